"""Exact top-k inner products by Fagin's threshold algorithm, in blocks.

Vectors are dealt into blocks by a hash, queries into blocks likewise, and each
pair of blocks is one group. In a group every dimension has a list of the
vectors sorted by that component. A query reads all lists in step, from the end
that helps it: from the top where its own component is positive, from the
bottom where it is negative. Vectors seen for the first time are scored in
full. The components at the current depth bound what any unseen vector can
score; once that bound cannot beat the k-th best score, the search stops. Ties
go to the smaller id, so it goes on while the bound still equals that score.

The k best of each block are merged by one ranking over k rows for each query
and block. Neither vectors nor queries are broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import ship, table

K = 5
SCALE = 256
EVERY = 50

#: Vectors and queries in a block, on average.
BLOCK = 8192
QUERIES = 8192

#: Entries that a query reads from each list at first; each further step reads twice as many.
FIRST_STEP = 16

RESULT = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not empty and holds finite components only."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad)


def integers(vectors: DataFrame, vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components turned into floor(scale * x)."""
    return usable(vectors, vec).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def search(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows for one query; ``order`` holds the ascending list of each dimension."""
    n = len(ids)
    live = np.flatnonzero(query)
    up = query[live] > 0
    seen = ids == own
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, FIRST_STEP
    while at < n:
        upto = min(n, at + step)
        if len(live):
            from_top = order[live[up], n - upto : n - at]
            from_bottom = order[live[~up], at:upto]
            fresh = np.zeros(n, bool)
            fresh[from_top.ravel()] = True
            fresh[from_bottom.ravel()] = True
            fresh &= ~seen
        else:
            fresh, upto = ~seen, n
        found = np.flatnonzero(fresh)
        seen |= fresh
        at, step = upto, step * 2
        best_ids, best = np.append(best_ids, ids[found]), np.append(best, rows[found] @ query)
        first = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[first], best[first]
        if at < n and len(best) == k:
            # an unseen row lies at depth ``at`` or below it in every list
            edge = np.where(up, rows[order[live, n - 1 - at], live], rows[order[live, at], live])
            if best[-1] > int(edge @ query[live]):
                break
    return best_ids, best


def search_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best vectors of one block for each query of the other; vectors of another length don't take part."""
    out = []
    for length, asked in queries.groupby(queries["v"].map(len)):
        held = vectors[vectors["v"].map(len) == length]
        if not len(held):
            continue
        rows, ids = np.stack(held["v"].to_numpy()).astype(np.int64), held["vec_id"].to_numpy()
        largest = max(int(np.abs(rows).max(initial=0)), max(int(np.abs(np.asarray(v)).max(initial=0)) for v in asked["v"]))
        if largest * largest * length >= 1 << 63:
            raise ValueError("components are too large for scores of 64 bits")
        order = np.ascontiguousarray(rows.argsort(axis=0, kind="stable").T)
        for query_id, v in zip(asked["vec_id"], asked["v"], strict=True):
            got, scores = search(np.asarray(v, np.int64), query_id, ids, rows, order, k)
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": got, "score": scores}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, vec: str = "embedding", block: int = BLOCK, queries_a_block: int = QUERIES) -> DataFrame:
    """The k best rows for every query row, a row whose vec_id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id and score, the inner product of the
    integers; fewer than k rows where there are fewer candidates. Rows with a
    null id, or a vector that is null, empty or holds a null or non-finite
    component, take no part. A query is not its own candidate, nor is a row
    that repeats its id; rows that repeat another id are ranked once each. A
    query id with several vectors is searched by the least of them, compared
    component by component. Ties of score go to the smaller vec_id. Vectors of
    unequal length never meet. Components so large that a score could leave 64
    bits are an error. Other columns are left out; an empty table gives no rows.
    """
    ship(vectors.sparkSession)
    total = vectors.count()
    n_blocks, n_groups = max(1, -(-total // block)), max(1, -(-total // (every * queries_a_block)))
    rows = integers(vectors, vec)
    dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("g"))
    asked = (
        rows.where(F.col("vec_id") % every == 0)
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_groups)).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("b"))
    )

    def run(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return search_block(queries, held, k)

    found = asked.groupBy("g", "b").cogroup(dealt.groupBy("g", "b")).applyInPandas(run, RESULT)
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: The same search for DuckDB.
SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
asked as (select vec_id, min(e) as e from v where vec_id % {EVERY} = 0 group by vec_id),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from asked q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= {K}
"""
