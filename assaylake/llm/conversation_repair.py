"""Repair of conversations by a forward Viterbi pass over four grammar states.

A well-formed conversation has the role initials ``(s?(ua)+)?``. Its grammar has
four states: nothing yet, after the system turn, after a user, after an
assistant. Each turn is kept, given another role or deleted, and empty turns may
be inserted. A layer holds, for each state, the least (cost, audit string) that
reaches it; the initials of the edits make up the audit string. Every turn's
layer is closed by inserts: one leads to a user, one more to an assistant, and
longer chains only come back dearer, so one round closes it.

Turns are sorted over the cluster by conversation and turn and cut into
partitions; a conversation that runs over several partitions is several
segments. The first conversation of a partition is passed from each of the four
states, so its segment is a 4 x 4 table of (cost, audit); the tables of a
conversation are multiplied in order. A conversation of any length is so spread
over tasks, and no task holds texts: survivors soon share their past, and the
shared part of their audits is put away as the pass goes on.

Two audits of equal cost over the same turns are never a prefix of one another
(the longer one would hold more inserts), so the least audit of a state stays
least whatever follows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import Tables, cut, ship, table

#: Costs of the edits; an undeleted truncated turn adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

START, SYSTEM, USER, ASSISTANT = range(4)

#: The state that a role initial leads to.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")

#: Characters that make a text blank.
BLANKS = " \t\n\x0b\x0c\r"

#: Audits of this length put their shared part away.
LONG_AUDIT = 512

ORDER = ("conv_id", "turn", "role", "digest")

Layer = list[tuple[float, str]]
NOWHERE = (math.inf, "")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of ``conversations`` after damage that its keys decide.

    crc32 of ``conv_id:turn``, divided by 20, leaves 0: the row is dropped; 1:
    its text is emptied; 2: its ``[.!?]`` go; 3: it stands twice; 4: its role
    becomes user. Nulls count as one space, in the key too; a null id or turn
    stays null. Other columns are left out.
    """

    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    luck = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    text = F.when(luck == 1, "").when(luck == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(luck == 4, "user").otherwise(text_of("role"))
    copies = F.when(luck == 3, 2).otherwise(1).cast("long")
    return conversations.where(luck != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def turns(rows: DataFrame, tables: Tables) -> DataFrame:
    """One row for each different turn: conv_id, turn, role, text, copies, digest and fault of its first copy.

    Further copies, and turns whose role and text came earlier in the
    conversation, are duplicates. Equal rows are counted before anything is
    exchanged by conversation, so a row repeated without end is one row.
    """
    held = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    bare = F.rtrim("text", F.lit(BLANKS))
    own = F.when(F.length(bare) == 0, "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    held = tables.cut(held.withColumns({"digest": F.md5("text"), "own": own}), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = held.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    met = held.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    repeated = F.col("first.known").cast("int") < F.col("turn").isNotNull().cast("int")
    repeated = repeated | F.coalesce(F.col("first.turn") < F.col("turn"), F.lit(False))
    fault = F.when(F.col("own") == "blank", "blank").when(repeated, "duplicate").otherwise(F.coalesce("own", F.lit("")))
    return met.select("conv_id", "turn", "role", "text", "copies", "digest", fault.alias("fault"))


def with_inserts(layer: Layer) -> Layer:
    """The layer closed under inserted turns."""

    def inserted(state: int) -> tuple[float, str]:
        return layer[state][0] + INSERT, layer[state][1] + "I"

    layer = list(layer)
    layer[USER] = min(layer[USER], inserted(START), inserted(SYSTEM), inserted(ASSISTANT))
    layer[ASSISTANT] = min(layer[ASSISTANT], inserted(USER))
    return layer


def passed(layer: Layer, initial: str, fault: str, copies: int = 1) -> Layer:
    """The closed layer after a turn and its further copies, which are duplicates.

    An insert before a deletion sorts behind one after it, so the copies are
    deleted before the layer is closed.
    """
    out = [(cost + DELETE, audit + "D") for cost, audit in layer]
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        for (state, letter), to in STEPS.items():
            cost, audit = layer[state]
            if letter == initial:
                out[to] = min(out[to], (cost + extra, audit + "K"))
            if to in ROLES:
                out[to] = min(out[to], (cost + extra + REROLE, audit + "R"))
    if copies > 1:
        out = [(cost + DELETE * (copies - 1), audit + "D" * (copies - 1)) for cost, audit in out]
    return with_inserts(out)


class Pass:
    """A pass over consecutive turns from one layer; the shared beginning of the audits is put away in parts."""

    def __init__(self, layer: Layer):
        self.layer, self.shared = layer, []

    def take(self, initial: str, fault: str, copies: int) -> None:
        self.layer = passed(self.layer, initial, fault, copies)
        live = [audit for cost, audit in self.layer if cost < math.inf]
        if max(map(len, live), default=0) > LONG_AUDIT and (shared := commonprefix(live)):
            self.shared.append(shared)
            self.layer = [(cost, audit[len(shared) :]) for cost, audit in self.layer]

    def row(self) -> tuple[list[int | None], list[str | None]]:
        before = "".join(self.shared)
        return [None if c == math.inf else int(c) for c, _ in self.layer], [None if c == math.inf else before + a for c, a in self.layer]


def at_start() -> Layer:
    return with_inserts([(0, ""), NOWHERE, NOWHERE, NOWHERE])


def _entering(state: int) -> Layer:
    return [(0, "") if s == state else NOWHERE for s in range(4)]


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, part, entry, costs, audits, first, last, illegal): each partition's stretch of each conversation.

    ``entry`` is the state it was passed from, -1 for the start of a conversation
    with its inserts. costs and audits are null for states out of reach.
    """
    spread = rows.select(*ORDER, F.substring("role", 1, 1).alias("initial"), "fault", "copies")
    placed = spread.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    kind = pa.schema(
        [("conv_id", placed_type(rows, "conv_id")), ("part", pa.int32()), ("entry", pa.int32()), ("costs", pa.list_(pa.int64()))]
        + [("audits", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())]
    )
    id_kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first_one, at, held = TaskContext.get().partitionId(), True, None, {}

        def ended() -> list[dict]:
            return [{"conv_id": at[0], "part": part, "entry": e, "first": first, "last": last, "illegal": illegal} | dict(zip(("costs", "audits"), p.row(), strict=True)) for e, p in held.items()]

        for batch in batches:
            out = []
            ids = batch.column("conv_id").to_pylist()
            for conv_id, initial, fault, copies in zip(ids, *(batch.column(n).to_pylist() for n in ("initial", "fault", "copies")), strict=True):
                if at is None or at[0] != conv_id:
                    if at is not None:
                        out += ended()
                        first_one = False
                    at = (conv_id,)
                    held = {s: Pass(_entering(s)) for s in range(4)} if first_one else {-1: Pass(at_start())}
                    first, last, illegal = initial, None, 0
                if last is not None:
                    illegal += last + initial not in LEGAL
                illegal, last = illegal + copies - 1, initial
                for p in held.values():
                    p.take(initial, fault, copies)
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)
        if at is not None:
            yield pa.RecordBatch.from_pylist(ended(), kind)

    return placed.mapInArrow(run, f"conv_id {id_kind}, part int, entry int, costs array<bigint>, audits array<string>, first string, last string, illegal bigint")


def placed_type(rows: DataFrame, name: str) -> pa.DataType:
    """The Arrow type of a column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[name].dataType)


def joined(parts: list[dict]) -> tuple[int, str, int]:
    """Cost, audit and illegal pairs of a conversation from the rows of its segments."""
    by_part: dict[int, dict[int, dict]] = {}
    for row in parts:
        by_part.setdefault(row["part"], {})[row["entry"]] = row
    layer, illegal, last = at_start(), 0, None
    for part in sorted(by_part):
        held = by_part[part]
        one = next(iter(held.values()))
        illegal += one["illegal"] + (last is not None and last + one["first"] not in LEGAL)
        last = one["last"]
        reached = {-1: (0, "")} if -1 in held else dict(enumerate(layer))
        layer = [
            min((c + held[e]["costs"][to], a + held[e]["audits"][to]) if held[e]["costs"][to] is not None else NOWHERE for e, (c, a) in reached.items())
            for to in range(4)
        ]
    cost, audit = min(layer[START], layer[ASSISTANT])
    return int(cost), audit, illegal


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, illegal) of every conversation of ``turns``.

    A conversation has few segments (four rows in each partition that it
    reaches), which meet in one row.
    """
    parts = segments(rows)
    kind = placed_type(rows, "conv_id")
    held = parts.groupBy("conv_id").agg(F.collect_list(F.struct(*(c for c in parts.columns if c != "conv_id"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [joined(p) for p in batch.column("parts").to_pylist()]
            columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)] if found else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").cast(kind), *columns], names=["conv_id", "cost", "audit", "illegal"])

    id_kind = rows.schema["conv_id"].dataType.simpleString()
    return held.mapInArrow(run, f"conv_id {id_kind}, cost bigint, audit string, illegal bigint")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text) of every repaired turn, in order, and (conv_id, None, None) where a conversation ends.

    Rows come sorted by conversation, the row with the audit before its turns.
    """
    at, audit, used, state = None, "", 0, START

    def inserts() -> Iterator[tuple]:
        nonlocal used, state
        while used < len(audit) and audit[used] == "I":
            used, state = used + 1, ASSISTANT if state == USER else USER
            yield at[0], ROLES[state], ""

    for batch in batches:
        for conv_id, plan, role, text, copies in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text", "copies")), strict=True):
            if plan is not None:
                if at is not None:
                    yield from inserts()
                    yield at[0], None, None
                at, audit, used, state = (conv_id,), plan, 0, START
                continue
            yield from inserts()
            edit, used = audit[used], used + copies
            if edit == "R":
                state = ASSISTANT if state == USER else USER
                yield conv_id, ROLES[state], text
            elif edit == "K":
                state = STEPS[state, role[0]]
                yield conv_id, role, text
    if at is not None:
        yield from inserts()
        yield at[0], None, None


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and turns, in one partition, sorted there by Spark; only the turns in hand are in memory."""
    plans = found.select("conv_id", "audit")
    both = rows.select(*ORDER, "text", "copies").unionByName(plans, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER[1:]).select("conv_id", "audit", "role", "text", "copies")


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position (from 0), role and text.

    Reads conv_id, turn, role and text; nulls of role and text count as one
    space. Turns of a conversation are taken by turn, nulls first, ties by role
    and then by the MD5 of the text; rows equal in all four are copies of one
    turn. Blank turns and duplicates are deleted; other edits are the cheapest
    that give the grammar, ties to the audit string that is least in ASCII. A
    null conv_id is a conversation too. A conversation whose turns are all
    deleted has no row; nor has an empty table.
    """
    ship(conversations.sparkSession)
    tables = Tables(conversations.sparkSession)
    space = [F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")]
    try:
        rows = tables.cut(turns(conversations.select("conv_id", "turn", *space, F.lit(1).cast("long").alias("copies")), tables), "faults")
        kind = placed_type(rows, "conv_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, size, position = [], 0, 0
            for conv_id, role, text in edited(batches):
                if role is None:
                    position = 0
                    continue
                out.append((conv_id, position, role, text))
                position, size = position + 1, size + len(text) + 64
                if size > 2_000_000:
                    yield _batch(out, kind)
                    out, size = [], 0
            if out:
                yield _batch(out, kind)

        id_kind = rows.schema["conv_id"].dataType.simpleString()
        return cut(_in_order(rows, audits(rows)).mapInArrow(run, f"conv_id {id_kind}, position bigint, role string, text string"), "repaired")
    finally:
        tables.clear()


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, positions, roles, texts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(positions, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=["conv_id", "position", "role", "text"])


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, cheapest repair and the digest of its text for every conversation of ``conversations``.

    ``rows`` are the turns to look at (conv_id, turn, role, text, copies), of
    conversations that ``conversations`` names; one without a turn there has
    zeros, an empty audit and the digest of an empty text. Order, ties, copies
    and null ids are as ``repair`` states. gaps is the number of turn numbers
    missing between the least and the greatest, nulls aside; a span beyond 64
    bits has null. Columns besides conv_id of ``conversations`` are not read.
    An empty table gives no rows.
    """
    ship(conversations.sparkSession)
    tables = Tables(conversations.sparkSession)
    try:
        held = tables.cut(turns(rows, tables), "faults")

        def number(fault: str, further: bool = False) -> Column:
            copies = F.when(F.col("fault") == fault, F.col("copies") if fault != "truncated" else F.lit(1))
            if further:  # copies of a turn that is itself neither blank nor a duplicate
                copies = F.when(F.col("fault") == fault, F.col("copies")).when(F.col("fault") != "blank", F.col("copies") - 1)
            return F.coalesce(F.sum(copies), F.lit(0)).alias(fault)

        wide = F.max(F.col("turn").cast("decimal(20,0)")) - F.min(F.col("turn").cast("decimal(20,0)")) + 1
        counted = held.groupBy("conv_id").agg(
            F.when(F.max("turn").isNull(), 0).otherwise((wide - F.countDistinct("turn")).try_cast("bigint")).alias("gaps"),
            number("blank"),
            number("duplicate", further=True),
            number("truncated"),
        )
        found = tables.cut(audits(held), "audits")
        kind = placed_type(held, "conv_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest, empty, ids, digests = hashlib.sha256(), True, [], []
            for conv_id, role, text in edited(batches):
                if role is None:
                    ids.append(conv_id)
                    digests.append(digest.hexdigest())
                    digest, empty = hashlib.sha256(), True
                else:
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])

        id_kind = held.schema["conv_id"].dataType.simpleString()
        hashed = _in_order(held, found).mapInArrow(run, f"conv_id {id_kind}, repaired_sha256 string")
        out = conversations.select(F.col("conv_id").alias("asked")).distinct()
        for k, part in enumerate((counted, found, hashed)):
            own = part.withColumnRenamed("conv_id", f"id{k}")
            out = out.join(own, F.col("asked").eqNullSafe(F.col(f"id{k}")), "left")
        zero = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
        gaps = F.when(F.col("cost").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps")
        empty = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
        return cut(out.select(F.col("asked").alias("conv_id"), gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"), empty), "conversations")
    finally:
        tables.clear()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return report(conversations, damage(conversations))


def _least(*entries: str) -> str:
    return f"list_min([{', '.join(entries)}])"


def _plus(state: str, cost: str, edit: str) -> str:
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} end"


#: The same report for DuckDB: one step of the recursion passes one turn of every conversation.
SQL = f"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ord(x) as bigint)) as bytes
  from conversations),
lucky as (
  select * exclude (bytes),
         xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b:
               list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 as luck
  from keyed),
damaged as (
  select conv_id, turn, case when luck = 4 then 'user' else role end as role,
         case luck when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from lucky, generate_series(1, case luck when 0 then 0 when 3 then 2 else 1 end)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare
  from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by k) as nth from placed),
rows_ as (
  select conv_id, turn, k, role, text, substr(role, 1, 1) as i,
         case when bare = '' then 'b' when nth > 1 then 'd' when right(bare, 1) not in ('.', '!', '?') then 't' else '' end as fault,
         lag(substr(role, 1, 1)) over (partition by conv_id order by k) as before
  from seen),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) as n,
         count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
         count(*) filter (k > 1 and before || i not in ('su', 'ua', 'au')) as illegal
  from rows_ group by conv_id),
dp as (
  select conv_id, 0 as k, {{'c': 0, 'a': ''}} as s0, cast(null as struct(c integer, a varchar)) as s1, {{'c': {INSERT}, 'a': 'I'}} as s2, {{'c': {2 * INSERT}, 'a': 'II'}} as s3
  from counted
  union all
  select conv_id, k, s0, s1, u, {_least("s3", _plus("u", str(INSERT), "I"))}
  from (
    select conv_id, k, s0, s1, s3, {_least("s2", _plus("s0", str(INSERT), "I"), _plus("s1", str(INSERT), "I"), _plus("s3", str(INSERT), "I"))} as u
    from (
      select r.conv_id, r.k,
             {_plus("p.s0", str(DELETE), "D")} as s0,
             {_least(_plus("p.s1", str(DELETE), "D"), f"case when f and i = 's' then {_plus('p.s0', 'x', 'K')} end")} as s1,
             {_least(_plus("p.s2", str(DELETE), "D"), *(f"case when f and i = 'u' then {_plus(s, 'x', 'K')} end" for s in ("p.s0", "p.s1", "p.s3")), *(f"case when f then {_plus(s, f'x + {REROLE}', 'R')} end" for s in ("p.s0", "p.s1", "p.s3")))} as s2,
             {_least(_plus("p.s3", str(DELETE), "D"), f"case when f and i = 'a' then {_plus('p.s2', 'x', 'K')} end", f"case when f then {_plus('p.s2', f'x + {REROLE}', 'R')} end")} as s3
      from dp p join (select *, fault not in ('b', 'd') as f, case when fault = 't' then {TRUNCATED} else 0 end as x from rows_) r
        on r.conv_id is not distinct from p.conv_id and r.k = p.k + 1))),
best as (
  select d.conv_id, {_least("d.s0", "d.s3")} as b from dp d join counted c on c.conv_id is not distinct from d.conv_id and c.n = d.k),
edits as (
  select conv_id, b.c as cost, b.a as audit, j, substr(b.a, cast(j as integer), 1) as e,
         length(regexp_replace(substr(b.a, 1, cast(j as integer)), 'I', '', 'g')) as k,
         length(regexp_replace(substr(b.a, 1, cast(j as integer)), 'D', '', 'g')) as m
  from best, generate_series(1, length(b.a)) g(j)),
kept as (
  select e.conv_id, e.j, e.m, e.e, r.role, r.text, coalesce(max(case when e.m = 1 and e.e = 'K' and r.i = 's' then 1 end) over (partition by e.conv_id), 0) as systems
  from edits e left join rows_ r on e.e <> 'I' and r.conv_id is not distinct from e.conv_id and r.k = e.k
  where e.e <> 'D'),
hashed as (
  select conv_id, sha256(string_agg(
           case when e = 'K' then role when (m - systems) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by j)) as repaired_sha256
  from kept group by conv_id)
select a.conv_id, cast(coalesce(c.gaps, 0) as bigint) as gaps, cast(coalesce(c.blank, 0) as bigint) as blank, cast(coalesce(c.duplicate, 0) as bigint) as duplicate,
       cast(coalesce(c.truncated, 0) as bigint) as truncated, cast(coalesce(c.illegal, 0) as bigint) as illegal, cast(coalesce(b.b.c, 0) as bigint) as cost,
       coalesce(b.b.a, '') as audit, coalesce(h.repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join counted c on c.conv_id is not distinct from a.conv_id
left join best b on b.conv_id is not distinct from a.conv_id
left join hashed h on h.conv_id is not distinct from a.conv_id
"""
