"""Conversation repair against every edit sequence, over segments, hot and odd conversations."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from assaylake.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(cr.BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(rows, most_inserts=3):
    """Least (cost, audit, text) by trying all edits."""
    best = None
    own = faults(rows)
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in own]
    for edits in itertools.product(*choices):
        for slots in itertools.product(*[[()] + [c for n in range(1, most_inserts) for c in itertools.product(("Iu", "Ia"), repeat=n)]] * (len(rows) + 1)):
            cost, audit, roles, out = 0, "", "", []
            for k in range(len(rows) + 1):
                for i in slots[k]:
                    cost, audit, roles = cost + 5, audit + "I", roles + i[1]
                    out.append("user:" if i[1] == "u" else "assistant:")
                if k == len(rows):
                    break
                edit, (role, text) = edits[k], rows[k]
                audit += edit[0]
                if edit == "D":
                    cost += 2
                    continue
                cost += 5 * (own[k] == "truncated") + (edit[0] == "R")
                role = role if edit == "K" else {"u": "user", "a": "assistant"}[edit[1]]
                roles += role[:1] or "-"
                out.append(f"{role}:{text}")
            if GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(out))
    return best


def as_frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", copies long")


def reported(spark, rows):
    frame = as_frame(spark, rows)
    return {r["conv_id"]: r for r in cr.report(frame.select("conv_id"), frame).collect()}


def test_against_every_edit_sequence(spark):
    rng, rows, want = random.Random(5), [], {}
    for conv in range(60):
        own = [(rng.choice(("system", "user", "assistant", "tool", "user", "assistant")), rng.choice(("Yes.", "no", "", " \t", "Why? ", "Go!"))) for _ in range(rng.randint(1, 3))]
        rows += [(conv, k, *r) for k, r in enumerate(own)]
        want[conv] = (*every_repair(own, 3 if len(own) < 3 else 2), own)
    got = reported(spark, rows)
    for conv, (cost, audit, text, own) in want.items():
        r, f = got[conv], faults(own)
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), own
        assert (r["blank"], r["duplicate"], r["truncated"]) == tuple(f.count(x) for x in ("blank", "duplicate", "truncated"))
        initials = [role[0] for role, _ in own]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def plain(rows):
    """The pass over one conversation by one layer after another."""
    layer = cr.at_start()
    for (role, _), fault in zip(rows, faults(rows), strict=True):
        layer = cr.passed(layer, role[:1], fault)
    return min(layer[cr.START], layer[cr.ASSISTANT])


def test_a_long_conversation_spreads_over_tasks(spark):
    rng = random.Random(6)
    own = [(rng.choice(("user", "assistant", "user", "assistant", "system", "")), rng.choice((f"Turn {k}.", f"Turn {k}", "", "Same."))) for k in range(3000)]
    rows = [(7, k, *r) for k, r in enumerate(own)] + [(c, 0, "user", "Hi.") for c in (6, 8)]
    frame = as_frame(spark, rows)
    from assaylake.llm.common import Tables

    tables = Tables(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little stays in one partition
    parts = cr.segments(cr.turns(frame, tables)).where("conv_id = 7").select("part").distinct().count()
    tables.clear()
    assert parts > 1
    got = cr.report(frame.select("conv_id"), frame).where("conv_id = 7").first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (got["cost"], got["audit"]) == plain(own)


def test_audits_put_away_stay_whole(monkeypatch, spark):
    monkeypatch.setattr(cr, "LONG_AUDIT", 4)
    rng = random.Random(8)
    own = [(rng.choice(("user", "assistant", "system")), rng.choice((f"{k}.", f"{k}", ""))) for k in range(200)]
    held = cr.Pass(cr.at_start())
    for (role, _), fault in zip(own, faults(own), strict=True):
        held.take(role[:1], fault, 1)
    costs, audits = held.row()
    assert min((costs[s], audits[s]) for s in (cr.START, cr.ASSISTANT)) == plain(own) and held.shared


def test_copies_count_once_and_repeat_without_end(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi.", 4), (1, 1, "assistant", "Ho.", 1), (1, 2, "user", " ", 3)], SCHEMA + ", copies long")
    r = cr.report(frame.select("conv_id"), frame).first()
    assert (r["blank"], r["duplicate"], r["audit"], r["cost"], r["illegal"]) == (3, 3, "KDDDKDDD", 12, 5)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "A."), (None, 9, "assistant", "B."),
        (1, None, "user", "first."), (1, 0, "assistant", "then."),
        (2, None, "", "x"), (3, 5, "user", ""), (4, -(2**63), "user", "a."), (4, 2**63 - 1, "assistant", "b."),
        (5, 0, "user", "long " * 300_000 + "."), (5, 1, "assistant", "퟿ é."),
    ]
    clash = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", fault int, copies int")
    got = {r["conv_id"]: r for r in cr.report(clash, cr.damage(clash.where("false")).unionByName(as_frame(spark, [(a, b, c or " ", d if d is not None else " ") for a, b, c, d in rows]))).collect()}
    assert (got[None]["audit"], got[None]["blank"], got[None]["gaps"]) == ("DKK", 1, 5)
    assert (got[1]["audit"], got[1]["gaps"]) == ("KK", 0)
    assert (got[2]["audit"], got[2]["gaps"], got[3]["audit"]) == ("D", 0, "D")
    assert got[4]["gaps"] is None and got[4]["audit"] == "KK" and got[5]["audit"] == "KK"
    assert {r["conv_id"] for r in cr.repair(clash).collect()} == {None, 1, 4, 5}
    assert [r["role"] for r in cr.repair(clash).where("conv_id = 1").orderBy("position").collect()] == ["user", "assistant"]


def test_conversations_without_turns_and_empty_tables(spark):
    named = spark.createDataFrame([(1,), (1,), (2,)], "conv_id long")
    got = cr.report(named, as_frame(spark, [(2, 0, "user", "Hi.")])).orderBy("conv_id").collect()
    assert tuple(got[0]) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) and got[1]["audit"] == "D"
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.report(empty, cr.damage(empty)).count() == 0 and cr.repair(empty).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B!") for c in (*range(40), None) for t in (0, None)]
    got = {}
    for r in cr.damage(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["conv_id"], r["turn"]] = (r["role"], r["text"], r["copies"])
    for c, t, role, text in rows:
        luck = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = None if luck == 0 else ("user" if luck == 4 else role, "" if luck == 1 else "A B" if luck == 2 else text, 2 if luck == 3 else 1)
        assert got.get((c, t)) == want


def test_nothing_depends_on_the_layout(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    one = cr.report(conversations, cr.damage(conversations.coalesce(1))).orderBy("conv_id").collect()
    other = conversations.repartition(5, F.rand(3))
    assert one == cr.report(other, cr.damage(other)).orderBy("conv_id").collect()
