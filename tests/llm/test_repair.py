import hashlib
import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from gridspark.llm.queries import QUERIES, _repair_digests
from gridspark.llm.repair import repair
from tests.conftest import SF001

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
DIGESTS = ("conv_id string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def ordered(rows):
    return sorted(((r[1] is not None, r[1] or 0), r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ")
                  for r in rows)


def best(turns):
    """(cost, edits, turns) by trying every edit at every place, least first."""
    seen, faults = set(), []
    for _, role, text in turns:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else
                      "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def rest(i, initials, inserts):
        """From row ``i`` on, the last initials put out being s, u, a or none."""
        found = []
        if i == len(turns) and initials in ("", "a"):
            found.append((0, "", ()))
        options = []
        if inserts < 2:
            options += [("I", r, "", 5, i, inserts + 1) for r in ("user", "assistant")]
        if i < len(turns):
            _, role, text = turns[i]
            options.append(("D", None, None, 2, i + 1, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                options.append(("K", role, text, more, i + 1, 0))
                options += [("R", r, text, 1 + more, i + 1, 0) for r in ("user", "assistant")]
        for letter, role, text, cost, j, n in options:
            if role is None:
                after = rest(j, initials, n)
            elif re.fullmatch("s|u|su|ua|au", initials + role[:1]) and role[:1] != "":
                after = rest(j, role[:1], n)
            else:
                continue
            if after:
                found.append((cost + after[0], letter + after[1], (() if role is None else ((role, text),)) + after[2]))
        return min(found, default=None)

    return rest(0, "", 0), faults


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = ordered(r for r in rows if r[0] == conv)
        (cost, audit, put), faults = best(turns)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        shown = "\n".join(f"{r}:{t}" for r, t in put)
        out[None if conv is None else str(conv)] = (
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
            hashlib.sha256(shown.encode()).hexdigest())
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = (repair(df, **kw).withColumn("conv_id", F.col("conv_id").cast("string")).repartition("conv_id")
           .sortWithinPartitions("conv_id", "segment", "at").mapInPandas(_repair_digests, DIGESTS))
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def made(rnd, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"]
    texts = ["Yes.", "No", "", " \t\n", "Why?  ", "a", "b!", None, "Yes."]
    return [(conv, rnd.choice([None, *range(max(1, n))]), rnd.choice(roles), rnd.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("segment", [2, 5, 8192])
def test_matches_brute_force(spark, segment):
    rnd = random.Random(segment)
    rows = [r for conv in [None, *range(60)] for r in made(rnd, conv, rnd.randint(1, 9))]
    rows += [r for conv in range(100, 104) for r in made(rnd, conv, 60)]
    rows += [(200, t, "user" if t % 2 == 0 else "assistant", f"line {t}.") for t in range(40)]
    assert run(spark, rows, segment=segment) == brute(rows)


def test_conversation_over_many_tasks(spark):
    rnd, rows = random.Random(3), []
    for t in range(6000):
        rows.append((7, t, rnd.choice(["user", "assistant", "user", "assistant", "system"]),
                     rnd.choice(["Fine.", "cut", " "]) if rnd.random() < .5 else f"{t}."))
    rows += made(rnd, 8, 12)
    few, many = run(spark, rows, segment=64), run(spark, rows)
    assert few == many
    assert few["8"] == brute(rows[6000:])["8"] and few["7"][5] != "" and len(few["7"][5]) >= 6000


def test_many_equal_rows_are_copies(spark):
    rows = [(1, 0, "user", "Hi.")] * 200 + [(1, 1, "assistant", "Hello.")] + [(2, None, "assistant", "x" * 300_000 + ".")]
    assert run(spark, rows) == brute(rows)
    out = repair(spark.createDataFrame(rows, SCHEMA)).where("conv_id = 1 and copies = 200").collect()
    assert [r.edits for r in out] == ["K" + "D" * 199]


def test_clashing_columns_types_and_empty_table(spark):
    df = spark.createDataFrame([("x", 2, "user", "Hi.", 1, 2, "a"), ("x", 3, "assistant", "Yes.", 1, 2, "b")],
                               "conv_id string, turn int, role string, text string, copies long, segment long, turns string")
    out = repair(df)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema][:2] == [("conv_id", "string"), ("turn", "int")]
    assert [(r.turn, r.edits, r.cost, r.illegal) for r in out.orderBy("turn").collect()] == [(2, "K", 0, 0), (3, "K", 0, 0)]
    assert repair(df.limit(0)).count() == 0


def test_query_returns_every_conversation(spark):
    out = QUERIES["op13_conversation_repair"](spark, SF001).collect()
    convs = spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id").distinct().count()
    assert len(out) == convs == len({r.conv_id for r in out})
    for r in out:
        assert len(r.audit) >= 0 and set(r.audit) <= set("DIKR") and r.cost >= 0
