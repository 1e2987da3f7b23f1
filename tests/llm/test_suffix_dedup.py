import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridspark.llm.suffix_dedup as S
from gridspark.llm.queries import op8_suffix_dedup
from gridspark.llm.suffix_dedup import repeated_bytes


def brute(docs, length):
    """docs in order, by id; every row a document of its own."""
    seen, out = set(), {}
    for key, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        out[key] = (raw if not gone.any() else bytes(np.frombuffer(raw, np.uint8)[~gone]),
                    list(zip(edges[::2].tolist(), edges[1::2].tolist())), len(raw))
    return out


def run(spark, docs, length, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.spans], r.n_bytes) for r in repeated_bytes(df, length).collect()}


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    shared = [words(rnd, rnd.randint(5, 40)) for _ in range(6)]
    docs = []
    for i in range(60):
        t = " ".join(rnd.choice(shared) if rnd.random() < 0.4 else words(rnd, rnd.randint(1, 12)) for _ in range(rnd.randint(0, 6)))
        if i and rnd.random() < 0.3:   # a near copy
            t = docs[rnd.randrange(i)][1] or ""
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randint(0, len(t))
                t = t[:at] + rnd.choice("xyz") * rnd.randint(0, 2) + t[at + rnd.randint(0, 2):]
        docs.append((i * 7 - 100, t))
    docs += [(1000, None), (1001, ""), (1002, "z" * 90), (1003, "ab" * 200), (1004, "z" * 700)]
    assert run(spark, docs, 20 + 10 * seed) == brute(sorted(docs), 20 + 10 * seed)


def test_small_segments_and_many_stretches(spark, monkeypatch):
    # segments and the batch limit are read in the driver's process only: compare the record stage directly
    rnd = random.Random(9)
    line = words(rnd, 30)
    docs = [(i, words(rnd, 4) + line + words(rnd, 4)) for i in range(80)]
    assert run(spark, docs, 40) == brute(docs, 40)
    for seg in (64, 1 << 19):
        monkeypatch.setattr(S, "_SEGMENT", seg)
        text = words(rnd, 400).encode()
        starts = []
        for at, b in S.pieces(text, 40):
            _, anchor, lo, hi, _, _ = S.runs([b], 40, 22)
            starts += [s + at for x, y in zip(lo, hi) for s in range(x, y + 1)]
        assert starts == list(range(len(text) - 39))


def test_sorted_records_across_batches():
    import pandas as pd
    rnd = random.Random(1)
    rows = {(rnd.randrange(6), rnd.randrange(3), rnd.randrange(5), rnd.randrange(2), rnd.randrange(30), 0) for _ in range(200)}
    rows = sorted({(k, c if k % 2 else 0, d, t, a, n) for k, c, d, t, a, n in rows})
    frame = pd.DataFrame(rows, columns=["kh", "ch", "doc", "tag", "at", "kind"])

    def settle(size):
        s = S._Sorted()
        out = [S._places(s.add(frame[i:i + size])) for i in range(0, len(frame), size)]
        return sorted(map(tuple, pd.concat(out).to_numpy().tolist()))
    want = settle(len(frame))
    assert all(settle(n) == want for n in (1, 2, 3, 7, 50))
    first = {}
    for k, c, d, t, a, _ in rows:
        first.setdefault((k, c), (d, t, a))
    several = {k for k in range(6) if sum(x[0] == k for x in first) > 1}
    expect = [(d, t, a, S._REMOVED) for k, c, d, t, a, _ in rows if first[k, c] != (d, t, a)]
    expect += [(*v, S._OPEN) for (k, _), v in first.items() if k in several]
    assert want == sorted(expect)


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    want = {k: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
            for k, (kept, spans, n) in brute(docs, 100).items()}
    assert {r.doc_id: tuple(r)[1:] for r in op8_suffix_dedup(spark, d).collect()} == want


def test_null_ids_repeats_clashing_columns_and_empty(spark):
    t = "the same long passage of text again"
    df = spark.createDataFrame([(None, t, 1), (5, t, 1), (5, t, 1), (7, "q" + t, 1)], "doc_id long, text string, at int")
    got = sorted(((r.doc_id, bytes(r.kept).decode()) for r in repeated_bytes(df, 20).collect()), key=repr)
    assert got == [(5, ""), (5, ""), (7, "q"), (None, t)]
    assert repeated_bytes(df.limit(0), 20).count() == 0
    one = df.where("doc_id = 5").withColumn("doc", F.lit(1))
    assert [bytes(r.kept).decode() for r in repeated_bytes(one, 20).collect()] == [t, t]
    with pytest.raises(ValueError):
        repeated_bytes(df, 5)


@pytest.mark.parametrize("key", [None, 7])
def test_many_texts_of_one_id(spark, key):
    rnd = random.Random(1)
    rows = []
    for i in range(600):      # pairs of different texts that share their middle
        middle = hashlib.sha256(str(i).encode()).hexdigest() * 2
        rows += [(key, f"{rnd.random()} first {i} {middle} tail {rnd.random()}"), (key, f"{rnd.random()} again {i} {middle}")]
    rows.append(rows[0])
    out = repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 100)
    got = [(r.doc_id, r.n_bytes - len(r.kept)) for r in out.collect()]
    assert len(got) == 1201 and all(d == key for d, _ in got)
    gone = [n for _, n in got if n]
    assert 600 <= len(gone) <= 601 and min(gone) >= 128 and max(gone) < 145   # 601: the repeated row may be a later one
