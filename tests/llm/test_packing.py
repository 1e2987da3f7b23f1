import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gridspark.llm.packing import SHORT_PENALTY, Packer, choose_cuts, pack, padding
from gridspark.llm.queries import op3_packing, tokenizer_path
from gridspark.llm.tokens import tokenizer

PATH = tokenizer_path()


LIBRARY = Tokenizer.from_file(PATH)


def plain_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
def test_ids_are_those_of_the_library_any_text(text):
    assert tokenizer(PATH).encode(text).tolist() == plain_ids(text)[:-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzA'sltd 0189\n\t\r.,!?-_éÈñßü¿¡«»×÷²½ªº–’…~"), max_size=120))
def test_ids_are_those_of_the_library_plain_text(text):
    assert tokenizer(PATH)._fast is not None
    assert tokenizer(PATH).encode(text).tolist() == plain_ids(text)[:-1]


def test_ids_with_a_special_string():
    assert tokenizer(PATH).encode("a<|endoftext|>b").tolist() == plain_ids("a<|endoftext|>b")[:-1]


def price(n, m):
    short = n < m and n & (n - 1) == 0
    return min(m - n, SHORT_PENALTY if short else m - n)


def least_cost(pos, pen, m):
    cost = [0.0]
    for j in range(1, len(pos)):
        cost.append(min(cost[i] + price(pos[j] - pos[i], m) + pen[j] for i in range(j) if pos[j] - pos[i] <= m))
    return cost[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 128), st.sampled_from([0.0, 1.0, 8.0, 64.0])), min_size=1, max_size=40))
def test_cuts_are_optimal(steps):
    pos = np.concatenate(([0], np.cumsum([s for s, _ in steps])))
    pen = np.array([0.0] + [p for _, p in steps])
    cuts = [0] + choose_cuts(pos, pen, 128)
    assert cuts[-1] == len(pos) - 1
    lengths = np.diff(pos[cuts])
    assert lengths.max() <= 128
    got = sum(price(int(n), 128) for n in lengths) + sum(pen[c] for c in cuts[1:])
    assert got == pytest.approx(least_cost(pos.tolist(), pen.tolist(), 128))


def test_packer_keeps_order_over_chunks(monkeypatch):
    import gridspark.llm.packing as P
    monkeypatch.setattr(P, "CHUNK_TOKENS", 40)
    rnd = random.Random(3)
    docs = [np.array([rnd.randrange(50) for _ in range(rnd.choice([1, 2, 5, 33, 130]))], dtype=np.uint32) for _ in range(60)]
    ends = np.zeros(50, dtype=bool)
    ends[7] = True
    p, rows = Packer(ends, 16), []
    for i, d in enumerate(docs):
        rows += p.add(i, d)
    rows += p.flush(True)
    check([(k, s, n, np.frombuffer(b, "<u4"), t, q, o) for k, s, n, b, t, q, o in rows], dict(enumerate(docs)), 16)
    assert [r[5] for r in rows] == sorted(r[5] for r in rows)


def check(rows, docs, m):
    own, seq = defaultdict(list), defaultdict(list)
    for k, s, n, ids, t, q, o in rows:
        assert n == len(ids) and n > 0 and t == len(docs[k])
        own[k].append((s, ids))
        seq[q].append((o, n))
    assert set(own) == set(docs)
    for k, parts in own.items():
        parts.sort(key=lambda x: x[0])
        assert [s for s, _ in parts] == [0, *np.cumsum([len(i) for _, i in parts])[:-1]]
        assert np.array_equal(np.concatenate([i for _, i in parts]), docs[k])
    for parts in seq.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= m
    total = sum(len(d) for d in docs.values())
    return sum(padding(sum(n for _, n in p), m) for p in seq.values()) / total


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: np.array(plain_ids(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pack(spark.read.parquet(f"{d}/documents.parquet"), PATH).collect()
    waste = check([(r.doc_id, r.start, r.length, np.frombuffer(r.ids, "<u4"), r.doc_tokens, r.sequence_id, r.offset)
                   for r in rows], docs, 2048)
    assert waste < 0.02
    got = {(r.doc_id, r.start): r.ids_crc32 for r in op3_packing(spark, d).collect()}
    assert got == {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in rows}


def test_nulls_repeats_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "hi there", "x"), (2, "hi there", "x")],
                               "doc_id long, text string, ids string")
    rows = pack(df, PATH).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.doc_tokens) for r in rows) == [(-1, 1), (1, 1), (2, 3), (2, 3)]
    assert pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        pack(df, PATH, max_len=1000)


def test_rows_without_an_id_spread_over_tasks(spark):
    rows = [(None, f"text number {i} of many") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")    # so small a table would be put together again
    try:
        got = pack(df, tokenizer_path(), max_len=256).collect()
    finally:
        spark.conf.set(key, before)
    assert len({r.sequence_id >> 40 for r in got}) == 4
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert len([r for r in got if r.start == 0]) == 2000
