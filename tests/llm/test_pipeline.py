import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import plain_ids
from tests.llm.test_simhash import classes, plain
from gridspark.llm.decontaminate import drop_contaminated
from gridspark.llm.words import words_of

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_by_name():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]


def test_each_stage_on_its_own_input_and_the_whole_run(spark):
    docs = P.table(spark, SF, "documents")
    columns, before = docs.columns, rows(docs)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, SF), f"test-{name}")
        after = rows(docs)
        assert docs.columns == columns and docs.count() == len(after) and set(after) <= set(before)
        if name == "toxicity":
            gone = set(before) - set(after)
            assert all(after[k] == before[k] for k in after) and len(gone) < 0.2 * len(before)
            assert sum(labels.get(k) == 0 for k in gone) <= 0.05 * len(gone)
        elif name == "line_dedup":
            want = {k: t for k, t, _, _ in brute_lines(sorted(before.items()), 20, 3)}
            assert after == want and before != want
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "simhash":
            prints = {k: plain(t) for k, t in before.items()}
            of = classes(prints, [(a, b) for a in prints for b in prints
                                  if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
            assert set(after) == set(of.values()) and all(after[k] == before[k] for k in after)
        else:
            words = {k: words_of(t) for k, t in before.items()}
            bench = [words_of(b) for _, b in items if len(words_of(b)) >= 5]
            leaks = {k for k, w in words.items() for b in bench if f" {' '.join(b)} " in f" {' '.join(w)} "}
            assert not leaks & set(after) and all(after[k] == before[k] for k in after)
            grams = {tuple(b[i:i + 6]) for b in bench for i in range(len(b) - 5)}
            short = [tuple(b) for b in bench if len(b) < 13]
            clean = {k for k, w in words.items() if not any(tuple(w[i:i + 6]) in grams for i in range(len(w)))
                     and not any(tuple(w[i:i + len(b)]) == b for b in short for i in range(len(w)))}
            assert clean <= set(after)
        before = after
    out = P.STAGES[-1][1](spark, docs, SF).collect()
    seen = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        seen.setdefault(r.doc_id, []).append(r)
    assert set(seen) == set(before)
    for k, pieces in seen.items():
        ids = np.array(plain_ids(before[k]), dtype="<u4")
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    again = P.run(spark, SF).select("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, again.collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in out)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    kept = P.toxicity(spark, P.table(spark, d, "documents"), d).select("doc_id")
    stay = dict(labels.join(kept, "doc_id").groupBy("toxic").count().collect())
    all_ = dict(labels.join(P.table(spark, d, "documents"), "doc_id").groupBy("toxic").count().collect())
    assert stay[0] >= 0.995 * all_[0] and stay.get(1, 0) <= 0.15 * all_[1]


def test_odd_rows_pass_through_every_stage(spark):
    t = " ".join(f"word{i}" for i in range(50))
    docs = spark.createDataFrame([(None, None, "en", None, None, "x"), (1, "", "en", "s", 0, "x"), (2, t, None, "s", 9, "x"),
                                  (2, t, None, "s", 9, "x"), (3, t + " more", "en", "s", 1, "x"), (None, t * 300, "en", "s", 2, "x")],
                                 "doc_id long, text string, lang string, source string, n_chars long, score string")
    for part in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            part = P.written(stage(spark, part, SF), "test-odd")
        assert part.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kept = P.simhash(spark, docs, SF)
    assert kept.where("doc_id = 2").count() == 1 and kept.columns == docs.columns


def test_leaks_are_dropped_with_extra_columns(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("a b c "), "text").alias("text"), F.lit(1).alias("item_id"))
    assert drop_contaminated(docs, items).count() == 0
