import random

import xxhash
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridspark.llm.components import connected_components
from gridspark.llm.simhash import fingerprint, fingerprint_links, keep_one_per_group, near_duplicates


def plain(text, n=3):
    words = bytes(text or "", "utf-8").lower().split()
    grams = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(nodes, links):
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            of[n] = of[of[n]]
            n = of[n]
        return n
    for a, b in links:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBÉ \t\n\v\x1c "), max_size=60))
def test_fingerprint_is_the_contract(text):
    assert fingerprint(text) == plain(text)


def test_spark_hash_agrees(spark):
    df = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t"))
    assert df.first()[0] % 2**64 == fingerprint("A  b\tc")


def test_links_find_every_pair(spark):
    rnd = random.Random(5)
    for bits in (1, 2, 3, 5):
        prints = set()
        for _ in range(60):
            base = rnd.getrandbits(64)
            prints.add(base)
            for _ in range(6):
                prints.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, bits + 2))))
        prints |= {0, 1, 2**64 - 1}
        signed = [p - 2**64 if p >> 63 else p for p in prints]
        got = sorted(map(tuple, fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect()))
        want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= bits)
        assert got == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert dict(map(tuple, got.collect())) == classes({n for x in links for n in x}, links)
    assert got.count() == len({n for x in links for n in x})


def test_components_of_a_path(spark):
    n = 300
    got = connected_components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.select("component").distinct().collect()[0][0] == 0 and got.count() == n + 1


def test_near_duplicates_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(1000, docs[3][1]), (1001, None), (1002, ""), (1003, " \n"), (1004, "two words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = {i: plain(t) for i, t in docs}
    want = classes(prints, [(a, b) for a in prints for b in prints
                            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(df).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = keep_one_per_group(df.withColumn("fp", F.lit("own")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*want.values()})
    assert kept.columns == ["doc_id", "text", "fp"]


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "z y x w v"), (None, "z y x w v")],
                               "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=repr)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in keep_one_per_group(df).collect()), key=repr) == [(5, "a b c d"), (None, "z y x w v")]
    assert near_duplicates(df.limit(0)).count() == 0
