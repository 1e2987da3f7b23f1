import itertools
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from gridspark.llm.decontaminate import LEAST_WORDS, MASKS, MIN_WORDS, SIMILARITY, drop_contaminated, find_overlaps
from gridspark.llm.words import longest_stretch, words_of


def test_masks_meet_every_stretch_with_two_substitutions():
    kept = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
    for bad in itertools.combinations(range(MIN_WORDS), 2):
        assert any(not {o + k for k in ks} & set(bad) for ks in kept for o in range(MIN_WORDS - ks[-1]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.sampled_from([0.5, 0.8]))
def test_longest_stretch(equal, share):
    e = np.array(equal, dtype=bool)
    best = max([j - i for i in range(len(e)) for j in range(i + 1, len(e) + 1)
                if e[i:j].sum() >= share * (j - i) - 1e-9], default=0)
    i, j = longest_stretch(e, share)
    if best == 0:
        assert i == j == 0
    else:
        assert j - i <= best and e[i] and e[j - 1]
        wide = [(a, a + best) for a in range(len(e) - best + 1) if e[a:a + best].sum() >= share * best - 1e-9]
        assert any(a <= i and j <= b and not e[a:i].any() and not e[j:b].any() for a, b in wide)


def by_trying_all(e, least):
    """Disjoint stretches of at least ``least``, by trying every begin and end."""
    best = max(((j - i, -i) for i in range(len(e)) if e[i] for j in range(i + least, len(e) + 1)
                if e[j - 1] and 10 * int(e[i:j].sum()) >= 8 * (j - i)), default=None)
    if best is None:
        return []
    i = -best[1]
    j = i + best[0]
    return by_trying_all(e[:i], least) + [(i, j)] + [(j + a, j + b) for a, b in by_trying_all(e[j:], least)]


def brute(docs, items):
    found = set()
    for d, text in docs:
        w = words_of(text)
        for key, body in items:
            own = words_of(body)
            if len(own) < LEAST_WORDS:
                continue
            for shift in range(-len(own) + 1, len(w)):
                lo, hi = max(0, shift), min(len(w), shift + len(own))
                e = np.array([w[p] == own[p - shift] for p in range(lo, hi)], dtype=bool)
                if len(own) < MIN_WORDS:
                    if hi - lo == len(own) and 10 * int(e.sum()) >= 8 * len(own):
                        found.add((d, key, lo, hi, 0, len(own), int(e.sum())))
                    continue
                for i, j in by_trying_all(e, MIN_WORDS) if e.sum() >= 10 else []:
                    found.add((d, key, lo + i, lo + j, lo + i - shift, j - i, int(e[i:j].sum())))
    return found


def text(rnd, n, vocab=400):
    return " ".join(f"w{rnd.randrange(vocab)}" for _ in range(n))


def test_matches_brute_force(spark):
    rnd = random.Random(4)
    items = [(i, text(rnd, rnd.choice([3, 5, 8, 13, 20, 40]))) for i in range(30)] + [(100, None), (101, ""), (102, "the")]
    items.append((103, items[5][1]))
    docs = []
    for i in range(200):
        t = text(rnd, rnd.randint(0, 60)).split(" ")
        for _ in range(rnd.randint(0, 2)):
            w = (rnd.choice(items)[1] or "").split(" ")
            a = rnd.randint(0, len(w) // 3)
            w = [x if rnd.random() > 0.12 else "zzz" for x in w[a:]]
            at = rnd.randint(0, len(t))
            t[at:at] = w
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(t).title()))
    docs += [(200, None), (201, "")]
    got = find_overlaps(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                        spark.createDataFrame(items, "item_id long, text string"))
    rows = [tuple(r) for r in got.collect()]
    want = brute(docs, items)
    assert set(rows) == want and len(rows) == len(set(rows))
    assert len(want) > 30 and any(r[5] < MIN_WORDS and r[6] < r[5] for r in want)


def test_all_stretches_of_an_alignment(spark):
    own = [f"w{i}" for i in range(60)]
    # 13 words with 11 equal, and further on 12 equal words among changed ones
    doc = [w if i in (0, 1, 2, 4, 5, 6, 7, 9, 10, 11, 12) or 30 <= i < 42 else "other" for i, w in enumerate(own)]
    two = own[:20] + ["other"] * 20 + own[40:]
    docs = [(1, " ".join(doc)), (2, " ".join(reversed(doc))), (3, " ".join(two))]
    items = [(1, " ".join(own)), (2, " ".join(reversed(own)))]
    got = find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                        spark.createDataFrame(items, "item_id long, text string")).collect()
    rows = {tuple(r) for r in got}
    assert rows == brute(docs, items)
    assert {(1, 1, 0, 13, 0, 13, 11), (3, 1, 0, 20, 0, 20, 20), (3, 1, 40, 60, 40, 20, 20)} <= rows


def test_short_items_down_to_one_word(spark):
    items = [(n, " ".join(f"{c}{n}" for c in "abcdefghijkl"[:n])) for n in range(1, 13)]
    docs = []
    for n, t in items:
        w = t.split()
        allowed = n // 5
        docs += [(100 * n, "x " + t + " y")]
        for bad in itertools.combinations(range(n), allowed):
            docs.append((100 * n + len(docs) % 100, " ".join("z" if i in bad else v for i, v in enumerate(w)) + " end"))
        docs.append((5000 + n, " ".join("z" if i <= allowed else v for i, v in enumerate(w))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = find_overlaps(df, bench, least_words=1).collect()
    assert {r.doc_id for r in got} == {d for d, _ in docs if d < 5000}
    assert {r.item_id for r in find_overlaps(df, bench).collect()} == set(range(LEAST_WORDS, 13))


def test_many_items_of_one_id_split_into_blocks(spark, monkeypatch):
    import gridspark.llm.decontaminate as D
    monkeypatch.setattr(D, "BLOCK_WORDS", 300)
    bench = spark.createDataFrame([(7, " ".join(f"v{i}x{k}" for k in range(14))) for i in range(100)], "item_id long, text string")
    items = bench.select(bench.item_id.alias("item"), bench.text.alias("body")).selectExpr("*", "14 as size")
    assert len(D._blocks(items)) > 4


def test_whole_table_finds_every_leak(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs += [(10_000 + k, "before it " + t + " after it") for k, t in items]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_overlaps(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(a, k) for a, t in docs for k, body in items
            if " " + " ".join(words_of(body)) + " " in " " + " ".join(words_of(t)) + " "}
    assert want <= got
    kept = drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {a for a, _ in docs} - {a for a, _ in got}


def test_blocks_nulls_repeats_clashing_columns_and_empty(spark, monkeypatch):
    import gridspark.llm.decontaminate as D
    monkeypatch.setattr(D, "BLOCK_WORDS", 30)
    rnd = random.Random(2)
    items = [(i, text(rnd, 15)) for i in range(12)]
    leak = items[7][1]
    df = spark.createDataFrame([(None, leak, 1), (3, leak, 1), (3, leak, 1), (4, "clean words only", 1), (None, None, 2)],
                               "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, size string")
    rows = sorted(((r.doc_id, r.item_id, r.n_equal) for r in find_overlaps(df, bench).collect()), key=repr)
    assert rows == [(3, 7, 15), (3, 7, 15), (None, 7, 15)]
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=repr) == [(4, "clean words only", 1), (None, None, 2)]
    assert find_overlaps(df.limit(0), bench).count() == 0 and find_overlaps(df, bench.limit(0)).count() == 0


def test_masks_meet_every_stretch_at_the_threshold():
    # least substitutions of any pattern that no mask meets, by its last words
    masks, full = [(int(m, 2), len(m)) for m in MASKS], (1 << max(map(len, MASKS))) - 1
    least, n = {1: 0}, 1
    while n < 200:
        after, n = {}, n + 1
        for bits, bad in least.items():
            for equal in (0, 1):
                b = (bits << 1 | equal) & full
                if not any(n >= size and b & m == m for m, size in masks):
                    after[b] = min(after.get(b, n), bad + 1 - equal)
        least = after
        assert n < MIN_WORDS or min((bad for b, bad in least.items() if b & 1), default=n) > (1 - SIMILARITY) * n + 1e-9
    assert min(least.values()) > 0.25 * n   # longer ones only fall further below


def test_every_pattern_of_a_leak_equals_brute_force(spark):
    own = [f"w{i}" for i in range(60)]
    docs = []
    for length, most in ((15, 3), (16, 3)):
        for bad in itertools.combinations(range(1, length - 1), most):
            docs.append(["other" if i in bad else own[i] for i in range(length)])
    rnd = random.Random(9)
    for length in (20, 25, 40, 60):
        for _ in range(150):
            bad = set(rnd.sample(range(1, length - 1), length // 5))
            docs.append(["other" if i in bad else own[i] for i in range(length)])
    docs = [(i, " ".join(["before", *t, "after"])) for i, t in enumerate(docs)]
    items = [(n, " ".join(own[:n])) for n in (15, 16, 20, 25, 40, 60)]
    got = find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                        spark.createDataFrame(items, "item_id long, text string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, items)
    assert {r[0] for r in rows} == {i for i, _ in docs}
