"""Very long texts through the operators that work text by text."""

import random

from gridspark.llm.decontaminate import SeedIndex
from gridspark.llm.passages import repeated_passages
from gridspark.llm.simhash import fingerprint
from gridspark.llm.toxicity import Model
from tests.llm.test_simhash import plain


def words(n, seed=1):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(100_000)}" for _ in range(n)]


def test_fingerprint_over_several_chunks():
    text = " ".join(words(70_000))
    assert fingerprint(text) == plain(text)


def test_leak_at_the_end():
    item = " ".join(words(30, 2))
    index = SeedIndex([(7, item)])
    found = list(index.search([None, " ".join(words(150_000)) + " " + item, item]))
    assert [(f[0], f[1], f[3] - f[2], f[5]) for f in found] == [(1, 0, 30, 30), (2, 0, 30, 30)]
    assert found[0][2] == 150_000


def test_score_of_a_long_text_sums_all_its_words():
    m = Model({"=needle": 5.0}, -1.0)
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(200_000))
    assert m.scores([long])[0] < 0.5 < m.scores([long + " needle"])[0]


def test_passage_deep_in_long_documents(spark):
    shared = words(60, 3)
    a, b = words(40_000, 4), words(30_000, 5)
    docs = [(1, " ".join(a[:39_000] + shared + a[39_000:])), (2, " ".join(b + shared))]
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.other_id, r.other_start, r.other_end) for r in rows] == [
        (2, 30_000, 30_060, 1, 39_000, 39_060)]
