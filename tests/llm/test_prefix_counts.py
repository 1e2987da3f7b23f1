import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import gridspark.llm.prefix_counts as P
from gridspark.llm.prefix_counts import PrefixCounter, longest_prefix, prefix_tokens, with_token_changes
from gridspark.llm.queries import QUERIES, tokenizer_path
from tests.conftest import SF001

PARTS = ["a", "s", "t", " ", "  ", "\n", "\t", "'", "'s", "'re", "ll", "é", "ß", "的", "한", "😀", "٣", "½", " ", " ",
         "　", "0", "12", "-", "-----", "=", "<|endoftext|>", "<|endof", "|>", "word", "the ", "\x1c", "́", "Ⅷ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def brute(library, text):
    return [len(library.encode(text[:i + 1], add_special_tokens=False).ids) for i in range(len(text))]


def counts(made, text):
    return np.cumsum(np.frombuffer(made.changes(text), "<i2")).tolist()


def test_every_prefix_as_the_library_counts_it(library, monkeypatch):
    monkeypatch.setattr(P, "CACHED", 50)   # both generations of the cache are dropped, too
    made, rnd = PrefixCounter(tokenizer_path()), random.Random(5)
    for _ in range(800):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25)))
        assert counts(made, text) == brute(library, text), text


def test_random_bytes_and_long_runs(library):
    made, rnd = PrefixCounter(tokenizer_path()), random.Random(6)
    for _ in range(200):
        text = "".join(chr(rnd.choice([rnd.randint(0, 0x2ff), rnd.randint(0x300, 0xd7ff), rnd.randint(0x10000, 0x10ffff)]))
                       for _ in range(rnd.randint(1, 12)))
        assert counts(made, text) == brute(library, text), text
    for text in ("a" * 3000, " " * 3000 + "x", "=-" * 2000, "Ω" * 1500, "\n" * 1000 + "'s"):
        assert counts(made, text)[-1] == len(library.encode(text, add_special_tokens=False).ids)


def test_awkward_rows(spark, library):
    long = "Long words and lines.\n" * 40_000
    rows = [(1, None, 5), (2, "", 5), (None, "a <|endoftext|> b", 6), (4, "same", 7), (4, "same", 7), (5, long, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_changes long")   # a clashing name is replaced
    out = with_token_changes(df, tokenizer_path())
    assert out.columns == df.columns
    got = out.select("text", prefix_tokens("token_changes", F.length("text")).alias("n")).collect()
    for text, n in got:
        assert n == (None if text is None else len(library.encode(text, add_special_tokens=False).ids))
    assert with_token_changes(df.limit(0), tokenizer_path()).count() == 0


def test_budgets_without_encoding_again(spark, library):
    texts = ["one two   three", "x  'll <|endoftext|>", "-" * 130, "", "déjà vu 的的的"]
    df = spark.createDataFrame([(t, n) for t in texts for n in (-1, 0, 1, 2, 3, 100)], "text string, budget long")
    rows = with_token_changes(df, tokenizer_path()).select(
        "text", "budget", longest_prefix("token_changes", F.col("budget")).alias("chars"),
        prefix_tokens("token_changes", F.col("budget")).alias("tokens")).collect()
    for text, budget, chars, tokens in rows:
        all_ = [0, *brute(library, text)]
        assert chars == (None if budget < 0 else max(i for i, n in enumerate(all_) if n <= budget))
        assert tokens == all_[min(max(budget, 0), len(text))]


def test_other_vocabularies_raise():
    with pytest.raises(ValueError):
        PrefixCounter(tokenizer_path("word_bpe_49k.json"))


def test_query_counts_whole_table(spark, library):
    got = {r.doc_id: r for r in QUERIES["op12_token_counts"](spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), n, n > 1024)
