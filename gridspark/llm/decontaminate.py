"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a few consecutive words; the hash of a window takes
the masked-in words and ignores the others, so a substituted word there does not
hide the match. Hashes of the documents' windows are looked up among those of
the benchmark items; every hit names an item and an alignment, along which all
disjoint stretches that hold enough equal words are reported.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gridspark.llm.common import free_name, ship_code
from gridspark.llm.words import stretches, words_of

#: Fixed masks (1: the word counts). Together they meet every stretch of at least
#: ``MIN_WORDS`` words of which ``SIMILARITY`` are equal (tested over all patterns).
MASKS = ("111111", "11001010011", "101001100101")
MIN_WORDS = 13          # a stretch of an item; shorter items count as a whole
LEAST_WORDS = 5         # default of the least words of an item that is looked for
SIMILARITY = 0.8        # least share of equal words along the stretch
BLOCK_WORDS = 1_000_000  # benchmark words looked up in one pass over the documents
CHUNK_WORDS = 1 << 20

_MULT = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BITS = 22


def seed_hashes(ids: np.ndarray, kept: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the windows all of whose kept words are known (not 0)."""
    n = len(ids) - kept[-1]
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids != 0
    ok = known[kept[0]:kept[0] + n].copy()
    for k in kept[1:]:
        ok &= known[k:k + n]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), dtype=np.uint64)
    for j, k in enumerate(kept):
        h += ids[at + k].astype(np.uint64) * _MULT[j]
    h ^= h >> np.uint64(29)
    return at, h * _MULT[63]


def whole_masks(length: int) -> list[list[int]]:
    """Spaced masks without a common word, one more than the words that may be changed
    in an item of ``length`` words."""
    parts = int((1 - SIMILARITY) * length + 1e-9) + 1
    return [list(range(p, length, parts)) for p in range(parts)]


class SeedIndex:
    """Seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple], least_words: int = LEAST_WORDS):
        self.vocab: dict[str, int] = {}
        self.items = []
        for key, text in items:
            words = words_of(text)
            if len(words) >= max(1, least_words):
                ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.int64)
                self.items.append((key, ids))
        # items shorter than MIN_WORDS are looked up whole, with masks of which any changed
        # words that SIMILARITY allows leave one untouched
        short = sorted({len(ids) for _, ids in self.items if len(ids) < MIN_WORDS})
        self.seeds = []
        for kept in [[k for k, c in enumerate(m) if c == "1"] for m in MASKS]:
            self._add(kept, lambda n: n >= MIN_WORDS)
        for length in short:
            for kept in whole_masks(length):
                self._add(kept, lambda n, length=length: n == length, True)

    def _add(self, kept, wanted, whole: bool = False) -> None:
        found = [(h, i, at) for i, (_, ids) in enumerate(self.items) if wanted(len(ids))
                 for at, h in zip(*seed_hashes(ids, kept)) if at == 0 or not whole]
        if not found:
            return
        found.sort(key=lambda x: x[0])
        hashes = np.array([x[0] for x in found], dtype=np.uint64)
        bits = np.zeros(1 << _BITS, dtype=bool)
        bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.seeds.append((kept, hashes, bits, np.array([x[1:] for x in found], dtype=np.int64)))

    def search(self, texts: list[str | None]) -> Iterator[tuple]:
        """(text number, item number, doc start, doc end, item start, equal words)
        of the verified overlaps, one for each alignment."""
        get, gap = self.vocab.get, max(MIN_WORDS, 16)
        start, chunk, first = [], [], 0
        size = 0
        for n, text in enumerate(texts):
            words = words_of(text)
            ids = np.fromiter(map(get, words, itertools.repeat(0)), np.int64, len(words))
            start.append(size)
            chunk += [ids, np.zeros(gap, np.int64)]
            size += len(ids) + gap
            if size >= CHUNK_WORDS or n + 1 == len(texts):
                yield from self._search(np.concatenate(chunk), np.array(start), first, gap)
                start, chunk, size, first = [], [], 0, n + 1

    def _search(self, ids, start, first, gap) -> Iterator[tuple]:
        seen: set[tuple[int, int]] = set()
        for kept, hashes, bits, places in self.seeds:
            at, h = seed_hashes(ids, kept)
            may = bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
            at, h = at[may], h[may]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for item, q in places[a:b].tolist():
                    seen.add((p - q, item))
        ends = np.append(start[1:], len(ids)) - gap
        for diagonal, item in sorted(seen):
            own = self.items[item][1]
            # the document is the one that holds the alignment's overlap with a seed in it
            for doc in range(max(0, int(np.searchsorted(start, diagonal, "right")) - 1),
                             int(np.searchsorted(start, diagonal + len(own), "left"))):
                lo, hi = max(diagonal, int(start[doc])), min(diagonal + len(own), int(ends[doc]))
                if hi - lo < min(MIN_WORDS, len(own)):
                    continue
                equal = ids[lo:hi] == own[lo - diagonal:hi - diagonal]
                if len(own) < MIN_WORDS:
                    whole = len(equal) == len(own) and equal.sum() >= SIMILARITY * len(own) - 1e-9
                    found = [(0, len(own))] if whole else []
                else:
                    found = stretches(equal, SIMILARITY, MIN_WORDS)
                for i, j in found:
                    yield (first + doc, item, lo + i - int(start[doc]), lo + j - int(start[doc]),
                           lo + i - diagonal, int(equal[i:j].sum()))


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in blocks of at most ``BLOCK_WORDS`` white-space words each,
    or of one hash class (of id and text) that cannot be split further."""
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item", "body"), F.lit(n))
        most = benchmark.groupBy(block.alias("b")).agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] or 0
        if most <= BLOCK_WORDS or n >= 1 << 16:
            return [benchmark.where(block == i) for i in range(n)]
        n *= 2


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per overlap of a document with a benchmark item: the document's id,
    ``item_id``, ``start_word`` and ``end_word`` there, ``item_start``, ``n_words``
    and ``n_equal``; words are runs of ``\\w`` in lower case.

    An overlap is a stretch of at least ``MIN_WORDS`` aligned words that begins and ends
    with an equal one and of which at least ``SIMILARITY`` are equal; of an alignment all
    disjoint ones are given, longest first chosen. Items of fewer words count as a whole,
    with the same share of equal words; items of fewer than ``least_words`` (1 for all) are
    not looked for, as the caller decides.

    Defined cases: null and empty texts on either side overlap nothing; rows with
    null or repeated ids are searched like any other (their rows repeat); repeated
    items are reported each; extra columns are ignored; an empty table on either
    side gives no rows.

    Scale: documents are read once for each block of the benchmark and never
    shuffled; what is sent to the tasks is one block, bounded by ``BLOCK_WORDS``."""
    spark = docs.sparkSession
    ship_code(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("body")).where(
        "body is not null").withColumn("size", F.size(F.split("body", r"\W+")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("item_id", benchmark.schema[item_col].dataType),
        *[T.StructField(c, T.LongType()) for c in ("start_word", "end_word", "item_start", "n_words", "n_equal")]])

    def search(index):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = index.value
            for batch in batches:
                ids = batch["id"].astype(object).where(batch["id"].notna(), None).tolist()
                rows = [(ids[n], found.items[item][0], a, b, at, b - a, equal)
                        for n, item, a, b, at, equal in found.search(batch["text"].tolist())]
                if rows:
                    yield pd.DataFrame(rows, columns=schema.names)
        return run

    out = None
    for block in _blocks(items):
        index = spark.sparkContext.broadcast(
            SeedIndex([(r["item"], r["body"]) for r in block.select("item", "body").collect()], least_words))
        part = texts.mapInPandas(search(index), schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item. Documents
    with a null id are told apart by their text."""
    tag = free_name(docs, "_text_hash")
    tagged = docs.withColumn(tag, F.xxhash64(F.col(text_col)))
    key = F.struct(F.col(id_col), F.col(tag))
    both = tagged.select(key.alias("key"), F.col(text_col).alias("text"))
    bad = find_overlaps(both, benchmark, "key", "text", **options).select(
        F.col("key").getField(id_col).alias("_bad_id"), F.col("key").getField(tag).alias("_bad_tag"))
    return tagged.join(bad, tagged[id_col].eqNullSafe(bad["_bad_id"]) & (tagged[tag] == bad["_bad_tag"]),
                       "left_anti").drop(tag)
