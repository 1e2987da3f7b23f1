"""SimHash near-dedup with pigeonring filtering.

Every document gets a 64-bit fingerprint of its word shingles. The 64 bits form
a ring of ``max_bits + 1`` segments. If two fingerprints differ in at most
``max_bits`` bits, some segment starts a chain in which, for every length, the
differences of the first segments stay within their proportional share of the
budget. The first segment of the chain must then be equal and the first two
differ in one bit at most, which is what the candidate join looks up; longer
prefixes of the chain are tested before the full Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.common import free_name, ship_code, written
from gridspark.llm.components import connected_components

_CHUNK = 65536


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of one text: bit i is 1 if set in over half of the XXH64
    values (seed 42) of its word shingles. Fewer words than ``shingle`` make one
    shingle; no words (or null) give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules only
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        values = np.array([h(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first = np.concatenate(([0], ends[:-1] + 1))[:len(words) - shingle + 1].tolist()
        values = np.array([h(joined[i:j], 42) for i, j in zip(first, ends[shingle - 1:].tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), _CHUNK):
        part = np.unpackbits(values[i:i + _CHUNK].astype("<u8").view(np.uint8), bitorder="little")
        ones += part.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str, name: str, shingle: int = 3) -> DataFrame:
    ship_code(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
    return docs.withColumn(name, simhash(F.col(text_col)))


def _segments(max_bits: int) -> list[tuple[int, int]]:
    m = max_bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(m)]


def _part(bits: Column, segment: tuple[int, int]) -> Column:
    start, width = segment
    moved = F.shiftrightunsigned(bits, start)
    return moved if width == 64 else moved.bitwiseAND(F.lit((1 << width) - 1))


def _chain_start(a: Column, b: Column, max_bits: int) -> Column:
    """The first segment that starts a chain within budget, null if none does."""
    segs = _segments(max_bits)
    m = len(segs)
    diff = [F.bit_count(_part(a.bitwiseXOR(b), s)) for s in segs]
    start = F.lit(None).cast("int")
    for i in reversed(range(m)):
        total, ok = diff[i], diff[i] * m <= max_bits
        for length in range(2, m + 1):
            total = total + diff[(i + length - 1) % m]
            ok = ok & (total * m <= length * max_bits)
        start = F.when(ok, F.lit(i)).otherwise(start)
    return start


def fingerprint_links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): every pair of distinct fingerprints (column ``fp``) that differ in
    ``max_bits`` bits or fewer, once.

    Each fingerprint is looked up under its chain heads: a segment and the next
    one, the latter also with each single bit flipped. A pair that meets under
    several heads is kept under its first chain only."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be between 0 and 7")
    fp = prints.select("fp").where("fp is not null").distinct()
    if max_bits == 0:
        return fp.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    segs = _segments(max_bits)
    heads, flips = [], []
    for i, seg in enumerate(segs):
        nxt = segs[(i + 1) % len(segs)]
        key = F.shiftleft(_part(F.col("fp"), seg), nxt[1]).bitwiseOR(_part(F.col("fp"), nxt)) \
            if seg[1] + nxt[1] <= 64 else F.col("fp")
        heads.append(F.struct(F.lit(i).alias("i"), key.alias("key")))
        flips.append([0] + [1 << k for k in range(nxt[1])])
    index = fp.select(F.col("fp").alias("a"), F.explode(F.array(*heads)).alias("h")).select("a", "h.i", "h.key")
    width = max(map(len, flips))
    masks = F.explode(F.array(*[F.lit(1 << k if k >= 0 else 0).cast("long") for k in range(-1, width - 1)]))
    probe = (index.select(F.col("a").alias("b"), "i", "key", masks.alias("flip"))
             .where(F.col("flip") < F.element_at(F.array(*[F.lit(1 << (len(f) - 1)).cast("long") for f in flips]),
                                                 F.col("i") + 1))
             .select("b", "i", F.col("key").bitwiseXOR(F.col("flip")).alias("key")))
    x, y = index.alias("x"), probe.alias("y")
    cond = ((F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.a") < F.col("y.b"))
            & (_chain_start(F.col("x.a"), F.col("y.b"), max_bits) == F.col("x.i"))
            & (F.bit_count(F.col("x.a").bitwiseXOR(F.col("y.b"))) <= max_bits))
    return x.join(y, cond).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 hex digits),
    ``component_id`` (the smallest id reachable over links between fingerprints
    that differ in at most ``max_bits`` bits, itself included) and ``text_hash``
    (XXH64 of the text, to tell rows of one id apart).

    Defined cases: null and word-free texts have fingerprint zero, which links
    like any other; a null id gets its component like other rows and is never the
    smallest, so a component of null ids alone has a null ``component_id``;
    repeated rows each give a row; an empty table gives an empty result.

    Scale: exact copies meet in one aggregate (partial sums on the map side);
    links are searched between distinct fingerprints only; every lookup key has
    32 bits at the default budget. The table of fingerprints is written once and
    read by the later steps."""
    prints = written(
        with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp", shingle)
        .select("id", "fp", F.xxhash64("text").alias("text_hash")), "simhash")
    groups = prints.groupBy("fp").agg(F.min("id").alias("least"))
    links = fingerprint_links(prints, max_bits)
    parts = connected_components(links)
    labelled = groups.join(parts, groups.fp == parts.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = written(labelled.join(smallest, "label").select("fp", "component_id"), "simhash-classes")
    out = prints.join(classes, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id", "text_hash")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the
    smallest id stays (repeated rows become one; rows of a component without any
    id stay, one for each distinct text)."""
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    keep = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(
        F.col(id_col).alias("_keep_id"), F.col("text_hash").alias("_keep_hash"))
    tag = free_name(docs, "_text_hash")
    tagged = docs.withColumn(tag, F.xxhash64(F.col(text_col)))
    kept = tagged.join(keep, tagged[id_col].eqNullSafe(keep["_keep_id"]) & (tagged[tag] == keep["_keep_hash"]),
                       "left_semi")
    return kept.dropDuplicates([id_col, tag]).drop(tag)
