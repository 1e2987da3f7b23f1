"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are only ordered through their first ``length`` bytes, most significant
digits first, and a group that is down to one suffix is dropped at once. The
groups left at full depth are the repeated windows.

* First digit: of the windows of ``length`` bytes that start in a stretch of text,
  consecutive ones share the same smallest ``gram``-byte piece (their anchor), so
  one record per anchor stands for a run of suffixes. Equal windows have equal
  anchors at equal places; a run whose piece occurs nowhere else is unique.
* Second digit: the run's whole stretch. Runs that agree in it are equal window
  by window: all but the earliest are removed.
* Last digit: runs that share the piece but not the stretch, the earliest of each
  stretch, are resolved window by window through the full ``length`` bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridspark.llm.common import by_size, ship_code, written

GRAM_SHARE = 0.56        # of the length: bytes of an anchor's piece
MOST_CONTEXTS = 8        # stretches of one piece that one batch passes on to the sort
_SEGMENT = 1 << 18       # window starts handled at once
_BITS = 20               # of a position among them
_PART = 1 << 22          # characters of text whose records are held at once
_UNIQUE, _REMOVED, _OPEN = 0, 1, 2   # kinds of records: to be sorted, known, to be resolved by window
_SEVERAL = 3                         # to be sorted, piece known to have several stretches
_LEAST_ID = -(1 << 63)   # stands for a null id
_PLACE = ("doc", "tag", "at")        # of a record: id, hash of the text, position

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = 1 << _BITS
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    power, back = np.full(n, _BASE), np.full(n, inverse)
    power[0] = back[0] = 1
    table = np.random.default_rng(8).integers(1, 2**64 - 1, 256, dtype=np.uint64)
    return np.multiply.accumulate(power), np.multiply.accumulate(back), table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C1
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hash of any stretch of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        power, self.back, table = _powers()
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * power[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.back[:n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have:width - have + n])


def pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes): ``text`` in stretches that hold every window once."""
    for at in range(0, max(1, len(text) - length + 1), _SEGMENT):
        yield at, text[at:at + _SEGMENT + length - 1]


def runs(chunk: list[bytes], length: int, gram: int):
    """(piece number, anchor, first start, last start, piece hash, stretch hash)
    of the runs of windows in each of the pieces; places within the piece."""
    sizes = np.array([len(b) for b in chunk])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(chunk), dtype=np.uint8)
    h = Hashes(data)
    grams = h.windows(gram)
    low = np.uint64((1 << _BITS) - 1)
    least = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    ok = np.ones(len(least), dtype=bool)
    for e in ends.tolist():
        ok[max(0, e - length + 1):e] = False
    at = np.flatnonzero(ok)
    anchor = (least[at] & low).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    anchor, lo, hi = anchor[first], at[first], at[last]
    piece = np.searchsorted(begins, lo, "right") - 1
    shape = ((anchor - lo) * 4096 + (anchor - hi)).astype(np.uint64)
    stretch = _mix(h.of(lo, hi + length) + shape * _C2)
    return piece, anchor - begins[piece], lo - begins[piece], hi - begins[piece], grams[anchor], stretch


def _pack(pos, near, far):
    return (pos << 14) | (near << 7) | far


def _by_place(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A sort key for records that only pass through: spread by their place."""
    return _mix((doc ^ (at << 17) ^ tag).view(np.uint64)).view(np.int64)


def _keep_first(key: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, kind) of records sorted by (key, doc, tag, at): 0 for the first of a key,
    1 for a later place, 2 for a repetition of the very place before it."""
    order = np.lexsort((at, tag, doc, key))
    k, d, t, a = key[order], doc[order], tag[order], at[order]
    same = np.zeros(len(k), dtype=bool)
    same[1:] = k[1:] == k[:-1]
    again = same.copy()
    again[1:] &= (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (a[1:] == a[:-1])
    return order, np.where(again, 2, same.astype(np.int8))


def _anchor_rows(ids, texts, tags, length: int, gram: int) -> pd.DataFrame:
    """Records of one batch, after what can be settled within it."""
    found, chunk, owner, size = [], [], [], 0

    def flush():
        nonlocal chunk, owner, size
        if chunk:
            piece, anchor, lo, hi, kh, ch = runs(chunk, length, gram)
            doc, tag, base = (x[piece] for x in np.array(owner, dtype=np.int64).T)
            found.append((kh.view(np.int64), ch.view(np.int64), doc, tag, _pack(anchor + base, anchor - hi, anchor - lo)))
        chunk, owner, size = [], [], 0

    for key, text, tag in zip(ids, texts, tags):
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) < length:
            continue
        for at, b in pieces(raw, length):
            chunk.append(b)
            owner.append((key, tag, at))
            size += len(b)
            if size >= _SEGMENT:
                flush()
    flush()
    if not found:
        return pd.DataFrame({"kh": [], "ch": [], "doc": [], "tag": [], "at": [], "kind": []}).astype("int64")
    kh, ch, doc, tag, at = (np.concatenate(c) for c in zip(*found))
    kind = np.zeros(len(kh), dtype=np.int64)
    # stretches that repeat within the batch: all but the first are settled
    order, state = _keep_first(ch, doc, tag, at)
    kind[order[state == 1]] = _REMOVED
    drop = np.zeros(len(kh), dtype=bool)
    drop[order[state == 2]] = True
    # pieces with many stretches in the batch: one record goes on for all
    first = np.flatnonzero((kind == 0) & ~drop)
    by = first[np.argsort(kh[first], kind="stable")]
    new = np.ones(len(by), dtype=bool)
    new[1:] = kh[by][1:] != kh[by][:-1]
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > MOST_CONTEXTS if len(by) else new
    kind[by[many & new]] = _SEVERAL
    kind[by[many & ~new]] = _OPEN
    # settled records only pass through; they travel by their place, not their piece
    through = (kind == _REMOVED) | (kind == _OPEN)
    kh = np.where(through, _by_place(doc, tag, at), kh)
    out = pd.DataFrame({"kh": kh, "ch": np.where(through, 0, ch), "doc": doc, "tag": tag, "at": at, "kind": kind})
    return out[~drop]


class _Sorted:
    """Settles records that come sorted by (kh, ch, doc, tag, at), batch by batch; keeps
    one record between batches."""

    def __init__(self):
        self.last: dict | None = None   # of the piece in progress

    def add(self, b: pd.DataFrame) -> list[tuple]:
        kind = b["kind"].to_numpy()
        through = (kind == _REMOVED) | (kind == _OPEN)
        out = [(*(b[c].to_numpy()[through] for c in _PLACE), kind[through])]
        b = b[~through]
        if not len(b):
            return out
        kh, ch, doc, tag, at = (b[c].to_numpy() for c in ("kh", "ch", *_PLACE))
        several = b["kind"].to_numpy() == _SEVERAL
        if self.last is not None:
            t = self.last
            kh, ch, doc, tag, at = (np.concatenate((np.array([t[n]], dtype=np.int64), v)) for n, v in (
                ("kh", kh), ("ch", ch), ("doc", doc), ("tag", tag), ("at", at)))
            several = np.concatenate(([t["several"]], several))
        new = np.ones(len(kh), dtype=bool)
        new[1:] = kh[1:] != kh[:-1]
        fresh = new.copy()
        fresh[1:] |= ch[1:] != ch[:-1]
        again = np.zeros(len(kh), dtype=bool)
        again[1:] = ~fresh[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (at[1:] == at[:-1])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        multi = (np.add.reduceat(fresh, starts) > 1) | np.maximum.reduceat(several, starts)
        later = ~fresh & ~again
        out.append((doc[later], tag[later], at[later], np.full(later.sum(), _REMOVED)))
        # first records of stretches of pieces with several stretches
        opened = fresh & multi[group]
        if self.last is not None and self.last["several"]:
            opened[0] = False
        out.append((doc[opened], tag[opened], at[opened], np.full(opened.sum(), _OPEN)))
        # a piece with one stretch so far waits with its first record; of others the
        # last stretch is kept, its first record already given out
        f = int(np.flatnonzero(fresh)[-1])
        self.last = {"kh": kh[f], "ch": ch[f], "doc": doc[f], "tag": tag[f], "at": at[f], "several": bool(multi[-1])}
        return out


def _places(parts: list[tuple]) -> pd.DataFrame:
    doc, tag, at, kind = (np.concatenate(c) for c in zip(*parts))
    return pd.DataFrame({"doc": doc, "tag": tag, "at": at, "kind": kind.astype(np.int64)})


def _later_windows(b: pd.DataFrame, last: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Places, sorted by (wh, doc, tag, at), that are not the first of their window."""
    wh, doc, tag, at = (b[c].to_numpy() for c in ("wh", *_PLACE))
    if last is not None:
        wh, doc, tag, at = (np.concatenate((np.array([x], dtype=np.int64), v)) for x, v in zip(last, (wh, doc, tag, at)))
    same = np.zeros(len(wh), dtype=bool)
    same[1:] = wh[1:] == wh[:-1]
    firsts = np.maximum.accumulate(np.where(same, 0, np.arange(len(wh))))
    later = same & ((doc != doc[firsts]) | (tag != tag[firsts]) | (at != at[firsts]))
    f = firsts[-1]
    return pd.DataFrame({"doc": doc[later], "tag": tag[later], "at": at[later]}), (wh[f], doc[f], tag[f], at[f])


def _tag(text: Column) -> Column:
    """Tells rows of one id apart; their order is by it."""
    return F.xxhash64(text)


def repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``kept`` (the remaining UTF-8 bytes,
    joined), ``spans`` (the maximal removed byte ranges) and ``n_bytes``.

    Removed is each byte covered by a string of ``length`` bytes that also starts
    earlier: in a smaller id, or in the same document before. Strings are judged on
    the input.

    Defined cases: null text is empty; texts under ``length`` bytes stay whole; a
    null id counts as the smallest; rows with one id but different texts are
    documents of their own, in the order of a 64-bit hash of the text; repeated rows are
    one document and get the same result; extra columns are ignored; an empty
    table gives no rows. Equality is judged by hashes: 64 bits of a piece and 64 of
    the stretch, or 64 bits of a window. Ids must be whole numbers.

    Scale: about one record per ``length / 5`` bytes is shuffled, and one per
    window only where a repeated passage begins or ends. Equal stretches, pieces
    with many stretches and equal windows are settled within each part of a batch first,
    so a passage that a third of all documents share sends one record per part to
    the task that sorts it; that task holds one record between batches."""
    if not 20 <= length <= 250:
        raise ValueError("length must be between 20 and 250 bytes")
    ship_code(docs.sparkSession)
    gram = max(8, int(length * GRAM_SHARE))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID)).alias("doc"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tagged = source.withColumn("tag", _tag(F.col("text")))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in by_size(batches, "text", _PART):
            yield _anchor_rows(b["doc"].tolist(), b["text"], b["tag"].tolist(), length, gram)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = _Sorted()
        for b in batches:
            yield _places(state.add(b))

    records = tagged.mapInPandas(find, "kh long, ch long, doc long, tag long, at long, kind long")
    places = written(records.repartition("kh").sortWithinPartitions("kh", "ch", "doc", "tag", "at")
                     .mapInPandas(settle, "doc long, tag long, at long, kind long"), "suffix-places")

    def hard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in by_size(batches, "text", _PART):
            out = []
            for key, text, tag, ats in zip(b["doc"].tolist(), b["text"], b["tag"].tolist(), b["ats"]):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                a = np.asarray(ats, dtype=np.int64)
                pos, near, far = a >> 14, a >> 7 & 127, a & 127
                n = far - near + 1
                start = np.repeat(pos - far, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.unique(start)
                for at in range(0, len(raw), _SEGMENT):
                    own = start[(start >= at) & (start < at + _SEGMENT)]
                    if len(own):
                        h = Hashes(raw[at:at + _SEGMENT + length])
                        wh = h.of(own - at, own - at + length).view(np.int64)
                        out.append((wh, np.full(len(own), key), np.full(len(own), tag), own))
            if not out:
                continue
            wh, doc, tag, at = (np.concatenate(c) for c in zip(*out))
            order, state = _keep_first(wh, doc, tag, at)
            keep = state != 2
            wh, doc, tag, at = (x[order][keep] for x in (wh, doc, tag, at))
            later = state[keep] == 1
            # known as repeated already: travels by its place
            wh = np.where(later, _by_place(doc, tag, at), wh)
            yield pd.DataFrame({"wh": wh, "doc": doc, "tag": tag, "at": at, "known": later})

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            known = b["known"].to_numpy(dtype=bool)
            yield b.loc[known, list(_PLACE)]
            if not known.all():
                out, last = _later_windows(b[~known], last)
                yield out

    open_runs = (places.where(F.col("kind") == _OPEN).select(*_PLACE).distinct()
                 .groupBy("doc", "tag").agg(F.collect_list("at").alias("ats")))
    windows = tagged.join(open_runs, ["doc", "tag"]).mapInPandas(hard, "wh long, doc long, tag long, at long, known boolean")
    single = written(windows.repartition("wh").sortWithinPartitions("wh", "doc", "tag", "at")
                     .mapInPandas(resolve, "doc long, tag long, at long"), "suffix-windows")
    # every removed stretch as (start, windows in a row)
    removed = (places.where(F.col("kind") == _REMOVED).select(
        "doc", "tag", F.struct(
            (F.shiftright("at", 14) - F.col("at").bitwiseAND(F.lit(127))).alias("start"),
            (F.col("at").bitwiseAND(F.lit(127)) - F.shiftright("at", 7).bitwiseAND(F.lit(127)) + 1).alias("n")).alias("s"))
        .unionByName(single.select("doc", "tag", F.struct(
            F.col("at").alias("start"), F.lit(1).cast("long").alias("n")).alias("s")))
        .groupBy("doc", "tag").agg(F.collect_list("s").alias("s"))
        .select("doc", "tag", F.col("s.start").alias("starts"), F.col("s.n").alias("counts")))
    null_id = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        "id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("id").cast("long"), F.lit(_LEAST_ID)).alias("doc"))
    null_id = null_id.withColumn("tag", _tag(F.col("text"))).withColumn("no_id", F.col("id").isNull()).drop("id")
    pair = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("no_id", T.BooleanType()),
                           T.StructField("kept", T.BinaryType()), T.StructField("spans", pair),
                           T.StructField("n_bytes", T.LongType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in by_size(batches, "text", _PART):
            rows = []
            for key, no_id, text, starts, counts in zip(b["doc"], b["no_id"], b["text"], b["starts"], b["counts"]):
                raw = text.encode("utf-8", "surrogatepass")
                if starts is None or not len(starts):
                    rows.append((key, no_id, raw, [], len(raw)))
                    continue
                s = np.asarray(starts, dtype=np.int64)
                edge = np.bincount(s, minlength=len(raw) + 1) - np.bincount(
                    s + np.asarray(counts, dtype=np.int64) - 1 + length, minlength=len(raw) + 1)
                gone = np.cumsum(edge)[:len(raw)] > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                rows.append((key, no_id, np.frombuffer(raw, np.uint8)[~gone].tobytes(),
                             [{"start": i, "end": j} for i, j in zip(turn[::2].tolist(), turn[1::2].tolist())], len(raw)))
            yield pd.DataFrame(rows, columns=schema.names)

    out = null_id.join(removed, ["doc", "tag"], "left").drop("tag").mapInPandas(cut, schema)
    return out.select(F.when(~F.col("no_id"), F.col("doc")).cast(docs.schema[id_col].dataType).alias(id_col),
                      "kept", "spans", "n_bytes")
