"""Order-preserving packing of tokenised documents into fixed-length sequences.

Documents are laid end to end in id order. A dynamic program chooses where the
token stream is cut: at document ends (free), sentence ends (a small penalty)
or, where neither comes for long, between tokens (a larger one), so that the
padding plus the penalties are least. The best previous cut within one sequence
length is the head of a monotone queue; a sequence whose length is a power of
two needs no padding, which adds a handful of fixed transitions for each cut (at
a penalty below full length, so that full sequences are preferred).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gridspark.llm.common import ship_code
from gridspark.llm.tokens import tokenizer

SENTENCE_PENALTY = 4.0   # of a cut at a sentence end inside a document, in padding tokens
TOKEN_PENALTY = 12.0     # of a cut between any other two tokens
SHORT_PENALTY = 256.0    # of an unpadded sequence below full length
TOKEN_STEP = 32          # such cuts are offered this far apart where no other comes
CHUNK_TOKENS = 1 << 18   # tokens laid out before a program runs; the last sequence is carried on


def padding(length: int, max_len: int) -> int:
    """Padding of one sequence: none at a power of two, else up to ``max_len``."""
    return 0 if length & (length - 1) == 0 else max_len - length


def choose_cuts(pos: np.ndarray, pen: np.ndarray, max_len: int) -> list[int]:
    """Indexes into ``pos`` of the cuts that minimise padding plus penalties.

    ``pos`` ascends strictly, starts at 0, ends at the end of the stream and has
    no gap over ``max_len``; ``pen`` is the penalty of a cut at each of them."""
    n = len(pos)
    exact: dict[int, list[int]] = {}
    place = np.full(int(pos[-1]) + 1, -1, dtype=np.int64)   # of each position among the candidates
    place[pos] = np.arange(n)
    for k in range(max_len.bit_length()):
        first = int(np.searchsorted(pos, 1 << k))
        at = place[pos[first:] - (1 << k)]
        hit = np.flatnonzero(at >= 0)
        for j, i in zip((hit + first).tolist(), at[hit].tolist()):
            exact.setdefault(j, []).append(i)
    where, extra = pos.tolist(), pen.tolist()
    cost, back = [0.0] * n, [0] * n
    key = [0.0] * n          # cost so far plus position: what a sequence from here on is judged by
    queue: deque[int] = deque()
    for j in range(1, n):
        while queue and key[queue[-1]] >= key[j - 1]:
            queue.pop()
        queue.append(j - 1)
        p = where[j]
        while where[queue[0]] < p - max_len:
            queue.popleft()
        best, arg = key[queue[0]] + max_len - p, queue[0]
        for i in exact.get(j, ()):
            c = cost[i] + (SHORT_PENALTY if p - where[i] < max_len else 0.0)
            if c <= best:
                best, arg = c, i
        cost[j], back[j] = best + extra[j], arg
        key[j] = cost[j] + p
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, max_len: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a token stream and their penalties."""
    kind = np.zeros(len(ids) + 1, dtype=np.uint8)   # 1: between tokens, 2: after a sentence, 3: free
    kind[1:][ends_sentence[ids]] = 2
    kind[doc_ends] = 3
    kind[0] = kind[-1] = 3
    pos = np.flatnonzero(kind)
    step = min(TOKEN_STEP, max_len)
    more = (np.diff(pos) - 1) // step               # cuts to offer in each gap
    within = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    kind[np.repeat(pos[:-1], more) + step * (within + 1)] = 1
    pos = np.flatnonzero(kind)
    return pos, np.array([0.0, TOKEN_PENALTY, SENTENCE_PENALTY, 0.0])[kind[pos]]


class Packer:
    """Lays out documents and yields finished pieces as rows
    (key, start, length, ids, doc_tokens, sequence number, offset)."""

    def __init__(self, ends_sentence: np.ndarray, max_len: int):
        self.ends_sentence, self.max_len = ends_sentence, max_len
        self.parts: list[tuple] = []   # (key, doc_tokens, start, ids)
        self.held, self.sequence = 0, 0

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        self.parts.append((key, len(ids), 0, ids))
        self.held += len(ids)
        return self.flush(False) if self.held >= CHUNK_TOKENS else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.parts:
            return []
        ids = np.concatenate([p[3] for p in self.parts])
        ends = np.cumsum([len(p[3]) for p in self.parts])
        pos, pen = candidates(ids, ends, self.ends_sentence, self.max_len)
        cuts = [int(pos[j]) for j in choose_cuts(pos, pen, self.max_len)]
        if last:
            cuts = self._tail(cuts)
        elif len(cuts) > 1:
            cuts = cuts[:-1]   # the last sequence may still grow
        elif cuts[-1] < self.max_len:
            return []
        rows, upto, seq_start, c = [], 0, 0, 0
        for k, (key, total, start, own) in enumerate(self.parts):
            begin, end = upto, int(ends[k])
            while begin < end and c < len(cuts):
                stop = min(end, cuts[c])
                if stop > begin:
                    a = begin - upto
                    piece = own[a:a + stop - begin]
                    rows.append((key, start + a, len(piece), piece.astype("<u4").tobytes(), total,
                                 self.sequence, begin - seq_start))
                if stop == cuts[c]:
                    seq_start, c = cuts[c], c + 1
                    self.sequence += 1
                begin = stop
            upto = end
        done = cuts[-1]
        rest = []
        for k, (key, total, start, own) in enumerate(self.parts):
            if ends[k] > done:
                skip = max(0, len(own) - int(ends[k] - done))
                rest.append((key, total, start + skip, own[skip:]))
        self.parts, self.held = rest, int(ends[-1]) - done
        return rows

    def _tail(self, cuts: list[int]) -> list[int]:
        """The stream's last sequence as powers of two, where that costs less."""
        start = cuts[-2] if len(cuts) > 1 else 0
        length = cuts[-1] - start
        bits = [1 << k for k in range(length.bit_length()) if length >> k & 1][::-1]
        if padding(length, self.max_len) <= (TOKEN_PENALTY + SHORT_PENALTY) * (len(bits) - 1):
            return cuts
        return cuts[:-1] + [start + int(x) for x in np.cumsum(bits)]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         max_len: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of a document: the id, ``start`` (the document's tokens
    before it), ``length``, ``ids`` (little-endian unsigned 32-bit tokens),
    ``doc_tokens`` (its document's tokens with ``end_id``), ``sequence_id`` and
    ``offset`` (the piece's place there).

    A sequence holds at most ``max_len`` tokens (a power of two); its length is
    padded to that unless it is a power of two itself.

    Defined cases: null or empty text is the single token ``end_id``; rows with
    null or equal ids are documents of their own, in the order of a hash of the
    text; very long documents run over
    many sequences; extra columns are ignored; an empty table gives no rows.

    Scale: one shuffle puts ranges of ids, and of text hashes within an id, in order,
    so many rows of one id or without any spread over the tasks; each task holds one chunk of
    tokens and one document at a time. Sequence ids carry the partition number in
    their upper bits; a repeated task gives the same pieces."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    ship_code(docs.sparkSession)
    source = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
              .withColumn("tag", F.xxhash64("text"))
              .repartitionByRange("id", "tag").sortWithinPartitions("id", "tag", "text")
              .drop("tag").withColumn("part", F.spark_partition_id()))
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(tokenizer_path)
        table = tok.ends_sentence
        if end_id >= len(table):
            table = np.concatenate([table, np.zeros(end_id + 1 - len(table), dtype=bool)])
        packer, base = Packer(table, max_len), 0

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            out["sequence_id"] += base
            return out

        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for key, text, part in zip(batch["id"].astype(object).where(batch["id"].notna(), None),
                                       batch["text"], batch["part"]):
                base = int(part) << 40
                rows = packer.add(key, np.concatenate((tok.encode(text), end)))
                if rows:
                    yield frame(rows)
        rows = packer.flush(True)
        if rows:
            yield frame(rows)

    return source.mapInPandas(run, schema)
