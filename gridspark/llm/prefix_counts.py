"""Exact token counts of every prefix of a text, by prefix dynamic programming.

For a byte-level BPE whose merges are ranked by token id, the encoding of a byte
string is the one sequence of tokens in which every neighbouring pair stays
apart when encoded alone. So the last token of each prefix follows from the
prefixes before it: of the tokens that end there, the one that stays apart from
the last token of the prefix it continues. One pass over the bytes, with all
tokens that end at a byte read from an Aho-Corasick automaton, gives the count
of tokens of every prefix. Pieces that the vocabulary's splitting pattern makes
are counted each on its own, and frequent ones once for each task.

What is stored is the change of the count from character to character, two
bytes each. ``prefix_tokens`` and ``longest_prefix`` answer budget and
truncation questions from it; no text is encoded again.
"""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.common import ship_code
from gridspark.llm.tokens import BpeTokenizer, _byte_alphabet

#: Pieces kept with their counts in a Python worker, in each of two generations: when
#: the newer is full, it takes the place of the older.
CACHED = 250_000
CACHED_CHARS = 48
_KNOWN = 0x250   # characters below are named in the splitting pattern itself


class _Classes(dict):
    """Stands in for a character above the known ones: one of its class. Classes
    (letter, number, white space, other) are asked of the vocabulary's library."""

    def __init__(self, pieces):
        self._pieces = pieces

    def kind(self, c: str) -> str:
        if len(self._pieces("a" + c)) == 1:
            return "a"
        if len(self._pieces("0" + c)) == 1:
            return "0"
        return "\n" if len(self._pieces(c + " ")) == 1 else "!"

    def __missing__(self, code: int) -> int:
        self[code] = code if code < _KNOWN else ord(self.kind(chr(code)))
        return self[code]


class PrefixCounter:
    """Counts for one vocabulary file of the ``tokenizers`` library: a byte-level
    BPE with merges ranked by id; any other raises."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = sorted((t.content for t in library.get_added_tokens_decoder().values()), key=len, reverse=True)
        alphabet = _byte_alphabet()
        raw = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"].get("vocab", {}).items()
               if t not in special and all(c in alphabet for c in t)}
        if not BpeTokenizer._ranked(spec, raw):
            raise ValueError(f"{path} is no byte-level BPE with merges ranked by token id")
        ids = {b: i for i, b in raw.items()}
        self._left, self._right, self._merge, self._apart_cache = {}, {}, {}, {}
        for merge in spec["model"]["merges"]:
            a, b = (ids[bytes(alphabet[c] for c in t)] for t in (merge.split(" ") if isinstance(merge, str) else merge))
            m = ids[raw[a] + raw[b]]
            self._left[m], self._right[m], self._merge[a, b] = a, b, m
        self._ends = ahocorasick.Automaton()
        made = set()
        for i in sorted(raw):   # only tokens that their own bytes are encoded as
            if i not in self._left or (self._left[i] in made and self._right[i] in made
                                       and self._stay_apart(self._left[i], self._right[i], i)):
                made.add(i)
                self._ends.add_word(raw[i].decode("latin-1"), (i, len(raw[i])))
        self._ends.make_automaton()
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._classes = _Classes(library.pre_tokenizer.pre_tokenize_str)
        kinds: dict[str, list[str]] = {"a": [], "0": [], "\n": [], "!": []}
        for c in map(chr, range(_KNOWN)):
            kinds[self._classes.kind(c)].append(c)
        letter, number, space = (re.escape("".join(kinds[k])) for k in "a0\n")
        break_ = re.escape("".join(c for c in kinds["\n"] if c != " "))
        self._space = re.compile(f"[{space}]*")
        self._known = re.compile(f"[\\x00-{re.escape(chr(_KNOWN - 1))}]*")
        # a run of white space with the piece after it; a contraction is one only if no blank stands before it
        self._contraction = re.compile("'(?:[stmd]|re|ve|ll)")
        self._units = re.compile(f"(?:[{space}]*[{break_}])?{self._contraction.pattern}|"
                                 f"[{space}]*(?:[{letter}]+|[{number}]+|[^{space}{letter}{number}]+)|[{space}]+")
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _stay_apart(self, a: int, b: int, end: float = float("inf")) -> bool:
        """Whether the bytes of ``a`` and then ``b`` are encoded as these two: going
        back in the order of merges, no two parts that ever meet at the border
        are merged while both are there. Of equal merges the left one is first."""
        merge = self._merge
        while True:
            m = merge.get((a, b))
            if m is not None and m < end:
                return False
            if a > b:
                if a not in self._right:
                    return True
                end, a = a, self._right[a]
            else:
                if b not in self._left:
                    return True
                end, b = b + 1, self._left[b]

    def piece(self, text: str) -> list[int]:
        """Token counts of the prefixes (by code points, from the empty one) of one
        piece, none of which is split further."""
        data = text.encode("utf-8")
        last, count = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        apart, done = self._apart_cache, -1
        if len(apart) > 4 * CACHED:
            apart.clear()
        for at, (token, size) in self._ends.iter(data.decode("latin-1")):
            if at == done:   # its last token is found already
                continue
            begin = at + 1 - size
            if begin:
                pair = last[begin], token
                if pair not in apart:
                    apart[pair] = self._stay_apart(*pair)
                if not apart[pair]:
                    continue
            last[at + 1], count[at + 1], done = token, count[begin] + 1, at
        if len(data) == len(text):
            return count
        return [0] + [count[i + 1] for i, b in enumerate(data) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80]

    def _unit(self, text: str, shown: str) -> bytes:
        """Changes of the count over white space and the piece after it. A prefix
        that ends in the white space takes all of it as one piece; otherwise its
        last character goes with the piece if it is a blank, else alone."""
        gap = self._space.match(shown).end()
        blank = gap > 0 and text[gap - 1] == " "
        if gap < len(text) and not blank and self._contraction.fullmatch(shown, gap):
            after = [1, *range(2, len(text) - gap), self.piece(text[gap:])[-1]]   # apostrophe, then letters
        else:
            after = self.piece(text[gap - blank:] if gap < len(text) else "")[1 + blank:]
        if gap <= blank:   # no white space, or one blank (one token, as part of the piece or alone)
            counts = [0, 1, *after] if blank else [0, *after]
        else:
            counts = self.piece(text[:gap])
            before = self.piece(text[:gap - 1])[-1] + (0 if blank else self.piece(text[gap - 1:gap])[-1])
            counts += [before + n for n in after]
        return struct.pack(f"<{len(text)}h", *map(int.__sub__, counts[1:], counts))

    def _plain(self, text: str) -> bytes:
        """Changes over a text without special strings."""
        cache, older = self._cache, self._older
        if self._known.fullmatch(text):
            pairs = ((u, u) for u in self._units.findall(text))
        else:
            shown = text.translate(self._classes)
            pairs = ((text[m.start():m.end()], m.group()) for m in self._units.finditer(shown))
        out = []
        for unit, shown in pairs:
            got = cache.get(unit)
            if got is None:
                got = older.get(unit) or self._unit(unit, shown)
                if len(unit) <= CACHED_CHARS:
                    if len(cache) >= CACHED:
                        cache, older = self._cache, self._older = {}, cache
                    cache[unit] = got
            out.append(got)
        return b"".join(out)

    def changes(self, text: str) -> bytes:
        """For each code point, by how much the count of the prefix that ends with
        it differs from the one before: little-endian 16-bit integers."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out, begin = [], 0
        for m in self._special.finditer(text):
            open_ = self._plain(text[begin:m.end() - 1])   # a special string counts as one when it is whole
            steps = np.frombuffer(open_, "<i2")
            behind = int(steps[m.start() - begin:].sum())
            out += [open_, struct.pack("<h", 1 - behind)]
            begin = m.end()
        return b"".join([*out, self._plain(text[begin:])])


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """The counter of one file, made once for each Python worker."""
    return PrefixCounter(path)


def with_token_changes(df: DataFrame, path: str, text_col: str = "text", out: str = "token_changes") -> DataFrame:
    """``df`` with the binary column ``out`` (in place of one of that name): the token
    counts of all prefixes of the text, as changes from one code point to the next,
    under the vocabulary file ``path``, which must lie there on every executor. Counts
    are those of the ``tokenizers`` library without begin, end or added tokens; special
    strings inside a text count as it counts them.

    Defined cases: a null text is empty; an empty text has no entries; a text of any
    length is read once, in memory in proportion to it; repeated rows and an empty
    table need nothing special; other columns pass unchanged."""
    ship_code(df.sparkSession)

    @F.pandas_udf("binary")
    def changes(texts: pd.Series) -> pd.Series:
        return texts.map(counter(path).changes)
    return df.withColumn(out, changes(F.coalesce(F.col(text_col), F.lit(""))))


def prefix_tokens(changes: Column | str, length: Column | int) -> Column:
    """long: tokens of the first ``length`` code points (all, if there are fewer; none
    for a negative length; null for null changes or length)."""
    @F.pandas_udf("long")
    def tokens(stored: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or pd.isna(n) else
                          int(np.frombuffer(s, "<i2", min(max(int(n), 0), len(s) // 2)).sum(dtype=np.int64))
                          for s, n in zip(stored, lengths)], dtype="Int64")
    return tokens(changes, F.lit(length).cast("long") if isinstance(length, int) else length.cast("long"))


def longest_prefix(changes: Column | str, budget: Column | int) -> Column:
    """long: code points of the longest prefix of at most ``budget`` tokens. The count
    can fall as a prefix grows, so longer prefixes are looked at, too. A negative budget
    admits none (null); null changes or budget give null."""
    @F.pandas_udf("long")
    def longest(stored: pd.Series, budgets: pd.Series) -> pd.Series:
        out = []
        for s, n in zip(stored, budgets):
            if s is None or pd.isna(n) or n < 0:
                out.append(None)
                continue
            fits = np.flatnonzero(np.cumsum(np.frombuffer(s, "<i2"), dtype=np.int64) <= n)
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pd.Series(out, dtype="Int64")
    return longest(changes, F.lit(budget).cast("long") if isinstance(budget, int) else budget.cast("long"))
