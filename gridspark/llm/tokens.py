"""Token ids of whole texts by a byte-level BPE vocabulary file."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Characters on whose class (letter, digit, space, other) every Unicode version
#: agrees; texts made of others go to the ``tokenizers`` library itself.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ–—‘-”…]*")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeTokenizer:
    """``encode`` gives the ids that the ``tokenizers`` library gives for a text
    with ``add_special_tokens=False``.

    Where the file is a plain byte-level BPE whose merges are ranked by token id,
    texts of unambiguous characters run through ``tiktoken`` on ranks read from
    the same file, several times faster and with the same ids (tested)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(path)
        self._special = tuple(t.content for t in self._slow.get_added_tokens_decoder().values())
        self._fast = None
        alphabet = _byte_alphabet()
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"].get("vocab", {})
        self.size = 1 + max(max(vocab.values(), default=0), *(int(t["id"]) for t in spec["added_tokens"]), 0)
        raw = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()
               if t not in self._special and all(c in alphabet for c in t)}
        if self._ranked(spec, raw):
            import tiktoken
            self._fast = tiktoken.Encoding(
                "vocabulary", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
                mergeable_ranks={b: i for i, b in raw.items()}, special_tokens={})
        #: For each id, whether its text ends a sentence or a line.
        self.ends_sentence = np.zeros(self.size, dtype=bool)
        for i, b in raw.items():
            self.ends_sentence[i] = b.endswith((b".", b"!", b"?")) or b"\n" in b

    @staticmethod
    def _ranked(spec: dict, raw: dict[int, bytes]) -> bool:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or model.get("type") != "BPE" or model.get("ignore_merges")):
            return False
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        return len({*raw.values()}) == len(raw) and {len(raw.get(i, b"")) for i in range(256)} == {1} and all(
            vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)) and len(raw) == 256 + len(pairs)

    def encode(self, text: str) -> np.ndarray:
        if self._fast is not None and _PLAIN.fullmatch(text) and not any(s in text for s in self._special):
            return np.array(self._fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> BpeTokenizer:
    """The tokenizer of one file, made once for each Python worker."""
    return BpeTokenizer(path)
