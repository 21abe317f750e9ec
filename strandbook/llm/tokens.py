"""Token ids of whole texts, with the words that a worker has met kept beside the tokenizer.

The vocabulary file splits its normalised text (NFC, lower case) into runs of letters, single
digits, contractions and runs of other signs, and encodes each run on its own.  So runs are encoded
once and looked up afterwards.  A text with characters outside a plain Latin set, or with the
strings of special tokens, goes to the tokenizer whole; both ways give the same ids.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain, repeat

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

UNUSUAL = regex.compile(r"[^\t\n\r\x20-\x7e\xa0-ͯ‐-‧‰-⁞]|İ|<\|(?:start|end)oftext")


def _class(kind: str) -> str:
    """The characters whose category begins with ``kind``, up to U+FFFF: usual texts have no others."""
    of = [unicodedata.category(chr(c))[0] == kind for c in range(0x10000)]
    edge = np.flatnonzero(np.diff(of, prepend=False, append=False))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edge[::2], edge[1::2], strict=True))


# fixed value: the splitting pattern in the vocabulary file, with its classes written out for re, which is faster
LETTERS, DIGITS = _class("L"), _class("N")
RUNS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
KEPT_RUNS = 250_000  # runs that a worker remembers (some 50 MB); beyond it those met in one batch only are forgotten


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)`` gives one uint32 array of ids for each text."""

    _of: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker process."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.length = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(0, dtype=np.int64)
        self.again = np.zeros(0, dtype=bool)  # met in a later batch than the one that they were learned in

    def forget_rare(self) -> None:
        """Keeps the runs that were met again since the last time; all go if these are too many."""
        kept = np.flatnonzero(self.again)
        if len(kept) > KEPT_RUNS // 2:
            return self.forget()
        names = list(self.number)  # in the order of their numbers
        self.number = {names[i]: k for k, i in enumerate(kept.tolist())}
        n = self.length[kept]
        first = np.cumsum(n) - n
        self.ids = self.ids[np.repeat(self.first[kept] - first, n) + np.arange(n.sum())]
        self.length, self.first, self.again = n, first, np.zeros(len(kept), dtype=bool)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: list[str]) -> None:
        found = []
        lines = [runs[i : i + 500] for i in range(0, len(runs), 500)]
        for line, ids in zip(lines, self._direct([" ".join(x) for x in lines]), strict=True):
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) == len(line) and (not len(ids) or end[-1] == len(ids)):
                found.extend(np.split(ids, end[:-1]))
            else:
                found.extend(self._direct(line))
        self.number.update(zip(runs, range(len(self.length), len(self.length) + len(runs)), strict=True))
        length = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.ids = np.concatenate([self.ids, *found])
        self.length = np.concatenate([self.length, length])
        self.first = np.cumsum(self.length) - self.length
        self.again = np.concatenate([self.again, np.zeros(len(found), dtype=bool)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        some: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            some.append(i)
            size += len(text)
            if size >= 2_000_000 or i == len(texts) - 1:
                for k, ids in zip(some, self._some([texts[k] for k in some]), strict=True):
                    out[k] = ids
                some, size = [], 0
        return out

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        plain = [UNUSUAL.search(t) is None for t in texts]
        whole = iter(self._direct([t for t, p in zip(texts, plain, strict=True) if not p]))
        split = [RUNS.findall(unicodedata.normalize("NFC", t).lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        runs = list(chain.from_iterable(split))
        at = np.fromiter(map(self.number.get, runs, repeat(-1)), dtype=np.int64, count=len(runs))
        self.again[at[at >= 0]] = True
        if len(unknown := np.flatnonzero(at < 0)):
            new = list(dict.fromkeys(runs[i] for i in unknown))
            if len(self.number) + len(new) > KEPT_RUNS:
                self.forget_rare()
                if len(self.number) + len(new) > KEPT_RUNS:
                    self.forget()
                at = np.fromiter(map(self.number.get, runs, repeat(-1)), dtype=np.int64, count=len(runs))
                unknown = np.flatnonzero(at < 0)
                new = list(dict.fromkeys(runs[i] for i in unknown))
            self._learn(new)
            at[unknown] = np.fromiter((self.number[runs[i]] for i in unknown), dtype=np.int64, count=len(unknown))
        n = self.length[at]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        ids = self.ids[np.repeat(self.first[at] - (end - n), n) + np.arange(total)]
        borders = np.concatenate([[0], end])[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] if p else next(whole) for p, a, b in zip(plain, borders[:-1], borders[1:], strict=True)]
