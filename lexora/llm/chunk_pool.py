"""Token ids of texts by way of their space-separated chunks.

The pre-tokenizer's pattern always starts a match at a space that follows a
character other than white space: matches before it can't take the space in.
So a text's ids are those of its chunks " word", and the same chunk has the
same ids in any text.  A worker keeps ids of chunks in one flat pool and
encodes only chunks it hasn't met.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

#: Chunks of a worker's pool, and code points and ids of them; a full pool is emptied before the next batch.
MOST, MOST_HELD = 250_000, 1 << 24
#: Code points after which a batch of texts is closed.
BATCH_CHARS = 1 << 21

#: The ids of all texts, one after the other, and how many each has.
_ODD = re.compile(r"\s \S")

Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def chunks(text: str) -> list[str]:
    """Parts of text, each but the first without the space before it, that can be encoded apart (the last resort: text itself)."""
    parts = text.split(" ")
    return _merged(parts) if _ODD.search(text) or "" in parts else parts


def _merged(parts: list[str]) -> list[str]:
    """A space after white space or at the start begins no chunk."""
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out if out[-1] or len(out) == 1 else [*out[:-1], ""]


class ChunkPool:
    def __init__(self, encode: Encode, most: int = MOST, most_held: int = MOST_HELD):
        self.encode, self.most, self.most_held = encode, most, most_held
        self._empty()

    def _empty(self) -> None:
        self.slot: dict[str, int] = {}
        self.pool = np.empty(1 << 16, np.int32)
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.used = self.held = 0

    def _add(self, new: list[str]) -> None:
        """new: a text's first chunk after a "\\0", any other after its space."""
        ids, size = self.encode([k[1:] if k[0] == "\0" else k for k in new])
        at, n = len(self.slot), len(new)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while at + n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[at : at + n], self.size[at : at + n] = self.used + np.cumsum(size) - size, size
        self.slot.update(zip([k if k[0] == "\0" else k[1:] for k in new], range(at, at + n), strict=True))
        self.used += len(ids)
        self.held += len(ids) + sum(map(len, new))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and for each text the place of its first (and, at last, the end)."""
        if len(self.slot) > self.most or self.held > self.most_held:
            self._empty()
        # keys: "\0" and the text's first chunk; any other chunk as it is (a chunk can't start with "\0" unless the text has it: those take the space)
        keys, counts = [], np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            c = chunks(t)
            c[0] = "\0" + c[0]
            for j in range(1, len(c) if "\0" in t else 0):
                if c[j][:1] == "\0":
                    c[j] = "\0 " + c[j]
            counts[i] = len(c)
            keys += c
        new = [k if k[:1] == "\0" else " " + k for k in dict.fromkeys(keys) if k not in self.slot]
        if new:
            self._add(new)
        slots = np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))
        size = self.size[slots]
        ends = np.cumsum(size)
        out = self.pool[np.repeat(self.start[slots] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum(counts)
        return out, np.concatenate([[0], ends[last - 1]]) if len(texts) else np.zeros(1, np.int64)


def slices(texts: list[str | None], most: int = BATCH_CHARS) -> Iterable[tuple[int, int]]:
    """Ranges of texts of about `most` code points; one text is never cut."""
    begin, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= most:
            yield begin, i + 1
            begin, n = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
