"""Hashes of words and word shingles, computed with numpy over many texts at once."""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20  # bytes hashed together; bounds the memory of one step, not the length of a text
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15
BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Word hashes of UTF-8 texts: A-Z lower-cased, words split at the space and the characters 9 to 13."""

    def __init__(self) -> None:
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        inverse = pow(BASE, -1, 1 << 64)
        self.up = np.cumprod(np.full(n, BASE, dtype=np.uint64))
        self.down = np.cumprod(np.full(n, inverse, dtype=np.uint64))

    def _segment(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        raw = np.frombuffer(data.lower(), dtype=np.uint8)
        if len(raw) > len(self.up):
            self._powers(2 * len(raw))
        word = ~self.space[raw]
        edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
        first, end = edge[0::2], edge[1::2]
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.value[raw] * self.up[: len(raw)], out=total[1:])
        return mix((total[end] - total[first]) * self.down[first]), first

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The word hashes of each text, in order."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                hashes, first = self._segment(b"\n".join(texts[i] for i in held))
                ends = np.cumsum([len(texts[i]) + 1 for i in held])
                cuts = np.searchsorted(first, ends)
                for i, a, b in zip(held, np.concatenate([[0], cuts[:-1]]), cuts):
                    out[i].append(hashes[a:b])
            held, size = [], 0

        for i, t in enumerate(texts):
            if len(t) > SEGMENT:
                for piece in self._pieces(t):
                    out[i].append(self._segment(piece)[0])
                continue
            if size + len(t) > SEGMENT:
                flush()
            held.append(i)
            size += len(t) + 1
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, dtype=np.uint64) for x in out]

    def _pieces(self, text: bytes):
        """A long text cut at white space into pieces of about a segment."""
        at = 0
        while at < len(text):
            end = min(at + SEGMENT, len(text))
            while end < len(text) and text[end] not in b" \t\n\v\f\r":
                end += 1
            yield text[at:end]
            at = end


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes, ascending, of runs of ``width`` words; a shorter text is one run, an empty one has none."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    k = min(n, width)
    total = np.full(n - k + 1, (k * STEP) & MASK, dtype=np.uint64)
    for j in range(k):
        total = total * np.uint64(BASE) + mix(words[j : n - k + 1 + j] + np.uint64(j + 1))
    return np.unique(mix(total))


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
