"""Words, word hashes and shingles of many texts at once, in numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3: a bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CASED = mix(np.arange(1, 257, dtype=U))
_BYTE = _CASED[_LOWER]

#: Bytes of words: all but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words after A-Z are lower-cased: 0-9, a-z and what isn't ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = 1 << n.bit_length()
        for name, base in (("up", _P), ("down", _P_INV)):
            x = np.full(n, U(base))
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


class Words:
    """Words of texts: `hash` (64 bits of each word; ASCII case is ignored unless `cased`), those of text i at first[i] to first[i + 1]; start, end: bytes in `buf`."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray | Callable[[np.ndarray], np.ndarray] = NOT_SPACE, cased: bool = False):
        buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
        edge = np.flatnonzero(np.diff((is_word(buf) if callable(is_word) else is_word[buf]).view(np.int8)))
        start, end = edge[::2] + 1, edge[1::2] + 1
        up, down = _power(len(buf))
        total = np.cumsum((_CASED if cased else _BYTE)[buf] * up[: len(buf)])
        self.hash = mix((total[end - 1] - total[start - 1]) * down[start])
        offset = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(start, offset)
        self.start, self.end, self.offset = start, end, offset
        self.buf, self._total, self._down = buf, total, down

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than n bytes, and the hashes of their first n bytes."""
        who = np.flatnonzero(self.end - self.start > n)
        start = self.start[who]
        return who, mix((self._total[start + n - 1] - self._total[start - 1]) * self._down[start] + U(n))

    def text_of_word(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Runs:
    """Hashes of runs of `x`, whose sums are taken once."""

    def __init__(self, x: np.ndarray):
        up, self._down = _power(len(x) + 1)
        self._total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(x * up[: len(x)])))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs x[start:end], in their order."""
        return mix((self._total[end] - self._total[start]) * self._down[start] + (end - start).astype(U))


def runs_hash(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs x[start:end], in their order."""
    return Runs(x).hash(start, end)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `most` bytes of text each (one text at least), and their texts as UTF-8; a null text is empty."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_binary())
        size = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1])) if len(column) else np.zeros(0)
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at), [x or b"" for x in column.slice(at, stop - at).to_pylist()]
            at = stop


def shingle_sets(words: Words, n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of fewer words, one hash of them all; none without words."""
    w, first = words.hash, words.first
    whole = np.zeros(max(0, len(w) - n + 1), dtype=U)
    for k in range(n):
        whole = whole * U(_P) + w[k : k + len(whole)]
    whole = mix(whole + U(n))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        elif b > a:
            x = 0
            for v in w[a:b].tolist():
                x = (x * _P + v) & 0xFFFFFFFFFFFFFFFF
            yield mix(np.array([(x + b - a) & 0xFFFFFFFFFFFFFFFF], dtype=U))
        else:
            yield w[:0]
