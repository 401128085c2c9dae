"""Words, shingles and rolling hashes of whole texts, computed with numpy inside tasks.

Words are runs of bytes other than space and 0x09-0x0D. These bytes never occur inside
a longer UTF-8 sequence, so working on bytes gives the same words as on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of a byte buffer, from prefix sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n + 1:
            n = max(n, CHUNK_BYTES)
            one = np.ones(1, np.uint64)
            inverse = pow(BASE, -1, 1 << 64)
            self.up = np.concatenate([one, np.cumprod(np.full(n, BASE, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(n, inverse, np.uint64))])

    def sums(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf))
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[: len(buf)], out=out[1:])
        return out

    def stretches(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((sums[end] - sums[start]) * self.down[start] + length * np.uint64(0xA24BAED4963EE407))

    def windows(self, sums: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` bytes, by first byte."""
        count = max(0, len(sums) - size)
        return mix((sums[size:] - sums[:count]) * self.down[:count])

    def windows_at(self, sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Those that begin at the given places."""
        return mix((sums[starts + size] - sums[starts]) * self.down[starts])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEPS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``limit`` bytes with the index of the first; null: empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


class Words:
    """The words of some texts: byte offsets in one buffer, hash, and bounds per text."""

    def __init__(self, rolling: Rolling, texts: list[bytes], lower: bool):
        joined = np.frombuffer(b" ".join(texts), np.uint8)
        self.buf = _LOWER[joined] if lower else joined
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = ~_SPACE[self.buf]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        self.bounds = np.searchsorted(self.start, self.at)
        self.hash = rolling.stretches(rolling.sums(self.buf), self.start, self.end)

    def grams(self, n: int) -> np.ndarray:
        """Hashes of n consecutive words by first word, also across texts (see ``spans``)."""
        return self.grams_of(0, len(self.hash) - n + 1, n)

    def grams_of(self, first: int, last: int, n: int) -> np.ndarray:
        """Those whose first word is among ``first`` to ``last`` (exclusive)."""
        count = last - first
        if count <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(count, np.uint64)
        for j in range(n):
            total += self.hash[first + j : first + j + count] * _STEPS[j]
        return mix(total + np.uint64(n))

    def spans(self, i: int, n: int) -> tuple[int, int]:
        """Range of the n-grams that lie wholly in text i."""
        first, last = int(self.bounds[i]), int(self.bounds[i + 1])
        return first, max(first, last - n + 1)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive) joined by single spaces."""
        return b" ".join(self.buf[self.start[k] : self.end[k]].tobytes() for k in range(i, j))


_PLACE = (1 << 31) - 1  # a string is shorter than this


def _slide_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` consecutive values."""
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def least_places(hashes: np.ndarray, starts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the least of ``reach`` consecutive hashes stands, for windows at ``starts`` (sorted).

    Gives each such place once, with the first and last start of the windows it is least
    of. Hashes are compared by their upper bits, equal ones by place, so equal stretches
    have their least at the same distance whatever is around them.
    """
    if not len(starts):
        return starts, starts, starts
    keyed = (hashes & ~np.uint64(_PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    place = (_slide_min(keyed, reach)[starts] & np.uint64(_PLACE)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]


def shingle_set(words: Words, grams: np.ndarray, i: int, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles of text i, given ``words.grams(n)``.

    A text of fewer than n words is one shingle, a text without words has none.
    """
    first, last = words.spans(i, n)
    if last > first:
        return np.unique(grams[first:last])
    held = words.hash[words.bounds[i] : words.bounds[i + 1]]
    if not len(held):
        return np.zeros(0, np.uint64)
    return mix(np.array([(held * _STEPS[: len(held)]).sum() + np.uint64(len(held))], np.uint64))
