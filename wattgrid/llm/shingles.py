"""Word shingles of whole texts as 64-bit hashes, with numpy, some megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 4
#: Bytes hashed together; a longer text is cut at white space.
PIECE = 1 << 18
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two rounds of xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, as far as a piece is long."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)
        self.bytes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word of lower-cased text."""
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.reach(len(b))
        solid = np.r_[False, ~BLANK[b], False]
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        begin, end = edges[::2], edges[1::2]
        total = np.r_[np.uint64(0), np.cumsum(self.bytes[b] * self.up[:len(b)])]
        return mixed((total[end] - total[begin]) * self.down[begin] + (end - begin).astype(np.uint64)), begin


def pieces_of(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PIECE:
        cut = max(data.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:  # one word longer than a piece
            after = [k for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (k := data.find(c, at + PIECE)) >= 0]
            cut = min(after, default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def shingle_sets(texts: list[str | None], powers: Powers, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs without white space, A-Z lower-cased. A text of fewer than ``width`` words has one shingle, all
    of them; null, empty and blank texts have none.
    """
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
        if len(data) > PIECE:
            yield from _together(waiting, powers, width)
            waiting, size = [], 0
            yield _set(np.concatenate([powers.words(p)[0] for p in pieces_of(data)]), width)
            continue
        waiting.append(data)
        size += len(data) + 1
        if size > PIECE:
            yield from _together(waiting, powers, width)
            waiting, size = [], 0
    yield from _together(waiting, powers, width)


def _set(words: np.ndarray, width: int) -> np.ndarray:
    if len(words) < width:
        if not len(words):
            return words
        return mixed(np.array([int(np.bitwise_xor.reduce(mixed(words + np.arange(1, len(words) + 1, dtype=np.uint64)))) ^ len(words)], np.uint64))
    n = len(words) - width + 1
    by = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    return np.unique(mixed(sum((words[k:k + n] * by[k] for k in range(1, width)), words[:n] * by[0])))


def _together(waiting: list[bytes], powers: Powers, width: int) -> Iterator[np.ndarray]:
    words, begin = powers.words(b" ".join(waiting))
    ends = np.cumsum([len(d) + 1 for d in waiting])
    cuts = np.r_[0, np.searchsorted(begin, ends)] if len(waiting) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield _set(words[a:b], width)
