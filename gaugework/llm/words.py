"""Word and shingle hashes of whole texts, vectorised over blocks of many texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

BLOCK_BYTES = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
BASE = 0x9E3779B97F4A7C15 | 1
ALL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(words_only: bool) -> np.ndarray:
    """Which bytes end a word: ASCII white space, or every ASCII character but letters and digits."""
    table = np.zeros(256, bool)
    if words_only:
        table[:128] = [not chr(b).isalnum() for b in range(128)]
    else:
        table[list(SPACES)] = True
    return table


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), base & ALL, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class WordHasher:
    """Hashes the words of texts. A word is a maximal run of bytes that are no separators."""

    def __init__(self, words_only: bool = False):
        self.table = separators(words_only)
        self._grow(BLOCK_BYTES + 1)

    def _grow(self, n: int) -> None:
        self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)

    def pieces(self, texts: Sequence[bytes]) -> Iterator[tuple[int, bytes]]:
        """(index, bytes), long texts cut after white space."""
        for index, text in enumerate(texts):
            while len(text) > BLOCK_BYTES:
                cut = max(text.rfind(s, 0, BLOCK_BYTES) for s in (b" ", b"\n", b"\t"))
                if cut < 0:
                    later = [at for at in (text.find(s, BLOCK_BYTES) for s in (b" ", b"\n", b"\t")) if at >= 0]
                    cut = min(later, default=len(text) - 1)
                yield index, text[: cut + 1]
                text = text[cut + 1 :]
            yield index, text

    def block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of one block of bytes."""
        if len(data) >= len(self.up):
            self._grow(len(data) + 1)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~self.table[data]
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        return starts, ends, mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def __call__(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where the words of each text begin (one more entry than texts)."""
        found, counts = [], np.zeros(len(texts) + 1, np.int64)
        held, size = [], 0

        def flush():
            at = np.cumsum([0, *[len(p) + 1 for _, p in held]])
            starts, _, hashes = self.block(np.frombuffer(b"\n".join(p for _, p in held), np.uint8))
            found.append(hashes)
            np.add.at(counts, [i + 1 for i, _ in held], np.diff(np.searchsorted(starts, at)))

        for index, piece in self.pieces(texts):
            if held and size + len(piece) > BLOCK_BYTES:
                flush()
                held, size = [], 0
            held.append((index, piece))
            size += len(piece) + 1
        if held:
            flush()
        return np.concatenate(found) if found else np.zeros(0, np.uint64), np.cumsum(counts)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every run of ``k`` words; a text of fewer words, but not none, has one shingle."""
    n, lengths = len(words), np.diff(offsets)
    left = np.repeat(offsets[1:], lengths) - np.arange(n)
    first = np.zeros(n, bool)
    first[offsets[:-1][lengths > 0]] = True
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = np.zeros(n, np.uint64)
    for j in range(k):
        factor = np.uint64((BASE * (2 * j + 3) ** 5 | 1) & ALL)
        total += np.where(left > j, padded[j : j + n], np.uint64(0)) * factor
    valid = (left >= k) | first
    counts = np.where(lengths > 0, np.maximum(lengths - k + 1, 1), 0)
    return mix(total)[valid], np.concatenate([[0], np.cumsum(counts)])


def chunks(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8, some ``limit`` bytes at a time, with the index of the first; null is empty."""
    held, size, first = [], 0, 0
    for index, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > limit:
            yield first, held
            held, size, first = [], 0, index
        held.append(data)
        size += len(data)
    if held:
        yield first, held
