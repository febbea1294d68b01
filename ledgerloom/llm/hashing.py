"""Hashes of many stretches of bytes at once, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FACTOR, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)  # odd multipliers
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of its bits."""
    hashes = (hashes ^ (hashes >> np.uint64(31))) * SPREAD
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


class Powers:
    """Powers of FACTOR and of its inverse: the hash of any stretch follows from one running sum."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            both = []
            for base in (FACTOR, np.uint64(pow(int(FACTOR), -1, 2**64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            (self.up, self.down), self.size = both, n
        return self.up[:n], self.down[:n]

    def sums(self, data: np.ndarray) -> np.ndarray:
        up, _ = self.upto(len(data) + 1)
        terms = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
        return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms)))

    def hashes(self, sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, stop); equal bytes have equal hashes wherever they lie."""
        raw = (sums[stops] - sums[starts]) * self.upto(len(sums))[1][starts]
        return mixed(raw + (stops - starts).astype(np.uint64) * SPREAD)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: text i is bytes[offsets[i]:offsets[i + 1]]."""
    texts = column.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words of ``data``; ``fresh[i]`` says that a text begins at byte i."""
    ink = ~SPACE[data]
    begins = ink & (np.concatenate(([True], ~ink[:-1])) | fresh[: len(data)])
    ends = ink & (np.concatenate((~ink[1:], [True])) | fresh[1 : len(data) + 1])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1
