"""Names of words and of runs of words, for code in Arrow batches, and how tasks pass many of them to each other.

A name is a 64-bit digest of what it stands for, so all tasks give the same thing the same name without asking each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd bases of the two sums that name runs of words.
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base squared ... modulo 2 to the 64th."""
    return np.concatenate(([U(1)], np.cumprod(np.full(max(n - 1, 1), base, U), dtype=U)))[: max(n, 1)]


class Words:
    """The words of several texts: name, text, start and end byte of each in ``data``, which joins all texts.

    inside: for each byte whether it belongs to words; low: whether A-Z are lowered. Texts are bytes of UTF-8, and all that divides words is ASCII.
    """

    def __init__(self, texts: list[bytes], inside: np.ndarray, low: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined.lower() if low else joined, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        within = inside[self.data]
        edges = np.flatnonzero(np.diff(within, prepend=False))
        self.start, self.end = edges[::2], edges[1::2]
        self.text = np.searchsorted(self.begin, self.start, "right") - 1
        size = self.end - self.start
        kept = self.data[within]
        first = np.cumsum(size) - size
        place = np.arange(len(kept)) - np.repeat(first, size)
        values = (kept.astype(U) + U(1)) * powers(BASES[0], int(size.max(initial=1)))[place]
        self.name = mixed(np.add.reduceat(values, first) + size.astype(U) * BASES[1]) | U(1) if len(first) else np.zeros(0, U)
        #: Where the words of each text begin, and where those of the last end.
        self.at = np.searchsorted(self.text, np.arange(len(texts) + 1))


class Runs:
    """Names of any runs of a row of symbols in constant time each, from sums over all that come before."""

    def __init__(self, symbols: np.ndarray, lanes: int = 1):
        self.sums, self.back = [], []
        for base in BASES[:lanes]:
            up = powers(base, len(symbols) + 1)
            self.sums.append(np.concatenate(([U(0)], np.cumsum(symbols * up[: len(symbols)], dtype=U))))
            self.back.append(powers(U(pow(int(base), -1, 1 << 64)), len(symbols) + 1))

    def names(self, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
        return mixed((self.sums[lane][end] - self.sums[lane][start]) * self.back[lane][start] + (end - start).astype(U))


def slices(batch: pa.RecordBatch, column: str, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes in a binary column."""
    sizes = np.array(batch.column(column).to_pandas().map(lambda x: len(x or b"")), np.int64)
    marks = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, b in zip([0, *marks], [*marks, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def dealt(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[dict]:
    """A row for each bucket that comes: its number and, as bytes, its part of each column."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    marks = np.flatnonzero(np.diff(bucket)) + 1
    moved = {k: v[order] for k, v in columns.items()}
    for a, b in zip([0, *marks], [*marks, len(bucket)], strict=True):
        if b > a:
            yield {"bucket": int(bucket[a])} | {k: v[a:b].tobytes() for k, v in moved.items()}


def gathered(table: pa.Table, column: str, kind: str) -> np.ndarray:
    """All numbers of a column of bytes."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


class Sieve:
    """A set of names as bits of their leading digits: it says yes to all of them, and to few others while it isn't full.

    It only saves work: what passes it by mistake is told apart later. Its size is bounded, and beyond that it lets more pass.
    """

    #: Bits at most, as a power of two: 32 MB.
    MOST = 28

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @classmethod
    def bits_for(cls, names: int) -> int:
        """The power of two of bits that so many names take, 16 bits each where there is room."""
        return int(np.clip(int(max(names, 1) * 16 - 1).bit_length(), 24, cls.MOST))

    @staticmethod
    def segment(names: np.ndarray, size: int, share: int) -> bytes:
        """The bits of names that agree in their first ``share`` digits."""
        marks = np.zeros(1 << (size - share), bool)
        marks[((names >> U(64 - size)) & U((1 << (size - share)) - 1)).astype(np.int64)] = True
        return np.packbits(marks, bitorder="little").tobytes()

    @classmethod
    def joined(cls, segments: dict[int, bytes], size: int, share: int) -> Sieve:
        """The sieve from the segments by their first digits; missing ones are empty."""
        bits = np.zeros(1 << (size - 3), np.uint8)
        width = 1 << (size - share - 3)
        for k, s in segments.items():
            bits[k * width : (k + 1) * width] = np.frombuffer(s, np.uint8)
        return cls(bits, size)

    def holds(self, names: np.ndarray) -> np.ndarray:
        place = (names >> U(64 - self.size)).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def share_for(items: int, each: int = 1_000_000) -> int:
    """Into how many buckets, as a power of two, so many items are dealt for about ``each`` in one."""
    return int(np.clip(int(max(1, items // each)).bit_length(), 3, 20))
