"""The algebra of rows: what samplers and partitioners do to row ids and lengths. Plain Python, no Spark.

A stream of n rows has row ids 0..n-1. Lengths of the slices of a stream are run-length encoded, so that a stream of
any size cut into equal groups costs two entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np

Hull = tuple[int, int]
EMPTY: Hull = (0, 0)
#: Wanted rows as disjoint ascending intervals.
Rows = tuple[Hull, ...]
#: More intervals than this are replaced with the one that holds them all: they serve as filters only, see Wanted.
MAX_INTERVALS = 256


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def hull(a: Hull, b: Hull) -> Hull:
    """The least interval that holds both."""
    if a[0] >= a[1]:
        return b
    return a if b[0] >= b[1] else (min(a[0], b[0]), max(a[1], b[1]))


def merge(intervals: Iterable[Hull]) -> Rows:
    """The union of intervals."""
    out: list[list[int]] = []
    for a, b in sorted(i for i in intervals if i[0] < i[1]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    if len(out) > MAX_INTERVALS:
        out = [[out[0][0], out[-1][1]]]
    return tuple((a, b) for a, b in out)


@dataclass(frozen=True)
class Lengths:
    """Row counts of the slices of a stream as (length, repeats) runs; an unsliced stream has one slice."""

    runs: tuple[tuple[int, int], ...]

    @classmethod
    def of(cls, lengths: Iterable[int]) -> Lengths:
        runs: list[list[int]] = []
        for n in lengths:
            if runs and runs[-1][0] == n:
                runs[-1][1] += 1
            else:
                runs.append([n, 1])
        return cls(tuple((a, b) for a, b in runs))

    @property
    def groups(self) -> int:
        return sum(k for _, k in self.runs)

    @property
    def total(self) -> int:
        return sum(n * k for n, k in self.runs)

    def __iter__(self) -> Iterator[int]:
        for n, k in self.runs:
            for _ in range(k):
                yield n

    def map(self, f) -> Lengths:
        return Lengths.of_runs((f(n), k) for n, k in self.runs)

    @classmethod
    def of_runs(cls, runs: Iterable[tuple[int, int]]) -> Lengths:
        merged: list[tuple[int, int]] = []
        for n, k in runs:
            if merged and merged[-1][0] == n:
                merged[-1] = (n, merged[-1][1] + k)
            elif k:
                merged.append((n, k))
        return cls(tuple(merged))

    def stride(self) -> int | None:
        """The common length if all slices but the last have it and the last is no longer: offsets are then products."""
        if len(self.runs) == 1:
            return self.runs[0][0]
        if len(self.runs) == 2 and self.runs[1][1] == 1 and self.runs[1][0] <= self.runs[0][0]:
            return self.runs[0][0]
        return None

    def offsets(self) -> Iterator[int]:
        at = 0
        for n in self:
            yield at
            at += n


class Sampler:
    """Maps the rows of a stream: ``count`` of n upstream rows, and the upstream ``needed`` for downstream rows."""

    def count(self, n: int) -> int:
        raise NotImplementedError

    def needed(self, rows: Hull, n: int) -> Hull:
        raise NotImplementedError

    def rows(self, n: int) -> list[int | None]:
        """Upstream row of every downstream row (None: a null row); for small n."""
        raise NotImplementedError

    def needs(self, rows: Rows, n: int) -> Rows:
        """Upstream rows for downstream rows: each alone while they are few, else the intervals that hold them."""
        if sum(b - a for a, b in rows) <= MAX_INTERVALS:
            rows = tuple((r, r + 1) for a, b in rows for r in range(a, b))
        return merge(self.needed(r, n) for r in rows)

    def asks(self, below: Wanted, n: int) -> Ask:
        """Whether upstream rows lo..hi have one that the wanted rows ``below`` are made of."""
        raise NotImplementedError


@dataclass(frozen=True)
class All(Sampler):
    """Every row."""

    def count(self, n: int) -> int:
        return n

    def needed(self, rows: Hull, n: int) -> Hull:
        return rows

    def rows(self, n: int) -> list[int | None]:
        return list(range(n))

    def asks(self, below: Wanted, n: int) -> Ask:
        return below.any


@dataclass(frozen=True)
class Ranges(Sampler):
    """The rows a, a + stride, ... below b of each (a, b), one range after the other. Ranges may overlap; what lies
    beyond the stream is left out."""

    intervals: tuple[tuple[int, int], ...]
    stride: int = 1

    def __post_init__(self) -> None:
        if self.stride <= 0:
            raise ValueError(f"stride must be positive, not {self.stride}")
        for a, b in self.intervals:
            if a < 0 or b < a:
                raise ValueError(f"a range needs 0 <= start <= end, not ({a}, {b})")

    def cut(self, n: int) -> list[tuple[int, int, int]]:
        """(start, end, offset of its rows downstream) of each range within n rows."""
        out, at = [], 0
        for a, b in self.intervals:
            b = min(b, n)
            if a < b:
                out.append((a, b, at))
                at += ceil_div(b - a, self.stride)
        return out

    def count(self, n: int) -> int:
        return sum(ceil_div(b - a, self.stride) for a, b, _ in self.cut(n))

    def needed(self, rows: Hull, n: int) -> Hull:
        found = EMPTY
        for a, b, at in self.cut(n):
            low, high = max(rows[0] - at, 0), min(rows[1] - at, ceil_div(b - a, self.stride))
            if low < high:
                found = hull(found, (a + low * self.stride, a + (high - 1) * self.stride + 1))
        return found

    def rows(self, n: int) -> list[int | None]:
        return [r for a, b, _ in self.cut(n) for r in range(a, b, self.stride)]

    def asks(self, below: Wanted, n: int) -> Ask:
        return partial(_in_ranges, np.array(self.cut(n), np.int64).reshape(-1, 3), self.stride, below)


@dataclass(frozen=True)
class Stride(Sampler):
    """Every row whose id is a multiple of ``stride``."""

    stride: int

    def __post_init__(self) -> None:
        if self.stride <= 0:
            raise ValueError(f"stride must be positive, not {self.stride}")

    def count(self, n: int) -> int:
        return ceil_div(n, self.stride)

    def needed(self, rows: Hull, n: int) -> Hull:
        return (rows[0] * self.stride, (rows[1] - 1) * self.stride + 1) if rows[0] < rows[1] else EMPTY

    def rows(self, n: int) -> list[int | None]:
        return list(range(0, n, self.stride))

    def asks(self, below: Wanted, n: int) -> Ask:
        return partial(_in_stride, self.stride, below)


@dataclass(frozen=True)
class Gather(Sampler):
    """The listed rows in the listed order, up to the first that lies beyond the stream. Rows may repeat."""

    indices: tuple[int, ...]

    def __post_init__(self) -> None:
        if any(r < 0 for r in self.indices):
            raise ValueError("row ids can't be negative")

    def within(self, n: int) -> tuple[int, ...]:
        end = next((i for i, r in enumerate(self.indices) if r >= n), len(self.indices))
        return self.indices[:end]

    def count(self, n: int) -> int:
        return len(self.within(n))

    def needed(self, rows: Hull, n: int) -> Hull:
        wanted = self.within(n)[rows[0] : rows[1]]
        return (min(wanted), max(wanted) + 1) if wanted else EMPTY

    def rows(self, n: int) -> list[int | None]:
        return list(self.within(n))

    def asks(self, below: Wanted, n: int) -> Ask:
        chosen = np.array(self.within(n), np.int64)
        at = np.arange(len(chosen))
        return partial(_in_list, np.unique(chosen[below.any(at, at)]))


@dataclass(frozen=True)
class Repeat(Sampler):
    """``times`` rows for each: copies, or with ``null`` the row and then nulls."""

    times: int
    null: bool = False

    def __post_init__(self) -> None:
        if self.times <= 0:
            raise ValueError(f"spacing must be positive, not {self.times}")

    def count(self, n: int) -> int:
        return n * self.times

    def needed(self, rows: Hull, n: int) -> Hull:
        return (rows[0] // self.times, (rows[1] - 1) // self.times + 1) if rows[0] < rows[1] else EMPTY

    def rows(self, n: int) -> list[int | None]:
        return [None if self.null and j else r for r in range(n) for j in range(self.times)]

    def asks(self, below: Wanted, n: int) -> Ask:
        return partial(_in_repeats, self.times, below)


class Partitioner:
    """Cuts a stream into slices: their lengths, the upstream rows they need, and each slice's rows."""

    def lengths(self, n: int) -> Lengths:
        raise NotImplementedError

    def needed(self, n: int) -> Hull:
        raise NotImplementedError

    def groups(self, n: int) -> list[list[int]]:
        """Upstream rows of every slice; for small n."""
        raise NotImplementedError


@dataclass(frozen=True)
class GroupsOf(Partitioner):
    """Slices of ``size`` rows out of every ``stride``-th row."""

    size: int = 250
    stride: int = 1

    def __post_init__(self) -> None:
        if self.size <= 0 or self.stride <= 0:
            raise ValueError("group size and stride must be positive")

    def lengths(self, n: int) -> Lengths:
        m = ceil_div(n, self.stride)
        return Lengths.of_runs([(self.size, m // self.size), (m % self.size, 1 if m % self.size else 0)])

    def needed(self, n: int) -> Hull:
        return (0, n)

    def groups(self, n: int) -> list[list[int]]:
        chosen = list(range(0, n, self.stride))
        return [chosen[i : i + self.size] for i in range(0, len(chosen), self.size)]


@dataclass(frozen=True)
class RangeGroups(Partitioner):
    """A slice for each (a, b), with every ``stride``-th row from a on. Slices may overlap but not exceed the stream."""

    intervals: tuple[tuple[int, int], ...]
    stride: int = 1

    def __post_init__(self) -> None:
        Ranges(self.intervals, self.stride)

    def lengths(self, n: int) -> Lengths:
        for a, b in self.intervals:
            if b > n:
                raise ValueError(f"slice ({a}, {b}) exceeds a stream of {n} rows")
        return Lengths.of(ceil_div(b - a, self.stride) for a, b in self.intervals)

    def needed(self, n: int) -> Hull:
        found = EMPTY
        for interval in self.intervals:
            found = hull(found, interval)
        return found

    def groups(self, n: int) -> list[list[int]]:
        return [list(range(a, b, self.stride)) for a, b in self.intervals]


@dataclass(frozen=True)
class GatherGroups(Partitioner):
    """A slice for each list of rows."""

    rows: tuple[tuple[int, ...], ...]

    def lengths(self, n: int) -> Lengths:
        if any(not 0 <= r < n for group in self.rows for r in group):
            raise ValueError(f"a slice names a row outside a stream of {n} rows")
        return Lengths.of(map(len, self.rows))

    def needed(self, n: int) -> Hull:
        every = [r for group in self.rows for r in group]
        return (min(every), max(every) + 1) if every else EMPTY

    def groups(self, n: int) -> list[list[int]]:
        return [list(g) for g in self.rows]


def stencil_needs(rows: Rows, offsets: Sequence[int], n: int) -> Rows:
    """Rows that windows at ``rows`` touch, the rows themselves included, with ids clamped to the stream."""
    low, high = min(0, *offsets), max(0, *offsets)
    return merge((max(0, a + low), min(n, b + high)) for a, b in rows) if offsets else rows


def bounded_needs(rows: Rows, warmup: int) -> Rows:
    """Each wanted row and the ``warmup`` rows before it."""
    return merge((max(0, a - warmup), b) for a, b in rows)


def unbounded_needs(rows: Rows) -> Rows:
    """All rows up to the last wanted."""
    return ((0, rows[-1][1]),) if rows else ()


#: Of ascending first and last rows lo and hi: which lo..hi have a wanted row.
Ask = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True, eq=False)
class Wanted:
    """Exactly the wanted rows of a stream of ``n`` rows: all, or those that one of ``asks`` finds. Samplers translate
    the question to their downstream rows, so that no rows are listed but those that Gather lists."""

    n: int
    whole: bool = True
    asks: tuple[Ask, ...] = ()

    def any(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which of the rows lo..hi, both ascending, have a wanted row."""
        lo, hi = np.maximum(lo, 0), np.minimum(hi, self.n - 1)
        found = lo <= hi
        if self.whole or not found.any():
            return found
        at = np.flatnonzero(found)
        lo, hi = lo[at], hi[at]
        found[at] = np.logical_or.reduce([ask(lo, hi) for ask in self.asks])
        return found


def _in_ranges(cut: np.ndarray, stride: int, below: Wanted, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    found = np.zeros(len(lo), bool)
    for a, b, at in cut[(cut[:, 0] <= hi[-1]) & (cut[:, 1] > lo[0])].tolist():
        i, j = np.searchsorted(hi, a), np.searchsorted(lo, b)
        if i < j:
            first, last = np.maximum(lo[i:j], a) - a, np.minimum(hi[i:j], b - 1) - a
            first, last = -(-first // stride), last // stride
            found[i:j] |= below.any(at + first, at + last)
    return found


def _in_stride(stride: int, below: Wanted, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return below.any(-(-lo // stride), hi // stride)


def _in_list(chosen: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.searchsorted(chosen, lo) < np.searchsorted(chosen, hi, "right")


def _in_repeats(times: int, below: Wanted, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return below.any(lo * times, hi * times + (times - 1))


def _in_windows(before: int, after: int, below: Wanted, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return below.any(lo - before, hi + after)


def _in_hull(rows: Hull, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (lo < rows[1]) & (hi >= rows[0])


def within_windows(below: Wanted, before: int, after: int) -> Wanted:
    """Rows with a wanted row at most ``before`` rows before or ``after`` rows after them."""
    if below.whole or not before and not after:
        return below
    return Wanted(below.n, False, (partial(_in_windows, before, after, below),))


def within_hull(rows: Hull, n: int) -> Wanted:
    return Wanted(n, False, (partial(_in_hull, rows),))


@dataclass
class SliceArgs:
    """One argument for each slice of a stream; a plain argument holds for all slices."""

    values: list = field(default_factory=list)
