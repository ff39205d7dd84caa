"""Runs of words that repeat with a period, found on a harmonic grid with vectorised prefix hashes.

A run of period q and length >= 4 * q matches itself, q words on, over 3 * q words or more, so one of these words has a number
that 3 * q divides. For every period p the grid points are thus the multiples of 3 * p, n/3 * (1 + 1/2 + 1/3 + ...) in all.
From all (period, grid point) pairs whose words match, the longest common extensions forwards and backwards are found at
once by binary search, comparing prefix hashes. What is long enough is a run; runs of equal extent keep their smallest
period, and each is then verified word by word. Hashes never tell equal words apart, so a verified run is exact: its
ends are mismatches. If one fails (a collision), its documents are searched again under another base.

Many texts are searched at once, as extensions stop at the ends of texts; pairs are taken PAIRS at a time, so memory follows
the words of a batch (or of one longer text) and not the number of its periods.

Null and empty texts have no words and no runs; every row is judged by its own text, so repeats get equal results; empty
tables give no rows; a column that has the name of a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quirefold.llm.common import append_by_arrow

#: Times that a run's period fits into it at least, and words that it has at least.
EXPONENT = 4
SHORTEST = 6
#: Words that are searched at once (or one longer text), and pairs of period and grid point.
WORDS = 200_000
PAIRS = 1_000_000
#: Hashes are taken modulo this prime: products of two stay below 2**63.
PRIME = 2**31 - 1
BASES = (1_103_515_245, 69_621, 48_271, 1_220_703_125, 630_360_016, 397_204_094)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo PRIME, by doubling."""
    out = np.ones(1, np.int64)
    step = base % PRIME
    while len(out) <= n:
        out = np.r_[out, out * step % PRIME]
        step = step * step % PRIME
    return out[: n + 1]


def _grid(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grid point, period, text) arrays of about PAIRS entries: in a text of n words, periods 1 to n / EXPONENT, for each
    the points start + 3 * p * k that have a word p further on."""
    size = ends - starts
    most = int(size.max(initial=0)) // EXPONENT
    low = 1
    while low <= most:
        alive = np.flatnonzero(size >= EXPONENT * low)
        # periods low to high - 1: each has at most size / (3 * low) + 1 points a text
        high = min(most + 1, low + max(1, PAIRS // int((size[alive] // (3 * low) + 1).sum())))
        p = np.arange(low, high)
        text, period = (x.ravel() for x in np.meshgrid(alive, p, indexing="ij"))
        fits = size[text] >= EXPONENT * period
        text, period = text[fits], period[fits]
        points = (size[text] - period - 1) // (3 * period) + 1
        of = np.repeat(np.arange(len(text)), points)
        k = np.arange(len(of)) - np.repeat(np.cumsum(points) - points, points)
        yield starts[text][of] + 3 * period[of] * k, period[of], text[of]
        low = high


def _extend(limit: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For all pairs the largest length up to limit at which same(pairs, lengths) holds; it holds at 0."""
    low, high = np.zeros_like(limit), limit.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_] + 1) // 2
        equal = same(open_, middle)
        low[open_] = np.where(equal, middle, low[open_])
        high[open_] = np.where(equal, high[open_], middle - 1)
    return low


def _search(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start, end, period) rows of the runs, and whether each is verified."""
    power = _powers(base, len(words))
    prefix = np.r_[0, np.cumsum(words * power[: len(words)] % PRIME) % PRIME]  # words are small numbers
    found = []
    for at, p, text in _grid(starts, ends):
        match = words[at] == words[at + p]
        at, p, text = at[match], p[match], text[match]

        def same(a: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
            """Whether the hashes of so many words from a and from a + p agree."""
            left = (prefix[a + length] - prefix[a]) % PRIME * power[p] % PRIME
            return left == (prefix[a + p + length] - prefix[a + p]) % PRIME

        ahead = _extend(ends[text] - at - p, lambda i, n: same(at[i], n, p[i]))
        back = _extend(at - starts[text], lambda i, n: same(at[i] - n, n, p[i]))
        start, end = at - back, at + p + ahead
        run = end - start >= np.maximum(SHORTEST, EXPONENT * p)
        found.append(np.stack([text[run], start[run], end[run], p[run]], axis=1))
    runs = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    runs = runs[np.lexsort(runs.T[::-1])]
    runs = runs[np.r_[True, (np.diff(runs[:, :3], axis=0) != 0).any(axis=1)]] if len(runs) else runs
    return runs, np.array([np.array_equal(words[s : e - p], words[s + p : e]) for _, s, e, p in runs], bool)


def find_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, as rows of start, length and period, by start, then period."""
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers) + 1) for x in texts for w in x], np.int64)
    ends = np.cumsum([len(x) for x in texts]).astype(np.int64)
    starts = ends - np.array([len(x) for x in texts], np.int64)
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(texts)
    left = np.flatnonzero(ends - starts >= SHORTEST)
    for base in BASES:
        if not len(left):
            break
        runs, right = _search(words, starts[left], ends[left], base)
        failed = np.unique(runs[~right, 0])
        for i in np.setdiff1d(runs[:, 0], failed):
            own = runs[runs[:, 0] == i]
            rows = np.stack([own[:, 1] - starts[left[i]], own[:, 2] - own[:, 1], own[:, 3]], axis=1)
            out[left[i]] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        left = left[failed]
    if len(left):
        raise ArithmeticError(f"hashes collide under all of {len(BASES)} bases")
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run repeats: what lies in a run beyond its first period."""
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]


FIELDS = [
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
    T.StructField("collapsed", T.StringType()),
]


def periodic_runs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (all, if None), `runs` (by start, then period; words numbered from 0) and `collapsed`: the kept words,
    joined by one blank."""

    def build() -> Callable[[list[pa.Array]], list[pa.Array]]:
        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            texts = [x.split() if x else [] for x in columns[0].cast(pa.binary()).to_pylist()]
            runs: list[np.ndarray] = []
            i = 0
            while i < len(texts):
                j, n = i + 1, len(texts[i])
                while j < len(texts) and n + len(texts[j]) <= WORDS:
                    n += len(texts[j])
                    j += 1
                runs += find_runs(texts[i:j])
                i = j
            rows = np.concatenate([*runs, np.empty((0, 3), np.int64)])
            offsets = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in range(3)], ["start", "length", "period"])
            collapsed = [b" ".join(collapse(w, r)) for w, r in zip(texts, runs, strict=True)]
            return [pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(collapsed, pa.binary()).cast(pa.string())]

        return compute

    return append_by_arrow(df, FIELDS, build, [text_col], keep=keep)
