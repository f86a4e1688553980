"""Periodic runs of words: stretches that repeat a period four times or more, and texts with the repeats taken out.

Method: a harmonic grid. A stretch of period p and length 4p or more holds four neighbouring multiples of p, whose
words are equal. So for every period p up to a quarter of a text, wherever four grid words in a row agree, the
longest common extensions forward and backward between jp and (j+1)p give the run's ends. Extensions come from
suffix arrays of the words and of the reversed words, their common prefixes and range-minimum tables. A run is found
once for each multiple of its smallest period, always with the same ends; the smallest is kept.

Scale: texts are independent, so there is no shuffle; a text of n words takes n log n grid points, and only texts with
a candidate get suffix arrays. Memory follows the longest single text (some 400 bytes a word for texts that repeat
all through, far less otherwise).

Cases: null, empty and blank texts have no words, no runs and an empty collapsed text. Words are compared whole, byte
by byte. Repeated rows get equal results each; rows keep their number and their other columns. Input columns named
like a result (`n_words`, `runs`, `collapsed`, in any case) are replaced. Empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from quantloom.llm import kernels as K

#: Least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text whose words are handled at once, and grid points at once.
PIECE, GRID = 1 << 21, 1 << 20

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


class Extensions:
    """Longest common extensions between suffixes of one text, for many texts in one array of symbols.

    symbols: int64, 0 or more; ends: for every place, the end of its text; texts: which text it is of.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, texts: np.ndarray):
        n = len(symbols)
        self.ends = ends
        # order by text, then symbol; a rank is the place of the first of its equals
        order = np.lexsort((symbols, texts))
        s, t = symbols[order], texts[order]
        head = np.ones(n, bool)
        head[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        tied = order[_in_group(head)]
        levels, h = [(1, rank.copy())], 1
        while len(tied):
            after = tied + h
            inside = after < ends[tied]
            second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[tied] * (n + 1) + second
            by = np.argsort(key, kind="stable")
            tied, key = tied[by], key[by]
            group = rank[tied]
            new_group, new_key = np.ones(len(tied), bool), np.ones(len(tied), bool)
            new_group[1:] = group[1:] != group[:-1]
            new_key[1:] = key[1:] != key[:-1]
            at = np.arange(len(tied))
            first = np.maximum.accumulate(np.where(new_group, at, 0))
            rank[tied] = group + np.maximum.accumulate(np.where(new_key, at, 0)) - first
            tied = tied[_in_group(new_key)]
            h *= 2
            levels.append((h, rank.copy()))
        self.rank = rank
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        self.minima = _minima(self._prefixes(suffixes, levels))

    def _prefixes(self, suffixes: np.ndarray, levels: list) -> np.ndarray:
        """Common prefix of each suffix, in order, with the one before it: equal ranks of h symbols, h falling."""
        n = len(suffixes)
        out = np.zeros(n, np.int64)
        if n > 1:
            a, b = suffixes[:-1].copy(), suffixes[1:].copy()
            for h, rank in reversed(levels):
                ok = (a < self.ends[suffixes[:-1]]) & (b < self.ends[suffixes[1:]])
                same = ok & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
                a[same] += h
                b[same] += h
            out[1:] = a - suffixes[:-1]
        return out.astype(np.int32)

    def query(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, i != j, of one text."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for level in np.unique(k).tolist():
            m, row = k == level, self.minima[level]
            out[m] = np.minimum(row[low[m]], row[high[m] - (1 << level) + 1])
        return out


def _in_group(head: np.ndarray) -> np.ndarray:
    """Which members of sorted groups, given their heads, are not alone."""
    alone = head.copy()
    alone[:-1] &= head[1:]
    return ~alone


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Row k has the minimum of 2^k values from each place on."""
    rows, w = [values], 1
    while 2 * w <= len(values):
        last = rows[-1]
        rows.append(np.minimum(last[:-w], last[w:]))
        w *= 2
    return rows


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many members: each member's group, and its number within it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def candidates(symbols: np.ndarray, offs: np.ndarray):
    """Yields (places, periods): grid points jp from which four grid words in a row agree, for all texts and periods."""
    n = np.diff(offs)
    text, p = _ragged(n // LEAST_PERIODS)
    p += 1
    points = -(-n[text] // p)
    total = np.cumsum(points)
    row = 0
    while row < len(p):
        stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + GRID, "right")))
        which, j = _ragged(points[row:stop])
        step = p[row:stop][which]
        at = offs[:-1][text[row:stop]][which] + j * step
        same = np.zeros(len(at) + 2, bool)
        w = symbols[at]
        same[: len(at) - 1] = (w[1:] == w[:-1]) & (which[1:] == which[:-1])
        good = same[:-2] & same[1:-1] & same[2:]
        if good.any():
            yield at[good], step[good]
        row = stop


def find_runs(symbols: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, smallest periods) of all runs, by start, then period; text t has the symbols offs[t] to offs[t + 1]."""
    none = np.zeros(0, np.int64)
    found = list(candidates(symbols, offs))
    if not found:
        return none, none, none
    at, p = (np.concatenate(x) for x in zip(*found, strict=True))
    n = np.diff(offs)
    text = np.searchsorted(offs, at, "right") - 1
    own = np.unique(text)
    group, j = _ragged(n[own])
    base = np.cumsum(n[own]) - n[own]
    place = offs[own][group] + j  # of each symbol kept
    kept, ends = symbols[place], (base + n[own])[group]
    size = len(kept)
    forward = Extensions(kept, ends, group)
    backward = Extensions(kept[::-1].copy(), size - base[group][::-1], group[::-1].copy())
    mine = np.searchsorted(own, text)
    local = at - offs[text] + base[mine]
    out = []
    for k in range(0, len(local), GRID):
        i, q, b = local[k : k + GRID], p[k : k + GRID], base[mine[k : k + GRID]]
        ahead = forward.query(i, i + q)
        back = np.zeros(len(i), np.int64)
        inner = i > b
        back[inner] = backward.query(size - i[inner], size - i[inner] - q[inner])
        s, e = i - back, i + q + ahead
        ok = e - s >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        out.append(_smallest(s[ok], e[ok], q[ok]))
    s, e, q = _smallest(*(np.concatenate(x) for x in zip(*out, strict=True)))
    s, e = place[s], place[e - 1] + 1
    by = np.lexsort((q, s))
    return s[by], e[by], q[by]


def _smallest(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with the smallest of its periods."""
    by = np.lexsort((q, e, s))
    s, e, q = s[by], e[by], q[by]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return s[first], e[first], q[first]


def _batch(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(n_words, runs, collapsed) of a column of texts."""
    counts, collapsed, starts, lengths, periods, per_row = [], [], [], [], [], []
    for _, raw, offs in K.pieces(column, PIECE):
        whole = raw.tobytes()
        words = [whole[a:b].split() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]  # ASCII white space
        n = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(n)])
        names: dict = defaultdict(count().__next__)
        symbols = np.fromiter(map(names.__getitem__, chain.from_iterable(words)), np.int64, int(first[-1]))
        s, e, q = find_runs(symbols, first)
        at = np.searchsorted(s, first)
        gone = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(gone, s + q, 1)
        np.add.at(gone, e, -1)
        keep = np.cumsum(gone[:-1]) == 0
        has = np.diff(at) > 0
        for row, ws in enumerate(words):
            if has[row]:
                ws = [ws[i] for i in np.flatnonzero(keep[first[row] : first[row + 1]]).tolist()]
            collapsed.append(b" ".join(ws))
        counts.append(n)
        per_row.append(np.diff(at))
        starts.append(s - first[np.searchsorted(first, s, "right") - 1])
        lengths.append(e - s)
        periods.append(q)
    if not counts:
        counts = starts = lengths = periods = per_row = [np.zeros(0, np.int64)]
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (starts, lengths, periods)], names=RUN.names)
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(per_row))]), pa.int32()), flat)
    return pa.array(np.concatenate(counts), pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, runs (array of start, length, period; by start, then period) and collapsed: the words that no
    run holds after its first period, joined by one space."""
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    kept = [f for f in docs.schema if f.name.lower() not in added.names]
    names = [f.name for f in kept]
    place = [f.name.lower() for f in docs.schema].index(text.lower())

    def rows(batches):
        for b in batches:
            more = _batch(b.column(place))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i, f in enumerate(b.schema.names) if f in names), *more], names=[*names, *added.names])

    return docs.mapInArrow(rows, T.StructType([*kept, *added]))
