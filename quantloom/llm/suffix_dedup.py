"""Suffix-array deduplication by column-wise construction over many documents.

Repeated strings of `WINDOW` bytes are removed from whole texts. A string's anchor is its leftmost
32-byte gram of least hash; equal strings have it at the same place, so aligned at their anchors they
begin in the same column. All fragments whose anchor occurs more than once are the documents of collections whose
suffix order is built from the last column to the first, one symbol of every document a round: the
round's Burrows-Wheeler column sorts the order of the round before (a stable sort by the inserted
symbol), and common prefixes grow by one where neighbours have equal symbols and are minima of the ranges
between them. Suffixes whose common prefix with a neighbour has `WINDOW` bytes are marked. Order and prefixes are read
from one table in the shared folder and written to the next, in sequence, every PASS rounds. As columns
are aligned, a round compares only suffixes of its own column, and costs one row a document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm import kernels as K
from quantloom.llm.common import discard, stored
from quantloom.llm.repeats import BATCH, Repeats, covered, prepared

WINDOW, GRAM = 400, 32


def _sequence(data: np.ndarray, offs: np.ndarray):
    cut = lambda i, j: data[i:j].tobytes()
    return offs, cut, cut


def _anchors(data: np.ndarray, offs: np.ndarray):
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < WINDOW:
        return none.view(K.U64), none, none, none
    eight = K.mix(np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8").ravel())
    m = n - GRAM + 1
    g = K.mix(sum(eight[8 * i : 8 * i + m] * K.U64(2 * i + 1) for i in range(GRAM // 8)))  # equal anchors only propose
    v = (g >> K.U64(32) << K.U64(32)) | np.arange(len(g), dtype=K.U64)  # ties go to the left, alike in every window
    best = (K.sliding_min(v, WINDOW - GRAM + 1) & K.U64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(best) + 1, bool)
    for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if e - s >= WINDOW:
            valid[s : e - WINDOW + 1] = True
    new = valid[:-1].copy()
    new[1:] &= ~valid[:-2] | (best[1:] != best[:-1])
    end = valid[:-1].copy()
    end[:-1] &= ~valid[1:-1] | (best[1:] != best[:-1])
    p0, p1 = np.flatnonzero(new), np.flatnonzero(end) + 1
    return none.view(K.U64), best[p0], p0, p1


def _least(e: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of e[lo : hi + 1], ranges not empty."""
    span = hi - lo + 1
    if span.sum() <= 8 * len(e) + 64:
        return np.minimum.reduceat(np.append(e, e[-1]), np.stack([lo, hi + 1], axis=1).ravel())[::2]
    level = np.frexp(span.astype(np.float64))[1] - 1
    out, t = np.empty(len(lo), e.dtype), e
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << k) + 1])
        t = np.minimum(t[: -(1 << k)], t[1 << k :]) if len(t) > 1 << k else t
    return out


class Collection:
    """Fragments (first column, bytes, copies) aligned at their anchors, and the order of their suffixes at column `x`:
    the documents in suffix order, and the column at which each first differs from the one before. flags: the starts
    of windows, fragment by fragment, that were found to occur again."""

    ARRAYS = {"first": np.int64, "end": np.int64, "copies": np.int64, "order": np.int32, "diff": np.int32, "flags": np.bool_}

    def __init__(self, x: int, data: bytes, **arrays: np.ndarray):
        self.x, self.data = x, data
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, fragments: list[tuple[int, bytes, int]], window: int = WINDOW) -> Collection:
        first = np.array([x for x, _, _ in fragments], np.int64)
        size = np.array([len(b) for _, b, _ in fragments], np.int64)
        copies = np.array([k for *_, k in fragments], np.int64)
        starts = np.maximum(size - window + 1, 0)
        none = np.zeros(0, np.int32)
        return cls(int((first + size).max()), b"".join(b for _, b, _ in fragments), first=first, end=first + size, copies=copies, order=none, diff=none, flags=np.repeat(copies > 1, starts))

    def left(self) -> int:
        return self.x - int(self.first.min())

    def advance(self, rounds: int, window: int = WINDOW) -> None:
        """Inserts the symbols of the next `rounds` columns, last columns first, one of every document a round."""
        s, e = self.first, self.end
        flat = np.frombuffer(self.data, np.uint8)
        size = np.minimum(e, self.x) - s
        size = np.maximum(size, 0)  # symbols behind column x are gone: their rounds are over
        base = np.cumsum(size) - size - s
        starts = np.maximum(e - s - window + 1, 0)
        at, limit = np.cumsum(starts) - starts, s + starts
        joins, leaves = np.argsort(-e, kind="stable"), np.argsort(-s, kind="stable")
        je, ls = -e[joins], -s[leaves]
        order, diff, flags = self.order.astype(np.int64), self.diff.astype(np.int64), np.append(self.flags, False)
        for x in range(self.x - 1, max(self.x - rounds, int(s.min())) - 1, -1):
            a, b = np.searchsorted(ls, -(x + 1)), np.searchsorted(ls, -(x + 1), "right")
            if b > a:  # whole by now
                kept = np.flatnonzero(s[order] <= x)
                if len(kept):
                    diff = np.minimum.reduceat(diff[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
                    order = order[kept]
                else:
                    order, diff = order[:0], diff[:0]
            a, b = np.searchsorted(je, -(x + 1)), np.searchsorted(je, -(x + 1), "right")
            if b > a:  # empty suffixes come first
                order = np.concatenate([joins[a:b], order])
                diff = np.concatenate([np.full(b - a, x + 1), diff])
                if len(diff) > b - a:
                    diff[b - a] = x + 1
            if not len(order):
                continue
            symbol = flat[base[order] + x]  # the round's Burrows-Wheeler column
            rank = np.argsort(symbol, kind="stable")
            ranked, grown = symbol[rank], np.full(len(order), x, np.int64)
            same = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
            if len(same):
                grown[same] = _least(diff, rank[same - 1] + 1, rank[same])
            order, diff = order[rank], grown
            near = diff - x >= window
            near[0] = False
            hit = near.copy()
            hit[:-1] |= near[1:]
            f = order[hit]
            f = f[x < limit[f]]
            flags[at[f] + x - s[f]] = True
        self.x = max(self.x - rounds, int(s.min()))
        self.order, self.diff, self.flags = order.astype(np.int32), diff.astype(np.int32), flags[:-1]
        keep = np.maximum(np.minimum(e, self.x) - s, 0)
        if keep.sum() < len(flat):  # what is left to insert
            self.data = flat[np.repeat(np.append(0, np.cumsum(size)[:-1]), keep) + np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)].tobytes()


def repeated(fragments: list[tuple[int, bytes, int]], window: int = WINDOW, rounds: int = 100) -> list[np.ndarray]:
    """For each (first column, bytes, copies): which of its windows occur again, in it or in another."""
    own = Collection.of(fragments, window)
    while own.left() > 0:
        own.advance(rounds, window)
    return np.split(own.flags, np.cumsum(np.maximum(own.end - own.first - window + 1, 0))[:-1])


#: Rounds between two writings of a collection's state.
PASS = 160
_IDS = ("key", "f1", "f2")
_COLUMNS = ["x", "left", "data", *Collection.ARRAYS, *_IDS]
_TABLE = "x int, left int, " + ", ".join(f"{c} binary" for c in ("data", *Collection.ARRAYS, *_IDS))


def _written(own: Collection, ids: list[bytes]) -> pa.RecordBatch:
    arrays = [np.ascontiguousarray(getattr(own, c), k).tobytes() for c, k in Collection.ARRAYS.items()]
    values = [own.x, max(own.left(), 0), own.data, *arrays, *ids]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i < 2 else pa.binary()) for i, v in enumerate(values)], names=_COLUMNS)


def _gathered(batches):
    """From fragments sorted by key: collections of whole groups, about BATCH bytes each."""
    rows, size = [], 0

    def flush():
        return _written(Collection.of([r[3:] for r in rows]), [np.array([r[i] for r in rows], np.int64).tobytes() for i in range(3)])

    for b in batches:
        for key, f1, f2, n, x0, raw in zip(*(b.column(k).to_pylist() for k in ("key", "f1", "f2", "n", "x0", "data")), strict=True):
            if size >= BATCH and key != rows[-1][0]:
                yield flush()
                rows, size = [], 0
            rows.append((key, f1, f2, x0, raw, n))
            size += len(raw)
    if rows:
        yield flush()


def _read(b: pa.RecordBatch, r: int) -> tuple[Collection, list[bytes]]:
    arrays = {c: np.frombuffer(b.column(c)[r].as_buffer(), k) for c, k in Collection.ARRAYS.items()}
    return Collection(b.column("x")[r].as_py(), b.column("data")[r].as_py(), **arrays), [b.column(c)[r].as_py() for c in _IDS]


def _pass(batches):
    """PASS rounds of every collection that is not done."""
    for b in batches:
        for r in range(b.num_rows):
            own, ids = _read(b, r)
            if own.left() > 0:
                own.advance(PASS)
            yield _written(own, ids)


def _marked_runs(batches):
    """Ranges of flagged starts, counted from each fragment's first."""
    for b in batches:
        for r in range(b.num_rows):
            own, ids = _read(b, r)
            starts = np.maximum(own.end - own.first - WINDOW + 1, 0)
            at = np.cumsum(starts) - starts
            f = np.repeat(np.arange(len(starts)), starts)
            head, tail = own.flags.copy(), own.flags.copy()
            edge = f[1:] != f[:-1]
            head[1:] &= ~own.flags[:-1] | edge
            tail[:-1] &= ~own.flags[1:] | edge
            i, j = np.flatnonzero(head), np.flatnonzero(tail) + 1
            cols = [*(np.frombuffer(x, np.int64)[f[i]] for x in ids), (i - at[f[i]]).astype(np.int32), (j - at[f[i]]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*_IDS, "s0", "s1"])


def constructed(fragments: DataFrame) -> DataFrame:
    """Runs (key, f1, f2, s0, s1) of repeated starts of fragments that are sorted by key in each partition.

    The state of every collection is a row of a table in the shared folder: a pass reads all rows in order, inserts PASS
    columns, and writes all rows to the next table. A lost executor costs a part of one pass."""
    table = stored(fragments.mapInArrow(_gathered, _TABLE), "columns")
    while (table.agg(F.max("left").alias("n")).first()["n"] or 0) > 0:  # one row
        last, table = table, stored(table.mapInArrow(_pass, _TABLE), "columns")
        discard(last)
    return table.mapInArrow(_marked_runs, "key long, f1 long, f2 long, s0 int, s1 int")


REPEATS = Repeats(WINDOW, _sequence, _anchors, repeated, (47, 12, 3, 1), 185, WINDOW - GRAM, constructed, True)


def deduplicated(docs: DataFrame, repeats: Repeats = REPEATS) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Every byte that a string of 400 bytes covers which also starts elsewhere, in any row, is removed;
    strings are judged on the input. Null texts count as empty; texts under 400 bytes stay; repeated
    rows of 400 bytes or more lose all. Other columns are not read.
    """
    length = repeats.length

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            marks = b.column("marks").to_pylist()
            for row, data, offs in K.pieces(b.column("text")):
                for d in range(len(offs) - 1):
                    own = data[offs[d] : offs[d + 1]]
                    s, e = covered(marks[row + d], length)
                    keep = np.ones(len(own), bool)
                    for i, j in zip(s.tolist(), e.tolist(), strict=True):
                        keep[i:j] = False
                    kept = own[keep].tobytes() if len(s) else own.tobytes()
                    for col, v in zip(out, (len(own), len(own) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return repeats.marked(prepared(docs)).select("doc_id", "text", "marks").mapInArrow(run, schema)
