"""Repeated windows of fixed length across a corpus: the distributed frame of both substring operators.

An operator names, for every window of `length` symbols, an anchor inside it that depends on nothing
but the window. Neighbouring windows of one anchor make a fragment. Fragments meet by the name of
their anchor: an anchor met once has no repeated window; an anchor whose fragments are all equal has
only repeated windows. Other groups go, each fragment once with the number of its copies, to the
operator's own comparison. A group of over `GROUP` different fragments is split first, by names that
cover more of the window, until its windows are single; so no group is gathered whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm import kernels as K
from quantloom.llm.common import stored

GROUP = 20_000
#: Bytes of fragments that are compared at once (more only where one group has more).
BATCH = 8_000_000
#: Texts and fragments are told apart by two independent 64-bit hashes each, or 128 bits of one digest.
UID, FRAG = ["u1", "u2"], ["f1", "f2"]
NAMES = [*UID, "key", *FRAG, "a", "p0", "p1"]
RECORD = "u1 long, u2 long, key long, f1 long, f2 long, a int, p0 int, p1 int"
_INT, _LONG = pa.int32(), pa.int64()


def _batch(uids, cols) -> pa.RecordBatch:
    """uids: u1 and u2 of the records, as lists of arrays; cols: key, f1, f2, a, p0, p1 likewise."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (*uids, *cols)]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64 if i < 5 else np.int32, copy=False)) for i, x in enumerate(flat)], names=NAMES)


@dataclass
class Repeats:
    """length: symbols in a window. sequence(data, offs): rows' first symbols, and two functions of a range of
    symbols: bytes that tell it apart, and its content for `compare`. anchors(data, offs): key, anchor, first
    and end start of every fragment in flat symbol positions. compare(fragments): for each (anchor-relative
    start, content, copies) the flags of its windows. sizes: numbers of starts in the parts that a group is
    split into; first: that of the parts made at once (0: none). reach: how far before its anchor a window
    can start. tables: a form of `compare` that works on the table of all fragments, sorted by key. every: compare
    fragments that occur in one form only, too."""

    length: int
    sequence: Callable
    anchors: Callable
    compare: Callable
    sizes: tuple[int, ...]
    first: int
    reach: int
    tables: Callable | None = None
    every: bool = False

    def parts(self, ident, a, p0, p1, size):
        """Records cut to ranges of `size` starts, counted from the anchor: key, index of the record, p0, p1."""
        length, reach = self.length, self.reach
        lo, hi = (p0 - a + reach) // size, (p1 - 1 - a + reach) // size
        n = hi - lo + 1
        at = np.repeat(np.arange(len(a)), n)
        sub = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[at]
        edge = sub * size - reach + a[at]  # first start that the range may have
        q0, q1 = np.maximum(p0[at], edge), np.minimum(p1[at], edge + size)
        start, end = edge + size - 1, edge + length  # symbols that every window of the range has
        key = [K.digest(ident(i, j) + b"%d,%d" % (k, size))[:8] for i, j, k in zip(start.tolist(), end.tolist(), sub.tolist(), strict=True)]
        return np.frombuffer(b"".join(key), np.int64), at, q0, q1

    def frag(self, ident, a, p0, p1):
        """128 bits for each fragment's symbols and its place about the anchor, as two arrays."""
        tail = self.length - 1
        raw = [K.digest(ident(i, j + tail) + b"%d" % (i - x)) for i, j, x in zip(p0.tolist(), p1.tolist(), a.tolist(), strict=True)]
        both = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def records(self):
        def run(batches):
            for b in batches:
                uid = [b.column(u).to_numpy() for u in UID]
                uids, cols = [[], []], [[] for _ in range(6)]
                for row, data, offs in K.pieces(b.column("text")):
                    at, ident, _ = self.sequence(data, offs)
                    key, a, p0, p1 = self.anchors(data, offs)
                    if self.first and len(a):
                        key, i, p0, p1 = self.parts(ident, a, p0, p1, self.first)
                        a = a[i]
                    d = np.searchsorted(at, p0, "right") - 1
                    for col, v in zip((*uids, *cols), (*(u[row + d] for u in uid), K.signed(key), *self.frag(ident, a, p0, p1), a - at[d], p0 - at[d], p1 - at[d]), strict=True):
                        col.append(v)
                yield _batch(uids, cols)

        return run

    def finer(self, size: int):
        """From texts with `list` (old key, a, p0, p1): records of parts of `size` starts."""

        def run(batches):
            for b in batches:
                uid, lists = [b.column(u).to_numpy() for u in UID], b.column("list").to_pylist()
                uids, cols = [[], []], [[] for _ in range(6)]
                for row, data, offs in K.pieces(b.column("text")):
                    at, ident, _ = self.sequence(data, offs)
                    for d in range(len(offs) - 1):
                        own = lists[row + d]
                        a, p0, p1 = (np.array([x[k] for x in own], np.int64) + at[d] for k in ("a", "p0", "p1"))
                        key, i, q0, q1 = self.parts(ident, a, p0, p1, size)
                        old = np.array([x["key"] for x in own], np.int64).view(K.U64)[i]
                        key = K.mix(key.view(K.U64) * K.U64(3) + old)
                        for col, v in zip((*uids, *cols), (*(np.full(len(i), u[row + d]) for u in uid), K.signed(key), *self.frag(ident, a[i], q0, q1), a[i] - at[d], q0 - at[d], q1 - at[d]), strict=True):
                            col.append(v)
                yield _batch(uids, cols)

        return run

    def payloads(self):
        """From texts with `list`: (key, f1, f2, n, x0, data) for every fragment to compare."""

        def run(batches):
            for b in batches:
                lists = b.column("list").to_pylist()
                key, f1, f2, n, x0, raw = [], [], [], [], [], []
                for row, data, offs in K.pieces(b.column("text")):
                    at, _, content = self.sequence(data, offs)
                    for d in range(len(offs) - 1):
                        for x in lists[row + d]:
                            for col, v in zip((key, f1, f2, n), (x["key"], x["f1"], x["f2"], x["n"]), strict=True):
                                col.append(v)
                            x0.append(x["p0"] - x["a"])
                            raw.append(content(at[d] + x["p0"], at[d] + x["p1"] + self.length - 1))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, _LONG) for c in (key, f1, f2, n)), pa.array(x0, _INT), pa.array(raw, pa.binary())], names=["key", *FRAG, "n", "x0", "data"])

        return run

    def compared(self):
        """From fragments sorted by key: (key, f1, f2, s0, s1), ranges of repeated starts counted from the fragment's."""

        def flush(rows):
            out = [[], [], [], [], []]
            for (key, f1, f2, *_), flags in zip(rows, self.compare([r[3:] for r in rows]), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                for s0, s1 in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    for col, v in zip(out, (key, f1, f2, s0, s1), strict=True):
                        col.append(v)
            return pa.RecordBatch.from_arrays([*(pa.array(c, _LONG) for c in out[:3]), pa.array(out[3], _INT), pa.array(out[4], _INT)], names=["key", *FRAG, "s0", "s1"])

        def run(batches):
            rows, size = [], 0
            for b in batches:
                for key, f1, f2, n, x0, raw in zip(*(b.column(k).to_pylist() for k in ("key", *FRAG, "n", "x0", "data")), strict=True):
                    if size >= BATCH and key != rows[-1][0]:
                        yield flush(rows)
                        rows, size = [], 0
                    rows.append((key, f1, f2, x0, raw, n))
                    size += len(raw)
            if rows:
                yield flush(rows)

        return run

    def starts(self, docs: DataFrame, records: DataFrame | None = None) -> DataFrame:
        """(u1, u2, p0, p1): ranges of repeated window starts, in symbols, of texts of `docs` (doc_id, u1, u2, text).

        records: fragments found elsewhere; `docs` then has a column `times`, how often each text occurs."""
        if records is None:
            records = docs.select(*UID, "text").mapInArrow(self.records(), RECORD)
        reps = docs.groupBy(*UID).agg(F.min("doc_id").alias("rep"))

        def with_text(lists: DataFrame) -> DataFrame:
            """Each text once beside its list (copies of one id may come along; they change nothing)."""
            own = lists.join(reps, UID).select(F.col("u1").alias("l_u1"), F.col("u2").alias("l_u2"), "rep", "list")
            same = (docs["u1"] == F.col("l_u1")) & (docs["u2"] == F.col("l_u2")) & docs["doc_id"].eqNullSafe(F.col("rep"))
            return docs.join(own.hint("shuffle_hash"), same).select(*UID, "text", "list")

        found, sizes = None, list(self.sizes)
        while True:
            sums = [F.count(F.lit(1)).alias("m"), *(f(c).alias(f"{n}_{c}") for c in FRAG for f, n in ((F.min, "lo"), (F.max, "hi")))]
            groups = records.groupBy("key").agg(*sums).where("m > 1").select("key", F.expr("lo_f1 = hi_f1 and lo_f2 = hi_f2").alias("same"))
            # stored, so that the join reads plain shuffles on both sides and one hot key's records are split among tasks
            groups = stored(groups, "repeat-groups")
            hits = stored(records.join(groups, "key").select(*NAMES, "same"), "repeat-hits")
            mixed = hits if self.every else hits.where("not same")
            frags = mixed.groupBy("key", *FRAG).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*UID, "a", "p0", "p1")).alias("at"))
            frags = stored(frags.select("key", *FRAG, "n", "at.*"), "repeat-frags")
            large = frags.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > GROUP).select("key")
            hot = bool(sizes) and bool(large.limit(1).count())
            if hot:
                large = stored(large, "repeat-large")
                frags = frags.join(large, "key", "left_anti")
            lists = frags.groupBy(*UID).agg(F.collect_list(F.struct("key", *FRAG, "n", "a", "p0", "p1")).alias("list"))
            payload = with_text(lists).mapInArrow(self.payloads(), "key long, f1 long, f2 long, n long, x0 int, data binary")
            payload = payload.repartition("key").sortWithinPartitions("key")
            runs = self.tables(payload) if self.tables else payload.mapInArrow(self.compared(), "key long, f1 long, f2 long, s0 int, s1 int")
            runs = stored(runs, "repeat-runs")
            some = mixed.join(runs, ["key", *FRAG]).select(*UID, (F.col("p0") + F.col("s0")).alias("p0"), (F.col("p0") + F.col("s1")).alias("p1"))
            if not self.every:
                some = hits.where("same").select(*UID, "p0", "p1").union(some)
            found = some if found is None else found.union(some)
            if not hot:
                return found
            found = stored(found, "repeat-found")
            # copies of a text repeat all their records: one text stands for them, and each record comes as often
            again = mixed.join(large, "key").groupBy(*UID).agg(F.collect_set(F.struct("key", "a", "p0", "p1")).alias("list"))
            times = docs.groupBy(*UID).agg((F.sum("times") if "times" in docs.columns else F.count(F.lit(1))).alias("times"))
            finer = with_text(again).mapInArrow(self.finer(sizes.pop(0)), RECORD).join(times, UID)
            records = finer.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.least("times", F.lit(2)).cast("int")))).drop("times").select(*NAMES)

    def marked(self, docs: DataFrame, starts: DataFrame | None = None) -> DataFrame:
        """`docs` (doc_id, u1, u2, text) with `marks`: packed ranges p0 * 2**32 + p1 of repeated starts, or null."""
        pack = F.shiftleft(F.col("p0").cast("long"), 32) + F.col("p1")
        marks = (self.starts(docs) if starts is None else starts).select(*UID, pack.alias("mark")).groupBy(*UID).agg(F.collect_set("mark").alias("marks"))
        marks = marks.select(F.col("u1").alias("m_u1"), F.col("u2").alias("m_u2"), "marks")
        marks = stored(marks, "repeat-marks")  # so that a hot text's rows are split among tasks
        return docs.join(marks.hint("shuffle_hash"), (docs["u1"] == F.col("m_u1")) & (docs["u2"] == F.col("m_u2")), "left").drop("m_u1", "m_u2")


def covered(marks: list[int] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of symbols that the windows of packed ranges of starts cover."""
    m = np.array(marks or [], np.int64)
    return K.union_runs(m >> 32, (m & 0xFFFFFFFF) + (length - 1))


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, u1, u2 and text (null: empty): what the operators read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("u1"), F.xxhash64(F.lit("second"), text).alias("u2"), text.alias("text"))
