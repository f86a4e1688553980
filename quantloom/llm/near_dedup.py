"""Near-duplicates by min-max hashing.

A document's set is hashed once by each of 64 functions; both the least and the greatest value are
kept, which makes 128 signature values out of 64 evaluations. 32 bands of four values (both ends under
two functions) name candidates: a pair of similarity 0.8 shares none with probability 5e-8. Documents
of equal sets (128 bits of each) are one node from the start, so groups of copies make no pairs.

Candidates are tested without listing all pairs of a bucket: first every node against the least node
of its bucket, and links that full sets of words confirm join components; then, in buckets that still hold
several components, members outside the largest one are compared with all by full sets, in parts,
and only links that join components are given out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm import kernels as K
from quantloom.llm.common import fresh, stored

FUNCTIONS, BANDS = 64, 32
#: Members of a bucket that one task compares, of either side.
PART = 3000
_rng = np.random.default_rng(97)
MULTIPLIERS = _rng.integers(1, 2**63, FUNCTIONS, dtype=np.int64).astype(K.U64) * K.U64(2) + K.U64(1)
ADDENDS = _rng.integers(0, 2**63, FUNCTIONS, dtype=np.int64).astype(K.U64)


def sets(data: np.ndarray, offs: np.ndarray, k: int):
    """For each row the sorted hashes of its distinct k-word shingles, letters A-Z folded, and 128 bits of the
    whole set: of its hashes and of those by a second, independent function."""
    starts, ends, at = K.words(data, offs, K.WORD_BYTES)
    both = [K.word_hashes(data, starts, ends, fold=True, seed=seed) for seed in (0, 1)]
    first, second = (K.chained(h, k) for h in both)
    for d in range(len(offs) - 1):
        a, e = at[d], at[d + 1]
        if e - a >= k:
            u, once = np.unique(first[a : e - k + 1], return_index=True)
            v = second[a : e - k + 1][once]
        else:  # fewer words than a shingle has: all of them are one, told apart by their number
            u, v = (K.chained(h[a:e], int(e - a)) if e > a else h[:0] for h in both)
        yield u, (_total(u), _total(v))


def _total(u: np.ndarray) -> int:
    return int(K.mix(K.mix(u + K.U64(0x632BE59BD9B4E019)).sum(keepdims=True) ^ K.U64(len(u))).view(np.int64)[0])


def shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The set itself, in words."""
    w = text.encode().lower().split()  # of bytes: ASCII letters and white space only
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def band_keys(u: np.ndarray) -> np.ndarray:
    low = np.full(FUNCTIONS, np.iinfo(K.U64).max, K.U64)
    high = np.zeros(FUNCTIONS, K.U64)
    for i in range(0, len(u), 4096):
        v = MULTIPLIERS[:, None] * u[None, i : i + 4096] + ADDENDS[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    key = np.arange(BANDS).astype(K.U64)
    for part in (low[0::2], high[0::2], low[1::2], high[1::2]):
        key = K.mix(key * K.U64(K.BASE) + part)
    return K.signed(key)


def _list(values: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=off[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int64, copy=False)))


def _signatures(k: int):
    def run(batches):
        for b in batches:
            n, one, two, bands = [], [], [], []
            for _, data, offs in K.pieces(b.column("text")):
                for u, (x, y) in sets(data, offs, k):
                    n.append(len(u))
                    one.append(x)
                    two.append(y)
                    bands.append(band_keys(u) if len(u) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tid"), *(pa.array(c, pa.int64()) for c in (n, one, two)), _list(bands)], names=["doc_id", "tid", "n", "s1", "s2", "bands"])

    return run


def whole_texts(nodes: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, text): the whole text of one document of each of some nodes."""
    ids = nodes.distinct().join(reps.select("node", "rep", "tid"), "node").select("node", F.col("rep").alias("k_id"), F.col("tid").alias("k_tid"))
    texts = docs.join(ids, (docs["tid"] == F.col("k_tid")) & docs["doc_id"].eqNullSafe(F.col("k_id")))
    return texts.select("node", "text").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose shingles have 100 * |intersection| >= percent * |union|, word for word."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        last, own = None, set()
        for batch in batches:
            keep = []
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True)):
                if a != last:  # pairs of one text mostly come together
                    last, own = a, shingles(x.as_py(), k)
                other = shingles(y.as_py(), k)
                shared = len(own & other)
                if shared * 100 >= (len(own) + len(other) - shared) * percent:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _spanning(k: int, percent: int):
    """Links between members of different components in one part of a bucket, as many as join them."""

    def run(table: pa.Table) -> pa.Table:
        node, comp = table.column("node").to_pylist(), table.column("comp").to_pylist()
        minor, texts = table.column("minor").to_pylist(), table.column("text").combine_chunks()
        full = [u for _, data, offs in K.pieces(texts) for u, _ in sets(data, offs, k)]
        size = np.array([len(u) for u in full])
        off = np.cumsum(size) - size
        vocabulary, word = np.unique(np.concatenate(full), return_inverse=True)
        root: dict[int, int] = {c: c for c in comp}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        mark, a, b = np.zeros(len(vocabulary), np.int32), [], []
        for x in range(len(node)):
            if not minor[x]:
                continue
            own = word[off[x] : off[x] + size[x]]
            mark[own] = 1
            shared = np.add.reduceat(mark[word], off)
            mark[own] = 0
            for y in np.flatnonzero(shared * 100 >= (size + size[x] - shared) * percent).tolist():
                r, t = find(comp[x]), find(comp[y])
                if r != t:
                    p, q = shingles(texts[x].as_py(), k), shingles(texts[y].as_py(), k)
                    if 100 * len(p & q) >= percent * len(p | q):
                        root[t] = r
                        a.append(node[x])
                        b.append(node[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of `edges` (a, b) reaches.

    Every round hangs each node to its least neighbour, follows two such steps, and contracts the edges.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "cc-edges")
    names = both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node"))
    while both.limit(1).count():
        up = both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        nxt = up.select(F.col("a").alias("to"), F.col("to").alias("far"))
        up = stored(up.join(nxt, "to").select("a", F.col("far").alias("to")), "cc-up")
        names = stored(names.join(up.withColumnRenamed("a", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "cc-names")
        at_b = up.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        both = both.join(up, "a").join(at_b, "b").select(F.col("to").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct()
        both = stored(both, "cc-edges")
    return names


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, tid (64 bits of its text), n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles.
    component_id is the least id reachable (nulls aside; null if a group has no other), kept tells
    whether it is the row's own. Null, empty and blank texts have no set and no links. Repeated rows
    are linked like any equal texts. Other columns of `docs` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    rows = stored(docs.mapInArrow(_signatures(k), "doc_id long, tid long, n long, s1 long, s2 long, bands array<long>"), "near-rows")
    reps = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "tid", "bands")).alias("r"), F.min("doc_id").alias("least"))
    # a node is a number of its own from here on, fixed where the table is written
    reps = reps.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", F.col("r.doc_id").alias("rep"), F.col("r.tid").alias("tid"), F.col("r.bands").alias("bands"), "least")
    reps = stored(reps, "near-reps")
    spread = reps.select("node", "n", F.explode("bands").alias("key"))
    # (center's set size rides along with its name; stored, so that a hot bucket's members are split among tasks)
    stars = spread.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    stars = stored(stars.select("key", F.col("c.node").alias("center"), F.col("c.n").alias("nc"), "m"), "near-stars")
    members = stored(spread.join(stars, "key"), "near-members")
    pairs = members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b"), F.col("nc").alias("na"), F.col("n").alias("nb")).distinct()
    pairs = stored(pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b"), "near-pairs")
    # every member of a bucket of three or more may be needed again below
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members.where("m > 2").select("node"))
    full = stored(whole_texts(wanted, docs, reps), "near-texts")
    edges = stored(confirmed(pairs, full, k, percent), "near-edges")
    names = components(edges)
    # what the stars can have missed: links between components that share a bucket of three or more
    known = members.where("m > 2").join(names, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    torn = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.max("c").alias("c"), F.sum("c").alias("m")).where("m > c")
    torn = stored(torn, "near-torn")
    rest = stored(known.join(torn, "key").select("key", "node", "comp", (F.col("comp") != F.col("major")).alias("minor"), "m", "c"), "near-rest")
    if rest.limit(1).count():
        # minor members are compared with all; both are dealt into parts, so that no task holds a whole large bucket
        part = lambda n: F.greatest(F.ceil(n / PART), F.lit(1)).cast("int")
        parts = rest.select("*", part(F.col("m") - F.col("c")).alias("pi"), part(F.col("m")).alias("pj"))
        own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        any_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = parts.where("pi = 1 and pj = 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "comp", "minor")
        many = parts.where("pi > 1 or pj > 1")
        both = one.union(many.where("minor").select("key", own("pi").alias("i"), any_of("pj").alias("j"), "node", "comp", "minor"))
        both = both.union(many.select("key", any_of("pi").alias("i"), own("pj").alias("j"), "node", "comp", F.lit(False).alias("minor")))
        more = both.join(full, "node").groupBy("key", "i", "j").applyInArrow(_spanning(k, percent), "a long, b long")
        names = components(edges.union(stored(more, "near-more")))
    comps = stored(reps.select("node", "s1", "s2", "n", "least").join(names, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near-comps")
    least = stored(comps.groupBy("comp").agg(F.min("least").alias("least")), "near-least")
    comps = stored(comps.select("s1", "s2", "n", "comp").join(least, "comp").select("s1", "s2", "n", "least"), "near-ids")
    own = rows.select("doc_id", "tid", "s1", "s2", "n").join(comps, ["s1", "s2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return own.select("doc_id", "tid", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the least id, with the columns of `docs`.

    Documents without a set stay. Of repeated rows of the kept id, one stays.
    """
    found = groups(docs, k, percent)
    one, two = fresh(docs, "near_key", "near_key2")
    row = lambda i, t: (F.xxhash64(i, i.isNull(), t).alias(one), F.xxhash64(F.lit("second"), t, i, i.isNull()).alias(two))
    kept = found.where("kept").select(*row(F.col("doc_id"), F.col("tid"))).distinct()
    mine = docs.select("*", *row(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    return mine.join(kept, [one, two]).dropDuplicates([one, two]).select(*(F.col(f"`{c}`") for c in docs.columns))
