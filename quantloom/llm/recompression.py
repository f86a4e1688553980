"""Substring deduplication by recompression.

Words are named first: a Spark round counts every word of the collection, and each that occurs more than once gets a
number, its name. Every further round takes maximal runs of one symbol together, splits all symbols in two sides, and
names the pairs of a left symbol and a right one that follow each other: a Spark round counts all different pairs of
the collection, and each that occurs more than once gets a new name from the table that this round writes. Names are
numbers given to what they stand for, never hashes of it, so one name has one meaning, and equal passages get equal
symbols apart from their edges. A word or pair that occurs once gets no name, and no window that holds it is repeated.

Each symbol keeps the range of words that its parse depended on. A window's anchor is the symbol of the highest round
whose range lies wholly in the window (of several, the one of least hashed name), so equal windows have equal anchors at
equal places: shared high symbols reveal candidates. Where all stretches about a symbol are equal they are repeats;
where they differ, the words of whole windows decide.

Rounds work on the parts of texts in which repeats can be: windows whose least 12-word gram occurs more than once, which
holds for every repeated window. They are dealt to blocks of many parts, and the state of a block is bucketed by its
number, so that a round shuffles candidates and names only.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quantloom.llm import kernels as K
from quantloom.llm.common import discard, shared_dir, stored
from quantloom.llm.repeats import NAMES, RECORD, UID, Repeats, covered, prepared

WINDOW, GRAM = 35, 12
#: Rounds of pairs. A round leaves about 3/4 of the symbols; after these most windows hold a few. More would shorten
#: comparisons and change no result.
ROUNDS = 3
#: Parts of a block at most: it has 131,072 words, a part 35 or more.
PARTS = 1 << 12
#: Words of a block, and bytes of state for a bucket.
BLOCK, BUCKET = 1 << 17, 1 << 24


def _sequence(data: np.ndarray, offs: np.ndarray):
    """For parts of texts, whose words stand one space apart: a range of words is a range of bytes."""
    s, e, at = K.words(data, offs, K.WORD_BYTES)
    raw, s, e = data.tobytes(), s.tolist(), e.tolist()
    cut = lambda i, j: raw[s[i] : e[j - 1]]
    return at, cut, cut


def _gram_hashes(h: np.ndarray) -> np.ndarray:
    """64 bits for every GRAM words in a row, from those of two, four and eight; they only propose."""
    two = lambda x, k: K.mix(x[: max(len(x) - k, 0)] * K.U64(2 * k + 1) + x[k:])
    g2 = two(h, 1)
    g4 = two(g2, 2)
    g8 = two(g4, 4)
    m = max(len(h) - GRAM + 1, 0)
    return K.mix(g8[:m] * K.U64(3) + g4[8 : 8 + m])


# --- where repeats can be -------------------------------------------------------------------------


def _grams(batches):
    """From (u1, u2, text): the least gram of every window, once for neighbouring windows that share it."""
    for b in batches:
        uid, cols = [b.column(u).to_numpy() for u in UID], [[], [], [], [], []]
        for row, data, offs in K.pieces(b.column("text")):
            s, e, at = K.words(data, offs, K.WORD_BYTES)
            if len(s) < WINDOW:
                continue
            gram = _gram_hashes(K.word_hashes(data, s, e))
            # place and all: windows that share a gram at one place are neighbours, at two places they are repeats
            least = K.sliding_min((gram >> K.U64(32) << K.U64(32)) | np.arange(len(gram), dtype=K.U64), WINDOW - GRAM + 1)
            valid = np.zeros(len(least) + 1, bool)
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if y - x >= WINDOW:
                    valid[x : y - WINDOW + 1] = True
            change = least[1:] != least[:-1]
            first, last = valid[:-1].copy(), valid[:-1].copy()
            first[1:] &= ~valid[:-2] | change
            last[:-1] &= ~valid[1:-1] | change
            p0, p1 = np.flatnonzero(first), np.flatnonzero(last) + 1
            d = np.searchsorted(at, p0, "right") - 1
            for c, v in zip(cols, (uid[0][row + d], uid[1][row + d], K.signed(gram[(least[p0] & K.U64(0xFFFFFFFF)).astype(np.int64)]), p0 - at[d], p1 - at[d]), strict=True):
                c.append(v)
        out = [np.concatenate(c).astype(np.int64 if i < 3 else np.int32) if c else np.zeros(0, np.int64 if i < 3 else np.int32) for i, c in enumerate(cols)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[*UID, "key", "p0", "p1"])


def _blocks(batches):
    """From (u1, u2, text, marks, times): blocks of the parts that marks cover, their words joined by one space."""
    own, size = [], 0

    def flush():
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        cols = [pa.array([[p[i] for p in own]], longs if i < 2 else ints) for i in range(5)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([b" ".join([p[5] for p in own])], pa.binary())], names=[*UID, "w0", "n", "times", "words"])

    for b in batches:
        u1, u2, times, marks = (b.column(c).to_pylist() for c in (*UID, "times", "marks"))
        for row, data, offs in K.pieces(b.column("text")):
            s, e, at = K.words(data, offs, K.WORD_BYTES)
            raw = data.tobytes()
            for d in range(len(offs) - 1):
                i = row + d
                for x, y in zip(*(v.tolist() for v in covered(marks[i], WINDOW)), strict=True):
                    part = slice(at[d] + x, at[d] + y)
                    own.append((u1[i], u2[i], x, y - x, min(times[i], 2), b" ".join([raw[p:q] for p, q in zip(s[part].tolist(), e[part].tolist(), strict=True)])))
                    size += y - x
                    if size >= BLOCK:
                        yield flush()
                        own, size = [], 0
    if own:
        yield flush()


# --- rounds ---------------------------------------------------------------------------------------

#: Arrays of a block. n and times: words and copies of each part; left: its symbols; the next four for each symbol, the
#: last two for each word.
_KINDS = {"n": np.int32, "times": np.int32, "left": np.int32, "name": np.int64, "count": np.int32, "ca": np.int32, "cb": np.int32, "akey": np.int64, "reach": np.uint8}
_STATE = tuple(_KINDS)


class Block:
    """Symbols of one block: names (0: none), run lengths, the words [ca, cb) that each depends on; for every word the
    key and distance of the anchor of the window that starts there (key 0: no window that can be repeated)."""

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def of_words(cls, n: np.ndarray, times: np.ndarray, name: np.ndarray) -> Block:
        size, ends = int(n.sum()), np.cumsum(n)
        at = np.arange(size)
        akey = (np.repeat(ends, n) - at >= WINDOW).astype(np.int64)
        own = cls(n=n, times=times, left=n, name=name, count=np.ones(size, np.int32), ca=at, cb=at + 1, akey=akey, reach=np.zeros(size, np.uint8))
        own.part = np.repeat(np.arange(len(n)), n)
        own.anchor(0)
        return own

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> Block:
        own = cls(**{c: np.frombuffer(batch.column(c)[i].as_buffer(), _KINDS[c]) for c in _STATE})
        own.part = np.repeat(np.arange(len(own.n)), own.left)
        return own

    def row(self) -> list[bytes]:
        self.left = np.bincount(self.part, minlength=len(self.n))
        return [np.ascontiguousarray(getattr(self, c), _KINDS[c]).tobytes() for c in _STATE]

    def _side(self, salt: int) -> np.ndarray:
        return K.mix(self.name.view(K.U64) * K.U64(2 * salt + 3) + self.count.astype(K.U64))

    def anchor(self, level: int) -> None:
        """Gives every window the best symbol whose range lies in it, and ends windows that hold one without a name."""
        p = np.flatnonzero(self.akey)
        lo = np.searchsorted(self.ca, p)
        hi = np.searchsorted(self.cb, p + WINDOW, "right") - 1
        some = lo <= hi
        p, lo, hi = p[some], lo[some], hi[some]
        if not len(p):
            return
        dead = np.cumsum(np.append(0, self.name == 0))
        lost = dead[hi + 1] > dead[lo]
        akey, reach = self.akey.copy(), self.reach.copy()
        akey[p[lost]] = 0
        p, lo, hi = p[~lost], lo[~lost], hi[~lost]
        if len(p):
            v = self._side(101)
            best = _range_argmin(v, lo, hi)
            akey[p] = K.signed(K.mix(v + K.U64(level)) | K.U64(1))[best]
            reach[p] = self.ca[best] - p
        self.akey, self.reach = akey, reach

    def collapse(self) -> None:
        """Takes runs of one name together."""
        part, name, ca, cb = self.part, self.name, self.ca, self.cb
        edge = np.ones(len(name), bool)
        edge[1:] = part[1:] != part[:-1]
        begin = edge.copy()
        begin[1:] |= (name[1:] != name[:-1]) | (name[1:] == 0)
        b = np.flatnonzero(begin)
        z = np.append(b[1:], len(name)) - 1
        first, last = edge[b], np.append(edge[b[1:]], True)
        before = np.where(first, ca[b] - 1, ca[np.maximum(b - 1, 0)])
        after = np.where(last, cb[z] + 1, cb[np.minimum(z + 1, len(name) - 1)])
        self.ca, self.cb = np.minimum(ca[b], before), np.maximum(cb[z], after)
        self.count = np.add.reduceat(self.count, b) if len(b) else self.count[:0]
        self.name, self.part = name[b], part[b]

    def pairs(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where a left symbol is followed by a right one (flags), the sides of all symbols, and the different pairs
        (names and run lengths) with the number of each joined one's."""
        part = self.part
        right = (self._side(level) >> K.U64(17) & K.U64(1)).astype(bool)
        joined = np.zeros(len(self.name), bool)
        if len(joined) > 1:
            joined[:-1] = ~right[:-1] & right[1:] & (part[1:] == part[:-1]) & (self.name[:-1] > 0) & (self.name[1:] > 0)
            # only pairs whose range lies in a window that can still be repeated: no other is an anchor or ends a window
            k = np.flatnonzero(joined)
            ca, cb = np.minimum(self.ca[k], self.ca[k + 1]), np.maximum(self.cb[k], self.cb[k + 1])
            alive, size = np.cumsum(np.append(0, self.akey != 0)), len(self.akey)
            joined[k] = (ca >= 0) & (alive[np.clip(ca + 1, 0, size)] > alive[np.clip(cb - WINDOW, 0, size)])
        k = np.flatnonzero(joined)
        kinds, code = np.unique(self.name, return_inverse=True)
        lengths, size = np.unique(self.count, return_inverse=True)
        both = code * len(lengths) + size  # symbols of one name and run length
        pairs, which = np.unique(both[k] * (len(kinds) * len(lengths)) + both[k + 1], return_inverse=True)
        l, r = np.divmod(pairs, max(len(kinds) * len(lengths), 1))
        parts = [x for v in (l, r) for x in np.divmod(v, max(len(lengths), 1))]
        return joined, right, np.stack([kinds[parts[0]], lengths[parts[1]], kinds[parts[2]], lengths[parts[3]]], axis=1).astype(np.int64), which

    def merge(self, joined: np.ndarray, right: np.ndarray, names: np.ndarray) -> None:
        """Replaces joined pairs by symbols of the given names."""
        part, second = self.part, np.zeros(len(joined), bool)
        second[1:] = joined[:-1]
        first, last = np.ones(len(part), bool), np.ones(len(part), bool)
        first[1:] = part[1:] != part[:-1]
        last[:-1] = first[1:]
        prev_ca = np.where(first, self.ca - 1, np.append(0, self.ca[:-1]))
        next_cb = np.where(last, self.cb + 1, np.append(self.cb[1:], 0))
        # a left symbol depends on what follows it, a right one on what comes before
        la, lb = np.where(right, np.minimum(self.ca, prev_ca), self.ca), np.where(right, self.cb, np.maximum(self.cb, next_cb))
        k = np.flatnonzero(~second)
        both, nxt = joined[k], np.minimum(k + 1, len(joined) - 1)
        name = self.name[k].copy()
        name[both] = names
        ca, cb = np.where(both, np.minimum(la[k], self.ca[nxt]), la[k]), np.where(both, np.maximum(self.cb[k], self.cb[nxt]), lb[k])
        self.name, self.count, self.ca, self.cb, self.part = name, np.where(both, 1, self.count[k]), ca, cb, part[k]


def _range_argmin(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least v in [lo, hi], ranges not empty; the first of several."""
    span = hi - lo + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out, t = np.empty(len(lo), np.int64), np.arange(len(v))
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        if len(at):
            a, b = t[lo[at]], t[hi[at] - (1 << k) + 1]
            out[at] = np.where(v[b] < v[a], b, a)
        if len(t) > 1 << k:
            a, b = t[: -(1 << k)], t[1 << k :]
            t = np.where(v[b] < v[a], b, a)
    return out


def _ints(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return batch.column(column)[i].values.to_numpy(zero_copy_only=False)


def _distinct_words(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    known: dict[bytes, int] = {}
    words = raw.split(b" ")
    which = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return list(known), which


def _word_candidates(batches):
    """From blocks: their different words, and how often each occurs."""
    for b in batches:
        for r, block in enumerate(b.column("block").to_pylist()):
            words, which = _distinct_words(b.column("words")[r].as_py())
            often = np.bincount(which, weights=np.repeat(_ints(b, "times", r), _ints(b, "n", r)), minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(words, pa.binary()), pa.array(often)], names=["block", "i", "word", "often"])


def _names(batch: pa.RecordBatch, r: int, size: int) -> np.ndarray:
    """Names by number of candidate (0: none)."""
    out, got = np.zeros(size, np.int64), batch.column("got")[r].values
    if got is not None and len(got):
        out[got.field("i").to_numpy()] = got.field("id").to_numpy()
    return out


def _state_batch(block: int, own: Block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([c], pa.binary()) for c in own.row())], names=["block", *_STATE])


def _first_state(batches):
    """From blocks with the names of their words (got): the state before the first round."""
    for b in batches:
        for r, block in enumerate(b.column("block").to_pylist()):
            words, which = _distinct_words(b.column("words")[r].as_py())
            yield _state_batch(block, Block.of_words(_ints(b, "n", r), _ints(b, "times", r), _names(b, r, len(words))[which]))


def _pair_candidates(level: int):
    def run(batches):
        """From the state: each block's different pairs, and how often each occurs."""
        for b in batches:
            for r, block in enumerate(b.column("block").to_pylist()):
                own = Block.read(b, r)
                own.collapse()
                joined, _, unique, which = own.pairs(level)
                often = np.bincount(which, weights=own.times[own.part[joined]], minlength=len(unique)).astype(np.int32)
                pair = (c.astype(np.int32) if i % 2 else c for i, c in enumerate(unique.T))
                cols = [np.full(len(unique), block), np.arange(len(unique), dtype=np.int32), *pair, often]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["block", "i", *_PAIR, "often"])

    return run


_PAIR = ["ln", "lc", "rn", "rc"]


def _next_state(level: int):
    def run(batches):
        """From the state with the names of its pairs (got): the state after the round."""
        for b in batches:
            for r, block in enumerate(b.column("block").to_pylist()):
                own = Block.read(b, r)
                own.collapse()
                joined, right, unique, which = own.pairs(level)
                own.merge(joined, right, _names(b, r, len(unique))[which])
                own.anchor(level)
                yield _state_batch(block, own)

    return run


def _parts(batches):
    """From blocks: their parts as texts of their own."""
    for b in batches:
        for r, block in enumerate(b.column("block").to_pylist()):
            raw, n = b.column("words")[r].as_py(), _ints(b, "n", r)
            s, e, _ = K.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), K.WORD_BYTES)
            z = np.cumsum(n)
            texts = [raw[x:y].decode() for x, y in zip(s[z - n].tolist(), e[z - 1].tolist(), strict=True)]
            rid = block * PARTS + np.arange(len(texts))
            cols = [pa.array(rid), pa.array(rid), pa.array(np.zeros(len(texts), np.int64)), pa.array(texts, pa.string()), *(pa.array(_ints(b, c, r)) for c in ("times", *UID, "w0"))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "u1", "u2", "text", "times", "d1", "d2", "w0"])


def _records(batches):
    """From blocks with their final anchors: fragments, in words of their part, once for each occurrence of the part."""
    for b in batches:
        for r, block in enumerate(b.column("block").to_pylist()):
            words, n = b.column("words")[r].as_py(), _ints(b, "n", r).astype(np.int64)
            akey, reach = (np.frombuffer(b.column(c)[r].as_buffer(), _KINDS[c]) for c in ("akey", "reach"))
            data = np.frombuffer(words, np.uint8)
            s, e, _ = K.words(data, np.array([0, len(data)]), K.WORD_BYTES)
            first = np.cumsum(n) - n
            part, abeg = np.repeat(np.arange(len(n)), n), np.arange(len(akey)) + reach
            new, last = akey != 0, akey != 0
            edge = (akey[1:] != akey[:-1]) | (abeg[1:] != abeg[:-1]) | (part[1:] != part[:-1])
            new[1:] &= edge
            last[:-1] &= edge
            p0, p1 = np.flatnonzero(new), np.flatnonzero(last) + 1
            a, d = abeg[p0], part[p0]
            raw = [K.digest(words[x:y] + b"|%d" % z) for x, y, z in zip(s[p0].tolist(), e[p1 + WINDOW - 2].tolist(), (p0 - a).tolist(), strict=True)]
            both = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
            copies = np.repeat(np.arange(len(p0)), _ints(b, "times", r)[d])
            cols = [block * PARTS + d, np.zeros(len(d), np.int64), akey[p0], both[:, 0], both[:, 1], a - first[d], p0 - first[d], p1 - first[d]]
            yield pa.RecordBatch.from_arrays([pa.array(c[copies].astype(np.int64 if i < 5 else np.int32)) for i, c in enumerate(cols)], names=NAMES)


class _Buckets:
    """Tables of blocks, bucketed by block number in the shared folder, so that joins by it move only the other side."""

    def __init__(self, spark, count: int):
        self.spark, self.count, self.names = spark, count, []

    def stored(self, df: DataFrame) -> DataFrame:
        name = f"recompression_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/quantloom-{self.spark.sparkContext.applicationId}/{name}"
        df.write.bucketBy(self.count, "block").option("path", path).format("parquet").saveAsTable(name)
        self.names.append((name, path))
        return self.spark.table(name)

    def drop(self, keep: int = 0) -> None:
        """Drops all tables but the last `keep`, with their files: the next round reads none of them."""
        for name, path in self.names[: len(self.names) - keep]:
            self.spark.sql(f"drop table if exists {name}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.names = self.names[len(self.names) - keep :]


_STATE_SCHEMA = "block long, " + ", ".join(f"{c} binary" for c in _STATE)


def _named(candidates: DataFrame, keys: list[str], level: int) -> DataFrame:
    """(block, got): the names of each block's candidates (stored). A key that occurs more than once in the collection
    gets a number of its own, fixed where the table of names is written."""
    names = candidates.groupBy(*keys).agg(F.sum("often").alias("often")).where("often > 1")
    names = stored(names.select(*keys, (F.monotonically_increasing_id() + F.lit((level << 56) + 1)).alias("id")), f"names-{level}")
    return candidates.select("block", "i", *keys).join(names, keys).groupBy("block").agg(F.collect_list(F.struct("i", "id")).alias("got"))


def tidy(kernel):
    """The kernel, with Arrow's free memory given back after each batch: workers live on between stages."""

    def run(batches):
        for out in kernel(batches):
            yield out
            pa.default_memory_pool().release_unused()

    return run


def block_number(row: Column) -> Column:
    """A smaller number for a row number that has the partition above its lowest 33 bits: a partition has at most 2^17 blocks, and a
    block at most PARTS parts (a part has WINDOW words or more), so that with the part's number it has 60 bits."""
    return F.shiftright(row, 33) * (1 << 17) + row.bitwiseAND((1 << 33) - 1)


def fragments(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Parts of texts as a table of texts of their own (doc_id, u1, u2, text, times; d1, d2, w0: where they come
    from), and the records of their fragments by anchors. docs: doc_id, u1, u2, text."""
    spark = docs.sparkSession
    # copies of a text are one text here, with their number
    grams = docs.select(*UID, "text").mapInArrow(tidy(_grams), "u1 long, u2 long, key long, p0 int, p1 int")
    shared = stored(grams.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "grams")
    pack = F.shiftleft(F.col("p0").cast("long"), 32) + F.col("p1")
    marks = grams.join(shared, "key").groupBy(*UID).agg(F.collect_set(pack).alias("marks"))
    reps = docs.groupBy(*UID).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).cast("int").alias("times"))
    own = marks.join(reps, UID).select(F.col("u1").alias("m1"), F.col("u2").alias("m2"), "rep", "times", "marks")
    own = stored(own, "gram-marks")  # so that a hot text's rows are split among tasks in the join below
    same = (docs["u1"] == F.col("m1")) & (docs["u2"] == F.col("m2")) & docs["doc_id"].eqNullSafe(F.col("rep"))
    texts = docs.join(own.hint("shuffle_hash"), same)
    blocks = texts.select(*UID, "text", "marks", "times").mapInArrow(tidy(_blocks), "u1 array<long>, u2 array<long>, w0 array<int>, n array<int>, times array<int>, words binary")
    blocks = stored(blocks.select(block_number(F.monotonically_increasing_id()).alias("block"), "*"), "blocks")
    size = blocks.agg(F.sum(F.length("words")).alias("n")).first()["n"] or 0  # one row
    buckets = _Buckets(spark, max(spark.sparkContext.defaultParallelism, min(20_000, size * 6 // BUCKET + 1)))
    candidates = stored(blocks.mapInArrow(tidy(_word_candidates), "block long, i int, word binary, often long"), "candidates-0")
    words = _named(candidates, ["word"], 0)
    state = blocks.join(words.hint("shuffle_hash"), "block", "left").select("block", "n", "times", "words", "got")
    state = buckets.stored(state.mapInArrow(tidy(_first_state), _STATE_SCHEMA).repartition(buckets.count, "block"))
    discard(candidates)
    for level in range(1, rounds + 1):
        # stored, as they are read twice: to be counted and to be named
        candidates = stored(state.mapInArrow(tidy(_pair_candidates(level)), "block long, i int, ln long, lc int, rn long, rc int, often int"), f"candidates-{level}")
        got = _named(candidates, _PAIR, level)
        joined = state.join(got.hint("shuffle_hash"), "block", "left")
        state = buckets.stored(joined.mapInArrow(tidy(_next_state(level)), _STATE_SCHEMA))
        buckets.drop(keep=1)
        discard(candidates)
    final = state.select("block", "akey", "reach").join(blocks.select("block", "n", "times", "words"), "block")
    records = stored(final.mapInArrow(tidy(_records), RECORD), "records")
    buckets.drop()
    return stored(blocks.mapInArrow(tidy(_parts), "doc_id long, u1 long, u2 long, text string, times int, d1 long, d2 long, w0 int"), "parts"), records


def verified(fragments: list[tuple[int, bytes, int]], window: int = WINDOW) -> list[np.ndarray]:
    """For each (place, words, copies): which of its windows occur again, word for word, in it or in another."""
    known: dict[bytes, int] = {}
    symbols = [np.array([known.setdefault(w, len(known)) for w in raw.split(b" ")], np.int32) for _, raw, _ in fragments]
    n = [max(len(s) - window + 1, 0) for s in symbols]
    flat = np.concatenate(symbols)
    base = np.cumsum([0, *(len(s) for s in symbols[:-1])])
    start = np.concatenate([b + np.arange(k) for b, k in zip(base.tolist(), n, strict=True)])
    copies = np.repeat([k for *_, k in fragments], n)
    name = K.chained(K.mix(flat.astype(K.U64) + K.U64(1)), window)[start] if len(start) else np.zeros(0, K.U64)
    order = np.argsort(name, kind="stable")
    srt, head = name[order], np.ones(len(order), bool)
    alike = np.flatnonzero(srt[1:] == srt[:-1]) + 1
    differ = False
    for i in range(0, len(alike), 20_000):  # the words themselves decide
        own = alike[i : i + 20_000]
        x, y = (flat[start[order[at]][:, None] + np.arange(window)] for at in (own, own - 1))
        equal = (x == y).all(axis=1)
        head[own[equal]] = False
        differ = differ or not equal.all()
    if differ:  # different windows of one name lie between equal ones
        order = np.lexsort(flat[start[:, None] + np.arange(window)].T[::-1])
        rows = flat[start[order][:, None] + np.arange(window)]
        head = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    group = np.cumsum(head) - 1
    total = np.bincount(group, weights=copies[order]) if len(order) else np.zeros(0)
    out = np.zeros(len(order), bool)
    out[order] = total[group] > 1
    return np.split(out, np.cumsum(n)[:-1])


#: Fragments come from the rounds above, so there is no function of one text that finds anchors.
REPEATS = Repeats(WINDOW, _sequence, None, verified, (12, 4, 1), 0, WINDOW)


def deduplicated(docs: DataFrame, repeats: Repeats = REPEATS, rounds: int = ROUNDS) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept_sha256, kept (the remaining words, one space between).

    Every word that a window of 35 words covers whose words also start elsewhere, in any row, is
    removed; windows are judged on the input. Null and blank texts have no words; texts under 35 words
    keep theirs; repeated rows of 35 words or more lose all; very long texts count whole, and an empty table gives
    no rows. Other columns are not read.
    """
    length, docs = repeats.length, prepared(docs)

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            marks = b.column("marks").to_pylist()
            for row, data, offs in K.pieces(b.column("text")):
                raw = data.tobytes()
                for d in range(len(offs) - 1):
                    words = raw[offs[d] : offs[d + 1]].split()  # of bytes: at ASCII white space only
                    n = len(words)
                    for i, j in reversed(list(zip(*(x.tolist() for x in covered(marks[row + d], length)), strict=True))):
                        del words[i:j]
                    kept = b" ".join(words)
                    for col, v in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    parts, records = fragments(docs, rounds)
    found = repeats.starts(parts.select("doc_id", *UID, "text", "times"), records)
    at = parts.select("u1", "u2", "d1", "d2", "w0")
    starts = found.join(at, UID).select(F.col("d1").alias("u1"), F.col("d2").alias("u2"), (F.col("p0") + F.col("w0")).alias("p0"), (F.col("p1") + F.col("w0")).alias("p1"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return repeats.marked(docs, starts).select("doc_id", "text", "marks").mapInArrow(run, schema)
