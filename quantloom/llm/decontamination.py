"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one automaton (each item starts at the root). Training
words are streamed through it, tracking the longest match that ends at each word: a match of `window`
words or more means that a window of an item ends here, and an item of fewer words is met when the
match covers all of it. Only runs of neighbouring words that follow each other somewhere in the items
enter the automaton; elsewhere no match can be that long.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quantloom.llm import kernels as K
from quantloom.llm.common import extended, fresh, stored

WINDOW = 13
#: Least part of a document's words, one in so many, that hits must cover to make it contaminated.
ONE_IN = 20


class Automaton:
    """Suffix automaton of several word sequences (words are small numbers), frozen to flat arrays.

    Transitions are one sorted array of state * words + word beside their targets; the items of a state are kept
    where a window of `window` words is held, and items shorter than a window at the state that they end in.
    """

    def __init__(self, items: list[list[int]], n_words: int, window: int = WINDOW):
        self.window, self.n_words = window, n_words
        self._next: list[dict[int, int]] = [{}]
        link, size = [-1], [0]
        self._link, self._size = link, size
        for words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self._next)
        held: dict[int, set[int]] = {}
        self.ends_short: dict[int, list[int]] = {}
        for i, words in enumerate(items):
            state = 0
            for w in words:
                state = self._next[state][w]
                if size[state] >= window:
                    held.setdefault(self._holder(state, window), set()).add(i)
            if 0 < len(words) < window:
                self.ends_short.setdefault(self._holder(state, len(words)), []).append(i)
        self.items = {v: tuple(sorted(x)) for v, x in held.items()}
        self.short_len = array("i", [len(w) if len(w) < window else 0 for w in items])
        # the nearest state on the way to the root, itself included, at which a short item ends
        near = array("i", bytes(4 * n))
        for v in sorted(range(1, n), key=size.__getitem__):
            near[v] = v if v in self.ends_short else near[link[v]]
        edges = sorted((v * n_words + w, to) for v, out in enumerate(self._next) for w, to in out.items())
        self.keys, self.to = array("q", [k for k, _ in edges]), array("i", [t for _, t in edges])
        self.link, self.size, self.near = array("i", link), array("i", size), near
        del self._next, self._link, self._size

    def n_bytes(self) -> int:
        """About what it takes in memory."""
        flat = sum(len(x) * x.itemsize for x in (self.keys, self.to, self.link, self.size, self.near, self.short_len))
        return flat + sum(100 + 8 * len(x) for d in (self.items, self.ends_short) for x in d.values())

    def _holder(self, state: int, length: int) -> int:
        while self._size[self._link[state]] >= length:
            state = self._link[state]
        return state

    def _extend(self, last: int, w: int) -> int:
        nxt, link, size = self._next, self._link, self._size
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._split(last, w, q)
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, size = self._next, self._link, self._size
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def _step(self, state: int, w: int) -> int:
        """The target of a transition, or -1."""
        key = state * self.n_words + w
        at = bisect_left(self.keys, key)
        return self.to[at] if at < len(self.keys) and self.keys[at] == key else -1

    def matches(self, words: list[int]):
        """Yields (first word, end word, items) of windows met, by where they end."""
        state, length, window, link, size, near = 0, 0, self.window, self.link, self.size, self.near
        for i, w in enumerate(words):
            while (to := self._step(state, w)) < 0 and state:
                state = link[state]
                length = size[state]
            state, length = (to, length + 1) if to >= 0 else (0, 0)
            if length >= window:
                v = state
                while size[link[v]] >= window:
                    v = link[v]
                yield i + 1 - window, i + 1, self.items[v]
            v = state
            while (v := near[v]) > 0:
                for item in self.ends_short[v]:
                    if self.short_len[item] <= length:
                        yield i + 1 - self.short_len[item], i + 1, (item,)
                v = link[v]


def _words(texts: pa.Array) -> list[list[bytes]]:
    out: list[list[bytes]] = []
    for _, data, offs in K.pieces(texts):
        s, e, at = K.words(data, offs, K.ALNUM_BYTES)
        raw = K.LOWER[data].tobytes()
        every = [raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)]
        out += [every[at[d] : at[d + 1]] for d in range(len(offs) - 1)]
    return out


def _hashes(words: list[bytes], seed: int) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return K.word_hashes(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends, seed=seed)


class Screen:
    """An automaton of some items with the word and word-pair tables that keep most words from it. Broadcast as a whole.

    Texts' words are looked up by 64-bit hashes, for which the items' own words have different values (the seed is
    chosen so), and the words of every window met are compared byte by byte."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        vocabulary = sorted({w for _, ws in items for w in ws})
        self.seed = 0
        while len(np.unique(h := _hashes(vocabulary, self.seed) if vocabulary else np.zeros(0, K.U64))) < len(vocabulary):
            self.seed += 1
        order = np.argsort(h)
        self.hashes, self.vocabulary = h[order], [vocabulary[i] for i in order.tolist()]
        number = {w: i for i, w in enumerate(self.vocabulary)}
        coded = [[number[w] for w in ws] for _, ws in items]
        self.auto = Automaton(coded, max(len(vocabulary), 1), window)
        self.least = min([min(len(w), window) for w in coded if w], default=window)
        pairs = {x * len(vocabulary) + y for w in coded for x, y in zip(w, w[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.hashes >> K.U64(48)] = True
        self.names = [name for name, _ in items]

    def n_bytes(self) -> int:
        return self.auto.n_bytes() + self.hashes.nbytes + self.pairs.nbytes + sum(60 + len(w) for w in self.vocabulary) + 80 * len(self.names)

    @staticmethod
    def _place(x: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Where each x is in the sorted table, or -1."""
        if not len(table):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return np.where(table[at] == x, at, -1)

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray):
        """For each row with hits: hit word ranges (starts, ends) and the names of items met."""
        h = K.word_hashes(data, starts, ends, fold=True, seed=self.seed)
        word = np.full(len(h), -1)
        which = np.flatnonzero(self.maybe[h >> K.U64(48)])
        word[which] = self._place(h[which], self.hashes)
        known, n = word >= 0, len(h)
        # joined[i]: words i and i + 1 of one row follow each other in some item
        joined = np.zeros(n, bool)
        if n > 1:
            ok = known[:-1] & known[1:]
            edge = at[1:-1] - 1
            ok[edge[(edge >= 0) & (edge < n - 1)]] = False
            which = np.flatnonzero(ok)
            joined[which] = self._place(word[which] * len(self.vocabulary) + word[which + 1], self.pairs) >= 0
        first = known.copy()
        first[1:] &= ~joined[:-1]
        a, z = np.flatnonzero(first), np.flatnonzero(known & ~joined) + 1
        long = z - a >= self.least
        a, z = a[long], z[long]
        row = np.searchsorted(at, a, "right") - 1
        out: dict[int, tuple[list[int], list[int], set[str]]] = {}
        for s, e, d in zip(a.tolist(), z.tolist(), row.tolist(), strict=True):
            own = word[s:e].tolist()
            for x, y, items in self.auto.matches(own):
                there = (K.LOWER[data[starts[i] : ends[i]]].tobytes() for i in range(s + x, s + y))
                if all(w == self.vocabulary[own[x + i]] for i, w in enumerate(there)):
                    a0, b0, met = out.setdefault(d, ([], [], set()))
                    a0.append(s + x)
                    b0.append(s + y)
                    met.update(self.names[i] for i in items)
        return out


#: Bytes of item texts that one automaton is built of, and bytes of automata that are held at once.
PART_BYTES, HELD_BYTES = 2_000_000, 200_000_000


def screens(items: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> Iterator[Screen]:
    """Automata of `items` (item_id, text), each of about `part_bytes` of text: items are dealt by a hash of
    their id into as many parts as their bytes need, and one part at a time is gathered. An item of more than
    `part_bytes` makes a larger part."""
    named = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    total = named.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 0  # one row
    parts = total // part_bytes + 1
    named = named.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    for i in range(parts):
        got = named.where(F.col("part") == i).select("item_id", "text").toArrow()  # about part_bytes
        words = _words(got.column("text").cast(pa.large_string()))
        yield Screen(sorted(zip(got.column("item_id").to_pylist(), words, strict=True)), window)


def _batches_of(found: Iterator[Screen], held_bytes: int) -> Iterator[list[Screen]]:
    """Screens in lists of at most `held_bytes` (or one)."""
    own, size = [], 0
    for s in found:
        if own and size + s.n_bytes() > held_bytes:
            yield own
            own, size = [], 0
        own.append(s)
        size += s.n_bytes()
    yield own


def _met(shared, columns: list[str]):
    """Adds n_words, runs (hit word ranges, flat), flat (their byte ranges) and ids (items met) to `columns`."""

    def run(batches):
        for b in batches:
            n_words, runs, spans, ids = [], [], [], []
            for _, data, offs in K.pieces(b.column("text")):
                s, e, at = K.words(data, offs, K.ALNUM_BYTES)
                found = [screen.hits(data, s, e, at) for screen in shared.value]
                for d in range(len(offs) - 1):
                    n_words.append(int(at[d + 1] - at[d]))
                    own = [f[d] for f in found if d in f]
                    a, z = K.union_runs(np.array([x for o in own for x in o[0]], np.int64), np.array([x for o in own for x in o[1]], np.int64))
                    runs.append((np.stack([a, z], axis=1) - at[d]).ravel().tolist())
                    spans.append((np.stack([s[a], e[z - 1]], axis=1) - offs[d]).ravel().tolist())
                    ids.append(sorted(set().union(*(o[2] for o in own))))
            ints = pa.list_(pa.int32())
            new = [pa.array(n_words, pa.int64()), pa.array(runs, ints), pa.array(spans, ints), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *new], names=[*columns, *_FOUND])

    return run


def _placed(batches):
    """Adds dc_words and dc_spans to rows with text and dc_runs."""
    for b in batches:
        n_words, spans, runs = [], [], b.column("dc_runs").to_pylist()
        for row, data, offs in K.pieces(b.column("text")):
            s, e, at = K.words(data, offs, K.ALNUM_BYTES)
            for d in range(len(offs) - 1):
                n_words.append(int(at[d + 1] - at[d]))
                a, z = (np.array((runs[row + d] or [])[i::2], np.int64) + at[d] for i in (0, 1))
                spans.append((np.stack([s[a], e[z - 1]], axis=1) - offs[d]).ravel().tolist())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], names=[*b.schema.names, "dc_words", "dc_spans"])


_FOUND = {"dc_words": "long", "dc_runs": T.ArrayType(T.IntegerType()), "dc_spans": T.ArrayType(T.IntegerType()), "dc_ids": T.ArrayType(T.StringType())}


def _joined(flat: Column) -> Column:
    """Ranges (start, end, start, end, ...) of several lists, as one flat list of disjoint ranges that rise."""
    pairs = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(flat), 1) - 1), lambda i: F.struct(F.get(flat, 2 * i).alias("s"), F.get(flat, 2 * i + 1).alias("e")))
    none = F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.greatest(last, x["e"])))
        return F.when((F.size(acc) > 0) & (x["s"] <= last), grown).otherwise(F.concat(acc, F.array(x["s"], x["e"])))

    safe = F.when(F.size(flat) > 0, F.array_sort(pairs)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    return F.aggregate(safe, none, step)


def _or_empty(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<int>"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, spans: bool = False, part_bytes: int = PART_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to `docs` (such columns are replaced).

    Null and empty texts have no words; texts of any length are streamed whole. An empty list of items hits
    nothing. Items of one id count as one item; items without an id are left out. Repeated rows get equal
    answers. spans: also `hit_spans`, byte ranges [start, end) of hit words in flat order, from a hit's first word
    to its last. Items of over `part_bytes` are screened in parts, as many automata at once as `held_bytes`
    hold; each pass over `docs` writes only the rows that it hits, and passes are joined by id and text.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", *_FOUND)
    context = docs.sparkSession.sparkContext
    groups = _batches_of(screens(items, window, part_bytes), held_bytes)
    first, second = next(groups), next(groups, None)
    if second is None:  # one pass does
        seen = docs.mapInArrow(_met(context.broadcast(first), docs.columns), extended(docs.schema, **_FOUND))
    else:
        one, two = fresh(docs, "dc_key", "dc_key2")
        keys = (F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias(one), F.xxhash64(F.lit("second"), "text", "doc_id").alias(two))
        docs = docs.select("*", *keys)
        slim, hits = docs.select(one, two, "text").distinct(), None
        for group in chain([first, second], groups):
            found = slim.mapInArrow(_met(context.broadcast(group), [one, two]), extended(docs.select(one, two).schema, **_FOUND))
            found = stored(found.where(F.size("dc_ids") > 0), "contamination-part")
            hits = found if hits is None else hits.union(found)
        whole = lambda c: F.flatten(F.collect_list(c))
        hits = hits.groupBy(one, two).agg(whole("dc_runs").alias("dc_runs"), F.array_sort(F.array_distinct(whole("dc_ids"))).alias("dc_ids"))
        hits = stored(hits.withColumn("dc_runs", _joined(F.col("dc_runs"))), "contamination-hits")
        docs = docs.join(hits, [one, two], "left").drop(one, two)
        seen = docs.mapInArrow(_placed, extended(docs.schema, dc_words="long", dc_spans=_FOUND["dc_spans"]))
    runs, ids = _or_empty(F.col("dc_runs")), F.coalesce("dc_ids", F.array().cast("array<string>"))
    hit = F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x).cast("long")
    out = seen.withColumn("n_words", F.col("dc_words")).withColumn("n_hit", hit).withColumn("n_items", F.size(ids).cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join(ids, ",").cast("binary"), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words")))
    if spans:
        out = out.withColumn("hit_spans", _or_empty(F.col("dc_spans")))
    return out.drop(*_FOUND)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without contaminated documents (hits cover one word in 20 or more), and with the hit spans of
    the others, each at least an item's window long, cut out of their texts. Texts without hits stay
    as they are; n_chars, if there is such a column, is counted anew where a text was cut."""
    slim, (mark, key) = docs.columns, fresh(docs, "cut_text", "cut_spans")
    judged = contamination(docs.select(F.struct(*slim).alias(key), F.col("text")), items, window, spans=True).where(~F.col("contaminated"))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, flat in enumerate(b.column("hit_spans").to_pylist()):
                if flat:
                    raw, at, kept = texts[i].encode(), 0, []
                    for s, e in zip(flat[::2], flat[1::2], strict=True):
                        kept.append(raw[at:s])
                        at = e
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("n_hit"), pa.array(texts, pa.string())], names=[key, "n_hit", mark])

    schema = T.StructType([T.StructField(key, docs.select(F.struct(*slim)).schema[0].dataType), T.StructField("n_hit", T.LongType()), T.StructField(mark, T.StringType())])
    out = judged.select(key, "n_hit", "text", "hit_spans").mapInArrow(run, schema)
    new = {"text": F.col(mark), "n_chars": F.when(F.col("n_hit") > 0, F.char_length(mark)).otherwise(F.col(f"{key}.n_chars"))} if "n_chars" in slim else {"text": F.col(mark)}
    return out.select(*(new.get(c, F.col(f"{key}.`{c}`")).alias(c) for c in slim))
