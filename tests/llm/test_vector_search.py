"""Nearest neighbours (11), periodic runs (12) and hard negatives (13) against brute force, on the given and on odd tables."""

import hashlib
import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quantloom.llm import hard_negatives, periodic_runs, prefix_forest
from quantloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
Q = {int(k[2:].split("_")[0]): f for k, f in QUERIES.items()}
VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("score", pa.int32()), ("Key", pa.string()), ("list", pa.int32())])
SMALL_TABLE = "vec_id long, embedding array<float>, label int"


def write(folder, name, rows, schema):
    pq.write_table(pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in schema], schema=schema), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd_vectors(tmp_path_factory):
    """Copies (a third of all), scaled copies, ties, nulls, zeros, other lengths, repeated rows and ids, clashing names."""
    rng, rows = np.random.default_rng(3), []
    hot = rng.integers(-3, 4, 8) / 4.0
    for i in range(0, 600):
        v = hot if i % 3 == 0 else rng.integers(-2, 3, 8) / 4.0
        rows.append((i, v.tolist(), int(rng.integers(0, 3)) if i % 3 else 1 + (i % 2)))
    rows += [rows[50], rows[100], (7, [0.5] * 8, 1), (1000, (hot * 2).tolist(), 1), (1050, None, 1), (1100, [0.0] * 8, 2), (1150, [1.0, None] * 4, 2), (1200, [float("nan")] * 8, 0), (1250, [float("inf")] + [1.0] * 7, 0)]
    rows += [(1300, [1.0] * 5, 1), (1400, [], 1), (None, [1.0] * 8, 1), (1500, [0.25] * 8, None), (-100, [0.25] * 8, 2), (-50, rng.normal(size=8).tolist(), 0)]
    return write(tmp_path_factory.mktemp("vectors"), "embeddings", [(*r, 5, "x", 2) for r in rows], VECTORS)


def rows_of(d):
    return pq.read_table(f"{d}/embeddings.parquet").to_pylist()


def usable(rows, label=False):
    """id -> (label, vector): finite vectors of the commonest length, one row an id."""
    ok = [(r["vec_id"], r["label"] if label else 0, r["embedding"]) for r in rows if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]) and (not label or r["label"] is not None)]
    if label:
        ok = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(x * 256) for x in v]) for i, y, v in ok]
    one = {}
    for i, y, v in ok:
        one[i] = min(one.get(i, (y, v)), (y, v))
    n = defaultdict(int)
    for _, v in one.values():
        n[len(v)] += 1
    best = max(n, key=lambda k: (n[k], k))
    return {i: (y, np.array(v, float)) for i, (y, v) in one.items() if len(v) == best}


@pytest.mark.parametrize("d", [SMALL, "odd"])
def test_op11_finds_the_nearest(spark, odd_vectors, d):
    d = odd_vectors if d == "odd" else d
    vecs = {i: v for i, (_, v) in usable(rows_of(d)).items() if v.any()}
    ids = np.array(sorted(vecs))
    x = np.stack([vecs[i] for i in ids])
    got, hit, want_n = defaultdict(list), 0, 0
    for r in sorted(Q[11](spark, d).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == {i for i in vecs if i % 50 == 0}
    for q, found in got.items():
        s = (x @ vecs[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(vecs[q]))
        own = dict(zip(ids.tolist(), s.tolist(), strict=True))
        assert [f[2] for f in found] == list(range(1, 6)) and q not in [f[0] for f in found]
        assert all(abs(own[i] - sc) < 1e-12 for i, sc, _ in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        best = sorted((-round(own[i], 12), i) for i in own if i != q)[:5]
        hit += sum(round(own[i], 12) >= -best[-1][0] for i, _, _ in found)
        want_n += 5
    assert hit / want_n >= 0.95


def test_op11_recall_in_rounds(spark, monkeypatch):
    """Many small segments in several rounds: recall against brute force, and nothing but true cosines."""
    monkeypatch.setattr(prefix_forest, "SEGMENT", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 24))).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in prefix_forest.neighbours(table, F.col("vec_id") % 20 == 0, k=4).collect():
        got[r["query_id"]].add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 1500, 20):
        s = u @ u[q]
        s[q] = -2
        hit += len(got[q] & set(np.argsort(-s)[:4].tolist()))
    assert hit / (4 * 75) >= 0.95


def test_forest_descends_and_ascends():
    """Longest prefixes and spans are those of the sorted strings themselves."""
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(200, 6)), rng.normal(size=(9, 6))
    f = prefix_forest.Forest(x)
    text = lambda s: format(int(s) & (1 << prefix_forest.BITS) - 1, f"0{prefix_forest.BITS}b")
    rows, asked = f.strings(x), f.strings(q)
    common = lambda a, b: next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    for j in range(9):
        assert f.depth(asked)[j] == max(common(text(asked[t, j]), text(r)) for t in range(prefix_forest.TREES) for r in rows[t])
    lo, hi = f.span(asked, 5)
    of, row = f.members(lo, hi)
    want = sorted((j, i) for t in range(prefix_forest.TREES) for j in range(9) for i in range(200) if text(rows[t, i])[:5] == text(asked[t, j])[:5])
    assert sorted(zip(of.tolist(), row.tolist(), strict=True)) == want


def negatives(rows):
    e = usable(rows, label=True)
    out = []
    for a in (i for i in e if i % 100 == 0):
        y, v = e[a]
        s = {i: int(v @ w) for i, (_, w) in e.items() if i != a}
        pos = sorted(((-s[i], i) for i in s if e[i][0] == y))[:5]
        for ps, p in pos:
            ok = sorted((-s[i], i) for i in s if e[i][0] != y and 30 * -ps <= 100 * s[i] <= 90 * -ps)[:10]
            out += [(a, p, k + 1, i, -ps, -ns) for k, (ns, i) in enumerate(ok)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("d", [SMALL, "odd"])
def test_op13_is_exact(spark, odd_vectors, d, monkeypatch):
    d = odd_vectors if d == "odd" else d
    got = sorted(tuple(r[c] for c in COLUMNS) for r in Q[13](spark, d).collect())
    assert got == negatives(rows_of(d)) and got


def test_op13_chunks_blocks_and_few_visits(spark, odd_vectors, monkeypatch):
    for name, value in (("CHUNK", 16), ("BLOCK", 2), ("FIRST", 1), ("CELLS", 256), ("SAMPLE", 64)):
        monkeypatch.setattr(hard_negatives, name, value)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in Q[13](spark, odd_vectors).collect())
    assert got == negatives(rows_of(odd_vectors))


def test_clustered_vectors_skip_lists():
    """Bounds hold for every row, and on clustered vectors most lists are outside a window."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 10
    x = centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) * 0.1
    c = hard_negatives.fit(x[:600], 40)
    own, far = hard_negatives.nearest(x, c)
    radii = np.array([far[own == k].max(initial=-1) for k in range(40)])
    upper, lower = hard_negatives.bounds(x[:50], c, radii)
    s = x[:50] @ x.T
    assert (s <= upper[:, own] + 1e-9).all() and (s >= lower[:, own] - 1e-9).all()
    top = np.sort(s, axis=1)[:, -10]
    assert (upper >= top[:, None]).mean() < 0.3


def test_no_vectors(spark, tmp_path):
    d = write(tmp_path, "embeddings", [], VECTORS)
    assert Q[11](spark, d).collect() == [] and Q[13](spark, d).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 1.0], 2)], SMALL_TABLE)
    assert [(r["rank"], r["vec_id"]) for r in prefix_forest.neighbours(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def runs_of(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_words():
    random.seed(4)
    texts = [None, "", " \n\t ", "a", "a b a b a b", "a b a b a b a b", "x " * 5, "x " * 6, "é é " * 9, "ab cd " * 400]
    for _ in range(400):
        parts = []
        for _ in range(random.randint(0, 6)):
            letters = "abcde"[: random.randint(1, 5)]
            parts += [random.choice(letters) for _ in range(random.randint(1, 7))] * random.randint(1, 9) + [random.choice(letters) for _ in range(random.randint(0, 4))]
        texts.append(" \t"[random.randint(0, 1)].join(parts))
    n, runs, left = periodic_runs._batch(pa.array(texts))
    for t, k, got, c in zip(texts, n.to_pylist(), runs.to_pylist(), left.to_pylist(), strict=True):
        words = [w.decode() for w in (t or "").encode().split()]
        want = runs_of(words)
        assert k == len(words) and [(r["start"], r["length"], r["period"]) for r in got] == want and c == collapsed(words, want)


def test_extensions_match_scans():
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 2, n) for n in (1, 40, 7, 90)]
    symbols, offs = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    text = np.repeat(np.arange(4), [len(p) for p in parts])
    e = periodic_runs.Extensions(symbols, offs[1:][text], text)
    pairs = [(i, j) for t in range(4) for i in range(offs[t], offs[t + 1]) for j in range(i + 1, offs[t + 1])]
    i, j = np.array(pairs).T
    for a, b, got in zip(i, j, e.query(i, j), strict=True):
        want = 0
        while b + want < offs[text[a] + 1] and symbols[a + want] == symbols[b + want]:
            want += 1
        assert got == want


@pytest.mark.parametrize("n", [1, 7])
def test_very_long_regular_texts(n):
    words = [f"w{i}" for i in range(n)] * (200_000 // n)
    _, runs, left = periodic_runs._batch(pa.array([" ".join(words)]))
    assert runs.to_pylist()[0] == [{"start": 0, "length": len(words), "period": n}] and left.to_pylist() == [" ".join(words[:n])]


DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("RUNS", pa.int32()), ("g", pa.string()), ("n_words", pa.int64())])


@pytest.mark.parametrize("d", [SMALL, "odd", "none"])
def test_op12_is_exact(spark, d, tmp_path):
    if d != SMALL:
        base = " ".join(f"word{i}" for i in range(50))
        texts = [base, base, None, "", "  ", "solo", "a b " * 30, " ".join(["x"] * 3000)] * 12
        rows = [(None if i == 9 else i // 2 * 7, t, 1, "y", 3) for i, t in enumerate(texts)] if d == "odd" else []
        d = write(tmp_path, "documents", rows, DOCS)
    table = pq.read_table(f"{d}/documents.parquet").to_pylist()
    want = []
    for r in table:
        words, doc = (r["text"] or "").encode().split(), r["doc_id"]
        n = len(words)
        h = crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        words = [w.decode() for w in words]
        runs = runs_of(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(collapsed(words, runs))))
    got = [tuple(r)[:8] for r in Q[12](spark, d).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
