"""The pipeline's stages, each against a plain form of its rule on what came in."""

import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline as P
from quantloom.llm import quality
from quantloom.llm.queries import table

D = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    path, docs, seen = tmp_path_factory.mktemp("stages"), table(spark, D, "documents"), [("input", pq.read_table(f"{D}/documents.parquet").to_pylist())]
    for name, f in P.STAGES:
        f(spark, docs, D).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        if name != P.STAGES[-1][0]:
            assert docs.columns == COLUMNS
        seen.append((name, [r.asDict() for r in docs.collect()]))
    return dict(seen)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_quality_drops_what_it_rejects(spark, stages):
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{D}/labels.parquet").to_pylist()}
    kept = {r["doc_id"] for r in stages["quality"]}
    seen = {r["doc_id"] for r in stages["input"]}
    assert kept < seen
    good = [i in kept for i, q in label.items() if q == 1]
    bad = [i in kept for i, q in label.items() if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15
    assert hasattr(quality, "rejected_removed")


def test_near_duplicates_leave_one_of_each_group(stages):
    rows, sets = stages["quality"], {}
    for r in rows:
        w = words(fold(r["text"]))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r["doc_id"] for r in stages["near_dedup"]) == [k for k in keys if find(k) == k]


def test_contaminated_go_and_clean_stay_whole(stages):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in pq.read_table(f"{D}/benchmark.parquet").to_pylist():
        w = word.findall(fold(r["text"]))
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows[len(w[i : i + 13])].add(tuple(w[i : i + 13]))
    after = {r["doc_id"]: r for r in stages["decontamination"]}
    for r in stages["near_dedup"]:
        w = word.findall(fold(r["text"]))
        hit = [False] * len(w)
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit[i : i + n] = [True] * n
        n = sum(hit)
        if n and 20 * n >= len(w):
            assert r["doc_id"] not in after
        elif not n:
            assert after[r["doc_id"]] == r
        else:
            got = after[r["doc_id"]]
            assert len(got["text"]) == got["n_chars"] < len(r["text"])


def test_mix_takes_known_documents(stages):
    before = {r["doc_id"]: r for r in stages["decontamination"]}
    taken = Counter(r["doc_id"] for r in stages["mixing"])
    assert all(before[r["doc_id"]] == r for r in stages["mixing"]) and max(taken.values()) <= 3
    total = sum(len(words(r["text"])) for r in before.values())
    mixed = sum(len(words(r["text"])) for r in stages["mixing"])
    assert abs(mixed - total) < 0.15 * total


def test_shards_hold_the_mix(stages):
    assert Counter(r["doc_id"] for r in stages["sharding"]) == Counter(r["doc_id"] for r in stages["mixing"])
    slots = defaultdict(list)
    for r in stages["sharding"]:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_copies_are_caught(stages):
    """Of pairs of texts that share 0.8 or more of their five-word shingles, at most one of each group is left."""
    sets = {}
    for r in stages["near_dedup"]:
        w = words(fold(r["text"]))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    kept = sorted(k for k, s in sets.items() if s)
    missed = sum(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for i, a in enumerate(kept) for b in kept[i + 1 :])
    gone = len(stages["quality"]) - len(stages["near_dedup"])
    assert gone > 0 and missed <= 0.1 * gone


def test_empty_and_odd_tables(spark, tmp_path):
    """No rows, then nulls in every column, repeated rows, and texts without words, through all stages."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    rows = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (None, None, None, None, None), (-9 * 10**18, "", None, "a", 0), (9 * 10**18, " \n ", "de", None, 3)]
    rows += [(i, f"text {i} of several words that differ {i * 7} and more {i * 13}", "en", "b", 10) for i in range(2, 12)]
    for name, own in (("none", []), ("odd", rows)):
        d = tmp_path / name
        d.mkdir()
        pq.write_table(pa.table([list(c) for c in zip(*own, strict=True)], schema=schema) if own else schema.empty_table(), d / "documents.parquet")
        pq.write_table(pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())]).empty_table() if not own else pa.table({"doc_id": [1, 2, None, 3], "quality": [1, 1, None, 1], "toxic": [0, None, 0, 0]}), d / "labels.parquet")
        pq.write_table(pa.schema([("item_id", pa.int64()), ("text", pa.string())]).empty_table(), d / "benchmark.parquet")
        got = P.run(spark, str(d)).collect()
        assert bool(got) == bool(own) and max(Counter(r.doc_id for r in got).values(), default=0) <= 3
