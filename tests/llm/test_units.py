"""Kernels and operators apart from their queries: odd inputs, clashing columns, repeated rows, split groups."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import common, decontamination, fingerprints, kernels, language_id, mixing, near_dedup, quality, recompression, secrets, sharding, suffix_dedup
from quantloom.llm.repeats import Repeats


def test_words_split_at_rows():
    _, data, offs = next(kernels.pieces(pa.array(["ab c", None, "", "d", " e\t"])))
    s, e, at = kernels.words(data, offs, kernels.WORD_BYTES)
    assert [bytes(data[i:j]) for i, j in zip(s, e, strict=True)] == [b"ab", b"c", b"d", b"e"] and at.tolist() == [0, 2, 2, 2, 3, 4]


def test_pieces_cover_sliced_arrays():
    rows = [str(i) * (i % 50) for i in range(300)]
    got = []
    for _, data, offs in kernels.pieces(pa.array(rows)[17:250], 400):
        got += [bytes(data[a:b]).decode() for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert got == rows[17:250]


def test_sliding_min():
    v = np.random.default_rng(1).integers(0, 99, 500).astype(np.uint64)
    assert kernels.sliding_min(v, 37).tolist() == [min(v[i : i + 37]) for i in range(464)]


@pytest.mark.parametrize("seed", range(5))
def test_columns_mark_repeated_windows(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(60))
    frags = []
    for _ in range(40):
        x0 = rng.randrange(-10, 5)
        own = bytearray(base[x0 + 20 : x0 + 20 + rng.randrange(9, 30)])
        for _ in range(rng.randrange(2)):
            own[rng.randrange(len(own))] = rng.choice(b"abc")
        frags.append((x0, bytes(own), 1))
    got = suffix_dedup.repeated(frags, 8)
    seen = Counter((x + i, b[i : i + 8]) for x, b, _ in frags for i in range(len(b) - 7))
    for (x, b, _), flags in zip(frags, got, strict=True):
        assert flags.tolist() == [seen[x + i, b[i : i + 8]] > 1 for i in range(len(b) - 7)]


def _named_in_rounds(words: list[list[int]], rounds: int):
    """The rounds of recompression on one block, with names by a plain count of all that occurs more than once."""
    flat = np.concatenate([np.array(w, np.int64) for w in words])
    n = np.array([len(w) for w in words], np.int32)
    count = Counter(flat.tolist())
    known = {w: i + 1 for i, w in enumerate(sorted(w for w in count if count[w] > 1))}
    own = recompression.Block.of_words(n, np.ones(len(n), np.int32), np.array([known.get(w, 0) for w in flat.tolist()], np.int64))
    for level in range(1, rounds + 1):
        own = recompression.Block.read(recompression._state_batch(0, own), 0)
        own.collapse()
        joined, right, unique, which = own.pairs(level)
        often = np.bincount(which, minlength=len(unique))
        names = np.where(often > 1, np.arange(len(unique)) + (level << 56) + 1, 0)
        own.merge(joined, right, names[which])
        own.anchor(level)
    return own, np.cumsum(n) - n


@pytest.mark.parametrize("seed", range(6))
def test_anchors_depend_on_the_window_only(seed):
    """Equal windows have one key and equally distant anchors, in whatever text they are; unique words end windows."""
    rng = np.random.default_rng(seed)
    passage = rng.integers(0, 9 if seed % 2 else 400, 200).tolist()
    texts = [[*rng.integers(0, 9, 50).tolist(), *passage, 777_000, *rng.integers(0, 9, 60).tolist()], [*rng.integers(0, 400, 7).tolist(), *passage, 5, 5, 5], [3] * 90]
    own, first = _named_in_rounds(texts, 5)
    flat, w = [x for t in texts for x in t], recompression.WINDOW
    seen: dict = {}
    for t, f in zip(texts, first.tolist(), strict=True):
        for p in range(f, f + len(t) - w + 1):
            seen.setdefault(tuple(flat[p : p + w]), []).append(p)
    assert sum(len(x) > 1 for x in seen.values()) > 150
    for words, places in seen.items():
        if len(places) > 1:
            assert len({(own.akey[p], own.reach[p]) for p in places}) == 1 and own.akey[places[0]] != 0
        elif 777_000 in words:
            assert own.akey[places[0]] == 0
    assert len(own.name) < 0.9 * len(flat)


def test_large_groups_are_split(spark, monkeypatch):
    import quantloom.llm.repeats as repeats

    monkeypatch.setattr(repeats, "GROUP", 3)
    rng = random.Random(3)
    passage = [f"w{i}" for i in range(34)]
    texts = [" ".join([*(f"a{rng.randrange(10**6)}" for _ in range(40)), *passage, *([f"z{i % 3}"] if i % 2 else []), *(f"b{rng.randrange(10**6)}" for _ in range(40))]) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for op, size, cut in ((recompression, 35, str.split), (suffix_dedup, 400, str.encode)):
        rows = [cut(t) for t in texts]
        if size == 400:
            texts2 = [t[:200] + "".join(passage) * 5 + t[200:] for t in texts]
            docs = spark.createDataFrame(list(enumerate(texts2)), "doc_id long, text string")
            rows = [t.encode() for t in texts2]
        seen = Counter(tuple(r[i : i + size]) for r in rows for i in range(len(r) - size + 1))
        for r in op.deduplicated(docs).collect():
            own = rows[r.doc_id]
            gone = set()
            for i in range(len(own) - size + 1):
                if seen[tuple(own[i : i + size])] > 1:
                    gone.update(range(i, i + size))
            assert r.n_removed == len(gone)
    assert isinstance(suffix_dedup.REPEATS, Repeats)


def test_wide_buckets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        own = list(base)
        for i in rng.sample(range(60), rng.randrange(1, 9)):
            own[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    root = list(range(40))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(40):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in near_dedup.groups(docs, 2, 80).collect()}
    assert got == {i: find(i) for i in range(40)}


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "hello world token = abcdef1234567890xyz", "en", "s", 5, 0.5, "k"), (1, "hello world token = abcdef1234567890xyz", "en", "s", 5, 0.5, "k"), (2, None, None, None, None, None, None), (None, "other text here", "en", "t", 1, 1.0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, node string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([("a", "hello world")], "item_id string, text string")
    model = quality.fit(docs, labels, F.lit(True))
    assert quality.classify(docs, model).count() == 4 and quality.rejected_removed(docs, model).columns == docs.columns
    assert sharding.shard(docs.withColumn("shard", F.lit(1))).count() == 4
    assert suffix_dedup.deduplicated(docs).count() == 4 and recompression.deduplicated(docs).count() == 4
    assert language_id.fit(docs, F.lit(True)).predict(docs.withColumn("letter", F.lit(1))).count() == 4
    assert secrets.scan(docs.withColumn("base", F.lit(1))).count() == 4
    assert mixing.plan(docs.withColumn("size", F.lit(1))).count() == 4 and mixing.mixed(docs).columns == docs.columns
    assert decontamination.contamination(docs.withColumn("n_hit", F.lit("x")), items).where("contaminated").count() == 2
    assert decontamination.decontaminated(docs, items).columns == docs.columns
    assert fingerprints.edit_study(docs.withColumn("anchors", F.lit(1))).count() == 4
    assert near_dedup.groups(docs, 2, 80).count() == 4
    kept = near_dedup.deduplicated(docs.withColumn("near_key", F.lit(1)))
    assert kept.count() == 3 and "near_key" in kept.columns


def test_secrets_hide(spark):
    docs = spark.createDataFrame([(1, 'a token = "abcdef1234567890" b'), (2, "plain"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert "abcdef" not in got[1] and got[1].endswith(" b") and got[2] == "plain" and got[3] is None


def test_random_tokens_score_higher(spark):
    rng = random.Random(4)
    letters = secrets.ALPHABETS[64]
    rows = [("r", "".join(rng.choice(letters) for _ in range(40))) for _ in range(60)] + [("t", ("report2024final" * 4)[: 30 + i % 9]) for i in range(60)]
    got = spark.createDataFrame(rows, "kind string, t string").select("kind", secrets.p_value(F.col("t")).alias("p")).groupBy("kind").agg(F.avg("p").alias("p"))
    p = {r.kind: r.p for r in got.collect()}
    assert 0.3 < p["r"] < 0.7 and p["t"] < 0.05


def test_targets_share_the_excess():
    got = mixing.targets([10, 100, 1000, 0])
    assert got[0] == 30 and got[3] == 0 and sum(got) == pytest.approx(1110) and got[1] == 300


def test_large_items_are_screened_in_parts(spark):
    """Several automata and several passes give the rows of one."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(str(i), " ".join(word() for _ in range(rng.choice([1, 3, 14, 40])))) for i in range(40)]
    texts = [" ".join([*(word() for _ in range(30)), *items[rng.randrange(40)][1].split(), *items[rng.randrange(40)][1].split()[3:], *(word() for _ in range(30))]) for _ in range(30)]
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (1, texts[1])], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id string, text string")
    one = decontamination.contamination(docs, table, spans=True)
    many = decontamination.contamination(docs, table, spans=True, part_bytes=300, held_bytes=9000)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect())) and one.where("n_hit > 0").count() > 20
    assert len(list(decontamination.screens(table, part_bytes=300))) > 5


def _thue_morse():
    """Two different words of 1,024 letters that any power series modulo 2**64 takes for equal."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_regular_words_are_told_apart(spark):
    x, y = _thue_morse()
    plain = [f"p{i}" for i in range(34)]
    rows = [(1, " ".join([*plain[:17], x, *plain[17:]])), (2, " ".join([*plain[:17], y, *plain[17:]])), (3, x), (4, y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.groups(docs, 2, 95).collect()} == {i: i for i in range(1, 5)}
    assert {r.n_removed for r in recompression.deduplicated(docs).collect()} == {0}
    items = spark.createDataFrame([("a", x)], "item_id string, text string")
    assert {r.doc_id for r in decontamination.contamination(docs, items).where("n_hit > 0").collect()} == {1, 3}
    whole = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicated(docs).collect()}
    seen = Counter(t.encode()[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    for i, t in rows:
        raw, gone = t.encode(), set()
        for j in range(len(raw) - 399):
            if seen[raw[j : j + 400]] > 1:
                gone.update(range(j, j + 400))
        assert whole[i] == len(gone)


def test_shard_counts_other_than_powers_of_two(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) as text", "'s' as source", "'en' as lang")
    load = {r.shard: r.n for r in sharding.shard(docs, 5).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert len(load) == 5 and max(load.values()) < 1.1 * min(load.values())


def test_every_text_has_a_fingerprint(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(i % 14))) for i in range(400)], "doc_id long, text string")
    got = fingerprints.edit_study(docs)
    assert got.where("fingerprint = '' or edited_fingerprint = ''").count() == 0 and got.count() == 400


def test_short_and_unspaced_texts_keep_anchors(spark, tmp_path):
    """Half of each text is unchanged, so it is nearer to its edited text than to the next, on every scale and at its borders."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (4, 6, 9, 12, 19, 20, 27, 39, 60, 75, 90, 200, 3, 70)]
    texts += ["".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n)) for n in (5, 16, 17, 33, 201, 399, 401, 2000, 30)]
    texts += ["".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (40, 399, 402, 30_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in fingerprints.edit_study(rows).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k].near_edited > got[k].near_next and got[k].near_edited > 0.05, (k, t[:40], got[k].near_edited, got[k].near_next)
    long = "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(1000))
    pair = spark.createDataFrame([(long, long[:500] + "x" + long[501:])], "a string, b string")
    assert pair.select(fingerprints.likeness(fingerprints.syncmers(F.col("a")), fingerprints.syncmers(F.col("b"))).alias("x")).first().x > 0.9


def test_shards_are_cut_by_metadata(spark):
    """Texts of one length and source, half of them of each language: the cut is by language, not by a hash of the text."""
    docs = spark.range(80).select(F.col("id").alias("doc_id"), F.format_string("text %05d", "id").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), F.lit("web").alias("source"))
    rows = sharding.shard(docs, 2).join(docs, "doc_id").groupBy("shard").agg(F.collect_set("lang").alias("langs"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted((*r.langs, r.n) for r in rows) == [("de", 40), ("en", 40)]


def test_ids_far_apart(spark):
    """Ids of both ends, null ids, and one outlying id: results are whole and ranges stay even."""
    ids = [-9 * 10**18, 9 * 10**18, None, None, *range(400), 8 * 10**18]
    docs = spark.createDataFrame([(i, f"text number {n} of them all", "s", "en") for n, i in enumerate(ids)], "doc_id long, text string, source string, lang string")
    rows = sharding.shard(docs, 4).collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(4))
    assert Counter(r.doc_id for r in mixing.plan(docs).collect()) == Counter(ids)
    got = fingerprints.with_next(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids) and len({r.next_text for r in got}) == len(ids)
    part = docs.select(common.id_range(docs, "doc_id", 8).alias("r")).where("r >= 0").groupBy("r").count().collect()
    assert len(part) == 8 and max(p["count"] for p in part) < 70


def test_equal_texts_share_a_shard(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('copied text ', if(id % 7 = 0, 0, id)) as text", "concat('s', id % 3) as source", "'en' as lang")
    spread = sharding.shard(docs, 5).groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("n")).agg(F.max("n")).first()[0]
    assert spread == 1


def test_planted_random_tokens_are_found(spark):
    """Random tokens outside of fixed patterns and long ones that are not random, every one of them tested."""
    rng = random.Random(11)
    rows, planted = [], {}
    for i in range(600):
        kind = i % 3
        if kind == 0:
            k = rng.choice([36, 64, 64])
            token = "".join(rng.choice(secrets.ALPHABETS[k]) for _ in range(rng.randrange(24, 60)))
        elif kind == 1:
            token = "-".join(rng.choice(["alpha", "report", "final", "version", "2024", "draft", "internal"]) for _ in range(6))
        else:
            token = rng.choice(["internationalization", "counterrevolutionaries", "aaaaaaaaaaaaaaaaaaaaaaaa", "0123456789012345678901234567", "________________________", "abcdefghijklmnopqrstuvwxyz"])
        rows.append((i, f"some words before {token} and after"))
        planted[i] = kind == 0
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_tested == 1 for r in got.values())
    found = {i for i, r in got.items() if r.added or r.n_random}
    hits = sum(planted[i] for i in found)
    assert hits / 200 >= 0.9 and hits / len(found) >= 0.93


def test_unit_without_gathering_sources(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(mixing, "RATIOS", 4)
    for n in (1, 2, 5, 60):
        sizes = [rng.choice([0, 1, 7, 7, 300, 20_000]) for _ in range(n)]
        table = spark.createDataFrame([(s, float(mixing.WEIGHTS[i % 3])) for i, s in enumerate(sizes)], "source_size long, weight double")
        unit, want = mixing._unit(table, 3), mixing.targets(sizes)
        got = [min(3.0 * s, unit * mixing.WEIGHTS[i % 3]) if s else 0.0 for i, s in enumerate(sizes)]
        assert got == pytest.approx(want)


def test_block_numbers_of_many_partitions(spark):
    """Numbers of blocks and parts stay different and within 64 bits far beyond 1,024 partitions."""
    from quantloom.llm import recompression as RC

    partitions = [0, 1, 1023, 1024, 5000, 2**21, 2**29]
    rows = spark.createDataFrame([((p << 33) + i,) for p in partitions for i in (0, 1, 2**17 - 1)], "m long")
    got = [r[0] for r in rows.select(RC.block_number(F.col("m"))).collect()]
    assert len(set(got)) == len(got) and min(got) >= 0 and max(got) * RC.PARTS + RC.PARTS < 2**63
    block = (5000 << 17) + 7
    words = [f"w{i}" for i in range(80)]
    row = {"block": block, "u1": [1, 1], "u2": [2, 2], "w0": [0, 40], "n": [40, 40], "times": [1, 2], "words": " ".join(words).encode()}
    kinds = pa.schema([("block", pa.int64()), ("u1", pa.list_(pa.int64())), ("u2", pa.list_(pa.int64())), ("w0", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("words", pa.binary())])
    (out,) = RC._parts([pa.RecordBatch.from_pylist([row], schema=kinds)])
    assert out.column("doc_id").to_pylist() == [block * RC.PARTS, block * RC.PARTS + 1]
    assert out.column("text").to_pylist() == [" ".join(words[:40]), " ".join(words[40:])]
