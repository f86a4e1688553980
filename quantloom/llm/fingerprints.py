"""Document fingerprints from closed syncmers.

A text is read on one or two of four scales, by its length: single code points, pairs and runs of 6 code points
for short texts, runs of 4 words for longer ones. A word of over 20 code points (a text without white space is
one) counts as its runs of 8 code points. A k-mer is kept if the least hash among its s-mers stands at its first
or its last place, which depends on nothing but the k-mer: an edit changes only the k-mers that hold it. Of any
2k - s - 1 tokens in a row at least one k-mer is kept. Scales overlap, so that a text and any edit of it that
keeps half of its code points share one. The fingerprint is the hashes of all kept k-mers, scale by scale in
text order, 8 hexadecimal digits each. A text without a k-mer (an empty one) is one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quantloom.llm.common import id_range

K_MER, S_MER = 4, 2
#: k and s in code points, for texts of over `low` and up to 2 * `high` code points; words are for those of over the last `high`.
SHORT_SCALES = ((1, 1, 0, 2), (2, 1, 2, 16), (6, 2, 16, 200))
#: Code points of the longest word that is one token, and of the runs that stand for longer ones (a power of 2).
LONG_WORD, RUN = 20, 8
#: Rows of a range of ids that one task sorts, as long as there are fewer than MOST_RANGES ranges.
RANGE_ROWS, MOST_RANGES = 2000, 100_000
_SPACE = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once for all uses in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kept(h: Column, k: int, s: int) -> Column:
    """The closed syncmers of tokens with hashes h, in order: hash * 2**32 + place of the first token, from 1; none if
    there are fewer than k tokens."""
    inner = k - s + 1

    def of_hashes(h: Column) -> Column:
        small = h
        for i in range(1, s):
            small = F.zip_with(small, F.slice(h, F.lit(i + 1), F.size(h)), lambda a, b: F.hash(a, b))

        def closed(m: Column):
            edge = lambda i: F.array_contains(F.array(F.get(m, i - 1), F.get(m, i + inner - 2)), F.array_min(F.slice(m, i, F.lit(inner))))
            return F.transform(F.filter(F.sequence(F.lit(1), F.size(h) - (k - 1)), edge), lambda i: F.shiftleft(F.hash(F.slice(h, i, F.lit(k))).cast("long"), 32) + i)

        return F.when(F.size(h) < k, F.array().cast("array<long>")).otherwise(_let(small, closed))

    return _let(h, of_hashes)


def _points(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.hash(c))


def _runs(word: Column) -> Column:
    """Hashes of the runs of RUN code points of a longer word, by doubling, so that long words cost a few passes."""

    def doubled(h: Column, n: int) -> Column:
        two = F.zip_with(F.slice(h, F.lit(1), F.size(h) - n), F.slice(h, F.lit(n + 1), F.size(h)), lambda a, b: F.hash(a, b))
        return two if 2 * n == RUN else _let(two, lambda x: doubled(x, 2 * n))

    return _let(_points(word), lambda h: doubled(h, 1))


def _words(text: Column) -> Column:
    words = F.split(F.btrim(text, F.lit(_SPACE)), r"[\x20\x09-\x0D]+")
    return F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) > LONG_WORD, _runs(w)).otherwise(F.array(F.hash(w)))))


def syncmers(text: Column) -> Column:
    """The closed syncmers of a text on its scales, in order: hash * 2**32 + place (in tokens of the scale, from 1).
    Null texts count as empty; very long ones are read whole."""

    def of(t: Column) -> Column:
        n, none = F.char_length(t), F.array().cast("array<long>")
        scales = [F.when((n > low) & (n <= 2 * high), _kept(_points(t), k, s)).otherwise(none) for k, s, low, high in SHORT_SCALES]
        scales.append(F.when(n > SHORT_SCALES[-1][-1], _kept(_words(t), K_MER, S_MER)).otherwise(none))
        return _let(F.concat(*scales), lambda x: F.when(F.size(x) == 0, F.array(F.shiftleft(F.hash(t).cast("long"), 32) + 1)).otherwise(x))

    return _let(F.coalesce(text, F.lit("")), of)


def as_text(anchors: Column) -> Column:
    """The hashes, 8 hexadecimal digits each."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0")), "")


def hashes(anchors: Column) -> Column:
    return F.transform(anchors, lambda x: F.shiftright(x, 32).cast("int"))


def placed_likeness(a: Column, b: Column) -> Column:
    """Part of the anchors of both texts that agree in hash and place (Dice's coefficient): what is unchanged and has
    not moved."""
    return (2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of the hashes of two texts' anchors, wherever they stand: 1 for equal texts, 0 for texts that
    share none."""

    def dice(x: Column, y: Column) -> Column:
        shared, all_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
        return (2 * shared / (shared + all_)).cast("double")

    return _let(hashes(a), lambda x: _let(hashes(b), lambda y: dice(x, y)))


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text to `docs` (a column so named is replaced)."""
    return docs.withColumn(into, as_text(syncmers(F.col(text))))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: each document beside the next by falling id.

    Null texts count as empty, null ids come last, rows of one id go by a hash of their text, and after
    the last document comes the first. Ids are cut into ranges of like counts (rows without id by their texts' hashes), each sorted by itself; the head
    of the range below follows a range's last document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    rows = rows.withColumn("tid", F.xxhash64("text"))
    rows = rows.withColumn("range", id_range(rows, "doc_id", ranges, "tid"))
    key = rows.select("range", F.struct("doc_id", "tid").alias("first"))
    heads = key.groupBy("range").agg(F.max("first").alias("first"))
    down = W.partitionBy(F.lit(0)).orderBy(F.col("range").desc())  # 2 * MOST_RANGES rows at most
    below = F.coalesce(F.lead("first").over(down), F.first("first").over(down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select(F.col("range").alias("above"), below.alias("first"))
    # 2 * MOST_RANGES rows at most are broadcast, so that texts need no second shuffle
    heads = heads.select("above", F.col("first.doc_id").alias("h_id"), F.col("first.tid").alias("h_tid"))
    head = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tid") == F.col("h_tid"))).select("above", F.col("text").alias("h_text")).dropDuplicates(["above"])
    by = W.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("tid").desc())
    rows = rows.withColumn("next_text", F.lead("text").over(by))
    both = rows.join(head, (F.col("range") == F.col("above")) & F.col("next_text").isNull(), "left")
    return both.select("doc_id", "text", F.coalesce("next_text", "h_text").alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """`text` with its last floor(n / 2) code points replaced by the first as many (or all) of `other`."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def edit_study(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and likenesses to the edited and the next text: of anchors
    wherever they stand (near_*), and of anchors at their places (placed_*). Null and empty texts are one anchor."""
    rows = with_next(docs).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    # anchors are found after the shuffle, which moves texts only
    found = [syncmers(F.col(c)).alias(n) for c, n in (("text", "anchors"), ("edit", "edit_anchors"), ("next_text", "next_anchors"))]
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), *found)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("anchors")).alias("fingerprint"), as_text(F.col("edit_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edit_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
        placed_likeness(F.col("anchors"), F.col("edit_anchors")).alias("placed_edited"), placed_likeness(F.col("anchors"), F.col("next_anchors")).alias("placed_next"),
    )
