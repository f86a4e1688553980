"""Language identification by hierarchical discrimination.

First the family, by one linear support vector machine per family; then one-versus-one linear support
vector machines among that family's languages. All machines read hashed byte n-grams of the whole text
(ASCII letters folded) and are trained here by stochastic subgradient descent on the hinge loss, over a
bounded sample: at most `rows_per_lang` rows of each language, `max_rows` in all. Families come from a table of language
codes; a code it lacks is a family of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quantloom.llm import kernels as K
from quantloom.llm.common import extended, fresh

BITS = 16
SALTS = 16
ORDERS = (2, 3, 4)

# Families by language codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk pl cs sk bg sr hr sl mk be bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi bn ur pa mr gu ne si".split(),
    "semitic": "ar he am mt".split(),
    "sinitic": "zh yue".split(),
    "celtic": "ga cy gd br".split(),
    "baltic": "lt lv".split(),
}
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def family_of(lang: str) -> str:
    code = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes), code)


def _grams(data: np.ndarray, offs: np.ndarray):
    wide = _FOLD[data].astype(np.uint32)
    for k, n in enumerate(ORDERS):
        m = max(len(wide) - n + 1, 0)
        g = np.zeros(m, np.uint32)
        for i in range(n):
            g |= wide[i : i + m] << np.uint32(8 * i)
        g *= np.uint32(0x9E3779B1)
        first = np.minimum(offs[:-1], m)
        yield ((g >> np.uint32(32 - BITS)).astype(np.int32) + np.int32(k << BITS)), first, np.maximum(offs[1:] - n + 1, first)


def _counted(batches):
    for b in batches:
        ids, counts = [], []
        for _, data, offs in K.pieces(b.column("text")):
            parts = list(_grams(data, offs))
            for d in range(len(offs) - 1):
                u, c = np.unique(np.concatenate([x[a[d] : e[d]] for x, a, e in parts]), return_counts=True)
                ids.append(u.astype(np.int32).tobytes())
                counts.append(c.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "ids", "counts"])


def _svm(rows, sign: np.ndarray, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """A linear machine on feature shares; classes weigh alike. sign: +1, -1 or 0 (not used) for each row."""
    rng, used = np.random.default_rng(seed), np.flatnonzero(sign)
    w, b = np.zeros(len(ORDERS) << BITS, np.float32), 0.0
    weigh = {s: len(used) / (2 * max((sign == s).sum(), 1)) for s in (1, -1)}
    steps, step = epochs * len(used), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            y, (_, ids, counts) = sign[i], rows[i]
            share = counts.astype(np.float32) / counts.sum()
            lr = rate * (1 - step / steps) * weigh[int(y)]
            step += 1
            if y * (w[ids] @ share + b) < 1:
                w[ids] += (lr * y) * share
                b += 0.001 * lr * y
    return w, b


@dataclass
class LanguageModel:
    """Columns of `weight`: one machine per family, then one for each pair of languages of a family."""

    families: list[str]
    langs: dict[str, list[str]]
    weight: np.ndarray
    bias: np.ndarray
    pairs: list[tuple[str, str]] = field(default_factory=list)

    def decide(self, z: np.ndarray) -> tuple[list[str | None], np.ndarray]:
        """From the machines' margins, a language and a confidence for each row."""
        n, nf = len(z), len(self.families)
        p = 1 / (1 + np.exp(-np.clip(2 * z, -30, 30)))
        if not nf:
            return [None] * n, np.zeros(n)
        pick = z[:, :nf].argmax(axis=1)
        lang, score = np.empty(n, object), np.zeros(n)
        for f, family in enumerate(self.families):
            at = np.flatnonzero(pick == f)
            if not len(at):
                continue
            names = self.langs[family]
            wins, sure = np.zeros((len(at), len(names))), np.zeros((len(at), len(names)))
            for k, (a, b) in enumerate(self.pairs):
                if a in names:
                    q, i, j = p[at, nf + k], names.index(a), names.index(b)
                    wins[:, i] += q >= 0.5
                    wins[:, j] += q < 0.5
                    sure[:, i] += q
                    sure[:, j] += 1 - q
            best = (wins + 1e-3 * sure).argmax(axis=1)  # votes, then summed confidence
            inner = sure[np.arange(len(at)), best] / (len(names) - 1) if len(names) > 1 else np.ones(len(at))
            lang[at], score[at] = np.array(names, object)[best], (p[at, f] if nf > 1 else 1.0) * inner
        return lang.tolist(), np.clip(score, 0, 1)

    def predict(self, docs: DataFrame) -> DataFrame:
        """Adds `lang_pred` and `score`. Texts that are null or have no letter are `und` with score 0.

        Texts of any length are read whole; repeated rows get equal answers; an empty table gives no rows.
        Columns of `docs` by those names are replaced. A model without languages answers `und`.
        """
        docs = docs.drop("lang_pred", "score")
        (letter,) = fresh(docs, "letter")
        model = docs.sparkSession.sparkContext.broadcast(self)
        docs = docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
        schema = extended(docs.drop(letter).schema, lang_pred="string", score="double")

        def run(batches):
            m = model.value
            cols = m.weight.shape[1]
            for b in batches:
                lang, score = [], []
                for _, data, offs in K.pieces(b.column("text")):
                    z, n = np.zeros((len(offs) - 1, cols)), np.zeros(len(offs) - 1)
                    for x, a, e in _grams(data, offs):
                        n += e - a
                        for k in range(cols):
                            c = np.zeros(len(x) + 1)
                            np.cumsum(m.weight[:, k][x], out=c[1:])
                            z[:, k] += c[e] - c[a]
                    got, sure = m.decide(z / np.maximum(n, 1)[:, None] + m.bias)
                    lang += got
                    score += sure.tolist()
                ok = b.column(letter).to_pylist()
                lang = [x if o and x is not None else "und" for x, o in zip(lang, ok, strict=True)]
                score = [s if x != "und" else 0.0 for s, x in zip(score, lang, strict=True)]
                keep = [(c, n) for c, n in zip(b.columns, b.schema.names, strict=True) if n != letter]
                yield pa.RecordBatch.from_arrays([*(c for c, _ in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*(n for _, n in keep), "lang_pred", "score"])

        return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, learn: Column, rows_per_lang: int = 1000, max_rows: int = 64_000, epochs: int = 6, rate: float = 60.0) -> LanguageModel:
    """Learns `lang` from `text` on rows that satisfy `learn` and have both.

    The sample holds at most `rows_per_lang` ids of a language and about `max_rows` in all, those with the lowest
    hashes; of repeated rows of an id the least text counts. Very long texts count whole. Empty tables give a
    model without languages. What the driver and the model hold is bounded by `max_rows`.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & learn).select("doc_id", "lang")
    langs = known.select("lang").distinct().count()
    each = max(1, min(rows_per_lang, max_rows // max(langs, 1)))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    # first in SALTS parts of a language, so that no task sorts more than SALTS * rows_per_lang ids of one
    picked = known.distinct().withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        picked = picked.withColumn("at", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("at") <= each).drop("at")
    chosen = F.broadcast(picked.select("doc_id", "lang").orderBy(*order).limit(max_rows))  # max_rows rows at most
    texts = docs.where(F.col("text").isNotNull() & learn).select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    got = texts.mapInArrow(_counted, "lang string, ids binary, counts binary").toArrow().combine_chunks()
    rows = [r for r in zip(got.column("lang").to_pylist(), K.views(got.column("ids"), np.int32), K.views(got.column("counts"), np.uint32), strict=True) if len(r[1])]
    rows.sort(key=lambda r: (r[0], len(r[1]), crc32(r[1]), crc32(r[2])))  # not as tasks happened to end
    return train(rows, epochs, rate)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 60.0) -> LanguageModel:
    names = np.array([r[0] for r in rows], object)
    langs: dict[str, list[str]] = {}
    for lang in sorted(set(names.tolist())):
        langs.setdefault(family_of(lang), []).append(lang)
    families, own = sorted(langs), np.array([family_of(x) for x in names], object)
    pairs = [p for f in families for p in combinations(langs[f], 2)]
    signs = [np.where(own == f, 1, -1) if len(families) > 1 else np.zeros(len(rows), int) for f in families]
    signs += [np.where(names == a, 1, np.where(names == b, -1, 0)) for a, b in pairs]
    learnt = [_svm(rows, s, epochs, rate, 11 + k) for k, s in enumerate(signs)]
    weight = np.asfortranarray(np.stack([w for w, _ in learnt], axis=1)) if learnt else np.zeros((len(ORDERS) << BITS, 0), np.float32)
    return LanguageModel(families, langs, weight, np.array([b for _, b in learnt]), pairs)
