"""Secrets by fixed patterns and a battery of randomness tests.

Base spans follow three patterns: assignments, access keys and hexadecimal runs. The method tests every run
of 16 or more characters of an encoding, those inside base spans too, and adds those that look random in the
encoding that their characters suggest (hexadecimal, base 32, letters and digits of one case, or base 64): a chi-squared statistic of alphabet uniformity, a runs test about
the middle of the alphabet, and serial correlations of lags 1 and 2 are standardised, and the sum of
their squares has nearly a chi-squared law with 4 degrees of freedom if the token is random, with tail
exp(-s/2) (1 + s/2). p-values of random tokens are even, those of words pile up at 0. In each class of
lengths (powers of 2) the upper half of the p-values tells how many tokens are random, and the
threshold is the least one at which the estimated part of other tokens among those kept is at most
`false_discoveries`. The counts behind it cover the whole corpus and are 100 numbers a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quantloom.llm.common import fresh, stored

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
_T = "A-Za-z0-9+/_=-"
#: Every candidate: a maximal run of 16 characters or more.
TOKEN = rf"[{_T}]{{16,}}"
ALPHABETS = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "0123456789abcdefghijklmnopqrstuvwxyz", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
KINDS = ("assign", "access", "hex", "random")
BINS = 100
#: Codes of the shortest token whose statistics have their laws.
LEAST = 16
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans (start, kind, end) in code points of the matches whose `group` has `least` characters or more.

    What lies between the matches and the matches themselves alternate; running lengths are positions.
    """

    def at(between: Column, match: Column, part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            a = acc["at"] + F.char_length(F.get(between, i))
            e = a + F.char_length(F.get(match, i))
            span = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
            keep = F.char_length(F.get(part, i)) >= least
            return F.struct(e.alias("at"), F.when(keep, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(match) - 1), start, step, lambda acc: acc["out"])

    p = F.lit(pattern)
    match = F.regexp_extract_all(text, p, F.lit(0))
    part = F.regexp_extract_all(text, p, F.lit(group)) if group else match
    spans = _let(F.split(text, pattern, -1), lambda b: _let(match, lambda m: at(b, m, m) if not group else _let(part, lambda g: at(b, m, g))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def _codes(token: Column, k: int) -> Column:
    plain = F.translate(F.translate(token, "=", ""), "-_", "+/") if k == 64 else F.translate(F.lower(token) if k in (16, 36) else token, "=", "")
    return F.transform(F.split(plain, ""), lambda c: (F.instr(F.lit(ALPHABETS[k]), c) - 1).cast("double"))


def statistic(v: Column, k: int) -> Column:
    """Sum of the squares of four standardised randomness statistics of the codes `v` (0 to k - 1)."""
    n = F.size(v).cast("double")
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.size(F.filter(v, lambda x: x == c)).cast("double"))
    chi = total(counts, lambda o: o * o) * k / n - n
    uniform = (chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)

    def runs(above: Column) -> Column:
        a = total(above, lambda x: x)
        b = n - a
        turns = total(F.zip_with(above, F.slice(above, F.lit(2), F.size(above)), lambda x, y: F.coalesce(F.abs(x - y), F.lit(0.0))), lambda x: x) + 1
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(var > 0, F.pow((turns - mean) / F.sqrt(var), 2)).otherwise(F.lit(25.0))

    def serial(d: Column) -> Column:
        var = total(d, lambda x: x * x)
        lag = lambda j: total(F.zip_with(d, F.slice(d, F.lit(j + 1), F.size(d)), lambda x, y: x * F.coalesce(y, F.lit(0.0))), lambda x: x)
        return F.when(var > 0, n * (F.pow(lag(1), 2) + F.pow(lag(2), 2)) / (var * var)).otherwise(F.lit(50.0))

    mean = total(v, lambda x: x) / n
    spread = _let(mean, lambda m: serial(F.transform(v, lambda x: x - m)))
    return F.pow(uniform, 2) + _let(F.transform(v, lambda x: F.when(x >= k / 2, 1.0).otherwise(0.0)), runs) + spread


def p_value(token: Column) -> Column:
    """How well a token agrees with random codes of its inferred encoding (0 to 1)."""
    one = lambda k: _let(_codes(token, k), lambda v: F.when(F.size(v) >= LEAST, statistic(v, k)))
    letters = token.rlike("[a-zA-Z]")
    s = F.when(letters & token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), one(16)).when(letters & token.rlike("^[A-Z2-7]+=*$") & token.rlike("[2-7]"), one(32))
    s = s.when(token.rlike("^([a-z0-9]+|[A-Z0-9]+)$") & letters & token.rlike("[0-9]"), one(36)).otherwise(one(64))
    return _let(F.coalesce(s, F.lit(float("inf"))), lambda x: F.when(x == float("inf"), 0.0).otherwise(F.exp(-x / 2) * (1 + x / 2)))


def thresholds(tests: DataFrame, false_discoveries: float) -> dict[int, int]:
    """For each class of lengths the least bin of p-values that is kept, from rows (length_class, bin)."""
    counts: dict[int, list[int]] = {}
    for r in tests.groupBy("length_class", "bin").count().collect():  # BINS rows for each power of 2
        counts.setdefault(r["length_class"], [0] * BINS)[r["bin"]] = r["count"]
    out = {}
    for c, by_bin in counts.items():
        random = 2 * sum(by_bin[BINS // 2 :])  # p-values of random tokens are even
        kept, least = 0, BINS
        for b in reversed(range(BINS)):
            kept += by_bin[b]
            wanted = random * (BINS - b) / BINS
            if kept and 1 - min(wanted / kept, 1) <= false_discoveries:
                least = b
        out[c] = least
    return out


def scan(docs: DataFrame, false_discoveries: float = 0.05) -> DataFrame:
    """Per row of `docs`: doc_id, base (spans of the fixed patterns) and added (spans of random tokens).

    Also n_tested and n_random: candidates and those judged random, inside base spans or not. Spans are in code
    points, end exclusive, by start, then kind; a random token that a base span holds is not added again. Null and
    empty texts have none; whole texts of any length are read. Repeated rows get equal answers. Other columns are
    not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    base = F.array_sort(F.concat(found(F.col("text"), ASSIGN, 0, 1, 12), found(F.col("text"), ACCESS, 1), found(F.col("text"), HEX, 2)))
    rows = rows.select("doc_id", base.alias("base"), "text", found(F.col("text"), TOKEN, 3).alias("tokens"))
    token = lambda t: F.substring(F.col("text"), t["start"] + 1, t["end"] - t["start"])
    tested = F.transform("tokens", lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"),
        F.floor(F.log2((t["end"] - t["start"]).cast("double"))).cast("int").alias("length_class"),
        F.least(F.floor(p_value(token(t)) * BINS), F.lit(BINS - 1)).cast("int").alias("bin"),
    ))
    rows = stored(rows.select("doc_id", "base", tested.alias("tested")), "secrets")
    least = thresholds(rows.select(F.explode("tested").alias("t")).select("t.length_class", "t.bin"), false_discoveries)
    limit = F.create_map(*(F.lit(x) for kv in least.items() for x in kv)) if least else F.create_map(F.lit(0), F.lit(BINS))
    kept = F.filter("tested", lambda t: t["bin"] >= F.coalesce(F.try_element_at(limit, t["length_class"]), F.lit(BINS)))
    rows = rows.select("doc_id", "base", F.size("tested").cast("long").alias("n_tested"), kept.alias("kept"))
    free = F.filter("kept", lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    added = F.transform(free, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return rows.select("doc_id", "base", added.alias("added"), "n_tested", F.size("kept").cast("long").alias("n_random"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mask: str = "*") -> DataFrame:
    """`docs` with every character of a found span replaced by `mask`. Rows that agree in id and text have the
    same spans, so ids need not be unique. Null texts stay null."""
    key, other = fresh(docs, "red_key", "red_spans")
    spans = scan(docs.select(F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("doc_id"), "text")).select(F.col("doc_id").alias(key), F.concat("base", "added").alias(other)).dropDuplicates([key])
    hide = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.repeat(F.lit(mask), s["end"] - s["start"]), F.substring(t, s["end"] + 1, F.length(t)))
    out = docs.withColumn(key, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")).join(spans, key, "left")
    return out.withColumn("text", F.coalesce(F.aggregate(other, F.col("text"), hide), F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns))
