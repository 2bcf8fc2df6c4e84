"""Secret scanning: three fixed patterns, and a battery of randomness tests over long tokens.

Every run of 20 or more characters of the base64 family is a candidate.  Its encoding is the
tightest that its characters without separators fit (decimal, hex, base32 and base36 of either case,
alphanumeric, base64) and its characters, as places in that alphabet, are
tested for what random data would show: chi-squared uniformity, the number of runs about the middle,
and serial correlation.  A candidate that random data would rarely give (Bonferroni over the three
tests) is no secret.  Against the other explanation, ordinary words, it has a p-value: the chance of so
many characters other than lower-case letters at the rate seen inside the corpus' long tokens.  Those
p-values go through a Benjamini-Hochberg step weighted by length, over all candidates of the corpus
(binned, so the step works on a few hundred counts).  DataFrame expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import written

# Fixed patterns of the scan.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "decimal": ("^[0-9]+$", "0123456789"),
    "hex": ("^[0-9a-f]+$", "0123456789abcdef"),
    "HEX": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "base32": ("^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    "BASE32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    "BASE36": ("^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    "alnum": ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": (None, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}


BLOCK = 1024  # code points of a text's blocks in masking
SEPARATORS = "-_="  # no data of the tightest encoding, nor evidence against words


def body_of(token: Column) -> Column:
    return F.translate(token, SEPARATORS, "")


def _unlike_words(token: Column) -> Column:
    """Characters other than lower-case letters; between separators a whole number is a word too (dates in names)."""
    numbers = F.regexp_replace(token, "(?<![A-Za-z0-9+/])[0-9]+(?![A-Za-z0-9+/])", "")
    rest = F.when(token.rlike("[A-Za-z0-9+/][-_=]+[A-Za-z0-9+/]"), numbers).otherwise(token)
    return F.length(F.translate(rest, "abcdefghijklmnopqrstuvwxyz" + SEPARATORS, ""))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, add) -> Column:
    """Running totals of a long array under ``add`` (a sum, a maximum), by doubling: n log n steps, as an
    array that an aggregate appends to would be copied for every entry."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda s: s < F.size(values))

    def once(acc: Column, s: Column) -> Column:
        ahead = F.zip_with(F.slice(acc, s + 1, F.size(acc) - s), F.slice(acc, F.lit(1), F.size(acc) - s), add)
        return F.concat(F.slice(acc, F.lit(1), s), ahead)

    return F.aggregate(steps, values, once)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>>: the leftmost non-overlapping matches, in code points.

    The texts between matches come from ``split``; running sums of lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:long,end:long,match:string>>")

    def place(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        steps = F.zip_with(gaps, matches, lambda gap, match: (F.length(gap) + F.length(match)).cast("long"))
        spans = _once(steps, lambda x: F.zip_with(_running(x, lambda a, b: a + b), matches, lambda end, match: F.struct(
            (end - F.length(match)).alias("start"), end.alias("end"), match.alias("match"))))
        return F.when(F.size(matches) > 0, spans).otherwise(empty)

    return _once(found, place)


def _tail(z: Column) -> Column:
    """P(normal > z), by a rational approximation of the error function (error under 2e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def randomness(token: Column) -> Column:
    """The battery's p-value: small if random data in the token's encoding would rarely look like it."""
    body = body_of(token)
    alphabet = F.lit(ALPHABETS["base64"][1])
    for name, (pattern, letters) in reversed(list(ALPHABETS.items())):
        if pattern:
            alphabet = F.when(body.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    state = F.struct(body.alias("body"), alphabet.alias("alphabet"))

    def places(z: Column) -> Column:
        at = F.transform(F.regexp_extract_all(z["body"], F.lit("."), F.lit(0)),
                         lambda c: (F.instr(z["alphabet"], c) - 1).cast("double"))
        return _once(F.struct(at.alias("x"), F.length(z["alphabet"]).cast("double").alias("k")), lambda s: _once(
            F.struct(s["x"].alias("x"), s["k"].alias("k"), (total(s["x"]) / F.greatest(F.size(s["x"]), F.lit(1))).alias("mean")), tests))

    def total(column: Column) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda a, b: a + b)

    def tests(s: Column) -> Column:
        x, k, mean = s["x"], s["k"], s["mean"]
        n = F.size(x).cast("double")
        squares = total(F.transform(F.array_distinct(x), lambda v: _once(
            F.size(F.filter(x, lambda y: y == v)).cast("double"), lambda c: c * c)))
        chi = k / n * squares - n
        p_uniform = _tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
        neighbours = F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), F.slice(x, F.lit(2), F.size(x) - 1).alias("b"))
        high = F.size(F.filter(x, lambda v: v >= k / 2)).cast("double")
        runs = 1 + F.size(F.filter(neighbours, lambda q: (q["a"] >= k / 2) != (q["b"] >= k / 2)))
        pairs = 2 * high * (n - high)
        spread = F.sqrt(F.greatest(pairs * (pairs - n) / (n * n * (n - 1)), F.lit(1e-9)))
        p_runs = 2 * _tail(F.abs((runs - pairs / n - 1) / spread))
        variance = total(F.transform(x, lambda v: (v - mean) * (v - mean)))
        lagged = total(F.transform(neighbours, lambda q: (q["a"] - mean) * (q["b"] - mean)))
        rho = lagged / F.greatest(variance, F.lit(1e-9))
        p_serial = 2 * _tail(F.abs((rho + 1 / n) * F.sqrt(n)))
        return F.when(n < 8, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 3 * F.least(p_uniform, p_runs, p_serial)))

    return _once(state, places)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (sorted base spans) and ``_found`` (candidates and their statistics)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    group2 = lambda m: F.regexp_extract(m, ASSIGN, 1)

    def tagged(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    spans = docs.withColumn("_assign", F.filter(match_spans(text, ASSIGN), lambda s: F.length(group2(s["match"])) >= 8))
    spans = spans.withColumn("_access", match_spans(text, ACCESS)).withColumn("_hex", match_spans(text, HEX))
    base = F.array_sort(F.concat(tagged(F.col("_assign"), 0), tagged(F.col("_access"), 1), tagged(F.col("_hex"), 2)))
    candidates = F.transform(match_spans(text, CANDIDATE), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.greatest(F.length(body_of(s["match"])), F.lit(1)).alias("n"),
        _unlike_words(s["match"]).alias("other"),
        randomness(s["match"]).alias("p_random")))
    return spans.withColumn("_base", base).withColumn("_found", candidates).drop("_assign", "_access", "_hex")


def _p_words(n: Column, other: Column, rate: Column) -> Column:
    """Chernoff bound of P(Binomial(n, rate) >= other)."""
    share = F.least(F.greatest(other / n, F.lit(1e-6)), F.lit(1 - 1e-6))
    gap = share * F.log(share / rate) + (1 - share) * F.log((1 - share) / (1 - rate))
    return F.when(share <= rate, F.lit(1.0)).otherwise(F.exp(-n * gap))


def judge(scanned: DataFrame, alpha: float = 0.01, fdr: float = 0.01) -> DataFrame:
    """``scanned`` with ``_random``: the candidates that pass the battery and the weighted step-up.

    ``alpha``: level of the battery; ``fdr``: rate of false discoveries among words.  Both statistics
    (the rate of other characters, the threshold) are over all candidates.  ``scanned`` should be a
    written table, as it is read three times.
    """
    tokens = scanned.select(F.explode("_found").alias("c")).select("c.*")
    # Ordinary words are what the battery rejects; one half is a bound for corpora of few words.
    rate = tokens.where(F.col("p_random") < alpha).agg(
        F.least(F.lit(0.5), (F.coalesce(F.sum("other"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 20)).alias("rate"),
    ).select("rate")
    mean = tokens.agg(F.coalesce(F.avg("n"), F.lit(1.0)).alias("mean")).select("mean")
    rate_value, mean_value = rate.scalar(), mean.scalar()
    # Bins of a tenth of a decade; a bin's p-value is its upper end, so binning never adds discoveries.
    weighted = lambda n, other, r, m: _p_words(n, other, r) * m / n
    to_bin = lambda p: F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-60)))), F.lit(500))
    bins = (tokens.select(to_bin(weighted(F.col("n"), F.col("other"), rate_value, mean_value)).alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("k")))
    smaller = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # over at most ~560 bins
    ranked = bins.withColumn("rank", F.sum("k").over(smaller)).withColumn("all", F.sum("k").over(Window.partitionBy()))
    ok = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("all") <= fdr * F.col("rank"))
    cut = ok.agg(F.coalesce(F.min("bin"), F.lit(10_000)).alias("cut")).select("cut").scalar()
    chosen = scanned.withColumn("_rate", rate_value).withColumn("_mean", mean_value).withColumn("_cut", cut)
    keep = lambda c: (c["p_random"] >= alpha) & (
        to_bin(weighted(c["n"], c["other"], F.col("_rate"), F.col("_mean"))) >= F.col("_cut"))
    random = F.transform(F.filter("_found", keep), lambda c: F.struct(
        c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return chosen.withColumn("_random", random).drop("_rate", "_mean", "_cut", "_found")


def _spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, alpha: float = 0.01, fdr: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` holds kind:start:end of all spans (code points, end exclusive) by start, then kind; the
    kinds are assign, access, hex (the base, hashed in ``base_sha256``) and random.  Null and empty
    texts have none; a null id stays null; repeated rows give repeated rows; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    judged = judge(written(scan(rows).drop("text"), "secret-scan"), alpha, fdr)
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return judged.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                         F.sha2(_spelled(F.col("_base")), 256).alias("base_sha256"),
                         _spelled(F.array_sort(F.concat("_base", "_random"))).alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", alpha: float = 0.01, fdr: float = 0.01, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by ``mask`` (overlapping spans by one); other texts,
    rows and columns, whatever their names, unchanged.  A null text stays null."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = judge(written(scan(packed, f"row.`{text_col}`"), "secret-mask"), alpha, fdr)
    text = F.col(f"row.`{text_col}`")
    spans = F.array_sort(F.concat("_base", "_random"))
    # The text in blocks, so that a cut far inside a long text does not start from its beginning.
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def masked(z: Column) -> Column:
        """``z``: spans in order, the largest end up to each, the text's blocks."""
        before = F.concat(F.array(F.lit(0).cast("long")), z["ends"])  # the largest end ahead of each span
        placed = F.zip_with(z["spans"], F.slice(before, F.lit(1), F.size(z["spans"])), lambda s, at: F.struct(
            at.alias("at"), s["start"].alias("start")))
        # A span that starts before the largest end overlaps one ahead of it: no second mask.
        fresh = F.filter(placed, lambda s: s["start"] >= s["at"])

        def cut(a: Column, b: Column) -> Column:
            parts = F.transform(F.sequence(F.floor(a / BLOCK), F.floor((b - 1) / BLOCK)), lambda i: F.substring(
                F.element_at(z["blocks"], (i + 1).cast("int")), (F.greatest(a - i * BLOCK, F.lit(0)) + 1).cast("int"),
                (F.least(b - i * BLOCK, F.lit(BLOCK)) - F.greatest(a - i * BLOCK, F.lit(0))).cast("int")))
            return F.when(b > a, F.array_join(parts, "")).otherwise("")

        last = F.element_at(z["ends"], -1)
        heads = F.transform(fresh, lambda s: F.concat(cut(s["at"], s["start"]), F.lit(mask)))
        return F.concat(F.array_join(heads, ""), cut(last, F.length(text).cast("long")))

    ends = _once(F.transform(spans, lambda s: s["end"]), lambda x: _running(x, lambda a, b: F.greatest(a, b)))
    state = F.struct(spans.alias("spans"), ends.alias("ends"), blocks.alias("blocks"))
    result = F.when(F.size("_base") + F.size("_random") > 0, _once(state, masked)).otherwise(text)
    return judged.select(*[(result if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
