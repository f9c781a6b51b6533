"""Secret scans on DataFrame functions alone.

Base kinds are found by their patterns, leftmost and non-overlapping, and dropped afterwards if too short. A match's place is
the sum of what stands before it: split() gives the gaps between matches and regexp_extract_all() the matches.

The randomness battery adds spans. Every run of key characters (TOKEN) that no base span covers is a candidate. Its
encoding is inferred (hex, base 32, letters and digits, base 64), which fixes the alphabet, and three tests give p-values
for the hypothesis that it is random over it: a chi-squared test of uniform characters, a runs test about the middle of
the alphabet, and the serial correlation of neighbours. Their p-values are combined (Bonferroni); within each length
class the Benjamini-Hochberg procedure, on a histogram of log p-values of all candidates, rejects randomness at rate FDR. A
candidate that is not rejected is a secret if its class is at least 20 characters long, as the tests cannot tell shorter ones from words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds in their order, and the least lengths of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a shorter run has no longer match inside it, so the bound may stand in the pattern
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
ASSIGN_LEAST = 12

#: A candidate; the rate of false rejections; histogram steps per unit of log10 p, its least value; the last length class (of doubling lengths).
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
FDR, STEPS, FLOOR, LONGEST_CLASS = 0.05, 10, -30.0, 12
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}


SPANS = "array<struct<start: bigint, rank: int, end: bigint, kind: string, body: string>>"
#: Abramowitz and Stegun 26.2.17, the upper tail of the normal distribution.
TAIL = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def none() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """All matches in order, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda gap, body: F.struct(F.length(gap).cast("long").alias("gap"), F.length(body).cast("long").alias("long"), body.alias("body")))

    def add(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["long"]
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["body"].alias("body"))
        return F.when(x["long"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    walked = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none().alias("out")), add)
    return F.when(text.rlike(pattern), walked["out"]).otherwise(none())


def base_spans(text: Column) -> Column:
    assign = F.filter(spans_of(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["body"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(assign, spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex")))


def let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def upper_tail(z: Column) -> Column:
    """Of the standard normal distribution; never 0."""

    def of(x: Column) -> Column:
        t = 1 / (1 + 0.2316419 * x)
        series = F.lit(0.0)
        for b in reversed(TAIL):
            series = (series + b) * t
        return F.exp(-x * x / 2) / 2.5066282746310002 * series

    bounded = F.least(F.abs(z), F.lit(11.0))
    return let(bounded, lambda x: F.when(z >= 0, of(x)).otherwise(1 - of(x)))


def encoding_of(body: Column) -> Column:
    return F.when(body.rlike("^([0-9a-f-]+|[0-9A-F-]+)$"), "hex").when(body.rlike("^[A-Z2-7]+=*$"), "base32").when(body.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")



def p_value(body: Column) -> Column:
    """Of randomness over the inferred alphabet: three times the smallest of the tests' p-values, at most 1."""
    key = encoding_of(body)
    alphabet = F.coalesce(*[F.when(key == name, F.lit(letters)) for name, letters in ALPHABETS.items()])
    bare = F.when(key == "hex", F.lower(F.regexp_replace(body, "-", ""))).otherwise(F.regexp_replace(body, "=+$", ""))

    def tests(x: Column) -> Column:
        n, k = F.size(x["at"]).cast("double"), x["k"].cast("double")
        squares = F.aggregate(F.array_distinct(x["at"]), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(x["at"], lambda y: y == c)).cast("double"), 2.0))
        chi, df = squares * k / n - n, k - 1
        # The statistic's true variance over n characters is 2 * df * (n - 1) / n: short strings spread less.
        chi_p = upper_tail((chi - df) / F.sqrt(2 * df * F.greatest(n - 1, F.lit(1.0)) / n))
        pairs = F.zip_with(F.slice(x["at"], 1, F.greatest(F.size(x["at"]) - 1, F.lit(0))), F.slice(x["at"], 2, F.greatest(F.size(x["at"]) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        middle = (k - 1) / 2
        high = F.size(F.filter(x["at"], lambda y: y > middle)).cast("double")
        low = n - high
        runs = 1.0 + F.size(F.filter(pairs, lambda q: (q["a"] > middle) != (q["b"] > middle)))
        expected = 1 + 2 * high * low / n
        runs_p = F.when((high < 2) | (low < 2), 2 * F.pow(F.lit(0.5), n)).otherwise(2 * upper_tail(F.abs(runs - expected) / F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))))
        mean = F.aggregate(x["at"], F.lit(0.0), lambda acc, y: acc + y) / n
        spread = F.aggregate(x["at"], F.lit(0.0), lambda acc, y: acc + F.pow(y - mean, 2.0))
        serial = F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + (q["a"] - mean) * (q["b"] - mean))
        serial_p = F.when(spread <= 0, F.lit(0.0)).otherwise(2 * upper_tail(F.abs(serial / spread + 1 / n) * F.sqrt(n)))
        return F.least(F.lit(1.0), 3 * F.least(chi_p, runs_p, serial_p))

    parts = F.struct(F.length(alphabet).alias("k"), F.transform(F.split(bare, ""), lambda c: F.greatest(F.position(c, alphabet), F.lit(1)).cast("double") - 1).alias("at"))
    return F.when(F.length(bare) < 2, F.lit(0.0)).otherwise(let(parts, tests))


def candidates(text: Column, base: Column) -> Column:
    """Runs that no base span overlaps: start, end, cls (the length class) and bin (of the p-value's logarithm)."""
    free = F.filter(spans_of(text, TOKEN, "random"), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))

    def tested(c: Column) -> Column:
        log = F.greatest(F.log10(F.greatest(p_value(c["body"]), F.lit(1e-300))), F.lit(FLOOR))
        cls = F.least(F.floor(F.log2((c["end"] - c["start"]).cast("double"))), F.lit(LONGEST_CLASS)).cast("int")
        return F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), c["body"].alias("body"), cls.alias("cls"), F.ceil(log * STEPS).cast("int").alias("bin"))

    return F.transform(free, tested)


def rejected_up_to(df: DataFrame, text: str) -> dict[int, int]:
    """By length class the largest bin at which randomness is rejected, over all candidates of the frame.

    What reaches the driver is a row for each class and bin: LONGEST_CLASS times STEPS * -FLOOR at most.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.where(whole.rlike(TOKEN)).select(whole.alias("_text")).select("_text", base_spans(F.col("_text")).alias("_base"))
    found = rows.select(F.explode(candidates(F.col("_text"), F.col("_base"))).alias("c")).groupBy("c.cls", "c.bin").count().collect()
    out = {}
    for cls in {r.cls for r in found}:
        own = sorted((r.bin, r["count"]) for r in found if r.cls == cls)
        total, below = sum(n for _, n in own), 0
        for b, n in own:
            below += n
            if 10 ** (b / STEPS) <= FDR * below / total:
                out[cls] = b
    return out


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with two more columns, _base_spans and _random_spans: arrays of start, rank, end, kind and body.

    Null and empty texts have no spans. Rows are scanned on their own but for the rejection bounds, which are of the whole
    frame; repeated rows count as often as they occur.
    """
    bounds = rejected_up_to(df, text)
    whole = F.coalesce(F.col(text), F.lit(""))

    def of_class(cls: Column) -> Column:
        out = F.lit(-(10**6))
        for c, b in bounds.items():
            out = F.when(cls == c, F.lit(b)).otherwise(out)
        return out

    rows = df.withColumn("_base_spans", base_spans(whole))
    kept = F.filter(candidates(whole, F.col("_base_spans")), lambda c: c["bin"] > of_class(c["cls"]))
    return rows.withColumn("_random_spans", F.transform(kept, lambda c: F.struct(*[c[n].alias(n) for n in ("start", "rank", "end", "kind", "body")])))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, the number of spans of each base kind, the base spans' digest, all spans."""
    base, all_ = F.col("_base_spans"), F.array_sort(F.concat("_base_spans", "_random_spans"))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan_secrets(df.select(key, text), text).select(key, *map(of_kind, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(all_).alias("spans"))


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The frame with each secret span of the text replaced by a mark; overlapping spans share one."""
    spans = F.array_sort(F.concat("_base_spans", "_random_spans"))
    whole = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.concat(acc["out"], gap, F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole)))

    clean = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, end)
    scanned = scan_secrets(df, text)
    return scanned.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(whole)).select(*[F.col(f"`{c}`") for c in df.columns])
