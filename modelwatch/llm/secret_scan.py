"""Secret scans with a battery of randomness tests (operator 10). DataFrame operations only.

Three patterns find secrets by their form: assignments, access keys, long hexadecimal runs. The method adds
strings that look random: every run of 16 or more characters of the base64 alphabets with a letter and a digit is a
candidate. Its encoding (hexadecimal, base32, one-case letters and digits, base64) is inferred from
its characters; as values of that alphabet the characters are tested for uniformity (chi-squared over eight
classes), for runs above and below the middle, and for serial correlation. Three times the smallest p is the candidate's p.
In each class of length, false discovery control (Benjamini-Hochberg over p in thousandths, all candidates counted)
finds those that are not random. The others are reported. The rate of a class is also the share of truly random strings that may be lost to it, however many others
there are; the shortest class, where one string in twenty has no digit and so is no candidate, is given a lower one.

Spans are half-open, in code points. Results for odd input: null counts as empty; no spans give the hash of the
empty string; equal texts have equal spans; repeated rows stay; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
KINDS = ["assign", "access", "hex", "random"]
#: Span kinds are numbered as in KINDS, so that spans sort by start, then kind.
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Length classes (from, false discovery rate).
LENGTHS = [(16, 0.03), (20, 0.05), (32, 0.05), (64, 0.05)]
BINS = 1000
#: Candidates that one task tests.
TOKENS_A_TASK = 10_000
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ALPHABETS = [("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
             ("upper hex", r"^[0-9A-F]+$", "0123456789ABCDEF"), ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
             ("lower", r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"), ("upper", r"^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
             ("base64", "", B64)]


def matches(text: Column, gate: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters or more.

    The pieces between the matches give the places; a pattern of whole runs may state their least length itself. ``gate`` is found wherever a match is kept; texts without it are passed over.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.slice(F.transform(F.split(text, pattern, -1), F.char_length), 1, F.size(whole)).alias("gap"),
                         F.transform(whole, F.char_length).alias("len"), F.transform(part, F.char_length).alias("size"))
    empty = F.array().cast(SPAN)

    def add(acc: Column, s: Column) -> Column:
        start = acc["pos"] + s["gap"]
        span = F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), (start + s["len"]).cast("int").alias("end"))
        return F.struct((start + s["len"]).cast("int").alias("pos"), F.when(s["size"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    named = F.transform(steps, lambda s: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), s["size"].alias("size")))
    found = F.aggregate(named, F.struct(F.lit(0).alias("pos"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(gate), found).otherwise(empty)


def base_spans(text: Column) -> list[Column]:
    return [matches(text, ASSIGN[:-2] + "{12})", ASSIGN, 0, 2, 12),
            matches(text, ACCESS[:-1] + "{14}", ACCESS[:-1] + "{14,}", 1),
            matches(text, HEX[:-1] + "{16}", HEX[:-1] + "{16,}", 2)]


def tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a fixed polynomial (absolute error below 1e-7)."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.2316419)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def total(values: Column, fn) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + fn(x).cast("double"))


def with_p(tokens: DataFrame) -> DataFrame:
    """``tokens`` (token, ...) plus p: three times the smallest p of the battery, at most 1."""
    alphabet = F.lit(ALPHABETS[-1][2])
    for _, form, letters in reversed(ALPHABETS[:-1]):
        alphabet = F.when(F.col("token").rlike(form), letters).otherwise(alphabet)
    plain = F.translate("token", "-_", "+/")
    rows = tokens.withColumn("letters", alphabet).withColumn("n", F.length("token")).withColumn("k", F.length("letters"))
    rows = rows.withColumn("v", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.position(F.substring(plain, i, F.lit(1)), F.col("letters")) - 1))
    n, k, v = F.col("n"), F.col("k"), F.col("v")
    chi = F.lit(0.0)
    for b in range(8):
        expected = n * (F.ceil(k * (b + 1) / 8) - F.ceil(k * b / 8)) / k
        seen = total(v, lambda x: F.floor(x * 8 / k) == b)  # noqa: B023
        chi = chi + (seen - expected) * (seen - expected) / expected
    df = 7.0
    uniform = tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
    high = F.transform(v, lambda x: (x * 2 >= k).cast("int"))
    ones = total(high, lambda x: x)
    zeros = n - ones
    runs = 1 + total(F.arrays_zip(F.slice(high, F.lit(1), n - 1).alias("a"), F.slice(high, F.lit(2), n - 1).alias("b")), lambda s: F.abs(s["a"] - s["b"]))
    mean = 2 * ones * zeros / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    run_p = F.when(spread > 0, 2 * tail(F.abs(runs - mean) / F.sqrt(spread))).otherwise(0.0)
    middle = total(v, lambda x: x) / n
    square = total(v, lambda x: (x - middle) * (x - middle))
    pairs = F.arrays_zip(F.slice(v, F.lit(1), n - 1).alias("a"), F.slice(v, F.lit(2), n - 1).alias("b"))
    serial = F.when(square > 0, 2 * tail(F.abs(total(pairs, lambda s: (s["a"] - middle) * (s["b"] - middle)) / square * F.sqrt(n)))).otherwise(0.0)
    return rows.withColumn("p", F.least(F.lit(1.0), 3 * F.least(uniform, run_p, serial))).drop("letters", "n", "k", "v")


def length_class() -> Column:
    out = F.lit(0)
    for i, (least, _) in enumerate(LENGTHS):
        out = F.when(F.length("token") >= least, i).otherwise(out)
    return out


def random_limits(tested: DataFrame) -> list[int]:
    """For each length class the bin of p up to which a candidate counts as not random (-1: none).

    Benjamini-Hochberg on bins: the last bin whose upper edge is at most rate * (candidates up to it) / (all). At most
    4 * 1001 counts reach the driver.
    """
    counts = {(r["band"], r["bin"]): r["n"] for r in tested.groupBy("band", "bin").agg(F.count("*").alias("n")).collect()}
    limits = []
    for band, (_, rate) in enumerate(LENGTHS):
        mine = sorted((b, n) for (c, b), n in counts.items() if c == band)
        whole, upto, limit = sum(n for _, n in mine), 0, -1
        for b, n in mine:
            upto += n
            if (b + 1) / BINS <= rate * upto / whole:
                limit = b
        limits.append(limit)
    return limits


def random_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(tid, random): the spans of random strings of each text that has any, keyed by the md5 of the text."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hits = docs.select(body.alias("body")).where(F.col("body").rlike(CANDIDATE))
    spans = hits.select(F.md5("body").alias("tid"), "body", F.explode(matches(F.col("body"), CANDIDATE, CANDIDATE, 3)).alias("s"))
    tokens = spans.select("tid", "s", F.expr("substring(body, s.start + 1, s.end - s.start)").alias("token")).where(
        F.col("token").rlike("[A-Za-z]") & F.col("token").rlike("[0-9]"))
    different = stored(tokens.distinct(), "tokens")
    different = different.repartition(max(1, different.count() // TOKENS_A_TASK))  # small rows, but much work each
    tested = with_p(different).withColumn("band", length_class()).withColumn("bin", F.floor(F.col("p") * BINS))
    tested = stored(tested.select("tid", "s", "band", "bin"), "tested")
    limits = random_limits(tested)
    limit = F.lit(-1)
    for band, value in enumerate(limits):
        limit = F.when(F.col("band") == band, value).otherwise(limit)
    return stored(tested.where(F.col("bin") > limit).groupBy("tid").agg(F.array_sort(F.collect_list("s")).alias("random")), "random")


def with_spans(rows: DataFrame, random: DataFrame) -> DataFrame:
    """``rows`` (tid, assign, access, hex, ...) plus base and spans, sorted; a random span inside a base span adds nothing."""
    met = rows.join(random.withColumnRenamed("tid", "random_tid"), F.col("tid") == F.col("random_tid"), "left")
    met = met.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    extra = F.filter(F.coalesce("random", F.array().cast(SPAN)), lambda r: ~F.exists(
        F.col("base"), lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])))
    return met.withColumn("spans", F.array_sort(F.concat("base", extra))).drop("random", "random_tid")


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: str, mark: str) -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans share one."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        sign = F.when((s["start"] >= acc["pos"]), F.lit(mark)).otherwise("")
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], gap, sign).alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str = "n_chars") -> DataFrame:
    """``docs`` with all secrets replaced by ``mark``; the ``length`` column, if there is one, follows. Null texts stay null."""
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    assign, access, hexa = base_spans(body)
    rows = packed.select("row", F.md5(body).alias("tid"), assign.alias("assign"), access.alias("access"), hexa.alias("hex"))
    met = with_spans(rows, random_spans(docs, text))
    new = redacted(F.col(f"row.`{text}`"), "spans", mark)
    values = {text: new} | ({length: F.when(F.size("spans") > 0, F.char_length(new)).otherwise(F.col(f"row.`{length}`"))} if length in own else {})
    kinds = dict(docs.dtypes)
    return met.select(*[values.get(c, F.col(f"row.`{c}`")).cast(kinds[c]).alias(c) for c in own])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    assign, access, hexa = base_spans(body)
    rows = docs.select("doc_id", F.md5(body).alias("tid"), assign.alias("assign"), access.alias("access"), hexa.alias("hex"))
    found = with_spans(rows, random_spans(docs))
    return found.select("doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
                        F.size("hex").cast("long").alias("n_hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
