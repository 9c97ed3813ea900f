"""Secret scan: fixed patterns and a randomness test battery, in DataFrame operations only.

Long tokens that mix letters and digits are candidates. The encoding is inferred from their characters. What is tested
is that a token is *not* random in that alphabet: that its characters are as uneven as UNEVEN or more (chi-squared over
eight equal bins), that its runs above and below the middle are off by RUNS_OFF of their number or more, or that its
lag-one serial correlation is SERIAL or more. Only a token that refutes all three is a secret, so its p-value is the
largest of the three; within each class of lengths the Benjamini-Hochberg step-up over all candidates of the corpus
bounds the expected share of such non-random tokens among those reported. Short tokens can refute little, and are not
reported unless many candidates of their class do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import cut, pick, text_or_empty

#: kind, pattern, gate: fixed values of the query's contract. The gates are necessary conditions, cheap to look for.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
LENGTH_CLASSES = (28, 40, 64, 96, 160, 320)
_BINS = 8
#: How far from random a token is that is none: the sum of (share - 1/8)**2 / (1/8) over the bins, the share of runs too
#: many or too few, and the serial correlation.
UNEVEN, RUNS_OFF, SERIAL = 0.5, 0.5, 0.5
_STEPS = 16  # p-values are rounded up to a power of two to the 1/16, by 4.5 % at most, which bounds the histogram
_LEAST_BIN = -1000 * _STEPS


def _running(lengths: Column, kind: int, empty: Column, block: int = 256) -> Column:
    """Spans from (gap, size, match): running sums within blocks, and then over the blocks, as appending to one array is
    quadratic in its length."""

    def of_block(held: Column) -> Column:
        return F.aggregate(
            held,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["size"]).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + x["size"]).alias("end"), x["match"].alias("match"))).alias("out"),
            ),
        )

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["match"].alias("match")))

    def over(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,kind:int,end:int,match:string>>>").alias("out"))
        return F.flatten(F.aggregate(blocks, begin, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], shifted(b["out"], acc["at"])).alias("out")))["out"])

    def cut_up(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda k: of_block(F.slice(x, k * block + 1, block)))
        return F.when(F.size(x) > 0, over(blocks)).otherwise(empty)

    return F.transform(F.array(lengths), cut_up)[0]


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """The matches, leftmost and without overlap, as structs (start, kind, end, match): what lies between them comes
    from a split by the same pattern, so places are running sums of lengths in code points."""
    parts, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.slice(parts, 1, F.size(matches)), matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size"), match.alias("match")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    return F.when(text.rlike(pattern), _running(lengths, kind, empty)).otherwise(empty)


def _tail(z: Column) -> Column:
    """An upper bound of P(Z > z) for z > 0, less than 1 % too large beyond 1; 1 for other z."""
    return F.when(z > 0, F.least(F.lit(1.0), F.exp(F.greatest(-z * z / 2, F.lit(-690.0))) * (4 / math.sqrt(2 * math.pi)) / (3 * z + F.sqrt(z * z + 8)))).otherwise(1.0)


def p_value(token: Column) -> Column:
    """The p-value of the battery under "not random in the inferred alphabet"."""
    alphabet = F.coalesce(*[F.when(token.rlike(pattern), F.lit(letters)) for _, pattern, letters in ALPHABETS], F.lit(ALPHABETS[-2][2]))
    stripped = F.regexp_replace(token, "[=]+", "")
    return F.transform(
        F.array(F.struct(alphabet.alias("a"), F.split(stripped, "").alias("c"))),
        lambda s: _battery(F.filter(F.transform(s["c"], lambda c: F.instr(s["a"], c) - 1), lambda v: v >= 0), F.length(s["a"])),
    )[0]


def _battery(values: Column, size: Column) -> Column:
    return F.transform(F.array(F.struct(values.alias("v"), size.alias("m"), F.size(values).cast("double").alias("n"))), lambda s: _largest(s["v"], s["m"], s["n"]))[0]


def _largest(v: Column, m: Column, n: Column) -> Column:
    def total(array: Column, of) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + of(x))

    expected = n / _BINS
    observed = F.transform(F.sequence(F.lit(0), F.lit(_BINS - 1)), lambda b: F.size(F.filter(v, lambda x: F.floor(x * _BINS / m) == b)).cast("double"))
    chi = total(observed, lambda o: (o - expected) * (o - expected) / expected)
    # noncentral chi-squared with n * UNEVEN, by the cube-root transform (Abdel-Aty)
    degrees, away = _BINS - 1.0, n * UNEVEN
    centre, spread_by = degrees + away, 1 + away / (degrees + away)
    variance_of_root = 2 * spread_by / (9 * centre)
    p_chi = _tail((1 - variance_of_root - F.pow(chi / centre, F.lit(1 / 3))) / F.sqrt(variance_of_root))

    upper = total(v, lambda x: F.when(x * 2 >= m, 1.0).otherwise(0.0))
    lower = n - upper
    places = F.sequence(F.lit(2), F.greatest(F.size(v), F.lit(2)))
    turns = total(places, lambda i: F.when((F.get(v, i - 1) * 2 >= m) != (F.get(v, i - 2) * 2 >= m), 1.0).otherwise(0.0)) + 1.0
    mean_runs = 2 * upper * lower / n + 1
    spread = (mean_runs - 1) * (mean_runs - 2) / F.greatest(n - 1, F.lit(1.0))
    p_runs = F.when(spread > 0, _tail((RUNS_OFF * mean_runs - F.abs(turns - mean_runs)) / F.sqrt(spread))).otherwise(1.0)

    middle = (m - 1) / 2.0
    variance = total(v, lambda x: (x - middle) * (x - middle)) / n
    lagged = total(places, lambda i: F.coalesce((F.get(v, i - 1) - middle) * (F.get(v, i - 2) - middle), F.lit(0.0))) / n
    p_serial = F.when(variance > 0, _tail((SERIAL - F.abs(lagged / variance)) * F.sqrt(n))).otherwise(1.0)
    return F.when(n < 8, 1.0).otherwise(F.greatest(p_chi, p_runs, p_serial))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_discovery: float = 0.05) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind; base kinds are found by pattern,
    `random` ones are the candidates for which the test battery refutes that they are not random, with an expected share of
    false ones of `false_discovery` at most. Null and empty texts have no spans (the
    digest is that of the empty string). Rows are judged one by one, so ids may repeat or be null; an empty table
    gives an empty result; other columns of the input are ignored.
    """
    text = F.col("text")
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    assign = F.filter(_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LENGTH)
    rows = cut(
        pick(docs, doc_id=id_col, text=text_col)
        .select("doc_id", text_or_empty().alias("text"))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            bare(assign).alias("assign"),
            bare(_spans(text, ACCESS, 1)).alias("access"),
            bare(_spans(text, HEX, 2)).alias("hex"),
            F.filter(_spans(text, CANDIDATE, 3), lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]")).alias("candidates"),
        )
    )
    stratum = F.lit(0)
    for at in LENGTH_CLASSES:
        stratum = stratum + (F.col("end") - F.col("start") >= at).cast("int")
    p = F.greatest(F.ceil(F.log2(F.greatest(p_value(F.col("match")), F.lit(1e-300))) * _STEPS), F.lit(_LEAST_BIN))
    tested = cut(rows.select("row", F.inline("candidates")).select("row", "start", "kind", "end", stratum.alias("stratum"), p.cast("int").alias("bin")))

    # Benjamini-Hochberg from a histogram, of a row for each length class and step of p at most
    below = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    histogram = tested.groupBy("stratum", "bin").agg(F.count("*").alias("n")).withColumn("rank", F.sum("n").over(below)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    refuted = histogram.filter(F.pow(F.lit(2.0), F.col("bin") / _STEPS) * F.col("all") <= false_discovery * F.col("rank")).groupBy("stratum").agg(F.max("bin").alias("cut"))
    random = tested.join(F.broadcast(refuted), "stratum").filter("bin <= cut").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("random"))

    base = F.concat("assign", "access", "hex")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.join(random, "row", "left").select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.size(F.coalesce("random", none)).cast("long").alias("n_random"),
        F.sha2(_named(base), 256).alias("base_sha256"),
        _named(F.concat(base, F.coalesce("random", none))).alias("spans"),
    )
