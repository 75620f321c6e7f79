"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests on other long tokens.

Three fixed patterns give the base spans. A token is a run of TOKEN characters that no base span touches. Its encoding (digits, letters of one case, hex, base 32, base 36, base 62 or
base 64) follows from its characters. Three tests then ask whether it is a uniform draw from that alphabet: chi-squared counts of symbols,
runs of character classes, and the serial correlation of neighbouring symbols; the least of the three tail probabilities, times three, must
reach RANDOM_LEVEL, so what one of them finds too regular is no secret.

The same three statistics, under the hypothesis of ordinary writing, give the p-value of the false-discovery step: the pairs of equal symbols (which make up
chi-squared) are too few for letters drawn with the shares of ordinary writing, the changes of class are more than writing makes at the rate WORDY (Chernoff's
bound), and the correlation is nearer to that of random symbols than to writing's. Fisher's method combines the three. A token of one class has no
changes and lives by the other two, so it must be longer. A weighted step-up procedure over all tokens of the table, with
weights in proportion to length, holds the share of false discoveries at FALSE_SHARE. It works on a histogram of p-values
of fixed size, so no task or driver holds the tokens.

Positions count code points; ends are exclusive. Defined cases: a null text counts as empty and has no span; null ids, repeated rows and
ties are rows like others; an empty table gives an empty result; texts count whole; other columns do not matter, and ``redact``
keeps them. Matches of a text are joined in one pass over its pieces, so a text with very many matches costs the square of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, group that has a least length, least length.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
KINDS = [kind for kind, *_ in BASE] + ["random"]
#: The same matches as "a run, if it is long enough" where no shorter match can hide another one.
SEARCH = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings: pattern, alphabet, symbols of each class (letters of either case, digits, marks).
ENCODINGS = [
    ("digits", r"^[0-9]+$", DIGITS),
    ("lower", r"^[a-z]+$", LOWER),
    ("upper", r"^[A-Z]+$", UPPER),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("base62", r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
]
HEX = 1 + [name for name, *_ in ENCODINGS].index("hex")
RANDOM_LEVEL, FALSE_SHARE = 1e-3, 0.01
#: Parameters of ordinary writing: chances that two and that three letters are equal, the greatest rate of class changes, and the correlation of neighbouring letters.
PAIRS, TRIPLES, WORDY, ALONG = 0.062, 0.0050, 0.12, -0.10
#: Histogram of -log10 of weighted p-values: width of a bin, and the last one.
BIN, LAST_BIN, LAST_LENGTH = 0.05, 1200, 4096
MASK = "[redacted]"


EMPTY_SPANS = "array<struct<start:int,end:int,token:string>>"


def with_matches(df: DataFrame, name: str, pattern: str, measured: int, least: int) -> DataFrame:
    """Add ``name``: array<struct<start, end, token>> of the leftmost non-overlapping matches in ``scan_text`` whose group ``measured`` has ``least`` characters.

    The pieces between matches give their places; both are columns of their own, so that each text is searched once for either.
    """
    pieces, found = F.col(f"{name}_pieces"), F.col(f"{name}_found")
    df = df.withColumn(f"{name}_pieces", F.split("scan_text", pattern, -1))
    every = lambda group: F.regexp_extract_all("scan_text", F.lit(pattern), F.lit(group))
    df = df.withColumn(f"{name}_found", F.when(F.size(pieces) > 1, every(0)))
    sizes = F.transform(every(measured) if measured else found, F.length)
    rows = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(found)), F.length).alias("skip"), found.alias("token"), sizes.alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY_SPANS).alias("out"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + row["skip"]
        end = begin + F.length(row["token"])
        span = F.struct(begin.alias("start"), end.alias("end"), row["token"].alias("token"))
        return F.struct(end.alias("at"), F.when(row["size"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    out = F.when(F.size(pieces) > 1, F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(EMPTY_SPANS))
    return df.withColumn(name, out).drop(f"{name}_pieces", f"{name}_found")


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic fit that is right to 0.0002."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def class_rate(alphabet: str) -> float:
    """Chance that two uniform draws differ in class: lower case, upper case, digit or mark."""
    classes = [sum(c in group for c in alphabet) for group in (LOWER, UPPER, DIGITS, "+/")]
    return 1 - sum((n / len(alphabet)) ** 2 for n in classes)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def tested(tokens: Column) -> Column:
    """array<struct<start, end, n, random_p, evidence>>: places, length, the battery's probability under randomness, and -log10 of its combined one under ordinary writing.

    Each transform adds fields to all tokens, so that every value is computed once.
    """

    def adding(rows: Column, names: list[str], fields) -> Column:
        return F.transform(rows, lambda t: F.struct(*[t[n].alias(n) for n in names], *[c.alias(n) for n, c in fields(t).items()]))

    def encoding(t: Column) -> Column:
        out = F.lit(len(ENCODINGS))
        for number, (_, pattern, _) in reversed(list(enumerate(ENCODINGS, 1))[:-1]):
            out = F.when(t["body"].rlike(pattern), F.lit(number)).otherwise(out)
        return out

    of = lambda values, t: F.element_at(F.array(*[F.lit(v) for v in values]), t["enc"])
    alphabets = [alphabet for *_, alphabet in ENCODINGS]
    spans = ["start", "end"]
    rows = adding(tokens, spans, lambda t: {"body": F.translate(F.regexp_replace(t["token"], "=+$", ""), "-_", "+/")})
    rows = adding(rows, [*spans, "body"], lambda t: {"enc": encoding(t)})
    rows = adding(rows, [*spans, "enc"], lambda t: {"body": F.when(t["enc"] == HEX, F.lower(t["body"])).otherwise(t["body"]), "alphabet": of(alphabets, t), "k": of([float(len(a)) for a in alphabets], t), "rate": of([class_rate(a) for a in alphabets], t)})
    rows = adding(
        rows,
        [*spans, "k", "rate"],
        lambda t: {
            "n": F.length(t["body"]).cast("double"),
            "squares": total(F.transform(F.split(t["alphabet"], ""), lambda c: F.pow((F.length(t["body"]) - F.length(F.replace(t["body"], c, F.lit("")))).cast("double"), F.lit(2.0)))),
            "changes": F.regexp_count(F.translate(t["body"], LOWER + UPPER + DIGITS + "+/", "l" * 26 + "u" * 26 + "d" * 10 + "ss"), F.lit("l+|u+|d+|s+")).cast("double") - 1,
            "codes": F.transform(F.split(t["body"], ""), lambda c: F.instr(t["alphabet"], c).cast("double")),
        },
    )
    known = [*spans, "n", "k", "rate", "squares", "changes"]
    rows = adding(rows, [*known, "codes"], lambda t: {"mean": total(t["codes"]) / t["n"]})
    rows = adding(rows, known, lambda t: {"off": F.transform(t["codes"], lambda x: x - t["mean"])})
    rows = adding(rows, known, lambda t: {"spread": total(F.transform(t["off"], lambda x: x * x)), "along": total(F.zip_with(F.slice(t["off"], F.lit(1), F.size(t["off"]) - 1), F.slice(t["off"], F.lit(2), F.size(t["off"]) - 1), lambda x, y: x * y))})
    rows = adding(
        rows,
        [*spans, "n"],
        lambda t: {
            "z_uniform": (F.pow(F.greatest(t["k"] * t["squares"] / t["n"] - t["n"], F.lit(0.0)) / (t["k"] - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (t["k"] - 1)))) / F.sqrt(2 / (9 * (t["k"] - 1))),
            "z_runs": ((t["n"] - 1) * t["rate"] - t["changes"]) / F.greatest(F.sqrt((t["n"] - 1) * t["rate"] * (1 - t["rate"])), F.lit(1e-9)),
            "z_serial": F.when(t["spread"] > 0, F.abs(t["along"] / t["spread"] + 1 / t["n"]) * F.sqrt(t["n"])).otherwise(F.lit(99.0)),
            "share": F.least(t["changes"] / (t["n"] - 1), F.lit(1 - 1e-9)),
            "equal": (t["squares"] - t["n"]) / 2,
            "serial": F.when(t["spread"] > 0, t["along"] / t["spread"] + 1 / t["n"]).otherwise(F.lit(-1.0)),
        },
    )

    def few_pairs(t: Column) -> Column:
        """Tail of the number of pairs of equal symbols under ordinary writing, by its mean and variance."""
        n = t["n"]
        pairs, triples = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
        spread = F.sqrt(pairs * (PAIRS * (1 - PAIRS)) + 6 * triples * (TRIPLES - PAIRS**2))
        z = (pairs * PAIRS - t["equal"] - 0.5) / spread
        return F.when(z >= 0, tail(F.abs(z))).otherwise(1 - tail(F.abs(z)))

    def many_changes(t: Column) -> Column:
        s = t["share"]
        return F.when(s > WORDY, F.exp(-(t["n"] - 1) * (s * F.log(s / WORDY) + (1 - s) * F.log((1 - s) / (1 - WORDY))))).otherwise(F.lit(1.0))

    def uncorrelated(t: Column) -> Column:
        """Tail of a correlation as far towards 0 as this one, from writing's."""
        z = (-F.abs(t["serial"]) - ALONG) * F.sqrt(t["n"])
        return F.when(z >= 0, tail(F.abs(z))).otherwise(1 - tail(F.abs(z)))

    def fisher(t: Column) -> Column:
        """-log10 of the tail of Fisher's sum of three."""
        s = -(F.log(F.greatest(few_pairs(t), F.lit(1e-300))) + F.log(F.greatest(many_changes(t), F.lit(1e-300))) + F.log(F.greatest(uncorrelated(t), F.lit(1e-300))))
        return F.greatest(F.lit(0.0), (s - F.log(1 + s + s * s / 2)) / F.log(F.lit(10.0)))

    return adding(
        rows,
        spans,
        lambda t: {
            "n": t["n"].cast("int"),
            "random_p": F.least(F.lit(1.0), 3 * F.least(tail(t["z_uniform"]), tail(t["z_runs"]), 2 * tail(t["z_serial"]))),
            "evidence": fisher(t),
        },
    )


def of_kind(number: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"))


def scanned(docs: DataFrame) -> DataFrame:
    """The documents with ``scan_base`` (spans with kind numbers) and ``scan_tokens`` (tokens that no base span touches, tested)."""
    seen = docs.withColumn("scan_text", F.coalesce(F.col("text"), F.lit("")))
    parts = []
    for number, (kind, pattern, measured, least) in enumerate(BASE):
        seen = with_matches(seen, f"scan_{kind}", SEARCH.get(kind, pattern), measured, least)
        parts.append(F.transform(f"scan_{kind}", of_kind(number)))
    seen = with_matches(seen, "scan_long", TOKEN, 0, 0).withColumn("scan_base", F.array_sort(F.concat(*parts)))
    apart = F.filter("scan_long", lambda t: ~F.exists("scan_base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    seen = seen.withColumn("scan_apart", apart).withColumn("scan_tokens", tested(F.col("scan_apart")))
    return seen.drop("scan_text", "scan_long", "scan_apart", *[f"scan_{kind}" for kind, *_ in BASE])


def weighted(evidence: Column, n: Column, mean_length: Column) -> Column:
    """-log10 of a p-value divided by its weight, which is the token's length by the mean length."""
    return F.greatest(F.lit(0.0), evidence + F.log10(F.least(n, F.lit(LAST_LENGTH)) / mean_length))


def cutoff(docs: DataFrame, false_share: float = FALSE_SHARE) -> tuple[float, float]:
    """(mean length of tokens, least weighted evidence of a discovery) over the whole table; a bounded histogram of lengths and p-values is all that is gathered."""
    tokens = scanned(docs.select("text")).select(F.inline("scan_tokens"))
    fine = F.floor(F.least(F.col("evidence") / BIN, F.lit(float(LAST_BIN)))).alias("fine")
    histogram = tokens.groupBy(F.least(F.col("n"), F.lit(LAST_LENGTH)).alias("n"), fine).agg(F.count("*").alias("c"), F.sum(F.when(F.col("random_p") >= RANDOM_LEVEL, 1).otherwise(0)).alias("r")).collect()
    total = sum(x["c"] for x in histogram)
    if not total:
        return 1.0, float("inf")
    mean = sum(x["n"] * x["c"] for x in histogram) / total
    import math

    passing = [0] * (LAST_BIN + 200)
    for x in histogram:
        score = max(0.0, x["fine"] * BIN + math.log10(x["n"] / mean))
        passing[min(int(score / BIN), len(passing) - 1)] += x["r"]
    best, seen = float("inf"), 0
    for b in range(len(passing) - 1, -1, -1):
        seen += passing[b]
        if seen and math.log10(total) - b * BIN <= math.log10(false_share * seen):
            best = b * BIN
    return mean, best


def find(docs: DataFrame, mean_length: float, least: float) -> DataFrame:
    """The documents with ``scan_base`` and ``scan_spans``, both sorted arrays of struct<start, kind, end>."""
    seen = scanned(docs)
    random = F.filter("scan_tokens", lambda t: (t["random_p"] >= RANDOM_LEVEL) & (t["evidence"] > 0) & (weighted(F.floor(t["evidence"] / BIN) * BIN, t["n"], F.lit(mean_length)) >= least))
    added = F.transform(random, of_kind(len(BASE)))
    return seen.withColumn("scan_spans", F.array_sort(F.concat("scan_base", added))).drop("scan_tokens")


def listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The documents with each stretch of secrets replaced by ``mask`` (and ``n_chars`` counted anew, if it is there); every row and column stays."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"c{i}") for i, c in enumerate(names)])
    seen = find(plain, *cutoff(plain))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate("scan_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    masked = seen.withColumn("text", F.when(F.size("scan_spans") > 0, whole).otherwise(F.col("text")))
    kept = {c: F.col("text" if c == "text" else f"c{i}") for i, c in enumerate(names)}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.size("scan_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(kept["n_chars"])
    return masked.select(*[c.alias(n) for n, c in kept.items()])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, *cutoff(docs))
    count = lambda number: F.size(F.filter("scan_base", lambda s: s["kind"] == number)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)], F.sha2(listed("scan_base").cast("binary"), 256).alias("base_sha256"), listed("scan_spans").alias("spans"))
