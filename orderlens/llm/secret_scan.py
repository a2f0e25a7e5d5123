"""Secrets by patterns and by a battery of randomness tests with length-aware false-discovery control.

Long tokens that are not covered by a pattern are read as symbols of the smallest encoding that holds
them (hex, base32, letters, letters and digits, base64). Two questions are asked of each:

* Is it less likely as an ordinary token than as a random one of its encoding? Ordinary tokens follow
  a chain: the class of a symbol (lower, upper, digit, sign) depends on the class before it, and a
  letter on the letter before it. Changes of class are rare in words, identifiers, paths and dates and
  common in random hex, base32, base36, base62 and base64; letter pairs tell random letters apart. The
  ratio of the two likelihoods, times the number of encodings, bounds the probability that an ordinary
  token looks as random as this one; a small one speaks for a secret. The letter pairs are counted in
  all distinct purely alphabetic long tokens.
* Does it pass as random? Uniformity, runs about the middle of the alphabet, and serial correlation
  must not reject it, each at a third of ``REJECT``.

The first probability goes through the Benjamini-Hochberg rule within bands of length, counted in
narrow bins of the logarithm, so the rule sees every token of the corpus through a table of fixed
size. Spark functions only; texts are read once and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import stored
from .native_spans import bound, listed, matches

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "random")
#: Share of false discoveries, and the level at which the battery rejects randomness.
FALSE_DISCOVERIES, REJECT = 0.01, 0.001
#: First lengths of the bands within which discoveries are controlled.
BANDS = (16, 24, 40)
#: Bins per power of ten of a probability, and the least power that is told apart.
BINS, LEAST_POWER = 20, 20

# Possessive repetition; the matches are those of the plain patterns. ``\G`` is the end of the match before.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+"

#: Alphabets of the encodings, from the smallest; a token has the first that holds it.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64_url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "base64_any": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: Symbols of tokens in the order of their classes.
SYMBOLS = ENCODINGS["lower"] + ENCODINGS["upper"] + "0123456789" + "+/-_"
#: Chances of the class of an ordinary token's next symbol (lower, upper, digit, sign) after the start and each class.
CLASSES = ((0.60, 0.20, 0.15, 0.05), (0.93, 0.03, 0.01, 0.03), (0.35, 0.60, 0.02, 0.03), (0.04, 0.04, 0.80, 0.12), (0.60, 0.15, 0.20, 0.05))
#: Letter shares, a to z in percent, before any ordinary word is seen, and the part of them that is even.
START_LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.07)
START_EVEN = 0.2
#: Weight of the start in letters, and that of the letter shares among the letters after one letter.
START_WEIGHT, SHARES_WEIGHT = 100.0, 26.0


def tail(z: Column) -> Column:
    """Probability that a standard normal variable exceeds ``z``; relative error below some percent."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _encoding(body: Column) -> Column:
    """Name of the smallest encoding; null for numbers, which are no secrets by themselves."""
    found = F.when(body.rlike("^[0-9_+/-]*$"), F.lit(None).cast("string"))
    for name, alphabet in ENCODINGS.items():
        found = found.when(F.translate(body, alphabet, "") == "", F.lit(name))
    return found


def _battery(body: Column, encoding: Column) -> Column:
    """Statistics of a token: ``n`` symbols, alphabet ``size``, ``chi``, and the battery's ``p_uniform, p_runs, p_serial``."""
    alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in ENCODINGS.items() for x in pair]), encoding)

    def of_codes(x: Column) -> Column:
        codes, size = x["codes"], x["size"].cast("double")
        n = F.size(codes).cast("double")
        zero = F.lit(0.0)
        squares = F.aggregate(F.array_distinct(codes), zero, lambda a, c: a + F.pow(F.size(F.filter(codes, lambda d: d == c)), F.lit(2.0)))
        chi = size / n * squares - n
        free = size - 1
        # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal.
        p_uniform = tail((F.cbrt(F.greatest(chi, zero) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
        high = F.transform(codes, lambda c: (2 * c >= x["size"]).cast("int"))
        ones = F.aggregate(high, F.lit(0), lambda a, h: a + h).cast("double")
        pairs = F.zip_with(F.slice(high, F.lit(1), F.size(high) - 1), F.slice(high, F.lit(2), F.size(high) - 1), lambda a, b: (a != b).cast("int"))
        runs = 1 + F.aggregate(pairs, F.lit(0), lambda a, h: a + h).cast("double")
        expected = 1 + 2 * ones * (n - ones) / n
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        p_runs = F.least(F.lit(1.0), 2 * tail(F.abs(runs - expected) / spread))
        mean = F.aggregate(codes, zero, lambda a, c: a + c) / n
        centred = F.transform(codes, lambda c: c - mean)

        def serial(c: Column) -> Column:
            power = F.aggregate(c, zero, lambda a, v: a + v * v)
            product = F.aggregate(
                F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * b), zero, lambda a, v: a + v
            )
            r = F.when(power > 0, product / power).otherwise(1.0)
            return F.least(F.lit(1.0), 2 * tail(F.abs(r + 1 / n) * F.sqrt(n)))

        return F.struct(
            n.alias("n"), size.alias("size"), chi.alias("chi"), p_uniform.alias("p_uniform"), p_runs.alias("p_runs"), bound(centred, serial).alias("p_serial")
        )

    symbols = F.filter(F.split(body, "(?!^)"), lambda c: c != "")
    codes = F.transform(symbols, lambda c: F.call_function("instr", alphabet, c) - 1)
    return F.when(encoding.isNotNull(), bound(F.struct(codes.alias("codes"), F.length(alphabet).alias("size")), of_codes))


def _steps(body: Column) -> Column:
    """``classes``, the logarithm of the chance of an ordinary token's classes, digits and signs, and ``pairs``.

    A pair is 27 times the letter before plus the letter, with letters from 1 and 0 for anything else.
    """
    cost = {3: math.log(10), 4: math.log(4)}
    table = [math.log(p) - cost.get(k, 0.0) for row in CLASSES for k, p in enumerate(row, 1)]

    def of_codes(codes: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.slice(codes, F.lit(1), F.size(codes) - 1))
        group = lambda c: F.when(c < 0, 0).when(c < 26, 1).when(c < 52, 2).when(c < 62, 3).otherwise(4)
        letter = lambda c: F.when((c < 0) | (c >= 52), 0).when(c < 26, c + 1).otherwise(c - 25)
        classes = F.zip_with(before, codes, lambda a, b: F.get(F.lit(table), group(a) * 4 + group(b) - 1))
        pairs = F.zip_with(before, codes, lambda a, b: (letter(a) * 27 + letter(b)).cast("short"))
        return F.struct(F.aggregate(classes, F.lit(0.0), lambda a, x: a + x).alias("classes"), pairs.alias("pairs"))

    symbols = F.filter(F.split(body, "(?!^)"), lambda c: c != "")
    return bound(F.transform(symbols, lambda c: F.call_function("instr", F.lit(SYMBOLS), c) - 1), of_codes)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), m["start"], m["stop"]))


def candidates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, base, tokens`` and the columns in ``keep`` for each row: spans of the patterns, and tested tokens elsewhere."""
    kept = [F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *kept)
    text = F.col("text")
    names = [f"kept_{k}" for k in range(len(keep))]
    found = own.select(
        "doc_id",
        *names,
        matches(text, ASSIGN, F.regexp_like(text, F.lit("(?i)passw|secret|token|api_?key"))).alias("assign"),
        matches(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        matches(text, HEX).alias("hex"),
        matches(text, TOKEN).alias("token"),
    )
    value = lambda m: F.regexp_extract(m["found"], ASSIGN, 1)
    passed = {
        "assign": F.filter("assign", lambda m: F.length(value(m)) >= 6),
        "access": F.filter("access", lambda m: F.length(m["found"]) >= 20),
        "hex": F.col("hex"),
    }
    found = found.withColumn("base", F.concat(*[_spans(passed[kind], kind) for kind in KINDS[:3]]))
    free = F.filter("token", lambda m: ~F.exists("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))

    def tested(m: Column) -> Column:
        def of(x: Column) -> Column:
            read = F.when(x["plain"], F.lower(x["body"])).otherwise(x["body"])
            return F.when(
                x["encoding"].isNotNull(),
                F.struct(x["start"], x["stop"], x["encoding"], x["plain"], _steps(read).alias("steps"), _battery(read, x["encoding"]).alias("t")),
            )

        body = F.regexp_replace(m["found"], "=+$", "")
        plain = body.rlike("^[A-Z]?[a-z]+$|^[A-Z]+$")
        encoding = F.when(plain, F.lit("lower")).otherwise(_encoding(body))
        return bound(F.struct(m["start"], m["stop"], body.alias("body"), plain.alias("plain"), encoding.alias("encoding")), of)

    tokens = F.filter(F.transform(free, tested), lambda x: x.isNotNull())
    return found.select("doc_id", "base", tokens.alias("tokens"), *names)


def letter_chances(tokens: DataFrame) -> list[float]:
    """For each pair of ``_steps`` the logarithm of the letter's chance in ordinary words; 0 where it is no letter.

    Every distinct word counts once, so a copied secret does not teach its own pairs. At most 702
    counts come to the driver.
    """
    words = tokens.filter("plain").select("steps.pairs").distinct()
    counts = [0] * (27 * 27)
    for r in words.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.pair] = r.n
    start = [(1 - START_EVEN) * x / sum(START_LETTERS) + START_EVEN / 26 for x in START_LETTERS]
    seen = [sum(counts[b::27]) for b in range(1, 27)]
    shares = [(n + START_WEIGHT * p) / (sum(seen) + START_WEIGHT) for n, p in zip(seen, start, strict=True)]
    out = [0.0] * (27 * 27)
    for a in range(27):
        own = counts[27 * a + 1 : 27 * a + 27]
        for b, (n, p) in enumerate(zip(own, shares, strict=True), 1):
            out[27 * a + b] = math.log((n + SHARES_WEIGHT * p) / (sum(own) + SHARES_WEIGHT))
    return out


def random_evidence(x: Column, letters: Column) -> Column:
    """At most this share of ordinary tokens is as much likelier as a random token of some encoding.

    Under a model Q the chance that P(x) / Q(x) exceeds r is at most 1 / r for any other model P; the
    encoding is chosen by the token, so each has its part of the bound.
    """
    ordinary = x["steps"]["classes"] + F.aggregate(x["steps"]["pairs"], F.lit(0.0), lambda a, k: a + F.get(letters, k.cast("int")))
    return F.exp(F.least(F.lit(0.0), ordinary + x["t"]["n"] * F.log(x["t"]["size"].cast("double")) + math.log(len(ENCODINGS))))


def ordinary_probability(t: Column, shares: Column) -> Column:
    """Chance that letters drawn as in ordinary words are spread as evenly over the alphabet as the token's symbols.

    The chi-squared statistic of n such letters over ``size`` cells has mean
    ``size (1 - s2 + n s2) - n`` and a variance that grows with n, with s2 and s3 the sums of squared
    and cubed shares; a normal approximation gives the lower tail. It cannot tell random hex from
    letters, so it takes no part in the rule.
    """
    n, size, s2, s3 = t["n"], t["size"], shares["squares"], shares["cubes"]
    mean = size * (1 + (n - 1) * s2) - n
    variance = size * size * (4 * (n - 1) * (n - 2) * (s3 - s2 * s2) + 2 * (n - 1) * (s2 - s2 * s2)) / n
    return tail((mean - t["chi"]) / F.sqrt(F.greatest(variance, F.lit(1e-9))))


def _band(n: Column) -> Column:
    out = F.lit(0)
    for k, first in enumerate(BANDS):
        out = F.when(n >= first, k).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(10.0**-LEAST_POWER))) * BINS), F.lit(BINS * LEAST_POWER)).cast("int")


def thresholds(binned: DataFrame) -> DataFrame:
    """One row: for each band of length the least bin that the Benjamini-Hochberg rule accepts.

    ``binned`` has ``band, bin, n``, at most three bands times some hundred bins. A bin counts with
    its largest probability, so the rule is at most a twentieth of a power of ten too strict.
    """
    row = binned.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("all"))

    def accepted(b: Column) -> Column:
        above = F.aggregate(F.filter("bins", lambda x: x["bin"] >= b["bin"]), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.pow(F.lit(10.0), -b["bin"] / BINS) <= FALSE_DISCOVERIES * above / F.col("all")

    least = F.array_min(F.transform(F.filter("bins", accepted), lambda b: b["bin"]))
    return row.select("band", least.alias("least")).agg(F.map_from_entries(F.collect_list(F.struct("band", "least"))).alias("least"))


def find_spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, base, added`` for each row of documents: arrays of ``struct<kind, rank, start, stop>``.

    Columns in ``keep`` come along as ``kept_0``, ``kept_1`` and so on, and are written too.

    Base spans always stay. A tested token is added as ``random`` if the false-discovery rule of its
    band accepts it and the battery does not reject randomness; tokens that touch a base span are not
    tested. Positions are code points, ``stop`` exclusive. A null text counts as empty, a null
    ``doc_id`` stays null, repeated rows each get their result and count in the statistics, equal
    probabilities share their fate, other columns are not read. Texts are searched whole, however
    long; an empty table gives no rows. What was found, without the texts,
    is written once to the shared folder.
    """
    found = stored(candidates(docs, keep), "secret-candidates")
    tokens = found.select(F.explode("tokens").alias("x")).select("x.*")
    letters = F.lit(letter_chances(tokens))
    judged = found.select(F.explode(F.transform("tokens", lambda x: F.struct(_band(x["t"]["n"]).alias("band"), _bin(random_evidence(x, letters)).alias("bin")))).alias("x")).select("x.*")
    least = thresholds(judged.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))).scalar()

    def random(x: Column) -> Column:
        t = x["t"]
        accepted = _bin(random_evidence(x, letters)) >= F.coalesce(F.element_at("least", _band(t["n"])), F.lit(BINS * LEAST_POWER + 1))
        return accepted & (F.least(t["p_uniform"], t["p_runs"], t["p_serial"]) >= REJECT / 3)

    added = _spans(F.filter("tokens", random), KINDS[3])
    return found.withColumn("least", least).select(
        "doc_id", "base", added.alias("added"), *[f"kept_{k}" for k in range(len(keep))]
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Documents with each secret, overlapping ones together, replaced by ``mark``; the columns stay as they are."""
    names = docs.columns
    found = find_spans(docs, tuple(names)).withColumnRenamed("doc_id", "_id")
    renamed = found.withColumnsRenamed({f"kept_{k}": c for k, c in enumerate(names)})
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["stop"])))
    start = F.struct(F.lit(0).alias("to"), F.array().cast("array<string>").alias("parts"))
    text = F.col("text")

    def taken(a: Column, s: Column) -> Column:
        part = F.when(s["start"] >= a["to"], F.concat(F.substring(text, a["to"] + 1, s["start"] - a["to"]), F.lit(mark)))
        parts = F.when(part.isNull(), a["parts"]).otherwise(F.concat(a["parts"], F.array(part)))
        return F.struct(F.greatest(a["to"], s["stop"]).alias("to"), parts.alias("parts"))

    def whole(a: Column) -> Column:
        return F.concat(F.array_join(a["parts"], ""), F.substring(text, a["to"] + 1, F.length(text)))

    clean = F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, taken, whole))
    return renamed.withColumn("text", clean).select(*[f"`{c}`" for c in names])


def secret_digest(docs: DataFrame) -> DataFrame:
    """The spans as counts, a digest of the base ones and a list of all."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_spans(docs).select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
