"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Every candidate span of a kind gets five votes (no, abstain, yes): strict shape, checksum or number
range, gazetteer, words around it, clean borders. The distinct vote patterns with their counts (at
most kinds times 3**5, whatever the corpus) go into one row, on which expectation-maximisation runs
as SQL array functions and gives each pattern its probability. These soft labels of all candidates
train a naive Bayes classifier over votes and shape features, whose decision adds spans to the base
ones. Spark functions only; texts are read once and never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import stored
from .native_spans import bound, listed, matches

NO, ABSTAIN, YES = 0, 1, 2
LABELERS = 5
#: Rounds of EM, and the pseudo-observations that hold each labeler near its starting reliability.
ROUNDS, ANCHOR = 25, 20.0
#: The share of votes a labeler is expected to give to true and to false spans: no, abstain, yes.
START_TRUE, START_FALSE = (0.05, 0.25, 0.7), (0.6, 0.3, 0.1)
#: Probability from which the classifier adds a span.
THRESHOLD = 0.9

# Gazetteers. Common top-level domains, country calling codes of one and two digits,
# titles before a name, first names.
TOP_LEVEL = "com org net edu gov mil int io co info biz us uk de fr es it nl eu ch at be pl se no fi dk pt ie ca au jp cn in br mx"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
FIRST_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Paul Marie Hans Jean Luis Carmen"

#: Words near a span that speak for any number or code that is not personal.
AGAINST = r"(?i)\b(?:version|isbn|issn|order|invoice|sku|part no|page|chapter|section|build|revision|license)\b"


@dataclass(frozen=True)
class Kind:
    """A kind of span: where candidates are, and what its labelers look for. Conditions are SQL."""

    name: str
    pattern: str
    guard: str  #: condition on ``text`` that is cheaper than the pattern and necessary
    base: str | None  #: condition on a match ``x`` under which it counts by itself
    strict: str  #: regex of the usual shape
    number: str | None  #: condition on ``x``: checksum or range
    gazetteer: str | None  #: condition on ``x``
    near: str  #: regex of words around


_DIGITS = "regexp_replace(x.found, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Sum of the digits from the right, every second one doubled and reduced, is a multiple of ten."""
    digit = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    doubled = f"(2 * {digit} - if({digit} > 4, 9, 0))"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + if(i % 2 = 1, {doubled}, {digit})) % 10 = 0"


def _among(value: str, words: str) -> str:
    return f"array_contains(array({', '.join(repr(w) for w in words.split())}), {value})"


# Possessive repetition throughout. ``\\G`` is the end of the match before; with it and the look-behind
# a match begins where a run of its first characters begins, so long runs take linear time. The
# matches are those of the plain patterns.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_LOCAL = r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])"
_SPELLED = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+"
    r"(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,63}+){1,5}+"
)
_PERSON = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?+"

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP_VALID = f"x.found rlike r'^(?:{_PART}[.]){{3}}{_PART}$'"
_CARD_VALID = f"if(length({_DIGITS}) between 14 and 19, {_luhn(_DIGITS)}, false)"
_PHONE_VALID = f"length({_DIGITS}) between 10 and 15"
_ENDS_IN_DOMAIN = _among("lower(regexp_extract(x.found, r'([A-Za-z0-9-]+)$', 1))", TOP_LEVEL)
_MAIL_WORDS, _PHONE_WORDS = "e-?mail|mail|contact|write|reach", "phone|tel|call|mobile|cell|fax|sms"

#: In the order in which spans of one start are listed.
KINDS = (
    Kind(
        "email", _EMAIL, "contains(text, '@')", "true",
        "^[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]++$", "length(x.found) <= 254", _ENDS_IN_DOMAIN, _MAIL_WORDS,
    ),
    Kind(
        "ip", _IP, "text rlike '[0-9][.][0-9]'", _IP_VALID,
        "^(?:[0-9]{1,3}[.]){3}[0-9]{1,3}$", _IP_VALID, "not (x.found rlike '^(?:0|22[4-9]|2[3-5][0-9])[.]')", "ip|host|server|address|login|ssh|from",
    ),
    Kind(
        "card", _CARD, "text rlike '[0-9][ -]?[0-9]'", _CARD_VALID,
        "^(?:[0-9]{4}[ -]?){3}[0-9]{1,7}$|^3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}$", _CARD_VALID,
        f"{_DIGITS} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)[0-9]{{11,18}}$'", "card|visa|mastercard|amex|credit|debit|payment",
    ),
    Kind(
        "phone", _PHONE, "contains(text, '+')", _PHONE_VALID,
        "^[+][0-9]{1,3}[ .-]?(?:[(][0-9]{1,4}[)]|[0-9]{1,4})(?:[ .-]?[0-9]{2,5}){1,4}$", _PHONE_VALID,
        f"({_among('substring(x.found, 2, 1)', CALLING)} or {_among('substring(x.found, 2, 2)', CALLING)})", _PHONE_WORDS,
    ),
    Kind(
        "ssn", _SSN, "text rlike '[0-9]-[0-9]{2}-[0-9]'", None,
        "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "not (x.found rlike '^(?:000|666|9)|-00-|0000$')", None, "ssn|social security",
    ),
    Kind(
        "local_phone", _LOCAL, "text rlike '[0-9][ .-][0-9]{4}'", None,
        r"^[(][0-9]{3}[)]|^[0-9]{3}([.-])[0-9]{3}\1", "not (x.found rlike '^[(]?[01]')", None, _PHONE_WORDS,
    ),
    Kind(
        "iban", _IBAN, "text rlike '[A-Z]{2}[0-9]{2}'", None,
        "^[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "length(replace(x.found, ' ', '')) between 15 and 34",
        _among("substring(x.found, 1, 2)", "AT BE CH DE DK ES FI FR GB IE IT NL NO PL PT SE"), "iban|account|bank|konto",
    ),
    Kind("spelled_email", _SPELLED, "text rlike '[(\\\\[]at[)\\\\]]'", None, r"[\[(]dot[\])]", None, _ENDS_IN_DOMAIN, _MAIL_WORDS),
    Kind(
        "person", _PERSON, "text rlike '(?:Mr|Mrs|Ms|Dr|Prof)[.]? '", None,
        " [^ ]+ [^ ]+$", None, _among("regexp_extract(x.found, '^[A-Za-z]+[.]? ([^ ]+)', 1)", FIRST_NAMES), "name|patient|born|customer|signed|dear",
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _vote(yes: str | None, no: str | None) -> str:
    if yes is None:
        return f"{ABSTAIN}"
    return f"case when {yes} then {YES} when {no or f'not ({yes})'} then {NO} else {ABSTAIN} end"


def _candidates(kind: Kind, rank: int) -> str:
    """SQL for the candidates of a kind from its matches ``m_<kind>``."""
    around = "concat(x.before, ' ', x.after)"
    votes = [
        _vote(f"x.found rlike r'{kind.strict}'", None),
        _vote(kind.number, None),
        _vote(kind.gazetteer, None),
        _vote(rf"{around} rlike r'(?i)\b(?:{kind.near})\b'", f"{around} rlike r'{AGAINST}'"),
        _vote("not (x.before rlike r'[\\p{L}\\p{N}]$' or x.after rlike r'^[\\p{L}\\p{N}]')".replace("\\\\", "\\"), None),
    ]
    features = [
        f"'kind={kind.name}'",
        "concat('length=', least(floor(length(x.found) / 4), 10))",
        "concat('digits=', floor(4 * length(regexp_replace(x.found, '[^0-9]', '')) / length(x.found)))",
        "concat('before=', case when x.before = '' then 'none' when x.before rlike '[ \\\\n]$' then 'space' else 'mark' end)",
        "concat('after=', case when x.after = '' then 'none' when x.after rlike '^[ \\\\n.,]' then 'space' else 'mark' end)",
    ]
    return (
        f"transform(m_{kind.name}, x -> named_struct('kind', '{kind.name}', 'rank', {rank}, 'start', x.start, 'stop', x.stop,"
        f" 'base', {kind.base or 'false'}, 'votes', array({', '.join(votes)}), 'features', array({', '.join(features)})))"
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for each row: all candidate spans with their votes and features."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    matched = own.select("doc_id", *[matches(F.col("text"), k.pattern, F.expr(k.guard)).alias(f"m_{k.name}") for k in KINDS])
    return matched.select("doc_id", F.concat(*[F.expr(_candidates(k, i)) for i, k in enumerate(KINDS)]).alias("spans"))


def _probability(pattern: Column, state: Column) -> Column:
    """Of a vote pattern (``k``, ``votes``) being a true span."""
    log = F.aggregate(
        F.transform(pattern["votes"], lambda v, i: F.log(F.get(state["yes"], i * 3 + v)) - F.log(F.get(state["no"], i * 3 + v))),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    prior = F.get(state["prior"], pattern["k"])
    return 1 / (1 + F.exp(F.log(1 - prior) - F.log(prior) - log))


def _reliability(found: Column, weight, start: tuple[float, ...]) -> Column:
    """A labeler's shares of votes (no, abstain, yes) among spans weighted by ``weight``, flattened over labelers."""
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(3 * LABELERS - 1)),
        lambda j: F.get(F.array(*[F.lit(ANCHOR * s) for s in start]), j % 3)
        + F.aggregate(
            found,
            F.lit(0.0),
            lambda a, x: a + F.when(F.get(x["votes"], F.floor(j / 3).cast("int")) == j % 3, x["n"] * weight(x)).otherwise(0.0),
        ),
    )
    return bound(sums, lambda s: F.transform(s, lambda x, j: x / _three(s, j)))


def _three(sums: Column, j: Column) -> Column:
    first = (j - j % 3).cast("int")
    return F.get(sums, first) + F.get(sums, first + 1) + F.get(sums, first + 2)


def pattern_probabilities(spans: DataFrame) -> DataFrame:
    """One row with ``probability``: a map from a vote pattern to the chance that it marks a true span.

    Expectation-maximisation over conditionally independent labelers: each round gives every pattern
    its probability, then re-estimates the share of true spans of each kind and what each labeler
    votes on true and on false spans. The row holds the distinct patterns only.
    """
    patterns = spans.groupBy(F.col("rank").alias("k"), "votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    row = patterns.agg(F.array_sort(F.collect_list(F.struct("k", "votes", "n"))).alias("found"))
    flat = lambda shares: F.array(*[F.lit(s) for _ in range(LABELERS) for s in shares])
    start = F.struct(F.array(*[F.lit(0.5)] * len(KINDS)).alias("prior"), flat(START_TRUE).alias("yes"), flat(START_FALSE).alias("no"))

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform(F.col("found"), lambda x: F.struct(x["k"], x["votes"], x["n"], _probability(x, state).alias("p")))

        def maximised(found: Column) -> Column:
            def share(k: Column) -> Column:
                of = F.filter(found, lambda x: x["k"] == k)
                true = F.aggregate(of, F.lit(1.0), lambda a, x: a + x["n"] * x["p"])
                return true / F.aggregate(of, F.lit(2.0), lambda a, x: a + x["n"])

            return F.struct(
                F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), share).alias("prior"),
                _reliability(found, lambda x: x["p"], START_TRUE).alias("yes"),
                _reliability(found, lambda x: 1 - x["p"], START_FALSE).alias("no"),
            )

        return bound(weighed, maximised)

    fitted = row.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step))
    key = lambda x: F.concat_ws(":", x["k"], F.array_join(F.transform(x["votes"], lambda v: v.cast("string")), ""))
    return fitted.select(
        F.map_from_entries(F.transform("found", lambda x: F.struct(key(x), _probability(x, F.col("state"))))).alias("probability")
    )


def feature_scores(spans: DataFrame, probability: DataFrame) -> DataFrame:
    """One row with ``score``: log ratio of each vote and feature among true and among false spans.

    The classifier is naive Bayes on the soft labels of all candidates. Its table has one row for
    each value of a vote or feature, about a hundred.
    """
    key = F.concat_ws(":", F.col("rank"), F.array_join(F.transform("votes", lambda v: v.cast("string")), ""))
    labelled = spans.groupBy(key.alias("key"), _all_features().alias("features")).agg(F.count(F.lit(1)).alias("n"))
    labelled = labelled.withColumn("p", F.element_at(probability.scalar(), F.col("key")))
    sums = (
        labelled.select(F.explode(F.concat("features", F.array(F.lit("prior")))).alias("feature"), "n", "p")
        .groupBy("feature")
        .agg(F.sum(F.col("n") * F.col("p")).alias("true"), F.sum(F.col("n") * (1 - F.col("p"))).alias("false"))
    )
    row = sums.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("true", "false")))).alias("sums")
    )
    total = F.coalesce(F.get(F.array(F.col("sums")["prior"]), F.lit(0)), F.struct(F.lit(0.0).alias("true"), F.lit(0.0).alias("false")))
    ratio = lambda v: F.log((v["true"] + 0.5) / (total["true"] + 1.0)) - F.log((v["false"] + 0.5) / (total["false"] + 1.0))
    return row.select(
        F.transform_values(
            "sums", lambda k, v: F.when(k == "prior", F.log((v["true"] + 0.5) / (v["false"] + 0.5))).otherwise(ratio(v))
        ).alias("score")
    )


def _all_features() -> Column:
    votes = F.transform("votes", lambda v, i: F.concat(F.lit("vote"), i.cast("string"), F.lit("="), v.cast("string")))
    return F.concat(F.col("features"), votes)


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for each row of documents: ``array<struct<kind, rank, start, stop, base, score>>``.

    Base spans (``base``) always stay. Candidates of the further kinds stay if the classifier gives
    them at least the probability ``THRESHOLD`` and they share no code point with a base span;
    matches of a base kind that fail its check only serve as examples. Positions are code
    points, ``stop`` exclusive. A null text counts as empty, a null ``doc_id`` stays null, repeated
    rows each get their result, other columns are not read. Texts are searched whole, however long;
    spans of one start are listed by kind; an empty table gives no rows. The candidates, without the texts, are
    written once to the shared folder and read for statistics and decision.
    """
    found = stored(candidates(docs), "pii-candidates")
    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    score = feature_scores(spans, pattern_probabilities(spans)).scalar()

    def scored(s: Column) -> Column:
        votes = F.transform(s["votes"], lambda v, i: F.concat(F.lit("vote"), i.cast("string"), F.lit("="), v.cast("string")))
        features = F.concat(s["features"], votes, F.array(F.lit("prior")))
        total = F.aggregate(features, F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(F.col("score"), f), F.lit(0.0)))
        return F.struct(s["kind"], s["rank"], s["start"], s["stop"], s["base"], total.alias("score"))

    decided = found.withColumn("score", score).select("doc_id", F.transform("spans", scored).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    limit = math.log(THRESHOLD / (1 - THRESHOLD))
    extra = lambda s: s["rank"] >= len(BASE)
    added = lambda s: extra(s) & (s["score"] >= limit) & ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    return decided.withColumn("base", base).select("doc_id", F.filter("spans", lambda s: s["base"] | added(s)).alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The spans as counts, a digest of the base ones and a list of all."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return find_spans(docs).select(
        "doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
