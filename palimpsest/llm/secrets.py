"""Secret scans with a trigram inverted index, in DataFrame expressions only.

Each rule is a regular expression with the literals that any match must hold. The literals give a
Boolean trigram query: an OR over alternatives of an AND over their trigrams. `trigram_postings`
posts a fingerprint of each distinct text under those trigrams that some rule asks for;
`candidates` intersects the postings; the scan then verifies a rule only on its candidates. A rule
without a mandatory trigram is tried on every text. A clash of fingerprints only adds a candidate.

Null text is the empty text. Rows with equal or null ids are scanned one by one, repeated rows too. Spans that begin
together are ordered as the rules are. A column secret_spans of the input is replaced; others may have any names but
__key and __kinds. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

#: Most fingerprints of candidates that are sent to every executor; more are joined by a shuffle.
SENT = 2_000_000


@dataclass(frozen=True)
class Rule:
    """value: the group that must have `least` characters. literals: one of these is in any match."""

    kind: str
    regex: str
    value: int = 0
    least: int = 0
    literals: tuple[str, ...] = ()
    base: bool = False


RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key"), base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, ("akia",), base=True),
    Rule("hex", r"[0-9a-f]+", 0, 16, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39, ("aiza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, ("eyj",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("-----begin",)),
)


def trigrams(literal: str) -> list[str]:
    return sorted({literal[i : i + 3] for i in range(len(literal) - 2)})


def trigram_postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, text_key) over lower-cased texts, of the trigrams that rules ask for."""
    asked = sorted({t for r in rules for literal in r.literals for t in trigrams(literal)})
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked]))
    lowered = texts.select(F.xxhash64("text").alias("text_key"), F.lower("text").alias("low"))
    return lowered.select(F.explode(held).alias("trigram"), "text_key").distinct()


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_key, kinds): the rules whose Boolean query a text meets, by intersecting postings."""
    clauses = [(r.kind, n, t) for r in rules for n, literal in enumerate(r.literals) for t in trigrams(literal)]
    needs = Counter(c[:2] for c in clauses)
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(n).alias("clause"), F.lit(t).alias("trigram"), F.lit(needs[k, n]).alias("needs")) for k, n, t in clauses]
    wanted = postings.sparkSession.range(1).select(F.inline(F.array(*rows)))  # as many rows as rules have trigrams
    met = (
        postings.join(F.broadcast(wanted), "trigram")
        .groupBy("text_key", "kind", "clause", "needs")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") == F.col("needs"))
    )
    return met.groupBy("text_key").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """array of (begin, rank, kind, end) of a rule's matches: leftmost, non-overlapping, then those that fail dropped."""
    if not rule.least and not rule.value:
        regex, checked = rule.regex, None
    elif rule.value == 0 and rule.regex.endswith("+"):  # one class to the end: a longer match starts nowhere else
        regex, checked = rule.regex, F.lit(0)
    else:
        regex, checked = rule.regex, F.lit(rule.value)
    if rule.kind == "hex":
        regex, checked = f"[0-9a-f]{{{rule.least},}}", None
    found, between = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    values = found if checked is None or rule.value == 0 else F.regexp_extract_all(text, F.lit(regex), checked)
    lengths = F.arrays_zip(
        F.transform(found, lambda x: F.char_length(x)).alias("long"),
        F.transform(F.slice(between, 1, F.size(found)), lambda x: F.char_length(x)).alias("gap"),
        F.transform(values, lambda x: F.char_length(x)).alias("value"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:long,rank:int,kind:string,end:long>>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        begin = held["at"] + x["gap"]
        span = F.struct(begin.cast("long").alias("begin"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), (begin + x["long"]).cast("long").alias("end"))
        kept = F.when(x["value"] >= rule.least, F.array(span)).otherwise(F.array().cast("array<struct<begin:long,rank:int,kind:string,end:long>>"))
        return F.struct((begin + x["long"]).cast("long").alias("at"), F.concat(held["out"], kept).alias("out"))

    spans = F.aggregate(lengths, start, step, lambda held: held["out"])
    return F.when(text.rlike(regex), spans).otherwise(F.array().cast("array<struct<begin:long,rank:int,kind:string,end:long>>"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with secret_spans: array of (begin, rank, kind, end) in code points, end exclusive, by begin and rule."""
    docs = docs.drop("secret_spans")
    chosen = stored(candidates(trigram_postings(docs.select("text"), rules), rules))
    small = chosen.count() <= SENT
    keyed = docs.withColumn("__key", F.xxhash64("text")).join(F.broadcast(chosen.withColumnRenamed("text_key", "__key").withColumnRenamed("kinds", "__kinds")) if small else chosen.withColumnRenamed("text_key", "__key").withColumnRenamed("kinds", "__kinds"), "__key", "left")
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast("array<struct<begin:long,rank:int,kind:string,end:long>>")
    each = [(F.when(F.array_contains("__kinds", r.kind), _spans(r, i, text)).otherwise(none) if r.literals else _spans(r, i, text)) for i, r in enumerate(rules)]
    return keyed.withColumn("secret_spans", F.array_sort(F.concat(*each))).drop("__key", "__kinds")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret span of the text replaced by mark (overlapping spans by one); other texts unchanged."""
    found, text = find_secrets(docs, rules), F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(held: Column, s: Column) -> Column:
        gap = F.substring(text, (held["at"] + 1).cast("int"), F.greatest(s["begin"] - held["at"], F.lit(0)).cast("int"))
        new = F.when(s["begin"] < held["at"], held["out"]).otherwise(F.concat(held["out"], gap, F.lit(mark)))
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"), new.alias("out"))

    clean = F.aggregate("secret_spans", start, step, lambda held: F.concat(held["out"], F.substring(text, (held["at"] + 1).cast("int"), F.length(text))))
    return found.withColumn("text", F.when(F.size("secret_spans") > 0, clean).otherwise(text)).drop("secret_spans")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(of("assign", "access", "hex")), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
