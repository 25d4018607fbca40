"""Operator 10: personal data by pattern, checksum and context.

Regular expressions propose spans. Validators confirm them: Luhn for cards, mod 97 for bank accounts, ranges for
addresses and digit counts for phones. Words near a span move its score. Everything is one projection of built-in
functions: no shuffle, no Python, nothing that grows with the table.

Base kinds (email, ip, card, phone) are reported whenever their validator accepts them, whatever their score. The method
adds iban (mod 97) and ssn (three-two-four digits), the latter only where a word near by lifts its score to REPORT.

Null texts count as empty and have no spans. Repeated rows each get the same result. Extra columns are left out. An empty
table gives an empty result; long texts and any number of matches are taken whole, in time nearly linear in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, let, read
from .spans import between, digest, find, fold, joined

KINDS = ("email", "ip", "card", "phone")
#: Java patterns. A start inside a run that its first start could not use fails as well, so it is not tried again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Words that raise a span's score, and words that lower it, within CONTEXT code points before or after it.
NEAR = {
    "email": r"\b(?:e-?mail|contact|write|reach)\b",
    "ip": r"\b(?:ip|host|server|address|login)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|payment|cvv)\b",
    "phone": r"\b(?:phone|tel|call|mobile|fax|cell)\b",
    "iban": r"\b(?:iban|account|bank|transfer|konto|cuenta|compte)\b",
    "ssn": r"\b(?:ssn|social security|taxpayer)\b",
}
AGAINST = r"\b(?:example|sample|version|isbn|invoice|order no|part no)\b"
START = {"email": 0.7, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT, LIFT, REPORT = 40, 0.25, 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97, letters counting from A = 10."""
    turned = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + code(c)) % 97).otherwise((a * 100 + code(c)) % 97))
    return rest == 1


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        return F.regexp_like(match, F.lit(OCTETS))
    if kind == "card":
        return F.char_length(digits(match)).between(16, 19) & luhn(digits(match))
    if kind == "phone":
        return F.char_length(digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def score(data: Column, kind: str, span: Column) -> Column:
    """A span's score from 0 to 1: its kind's start, moved by the words around it. data: the text's bytes."""
    wide = 4 * CONTEXT  # bytes that hold as many code points at least
    before = F.substring(between(data, F.greatest(span["first"] - wide, F.lit(0)), span["first"]), -CONTEXT, CONTEXT)
    after = F.substring(between(data, span["last"], span["last"] + wide), 1, CONTEXT)
    around = F.lower(F.concat(before, F.lit(" \n "), after))
    up = F.regexp_like(around, F.lit(NEAR[kind])).cast("int")
    down = F.regexp_like(around, F.lit(AGAINST)).cast("int")
    return F.round(F.lit(START[kind]) + LIFT * up - LIFT * down, 2)


def detect_kind(text: Column, kind: str) -> Column:
    """Spans of one kind with their score."""
    spans = F.filter(find(text, PATTERNS[kind], kind), lambda s: F.coalesce(valid(kind, s["match"]), F.lit(False)))
    fields = ("kind", "start", "end", "match", "first", "last")
    return let(text.cast("binary"), lambda data: F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in fields], score(data, kind, s).alias("score"))))


def detect(text: Column) -> Column:
    """Spans of all kinds, by kind and start: base kinds as validated, the others from a score of REPORT."""
    text = F.coalesce(text, F.lit(""))
    found = [detect_kind(text, kind) for kind in PATTERNS]
    return F.concat(*[x if kind in KINDS else F.filter(x, lambda s: s["score"] >= REPORT) for kind, x in zip(PATTERNS, found, strict=True)])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text and the spans of each row."""
    return docs.select("doc_id", "text", detect(F.col("text")).alias("found"))


def masked(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first in the text, then the longest."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["first"].alias("first"), (-s["last"]).alias("less"), s["kind"].alias("kind"))))

    def cut(data: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            fits = s["first"] >= acc["at"]
            piece = F.concat(between(data, acc["at"], s["first"]), F.lit("<"), s["kind"], F.lit(">"))
            return F.struct(F.when(fits, -s["less"]).otherwise(acc["at"]).alias("at"), F.when(fits, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        none = F.array().cast("array<string>")
        done = let(order, lambda rows: fold(rows, F.lit(0).cast("long"), none, step))
        return let(done, lambda d: F.concat(F.array_join(d["out"], ""), between(data, d["at"], F.octet_length(text))))

    return F.when(F.size(found) > 0, let(text.cast("binary"), cut)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with the personal data of their texts masked. Null texts stay null; n_chars follows the new text."""
    found = docs.select(*DOCUMENT_COLUMNS, detect(F.col("text")).alias("_found"))
    done = found.select("doc_id", masked(F.col("text"), F.col("_found")).alias("text"), "lang", "source", "n_chars", (F.size("_found") > 0).alias("_some"))
    # Counted from the new column, in a projection of its own: one copy of the fold.
    return done.withColumn("n_chars", F.when(F.col("_some"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts by base kind, the digest of the base spans, and all spans."""
    scanned = scan(read(spark, sf_dir, "documents"))
    of = lambda kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in KINDS]
    scores = F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",")
    return scanned.select("doc_id", *counts, digest(of(KINDS)).alias("base_sha256"), joined(F.col("found")).alias("spans"), scores.alias("scores"))
