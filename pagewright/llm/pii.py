"""PII: pattern spans, and terms whose co-occurrence with them discloses them. DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card and phone numbers, each kind found from left to right.

Information-theoretic sanitisation protects the value of each base span, its kind (that a document has such data at all) and the
domain of an e-mail address. It looks at the words of each document with a protected entity, outside of base spans. Over the whole corpus, a term t discloses an entity e by PMI(t, e) = log2(p(t, e) / (p(t) p(e))) bits of the
IC(e) = -log2 p(e) bits that e carries, with probabilities over documents. A term that discloses at least GENERALISE of them and
shares at least SUPPORT different texts with e (exact copies count as one) becomes spans of kind `term` wherever it occurs, in
any text: replaced by a general word, or removed from REMOVE on.

Patterns run in Java's regex engine on whole texts. Possessive quantifiers and the look-behinds keep them linear and free of
recursion on any text; they match what the plain patterns match (the comments say why). Positions come from the pieces
between the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import cut, drop_existing, fresh, salted_lookup

KINDS = ["email", "ip", "card", "phone"]
#: A run of local-part characters must reach the @, so only its first character (or the end of the last match) can start one.
#: Nothing follows the repeated groups, so giving nothing back changes nothing.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95
TERM = r"[\p{L}\p{N}]+"
EDGE = "\ufdd0"  # a noncharacter: stands beside a piece of a word that a base span has cut
WHOLE = rf"(?<![\p{{L}}\p{{N}}{EDGE}])[\p{{L}}\p{{N}}]++(?!{EDGE})"
SPAN = "array<struct<start: int, stop: int, value: string>>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.split(F.reverse(number), "")
    value = F.transform(d, lambda x, i: F.when(x == "", 0).otherwise(x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_extract(p, "([0-9]{1,3})$", 1).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        n = F.length(digits(v))
        return F.when(n.between(14, 19), luhn(digits(v))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(v)).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places in code points, stop exclusive: what split() leaves between them gives the places."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["gap"] + F.length(x["v"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + F.length(x["v"])).alias("stop"), x["v"].alias("value")))).alias("out"))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("v")))
    return F.aggregate(pairs, zero, step, lambda a: a["out"])


#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}


def _keeps(kind: str):
    return lambda span: valid(kind, span["value"])


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, stop, value) by kind."""
    out = {}
    for kind, pattern in PATTERNS.items():
        spans = F.filter(matches(text, pattern), _keeps(kind))
        out[kind] = F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast(SPAN))
    return out


def tag(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of spans in order."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base: all base spans as (start, ord, kind, stop, value), in order of start, then kind. A null text has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    spans = base_spans(t)
    return drop_existing(docs, ["base"]).withColumn("base", F.array_sort(F.concat(*[tag(spans[k], k, i) for i, k in enumerate(KINDS)])))


def outside(t: Column, base: Column) -> Column:
    """The text with base spans blanked; pieces of words that a span cuts are marked, so that WHOLE finds the words outside of all spans."""
    word = lambda at: F.substring(t, at, F.lit(1)).rlike(r"^[\p{L}\p{N}]")
    mark = lambda cond: F.when(cond, EDGE).otherwise(" ")
    piece = lambda at, to: F.concat(mark((at > 0) & word(at)), F.replace(F.substring(t, at + 1, to - at), F.lit(EDGE), F.lit(" ")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], piece(a["at"], s["start"]), mark(word(s["start"] + 1)))).alias("out"))
    return F.aggregate(base, zero, step, lambda a: F.concat(a["out"], piece(a["at"], F.length(t))))


def protected(b: Column) -> Column:
    """What a base span protects: its value, its kind (that there is such data at all) and, of an e-mail address, its domain."""
    value = F.lower(b["value"])
    domain = F.when(b["kind"] == "email", F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)))
    return F.array_compact(F.array(F.concat_ws(":", b["kind"], value), F.concat(F.lit("kind:"), b["kind"]), domain))


def vocabulary(found: DataFrame, text: str) -> DataFrame:
    """(class, entities, words, own) of each row: a hash of its text, its distinct entities and words, and its words outside of base
    spans, where it has any spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    distinct = lambda c, pattern: F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), 0)), lambda w: F.lower(w)))
    entities = F.array_distinct(F.flatten(F.transform("base", protected)))
    own = F.when(F.size("base") > 0, distinct(outside(t, F.col("base")), WHOLE))
    return found.select(F.xxhash64(t).alias("class"), entities.alias("entities"), distinct(t, TERM).alias("words"), own.alias("own"))


def disclosing_terms(rows: DataFrame) -> DataFrame:
    """(term, disclosed): terms that carry at least GENERALISE of some entity's information, from whole-corpus counts over the rows of
    vocabulary(). Entities and terms in fewer than SUPPORT rows cannot have the support and are left out before they are paired."""
    total = rows.count()
    held = rows.where(F.size("entities") > 0)
    entities = cut(held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= SUPPORT), "entities")
    frequency = rows.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term") >= SUPPORT)
    texts = held.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.first("entities").alias("entities"), F.first("own").alias("own"))  # equal texts, equal arrays
    each = texts.select("n", "own", F.explode("entities").alias("entity"))
    pairs = salted_lookup(each, entities, ["entity"], F.xxhash64("own"), how="inner").select("n", "entity", "n_entity", F.explode("own").alias("term"))
    both = pairs.groupBy("entity", "n_entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("ways")).where(F.col("ways") >= SUPPORT)
    counted = cut(both, "pairs")
    if counted.isEmpty():
        return counted.select("term", F.lit(0.0).alias("disclosed"))
    wanted = counted.select("term").distinct()
    scored = counted.join(frequency.join(wanted, "term"), "term")
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    scored = scored.select("term", F.when(information > 0, pmi / information).otherwise(F.lit(0.0)).alias("disclosed"))
    return cut(scored.where(F.col("disclosed") >= GENERALISE).groupBy("term").agg(F.max("disclosed").alias("disclosed")), "disclosing")


def term_spans(t: Column, base: Column, marks: Column) -> Column:
    """Spans of every word that marks (term -> general or remove) names, outside of base spans."""
    gaps = F.transform(F.split(t, TERM, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(t, F.lit(TERM), 0)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("v")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(BASE).alias("out"))

    def step(a, x):
        start = a["at"] + x["gap"]
        stop = start + F.length(x["v"])
        value = F.try_element_at(marks, F.lower(x["v"]))
        free = ~F.exists(base, lambda b: (start < b["stop"]) & (b["start"] < stop))
        span = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("ord"), F.lit("term").alias("kind"), stop.alias("stop"), value.alias("value"))
        return F.struct(stop.alias("at"), F.when(value.isNotNull() & free, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(pairs, zero, step, lambda a: a["out"])


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with base and spans: base spans and, in spans, disclosing terms too, as (start, ord, kind, stop, value).

    The value of a term span is `general` or `remove`. A null or empty text has no spans; every row, whatever its key, gets the
    spans of its own text, and counts as a document. Columns with added names are replaced; an empty table gives an empty result.
    """
    docs = drop_existing(docs, ["base", "spans"])
    found = find_base(docs, text)
    rows = cut(vocabulary(found, text), "vocabulary")
    terms = disclosing_terms(rows)
    mark = F.struct("term", F.when(F.col("disclosed") >= REMOVE, "remove").otherwise("general").alias("value"))
    hits = rows.select("class", F.explode("words").alias("term")).join(terms, "term").select("class", mark.alias("m"))
    name, marks = fresh(found, "class", "marks")
    more = cut(hits.groupBy("class").agg(F.map_from_entries(F.collect_set("m")).alias(marks)).withColumnRenamed("class", name), "marks")
    t = F.coalesce(F.col(text), F.lit(""))
    out = salted_lookup(found.withColumn(name, F.xxhash64(t)), more, [name], F.xxhash64(F.col(key)))
    every = F.when(F.col(marks).isNotNull(), F.array_sort(F.concat("base", term_spans(t, F.col("base"), F.col(marks))))).otherwise(F.col("base"))
    return out.select(*[F.col(f"`{c}`") for c in found.columns], every.alias("spans"))


BASE = "array<struct<start: int, ord: int, kind: string, stop: int, value: string>>"


def sanitise(found: DataFrame, text: str = "text") -> DataFrame:
    """found (of find_pii) with sanitised: spans replaced by their kind in brackets, removable terms dropped; overlaps go to the first."""
    t = F.coalesce(F.col(text), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    word = lambda s: F.when(s["value"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["stop"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), word(s)).alias("out")))
    return found.withColumn("sanitised", F.aggregate("spans", zero, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t)))))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLES: dict[str, str] = {}
