"""Numbered translation requests, replies, filters and page outcomes."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compat import all_digits, blank, ordered_text, utrim

#: Fixed values of the protocol: a think block, a numbered line (its parts may be written loosely).
THINK = r"(?s)(</think>)?<think>.*?</think>"
LINE = r"<\|?(\d+)\s*[|>]+(.*)"
#: Words by which a service refuses a thinking parameter.
REFUSALS = ["unsupported", "not supported", "unknown", "unrecognized", "invalid", "not permitted"]


def prompt(texts: Column) -> Column:
    """`<|i|>text` lines, numbered from 1."""
    return F.array_join(F.transform(texts, lambda s, i: F.concat(F.lit("<|"), (i + 1).cast("string"), F.lit("|>"), s)), "\n")


def messages(system: Column, shot_user: Column, shot_reply: Column, user: Column) -> Column:
    """JSON message list: system, one example if both its halves are there, the user's prompt."""
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    shots = F.when(~blank(shot_user) & ~blank(shot_reply), F.array(m("user", shot_user), m("assistant", shot_reply))).otherwise(F.array().cast("array<struct<role: string, content: string>>"))
    return F.to_json(F.concat(F.array(m("system", system)), shots, F.array(m("user", user))))


def fill_template(template: Column, source: Column, target: Column) -> Column:
    """{from} and {to} filled in; a blank source language takes its clause away, else it is trimmed and followed by a blank."""
    clause = F.when(blank(source), F.lit("")).otherwise(F.concat(utrim(source), F.lit(" ")))
    return F.replace(F.replace(template, F.lit("{from}"), clause), F.lit("{to}"), target)


def strip_think(raw: Column) -> Column:
    return F.regexp_replace(raw, THINK, "")


def parse_replies(replies: DataFrame, key: str = "page", raw: str = "reply") -> DataFrame:
    """(key, id, text): the numbered lines of each reply; the last line of a number wins. Numbers that are no integers are null."""
    lines = replies.select(key, F.posexplode(F.split(strip_think(F.col(raw)), r"\r\n|\n|\r")).alias("line_no", "line"))
    line = utrim(F.col("line"))
    found = lines.where(line.rlike(LINE)).select(key, "line_no", F.regexp_extract(line, LINE, 1).try_cast("int").alias("id"), utrim(F.regexp_extract(line, LINE, 2)).alias("text"))
    return found.groupBy(key, "id").agg(F.max_by("text", "line_no").alias("text"))


def join_replies(queries: DataFrame, parsed: DataFrame, key: str = "page") -> DataFrame:
    """queries (key, i, source) with translated: the parsed text, the source where it is missing or blank."""
    got = parsed.select(key, F.col("id").cast("bigint").alias("i"), "text")
    return queries.join(got, [key, "i"], "left").withColumn("translated", F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.col("source")).otherwise(F.col("text"))).drop("text")


def is_pattern(pattern: str) -> bool:
    """Whether Java's regular expressions, which the rows meet, can read it."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def filtered(source: Column, target: Column, pattern: str | None = None) -> Column:
    """Whether a text is unusable: blank, digits only, hit by the pattern, or the source but for case. A pattern that is none is no rule."""
    t = utrim(target)
    out = (t == "") | all_digits(t)
    if pattern is not None and is_pattern(pattern):
        out = out | t.rlike(pattern)
    return out | (F.lower(utrim(source)) == F.lower(t))


def call_errors(queries: DataFrame, parsed: DataFrame, key: str = "page") -> DataFrame:
    """(key, n, parsed, error): error is `parsed/n` where fewer different numbers came back than were asked for."""
    n = queries.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    p = parsed.groupBy(key).agg(F.count(F.lit(1)).alias("parsed"))
    out = n.join(p, key, "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)).cast("bigint"))
    return out.withColumn("error", F.when(F.col("parsed") < F.col("n"), F.concat_ws("/", "parsed", "n")))


def outcome(n_regions: Column, n_kept: Column, failed: Column, error: Column) -> Column:
    """Keep-or-replace decision of a page; the first rule that fits."""
    return F.when(failed.isNotNull(), "Failed").when(n_regions == 0, "Skipped").when((n_kept == 0) & error.isNotNull(), "Failed").when(n_kept == 0, "Skipped").otherwise("Translated")


def refuses_thinking(error: Column) -> Column:
    """Whether an error says that thinking parameters are not accepted."""
    e = F.lower(error)
    return error.startswith("HTTP 400") & e.rlike("thinking|reasoning") & e.rlike("|".join(REFUSALS))


def collect_replies(lines: DataFrame, key: str = "page") -> DataFrame:
    return lines.groupBy(key).agg(ordered_text([F.col("i"), F.col("k")], F.col("line"), "\n").alias("reply"))


def chunked(rows: DataFrame, size: int, *order: str, ranges: int = 64) -> DataFrame:
    """rows with chunk and place: consecutive numbers over the given order (a number first), `size` rows a chunk, without a single-task sort.

    Ranges of the first column are counted; a row's number is its place in its range plus the rows before the range. A row's range
    follows from its value alone, so neither lost tasks nor other partitions change a number; rows that tie in the whole order may swap."""
    edges = rows.agg(F.percentile_approx(order[0], [i / ranges for i in range(1, ranges)])).first()[0] or []
    edges = sorted({e for e in edges if e is not None})
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(order[0]))) if edges else F.lit(0)
    placed = rows.withColumn("__part", F.coalesce(part, F.lit(0)))
    total = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `ranges` rows
    before, at = {}, 0
    for p in sorted(total):
        before[p] = at
        at += total[p]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("__part")] if before else F.lit(0)
    number = start + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return placed.withColumn("__at", number).withColumns({"chunk": F.floor(F.col("__at") / size).cast("bigint"), "place": (F.col("__at") % size).cast("bigint")}).drop("__part", "__at")
