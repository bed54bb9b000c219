"""Run logs: tab-separated records to verdicts, gates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with kind and kv. A field without `=` has an empty value; a torn line simply lacks its last keys."""
    parts = F.split(line, "\t")
    fields = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    pair = lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("").alias("value"))
    entries = F.transform(fields, pair)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return lines.withColumns({"kind": F.get(parts, F.lit(0)), "kv": F.map_from_entries(last)})


def number(key: str) -> Column:
    return F.coalesce(F.try_element_at("kv", F.lit(key)).try_cast("int"), F.lit(0))


def value(key: str) -> Column:
    return F.try_element_at("kv", F.lit(key))


def verdict(mismatches: Column, compared: Column, want: Column) -> Column:
    return F.when(mismatches != 0, "false").when(compared < want, "incomplete").otherwise("true")


def first_of(parsed: DataFrame, keys: list[Column], run: str = "run") -> DataFrame:
    """The first record of each key in each run."""
    w = Window.partitionBy(run, *keys).orderBy("line_no")
    return parsed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pairs(parsed: DataFrame, run: str = "run") -> DataFrame:
    """(run, pairs, compared, mismatches): each combination once; compared only with a count and without missing baselines."""
    rows = first_of(parsed.where("kind = 'PAIR'"), [F.coalesce(value(k), F.lit("?")) for k in ("threads", "page", "a", "b")], run)
    ok = (number("compared") > 0) & (number("noExpect") == 0)
    return rows.groupBy(run).agg(F.count(F.lit(1)).alias("pairs"), F.sum(ok.cast("bigint")).alias("compared"), F.sum(number("mismatches").cast("bigint")).alias("mismatches"))


def throughput(parsed: DataFrame, run: str = "run") -> DataFrame:
    """(run, wall, compared, mismatches, no_expect): the first record of each mode; wall as `mode=ms` in order of appearance."""
    rows = first_of(parsed.where("kind = 'TP'").where(value("mode").isNotNull()), [value("mode")], run)
    wall = F.when(value("wallMs").try_cast("bigint").isNotNull(), F.struct("line_no", F.concat_ws("=", value("mode"), value("wallMs")).alias("w")))
    ok = (number("compared") > 0) & (number("noExpect") == 0)
    return rows.groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(wall)), lambda x: x["w"]), ",").alias("wall"), F.sum(ok.cast("bigint")).alias("compared"), F.sum(number("mismatches").cast("bigint")).alias("mismatches"), F.sum(number("noExpect").cast("bigint")).alias("no_expect"))


def foreground(parsed: DataFrame, run: str = "run", before: str = "before start") -> DataFrame:
    """(run, n_left, steps): how often the run left the foreground and which steps that touched, from the latest step at each record."""
    step = F.when((F.col("kind") == "STEP"), value("id"))
    w = Window.partitionBy(run).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parsed.withColumn("now", F.coalesce(F.last(step, ignorenulls=True).over(w), F.lit(before)))
    warn = (F.col("kind") == "WARN") & (value("what") == "left_foreground")
    env = (F.col("kind") == "ENV") & (value("importance") != "100")
    touched = F.when(F.coalesce(warn, F.lit(False)), F.col("now")).when(F.coalesce(env, F.lit(False)), F.coalesce(value("step"), "now"))
    return rows.groupBy(run).agg(F.sum(F.coalesce(warn, F.lit(False)).cast("bigint")).alias("n_left"), F.array_join(F.array_sort(F.collect_set(touched)), ",").alias("steps"))


def last_of(parsed: DataFrame, key: Column, run: str = "run") -> DataFrame:
    """The last record's kv of each key."""
    return parsed.groupBy(run, key.alias("key")).agg(F.max_by("kv", "line_no").alias("kv"))


def write_line(kind: str, *fields: tuple[str, Column]) -> Column:
    """A record; tabs and line feeds in values become blanks."""
    return F.concat_ws("\t", F.lit(kind), *[F.concat(F.lit(k + "="), F.regexp_replace(v, "[\t\r\n]", " ")) for k, v in fields])


def tombstone(report: Column, step: Column, time: Column) -> Column:
    return F.concat(F.regexp_replace(report, r"\.txt$", ""), F.lit("_crash_"), F.regexp_replace(F.coalesce(step, F.lit("outside")), "[^A-Za-z0-9._-]", "_"), F.lit("_"), time, F.lit(".pb"))


def belongs(name: Column, report: Column) -> Column:
    return (name == report) | (name.startswith(F.concat(F.regexp_replace(report, r"\.txt$", ""), F.lit("_crash"))) & name.endswith(".pb"))


def ordered_digest(rows: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """(key, digest): SHA-256 over `order:data` of a key's rows in order."""
    r = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d")))).alias("r"))
    return r.select(key, F.sha2(F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["o"].cast("string"), x["d"])), ","), 256).alias("digest"))


def weighted_ratio(times: DataFrame, key: str, round_: list[str]) -> DataFrame:
    """(key, ratio): time b over time a, each summed over the kinds of a round, a kind as often as the round has it. times: (key, kind, a, b)."""
    weight = F.broadcast(times.sparkSession.createDataFrame([(k,) for k in round_], "kind string").groupBy("kind").agg(F.count(F.lit(1)).alias("w")))  # a few rows
    rows = times.join(weight, "kind").groupBy(key)
    return rows.agg(F.round(F.try_divide(F.sum(F.col("b") * F.col("w")), F.sum(F.col("a") * F.col("w"))), 6).alias("ratio"))


def batch_throughput(runs: DataFrame) -> DataFrame:
    """(depth, per_page, n_ok) of runs (depth, ms, ok): `depth` pages are done at a time."""
    return runs.groupBy("depth").agg((F.sum("ms") / F.col("depth")).alias("per_page"), F.count_if("ok").alias("n_ok"))
