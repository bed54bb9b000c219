"""URL filters: rules first, else the ratio of two character language models. DataFrame operations only.

Both models are variable-order Markov models over a folded alphabet (letters, one digit, URL punctuation, one symbol for
the rest): contexts of up to ORDER symbols, kept where at least one in STATES training symbols follows them, so that common
beginnings and words of URLs get long contexts and rare ones short; smoothed by Witten-Bell interpolation with the next shorter
context. One model is trained on URLs that the rules allow, one on those they block. Kept contexts are the states of an automaton,
as every part of a kept context is kept: a table of at most (ORDER * STATES + 1) * len(SYMBOLS) log ratios and next states,
whatever the input, which reaches the rows as a scalar subquery. A URL's score is the mean log ratio of its symbols (so length does
not matter). A quarter of the labelled URLs, chosen by hash, is left out of training; the threshold is the one that separates
allowed and blocked among those best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import cut, drop_existing, fresh

#: The rules (verdict, host, start of the path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-_?=&%#~"  # the last stands for any other character
START = "^"
ORDER, STATES = 4, 1000
BINS = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host and path together) that fits; null if none does."""
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in reversed(by_length):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def folded(url: Column) -> Column:
    """The part after `://` in SYMBOLS, digits as one symbol."""
    text = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    return F.regexp_replace(F.translate(F.translate(text, _UPPER, _LOWER), "123456789", "000000000"), r"[^a-z0./\-_?=&%#]", "~")


def held_out(url: Column) -> Column:
    """Whether a labelled URL is for calibration, not for training."""
    return F.left(F.md5(F.coalesce(url, F.lit(""))), F.lit(1)).isin("0", "1", "2", "3")


def counts(labelled: DataFrame, text: str, accepted: str) -> DataFrame:
    """(gram, y, n): how often each run of up to ORDER context symbols and one more occurs in accepted and rejected texts."""
    padded = F.concat(F.lit(START * ORDER), F.col(text))
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    long = labelled.select(F.col(accepted).alias("yes"), F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER + 1)))).alias("g"))
    long = long.groupBy("g").agg(F.sum(F.col("yes").cast("long")).alias("y"), F.sum((~F.col("yes")).cast("long")).alias("n"))
    every = long.select("y", "n", F.explode(F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.right(F.col("g"), k))).alias("gram"))
    return every.groupBy("gram").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))


def train(labelled: DataFrame, text: str, accepted: str) -> DataFrame:
    """One row: start, and the arrays ratio (hundredths of log P(symbol | context) under accepted less that under rejected) and next,
    by state * len(SYMBOLS) + symbol. Counts cover every labelled row."""
    seen = cut(counts(labelled, text, accepted), "grams")
    before = F.expr("left(gram, length(gram) - 1)")
    contexts = seen.groupBy(before.alias("c")).agg(*[F.sum(k).cast("double").alias("t" + k) for k in "yn"], *[F.sum((F.col(k) > 0).cast("double")).alias("d" + k) for k in "yn"])
    contexts = cut(contexts.withColumn("k", F.length("c")), "contexts")
    total = contexts.where("k = 0").select((F.col("ty") + F.col("tn")).alias("total")).scalar()
    kept = contexts.where((F.col("ty") + F.col("tn") >= F.greatest(F.lit(2.0), total / STATES)) | (F.col("k") == 0)).select("c")
    numbered = cut(kept.agg(F.sort_array(F.collect_list("c")).alias("cs")).select(F.posexplode("cs").alias("state", "c")), "states")  # at most ORDER * STATES + 1
    letters = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(x).alias("x")) for i, x in enumerate(SYMBOLS)])
    cells = numbered.select("state", "c", F.explode(letters).alias("l")).select("state", "c", "l.s", "l.x")
    levels = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("j"))
    shorter = levels.where(F.col("j") <= F.length("c")).withColumn("c", F.expr("right(c, j)")).withColumn("gram", F.concat("c", "x"))
    shorter = shorter.join(contexts.drop("k"), "c").join(seen, "gram", "left")
    by_level = shorter.groupBy("state", "s").agg(F.array_sort(F.collect_list(F.struct("j", "y", "n", "ty", "tn", "dy", "dn"))).alias("a"))

    def p(side):
        return F.aggregate("a", F.lit(1.0 / len(SYMBOLS)), lambda q, v: F.when(v["t" + side] > 0, (F.coalesce(v[side], F.lit(0)) + v["d" + side] * q) / (v["t" + side] + v["d" + side])).otherwise(q))

    ratios = by_level.select("state", "s", F.round(100 * F.ln(p("y") / p("n"))).cast("int").alias("r"))
    after = levels.where(F.col("j") <= F.length("c") + 1).withColumn("c", F.expr("right(concat(c, x), j)"))
    after = after.join(numbered.select("c", F.col("state").alias("to")), "c").groupBy("state", "s").agg(F.max_by("to", "j").alias("to"))
    table = ratios.join(after, ["state", "s"]).agg(F.array_sort(F.collect_list(F.struct("state", "s", "r", "to"))).alias("t"))
    start = numbered.where(F.col("c") == F.repeat(F.lit(START), F.length("c"))).agg(F.max_by("state", F.length("c")).alias("start")).scalar()
    return cut(table.select(F.coalesce(start, F.lit(0)).alias("start"), F.transform("t", lambda v: v["r"]).alias("ratio"), F.transform("t", lambda v: v["to"]).alias("next")), "model")


def score(text: Column, model: Column) -> Column:
    """Mean log ratio of a folded text under the one row of train(); 0 for an empty one or an empty model."""
    codes = F.filter(F.transform(F.split(text, ""), lambda c: F.when(c == "", -1).otherwise(F.instr(F.lit(SYMBOLS), c) - 1)), lambda c: c >= 0)

    def step(a, c):
        at = a["state"] * len(SYMBOLS) + c
        return F.struct(F.coalesce(F.get(model["next"], at), F.lit(0)).alias("state"), (a["sum"] + F.coalesce(F.get(model["ratio"], at), F.lit(0))).alias("sum"))

    total = F.aggregate(codes, F.struct(model["start"].alias("state"), F.lit(0).cast("long").alias("sum")), step, lambda a: a["sum"])
    return F.when(F.length(text) > 0, total / (100.0 * F.length(text))).otherwise(F.lit(0.0))


def threshold(scored: DataFrame, value: str, accepted: str) -> DataFrame:
    """One row, `cut`: the bin edge where the share of accepted at or above it plus that of rejected below it is largest
    (the lowest of equals); 0 unless there are both kinds. Scores fall into BINS bins between -4 and 4."""
    at = F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor((F.col(value) + 4) * (BINS / 8)).cast("int")))
    hist = scored.select(at.alias("bin"), F.col(accepted).alias("yes")).groupBy("bin").agg(F.sum(F.col("yes").cast("long")).alias("y"), F.sum((~F.col("yes")).cast("long")).alias("n"))
    rows = hist.agg(F.array_sort(F.collect_list(F.struct("bin", "y", "n"))).alias("h"), F.sum("y").alias("ty"), F.sum("n").alias("tn"))
    below = lambda f, b: F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bin"] < b, x[f]).otherwise(F.lit(0).cast("long")))
    gains = F.transform("h", lambda x: F.struct((below("n", x["bin"]) / F.col("tn") - below("y", x["bin"]) / F.col("ty")).alias("gain"), (-x["bin"]).alias("neg")))
    best = F.array_max(gains)["neg"]
    return rows.select(F.when((F.col("ty") > 0) & (F.col("tn") > 0), -best / F.lit(BINS / 8) - 4).otherwise(F.lit(0.0)).cast("double").alias("cut"))


def filter_urls(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and url_score.

    The rule decides where one fits; elsewhere the models do: allow at or above the threshold. A null URL, or one without
    `://`, has an empty host and path and fits no rule; a null one scores 0. Without allowed or without blocked URLs to train
    on the threshold is 0. Columns with added names are replaced; an empty table gives an empty result.
    """
    pages = drop_existing(pages, ["host", "path", "rule", "verdict", "url_score"])
    fit, text, table = fresh(pages, "fit", "folded", "model")
    rows = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn(fit, rule_of(F.col("host"), F.col("path"), rules)).withColumn(text, folded(F.col(url)))
    labelled = rows.where(F.col(fit).isNotNull()).select(F.col(text).alias("text"), (F.col(fit)["verdict"] == "allow").alias("yes"), held_out(F.col(url)).alias("held"))
    model = train(labelled.where("not held"), "text", "yes").select(F.struct("start", "ratio", "next")).scalar()
    held = labelled.where("held").withColumn("m", model).withColumn("s", score(F.col("text"), F.col("m")))
    limit = cut(threshold(held, "s", "yes"), "cut").scalar()
    scored = rows.withColumn(table, model).withColumn("url_score", score(F.col(text), F.col(table))).drop(table)
    verdict = F.coalesce(F.col(fit)["verdict"], F.when(F.col("url_score") >= F.coalesce(limit, F.lit(0.0)), "allow").otherwise("block"))
    return scored.withColumns({"rule": F.col(fit)["rule"], "verdict": verdict}).drop(fit, text)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op6_url_filter": op6_url_filter}
_FITS = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_CASE = lambda k: "CASE " + " ".join(f"WHEN {_FITS(h, p)} THEN '{(v, h + p)[k]}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
_LEVEL = lambda j, k: f"CASE WHEN max(t{k}) FILTER (j = {j}) > 0 THEN (max({k}) FILTER (j = {j}) + max(d{k}) FILTER (j = {j}) * {f'{k}{j - 1}' if j else f'(1.0::DOUBLE / {len(SYMBOLS)})'}) / (max(t{k}) FILTER (j = {j}) + max(d{k}) FILTER (j = {j}))::DOUBLE ELSE {f'{k}{j - 1}' if j else f'(1.0::DOUBLE / {len(SYMBOLS)})'} END AS {k}{j}"
ORACLES = {
    "op6_url_filter": rf"""
        WITH a AS (
            SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                   regexp_replace(translate(translate(regexp_replace(coalesce(url, ''), '(?s)^.*?://', ''), '{_UPPER}', '{_LOWER}'), '123456789', '000000000'), '[^a-z0./\-_?=&%#]', '~', 'g') AS f
            FROM pages),
        u AS (SELECT *, {_CASE(1)} AS rule, {_CASE(0)} AS known, left(md5(url), 1) IN ('0', '1', '2', '3') AS held FROM a),
        pos AS (SELECT known = 'allow' AS yes, substr('{START * ORDER}' || f, i, {ORDER + 1}) AS g FROM (SELECT known, f, unnest(range(1, length(f) + 1)) AS i FROM u WHERE known IS NOT NULL AND NOT held)),
        seen AS MATERIALIZED (SELECT right(g, k) AS gram, count(*) FILTER (yes) AS y, count(*) FILTER (NOT yes) AS n FROM pos, range(1, {ORDER + 2}) AS r(k) GROUP BY 1),
        ctx AS MATERIALIZED (SELECT left(gram, length(gram) - 1) AS c, sum(y) AS ty, sum(n) AS tn, count(*) FILTER (y > 0) AS dy, count(*) FILTER (n > 0) AS dn FROM seen GROUP BY 1),
        kept AS MATERIALIZED (SELECT c FROM ctx WHERE c = '' OR ty + tn >= greatest(2.0, (SELECT ty + tn FROM ctx WHERE c = '') / {STATES}.0::DOUBLE)),
        text AS (SELECT DISTINCT f FROM u WHERE f <> ''),
        places AS (SELECT f, substr('{START * ORDER}' || f, i, {ORDER}) AS h, substr(f, i, 1) AS s FROM (SELECT f, unnest(range(1, length(f) + 1)) AS i FROM text)),
        state AS (SELECT h, arg_max(c, length(c)) AS c FROM (SELECT DISTINCT h FROM places), range(0, {ORDER + 1}) AS r(j) JOIN kept ON kept.c = right(h, j) GROUP BY h),
        cell AS (SELECT DISTINCT c, s FROM places JOIN state USING (h)),
        level AS (
            SELECT cell.c, s, j, ty, tn, dy, dn, coalesce(y, 0) AS y, coalesce(n, 0) AS n
            FROM cell, range(0, {ORDER + 1}) AS r(j) JOIN ctx ON ctx.c = right(cell.c, j) LEFT JOIN seen ON gram = right(cell.c, j) || s WHERE j <= length(cell.c)),
        ratio AS (SELECT c, s, {", ".join(_LEVEL(j, k) for j in range(ORDER + 1) for k in "yn")}, round(100 * ln(y{ORDER} / n{ORDER}))::BIGINT AS r FROM level GROUP BY c, s),
        score AS (SELECT f, sum(r)::DOUBLE / (100.0::DOUBLE * length(f)) AS v FROM places JOIN state USING (h) JOIN ratio USING (c, s) GROUP BY f),
        v AS (SELECT u.*, coalesce(v, 0.0::DOUBLE) AS v FROM u LEFT JOIN score USING (f)),
        bins AS (SELECT greatest(0, least({BINS}, floor((v + 4) * {BINS // 8})::INT)) AS bin, count(*) FILTER (known = 'allow') AS y, count(*) FILTER (known = 'block') AS n FROM v WHERE known IS NOT NULL AND held GROUP BY 1),
        gains AS (
            SELECT bin, coalesce(sum(n) OVER w, 0)::DOUBLE / (SELECT sum(n) FROM bins) - coalesce(sum(y) OVER w, 0)::DOUBLE / (SELECT sum(y) FROM bins) AS gain
            FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        edge AS (SELECT CASE WHEN (SELECT sum(n) > 0 AND sum(y) > 0 FROM bins) THEN (SELECT bin FROM gains ORDER BY gain DESC, bin LIMIT 1) / {BINS // 8}.0::DOUBLE - 4 ELSE 0.0 END AS edge)
        SELECT page_id, host, path, rule, coalesce(known, CASE WHEN v >= (SELECT coalesce(edge, 0.0) FROM edge) THEN 'allow' ELSE 'block' END) AS verdict FROM v"""
}
