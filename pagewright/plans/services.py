"""Queries over provider rules, manifests, layout and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.compat import upper_median
from ..operators import layout as L
from ..operators import probe as P
from ..operators import providers as V
from ..sources.tables import bind, bind_placed, table

# --- requests ---------------------------------------------------------------------------------------------------------
REQUESTS = """
    SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' WHEN 3 THEN 'custom' ELSE 'alpha' END AS provider,
           CASE p_partkey % 7 WHEN 0 THEN ' R1-x ' WHEN 1 THEN 'think-old' WHEN 2 THEN 'x-pro' WHEN 3 THEN 'plain' WHEN 4 THEN 'r0' WHEN 5 THEN 'Think 2' ELSE 'x-Pro' END AS model
    FROM {part}"""
_REQ = "(" + REQUESTS.replace("{part}", "part") + ")"
_PICK = """(SELECT id, provider, model, CASE provider WHEN 'alpha' THEN CASE WHEN regexp_matches(m, '^r[0-9]') THEN 1 ELSE 2 END WHEN 'beta' THEN CASE WHEN regexp_matches(m, 'think') THEN 3 ELSE 4 END WHEN 'gamma' THEN CASE WHEN regexp_matches(m, 'pro$') THEN 5 ELSE 0 END ELSE 0 END AS rule
    FROM (SELECT *, lower(trim(model)) AS m FROM """ + _REQ + "))"
BASES = """
    SELECT s_suppkey AS id, concat(CASE s_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' http://h' WHEN 2 THEN 'http://h/v1' WHEN 3 THEN 'http://h/v1/chat/completions' WHEN 4 THEN 'http://h/completions' WHEN 5 THEN 'http://h/models' ELSE 'http://h/v1///' END, CASE WHEN s_suppkey % 2 = 0 THEN '/ ' ELSE '' END) AS base FROM {supplier}"""
_BASES = "(SELECT id, rtrim(trim(base), '/') AS b FROM (" + BASES.replace("{supplier}", "supplier") + "))"


def _requests(s, d):
    return bind(s, d, REQUESTS)


def _rules(s, d):
    return V.rule_lookup(_requests(s, d), s.createDataFrame(V.RULES, V.RULE_SCHEMA))


# --- model lists and files ----------------------------------------------------------------------------------------------
def _openai(s, d):
    body = F.concat(F.lit('{"data": ['), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_nationkey") % 3 + 1), lambda i: F.concat(F.lit('{"id": "m'), i.cast("string"), F.lit('"}'))), ","), F.lit("]}"))
    return table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 == 3, "HTTP 401").otherwise(body).alias("body"))


def _gemini(s, d):
    body = '{"models": [{"name": "models/a", "supportedGenerationMethods": ["generateContent"]}, {"name": "models/b", "supportedGenerationMethods": ["embed"]}, {"name": "x/y/c", "supportedGenerationMethods": ["embed", "generateContent"]}, {"name": "d"}]}'
    return table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 == 3, '{"other": 1}').otherwise(body).alias("body"))


def _manifest(s, d):
    file = lambda i: F.concat(F.lit('{"role": "r'), i.cast("string"), F.lit('", "name": "f'), (F.col("s_suppkey") * 10 + i).cast("string"), F.lit('", "url": "u", "size": '), (i * 100).cast("string"), F.lit(', "sha256": "AB'), i.cast("string"), F.lit('"}'))
    body = F.concat(F.lit('{"models": ['), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), file), ","), F.lit("]}"))
    return V.parse_manifest(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), body.alias("body")))


def _listing(s, d):
    return table(s, d, "supplier").selectExpr("concat('f', CAST(s_suppkey * 10 + s_suppkey % 3 AS STRING)) AS name", "CAST((s_suppkey % 3) * 100 + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size", "concat(CASE WHEN s_suppkey % 2 = 0 THEN 'ab' ELSE 'AB' END, CAST(s_suppkey % 3 AS STRING)) AS sha256")


FILES = """
    SELECT l_orderkey AS id, l_linenumber * 100000 + l_partkey AS ord, concat('p', CAST(l_partkey AS VARCHAR(20))) AS path,
           concat(CASE l_partkey % 8 WHEN 0 THEN 'OCR_48' WHEN 1 THEN 'ocr_mixed' WHEN 2 THEN 'dbnet' WHEN 3 THEN 'x_aot' WHEN 4 THEN 'Manga_Seg' WHEN 5 THEN 'cartoonseg' WHEN 6 THEN 'ocr_48' ELSE 'dbnet2' END, CASE WHEN l_partkey % 11 = 0 THEN '.bin' ELSE '.param' END) AS name
    FROM {lineitem}"""
_FILES = "(" + FILES.replace("{lineitem}", "lineitem") + ")"
_FIRST = lambda k: f"arg_min(path, ord) FILTER (n LIKE '%.param' AND n LIKE '%{k}%')"


# --- layout -----------------------------------------------------------------------------------------------------------
LAYOUT = """
    SELECT doc_id, concat(replace(text, chr(10), ' '), CASE doc_id % 4 WHEN 0 THEN '、「日本。」!!' WHEN 1 THEN 'A1!?2' ELSE '。12' END) AS t,
           CAST(60 + doc_id % 240 AS DOUBLE) AS width, CAST(40 + (doc_id * 7) % 400 AS DOUBLE) AS room
    FROM {documents}"""
_LAY = "(" + LAYOUT.replace("{documents}", "documents") + ")"


def _layout(s, d):
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a generator's result is computed once, not inlined into each use
    rows = bind(s, d, LAYOUT).withColumn("cells", once(L.vertical_cells(F.col("t"))))
    rows = rows.withColumn("size", once(L.vertical_size(F.size("cells"), F.col("width") * 1.3, F.col("room") * 1.5)))
    rows = rows.withColumn("capacity", once(L.per_column(F.col("room") * 1.5, F.col("size"))))
    return rows.withColumn("cols", once(L.columns(F.col("cells"), F.col("capacity"))))


def _placed(s, d):
    rows = _layout(s, d).withColumns({"n": F.size("cols"), "longest": F.array_max(F.transform("cols", lambda c: F.size(c)))})
    each = rows.select("doc_id", "size", "n", "longest", F.posexplode("cols").alias("col", "cs")).select("doc_id", "size", "n", "longest", "col", F.posexplode("cs").alias("row", "cell"))
    cw, lh = F.col("size") * 1.1, F.col("size") * 1.05
    return each.select("doc_id", "col", "row", "cell", F.round(F.col("n") * cw / 2 - cw / 2 - F.col("col") * cw, 4).alias("x"), F.round((F.col("row") + 0.5) * lh - F.col("longest") * lh / 2, 4).alias("y"), (F.instr(F.lit(L.SIDEWAYS), F.col("cell")) > 0).alias("sideways"))


#: Cells as islands: RE2 has no look-around, so runs of mergeable characters are numbered and measured.
_CELLS = f"""(SELECT doc_id, list(cell ORDER BY i, k) AS cells FROM (
    SELECT doc_id, i, k, CASE WHEN a AND n BETWEEN 2 AND 4 THEN run ELSE substr(run, k, 1) END AS cell
    FROM (SELECT doc_id, min(i) AS i, any_value(a) AS a, count(*) AS n, string_agg(c, '' ORDER BY i) AS run, unnest(range(1, CASE WHEN any_value(a) AND count(*) BETWEEN 2 AND 4 THEN 2 ELSE count(*) + 1 END)) AS k
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, a ORDER BY i) AS g FROM (
            SELECT doc_id, i, c, regexp_matches(c, '^[0-9A-Za-z!?]$') AS a FROM (SELECT doc_id, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '(?s).') AS cs FROM {_LAY}))))
        GROUP BY doc_id, a, g)) GROUP BY doc_id)"""
_CPC = lambda s: f"greatest(1, trunc(room * 1.5::DOUBLE / ({s} * 1.05::DOUBLE))::INT - 3)"
_FIT = f"""(SELECT doc_id, room, greatest(9, floor(coalesce(list_max(list_filter(range(9, least(trunc(room * 1.5::DOUBLE)::INT, 60) + 1), lambda s: ceil(n / {_CPC('s')}) * 1.1::DOUBLE * s <= width * 1.3::DOUBLE)), 9) * 0.85::DOUBLE + 0.5::DOUBLE)::INT) AS size
    FROM (SELECT doc_id, width, room FROM {_LAY}) JOIN (SELECT doc_id, len(cells) AS n FROM {_CELLS}) USING (doc_id))"""
# --- run logs ---------------------------------------------------------------------------------------------------------
_LINE = """CASE event_id % 7
    WHEN 0 THEN concat('STEP', T, 'id=s', user_id % 4)
    WHEN 1 THEN concat('PAIR', T, 'threads=', user_id % 2, T, 'page=', event_id % 5, T, 'a=x', T, 'b=y', T, 'compared=', event_id % 3, T, 'noExpect=', CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, T, 'mismatches=', CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END)
    WHEN 2 THEN concat('TP', T, 'mode=m', event_id % 3, T, 'wallMs=', event_id % 1000, T, 'compared=', event_id % 4, T, 'noExpect=0', T, 'mismatches=0')
    WHEN 3 THEN concat('WARN', T, 'what=', CASE WHEN event_id % 2 = 0 THEN 'left_foreground' ELSE 'slow' END)
    WHEN 4 THEN concat('ENV', T, 'importance=', CASE WHEN event_id % 3 = 0 THEN '100' ELSE '125' END, CASE WHEN event_id % 5 = 0 THEN concat(T, 'step=env') ELSE '' END)
    WHEN 5 THEN concat('FAIL', T, 'step=f', event_id % 3, T, 'torn')
    ELSE concat('GATE', T, 'name=g', event_id % 4, T, 'gain=', event_id % 50, '=x') END"""
LOG = "SELECT user_id AS run, event_id AS line_no, " + _LINE.replace("T,", "chr(9),").replace("(T", "(chr(9)") + " AS line FROM {events}"
_LOG = "(" + LOG.replace("{events}", "events") + ")"
_KV = f"(SELECT run, line_no, line, string_split(line, chr(9))[1] AS kind, string_split(line, chr(9))[2:] AS f FROM {_LOG})"
_VAL = lambda k: f"list_extract(list_transform(list_filter(f, lambda p: starts_with(p, '{k}=')), lambda p: substr(p, {len(k) + 2})), 1)"
_NUM = lambda k: f"coalesce(try_cast({_VAL(k)} AS INT), 0)"
_FIRSTS = lambda kind, key: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, {key} ORDER BY line_no) AS n FROM {_KV} WHERE kind = '{kind}') WHERE n = 1)"
_PKEY = "concat(" + ", '/', ".join(_VAL(k) for k in ("threads", "page", "a", "b")) + ")"


def _log(s, d):
    return P.parse(bind(s, d, LOG))


def _gain(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"))
    gain = F.round(F.try_divide("a", "b") - 1, 6)
    return e.select("user_id", gain.alias("gain"), F.coalesce(gain >= 0.25, F.lit(False)).alias("passed"))


#: A layer graph: each part is a layer of its kind, fed by earlier ones.
LAYERS = "SELECT p_partkey AS layer, CASE WHEN p_partkey % 26 = 0 THEN 'gelu' WHEN p_partkey % 13 = 0 THEN 'split' WHEN p_partkey % 5 = 1 THEN 'conv' WHEN p_partkey % 5 = 2 THEN 'norm' ELSE 'gemm' END AS kind, p_partkey % 3 = 0 AS masked FROM {part}"
EDGES = "SELECT l_partkey AS layer, l_suppkey AS source FROM {lineitem}"


def _graph(s, d):
    """Masked layers all of whose producers are of kinds that allow it."""
    layers, edges = bind(s, d, LAYERS), bind(s, d, EDGES).distinct()
    bad = edges.join(layers.where("kind in ('gelu', 'split')").select(F.col("layer").alias("source")), "source").select("layer").distinct()
    return layers.where("masked").join(bad, "layer", "left_anti").select("layer", "kind")


QUERIES = {
    "rule_lookup": lambda s, d: _rules(s, d).select("id", F.coalesce("ord", F.lit(0)).alias("ord"), "send_temp", "t_min", "t_max", "max_tokens_field"),
    "request_params": lambda s, d: V.request_params(_rules(s, d), F.col("id") % 2 == 0, (F.col("id") % 30) / 10, F.col("id") % 6 == 0),
    "retired_models": lambda s, d: V.migrate(_requests(s, d), s.createDataFrame(V.RETIRED, "r_provider string, old_id string, new_id string")).select("id", "model"),
    "chat_url": lambda s, d: bind(s, d, BASES).select("id", V.chat_url(F.col("base")).alias("url")),
    "models_url": lambda s, d: bind(s, d, BASES).select("id", V.models_url(F.col("base")).alias("url")),
    "list_openai": lambda s, d: V.list_openai(_openai(s, d)),
    "list_gemini": lambda s, d: V.list_gemini(_gemini(s, d)),
    "manifest_parse": _manifest,
    "ensure_plan": lambda s, d: V.ensure_plan(_manifest(s, d), _listing(s, d)),
    "role_resolve": lambda s, d: V.resolve_roles(bind_placed(s, d, FILES, "lineitem"), "place"),
    "sha256_verify": lambda s, d: table(s, d, "documents").select("doc_id", (F.left(F.sha2("text", 256), F.lit(1)) < F.lit("8")).alias("low"), F.sha2("text", 256).alias("sha256")),
    "vertical_cells": lambda s, d: _layout(s, d).select("doc_id", F.size("cells").cast("bigint").alias("n"), F.array_join("cells", "|").alias("cells")),
    "vertical_fit": lambda s, d: _layout(s, d).select("doc_id", "size", "capacity"),
    "kinsoku_columns": lambda s, d: _layout(s, d).select("doc_id", F.array_join(F.transform("cols", lambda c: F.array_join(c, "")), "|").alias("columns")),
    "cell_placement": _placed,
    "horizontal_wrap": lambda s, d: bind(s, d, LAYOUT).select("doc_id", L.horizontal_fit("t", F.col("width") * 1.3, F.col("room") * 1.5).alias("f")).select("doc_id", "f.size", F.array_join("f.lines", "|").alias("lines")),
    "text_colour": lambda s, d: table(s, d, "supplier").select("s_suppkey", L.text_colour(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 256).alias("colours"), F.round(L.stroke_width(F.col("s_suppkey") % 60, F.col("s_suppkey") % 3 == 0), 6).alias("stroke")),
    "probe_parse": lambda s, d: _log(s, d).select("line_no", "kind", F.size("kv").cast("bigint").alias("n_keys"), F.coalesce(P.value("step"), F.lit("-")).alias("step"), F.coalesce(P.value("gain"), F.lit("-")).alias("gain")),
    "probe_pairs": lambda s, d: P.pairs(_log(s, d)),
    "probe_throughput": lambda s, d: P.throughput(_log(s, d)),
    "probe_foreground": lambda s, d: P.foreground(_log(s, d)),
    "probe_failed_steps": lambda s, d: _log(s, d).where("kind = 'FAIL'").groupBy("run", P.value("step").alias("step")).agg(F.min("line_no").alias("first_line")),
    "probe_verdict": lambda s, d: P.pairs(_log(s, d)).select("run", P.verdict(F.col("mismatches"), F.col("compared"), F.lit(4)).alias("verdict")),
    "probe_write": lambda s, d: table(s, d, "events").select("event_id", P.write_line("EV", ("type", F.concat("event_type", F.lit("\tx\n"))), ("user", F.col("user_id").cast("string"))).alias("line")),
    "probe_files": lambda s, d: table(s, d, "nation").select("n_nationkey", P.tombstone(F.lit("run.txt"), F.when(F.col("n_nationkey") % 3 > 0, F.concat("n_name", F.lit(" /x"))), F.lit("t")).alias("name")).withColumn("belongs", P.belongs(F.col("name"), F.lit("run.txt"))),
    "gate_last_wins": lambda s, d: P.last_of(_log(s, d).where("kind = 'GATE'"), P.value("name")).select("run", "key", P.value("gain").alias("gain")),
    "upper_median": lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.collect_list("value").alias("v")).select("user_id", upper_median(F.col("v")).alias("median")),
    "throughput_gain": _gain,
    "ab_pivot": lambda s, d: table(s, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.max("event_id")),
    "graph_mask_check": _graph,
}
_PAIRSUM = f"(SELECT run, count(*) AS pairs, count(*) FILTER ({_NUM('compared')} > 0 AND {_NUM('noExpect')} = 0) AS compared, sum({_NUM('mismatches')})::BIGINT AS mismatches FROM {_FIRSTS('PAIR', _PKEY)} GROUP BY run)"
ORACLES = {
    "rule_lookup": f"SELECT id, CASE rule WHEN 0 THEN 0 WHEN 2 THEN 2 WHEN 4 THEN 2 ELSE 1 END AS ord, rule <> 1 AS send_temp, CASE WHEN rule = 5 THEN 0.5 ELSE 0.0 END AS t_min, CASE WHEN rule IN (3, 4) THEN 1.0 WHEN rule = 5 THEN 1.5 ELSE 2.0 END AS t_max, CASE WHEN rule = 1 THEN 'max_completion_tokens' ELSE 'max_tokens' END AS max_tokens_field FROM {_PICK}",
    "request_params": f"""SELECT id, CASE WHEN rule = 1 THEN NULL ELSE least(CASE WHEN rule IN (3, 4) THEN 1.0 WHEN rule = 5 THEN 1.5 ELSE 2.0 END, greatest(CASE WHEN rule = 5 THEN 0.5 ELSE 0.0 END, (id % 30) / 10)) END AS temperature,
        CASE WHEN id % 6 = 0 THEN '' WHEN id % 2 = 0 THEN CASE rule WHEN 3 THEN 'thinking={{"type":"enabled"}}' WHEN 4 THEN 'enable_thinking=false' ELSE '' END ELSE CASE rule WHEN 1 THEN 'reasoning_effort=low' WHEN 3 THEN 'thinking={{"type":"disabled"}}' WHEN 4 THEN 'enable_thinking=false' WHEN 5 THEN 'reasoning=none' ELSE '' END END AS extras FROM {_PICK}""",
    "retired_models": f"SELECT id, CASE WHEN provider = 'alpha' AND model = 'r0' THEN 'r1' WHEN provider = 'beta' AND model = 'think-old' THEN 'think-new' ELSE model END AS model FROM {_REQ}",
    "chat_url": f"SELECT id, CASE WHEN b = '' THEN '' WHEN contains(b, '/chat/completions') OR b LIKE '%/completions' THEN b WHEN b LIKE '%/v1' THEN b || '/chat/completions' ELSE b || '/v1/chat/completions' END AS url FROM {_BASES}",
    "models_url": f"SELECT id, CASE WHEN b = '' THEN '' WHEN c LIKE '%/models' THEN c WHEN c LIKE '%/v1' THEN c || '/models' ELSE c || '/v1/models' END AS url FROM (SELECT *, rtrim(string_split(b, '/chat/completions')[1], '/') AS c FROM {_BASES})",
    "list_openai": "SELECT n_nationkey AS id, concat('m', unnest(range(1, n_nationkey % 3 + 2))) AS model FROM nation WHERE n_nationkey % 4 <> 3",
    "list_gemini": "SELECT n_nationkey AS id, unnest(['a', 'c']) AS model FROM nation WHERE n_nationkey % 4 <> 3",
    "manifest_parse": "SELECT s_suppkey AS id, i::INT AS ord, concat('r', i) AS role, concat('f', s_suppkey * 10 + i) AS name, 'u' AS url, i * 100 AS size, concat('ab', i) AS sha256 FROM supplier, range(0, 3) AS r(i)",
    "ensure_plan": "SELECT concat('f', s_suppkey * 10 + i) AS name, concat('r', i) AS role, CASE WHEN s_suppkey % 3 <> i THEN 'fetch' WHEN s_suppkey % 5 = 0 THEN 'replace' ELSE 'keep' END AS action FROM supplier, range(0, 3) AS r(i)",
    "role_resolve": f"""SELECT id, ready, CASE WHEN ready THEN o END AS ocr, CASE WHEN ready THEN dd END AS detector, CASE WHEN ready THEN a END AS inpainter, CASE WHEN ready THEN s1 END AS seg_a, CASE WHEN ready THEN s2 END AS seg_b
        FROM (SELECT *, o IS NOT NULL AND dd IS NOT NULL AND a IS NOT NULL AS ready FROM (SELECT id, coalesce(arg_min(path, ord) FILTER (n LIKE '%.param' AND n LIKE '%ocr%' AND n NOT LIKE '%mixed%'), {_FIRST('ocr')}) AS o, {_FIRST('dbnet')} AS dd, {_FIRST('aot')} AS a, {_FIRST('manga_seg')} AS s1, {_FIRST('cartoonseg')} AS s2 FROM (SELECT *, lower(name) AS n FROM {_FILES}) GROUP BY id))""",
    "sha256_verify": "SELECT doc_id, left(sha256(text), 1) < '8' AS low, sha256(text) AS sha256 FROM documents",
    "vertical_cells": f"SELECT doc_id, len(cells)::BIGINT AS n, array_to_string(cells, '|') AS cells FROM {_CELLS}",
    "vertical_fit": f"SELECT doc_id, size, {_CPC('size')} AS capacity FROM {_FIT}",
    "text_colour": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 256 < 110 THEN 'white/black' ELSE 'black/white' END AS colours, round(greatest(2.0, (s_suppkey % 60) * CASE WHEN s_suppkey % 3 = 0 THEN 0.16 ELSE 0.10 END)::DOUBLE, 6) AS stroke FROM supplier",
    "probe_parse": f"SELECT line_no, kind, len(f)::BIGINT AS n_keys, coalesce({_VAL('step')}, '-') AS step, coalesce({_VAL('gain')}, '-') AS gain FROM {_KV}",
    "probe_pairs": f"SELECT * FROM {_PAIRSUM}",
    "probe_throughput": f"SELECT run, string_agg(concat({_VAL('mode')}, '=', {_VAL('wallMs')}), ',' ORDER BY line_no) AS wall, count(*) FILTER ({_NUM('compared')} > 0) AS compared, 0::BIGINT AS mismatches, 0::BIGINT AS no_expect FROM {_FIRSTS('TP', _VAL('mode'))} GROUP BY run",
    "probe_foreground": f"""SELECT run, count(*) FILTER (warn) AS n_left, coalesce(string_agg(DISTINCT CASE WHEN warn THEN now WHEN env THEN coalesce({_VAL('step')}, now) END, ',' ORDER BY CASE WHEN warn THEN now WHEN env THEN coalesce({_VAL('step')}, now) END), '') AS steps
        FROM (SELECT *, coalesce(last_value(CASE WHEN kind = 'STEP' THEN {_VAL('id')} END IGNORE NULLS) OVER (PARTITION BY run ORDER BY line_no), 'before start') AS now, kind = 'WARN' AND {_VAL('what')} = 'left_foreground' AS warn, kind = 'ENV' AND {_VAL('importance')} <> '100' AS env FROM {_KV}) GROUP BY run""",
    "probe_failed_steps": f"SELECT run, {_VAL('step')} AS step, min(line_no) AS first_line FROM {_KV} WHERE kind = 'FAIL' GROUP BY ALL",
    "probe_verdict": f"SELECT run, CASE WHEN mismatches <> 0 THEN 'false' WHEN compared < 4 THEN 'incomplete' ELSE 'true' END AS verdict FROM {_PAIRSUM}",
    "probe_write": "SELECT event_id, concat('EV', chr(9), 'type=', event_type, ' x ', chr(9), 'user=', user_id) AS line FROM events",
    "probe_files": "SELECT n_nationkey, concat('run_crash_', CASE WHEN n_nationkey % 3 > 0 THEN regexp_replace(concat(n_name, ' /x'), '[^A-Za-z0-9._-]', '_', 'g') ELSE 'outside' END, '_t.pb') AS name, true AS belongs FROM nation",
    "gate_last_wins": f"SELECT run, {_VAL('name')} AS key, arg_max({_VAL('gain')}, line_no) AS gain FROM {_KV} WHERE kind = 'GATE' GROUP BY ALL",
    "upper_median": "SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY user_id",
    "throughput_gain": "SELECT user_id, g AS gain, coalesce(g >= 0.25, false) AS passed FROM (SELECT user_id, round(avg(value) FILTER (event_type = 'click') / avg(value) FILTER (event_type = 'view') - 1, 6) AS g FROM events GROUP BY user_id)",
    "ab_pivot": "SELECT user_id, max(event_id) FILTER (event_type = 'click') AS click, max(event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id",
    "graph_mask_check": "SELECT p_partkey AS layer, CASE WHEN p_partkey % 26 = 0 THEN 'gelu' WHEN p_partkey % 13 = 0 THEN 'split' WHEN p_partkey % 5 = 1 THEN 'conv' WHEN p_partkey % 5 = 2 THEN 'norm' ELSE 'gemm' END AS kind FROM part WHERE p_partkey % 3 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN part ON p_partkey = l_suppkey WHERE p_partkey % 13 = 0)",
}
