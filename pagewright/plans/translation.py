"""Queries of the translation protocol."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import protocol as P
from ..sources.tables import REPLY_LINES, TURNS, as_sql, bind, table

FILTER = "^SFX"
T, L = as_sql(TURNS), as_sql(REPLY_LINES)
#: The same steps as the operators, for DuckDB.
_REPLY = f"(SELECT page, string_agg(line, chr(10) ORDER BY i, k) AS reply FROM {L} GROUP BY page)"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LINES = rf"(SELECT page, unnest(range(1, len(ls) + 1)) AS line_no, {_TRIM.format('unnest(ls)')} AS line FROM (SELECT page, string_split_regex(regexp_replace(reply, '(</think>)?<think>(.|\n)*?</think>', '', 'g'), '\r\n|\n|\r') AS ls FROM {_REPLY}))"
_PAT = r"'<\|?(\d+)\s*[|>]+(.*)'"
_PARSED = rf"(SELECT page, id, arg_max(text, line_no) AS text FROM (SELECT page, line_no, try_cast(regexp_extract(line, {_PAT}, 1) AS INT) AS id, {_TRIM.format(f'regexp_extract(line, {_PAT}, 2)')} AS text FROM {_LINES} WHERE regexp_matches(line, {_PAT})) GROUP BY page, id)"
_JOINED = f"(SELECT t.page, t.i, t.source, CASE WHEN coalesce(p.text, '') = '' THEN t.source ELSE p.text END AS translated FROM {T} t LEFT JOIN {_PARSED} p ON p.page = t.page AND p.id = t.i)"
_BAD = rf"({_TRIM.format('{1}')} = '' OR regexp_matches({_TRIM.format('{1}')}, '^\p{{Nd}}+$') OR regexp_matches({_TRIM.format('{1}')}, '^SFX') OR lower({_TRIM.format('{0}')}) = lower({_TRIM.format('{1}')}))"


def _bad(source, target):
    return _BAD.replace("{0}", source).replace("{1}", target).replace("{{", "{").replace("}}", "}")


_FLAGS = f"(SELECT *, NOT {_bad('source', 'translated')} AS keep FROM {_JOINED})"
_ERRORS = f"(SELECT n.page, n.n, coalesce(p.parsed, 0) AS parsed, CASE WHEN coalesce(p.parsed, 0) < n.n THEN concat(coalesce(p.parsed, 0), '/', n.n) END AS error FROM (SELECT page, count(*) AS n FROM {T} GROUP BY page) n LEFT JOIN (SELECT page, count(*) AS parsed FROM {_PARSED} GROUP BY page) p ON p.page = n.page)"


def _turns(s, d):
    return bind(s, d, TURNS)


def _replies(s, d):
    return P.collect_replies(bind(s, d, REPLY_LINES))


def _joined(s, d):
    return P.join_replies(_turns(s, d).select("page", "i", "source"), P.parse_replies(_replies(s, d)))


def _flags(s, d):
    return _joined(s, d).withColumn("keep", ~P.filtered(F.col("source"), F.col("translated"), FILTER))


def page_outcomes(s, d):
    regions = _flags(s, d).groupBy("page").agg(F.count(F.lit(1)).alias("n_regions"), F.sum(F.col("keep").cast("bigint")).alias("n_kept"))
    errors = P.call_errors(_turns(s, d), P.parse_replies(_replies(s, d)))
    out = regions.join(errors.select("page", "error"), "page")
    return out.select("page", "n_regions", "n_kept", P.outcome(F.col("n_regions"), F.col("n_kept"), F.lit(None), F.col("error")).alias("outcome"))


def page_stats(s, d):
    e = table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.groupBy(F.col("user_id").alias("page")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum((F.col("event_type") == "click").cast("bigint")).alias("n_regions"), F.sum(k).alias("total_ms"), F.max(k).alias("wall_ms"))


def token_usage(s, d):
    raw = F.when(F.col("event_id") % 4 == 0, '{"choices": []}').when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"usage": {"prompt_tokens": '), F.get_json_object("props", "$.k"), F.lit("}}"))).otherwise(F.concat(F.lit('{"usage": {"prompt_tokens": '), F.get_json_object("props", "$.k"), F.lit(', "completion_tokens": 7}}')))
    e = table(s, d, "events").select("event_id", raw.alias("raw"))
    u = F.get_json_object("raw", "$.usage")
    field = lambda f: F.when(u.isNotNull(), F.coalesce(F.get_json_object("raw", f"$.usage.{f}").try_cast("int"), F.lit(0)))
    return e.select("event_id", field("prompt_tokens").alias("prompt_tokens"), field("completion_tokens").alias("completion_tokens"))


def chat_response(s, d):
    raw = F.concat(F.lit('{"choices": [{"message": {"content": "'), F.concat(F.lit("k"), F.get_json_object("props", "$.k")), F.lit('"}}]}'))
    e = table(s, d, "events").select("event_id", raw.alias("raw"), F.when(F.col("event_id") % 9 == 0, 429).otherwise(200).alias("status"))
    ok = F.col("status").between(200, 299)
    return e.select("event_id", F.when(ok, F.get_json_object("raw", "$.choices[0].message.content")).alias("content"), F.when(~ok, F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" "), F.left("raw", F.lit(300)))).alias("error"))


ERROR = "CASE {x} % 6 WHEN 0 THEN 'HTTP 400 Thinking is not supported' WHEN 1 THEN 'HTTP 400 reasoning_effort: Invalid value' WHEN 2 THEN 'HTTP 401 thinking unsupported' WHEN 3 THEN 'HTTP 400 model not exist' WHEN 4 THEN 'HTTP 400 unknown field enable_thinking' ELSE 'timeout' END"
QUERIES = {
    "page_outcomes": page_outcomes,
    "text_filter": lambda s, d: _turns(s, d).where(~P.filtered(F.col("source"), F.col("target"), FILTER)).select("page", "i"),
    "reply_parse": lambda s, d: P.parse_replies(_replies(s, d)),
    "reply_errors": lambda s, d: P.call_errors(_turns(s, d), P.parse_replies(_replies(s, d))),
    "prompt_build": lambda s, d: _turns(s, d).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("i", "source"))).alias("q")).select("page", F.md5(P.prompt(F.transform("q", lambda x: x["source"]))).alias("prompt_md5")),
    "message_list": lambda s, d: bind(s, d, "SELECT p_partkey AS id, p_name AS u FROM {part}").select("id", P.messages(F.lit("translate"), F.when(F.col("id") % 2 == 0, "in").otherwise(" "), F.lit("out"), F.col("u")).alias("messages")),
    "template_fill": lambda s, d: table(s, d, "nation").select("n_nationkey", P.fill_template(F.lit("From {from}to {to}."), F.when(F.col("n_nationkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "n_name", F.lit(" "))), F.lit("X")).alias("text")),
    "think_strip": lambda s, d: _replies(s, d).select("page", F.md5(P.strip_think(F.col("reply"))).alias("md5"), F.length(P.strip_think(F.col("reply"))).cast("bigint").alias("n")),
    "translation_join": lambda s, d: _joined(s, d).select("page", "i", F.md5("translated").alias("md5")),
    "kept_antijoin": lambda s, d: _joined(s, d).join(_flags(s, d).where("keep").select("page", "i"), ["page", "i"], "left_anti").select("page", "i", F.md5("source").alias("reverted_md5")),
    "page_stats": page_stats,
    "token_usage": token_usage,
    "chat_response": chat_response,
    "thinking_reject": lambda s, d: table(s, d, "events").select("event_id", F.expr(ERROR.format(x="event_id")).alias("error")).select("event_id", P.refuses_thinking(F.col("error")).alias("rejects")),
    "chunked_batches": lambda s, d: P.chunked(table(s, d, "documents").select("doc_id"), 7, "doc_id"),
}
ORACLES = {
    "page_outcomes": f"SELECT f.page, count(*) AS n_regions, sum(keep::INT)::BIGINT AS n_kept, CASE WHEN sum(keep::INT) = 0 AND any_value(e.error) IS NOT NULL THEN 'Failed' WHEN sum(keep::INT) = 0 THEN 'Skipped' ELSE 'Translated' END AS outcome FROM {_FLAGS} f JOIN {_ERRORS} e ON e.page = f.page GROUP BY f.page",
    "text_filter": f"SELECT page, i FROM {T} WHERE NOT {_bad('source', 'target')}",
    "reply_parse": f"SELECT * FROM {_PARSED}",
    "reply_errors": f"SELECT * FROM {_ERRORS}",
    "prompt_build": f"SELECT page, md5(string_agg(concat('<|', i, '|>', source), chr(10) ORDER BY i)) AS prompt_md5 FROM {T} GROUP BY page",
    "message_list": """SELECT p_partkey AS id, concat('[{"role":"system","content":"translate"},', CASE WHEN p_partkey % 2 = 0 THEN '{"role":"user","content":"in"},{"role":"assistant","content":"out"},' ELSE '' END, '{"role":"user","content":"', p_name, '"}]') AS messages FROM part""",
    "template_fill": "SELECT n_nationkey, concat('From ', CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE concat(n_name, ' ') END, 'to X.') AS text FROM nation",
    "think_strip": f"SELECT page, md5(r) AS md5, length(r)::BIGINT AS n FROM (SELECT page, regexp_replace(reply, '(</think>)?<think>(.|\\n)*?</think>', '', 'g') AS r FROM {_REPLY})",
    "translation_join": f"SELECT page, i, md5(translated) AS md5 FROM {_JOINED}",
    "kept_antijoin": f"SELECT page, i, md5(source) AS reverted_md5 FROM {_FLAGS} WHERE NOT keep",
    "page_stats": "SELECT user_id AS page, count(*) AS n_lines, count(*) FILTER (event_type = 'click') AS n_regions, sum((props->>'k')::BIGINT)::BIGINT AS total_ms, max((props->>'k')::BIGINT) AS wall_ms FROM events GROUP BY user_id",
    "token_usage": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN (props->>'k')::INT END AS prompt_tokens, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 0 ELSE 7 END AS completion_tokens FROM events",
    "chat_response": """SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN concat('k', props->>'k') END AS content, CASE WHEN event_id % 9 = 0 THEN concat('HTTP 429 {"choices": [{"message": {"content": "k', props->>'k', '"}}]}') END AS error FROM events""",
    "thinking_reject": f"SELECT event_id, starts_with(e, 'HTTP 400') AND regexp_matches(lower(e), 'thinking|reasoning') AND regexp_matches(lower(e), '{'|'.join(P.REFUSALS)}') AS rejects FROM (SELECT event_id, {ERROR.format(x='event_id')} AS e FROM events)",
    "chunked_batches": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 7 AS chunk, (row_number() OVER (ORDER BY doc_id) - 1) % 7 AS place FROM documents",
}
