"""Service rules as reference data: parameter rules, retired models, endpoints, model lists, manifests, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import utrim

#: Own sample rules in the shapes that services need: (provider, order, model pattern, sends temperature, least, greatest,
#: token field, fields with thinking off, fields with thinking on).
RULES = [
    ("alpha", 1, "^r[0-9]", False, 0.0, 2.0, "max_completion_tokens", {"reasoning_effort": "low"}, {}),
    ("alpha", 2, None, True, 0.0, 2.0, "max_tokens", {}, {}),
    ("beta", 1, "think", True, 0.0, 1.0, "max_tokens", {"thinking": '{"type":"disabled"}'}, {"thinking": '{"type":"enabled"}'}),
    ("beta", 2, None, True, 0.0, 1.0, "max_tokens", {"enable_thinking": "false"}, {"enable_thinking": "false"}),
    ("gamma", 1, "pro$", True, 0.5, 1.5, "max_tokens", {"reasoning": "none"}, {}),
]
RULE_SCHEMA = "provider string, ord int, pattern string, send_temp boolean, t_min double, t_max double, max_tokens_field string, off map<string, string>, on map<string, string>"
RETIRED = [("alpha", "r0", "r1"), ("beta", "think-old", "think-new")]
#: The fields that turn thinking on or off.
THINKING_KEYS = ["reasoning_effort", "reasoning", "thinking", "enable_thinking"]


def rule_lookup(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests (id, provider, model) with the first rule of the provider, in order, whose pattern the model holds; a null pattern
    holds always; no rule: temperature only. The rule table is fixed reference data and is broadcast."""
    m = F.lower(utrim(F.col("model")))
    r = F.broadcast(rules.withColumnRenamed("provider", "rule_provider"))
    hits = requests.withColumn("__row", F.monotonically_increasing_id()).join(r, (F.col("provider") == F.col("rule_provider")) & (F.col("pattern").isNull() | F.regexp_like(m, F.coalesce("pattern", F.lit("")))), "left")
    first = hits.withColumn("__n", F.row_number().over(Window.partitionBy("__row").orderBy("ord"))).where("__n = 1").drop("__n", "__row", "rule_provider")
    return first.withColumns({"send_temp": F.coalesce("send_temp", F.lit(True)), "t_min": F.coalesce("t_min", F.lit(0.0)), "t_max": F.coalesce("t_max", F.lit(2.0)), "max_tokens_field": F.coalesce("max_tokens_field", F.lit("max_tokens"))})


def request_params(looked_up: DataFrame, thinking: Column, temperature: Column, drop_thinking: Column) -> DataFrame:
    """The parameters to send as (temperature, extras as `key=value` in order of the key); thinking fields go on a retry."""
    extra = F.coalesce(F.when(thinking, F.col("on")).otherwise(F.col("off")), F.create_map().cast("map<string, string>"))
    keys = F.array(*[F.lit(k) for k in THINKING_KEYS])
    extra = F.map_filter(extra, lambda k, v: ~(drop_thinking & F.array_contains(keys, k)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(extra)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return looked_up.select("id", F.when(F.col("send_temp"), F.least("t_max", F.greatest("t_min", temperature))).alias("temperature"), text.alias("extras"))


def migrate(requests: DataFrame, retired: DataFrame) -> DataFrame:
    r = F.broadcast(retired)
    return requests.join(r, (F.col("provider") == F.col("r_provider")) & (F.col("model") == F.col("old_id")), "left").withColumn("model", F.coalesce("new_id", "model")).drop("r_provider", "old_id", "new_id")


def chat_url(base: Column) -> Column:
    b = F.regexp_replace(utrim(base), "/+$", "")
    return F.when(b == "", "").when(b.contains("/chat/completions") | b.endswith("/completions"), b).when(b.endswith("/v1"), F.concat(b, F.lit("/chat/completions"))).otherwise(F.concat(b, F.lit("/v1/chat/completions")))


def models_url(base: Column) -> Column:
    b = F.regexp_replace(utrim(base), "/+$", "")
    c = F.regexp_replace(F.substring_index(b, "/chat/completions", 1), "/+$", "")
    return F.when(b == "", "").when(c.endswith("/models"), c).when(c.endswith("/v1"), F.concat(c, F.lit("/models"))).otherwise(F.concat(c, F.lit("/v1/models")))


def list_openai(replies: DataFrame, body: str = "body") -> DataFrame:
    return replies.select("id", F.explode(F.from_json(body, "data array<struct<id: string>>")["data"]).alias("m")).select("id", F.col("m.id").alias("model"))


def list_gemini(replies: DataFrame, body: str = "body") -> DataFrame:
    m = F.from_json(body, "models array<struct<name: string, supportedGenerationMethods: array<string>>>")["models"]
    rows = replies.select("id", F.explode(m).alias("m")).where(F.array_contains("m.supportedGenerationMethods", "generateContent"))
    return rows.select("id", F.substring_index("m.name", "/", -1).alias("model"))


def parse_manifest(manifests: DataFrame, body: str = "body") -> DataFrame:
    m = F.from_json(body, "models array<struct<role: string, name: string, url: string, size: bigint, sha256: string>>")["models"]
    return manifests.select("id", F.posexplode(m).alias("ord", "m")).select("id", "ord", "m.role", "m.name", "m.url", "m.size", F.lower("m.sha256").alias("sha256"))


def ensure_plan(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """What to do for each file of a manifest: keep it if it is there with the right size and digest, else fetch it."""
    here = listing.select("name", F.col("size").alias("here_size"), F.col("sha256").alias("here_sha"))
    rows = manifest.join(here, "name", "left")
    same = F.coalesce((F.col("here_size") == F.col("size")) & (F.lower("here_sha") == F.col("sha256")), F.lit(False))
    return rows.select("name", "role", F.when(same, "keep").when(F.col("here_size").isNull(), "fetch").otherwise("replace").alias("action"))


def resolve_roles(files: DataFrame, *ties: str) -> DataFrame:
    """One row for each set of files (id, ord, name, path): a path for each role, null unless the three required ones are there.
    The first match in list order counts; for the recogniser a name without `mixed` comes first. Matches of equal ord are taken
    in the order of the columns `ties`, then of their paths."""
    n = F.lower("name")
    fits = lambda key: n.endswith(".param") & n.contains(key) & F.col("ord").isNotNull()
    order = [F.col(c).alias(c) for c in ("ord", *ties, "path")]
    first = lambda key, *before: F.min_by(F.when(fits(key), F.col("path")), F.when(fits(key), F.struct(*before, *order)))
    ocr = first("ocr", n.contains("mixed").alias("mixed"))
    rows = files.groupBy("id").agg(ocr.alias("ocr"), first("dbnet").alias("detector"), first("aot").alias("inpainter"), first("manga_seg").alias("seg_a"), first("cartoonseg").alias("seg_b"))
    ready = F.col("ocr").isNotNull() & F.col("detector").isNotNull() & F.col("inpainter").isNotNull()
    return rows.select("id", ready.alias("ready"), *[F.when(ready, F.col(c)).alias(c) for c in ("ocr", "detector", "inpainter", "seg_a", "seg_b")])


def provider_of(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """requests (provider) with the provider's row; an unknown or null one gets the first. providers: (ord, provider, ...), fixed reference data."""
    first = providers.orderBy("ord").first()
    names = [c for c in providers.columns if c != "provider"]
    rows = requests.join(F.broadcast(providers.withColumnRenamed("provider", "known")), F.col("provider") == F.col("known"), "left")
    missing = F.col("known").isNull()
    return rows.withColumns({**{c: F.when(missing, F.lit(first[c])).otherwise(F.col(c)) for c in names}, "provider": F.coalesce("known", F.lit(first["provider"]))}).drop("known")


def endpoint(editable: Column, base: Column, preset_chat: Column, preset_models: Column) -> tuple[Column, Column]:
    """Addresses for chat and for the model list: from the user's base where the provider allows one, else the preset ones."""
    return F.when(editable, chat_url(base)).otherwise(preset_chat), F.when(editable, models_url(base)).otherwise(preset_models)


def list_models(replies: DataFrame) -> DataFrame:
    """(id, models, last_error) of replies (id, source, url, key, status, body): sorted model ids, none without a source, address or key;
    a failed call or an unreadable body gives none and a reason (of a body at most 300 characters)."""
    asked = (F.col("source") != "none") & ~F.coalesce(utrim(F.col("url")) == "", F.lit(True)) & ~F.coalesce(utrim(F.col("key")) == "", F.lit(True))
    open_ai = F.transform(F.from_json("body", "data array<struct<id: string>>")["data"], lambda m: m["id"])
    gemini = F.from_json("body", "models array<struct<name: string, supportedGenerationMethods: array<string>>>")["models"]
    gemini = F.transform(F.filter(gemini, lambda m: F.array_contains(m["supportedGenerationMethods"], "generateContent")), lambda m: F.substring_index(m["name"], "/", -1))
    found = F.array_sort(F.when(F.col("source") == "openai", open_ai).when(F.col("source") == "gemini", gemini))
    ok = F.col("status").between(200, 299)
    error = F.when(~ok, F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" "), F.left("body", F.lit(300)))).when(found.isNull(), F.lit("no list in the body"))
    none = F.array().cast("array<string>")
    return replies.select("id", F.when(asked & ok, F.coalesce(found, none)).otherwise(none).alias("models"), F.when(asked, error).alias("last_error"))


def request_body(model: Column, temperature: Column, thinking: Column, prompt: Column) -> Column:
    """A request as JSON; null fields, nested ones too, are left out. thinking: a map, or null."""
    inner = F.map_filter(thinking, lambda k, v: v.isNotNull())
    return F.to_json(F.struct(model.alias("model"), temperature.alias("temperature"), inner.alias("thinking"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages")))


def with_retry(requests: DataFrame, send, refused: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(replies, refused keys): requests (retry_key, ...) are sent with thinking fields unless their key is known to refuse them; those
    that are refused are sent once more without. send(rows with drop_thinking) gives rows with `refused`."""
    known = requests.sparkSession.createDataFrame([], "retry_key string") if refused is None else refused
    first = send(requests.join(known, "retry_key", "left_anti").withColumn("drop_thinking", F.lit(False)))
    again = first.where("refused").select(*requests.columns).unionByName(requests.join(known, "retry_key", "left_semi").select(*requests.columns))
    out = first.where("not refused").unionByName(send(again.withColumn("drop_thinking", F.lit(True))))
    return out, known.unionByName(first.where("refused").select("retry_key")).distinct()
