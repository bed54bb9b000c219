"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (1 to 4 characters of the lower-cased text, letters only, runs of anything else
count as one blank) for each language in numpy, sums the counts in Spark and brings one log-probability
matrix of languages x BUCKETS to the driver, whose size depends on neither rows nor texts. Scoring adds rows of
that matrix for the n-grams of a text, in batches.

At most `train_rows` labelled rows of each language are used: the rows whose key hashes lowest, an unbiased choice
that needs no sort. All of their text is used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import U64, drop_existing, in_arrow, map_batches, mix, shelter

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
TRAIN_ROWS = 4000
PIECE = 1 << 20  # characters taken at a time
MAX_LANGUAGES = 200  # bounds the matrix: 52 MB
UNKNOWN = "und"


def _is_letter(c: np.ndarray) -> np.ndarray:
    out = ((c >= 97) & (c <= 122)) | ((c >= 65) & (c <= 90))
    rest = np.flatnonzero(c >= 128)
    if len(rest):
        u, back = np.unique(c[rest], return_inverse=True)
        out[rest] = np.array([chr(x).isalpha() for x in u.tolist()], bool)[back]
    return out


def _folded(text: str):
    """Lower-cased letters as code points and 32 for each run of anything else, in pieces; runs may cross pieces."""
    blank = False
    for i in range(0, len(text), PIECE):
        low = text[i : i + PIECE].replace("Σ", "σ").lower()  # character by character, so that pieces make no difference
        c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter(c)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = letter[0] or not blank
        blank = not letter[-1]
        yield np.where(letter, c, 32)[keep].astype(U64)


def _buckets(text: str):
    """Bucket numbers of the n-grams of a text, in pieces: each holds those that end in it."""
    tail = np.zeros(0, U64)
    for piece in _folded(text):
        c = np.concatenate([tail, piece + U64(1)])
        h = np.zeros(len(c), U64)
        for n in range(1, max(ORDERS) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * U64(0x9E3779B97F4A7C15) + c[n - 1 :]
            if n in ORDERS:
                yield (mix(h[max(0, len(tail) - n + 1) :] + U64(n)) % U64(BUCKETS)).astype(np.int64)
        tail = c[-(max(ORDERS) - 1) :]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(ch.isalpha() for ch in text)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities as float32 of shape languages x BUCKETS), from the rows with a language and letters."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)).alias("place"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, BUCKETS), np.float32)
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{len(counts)} different values in {lang}: more than MAX_LANGUAGES")
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, train_rows / n) * (1 << 30)))) for k, n in counts.items()])
    names = sorted(counts)
    at = {k: i for i, k in enumerate(names)}

    def count(batches):
        sums = np.zeros((len(names), BUCKETS), np.int64)
        for b in batches:
            for t, k in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                for x in _buckets(t) if has_letter(t) else ():
                    sums[at[k]] += np.bincount(x, minlength=BUCKETS)
        i, j = np.nonzero(sums)
        for s in range(0, len(i), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(i[s : s + 100_000]), pa.array(j[s : s + 100_000]), pa.array(sums[i[s : s + 100_000], j[s : s + 100_000]])], names=["i", "j", "n"])

    found = in_arrow(rows.where(F.col("place") < limit).select("text", "lang"), count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((len(names), BUCKETS))
    sums[found["i"].to_numpy(), found["j"].to_numpy()] = found["n"].to_numpy()
    seen = sums.sum(1) > 0
    sums, names = sums[seen], [k for k, s in zip(names, seen, strict=True) if s]
    smooth = 0.5
    return names, np.log((sums + smooth) / (sums.sum(1, keepdims=True) + smooth * BUCKETS)).astype(np.float32)


def score_text(text: str | None, names: list[str], table: np.ndarray) -> tuple[str, float]:
    """table: BUCKETS x languages. The language with the highest likelihood (the first of equals), its posterior."""
    if not names or not has_letter(text):
        return UNKNOWN, 0.0
    sums = np.zeros(len(names))
    for x in _buckets(text):
        sums += np.take(table, x, axis=0).sum(0, dtype=np.float64)
    p = np.exp(sums - sums.max())
    i = int(sums.argmax())
    return names[i], float(p[i] / p.sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score.

    lang_pred is a learned language, or `und` with score 0 for a null text, one without letters, or an empty model.
    score is the posterior of the language under equal priors. Long texts are read in pieces. Columns named lang_pred
    or score are replaced; an empty table gives an empty result.
    """
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(logs.T)))

    def fn(b):
        n, table = shared.value
        got = [score_text(t, n, table) for t in b.column(text).to_pylist()]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return map_batches(docs, "lang_pred string, score double", fn, text)


def held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """docs with held_out, lang_pred and score, learned from the rows that are not held out. A null key is not held out. Columns
    with these names are replaced; for nulls, empty and long texts see predict()."""
    docs = drop_existing(docs, ["held_out"]).withColumn("held_out", held_out(key))
    return predict(docs, train(docs.where(~F.col("held_out")), text, lang, key), text)


def stage_lang_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in a language that was learned, with that language in lang; rejected are those with no letters to
    judge by (`und`), null and empty texts among them.

    Repeated rows and null keys are judged each; an empty table, or one without any lang, gives an empty result; columns of docs
    named like the operator's own keep their values."""
    safe, back = shelter(docs, ["held_out", "lang_pred", "score"])
    known = identify(safe).where(F.col("lang_pred") != UNKNOWN)
    return back(known.withColumn("lang", F.col("lang_pred")))


def op9_lang_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op9_lang_id": op9_lang_id}
ORACLES: dict[str, str] = {}
