"""Exact dedup with two Bloom passes.

Pass 1 hashes every text and counts, in a filter of counters that saturate at two, how often each position was
hit; only the positions hit twice matter, so they alone are kept as a bitmap. Pass 2 tests every row against the
bitmap: a row whose positions were not all hit twice has no equal text anywhere and goes straight through. Only the
remaining rows shuffle; they are grouped by SHA-256 of the text, so false positives of the filter change nothing.

The filter has BITS_PER_ROW positions for each row up to MAX_BITS (a 32 MB bitmap, the largest thing that is
broadcast). Beyond about MAX_BITS / BITS_PER_ROW rows it only fills up: more rows shuffle, the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import cut, drop_existing, fresh, salted_lookup, shelter

BITS_PER_ROW = 16
MAX_BITS = 1 << 28
PROBES = 2


def filter_bits(rows: int) -> int:
    bits = 1 << 16
    while bits < min(MAX_BITS, rows * BITS_PER_ROW):
        bits <<= 1
    return bits


def _probes(text, bits: int) -> list:
    h = F.xxhash64(text)
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))][:PROBES]


def repeated_positions(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """The bitmap of positions hit at least twice: (bucket, bitmap), 4 KB of bits a row."""
    hit = docs.select(F.explode(F.array_distinct(F.array(*_probes(F.coalesce(F.col(text), F.lit("")), bits)))).alias("p"))
    twice = hit.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.select(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket"), F.bitmap_bit_position(F.col("p") + 1).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def flag_possible(docs: DataFrame, text: str, flag: str) -> DataFrame:
    """docs with a boolean that is false only for texts that occur once."""
    bits = filter_bits(docs.count())
    maps = cut(repeated_positions(docs, text, bits), "bloom")  # used several times; at most MAX_BITS / 8 bytes
    out, test = docs, F.lit(True)
    for i, p in enumerate(_probes(F.coalesce(F.col(text), F.lit("")), bits)):
        key, bitmap = fresh(docs, f"bucket{i}", f"bitmap{i}")
        m = F.broadcast(maps.select(F.col("bucket").alias(key), F.col("bitmap").alias(bitmap)))  # at most MAX_BITS / 8 bytes
        bit = F.bitmap_bit_position(p + 1)
        byte = F.hex(F.substring(F.col(bitmap), F.shiftright(bit, 3).cast("int") + 1, F.lit(1)))
        one = F.conv(byte, 16, 10).cast("int")
        out = out.withColumn(key, F.bitmap_bucket_number(p + 1)).join(m, key, "left")
        mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (F.pmod(bit, F.lit(8)) + 1).cast("int"))
        test = test & F.coalesce(one.bitwiseAND(mask) != 0, F.lit(False))
    return out.withColumn(flag, test).select(*[F.col(f"`{c}`") for c in docs.columns], flag)


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with keep_id, group_size and kept: of equal texts, the row with the largest key stays.

    A null text counts as empty; an empty text equals other empty texts. A null key is smaller than any other; if all
    keys of a group are null, keep_id is null and all its rows are kept. Rows that repeat both text and key are one
    document: they count in group_size and are kept or dropped together (drop_exact_duplicates leaves one of them).
    Columns of docs named keep_id, group_size or kept are replaced. Empty tables give empty results.
    """
    docs = drop_existing(docs, ["keep_id", "group_size", "kept"])
    maybe, digest = fresh(docs, "maybe", "digest")
    flagged = flag_possible(docs, text, maybe)
    alone = flagged.where(~F.col(maybe)).drop(maybe).withColumns({"keep_id": F.col(key), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    rows = flagged.where(F.col(maybe)).drop(maybe).withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    groups = rows.groupBy(digest).agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = salted_lookup(rows, groups, [digest], F.coalesce(F.col(key).cast("string"), F.lit("")), how="inner").drop(digest)
    return alone.unionByName(found.withColumn("kept", F.col(key).eqNullSafe(F.col("keep_id"))))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that exact_dedup keeps, rows that repeat text and key once."""
    kept = exact_dedup(docs, text, key).where("kept")
    once = kept.where("group_size = 1")
    again = kept.where("group_size > 1").dropDuplicates([key, text])
    return once.unionByName(again).drop("keep_id", "group_size", "kept")


def stage_exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of equal texts the document with the largest doc_id, rows that repeat it once.

    Null and empty texts are one group; of rows whose doc_id is null, one for each text stays if its group has no other; an empty
    table stays empty; columns of docs with the operator's names keep their values."""
    safe, back = shelter(docs, ["keep_id", "group_size", "kept"])
    return back(drop_exact_duplicates(safe))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents"""
}
