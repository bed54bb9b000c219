"""Reading tables, and the relations of page analysis derived from generic ones.

A binding is SQL over {table} placeholders that means the same in Spark and in DuckDB: integer arithmetic and CASE only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The binding's rows in Spark."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def bind_placed(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """The rows of a binding that selects from the table `name` alone, with the place of the table's row: file, then row in it."""
    rows = table(spark, sf_dir, name).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return spark.sql(sql.replace("SELECT ", "SELECT place, ", 1), **{name: rows})


def as_sql(sql: str) -> str:
    """The binding as a subquery for DuckDB."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return f"({sql})"


#: One text line box for each line item: page, id, corner and size, score in thousandths.
BOXES = """
    SELECT l_orderkey AS page, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 100000 + l_suppkey AS id,
           CAST(l_partkey % 97 AS DOUBLE) AS x1, CAST(l_suppkey % 89 AS DOUBLE) AS y1,
           CAST(l_partkey % 97 + 5 + l_partkey % 31 AS DOUBLE) AS x2, CAST(l_suppkey % 89 + 5 + (l_suppkey * 3 + l_partkey) % 29 AS DOUBLE) AS y2,
           CAST((l_partkey * 7 + l_suppkey * 13) % 1000 AS BIGINT) AS score
    FROM {lineitem}"""
#: The same boxes as quadrilaterals that lean by a few pixels, in reading order of their corners.
QUADS = """
    SELECT page, id, x1 + s AS ax, y1 AS ay, x2 + s AS bx, y1 + t AS by, x2 AS cx, y2 + t AS cy, x1 AS dx, y2 AS dy, score
    FROM (SELECT *, CAST(id % 7 - 3 AS DOUBLE) AS s, CAST(id % 5 - 2 AS DOUBLE) AS t FROM (""" + BOXES + """) AS boxes) AS leaning"""
#: One page for each conversation, one text region for each turn; what a translator said about it.
TURNS = """
    SELECT conv_id AS page, turn + 1 AS i, CASE WHEN conv_id % 10 = 0 THEN replace(text, chr(10), ' ') ELSE text END AS source,
           CASE WHEN conv_id % 10 = 0 THEN replace(text, chr(10), ' ') WHEN turn % 5 = 1 THEN '   ' WHEN turn % 5 = 2 THEN '12345'
                WHEN turn % 5 = 3 THEN replace(replace(text, 'a', 'A'), 'e', 'E') WHEN turn % 5 = 4 THEN 'SFX bang' ELSE concat('T: ', text) END AS target
    FROM {conversations}"""
#: The raw reply, line by line: ids dropped, doubled, written loosely.
REPLY_LINES = """
    SELECT page, i, 0 AS k, concat(CASE WHEN i % 3 = 0 THEN '<' ELSE '<|' END, CAST(i AS VARCHAR(9)), CASE WHEN i % 2 = 0 THEN '|>' ELSE ' >|' END, ' ', replace(target, chr(10), ' ')) AS line
    FROM (""" + TURNS + """) AS t WHERE page % 10 = 0 OR (page + i) % 7 <> 0 AND page % 13 <> 5
    UNION ALL
    SELECT page, i, 1 AS k, concat('<|', CAST(i AS VARCHAR(9)), '|>again ', CAST(page AS VARCHAR(20))) AS line FROM (""" + TURNS + """) AS t WHERE (page + i) % 11 = 0 AND page % 10 <> 0 AND page % 13 <> 5
    UNION ALL
    SELECT page, 0 AS i, 0 AS k, '<think>plan <|1|>no</think>' AS line FROM (""" + TURNS + """) AS t WHERE i = 1"""
#: Recogniser steps: one strip for each user, five classes of which 0 is the blank.
STEPS = """
    SELECT user_id AS strip, ts AS t, event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS idx,
           -value / 100 AS logp
    FROM {events}"""
#: 8 x 8 images: signed values in thousandths, and grey levels.
PIXELS_SPARK = "SELECT vec_id AS img, label, pos DIV 8 AS y, pos % 8 AS x, CAST(CAST(e AS DOUBLE) * 1000 AS INT) AS v FROM (SELECT vec_id, label, posexplode(embedding) AS (pos, e) FROM {embeddings})"
PIXELS_DUCK = "(SELECT img, label, pos // 8 AS y, pos % 8 AS x, trunc(e::DOUBLE * 1000)::INT AS v FROM (SELECT vec_id AS img, label, unnest(embedding) AS e, unnest(range(0, 64)) AS pos FROM embeddings))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, label, y, x, v, g): v in thousandths, g = v mod 256."""
    return bind(spark, sf_dir, PIXELS_SPARK).selectExpr("img", "label", "y", "x", "v", "pmod(v, 256) AS g")


PIXELS = f"(SELECT *, ((v % 256) + 256) % 256 AS g FROM {PIXELS_DUCK})"
