"""Recogniser output and box suppression: folds and windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = 0


def ctc_collapse(steps: DataFrame, strip: str = "strip", order: tuple[str, ...] = ("t",), idx: str = "idx") -> DataFrame:
    """Steps that emit a symbol: not blank, and not the class of the step before (which may be the blank)."""
    before = F.lag(idx, 1, BLANK).over(Window.partitionBy(strip).orderBy(*order))
    return steps.withColumn("__before", before).where((F.col(idx) != BLANK) & (F.col(idx) != F.col("__before"))).drop("__before")


def ctc_text(steps: DataFrame, alphabet: DataFrame, strip: str = "strip", order: tuple[str, ...] = ("t",)) -> DataFrame:
    """(strip, text, prob): symbols of alphabet (idx, symbol) in order, and exp of the mean log-probability; 0 if none is emitted."""
    got = ctc_collapse(steps, strip, order).join(F.broadcast(alphabet), "idx")  # one row a class
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "symbol"))), lambda x: x["symbol"]), "")
    text = got.groupBy(strip).agg(line.alias("text"), F.exp(F.avg("logp")).alias("prob"))
    every = steps.select(strip).distinct()
    return every.join(text, strip, "left").select(strip, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("prob", F.lit(0.0)).alias("prob"))


def log_softmax_top1(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, top, logp): the first largest entry and its log-softmax. No row explodes: folds over the array."""
    v = F.transform(vector, lambda x: x.cast("double"))
    best = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - best))
    return vectors.select(key, (F.array_position(v, best) - 1).cast("int").alias("top"), (-F.ln(total)).alias("logp"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def nms(boxes: DataFrame, group: str, threshold: float, score: str = "score", key: str = "id", limit: int | None = None) -> DataFrame:
    """Greedy suppression in each group: highest score first, ties by key; a box goes if it overlaps a kept one by more than threshold.

    One fold over the sorted boxes of a group (a page's detections). A limit may be applied last: later boxes never affect earlier ones.
    """
    box = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), "x1", "y1", "x2", "y2")
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])

    def overlap(a, b):
        w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
        h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
        return w * h / (area(a) + area(b) - w * h + F.lit(1e-9))

    rows = boxes.groupBy(group).agg(F.array_sort(F.collect_list(box)).alias("b"))
    fold = F.aggregate("b", F.slice("b", 1, 0), lambda kept, v: F.when(F.exists(kept, lambda k: overlap(k, v) > threshold), kept).otherwise(F.concat(kept, F.array(v))))
    if limit:
        fold = F.slice(fold, 1, limit)
    return rows.select(group, F.explode(fold).alias("b")).select(group, F.col("b.k").alias(key))


def dedupe_consecutive(rows: DataFrame, group: str, order: tuple[str, ...], value: str) -> DataFrame:
    """Rows whose value differs from the one before (equality is transitive, so the last emitted one is the same)."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__b", before).where(~F.col(value).eqNullSafe(F.col("__b")) | F.col("__b").isNull()).drop("__b")


def position_table(spark, rows: int, width: int) -> DataFrame:
    """(t, d, value): sin at even places and cos at odd ones of t * exp(-2i ln(10000) / width)."""
    grid = spark.range(rows * width).select((F.col("id") / width).cast("int").alias("t"), (F.col("id") % width).cast("int").alias("d"))
    angle = F.col("t") * F.exp(F.floor(F.col("d") / 2) * 2 * (-F.ln(F.lit(10000.0)) / width))
    return grid.select("t", "d", F.when(F.col("d") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("value"))


def anchor_decode(cells: DataFrame, stride: int, size: int, per_row: int) -> DataFrame:
    """cells (idx, l, t, r, b): boxes around the cell's corner at distances relu(x) * stride, kept within 0..size."""
    px, py = (F.col("idx") % per_row) * stride, F.floor(F.col("idx") / per_row) * stride
    d = lambda c: F.greatest(F.col(c), F.lit(0.0)) * stride
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(float(size)), c))
    return cells.select("*", clamp(px - d("l")).alias("x1"), clamp(py - d("t")).alias("y1"), clamp(px + d("r")).alias("x2"), clamp(py + d("b")).alias("y2"))


def class_argmax(rows: DataFrame, scores: str, wanted: int, least: float) -> DataFrame:
    """rows with score where the first largest of the class scores is the wanted class and above least."""
    best = F.array_max(scores)
    return rows.where((F.array_position(scores, best) == wanted + 1) & (best > least)).withColumn("score", best).drop(scores)
