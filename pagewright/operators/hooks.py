"""Places for the caller's own callables: translators, models, stages and sinks.

A callable travels to the workers with the plan and meets one page at a time; configuration is its own argument. Errors of a page
become that page's `error`, so that one page cannot fail a run.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def translate_pages(regions: DataFrame, translator: Callable[[list[str]], list[str]] | None, post: Callable[[Column], Column] | None = None) -> DataFrame:
    """regions (page, i, source, ...) with translated and error. translator: the texts of a page in order of i to as many texts; None lays
    the source out. post: a last change of every translated text, as a Column function. Null sources are passed as empty texts."""
    if translator is None:
        out = regions.withColumns({"translated": F.col("source"), "error": F.lit(None).cast("string")})
    else:
        schema = StructType([*regions.schema.fields, StructField("translated", StringType()), StructField("error", StringType())])

        def page(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("i", kind="stable")
            got, error = [None] * len(rows), None
            try:
                got = list(translator(rows["source"].fillna("").tolist()))
                if len(got) != len(rows):
                    got, error = [None] * len(rows), f"{len(got)}/{len(rows)}"
            except Exception as e:  # the caller's code: its failure is the page's result
                error = f"{type(e).__name__}: {e}"
            return rows.assign(translated=got, error=error)

        out = regions.groupBy("page").applyInPandas(page, schema)
    return out if post is None else out.withColumn("translated", post(F.col("translated")))


def run_model(tensors: DataFrame, model: Callable[[dict], dict], inputs: dict[str, tuple], outputs: dict[str, tuple]) -> DataFrame:
    """tensors (key, one array column for each input) with an array column for each output, and error.

    A shape is a tuple of sizes, None for any. model gets a row's inputs as numpy arrays of their shapes and returns the outputs by name;
    inputs or outputs of another size give an error and null outputs, as does a model that raises."""
    import numpy as np

    def fit(values, shape, name):
        a = np.asarray(values, np.float32)
        known = int(np.prod([s for s in shape if s is not None]))
        if a.size % known or (None not in shape and a.size != known):
            raise ValueError(f"{name}: {a.size} numbers do not fit {shape}")
        return a.reshape([-1 if s is None else s for s in shape])

    def one(row: dict) -> dict:
        try:
            got = model({k: fit(row[k], s, k) for k, s in inputs.items()})
            return {**{k: fit(got[k], s, k).ravel().tolist() for k, s in outputs.items()}, "error": None}
        except Exception as e:  # a model's failure is the row's result
            return {**dict.fromkeys(outputs), "error": f"{type(e).__name__}: {e}"}

    def run(batches):
        for b in batches:
            found = [one(r) for r in b[list(inputs)].to_dict("records")]
            yield b[["key"]].assign(**{k: pd.Series([f[k] for f in found], index=b.index, dtype=object) for k in [*outputs, "error"]})

    extra = StructType.fromDDL(", ".join(f"{k} array<float>" for k in outputs) + ", error string")
    return tensors.mapInPandas(run, StructType([tensors.schema["key"], *extra.fields]))


def run_stages(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stage callables (detect, segment, before rendering, ...) one after the other; None stands for a stage left out."""
    for s in stages:
        df = df if s is None else s(df)
    return df


def union_masks(pages: DataFrame, segmenter: Callable[[list], list], mask: str = "mask") -> DataFrame:
    """pages (page, values, mask) with the mask joined by the segmenter's own: an array of booleans for the array of values."""
    found = F.pandas_udf(lambda v: v.map(lambda x: [bool(m) for m in segmenter(list(x))]), "array<boolean>")
    return pages.withColumn(mask, F.zip_with(mask, found("values"), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))))


def to_sink(outputs: DataFrame, sink: Callable[[dict], str], key: str = "page") -> DataFrame:
    """(key, tier, receipt): every output row is handed to sink once it is made and let go after it returns; one row is held at a time.

    A lost task hands its rows over again, so a sink must take repeats."""

    def run(batches):
        for b in batches:
            for r in b.to_dict("records"):
                yield pd.DataFrame([{key: r[key], "tier": r["tier"], "receipt": str(sink(r))}])

    return outputs.mapInPandas(run, StructType([outputs.schema[key], outputs.schema["tier"], StructField("receipt", StringType())]))
