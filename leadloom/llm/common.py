"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import application_folder, cut, discard, shared_folder

__all__ = ["application_folder", "cut", "discard", "id_and_text", "joined", "let_go", "shared_folder", "text_slices", "unused"]

#: Texts are handled inside a task in pieces of about this many characters.
SLICE_BYTES = 4_000_000
#: A task forgets its per-word results when it holds this many.
CACHE_WORDS = 400_000


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished steps now, rather than when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``df`` has."""
    while name in df.columns:
        name += "_"
    return name


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs; a null text counts as empty.

    Columns of other names, whatever they are, never reach the operator.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Consecutive pieces of an Arrow string array as Python strings (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at, n = 0, len(texts)
    while at < n:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield at, [x or "" for x in texts.slice(at, to - at).to_pylist()]
        at = to


def joined(arrays: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """The results for the slices of one batch, as one array."""
    return pa.concat_arrays(arrays) if arrays else pa.array([], type=kind)
