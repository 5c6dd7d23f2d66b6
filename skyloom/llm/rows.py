"""Helpers on rows that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hash of a row's text; with doc_id it names the row where ids repeat.
TEXT_KEY = "text_key"

#: A list of row names is broadcast up to this many rows (two longs each), joined by a shuffle beyond.
BROADCAST_ROWS = 400_000


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` marked for broadcast if it was counted to be within the bound, else as it is.

    ``small`` is read from a written table, so counting it costs no recomputation.
    """
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``dropped`` names by doc_id and text key."""
    named = bounded(dropped.select(F.col("doc_id").alias("dropped_id"), F.col(TEXT_KEY).alias("dropped_key")))
    same = docs["doc_id"].eqNullSafe(named["dropped_id"]) & (text_key_of(docs) == named["dropped_key"])
    return docs.join(named, same, "left_anti")


def text_key_of(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, wherever their files are."""
    for table in tables:
        files = table.inputFiles()
        if files:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
