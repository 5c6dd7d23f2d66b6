"""Exact deduplication by content-defined chunk recipes.

A text is normalised, cut into chunks at places that its own characters choose,
and written down as the ordered list of its chunks' identifiers: its recipe.
Chunks are deduplicated once; an identifier counts as verified when all chunks
that carry it have the same content.  Documents are then compared by recipes,
which are some thirty times shorter than texts, so long documents are not moved
again.  Everything here is DataFrame operations.

Defined results
    null text        counts as the empty text; all empty texts are one group
    null doc_id      never the row that stays unless the group has no other
    repeated rows    every row counts in ``group_size``; rows that carry the
                     staying doc_id are all marked kept
    very long texts  cut into chunks of at most ``MAX_CHUNK`` characters
    extra columns    ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.rows import TEXT_KEY, discard, text_key, without_rows
from skyloom.session import materialise

#: Characters in a chunk, at least and at most.
MIN_CHUNK, MAX_CHUNK = 256, 1024

SPACES = r"[\x20\x09-\x0D]+"


def _cut_class(salt: int) -> str:
    """A quarter of the Latin characters, chosen by a multiplicative hash of their codes."""
    codes = [c for c in range(0x20, 0x250) if ((c + salt) * 2654435761 >> 7) % 4 == 0]
    return "[" + "".join(f"\\x{{{c:x}}}" for c in codes) + "]"


#: A chunk ends at the first hit of two cut classes after the least length, or at the greatest length.
CHUNK = f"(?s).{{{MIN_CHUNK - 2},{MAX_CHUNK - 2}}}?{_cut_class(0)}{_cut_class(1)}|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def chunk_table(docs: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, text_sha256, chunks and recipe of every row, written once."""
    texts = docs.select("doc_id", text_key().alias(TEXT_KEY), normalised(F.col("text")).alias("norm"))
    cut = texts.select(
        "doc_id", TEXT_KEY,
        F.sha2("norm", 256).alias("text_sha256"),
        F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"),
    )
    return materialise(cut.withColumn("recipe", F.transform("chunks", lambda chunk: hash_of(chunk))), "chunks")


def ambiguous_chunks(table: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Chunks whose identifier also names another content, with an ordinal that tells them apart."""
    chunk = table.select(F.explode("chunks").alias("chunk")).withColumn("id", hash_of(F.col("chunk")))
    distinct = chunk.groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    shared = materialise(distinct.groupBy("id").agg(F.count("one").alias("contents")).filter("contents > 1"), "shared-ids")
    if shared.isEmpty():  # so that texts move a second time only where 64 bits clash
        return shared.select("id", F.lit(0).alias("ordinal"), F.lit("").alias("chunk"))
    clashing = chunk.join(shared.select("id"), "id", "left_semi").distinct()
    # a group holds the few contents that clash on 64 bits, not the documents that hold them
    names = clashing.groupBy("id").agg(F.sort_array(F.collect_set("chunk")).alias("contents"))
    return names.select("id", F.posexplode("contents").alias("ordinal", "chunk"))


def recipes(table: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, text_sha256 and a recipe of verified identifiers for every row of a chunk table."""
    clashes = materialise(ambiguous_chunks(table, hash_of), "clashes")
    if clashes.isEmpty():
        return table.select("doc_id", TEXT_KEY, "text_sha256", "recipe")
    numbered = table.withColumn("row", F.monotonically_increasing_id())
    numbered = materialise(numbered, "numbered-chunks")
    pieces = numbered.select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("id", hash_of(F.col("chunk")))
    named = pieces.join(clashes, ["id", "chunk"], "left")
    verified = named.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("pos", "id", F.coalesce("ordinal", F.lit(0)).cast("long").alias("ordinal")))).alias("ids")
    )
    both = F.flatten(F.transform("ids", lambda x: F.array(x["id"], x["ordinal"])))
    empty = F.array().cast("array<bigint>")
    return numbered.join(verified, "row", "left").select(
        "doc_id", TEXT_KEY, "text_sha256", F.coalesce(both, empty).alias("recipe")
    )


def exact_groups(docs: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """For every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and the row's text key."""
    return grouped(chunk_table(docs, hash_of), hash_of)


def grouped(table: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The same from a chunk table."""
    listed = recipes(table, hash_of).withColumn("key", F.xxhash64("recipe"))
    groups = (
        listed.groupBy("key", "recipe")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    # written, so that the join below has a shuffle of its own on either side and a hot group can be split
    groups = materialise(groups, "copies")
    found = listed.join(groups, ["key", "recipe"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", TEXT_KEY,
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat one doc_id with equal texts are one document and stay once;
    so do rows without a doc_id that have equal texts.
    """
    table = chunk_table(docs)
    decided = materialise(grouped(table), "exact-groups")
    discard(table)  # as large as the texts; the decisions are written
    kept = without_rows(docs, decided.filter("not kept").select("doc_id", TEXT_KEY))
    again = decided.filter("kept").groupBy("doc_id", TEXT_KEY).count().filter("count > 1")
    if again.isEmpty():
        return kept
    return kept.withColumn(TEXT_KEY, text_key()).dropDuplicates(["doc_id", TEXT_KEY]).select(docs.columns)
