"""Substring deduplication by a relative Lempel-Ziv parse over words.

Every document is read against an index of reference blocks taken from all
documents.  A block is a run of neighbouring windows of ``WINDOW`` words that
share their minimiser, the least hash among the windows' short word runs; equal
passages are therefore cut at equal places, wherever they stand.  The index is
a distributed hash table from block to the smallest document that holds it.

Parsing a document against the index gives its factors.  A block whose first
holder is a smaller document extends the current factor by all its windows at
once.  Where a minimiser occurs with different blocks a factor begins or ends
inside a block; there, and only there, single windows are checked against the
windows of the blocks' first holders.  A factor so covers exactly the windows
that also start in a smaller document, and all of its words are removed.

Why this is whole: equal windows have equal minimisers, so a window whose
minimiser lies in one document only repeats nowhere.  The smallest holder of a
window holds it in a block that no smaller document has, and the windows of all
such blocks take part in the check.

Defined results
    null or empty text   no words, nothing removed
    under 50 words       never touched
    null doc_id          takes no part: neither a reference nor cleaned
    repeated doc_id      rows with one doc_id never clean each other
    very long texts      read whole, as one slice of their own
    extra columns        carried through, whatever their names
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.rows import TEXT_KEY, text_key
from skyloom.llm.words import Words, ranges, slices
from skyloom.session import materialise

#: Words of a window, and of the runs among which its minimiser is chosen.
WINDOW, GRAM = 50, 8

_BLOCKS = "doc_id long, text_key long, minimiser long, start int, windows int, block long"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, in two passes over blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in slices(batch.column("text")):
            words = Words(data, offsets)
            n = len(words.hashes)
            counts = np.maximum(np.diff(words.first) - (WINDOW - 1), 0)
            if not counts.any():
                continue
            grams = words.runs(np.arange(n - GRAM + 1), GRAM)
            begin = ranges(words.first[:-1], counts)
            owner = np.repeat(np.arange(end - at), counts)
            least = _sliding_min(grams, WINDOW - GRAM + 1)[begin]
            fresh = np.ones(len(begin), bool)
            fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
            heads = np.flatnonzero(fresh)
            size = np.diff(np.append(heads, len(begin)))
            rows = pa.array(at + owner[heads])
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(rows), batch.column(TEXT_KEY).take(rows),
                    pa.array(least[heads].view(np.int64)),
                    pa.array((begin[heads] - words.first[owner[heads]]).astype(np.int32)), pa.array(size.astype(np.int32)),
                    pa.array(words.runs(begin[heads], size + (WINDOW - 1)).view(np.int64)),
                ],
                names=["doc_id", TEXT_KEY, "minimiser", "start", "windows", "block"],
            )


def _lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the lists of a column of arrays of structs, and the fields' values on end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    return sizes, [flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, (starts, windows) = _lists(batch.column("parts"), "start", "windows")
        ends = np.append(0, np.cumsum(sizes))
        for at, end, data, offsets in slices(batch.column("text")):
            words = Words(data, offsets)
            own = slice(ends[at], ends[end])
            owner = np.repeat(np.repeat(np.arange(end - at), sizes[at:end]), windows[own])
            offset = ranges(starts[own], windows[own])
            rows = pa.array(at + owner)
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(rows), batch.column(TEXT_KEY).take(rows), pa.array(offset.astype(np.int32)),
                    pa.array(words.runs(words.first[owner] + offset, WINDOW).view(np.int64)),
                ],
                names=["doc_id", TEXT_KEY, "start", "window"],
            )


def factors(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and ``factors``, the (start, words) of the word spans to remove, for documents that have any."""
    texts = docs.select("doc_id", "text", text_key().alias(TEXT_KEY)).filter("doc_id is not null")
    index = materialise(texts.mapInArrow(_blocks_of, _BLOCKS), "blocks")
    shared = (
        index.groupBy("minimiser")
        .agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"), (F.min("block") != F.max("block")).alias("split"))
        .filter("smallest < largest")
        .select("minimiser", "smallest", "split")
    )
    met = materialise(index.join(shared, "minimiser"), "shared-blocks")
    words = (F.col("windows") + (WINDOW - 1)).alias("words")
    whole = met.filter("not split and doc_id > smallest").select("doc_id", TEXT_KEY, "start", words)

    inside = met.filter("split").select("doc_id", TEXT_KEY, "start", "windows", "block")
    # both minima are written, so that the joins with them shuffle either side and a hot block or window can be split
    holders = materialise(inside.groupBy("block").agg(F.min("doc_id").alias("holder")), "holders")
    placed = materialise(inside.join(holders, "block"), "split-blocks")
    later = placed.filter("doc_id > holder").select("doc_id", TEXT_KEY, "start", words)

    parts = (
        placed.filter("doc_id = holder")
        .groupBy("doc_id", TEXT_KEY)
        .agg(F.sort_array(F.collect_set(F.struct("start", "windows"))).alias("parts"))
    )
    single = materialise(
        texts.join(parts, ["doc_id", TEXT_KEY]).mapInArrow(_windows_of, "doc_id long, text_key long, start int, window long"),
        "windows",
    )
    firsts = materialise(single.groupBy("window").agg(F.min("doc_id").alias("first")), "firsts")
    edges = single.join(firsts, "window").filter("doc_id > first").select("doc_id", TEXT_KEY, "start", F.lit(WINDOW).alias("words"))
    # spans of one document: no more than it has words
    spans = whole.unionByName(later).unionByName(edges)
    return spans.groupBy("doc_id", TEXT_KEY).agg(F.collect_list(F.struct("start", "words")).alias("factors"))


def _cleaned(keep_text: bool, names: list[str]):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, (starts, lengths) = _lists(batch.column("factors"), "start", "words")
            ends = np.append(0, np.cumsum(sizes))
            for at, end, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                n = len(words.hashes)
                own = slice(ends[at], ends[end])
                begin = np.repeat(words.first[:-1], sizes[at:end]) + starts[own]
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + lengths[own], -1)
                gone = np.cumsum(cover[:n]) > 0
                kept = np.flatnonzero(~gone)
                # kept words with the byte after each, which becomes the space
                size = words.end[kept] - words.start[kept] + 1
                joined = np.append(data, np.uint8(0x20))[ranges(words.start[kept], size)]
                stops = np.cumsum(size)
                joined[stops - 1] = 0x20
                bytes_at = np.append(0, stops)[np.searchsorted(kept, words.first)]
                total, left = np.diff(words.first), np.diff(np.searchsorted(kept, words.first))
                joined = joined.tobytes()
                texts = [joined[a : max(a, b - 1)] for a, b in zip(bytes_at[:-1], bytes_at[1:])]
                part = batch.slice(at, end - at)
                out = {name: part.column(name) for name in names}
                if keep_text:
                    old = part.column("text").to_pylist()
                    new = [o if t == k else x.decode() for o, x, t, k in zip(old, texts, total, left)]
                    out["text"] = pa.array(new, pa.string())
                else:
                    out["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in texts])
                out["n_words"], out["n_removed"] = pa.array(total), pa.array(total - left)
                yield pa.record_batch(list(out.values()), names=list(out))

    return clean


def removed_words(docs: DataFrame) -> DataFrame:
    """doc_id, kept_sha256, n_words and n_removed of every row."""
    texts = docs.select("doc_id", "text", text_key().alias(TEXT_KEY))
    read = texts.join(factors(docs), ["doc_id", TEXT_KEY], "left").select("doc_id", "text", "factors")
    return read.mapInArrow(_cleaned(False, ["doc_id"]), "doc_id long, kept_sha256 string, n_words long, n_removed long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; a row left without any word goes.

    Texts that lose nothing stay as they are, others are their kept words with
    one space between them.  ``n_chars``, where there is one, is counted anew.
    """
    own = f"{TEXT_KEY} row of docs"  # a name that no column of docs is likely to have
    keyed = docs.withColumn(own, text_key())
    found = factors(docs).select(F.col("doc_id").alias(f"{own} id"), F.col(TEXT_KEY).alias(f"{own} key"), "factors")
    spans = found.withColumnRenamed("factors", f"{own} spans")
    joined = keyed.join(spans, (F.col("doc_id") == F.col(f"{own} id")) & (F.col(own) == F.col(f"{own} key")), "left")
    names = [c for c in docs.columns if c != "text"]
    inner = joined.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], "text", F.col(f"`{own} spans`").alias("factors"))
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = inner.mapInArrow(_cleaned(True, [f.name for f in fields]), schema).filter("n_removed = 0 or n_removed < n_words")
    back = {c: F.col(f"c{i}") for i, c in enumerate(names)} | {"text": F.col("text")}
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("n_removed") == 0, back["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[back[c].alias(c) for c in docs.columns])
