"""Ranked lexical search by the Best Position Algorithm.

Documents are dealt out in shards.  A shard keeps for every query term its
impact list: the documents that hold the term, highest impact first, and a
second order by document for direct access.  A query reads its terms' lists
from the top, all to the same depth; each document met there is looked up in
the other lists at once, which gives its whole score and its positions in them.
A list's best position is the end of the run of seen positions from its top, by
whichever way they were seen.  No document that is still unseen scores more
than the sum of the impacts just behind the best positions, so a query stops in
a shard when that sum is strictly below its k-th score.  The k best carry over
from shard to shard of a task, and the tasks' lists are merged.

Term weights come from the whole table, so a first pass counts documents, terms
and the documents of each query term, and writes the postings of query terms.
Queries are taken in blocks of at most about ``BLOCK_TERMS`` terms; their terms
and weights are what every task gets.

Defined results
    null or empty text       no terms: not counted as a document, no results as an item
    equal scores             the smaller doc_id first, null last
    null or repeated doc_id  every row is a document of its own
    repeated items           each row is ranked
    terms without weight     add nothing; documents without score are not returned
    empty tables             no rows
    very long texts          read whole
    extra columns            ignored
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.words import Words, ranges, slices
from skyloom.session import materialise

#: Results of an item; documents of a shard; item terms handled in one pass; positions read at first and at most in a round.
K, SHARD, BLOCK_TERMS, FIRST_STEP, LAST_STEP = 10, 8192, 1 << 18, 8, 512
#: Length correction in percent: its share of the average length, and the saturation's factors.
LENGTH_PERCENT, SCALE, FLAT, SLOPE = 75, 1_000_000_000, 1000, 8

#: Bytes of terms as they are, all others as spaces.
_TERM_BYTES = np.full(256, 0x20, np.uint8)
_TERM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [
    *range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x61, 0x7B), *range(0x80, 0x100)
]
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_NO_ID = np.iinfo(np.int64).max


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (row, term, n)
            for row, text in zip(batch.column("item_row").to_pylist(), batch.column("text").to_pylist())
            for term, n in Counter(_TERM.findall((text or "").encode().lower())).items()
        ]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32()))], names=["item_row", "term", "times"])


class _Vocabulary:
    """Terms with their hashes, for finding them among the words of a slice."""

    def __init__(self, terms: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.ends = np.cumsum([len(t) for t in terms])
        starts = self.ends - [len(t) for t in terms]
        # a term a text, so that none runs into the next
        hashes = Words(self.data, np.append(0, self.ends)).hashes
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.codes, self.starts = hashes[order], order.astype(np.int32), starts[order]
        self.lengths = (self.ends - starts)[order]

    def found(self, words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that are terms, and the terms' codes; equal hashes are compared byte by byte."""
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == words.hashes)
        at = at[hit]
        lengths = words.end[hit] - words.start[hit]
        fits = lengths == self.lengths[at]
        hit, at, lengths = hit[fits], at[fits], lengths[fits]
        if len(hit):
            equal = data[ranges(words.start[hit], lengths)] == self.data[ranges(self.starts[at], lengths)]
            same = np.logical_and.reduceat(equal, np.append(0, np.cumsum(lengths)[:-1]))
            hit, at = hit[same], at[same]
        return hit, self.codes[at]


def _counted(terms: list[bytes]):
    """doc_id, number of terms, and the codes and frequencies of the query terms of every document that has terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(terms)
        for batch in batches:
            for at, end, data, offsets in slices(batch.column("text")):
                data = _TERM_BYTES[data]
                words = Words(data, offsets)
                n = np.diff(words.first)
                hit, code = vocabulary.found(words, data)
                owner = np.searchsorted(words.first, hit, "right") - 1
                cells, tf = np.unique(owner * len(terms) + code, return_counts=True)
                owner, code = cells // len(terms), (cells % len(terms)).astype(np.int32)
                bounds = pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=end - at))).astype(np.int32))
                columns = [
                    batch.column("doc_id").slice(at, end - at), pa.array(n),
                    pa.ListArray.from_arrays(bounds, pa.array(code)), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32))),
                ]
                yield pa.record_batch(columns, names=["doc_id", "n", "codes", "tfs"]).filter(pa.array(n > 0))

    return count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code, n = np.unique(batch.column("codes").flatten().to_numpy(), return_counts=True)
        yield pa.record_batch([pa.array(code), pa.array(n)], names=["code", "n"])


class _Shard:
    """Impact lists of some documents, with direct access by document."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, owner: np.ndarray, code: np.ndarray, tf: np.ndarray) -> None:
        self.ids, self.n = ids, len(ids)
        impact = (SCALE * tf) // (FLAT * tf + SLOPE * lengths[owner])
        order = np.lexsort((owner, -impact, code))
        self.doc, self.impact, code = owner[order], impact[order], code[order]
        self.known, self.first = np.unique(code, return_index=True)
        self.last = np.append(self.first[1:], len(code))
        # direct access: cells in order of term and document, with their place in the impact lists
        cells = code.astype(np.int64) * self.n + self.doc
        self.place = np.argsort(cells, kind="stable")
        self.cells = cells[self.place]
        self.seen = np.zeros(len(code), bool)

    def direct(self, code: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Places in the lists (terms by documents), -1 where a document does not hold a term."""
        wanted = code.astype(np.int64)[:, None] * self.n + docs[None, :]
        at = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
        return np.where(self.cells[at] == wanted, self.place[at], -1)

    def best(self, codes: np.ndarray, weights: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``scores`` and ``ids``, the best so far, with those of this shard taken in."""
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        here = self.known[at] == codes
        at, codes, weights = at[here], codes[here], weights[here]
        first, last = self.first[at], self.last[at]
        best, depth, step = first.copy(), 0, FIRST_STEP
        met = np.zeros(self.n, bool)
        while True:
            # what is unseen adds at most the impact just behind each best position
            open_ = best < last
            bound = int((weights[open_] * self.impact[best[open_]]).sum())
            if bound == 0 or (len(scores) == k and bound < scores[-1]):
                break
            size = np.clip(last - first - depth, 0, step)
            docs = np.unique(self.doc[ranges(first + depth, size)])
            docs = docs[~met[docs]]
            depth, step = depth + step, min(2 * step, LAST_STEP)
            met[docs] = True
            if len(docs):
                places = self.direct(codes, docs)
                held = places >= 0
                self.seen[places[held]] = True
                total = (np.where(held, self.impact[places], 0) * weights[:, None]).sum(0)
                scores, ids = _merged(np.append(scores, total[total > 0]), np.append(ids, self.ids[docs[total > 0]]), k)
            for i in np.flatnonzero(open_):
                ahead = self.seen[best[i] : last[i]]
                stop = int(ahead.argmin())
                best[i] = last[i] if ahead[stop] else best[i] + stop
        for a, b in zip(first, last):
            self.seen[a:b] = False
        return scores, ids


def _merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _searched(queries: dict[int, tuple[np.ndarray, np.ndarray]], documents: int, words: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = {item: (none, none) for item in queries}
        for whole in batches:
            for at in range(0, whole.num_rows, SHARD):
                batch = whole.slice(at, SHARD)
                codes = batch.column("codes")
                owner = np.repeat(np.arange(batch.num_rows), codes.value_lengths().to_numpy().astype(np.int64))
                if not len(owner):
                    continue
                lengths = [100 - LENGTH_PERCENT + LENGTH_PERCENT * n * documents // words for n in batch.column("n").to_pylist()]
                ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
                shard = _Shard(ids, np.array(lengths, np.int64), owner, codes.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy().astype(np.int64))
                for item, (terms, weights) in queries.items():
                    best[item] = shard.best(terms, weights, k, *best[item])
        for item, (scores, ids) in best.items():
            if len(ids):
                found = pa.array(ids, mask=ids == _NO_ID)
                yield pa.record_batch([pa.array(np.full(len(ids), item)), found, pa.array(scores)], names=["item_row", "doc_id", "score"])

    return search


def term_weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def _of_block(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame | None:
    """Best documents of the items of one block, whose terms are few enough to be handed to every task."""
    wanted = rows.collect()  # at most about BLOCK_TERMS rows
    terms = sorted({bytes(r["term"]) for r in wanted})
    if not terms:
        return None
    code = {t: i for i, t in enumerate(terms)}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    postings = materialise(texts.mapInArrow(_counted(terms), "doc_id long, n long, codes array<int>, tfs array<int>"), "postings")
    documents, words = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    held = postings.select("codes").mapInArrow(_frequencies, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    weight = {r["code"]: term_weight(documents, r["n"]) for r in held.collect()}  # one row for each term of the block
    queries: dict[int, list[tuple[int, int]]] = {}
    for r in wanted:
        own = weight.get(code[bytes(r["term"])], 0) * r["times"]
        if own > 0:
            queries.setdefault(r["item_row"], []).append((code[bytes(r["term"])], own))
    if not queries:
        return None
    packed = {item: tuple(np.array(c, np.int64) for c in zip(*sorted(pairs))) for item, pairs in queries.items()}
    return postings.mapInArrow(_searched(packed, documents, words, k), "item_row long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item (item_id, text)."""
    spark = docs.sparkSession
    named = materialise(items.select("item_id", "text").withColumn("item_row", F.monotonically_increasing_id()), "items")
    terms = materialise(named.select("item_row", "text").mapInArrow(_item_terms, "item_row long, term binary, times int"), "item-terms")
    blocks = -(-terms.count() // BLOCK_TERMS)
    found = [_of_block(docs, terms.filter(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = spark.createDataFrame([], "item_row long, doc_id long, score long")
    for part in found:
        out = out if part is None else out.unionByName(part)
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(named.select("item_row", "item_id"), "item_row").select("item_id", "rank", "doc_id", "score")
