"""Best-fit packing of token pieces into sequences by hierarchical residual packing.

Documents are tokenised and cut once.  Each partition of pieces is packed best
fit, longest first, and its nearly full bins are final.  Underfull bins go up
the tree: they are opened into their pieces (a bin over half full could not
merge with another one whole), the pieces of several partitions meet in one
group of at most about ``GROUP`` pieces, and best fit runs again.  Each round
leaves fewer pieces over; the last group, or a round that closes almost nothing
more, closes all that it has.  No group grows with the input.

Defined results
    null or empty text   one piece that holds the end token alone
    very long texts      cut into pieces of ``CAPACITY``, the first one shorter
    repeated or null doc_id   every row has pieces of its own
    extra columns        ignored
    empty table          no rows
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.tokens import encoder, special_tokens
from skyloom.llm.words import ranges, slices
from skyloom.session import materialise

#: Tokens of a sequence; tokens that a nearly full one may lack; pieces of a group of the tree.
CAPACITY, SLACK, GROUP = 1024, 2, 100_000
#: The id that ends each document.
END = 2

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECE}, sequence_id long, offset long, closed boolean"


def _pieces(path: str, capacity: int, keep_ids: bool):
    special = special_tokens(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special).encode
        for batch in batches:
            for at, end, _, _ in slices(batch.column("text")):
                part = batch.slice(at, end - at)
                total, ids = encode(part.column("text"), END)
                ids = ids.flat()
                count = -(-total // capacity)
                owner = np.repeat(np.arange(len(total)), count)
                piece = ranges(np.zeros(len(total), np.int64), count)
                head = (total - 1) % capacity + 1  # the first piece's length
                length = np.where(piece == 0, head[owner], capacity)
                start = np.where(piece == 0, 0, head[owner] + (piece - 1) * capacity)
                begin = np.append(0, np.cumsum(total))[owner] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
                columns = [part.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:  # pieces of a text follow each other, so their ids do
                    offsets = pa.array(np.append(0, np.cumsum(length)).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    return cut


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of each row's ids; ``keep_ids`` adds the ids themselves."""
    schema = _PIECE + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, keep_ids), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, longest first into the fullest bin that has room, and the bins' fills."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, room_of = 0, []  # bit r: some bin has room for r more
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(room_of)
            room_of.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room -= size
        room_of[b] = room
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins, offsets, capacity - np.array(room_of, np.int64)


def _packed(level: int, capacity: int, slack: int, final: bool):
    """Packs what a partition holds; bins get numbers that no other level or partition uses."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = ((level << 24) + TaskContext.get().partitionId()) << 32
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        bins, offsets, fills = best_fit(table.column("length").to_numpy(), capacity)
        closed = (fills >= capacity - slack) | final
        out = table.append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offsets))
        yield from out.append_column("closed", pa.array(closed[bins])).to_batches(max_chunksize=50_000)

    return pack


def packed(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, group: int = GROUP) -> DataFrame:
    """``items``, rows of pieces with a ``length``, with their sequence_id and offset."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    level, final = 0, False
    placed = materialise(items.select(names).mapInArrow(_packed(0, capacity, slack, False), _PLACED), "packed-0")
    done = placed.filter("closed")
    left, open_ = None, placed.filter("not closed")
    while not final:
        before, left = left, open_.count()
        if not left:
            break
        groups = -(-left // group)
        final = groups == 1 or (before is not None and left > 0.9 * before)
        level += 1
        dealt = open_.select(*names, F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(level)), F.lit(groups)).alias("group"))
        met = dealt.repartition(groups, "group").select(names)
        placed = materialise(met.mapInArrow(_packed(level, capacity, slack, final), _PLACED), f"packed-{level}")
        done, open_ = done.unionByName(placed.filter("closed")), placed.filter("not closed")
    return done.select(*names, "sequence_id", "offset")


def packed_documents(docs: DataFrame, path: str) -> DataFrame:
    """Every document's pieces with the sequence and offset that they got."""
    return packed(materialise(pieces(docs, path), "pieces"))


def token_sequences(docs: DataFrame, path: str) -> DataFrame:
    """sequence_id and the ``ids`` of each full sequence, in the order of the offsets."""
    cut = materialise(pieces(docs, path, keep_ids=True), "pieces")
    placed = packed(cut)
    where = placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    joined = where.join(cut.dropDuplicates(["doc_id", "piece", "start", "length", "ids_crc32"]), ["doc_id", "piece", "start", "length", "ids_crc32"])
    # a sequence has at most its capacity in tokens, so its list is bounded
    parts = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
