"""Merkle manifest of a table: a postorder append log of every tree, proofs and their check.

Each row is a leaf.  The leaves of one tree (a source) are numbered in order,
and aligned builders take ranges of ``FAN ** BUILD`` of them.  A builder appends
nodes in the order in which they are completed: a leaf, and after every
``FAN``-th child its parent, at the end what is still open.  That is postorder,
so the place of every node follows from the sizes of the subtrees before it,
and a proof reads a leaf's siblings from those places without an index.  A
builder's top node is an item of the next round; rounds go on until a tree has
one node.  The trees' roots are the leaves of one more tree.

Numbers come from a sort by ranges: the position within a range's part plus the
number of the tree's rows in earlier parts, so a tree with a third of all rows
is spread over many tasks.  A builder holds ``FAN ** BUILD`` digests.

Defined results
    null fields          ``-`` in the leaf's input; an empty text is ``0:``
    null source          a tree of its own, before all others
    null doc_id          before all others of its source
    repeated doc_id, repeated rows   a leaf each, equal ids in order of their digests
    one leaf             is its tree's root; its proof has no siblings there
    empty table          no rows
    very long texts      hashed whole
    extra columns        ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.llm.rows import bounded
from skyloom.session import materialise

#: Children of a node; levels that one builder completes; the columns of a leaf, in order.
FAN, BUILD, FIELDS = 16, 3, ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of an aligned builder.
RANGE = FAN**BUILD


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields on end, each as its UTF-8 byte count, a colon and its value."""

    def one(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[one(f) for f in fields]), 256))


def node_digest(children: str) -> str:
    """The digest of a node from its children's digests as hex text on end."""
    return hashlib.sha256(children.encode()).hexdigest()


def height(leaves: int) -> int:
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def position(level: int, index: int, leaves: int) -> int:
    """Where the log of a tree of ``leaves`` has node ``index`` of ``level``.

    Its last leaf comes after all leaves before it and after every inner node
    that those completed; the node itself follows ``level`` places later.
    """
    last = min((index + 1) * FAN**level, leaves) - 1
    place, step = last + level, FAN
    while step <= last:
        place += last // step
        step *= FAN
    return place


def append_log(leaves: list[str], levels: int) -> list[str]:
    """All nodes above ``leaves`` up to ``levels``, with the leaves, in order of completion."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]

    def add(level: int, digest: str) -> None:
        log.append(digest)
        open_[level].append(digest)
        if level < levels and len(open_[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        children, open_[level] = "".join(open_[level]), []
        add(level + 1, node_digest(children))

    for leaf in leaves:
        add(0, leaf)
    for level in range(levels):
        if open_[level]:
            close(level)
    return log


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``at``: the position of each row among its tree's rows in a sorted partition."""
    tree, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("tree")
        codes = names.dictionary_encode().indices.to_numpy()
        heads = np.append(0, np.flatnonzero(codes[1:] != codes[:-1]) + 1)
        at = np.arange(batch.num_rows) - np.repeat(heads, np.diff(np.append(heads, batch.num_rows)))
        if names[0].as_py() == tree:
            at[: heads[1] if len(heads) > 1 else None] += seen
        tree, seen = names[-1].as_py(), int(at[-1]) + 1
        yield pa.record_batch([*batch.columns, pa.array(at.astype(np.int64))], names=[*batch.schema.names, "at"])


def _with(df: DataFrame, columns: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(columns).fields])


def numbered_leaves(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, leaf, ...) with place and n: its number within its tree, and the tree's size."""
    kept = rows.columns
    ranged = rows.repartitionByRange("tree", *order, "leaf").sortWithinPartitions("tree", *order, "leaf")
    at = ranged.withColumn("part", F.spark_partition_id())
    schema = _with(at, "at long")
    at = materialise(at.mapInArrow(_places, schema), "leaf-parts")
    parts = at.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "tree", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("start"), F.sum("here").over(Window.partitionBy("tree")).alias("n")
    )
    placed = at.join(bounded(materialise(starts, "leaf-starts")), ["tree", "part"])
    return placed.select(*kept, (F.col("start") + F.col("at")).alias("place"), "n")


def _levels_of(n: int) -> int:
    """Levels that a builder adds in a tree that has ``n`` items in this round."""
    return BUILD if n > RANGE else height(n)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        logs, tops = [], []
        for items, n in zip(batch.column("items"), batch.column("n").to_pylist()):
            leaves = [leaf.hex() for leaf in items.values.field("leaf").to_pylist()]
            log = append_log(leaves, _levels_of(n))
            logs.append(bytes.fromhex("".join(log)))
            tops.append(bytes.fromhex(log[-1]))
        yield pa.record_batch([*batch.columns, pa.array(logs, pa.binary()), pa.array(tops, pa.binary())], names=[*batch.schema.names, "log", "top"])


class Forest:
    """The logs of all trees over ``rows`` (tree string, leaf binary, carried columns), by rounds of builders."""

    def __init__(self, rows: DataFrame, order: list[str]) -> None:
        self.rounds: list[DataFrame] = []
        carried = [c for c in rows.columns if c not in ("tree", "leaf")]
        items = numbered_leaves(rows, order)
        while True:
            cells = F.array_sort(F.collect_list(F.struct("place", "leaf", *carried))).alias("items")
            block = F.floor(F.col("place") / RANGE).alias("block")
            groups = items.groupBy("tree", block, "n").agg(cells)
            schema = _with(groups, "log binary, top binary")
            self.rounds.append(materialise(groups.mapInArrow(_built, schema), "merkle-log"))
            tops = self.rounds[-1].filter(F.col("n") > RANGE)
            if tops.isEmpty():
                break
            items = tops.select("tree", F.col("block").alias("place"), F.ceil(F.col("n") / RANGE).alias("n"), F.col("top").alias("leaf"))
            carried = []

    def roots(self) -> DataFrame:
        """tree, root."""
        done = [r.filter(F.col("n") <= RANGE).select("tree", F.col("top").alias("root")) for r in self.rounds]
        return _union(done)

    def log(self) -> DataFrame:
        """tree, position, level, index and digest of every node, positions being those of the tree's whole log."""
        parts = [r.select("tree", "block", "n", "log", F.lit(k * BUILD).alias("base")) for k, r in enumerate(self.rounds)]
        # the size of the whole tree is that of its first round
        sizes = self.rounds[0].select("tree", F.col("n").alias("leaves")).distinct()
        nodes = _union(parts).mapInArrow(_nodes, "tree string, level int, index long, digest string")
        whole = F.least((F.col("index") + 1) * F.pow(F.lit(FAN), "level").cast("long"), "leaves") - 1
        before = sum(F.floor(F.col("last") / F.lit(FAN**k)) for k in range(1, 15))
        placed = nodes.join(sizes, "tree").withColumn("last", whole).withColumn("position", F.col("last") + F.col("level") + before)
        return placed.select("tree", "position", "level", "index", "digest")

    def proven(self, above: DataFrame) -> DataFrame:
        """The first round's rows with ``path``, the siblings of their top node up to the root, and the columns of ``above``.

        ``above`` has for each tree the path of its root, and columns that all rows shall carry.
        """
        carried = [c for c in above.columns if c not in ("tree", "path")]
        down = None
        for k in range(len(self.rounds) - 1, -1, -1):
            rows = self.rounds[k]
            ending = rows.filter(F.col("n") <= RANGE).join(above, "tree")
            rows = ending if down is None else ending.unionByName(rows.filter(F.col("n") > RANGE).join(down, ["tree", "block"]))
            if k == 0:
                return rows
            paths = rows.select("tree", "block", "n", "log", "path", *carried)
            schema = paths.select("tree", "block", "path", *carried).schema
            down = materialise(paths.mapInArrow(_descended(carried), schema), "merkle-paths")
        raise AssertionError("a forest has a round")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _counts(leaves: int, levels: int) -> list[int]:
    """Nodes of each level of a builder's log."""
    counts = [leaves]
    for _ in range(levels):
        counts.append(-(-counts[-1] // FAN))
    return counts


def _leaves_in(block: int, n: int) -> int:
    return min(RANGE, n - block * RANGE)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tree, block, n, log, base in zip(*[batch.column(c).to_pylist() for c in ("tree", "block", "n", "log", "base")]):
            here, levels = _leaves_in(block, n), _levels_of(n)
            out = []
            for level, count in enumerate(_counts(here, levels)):
                if level == 0 and base:
                    continue  # the round below has written these
                for i in range(count):
                    at = 32 * position(level, i, here)
                    out.append((tree, base + level, block * FAN ** (BUILD - level) + i, log[at : at + 32].hex()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.string()))] if out else
                                  [pa.array([], t) for t in (pa.string(), pa.int32(), pa.int64(), pa.string())], names=["tree", "level", "index", "digest"])


class _Siblings:
    """Reads the siblings of a log's leaves from closed-form positions."""

    def __init__(self, log: bytes, leaves: int, levels: int) -> None:
        self.text, self.leaves, self.counts = log.hex(), leaves, _counts(leaves, levels)
        self.runs: dict[tuple[int, int], str] = {}

    def run(self, level: int, number: int) -> str:
        """The digests of run ``number`` of a level on end."""
        found = self.runs.get((level, number))
        if found is None:
            nodes = range(number * FAN, min((number + 1) * FAN, self.counts[level]))
            places = [64 * position(level, i, self.leaves) for i in nodes]
            found = self.runs[level, number] = "".join(self.text[p : p + 64] for p in places)
        return found

    def of(self, leaf: int) -> list[tuple[str, str]]:
        """For each level the digests left and right of the leaf's ancestor in its run."""
        out, index = [], leaf
        for level in range(len(self.counts) - 1):
            number, k = divmod(index, FAN)
            run = self.run(level, number)
            out.append((run[: 64 * k], run[64 * (k + 1) :]))
            index = number
        return out


def _descended(carried: list[str]):
    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, block, n, log, path = (batch.column(c)[row].as_py() for c in ("tree", "block", "n", "log", "path"))
                here = _leaves_in(block, n)
                siblings = _Siblings(log, here, _levels_of(n))
                paths = [[{"left": a, "right": b} for a, b in siblings.of(i)] + path for i in range(here)]
                kind = batch.schema.field("path").type
                fixed = [pa.array([batch.column(c)[row].as_py()] * here, batch.schema.field(c).type) for c in carried]
                blocks = pa.array(range(block * RANGE, block * RANGE + here), pa.int64())
                yield pa.record_batch([pa.array([tree] * here, pa.string()), blocks, pa.array(paths, kind), *fixed], names=["tree", "block", "path", *carried])

    return descend


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = node_digest(left + leaf + right)
    return leaf


_CHECKED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_CHECKED_NAMES = [c.split()[0] for c in _CHECKED.split(", ")]


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            n, block, log, path = (batch.column(c)[row].as_py() for c in ("n", "block", "log", "path"))
            items = batch.column("items")[row].values
            upper = [(p["left"], p["right"]) for p in path]
            tail = "".join(a + b for a, b in upper).encode()
            root, subroot = (batch.column(c)[row].as_py().hex() for c in ("root", "subroot"))
            siblings = _Siblings(log, len(items), _levels_of(n))
            leaves, claims = items.field("leaf").to_pylist(), items.field("claim").to_pylist()
            proofs, roots = [], []
            for i, claim in enumerate(claims):
                own = siblings.of(i)
                digest = hashlib.sha256("".join(a + b for a, b in own).encode())
                digest.update(tail)
                proofs.append(digest.hexdigest())
                roots.append(folded(claim.hex(), own + upper))
            columns = [
                items.field("doc_id"), pa.array([x.hex() for x in leaves]), pa.array([subroot] * len(leaves)), pa.array([root] * len(leaves)),
                pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots]),
            ]
            yield pa.record_batch(columns, names=_CHECKED_NAMES)


def _leaf_rows(docs: DataFrame, claimed_text: Column) -> DataFrame:
    fields = [F.col(c) for c in FIELDS]
    claim = leaf_digest([*fields[:-1], claimed_text])
    # null sources come first, and no source is taken for one
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), leaf_digest(fields).alias("leaf"), claim.alias("claim"))


class Manifest:
    """The trees of ``docs`` by source, and the tree of their roots."""

    def __init__(self, docs: DataFrame, claimed_text: Column | None = None) -> None:
        self.sources = Forest(_leaf_rows(docs, F.col("text") if claimed_text is None else claimed_text), ["doc_id"])
        roots = self.sources.roots().select(F.lit("").alias("tree"), F.col("root").alias("leaf"), F.col("tree").alias("name"))
        self.top = Forest(roots, ["name"])

    def checked(self) -> DataFrame:
        """Every row's leaf, its trees' roots, the digest of its proof, and whether the claimed leaf leads to the root."""
        path = "array<struct<left:string,right:string>>"
        root = self.top.roots().select("tree", F.array().cast(path).alias("path"), "root")
        tops = self.top.proven(root).mapInArrow(_source_paths, f"tree string, path {path}, root binary, subroot binary")
        return self.sources.proven(materialise(tops, "source-paths")).mapInArrow(_checked, _CHECKED)


def _source_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            n, log, path, root = (batch.column(c)[row].as_py() for c in ("n", "log", "path", "root"))
            items = batch.column("items")[row].values
            siblings = _Siblings(log, len(items), _levels_of(n))
            paths = [[{"left": a, "right": b} for a, b in siblings.of(i)] + path for i in range(len(items))]
            columns = [items.field("name"), pa.array(paths, batch.schema.field("path").type), pa.array([root] * len(items), pa.binary()), items.field("leaf")]
            yield pa.record_batch(columns, names=["tree", "path", "root", "subroot"])
