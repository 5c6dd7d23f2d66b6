"""Near-duplicate groups by a chosen-path set similarity join.

A document's set is its distinct word shingles.  Equal sets are one vertex.
Each vertex keeps ``COORDINATES`` minwise tokens.  A tree starts with all
vertices in one node; a node chooses a few coordinates by its own hash and
branches its vertices by their tokens there.  A node of at most ``SMALL``
vertices is compared exhaustively; larger ones branch on.  Two sets of
similarity s stay together along a chosen coordinate with probability s, so
independent trees lift the recall of a link as near to one as wanted: at the
threshold, be it 0.85 or 0.80, one tree of three levels keeps a pair together with
more than 0.6, ``TREES`` of them lose fewer than one link in ten thousand, and
almost every link is met at the first level already, where one tree keeps 0.85 or
more.  The threshold is a parameter: op4 links at ``PERCENT``, the pipeline's stage
at ``STAGE_PERCENT``.

A node that is still large at the last level holds vertices that are mostly
alike, which more branching would not part.  It is compared breadth first: each
vertex once, with those that nothing has reached yet.  Nodes beyond ``BLOCK``
vertices are dealt out in blocks that share some hub vertices, and what then
lies outside the node's main cluster is compared with the whole node, so that
no pair is skipped for the node's size.

Signatures only cluster: a node hands on edges that connect what its alike
pairs connect, and the components of all edges hold every link.  Within a
cluster full sets decide.  A cluster of at most ``CLUSTER`` shingles goes to one
task, each set once, where pivots are compared with all vertices that no
confirmed link has yet joined to them.  A larger one is dealt out in blocks that
share the vertices nearest to the cluster's consensus, which the copies of one
text are likely to be linked through; what stays outside the main component is
again compared with the whole cluster.

Defined results
    null or empty text   empty set, linked with nothing, stays
    fewer words than a shingle has   the whole sequence is the one shingle
    null doc_id          component null, stays, links nothing
    repeated doc_id      rows with one doc_id are one document with several texts
    very long texts      read whole
    extra columns        ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.components import components
from skyloom.llm.rows import TEXT_KEY, bounded, text_key, without_rows
from skyloom.llm.words import Words, mixed, ranges, slices
from skyloom.session import materialise

#: Words of a shingle; percent of the union that linked sets share at least, in op4 and in the pipeline's stage.
SHINGLE, PERCENT, STAGE_PERCENT = 5, 85, 80
#: Minwise tokens of a set, independent trees, levels of branching, vertices of a node that is compared exhaustively.
COORDINATES, TREES, LEVELS, SMALL = 128, 12, 3, 64
#: Vertices of a node that one task compares by signatures, half a kilobyte each, and of the blocks of a larger one.
BLOCK = 16_384
#: Shingles of a cluster that one task compares by full sets, and of the blocks of a larger one.
CLUSTER = 1_000_000
#: Vertices of a large last-level node that all of its blocks share, about; and those of a large cluster.
HUBS, CENTRAL = 16, 8
#: Vertices of a large cluster from which its consensus is taken, about.
POLLED = 128

_RANDOM = np.random.default_rng(8_675_309)
_FACTORS = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Owner text and hash of the distinct shingles of a slice, by owner."""
    counts = np.diff(words.first)
    at, hashes = words.grams(SHINGLE)
    owner = np.searchsorted(words.first, at, "right") - 1
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    owner = np.concatenate([owner, short])
    hashes = np.concatenate([hashes, words.runs(words.first[short], counts[short])])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in slices(batch.column("text")):
            owner, hashes = _shingles(Words(data, offsets, lower=True))
            size = np.bincount(owner, minlength=end - at)
            some = np.flatnonzero(size)
            heads = np.append(0, np.cumsum(size[some]))[:-1]
            one, two = np.zeros(end - at, np.uint64), np.zeros(end - at, np.uint64)
            tokens = np.zeros((end - at, COORDINATES), np.uint32)
            if len(some):
                one[some] = np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), heads)
                two[some] = np.add.reduceat(mixed(hashes ^ np.uint64(0x14057B7EF767814F)), heads)
                for i, factor in enumerate(_FACTORS):
                    tokens[some, i] = np.minimum.reduceat(hashes * factor, heads) >> np.uint64(32)
            part = batch.slice(at, end - at)
            signature = pa.array([row.tobytes() for row in tokens], pa.binary())
            yield pa.record_batch(
                [part.column("doc_id"), part.column(TEXT_KEY), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), signature],
                names=["doc_id", TEXT_KEY, "n_shingles", "one", "two", "signature"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _least_alike(percent: int) -> int:
    """Equal coordinates of a pair worth confirming: five standard deviations below the mean at the threshold."""
    share = percent / 100
    return int(COORDINATES * share - 5 * (COORDINATES * share * (1 - share)) ** 0.5)


def _chosen(keys: np.ndarray, percent: int) -> np.ndarray:
    """Which coordinates the nodes branch on: each with probability 1 / (threshold * COORDINATES), one at least."""
    draw = mixed(keys[:, None] ^ _FACTORS[None, :])
    limit = np.uint64(int(2**64 / (COORDINATES * percent / 100)))
    chosen = draw < limit
    chosen[np.arange(len(keys)), draw.argmin(1)] = True
    return chosen


def _branch(keys: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``tokens`` and the child nodes that they go to."""
    uniq, back = np.unique(keys, return_inverse=True)
    row, coordinate = np.nonzero(_chosen(uniq, percent)[back])
    child = mixed(mixed(keys[row] + np.uint64(0x9E3779B97F4A7C15) * (coordinate.astype(np.uint64) + np.uint64(1))) ^ tokens[row, coordinate])
    return row, child


_ROOTS = mixed(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _first_level(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = _matrix(batch.column("signature"))
        for root in _ROOTS:
            row, child = _branch(np.full(len(tokens), root), tokens, percent)
            yield pa.record_batch([pa.array(child.view(np.int64)), batch.column("vertex").take(pa.array(row))], names=["tree_node", "vertex"])


def _next_level(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, child = _branch(batch.column("tree_node").to_numpy().view(np.uint64), _matrix(batch.column("signature")), percent)
        yield pa.record_batch([pa.array(child.view(np.int64)), batch.column("vertex").take(pa.array(row))], names=["tree_node", "vertex"])


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a sorted partition in tables that end where a tree node ends."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("tree_node").to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if rest and rest[-1].column("tree_node")[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        if last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest)


def _pairs_in(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows with equal keys, in sorted ``keys``."""
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(heads[1:], len(keys))
    after = np.repeat(ends, ends - heads) - np.arange(len(keys)) - 1
    left = np.repeat(np.arange(len(keys)), after)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.append(0, np.cumsum(after)[:-1]), after)


def _stars(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the smallest row that pairs connect it with."""
    root = np.arange(n)
    while len(left):
        low = root.copy()
        np.minimum.at(low, left, root[right])
        np.minimum.at(low, right, root[left])
        low = np.minimum(low, low[low])
        if (low == root).all():
            break
        root = low
    return root


def _spread(tokens: np.ndarray, size: np.ndarray, group: np.ndarray, least: int, percent: int) -> np.ndarray:
    """The same for the rows of one large node, breadth first.

    Each row is compared once, with those that nothing has reached yet, so a
    family of copies costs about one comparison a row and not one a pair.
    """
    n = len(group)
    group = np.unique(group, return_inverse=True)[1]
    apart = len(np.unique(group)) == n
    root, left_over = np.arange(n), np.ones(n, bool)
    for start in range(n):
        if not left_over[start]:
            continue
        found = np.array([start]) if apart else np.flatnonzero(group == group[start])
        left_over[found] = False
        waiting = found.tolist()
        while waiting:
            pivot = waiting.pop()
            rest = np.flatnonzero(left_over)
            if not len(rest):
                break
            rest = rest[100 * np.minimum(size[rest], size[pivot]) >= percent * np.maximum(size[rest], size[pivot])]
            hit = rest[(tokens[rest] == tokens[pivot]).sum(1) >= least]
            if len(hit):
                if not apart:
                    hit = np.flatnonzero(np.isin(group, group[hit]))
                left_over[hit] = False
                root[hit] = start
                waiting += hit.tolist()
        root[found] = start
    return root


def _alike(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges that connect what alike pairs connect in each tree node, between rows of different components."""
    least = _least_alike(percent)
    for rows in _whole_nodes(batches):
        keys = rows.column("tree_node").to_numpy()
        vertex, size = rows.column("vertex").to_numpy(), rows.column("n_shingles").to_numpy()
        group = rows.column("component").to_numpy()
        tokens = _matrix(rows.column("signature"))
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(heads[1:], len(keys))
        small = np.flatnonzero(np.repeat(ends - heads <= SMALL, ends - heads))
        left, right = (small[x] for x in _pairs_in(keys[small])) if len(small) else (small, small)
        fits = 100 * np.minimum(size[left], size[right]) >= percent * np.maximum(size[left], size[right])
        fits &= (vertex[left] != vertex[right]) & (group[left] != group[right])
        left, right = left[fits], right[fits]
        close = [
            (tokens[left[i : i + 50_000]] == tokens[right[i : i + 50_000]]).sum(1) >= least for i in range(0, len(left), 50_000)
        ]
        close = np.concatenate(close) if close else np.zeros(0, bool)
        root = _stars(left[close], right[close], len(keys))
        for head, end in zip(heads.tolist(), ends.tolist()):
            if end - head > SMALL:
                root[head:end] = head + _spread(tokens[head:end], size[head:end], group[head:end], least, percent)
        a, b = vertex[root], vertex
        new = (a != b) & (group[root] != group)
        a, b = a[new], b[new]
        yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent token of each coordinate among the polled vertices of a cluster."""
    for rows in _whole_nodes(batches):
        keys, tokens = rows.column("tree_node").to_numpy(), _matrix(rows.column("signature"))
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        modes = []
        for own in np.split(tokens, heads[1:]):
            mode = np.zeros(COORDINATES, np.uint32)
            for i in range(COORDINATES):
                values, counts = np.unique(own[:, i], return_counts=True)
                mode[i] = values[counts.argmax()]
            modes.append(mode.tobytes())
        yield pa.record_batch([pa.array(keys[heads]), pa.array(modes, pa.binary())], names=["cluster", "mode"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        equal = (_matrix(batch.column("signature")) == _matrix(batch.column("mode"))).sum(1)
        yield pa.record_batch([batch.column("cluster"), batch.column("vertex"), pa.array(equal)], names=["cluster", "vertex", "agree"])


def _links_in(sets: np.ndarray, owner: np.ndarray, group: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """A pivot and what it is linked with, until all pairs are compared or in one component; central pivots first.

    A pivot meets only the sets that no link has joined to it yet, so once a
    family is one component its members cost what the few others hold.
    """
    n = len(group)
    size = np.bincount(owner, minlength=n)
    known, code = np.unique(sets, return_inverse=True)
    shared = np.bincount(owner, np.bincount(code)[code], n) / np.maximum(size, 1)
    ends = np.append(0, np.cumsum(size))
    group, open_ = np.unique(group, return_inverse=True)[1], np.ones(n, bool)
    mark = np.zeros(len(known), bool)
    for pivot in np.argsort(-shared, kind="stable").tolist():
        open_[pivot] = False
        other = np.flatnonzero(open_ & (group != group[pivot]))
        other = other[100 * np.minimum(size[other], size[pivot]) >= percent * np.maximum(size[other], size[pivot])]
        if not len(other):
            continue
        own = code[ends[pivot] : ends[pivot + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[code[ranges(ends[other], size[other])]], np.append(0, np.cumsum(size[other])[:-1]), dtype=np.int64)
        mark[own] = False
        hit = other[100 * both >= percent * (size[other] + size[pivot] - both)]
        if len(hit):
            group[np.isin(group, group[hit])] = group[pivot]
            yield pivot, hit


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for rows in _whole_nodes(batches):
        keys, vertex, group = (rows.column(c).to_numpy() for c in ("tree_node", "vertex", "component"))
        lists = rows.column("shingles").combine_chunks()
        sizes, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        at = np.append(0, np.cumsum(sizes))
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        a, b = [], []
        for head, end in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)]):
            if end - head > 1:
                owner = np.repeat(np.arange(end - head), sizes[head:end])
                for pivot, hit in _links_in(flat[at[head] : at[end]], owner, group[head:end], percent):
                    a.append(np.full(len(hit), vertex[head + pivot]))
                    b.append(vertex[head + hit])
        none = [np.zeros(0, np.int64)]
        yield pa.record_batch([pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in slices(batch.column("text")):
            owner, hashes = _shingles(Words(data, offsets, lower=True))
            bounds = np.append(0, np.cumsum(np.bincount(owner, minlength=end - at))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64)))
            yield pa.record_batch([batch.column("vertex").slice(at, end - at), lists], names=["vertex", "shingles"])


class _Join:
    """The vertices, and the steps that turn tree nodes into confirmed links."""

    def __init__(self, docs: DataFrame, percent: int) -> None:
        self.percent = percent
        self.texts = docs.select("doc_id", "text", text_key().alias(TEXT_KEY))
        schema = "doc_id long, text_key long, n_shingles long, one long, two long, signature binary"
        self.sketches = materialise(self.texts.mapInArrow(_sketch, schema), "sketches")
        classes = self.sketches.filter("n_shingles > 0 and doc_id is not null").groupBy("one", "two", "n_shingles")
        named = classes.agg(F.min("doc_id").alias("vertex"), F.min_by("signature", "doc_id").alias("signature"), F.min_by(TEXT_KEY, "doc_id").alias(TEXT_KEY), F.count(F.lit(1)).alias("rows"))
        self.vertices = materialise(named, "vertices")

    def at_percent(self, step):
        """``step`` with the threshold, to be sent to the executors."""
        percent = self.percent
        return lambda batches: step(batches, percent)

    def crowded(self, members: DataFrame) -> DataFrame:
        """Members of tree nodes that have company, with the number of members."""
        many = members.groupBy("tree_node").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        # written, so that a crowded node can be split when its members are joined with it
        return materialise(members.join(materialise(many, "node-sizes"), "tree_node"), "tree-nodes")

    def signed(self, members: DataFrame) -> DataFrame:
        return members.join(self.vertices.select("vertex", "n_shingles", "signature"), "vertex")

    def leaves(self) -> tuple[DataFrame, DataFrame]:
        """Members of nodes to be compared exhaustively, and of those still large at the last level."""
        members = self.crowded(self.vertices.select("vertex", "signature").mapInArrow(self.at_percent(_first_level), "tree_node long, vertex long"))
        small, level = members.filter(F.col("members") <= SMALL), 1
        large = members.filter(F.col("members") > SMALL)
        while level < LEVELS and not large.isEmpty():
            deeper = self.signed(large).select("tree_node", "vertex", "signature").mapInArrow(self.at_percent(_next_level), "tree_node long, vertex long")
            members, level = self.crowded(deeper), level + 1
            small = small.unionByName(members.filter(F.col("members") <= SMALL))
            large = members.filter(F.col("members") > SMALL)
        return small.select("tree_node", "vertex"), large

    def dealt(self, large: DataFrame, hub: Column) -> DataFrame:
        """Large nodes dealt out in ``parts`` blocks that share the hubs."""
        own = F.array(F.pmod(F.xxhash64("tree_node", "vertex", F.lit(1)), F.col("parts")))
        dealt = large.select("tree_node", "vertex", F.explode(F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(own)).alias("block"))
        return dealt.select(F.xxhash64("tree_node", "block").alias("tree_node"), "vertex")

    def strays(self, large: DataFrame, joined: DataFrame, block: int) -> DataFrame:
        """Blocks of about ``block`` weight in which what lies outside the main component of a large node meets the whole node."""
        placed = materialise(large.select("tree_node", "vertex", "weight").join(joined, "vertex"), "placed")
        parts = placed.groupBy("tree_node", "component").agg(F.sum("weight").alias("n"))
        main = parts.groupBy("tree_node").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        main = materialise(main.filter("all > most"), "main-components")
        open_ = placed.join(main, "tree_node").withColumn("out", F.col("component") != F.col("main"))
        half = block // 2
        inner, outer = F.ceil(F.col("all") / half), F.ceil((F.col("all") - F.col("most")) / half)
        mine = lambda salt, n: F.pmod(F.xxhash64("vertex", F.lit(salt)), n)
        to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other")
        strays = open_.filter("out").select("tree_node", "vertex", "component", mine(2, outer).alias("u"), to(inner)).withColumnRenamed("other", "v")
        whole = open_.select("tree_node", "vertex", "component", mine(3, inner).alias("v"), to(outer)).withColumnRenamed("other", "u")
        return strays.unionByName(whole).select(F.xxhash64("tree_node", "u", "v").alias("tree_node"), "vertex", "component").distinct()

    def alike(self, members: DataFrame) -> DataFrame:
        """Edges between vertices of different components with alike signatures that connect all that are so in some node."""
        rows = self.signed(members).select("tree_node", "vertex", "n_shingles", "component", "signature")
        sorted_ = rows.repartition("tree_node").sortWithinPartitions("tree_node")
        return materialise(sorted_.mapInArrow(self.at_percent(_alike), "a long, b long").distinct(), "alike")

    def joined(self, edges: DataFrame) -> DataFrame:
        """The component of every vertex that has edges."""
        found = components(edges).withColumnRenamed("node", "vertex")
        return materialise(found.unionByName(found.select(F.col("component").alias("vertex"), "component").distinct()), "joined")

    def clusters(self) -> DataFrame:
        """vertex, cluster and the cluster's members and shingles, for vertices that have something alike."""
        small, large = self.leaves()
        whole = large.filter(F.col("members") <= BLOCK).select("tree_node", "vertex")
        large = large.filter(F.col("members") > BLOCK).withColumns({"weight": F.lit(1), "parts": F.ceil(F.col("members") / (BLOCK - HUBS))})
        crowded = not large.isEmpty()
        members = small.unionByName(whole)
        if crowded:
            draw = F.pmod(F.xxhash64("vertex", "tree_node"), F.lit(1 << 30))
            members = members.unionByName(self.dealt(large, draw * F.col("members") < HUBS * (1 << 30)))
        edges = self.alike(members.withColumn("component", F.col("vertex")))
        if crowded:
            every = self.vertices.select("vertex").join(self.joined(edges), "vertex", "left")
            every = every.withColumn("component", F.coalesce("component", "vertex"))
            edges = edges.unionByName(self.alike(self.strays(large, every, BLOCK)))
        found = self.joined(edges).withColumnRenamed("component", "cluster")
        weighed = found.join(self.vertices.select("vertex", F.col("n_shingles").alias("weight")), "vertex")
        sizes = weighed.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("weight").alias("shingles"))
        return materialise(weighed.join(materialise(sizes, "cluster-sizes"), "cluster"), "clusters")

    def central(self, large: DataFrame) -> DataFrame:
        """The vertices of each large cluster that are nearest to its consensus."""
        signed = large.join(self.vertices.select("vertex", "signature"), "vertex")
        polled = F.pmod(F.xxhash64("vertex"), F.lit(1 << 30)) * F.col("members") < POLLED * (1 << 30)
        few = signed.filter(polled).select(F.col("cluster").alias("tree_node"), "signature")
        modes = few.repartition("tree_node").sortWithinPartitions("tree_node").mapInArrow(_consensus, "cluster long, mode binary")
        rows = signed.select("cluster", "vertex", "signature").join(materialise(modes, "consensus"), "cluster")
        agree = rows.mapInArrow(_agreement, "cluster long, vertex long, agree long")
        rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("agree"), "vertex"))
        return materialise(agree.withColumn("rank", rank).filter(F.col("rank") <= CENTRAL).select("vertex", F.lit(True).alias("hub")), "central")

    def sets_of(self, clusters: DataFrame) -> DataFrame:
        wanted = materialise(clusters.select("vertex").join(self.vertices.select("vertex", TEXT_KEY), "vertex"), "wanted")
        named = bounded(wanted.select("vertex", F.col("vertex").alias("doc_id"), TEXT_KEY))
        read = self.texts.join(named, ["doc_id", TEXT_KEY]).select("vertex", "text")
        return materialise(read.mapInArrow(_sets, "vertex long, shingles array<long>"), "sets")

    def confirmed(self, groups: DataFrame, sets: DataFrame) -> DataFrame:
        """Links in groups (tree_node, vertex, component) between vertices of different components."""
        rows = groups.join(sets, "vertex").select("tree_node", "vertex", "component", "shingles")
        sorted_ = rows.repartition("tree_node").sortWithinPartitions("tree_node")
        return materialise(sorted_.mapInArrow(self.at_percent(_confirmed), "a long, b long"), "links")

    def links(self) -> DataFrame:
        clusters = self.clusters()
        sets = self.sets_of(clusters)
        alone = F.col("vertex").alias("component")
        small = clusters.filter(F.col("shingles") <= CLUSTER).select(F.col("cluster").alias("tree_node"), "vertex", alone)
        large = clusters.filter(F.col("shingles") > CLUSTER)
        if large.isEmpty():
            return self.confirmed(small, sets)
        parts = {"tree_node": F.col("cluster"), "parts": F.ceil(F.col("shingles") / CLUSTER)}
        large = materialise(large.join(self.central(large), "vertex", "left").withColumns(parts), "large-clusters")
        blocks = self.dealt(large, F.coalesce("hub", F.lit(False))).select("tree_node", "vertex", alone)
        links = self.confirmed(small.unionByName(blocks), sets)
        every = large.select("vertex").join(self.joined(links), "vertex", "left")
        every = materialise(every.withColumn("component", F.coalesce("component", "vertex")), "linked")
        return links.unionByName(self.confirmed(self.strays(large, every, CLUSTER), sets))


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For every row of ``docs``: doc_id, n_shingles, component_id, kept and the row's text key."""
    join = _Join(docs, percent)
    found = components(join.links())
    named = join.vertices.join(found.withColumnRenamed("node", "vertex"), "vertex", "left")
    grouped = named.filter("rows > 1 or component is not null").select("one", "two", "n_shingles", F.coalesce("component", "vertex").alias("component_id"))
    rows = join.sketches.select("doc_id", TEXT_KEY, "n_shingles", "one", "two")
    placed = rows.join(grouped, ["one", "two", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), TEXT_KEY
    )


def drop_near_copies(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns."""
    decided = materialise(near_groups(docs, percent), "near-groups")
    return without_rows(docs, decided.filter("not kept").select("doc_id", TEXT_KEY))
