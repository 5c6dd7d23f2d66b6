"""Tree ensembles that Spark's own library lacks: second-order boosting and extremely randomised trees.

Both grow level by level.  A level is one pass over the rows: every task adds
its rows to arrays of fixed size (nodes by features by bins, or by candidate
splits), the arrays are summed, and the driver picks the splits from the sums.
What the driver holds is bounded by the settings and not by the rows.  Equal rows
are one row with their number, so a pass costs no more than there are different ones.

Boosting keeps each row's features as bin numbers, four in a long, and the error
of its current prediction in a written table, renewed once a tree, so a pass
reads few numbers and no tree is evaluated twice.  A model can be fitted further: the stored bins and the
number of the next tree go on where they stopped, so two fits in a row give the
same trees as one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.attribution import Tree
from skyloom.operators.models import evenly, filled, fills
from skyloom.operators.ranks import number, reached
from skyloom.session import drop_table, materialise


@dataclass(frozen=True)
class Boosting:
    """Settings; names say what the usual ones mean."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    l2: float = 1.0
    l1: float = 0.0
    least_gain: float = 0.0
    child_weight: float = 1.0
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 128
    patience: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class RandomTrees:
    trees: int = 100
    depth: int = 10
    leaf_rows: int = 5
    column_share: float = 1.0
    seed: int = 42


@dataclass
class Ensemble:
    """A sum of weighted trees over named features, with what stands for missing values."""

    features: list[str]
    fill: dict[str, float]
    base: float
    trees: list[Tree]
    settings: dict
    cuts: list[np.ndarray] = field(default_factory=list)
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0))
    history: list[tuple[int, float | None]] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Every row with a ``prediction``."""
        trees, base = self.trees, self.base

        @F.pandas_udf("double")
        def predict(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))
            out = np.full(len(x), base)
            for tree in trees:
                out += tree.weight * tree.predict(x)
            return pd.Series(out)

        values = [F.coalesce(number(f), F.lit(self.fill[f])) for f in self.features]
        return df.withColumn("prediction", predict(F.array(*values)))

    def importance(self) -> dict[str, float]:
        """Shares of the gain of all splits, summing to one."""
        total = float(self.gains.sum()) or 1.0
        return {f: float(g) / total for f, g in zip(self.features, self.gains)}

    def save(self, spark: SparkSession, path: str) -> None:
        """The nodes as a table, and what else the model knows as one row of JSON."""
        rows = [
            (i, k, int(t.feature[k]), float(t.cut[k]), int(t.left[k]), int(t.right[k]), float(t.value[k]), float(t.cover[k]), t.weight)
            for i, t in enumerate(self.trees) for k in range(len(t.value))
        ]
        schema = "tree int, node int, feature int, cut double, left int, right int, value double, cover double, weight double"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/nodes")
        rest = {
            "features": self.features, "fill": self.fill, "base": self.base, "settings": self.settings, "history": self.history,
            "cuts": [c.tolist() for c in self.cuts], "gains": self.gains.tolist(),
        }
        spark.createDataFrame([(json.dumps(rest),)], "model string").write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        rest = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])  # bounded by the settings
        trees = [
            Tree(*[own[c].to_numpy() for c in ("feature", "cut", "left", "right", "value", "cover")], weight=float(own["weight"].iloc[0]))
            for _, own in nodes.groupby("tree")
        ]
        history = [tuple(h) for h in rest["history"]]
        cuts = [np.array(c) for c in rest["cuts"]]
        return Ensemble(rest["features"], rest["fill"], rest["base"], trees, rest["settings"], cuts, np.array(rest["gains"]), history)


def summed(df: DataFrame, fill: Callable[[pd.DataFrame, np.ndarray], None], size: int) -> np.ndarray:
    """The sum over all rows of what ``fill`` adds to an array of ``size``, one array a task."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(size)
        for batch in batches:
            fill(batch, held)
        at = np.flatnonzero(held)
        yield pd.DataFrame({"at": at.astype(np.int64), "v": held[at]})

    out = np.zeros(size)
    found = df.mapInPandas(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of whole numbers, the same everywhere."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _share(keys: np.ndarray) -> np.ndarray:
    return mixed(keys) / 2.0**64


# --- second-order boosting ---------------------------------------------------------

#: Bin numbers, which are shorts, in a long.
_IN_WORD = 4


def _words(bins: np.ndarray) -> np.ndarray:
    """Rows of shorts as rows of longs."""
    return np.pad(bins.astype(np.int16), ((0, 0), (0, -bins.shape[1] % _IN_WORD))).view(np.int64)


def _bins(batch: pd.DataFrame, words: Sequence[str], count: int) -> np.ndarray:
    """The shorts of rows of longs, ``count`` to a row."""
    return np.ascontiguousarray(batch[list(words)].to_numpy(np.int64)).view(np.int16)[:, :count]


def _sampled(key: np.ndarray, number_of_tree: int, s: Boosting) -> np.ndarray:
    return _share(key.astype(np.int64).view(np.uint64) ^ mixed(np.array([number_of_tree * 2 + 1 + s.seed * 1_000_003]))) < s.row_share


def _columns(count: int, number_of_tree: int, s: Boosting) -> np.ndarray:
    rng = np.random.default_rng([s.seed, number_of_tree])
    return np.sort(rng.permutation(count)[: max(1, round(s.column_share * count))])


class _Growing:
    """A tree over bin numbers while it grows: rows of bin ``cut`` and less go left."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.value, self.cover = [-1], [0], [-1], [-1], [0.0], [0.0]

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = len(self.left), len(self.left) + 1
        for own, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.cover, 0.0)):
            own += [v, v]
        return self.left[node], self.right[node]

    def tree(self, weight: float = 1.0) -> Tree:
        return Tree(np.array(self.feature), np.array(self.cut, float), np.array(self.left), np.array(self.right), np.array(self.value), np.array(self.cover), weight)


def _leaf(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(tree.left[at] >= 0)
        if not len(inner):
            return at
        here = at[inner]
        at[inner] = np.where(x[inner, tree.feature[here]] <= tree.cut[here], tree.left[here], tree.right[here])


def _softened(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_splits(hist: np.ndarray, s: Boosting) -> list[tuple[float, int, int] | None]:
    """For each node of (nodes, features, bins, [gradient, hessian]) the gain, feature and bin of its best split."""
    below = hist.cumsum(2)[:, :, :-1]
    total = hist.sum(2)[:, :1, None, :]
    above = total - below

    def score(part: np.ndarray) -> np.ndarray:
        return _softened(part[..., 0], s.l1) ** 2 / (part[..., 1] + s.l2)

    gain = (score(below) + score(above) - score(total)) / 2 - s.least_gain
    gain[(below[..., 1] < s.child_weight) | (above[..., 1] < s.child_weight)] = -np.inf
    out = []
    for own in gain:
        at = int(own.argmax()) if own.size else 0
        found = own.size and own.flat[at] > 1e-12
        out.append((float(own.flat[at]), *map(int, np.unravel_index(at, own.shape))) if found else None)
    return out


def _grow(rows: DataFrame, words: list[str], features: int, number_of_tree: int, s: Boosting, gains: np.ndarray) -> _Growing:
    bins, columns = s.bins, _columns(features, number_of_tree, s)
    rows = rows.where("not valid").select(*words, "key", "n", "error")
    growing, open_ = _Growing(), [0]
    for level in range(s.depth + 1):
        tree, slots = growing.tree(), np.full(len(growing.left), -1)
        slots[open_] = np.arange(len(open_))
        last = level == s.depth
        width = 1 if last else len(columns)
        size = len(open_) * width * bins * 2

        def fill(batch: pd.DataFrame, held: np.ndarray) -> None:
            drawn = np.flatnonzero(_sampled(batch["key"].to_numpy(), number_of_tree, s))
            x = _bins(batch, words, features)[drawn]
            slot = slots[_leaf(tree, x)]
            inside = slot >= 0
            x, slot, drawn = x[inside], slot[inside], drawn[inside]
            n = batch["n"].to_numpy()[drawn]
            g = batch["error"].to_numpy()[drawn] * n
            for k in range(width):
                cell = (slot * width + k) * bins + (0 if last else x[:, columns[k]])
                count = len(open_) * width * bins
                held[0::2] += np.bincount(cell, g, count)
                held[1::2] += np.bincount(cell, n, count)

        hist = summed(rows, fill, size).reshape(len(open_), width, bins, 2)
        sums = hist[:, 0].sum(1)
        for node, (g, h) in zip(open_, sums):
            growing.value[node] = float(-_softened(g, s.l1) / (h + s.l2)) * s.rate
            growing.cover[node] = float(h)
        if last:
            break
        following = []
        for node, found in zip(open_, best_splits(hist, s)):
            if found is not None:
                gains[columns[found[1]]] += found[0]
                following += growing.split(node, int(columns[found[1]]), found[2])
        if not following:
            break
        open_ = following
    return growing


def fit_boosted(train: DataFrame, features: Sequence[str], target: str, settings: Boosting = Boosting(), *, valid: DataFrame | None = None,
                start: Ensemble | None = None, fill: dict[str, float] | None = None, weight: str | None = None) -> Ensemble:
    """Boosted trees on rows with a target; missing features become medians.

    ``start`` is a model to go on from: ``rounds`` more trees are added to it.
    ``valid`` rows are scored after every tree; with ``patience`` the fit stops
    when that many trees bring no better score, and the model ends with the
    best one.  Rows are sampled for a tree by a hash of their values, so equal
    rows are in or out together and go through the passes as one.  ``fill`` is
    what stands for missing values where that is known; with ``weight`` a row
    of ``train`` stands for that many equal ones, and one of ``valid`` for itself.
    """
    features, s = list(features), settings
    if s.bins > 32_767:
        raise ValueError("bins must fit a short")
    one = F.lit(1).cast("long")
    rows = train.withColumns({"__valid": F.lit(False), "__n": F.col(weight).cast("long") if weight else one})
    if valid is not None:
        rows = rows.unionByName(valid.withColumns({"__valid": F.lit(True), "__n": one}), allowMissingColumns=True)
    rows = rows.where(number(target).isNotNull())
    own = rows.where(~F.col("__valid"))
    fill = start.fill if start else fill or fills(own, features, weight)
    names = [f"b{i}" for i in range(len(features))]
    raw = filled(rows, fill).select(
        *[number(f).alias(n) for f, n in zip(features, names)], number(target).alias("y"), F.col("__valid").alias("valid"), F.col("__n").alias("n"),
        F.xxhash64(*[number(f) for f in features], number(target)).alias("key"),
    )
    if start:
        cuts, base, trees, gains, history = start.cuts, start.base, list(start.trees), start.gains.copy(), list(start.history)
    else:
        probs, learned = [i / s.bins for i in range(1, s.bins)], raw.where(~F.col("valid"))
        quantiles = [] if weight else [F.percentile_approx(n, probs, 10 * s.bins).alias(n) for n in names]
        row = learned.agg((F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("base"), *quantiles).first()
        found = reached(learned, names, probs, "n") if weight else row
        cuts, base = [np.unique(found[n] or []) for n in names], float(row["base"] or 0.0)
        trees, gains, history = [], np.zeros(len(features)), []

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(float)
            margin = np.full(len(x), base)
            for tree in trees:
                margin += tree.predict(x)
            found = _words(np.stack([np.searchsorted(cuts[i], x[:, i], "left") for i in range(len(names))], 1))
            rest = {"valid": batch["valid"], "key": batch["key"], "n": batch["n"], "error": margin - batch["y"].to_numpy()}
            yield pd.DataFrame({**dict(zip(words, found.T)), **rest})

    words = [f"w{i}" for i in range(-(-len(names) // _IN_WORD))]
    schema = ", ".join(f"{w} long" for w in words) + ", valid boolean, key long, n long, error double"
    equal = raw.groupBy(*names, "y", "valid", "key").agg(F.sum("n").alias("n"))
    table = materialise(evenly(equal, [*names, "y"]).mapInPandas(binned, schema), "boosting")
    best = None
    for _ in range(s.rounds):
        growing = _grow(table, words, len(names), len(trees), s, gains)
        tree = growing.tree()

        def advanced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(error=batch["error"] + tree.value[_leaf(tree, _bins(batch, words, len(names)))])

        before, table = table, materialise(table.mapInPandas(advanced, schema), "boosting")
        drop_table(before)
        real = [cuts[f][int(c)] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
        trees.append(replace(tree, cut=np.array(real, float)))
        error = None
        if valid is not None:
            error = table.where("valid").agg(F.sqrt(F.sum(F.col("n") * F.col("error") ** 2) / F.sum("n"))).first()[0]
        history.append((len(trees), error))
        if error is not None and s.patience is not None:
            if best is None or error < best[0]:
                best = (error, len(trees))
            elif len(trees) - best[1] >= s.patience:
                break
    drop_table(table)
    if best is not None:
        trees, history = trees[: best[1]], history[: best[1]]
    return Ensemble(features, fill, base, trees, asdict(s), cuts, gains, history)


# --- extremely randomised trees ------------------------------------------------------


def _draws(tree: int, node: int, count: int, s: RandomTrees) -> np.ndarray:
    """For every feature of a node where in its range the threshold lies; features that are not tried are NaN."""
    rng = np.random.default_rng([s.seed, tree, node])
    out, order = rng.random(count), rng.permutation(count)
    out[order[max(1, round(s.column_share * count)) :]] = np.nan
    return out


def _assigned(x: np.ndarray, growing: list[Tree], slots: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each tree that is still growing the rows in its open nodes and their slots."""
    for k, tree in enumerate(growing):
        if len(slots[k]):
            slot = slots[k][_leaf(tree, x)]
            at = np.flatnonzero(slot >= 0)
            yield k, at, slot[at]


def fit_random_trees(train: DataFrame, features: Sequence[str], target: str, settings: RandomTrees = RandomTrees(), *,
                     fill: dict[str, float] | None = None, weight: str | None = None) -> Ensemble:
    """Extremely randomised trees, all of them grown at once: two passes a level.

    The first pass finds the range of every feature in every open node of every
    tree, the second the moments on either side of the drawn thresholds; the
    feature whose threshold lowers the squared error most splits the node.  Rows
    of equal features go through the passes as one, with their moments.  ``fill``
    and ``weight`` are as in ``fit_boosted``.
    """
    features, s = list(features), settings
    fill = fill or fills(train, features, weight)
    names = [f"x{i}" for i in range(len(features))]
    rows = filled(train.where(number(target).isNotNull()), fill)
    n = (F.col(weight) if weight else F.lit(1)).cast("double")
    rows = rows.select(*[number(f).alias(c) for f, c in zip(features, names)], number(target).alias("y"), n.alias("n"))
    n, y = F.col("n"), F.col("y")
    base = float(rows.agg(F.sum(n * y) / F.sum(n)).first()[0] or 0.0)  # moments around the mean keep their digits
    off = y - F.lit(base)
    equal = rows.groupBy(*names).agg(F.sum(n).alias("m0"), F.sum(n * off).alias("m1"), F.sum(n * off * off).alias("m2"))
    table = materialise(evenly(equal, names), "random-trees")
    width, gains = len(features), np.zeros(len(features))
    growing = [_Growing() for _ in range(s.trees)]
    open_: list[list[int]] = [[0] for _ in range(s.trees)]
    for level in range(s.depth + 1):
        trees = [g.tree() for g in growing]
        slots, starts, total = [], [], 0
        for g, nodes in zip(growing, open_):
            own = np.full(len(g.left), -1) if nodes else np.zeros(0, np.int64)
            if nodes:
                own[nodes] = total + np.arange(len(nodes))
            slots.append(own)
            starts.append(total)
            total += len(nodes)
        if not total:
            break

        def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            low, high = np.full((total, width), np.inf), np.full((total, width), -np.inf)
            for batch in batches:
                x = batch[names].to_numpy()
                for _, at, slot in _assigned(x, trees, slots):
                    if len(at):
                        order = np.argsort(slot, kind="stable")
                        met, own = slot[order], x[at[order]]
                        heads = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
                        low[met[heads]] = np.minimum(low[met[heads]], np.minimum.reduceat(own, heads))
                        high[met[heads]] = np.maximum(high[met[heads]], np.maximum.reduceat(own, heads))
            at, of = np.nonzero(low <= high)
            yield pd.DataFrame({"slot": at.astype(np.int64), "f": of.astype(np.int64), "low": low[at, of], "high": high[at, of]})

        parts = table.mapInPandas(ranges, "slot long, f long, low double, high double")
        low, high = np.full((total, width), np.nan), np.full((total, width), np.nan)
        met = parts.groupBy("slot", "f").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        at = met["slot"].to_numpy(), met["f"].to_numpy()
        low[at], high[at] = met["low"].to_numpy(), met["high"].to_numpy()
        where = np.array([_draws(k, node, width, s) for k, nodes in enumerate(open_) for node in nodes])
        thresholds = np.where(high > low, low + where * (high - low), np.nan)

        # per slot the moments of all rows, and per slot and feature those at or below the threshold
        def moments(batch: pd.DataFrame, held: np.ndarray) -> None:
            x, of = batch[names].to_numpy(), batch[["m0", "m1", "m2"]].to_numpy()
            sums = held.reshape(total, width + 1, 3)
            for k, at, slot in _assigned(x, trees, slots):
                first, count = starts[k], len(open_[k])
                below = x[at] <= thresholds[slot]
                for f in range(width + 1):
                    own = below[:, f] if f < width else slice(None)
                    for m in range(3):
                        sums[first : first + count, f, m] += np.bincount(slot[own] - first, of[at[own], m], count)

        sums = summed(table, moments, total * (width + 1) * 3).reshape(total, width + 1, 3)
        following: list[list[int]] = [[] for _ in range(s.trees)]
        slot = -1
        for k, nodes in enumerate(open_):
            for node in nodes:
                slot += 1
                n, sy, syy = sums[slot, width]
                growing[k].value[node], growing[k].cover[node] = (sy / n if n else 0.0), n
                left = sums[slot, :width]
                right = sums[slot, width] - left
                fits = (left[:, 0] >= s.leaf_rows) & (right[:, 0] >= s.leaf_rows) & ~np.isnan(thresholds[slot])
                if level == s.depth or not fits.any():
                    continue
                gain = np.full(width, -np.inf)
                gain[fits] = left[fits, 1] ** 2 / left[fits, 0] + right[fits, 1] ** 2 / right[fits, 0] - sy**2 / n
                best = int(gain.argmax())
                if gain[best] <= 1e-12 * max(1.0, syy):
                    continue
                gains[best] += gain[best]
                following[k] += growing[k].split(node, best, thresholds[slot, best])
        open_ = following
    drop_table(table)
    return Ensemble(features, fill, base, [g.tree(1 / s.trees) for g in growing], asdict(s), gains=gains)
