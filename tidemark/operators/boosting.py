"""Gradient-boosted regression trees with a leaf penalty, missing values and best-leaf growth, on histograms.

Features are cut into bins at exact quantiles once. For a tree, each depth is one pass over the binned rows: every partition adds up its
gradients by (node, feature, bin), the partitions are added up by node, and one small table for each node reaches the driver, whatever
the number of rows. Of the tree grown to ``depth`` that way the splits are then taken best first up to ``leaves``.
"""

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import ranks
from tidemark.session import materialise

BINS = 32


@dataclass
class Tree:
    """Nodes by number (root 1, children 2k and 2k + 1): (feature, edge number, missing go left) or the value of a leaf."""

    splits: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; ``bins`` is (features, rows), missing values hold ``BINS``."""
        at = np.ones(bins.shape[1], np.int64)
        for node in sorted(self.splits):  # parents come before their children
            here = np.flatnonzero(at == node)
            if len(here):
                f, edge, missing_left = self.splits[node]
                b = bins[f, here]
                left = np.where(b == BINS, missing_left, b <= edge)
                at[here] = 2 * node + ~left
        return at

    def value(self, bins: np.ndarray) -> np.ndarray:
        at = self.nodes(bins)
        out = np.zeros(bins.shape[1])
        for node, v in self.values.items():
            out[at == node] = v
        return out


@dataclass
class Boosted:
    """Trees, the edges of the bins, and the constant they start from."""

    columns: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree]
    gains: dict[str, float]

    def bins(self, x: np.ndarray) -> np.ndarray:
        """(features, rows) of bin numbers from raw values, NaN for what is missing."""
        out = np.stack([np.searchsorted(np.array(e), v, side="left") for e, v in zip(self.edges, x, strict=True)]) if len(x) else np.zeros(x.shape, int)
        return np.where(np.isnan(x), BINS, out).astype(np.uint8)

    def predict(self, df: DataFrame, output: str = S.PREDICTION) -> DataFrame:
        missing = set(self.columns) - set(df.columns)
        if missing:
            raise ValueError(f"panel lacks features the model was fitted on: {sorted(missing)}")
        shared = df.sparkSession.sparkContext.broadcast(self)
        schema = df.drop(output).withColumn(output, F.lit(0.0)).schema

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                x = np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(m.columns))])
                b = m.bins(x)
                score = m.start + sum((t.value(b) for t in m.trees), np.zeros(batch.num_rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:-1]), pa.array(score)], names=schema.names)

        given = df.drop(output).withColumns({f"_x{i}": ranks.finite(F.col(c).cast("double")) for i, c in enumerate(self.columns)})
        return given.mapInArrow(run, schema)

    def importance(self) -> dict[str, float]:
        """Gain of the squared error by feature, largest first."""
        return dict(sorted(self.gains.items(), key=lambda kv: -kv[1]))


def _partial(bins: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, wanted: list[int]) -> dict[int, np.ndarray]:
    """(features, bins, 3) of gradients, weights and rows for each wanted node."""
    out = {}
    for node in wanted:
        here = np.flatnonzero(at == node)
        if len(here):
            made = np.empty((len(bins), BINS + 1, 3))
            for f, b in enumerate(bins[:, here]):
                for k, v in enumerate((g[here], h[here], None)):
                    made[f, :, k] = np.bincount(b, v, BINS + 1)
            out[node] = made
    return out


def _best(hist: np.ndarray, features: list[int], penalty: float, min_rows: int) -> tuple[float, tuple[int, int, bool]] | None:
    """(gain, split) of a node, None where no split leaves ``min_rows`` on both sides and gains."""
    score = lambda g, h: g * g / np.maximum(h + penalty, 1e-300)  # an empty side counts nothing
    best = None
    for f in features:
        g, h, n = hist[f].T
        whole = score(g.sum(), h.sum())
        below = [np.cumsum(v[:BINS])[:-1] for v in (g, h, n)]
        for missing_left in (True, False):
            left = [b + missing_left * v[BINS] for b, v in zip(below, (g, h, n), strict=True)]
            right = [v.sum() - a for a, v in zip(left, (g, h, n), strict=True)]
            ok = (left[2] >= min_rows) & (right[2] >= min_rows)
            if ok.any():
                gain = np.where(ok, score(left[0], left[1]) + score(right[0], right[1]) - whole, -np.inf)
                k = int(gain.argmax())
                if gain[k] > 1e-12 and (best is None or gain[k] > best[0] + 1e-12):
                    best = float(gain[k]), (f, k, missing_left)
    return best


def fit(train: DataFrame, columns: list[str], *, trees: int = 300, rate: float = 0.03, leaves: int = 15, depth: int = 6, min_rows: int = 80, rows: float = 0.8,
        features: float = 0.7, penalty: float = 5.0, seed: int = 7, save_every: int = 10) -> Boosted:
    """Boosted trees of the labelled rows, for the squared error. Rows and features of a tree are drawn by keyed hashes.

    A table without labels gives the constant 0. Every ``save_every`` trees the scores are written, so a pass applies only recent trees.
    """
    spark, p = train.sparkSession, len(columns)
    weight = F.coalesce(F.col(S.WEIGHT), F.lit(1.0)) if S.WEIGHT in train.columns else F.lit(1.0)
    known = train.where(F.col(S.LABEL).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(S.LABEL).cast("double").alias("y"), weight.cast("double").alias("w"),
                                                           *[ranks.finite(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(columns)])
    known = materialise(known, "training")
    found = {i: sorted(set(q)) for i, q in ranks.column_quantiles(known, p, [k / BINS for k in range(1, BINS)]).items()}
    total = known.agg(F.sum(F.col("w") * F.col("y")), F.sum("w")).first()
    model = Boosted(columns, [found.get(i, []) for i in range(p)], float(total[0] / total[1]) if total[1] else 0.0, [], dict.fromkeys(columns, 0.0))
    shared = spark.sparkContext.broadcast(model)

    def bin_rows(batches):
        m = shared.value
        for batch in batches:
            b = m.bins(np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(p)]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("y"), batch.column("w"), pa.array(np.full(batch.num_rows, m.start)),
                                              pa.array([c.tobytes() for c in b.T], pa.binary())], names=["row", "y", "w", "score", "bins"])

    schema = "row bigint, y double, w double, score double, bins binary"
    table = materialise(known.mapInArrow(bin_rows, schema), "binned")
    recent: list[Tree] = []
    for number in range(trees if total[1] else 0):
        drawn = [f for f in range(p) if np.random.default_rng([seed, number, f]).random() < features] or [number % p]
        keep = F.pmod(F.xxhash64(F.lit(seed), F.lit(number), "row"), F.lit(1_000_000)) < int(rows * 1_000_000)
        grown, gains, hists, level = Tree(), {}, {}, [1]
        while level:
            for node, m in _histograms(table.where(keep), recent, grown, level, p).items():
                hists[node] = m
                best = _best(m, drawn, penalty, min_rows)
                if best and node < 2 ** depth:
                    gains[node], grown.splits[node] = best
            level = [c for k in level if k in grown.splits for c in (2 * k, 2 * k + 1)]
        recent.append(_best_first(grown, gains, hists, leaves, penalty, rate, model))
        model.trees.append(recent[-1])
        if len(recent) == save_every:
            table, recent = materialise(_rescored(table, recent, schema), "scored"), []
    return model


def _best_first(grown: Tree, gains: dict, hists: dict, leaves: int, penalty: float, rate: float, model: Boosted) -> Tree:
    """The ``leaves`` - 1 best splits that hang together, and the leaf values."""
    out, open_ = Tree(), {1}
    while len(open_) < leaves:
        best = max((k for k in open_ if k in gains), key=lambda k: (gains[k], -k), default=None)
        if best is None:
            break
        out.splits[best] = grown.splits[best]
        model.gains[model.columns[grown.splits[best][0]]] += gains[best]
        open_ = open_ - {best} | {2 * best, 2 * best + 1}
    for node in open_:
        g, h = hists[node][0, :, 0].sum(), hists[node][0, :, 1].sum()
        out.values[node] = float(rate * g / (h + penalty))
    return out


def _arrays(batch: pa.RecordBatch, p: int, trees: list[Tree]) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, p).T
    score = batch.column("score").to_numpy() + sum((t.value(bins) for t in trees), np.zeros(batch.num_rows))
    return bins, score, batch.column("y").to_numpy(), batch.column("w").to_numpy()


def _histograms(table: DataFrame, trees: list[Tree], grown: Tree, wanted: list[int], p: int) -> dict[int, np.ndarray]:
    shared = table.sparkSession.sparkContext.broadcast((trees, grown, wanted))

    def run(batches):
        (done, tree, nodes), sums = shared.value, {}
        for batch in batches:
            bins, score, y, w = _arrays(batch, p, done)
            for node, m in _partial(bins, w * (y - score), w, tree.nodes(bins), nodes).items():
                sums[node] = sums[node] + m if node in sums else m
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["node", "m"])

    def add(key, part):
        return pa.table({"node": [key[0].as_py()], "m": pa.array([sum(np.frombuffer(m) for m in part["m"].to_pylist()).tobytes()], pa.binary())})

    rows = table.mapInArrow(run, "node bigint, m binary").groupBy("node").applyInArrow(add, "node bigint, m binary").collect()  # one row for each node
    return {r.node: np.frombuffer(r.m).reshape(p, BINS + 1, 3) for r in rows}


def _rescored(table: DataFrame, trees: list[Tree], schema: str) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            p = len(batch.column("bins")[0].as_py()) if batch.num_rows else 0
            score = _arrays(batch, p, shared.value)[1] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("y"), batch.column("w"), pa.array(score), batch.column("bins")], names=["row", "y", "w", "score", "bins"])

    return table.mapInArrow(run, schema)


def importance_table(model: Boosted, like: DataFrame) -> DataFrame:
    """(feature, importance), the share of the gain."""
    total = sum(model.gains.values()) or 1.0
    return like.sparkSession.createDataFrame([(c, g / total) for c, g in model.importance().items()], "feature string, importance double")


def to_json(model: Boosted) -> str:
    return json.dumps({"columns": model.columns, "edges": model.edges, "start": model.start, "gains": model.gains,
                       "trees": [[sorted((k, *map(float, v)) for k, v in t.splits.items()), sorted(t.values.items())] for t in model.trees]})


def from_json(text: str) -> Boosted:
    d = json.loads(text)
    trees = [Tree({int(k): (int(f), int(e), bool(m)) for k, f, e, m in splits}, {int(k): v for k, v in values}) for splits, values in d["trees"]]
    return Boosted(d["columns"], d["edges"], d["start"], trees, d["gains"])
