"""Boosted trees as those of MLlib's GBTClassifier, all grown in one barrier stage instead of some jobs a level."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from brindle.operators.group import Group, together

BINS = 32  # of a feature, as MLlib's maxBins; two features are counted at once, as one key of BINS * BINS
SUMMARY = 1024  # values a task tells of a feature that has more


@dataclass
class GBTClassifier:
    """Logistic loss, trees of the least squares of its gradient, `stepSize` for all trees but the first: MLlib's algorithm.

    Bins are those of all rows (MLlib takes a sample of 10,000): values in between where a feature has no more than BINS, else
    quantiles, with a rank that is exact to 1 / SUMMARY.
    """

    labelCol: str = "label"
    weightCol: str = "weight"
    featuresCol: str = "features"
    maxIter: int = 20
    maxDepth: int = 5
    stepSize: float = 0.1

    def fit(self, rows: DataFrame) -> GBTClassificationModel:
        trees, depth, step = self.maxIter, self.maxDepth, self.stepSize
        given = rows.select(F.col(self.labelCol).cast("double").alias("label"), F.col(self.weightCol).cast("double").alias("weight"), vector_to_array(F.col(self.featuresCol)).alias("features"))

        def work(group: Group, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grown = _grow(group, batches, trees, depth, step)
            if not group.rank:
                yield pa.RecordBatch.from_pydict({"trees": pa.array([pickle.dumps(grown)], pa.binary())})

        grown, features = pickle.loads(together(given, work, "trees binary").collect()[0]["trees"])
        return _model(rows.sparkSession.sparkContext, grown, features, step).setFeaturesCol(self.featuresCol)


def _read(batches: Iterator[pa.RecordBatch], file) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Labels, weights and blocks (features, rows) of the batches; the blocks are mapped from the file."""
    labels, weights, shapes, at = [], [], [], 0
    for b in batches:
        if b.num_rows:
            labels.append(b.column(0).to_numpy(zero_copy_only=False))
            weights.append(b.column(1).to_numpy(zero_copy_only=False))
            x = np.ascontiguousarray(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).T)
            file.write(x.data)
            shapes.append((at, x.shape))
            at += x.nbytes
    file.flush()
    join = lambda x: np.concatenate(x) if x else np.zeros(0)
    return join(labels), join(weights), [np.memmap(file, "f8", "r", at, shape) for at, shape in shapes]


def _summary(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and how many rows each stands for: all distinct values of few, else values at even ranks."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) > SUMMARY:
        at = np.minimum(np.searchsorted(np.cumsum(counts), (np.arange(SUMMARY) + 0.5) * len(x) / SUMMARY), len(values) - 1)
        values, counts = values[at], np.full(SUMMARY, len(x) / SUMMARY)
    return values, counts


def _cuts(summaries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """At most BINS - 1 values between the bins; a row is in the bin of the least cut that isn't below its value."""
    values, at = np.unique(np.concatenate([v for v, _ in summaries]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([c for _, c in summaries]))
    if len(values) <= BINS:
        return (values[1:] + values[:-1]) / 2
    upto = np.cumsum(counts)
    picked = np.unique(np.searchsorted(upto, np.arange(1, BINS) * upto[-1] / BINS))
    picked = picked[picked < len(values) - 1]
    return (values[picked] + values[picked + 1]) / 2


def _grow(group: Group, batches: Iterator[pa.RecordBatch], trees: int, depth: int, step: float) -> Any:
    with tempfile.TemporaryFile() as raw, tempfile.TemporaryFile() as packed:
        label, w, blocks = _read(batches, raw)
        n = len(label)
        features = max(group.shared(max(group.gathered(len(blocks[0]) if blocks else 0) or [0])), 0)
        whole = [lambda f=f: np.concatenate([b[f] for b in blocks]) if blocks else np.zeros(0) for f in range(features)]
        cuts = []
        for f in range(features):
            told = group.gathered(_summary(whole[f]()))
            cuts.append(_cuts(told) if told else None)
        cuts = group.shared(cuts)
        pairs = (features + 1) // 2
        for p in range(pairs):
            key = np.searchsorted(cuts[2 * p], whole[2 * p]()) * BINS
            if 2 * p + 1 < features:
                key += np.searchsorted(cuts[2 * p + 1], whole[2 * p + 1]())
            packed.write(key.astype(np.uint16).data)
        packed.flush()
        keys = np.memmap(packed, np.uint16, "r", 0, (pairs, n)) if n and pairs else np.zeros((pairs, 0), np.uint16)
        y = np.where(label > 0.5, 1.0, -1.0)
        score, target, grown = np.zeros(n), y, []
        for k in range(trees):
            nodes, leaf = _tree(group, keys, w, target, depth, features)
            score += leaf * (step if k else 1.0)
            target = 4.0 * y / (1.0 + np.exp(2.0 * y * score))  # the negative gradient of 2 log(1 + exp(-2 y F))
            if nodes is not None:
                grown.append([(cuts[f][b], f, i) if f >= 0 else (v, -1, -1) for f, b, v, i in nodes])
    return grown, features


def _counted(keys: np.ndarray, rows: list[np.ndarray], w: np.ndarray, wt: np.ndarray) -> np.ndarray:
    """(2, nodes, 2 * pairs, BINS): weights and weighted targets of the rows of each node by bin."""
    cells, sel = BINS * BINS, np.concatenate(rows)
    shift = np.repeat(np.arange(len(rows)) * cells, [len(r) for r in rows])
    out = np.zeros((2, len(rows), len(keys), 2, BINS))
    if len(sel):
        of = [w[sel], wt[sel]]
        for p, key in enumerate(keys):
            at = key[sel].astype(np.intp)
            at += shift
            for s in (0, 1):
                both = np.bincount(at, of[s], len(rows) * cells).reshape(len(rows), BINS, BINS)
                out[s, :, p, 0], out[s, :, p, 1] = both.sum(2), both.sum(1)
    return out.reshape(2, len(rows), -1, BINS)


def _splits(counts: np.ndarray) -> list[tuple]:
    """For each node (feature, bin, sums of the left, sums of the right) of the largest gain, or None if none is above 0."""
    left = np.cumsum(counts, 3)
    whole = left[:, :, :1, -1:]
    right = whole - left
    (wl, tl), (wr, tr), (w0, t0) = left, right, whole
    least = 1e-9 * w0
    ok = (wl > least) & (wr > least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, tl * tl / wl + tr * tr / wr - t0 * t0 / w0, -1.0)
    out = []
    for m, g in enumerate(gain.reshape(len(w0), -1)):
        at = int(g.argmax())
        f, b = divmod(at, BINS)
        sums = left[:, m, f, b], right[:, m, f, b]
        out.append((f, b, *map(tuple, sums)) if g[at] > 1e-12 * w0[m, 0, 0] else None)
    return out


def _tree(group: Group, keys: np.ndarray, w: np.ndarray, target: np.ndarray, depth: int, features: int):
    """At task 0 the nodes (feature or -1, bin, value, number of the left child; the right one follows); the value of each row's leaf."""
    wt, leaf = w * target, np.zeros(len(w))
    level = [(0, np.arange(len(w)))]  # nodes that may be split, with their rows here
    counts = group.total(_counted(keys, [level[0][1]], w, wt))
    nodes = None
    if counts is not None:
        s = counts[:, 0, 0].sum(1)
        nodes = [[-1, 0, s[1] / s[0], -1]]
    leaf[:] = group.shared(nodes[0][2] if nodes else None)
    for d in range(depth):
        best = group.shared(_splits(counts) if counts is not None else None)
        children, small, rest = [], [], []
        for m, ((number, rows), found) in enumerate(zip(level, best)):
            if found is None:
                continue
            f, b, left, right = found
            key = keys[f // 2][rows]
            goes = (key % BINS if f % 2 else key // BINS) > b
            parts = rows[~goes], rows[goes]
            for part, s in zip(parts, (left, right)):
                leaf[part] = s[1] / s[0]
            if nodes is not None:
                nodes[number][:2], nodes[number][3] = (f, b), len(nodes)
                nodes += [[-1, 0, s[1] / s[0], -1] for s in (left, right)]
            less = int(left[0] > right[0])  # the child of less weight is counted, the other is what is left
            small.append(parts[less])
            rest.append((m, less))
            children += [(len(nodes) - 2 + i if nodes is not None else 0, p) for i, p in enumerate(parts)]
        level = children
        if not level:
            break
        if d + 1 < depth:
            new = group.total(_counted(keys, small, w, wt))
            if new is not None:
                old = np.stack([counts[:, m] for m, _ in rest], 1) - new
                pair = np.stack([new, old], 2)
                for j, (_, less) in enumerate(rest):
                    if less:
                        pair[:, j] = pair[:, j, ::-1]
                counts = pair.reshape(2, -1, *pair.shape[3:])
    return nodes, leaf


def _model(sc, trees: list, features: int, step: float) -> GBTClassificationModel:
    """The trees as a model of MLlib."""
    ml, gateway = sc._jvm.org.apache.spark.ml, sc._gateway
    tree = ml.tree
    made = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(sc._jvm.double, len(trees))
    names = f"gbt_{uuid.uuid4().hex[:12]}"
    for k, nodes in enumerate(trees):
        built: dict[int, Any] = {}
        for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
            v, f, child = nodes[i]
            if f < 0:
                built[i] = tree.LeafNode(float(v), 0.0, None)
            else:
                built[i] = tree.InternalNode(0.0, 0.0, 0.0, built.pop(child), built.pop(child + 1), tree.ContinuousSplit(f, float(v)), None)
        made[k] = ml.regression.DecisionTreeRegressionModel(f"{names}_{k}", built[0], features)
        weights[k] = step if k else 1.0
    return GBTClassificationModel(ml.classification.GBTClassificationModel(names, made, weights, features))
