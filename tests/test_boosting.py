import random

import numpy as np
from pyspark.ml.classification import GBTClassifier as MLlib
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from brindle.operators.boosting import BINS, GBTClassifier, _cuts, _summary


def _rows(spark, n, values):
    r = random.Random(5)
    made = []
    for _ in range(n):
        x = [float(r.randrange(values)) for _ in range(5)]
        y = int(x[0] + x[1] * x[2] / values + r.random() * 4 > values)
        made.append((y, 1.0 + 0.25 * y, Vectors.dense(x)))
    return spark.createDataFrame(made, ["label", "weight", "features"])


def _scores(model, df):
    return np.array([r[0] for r in model.transform(df).select(vector_to_array("probability")[1]).collect()])


def test_trees_are_those_of_mllib(spark):
    """With as few values as bins both have the same candidates for splits, and so the same trees."""
    df = _rows(spark, 500, 9).persist()
    want = MLlib(weightCol="weight", maxIter=12, maxDepth=5, stepSize=0.05).fit(df)
    got = GBTClassifier(weightCol="weight", maxIter=12, maxDepth=5, stepSize=0.05).fit(df)
    assert got.getNumTrees == 12 and got.numFeatures == 5 and got.treeWeights == want.treeWeights
    assert np.allclose(_scores(got, df), _scores(want, df), atol=1e-9)


def test_jobs_do_not_grow_with_the_trees(spark):
    """A model has as many jobs for thirty trees as for three: MLlib has some jobs for each level of each tree."""
    df, counts = _rows(spark, 200, 9), []
    for k, trees in enumerate((3, 30)):
        group = f"boosting-{k}"
        spark.sparkContext.setJobGroup(group, "")
        GBTClassifier(maxIter=trees).fit(df)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] < 10


def test_cuts_of_many_values_are_quantiles_of_all_rows():
    x = np.random.default_rng(3).lognormal(size=60_000)
    cuts = _cuts([_summary(part) for part in (x[:50_000], x[50_000:])])
    shares = np.diff([0, *(np.mean(x <= c) for c in cuts), 1])
    assert len(cuts) == BINS - 1 and np.all(np.abs(shares - 1 / BINS) < 0.004)
    heavy = np.concatenate([np.zeros(5_000), np.arange(1.0, 2_001)])
    assert _cuts([_summary(heavy)])[0] == 0.5
