"""Scoring of pairs by a batch model, such as a cross-encoder, loaded once a Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T


def rerank(pairs: DataFrame, load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], query: str = "message_text", passage: str = "profile", batch: int = 16) -> DataFrame:
    """Adds `score`, the sigmoid of the model's logit for (query, passage). `load` runs once a worker and gives a function from
    two arrays of texts to an array of logits; null texts count as empty."""
    predict = predict_batch_udf(load, return_type=T.FloatType(), batch_size=batch)
    logit = predict(F.coalesce(F.col(query), F.lit("")), F.coalesce(F.col(passage), F.lit(""))).cast("double")
    return pairs.withColumn("score", 1 / (1 + F.exp(-logit)))
