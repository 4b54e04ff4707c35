"""Scoring of feature vectors.

A scored row keeps its input columns and gains ``label``, ``is_attack``, ``confidence``
and ``model_version``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sessora import schemas as S

SCORE_TYPE = "label string, is_attack boolean, confidence double, model_version string"
_SCORES = ("label", "is_attack", "confidence", "model_version")

#: A model takes event types and vectors of one batch and returns the score columns.
Model = Callable[[pd.Series, pd.Series], pd.DataFrame]


def score_constant(vectors: DataFrame) -> DataFrame:
    """The shipped model, which gives every vector the same answer."""
    return vectors.withColumns(
        {
            "label": F.lit(S.CONSTANT_LABEL),
            "is_attack": F.lit(S.CONSTANT_IS_ATTACK),
            "confidence": F.lit(S.CONSTANT_CONFIDENCE),
            "model_version": F.lit(S.CONSTANT_MODEL_VERSION),
        }
    )


def score_with(vectors: DataFrame, model: Model) -> DataFrame:
    """Score with any model, in Arrow batches; each Python worker unpickles it once."""

    @F.pandas_udf(SCORE_TYPE)
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for event_types, values in batches:
            yield model(event_types, values)[list(_SCORES)]

    return _unpack(vectors, scored("event_type", "values"))


def score_where(
    vectors: DataFrame,
    is_attack: Column,
    *,
    confidence: Column,
    model_version: str,
    attack_label: str = "attack",
) -> DataFrame:
    """Score by a rule over columns, without leaving the JVM."""
    verdict = F.coalesce(is_attack, F.lit(False))
    return vectors.withColumns(
        {
            "label": F.when(verdict, attack_label).otherwise(S.CONSTANT_LABEL),
            "is_attack": verdict,
            "confidence": confidence,
            "model_version": F.lit(model_version),
        }
    )


def _unpack(vectors: DataFrame, score: Column) -> DataFrame:
    scored = vectors.withColumn("_score", score)
    return scored.withColumns({c: F.col("_score")[c] for c in _SCORES}).drop("_score")


class ThresholdModel:
    """Message rule: an attack once the session has ``limit`` errors. Summaries are normal."""

    version = "threshold-v1"

    def __init__(self, limit: int = 3) -> None:
        self.limit = limit

    def __call__(self, event_types: pd.Series, values: pd.Series) -> pd.DataFrame:
        errors_at = S.MESSAGE_FEATURES.index("error_count_total")
        is_message = event_types == S.MESSAGE_EVENT
        attack = pd.Series(False, index=values.index)
        if is_message.any():
            messages = np.stack(values[is_message].to_numpy())
            attack[is_message] = messages[:, errors_at] >= self.limit
        return pd.DataFrame(
            {
                "label": attack.map({True: "attack", False: S.CONSTANT_LABEL}),
                "is_attack": attack,
                "confidence": attack.map({True: 0.9, False: 0.1}),
                "model_version": self.version,
            }
        )


def inference_responses(scored: DataFrame) -> DataFrame:
    """The six response fields; ``queue_sequence_id`` as text names the request."""
    return scored.select(
        F.col("queue_sequence_id").cast("string").alias("request_id"),
        *_SCORES,
        F.col("event_type").alias("received_event_type"),
    )


def invalid_responses(responses: DataFrame) -> DataFrame:
    """Responses whose confidence is missing, NaN or outside [0, 1]."""
    return responses.where(~_confidence_ok())


def validate_responses(responses: DataFrame) -> DataFrame:
    """Responses with a confidence within [0, 1]."""
    return responses.where(_confidence_ok())


def _confidence_ok() -> Column:
    # Spark orders NaN above every number, so the upper bound rejects it
    return F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
