"""What a node classifier is judged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.vectors import argmax, log_softmax


def masked(df: DataFrame, mask: str = "mask") -> DataFrame:
    """The rows of a split: those whose mask is true."""
    return df.filter(F.col(mask))


def predictions(df: DataFrame, h: str = "h") -> DataFrame:
    return df.withColumn("pred", argmax(F.col(h)))


def accuracy(df: DataFrame, h: str = "h", label: str = "label") -> DataFrame:
    """(accuracy): the share of rows whose largest output is at the label; null for no rows."""
    return df.agg(F.avg((argmax(F.col(h)) == F.col(label)).cast("double")).alias("accuracy"))


def cross_entropy(df: DataFrame, h: str = "h", label: str = "label", from_logits: bool = True) -> DataFrame:
    """(loss): the mean of -log p[label], from logits or from probabilities."""
    p: Column = log_softmax(F.col(h)) if from_logits else F.transform(h, F.ln)
    return df.agg(F.avg(-F.get(p, F.col(label))).alias("loss"))
