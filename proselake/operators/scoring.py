"""Sentence models as plug-ins: batched probabilities, the training loss, and perplexity from token losses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions import text as T


def softmax(logits: np.ndarray) -> np.ndarray:
    """Row by row, stable for large values."""
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


_MODELS: dict[str, Callable] = {}


def batched_scorer(load: Callable[[str], Callable[[list[str]], np.ndarray]], folder: str, batch: int = 64, most_tokens: int = 128) -> Callable[[Column], Column]:
    """A scorer from a function that loads a model: texts in batches, the first `most_tokens` words of each, to logits of two classes.

    The model is loaded once in each Python worker and folder.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if folder not in _MODELS:
            _MODELS[folder] = load(folder)
        model = _MODELS[folder]
        for texts in parts:
            cut = [" ".join((t or "").split()[:most_tokens]) for t in texts]
            logits = [model(cut[k : k + batch]) for k in range(0, len(cut), batch)]
            yield pd.Series(softmax(np.concatenate(logits))[:, 1] if logits else np.zeros(0))

    return lambda c: score(c)


def smoothed_loss(rows: DataFrame, label: str = "label", logits: str = "logits", weight: str = "weight", smoothing: float = 0.1) -> DataFrame:
    """One row: cross-entropy of logits (array of doubles) with class weights and label smoothing.

    A row's own class counts by its weight; the smoothed part counts each class by its own. rows have `weights`, all classes'
    weights in order, and the mean goes by the weights of the rows' labels.
    """
    top = F.array_max(logits)
    total = top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    loss = F.transform(logits, lambda x: total - x)
    own = F.get(loss, F.col(label)) * F.col(weight)
    spread = F.aggregate(F.zip_with(loss, F.col("weights"), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) / F.size(logits)
    return rows.agg((F.sum((1 - smoothing) * own + smoothing * spread) / F.sum(weight)).alias("loss"))


def perplexity(losses: DataFrame, keys: list[str], at: str = "at", loss: str = "loss", chunk: int = 512, most_chunks: int | None = None) -> DataFrame:
    """(keys, perplexity, n_chunks) from the loss of every token: the exponential of the mean of the chunks' mean losses.

    A chunk of one token isn't scored. Keys without a scored chunk: infinite.
    """
    c = losses.groupBy(*keys, F.floor(F.col(at) / chunk).alias("_chunk")).agg(F.avg(loss).alias("_loss"), F.count(F.lit(1)).alias("_n"))
    scored = (F.col("_n") >= 2) & (F.lit(True) if most_chunks is None else F.col("_chunk") < most_chunks)
    p = c.groupBy(*keys).agg(F.avg(F.when(scored, F.col("_loss"))).alias("m"), F.count_if(scored).alias("n_chunks"))
    return p.select(*keys, F.coalesce(F.exp("m"), F.lit(float("inf"))).alias("perplexity"), "n_chunks")


def evaluated(rows: DataFrame, scorer: Callable[[Column], Column], threshold: float, label: str = "label", text_col: str = "text", most_errors: int = 15) -> tuple[DataFrame, DataFrame]:
    """The confusion at a threshold that is read, never picked again, and the errors to show."""
    from proselake.operators import evaluation as E
    from proselake.operators.choices import shown

    s = E.scored(rows, scorer, text_col)
    return E.confusion(s, threshold, label), shown(E.errors(s, threshold, label), [F.desc("score"), text_col], most_errors)


def sentence_scores(df: DataFrame, scorer: Callable[[Column], Column], unit: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(unit, i, sentence, score)."""
    s = df.select(unit, F.posexplode(T.sentences(text_col)).alias("i", "sentence"))
    return s.withColumn("score", scorer(F.col("sentence")))
