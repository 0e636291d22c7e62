"""Toxicity: a bag of subword embeddings averaged into a linear softmax.

Words are read in windows of ``window`` words, so that a few toxic words show
in a long text: a window is the average of its words' vectors, a word the
average of its character n-grams' (an unseen misspelling shares most of them),
and a document scores as its most toxic window.  Embeddings and softmax are
trained jointly on at most ``MAX_ROWS`` labelled rows of at most ``MAX_CHARS``
characters; a seventh of them is held back to turn margins into probabilities.

Defined cases: a text that is null or has no word scores 0; rows with a null
label are not learned from; without rows of both labels every text with a word
scores the share of label 1 (0 without rows); rows are scored one by one, so
repeated ids and texts repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from rankaudit.llm.labelled import in_fold, labelled_sample
from rankaudit.llm.scoring import scored
from rankaudit.llm.subwords import REMEMBER, SubwordSoftmax, WordIndex, platt

MAX_ROWS = 8_000
MAX_CHARS = 20_000
THRESHOLD = 0.7


def train(texts: list[str], labels: list[int], window: int = 8) -> SubwordSoftmax | float:
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return float(y.mean()) if len(y) else 0.0
    back = np.arange(len(y)) % 7 == 6
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back = np.zeros(len(y), bool)
    model = SubwordSoftmax(2, dim=4, window=window).fit([t for t, b in zip(texts, back, strict=True) if not b], y[~back], steps=250, refine=330)
    held = back if back.any() else ~back
    z, _ = model.document_logits([t for t, b in zip(texts, held, strict=True) if b], WordIndex(), [])
    model.slope, model.offset = platt(z[:, 1] - z[:, 0], y[held].astype(float))
    model.embed = model.out = None
    return model


def scorer(model: SubwordSoftmax | float, text_col: str):
    index, memory = WordIndex(), []

    def score(rows: pa.RecordBatch) -> dict[str, list]:
        nonlocal index, memory
        if len(index.ids) > REMEMBER:
            index, memory = WordIndex(), []
        texts = rows.column(text_col).to_pylist()
        if isinstance(model, float):
            counts = np.array([len(index.number(t)) for t in texts])
            p = np.full(len(texts), model)
        else:
            z, counts = model.document_logits(texts, index, memory)
            margin = model.slope * (z[:, 1] - z[:, 0]) + model.offset
            p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return {"score": np.where(counts > 0, p, 0.0).tolist()}

    return score


def toxicity_model(docs: DataFrame, labels: DataFrame) -> SubwordSoftmax | float:
    """Learned from the rows of ``labels`` (doc_id, toxic) outside the held-out fold."""
    return train(*labelled_sample(docs, labels, "toxic", in_fold("doc_id", 3, 1), MAX_ROWS, MAX_CHARS))


def score_toxicity(docs: DataFrame, model: SubwordSoftmax | float, text_col: str = "text", keep: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text (unless ``keep``), and ``score``."""
    return scored(docs, text_col, partial(scorer, model, text_col), [StructField("score", DoubleType())], keep)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("others"), "text")
    out = score_toxicity(rows, toxicity_model(docs, labels), keep=True).where(F.col("score") < threshold)
    return out.select(*[F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score_toxicity(docs.select("doc_id", "text"), toxicity_model(docs, labels))
    return out.select(
        "doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
