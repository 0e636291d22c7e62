"""Language identification: averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy.

A seventh of the training sample is held back: its cross-entropy chooses the
softmax temperature, and the score below which a prediction is flagged as
rejected is the ``REJECT`` quantile of the right answers' scores there.

Defined cases: a text that is null or has no letter gets ``und`` with score 0,
rejected; without a labelled row every text does; with one learned language
every other text gets that language with score 1; rows are predicted one by one,
so repeated ids and texts repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from rankaudit.llm.labelled import in_fold, labelled_sample
from rankaudit.llm.scoring import scored
from rankaudit.llm.subwords import REMEMBER, SubwordSoftmax, WordIndex

MAX_ROWS = 4_000
MAX_CHARS = 20_000
REJECT = 0.005
LETTER = re.compile(r"[^\W\d_]")


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str]) -> tuple[SubwordSoftmax | None, list[str], float, float]:
    """(model, languages, temperature, score below which to reject)."""
    usable = [(t, v) for t, v in zip(texts, labels, strict=True) if LETTER.search(t)]
    langs = sorted({v for _, v in usable})
    if not langs:
        return None, [], 1.0, 1.0
    y = np.array([langs.index(v) for _, v in usable], np.int64)
    back = np.arange(len(y)) % 7 == 6
    if len(set(y[~back])) < len(langs):
        back = np.zeros(len(y), bool)
    model = SubwordSoftmax(len(langs)).fit([t for (t, _), b in zip(usable, back, strict=True) if not b], y[~back], steps=160)
    held = back if back.any() else ~back
    z, _ = model.document_logits([t for (t, _), b in zip(usable, held, strict=True) if b], WordIndex(), [])
    at = np.arange(len(z)), y[held]
    grid = np.geomspace(0.25, 8, 26)
    temperature = float(min(grid, key=lambda t: -np.log(np.maximum(_softmax(z / t)[at], 1e-12)).mean()))
    p = _softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    model.embed = model.out = None
    return model, langs, temperature, float(np.quantile(right, REJECT)) if len(right) else 1.0


def scorer(trained, text_col: str):
    model, langs, temperature, floor = trained
    index, memory = WordIndex(), []

    def predict(rows: pa.RecordBatch) -> dict[str, list]:
        nonlocal index, memory
        if len(index.ids) > REMEMBER:
            index, memory = WordIndex(), []
        texts = rows.column(text_col).to_pylist()
        letters = np.array([model is not None and bool(LETTER.search(t or "")) for t in texts])
        if model is None:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "rejected": [True] * len(texts)}
        p = _softmax(model.document_logits(texts, index, memory)[0] / temperature)
        best, score = p.argmax(1), np.where(letters, p.max(1), 0.0)
        return {
            "lang_pred": [langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)],
            "score": score.tolist(),
            "rejected": (~letters | (score < floor)).tolist(),
        }

    return predict


def identify_language(docs: DataFrame, trained, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and lang_pred, score, rejected."""
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    return scored(docs, text_col, partial(scorer, trained, text_col), fields)


def language_model(docs: DataFrame):
    """Learned from text and non-null lang of documents outside the held-out fold."""
    return train(*labelled_sample(docs, docs, "lang", in_fold("doc_id", 5, 0), MAX_ROWS, MAX_CHARS, own=True))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    out = identify_language(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "rejected")
