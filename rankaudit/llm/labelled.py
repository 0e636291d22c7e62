"""Folds and bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(id_col, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts`` (a null id counts as empty text)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts == part


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, held_out: Column, max_rows: int, max_chars: int, own: bool = False
) -> tuple[list[str], list]:
    """Texts and labels of at most ``max_rows`` rows outside the held-out fold,
    chosen by the hash of doc_id.  ``docs``: doc_id, text; ``labels``: doc_id and
    ``label_col``.  Null labels and texts, and texts beyond ``max_chars``
    characters, are never sampled; only the sample reaches the driver.  ``own``: the texts
    carry their labels themselves (column ``label_col`` of ``docs``), so where rows repeat an
    id each text keeps its own."""
    chosen = (
        labels.select("doc_id", F.col(label_col).alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    )
    on = ["doc_id", "label"] if own else ["doc_id"]
    chosen = chosen.distinct() if own else chosen
    usable = docs.select("doc_id", "text", *([F.col(label_col).alias("label")] if own else [])).where(F.length("text") <= max_chars)
    rows = (
        usable.join(F.broadcast(chosen), on)  # at most max_rows rows
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label", "text").limit(max_rows).collect()
    )
    return [r["text"] for r in rows], [r["label"] for r in rows]
