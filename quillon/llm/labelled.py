"""The bounded sample of labelled rows that the classifiers are fitted on, and their folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_of(modulus: int):
    """crc32 of doc_id as text, modulo; a null doc_id has the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def training_ids(labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """doc_id, y: at most per_class rows of each class outside the held-out fold, chosen by a hash of doc_id.

    Rows without doc_id or label are no examples; a document labelled twice counts as positive if either is.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_of(modulus) != held_out))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return picked[0].union(picked[1])


def training_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """doc_id, text, y of the sample. Its ids are bounded by 2 * per_class, so they are broadcast."""
    ids = training_ids(labels, label, modulus, held_out, per_class)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
