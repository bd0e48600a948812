"""Quality classifier: histogram gradient-boosted trees over document statistics.

Fitted on the driver, on the statistics (not texts) of at most PER_CLASS labelled documents of each
class; scores are computed where the documents are, by a vectorised walk of the flattened trees.

Defined cases: null and empty texts are scored on zero statistics; without usable labels every score
is the prior (0.5 with no label at all); repeated rows and null doc_ids keep one row each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, read_table, small_batches
from .labelled import fold_of, training_texts
from .textstats import BASE, MORE, statistics
from .trees import Forest, fit

MODULUS, HELD_OUT = 5, 0
PER_CLASS = 6000
THRESHOLD = 0.3
COUNTS = (*BASE, *MORE)


def features(counts: np.ndarray) -> np.ndarray:
    """Lengths in logarithms, and every other count per word and per character."""
    c = counts.astype(float)
    words, chars = np.maximum(1.0, c[:, :1]), np.maximum(1.0, c[:, len(BASE) : len(BASE) + 1])
    return np.concatenate([np.log1p(c[:, :1]), np.log1p(c[:, len(BASE) : len(BASE) + 1]), c[:, 1:] / words, c[:, 2:] / chars, np.log1p(c[:, 2:5])], axis=1)


def counted(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(COUNTS))


def _sample_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 1024):
        rows = counted(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=["doc_id", "y", *COUNTS])


def train(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, per_class: int = PER_CLASS) -> Forest:
    sample = training_texts(docs, labels, "quality", modulus, held_out, per_class).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "y")
    rows = sample.mapInArrow(_sample_features, "doc_id long, y int, " + ", ".join(f"{c} long" for c in COUNTS)).toPandas()
    rows = rows.sort_values(["doc_id", *COUNTS]).drop_duplicates()
    return fit(features(rows[list(COUNTS)].to_numpy(np.int64)), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text -> doc_id, score, predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: trees x nodes

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            p = shared.value.probabilities(features(counted(batch.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double, predicted int")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold_of(MODULUS) == HELD_OUT).alias("held_out"), "score", "predicted")
