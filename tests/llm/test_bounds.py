"""What a task holds of a large table: splits of what it reads and row groups of what it writes."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import common

SPLIT, LEAST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"


@pytest.fixture
def settings(spark):
    keys = [*common.SMALL, LEAST]
    for key in keys:
        spark.conf.unset(key)
    spark.conf.set(LEAST, "1")
    yield spark.conf
    for key in keys:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """40 MB of documents in one file, as one task writes it."""
    path = tmp_path_factory.mktemp("wide")
    digits = [F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(8)]
    docs = spark.range(0, 40_000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *digits).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    docs.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_row_groups_of_stored_tables_are_small(spark, settings, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    table = common.stored(docs.coalesce(1), "wide")
    (path,) = table.inputFiles()
    found = pq.ParquetFile(path.removeprefix("file://")).metadata
    sizes = [found.row_group(k).total_byte_size for k in range(found.num_row_groups)]
    assert sum(sizes) > 2 * common.ROW_GROUP and max(sizes) < 1.5 * common.ROW_GROUP
    assert table.count() == 40_000


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage])
def test_stages_read_large_files_in_small_splits(spark, settings, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert spark.read.parquet(f"{folder}/documents.parquet").rdd.getNumPartitions() == 1
    assert stage(spark, docs, folder).rdd.getNumPartitions() >= 3


def test_settings_of_the_session_stay(spark, settings):
    settings.set(SPLIT, "64m")
    common.small_batches(spark)
    assert settings.get(SPLIT) == "64m"
