"""Token counts through a digest cache.

The cache is a Parquet table in shared storage, one folder per tokenizer version (a digest of the
tokenizer's file, the library and its release): content digest -> n_tokens. A run joins the digests
of its contents to it, encodes only distinct contents that miss, appends their counts, and joins
counts back by digest. The digest is over the content as the tokenizer is given it (null becomes
empty; nothing else may be normalised away, as it would change counts).

Texts move at most once: equal contents are merged on the map side first, so a content with a third
of all rows is one row per task, and its ids meet its count in a join whose large partitions are split; with few misses only those texts are picked, by a broadcast join
whose size is counted before. Appends are Spark's committed writes: a lost executor or a failed run
leaves no partial count, and rows that two runs append at once agree and are merged on reading.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and null doc_ids keep
one row each; an empty table gives an empty table; other columns are ignored; texts are encoded
whole, whatever their length.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from importlib import metadata
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, read_table, shared_dir, small_batches, stored, text_or_empty

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
#: Up to so many missing digests (32 bytes each) are sent to all executors.
BROADCAST_DIGESTS = 50_000
CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_path(name: str) -> str:
    """The tokenizer's file: a path as it is, else a file of the installed public tokenizers."""
    if Path(name).is_absolute():
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=4)
def load_tokenizer(name: str):
    """A function from a list of texts to their token counts; one per worker process and tokenizer."""
    path = tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def tokenizer_version(name: str) -> str:
    path = Path(tokenizer_path(name))
    library = "sentencepiece" if path.suffix == ".model" else "tokenizers"
    return hashlib.sha256(path.read_bytes() + f"/{library}/{metadata.version(library)}".encode()).hexdigest()[:32]


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _encode(name: str):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_tokenizer(name)
        for batch in batches_of(batches, 256):
            counts = count(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return encode


def count_tokens(docs: DataFrame, cache_dir: str, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_tokens, over_limit; brings the cache up to date."""
    spark = docs.sparkSession
    small_batches(spark)
    cache_path = f"{cache_dir}/{tokenizer_version(tokenizer)}"
    content = text_or_empty()
    contents = docs.select("doc_id", content.alias("content"), F.unhex(F.sha2(content, 256)).alias("digest"))
    keyed = stored(contents.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes")), "token-digests")
    texts = contents.select("digest", "content")
    known = read_cache(spark, cache_path)
    misses = None
    if known is not None:
        misses = stored(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "token-misses")
        n = misses.count()
        texts = texts.join(F.broadcast(misses) if n <= BROADCAST_DIGESTS else misses, "digest", "left_semi")
    if misses is None or n:
        distinct = texts.groupBy("digest").agg(F.first("content").alias("content"))
        distinct.mapInArrow(_encode(tokenizer), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # stored, so that both sides of the join are plain exchanges: Spark then splits a digest with many rows
    counts = stored(read_cache(spark, cache_path), "token-counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """The cache is kept for each input folder."""
    cache = f"{shared_dir(spark)}/quillon/token-counts/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), cache)
