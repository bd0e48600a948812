"""BPE encoding and decoding through a table of distinct words.

Texts are cut at ASCII white space, which this tokenizer drops, so a word's ids do not depend on its
neighbours. Every distinct word of the corpus is encoded once; ids come back by position:

1. Spark splits texts into words. Scan tasks gather documents into blocks of about BLOCK_BYTES of words and
   give each document as places in the block's list of distinct words, and the list itself, ordered by a
   hash of the word and cut into buckets, which are ranges of the hash; both packed. One exchange deals
   documents by block and lists by bucket; texts themselves do not move.
2. A bucket's task encodes each distinct word once and answers each block with the ids of its words in their
   order.
3. A block's answers in the order of buckets are its word table: documents take ids by place, and decoding
   takes pieces by id from the tokenizer's own table, a word at a time. Decoded words are joined with
   spaces, as this tokenizer has no decoder of its own.

Rows shuffled are packs: a row per word and block moved 3.7 times the input, as over a tenth of these texts'
words are distinct. A very common word is one entry per block; copies of a text add no distinct words.

Defined cases: null, empty and blank texts have no tokens and decode to the empty string; very long
texts are a block of their own; repeated rows and null doc_ids keep one row each; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, read_table, small_batches, text_or_empty
from .tokens import tokenizer_path

TOKENIZER = "word_bpe_49k.json"
BLOCK_BYTES = 8 << 20
#: Text for which there is a bucket, up to MOST_BUCKETS, so that a block's part of a bucket stays hundreds of words.
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 2048
#: A bucket's words are remembered up to this number; beyond it some may be encoded again.
KNOWN_WORDS = 2_000_000
SPACE = r"[\x20\x09-\x0D]+"


@functools.lru_cache(maxsize=2)
def load_word_tokenizer(name: str):
    """The tokenizer, and its pieces by id (None where an id has no piece)."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path(name))
    model.no_truncation()
    model.no_padding()
    return model, [model.id_to_token(i) for i in range(model.get_vocab_size())]


def pack_strings(items: list[bytes]) -> bytes:
    """Byte strings as compressed lengths and content."""
    lengths = np.fromiter(map(len, items), np.uint32, len(items))
    return zstandard.compress(np.uint32(len(items)).tobytes() + lengths.tobytes() + b"".join(items), 3)


def unpack_strings(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def pack_codes(codes: np.ndarray) -> bytes:
    """32-bit places, by planes of bytes: those high up are nearly all zero."""
    return zstandard.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_codes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


#: Documents have their block; a part of a list has -1 - its bucket there, and its block in of_block.
BLOCKS = "block long, of_block long, doc_id long, codes binary, words binary"
_block_schema = pa.schema([("block", pa.int64()), ("of_block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("words", pa.binary())])


def _block_rows(block: int, parts: list[pa.RecordBatch], n_buckets: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its words as places, and one for each bucket of the list of distinct words."""
    lists = pa.chunked_array([p.column("words") for p in parts]).combine_chunks()
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy()
    ends = np.asarray(lists.offsets)[1:].astype(np.int64) - lists.offsets[0].as_py()
    blank = pc.index(encoded.dictionary, "").as_py()  # what stands before the first and after the last white space
    if blank >= 0:
        there = codes != blank
        ends = np.concatenate(([0], np.cumsum(there)))[ends]
        codes = codes[there]
    distinct = encoded.dictionary.cast(pa.binary()).to_pylist()
    order = sorted((i for i in range(len(distinct)) if i != blank), key=lambda i: (zlib.crc32(distinct[i]), distinct[i]))
    place = np.zeros(len(distinct), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    codes = place[codes]
    packed = [pack_codes(codes[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    doc_ids = pa.chunked_array([p.column("doc_id") for p in parts]).combine_chunks()
    for at in range(0, len(packed), rows):
        part = packed[at : at + rows]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.nulls(len(part), pa.int64()), doc_ids.slice(at, rows), pa.array(part, pa.binary()), pa.nulls(len(part), pa.binary())], schema=_block_schema)
    if order:
        words = [distinct[i] for i in order]
        buckets = (np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
        cuts = [*first.tolist(), len(words)]
        packs = [pack_strings(words[a:b]) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(-1 - buckets[first]), pa.array([block] * len(packs), pa.int64()), pa.nulls(len(packs), pa.int64()), pa.nulls(len(packs), pa.binary()), pa.array(packs, pa.binary())], schema=_block_schema)


def _blocks(block_bytes: int, n_buckets: int):
    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        parts: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            ends = np.asarray(batch.column("words").offsets)
            flat = batch.column("words").values
            sizes = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(flat)), dtype=np.int64)))[ends] if len(flat) else np.zeros(len(ends), np.int64)
            at = 0
            while at < batch.num_rows:  # as many documents as fit, and one at least
                fit = int(np.searchsorted(sizes, sizes[at] + block_bytes - size, side="right")) - 1
                upto = min(batch.num_rows, max(fit, at if parts else at + 1))
                if upto > at:
                    parts.append(batch.slice(at, upto - at))
                    size += int(sizes[upto] - sizes[at])
                    at = upto
                if at < batch.num_rows or size >= block_bytes:
                    yield from _block_rows(block, parts, n_buckets)
                    block, parts, size = block + 1, [], 0
                    give_back()
        if parts:
            yield from _block_rows(block, parts, n_buckets)
        del parts
        give_back()

    return blocks


def encode_words(words: list[str], tokenizer: str) -> list[np.ndarray]:
    """The ids of each word.

    Many words are encoded in one call, with a special token between them: the tokenizer cuts texts at
    special tokens first. A call whose separators don't come out one by one is made word by word.
    """
    model, _ = load_word_tokenizer(tokenizer)
    special = {t.content: k for k, t in model.get_added_tokens_decoder().items() if t.special and not t.normalized}
    separator = max(special, key=special.get, default=None)
    out: list[np.ndarray] = []
    for chunk in itertools.batched(words, 2048):
        texts = list(chunk)
        if separator is not None:
            ids = np.array(model.encode_batch_fast([separator.join(texts)], add_special_tokens=False)[0].ids, "<u4")  # no offsets
            at = np.flatnonzero(ids == special[separator])
            if len(at) == len(texts) - 1:
                ends = [*at.tolist(), len(ids)]
                out += [ids[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends)]
                continue
        out += [np.array(x.ids, "<u4") for x in model.encode_batch(texts, add_special_tokens=False)]
    return out


def _encode_buckets(tokenizer: str):
    """Parts of lists, those of a bucket one after the other -> answers; documents are passed over."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        bucket_now = None
        for batch in batches:
            lists = batch.filter(pc.is_valid(batch.column("words")))
            for bucket, block, data in zip(lists.column("block").to_pylist(), lists.column("of_block").to_pylist(), lists.column("words"), strict=True):
                if bucket != bucket_now or len(known) > KNOWN_WORDS:
                    known, bucket_now = {}, bucket
                words = unpack_strings(data.as_py())
                new = [w for w in words if w not in known]
                known.update(zip(new, (x.tobytes() for x in encode_words([w.decode() for w in new], tokenizer)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1 - bucket], pa.int64()), pa.array([pack_strings([known[w] for w in words])], pa.binary())], names=["answered", "bucket", "word_ids"])
        del known
        give_back()

    return encode


def decode_words(ids: np.ndarray, lengths: np.ndarray, tokenizer: str) -> list[bytes]:
    """Each word's ids joined to the tokenizer's pieces by id, with spaces between; ids without a piece are nothing."""
    _, pieces = load_word_tokenizer(tokenizer)
    table = np.array([None if p is None else p.encode() for p in pieces], object)
    found = table[ids].tolist() if len(ids) else []
    ends = np.cumsum(lengths).tolist()
    return [found[b - 1] or b"" if n == 1 else b" ".join([p for p in found[b - n : b] if p is not None]) for n, b in zip(lengths.tolist(), ends, strict=True)]


def _join_back(tokenizer: str, with_output: bool):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_output else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.binary(), pa.string()] if with_output else [])]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def join(documents: pa.Table, answers: pa.Table) -> pa.Table:
        documents = documents.filter(pc.is_valid(documents.column("codes")))
        if not len(documents):  # lists, which the other branch reads
            return schema.empty_table()
        in_order = answers.take(np.argsort(answers.column("bucket").to_numpy())) if len(answers) else answers
        of_words = [w for data in in_order.column("word_ids") for w in unpack_strings(data.as_py())]
        lengths = np.fromiter(map(len, of_words), np.int64, len(of_words)) // 4
        flat = np.frombuffer(b"".join(of_words), "<u4")
        first = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        decoded = np.empty(len(of_words), object)
        decoded[:] = decode_words(flat, lengths, tokenizer)
        rows: list[tuple] = []
        for packed in documents.column("codes"):
            codes = unpack_codes(packed.as_py())
            n = lengths[codes]
            total = int(n.sum())
            at = np.repeat(first[codes] - (np.cumsum(n) - n), n) + np.arange(total)
            encoded = flat[at].tobytes()
            plain = b" ".join([x for x in decoded[codes].tolist() if x])
            row = (total, hashlib.sha256(encoded).hexdigest(), hashlib.sha256(plain).hexdigest())
            rows.append((*row, encoded, plain.decode()) if with_output else row)
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds[1:])]
        del rows, of_words, decoded, flat, first, lengths, in_order
        give_back()
        return pa.Table.from_arrays([documents.column("doc_id"), *columns], schema=schema)

    return join


def encode_decode(docs: DataFrame, tokenizer: str = TOKENIZER, with_output: bool = False, block_bytes: int = BLOCK_BYTES, n_buckets: int | None = None) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens and digests of ids and decoded text; with_output adds both
    themselves (ids as little-endian 32-bit integers)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = n_buckets or min(MOST_BUCKETS, size // BUCKET_BYTES + 1)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * (size // BLOCK_BYTES))
    blocks = texts.select("doc_id", F.split("text", SPACE).alias("words")).mapInArrow(_blocks(block_bytes, n_buckets), BLOCKS)
    # all rows and columns go on in both branches: the exchange is then the same, and is made once
    dealt = blocks.repartition(n, "block")
    answers = dealt.sortWithinPartitions("block").mapInArrow(_encode_buckets(tokenizer), "answered long, bucket long, word_ids binary").repartition(n, "answered")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_output
    return dealt.groupBy("block").cogroup(answers.groupBy("answered")).applyInArrow(_join_back(tokenizer, with_output), schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
