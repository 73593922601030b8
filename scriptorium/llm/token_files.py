"""Transcripts as token ids in binary files with a shared zstandard dictionary.

A store is a folder: ``dictionary`` (one row: dict_hash, dictionary), ``blocks`` (documents
in ascending order of id, file by file) and ``files`` (ids before each file). A block row
holds the frames of up to ``BLOCK_DOCS`` documents, one behind the other, and the index to
them: ids of documents, offsets of frames, numbers of tokens. Parquet is the container, so
any file system that Spark reaches will do, and readers prune blocks by id.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import slices, word_encoder

BLOCK_DOCS, BLOCK_BYTES = 1024, 1 << 20
MAX_FILES = 10_000  # a larger store has larger files
BLOCKS = (
    "file int, block int, first_doc bigint, last_doc bigint, start bigint, tokens bigint, width int, dict_hash string, "
    "docs array<bigint>, offsets array<int>, lengths array<int>, payload binary"
)


def serialize(ids: bytes, width: int) -> bytes:
    """Ids as little-endian integers of ``width`` bytes."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def restore(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train_dictionary(
    jobs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "raw_text", end_id: int = 0, sample: int = 1000, size: int = 64 << 10,
) -> tuple[bytes, int]:
    """Dictionary, and bytes an id, from whole transcripts of up to 64 KB: at most ``sample`` of them, the lowest hashes of ids.

    Too few or too small samples give an empty dictionary, and frames without one.
    """
    width = 2 if max(word_encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    short = jobs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("raw_text")).filter(F.octet_length("raw_text").between(1, 64 << 10))
    count = short.count()
    share = min(1_000_000, 2_000_000 * sample // max(1, count))
    few = short.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    encode, end = word_encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
    samples = [serialize(encode(row["raw_text"]) + end, width) for row in few.select("raw_text").toLocalIterator()]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes(), width
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"", width


def _borders(jobs: DataFrame, doc_id: str, files: int) -> np.ndarray:
    if files < 2:
        return np.empty(0, np.int64)
    found = jobs.agg(F.percentile_approx(F.col(doc_id).cast("bigint"), [i / files for i in range(1, files)], 20 * files).alias("q")).first()["q"]
    return np.unique(np.array(found or [], np.int64))


def write_token_files(
    jobs: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "raw_text", end_id: int = 0, file_bytes: int = 32 << 20, level: int = 3,
) -> None:
    """Writes the ids of every transcript and ``end_id`` in ascending order of id.

    A null text counts as empty. Rows without id come first; rows with the same id follow
    each other in the order of their frames. A file takes a range of ids with about
    ``file_bytes`` of text; texts are encoded and compressed where they are read, and only
    frames are shuffled.
    """
    spark = jobs.sparkSession
    rows = jobs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("raw_text"))
    dictionary, width = train_dictionary(rows, tokenizer, end_id=end_id)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    total = rows.agg(F.sum(F.octet_length("raw_text").cast("bigint"))).first()[0] or 0
    borders = _borders(rows, "doc_id", min(MAX_FILES, max(1, round(total / file_bytes))))
    end = int(end_id).to_bytes(4, "little")

    def encode(batches):
        words, packer = word_encoder(tokenizer), _packer(dictionary, level)
        for batch in slices(batches):
            docs = batch.column(0)
            ids = [words.encode(t or "") + end for t in batch.column(1).to_pylist()]
            files = np.searchsorted(borders, docs.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right")
            frames = [packer.compress(serialize(i, width)) for i in ids]
            lengths = pa.array([len(i) // 4 for i in ids], pa.int32())
            yield pa.RecordBatch.from_arrays([docs, pa.array(files, pa.int32()), lengths, pa.array(frames, pa.binary())], ["doc_id", "file", "length", "frame"])

    def gather(batches):
        file, number, start, held = 0, 0, 0, ([], [], [])

        def flush():
            nonlocal number, start, held
            docs, lengths, frames = held
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype(np.int32)
            known = [d for d in docs if d is not None]
            values = (file, number, known[0] if known else None, known[-1] if known else None, start, sum(lengths), width, dict_hash, docs, offsets.tolist(), lengths, b"".join(frames))
            number, start, held = number + 1, start + sum(lengths), ([], [], [])
            types = (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        size = 0
        for batch in batches:
            for doc, at, length, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if held[0] and (len(held[0]) == BLOCK_DOCS or size + len(frame) > BLOCK_BYTES):
                    yield flush()
                    size = 0
                file, size = at, size + len(frame)
                for column, value in zip(held, (doc, length, frame)):
                    column.append(value)
        if held[0]:
            yield flush()

    frames = rows.mapInArrow(encode, "doc_id bigint, file int, length int, frame binary")
    placed = frames.repartitionById(len(borders) + 1, F.col("file")).sortWithinPartitions("doc_id", "frame")
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary").write.parquet(f"{path}/dictionary")
    placed.mapInArrow(gather, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    files = spark.read.parquet(f"{path}/blocks").groupBy("file").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    files.select("file", "tokens", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{path}/files")


def _packer(dictionary: bytes, level: int):
    if not dictionary:
        return zstandard.ZstdCompressor(level=level)
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=shared)


def _unpacker(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def read_token_files(spark: SparkSession, path: str, *, docs: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    With ``docs`` only blocks that may hold one of these ids are read, and only their
    frames are decompressed. A block that names another dictionary is an error.
    """
    held = {r["dict_hash"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    blocks, files = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/files")
    wanted = None if docs is None else set(docs)
    if docs is not None:
        blocks = blocks.filter((F.col("first_doc") <= max(docs, default=0)) & (F.col("last_doc") >= min(docs, default=0)))

    def read(batches):
        unpackers = {name: _unpacker(d) for name, d in held.items()}
        for batch in batches:
            for b in batch.to_pylist():
                unpack, at, out = unpackers[b["dict_hash"]], b["before"] + b["start"], []
                for n, (doc, length) in enumerate(zip(b["docs"], b["lengths"])):
                    if wanted is None or doc in wanted:
                        ids = restore(unpack.decompress(b["payload"][b["offsets"][n] : b["offsets"][n + 1]]), b["width"])
                        out.append((doc, at, len(ids) // 4, ids))
                    at += length
                if out:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(files.select("file", "before"), "file").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the ids that were read back."""
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
