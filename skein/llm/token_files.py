"""Token-ID files: encoded documents in id order, range-coded in checksummed blocks.

A file holds a header, an index (doc ids and lengths, zlib with a CRC), a table of blocks
(ids, bytes, CRC of the bytes, CRC of the ids) and the blocks' payloads.  Every block is
coded on its own, so a damaged one is found and costs no other.

Documents are dealt by ranges of doc_id, so files in the order of their names hold all
documents in ascending order.  Executors write them through a name of their own and move
them into place when whole: a task that runs twice leaves one file.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; equal
doc_ids are ordered by their texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import new_path, small_batches
from skein.llm.range_coder import BLOCK, checksum, decode_blocks, encode_blocks
from skein.llm.tokens import chunks, encoder, tokenizer_path

MAGIC = b"SKNIDS1\n"
END_ID = 1
#: Ids after which a writer begins its next file: bounds memory and a file's rows.
FILE_IDS = 8 << 20
#: Bytes of text that are encoded at once: a batch mostly, so known pieces are looked through once for it.
ENCODED = 8 << 20
_HEAD = struct.Struct("<8sQQIIIIII")  # magic, docs, ids, vocabulary, block, blocks, index bytes, index CRC, table CRC


class DamagedFile(ValueError):
    """A checksum or a size does not fit."""


def pack_file(doc_ids: list[str | None], lengths: np.ndarray, ids: np.ndarray, vocab: int) -> bytes:
    """The bytes of one file; ``lengths`` are ids of each document, in the order of ``ids``."""
    names = json.dumps(doc_ids, separators=(",", ":")).encode()
    index = zlib.compress(struct.pack("<I", len(names)) + names + np.asarray(lengths, "<u4").tobytes(), 1)
    payloads = encode_blocks(ids, vocab)
    rows = [(len(ids[i * BLOCK : (i + 1) * BLOCK]), len(p), zlib.crc32(p), checksum(ids[i * BLOCK : (i + 1) * BLOCK])) for i, p in enumerate(payloads)]
    table = np.array(rows, "<u4").tobytes()
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), vocab, BLOCK, len(payloads), len(index), zlib.crc32(index), zlib.crc32(table))
    return b"".join([head, index, table, *payloads])


def unpack_file(raw: bytes) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a file; raises DamagedFile where a checksum does not fit."""
    magic, docs, n, vocab, _, blocks, size, index_crc, table_crc = _HEAD.unpack_from(raw)
    at = _HEAD.size
    index, table = raw[at : at + size], raw[at + size : at + size + 16 * blocks]
    if magic != MAGIC or zlib.crc32(index) != index_crc or zlib.crc32(table) != table_crc:
        raise DamagedFile("header or index")
    rows = np.frombuffer(table, "<u4").reshape(-1, 4).astype(np.int64)
    ends = at + size + 16 * blocks + np.cumsum(rows[:, 1])
    payloads = [raw[e - k : e] for e, k in zip(ends.tolist(), rows[:, 1].tolist(), strict=True)]
    for i, p in enumerate(payloads):
        if zlib.crc32(p) != rows[i, 2]:
            raise DamagedFile(f"block {i}")
    ids = decode_blocks(payloads, rows[:, 0], vocab)
    if any(checksum(x) != c for x, c in zip(np.split(ids, np.cumsum(rows[:-1, 0])) if blocks else [], rows[:, 3].tolist(), strict=True)) or len(ids) != n:
        raise DamagedFile("ids")
    plain = zlib.decompress(index)
    (size,) = struct.unpack_from("<I", plain)
    return json.loads(plain[4 : 4 + size]), np.frombuffer(plain, "<u4", docs, 4 + size).astype(np.int64), ids


def _place(folder: str, name: str, raw: bytes) -> None:
    """Writes a file whole or not at all, to any store that pyarrow knows."""
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(folder)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(raw)
    fs.move(own, f"{root}/{name}")


def _write(folder: str, path: str, kind: str):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, number = encoder(kind, path), TaskContext.get().partitionId(), 0
        names: list[str | None] = []
        parts: list[np.ndarray] = []  # a document's ids without the end id
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
            ids = np.full(int(lengths.sum()), END_ID, np.uint32)
            inside = np.ones(len(ids), bool)
            inside[np.cumsum(lengths) - 1] = False
            ids[inside] = np.concatenate(parts)
            file = f"part-{part:06d}-{number:06d}.ids"
            _place(folder, file, pack_file(names, lengths, ids, e.vocab))
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([file]), pa.array([len(names)]), pa.array([int(lengths.sum())])], names=["part", "number", "file", "n_docs", "n_ids"])
            names.clear()
            parts.clear()
            held, number = 0, number + 1
            return row

        for b in batches:
            own = b.column("doc_id").to_pylist()
            for at, texts in chunks(b.column("text"), ENCODED):
                ids, starts, counts = e.encode(texts)
                for i, (start, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
                    names.append(own[at + i])
                    parts.append(ids[start : start + n])
                    held += n + 1
                    if held >= FILE_IDS:
                        yield flush()
        if names:
            yield flush()

    return written


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, kind: str = "word") -> DataFrame:
    """Writes the files into ``folder``; gives their table: part, number, file, n_docs, n_ids (stored beside them)."""
    spark = docs.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ids")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = ordered.mapInArrow(_write(f"{folder}/ids", tokenizer or tokenizer_path("word_bpe_49k.json"), kind), "part long, number long, file string, n_docs long, n_ids long")
    with small_batches(spark):
        made.write.parquet(f"{folder}/files")
    return spark.read.schema(made.schema).parquet(f"{folder}/files")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for base, raw in zip(b["base"], b["content"], strict=True):
            names, lengths, ids = unpack_file(raw)
            data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
            starts = ends - lengths
            crcs = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": names, "start": starts + base, "n_tokens": lengths, "ids_crc32": np.array(crcs, np.int64)})


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (string), start, n_tokens, ids_crc32 of every document, from the files alone."""
    files = spark.read.schema("part long, number long, file string, n_docs long, n_ids long").parquet(f"{folder}/files")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", none(F.sum("n").over(ahead(Window.orderBy("part")))).alias("before"))
    inside = none(F.sum("n_ids").over(ahead(Window.partitionBy("part").orderBy("number"))))
    base = files.select("part", "file", inside.alias("inside")).join(parts, "part").select("file", (F.col("inside") + F.col("before")).alias("base"))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(f"{folder}/ids")
    raw = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return raw.join(base, "file").select("base", "content").mapInPandas(_read, "doc_id string, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Contract rows: written, then read back."""
    folder = new_path(docs.sparkSession, "token-files")
    write(docs, folder)
    return read(docs.sparkSession, folder).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
