r"""Token ids in files of single compressed documents that share one zstandard dictionary, with an index of offsets.

A store is a folder: `dictionary` (a Parquet row: sha256, dictionary, width) and `data`, raw files in ascending doc_id
order. Every part of a file is followed by a line end, which counts in offsets:

    header   b"TKZ1", the dictionary's SHA-256 (32 bytes), the file's number (unsigned 64-bit)
    frames   one per document: its ids, little-endian unsigned of `width` bytes, as a zstandard frame
    index    per document: id, flag (1: the id is null), ids before it in the file, ids, offset, bytes; signed 64-bit
    footer   offset of the index, documents, ids in the file (signed 64-bit), b"TKZ1"

Files go through Spark's writer (a text file whose lines are the parts), so that its commit protocol holds, any of
its file systems will do and a task that is run again leaves nothing twice. Sequences of a document are found
from the index alone: fetch() reads only the files that hold the asked documents and slices their frames out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialize, release, small_batches
from .packing import ChunkTokenizer, parts

_MAGIC = b"TKZ1"
_HEADER, _ENTRY, _FOOTER = "<4s32sQ", "<6q", "<3q4s"
#: Text of a file, in bytes: what a task holds beside it is its index.
FILE_BYTES = 32 << 20
#: The dictionary is trained on blocks of ids, one each of about so many documents.
SAMPLE_DOCUMENTS, SAMPLE_IDS, DICTIONARY_BYTES = 2048, 1024, 64 << 10
_TOKENIZERS: dict[tuple, ChunkTokenizer] = {}


def _tokenizer(path: str | None) -> ChunkTokenizer:
    """One per Python worker, kept from task to task."""
    return _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, ChunkTokenizer(path))


def _ids(ids: np.ndarray, end_id: int, width: int) -> bytes:
    return np.append(ids, end_id).astype(f"<u{width}").tobytes()


def train(rows: DataFrame, *, tokenizer_path: str | None, end_id: int, width: int, documents: int = SAMPLE_DOCUMENTS) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES from at most SAMPLE_IDS consecutive ids of each of about `documents` documents.

    rows: doc_id, text. Which documents, and where in them, is told by digests; a document is as likely as any other.
    Too few or too short samples give an empty dictionary, which is none.
    """
    import zstandard

    total = rows.count()
    pick = F.xxhash64("doc_id", F.monotonically_increasing_id())
    sample = rows if total <= documents else rows.where(F.pmod(pick, F.lit(1 << 30)) < int((1 << 30) * documents / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            found = []
            for ids in tokenizer.encode(batch.column(1).to_pylist()):
                block = zlib.crc32(ids.tobytes()) % (len(ids) // SAMPLE_IDS + 1)
                found.append(_ids(ids, end_id, width)[block * SAMPLE_IDS * width : (block + 1) * SAMPLE_IDS * width])
            yield pa.RecordBatch.from_pydict({"block": pa.array(found, pa.binary())})
        tokenizer.trim()
        release()

    blocks = sorted(r[0] for r in sample.mapInArrow(run, "block binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [b for b in blocks if b]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b""


def write_store(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, end_id: int = 1, level: int = 3, file_bytes: int = FILE_BYTES, width: int | None = None) -> None:
    """Writes the ids of all texts, each followed by end_id, in ascending doc_id order (nulls first).

    Null text: end_id alone. Repeated rows are stored once each; rows of one doc_id come by a digest of their texts.
    A doc_id with very many rows is dealt over several files. Other columns are ignored; an empty table gives files
    without documents.
    """
    import zstandard

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    width = width or (2 if max(_tokenizer(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
    dictionary = train(rows, tokenizer_path=tokenizer_path, end_id=end_id, width=width)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary), width)], "sha256 string, dictionary binary, width int").write.parquet(f"{path}/dictionary")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", "_tie", "_pin"]
    dealt = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_pin", F.monotonically_increasing_id()).repartitionByRange(size // file_bytes + 1, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(tokenizer_path), zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=known)
        head = struct.pack(_HEADER, _MAGIC, digest, TaskContext.get().partitionId())
        index, offset, before = [], len(head) + 1, 0
        yield pa.RecordBatch.from_pydict({"part": pa.array([head], pa.binary())})
        for batch in batches:
            for part in map(pa.RecordBatch.to_pydict, parts(batch)):
                frames = []
                for doc, ids in zip(part["doc_id"], tokenizer.encode(part["text"]), strict=True):
                    frame, n = press.compress(_ids(ids, end_id, width)), len(ids) + 1
                    index.append(struct.pack(_ENTRY, doc or 0, doc is None, before, n, offset, len(frame)))
                    before, offset = before + n, offset + len(frame) + 1
                    frames.append(frame)
                yield pa.RecordBatch.from_pydict({"part": pa.array(frames, pa.binary())})
        yield pa.RecordBatch.from_pydict({"part": pa.array([b"".join(index), struct.pack(_FOOTER, offset, len(index), before, _MAGIC)], pa.binary())})
        tokenizer.trim()
        release()

    with small_batches(spark, 2048):
        dealt.select("doc_id", "text").mapInArrow(run, "part binary").select(F.col("part").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, bytes, int]:
    found = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(found["dictionary"]).hexdigest() != found["sha256"]:
        raise ValueError(f"damaged dictionary in {path}")
    return bytes(found["dictionary"]), bytes.fromhex(found["sha256"]), found["width"]


def _parse(content: bytes, digest: bytes) -> tuple[int, np.ndarray]:
    """A file's number and its index: one row of six numbers per document."""
    magic, used, number = struct.unpack_from(_HEADER, content)
    at, documents, total, end = struct.unpack_from(_FOOTER, content, len(content) - struct.calcsize(_FOOTER) - 1)
    if magic != _MAGIC or end != _MAGIC or used != digest:
        raise ValueError("no file of this store, or one of another dictionary")
    index = np.frombuffer(content, dtype="<i8", count=documents * 6, offset=at).reshape(-1, 6)
    if index[:, 3].sum() != total:
        raise ValueError("damaged index")
    return number, index


def _unpack(frames: list[bytes], dictionary: bytes, width: int) -> list[np.ndarray]:
    import zstandard

    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return [np.frombuffer(press.decompress(f), dtype=f"<u{width}").astype("<u4") for f in frames]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, file, offset, bytes of every document, from the files' indexes alone; start counts the ids of all documents before it."""
    _, digest, _ = _dictionary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number, x = _parse(content.as_buffer(), digest)
                columns = {c: pa.array(x[:, k], pa.int64()) for c, k in (("start", 2), ("n_tokens", 3), ("offset", 4), ("bytes", 5))}
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(x[:, 0], pa.int64(), mask=x[:, 1] == 1), "number": pa.array(np.full(len(x), number), pa.int64()), "file": pa.array([name] * len(x), pa.string())} | columns)

    with small_batches(spark, 1):
        rows = materialize(_files(spark, path).select("path", "content").mapInArrow(run, "doc_id long, number long, file string, start long, n_tokens long, offset long, bytes long"), "token-index")
    return _placed(rows)


def _placed(rows: DataFrame) -> DataFrame:
    """rows of written files with start counted over all files before, which are one row each in the running sum."""
    files = rows.groupBy("number").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(files.select("number", before.alias("before")), "number").withColumn("start", F.col("start") + F.col("before")).drop("before", "number")


def read_store(spark: SparkSession, path: str, *, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store, from its decompressed frames; ids: also them, as array<long>."""
    dictionary, digest, width = _dictionary(spark, path)
    schema = "doc_id long, number long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                content = content.as_buffer()
                number, index = _parse(content, digest)
                for k in range(0, len(index), 512):
                    x = index[k : k + 512]
                    found = _unpack([content[a : a + n] for a, n in x[:, 4:].tolist()], dictionary, width)
                    if any(len(f) != n for f, n in zip(found, x[:, 3].tolist(), strict=True)):
                        raise ValueError("damaged frame")
                    columns = {"doc_id": pa.array(x[:, 0], pa.int64(), mask=x[:, 1] == 1), "number": pa.array(np.full(len(x), number), pa.int64()), "start": pa.array(x[:, 2], pa.int64()), "n_tokens": pa.array([len(f) for f in found], pa.int64()), "ids_crc32": pa.array([zlib.crc32(f.tobytes()) for f in found], pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))} if ids else {}))
        release()

    with small_batches(spark, 1):
        rows = materialize(_files(spark, path).select("content").mapInArrow(run, schema), "token-rows")
    return _placed(rows)


def fetch(spark: SparkSession, path: str, doc_ids: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """doc_id, start, ids (array<long>) of the asked documents (column doc_id): their files are read, and of those their frames alone are decompressed."""
    dictionary, _, width = _dictionary(spark, path)
    asked = (index or read_index(spark, path)).join(doc_ids.select("doc_id").distinct(), "doc_id")
    frames = asked.join(_files(spark, path).select(F.col("path").alias("file"), "content"), "file")
    frames = frames.select("doc_id", "start", F.substring("content", F.col("offset") + 1, F.col("bytes")).alias("frame"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _unpack(batch.column(2).to_pylist(), dictionary, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return frames.mapInArrow(run, "doc_id long, start long, ids array<long>")


def store_path(folder: str) -> str:
    return f"{folder}/evidentia-tokens-{uuid.uuid4().hex}"
