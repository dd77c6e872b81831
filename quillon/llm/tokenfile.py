"""Token-id files with a shared zstandard dictionary (operator 6).

A shard holds documents one after another, each its own zstandard frame over little-endian ids, made with one
dictionary for all shards. The head names the dictionary's SHA-256; an index of document ids, offsets and id
counts ends the file, so one short document is read with two small ranged reads.

    head   8 bytes magic, 4 bytes version, 4 bytes id width, 32 bytes dictionary SHA-256
    body   zstandard frames
    index  zstandard frame of: int64 doc ids, then uint64 offsets (one more than documents), then uint64 id counts
    tail   uint64 index offset, uint64 documents, uint32 crc32 of the index frame, 8 bytes magic
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytelevel import chunks, text_buffer
from .packing import encoder
from .shared import scratch, ship, smallest

MAGIC = b"QUILTOK1"
END_ID = 2
LEVEL = 3
#: The dictionary is trained on at most this many documents, those with the smallest hash of their id, and on
#: at most SAMPLE_IDS ids of each. It decides how well ids are compressed and never what is read back.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES, LEAST_DICTIONARY = 1000, 4096, 64 << 10, 512


class ShardWriter:
    """Writes one shard to a binary stream; holds the index only."""

    def __init__(self, stream, dictionary: bytes, width: int):
        self.stream, self.dtype = stream, np.dtype(f"<u{width}")
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        self.docs, self.counts, self.offsets = [], [], []
        head = MAGIC + struct.pack("<II", 1, width) + hashlib.sha256(dictionary).digest()
        stream.write(head)
        self.at = len(head)
        self.offsets.append(self.at)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        frame = self.compressor.compress(ids.astype(self.dtype).tobytes())
        self.stream.write(frame)
        self.at += len(frame)
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.offsets.append(self.at)

    def close(self) -> None:
        index = zstandard.ZstdCompressor(level=LEVEL).compress(np.array(self.docs, "<i8").tobytes() + np.array(self.offsets, "<u8").tobytes() + np.array(self.counts, "<u8").tobytes())
        self.stream.write(index)
        self.stream.write(struct.pack("<QQI", self.at, len(self.docs), zlib.crc32(index)) + MAGIC)


class ShardReader:
    """Reads a shard from a seekable file: any document by its place, or all in order."""

    def __init__(self, file, dictionary: bytes):
        self.file = file
        file.seek(0)
        head = file.read(48)
        version, width = struct.unpack("<II", head[8:16])
        if head[:8] != MAGIC or version != 1:
            raise ValueError("not a token-id shard")
        if head[16:48] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.dtype = np.dtype(f"<u{width}")
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        size = file.size()
        file.seek(size - 28)
        tail = file.read(28)
        at, docs, crc = struct.unpack("<QQI", tail[:20])
        if tail[20:] != MAGIC:
            raise ValueError("the shard is cut short")
        file.seek(at)
        packed = file.read(size - 28 - at)
        if zlib.crc32(packed) != crc:
            raise ValueError("the index is damaged")
        index = zstandard.ZstdDecompressor().decompress(packed)
        self.docs = np.frombuffer(index, "<i8", docs)
        self.offsets = np.frombuffer(index, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.counts = np.frombuffer(index, "<u8", docs, 8 * (2 * docs + 1)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.docs)

    def _ids(self, frame: bytes, k: int) -> np.ndarray:
        ids = np.frombuffer(self.decompressor.decompress(frame), self.dtype).astype(np.uint32)
        if len(ids) != self.counts[k]:
            raise ValueError(f"document {self.docs[k]} has {len(ids)} ids, its index {self.counts[k]}")
        return ids

    def read(self, k: int) -> np.ndarray:
        self.file.seek(int(self.offsets[k]))
        return self._ids(self.file.read(int(self.offsets[k + 1] - self.offsets[k])), k)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        begin = 0
        while begin < len(self.docs):
            end = max(begin + 1, int(np.searchsorted(self.offsets, self.offsets[begin] + (4 << 20), side="right")) - 1)
            self.file.seek(int(self.offsets[begin]))
            block = self.file.read(int(self.offsets[end] - self.offsets[begin]))
            for k in range(begin, end):
                yield int(self.docs[k]), self._ids(block[self.offsets[k] - self.offsets[begin] : self.offsets[k + 1] - self.offsets[begin]], k)
            begin = end


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary trained on the serialized ids of the bounded sample.

    It has an eighth of the sample's size, DICTIONARY_BYTES at most. A small sample is repeated, as training asks for
    several times the dictionary's size; where it still finds no segment worth keeping (a few short documents, or none with text),
    the sample itself is the dictionary, as raw content. So there is one at every size, and its hash is in every shard.
    """
    sample = smallest(docs.where("text is not null").select("doc_id", "text"), F.xxhash64("doc_id"), SAMPLE_DOCS).select(F.substring("text", 1, 4 * SAMPLE_IDS).alias("text")).toArrow()
    data, offsets = text_buffer(sample["text"])
    samples = []
    for low, high in chunks(offsets):
        got = encoder(path).encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        samples += [np.append(got.ids[a : min(b, a + SAMPLE_IDS)], end_id).astype("<u2").tobytes() for a, b in zip(got.offsets, got.offsets[1:], strict=False)]
    total = sum(map(len, samples))
    size = min(DICTIONARY_BYTES, max(LEAST_DICTIONARY, total // 8))
    repeats = max(1, -(-8 * size // max(1, total)), -(-16 // max(1, len(samples))))
    try:
        return zstandard.train_dictionary(size, samples * repeats).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) + np.full(8, end_id, "<u2").tobytes())[:size]


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> tuple[list[tuple[str, int, int]], bytes]:
    """Encode all texts and write shards to ``folder`` in ascending doc_id order over the shards.

    Returns (file, documents, ids) of each shard in order and the dictionary. Equal doc_ids keep the order of
    their texts; null texts are empty, so that their document is the end id alone; null doc_ids come first, stored
    as the least 64-bit integer. A task writes to a name of its own attempt and moves the whole file into place, so
    that a lost executor leaves no partial shard.
    """
    ship(docs.sparkSession)
    dictionary = train_dictionary(docs, path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        number = TaskContext.get().partitionId()
        final, own = f"{root}/shard-{number:06d}.qtok", f"{root}/.shard-{number:06d}-{uuid.uuid4().hex}"
        codec, total = encoder(path), 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(own, compression=None) as stream:
            writer = ShardWriter(stream, dictionary, 2)
            for batch in batches:
                data, offsets = text_buffer(batch.column(1))
                keys = batch.column(0).to_pylist()
                for low, high in chunks(offsets):
                    got = codec.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    for i in range(high - low):
                        ids = np.append(got.ids[got.offsets[i] : got.offsets[i + 1]], np.uint32(end_id))
                        writer.add(-(1 << 63) if keys[low + i] is None else keys[low + i], ids)
                        total += len(ids)
            writer.close()
        fs.move(own, final)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "file": [final], "docs": pa.array([len(writer.docs)], pa.int64()), "ids": pa.array([total], pa.int64())})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = ordered.mapInArrow(run, "shard long, file string, docs long, ids long").collect()  # one row a shard
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zstd", compression=None) as out:
        out.write(dictionary)
    return [(r["file"], r["docs"], r["ids"]) for r in sorted(manifest)], dictionary


def read_token_files(spark: SparkSession, shards: list[tuple[str, int, int]], folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, on request, ids, from the shards."""
    ship(spark)
    rows, before = [], 0
    for file, docs, ids in shards:
        if docs:
            rows.append((file, before))
        before += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{root}/dictionary.zstd", compression=None) as f:
            dictionary = f.read()
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(file) as f:
                    reader = ShardReader(f, dictionary)
                    out = ([], [], [], [], [])
                    for doc, ids in reader:
                        values = (None if doc == -(1 << 63) else doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if with_ids else None)
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                        start += len(ids)
                        if len(out[0]) == 4096:
                            yield _batch(out, with_ids)
                            out = ([], [], [], [], [])
                    if out[0]:
                        yield _batch(out, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows))).mapInArrow(run, schema)


def _batch(out: tuple[list, ...], with_ids: bool) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in out[:4]]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        columns.append(pa.array(out[4], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back.

    No documents give no rows. Repeated rows are documents each. A document is encoded and compressed whole, so a very long one
    needs memory in proportion. Null doc_ids come back null; the least 64-bit integer stands for them in a shard and is no id.
    Columns beside doc_id and text are not read.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    shards, _ = write_token_files(docs, path, folder)
    return read_token_files(spark, shards, folder)
