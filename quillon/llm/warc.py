"""WARC archives: written with one gzip member per record, read back sequentially (operator 8).

Records of equal payloads are written once: the one with the largest page id as ``response``, the others as
``revisit`` records that refer to it (identical-payload-digest profile) and hold no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, ship

#: Payloads under this many bytes are always written whole.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # pages have no time of their own; a constant keeps archives reproducible
BLOCK = 1 << 16
SALTS = 32  # parts that the ids of one payload are dealt to


def base32_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    text = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", base32_digest(payload)), ("WARC-Block-Digest", base32_digest(block))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head.append(("Content-Length", str(len(block))))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """The HTTP header fields and what follows them."""
        head, _, rest = self.block.partition(b"\r\n\r\n")
        return _fields(head.split(b"\r\n")[1:]), rest


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError(f"a header line without a colon: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def members(stream) -> Iterator[bytearray]:
    """The content of each gzip member of ``stream``, read in small blocks; memory holds one member."""
    pending = b""
    while True:
        pending = pending or stream.read(BLOCK)
        if not pending:
            return
        unpack, content = zlib.decompressobj(31), bytearray()
        while not unpack.eof:
            content += unpack.decompress(pending)
            pending = unpack.unused_data
            if not unpack.eof:
                pending = stream.read(BLOCK)
                if not pending:
                    raise ValueError("the archive ends within a record")
        yield content


def records(stream) -> Iterator[Record]:
    """The records of an archive in order. Wrong framing or a digest that differs is an error, never skipped."""
    for content in members(stream):
        end = content.find(b"\r\n\r\n")
        lines = bytes(content[: max(end, 0)]).split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/1."):
            raise ValueError("a member doesn't begin with a WARC header")
        headers = _fields(lines[1:])
        length = int(headers["content-length"])
        block = bytes(content[end + 4 : end + 4 + length])
        if len(block) != length or bytes(content[end + 4 + length :]) != b"\r\n\r\n":
            raise ValueError(f"{headers.get('warc-record-id')}: its length isn't {length}")
        found = Record(headers, block)
        if headers.get("warc-block-digest", base32_digest(block)) != base32_digest(block):
            raise ValueError(f"{headers.get('warc-record-id')}: its block digest differs")
        if headers["warc-type"] == "response":
            http, payload = found.http()
            if headers.get("warc-payload-digest") != base32_digest(payload) or int(http.get("content-length", len(payload))) != len(payload):
                raise ValueError(f"{headers.get('warc-record-id')}: its payload digest differs")
        yield found


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html ('' for null) and refers_to: the largest page_id with the same payload, if it is another.

    Only ids and digests are grouped; the count of a hot payload is made map-side. The ids of a payload then meet its
    largest one by (digest, salt), where the salt comes from the id, so no task receives all ids of a hot payload; what is
    joined to the pages is keyed by page_id.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = base.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"))
    last = keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least")).where("_least < refers_to").drop("_least")
    salted = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"]).where("page_id < refers_to").groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("digest", "refers_to"))).alias("_to"))
    joined = base.join(revisits, "page_id", "left")
    refers = F.when(F.col("_to").isNotNull() & (F.octet_length("html") >= REVISIT_BYTES), F.try_element_at("_to", F.sha1(F.encode("html", "UTF-8"))))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> list[str]:
    """Write ``pages`` (as with_revisits gives them) to archives, one per partition; returns their files.

    Each attempt writes to its own name and moves the whole archive into place.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        number = TaskContext.get().partitionId()
        final, own, many = f"{root}/pages-{number:06d}.warc.gz", f"{root}/.pages-{number:06d}-{uuid.uuid4().hex}", 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(record("response" if refers_to is None else "revisit", page_id, url, html.encode(), refers_to))
                    many += 1
        fs.move(own, final)
        yield pa.RecordBatch.from_pydict({"file": [final], "records": pa.array([many], pa.int64())})

    return sorted(r["file"] for r in pages.mapInArrow(run, "file string, records long").collect() if r["records"])  # one row an archive


def read_archives(spark: SparkSession, files: list[str], folder: str, with_html: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to and, on request, url and html of responses."""
    ship(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "html"] * with_html
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string(), pa.string()] * with_html

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(file, compression=None) as stream:
                    for r in records(stream):
                        h, (http, payload) = r.headers, r.http()
                        kind = h["warc-type"]
                        row = [page_of(h["warc-record-id"]), int(http["content-length"]), base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex(), kind, page_of(h["warc-refers-to"]) if kind == "revisit" else None]
                        rows.append(row + ([h["warc-target-uri"], payload.decode() if kind == "response" else None] if with_html else []))
                        if len(rows) == 2048:
                            yield _rows(rows, names, kinds)
                            rows = []
                if rows:
                    yield _rows(rows, names, kinds)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, html string" * with_html
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files))).mapInArrow(run, ddl)


def _rows(rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back.

    Null html is an empty payload, null urls become about:blank, a null page_id is kept. Rows that share both
    the largest page_id and the payload are all responses. An empty table gives no rows. A record is held whole, so a very
    long payload needs memory in proportion. Columns beside page_id, url and html are not read.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    return read_archives(spark, write_archives(with_revisits(pages), folder), folder)
