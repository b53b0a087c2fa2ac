"""A deterministic sharded WARC writer, and its reader.

Records are sorted by page_id into shards of near equal payload, told by a histogram of id ranges,
so that the same pages always make the same files. Each task streams its shards: it compresses every
record as a gzip member of its own, begins a new file when the current one would pass ``roll_bytes``
of compressed size, and makes headers, dates and digests anew. A file is written under a temporary
name and renamed when whole; the list of files, with sizes and SHA-256, is a manifest that Spark
commits last, and readers read only what it lists. A task that runs again writes the same bytes to
the same names.

Of records with equal payloads of at least ``revisit_bytes`` that with the largest page_id is a
response, the others revisit it and carry no payload. Which these are is told from digests alone and
joins the sorted stream as rows of its own, so that payloads are shuffled once, evenly.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrolith.llm._common import cut, sized

SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs
BLOCKS = 64


def _id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{digest}')}>"


def _member(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with one record."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()), ("Content-Length", str(len(block)))]
    said = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(said.encode() + block + b"\r\n\r\n") + packer.flush()


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to) -> bytes:
    """The member of one page; ``refers_to``: (page_id,) of the response it revisits, or None."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    fields = [("X-Page-Id", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        fields.insert(0, ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if refers_to is None:
        return _member("response", _id(page_id, digest), fields, http + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(refers_to[0], digest)), ("X-Refers-To-Page", str(refers_to[0]))]
    return _member("revisit", _id(page_id, digest), fields, http)


class _Roller:
    """The current file of a shard."""

    def __init__(self, out: str, roll_bytes: int):
        self.fs, self.path = pafs.FileSystem.from_uri(out)
        self.roll, self.shard, self.seq, self.file = roll_bytes, None, 0, None

    def add(self, shard: int, member: bytes) -> Iterator[tuple]:
        if shard != self.shard or self.size + len(member) > self.roll:
            yield from self.close()
            self.seq = self.seq + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sha = shard, 0, 0, hashlib.sha256()
            self.name = f"shard-{shard:06d}-{self.seq:05d}.warc.gz"
            self.spare = f"{self.path}/_temporary-{uuid.uuid4().hex}-{self.name}"
            self.file = self.fs.open_output_stream(self.spare, compression=None)
            said = f"software: ferrolith\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
            self._write(_member("warcinfo", f"<urn:uuid:{uuid.uuid5(SPACE, self.name)}>", [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], said))
        self._write(member)
        self.records += 1

    def _write(self, member: bytes) -> None:
        self.file.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> Iterator[tuple]:
        if self.file is not None:
            self.file.close()
            self.fs.move(self.spare, f"{self.path}/{self.name}")
            self.file = None
            yield self.name, self.shard, self.records, self.size, self.sha.hexdigest()


def roles(narrow: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, top): the pages with an equal, and the largest id among these."""
    same = narrow.where(F.col("n_bytes") >= revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select(F.col("sha1").alias("s"), "top")
    return narrow.join(sized(cut(same)), F.col("sha1") == F.col("s")).select("page_id", "sha1", "top").distinct()


def write_archives(pages: DataFrame, out: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to the folder ``out``; return the manifest.

    A null html is an empty payload; a null page_id sorts first and is never referred to; of rows
    that repeat id and payload the first is the response, if any is. An empty table writes no file.
    """
    spark = pages.sparkSession
    fs, path = pafs.FileSystem.from_uri(out)
    fs.create_dir(path, recursive=True)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    narrow = cut(source.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes")))
    told = narrow.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.sum(F.col("n_bytes") + 256).alias("b")).first()
    lo, hi, total = int(told.lo or 0), int(told.hi or 0), int(told.b or 0)
    shards = max(1, math.ceil(total / shard_bytes))
    width = max(1, -(-(hi - lo + 1) // (shards * BLOCKS)))
    block = F.coalesce(F.floor((F.col("page_id") - lo) / width), F.lit(0)).cast("long")
    tally = narrow.groupBy(block.alias("b")).agg(F.sum(F.col("n_bytes") + 256).alias("n"))  # at most BLOCKS * shards rows
    start = F.sum("n").over(Window.orderBy("b")) - F.col("n")
    dealt = cut(tally.select("b", F.least(F.lit(shards - 1), F.floor(start * shards / max(total, 1))).cast("int").alias("shard")))
    rows = source.select("page_id", F.lit(1).alias("kind"), F.sha1("payload").alias("sha1"), "url", "payload", F.lit(None).cast("long").alias("top"))
    marks = roles(narrow, revisit_bytes).select("page_id", F.lit(0).alias("kind"), "sha1", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("top").cast("long").alias("top"))
    both = rows.unionByName(marks).withColumn("b", block).join(sized(dealt), "b").drop("b")
    # a shard is a partition, whatever a sample would say; equal ids meet in one shard, marks before pages
    both = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "sha1", "kind", "url").select("shard", "page_id", "kind", "sha1", "url", "payload", "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, mark, before, made = _Roller(out, roll_bytes), None, None, []
        for b in batches:
            for shard, page_id, kind, sha1, url, data, top in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    mark = (page_id, sha1, top)
                    continue
                revisit = mark is not None and mark[:2] == (page_id, sha1) and (page_id != mark[2] or before == (page_id, sha1))
                before = (page_id, sha1)
                made += roller.add(shard, record(page_id, url, data, sha1, (mark[2],) if revisit else None))
        made += roller.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["file", "shard", "records", "bytes", "sha256"])

    both.mapInArrow(run, "file string, shard int, records long, bytes long, sha256 string").write.mode("overwrite").json(f"{out}/_manifest")
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("file string, shard int, records long, bytes long, sha256 string").json(f"{out}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one at a time."""
    data, unpack, out = b"", zlib.decompressobj(31), []
    while True:
        if not data and not (data := stream.read(1 << 20)):
            return
        out.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            data = unpack.unused_data
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block; the block's digest is verified."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["warc-block-digest"]:
        raise ValueError(f"the block of {fields['warc-record-id']} is damaged")
    return fields, block


def read_archives(spark: SparkSession, out: str, payloads: bool = False) -> DataFrame:
    """A row for each page record of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, file[, payload]."""
    listed = read_manifest(spark, out)
    files = listed.select("file").repartition(max(1, min(listed.count(), 10_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(out)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    made, held = [], 0
                    for member in members(stream):
                        fields, block = parse(member)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        data, digest = block.partition(b"\r\n\r\n")[2], fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and (base64.b32encode(hashlib.sha1(data).digest()).decode() != digest or len(data) != int(fields["x-payload-length"])):
                            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                        refers = fields.get("x-refers-to-page")
                        made.append((int(fields["x-page-id"]) if fields["x-page-id"] else None, fields.get("warc-target-uri"), int(fields["x-payload-length"]), digest, fields["warc-type"], refers and int(refers), name, data if payloads and fields["warc-type"] == "response" else None))
                        held += len(data) if payloads else 200
                        if held > 8 << 20:
                            yield batch(made)
                            made, held = [], 0
                    if made:
                        yield batch(made)

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "payload"]
    batch = lambda made: pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)], names)
    got = files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, payload binary")
    return got if payloads else got.drop("payload")
