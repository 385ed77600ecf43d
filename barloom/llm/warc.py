"""WARC archives: a deterministic sharded writer and a reader, as a Spark data source.

Records are range-sorted by page; a shard's task writes them one gzip member each, rolls to the next file by compressed
size, and computes headers, ids and digests from the payload alone. Files are written under temporary names; the commit
gives them their final names and writes the manifest last. Readers know only files that the manifest names, so tasks
that were tried twice or lost leave nothing to read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegerType

from barloom.llm.common import Scratch, arrow_batches

REVISIT_BYTES = 1000
#: Bytes of records in a range shard, compressed bytes after which a file is closed, and shards at most: beyond that,
#: shards grow and roll into more files, and the list of their first keys stays below 2 MB.
SHARD_BYTES, ROLL_BYTES, MOST_SHARDS = 64 << 20, 16 << 20, 20_000
#: Distinct (page, digest) keys that range bounds are drawn from, chosen by their hash.
SAMPLE_KEYS = 100_000
HEADER_BYTES, LOOKUP_ROWS = 700, 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest.jsonl"
FIELDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
          "record_id string, refers_id string, file string")


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _plain(url: str) -> str:
    """One header line: blanks and control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def _id(*parts: object) -> str:
    """Record id that depends on the record alone."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(parts).encode()).digest()[:16], version=5)}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member without a time stamp: equal records are equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class ArchiveFile:
    """What the manifest says about one file."""
    file: str
    shard: int
    records: int = 0
    bytes: int = 0
    sha256: str = ""
    first: int | None = None
    last: int | None = None


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, ArchiveFile]] = field(default_factory=list)


class _Roller:
    """Files of one task: open, filled, closed when large enough."""

    def __init__(self, folder: str, roll: int, date: str):
        self.fs, self.folder = place(folder)
        self.roll, self.date = roll, date
        self.done: list[tuple[str, ArchiveFile]] = []
        self.stream = None
        self.number = 0

    def record(self, shard: int, page_id: int | None, data: bytes) -> None:
        if self.stream is not None and (shard != self.now.shard or self.now.bytes >= self.roll):
            self.number = self.number + 1 if shard == self.now.shard else 0
            self.close()
        if self.stream is None:
            self._open(shard)
        self._write(data)
        self.now.records += 1
        self.now.first = page_id if self.now.records == 1 else self.now.first
        self.now.last = page_id

    def _open(self, shard: int) -> None:
        name = f"shard-{shard:05d}-{self.number:05d}.warc.gz"
        self.temp = f"{self.folder}/_temporary/{name}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.temp, compression=None)
        self.now, self.digest = ArchiveFile(name, shard), hashlib.sha256()
        self._write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id("warcinfo", name)), ("WARC-Date", self.date), ("WARC-Filename", name),
                             ("Content-Type", "application/warc-fields")], b"software: barloom\r\nformat: WARC File Format 1.1\r\n"))

    def _write(self, data: bytes) -> None:
        member = _member(data)
        self.stream.write(member)
        self.digest.update(member)
        self.now.bytes += len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.now.sha256 = self.digest.hexdigest()
            self.done.append((self.temp, self.now))
            self.stream = None


class WarcWriter(DataSourceArrowWriter):
    """Writes rows sorted by shard and key (see ``archive``)."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.date = options["path"], options["date"]
        self.roll = int(options.get("roll_bytes", ROLL_BYTES))
        files, path = place(self.folder)
        if files.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.folder} holds a committed archive")
        files.create_dir(f"{path}/_temporary", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, seen, repeat = _Roller(self.folder, self.roll, self.date), None, 0
        for batch in iterator:
            names = batch.schema.names
            for i in range(batch.num_rows):
                r = {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}
                key = (r["page_id"], r["digest"], r["url"])
                repeat = repeat + 1 if key == seen else 0
                seen = key
                out.record(r["shard"], r["page_id"], self._page(r, repeat))
        out.close()
        return Written(out.done)

    def _page(self, r: dict, repeat: int) -> bytes:
        payload, kind = r["payload"], r["record_type"]
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
        block = http + payload if kind == "response" else http
        digest = _sha1(payload) if kind == "response" else "sha1:" + base64.b32encode(bytes.fromhex(r["digest"])).decode()
        headers = [("WARC-Type", kind), ("WARC-Record-ID", _id(r["page_id"], r["digest"], r["url"], repeat)), ("WARC-Date", self.date),
                   ("WARC-Target-URI", _plain(r["url"]) if r["url"] else None), ("X-Page-ID", r["page_id"]),
                   ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response")]
        if kind == "revisit":
            headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(r["refers_to"], r["digest"], r["refers_url"], 0)),
                        ("WARC-Refers-To-Target-URI", _plain(r["refers_url"]) if r["refers_url"] else None), ("X-Refers-To-Page-ID", r["refers_to"])]
        return _record(headers, block)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = place(self.folder)
        done = sorted((pair for m in messages if m for pair in m.files), key=lambda pair: pair[1].file)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda pair: files.move(pair[0], f"{path}/{pair[1].file}"), done))
        with files.open_output_stream(f"{path}/_temporary/{MANIFEST}", compression=None) as out:
            for _, about in done:
                out.write((json.dumps(asdict(about), sort_keys=True) + "\n").encode())
        files.move(f"{path}/_temporary/{MANIFEST}", f"{path}/{MANIFEST}")
        files.delete_dir(f"{path}/_temporary")  # files of tasks that did not count

    def abort(self, messages: list[Written | None]) -> None:
        files, path = place(self.folder)
        files.delete_dir_contents(f"{path}/_temporary", missing_dir_ok=True)


class _Hashed(io.RawIOBase):
    """Stream that digests what is read."""

    def __init__(self, stream):
        self.stream, self.digest = stream, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[:len(data)] = data
        self.digest.update(data)
        return len(data)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an unpacked WARC stream; raises where the format is broken."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record here: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('WARC-Record-ID')} does not end where it says")
        yield headers, block


@dataclass
class _File(InputPartition):
    about: dict


class WarcReader(DataSourceReader):
    """One partition a file of the manifest; every digest is checked."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.payloads = options["path"], options.get("payloads", "true") == "true"

    def partitions(self) -> list[_File]:
        files, path = place(self.folder)
        with files.open_input_stream(f"{path}/{MANIFEST}", compression=None) as f:
            return [_File(json.loads(line)) for line in f.read().decode().splitlines()] or [_File({})]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.about:
            return
        files, path = place(self.folder)
        rows, held = [], 0
        with files.open_input_stream(f"{path}/{partition.about['file']}", compression=None) as f:
            raw = _Hashed(f)
            with gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as unpacked:
                for headers, block in records(unpacked):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    rows.append(self._row(headers, block, partition.about["file"]))
                    held += len(rows[-1].get("payload") or b"") + 500
                    if held > 4 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
            if raw.digest.hexdigest() != partition.about["sha256"]:
                raise ValueError(f"{partition.about['file']} is not the file of the manifest")
        if rows:
            yield self._batch(rows)

    def _row(self, headers: dict[str, str], block: bytes, file: str) -> dict:
        if _sha1(block) != headers["WARC-Block-Digest"]:
            raise ValueError(f"{headers['WARC-Record-ID']}: block and digest differ")
        http, _, payload = block.partition(b"\r\n\r\n")
        said = int(next(v for k, _, v in (line.partition(b": ") for line in http.split(b"\r\n")) if k == b"Content-Length"))
        kind = headers["WARC-Type"]
        if kind == "response" and (said != len(payload) or _sha1(payload) != headers["WARC-Payload-Digest"]):
            raise ValueError(f"{headers['WARC-Record-ID']}: payload and headers differ")
        number = {n: int(headers[n]) if n in headers else None for n in ("X-Page-ID", "X-Refers-To-Page-ID")}
        row = {"page_id": number["X-Page-ID"], "payload_bytes": said, "payload_digest": base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex(),
               "record_type": kind, "refers_to": number["X-Refers-To-Page-ID"], "url": headers.get("WARC-Target-URI"),
               "record_id": headers["WARC-Record-ID"], "refers_id": headers.get("WARC-Refers-To"), "file": file}
        return row | ({"payload": payload if kind == "response" else None} if self.payloads else {})

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = FIELDS + (", payload binary" if self.payloads else "")
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, kinds[t]) for n, t in (c.split() for c in fields.split(", "))]))


class WarcSource(DataSource):
    """``format("barloom_warc")`` with options path, date and roll_bytes (write), path and payloads (read)."""

    @classmethod
    def name(cls) -> str:
        return "barloom_warc"

    def schema(self) -> str:
        return FIELDS + (", payload binary" if self.options.get("payloads", "true") == "true" else "")

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def _key(page_id: int | str | None, digest: str) -> tuple:
    return (False, 0, digest) if page_id is None else (True, int(page_id), digest)


def shard_starts(rows: DataFrame, shard_bytes: int) -> list[tuple]:
    """First key of every shard but the first, so that shards hold near equal bytes.

    Keys are drawn by their own hash, so bounds depend on the rows alone and not on how files are split; only shard
    sizes vary with the draw, not what is written.
    """
    total = rows.agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    if not total["n"]:
        return []
    shards = min(MOST_SHARDS, -(-total["w"] // shard_bytes))
    drawn = rows.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(max(1, total["n"] // SAMPLE_KEYS))) == 0)
    keys = [(_key(r["page_id"], r["digest"]), r["w"]) for r in drawn.groupBy("page_id", "digest").agg(F.sum("weight").alias("w")).collect()]
    keys.sort()
    step, at, starts = sum(w for _, w in keys) / shards, 0, []
    for key, w in keys:
        if at >= step * (len(starts) + 1):
            starts.append(key)
        at += w
    return starts


def classified(pages: DataFrame, scratch: Scratch, at_least: int = REVISIT_BYTES) -> DataFrame:
    """pages as (page_id, url, html, digest, payload_bytes, record_type, refers_to, refers_url)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    facts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    facts = facts.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "same", F.when(F.col("payload_bytes") >= at_least, F.sha2("payload", 256)))
    heads = facts.where("same IS NOT NULL").groupBy("same").agg(F.max(F.struct("page_id", "url")).alias("head"), F.count("*").alias("k"))
    heads = scratch.keep(heads.where("k > 1 AND head.page_id IS NOT NULL").select("same", "head"), "heads")
    side = F.broadcast(heads) if heads.count() <= LOOKUP_ROWS else heads
    other = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head.page_id"))
    return facts.join(side, "same", "left").select(
        "page_id", "url", F.sha1("payload").alias("digest"), "payload_bytes", F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("head.page_id")).alias("refers_to"), F.when(other, F.col("head.url")).alias("refers_url"), F.when(~other, F.col("payload")).alias("payload"))


def archive(pages: DataFrame, folder: str, date: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> None:
    """Writes one record per row of pages (page_id, url, html) to WARC files and a manifest in ``folder``.

    Of rows with equal payloads of at least 1000 bytes, that with the largest page_id is written as response and the
    others as revisits without payload; rows that repeat its page_id too are responses, as are equal payloads without
    any page_id. Null html is an empty payload; a null page_id or url leaves its header out and sorts first. The same
    rows give the same bytes and names, in any order or number of input files. ``date`` (WARC-Date) is a parameter, as
    pages carry no time. An empty table commits an empty manifest. A folder that holds a manifest is refused. Other
    columns are ignored.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    arrow_batches(spark)
    spark.dataSource.register(WarcSource)
    rows = classified(pages, scratch)
    weight = F.lit(HEADER_BYTES) + F.when(F.col("payload").isNotNull(), F.col("payload_bytes")).otherwise(0)
    starts = shard_starts(scratch.keep(rows.select("page_id", "digest", weight.cast("long").alias("weight")), "keys"), shard_bytes)

    def shard_of(ids: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(starts, _key(i, d)) for i, d in zip(ids, digests)], dtype="int32")

    shard = F.pandas_udf(shard_of, IntegerType())(F.col("page_id").cast("string"), F.col("digest"))
    dealt = rows.withColumn("shard", shard).repartitionById(len(starts) + 1, F.col("shard"))
    dealt.sortWithinPartitions("shard", "page_id", "digest", "url").write.format("barloom_warc").mode("append").options(
        path=folder, date=date, roll_bytes=str(roll_bytes)).save()


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of a committed archive; a missing manifest, a broken record or a digest that differs is an error."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("barloom_warc").options(path=folder, payloads=str(payloads).lower()).load()


def pages_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
c AS (SELECT page_id, payload, strlen(payload)::BIGINT AS payload_bytes,
  CASE WHEN strlen(payload) >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS head FROM p)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to FROM c"""
