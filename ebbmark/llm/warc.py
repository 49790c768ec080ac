"""Deterministic sharded WARC files.

Pages are range-partitioned and sorted by page id; each task writes its records as gzip members into files that roll over
once their compressed size reaches a limit. Headers and digests are made anew from the payload, record ids from page id
and digest, and dates are a parameter, so equal input gives equal files. Files are written under temporary names and
renamed; the manifest, which lists them with their sizes and digests, comes last and commits the archive. Shards begin where
exact counts of page ids put them, and their number follows from the number of pages, so neither depends on how the
input is partitioned.

Of records with equal payloads of at least LEAST_SHARED bytes, the one with the largest page id is the response and the
others are revisits of it; payloads are equal where their SHA-256 is. Null html counts as empty, a null url as urn:page:<id>. A null page id is the smallest and is
written as none. Rows of one page id and payload are all of one type. No rows give an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrays, text_of, written
from .tokenfiles import LEAST, put, shard_bounds, shard_count, take

LEAST_SHARED = 1000
#: Compressed bytes after which a file is closed, and the date of all records.
ROLL = 32 << 20
DATE = "2024-01-01T00:00:00Z"
#: Revisits are broadcast up to so many.
MOST_BROADCAST = 100_000
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:ebbmark:warc")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page} {digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed record: a response, or a revisit of the page refers_to."""
    digest = _sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", _sha1(block)), ("X-Page-ID", "none" if page is None else str(page)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def info_record(name: str, date: str = DATE) -> bytes:
    block = f"software: ebbmark\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member; its header has no time, so equal data give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: pa.Buffer, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, decompressed one after another."""
    view, at, rest = memoryview(data), 0, b""
    while at < len(view) or rest:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not rest:
                if at >= len(view):
                    raise ValueError("the last gzip member is cut off")
                rest, at = bytes(view[at : at + step]), at + step
            parts.append(z.decompress(rest))
            rest = z.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("this is no whole WARC record")
    return fields, rest[:size]


def revisits(pages: DataFrame) -> DataFrame:
    """(page, digest, refers_to) for the rows that revisit another page. pages: page, payload."""
    narrow = pages.select("page", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("size")).filter(f"size >= {LEAST_SHARED}")
    groups = narrow.groupBy("digest", "size").agg(F.max("page").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    return narrow.join(groups, ["digest", "size"]).filter("page < refers_to").select("page", "digest", "refers_to").distinct()


def write_archive(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", source: str = "html", shards: int | None = None, roll: int = ROLL, date: str = DATE) -> dict:
    """Writes the files and the manifest, which is returned."""
    bounds = shard_bounds(pages, page, shards or shard_count(pages))
    rows = pages.select(F.coalesce(F.col(page).cast("long"), F.lit(LEAST)).alias("page"), F.col(url).cast("string").alias("url"), text_of(source).cast("binary").alias("payload"))
    again = written(revisits(rows))
    again = F.broadcast(again) if again.count() <= MOST_BROADCAST else again
    edges = np.array(bounds, np.int64)
    place = F.pandas_udf(lambda keys: pd.Series(np.searchsorted(edges, keys.to_numpy(), "right")), "int")("page")
    joined = rows.withColumn("digest", F.sha2("payload", 256)).join(again, ["page", "digest"], "left").drop("digest").withColumn("shard", place)

    def save(batches):
        files, parts, size, records, shard, name = [], [], 0, 0, None, ""

        def close() -> None:
            nonlocal parts, size, records
            if records:
                put(folder, name, parts)
                whole = hashlib.sha256()
                for p in parts:
                    whole.update(p)
                files.append((name, records, size, whole.hexdigest()))
            parts, size, records = [], 0, 0

        for batch in batches:
            for s, k, u, payload, ref in zip(*(batch.column(c).to_pylist() for c in ("shard", "page", "url", "payload", "refers_to")), strict=True):
                shard = s
                if not parts:
                    name = f"{shard:05}-{len(files):05}.warc.gz"
                    parts, size = [first := member(info_record(name, date))], len(first)
                parts.append(member(record(None if k == LEAST else k, u, payload, ref, date)))
                size, records = size + len(parts[-1]), records + 1
                if size >= roll:
                    close()
        close()
        if files:
            yield arrays({"name": pa.string(), "records": pa.int64(), "bytes": pa.int64(), "sha256": pa.string()}, {n: [f[i] for f in files] for i, n in enumerate(("name", "records", "bytes", "sha256"))})

    dealt = joined.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("page", "payload", "url")
    files = dealt.mapInArrow(save, "name string, records long, bytes long, sha256 string").collect()  # a row for a file
    manifest = {"date": date, "records": sum(f["records"] for f in files), "files": sorted((f.asDict() for f in files), key=lambda f: f["name"])}
    put(folder, "manifest.json", [json.dumps(manifest, indent=1).encode()])
    return manifest


def read_archive(spark: SparkSession, folder: str, page: str = "page_id") -> DataFrame:
    """A row per record, from the files alone: page, payload_bytes, payload_digest (hex), record_type, refers_to. A response's digests are verified."""
    manifest = json.loads(take(folder, "manifest.json").to_pybytes())
    names = ("page", "payload_bytes", "payload_digest", "record_type", "refers_to")
    types = dict(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))

    def rows_of(name: str):
        for data in members(take(folder, name)):
            fields, block = parse(data)
            if fields["WARC-Type"] == "warcinfo":
                continue
            if _sha1(block) != fields["WARC-Block-Digest"]:
                raise ValueError(f"a record of {name} has another block than was written")
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            if fields["WARC-Type"] == "response" and (len(payload) != size or _sha1(payload) != fields["WARC-Payload-Digest"]):
                raise ValueError(f"a record of {name} has another payload than was written")
            digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            own, ref = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
            yield None if own == "none" else int(own), size, digest, fields["WARC-Type"], None if ref is None else int(ref)

    def read(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                found = list(rows_of(name))
                yield arrays(types, {n: [r[i] for r in found] for i, n in enumerate(names)})

    files = spark.createDataFrame([(k, f["name"]) for k, f in enumerate(manifest["files"])], "place int, name string")
    dealt = files.repartitionById(max(1, len(manifest["files"])), "place")
    return dealt.mapInArrow(read, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long").withColumnRenamed("page", page)
