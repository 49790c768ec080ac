"""Token ids as flat binary files.

A folder holds, for each shard, `NNNNN.bin` (the ids of its documents one after another, unsigned little-endian integers
of 2 bytes where the vocabulary allows, else 4) and `NNNNN.idx` (for each document its id, then its first token counted
from the start of the shard, both 64-bit, then the number of tokens in all), and `manifest.json` with each shard's first
document and its base: the tokens in all shards before it, a prefix sum over shards. Shards are in ascending order of
document id. Files are written under temporary names and renamed, so a repeated task leaves the same file, and the
manifest comes last.

Null texts count as empty; each document ends with the end id. Rows with a null id come first, as id -2**63; rows of
equal id are in the order of their ids' bytes.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec
from .shared import arrays, map_batches, text_of

LEAST = -(2**63)
#: Rows of a shard, about; leading bits by which keys are counted at once.
SHARD_ROWS, BIN_BITS = 1 << 14, 12


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def put(folder: str, name: str, parts: Iterable[bytes]) -> None:
    """A whole file, written under a temporary name and then renamed; one that is there is replaced."""
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    store.move(temporary, f"{path}/{name}")


def take(folder: str, name: str) -> pa.Buffer:
    """A file's bytes: memory-mapped where the file system is local."""
    store, path = filesystem(folder)
    if isinstance(store, fs.LocalFileSystem):
        with pa.memory_map(f"{path}/{name}") as file:
            return file.read_buffer()
    with store.open_input_file(f"{path}/{name}") as file:
        return file.read_buffer()


def shard_count(docs: DataFrame) -> int:
    """Shards of about SHARD_ROWS rows: their number depends on the input alone."""
    return max(1, math.ceil(docs.count() / SHARD_ROWS))


def shard_bounds(docs: DataFrame, key: str, shards: int) -> list[int]:
    """Where shards begin, from the second on. Keys are counted by their leading bits, and where many share them by more bits, so the bounds depend on the keys alone, not on partitions; what comes to the driver is a count for at most 2**BIN_BITS prefixes and for each that is split again."""
    sign = -(2**63)
    keys = docs.select(F.col(key).cast("long").bitwiseXOR(F.lit(sign)).alias("k")).filter("k IS NOT NULL")  # in order as unsigned numbers
    least, most, total = docs.agg(F.min(F.col(key).cast("long")), F.max(F.col(key).cast("long")), F.count(F.col(key))).head()
    if shards < 2 or not total or least == most:
        return []
    shift = max(0, ((least ^ most) & (2**64 - 1)).bit_length() - BIN_BITS)
    counted = {r["p"]: r["n"] for r in keys.groupBy(F.shiftrightunsigned("k", shift).alias("p")).agg(F.count("*").alias("n")).collect()}
    leaves: list[tuple[int, int]] = []  # first unsigned key of a prefix, and its keys
    while counted:
        heavy = {p for p, n in counted.items() if shift and 8 * n * shards > total}
        leaves += [((p << shift) % 2**64, n) for p, n in counted.items() if p not in heavy]
        counted = {}
        if heavy:
            inside = keys.filter(F.shiftrightunsigned("k", shift).isin(*heavy))
            shift = max(0, shift - BIN_BITS)
            counted = {r["p"]: r["n"] for r in inside.groupBy(F.shiftrightunsigned("k", shift).alias("p")).agg(F.count("*").alias("n")).collect()}
    cuts, before, previous = set(), 0, 0
    for start, n in sorted(leaves):
        if before and before * shards // total != (before - previous) * shards // total:
            cuts.add(start - 2**63)
        before, previous = before + n, n
    return sorted(cuts)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, shards: int | None = None) -> dict:
    """Encodes every document, writes the files, and returns the manifest. Only one count per shard comes to the driver."""
    bounds = shard_bounds(docs, key, shards or shard_count(docs))
    wide = codec(tokenizer).size > 2**16
    kind = np.dtype("<u4" if wide else "<u2")

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(tokenizer)
        end = np.array([end_id], kind).tobytes()
        ids = [np.frombuffer(c.encode_bytes(x), np.uint32).astype(kind).tobytes() + end for x in batch.column("text").to_pylist()]
        keys = batch.column("key").to_pylist()
        where = np.searchsorted(np.array(bounds, np.int64), np.array(keys, np.int64), "right").tolist() if bounds else [0] * len(keys)
        return arrays({"shard": pa.int32(), "key": pa.int64(), "ids": pa.binary()}, {"shard": where, "key": keys, "ids": ids})

    def saved(batches):
        full = (b for b in batches if b.num_rows)
        if (first := next(full, None)) is None:
            return
        shard, keys, sizes = first.column("shard")[0].as_py(), [], []

        def parts():
            for batch in itertools.chain([first], full):
                keys.extend(batch.column("key").to_pylist())
                new = batch.column("ids").to_pylist()
                sizes.extend(len(x) // kind.itemsize for x in new)
                yield b"".join(new)

        put(folder, f"{shard:05}.bin", parts())
        starts = np.cumsum([0, *sizes], dtype="<i8")
        put(folder, f"{shard:05}.idx", [np.array(keys, "<i8").tobytes(), starts.tobytes()])
        yield arrays({"shard": pa.int32(), "first": pa.int64(), "documents": pa.int64(), "tokens": pa.int64()}, {"shard": [shard], "first": [keys[0]], "documents": [len(keys)], "tokens": [int(starts[-1])]})

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("key"), text_of(text).alias("text"))
    dealt = map_batches(rows, encoded, "shard int, key long, ids binary").repartitionById(len(bounds) + 1, "shard")
    counts = dealt.sortWithinPartitions("key", "ids").mapInArrow(saved, "shard int, first long, documents long, tokens long").collect()
    base, entries = 0, []
    for r in sorted(counts, key=lambda r: r["shard"]):
        entries.append({"shard": r["shard"], "first": r["first"], "documents": r["documents"], "tokens": r["tokens"], "base": base})
        base += r["tokens"]
    manifest = {"type": kind.str, "end_id": end_id, "documents": sum(e["documents"] for e in entries), "tokens": base, "shards": entries}
    put(folder, "manifest.json", [json.dumps(manifest).encode()])
    return manifest


def documents_of(folder: str, manifest: dict, shard: dict):
    """(key, start over all shards, ids) of each document of a shard."""
    kind = np.dtype(manifest["type"])
    index = np.frombuffer(take(folder, f"{shard['shard']:05}.idx"), "<i8")
    ids = np.frombuffer(take(folder, f"{shard['shard']:05}.bin"), kind)
    n = shard["documents"]
    for k in range(n):
        a, b = int(index[n + k]), int(index[n + k + 1])
        yield int(index[k]), shard["base"] + a, ids[a:b]


def read_token_files(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document: key, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""
    manifest = json.loads(take(folder, "manifest.json").to_pybytes())
    types = {"key": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def read(batches):
        for batch in batches:
            for entry in batch.column("entry").to_pylist():
                found = ((None if k == LEAST else k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, start, ids in documents_of(folder, manifest, json.loads(entry)))
                while rows := list(itertools.islice(found, 10_000)):
                    yield arrays(types, {n: [r[i] for r in rows] for i, n in enumerate(types)})

    entries = spark.createDataFrame([(place, json.dumps(e)) for place, e in enumerate(manifest["shards"])], "place int, entry string")
    dealt = entries.repartitionById(max(1, len(manifest["shards"])), "place")
    return dealt.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)
