"""Media columns: content-addressed payloads in tar shards.

Each task appends the distinct payloads that it meets to tar shards of its own in the shared folder, as lossless 8-bit
grey images (PNG) named by the payload's SHA-256; rows carry digest, shard, offset and length. One location of each
digest is then the payload's address for all rows, so that equal payloads are read once. Range reads of the first bytes
of a member fill the metadata columns; only what asks for the samples reads whole members.

A shard's name holds the task attempt, and rows name a shard only when it is closed, so that lost or repeated attempts
leave at most files that no row names. Defined results: a null text is an empty one; an empty text is one block of 64
zero bytes; texts of any length are whole; repeated rows share one address; further columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, crc32, emit, open_fs, shared_dir, staged, table

BLOCK = 64
ROWS, SEEN = 200_000, 1_000_000  # rows of a shard and digests of a task that are held in memory
PNG = b"\x89PNG\r\n\x1a\n"
ADDRESS = "digest string, n_bytes long, payload_bytes long, shard string, offset long, length long"


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's bytes with zeros up to a positive multiple of BLOCK, and their number without."""
    b = (text or "").encode()
    return b + bytes(-len(b) % BLOCK or (0 if b else BLOCK)), len(b)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(p: bytes) -> bytes:
    """An 8-bit grey PNG, BLOCK samples wide, with unfiltered lines."""
    lines = np.zeros((len(p) // BLOCK, BLOCK + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(p, np.uint8).reshape(-1, BLOCK)
    head = struct.pack(">IIBBBBB", BLOCK, len(lines), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(b: bytes) -> dict:
    """Width, height and bit depth from a PNG's first 33 bytes; nulls if they are none."""
    if b[:8] != PNG or b[12:16] != b"IHDR" or len(b) < 33 or zlib.crc32(b[12:29]) != struct.unpack(">I", b[29:33])[0]:
        return {"width": None, "height": None, "depth": None}
    w, h, depth = struct.unpack(">IIB", b[16:25])
    return {"width": w, "height": h, "depth": depth}


def decode(b: bytes) -> bytes:
    """The samples of what encode() made; every chunk's checksum is tested."""
    at, data, width = 8, [], 0
    while at < len(b):
        (n,), kind = struct.unpack(">I", b[at : at + 4]), b[at + 4 : at + 8]
        body = b[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", b[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(p: bytes) -> str:
    """64 bits of whether each of 64 equal parts is brighter than the whole, with the samples' mean in thousandths and how many values they take."""
    x = np.frombuffer(p, np.uint8).astype(np.int64)
    parts = x.reshape(64, -1).sum(axis=1) * 64 > x.sum()
    mean = int(x.sum() * 1000 // len(x))
    return f"{int(''.join('01'[int(v)] for v in parts), 2):016x}:{mean}:{int(np.bincount(x.astype(np.uint8), minlength=1).astype(bool).sum())}"


def tar_header(name: str, size: int) -> bytes:
    """One ustar member header, with all but name and size fixed."""
    h = bytearray(512)
    for at, field in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        h[at : at + len(field)] = field
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


class Shards:
    """Tar files of up to about `most` bytes in one folder."""

    def __init__(self, folder: str, tag: str, most: int = 256 << 20):
        self.fs, self.root = open_fs(folder)
        self.folder, self.tag, self.most, self.n, self.out = folder, tag, most, 0, None
        self.fs.create_dir(self.root, recursive=True)

    def add(self, name: str, body: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name, self.at = f"shard-{self.tag}-{self.n:04d}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}.part")
            self.n += 1
        self.out.write(tar_header(name, len(body)) + body + bytes(-len(body) % 512))
        offset = self.at + 512
        self.at = offset + len(body) + -len(body) % 512
        return self.name, offset, len(body)

    def full(self) -> bool:
        return self.out is not None and self.at >= self.most

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.fs.move(f"{self.root}/{self.name}.part", f"{self.root}/{self.name}")
            self.out = None


def store(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the texts' payloads to shards below folder; returns a row with the payload's address for each of docs.

    A shard is closed when it is full or has ROWS rows, and a task remembers at most SEEN digests: of many tiny texts, neither
    outgrows a task's memory. A payload written twice has two locations, of which addresses() takes one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def write(batches, out) -> Iterator:
        c = TaskContext.get()
        shards, seen, rows = Shards(folder, f"{c.partitionId():05d}-{c.taskAttemptId()}"), {}, []

        def flush():
            shards.close()
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return out(cols)

        for b in batches:
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                p, n = payload(t)
                d = hashlib.sha256(p).digest()
                if d not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[d] = shards.add(f"{d.hex()}.png", encode(p))
                rows.append((k, d.hex(), n, len(p), *seen[d]))
            if shards.full() or len(rows) >= ROWS:
                yield flush()
        if rows:
            yield flush()

    return emit(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), f"key {kind}, {ADDRESS}", write)


def addresses(rows: DataFrame) -> DataFrame:
    """One location for each digest: the first by shard and offset."""
    at = F.min(F.struct("shard", "offset", "length")).alias("at")
    return rows.groupBy("digest").agg(at).select("digest", "at.shard", "at.offset", "at.length")


def _each(df: DataFrame, folder: str, most: int, kind: str, see) -> DataFrame:
    """df with what see() makes of the first bytes (most, or all if 0) of each member; members of a shard in order."""
    names = [c for c in df.columns]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(folder)
        name, f = None, None
        for b in batches:
            got = []
            for shard, offset, length in zip(b["shard"], b["offset"], b["length"], strict=True):
                if shard != name:
                    name, f = shard, fs.open_input_file(f"{root}/{shard}")
                got.append(see(f.read_at(min(length, most) if most else length, offset)))
            yield pd.concat([b[names].reset_index(drop=True), pd.DataFrame(got)], axis=1)

    parts = max(1, df.sparkSession.sparkContext.defaultParallelism * 2)
    ordered = df.repartition(parts, "shard", F.floor(F.col("offset") / (16 << 20))).sortWithinPartitions("shard", "offset")
    return ordered.mapInPandas(read, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema) + ", " + kind)


def fill_metadata(at: DataFrame, folder: str) -> DataFrame:
    """Metadata columns by header-only range reads: 33 bytes of each member."""
    return _each(at, folder, 33, "width int, height int, depth int", header)


def read_back(at: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes hold: digests of samples and media, checksum of the last block, feature."""

    def see(b: bytes) -> dict:
        p = decode(b)
        return {"payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": crc32(p[-BLOCK:]), "media_bytes": len(b), "media_sha256": hashlib.sha256(b).hexdigest(), "feature": feature(p)}

    return _each(at, folder, 0, "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", see)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = staged(spark, store(docs, f"{folder}/media"), folder, "rows")
    at = read_back(fill_metadata(addresses(rows), f"{folder}/media"), f"{folder}/media")
    out = rows.drop("shard", "offset", "length").join(at, "digest")
    return out.select(F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "depth")
