"""Tiled rasters as a Spark data source: windows go down to the tiles that are read, expressions to where they are decoded.

A raster folder holds shards, each a run of tiles of float64 bands and, behind them, a footer with the place of each tile;
a manifest, which a write's commit adds as a whole, has a line for each shard: what rasters, rows and columns it covers.
So the driver plans by shards, and a task that reads one gets its footer and then only the byte ranges of the tiles that
the window meets. Filters on raster, row and col are evaluated here, others by Spark above the scan.

Options of a read: raster, row, col (first:last, like a filter), bands (names, comma-separated; all), expression (norm_diff(a,b), decibel(a) or difference(a,b): a
column `value`), codes (index or decibel: `code`, the 16-bit form of the value), receipts (a line for each shard read,
instead of pixels: its tiles and the bytes read). Of a write: tile (rows and columns of a tile) and bands.

A pixel of which a write got no row isn't returned; a band without a value is null, as is what an expression makes of
it (65535 as code of an index); empty tables are empty rasters. Pixels given twice keep the last of the task that has them.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.scalar import CLOUD, SCALE

NAME, TILE, MAGIC = "tidemark_raster", 64, b"TDMRAST1"
AXES = ("raster", "row", "col")


def _positive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    return np.where(total > 0, (a - b) / np.where(total > 0, total, 1.0), np.nan)


EXPRESSIONS = {"norm_diff": _positive, "difference": lambda a, b: a - b, "decibel": lambda a: np.where(a > 0, 10 * np.log10(np.where(a > 0, a, 1.0)), np.nan)}


def index_code(v: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(v), CLOUD, np.floor((np.nan_to_num(v) + 1) * SCALE + 0.5) + 1)


def decibel_code(v: np.ndarray, low: float = -50.0, high: float = 15.0, scale: float = 1000.0) -> np.ndarray:
    return np.where(np.isnan(v), 0, np.floor((np.clip(np.nan_to_num(v), low, high) - low) * scale + 0.5) + 1)


CODES = {"index": index_code, "decibel": decibel_code}


def open_at(path: str):
    """File system and path of a folder, on the driver and on executors."""
    from pyarrow import fs

    uri = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def manifest(path: str) -> dict:
    """bands, tile and the shards of all committed writes."""
    from pyarrow import fs

    system, at = open_at(path)
    out: dict = {"bands": [], "tile": TILE, "shards": []}
    found = system.get_file_info(fs.FileSelector(f"{at}/manifest", allow_not_found=True))
    for f in sorted(f.path for f in found if f.path.endswith(".json")):
        with system.open_input_stream(f) as s:
            got = json.loads(s.read())
        if out["bands"] and (got["bands"], got["tile"]) != (out["bands"], out["tile"]):
            raise ValueError(f"{f} has other bands or tiles than the writes before it")
        out = {"bands": got["bands"], "tile": got["tile"], "shards": out["shards"] + got["shards"]}
    return out


class Shard(InputPartition):
    def __init__(self, shard: dict):
        self.shard = shard


class RasterReader(DataSourceReader):
    def __init__(self, options: dict, what: dict):
        self.options, self.what = options, what
        self.path = options["path"]
        self.bounds = {a: [int(v) for v in options[a].split(":")] if a in options else [-(1 << 62), 1 << 62] for a in AXES}
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if name not in AXES or not (isinstance(f, In) or isinstance(value, int)):
                yield f
            elif isinstance(f, In):
                some = {v for v in value if v is not None}
                self.only[name] = self.only.get(name, some) & some
            elif isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                lo, hi = self.bounds[name]
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    lo = max(lo, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    hi = min(hi, value - isinstance(f, LessThan))
                self.bounds[name] = [lo, hi]
            else:
                yield f

    def meets(self, box: dict, name: str) -> bool:
        (a, b), (lo, hi) = box[name], self.bounds[name]
        return a <= hi and b >= lo and (name not in self.only or any(a <= v <= b for v in self.only[name]))

    def partitions(self) -> list[InputPartition]:
        return [Shard(s) for s in self.what["shards"] if all(self.meets(s, a) for a in AXES)] or [Shard({})]

    def read(self, partition: Shard) -> Iterator:
        import pyarrow as pa

        s, bands, t = partition.shard, self.what["bands"], self.what["tile"]
        if not s:
            return
        system, at = open_at(self.path)
        with system.open_input_file(f"{at}/{s['file']}") as f:
            f.seek(s["size"] - 16)
            start, magic = struct.unpack("<q8s", f.read(16))
            if magic != MAGIC:
                raise ValueError(f"{s['file']} is no shard of tiles")
            f.seek(start)
            tiles = np.frombuffer(f.read(s["size"] - 16 - start), np.int64).reshape(-1, 4)  # raster, row, col of a tile, offset
            n_bytes, n_read = s["size"] - start, 0
            for raster, r0, c0, offset in tiles.tolist():
                if not all(self.meets({"raster": (raster, raster), "row": (r0, r0 + t - 1), "col": (c0, c0 + t - 1)}, a) for a in AXES):
                    continue
                wanted = self.needs(bands)
                f.seek(offset)
                there = np.unpackbits(np.frombuffer(f.read((t * t + 7) // 8), np.uint8), count=t * t).astype(bool)
                n_bytes, n_read = n_bytes + (t * t + 7) // 8 + 8 * t * t * len(wanted), n_read + 1
                planes = {}
                for b in wanted:  # of the bands, only those that are asked for
                    f.seek(offset + (t * t + 7) // 8 + 8 * t * t * bands.index(b))
                    planes[b] = np.frombuffer(f.read(8 * t * t), np.float64)
                if "receipts" in self.options:
                    continue
                cells = np.flatnonzero(there)
                row, col = r0 + cells // t, c0 + cells % t
                keep = self.inside("row", row) & self.inside("col", col)
                row, col, cells = row[keep], col[keep], cells[keep]
                cols = [pa.array(np.full(len(row), raster, np.int32)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), *self.values({b: v[cells] for b, v in planes.items()}, len(row))]
                yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in fields(self.options, self.what)])
        if "receipts" in self.options:
            yield pa.RecordBatch.from_arrays([pa.array([s["file"]]), pa.array([len(tiles)], pa.int64()), pa.array([n_read], pa.int64()), pa.array([n_bytes], pa.int64())], names=["shard", "tiles", "tiles_read", "bytes_read"])

    def needs(self, bands: list[str]) -> list[str]:
        return expression(self.options)[1] if "expression" in self.options else chosen(self.options, bands)

    def inside(self, name: str, v: np.ndarray) -> np.ndarray:
        (lo, hi), only = self.bounds[name], self.only.get(name)
        ok = (v >= lo) & (v <= hi)
        return ok & np.isin(v, list(only)) if only is not None else ok

    def values(self, planes: dict[str, np.ndarray], n: int) -> list:
        import pyarrow as pa

        if "expression" not in self.options:
            return [pa.array(v, from_pandas=True) for v in planes.values()]
        f, names = expression(self.options)
        v = EXPRESSIONS[f](*[planes[b] for b in names])
        out = [pa.array(v, from_pandas=True)]
        return [*out, pa.array(CODES[self.options["codes"]](v).astype(np.int32))] if "codes" in self.options else out


def expression(options: dict) -> tuple[str, list[str]]:
    m = re.fullmatch(r"\s*(\w+)\(([\w\s,]+)\)\s*", options["expression"])
    if not m or m[1] not in EXPRESSIONS:
        raise ValueError(f"expression must be one of {sorted(EXPRESSIONS)} of bands")
    return m[1], [b.strip() for b in m[2].split(",")]


def chosen(options: dict, bands: list[str]) -> list[str]:
    return [b.strip() for b in options["bands"].split(",")] if "bands" in options else bands


def fields(options: dict, what: dict) -> list[tuple[str, str]]:
    if "receipts" in options:
        return [("shard", "string"), ("tiles", "bigint"), ("tiles_read", "bigint"), ("bytes_read", "bigint")]
    names = [(a, "int") for a in AXES]
    if "expression" in options:
        return [*names, ("value", "double"), *([("code", "int")] if "codes" in options else [])]
    return [*names, *[(b, "double") for b in chosen(options, what["bands"])]]


class Written(WriterCommitMessage):
    def __init__(self, shard: dict | None):
        self.shard = shard


class RasterWriter(DataSourceArrowWriter):
    """Rows must come dealt and sorted by tile, as write() gives them: a task holds one tile at a time."""

    def __init__(self, path: str, bands: list[str], tile: int, overwrite: bool):
        self.path, self.bands, self.tile, self.overwrite = path, bands, tile, overwrite

    def write(self, batches: Iterator) -> WriterCommitMessage:
        system, at = open_at(self.path)
        system.create_dir(f"{at}/shards", recursive=True)
        name, t, index, held, now = f"shards/{uuid.uuid4().hex}.tiles", self.tile, [], [], None
        with system.open_output_stream(f"{at}/{name}") as f:

            def flush() -> None:
                there, planes = np.zeros(t * t, bool), np.full((len(self.bands), t * t), np.nan)
                for cells, values in held:
                    there[cells] = True
                    planes[:, cells] = values
                index.append((*now, f.tell()))
                f.write(np.packbits(there).tobytes() + planes.tobytes())
                held.clear()

            for b in batches:
                raster, row, col = (b.column(a).to_numpy(zero_copy_only=False).astype(np.int64) for a in AXES)
                values = np.stack([b.column(x).to_numpy(zero_copy_only=False).astype(np.float64) for x in self.bands]) if len(raster) else None
                r0, c0 = row // t * t, col // t * t
                cut = np.flatnonzero(np.concatenate([[True], (raster[1:] != raster[:-1]) | (r0[1:] != r0[:-1]) | (c0[1:] != c0[:-1])])) if len(raster) else []
                for i, j in zip(cut, [*cut[1:], len(raster)], strict=True) if len(raster) else ():
                    of = (int(raster[i]), int(r0[i]), int(c0[i]))
                    if of != now and held:
                        flush()
                    now = of
                    held.append(((row[i:j] - r0[i]) * t + col[i:j] - c0[i], values[:, i:j]))
            if held:
                flush()
            foot = f.tell()
            f.write(np.array(index, np.int64).tobytes() + struct.pack("<q8s", foot, MAGIC))
            size = f.tell()
        if not index:
            system.delete_file(f"{at}/{name}")
            return Written(None)
        x = np.array(index)
        return Written({"file": name, "size": size, "raster": [int(x[:, 0].min()), int(x[:, 0].max())], "row": [int(x[:, 1].min()), int(x[:, 1].max()) + t - 1], "col": [int(x[:, 2].min()), int(x[:, 2].max()) + t - 1]})

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, at = open_at(self.path)
        system.create_dir(f"{at}/manifest", recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(f"{at}/manifest"))] if self.overwrite else []
        name = f"{at}/manifest/{len(system.get_file_info(fs.FileSelector(f'{at}/manifest'))):08d}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps({"bands": self.bands, "tile": self.tile, "shards": [m.shard for m in messages if m is not None and m.shard]}).encode())
        system.move(f"{name}.part", f"{name}.json")  # readers see the whole write or nothing of it
        for f in old:
            system.delete_file(f)

    def abort(self, messages: list) -> None:
        """Shards that no manifest names are never read."""


class TiledRaster(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _what(self) -> dict:
        if not hasattr(self, "_read"):
            self._read = manifest(self.options["path"])
        return self._read

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in fields(dict(self.options), self._what()))

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(dict(self.options), self._what())

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        bands = [f.name for f in schema if f.name not in AXES]
        return RasterWriter(self.options["path"], bands, int(self.options.get("tile", TILE)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiledRaster)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(pixels: DataFrame, path: str, bands: list[str], tile: int = TILE, shards: int | None = None, mode: str = "overwrite") -> None:
    """Writes pixels (raster, row, col, bands) as tiles, dealt so that each tile is one task's; neighbouring tiles share shards."""
    register(pixels.sparkSession)
    at = [F.floor(F.col(a) / tile) for a in ("row", "col")]
    df = pixels.select(*[F.col(a).cast("int").alias(a) for a in AXES], *[F.col(b).cast("double").alias(b) for b in bands])
    n = shards or int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, "raster", *at).sortWithinPartitions("raster", *at).write.format(NAME).option("tile", tile).mode(mode).save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    r = spark.read.format(NAME)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)
