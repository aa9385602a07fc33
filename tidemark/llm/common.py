"""What the operators of this subpackage share: tables, the shared folder, hashing and packed exchanges."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"  # what separates words: \x20 and \x09-\x0D
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session without that setting, as in tests, gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _OWN.setdefault("base", tempfile.mkdtemp(prefix="tidemark-"))
    out = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, out))
    return out


@atexit.register
def _sweep() -> None:
    """Removes the folders that this process made, as far as the session still lives."""
    for spark, path in _MADE:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended: nothing can be removed through it
            return


def staged(spark: SparkSession, df: DataFrame, folder: str, name: str, small: bool = False) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, which survives lost executors.

    small: rows of a few numbers, which come from a shuffle: two files a core are enough for them, instead of a tiny one
    for each partition of the shuffle. The write's shuffle files go with its end: nothing reads them again.
    """
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(2 * spark.sparkContext.defaultParallelism) if small else df).write.mode("overwrite").parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(CLEANUP, held)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Removes staged tables that nothing reads any more: what was made from them is staged itself."""
    for name in names:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, like the given ones, that df has no column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, from file sizes: no job runs. Tables that aren't files are counted, at 2 KB a row."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 55 else df.count() * 2048


def arrow_rows(spark: SparkSession, n: int = 500) -> None:
    """Python workers get n rows at a time at most, so that long texts stay within their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def deal(df: DataFrame, *keys, n: int) -> DataFrame:
    return df.repartition(max(1, int(n)), *keys)


def open_fs(uri: str):
    """File system and path of a URI, for Python on executors (file, hdfs, s3, gs: whatever pyarrow opens)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def to_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def kept(key, make):
    """What make() gives, made once for each key in a worker process, which serves many tasks."""
    import sys
    import types

    box = sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept"))
    if key not in box.__dict__:
        box.__dict__[key] = make()
    return box.__dict__[key]


# -- hashes ---------------------------------------------------------------------------------------

M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 400_000):
        self.seen: dict[bytes, int] = {}
        self.bound = bound

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        seen, one = self.seen, xxhash.xxh64_intdigest
        if len(seen) > self.bound:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = one(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes; n enters the hash."""
    if len(h) < n:
        return h[:0]
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = mix(x * M3 + h[i : len(h) - n + 1 + i])
    return x


def places(keys: np.ndarray) -> np.ndarray:
    """For each key its place among the distinct keys in order, in less memory than np.unique takes for it."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    ranked = keys[order]
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    del ranked
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32) - 1
    return out


# -- packed exchanges -----------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """An integer array as byte planes, deflated: leading bytes that are alike cost nothing."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes, dtype) -> np.ndarray:
    import zstandard

    raw, size = zstandard.ZstdDecompressor().decompress(b), np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def ranges(keys: np.ndarray, buckets: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(bucket, first, past the last) of sorted keys for each of the equal ranges of their space that has any."""
    if not len(keys):
        return []
    b = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.flatnonzero(np.diff(b, prepend=b[:1] + np.uint64(1)))
    return list(zip(b[at].tolist(), at.tolist(), [*at[1:].tolist(), len(b)], strict=True))


def crc_mod3(col) -> "F.Column":
    """crc32 of a number written as text, modulo 3."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 3


def crc32(b: bytes) -> int:
    return zlib.crc32(b) & 0xFFFFFFFF


# -- Arrow kernels --------------------------------------------------------------------------------


def give_back() -> None:
    """Returns memory that a task has freed to the system: a worker lives on between tasks, and would keep the most it ever held."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def with_columns(df: DataFrame, inputs: list[str], extra: str, fn, replaces: str | None = None) -> DataFrame:
    """df with further columns that fn(*lists of the inputs) gives as lists; all others pass through untouched.

    Columns of df named like a further one give way. fn may give Arrow arrays instead of lists. With replaces, fn's last list takes that column's place.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new: StructType = _parse_datatype_string(extra)
    taken = {f.name.lower() for f in new}
    back = dict(zip(fresh(df, *[f"_in{i}" for i in range(len(inputs))]), inputs, strict=True))
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[F.col(f"`{c}`").alias(a) for a, c in back.items()])
    names = [c for c in kept.columns if c not in back]
    schema = StructType([kept.schema[c] for c in names] + list(new.fields))
    types = [f.type for f in to_arrow_schema(new)]

    def each(batches):
        try:
            for b in batches:
                made = fn(*[b.column(a).to_pylist() for a in back])
                cols = [b.column(c) for c in names]
                if replaces:
                    cols[names.index(replaces)] = pa.array(made[-1], cols[names.index(replaces)].type)
                yield pa.RecordBatch.from_arrays(cols + [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, types, strict=False)], [*names, *[f.name for f in new]])
        finally:
            give_back()

    return kept.mapInArrow(each, schema)


def emit(df: DataFrame, schema: str, fn) -> DataFrame:
    """df.mapInArrow(fn), where fn(batches, out) yields out(list of columns) of the schema."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def each(batches):
        try:
            yield from fn(batches, lambda cols: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], [f.name for f in arrow]))
        finally:
            give_back()

    return df.mapInArrow(each, kind)


def list_array(rows: list):
    """An Arrow array of lists of ints from numpy arrays and Nones, without a Python object for each number."""
    import pyarrow as pa

    sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
    some = [r for r in rows if r is not None]
    flat = np.concatenate(some).astype(np.int32) if some else np.zeros(0, np.int32)
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(flat), mask=pa.array([r is None for r in rows]))


def lists(column) -> list[np.ndarray]:
    """The lists of an Arrow list column as numpy arrays, without copies."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def runs(batches, key: str, names: list[str]):
    """(key, list of rows) for each run of equal keys of batches that are sorted by key; list columns become arrays."""
    import pyarrow as pa

    now, rows = None, []
    for b in batches:
        cols = [lists(b.column(n)) if pa.types.is_list(b.column(n).type) else b.column(n).to_pylist() for n in names]
        for k, *row in zip(b.column(key).to_pylist(), *cols, strict=True):
            if k != now and rows:
                yield now, rows
                rows = []
            now = k
            rows.append(row)
    if rows:
        yield now, rows


MOST_TASKS = 1 << 16  # of a stage: beyond it, a task takes several buckets, one after another


def bucket_count(spark: SparkSession, df: DataFrame, size: int) -> int:
    """Buckets in proportion to df's size on disk, and at least as many as shuffles have partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // size)


def deal_buckets(df: DataFrame, n: int) -> DataFrame:
    """df with each bucket (0 to n - 1) in one partition, a run of rows, and as evenly as they are."""
    tasks = min(n, MOST_TASKS)
    return df.repartitionById(tasks, F.floor(F.col("bucket").cast("long") * tasks / n).cast("int")).sortWithinPartitions("bucket")


def numbered(spark: SparkSession, df: DataFrame, folder: str, name: str, rows: int, *order) -> DataFrame:
    """df as a staged table with place, its number from 0 in the given order: dealt by ranges, numbered in each, offset by their sizes.

    df must read staged tables, since its ranges are sampled first. Equal rows spread over ranges by their place in the
    table. rows: about how many; each range gets some million.
    """
    n = max(1, min(MOST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")), rows >> 10), min(MOST_TASKS, rows >> 21))
    at, spread = fresh(df, "_at", "_spread")
    df = df.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(n, *order, spread).sortWithinPartitions(*order, spread)
    df = staged(spark, df.withColumn(at, F.monotonically_increasing_id()).drop(spread), folder, name)
    part = F.shiftright(at, 33)
    sizes = dict(df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each range
    offsets, seen = [], 0
    for k in sorted(sizes):
        offsets.append((k, seen))
        seen += sizes[k]
    before = spark.createDataFrame(offsets, "_part long, _before long") if offsets else spark.createDataFrame([], "_part long, _before long")
    df = df.join(F.broadcast(before), part == F.col("_part"))  # as many rows as ranges
    return df.withColumn("place", F.col("_before") + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, "_part", "_before")


FEW_EDGES = 1 << 17


def _joined(batches, out):
    """node, top: each node of some edges with the least node that they connect it with."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for b in batches:
        for v, w in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            v, w = root(v), root(w)
            if v != w:
                up[max(v, w)] = min(v, w)
    yield out([list(up), [root(v) for v in list(up)]])


def components(spark: SparkSession, edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node, comp: the smallest node that edges (a, b) connect it with. Contraction in tables, by rounds.

    In a round each node hangs on the least of its neighbourhood, in an order hashed anew, and on what that one hangs on;
    the edges between what is hung on go on, until they are FEW_EDGES at most. Nodes and edges fall by a factor a round whatever the graph's form, a chain
    included, so that the rounds are few and all together cost little more than the first. The way back joins the rounds'
    tables. Minima are combined before the shuffle, so that a node with very many edges costs a task no more than others.
    """
    e = staged(spark, edges.where("a != b").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).distinct(), folder, f"{name}-e0", small=True)
    steps = []
    for i in itertools.count():
        n = e.count()
        if n <= FEW_EDGES:  # of bounded size: one task joins what is left, which saves the last rounds
            if n:
                steps.append(staged(spark, emit(e.coalesce(1), "node long, top long", _joined), folder, f"{name}-h{i}", small=True))
            break
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        far = least.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hung = staged(spark, least.join(far, "up").select("node", "top"), folder, f"{name}-h{i}", small=True)
        steps.append(hung)
        to = lambda c: hung.select(F.col("node").alias(c), F.col("top").alias(f"{c}_top"))  # noqa: B023, E731
        e = e.join(to("a"), "a").join(to("b"), "b").where("a_top != b_top").select(F.xxhash64("a_top").alias("a"), F.xxhash64("b_top").alias("b")).distinct()
        e = staged(spark, e, folder, f"{name}-e{i + 1}", small=True)
        discard(spark, folder, f"{name}-e{i}")
    of = None  # node as hashed in a round; its root, and in which round's hash
    for k, hung in reversed(list(enumerate(steps))):
        hung = hung.select("node", F.col("top").alias("root"), F.lit(k).alias("round"))
        if of is not None:
            up = of.select(F.col("node").alias("next"), F.col("root").alias("_root"), F.col("round").alias("_round"))
            hung = hung.join(up, F.xxhash64("root") == F.col("next"), "left").select("node", F.coalesce("_root", "root").alias("root"), F.coalesce("_round", "round").alias("round"))
        of = staged(spark, hung, folder, f"{name}-r{k}", small=True)
    if of is None:
        return spark.createDataFrame([], f"node {edges.schema['a'].dataType.simpleString()}, comp {edges.schema['a'].dataType.simpleString()}")
    nodes = edges.where("a != b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = staged(spark, nodes.join(of.select(F.col("node").alias("x"), "root", "round"), F.xxhash64("node") == F.col("x")).select("node", "root", "round"), folder, f"{name}-of", small=True)
    out = staged(spark, found.join(found.groupBy("root", "round").agg(F.min("node").alias("comp")), ["root", "round"]).select("node", "comp"), folder, name, small=True)
    discard(spark, folder, f"{name}-of", f"{name}-e{i}", *[f"{name}-{c}{k}" for c in "hr" for k in range(len(steps))])
    return out
