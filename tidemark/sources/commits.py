"""A commit log over Parquet: rows become visible through manifests that are created exclusively, one after another.

A table is a folder with data folders, one for each attempt to write, and a log of numbered manifests. A writer first
writes its attempt, which nobody reads, and then tries to create the next manifest; of several writers one succeeds, by
the file system's own exclusive creation (a hard link on a local file system, else create without overwrite), and the
others look at what was added meanwhile and try the number after it. So a reader sees whole commits or nothing of them,
whatever writers do or where they die; what an attempt left behind is swept later. Every SNAPSHOT-th manifest lists all
data folders that are alive, so that a reader reads few manifests however long the log is.

On it stand documents that are published once (publish), stages that are resumed or replaced as a whole (stage), and a
cache of fetched bodies by the digest of request and body (fetched).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raster import open_at

SNAPSHOT = 20


@dataclass
class State:
    """What manifests up to `version` (0: none) say: data folders that are alive, and what the last one noted."""

    version: int
    folders: list[str]
    note: dict


class Log:
    """The log of one table. It is used on the driver only; what it holds is a few names for each commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.system, self.at = open_at(self.path)
        self.system.create_dir(f"{self.at}/log", recursive=True)

    def _manifest(self, version: int) -> str:
        return f"{self.at}/log/{version:012d}.json"

    def _versions(self) -> list[int]:
        from pyarrow import fs

        names = [f.base_name for f in self.system.get_file_info(fs.FileSelector(f"{self.at}/log"))]
        return sorted(int(n[:12]) for n in names if n.endswith(".json"))

    def _read(self, version: int) -> dict:
        with self.system.open_input_stream(self._manifest(version)) as s:
            return json.loads(s.read())

    def state(self) -> State:
        versions, added, removed = self._versions(), [], set()
        if not versions:
            return State(0, [], {})
        note = None
        for v in reversed(versions):
            m = self._read(v)
            note = m["note"] if note is None else note
            added = [f for f in m["add"] if f not in removed] + added
            removed |= set(m["remove"])
            if m["all"] is not None:
                return State(versions[-1], [f for f in m["all"] if f not in removed and f not in added] + added, note)
        return State(versions[-1], added, note or {})

    def create(self, version: int, body: dict) -> bool:
        """Creates a manifest if there is none of this number: True for one writer only."""
        to, data = self._manifest(version), json.dumps(body).encode()
        if self.system.type_name == "local":
            part = f"{to}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(part, to)  # fails if it exists, in one step
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{version:012d}.json")
        hadoop = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = hadoop.create(p, False)
        except Exception:  # noqa: BLE001  whoever holds the number, it isn't this writer
            if hadoop.exists(p):
                return False
            raise
        out.write(bytearray(data))
        out.close()
        return True

    def commit(self, state: State, add: list[str], remove: list[str], note: dict | None = None) -> bool:
        """Adds the manifest after `state`; False if another writer was first."""
        v, alive = state.version + 1, [f for f in state.folders if f not in remove] + add
        return self.create(v, {"add": add, "remove": remove, "all": alive if v % SNAPSHOT == 0 else None, "note": note or {}})

    def attempt(self, df: DataFrame) -> str:
        """Writes df to a folder that no manifest names yet."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def rows(self, state: State, schema=None) -> DataFrame | None:
        if not state.folders:
            return self.spark.createDataFrame([], schema) if schema is not None else None
        r = self.spark.read if schema is None else self.spark.read.schema(schema)
        return r.parquet(*[f"{self.path}/{f}" for f in state.folders])

    def sweep(self, older_s: float = 7 * 86_400) -> list[str]:
        """Removes data folders that no manifest keeps and that are older than any writer or reader may be."""
        from pyarrow import fs

        alive, gone = set(self.state().folders), []
        for f in self.system.get_file_info(fs.FileSelector(f"{self.at}/data", allow_not_found=True)):
            name = f"data/{f.base_name}"
            if name not in alive and time.time() - f.mtime.timestamp() >= older_s:
                self.system.delete_dir(f.path)
                gone.append(name)
        return gone


def publish(docs: DataFrame, path: str, key: str = "id", tries: int = 100) -> DataFrame:
    """Publishes documents of ids that aren't published; published ones never change. Returns what this call published.

    Of one id given twice in docs, the row that is least in the order of its columns counts. A null id is one id. Writers
    may run at once: who commits second drops the ids of who committed first.
    """
    log = Log(docs.sparkSession, path)
    rest = [c for c in docs.columns if c != key]
    one = docs.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else docs.select(key).distinct()
    state, name = log.state(), None
    for _ in range(tries):
        old = log.rows(state)
        if name is not None:
            one = log.spark.read.schema(one.schema).parquet(f"{log.path}/{name}")  # what was lost to others goes, what was written isn't made again
        new = one if old is None else one.join(old.select(F.col(key).alias("_old")).distinct(), F.col(key).eqNullSafe(F.col("_old")), "left_anti")
        name = log.attempt(new)
        if log.commit(state, [name], []):
            return log.spark.read.schema(one.schema).parquet(f"{log.path}/{name}")
        state = log.state()
    raise RuntimeError(f"{path}: other writers were first {tries} times")


def published(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    log = Log(spark, path)
    return log.rows(log.state(), schema)


def stage(spark: SparkSession, path: str, content: str, make: Callable[[], DataFrame], tries: int = 100) -> DataFrame:
    """The stage's rows: those that are there if they were made from the same content (any text that names inputs and parameters), else make()'s, which replace them as a whole.

    A stage that died half-written has no manifest and is made again. A reader that has begun keeps what it reads until
    sweep() removes it.
    """
    log = Log(spark, path)
    state = log.state()
    if state.note.get("content") == content and state.folders:
        return log.rows(state)
    name = log.attempt(make())
    for _ in range(tries):
        if log.commit(state, [name], state.folders, {"content": content}):
            return spark.read.parquet(f"{log.path}/{name}")
        state = log.state()
        if state.note.get("content") == content:  # another one has made the same meanwhile
            return log.rows(state)
    raise RuntimeError(f"{path}: other writers were first {tries} times")


def staged(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The rows of a stage's last whole version."""
    return published(spark, path, schema)


def request_key(namespace: str | F.Column, url: F.Column, params: F.Column) -> F.Column:
    """SHA-256 of namespace, URL and the parameters (a map) in order of their names."""
    name = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.sha2(F.to_json(F.struct(name.alias("n"), F.coalesce(url, F.lit("")).alias("u"), F.coalesce(F.array_sort(F.map_entries(params)), F.array()).alias("p"))), 256)


def fetched(requests: DataFrame, path: str, fetch: Callable[[DataFrame], DataFrame], namespace: str = "http") -> DataFrame:
    """requests (url, params: map<string,string>, ...) with request, digest and body of each, from the cache where it has them.

    fetch: takes the requests that are missing, once each (request, url, params), and gives request and body (binary) of
    those that succeed, as a lazy DataFrame: a kernel that fetches by batches, or a join. Requests that fail have null
    digests and are asked for again next time. Bodies are kept by digest, so that equal ones are kept once, and are never
    replaced: of two writers, the first one's body of a request counts for both.
    """
    spark = requests.sparkSession
    asked = requests.withColumn("request", request_key(namespace, F.col("url"), F.col("params")))
    distinct = asked.groupBy("request").agg(F.min("url").alias("url"), F.min_by(F.map_entries("params"), "url").alias("_p"))
    distinct = distinct.select("request", "url", F.map_from_entries("_p").alias("params"))
    known = published(spark, f"{path}/requests", "request string, digest string")
    missing = distinct.join(known.select("request"), "request", "left_anti")
    if not missing.isEmpty():
        got = fetch(missing).where("body is not null").withColumn("digest", F.sha2("body", 256))
        log = Log(spark, f"{path}/fetches")
        name = log.attempt(got.select("request", "digest", "body"))  # a fetch runs once, even if a later step fails
        got = spark.read.parquet(f"{log.path}/{name}")
        publish(got.select("digest", "body").dropDuplicates(["digest"]), f"{path}/bodies", "digest")
        publish(got.select("request", "digest"), f"{path}/requests", "request")
        log.sweep(0)
        known = published(spark, f"{path}/requests", "request string, digest string")
    bodies = published(spark, f"{path}/bodies", "digest string, body binary")
    return asked.join(known, "request", "left").join(bodies, "digest", "left").select(*requests.columns, "request", "digest", "body")
