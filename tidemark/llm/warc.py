"""WARC archives of pages, and their index by an external merge.

Writing: each page's payload digest is known first (a narrow pass over the pages gives digest and size of each payload;
one small row a page is shuffled), so that of equal payloads of at least MIN_REVISIT bytes the one of the largest page_id
becomes a response and the others revisit it. Each task then writes gzip members of WARC/1.1 records to archives of its
own in the shared folder, and a run of index lines sorted by URL key and timestamp.

Index: evenly spaced keys of every run give the limits of the ranges; a range's task reads its slice of each run, found
in the run's own table of offsets, and merges the slices with a loser tree, a block of each run at a time. Ranges follow
one another, so the captures of a URL stand in order of time over all archives. A URL with very many captures is cut by
timestamp and page.

Reading: each archive is parsed record by record from the stored bytes, payloads are hashed again, and a revisit takes
size and digest of the record that it refers to. Archives and runs are named by task attempt and known only from rows
that their tasks return when they have ended, so lost executors leave at most files that no row names.

Defined results: a null html is an empty payload; a null url is an empty one; rows of equal page_id are written each;
a row without page_id is written with an empty id, and only revisits; an empty table gives an empty one; further columns
are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import struct
import zlib
from datetime import UTC, datetime, timedelta
from itertools import islice
from urllib.parse import urlsplit

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, emit, open_fs, shared_dir, staged, table
from .common import runs as runs_of

MIN_REVISIT = 1000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PER_BLOCK = 256  # lines of a run that are read at once
FAN_IN = 256  # runs that are merged at once
PER_RANGE = 20_000  # lines of a range of the merged index, about
SAMPLE = 20_000  # keys from which the ranges' limits are taken


def url_key(url: str) -> str:
    """A sort key that keeps a site together: host labels reversed, then the path and query in lower case."""
    u = urlsplit(url)
    host = (u.hostname or "").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + ("?" + u.query.lower() if u.query else "")


def stamp(page_id: int | None) -> str:
    """Pages have no time of capture: a second each from a fixed day on, by page_id."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 33))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(kind: str, page_id: int | None, url: str, sha1: bytes, body: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + body if kind == "response" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {stamp(page_id)}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def parse(raw: bytes) -> dict:
    """What a record says, and size and digest of the payload that it holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    f = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(f["Content-Length"])]
    body = block.partition(b"\r\n\r\n")[2]
    num = lambda k: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", f.get(k, ""))) else None
    said = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    got = hashlib.sha1(body).hexdigest() if f["WARC-Type"] == "response" else None
    if got and got != said:
        raise ValueError("a payload's digest is wrong")
    return {"page_id": num("WARC-Record-ID"), "kind": f["WARC-Type"], "bytes": len(body) if got else None, "digest": said, "refers_to": num("WARC-Refers-To")}


def members(f):
    """(offset, length, bytes) of each gzip member of an open file, a few megabytes at a time."""
    at, start, held, ended = 0, 0, b"", False
    d, out = zlib.decompressobj(31), []
    while True:
        if not held:
            held = f.read(1 << 20)
            if not held:
                return
        out.append(d.decompress(held))
        if d.eof:
            at = f.tell() - len(d.unused_data)
            yield start, at - start, b"".join(out)
            start, held, out, d = at, d.unused_data, [], zlib.decompressobj(31)
        else:
            held = b""


# -- decisions ------------------------------------------------------------------------------------


def decisions(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the page that a revisit repeats, null for responses."""
    html = F.coalesce("html", F.lit(""))
    small = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= MIN_REVISIT)
    first = staged(spark, small.groupBy("digest").agg(F.max("page_id").alias("of"), F.count(F.lit(1)).alias("c")).where("c > 1 and of is not null"), folder, "first", small=True)
    again = small.join(first, "digest").where("page_id is null or page_id != of").select(F.col("page_id").alias("p"), F.col("of").alias("refers_to"), F.col("digest").alias("d")).distinct()
    again = staged(spark, again, folder, "again", small=True)
    return pages.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.sha1(html.cast("binary")) == F.col("d")), "left").select("page_id", "url", "html", "refers_to")


# -- archives and runs ----------------------------------------------------------------------------


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of pages (page_id, url, html, refers_to) and sorted runs of their index; a row for each file: archive, run, rows, samples."""

    def each(batches, out):
        c = TaskContext.get()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        tag, n, f = f"{c.partitionId():05d}-{c.taskAttemptId()}", 0, None

        def close():
            f.close()
            fs.move(f"{root}/{name}.part", f"{root}/{name}")
            lines.sort()
            run = f"run-{tag}-{n:04d}.idx"
            keys = put_run(fs, f"{root}/{run}", lines)
            return out([[name], [run], [len(lines)], [keys]])

        for b in batches:
            for page, url, html, to in zip(*[b.column(x).to_pylist() for x in ("page_id", "url", "html", "refers_to")], strict=True):
                if f is None:
                    name, at, lines = f"pages-{tag}-{n:04d}.warc.gz", 0, []
                    f = fs.open_output_stream(f"{root}/{name}.part")
                body, url = (html or "").encode(), re.sub(r"[\r\n]", " ", url or "")
                rec = record("response" if to is None else "revisit", page, url, hashlib.sha1(body).digest(), body, to)
                f.write(rec)
                key = f"{url_key(url)} {stamp(page)} {'' if page is None else f'{page:020d}'}"
                lines.append((key, name, at, len(rec)))
                at += len(rec)
                if at >= 128 << 20:
                    yield close()
                    f, n = None, n + 1
        if f is not None:
            yield close()

    return emit(pages, "archive string, run string, lines long, sample array<string>", each)


def put_run(fs, path: str, lines) -> list[str]:
    """Blocks of PER_BLOCK gzipped lines, then a table of first keys and offsets, then that table's place. Returns up to 64 keys."""
    lines, at, heads = iter(lines), 0, []
    with fs.open_output_stream(f"{path}.part") as f:
        while block := list(islice(lines, PER_BLOCK)):
            b = gzip.compress("".join(f"{k}\t{n}\t{o}\t{z}\n" for k, n, o, z in block).encode(), 3)
            f.write(b)
            heads.append((block[0][0], at, len(b)))
            at += len(b)
        b = gzip.compress("\n".join(f"{k}\t{o}\t{z}" for k, o, z in heads).encode())
        f.write(b + struct.pack(">QQ", at, len(b)))
    fs.move(f"{path}.part", path)
    return [h[0] for h in heads[:: max(1, len(heads) // 64)]]


def slice_of(fs, path: str, low: str, high: str | None):
    """The lines of a run with low <= key < high, a block at a time."""
    f = fs.open_input_file(path)
    at, size = struct.unpack(">QQ", f.read_at(16, f.size() - 16))
    heads = [x.split("\t") for x in gzip.decompress(f.read_at(size, at)).decode().split("\n")]
    for i in range(max(0, bisect.bisect_right([h[0] for h in heads], low) - 1), len(heads)):
        if high is not None and heads[i][0] >= high:
            return
        for line in gzip.decompress(f.read_at(int(heads[i][2]), int(heads[i][1]))).decode().splitlines():
            key, name, o, z = line.split("\t")
            if key >= low and (high is None or key < high):
                yield key, name, int(o), int(z)


class LoserTree:
    """k-way merge: inner nodes hold the losers of their games, so that a step replays one path from a leaf."""

    def __init__(self, runs: list):
        self.runs = runs
        self.k = max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.lost = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (self.head[a], a) < (self.head[b], b)

    def _play(self, i: int) -> None:
        at, won = (i + self.k) // 2, i
        while at > 0:
            if self.lost[at] == -1:  # while building: wait here for the other side
                self.lost[at] = won
                return
            if self._less(self.lost[at], won):
                self.lost[at], won = won, self.lost[at]
            at //= 2
        self.won = won

    def __iter__(self):
        while self.head[self.won] is not None:
            yield self.head[self.won]
            self.head[self.won] = next(self.runs[self.won], None)
            self._play(self.won)


def folded(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """run, lines, sample of at most FAN_IN runs: while there are more, each task merges FAN_IN of them into one."""
    df = files.select("run", "lines", "sample")
    for turn in range(1, 9):
        n = df.count()
        if n <= FAN_IN:
            return df
        groups = -(-n // FAN_IN)

        def each(batches, out, turn=turn):
            fs, root = open_fs(folder)
            c = TaskContext.get()
            for g, rows in runs_of(batches, "g", ["run", "lines"]):
                name = f"run-m{turn}-{g}-{c.taskAttemptId()}.idx"
                keys = put_run(fs, f"{root}/{name}", LoserTree([slice_of(fs, f"{root}/{r}", "", None) for r, _ in rows]))
                yield out([[name], [sum(n for _, n in rows)], [keys]])

        dealt = df.withColumn("g", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int")).repartition(groups, "g").sortWithinPartitions("g", "run")
        df = staged(spark, emit(dealt, "run string, lines long, sample array<string>", each), folder, f"folded-{turn}")
    raise RuntimeError("too many runs")


def merged(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """range, nth, url_key, captured, archive, offset, length: all captures; (range, nth) is their global order."""
    last = folded(spark, files, folder)
    names = sorted(r["run"] for r in last.select("run").collect())  # FAN_IN at most
    total = last.agg(F.sum("lines")).first()[0] or 0
    keys = sorted(r["k"] for r in last.select(F.explode("sample").alias("k")).distinct().orderBy(F.xxhash64("k")).limit(SAMPLE).collect())
    ranges = max(1, min(len(keys), total // PER_RANGE + 1))
    limits = [keys[len(keys) * i // ranges] for i in range(1, ranges)]
    bounds = spark.createDataFrame(list(zip(range(ranges), ["", *limits], [*limits, None], strict=True)), "range int, low string, high string")

    def each(batches, out):
        fs, root = open_fs(folder)
        for b in batches:
            for r, low, high in zip(*[b.column(x).to_pylist() for x in ("range", "low", "high")], strict=True):
                it, nth = iter(LoserTree([slice_of(fs, f"{root}/{n}", low, high) for n in names])), 0
                while rows := list(islice(it, 4096)):
                    keys = [k.rsplit(" ", 2) for k, *_ in rows]
                    yield out([[r] * len(rows), list(range(nth, nth + len(rows))), [k[0] for k in keys], [k[1] for k in keys], *[[x[i] for x in rows] for i in (1, 2, 3)]])
                    nth += len(rows)

    return emit(bounds.repartitionById(ranges, F.col("range")), "range int, nth long, url_key string, captured string, archive string, offset long, length long", each)


# -- reading back ---------------------------------------------------------------------------------


def read(files: DataFrame, folder: str) -> DataFrame:
    """archive, offset, length, page_id, kind, bytes, digest, refers_to of each stored record."""

    def each(batches, out):
        fs, root = open_fs(folder)
        for b in batches:
            for name in b.column("archive").to_pylist():
                rows = []
                with fs.open_input_file(f"{root}/{name}") as f:
                    for offset, length, raw in members(f):
                        x = parse(raw)
                        rows.append((name, offset, length, x["page_id"], x["kind"], x["bytes"], x["digest"], x["refers_to"]))
                        if len(rows) == 4096:
                            yield out(list(zip(*rows, strict=True)))
                            rows = []
                if rows:
                    yield out(list(zip(*rows, strict=True)))

    parts = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    return emit(files.select("archive").repartition(parts, "archive"), "archive string, offset long, length long, page_id long, kind string, bytes long, digest string, refers_to long", each)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """A row for each page: what the archives hold for it, and its place in them and in the merged index."""
    arrow_rows(spark)
    root = shared_dir(spark)
    folder = f"{root}/warc"
    files = staged(spark, write(decisions(spark, pages.select("page_id", "url", "html"), root), folder), root, "files")
    got = staged(spark, read(files, folder), root, "read")
    first = staged(spark, got.where("kind = 'response'").groupBy("page_id", "digest").agg(F.max("bytes").alias("b")).select(F.col("page_id").alias("o"), F.col("digest").alias("d"), "b"), root, "origins", small=True)
    index = staged(spark, merged(spark, files, folder), root, "index")
    df = got.join(index, ["archive", "offset", "length"])
    again = df.where("kind = 'revisit'").join(first, (F.col("refers_to") == F.col("o")) & (F.col("digest") == F.col("d")))
    return df.where("kind = 'response'").select("*", F.col("bytes").alias("payload_bytes")).unionByName(again.select(*df.columns, F.col("b").alias("payload_bytes")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = archive(spark, table(spark, sf_dir, "pages"))
    return df.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "url_key", "captured", F.col("range").alias("index_range"), F.col("nth").alias("index_nth"), "offset", "length")
