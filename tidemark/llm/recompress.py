"""Substring dedup by recompression: words of passages that a document with a smaller doc_id has, too, are removed.

1. Naming. A text is a sequence of symbols, at first its words. A round names runs of equal symbols, then pairs of a
   left and a right symbol (a bit of the name tells which), as long as what a name stands for keeps within the round's
   cap. A name is a fingerprint of what it stands for and of the round, so that equal strings have equal names in every
   task, without an exchange of dictionaries. Rounds see neighbours only: of a window of `window` words, all symbols are
   alike in every occurrence but for some at its ends, and where these end follows from the window's words alone.
2. Anchors. Each window takes the highest round that leaves it whole symbols of its own, and of these the one whose name
   has the least hash: equal windows take equal anchors at equal offsets. Neighbouring windows mostly share an anchor; a
   row for each (anchor, windows that take it) has the anchor's name and a fingerprint of those windows' words, the context.
3. Shared names. Spark groups the names over all distinct texts; a name of one document alone ends here, with most text.
   A context whose first holder has a smaller doc_id removes all its windows. Where a shared name has several contexts,
   the first holder of each is read again, and its single windows are grouped by name and fingerprint.
4. Words under removed windows go. Of equal texts only the first doc_id's is looked at: the others lose all their words
   if they have a window at all.

All groupings combine before they shuffle; a passage of very many documents has one context but at its ends, where the
rows are as many as its documents. Fingerprints have 64 bits and are compared under equal names of 64 bits.

Defined results: a null text has no words; a null doc_id counts as larger than all others, and rows without doc_id remove
nothing from each other; nor do rows of equal doc_id; repeated rows get equal results; texts are whole; an empty table
gives an empty one; further columns are ignored. The key must be an integer.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import M3, WordHash, arrow_rows, discard, emit, mix, shared_dir, staged, table, to_long

WINDOW = 50
CAPS = (2, 4, 8)  # words that a name of a round may stand for
CHUNK = 400_000  # words that a task parses at once; windows don't see where a text is cut
LAST = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C17 | 3)  # odd, and 3 modulo 4
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Prints:
    """Fingerprints of substrings of a sequence of hashes."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, h: np.ndarray):
        n = len(h) + 1
        if len(Prints.powers) < n:
            Prints.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
            Prints.inverses = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(h * Prints.inverses[: n - 1], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * Prints.powers[a] + (b - a).astype(np.uint64) * M3)


class Round:
    """Symbols of a chunk: where they start (and the end of all), their names, and whether a text starts there."""

    def __init__(self, start: np.ndarray, name: np.ndarray, fresh: np.ndarray):
        self.start, self.name, self.fresh = start, name, fresh

    def index(self) -> np.ndarray:
        """For each word that a symbol starts at, and the end, which symbol it is."""
        at = np.zeros(int(self.start[-1]) + 1, np.int32)
        at[self.start] = np.arange(len(self.start), dtype=np.int32)
        return at

    def joined(self, heads: np.ndarray, name: np.ndarray) -> "Round":
        return Round(np.append(self.start[:-1][heads], self.start[-1]), name, self.fresh[heads])


def runs_named(r: Round, p: np.ndarray, q: np.ndarray, cap: int, k: int) -> Round:
    """Names runs of equal symbols; p and q move to what no word outside a window can change."""
    n, size = len(r.name), np.diff(r.start)
    new = np.ones(n, bool)
    new[1:] = (r.name[1:] != r.name[:-1]) | r.fresh[1:]
    run = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], n)
    count = ends - heads
    named = (count > 1) & (count * size[heads] <= cap)

    at = r.index()
    live = np.flatnonzero(p < q)
    a, b = at[p[live]], at[q[live]] - 1
    first = r.start[np.minimum(ends[run[a]], b + 1)]  # where the run ends that the window starts with
    last = r.start[np.maximum(heads[run[b]], a)]
    open_ = lambda s, length: (2 * size[s] <= cap) & (length <= cap)  # noqa: E731  longer runs stay as they are, whatever is outside
    move_p, move_q = open_(a, first - p[live]), open_(b, q[live] - last)
    p[live[move_p]] = first[move_p]
    q[live[move_q]] = last[move_q]

    keep = new | ~named[run]
    name = r.name.copy()
    some = heads[named]
    name[some] = mix(r.name[some] * M3 + count[named].astype(np.uint64) + np.uint64(2 * k + 1 << 32))
    return r.joined(np.flatnonzero(keep), name[keep])


def pairs_named(r: Round, p: np.ndarray, q: np.ndarray, cap: int, k: int) -> Round:
    """Names pairs of a left and a right symbol."""
    size = np.diff(r.start)
    left = (mix(r.name + np.uint64(2 * k + 2 << 32)) >> np.uint64(17) & np.uint64(1)).astype(bool)
    both = np.zeros(len(size), bool)
    both[1:] = left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= cap) & ~r.fresh[1:]

    at = r.index()
    live = np.flatnonzero(p < q)
    a, b = at[p[live]], at[q[live]] - 1
    move = ~left[a] & (size[a] < cap)
    p[live[move]] = r.start[a[move] + 1]
    move = left[b] & (size[b] < cap)
    q[live[move]] = r.start[b[move]]

    name = r.name.copy()
    second = np.flatnonzero(both)
    name[second - 1] = mix(mix(r.name[second - 1] * M3 + np.uint64(2 * k + 2 << 32)) + r.name[second])
    return r.joined(np.flatnonzero(~both), name[~both])


def least(r: Round, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each window the longest symbol between p and q, of equally long ones that whose name has the least hash, of equal ones the first."""
    order, at = mix(r.name ^ M3) >> np.uint64(8) | np.uint64(255) - np.minimum(np.diff(r.start), 255).astype(np.uint64) << np.uint64(56), r.index()
    a, b = at[p], at[q]
    step = [np.arange(len(order), dtype=np.int32)]
    width = int((b - a).max(initial=1))
    while 2 << len(step) - 1 <= width:
        prev, half = step[-1], 1 << len(step) - 1
        x, y = prev[:-half], prev[half:]
        step.append(np.where(order[y] < order[x], y, x))
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.zeros(len(p), np.int32)
    for j, s in enumerate(step):
        mine = np.flatnonzero(level == j)
        x, y = s[a[mine]], s[b[mine] - (1 << j)]
        out[mine] = np.where(order[y] < order[x], y, x)
    return out


def anchors(h: np.ndarray, sizes: list[int], window: int, caps=CAPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, name, context) of the windows of texts in a row, as positions in h, where `sizes` words make a text."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    n_windows = np.maximum(np.asarray(sizes) - window + 1, 0)
    p = np.repeat(begins - np.concatenate([[0], np.cumsum(n_windows)[:-1]]), n_windows) + np.arange(n_windows.sum())
    if not len(p):
        return p, p, p.astype(np.uint64), p.astype(np.uint64)
    windows, q = p.copy(), p + window
    fresh = np.zeros(len(h), bool)
    fresh[begins[np.asarray(sizes) > 0]] = True
    r = Round(np.arange(len(h) + 1), h, fresh)
    where, name, done = p.copy(), np.zeros(len(p), np.uint64), np.zeros(len(p), bool)
    rounds = [(r, p.copy(), q.copy())]
    for k, cap in enumerate(caps):
        r = runs_named(r, p, q, cap, k)
        r = pairs_named(r, p, q, cap, k)
        rounds.append((r, p.copy(), q.copy()))
    for k, (r, p, q) in reversed(list(enumerate(rounds))):
        mine = np.flatnonzero(~done & (p < q))
        got = least(r, p[mine], q[mine])
        where[mine], name[mine], done[mine] = r.start[got], mix(r.name[got] + np.uint64(k)), True
    new = np.ones(len(windows), bool)
    new[1:] = (where[1:] != where[:-1]) | (name[1:] != name[:-1]) | (windows[1:] != windows[:-1] + 1)
    heads = np.flatnonzero(new)
    lo, hi = windows[heads], windows[np.append(heads[1:], len(windows)) - 1]
    context = mix(Prints(h)(lo, hi + window) + (where[heads] - lo).astype(np.uint64) * M3)
    return lo, hi, name[heads], context


def chunks(lengths: list[int], window: int, limit: int):
    """Lists of (text, first word, past the last) with some `limit` words each; pieces of one text overlap by window - 1."""
    part, held = [], 0
    for i, n in enumerate(lengths):
        a = 0
        while True:
            b = min(n, a + limit)
            part.append((i, a, b))
            held += b - a
            if held >= limit:
                yield part
                part, held = [], 0
            if b == n:
                break
            a = b - window + 1
    if part:
        yield part


def parsed(docs: DataFrame, window: int, key: str, text: str) -> DataFrame:
    """key, h1, h2, n_words, sha, lows, names, contexts of each row: the anchors of all its windows, as arrays in binary."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches, out):
        of = WordHash()
        for b in batches:
            hashes, sha = [], []
            for t in b.column("text").to_pylist():
                w = t.split() if t else []
                hashes.append(of(w))
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
                del w
            got = [([], [], []) for _ in hashes]
            for part in chunks([len(h) if len(h) >= window else 0 for h in hashes], window, CHUNK):
                lo, _, name, context = anchors(np.concatenate([hashes[i][x:y] for i, x, y in part]), [y - x for _, x, y in part], window)
                ends = np.cumsum([y - x for _, x, y in part])
                cuts = np.searchsorted(lo, ends)
                for (i, x, y), end, a, z in zip(part, ends, [0, *cuts[:-1]], cuts, strict=True):
                    if z > a:
                        for to, v in zip(got[i], ((lo[a:z] - (end - (y - x)) + x).astype(np.int32), name[a:z], context[a:z]), strict=True):
                            to.append(v)
            cols = [[np.concatenate(g[j]).tobytes() if g[j] else b"" for g in got] for j in range(3)]
            yield out([b.column(c).to_pylist() for c in ("key", "h1", "h2")] + [[len(h) for h in hashes], sha, *cols])

    return emit(keyed(docs, key, text), f"key {kind}, h1 long, h2 long, n_words long, sha string, lows binary, names binary, contexts binary", each)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text as bytes, and two hashes that tell texts apart."""
    t = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(key).alias("key"), t.alias("text"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2"))


def exploded(texts: DataFrame, window: int) -> DataFrame:
    """name, context, t, d, lo, hi: a row for each anchor of each distinct text."""

    def each(batches, out):
        for b in batches:
            parts = []
            for t, d, n, lows, names, contexts in zip(*[b.column(c).to_pylist() for c in ("t", "d", "n_words", "lows", "names", "contexts")], strict=True):
                lo = np.frombuffer(lows, np.int32)
                hi = np.append(lo[1:] - 1, n - window)
                parts.append([to_long(np.frombuffer(names, np.uint64)), to_long(np.frombuffer(contexts, np.uint64)), np.full(len(lo), t), np.full(len(lo), d), lo, hi])
            if parts:
                yield out([np.concatenate(c) for c in zip(*parts, strict=True)])

    return emit(texts.select("t", "d", "n_words", "lows", "names", "contexts"), "name long, context long, t long, d long, lo int, hi int", each)


def window_prints(rows: DataFrame, window: int) -> DataFrame:
    """name, print, t, d, lo of each window of the asked-for ranges (a: array of lo, hi, name) of texts."""

    def each(batches, out):
        of = WordHash()
        for b in batches:
            parts, held = [], 0
            for t, d, text, asked in zip(*[b.column(c).to_pylist() for c in ("t", "d", "text", "asked")], strict=True):
                prints = Prints(of(text.split()))
                lo, hi = np.array([x["lo"] for x in asked]), np.array([x["hi"] for x in asked])
                n = hi - lo + 1
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                name = np.repeat(np.array([x["name"] for x in asked], np.int64), n)
                parts.append([name, to_long(prints(at, at + window)), np.full(len(at), t), np.full(len(at), d), at.astype(np.int32)])
                held += len(at)
                if held > 400_000:
                    yield out([np.concatenate(c) for c in zip(*parts, strict=True)])
                    parts, held = [], 0
            if parts:
                yield out([np.concatenate(c) for c in zip(*parts, strict=True)])

    return emit(rows.select("t", "d", "text", "asked"), "name long, print long, t long, d long, lo int", each)


def without(rows: DataFrame, window: int) -> DataFrame:
    """h1, h2, n_removed, sha of texts without the words under the spans."""

    def each(batches, out):
        for b in batches:
            n_removed, sha = [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                w = text.split()
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, [x["lo"] for x in spans], 1)
                np.add.at(edge, [x["hi"] + window for x in spans], -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])).hexdigest())
            yield out([b.column("h1").to_pylist(), b.column("h2").to_pylist(), n_removed, sha])

    return emit(rows.select("h1", "h2", "text", "spans"), "h1 long, h2 long, n_removed long, kept_sha256 string", each)


def shared_anchors(spark: SparkSession, texts: DataFrame, window: int, folder: str) -> DataFrame:
    """The anchors whose name several documents have, with context_first (smallest d of the context) and several (contexts of the name)."""
    rows = exploded(texts, window)
    names = rows.groupBy("name").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").select("name")
    names = staged(spark, names, folder, "names", small=True)  # joins read it as it is, so that a frequent name's rows can be split
    held = staged(spark, rows.join(names, "name"), folder, "shared")
    first = staged(spark, held.groupBy("name", "context").agg(F.min("d").alias("context_first")), folder, "contexts", small=True)
    several = staged(spark, first.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit(True).alias("several")), folder, "several", small=True)
    found = staged(spark, held.join(first, ["name", "context"]).join(several, "name", "left").drop("context"), folder, "anchors")
    discard(spark, folder, "names", "shared", "contexts", "several")
    return found


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256: words under windows that also start in a document with a smaller key are removed."""
    arrow_rows(spark)
    folder = shared_dir(spark)
    rows = staged(spark, parsed(docs, window, key, text), folder, "parsed")
    d = F.coalesce(F.col("key").cast("long"), F.lit(LAST))
    payload = F.struct("lows", "names", "contexts")
    texts = rows.where(F.col("n_words") >= window).groupBy("h1", "h2").agg(F.min(d).alias("d"), F.first("n_words").alias("n_words"), F.first(payload).alias("x"))
    texts = staged(spark, texts.select("h1", "h2", "d", "n_words", "x.*", F.monotonically_increasing_id().alias("t")), folder, "texts")
    rows = staged(spark, rows.select("key", "h1", "h2", "n_words", "sha"), folder, "rows")
    discard(spark, folder, "parsed")

    found = shared_anchors(spark, texts, window, folder)
    ids = staged(spark, texts.select("t", "h1", "h2", "d"), folder, "ids")
    discard(spark, folder, "texts")
    wanted = found.where("several and d = context_first").groupBy("t").agg(F.collect_list(F.struct("lo", "hi", "name")).alias("asked"))  # a text's own anchors
    wanted = staged(spark, wanted.join(ids, "t"), folder, "wanted")
    source = keyed(docs, key, text).withColumn("d", d).select("h1", "h2", "d", "text")
    prints = staged(spark, window_prints(source.join(wanted, ["h1", "h2", "d"]), window).distinct(), folder, "prints")
    first = prints.groupBy("name", "print").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").select("name", "print", "least")
    first = staged(spark, first, folder, "first", small=True)
    discard(spark, folder, "wanted")
    single = prints.join(first, ["name", "print"]).where("least < d").select("t", "lo", F.col("lo").alias("hi"))
    spans = found.where("context_first < d").select("t", "lo", "hi").union(single).groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = staged(spark, spans.join(ids, "t"), folder, "spans")
    discard(spark, folder, "anchors", "prints", "first")
    cut = staged(spark, without(source.join(spans, ["h1", "h2", "d"]), window).distinct(), folder, "cut", small=True)

    out = rows.join(ids.select("h1", "h2", "d"), ["h1", "h2"], "left").join(cut, ["h1", "h2"], "left")
    copy = F.coalesce(d, F.lit(LAST)) > F.col("d")  # an equal text has a smaller key
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("key").alias(key), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
x AS (SELECT r, doc_id, unnest(range(1, len(w) - {WINDOW - 1} + 1)) AS i, w FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM x),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM h JOIN f USING (h) WHERE first < doc_id OR doc_id IS NULL AND first IS NOT NULL),
k AS (SELECT r, count(*) AS n FROM g GROUP BY 1),
e AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM e ANTI JOIN g USING (r, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r) LEFT JOIN s USING (r)
"""
