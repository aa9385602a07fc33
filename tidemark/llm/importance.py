"""Importance resampling towards a target's distribution of hashed word features, with weights from bit-sliced sums.

1. Words are runs of letters, digits and non-ASCII characters, A-Z lowered; features are all runs of 1 to `most` words,
   and a feature's bucket is the CRC-32 of its bytes modulo `buckets`. Each task sums its documents' buckets before the
   shuffle, so that one row for each task and bucket travels, whatever the data hold.
2. A bucket's gain, 1000 times the logarithm of how much more frequent it is in the target, is an integer; its
   magnitude's bits are planes of `buckets` bits, one set for gains above 0 and one for those below.
3. A document's bucket counts become planes of `buckets` bits, too: plane j has the buckets whose count has bit j. The
   number of common bits of count plane j and gain plane k counts 2^(j + k) times. These sums are exact integers; their
   floored mean is the document's weight.
4. The score adds Gumbel noise hashed from seed and doc_id, so that the highest scores are a draw without replacement.
   A histogram of scores, bounded by their range, gives the lowest one that can be drawn; what reaches it is dealt by
   ranges of (score, doc_id), numbered within its range, and offset by the ranges' sizes: no task sorts all rows.

Defined results: a null text has no words; no words give a weight of 0; a null doc_id draws as the text 'null' and ranks
after others of its score; repeated rows are ranked each for itself; texts are whole; an empty table gives an empty one,
an empty target the gains of no features; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, emit, numbered, shared_dir, staged, table

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lowered runs of letters, digits and bytes of non-ASCII characters."""
    return text.translate(_WORD).split() if text else []


class Buckets:
    """Buckets of words, remembered up to a bound."""

    def __init__(self, buckets: int, bound: int = 400_000):
        self.buckets, self.bound, self.seen = buckets, bound, {}

    def __call__(self, features: list[bytes]) -> np.ndarray:
        if len(self.seen) > self.bound:
            self.seen.clear()
        for w in set(features).difference(self.seen):
            self.seen[w] = zlib.crc32(w) % self.buckets
        return np.fromiter(map(self.seen.__getitem__, features), np.int64, len(features))


def feature_list(text: bytes | None, most: int) -> tuple[int, list[bytes]]:
    """The number of words, and the features."""
    w = words(text)
    return len(w), w + [b" ".join(w[i : i + k]) for k in range(2, most + 1) for i in range(len(w) - k + 1)]


def bucket_counts(docs: DataFrame, most: int = 1, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket."""

    def each(batches, out):
        of, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                total += np.bincount(of(feature_list(t, most)[1]), minlength=buckets)
        some = np.flatnonzero(total)
        yield out([some, total[some]])

    return emit(docs.select(F.col(text).cast("binary").alias("text")), "bucket int, n long", each).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The integer gain of each bucket from two tables of bucket_counts(), which have at most `buckets` rows."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for df, to in ((corpus, s), (target, t)):
        for r in df.collect():
            to[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (all_s + buckets) / ((x + 1) * (all_t + buckets)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def bit_planes(values: np.ndarray, rows: np.ndarray, buckets: np.ndarray, n_rows: int, width: int) -> list[np.ndarray]:
    """Planes of the values at (row, bucket), which are sorted and distinct: plane j has bit `bucket` set in a row where the value has bit j."""
    slots, bits = rows * width + (buckets >> 6), np.uint64(1) << (buckets & 63).astype(np.uint64)
    out = []
    for j in range(int(values.max(initial=0)).bit_length()):
        on = np.flatnonzero((values >> j) & 1)
        plane, at = np.zeros(n_rows * width, np.uint64), slots[on]
        if len(on):
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            plane[at[heads]] = np.bitwise_or.reduceat(bits[on], heads)
        out.append(plane.reshape(n_rows, width))
    return out


def sliced_sums(counts: np.ndarray, rows: np.ndarray, buckets: np.ndarray, n_rows: int, signed: list[tuple[int, list[np.ndarray]]]) -> np.ndarray:
    """For each row the exact sum of count x gain. signed: (sign, planes of the gains' magnitudes of that sign)."""
    width = signed[0][1][0].shape[1] if signed[0][1] else signed[1][1][0].shape[1] if signed[1][1] else 0
    total = np.zeros(n_rows, np.int64)
    if width:
        for j, plane in enumerate(bit_planes(counts, rows, buckets, n_rows, width)):
            for sign, planes in signed:
                for k, g in enumerate(planes):
                    total += sign * (np.bitwise_count(plane & g).sum(1, dtype=np.int64) << (j + k))
    return total


def gain_planes(g: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
    at, width = np.arange(len(g)), (len(g) + 63) // 64
    return [(sign, bit_planes(np.maximum(sign * g, 0), np.zeros(len(g), np.int64), at, 1, width)) for sign in (1, -1)]


def gumbel(seed: int, key) -> int:
    """1000 times a Gumbel number hashed from seed and key, floored."""
    h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, g: np.ndarray, most: int = 1, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features, weight, score."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches, out):
        of, planes, size = Buckets(len(g)), gain_planes(g), np.int64(len(g))
        for b in batches:
            keys, lists = b.column("key").to_pylist(), []
            for t in b.column("text").to_pylist():  # one text's words at a time
                w, f = feature_list(t, most)
                lists.append((w, of(f)))
            n, all_ = np.array([len(f) for _, f in lists], np.int64), np.concatenate([f for _, f in lists])
            cells, counts = np.unique(np.repeat(np.arange(len(n)), n) * size + all_, return_counts=True)
            weight = sliced_sums(counts, cells // size, cells % size, len(n), planes) // np.maximum(n, 1)
            score = [w + gumbel(seed, k) for k, w in zip(keys, weight.tolist(), strict=True)]
            yield out([keys, [w for w, _ in lists], n, weight, score])

    return emit(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), f"key {kind}, n_words long, n_features long, weight long, score long", each)


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_features, weight, score, rank of every document: the `percent` highest scores of those with `least` words are drawn, and have a rank."""
    arrow_rows(spark)
    folder = shared_dir(spark)
    g = gains(bucket_counts(docs, most, buckets, text), bucket_counts(target, most, buckets), buckets)
    rows = staged(spark, weighed(docs, g, most, seed, key, text), folder, "weighed")
    ok = rows.where(F.col("n_words") >= least)
    by_score = sorted(((r["score"], r["n"]) for r in ok.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # distinct integers of a bounded range
    want, cut, seen = percent * sum(n for _, n in by_score) // 100, None, 0
    for cut, n in by_score if want else []:
        seen += n
        if seen >= want:
            break
    out = ["key", "n_features", "weight", "score"]
    if cut is None:
        return rows.select(F.col("key").alias(key), *out[1:], F.lit(None).cast("long").alias("rank"))
    can = (F.col("n_words") >= least) & (F.col("score") >= cut)
    ranked = numbered(spark, rows.where(can), folder, "ranked", seen, F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("n_features").asc())
    ranked = ranked.select(*out, F.when(F.col("place") < want, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(rows.where(~can).select(*out, F.lit(None).cast("long").alias("rank"))).withColumnRenamed("key", key)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_FEATURES = "SELECT unnest(regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w"
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, {_FEATURES.format(t="text").removeprefix("SELECT ")} FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM ({_FEATURES.format(t="text")} FROM benchmark) GROUP BY 1),
v AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), 2 * i::INT + 1, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % {BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dw JOIN v USING (w) GROUP BY 1), t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM bw JOIN v USING (w) GROUP BY 1),
al AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS a_s, coalesce((SELECT sum(t) FROM t), 0) AS a_t),
g AS (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (a_s + {BUCKETS}) / ((coalesce(s, 0) + 1) * (a_t + {BUCKETS}))))::BIGINT AS g FROM (SELECT DISTINCT bucket FROM v) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), al),
f AS (SELECT r, sum(n)::BIGINT AS n, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY 1),
p AS (SELECT d.r, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN f USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, {PERCENT} * count(*) OVER () // 100 AS most FROM p WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN rank <= most THEN rank END::BIGINT AS rank FROM p LEFT JOIN k USING (r)
"""
