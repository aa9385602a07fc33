"""LM scoring: stupid backoff from n-gram counts of the whole corpus, each document scored by the others' counts.

The relations are: grams(order, gram, block, n) exploded from the documents, counts(order, gram, n) partitioned by hash
range and summed from them, and their join, summed per document. As rows, two thirds of a billion grams of a gigabyte
would be shuffled at some 20 bytes each. They travel packed instead: documents are dealt to blocks of bounded size; a
block explodes its n-grams and sends each hash range its distinct hashes, sorted and as differences, with their numbers;
a range's task merges what all blocks sent - that is the range's part of the count table - and answers each block with
the totals of its own grams, in the same order. The block joins them by position to its documents' grams and sums the
logarithms for each document. A frequent gram is one entry of a block, however often it occurs.

A document's own occurrences are subtracted (else every gram would have been seen). With c the counts of the other
documents: c(abc)/c(ab) if c(abc) > 0, else ALPHA times c(bc)/c(b) if c(bc) > 0, else ALPHA^2 c(c)/N if c(c) > 0, else
ALPHA^3/(N + 1), N the other documents' words. The first word has no context to back off from, the second one word.

Words are lower-cased runs without ASCII white space; grams are told apart by hashes of BITS bits (of 10^10 different
grams, one in seven million has another's count added). Defined results: a null or empty text
has no words and a null score; texts are scored whole; repeated rows are documents of their own and support each other;
a null doc_id is a document like others; one document alone scores ALPHA^k for every word; an empty table gives an empty
one; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_TASKS, WordHash, arrow_rows, bucket_count, deal_buckets, emit, ngram_hashes, pack, pack_sorted, places, ranges, runs, shared_dir, staged, table, unpack, unpack_sorted

ORDER = 3
ALPHA = 0.4
BITS = 56
BLOCK_BYTES = 20 << 20  # of text, for a block
BUCKET_BYTES = 8 << 20  # of text, for a range of the hash space


def words_of(text: str | None, words: WordHash) -> np.ndarray:
    return words((text or "").encode().lower().split())


def gram_keys(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams in their upper BITS bits: what is shorter travels shorter, and 2 ** BITS is far above any corpus's grams."""
    return ngram_hashes(h, n) >> np.uint64(64 - BITS)


def labels(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n blocks that Spark's hash puts into a partition of its own; from 4,096 on chance deals evenly enough."""
    if n > 4096:
        return []
    ids = spark.range(n * 40 + 400).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    got = {r["p"]: r["id"] for r in ids.collect()}  # a number for each block
    return [int(got.get(i, i)) for i in range(n)]


def grams(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, block, n, keys, nums: the distinct n-grams of each block and range. docs (block, text): a block in one partition."""

    def each(batches, out):
        words, block, held = WordHash(), None, []

        def flush():
            for n in range(1, order + 1):
                keys, nums = np.unique(np.concatenate([gram_keys(h, n) for h in held]), return_counts=True)
                at = ranges(keys, buckets, BITS)
                yield out([[i for i, _, _ in at], [block] * len(at), [n] * len(at), [pack_sorted(keys[a:z]) for _, a, z in at], [pack(nums[a:z].astype(np.uint32)) for _, a, z in at]])

        for k, rows in runs(batches, "block", ["text"]):
            if k != block and held:
                yield from flush()
                held = []
            block = k
            held += [words_of(r[0], words) for r in rows]
        if held:
            yield from flush()

    return emit(docs, "bucket int, block int, n int, keys binary, nums binary", each)


def totals(packed: DataFrame, buckets: int) -> DataFrame:
    """block, n, bucket, nums: for each block's grams of a range, in their order, how often all blocks have them."""

    def each(batches, out):
        for bucket, rows in runs(batches, "bucket", ["block", "n", "keys", "nums"]):
            for n in sorted({r[1] for r in rows}):
                mine = [r for r in rows if r[1] == n]
                keys = [unpack_sorted(r[2]) for r in mine]
                table_keys, back = np.unique(np.concatenate(keys), return_inverse=True)
                table_nums = np.bincount(back, np.concatenate([unpack(r[3], np.uint32) for r in mine])).astype(np.uint64)
                got = table_nums[back]
                for r, part in zip(mine, np.split(got, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
                    yield out([[r[0]], [n], [bucket], [pack(part)]])

    return emit(deal_buckets(packed, buckets), "block int, n int, bucket int, nums binary", each)


def count_table(docs: DataFrame, order: int = ORDER, text: str = "text") -> DataFrame:
    """n, gram (hash), count: the corpus's counts, partitioned by range of the hash."""
    buckets = bucket_count(docs.sparkSession, docs, 4 << 20)

    def each(batches, out):
        for _, rows in runs(batches, "bucket", ["n", "keys", "nums"]):
            for n in sorted({r[0] for r in rows}):
                keys, back = np.unique(np.concatenate([unpack_sorted(r[1]) for r in rows if r[0] == n]), return_inverse=True)
                nums = np.bincount(back, np.concatenate([unpack(r[2], np.uint32) for r in rows if r[0] == n])).astype(np.int64)
                for i in range(0, len(keys), 100_000):
                    yield out([[n] * len(keys[i : i + 100_000]), keys[i : i + 100_000].view(np.int64), nums[i : i + 100_000]])

    packed = grams(docs.select(F.lit(0).alias("block"), F.col(text).alias("text")), order, buckets)
    return emit(deal_buckets(packed, buckets), "n int, gram long, count long", each)


def others(h: list[np.ndarray], n: int, nums: np.ndarray) -> np.ndarray:
    """For the n-grams of all documents, one after another: how often the other documents have them. nums: totals of the block's distinct grams."""
    size = np.array([max(0, len(x) - n + 1) for x in h])
    back = places(np.concatenate([gram_keys(x, n) for x in h])) if len(h) else np.zeros(0, np.int32)
    out = nums[back].astype(np.float64)
    for a, z in zip(np.cumsum(size) - size, np.cumsum(size), strict=True):
        own, at, count = np.unique(back[a:z], return_inverse=True, return_counts=True)
        out[a:z] -= count[at]
    return out


def scores(h: list[np.ndarray], nums, order: int) -> list[tuple[float, int, int]]:
    """For each document: the sum of the logarithms of its words without what the corpus's size enters, the words scored
    by their own frequency, and the words that no other document has. nums(n): totals of the block's distinct n-grams.
    """
    size = np.array([len(x) for x in h], np.int64)
    begin = np.cumsum(size) - size
    word = np.arange(int(size.sum())) - np.repeat(begin, size)  # place in its document
    longest = np.minimum(word + 1, order)
    value, backed = np.zeros(len(word)), np.zeros(len(word), np.int8)
    level = np.zeros(len(word), np.int8)  # the order that a word was scored at
    upper = others(h, order, nums(order))
    for n in range(order, 0, -1):
        lower = others(h, n - 1, nums(n - 1)) if n > 1 else None
        ends = np.flatnonzero(word >= n - 1)  # the last word of each n-gram, in the grams' order
        wanted = (level[ends] == 0) & (longest[ends] >= n)
        hit = wanted & (upper > 0)
        at = ends[hit]
        value[at] = np.log(upper[hit])
        if lower is not None:  # the (n-1)-gram that the n-gram begins with stands where the word before ends
            place = np.cumsum(np.where(word >= n - 2, 1, 0)) - 1
            value[at] -= np.log(lower[place[at - 1]])
        level[at] = n
        backed[ends[wanted & ~hit]] += 1
        upper = lower
    value += backed * np.log(ALPHA)
    own, unseen = level == 1, level == 0
    total = lambda x: np.add.reduceat(np.append(x, 0), begin)[: len(h)] * (size > 0) if len(h) else x[:0]
    return list(zip(total(value).tolist(), total(own.astype(np.int64)).tolist(), total(unseen.astype(np.int64)).tolist(), strict=True))


def lm_scores(spark: SparkSession, docs: DataFrame, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, log_score (sum of natural logarithms), mean_log_score for each row of docs."""
    arrow_rows(spark)
    # As many blocks as shuffles have partitions at least: then the join below keeps this partitioning, and the texts move once.
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_BYTES)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    i = F.pmod(F.xxhash64("key", "text"), F.lit(n)).cast("int")
    names = labels(spark, n)
    block = F.element_at(F.array(*[F.lit(x) for x in names]), i + 1) if names else i
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("block", block).repartition(min(n, MOST_TASKS), "block")
    rows = rows if names else rows.sortWithinPartitions("block")
    answers = totals(grams(rows, order, buckets), buckets)
    kind = docs.schema[key].dataType.simpleString()

    def each(left, right):
        import pyarrow as pa

        words = WordHash()
        h = [words_of(t.as_py(), words) for t in left.column("text")]
        words.seen.clear()
        sent = sorted(zip(*[right.column(c).to_pylist() for c in ("n", "bucket", "nums")], strict=True), key=lambda r: r[:2])
        nums = lambda k: np.concatenate([unpack(r[2], np.uint64) for r in sent if r[0] == k] or [np.zeros(0, np.uint64)])
        got = scores(h, nums, order)
        return pa.table([left.column("key"), pa.array([len(x) for x in h], pa.int64()), *[pa.array([g[j] for g in got], t) for j, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]], names=["key", "n_words", "value", "own", "unseen"])

    made = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(each, f"key {kind}, n_words long, value double, own long, unseen long")
    # The corpus's size is known once all documents are counted: rows of five numbers are kept, so that no scan is made for it.
    made = staged(spark, made, shared_dir(spark), "scores")
    total = made.agg(F.sum("n_words")).first()[0] or 0
    rest = F.lit(total) - F.col("n_words")
    score = F.when(F.col("n_words") > 0, F.col("value") - F.col("own") * F.log(F.greatest(rest, F.lit(1))) - F.col("unseen") * F.log(rest + 1))
    return made.select(F.col("key").alias(key), "n_words", score.alias("log_score"), (score / F.col("n_words")).alias("mean_log_score"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lm_scores(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))
