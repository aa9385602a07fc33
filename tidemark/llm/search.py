"""Ranked lexical search: the highest-scoring documents for each item of a query set, with classes of equal bags scored once.

1. Items are taken in groups whose text is bounded, so that what a task holds of them is bounded, too; each group's
   pass goes over all documents. A document's bag is its term counts restricted to the group's vocabulary.
2. Documents with equal bags and equal length factor m have equal scores for all items of the group: they are one class.
   Classes are grouped by hash, and by bag and m themselves, so that equal hashes alone join nothing. What is kept of
   them here is their size and smallest doc_id, which is combined before the shuffle.
3. Document frequencies are sums of class sizes. A class's integer impacts (weight x saturated frequency) are multiplied
   with the items' term counts; a task keeps each item's best classes by (score, smallest doc_id), which are enough: each
   has a document that comes before all documents of classes after it.
4. The best classes of each item are expanded: documents of these classes, of each class those first by doc_id, limited
   before the shuffle, so that a class with very many documents costs no more than others.

Scores are sums of 64-bit integers: doubles hold them exactly while a bound of the largest is below 2^53, beyond which
the kernel multiplies integers.

Defined results: a null text has no terms; items without terms and items that nothing matches return no rows; repeated
items are ranked each for itself; repeated documents each take a rank; a null doc_id comes after others of its score;
texts are whole; empty tables give an empty one; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, discard, emit, shared_dir, staged, table
from .importance import words

TOP = 20
DAMPING = 25  # of length, of 100
GROUP_BYTES = 1 << 20  # of item texts that one pass holds
CELLS = 1 << 22  # of a task's table of items by terms
BLOCK = 256  # classes that are ranked at once
MOST_IMPACT = 1_000_000  # an impact is below that times its term's weight


def grouped_items(items: DataFrame, group_bytes: int, key: str, text: str) -> DataFrame:
    """item (a number), key, text, group: groups hold some group_bytes of text, or one item."""
    rows = items.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    groups = max(1, -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes))
    return rows.withColumn("item", F.monotonically_increasing_id()).withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)))


def lengths(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """key, n, bag: the number of terms, and (term, count) of those in the vocabulary by term, as 32-bit numbers."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches, out):
        for b in batches:
            n, bags = [], []
            for t in b.column("text").to_pylist():
                w = words(t)
                ids, tf = np.unique(np.fromiter((i for i in map(vocabulary.get, w) if i is not None), np.int32), return_counts=True)
                n.append(len(w))
                bags.append(np.stack([ids, tf.astype(np.int32)]).tobytes())
            yield out([b.column("key").to_pylist(), n, bags])

    return emit(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), f"key {kind}, n long, bag binary", each)


def frequencies(classes: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term: class sizes, summed in each task first."""

    def each(batches, out):
        total = np.zeros(terms, np.int64)
        for b in batches:
            for bag, size in zip(b.column("bag").to_pylist(), b.column("size").to_pylist(), strict=True):
                ids = np.frombuffer(bag, np.int32)
                total[ids[: len(ids) // 2]] += size
        some = np.flatnonzero(total)
        yield out([some, total[some]])

    df = np.zeros(terms, np.int64)
    for r in emit(classes.select("bag", "size"), "term int, n long", each).groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the group
        df[r["term"]] = r["n"]
    return df


def best_classes(classes: DataFrame, items: list[tuple[int, dict[int, int]]], weights: np.ndarray, top: int) -> DataFrame:
    """item, score, bag, m, hash, first: of each task, each item's `top` classes by (score, first). items: (number, term counts)."""
    kind = classes.schema["first"].dataType.simpleString()
    longest = max((sum(c.values()) for _, c in items), default=0)
    exact = int(weights.max(initial=0)) * MOST_IMPACT * longest < 1 << 53

    def each(batches, out):
        number = np.array([i for i, _ in items])
        wide = max(1, CELLS // max(1, len(weights)))
        tables = []
        for at in range(0, len(items), wide):
            q = np.zeros((len(weights), min(wide, len(items) - at)), np.float64 if exact else np.int64)
            for j, (_, counts) in enumerate(items[at : at + wide]):
                q[list(counts), j] = list(counts.values())
            tables.append(q)
        held_s, held_c = np.zeros((0, len(items)), np.int64), np.zeros((0, len(items)), np.int64)  # scores, and positions in kept
        kept: dict[int, tuple] = {}
        seen = 0

        def rank(scores: np.ndarray, rows: list[tuple]) -> None:
            """Merges a block's scores with those held: best score first, then the smallest doc_id."""
            nonlocal held_s, held_c, kept, seen
            new = dict(enumerate(rows, seen))
            seen += len(rows)
            floor = held_s[-1] if len(held_s) == top else np.zeros(len(items), np.int64)
            some = np.flatnonzero((scores >= np.maximum(floor, 1)).any(1))
            if not len(some):
                return
            ids = np.fromiter(new, np.int64)[some]
            all_s = np.concatenate([held_s, scores[some]])
            all_c = np.concatenate([held_c, np.broadcast_to(ids[:, None], (len(ids), len(items)))])
            known = kept | {i: new[i] for i in ids.tolist()}
            used = np.unique(all_c)
            order = sorted(used.tolist(), key=lambda i: (known[i][4] is None, known[i][4] if known[i][4] is not None else 0))
            place = np.empty(len(used), np.int64)
            place[np.searchsorted(used, order)] = np.arange(len(order))
            by = np.lexsort((place[np.searchsorted(used, all_c)], -all_s), axis=0)[:top]
            held_s, held_c = np.take_along_axis(all_s, by, 0), np.take_along_axis(all_c, by, 0)
            kept = {i: known[i] for i in np.unique(held_c[held_s > 0]).tolist()}
            held_c = np.where(held_s > 0, held_c, held_c.flat[np.argmax(held_s)] if (held_s > 0).any() else 0)
            if not kept:
                held_s, held_c = held_s[:0], held_c[:0]

        for b in batches:
            names = ["bag", "m", "hash", "size", "first"]
            rows = list(zip(*[b.column(c).to_pylist() for c in names], strict=True))
            for at in range(0, len(rows), BLOCK):
                part = rows[at : at + BLOCK]
                scores = np.zeros((len(part), len(items)), np.int64)
                for i, (bag, m, *_) in enumerate(part):
                    ids = np.frombuffer(bag, np.int32)
                    ids, tf = ids[: len(ids) // 2], ids[len(ids) // 2 :].astype(np.int64)
                    if len(ids):
                        impact = weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                        scores[i] = np.concatenate([(impact.astype(q.dtype) @ q[ids]).astype(np.int64) for q in tables])
                rank(scores, part)
        r, c = np.nonzero(held_s > 0)
        got = [kept[i] for i in held_c[r, c].tolist()]
        yield out([number[c], held_s[r, c], [g[0] for g in got], [g[1] for g in got], [g[2] for g in got], [g[4] for g in got]])

    return emit(classes.select("bag", "m", "hash", "size", "first"), f"item long, score long, bag binary, m long, hash long, first {kind}", each)


def search_group(spark: SparkSession, docs: DataFrame, items: list, folder: str, top: int, damping: int, key: str, text: str) -> DataFrame:
    """item, rank, key, score for a group of items: rows of (number, text)."""
    counts, vocabulary = [], {}
    for number, t in items:
        c: dict[int, int] = {}
        for w in words(t.encode()):
            i = vocabulary.setdefault(w, len(vocabulary))
            c[i] = c.get(i, 0) + 1
        counts.append((number, c))
    bags = staged(spark, lengths(docs, key, text, vocabulary), folder, "bags")
    many, long = bags.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    m = F.lit(100 - damping).cast("long") + (F.expr(f"({damping}L * n * {many or 0}L) div {long}L") if long else F.lit(0))
    bags = bags.where("n > 0").select("key", "bag", m.alias("m")).withColumn("hash", F.xxhash64("bag", "m"))
    first = F.min(F.col("key"))
    classes = bags.where("bag != X''").groupBy("hash", "bag", "m").agg(F.count(F.lit(1)).alias("size"), first.alias("first"))
    classes = staged(spark, classes, folder, "classes")
    df = frequencies(classes, len(vocabulary))
    weights = np.floor(1000 * np.log((2 * (many or 0) + 2) / (2.0 * df + 1))).astype(np.int64)
    best = best_classes(classes, counts, weights, top)
    by_best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("first").asc_nulls_last())
    best = staged(spark, best.withColumn("at", F.row_number().over(by_best)).where(F.col("at") <= top).drop("at"), folder, "best", small=True)
    chosen = best.select("hash", "bag", "m").distinct()
    rows, held = best.agg(F.count(F.lit(1)), F.sum(F.octet_length("bag"))).first()
    if (held or 0) + 24 * rows < 8 << 20:  # the size is checked; beyond it the join shuffles
        chosen = F.broadcast(chosen)
    by_key = Window.partitionBy("hash", "bag", "m").orderBy(F.col("key").asc_nulls_last())
    found = bags.join(chosen, ["hash", "bag", "m"]).withColumn("at", F.row_number().over(by_key)).where(F.col("at") <= top).drop("at")
    found = staged(spark, found, folder, "found", small=True)
    by_rank = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    out = best.drop("first").join(found, ["hash", "bag", "m"]).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    out = staged(spark, out.select("item", "rank", "key", "score"), folder, "ranks", small=True)
    discard(spark, folder, "bags", "classes", "best", "found")
    return out


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP, damping: int = DAMPING, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item key, rank, key, score: each item's `top` documents with a score above 0."""
    arrow_rows(spark)
    folder = shared_dir(spark)
    all_items = staged(spark, grouped_items(items, group_bytes, item, item_text), folder, "items")
    groups = sorted(r["group"] for r in all_items.select("group").distinct().collect())
    out = None
    for g in groups:
        rows = [(r["item"], r["text"]) for r in all_items.where(F.col("group") == g).collect()]  # of bounded text
        part = search_group(spark, docs, rows, f"{folder}/{g}", top, damping, key, text)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"item long, rank int, key {docs.schema[key].dataType.simpleString()}, score long")
    names = all_items.select("item", F.col("key").alias("item_key"))
    return out.join(names, "item").select(F.col("item_key").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{_TERM}') AS t FROM documents),
n AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0), a AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
tf AS (SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS w FROM d) GROUP BY ALL),
i AS (SELECT item_id, w, count(*)::BIGINT AS q FROM (SELECT item_id, unnest(regexp_extract_all({_LOW}, '{_TERM}')) AS w FROM benchmark) GROUP BY ALL),
w AS (SELECT w, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, a GROUP BY w, n_docs),
s AS (SELECT item_id, r, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * ({100 - DAMPING} + ({DAMPING} * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN tf USING (w) JOIN w USING (w) JOIN n USING (r), a GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN n USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
