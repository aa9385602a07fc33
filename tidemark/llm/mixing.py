"""Mixing sources to target weights by Poisson replication.

A document's number of copies is the inverse of the Poisson distribution function at a uniform number hashed from seed
and doc_id, with its source's target repetition rate as mean: weight x target documents / documents of the source. A
mean above MOST_RATE is drawn as a sum of independent draws of equal means of at most MOST_RATE, which has the same
distribution. Copies are exploded (in blocks of BLOCK if a row can have many) and shuffled globally by a hashed key.
All expressions are built in; the rates are a table with one row for each source, joined by broadcast only below a
checked number of sources and else with the documents' side split by AQE. The shuffle deals by the hashed key, so that
a hot source spreads evenly.

Defined results: a null source is a source of its own; null texts and repeated rows count and copy like others (equal
doc_ids draw equal numbers); a null doc_id draws as the text 'null'; an empty table gives an empty one; further
columns pass through, and columns named like the added ones give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_TASKS, fresh, input_bytes, table

SEED = "mix-1"
FLATTEN = 0.5  # the default weights: proportional to a source's documents to this power
MOST_RATE = 64.0  # a mean above this is drawn in parts: the table of the distribution function would grow without need
TERMS = 160  # of the distribution function: at a mean of 64 the rest is below 1e-20
BLOCK = 1 << 16  # copies of a row that are made at once


def uniform(what: str, *cols) -> F.Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5: the same in any engine. cols: names or columns."""
    key = F.concat_ws("|", F.lit(SEED), F.lit(what), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, target: float | None = None, source: str = "source") -> DataFrame:
    """source_key, rate: target repetition rates. weights: by source, those not named get 0; target: documents wanted (all there are)."""
    n = docs.groupBy(F.coalesce(F.col(source), F.lit("null")).alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(FLATTEN))
    else:
        w = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("source_key")], F.lit(0.0))
    n = n.withColumn("w", w)
    all_n, all_w = n.agg(F.sum("n"), F.sum(F.round("w", 6))).first()  # two numbers
    want = float(target if target is not None else all_n or 0)
    return n.select("source_key", F.round(F.col("w") / F.lit(float(all_w or 1)) * F.lit(want) / F.col("n"), 9).alias("rate"))


def distribution(rate: F.Column) -> F.Column:
    """The Poisson distribution function at 0, 1, ... as an array."""
    step = lambda a, k: F.struct((a["p"] * rate / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c"))
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(TERMS), F.ceil(rate * 4 + 16).cast("int"))), zero, step, lambda a: a["c"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, target: float | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs, each as often as drawn, with copy (from 0) and shuffle_key, dealt and ordered by the latter."""
    docs = docs.drop("copy", "shuffle_key")
    of, from_, draws, cdf, u, n, b = fresh(docs, "_source", "_key", "_draws", "_cdf", "_u", "_n", "_b")
    r = rates(docs, weights, target, source).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("long"))
    sources, most = r.agg(F.count(F.lit(1)), F.max("rate")).first()
    few = sources <= 10_000  # rows of at most TERMS numbers
    r = r.select(F.col("source_key").alias(from_), F.col("draws").alias(draws), distribution(F.col("rate") / F.col("draws")).alias(cdf))
    df = docs.withColumn(of, F.coalesce(F.col(source), F.lit("null"))).join(F.broadcast(r) if few else r, F.col(of) == F.col(from_))
    parts = min(MOST_TASKS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // (32 << 20)))
    zero = F.lit(0).cast("long")
    drawn = lambda x: F.size(F.filter(cdf, lambda c: c <= x)).cast("long")
    df = df.withColumn(u, uniform("copies", key)).withColumn(n, drawn(F.col(u)))
    if (most or 0) > MOST_RATE:  # the further draws of a large mean have numbers of their own
        further = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col(draws) - 1), zero, lambda a, i: a + drawn(uniform("copies", key, i)))
        df = df.withColumn(n, F.col(n) + F.when(F.col(draws) > 1, further).otherwise(zero))
    some = lambda a: F.explode(F.when(F.col(n) > 0, a))  # noqa: E731  # not a filter: Spark 4.1 moves one to the rates, which lack the row's number
    if (most or 0) > BLOCK // 2:  # blocks are dealt first, so that the copies of one row aren't made by one task
        df = df.drop(cdf).withColumn(b, some(F.sequence(zero, F.floor((F.col(n) - 1) / BLOCK)))).repartition(parts, F.xxhash64(key, b))
        df = df.withColumn("copy", F.explode(F.sequence(F.col(b) * BLOCK, F.least(F.col(n), (F.col(b) + 1) * BLOCK) - 1))).drop(b)
    else:
        df = df.withColumn("copy", some(F.sequence(zero, F.col(n) - 1)))
    df = df.withColumn("shuffle_key", uniform("order", key, "copy")).drop(of, from_, draws, cdf, u, n)
    return df.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key", key, "copy")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "shuffle_key", "lang", "n_chars", "text")


ORACLE_SQL = f"""
WITH RECURSIVE s AS (SELECT coalesce(source, 'null') AS sk, count(*) AS n, power(count(*)::DOUBLE, {FLATTEN}) AS w FROM documents GROUP BY 1),
a AS (SELECT sum(n)::DOUBLE AS all_n, sum(round(w, 6)) AS all_w FROM s),
r AS (SELECT sk, round(w / all_w * all_n / n, 9) AS rate FROM s, a),
c AS (SELECT sk, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cum FROM r
      UNION ALL SELECT sk, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) FROM c WHERE k + 1 <= least({TERMS}, ceil(rate * 4 + 16))),
d AS (SELECT *, coalesce(source, 'null') AS sk, ('0x' || substr(md5('{SEED}|copies|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, d.u, (SELECT count(*) FROM c WHERE c.sk = d.sk AND c.cum <= d.u) AS n FROM d),
e AS (SELECT *, unnest(range(0, n)) AS copy FROM n WHERE n > 0)
SELECT doc_id, source, copy, ('0x' || substr(md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS shuffle_key,
       lang, n_chars, text FROM e
"""
