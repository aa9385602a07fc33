"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of at least t, and their components.

1. Sets. Each text becomes the sorted distinct hashes of its word shingles; texts with equal sets are one node.
2. Document frequencies. Blocks of documents exchange their shingles packed and sorted by ranges of the hash space; a
   range's task counts each shingle's nodes. A shingle of one node can match nothing: it is only counted, and rows go on
   for the others. All later steps work on these, and on the nodes that have enough of them to be linked at all.
3. Prefixes. The total order is (document frequency, hash). A pair of similarity t shares at least ceil(t n) shingles of
   either side, so at least l among the first n - ceil(t n) + l of both. Each node picks the l, and with it the length
   of its prefix, whose estimated cost (postings to scan, plus candidates - postings / l - times the cost of comparing
   a set of its size) is least; a pair is compared only if it shares l tokens in its prefixes of the smaller l of both.
4. Groups. Nodes that share any token of their shortest prefixes, directly or by others, form a group: only there can
   links be. A small group is compared at once. A large one falls apart: pairs that share only tokens of at most COLD
   nodes come from joining the lengthened prefixes on them, with at least l hits, and are verified one by one; what
   tokens of more nodes connect stays a group. If that is still large, its nodes are first compared with its most
   typical node; those linked with it are known to be one component, so that only the rest meets, in blocks of bounded
   size, the group's blocks. No long posting list is expanded into pairs, and no task holds a whole group.
5. Links found go into components().

Shingles are compared by 64-bit hashes. Defined results: a null text is empty; texts without words have no shingles and
are linked with nothing; with fewer words than n the whole sequence is the one shingle; texts are whole; repeated rows
share a component; rows with equal doc_id are judged each by its own text; a null doc_id has component_id null unless
a row linked with it has one; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_TASKS, WordHash, arrow_rows, bucket_count, components, deal_buckets, emit, lists, ngram_hashes, pack, pack_sorted, ranges, runs, shared_dir, staged, table, to_long, unpack, unpack_sorted

LEVELS = (1, 2, 3, 4, 6, 8)
BLOCK = 64  # nodes of a block when a large group is compared in blocks
LARGE = 128  # nodes of a group that is compared at once at most
COLD = 16  # nodes that have a token, up to which it doesn't hold a large group together
SHINGLES = 1_500_000  # of a block in the exchange


def shingles(text: str | None, n: int, words: WordHash) -> np.ndarray:
    """Sorted distinct hashes; letters A-Z are lowered, and words are what bytes.split() gives: runs without ASCII white space."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    return np.unique(ngram_hashes(words(w), min(n, len(w))))


def node_of(s: np.ndarray) -> int | None:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def members(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """key, n_shingles, node for each row."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches, out):
        words = WordHash()
        for b in batches:
            sets = [shingles(t, n, words) for t in b.column("text").to_pylist()]
            yield out([b.column("key").to_pylist(), [len(s) for s in sets], [node_of(s) for s in sets]])

    return emit(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), f"key {kind}, n_shingles long, node long", each)


def exchange(docs: DataFrame, n: int, text: str, buckets: int) -> DataFrame:
    """bucket, keys, who, nodes, sizes: of each block and range, sorted shingles and the positions of their nodes, packed."""

    def each(batches, out):
        words, sets, seen = WordHash(), [], {}

        def flush():
            keys = np.concatenate([s for s, _ in sets])
            who = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s, _ in sets])
            nodes, sizes = np.array([v for _, v in sets], np.int64), np.array([len(s) for s, _ in sets], np.uint32)
            order = np.argsort(keys, kind="stable")
            keys, who, cols = keys[order], who[order], [[], [], [], [], []]
            for i, lo, hi in ranges(keys, buckets):
                used, back = np.unique(who[lo:hi], return_inverse=True)
                for c, v in zip(cols, (i, pack_sorted(keys[lo:hi]), pack(back.astype(np.uint32)), pack(nodes[used]), pack(sizes[used])), strict=True):
                    c.append(v)
            sets.clear()
            seen.clear()
            return out(cols)

        held = 0
        for b in batches:
            for t in b.column("text").to_pylist():
                s = shingles(t, n, words)
                v = node_of(s)
                if v is not None and v not in seen:
                    seen[v] = True
                    sets.append((s, v))
                    held += len(s)
                if held >= SHINGLES:
                    yield flush()
                    held = 0
        if sets:
            yield flush()

    return emit(docs.select(F.col(text).alias("text")), "bucket int, keys binary, who binary, nodes binary, sizes binary", each)


def shared(packed: DataFrame, buckets: int) -> DataFrame:
    """node, n, df, token: for each shingle that more than one node has, its nodes."""

    def each(batches, out):
        for _, rows in runs(batches, "bucket", ["keys", "who", "nodes", "sizes"]):
            keys, nodes, sizes = [], [], []
            for k, w, v, s in rows:
                w = unpack(w, np.uint32)
                keys.append(unpack_sorted(k))
                nodes.append(unpack(v, np.int64)[w])
                sizes.append(unpack(s, np.uint32)[w])
            keys, nodes, sizes = np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            many = np.zeros(len(keys), bool)
            same = keys[1:] == keys[:-1]
            many[1:] |= same
            many[:-1] |= same
            order, keys = order[many], keys[many]
            nodes, sizes = nodes[order], sizes[order]
            order = np.lexsort((nodes, keys))  # a node that several blocks have counts once
            keys, nodes, sizes = keys[order], nodes[order], sizes[order]
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            keys, nodes, sizes = keys[once], nodes[once], sizes[once]
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            df = np.diff(np.append(heads, len(keys)))
            df = np.repeat(df, df)
            two = df > 1
            for i in range(0, int(two.sum()), 200_000):
                part = slice(i, i + 200_000)
                yield out([nodes[two][part], sizes[two][part].astype(np.int64), df[two][part].astype(np.int32), to_long(keys[two])[part]])

    return emit(deal_buckets(packed, buckets), "node long, n long, df int, token long", each)


def records(postings: DataFrame, percent: int) -> DataFrame:
    """node, n, tokens and dfs in the total order, base (tokens of the shortest prefix that others have), of nodes that can be linked."""
    df = postings.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    need = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    return df.select("node", "n", F.col("t.token").alias("tokens"), F.col("t.df").alias("dfs"), (F.size("t") - need + 1).alias("base")).where("base > 0")


def level(n: int, dfs: np.ndarray, base: int) -> int:
    """The l of least estimated cost."""
    scan = np.cumsum(dfs - 1)
    best, least = 1, None
    for k in LEVELS:
        if base + k - 1 > len(dfs):
            break
        posts = float(scan[base + k - 2])
        cost = posts + posts / k * (5 + 0.05 * n)
        if least is None or cost < least:
            best, least = k, cost
    return best


def _overlaps(rows: list[np.ndarray], chunk: int = 16384) -> np.ndarray:
    """Sizes of all intersections among a bounded number of sets, by dense products over ranges of the vocabulary."""
    vocab, ids = np.unique(np.concatenate(rows), return_inverse=True) if rows else (np.zeros(0), np.zeros(0, int))
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(ids, kind="stable")
    ids, who = ids[order], who[order]
    total = np.zeros((len(rows), len(rows)))
    for lo in range(0, len(vocab), chunk):
        a, b = np.searchsorted(ids, [lo, lo + chunk])
        m = np.zeros((len(rows), min(chunk, len(vocab) - lo)), np.float32)
        m[who[a:b], ids[a:b] - lo] = 1
        total += m @ m.T
    return total


def linked(group: list, percent: int) -> np.ndarray:
    """Pairs (i, j) of positions in group that are linked. group: n, tokens, dfs, base of each node."""
    n = np.array([g[0] for g in group])
    ls = np.array([level(g[0], g[2], g[3]) for g in group])
    cand = np.zeros((len(group), len(group)), bool)
    for k in np.unique(ls):
        at = np.flatnonzero(ls >= k)  # at this l, the pairs whose smaller l it is
        hits = _overlaps([group[i][1][: group[i][3] + k - 1] for i in at]) >= k
        cand[np.ix_(at, at)] |= hits & (np.minimum.outer(ls[at], ls[at]) == k)
    cand &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
    cand = np.triu(cand, 1)
    live = np.flatnonzero(cand.any(0) | cand.any(1))
    if not len(live):
        return np.zeros((0, 2), int)
    both = _overlaps([group[i][1] for i in live])
    ok = (100 * both >= percent * (np.add.outer(n[live], n[live]) - both)) & cand[np.ix_(live, live)]
    return live[np.argwhere(ok)]


def forest(pairs: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    up = list(range(size))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in pairs.tolist():
        a, b = top(i), top(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def prefixes(recs: DataFrame) -> DataFrame:
    """node, n, l, token, at: the lengthened prefixes; from level at on, up to the node's l, a token belongs to the prefix."""

    def each(batches, out):
        for b in batches:
            for v, n, tokens, dfs, base in zip(b.column("node").to_pylist(), b.column("n").to_pylist(), lists(b.column("tokens")), lists(b.column("dfs")), b.column("base").to_pylist(), strict=True):
                k = level(n, dfs, base)
                size = base + k - 1
                yield out([np.full(size, v), np.full(size, n), np.full(size, k), tokens[:size], np.maximum(1, np.arange(size) - base + 2)])

    return emit(recs.select("node", "n", "tokens", "dfs", "base"), "node long, n long, l int, token long, at int", each)


def grouped(spark: SparkSession, posts: DataFrame, folder: str, name: str) -> DataFrame:
    """node, comp, size: the groups of nodes that tokens of posts (node, token) connect, of more than one node."""
    hubs = staged(spark, posts.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", "hub"), folder, f"{name}-hubs", small=True)
    star = posts.join(hubs, "token").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    group = components(spark, star, folder, name)
    sizes = staged(spark, group.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), folder, f"{name}-sizes", small=True)
    return staged(spark, group.join(sizes, "comp").select("node", "comp", "size"), folder, f"{name}-of", small=True)


def sparse_links(spark: SparkSession, posts: DataFrame, recs: DataFrame, of: DataFrame, folder: str, percent: int) -> DataFrame:
    """a, b: links between nodes that aren't of one group of `of`. posts: prefixes whose tokens at most COLD nodes have."""
    side = lambda x: posts.select("token", *[F.col(c).alias(c + x) for c in ("node", "n", "l", "at")])
    pairs = side("1").join(side("2"), "token").where("node1 < node2 and 100 * least(n1, n2) >= greatest(n1, n2) * " + str(percent) + " and greatest(at1, at2) <= least(l1, l2)")
    pairs = pairs.groupBy("node1", "node2").agg(F.count(F.lit(1)).alias("hits"), F.first(F.least("l1", "l2")).alias("l")).where("hits >= l").select("node1", "node2")
    group = lambda x: of.select(F.col("node").alias("node" + x), F.col("comp").alias("comp" + x))
    pairs = pairs.join(group("1"), "node1", "left").join(group("2"), "node2", "left").where("comp1 is null or comp2 is null or comp1 != comp2").select("node1", "node2")
    pairs = staged(spark, pairs, folder, "candidates", small=True)
    sets = lambda x: recs.select(*[F.col(c).alias(c + x) for c in ("node", "n", "tokens")])

    def verify(batches, out):
        for b in batches:
            a, z, ok = b.column("node1").to_pylist(), b.column("node2").to_pylist(), []
            for n1, t1, n2, t2 in zip(b.column("n1").to_pylist(), lists(b.column("tokens1")), b.column("n2").to_pylist(), lists(b.column("tokens2")), strict=True):
                both = len(np.intersect1d(t1, t2, assume_unique=True))
                ok.append(100 * both >= percent * (n1 + n2 - both))
            yield out([[v for v, k in zip(a, ok, strict=True) if k], [v for v, k in zip(z, ok, strict=True) if k]])

    return emit(pairs.join(sets("1"), "node1").join(sets("2"), "node2"), "a long, b long", verify)


def links(spark: SparkSession, recs: DataFrame, folder: str, percent: int) -> DataFrame:
    """a, b: links that connect what is linked. recs: a table of records()."""
    posts = recs.select("node", F.explode(F.slice("tokens", F.lit(1), F.col("base"))).alias("token"))
    of = grouped(spark, posts, folder, "groups")
    df = staged(spark, recs.join(of, "node"), folder, "grouped")

    # Large groups fall apart: only tokens of many nodes hold a group together, pairs that share others are counted.
    split = df.where(F.col("size") > LARGE)
    posts = staged(spark, prefixes(split), folder, "prefixes")
    counts = staged(spark, posts.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), folder, "counts", small=True)
    hot = posts.join(counts.where(F.col("c") > COLD).select("token"), "token", "left_semi").select("node", "token")
    of = grouped(spark, hot, folder, "hot")
    sparse = staged(spark, sparse_links(spark, posts.join(counts.where(F.col("c") <= COLD).select("token"), "token", "left_semi"), split, of, folder, percent), folder, "sparse", small=True)
    df = staged(spark, df.where(F.col("size") <= LARGE).unionByName(split.drop("comp", "size").join(of, "node")), folder, "regrouped")

    large = df.where(F.col("size") > LARGE)
    typical = large.groupBy("comp").agg(F.min_by(F.struct(F.col("node").alias("h"), F.col("n").alias("hn"), F.col("tokens").alias("ht")), F.struct((F.col("n") - F.size("tokens")) / F.col("n"), F.col("node"))).alias("x"))
    typical = staged(spark, typical.select("comp", "x.*"), folder, "typical", small=True)

    def near(batches, out):
        for b in batches:
            ok = []
            for n, t, hn, ht in zip(b.column("n").to_pylist(), lists(b.column("tokens")), b.column("hn").to_pylist(), lists(b.column("ht")), strict=True):
                both = len(np.intersect1d(t, ht, assume_unique=True))
                ok.append(100 * both >= percent * (n + hn - both))
            yield out([b.column("node").to_pylist(), b.column("h").to_pylist(), ok])

    star = emit(large.join(typical, "comp").select("node", "n", "tokens", "h", "hn", "ht"), "node long, h long, core boolean", near)
    star = staged(spark, star, folder, "star")

    # Blocks: of small groups one; of large ones the core's and the rest's, of which only pairs with the rest meet.
    pick = lambda size: F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(size / BLOCK)).cast("int")).cast("int")
    parts = large.select("node", "comp").join(star.select("node", "core"), "node").groupBy("comp").agg(F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_rest"))
    parts = staged(spark, parts, folder, "parts", small=True)
    few = df.where(F.col("size") <= LARGE).select("node", "n", "tokens", "dfs", "base", F.concat_ws(":", "comp").alias("task"))
    big = large.join(star.select("node", "core"), "node").join(parts, "comp").where("n_rest > 0")
    rest_blocks, core_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_rest") / BLOCK)).cast("int"), F.greatest(F.lit(1), F.ceil(F.col("n_core") / BLOCK)).cast("int")
    mine = F.when(F.col("core"), F.concat(F.lit("c"), pick(F.col("n_core")).cast("string"))).otherwise(F.concat(F.lit("r"), F.format_string("%09d", pick(F.col("n_rest")))))
    rest = F.transform(F.sequence(F.lit(0), rest_blocks - 1), lambda i: F.concat(F.lit("r"), F.format_string("%09d", i)))
    cores = F.transform(F.sequence(F.lit(0), core_blocks - 1), lambda i: F.concat(F.lit("c"), i.cast("string")))
    others = F.when(F.col("core"), rest).otherwise(F.concat(rest, cores))
    big = big.withColumn("mine", mine).withColumn("other", F.explode(others))
    big = big.select("node", "n", "tokens", "dfs", "base", F.concat_ws(":", "comp", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"))

    def compare(batches, out):
        for _, rows in runs(batches, "task", ["node", "n", "tokens", "dfs", "base"]):
            if len(rows) > 1:
                got = forest(linked([r[1:] for r in rows], percent), len(rows))
                if got:
                    yield out([[rows[i][0] for i, _ in got], [rows[j][0] for _, j in got]])

    n = min(MOST_TASKS, bucket_count(spark, recs, 4 << 20))
    dealt = few.union(big).repartition(n, "task").sortWithinPartitions("task")
    found = emit(dealt, "a long, b long", compare)
    return found.union(star.where("core").select(F.col("node").alias("a"), F.col("h").alias("b"))).union(sparse)


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key that links reach), node (equal for equal sets)."""
    arrow_rows(spark)
    folder = shared_dir(spark)
    buckets = bucket_count(spark, docs, 4 << 20)
    mem = staged(spark, members(docs, n, key, text), folder, "members")
    recs = staged(spark, records(shared(exchange(docs, n, text, buckets), buckets), percent), folder, "records", small=True)
    edges = staged(spark, links(spark, recs, folder, percent), folder, "links")
    comp = components(spark, edges, folder, "components")
    reps = mem.where("node is not null").groupBy("node").agg(F.min("key").alias("first"))
    reps = reps.join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "first")
    reps = staged(spark, reps, folder, "reps", small=True)
    ids = staged(spark, reps.groupBy("comp").agg(F.min("first").alias("component_id")), folder, "ids", small=True)
    of = staged(spark, reps.join(ids, "comp").select("node", "component_id"), folder, "of-node", small=True)
    out = mem.join(of, "node", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id"), "node")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
