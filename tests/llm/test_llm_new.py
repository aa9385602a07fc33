"""Importance resampling, ranked search, recompression: brute force on edge rows, SQL on the smallest tables, hot and periodic cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import common, importance, ngramjoin, queries, recompress, repeats, search


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_ranked_search", "op13_substring_dedup"])
def test_same_as_sql(name, spark, sf, duck, same):
    same(queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLES[name]).df())


# -- importance resampling ------------------------------------------------------------------------


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_resample(rows, target, percent, least, most, buckets, seed):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = collections.Counter(bucket(f) for _, x in rows for f in feats(x)[1]), collections.Counter(bucket(f) for x in target for f in feats(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for i, x in rows:
        n, f = feats(x)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    can = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(can[: percent * len(can) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


@pytest.mark.parametrize(("most", "buckets", "percent"), [(1, 10_000, 50), (2, 97, 30), (1, 64, 0)])
def test_resample_against_brute_force(spark, edge, edge_rows, most, buckets, percent):
    target = ["the token of base words", None, "a b c d e a b c", " ".join(f"w{i % 7}" for i in range(90))]
    got = importance.resample(spark, edge, spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, most, buckets, 7).collect()
    want = brute_resample([r[:2] for r in edge_rows], target, percent, 20, most, buckets, 7)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_resample_empty_tables(spark, edge, empty):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(spark, empty, none).count() == 0
    assert importance.resample(spark, edge, none).count() == edge.count()


def test_sliced_sums_are_exact():
    r = np.random.default_rng(3)
    gain = r.integers(-30_000, 30_000, 1000)
    rows, buckets = np.repeat(np.arange(20), 50), np.concatenate([np.sort(r.choice(1000, 50, replace=False)) for _ in range(20)])
    counts = r.integers(1, 1 << 20, 1000)
    want = np.zeros(20, np.int64)
    np.add.at(want, rows, counts * gain[buckets])
    assert (importance.sliced_sums(counts, rows, buckets, 20, importance.gain_planes(gain)) == want).all()
    assert (importance.sliced_sums(counts, rows, buckets, 20, importance.gain_planes(gain * 0)) == 0).all()


# -- ranked search --------------------------------------------------------------------------------


def brute_search(rows, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    docs = [(i, collections.Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms, df = len(docs), sum(n for *_, n in docs), collections.Counter(w for _, c, _ in docs for w in c)
    for k, t in items:
        q, found = collections.Counter(terms(t)), []
        for i, c, n in docs:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(f * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w, f in q.items() if w in c)
            if s > 0:
                found.append((s, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        yield from ((k, r, i, s) for r, (s, i) in enumerate(found[:top], 1))


ITEMS = [(1, "the TOKEN is here, here"), (2, None), (3, ""), (4, "a b c d e a a"), (4, "stupid idiot he said"), (None, "token end line"), (6, "nowhere0 to-be-found9"), (7, "line a line")]


@pytest.mark.parametrize(("group", "block", "cells", "impact"), [(1 << 20, 256, 1 << 22, 1), (4, 3, 8, 1), (1 << 20, 2, 5, 1 << 40)])
def test_search_against_brute_force(spark, edge, edge_rows, monkeypatch, group, block, cells, impact):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "MOST_IMPACT", search.MOST_IMPACT * impact)  # beyond 2^53 the kernel multiplies integers
    got = search.search(spark, edge, spark.createDataFrame(ITEMS, "item_id long, text string"), top=4, group_bytes=group).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_search([r[:2] for r in edge_rows], ITEMS, 4), key=key)


def test_search_on_many_copies_and_empty_tables(spark, empty):
    rows = [(i, "red fox jumps" if i % 3 else f"red hen {i}") for i in range(3000)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame(ITEMS + [(9, "fox hen red"), (10, "hen")], "item_id long, text string")
    got = sorted(tuple(r) for r in search.search(spark, docs, items).collect())
    assert got == sorted(brute_search(rows, ITEMS + [(9, "fox hen red"), (10, "hen")], 20))
    assert search.search(spark, empty, items).count() == 0
    assert search.search(spark, docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


# -- recompression --------------------------------------------------------------------------------


def brute_dedup(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            g = tuple(w[j : j + window])
            first[g] = min(first.get(g, order(i)), order(i))
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < order(i):
                gone.update(range(j, j + window))
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()


def compare(spark, df, rows, window):
    got = recompress.substring_dedup(spark, df, window).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_dedup(rows, window), key=str)


@pytest.mark.parametrize(("window", "chunk"), [(50, 400_000), (12, 1000), (1, 700)])
def test_dedup_against_brute_force(spark, edge, edge_rows, monkeypatch, window, chunk):
    monkeypatch.setattr(recompress, "CHUNK", chunk)
    compare(spark, edge, [r[:2] for r in edge_rows], window)


def test_dedup_on_shared_passages_and_periods(spark):
    """Passages in very many documents, chains of overlapping ones, periodic and low-entropy texts."""
    r = random.Random(8)
    word = lambda k: f"w{r.randrange(k)}"
    passage, small = [word(500) for _ in range(90)], [word(2) for _ in range(400)]
    rows = [(i, " ".join([word(900) for _ in range(r.randrange(30))] + passage + [word(900) for _ in range(r.randrange(30))])) for i in range(150)]
    rows += [(200 + i, " ".join(passage[i * 3 : i * 3 + 55])) for i in range(12)]
    rows += [(300 + i, "ab " * (60 + i)) for i in range(12)] + [(320 + i, "ab cd ab ab cd " * (15 + i) + "ef") for i in range(9)] + [(340 + i, "x " * i) for i in (49, 50, 51)]
    rows += [(400 + i, " ".join(small[i * 7 : i * 7 + 120])) for i in range(30)] + [(None, " ".join(passage)), (None, "no other " + " ".join(small[:70])), (7, rows[9][1]), (7, rows[9][1])]
    r.shuffle(rows)
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, 50)


def test_dedup_empty(spark, empty):
    assert recompress.substring_dedup(spark, empty).count() == 0


@pytest.mark.parametrize("letters", [2, 3, 50])
def test_anchors_depend_on_the_window_alone(letters):
    """Equal windows in any surroundings take anchors of equal name at equal offsets."""
    g = np.random.default_rng(letters)
    inner = recompress.mix(g.integers(0, letters, 130).astype(np.uint64))
    seen = {}
    for _ in range(30):
        sides = [recompress.mix(g.integers(0, letters, g.integers(0, 60)).astype(np.uint64)) for _ in range(2)]
        h = np.concatenate([sides[0], inner, sides[1]])
        lo, hi, name, _ = recompress.anchors(h, [len(h)], 50)
        assert lo[0] == 0 and hi[-1] == len(h) - 50 and (lo[1:] == hi[:-1] + 1).all()
        for j in range(len(inner) - 49):
            got = name[np.searchsorted(lo, len(sides[0]) + j, "right") - 1]
            assert seen.setdefault(j, got) == got


# -- components and groups ------------------------------------------------------------------------


@pytest.mark.parametrize("few", [0, 500])
def test_components_of_chains_and_random_graphs(spark, monkeypatch, few):
    from pyspark.sql import functions as F

    rounds, staged = [], common.staged

    def counted(s, df, folder, name, small=False):
        rounds.append(name)
        return staged(s, df, folder, name, small)

    monkeypatch.setattr(common, "staged", counted)
    monkeypatch.setattr(common, "FEW_EDGES", few)
    chain = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.components(spark, chain, common.shared_dir(spark), "chain").agg(F.count(F.lit(1)), F.max("comp")).first()
    assert tuple(got) == (20_001, 0) and sum("-h" in n for n in rounds) < 20
    r = random.Random(3)
    edges, up = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(220)], {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = common.components(spark, spark.createDataFrame(edges, "a long, b long"), common.shared_dir(spark), "random").collect()
    assert {x["node"]: x["comp"] for x in got} == {i: top(i) for a, b in edges if a != b for i in (a, b)}
    assert common.components(spark, spark.createDataFrame([(1, 1)], "a long, b long"), common.shared_dir(spark), "none").count() == 0


def test_chains_of_unlinked_halves_form_no_group(spark, monkeypatch):
    """Documents that share a half with the next one aren't compared with all others of the chain; a planted link in it is found."""
    made, staged = {}, ngramjoin.staged
    monkeypatch.setattr(ngramjoin, "LARGE", 16)

    def counted(s, df, folder, name, small=False):
        made[name] = staged(s, df, folder, name, small)
        return made[name]

    monkeypatch.setattr(ngramjoin, "staged", counted)
    r = random.Random(5)
    halves = [[f"w{r.randrange(10**6)}" for _ in range(40)] for _ in range(301)]
    rows = [(i, " ".join(halves[i] + halves[i + 1])) for i in range(300)]
    rows.append((1000, " ".join(halves[17] + halves[18][:-1] + ["other"])))
    got = {x["doc_id"]: x["component_id"] for x in ngramjoin.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 17 if i == 1000 else i for i, _ in rows}
    assert made["regrouped"].where("size > 16").count() == 0 and made["candidates"].count() <= 320 and made["parts"].count() == 0


# -- repeats within very long texts ---------------------------------------------------------------


def brute_repeats(texts, least):
    seen = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - least + 1):
            seen[t[j : j + least]] = seen.get(t[j : j + least], 0) + 1
    for t in texts:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - least + 1):
            if seen[t[j : j + least]] > 1:
                gone[j : j + least] = True
        yield int(gone.sum())


def test_repeats_in_pieces(spark, monkeypatch):
    """Texts longer than a piece, with repeats across its edges, periods and low entropy."""
    monkeypatch.setattr(repeats, "PIECE", 1500)
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7)))
    plain = " ".join(word() for _ in range(2000))
    texts = [plain, plain[2900:3500] + " " + plain[:450] + " tail", " " * 6000, "ab " * 2500, "x" * 1490 + plain[5000:5600] + "x" * 1490, "".join(r.choice("ab") for _ in range(5000)), plain[6000:6399], "ab " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in repeats.remove_repeats(spark, df).select("doc_id", "n_removed").collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 400)))


def test_segments_of_a_long_blank_text_stay_few(spark):
    text = " " * 3_000_000
    df = spark.createDataFrame([(1, text)], "node long, text string")
    profile = repeats.profile(df).first()
    assert len(profile["anchors"]) == 1 and profile["again"] == [True]
    rows = repeats.segments(spark.createDataFrame([(1, text, profile["anchors"])], "node long, text string, wanted array<long>")).collect()
    assert len(rows) <= 3 and [(x["start"], x["lead"]) for x in rows if x["seg"] is None] == [(0, 3_000_000)]


def test_stages_and_shuffle_files_go_when_read(spark, tmp_path, sf, monkeypatch):
    """A staged table leaves no shuffle files, and substring dedup none of its large tables."""
    from pyspark.sql import functions as F

    files = lambda: sum("shuffle_" in str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split())
    before = files()
    df = common.staged(spark, spark.range(5000).groupBy((F.col("id") % 50).alias("k")).count(), str(tmp_path), "rows")
    assert files() <= before and df.count() == 50
    monkeypatch.setattr(recompress, "shared_dir", lambda _: str(tmp_path / "stages"))
    out = recompress.op13_substring_dedup(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    left = {p.name for p in (tmp_path / "stages").glob("*")}
    assert {"rows", "ids", "cut"} <= left and not left & {"parsed", "texts", "shared", "anchors", "wanted", "prints"}


def test_shares_are_the_longest_common_prefixes(monkeypatch):
    """What a suffix shares with any other, and with one of another document, of suffixes in order; no loop over intervals."""
    r = random.Random(6)
    monkeypatch.setattr(repeats, "intervals", None)
    for _ in range(200):
        rows = sorted(("".join(r.choice("ab") for _ in range(r.randrange(1, 9))), r.randrange(3)) for _ in range(r.randrange(1, 12)))
        common_ = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905, E731
        lcp = np.array([common_(a, b) for (a, _), (b, _) in zip(rows, rows[1:])], np.int64)  # noqa: B905
        who = np.array([d for _, d in rows])
        for w in (None, who):
            want = [max((common_(a, b) for j, (b, e) in enumerate(rows) if (i != j if w is None else d != e)), default=0) for i, (a, d) in enumerate(rows)]
            assert repeats.shares(lcp, w).tolist() == want
    assert repeats.covered([b"x" * 450, b"y" * 30 + b"x" * 420]) == [[(0, 450)], [(30, 450)]]
