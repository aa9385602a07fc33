"""Language model, joins, archives, repeats, pipeline: brute force on small tables, edge cases, the paths of large groups."""

import collections
import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm, ngramjoin, queries, repeats, warc

# -- language model -------------------------------------------------------------------------------


def brute_lm(rows):
    own = []
    total = collections.Counter()
    for t in rows:
        w = (t or "").encode().lower().split()
        c = collections.Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        own.append((w, c))
        total.update(c)
    n_all = sum(len(w) for w, _ in own)
    for w, c in own:
        s = 0.0
        for j in range(len(w)):
            for back, n in enumerate(range(min(3, j + 1), 0, -1)):
                g = tuple(w[j - n + 1 : j + 1])
                if total[g] - c[g] > 0:
                    s += math.log((total[g] - c[g]) / (total[g[:-1]] - c[g[:-1]] if n > 1 else n_all - len(w))) + back * math.log(0.4)
                    break
            else:
                s += math.log(1 / (n_all - len(w) + 1)) + min(3, j + 1) * math.log(0.4)
        yield len(w), s if w else None


def test_lm_against_brute_force(spark, edge, empty, edge_rows, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 40_000)
    got = sorted(((r["n_words"], None if r["log_score"] is None else round(r["log_score"], 3)) for r in lm.lm_scores(spark, edge).collect()), key=str)
    want = sorted(((n, None if s is None else round(s, 3)) for n, s in brute_lm([r[1] for r in edge_rows])), key=str)
    assert len(got) == len(want) and all(a[0] == b[0] and (a[1] == b[1] or abs(a[1] - b[1]) < 0.01) for a, b in zip(got, want, strict=True))
    assert lm.lm_scores(spark, empty).count() == 0


def test_lm_query(spark, sf, docs):
    got = {r["doc_id"]: r["log_score"] for r in queries.QUERIES["op5_lm_scoring"](spark, sf).collect()}
    want = dict(zip([i for i, _ in docs], brute_lm([t for _, t in docs]), strict=True))
    assert all((got[i] is None) == (s is None) and (s is None or abs(got[i] - s) < 0.01) for i, (_, s) in want.items())


def test_count_table(spark):
    df = spark.createDataFrame([("a b a",), ("b a",), (None,)], "text string")
    rows = lm.count_table(df, 2).collect()
    assert sorted((r["n"], r["count"]) for r in rows) == [(1, 2), (1, 3), (2, 1), (2, 2)]


# -- joins ----------------------------------------------------------------------------------------


def sets_of(rows):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_components(rows):
    s = sets_of(rows)
    up = list(range(len(s)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                up[max(top(a), top(b))] = min(top(a), top(b))
    best = {}
    for i in range(len(s)):
        if s[i][0] is not None:
            best[top(i)] = min(best.get(top(i), s[i][0]), s[i][0])
    return sorted(((s[i][0], len(s[i][1]), best.get(top(i))) for i in range(len(s))), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_join_edges(spark, edge, empty, edge_rows):
    got = ngramjoin.near_duplicates(spark, edge)
    assert result(got) == brute_components([(r[0], r[1]) for r in edge_rows])
    assert ngramjoin.near_duplicates(spark, empty).count() == 0


def families(seed, n, size):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7)))
    rows, i = [], 0
    for f in range(n):
        base = [word() for _ in range(80 + 40 * f)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4, 6, 9])):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("large,block", [(128, 64), (10, 4)])
def test_join_of_near_copies(spark, monkeypatch, large, block):
    """The second case sends every family down the path of large groups: one typical node, then blocks of the rest."""
    monkeypatch.setattr(ngramjoin, "LARGE", large)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "SHINGLES", 2000)
    rows = families(3, 3, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(ngramjoin.near_duplicates(spark, df)) == brute_components(rows)


def test_prefixes_lose_no_pair():
    r = np.random.default_rng(0)
    for _ in range(60):
        base = r.integers(0, 400, 60)
        sets = []
        for _ in range(12):
            x = base.copy()
            at = r.integers(0, 60, r.integers(0, 12))
            x[at] = r.integers(400, 430, len(at))
            sets.append(np.unique(x))
        df = collections.Counter(int(v) for s in sets for v in s)
        group = []
        for s in sets:
            t = sorted((int(v) for v in s if df[int(v)] > 1), key=lambda v: (df[v], v))
            k = len(t) - -(-80 * len(s) // 100) + 1
            if k > 0:
                group.append([len(s), np.array(t), np.array([df[v] for v in t]), k, frozenset(s.tolist())])
        got = {tuple(p) for p in ngramjoin.linked([g[:4] for g in group], 80).tolist()}
        want = {(i, j) for i in range(len(group)) for j in range(i + 1, len(group)) if 5 * len(group[i][4] & group[j][4]) >= 4 * len(group[i][4] | group[j][4])}
        assert got == want


def test_join_query(spark, sf, docs):
    assert result(queries.QUERIES["op6_ngram_jaccard_join"](spark, sf)) == brute_components(docs)


# -- archives -------------------------------------------------------------------------------------


def test_loser_tree():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        parts = [sorted((f"{r.randrange(40):03d}", r.random()) for _ in range(r.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(p) for p in parts])) == sorted(sum(parts, []))


def test_archives(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 3)
    monkeypatch.setattr(warc, "PER_RANGE", 40)
    p = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(7777, None, None), (None, "http://x", "y" * 2000), (None, "http://x", "y" * 2000), (7778, "http://x/\r\nbad", "y" * 2000), (7779, "http://X:99999/p", "é" * 3), (7779, "http://X", "é" * 3), (7780, "no url [", "y" * 999), (7781, "u", "y" * 999)], "page_id long, url string, html string")
    p = p.union(p.selectExpr("page_id + 100000", "url", "html").limit(20)).union(odd).withColumn("digest", F.lit("clash")).repartition(6)
    rows = p.collect()
    got = warc.archive(spark, p).collect()
    same = collections.defaultdict(list)
    for r in rows:
        same[r["html"] or ""].append(r["page_id"])
    want = []
    for r in rows:
        b = (r["html"] or "").encode()
        top = max((x for x in same[r["html"] or ""] if x is not None), default=None)
        to = top if len(b) >= 1000 and top is not None and r["page_id"] != top else None
        want.append((r["page_id"], len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted(((r["page_id"], r["payload_bytes"], r["digest"], r["kind"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    order = [(r["url_key"], r["captured"]) for r in sorted(got, key=lambda r: (r["range"], r["nth"]))]
    assert order == sorted(order, key=lambda x: " ".join(x)) and len({r["range"] for r in got}) > 1


def test_no_pages(spark):
    assert warc.archive(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damaged_record_is_told():
    raw = gzip.decompress(warc.record("response", 1, "http://a", hashlib.sha1(b"x").digest(), b"x", None))
    assert warc.parse(raw)["bytes"] == 1
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"\r\n\r\nx\r\n", b"\r\n\r\ny\r\n"))


# -- repeats --------------------------------------------------------------------------------------


def brute_repeats(texts, n):
    count = collections.Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out.append((len(b), int(gone.sum()), int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)), hashlib.sha256(kept).hexdigest()))
    return out


def test_maximal_repeats_against_brute_force():
    r = random.Random(5)
    for _ in range(25):
        a = r.choice(["ab", "abc", "abcdefgh"])
        base = ["".join(r.choice(a) for _ in range(r.randrange(120))).encode() for _ in range(4)]
        t, least = [base[0][3:60] + base[1], base[2] + base[0][:50] + b"zz", base[1], base[3] * 3, base[0]], r.choice([8, 15, 30])
        at = collections.defaultdict(set)
        for i, x in enumerate(t):
            for s in range(len(x)):
                for n in range(least, len(x) - s + 1):
                    at[x[s : s + n]].add((i, s))
        want = []
        for s, o in at.items():
            side = lambda f: len({f(i, p) for i, p in o}) > 1 or any(isinstance(f(i, p), int) for i, p in o)  # noqa: E731,B023
            if len(o) > 1 and side(lambda i, p: t[i][p - 1 : p] if p else -1) and side(lambda i, p: t[i][p + len(s) : p + len(s) + 1] if p + len(s) < len(t[i]) else -1):  # noqa: B023
                want.append((len(s), tuple(sorted(o))))
        assert sorted((n, tuple(sorted(o))) for n, o in repeats.maximal_repeats(t, least)) == sorted(want)


def planted(seed=1):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("etaoin shrdlu\n") for _ in range(n))
    p, q, e = text(900), text(400), "é" * 150 + text(300)
    rows = [text(r.randrange(300, 900)) + r.choice([p, q, p[200:700], e, ""]) + text(r.randrange(50, 700)) for _ in range(60)]
    rows += [p + text(100) + p, text(50) * 30, "ab" * 900, "ba" * 700, q, q, q[:399], text(399), p[:450] + text(30) + p[450:], e + e]
    return list(enumerate(rows))


@pytest.mark.parametrize("large", [200, 1])
def test_repeats_against_brute_force(spark, monkeypatch, large):
    """The second case sends every anchor down the path of large ones."""
    monkeypatch.setattr(repeats, "LARGE", large)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r[1:5]) for r in sorted(repeats.remove_repeats(spark, df).collect(), key=lambda r: r["doc_id"])]
    assert got == brute_repeats([t for _, t in rows], 400)


def test_repeats_edges(spark, edge, empty, edge_rows):
    rows = repeats.remove_repeats(spark, edge.drop("key", "node")).collect()
    rows2 = repeats.remove_repeats(spark, edge).collect()
    assert len(rows) == len(rows2) == len(edge_rows)
    want = sorted(brute_repeats([r[1] for r in edge_rows], 400))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == want == sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows2)
    assert repeats.remove_repeats(spark, empty).count() == 0


def test_repeats_query(spark, sf, docs):
    got = {r["doc_id"]: tuple(r[1:]) for r in queries.QUERIES["op9_suffix_array_dedup"](spark, sf).collect()}
    assert [got[i][:4] for i, _ in docs] == brute_repeats([t for _, t in docs], 400)
    assert [got[i][4] > 0 for i, _ in docs] == [n > 0 for n in brute_passages([t for _, t in docs])]


def brute_passages(texts, n=51):
    """Words of each text in runs of n words that another row has too; of equal runs of one text the first counts."""
    words = [(t or "").encode().split() for t in texts]
    at = collections.defaultdict(set)
    for i, w in enumerate(words):
        for j in range(len(w) - n + 1):
            at[tuple(w[j : j + n])].add(i)
    out = []
    for i, w in enumerate(words):
        on = np.zeros(len(w), bool)
        for j in range(len(w) - n + 1):
            if len(at[tuple(w[j : j + n])]) > 1:
                on[j : j + n] = True
        out.append(int(on.sum()))
    return out


@pytest.mark.parametrize("large", [200, 1])
def test_passages_against_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(repeats, "LARGE", large)
    r = random.Random(8)
    words = lambda n: [r.choice("abcdefgh") * r.randrange(1, 9) + str(r.randrange(99)) for _ in range(n)]
    p, q = words(51), words(130)
    rows = [" ".join(words(r.randrange(0, 90)) + r.choice([p, q, q[20:71], q[20:70], p[1:], []]) + words(r.randrange(60))) for _ in range(80)]
    rows += ["\n".join(p), " ".join(p[:50]), " ".join(words(200) * 2), "a b " * 40, "a b " * 40, "c d " * 60, None, "", "é " * 60]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = [x["passage_words"] for x in sorted(repeats.remove_repeats(spark, df).collect(), key=lambda x: x["doc_id"])]
    assert got == brute_passages(rows)


@pytest.mark.parametrize("large", [200, 3])
def test_repeat_groups(spark, monkeypatch, large):
    """All occurrences of a group have the same bytes, at least two; together they cover just what is removed; no group is missing an occurrence."""
    monkeypatch.setattr(repeats, "LARGE", large)
    rows = [*planted(2), (900, None), (901, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    raw = {i: (t or "").encode() for i, t in rows}
    groups = collections.defaultdict(set)
    for x in repeats.repeat_groups(spark, df).collect():
        groups[x["group"], x["length"]].add((x["doc_id"], x["offset"]))
    on = {i: np.zeros(len(b), bool) for i, b in raw.items()}
    for (_, n), at in groups.items():
        first = next(iter(at))
        s = raw[first[0]][first[1] : first[1] + n]
        assert n >= 400 and len(at) > 1 and all(raw[i][o : o + n] == s for i, o in at)
        for i, o in at:
            on[i][o : o + n] = True
    assert {i: int(v.sum()) for i, v in on.items()} == {i: b[1] for (i, _), b in zip(rows, brute_repeats([t for _, t in rows], 400), strict=True)}


# -- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as cp
    from tidemark.llm import mixing, secrets, toxicity
    from tidemark.llm.common import table

    src = table(spark, sf, "documents")
    model = toxicity.train(src, table(spark, sf, "labels"))
    want = {i: t for i, t in docs if model.score(t) < toxicity.THRESHOLD}
    a = cp.toxicity(spark, src, sf)
    assert tuple(a.columns) == cp.COLUMNS and {r["doc_id"] for r in a.collect()} == set(want)
    a = a.cache()
    b = cp.near_duplicate(spark, a, sf).cache()
    keep = {c for _, _, c in brute_components(list(want.items()))}
    assert {r["doc_id"] for r in b.collect()} == keep and b.count() == len(keep)
    c = cp.secrets(spark, b, sf).cache()
    net = secrets.model()
    assert {r["doc_id"]: r["text"] for r in c.collect()} == {i: secrets.redacted(want[i], secrets.scan(want[i], net)[1]) for i in keep}
    d = cp.mixing(spark, c, sf).cache()
    n = collections.Counter(r["doc_id"] for r in d.collect())
    assert n == collections.Counter(r["doc_id"] for r in mixing.mix(c).collect()) and set(n) <= keep
    e = cp.pieces(spark, d, sf)
    assert e.count() == d.count() and e.where("not lossless").count() == 0
    whole = cp.run(spark, sf)
    assert sorted((r["doc_id"], r["text"], r["pieces"]) for r in whole.collect()) == sorted((r["doc_id"], r["text"], r["pieces"]) for r in e.collect())


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline as cp

    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words), (1, "an unlike text of the same id"), (1, "and a third one of this id"), (2, words + " more"), (None, words), (None, "only here without an id"), (3, None), (3, ""), (4, "only four words here"), (4, "only four words here")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicate(spark, df, "").collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[2], rows[5], rows[6], rows[7], rows[8]], key=str)


def test_pipeline_on_edges(spark, edge, empty, tmp_path):
    import corpus_pipeline as cp

    for name, df in (("edge", edge), ("empty", empty)):
        df.select(*cp.COLUMNS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (15, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = cp.run(spark, f"{tmp_path}/{name}")
        assert out.where("not lossless").count() == 0 and (name == "edge" or out.count() == 0)
