"""Whole chains against planted truth and brute force."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import components as C
from tidemark.plans import chains, planted
from tidemark.plans.base import cut


def test_components_of_a_spiral(spark):
    """One long component whose first run is far from its last, one beside it, one alone; an empty window."""
    art = ["#####.#", "....#..", "###.#.#", "#...#.#", "#####..", ".......", "##..##."]
    rows = [(w, r, c, x == "#" and w == 1) for w in (1, 2) for r, line in enumerate(art) for c, x in enumerate(line)]
    got = C.components(spark.createDataFrame(rows, "window int, row int, col int, hit boolean"), cut).groupBy("window", "label").count().collect()
    assert sorted(x["count"] for x in got) == [1, 2, 2, 2, 17] and {x["window"] for x in got} == {1}


def test_components_against_flood_fill(spark):
    m = np.random.default_rng(4).random((3, 25, 25)) < 0.42
    rows = [(int(w), int(r), int(c), bool(m[w, r, c])) for w, r, c in np.ndindex(m.shape)]
    got = {(x["window"], x["row"], x["col"]): x["label"] for x in C.components(spark.createDataFrame(rows, "window int, row int, col int, hit boolean"), cut).collect()}
    seen = {}
    for at in zip(*np.nonzero(m), strict=True):
        todo = [] if at in seen else [at]
        while todo:
            w, r, c = p = todo.pop()
            if p in seen or not (0 <= r < 25 and 0 <= c < 25) or not m[p]:
                continue
            seen[p] = at
            todo += [(w, r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert len(got) == len(seen)
    pairs = {(seen[k], (k[0], got[k])) for k in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_sampling_is_seeded(spark):
    df = spark.range(50).select((F.col("id") % 5).alias("window"), F.col("id").alias("key"))
    a, b, c = ({x["window"]: x["key"] for x in C.sampled(df, s).collect()} for s in (1, 1, 2))
    assert a == b != c and len(a) == 5


def test_air_attacks(spark, sf):
    got = {x["attack"]: (x["status"], x["treated_n"]) for x in chains.air_attacks(spark, sf).collect()}
    made = planted.air_attacks(156)
    assert set(got) == set(made) and got["silent"][1] == 2
    for a, (_, may) in made.items():
        assert got[a][0] in may, (a, got[a])


def test_air_power(spark, sf):
    got = {x["effect"]: x for x in chains.air_power(spark, sf, [0.0, -6.0], 3).collect()}
    assert got[0.0]["REAL"] == 0 and got[-6.0]["REAL"] >= 2


def test_two_baselines(spark, sf):
    got = chains.fusion_audit(spark, sf).collect()
    assert len(got) == 4 and all((x["optical_year"], x["radar_year"]) == (2021, 2023) and x["optical_p"] <= 0.1 and x["radar_p"] <= 0.1 for x in got)


def test_red_edge_leads(spark, sf):
    got = chains.disease_lead(spark, sf).collect()
    assert len(got) == 4 and all(x["lead"] > 0 and abs(x["rededge"] - int(x["role"].split()[1])) <= 4 for x in got)


def test_texture_tells_weeds(spark, sf):
    got = {(x["role"], x["verdict"]): x["n"] for x in chains.texture_verdicts(spark, sf).collect()}
    assert got == {("cover", "MANAGED COVER CROP"): 4, ("weeds", "LIKELY WEEDS"): 4, ("bare", "NO COVER"): 16}


def test_wider_controls(spark, sf):
    got = {x["verdict"]: (x["status"], x["wide"]) for x in chains.wide_verdicts(spark, sf).collect()}
    assert got == {"regional": ("REAL", True), "alone": ("REAL", False)}


def test_dates_cannot_be_chosen(spark, sf):
    assert all(x["dates"] == 4 and x["reals"] == 0 for x in chains.date_selection(spark, sf).collect())


def test_hours_become_weeks(spark, sf):
    """The planted fall is there beside what the season (which stays in the weeks) does to all, the week of the event is gone, the station without months has a receipt."""
    got = {x["unit"]: x for x in chains.air_chain(spark, sf).collect()}
    moved = {u: got[u]["after"] - got[u]["before"] for u in "01234"}
    rest = [moved[u] for u in "1234"]
    assert max(rest) - min(rest) < 0.1 and abs(moved["0"] - np.mean(rest) + 4) < 0.1
    assert got["5"]["reason"] == "coverage" and got["5"]["weeks"] is None and got["1"]["weeks"] == 155  # 156 whole weeks less the mixed one


def test_gates(spark, sf):
    got = {x["gate"]: (x["reals"], x["n"]) for x in chains.gate_attack(spark, sf).collect()}
    reals, n = got.pop("none")
    assert reals == n > 0 and all(x == (0, n) for x in got.values()) and set(got) == set(chains.beyond_gates())


def test_water_is_spared(spark, sf):
    got = {x["spell"]: x for x in chains.flood_attack(spark, sf).collect()}
    assert got[3]["without_water"] > 0.5 > got[25]["without_water"] and all(x["with_water"] == 0 for x in got.values())


def test_a_lasting_fall_stays(spark, sf):
    got = chains.despike_attack(spark, sf).collect()
    assert len(got) == 3 and all(x["lost"] <= 2 and x["series"] == 30 for x in got)


def test_relaxed_gate_lets_nothing_through(spark, sf):
    r = chains.relaxation(spark, sf).first()
    assert r["fits"] == 3 and r["let_through_real"] == 0 and r["reals"] == 0


def test_as_of_across_slots(spark):
    """Against a brute force: hot keys over many slots, ties, keys and times that are missing, a limit on the age."""
    from tidemark.operators import windows as W

    r = np.random.default_rng(3)
    make = lambda n, off: [(int(i) + off, None if i % 50 == 7 else int(r.integers(0, 3)) // 2, None if i % 60 == 9 else int(r.integers(0, 3000))) for i in range(n)]
    ev, lo = make(300, 0), make(60, 1000)
    table = lambda rows: spark.createDataFrame(rows, "id long, key int, s long").withColumn("ts", F.timestamp_seconds("s"))
    for within in (None, 90):
        got = {x["id"]: x["lookup_id"] for x in W.as_of(table(ev), table(lo).withColumn("x", F.col("id")), within_s=within, slot_s=100).collect()}
        for i, k, s in ev:
            may = [(t, j) for j, q, t in lo if None not in (q, t, k, s) and q == k and t <= s]
            want = max(may)[1] if may and (within is None or s - max(may)[0] <= within) else None
            assert got[i] == want, (i, k, s)
        assert len(got) == len(ev)


def test_step_up_in_parts(spark):
    """As the definition says, over ties, missing values and families, however the range of p is cut."""
    from tidemark.functions.stats import step_up

    r = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], None if i % 13 == 5 else round(float(r.random() ** (4 if i % 3 else 1)), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, f string, p double")

    def brute(part):
        ps = sorted(p for *_, p in part if p is not None)
        cut = max((p for i, p in enumerate(ps, 1) if p <= 0.05 * (i + ps[i:].count(p)) / len(ps)), default=-1)
        return {i for i, _, p in part if p is not None and p <= cut}

    for parts in (1, 7, 4096):
        assert {x["id"] for x in step_up(df, parts=parts).where("found").collect()} == brute(rows)
        assert {x["id"] for x in step_up(df, family="f", parts=parts).where("found").collect()} == brute([x for x in rows if x[1] == "a"]) | brute([x for x in rows if x[1] == "b"])
