"""Problems 1, 3, 4, 5 and 6 against brute force on small fixtures, with NULLs, ties, repeats and empty tables."""

import datetime as dt
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainloom.functions import forest
from rainloom.functions.tree_edit import Node, assignment, edit_script, schema_tree
from rainloom.functions.unit_text import unit_of, unit_said
from rainloom.functions.whole_groups import whole_groups
from rainloom.operators import anomalies, near, regular_grid, schema_drift, units
from rainloom.session import table

T = dt.datetime(2024, 9, 1)
READ = "poste long, field string, time timestamp_ntz, value double"
DEPLOY = "deployment_id long, poste long, field string, step_min int, active_from timestamp_ntz, active_to timestamp_ntz, remarks string"


def minutes(n):
    return T + dt.timedelta(minutes=n)


def test_als_restores_low_rank_and_marks_unsupported():
    rng = np.random.default_rng(3)
    true = rng.normal(0, 1, (60, 2)) @ rng.normal(0, 1, (2, 20)) + 3
    m = true.copy()
    m[rng.random(m.shape) < 0.3] = np.nan
    m[5] = np.nan
    got, ok = regular_grid.als_fill(m, rank=3, ridge=0.01, most_sweeps=200, tolerance=1e-9)
    assert not ok[5] and ok.sum() == 59
    gap = np.isnan(m) & ok[:, None]
    assert np.abs(got - true)[gap].mean() < 0.1
    source = np.repeat([0, 1, 2], [40, 5, 30])
    v = np.where(rng.random(75) < 0.2, np.nan, np.sin(np.arange(75) / 5) + 2)
    v[10:30], v[40:45] = np.nan, [1, np.nan, np.nan, np.nan, 2]
    out, fill = regular_grid.fill_series(source, v)
    seen = ~np.isnan(v)
    assert (out[seen] == v[seen]).all() and not fill[seen].any() and (out[fill] >= 0).all()
    assert np.isnan(out[16:20]).all() and np.isnan(out[41:44]).all() and fill[45:].sum() == (~seen[45:]).sum()


@pytest.mark.parametrize("scale", ["sf0.01"])
def test_withheld_cells_beat_the_source_mean(spark, scale):
    folder = f"/root/testdata/{scale}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    x = table(spark, folder, "gauge_series").select("poste", F.lit("precipitation").alias("field"), "time", F.col("precipitation").alias("value"))
    d = table(spark, folder, "deployments").where("field = 'precipitation'")
    seen = regular_grid.regular_grid(x, d).where("status = 'observed'").toPandas()
    held = np.random.default_rng(5).random(len(seen)) < 0.1
    rest = seen[~held].assign(us=seen["slot_epoch"])[["poste", "field", "us", "value", "deployment_id"]]
    readings = spark.createDataFrame(rest).select("poste", "field", F.timestamp_seconds("us").cast("timestamp_ntz").alias("time"), "value")
    out = regular_grid.regular_grid(readings, d).toPandas()
    m = seen[held].merge(out, on=["deployment_id", "poste", "field", "slot_epoch"], suffixes=("", "_got"))
    m["mean"] = m["deployment_id"].map(rest.groupby("deployment_id")["value"].mean())
    m = m[m["status_got"] == "filled"].dropna(subset=["mean"])
    rms = lambda p: float(np.sqrt(((p - m["value"]) ** 2).mean()))
    assert len(m) > 0.95 * held.sum() and rms(m["value_got"]) < 0.85 * min(rms(m["mean"]), rms(0 * m["value"]))


def test_grid_slots(spark):
    d = spark.createDataFrame(
        [(1, 7, "precipitation", 10, T + dt.timedelta(hours=23, minutes=45), minutes(1440 + 30), None), (2, 8, "precipitation", 10, T, minutes(25), None), (3, None, "precipitation", 10, T, minutes(25), None), (4, 9, "precipitation", 0, T, minutes(25), None)],
        DEPLOY,
    )
    r = spark.createDataFrame(
        [(7, "precipitation", minutes(1440 - 15), 1.0), (7, "precipitation", minutes(1440 - 6), 3.0), (7, "precipitation", minutes(1440 - 6), 5.0), (7, "precipitation", minutes(1441), 2.0), (7, "precipitation", minutes(1440 + 14), -1.0), (7, "precipitation", minutes(1440 + 14), float("nan")), (7, "precipitation", None, 1.0), (7, "precipitation", minutes(1440 + 29), 1.0)],
        READ,
    )
    rows = {(x.deployment_id, x.slot_epoch): x for x in regular_grid.regular_grid(r, d).collect()}
    base = int((minutes(1440 - 15) - dt.datetime(1970, 1, 1)).total_seconds())
    one = [rows[1, base + 600 * k] for k in range(4)]
    assert [x.status for x in one] == ["observed", "observed", "unsupported", "unsupported"]
    assert one[0].value == (1 + 3 + 5) / 3 and one[1].value == 2.0 and one[2].value is None
    assert sum(k[0] == 2 for k in rows) == 2 and len(rows) == 6
    assert regular_grid.missing_slots(regular_grid.regular_grid(r, d)).count() == 4
    assert regular_grid.regular_grid(r.limit(0), d.limit(0)).count() == 0


def test_units_in_words(spark):
    depth = {"mm": "mm", " MM ": "mm", "l/m²": "mm", "0,1mm": "tenth_mm", "1/100 de pouce": "hundredth_inch", "µm": "um", '"': "inch", "": None, "furlong": None, "mm/h": None}
    rate = {"mm/h": "mm_h", "kg m-2 s-1": "mm_s", "IPH": "inch_h", "mm/24h": "mm_day", "dixièmes de mm/h": "tenth_mm_h", "m s-1": "m_s", "mm": None}
    x = spark.createDataFrame(list(depth.items()) + [(None, None)], "u string, c string").select("c", unit_of(F.col("u"), "depth").alias("g"))
    assert all(r.c == r.g for r in x.collect())
    x = spark.createDataFrame(list(rate.items()), "u string, c string").select("c", unit_of(F.col("u"), "rate").alias("g"))
    assert all(r.c == r.g for r in x.collect())
    said = {"funnel 8 in wide, replaced": None, "grille 40 µm neuve ; valeur en microns": "um", "unit: in (manual sheet)": "inch", "mât déplacé de 30 cm": None, "pile faible. reading in tenths of a millimetre": "tenth_mm"}
    x = spark.createDataFrame(list(said.items()), "u string, c string").select("u", "c", unit_said(F.col("u"), "depth").alias("g"))
    assert all(r.c == r.g for r in x.collect()), x.collect()


def test_unit_graph():
    g = units.UnitGraph([("inch", "cm", 2.54, 0), ("cm", "mm", 10, 0), ("k", "c", 1, -273.15), ("inch", "mm", 25.4, 0), (None, "mm", 1, 0)])
    steps, f = g.from_unit("inch")["mm"]
    assert steps == 1 and math.isclose(f.scale, 25.4) and g.disagreements() == []
    assert math.isclose(g.from_unit("c")["k"][1].offset, 273.15)
    assert units.UnitGraph([("a", "b", 2, 0), ("b", "c", 3, 0), ("a", "c", 7, 0)]).disagreements()


def test_recorded_unit_order(spark):
    d = spark.createDataFrame([(1, 5, "rr6", 6, minutes(0), minutes(10), "valeur en microns"), (2, 5, "rr6", 6, minutes(20), minutes(30), "ok"), (3, 6, "rr6", 6, minutes(0), None, "reading in tenths of mm")], DEPLOY)
    r = spark.createDataFrame(
        [(1, 5, minutes(5), None, None, 1.0), (2, 5, minutes(15), "", None, 1.0), (3, 5, minutes(25), None, None, 1.0), (4, 5, minutes(5), "cm", "valeur en pouces", 1.0), (5, 5, minutes(5), " ", "valeur en pouces", 1.0), (6, 6, minutes(9000), None, None, 1.0), (7, None, None, None, None, 1.0), (8, 5, minutes(-1), None, None, 1.0)],
        "id long, poste long, time timestamp_ntz, unit string, remark string, value double",
    ).withColumn("field", F.lit("rr6"))
    got = {x.id: x.unit_code for x in units.with_recorded_unit(r, d, "depth").collect()}
    assert got == {x.id: x.unit_code for x in units.with_recorded_unit(r, d, "depth", broadcast_rows=0).collect()}
    assert got == {1: "um", 2: "um", 3: "mm", 4: "cm", 5: "inch", 6: "tenth_mm", 7: "mm", 8: "mm"}


def test_near_pairs_match_brute_force(spark):
    rng = np.random.default_rng(2)
    lat = np.concatenate([rng.uniform(-89, 89, 200), 10 + rng.normal(0, 0.01, 150), [0.0, 0.0, 89.999, 89.999, 10.0, 10.0]])
    lon = np.concatenate([rng.uniform(-180, 180, 200), 20 + rng.normal(0, 0.01, 150), [179.999, -179.999, 0.0, 180.0, 20.0, 20.0]])
    pts = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))]
    df = spark.createDataFrame(pts + pts[:3] + [(None, 1.0, 1.0), (9, None, 2.0)], "id long, lat double, lon double")
    d = near.great_circle(lat[:, None], lon[:, None], lat[None], lon[None])
    want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if d[i, j] <= 2000}
    for kw in ({}, {"per_pivot": 16, "chunk": 20, "cell_pivots": 4, "level_pivots": 12}):
        got = [(r.id_a, r.id_b) for r in near.near_pairs(df, 2000.0, **kw).collect()]
        assert set(got) == want and len(got) == len(want)
    assert near.near_pairs(df.limit(0), 2000.0).count() == 0


def test_positions(spark):
    rows = [(1, 1.0, 350.0, None), (2, None, None, "38°32'12.0\"N  124°12'11.7\"O"), (3, None, None, "53°21,898'S 68°16,918'W"), (4, None, None, "-23.5 202.5"), (5, 0.0, 0.0, "1 1"), (6, 99.0, 1.0, "1 1"), (7, None, None, "n.c."), (8, None, None, None), (9, float("nan"), 1.0, "2 3")]
    got = {r.poste: (r.p_lat, r.p_lon) for r in near.with_position(spark.createDataFrame(rows, "poste long, lat double, lon double, coordinates string")).collect()}
    assert got[1] == (1.0, -10.0) and got[4] == (-23.5, -157.5) and got[9] == (2.0, 3.0)
    assert math.isclose(got[2][0], 38 + 32 / 60 + 12 / 3600) and math.isclose(got[2][1], -(124 + 12 / 60 + 11.7 / 3600))
    assert math.isclose(got[3][0], -(53 + 21.898 / 60)) and all(got[i] == (None, None) for i in (5, 6, 7, 8))


def _readings(spark, values, start=0, poste=1, step=6):
    return [(start + i, poste, "rr6", minutes(step * i), v) for i, v in enumerate(values)]


IMPL = "row_id long, poste long, field string, time timestamp_ntz, value double"


def test_implausible_rules(spark):
    rng = np.random.default_rng(1)
    usual = [round(float(v), 1) for v in rng.gamma(0.4, 1.5, 60)]
    values = usual[:20] + [0.7] * 11 + usual[20:30] + [60.0] + usual[30:] + [-1.0, 200.0]
    rows = _readings(spark, values)
    rows += [(900, 1, "rr6", rows[41][3], 60.0), (901, 1, "rr6", None, 3.0), (902, None, "rr6", minutes(1), 3.0), (903, 1, "rr6", minutes(3), None), (904, 1, "rr6", minutes(3), float("nan"))]
    x = anomalies.implausible(spark.createDataFrame(rows, IMPL), {"rr6": 150.0})
    got = {r.row_id: r for r in x.collect()}
    assert {k for k, r in got.items() if r.stuck} >= set(range(20, 31)) and {k for k, r in got.items() if r.spike} == {41, 900}
    assert {k for k, r in got.items() if r.impossible} == {len(values) - 2, len(values) - 1}
    assert all(r.anomaly for r in got.values() if r.stuck or r.spike or r.impossible) and not {901, 902, 903, 904} & set(got)


def test_runs_across_blocks_and_repeats(spark):
    n = 400  # a run that crosses several blocks of one day
    rows = [(i, 1, "rr6", minutes(12 * i), 1.5 if 50 <= i < 350 else float(i % 3)) for i in range(n)] + [(1000, 1, "rr6", minutes(12 * 60), 1.5)]
    x = spark.createDataFrame(rows, IMPL)
    stuck = lambda run, **kw: {r.row_id for r in anomalies.implausible(x, {"rr6": 150.0}, stuck_run=run, **kw).collect() if r.stuck}
    assert stuck(300, block_us=86_400_000_000) == {*range(50, 350), 1000} and stuck(301, block_us=86_400_000_000) == set()


def test_blocks_change_nothing(spark):
    rng = np.random.default_rng(4)
    values = np.round(rng.gamma(0.3, 2, 900), 1)
    rows = [(i, i % 3, "rr6", minutes(37 * i), float(v)) for i, v in enumerate(values)] + [(2000, 0, "rr6", minutes(0), float(values[0])), (2001, 9, "rr1", T, 5.0)]
    x = spark.createDataFrame(rows, IMPL)
    one, two = ({r.row_id: r for r in anomalies.implausible(x, {"rr6": 150.0}, block_us=b * 86_400_000_000).collect()} for b in (1, 30))
    assert one == two and len(one) == 902 and one[2000].score == one[0].score and one[2000].time == rows[0][3]
    assert anomalies.implausible(x.limit(0), {"rr6": 150.0}).count() == 0


def test_rules_hold_whatever_the_score(spark):
    values = ([0.7] * 12 + [0.0]) * 30  # stuck runs are the usual thing here, so the forest finds them plain
    got = anomalies.implausible(spark.createDataFrame(_readings(spark, values), IMPL), {"rr6": 150.0}).collect()
    assert len(got) == len(values) and min(r.score for r in got if r.stuck) < 0.5
    assert {r.row_id for r in got if r.anomaly} == {i for i, v in enumerate(values) if v > 0}


def test_two_spikes_among_few_positive_readings(spark):
    cases = [([24.8, 42.9], [0.2], 77), ([30.0, 35.0], [0.2, 0.4], 20), ([9.0, 50.0], [0.1, 0.2, 0.3], 40), ([4.5, 5.0], [0.6], 117), ([7.0], [0.1, 0.1, 0.2], 9)]
    rows = []
    for p, (spikes, rest, zeros) in enumerate(cases):
        values = [0.0] * (zeros + len(spikes) + len(rest))
        for i, v in enumerate(spikes + rest):
            values[5 + i * (len(values) - 6) // len(spikes + rest)] = v
        rows += _readings(spark, values, 1000 * p, p)
    got = anomalies.implausible(spark.createDataFrame(rows, IMPL), {"rr6": 150.0}).collect()
    for p, (spikes, _, _) in enumerate(cases):
        assert sorted(r.value for r in got if r.spike and r.poste == p) == spikes, [(r.value, r.score) for r in got if r.value > 0 and r.poste == p]


def test_the_score_decides_about_a_gap(spark):
    level = lambda p, score, above, below=3, zeros=40: [(p, None, 0.0, 0.0, zeros, 0.4 * zeros), (p, -2, 0.3, 0.4, below, 0.45 * below), (p, 4, 16.0, 20.0, above, score * above)]
    rows = [*level(1, 0.7, 2), *level(2, 0.5, 2), *level(3, 0.7, 8), *level(4, 0.7, 2, zeros=0), *level(5, 0.9, 1, below=0)]
    rows = [r for r in rows if r[4]]
    got = {r.s_p: r.spike_from for r in anomalies.spike_levels(spark.createDataFrame(rows, "s_p long, octave long, low double, high double, n long, total double"), ["s_p"]).collect()}
    assert got == {1: 16.0, 4: 16.0, 5: 16.0}


def test_isolation_forest():
    rng = np.random.default_rng(0)
    s = np.vstack([rng.normal(0, 1, (200, 4)), rng.normal(5, 1, (150, 4)), [[1, 1, 1, 1.0]]])
    sizes = np.array([200, 150, 1])
    far = np.array([[9, 9, 9, 9.0]])
    low, high = np.array([[-4.0] * 4, [1.0] * 4, [1.0] * 4]), np.array([[9.0] * 4, [8.0] * 4, [1.0] * 4])
    seeds = np.array([5, 6, 7])
    whole = forest.grow(s, sizes, low, high, seeds)
    score = forest.scores(np.vstack([s[:200], far]), np.zeros(201, int), *whole)
    assert score[-1] > score[:-1].max() and (score > 0).all() and (score < 1).all()
    alone = forest.grow(s[200:350], sizes[1:2], low[1:2], high[1:2], seeds[1:2])
    assert all((a[1] == b[0]).all() for a, b in zip(whole, alone))  # whatever the batch


def test_whole_groups():
    keys = np.repeat([0, 1, 2, 3, 9], [3, 50, 1, 7, 40])
    x = pd.DataFrame({"k": keys, "v": range(len(keys))})
    for size in (1, 4, 33, 200):
        parts = list(whole_groups((x.iloc[i : i + size] for i in range(0, len(x), size)), ["k"], 10))
        assert pd.concat(parts)["v"].tolist() == list(range(len(x)))
        assert sum(p["k"].nunique() for p in parts) == 5
    assert list(whole_groups(iter([x.iloc[:0]]), ["k"])) == []


def test_assignment_and_edit_script():
    rng = np.random.default_rng(0)
    import itertools

    for _ in range(20):
        c = rng.random((5, 5))
        assert math.isclose(sum(c[i, j] for i, j in enumerate(assignment(c))), min(sum(c[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5))))
    old = Node("", children=[Node("a", "int"), Node("b", "int", [Node("x", "int"), Node("y", "int")]), Node("gone", "text")])
    new = Node("", children=[Node("b2", "int", [Node("x", "text"), Node("gone", "text")]), Node("a", "int")])
    edits = {(e.kind, e.old, e.new) for e in edit_script(old, new, lambda p, q: 0.9 if (p, q) == ("b", "b2") else 0.0)[1]}
    assert edits == {("renamed", "b", "b2"), ("retyped", "b.x", "b2.x"), ("removed", "b.y", None), ("moved", "gone", "b2.gone")}


def test_edit_scripts_of_nested_schemas():
    none = lambda p, q: 0.0
    run = lambda a, b, like=none: edit_script(schema_tree(dict.fromkeys(a, "t")), schema_tree(dict.fromkeys(b, "t")), like)
    kinds = lambda r: {(e.kind, e.old, e.new) for e in r[1]}
    assert run(["a", "g.b"], ["a", "g.b"]) == (0.0, []) and run([], []) == (0.0, [])
    assert kinds(run(["a", "g.b", "g.c"], ["a", "h.b", "h.c"])) == {("renamed", "g", "h")}  # a struct is known by what it holds
    cost, _ = run(["g.b", "h.c"], ["g.c", "h.b"])
    assert cost == 1.8 and kinds(run(["g.b", "h.c"], ["g.c", "h.b"])) == {("moved", "g.b", "h.b"), ("moved", "h.c", "g.c")}
    assert kinds(run(["g.b", "x"], ["x", "g.y"])) == {("removed", "g.b", None), ("added", None, "g.y")}
    like = lambda p, q: 0.9 if (p, q) == ("g.b", "w") else 0.0
    assert kinds(run(["g.a", "g.b"], ["g.a", "w"], like)) == {("moved", "g.b", "w"), ("renamed", "g.b", "w")}
    rng = np.random.default_rng(1)
    for _ in range(30):  # never dearer than removing and adding everything that differs
        names = lambda: {f"{rng.choice(['', 'p.', 'q.'])}{c}" for c in rng.choice(list("abcdef"), 4, replace=False)}
        a, b = names(), names()
        structs = lambda n: {x[0] for x in n if "." in x}
        assert run(sorted(a), sorted(b))[0] <= len(a ^ b) + len(structs(a) ^ structs(b)) + 1e-9


FILES = "file_id long, series string, published_at timestamp_ntz, content string"


def _file(header, rows, sep=";"):
    return sep.join(header) + "\n" + "\n".join(sep.join(r) for r in rows) + "\n"


def test_schema_changes(spark):
    hours = [f"20241001{h:02d}" for h in range(12)]
    rain = ["0,0", "1,2", "3,4", "0,5", "0,0", "2,2", "7,1", "0,3", "1,1", "0,0", "4,4", "0,9"]
    a = _file(["POSTE", "DATE", "RR1", "T"], [["20000001", h, r, "20,1"] for h, r in zip(hours[:8], rain)])
    b = "﻿# note\r\n" + _file(["date ", '"POSTE"', "V03", "U"], [[h, "20000001", r.replace(",", "."), "55"] for h, r in zip(hours[4:], rain[4:])]).replace("\n", "\r\n")
    c = _file(["DATE", "POSTE", "V03", "U"], [[h, "20000001", r.replace(",", ".") + "mm", "mq"] for h, r in zip(hours[6:], rain[6:])], "\t")
    f = spark.createDataFrame([(3, "s", minutes(3), c), (1, "s", minutes(1), a), (2, "s", minutes(2), b), (4, "s", minutes(4), c), (5, "s", minutes(5), None), (6, "s", minutes(6), " "), (7, "other", minutes(1), a)], FILES)
    got = {(r.file_id, r.change_kind, r.field_name) for r in schema_drift.schema_changes(f).collect()}
    assert got == {(2, "renamed", "V03"), (2, "retyped", "V03"), (2, "removed", "T"), (2, "added", "U"), (3, "retyped", "V03")}
    rec = schema_drift.unified_records(f).where("series = 's'").collect()
    assert len(rec) == 12 and {round(r.rr1, 3) for r in rec} == {round(float(x.replace(",", ".")), 3) for x in rain}
    assert schema_drift.schema_changes(f.limit(0)).count() == 0


def test_nothing_is_cut_from_records(spark):
    a = "POSTE;DATE;RR1;RR1;;X\n" + "\n".join(f"20000001;20241001{h:02d};1,{h};2,{h};n;x;extra" for h in range(6))
    assert schema_drift.parse_file(a)[0] == ["POSTE", "DATE", "RR1", "RR1#4", "#5", "X", "#7"]
    assert schema_drift.parse_file("A;B;\n1;2;\n3\n") == (["A", "B", ""], [["1", "2", ""], ["3", "", ""]])
    f = spark.createDataFrame([(1, "s", minutes(1), a), (2, "s", minutes(2), a.replace(";extra", ""))], FILES)
    assert {(r.file_id, r.change_kind, r.field_name) for r in schema_drift.schema_changes(f).collect()} == {(2, "removed", "#7")}
    rows = schema_drift.file_records(f).where("file_id = 1").collect()
    assert len(rows) == 6 and all(r.other == {"rr1#4": f"2,{r.line}", "#5": "n", "x": "x", "#7": "extra"} and r.rr1 == round(1 + r.line / 10, 1) for r in rows)


def test_changes_across_buckets(spark):
    header = lambda n: _file(["POSTE", "DATE", n], [["20000001", "2024100101", "1,5"], ["20000001", "2024100102", "2,5"]])
    rows = [(d, "s", T + dt.timedelta(days=d), header("RR1" if d < 100 else "PRECIP_1H")) for d in (0, 10, 40, 99, 100, 230)]
    f = spark.createDataFrame(rows, FILES)
    for days in (1, 30, 400):
        assert [(r.file_id, r.change_kind, r.field_name) for r in schema_drift.schema_changes(f, days).collect()] == [(100, "renamed", "PRECIP_1H")]


def test_value_types():
    t = schema_drift.value_type
    assert [t(["1", "mq"]), t(["1,5", "2"]), t(["1.5"]), t(["1,5", "1.5"]), t(["-", "NA", ""]), t(["néant"])] == ["whole", "comma", "point", "text", None, "text"]
