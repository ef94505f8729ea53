"""Reference operators: fixtures of small cubes with known results, invariants, and every query against its SQL."""

import datetime as dt
import gzip
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.functions import metrics as M
from rainloom.functions import scalar as S
from rainloom.operators import accumulate, align, fusion, interp, scores, space

T = dt.datetime(2023, 1, 1)
CUBE = "time timestamp_ntz, lat double, lon double, v double"


def cube(spark, hours, value=lambda h: 1.0, cells=3):
    return spark.createDataFrame([(T + dt.timedelta(hours=h), float(i), 0.0, value(h)) for h in hours for i in range(cells)], CUBE)


def test_completeness_of_full_and_half_days(spark):
    r = accumulate.completeness(cube(spark, range(24)), "gsmap").first()
    assert (r.expected, r.actual, r.missing, r.missing_fraction, r.is_complete) == (24, 24, 0, 0.0, True)
    r = accumulate.completeness(cube(spark, range(12)), "gsmap").first()
    assert (r.missing, r.missing_fraction, r.is_complete, len(r.missing_times)) == (12, 0.5, False, 12)
    with pytest.raises(ValueError):
        accumulate.completeness(cube(spark, range(3)), "nothing")


@pytest.mark.parametrize("mask,most,want", [([0, 1, 1, 1, 0], 2, [0, 1, 1, 1, 0]), ([1, 0, 1, 1, 0, 1, 1, 1, 1], 2, [0, 0, 0, 0, 0, 1, 1, 1, 1]), ([1, 1, 0, 0, 0], 2, [0] * 5)])
def test_large_gaps(spark, mask, most, want):
    df = spark.createDataFrame([(1, i, bool(m)) for i, m in enumerate(mask)], "k int, i int, m boolean")
    assert [int(r.large_gap) for r in accumulate.large_gaps(df, ["k"], "i", "m", most).orderBy("i").collect()] == want


@pytest.mark.parametrize("method", accumulate.METHODS)
def test_gap_filling(spark, method):
    hours = [h for h in range(0, 24, 2)]
    df = cube(spark, hours, value=lambda h: float(h), cells=1)
    v = [r.v for r in accumulate.gap_filled(df, ["lat", "lon"], "v", 24, method, 0).orderBy("time").collect()]
    assert len(v) == 24 and None not in v and v[::2] == [float(h) for h in hours]
    if method == "linear":
        assert np.allclose(v, range(24))
    full = cube(spark, range(24), value=lambda h: float(h * h), cells=1)
    assert [r.v for r in accumulate.gap_filled(full, ["lat", "lon"], "v", 24, method, 0).orderBy("time").collect()] == [float(h * h) for h in range(24)]


def test_daily_amounts(spark):
    r = accumulate.daily_accumulation(cube(spark, range(24)), ["lat"], "v", 1.0).collect()
    assert all(math.isclose(x.daily_accumulation, 24.0) and x.valid_fraction == 1.0 for x in r)
    half = cube(spark, range(24), value=lambda h: None if h < 12 else 1.0)
    assert all(x.daily_accumulation == 12.0 for x in accumulate.daily_accumulation(half, ["lat"], "v", 1.0).collect())
    assert all(x.daily_accumulation is None for x in accumulate.daily_accumulation(half, ["lat"], "v", 1.0, min_valid=0.6).collect())


def test_pipeline_skips_and_reports(spark):
    df = cube(spark, list(range(24)) + list(range(24, 30)) + list(range(48, 72))).withColumnRenamed("v", "precipitation")
    p = accumulate.DailyPipeline("gsmap", ["lat", "lon"])
    out = p.run(df, done=spark.createDataFrame([(dt.date(2023, 1, 3),)], "day date")).collect()
    assert {r.day for r in out} == {dt.date(2023, 1, 1)} and all(math.isclose(r.daily_accumulation, 24) for r in out)
    assert {r.status: r["count"] for r in p.summary().collect()} == {"success": 1, "failed": 1}


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.gamma(1, 2, 200), rng.gamma(1, 2, 200)
    rows = [(float(x), float(y)) for x, y in zip(a, b)] + [(None, 1.0), (2.0, float("nan"))]
    r = spark.createDataFrame(rows, "o double, s double").agg(*[f(F.col("o"), F.col("s")).alias(n) for n, f in M.SCORES.items()]).first()
    corr = np.corrcoef(a, b)[0, 1]
    assert math.isclose(r.correlation, corr) and math.isclose(r.rmse, np.sqrt(((a - b) ** 2).mean())) and math.isclose(r.rbias, (b.sum() - a.sum()) / a.sum())
    assert math.isclose(r.kge, 1 - np.sqrt((corr - 1) ** 2 + (a.std() / a.mean() - b.std() / b.mean()) ** 2 + (a.mean() / b.mean() - 1) ** 2))
    assert math.isclose(r.r2, 1 - ((a - b) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "o double, s double")
    assert flat.agg(M.correlation(F.col("o"), F.col("s")).alias("c")).first().c is None
    assert flat.limit(0).agg(M.kge(F.col("o"), F.col("s")).alias("c")).first().c is None


def test_contingency_is_strict(spark):
    df = spark.createDataFrame([(2.0, 2.0), (3.0, 3.0), (1.0, 3.0), (3.0, 1.0), (1.0, 1.0), (None, 3.0)], "o double, s double")
    r = scores.contingency_scores(df, "o", "s", [2.0], global_threshold=True).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1)


def test_scalars(spark):
    r = spark.range(1).select(S.rate_from_reflectivity(S.reflectivity_from_rate(F.lit(5.0))).alias("r"), (S.echelon_up(F.lit(0.3)) + S.echelon_down(F.lit(0.3))).alias("one"), S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("km")).first()
    assert abs(r.r - 5) < 1e-3 and r.one == 1.0 and math.isclose(r.km, math.pi * 6371.0088)
    names = {"3B-HHR.MS.MRG.3IMERG.20230101-S000000-E002959.0000.V06B.HDF5": T, "gsmap.20230101.0000.dat.gz": T, "Romuald_20230101120000_scan.nc": T.replace(hour=12), "230101120000.RAW": T.replace(hour=12), "2023010112000000.vol": T.replace(hour=12), "L1_radar_S20230101T1200_x.nc": T.replace(hour=12), "x.txt": None}
    x = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.filename_time(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in x} == names
    lon, lat = S.aeqd_to_geographic(F.lit(0.0), F.lit(0.0), -38.0, -3.0)
    assert spark.range(1).select(lon.alias("a"), lat.alias("b")).first()[:] == (-38.0, -3.0)


def test_idw_bounds_and_hits(spark):
    st = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "id long, lat double, lon double")
    obs = spark.createDataFrame([(1, T, 2.0), (2, T, 4.0), (1, T + dt.timedelta(hours=1), 2.0), (2, T + dt.timedelta(hours=1), None)], "station long, time timestamp_ntz, value double")
    nodes = spark.createDataFrame([(0.0, 0.0), (0.5, 0.5), (0.2, 0.1)], "lat double, lon double")
    got = {(r.time, r.lat): r.value for r in interp.idw(obs, st, nodes).collect()}
    assert got[T, 0.0] is None and got[T, 0.5] == 3.0 and 2 < got[T, 0.2] < 3 and got[T + dt.timedelta(hours=1), 0.5] is None
    assert {(r.time, r.lat): r.value for r in interp.idw(obs, st, nodes, exact_hit="value").collect()}[T, 0.0] == 2.0


def test_scattered_regrid_is_exact_on_planes(spark):
    rng = np.random.default_rng(4)
    pts = [(T, float(a), float(o), float(3 * a - o + 1)) for a, o in rng.uniform(0, 4, (40, 2))] + [(T, a, o, 3 * a - o + 1) for a in (0.0, 4.0) for o in (0.0, 4.0)]
    out = interp.regrid_scattered(spark.createDataFrame(pts, CUBE), space.BBox(0.1, 0.1, 3.9, 3.9), 0.4, "v").collect()
    assert len(out) == 100 and all(abs(r.value - (3 * r.lat - r.lon + 1)) < 1e-6 for r in out)


def test_quantiles_by_rank_equal_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.gamma(1, 1, 3000), 2)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double")
    q = list(np.linspace(0, 1, 501, endpoint=False))
    assert np.allclose(fusion.exact_quantiles(df, ["x"], q)["x"], np.quantile(v, q))


def test_parts_query_equals_numpy_with_all_quantiles(spark):
    from rainloom.plans import reference

    d, q = "/root/testdata/sf0.001", np.linspace(0, 1, 10_000, endpoint=False)
    g = reference.grid(spark, d).toPandas().sort_values(["time", "lat", "lon"])
    radar, sat = g["radar"].to_numpy(float), g["sat"].to_numpy(float)

    def part(at):
        x, y = np.quantile(sat, at), np.quantile(radar, at)
        p = np.polyfit(x, y, 2)
        return np.polyval(p if p[0] >= 0 else np.polyfit(x, y, 1), sat)

    up = (1 + np.tanh(20 * (sat - np.quantile(sat, 0.75)))) / 2
    want = np.maximum(part(q * 0.75) * (1 - up) + part(0.75 + q * 0.25) * up, 0)
    got = reference.quantile_match_by_parts(spark, d).toPandas().sort_values(["time", "lat", "lon"])["sat_matched"].to_numpy(float)
    assert len(got) == len(want) and np.abs(got - want).max() < 2e-4


def test_fits():
    x = np.linspace(0, 5, 50)
    assert np.allclose(fusion.fit_quadratic(x, 2 * x * x + x + 1), [2, 1, 1])
    assert fusion.fit_quadratic(x, -x * x)[0] == 0
    assert np.allclose(fusion.fit_callable(lambda x, a, b: a * np.exp(b * x / 5), x, 3 * np.exp(0.7 * x / 5), 2), [3, 0.7], atol=1e-5)


def test_delaunay_is_delaunay():
    from rainloom.operators.interp import delaunay

    rng = np.random.default_rng(0)
    g = np.stack(np.meshgrid(np.arange(12.0), np.arange(7.0)), -1).reshape(-1, 2)
    for p in (rng.random((150, 2)), g, g[:3]):
        x, y = p.T
        t = delaunay(x, y)
        area = 0.5 * np.abs((x[t[:, 1]] - x[t[:, 0]]) * (y[t[:, 2]] - y[t[:, 0]]) - (x[t[:, 2]] - x[t[:, 0]]) * (y[t[:, 1]] - y[t[:, 0]]))
        for (a, b, c), s in zip(t, area):
            if s < 1e-9:
                continue
            m = np.linalg.solve(2 * np.array([p[b] - p[a], p[c] - p[a]]), [p[b] @ p[b] - p[a] @ p[a], p[c] @ p[c] - p[a] @ p[a]])
            assert (np.hypot(*(p - m).T) > np.hypot(*(p[a] - m)) - 1e-7).all()
        if len(p) == len(g):
            assert math.isclose(area.sum(), 66.0)
    assert len(delaunay(np.zeros(2), np.zeros(2))) == 0


def test_many_quantiles_by_rank(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.gamma(1, 3, (4000, 2)), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in v] + [(None, float("nan"))], "a double, b double")
    q = list(np.linspace(0, 1, 500))
    got = fusion.exact_quantiles(df, ["a", "b"], q)
    assert np.allclose(got["a"], np.quantile(v[:, 0], q)) and np.allclose(got["b"], np.quantile(v[:, 1], q))
    assert np.isnan(fusion.exact_quantiles(df.limit(0), ["a"], q)["a"]).all()


def test_idw_on_nodes_and_gaps(spark):
    o = spark.createDataFrame([(1, T, 2.0), (2, T, 4.0), (1, T.replace(hour=1), 1.0), (2, T.replace(hour=1), None)], "station long, time timestamp_ntz, value double")
    s = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 2.0)], "id long, lat double, lon double")
    n = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0)], "lat double, lon double")
    got = {(r.time.hour, r.lon): r.value for r in interp.idw(o, s, n).collect()}
    assert got == {(0, 0.0): None, (0, 1.0): 3.0, (1, 0.0): None, (1, 1.0): None}
    assert {(r.time.hour, r.lon): r.value for r in interp.idw(o, s, n, exact_hit="value").collect()}[0, 0.0] == 2.0


def _brute_idw(obs, st, nodes):
    place, out = {i: (a, o) for i, a, o in st}, {}
    for time in {t for _, t, _ in obs}:
        seen = [(*place[i], v) for i, t, v in obs if t == time and i in place]
        for a, o in nodes:
            d2 = [(a - x) ** 2 + (o - y) ** 2 for x, y, _ in seen]
            blank = 0.0 in d2 or any(v is None for *_, v in seen)
            out[time, a, o] = None if blank else sum(v / d for d, (*_, v) in zip(d2, seen)) / sum(1 / d for d in d2)
    return out


def _network(spark):
    rng = np.random.default_rng(8)
    st = [(i, float(rng.integers(0, 12)) / 2, float(rng.integers(0, 12)) / 2) for i in range(90)]
    obs = [(i, T + dt.timedelta(hours=h), float(rng.normal(0, 5))) for h in range(30) for i in range(0, 95) if rng.random() < 0.3]
    obs = [*obs, obs[0], (1, T + dt.timedelta(hours=2), None)]  # one observation twice; stations from 90 on are unknown
    nodes = [(i * 0.75 + 0.25, j * 0.7) for i in range(6) for j in range(7)] + [(0.5, 0.5), (2.0, 3.0)]
    frames = spark.createDataFrame(obs, "station long, time timestamp_ntz, value double"), spark.createDataFrame(st, "id long, lat double, lon double"), spark.createDataFrame(nodes, "lat double, lon double")
    return frames, _brute_idw(obs, st, nodes)


@pytest.mark.parametrize("limits", [{}, {"GROUP_STATIONS": 20, "TILES": 6, "CHUNK": (40, 3, 100, 20)}, {"NODES_AT_ONCE": 15}])
def test_idw_in_tiles(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(interp, name, value)
    frames, want = _network(spark)
    got = {(r.time, r.lat, r.lon): r.value for r in interp.idw(*frames).collect()}
    assert got.keys() == want.keys() and sum(v is None for v in want.values()) > len(want) // 30
    assert all((got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9)) for k, v in want.items())


def test_idw_makes_no_row_for_an_observation_at_a_node(spark):
    """Observations by nodes are 48 billion at 60,000 stations: they may only meet in matrix products."""
    frames, _ = _network(spark)
    plan = interp.idw(*frames)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("Join") == 1 and "MapInArrow" in plan


def test_checkpoints_and_broadcasts_are_checked(spark):
    from rainloom import session

    wide = spark.range(100).select(F.expr("repeat('x', 10000)").alias("t"))
    assert session.fits(wide, 1000) and not session.fits(wide, 1000, 500_000) and not session.fits(wide, 50)
    assert session.fits(spark.range(10).select(F.array("id", "id").alias("a"), F.struct("id").alias("s")), 10)


def test_nearest_step_and_stations(spark):
    from rainloom.sources import gauges

    a = spark.createDataFrame([(T.replace(hour=h), 0.0, 0.0, float(h)) for h in (0, 5, 12)], "time timestamp_ntz, lat double, lon double, radar double")
    b = spark.createDataFrame([(T.replace(hour=h), 0.0, 0.0, float(h)) for h in (3, 7, 11)], "time timestamp_ntz, lat double, lon double, sat double")
    assert {r.radar: r.sat for r in align.at_nearest_step(a, b).collect()} == {0.0: 3.0, 5.0: 3.0, 12.0: 11.0}
    s = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 2.0), (2, 3.0, 4.0)], "id long, lat double, lon double")
    assert [tuple(r) for r in gauges.station_coordinates(s, spark.createDataFrame([(1,), (1,), (9,)], "id long")).collect()] == [(1, 1.0, 2.0)]


def test_split_is_disjoint(spark):
    for method in ("sequential", "random"):
        a, b = align.split_times(cube(spark, range(10)), method=method)
        ta, tb = ({r.time for r in x.select("time").distinct().collect()} for x in (a, b))
        assert len(ta) == 8 and len(tb) == 2 and not ta & tb
    with pytest.raises(ValueError):
        align.split_times(cube(spark, range(3)), 0.9, 0.2)


def test_streaming_accumulation(spark, tmp_path):
    from rainloom.streaming.accumulation import stream_daily

    cube(spark, range(30)).withColumn("time", F.col("time").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("time timestamp, lat double, lon double, v double").parquet(str(tmp_path / "in"))
    q = stream_daily(s, ["lat"], "time", "v", 1.0).writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.lat, r.amount) for r in spark.table("daily").collect()} == {(float(i), a) for i in range(3) for a in (24.0, 6.0)}


def test_files(spark, tmp_path):
    from rainloom.sources import catalog, gauges, gsmap, sinks

    grid = np.arange(1200 * 3600, dtype="<f4").reshape(1200, 3600)
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "gsmap.20230101.0000.dat.gz").write_bytes(gzip.compress(grid.tobytes(), 1))
    (tmp_path / "g" / ".DS_Store").write_text("x")
    assert catalog.catalog(spark, str(tmp_path / "g"), "*.gz").first().time == T
    r = gsmap.read_gsmap(spark, str(tmp_path / "g" / "*.gz"), space.BBox(59.8, -0.2, 60, 0.2)).collect()
    assert len(r) == 8 and {(x.lat, x.lon): x.precipitation for x in r}[59.95, -0.05] == 3599.0
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.data").write_text("POSTE;DATE;RR1;X\n12345678;2023010105;1,5;9\n12345678;2023010105;2,5;9\n12345678;2023010106;mq;9\n")
    got = {x.time: x.value for x in gauges.record_files(spark, str(tmp_path / "d")).collect()}
    assert got == {T.replace(hour=8): 1.5, T.replace(hour=9): None}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "s.csv").write_text("#Código:7\n#Nome:N\n#Latitude:-3.5\n#Longitude:-38\n#Altitude:9\ndata,valor\n2023-01-01 00:00:00,1\n2023-01-01 00:10:00,2\n")
    obs, meta = gauges.commented_csv(spark, str(tmp_path / "c"))
    assert meta.first().step_seconds == 600 and {x.time for x in obs.collect()} == {T.replace(hour=3), T.replace(hour=3, minute=10)}
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "p.html").write_text("<table><tr><td>97301</td><td>A</td><td>4°49'12\"N 52°21'54\"O</td><td>4 m</td><td>MF</td></tr></table>")
    s = gauges.station_pages(spark, str(tmp_path / "h")).first()
    assert s.id == 97301 and math.isclose(s.lat, 4.82) and s.lon < -52 and s.altitude == 4
    day = accumulate.daily_accumulation(cube(spark, range(24)), ["lat", "lon"], "v", 1.0)
    sinks.save_grid(day, str(tmp_path / "o"), {"product": "gsmap"})
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def _names():
    import __spark_entry__ as e

    from rainloom.plans import climate, files, reference

    return sorted(n for m in (reference, climate, files) for n in m.ORACLE)


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, name):
    import os

    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(d):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{d}/{f}')")
    a, b = e.queries()[name](spark, d).toPandas(), con.execute(e.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    for x in (a, b):
        for c in cols:
            if str(x[c].dtype).startswith("datetime"):
                x[c] = x[c].astype("datetime64[us]").astype(str)
            elif x[c].dtype == object:
                x[c] = x[c].astype(str).str.replace(" 00:00:00", "")
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=2e-6, equal_nan=True), c
        elif str(b[c].iloc[0] if len(b) else "")[:4].isdigit() and c == "day":
            assert [str(v)[:10] for v in a[c]] == [str(v)[:10] for v in b[c]]
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
