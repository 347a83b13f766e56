"""Co-location statistics against known values and brute force."""

import hashlib
import math
import time
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquarry.functions.geometry import grid_definition, in_polygon
from geoquarry.functions.vectors import cosine_distance, float64_hex, taxonomy_distance, vector_hash
from geoquarry.operators import colocation as C, geo, semantics as S
from geoquarry.operators.pairs import Numbered, pair_sums


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


def test_pmf_and_convolution():
    assert C.pmf(4, 2, 2) == pytest.approx([1 / 6, 4 / 6, 1 / 6])
    assert C.convolve_null([(4, 2, 2)], 2)[0] == pytest.approx(1 / 6)
    assert C.convolve_null([(4, 2, 2), (2, 1, 1)], 3)[0] == pytest.approx(1 / 12)
    assert C.convolve_null([(4, 2, 2)] * 3, 1, states=3)[0] is None
    brute = [0.0] * 5
    for x, y in product(range(3), range(3)):
        brute[x + y] += C.pmf(4, 2, 2)[x] * C.pmf(4, 2, 2)[y]
    assert C.convolve_null([(4, 2, 2)] * 2, 3)[0] == pytest.approx(sum(brute[3:]))


def cells(spark, rows):
    return spark.createDataFrame(rows, "lat_idx long, lon_idx long, density long, has_a boolean, has_b boolean")


def test_observed_and_moments(spark):
    own = cells(spark, [(0, 0, 1, True, True), (0, 1, 1, True, False), (0, 2, 1, False, True), (0, 3, 1, False, False)])
    r = C.observed(own).first()
    assert (r.joint, r.expected, r.lift) == (1, 1.0, 1.0)
    incident = own.where("has_a").select("lat_idx", "lon_idx", F.lit("a").alias("category")).union(own.where("has_b").select("lat_idx", "lon_idx", F.lit("b")))
    m = C.pair_moments(own, incident).first()
    assert (m.mean, m.variance) == pytest.approx((1.0, 1 / 3))
    assert C.observed(own.limit(0)).first().lift is None


def test_permutation_null_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i // 12), int(i % 12), int(rng.integers(1, 5)), bool(rng.random() < 0.5), bool(rng.random() < 0.4)) for i in range(96)]
    got = C.permutation_null(cells(spark, rows), "seed", 19).first()
    strata = {}
    for la, lo, d, a, b in rows:
        strata.setdefault(f"{la // 8}:{lo // 8}:{int(math.log2(d))}", []).append((f"{la}:{lo}", a, b))
    counts = []
    for r in range(19):
        joint = 0
        for s, own in strata.items():
            n_a, n_b = sum(x[1] for x in own), sum(x[2] for x in own)
            order = sorted((hashlib.sha256(f"seed|{r}|{s}|{c}".encode()).hexdigest(), c, a) for c, a, _ in own)
            joint += sum(x[2] for x in order[:n_b]) if max(0, n_a + n_b - len(own)) < min(n_a, n_b) else max(0, n_a + n_b - len(own))
        counts.append(joint)
    seen = sum(a and b for *_, a, b in rows)
    assert got.null_mean == pytest.approx(np.mean(counts)) and got.null_deviation == pytest.approx(np.std(counts))
    assert got.p_value == pytest.approx((1 + sum(c >= seen for c in counts)) / 20)


def test_exact_null_equals_convolution(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i // 10), int(i % 10), 1 + int(i % 3)) for i in range(60)]
    all_cells = spark.createDataFrame(rows, "lat_idx long, lon_idx long, density long")
    held = {(la, lo): {c for c in "xy" if rng.random() < 0.5} for la, lo, _ in rows}
    incident = spark.createDataFrame([(la, lo, c) for (la, lo), s in held.items() for c in s], "lat_idx long, lon_idx long, category string")
    joint = sum(len(s) == 2 for s in held.values())
    pairs = spark.createDataFrame([("x", "y", joint)], "a string, b string, joint long")
    strata = {}
    for la, lo, d in rows:
        own = strata.setdefault((la // 8, lo // 8, int(math.log2(d))), [0, 0, 0])
        own[0] += 1
        own[1] += "x" in held[la, lo]
        own[2] += "y" in held[la, lo]
    assert C.exact_null(all_cells, incident, pairs).first().raw_p == pytest.approx(C.convolve_null([tuple(s) for s in strata.values()], joint)[0])


def test_exact_null_by_a_tree(spark):
    """Many strata, some that cannot vary and many alike, against folding them one after another; caps."""
    rng = np.random.default_rng(9)
    pairs = [("p", "q"), ("p", "r"), ("q", "r")]
    rows, want = [], {}
    for k, (a, b) in enumerate(pairs):
        strata = []
        for s in range(150 * (k + 1)):
            n = int(rng.integers(1, 40))
            strata.append((n, int(rng.integers(0, n + 1)), int(rng.integers(0, n + 1)) if s % 3 else n))
        rows += [(a, b, f"{s:04d}", *x) for s, x in enumerate(strata)]
        want[a, b] = strata
    table = spark.createDataFrame(rows, "a string, b string, stratum string, n long, m_a long, m_b long")
    got = {(r.a, r.b): r for r in C.null_distributions(table, fan=4).collect()}
    costs = {(r.a, r.b): r for r in C.null_costs(table, 5000, 2_500_000).collect()}
    assert {r.reason is None for r in costs.values()} == {True, False}
    for pair, strata in want.items():
        whole = np.ones(1)
        for x in strata:
            whole = np.convolve(whole, C.pmf(*x))
        own = np.zeros(len(whole))
        own[got[pair].shift : got[pair].shift + len(got[pair].probs)] = got[pair].probs
        assert np.abs(own - whole).max() < 1e-12 and abs(own[len(own) // 2 :].sum() - whole[len(own) // 2 :].sum()) < 1e-12
        _, _, states, transitions, reason = C.convolve_null(strata, 0, 5000, 2_500_000)
        assert (costs[pair].states, costs[pair].transitions, costs[pair].reason) == (states, transitions, reason)
    x = rng.random(700) / 700
    assert np.abs(C.convolved(x, x[:300]) - np.convolve(x, x[:300])).max() < 1e-12
    assert np.abs(C.powered(x[:50], 5) - np.convolve(np.convolve(np.convolve(np.convolve(x[:50], x[:50]), x[:50]), x[:50]), x[:50])).max() < 1e-12
    assert C.null_distributions(table.where("n = m_b and a = 'p' and b = 'q'")).first().probs == [1.0]


@pytest.mark.parametrize("block", [256, 3])
def test_pair_sums_by_blocks(spark, block):
    rng = np.random.default_rng(2)
    rows = [(s, f"c{c:02d}", n, int(rng.integers(1, n + 1))) for s in range(40) for n in [int(rng.integers(1, 9))] for c in range(11) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "s int, category string, n long, m long")
    got = {(r.a, r.b): (r.joint, r.mean, r.variance) for r in pair_sums(df, ["s"], Numbered(df, block)).collect()}
    want = {}
    for s, a, n, x in rows:
        for t, b, _, y in rows:
            if s == t and a < b:
                j, m, v = want.get((a, b), (0, 0.0, 0.0))
                want[a, b] = (j + x * y, m + x * y / n, v + (x * (n - x) * y * (n - y) / (n * n * (n - 1)) if n > 1 else 0))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    # sums of whole numbers are whole: a pair that cannot vary has a mean without rounding
    fixed = spark.createDataFrame([(s, c, 49, 49 if c == "x" else 7) for s in range(30) for c in "xy"], "s int, category string, n long, m long")
    r = pair_sums(fixed, ["s"], Numbered(fixed)).first()
    assert (r.mean, r.variance) == (210.0, 0.0)
    assert pair_sums(df.limit(0), ["s"], Numbered(df.limit(0))).count() == 0


def test_largest_frontier(spark):
    """20,000 cells that all hold 256 categories: 32,640 pairs, 653 million meetings, none of them a row."""
    all_cells = spark.range(20_000).select((F.col("id") / 200).cast("long").alias("lat_idx"), (F.col("id") % 200).alias("lon_idx"), (1 + F.col("id") % 5).alias("density"))
    incident = all_cells.select("lat_idx", "lon_idx", F.explode(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.format_string("c%03d", i))).alias("category"))
    began = time.time()
    out = C.joint_counts(incident).agg(F.count("*").alias("n"), F.min("joint").alias("lo"), F.max("joint").alias("hi")).first()
    assert tuple(out) == (32_640, 20_000, 20_000)
    assert time.time() - began < 60


def test_holm(spark):
    for p, want in (([0.01, 0.01, 0.04], [0.03, 0.03, 0.04]), ([1.0, 0.01], [1.0, 0.02]), ([None, 0.01], [1.0, 0.02])):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
        assert [r.holm_p for r in C.holm(df, "p", "i").orderBy("i").collect()] == pytest.approx(want)


def test_percentiles_and_quantiles(spark):
    d = spark.createDataFrame([(str(i), "z", x) for i, x in enumerate([0.1, 0.2, 0.2, 0.4, 0.5])], "a string, b string, distance double")
    got = {r.distance: r.percentile for r in S.percentiles(d).collect()}
    assert got == pytest.approx({0.1: 0.2, 0.2: 0.6, 0.4: 0.8, 0.5: 1.0})
    q = S.quantiles(d).first()
    assert (q.p0, q.p80, q.p100) == (0.1, 0.4, 0.5)


def test_split(spark):
    one_cell = spark.createDataFrame([(0, 0, 1)], "lat_idx long, lon_idx long, density long")
    with pytest.raises(ValueError):
        C.check_split(C.split(one_cell, "s"))
    many = spark.createDataFrame([(i, 0, 1) for i in range(8)], "lat_idx long, lon_idx long, density long")
    b = C.split_balance(C.split(many, "s")).first()
    assert (b.discovery_cells, b.validation_cells, b.max_imbalance) == (4, 4, 0)


def test_modal_path(spark):
    rows = [("k", p) for p in ["z", "z", "a", "a", "b", None, None, None]]
    r = C.modal_paths(spark.createDataFrame(rows, "taxonomy_primary string, taxonomy_hierarchy string")).first()
    assert (r.path, r.coverage, r.ambiguity) == ("a", 0.25, 1)


def test_size_guard(spark):
    with pytest.raises(ValueError):
        C.size_guard(spark.range(5), 4, "rows")
    assert C.size_guard(spark.range(4), 4, "rows").count() == 4


def test_functions(spark):
    assert one(spark, taxonomy_distance("a", "b"), a="dining/restaurant/cafe", b="dining/restaurant/diner") == pytest.approx(1 / 3)
    assert one(spark, taxonomy_distance("a", "b"), a="x", b="/") is None
    assert one(spark, cosine_distance("a", "b"), a=[1e200, 0.0], b=[0.0, 1e-200]) == 1.0
    assert one(spark, cosine_distance("a", "b"), a=[2.0, 2.0], b=[5.0, 5.0]) == pytest.approx(0.0)
    with pytest.raises(Exception, match="vectors must be"):
        one(spark, cosine_distance("a", "b"), a=[0.0, 0.0], b=[1.0, 1.0])
    digest = one(spark, vector_hash("v"), v=[1.0, 2.0])
    assert digest.startswith("f814737d") and digest.endswith("ea073afc")
    assert one(spark, vector_hash("v"), v=[-0.0]) == one(spark, vector_hash("v"), v=[0.0])
    assert one(spark, float64_hex("v"), v=1.0) == "3ff0000000000000"
    with pytest.raises(ValueError):
        grid_definition(800, 89.9999999, 90.0)


def test_areas(spark):
    points = spark.createDataFrame([("p1", 1.0, 1.0, 100.0), ("p2", 9.0, 9.0, None), ("p3", 20.0, 1.0, 5.0)], "id string, latitude double, longitude double, value double")
    ring = [(0.0, 0.0), (0.0, 10.0), (10.0, 0.0)]
    areas = [(1, 0.0, 10.0, 0.0, 10.0, None), (2, None, None, None, None, ring), (3, None, None, None, None, ring[:2]), (4, 5.0, 1.0, 0.0, 1.0, None), (5, None, None, None, None, None)]
    df = spark.createDataFrame(areas, "area_id int, min_lat double, max_lat double, min_lon double, max_lon double, ring array<struct<lat: double, lon: double>>")
    assert {r.area_id: r.error is None for r in geo.validate_areas(df).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    want = {(1, "p1"), (1, "p2"), (2, "p1")}
    assert {(r.area_id, r.id) for r in geo.area_join(points, df).collect()} == want
    assert {r.area_id: (r.total, r.n) for r in geo.area_sums(points, df, "value").collect()} == {1: (100.0, 2), 2: (100.0, 1)}
    # areas of every size, the whole world and a single point among them, against all pairs
    rng = __import__("random").Random(4)
    spots = [(str(i), rng.uniform(-90, 90), rng.uniform(-180, 180), 1.0) for i in range(300)]
    boxes = [(0, -90.0, 90.0, -180.0, 180.0, None), (1, spots[0][1], spots[0][1], spots[0][2], spots[0][2], None)]
    for k in range(2, 60):
        lat, lon, size = rng.uniform(-90, 80), rng.uniform(-180, 170), 2.0 ** rng.uniform(-7, 6)
        boxes.append((k, lat, min(lat + size, 90.0), lon, min(lon + size * rng.random() + 0.001, 180.0), None))
    got = {(r.area_id, r.id) for r in geo.area_join(spark.createDataFrame(spots, points.schema), spark.createDataFrame(boxes, df.schema)).collect()}
    assert got == {(k, i) for i, lat, lon, _ in spots for k, x0, x1, y0, y1, _ in boxes if x0 <= lat <= x1 and y0 <= lon <= y1}
    assert geo.area_join(points, df.limit(0)).count() == 0
    # a city centre: crowded cells are split, and the rows are the same
    centre = [(f"c{i}", 26.0 + i % 7 * 1e-4, -82.0, 1.0) for i in range(500)]
    some = spark.createDataFrame(spots + centre, points.schema)
    around = spark.createDataFrame([*boxes[:9], (90, 25.0, 27.0, -83.0, -81.0, None), (91, 26.0, 26.0002, -82.0, -82.0, None)], df.schema)
    rows = lambda hot: sorted((r.area_id, r.id) for r in geo.area_join(some, around, hot).collect())
    assert rows(20) == rows(10**6) and sum(k == 90 for k, _ in rows(20)) >= 500


def test_guards_refuse_beyond_their_bounds(spark, monkeypatch):
    from geoquarry.operators import colocation as C

    places = spark.range(12).selectExpr("id", "cast(IF(id < 2, 91, 26) as double) as latitude", "cast(-82 as double) as longitude")
    cells, categories = spark.range(5), spark.range(4)
    monkeypatch.setattr(C, "MAX_PLACES", 10)  # two of the twelve have no valid coordinates
    monkeypatch.setattr(C, "MAX_CELLS", 5)
    monkeypatch.setattr(C, "MAX_CATEGORIES", 4)
    assert C.guarded_places(places).count() == 12
    C.guarded_stages(cells, categories)
    monkeypatch.setattr(C, "MAX_PLACES", 9)
    with pytest.raises(ValueError, match="refused"):
        C.guarded_places(places)
    for bound, least in (("MAX_CELLS", 4), ("MAX_CATEGORIES", 3)):
        with monkeypatch.context() as m:
            m.setattr(C, bound, least)
            with pytest.raises(ValueError, match="refused"):
                C.guarded_stages(cells, categories)
    assert C.MAX_PAIRS == 256 * 255 // 2


def test_rewritten_tables_are_read_anew(spark, tmp_path):
    import shutil

    from geoquarry import catalogue

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "d")
    before = catalogue.QUERIES["cell_density"](spark, str(tmp_path / "d")).agg({"density": "sum"}).first()[0]
    half = spark.read.parquet(f"{tmp_path}/d/lineitem.parquet").where("l_orderkey % 2 = 0").toPandas()
    (tmp_path / "d" / "lineitem.parquet").chmod(0o644)
    half.to_parquet(tmp_path / "d" / "lineitem.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    after = catalogue.QUERIES["cell_density"](spark, str(tmp_path / "d")).agg({"density": "sum"}).first()[0]
    assert 0 < after < before
