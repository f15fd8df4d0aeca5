import pytest
from pyspark.sql import functions as F

from tidegauge.operators.compress import compress
from tidegauge.operators.groups import Clause, Hierarchy, derive, derived_agg, group_series, is_even
from tidegauge.operators.view import points
from tidegauge.sources.dimensions import load_dimensions, parse_definitions

# pumps on three sites: two levels of place, two of kind; the last dimension counts half
PUMPS = [("north", "hall 1", "water", "axial"), ("north", "hall 1", "water", "radial"), ("north", "hall 2", "oil", "radial"), ("south", "yard", "water", "axial"),
         ("south", "yard", "water", "axial"), ("south", "roof", "oil", "radial"), ("east", "hall 1", "oil", "axial")]
HIERARCHY = Hierarchy({"Place": ["site", "room"], "Kind": ["medium", "blade"]}, {"Kind": 0.5})


@pytest.fixture(scope="module")
def series(spark):
    rows = [(i + 1, f"pump{i + 1}", *p) for i, p in enumerate(PUMPS)]
    return spark.createDataFrame(rows, "tid int, source string, site string, room string, medium string, blade string")


def gids(d):
    return [r.gid for r in d.orderBy("tid").select("gid").collect()]


def test_by_source(series):
    assert gids(group_series(series, [Clause(sources=("pump2", "pump6"))], HIERARCHY)) == [1, 2, 3, 4, 5, 2, 6]


def test_by_level(series):
    assert gids(group_series(series, [Clause(lca={"Place": 1, "Kind": 1})], HIERARCHY)) == [1, 1, 2, 3, 3, 4, 5]


def test_by_distance(series):
    # one blade apart: (0 + 0.5 / 2) / 2; one room and the medium apart: (1 / 2 + 0.5) / 2
    assert gids(group_series(series, [Clause(distance=0.125)], HIERARCHY)) == [1, 1, 2, 3, 3, 4, 5]
    assert gids(group_series(series, [Clause(distance=0.5)], HIERARCHY)) == [1, 1, 1, 2, 2, 2, 3]


def test_many_level_vectors_keep_the_plan_small(spark):
    levels = {"A": ["a1", "a2", "a3", "a4"], "B": ["b1", "b2", "b3", "b4"]}
    hierarchy = Hierarchy(levels, {"B": 0.5})
    bound = 0.6
    assert len(hierarchy.level_vectors(bound)) > 8
    d = spark.range(1, 41).select(F.col("id").cast("int").alias("tid"), *[(F.col("id") % (k + 2)).cast("string").alias(c) for k, c in enumerate(sum(levels.values(), []))])
    grouped = group_series(d, [Clause(distance=bound)], hierarchy)
    assert len(grouped._jdf.queryExecution().toString()) < 60_000
    rows = {r.tid: r for r in grouped.collect()}

    def shared(x, y, columns):
        return next((n for n, c in enumerate(columns) if x[c] != y[c]), len(columns))
    for x in rows.values():
        for y in rows.values():
            if x.gid == y.gid:
                assert hierarchy.distance_of({k: shared(x, y, v) for k, v in levels.items()}) <= bound


def test_auto_distance():
    assert HIERARCHY.auto_distance() == 0.25
    with pytest.raises(ValueError):
        Hierarchy({}).auto_distance()


def test_no_clause_keeps_series_apart_and_ids_continue(series):
    assert gids(group_series(series, [], HIERARCHY, first_gid=8)) == list(range(8, 15))


def test_later_clauses_see_earlier_groups(series):
    clauses = [Clause(sources=("pump1", "pump7")), Clause(lca={"Kind": 2})]
    # the first group has one kind, and so merges with the other axial water pumps' clause only if all agree
    assert gids(group_series(series, clauses, HIERARCHY)) == [1, 2, 3, 4, 4, 3, 1]


def test_scaling_of_grouped_series_only(series):
    clause = Clause(sources=("pump1", "pump2"), source_scaling={"pump1": 2.0, "pump3": 9.0}, member_scaling={("Kind", 2, "radial"): 3.0})
    d = group_series(series, [clause], HIERARCHY).orderBy("tid").select("scaling").collect()
    assert [r.scaling for r in d] == [2.0, 3.0] + [1.0] * 5


def test_levels():
    assert HIERARCHY.column("Place", 1) == "site" and HIERARCHY.column("Place", 0) == "room"
    assert HIERARCHY.column("Place", -1) == "site"
    for level in (3, -2):
        with pytest.raises(ValueError):
            HIERARCHY.column("Place", level)
    with pytest.raises(ValueError):
        HIERARCHY.column("Nowhere", 1)


def test_dimension_file(spark, tmp_path):
    file = tmp_path / "dims.txt"
    file.write_text("Location, House string, Channel int\nType, Purpose string, 4.0\n\na.dat, H 1, 7, P\nb.dat, H 2, 8, P\n")
    hierarchy, rows = load_dimensions(spark, str(file))
    assert hierarchy.levels == {"Location": ["house", "channel"], "Type": ["purpose"]} and hierarchy.weights == {"Type": 0.25}
    assert sorted(map(tuple, rows.collect())) == [("a.dat", "H 1", 7, "P"), ("b.dat", "H 2", 8, "P")]


def test_dimension_rows_by_place_and_inline_definitions(spark, tmp_path):
    file = tmp_path / "dims.txt"
    head = "".join(f"D{k}, level{k} string\n" for k in range(1200))
    member = ", ".join(["m"] * 1200)
    file.write_text(f"{head}\na, {member}\n\nb, {member}\n")
    hierarchy, rows = load_dimensions(spark, str(file))
    assert len(hierarchy.levels) == 1200 and sorted(r.source for r in rows.select("source").collect()) == ["a", "b"]
    file.write_text("Place, site string\n\nPlace, site string\n")
    assert [tuple(r) for r in load_dimensions(spark, str(file))[1].collect()] == [("Place", "site string")]
    file.write_text("x, 1\ny, 2\n")
    assert sorted(map(tuple, load_dimensions(spark, str(file), ["Row, number int"])[1].collect())) == [("x", 1), ("y", 2)]
    with pytest.raises(ValueError):
        load_dimensions(spark, str(file))


def test_dimension_file_errors(spark, tmp_path):
    for text in ("L, house\n\n", "L, house colour\n\n", "L\n\n"):
        with pytest.raises(ValueError):
            parse_definitions([text.splitlines()[0]])
    for row in ("a.dat, H 1", "a.dat, H 1, x"):
        file = tmp_path / "bad.txt"
        file.write_text(f"Location, house string, channel int\n\n{row}\n")
        with pytest.raises(Exception):
            load_dimensions(spark, str(file))[1].collect()


def test_even_expressions():
    even = ["value", "value * 2 + 1", "2.5*value", "VALUE / scalingFactor - .5", " scalingFactor * value * 3 "]
    assert all(map(is_even, even))
    assert not any(map(is_even, ["sqrt(value)", "value * value", "1 / value", "value + 1 + 2", "-value", "values * 2", "value % 3", ""]))


def test_derived_aggregates_of_segments_and_of_points_agree(spark):
    d = spark.range(600).selectExpr("cast(id % 2 + 1 AS int) AS tid", "timestamp_millis((id div 2) * 1000) AS ts", "cast(10 * sin(id / 9) + id % 2 AS float) AS value")
    listed = spark.createDataFrame([(1, 1, "left", -2.0), (2, 2, "right", 4.0)], "tid int, gid int, source string, scaling double")
    stored = compress(d, 0.0, si_ms=1000)
    rules = [("left", 11, "value * 2 + 1"), (1, 12, "value / scalingFactor - 7"), (2, 13, "scalingFactor * value"), (2, 14, "abs(value)"), ("right", 15, "value"), ("gone", 16, "value")]
    want = {r.tid: r for r in derive(points(stored), listed, rules).groupBy("tid").agg(
        F.count("*"), F.min("value"), F.max("value"), F.sum(F.col("value").cast("double")), F.avg("value")).collect()}
    got = {r.tid: r for r in derived_agg(stored, listed, rules).collect()}
    assert set(got) == set(want) == {11, 12, 13, 14, 15}
    assert all(list(got[t]) == pytest.approx(list(want[t]), rel=1e-5, abs=1e-3) for t in got)
    text = derived_agg(stored, listed, rules[:3])._jdf.queryExecution().optimizedPlan().toString()
    assert "stored_values" not in text and "generate explode(sequence" not in text.lower()
    with pytest.raises(ValueError):
        derived_agg(stored, listed, [])
