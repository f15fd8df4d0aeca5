"""Correlation groups, scaling rules and derived series."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import Catalog, sql
from tidegauge.operators import groups, view
from tidegauge.operators.groups import Clause, Hierarchy

CATALOG = Catalog()
add = CATALOG.add

LOCATION = Hierarchy({"Location": ["region", "nation"]})
# two dimensions over the suppliers: place, and size class of the balance
PLACE_AND_SIZE = Hierarchy({"Location": ["region", "nation"], "Size": ["sign", "class"]}, {"Size": 0.5})


def grouped(key, tables=("series_seq",), columns="tid, gid"):
    """gids are dense ranks of the smallest tid of each group key."""
    return sql(*tables, k=f"SELECT *, {key} k FROM {tables[0]}", body=f"""SELECT {columns} FROM (
 SELECT * EXCLUDE (gid), CAST(dense_rank() OVER (ORDER BY first) AS INT) gid FROM (SELECT *, min(tid) OVER (PARTITION BY k) first FROM k))""")


def _groups(spark, sf_dir, clauses, hierarchy=LOCATION, series=None):
    series = fx.series_seq(spark, sf_dir) if series is None else series
    return groups.group_series(series, clauses, hierarchy).select("tid", "gid")


@add("group_by_source", grouped("CASE WHEN source IN ('click', 'view') THEN 'a' WHEN source IN ('error', 'purchase') THEN 'b' ELSE source END", ("series_ev",)))
def group_by_source(spark, sf_dir):
    clauses = [Clause(sources=("click", "view")), Clause(sources=("error", "purchase"))]
    return _groups(spark, sf_dir, clauses, series=fx.series_ev(spark, sf_dir))


@add("group_by_member", grouped("CASE WHEN region IN ('ASIA', 'EUROPE') THEN 'together' ELSE CAST(tid AS VARCHAR) END"))
def group_by_member(spark, sf_dir):
    return _groups(spark, sf_dir, [Clause(members={("Location", 1): ["ASIA", "EUROPE"]})])


@add("group_by_lca", grouped("region || '/' || nation"))
def group_by_lca(spark, sf_dir):
    return _groups(spark, sf_dir, [Clause(lca={"Location": 0})])


@add("group_by_lca_top", grouped("region"))
def group_by_lca_top(spark, sf_dir):
    return _groups(spark, sf_dir, [Clause(lca={"Location": -1})])


@add("group_by_distance", grouped("region"))
def group_by_distance(spark, sf_dir):
    """`auto` allows the lowest distance above zero: one level of the only dimension."""
    return _groups(spark, sf_dir, [Clause(distance=LOCATION.auto_distance())])


@add("group_clauses", grouped("CASE WHEN region = 'ASIA' THEN nation WHEN region IN ('EUROPE', 'AFRICA') THEN region ELSE CAST(tid AS VARCHAR) END"))
def group_clauses(spark, sf_dir):
    """Members AND level in one clause; a second clause for other series."""
    return _groups(spark, sf_dir, [Clause(members={("Location", 1): ["ASIA"]}, lca={"Location": 0}),
                                   Clause(members={("Location", 1): ["EUROPE", "AFRICA"]}, lca={"Location": 1})])


def sized(spark, sf_dir):
    balance = fx.load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("tid"), F.when(F.col("s_acctbal") < 0, "neg").otherwise("pos").alias("sign"),
        F.floor(F.col("s_acctbal") / 1000).alias("class"))
    return fx.series_seq(spark, sf_dir).join(balance, "tid")


SIZED = """SELECT q.*, CASE WHEN s_acctbal < 0 THEN 'neg' ELSE 'pos' END sign, CAST(floor(s_acctbal / 1000) AS BIGINT) class
 FROM series_seq q JOIN supplier ON tid = s_suppkey"""
SHARED = "CASE WHEN a.{0} <> b.{0} THEN 0 WHEN a.{1} <> b.{1} THEN 1 ELSE 2 END"


@add("series_distance", sql("series_seq", sized=SIZED, body=f"""SELECT a.tid, b.tid other_tid, round(least(((2 - {SHARED.format('region', 'nation')}) / 2.0
 + 0.5 * (2 - {SHARED.format('sign', 'class')}) / 2.0) / 2, 1), 6) distance
 FROM sized a JOIN (SELECT region, min(tid) leader FROM sized GROUP BY 1) l USING (region) JOIN sized b ON b.tid = l.leader"""))
def series_distance(spark, sf_dir):
    """Every series against the first series of its region."""
    series = sized(spark, sf_dir)
    leaders = series.groupBy("region").agg(F.min("tid").alias("other_tid"))
    pairs = series.join(leaders, "region").select("tid", "other_tid")
    return groups.series_distance(series, pairs, PLACE_AND_SIZE).select("tid", "other_tid", F.round("distance", 6).alias("distance"))


@add("scaling_rules", grouped("nation", columns="""tid, gid, CAST(CASE WHEN count(*) OVER (PARTITION BY gid) = 1 THEN scaling WHEN nation = 'FRANCE' THEN 4
 WHEN nation = 'CHINA' THEN 3 WHEN source = 'Supplier#000000001' THEN 2 ELSE scaling END AS DOUBLE) scaling"""))
def scaling_rules(spark, sf_dir):
    """Rules apply to grouped series only; a member rule overrides a source rule."""
    clause = Clause(lca={"Location": 0}, source_scaling={"Supplier#000000001": 2.0},
                    member_scaling={("Location", 0, "CHINA"): 3.0, ("Location", 0, "FRANCE"): 4.0})
    d = groups.group_series(fx.series_seq(spark, sf_dir), [clause], LOCATION)
    return d.select("tid", "gid", F.col("scaling").cast("double").alias("scaling"))


@add("derived_series", sql("pts_ev", "series_ev", body="""SELECT tid, ts, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) AS value FROM (
 SELECT 101 tid, ts, sqrt(abs(CAST(value AS DOUBLE))) / scaling v FROM pts_ev JOIN series_ev USING (tid) WHERE source = 'click'
 UNION ALL SELECT 102, ts, value * 2 + 1 FROM pts_ev WHERE tid = 2
 UNION ALL SELECT 103, ts, value / scaling FROM pts_ev JOIN series_ev USING (tid) WHERE source = 'click')"""))
def derived_series(spark, sf_dir):
    stored = view.points(fx.store(spark, sf_dir, "pts_ev"))
    rules = [("click", 101, "sqrt(abs(cast(value as double))) / scalingFactor"), (2, 102, "value * 2 + 1"), ("click", 103, "value / scalingFactor")]
    d = groups.derive(stored, fx.series_ev(spark, sf_dir), rules)
    return d.select("tid", "ts", F.round(F.col("value").cast("double"), 4).alias("value"))


@add("derived_agg_s", sql("pts_ev", "series_ev", d="""SELECT 101 tid, CAST(sqrt(abs(CAST(value AS DOUBLE))) / scaling AS FLOAT) v FROM pts_ev JOIN series_ev USING (tid) WHERE source = 'click'
 UNION ALL SELECT 102, CAST(value AS DOUBLE) * 2 + 1 FROM pts_ev WHERE tid = 2
 UNION ALL SELECT 103, CAST(value AS DOUBLE) / scaling - 7 FROM pts_ev JOIN series_ev USING (tid) WHERE source = 'click'
 UNION ALL SELECT 104, 0.5 * CAST(value AS DOUBLE) FROM pts_ev WHERE tid = 1""",
     body="""SELECT CAST(tid AS INT) tid, count(*) AS count, round(min(v), 4) AS min, round(max(v), 4) AS max, round(sum(v), 2) AS sum, round(avg(v), 4) AS avg FROM (
 SELECT tid, CAST(v AS DOUBLE) v FROM d) GROUP BY 1"""))
def derived_agg_s(spark, sf_dir):
    """Three derived series from whole segments, one from points of its source."""
    rules = [("click", 101, "sqrt(abs(cast(value as double))) / scalingFactor"), (2, 102, "value * 2 + 1"), ("click", 103, "value / scalingFactor - 7"), (1, 104, "0.5 * value")]
    d = groups.derived_agg(fx.store(spark, sf_dir, "pts_ev"), fx.series_ev(spark, sf_dir), rules)
    return d.select("tid", "count", *[F.round(c, n).alias(c) for c, n in (("min", 4), ("max", 4), ("sum", 2), ("avg", 4))])
