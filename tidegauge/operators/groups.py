"""Dimensions, correlation groups, scaling rules and derived series over the `series` table."""

import itertools
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.operators.aggregate import with_stats
from tidegauge.operators.view import members, points_by_member
from tidegauge.plans.lookup import required
from tidegauge.plans.ordered import positions
from tidegauge.session import written


@dataclass(frozen=True)
class Hierarchy:
    """Ordered level columns per dimension; a weight W in a dimension file counts as 1/W."""

    levels: Mapping[str, Sequence[str]]
    weights: Mapping[str, float] = field(default_factory=dict)

    def column(self, dimension: str, level: int) -> str:
        """The column of a level: 1 is the top, 0 the bottom, negative counts from the bottom."""
        columns = self._dimension(dimension)
        index = len(columns) - 1 + level if level <= 0 else level - 1
        if not 0 <= index < len(columns):
            raise ValueError(f"{dimension!r} has {len(columns)} levels, asked for {level}")
        return columns[index]

    def prefix(self, dimension: str, level: int) -> list[str]:
        columns = list(self._dimension(dimension))
        return columns[:columns.index(self.column(dimension, level)) + 1]

    def auto_distance(self) -> float:
        """Lowest possible distance above zero."""
        if not self.levels:
            raise ValueError("a distance needs at least one dimension")
        return 1.0 / max(len(c) for c in self.levels.values()) / len(self.levels)

    def distance_of(self, shared: Mapping[str, int]) -> float:
        """Distance of two groups that share that many levels in each dimension."""
        parts = [self.weights.get(d, 1.0) * (len(c) - shared[d]) / len(c) for d, c in self.levels.items()]
        return min(sum(parts) / len(parts), 1.0)

    def level_vectors(self, bound: float) -> list[dict[str, int]]:
        """Numbers of shared levels whose distance is within the bound, the closest first."""
        names = list(self.levels)
        grid = itertools.product(*[range(len(self.levels[d]), -1, -1) for d in names])
        vectors = [dict(zip(names, v)) for v in grid]
        return sorted((v for v in vectors if self.distance_of(v) <= bound), key=self.distance_of)

    def _dimension(self, dimension: str) -> Sequence[str]:
        if dimension not in self.levels:
            raise ValueError(f"{dimension!r} is none of {sorted(self.levels)}")
        return self.levels[dimension]


@dataclass(frozen=True)
class Clause:
    """All given conditions must hold for two groups to be merged.

    `members` maps (dimension, level) to allowed members, `lca` a dimension to the level down to
    which all members agree. Scaling factors are set on series that the clause has grouped.
    """

    sources: Sequence[str] = ()
    members: Mapping[tuple[str, int], Sequence] = field(default_factory=dict)
    lca: Mapping[str, int] = field(default_factory=dict)
    distance: float | None = None
    source_scaling: Mapping[str, float] = field(default_factory=dict)
    member_scaling: Mapping[tuple[str, int, str], float] = field(default_factory=dict)


def group_series(series: DataFrame, clauses: Sequence[Clause], hierarchy: Hierarchy | None = None,
                 first_gid: int = 1) -> DataFrame:
    """Set gid (and scaling) of every series by applying the clauses in order.

    Groups merge when all their series meet the conditions and agree on the compared levels, which
    is an equivalence, so each step is a groupBy over the series. Ids follow the smallest tid.
    Every step but the first reads the table that the one before wrote, so plans keep their size.
    """
    steps = 0
    hierarchy = hierarchy or Hierarchy({})
    d = series.drop("gid").withColumn("__g", F.col("tid"))
    if "scaling" not in d.columns:
        d = d.withColumn("scaling", F.lit(1.0).cast("float"))
    for clause in clauses:
        allowed = F.lit(True)
        if clause.sources:
            allowed &= F.col("source").isin(list(clause.sources))
        for (dimension, level), names in clause.members.items():
            allowed &= F.col(hierarchy.column(dimension, level)).isin(list(names))
        prefix = [c for dimension, level in clause.lca.items() for c in hierarchy.prefix(dimension, level)]
        vectors = [None] if clause.distance is None else hierarchy.level_vectors(clause.distance)
        d = d.withColumn("__was", F.col("__g"))
        for vector in vectors:
            if steps:
                d = written(d.sparkSession, d, "grouping")
            steps += 1
            shared = [] if vector is None else [c for dim, n in vector.items() for c in hierarchy.levels[dim][:n]]
            d = _merge(d, allowed, [*prefix, *shared])
        d = _scale(d, clause, hierarchy)
    ids = positions(d.select("__g").distinct(), [], ["__g"], F.floor(F.col("__g") / 65_536), "gid")
    ids = ids.select("__g", (F.col("gid") + (first_gid - 1)).cast("int").alias("gid"))
    return d.join(ids, "__g").drop("__g", "__was")


def _merge(d: DataFrame, allowed: Column, levels: Sequence[str]) -> DataFrame:
    key = F.struct(F.lit(0).alias("__0"), *levels)
    groups = d.groupBy("__g").agg(F.bool_and(allowed).alias("ok"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    roots = groups.where(F.col("ok") & (F.col("lo") == F.col("hi")))
    targets = roots.groupBy("lo").agg(F.min("__g").alias("__to"))
    moves = roots.join(targets, "lo").select("__g", "__to")
    return d.join(moves, "__g", "left").withColumn("__g", F.coalesce("__to", "__g")).drop("__to")


def _scale(d: DataFrame, clause: Clause, hierarchy: Hierarchy) -> DataFrame:
    if not clause.source_scaling and not clause.member_scaling:
        return d.drop("__was")
    scaling = F.col("scaling")
    for source, factor in clause.source_scaling.items():
        scaling = F.when(F.col("source") == source, F.lit(float(factor))).otherwise(scaling)
    for (dimension, level, member), factor in clause.member_scaling.items():
        scaling = F.when(F.col(hierarchy.column(dimension, level)) == member, F.lit(float(factor))).otherwise(scaling)
    touched = d.groupBy("__g").agg((F.min("__was") != F.max("__was")).alias("__merged"))
    return (d.join(touched, "__g")
            .withColumn("scaling", F.when(F.col("__merged"), scaling).otherwise(F.col("scaling")).cast("float"))
            .drop("__was", "__merged"))


def shared_levels(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """How many levels of one dimension agree from the top."""
    count = F.lit(len(left))
    for n in range(len(left) - 1, -1, -1):
        count = F.when(left[n] != right[n], F.lit(n)).otherwise(count)
    return count


def series_distance(series: DataFrame, pairs: DataFrame, hierarchy: Hierarchy) -> DataFrame:
    """(tid, other_tid, distance) of the listed pairs of series."""
    columns = [c for cs in hierarchy.levels.values() for c in cs]
    left = series.select("tid", *[F.col(c).alias(f"l_{c}") for c in columns])
    right = series.select(F.col("tid").alias("other_tid"), *[F.col(c).alias(f"r_{c}") for c in columns])
    total = F.lit(0.0)
    for name, cs in hierarchy.levels.items():
        lca = shared_levels([F.col(f"l_{c}") for c in cs], [F.col(f"r_{c}") for c in cs])
        total += (len(cs) - lca) / F.lit(float(len(cs))) * hierarchy.weights.get(name, 1.0)
    distance = F.least(total / len(hierarchy.levels), F.lit(1.0))
    return pairs.join(left, "tid").join(right, "other_tid").select("tid", "other_tid", distance.alias("distance"))


# Expressions that rise or fall evenly with the value, [c *] value [* c | / c] [+ c | - c] with c a number or scalingFactor.
_C = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+|scalingFactor)"
_EVEN = re.compile(rf"\s*(?:{_C}\s*\*\s*)?value(?:\s*[*/]\s*{_C})?(?:\s*[+-]\s*{_C})?\s*", re.I)


def is_even(expression: str) -> bool:
    return _EVEN.fullmatch(expression) is not None


def _applied(expression: str, to: str) -> Column:
    return F.expr(re.sub(r"\bvalue\b", f"cast({to} AS double)", expression, flags=re.I)).cast("double")


def derived_agg(groups: DataFrame, series: DataFrame, derived: Iterable[tuple[int | str, int, str]]) -> DataFrame:
    """(tid, count, min, max, sum, avg) of derived series, see derive, from the segment groups of their sources.

    Even expressions come from the count, extremes and sum of each segment, of which none is decoded; the others are evaluated on the
    points of their sources, as FLOAT. A derived series without segments gives no row.
    """
    rules = list(derived)
    even, other = [r for r in rules if is_even(r[2])], [r for r in rules if not is_even(r[2])]
    names = lambda some: (F.col("source").isin([s for s, _, _ in some if isinstance(s, str)]) | F.col("tid").isin([s for s, _, _ in some if not isinstance(s, str)]))
    parts = []
    if even:
        known = series.where(names(even)).select("tid", "source", F.col("scaling").alias("scalingFactor"))
        d = with_stats(members(groups)).join(known, "tid")  # only sources are wanted
        rows = []
        for source, tid, text in even:
            is_source = F.col("source") == source if isinstance(source, str) else F.col("tid") == source
            ends = [_applied(text, c) for c in ("vmin", "vmax")]
            total = _applied(text, "vsum") + (F.col("n_ticks") - 1) * _applied(text, "0")
            rows.append(F.when(is_source, F.struct(F.lit(tid).alias("tid"), F.col("n_ticks").cast("long").alias("n"), F.least(*ends).alias("lo"),
                                                   F.greatest(*ends).alias("hi"), total.alias("total"))))
        d = d.select(F.explode(F.array_compact(F.array(*rows))).alias("p")).select("p.*")
        parts.append(d.groupBy("tid").agg(F.sum("n").alias("count"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("total").alias("sum")))
    if other:
        stored = points_by_member(groups, series.withColumn("scaling", F.lit(1.0)), names(other)).select("tid", "ts", "value")
        v = F.col("value").cast("double")
        parts.append(derive(stored, series, other).groupBy("tid").agg(F.count("value").alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum")))
    if not parts:
        raise ValueError("no derived series given")
    return reduce(DataFrame.unionByName, parts).withColumn("avg", F.col("sum") / F.col("count"))


def derive(stored: DataFrame, series: DataFrame, derived: Iterable[tuple[int | str, int, str]]) -> DataFrame:
    """Points of derived series: (source tid or name, new tid, SQL expression).

    The expression sees the stored `value` and the `scalingFactor` of its source. All expressions
    are evaluated in one pass over the points of the sources.
    """
    rules = list(derived)
    d = required(stored, series.select("tid", "source", F.col("scaling").alias("scalingFactor")), ["tid"], "series")
    outputs = []
    for source, tid, expression in rules:
        is_source = F.col("source") == source if isinstance(source, str) else F.col("tid") == source
        row = F.struct(F.lit(tid).alias("tid"), F.expr(expression).cast("float").alias("value"))
        outputs.append(F.when(is_source, row))
    rows = F.array_compact(F.array(*outputs))
    return (d.select("ts", F.explode(rows).alias("p")).select("p.tid", "ts", "p.value"))
