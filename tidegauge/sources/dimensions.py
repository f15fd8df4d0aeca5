"""Dimension files: definitions, an empty line, then one row of members per source."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators.groups import Hierarchy

# Type names of a dimension file and their Spark types.
TYPES = {"int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "text": "string"}


def parse_definitions(lines: list[str]) -> tuple[Hierarchy, list[tuple[str, str]]]:
    """Hierarchy and (column, Spark type) list from lines `name, level type, ...[, weight]`."""
    levels, weights, columns = {}, {}, []
    for line in lines:
        parts = [p.strip() for p in line.split(",")]
        name, members = parts[0], parts[1:]
        if members and " " not in members[-1]:
            weights[name] = 1.0 / float(members.pop())
        if not members:
            raise ValueError(f"no level follows the name in {line!r}")
        levels[name] = []
        for member in members:
            column = member.split(" ")
            if len(column) != 2 or column[1].lower() not in TYPES:
                raise ValueError(f"expected `level type` with a known type in {line!r}")
            levels[name].append(column[0].lower())
            columns.append((column[0].lower(), TYPES[column[1].lower()]))
    return Hierarchy(levels, weights), columns


def load_dimensions(spark: SparkSession, path: str, definitions: list[str] | None = None) -> tuple[Hierarchy, DataFrame]:
    """The hierarchy and a table (source, member columns) of one dimension file.

    The lines before the first empty line define the dimensions and go to the driver; the rows after it, chosen by their
    place in the file, stay distributed. With `definitions` the file holds rows only. A row with the wrong number of
    members, or a member of the wrong type, raises when the table is computed.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    text = spark.read.text(path).select(F.trim("value").alias("value"), place.alias("place"), F.col("_metadata.file_path").alias("file"))
    rows = text
    if definitions is None:
        files, end = text.agg(F.count_distinct("file"), F.min(F.when(F.col("value") == "", F.col("place")))).first()
        if files > 1:
            raise ValueError(f"one dimension file is expected, {path} holds {files}")
        if end is None:
            raise ValueError(f"no empty line follows the definitions in {path}")
        end = F.struct(F.lit(end["block"]).alias("block"), F.lit(end["line"]).alias("line"))
        definitions = [r.value for r in text.where(F.col("place") < end).orderBy("place").collect()]
        rows = text.where(F.col("place") > end)
    hierarchy, columns = parse_definitions(definitions)
    parts = F.transform(F.split("value", ","), lambda p: F.trim(p))
    width = len(columns) + 1
    checked = F.when(F.size(parts) == width, parts).otherwise(
        F.raise_error(F.concat(F.lit(f"expected a source and {len(columns)} members, found: "), F.col("value"))))
    d = rows.where("value != ''").select(checked.alias("p"))
    return hierarchy, d.select(F.col("p")[0].alias("source"),
                               *[F.col("p")[i + 1].cast(t).alias(c) for i, (c, t) in enumerate(columns)])
