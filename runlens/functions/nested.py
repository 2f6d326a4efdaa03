"""Nested values described level by level: what kind each part is, how long, and a little of what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels below the value, parts of a container, and code points of a text that are shown (fixed values).
DEPTH, WIDTH, SHOWN = 2, 8, 60


def kind(value: Column) -> Column:
    """list, dict, str, bool, int, float or null."""
    schema = F.schema_of_variant(value)
    starts = lambda x: F.startswith(schema, F.lit(x))
    return F.when(starts("ARRAY"), "list").when(starts("OBJECT"), "dict").when(schema == "STRING", "str").when(schema == "BOOLEAN", "bool").when(schema == "BIGINT", "int").when(value.isNull() | (schema == "VOID"), "null").otherwise("float")


def described(df: DataFrame, keys: list[str], value: str, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """keys, path, level, kind, length and shown of a VARIANT and its parts.

    Lists and dicts are walked down to ``depth`` levels and ``width`` parts
    each; deeper ones tell only their kind. A dict's parts go by their names.
    Each level is one pass over the rows of the level above, without a shuffle.
    """
    level = df.select(*keys, F.lit("$").alias("path"), F.col(value).alias("_v"))
    out = None
    for n in range(depth + 1):
        level = level.withColumn("kind", kind(F.col("_v")))
        items = F.when(F.col("kind") == "list", F.try_variant_get("_v", "$", "array<variant>"))
        entries = F.when(F.col("kind") == "dict", F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>")))
        text = F.try_variant_get("_v", "$", "string")
        shown = F.when(F.col("kind").isin("list", "dict", "null"), None).otherwise(F.substring(text, 1, SHOWN))
        length = F.when(F.lit(n < depth), F.coalesce(F.size(items), F.size(entries)))
        rows = level.select(*keys, "path", F.lit(n).alias("level"), "kind", F.when(F.col("kind").isin("list", "dict"), length).alias("length"), shown.alias("shown"))
        out = rows if out is None else out.unionByName(rows)
        if n < depth:
            parts = F.coalesce(
                F.transform(F.slice(items, 1, width), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("at"), x.alias("v"))),
                F.transform(F.slice(entries, 1, width), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("at"), e["value"].alias("v"))),
            )
            level = level.select(*keys, "path", F.explode(parts).alias("p")).select(*keys, F.concat("path", "p.at").alias("path"), F.col("p.v").alias("_v"))
    return out
