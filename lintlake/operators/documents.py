"""JSON documents merged by path: maps are merged key by key, everything else (lists too) is replaced whole, the last layer wins.

Documents are taken apart level by level into paths with their values, paths that a later layer overrides are dropped by
joins on paths, and what is left is put together again from the deepest level up. No document has to fit a schema, and
the layers of one document may lie in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.operators.rule_documents import kind
from lintlake.session import written


def leaves(layers: DataFrame, key: str = "doc", order: str = "layer", doc: str = "body") -> DataFrame:
    """doc, layer, path (array), value (JSON), map: what the documents (VARIANT) hold at the ends of their maps; map: an empty map is there."""
    level = layers.select(F.col(key).alias("doc"), F.col(order).alias("layer"), F.array().cast("array<string>").alias("path"), F.col(doc).alias("v"))
    out = None
    while True:
        level = written(level, "document-level")
        if level.isEmpty():
            break
        inner = F.try_variant_get("v", "$", "map<string,variant>")
        is_map = kind(F.col("v")) == "map"
        ends = level.filter(~is_map | (F.size(inner) == 0)).select("doc", "layer", "path", F.coalesce(F.to_json("v"), F.lit("null")).alias("value"), is_map.alias("map"))
        out = ends if out is None else out.unionByName(ends)
        level = level.filter(is_map).select("doc", "layer", "path", F.explode(inner)).select("doc", "layer", F.concat("path", F.array("key")).alias("path"), F.col("value").alias("v"))
    return out if out is not None else layers.sparkSession.createDataFrame([], f"doc {dict(layers.dtypes)[key]}, layer {dict(layers.dtypes)[order]}, path array<string>, value string, map boolean")


def _overridden(ends: DataFrame) -> DataFrame:
    """The ends that stay. An end goes if a later layer has another end at its path or a value that is no map above it, or anything below it; an empty map goes if anything that stays lies below it."""
    above = ends.select("doc", "layer", "path", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("n")).select("doc", "layer", F.slice("path", 1, F.col("n")).alias("at"), (F.col("n") < F.size("path")).alias("below"))
    newest = above.filter("below").groupBy("doc", "at").agg(F.max("layer").alias("deep"))
    tops = ends.groupBy("doc", F.col("path").alias("at")).agg(F.max("layer").alias("same"), F.max(F.when(~F.col("map"), F.col("layer"))).alias("flat"))
    # of each end the newest layer with a value that is no map above it
    over = ends.select("doc", "path", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("n")).filter(F.col("n") < F.size("path")).select("doc", "path", F.slice("path", 1, F.col("n")).alias("at"))
    # no side is sent to all: written paths take a fraction of the room on disk, so an estimate by bytes takes large sides for small ones
    over = over.distinct().join(tops.select("doc", "at", "flat").hint("merge"), ["doc", "at"]).groupBy("doc", "path").agg(F.max("flat").alias("flat"))
    out = ends.join(over.hint("merge"), ["doc", "path"], "left").join(newest.withColumnRenamed("at", "path").hint("merge"), ["doc", "path"], "left").join(tops.select("doc", F.col("at").alias("path"), "same").hint("merge"), ["doc", "path"])
    stays = (F.col("layer") == F.col("same")) & ~F.coalesce(F.col("flat") > F.col("layer"), F.lit(False)) & ~F.coalesce(F.col("deep") > F.col("layer"), F.lit(False))
    out = written(out.filter(stays).select("doc", "path", "value", "map"), "document-ends")
    filled = out.select("doc", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("n"), "path").filter(F.col("n") < F.size("path")).select("doc", F.slice("path", 1, F.col("n")).alias("path")).distinct().withColumn("_filled", F.lit(True))
    return out.join(filled.hint("merge"), ["doc", "path"], "left").filter(~(F.col("map") & F.coalesce("_filled", F.lit(False)))).select("doc", "path", "value")


def deep_merge(layers: DataFrame, key: str = "doc", order: str = "layer", doc: str = "body") -> DataFrame:
    """doc, merged (JSON, names in order) of documents given in layers (VARIANT), a layer once for each document; null counts as the value null."""
    parts = written(_overridden(leaves(layers, key, order, doc)), "document-parts")
    deepest = parts.agg(F.max(F.size("path"))).first()[0] or 0
    level = parts
    for n in range(deepest, 0, -1):
        here, rest = level.filter(F.size("path") == n), level.filter(F.size("path") < n)
        name = F.element_at("path", -1)
        member = F.concat(F.regexp_replace(F.to_json(F.array(name)), r"(?s)^\[(.*)\]$", "$1"), F.lit(":"), F.col("value"))
        up = here.groupBy("doc", F.slice("path", 1, n - 1).alias("path")).agg(F.array_sort(F.collect_list(F.struct(name.alias("k"), member.alias("m")))).alias("_m"))
        up = up.select("doc", "path", F.concat(F.lit("{"), F.array_join(F.transform("_m", lambda x: x["m"]), ","), F.lit("}")).alias("value"))
        level = written(rest.unionByName(up), "document-parts")
    return level.select(F.col("doc").alias(key), F.col("value").alias("merged"))
