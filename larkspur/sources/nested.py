"""Nested feeds as VARIANT: every node by level, the names of ids, the values of nested lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.identity import cut

#: Feeds are not nested deeper; more levels raise an error.
DEEPEST = 64


def nodes(docs: DataFrame, key: str, json: str) -> DataFrame:
    """docs(key, json text) to (key, path, depth, node): every value of every document, the document itself at depth 0.

    path holds the position of each step, so that its order is that of reading a document from the front; fields stand in the order of
    their names, as VARIANT keeps them. Text that is no JSON has no nodes. A round goes one level down, all documents at once.
    """
    spark = docs.sparkSession
    level = docs.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("path"), F.try_parse_json(json).alias("node")).where("node IS NOT NULL")
    out, depth = level.withColumn("depth", F.lit(0)), 0
    while True:
        inner = level.where(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)"))
        found = inner.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()).toDF("pos", "field", "value"))
        level = cut(found.select("key", F.concat("path", F.array("pos")).alias("path"), F.col("value").alias("node")))
        if level.isEmpty():
            return out
        depth += 1
        if depth > DEEPEST:
            raise ValueError(f"documents are nested deeper than {DEEPEST} levels")
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))


def name_of(node: Column) -> Column:
    """A node's name: that of its local names in Portuguese, in English or the first one; without local names its own."""
    local = F.try_variant_get(node, "$.localNames", "variant")
    chosen = F.coalesce(
        F.nullif(F.try_variant_get(local, "$['pt-BR']", "string"), F.lit("")), F.nullif(F.try_variant_get(local, "$.en", "string"), F.lit("")),
        F.get(F.map_values(F.from_json(F.to_json(local), "map<string, string>")), F.lit(0)),
    )
    return F.when(F.schema_of_variant(local).startswith("OBJECT"), chosen).otherwise(F.try_variant_get(node, "$.name", "string"))


def dictionary(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, id, name, depth): what each id of a document is called; of several names the last one read."""
    named = nodes(docs, key, json).where(F.schema_of_variant("node").startswith("OBJECT")).select("key", "path", "depth", F.try_variant_get("node", "$.id", "string").alias("id"), name_of(F.col("node")).alias("name"))
    real = named.where("id NOT IN ('', '0', 'false') AND name != ''")
    return real.groupBy("key", "id").agg(F.max_by(F.struct("name", "depth"), "path").alias("last")).select("key", "id", "last.name", "last.depth")


def flat_values(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, pos, value) of the values in nested lists, in order, without nulls."""
    found = nodes(docs, key, json).where(~F.schema_of_variant("node").rlike("^(OBJECT|ARRAY|VOID)")).select("key", "path", F.try_variant_get("node", "$", "string").alias("value"))
    return found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("path", "value"))).alias("all")).select("key", F.posexplode("all").alias("pos", "v")).select("key", "pos", "v.value")
