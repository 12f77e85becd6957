"""Node and edge tables, trees and roll-ups; paths come from the hierarchy operator, not from walking on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.hierarchy import resolve
from arborlake.session import folder_names, shared_folder


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes unique by id, edges summed over parallels): no self loops and no edge with a missing end."""
    n = nodes.groupBy("id").agg(F.min("label").alias("label"), F.max("weight").alias("weight"))
    ids = n.select("id")
    e = edges.where("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return n, e.groupBy("source", "target", "type").agg(F.sum("value").alias("value"))


def node_values(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, value: the greatest of its own weight, what flows in and what flows out."""
    flow = edges.select(F.col("source").alias("id"), F.col("value").alias("out"), F.lit(0.0).alias("in")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0.0).alias("out"), F.col("value").alias("in")))
    sums = flow.groupBy("id").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    return nodes.join(sums, "id", "left").select("id", F.greatest(F.coalesce("weight", F.lit(0.0)), F.coalesce("in", F.lit(0.0)), F.coalesce("out", F.lit(0.0)), F.lit(1e-6)).alias("value"))


def complete_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes together with the endpoints of edges that lack one."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    return nodes.unionByName(ends.join(nodes.select("id"), "id", "left_anti").withColumn("label", F.col("id")).withColumn("weight", F.lit(0.0)))


def parse_edges(df: DataFrame, text: str) -> DataFrame:
    """source, target of `a->b` texts; others give no edge."""
    parts = F.split(F.col(text), r"\s*->\s*")
    return df.where(F.col(text).contains("->")).select(F.trim(parts[0]).alias("source"), F.trim(parts[1]).alias("target"))


def tree_metrics(links: DataFrame) -> DataFrame:
    """node, root, depth, leaves, descendants; nodes on circles are cut and keep null depth.

    Each node adds one to the counts of its ancestors by its path, so hot ancestors are summed on the map side.
    """
    r = resolve(links, with_paths=True)
    inner = links.select(F.col("up").alias("node")).where("node is not null").distinct()
    leaf = r.join(inner.withColumn("inner", F.lit(1)), "node", "left").withColumn("leaf", F.col("inner").isNull().cast("bigint"))
    up = leaf.where("path is not null").select(F.explode("path").alias("node"), "leaf", F.lit(1).cast("bigint").alias("one"))
    sums = up.groupBy("node").agg(F.sum("leaf").alias("leaves"), (F.sum("one") - 1).alias("descendants"))
    return r.select("node", "root", "depth").join(sums, "node", "left")


def roll_up(links: DataFrame, values: DataFrame) -> DataFrame:
    """node, total: the greater of its own value and the sum of the totals of its children; nodes on circles are left out.

    Levels are written once, split by depth, and added up from the deepest: each level is read and shuffled once,
    whatever the depth. Values that repeat for a node count as their greatest.
    """
    spark = links.sparkSession
    out = shared_folder(spark, "levels")
    # A node that only stands above others is a node, too.
    every = links.select("node", "up").unionByName(links.where("up is not null").select(F.col("up").alias("node"), F.lit(None).cast("string").alias("up")))
    one = every.groupBy("node").agg(F.max("up").alias("up"))
    own = values.groupBy("node").agg(F.max("value").cast("double").alias("value"))
    rows = resolve(one).where("depth is not null").select("node", "depth").join(one, "node").join(own, "node", "left")
    rows.select("node", "up", F.coalesce("value", F.lit(0.0)).alias("value"), "depth").write.partitionBy("depth").parquet(out)
    levels = sorted((int(n.split("=")[1]) for n in folder_names(spark, out) if n.startswith("depth=")), reverse=True)
    schema, below = "node string, up string, value double", None
    for d in levels:
        level = spark.read.schema(schema).parquet(f"{out}/depth={d}")
        total = F.col("value")
        if below is not None:
            level = level.join(below, "node", "left")
            total = F.greatest("value", F.coalesce("sum", F.lit(0.0)))
        level.select("node", "up", total.alias("total")).write.parquet(f"{out}/totals/level={d}")
        below = spark.read.schema("node string, up string, total double").parquet(f"{out}/totals/level={d}").groupBy(F.col("up").alias("node")).agg(F.sum("total").alias("sum"))
    if not levels:
        return spark.createDataFrame([], "node string, total double")
    return spark.read.schema("node string, up string, total double").parquet(*[f"{out}/totals/level={d}" for d in levels]).select("node", "total")


def branch_lengths(links: DataFrame, lengths: DataFrame) -> DataFrame:
    """node, length to the root: the sum of the lengths along its path."""
    r = resolve(links, with_paths=True).where("path is not null").select("node", F.explode("path").alias("step"))
    return r.join(lengths.withColumnRenamed("node", "step"), "step", "left").groupBy("node").agg(F.sum(F.coalesce("length", F.lit(0.0))).alias("total"))


def depth_layers(edges: DataFrame) -> DataFrame:
    """Depth and circle of each node of a graph in which every node has one edge upwards at most."""
    return resolve(edges.select(F.col("source").alias("node"), F.col("target").alias("up"))).select("node", "depth", "cycle_key")


def infer_parents(df: DataFrame, ranks: list[str], label: str, rank: str) -> DataFrame:
    """label, parent: the value of the nearest higher rank column that is itself a label."""
    order = F.create_map(*[x for i, r in enumerate(ranks) for x in (F.lit(r), F.lit(i))])
    labels = df.select(F.col(label).alias("parent")).distinct()
    up = df.select(F.col(label).alias("label"), F.col(rank).alias("own"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(r).alias("parent")) for i, r in enumerate(ranks) if r in df.columns])).alias("x")).select("label", "own", "x.i", "x.parent")
    up = up.where((F.col("parent") != "") & (F.col("parent") != F.col("label")) & (F.col("i") < F.coalesce(order[F.col("own")], F.lit(len(ranks))))).join(labels, "parent", "left_semi")
    return up.groupBy("label").agg(F.max_by("parent", "i").alias("parent"))


def parents_by_id_or_name(df: DataFrame, key: str, name: str, parent: str) -> DataFrame:
    """key, parent_key: the parent found by its id, or else by its lower-case name (smallest key of that name)."""
    ids = df.select(F.col(key).alias("by_id")).distinct()
    names = df.groupBy(F.lower(name).alias("n")).agg(F.min(key).alias("by_name"))
    j = df.select(key, parent).join(ids, F.col(parent) == F.col("by_id"), "left").join(names, F.lower(parent) == F.col("n"), "left")
    return j.select(key, F.coalesce("by_id", "by_name").alias("parent_key"))


def expand_lineage(df: DataFrame, lineage: str, source: str, key: str) -> DataFrame:
    """One row per lineage prefix: id, name, rank, parent_id, terminal. Ancestors get an id from the digest of the prefix, the record keeps its own."""
    at = df.select(key, source, F.col(lineage).alias("l"), F.posexplode(lineage).alias("i", "x"))
    src = F.coalesce(F.col(source), F.lit(""))
    prefix_ = F.when(src == "", "speciedex").otherwise(src)
    def made(prefix, name, rank):
        steps = F.transform(prefix, lambda s: F.struct(s["name"].alias("name"), s["rank"].alias("rank")))
        return F.concat(prefix_, F.lit(":taxon:"), F.sha2(F.to_json(F.struct(steps.alias("lineage"), name.alias("name"), rank.alias("rank"), src.alias("source"))), 256))
    last = F.col("i") == F.size("l") - 1
    own = F.when(last, F.col(key)).otherwise(made(F.slice("l", F.lit(1), F.col("i") + 1), F.col("x.name"), F.col("x.rank")))
    parent = F.when(F.col("i") > 0, made(F.slice("l", F.lit(1), F.greatest(F.col("i"), F.lit(1))), F.get("l", F.col("i") - 1)["name"], F.get("l", F.col("i") - 1)["rank"]))
    return at.select(own.alias("id"), F.col("x.name").alias("name"), F.col("x.rank").alias("rank"), parent.alias("parent_id"), last.alias("terminal"))


def merge_records(df: DataFrame, key: str, order: str, fields: list[str], lineage: str) -> DataFrame:
    """One record a key: each field's first filled value in order, the longest lineage."""
    filled = lambda c: F.min_by(F.col(c), F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(order)))
    return df.groupBy(key).agg(*[filled(c).alias(c) for c in fields], F.max_by(lineage, F.struct(F.size(lineage), -F.col(order))).alias(lineage))


def normalize_matrix(df: DataFrame, row: str, values: str) -> DataFrame:
    """row, col, value of ragged rows, padded with null to the longest."""
    width = df.agg(F.max(F.size(values)).alias("w"))
    return df.crossJoin(F.broadcast(width)).select(row, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.get(F.col(values), i))).alias("col", "value"))


def rank_relation(df: DataFrame, a: str, b: str, ranks: list[str]) -> DataFrame:
    """Level difference and relation (above, below, same) of two rank columns."""
    order = F.create_map(*[x for i, r in enumerate(ranks) for x in (F.lit(r), F.lit(i))])
    d = order[F.lower(F.col(b))] - order[F.lower(F.col(a))]
    return df.withColumn("levels", d).withColumn("relation", F.when(d > 0, "above").when(d < 0, "below").when(d == 0, "same"))


def edge_ranks(edges: DataFrame) -> DataFrame:
    """Edges with their rank by value from each source; ties by target."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("value"), "target")))
