"""Parent-child links to full hierarchies (problem 2).

Weighted disjoint-set forests: each partition of links contracts its own chains to (exit, offset) with numpy,
then only the exits, which are the few keys that other partitions point to, are merged round by round, the
distance doubling each time; at last every key takes over the state of its exit. Paths are gathered on the same
way from the indexed parents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.keys import filled, instant
from arborlake.session import checkpoint, parallelism

STATE = "node string, up string, state string, root string, cycle string, depth bigint, lo string, last string, seg array<string>"


def current_links(df: DataFrame, key: str, parent: str, accepted: str | None, updated: str, tie: Column | None = None) -> DataFrame:
    """node, up: the one step upwards of each key.

    Of several rows of a key the one with the latest `updated` (text in any ISO notation; missing counts as
    oldest) counts, then the one with the greatest `tie`, then the greatest links. accepted, if filled and
    not the key itself, goes before parent. Rows whose key is null or blank are left out.
    """
    at = F.coalesce(instant(F.col(updated)), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    acc = F.col(accepted) if accepted else F.lit(None).cast("string")
    up = F.when(filled(acc) & (acc != F.col(key)), acc).when(filled(F.col(parent)), F.col(parent))
    rows = df.where(filled(F.col(key))).select(F.col(key).alias("node"), at.alias("at"), (tie if tie is not None else F.lit(0)).alias("tie"), up.alias("up"))
    return rows.groupBy("node").agg(F.max(F.struct("at", "tie", "up")).alias("m")).select("node", "m.up")


def _contract(with_paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        links = pd.concat(frames, ignore_index=True).sort_values("node", ignore_index=True)  # index order is code point order
        node, up = links["node"].to_numpy(), links["up"].to_numpy()
        n = len(node)
        own = np.arange(n)
        top = pd.Index(node).get_indexer(links["up"])
        outside = top < 0
        top = np.where(outside, own, top)
        off = np.where(outside, 0, 1).astype(np.int64)
        lo = own.copy()
        chain = [[s] for s in node] if with_paths else None
        # Doubling: after k turns each link spans 2^k steps; a key still under way after n steps runs in a circle.
        steps = 1
        low_span, hop = lo.copy(), top.copy()
        while not outside[top].all() and steps <= 2 * n:
            low_span = np.minimum(low_span, low_span[hop])
            hop = hop[hop]
            off = off + off[top]
            top = top[top]
            steps *= 2
        open_ = outside[top]
        state = np.where(~open_, "cycle", np.where(pd.isna(up[top]), "root", "open"))
        if with_paths:
            parent = np.where(outside, -1, pd.Index(node).get_indexer(links["up"]))
            for i in range(n):
                seg, j = chain[i], parent[i]
                if not open_[i]:
                    chain[i] = None
                    continue
                while j >= 0:
                    seg.append(node[j])
                    j = parent[j]
        # low_span[top] has gone round the whole circle, and top lies on it.
        lo_path = np.minimum(low_span, low_span[top])
        yield pd.DataFrame({
            "node": node,
            "up": np.where(state == "open", up[top], None),
            "state": state,
            "root": np.where(state == "root", node[top], None),
            "cycle": np.where(state == "cycle", node[low_span[top]], None),
            "depth": np.where(state == "open", off + 1, off),
            "lo": node[lo_path],
            "last": node[top],
            "seg": chain if with_paths else [None] * n,
        })

    return run


def _merge(open_: DataFrame, known: DataFrame) -> DataFrame:
    """One hierarchical merge: an open key takes over the state of its exit."""
    t = known.select(*[F.col(c).alias("t_" + c) for c in known.columns])
    j = open_.join(t, open_.up == t.t_node, "left")
    missing = F.col("t_node").isNull()
    state = F.when(missing, "root").otherwise(F.col("t_state"))
    goes_on = state == "open"
    return j.select(
        "node",
        F.when(goes_on, F.col("t_up")).alias("up"),
        state.alias("state"),
        F.when(missing, F.col("last")).otherwise(F.col("t_root")).alias("root"),
        F.col("t_cycle").alias("cycle"),
        (F.col("depth") + F.when(missing, -1).otherwise(F.coalesce("t_depth", F.lit(0)))).alias("depth"),
        F.least("lo", "t_lo").alias("lo"),
        F.coalesce("t_last", "last").alias("last"),
        F.when(missing, F.col("seg")).when(state == "cycle", F.lit(None).cast("array<string>")).otherwise(F.concat("seg", "t_seg")).alias("seg"),
        (goes_on & (F.coalesce(F.col("t_lo") < F.col("lo"), F.lit(False)))).alias("changed"),
    )


def resolve(links: DataFrame, with_paths: bool = False) -> DataFrame:
    """node, root, depth, cycle_key, path of each node of links(node, up), node unique.

    A way ends at a node without a link or whose link leads to no node; that last node is the root, with depth
    0, and path runs from the root to the node. Where the way runs into a circle, cycle_key is the smallest
    node on the circle by code point and root, depth and path are null. Empty input gives no rows. No step
    gathers a component: the rounds hold boundary keys only and their number is the logarithm of the depth.
    """
    spark = links.sparkSession
    parts = links.select("node", "up").repartition(parallelism(spark), "node")
    local = checkpoint(parts.mapInPandas(_contract(with_paths), STATE))
    exits = local.where("state = 'open'").select(F.col("up").alias("node")).distinct()
    bound = checkpoint(local.join(exits, "node", "left_semi"))
    done, open_ = bound.where("state <> 'open'"), bound.where("state = 'open'")
    stuck, before = False, None
    while True:
        n = open_.agg(F.count(F.lit(1)), F.count_distinct("up")).first()
        if not n[0]:
            break
        nxt = checkpoint(_merge(open_, done.unionByName(open_)))
        still = nxt.where("state = 'open'")
        got = still.agg(F.count(F.lit(1)), F.count_distinct("up"), F.max(F.col("changed").cast("int"))).first()
        done = done.unionByName(nxt.where("state <> 'open'").drop("changed"))
        open_ = still.drop("changed")
        if got[0] == n[0] and not stuck:
            stuck = True  # nothing was resolved in this round: all the rest runs in circles
            open_ = open_.withColumn("seg", F.lit(None).cast("array<string>"))
        if stuck and (got[0], got[1]) == before and not got[2]:
            # The exits map onto themselves, so all of them lie on circles, and their minima no longer change.
            on = open_.select(F.col("node").alias("c_node"), F.col("lo").alias("c_lo"))
            circles = open_.join(on, open_.up == on.c_node).withColumn("cycle", F.col("c_lo")).withColumn("state", F.lit("cycle")).drop("c_node", "c_lo")
            done = done.unionByName(circles.select(done.columns))
            break
        before = (got[0], got[1])
    done = checkpoint(done)
    ready = local.where("state <> 'open'").unionByName(_merge(local.where("state = 'open'"), done).drop("changed"))
    circle = F.col("state") == "cycle"
    return ready.select(
        "node",
        F.when(~circle, F.col("root")).alias("root"),
        F.when(~circle, F.col("depth")).alias("depth"),
        F.when(circle, F.col("cycle")).alias("cycle_key"),
        F.when(~circle, F.reverse("seg")).alias("path"),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """ancestor, descendant, distance: one row per pair on a path, the node itself left out; circles have none."""
    return (
        resolved.where("path is not null and depth > 0")
        .select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
        .where("at < depth")
        .select("ancestor", "descendant", (F.col("depth") - F.col("at")).cast("bigint").alias("distance"))
    )
