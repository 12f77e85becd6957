"""References to records that do not exist (problem 4).

Distinct non-null foreign keys are anti-joined against the parents; the failing keys go back to the referring
rows for the cases and for counts per table and period.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.keys import record_id, strip


def parent_states(parents: DataFrame, key: Column, loaded: Column, status: Column) -> DataFrame:
    """key, first_seen, deleted: when the key was first loaded and whether its last load says deleted.

    Ties of the last load: deleted wins only if every row of that instant says deleted. Null times count as
    the oldest. Rows without a key are left out.
    """
    gone = F.coalesce(F.lower(strip(status)) == "deleted", F.lit(False))
    order = F.coalesce(loaded, F.lit("0001-01-02 00:00:00").cast("timestamp"))
    rows = parents.select(record_id(key).alias("key"), order.alias("at"), gone.alias("gone")).where("key is not null")
    return rows.groupBy("key").agg(F.min("at").alias("first_seen"), F.max(F.struct("at", ~F.col("gone"))).alias("last")).select(
        "key", "first_seen", (~F.col("last.col2")).alias("deleted")
    )


def references(df: DataFrame, ref_table: str, ref_id: str) -> DataFrame:
    """The referring rows of one table in the common shape."""
    return df.select(
        F.lit(ref_table).alias("ref_table"), F.col("provider"), F.col(ref_id).alias("ref_id"), F.col("speciedex_id"), F.col("loaded_at"), record_id(F.col("speciedex_id")).alias("key")
    ).where("key is not null")


def orphans(refs: DataFrame, states: DataFrame, salts: int = 8) -> DataFrame:
    """Rows of refs that are orphans, with `why` (missing, deleted or early).

    A row is an orphan if no parent has its key, the parent's last load says deleted, or the parent's first
    load is later than the row. Only distinct keys with their earliest reference meet the parents, so a hot key
    is one row there; the failing keys go back `salts`-fold, so no hot key meets in one task. Null load times of
    a reference count as the oldest. Null, empty and blank ids refer to nothing; empty inputs give no rows;
    repeated rows stay as often as they come.
    """
    oldest = F.lit("0001-01-01 00:00:00").cast("timestamp")
    refs = refs.withColumn("at", F.coalesce("loaded_at", oldest))
    keys = refs.groupBy("key").agg(F.min("at").alias("earliest"))
    failing = (
        keys.join(states, "key", "left")
        .where(F.col("first_seen").isNull() | F.col("deleted") | (F.col("first_seen") > F.col("earliest")))
        .select("key", "first_seen", F.when(F.col("first_seen").isNull(), "missing").when(F.col("deleted"), "deleted").otherwise("early").alias("why"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("ref_table", "provider", "ref_id", "at"), F.lit(salts)).cast("int"))
    return salted.join(failing, ["key", "salt"]).where((F.col("why") != "early") | (F.col("first_seen") > F.col("at"))).drop("salt", "first_seen")


def orphan_report(refs: DataFrame, found: DataFrame) -> DataFrame:
    """ref_table, period (month of loaded_at), refs, orphans and their kinds; rows without a time have a null period."""
    month = F.date_format("loaded_at", "yyyy-MM").alias("period")
    all_ = refs.groupBy("ref_table", month).agg(F.count(F.lit(1)).alias("refs"))
    bad = found.groupBy("ref_table", month).agg(
        F.count(F.lit(1)).alias("orphans"), *[F.count_if(F.col("why") == w).alias(w) for w in ("missing", "deleted", "early")]
    )
    same = (all_.ref_table == bad.ref_table) & all_.period.eqNullSafe(bad.period)
    kinds = [F.coalesce(bad[c], F.lit(0)).alias(c) for c in ("orphans", "missing", "deleted", "early")]
    return all_.join(bad, same, "left").select(all_.ref_table, all_.period, "refs", *kinds)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
