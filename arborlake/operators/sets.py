"""Key-set algebra, overlap measures and named collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _key(c: Column, case: bool) -> Column:
    k = F.trim(c.cast("string"))
    return F.when(k != "", k if case else F.lower(k))


def overlap(left: DataFrame, right: DataFrame, key: str, case: bool = False) -> dict[str, DataFrame]:
    """intersection (rows of left), left_only, right_only, union (first row of each key); null keys never match and all stay in the differences.

    The other side is reduced to its distinct keys before it is shuffled.
    """
    a, b = left.withColumn("_k", _key(F.col(key), case)), right.withColumn("_k", _key(F.col(key), case))
    ka, kb = a.select("_k").distinct(), b.select("_k").distinct()
    return {
        "intersection": a.join(kb, "_k", "left_semi").drop("_k"), "left_only": a.join(kb, "_k", "left_anti").drop("_k"), "right_only": b.join(ka, "_k", "left_anti").drop("_k"),
        "union": left.unionByName(b.join(ka, "_k", "left_anti").drop("_k"), allowMissingColumns=True),
    }


def overlap_measures(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: row counts and Jaccard over rows, |matched left| / (|L| + |R| - |matched left|), overlap coefficient; empty gives 1."""
    parts = overlap(left, right, key)
    one = [parts["intersection"].agg(F.count(F.lit(1)).alias("shared")), left.agg(F.count(F.lit(1)).alias("left_rows")), right.agg(F.count(F.lit(1)).alias("right_rows"))]
    row = one[0].crossJoin(one[1]).crossJoin(one[2])  # three single rows
    s, a, b = F.col("shared"), F.col("left_rows"), F.col("right_rows")
    return row.select("shared", "left_rows", "right_rows", F.round(F.when(a + b - s == 0, 1.0).otherwise(s / F.nullif(a + b - s, F.lit(0))), 6).alias("jaccard"), F.round(F.coalesce(F.try_divide(s, F.least(a, b)), F.lit(1.0)), 6).alias("overlap"))


def set_measures(s: Column, a: Column, b: Column) -> list[Column]:
    """Dice, containment, duplicate (Jaccard at least 0.99) and asymmetric (coverages a quarter apart) of set sizes."""
    ca, cb = F.try_divide(s, a), F.try_divide(s, b)
    j = F.try_divide(s, a + b - s)
    return [F.round(j, 6).alias("jaccard"), F.round(F.try_divide(2 * s, a + b), 6).alias("dice"), F.round(F.greatest(ca, cb), 6).alias("containment"), (j >= 0.99).alias("duplicate"), (F.abs(ca - cb) >= 0.25).alias("asymmetric")]


def pairwise_overlap(df: DataFrame, source: str, key: str) -> DataFrame:
    """left, right, shared, sizes and measures of every pair of sources that share a key.

    Keys go to their set of sources first, which is bounded by the number of sources; pairs come from that set, so a
    key held by all costs no more than sources squared.
    """
    keys = df.select(F.col(source).alias("s"), F.col(key).alias("k")).where("s is not null and k is not null").distinct()
    size = keys.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    held = keys.groupBy("k").agg(F.array_sort(F.collect_set("s")).alias("ss")).groupBy("ss").agg(F.count(F.lit(1)).alias("c"))
    pairs = held.select("c", F.posexplode("ss").alias("i", "left"), "ss").select("c", "left", F.explode(F.slice("ss", F.col("i") + 2, F.size("ss"))).alias("right"))
    shared = pairs.groupBy("left", "right").agg(F.sum("c").alias("shared"))
    out = shared.join(size.select(F.col("s").alias("left"), F.col("n").alias("left_size")), "left").join(size.select(F.col("s").alias("right"), F.col("n").alias("right_size")), "right")
    return out.select("left", "right", "shared", "left_size", "right_size", *set_measures(F.col("shared"), F.col("left_size"), F.col("right_size")))


def coverage(df: DataFrame, source: str, key: str) -> DataFrame:
    """source, keys, share of all distinct keys."""
    keys = df.select(source, key).where(f"{key} is not null").distinct()
    total = keys.agg(F.count_distinct(key).alias("total"))
    return keys.groupBy(source).agg(F.count(F.lit(1)).alias("keys")).crossJoin(F.broadcast(total)).select(source, "keys", F.round(F.col("keys") / F.col("total"), 6).alias("share"))


def duplicates(df: DataFrame, keys: list[str], member: str | None = None) -> DataFrame:
    """keys, n (and smallest and greatest member) of keys that occur more than once; member lists stay out, as a key may hold a third of all rows."""
    extra = [F.min(member).alias("first_member"), F.max(member).alias("last_member")] if member else []
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *extra).where("n > 1")


def union_by_key(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """Concatenation that keeps the first row of each key by (frame, order); rows with a null key all stay."""
    rows = None
    for i, f in enumerate(frames):
        f = f.withColumn("_frame", F.lit(i))
        rows = f if rows is None else rows.unionByName(f, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    kept = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_frame", order)).alias("m")).select(key, "m.*")
    return kept.unionByName(rows.where(F.col(key).isNull())).drop("_frame")


def merge_by_key(old: DataFrame, new: DataFrame, key: str, order: str, replace: bool = True) -> DataFrame:
    """Named-collection merge: incoming rows without a key are dropped, old ones collapse to one; the last row of a key wins, or the first without `replace`."""
    a = old.withColumn("_frame", F.lit(0))
    rows = a.unionByName(new.where(F.col(key).isNotNull()).withColumn("_frame", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    pick = F.max_by if replace else F.min_by
    return rows.groupBy(key).agg(pick(F.struct(*rest), F.struct("_frame", order)).alias("m")).select(key, "m.*").drop("_frame")


def difference(old: DataFrame, new: DataFrame, path: str, value: str) -> DataFrame:
    """path, before, after, change (added, removed, changed, unchanged) of two flat documents."""
    j = old.select(F.col(path).alias("p1"), F.col(value).alias("before"), F.lit(True).alias("has1")).join(new.select(F.col(path).alias("p2"), F.col(value).alias("after"), F.lit(True).alias("has2")), F.col("p1") == F.col("p2"), "full_outer")
    change = F.when(F.col("has1").isNull(), "added").when(F.col("has2").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed")
    return j.select(F.coalesce("p1", "p2").alias("path"), "before", "after", change.alias("change"))


def set_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and an order-insensitive digest of a record set: row digests are added up in two 64-bit halves, so no list is gathered."""
    h = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substr(h, F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(20,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), part(0).cast("string"), part(1).cast("string")), 256).alias("digest"))


def tagged(df: DataFrame, record: str, tag: str, tags: list[str], how: str = "any") -> DataFrame:
    """Records with any, or all, of the tags."""
    rows = df.where(F.col(tag).isin(tags)).select(record, tag).distinct()
    if how == "any":
        return rows.select(record).distinct()
    return rows.groupBy(record).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(tags))).select(record)


def tag_counts(df: DataFrame, tag: str, least: int = 1, most: int | None = None, limit: int = 100) -> DataFrame:
    """tag, count within bounds; count desc, tag."""
    n = df.groupBy(tag).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)
    return (n.where(F.col("count") <= most) if most else n).orderBy(F.desc("count"), tag).limit(limit)


def rename_tag(df: DataFrame, record: str, tag: str, old: str, new: str) -> DataFrame:
    """Renames a tag; where the new one is there already the two become one."""
    return df.withColumn(tag, F.when(F.col(tag) == old, new).otherwise(F.col(tag))).dropDuplicates([record, tag])


class Library:
    """Named collections of records as views of the session."""

    def __init__(self, spark: SparkSession, prefix: str = "library_"):
        self.spark, self.prefix, self.names = spark, prefix, {}

    def set(self, name: str, df: DataFrame) -> None:
        self.names[name] = df
        df.createOrReplaceTempView(self.prefix + name)

    def get(self, name: str) -> DataFrame:
        return self.names[name]

    def append(self, name: str, df: DataFrame) -> None:
        self.set(name, self.names[name].unionByName(df, allowMissingColumns=True) if name in self.names else df)

    def merge(self, name: str, df: DataFrame, key: str, order: str, replace: bool = True) -> None:
        self.set(name, merge_by_key(self.names[name], df, key, order, replace))

    def rename(self, old: str, new: str) -> None:
        self.set(new, self.names[old])
        self.delete(old)

    def clone(self, old: str, new: str) -> None:
        self.set(new, self.names[old])

    def clear(self, name: str) -> None:
        self.set(name, self.names[name].limit(0))

    def delete(self, name: str) -> None:
        self.names.pop(name, None)
        self.spark.catalog.dropTempView(self.prefix + name)

    def list(self) -> list[str]:
        return sorted(self.names)
