"""Profiles, groups, histograms, percentiles, correlations and densities."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import coerce as C
from arborlake.session import checkpoint

QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def summary(x: Column, prefix: str = "", quantiles: tuple[float, ...] = QUANTILES) -> list[Column]:
    """count, sum, min, max, mean, median, sample variance (0 for one value), stddev and interpolated percentiles, of groups known to be small.

    The percentiles gather a group's distinct values; `quantiles` does not.
    """
    var = F.when(F.count(x) > 0, F.coalesce(F.var_samp(x), F.lit(0.0)))
    points = sorted({0.5, *quantiles})
    cut = F.percentile(x, F.array(*map(F.lit, points)))  # the same aggregate for all, so values are gathered once
    at = lambda q: cut[points.index(q)]
    out = {"count": F.count(x), "sum": F.sum(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "median": at(0.5), "variance": var, "stddev": F.sqrt(var)}
    out |= {f"p{round(q * 100)}": at(q) for q in quantiles}
    return [c.alias(prefix + k) for k, c in out.items()]


def quantiles(df: DataFrame, by: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """by, cuts: the interpolated percentiles of a numeric column in each group, exact and without gathering a group.

    Equal values are counted first. The counts are split by range of (group, value), so that each part can number its
    own rows once it knows how many values of the group stand in the parts before it; only the rows at the wanted
    places remain. Nulls do not count; a group without a value has no row.
    """
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    counts = df.select(*keys, F.col(f"`{value}`").cast("double").alias("_v")).where("_v is not null").groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_n"))
    parts = checkpoint(counts.repartitionByRange(*names, "_v").withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy(*names, "_p").agg(F.sum("_n").alias("_s"))  # one row a part and group
    over = Window.partitionBy(*(names or [F.lit(1)]))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(over.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_s").over(over)).drop("_s")
    both = parts.alias("a").join(sums.alias("b"), reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*names, "_p"]])).select("a.*", "_before", "_all")
    run = F.sum("_n").over(Window.partitionBy(*names, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_to", F.col("_before") + run).withColumn("_from", F.col("_to") - F.col("_n"))
    want = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("at")) for i, q in enumerate(points)]))
    rows = placed.select(*names, "_v", "_from", "_to", want.alias("_w"))
    low, high = F.floor("_w.at"), F.ceil("_w.at")
    holds = lambda x: (x >= F.col("_from")) & (x < F.col("_to"))
    ends = rows.where(holds(low) | holds(high)).groupBy(*names, "_w").agg(F.max(F.when(holds(low), F.col("_v"))).alias("lo"), F.max(F.when(holds(high), F.col("_v"))).alias("hi"))
    cut = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("_w.at") - F.floor("_w.at"))
    out = ends.select(*names, F.struct(F.col("_w.i").alias("i"), cut.alias("cut")).alias("c")).groupBy(*names).agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["cut"]).alias("cuts"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, by)], "cuts")


def with_quantiles(base: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """base with the cuts of its groups; null groups meet."""
    if not by:
        return base.join(cuts, how="left")  # a single row beside a single row
    return base.alias("a").join(cuts.alias("b"), reduce(lambda x, y: x & y, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in by]), "left").select("a.*", "b.cuts")


def moments(x: Column, prefix: str = "") -> list[Column]:
    """count, sum, min, max, mean, sample variance (0 for one value) and stddev."""
    var = F.when(F.count(x) > 0, F.coalesce(F.var_samp(x), F.lit(0.0)))
    out = {"count": F.count(x), "sum": F.sum(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "variance": var, "stddev": F.sqrt(var)}
    return [c.alias(prefix + k) for k, c in out.items()]


def _named(prefix: str) -> list[Column]:
    """The summary's columns in their order, with the median and percentiles out of cuts."""
    at = lambda q: F.get("cuts", F.lit(QUANTILES.index(q)))
    plain = [F.col(f"`{prefix}{k}`") for k in ("count", "sum", "min", "max", "mean")]
    return [*plain, at(0.5).alias(prefix + "median"), F.col(f"`{prefix}variance`"), F.col(f"`{prefix}stddev`"), *[at(q).alias(f"{prefix}p{round(q * 100)}") for q in QUANTILES]]


def unpivot(df: DataFrame, fields: list[str], numeric: bool = True) -> DataFrame:
    """field, value: one row per record and field; numeric values, or all as text."""
    cells = [F.struct(F.lit(f).alias("field"), (C.numeric(F.col(f), C.field_type(df, f)) if numeric else F.col(f).cast("string")).alias("value")) for f in fields]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.field", "c.value")


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, records, nulls (blank counts as null), null_rate, distinct and the numeric summary of each field."""
    cells = [F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias("value"), C.numeric(F.col(f), C.field_type(df, f)).alias("x")) for f in fields]
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    nulls = F.count_if(F.col("value").isNull())
    base = rows.groupBy("field").agg(F.count(F.lit(1)).alias("records"), nulls.alias("nulls"), F.round(nulls / F.count(F.lit(1)), 6).alias("null_rate"), *moments(F.col("x"), "num_"))
    kinds = rows.where("value is not null").groupBy("field", "value").agg(F.lit(1)).groupBy("field").agg(F.count(F.lit(1)).alias("distinct_values"))
    out = base.join(kinds, "field", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    return with_quantiles(out, quantiles(rows, ["field"], "x", QUANTILES), ["field"]).select("field", "records", "nulls", "null_rate", "distinct_values", *_named("num_"))


def type_histogram(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, type, count; text is null when blank, a date when it parses and holds one of - T : /, else string."""
    def kind(f: str) -> Column:
        t, c = C.field_type(df, f), F.col(f)
        plain = "boolean" if t.typeName() == "boolean" else "number" if isinstance(t, C.NUMERIC) else "date" if isinstance(t, C.TIMES) else "string" if t.typeName() == "string" else "array" if t.typeName() == "array" else "object"
        text = F.when(F.trim(c) == "", "null").when(C.moment(c, t).isNotNull(), "date") if plain == "string" else None
        return F.when(c.isNull(), "null").otherwise(text.otherwise(F.lit(plain)) if text is not None else F.lit(plain))
    return df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), kind(f).alias("type")) for f in fields])).alias("c")).groupBy("c.field", "c.type").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, fields: list[str], limit: int = 10) -> DataFrame:
    """field, value, count, rank: the most frequent values of each field; ties by value."""
    n = unpivot(df, fields, False).where("value is not null and trim(value) <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "value"))).where(F.col("rank") <= limit)


def grouped(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """One row a group (arrays explode, missing is the null group): records and the summary of each field; records desc, group."""
    g = F.explode_outer(F.array_distinct(C.values(df, by))).alias("group")
    rows = df.select(g, *[C.numeric(F.col(f), C.field_type(df, f)).alias(f) for f in fields])
    out = rows.groupBy("group").agg(F.count(F.lit(1)).alias("records"), *[c for f in fields for c in moments(F.col(f"`{f}`"), f + "_")])
    done = ["group", "records"]
    for f in fields:
        out = with_quantiles(out, quantiles(rows, ["group"], f, QUANTILES), ["group"])
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if c != "cuts" and not c.startswith(f + "_")], *_named(f + "_"))
        done += [f + "_" + k for k in ("count", "sum", "min", "max", "mean", "median", "variance", "stddev", *[f"p{round(q * 100)}" for q in QUANTILES])]
    return out.select(*[F.col(f"`{c}`") for c in done]).orderBy(F.desc("records"), "group")


def histogram(df: DataFrame, field: str, bins: int = 10, weight: str | None = None) -> DataFrame:
    """bin (from 0), low, high, count, total weight and cumulative count: equal widths, the last bin closed, empty bins kept; constant data is one bin of width 0.

    Bounds come from one small aggregate that joins by broadcast of a single row.
    """
    x = df.select(C.numeric(F.col(field), C.field_type(df, field)).alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("x is not null")
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("n", F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins)).withColumn("step", (F.col("hi") - F.col("lo")) / F.col("n")).where("lo is not null")
    at = F.when(F.col("step") == 0, 0).otherwise(F.least(F.col("n") - 1, F.floor((F.col("x") - F.col("lo")) / F.col("step")))).cast("int")
    counts = x.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.sum("w").alias("weight"))
    frame = span.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"), "lo", "step")
    out = frame.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("high"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return out.withColumn("cumulative", F.sum("count").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))  # one row a bin


def correlations(df: DataFrame, fields: list[str]) -> DataFrame:
    """a, b, n, r of each pair over records with both numbers; r is null for n < 2 or no variance; by |r| descending."""
    row = df.select(*[C.numeric(F.col(f), C.field_type(df, f)).alias(f) for f in fields])
    aggs = []
    for a, b in combinations(fields, 2):
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        ok = (F.count(x) > 1) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), F.when(ok, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))).alias("r")))
    return row.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*").orderBy(F.desc_nulls_last(F.abs("r")), "a", "b")


def density_summary(df: DataFrame, field: str, weight: str) -> DataFrame:
    """Weighted mean and population variance, unweighted quartiles and their range."""
    x, w = F.col(field).cast("double"), F.col(weight).cast("double")
    m = F.sum(w * x) / F.sum(w)
    base = df.agg(F.count(x).alias("count"), F.sum(w).alias("weight"), m.alias("mean"), (F.sum(w * x * x) / F.sum(w) - m * m).alias("variance"))
    out = with_quantiles(base, quantiles(df, [], field, (0.25, 0.5, 0.75)), [])
    return out.select("*", *[F.get("cuts", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))]).drop("cuts").withColumn("iqr", F.col("q3") - F.col("q1"))


KERNELS = {
    "gaussian": lambda u: F.exp(-0.5 * u * u) / 2.5066282746310002, "epanechnikov": lambda u: F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0), "triangular": lambda u: F.when(F.abs(u) <= 1, 1 - F.abs(u)).otherwise(0.0),
    "uniform": lambda u: F.when(F.abs(u) <= 1, 0.5).otherwise(0.0), "cosine": lambda u: F.when(F.abs(u) <= 1, 0.7853981633974483 * F.cos(1.5707963267948966 * u)).otherwise(0.0),
}


def kernel_density(df: DataFrame, field: str, points: int = 128, kernel: str = "gaussian", bandwidth: float | None = None) -> DataFrame:
    """x, density on an even grid from min to max. Equal values are first counted, so each meets the grid once; Silverman's bandwidth unless given."""
    x = df.select(F.col(field).cast("double").alias("v")).where("v is not null")
    s = x.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))
    s = with_quantiles(s, quantiles(x, [], "v", (0.25, 0.75)), []).withColumn("iqr", F.get("cuts", F.lit(1)) - F.get("cuts", F.lit(0))).drop("cuts")
    spread = F.when(F.col("iqr") > 0, F.least("sd", F.col("iqr") / 1.34)).otherwise(F.col("sd"))
    h = F.lit(bandwidth) if bandwidth else F.when(spread > 0, 0.9 * spread * F.pow("n", F.lit(-0.2))).otherwise(1.0)
    s = s.withColumn("h", h).where("n > 0")
    counts = x.groupBy("v").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(s))
    grid = counts.select("v", "c", "n", "h", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("i"), (F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x")))).alias("g"))
    k = KERNELS[kernel]((F.col("g.x") - F.col("v")) / F.col("h"))
    return grid.groupBy(F.col("g.i").alias("point")).agg(F.first("g.x").alias("x"), (F.sum(F.col("c") * k) / F.first(F.col("n") * F.col("h"))).alias("density"))


AGGREGATES = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max, "count": F.count}


def matrix(df: DataFrame, row: str, column: str, value: str, how: str = "sum", fill: float | None = None, scale: str = "none") -> DataFrame:
    """row, column, value, scaled: aggregated cells with missing ones filled in; scale is none, global, row, column or log."""
    cells = df.groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(AGGREGATES[how](value).cast("double").alias("value"))
    full = cells.select("row").distinct().crossJoin(cells.select("column").distinct()).join(cells, ["row", "column"], "left")  # margins of the matrix, which is itself the answer
    full = full.withColumn("value", F.coalesce("value", F.lit(fill)) if fill is not None else F.col("value"))
    if scale == "none":
        return full.withColumn("scaled", F.col("value"))
    v = F.log1p(F.greatest("value", F.lit(0.0))) if scale == "log" else F.col("value")
    if scale in ("row", "column"):
        lo, hi = F.min(v).over(Window.partitionBy(scale)), F.max(v).over(Window.partitionBy(scale))
    else:
        full = full.crossJoin(F.broadcast(full.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))))
        lo, hi = F.col("_lo"), F.col("_hi")
    return full.select("row", "column", "value", lo.alias("_lo"), hi.alias("_hi")).withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.when(v.isNotNull(), 0.0))).drop("_lo", "_hi")


def margins(cells: DataFrame, by: str) -> DataFrame:
    """count, total, avg, min, max of the cells of each row or column."""
    return cells.groupBy(by).agg(F.count("value").alias("count"), F.sum("value").alias("total"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))


def word_counts(df: DataFrame, field: str, stop: list[str] = (), least: int = 2, most: int = 80) -> DataFrame:
    """text, count: words between blanks and , ; | / \\ without case; the longest surface form (then the smallest) is kept."""
    words = df.select(F.explode(F.split(F.coalesce(F.col(field), F.lit("")), r"[\s,;|/\\]+")).alias("word")).where(F.length("word").between(least, most))
    low = words.groupBy(F.lower("word").alias("key")).agg(F.count(F.lit(1)).alias("count"), F.max_by("word", F.struct(F.length("word"), F.col("word"))).alias("text"))
    return low.where(~F.col("key").isin(*stop)) if stop else low


def cumulative_buckets(df: DataFrame, field: str, bounds: list[float]) -> DataFrame:
    """Metric histogram: count, sum, min, max, mean and how many values are at most each bound."""
    x = F.col(field).cast("double")
    return df.agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), *[F.count_if(x <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds])


def summarize(df: DataFrame, flags: dict[str, Column], dims: list[str], metrics: list[str]) -> DataFrame:
    """section, name, value: counts of conditions, breakdowns by dimension (arrays explode) and metric summaries in long form."""
    total = df.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(c).alias("flag_" + k) for k, c in flags.items()], *[F.round(f(C.numeric(F.col(m), C.field_type(df, m))), 6).alias(f"metric_{m}_{n}") for m in metrics for n, f in (("count", F.count), ("min", F.min), ("max", F.max), ("avg", F.avg))])
    cells = [F.struct(F.lit("total" if c == "all" else c.split("_")[0]).alias("section"), F.lit("records" if c == "all" else c.split("_", 1)[1]).alias("name"), F.col(c).cast("double").alias("value")) for c in total.columns]
    out = total.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    for d in dims:
        vals = df.select(F.explode(F.array_distinct(C.values(df, d, "drop"))).alias("name")).select(F.col("name").cast("string").alias("name")).where("name <> ''")
        out = out.unionByName(vals.groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("section", F.lit("by_" + d)))
    return out
