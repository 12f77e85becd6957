"""Best representative of each duplicate group (problem 6).

A latent two-sided quality model over sources: a value that a source could have given and did not speaks against it
as far as the source is usually complete (sensitivity), one that it gave speaks for it as far as it seldom errs
(specificity). Whether a value is true depends only on which sources gave it and which were silent, so all claims
are first reduced to the counts of such patterns; expectation-maximisation then runs over the patterns. A field
keeps every value judged true.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions.keys import BLANKS, instant, label, record_id
from arborlake.session import checkpoint

# The fields that count and the words by which a field says that it is not known.
FIELDS = ["scientific_name", "authorship", "rank", "status", "kingdom", "phylum", "class", "order", "family", "genus", "source_url", "source_modified"]
UNKNOWN = ["-", "--", "?", "n/a", "na", "none", "null", "unknown", "not recorded", "not given", "not available", "not known", "not specified", "unspecified", "undetermined", "no data", "nil", "missing"]


def once(c: Column) -> Column:
    """The column through a generator, which keeps later projections from evaluating it again and again."""
    return F.explode(F.array(c))


def uncoded(text: Column) -> Column:
    """JSON text without the codings as a string around it, however many.

    Every coding but the first doubles what stands before the quotes, so a text has no more of them than its length
    has binary digits.
    """
    def inner(t: Column) -> Column:
        return F.from_json(F.concat(F.lit("["), t, F.lit("]")), T.ArrayType(T.StringType()))[0]

    most = F.ceil(F.log2(F.length(text) + F.lit(1.0))).cast("int") + 1
    peeled = F.aggregate(F.sequence(F.lit(1), most), text, lambda t, i: F.when(F.ltrim(t).startswith('"'), inner(t)).otherwise(t))
    return F.when(F.ltrim(text).startswith('"'), peeled).otherwise(text)


def fields_of(df: DataFrame, text: str, fields: list[str], out: str) -> DataFrame:
    """df with an array of the known values of the fields of a JSON object; all null where the text is no valid JSON object."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields] + [T.StructField("_bad", T.StringType())])
    rest = [c for c in df.columns if c != text]
    plain = df.select(*rest, once(uncoded(F.col(text))).alias("_t"))
    parsed = plain.select(*rest, F.ltrim("_t").startswith("{").alias("_object"), once(F.from_json("_t", schema, {"columnNameOfCorruptRecord": "_bad"})).alias("_c"))
    bare = parsed.select(*rest, once(F.when(F.col("_object") & F.col("_c._bad").isNull(), F.array(*[F.btrim(F.col("_c")[f], F.lit(BLANKS)) for f in fields])).otherwise(F.array(*[F.lit(None).cast("string")] * len(fields)))).alias("_v"))
    return bare.select(*rest, once(F.array(*[known(F.col("_v")[i]) for i in range(len(fields))])).alias(out))


def known(bare: Column) -> Column:
    """The trimmed value, or null where it is blank or only says that it is unknown."""
    return F.when((F.length(bare) > 0) & ~F.lower(bare).isin(UNKNOWN), bare)


def ranked_rows(assertions: DataFrame, providers: DataFrame) -> DataFrame:
    """key, source, trust, at, filled, values and the stored labels of every row that refers to a taxon.

    Rows whose speciedex_id is null or blank belong to no group. A provider that is not listed has trust -1.
    """
    trust = providers.select(label(F.col("provider")).alias("source"), "trust").where("source is not null").groupBy("source").agg(F.max("trust").alias("trust"))
    rows = assertions.select(
        record_id(F.col("speciedex_id")).alias("key"), F.coalesce(label(F.col("provider")), F.lit("")).alias("source"), "provider", "provider_id", "assertion_hash", "assertion_json",
        F.coalesce(instant(F.col("updated_at")), F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("at"),
    ).where("key is not null")
    rows = fields_of(rows, "assertion_json", FIELDS, "values").withColumn("filled", F.size(F.array_compact("values")))
    return rows.join(trust, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(-1)))


def _claims(rows: DataFrame) -> DataFrame:
    return rows.select(F.xxhash64("key").alias("k"), "source", F.posexplode_outer("values").alias("f", "value")).where("value is not null").withColumn("v", F.xxhash64(F.lower("value")))


def patterns(rows: DataFrame) -> DataFrame:
    """k, f, v, yes, no: for each claimed value the sources that gave it and those that gave only others.

    Sets of sources per value are bounded by the number of sources, so a hot key is no large group; the values
    of a hot key are spread by their hash.
    """
    votes = _claims(rows).groupBy("k", "f", "v").agg(F.array_sort(F.collect_set("source")).alias("yes"))
    cover = votes.select("k", "f", F.explode("yes").alias("s")).groupBy("k", "f").agg(F.array_sort(F.collect_set("s")).alias("cover"))
    return votes.join(cover, ["k", "f"]).select("k", "f", "v", "yes", F.array_except("cover", "yes").alias("no"))


def _lookup(weights: dict[str, float], sources: Column) -> Column:
    if not weights:
        return F.lit(0.0)
    table = F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))])
    return F.aggregate(sources, F.lit(0.0), lambda a, s: a + F.coalesce(table[s], F.lit(0.0)))


def _posterior(quality: dict[str, tuple[float, float]], prior: float) -> Column:
    for_ = {s: math.log(a / (1 - b)) for s, (a, b) in quality.items()}
    against = {s: math.log((1 - a) / b) for s, (a, b) in quality.items()}
    odds = F.lit(math.log(prior / (1 - prior))) + _lookup(for_, F.col("yes")) + _lookup(against, F.col("no"))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), odds))))


def _expected(quality: dict[str, tuple[float, float]], prior: float):
    """Expected true and false claims of each source over patterns; the row without a source holds those of all values."""
    base, most = math.log(prior / (1 - prior)), 40.0
    for_, against = {s: math.log(a / (1 - b)) for s, (a, b) in quality.items()}, {s: math.log((1 - a) / b) for s, (a, b) in quality.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str | None, list[float]] = {None: [0.0] * 4}
        for b in batches:
            for yes, no, n in zip(b["yes"], b["no"], b["n"]):
                odds = base + sum(for_[s] for s in yes) + sum(against[s] for s in no)
                p = 1 / (1 + math.exp(-max(-most, min(most, odds))))
                for s, row in [(None, (0, n * p, 0, n * (1 - p))), *((s, (n * p, n * p, 0, n * (1 - p))) for s in yes), *((s, (0, n * p, n * (1 - p), n * (1 - p))) for s in no)]:
                    have = sums.setdefault(s, [0.0] * 4)
                    for i, x in enumerate(row):
                        have[i] += x
        yield pd.DataFrame([(s, *map(float, v)) for s, v in sums.items()], columns=["s", "ty", "t", "fn", "f"])

    return run


def fit(pattern_rows: DataFrame, rounds: int = 6, bound: int = 2000) -> tuple[dict[str, tuple[float, float]], float]:
    """Sensitivity and specificity of each source, and the prior of truth, by expectation-maximisation.

    The state, two numbers a source, is on the driver; more than `bound` sources are refused. No rows give no
    sources.
    """
    counts = checkpoint(pattern_rows.groupBy("yes", "no").agg(F.count(F.lit(1)).alias("n")))
    names = [r.s for r in counts.select(F.explode(F.concat("yes", "no")).alias("s")).distinct().limit(bound + 1).collect()]
    if len(names) > bound:
        raise ValueError(f"more than {bound} sources")
    quality, prior = {s: (0.7, 0.9) for s in names}, 0.5
    for _ in range(rounds if names else 0):
        # One pass a round: each task adds up its patterns, a row a source comes back.
        stats = {r.s: r for r in counts.mapInPandas(_expected(quality, prior), "s string, ty double, t double, fn double, f double").groupBy("s").agg(*[F.sum(c).alias(c) for c in ("ty", "t", "fn", "f")]).collect()}
        total = stats.pop(None)
        prior = min(0.99, max(0.01, total.t / (total.t + total.f)))
        # Two pseudo-counts a side keep a source of few claims near the middle of the others.
        quality = {s: ((r.ty + 1.4) / (r.t + 2), (r.fn + 1.8) / (r.f + 2)) for s, r in stats.items()}
    return quality, prior


def resolved(rows: DataFrame, best: DataFrame, judged: DataFrame) -> DataFrame:
    """best with record: of every field the values of the surviving record.

    Where the sources disagree the model chooses: a field holds every value judged true, spelt as in the surviving row
    if that row gives it; a field of which no value is judged true keeps the value of the surviving row.
    """
    names = F.array(*map(F.lit, FIELDS))
    chosen = best.join(rows.select("key", "provider", "provider_id", "assertion_hash", "values").groupBy("key", "provider", "provider_id", "assertion_hash").agg(F.max("values").alias("values")), ["key", "provider", "provider_id", "assertion_hash"])
    own = chosen.select("key", F.posexplode("values").alias("f", "own")).select("key", F.get(names, F.col("f")).alias("field"), "own").where("own is not null")
    true = judged.groupBy("key", "field").agg(F.sort_array(F.collect_set("value")).alias("true"))
    fields = own.join(true, ["key", "field"], "full")
    kept = F.when(F.col("true").isNull(), F.array("own")).otherwise(F.transform("true", lambda v: F.when(F.lower(v) == F.lower(F.col("own")), F.col("own")).otherwise(v)))
    record = fields.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", kept.alias("values"))))).alias("record"))
    return best.join(record, "key", "left")


def survive(assertions: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(surviving rows as of `best_rows`, values judged true as of `true_values`, all rows): the text is parsed once.

    The claims are derived again from the parsed rows where values are asked for, as they are as large as these.
    """
    rows = checkpoint(ranked_rows(assertions, providers))
    claims = patterns(rows)
    quality, prior = fit(claims)
    return best_rows(rows, quality), true_values(rows, claims, quality, prior), rows


def best_rows(rows: DataFrame, quality: dict[str, tuple[float, float]]) -> DataFrame:
    """The surviving row of each group of at least two distinct rows, with what it reaches.

    key, provider, provider_id, assertion_hash, rows, ties and all_best: the row is the first by filled fields,
    trust, time, expected truth of its values under the model, then its labels. all_best says that it alone
    reaches the most filled fields, the highest trust and the latest time of its group. Repeated rows count once.
    """
    distinct = rows.select("key", "source", "provider", "provider_id", "assertion_hash", "at", "filled", "trust").distinct()
    right = {s: a / (a + 1 - b) for s, (a, b) in quality.items()}
    distinct = distinct.withColumn("truth", F.col("filled") * _lookup(right, F.array("source")))
    row = F.struct("truth", "provider", "provider_id", "assertion_hash")
    level = distinct.groupBy("key", "filled", "trust", "at").agg(F.count(F.lit(1)).alias("n"), F.max(row).alias("row"))
    group = level.groupBy("key").agg(
        F.sum("n").alias("rows"), F.max("filled").alias("filled"), F.max("trust").alias("trust"), F.max("at").alias("at"), F.max(F.struct("filled", "trust", "at", "n", "row")).alias("top")
    )
    every = (F.col("top.filled") == F.col("filled")) & (F.col("top.trust") == F.col("trust")) & (F.col("top.at") == F.col("at")) & (F.col("top.n") == 1)
    return group.where("rows > 1").select("key", "top.row.provider", "top.row.provider_id", "top.row.assertion_hash", "rows", F.col("top.n").alias("ties"), every.alias("all_best"))


def true_values(rows: DataFrame, pattern_rows: DataFrame, quality: dict[str, tuple[float, float]], prior: float, threshold: float = 0.5) -> DataFrame:
    """key, field, value, probability: every value judged true; of spellings that differ in case the first one."""
    judged = pattern_rows.withColumn("probability", _posterior(quality, prior)).where(F.col("probability") >= threshold).select("k", "f", "v", "probability")
    names = F.array(*map(F.lit, FIELDS))
    spelt = rows.select("key", F.posexplode("values").alias("f", "value")).where("value is not null").groupBy("key", "f", F.lower("value").alias("low")).agg(F.min("value").alias("value"))
    spelt = spelt.withColumn("k", F.xxhash64("key")).withColumn("v", F.xxhash64("low"))
    return spelt.join(judged, ["k", "f", "v"]).select("key", F.get(names, F.col("f")).alias("field"), "value", F.round("probability", 6).alias("probability"))


