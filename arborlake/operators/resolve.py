"""Validation, reconciliation, duplicate clustering and merge plans over whole batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import taxonomy as X
from arborlake.operators.archive import newest
from arborlake.session import checkpoint

# Points of agreeing fields, and the thresholds of a match and a conflict.
FIELD_POINTS = {"scientific_name": 8, "canonical_name": 35, "authorship": 20, "rank": 10, "kingdom": 15}
LINEAGE_POINTS, LINEAGE_MOST, ACCEPTED_ID_POINTS = 4, 20, 4
MATCH, CONFLICT, LEAST = 75, 50, 35
# Names that stand for none.
PLACEHOLDERS = ["unknown", "unnamed", "unidentified", "not available", "n/a", "na", "none", "null", "taxon", "species"]
# Weights and thresholds of duplicate scores.
DUPLICATE_WEIGHTS = {"canonical_name": 0.30, "scientific_name": 0.08, "authorship": 0.14, "rank": 0.10, "kingdom": 0.08, "lineage": 0.18, "status": 0.04, "provider_support": 0.05, "synonym_support": 0.03}
EXACT, PROBABLE, REVIEW = 0.98, 0.84, 0.68


def issues(df: DataFrame, key: list[str], rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """key, code, severity, field: one row per rule (code, severity, field, condition) that a record breaks."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(f).alias("field"))) for c, s, f, cond in rules]))
    return df.select(*key, F.explode(found).alias("i")).select(*key, "i.*")


def issue_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("count"))


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def taxon_rules() -> list[tuple[str, str, str, Column]]:
    """Checks of a normalised record."""
    out = [(f"{f}_missing", "error", f, blank(f)) for f in ("provider", "provider_id", "scientific_name", "canonical_name")]
    out += [(f"{f}_too_long", "error", f, F.length(f) > n) for f, n in (("scientific_name", 1024), ("canonical_name", 1024), ("authorship", 1024))]
    out += [(f"{f}_placeholder", "error", f, F.lower(F.trim(F.col(f))).isin(PLACEHOLDERS)) for f in ("scientific_name", "canonical_name")]
    out += [(f"{f}_null_byte", "error", f, F.col(f).contains("\0")) for f in ("scientific_name", "canonical_name")]
    out += [
        ("rank_unknown", "warning", "rank", X.rank(F.col("rank"), "?") == "?"),
        ("status_unknown", "warning", "status", ~(X.is_accepted(F.col("status")) | X.is_synonym(F.col("status")) | X.is_uncertain(F.col("status")))),
        ("accepted_id_self_reference", "error", "accepted_provider_id", ~blank("accepted_provider_id") & (F.col("accepted_provider_id") == F.col("provider_id"))),
        ("synonym_target_missing", "warning", "accepted_provider_id", X.is_synonym(F.col("status")) & blank("accepted_provider_id")),
        ("accepted_taxon_has_target", "warning", "accepted_provider_id", X.is_accepted(F.col("status")) & ~blank("accepted_provider_id") & (F.col("accepted_provider_id") != F.col("provider_id"))),
        ("canonical_name_mismatch", "warning", "canonical_name", ~blank("canonical_name") & ~X.key(F.col("scientific_name")).startswith(X.key(F.col("canonical_name")))),
        ("lineage_empty", "warning", "kingdom", reduce(lambda a, b: a & b, [blank(c) for c in ("kingdom", "phylum", "class_name", "order_name", "family", "genus")])),
        ("genus_missing", "warning", "genus", (X.rank_order(X.rank(F.col("rank"))) > X.RANKS.index("genus")) & blank("genus")),
        ("source_url_non_http", "warning", "source_url", ~blank("source_url") & ~F.lower("source_url").rlike("^https?://")),
        ("retrieved_at_invalid", "error", "retrieved_at", ~blank("retrieved_at") & F.col("retrieved_at").try_cast("timestamp").isNull() & ~F.col("retrieved_at").rlike(r"^\d{8}T\d{6}Z$")),
    ]
    return out


def assertion_rules() -> list[tuple[str, str, str, Column]]:
    """Checks of a stored assertion."""
    return [
        ("assertion_provider_missing", "error", "provider", blank("provider")), ("assertion_provider_id_missing", "error", "provider_id", blank("provider_id")),
        ("assertion_hash_mismatch", "error", "assertion_hash", F.sha2("assertion_json", 256) != F.col("assertion_hash")),
        ("speciedex_id_missing", "error", "speciedex_id", blank("speciedex_id")), ("speciedex_id_invalid_format", "error", "speciedex_id", ~blank("speciedex_id") & ~F.col("speciedex_id").rlike("^spx:sha256:[0-9a-f]{64}$")),
    ]


def batch_rules(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Batch checks: provider_id, code, count of duplicate source ids and mixed providers, and one row if the batch is too large."""
    double = df.groupBy("provider", "provider_id").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("provider_id", F.lit("batch_duplicate_source_id").alias("code"), "count")
    total = df.agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > limit).select(F.lit(None).cast("string").alias("provider_id"), F.lit("batch_record_limit_exceeded").alias("code"), "count")
    return double.unionByName(total)


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a record breaks, null if none."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules], F.lit(None).cast("string"))


def candidate_score(a: str, b: str, weight: Column) -> Column:
    """Points of agreeing fields of incoming (a.) and archived (b.) records, times the provider's weight; raw below 35 stays below 50."""
    def same(f: str) -> Column:
        return (X.key(F.col(f"{a}.{f}")) != "") & (X.key(F.col(f"{a}.{f}")) == X.key(F.col(f"{b}.{f}")))
    raw = sum((F.when(same(f), p).otherwise(0) for f, p in FIELD_POINTS.items()), F.lit(0))
    line = sum((F.when(same(f), LINEAGE_POINTS).otherwise(0) for f in ("phylum", "class_name", "order_name", "family", "genus")), F.lit(0))
    raw = raw + F.least(F.lit(LINEAGE_MOST), line) + F.when(F.trim(F.coalesce(F.col(f"{a}.accepted_provider_id"), F.lit(""))) != "", ACCEPTED_ID_POINTS).otherwise(0)
    score = raw * weight
    return F.when(raw < LEAST, F.least(score, F.lit(CONFLICT - 0.01))).otherwise(score)


def reconcile(new: DataFrame, taxa: DataFrame, source_ids: DataFrame, weights: dict[str, float] | None = None, default: float = 0.85) -> DataFrame:
    """provider, provider_id, action, speciedex_id, score, reason of each incoming record.

    Source id first, then an exact identity (several ids are a conflict), then scored candidates of the same name,
    rank and kingdom: at least 75 and alone at the top is a match, at least 50 a conflict, else the record is new.
    Rows of one identity within the batch resolve alike, so none depends on the order.
    """
    key = ["provider", "provider_id"]
    rows = newest(new, key, "retrieved_at")
    ident = X.identity_key(F.col("canonical_name"), F.col("rank"), F.col("kingdom"), F.col("authorship"))
    rows = rows.withColumn("_ident", ident).withColumn("_name", F.concat_ws("|", X.key(F.col("canonical_name")), X.key(F.col("rank")), X.key(F.col("kingdom"))))
    have = newest(taxa, ["speciedex_id"]).withColumn("_ident", ident).withColumn("_name", F.concat_ws("|", X.key(F.col("canonical_name")), X.key(F.col("rank")), X.key(F.col("kingdom"))))
    by_source = rows.select(key).join(source_ids.groupBy(*key).agg(F.min("speciedex_id").alias("s_id")), key)
    by_ident = rows.select(*key, "_ident").join(have.groupBy("_ident").agg(F.count(F.lit(1)).alias("i_n"), F.min("speciedex_id").alias("i_id")), "_ident").select(*key, "i_n", "i_id")
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.lower("a.provider")], F.lit(default)) if weights else F.lit(default)
    pairs = rows.alias("a").join(have.alias("b"), F.col("a._name") == F.col("b._name")).select(F.col("a.provider").alias("provider"), F.col("a.provider_id").alias("provider_id"), F.col("b.speciedex_id").alias("c_id"), candidate_score("a", "b", weight).alias("score"))
    top = pairs.groupBy(*key, "score").agg(F.count(F.lit(1)).alias("ties"), F.min("c_id").alias("c_id")).groupBy(*key).agg(F.max(F.struct("score", "ties", "c_id")).alias("t")).select(*key, "t.*")
    j = rows.select(key).join(by_source, key, "left").join(by_ident, key, "left").join(top, key, "left")
    action = F.when(F.col("s_id").isNotNull(), "match").when(F.col("i_n") == 1, "match").when(F.col("i_n") > 1, "conflict").when((F.col("score") >= MATCH) & (F.col("ties") == 1), "match").when(F.col("score") >= CONFLICT, "conflict").otherwise("create")
    reason = F.when(F.col("s_id").isNotNull(), "source_id").when(F.col("i_n") == 1, "identity").when(F.col("i_n") > 1, "ambiguous_identity").when(F.col("score") >= CONFLICT, "scored").otherwise("new")
    target = F.when(F.col("s_id").isNotNull(), F.col("s_id")).when(F.col("i_n") == 1, F.col("i_id")).when((F.col("score") >= MATCH) & (F.col("ties") == 1) & F.col("i_n").isNull(), F.col("c_id"))
    return j.select(*key, action.alias("action"), target.alias("speciedex_id"), F.round("score", 6).alias("score"), reason.alias("reason"))


def basic_score(a: str, b: str) -> Column:
    """Integer points of the reduced matcher: no provider weight, no points for the scientific name or the accepted id; raw below 35 stays below 50."""
    def same(f: str) -> Column:
        return (X.key(F.col(f"{a}.{f}")) != "") & (X.key(F.col(f"{a}.{f}")) == X.key(F.col(f"{b}.{f}")))
    raw = sum((F.when(same(f), p).otherwise(0) for f, p in FIELD_POINTS.items() if f != "scientific_name"), F.lit(0))
    line = sum((F.when(same(f), LINEAGE_POINTS).otherwise(0) for f in ("phylum", "class_name", "order_name", "family", "genus")), F.lit(0))
    return (raw + F.least(F.lit(LINEAGE_MOST), line)).cast("int")


def basic_candidates(new: DataFrame, taxa: DataFrame) -> DataFrame:
    """provider, provider_id, speciedex_id, score of the candidates of one name, rank and kingdom under `basic_score`, best first a record; ties by id."""
    name = lambda: F.concat_ws("|", X.key(F.col("canonical_name")), X.key(F.col("rank")), X.key(F.col("kingdom")))
    rows = newest(new, ["provider", "provider_id"], "retrieved_at").withColumn("_name", name())
    have = newest(taxa, ["speciedex_id"]).withColumn("_name", name())
    pairs = rows.alias("a").join(have.alias("b"), F.col("a._name") == F.col("b._name"))
    return pairs.select(F.col("a.provider").alias("provider"), F.col("a.provider_id").alias("provider_id"), F.col("b.speciedex_id").alias("speciedex_id"), basic_score("a", "b").alias("score"))


def apply_result(actions: DataFrame, assertions: DataFrame, new: DataFrame) -> DataFrame:
    """provider, provider_id, speciedex_id, outcome of each reconciled record.

    A match is attached: `revised` if an assertion of that source id was there with another hash, `unchanged` if with
    the same one, else `matched`; a new one is `created` under the id of its identity; a conflict is `conflicted` and
    has no id.
    """
    key = ["provider", "provider_id"]
    rows = newest(new, key, "retrieved_at")
    digest = F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c != "retrieved_at")), {"ignoreNullFields": "false"}), 256)
    made = X.record_id(X.identity_key(F.col("canonical_name"), F.col("rank"), F.col("kingdom"), F.col("authorship")))
    j = actions.join(rows.select(*key, digest.alias("_new"), made.alias("_made")), key, "left").join(newest(assertions, key).select(*key, F.col("assertion_hash").alias("_old")), key, "left")
    outcome = F.when(F.col("action") == "conflict", "conflicted").when(F.col("action") == "create", "created").when(F.col("_old").isNull(), "matched").when(F.col("_old") != F.col("_new"), "revised").otherwise("unchanged")
    return j.select(*key, F.when(F.col("action") == "create", F.col("_made")).otherwise(F.col("speciedex_id")).alias("speciedex_id"), outcome.alias("outcome"))


def duplicate_pairs(taxa: DataFrame, key: str = "speciedex_id", hot: int = 1000, providers: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """a, b, score, verdict of candidate pairs scored at least 0.68.

    Candidates share the canonical name with its rank (so also the identity key), or the scientific name, or a name or
    synonym of one is a synonym of the other. `providers` has a provider and `synonyms` a synonym_key of each key; without
    them these sets are empty. Exact copies share a signature first, so that distinct contents only are paired; contents
    of one signature are linked to its smallest id with score 1. One side of what shares a value is cut into slices of
    about `hot` contents, each of which meets the whole other side, so that tasks share a large block and no pair
    depends on its size.
    """
    fields = ["canonical_name", "scientific_name", "authorship", "rank", "kingdom", "phylum", "class_name", "order_name", "family", "genus", "status"]
    rows = newest(taxa.select(key, *fields, *[c for c in ("loaded_at",) if c in taxa.columns]), [key]).select(key, *fields)
    for name, df, c in (("providers", providers, "provider"), ("synonyms", synonyms, "synonym_key")):
        if df is not None:
            rows = rows.join(df.select(key, X.key(F.col(c)).alias("v")).where("v <> ''").groupBy(key).agg(F.array_sort(F.collect_set("v")).alias(name)), key, "left")
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast("array<string>")) if df is not None else F.array().cast("array<string>"))
    rows = checkpoint(rows.withColumn("sig", F.xxhash64(*[X.key(F.col(c)) for c in fields], F.to_json(F.struct("providers", "synonyms")))))
    fields = [*fields, "providers", "synonyms"]
    heads = checkpoint(rows.withColumnRenamed(key, "id").groupBy("sig").agg(F.min("id").alias("id"), *[F.min(c).alias(c) for c in fields]))
    copies = rows.join(heads.select("sig", F.col("id").alias("a")), "sig").where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"), F.lit(1.0).alias("score"))
    names = F.array(F.concat(F.lit("n|"), X.key(F.col("canonical_name")), F.lit("|"), X.key(F.col("rank"))), F.when(~blank("scientific_name"), F.concat(F.lit("f|"), X.key(F.col("scientific_name")))))
    own = F.filter(F.array(X.key(F.col("canonical_name")), X.key(F.col("scientific_name"))), lambda v: v != "")
    terms = lambda vs: F.transform(vs, lambda v: F.concat(F.lit("s|"), v))
    met = lambda values: heads.select("id", F.explode(F.array_distinct(F.array_compact(values))).alias("block"))
    right = met(F.concat(names, terms(F.col("synonyms"))))
    size = right.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("slices"))
    left = met(F.concat(names, terms(F.concat(F.col("synonyms"), own)))).join(size, "block").withColumn("slice", F.pmod(F.xxhash64("id"), "slices").cast("int"))
    right = right.join(size, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    found = left.alias("x").join(right.alias("y"), (F.col("x.block") == F.col("y.block")) & (F.col("x.slice") == F.col("y.slice")) & (F.col("x.id") != F.col("y.id")))
    found = found.select(F.least("x.id", "y.id").alias("p"), F.greatest("x.id", "y.id").alias("q")).distinct()
    c = lambda s, f: F.col(f"{s}.{f}")
    w = DUPLICATE_WEIGHTS
    line = X.lineage_similarity({r: c("x", f) for r, f in (("kingdom", "kingdom"), ("phylum", "phylum"), ("class", "class_name"), ("order", "order_name"), ("family", "family"), ("genus", "genus"))}, {r: c("y", f) for r, f in (("kingdom", "kingdom"), ("phylum", "phylum"), ("class", "class_name"), ("order", "order_name"), ("family", "family"), ("genus", "genus"))})
    author = X.authority_similarity(c("x", "authorship"), c("y", "authorship"))
    same = lambda f: F.when((X.key(c("x", f)) == "") & (X.key(c("y", f)) == ""), 0.5).otherwise((X.key(c("x", f)) == X.key(c("y", f))).cast("double"))
    named = lambda s, o: (X.key(c(s, "canonical_name")) != "") & F.array_contains(c(o, "synonyms"), X.key(c(s, "canonical_name")))
    shared = F.coalesce(F.try_divide(F.size(F.array_intersect(c("x", "synonyms"), c("y", "synonyms"))), F.size(F.array_union(c("x", "synonyms"), c("y", "synonyms")))), F.lit(0.0))
    synonym = F.when(named("x", "y") | named("y", "x"), 1.0).otherwise(shared)
    score = w["canonical_name"] * X.text_similarity(c("x", "canonical_name"), c("y", "canonical_name")) + w["scientific_name"] * X.text_similarity(c("x", "scientific_name"), c("y", "scientific_name")) + w["authorship"] * author + w["rank"] * same("rank") + w["kingdom"] * same("kingdom") + w["lineage"] * line + w["status"] * X.status_similarity(c("x", "status"), c("y", "status")) + w["provider_support"] * X.set_similarity(c("x", "providers"), c("y", "providers")) + w["synonym_support"] * synonym
    ident = X.identity_key(c("x", "canonical_name"), c("x", "rank"), c("x", "kingdom"), c("x", "authorship")) == X.identity_key(c("y", "canonical_name"), c("y", "rank"), c("y", "kingdom"), c("y", "authorship"))
    strong = (X.key(c("x", "canonical_name")) == X.key(c("y", "canonical_name"))) & (same("rank") == 1) & (line >= 0.9) & (author >= 0.85)
    score = F.greatest(score, F.when(ident, EXACT).otherwise(0.0), F.when(strong, 0.95).otherwise(0.0))
    pairs = found.join(heads.alias("x"), F.col("p") == F.col("x.id")).join(heads.alias("y"), F.col("q") == F.col("y.id")).select(F.col("p").alias("a"), F.col("q").alias("b"), score.alias("score")).where(F.col("score") >= REVIEW)
    verdict = F.when(F.col("score") >= EXACT, "exact").when(F.col("score") >= PROBABLE, "probable").otherwise("review")
    return pairs.unionByName(copies).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("score", 6).alias("score"), verdict.alias("verdict"))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, cluster: connected components, named by their smallest node.

    Labels jump along the smallest neighbour (large star, small star), so rounds grow with the logarithm of the
    longest chain; a hot node is only ever the target of edges that are already reduced to one a neighbour.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = checkpoint(e)
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select("b", "m").distinct()  # greater neighbours point to the smallest
        down = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").unionByName(least.select(F.col("a").alias("x"), "m")).distinct()
        e = checkpoint(small.select(F.col("m").alias("a"), F.col("x").alias("b")).where("a < b").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    root = e.groupBy("b").agg(F.min("a").alias("cluster"))
    return nodes.join(root, nodes.node == root.b, "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def cluster_summary(pairs: DataFrame, least: float = PROBABLE) -> DataFrame:
    """cluster, size, max, min and mean score over the probable pairs of each cluster; action is merge if all found pairs of its members are probable, else review."""
    pairs = checkpoint(pairs)
    good = pairs.where(F.col("score") >= least)
    nodes = good.select(F.col("a").alias("node")).unionByName(good.select(F.col("b").alias("node"))).distinct()
    c = checkpoint(components(nodes, good))
    size = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    stats = good.join(c, good.a == c.node).groupBy("cluster").agg(F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.round(F.avg("score"), 6).alias("avg_score"))
    # A review pair that leaves the cluster counts too: it would be a member pair if such pairs linked.
    weak = pairs.where(F.col("score") < least)
    weak = weak.select(F.explode(F.array("a", "b")).alias("node")).join(c, "node").select("cluster").distinct().withColumn("action", F.lit("review"))
    return size.join(stats, "cluster").join(weak, "cluster", "left").withColumn("action", F.coalesce("action", F.lit("merge")))


def preferred(members: DataFrame, taxa: DataFrame, providers: DataFrame, key: str = "speciedex_id") -> DataFrame:
    """cluster, keep: accepted first, then most providers, fullest lineage, has an author; then the greatest id."""
    n = providers.groupBy(key).agg(F.count_distinct("provider").alias("n"))
    full = sum((F.when(~blank(c), 1).otherwise(0) for c in ("kingdom", "phylum", "class_name", "order_name", "family", "genus")), F.lit(0))
    t = newest(taxa, [key]).select(key, F.struct(X.is_accepted(F.col("status")).alias("ok"), full.alias("full"), (~blank("authorship")).alias("author")).alias("q"))
    j = members.join(t, members.node == t[key]).join(n, key, "left")
    return j.groupBy("cluster").agg(F.max_by(key, F.struct(F.col("q.ok"), F.coalesce("n", F.lit(0)), F.col("q.full"), F.col("q.author"), F.col(key))).alias("keep"))


def merge_plan(members: DataFrame, keep: DataFrame, tables: dict[str, DataFrame], key: str = "speciedex_id") -> DataFrame:
    """table, from_id, to_id, rows: what moves when the members of each cluster merge into the kept record."""
    m = members.join(keep, "cluster").where("node <> keep").select(F.col("node").alias(key), "keep")
    parts = [t.join(m, key).groupBy(F.lit(n).alias("table"), F.col(key).alias("from_id"), F.col("keep").alias("to_id")).agg(F.count(F.lit(1)).alias("rows")) for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def pair_id(a: Column, b: Column) -> Column:
    return F.sha2(F.to_json(F.array_sort(F.array(a, b))), 256)


def worst_status(df: DataFrame, by: str, status: str) -> DataFrame:
    """by, status: critical over warning over unknown over ok."""
    order = F.create_map(*[F.lit(x) for kv in {"ok": 0, "unknown": 1, "warning": 2, "critical": 3}.items() for x in kv])
    return df.groupBy(by).agg(F.max_by(status, order[F.col(status)]).alias("status"))


def history_issues(df: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """order, code: tracked fields that are missing or negative."""
    return issues(df, [order], [(f"{f}_negative", "error", f, F.col(f) < 0) for f in fields] + [(f"{f}_missing", "error", f, F.col(f).isNull()) for f in fields])
