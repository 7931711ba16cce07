"""Queries over the star-schema tables, one for each operator or group of operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text, vectors
from plumbline.operators import chain, drift, duplicates, evaluate, evidence, findings, fourier, fusion, governance, groups, label_noise, ledger, models, neighbours, outliers, patterns, profile, quantiles, report, reports, validate
from plumbline.streaming import operators as streams
from plumbline.tables import durable, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- validation


@query("""select 'missing_label' as side, count(*) as n from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)
union all select 'unknown_sample', count(*) from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id)""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


RELATIONS = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"))


@query(" union all ".join(f"select '{c}.{k}' as relation, count(*) as n from {c} x where {k} is not null and not exists (select 1 from {p} y where y.{q} = x.{k})" for c, k, p, q in RELATIONS))
def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [validate.orphans(table(spark, sf_dir, c).select(k), table(spark, sf_dir, p), (k, q), f"{c}.{k}") for c, k, p, q in RELATIONS]
    return findings.union(*parts)


@query("""select violation, count(*) as n from (select unnest(list_filter([case when not (l_quantity between 1 and 45) then 'quantity_range' end, case when not (l_discount <= 0.08) then 'discount_range' end,
case when not (l_extendedprice >= 2000) then 'price_low' end, case when not (l_returnflag in ('A', 'N')) then 'flag_unknown' end, case when not (l_tax < l_discount) then 'tax_above_discount' end], lambda x: x is not null)) as violation from lineitem) group by 1""")
def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = validate.violations(quantity_range=F.col("l_quantity").between(1, 45), discount_range=F.col("l_discount") <= 0.08, price_low=F.col("l_extendedprice") >= 2000, flag_unknown=F.col("l_returnflag").isin("A", "N"), tax_above_discount=F.col("l_tax") < F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(F.explode(broken).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query("""select count(*) filter (where l and r) as paired, count(*) filter (where l and not r) as left_only, count(*) filter (where r and not l) as right_only from (
select k, bool_or(s = 'l') as l, bool_or(s = 'r') as r from (select distinct c_custkey as k, 'l' as s from customer union all select distinct o_custkey, 'r' from orders) group by k)""")
def customer_order_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.pairing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


# ---- profiles


@query("select lang, source, count(*) as n from documents group by all")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distribution(table(spark, sf_dir, "documents"), "lang", "source")


@query("""select source, count(*) as n_docs, count(distinct text) as n_texts, sum(length(text)) as n_chars, list_sort(list(distinct lang)) as langs, count(quality) as n_labelled, count(*) filter (where toxic = 1) as n_toxic
from documents left join labels using (doc_id) group by source""")
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_distinct("text").alias("n_texts"), F.sum(F.length("text")).alias("n_chars"), F.array_sort(F.collect_set("lang")).alias("langs"), F.count("quality").alias("n_labelled"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


@query("""with h as (select sha256(concat_ws('|', o_orderkey::varchar, o_custkey::varchar, o_orderstatus)) as h from orders), g as (select substr(h, 1, 2) as g, count(*) as n, sha256(string_agg(h, ',' order by h)) as d from h group by 1)
select sum(n)::bigint as n, sha256(string_agg(d, ',' order by g)) as digest from g""")
def dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.digest(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderstatus")


@query("select pos, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, count(*) as n from (select unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by pos")
def standardization_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.dimension_stats(table(spark, sf_dir, "embeddings"), "embedding")
    return stats.select(F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("select label, pos, round(avg(x), 6) as mean from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by all")
def class_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dimension_stats(table(spark, sf_dir, "embeddings"), "embedding", "label").select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query("""with m as (select event_type, median(value) as median, count(*) as n from events group by 1), s as (select event_type, median, n, median(abs(value - median)) as mad from events join m using (event_type) group by all)
select event_type, round(median, 6) as median, round(mad, 6) as mad, n, round(median + 5 * 1.4826 * mad, 6) as threshold from s""")
def robust_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = profile.threshold_from(profile.robust_scale(table(spark, sf_dir, "events"), "value", "event_type"))
    return done.select("event_type", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "n", F.round("threshold", 6).alias("threshold"))


@query("""with x as (select vec_id, label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as pos from embeddings), m as (select label, pos, median(x) as m from x group by all),
d as (select vec_id, label, round(sqrt(sum((x - m) * (x - m))), 9) as d from x join m using (label, pos) group by all), r as (select *, row_number() over (partition by label order by d, vec_id) as r, count(*) over (partition by label) as n from d)
select label, count(*) as kept, round(max(d), 6) as reach from r where r <= greatest(8, ceil(round(n * 0.9, 9))) group by label""")
def outlier_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    middle = rows.groupBy("label", "pos").agg(F.median("x").alias("m"))
    apart = rows.join(middle, ["label", "pos"]).groupBy("vec_id", "label").agg(F.round(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)), 9).alias("d"))
    return profile.trimmed(apart, "d", "label", "vec_id").groupBy("label").agg(F.count("*").alias("kept"), F.round(F.max("d"), 6).alias("reach"))


@query("""with q as (select l_returnflag, l_linestatus, count(l_extendedprice) as n, quantile_cont(l_extendedprice, [0.01, 0.5, 0.95, 0.999]) as q from lineitem group by all)
select l_returnflag, l_linestatus, n, round(q[1], 4) as p1, round(q[2], 4) as median, round(q[3], 4) as p95, round(q[4], 4) as p999 from q""")
def large_group_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quantiles.exact(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.01, 0.5, 0.95, 0.999], "l_returnflag", "l_linestatus")
    return done.select("l_returnflag", "l_linestatus", "n", *(F.round(F.col("quantiles")[i], 4).alias(name) for i, name in enumerate(("p1", "median", "p95", "p999"))))


@query("""with m as (select median(l_quantity * l_extendedprice) as m, count(*) as n from lineitem), s as (select m, n, median(abs(l_quantity * l_extendedprice - m)) as mad from lineitem, m group by all)
select round(m, 4) as median, round(mad, 4) as mad, n, round(m + 5 * 1.4826 * mad, 4) as threshold from s""")
def large_robust_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * F.col("l_extendedprice")).alias("value"))
    done = profile.threshold_from(quantiles.robust_scale(values, "value"))
    return done.select(F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), "n", F.round("threshold", 4).alias("threshold"))


@query("""select o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_pop(o_totalprice), 4) as std, min(o_totalprice) as min, round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.95), 4) as p95, round(quantile_cont(o_totalprice, 0.99), 4) as p99, max(o_totalprice) as max from orders group by 1""")
def null_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = profile.null_summary(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return done.select("o_orderpriority", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std")), "min", *(F.round(c, 4).alias(c) for c in ("median", "p95", "p99")), "max")


_CHANGE = "case when abs(reference) > 1e-12 then abs(live - reference) / abs(reference) end"


@query(f"""with r as (select avg(l_quantity) as a1, stddev_pop(l_quantity) as a2, avg(l_extendedprice) as b1, stddev_pop(l_extendedprice) as b2, avg(l_tax) as c1, stddev_pop(l_tax) as c2 from lineitem where l_returnflag = 'A'),
l as (select avg(l_quantity) as a1, stddev_pop(l_quantity) as a2, avg(l_extendedprice) as b1, stddev_pop(l_extendedprice) as b2, avg(l_tax) as c1, stddev_pop(l_tax) as c2 from lineitem where l_returnflag = 'N' and l_discount > 0.05 and l_quantity > 20),
u as (select unnest(['l_quantity', 'l_quantity', 'l_extendedprice', 'l_extendedprice', 'l_tax', 'l_tax']) as column_name, unnest(['mean', 'std', 'mean', 'std', 'mean', 'std']) as statistic, unnest([r.a1, r.a2, r.b1, r.b2, r.c1, r.c2]) as reference, unnest([l.a1, l.a2, l.b1, l.b2, l.c1, l.c2]) as live from r, l)
select column_name, statistic, round(reference, 4) as reference, round(live, 4) as live, round({_CHANGE}, 4) as change, case when {_CHANGE} is null then 'NOT_AVAILABLE' when {_CHANGE} >= 0.2 then 'HIGH' when {_CHANGE} >= 0.08 then 'MEDIUM' else 'LOW' end as level from u""")
def column_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    done = profile.column_diagnostics(items.filter("l_returnflag = 'A'"), items.filter("l_returnflag = 'N' and l_discount > 0.05 and l_quantity > 20"), ["l_quantity", "l_extendedprice", "l_tax"])
    return done.select("column_name", "statistic", *(F.round(c, 4).alias(c) for c in ("reference", "live", "change")), "level")


@query("""select case when not exists (select event_type from events) then 'NOT_AVAILABLE' when exists (select event_type from events where user_id % 2 = 0 except select event_type from events where user_id % 2 = 1) or exists (select event_type from events where user_id % 2 = 1 except select event_type from events where user_id % 2 = 0) then 'HIGH' else 'LOW' end as level""")
def metadata_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return profile.set_change(events.filter("user_id % 2 = 0"), events.filter("user_id % 2 = 1"), "event_type")


# ---- duplicates and neighbours


@query("select sha256(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


_PAIRS = "select a.vec_id as id_a, b.vec_id as id_b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a join embeddings b on a.vec_id < b.vec_id"


@query(f"select id_a, id_b, round(round(s, 6), 4) as similarity from ({_PAIRS}) where s >= 0.35")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.35).withColumn("similarity", F.round("similarity", 4))


@query(f"with p as (select id_a, id_b, round(s, 6) as s from ({_PAIRS}) where s >= 0.35), e as (select id_a as id, id_b as partner, s from p union all select id_b, id_a, s from p) select id, arg_min(partner, (-s, partner)) as partner, round(max(s), 4) as similarity from e group by id")
def duplicate_best_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.best_partners(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.35).withColumn("similarity", F.round("similarity", 4))


_NEAREST = "select a.vec_id as id, a.label, b.vec_id as neighbour, b.label as near, list_distance(a.embedding::double[], b.embedding::double[]) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id qualify row_number() over (partition by a.vec_id order by d, b.vec_id) <= 5"


@query(f"select id, neighbour, round(d, 5) as distance, row_number() over (partition by id order by d, neighbour) as rank from ({_NEAREST})")
def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5).withColumn("distance", F.round("distance", 5)).withColumn("rank", F.col("rank").cast("long"))


@query()
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest orders of every order, by price, day and customer in standard deviations, by the index of centres."""
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_totalprice") / 144_000, day / 700, F.col("o_custkey") / 433).cast("array<double>").alias("v"))
    return neighbours.nearest(orders.filter("v[0] + v[1] + v[2] is not null"), "o_orderkey", "v", 5).withColumn("distance", F.round("distance", 6))


@query(f"select label, count(*) as n, round(avg(case when label = near then 1.0 else 0.0 end), 4) as agreement from ({_NEAREST}) group by label")
def knn_label_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    near = duplicates.nearest(rows, "vec_id", "embedding", 5).join(rows.select(F.col("vec_id").alias("id"), "label"), "id").join(rows.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("near")), "neighbour")
    return near.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("near")).cast("double")), 4).alias("agreement"))


@query()
def label_flip_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_noise.find(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query()
def mahalanobis_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    threshold = outliers.calibrate(rows, "vec_id", "embedding", "label")
    return outliers.flag(outliers.score(rows, "vec_id", "embedding", outliers.fit(rows, "vec_id", "embedding", "label")), threshold)


# ---- groups, fusion, evaluation


def _doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "labels").filter("toxic = 1 or quality = 0")
    return marked.select("doc_id", F.when(F.col("toxic") == 1, "label_flip").otherwise("duplicate").alias("anomaly_type"), F.concat(F.lit("q"), "quality").alias("original_label"), F.concat(F.lit("q"), F.col("doc_id") % 3).alias("predicted_label"), F.concat(F.lit("e"), "doc_id").alias("evidence"))


_MEMBERS = "u as (select doc_id, 'source' as group_type, source as group_id from documents union all select doc_id, 'lang', lang from documents), f as (select doc_id, case when toxic = 1 then 'label_anomaly' else 'duplicate_anomaly' end as t, case when toxic = 1 and quality <> doc_id % 3 then 'q' || quality || ' -> q' || doc_id % 3 end as c, 'e' || doc_id as evidence from labels where toxic = 1 or quality = 0)"


@query(f"""with {_MEMBERS}, b as (select (select count(distinct doc_id) from f) / count(*) as p from documents), s as (select group_type, group_id, count(*) as size, count(f.doc_id) as affected from u left join f using (doc_id) group by all),
z as (select *, affected / size as f, case when size < 5 or p <= 0 then 0.0 else (affected / size - p) / (case when p >= 1 then 0.001 else sqrt(p * (1 - p) / size) end) end as z from s, b), k as (select *, size >= 5 and affected >= 3 and (f >= 0.1 or z >= 2.5) as flagged from z)
select group_type, group_id, size, affected, affected as n_findings, round(f, 4) as fraction, round(z, 2) as z, round(least(greatest(0.65 + least(0.3, 0.05 * greatest(0, z)), 0.6), 0.95), 2) as confidence, case when not flagged then 'LOW' when f >= 0.25 then 'HIGH' when f >= 0.15 then 'MEDIUM' else 'LOW' end as severity, flagged from k""")
def group_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.risk(_doc_findings(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id", ["source", "lang"])


@query(f"with {_MEMBERS} select group_type, group_id, arg_min(c, (-n, c)) as confusion, max(n) as n from (select group_type, group_id, c, count(*) as n from u join f using (doc_id) where c is not null group by all) group by all")
def dominant_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.dominant_confusion(_doc_findings(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id", ["source", "lang"])


@query(f"with {_MEMBERS}, n as (select group_type, group_id, t, count(*) as n from u join f using (doc_id) group by all) select group_type, group_id, string_agg(t || '=' || n, ',' order by t) as types from n group by all")
def group_finding_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = groups.type_counts(_doc_findings(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id", ["source", "lang"])
    entries = F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return typed.select("group_type", "group_id", F.array_join(entries, ",").alias("types"))


@query(f"""with {_MEMBERS}, b as (select (select count(distinct doc_id) from f) as k, count(*) as total, (select count(distinct doc_id) from f) / count(*) as p from documents), s as (select group_type, group_id, count(*) as size, count(f.doc_id) as affected, count(*) filter (where t = 'label_anomaly') as labels, count(*) filter (where t = 'duplicate_anomaly') as dups from u left join f using (doc_id) group by all),
z as (select *, affected / size as share, (affected / size - p) / sqrt(p * (1 - p) / size) as z from s, b), k as (select * from z where size >= 5 and affected >= 3 and (share >= 0.1 or z >= 2.5)),
c as (select group_type, group_id, arg_min(c, (-n, c)) as confusion, max(n) as times from (select group_type, group_id, c, count(*) as n from u join f using (doc_id) where c is not null group by all) group by all),
r as (select group_type, group_id, list(evidence order by doc_id)[1:10] as refs from u join f using (doc_id) group by all)
select 'group_' || group_type || '_' || group_id as finding_id, affected as affected_samples, case when share >= 0.25 then 'HIGH' when share >= 0.15 then 'MEDIUM' else 'LOW' end as severity, case when labels > 0 then 'Elevated systematic annotation anomaly' else 'Elevated integrity risk' end as finding,
case when confusion is not null then confusion || ' (' || times || 'x)' end as dominant_confusion, array_to_string(refs, ',') as evidence_refs,
coalesce(nullif(concat_ws('; ', case when times >= 3 then 'Systematic mislabelling anomaly: dominant confusion ' || confusion || ' (' || times || '/' || affected || ' label anomalies)' when labels >= 3 then printf('Elevated label anomaly rate: %d anomalies (%.1f%% vs %.1f%% baseline)', labels, share * 100, p * 100) end, case when dups >= 3 then 'Near-duplicate concentration: ' || dups || ' duplicate pairs in group' end), ''), printf('Elevated aggregate anomaly rate (%.1f%% vs %.1f%% baseline, z=%.1f)', share * 100, p * 100, round(z, 2))) as reason
from k left join c using (group_type, group_id) left join r using (group_type, group_id)""")
def group_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups.findings(_doc_findings(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id", ["source", "lang"], "evidence")
    return found.select("finding_id", "affected_samples", "severity", "finding", "dominant_confusion", F.array_join("evidence_refs", ",").alias("evidence_refs"), "reason")


@query("""with f as (select user_id, case event_type when 'click' then 'trigger' else event_type end as detector, least(greatest(0.05 + round(value, 2) / 1000, 0.01), 0.99) as c, case when value > 150 then 3 when value > 80 then 2 else 1 end as p from events),
e as (select user_id, list_sort(list(distinct detector)) as detectors, round(least(greatest(1 - exp(sum(ln(1 - c))), 0.5), 0.98), 2) as confidence, max(p) as p from f group by 1),
r as (select *, case when list_contains(detectors, 'trigger') and confidence >= 0.88 then 4 when list_contains(detectors, 'trigger') or len(detectors) >= 2 then greatest(p, 3) else p end as q from e)
select user_id, detectors, confidence, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][q + 1] as severity, case when list_contains(detectors, 'trigger') and q >= 3 and confidence >= 0.9 then 'QUARANTINE' else 'REVIEW' end as disposition from r""")
def noisy_or_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "click", "trigger").otherwise(F.col("event_type")).alias("detector"), (0.05 + F.round(value, 2) / 1000).alias("confidence"), F.when(value > 150, "HIGH").when(value > 80, "MEDIUM").otherwise("LOW").alias("severity"))
    return fusion.fuse(rows, "user_id")


_FLAGS = "flags as (select doc_id, 'duplicate' as flag, 2 as p from documents where text in (select text from documents group by text having count(*) > 1) union all select doc_id, 'label_flip', 3 from labels where toxic = 1 union all select doc_id, 'ood', 2 from labels where quality = 0)"


def _detectors(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    repeated = hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    return {"duplicate": hashed.join(repeated, "h").select("doc_id"), "label_flip": labels.filter("toxic = 1").select("doc_id"), "ood": labels.filter("quality = 0").select("doc_id")}


SEVERITY = {"duplicate": "MEDIUM", "label_flip": "HIGH", "ood": "MEDIUM"}


@query(f"""with {_FLAGS}, m as (select doc_id, list_sort(list(flag)) as flags, count(*)::int as n_flags, max(p) as p from flags group by 1)
select doc_id, flags, n_flags, round(least(0.6 + 0.15 * (n_flags - 1), 0.95)::double, 2) as confidence, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][least(p + (case when n_flags >= 2 then 1 else 0 end), 4) + 1] as severity, 'REVIEW' as disposition from m""")
def detector_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merge(_detectors(spark, sf_dir), "doc_id", SEVERITY)


@query(f"""with {_FLAGS}, m as (select doc_id, list_sort(list(flag)) as flags, count(*)::int as n, max(p) as p from flags group by 1), j as (select doc_id, '{{"assessment":"FLAGGED_FOR_REVIEW","asset":{{"flags":["' || array_to_string(flags, '","') || '"],"image_id":"' || doc_id || '","n_flags":' || n || '}},"check_context":{{"least":1}},"dataset":{{"name":"documents"}},"finding_fields":{{"confidence":' || round(least(0.6 + 0.15 * (n - 1), 0.95)::double, 2) || ',"disposition":"REVIEW","reason":"' || array_to_string(flags, ', ') || '","severity":"' || ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][least(p + (case when n >= 2 then 1 else 0 end), 4) + 1] || '"}},"limitations":["no proof of intent"],"module":"DataIntegrity","run":{{"mode":"offline","timestamp":"2024-01-01"}}}}' as payload from m) select doc_id, sha256(payload) as evidence_hash, payload from j""")
def evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = detector_merge(spark, sf_dir).withColumn("reason", F.array_join("flags", ", "))
    return evidence.documents(flagged, "doc_id", F.struct(F.lit(1).alias("least")), F.struct(F.lit("documents").alias("name")), "2024-01-01", ("no proof of intent",))


@query(f"""with {_FLAGS}, m as (select doc_id, count(*) as n, max(p) as p from flags group by 1) select 'check' as kind, flag as name, count(*) as n from flags group by flag
union all select 'severity', ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][least(p + (case when n >= 2 then 1 else 0 end), 4) + 1], count(*) from m group by 2""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.run_summary(detector_merge(spark, sf_dir))


_RATES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 4) as accuracy, round(coalesce(fp / nullif(fp + tn, 0), 0), 4) as fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 4) as fnr"
_JUDGED = "j as (select d.doc_id, lang, length(text) < 800 as f, coalesce(quality = 0 or toxic = 1, false) as t, case when toxic = 1 then 'toxic' when quality = 0 then 'quality' end as scenario from documents d left join labels using (doc_id))"


@query(f"with {_JUDGED}, c as (select lang, count(*) filter (where f and t) as tp, count(*) filter (where f and not t) as fp, count(*) filter (where not f and t) as fn, count(*) filter (where not f and not t) as tn from j group by lang) select lang, tp, fp, fn, tn, {_RATES} from c")
def evaluation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("lang", (F.length("text") < 800).alias("f"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("t"))
    return evaluate.rates(evaluate.confusion(judged, "f", "t", "lang"))


def _attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("toxic = 1 or quality = 0").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("quality").alias("scenario"))


@query(f"with {_JUDGED}, c as (select scenario, count(*) filter (where f) as tp, count(*) filter (where not f) as fn from j where t group by 1), o as (select count(*) filter (where f and not t) as fp, count(*) filter (where not f and not t) as tn from j) select scenario, tp, fn, fp, tn, {_RATES} from c, o")
def scenario_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return evaluate.per_scenario(docs, docs.filter(F.length("text") < 800), _attacks(spark, sf_dir), "doc_id", "scenario")


@query(f"""with {_JUDGED}, d as (select distinct 'lang' as group_type, lang as group_id from documents where length(text) > 20000 union select distinct 'source', source from documents where length(text) > 20000),
a as (select distinct 'lang' as group_type, lang as group_id from documents join labels using (doc_id) where toxic = 1 and quality = 0 union select distinct 'source', source from documents join labels using (doc_id) where toxic = 1 and quality = 0),
c as (select group_type, count(*) filter (where d.group_id is not null and a.group_id is not null) as tp, count(*) filter (where a.group_id is null) as fp, count(*) filter (where d.group_id is null) as fn, 0::bigint as tn from d full join a using (group_type, group_id) group by 1) select group_type, tp, fp, fn, tn, {_RATES} from c""")
def group_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bad = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1 and quality = 0"), "doc_id")
    members = lambda frame: groups.unpivoted(frame.select("doc_id", "lang", "source"), "doc_id", ["lang", "source"])
    return evaluate.group_attribution(members(docs.filter(F.length("text") > 20000)), members(bad))


@query(f"with {_FLAGS}, c as (select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1)) select flag as detector, count(*) as false_positives, round(count(*) / (select count(*) from c), 4) as fpr, case when round(count(*) / (select count(*) from c), 4) < 0.05 then 'ACCEPTABLE' else 'NEEDS_REVIEW' end as verdict from flags join c using (doc_id) group by 1")
def clean_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_anti").select("doc_id")
    return evaluate.clean_control(detector_merge(spark, sf_dir).join(clean, "doc_id"), clean, "doc_id")


@query("""with t as (select o_orderkey as k, o_orderpriority as corruption, o_custkey as event_id, o_totalprice > 200000 as hit from orders), e as (select corruption, event_id, bool_or(hit) as hit from t group by all)
select corruption, count(*) as events, count(*) filter (where hit) as detected, round(count(*) filter (where hit) / count(*), 4) as rate from e group by 1""")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("corruption"), F.col("o_custkey").alias("event_id"), "o_totalprice")
    return evaluate.event_rates(orders.drop("o_totalprice"), orders.filter("o_totalprice > 200000"), "k")


@query("""with c as (select lang as item, count(*) as n from documents group by 1), e as (select * from (values ('en', 100), ('de', 30), ('pl', 1)) e(item, expected)) select item, expected, coalesce(n, 0) as actual, expected = coalesce(n, 0) as matches from e left join c using (item)""")
def inventory_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("en", 100), ("de", 30), ("pl", 1)], "item string, expected int")
    return evaluate.inventory(table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("item")).agg(F.count("*").alias("n")), expected)


@query(f"with {_FLAGS}, m as (select doc_id, min(flag) as kind from flags group by 1) select coalesce(kind, 'clean') as kind, count(*) as n from documents left join m using (doc_id) group by 1")
def first_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "documents").select("doc_id").join(detector_merge(spark, sf_dir).select("doc_id", "flags"), "doc_id", "left")
    return reports.first_flags(marked.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>"))), "flags")


# ---- windows and drift


@query("""with e as (select *, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from events), w as (select *, unnest(range(greatest(0, ceil((i - 99) / 40))::bigint, least(floor(i / 40), floor((n - 100) / 40))::bigint + 1)) as window_no from e)
select window_no, min(ts) as first_ts, max(ts) as last_ts, list_sort(list(distinct event_type)) as sources, count(*) as n, sha256(string_agg(event_id::varchar, ',' order by i)) as digest from w group by 1""")
def count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = drift.assigned(drift.indexed(table(spark, sf_dir, "events"), ["ts", "event_id"]), drift.Windows(100, 40))
    return drift.described(members, "ts", "event_type", "event_id")


_MMD = """r as (select embedding::double[] as v from embeddings where label = 0), l as (select i // 50 as window_no, v from (select row_number() over (order by vec_id) - 1 as i, embedding::double[] as v from embeddings where label > 0)),
f as (select window_no from l group by 1 having count(*) = 50), rr as (select avg(exp(-least(pow(list_distance(a.v, b.v), 2) / 2, 700))) as k from r a, r b), ll as (select a.window_no, avg(exp(-least(pow(list_distance(a.v, b.v), 2) / 2, 700))) as k from l a join l b using (window_no) group by 1),
rl as (select window_no, avg(exp(-least(pow(list_distance(a.v, b.v), 2) / 2, 700))) as k from r a, l b group by 1), m as (select window_no, 50 as n, greatest(0, rr.k + ll.k - 2 * rl.k) as mmd from f join ll using (window_no) join rl using (window_no), rr)"""


def _window_mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    members = drift.assigned(drift.indexed(rows.filter("label > 0"), ["vec_id"]), drift.Windows(50, 50))
    return drift.window_mmd(rows.filter("label = 0"), members, "vec_id", "embedding", sigma=1.0)


@query(f"with {_MMD} select window_no, n, round(mmd, 6) as mmd from m")
def window_mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_mmd(spark, sf_dir).select("window_no", "n", F.round("mmd", 6).alias("mmd"))


@query(f"with {_MMD} select window_no, n, true as within from m")
def window_mmd_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's statistic by Fourier features, and whether the one over all pairs lies within six standard errors of it."""
    rows = table(spark, sf_dir, "embeddings")
    reference, live = rows.filter("label = 0"), rows.filter("label > 0")
    members = durable(drift.assigned(drift.indexed(live, ["vec_id"]), drift.Windows(50, 50)))
    linear = fourier.window_mmd(fourier.fitted(reference, "vec_id", "embedding", 2_048, sigma=1.0), members, "embedding")
    exact = drift.window_mmd(reference, members, "vec_id", "embedding", sigma=1.0).select("window_no", F.col("mmd").alias("exact"))
    return linear.join(exact, "window_no").select("window_no", "n", (F.abs(F.col("mmd") - F.col("exact")) <= 6 * F.col("error")).alias("within"))


@query()
def window_mmd_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear form alone, with p values, over count windows of line items against those of returned ones."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_returnflag", F.array(F.col("l_quantity") / 14, F.col("l_extendedprice") / 23_000, F.col("l_discount") / 0.03, F.col("l_tax") / 0.026).alias("v"))
    good = items.filter("v[0] + v[1] + v[2] + v[3] is not null")
    reference, live = good.filter("l_returnflag = 'R'"), good.filter("l_returnflag <> 'R'")
    members = durable(drift.assigned(drift.indexed(live, ["id"]), drift.Windows(500, 500)))
    fitted = fourier.fitted(reference, "id", "v", 512)
    return fourier.window_mmd(fitted, members, "v").join(fourier.permutation_p(fitted, reference, members, "id", "v", 100), "window_no")


_IMAGE = "list_avg(embedding::double[]) as brightness, list_stddev_pop(embedding::double[]) as contrast"
_MOVED = lambda c: f"case when abs(r.{c}) < 1e-12 then 'NOT_AVAILABLE' when abs(l.{c} - r.{c}) / abs(r.{c}) >= 0.2 then 'HIGH' when abs(l.{c} - r.{c}) / abs(r.{c}) >= 0.08 then 'MEDIUM' else 'LOW' end"
_LEVELS = f"""lv as (select window_no, {_MOVED('brightness')} as b, {_MOVED('contrast')} as c from (select window_no, avg(brightness) as brightness, avg(contrast) as contrast from (select (row_number() over (order by vec_id) - 1) // 50 as window_no, {_IMAGE} from embeddings where label > 0) group by 1) l, (select avg(brightness) as brightness, avg(contrast) as contrast from (select {_IMAGE} from embeddings where label = 0)) r),
ds as (select window_no, 'LOW' as s from lv)"""
_CHECKED = f"""with {_MMD}, {_LEVELS}, a as (select window_no, mmd, case when round(mmd, 9) <= 0.02 then 'NO_SIGNIFICANT_SHIFT' when b = 'NOT_AVAILABLE' and c = 'NOT_AVAILABLE' then 'INSUFFICIENT_EVIDENCE' when b in ('MEDIUM', 'HIGH') or c in ('MEDIUM', 'HIGH') then 'OPERATIONAL_SHIFT_LIKELY' else 'UNEXPLAINED_SHIFT' end as assessment from m join lv using (window_no)),
checked as (select window_no, mmd, assessment, round(case assessment when 'NO_SIGNIFICANT_SHIFT' then 0.6 + 0.3 * least(greatest((0.02 - mmd) / 0.02, 0), 1) when 'OPERATIONAL_SHIFT_LIKELY' then 0.65 when 'UNEXPLAINED_SHIFT' then 0.7 else 0.2 end, 2) as confidence,
case assessment when 'OPERATIONAL_SHIFT_LIKELY' then 'MEDIUM' when 'UNEXPLAINED_SHIFT' then 'HIGH' else 'LOW' end as severity, case assessment when 'NO_SIGNIFICANT_SHIFT' then 'ACCEPT' else 'REVIEW' end as disposition from a)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of labelled vectors against those of label 0, with the means and deviations of the vectors as measured statistics."""
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").withColumn("brightness", vectors.mean(x)).withColumn("contrast", vectors.std(x))
    reference, live = rows.filter("label = 0"), rows.filter("label > 0")
    members = durable(drift.assigned(drift.indexed(live, ["vec_id"]), drift.Windows(50, 50)))
    described = drift.described(members, "vec_id", "label", "vec_id").withColumn("window_id", text.window_id("window_no", "digest"))
    tested = drift.window_mmd(reference, members, "vec_id", "embedding", sigma=1.0).withColumn("mmd", F.round("mmd", 9))
    levels = profile.window_levels(reference, members, {"brightness": ["brightness"], "contrast": ["contrast"]})
    return drift.checked(described, tested, 0.02, levels, size=50)


@query(f"{_CHECKED} select window_no, assessment, confidence, severity, disposition from checked")
def drift_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("window_no", "assessment", "confidence", "severity", "disposition")


@query(f"{_CHECKED} select window_no, round(mmd, 6) as drift, 0.02::double as threshold, confidence, assessment as status, round(mmd, 6) > 0.02 as anomaly from checked")
def drift_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _checked(spark, sf_dir)
    series = reports.drift_series(checked.select(F.col("window_no").alias("window_id"), "mmd", "threshold", "confidence", "assessment"))
    return series.withColumnRenamed("window_id", "window_no")


@query()
def drift_size_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    done = drift.size_matched_null(rows.filter("label = 0"), rows.filter("label > 0"), "vec_id", "embedding", 50, draws=50)
    return done.select("calibration_id", "threshold", "sigma", "draws", "n", "m", "digest", "null.mean", "null.median", "null.max")


@query()
def drift_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.calibrated(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


# ---- chains, seals, ledger


@query("""select conv_id, count(*) as n, list_reduce(list_prepend(repeat('0', 64), list(coalesce(text, '') order by turn)), lambda a, x: sha256(a || '|' || x)) as head from conversations group by conv_id""")
def chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.head_hash(table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), "conv_id", "turn", "text")


@query(f"""with recursive t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as seq,
  '{{"conv_id":' || conv_id || ',"event":{{"role":' || to_json(role) || ',"size":' || length(text) || ',"text":"' || md5(text) || '"}},"previous_event_hash":"' as before, '","turn":' || turn || '}}' as behind from conversations),
c as (select conv_id, seq, sha256(before || repeat('0', 64) || behind) as head from t where seq = 0 union all select t.conv_id, t.seq, sha256(before || head || behind) from c join t on t.conv_id = c.conv_id and t.seq = c.seq + 1)
select conv_id, max(seq) + 1 as n, arg_max(head, seq) as head from c group by 1""")
def nested_chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chains of nested events in canonical JSON."""
    event = F.struct(F.md5("text").alias("text"), F.col("role"), F.length("text").alias("size"))
    events = table(spark, sf_dir, "conversations").select("conv_id", "turn", event.alias("event"))
    return chain.head_hash(events, "conv_id", "turn", chain.nested(events))


_BROKEN = "case when conv_id % 11 = 0 and n > 1 then 'sequence' when conv_id % 7 = 0 then 'hash' when conv_id % 5 = 0 and n > 1 then 'link' end"


@query(f"with c as (select conv_id, count(*) as n from conversations group by 1) select conv_id, case when conv_id % 11 = 0 and n > 1 then n - 1 else n end as n, {_BROKEN} is null as valid, {_BROKEN} as first_error, case {_BROKEN} when 'sequence' then 0 when 'hash' then 0 when 'link' then 1 end as at from c")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with their first event deleted (every 11th), changed (7th) or a later one relinked (5th)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    built = chain.build(rows, "conv_id", "seq", "text").withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    short = built.filter(~((F.col("conv_id") % 11 == 0) & (F.col("seq") == 0) & (F.col("n") > 1)))
    first = F.col("seq") == 0
    changed = short.withColumn("text", F.when((F.col("conv_id") % 7 == 0) & first, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    relinked = (F.col("conv_id") % 5 == 0) & (F.col("conv_id") % 7 != 0) & (F.col("seq") == 1)
    changed = changed.withColumn("previous_hash", F.when(relinked, F.lit(chain.GENESIS)).otherwise(F.col("previous_hash")))
    return chain.verify(changed, "conv_id", "seq", "text").withColumn("at", F.col("at").cast("long"))


@query("select conv_id, count(*) as n, min(turn) as first_seq, max(turn) as last_seq, count(distinct turn) = count(*) and max(turn) - min(turn) + 1 = count(*) as contiguous from conversations group by 1")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.gaps(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("select event_id, user_id || '-' || props as nonce, row_number() over (partition by user_id || '-' || props order by ts, event_id) as use from events qualify use > 1")
def nonce_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("nonce", F.concat_ws("-", F.col("user_id").cast("string"), "props"))
    return chain.replays(rows, "nonce", "ts", "event_id").select("event_id", "nonce", F.col("use").cast("long").alias("use"))


@query("""with u as (select event_id, user_id, ts, props, row_number() over (partition by user_id || '-' || props order by ts, event_id) as use from events qualify use > 1)
select 'find-replay-' || substr(sha256('e' || event_id || '|' || use), 1, 12) as finding_id, 'e' || event_id as asset_id, 'FAIL' as status, 'HIGH' as severity, 'QUARANTINE' as disposition, 'Use ' || use || ' of nonce ' || user_id || '-' || props || '.' as reason, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as ts from u""")
def replay_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for every event whose nonce an earlier event has used."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("sealID"), F.concat_ws("-", F.col("user_id").cast("string"), "props").alias("nonce"), text.iso_utc("ts").alias("timestamp"), "ts", "event_id")
    done = findings.from_replays(chain.replays(rows, "nonce", "ts", "event_id").drop("ts", "event_id"))
    return done.select("finding_id", "asset_id", "status", "severity", "disposition", "reason", "ts")


@query("""with s as (select *, case when o_orderkey % 13 = 0 or o_orderstatus is null then false else true end as same, o_custkey % 3 as reg from orders), v as (select case when not same or reg = 1 then 'TAMPERED' when reg = 2 then 'UNREGISTERED' else 'VALID' end as verdict from s)
select verdict, count(*) as n from v group by 1""")
def seal_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sealed records: every 13th changed after sealing, a third bound to another model, a third to none."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("input"), F.col("o_orderstatus").alias("output"), F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("modelAssetID"), F.lit("d0").alias("modelDigest"))
    sealed = orders.withColumn("contentHash", F.sha2(F.concat_ws("|", "input", F.when(F.col("input") % 13 == 0, "?").otherwise(F.col("output"))), 256))
    registered = spark.createDataFrame([("m0", "d0"), ("m1", "d1")], "modelAssetID string, registered_digest string")
    return chain.verify_seals(sealed, ["input", "output"], registered, F.lit(True)).groupBy("verdict").agg(F.count("*").alias("n"))


@query("select page_id, case when page_id % 15 = 1 then 'missing' else 'changed' end as problem from pages where page_id % 15 = 1 or page_id % 10 = 0")
def evidence_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("evidence_hash", F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), "html"), 256))
    stored = pages.filter("page_id % 15 <> 1").select("evidence_hash", F.concat_ws("|", F.col("page_id").cast("string"), F.when(F.col("page_id") % 10 == 0, "x").otherwise(F.col("html"))).alias("payload"))
    return chain.unbound(pages.select("page_id", "evidence_hash"), stored).select("page_id", "problem")


@query("select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1")
def first_wins_single_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.first_by_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as o_orderstatus from orders group by 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_by_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query()
def first_wins_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat("o_custkey", F.lit("-"), F.date_format("o_orderdate", "yyyy-MM")).alias("asset"), F.sha2(F.round("o_totalprice", 0).cast("string"), 256).alias("hash"))
    return ledger.first_wins(orders)


_ENTRIES = "e as (select o_orderkey as tx_id, 'h' || o_custkey as hash, 'k' || (o_orderkey % 1000) as ledger_key, o_orderdate as day, case o_orderstatus when 'F' then 'COMMITTED' else 'PENDING' end as status from orders)"


@query(f"""with {_ENTRIES}, c as (select c_custkey as finding_id, 'h' || c_custkey as hash, 'k' || c_custkey as ledger_key from customer), g as (select finding_id, day, tx_id from c join e using (hash) where status = 'COMMITTED' union all select finding_id, day, tx_id from c join e using (ledger_key) where status = 'COMMITTED')
select finding_id, arg_max(tx_id, (day, tx_id)) as tx_id, max(day) as committed_at from c left join g using (finding_id) group by 1""")
def ledger_committed_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), F.concat(F.lit("h"), "o_custkey").alias("hash"), F.concat(F.lit("k"), F.col("o_orderkey") % 1000).alias("ledger_key"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "COMMITTED").otherwise("PENDING").alias("status"))
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("finding_id"), F.concat(F.lit("h"), "c_custkey").alias("hash"), F.concat(F.lit("k"), "c_custkey").alias("ledger_key"))
    return ledger.committed_entry(found, entries).select("finding_id", "tx_id", "committed_at")


@query("select user_id, arg_max(event_type, (ts, event_id)) as status, count(*) as steps, md5(string_agg(event_type, ',' order by ts, event_id)) as trail from events group by 1")
def quarantine_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("action"), F.lit("system").alias("actor"))
    steps = ledger.quarantine_timeline(events, "user_id")
    trail = steps.groupBy("user_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("step", "action")))["action"], ",")).alias("trail"))
    return ledger.quarantine_state(events, "user_id").select("user_id", "status", "steps").join(trail, "user_id")


# ---- findings and governance


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of four modules: labelled documents, suppliers as models, customers as sealed records, events as windows."""
    docs = table(spark, sf_dir, "labels").filter("toxic = 1 or quality = 0").join(table(spark, sf_dir, "documents"), "doc_id")
    toxic, poor = F.col("toxic") == 1, F.col("quality") == 0
    data = docs.select(F.col("doc_id").cast("string").alias("assetID"), F.when(toxic & poor, "CRITICAL").when(toxic, "HIGH").otherwise("MEDIUM").alias("severity"), F.when(toxic, 0.9).otherwise(0.6).alias("confidence"), F.when(toxic, "label flip suspected").otherwise("duplicate or ood content").alias("reason"), F.lit("2024-01-01").alias("timestamp"), F.sha2("text", 256).alias("evidenceHash"))
    balance = F.col("s_acctbal")
    models_ = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("assetID"), F.when(balance < 0, "CRITICAL").when(balance < 1500, "MEDIUM").otherwise("LOW").alias("severity"), F.lit(0.8).alias("confidence"), F.when(balance < 0, "trojan trigger").otherwise("clean").alias("reason"), F.lit("2024-01-02").alias("timestamp"), F.sha2("s_name", 256).alias("evidenceHash"))
    good = F.col("c_custkey") % 7 != 0
    seals = table(spark, sf_dir, "customer").select(F.concat(F.lit("seal-"), "c_custkey").alias("sealID"), F.concat(F.lit("d"), F.col("c_nationkey") % 2).alias("modelDigest"), good.alias("contentHashMatches"), F.lit(True).alias("signatureValid"), F.when(good, "VALID").otherwise("TAMPERED").alias("verdict"), F.sha2("c_name", 256).alias("contentHash"), F.lit("2024-01-03").alias("timestamp"))
    mmd = F.round("value", 2) / 1000
    word = F.when(F.col("event_id") % 11 == 0, "INSUFFICIENT_EVIDENCE").when(mmd <= 0.16, "NO_SIGNIFICANT_SHIFT").when(F.col("user_id") % 2 == 0, "OPERATIONAL_SHIFT_LIKELY").otherwise("UNEXPLAINED_SHIFT")
    windows = table(spark, sf_dir, "events").select(F.concat(F.lit("w"), "event_id").alias("window_id"), word.alias("assessment"), mmd.alias("mmd"), F.lit(0.16).alias("threshold"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), F.sha2("props", 256).alias("evidence_hash"))
    return findings.union(findings.from_data(data), findings.from_models(models_), findings.from_seals(seals, "d0"), findings.from_drift(windows))


_FINDINGS = """raw as (select 'DATA_INTEGRITY' as category, 'DataIntegrity' as module_name, 'find-di-' as prefix, doc_id::varchar as asset_id, case when toxic = 1 and quality = 0 then 'CRITICAL' when toxic = 1 then 'HIGH' else 'MEDIUM' end as severity, case when toxic = 1 and quality = 0 then 'FAIL' else 'REVIEW' end as status, case when toxic = 1 then 0.9 else 0.6 end::double as confidence, 'Data Integrity Anomaly: ' || doc_id as title, case when toxic = 1 then 'label flip suspected' else 'duplicate or ood content' end as reason, '2024-01-01' as ts, sha256(text) as evidence_hash from labels join documents using (doc_id) where toxic = 1 or quality = 0
union all select 'MODEL_INTEGRITY', 'ModelIntegrity', 'find-mi-', s_suppkey::varchar, case when s_acctbal < 0 then 'CRITICAL' when s_acctbal < 1500 then 'MEDIUM' else 'LOW' end, case when s_acctbal < 0 then 'FAIL' when s_acctbal < 1500 then 'REVIEW' else 'PASS' end, 0.8, 'Model Integrity Assessment: ' || s_suppkey, case when s_acctbal < 0 then 'trojan trigger' else 'clean' end, '2024-01-02', sha256(s_name) from supplier
union all select 'INFERENCE_PROVENANCE', 'InferenceProvenance', 'find-inf-', 'seal-' || c_custkey, case when c_custkey % 7 <> 0 and c_nationkey % 2 = 0 then 'LOW' else 'CRITICAL' end, case when c_custkey % 7 <> 0 and c_nationkey % 2 = 0 then 'PASS' else 'FAIL' end, 1.0, case when c_custkey % 7 <> 0 and c_nationkey % 2 = 0 then 'Inference Output Authenticity Verified: seal-' || c_custkey else 'Inference Tampering Detected: seal-' || c_custkey end,
 case when c_custkey % 7 <> 0 and c_nationkey % 2 = 0 then 'Cryptographic seal seal-' || c_custkey || ' verified. Model digest, input tensor hash, config, and output binding are authentic.' else 'Integrity violation on inference record seal-' || c_custkey || ': ' || concat_ws('; ', case when c_custkey % 7 = 0 then 'RFC-8785 canonical content hash mismatch (payload modified post-signing)' end, case when c_nationkey % 2 = 1 then 'Model digest substitution detected: d1 != expected d0' end) end, '2024-01-03', sha256(c_name) from customer
union all select 'DISTRIBUTION_SHIFT', 'DistributionShift', 'find-drift-', w, case a when 'OPERATIONAL_SHIFT_LIKELY' then 'MEDIUM' when 'UNEXPLAINED_SHIFT' then 'HIGH' else 'LOW' end, case a when 'NO_SIGNIFICANT_SHIFT' then 'PASS' when 'OPERATIONAL_SHIFT_LIKELY' then 'WARNING' when 'UNEXPLAINED_SHIFT' then 'REVIEW' else 'NOT_ASSESSED' end, case a when 'NO_SIGNIFICANT_SHIFT' then 0.9 else 0.75 end, 'Distribution Shift Assessment: ' || w || ' (' || a || ')',
 case a when 'NO_SIGNIFICANT_SHIFT' then printf('MMD statistic (%.6f) is within calibrated reference variation (threshold %.6f).', m, 0.16::double) when 'OPERATIONAL_SHIFT_LIKELY' then printf('Statistically significant distribution shift detected (MMD %.6f > %.6f), correlated with operational lighting/sensor change.', m, 0.16::double) when 'UNEXPLAINED_SHIFT' then printf('Statistically significant distribution shift detected (MMD %.6f > %.6f) without clear operational sensor explanation.', m, 0.16::double) else 'Insufficient samples or calibration metadata to assess distribution drift.' end, strftime(ts, '%Y-%m-%d'), sha256(props)
 from (select *, 'w' || event_id as w, round(value, 2) / 1000 as m, case when event_id % 11 = 0 then 'INSUFFICIENT_EVIDENCE' when round(value, 2) / 1000 <= 0.16 then 'NO_SIGNIFICANT_SHIFT' when user_id % 2 = 0 then 'OPERATIONAL_SHIFT_LIKELY' else 'UNEXPLAINED_SHIFT' end as a from events)),
findings as (select prefix || substr(sha256(asset_id), 1, 12) as finding_id, category, asset_id, status, severity, confidence, case when confidence >= 0.8 then 'HIGH' when confidence >= 0.5 then 'MEDIUM' else 'LOW' end as interpretation, title, reason, ts, module_name, evidence_hash, null::varchar as signature,
case when status = 'FAIL' or severity = 'CRITICAL' then 'QUARANTINE' when status in ('REVIEW', 'WARNING', 'NOT_ASSESSED') or severity in ('HIGH', 'MEDIUM') then 'REVIEW' else 'ACCEPT' end as disposition,
case when status = 'FAIL' or severity = 'CRITICAL' then 'URGENT' when status in ('REVIEW', 'WARNING') or severity in ('HIGH', 'MEDIUM') then 'ELEVATED' else 'ROUTINE' end as priority from raw),
placed as (select *, case when disposition = 'QUARANTINE' or status = 'FAIL' or severity = 'CRITICAL' then 'critical' when status = 'WARNING' then 'warning' when status = 'REVIEW' then 'review' when status = 'NOT_ASSESSED' then 'not_assessed' else 'pass' end as place from findings)"""


@query(f"with {_FINDINGS} select * from findings")
def finding_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@query(f"""with {_FINDINGS}, n as (select 'run-' || (ascii(category) % 2) as run, 'findings' as part, count(*) as n from findings group by 1 union all select 'run-' || (n_regionkey % 2), 'checks', count(*) from nation group by 1
union all select 'run-' || (r_regionkey % 2), 'coverage', count(*) from region group by 1 union all select 'run-' || (user_id % 2), 'events', count(*) from events group by 1)
select run as assessment_id, case run when 'run-1' then 'TAMPERED' else 'VALID' end as verdict, sum(ceil(n / 1000))::bigint + case run when 'run-1' then 0 else 1 end as parts from n group by 1""")
def report_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two assessments written as documents and verified from their texts; one has lost its first page of events."""
    run = lambda number: F.concat(F.lit("run-"), number % 2).alias("assessment_id")
    found = _findings(spark, sf_dir).withColumn("assessment_id", run(F.ascii("category")))
    checks = table(spark, sf_dir, "nation").select(run(F.col("n_regionkey")), F.col("n_nationkey").alias("check_id"), F.lit("AUDIT").alias("category"), F.col("n_name").alias("name"), F.lit("Nations").alias("module"), F.lit("PASS").alias("status"))
    coverage = table(spark, sf_dir, "region").select(run(F.col("r_regionkey")), F.lit("capability").alias("kind"), F.col("r_name").alias("name"), F.lit("SUPPORTED").alias("support_status"), F.lit(1).alias("n"))
    rows = profile.placed(table(spark, sf_dir, "events").select(run(F.col("user_id")), "event_id", "ts", "event_type", "user_id", "props"), "assessment_id", "ts", "event_id")
    events = rows.select("assessment_id", F.col("__place").alias("sequence_index"), text.iso_utc("ts").alias("timestamp"), "event_type", F.concat(F.lit("user-"), "user_id").alias("actor"), F.array(F.col("event_id").cast("string")).alias("reference_ids"), F.create_map(F.lit("props"), "props").alias("data"))
    runs = checks.select("assessment_id", F.lit("2024-01-01T00:00:00Z").alias("assessment_timestamp")).distinct()
    documents = report.assemble(runs, found, checks, coverage, report.audit_events(events))
    kept = documents.filter("not (assessment_id = 'run-1' and part = 'events' and page = 0)")
    return report.verify(kept).select("assessment_id", "verdict", "parts")


@query(f"with {_FINDINGS} select finding_id, severity from findings where severity = 'HIGH' and lower(reason || title || module_name) like '%flip%'")
def finding_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.search(_findings(spark, sf_dir), "FLIP", "HIGH").select("finding_id", "severity")


@query(f"""with {_FINDINGS}, o as (select category, count(*) filter (where place = 'critical') as critical, count(*) filter (where place = 'warning') as warning, count(*) filter (where place = 'review') as review, count(*) filter (where place = 'pass') as pass, count(*) filter (where place = 'not_assessed') as not_assessed from placed group by 1)
select *, case when critical > 0 then 'FAIL' when review + warning > 0 then 'REVIEW' when not_assessed > 0 then 'PASS_WITH_LIMITATIONS' else 'PASS' end as overall_status, case when critical > 0 then 'QUARANTINE' when review + warning > 0 then 'REVIEW' else 'ACCEPT' end as disposition from o""")
def overall_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.overall(_findings(spark, sf_dir), "category")


@query(f"with {_FINDINGS}, t as (select category, finding_id, case place when 'critical' then 'CRITICAL integrity failure on ' || asset_id || ': ' || title when 'warning' then 'Warning on ' || asset_id || ': ' || title when 'review' then 'Review required on ' || asset_id || ': ' || title when 'not_assessed' then 'Unassessed check: ' || title end as t from placed) select category, array_to_string(list(t order by finding_id, t)[1:15], '|') as basis from t where t is not null group by 1")
def verdict_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.verdict_basis(_findings(spark, sf_dir), "category").withColumn("basis", F.array_join("basis", "|"))


_COVERED = """covered as (select 'capability' as kind, name, finding_id from findings, (values ('Label Anomaly & Flip Detection', 'DATA_INTEGRITY'), ('Near-Duplicate Flooding Detection', 'DATA_INTEGRITY'), ('Out-of-Distribution Insertion Detection', 'DATA_INTEGRITY'), ('Distribution Shift & Drift Monitoring', 'DATA_INTEGRITY'), ('Model Trojan & Backdoor Inversion', 'MODEL_INTEGRITY'), ('Model Substitution & Tamper Detection', 'MODEL_INTEGRITY'), ('Inference Output Sealing & Provenance', 'INFERENCE_PROVENANCE'), ('Inference Replay Detection', 'INFERENCE_PROVENANCE'), ('Distribution Shift & Drift Monitoring', 'DISTRIBUTION_SHIFT')) c(name, cat) where category = cat
union all select 'attack', name, finding_id from findings, (values ('DUPLICATE_FLOODING', 'duplicate'), ('LABEL_FLIPPING', 'flip'), ('OUT_OF_DISTRIBUTION_INSERTION', 'ood'), ('TRIGGER_INJECTION', 'trigger'), ('BACKDOOR_BEHAVIOUR', 'trojan'), ('INFERENCE_TAMPERING', 'tamper|seal'), ('DISTRIBUTION_SHIFT', 'shift')) a(name, word) where regexp_matches(lower(reason), word)),
known as (select * from (values ('capability', 'Label Anomaly & Flip Detection', 'PARTIALLY_SUPPORTED'), ('capability', 'Near-Duplicate Flooding Detection', 'PARTIALLY_SUPPORTED'), ('capability', 'Out-of-Distribution Insertion Detection', 'PARTIALLY_SUPPORTED'), ('capability', 'Training Data Trigger Patch Detection', 'PARTIALLY_SUPPORTED'), ('capability', 'Model Trojan & Backdoor Inversion', 'PARTIALLY_SUPPORTED'), ('capability', 'Model Substitution & Tamper Detection', 'SUPPORTED'), ('capability', 'Inference Output Sealing & Provenance', 'SUPPORTED'), ('capability', 'Inference Replay Detection', 'SUPPORTED'), ('capability', 'Distribution Shift & Drift Monitoring', 'SUPPORTED'), ('capability', 'Contributor & Provenance Risk Aggregation', 'PARTIALLY_SUPPORTED'),
('attack', 'LABEL_FLIPPING', 'PARTIALLY_SUPPORTED'), ('attack', 'SYSTEMATIC_MISLABELING', 'PARTIALLY_SUPPORTED'), ('attack', 'DUPLICATE_FLOODING', 'PARTIALLY_SUPPORTED'), ('attack', 'OUT_OF_DISTRIBUTION_INSERTION', 'PARTIALLY_SUPPORTED'), ('attack', 'TRIGGER_INJECTION', 'PARTIALLY_SUPPORTED'), ('attack', 'BACKDOOR_BEHAVIOUR', 'PARTIALLY_SUPPORTED'), ('attack', 'MODEL_SUBSTITUTION', 'SUPPORTED'), ('attack', 'MODEL_MODIFICATION', 'SUPPORTED'), ('attack', 'INFERENCE_TAMPERING', 'SUPPORTED'), ('attack', 'INFERENCE_REPLAY', 'SUPPORTED'), ('attack', 'DISTRIBUTION_SHIFT', 'SUPPORTED'), ('attack', 'CONTRIBUTOR_RISK_AGGREGATION', 'PARTIALLY_SUPPORTED'), ('attack', 'ADVERSARIAL_EVASION_PATCH', 'UNSUPPORTED'), ('attack', 'MODEL_EXTRACTION_STEALING', 'UNSUPPORTED')) k(kind, name, support_status))"""


@query(f"with {_FINDINGS}, {_COVERED} select kind, name, support_status, count(finding_id) as n, coalesce(array_to_string(list_sort(list(finding_id) filter (where finding_id is not null))[1:100], ','), '') as finding_ids from known left join covered using (kind, name) group by all")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.coverage(_findings(spark, sf_dir)).withColumn("finding_ids", F.array_join("finding_ids", ","))


@query(f"with {_FINDINGS}, {_COVERED} select 'find-unassessed-' || substr(sha256(kind || '|' || name), 1, 8) as finding_id, kind as category, 'NOT_ASSESSED' as status, 'Assessment Not Performed: ' || name as title, 'REVIEW' as disposition from known where (kind, name) not in (select kind, name from covered)")
def unassessed_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = governance.coverage(_findings(spark, sf_dir)).filter("n = 0").select(F.col("kind").alias("category"), F.col("name").alias("capability"), F.lit("no finding").alias("reason"), F.lit("an executed check").alias("required_access"))
    return governance.unassessed(skipped).select("finding_id", "category", "status", "title", "disposition")


@query(f"with {_FINDINGS} select finding_id, asset_id, disposition, priority from findings where disposition <> 'ACCEPT'")
def open_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.open_recommendations(_findings(spark, sf_dir))


@query(f"with {_FINDINGS} select module_name, count(*) as n, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity))] as max_severity from findings group by 1")
def threats_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threats_by_module(_findings(spark, sf_dir), "module_name", "severity")


@query(f"with {_FINDINGS} select count(*) as total, count(*) filter (where severity in ('HIGH', 'CRITICAL')) as grave, count(*) filter (where disposition = 'QUARANTINE') as quarantined, count(distinct asset_id) as assets, count(*) filter (where module_name = 'DistributionShift') as drift_events, count(*) filter (where module_name in ('DataIntegrity', 'ModelIntegrity') and severity in ('HIGH', 'CRITICAL')) as integrity_alerts, 0::bigint as committed, round(count(*) filter (where disposition <> 'ACCEPT') / count(*), 4) as anomaly_rate from findings")
def findings_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overview(_findings(spark, sf_dir))


@query(f"with {_FINDINGS}, c as (select m.module_name, count(f.finding_id) as n, count(*) filter (where severity in ('HIGH', 'CRITICAL')) as grave from (values ('DataIntegrity'), ('ModelIntegrity'), ('DistributionShift')) m(module_name) left join findings f using (module_name) group by 1), t as (select module_name, n, case when module_name = 'ModelIntegrity' and grave > 0 then 'FAIL' when n > 0 then 'WARNING' else 'PASS' end as status from c) select *, case status when 'FAIL' then 'QUARANTINE' when 'WARNING' then 'REVIEW' else 'ACCEPT' end as disposition from t")
def module_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.module_trust(_findings(spark, sf_dir))


@query(f"with {_FINDINGS}, m as (select * from findings where module_name = 'ModelIntegrity') select arg_min(asset_id, (disposition <> 'QUARANTINE', ts, finding_id)) as asset_id, case when count(*) filter (where disposition = 'QUARANTINE') > 0 then 'QUARANTINE_RECOMMENDED' when count(*) > 0 then 'REVIEW' else 'NO_MODEL_SCAN' end as status, case when count(*) filter (where disposition = 'QUARANTINE') > 0 then 'CRITICAL' when count(*) > 0 then 'UNKNOWN' else 'NOT_ASSESSED' end as risk, count(*) as n, count(*) filter (where disposition = 'QUARANTINE') as quarantined from m")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.model_summary(_findings(spark, sf_dir).filter("module_name = 'ModelIntegrity'"))


@query(f"""with {_FINDINGS}, f as (select *, 'c' || length(title) % 5 as contributor_id from findings), h as (select evidence_hash as k, min((finding_id, asset_id, contributor_id)) as f from f where evidence_hash <> '' group by 1), a as (select asset_id as k, min((finding_id, asset_id, contributor_id)) as f from f group by 1),
e as (select o_orderkey as tx_id, case when o_orderkey % 3 = 0 then (select sha256(s_name) from supplier where s_suppkey = o_custkey % 10 + 1) end as evidence_hash, 'w' || o_custkey as ledger_key, case when o_orderkey % 5 = 0 then 'own' end as contributor_id from orders)
select tx_id, coalesce(h.f[1], a.f[1]) as finding_id, coalesce(h.f[2], a.f[2], ledger_key) as asset_id, coalesce(e.contributor_id, h.f[3], a.f[3]) as contributor_id from e left join h on h.k = e.evidence_hash left join a on a.k = e.ledger_key""")
def ledger_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir).withColumn("contributor_id", F.concat(F.lit("c"), F.length("title") % 5))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.sha2("s_name", 256).alias("h"))
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 10 + 1).join(suppliers, "k", "left")
    entries = orders.select(F.col("o_orderkey").alias("tx_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("h")).alias("evidence_hash"), F.concat(F.lit("w"), "o_custkey").alias("ledger_key"), F.lit(None).cast("string").alias("finding_id"), F.lit(None).cast("string").alias("asset_id"), F.when(F.col("o_orderkey") % 5 == 0, "own").alias("contributor_id"))
    return findings.journal(entries, found).select("tx_id", "finding_id", "asset_id", "contributor_id")


@query("""with j as (select l_orderkey * 10 + l_linenumber as job_id, l_suppkey as d, l_partkey as m, case when l_linenumber = 1 then 'n1' end as named from lineitem), k as (select job_id, named, case when s_nationkey = 0 then null else 'n' || s_nationkey end as a, 'n' || p_size % 25 as b from j left join supplier on s_suppkey = d left join part on p_partkey = m)
select case when a <> b then 'assets of different contributors' when named <> coalesce(a, b) then 'not the contributor of the assets' end as conflict, count(*) as n, count(distinct coalesce(named, a, b, 'unassigned')) as contributors from k group by 1""")
def attribution_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("job_id"), F.concat(F.lit("d"), "l_suppkey").alias("dataset_id"), F.concat(F.lit("m"), "l_partkey").alias("model_id"), F.when(F.col("l_linenumber") == 1, "n1").alias("contributor_id"))
    datasets = table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), "s_suppkey").alias("asset_id"), F.when(F.col("s_nationkey") == 0, "unassigned").otherwise(F.concat(F.lit("n"), "s_nationkey")).alias("contributor_id"))
    owned = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), "p_partkey").alias("asset_id"), F.concat(F.lit("n"), F.col("p_size") % 25).alias("contributor_id"))
    return findings.attribution_conflicts(jobs, datasets.unionByName(owned)).groupBy("conflict").agg(F.count("*").alias("n"), F.count_distinct("contributor_id").alias("contributors"))


@query("""with e as (select event_type, 29 - floor((epoch(timestamp '2024-01-31 00:00:00') - epoch(ts)) / 86400)::int as bucket from events where ts <= timestamp '2024-01-31 00:00:00'), s as (select event_type, unnest(range(0, 30))::int as bucket from (select distinct event_type from events))
select bucket, event_type, count(e.event_type) as n from s left join e using (bucket, event_type) group by all""")
def activity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.activity_series(table(spark, sf_dir, "events"), "ts", "event_type", "2024-01-31 00:00:00", 30, 86400)


@query("""with a as (select case when o_totalprice > 300000 then 'unassigned' else o_custkey::varchar end as contributor, o_orderstatus as kind from orders), c as (select contributor, kind, count(*) as n from a group by all)
select * from c union all select c_custkey::varchar, 'none', 0 from customer where c_custkey::varchar not in (select contributor from c)""")
def contributor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") <= 300000, F.col("o_custkey")).alias("contributor"), F.col("o_orderstatus").alias("kind"))
    return reports.contributor_counts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contributor")), assets, "contributor", "kind")


@query(f"""with {_FINDINGS}, a as (select c_custkey::varchar as asset_id, 1 as turn, 'n' || c_nationkey as contributor_id from customer where c_custkey % 2 = 0 union all select (c_custkey + 1)::varchar, 2, 'n' || c_nationkey from customer where c_custkey % 2 = 0), m as (select asset_id, arg_min(contributor_id, (turn, contributor_id)) as contributor_id from a group by 1)
select finding_id, coalesce(contributor_id, 'unassigned') as contributor_id from findings left join m using (asset_id)""")
def finding_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("upload_id"), (F.col("c_custkey") + 1).alias("dataset_id"), F.lit(None).cast("long").alias("model_id"), F.concat(F.lit("n"), "c_nationkey").alias("contributor_id"))
    return findings.with_contributor(_findings(spark, sf_dir), assets).select("finding_id", "contributor_id")


# ---- models


_NORMS = "n as (select p_brand as model_id, p_size as class, sum(p_retailprice) as x from part group by all)"
_MAD = f"{_NORMS}, a as (select model_id, median(x) as m from n group by 1), b as (select model_id, m, median(abs(x - m)) as mad from n join a using (model_id) group by all), i as (select model_id, class, case when mad > 0 then round(greatest(0, m - x) / (1.4826 * mad), 4) else 0 end as i from n join b using (model_id)), mad as (select model_id, max(i) as max_index, arg_min(class, (-i, class)) as top_class, max(i) > 2 as flagged from i group by 1)"


def _mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model_id"), F.col("p_size").alias("class")).agg(F.sum("p_retailprice").alias("x"))
    return models.mad_index(norms, "model_id", "class", "x")


@query(f"with {_MAD} select model_id, round(max_index, 3) as max_index, top_class, flagged from mad")
def mad_index_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mad(spark, sf_dir).withColumn("max_index", F.round("max_index", 3))


_ENTROPY = """q as (select vec_id % 3 as class, label as model_id, vec_id % 5 as donor, case vec_id % 2 when 0 then 'real' else 'control' end as condition, list_transform(embedding::double[], lambda x: exp(4 * x)) as e from embeddings), p as (select *, list_transform(e, lambda x: x / list_sum(e)) as p from q),
u as (select model_id, class, donor, condition, unnest(p) as p, unnest(range(len(p))) as pos from p), m as (select model_id, class, donor, condition, pos, avg(p) as p from u group by all), h as (select model_id, class, donor, condition, -sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12))) as h from m group by all)"""


def _deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: 4 * x)
    queries = table(spark, sf_dir, "embeddings").select(F.col("label").alias("model_id"), (F.col("vec_id") % 3).alias("class"), (F.col("vec_id") % 5).alias("donor"), F.when(F.col("vec_id") % 2 == 0, "real").otherwise("control").alias("condition"), vectors.softmax(scaled).alias("probs"))
    return models.entropy_deficit(queries)


@query(f"with {_ENTROPY} select model_id, class, round(avg(h) filter (where condition = 'real'), 4) as real, round(avg(h) filter (where condition = 'control'), 4) as control, round(avg(h) filter (where condition = 'control') - avg(h) filter (where condition = 'real'), 4) as deficit from h group by all")
def entropy_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deficits(spark, sf_dir)


@query(f"""with {_MAD}, d as (select distinct p_brand as model_id, (length(p_brand) + ascii(right(p_brand, 1))) % 50 + 1 as deficit_class from part), v as (select *, top_class = deficit_class as agree from mad join d using (model_id))
select model_id, case when not flagged then 'ACCEPT' when agree then 'QUARANTINE' else 'REVIEW' end as verdict, case when not flagged then 'LOW' when agree then 'CRITICAL' else 'MEDIUM' end as severity, round(round(case when not flagged then least(0.5, max_index / 2) when agree then greatest(least(1, max_index / 5), 0.85) else least(1, max_index / 5) * 0.6 end, 4), 3) as confidence from v""")
def model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model_id")).distinct().withColumn("deficit_class", (F.length("model_id") + F.ascii(F.expr("right(model_id, 1)"))) % 50 + 1)
    return models.verdicts(_mad(spark, sf_dir), other).withColumn("confidence", F.round("confidence", 3))


@query("""with e as (select 'm' || l_suppkey % 7 as model_id, case l_linestatus when 'O' then 'BGR' else 'RGB' end as o, (l_quantity > 25)::int as predicted, case when l_suppkey % 7 < 5 then (case when l_suppkey % 7 < 3 then l_quantity > 22 else l_discount > 0.03 end)::int end as truth, l_tax as entropy from lineitem),
g as (select model_id, count(truth) as labelled, avg((predicted = truth)::int) filter (where o = 'RGB') * 100 as ar, avg((predicted = truth)::int) filter (where o = 'BGR') * 100 as ab, avg(entropy) filter (where o = 'RGB') as er, avg(entropy) filter (where o = 'BGR') as eb, count(distinct predicted) filter (where o = 'RGB') as kr, count(distinct predicted) filter (where o = 'BGR') as kb from e group by 1),
m as (select distinct 'm' || s_suppkey % 9 as model_id from supplier)
select model_id, case when labelled is null then 'TIER_D' when labelled > 0 then 'TIER_A' else 'TIER_C' end as tier, round(case when labelled > 0 then ar when labelled = 0 then er end, 4) as rgb, round(case when labelled > 0 then ab when labelled = 0 then eb end, 4) as bgr, kr as classes_rgb, kb as classes_bgr,
case when labelled is null then 'N/A' when labelled = 0 then (case when kr <= 1 and kb <= 1 then 'UNCERTAIN' when kb <= 1 then 'RGB' when kr <= 1 then 'BGR' when eb < er then 'BGR' else 'RGB' end) when ab > ar then 'BGR' when ar > ab or greatest(ar, ab) >= 70 then 'RGB' else 'UNCERTAIN' end as chosen,
case when labelled is null then 'CALIBRATION_IMPOSSIBLE' when labelled > 0 and greatest(ar, ab) < 70 then 'CALIBRATION_FAILED' when labelled = 0 and kr <= 1 and kb <= 1 then 'CALIBRATION_UNCERTAIN' else 'OK' end as status from m left join g using (model_id)""")
def channel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with a good, a poor and no labelled log, and without any log."""
    number = F.col("l_suppkey") % 7
    truth = F.when(number < 3, F.col("l_quantity") > 22).when(number < 5, F.col("l_discount") > 0.03)
    log = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), number).alias("model_id"), F.when(F.col("l_linestatus") == "O", "BGR").otherwise("RGB").alias("order"), (F.col("l_quantity") > 25).cast("int").alias("predicted"), truth.cast("int").alias("truth"), F.col("l_tax").alias("entropy"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey") % 9).alias("model_id"))
    return models.channel_order(log, known).withColumns({"rgb": F.round("rgb", 4), "bgr": F.round("bgr", 4)})


# ---- recurring patterns and streams


@query()
def recurring_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return patterns.find(patterns.segments(rows, "vec_id", "label", "embedding", 4), 0.8, 2)


@query("""with e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from events), w as (select *, unnest(range(greatest(0, ceil((i - 9) / 5))::bigint, least(floor(i / 5), floor((n - 10) / 5))::bigint + 1)) as window_no from e)
select user_id::varchar as key, window_no, string_agg(event_id::varchar, ',' order by i) as items from w group by all""")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = streams.count_windows(streams.read_stream(spark, sf_dir, "events"), "user_id", "event_id", "ts", drift.Windows(10, 5))
    return streams.drained(done, shared_folder(spark)).select("key", "window_no", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("select user_id || '-' || props as nonce, event_id as item from events qualify row_number() over (partition by user_id || '-' || props order by ts, event_id) > 1")
def streaming_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streams.read_stream(spark, sf_dir, "events").withColumn("nonce", F.concat_ws("-", F.col("user_id").cast("string"), "props"))
    return streams.drained(streams.replays(events, "nonce", "event_id", "ts", "400 days"), shared_folder(spark)).select("nonce", "item")


# ---- text functions


@query("""select s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, 'asset-' || substr(sha256(s_name), 1, 12) as short_id from supplier""")
def supplier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.slug(F.col("s_name")).alias("slug"), text.short_id("asset-", F.col("s_name")).alias("short_id"))
