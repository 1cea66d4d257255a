"""Run audit, manifests, nested differences and fact sheets, over records made from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadrille.fixtures import table
from quadrille.operators import records
from quadrille.operators.shared import shared_dir
from quadrille.plans.base import query
from quadrille.sources.records import dotted


@query("select n_nationkey as name, sha256('content of ' || n_name || chr(10)) as sha256 from nation")
def h01_file_digests(spark, sf):
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.concat(F.lit("content of "), "n_name").alias("value"))
    rows.repartition("name").write.partitionBy("name").text(path)
    found = records.digests(spark, path).filter("size > 0 and path like '%.txt'")
    return found.select(F.regexp_extract("path", r"name=(\d+)/", 1).cast("int").alias("name"), "sha256")


#: A file a part; every fifth changed its size, every seventh its time, since the manifest was made.
_FILES = "select concat('/data/', p_brand, '/', p_partkey) as path, p_size * 1000 + case when p_partkey % 5 = 0 then 1 else 0 end as size, case when p_partkey % 7 = 0 then 2 else 1 end as modified, p_partkey % 3 as grp from part"
_KNOWN = "select concat('/data/', p_brand, '/', p_partkey) as path, p_size * 1000 as size, 1 as modified, concat('sha', p_partkey) as sha256, p_partkey % 3 as grp from part where p_partkey % 11 > 0"
_FRESH = "select concat('/data/', p_brand, '/', p_partkey) as path, concat('new', p_partkey) as sha256 from part"


def _view(spark, sf, sql: str):
    return spark.sql(sql.replace("from part", "from {part}"), part=table(spark, sf, "part"))


@query(f"with f as ({_FILES}), k as ({_KNOWN}) select f.path, k.sha256, k.sha256 is null as again from f left join k using (path, size, modified)")
def h02_reused_digests(spark, sf):
    found = records.reused(_view(spark, sf, _FILES), _view(spark, sf, _KNOWN))
    return found.select("path", "sha256", F.col("sha256").isNull().alias("again"))


@query(f"with f as ({_FILES}), k as ({_KNOWN}), n as ({_FRESH}) select f.path, f.size, case when k.sha256 is not null then k.sha256 when f.size < 40000 then n.sha256 end as sha256, case when k.sha256 is not null then 'kept' when f.size >= 40000 then 'large' else 'read' end as origin from f left join k using (path, size, modified) left join n on n.path = f.path")
def h03_manifest(spark, sf):
    """Files of 40,000 bytes or more that changed aren't read."""
    return records.manifest(_view(spark, sf, _FILES), _view(spark, sf, _KNOWN), _view(spark, sf, _FRESH), 40_000)


_OLD = "select concat('/data/', p_brand, '/', p_partkey) as path, p_partkey % 3 as grp, concat('sha', p_partkey) as sha256, p_size as size from part"
_NEW = "select concat('/data/', p_brand, '/', p_partkey) as path, case when p_partkey % 6 = 0 then 9 else p_partkey % 3 end as grp, concat('sha', case when p_partkey % 5 = 0 then 0 else p_partkey end) as sha256, p_size + case when p_partkey % 10 = 0 then 1 else 0 end as size from part where p_partkey % 13 > 1"
_THERE = "select concat('/data/', p_brand, '/', p_partkey) as path from part where p_partkey % 13 <> 1"


@query(f"with o as ({_OLD}), n as ({_NEW}), t as ({_THERE}), b as (select o.path, o.grp, o.sha256 as s0, o.size as z0, n.path is not null as found, n.grp as g1, n.sha256 as s1, n.size as z1, t.path is not null as there from o left join n on n.path = o.path left join t on t.path = o.path), r as (select path, grp, case when not found then case when there then 'uncovered' else 'gone' end when s0 <> s1 or z0 <> z1 or grp <> g1 then 'changed' end as state, case when found then concat_ws(',', case when s0 <> s1 then 'sha256' end, case when z0 <> z1 then 'size' end, case when grp <> g1 then 'grp' end) else '' end as fields from b) select * from r where state is not null")
def h04_manifest_changes(spark, sf):
    found = records.manifest_changes(_view(spark, sf, _OLD), _view(spark, sf, _NEW), _view(spark, sf, _THERE))
    return found.withColumn("fields", F.array_join("fields", ","))


_ENTRIES = "select concat('/data/', p_brand, '/', p_partkey % 150) as path, p_partkey % 3 as grp, p_size % 3 as size, case when p_partkey % 4 = 0 then 'other' else 'data' end as root, concat(p_brand, '/', p_partkey % 150) as rest from part"
_ON_DISK = "select concat('/data/', p_brand, '/', p_partkey % 150) as path, min(p_size % 3) as size from part where p_partkey % 9 > 0 group by 1"


@query(f"with e as ({_ENTRIES}), d as ({_ON_DISK}), c as (select path, grp, count(*) as n from e group by 1, 2), r as (select e.path, e.grp, concat_ws(',', case when n > 1 then 'repeated' end, case when d.path is null then 'absent' end, case when d.size <> e.size then 'size' end, case when root <> 'data' then 'root' end) as faults from e join c on c.path = e.path and c.grp = e.grp left join d on d.path = e.path) select distinct * from r where faults <> ''")
def h05_manifest_faults(spark, sf):
    roots = spark.createDataFrame([("data", "/data"), ("other", "/other")], "root string, folder string")
    found = records.manifest_faults(_view(spark, sf, _ENTRIES), _view(spark, sf, _ON_DISK), roots)
    return found.withColumn("faults", F.array_join("faults", ","))


@query("with p as (select concat('/', p_brand, '/', replace(p_type, ' ', '/'), '/', p_partkey) as path from part), r as (select distinct concat('/', p_brand) as folder from part where p_partkey % 2 = 0 union select distinct concat('/', p_brand, '/', split_part(p_type, ' ', 1)) from part where p_partkey % 3 = 0), b as (select path, arg_max(folder, length(folder)) as folder from p join r on starts_with(path, folder || '/') group by 1) select p.path, coalesce(b.folder, 'FS') as root, case when b.folder is null then ltrim(p.path, '/') else substr(p.path, length(b.folder) + 2) end as rest from p left join b on b.path = p.path")
def h06_longest_root(spark, sf):
    parts = table(spark, sf, "part")
    paths = parts.select(F.concat(F.lit("/"), "p_brand", F.lit("/"), F.replace(F.col("p_type"), F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    one = parts.filter("p_partkey % 2 = 0").select(F.concat(F.lit("/"), "p_brand").alias("folder"))
    two = parts.filter("p_partkey % 3 = 0").select(F.concat(F.lit("/"), "p_brand", F.lit("/"), F.split_part(F.col("p_type"), F.lit(" "), F.lit(1))).alias("folder"))
    return records.longest_root(paths, one.union(two).distinct().select(F.col("folder").alias("root"), "folder"))


@query("with c as (select c_custkey as id, c_acctbal as x, c_nationkey as n from customer) select id, (case when id % 3 = 0 then 1 else 0 end) + (case when id % 4 = 0 then 1 else 0 end) + (case when id % 5 = 0 then 1 else 0 end) as differing, 4 as numbers, round(case when id % 3 = 0 then 0.5::double else 0.0::double end, 6) as max_abs from c")
def h07_deep_differences(spark, sf):
    """Nested records whose numbers, keys and texts differ by the customer's number."""
    rows = table(spark, sf, "customer")
    of = lambda shift, more, note: F.to_json(F.struct(F.struct((F.col("c_acctbal") + shift).alias("x"), F.col("c_nationkey").alias("n")).alias("run"), F.array(F.lit(1), F.lit(2)).alias("list"), note.alias("note"), F.struct(F.lit(True).alias("flag"), more.alias("extra")).alias("meta")))
    left = rows.select(F.col("c_custkey").alias("id"), of(F.lit(0.0), F.lit(None).cast("int"), F.lit("a")).alias("record"))
    extra = F.when(F.col("c_custkey") % 4 == 0, 1)
    right = rows.select(F.col("c_custkey").alias("id"), of(F.when(F.col("c_custkey") % 3 == 0, 0.5).otherwise(0.0), extra, F.when(F.col("c_custkey") % 5 == 0, "b").otherwise("a")).alias("record"))
    return records.deep_differences(left, right, "id", "record").withColumn("max_abs", F.round("max_abs", 6))


@query("with n as (select n_nationkey as note, sha256(n_name) as sha256 from nation) select a.note, case when a.note % 6 <> 0 then case when a.note % 5 = 0 then repeat('0', 64) else b.sha256 end end as cites, case when a.note % 6 <> 0 and a.note % 5 <> 0 then b.note end as predecessor from n a left join n b on b.note = a.note - 1")
def h08_chained_notes(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("note"), F.sha2("n_name", 256).alias("sha256"))
    before = rows.select((F.col("note") + 1).alias("note"), F.col("sha256").alias("cited"))
    said = F.when(F.col("note") % 6 == 0, "stands alone").when(F.col("note") % 5 == 0, F.concat(F.lit("after "), F.repeat(F.lit("0"), 64))).otherwise(F.concat(F.lit("after sha256 "), "cited", F.lit(".")))
    return records.chained(rows.join(before, "note", "left").withColumn("text", F.coalesce(said, F.lit(""))).select("note", "sha256", "text"))


_AUDIT = {
    "no_status": "o_orderstatus = 'P'", "no_price": "o_totalprice <= 0", "urgent_open": "o_orderpriority = '1-URGENT' and o_orderstatus = 'O'", "no_lines": "n is null", "few_lines": "n < 2",
    "many_lines": "n > 6", "no_customer": "c_custkey is null", "in_debt": "c_acctbal < 0", "returned": "n_returned > 0", "discounted": "most_discount > 0.09",
}
_AUDITED = "a as (select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, n, c_custkey, c_acctbal, n_returned, most_discount from orders left join (select l_orderkey, count(*) as n, count(*) filter (where l_returnflag = 'R') as n_returned, max(l_discount) as most_discount from lineitem group by 1) on l_orderkey = o_orderkey left join customer on c_custkey = o_custkey)"


@query(f"with {_AUDITED} select o_orderkey as run, concat_ws(',', " + ", ".join(f"case when {c} then '{n}' end" for n, c in _AUDIT.items()) + ") as failures from a")
def h09_run_audit(spark, sf):
    """Every failed check of a run by name, not the first alone."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.max("l_discount").alias("most_discount"))
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").join(customers, orders["o_custkey"] == customers["c_custkey"], "left")
    return rows.select(F.col("o_orderkey").alias("run"), F.array_join(records.failed({n: F.expr(c) for n, c in _AUDIT.items()}), ",").alias("failures"))


@query("with e as (select event_id as id, cast(json_extract_string(props, '$.k') as int) as k, user_id, event_type from events) select id, concat_ws(',', case when k % 7 = 0 then 'config.seed' end, case when event_type = 'view' then 'dataset.file' end) as missing, k % 5 <> 0 as same_digest, case when k % 7 = 0 or event_type = 'view' or k % 5 = 0 then 'blocks' when user_id % 2 = 0 then 'attention' else 'ok' end as verdict from e")
def h10_run_card(spark, sf):
    """Required fields by dotted path, the digest as declared against the one found, and what follows from both."""
    k = F.get_json_object("props", "$.k").cast("int")
    record = F.to_json(F.struct(F.struct(F.when(k % 7 != 0, k).alias("seed")).alias("config"), F.struct(F.when(F.col("event_type") == "view", "").otherwise("f").alias("file"), F.sha2(k.cast("string"), 256).alias("sha256")).alias("dataset")))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", record.alias("record"), F.sha2(F.when(k % 5 == 0, "other").otherwise(k.cast("string")), 256).alias("found"))
    missing = records.failed({p: F.coalesce(dotted(F.col("record"), p), F.lit("")) == "" for p in ("config.seed", "dataset.file")})
    same = dotted(F.col("record"), "dataset.sha256") == F.col("found")
    verdict = F.when((F.size(missing) > 0) | ~same, "blocks").when(F.col("user_id") % 2 == 0, "attention").otherwise("ok")
    return rows.select("id", F.array_join(missing, ",").alias("missing"), same.alias("same_digest"), verdict.alias("verdict"))


@query(
    "with r as (select c_mktsegment as grp, c_nationkey as nation, c_acctbal as balance, case when c_mktsegment = 'BUILDING' then 3 else c_custkey % 4 end as epochs from customer), v as (select grp, 'nation' as name, cast(nation as double) as x from r union all select grp, 'balance', balance from r union all select grp, 'epochs', epochs from r) select grp, name, case when count(distinct x) = 1 then min(x) end as one, "
    + ", ".join(f"case when count(distinct x) > 1 then {f} end as {n}" for f, n in (("min(x)", "least"), ("round(quantile_cont(x, 0.5), 6)", "middle"), ("max(x)", "most")))
    + " from v group by 1, 2"
)
def h12_parameter_sheet(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_mktsegment as grp", "c_nationkey as nation", "c_acctbal as balance", "case when c_mktsegment = 'BUILDING' then 3 else c_custkey % 4 end as epochs")
    return records.sheet(rows, "grp", ["nation", "balance", "epochs"]).withColumn("middle", F.round("middle", 6))


@query("with e as (select event_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k from events) select 'largest k' as fact, cast(max(k) as varchar) as value from e union all select 'first event of the largest k', cast(arg_max(event_id, k * 1000000 - event_id) as varchar) from e union all select 'event types', cast(count(distinct event_type) as varchar) from e union all select 'k of event 0', cast(max(k) filter (where event_id = 0) as varchar) from e")
def h13_fact_sheet(spark, sf):
    """Named facts by JSON path: a value, an extreme and where it stands, a count."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    facts = {
        "largest k": F.max(k), "first event of the largest k": F.max_by("event_id", k * 1_000_000 - F.col("event_id")),
        "event types": F.count_distinct("event_type"), "k of event 0": F.max(F.when(F.col("event_id") == 0, k)),
    }
    one = table(spark, sf, "events").agg(*[x.cast("string").alias(n) for n, x in facts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("fact"), F.col(n).alias("value")) for n in facts])).alias("f")).select("f.*")
