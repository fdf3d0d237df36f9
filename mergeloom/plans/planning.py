"""Plans and gates over orders and line items: orders stand in for items, line items for members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mergeloom.functions.session import table
from mergeloom.operators import planning as L


def target_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each order would be written; orders of one day collide and are numbered."""
    o = table(spark, sf_dir, "orders").withColumn("local", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")))
    got = L.target_paths(o, "o_orderkey", F.col("local"), F.lit(".jpg"), F.col("o_orderkey") % 4 != 0)
    return got.select("o_orderkey", "path")


def rescan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two listings."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/a/"), F.col("o_orderkey").cast("string")).alias("path"), F.floor("o_totalprice").alias("size"), (F.col("o_orderkey") * 1.5).alias("mtime"))
    old = o.where("o_orderkey % 7 <> 0")
    new = o.where("o_orderkey % 5 <> 0").withColumn("size", F.col("size") + F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0)).withColumn("mtime", F.col("mtime") + F.when(F.col("o_orderkey") % 13 == 0, 1.0).otherwise(0.25))
    return L.rescan(old, new).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def trash_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items after an order's first as duplicates: which may go, and what blocks the others."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"), F.when(F.col("l_orderkey") % 6 != 0, F.col("l_orderkey")).alias("keeper"))
    dec = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("verified_at"))
    return L.trash_gate(li, dec).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("first_id"))


def manifest_retire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows whose file is no longer kept: re-attached by content or dropped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.md5((F.col("o_custkey") % 700).cast("string")).alias("sha"))
    return L.retire(o.where("file_id % 4 = 0"), o.where("file_id % 12 <> 4"), o.where("file_id % 3 = 0")).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("now").cast("long").alias("check_sum"))


def superseded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each further line item of an order with the first one, role against role."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    first = li.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("k"))
    own = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max("l_partkey").alias("part"))
    return own.join(first, "l_orderkey").where(F.col("l_linenumber") > F.col("k.l_linenumber")).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "part", F.col("k.l_partkey").alias("keeper_part"), "n")


def six_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star of six tables: revenue by the regions of customer and supplier."""
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o, c, s = t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_nationkey"), t("supplier").select("s_suppkey", "s_nationkey")
    n, r = t("nation").select("n_nationkey", "n_regionkey"), t("region")
    place = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    cp, sp = place.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("customer_region")), place.select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("supplier_region"))
    full = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(cp, "c_nationkey").join(sp, "s_nationkey")
    return full.groupBy("customer_region", "supplier_region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rev"), 2).alias("revenue"))


def other_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers of one nation and balance class seen from either side."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 20).alias("b"))
    pairs = c.select(F.col("c_custkey").alias("x"), "c_nationkey", "b").join(c.select(F.col("c_custkey").alias("y"), "c_nationkey", "b"), ["c_nationkey", "b"]).where("x < y").select("x", "y")
    both = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("me"), F.col("y").alias("other")), F.struct(F.col("y").alias("me"), F.col("x").alias("other")))).alias("p")).select("p.*")
    return both.groupBy("me").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first_other"))


def latest_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of each customer's orders, as the override that counts."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return L.latest(o, ["o_custkey"], "o_orderkey")


def space_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes still to write: kept orders without a verified copy, with two per cent and a gigabyte to spare."""
    o = table(spark, sf_dir, "orders")
    done = o.where("o_orderstatus = 'F'").select("o_orderkey")
    return o.join(done, "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("files"), F.sum(F.floor("o_totalprice")).cast("long").alias("bytes")).select("files", "bytes", F.floor(F.col("bytes") * 1.02 + 1e9).cast("long").alias("needed"))


def undo_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which written files may be undone: still identical, and their sources there."""
    o = table(spark, sf_dir, "orders")
    now = o.where("o_orderkey % 9 <> 0").select("o_orderkey", F.md5(F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(""))).alias("now"))
    met = o.select("o_orderkey", "o_custkey", F.md5("o_orderstatus").alias("written")).join(now, "o_orderkey", "left").join(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("source")), "o_custkey", "left")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("written"), "changed").when(F.col("source").isNull(), "source gone").otherwise("undo")
    return met.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def write_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written line items whose content isn't what was planned, by ship mode of flag and status."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.md5(F.concat_ws("|", "l_partkey", "l_suppkey")).alias("planned"))
    back = li.withColumn("planned", F.when(F.col("l_orderkey") % 50 == 0, F.lit("other")).otherwise(F.col("planned"))).where("l_orderkey % 33 <> 0").withColumnRenamed("planned", "got").drop("l_returnflag").dropDuplicates(["l_orderkey", "l_linenumber", "got"])
    met = li.dropDuplicates(["l_orderkey", "l_linenumber", "planned"]).join(back.withColumn("planned", F.col("got")), ["l_orderkey", "l_linenumber", "planned"], "left")
    return met.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("written"), F.count_if(F.col("got").isNull()).alias("failed"))


def destination_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that contain a destination or lie in it, after their paths are made canonical."""
    n = table(spark, sf_dir, "nation")
    src = n.select("n_nationkey", F.concat(F.lit("/data/./r"), F.col("n_regionkey").cast("string"), F.lit("/x/../"), F.col("n_name"), F.lit("/")).alias("p")).select("n_nationkey", L.canonical_root(F.col("p")).alias("source"))
    dst = table(spark, sf_dir, "region").select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("/data/r"), F.col("r_regionkey").cast("string"))).otherwise(F.concat(F.lit("/data/r"), F.col("r_regionkey").cast("string"), F.lit("/NATION_"), F.col("r_regionkey").cast("string"), F.lit("/out"))).alias("target"))
    return src.join(F.broadcast(dst), L.reachable(F.col("target"), F.col("source"))).select("n_nationkey", "r_regionkey", "source", "target")  # the five regions are a fixed list


def tidy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates that may be moved away: not inside a library, not moved before; with what that frees."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    path = F.concat(F.when(F.col("l_suppkey") % 10 == 0, F.lit("/p/My.photoslibrary/")).otherwise(F.lit("/p/")), F.col("l_orderkey").cast("string"))
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return li.where(~F.contains(path, F.lit(".photoslibrary/"))).join(gone, "l_orderkey", "left_anti").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("frees"))


def stale_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that a stored result credits to a choice that no longer exists."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    credited = o.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select("day").distinct()
    picks = o.where("o_orderpriority = '2-HIGH'").select("day").distinct()
    return credited.join(picks, "day", "left_anti").select(F.col("day").cast("string").alias("day"))


def acknowledged_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that are open: those whose present signature isn't the acknowledged one."""
    o = table(spark, sf_dir, "orders")
    now = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(F.col("o_orderpriority").alias("kind"), F.col("n").cast("string").alias("signature"))
    known = o.where("o_orderkey % 2 = 0 or o_orderpriority < '3'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(F.col("o_orderpriority").alias("kind"), F.col("n").cast("string").alias("signature"))
    return now.join(known, ["kind", "signature"], "left_anti")


def bulk_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs after every undecided one was marked as different, by decision."""
    c = table(spark, sf_dir, "customer")
    pairs = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    decided = pairs.where("a % 6 = 0").withColumn("same", F.lit(True))
    rest = pairs.join(decided, ["a", "b"], "left_anti").withColumn("same", F.lit(False))
    return decided.unionByName(rest).groupBy("same").agg(F.count(F.lit(1)).alias("n"))


def name_bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files within an item: an edit's suffix, and numbers for equal names."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("a"), F.when(F.col("l_returnflag") == "R", "_edited").otherwise(""), F.lit(".jpg")).alias("name"))
    w = Window.partitionBy("l_orderkey", "name").orderBy("l_linenumber", "l_partkey")
    k = F.row_number().over(w) - 1
    return li.withColumn("k", k).groupBy("name", F.when(F.col("k") > 0, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise("").alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        target_plan, rescan_diff, trash_gate, manifest_retire, superseded_links, six_way_join, other_side, latest_override, space_estimate, undo_eligibility, write_verification, destination_checks, tidy_plan, stale_choices,
        acknowledged_cards, bulk_decision, name_bumps,
    )
}
SQL = {
    "target_plan": """
WITH b AS (SELECT o_orderkey, o_orderdate AS d, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y%m%d_%H%M%S') || CASE WHEN o_orderkey % 4 <> 0 THEN '' ELSE 'Z' END END AS base FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) - 1 AS k FROM b)
SELECT o_orderkey, CASE WHEN base IS NULL THEN 'undated/asset_' || lpad(o_orderkey::VARCHAR, greatest(6, length(o_orderkey::VARCHAR))::INTEGER, '0') || '.jpg' ELSE strftime(d, '%Y/%m/') || base || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.jpg' END AS path FROM k
""",
    "rescan_diff": """
WITH o AS (SELECT o_orderkey AS k, '/a/' || o_orderkey AS path, floor(o_totalprice)::BIGINT AS s, o_orderkey * 1.5 AS m FROM orders), a AS (SELECT * FROM o WHERE k % 7 <> 0),
b AS (SELECT path, s + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS s, m + CASE WHEN k % 13 = 0 THEN 1.0 ELSE 0.25 END AS m FROM o WHERE k % 5 <> 0)
SELECT CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'gone' WHEN a.s <> b.s OR abs(a.m - b.m) > 0.5 THEN 'changed' ELSE 'same' END AS change, count(*)::BIGINT AS n, min(coalesce(a.path, b.path)) AS first_path FROM a FULL JOIN b ON a.path = b.path GROUP BY 1
""",
    "trash_gate": """
WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS file_id, CASE WHEN l_orderkey % 6 <> 0 THEN l_orderkey END AS keeper FROM lineitem WHERE l_linenumber > 1)
SELECT CASE WHEN keeper IS NULL THEN 'no keeper' WHEN o_orderkey IS NULL THEN 'keeper undecided' WHEN o_orderstatus <> 'F' THEN 'keeper unverified' ELSE 'eligible' END AS reason, count(*)::BIGINT AS n, min(file_id)::BIGINT AS first_id FROM d LEFT JOIN orders ON o_orderkey = keeper AND o_orderstatus <> 'P' GROUP BY 1
""",
    "manifest_retire": """
WITH o AS (SELECT o_orderkey AS k, md5((o_custkey % 700)::VARCHAR) AS sha FROM orders), m AS (SELECT * FROM o WHERE k % 4 = 0), f AS (SELECT sha, min(k) AS other FROM o WHERE k % 3 = 0 AND k % 4 <> 0 GROUP BY sha)
SELECT CASE WHEN k % 12 <> 4 THEN 'kept' WHEN other IS NOT NULL THEN 'reattached' ELSE 'dropped' END AS state, count(*)::BIGINT AS n, sum(CASE WHEN k % 12 <> 4 THEN k ELSE other END)::BIGINT AS check_sum FROM m LEFT JOIN f USING (sha) GROUP BY 1
""",
    "superseded_links": """
WITH f AS (SELECT l_orderkey, l_linenumber AS ln, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem),
g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, max(l_partkey) AS part FROM lineitem GROUP BY ALL)
SELECT g.l_orderkey, g.l_linenumber::BIGINT AS l_linenumber, g.part, f.l_partkey AS keeper_part, g.n::BIGINT AS n FROM g JOIN f ON f.l_orderkey = g.l_orderkey AND f.k = 1 AND g.l_linenumber > f.ln
""",
    "six_way_join": """
SELECT cr.r_name AS customer_region, sr.r_name AS supplier_region, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey GROUP BY ALL
""",
    "other_side": """
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, floor(c_acctbal / 20) AS b FROM customer), p AS (SELECT x.k AS x, y.k AS y FROM c x JOIN c y ON x.n = y.n AND x.b = y.b AND x.k < y.k), s AS (SELECT x AS me, y AS other FROM p UNION ALL SELECT y, x FROM p)
SELECT me, count(*)::BIGINT AS n, min(other) AS first_other FROM s GROUP BY me
""",
    "latest_override": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
    "space_estimate": "WITH b AS (SELECT count(*)::BIGINT AS files, sum(floor(o_totalprice))::BIGINT AS bytes FROM orders WHERE o_orderstatus <> 'F') SELECT files, bytes, floor(bytes * 1.02::DOUBLE + 1e9)::BIGINT AS needed FROM b",
    "undo_eligibility": """
SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'missing' WHEN o_orderkey % 10 = 0 THEN 'changed' WHEN c_custkey IS NULL THEN 'source gone' ELSE 'undo' END AS state, count(*)::BIGINT AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 GROUP BY 1
""",
    "write_verification": """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, first_value(l_returnflag) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_returnflag) AS f FROM lineitem)
SELECT f AS l_returnflag, count(*)::BIGINT AS written, count(*) FILTER (l_orderkey % 50 = 0 OR l_orderkey % 33 = 0)::BIGINT AS failed FROM l GROUP BY f
""",
    "destination_checks": """
WITH s AS (SELECT n_nationkey, '/data/r' || n_regionkey || '/' || n_name AS source FROM nation), d AS (SELECT r_regionkey, '/data/r' || r_regionkey || CASE WHEN r_regionkey % 2 = 0 THEN '' ELSE '/NATION_' || r_regionkey || '/out' END AS target FROM region)
SELECT n_nationkey, r_regionkey, source, target FROM s JOIN d ON starts_with(target || '/', source || '/') OR starts_with(source || '/', target || '/')
""",
    "tidy_plan": "SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS frees FROM lineitem WHERE l_linenumber > 1 AND l_suppkey % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P') GROUP BY l_returnflag",
    "stale_choices": "SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day FROM orders c WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderpriority = '2-HIGH' AND p.o_orderdate::DATE = c.o_orderdate::DATE)",
    "acknowledged_cards": """
WITH n AS (SELECT o_orderpriority AS kind, count(*)::VARCHAR AS signature FROM orders GROUP BY 1), k AS (SELECT o_orderpriority AS kind, count(*)::VARCHAR AS signature FROM orders WHERE o_orderkey % 2 = 0 OR o_orderpriority < '3' GROUP BY 1)
SELECT kind, signature FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.kind = n.kind AND k.signature = n.signature)
""",
    "bulk_decision": "SELECT c_custkey % 6 = 0 AS same, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1",
    "name_bumps": """
WITH n AS (SELECT 'a' || CASE WHEN l_returnflag = 'R' THEN '_edited' ELSE '' END || '.jpg' AS name, row_number() OVER (PARTITION BY l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END ORDER BY l_linenumber, l_partkey) - 1 AS k FROM lineitem)
SELECT name, CASE WHEN k > 0 THEN '_' || k ELSE '' END AS suffix, count(*)::BIGINT AS n FROM n GROUP BY ALL
""",
}
