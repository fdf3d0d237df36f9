"""Coverage, timelines, probes, exports and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.hashing import loose_hash
from mergeloom.functions.session import table
from mergeloom.sources.sinks import csv_lines, manifest


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, distinct texts, languages, those with a label and their share."""
    docs, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(1))
    own = docs.select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("sha")).join(lab, "doc_id", "left")
    got = own.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("sha").alias("distinct_texts"), F.count_distinct("lang").alias("langs"), F.count("labelled").alias("labelled"), F.sum("n_chars").cast("long").alias("chars"), F.max("n_chars").alias("longest"))
    return got.withColumn("share", F.round(F.col("labelled") / F.col("docs"), 6))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per month: orders read, worked out and unknown."""
    o = table(spark, sf_dir, "orders").where(F.year("o_orderdate") >= 1990)
    s = F.col("o_orderstatus")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_if(s == "F").alias("read"), F.count_if(s == "O").alias("worked"), F.count_if(~s.isin("F", "O")).alias("unknown"))


def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: counts, value sums, first and last, and the first after the tenth day."""
    e = table(spark, sf_dir, "events")
    late = F.min(F.when(F.dayofmonth("ts") > 10, F.col("event_id")))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_if(F.col("value") > 250).alias("large"), F.count_distinct("user_id").alias("users"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), late.alias("first_late")).orderBy(F.desc("n"), "event_type")


def status_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by what is only known from one kind of event."""
    e = table(spark, sf_dir, "events").select("user_id", F.concat_ws("/", "user_id", F.to_date("ts").cast("string")).alias("item"), "event_type")
    of = lambda t: e.where(F.col("event_type") == t).select("item").distinct()
    only_sidecar = of("purchase").join(of("click"), "item", "left_anti").join(of("view"), "item", "left_anti")
    only_name = of("signup").join(e.where("event_type <> 'signup' and event_type <> 'error'").select("item").distinct(), "item", "left_anti")
    only_mtime = of("error").join(e.where("event_type <> 'error'").select("item").distinct(), "item", "left_anti")
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first_item")).select(F.lit(n).alias("probe"), "*")
    return one(only_sidecar, "only sidecar").unionByName(one(only_name, "only filename")).unionByName(one(only_mtime, "mtime only"))


def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven counts in one pass."""
    d = table(spark, sf_dir, "documents")
    c = [F.count(F.lit(1)).alias("files"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "fr").alias("fr"), F.count_if(F.col("lang") == "de").alias("de"), F.count_if(F.col("lang") == "es").alias("es"), F.count_if(F.col("n_chars") > 5000).alias("long"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_if(F.col("source") == "src0").alias("main"), F.count_distinct("source").alias("sources"), F.sum("n_chars").cast("long").alias("chars"), F.count_if(F.contains(F.col("text"), F.lit("@"))).alias("with_at")]
    return d.agg(*c)


def recent_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six places set last."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, sf_dir, "events").select(F.round(k / 7, 5).alias("lat"), F.round((F.col("user_id") % 10) / 3.0, 5).alias("lon"), "event_id")
    return e.groupBy("lat", "lon").agg(F.max("event_id").alias("set_at"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("set_at")).limit(6)


def decision_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the filters that a person browses by, and those with a duplicate line."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    dup = li.where("l_linenumber > 4").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("dup", F.lit(True))
    own = o.join(dup, "o_orderkey", "left")
    inferred = F.forall(F.split(F.concat_ws(" · ", F.lit("neighbour"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("clock + UTC")), F.when(F.col("o_orderkey") % 7 == 0, F.lit("camera"))), " · "), lambda p: p.isin("neighbour", "device") | p.startswith("clock + "))
    return own.agg(F.count_if(F.col("o_orderpriority").like("%URGENT")).alias("estimated"), F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("no_zone"), F.count_if(F.col("dup")).alias("duplicates"), F.count_if(inferred).alias("inferred"), F.count(F.lit(1)).alias("everything"))


def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six pages whose url or target holds a needle."""
    p = table(spark, sf_dir, "pages").withColumn("target", F.concat(F.lit("out/"), F.col("page_id").cast("string"), F.lit("/fr")))
    return p.where(F.contains("url", F.lit("/fr/")) | F.contains("target", F.lit("/9"))).orderBy("page_id").select("page_id", "url", "target").limit(6)


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", loose_hash(F.col("text")).alias("h"), F.concat(F.when(F.col("doc_id") % 4 == 0, "=").otherwise("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    role = F.when(F.col("doc_id") == F.col("group_id"), "canonical").when(F.col("doc_id") % 5 == 0, "companion").when(F.col("doc_id") % 5 == 1, "variant").otherwise("duplicate")
    return d.join(first, "h").select("group_id", "doc_id", "path", role.alias("role"), "n")


_ROLES = r"""
d AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h, CASE WHEN doc_id % 4 = 0 THEN '=' ELSE '/' END || source || '/' || doc_id AS path FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS group_id, count(*) OVER (PARTITION BY h) AS n FROM d),
r AS (SELECT group_id, doc_id, path, n, CASE WHEN doc_id = group_id THEN 'canonical' WHEN doc_id % 5 = 0 THEN 'companion' WHEN doc_id % 5 = 1 THEN 'variant' ELSE 'duplicate' END AS role FROM g)
"""


def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group with copies: what is kept and all others' paths, sorted and joined by line breaks."""
    own = _roles(spark, sf_dir).where("n > 1")
    others = F.array_join(F.sort_array(F.collect_list(F.when(F.col("role") != "canonical", F.col("path")))), "\n")
    return own.groupBy("group_id").agg(F.min(F.when(F.col("role") == "canonical", F.col("path"))).alias("kept"), others.alias("duplicates"), F.count(F.lit(1)).alias("n"))


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as lines of CSV, safe to open in a spreadsheet."""
    return csv_lines(export_records(spark, sf_dir), ["group_id", "kept", "duplicates", "n"], ["kept", "duplicates"])


def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as nested JSON by role."""
    return manifest(_roles(spark, sf_dir).where("n > 1"))


def attention_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for a person, with a signature of what it is about."""
    own = _roles(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    # a sum of hashes, which no order of rows changes and no task gathers
    sign = lambda c: F.sum(F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    variants = own.where("role = 'variant'").agg(F.lit("variants").alias("card"), F.count(F.lit(1)).alias("n"), sign(F.col("doc_id")).alias("signature"))
    unread = docs.where("n_chars < 100").agg(F.lit("unreadable").alias("card"), F.count(F.lit(1)).alias("n"), sign(F.col("doc_id")).alias("signature"))
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("c")).where("c < 51").agg(F.lit("sources").alias("card"), F.count(F.lit(1)).alias("n"), sign(F.col("source")).alias("signature"))
    return variants.unionByName(unread).unionByName(sources).where("n > 0")


def day_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of clocks that move a photo to another day, by how far they move it."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", ((F.col("user_id") % 5 - 2) * 3).alias("hours"))
    moved = F.to_date(F.expr("ts + make_interval(0, 0, 0, 0, cast(hours as int), 0, 0)")) != F.to_date("ts")
    return e.groupBy("hours").agg(F.count(F.lit(1)).alias("n"), F.count_if(moved).alias("day_changes"))


QUERIES = {f.__name__: f for f in (coverage_report, timeline, source_summary, status_probes, scoreboard, recent_places, decision_filters, path_search, export_records, export_csv, manifest_json, attention_cards, day_changes)}
_OTHERS = r"x AS (SELECT group_id, min(CASE WHEN role = 'canonical' THEN path END) AS kept, coalesce(string_agg(CASE WHEN role <> 'canonical' THEN path END, chr(10) ORDER BY path), '') AS duplicates, count(*)::BIGINT AS n FROM r WHERE n > 1 GROUP BY group_id)"
SQL = {
    "coverage_report": """
SELECT source, count(*)::BIGINT AS docs, count(DISTINCT sha256(text))::BIGINT AS distinct_texts, count(DISTINCT lang)::BIGINT AS langs, count(l.doc_id)::BIGINT AS labelled, sum(n_chars)::BIGINT AS chars, max(n_chars)::BIGINT AS longest, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS share FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source
""",
    "timeline": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS read, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS worked, count(*) FILTER (o_orderstatus NOT IN ('F', 'O'))::BIGINT AS unknown FROM orders WHERE year(o_orderdate) >= 1990 GROUP BY 1",
    "source_summary": "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total, count(*) FILTER (value > 250)::BIGINT AS large, count(DISTINCT user_id)::BIGINT AS users, min(event_id) AS first_id, max(event_id) AS last_id, min(event_id) FILTER (day(ts) > 10) AS first_late FROM events GROUP BY event_type",
    "status_probes": """
WITH i AS (SELECT user_id || '/' || ts::DATE::VARCHAR AS item, list(DISTINCT event_type) AS k FROM events GROUP BY 1)
SELECT 'only sidecar' AS probe, count(*)::BIGINT AS n, min(item) AS first_item FROM i WHERE list_contains(k, 'purchase') AND NOT list_contains(k, 'click') AND NOT list_contains(k, 'view')
UNION ALL SELECT 'only filename', count(*), min(item) FROM i WHERE list_contains(k, 'signup') AND NOT list_has_any(k, ['click', 'view', 'purchase']) UNION ALL SELECT 'mtime only', count(*), min(item) FROM i WHERE k = ['error']
""",
    "scoreboard": "SELECT count(*)::BIGINT AS files, count(*) FILTER (lang = 'en')::BIGINT AS en, count(*) FILTER (lang = 'fr')::BIGINT AS fr, count(*) FILTER (lang = 'de')::BIGINT AS de, count(*) FILTER (lang = 'es')::BIGINT AS es, count(*) FILTER (n_chars > 5000)::BIGINT AS long, count(*) FILTER (n_chars < 200)::BIGINT AS short, count(*) FILTER (source = 'src0')::BIGINT AS main, count(DISTINCT source)::BIGINT AS sources, sum(n_chars)::BIGINT AS chars, count(*) FILTER (contains(text, '@'))::BIGINT AS with_at FROM documents",
    "recent_places": "SELECT round((props->>'$.k')::DOUBLE / 7, 5) AS lat, round((user_id % 10) / 3.0::DOUBLE, 5) AS lon, max(event_id) AS set_at, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 ORDER BY set_at DESC LIMIT 6",
    "decision_filters": "SELECT count(*) FILTER (o_orderpriority LIKE '%URGENT')::BIGINT AS estimated, count(*) FILTER (o_orderstatus NOT IN ('F', 'O'))::BIGINT AS no_zone, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 4))::BIGINT AS duplicates, count(*) FILTER (o_orderkey % 7 <> 0)::BIGINT AS inferred, count(*)::BIGINT AS everything FROM orders",
    "path_search": "SELECT page_id, url, 'out/' || page_id || '/fr' AS target FROM pages WHERE contains(url, '/fr/') OR contains('out/' || page_id || '/fr', '/9') ORDER BY page_id LIMIT 6",
    "export_records": f"WITH {_ROLES}, {_OTHERS} SELECT * FROM x",
    "export_csv": f"""
WITH {_ROLES}, {_OTHERS}, s AS (SELECT group_id, n, CASE WHEN kept[1] IN ('=', '+', '-', '@') THEN '''' || kept ELSE kept END AS k, CASE WHEN duplicates[1] IN ('=', '+', '-', '@') THEN '''' || duplicates ELSE duplicates END AS d FROM x)
SELECT group_id || ',' || CASE WHEN regexp_matches(k, '[",\r\n]') THEN '"' || replace(k, '"', '""') || '"' ELSE k END || ',' || CASE WHEN regexp_matches(d, '[",\r\n]') THEN '"' || replace(d, '"', '""') || '"' ELSE d END || ',' || n || chr(13) || chr(10) AS line FROM s
""",
    "manifest_json": f"""
WITH {_ROLES}, j AS (SELECT group_id, min(CASE WHEN role = 'canonical' THEN path END) AS keep, list(path ORDER BY path) FILTER (role = 'companion') AS c, list(path ORDER BY path) FILTER (role = 'duplicate') AS d, list(path ORDER BY path) FILTER (role = 'variant') AS v FROM r WHERE n > 1 GROUP BY group_id)
SELECT group_id, '{{"keep":"' || keep || '","companions":' || CASE WHEN c IS NULL THEN '[]' ELSE '["' || array_to_string(c, '","') || '"]' END || ',"drop":' || CASE WHEN d IS NULL THEN '[]' ELSE '["' || array_to_string(d, '","') || '"]' END || ',"review":' || CASE WHEN v IS NULL THEN '[]' ELSE '["' || array_to_string(v, '","') || '"]' END || '}}' AS manifest FROM j
""",
    "attention_cards": f"""
WITH {_ROLES}, s AS (SELECT source FROM documents GROUP BY source HAVING count(*) < 51), c AS (SELECT 'variants' AS card, count(*)::BIGINT AS n, sum(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT)::VARCHAR AS signature FROM r WHERE role = 'variant'
UNION ALL SELECT 'unreadable', count(*), sum(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT)::VARCHAR FROM documents WHERE n_chars < 100 UNION ALL SELECT 'sources', count(*), sum(('0x' || substr(md5(source), 1, 15))::BIGINT)::VARCHAR FROM s) SELECT * FROM c WHERE n > 0
""",
    "day_changes": "SELECT (user_id % 5 - 2) * 3 AS hours, count(*)::BIGINT AS n, count(*) FILTER ((ts + to_hours((user_id % 5 - 2) * 3))::DATE <> ts::DATE)::BIGINT AS day_changes FROM events GROUP BY 1",
}
