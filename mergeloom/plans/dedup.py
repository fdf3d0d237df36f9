"""Identity: exact and near duplicates, the cascade, components, survivors, roles and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mergeloom.functions.components import connected_components
from mergeloom.functions.hashing import hamming, loose_hash, sign_hash, simhash
from mergeloom.functions.session import table
from mergeloom.operators.cascade import deviation, mean_difference, recording_outcome, shrink, strict_outcome, worst_tile
from mergeloom.operators.similarity import hamming_edges, hamming_join
from mergeloom.operators.survivors import elect, exact_edges, guarded_edges, in_band

RADII = (0, 2, 4, 6, 8)
#: Recordings of one duration, about, that meet as many others in one group of a join.
FRAME_BLOCK = 512


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", "n_chars").join(simhash(docs, "doc_id", "text"), "doc_id")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of byte-identical texts: survivor (least id), size and bytes that dropping the others frees."""
    docs = table(spark, sf_dir, "documents")
    return (
        docs.groupBy(F.sha2(F.col("text"), 256).alias("sha"))
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"), F.sum("n_chars").alias("total"), F.min("n_chars").alias("one"))
        .select("sha", "keep_id", "copies", (F.col("total") - F.col("one")).cast("long").alias("recoverable"))
    )


def guarded_pixel_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of texts that are equal but for case and space, unless their moments (here: sources) exclude each other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", loose_hash(F.col("text")).alias("pixel"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("moment"))
    return guarded_edges(docs, "doc_id", "pixel", "moment").select(F.col("v").alias("doc_id"), F.col("u").alias("linked_to"))


def hamming_join_r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of texts whose similarity hashes differ in at most four bits."""
    return hamming_join(_hashed(spark, sf_dir), "doc_id", "simhash", 4, 60).select("a", "b", F.col("distance").cast("long").alias("distance"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", sign_hash(F.col("embedding"), 63).alias("h"))


def embedding_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors whose sign hashes differ in at most 12 of 63 bits."""
    return hamming_join(_signed(spark, sf_dir), "vec_id", "h", 12, 63).select("a", "b", F.col("distance").cast("long").alias("distance"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signed(spark, sf_dir).select("vec_id", "h", "embedding", shrink(F.col("embedding"), 16, 4).alias("small"), deviation(F.col("embedding")).alias("dev"), F.when(F.col("vec_id") % 4 != 0, F.col("label")).alias("moment"))
    pairs = hamming_join(rows, "vec_id", "h", 14, 63)
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in rows.columns]) for s in "ab")
    both = pairs.join(a, F.col("a") == F.col("vec_id_a")).join(b, F.col("b") == F.col("vec_id_b"))
    both = both.withColumn("hi", mean_difference(F.col("embedding_a"), F.col("embedding_b"))).withColumn("lo", mean_difference(F.col("small_a"), F.col("small_b"))).withColumn("tile", worst_tile(F.col("embedding_a"), F.col("embedding_b"), 4, 16))
    flat = (F.col("dev_a") < 0.12) | (F.col("dev_b") < 0.12)
    return both.withColumn("outcome", strict_outcome(F.col("moment_a"), F.col("moment_b"), F.lit(None).cast("double"), F.lit(None).cast("double"), flat, F.col("hi"), F.col("lo"), 0.06, 0.095))


def cascade_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each candidate pair of vectors, with the differences at both resolutions and of the worst tile."""
    r = lambda c: F.round(c, 6).alias(c)
    return _judged(spark, sf_dir).select("a", "b", F.col("distance").cast("long").alias("distance"), r("hi"), r("lo"), r("tile"), "outcome")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs by distance and verdict: how far the radius may be opened."""
    return _judged(spark, sf_dir).groupBy(F.col("distance").cast("long").alias("distance"), "outcome").agg(F.count(F.lit(1)).alias("pairs"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _hashed(spark, sf_dir)
    roots = connected_components(hamming_edges(hashed, "doc_id", "simhash", 4, 60, ["lang"]).select("u", "v"))
    return hashed.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "lang", "source", "n_chars", F.coalesce("root", "doc_id").alias("group_id"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each text: connected over confirmed pairs (at most four bits apart, one language); its least id names it."""
    return _grouped(spark, sf_dir).select("doc_id", "group_id")


_TOKENS = r"""
tok AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents),
hw AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM tok WHERE w <> ''),
bitsum AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM hw, (SELECT unnest(range(60))::INTEGER AS b) GROUP BY doc_id, b),
sim AS (SELECT doc_id, sum(CASE WHEN s > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS simhash FROM bitsum GROUP BY doc_id),
"""
_PAIRS = """p AS (SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.simhash, y.simhash))::BIGINT AS distance FROM sim x JOIN sim y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.simhash, y.simhash)) <= 8),"""
_COMPONENTS = """
e AS (SELECT a AS u, b AS v FROM conf UNION SELECT b, a FROM conf),
r AS (SELECT doc_id AS node, doc_id AS label FROM sim UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.node),
g AS (SELECT node AS doc_id, min(label) AS group_id FROM r GROUP BY node)
"""
_CONF = "conf AS (SELECT a, b FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE distance <= 4 AND x.lang = y.lang),"


def group_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How groups came about: single, one content, one look, or similar; with the largest of each kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), loose_hash(F.col("text")).alias("pixel"))
    own = _grouped(spark, sf_dir).join(docs, "doc_id").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sha").alias("shas"), F.count_distinct("pixel").alias("pixels"))
    method = F.when(F.col("n") == 1, "single").when(F.col("shas") == 1, "exact").when(F.col("pixels") == 1, "same image").otherwise("similar")
    return own.groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").cast("long").alias("members"), F.max("n").alias("longest"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in groups of one loose hash, with stand-ins for what elections look at."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    own = docs.select(
        "doc_id", "n_chars", loose_hash(F.col("text")).alias("group_id"), F.sha2("text", 256).alias("sha"), F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("priority"),
        F.when(F.col("lang") == "en", 3).when(F.col("lang") == "fr", 2).otherwise(1).cast("long").alias("tier"),
    )
    return own.join(labels, "doc_id", "left")


_MEMBERS = r"""
lab AS (SELECT doc_id, max(quality)::BIGINT AS quality FROM labels GROUP BY doc_id),
m AS (SELECT d.doc_id, n_chars, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS group_id, sha256(text) AS sha, regexp_extract(source, '(\d+)$', 1)::BIGINT AS priority,
  CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END AS tier, quality FROM documents d LEFT JOIN lab USING (doc_id)),
w AS (SELECT *, n_chars >= max(n_chars) OVER (PARTITION BY group_id) * 0.98 AS in_band, count(*) OVER (PARTITION BY group_id) AS members FROM m)
"""


def canonical_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivor of each group: nearly the most pixels, best format, largest, first source, least hash."""
    own = in_band(_members(spark, sf_dir), "group_id", "n_chars")
    order = [~F.col("in_band"), -F.col("tier"), -F.col("n_chars"), F.col("priority"), F.col("sha"), F.col("doc_id")]
    return elect(own, "group_id", order, ["doc_id", "n_chars"])


def canonical_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivor of a burst: the sharpest of those with nearly the most pixels."""
    own = in_band(_members(spark, sf_dir), "group_id", "n_chars").where("in_band")
    order = [F.col("quality").isNull(), -F.col("quality"), F.col("priority"), F.col("doc_id")]
    return elect(own, "group_id", order, ["doc_id", "quality"])


def canonical_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivor of a group of recordings: most pixels, largest, last id."""
    return elect(_members(spark, sf_dir), "group_id", [-F.col("n_chars"), -F.col("tier"), -F.col("doc_id")], ["doc_id"])


def canonical_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivor by size and id, unless a person chose another by its content hash; with the runner-up and the reason."""
    own = _members(spark, sf_dir)
    keeper = own.where(F.col("doc_id") % 7 == 0).select("sha").distinct().withColumn("chosen", F.lit(True))
    own = own.join(keeper, "sha", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    w = Window.partitionBy("group_id").orderBy(F.desc("chosen"), F.desc("n_chars"), "doc_id")
    ranked = own.select("group_id", "doc_id", "chosen", "n_chars", F.row_number().over(w).alias("k"), F.lead("doc_id").over(w).alias("runner_up"), F.lead("n_chars").over(w).alias("next_chars"))
    reason = F.when(F.col("runner_up").isNull(), "only copy").when(F.col("chosen"), "chosen").when(F.col("n_chars") > F.col("next_chars"), "more pixels").otherwise("first id")
    return ranked.where("k = 1").select("group_id", "doc_id", "runner_up", reason.alias("reason"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of each member: canonical, burst sibling, variant (an edit) or duplicate, and the evidence for a duplicate."""
    own = _members(spark, sf_dir)
    keep = elect(own, "group_id", [-F.col("n_chars"), F.col("doc_id")], ["doc_id", "sha"]).select("group_id", F.col("doc_id").alias("keep_id"), F.col("sha").alias("keep_sha"))
    edited = F.col("doc_id") % 10 == 3
    role = F.when(F.col("doc_id") == F.col("keep_id"), "canonical").when((F.col("sha") != F.col("keep_sha")) & (F.col("quality") == 0), "burst_sibling").when((F.col("sha") != F.col("keep_sha")) & edited, "variant").otherwise("duplicate")
    why = F.when(F.col("doc_id") == F.col("keep_id"), F.lit("")).when(F.col("sha") == F.col("keep_sha"), "identical bytes").otherwise("identical pixels")
    return own.join(keep, "group_id").select("doc_id", "keep_id", role.alias("role"), why.alias("why"))


def radius_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each radius would do: pairs, texts merged away, longest chain. Pairs are found once, at the largest, and sliced."""
    edges = hamming_edges(_hashed(spark, sf_dir), "doc_id", "simhash", max(RADII), 60).cache()
    out = None
    for r in RADII:
        roots = connected_components(edges.where(F.col("distance") <= r).select("u", "v"))
        sizes = roots.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("n"))
        one = sizes.agg(F.count(F.lit(1)).alias("merged_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("merged_away"), F.coalesce(F.max("n"), F.lit(1)).cast("long").alias("longest")).select(F.lit(r).cast("long").alias("radius"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of its group beside each text that has copies."""
    own = _members(spark, sf_dir)
    sizes = own.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return own.join(sizes, "group_id").select("doc_id", "group_id", "size")


def weakest_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten groups that most deserve a look: by the least certain reason among their members, read from its text."""
    reason = F.when(F.col("doc_id") % 5 == 0, F.lit("flat picture, tiles agree")).when(F.col("doc_id") % 5 == 1, F.lit("geometry: 34 inliers")).otherwise(F.concat(F.lit("ssim 0."), F.lpad((F.col("n_chars") % 100).cast("string"), 2, "0")))
    own = _members(spark, sf_dir).withColumn("reason", reason)
    ssim = F.regexp_extract("reason", r"ssim (\d+\.\d+)", 1)
    risk = F.when(F.col("reason").contains("flat"), 0.0).when(F.col("reason").contains("geometry"), 0.1).when(ssim != "", ssim.cast("double")).otherwise(1.0)
    groups = own.groupBy("group_id").agg(F.min(risk).alias("risk"), F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("first_id")).where("members > 1")
    return groups.orderBy("risk", F.desc("members"), "first_id").limit(10)


def review_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least three and at most a third of twelve pairs per verdict, nearest first."""
    w = Window.partitionBy("outcome").orderBy("hi", "a", "b")
    return _judged(spark, sf_dir).select("outcome", "a", "b", F.row_number().over(w).cast("long").alias("k")).where("k <= greatest(3, 12 div 3)")


def human_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups after a person joined some texts outside any radius and parted others: a parted pair loses its own link only."""
    hashed = _hashed(spark, sf_dir)
    same = hashed.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("u"), (F.col("doc_id") + 1).alias("v")).join(hashed.select(F.col("doc_id").alias("v")), "v", "left_semi").select("u", "v")
    pairs = hamming_join(hashed, "doc_id", "simhash", 4, 60).where("(a + b) % 3 <> 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connected_components(pairs.unionByName(same))
    return hashed.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))


def exact_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups over equal bytes, then equal looks: the least id reachable over either hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), loose_hash(F.col("text")).alias("pixel"))
    roots = connected_components(exact_edges(docs, "doc_id", "sha", "pixel"))
    return docs.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))


def equal_durations(rows: DataFrame, block: int = FRAME_BLOCK) -> DataFrame:
    """All pairs of recordings (conv_id_a < conv_id_b) of one duration.

    A duration's recordings are dealt into blocks of about ``block``; each block meets each, so no group of the join holds a whole large duration."""
    sizes = rows.groupBy("duration").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = rows.join(sizes, "duration").withColumn("block", F.pmod(F.xxhash64("conv_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a, b = ([F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "duration"] for s in "ab")
    met = own.select("duration", F.col("block").alias("i"), every.alias("j"), *a).join(own.select("duration", every.alias("i"), F.col("block").alias("j"), *b), ["duration", "i", "j"])
    return met.where("conv_id_a < conv_id_b").drop("i", "j")


def frame_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on conversations as recordings: equal streams, else three frames (turns at 10, 50 and 90 %) compared bit by bit.

    Candidates are all pairs of one duration: durations are whole numbers, so none else are within the reference's 0.15. Conversations have no time of their own to bound
    candidates by."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    n = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    h = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")
    own = turns.join(n, "conv_id").where("turn in (floor(last * 0.1), floor(last * 0.5), floor(last * 0.9))")
    frames = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", h.alias("h")))).alias("f")).select("conv_id", F.transform("f", lambda x: x["h"]).alias("frames"))
    stream = turns.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "|")).alias("stream"), F.max("turn").alias("duration"))
    rows = frames.join(stream, "conv_id")
    pairs = equal_durations(rows)
    far = F.array_max(F.zip_with("frames_a", "frames_b", lambda x, y: hamming(x, y)))
    return pairs.select(F.col("conv_id_a").alias("a"), F.col("conv_id_b").alias("b"), far.cast("long").alias("farthest"), recording_outcome(F.col("stream_a"), F.col("stream_b"), F.col("frames_a"), F.col("frames_b"), 24).alias("outcome"))


_JUDGED = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS x, CASE WHEN vec_id % 4 <> 0 THEN label END AS moment,
  list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN 1::BIGINT << (i - 1)::INTEGER ELSE 0 END))::BIGINT AS h FROM embeddings),
s AS (SELECT *, list_transform(range(0, 16), lambda i: list_sum(x[i * 4 + 1 : i * 4 + 4]) / 4) AS small, sqrt(list_avg(list_transform(x, lambda y: y * y)) - list_avg(x) * list_avg(x)) AS dev FROM v),
j AS (SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::BIGINT AS distance, a.moment AS ma, b.moment AS mb, a.dev < 0.12 OR b.dev < 0.12 AS flat,
  list_sum(list_transform(range(1, 65), lambda i: abs(a.x[i] - b.x[i]))) / 64 AS hi,
  list_sum(list_transform(range(1, 17), lambda i: abs(a.small[i] - b.small[i]))) / 16 AS lo,
  list_max(list_transform(range(0, 4), lambda t: list_sum(list_transform(range(1, 17), lambda i: abs(a.x[t * 16 + i] - b.x[t * 16 + i]))) / 16)) AS tile
  FROM s a JOIN s b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 14),
o AS (SELECT *, CASE WHEN ma IS NOT NULL AND mb IS NOT NULL AND ma <> mb THEN 'burst' WHEN flat AND (ma IS NULL OR mb IS NULL) THEN 'unverifiable' WHEN hi - lo > 0.06 THEN 'reject' WHEN hi <= 0.095 THEN 'confirm' ELSE 'review' END AS outcome FROM j)
"""

QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup, guarded_pixel_dedup, hamming_join_r4, embedding_hamming, cascade_outcomes, calibration, components, group_methods, canonical_default, canonical_burst, canonical_video, canonical_override,
        roles, radius_sweep, cluster_sizes, weakest_merges, review_samples, human_decisions, exact_tiers, frame_match,
    )
}
SQL = {
    "exact_dedup": """
SELECT sha256(text) AS sha, min(doc_id)::BIGINT AS keep_id, count(*)::BIGINT AS copies, (sum(n_chars) - min(n_chars))::BIGINT AS recoverable
FROM documents GROUP BY sha256(text)
""",
    "guarded_pixel_dedup": r"""
WITH m AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS pixel, CASE WHEN doc_id % 3 <> 0 THEN source END AS moment FROM documents)
SELECT b.doc_id AS doc_id, min(a.doc_id) AS linked_to FROM m a JOIN m b ON a.pixel = b.pixel AND a.doc_id < b.doc_id AND (a.moment IS NULL OR b.moment IS NULL OR a.moment = b.moment) GROUP BY b.doc_id
""",
    "hamming_join_r4": f"WITH {_TOKENS} {_PAIRS} z AS (SELECT 1) SELECT a, b, distance FROM p WHERE distance <= 4",
    "embedding_hamming": """
WITH v AS (SELECT vec_id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN 1::BIGINT << (i - 1)::INTEGER ELSE 0 END))::BIGINT AS h FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 12
""",
    "cascade_outcomes": f"WITH {_JUDGED} SELECT a, b, distance, round(hi, 6) AS hi, round(lo, 6) AS lo, round(tile, 6) AS tile, outcome FROM o",
    "calibration": f"WITH {_JUDGED} SELECT distance, outcome, count(*)::BIGINT AS pairs FROM o GROUP BY distance, outcome",
    "components": f"WITH RECURSIVE {_TOKENS} {_PAIRS} {_CONF} {_COMPONENTS} SELECT doc_id, group_id FROM g",
    "group_methods": rf"""
WITH RECURSIVE {_TOKENS} {_PAIRS} {_CONF} {_COMPONENTS},
n AS (SELECT group_id, count(*) AS n, count(DISTINCT sha256(text)) AS shas, count(DISTINCT md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))) AS pixels FROM g JOIN documents USING (doc_id) GROUP BY group_id)
SELECT CASE WHEN n = 1 THEN 'single' WHEN shas = 1 THEN 'exact' WHEN pixels = 1 THEN 'same image' ELSE 'similar' END AS method, count(*)::BIGINT AS groups, sum(n)::BIGINT AS members, max(n)::BIGINT AS longest FROM n GROUP BY 1
""",
    "canonical_default": f"""
WITH {_MEMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY in_band DESC, tier DESC, n_chars DESC, priority, sha, doc_id) AS k FROM w)
SELECT group_id, doc_id, n_chars, members::BIGINT AS members FROM k WHERE k = 1
""",
    "canonical_burst": f"""
WITH {_MEMBERS}, b AS (SELECT * REPLACE (count(*) OVER (PARTITION BY group_id) AS members) FROM w WHERE in_band),
k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY quality DESC NULLS LAST, priority, doc_id) AS k FROM b)
SELECT group_id, doc_id, quality, members::BIGINT AS members FROM k WHERE k = 1
""",
    "canonical_video": f"""
WITH {_MEMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n_chars DESC, tier DESC, doc_id DESC) AS k FROM w)
SELECT group_id, doc_id, members::BIGINT AS members FROM k WHERE k = 1
""",
    "canonical_override": f"""
WITH {_MEMBERS}, c AS (SELECT *, sha IN (SELECT sha FROM m WHERE doc_id % 7 = 0) AS chosen FROM w),
k AS (SELECT *, row_number() OVER win AS k, lead(doc_id) OVER win AS runner_up, lead(n_chars) OVER win AS next_chars FROM c WINDOW win AS (PARTITION BY group_id ORDER BY chosen DESC, n_chars DESC, doc_id))
SELECT group_id, doc_id, runner_up, CASE WHEN runner_up IS NULL THEN 'only copy' WHEN chosen THEN 'chosen' WHEN n_chars > next_chars THEN 'more pixels' ELSE 'first id' END AS reason FROM k WHERE k = 1
""",
    "roles": f"""
WITH {_MEMBERS}, k AS (SELECT *, first_value(doc_id) OVER win AS keep_id, first_value(sha) OVER win AS keep_sha FROM w WINDOW win AS (PARTITION BY group_id ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, CASE WHEN doc_id = keep_id THEN 'canonical' WHEN sha <> keep_sha AND quality = 0 THEN 'burst_sibling' WHEN sha <> keep_sha AND doc_id % 10 = 3 THEN 'variant' ELSE 'duplicate' END AS role,
CASE WHEN doc_id = keep_id THEN '' WHEN sha = keep_sha THEN 'identical bytes' ELSE 'identical pixels' END AS why FROM k
""",
    "radius_sweep": f"""
WITH RECURSIVE {_TOKENS} {_PAIRS}
rad AS (SELECT unnest([0, 2, 4, 6, 8])::BIGINT AS radius),
e AS (SELECT radius, a AS u, b AS v FROM p, rad WHERE distance <= radius UNION SELECT radius, b, a FROM p, rad WHERE distance <= radius),
r AS (SELECT radius, u AS node, u AS label FROM e UNION SELECT r.radius, e.v, r.label FROM r JOIN e ON e.u = r.node AND e.radius = r.radius),
g AS (SELECT radius, node, min(label) AS label FROM r GROUP BY radius, node),
n AS (SELECT radius, label, count(*) AS n FROM g GROUP BY radius, label)
SELECT rad.radius, count(n)::BIGINT AS merged_groups, coalesce(sum(n - 1), 0)::BIGINT AS merged_away, coalesce(max(n), 1)::BIGINT AS longest FROM rad LEFT JOIN n ON n.radius = rad.radius GROUP BY rad.radius
""",
    "cluster_sizes": f"WITH {_MEMBERS} SELECT doc_id, group_id, members::BIGINT AS size FROM w WHERE members > 1",
    "weakest_merges": f"""
WITH {_MEMBERS}, q AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.1::DOUBLE ELSE ('0.' || lpad((n_chars % 100)::VARCHAR, 2, '0'))::DOUBLE END AS risk FROM w)
SELECT group_id, min(risk) AS risk, count(*)::BIGINT AS members, min(doc_id) AS first_id FROM q WHERE members > 1 GROUP BY group_id ORDER BY risk, members DESC, first_id LIMIT 10
""",
    "review_samples": f"WITH {_JUDGED}, k AS (SELECT outcome, a, b, row_number() OVER (PARTITION BY outcome ORDER BY hi, a, b) AS k FROM o) SELECT outcome, a, b, k FROM k WHERE k <= 4",
    "human_decisions": f"""
WITH RECURSIVE {_TOKENS} {_PAIRS}
conf AS (SELECT a, b FROM p WHERE distance <= 4 AND (a + b) % 3 <> 0 UNION SELECT x.doc_id, y.doc_id FROM sim x JOIN sim y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 50 = 0),
{_COMPONENTS} SELECT doc_id, group_id FROM g
""",
    "exact_tiers": r"""
WITH RECURSIVE d AS (SELECT doc_id, sha256(text) AS sha, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS pixel FROM documents),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM d a JOIN d b ON a.doc_id <> b.doc_id AND (a.sha = b.sha OR a.pixel = b.pixel)),
r AS (SELECT doc_id AS node, doc_id AS label FROM d UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.node)
SELECT node AS doc_id, min(label) AS group_id FROM r GROUP BY node
""",
    "frame_match": """
WITH n AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
f AS (SELECT c.conv_id, list(('0x' || substr(md5(text), 1, 15))::BIGINT ORDER BY turn) AS frames FROM conversations c JOIN n USING (conv_id)
  WHERE text IS NOT NULL AND turn IN (floor(last * 0.1)::BIGINT, floor(last * 0.5)::BIGINT, floor(last * 0.9)::BIGINT) GROUP BY c.conv_id),
s AS (SELECT conv_id, md5(string_agg(text, '|' ORDER BY turn)) AS stream, max(turn) AS duration FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
r AS (SELECT * FROM f JOIN s USING (conv_id)),
p AS (SELECT a.conv_id AS a, b.conv_id AS b, a.stream AS sa, b.stream AS sb, a.frames AS fa, b.frames AS fb,
  list_max(list_transform(range(1, greatest(len(a.frames), len(b.frames)) + 1), lambda i: bit_count(xor(a.frames[i], b.frames[i])))) AS far
  FROM r a JOIN r b ON a.conv_id < b.conv_id AND a.duration = b.duration)
SELECT a, b, far::BIGINT AS farthest, CASE WHEN sa = sb THEN 'confirm' WHEN len(fa) = 0 OR len(fa) <> len(fb) THEN 'review' WHEN far <= 24 THEN 'confirm' ELSE 'reject' END AS outcome FROM p
""",
}
