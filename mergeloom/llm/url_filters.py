"""URL rules as a sort-merge range join over reversed-host keys.

A host is keyed by its labels in reverse, each followed by a dot (``com.example.``), so
a host and all its subdomains are the keys of one interval that starts at the rule's key. Rows
are dealt by ranges of the key and sorted; a sweep over them keeps a stack of the
nested intervals that are open, each with the path prefixes of its rules by length. Between two ends of intervals the
stack is the same, so all pages there are judged at once, by a lookup for each length of prefixes. Intervals that reach into
several ranges are given to each of them, so no range depends on another one's sweep. Rules are never
broadcast; a hot host is split, as the ranges are cut by (key, row)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.session import small_batches, table
from mergeloom.llm._order import range_number

#: Ranges per shuffle partition, and keys kept per range, at most, to choose where ranges are cut.
RANGES = 4
PER_RANGE = 16

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "/", 1)).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column, host: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(tail, "?", 1), "#", 1)).otherwise(F.lit(""))


def reversed_key(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``; an empty host has an empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, key."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    own = own.withColumn("host", host_of(F.col("url")))
    return own.withColumn("path", path_of(F.col("url"), F.col("host"))).withColumn("key", reversed_key(F.col("host")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path prefix, verdict) as rows."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


class Open:
    """The rules of a host whose interval is open: path prefixes by their length."""

    def __init__(self, key: str) -> None:
        self.key = key
        self.rules: dict[int, dict[str, tuple[str, str]]] = {}
        self.made: dict[int, tuple[pa.Array, np.ndarray, np.ndarray]] = {}

    def add(self, host: str, path: str, verdict: str) -> None:
        own = self.rules.setdefault(len(path), {})
        if path not in own or (verdict == "block") > (own[path][1] == "block"):
            own[path] = (host + path, verdict)
            self.made.pop(len(path), None)

    def prefixes(self, size: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The prefixes of a length, their rules and verdicts."""
        if size not in self.made:
            own = self.rules[size]
            self.made[size] = (pa.array(list(own), pa.string()), np.array([x[0] for x in own.values()], object), np.array([x[1] for x in own.values()], object))
        return self.made[size]


def judge(path: pa.Array, stack: list[Open], default: str) -> tuple[pa.Array, pa.Array]:
    """The rules and verdicts of paths on hosts for which the rules in ``stack`` are open."""
    rule, verdict = np.full(len(path), None, object), np.full(len(path), default, object)
    # the length of a rule's host is that of its key without the last dot
    for _, _, x, size in sorted((len(x.key) + size, len(x.key), i, size) for i, x in enumerate(stack) for size in x.rules):
        prefixes, rules, verdicts = stack[x].prefixes(size)
        k = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(path, 0, size), value_set=prefixes), -1).to_numpy()
        rule[k >= 0], verdict[k >= 0] = rules[k[k >= 0]], verdicts[k[k >= 0]]
    return pa.array(rule, pa.string()), pa.array(verdict, pa.string())


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None) -> DataFrame:
    """Judges each page's url by the longest rule that fits it.

    pages: page_id, url; further columns are ignored. rules: host, path, verdict; a rule fits its host
    and all subdomains if the path starts with its own. Of the rules that fit, the one with the longest host
    and path together wins, then the longest host, then the verdict ``block``. Returns page_id, host, path,
    rule (host and path, null if none fits) and verdict (else ``default``). A null url, or one without
    ``://``, has an empty host and path, which no rule fits. Urls of any length are judged whole. Rules with a null or empty host are
    ignored; a null path is the empty prefix. Repeated rows are judged each. Empty tables give no rows,
    or the default verdict."""
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = parsed(small_batches(pages))
    tie = F.lpad(F.pmod(F.xxhash64("page_id", "url"), F.lit(2**62)).cast("string"), 20, "0")
    rows = rows.withColumn("tie", tie).withColumn("place", F.concat("key", F.lit("\u0001"), "tie"))
    # where ranges are cut only balances the work; the row with the least hash of each hash bucket is a fair choice
    ranges = RANGES * parts
    hashed = rows.select("place", F.xxhash64("tie").alias("h")).groupBy(F.pmod("h", F.lit(PER_RANGE * ranges)).alias("b")).agg(F.min(F.struct("h", "place")).alias("x"))
    seen = sorted(r["place"] for r in hashed.select("x.place").collect())  # at most the buckets
    cuts = sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []

    def number(place: Column) -> Column:
        return range_number(place, cuts, "string")

    own = (
        rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where((F.col("host") != "") & F.col("verdict").isNotNull())
        .select(
            F.lit(None).cast("long").alias("page_id"), "host", "path",
            reversed_key(F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("key"), F.lit("").alias("tie"), "verdict",
        )
    )
    # '/' follows '.', with which a key ends
    own = own.withColumn("part", F.explode(F.sequence(number(F.col("key")), number(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))))))
    both = rows.select("page_id", "host", "path", "key", "tie", F.lit(None).cast("string").alias("verdict"), number(F.col("place")).alias("part")).unionByName(own)
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "key", F.col("verdict").isNull(), "tie", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for batch in batches:
            host, path, key, verdict, parted = (batch.column(batch.schema.get_field_index(c)) for c in ("host", "path", "key", "verdict", "part"))
            is_rule, at = verdict.is_valid().to_numpy(zero_copy_only=False), parted.to_numpy()
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | is_rule[1:] | is_rule[:-1]
            cuts_ = np.append(np.flatnonzero(new), len(at))
            judged = [pa.array([], pa.string())], [pa.array([], pa.string())]
            for lo, hi in zip(cuts_[:-1].tolist(), cuts_[1:].tolist(), strict=True):  # a rule, or pages between rules
                if at[lo] != part:
                    part, stack = at[lo], []
                if is_rule[lo]:
                    name = key[lo].as_py()
                    while stack and not name.startswith(stack[-1].key):
                        stack.pop()
                    if not stack or stack[-1].key != name:
                        stack.append(Open(name))
                    stack[-1].add(host[lo].as_py(), path[lo].as_py(), verdict[lo].as_py())
                    continue
                while lo < hi:
                    while stack and not key[lo].as_py().startswith(stack[-1].key):
                        stack.pop()
                    inside = pc.starts_with(key.slice(lo, hi - lo), stack[-1].key).to_numpy(zero_copy_only=False) if stack else np.ones(hi - lo, bool)
                    n = hi - lo if inside.all() else int(inside.argmin())  # keys are sorted, so the others follow
                    for x, found in zip(judged, judge(path.slice(lo, n), stack, default), strict=True):
                        x.append(found)
                    lo += n
            pages_ = batch.filter(pa.array(~is_rule))
            yield pa.RecordBatch.from_arrays(
                [*(pages_.column(pages_.schema.get_field_index(c)) for c in ("page_id", "host", "path")), *(pa.concat_arrays(x) for x in judged)], names=["page_id", "host", "path", "rule", "verdict"]
            )

    return dealt.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


QUERIES = {"op8_url_filters": op8_url_filters}
SQL = {
    "op8_url_filters": r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY CASE WHEN r.host IS NULL THEN -1 ELSE length(r.host) + length(r.path) END DESC, length(r.host) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id::BIGINT AS page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
}
