"""Exact Jaccard join of documents on word shingles: a blocked sparse matrix product, pruned by size.

The incidence matrix has a row per different shingle set and a column per shingle, in one global order in which
frequent shingles come last. Two sets of n and m shingles that are similar enough share one of their first
n - ceil(t n) + 1 ones, so only those columns are multiplied. Blocks of columns are dealt by shingle; a column with one
entry is dropped at once. For the rest, overlap counts are accumulated per pair, and a pair goes if its count and
what can still follow stay below the bound that its sizes set. So does one whose sets, summed up in blocks of
columns (a count of each set's shingles by their leading hash bits, about one for every two shingles), can't
overlap enough: the lesser counts of all blocks bound the overlap. The pairs left are counted exactly on whole texts.

Groups of thousands of near copies would fill blocks with pairs. So before the full product, each column's
entries are first multiplied only with one entry of about their size, the column's leader, which is linear; what
that links is contracted. The full product then takes only pairs that are in different components, which finds
every link that can still join two of them. Crowded columns are cut by the size classes of the pair, each of which
only takes the entries whose place leaves room for enough overlap, and then into bounded blocks of rows; a
component that fills blocks has blocks of its own, which meet all others but each other. So a column in which a great
group meets a few strangers is linear in the group. Each block pair is multiplied in place: a pair is written only if its
summaries leave room for enough overlap, and not again in a column that follows one of the pair's first common
ones. Documents with equal sets are one row throughout.

Rows are named by 64 bits of their sets' 128-bit signatures; those whose 64 bits two sets share, if any, by all of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mergeloom.functions.components import connected_components
from mergeloom.functions.session import cut, small_batches, table
from mergeloom.llm import _text
from mergeloom.llm._ids import NULL, IdFilter

PERCENT = 80
LEADER_ROUNDS = 2
#: Shingles whose frequency is known to the order, at most. It only affects speed: any order is right.
FREQUENT = 1 << 16
LOCAL_LEAST = 8
#: Entries of a shingle that is known to be frequent are dealt to one task per so many.
SPREAD = 256
#: Columns with more entries are crowded; they're multiplied in blocks of so many rows.
CROWD = 64
BLOCK = 2048
#: Size classes up to the largest ratio of similar sizes.
CLASSES = 4
#: Of a row's crowded columns, so many first ones are known to the others.
FIRST = 8
BLOCKS_BITS = 8


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, _, raw, at in _text.chunks(texts):
        h, first = _text.shingles(raw, at)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            s = np.sort(h[a:b])
            if len(s) > 1:
                keep = np.ones(len(s), bool)
                keep[1:] = s[1:] != s[:-1]
                s = s[keep]
            yield s


def signature(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set; of the first one, tests may keep fewer bits."""
    one = int(np.add.reduce(_text.mix(s + np.uint64(0x51ED270B)))) + len(s) * 0x9E3779B97F4A7C15
    two = int(np.add.reduce(_text.mix(s ^ np.uint64(0xA0761D6478BD642F))))
    pair = _text.mix(np.array([one & (2**64 - 1), two & (2**64 - 1)], np.uint64)).view(np.int64)
    return int(pair[0]) if bits == 64 else int(pair[0]) & ((1 << bits) - 1), int(pair[1])


def row_key(one: int, two: int, clash: frozenset[int]) -> int:
    """The name of the row with this signature; ``clash`` has the first halves that several signatures have."""
    if one not in clash:
        return one
    both = (two ^ (one << 1)) & (2**64 - 1)
    return both - 2**64 if both >= 2**63 else both


def required(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that is similar enough to it."""
    return -(-percent * n // 100)


def similar(both: int, n: int, m: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def summary(s: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of about half as many blocks (256 at least), up to 255."""
    bits = max(BLOCKS_BITS, int(len(s)).bit_length() - 1)
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(a: bytes, size: int) -> np.ndarray:
    """A summary with fewer blocks."""
    return np.frombuffer(a, np.uint8).astype(np.int32).reshape(size, -1).sum(1)


def apart(a: bytes, b: bytes) -> int:
    """No two sets with these summaries differ in fewer shingles. Counts that were capped only lower it, if neither is folded."""
    size = min(len(a), len(b))
    x, y = folded(a, size), folded(b, size)
    if len(a) != len(b) and max(max(a), max(b)) == 255:
        return 0
    return int(np.abs(x - y).sum())


def enough(differ: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sets of n and m shingles that differ in ``differ`` are similar enough: intersection (n + m - d) / 2, union (n + m + d) / 2."""
    return 100 * (n + m - differ) >= percent * (n + m + differ)


def bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, size of a, size of b, summary of a, summary of b) that may be similar enough."""
    for batch in batches:
        n, m, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
        good = []
        for i in range(len(n)):
            good.append(x[i] is None or y[i] is None or enough(apart(x[i], y[i]), n[i], m[i], percent))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def scan(batches: Iterator[pa.RecordBatch], bits: int = 64) -> Iterator[pa.RecordBatch]:
    """kind 0: doc_id, set size, signature, and the set's summary with its first row here. kind 1: a frequent shingle, and how often it's here."""
    seen: set[tuple[int, int]] = set()
    pool: list[np.ndarray] = []
    size = 0

    def frequent() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(pool), return_counts=True)
        h, n = h[n >= LOCAL_LEAST].view(np.int64), n[n >= LOCAL_LEAST].astype(np.int64)
        zero = np.zeros(len(h), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(zero + 1, pa.int64()), pa.array(h), pa.array(n), pa.array(zero), pa.array(zero), pa.nulls(len(h), pa.binary())], names=["kind", "a", "b", "c", "d", "s"])

    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), []
        for key, s in zip(ids, sets(batch.column(1)), strict=True):
            one, two = signature(s, bits) if len(s) else (0, 0)
            rows.append((0, key, len(s), one, two, summary(s) if len(s) and (one, two) not in seen else None))
            if len(s) and (one, two) not in seen:
                seen.add((one, two))
                pool.append(s)
                size += len(s)
            if size > 1 << 20:
                yield frequent()
                pool, size = [], 0
        yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], pa.array([r[5] for r in rows], pa.binary())], names=["kind", "a", "b", "c", "d", "s"])
    if pool:
        yield frequent()


def columns(batches: Iterator[pa.RecordBatch], hot: np.ndarray, rank: np.ndarray, spread: np.ndarray, percent: int, key: Callable[[np.ndarray], int]) -> Iterator[pa.RecordBatch]:
    """The entries (shingle, salt, set, set's size, place in the set's order) that the product needs.

    Entries of a frequent shingle have one of ``spread`` salts above 0, by their set."""
    seen: set[int] = set()
    for batch in batches:
        tokens, salts, nodes, sizes, places = [], [], [], [], []
        held = 0

        def flush() -> pa.RecordBatch:
            n = np.array([len(t) for t in tokens], np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64)),
                    pa.array(np.concatenate([*salts, np.zeros(0, np.int32)]).astype(np.int32)),
                    pa.array(np.repeat(np.array(nodes, np.int64), n)),
                    pa.array(np.repeat(np.array(sizes, np.int32), n)),
                    pa.array(np.concatenate([*places, np.zeros(0, np.int32)]).astype(np.int32)),
                ],
                names=["token", "salt", "node", "n", "place"],
            )

        for s in sets(batch.column(0)):
            if not len(s):
                continue
            node = key(s)
            if node in seen:
                continue
            seen.add(node)
            n = len(s)
            salt = np.zeros(n, np.int32)
            if len(hot):
                k = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                late = hot[k] == s
                if late.any():
                    order = np.argsort(rank[k[late]], kind="stable")
                    salt = np.concatenate([salt[~late], np.where(spread[k[late]] > 1, node % spread[k[late]] + 1, 0)[order]])
                    s = np.concatenate([s[~late], s[late][order]])
            first = n - required(n, percent) + 1
            tokens.append(s[:first])
            salts.append(salt[:first])
            nodes.append(node)
            sizes.append(n)
            places.append(np.arange(first, dtype=np.int32))
            held += first
            if held > 200_000:
                yield flush()
                tokens, salts, nodes, sizes, places, held = [], [], [], [], [], 0
        yield flush()


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by (token, salt, node), those of tokens with several nodes or with salts, each once."""
    rest: pa.RecordBatch | None = None  # the entries of the last token so far, if they're one node's
    last: tuple | None = None  # token, salt and node of the last entry passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            rest = None
        t, salt, v = (batch.column(i).to_numpy() for i in range(3))
        begin = np.ones(len(t), bool)
        begin[1:] = (t[1:] != t[:-1]) | (salt[1:] != salt[:-1])
        new = begin.copy()
        new[1:] |= v[1:] != v[:-1]
        goes_on = last is not None and (t[0], salt[0]) == last[:2]
        if goes_on and v[0] == last[2]:
            new[0] = False
        # a token is shared if any of its neighbours differ in node; spread that over the token's run
        run = np.cumsum(begin) - 1
        many = np.zeros(run[-1] + 1, bool)
        many[run[new & ~begin]] = True
        many[run[salt > 0]] = True
        many[0] |= goes_on  # the batch before has passed on another node of this token
        keep = many[run] & new
        if many[-1]:
            last = (t[-1], salt[-1], v[-1])
        else:  # the last token may go on in the next batch
            rest, last = batch.slice(int(np.flatnonzero(run == run[-1])[0]), 1), None
        yield batch.filter(pa.array(keep)).drop_columns(["salt"])


def crowd(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb) of the pairs of each block pair that are in different components and may be similar enough.

    Rows are sorted by (token, lo, hi, i, j); those of a block pair are together, 2 * BLOCK or so."""
    names = ["token", "lo", "hi", "i", "j", "own", "side", "node", "n", "place", "comp", "first", "s"]
    held: dict[str, list] = {c: [] for c in names}
    key = None

    def done() -> Iterator[pa.RecordBatch]:
        if len(held["node"]) < 2:
            return
        node, n, comp, place, side = (np.array(held[c], np.int64) for c in ("node", "n", "comp", "place", "side"))
        own = np.array([x == held["i"][0] for x in held["own"]])
        s = np.stack([folded(x, 1 << BLOCKS_BITS) for x in held["s"]])
        capped = np.array([max(x) == 255 for x in held["s"]])
        before = [{t for p, t in f if p < q} for f, q in zip(held["first"], held["place"], strict=True)]
        tally = Counter(t for f in before for t in f).most_common(63)
        bit = {t: 1 << k for k, (t, _) in enumerate(tally)}
        seen = np.array([sum(bit.get(t, 0) for t in f) for f in before], np.int64)
        order = np.lexsort((node, n))
        node, n, comp, own, side, s, seen, capped = (x[order] for x in (node, n, comp, own, side, s, seen, capped))
        left = (n - place[order]) * (100 + percent)  # the overlap that the place leaves room for
        crossed, sided = held["i"][0] != held["j"][0], held["lo"][0] != held["hi"][0]
        for lo in range(0, len(node), 256):
            hi = min(lo + 256, len(node))
            to = int(np.searchsorted(n * percent, n[hi - 1] * 100, "right"))  # larger ones are too large for all of these
            a, b = np.arange(lo, hi)[:, None], np.arange(lo, to)[None, :]
            good = (a < b) & (comp[a] != comp[b]) & ((seen[a] & seen[b]) == 0) & (np.minimum(left[a], left[b]) >= percent * (n[a] + n[b]))
            if crossed:
                good &= own[a] != own[b]
            if sided:
                good &= side[a] != side[b]
            x, y = np.nonzero(good)
            x, y = x + lo, y + lo
            for k in range(0, len(x), 1 << 14):
                u, v = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
                differ = np.abs(s[u] - s[v]).sum(1, dtype=np.int64)
                may = enough(differ, n[u], n[v], percent) | capped[u] | capped[v]
                u, v = u[may], v[may]
                if len(u):
                    swap = node[u] > node[v]
                    u, v = np.where(swap, v, u), np.where(swap, u, v)
                    yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v]), pa.array(n[u].astype(np.int32)), pa.array(n[v].astype(np.int32))], names=["a", "b", "na", "nb"])

    for batch in batches:
        columns_ = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names if c != "first"}
        first = batch.column(batch.schema.get_field_index("first"))
        columns_["first"] = [[(f["place"], f["token"]) for f in x] for x in first.to_pylist()]
        for r, new in enumerate(zip(*(columns_[c] for c in names[:5]), strict=True)):
            if new != key:
                yield from done()
                held, key = {c: [] for c in names}, new
            for c in names:
                held[c].append(columns_[c][r])
    yield from done()


def counted(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, text of a, text of b) whose shingle sets are similar enough."""
    known: dict[int, np.ndarray] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            a, b = some.column(0).to_pylist(), some.column(1).to_pylist()
            for keys, texts in ((a, some.column(2)), (b, some.column(3))):
                want = [i for i, k in enumerate(keys) if k not in known]
                want = list({keys[i]: i for i in want}.values())
                if want:
                    for i, s in zip(want, sets(texts.take(pa.array(want))), strict=True):
                        known[keys[i]] = s
            good = []
            for x, y in zip(a, b, strict=True):
                s, t = known[x], known[y]
                both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                good.append(similar(both, len(s), len(t), percent))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], names=["u", "v"]).filter(pa.array(good))
            if sum(map(len, known.values())) > 1 << 20:
                known.clear()


class Join:
    """One run of the join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, bits: int = 64) -> None:
        self.percent, self.bits = percent, bits
        self.docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        got = cut(self.docs.mapInArrow(partial(scan, bits=bits), "kind long, a long, b long, c long, d long, s binary"))
        own = got.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.when(F.col("b") > 0, F.col("c")).alias("c"), "d", "s")
        # first halves of signatures that several sets share: of n sets about n * n / 2 ** 65
        self.clash = frozenset(r["c"] for r in own.where("n > 0").groupBy("c").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("c").collect())
        both = F.col("d").bitwiseXOR(F.shiftleft("c", 1))
        own = own.withColumn("node", F.when(F.col("c").isin(*self.clash), both).otherwise(F.col("c")) if self.clash else F.col("c"))
        self.summaries = own.where("s is not null").select("node", "s")
        self.rows = own.select("doc_id", "n", "node")
        nodes = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), *[f(x).alias(f"{x}{k}") for x in ("c", "d") for k, f in enumerate((F.min, F.max))])
        self.nodes = cut(nodes)
        if self.clash and self.nodes.where("c0 <> c1 or d0 <> d1").limit(1).count():
            raise ArithmeticError("two different shingle sets have one 128-bit signature")
        # the most frequent shingle of each hash bucket, and all that make up one in FREQUENT of the entries: a bounded table
        total = got.where("kind = 1").agg(F.sum("b")).first()[0] or 0
        known = got.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("n"))
        top = known.groupBy(F.pmod("token", F.lit(FREQUENT)).alias("bucket")).agg(F.max(F.struct("n", "token")).alias("top")).select("top.token", "top.n")
        hot = top.union(known.where(F.col("n") >= max(LOCAL_LEAST, total // FREQUENT)).orderBy(F.desc("n"), "token").limit(FREQUENT)).distinct().toArrow()
        h, n = hot.column("token").to_numpy().view(np.uint64), hot.column("n").to_numpy()
        order = np.argsort(h)
        self.hot, n = h[order], n[order]
        self.spread = -(-n // SPREAD)
        self.rank = np.empty(len(h), np.int64)
        self.rank[np.lexsort((self.hot, n))] = np.arange(len(h))

    def keyed(self) -> Callable[[np.ndarray], int]:
        """Names the row that a set is, in tasks."""
        bits, clash = self.bits, self.clash
        return lambda s: row_key(*signature(s, bits), clash)

    def entries(self) -> DataFrame:
        """The entries of columns that several rows share. Frequent ones are dealt to several tasks."""
        every = self.docs.select("text").mapInArrow(
            partial(columns, hot=self.hot, rank=self.rank, spread=self.spread, percent=self.percent, key=self.keyed()), "token long, salt int, node long, n int, place int"
        )
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = every.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "node")
        return cut(dealt.mapInArrow(shared, "token long, node long, n int, place int"))

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose accumulated count and what may follow can reach the bound of their sizes."""
        n, m, t = F.col("na").cast("long"), F.col("nb").cast("long"), self.percent
        return (
            pairs.groupBy("a", "b", "na", "nb")
            .agg(F.count(F.lit(1)).alias("k"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
            .where((F.col("k") + F.least(n - F.col("pa") - 1, m - F.col("pb") - 1)) * (100 + t) >= t * (n + m))
            .select("a", "b", "na", "nb")
        )

    def sized(self, n: str, m: str) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def room(self, n: Column, place: Column, m: Column) -> Column:
        """Whether a row of n whose first column in common with one of m is at ``place`` can overlap it enough."""
        return (n.cast("long") - place) * (100 + self.percent) >= self.percent * (n.cast("long") + m)

    def leaders(self, entries: DataFrame, step: int) -> DataFrame:
        """Pairs of a column's leader, among entries of about one size, and each other one.

        At first that's the row with the fewest rarer shingles, the least edited one of a group of copies; then any."""
        own = entries.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / self.percent)))).withColumn("h", F.xxhash64("node", F.lit(step)))
        first = own.groupBy("token", "size").agg(F.min(F.struct(F.when(F.lit(step == 0), F.col("place")).otherwise(F.lit(0)).alias("rarer"), "h", "node", "n", "place", "comp")).alias("x"))
        pairs = (
            own.join(first, ["token", "size"])
            .where((F.col("comp") != F.col("x.comp")) & self.sized("n", "x.n"))
            .select(F.col("x.node").alias("a"), F.col("node").alias("b"), F.col("x.n").alias("na"), F.col("n").alias("nb"), F.col("x.place").alias("pa"), F.col("place").alias("pb"))
        )
        return self.possible(pairs)

    def product(self, entries: DataFrame) -> DataFrame:
        """All pairs of different components that share a column and can be similar enough. ``entries`` has each column's ``rows``."""
        few = entries.where(F.col("rows") <= CROWD)
        a = few.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("comp").alias("ca"))
        b = few.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("comp").alias("cb"))
        pairs = a.join(b, "token").where(
            (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & self.sized("na", "nb")
            & self.room(F.col("na"), F.col("pa"), F.col("nb")) & self.room(F.col("nb"), F.col("pb"), F.col("na"))
        )
        many = entries.where(F.col("rows") > CROWD)
        # of a crowded column's rows, the first crowded columns and the summary
        first = many.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "token"))), 1, FIRST).alias("first"))  # at most the columns of one row
        first = first.join(self.summaries.dropDuplicates(["node"]), "node")
        dealt = self.blocks(many).join(first, "node")
        parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        by = ["token", "lo", "hi", "i", "j"]
        dealt = dealt.repartition(parts, *by).sortWithinPartitions(*by)
        crowded = dealt.mapInArrow(partial(crowd, percent=self.percent), "a long, b long, na int, nb int")
        return self.possible(pairs).unionByName(crowded).distinct()

    def blocks(self, many: DataFrame) -> DataFrame:
        """Crowded columns' entries, once per pair (i, j) of blocks of rows, by the pair's size classes (lo, hi).

        A column of at most BLOCK ``rows`` is one block. In larger ones a component with BLOCK rows or more has blocks of its own,
        which don't meet each other."""
        own, one = ["token", "node", "n", "place", "comp"], F.lit("")
        small = many.where(F.col("rows") <= BLOCK).select("token", F.lit(0).alias("lo"), F.lit(0).alias("hi"), one.alias("i"), one.alias("j"), one.alias("own"), F.lit(0).alias("side"), *own[1:])
        return small.unionByName(self.great(many.where(F.col("rows") > BLOCK).select(*own)))

    def great(self, many: DataFrame) -> DataFrame:
        step = (100 / self.percent) ** (1 / CLASSES)

        def size_class(n: Column) -> Column:
            return F.floor(F.log(n.cast("double")) / F.log(F.lit(step))).cast("int")

        cls = size_class(F.col("n"))
        # the largest partner that the place leaves room for, and a class more, as logarithms are rounded
        largest = F.greatest(F.floor((F.col("n").cast("long") - F.col("place")) * (100 + self.percent) / self.percent) - F.col("n"), F.lit(1))
        lowest = F.col("cls") - CLASSES - 1
        other = F.explode(F.sequence(lowest, F.greatest(lowest, F.least(F.col("cls") + CLASSES, size_class(largest)) + 1)))
        least = F.floor(F.pow(F.lit(step), F.col("c2").cast("double")) * (1 - 1e-9))  # no row of the class is smaller
        kept = (
            many.withColumn("cls", cls).withColumn("c2", other)
            .where(self.room(F.col("n"), F.col("place"), least))
            .select("token", F.least("cls", "c2").alias("lo"), F.greatest("cls", "c2").alias("hi"), (F.col("cls") > F.col("c2")).cast("int").alias("side"), "node", "n", "place", "comp")
        )
        key, size = ["token", "lo", "hi"], F.ceil(F.col("c") / BLOCK).cast("int")
        of_comp = kept.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("c"), F.min("side").alias("s0"), F.max("side").alias("s1"))
        # at most one block per BLOCK rows, and one for the rest
        plan = of_comp.groupBy(*key).agg(
            F.sum(F.when(F.col("c") < BLOCK, F.col("c")).otherwise(0)).alias("rest"), F.sort_array(F.collect_list(F.when(F.col("c") >= BLOCK, F.struct(F.col("comp").alias("own"), size.alias("size"))))).alias("big"),
            F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("s0").alias("s0"), F.max("s1").alias("s1"),
        ).where("c0 <> c1 and (lo = hi or s0 <> s1)")

        def numbered(own: Column, size: Column) -> Column:
            return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.struct(own.alias("own"), k.alias("k")))).otherwise(F.array().cast("array<struct<own: bigint, k: int>>"))

        rest = F.ceil(F.col("rest") / BLOCK).cast("int")
        plan = plan.select(*key, rest.alias("rest"), "big", F.concat(numbered(F.lit(None).cast("long"), rest), F.flatten(F.transform("big", lambda x: numbered(x["own"], x["size"])))).alias("all"))
        met = kept.join(plan, key).withColumn("mine", F.get(F.filter("big", lambda x: x["own"] == F.col("comp")), F.lit(0)))
        own = F.struct(F.col("mine.own").alias("own"), F.pmod(F.xxhash64("node"), F.coalesce("mine.size", "rest")).cast("int").alias("k"))
        met = met.withColumn("own", own).withColumn("other", F.explode(F.filter("all", lambda x: x["own"].isNull() | F.col("mine").isNull() | (x["own"] != F.col("comp")))))

        def name(x: Column) -> Column:
            return F.concat_ws(":", F.coalesce(x["own"].cast("string"), F.lit("")), x["k"].cast("string"))

        met = met.withColumn("own", name(F.col("own"))).withColumn("other", name(F.col("other")))
        return met.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "side", "node", "n", "place", "comp")

    def links(self, pairs: DataFrame) -> DataFrame:
        """(u, v) of the pairs (a, b) that are similar enough by an exact count over their whole texts."""
        pairs = cut(pairs)
        some = self.summaries.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").dropDuplicates(["node"])
        a, b = some.select(F.col("node").alias("a"), F.col("s").alias("sa")), some.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        pairs = cut(pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(partial(bounded, percent=self.percent), "a long, b long"))
        want = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.nodes, "node").select("node", F.coalesce("rep", F.lit(NULL)).alias("rep"))
        want = cut(want)
        named, key = IdFilter(want, "rep"), self.keyed()

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # any document with a node's set will do
            seen: set[int] = set()
            for batch in batches:
                text = batch.column(1).filter(pa.array(named(batch.column(0))))
                nodes = [key(s) if len(s) else None for s in sets(text)]
                first = []
                for x in nodes:
                    first.append(x is not None and x not in seen)
                    seen.add(x)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), text], names=["node", "text"]).filter(pa.array(first, pa.bool_()))

        texts = self.docs.mapInArrow(wanted, "node long, text string").join(want, "node", "left_semi").dropDuplicates(["node"])
        texts = cut(texts)
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
        return both.mapInArrow(partial(counted, percent=self.percent), "u long, v long")

    def components(self) -> DataFrame:
        """(node, root) for each row of the matrix that is linked to one with a smaller signature."""
        entries = self.entries()
        roots = None
        for step in range(LEADER_ROUNDS + 1):
            if roots is None:
                own = entries.withColumn("comp", F.col("node"))
            else:
                own = entries.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
                mixed = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi").select("token", "rows")
                own = cut(own.join(mixed, "token"))
            found = self.links(self.leaders(own, step) if step < LEADER_ROUNDS else self.product(own))
            every = found if roots is None else found.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
            roots = connected_components(every)
        return roots


def jaccard_join(docs: DataFrame, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """One row per document with its class: documents that links join, directly or over others.

    docs: doc_id, text; further columns are ignored. Words are runs without ASCII white space, A-Z lower-cased; a
    document's set is its distinct 5-word shingles, or with fewer words the whole sequence as one. Two
    documents link if 100 * intersection >= percent * union. Returns doc_id, n_shingles and component_id, the
    least doc_id of the class. Null, empty and blank texts have no shingles and are linked with nothing. Rows with a
    null doc_id are kept; their class has its least non-null doc_id. Repeated rows are rows of one class (without
    shingles: of their own doc_id). An empty table gives no rows."""
    join = Join(docs, percent, bits)
    roots = join.components()
    owned = join.nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = owned.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = cut(owned.join(least, "root").select("node", "component_id"))
    return join.rows.join(label, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def fresh(name: str, names: list[str]) -> str:
    """``name``, with underscores until no column has it."""
    while name.lower() in {x.lower() for x in names}:
        name += "_"
    return name


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class that ``jaccard_join`` finds: one with the class's least doc_id (a null one comes last).

    Of rows with the same doc_id and set one stays. Rows without shingles all stay. Only rows that aren't alone in
    their class, and few others, are shuffled."""
    join = Join(docs, percent)
    roots = join.components()
    rows = join.rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("rows")).join(join.nodes.select("node", "rep"), "node")
    owned = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = owned.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("keep"), F.sum("rows").alias("all")).where("all > 1")
    names, key = docs.columns, join.keyed()
    mark, keeps, rep = (fresh(x, names) for x in ("shingle_set", "keeps", "rep"))
    member = cut(owned.join(keep, "root").select(F.col("node").alias(mark), (F.col("keep.node") == F.col("node")).alias(keeps), F.col("rep").alias(rep)))
    named = IdFilter(join.rows.join(member, F.col("node") == F.col(mark), "left_semi").select("doc_id").distinct(), "doc_id")
    at, body = names.index("doc_id"), names.index("text")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~named(batch.column(at))))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(named(batch.column(at))))
            text = some.column(body).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([key(s) if len(s) else None for s in sets(text)], pa.int64())], names=[*names, mark])

    marked = docs.mapInArrow(others, StructType([*docs.schema.fields, StructField(mark, LongType())]))
    met, own = marked.join(member, mark, "left"), [F.col(f"`{c}`") for c in names]
    stay = met.where(F.col(keeps).isNull()).select(*own)
    one = met.where(F.col(keeps) & F.col("doc_id").cast("long").eqNullSafe(F.col(rep))).dropDuplicates(["doc_id", mark]).select(*own)
    return docs.mapInArrow(alone, docs.schema).unionByName(stay).unionByName(one)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ngram_jaccard_join": op4_ngram_jaccard_join}
SQL: dict[str, str] = {}
