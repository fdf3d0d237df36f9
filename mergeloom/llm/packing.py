"""Best-fit packing of token sequences by a linear grouping scheme.

Documents are tokenised once; longer ones are cut into pieces. Since a length is
a whole number of at most ``capacity``, everything that the plan needs is the
histogram of lengths, which is bounded however many documents there are. Large
lengths are rounded up within groups of equal cardinality, configurations of
the few rounded sizes are chosen, the actual lengths are put in their places,
and small ones go, best fit first, into what room is left. The plan says, for
ranges of ranks within a length, which sequence and place they get, so pieces are
assigned where they are, by their rank; no piece visits the driver."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mergeloom.functions.session import cut, small_batches, table

CAPACITY = 1024
END = 2
GROUPS = 512
#: Lengths up to this share of the capacity are small: they fill gaps. Each share is planned, the fewest sequences win.
SMALL = (0.25, 0.4, 0.5)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    """The place of the public byte-level vocabulary, on whichever machine this runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """texts -> lists of ids, as the vocabulary's file defines them.

    Plain texts (Latin letters, printable ASCII and line breaks, without very long words) go
    through a rank encoder that is built from the file's own vocabulary and gives the same ids
    several times faster; all others go through the tokenizers library."""
    import json
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    model = json.loads(open(path, encoding="utf-8").read())
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in kept}
    code |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    special = {x["content"] for x in model["added_tokens"]}
    ranks = {bytes(code[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile(r"[^\n\r\t\x20-\x7e\xa1-\xac\xae-ɏ]|[^\s]{400}|" + "|".join(map(re.escape, sorted(special))))

    def encode(texts: list[str]) -> list[list[int]]:
        out = [None if odd.search(x) else fast.encode_ordinary(x) for x in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i in rest:
                out[i] = slow.encode(texts[i], add_special_tokens=False).ids
        return out

    return encode


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` ids start; all but the first have ``capacity`` ids."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece, with the CRC-32 of its ids. A null text is empty: the end mark alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path or vocabulary())
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(keys), 256):
                some, out = texts.slice(lo, 256).to_pylist(), []
                for key, ids in zip(keys.slice(lo, 256).to_pylist(), encode([x or "" for x in some]), strict=True):
                    ids = np.append(np.asarray(ids, "<u4"), np.asarray([end], "<u4"))
                    for k, s in enumerate(cut_points(len(ids), capacity)):
                        e = len(ids) if k == 0 and len(ids) <= capacity else (s + capacity if k else len(ids) % capacity or capacity)
                        out.append((key, k, s, e - s, zlib.crc32(ids[s:e].tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def grouped(histogram: dict[int, int], groups: int) -> dict[int, int]:
    """Length -> the largest length of its group; groups hold about as many items each."""
    up, total = {}, sum(histogram.values())
    goal, now, members = max(1.0, total / groups), 0, []
    for size in sorted(histogram, reverse=True):
        members.append(size)
        now += histogram[size]
        if now >= goal:
            up |= dict.fromkeys(members, members[0])
            members, now = [], 0
    return up | dict.fromkeys(members, members[0] if members else 0)


def configurations(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Multisets of sizes that fill ``capacity`` best, each with how often it's used, until no item is left.

    The largest size left is completed, each time, by the subset of the others with the least
    room left over; the choice is repeated as often as the counts allow."""
    count, out = {k: v for k, v in count.items() if v}, []
    while count:
        top = max(count)
        space = capacity - top
        sizes = [s for s in sorted(count, reverse=True) if s <= space]
        # reach[r]: the last size added to reach the sum r, with fewest parts
        parts, last = np.full(space + 1, 1 << 30, np.int64), np.zeros(space + 1, np.int64)
        parts[0] = 0
        for s in sizes:
            most = min(count[s] - (s == top), space // s)
            k = 1
            while most > 0:  # binary split of the bounded multiplicity
                take = min(k, most)
                step = take * s
                if step <= space:
                    cand = parts[: space + 1 - step] + take
                    better = cand < parts[step:]
                    # sizes are taken in turn, so a sum reached earlier keeps its trace
                    fresh = better & (parts[step:] >= 1 << 30)
                    parts[step:][fresh] = cand[fresh]
                    last[step:][fresh] = s * 4096 + take
                most -= take
                k *= 2
            if parts[space] < 1 << 30:
                break
        best = int(np.flatnonzero(parts < 1 << 30)[-1])
        chosen: dict[int, int] = defaultdict(int)
        chosen[top] += 1
        while best > 0:
            s, take = divmod(int(last[best]), 4096)
            chosen[s] += take
            best -= s * take
        over = [s for s, n in chosen.items() if n > count[s]]
        if over:  # a trace that used a size twice over; fall back to one more item at a time
            chosen = defaultdict(int, {top: 1})
            left = capacity - top
            for s in sizes:
                n = min(left // s, count[s] - chosen[s])
                if n > 0:
                    chosen[s] += n
                    left -= n * s
        times = min(count[s] // n for s, n in chosen.items())
        out.append((tuple(s for s in sorted(chosen, reverse=True) for _ in range(chosen[s])), times))
        for s, n in chosen.items():
            count[s] -= n * times
            if not count[s]:
                del count[s]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[float, ...] = SMALL) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, number of such sequences)] that hold exactly the histogram's items."""
    return min((scheme(histogram, capacity, groups, share) for share in small), key=lambda found: sum(n for _, n in found))


def scheme(histogram: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[tuple[int, ...], int]]:
    """The linear grouping scheme with lengths up to ``small`` times the capacity kept for the gaps."""
    limit = int(capacity * small)
    large = {s: n for s, n in histogram.items() if s > limit and n}
    little = {s: n for s, n in histogram.items() if 0 < s <= limit and n}
    up = grouped(large, groups)
    rounded: dict[int, int] = defaultdict(int)
    for s, n in large.items():
        rounded[up[s]] += n
    # actual lengths take the places of the rounded ones, largest first
    waiting = {g: [[s, large[s]] for s in sorted((s for s in large if up[s] == g), reverse=True)] for g in rounded}
    classes: dict[tuple[int, ...], int] = defaultdict(int)
    for config, times in configurations(rounded, capacity):
        need: dict[int, int] = defaultdict(int)
        for g in config:
            need[g] += 1
        while times:
            step, actual = times, []
            for g, n in need.items():
                queue = waiting[g]
                if queue[-1][1] >= n:
                    take = [queue[-1][0]] * n
                    step = min(step, queue[-1][1] // n)
                else:  # one sequence that straddles lengths
                    take, step, left = [], 1, n
                    for s, have in reversed(queue):
                        use = min(left, have)
                        take += [s] * use
                        left -= use
                        if not left:
                            break
                actual += take
            for g in need:
                used: dict[int, int] = defaultdict(int)
                for s in actual:
                    if up[s] == g:
                        used[s] += step
                for s, n in used.items():
                    entry = next(x for x in waiting[g] if x[0] == s)
                    entry[1] -= n
                waiting[g] = [x for x in waiting[g] if x[1]]
            classes[tuple(sorted(actual, reverse=True))] += step
            times -= step
    # small ones: best fit, the largest first
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for c, n in classes.items():
        by_room[capacity - sum(c)][c] = by_room[capacity - sum(c)].get(c, 0) + n
    for s in sorted(little, reverse=True):
        left = little[s]
        while left:
            room = min((r for r in by_room if r >= s and by_room[r]), default=None)
            if room is None:
                fit = capacity // s
                n, rest = divmod(left, fit)
                for k, times in ((fit, n), (rest, 1)):
                    if k and times:
                        c = (s,) * k
                        by_room[capacity - s * k][c] = by_room[capacity - s * k].get(c, 0) + times
                left = 0
                continue
            c, n = max(by_room[room].items())
            fit = min(room // s, left)
            take = min(n, left // fit)
            new = c + (s,) * fit
            by_room[room][c] -= take
            if not by_room[room][c]:
                del by_room[room][c]
            by_room[room - s * fit][new] = by_room[room - s * fit].get(new, 0) + take
            left -= take * fit
    return sorted((c, n) for group in by_room.values() for c, n in group.items() if n)


def slots(classes: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where the pieces of a length go, by rank."""
    rows, used, base = [], defaultdict(int), 0
    for lengths, times in classes:
        offset = 0
        for s in lengths:
            rows.append((s, used[s], base, offset))
            used[s] += times
            offset += s
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def ranked(pieces: DataFrame, per_bucket: int = 50_000, rows: int | None = None) -> DataFrame:
    """Adds rank, from 0, of each piece within its length. A length that many pieces have is
    ranked in buckets, whose sizes give their first ranks, so no task gets all of it."""
    buckets = max(64, -(-(rows if rows is not None else pieces.count()) // per_bucket))
    own = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = own.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col("length").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    return (
        own.withColumn("k", F.row_number().over(within) - 1)
        .join(first, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
        .withColumn("rank", F.col("first") + F.col("k"))
        .drop("l", "b", "k", "first", "bucket")
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, groups: int = GROUPS) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    docs: doc_id, text; further columns are ignored. Returns a row per piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset. Null and empty texts are the end mark alone. Repeated
    doc_ids are packed as often as they occur. An empty table gives an empty result. Ties of length
    go by a hash of the piece, so the result doesn't depend on the input's order."""
    pieces = cut(token_pieces(docs, path, capacity, end))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = slots(plan(histogram, capacity, groups))
    width = 1 << 40
    keys = places[:, 0] * width + places[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(keys, length * width + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(places[k, 2] + rank - places[k, 1]), pa.array(places[k, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked(pieces, rows=sum(histogram.values())).mapInArrow(assign, PIECES + ", sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))



QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
SQL: dict[str, str] = {}
