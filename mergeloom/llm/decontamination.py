"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become token sequences twice: plainly, and as templates, in which numbers, names and units
are typed placeholders (runs of numbers or names are one). Windows of five tokens, and of as many as shorter items
have, are joined by hash. A document holds an item if enough of its plain windows occur, or if enough of its template
windows do along one alignment and the values in the slots are consistent: the document exchanges the item's values
one for one. So questions whose numbers and names were changed are found.

Items whose templates and whose pattern of equal values are the same are one class, so a benchmark of thousands of
questions of one form is as cheap as one of them. Windows of classes and of documents are rows. Documents leave out
windows that no class has, by a bitmap of bounded size, and are left out themselves without one of a class's rarest windows:
so few that a document lacking them all can't have enough. Those windows find the candidates, so a
window that many classes share doesn't multiply them; all windows of the candidates are then counted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mergeloom.functions.session import cut, small_batches, table
from mergeloom.llm import _text
from mergeloom.llm._ids import IdFilter

WINDOW = 5
LEAST = 0.8
#: Template windows with fewer plain words say nothing, unless an item has no others.
PLAIN_WORDS = 3

WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
# Words that stand for numbers, units, first names.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollars dollar cents cent euros euro pounds usd eur gbp c f k hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa bar mph kmh degrees degree".split()
FIRST_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark Ashley Donald Emily Steven Kimberly Andrew Margaret Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Timothy Stephanie Ronald Rebecca Jason Laura Edward Helen Tom Ann Anna Bob Alice Peter Maria Emma Jack Kate Sam Lucy Ben Sophie Max Julia Tim Eva".split()

_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".!?\n"]] = 1
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_OUT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _hash_words(words: list[str]) -> np.ndarray:
    column = pa.array(words, pa.large_string())
    out = []
    for _, _, raw, at in _text.chunks(column):
        out.append(_text.hash_spans(raw, at[:-1], at[1:], _text.FOLD))
    return np.sort(np.concatenate(out))


_NUMBER_WORDS, _UNITS, _FIRST_NAMES = (_hash_words([w.lower() for w in x]) for x in (NUMBER_WORDS, UNITS, FIRST_NAMES))
_PLACEHOLDER = np.array([0, 0x6E756D, 0x6E616D, 0x756E69], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


@dataclass
class Tokens:
    """Of a chunk: the plain tokens, and those that templates keep with their class."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # first token of each row
    plain: np.ndarray  # hashes
    kept: np.ndarray  # tokens in templates
    kept_row: np.ndarray
    template: np.ndarray  # hashes
    kind: np.ndarray  # of the kept tokens


def tokens(raw: np.ndarray, at: np.ndarray) -> Tokens:
    """Runs of letters or of digits; their classes by shape, neighbours and word lists."""
    n = len(raw)
    ink = ~_OUT[raw]
    digit = _DIGIT[raw]
    first, last = ink.copy(), ink.copy()
    if n:
        split = digit[1:] != digit[:-1]
        first[1:] &= ~ink[:-1] | split
        last[:-1] &= ~ink[1:] | split
        cuts = at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts], last[cuts - 1] = ink[cuts], ink[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(start, at)
    h = _text.hash_spans(raw, start, end, _text.FOLD)
    m = len(start)
    kind = np.zeros(m, np.int8)
    if m:
        opening = np.zeros(m, bool)
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        opening[1:] = stops[start[1:]] > stops[end[:-1]]
        opening[row[:-1][np.diff(row) > 0]] = True
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])
        b0, b1, b2 = padded[start], padded[start + 1], padded[start + 2]
        ascii_capital = (b0 >= 65) & (b0 <= 90)
        latin_capital = (b0 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x9E) & (b1 != 0x97)
        after = np.where(latin_capital, b2, b1)
        longer = end - start > np.where(latin_capital, 2, 1)
        title = (ascii_capital | latin_capital) & longer & ~((after >= 65) & (after <= 90))
        kind[title & (~opening | _among(h, _FIRST_NAMES))] = NAME
        kind[_DIGIT[raw[start]] | _among(h, _NUMBER_WORDS)] = NUMBER
        head = np.zeros(m, bool)
        head[row[:-1][np.diff(row) > 0]] = True
        unit = np.zeros(m, bool)
        unit[1:] = (kind[:-1] == NUMBER) & ~head[1:]
        kind[unit & _among(h, _UNITS)] = UNIT
        again = np.zeros(m, bool)
        again[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME)) & ~head[1:]
        kept = np.flatnonzero(~again)
    else:
        kept = np.zeros(0, np.int64)
    k = kind[kept]
    return Tokens(start, end, row, h, kept, np.searchsorted(kept, row), np.where(k > 0, _PLACEHOLDER[k], h[kept]), k)


def values(raw: np.ndarray, t: Tokens) -> np.ndarray:
    """A hash of the text of each kept token, with the tokens merged into it."""
    if not len(t.kept):
        return np.zeros(0, np.uint64)
    last = np.append(t.kept[1:], len(t.start)) - 1
    of = np.searchsorted(t.row, t.kept, "right")  # a row's last kept token ends with the row
    return _text.hash_spans(raw, t.start[t.kept], t.end[np.minimum(last, t.row[of] - 1)])


def digest(x: bytes) -> tuple[int, int]:
    """128 bits, as two longs."""
    h = hashlib.blake2b(x, digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def long(x: list | np.ndarray) -> pa.Array:
    return pa.array(x, pa.int64()) if isinstance(x, list) else pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


SLOTS = [f"v{i}" for i in range(WINDOW)]
ITEM = "item_id long, which int, c1 long, c2 long, p1 long, p2 long, width int, h long, at long, " + ", ".join(f"{v} long" for v in SLOTS)
HIT = "doc_id long, k1 long, k2 long, which int, h long, at long, " + ", ".join(f"{v} long" for v in SLOTS)
PLAIN, TEMPLATE = 0, 1


def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per window of an item: its class (c1, c2) and that of its plain tokens, the window's place, and which values are in its slots, numbered in order."""
    names = [c.split()[0] for c in ITEM.split(", ")]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for lo, _, raw, at in _text.chunks(batch.column(1)):
            t, out = tokens(raw, at), []
            held = values(raw, t)
            h, first = _text.sequences(t.plain, t.row, WINDOW)
            g, gfirst = _text.sequences(t.template, t.kept_row, WINDOW)
            for r in range(len(at) - 1):
                a, b = t.kept_row[r], t.kept_row[r + 1]
                p = digest(t.plain[t.row[r] : t.row[r + 1]].tobytes())
                slot = t.kind[a:b] != WORD
                _, where, same = np.unique(held[a:b][slot], return_index=True, return_inverse=True)
                pattern = np.zeros(b - a, np.int64)
                pattern[slot] = np.argsort(np.argsort(where))[same] + 1
                c = digest(t.template[a:b].tobytes() + pattern.tobytes())
                width = int(min(WINDOW, t.row[r + 1] - t.row[r]))
                out += [(ids[lo + r], PLAIN, *p, *p, width, x, 0, *[0] * WINDOW) for x in np.unique(h[first[r] : first[r + 1]]).view(np.int64).tolist()]
                width = int(min(WINDOW, b - a))
                words = [int((t.kind[a + j : a + j + width] == WORD).sum()) for j in range(gfirst[r + 1] - gfirst[r])]
                telling = min(PLAIN_WORDS, max(words, default=0))
                for j, x in enumerate(g[gfirst[r] : gfirst[r + 1]].view(np.int64).tolist()):
                    if words[j] >= telling > 0:
                        out.append((ids[lo + r], TEMPLATE, *c, *p, width, x, j, *pattern[j : j + width].tolist(), *[0] * (WINDOW - width)))
            columns = [[x[i] for x in out] for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) if n in ("which", "width") else long(x) for n, x in zip(names, columns, strict=True)], names=names)


#: Bits of a window's hash, from these places on, that name its bits in a bitmap, and the bitmap's size, at most: 16 MB.
PROBES = (0, 18, 37)
MOST_BITS = 1 << 27


class Known:
    """A Bloom filter of window hashes. It may name others, never miss one; a fuller one only lets more rows through."""

    def __init__(self, windows: DataFrame) -> None:
        n = windows.count()
        self.bits = min(MOST_BITS, max(1 << 12, 1 << (128 * n).bit_length()))
        bit = windows.select(F.explode(F.array(*[F.shiftrightunsigned("h", p).bitwiseAND(F.lit(self.bits - 1)) for p in PROBES])).alias("b"))
        # at most bits / 64 rows
        words = bit.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("x")).toArrow()
        self.words = np.zeros(self.bits // 64, np.int64)
        self.words[words.column("w").to_numpy()] = words.column("x").to_numpy()

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        where = np.arange(len(h))
        for p in PROBES:
            at = ((h[where] >> np.uint64(p)) & np.uint64(self.bits - 1)).astype(np.int64)
            where = where[(self.words[at >> 6] >> (at & 63)) & 1 > 0]
        out[where] = True
        return out


def text_keys(column: pa.Array) -> list[tuple[int, int] | None]:
    return [None if x is None else digest(x.encode()) for x in column.to_pylist()]


def hits(batches: Iterator[pa.RecordBatch], widths: list[tuple[int, int]], known: Known, lead: Known) -> Iterator[pa.RecordBatch]:
    """Of texts with a leading window: a row (doc_id, text's key) each, and once for a text its windows that items may have."""
    names = [c.split()[0] for c in HIT.split(", ")]
    seen: set[tuple[int, int]] = set()

    def rows(n: int, **given: np.ndarray | list) -> pa.RecordBatch:
        cols = [given.get(c, np.zeros(n, np.int64)) for c in names]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x), pa.int32()) if c == "which" else long(x) for c, x in zip(names, cols, strict=True)], names=names)

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for lo, end, raw, at in _text.chunks(batch.column(1)):
            t, n = tokens(raw, at), end - lo
            keep, found = np.zeros(n, bool), []
            for which, width in widths:
                h, first = _text.sequences(t.plain, t.row, width) if which == PLAIN else _text.sequences(t.template, t.kept_row, width)
                hit = np.flatnonzero(known(h))
                row = np.searchsorted(first, hit, "right") - 1
                keep[row[lead(h[hit])]] = True
                found.append((which, width, h, first, hit, row))
            if not keep.any():
                continue
            keys = [digest(raw[at[r] : at[r + 1]].tobytes()) if keep[r] else (0, 0) for r in range(n)]
            some = np.flatnonzero(keep)
            yield rows(len(some), doc_id=[ids[lo + r] for r in some], k1=[keys[r][0] for r in some], k2=[keys[r][1] for r in some], which=np.full(len(some), -1))
            for r in some:
                keep[r] = keys[r] not in seen
                seen.add(keys[r])
            k = np.array(keys, np.int64)
            held = values(raw, t)
            slot = np.where(t.kind != WORD, held, np.uint64(0))
            for which, width, h, first, hit, row in found:
                own = keep[row]
                hit, row = hit[own], row[own]
                if which == PLAIN:  # how often doesn't matter
                    _, once = np.unique(np.stack([row.astype(np.uint64), h[hit]]), axis=1, return_index=True)
                    hit, row = hit[once], row[once]
                place = hit - first[row]
                given = {}
                if which == TEMPLATE:
                    for i in range(width):
                        j = np.minimum(t.kept_row[row] + place + i, len(slot) - 1)
                        given[SLOTS[i]] = np.where(t.kept_row[row] + place + i < t.kept_row[row + 1], slot[j], np.uint64(0))
                for a in range(0, len(hit), 100_000):
                    z = slice(a, a + 100_000)
                    yield rows(
                        len(hit[z]), k1=k[row[z], 0], k2=k[row[z], 1], which=np.full(len(hit[z]), which), h=h[hit[z]], at=place[z] if which == TEMPLATE else np.zeros(len(hit[z]), np.int64), **{c: x[z] for c, x in given.items()}
                    )


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Rows of all windows of all items with tokens: item_id, which, class (c1, c2), plain class (p1, p2), width, h, at, values."""
    own = small_batches(benchmark).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return cut(own.where("text is not null").mapInArrow(item_rows, ITEM))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """The members of the classes: item_id, plain_class and template_class, each by its least item_id. Items without tokens, or without template windows that tell, have none."""
    rows = item_windows(benchmark)
    least = rows.groupBy("which", "c1", "c2").agg(F.min("item_id").alias("least"))
    of = rows.select("item_id", "which", "c1", "c2").distinct().join(least, ["which", "c1", "c2"])
    return of.groupBy("item_id").agg(F.min(F.when(F.col("which") == PLAIN, F.col("least"))).alias("plain_class"), F.min(F.when(F.col("which") == TEMPLATE, F.col("least"))).alias("template_class"))


class Search:
    """The pairs of a text and a class of items that it holds, and the documents with such texts."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, least: float) -> None:
        self.docs, self.least = docs, least
        items = item_windows(benchmark)
        cls, win = ["which", "c1", "c2"], ["which", "h"]
        self.classes = items.select(*cls, "item_id").distinct().groupBy(*cls).agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("items"))
        self.templates = items.where(F.col("which") == TEMPLATE).select("p1", "p2", "c1", "c2").distinct()
        windows = items.select(*cls, "width", "h", "at", *SLOTS).distinct()
        # the rarest windows of a class, one more than a document may lack; at most an item's windows in a group
        of_class = windows.select(*cls, "h").distinct()
        often = of_class.groupBy(*win).agg(F.count(F.lit(1)).alias("often"))
        ranked = of_class.join(often, win).withColumn("rank", F.row_number().over(Window.partitionBy(*cls).orderBy("often", "h")))
        size = of_class.groupBy(*cls).agg(F.count(F.lit(1)).alias("size"))
        lead = F.col("rank") <= F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1
        self.windows = cut(windows.join(ranked.select(*cls, "h", "rank"), [*cls, "h"]).join(size, cls).withColumn("lead", lead).drop("rank"))
        self.found = self.search()

    def search(self) -> DataFrame:
        """Documents with windows of items, and the windows."""
        widths = sorted((r["which"], r["width"]) for r in self.windows.select("which", "width").distinct().collect())  # ten at most
        known, lead = Known(self.windows), Known(self.windows.where("lead"))
        own = small_batches(self.docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return cut(own.mapInArrow(lambda batches: hits(batches, widths, known, lead), HIT))

    def pairs(self) -> DataFrame:
        """k1, k2 (the text), which, c1, c2 (the class), coverage and consistency of the classes that a text holds."""
        key, cls = ["k1", "k2"], ["which", "c1", "c2"]
        place = [*key, "which", "h", "at"]
        found = self.found.where("which >= 0").select(*place, *SLOTS).dropDuplicates(place)
        lead = self.windows.where("lead").select(*cls, "h").distinct()
        candidates = found.select(*key, "which", "h").distinct().join(lead, ["which", "h"]).select(*key, *cls).distinct()
        wanted = self.windows.select(*cls, "h", "size", "width", F.col("at").alias("j"), *[F.col(v).alias(f"i{v}") for v in SLOTS])
        met = cut(candidates.join(wanted, cls).join(found, [*key, "which", "h"]))
        met = met.join(met.groupBy(*key, *cls).agg(F.countDistinct("h").alias("n"), F.first("size").alias("of")).where(F.col("n") >= self.least * F.col("of") - 1e-9).select(*key, *cls, "n"), [*key, *cls])
        plain = met.where(F.col("which") == PLAIN).select(*key, *cls, (F.col("n") / F.col("size")).alias("coverage"), F.lit(1.0).alias("consistency")).distinct()
        return plain.unionByName(self.aligned(met.where(F.col("which") == TEMPLATE)))

    def aligned(self, met: DataFrame) -> DataFrame:
        """Template classes along the alignment with the most windows, give or take a window's length; of short items along any."""
        by = ["k1", "k2", "which", "c1", "c2"]
        met = met.withColumn("shift", F.col("at") - F.col("j"))
        best = met.groupBy(*by, "shift").agg(F.countDistinct("j").alias("windows")).groupBy(*by).agg(F.min(F.struct(-F.col("windows"), "shift")).getField("shift").alias("best"))
        short = F.col("width") < WINDOW
        way = F.when(short, F.col("shift")).otherwise(F.col("best"))
        lines = cut(met.join(best, by).where(short | (F.abs(F.col("shift") - F.col("best")) <= WINDOW)).withColumn("way", way))
        by = [*by, "way"]
        covered = lines.groupBy(*by).agg((F.countDistinct("h") / F.first("size")).alias("coverage"))
        slots = F.array(*[F.struct((F.col("j") + i).alias("place"), F.col(f"iv{i}").alias("mine"), F.col(f"v{i}").alias("other")) for i in range(WINDOW)])
        places = (
            lines.withColumn("x", F.explode(slots)).where("x.mine > 0")
            .groupBy(*by, "x.place", "x.mine").agg(F.min(F.struct(F.abs(F.col("shift") - F.col("way")).alias("far"), F.col("x.other").alias("other"))).getField("other").alias("other"))
        )
        exchanged = places.groupBy(*by, "mine", "other").agg(F.count(F.lit(1)).alias("n"))
        # an exchange counts if it's the most common one of both values
        one = exchanged.groupBy(*by, "mine").agg(F.max(F.struct("n", "other")).getField("other").alias("other"))
        two = exchanged.groupBy(*by, "other").agg(F.max(F.struct("n", "mine")).getField("mine").alias("mine"))
        kept = exchanged.join(one, [*by, "mine", "other"]).join(two, [*by, "mine", "other"]).groupBy(*by).agg(F.sum("n").alias("kept"))
        rate = exchanged.groupBy(*by).agg(F.sum("n").alias("slots")).join(kept, by, "left").select(*by, (F.coalesce("kept", F.lit(0)) / F.col("slots")).alias("consistency"))
        every = covered.join(rate, by, "left").select(*by, "coverage", F.coalesce("consistency", F.lit(1.0)).alias("consistency")).where(F.col("coverage") >= self.least - 1e-9)
        return every.groupBy("k1", "k2", "which", "c1", "c2").agg(F.max(F.struct("consistency", "coverage")).alias("x")).select("k1", "k2", "which", "c1", "c2", "x.coverage", "x.consistency")

    def held(self) -> DataFrame:
        """k1, k2, item_id, items, coverage, template_coverage, slot_consistency, kind."""
        pairs, key = cut(self.pairs()), ["k1", "k2"]
        exact, like = pairs.where(F.col("which") == PLAIN), pairs.where(F.col("which") == TEMPLATE)
        # the templates of the items that a text holds exactly
        own = exact.select(*key, F.col("c1").alias("p1"), F.col("c2").alias("p2")).join(self.templates, ["p1", "p2"])
        template = own.join(like.select(*key, "c1", "c2", "coverage"), [*key, "c1", "c2"]).groupBy(*key, "p1", "p2").agg(F.max("coverage").alias("template_coverage"))
        exact = exact.join(template.withColumnsRenamed({"p1": "c1", "p2": "c2"}), [*key, "c1", "c2"], "left").withColumn("template_coverage", F.coalesce("template_coverage", F.lit(0.0)))
        changed = like.where(F.col("consistency") >= self.least - 1e-9).join(own.select(*key, "c1", "c2").distinct(), [*key, "c1", "c2"], "left_anti")
        names = [*key, "which", "c1", "c2", "coverage", "template_coverage", "consistency", "kind"]
        exact = exact.withColumn("kind", F.lit("exact")).select(*names)
        changed = changed.withColumn("template_coverage", F.col("coverage")).withColumn("coverage", F.lit(0.0)).withColumn("kind", F.lit("reparameterised")).select(*names)
        return exact.unionByName(changed).join(self.classes, ["which", "c1", "c2"]).select(*key, "item_id", "items", "coverage", "template_coverage", F.col("consistency").alias("slot_consistency"), "kind")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The benchmark items that documents hold.

    docs: doc_id, text; benchmark: item_id, text; further columns are ignored. Returns a row for each pair of a document and a
    class of items of which it holds at least ``least`` of the distinct windows: doc_id, item_id (the least of the class), items (how
    many the class has), coverage (of plain windows; 0 if too few), template_coverage (0 if too low), slot_consistency and
    kind. Kind ``exact``: the class is of items with the same tokens. ``reparameterised``: of items with the same template and
    the same pattern of equal values, none of which the document holds exactly; ``item_classes`` has the members. An
    item of fewer than five tokens is one window of as many, which a document may hold anywhere. Null, empty and wordless
    ones hold nothing and are held by nothing. Repeated documents give a row each, repeated items are one. Ties between
    alignments go to the earliest. Empty tables give no rows. Only windows that items may have are shuffled."""
    search = Search(docs, benchmark, least)
    return search.found.where("which < 0").select("doc_id", "k1", "k2").join(search.held(), ["k1", "k2"]).drop("k1", "k2")


def without_items(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows whose text holds an item, as ``decontaminate`` finds them.

    Null, empty and wordless texts stay, and so does everything if the benchmark is empty. Repeated rows go or stay together. Of other
    columns, names may be any. Rows stay where they are but for those that are to go, and few others."""
    bad = cut(Search(docs, benchmark, least).held().select("k1", "k2").distinct())
    named, names = IdFilter(bad, "k1"), docs.columns
    at, mark = names.index("text"), ["", ""]
    for i in range(2):
        mark[i] = f"text_key{i}"
        while mark[i].lower() in {x.lower() for x in names}:
            mark[i] += "_"

    def meant(batch: pa.RecordBatch) -> tuple[np.ndarray, list]:
        keys = text_keys(batch.column(at).cast(pa.string()))
        known = np.array([k is not None for k in keys], bool)
        return known & named(pa.array([k[0] if k else 0 for k in keys], pa.int64())), keys

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~meant(batch)[0]))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, keys = meant(batch)
            marks = [pa.array([k[i] if k else None for k in keys], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*names, *mark]).filter(pa.array(some))

    own = small_batches(docs)
    marked = own.mapInArrow(others, StructType([*docs.schema.fields, *[StructField(m, LongType()) for m in mark]]))
    stay = marked.join(bad.select(F.col("k1").alias(mark[0]), F.col("k2").alias(mark[1])), mark, "left_anti").select(*[F.col(f"`{c}`") for c in names])
    return own.mapInArrow(alone, docs.schema).unionByName(stay)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_benchmark_decontamination": op1_benchmark_decontamination}
SQL: dict[str, str] = {}
