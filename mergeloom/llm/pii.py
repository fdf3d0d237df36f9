"""Personal data by weak supervision, in DataFrame operations alone.

Patterns propose candidate spans. Five labelers vote on each (+1 personal, -1 not, 0 no opinion): the strict
pattern with its checks, the structure of the digits or letters, gazetteers, the words before
and the characters around. Votes are counted by pattern over the whole corpus, which is a bounded table;
expectation-maximisation on it estimates how reliable each labeler is for each kind, and a logistic span
classifier is trained on its posteriors. Candidates that the classifier accepts are
added to the base spans, which always stay.

Matches come from one regular expression per kind. Their places follow from the lengths of the pieces between
them. Repeats are possessive, so the patterns neither recurse nor back-track over long runs, and they
match what the plain ones match."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.session import table

KINDS = ["email", "ip", "card", "phone", "name"]
N_BASE = 4

# A pattern that starts inside a run of its own characters can't match there unless the last match ended there (\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser candidates; those that overlap a base span are dropped.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,24}(?: [A-Z][a-z]{1,24})?(?![A-Za-z])",
}
# Gazetteers.
TOP_DOMAINS = "com org net edu gov mil int info io co uk de fr es it nl eu us ca au ch at be se no dk fi pl pt ru cn jp kr in br mx".split()
FIRST_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Paul Maria Laura Julia Martin Lukas Sophie Marie Pierre Jean Jose Carlos Carmen Ana".split()
CUES = {
    "email": "mail|contact|write|address|reach|courriel|correo",
    "ip": "ip|host|server|address|login|from",
    "card": "card|visa|master|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|cell|contact|ruf",
    "name": "name|dear|by|from|sincerely|regards",
}
AGAINST = "version|isbn|issn|doi|order|invoice|build|release|section|figure|ref"

VOTES = ["strict", "structure", "gazetteer", "before", "around"]
CONTEXT = 24


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, txt>> of the matches, in code points, end exclusive."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.expr("cast(array() as array<struct<start: int, end: int, txt: string>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("txt")))).alias("out"))

    zipped = F.filter(F.arrays_zip(between.alias("g"), matches.alias("m")), lambda x: x["m"].isNotNull())
    return F.aggregate(zipped, F.struct(F.lit(0).alias("pos"), empty.alias("out")), add, lambda acc: acc["out"])


def digits(txt: Column) -> Column:
    return F.regexp_replace(txt, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)
    double = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(back)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, back.substr(i, F.lit(1)).cast("int")).otherwise(F.element_at(double, back.substr(i, F.lit(1)).cast("int") + 1)),
    )
    return (F.length(number) > 0) & (total % 10 == 0)


def passes(kind: str, txt: Column) -> Column:
    """The checks that a base match must pass."""
    if kind == "ip":
        return F.forall(F.split(txt, r"\.", -1), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits(txt)).between(14, 19) & luhn(digits(txt))
    if kind == "phone":
        return F.length(digits(txt)).between(10, 15)
    return F.lit(True)


def votes(kind: str, text: Column, x: Column, base: bool) -> list[Column]:
    """One vote per labeler on the candidate ``x`` of ``text``."""
    txt, one, minus, none = x["txt"], F.lit(1), F.lit(-1), F.lit(0)
    if base:
        strict = F.when(passes(kind, txt), one).otherwise(minus)
    else:
        strict = none
    n = F.length(digits(txt))
    structure = {
        "email": F.when(F.length(txt).between(6, 254), one).otherwise(minus),
        "ip": F.when(txt.rlike(r"^(?:0|127|255)\."), none).when(F.length(txt) >= 9, one).otherwise(none),
        "card": F.when(luhn(digits(txt)), one).otherwise(minus),
        "phone": F.when(n.between(10, 15), one).otherwise(minus),
        "name": F.when(F.size(F.split(txt, " ")) >= 3, one).otherwise(none),
    }[kind]
    gazetteer = {
        "email": F.when(F.lower(F.regexp_extract(txt, r"([A-Za-z]+)[^A-Za-z]*$", 1)).isin(TOP_DOMAINS), one).otherwise(none),
        "ip": none,
        "card": F.when(digits(txt).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), one).otherwise(none),
        "phone": F.when(txt.rlike(r"^\+(?:1|3[0-9]|4[0-9]|[25-9])"), one).otherwise(none),
        "name": F.when(F.exists(F.split(txt, " "), lambda w: w.isin(FIRST_NAMES)), one).otherwise(none),
    }[kind]
    first = F.greatest(x["start"] - CONTEXT, F.lit(0))
    left = F.lower(text.substr(first + 1, x["start"] - first))
    before = F.when(left.rlike(rf"\b(?:{AGAINST})\b"), minus).when(left.rlike(rf"(?:{CUES[kind]})"), one).otherwise(none)
    edge = text.substr(x["end"] + 1, F.lit(1))
    around = F.when(edge.rlike(r"[\p{L}0-9_@]"), minus).otherwise(none)
    return [strict, structure, gazetteer, before, around]


SPAN = "array<struct<start: int, kind: int, end: int, base: boolean, votes: array<int>>>"


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start, then kind; base spans and others that overlap none."""
    nothing = F.expr(f"cast(array() as {SPAN})")
    has_digit = text.rlike("[0-9]")
    guard = {"email": F.contains(text, F.lit("@")), "ip": has_digit, "card": has_digit, "phone": F.contains(text, F.lit("+"))}
    loose_guard = {"email": text.rlike(r"[\[(](?:at|AT)[\])]"), "phone": has_digit, "name": text.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof)\. ")}

    def spans(kind: str, pattern: str, base: bool) -> Column:
        def span(x: Column) -> Column:
            good = passes(kind, x["txt"]) if base else F.lit(False)
            return F.struct(
                x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), good.alias("base"), F.array(*votes(kind, text, x, base)).alias("votes")
            )

        return F.transform(found(text, pattern), span)

    parts = [F.when(guard[k], spans(k, p, True)).otherwise(nothing) for k, p in BASE.items()]
    parts += [F.when(loose_guard[k], spans(k, p, False)).otherwise(nothing) for k, p in LOOSE.items()]
    return F.array_sort(F.concat(*parts))


def features(kind: np.ndarray, vote: np.ndarray) -> np.ndarray:
    """Per span: one, and for each kind and labeler whether it voted for and against."""
    out = np.zeros((len(kind), 1 + len(KINDS) * len(VOTES) * 2))
    out[:, 0] = 1
    for j in range(len(VOTES)):
        for sign, shift in ((1, 0), (-1, 1)):
            hit = vote[:, j] == sign
            out[np.flatnonzero(hit), 1 + (kind[hit] * len(VOTES) + j) * 2 + shift] = 1
    return out


def expectation_maximisation(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior that each pattern is personal data, reliabilities [kind, labeler, class, vote]).

    Each labeler votes -1, 0 or 1 with probabilities that depend on the true class. Smoothed by weak prior counts,
    under which a labeler is right more often than wrong."""
    start = np.tile(np.array([[4.0, 4.0, 2.0], [1.0, 4.0, 5.0]]), (len(KINDS), len(VOTES), 1, 1))
    rel, prior = start / start.sum(-1, keepdims=True), np.full(len(KINDS), 0.5)
    post = np.full(len(kind), 0.5)
    for _ in range(rounds):
        like = np.stack([np.log(rel[kind[:, None], np.arange(len(VOTES))[None, :], c, vote + 1]).sum(1) for c in (0, 1)])
        like += np.log(np.stack([1 - prior[kind], prior[kind]]))
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -60, 60)))
        got = start.copy()
        for c, w in ((0, count * (1 - post)), (1, count * post)):
            for j in range(len(VOTES)):
                np.add.at(got, (kind, j, c, vote[:, j] + 1), w)
        rel = got / got.sum(-1, keepdims=True)
        ones, alls = np.ones(len(KINDS)), np.full(len(KINDS), 2.0)
        np.add.at(ones, kind, count * post)
        np.add.at(alls, kind, count)
        prior = ones / alls
    return post, rel


def train(docs: DataFrame, text: str = "text") -> list[float]:
    """Weights of the span classifier. What reaches the driver is at most kinds x 3^labelers rows of counts."""
    rows = (
        docs.select(F.explode(candidates(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("s"))
        .groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()
    )
    if not rows:
        return [0.0] * (1 + len(KINDS) * len(VOTES) * 2)
    kind, vote, count = np.array([r["kind"] for r in rows]), np.array([r["votes"] for r in rows]), np.array([r["n"] for r in rows], float)
    post, _ = expectation_maximisation(kind, vote, count)
    x, weight = features(kind, vote), np.log1p(count)
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - post)) + 1e-2 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 9) for v in w]


def chance(x: Column, weights: list[float]) -> Column:
    """The classifier's probability for a candidate span."""
    table_ = F.array(*[F.lit(v) for v in weights])
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(len(VOTES) - 1)), F.lit(weights[0]),
        lambda acc, j: acc + F.when(F.element_at(x["votes"], j + 1) == 0, 0.0).otherwise(
            F.element_at(table_, ((x["kind"] * len(VOTES) + j) * 2 + F.when(F.element_at(x["votes"], j + 1) < 0, 1).otherwise(0) + 2))),
    )
    return 1 / (1 + F.exp(-total))


def accepted(spans: Column, weights: list[float], least: float = 0.5) -> Column:
    """Base spans, and candidates that the classifier accepts and that overlap no base span."""
    base = F.filter(spans, lambda x: x["base"])
    rest = F.filter(
        spans,
        lambda x: ~x["base"] & (F.element_at(x["votes"], 1) >= 0) & (chance(x, weights) >= least) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    return F.array_sort(F.concat(base, rest))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans that are already in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def personal_data(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Finds personal data in each whole text.

    docs: doc_id, text; further columns are ignored. Returns doc_id, ``base`` (the pattern matches that pass their
    checks) and ``spans`` (those and what the method adds), arrays of (start, kind, end, base, votes) in code points
    by start, then kind. A null or empty text has none. Repeated rows are judged each; an empty table gives no
    rows. Both passes over the texts stay where the rows are; only counts of vote patterns are shuffled."""
    weights = weights if weights is not None else train(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("c"))
    return own.select("doc_id", F.filter("c", lambda x: x["base"]).alias("base"), accepted(F.col("c"), weights).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one, to the last one's end."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def add(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] > acc["pos"], text.substr(acc["pos"] + 1, x["start"] - acc["pos"])).otherwise(F.lit(""))
        mark = F.when(x["start"] >= acc["pos"], F.element_at(names, x["kind"] + 1)).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.concat(acc["out"], gap, mark).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], text.substr(acc["pos"] + 1, F.length(text))))
    )


def redact(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[KIND]``, and ``n_chars``, if there, brought up to date.

    Null texts keep their n_chars; empty ones have 0. Of overlapping spans the first names the place, up to the last one's end. Repeated rows change alike.
    An empty table stays empty. Other columns may have any name."""
    weights = weights if weights is not None else train(docs)
    own = docs.withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text"), accepted(candidates(F.col("text")), weights))))
    if "n_chars" in docs.columns:
        own = own.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return own.select(*docs.columns)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:N_BASE])]
    return own.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op2_personal_data": op2_personal_data}
SQL: dict[str, str] = {}
