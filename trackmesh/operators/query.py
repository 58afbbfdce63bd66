"""Subject queries: conjunctive, Boolean, by keywords, in space, ranked and paged."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmesh.functions import geometry as g
from trackmesh.functions.scalars import contains_run


@dataclass(frozen=True)
class SubjectQuery:
    """All parts given must hold. Sample parts prune samples; zone, route and dwell parts look at all of a subject's stays."""

    subject_ids: tuple[int, ...] = ()
    source_id: int | None = None
    start_ns: int | None = None
    end_ns: int | None = None
    min_confidence: float | None = None
    zone: int | None = None
    then: tuple[int, int, int] | None = None  # zone, later zone, within_ns (0: any time)
    route: tuple[int, ...] = ()
    min_dwell_ns: int | None = None
    near: tuple[float, float, float, float] | None = None  # left, top, right, bottom
    order: str = "subject_id"  # or sample_count, dwell
    offset: int = 0
    limit: int = 0  # 0: all


def _sample_parts(q: SubjectQuery) -> list[Column]:
    """The conditions that a sample must meet."""
    parts = [F.col("subject_id").isin(list(q.subject_ids))] if q.subject_ids else []
    parts += [F.col("source_id") == q.source_id] if q.source_id is not None else []
    parts += [F.col("pts_ns") >= q.start_ns] if q.start_ns is not None else []
    parts += [F.col("pts_ns") <= q.end_ns] if q.end_ns is not None else []
    parts += [F.col("confidence") >= q.min_confidence] if q.min_confidence is not None else []
    return parts + ([g.overlaps(g.box(), g.literal_box(*q.near))] if q.near is not None else [])


def _sample_filter(samples: DataFrame, q: SubjectQuery) -> DataFrame:
    return reduce(DataFrame.filter, _sample_parts(q), samples.filter("subject_id is not null"))


def then_seen(stays: DataFrame, first: int, later: int, within_ns: int = 0) -> DataFrame:
    """Subjects with a stay in one zone that ends before (or as) a stay in another starts.

    A fold over each zone's extremes where any time will do; with a limit, the nearest end before each start decides.
    """
    pair = stays.filter(F.col("zone_id").isin(first, later))
    if within_ns == 0:
        ends = F.min(F.when(F.col("zone_id") == first, F.col("end_ns")))
        starts = F.max(F.when(F.col("zone_id") == later, F.col("start_ns")))
        return pair.groupBy("subject_id").agg(ends.alias("e"), starts.alias("s")).filter("s >= e").select("subject_id")
    a = pair.filter(F.col("zone_id") == first).select("subject_id", "end_ns")
    b = pair.filter(F.col("zone_id") == later).select("subject_id", "start_ns")
    return a.join(b, "subject_id").filter((F.col("start_ns") >= F.col("end_ns")) & (F.col("start_ns") - F.col("end_ns") <= within_ns)).select("subject_id").distinct()


def subject_query(samples: DataFrame, stays: DataFrame, routes: DataFrame, q: SubjectQuery) -> DataFrame:
    """One row per subject: sample_count, max_confidence (0 at least), first_pos, n_stays, dwell_ns; ordered and paged.

    Samples that do not meet the query are not counted.
    """
    hits, holds = _flagged(_sample_filter(samples, q), stays, routes, [replace(q, subject_ids=(), source_id=None, start_ns=None, end_ns=None, min_confidence=None, near=None)])
    order = {"subject_id": ["subject_id"], "sample_count": [F.desc("sample_count"), "first_pos"], "dwell": [F.desc("dwell_ns"), "first_pos"]}[q.order]
    return page(hits.filter(holds[0]).select(*HIT).orderBy(*order), q.offset, q.limit)


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of ordered rows; limit 0 is all of them."""
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit else rows


# --- Boolean trees: ("pred", SubjectQuery), ("and", [...]), ("or", [...]), ("not", node) -----------------------------


def _leaves(node: tuple) -> list[SubjectQuery]:
    kind, arg = node
    return [arg] if kind == "pred" else [q for n in ([arg] if kind == "not" else arg) for q in _leaves(n)]


HIT = ("subject_id", "sample_count", "max_confidence", "first_pos", "n_stays", "dwell_ns")


def _flagged(samples: DataFrame, stays: DataFrame, routes: DataFrame, leaves: list[SubjectQuery]) -> tuple[DataFrame, list[Column]]:
    """A row for each subject of the samples, and for each leaf the condition that it meets it.

    Samples, stays and routes are aggregated once for all leaves; only a 'then' within a time needs a join of its own.
    """
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    hits = {f"s{i}": flag(reduce(Column.__and__, parts)) for i, q in enumerate(leaves) if (parts := _sample_parts(q))}
    seen = {f"z{i}": flag(F.col("zone_id") == q.zone) for i, q in enumerate(leaves) if q.zone is not None}
    for i, q in enumerate(leaves):
        if q.then and not q.then[2]:
            first, later, _ = q.then
            seen[f"t{i}"] = F.max(F.when(F.col("zone_id") == later, F.col("start_ns"))) >= F.min(F.when(F.col("zone_id") == first, F.col("end_ns")))
    runs = {f"r{i}": flag(contains_run(F.col("zones"), list(q.route))) for i, q in enumerate(leaves) if q.route}
    named = lambda columns: [c.alias(n) for n, c in columns.items()]
    rows = samples.filter("subject_id is not null").groupBy("subject_id").agg(F.count("*").alias("sample_count"), F.greatest(F.max("confidence"), F.lit(0.0)).alias("max_confidence"), F.min("sample_id").alias("first_pos"), *named(hits))
    rows = rows.join(stays.groupBy("subject_id").agg(F.count("*").alias("n_stays"), F.sum("duration_ns").alias("dwell_ns"), *named(seen)), "subject_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_stays", "dwell_ns")})
    if runs:
        rows = rows.join(routes.groupBy("subject_id").agg(*named(runs)), "subject_id", "left")
    flags = [*hits, *seen, *runs]
    for i, q in enumerate(leaves):
        if q.then and q.then[2]:
            rows = rows.join(then_seen(stays, *q.then).withColumn(f"t{i}", F.lit(True)), "subject_id", "left")
            flags.append(f"t{i}")

    def meets(i: int, q: SubjectQuery) -> Column:
        parts = [F.coalesce(f"{kind}{i}", F.lit(False)) for kind in "sztr" if f"{kind}{i}" in flags]
        return reduce(Column.__and__, parts, F.col("dwell_ns") >= q.min_dwell_ns if q.min_dwell_ns is not None else F.lit(True))

    return rows, [meets(i, q) for i, q in enumerate(leaves)]


def execute_ast(node: tuple, samples: DataFrame, stays: DataFrame, routes: DataFrame) -> DataFrame:
    """Hits of a tree's subjects, with all their samples: one filter over a flag for each leaf. An empty 'and' is every
    subject, an empty 'or' none."""
    leaves = list(dict.fromkeys(_leaves(node)))
    rows, meets = _flagged(samples, stays, routes, leaves)

    def holds(node: tuple) -> Column:
        kind, arg = node
        if kind == "pred":
            return meets[leaves.index(arg)]
        if kind == "not":
            return ~holds(arg)
        return reduce(Column.__and__ if kind == "and" else Column.__or__, map(holds, arg), F.lit(kind == "and"))

    return rows.filter(holds(node)).select(*HIT).orderBy("subject_id")


def hit_evidence(hits: DataFrame, samples: DataFrame, stays: DataFrame, routes: DataFrame, q: SubjectQuery = SubjectQuery()) -> DataFrame:
    """What the hits rest on, a row each (subject_id, kind, ref, start_ns, end_ns): samples that meet the query, all stays, all routes.

    ref is the sample's id, the stay's zone, or null. Rows and not arrays, so that a subject of many samples is no single row.
    """
    ids = hits.select("subject_id")
    row = lambda df, kind, ref, start, end: df.join(ids, "subject_id", "left_semi").select("subject_id", F.lit(kind).alias("kind"), ref.cast("long").alias("ref"), F.col(start).alias("start_ns"), F.col(end).alias("end_ns"))
    found = [row(_sample_filter(samples, q), "sample", F.col("sample_id"), "pts_ns", "pts_ns"), row(stays, "stay", F.col("zone_id"), "start_ns", "end_ns"), row(routes, "route", F.lit(None), "start_ns", "end_ns")]
    return reduce(DataFrame.unionByName, found)


# --- keywords ------------------------------------------------------------------------------------------------------


@dataclass
class Parsed:
    node: tuple
    warnings: list[str] = field(default_factory=list)


#: Words without meaning in a query.
NOISE = ("the", "a", "an", "who", "that", "were", "was", "persons", "people", "find", "show", "all")


def parse_keywords(text: str) -> Parsed:
    """'or' binds looser than 'and'; there are no parentheses and no 'not'. All clauses of a part must hold.

    Clauses: [seen] on source|camera N, source N; [in] zone N; then [zone] A then [zone] B [within NS]; route [zone] A B ...;
    subject N[, M ...]; min confidence X, confidence >= X; min dwell NS, dwell >= NS; during NS NS; near box L T R B.
    Unknown words become warnings; a clause of which a number is missing is an error, as is a text without any clause.
    """
    if not text.split():
        raise ValueError("the query is empty")
    warnings: list[str] = []
    text = " ".join(text.lower().split())
    ors = [("and", [_clauses(part.split(), warnings) for part in either.split(" and ")]) for either in text.split(" or ")]
    ors = [ands[1][0] if len(ands[1]) == 1 else ands for ands in ors]
    return Parsed(ors[0] if len(ors) == 1 else ("or", ors), warnings)


def _clauses(words: list[str], warnings: list[str]) -> tuple:
    """The node of a part without 'and' or 'or'."""
    at, found = 0, []

    def eat(*options: str) -> bool:
        """Go past the next word if it is one of these."""
        nonlocal at
        hit = at < len(words) and words[at] in options
        at += hit
        return hit

    def number(kind=int, most: float = 2**63):
        nonlocal at
        try:
            value = kind(words[at])
        except (IndexError, ValueError):
            raise ValueError(f"a number is missing after: {' '.join(words[:at])}") from None
        if not abs(value) < most:
            raise ValueError(f"out of range: {words[at]}")
        at += 1
        return value

    def then() -> tuple[int, int, int]:
        eat("zone")
        first = number(most=2**16)
        if not eat("then"):
            raise ValueError(f"'then' is missing after: {' '.join(words[:at])}")
        eat("zone")
        return first, number(most=2**16), number() if eat("within") else 0

    def several(most: float) -> tuple[int, ...]:
        out = [number(most=most)]
        while at < len(words) and words[at].isdigit():
            out.append(number(most=most))
        return tuple(out)

    words = " ".join(words).replace(",", " ").split()
    while at < len(words):
        word, start = words[at], at
        at += 1
        if word in ("seen", "on", "source", "camera"):
            if (word in ("source", "camera")) or ((word == "on" or eat("on")) and eat("source", "camera")):
                found.append(SubjectQuery(source_id=number(most=2**32)))
                continue
        elif word == "zone" or (word == "in" and eat("zone")):
            found.append(SubjectQuery(zone=number(most=2**16)))
            continue
        elif word == "then":
            found.append(SubjectQuery(then=then()))
            continue
        elif word == "route":
            eat("zone")
            found.append(SubjectQuery(route=several(2**16)))
            continue
        elif word == "subject":
            found.append(SubjectQuery(subject_ids=several(2**63)))
            continue
        elif word in ("min", "confidence", "dwell"):
            what = word if word != "min" else words[at] if at < len(words) else ""
            if what in ("confidence", "dwell") and eat(*([what] if word == "min" else [">="])):
                found.append(SubjectQuery(min_confidence=number(float)) if what == "confidence" else SubjectQuery(min_dwell_ns=number()))
                continue
        elif word == "during":
            found.append(SubjectQuery(start_ns=number(), end_ns=number()))
            continue
        elif word == "near" and eat("box"):
            found.append(SubjectQuery(near=tuple(number(float) for _ in range(4))))
            continue
        elif word in NOISE:
            continue
        at = start + 1
        warnings.append(f"unknown word: {word}")
    if not found:
        raise ValueError("no predicate in the query")
    preds = [("pred", q) for q in found]
    return preds[0] if len(preds) == 1 else ("and", preds)


# --- space and rank -------------------------------------------------------------------------------------------------


def spatial_query(samples: DataFrame, region: tuple[float, float, float, float], q: SubjectQuery = SubjectQuery()) -> DataFrame:
    """Samples whose box overlaps a region, by IoU with it."""
    rows = _sample_filter(samples, q) if q != SubjectQuery() else samples
    area = g.literal_box(*region)
    rows = rows.filter(g.overlaps(g.box(), area)).withColumn("iou", g.iou(g.box(), area))
    return page(rows.orderBy(F.desc("iou"), "sample_id"), q.offset, q.limit)


def overlap_join(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes of two tables that overlap: an equi-join on grid cells, kept in the first common cell."""

    def cells(df: DataFrame, p: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / cell)
        df = df.select(*[F.col(c).alias(p + c) for c in df.columns])
        return df.withColumn("cx", F.explode(F.sequence(at(p + "left"), at(p + "right")))).withColumn("cy", F.explode(F.sequence(at(p + "top"), at(p + "bottom"))))

    met = cells(a, "a_").join(cells(b, "b_"), ["cx", "cy"]).filter(g.overlaps(g.box("a_"), g.box("b_")))
    first = (F.col("cx") == F.floor(F.greatest("a_left", "b_left") / cell)) & (F.col("cy") == F.floor(F.greatest("a_top", "b_top") / cell))
    return met.filter(first).drop("cx", "cy")


def rank_subjects(samples: DataFrame) -> DataFrame:
    """Subjects by number of samples, then span, then id."""
    found = samples.filter("subject_id is not null").groupBy("subject_id").agg(F.count("*").alias("sample_count"), F.countDistinct("source_id").alias("source_count"), (F.max("pts_ns") - F.min("pts_ns")).alias("span_ns"))
    return found.orderBy(F.desc("sample_count"), F.desc("span_ns"), "subject_id")
