"""Baselines and detectors. Detectors yield (reason, subject_id, source_id, at_ns, score, severity)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trackmesh.functions import scalars as s
from trackmesh.operators import memory, pairs, ranks
from trackmesh.operators.patterns import gaps, met_in_all

INFINITE_SCORE = 100.0


@dataclass(frozen=True)
class StatConfig:
    z: float = 2.5
    min_samples: int = 5
    robust: bool = True
    change_point: float = 8.0
    by_day: bool = True
    rare_day: float = 0.08


#: The scopes that series are looked at in, and the column that parts them.
SCOPES = {"global": [], "subject": ["subject_id"], "source": ["source_id"]}


def mad(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Median and median absolute deviation by key, in two passes; without keys by rank, so that no task holds all rows."""
    if keys:
        med = df.groupBy(*keys).agg(F.median(value).alias("median"))
        return df.join(med, keys).groupBy(*keys).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    med = ranks.median(df, value)
    apart = df.crossJoin(F.broadcast(med)).select(F.abs(F.col(value) - F.col("median")).alias("apart"))
    return med.crossJoin(ranks.median(apart, "apart").withColumnRenamed("median", "mad"))


def _gated(c: Column, n: Column, least: int) -> Column:
    return F.when(n >= least, c)


def _subject_gaps(timed: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between a subject's events within a scope; those of unknown subject are one series."""
    return gaps(timed, tuple(dict.fromkeys([*keys, "subject_id"])))


def baseline(series: dict[str, DataFrame], config: StatConfig = StatConfig(), keys: list[str] | None = None) -> DataFrame:
    """One row (by key): dwell (mean, sd, median, MAD), positive gaps (mean, sd), hours (mean, sd), shares of the seven days.

    Statistics of fewer than min_samples values are null. With keys, rows without any that is known are left out.
    """
    keys = keys or []
    known = lambda df: df.dropna(subset=keys) if keys else df
    timed, durations = known(series["timed"]), known(series["durations"]).filter("duration_ns > 0")
    n, least = F.count("*"), config.min_samples
    gated = lambda c: _gated(c, n, least)
    dwell = durations.groupBy(*keys).agg(n.alias("dwell_n"), gated(F.avg("duration_ns")).alias("dwell_mean"), gated(F.stddev_pop("duration_ns")).alias("dwell_sd"))
    spread = mad(durations, "duration_ns", keys).withColumnsRenamed({"median": "_median", "mad": "_mad"})
    dwell = dwell.join(spread, keys) if keys else dwell.crossJoin(spread)
    enough = F.col("dwell_n") >= least
    dwell = dwell.withColumns({"dwell_median": F.when(enough, F.col("_median")), "dwell_mad": F.when(enough, F.col("_mad"))}).drop("_median", "_mad")
    gap = _subject_gaps(timed, keys).filter("gap_ns > 0").groupBy(*keys).agg(n.alias("gap_n"), gated(F.avg("gap_ns")).alias("gap_mean"), gated(F.stddev_pop("gap_ns")).alias("gap_sd"))
    hour, day = s.hour_of_day(F.col("at_ns")), s.day_of_week(F.col("at_ns"))
    hours = timed.groupBy(*keys).agg(n.alias("hour_n"), gated(F.avg(hour)).alias("hour_mean"), gated(F.stddev_pop(hour)).alias("hour_sd"), *[F.try_divide(F.count_if(day == d), n).alias(f"day_{d}") for d in range(7)])
    if not keys:
        return dwell.crossJoin(gap).crossJoin(hours)  # one row each
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("dwell_n", "gap_n", "hour_n")}
    return dwell.join(gap, keys, "full_outer").join(hours, keys, "full_outer").withColumns(counts).filter(F.greatest(*counts) >= least)


def _against(rows: DataFrame, base: DataFrame, keys: list[str], need: str) -> DataFrame:
    """rows beside their baseline, where it has what is needed."""
    base = base.filter(F.col(need).isNotNull())
    return rows.join(base, keys) if keys else rows.crossJoin(F.broadcast(base))  # one row


def _events(df: DataFrame, reason: str, score: Column, steps=s.Z_STEPS, subject="subject_id", source="source_id", at="at_ns") -> DataFrame:
    score = F.when(score == float("inf"), F.lit(INFINITE_SCORE)).otherwise(score)
    col = lambda c: F.lit(None).cast("long") if c is None else F.col(c).cast("long")
    return df.select(F.lit(reason).alias("reason"), col(subject).alias("subject_id"), col(source).alias("source_id"), col(at).alias("at_ns"), score.cast("double").alias("score"), s.severity(score, steps).alias("severity"))


def _over(rows: DataFrame, reason: str, z: Column, least: float, **places) -> DataFrame:
    return _events(rows.withColumn("z", z).filter(F.col("z") >= least), reason, F.col("z"), **places)


def detect_dwell(durations: DataFrame, base: DataFrame, config: StatConfig = StatConfig(), keys: list[str] | None = None) -> DataFrame:
    rows = _against(durations, base, keys or [], "dwell_mean")
    return _over(rows, "unusual_dwell", s.z_score(F.col("duration_ns"), F.col("dwell_mean"), F.col("dwell_sd")), config.z)


def detect_robust_dwell(durations: DataFrame, base: DataFrame, config: StatConfig = StatConfig(), keys: list[str] | None = None) -> DataFrame:
    rows = _against(durations, base, keys or [], "dwell_mad")
    return _over(rows, "robust_dwell", s.robust_z(F.col("duration_ns"), F.col("dwell_median"), F.col("dwell_mad")), config.z)


def detect_frequency(timed: DataFrame, base: DataFrame, config: StatConfig = StatConfig(), keys: list[str] | None = None) -> DataFrame:
    """Every gap, those of zero too."""
    rows = _against(_subject_gaps(timed, keys or []), base, keys or [], "gap_mean")
    return _over(rows, "unusual_frequency", s.z_score(F.col("gap_ns"), F.col("gap_mean"), F.col("gap_sd")), config.z)


def detect_time(timed: DataFrame, base: DataFrame, config: StatConfig = StatConfig(), keys: list[str] | None = None) -> DataFrame:
    rows = _against(timed, base, keys or [], "hour_mean")
    return _over(rows, "unusual_time", F.try_divide(s.hour_delta(s.hour_of_day(F.col("at_ns")).cast("double"), F.col("hour_mean")), F.greatest(F.col("hour_sd"), F.lit(0.5))), config.z)


def _last_gap(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    by = list(dict.fromkeys([*keys, "subject_id"]))
    return rows.groupBy(*by).agg(F.max_by("gap_ns", F.struct("at_ns", "event_id")).alias("gap_ns"), F.max("at_ns").alias("at_ns"), *more)


def detect_missing(timed: DataFrame, base: DataFrame, config: StatConfig = StatConfig(), keys: list[str] | None = None) -> DataFrame:
    """A subject's last gap, if it is longer than usual."""
    rows = _against(_last_gap(_subject_gaps(timed, keys or []), keys or []), base, keys or [], "gap_mean").filter("gap_ns > gap_mean")
    return _over(rows, "missing_expected", s.z_score(F.col("gap_ns"), F.col("gap_mean"), F.col("gap_sd")), config.z, source=None)


def detect_own_gaps(timed: DataFrame, config: StatConfig = StatConfig(), keys: list[str] | None = None) -> DataFrame:
    """A subject's last positive gap against its own median and MAD."""
    by = list(dict.fromkeys([*(keys or []), "subject_id"]))
    g = _subject_gaps(timed, keys or []).filter("gap_ns > 0")
    med = g.groupBy(*by).agg(F.median("gap_ns").alias("median"))
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]
    apart = g.alias("g").join(med.alias("m"), same).select("g.*", "median", F.abs(F.col("gap_ns") - F.col("median")).alias("apart"))
    rows = _last_gap(apart, keys or [], F.count("*").alias("n"), F.first("median").alias("median"), F.median("apart").alias("mad")).filter(F.col("n") >= config.min_samples)
    return _over(rows, "own_gap", s.robust_z(F.col("gap_ns"), F.col("median"), F.col("mad")), config.z, source=None)


def detect_sudden_change(durations: DataFrame, base: DataFrame, config: StatConfig = StatConfig(), keys: list[str] | None = None) -> DataFrame:
    """The mean of the latest min_samples rows against the baseline; the event is the latest row's."""
    keys, order = keys or [], ["at_ns", "subject_id", "duration_ns"]
    if keys:
        latest = durations.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*map(F.desc, order)))).filter(F.col("_n") <= config.min_samples)
    else:
        latest = durations.orderBy(*map(F.desc, order)).limit(config.min_samples)
    last = F.max(F.struct(*order)).alias("last")
    recent = latest.groupBy(*keys).agg(F.avg("duration_ns").alias("mean"), last, F.count("*").alias("n")).filter(F.col("n") >= config.min_samples)
    rows = _against(recent, base, keys, "dwell_mean").select("mean", "dwell_mean", "dwell_sd", "last.subject_id", "last.at_ns")
    return _over(rows, "sudden_change", s.z_score(F.col("mean"), F.col("dwell_mean"), F.col("dwell_sd")), config.z, source=None)


def detect_day(timed: DataFrame, base: DataFrame, config: StatConfig = StatConfig(), keys: list[str] | None = None) -> DataFrame:
    """Events on days of the week that are rare in the baseline."""
    shares = F.array(*[F.col(f"day_{d}") for d in range(7)])
    rows = _against(timed, base, keys or [], "hour_n").filter(F.col("hour_n") >= 2 * config.min_samples).withColumn("f", F.element_at(shares, s.day_of_week(F.col("at_ns")) + 1))
    return _over(rows.filter(F.col("f") <= config.rare_day), "unusual_day", F.least(F.lit(10.0), F.lit(0.5) / (F.col("f") + 1e-3)), config.z / 2)


def _summed(df: DataFrame, value: str) -> Column:
    """A column to sum: whole numbers as decimals, whose sums are exact and do not overflow however many rows there are."""
    kind = df.schema[value].dataType
    return F.col(value).cast("decimal(20,0)") if isinstance(kind, IntegralType) else F.col(value)


def _split_score(k: Column, left: Column, total: Column, n: Column) -> Column:
    left, total = left.cast("double"), total.cast("double")
    mean, r = total / n, n - k
    return F.abs(left / k - mean) * F.sqrt(k.cast("double")) + F.abs(F.try_divide(total - left, r) - mean) * F.sqrt(r.cast("double"))


def change_points(values: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The split of each series (four values at least) with the largest weighted departure of both sides' means; the first
    of equals. Without keys the whole table is one series, whose sums run over ranges of the first column of order."""
    rows = values.withColumns({"_one": F.lit(1).cast("long"), "_value": _summed(values, value)})
    sums = {"k": "_one", "left": "_value"}
    if keys:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*keys)
        rows = rows.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).withColumns({"total": F.sum("_value").over(whole), "n": F.count("*").over(whole)})
    else:
        totals = rows.agg(F.sum("_value").alias("total"), F.count("*").alias("n"))
        rows = ranks.running(rows, order[0], order[1:], sums).crossJoin(F.broadcast(totals))
    rows = rows.withColumn("_score", _split_score(F.col("k"), F.col("left"), F.col("total"), F.col("n")))
    top = F.max(F.when(F.col("k") < F.col("n"), F.struct("_score", (-F.col("k")).alias("early")))).alias("top")
    found = rows.filter("n >= 4").groupBy(*keys).agg(top).filter("top.early is not null")
    return found.select(*keys, (-F.col("top.early")).cast("long").alias("split"), F.col("top._score").alias("score"))


def detect_change_points(durations: DataFrame, config: StatConfig = StatConfig(), keys: list[str] | None = None) -> DataFrame:
    """The strongest split of a sequence of stays, if it is strong enough: the event is the first row after it."""
    keys, order = keys or [], ["at_ns", "subject_id", "duration_ns"]
    rows = durations.withColumn("_one", F.lit(1).cast("long"))
    if keys:
        many = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * config.min_samples).select(*keys)
        placed = rows.withColumn("place", F.sum("_one").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
        found = change_points(durations.join(many, keys, "left_semi"), keys, "duration_ns", order)
        rows = placed.join(found, keys).filter(F.col("place") == F.col("split") + 1)
    else:
        many = durations.agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * config.min_samples)
        found = change_points(durations, [], "duration_ns", order).crossJoin(many)
        rows = ranks.running(rows, order[0], order[1:], {"place": "_one"}).crossJoin(F.broadcast(found)).filter(F.col("place") == F.col("split") + 1)
    return _over(rows, "change_point", F.col("score"), config.change_point, source=None)


def detect_statistical(series: dict[str, DataFrame], base: DataFrame, config: StatConfig = StatConfig(), keys: list[str] | None = None) -> DataFrame:
    """All statistical detectors on live data; with keys, on each key's slice that has a baseline."""
    keys = keys or []
    has = (lambda df: df.join(base.select(*keys), keys, "left_semi")) if keys else (lambda df: df)
    timed, durations = has(series["timed"]), has(series["durations"])
    found = [detect(durations, base, config, keys) for detect in (detect_dwell, detect_sudden_change)]
    found += [detect(timed, base, config, keys) for detect in (detect_frequency, detect_time, detect_missing)]
    if config.robust:
        found += [detect_robust_dwell(durations, base, config, keys), detect_change_points(durations, config, keys), detect_own_gaps(timed, config, keys)]
    if config.by_day:
        found.append(detect_day(timed, base, config, keys))
    return reduce(DataFrame.unionByName, found)


def scoped_baselines(series: dict[str, DataFrame], config: StatConfig = StatConfig()) -> DataFrame:
    """The baselines of all, of each subject and of each source, by scope."""
    null = lambda keys: {c: F.lit(None).cast("long") for c in ("subject_id", "source_id") if c not in keys}
    parts = [baseline(series, config, keys).withColumns({**null(keys), "scope": F.lit(scope)}) for scope, keys in SCOPES.items()]
    return reduce(DataFrame.unionByName, parts)


def resolve_baseline(rows: DataFrame, scoped: DataFrame, column: str) -> DataFrame:
    """rows with the narrowest scope's value: of the subject, else of the source, else of all."""
    pick = lambda scope, key: scoped.filter(F.col("scope") == scope).select(F.col(key).alias("_" + key), F.struct(column).alias("_by_" + scope))
    subject, source = pick("subject", "subject_id"), pick("source", "source_id")
    every = scoped.filter("scope = 'global'").select(F.struct(column).alias("_by_global"))
    out = rows.join(subject, F.col("subject_id") == F.col("_subject_id"), "left").join(source, F.col("source_id") == F.col("_source_id"), "left").join(F.broadcast(every), how="left")
    return out.withColumn(column, F.coalesce("_by_subject", "_by_source", "_by_global")[column]).drop("_subject_id", "_source_id", "_by_subject", "_by_source", "_by_global")


def detect_scoped(series: dict[str, DataFrame], scoped: DataFrame, config: StatConfig = StatConfig()) -> DataFrame:
    """All statistical detectors under every scope; a row may be found under several, and all are kept."""
    parts = [detect_statistical(series, scoped.filter(F.col("scope") == scope).drop("scope", *({"subject_id", "source_id"} - set(keys))), config, keys).withColumn("scope", F.lit(scope)) for scope, keys in SCOPES.items()]
    return reduce(DataFrame.unionByName, parts)


# --- graph ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class GraphConfig:
    """Least counts of moves, pairs and routes in the history, and the share up to which one of them is rare."""

    min_hops: int = 8
    min_pairs: int = 6
    min_routes: int = 6
    rare: float = 0.05


def camera_hops(timed: DataFrame) -> DataFrame:
    """Moves of a subject between sources, with the time that they took (above zero); unknown subjects are one series."""
    w = W.partitionBy("subject_id").orderBy("at_ns", "event_id")
    rows = timed.filter("source_id is not null").select("subject_id", F.lag("source_id").over(w).alias("from_source"), F.col("source_id").alias("to_source"), "at_ns", (F.col("at_ns") - F.lag("at_ns").over(w)).alias("elapsed_ns"))
    return rows.filter("from_source is not null and from_source <> to_source and elapsed_ns > 0")


def fractions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by key and their share of all rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).withColumn("fraction", F.col("n") / F.col("total"))


def rare(live: DataFrame, history: DataFrame, keys: list[str], reason: str, least: int, most: float = 0.05, subject: str | None = "subject_id", source: str | None = None) -> DataFrame:
    """Live rows whose key has at most a share of `most` in a history of at least `least` rows: score 1 / (share + 0.001), 20 at most."""
    counts = history.groupBy(*keys).agg(F.count("*").alias("n"))
    total = history.agg(F.count("*").alias("total")).filter(F.col("total") >= least)
    rows = live.join(counts, keys, "left").crossJoin(F.broadcast(total)).withColumn("fraction", F.coalesce("n", F.lit(0)) / F.col("total"))
    return _events(rows.filter(F.col("fraction") <= most), reason, F.least(F.lit(20.0), F.lit(1.0) / (F.col("fraction") + 1e-3)), s.GRAPH_STEPS, subject=subject, source=source)


def rare_pairs(stays: DataFrame, least: int, most: float = 0.05) -> DataFrame:
    """As `rare` for the pairs of one table of stays, live and history at once: each meeting comes with its pair's count."""
    total = met_in_all(memory.meetings(stays)).filter(F.col("total") >= least)
    rows = pairs.meetings(stays).crossJoin(F.broadcast(total)).withColumn("fraction", F.col("n") / F.col("total"))
    return _events(rows.filter(F.col("fraction") <= most), "rare_pair", F.least(F.lit(20.0), F.lit(1.0) / (F.col("fraction") + 1e-3)), s.GRAPH_STEPS, subject="a", source=None)


def topology_factor(hops: DataFrame, edges: DataFrame, strict_unknown: bool = True) -> DataFrame:
    """1.0 for a move within its edge's travel window, 0.0 outside; unknown edges by strict_unknown; no move is 1.0.

    The topology is a table of cameras, joined as Spark sees fit for its size.
    """
    rows = hops.join(edges, ["from_source", "to_source"], "left")
    inside = (F.col("elapsed_ns") >= F.col("min_travel_ns")) & (F.col("max_travel_ns").isNull() | (F.col("elapsed_ns") <= F.col("max_travel_ns")))
    unknown = F.lit(0.0 if strict_unknown else 1.0)
    return rows.withColumn("factor", F.when(F.col("from_source") == F.col("to_source"), 1.0).when(F.col("min_travel_ns").isNull(), unknown).when(inside, 1.0).otherwise(0.0))


def detect_graph(live: dict[str, DataFrame], history: dict[str, DataFrame], edges: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """Impossible moves (score 8), else rare ones; rare pairs; rare routes of two zones at least."""
    hops = topology_factor(camera_hops(live["timed"]), edges)
    impossible = _events(hops.filter("factor = 0.0"), "impossible_hop", F.lit(8.0), s.GRAPH_STEPS, source="to_source")
    possible = rare(hops.filter("factor > 0.0"), camera_hops(history["timed"]), ["from_source", "to_source"], "rare_hop", config.min_hops, config.rare, source="to_source")
    order = lambda df: df.select(F.col("subject_a").alias("subject_id"), F.least("subject_a", "subject_b").alias("low"), F.greatest("subject_a", "subject_b").alias("high"), "at_ns")
    if live is history and "stays" in live:
        met = rare_pairs(live["stays"], config.min_pairs, config.rare)
    else:
        met = rare(order(live["pairs"]), order(history["pairs"]), ["low", "high"], "rare_pair", config.min_pairs, config.rare)
    routes = rare(live["routes"].filter(F.size("zones") >= 2), history["routes"], ["zones"], "rare_route", config.min_routes, config.rare)
    return reduce(DataFrame.unionByName, [impossible, possible, met, routes])


# --- thresholds ---------------------------------------------------------------------------------------------------------


def far_threshold(scores: DataFrame, target_far: float) -> DataFrame:
    """The score that the target share of normal rows reaches, picked by rank, with the empirical rates.

    Ranks come from counts of distinct scores in ranges, so that no task sorts all of them.
    """
    normal = scores.filter("is_normal").groupBy("score").agg(F.count("*").alias("n"))
    total = scores.agg(F.count_if("is_normal").alias("n_normal"), F.count_if(~F.col("is_normal")).alias("n_anomalous"))
    ranked = ranks.running(normal, "score", [], {"upto": "n"})
    place = F.floor((1 - F.lit(target_far)) * (F.col("n_normal") - 1) + 0.5)
    picked = ranked.crossJoin(F.broadcast(total)).filter(F.col("upto") > place).agg(F.min("score").alias("threshold"))
    rows = scores.crossJoin(F.broadcast(picked))
    rates = rows.agg(F.first("threshold").alias("threshold"), F.count_if(F.col("is_normal") & (F.col("score") >= F.col("threshold"))).alias("above"), F.count_if(~F.col("is_normal") & (F.col("score") < F.col("threshold"))).alias("below"))
    return rates.crossJoin(total).select("threshold", "n_normal", "n_anomalous", F.try_divide("above", "n_normal").alias("empirical_far"), F.try_divide("below", "n_anomalous").alias("miss_rate"))


def score_series(series: dict[str, DataFrame], base: DataFrame) -> DataFrame:
    """All z-scores of a series against a baseline: dwell, robust dwell, gap, hour."""
    b = F.broadcast(base)
    dwell = series["durations"].filter("duration_ns > 0").crossJoin(b)
    rows = [
        dwell.select(F.lit("dwell").alias("kind"), "subject_id", "at_ns", s.z_score(F.col("duration_ns"), F.col("dwell_mean"), F.col("dwell_sd")).alias("score")),
        dwell.select(F.lit("robust_dwell").alias("kind"), "subject_id", "at_ns", s.robust_z(F.col("duration_ns"), F.col("dwell_median"), F.col("dwell_mad")).alias("score")),
        gaps(series["timed"]).crossJoin(b).select(F.lit("gap").alias("kind"), "subject_id", "at_ns", s.z_score(F.col("gap_ns"), F.col("gap_mean"), F.col("gap_sd")).alias("score")),
        series["timed"].crossJoin(b).select(F.lit("hour").alias("kind"), "subject_id", "at_ns", F.try_divide(s.hour_delta(s.hour_of_day(F.col("at_ns")).cast("double"), F.col("hour_mean")), F.greatest(F.col("hour_sd"), F.lit(0.5))).alias("score")),
    ]
    return reduce(DataFrame.unionByName, rows)


def squash_dwell(durations: DataFrame, base: DataFrame) -> DataFrame:
    """The placeholder detector: the dwell z-score squashed to 0..1."""
    z = s.z_score(F.col("duration_ns"), F.col("dwell_mean"), F.col("dwell_sd"))
    return durations.crossJoin(F.broadcast(base)).select("subject_id", "at_ns", (z / (1 + z)).alias("score"))
