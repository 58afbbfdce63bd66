"""Views over revisions, and the entities that are built from samples: appearances, visits, profiles, reels, stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmesh.operators import ranks


def effective(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows that no other row supersedes."""
    gone = samples.filter(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias(key))
    return samples.join(gone, key, "left_anti")


def append_ids(existing: DataFrame, rows: DataFrame, order: list[str], key: str = "observation_id") -> DataFrame:
    """New rows with id 0 get the ids after the largest existing one; a revision counts up from the row it supersedes."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    fresh = ranks.running(rows.filter(F.col(key) == 0).withColumn("_one", F.lit(1).cast("long")), order[0], order[1:], {"_n": "_one"}).drop("_one")
    numbered = fresh.unionByName(rows.filter(F.col(key) != 0).withColumn("_n", F.lit(0).cast("long")))
    known = existing.select(F.col(key).alias("supersedes"), F.col("revision").alias("_before"))
    out = numbered.crossJoin(F.broadcast(top)).join(known, "supersedes", "left")  # top is one row
    return out.withColumns({key: F.when(F.col(key) == 0, F.col("_top") + F.col("_n")).otherwise(F.col(key)), "revision": F.coalesce(F.col("_before") + 1, F.lit(1).cast("long"))}).drop("_n", "_top", "_before")


def _islands(rows: DataFrame, keys: list[str], order: list[Column], breaks: Column) -> DataFrame:
    """rows with an island number that grows at each break."""
    return rows.withColumn("_break", breaks.cast("int")).withColumn("_island", F.sum("_break").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def zone_stays(samples: DataFrame) -> DataFrame:
    """Runs of samples of one subject in one zone; the source is that of the first."""
    order = [F.col("pts_ns"), F.col("sample_id")]
    w = W.partitionBy("subject_id").orderBy(*order)
    rows = _islands(samples.filter("subject_id is not null"), ["subject_id"], order, ~F.col("zone_id").eqNullSafe(F.lag("zone_id").over(w)) | (F.row_number().over(w) == 1))
    found = rows.groupBy("subject_id", "_island").agg(F.first("zone_id").alias("zone_id"), F.min_by("source_id", F.struct("pts_ns", "sample_id")).alias("source_id"), F.min("pts_ns").alias("start_ns"), F.max("pts_ns").alias("end_ns"))
    return found.select("zone_id", "subject_id", "source_id", "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"))


def routes(stays: DataFrame, span_ns: int = 86_400_000_000_000) -> DataFrame:
    """The zones of a subject in a span of time (a day), in order."""
    day = F.expr(f"start_ns div {span_ns}")
    found = stays.groupBy("subject_id", day.alias("_day")).agg(F.array_sort(F.collect_list(F.struct("start_ns", "zone_id"))).alias("s"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    return found.select("subject_id", F.col("s.zone_id").alias("zones"), "start_ns", "end_ns")


def co_occurrences(stays: DataFrame, bucket_ns: int | None = None) -> DataFrame:
    """Stays of two subjects that overlap in one zone: an equi-join on buckets of time, kept in the first common bucket.

    The width of a bucket, unless given, is a quarter of the mean stay (a minute at least): a stay lies in few buckets, and
    a bucket holds little that does not overlap.
    """
    stays = stays.select("subject_id", "zone_id", "start_ns", "end_ns", "duration_ns")
    width = stays.agg(F.greatest(F.avg(F.when(F.col("duration_ns") > 0, F.col("duration_ns"))) / 4, F.lit(6e10)).cast("long").alias("_width"))  # one row
    cut = stays.withColumn("_width", F.lit(bucket_ns).cast("long")) if bucket_ns else stays.crossJoin(F.broadcast(width))
    cut = cut.withColumn("_bucket", F.explode(F.sequence(F.expr("start_ns div _width"), F.expr("end_ns div _width"))))
    a = cut.select("zone_id", "_bucket", "_width", F.col("subject_id").alias("subject_a"), F.col("start_ns").alias("a0"), F.col("end_ns").alias("a1"))
    b = cut.select("zone_id", "_bucket", F.col("subject_id").alias("subject_b"), F.col("start_ns").alias("b0"), F.col("end_ns").alias("b1"))
    start, end = F.greatest("a0", "b0"), F.least("a1", "b1")
    met = a.join(b, ["zone_id", "_bucket"]).filter("subject_a < subject_b and a0 < b1 and b0 < a1").withColumn("_first", start)
    met = met.filter(F.col("_bucket") == F.expr("_first div _width"))
    return met.select("subject_a", "subject_b", "zone_id", start.alias("start_ns"), end.alias("end_ns"), (end - start).alias("overlap_ns"))


def meetings(stays: DataFrame) -> DataFrame:
    """(subject_id, n): how many co-occurrences each subject with a stay takes part in, without making one of them.

    A stay meets those that start before it ends, less those that end up to its start. Both are running sums by zone over
    starts and ends in order of time, ends before moments (stays of no length) before starts, so work is that of a sort.
    A subject's meetings with itself are counted likewise and taken off.
    """
    known = stays.filter("zone_id is not null and subject_id is not null").select("zone_id", "subject_id", "start_ns", "end_ns")
    kinds = F.when(F.col("start_ns") < F.col("end_ns"), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1)))  # 0: end, 1: moment, 2: start
    points = known.withColumn("_kind", F.explode(kinds)).select("zone_id", "subject_id", F.when(F.col("_kind") == 0, F.col("end_ns")).otherwise(F.col("start_ns")).alias("_at"), "_kind")
    one = lambda k: (F.col("_kind") == k).cast("long")
    points = points.withColumns({"_ended": one(0), "_moment": one(1), "_started": one(2)})
    sums = {"_ends": "_ended", "_moments": "_moment", "_starts": "_started"}

    def met(starts, moments, ends) -> Column:
        return F.when(F.col("_kind") == 0, starts + moments).when(F.col("_kind") == 1, starts - ends).otherwise(-ends - moments)

    rows = ranks.running(points, "_at", ["_kind"], sums, keys=("zone_id",)).withColumn("n", met(*map(F.col, ("_starts", "_moments", "_ends"))))
    w = W.partitionBy("subject_id", "zone_id").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    own = points.withColumn("n", -met(*[F.sum(sums[c]).over(w) for c in ("_starts", "_moments", "_ends")]))
    return rows.select("subject_id", "n").unionByName(own.select("subject_id", "n")).groupBy("subject_id").agg(F.sum("n").alias("n"))


def appearances(samples: DataFrame, gap_ns: int) -> DataFrame:
    """Runs of a track whose gaps are at most gap_ns. Subject: the first known; class: the last known."""
    keys, order = ["source_id", "track_id"], [F.col("pts_ns"), F.col("frame_index")]
    w = W.partitionBy(*keys).orderBy(*order)
    rows = _islands(samples, keys, order, F.coalesce(F.col("pts_ns") - F.lag("pts_ns").over(w) > gap_ns, F.lit(False)))
    when = F.struct("pts_ns", "frame_index")
    found = rows.groupBy(*keys, "_island").agg(
        F.min_by("subject_id", F.when(F.col("subject_id").isNotNull(), when)).alias("subject_id"), F.min("pts_ns").alias("start_ns"), F.max("pts_ns").alias("end_ns"),
        F.max_by("zone_id", F.when(F.col("zone_id").isNotNull(), when)).alias("class_id"), F.max("confidence").alias("peak_confidence"), F.count("*").alias("n_samples"),
    )
    return found.drop("_island")


def visits(found: DataFrame, gap_ns: int) -> DataFrame:
    """Appearances of a subject merged while the next starts within gap_ns of the latest end so far."""
    order = [F.col("start_ns"), F.col("end_ns")]
    before = W.partitionBy("subject_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = _islands(found.filter("subject_id is not null"), ["subject_id"], order, F.coalesce(F.col("start_ns") - F.max("end_ns").over(before) > gap_ns, F.lit(False)))
    out = rows.groupBy("subject_id", "_island").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.countDistinct("source_id").alias("source_count"))
    return out.select("subject_id", "start_ns", "end_ns", "source_count", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"))


def profiles(found: DataFrame, previous: DataFrame) -> DataFrame:
    """Totals by subject; labels come from the previous profiles, and subjects not seen again stay with zeros."""
    now = found.filter("subject_id is not null").groupBy("subject_id").agg(
        F.count("*").alias("appearance_count"), F.countDistinct("source_id").alias("source_count"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("total_duration_ns"), F.min("start_ns").alias("first_seen"), F.max("end_ns").alias("last_seen")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return now.join(previous.select("subject_id", "label"), "subject_id", "full_outer").select("subject_id", "label", zero("appearance_count"), zero("source_count"), zero("total_duration_ns"), "first_seen", "last_seen")


def reel(samples: DataFrame, gap_ns: int) -> DataFrame:
    """Segments of each subject's samples by source and track; the mask is the last that is not 0."""
    keys, order = ["subject_id", "source_id", "track_id"], [F.col("pts_ns"), F.col("sample_id")]
    w = W.partitionBy(*keys).orderBy(*order)
    rows = _islands(samples.filter("subject_id is not null"), keys, order, F.coalesce(F.col("pts_ns") - F.lag("pts_ns").over(w) > gap_ns, F.lit(False)))
    found = rows.groupBy(*keys, "_island").agg(
        F.min("pts_ns").alias("start_ns"), F.max("pts_ns").alias("end_ns"), F.max_by("mask_ref", F.when(F.col("mask_ref") != 0, F.struct("pts_ns", "sample_id"))).alias("mask_ref"), F.count("*").alias("n_samples")
    )
    return found.select(*keys, "start_ns", "end_ns", F.coalesce("mask_ref", F.lit(0)).alias("mask_ref"), "n_samples")


def identity_intervals(points: DataFrame, order: str, gap_ns: int | None = None) -> DataFrame:
    """Adjacent rows in input order with the same track, subject and decision, split also at gaps over gap_ns.

    Input order is kept within a source, so that sources can be handled apart.
    """
    same = ["track_id", "subject_id", "decision"]
    w = W.partitionBy("source_id").orderBy(order)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if gap_ns is not None:
        change = change | F.coalesce(F.col("at_ns") - F.lag("at_ns").over(w) > gap_ns, F.lit(False))
    rows = _islands(points, ["source_id"], [F.col(order)], change)
    return rows.groupBy("source_id", "_island", *same).agg(F.min("at_ns").alias("start_ns"), F.max("at_ns").alias("end_ns"), F.count("*").alias("n_points")).drop("_island")


def plan_redaction(found: DataFrame, include: int | None = None, exclude: int | None = None, intent: str = "blur") -> DataFrame:
    """Intervals of the appearances of one subject, or of all others; unknown subjects are left out."""
    rows = found.filter("subject_id is not null")
    if include is not None:
        rows = rows.filter(F.col("subject_id") == include)
    if exclude is not None:
        rows = rows.filter(F.col("subject_id") != exclude)
    return rows.select("subject_id", "source_id", "track_id", "start_ns", "end_ns", F.lit(intent).alias("intent"), "peak_confidence")


def latest_per_track(samples: DataFrame) -> DataFrame:
    """The last sample of each track."""
    w = W.partitionBy("source_id", "track_id").orderBy(F.desc("sample_id"))
    return samples.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def retention(samples: DataFrame, max_age_ns: int, source_ttl: dict[int, int], held_sources: list[int], keep: int) -> DataFrame:
    """Samples and what happens to them: 'held', 'expired', 'over_cap' or 'kept'. Ages count from the newest sample.

    The cap drops the oldest rows that are not held; ranks are found per source and hour first, so no task sorts all rows.
    """
    newest = samples.agg(F.max("pts_ns").alias("_newest"))
    per_source = samples.groupBy("source_id").agg(F.max("pts_ns").alias("_source_newest"))
    ttl = F.coalesce(*[F.when(F.col("source_id") == s, F.lit(t)) for s, t in source_ttl.items()], F.lit(1 << 62))
    rows = samples.crossJoin(F.broadcast(newest)).join(F.broadcast(per_source), "source_id")  # a row, and a row for each source
    held = F.col("source_id").isin(held_sources)
    expired = (F.col("_newest") - F.col("pts_ns") > max_age_ns) | (F.col("_source_newest") - F.col("pts_ns") > ttl)
    rows = rows.withColumns({"_held": held, "_live": ~held & ~expired, "_hour": F.expr("pts_ns div 3600000000000")})
    hours = rows.filter("_live").groupBy("_hour").agg(F.count("*").alias("_in_hour"))
    later = hours.alias("a").join(hours.alias("b"), F.col("b._hour") > F.col("a._hour"), "left").groupBy(F.col("a._hour").alias("_hour")).agg(F.coalesce(F.sum("b._in_hour"), F.lit(0)).alias("_later"))
    within = F.row_number().over(W.partitionBy("_hour", "_live").orderBy(F.desc("pts_ns"), F.desc("sample_id")))
    rows = rows.withColumn("_rank", within).join(later, "_hour", "left")
    state = F.when(F.col("_held"), "held").when(~F.col("_live"), "expired").when(F.col("_rank") + F.col("_later") > keep, "over_cap").otherwise("kept")
    return rows.withColumn("state", state).select("sample_id", "source_id", "pts_ns", "state")


def forget_subject(samples: DataFrame, subject: int, held: bool) -> DataFrame:
    """Revisions without the subject for its effective samples; none under a hold."""
    if held:
        return samples.limit(0)
    top = samples.agg(F.max("sample_id").alias("_top"))
    mine = effective(samples).filter(F.col("subject_id") == subject)
    rows = mine.withColumn("_n", F.row_number().over(W.partitionBy("subject_id").orderBy("sample_id"))).crossJoin(F.broadcast(top))
    new = {"supersedes": F.col("sample_id"), "sample_id": F.col("_top") + F.col("_n"), "revision": F.col("revision") + 1, "subject_id": F.lit(None).cast("long")}
    return rows.withColumns(new).select(*samples.columns)


def forget_everywhere(tables: dict[str, DataFrame], subject: int, held: bool) -> dict[str, DataFrame]:
    """Derived tables without a subject: appearances stay without its name, all other rows of it go; a hold keeps all."""
    if held:
        return tables
    named = F.col("subject_id") == subject
    out = {}
    for name, df in tables.items():
        if name == "appearances":
            out[name] = df.withColumn("subject_id", F.when(~named, F.col("subject_id")))
        elif name == "co_occurrences":
            out[name] = df.filter((F.col("subject_a") != subject) & (F.col("subject_b") != subject))
        else:
            out[name] = df.filter(~F.coalesce(named, F.lit(False)))
    return out


def retention_report(states: DataFrame) -> DataFrame:
    """How many samples of each source are in each state."""
    count = lambda state: F.count_if(F.col("state") == state).alias(state)
    return states.groupBy("source_id").agg(*[count(s) for s in ("held", "expired", "over_cap", "kept")])
