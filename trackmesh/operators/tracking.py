"""Tracks of detections, smoothed tracks, zone machines over tables, and the measures of tracking against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmesh.functions import geometry as g
from trackmesh.streaming import machines as mc
from trackmesh.streaming.fold import over_table

_BOX = ["left", "top", "right", "bottom"]


def track(detections: DataFrame, config: mc.Tracker | None = None, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Tracks of each source, frame by frame. A source is followed in order, so it is one task; where a source can be
    cut (a restart of its camera), name the column of its parts in ``by``, which spreads a hot source."""
    keep = ["frame_index", *_BOX, "score", "class_id"]
    rows = detections.select(*by, *[c for c in keep if c not in by], *([F.col("det_idx")] if "det_idx" in detections.columns else [F.lit(0).alias("det_idx")]))
    return over_table(rows, list(by), ["frame_index", "det_idx"], config or mc.Tracker(), unit="frame_index")


def smooth(tracked: DataFrame, config: mc.Smoother | None = None) -> DataFrame:
    """Smoothed boxes of each source's tracks."""
    return over_table(tracked.select("source_id", "frame_index", "track_id", *_BOX, "score", "class_id"), ["source_id"], ["frame_index", "track_id"], config or mc.Smoother(), unit="frame_index")


def line_crossings(samples: DataFrame, start: tuple[float, float], end: tuple[float, float]) -> DataFrame:
    """Crossings of a segment by tracks; tracks are independent here, and so spread over tasks."""
    x, y = g.center(g.box())
    points = samples.select("source_id", "track_id", "pts_ns", "sample_id", x.alias("x"), y.alias("y"))
    machine = mc.LineZone(start, end, fields="sample_id long, crossed_by long, direction string")
    found = over_table(points, ["source_id", "track_id"], ["pts_ns", "sample_id"], machine)
    return found.drop("crossed_by")


def zone_analytics(samples: DataFrame, inside: Column, config: mc.ZoneAnalytics | None = None) -> DataFrame:
    """Confirmed entries, exits, dwell times and occupancy of a zone, by source."""
    rows = samples.withColumn("inside", inside).select("source_id", "sample_id", "track_id", "pts_ns", "inside", *[c for c in ("class_id",) if c in samples.columns])
    return over_table(rows, ["source_id"], ["pts_ns", "sample_id"], config or mc.ZoneAnalytics())


def gate(stamps: DataFrame, config: mc.Gate | None = None) -> DataFrame:
    """Decisions on frames in the order of ``arrival``.

    Where late and disordered frames are not accepted, the watermark is the greatest time so far, and a window does it;
    otherwise it can move back, and the machine runs.
    """
    config = config or mc.Gate()
    if "accept" in (config.late, config.out_of_order) or "control" in stamps.columns:
        return over_table(stamps, ["source_id"], ["arrival"], config)
    w = W.partitionBy("source_id").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    high = F.max("pts_ns").over(w)
    told = lambda policy, name: F.lit(name if policy == "reject" else policy)
    behind = F.when(F.col("_high") - F.col("pts_ns") > config.max_lateness_ns, told(config.late, "reject_late")).otherwise(told(config.out_of_order, "reject_out_of_order"))
    rows = stamps.select("source_id", "arrival", "pts_ns", high.alias("_high"))
    accepted = F.col("_high").isNull() | (F.col("pts_ns") >= F.col("_high"))
    return rows.select("source_id", "arrival", "pts_ns", F.when(accepted, "accept").otherwise(behind).alias("decision"), F.greatest("_high", "pts_ns").alias("watermark_ns"))


def ingest_metrics(decisions: DataFrame) -> DataFrame:
    """Counts of decisions by source."""
    count = lambda *names: F.count_if(F.col("decision").isin(*names))
    return decisions.groupBy("source_id").agg(
        count("accept").alias("accepted"), count("drop").alias("dropped"), count("reject_late").alias("rejected_late"), count("reject_out_of_order").alias("rejected_out_of_order")
    )


def ingest_batch(frames: DataFrame, detections: DataFrame, config: mc.Gate | None = None, strict: bool = False, tracker: mc.Tracker | None = None) -> DataFrame:
    """Tracks of the frames (source_id, arrival, pts_ns) that the gate lets in, from their detections (source_id, arrival, box,
    score, class_id). A frame that is turned away is left out, or an error where the batch is strict."""
    decided = gate(frames, config)
    if strict:
        told = F.raise_error(F.concat_ws(" ", F.lit("frame"), F.col("arrival").cast("string"), F.lit("of source"), F.col("source_id").cast("string"), F.lit("is turned away:"), "decision"))
        decided = decided.withColumn("decision", F.when(F.col("decision") == "accept", F.col("decision")).otherwise(told.cast("string")))
    let_in = decided.filter("decision = 'accept'").select("source_id", "arrival", F.col("arrival").alias("frame_index"))
    return track(let_in.join(detections, ["source_id", "arrival"]), tracker)


# --- measures -------------------------------------------------------------------------------------------------------------

_PAIR = "array<struct<neg:double,gt:bigint,hyp:bigint>>"


def matches(gt: DataFrame, hyp: DataFrame, threshold: float) -> DataFrame:
    """(sequence, frame, gt_id, hyp_id) matched one to one by IoU of at least the threshold, best first, then by id."""
    a = gt.select("sequence", "frame", F.col("id").alias("gt_id"), *[F.col(c).alias("g_" + c) for c in _BOX])
    b = hyp.select("sequence", "frame", F.col("id").alias("hyp_id"), *[F.col(c).alias("h_" + c) for c in _BOX])
    pairs = a.join(b, ["sequence", "frame"]).withColumn("iou", g.iou(g.box("g_"), g.box("h_"))).filter(F.col("iou") >= threshold)
    sets = pairs.groupBy("sequence", "frame").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("neg"), F.col("gt_id").cast("long").alias("gt"), F.col("hyp_id").cast("long").alias("hyp")))).alias("p"))

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["gt"] == x["gt"]) | (k["hyp"] == x["hyp"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    found = sets.select("sequence", "frame", F.explode(F.aggregate("p", F.array().cast(_PAIR), step)).alias("m"))
    return found.select("sequence", "frame", F.col("m.gt").alias("gt_id"), F.col("m.hyp").alias("hyp_id"))


def _share(over: Column, under: Column) -> Column:
    return F.when(under > 0, F.try_divide(over.cast("double"), under)).otherwise(F.lit(0.0))


def mot_metrics(gt: DataFrame, hyp: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Hits, errors, switches, fragmentations and the scores made of them, by sequence.

    A truth's last match is remembered as long as it stands in each frame of the sequence (frames of either side); a
    match to another id is a switch, and also a fragmentation if the frame before had it unmatched.
    """
    frames = gt.select("sequence", "frame").union(hyp.select("sequence", "frame")).distinct()
    frames = frames.withColumn("at", F.row_number().over(W.partitionBy("sequence").orderBy("frame")))
    rows = gt.select("sequence", "frame", F.col("id").cast("long").alias("gt_id")).join(matches(gt, hyp, threshold), ["sequence", "frame", "gt_id"], "left").join(frames, ["sequence", "frame"])
    by_id = W.partitionBy("sequence", "gt_id").orderBy("at")
    rows = rows.withColumn("run", F.col("at") - F.row_number().over(by_id))
    in_run = W.partitionBy("sequence", "gt_id", "run").orderBy("at")
    last = F.last("hyp_id", ignorenulls=True).over(in_run.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"last": last, "missed": F.lag(F.col("hyp_id").isNull(), 1, False).over(in_run)})
    hit, moved = F.col("hyp_id").isNotNull(), F.col("last") != F.col("hyp_id")
    seen = rows.groupBy("sequence").agg(
        F.count_if(hit).alias("true_positives"), F.count_if(~hit).alias("false_negatives"), F.count_if(hit & F.coalesce(moved, F.lit(False))).alias("id_switches"),
        F.count_if(hit & F.coalesce(moved, F.lit(False)) & F.col("missed")).alias("fragmentations"),
    )
    totals = frames.groupBy("sequence").agg(F.count("*").alias("frames")).join(hyp.groupBy("sequence").agg(F.count("*").alias("hyps")), "sequence", "left").join(seen, "sequence", "left").na.fill(0)
    tp, fn, sw = F.col("true_positives"), F.col("false_negatives"), F.col("id_switches")
    totals = totals.withColumn("false_positives", F.col("hyps") - tp)
    fp = F.col("false_positives")
    idtp = tp - sw
    totals = totals.withColumns({
        "mota": F.when(tp + fn > 0, 1 - F.try_divide((fn + fp + sw).cast("double"), tp + fn)).otherwise(F.lit(0.0)),
        "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "idf1": _share(2 * idtp, 2 * idtp + fp + fn), "deta": _share(tp, tp + fp + fn),
    })
    return totals.drop("hyps").withColumns({"assa": F.col("idf1"), "hota": F.sqrt(F.col("deta") * F.col("idf1"))})


def passes(metrics: DataFrame, least_mota: float, most_switches: int) -> DataFrame:
    """Whether each sequence is good enough."""
    return metrics.select("sequence", ((F.col("mota") >= least_mota) & (F.col("id_switches") <= most_switches)).alias("passes"))


def markdown(metrics: DataFrame) -> DataFrame:
    """A table line of text per sequence."""
    return metrics.select("sequence", F.format_string("| %s | %.4f | %.4f | %.4f | %d | %d |", F.col("sequence").cast("string"), "mota", "idf1", "hota", "id_switches", "fragmentations").alias("line"))


def parallel_walk(spark: SparkSession, frames: int = 30) -> DataFrame:
    """Truth of two objects walking side by side, 2 to the right a frame."""
    at = spark.range(frames).select(F.col("id").alias("frame"), F.explode(F.array(F.lit(1), F.lit(2))).alias("id"))
    return _walk(at, F.lit(10.0) + (F.col("id") - 1) * 70 + F.col("frame") * 2, F.lit(10.0))


def occlusion_gap(spark: SparkSession, frames: int = 40, gap: int = 10) -> tuple[DataFrame, DataFrame]:
    """Truth of one walking object, and its detections without those of the ``gap`` middle frames."""
    truth = _walk(spark.range(frames).select(F.col("id").alias("frame"), F.lit(1).alias("id")), F.lit(10.0) + F.col("frame"), F.lit(10.0))
    first = (frames - gap) // 2
    hidden = (F.col("frame") >= first) & (F.col("frame") < first + gap)
    return truth, truth.select("sequence", "frame", "id", *[F.when(~hidden, F.col(c)).alias(c) for c in _BOX])


def triple_lane(spark: SparkSession, frames: int = 25) -> DataFrame:
    """Truth of three objects in lanes one over another."""
    at = spark.range(frames).select(F.col("id").alias("frame"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("id"))
    return _walk(at, F.lit(10.0) + F.col("frame") * F.col("id"), F.lit(10.0) + (F.col("id") - 1) * 60)


def _walk(at: DataFrame, left: Column, top: Column) -> DataFrame:
    rows = at.withColumns({"left": left.cast("double"), "top": top.cast("double")})
    return rows.select(F.lit(0).cast("long").alias("sequence"), "frame", F.col("id").cast("long").alias("id"), "left", "top", (F.col("left") + 20).alias("right"), (F.col("top") + 40).alias("bottom"))
