"""Machines over tables and streams, tracking measures, sampled detectors, packages and reports."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmesh.functions import mask_shapes as shapes
from trackmesh.operators import outliers, tracking
from trackmesh.sources import package, reports
from trackmesh.streaming import jobs
from trackmesh.streaming import machines as mc
from trackmesh.streaming.fold import over_table

BOXES = "source_id long, frame_index long, left double, top double, right double, bottom double, score double, class_id int, det_idx int"


def as_hyp(tracked):
    return tracked.select(F.lit(0).cast("long").alias("sequence"), F.col("frame_index").alias("frame"), F.col("track_id").alias("id"), "left", "top", "right", "bottom")


def as_detections(truth):
    return truth.select(F.lit(1).cast("long").alias("source_id"), F.col("frame").alias("frame_index"), "left", "top", "right", "bottom", F.lit(0.9).alias("score"), F.lit(0).alias("class_id"), F.col("id").alias("det_idx"))


def test_scenarios_pass_their_gates(spark):
    config = mc.Tracker(match=0.3)
    for truth, seen, mota, switches in ((*[tracking.parallel_walk(spark)] * 2, 0.9, 0), (*tracking.occlusion_gap(spark), 0.5, 0), (*[tracking.triple_lane(spark)] * 2, 0.85, 2)):
        got = tracking.mot_metrics(truth, as_hyp(tracking.track(as_detections(seen), config)))
        assert tracking.passes(got, mota, switches).first().passes and tracking.markdown(got).first().line.startswith("| 0 |")


def test_tracker_ids_classes_and_loss(spark):
    rows = [(1, f, 10.0 + f, 10.0, 30.0 + f, 50.0, 0.9, 1, 0) for f in range(3)]
    rows += [(1, 3, 13.0, 10.0, 33.0, 50.0, 0.3, None, 0)]  # a weak box keeps the track
    rows += [(1, f, None, None, None, None, None, None, None) for f in (4, 5, 6)]
    rows += [(1, 7, 17.0, 10.0, 37.0, 50.0, 0.55, 1, 0), (2, 0, 0.0, 0.0, 9.0, 9.0, 0.55, 0, 0), (2, 1, 0.0, 0.0, 9.0, 9.0, 0.05, 0, 0)]
    df = spark.createDataFrame(rows, BOXES).repartition(5)
    got = {(r.frame_index, r.track_id, r.class_id) for r in tracking.track(df, mc.Tracker(match=0.3)).collect()}
    assert got == {(f, 1, 1) for f in (0, 1, 2, 3, 7)}  # found again; boxes under 0.6 start no track
    assert {r.frame_index for r in tracking.track(df, mc.Tracker(match=0.3, max_lost=2)).collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        mc.Tracker(low=0.9)


def plain_metrics(gt, hyp, threshold):
    """Frame by frame with dictionaries."""
    tp = fp = fn = sw = frag = 0
    last, missed = {}, set()
    for f in sorted(set(gt) | set(hyp)):
        a, b = gt.get(f, {}), hyp.get(f, {})
        over = {(i, j): float(mc.iou_matrix(np.array([p], float), np.array([q], float))[0, 0]) for i, p in a.items() for j, q in b.items()}
        found = {}
        for (i, j), v in sorted(over.items(), key=lambda e: (-e[1], e[0])):
            if v >= threshold and i not in found and j not in found.values():
                found[i] = j
        for i, j in found.items():
            if last.get(i, j) != j:
                sw += 1
                frag += i in missed
        tp, fp, fn = tp + len(found), fp + len(b) - len(found), fn + len(a) - len(found)
        last = {i: j for i, j in (last | found).items() if i in a}
        missed = set(a) - set(found)
    return tp, fp, fn, sw, frag


def test_measures_against_plain_code(spark):
    rng = random.Random(5)
    gt, hyp, rows = {}, {}, {"g": [], "h": []}
    for f in range(60):
        for i in range(4):
            x = 30.0 * i + f
            if rng.random() < 0.9:
                gt.setdefault(f, {})[i] = (x, 0.0, x + 20, 20.0)
            if rng.random() < 0.8:
                x += rng.choice([0, 3, 25])
                hyp.setdefault(f, {})[i + 10 * (f // 17)] = (x, 0.0, x + 20, 20.0)
    for name, side in (("g", gt), ("h", hyp)):
        rows[name] = [(0, f, i, *b) for f, boxes in side.items() for i, b in boxes.items()]
    kind = "sequence long, frame long, id long, left double, top double, right double, bottom double"
    got = tracking.mot_metrics(spark.createDataFrame(rows["g"], kind), spark.createDataFrame(rows["h"], kind), 0.5).first()
    assert (got.true_positives, got.false_positives, got.false_negatives, got.id_switches, got.fragmentations) == plain_metrics(gt, hyp, 0.5)
    assert tracking.mot_metrics(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).count() == 0


def test_smoother_coasts_and_forgets(spark):
    rows = [(1, 0, 5, 0.0, 0.0, 10.0, 10.0, 0.8, 3), (1, 1, 5, 10.0, 0.0, 20.0, 10.0, 0.6, None)] + [(1, f, 9, 0.0, 0.0, 1.0, 1.0, 0.5, 0) for f in range(2, 6)]
    df = spark.createDataFrame(rows, "source_id long, frame_index long, track_id long, left double, top double, right double, bottom double, score double, class_id int")
    got = [r for r in tracking.smooth(df, mc.Smoother(alpha=0.5, max_missed=2)).collect() if r.track_id == 5]
    assert [r.frame_index for r in got] == [0, 1, 2, 3] and got[1].left == got[3].left == 5.0 and got[1].class_id == 3


def test_gate_moves_back_and_control_clears(spark):
    rows = [(1, i, p, c) for i, (p, c) in enumerate([(100, None), (50, None), (60, None), (55, None), (10, "reset"), (20, None)])]
    df = spark.createDataFrame(rows, "source_id long, arrival long, pts_ns long, control string")
    got = {r.arrival: r.decision for r in tracking.gate(df, mc.Gate(late="accept", out_of_order="drop", max_lateness_ns=20)).collect()}
    assert got == {0: "accept", 1: "accept", 2: "accept", 3: "drop", 4: "control", 5: "accept"}


@pytest.mark.parametrize("policy", ["reject", "drop"])
def test_gate_window_equals_machine(spark, policy):
    rng = random.Random(3)
    df = spark.createDataFrame([(i % 3, i, rng.randrange(1000)) for i in range(300)], "source_id long, arrival long, pts_ns long")
    config = mc.Gate(late=policy, max_lateness_ns=100)
    fast, slow = tracking.gate(df, config), over_table(df, ["source_id"], ["arrival"], config)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.select(*fast.columns).collect()))


def test_queue_policies(spark):
    rows = [(1, i, a, n) for i, (a, n) in enumerate([("push", None)] * 3 + [("drain", 1), ("push", None), ("drain", None)])]
    df = spark.createDataFrame(rows, "source_id long, arrival long, action string, n int")
    got = lambda **k: [(r.arrival, r.outcome) for r in over_table(df, ["source_id"], ["arrival"], mc.Queue(**k)).collect()]
    assert got(depth=2) == [(0, "queued"), (1, "queued"), (2, "rejected"), (0, "drained"), (4, "queued"), (1, "drained"), (4, "drained")]
    assert got(depth=2, policy="drop_oldest")[2:5] == [(0, "dropped"), (2, "queued"), (1, "drained")]
    assert all(o != "rejected" for _, o in got(depth=0))


def test_line_zone(spark):
    points = [(0.0, 5.0), (10.0, 5.0), (5.0, 5.0), (0.0, 5.0), (0.0, 50.0), (10.0, 50.0)]
    rows = [(1, 1, i, i, x, y, x, y) for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "source_id long, track_id long, pts_ns long, sample_id long, left double, top double, right double, bottom double")
    got = {(r.sample_id, r.direction) for r in tracking.line_crossings(df, (5.0, 0.0), (5.0, 10.0)).collect()}
    assert got == {(1, "left_to_right"), (3, "right_to_left")}  # over the line, back by way of it, then past its end


def test_zone_misses_and_classes(spark):
    rows = [(1, i, 1, i * 10, v, 2) for i, v in enumerate([True, None, True, None, None, None])] + [(1, 9, 2, 5, True, 7)]
    df = spark.createDataFrame(rows, "source_id long, sample_id long, track_id long, pts_ns long, was boolean, class_id int")
    got = [(r.sample_id, r.event, r.duration_ns) for r in tracking.zone_analytics(df, F.col("was"), mc.ZoneAnalytics(miss_tolerance=2, class_filter=2)).collect() if not r.event.startswith("occ")]
    assert got == [(0, "entered", None), (0, "dwell_started", None), (5, "exited", None), (5, "dwell_ended", 50)]


def test_stream_state_goes_on_between_batches(spark, tmp_path):
    schema = "source_id long, subject_id long, pts_ns long, sample_id long"
    for part in range(3):
        spark.createDataFrame([(1, s, part, part * 10 + s) for s in range(part, part + 2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.work_off(jobs.first_hits_stream(stream), "hits")
    assert sorted(r.subject_id for r in got.collect()) == [0, 1, 2, 3]


def test_windowed_counts(spark, sf):
    events = jobs.table_stream(spark, sf, "events")
    job = jobs.windowed_counts(events, "ts").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_detectors_on_samples(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(600)] + [(1000, [9.0, -9.0, 9.0])]
    df = spark.createDataFrame(data, "id long, features array<double>")
    for model in (outliers.IsolationForest(), outliers.OneClass()):
        scores = {r.id: r.score for r in model.fit(df).transform(df).collect()}
        again = {r.id: r.score for r in model.fit(df.repartition(7)).transform(df).collect()}
        assert max(scores, key=scores.get) == 1000 and all(0 <= v <= 1 for v in scores.values()) and scores == pytest.approx(again)
        none = df.filter("id < 0")
        assert model.fit(none).transform(none).count() == 0


def test_package(spark, tmp_path):
    root, one = f"file://{tmp_path}/p", spark.range(5)
    assert [package.save(spark, {"a": one, "b": one.limit(n)}, root) for n in (1, 2, 3)] == [1, 2, 3]
    assert package.load(spark, root)["b"].count() == 3 and not (tmp_path / "p" / "gen-1").exists()
    victim = next((tmp_path / "p" / "gen-3" / "b").glob("*.parquet"))
    victim.with_name(f".{victim.name}.crc").unlink()  # the local file system's own check
    victim.write_bytes(victim.read_bytes()[:-1] + b"x")
    with pytest.raises(package.PackageError):
        package.load(spark, root)
    with pytest.raises(package.PackageError):
        package.load(spark, f"file://{tmp_path}/none")
    blobs = spark.createDataFrame([(258, b"abc"), (2, b"")], "h long, d binary").select(package.blob_entry(F.col("h"), F.col("d")).alias("e")).agg(F.array_join(F.collect_list(F.hex("e")), "").alias("x")).select(F.unhex("x").alias("content"))
    assert {(r.mask_ref, bytes(r.data)) for r in package.read_blobs(blobs).collect()} == {(258, b"abc"), (2, b"")}


def test_shapes():
    ring = np.array([[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1]], bool)
    assert shapes.filled(ring).sum() == 10 and not shapes.filled(ring)[0, 3]
    lines = shapes.outlines(ring)
    assert len(lines) == 1 and lines[0][0] == (0.5, 0.5) and (3.5, 3.5) in lines[0] and (1.5, 1.5) not in lines[0]
    assert shapes.outlines(np.array([[0, 1]], bool)) == [[(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]]
    assert shapes.feathered(np.ones((5, 5), bool), 2).tolist()[1:3] == [[128, 255, 255, 255, 128]] * 2
    assert shapes.feathered(np.zeros((2, 2), bool), 1).sum() == 0


def test_summaries(spark):
    texts = spark.createDataFrame([("HOTA: 61.5%\nMOTA=70",), ('{"IDF1": 0.8, "frag": 3}',)], "text string")
    got = reports.parse_summary(texts).collect()
    assert (got[0].hota, got[0].mota, got[0].idf1) == (61.5, 70.0, None) and (got[1].idf1, got[1].frag) == (0.8, 3.0)
    with pytest.raises(Exception, match="no score"):
        reports.parse_summary(spark.createDataFrame([("nothing",)], "text string")).collect()
