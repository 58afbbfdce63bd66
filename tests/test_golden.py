"""Small cases with known results, and plain re-computations of what SQL cannot say."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackmesh.functions import geometry as g
from trackmesh.functions import keypoints as kp
from trackmesh.functions import scalars as s
from trackmesh.operators import anomalies as an
from trackmesh.operators import graph_index, identity, ranks, suppress, tracking
from trackmesh.plans import tables
from trackmesh.operators.host import HostConfig
from trackmesh.sources import evidence, track_columns
from trackmesh.streaming import machines as mc

UNIT = (0.0, 0.0, 4.0, 4.0)
NMS = {
    "threshold_zero": (0.0, [(*UNIT, 0.9, 1), (*UNIT, 0.8, 1)], [True, False]),
    "threshold_half_exact_overlap": (0.5, [(0.0, 0.0, 3.0, 1.0, 0.9, 1), (1.0, 0.0, 4.0, 1.0, 0.8, 1)], [True, True]),
    "threshold_one": (1.0, [(*UNIT, 0.9, 1), (*UNIT, 0.8, 1)], [True, True]),
    "different_classes": (0.5, [(*UNIT, 0.9, 1), (*UNIT, 0.8, 2)], [True, True]),
    "same_class": (0.5, [(*UNIT, 0.9, 1), (*UNIT, 0.8, 1)], [True, False]),
    "equal_scores": (0.5, [(*UNIT, 0.9, 1), (*UNIT, 0.9, 1)], [True, False]),
    "signed_zero_scores": (0.5, [(*UNIT, 0.0, 1), (*UNIT, -0.0, 1)], [True, False]),
    "absent_class_equals_absent_class": (0.5, [(*UNIT, 0.9, None), (*UNIT, 0.8, None)], [True, False]),
    "absent_class_differs_from_a_class": (0.5, [(*UNIT, 0.9, None), (*UNIT, 0.8, 1)], [True, True]),
    "no_area": (0.0, [(1.0, 1.0, 1.0, 4.0, 0.9, 1), (1.0, 1.0, 1.0, 4.0, 0.8, 1)], [True, True]),
}


def test_nms_cases(spark):
    rows = [(frame, i, *box) for frame, (_, boxes, _) in enumerate(NMS.values()) for i, box in enumerate(boxes)]
    df = spark.createDataFrame(rows, "frame long, det_idx long, left double, top double, right double, bottom double, score double, class_id int")
    for frame, (name, (threshold, boxes, keep)) in enumerate(NMS.items()):
        kept = {r.det_idx for r in suppress.nms(df.filter(F.col("frame") == frame), threshold).collect()}
        assert [i in kept for i in range(len(boxes))] == keep, name
    assert suppress.nms(df.limit(0), 0.5).count() == 0


def test_overlap_cases(spark):
    cases = [
        ("iou", UNIT, (2, 2, 6, 6), 1 / 7), ("ios", UNIT, (2, 2, 6, 6), 0.25), ("iou", (0, 0, 2, 2), (2, 0, 4, 2), 0.0), ("iou", (1, 1, 1, 4), UNIT, 0.0),
        ("iou", (-2, -2, 2, 2), (-1, -1, 3, 3), 9 / 23), ("ios", (0, 0, 8, 8), (2, 2, 4, 4), 1.0),
    ]
    for metric, a, b, want in cases:
        box = lambda r: g.literal_box(*map(float, r))
        assert spark.range(1).select(getattr(g, metric)(box(a), box(b))).first()[0] == pytest.approx(want, abs=1e-6, rel=1e-6)


def test_random_boxes_keep_their_properties(spark):
    rnd = random.Random(8)
    rows = [(f, i, x, y, x + rnd.choice([0, 3, 9]), y + rnd.choice([0, 4, 8]), rnd.choice([0.1, 0.5, 0.9]), rnd.choice([0, 1, None])) for f in range(40) for i in range(rnd.randint(0, 12)) for x, y in [(float(rnd.randint(0, 12)), float(rnd.randint(0, 12)))]]
    df = spark.createDataFrame(rows, "frame long, det_idx long, left double, top double, right double, bottom double, score double, class_id int")
    kept = suppress.nms(df, 0.3)
    assert sorted(map(tuple, suppress.nms(kept, 0.3).collect()), key=repr) == sorted(map(tuple, kept.collect()), key=repr)
    best = df.groupBy("frame").agg(F.max("score").alias("score")).collect()
    assert {(r.frame, r.score) for r in best} <= {(r.frame, r.score) for r in kept.collect()}


def plain_tracker(frames, config):
    """Tracks as objects, one number at a time; frames: lists of (left, top, right, bottom, score)."""
    live, next_id, out = [], 1, []

    def box_of(t):
        h = max(abs(t["m"][3]), 1e-3)
        w = max(abs(t["m"][2]), 1e-3) * h
        return t["m"][0] - w / 2, t["m"][1] - h / 2, t["m"][0] + w / 2, t["m"][1] + h / 2

    def state_of(b):
        w, h = max(b[2] - b[0], 1e-3), max(b[3] - b[1], 1e-3)
        return [b[0] + w / 2, b[1] + h / 2, w / h, h]

    def iou(a, b):
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        return inter / union if union > 0 else 0.0

    def match(pool, dets):
        pairs = sorted((-iou(box_of(t), d), i, j) for i, t in enumerate(pool) for j, d in enumerate(dets))
        used_t, used_d = set(), set()
        for v, i, j in pairs:
            if -v > config.match and i not in used_t and j not in used_d:
                used_t.add(i)
                used_d.add(j)
                t, seen = pool[i], state_of(dets[j])
                for c in range(4):
                    noise = max(0.01 * seen[3] ** 2 if c != 2 else 1e-2, 1e-6)
                    gap = seen[c] - t["m"][c]
                    own, fast = t["v"][c] / (t["v"][c] + noise), t["v"][c + 4] / (t["v"][c + 4] + t["v"][c] + noise)
                    t["m"][c] += own * gap
                    t["m"][c + 4] += fast * gap
                    t["v"][c], t["v"][c + 4] = max((1 - own) * t["v"][c], 1e-6), max((1 - fast) * t["v"][c + 4], 1e-6)
                t.update(score=dets[j][4], idle=0, phase="tracked")
        return [t for i, t in enumerate(pool) if i not in used_t], [d for j, d in enumerate(dets) if j not in used_d]

    for n, boxes in enumerate(frames):
        for t in live:
            h = max(abs(t["m"][3]), 1.0)
            for c in range(4):
                t["m"][c] += t["m"][c + 4]
            h = max(abs(t["m"][3]), 1.0)
            for c in range(8):
                plain = {2: 1e-4, 6: 1e-8}.get(c)
                t["v"][c] = max(t["v"][c] + (h**2 if plain is None else plain), 1e-6)
            t["idle"] += 1
        pool = sorted(live, key=lambda t: {"tracked": 0, "new": 1, "lost": 2}[t["phase"]])
        pool, strong = match(pool, [b for b in boxes if b[4] >= config.high])
        pool, _ = match(pool, [b for b in boxes if config.low <= b[4] < config.high])
        for t in pool:
            t["phase"] = "lost"
        for b in strong:
            if b[4] >= max(config.high, config.activate):
                h = state_of(b)[3]
                std = [2 * h, 2 * h, 1e-2, 2 * h, 10 * h, 10 * h, 1e-5, 10 * h]
                live.append({"id": next_id, "m": state_of(b) + [0.0] * 4, "v": [max(x * x, 1e-6) for x in std], "score": b[4], "idle": 0, "phase": "new"})
                next_id += 1
        live = [t for t in live if t["phase"] != "lost" or t["idle"] <= config.max_lost]
        out += [(n, t["id"], *box_of(t), t["score"]) for t in live if t["phase"] != "lost"]
    return out


def test_tracker_against_plain_objects():
    rnd = random.Random(13)
    for case in range(12):
        config = mc.Tracker(match=rnd.choice([0.2, 0.5]), max_lost=rnd.choice([1, 3, 30]))
        walkers = [[rnd.uniform(0, 60), rnd.uniform(0, 60), rnd.uniform(8, 20), rnd.uniform(-2, 2)] for _ in range(5)]
        frames = []
        for n in range(30):
            frames.append([])
            for x, y, side, speed in walkers:
                if rnd.random() < 0.8:
                    left = x + speed * n + rnd.uniform(-1, 1)
                    frames[-1].append((left, y, left + side, y + 2 * side, rnd.choice([0.05, 0.3, 0.55, 0.9])))
        rows = [(n, *b, 0) for n, boxes in enumerate(frames) for b in boxes or [(None,) * 5]]
        pdf = pd.DataFrame(rows, columns=["frame_index", "left", "top", "right", "bottom", "score", "class_id"]).astype({c: float for c in ("left", "top", "right", "bottom", "score")})
        got = [r[:7] for r in config.feed(config.start(), pdf)]
        want = plain_tracker(frames, config)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r[2:] for r in got], [r[2:] for r in want])


def test_running_sums_and_medians(spark):
    rng = np.random.default_rng(3)
    values = [int(v) for v in rng.integers(0, 40, 500)] + [7] * 300
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(5)
    for down in (False, True):
        got = {r.i: r.upto for r in ranks.running(df, "v", ["i"], {"upto": "v"}, descending=down).collect()}
        order = sorted(range(len(values)), key=lambda i: (values[i], i), reverse=down)
        assert got == dict(zip(order, np.cumsum([values[i] for i in order]).tolist()))
    for n in (1, 2, 799, 800):
        assert ranks.median(df.filter(F.col("i") < n), "v").first()[0] == np.median(values[:n])
    assert ranks.median(df.limit(0), "v").first()[0] is None


def test_change_points_of_the_whole_table(spark):
    rnd = random.Random(4)
    values = [rnd.randint(1, 9) for _ in range(40)] + [rnd.randint(30, 60) for _ in range(25)]
    mean = np.mean(values)
    scores = [abs(np.mean(values[:k]) - mean) * k**0.5 + abs(np.mean(values[k:]) - mean) * (len(values) - k) ** 0.5 for k in range(1, len(values))]
    df = spark.createDataFrame(list(enumerate(values)), "at long, x long")
    got = an.change_points(df, [], "x", ["at"]).first()
    assert got.split == int(np.argmax(scores)) + 1 and got.score == pytest.approx(max(scores))
    assert an.change_points(df.limit(3), [], "x", ["at"]).count() == 0


def test_checksums_keys_and_gates(spark):
    df = spark.createDataFrame([(bytearray(b""),), (bytearray(b"a"),), (bytearray(b"foobar"),), (None,)], "data binary")
    got = [r[0] for r in df.select(s.fnv64(F.col("data"))).collect()]
    assert [None if v is None else v & (1 << 64) - 1 for v in got] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8, None]
    key = s.track_key(F.lit(4294967295), F.lit(4294967295))
    assert tuple(spark.range(1).select(key, *s.track_of_key(key)).first()) == (-1, 4294967295, 4294967295)
    null = F.lit(None).cast("int")
    gates = spark.range(1).select(s.class_factor(F.lit(1), F.lit(2)), s.class_factor(F.lit(1), null), s.time_factor(F.lit(0), F.lit(-9), 5), s.time_factor(null, F.lit(9), 5), s.time_factor(F.lit(0), F.lit(9), None)).first()
    assert tuple(gates) == (0.0, 1.0, 0.0, 1.0, 1.0)


def test_graph_index_recall(spark, sf):
    e = tables.embeddings(spark, sf)
    asked = e.filter("embedding_ref % 20 = 0").select(F.col("embedding_ref").alias("query_id"), F.col("vector").alias("query"))
    exact = {(r.query_id, r.embedding_ref) for r in identity.top_k(e, asked, 5).collect()}
    got = {(r.query_id, r.embedding_ref) for r in graph_index.search(graph_index.build(e), asked, 5).collect()}
    assert len(exact & got) >= 0.9 * len(exact)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(512, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links, hits = graph_index.link(v, 16), 0
    for q in v[:100] + 0.2 * rng.normal(size=(100, 24)):
        hits += len(set(graph_index.walk(v, links, q, 5, 64).tolist()) & set(np.argsort(-(v @ q))[:5].tolist()))
    assert hits >= 0.9 * 500
    circle = np.array([[np.cos(0.1 * i), np.sin(0.1 * i), 0] for i in range(30)])
    assert circle[graph_index.walk(circle, graph_index.link(circle, 16), circle[7], 1, 64)[0]] @ circle[7] > 0.85
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [1.0, 0.0]), (6, [1.0, 0.0, 0.0])], "embedding_ref long, vector array<double>")
    one = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, query array<double>")
    assert [tuple(r) for r in identity.top_k(odd, one, 3).collect()] == [(9, 5, 1.0, 1)] and graph_index.search(graph_index.build(odd), one, 3).count() == 1
    assert identity.top_k(odd.limit(0), one, 3).count() == 0


def test_column_files():
    n = 11
    there = np.arange(n) % 3 > 0
    block = track_columns.encode_block({name: (np.arange(n), there if optional else np.ones(n, bool)) for name, optional, _ in track_columns.COLUMNS}, n)
    back = track_columns.decode_block(block)
    assert back["subject_id"].mask.tolist() == (~there).tolist() and back["sample_id"].tolist() == list(range(n)) and len(track_columns.decode_block(track_columns.encode_block({name: (np.zeros(0), np.zeros(0, bool)) for name, _, _ in track_columns.COLUMNS}, 0))["left"]) == 0
    for wrong in (b"", block[:-1], b"x" + block[1:], block[:8] + b"\2\0\0\0" + block[12:]):
        with pytest.raises(ValueError):
            track_columns.decode_block(wrong)


def test_strict_batches_and_keypoints(spark):
    frames = spark.createDataFrame([(1, 0, 100), (1, 1, 50)], "source_id long, arrival long, pts_ns long")
    boxes = spark.createDataFrame([(1, a, 0.0, 0.0, 9.0, 9.0, 0.9, 0) for a in (0, 1)], "source_id long, arrival long, left double, top double, right double, bottom double, score double, class_id int")
    assert [r.frame_index for r in tracking.ingest_batch(frames, boxes).collect()] == [0]
    with pytest.raises(Exception, match="turned away"):
        tracking.ingest_batch(frames, boxes, strict=True).collect()
    with pytest.raises(Exception, match="not finite"):
        spark.range(1).select(kp.keypoint(F.lit(float("nan")), F.lit(0.0), F.lit(1.0), F.lit(0))).collect()


def test_host_configuration():
    config = HostConfig.from_json('{"tracker": {"match": 0.4}, "statistical": {"z": 3.0}}')
    assert config.tracker.match == 0.4 and config.statistical.z == 3.0 and config.tracker.high == mc.Tracker().high
    assert HostConfig.from_json(config.to_json()) == config
    for wrong in ("[]", '{"tracker": {"speed": 1}}', '{"engine": {}}', '{"tracker": {"match": "much"}}', '{"tracker": {"match": 7}}', '{"tracker": 3}'):
        with pytest.raises(ValueError):
            HostConfig.from_json(wrong)


def test_evidence_and_models(spark, tmp_path):
    report = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, value double")
    paths = evidence.write_pack({"one": report}, f"file://{tmp_path}/pack")
    assert [r.value for r in spark.read.text(paths["report.md"]).collect()] == ["## one", "", "| name | value |", "| --- | --- |", "| a | 1.5 |", "| b |  |"]
    with pytest.raises(ValueError):
        evidence.write_pack({"many": spark.range(evidence.MOST_ROWS + 1)}, f"file://{tmp_path}/many")

    class Fetcher:
        def fetch(self, name, path):
            (tmp_path / "models").mkdir(exist_ok=True)
            (tmp_path / "models" / name).write_bytes(b"weights")

    import hashlib

    good = hashlib.sha256(b"weights").hexdigest()
    assert [r.name for r in evidence.ensure_models(spark, {"m.bin": good}, f"file://{tmp_path}/models", Fetcher()).collect()] == ["m.bin"]
    with pytest.raises(ValueError):
        evidence.ensure_models(spark, {"m.bin": "0"}, f"file://{tmp_path}/models", Fetcher())
