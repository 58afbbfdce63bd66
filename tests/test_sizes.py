"""Cases of the sizes at which queries once failed, made small."""

import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trackmesh.operators import anomalies, graph_index, identity, memory, pairs, patterns
from trackmesh.streaming import fold
from trackmesh.streaming import machines as mc


def test_change_points_of_sums_over_a_long(spark):
    big = 4 * 10**18  # three of them are over the largest long
    rows = [(k, at, 0 if at < 5 else big) for k in (1, 2) for at in range(10)]
    values = spark.createDataFrame(rows, "subject_id long, at_ns long, duration_ns long")
    order = ["at_ns", "subject_id", "duration_ns"]
    assert [r.split for r in anomalies.change_points(values, ["subject_id"], "duration_ns", order).collect()] == [5, 5]
    one = values.filter("subject_id = 1")
    assert [r.split for r in anomalies.change_points(one, [], "duration_ns", order).collect()] == [5]
    assert [(r.reason, r.at_ns) for r in anomalies.detect_change_points(one).collect()] == [("change_point", 5)]


def stays_of(spark, subjects=40, each=30, seed=1):
    """Stays on few moments, so that many start or end together, last no time, or are of one subject and overlap."""
    draw = random.Random(seed)
    rows = [(s, draw.choice([1, 2, 3, None]), at, at + draw.choice([0, 0, 1, 2, 5])) for s in range(subjects) for at in (draw.randrange(50) for _ in range(each))]
    rows += [(None, 1, 3, 9)]
    return spark.createDataFrame([(*r, r[3] - r[2]) for r in rows], "subject_id long, zone_id int, start_ns long, end_ns long, duration_ns long")


def test_meetings_are_counted_without_pairs(spark):
    stays = stays_of(spark)
    told = memory.co_occurrences(stays, bucket_ns=7).select("subject_a", "subject_b", "start_ns").collect()
    by_subject = Counter(s for r in told for s in (r.subject_a, r.subject_b))
    met = memory.meetings(stays)
    assert {r.subject_id: r.n for r in met.collect() if r.n} == by_subject
    assert patterns.met_in_all(met).first().total == len(told)


def test_pairs_are_counted_by_blocks(spark, monkeypatch):
    stays = stays_of(spark)
    told = [(r.subject_a, r.subject_b, r.start_ns) for r in memory.co_occurrences(stays, bucket_ns=7).collect()]
    by_pair = Counter((a, b) for a, b, _ in told)
    for name, small in (("SUBJECTS", 7), ("STAYS", 100), ("TABLE", 20), ("CHUNK", 13), ("ROWS", 5)):
        monkeypatch.setattr(pairs, name, small)
    assert {(r.a, r.b): r.n for r in pairs.counts(stays).collect()} == by_pair
    assert {(r.a, r.b): r.n for r in pairs.counts(stays, 3).collect()} == {k: n for k, n in by_pair.items() if n >= 3}
    assert sorted((r.a, r.b, r.n, r.at_ns) for r in pairs.meetings(stays).collect()) == sorted((a, b, by_pair[a, b], at) for a, b, at in told)


def vectors_of(spark, n, dims=8, seed=3):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "embedding_ref long, vector array<double>").coalesce(1)


def test_searches_hand_on_no_more_than_k_a_task(spark):
    v, store = vectors_of(spark, 1700)  # four blocks of one task
    asked = store.filter("embedding_ref % 100 = 0").select(F.col("embedding_ref").alias("query_id"), F.col("vector").alias("query"))
    assert identity._hits(store, asked, 3).count() == 17 * 3
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 1700, 100) for i in np.argsort(-(unit @ unit[q]))[:3]}
    assert {(r.query_id, r.embedding_ref) for r in identity.top_k(store, asked, 3).collect()} == want
    got = [(r.query_id, r.embedding_ref) for r in graph_index.search(graph_index.build(store), asked, 3).collect()]
    assert len(got) == 51 and len(set(got) & want) >= 46


def test_planes_by_blocks_are_those_of_a_join_on_buckets(spark):
    v, store = vectors_of(spark, 300)
    asked = store.filter("embedding_ref % 30 = 0").select(F.col("embedding_ref").alias("query_id"), F.col("vector").alias("query"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sides = [v @ np.random.default_rng(1000 + t).normal(size=(6, 8)).T >= 0 for t in range(2)]
    want = set()
    for q in range(0, 300, 30):
        near = [i for i in range(300) if any((s[i] != s[q]).sum() <= 1 for s in sides)]
        near = near if len(near) >= 60 else range(300)  # too few: the exact search
        want |= {(q, i) for i in sorted(near, key=lambda i: -(unit[i] @ unit[q]))[:60]}
    assert {(r.query_id, r.embedding_ref) for r in identity.lsh_top_k(store, asked, 60, 8, 6, 2).collect()} == want


def test_smoothing_in_parts_and_in_columns():
    """The smoother fed a few frames at a time against plain numbers, with tracks that are lost, come back and have no class."""
    draw, rows = random.Random(7), []
    for frame in range(0, 120, 2):
        for track in sorted(draw.sample(range(6), draw.randrange(4))) or [None]:
            box = [draw.random() if track is not None else None for _ in range(4)]
            rows.append((frame, track, *box, draw.random(), draw.choice([None, 1, 2])))
    names = ["frame_index", "track_id", *mc.BOX, "score", "class_id"]
    want, live = [], {}
    for frame in sorted({r[0] for r in rows}):
        for _, track, *box, cls in (r for r in rows if r[0] == frame and r[1] is not None):
            old = live.get(track)
            at = box if old is None else [o * (1 - 0.3) + v * 0.3 for o, v in zip(old[0], box, strict=True)]
            live[track] = [at, cls if cls is not None else old and old[1], -1]
        for entry in live.values():
            entry[2] += 1
        live = {k: e for k, e in live.items() if e[2] <= 3}
        want += [(frame, k, *e[0], e[1]) for k, e in sorted(live.items())]
    for size in (1, 4, 60):
        machine = mc.Smoother(alpha=0.3, max_missed=3)
        state, got = machine.start(), []
        for a in range(0, 120, 2 * size):
            part = pd.DataFrame([r for r in rows if a <= r[0] < a + 2 * size], columns=names)
            columns = machine.feed_columns(state, part)
            assert len({len(c) for c in columns}) == 1
            got += mc.as_tuples(columns)
        assert got == want


def test_rows_of_a_key_are_put_in_order_beyond_memory(monkeypatch):
    draw = random.Random(5)
    rows = pd.DataFrame({"at": [draw.randrange(300) for _ in range(3000)], "n": [draw.randrange(3) for _ in range(3000)]})
    rows["i"] = range(3000)
    parts = [rows.iloc[a : a + 37] for a in range(0, 3000, 37)]
    want = rows.sort_values(["at", "n"], kind="stable", ignore_index=True)
    for run, size in ((10_000, 50), (200, 30), (100, 1), (37, 1000)):
        monkeypatch.setattr(fold, "RUN", run)
        monkeypatch.setattr(fold, "SLICE", size)
        got = list(fold.in_order(iter(parts), ["at", "n"]))
        assert pd.concat(got, ignore_index=True).equals(want)
        assert all(a["at"].iloc[-1] < b["at"].iloc[0] for a, b in zip(got, got[1:]))
    assert list(fold.in_order(iter([]), ["at"])) == []
