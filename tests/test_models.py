"""Images, decoding, rotated boxes, masks of a frame, and audits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmesh.functions import geometry as g
from trackmesh.functions import images
from trackmesh.operators import identity as ident
from trackmesh.operators import models, suppress
from trackmesh.streaming import jobs


def test_letterbox_and_back():
    image = np.arange(40 * 20 * 3, dtype=np.uint8).reshape(20, 40, 3)
    out, place = images.letterbox(image, 64, 64)
    assert out.shape == (64, 64, 3) and (out[0] == images.PAD).all() and (place.pad_x, place.pad_y) == (0, 16)
    assert np.allclose(place.to_source(np.array([[0.0, 16.0, 64.0, 48.0], [-9.0, 0.0, -9.0, 0.0]])), [[0, 0, 40, 20], [0, 0, 1, 1]])
    assert (images.resize(image, 40, 20) == image).all() and images.crop(image, 1.2, 2.0, 3.1, 2.0).shape == (1, 3, 3)
    assert images.planes(image).shape == (3, 20, 40) and images.planes(image).max() <= 1
    with pytest.raises(ValueError):
        images.unpack(b"1", 1, 1)


def test_decode_layouts(spark):
    six = models.decode_rows(np.array([[0, 0, 10, 10, 0.9, 3], [0, 0, 10, 10, 0.1, 3]], float), 0.25)
    assert six.tolist()[0] == [0, 0, 10, 10, 0.9, 3]
    heads = models.decode_rows(np.array([[5, 5, 10, 10, 0.1, 0.2, 0.7, 0.3]], float), 0.25)
    assert heads.tolist() == [[0, 0, 10, 10, 0.7, 2]]
    full = np.zeros((1, 85))
    full[0, :5], full[0, 20] = (5, 5, 10, 10, 0.5), 0.8
    assert models.decode_rows(full, 0.25)[0, 4:].tolist() == [0.4, 15]
    raw = np.array([[5, 5, 10, 10, 0.1, 0.2, 0.7, 0.3], [5, 5, 10, 10, 0.1, 0.2, 0.6, 0.3]], float)
    df = spark.createDataFrame([(1, [float(v) for v in raw.T.ravel()], 8, 1.0, 1.0, 0.0, 0.0, 8, 8)], "frame long, raw array<double>, channels int, scale_x double, scale_y double, pad_x double, pad_y double, source_w int, source_h int")
    got = models.decode(df, channels_first=True).collect()
    assert [(r.score, r.right) for r in got] == [(0.7, 8.0)]


def test_oriented_iou(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("cx", "cy", "w", "h", "degrees"), strict=True)])
    got = spark.range(1).select(g.oriented_iou(box(0, 0, 2, 2, 0), box(0, 0, 2, 2, 90)), g.oriented_iou(box(0, 0, 2, 2, 0), box(1, 0, 2, 2, 0)), g.oriented_iou(box(0, 0, 2, 2, 0), box(0, 0, 2, 2, 45)), g.oriented_iou(box(0, 0, 2, 2, 0), box(9, 9, 2, 2, 5)), g.oriented_iou(box(0, 0, 0, 2, 0), box(0, 0, 2, 2, 0))).first()
    eight = 8 * (np.sqrt(2) - 1)
    assert tuple(got) == pytest.approx((1, 1 / 3, eight / (8 - eight), 0, 0))


def test_mask_nms(spark):
    df = spark.createDataFrame([(1, 0, 0.9, [1, 1, 0]), (1, 1, 0.9, [1, 1, 0]), (1, 2, 0.8, [0, 1, 1])], "frame long, det_idx long, score double, mask array<int>")
    assert {r.det_idx for r in suppress.mask_nms(df, 0.5).collect()} == {0, 2}
    assert {r.det_idx for r in suppress.mask_nms(df, 0.3).collect()} == {0}


def test_audit_answers(spark):
    h = [(1, 7, 0.5, "uncertain"), (2, 8, 0.4, "uncertain")]
    cases = spark.createDataFrame([(1, h, None, None), (2, h, None, None), (3, [], 5, None)], "audit_id long, hypotheses array<struct<rank:int,subject_id:long,score:double,decision:string>>, assigned_subject long, manual boolean")
    answers = lambda rows: spark.createDataFrame(rows, "audit_id long, subject_id long")
    got = {r.audit_id: (r.assigned_subject, r.manual) for r in ident.answer(cases, answers([(1, 8), (2, None)])).collect()}
    assert got == {1: (8, True), 2: (None, False), 3: (5, None)}
    assert ident.accept_hypotheses(cases, answers([(1, 7)])).filter("manual").first().assigned_subject == 7
    with pytest.raises(Exception, match="no such hypothesis"):
        ident.accept_hypotheses(cases, answers([(1, 9)])).collect()
    assert ident.calibrated(ident.ResolveConfig(), 0.2, 0.7).accept == 0.7


def test_rebuild_every_so_many_rows(spark, tmp_path):
    for _ in range(4):
        spark.range(10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = []
    jobs.rebuild_on(stream, lambda df, due: told.append(due), 20, str(tmp_path / "at")).awaitTermination()
    assert told == [True, False, True, False]


def test_resolution_by_candidates(spark):
    rng = np.random.default_rng(4)
    home = rng.normal(size=(6, 8))
    refs = spark.createDataFrame([(int(i), [float(v) for v in home[i] + rng.normal(size=8) * 0.02], True) for i in range(6) for _ in range(3)], "subject_id long, vector array<double>, is_positive boolean")
    asked = spark.createDataFrame([(int(i), [float(v) for v in home[i]], 1.0) for i in range(6)], "fragment_id long, query array<double>, topology double")
    near = ident.lsh_candidates(asked, refs, 8)
    fast, full = ident.resolve(asked, refs, candidates=near), ident.resolve(asked, refs)
    top = lambda df: {(r.fragment_id, r.subject_id, r.decision) for r in df.filter("rank = 1").collect()}
    assert top(fast) == top(full) == {(i, i, "accept") for i in range(6)}
    assert fast.count() == near.count() < full.count()
