"""The engine's queries against DuckDB, and single operators on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from trackmesh.functions import geometry as g
from trackmesh.functions import masks as m
from trackmesh.functions import scalars as s
from trackmesh.operators import identity, suppress
from trackmesh.operators import query as q
from trackmesh.plans import catalog, tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    got = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_lsh_recall(spark, sf):
    e = tables.embeddings(spark, sf)
    asked = e.filter("embedding_ref % 20 = 0").select(F.col("embedding_ref").alias("query_id"), F.col("vector").alias("query"))
    exact = {(r.query_id, r.embedding_ref) for r in identity.top_k(e, asked, 5).collect()}
    got = [(r.query_id, r.embedding_ref) for r in catalog.queries()["lsh_top_k"](spark, sf).collect()]
    assert len(got) == len(set(got)) == len(exact)
    assert len(exact & set(got)) >= 0.9 * len(exact)


def boxes(spark, rows):
    return spark.createDataFrame(rows, "frame long, det_idx long, left double, top double, right double, bottom double, score double, class_id int")


def test_nms_ties_classes_and_exact_overlap(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 0), (1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, 0), (1, 2, 0.0, 0.0, 10.0, 10.0, 0.9, 1), (1, 3, 5.0, 0.0, 15.0, 10.0, 0.8, 0)]
    kept = {r.det_idx for r in suppress.nms(boxes(spark, rows), 1 / 3).collect()}
    assert kept == {0, 2, 3}  # the lower index of a tie, other classes, and a box just at the threshold
    assert {r.det_idx for r in suppress.nms(boxes(spark, rows), 1 / 3, class_aware=False).collect()} == {0, 3}


def test_soft_and_merge_nms(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9, None), (1, 1, 2.0, 0.0, 12.0, 10.0, 0.85, None)]
    soft = {r.det_idx: r.score for r in suppress.soft_nms(boxes(spark, rows), 0.3).collect()}
    assert soft[0] == 0.9 and soft[1] == pytest.approx(0.85 * (1 - 80 / 120))
    merged = suppress.merge_nms(boxes(spark, rows), 0.1).collect()
    assert len(merged) == 1 and merged[0].left == 1.0 and merged[0].score == 0.9 and merged[0].class_id is None


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (10.0, 5.0), (11.0, 5.0)], "x double, y double")
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    assert [r[0] for r in df.select(g.in_polygon(square, F.col("x"), F.col("y"))).collect()] == [True, True, True, False]
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    one = spark.range(1)
    crossing = one.select(g.segments_cross(p(0, 0), p(2, 2), p(0, 2), p(2, 0)), g.segments_cross(p(0, 0), p(1, 1), p(1, 1), p(2, 0)), g.segments_cross(p(0, 0), p(1, 0), p(2, 0), p(3, 0))).first()
    assert tuple(crossing) == (True, True, False)
    assert one.select(g.iou(g.literal_box(0, 0, 0, 0), g.literal_box(0, 0, 0, 0))).first()[0] == 0.0


def test_masks(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 0, 1, 0, 0, 1],), ([1, 0, 0, 0, 0, 0, 0, 0, 0],), ([0] * 9,)], "m array<int>")
    mask = F.col("m")
    got = df.select(m.rle_encode(mask).alias("rle"), m.rle_decode(m.rle_encode(mask)).alias("back"), "m", m.area(mask).alias("area"), m.bbox(mask, F.lit(3)).alias("box"), m.crop(mask, F.lit(3)).alias("crop")).collect()
    assert all(r.back == r.m for r in got)
    assert [list(r.rle) for r in got] == [[1, 2, 2, 1, 2, 1], [0, 1, 8], [9]]
    assert [r.area for r in got] == [4, 1, 0] and tuple(got[0].box) == (1, 0, 3, 3) and got[2].box is None and got[1].crop == [1]
    two = spark.createDataFrame([([1, 1, 0, 0], [0, 1, 1, 0])], "a array<int>, b array<int>").select(m.iou(F.col("a"), F.col("b")), m.union(F.col("a"), F.col("b")), m.difference(F.col("a"), F.col("b"))).first()
    assert two[0] == pytest.approx(1 / 3) and two[1] == [1, 1, 1, 0] and two[2] == [1, 0, 0, 0]


def test_scalars(spark):
    one = spark.range(1)
    inf = float("inf")
    got = one.select(s.z_score(F.lit(3.0), F.lit(1.0), F.lit(0.0)), s.z_score(F.lit(1.0), F.lit(1.0), F.lit(0.0)), s.hour_delta(F.lit(23.0), F.lit(1.0)), s.severity(F.lit(6.0)), s.severity(F.lit(inf))).first()
    assert tuple(got) == (inf, 0.0, 2.0, "critical", "critical")
    arrays = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in arrays.select(s.cosine(F.col("a"), F.col("b"))).collect()] == [None, None, 1.0]


def test_keywords():
    parsed = q.parse_keywords("seen on source 1 and min confidence 0.5 or blah subject 3")
    assert parsed.node[0] == "or" and parsed.warnings == ["unknown word: blah"]
    found = q.parse_keywords("find people seen on source 1 and in zone 2")
    assert found.node == ("and", [("pred", q.SubjectQuery(source_id=1)), ("pred", q.SubjectQuery(zone=2))]) and not found.warnings
    assert len(q.parse_keywords("subject 5 or subject 7").node[1]) == 2
    assert q.parse_keywords("then zone 1 then zone 3 within 5000000000").node[1].then == (1, 3, 5_000_000_000)
    assert q.parse_keywords("route zone 1 2").node[1].route == (1, 2) and q.parse_keywords("confidence >= 0.9").node[1].min_confidence == 0.9
    assert q.parse_keywords("Subject 4, 5 6").node[1].subject_ids == (4, 5, 6)
    for wrong in ("   ", "hello world", "then zone 1 then zone 3 within soon", "then zone 1", "route zone", "near box 1 2 3", "min dwell", "during 5", "zone 70000"):
        with pytest.raises(ValueError):
            q.parse_keywords(wrong)


def test_the_rest_works_without_the_text_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['trackmesh.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'rank_subjects' in e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=sys.path[0]).returncode == 0
