"""The driver's tables seen as the domain's: each projection in DataFrame form, and as a DuckDB table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmesh.operators import memory
from trackmesh.shared import write_once

#: Event types in the order of their ordinals, which serve as classes and zones.
KINDS = ("click", "error", "purchase", "signup", "view")
HOUR, DAY = 3_600_000_000_000, 86_400_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit view: every twentieth sample revises the one before it."""
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    zone = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int")
    left, top = ((n * 37) % 1800).cast("double"), ((n * 53) % 1000).cast("double")
    return e.select(
        (n + 1).alias("sample_id"),
        F.when(n % 20 == 19, n).alias("supersedes"),
        F.when(n % 20 == 19, 2).otherwise(1).cast("long").alias("revision"),
        (n % 97).alias("idempotency_key"),
        (n % 4 + 1).alias("source_id"),
        n.alias("frame_index"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("pts_ns"),
        F.col("user_id").alias("track_id"),
        F.when(n % 7 != 0, F.col("user_id")).alias("subject_id"),
        zone.alias("zone_id"),
        left.alias("left"),
        top.alias("top"),
        (left + 20 + n % 60).alias("right"),
        (top + 40 + n % 80).alias("bottom"),
        (F.lit(0.5) + (n % 50) / 100).alias("confidence"),
        F.when(n % 11 == 0, n % 13).otherwise(0).alias("mask_ref"),
    )


def effective_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.effective(track_samples(spark, sf_dir))


def zone_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.zone_stays(effective_samples(spark, sf_dir))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.routes(zone_stays(spark, sf_dir))


def co_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.co_occurrences(zone_stays(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str, shared: bool = False) -> dict[str, DataFrame]:
    """The analysis inputs: timed, durations, routes, pairs, and the stays that pairs are made of. shared: samples and stays are written once, for
    queries that read them many times."""
    eff = effective_samples(spark, sf_dir).select("sample_id", "source_id", "pts_ns", "subject_id", "zone_id")
    eff = write_once(eff, "samples") if shared else eff
    stays = memory.zone_stays(eff)
    stays = write_once(stays, "stays") if shared else stays
    pairs = memory.co_occurrences(stays)
    return {
        "timed": eff.select("subject_id", "source_id", F.col("pts_ns").alias("at_ns"), F.col("sample_id").alias("event_id"), F.col("zone_id").cast("long").alias("kind_tag")),
        "durations": stays.select("subject_id", "source_id", "zone_id", "duration_ns", F.col("start_ns").alias("at_ns"), F.lit(None).cast("long").alias("event_id")),
        "routes": memory.routes(stays).select("subject_id", "zones", F.col("start_ns").alias("at_ns"), F.lit(None).cast("long").alias("event_id")),
        "pairs": pairs.select("subject_a", "subject_b", F.lit(None).cast("long").alias("source_id"), F.col("start_ns").alias("at_ns"), F.lit(None).cast("long").alias("event_id")),
        "stays": stays.select("subject_id", "zone_id", "start_ns", "end_ns"),
    }


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of boxes: an order is a frame, its lines are boxes; (score, line, part, supplier) is a total order."""
    li = read(spark, sf_dir, "lineitem")
    left, top = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 30).cast("double")
    idx = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")) - 1
    return li.select(
        F.col("l_orderkey").alias("frame"), idx.cast("long").alias("det_idx"), left.alias("left"), top.alias("top"),
        (left + 10 + F.col("l_linenumber")).alias("right"), (top + 10 + F.col("l_linenumber")).alias("bottom"),
        (F.lit(1.0) - F.col("l_discount")).alias("score"), (F.col("l_linenumber") % 2).alias("class_id"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("embedding_ref"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("subject_id"))


#: The same tables for DuckDB; each needs those before it.
SQL = {
    "audit": f"""select event_id + 1 as sample_id, case when event_id % 20 = 19 then event_id end as supersedes, cast(case when event_id % 20 = 19 then 2 else 1 end as bigint) as revision,
  event_id % 97 as idempotency_key, event_id % 4 + 1 as source_id, event_id as frame_index, epoch_us(ts) * 1000 as pts_ns, user_id as track_id,
  case when event_id % 7 <> 0 then user_id end as subject_id, cast(list_position([{", ".join(f"'{k}'" for k in KINDS)}], event_type) as integer) as zone_id,
  cast((event_id * 37) % 1800 as double) as "left", cast((event_id * 53) % 1000 as double) as top,
  cast((event_id * 37) % 1800 + 20 + event_id % 60 as double) as "right", cast((event_id * 53) % 1000 + 40 + event_id % 80 as double) as bottom,
  0.5::double + (event_id % 50) / 100.0::double as confidence, case when event_id % 11 = 0 then event_id % 13 else 0 end as mask_ref from events""",
    "eff": "select * from audit a where not exists (select 1 from audit b where b.supersedes = a.sample_id)",
    "stay_steps": """select *, case when zone_id is distinct from lag(zone_id) over (partition by subject_id order by pts_ns, sample_id) then 1 else 0 end as fresh from eff where subject_id is not null""",
    "stay_islands": "select *, sum(fresh) over (partition by subject_id order by pts_ns, sample_id) as island from stay_steps",
    "stays": "select any_value(zone_id) as zone_id, subject_id, arg_min(source_id, (pts_ns, sample_id)) as source_id, min(pts_ns) as start_ns, max(pts_ns) as end_ns, max(pts_ns) - min(pts_ns) as duration_ns from stay_islands group by subject_id, island",
    "routes": f"""select subject_id, list(zone_id order by start_ns, zone_id) as zones, min(start_ns) as start_ns, max(end_ns) as end_ns from stays group by subject_id, start_ns // {DAY}""",
    "co": """select a.subject_id as subject_a, b.subject_id as subject_b, a.zone_id, greatest(a.start_ns, b.start_ns) as start_ns, least(a.end_ns, b.end_ns) as end_ns,
  least(a.end_ns, b.end_ns) - greatest(a.start_ns, b.start_ns) as overlap_ns
  from stays a join stays b on a.zone_id = b.zone_id and a.subject_id < b.subject_id and a.start_ns < b.end_ns and b.start_ns < a.end_ns""",
    "durs": "select subject_id, source_id, duration_ns, start_ns as at_ns from stays",
    "timed": "select subject_id, source_id, pts_ns as at_ns, sample_id as event_id, cast(zone_id as bigint) as kind_tag from eff",
    "dets": """select l_orderkey as frame, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as bigint) as det_idx,
  cast(l_partkey % 40 as double) as "left", cast(l_suppkey % 30 as double) as top, cast(l_partkey % 40 + 10 + l_linenumber as double) as "right",
  cast(l_suppkey % 30 + 10 + l_linenumber as double) as bottom, 1.0::double - l_discount as score, l_linenumber % 2 as class_id from lineitem""",
    "emb": "select vec_id as embedding_ref, cast(embedding as double[]) as vector, cast(label as bigint) as subject_id from embeddings",
}


def with_tables(body: str, *names: str) -> str:
    """A query over the named tables and those that they need."""
    needs = {
        "audit": (), "eff": ("audit",), "stay_steps": ("eff",), "stay_islands": ("stay_steps",), "stays": ("stay_islands",), "routes": ("stays",), "co": ("stays",), "timed": ("eff",), "durs": ("stays",), "dets": (), "emb": (),
    }
    want: set[str] = set()

    def add(name: str) -> None:
        want.add(name)
        for n in needs[name]:
            add(n)

    for n in names:
        add(n)
    body = body.strip()
    parts = [f"{n} as ({SQL[n]})" for n in SQL if n in want]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body
