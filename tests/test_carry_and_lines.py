"""As-of scores on a carry and on a stream, CSV lines that do not fit, rows
from footers, newest names."""

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from arrears.operators import asof
from arrears.session import pin
from arrears.sources import dossiers, history, model_store
from arrears.streaming import asof_stream
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def cases(spark):
    return pin(dossiers.testbed_history(spark, SF_SMALL).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in asof_stream.CASES.fields]))


@pytest.fixture(scope="module")
def whole(cases):
    return sorted(map(tuple, asof.asof_scorecards(cases).collect()))


def halves(cases):
    day = F.lit("1995-01-01").cast("timestamp_ntz")
    return cases.where(F.col("created_at") < day), cases.where(F.col("created_at") >= day)


@pytest.mark.parametrize("partitions", [None, 1, 13])
def test_half_on_a_carry_plus_half_is_the_whole(cases, whole, partitions):
    first, second = halves(cases)
    carry = pin(asof.carry_of(first))
    got = asof.asof_scorecards(first, num_partitions=partitions).collect() + asof.asof_scorecards(
        second, num_partitions=partitions, carry=carry).collect()
    assert sorted(map(tuple, got)) == whole
    both = {(r.dim, r.entity): r for r in asof.merge_carries(carry, asof.carry_of(second)).collect()}
    assert {k: tuple(r) for k, r in both.items()} == {(r.dim, r.entity): tuple(r) for r in asof.carry_of(cases).collect()}


def test_a_batch_on_a_carry_reads_only_its_own_cases(spark, cases, tmp_dir, monkeypatch):
    first, second = halves(cases)
    first.write.parquet(f"{tmp_dir}/first")
    second.write.parquet(f"{tmp_dir}/second")
    asof.carry_of(spark.read.parquet(f"{tmp_dir}/first")).write.parquet(f"{tmp_dir}/carry")
    plans = []
    monkeypatch.setattr(asof, "pin", lambda df, *p: plans.append(df._jdf.queryExecution().executedPlan().toString()) or pin(df, *p))
    asof.asof_scorecards(spark.read.parquet(f"{tmp_dir}/second"), carry=spark.read.parquet(f"{tmp_dir}/carry")).count()
    assert plans and all(f"{tmp_dir}/first" not in p for p in plans)
    assert "Join" not in plans[0] and f"{tmp_dir}/second" in plans[0] and f"{tmp_dir}/carry" in plans[0]


def test_stream_in_parts_with_restarts_and_a_crash(spark, cases, whole, tmp_dir, monkeypatch):
    first, second = halves(cases)
    place = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/checkpoint"
    first.write.mode("append").parquet(place[0])
    asof_stream.start(spark, *place).awaitTermination()
    second.write.mode("append").parquet(place[0])
    moved = asof.merge_carries
    monkeypatch.setattr(asof, "merge_carries", lambda *c: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(Exception):  # the cases are written, the carry is not
        asof_stream.start(spark, *place).awaitTermination()
    monkeypatch.setattr(asof, "merge_carries", moved)
    for _ in range(2):
        asof_stream.start(spark, *place).awaitTermination()
        assert sorted(map(tuple, asof_stream.scored(spark, place[1]).collect())) == whole
    assert len(os.listdir(f"{place[1]}/carry")) <= asof_stream.KEPT_CARRIES


def test_a_lost_carry_is_an_error(spark, cases, tmp_dir):
    with pytest.raises(FileNotFoundError):
        asof_stream.replay_batch(cases, 3, f"{tmp_dir}/out")


def test_bad_lines_are_set_aside_whole(spark, tmp_dir):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("a int, b string, c date")
    with open(f"{tmp_dir}/x.csv", "w", encoding="utf-8") as f:
        f.write('a,b,c\n1,é,2020-01-02\nx,y,2020-01-02\n2,"q, r",\n3,z,2020-13-02\n4,z,2020-01-02,5\n5,z\n,,\n')
    rows, bad = history.read_csv_lines(spark, f"{tmp_dir}/x.csv", schema)
    assert sorted(map(str, (tuple(r)[:2] for r in rows.collect()))) == sorted(map(str, [(1, "é"), (2, "q, r"), (None, None)]))
    assert sorted(r.line for r in bad.collect()) == ["3,z,2020-13-02", "4,z,2020-01-02,5", "5,z", "x,y,2020-01-02"]
    assert all(r.file.endswith("x.csv") for r in bad.collect())
    with pytest.raises(FileNotFoundError):
        history.read_csv_lines(spark, f"{tmp_dir}/none.csv", schema)


def test_rows_come_from_footers(spark):
    path = f"{SF_SMALL}/lineitem.parquet"
    plan = history.footer_count(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert history.footer_rows(spark, path) == spark.read.parquet(path).count()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_newest_is_what_the_store_lists(spark, tmp_dir):
    names = ["rf_20200101_000000", "rf_20191231_235959", "rf_x_1", "rf_", "rfa_9", "_", "rf", "km_1", "a__b"]
    for n in names:
        os.makedirs(f"{tmp_dir}/store/{n}")
    prefixes = ["rf", "rf_x", "km", "none", "a", "a_", ""]
    got = {r.prefix: r.newest for r in model_store.newest(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in prefixes], "prefix string")).collect()}
    for p in prefixes:
        try:
            want = os.path.basename(model_store.latest_model_path(spark, f"{tmp_dir}/store", p))
        except FileNotFoundError:
            want = None
        assert got[p] == want, p


def test_stamps_agree(spark):
    now = datetime(2024, 2, 29, 23, 5, 9)
    row = spark.createDataFrame([(now,)], "t timestamp_ntz").select(model_store.stamp_of("t").alias("s")).first()
    assert row.s == model_store.stamp(now) == "20240229_230509"


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_scoring_time_is_utc_in_any_session_zone(spark, zone):
    rows = spark.range(1).select("id", F.lit("D").alias("dossier_id"), F.lit("P").alias("procedure_id"))
    for f in history.STORED_SCHEMA.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = history.to_history_rows(rows, "b").first().created_at
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert abs((datetime.now(timezone.utc).replace(tzinfo=None) - at).total_seconds()) < 60
