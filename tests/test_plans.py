"""Plans that must hold at scale."""

import pytest
from pyspark.sql import functions as F

from stackfall.functions import rules as FR
from stackfall.operators import blocks as B
from stackfall.operators import chunks as H
from stackfall.operators import identity as I
from stackfall.operators import links as L
from stackfall.operators import signals as G
from stackfall.operators import views as V
from stackfall.session import cut, scratch_path
from stackfall.sources.lines import parse_records


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plan") / "lines")
    line = F.lit("09-30 12:00:00.123  7  7 E AndroidRuntime: FATAL EXCEPTION: main")
    spark.range(200).select(
        F.lit("d").alias("device_serial"), F.lit("s").alias("session_id"), F.col("id").alias("seq"),
        F.lit("logcat").alias("source"), F.lit(0).cast("bigint").alias("received_at_ms"), line.alias("line"),
    ).write.parquet(path)
    records = path + "-records"
    parse_records(spark.read.parquet(path)).write.parquet(records)
    return spark.read.parquet(path), spark.read.parquet(records)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parsing_does_not_shuffle(stored):
    assert "Exchange" not in plan(parse_records(stored[0]))


def test_scan_hints_reach_parquet(stored):
    text = plan(stored[1].where(FR.scan_hints(uid=5, tags=["lmkd"])).select("seq"))
    assert "EqualTo(uid,5)" in text and "EqualTo(tag,lmkd)" in text or "In(tag" in text
    assert "message" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("build", [
    lambda lines, records: L.link_deaths(G.ams_signals(records)),
    lambda lines, records: B.crash_events(B.crash_blocks(lines)),
    lambda lines, records: B.live_crash_events(B.live_blocks(records)),
    lambda lines, records: V.tail(records, 10),
    lambda lines, records: I.follow(records, records.select(
        "device_serial", F.array("pid").alias("pids"), "uid", "package", F.lit(True).alias("found"))),
])
def test_no_nested_loops_and_no_single_partition(stored, build):
    text = plan(build(*stored))
    assert "NestedLoop" not in text and "Cartesian" not in text and "SinglePartition" not in text


def test_links_work_out_their_context_once(spark):
    says = [
        "ProcessRecord{ab 7:com.a.main/u0a1}", "isCrashing=true", "Killing 9:com.b/u0a9 (adj 0): crash",
        "nothing", "am_crash: [0,5,com.c,1,x]", "Force stopping com.b", "has died", "Process com.d (pid 4) has died",
    ]
    rows = [
        (f"d{i // 300}", "s", i, "logcat", None, f"09-30 12:00:{i // 10:02}.{i % 10}00  7  7 I ActivityManager: {says[i * 5 % 8]}")
        for i in range(600)
    ]
    kinds = "device_serial string, session_id string, seq bigint, source string, received_at_ms bigint, line string"
    signals = cut(G.ams_signals(parse_records(spark.createDataFrame(rows, kinds))), "signals")
    names = []
    once = L.link_deaths(signals, chunk_rows=50, keep=lambda df, name: names.append(name) or cut(df, name))
    plain = L.link_deaths(signals, chunk_rows=50)
    assert sorted(map(str, once.collect())) == sorted(map(str, plain.collect())) and once.count()
    assert names == ["context"] and 2 * plan(once).count("Window") < plan(plain).count("Window")


def test_log_is_not_shuffled_for_signals(stored):
    """Only words of bits and gated rows move, by hash aggregates: the raw line never crosses an
    exchange unfiltered. With the structure stored, the gated rows meet it and nothing else moves."""
    text = plan(G.ams_signals(stored[1]))
    assert text.count("Exchange hashpartitioning") <= 5 and "bit_or" in text
    assert "SortAggregate" not in text and "partial_bit_or" in text
    ranks = H.line_ranks(stored[1])
    path = scratch_path(stored[1].sparkSession, "ranks")
    ranks.write.parquet(path)
    text = plan(G.ams_signals(stored[1], ranks=stored[1].sparkSession.read.parquet(path)))
    assert text.count("Exchange hashpartitioning") <= 2 and "Aggregate" not in text
