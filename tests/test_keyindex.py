"""Key filters, lookups through them, change feeds, and progress by retractions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.operators import merge, progress
from feedloom.operators.jobs import COUNTS, job_status
from feedloom.plans import stores
from feedloom.session import scratch_path
from feedloom.sources import keyindex
from feedloom.sources.partitioned import PartitionedTable
from feedloom.streaming import streams as S

SCHEMA = "k STRING, n INT"
SF_DIR = "/root/testdata/sf0.001"


def keys(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("k"), "id").alias("k"), F.pmod("id", F.lit(3)).cast("int").alias("part"))


def passed(filters, asked, blocks):
    at = asked.select("k", "part", keyindex.block_of(["k"], F.lit(blocks)).alias("block"), keyindex.positions(["k"]).alias("at"))
    return at.join(filters, ["part", "block"]).where(keyindex.may_hold(F.col("bits"), F.col("at"))).count()


def test_filters_never_deny_and_rarely_err(spark):
    blocks = keyindex.blocks_for(20000 // 3)
    assert blocks == 4 and keyindex.blocks_for(0) == 1
    one, two = (keyindex.build(keys(spark, a, b), ["k"], blocks) for a, b in ((0, 9000), (9000, 20000)))
    whole, built = keyindex.merge(one.unionByName(two), blocks), keyindex.build(keys(spark, 0, 20000), ["k"], blocks)
    order = lambda df: sorted((r.part, r.block, bytes(r.bits)) for r in df.collect())
    assert order(whole) == order(built) and len(order(whole)) == 3 * blocks
    assert passed(whole, keys(spark, 0, 20000), blocks) == 20000
    assert passed(whole, keys(spark, 50000, 70000), blocks) < 600
    folded = keyindex.merge(whole, 2)
    assert passed(folded, keys(spark, 0, 20000), 2) == 20000
    assert passed(folded, keys(spark, 50000, 70000), 2) < 8000


def rows(spark, values):
    return spark.createDataFrame(list(values.items()), SCHEMA)


def shown(df):
    got = df.collect()
    assert len({r.k for r in got}) == len(got)
    return {r.k: r.n for r in got}


@pytest.mark.parametrize("broadcast", [32 << 20, 1])
def test_lookups_through_the_index(spark, monkeypatch, broadcast):
    from feedloom.operators import skew

    monkeypatch.setattr(skew, "MAX_BROADCAST_BYTES", broadcast)
    root = scratch_path(spark, "store")
    plain = PartitionedTable(spark, root, ["k"], SCHEMA, parts=8)
    store = PartitionedTable(spark, root, ["k"], SCHEMA, parts=8, indexed=True)
    assert shown(store.lookup(rows(spark, {"a": 0}))) == {}
    rng, state, history = random.Random(4), {}, []
    for version in range(1, 5):
        changed = {f"k{rng.randrange(300)}": rng.randrange(1000) for _ in range(80)} if version != 3 else {}
        (plain if version == 1 else store).write(rows(spark, changed), version)  # the first layer has no filter
        state |= changed
        history.append(dict(state))
        if version == 3:
            store.compact()
    wanted = {f"k{i}": 0 for i in range(0, 400, 7)}
    asked = rows(spark, wanted).unionByName(rows(spark, {"k0": 1})).unionByName(spark.createDataFrame([(None, 1)], SCHEMA))
    for version, was in enumerate(history, 1):
        if version >= 3:
            assert shown(store.lookup(asked, version)) == {k: v for k, v in was.items() if k in wanted}
    assert shown(store.lookup(asked.limit(0))) == {}
    store.compact()
    store.remove(keep=1)
    assert len(store._names("index")) == 1
    assert shown(store.read()) == state and shown(store.lookup(asked)) == {k: v for k, v in state.items() if k in wanted}


def test_only_named_partitions_are_read(spark):
    store = PartitionedTable(spark, scratch_path(spark, "store"), ["k"], SCHEMA, parts=8, indexed=True)
    store.write(rows(spark, {f"k{i}": i for i in range(200)}), 1)
    store.compact()
    store.write(rows(spark, {"k4": -4, "z": 0}), 2)
    new = rows(spark, {f"new{i}": 0 for i in range(50)})
    _, named = store.hits(new)
    assert sum(map(len, named.values())) < 8  # of up to 16; a filter may err
    found, named = store.hits(rows(spark, {"k4": 0}))
    part = rows(spark, {"k4": 0}).select(store._part()).first().part
    assert list(named.values()) == [[part], [part]]
    for layer in store._names("data"):  # nothing else is read
        for other in {n for n in store._names("data", layer) if n.startswith("part=")} - {f"part={part}"}:
            path, fs = store._path("data", layer, other)
            fs.delete(path, True)
    looked = store.lookup(rows(spark, {"k4": 0}))
    assert shown(looked) == {"k4": -4}
    plan = looked._jdf.queryExecution().executedPlan().toString()
    scans = [s for s in plan.splitlines() if "FileScan parquet" in s and "/data/" in s]
    assert scans and all("part#" in s.split("PartitionFilters")[1].split("PushedFilters")[0] for s in scans)


def test_changes_lead_from_one_version_to_the_next(spark):
    lists = stores.author_versions(spark, SF_DIR)
    feed = merge.bridge_changes(lists.changes(1, 2))
    before, after = merge.author_bridge(lists.read(1)), merge.author_bridge(lists.read(2))
    got = merge.apply_bridge_changes(before.withColumn("position", F.col("position").cast("int")), feed)
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(got) == order(after) != order(before) and feed.where("change = 'delete'").count() > 0
    assert lists.changes(2, 2).count() == 0
    lists.compact()
    assert order(merge.bridge_changes(lists.changes(1, 2))) == order(feed)  # the manifest before is still kept
    lists.remove(keep=1)
    with pytest.raises(ValueError, match="not all kept"):
        lists.changes(1, 2)


def walk(spark, batches):
    state = {}
    for batch in batches:
        for row in sorted(batch, key=lambda r: r[5]):
            state[row[0]] = row[:5]
        yield sorted(map(tuple, job_status(spark.createDataFrame([(j,) for j in range(6)], "job_id long"), spark.createDataFrame(list(state.values()), progress.TASK_STATE)).collect()))


def test_progress_by_retractions_equals_a_recount(spark):
    rng, seq = random.Random(6), 0
    batches = []
    for size in (40, 25, 25):
        batch = []
        for _ in range(size):
            seq += 1
            status = rng.choice(["pending", "processing", "completed", "failed", "cancelled"])
            job = 0 if rng.random() < 0.5 else rng.randrange(6)
            batch.append((f"t{rng.randrange(30)}", job, status, rng.choice([None, 3]), rng.choice([None, 1]), seq))
        batches.append(batch)
    store = progress.ProgressStore.at(spark, scratch_path(spark, "progress"), parts=4)
    all_jobs = spark.createDataFrame([(j,) for j in range(6)], "job_id long")
    columns = ["job_id", *COUNTS, "status"]
    for version, (batch, want) in enumerate(zip(batches, walk(spark, batches), strict=True), 1):
        changes = spark.createDataFrame(batch, f"{progress.TASK_STATE}, seq long")
        progress.advance(store, changes, version)
        progress.advance(store, changes, version)  # delivered again
        assert sorted(map(tuple, progress.current_status(store, all_jobs).select(columns).collect())) == want
    assert store.jobs.newest() == store.tasks.newest() == 3


def test_streams_go_on_behind_the_history_of_their_tables(spark, tmp_path):
    schema = "at TIMESTAMP, status STRING"
    table = PartitionedTable(spark, scratch_path(spark, "rates"), ["window_start"], S.RATES, parts=4)
    times = ["2024-01-01 00:10:00", "2024-01-05 10:00:00", "2024-01-01 00:50:00", "2024-01-01 00:20:00"]
    want = Counter()
    for i, at in enumerate(times):  # the last two are days behind what was seen before
        folder = f"{tmp_path}/{i // 2}"
        spark.createDataFrame([(at, "error" if i % 2 else "ok")], "at STRING, status STRING").select(F.to_timestamp("at").alias("at"), "status").write.mode("append").parquet(folder)
        want[at[:13]] += 1
        if i % 2:  # a new checkpoint on the same table
            stream = S.stream_rates(S.file_stream(spark, folder, schema, maxFilesPerTrigger="1"), table, f"{tmp_path}/checkpoint{i}")
            stream.awaitTermination()
            assert not stream.lastProgress["stateOperators"]
            S.stream_rates(S.file_stream(spark, folder, schema), table, f"{tmp_path}/checkpoint{i}").awaitTermination()
    got = {str(r.window_start)[:13]: r.results for r in table.read().collect()}
    assert got == dict(want) and sum(r.errors for r in table.read().collect()) == 2
