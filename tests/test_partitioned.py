"""Partitioned keyed tables: versions, pruning, commits, compaction and removal."""

from __future__ import annotations

import random

import pytest

from feedloom.session import scratch_path
from feedloom.sources.partitioned import PartitionedTable

SCHEMA = "k STRING, n INT"


@pytest.fixture
def store(spark):
    return PartitionedTable(spark, scratch_path(spark, "store"), ["k"], SCHEMA, parts=8)


def rows(spark, values):
    return spark.createDataFrame(list(values.items()), SCHEMA)


def shown(df):
    got = df.collect()
    assert len({r.k for r in got}) == len(got)
    return {r.k: r.n for r in got}


def test_versions_against_a_dictionary(spark, store):
    rng, state, history = random.Random(2), {}, {0: {}}
    assert shown(store.read()) == {} and store.newest() == 0
    for version in range(1, 6):
        changed = {f"k{rng.randrange(40)}": rng.randrange(1000) for _ in range(rng.choice([0, 3, 20]))}
        assert store.write(rows(spark, changed), version) and not store.write(rows(spark, {"k1": -1}), version)
        state |= changed
        history[version] = dict(state)
        if version == 3:
            store.compact()
    assert all(shown(store.read(v)) == want for v, want in history.items())
    some = rows(spark, {"k1": 0, "k7": 0, "none": 0}).unionByName(rows(spark, {"k1": 1}))
    assert shown(store.lookup(some)) == {k: v for k, v in state.items() if k in ("k1", "k7")}
    assert shown(store.lookup(some.limit(0))) == {}
    store.compact()
    store.remove(keep=1)
    assert shown(store.read()) == state and len(store._manifests()) == 1 and len(store._names("data")) == 1
    assert not store.maintain(changes=1) and store.write(rows(spark, {"z": 1}), 6) and store.maintain(changes=1)
    assert shown(store.read()) == state | {"z": 1}


def test_lookup_reads_only_partitions_of_its_keys(spark, store):
    store.write(rows(spark, {f"k{i}": i for i in range(200)}), 1)
    store.compact()
    store.write(rows(spark, {f"k{i}": -i for i in range(0, 200, 2)}), 2)
    found = store.lookup(rows(spark, {"k4": 0}))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "layer=" not in line.split("Location")[0] and "part#" in line]
    assert len(scans) >= 2 and all("PartitionFilters: [isnotnull(part#" in s or "PartitionFilters: [(part#" in s for s in scans)
    assert shown(found) == {"k4": -4}
    mine = {f"part={r.part}" for r in rows(spark, {"k4": 0}).select(store._part()).collect()}
    for layer in store._names("data"):  # nothing else is read
        for part in {n for n in store._names("data", layer) if n.startswith("part=")} - mine:
            path, fs = store._path("data", layer, part)
            fs.delete(path, True)
    assert shown(store.lookup(rows(spark, {"k4": 0}))) == {"k4": -4}


def test_layers_without_a_manifest_do_not_exist(spark, store):
    store.write(rows(spark, {"a": 1}), 1)
    store._add(rows(spark, {"a": 2}), 2)  # a writer that was lost before its commit
    assert shown(store.read()) == {"a": 1} and store.newest() == 1
    with pytest.raises(FileExistsError):
        store._commit(1, {"version": 9, "layers": []})
    assert shown(store.read()) == {"a": 1} and store.write(rows(spark, {"a": 3}), 2)
    store.remove(keep=1)
    assert shown(store.read()) == {"a": 3} and len(store._names("data")) == 2
