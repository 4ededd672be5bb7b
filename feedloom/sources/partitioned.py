"""Keyed tables as Parquet layers in hash partitions, named by a manifest.

A version is a layer of changed rows, laid out by a hash of the key. The manifest lists the layers that make up the table
and the partitions each has; it is written beside the others under the next number and renamed into place, which fails if
another writer was first. A layer that no manifest names does not exist, so neither a task that runs again nor a marker
file decides what is read.

A lookup by keys reads the partitions these keys hash to, in the base and in the changes, and filters by the keys below the
fold of the changes: its cost follows the batch, not the table. An ``indexed`` table has a Bloom filter of the keys for every
partition of every layer; a lookup of few keys asks these first, reads the partitions of the layers that may hold one of the keys, and of
them the rows whose key is wanted, so a wrong yes costs a read and never a row. Compaction folds all layers into one; layers and manifests
that are not needed any more are removed by rule.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from feedloom.operators.skew import bounded, restrict
from feedloom.session import cut_lineage
from feedloom.sources import keyindex

PARTS = 64
#: Changes on top of a base before :meth:`PartitionedTable.maintain` folds them, and manifests it keeps for readers.
MAX_CHANGES = 16
KEPT_MANIFESTS = 2
#: A lookup by at least one key for so many that the filters have room for reads every partition, whatever they answer.
KEYS_PER_ASKED = 10


@dataclass(frozen=True)
class PartitionedTable:
    """A table at ``root`` whose rows are unique on ``keys``; ``parts`` must stay what it was when the table began."""

    spark: SparkSession
    root: str
    keys: Sequence[str]
    schema: str
    parts: int = PARTS
    indexed: bool = False

    def _struct(self) -> StructType:
        return StructType.fromDDL(self.schema)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int").alias("part")

    def _path(self, *names: str) -> tuple[Any, Any]:
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        path, fs = self._path(*names)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _manifests(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._names("manifest") if n.endswith(".json") and n[0] != "."]

    def _load_manifest(self, number: int) -> dict[str, Any]:
        path, fs = self._path("manifest", f"{number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self, version: int | None = None) -> tuple[int, dict[str, Any]]:
        """Number and contents of the newest manifest, or of the newest one that goes up to ``version``."""
        for number in reversed(self._manifests()):
            found = self._load_manifest(number)
            if version is None or found["version"] <= version:
                return number, found
        return 0, {"version": 0, "layers": []}

    def _commit(self, number: int, manifest: dict[str, Any]) -> None:
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext
        draft, fs = self._path("manifest", f".{uuid.uuid4().hex}")
        final, _ = self._path("manifest", f"{number:012d}.json")
        stream = fs.create(draft)
        stream.writeBytes(json.dumps(manifest))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), context._jsc.hadoopConfiguration())
        keep_old = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, final, keep_old)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(final):
                raise FileExistsError(f"another writer committed manifest {number} of {self.root}") from error
            raise

    def _add(self, rows: DataFrame, version: int) -> dict[str, Any]:
        """Write a layer and describe it; it takes part in the table when a manifest names it."""
        name = f"{version:010d}-{uuid.uuid4().hex}"
        path = f"{self.root}/data/layer={name}"
        laid = rows.select(*self._struct().names, self._part()).repartition(self.parts, "part")
        laid.write.partitionBy("part").parquet(path)
        parts = [int(n.split("=")[1]) for n in self._names("data", f"layer={name}") if n.startswith("part=")]
        return {"name": name, "version": version, "parts": parts} | (self._index(name) if self.indexed and parts else {})

    def _index(self, name: str) -> dict[str, Any]:
        """Write the filters of a layer and tell their size, which follows its largest partition."""
        rows = self._rows([name])
        blocks = keyindex.blocks_for(rows.groupBy("part").count().agg(F.max("count")).first()[0])
        keyindex.build(rows, self.keys, blocks).write.mode("overwrite").parquet(f"{self.root}/index/layer={name}")
        return {"blocks": blocks}

    def newest(self) -> int:
        """The last committed version, 0 of an empty table."""
        return self._manifest()[1]["version"]

    def write(self, changed: DataFrame, version: int) -> bool:
        """Commit the changed rows as ``version`` (from 1 on). A version that was committed already stays as it is."""
        number, manifest = self._manifest()
        if version <= manifest["version"]:
            return False
        layer = self._add(changed, version) | {"kind": "change"}
        self._commit(number + 1, {"version": version, "layers": [*manifest["layers"], layer]})
        return True

    def _rows(self, names: list[str]) -> DataFrame:
        schema = StructType(self._struct().fields).add("layer", StringType()).add("part", IntegerType())
        paths = [f"{self.root}/data/layer={name}" for name in names]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths)

    def _load(self, layers: list[dict[str, Any]], touched: list[int] | None) -> DataFrame | None:
        used = [x for x in layers if x["parts"] and (touched is None or not set(touched).isdisjoint(x["parts"]))]
        if not used:
            return None
        rows = self._rows([x["name"] for x in used])
        return rows if touched is None else rows.where(F.col("part").isin(touched))

    def _hits(self, keys: DataFrame, layers: list[dict[str, Any]]) -> DataFrame:
        """``keys`` with every ``layer`` and ``part`` whose filter does not deny them; layers without filters deny nothing."""
        schema = "layer STRING, part INT, block BIGINT, bits BINARY"
        sized = F.explode(F.array(*[F.struct(F.lit(x["name"]).alias("layer"), F.lit(x.get("blocks", 0)).alias("blocks"), F.array(*map(F.lit, x["parts"])).alias("parts")) for x in layers]))
        asked = keys.select(*self.keys, self._part(), sized.alias("x")).where(F.array_contains("x.parts", F.col("part")))
        asked = asked.select(*self.keys, "part", "x.layer", "x.blocks")
        plain = asked.where("blocks = 0").select(*self.keys, "layer", "part")
        paths = [f"{self.root}/index/layer={x['name']}" for x in layers if x.get("blocks")]
        if not paths:
            return plain
        index = self.spark.read.schema(schema).option("basePath", f"{self.root}/index").parquet(*paths)
        asked = asked.where("blocks > 0").select(*self.keys, "part", "layer", keyindex.block_of(self.keys, F.col("blocks")).alias("block"), keyindex.positions(self.keys).alias("at"))
        found = index.join(bounded(asked), ["layer", "part", "block"]).where(keyindex.may_hold(F.col("bits"), F.col("at")))
        return found.select(*self.keys, "layer", "part").unionByName(plain)

    def hits(self, wanted: DataFrame, version: int | None = None) -> tuple[DataFrame, dict[str, list[int]]]:
        """What a lookup by ``wanted`` reads: keys with the layers and partitions that may hold them, and these by layer.

        The driver gets one row per layer and partition at most.
        """
        layers = [x for x in self._manifest(version)[1]["layers"] if x["parts"]]
        keys = wanted.select(*self.keys).distinct()
        if not layers:
            return keys.select(*self.keys, F.lit("").alias("layer"), F.lit(0).alias("part")).limit(0), {}
        found = cut_lineage(self._hits(keys, layers))
        named = found.groupBy("layer").agg(F.sort_array(F.collect_set("part")).alias("parts")).collect()
        return found, {r["layer"]: r["parts"] for r in named}

    def _asks_few(self, wanted: DataFrame, layers: list[dict[str, Any]]) -> bool:
        """Whether ``wanted`` is so few keys, next to the largest filters, that asking the filters can spare reads."""
        room = max([x["blocks"] * len(x["parts"]) for x in layers if x.get("blocks")], default=0) * keyindex.BLOCK_BITS // keyindex.BITS_PER_KEY
        return wanted.count() * KEYS_PER_ASKED < room

    def _load_hits(self, layers: list[dict[str, Any]], found: DataFrame, named: dict[str, list[int]]) -> DataFrame | None:
        used = {x["name"]: named[x["name"]] for x in layers if x["name"] in named}
        if not used:
            return None
        named_parts = reduce(or_, [(F.col("layer") == name) & F.col("part").isin(parts) for name, parts in used.items()])
        wanted = found.select(*self.keys, "layer").where(F.col("layer").isin(list(used)))
        return self._rows(list(used)).where(named_parts).join(bounded(wanted), [*self.keys, "layer"], "left_semi")

    def read(self, version: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """The table as of ``version`` (default: the newest), or the rows of it whose keys occur in ``wanted``."""
        _, manifest = self._manifest(version)
        found = []
        if wanted is not None and self.indexed and self._asks_few(wanted, manifest["layers"]):
            hits, named = self.hits(wanted, version)
            load = lambda layers: self._load_hits(layers, hits, named)
        elif wanted is not None:
            keys = wanted.select(*self.keys).distinct()
            touched = sorted(r.part for r in keys.select(self._part()).distinct().collect())  # ``parts`` numbers at most

            def load(layers: list[dict[str, Any]]) -> DataFrame | None:
                rows = self._load(layers, touched)
                return rows if rows is None else restrict(rows, keys, self.keys, unique=True)
        else:
            load = lambda layers: self._load(layers, None)
        for kind in ("base", "change"):
            found.append(load([x for x in manifest["layers"] if x["kind"] == kind]))
        return self._folded(*found)

    def _folded(self, base: DataFrame | None, changes: DataFrame | None) -> DataFrame:
        names = self._struct().names
        if changes is None:
            return (self.spark.createDataFrame([], self._struct()) if base is None else base).select(names)
        row = F.struct(*names)
        newest = changes.groupBy(*self.keys).agg(F.max_by(row, F.substring("layer", 1, 10).cast("int")).alias("_row")).select("_row.*")
        if base is None:
            return newest
        return base.join(newest.select(*self.keys), list(self.keys), "left_anti").select(names).unionByName(newest)

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Keys whose row differs between two versions, with the rows ``before`` (null: none yet) and ``after``.

        Needs the layers of all versions in between, so it has to be asked before a compaction of them is :meth:`remove`-d.
        """
        until = self.newest() if until is None else until
        whole = [m for m in map(self._load_manifest, self._manifests()) if m["version"] == until]
        layers = [x for x in (whole[0]["layers"] if whole else []) if x["version"] > since]
        if until > since and (not whole or any(x["kind"] == "base" for x in layers)):
            raise ValueError(f"the changes of versions {since + 1} to {until} are not all kept")
        rows = self._load(layers, None)
        keys = (self.read(until).limit(0) if rows is None else rows).select(*self.keys).distinct()
        new = self.read(until, keys).select(*self.keys, F.struct(*self._struct().names).alias("after"))
        old = self.read(since, keys).select(*self.keys, F.struct(*self._struct().names).alias("before"))
        return new.join(old, list(self.keys), "left").where(~F.col("before").eqNullSafe(F.col("after"))).select(*self.keys, "before", "after")

    def lookup(self, wanted: DataFrame, version: int | None = None) -> DataFrame:
        """The rows whose keys occur in ``wanted``; reads only the partitions these keys are in."""
        return self.read(version, wanted)

    def compact(self, version: int | None = None) -> None:
        """Fold all layers, up to the newest version, into a base. Readers of older manifests keep theirs until :meth:`remove`."""
        number, manifest = self._manifest()
        if version is not None and version != manifest["version"]:
            raise ValueError("only the newest version can be compacted")
        layer = self._add(self.read(manifest["version"]), manifest["version"]) | {"kind": "base"}
        self._commit(number + 1, {"version": manifest["version"], "layers": [layer]})

    def remove(self, keep: int = KEPT_MANIFESTS) -> None:
        """Delete all but the newest ``keep`` manifests, and the layers that none of these names."""
        numbers = self._manifests()
        old, kept = numbers[:-keep], numbers[-keep:]
        named = {x["name"] for n in kept for x in self._load_manifest(n)["layers"]}
        for number in old:
            path, fs = self._path("manifest", f"{number:012d}.json")
            fs.delete(path, False)
        for folder in ("data", "index"):
            for name in self._names(folder):
                if name.removeprefix("layer=") not in named:
                    path, fs = self._path(folder, name)
                    fs.delete(path, True)

    def maintain(self, changes: int = MAX_CHANGES, keep: int = KEPT_MANIFESTS) -> bool:
        """Compact and remove if there are ``changes`` layers of changes or more. To be called by the table's one writer."""
        due = sum(x["kind"] == "change" for x in self._manifest()[1]["layers"]) >= changes
        if due:
            self.compact()
            self.remove(keep)
        return due
