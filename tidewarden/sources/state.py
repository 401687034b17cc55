"""Versioned state tables: a folder for each batch and a pointer to the one that holds."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlay

Table = DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]


@dataclass
class Layer:
    """What a batch changes in a table: rows with ``deleted`` by key, or without keys more rows.

    ``marks``: deletions are kept for readers, as they hide rows of another table."""

    delta: DataFrame
    keys: tuple[str, ...] = ()
    marks: bool = False


class Snapshots:
    """Tables by name under a root that all machines reach, through Spark's file system layer.

    A batch writes to ``v{batch}`` and then moves the pointer; doing a batch again writes the same
    place, so replays change nothing. A table is whole, or made of layers: a batch writes only the
    rows that changed, with ``deleted`` for those that went, and every ``most_layers`` batches the
    layers are written as one."""

    def __init__(self, spark: SparkSession, root: str, most_layers: int = 16):
        self.spark, self.root, self.most_layers = spark, root.rstrip("/"), most_layers
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._path(f"{self.root}/{name}")))

    def _read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        lines = self.spark.read.text(f"{self.root}/{name}").collect()  # one line
        return lines[0][0] if lines else None

    def version(self) -> int | None:
        """The batch that the pointer names: the newest of the files ``current-{n}``, which only a finished batch makes."""
        root = self._path(self.root)
        if not self._fs.exists(root):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        found = [int(x.split("-")[1]) for x in names if x.startswith("current-")]
        return max(found, default=None)

    def _pointer(self) -> dict:
        v = self.version()
        return {} if v is None else json.loads(self._read(f"current-{v:012d}") or "{}")

    def progress(self) -> dict | None:
        return None if self.version() is None else {k: x for k, x in self._pointer().items() if k != "_layers"}

    def layered(self) -> set[str]:
        """Names of the tables that are made of layers."""
        return set(self._pointer().get("_layers", {}))

    def _merged(self, name: str, layer: dict) -> DataFrame:
        """Layers from the newest on, of each key the newest row; deletions stay where they mark what lies outside."""
        tiers = [self.spark.read.parquet(f"{self.root}/v{b}/{name}") for b in layer["from"]]
        if layer["keys"]:
            out = overlay.overlay(*tiers, keys=tuple(layer["keys"]), keep_deleted=True)
            return out if layer["marks"] else out.where(~F.col("deleted")).drop("deleted")
        return reduce(DataFrame.unionByName, tiers)

    def _table(self, name: str, version: int, layers: dict) -> DataFrame:
        return self._merged(name, layers[name]) if name in layers else self.spark.read.parquet(f"{self.root}/v{version}/{name}")

    def table(self, name: str) -> DataFrame | None:
        v = self.version()
        return None if v is None else self._table(name, v, self._pointer().get("_layers", {}))

    def commit(self, batch: int, tables: Mapping[str, Table] | None = None, progress: dict | None = None, layers: Mapping[str, Layer] | None = None) -> bool:
        """False, and nothing done, if this batch or a later one is there already.

        Layers are written first. A table may be a function that gets a reader of the new tables."""
        v = self.version()
        if v is not None and v >= batch:
            return False
        known = self._pointer().get("_layers", {})
        for name, x in (layers or {}).items():
            before = known.get(name, {"from": []})["from"]
            (x.delta.sortWithinPartitions(*x.keys) if x.keys else x.delta).write.mode("overwrite").parquet(f"{self.root}/v{batch}/{name}")
            known[name] = {"keys": list(x.keys), "marks": x.marks, "from": [batch, *before]}
            if len(known[name]["from"]) > self.most_layers:
                whole = self._merged(name, known[name])
                whole = whole if x.marks or not x.keys else whole.withColumn("deleted", F.lit(False))
                (whole if x.keys else whole.distinct()).write.mode("overwrite").parquet(f"{self.root}/v{batch}/{name}-whole/{name}")
                known[name]["from"] = [f"{batch}/{name}-whole"]
        for name, df in (tables or {}).items():
            made = df(lambda x: self._table(x, batch, known)) if callable(df) else df
            made.write.mode("overwrite").parquet(f"{self.root}/v{batch}/{name}")
        tmp, to = self._path(f"{self.root}/.tmp-{batch}"), self._path(f"{self.root}/current-{batch:012d}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps({**(progress or {}), "_layers": known} if known else progress or {}).encode()))
        out.close()
        return bool(self._fs.rename(tmp, to))

    def drop_before(self, batch: int) -> None:
        """Old versions and pointers go, once no reader needs them; those that layers are read from stay."""
        used = {int(str(b).split("/")[0]) for x in self._pointer().get("_layers", {}).values() for b in x["from"]}
        for f in self._fs.listStatus(self._path(self.root)):
            n = f.getPath().getName()
            k = int(n[1:]) if n.startswith("v") and n[1:].isdigit() else int(n[8:]) if n.startswith("current-") else batch
            if k < batch and (n.startswith("current-") or k not in used):
                self._fs.delete(f.getPath(), True)
