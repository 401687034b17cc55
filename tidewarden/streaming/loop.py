"""The endless run: change files in micro-batches over kept state."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from ..operators import changes, coastlines, elements, issues, overlay
from ..operators._state import checkpoint, drop, shared_folder
from ..sources import specs
from ..sources.state import Layer, Snapshots
from .analyzers import Admins, Analyzer, Changed, Coastlines, Names

log = logging.getLogger(__name__)
PAYLOAD = ("lat", "lon", "nodes", "members", "tags")
EDGES = ("node_way", "way_relation", "node_relation", "tracked")


@dataclass
class Elements:
    """What analyzers read: elements after overlay, and the expected state."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    expected: DataFrame

    def tagged(self) -> DataFrame:
        """(etype, id, deleted, tags) of all elements that have tags."""
        kinds = (("N", self.nodes), ("W", self.ways), ("R", self.relations))
        return reduce(DataFrame.unionByName, [d.where(F.size("tags") > 0).select(F.lit(k).alias("etype"), "id", F.lit(False).alias("deleted"), "tags") for k, d in kinds])


@dataclass
class Engine:
    """Base tables (nodes, ways, relations), a state folder, the expected areas, and the analyzers to run.

    A batch is merged, laid over the state, and only what it affects is evaluated again; what changed
    is written as layers of the state's tables, the issues with them, and then the pointer. The state
    depends on the batch number alone, so a batch that is replayed is skipped; what a crash kept from
    being published is published then. ``publish_to`` gets the issues as one JSON document, if the data
    is fresh or what is there is older."""

    spark: SparkSession
    base: dict[str, DataFrame]
    snapshots: Snapshots
    expected: DataFrame
    analyzers: list[Analyzer] = field(default_factory=lambda: [Coastlines(), Admins(), Names()])
    publish_to: str | None = None
    now: Callable[[], float] = time.time

    def _typed(self, kind: str, state: DataFrame | None) -> DataFrame:
        cols = {"N": ("lat", "lon", "tags"), "W": ("nodes", "tags"), "R": ("members", "tags")}[kind]
        name = {"N": "nodes", "W": "ways", "R": "relations"}[kind]
        base = self.base[name].select("id", *cols, F.lit(False).alias("deleted"))
        if state is None:
            return base.drop("deleted")
        top = state.where(F.col("etype") == kind).select("id", *cols, "deleted")
        return overlay.overlay(top, base, keys=("id",)).drop("deleted")

    def elements(self, state: DataFrame | None = None) -> Elements:
        return Elements(self._typed("N", state), self._typed("W", state), self._typed("R", state), self.expected)

    def bootstrap(self, seq: int = 0, end_s: int | None = None) -> bool:
        """Snapshot 0: all analyzers over the base; False if it is there."""
        if self.snapshots.version() is not None:
            self._publish()
            return False
        e = self.elements()
        layers = {}
        for a in self.analyzers:
            for name, df in a.full(e).items():
                layers[name] = Layer(df.withColumn("deleted", F.lit(False)), a.tables[name])
        none = self.base["nodes"].limit(0)
        empty = none.select(F.lit("N").alias("etype"), "id", F.lit(False).alias("deleted"), F.lit(0).alias("version"), "lat", "lon", F.array().cast("array<bigint>").alias("nodes"), F.array().cast("array<struct<type:string,ref:bigint,role:string>>").alias("members"), "tags")
        layers["state"] = Layer(empty, ("etype", "id"), marks=True)
        ways = e.ways.where(filters.COASTLINE.scan(F.col("tags")))
        layers |= {k: Layer(df) for k, df in self._edges(e.relations, e.ways, ways).items()}
        return self._commit(0, layers, e, F.current_timestamp(), seq, end_s)

    def _edges(self, relations: DataFrame, ways: DataFrame, more: DataFrame) -> dict[str, DataFrame]:
        """Edges of relations and their ways, and of more ways and their nodes."""
        out = changes.tracker_edges(elements.relation_members(relations), elements.way_nodes(ways))
        out["node_way"] = out["node_way"].unionByName(elements.way_nodes(more).select("node_id", "way_id")).distinct()
        return out

    def _commit(self, batch: int, layers: dict[str, Layer], e: Elements, run_ts, seq: int, end_s: int | None) -> bool:
        s = self.snapshots
        old = {k: s.table(k) for k in ("issues", "header")} if s.version() is not None else {"issues": None, "header": None}

        def current(read) -> DataFrame:
            found = reduce(DataFrame.unionByName, [a.issues(e, read).select("friendly_name", "issue_type", "osm_type", "osm_id", "details") for a in self.analyzers])
            return issues.first_seen(found, old["issues"], run_ts)

        tables = {"issues": current, "header": lambda read: issues.header(read("issues"), run_ts, F.lit(seq), old["header"])}
        done = s.commit(batch, tables, {"seq": seq, "end_s": end_s}, layers)
        self._publish()
        return done

    def _publish(self) -> None:
        """The issues of the newest snapshot, for readers outside; nothing if that is done. A failure leaves it to the next call."""
        s = self.snapshots
        batch, progress = s.version(), s.progress()
        if not s.exists(f"issues/{batch}/_SUCCESS"):
            s.table("issues").write.mode("overwrite").parquet(f"{s.root}/issues/{batch}")
        if not self.publish_to:
            return
        try:
            there = specs.read_issues(self.spark, self.publish_to)
            remote = there[1].first().seq if there else None
            if remote is not None and remote >= progress["seq"]:
                return
            end = progress["end_s"] if progress.get("end_s") is not None else self.now()
            if specs.should_publish(end, self.now(), remote, progress["seq"]):
                specs.write_issues(s.table("issues"), s.table("header"), self.publish_to)
                log.info("published %d issues of batch %d", s.table("issues").count(), batch)
        except Exception:
            log.exception("batch %d isn't published", batch)

    def process(self, batch_changes: DataFrame, batch: int, run_ts=None, seq: int | None = None, end_s: int | None = None) -> bool:
        """One batch, numbered from 1; False if it is done already."""
        s = self.snapshots
        if (s.version() or 0) >= batch:
            self._publish()
            return False
        # small tables that many steps read are made once
        merged = checkpoint(changes.merge(batch_changes).select("etype", "id", "deleted", "version", *PAYLOAD))
        e = self.elements(overlay.upsert(s.table("state"), merged))
        edges = {k: s.table(k) for k in EDGES}
        rel = changes.changed_relations(merged, *(edges[k] for k in EDGES))
        rel = checkpoint(rel.unionByName(merged.where("etype = 'R'").select("id")).distinct())
        way = checkpoint(changes.changed_coastlines(merged, edges["node_way"], s.table("coast")) if "coast" in s.layered() else merged.where("etype = 'W'").select("id"))
        changed, layers = Changed(merged, rel, way), {}
        for a in self.analyzers:
            for name, df in a.incremental(e, s.table, changed).items():
                layers[name] = Layer(df, a.tables[name])
        layers["state"] = Layer(merged, ("etype", "id"), marks=True)
        # edges only grow: those of what changed are added
        relations = e.relations.join(merged.where("etype = 'R'").select("id"), "id", "left_semi")
        own = elements.relation_members(relations).where("type = 'W'").select(F.col("ref").alias("id")).distinct()
        ways = e.ways.join(merged.where("etype = 'W'").select("id"), "id", "left_semi")
        layers |= {k: Layer(df) for k, df in self._edges(relations, e.ways.join(own, "id", "left_semi"), ways).items()}
        self._commit(batch, layers, e, run_ts if run_ts is not None else F.current_timestamp(), seq if seq is not None else batch, end_s)
        drop(merged, rel, way)
        s.drop_before(batch - 1)
        return True

    def catch_up(self, steps: Iterable[tuple[int, int, int]], read: Callable[[int, int, int], DataFrame | None], wait_s: float = 60, tries: int | None = None) -> int:
        """Runs over steps (period, start, end in seconds), as ``replication.plan`` gives them, from where the state is.

        ``read`` gives the changes of a step, or None where there is no file yet, which ends the run. A step
        that fails is tried again after a while, for ever unless ``tries`` says how often. Gives the number of batches."""
        done = 0
        for step in steps:
            progress = self.snapshots.progress() or {}
            if progress.get("end_s") is not None and step[2] <= progress["end_s"]:
                continue
            attempt = 0
            while True:
                try:
                    df = read(*step)
                    if df is None:
                        return done
                    batch = (self.snapshots.version() or 0) + 1
                    self.process(df, batch, seq=batch, end_s=step[2])
                    break
                except Exception:
                    attempt += 1
                    if tries is not None and attempt >= tries:
                        raise
                    log.exception("step %s is tried again", step)
                    time.sleep(wait_s)
            done += 1
        return done

    def stream(self, source: DataFrame, checkpoint: str, **trigger):
        """Runs on a streaming DataFrame of changes; batches number from 1."""
        step = lambda df, k: self.process(df, k + 1)
        return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def replayed_issues(c) -> DataFrame:
    """Coastline nodes without continuation after a file stream of changes, for a demonstration on test tables.

    The changes move ends of coastlines: each modified way gets the next node as its last one."""
    import uuid

    spark = c.spark
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ends = c.view("v_ends").join(c.view("v_ways"), "id").where("natural_tag = 'coastline' and n_nodes >= 2").select("id", "first_node", "last_node")
    snaps = Snapshots(spark, f"{root}/state")
    snaps.commit(0, {"coast": ends})
    moves = ends.where("id % 10 = 0").select(F.col("id"), (F.col("id") % 3).alias("file_seq"), F.lit(1).alias("sec"), F.col("id").alias("pos"), F.lit("W").alias("etype"), F.lit(2).alias("version"), F.col("first_node"), (F.col("last_node") + 1).alias("last_node"))
    moves.repartitionByRange(3, "file_seq").write.parquet(f"{root}/in")

    def step(df: DataFrame, k: int) -> None:
        m = changes.merge(df)
        old = snaps.table("coast")
        new = m.where(~F.col("deleted")).select("id", "first_node", "last_node")
        snaps.commit(k + 1, {"coast": overlay.delete(old, m.select("id")).unionByName(new)})

    q = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in").writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return coastlines.unconnected_nodes(snaps.table("coast")).select(F.col("node_id").alias("osm_id"), "state")


