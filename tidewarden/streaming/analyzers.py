"""Analyzers as the engine runs them: state tables by key, deltas of a batch, issues."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from ..operators import admins, coastlines, elements, features

State = Callable[[str], DataFrame]


@dataclass
class Changed:
    """A batch: the merged changes, the relations and coastline ways that they affect."""

    merged: DataFrame
    relations: DataFrame
    ways: DataFrame

    def elements(self) -> DataFrame:
        """(etype, id, deleted, tags) of what changed itself."""
        return self.merged.select("etype", "id", "deleted", "tags")


class Analyzer(Protocol):
    """``tables`` are the state's names and keys. ``full`` makes them from all elements, ``incremental``
    the rows of them that a batch changes (with ``deleted``), ``issues`` reads them."""

    name: str
    filters: tuple[filters.ElementFilter, ...]
    tables: dict[str, tuple[str, ...]]

    def full(self, ctx) -> dict[str, DataFrame]: ...

    def incremental(self, ctx, state: State, changed: Changed) -> dict[str, DataFrame]: ...

    def issues(self, ctx, state: State) -> DataFrame: ...


def _gone(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new``, and those of ``old`` that it doesn't have, as deleted."""
    return new.withColumn("deleted", F.lit(False)).unionByName(old.join(new.select(key), key, "left_anti").withColumn("deleted", F.lit(True)))


@dataclass
class Coastlines:
    work: coastlines.Coastlines = field(default_factory=coastlines.Coastlines)
    name: str = "BrokenCoastline"
    filters: tuple = (filters.COASTLINE,)
    tables: dict = field(default_factory=lambda: {"coast": ("id",)})

    def full(self, ctx) -> dict[str, DataFrame]:
        return {"coast": self.work.full(ctx)}

    def incremental(self, ctx, state: State, changed: Changed) -> dict[str, DataFrame]:
        return {"coast": self.work.delta(ctx, state("coast"), changed.ways)}

    def issues(self, ctx, state: State) -> DataFrame:
        return self.work.issues(state("coast"))


@dataclass
class Admins:
    """Areas, and which of them lie in which country, by country and level."""

    work: admins.Admins = field(default_factory=admins.Admins)
    name: str = "AdminCountPerCountry"
    filters: tuple = (filters.ADMINS,)
    tables: dict = field(default_factory=lambda: {"areas": ("id",), "inside": ("country_id", "level")})

    def full(self, ctx) -> dict[str, DataFrame]:
        areas = self.work.full(ctx)
        return {"areas": areas, "inside": self._inside(ctx, areas, self._wanted(ctx))}

    def _wanted(self, ctx) -> DataFrame:
        return ctx.expected.where("level is not null").select("country_id", "level").distinct()

    def _inside(self, ctx, areas: DataFrame, scope: DataFrame) -> DataFrame:
        """(country_id, level, ids) of the scope; a country without a sound area has none."""
        sound = admins.boxed(areas.where("sound"))
        countries = sound.join(scope.select(F.col("country_id").alias("id")).distinct(), "id", "left_semi")
        found = admins.within_countries(countries, sound, scope=scope).groupBy("country_id", "level").agg(F.sort_array(F.collect_list("admin_id")).alias("ids"))
        return scope.join(found, ["country_id", "level"], "left").select("country_id", "level", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))

    def incremental(self, ctx, state: State, changed: Changed) -> dict[str, DataFrame]:
        ids = changed.relations.select("id").distinct()
        old = state("areas").join(ids, "id", "left_semi")
        new = self.work.rebuilt(ctx, ids)
        areas = state("areas").join(ids, "id", "left_anti").unionByName(new)
        # what changed areas were members of, what they touch now, and all of a changed country
        sound = admins.boxed(areas.where("sound"))
        wanted = self._wanted(ctx)
        countries = sound.join(wanted.select(F.col("country_id").alias("id")).distinct(), "id", "left_semi")
        touched = admins.within_countries(countries, admins.boxed(new.where("sound"))).select("country_id", "level").distinct()
        members = state("inside").select("country_id", "level", F.explode("ids").alias("admin_id"))
        scope = admins.recompute_scope(ids, wanted.select(F.col("country_id").alias("id")).distinct(), wanted, members, touched)
        scope = scope.join(wanted, ["country_id", "level"], "left_semi")
        return {"areas": _gone(old, new, "id"), "inside": self._inside(ctx, areas, scope).withColumn("deleted", F.lit(False))}

    def issues(self, ctx, state: State) -> DataFrame:
        areas = state("areas")
        actual = state("inside").select("country_id", "level", F.explode("ids").alias("admin_id"))
        return admins.broken_issues(areas).unionByName(admins.state_issues(ctx.expected, actual, areas.where("sound").select("id")))


class _ByElement:
    """Issues of single elements, kept by element; those of a changed one are replaced, maybe by none."""

    table: str

    def found(self, ctx, elements_: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _kept(self, found: DataFrame) -> DataFrame:
        one = F.struct("friendly_name", "issue_type", "details")
        return found.groupBy("osm_type", "osm_id").agg(F.sort_array(F.collect_list(one)).alias("found"))

    def full(self, ctx) -> dict[str, DataFrame]:
        return {self.table: self._kept(self.found(ctx, ctx.tagged()))}

    def incremental(self, ctx, state: State, changed: Changed) -> dict[str, DataFrame]:
        own = changed.elements()
        new = self._kept(self.found(ctx, own))
        keys = own.select(F.col("etype").alias("osm_type"), F.col("id").alias("osm_id")).distinct()
        old = state(self.table).join(keys, ["osm_type", "osm_id"], "left_semi").join(new.select("osm_type", "osm_id"), ["osm_type", "osm_id"], "left_anti")
        return {self.table: new.withColumn("deleted", F.lit(False)).unionByName(old.withColumn("deleted", F.lit(True)))}

    def issues(self, ctx, state: State) -> DataFrame:
        return state(self.table).select("osm_type", "osm_id", F.explode("found").alias("f")).select("f.friendly_name", "f.issue_type", "osm_type", "osm_id", "f.details")


class Names(_ByElement):
    name, table = "Names", "names"
    filters = tuple(filters.ElementFilter(k, (filters.NAMED,)) for k in ("N", "W", "R"))
    tables = {"names": ("osm_type", "osm_id")}

    def found(self, ctx, elements_: DataFrame) -> DataFrame:
        return features.name_issues(elements_.where(~F.col("deleted")))


class Features(_ByElement):
    """Expected features against actual tags; ``expected`` as ``specs.read_features`` reads them, each element once."""

    name, table, filters = features.ISSUE, "features", ()
    tables = {"features": ("osm_type", "osm_id")}

    def __init__(self, expected: DataFrame):
        self.expected = features.unique(expected)

    def found(self, ctx, elements_: DataFrame) -> DataFrame:
        return features.tag_issues(self.expected, elements_)


__all__ = ["Admins", "Analyzer", "Changed", "Coastlines", "Features", "Names", "elements"]
