"""Tag and element predicates as columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ADMIN_LEVELS


@dataclass(frozen=True)
class TagFilter:
    """The key is there and, if values are given, has one of them."""

    key: str
    values: tuple[str, ...] = ()

    def column(self, tags: Column) -> Column:
        has = F.coalesce(F.map_contains_key(tags, self.key), F.lit(False))
        return has & tags[self.key].isin(*self.values) if self.values else has


@dataclass(frozen=True)
class ElementFilter:
    """Elements of one kind by tags and/or ids."""

    kind: str
    tags: tuple[TagFilter, ...] = ()
    ids: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if not self.tags and not self.ids:
            raise ValueError("a filter needs tags or ids")

    def matches(self, tags: Column, ident: Column) -> Column:
        """As a point test: elements without tags never match, a listed id does, else all tag filters must
        (which a filter of ids alone does for any element with tags)."""
        tagged = tags.isNotNull() & (F.size(tags) > 0)
        by_id = ident.isin(*self.ids) if self.ids else F.lit(False)
        return tagged & (by_id | reduce(and_, (t.column(tags) for t in self.tags), F.lit(True)))

    def scan(self, tags: Column) -> Column:
        """As a scan test: nodes and ways pass on any tag filter, relations need all."""
        return reduce(and_ if self.kind == "R" else or_, (t.column(tags) for t in self.tags))


#: Elements that the analyzers ask for.
ADMINS = ElementFilter("R", (TagFilter("boundary", ("administrative",)), TagFilter("type", ("boundary",)), TagFilter("admin_level", ADMIN_LEVELS)))
COASTLINE = ElementFilter("W", (TagFilter("natural", ("coastline",)),))
NAMED = TagFilter("name")


def merged_tags(filters: list[ElementFilter]) -> dict[str, dict[str, tuple[str, ...]]]:
    """By kind and key, the values that filters ask for, united; a filter on the key alone adds none."""
    out: dict[str, dict[str, tuple[str, ...]]] = {}
    for f in filters:
        for t in f.tags:
            own = out.setdefault(f.kind, {})
            own[t.key] = tuple(dict.fromkeys([*own.get(t.key, ()), *t.values]))
    return out


def select(elements: DataFrame, filters: list[ElementFilter]) -> DataFrame:
    """Rows (etype, id, tags, ...) by filters: tag branches first, then id branches; a row that passes two is there twice."""
    parts = [elements.where((F.col("etype") == f.kind) & f.scan(F.col("tags"))) for f in filters if f.tags]
    parts += [elements.where((F.col("etype") == f.kind) & F.col("id").isin(*f.ids)) for f in filters if f.ids]
    return reduce(DataFrame.unionByName, parts)


def by_ids(elements: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is asked for; Spark prunes row groups where files are sorted by id."""
    return elements.join(ids.select("id").distinct(), "id", "left_semi")
