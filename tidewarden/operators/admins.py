"""Administrative areas: role rules, polygons, centres, expected against actual state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters, scalars
from . import elements, geometry, spatial

def role_reason(members: DataFrame) -> DataFrame:
    """(rel_id, reason) by the first three rules on members (rel_id, pos, type, ref, role); sound ones have a null reason."""
    way = (F.col("type") == "W") & F.col("role").isin("outer", "inner", "")
    g = members.groupBy("rel_id").agg(
        F.bool_or(way).alias("ways"), F.bool_or(F.col("role") == "").alias("blank"), F.bool_or(way & (F.col("role") == "outer")).alias("outer")
    )
    return g.select("rel_id", F.when(~F.col("ways"), "Missing ways").when(F.col("blank"), "Member without role").when(~F.col("outer"), "No outer ways found").alias("reason"))


def polygons(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, reason, rings): assembled areas; rings are [polygon number, hole?, points] of sound ones.

    The rules on roles are columns; coordinates are fetched for the relations that pass them, whose ways go
    to Python as arrays, one relation's together."""
    m = elements.relation_members(relations)
    none = relations.where(F.size("members") <= 0).select(F.col("id").alias("rel_id"), F.lit("Missing ways").alias("reason"))
    roles = role_reason(m).unionByName(none)
    used = m.where((F.col("type") == "W") & F.col("role").isin("outer", "inner")).join(roles.where("reason is null").select("rel_id"), "rel_id", "left_semi")
    coords = elements.way_coordinates(ways.join(used.select(F.col("ref").alias("id")).distinct(), "id", "left_semi"), nodes)
    grid = lambda axis: F.transform("coords", lambda p: F.rint(p[axis] * geometry.SCALE).cast("long"))
    coords = coords.select(F.col("id").alias("ref"), grid("x").alias("x"), grid("y").alias("y"), "missing", F.lit(True).alias("known"))
    parts = F.struct("pos", "role", "ref", "x", "y", "missing", F.coalesce("known", F.lit(False)).alias("known"))
    g = used.join(coords, "ref", "left").groupBy("rel_id").agg(F.sort_array(F.collect_list(parts)).alias("m"))

    def build(batches):
        for pdf in batches:
            rows = []
            for rel, members in zip(pdf.rel_id, pdf.m, strict=True):
                gap = next((f"Missing way {x['ref']}" for x in members if not x["known"]), None) or next((f"Missing node {int(x['missing'])}" for x in members if not pd.isna(x["missing"])), None)
                reason, polys = (gap, []) if gap else geometry.build_polygon([("W", x["role"], list(zip(x["x"].tolist(), x["y"].tolist(), strict=True))) for x in members])
                rings = [{"polygon": k, "hole": h > 0, "points": [{"x": p[0], "y": p[1]} for p in r]} for k, (s, holes) in enumerate(polys) for h, r in enumerate((s, *holes))]
                rows.append((rel, reason, rings if reason is None else None))
            yield pd.DataFrame(rows, columns=["id", "reason", "rings"])

    schema = "id long, reason string, rings array<struct<polygon:int,hole:boolean,points:array<struct<x:long,y:long>>>>"
    rest = roles.where("reason is not null").select(F.col("rel_id").alias("id"), "reason", F.lit(None).cast("array<struct<polygon:int,hole:boolean,points:array<struct<x:long,y:long>>>>").alias("rings"))
    return g.mapInPandas(build, schema).unionByName(rest)


def centre_reason(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel_id, reason) by the rules on the member with role admin_centre. Texts are fixed values."""
    c = members.where("role = 'admin_centre'").groupBy("rel_id").agg(F.count("*").alias("n"), F.min(F.struct("pos", "type", "ref")).alias("m"))
    places = nodes.select(F.col("id").alias("ref"), F.coalesce(F.map_contains_key("tags", "place"), F.lit(False)).alias("place"))
    j = members.select("rel_id").distinct().join(c, "rel_id", "left").withColumn("ref", F.col("m.ref")).join(places, "ref", "left")
    reason = (
        F.when(F.col("n").isNull(), "Missing admin_centre role")
        .when(F.col("n") > 1, "Too many admin_centre role roles")
        .when(F.col("m.type") != "N", "admin_centre member is not Node")
        .when(~F.coalesce("place", F.lit(False)), F.concat(F.lit("admin_centre node("), F.col("ref").cast("string"), F.lit(") does not have 'place' tag.")))
    )
    return j.select("rel_id", reason.alias("reason"))


def centre_scope(expected: DataFrame) -> DataFrame:
    """Ids whose centre is checked: countries, and the areas of each country's first level in order of its text."""
    first = expected.where("level is not null").groupBy("country_id").agg(F.min(F.col("level").cast("string")).alias("l"))
    low = expected.join(first, "country_id").where(F.col("level").cast("string") == F.col("l")).select(F.col("admin_id").alias("id"))
    return low.unionByName(expected.select(F.col("country_id").alias("id"))).distinct()


def _issue(name: Column, kind: Column | str, ident: str, details: Column) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [name.alias("friendly_name"), kind.alias("issue_type"), F.lit("R").alias("osm_type"), F.col(ident).alias("osm_id"), details.alias("details")]


def broken_issues(admins: DataFrame) -> DataFrame:
    """Issues of areas (id, friendly_name, admin_level, reason, sound): bad centres, then areas without a polygon."""
    null = F.lit(None).cast("string")
    centre = admins.where(F.col("reason").contains("admin_centre")).select(*_issue(F.col("friendly_name"), "AdminCentre", "id", F.col("reason")))
    broken = admins.where(~F.col("sound"))
    ways = F.col("reason") == "Missing ways"
    rest = broken.select(
        *_issue(
            F.when(ways, F.concat("friendly_name", F.lit("("), F.col("admin_level").cast("string"), F.lit(")"))).otherwise(F.col("friendly_name")),
            F.when(ways, "MissingWays").otherwise(scalars.issue_type_of_level(F.col("admin_level"))),
            "id",
            F.when(ways, null).otherwise(F.col("reason")),
        )
    )
    return centre.unionByName(rest)


def state_issues(expected: DataFrame, actual: DataFrame, valid: DataFrame) -> DataFrame:
    """Missing countries, lost and gained areas.

    ``expected`` is (country_id, name, level, admin_id), ``actual`` (country_id,
    level, admin_id), ``valid`` the ids of countries that have an area."""
    null = F.lit(None).cast("string")
    countries = expected.select("country_id", "name").distinct()
    missing = countries.join(valid.select(F.col("id").alias("country_id")), "country_id", "left_anti")
    a = missing.select(*_issue(F.concat(F.lit("Missing "), "name"), "AdminsState", "country_id", null))
    live = expected.join(valid.select(F.col("id").alias("country_id")), "country_id", "left_semi").where("level is not null")
    keys = ["country_id", "level", "admin_id"]
    title = lambda what: F.concat("name", F.lit("("), F.col("level").cast("string"), F.lit(f") {what} "), F.col("admin_id").cast("string"))
    lost = live.join(actual.select(*keys).distinct(), keys, "left_anti").select("name", *keys).distinct()
    # only levels that the expected state lists are compared
    levels = live.select("country_id", "name", "level").distinct()
    gained = actual.select(*keys).distinct().join(levels, ["country_id", "level"]).join(live.select(*keys), keys, "left_anti")
    b = lost.select(*_issue(title("lost"), "AdminsState", "admin_id", null))
    c = gained.select(*_issue(title("gained"), "AdminsState", "admin_id", null))
    return a.unionByName(b).unionByName(c)


def recompute_scope(changed: DataFrame, countries: DataFrame, expected_levels: DataFrame, members: DataFrame, touched: DataFrame) -> DataFrame:
    """(country_id, level) to evaluate again: old membership of changed areas, all levels of changed countries, new geometric membership.

    ``members`` is the actual state, ``touched`` (country_id, level) by geometry of changed areas that are no countries."""
    ids = changed.select("id").distinct()
    old = members.join(ids.withColumnRenamed("id", "admin_id"), "admin_id", "left_semi").select("country_id", "level")
    whole = expected_levels.join(ids.join(countries.select("id"), "id", "left_semi").withColumnRenamed("id", "country_id"), "country_id", "left_semi").select("country_id", "level")
    return old.unionByName(whole).unionByName(touched.select("country_id", "level")).distinct()


def within_countries(countries: DataFrame, admins: DataFrame, cell: float = 2.0, scope: DataFrame | None = None) -> DataFrame:
    """(country_id, level, admin_id) of areas that a country contains or overlaps; both have id, rings and a box, areas admin_level.

    ``scope`` (country_id, level) are those that are asked for, else all."""
    box = ["id", "minx", "miny", "maxx", "maxy"]
    pairs = spatial.box_join(countries.select(*box), admins.select(*box, "admin_level"), cell)
    j = pairs.select(F.col("l_id").alias("country_id"), F.col("r_id").alias("admin_id"), F.col("r_admin_level").alias("level"))
    if scope is not None:
        j = j.join(scope, ["country_id", "level"], "left_semi")
    j = j.join(countries.select(F.col("id").alias("country_id"), F.col("rings").alias("a")), "country_id").join(admins.select(F.col("id").alias("admin_id"), F.col("rings").alias("b")), "admin_id")

    def polys(rings):
        out: dict[int, tuple[list, list]] = {}
        for r in rings:
            pts = [(p["x"], p["y"]) for p in r["points"]]
            shell, holes = out.setdefault(r["polygon"], ([], []))
            (holes.append if r["hole"] else shell.extend)(pts)
        return list(out.values())

    def test(batches):
        for pdf in batches:
            ok = [geometry.area_relation(polys(a), polys(b)) in ("equals", "contains", "overlaps") for a, b in zip(pdf.a, pdf.b, strict=True)]
            yield pdf.loc[ok, ["country_id", "level", "admin_id"]]

    return j.mapInPandas(test, "country_id long, level int, admin_id long")


def boxed(areas: DataFrame) -> DataFrame:
    """Areas with a box in degrees from their rings."""
    pts = F.flatten(F.transform("rings", lambda r: r.points))
    x, y = F.transform(pts, lambda p: p.x / geometry.SCALE), F.transform(pts, lambda p: p.y / geometry.SCALE)
    return areas.withColumns({"minx": F.array_min(x), "miny": F.array_min(y), "maxx": F.array_max(x), "maxy": F.array_max(y)})


class Admins:
    """The analyzer over a context with nodes, ways, relations and expected."""

    name = "AdminCountPerCountry"

    def full(self, ctx) -> DataFrame:
        """(id, friendly_name, admin_level, reason, rings, sound)."""
        r = ctx.relations.where(filters.ADMINS.scan(F.col("tags")))
        return self._evaluate(ctx, r)

    def _evaluate(self, ctx, relations: DataFrame) -> DataFrame:
        built = polygons(relations, ctx.ways, ctx.nodes)
        scope = centre_scope(ctx.expected).join(relations.select("id"), "id", "left_semi")
        m = elements.relation_members(relations.join(scope, "id", "left_semi"))
        none = scope.join(relations.where(F.size("members") <= 0).select("id"), "id", "left_semi").select(F.col("id").alias("rel_id"), F.lit("Missing admin_centre role").alias("reason"))
        centre = centre_reason(m, ctx.nodes).unionByName(none).select(F.col("rel_id").alias("id"), F.col("reason").alias("centre"))
        head = relations.select("id", scalars.friendly_name(F.col("tags")).alias("friendly_name"), F.col("tags")["admin_level"].cast("int").alias("admin_level"))
        return head.join(built, "id").join(centre, "id", "left").select("id", "friendly_name", "admin_level", F.coalesce("reason", "centre").alias("reason"), "rings", F.col("rings").isNotNull().alias("sound"))

    def issues(self, ctx, state: DataFrame) -> DataFrame:
        sound = boxed(state.where("sound"))
        valid = sound.select("id")
        countries = sound.join(ctx.expected.select(F.col("country_id").alias("id")).distinct(), "id", "left_semi")
        wanted = ctx.expected.where("level is not null").select(F.col("country_id"), "level").distinct()
        actual = within_countries(countries, sound).join(wanted, ["country_id", "level"], "left_semi")
        return broken_issues(state).unionByName(state_issues(ctx.expected, actual, valid))

    def rebuilt(self, ctx, ids: DataFrame) -> DataFrame:
        """The areas of the ids, built anew, as far as they still match."""
        return self._evaluate(ctx, ctx.relations.join(ids, "id", "left_semi").where(filters.ADMINS.scan(F.col("tags"))))
