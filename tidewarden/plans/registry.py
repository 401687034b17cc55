"""Queries of the map engine over the test tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, scalars
from ..operators import admins, changes, coastlines, elements, features, issues, overlay, spatial
from ..sources.tables import Context, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Context], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Context(spark, folder))
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


_EVENTS = """select first_node as node_id, id, case when first_node = last_node then 0 else 1 end as ev from {v_ends} join {v_ways} using (id) where natural_tag = 'coastline' and n_nodes >= 2
 union all select last_node, id, -1 from {v_ends} join {v_ways} using (id) where natural_tag = 'coastline' and n_nodes >= 2 and first_node <> last_node"""


@query(f"""select 'BrokenCoastLine' as issue_type, 'N' as osm_type, node_id as osm_id, 'Unconnected node in the coastline' as details from (
  select node_id, list_reduce(list(ev order by id), lambda s, e: case when e = 0 then 0 else greatest(least(s + e, 1), -1) end, 0) as state from ({_EVENTS}) group by node_id) where state <> 0""")
def coastline_unconnected_nodes(c: Context) -> DataFrame:
    ends = c.view("v_ends").join(c.view("v_ways"), "id").where("natural_tag = 'coastline' and n_nodes >= 2")
    n = coastlines.unconnected_nodes(ends)
    return n.select(F.lit(coastlines.ISSUE).alias("issue_type"), F.lit("N").alias("osm_type"), F.col("node_id").alias("osm_id"), F.lit(coastlines.UNCONNECTED).alias("details"))


@query("select id, admin_level, name from {v_relations} where boundary = 'administrative' and type = 'boundary' and admin_level between 2 and 9")
def filter_admin_relations(c: Context) -> DataFrame:
    return c.relations.where(filters.ADMINS.scan(F.col("tags"))).select("id", F.col("tags")["admin_level"].cast("int").alias("admin_level"), F.col("tags")["name"].alias("name"))


_ANY = filters.ElementFilter("N", (filters.TagFilter("place", ("economy", "large")), filters.TagFilter("name", ("*",))))
_ALL = filters.ElementFilter("R", (filters.TagFilter("boundary", ("administrative",)), filters.TagFilter("admin_level", ("4", "6"))))


@query("select id, place, name from {v_nodes} where place in ('economy', 'large') or name = '*'")
def filter_tag_any(c: Context) -> DataFrame:
    return c.nodes.where(_ANY.scan(F.col("tags"))).select("id", F.col("tags")["place"].alias("place"), F.col("tags")["name"].alias("name"))


@query("select id, admin_level from {v_relations} where boundary = 'administrative' and admin_level in (4, 6)")
def filter_tag_all(c: Context) -> DataFrame:
    return c.relations.where(_ALL.scan(F.col("tags"))).select("id", F.col("tags")["admin_level"].cast("int").alias("admin_level"))


@query("""select 'R' as etype, id, 'tags' as branch from {v_relations} where boundary = 'administrative' and admin_level in (4, 6)
 union all select 'N', id, 'tags' from {v_nodes} where place in ('economy', 'large') or name = '*' union all select 'N', id, 'ids' from {v_nodes} where id in (1, 2, 97, 1000000)""")
def filter_branches(c: Context) -> DataFrame:
    e = c.nodes.select(F.lit("N").alias("etype"), "id", "tags").unionByName(c.relations.select(F.lit("R").alias("etype"), "id", "tags"))
    tag = filters.select(e, [_ANY, _ALL]).select("etype", "id", F.lit("tags").alias("branch"))
    return tag.unionByName(filters.select(e, [filters.ElementFilter("N", ids=(1, 2, 97, 1000000))]).select("etype", "id", F.lit("ids").alias("branch")))


@query("select id, place is not null or name is not null as tagged, (place is not null or name is not null) and (id in (3, 5) or coalesce(place = 'economy', false)) as hit from {v_nodes}")
def filter_point_match(c: Context) -> DataFrame:
    f = filters.ElementFilter("N", (filters.TagFilter("place", ("economy",)),), (3, 5))
    return c.nodes.select("id", (F.size("tags") > 0).alias("tagged"), f.matches(F.col("tags"), F.col("id")).alias("hit"))


@query("select n.id, n.lat, n.lon from {v_nodes} n where exists (select 1 from {v_centres} m where m.type = 'N' and m.ref = n.id)")
def filter_by_ids(c: Context) -> DataFrame:
    return filters.by_ids(c.nodes, c.view("v_centres").where("type = 'N'").select(F.col("ref").alias("id"))).select("id", "lat", "lon")


@query("select 'Names' as issue_type, 'N' as osm_type, id as osm_id from {v_nodes} where name = '*'")
def names_invalid(c: Context) -> DataFrame:
    return features.name_issues(c.nodes.withColumn("etype", F.lit("N"))).select("issue_type", "osm_type", "osm_id")


@query("select way_id, pos, node_id from {v_way_nodes}")
def explode_way_nodes(c: Context) -> DataFrame:
    return elements.way_nodes(c.ways)


@query("select rel_id, cast(row_number() over (partition by rel_id order by pos) - 1 as int) as pos, type, ref, role from (select * from {v_members} union all select * from {v_centres}) where rel_id in (select id from {v_relations})")
def explode_relation_members(c: Context) -> DataFrame:
    return elements.relation_members(c.relations)


@query("select id, first_node, last_node, first_node = last_node as closed from {v_ends} where n_nodes >= 2 and id in (select id from {v_ways})")
def way_endpoints(c: Context) -> DataFrame:
    return elements.endpoints(c.ways).withColumn("closed", F.col("first_node") == F.col("last_node"))


def _tiers(c: Context) -> list[DataFrame]:
    """Batch, state and base of nodes."""
    base = c.view("v_nodes").select(F.lit("N").alias("etype"), "id", "name", F.lit(False).alias("deleted"))
    state = c.view("v_nodes").where("id % 5 = 0").select(F.lit("N").alias("etype"), "id", F.concat("name", F.lit(" state")).alias("name"), (F.col("id") % 15 == 0).alias("deleted"))
    batch = c.view("v_nodes").where("id % 7 = 0").select(F.lit("N").alias("etype"), "id", F.concat("name", F.lit(" batch")).alias("name"), (F.col("id") % 21 == 0).alias("deleted"))
    return [batch, state, base]


_TIERED = """select id, case when id % 7 = 0 then name || ' batch' when id % 5 = 0 then name || ' state' else name end as name,
 case when id % 7 = 0 then id % 21 = 0 when id % 5 = 0 then id % 15 = 0 else false end as deleted from {v_nodes}"""


@query(f"select id, name from ({_TIERED}) where not deleted")
def overlay_batch_state(c: Context) -> DataFrame:
    return overlay.overlay(*_tiers(c)).select("id", "name")


@query(f"select a.id, case when t.id is null then 'absent' when t.deleted then 'deleted' else 'value' end as found, t.name from (select distinct event_id % 3000 as id from {{events}}) a left join ({_TIERED}) t on a.id = t.id")
def overlay_point_lookup(c: Context) -> DataFrame:
    ids = c.view("events").select(F.lit("N").alias("etype"), (F.col("event_id") % 3000).alias("id"))
    return overlay.lookup(ids, *_tiers(c)).select("id", "found", "name")


@query()
def overlay_lookup_all(c: Context) -> DataFrame:
    """As overlay_point_lookup, for the ids of all events and users."""
    ids = c.view("events").select(F.explode(F.array(F.col("event_id").cast("long"), F.col("user_id").cast("long"))).alias("id")).where("id is not null")
    return overlay.lookup(ids.select(F.lit("N").alias("etype"), "id"), *_tiers(c)).select("id", "found", "name")


@query("select id, name, deleted from (select id, name || ' state' as name, id % 15 = 0 as deleted from {v_nodes} where id % 5 = 0 and id % 7 <> 0 union all select id, name || ' batch', id % 21 = 0 from {v_nodes} where id % 7 = 0)")
def state_upsert(c: Context) -> DataFrame:
    batch, state, _ = _tiers(c)
    return overlay.upsert(state, batch).select("id", "name", "deleted")


_MERGED = """select etype, id, w.sec = 2 as deleted, cast(w.version as int) as kept_version, w.pos as pos from (
 select etype, id, list_reduce(list(<<'sec': sec, 'version': version, 'pos': pos>> order by file_seq, sec, pos),
  lambda a, x: case when x.sec > 0 and a.version > x.version then a when x.sec = 2 then <<'sec': 2, 'version': 0, 'pos': x.pos>> else x end, <<'sec': 1, 'version': 0, 'pos': cast(-1 as bigint)>>) as w
 from {v_changes} group by etype, id) where w.pos >= 0"""


def _merged_sql(text: str) -> str:
    return with_views(text).replace("<<", "{").replace(">>", "}")


@query()
def merge_changes(c: Context) -> DataFrame:
    m = changes.merge(c.view("v_changes"))
    return m.where(~F.col("deleted")).select("etype", "id", "kept_version", "pos", "value")


ORACLE["merge_changes"] = _merged_sql(f"select m.etype, m.id, m.kept_version, m.pos, v.value from ({_MERGED}) m join {{v_changes}} v on v.pos = m.pos where not m.deleted")


@query()
def merge_changes_tombstones(c: Context) -> DataFrame:
    return changes.merge(c.view("v_changes")).where("deleted").select("etype", "id", "pos")


ORACLE["merge_changes_tombstones"] = _merged_sql(f"select etype, id, pos from ({_MERGED}) where deleted")

_MOD = f"""select m.etype, m.id from ({_MERGED}) m join {{v_changes}} v on v.pos = m.pos where not m.deleted and v.version >= 2"""
_CHANGED_WAYS = f"""select distinct id from (select n.way_id as id from {{v_way_nodes}} n join ({_MOD}) x on x.etype = 'N' and x.id = n.node_id union all select id from ({_MOD}) where etype = 'W')"""


@query()
def changed_ways(c: Context) -> DataFrame:
    return changes.changed_ways(changes.merge(c.view("v_changes")), c.view("v_way_nodes").select("node_id", "way_id").distinct())


ORACLE["changed_ways"] = _merged_sql(_CHANGED_WAYS)


def _edges(c: Context) -> dict[str, DataFrame]:
    return changes.tracker_edges(c.members, c.way_nodes)


@query("""select 'node_way' as edge, node_id as a, way_id as b from (select distinct node_id, way_id from {v_way_nodes} where way_id in (select ref from {v_members} union all select ref from {v_centres} where type = 'W') and way_id in (select id from {v_ways}))
 union all select distinct 'way_relation', ref, rel_id from (select ref, rel_id, type from {v_members} union all select ref, rel_id, type from {v_centres}) where type = 'W' and rel_id in (select id from {v_relations})
 union all select distinct 'node_relation', ref, rel_id from {v_centres} where type = 'N' and rel_id in (select id from {v_relations})""")
def tracker_edges(c: Context) -> DataFrame:
    e = _edges(c)
    parts = [e["node_way"].select(F.lit("node_way").alias("edge"), F.col("node_id").alias("a"), F.col("way_id").alias("b")), e["way_relation"].select(F.lit("way_relation").alias("edge"), F.col("way_id").alias("a"), F.col("rel_id").alias("b")), e["node_relation"].select(F.lit("node_relation").alias("edge"), F.col("node_id").alias("a"), F.col("rel_id").alias("b"))]
    return reduce(DataFrame.unionByName, parts)


@query()
def changed_relations(c: Context) -> DataFrame:
    e = _edges(c)
    return changes.changed_relations(changes.merge(c.view("v_changes")), e["node_way"], e["way_relation"], e["node_relation"], e["tracked"])


_MEMBERS = "(select rel_id, type, ref, role, pos from {v_members} union all select rel_id, type, ref, role, pos from {v_centres})"
ORACLE["changed_relations"] = _merged_sql(f"""select distinct id from (
 select m.rel_id as id from {_MEMBERS} m join (select distinct id from (select n.way_id as id from {{v_way_nodes}} n join ({_MOD}) x on x.etype = 'N' and x.id = n.node_id where n.way_id in (select id from {{v_ways}}) union all select id from ({_MOD}) where etype = 'W')) w on m.type = 'W' and m.ref = w.id
 union all select m.rel_id from {_MEMBERS} m join ({_MOD}) x on m.type = 'N' and x.etype = 'N' and m.ref = x.id
 union all select id from ({_MERGED}) where etype = 'R') where id in (select id from {{v_relations}}) and id in (select rel_id from {_MEMBERS})""")


@query()
def changed_coastlines(c: Context) -> DataFrame:
    coast = c.view("v_ways").where("natural_tag = 'coastline'")
    return changes.changed_coastlines(changes.merge(c.view("v_changes")), c.view("v_way_nodes").select("node_id", "way_id").distinct(), coast)


ORACLE["changed_coastlines"] = _merged_sql(f"""select id, false as direct from ({_CHANGED_WAYS}) where id not in (select id from ({_MERGED}) where etype = 'W') and id in (select id from {{v_ways}} where natural_tag = 'coastline')
 union all select id, true from ({_MERGED}) where etype = 'W'""")


@query("""with recursive r as (select distinct c_custkey as root, c_custkey as node from {customer} where c_custkey % 50 = 0
 union select r.root, e.child from r join {v_subrelations} e on r.node = e.parent) select root, node from r""")
def relation_closure(c: Context) -> DataFrame:
    roots = c.view("customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("id"))
    return elements.closure(c.view("v_subrelations"), roots).select("root", "node")


@query()
def relation_closure_all(c: Context) -> DataFrame:
    """As relation_closure, with all relations as roots."""
    return elements.closure(c.view("v_subrelations"), c.view("customer").select(F.col("c_custkey").alias("id"))).select("root", "node")


_CENTRE = """select r.rel_id, case when k.n is null then 'Missing admin_centre role' when k.n > 1 then 'Too many admin_centre role roles' when k.type <> 'N' then 'admin_centre member is not Node'
 when p.place is null then 'admin_centre node(' || k.ref || ') does not have ''place'' tag.' end as reason from (select distinct rel_id from {v_centres}) r
 left join (select rel_id, count(*) as n, min(type) as type, min(ref) as ref from {v_centres} where role = 'admin_centre' group by rel_id) k on r.rel_id = k.rel_id
 left join {v_nodes} p on p.id = k.ref"""


@query(f"select rel_id, reason from ({_CENTRE}) where reason is not null")
def admin_centre_issues(c: Context) -> DataFrame:
    return admins.centre_reason(c.view("v_centres"), c.nodes).where("reason is not null")


@query("select distinct admin_id as id from {v_expected} e where cast(level as varchar(5)) = (select min(cast(level as varchar(5))) from {v_expected} x where x.country_id = e.country_id) union select country_id from {v_expected}")
def admin_centre_scope(c: Context) -> DataFrame:
    return admins.centre_scope(c.expected)


def _valid(c: Context) -> DataFrame:
    return c.view("nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").cast("bigint").alias("id"))


def _state(c: Context) -> DataFrame:
    return admins.state_issues(c.expected, c.view("v_actual"), _valid(c)).select("friendly_name", "issue_type", "osm_type", "osm_id")


@query("""select name || '(' || level || ') lost ' || admin_id as friendly_name, 'AdminsState' as issue_type, 'R' as osm_type, admin_id as osm_id from (
 select distinct name, country_id, level, admin_id from {v_expected} e where country_id % 5 <> 0 and not exists (select 1 from {v_actual} a where a.country_id = e.country_id and a.level = e.level and a.admin_id = e.admin_id))""")
def admins_lost(c: Context) -> DataFrame:
    return _state(c).where(F.col("friendly_name").contains(" lost "))


@query("""select n.name || '(' || a.level || ') gained ' || a.admin_id as friendly_name, 'AdminsState' as issue_type, 'R' as osm_type, a.admin_id as osm_id from {v_actual} a
 join (select distinct country_id, name, level from {v_expected}) n on n.country_id = a.country_id and n.level = a.level
 where a.country_id % 5 <> 0 and not exists (select 1 from {v_expected} e where a.country_id = e.country_id and a.level = e.level and a.admin_id = e.admin_id)""")
def admins_gained(c: Context) -> DataFrame:
    return _state(c).where(F.col("friendly_name").contains(" gained "))


@query("select distinct 'Missing ' || name as friendly_name, 'AdminsState' as issue_type, 'R' as osm_type, country_id as osm_id from {v_expected} where country_id % 5 = 0")
def country_missing(c: Context) -> DataFrame:
    return _state(c).where(F.col("friendly_name").startswith("Missing "))


@query("""select distinct country_id, level from (select country_id, level from {v_actual} where admin_id in (select distinct user_id from {events} where event_type = 'error')
 union all select country_id, level from {v_expected} where country_id in (select distinct user_id from {events} where event_type = 'error')
 union all select cast(user_id % 25 as bigint), cast(2 + user_id % 8 as int) from {events} where event_type = 'error' and user_id >= 25)""")
def admins_state_scope(c: Context) -> DataFrame:
    changed = c.view("events").where("event_type = 'error'").select(F.col("user_id").alias("id"))
    countries = c.view("nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    touched = changed.where("id >= 25").select((F.col("id") % 25).alias("country_id"), (2 + F.col("id") % 8).cast("int").alias("level"))
    return admins.recompute_scope(changed, countries, c.expected.select("country_id", "level").distinct(), c.view("v_actual"), touched)


_ROLE = """select rel_id, case when max(case when type = 'W' and role in ('outer', 'inner', '') then 1 else 0 end) = 0 then 'Missing ways' when max(case when role = '' then 1 else 0 end) = 1 then 'Member without role'
 when max(case when type = 'W' and role = 'outer' then 1 else 0 end) = 0 then 'No outer ways found' end as reason from (select rel_id, type, role from {v_members} union all select rel_id, type, role from {v_centres}) group by rel_id"""


@query(f"select rel_id, reason from ({_ROLE}) where reason is not null")
def relation_role_checks(c: Context) -> DataFrame:
    return admins.role_reason(c.view("v_members").unionByName(c.view("v_centres"))).where("reason is not null")


@query(f"""select 'AdminCentre' as issue_type, r.name as friendly_name, r.id as osm_id, x.reason as details from {{v_relations}} r join ({_CENTRE}) x on x.rel_id = r.id left join ({_ROLE}) y on y.rel_id = r.id where y.reason is null and x.reason is not null
 union all select case when y.reason = 'Missing ways' then 'MissingWays' when r.admin_level > 6 then 'OpenAdminPolygon' || r.admin_level else 'OpenAdminPolygon' end,
 case when y.reason = 'Missing ways' then r.name || '(' || r.admin_level || ')' else r.name end, r.id, case when y.reason <> 'Missing ways' then y.reason end from {{v_relations}} r join ({_ROLE}) y on y.rel_id = r.id where y.reason is not null""")
def broken_admin_issues(c: Context) -> DataFrame:
    role = admins.role_reason(c.view("v_members").unionByName(c.view("v_centres"))).select(F.col("rel_id").alias("id"), F.col("reason").alias("role"))
    centre = admins.centre_reason(c.view("v_centres"), c.nodes).select(F.col("rel_id").alias("id"), F.col("reason").alias("centre"))
    a = c.view("v_relations").join(role, "id", "left").join(centre, "id", "left").select("id", F.col("name").alias("friendly_name"), "admin_level", F.coalesce("role", "centre").alias("reason"), F.col("role").isNull().alias("sound"))
    return admins.broken_issues(a).select("issue_type", "friendly_name", "osm_id", "details")


_COORDS = "(select w.way_id, w.pos, n.lon as x, n.lat as y, max(w.pos) over (partition by w.way_id) as last_pos, first_value(n.lon) over (partition by w.way_id order by w.pos) as ox, first_value(n.lat) over (partition by w.way_id order by w.pos) as oy from {v_way_nodes} w join {v_nodes} n on n.id = w.node_id where w.way_id in (select id from {v_ways}))"


def _closed(c: Context) -> DataFrame:
    """Ways closed by repeating their first point, as rings to orient."""
    g = elements.way_coordinates(c.ways, c.nodes).where("n_nodes >= 3")
    return g.withColumn("ring", F.concat("coords", F.slice("coords", 1, 1)))


@query(f"""select way_id as id, case when round(a, 4) > 0 then 1 when round(a, 4) < 0 then -1 else 0 end as orientation from (
 select way_id, sum((x - ox) * (ny - oy) - (nx - ox) * (y - oy)) as a from (select *, coalesce(lead(x) over (partition by way_id order by pos), ox) as nx, coalesce(lead(y) over (partition by way_id order by pos), oy) as ny from {_COORDS} where last_pos >= 2) group by way_id)""")
def ring_orientation(c: Context) -> DataFrame:
    a = F.round(elements.signed_area2(F.col("ring")), 4)
    return _closed(c).select("id", F.signum(a).cast("int").alias("orientation"))


@query("select w.id, 'Way has less than 2 nodes.' as reason from {v_ways} w left join {v_ends} e on e.id = w.id where coalesce(e.n_nodes, 0) < 2")
def way_too_short(c: Context) -> DataFrame:
    return c.ways.where(F.size("nodes") < 2).select("id", F.lit("Way has less than 2 nodes.").alias("reason"))


@query(f"select way_id as id, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from {_COORDS} group by way_id")
def way_bbox(c: Context) -> DataFrame:
    return elements.way_coordinates(c.ways, c.nodes).select("id", *elements.bbox(F.col("coords")))


def _small_boxes(c: Context) -> DataFrame:
    """Boxes around nodes, for joins that stay sparse."""
    return c.view("v_nodes").select("id", (F.col("lon") - 2).alias("minx"), (F.col("lat") - 2).alias("miny"), (F.col("lon") + 2).alias("maxx"), (F.col("lat") + 2).alias("maxy"))


@query("select a.id as id, b.id as other from {v_nodes} a join {v_nodes} b on a.id <> b.id and a.lon - 2 <= b.lon + 2 and b.lon - 2 <= a.lon + 2 and a.lat - 2 <= b.lat + 2 and b.lat - 2 <= a.lat + 2")
def bbox_neighbours(c: Context) -> DataFrame:
    b = _small_boxes(c)
    return spatial.box_join(b, b, 4.0).where("l_id <> r_id").select(F.col("l_id").alias("id"), F.col("r_id").alias("other"))


#: Short segments: from each node to a point nearby.
_SEG = "(select id, lon as ax, lat as ay, lon + (id % 13) - 6.25 as bx, lat + (id % 11) - 5.25 as by from {v_nodes})"
_TURN = "sign(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"


def _o(a: str, b: str, p: str) -> str:
    return _TURN.replace("{a}", a).replace("{b}", b).replace("{p}", p)


@query(f"select s.id as id, t.id as other from {_SEG} s join {_SEG} t on s.id <> t.id where {_o('s.a', 's.b', 't.a')} * {_o('s.a', 's.b', 't.b')} < 0 and {_o('t.a', 't.b', 's.a')} * {_o('t.a', 't.b', 's.b')} < 0")
def segment_crossings(c: Context) -> DataFrame:
    s = c.view("v_nodes").select("id", F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")), F.struct((F.col("lon") + (F.col("id") % 13) - 6.25).alias("x"), (F.col("lat") + (F.col("id") % 11) - 5.25).alias("y"))).alias("coords"))
    s = spatial.segments(s)
    return spatial.proper_crossings(s, s, 8.0).select(F.col("l_id").alias("id"), F.col("r_id").alias("other"))


@query("""select n.id as country_id, r.id as admin_id, r.admin_level as level from (select n_nationkey as id, cast(n_nationkey % 5 as double) * 60 - 150 as x, cast(n_nationkey % 7 as double) * 20 - 70 as y from {nation}) n
 join (select r.id, r.admin_level, p.lon as x, p.lat as y from {v_relations} r join {v_nodes} p on p.id = r.id) r on n.x - 20 <= r.x + 1 and r.x - 1 <= n.x + 20 and n.y - 10 <= r.y + 1 and r.y - 1 <= n.y + 10""")
def country_admin_bbox_join(c: Context) -> DataFrame:
    x, y = (F.col("n_nationkey") % 5).cast("double") * 60 - 150, (F.col("n_nationkey") % 7).cast("double") * 20 - 70
    n = c.view("nation").select(F.col("n_nationkey").alias("id"), (x - 20).alias("minx"), (y - 10).alias("miny"), (x + 20).alias("maxx"), (y + 10).alias("maxy"))
    r = c.view("v_relations").join(c.view("v_nodes").select("id", "lat", "lon"), "id").select("id", "admin_level", (F.col("lon") - 1).alias("minx"), (F.col("lat") - 1).alias("miny"), (F.col("lon") + 1).alias("maxx"), (F.col("lat") + 1).alias("maxy"))
    return spatial.box_join(n, r, 10.0).select(F.col("l_id").alias("country_id"), F.col("r_id").alias("admin_id"), F.col("r_admin_level").alias("level"))


def _area(a: str, b: str, p: str) -> str:
    """Twice the area of a triangle of points, named by the start of their columns x and y: its sign is the turn."""
    return f"(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"


def _meets_at(p: str) -> str:
    """Whether two segments that meet in one point do so in a given one."""
    return f"(case when spot is not null then spot = {p}x * 10000 + {p}y else {_area('a', 'e', p)} = 0 and {_area('c', 'd', p)} = 0 end)"


def _beside(a: str, b: str, p: str) -> str:
    return f"{p}x between least({a}x, {b}x) and greatest({a}x, {b}x) and {p}y between least({a}y, {b}y) and greatest({a}y, {b}y)"


#: Segments of coastlines on a grid of tenths of a degree, their line's ends (none if closed), and where segments of two lines meet.
_FAR = """pts as (select w.way_id as id, w.pos, cast((n.id * 104729) % 3500 as bigint) as x, cast((n.id * 7919) % 1700 as bigint) as y
  from {v_way_nodes} w join {v_ways} v on v.id = w.way_id join {v_nodes} n on n.id = w.node_id where v.natural_tag = 'coastline'),"""
#: The same ways with their nodes around the first one, so that few cross.
_NEAR = """pts as (select w.way_id as id, w.pos, cast((e.first_node * 104729 + w.way_id * 31) % 3500 + (w.node_id * 7919) % 41 - 20 as bigint) as x, cast((e.first_node * 7919 + w.way_id * 17) % 1700 + (w.node_id * 104729) % 31 - 15 as bigint) as y
  from {v_way_nodes} w join {v_ways} v on v.id = w.way_id join {v_ends} e on e.id = w.way_id where v.natural_tag = 'coastline'),"""
_MEETINGS = f"""ends as (select id, min_by(x, pos) as fx, min_by(y, pos) as fy, max_by(x, pos) as lx, max_by(y, pos) as ly from pts group by id),
steps as (select id, pos as k, x as ax, y as ay, lead(x) over w as ex, lead(y) over w as ey from pts window w as (partition by id order by pos)),
seg as (select s.id, s.k, s.ax, s.ay, s.ex, s.ey, fx, fy, lx, ly, fx <> lx or fy <> ly as open from steps s join ends e on e.id = s.id where ex is not null and (ax <> ex or ay <> ey)),
near as (select s.id as id, t.id as other, s.k as k, t.k as k2, s.ax as ax, s.ay as ay, s.ex as ex, s.ey as ey, t.ax as cx, t.ay as cy, t.ex as dx, t.ey as dy, s.fx as f1x, s.fy as f1y, s.lx as l1x, s.ly as l1y, s.open as open1, t.fx as f2x, t.fy as f2y, t.lx as l2x, t.ly as l2y, t.open as open2,
  sign({_area('s.a', 's.e', 't.a')}) as o1, sign({_area('s.a', 's.e', 't.e')}) as o2, sign({_area('t.a', 't.e', 's.a')}) as o3, sign({_area('t.a', 't.e', 's.e')}) as o4
  from seg s join seg t on s.id < t.id and least(s.ax, s.ex) <= greatest(t.ax, t.ex) and least(t.ax, t.ex) <= greatest(s.ax, s.ex) and least(s.ay, s.ey) <= greatest(t.ay, t.ey) and least(t.ay, t.ey) <= greatest(s.ay, s.ey)),
lex as (select *, o1 = 0 and o2 = 0 and o3 = 0 and o4 = 0 as flat, greatest(least(ax * 10000 + ay, ex * 10000 + ey), least(cx * 10000 + cy, dx * 10000 + dy)) as p, least(greatest(ax * 10000 + ay, ex * 10000 + ey), greatest(cx * 10000 + cy, dx * 10000 + dy)) as q from near where o1 * o2 <= 0 and o3 * o4 <= 0),
hit as (select *, case when flat then p when o1 = 0 then cx * 10000 + cy when o2 = 0 then dx * 10000 + dy when o3 = 0 then ax * 10000 + ay when o4 = 0 then ex * 10000 + ey end as spot,
  case when flat then p = q when o1 = 0 then {_beside('a', 'e', 'c')} when o2 = 0 then {_beside('a', 'e', 'd')}
   when o3 = 0 then {_beside('c', 'd', 'a')} when o4 = 0 then {_beside('c', 'd', 'e')} else true end as meets from lex),
met as (select id, other, k, k2, p, q, flat and p < q as piece, ax * 10000 + ay as a1, ex * 10000 + ey as b1, cx * 10000 + cy as a2, dx * 10000 + dy as b2, meets and not coalesce(
   open1 and ({_meets_at('f1')} or {_meets_at('l1')}) or open2 and ({_meets_at('f2')} or {_meets_at('l2')}), false) as touch from hit),
pair as (select id, other, bool_or(piece) as piece, bool_or(touch) as touch from met group by 1, 2),
part as (select id as own, other as than, k, least(a1, b1) as lo, greatest(a1, b1) as hi, p, q from met where piece union all select other, id, k2, least(a2, b2), greatest(a2, b2), p, q from met where piece),
run as (select *, max(q) over (partition by own, than, k order by p, q rows between unbounded preceding and 1 preceding) as reach from part),
full_ as (select own, than, k from run group by own, than, k having min(p) = min(lo) and max(q) = max(hi) and bool_and(reach is null or p <= reach)),
covered as (select f.own, f.than from full_ f group by f.own, f.than having count(*) = (select count(*) from seg s where s.id = f.own)),
crossing as (select id, other from pair p where case when piece then not exists (select 1 from covered c where c.own = p.id and c.than = p.other) and not exists (select 1 from covered c where c.own = p.other and c.than = p.id) else touch end)"""


@query(f"with {_FAR} {_MEETINGS} select id, other from crossing union all select other, id from crossing")
def coastline_crossings(c: Context) -> DataFrame:
    coast = c.ways.where(F.col("tags")["natural"] == "coastline")
    return coastlines.crossings(elements.way_coordinates(coast, c.nodes).where("n_nodes >= 2"), 40.0)


@query(f"with {_NEAR} {_MEETINGS} select id, other from crossing union all select other, id from crossing")
def coastline_crossings_near(c: Context) -> DataFrame:
    coast = c.ways.where((F.col("tags")["natural"] == "coastline") & (F.size("nodes") >= 2))
    first = F.element_at("nodes", 1)
    x = lambda n: ((first * 104729 + F.col("id") * 31) % 3500 + (n * 7919) % 41 - 20) / 10 - 175
    y = lambda n: ((first * 7919 + F.col("id") * 17) % 1700 + (n * 104729) % 31 - 15) / 10 - 85
    lines = coast.select("id", F.transform("nodes", lambda n: F.struct(x(n).alias("x"), y(n).alias("y"))).alias("coords"))
    return coastlines.crossings(lines, 4.0)


@query()
def coastline_way_reasons(c: Context) -> DataFrame:
    return coastlines.way_reasons(c.ways.where(F.col("tags")["natural"] == "coastline"), c.nodes).select("id", "first_node", "last_node", "reason")


@query()
def polygon_build(c: Context) -> DataFrame:
    p = admins.polygons(c.relations.where(filters.ADMINS.scan(F.col("tags"))), c.ways, c.nodes)
    return p.select("id", "reason", F.size("rings").alias("n_rings"))


def _features(c: Context) -> DataFrame:
    """Expected tags of nodes: one value, lists of values, a key that nothing has, one that is ignored."""
    n = c.view("v_nodes").where("id % 3 = 0").select(F.lit("N").alias("osm_type"), F.col("id").alias("osm_id"), "name")
    vals = F.create_map(F.lit("place"), F.when(F.col("osm_id") % 2 == 0, F.array(F.lit("economy"))).otherwise(F.array(F.lit("economy"), F.lit("large"), F.lit("promo"))), F.lit("population"), F.array(F.lit("1")), F.lit("name"), F.array("name"))
    return n.select("osm_type", "osm_id", vals.alias("tags"), F.create_map(F.lit("place"), F.col("osm_id") % 2 == 1).alias("is_array"))


@query("""select 'N' as osm_type, id as osm_id, case when name = '*' then '*' else name end as friendly_name, case when id % 30 = 0 then 'Deleted' when place is null then 'Missing tag ''place'', expected it to be ''' || want || ''''
 else 'Expected tag ''place'' to be ' || want || ', but found ''' || place || '''' end as details from (select *, case when id % 2 = 0 then '''economy''' else '''economy'', ''large'', or ''promo''' end as want from {v_nodes} where id % 3 = 0)
 where id % 30 = 0 or place is null or (id % 2 = 0 and place <> 'economy') or (id % 2 = 1 and place not in ('economy', 'large', 'promo'))""")
def feature_tag_issues(c: Context) -> DataFrame:
    actual = c.nodes.select(F.lit("N").alias("etype"), "id", (F.col("id") % 30 == 0).alias("deleted"), "tags")
    return features.tag_issues(_features(c), actual).select("osm_type", "osm_id", "friendly_name", "details")


def _snapshots(c: Context) -> tuple[DataFrame, DataFrame]:
    v = c.view("v_issues")
    cols = ["friendly_name", "issue_type", "osm_type", "osm_id", "details"]
    return v.where("odd = 0").select(*cols, "first_seen"), v.where("odd = 1").select(*cols)


@query("""select c.friendly_name, c.issue_type, c.osm_type, c.osm_id, c.details, cast(floor(epoch(case when p.osm_id is null then timestamp '2024-02-01 00:00:00' else p.first_seen end)) as bigint) as first_seen_s from {v_issues} c
 left join (select issue_type, osm_type, osm_id, details, min(first_seen) as first_seen from {v_issues} where odd = 0 group by all) p
 on c.issue_type = p.issue_type and c.osm_type = p.osm_type and c.osm_id = p.osm_id and c.details is not distinct from p.details where c.odd = 1""")
def issue_first_seen(c: Context) -> DataFrame:
    prev, cur = _snapshots(c)
    out = issues.first_seen(cur, prev, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.select("friendly_name", "issue_type", "osm_type", "osm_id", "details", F.unix_timestamp("first_seen").alias("first_seen_s"))


@query("""select 'all' as snapshot, cast(7 as bigint) as seq, cast(5 as bigint) as last_good_seq where (select count(*) from {v_issues} where issue_type in ('OpenAdminPolygon', 'BrokenCoastLine', 'AdminsState')) > 0
 union all select 'good', 7, 7""")
def last_known_good(c: Context) -> DataFrame:
    from datetime import datetime

    _, cur = _snapshots(c)
    old = c.spark.createDataFrame([(datetime(2024, 1, 5), 5)], "last_good_ts timestamp, last_good_seq bigint")
    now, seq = F.lit("2024-02-01 00:00:00").cast("timestamp"), F.lit(7)
    a = issues.header(cur, now, seq, old).select(F.lit("all").alias("snapshot"), "seq", "last_good_seq")
    return a.unionByName(issues.header(cur.where("issue_type = 'AdminCentre'"), now, seq, old).select(F.lit("good").alias("snapshot"), "seq", "last_good_seq"))


@query("""select t.pos, t.issue_type, coalesce(i.n, 0) as n, case when coalesce(i.n, 0) = 0 then 'green' when t.issue_type in ('OpenAdminPolygon', 'BrokenCoastLine', 'AdminsState') then 'red' else 'orange' end as colour
 from (values (0, 'OpenAdminPolygon'), (1, 'OpenAdminPolygon7'), (2, 'OpenAdminPolygon8'), (3, 'BrokenCoastLine'), (4, 'AdminsState'), (5, 'AdminCentre'), (6, 'MissingWays')) t(pos, issue_type)
 left join (select issue_type, count(*) as n from {v_issues} group by 1) i on i.issue_type = t.issue_type""")
def issue_overview(c: Context) -> DataFrame:
    return issues.overview(c.view("v_issues"))


@query("""select strftime(first_seen, '%Y-%m-%d  -  %A') as title, osm_type, osm_id, 'https://www.openstreetmap.org/' || case osm_type when 'N' then 'node' when 'W' then 'way' else 'relation' end || '/' || osm_id as url, friendly_name, details, strftime(first_seen, '%Y-%m-%d %H:%M:%S') as seen from {v_issues} where issue_type = 'BrokenCoastLine'""")
def issue_page(c: Context) -> DataFrame:
    return issues.page(c.view("v_issues"), "BrokenCoastLine").select("title", "osm_type", "osm_id", "url", "friendly_name", "details", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query("select 'N' as kind, p.p_partkey as id, (select max(b.offset_) from {v_blobs} b where b.first_id <= p.p_partkey) as offset from {part} p where p.p_partkey >= 7")
def blob_index_ranges(c: Context) -> DataFrame:
    ids = c.view("part").select(F.lit("N").alias("kind"), F.col("p_partkey").alias("id"))
    return spatial.assign_blobs(ids, c.view("v_blobs").withColumnRenamed("offset_", "offset"))


def _states(c: Context) -> DataFrame:
    return c.view("v_repl_state").select("period_s", "seq", F.timestamp_seconds(3600 * (F.col("seq") + 1)).alias("end_ts"))


@query("select cast(floor(epoch(e.ts)) as bigint) as ts_s, min(s.seq) as seq from (select distinct ts from {events}) e join {v_repl_state} s on 3600 * (s.seq + 1) > epoch(e.ts) group by 1")
def replication_locate(c: Context) -> DataFrame:
    # an hour has one sequence, so timestamps are looked up by their hour, not one by one
    wanted = c.view("events").select(F.lit(3600).alias("period_s"), F.date_trunc("hour", "ts").alias("ts"), F.unix_timestamp("ts").alias("ts_s")).distinct()
    found = changes.locate(_states(c), wanted.select("period_s", "ts").distinct())
    return wanted.join(found, ["period_s", "ts"]).select("ts_s", "seq").distinct()


@query("select seq, substr(lpad(cast(seq as varchar(20)), 9, '0'), 1, 3) || '/' || substr(lpad(cast(seq as varchar(20)), 9, '0'), 4, 3) || '/' || substr(lpad(cast(seq as varchar(20)), 9, '0'), 7, 3) || '.state.txt' as path from {v_repl_state}")
def replication_paths(c: Context) -> DataFrame:
    return c.view("v_repl_state").select("seq", F.concat(scalars.sequence_path(F.col("seq")), F.lit(".state.txt")).alias("path"))


@query("""with recursive b as (select cast(floor(min(epoch(ts))) as bigint) as lo, cast(floor(max(epoch(ts))) as bigint) as hi from {events}),
 walk as (select 0 as step, cast(0 as bigint) as period, lo - lo % 60 as t, hi - hi % 60 as m, hi - hi % 3600 as h, hi - hi % 86400 as d from b
 union all select step + 1, p, t + p, m, h, d from (select *, case when t % 86400 = 0 and t + 86400 <= d then 86400 when t % 3600 = 0 and t + 3600 <= h then 3600 when t + 60 <= m then 60 end as p from walk) where p is not null)
 select cast(step - 1 as int) as step, cast(period as int) as period_s, t - period as start_s, t as end_s from walk where step > 0""")
def catchup_plan(c: Context) -> DataFrame:
    from ..streaming import replication

    lo, hi = c.view("events").agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    start = lo - lo % 60
    steps = replication.plan(start, {60: hi - hi % 60, 3600: hi - hi % 3600, 86400: hi - hi % 86400})
    return c.spark.createDataFrame([(k, p, s, e) for k, (p, s, e) in enumerate(steps)], "step int, period_s int, start_s bigint, end_s bigint")


@query("select distinct cast(floor(node_id / 64) as bigint) as bucket, node_id, way_id from {v_way_nodes}")
def dump_node_way_buckets(c: Context) -> DataFrame:
    return spatial.node_way_buckets(c.view("v_way_nodes"), 64)


@query("select day, issue_type, count(*) as n from (select cast(first_seen as date) as day, issue_type from {v_issues}) group by 1, 2")
def issues_by_day(c: Context) -> DataFrame:
    return c.view("v_issues").groupBy(F.to_date("first_seen").alias("day"), "issue_type").agg(F.count("*").alias("n"))


@query("select 'N' as kind, first_id, lead(first_id) over (order by first_id) as next_id from {v_blobs}")
def blob_ranges(c: Context) -> DataFrame:
    return spatial.blob_ranges(c.view("v_blobs")).select("kind", "first_id", "next_id")


_MOVED = "(select id, first_node, case when id % 10 = 0 then last_node + 1 else last_node end as last_node from {v_ends} join {v_ways} using (id) where natural_tag = 'coastline' and n_nodes >= 2)"


@query(f"""select node_id as osm_id, state from (select node_id, cast(list_reduce(list(ev order by id), lambda s, e: case when e = 0 then 0 else greatest(least(s + e, 1), -1) end, 0) as int) as state
 from (select first_node as node_id, id, case when first_node = last_node then 0 else 1 end as ev from {_MOVED} union all select last_node, id, -1 from {_MOVED} where first_node <> last_node) group by node_id) where state <> 0""")
def stream_incremental_issues(c: Context) -> DataFrame:
    from ..streaming import loop

    return loop.replayed_issues(c)


_PLACES = "{v_nodes} n on n.id = x.node_id"


@query(f"""select x.rel_id, x.node_id, n.lat, n.lon from (select rel_id, ref as node_id from (select * from {{v_members}} union all select * from {{v_centres}}) where type = 'N' and rel_id in (select id from {{v_relations}})
 union select m.rel_id, w.node_id from (select * from {{v_members}} union all select * from {{v_centres}}) m join {{v_way_nodes}} w on w.way_id = m.ref where m.type = 'W' and m.rel_id in (select id from {{v_relations}}) and m.ref in (select id from {{v_ways}})) x join {_PLACES}""")
def relation_coordinates(c: Context) -> DataFrame:
    return elements.relation_coordinates(c.members, c.way_nodes, c.nodes)


@query("""select osm_type, osm_id, 'https://www.openstreetmap.org/' || case osm_type when 'N' then 'node' when 'W' then 'way' else 'relation' end || '/' || osm_id as page,
 case when osm_type = 'R' then 'http://ra.osmsurround.org/analyzeRelation?relationId=' || osm_id end as analyzer,
 'http://localhost:8111/load_object?new_layer=true&objects=' || lower(osm_type) || osm_id || '&relation_members=true' as editor from (select distinct osm_type, osm_id from {v_issues})""")
def issue_links(c: Context) -> DataFrame:
    return issues.links(c.view("v_issues").select("osm_type", "osm_id").distinct())
