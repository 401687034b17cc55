"""Schemas of map elements, changes, states and issues."""

from __future__ import annotations

MEMBER = "struct<type:string,ref:bigint,role:string>"
NODES = "id bigint, lat double, lon double, tags map<string,string>"
WAYS = "id bigint, nodes array<bigint>, tags map<string,string>"
RELATIONS = f"id bigint, members array<{MEMBER}>, tags map<string,string>"
#: sec: 0 create, 1 modify, 2 delete.
CHANGES = f"file_seq bigint, sec int, pos bigint, etype string, id bigint, version int, lat double, lon double, nodes array<bigint>, members array<{MEMBER}>, tags map<string,string>"
REPL_STATE = "period_s int, seq bigint, end_ts timestamp"
EXPECTED = "country_id bigint, name string, iso2 string, iso3 string, level int, admin_id bigint"
ISSUES = "friendly_name string, issue_type string, osm_type string, osm_id bigint, details string"
ADMINS = "id bigint, friendly_name string, admin_level int, reason string, geom_wkb binary, minx double, miny double, maxx double, maxy double"
COASTLINES = "id bigint, first_node bigint, last_node bigint, reason string, coords array<struct<x:double,y:double>>"

# Names of kinds and texts of issues.
KINDS = ("N", "W", "R")
KIND_NAMES = {"N": "node", "W": "way", "R": "relation"}
ISSUE_TYPES = ("OpenAdminPolygon", "OpenAdminPolygon7", "OpenAdminPolygon8", "BrokenCoastLine", "AdminsState", "AdminCentre", "MissingWays")
BLOCKING_TYPES = ("OpenAdminPolygon", "BrokenCoastLine", "AdminsState")
ADMIN_LEVELS = ("2", "3", "4", "5", "6", "7", "8", "9")
