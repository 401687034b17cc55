"""Change files as a stream: ``spark.readStream.format("mapreplication").load(folder)``.

The folder has ``state.txt``, whose sequence number is the latest, and the files by
sequence (``000/001/042.osc.gz``).  Offsets are sequence numbers; a micro-batch has a
task for each file after the last one that was done.  Options: ``start``, the last
sequence that is known (default: none is, so it begins at ``first``, 0 by default).
"""

from __future__ import annotations

import gzip
import io
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schemas import CHANGES
from ..streaming.replication import parse_state, path_of
from .osc import SECTIONS
from .pbf import open_file

_KIND = {"node": "N", "way": "W", "relation": "R"}
_PLACE = {"node": 0, "way": 1, "relation": 2}


def read_file(data: bytes, seq: int):
    """Rows of ``schemas.CHANGES`` of one file, gzip or plain; places count as in ``osc.read_changes``."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    section, numbers, places = None, dict.fromkeys(SECTIONS, -1), {}
    for event, e in ElementTree.iterparse(io.BytesIO(raw), events=("start", "end")):
        if event == "start":
            if e.tag in SECTIONS:
                section = e.tag
                numbers[section] += 1
                places = dict.fromkeys(_KIND, 0)
        elif e.tag in SECTIONS:
            section = None
            e.clear()
        elif e.tag in _KIND and section:
            kind = e.tag
            at = numbers[section] * 3_000_000_000 + _PLACE[kind] * 1_000_000_000 + places[kind]
            places[kind] += 1
            number = lambda k, e=e: float(e.get(k)) if e.get(k) is not None else None
            tags = {t.get("k"): t.get("v") or "" for t in e.findall("tag")}
            nodes = [int(n.get("ref")) for n in e.findall("nd")] if kind == "way" else None
            members = [(_KIND[m.get("type")], int(m.get("ref")), m.get("role") or "") for m in e.findall("member")] if kind == "relation" else None
            yield (seq, SECTIONS.index(section), at, _KIND[kind], int(e.get("id")), int(e.get("version") or 0), number("lat") if kind == "node" else None, number("lon") if kind == "node" else None, nodes, members, tags)
            e.clear()


def latest(folder: str) -> int | None:
    """The sequence number of a folder's ``state.txt``, None where there is none."""
    try:
        with open_file(f"{folder}/state.txt") as f:
            return parse_state(f.read().decode())[0]
    except FileNotFoundError:
        return None


class _File(InputPartition):
    def __init__(self, seq: int):
        self.seq = seq


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.start = int(options.get("start", int(options.get("first", 0)) - 1))

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    def latestOffset(self) -> dict:
        found = latest(self.folder)
        return {"seq": self.start if found is None else max(found, self.start)}

    def partitions(self, start: dict, end: dict):
        return [_File(k) for k in range(start["seq"] + 1, end["seq"] + 1)]

    def read(self, partition):
        with open_file(f"{self.folder}/{path_of(partition.seq)}.osc.gz") as f:
            yield from read_file(f.read(), partition.seq)

    def commit(self, end: dict) -> None:
        pass


class MapReplication(DataSource):
    """Registered by ``register(spark)`` as mapreplication."""

    @classmethod
    def name(cls) -> str:
        return "mapreplication"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(MapReplication)
