import gzip

import pytest
from pyspark.sql import functions as F

from tidewarden.sources import osc, replication
from tidewarden.streaming.replication import path_of

FILES = [
    "<osmChange><create><node id='1' version='1' lat='1.5' lon='2.5'><tag k='place' v='town'/></node><way id='4' version='1'><nd ref='1'/></way></create><create><node id='2' version='1' lat='1' lon='1'/></create></osmChange>",
    "<osmChange><modify><relation id='3' version='2'><member type='way' ref='4' role='outer'/></relation><node id='1' version='2' lat='3' lon='4'/></modify><delete><node id='2' version='2'/></delete></osmChange>",
    "<osmChange/>",
]


@pytest.fixture
def folder(tmp_path):
    def add(k):
        path = tmp_path / "files" / f"{path_of(k)}.osc.gz"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(FILES[k % 3].encode()))
        (tmp_path / "files" / "state.txt").write_text(f"# state\nsequenceNumber={k}\ntimestamp=2024-01-02T03\\:04\\:00Z\n")

    return tmp_path, add


def test_rows_are_those_of_files(spark, folder):
    root, add = folder
    add(0), add(1)
    for k in (0, 1):
        path = root / "files" / f"{path_of(k)}.osc.gz"
        want = sorted(map(str, osc.read_changes(spark, str(path)).collect()))
        got = spark.createDataFrame(list(replication.read_file(path.read_bytes(), k)), osc.read_changes(spark, str(path)).schema)
        assert sorted(map(str, got.collect())) == want


def test_stream_of_files(spark, folder):
    """Each file is read once, in batches up to the latest state; without one, nothing is."""
    root, add = folder
    (root / "files").mkdir()
    replication.register(spark)
    assert replication.latest(str(root / "files")) is None
    seen = []

    def run():
        source = spark.readStream.format("mapreplication").load(str(root / "files"))
        q = source.writeStream.foreachBatch(lambda df, k: seen.append(sorted(map(tuple, df.groupBy("file_seq").agg(F.count("*")).collect())))).option("checkpointLocation", str(root / "ck")).start()
        q.processAllAvailable()
        q.stop()

    add(0), add(1)
    run()
    add(2), add(3)
    run()
    assert [x for x in seen if x] == [[(0, 3), (1, 3)], [(3, 3)]]
