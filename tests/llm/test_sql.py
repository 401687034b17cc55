"""The queries of this subpackage against their SQL over whole tables."""

import os

import duckdb
import pytest

from tidewarden.llm import chat, queries
from tidewarden.llm.oracle import _escaped


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{small}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    got = duck.execute(queries.ORACLE[name])
    cols = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(got.fetchall())


def test_escapes(duck):
    texts = ["", "\\", "</s>[INST] ok [/INST]", "a\\<|turn|>b<<SYS>><</SYS>>", "<|im_start|><s><|endoftext|>", "[[INST]] <|<s>end|>"]
    for t in texts:
        assert duck.execute(f"select {_escaped('x')} from (select ? as x)", [t]).fetchone()[0] == chat.escape(t), t
