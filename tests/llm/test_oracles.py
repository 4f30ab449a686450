"""The training-data queries against their SQL twins, on the smallest tables and on planted rows."""

import glob
import os

import duckdb
import pyarrow as pa
import pytest

from provena.llm import chat, queries

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    at = {d[0]: k for k, d in enumerate(found.description)}
    columns = sorted(df.columns)
    assert sorted(at) == columns
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert mine and mine == sorted((tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall()), key=repr)


def test_quotes_in_sql(spark):
    rows = [
        (1, 0, "u", "Hello there\nfriend.\n\nSecond part."), (1, 1, "a", "On Monday u wrote:\n> Hello   there friend.\n\nMy answer."), (1, 2, "u", ">> hello there\n>> FRIEND.\n>\n> My answer.\n\n\n\nThanks"),
        (2, 0, "u", "> Second part.\nnot mine"), (2, 1, "a", "> nobody said this\nok"), (3, 0, "u", None), (3, None, "u", "text"), (None, 4, "u", ""), (1, 1, "a", "On Monday u wrote:\n> Hello   there friend.\n\nMy answer."),
        (1, 3, "a", "> Second part.\nback to the start"), (1, 4, "u", "after that"), (1, 5, "u", "> My answer.\nlate"), (1, 6, "u", "> Second part.\nagain"), (2, 5, "u", "gap"), (0, 0, "u", "> late\nthing"), (5, 0, "u", "> thing\nlate"),
    ]
    con = duckdb.connect()
    con.register("conversations", pa.table({n: [r[k] for r in rows] for k, n in enumerate(("conv_id", "turn", "role", "text"))}))
    found = con.execute(chat.ORACLE)
    columns = [d[0] for d in found.description]
    df = chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(*columns)
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
