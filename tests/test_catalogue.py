"""Every catalogued query with an oracle gives the oracle's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from palimpsest.plans import catalogue, further, lookups, placements  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    out = catalogue.QUERIES[name](spark, SF)
    names = sorted(out.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == names
    places = [want.columns.index(c) for c in names]
    got = sorted(tuple(plain(row[c]) for c in names) for row in out.collect())
    assert got == sorted(tuple(plain(row[i]) for i in places) for row in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_repeats(spark, name):
    """Queries that no SQL states (their operators are held against brute force elsewhere) have rows, and the same ones again."""
    once, again = ([tuple(map(plain, r)) for r in catalogue.QUERIES[name](spark, SF).collect()] for _ in range(2))
    assert once and sorted(once) == sorted(again)


def test_operations_follow_from_the_streams(spark):
    for r in catalogue.QUERIES["sdi_ops"](spark, SF).collect():
        assert min(r.s, r.d, r.i) >= 0 and r.s + r.d <= r.n
    own = catalogue._turn_tokens(spark, SF).collect()
    fused = {(r.conv_id, r.turn): r for r in catalogue.QUERIES["msa_vote"](spark, SF).collect()}
    certain = {(r.conv_id, r.turn): r.certain for r in catalogue.QUERIES["certain_transfer"](spark, SF).collect()}
    for r in own:
        assert set(filter(None, fused[r.conv_id, r.turn].fused.split(" "))) <= set(r.ref) | set(r.hyp)
        assert certain[r.conv_id, r.turn] <= min(len(r.ref), len(r.hyp))
        if r.ref == r.hyp:
            assert fused[r.conv_id, r.turn].cost == 0
