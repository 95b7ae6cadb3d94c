"""Every registered query of the event graph against its SQL in DuckDB, on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from trailgrain.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted([tuple(round(float(x), 6) if isinstance(x, (float, Decimal)) else str(x) for x in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in found.fetchall()]
    assert plain([tuple(r[c] for c in columns) for r in got.collect()]) == plain(want)


def test_routes_are_valid(spark):
    assert registry.queries()["route_violations"](spark, DATA).count() == 0


def test_graph_rounds_run_to_the_end(spark, monkeypatch):
    from trailgrain.operators import graph as G
    from trailgrain.plans import graphs

    short = spark.createDataFrame([(k, k, k + 1, k * graphs.HOUR) for k in range(8)], "edge_id long, src long, dst long, timestamp_ns long").coalesce(1)
    monkeypatch.setattr(graphs, "pois", lambda edges: edges.where("edge_id = 7"))
    assert {tuple(r) for r in graphs.all_routes_backward(short).collect()} == {(k, 7 - k) for k in range(8)}
    monkeypatch.setattr(graphs, "pois", lambda edges: edges.where("edge_id = 0"))
    assert {tuple(r) for r in graphs.all_routes_forward(short).collect()} == {(k, k) for k in range(8)}
    got = G.reachable(short, spark.createDataFrame([(0,)], "node long")).collect()
    assert {(r.node, r.hop) for r in got} == {(k, k) for k in range(9)}


def test_noisy_or_winner_by_the_order_of_the_sql(spark):
    from trailgrain.plans import scores

    # Scores 0.999988 of the point of interest 96709 and 0.999977 of 3988, which is far less in id.
    rows = [(1, "f1", "p1", 0), (96709, "p1", "f2", 10**9), (3988, "p1", "f3", 2 * 10**9)]
    edges = spark.createDataFrame(rows, "edge_id long, src string, dst string, timestamp_ns long").coalesce(1)
    (row,) = scores.poi_noisy_or(edges).collect()
    assert (row.winner, row.support) == (3988, 2)


def test_lineage_replay_without_deep_chains(spark):
    from trailgrain.plans import lineages

    rows = [(5, "p900", "p901", "EVENT_FORK", 10), (6, "p901", "f1", "EVENT_SENDTO", 20)]
    edges = spark.createDataFrame(rows, "edge_id long, src string, dst string, relation string, timestamp_ns long").coalesce(1)
    got = {tuple(r) for r in lineages.lineage_replay(edges).collect()}
    assert got == {("own", "none"), ("planted", "expiry"), ("planted", "link"), ("planted", "root")}
