"""Witnesses move by anchor once, and their faults by witness once."""

from trailgrain.operators import alternatives as A


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(anchor")


def test_faults_with_unknown_events_and_gaps(spark):
    events = spark.createDataFrame([(1, "a", "b", 1), (2, "b", "c", 2), (3, "x", "y", 3), (4, "c", "d", 4)], "edge_id long, src string, dst string, t long")
    pois = spark.createDataFrame([(4,)], "edge_id long")
    ways = {
        (10, 0): [("forward", 0, 2), ("forward", 1, 1), ("back", 0, 2), ("back", 1, 4)],  # whole
        (10, 1): [("forward", 0, 3), ("forward", 1, 1), ("back", 0, 4)],  # no link
        (11, 0): [("forward", 0, 2), ("forward", 1, 99), ("forward", 2, 3), ("back", 0, 2), ("back", 1, 1)],  # an unknown event links nothing; no point
        (12, 0): [("back", 0, 3), ("back", 1, 4)],  # without a way ahead nothing is linked
        (13, 0): [("forward", 0, 99)],
        (14, 0): [("forward", 0, 2), ("back", 0, 4), ("back", 1, 99)],  # the last known event counts
    }
    rows = spark.createDataFrame([(a, s, p, k, e) for (a, s), way in ways.items() for p, k, e in way], "anchor long, slot int, part string, position int, edge_id long")
    found = A.witness_faults(rows, events, pois)
    assert exchanges(found) == 1
    got = {tuple(r) for r in found.collect()}
    assert got == {(10, 1, "broken link"), (11, 0, "broken link"), (11, 0, "no point of interest"), (13, 0, "no point of interest")}


def test_witnesses_are_dealt_once(spark):
    labels = spark.createDataFrame([(1, 0, 0, None, None, 1), (2, 0, 1, 1, 0, 1), (2, 1, 0, None, None, 2)], A.LABEL)
    back = spark.createDataFrame([(1, None), (2, 1)], "edge_id long, next long")
    found = A.witnesses(labels, back)
    assert exchanges(found) == 1
    got = sorted(tuple(r) for r in found.select("anchor", "slot", "part", "position", "edge_id").collect())
    # both ways of 2 are the events 1 and 2: the first stays
    assert got == [(1, 0, "back", 0, 1), (1, 0, "forward", 0, 1), (2, 0, "back", 0, 1), (2, 0, "forward", 0, 2), (2, 0, "forward", 1, 1)]
