import json

from ledgerloom.operators import changefeed
from ledgerloom.session import new_path, published

E = "delivery_id bigint, sequence bigint, run_id string, op_kind string, payload_json string, id bigint, cursor string"
S = "snapshot_id bigint, run_id string, replay_cursor bigint, seq bigint, state_json string, seq_no int"
M = "marker_id bigint, run_id string, last_durable_sequence bigint, last bigint"


def state(spark, envelopes=(), snapshots=(), markers=(), values=False):
    e = spark.createDataFrame([(i, *x, 0, "") for i, x in enumerate(envelopes)], E)
    s = spark.createDataFrame([(i, *x, 0) for i, x in enumerate(snapshots)], S)
    m = spark.createDataFrame([(i, *x, 0) for i, x in enumerate(markers)], M)
    return {tuple(r) for r in changefeed.replay(e, s, m, values).collect()}


def p(key, **more):
    return json.dumps({"key": key, **more})


def test_pinned_replay(spark):
    got = state(spark, [(2, "r", "set", p("b", value=2)), (3, "r", "set", p("c", value=3))], [("R ", 1, 1, '{"a": 1}')], [("r", 2), ("r", None), ("r", 1)])
    assert got == {("r", "a", 0), ("r", "b", 2)}


def test_order_repeats_and_tombstones(spark):
    feed = [
        (5, " R", "SET ", p("a")), (9, "r", "delete", p("a")), (7, "r", "set", p("a")), (9, "r", "delete", p("a")),
        (4, "r", "set", p("b", value=None)), (3, "r", "delete", p("b")), (6, "r", "touch", p("c")), (6, "r", None, p("c")),
        (8, "r", "set", '"' + p("d").replace('"', '\\"') + '"'), (8, "r", "set", '{"key": "e'), (8, "r", "set", p("")), (8, "r", "set", "{}"), (8, "r", "set", None),
        (None, "r", "set", p("f")), (1, None, "set", p("f")), (1, "  ", "set", p("f")),
    ]
    assert state(spark, feed) == {("r", "b", 4), ("r", "d", 8)}


def test_best_snapshot_and_bounds(spark):
    snaps = [("r", 10, 10, '{"old": 1}'), ("r", 20, 20, '{"new": 1, "gone": 2}'), ("r", 20, 20, '{"new": 1, "gone": 2}'), ("r", 30, 30, "{unreadable"), ("s", None, None, '{"k": null}'), ("t", 5, 5, "{}")]
    feed = [(15, "r", "delete", p("new")), (25, "r", "delete", p("gone")), (26, "r", "set", p("late")), (-3, "s", "set", p("minus")), (5, "t", "set", p("no")), (6, "t", "set", p("yes"))]
    assert state(spark, feed, snaps, [("r", 25)]) == {("r", "new", 0), ("s", "k", 0), ("s", "minus", -3), ("t", "yes", 6)}


def test_values_and_empty_tables(spark):
    assert state(spark) == set()
    assert state(spark, [(1, "r", "set", p("a", value={"b": [1, "ü"], "a": None}))], values=True) == {("r", "a", 1, '{"a":null,"b":[1,"ü"]}')}


def test_hot_key_and_published_versions(spark):
    root = new_path(spark, "test-state")
    schema = "run_id string, state_key string, seq bigint, dead boolean, val string"
    changes = spark.range(20_000).selectExpr("'r' run_id", "if(id % 3 = 0, 'hot', cast(id as string)) state_key", "id seq", "false dead", "'' val")
    got = changefeed.apply_changes(changes, ["run_id", "state_key"], 20_000, root)
    assert got.where("state_key = 'hot'").collect()[0].seq == 19_998
    assert got.count() == 1 + 20_000 - 6667
    tie = spark.createDataFrame([("r", "k", 1, False, "x"), ("r", "k", 1, True, "x"), ("r", "m", 1, False, "a"), ("r", "m", 1, False, "b"), ("r", None, 1, False, "a")], schema)
    changefeed.apply_changes(tie, ["run_id", "state_key"], 5, root)
    assert {tuple(r) for r in published(spark, root).collect()} == {("r", "k", 1, True, "x"), ("r", "m", 1, False, "b")}
