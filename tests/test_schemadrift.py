import datetime as dt
import json

from ledgerloom.operators import schemadrift as S

SCHEMA = "file_id bigint, family string, producer string, written_at timestamp, body string, before string, id int"
T = dt.datetime(2025, 1, 1)


def files(spark, rows):
    return spark.createDataFrame([(i, f, p, None if t is None else T + dt.timedelta(hours=t), b, "", 0) for i, f, p, t, b in rows], SCHEMA)


def changes(spark, rows):
    return {tuple(r) for r in S.file_changes(files(spark, rows)).collect()}


def body(*records, lines=False):
    return "\n".join(map(json.dumps, records)) if lines else json.dumps(list(records))


def test_added_removed_renamed_retyped(spark):
    a = body({"record_key": "1", "n": 5, "x": {"y": "v"}, "gone": 1}, {"record_key": "2", "n": 6, "x": {"y": "w"}})
    b = body({"record_key": "2", "n": "6", "x": {"why": "w"}, "new": [1]}, {"record_key": "3", "n": "7", "x": {"why": "u"}}, lines=True)
    assert changes(spark, [(1, "f", "p", 0, a), (2, "f", "p", 30, b), (3, "f", "q", 1, b)]) == {(2, "n", "n"), (2, "x.y", "x.why"), (2, "gone", ""), (2, "", "new")}


def test_repeated_and_late_files(spark):
    a, b = body({"record_key": "1", "a": 1}), body({"record_key": "1", "b": 2})
    assert changes(spark, [(9, "f", "p", 1, b), (4, "f", "p", 1, b), (7, "f", "p", 0, a), (8, "f", "p", None, a), (5, None, None, 0, a), (6, None, None, 1, b)]) == {(4, "a", ""), (4, "", "b"), (6, "a", ""), (6, "", "b")}


def test_a_rename_needs_agreement_in_all_shared_records(spark):
    a = body({"record_key": "1", "a": True}, {"record_key": "2", "a": None}, {"record_key": "3"})
    same = body({"record_key": "1", "b": True}, {"record_key": "2", "b": None}, {"record_key": "3"})
    other = body({"record_key": "1", "b": 1}, {"record_key": "2", "b": None})
    nulls = body({"record_key": "2", "b": None})
    assert changes(spark, [(1, "f", "p", 0, a), (2, "f", "p", 1, same)]) == {(2, "a", "b")}
    assert changes(spark, [(1, "f", "p", 0, a), (2, "f", "p", 1, other)]) == {(2, "a", ""), (2, "", "b")}
    assert changes(spark, [(1, "f", "p", 0, a), (2, "f", "p", 1, nulls)]) == {(2, "a", ""), (2, "", "b")}


def test_flooding_prefers_alike_names_where_values_tie():
    a = S.Profile(body({"record_key": "1", "run_id": "v", "owner": "v"}))
    b = S.Profile(body({"record_key": "1", "runIdentifier": "v", "owner_team": "v"}))
    assert set(S.changes_between(a, b)) == {("run_id", "runIdentifier"), ("owner", "owner_team")}


def test_unreadable_empty_and_null(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(1, "f", "p", 0, None), (2, "f", "p", 1, ""), (3, "f", "p", 2, "{oops\n{\"record_key\": 1}"), (4, "f", "p", 3, "[]")]) == {(3, "", "record_key"), (4, "record_key", "")}


def test_many_days_of_one_producer(spark):
    rows = [(i, "f", "p", i * 5, body({"record_key": "1", f"f{i % 3}": i})) for i in range(60)]
    got = changes(spark, rows)
    assert {i for i, *_ in got} == set(range(1, 60))


def test_one_table(spark):
    a = body({"record_key": "1", "n": 5, "label": "v"}, {"record_key": "2", "n": 6, "label": "w"})
    b = body({"record_key": "2", "n": 6.5, "tag": "w"})
    f = files(spark, [(1, "f", "p", 0, a), (2, "f", "p", 1, b)])
    long = S.unified(f, S.file_changes(f))
    assert {r.field for r in long.collect()} == {"record_key", "n", "label"}
    wide = S.wide_table(long, "f")
    assert dict(wide.dtypes)["n"] == "double"
    assert {tuple(r) for r in wide.collect()} == {(1, 0, "v", 5.0, "1"), (1, 1, "w", 6.0, "2"), (2, 0, "w", 6.5, "2")}


def test_flooding_decides_between_fields_whose_values_tie(monkeypatch):
    a = S.Profile(body({"record_key": "1", "m": {"v": "x", "size": 3}, "n": {"v": "x", "hue": "red"}}))
    b = S.Profile(body({"record_key": "1", "q": {"v": "x", "size": 4}, "p": {"v": "x", "hue": "blue"}}))
    want = {("m.v", "q.v"), ("n.v", "p.v")}
    assert {c for c in S.changes_between(a, b) if all(c)} == want
    monkeypatch.setattr(S, "flood", lambda a, b, start: dict.fromkeys(((x, y) for x in a.fields for y in b.fields), 0.0))
    assert {c for c in S.changes_between(a, b) if all(c)} != want


def test_one_file_delivered_twice_is_read_once(spark):
    a = body({"record_key": "1", "n": 10**20, "label": "v"})
    f = files(spark, [(1, "f", "p", 0, a), (2, "f", "p", 0, a), (3, None, "p", 0, a)])
    long = S.unified(f)
    assert {(r.family, r.file_id) for r in long.collect()} == {("f", 1), (None, 3)}
    assert {r.n for r in S.wide_table(long, "f").collect()} == {str(10**20)}


def test_names_that_occur_together_stay_apart(spark):
    f = files(spark, [(1, "f", "p", 0, body({"record_key": "1", "a": "v"})), (2, "f", "p", 1, body({"record_key": "1", "b": "v"})), (3, "f", "p", 2, body({"record_key": "1", "c": "v"})), (4, "f", "q", 0, body({"record_key": "1", "a": "v", "c": "w"}))])
    got = {(r.file_id, r.field) for r in S.unified(f).collect()} - {(i, "record_key") for i in range(5)}
    assert (4, "a") in got and (4, "c") in got and len({x for i, x in got if i < 4}) == 2
