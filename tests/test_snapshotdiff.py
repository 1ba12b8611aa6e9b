import datetime as dt
import random

from ledgerloom.operators import snapshotdiff as S

LINT = "scope_id string, snapshot_no int, loaded_at timestamp, path string, line int, col int, code string, message string, severity string, param string, keys int"
T = dt.datetime(2025, 1, 1)


def lint(spark, rows):
    return S.lint_rows(spark.createDataFrame([(s, n, T, p, li, 1, c, m, sev, par, 0) for s, n, p, li, c, m, sev, par in rows], LINT))


def changes(df):
    return {(r.scope_id, r.snapshot_no, r.record_key, r.change_kind) for r in S.snapshot_changes(df).collect()}


def test_kinds_of_change(spark):
    rows = [
        ("s", 1, "./a.py", 1, "df1", "m  x", None, None), ("s", 1, "b.py", 2, "DF1", "m", "error", "p"), ("s", 1, "c.py", 3, "DF1", "m", "error", None),
        ("s", 4, "a.py ", 1, " DF1", "m x ", "warning", None), ("s", 4, "b.py", 2, "DF1", "m", "error", None), ("s", 4, "d\\e.py", 3, "DF1", "m", "error", None),
        ("s", 4, "d/e.py", 3, "DF1", "m", "error", None), ("t", 2, "x.py", 1, "A", "m", None, None),
    ]
    assert changes(lint(spark, rows)) == {("s", 4, "b.py:2:1:DF1", "changed"), ("s", 4, "c.py:3:1:DF1", "removed"), ("s", 4, "d/e.py:3:1:DF1", "added")}


def test_empty_param_is_not_null(spark):
    assert changes(lint(spark, [("s", 1, "a", 1, "c", "m", None, None), ("s", 2, "a", 1, "c", "m", None, "")])) == {("s", 2, "a:1:1:C", "changed")}


def test_metrics(spark):
    df = spark.createDataFrame([("s", 1, T, "a", " k", 1, None, 5), ("s", 2, T, "a ", "k", 1, 0, 9), ("s", 3, T, "a", "k", 2, 0, 9)], "scope_id string, snapshot_no int, loaded_at timestamp, advisory string, metric_key string, baseline_count bigint, current_count bigint, delta bigint")
    assert changes(S.metric_rows(df)) == {("s", 3, "a/k", "changed")}


def test_last_load_counts_and_nulls(spark):
    df = spark.createDataFrame([("t", None, 1, "k", 1, T), ("t", None, 2, "k", 2, T), ("t", None, 2, "k", 1, T + dt.timedelta(1)), ("t", None, None, "k", 5, T), ("t", None, 2, None, 5, T), ("t", None, 2, "n", None, T)], "source_table string, scope_id string, snapshot_no int, record_key string, row_hash bigint, loaded timestamp")
    assert changes(df) == set()
    assert changes(df.limit(0)) == set()


def test_large_snapshots_against_brute_force(spark):
    rng = random.Random(5)
    state, rows, want = {}, [], set()
    for n in range(1, 7):
        new = dict(state)
        for _ in range(40 if state else 4000):
            k = f"k{rng.randrange(6000):05d}"
            if k in new and rng.random() < 0.4:
                del new[k]
            else:
                new[k] = rng.randrange(1 << 40)
        if n > 1:
            want |= {("s", n, k, "added" if k not in state else "removed" if k not in new else "changed") for k in state.keys() | new.keys() if state.get(k) != new.get(k)}
        state = new
        rows += [("t", "s", n, k, v, T) for k, v in new.items()] * (2 if n == 3 else 1)
    df = spark.createDataFrame(rows, "source_table string, scope_id string, snapshot_no int, record_key string, row_hash bigint, loaded timestamp").repartition(3)
    assert changes(df) == want


def test_a_scope_in_many_parts(spark, monkeypatch):
    rows = [("t", "s" if i % 3 else "r", n, f"k{i:04d}", i * n if i % 50 == 0 else i, T) for n in (1, 2) for i in range(900) if (i + n) % 97]
    df = spark.createDataFrame(rows, "source_table string, scope_id string, snapshot_no int, record_key string, row_hash bigint, loaded timestamp")
    whole = changes(df)
    monkeypatch.setattr(S, "PART_ROWS", 100)
    assert changes(df) == whole and {k for *_, k in whole} == {"added", "removed", "changed"}
