"""Queries over whole tables where those that SQL states are bound to a part of one, against plain readings."""

import json
from collections import Counter

from ledgerloom.functions.text import read_object, scalar_text
from ledgerloom.operators import nested
from ledgerloom.plans import catalogue, training


def ident(x):
    return (x or "").strip().lower() or None


def test_ledger_tail_runs(spark, sf_dir, duck):
    best, last = {}, {}
    low = -(2**63)
    for i, run, cursor, seq, state in duck.execute("SELECT snapshot_id, run_id, replay_cursor, seq, state_json FROM snapshot_envelopes").fetchall():
        if ident(run) and read_object(state) is not None:
            best[ident(run)] = max(best.get(ident(run), (low, low, low)), (low if seq is None else seq, low if cursor is None else cursor, i))
    for run, n in duck.execute("SELECT run_id, last_durable_sequence FROM commit_markers").fetchall():
        if ident(run) and n is not None:
            last[ident(run)] = max(n, last.get(ident(run), n))
    want, every = Counter(), 0
    for run, seq, kind in duck.execute("SELECT run_id, sequence, op_kind FROM event_envelopes").fetchall():
        run = ident(run)
        if run and seq is not None:
            every += 1
            want[run, ident(kind)] += best.get(run, (0, low))[1] < seq <= last.get(run, seq)
    got = {(r.run_id, r.op_kind): r.n for r in catalogue.ledger_tail_runs(spark, sf_dir).collect()}
    assert got == {k: n for k, n in want.items() if n}
    assert 0 < sum(got.values()) < every


def test_join_point_in_span_all(spark, sf_dir, duck):
    entries = set(duck.execute("SELECT scope_id, snapshot_no, path, line, severity FROM lint_entries").fetchall())
    errors = {}
    for *k, line, severity in entries:
        if severity == "error" and None not in k:
            errors.setdefault(tuple(k), []).append(line)
    want = Counter((*k, line, x) for *k, line, severity in entries if severity == "info" for x in errors.get(tuple(k), ()) if abs(line - x) <= 5)
    got = Counter(tuple(r) for r in catalogue.join_point_in_span_all(spark, sf_dir).collect())
    assert got == want and {k[1] for k in got} - {1}


def test_text_lint_lines_all(spark, sf_dir, duck):
    want = {}
    for code, line in duck.execute("SELECT trim(code), line FROM lint_entries").fetchall():
        n, lines = want.get(code, (0, 0))
        want[code] = n + 1, lines + line
    assert {r.code: (r.n, r.lines) for r in catalogue.text_lint_lines_all(spark, sf_dir).collect()} == want


def test_scalar_canonical_objects(spark, sf_dir, duck):
    texts = dict(duck.execute("SELECT delivery_id, payload_json FROM event_envelopes WHERE payload_json IS NOT NULL").fetchall())
    want = {i: v for i, t in texts.items() if (v := read_object(t)) is not None}
    got = {r.delivery_id: r.canonical for r in catalogue.scalar_canonical_objects(spark, sf_dir).collect()}
    assert {i: json.loads(c) for i, c in got.items()} == want
    assert all(c == json.dumps(want[i], sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i, c in got.items())
    assert any(texts[i].startswith('"') for i in got)


def test_graph_signature_all(spark, sf_dir, duck):
    edges = set(duck.execute("SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer").fetchall())
    no = {x: i for i, x in enumerate(sorted({x for e in edges for x in e}, key=lambda x: (x[0], x)))}
    got = [tuple(r) for r in catalogue.graph_signature_all(spark, sf_dir).select("src_no", "dst_no").collect()]
    assert sorted(got) == sorted((no[a], no[b]) for a, b in edges)
    assert len(got) > 25


def test_typed_table_of_each_family(spark, sf_dir):
    long = training.p4_unified(spark, sf_dir).select("family", "file_id", "record_no", "value_type").collect()
    for family in {r.family for r in long}:
        wide = vars(training)[f"p4_{family}"](spark, sf_dir)
        assert wide.count() == len({(r.file_id, r.record_no) for r in long if r.family == family})
        if any(r.family == family and r.value_type == "integer" for r in long):
            assert "bigint" in {t for c, t in wide.dtypes if c not in ("file_id", "record_no")}


def test_stages_go_with_their_scope(spark):
    from ledgerloom.session import _hadoop, new_path, stored, working

    with working(spark):
        paths = [new_path(spark, "a")]
        df = stored(spark.range(5), "b")
        assert df.count() == 5
        kept = df.inputFiles()[0].rpartition("/")[0]
        p, fs = _hadoop(spark, kept)
        assert fs.exists(p)
    assert not fs.exists(p) and paths


def test_p1_tables(spark, sf_dir, duck):
    every = lambda x: [] if x is None else x if isinstance(x, list) else [x]
    within = lambda x, k: x.get(k) if isinstance(x, dict) else None
    text = lambda x: None if isinstance(x, (dict, list)) else scalar_text(x)
    want = Counter()
    for i, t in duck.execute("SELECT record_id, artifact_json FROM aspf_artifacts").fetchall():
        record = read_object(t) or {}
        for n, s in enumerate(every(record.get("boundary_asymmetry_scenario"))):
            want["aspf_artifacts", i, "scenario", n, text(s), None, None] += 1
            for side in ("left", "right"):
                if isinstance(s, dict) and side in s:
                    want["aspf_artifacts", i, "side", 0, text(s[side]), "scenario", n] += 1
                    for k, x in enumerate(every(within(s[side], "basis_path"))):
                        want["aspf_artifacts", i, "step", k, text(x.get("key") if isinstance(x, dict) else x), "side", 0] += 1
        for n, c in enumerate(every(record.get("cases"))):
            want["aspf_artifacts", i, "case", n, text(c.get("case_id") if isinstance(c, dict) else c), None, None] += 1
            of = within(c, "dimensions")
            for at, x in [(0, x) for x in of.values()] if isinstance(of, dict) else [(k, x) for k, x in enumerate(of or []) if isinstance(x, dict)]:
                want["aspf_artifacts", i, "dimension", at, text(x), "case", n] += 1
                if isinstance(x, dict) and "mask" in x:
                    want["aspf_artifacts", i, "mask", 0, text(x["mask"]), "dimension", at] += 1
    for i, t in duck.execute("SELECT delivery_id, payload_json FROM event_envelopes").fetchall():
        record = read_object(t)
        if record is not None:
            want["event_envelopes", i, "payload", 0, text(record.get("key")), None, None] += 1
            v = record.get("value")
            for n, s in enumerate(v if isinstance(v, list) else every(within(v, "sites"))):
                if isinstance(s, dict):
                    want["event_envelopes", i, "site", n, text(s.get("path")), "payload", 0] += 1
                    for k, x in enumerate(every(s.get("params"))):
                        want["event_envelopes", i, "param", k, text(x), "site", n] += 1
    got = training.p1_tables(spark, sf_dir).collect()
    idx = {(r.source, r.record_id, r.node_type, r.pre): r.idx for r in got}
    assert len(idx) == len(got)
    assert Counter((r.source, r.record_id, r.node_type, r.idx, r.value, r.parent_type, r.parent_pre if r.parent_pre is None else idx[r.source, r.record_id, r.parent_type, r.parent_pre]) for r in got) == want
    assert {r.node_type for r in got} == {t.name for t in nested.ARTIFACT_TYPES + nested.PAYLOAD_TYPES}
    n = Counter((r.node_type, r.parent_type) for r in got)
    assert {(r.node_type, r.parent_type): r.n for r in training.p1_table_counts(spark, sf_dir).collect()} == n
