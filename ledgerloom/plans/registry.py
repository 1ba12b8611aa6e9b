"""Named specs, and the predicates they may name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.compile import Predicate, get
from ledgerloom.plans.spec import Op, Spec


def _member(field: str, param: str) -> Predicate:
    def test(df: DataFrame, params: Mapping) -> Column:
        allowed = params.get(param) or []
        return get(df, field).isin(*allowed) if allowed else F.lit(False)

    return test


def _flagged(kind: str, flag: str) -> Predicate:
    """Rows of a kind whose flag isn't set."""
    return lambda df, params: (get(df, "row_kind") == kind) & ~F.coalesce(get(df, flag).cast("boolean"), F.lit(False))


def _status_allowed(df: DataFrame, params: Mapping) -> Column:
    allowed = [s for s in params.get("ordered_statuses") or [] if s != "PROVEN_UNREACHABLE" or params.get("include_proven_unreachable")]
    return get(df, "status").isin(*allowed) if allowed else F.lit(False)


PREDICATES: dict[str, Predicate] = {
    "count_gt_1": lambda df, params: get(df, "count") > 1,
    "never_status_allowed": _status_allowed,
    "evidence_row": lambda df, params: get(df, "row_kind") == "evidence",
    "evidence_kind": _member("evidence_kind", "evidence_kinds"),
    "evidence_id": _member("evidence_id", "evidence_ids"),
    "evidence_source": _member("evidence_source", "evidence_sources"),
    "canonicality_is_ambiguous": lambda df, params: (get(df, "row_kind") == "canonicality_signal") & get(df, "signal").isin(*(params.get("ambiguous_signals") or ["ambiguous", "conflicting", "missing", "unknown"])),
    **{
        name: _flagged(kind, flag)
        for name, kind, flag in (
            ("missing_frontmatter", "doc_frontmatter", "present"),
            ("missing_required_field", "doc_required_field", "present"),
            ("invalid_field_type", "doc_field_type", "valid"),
            ("missing_governance_ref", "doc_governance_ref", "present"),
            ("missing_explicit_ref", "doc_explicit_ref", "present"),
            ("review_pin_mismatch", "doc_review_pin", "match"),
            ("missing_review_note", "doc_review_note", "present"),
            ("commutation_unreciprocated", "doc_commutation", "reciprocated"),
            ("missing_loop_entry", "loop_entry", "present"),
            ("missing_matrix_gate_entry", "matrix_gate", "present"),
        )
    },
}


def _spec(name: str, domain: str, *ops: tuple[str, dict], **params) -> Spec:
    return Spec(name, tuple(Op(o, p) for o, p in ops), domain, params)


def _by(*fields: str, **directions: str) -> tuple[str, dict]:
    return "sort", {"by": [{"field": f, "order": directions.get(f, "asc")} for f in fields]}


def _pick(*fields: str) -> tuple[str, dict]:
    return "project", {"fields": list(fields)}


_SUITE = ("suite_path", "suite_qual", "suite_kind", "span_line", "span_col", "span_end_line", "span_end_col")
_SITE = ("site_path", "site_function", "span_line", "span_col", "span_end_line", "span_end_col")
_TESTS = ("test_id", "status", "tag")

SPECS: dict[str, Spec] = {
    s.name: s
    for s in (
        _spec(
            "never_invariants_section", "never_invariants", ("select", {"predicates": ["never_status_allowed"]}),
            _pick("status", "never_id", "reason", *_SITE, "owner", "expiry", "witness_ref", "undecidable_reason"), _by("status", *_SITE[:3], "never_id", "reason"),
            ordered_statuses=["VIOLATION", "OBLIGATION", "PROVEN_UNREACHABLE"], include_proven_unreachable=False, max_entries=50,
        ),
        _spec("test_obsolescence_summary", "test_obsolescence", _pick("class"), ("count_by", {"fields": ["class"]}), _by("class"), _pick("class", "count")),
        _spec("ambiguity_summary", "ambiguity", _pick("kind", *_SUITE[:5], "phase", "candidate_count"), _by("kind", *_SUITE[:4], "phase"), max_entries=20),
        _spec("ambiguity_suite_agg", "ambiguity", _pick(*_SUITE, "kind", "phase"), ("count_by", {"fields": [*_SUITE, "kind", "phase"]}), _by(*_SUITE[:5], "kind", "phase")),
        _spec("ambiguity_virtual_set", "ambiguity", _pick(*_SUITE), ("count_by", {"fields": list(_SUITE)}), ("select", {"predicates": ["count_gt_1"]}), _by(*_SUITE[:4])),
        _spec("deadline_obligations_summary", "deadline_obligations", _pick("status", "kind", "detail", *_SITE, "deadline_id"), _by("status", "kind", *_SITE[:4], "detail"), max_entries=20),
        _spec("lint_findings", "lint", _pick("path", "line", "col", "code", "message"), _by("path", "line", "col", "code", "message")),
        _spec("report_section_lines", "report", _pick("section", "line_index", "text"), _by("section", "line_index")),
        _spec("suite_order", "suite_order", _pick("depth", "complexity", "order_key", *_SUITE), _by("depth", "complexity", "order_key", *_SUITE[:3])),
        _spec("call_cluster_summary", "call_clusters", _pick("identity", "display", "count"), _by("count", "display", count="desc")),
        _spec("call_cluster_consolidation", "call_clusters", _pick("cluster_identity", "cluster_display", "cluster_count", "test_id", "file", "line", "replace", "with"), _by("cluster_identity", "test_id", "line")),
        _spec("test_annotation_drift", "annotation_drift", _pick(*_TESTS, "path"), _by("status", "test_id", "tag")),
        _spec("wl_refinement", "wl", target_node_kind="SuiteSite", edge_alt_kinds=["SuiteContains"], direction="undirected", seed_fields=["suite_kind"], steps=2, stabilize_early=True),
        *(
            _spec(name, domain)
            for domain, names in (
                ("test_obsolescence", ("test_obsolescence_baseline", "test_obsolescence_state", "test_obsolescence_delta")),
                ("annotation_drift", ("test_annotation_drift_baseline", "test_annotation_drift_delta")),
                ("ambiguity", ("ambiguity_baseline", "ambiguity_delta", "ambiguity_state")),
                ("taint", ("taint_state", "taint_baseline", "taint_delta")),
                ("quotient", ("quotient_protocol_readiness", "quotient_promotion_decision", "quotient_demotion_incidents")),
            )
            for name in names
        ),
    )
}
