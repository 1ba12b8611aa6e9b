"""Projection specs: a small declarative pipeline over one relation, its normal form and identity.

A spec is a list of operations (select, project, count_by, traverse, sort, limit) with parameters. Specs that mean the
same have one normal form, and its canonical JSON is the spec's identity: adjacent selects are one sorted set of named
predicates, operations that do nothing are gone, group fields are sorted, sort keys have an explicit order.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

OPS = ("select", "project", "count_by", "traverse", "sort", "limit")


@dataclass(frozen=True)
class Op:
    op: str
    params: Mapping = field(default_factory=dict)


@dataclass(frozen=True)
class Spec:
    name: str
    pipeline: tuple[Op, ...] = ()
    domain: str = ""
    params: Mapping = field(default_factory=dict)
    spec_version: int = 1


def from_dict(d: Mapping) -> Spec:
    """Tolerant reading: a bad version is 1, operations that aren't objects with a name are dropped."""
    version = d.get("spec_version")
    ops = []
    for x in d.get("pipeline") or []:
        if isinstance(x, Mapping) and isinstance(x.get("op"), str) and x["op"].strip():
            ops.append(Op(x["op"].strip(), dict(x["params"]) if isinstance(x.get("params"), Mapping) else {}))
    return Spec(str(d.get("name") or ""), tuple(ops), str(d.get("domain") or ""), dict(d["params"]) if isinstance(d.get("params"), Mapping) else {}, version if isinstance(version, int) and not isinstance(version, bool) else 1)


def to_dict(spec: Spec) -> dict:
    return {"spec_version": spec.spec_version, "name": spec.name, "domain": spec.domain, "params": dict(spec.params), "pipeline": [{"op": o.op, "params": dict(o.params)} for o in spec.pipeline]}


def _strings(value) -> list[str]:
    """Non-blank strings of a string or list, tidied, first occurrence kept."""
    items = [value] if isinstance(value, str) else value if isinstance(value, Sequence) else []
    return list(dict.fromkeys(x.strip() for x in items if isinstance(x, str) and x.strip()))


def sort_keys(params: Mapping) -> list[tuple[str, str]]:
    """(field, asc or desc) of a sort; strings are ascending, unknown orders too; a bare mapping counts as nothing."""
    by = params.get("by")
    out = []
    for e in [by] if isinstance(by, str) else by if isinstance(by, Sequence) else []:
        if isinstance(e, str) and e.strip():
            out.append((e.strip(), "asc"))
        elif isinstance(e, Mapping):
            name = next((e[k] for k in ("field", "key", "name") if isinstance(e.get(k), str) and e[k].strip()), None)
            if name:
                order = str(e.get("order") or "asc").strip().lower()
                out.append((name.strip(), order if order in ("asc", "desc") else "asc"))
    return out


def limit_count(params: Mapping) -> int | None:
    """The limit, None where there is none: not a whole number, or negative."""
    n = params.get("count")
    if isinstance(n, str):
        try:
            n = int(n)
        except ValueError:
            return None
    return n if isinstance(n, int) and not isinstance(n, bool) and n >= 0 else None


def predicates(params: Mapping) -> list[str]:
    """Predicate names of a select, the older single key included."""
    return sorted({*_strings(params.get("predicates")), *_strings(params.get("predicate"))})


def _sorted(value):
    if isinstance(value, Mapping):
        return {k: _sorted(value[k]) for k in sorted(value, key=str)}
    if isinstance(value, (list, tuple)):
        return [_sorted(x) for x in value]
    return value


def normalize(spec: Spec) -> dict:
    """The normal form; normalising it again changes nothing."""
    out: list[dict] = []
    for o in spec.pipeline:
        if o.op == "select":
            names = predicates(o.params)
            if not names:
                continue
            if out and out[-1]["op"] == "select":
                names = sorted({*names, *out.pop()["params"]["predicates"]})
            out.append({"op": "select", "params": {"predicates": names}})
        elif o.op == "project":
            if names := _strings(o.params.get("fields")):
                out.append({"op": "project", "params": {"fields": names}})
        elif o.op == "count_by":
            if names := sorted({*_strings(o.params.get("fields")), *_strings(o.params.get("field"))}):
                out.append({"op": "count_by", "params": {"fields": names}})
        elif o.op == "sort":
            if keys := sort_keys(o.params):
                out.append({"op": "sort", "params": {"by": [{"field": f, "order": d} for f, d in keys]}})
        elif o.op == "limit":
            if (n := limit_count(o.params)) is not None:
                out.append({"op": "limit", "params": {"count": n}})
        else:
            out.append({"op": o.op, "params": _sorted(dict(o.params))})
    return {"spec_version": spec.spec_version, "name": spec.name, "domain": spec.domain, "params": _sorted(dict(spec.params)), "pipeline": out}


def identity(spec: Spec) -> str:
    """Canonical JSON of the normal form."""
    return json.dumps(normalize(spec), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
