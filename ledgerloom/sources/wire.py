"""Ledger envelopes in the protocol-buffer wire format: events, snapshots, commit markers and manifests.

A message is a run of fields, each a varint of its number and kind and then a varint or a length and bytes. Unknown
fields are skipped, so later versions can be read. Encoding and decoding run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The number of each field, and whether it is a varint or bytes.
MESSAGES = {
    "event": {"sequence": (1, "varint"), "run_id": (2, "bytes"), "record": (3, "bytes")},
    "snapshot": {"run_id": (1, "bytes"), "replay_cursor": (2, "varint"), "snapshot": (3, "bytes")},
    "commit": {"run_id": (1, "bytes"), "last_durable_sequence": (2, "varint")},
    "manifest": {"body": (1, "bytes")},
}
_VARINT, _FIXED64, _BYTES, _FIXED32 = 0, 1, 2, 5


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at
        if shift > 63:
            raise ValueError("varint of more than ten bytes")


def encode(kind: str, values: dict) -> bytes:
    """A message of the kind; None fields are left out."""
    out = bytearray()
    for name, (number, form) in MESSAGES[kind].items():
        v = values.get(name)
        if v is None:
            continue
        if form == "varint":
            out += varint(number << 3 | _VARINT) + varint(v)
        else:
            raw = v.encode() if isinstance(v, str) else v
            out += varint(number << 3 | _BYTES) + varint(len(raw)) + raw
    return bytes(out)


def decode(kind: str, data: bytes) -> dict | None:
    """Fields of a message by name, absent ones None; of repeated fields the last counts. None for broken messages."""
    by_number = {number: (name, form) for name, (number, form) in MESSAGES[kind].items()}
    out, at = dict.fromkeys(MESSAGES[kind]), 0
    try:
        while at < len(data):
            tag, at = _read_varint(data, at)
            name, form = by_number.get(tag >> 3, (None, None))
            if tag & 7 == _VARINT:
                v, at = _read_varint(data, at)
                if form == "varint":
                    out[name] = v - (1 << 64) if v >> 63 else v
            elif tag & 7 == _BYTES:
                n, at = _read_varint(data, at)
                if at + n > len(data):
                    return None
                if form == "bytes":
                    out[name] = data[at : at + n].decode()
                at += n
            elif tag & 7 in (_FIXED64, _FIXED32):
                at += 8 if tag & 7 == _FIXED64 else 4
                if at > len(data):
                    return None
            else:
                return None
    except (IndexError, ValueError):  # cut off, or not text
        return None
    return out


def _schema(kind: str) -> str:
    return ", ".join(f"{n} {'bigint' if form == 'varint' else 'string'}" for n, (_, form) in MESSAGES[kind].items())


def to_wire(df: DataFrame, key: str, kind: str) -> DataFrame:
    """key, message (binary) of rows with the message's fields as columns."""
    names = list(MESSAGES[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(kind, dict(zip(names, r))) for r in zip(*cols)], pa.binary())], names=[key, "message"])

    return df.select(key, *names).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, message binary")


def from_wire(df: DataFrame, key: str, kind: str) -> DataFrame:
    """key and the fields of messages (column message); broken and null ones are left out."""
    names = list(MESSAGES[kind])
    kinds = [pa.int64() if form == "varint" else pa.string() for _, form in MESSAGES[kind].values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decode(kind, m) if m is not None else None for m in b.column(1).to_pylist()]
            ok = [i for i, r in enumerate(got) if r is not None]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok, pa.int32())), *(pa.array([got[i][n] for i in ok], t) for n, t in zip(names, kinds))], names=[key, *names])

    return df.select(key, "message").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {_schema(kind)}")
