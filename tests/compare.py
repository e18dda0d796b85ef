"""Run a registered query and its SQL text on the same tables and compare rows and types."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pyarrow as pa


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t) or pa.types.is_string_view(t):
        return "string"
    return "timestamp" if pa.types.is_timestamp(t) else str(t)


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = []
    for n in names:
        c = table.column(n)
        columns.append([(0.0 if isinstance(v, float) and v == 0 else v) for v in c.to_pylist()])
    return sorted(zip(*columns), key=lambda r: tuple((v is not None, str(type(v)), v if not isinstance(v, float) or not math.isnan(v) else 0.0)
                                                     if not isinstance(v, (dict, list)) else (True, "", str(v)) for v in r)) if names else []


def differences(got: pa.Table, want: pa.Table) -> list[str]:
    """What differs, in words; empty if the tables hold the same rows."""
    out = []
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} against {sorted(want.column_names)}"]
    for n in got.column_names:
        a, b = _kind(got.schema.field(n).type), _kind(want.schema.field(n).type)
        if a != b:
            out.append(f"type of {n}: {a} against {b}")
    if got.num_rows != want.num_rows:
        out.append(f"{got.num_rows} rows against {want.num_rows}")
    if not out:
        a, b = _rows(got), _rows(want)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            out.append(f"{len(bad)} of {len(a)} rows differ, first {bad[0][0]} against {bad[0][1]}")
    return out
