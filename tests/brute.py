"""Plain readings of the test tables for brute-force comparisons."""

import duckdb


def ref(x):
    x = None if x is None else x.strip()
    x = x[2:] if x and x.startswith("./") else x
    return x or None


def links(sf_dir):
    return [(ref(a), ref(b)) for a, b in duckdb.connect().execute(f"SELECT source, target FROM '{sf_dir}/impact_links.parquet'").fetchall()]
