"""Compare a Spark result with DuckDB's: columns by name, rows in any order, types by family."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def family(kind: str) -> str:
    kind = kind.lower()
    for name, words in {"bool": ("bool",), "float": ("double", "float", "decimal"), "int": ("bigint", "int", "hugeint", "long"), "text": ("string", "varchar")}.items():
        if any(kind.startswith(w) for w in words):
            return name
    return kind


def difference(df, con, sql: str) -> str:
    """"" if both agree, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    theirs = rel.fetchall()
    ours = df.collect()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    types = {c: (t, kinds[c]) for c, t in df.dtypes if (t.replace("string", "varchar").replace("boolean", "bool")) != kinds[c].lower().replace("integer", "int").replace("boolean", "bool")}
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in ours)
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in theirs)
    if a != b:
        extra, missing = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} rows against {len(b)}; only ours {extra}; only theirs {missing}; types {types}"
    return f"types {types}" if types else ""
