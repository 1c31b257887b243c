"""Runs registered queries beside their DuckDB oracles: python tests/compare.py SF_DIR [NAME...]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    got = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(got, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, sf_dir, name, query, sql):
    """None if both engines agree, else what differs."""
    df = query(spark, sf_dir)
    a = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    b = sorted_rows(names, cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; {list(set(a[1]) ^ set(b[1]))[:4]}"
    wrong = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(wrong)} of {len(a[1])} rows differ: {wrong[:2]}" if wrong else None if a[1] else "no rows"


if __name__ == "__main__":
    import __spark_entry__
    from meterline.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    session, con = local_session(), duck(sf)
    session.sparkContext.setLogLevel("ERROR")
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for n in names or [q for q in queries if not q.startswith(("op", "pipeline"))]:
        began = time.time()
        try:
            said = compare(session, con, sf, n, queries[n], oracles[n]) if n in oracles else f"no oracle; {queries[n](session, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{n}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
