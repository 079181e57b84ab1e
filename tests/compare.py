"""Run registered queries and their SQL twins, compare rows exactly."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else repr(value)
    return value


def _sorted(rows, names, order):
    place = [names.index(n) for n in order]
    return sorted((tuple(_cell(r[i]) for i in place) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, otherwise the first difference."""
    rows, names = spark_df.collect(), spark_df.columns
    cursor = con.execute(sql)
    other_names = [d[0] for d in cursor.description]
    other = cursor.fetchall()
    order = sorted(names)
    if order != sorted(other_names):
        return f"columns {order} / {sorted(other_names)}"
    a, b = _sorted(rows, names, order), _sorted(other, other_names, order)
    if len(a) != len(b):
        return f"{len(a)} / {len(b)} rows; only here {[x for x in a if x not in b][:3]}; only there {[x for x in b if x not in a][:3]}"
    for x, y in zip(a, b):
        if x != y:
            n = sum(p != q for p, q in zip(a, b))
            return f"{n} of {len(a)} rows differ, first {dict(zip(order, x))} / {dict(zip(order, y))}"
    return None


def main(folder: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from plumbline.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    con, queries, oracle = connect(folder), entry.queries(), entry.oracle_sql()
    for name in names or list(queries):
        start = time.time()
        try:
            if name in oracle:
                df = queries[name](spark, folder)
                found = difference(df, con, oracle[name]) or f"same, {len(con.execute(oracle[name]).fetchall())} rows"
            else:
                found = f"no SQL, {len(queries[name](spark, folder).collect())} rows"
        except Exception as error:  # noqa: BLE001 - shown per query
            found = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {found} [{time.time() - start:.1f} s]", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
