"""Runs a query and its SQL side by side."""

import glob
import os
from collections import Counter


def rows_of(columns, rows):
    names = sorted(columns)
    order = [columns.index(c) for c in names]
    return names, Counter(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in rows)


def against_sql(spark, data, function, sql):
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    df = function(spark, data)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1], (list((mine[1] - theirs[1]).items())[:3], list((theirs[1] - mine[1]).items())[:3])
