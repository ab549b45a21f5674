"""Compare reports with their SQL: python tests/check.py [sf dir] [names...]

CHUNK_ROWS sets the size beyond which groups are cut; NO_BROADCAST=1 makes Spark shuffle
both sides of every join, as it does with large tables.
"""

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return f"{x + 0.0:.9g}"  # -0.0 equals 0.0
    return repr(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kinds(types):
    names = {"bigint": "int64", "long": "int64", "int": "int32", "integer": "int32", "double": "double", "string": "varchar",
             "timestamp_ntz": "timestamp", "hugeint": "hugeint"}
    return [names.get(str(t).lower(), str(t).lower()) for t in types]


# Joins that pair every row of one side with every row of the other.
PAIRING = ("CartesianProduct", "BroadcastNestedLoopJoin")


def compare(df, con, sql):
    """List of differences; empty when the results agree and no plan step pairs all rows."""
    cur = con.execute(sql)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    types = dict(zip(names, kinds(r[1] for r in con.execute(f"describe {sql}").fetchall())))
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    ours = dict(zip(df.columns, kinds(t for _, t in df.dtypes)))
    found += [f"type of {n}: {ours[n]} != {types[n]}" for n in names if ours[n] != types[n]]
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(names, want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    found += [f"plan has a {step}" for step in PAIRING if step in plan]
    if len(got) != len(want):
        found.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        a, b = set(got), set(want)
        found.append(f"only ours {sorted(a - b)[:3]} only SQL {sorted(b - a)[:3]} columns {sorted(names)}")
    return found


if __name__ == "__main__":
    import tempfile

    from dwops.session import build_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                         "spark.dwops.chunkRows": os.environ.get("CHUNK_ROWS", "5000000"),
                                         "spark.checkpoint.dir": tempfile.mkdtemp(prefix="dwops-check-")})
    spark.sparkContext.setLogLevel("ERROR")
    if "NO_BROADCAST" in os.environ:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    con, queries, oracle = duck(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            diff = compare(df, con, oracle[name]) if name in oracle else [] if df.count() else ["no rows"]
        except Exception:
            diff = [traceback.format_exc()[-1500:]]
        bad += bool(diff)
        print(f"{'BAD ' if diff else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in oracle else '(no SQL)'}", *diff, sep="\n     " if diff else " ", flush=True)
    print(f"{bad} bad")
    spark.stop()
