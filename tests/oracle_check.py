"""Compare registered queries with their SQL: columns, types and every value.

Run directly for a report:  python -m tests.oracle_check /root/testdata/sf0.01 [query ...]
"""

import sys
import time

import duckdb

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SAME_TYPE = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
}


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def differences(spark, con, sf_dir, name):
    """Human-readable differences; empty when query and SQL agree."""
    query = contract.queries()[name](spark, sf_dir)
    relation = con.sql(contract.oracle_sql()[name])
    want_types = {c: SAME_TYPE.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    if dict(query.dtypes) != want_types:
        return [f"types {sorted(set(query.dtypes) ^ set(want_types.items()))}"]
    columns = sorted(want_types)
    got = [tuple(r) for r in query.select(columns).collect()]
    want = [tuple(r) for r in relation.select(", ".join(f'"{c}"' for c in columns)).fetchall()]
    if len(got) != len(want):
        return [f"{len(got)} rows, expected {len(want)}"]
    wrong = [(g, w) for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)) if g != w]
    return [f"{len(wrong)} of {len(want)} rows differ, first: {wrong[0]}"] if wrong else []


if __name__ == "__main__":
    from jobmargin.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(contract.queries())
    session, duck = local_session("oracle-check"), connect(folder)
    failures = 0
    for query_name in names:
        start = time.time()
        try:
            found = differences(session, duck, folder, query_name)
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failures += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {query_name} {time.time() - start:.2f}s {' '.join(found)}", flush=True)
    print(f"{len(names) - failures} of {len(names)} agree")
    session.stop()
