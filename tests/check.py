"""``python -m tests.check [pattern] [sf_dir]``: compare registered queries with their SQL."""

import re
import sys
import time

import __spark_entry__ as entry
from cliploom.session import local_session
from tests.oracle import compare


def main() -> None:
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = local_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if not re.fullmatch(pattern, name) and pattern != "." and pattern != getattr(queries[name], "module", ""):
            continue
        started = time.time()
        try:
            outcome = compare(spark, queries, oracles, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            outcome = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(outcome)
        mark = "FAIL" if outcome else "ok" if name in oracles else "ok (rows only)"
        print(f"{mark:5} {name} {time.time() - started:.1f}s {outcome}", flush=True)
    print("failures:", bad)


main()
