"""Compare every registered query with its SQL twin: ``python -m tests.check_oracle [sf] [key prefix ...]``."""

from __future__ import annotations

import sys
import time

from quirecheck.plans import all_queries
from tests.support import compare, database, session


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), database(sf_dir)
    bad = 0
    for key, q in all_queries().items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if q.oracle is None:
                n = q.build(spark, sf_dir).count()
                verdict = f"rows only: {n}"
            else:
                verdict, rows, oracle_time = compare(q.build(spark, sf_dir), con, q.oracle)
                start += oracle_time
                bad += bool(verdict)
                if verdict:
                    verdict = "DIFFERENT " + verdict
                else:
                    verdict = f"ok ({rows} rows, sql {oracle_time:.1f}s)" if rows else "ok BUT EMPTY"
        except Exception as e:  # a broken query must not hide the others
            bad += 1
            verdict = f"FAILED {type(e).__name__}: {str(e)[:900]}"
        print(f"{key:26} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
