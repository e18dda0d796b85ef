"""Compare all (or the named) queries with their SQL texts: python tests/run_compare.py FOLDER [NAME ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkverbs import plans  # noqa: E402
from sparkverbs.session import local_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402


def main():
    folder, names = sys.argv[1], sys.argv[2:]
    queries, sql = plans.all_queries(), plans.all_sql()
    names = [n for n in queries if not names or any(n == m or (m.endswith("*") and n.startswith(m[:-1])) for m in names)]
    spark, con, failed = local_session(8), connect(folder), []
    for name in names:
        start = time.time()
        try:
            got = queries[name](spark, folder).toArrow()
            took = time.time() - start
            start = time.time()
            found = differences(got, con.sql(sql[name]).to_arrow_table()) if name in sql else []
            note = "ok" if name in sql else f"rows only: {got.num_rows}"
        except Exception as e:  # noqa: BLE001
            took, found = time.time() - start, [f"{type(e).__name__}: {str(e)[:600]}"]
            if "-v" in os.environ.get("COMPARE", ""):
                traceback.print_exc()
        if found:
            failed.append(name)
            note = "DIFFERS " + "; ".join(found)
        print(f"{name:28s} {took:6.2f}s sql {time.time() - start:5.2f}s rows {got.num_rows if not found or 'got' in dir() else '-'} {note}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
