"""``python tests/check.py [name-prefix ...]``: compare queries with their SQL; SF picks the table folder."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

from millrace.plans import load_all  # noqa: E402
from millrace.session import build_session  # noqa: E402


def main() -> int:
    sf_dir = f"/root/testdata/sf{os.environ.get('SF', '0.01')}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    prefixes = sys.argv[1:]
    bad = 0
    for name, q in load_all().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start, notes = time.time(), []
        try:
            problem = compare(spark, con, q, sf_dir, notes)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {'' if q.oracle else '(rows)'} "
              f"{problem or ''}{' '.join(notes)}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
