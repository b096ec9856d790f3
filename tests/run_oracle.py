"""python -m tests.run_oracle FOLDER [QUERY...]: queries against their SQL, with times."""

import importlib
import sys
import time

from mnemosa.session import build_session
from tests.oracle import compare

if __name__ == "__main__":
    import __spark_entry__ as e

    mods = [m for m in sys.argv[1:] if m.startswith("mod=")]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    if mods:
        ms = [importlib.import_module(m[4:]) for m in mods]
        q, s = {k: v for m in ms for k, v in m.QUERIES.items()}, {k: v for m in ms for k, v in m.SQL.items()}
    else:
        q, s = e.queries(), e.oracle_sql()
    names = [a for a in sys.argv[2:] if not a.startswith("mod=")] or list(q)
    for n in names:
        t = time.time()
        try:
            if n in s:
                rows, a, b, cols = compare(spark, sys.argv[1], q[n], s[n])
                ok = not a and not b and not cols
                print(n, "OK" if ok else "DIFF", rows, f"{time.time() - t:.1f}s", flush=True)
                if not ok:
                    print("   names differ" if cols else "", len(a), len(b), list(a)[:3], list(b)[:3], flush=True)
            else:
                print(n, "rows", q[n](spark, sys.argv[1]).count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:  # noqa: BLE001
            print(n, "ERROR", str(x)[:1500], flush=True)
