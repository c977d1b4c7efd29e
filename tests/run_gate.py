"""Run every registered query against its SQL twin (local gate).
usage: python tests/run_gate.py [sf_dir] [key ...]"""
import json, os, sys, time
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E
from docsift.session import get_session
from oracle_compare import compare, duck

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
keys = sys.argv[2:] or list(E.queries())
spark = get_session(8)
con = duck(sf)
Q, S = E.queries(), E.oracle_sql()
res = {}
for k in keys:
    t = time.time()
    try:
        df = Q[k](spark, sf)
        if k in S:
            r = compare(df, S[k], sf, con)
        else:
            r = {"spark_rows": df.count(), "oracle": None}
    except Exception as e:  # report and go on
        r = {"error": repr(e)[:600]}
    r["sec"] = round(time.time() - t, 1)
    res[k] = r
    print(k, json.dumps(r, default=str)[:900], flush=True)
bad = [k for k, r in res.items() if "error" in r or r.get("values_match") is False]
print("FAILED:", bad)
