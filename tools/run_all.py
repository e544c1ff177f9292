"""Run every registered query once and print rows / seconds / schema (dev aid)."""
import json
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
from panelkit.catalog import registered  # noqa: E402
from panelkit.session import get_spark  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = set(sys.argv[2].split(",")) if len(sys.argv) > 2 else None
spark = get_spark("local[8]")
schemas = {}
for k, f in registered().items():
    if only and k not in only:
        continue
    t = time.time()
    try:
        df = f(spark, sf)
        n = df.count()
        schemas[k] = df.dtypes
        print(f"OK   {k:28s} rows={n:7d} {time.time()-t:6.2f}s {df.dtypes}", flush=True)
    except Exception as e:  # noqa: BLE001
        print(f"FAIL {k:28s} {type(e).__name__}: {str(e)[:300]}", flush=True)
        traceback.print_exc(limit=3)
json.dump(schemas, open("/tmp/schemas.json", "w"))
