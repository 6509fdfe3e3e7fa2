"""Command line: compare all (or the named) queries at one scale."""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

import __spark_entry__ as e  # noqa: E402
from compare import connect, differences  # noqa: E402
from foldcast.session import local_session  # noqa: E402

folder = sys.argv[1]
spark = local_session("8")
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
sql = e.oracle_sql()
names = sys.argv[2:] or list(e.queries())
for name in names:
    t0 = time.time()
    try:
        if name in sql:
            result = differences(spark, folder, e.queries()[name], sql[name], con) or "ok"
        else:
            result = f"rows only: {e.queries()[name](spark, folder).count()}"
    except Exception as err:  # report and go on
        result = f"ERROR {str(err)[:600]}"
    print(f"{name:26s} {time.time() - t0:6.1f}s {result}", flush=True)
