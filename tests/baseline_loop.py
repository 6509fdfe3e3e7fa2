"""Time the plain single-process loop on the supplier series of one scale."""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from compare import connect  # noqa: E402
from foldcast.catalog.oracle import PX  # noqa: E402
from foldcast.operators.folds import LINEAR  # noqa: E402
from helpers import least_squares, loop_forecasts  # noqa: E402

began = time.perf_counter()
prices = connect(sys.argv[1]).execute(f"SELECT * FROM ({PX['supp']}) ORDER BY sid, dt").df()
loaded = time.perf_counter()
spec = LINEAR.but(start_date=None, end_date=None)
made = 0
for _, part in prices.groupby("sid"):
    pred, _ = loop_forecasts(part.price.to_numpy(), spec, least_squares)
    made += int((pred == pred).sum())
print(f"{len(prices)} rows, {made} forecasts, load {loaded - began:.1f} s, loop {time.perf_counter() - loaded:.1f} s")
