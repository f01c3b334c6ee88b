"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from checks.verify import session  # noqa: E402

HEADLINE = (
    "ln_split", "ln_redact", "ln_mask_java", "r_weak", "r_secret", "scan_all", "r_py_authz", "a_correlate",
    "g_calls", "g_enrich_route", "d_frameworks", "d_components", "src_skip", "imp_semgrep", "cmp_unreported",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        # the first run of each query warms it up
        times[name] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({
        "metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
