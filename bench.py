"""Time the headline queries: one warm-up and one measured run each, one JSON line at the end.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textweave.registry import QUERIES  # noqa: E402
from textweave.session import build_session  # noqa: E402

HEADLINES = [
    "agg01_temporal_summary",
    "agg03_period_topics",
    "agg08_pearson_matrix",
    "agg11_top_terms",
    "agg19_cooccurrence",
    "jn01_link_by_id",
    "jn02_nearest_time",
    "jn03_time_window",
    "jn04_same_period",
    "jn08_text_outcome_by_period",
    "win05_top_links",
    "sem02_search",
    "tda03_balls",
    "gr05_document_edges",
    "agg04_describe",
    "fea03_one_hot_strings",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.log.level": "ERROR"},
    )
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        for _ in range(2):  # the second run is the one that counts
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
