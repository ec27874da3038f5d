"""Time the headline queries; prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailglass.plans.catalog import QUERIES  # noqa: E402
from mailglass.session import get_session  # noqa: E402

HEADLINE = [
    "p4_strip_markup", "p7_header_metadata", "u1_extract_links", "u5_domain_rules", "u10_mail_link_rollup", "n9_look_alike", "n11_sender_score",
    "b3_pair_history", "b5_behavior_score", "c1_lexicon", "c2_indicators", "c7_brand_impersonation", "c11_image_rollup", "v2_top_k", "v2_top_k_blocks",
    "v3_knn_vote", "e4_lite_ensemble", "e7_mail_verdicts", "d2_deduplicate", "d3_balance", "d5_split", "m1_vocabulary", "m2_tfidf", "m8_roc_auc",
    "k3_false_positives", "k6_confidence_histogram", "t2_daily_counts", "t5_detection_feedback_join",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("mailglass-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
