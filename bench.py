"""Headline queries: one JSON line with seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import time

from trackspark.plans import registry
from trackspark.session import build_session

HEADLINE = (
    "p2_project", "p6_pocket_membership", "j2_resolve_segment", "j1_asof_first", "j5_nearest_time", "j6_match_frames", "j10_match_truth", "a1_summary",
    "a7_build_census", "a8_window_summary", "a10_track_summary", "w2_running_median", "w9_census_drops", "w13_group_onsets", "g2_judge", "a16_summarize_verdicts",
    "j14_match_gallery", "a12_separation", "a21_pr_sweep", "w15_associate", "a18_standings", "a19_head_to_head", "b1_build_brackets", "v2_check_unique", "a30_fingerprint",
    "w17_dedupe_claims", "w18_prune_candidates", "b2_propagate", "b5_replay", "r2_latency_summary", "r4_stream_pots", "r8_append_audit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores, int(cores) if cores.isdigit() else 8)
    registry.QUERIES["a30_fingerprint"](spark, sf_dir).collect()  # start the executor threads and the file cache
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
