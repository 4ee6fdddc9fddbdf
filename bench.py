"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores, BENCH_RUNS how often (as far as BENCH_SECONDS go).

The figure of a query is the median of its runs, planning and staging included; ``planning`` gives that part of the median run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = (
    "p1_clean_text", "p4_redact_text", "p8_term_candidates", "p14_replace_term", "w1_assign_stable_ids", "w2_collapse_adjacent_duplicates",
    "w5_interval_union_length", "w6_gap_list", "w10_merge_moments", "w11_rank_and_cap", "w12_stratified_top_n", "w13_pick_per_bin",
    "w15_sessionize_paragraphs", "w16_build_paragraphs", "w18_build_packets", "w21_minute_evidence_buckets", "j2_segments_near_point",
    "j3_point_in_interval", "j4_assign_by_max_overlap", "j5_link_by_shared_ids", "j6_propose_corrections", "j7_apply_corrections",
    "j9_find_dangling_references", "j13_diff_manifests", "d5_candidate_pairs_hamming", "d6_greedy_dedup", "a1_transcript_quality_report",
    "a3_low_density_minutes", "a11_reconcile_terms", "a13_merge_glossary", "s2_read_srt", "s7_explode_candidates", "k6_build_content_manifest",
    "i6_select_changed_inputs", "i7_latest_attempt_status", "v4_rules_evidence", "w14_group_by_boundaries", "a2_asr_quality_report",
    "j17_build_sections_and_highlights", "k7_assemble_reader_dataset", "t1_append_increment_stream",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from reelscribe.plans.catalog import QUERIES
    from reelscribe.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/nation.parquet").count()
    runs, budget = max(1, int(os.environ.get("BENCH_RUNS", "3"))), float(os.environ.get("BENCH_SECONDS", "420"))
    # Staged tables go to one folder of this run, as on a cluster, where spark.checkpoint.dir names it.
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    seen, began, longest = {name: [] for name in HEADLINE}, time.perf_counter(), 0.0
    for done in range(runs):
        if done and time.perf_counter() - began + longest > budget:
            runs = done
            break
        pass_start = time.perf_counter()
        for name in HEADLINE:
            start = time.perf_counter()
            df = QUERIES[name](spark, sf)
            planned = time.perf_counter() - start
            # The noop sink runs the whole plan, every column of every row, without collecting it.
            df.write.format("noop").mode("overwrite").save()
            seen[name].append((round(time.perf_counter() - start, 3), round(planned, 3)))
            print(f"{name} {seen[name][-1][0]}", file=sys.stderr, flush=True)
        longest = max(longest, time.perf_counter() - pass_start)
    middle = {name: sorted(x)[len(x) // 2] for name, x in seen.items()}
    times, planning = ({name: x[k] for name, x in middle.items()} for k in (0, 1))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "planning": planning, "runs": runs, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
