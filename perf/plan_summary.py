"""Physical-plan shape of every clinical query (before adaptive
re-planning): shuffles, broadcasts, join kinds, scans and aggregation kinds.

    python perf/plan_summary.py [sf_dir] > perf/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SKIP = {"commands_ingest", "history_json", "encounter_stream", "layout_join", "insert_patients", "cascade_delete", "export_documents", "layout_lookups",
        "layout_email_first", "vitals_at_rest", "patch_files", "cascade_delete_files", "history_refresh", "authorised_stream"}   # these write data while they are built


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from ehrflow.plans import catalog
    from ehrflow.plans.layout import plan_text
    from ehrflow.session import build_session
    spark = build_session(master="local[8]", shuffle_partitions=16, extra={"spark.ui.showConsoleProgress": "false"})
    print(f"# Plan shapes at {os.path.basename(sf_dir)}\n")
    print("Counted in the physical plan before adaptive re-planning (AQE may still coalesce partitions,")
    print("split skewed ones or turn a sort-merge join into a broadcast). `pushed` = scans that carry")
    print("pushed filters. Queries that write data while they are built are not listed.\n")
    print("| query | shuffles | broadcasts | sort-merge joins | scans | pushed | sort aggregates | windows |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in sorted(catalog.QUERIES.items()):
        if name in SKIP:
            continue
        t = plan_text(fn(spark, sf_dir))
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", t))
        print(f"| {name} | {shuffles} | {t.count('BroadcastExchange')} | {t.count('SortMergeJoin')} | "
              f"{t.count('FileScan parquet')} | {len(re.findall(r'PushedFilters: \[[^\]]+\]', t))} | "
              f"{t.count('SortAggregate')} | {t.count('Window ')} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
