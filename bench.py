"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of parquet tables, ``BENCH_CPUS`` the number of
threads. Each query runs once unmeasured (class loading and code generation)
and is then timed; its whole result is produced and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

from scoreloom.plans.queries import QUERIES
from scoreloom.session import local_session

HEADLINE = (
    "reward_total", "reward_components_long", "group_advantage", "preference_pairs", "reward_by_step",
    "evaluation_report", "component_contribution", "config_sweep", "quality_summary", "lexicon_coverage",
    "script_profile", "truncation_report", "review_list", "digits_normalized", "turn_pairs", "sft_text",
    "grpo_prompts", "conversation_text", "tokenized", "padded_batches", "padding_waste", "align_cyclic",
    "decoded_prompts", "stream_scores", "stream_reward_windows", "stream_group_advantage",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    seconds = {}
    for name in names:
        for measured in (False, True):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if measured:
                seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
