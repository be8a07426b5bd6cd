"""Write the physical plans of the key registered queries to docs/PLANS.md.

Usage: python scripts/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fianchetto.plans.catalog import QUERIES  # noqa: E402
from fianchetto.session import get_session  # noqa: E402

KEY = ["frame_games_clean", "valid_games", "max_games", "encode_sequence", "split_exact", "segment_by_elo", "residual_histogram",
       "running_weighted_mean", "early_stop_epoch", "top_positions", "board_onehot"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", shuffle_partitions=16)
    out = ["# Physical plans of key queries", "",
           f"Generated by `scripts/explain_plans.py` on `{os.path.basename(sf)}` "
           "(adaptive plans before execution; long expressions cut at 200 characters).", ""]
    for name in KEY:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        lines = [ln if len(ln) <= 200 else ln[:200] + " ..." for ln in plan.split("\n") if ln.strip()]
        out += [f"## {name}", "", "```", *lines, "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
