"""The derived archive's text files: the lines in order, without sorting lines."""

import pytest
from pyspark.sql import functions as F

from fianchetto.plans import bindings as B
from tests.conftest import SMALL


@pytest.mark.parametrize("kinds", [{}, {"bad_bytes": True}, {"joined": True}])
def test_archive_holds_the_sorted_lines(spark, kinds):
    """A file's bytes are its lines in order of their numbers, with the lines that are no UTF-8 and those that share a line."""
    part = F.spark_partition_id().alias("p")
    got = B.pgn_archive_b4(spark, SMALL, 4, **kinds).select(part, "file", F.col("value").cast("binary").alias("v")).collect()
    lines = B.pgn_lines_b4(spark, SMALL, **kinds).repartition(4, "file").sortWithinPartitions("file", "ln")
    want = lines.select(part, "file", F.col("line").cast("binary").alias("v")).collect()

    def files(rows):
        out = {}
        for r in rows:
            out.setdefault(r.p, []).append(bytes(r.v) + b"\n")
        return sorted(b"".join(x) for x in out.values())

    assert files(got) == files(want)


def test_no_text_is_sorted_or_dealt(spark):
    plan = B.pgn_archive_b4(spark, SMALL, 4)._jdf.queryExecution().executedPlan().toString()
    at = min(plan.index("Sort "), plan.index("Exchange "))
    assert "Event" in plan[:at] and "Event" not in plan[at:] and "Generate" not in plan
