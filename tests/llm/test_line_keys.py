"""Keys of lines in op8."""

import pytest

from siftlake.llm import line_dedup


def by_hand(n_chars, shorter, i, shift, k):
    n = n_chars - shorter
    sizes = [n // k + (j >= k - n % k) for j in range(k)]
    return n, sum(sizes[:i]) + shift + 1, sizes[i]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_segments_are_placed_in_whole_numbers(spark, threshold):
    lines = spark.range(threshold, 70).selectExpr("cast(id as int) as n_chars")
    n, start, width = line_dedup._spans(threshold)
    rows = lines.select("n_chars", line_dedup.F.inline(line_dedup._places(threshold)))
    placed = rows.select("*", n.alias("n"), start.alias("start"), width.alias("width"))
    assert "double" not in placed._jdf.queryExecution().optimizedPlan().toString()
    for r in placed.collect():
        assert (r.n, r.start, r.width) == by_hand(r.n_chars, r.shorter, r.i, r.shift, threshold + 1)
