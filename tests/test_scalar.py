"""Functions that parse a text for each row."""

import pytest

from tidemark.functions import scalar


@pytest.mark.parametrize("name", scalar.PARSING)
def test_parsing_is_spread_over_tasks(name, spark, sf):
    """part is one small file, which one task would read."""
    assert scalar.queries()[name](spark, sf).rdd.getNumPartitions() >= 8
