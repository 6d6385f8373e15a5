"""What a query leaves in the shared folder: its result at most."""

import os

import pytest

from wordloom.llm import queries
from wordloom.session import shared_dir


@pytest.mark.parametrize("name", ["op3_nearest", "op5_toxicity", "op7_simhash", "op9_token_counts", "op10_external_shuffle",
                                  "op11_ranked_search", "op12_exact_dedup"])
def test_only_the_result_stays(spark, name):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0
    new = {x for x in set(os.listdir(folder)) - before if "wordloom-code" not in x}      # the shipped package and its checksum
    assert len(new) <= 1, new
