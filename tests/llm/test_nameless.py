"""Rows without a doc_id stay where no other stands for them."""

import pytest

from arbora.llm import similar, simhash


@pytest.mark.parametrize("keep_one", [simhash.keep_one, similar.keep_one])
def test_groups_without_ids(spark, keep_one):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (None, "alone in its group of texts"), (None, "said twice by nobody at all"), (None, "said twice  by nobody at all")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, " ".join(r["text"].split())) for r in got) == [(0, "alone in its group of texts"), (0, "said twice by nobody at all"), (1, "a b c d e f")]
