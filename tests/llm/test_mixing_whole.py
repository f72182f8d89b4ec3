"""The mixture leaves no document that fits, in all copies that are allowed."""

import pytest

from quern.llm import mixing
from quern.session import table


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_no_source_leaves_a_document_that_fits(spark, sf, scale):
    rows = mixing.mix_documents(table(spark, sf.replace("sf0.001", scale), "documents")).collect()
    left = {}
    for r in rows:
        left[r.source] = left.get(r.source, r.target) - r.taken
    assert all(v >= 0 for v in left.values())
    assert not [r for r in rows if r.copies < mixing.MAX_REPEAT and 0 < r.size <= left[r.source]]
    assert {r.copies for r in rows} == {0, 1, 2, 3}


def test_a_document_gets_its_third_copy_where_others_do_not_fit(spark):
    # a takes 5 / 7 of all words, at most 3 times its own
    rows = [(1, "a", 1), (2, "a", 40), (3, "b", 59), (4, "b", 300)]
    docs = spark.createDataFrame([(d, "w " * n, s) for d, s, n in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    assert (got[1].copies, got[2].copies) == (3, 3)
    target = got[3].target
    used = got[3].taken + got[4].taken
    assert not any(got[d].copies < 3 and got[d].size <= target - used for d in (3, 4))
