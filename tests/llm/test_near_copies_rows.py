"""Near copies by bands on odd rows."""

import pytest

from buswright.llm import near_copies


def test_odd_rows_have_classes_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(200))
    changed = text.replace("w100 ", "")
    rows = [(5, text, "a"), (3, changed, "b"), (9, text, "c"), (9, text, "c"), (None, text, "d"), (1, None, "e"), (2, "", "f"), (4, " \t", "g"), (6, "short text", "h"), (7, "short text", "i"), (8, text + " x" * 300, "j")]  # repeated shingles count once
    d = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in near_copies.near_duplicates(d).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 3), (6, 6), (7, 6), (8, 3), (9, 3), (9, 3)]
    assert near_copies.near_duplicates(d.limit(0)).collect() == []


@pytest.mark.parametrize("bad", [0.845, 0, 1.2, -0.5])
def test_a_similarity_that_is_no_whole_percent_is_refused(spark, bad):
    with pytest.raises(ValueError, match="whole hundredths"):
        near_copies.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), bad)
