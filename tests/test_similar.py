from __future__ import annotations

from test_functions import distance


def test_names_within_two_edits(spark):
    from dutyframe.operators.similar import within_two_edits

    some = ["", "a", "ab", "xy", "abc", "mint", "pine", "mine", "minty", "elephant", "elephent", "lephants", "elegant", "ab", None, "abcdefghij", "zbcdefghiz", "bcdefghi"]
    found = {tuple(r) for r in within_two_edits(spark.createDataFrame([(x,) for x in some], "n string"), "n").collect()}
    names = sorted({x for x in some if x is not None})
    assert found == {(a, b, distance(a, b)) for a in names for b in names if a < b and distance(a, b) <= 2}
