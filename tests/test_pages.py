"""Pages of a listing against the whole of it in order."""

import random

import pytest

from shelfmark.operators import pages


@pytest.mark.parametrize("descending", [True, False])
def test_pages(spark, tmp_path, descending):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(40)]), f"n{i}") for i in range(1000)]
    path = str(tmp_path / "listing")
    pages.write_listing(spark.createDataFrame(rows, "id long, size long, name string"), path, "size", "id", descending, 60)
    wanted = sorted(rows, key=lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if descending else r[1], r[0]))
    page = pages.page_at(spark, path, 930, 25, "size", "id", descending)
    assert [tuple(r) for r in page.rows] == wanted[930:955] and page.has_more and page.total == 1000 and page.ranges_read <= 2
    end = pages.page_at(spark, path, 990, 25, "size", "id", descending)
    assert [tuple(r) for r in end.rows] == wanted[990:] and not end.has_more
    assert pages.page_at(spark, path, 2000, 5, "size", "id", descending).rows == []
    found, last, most = [], None, 0
    while True:
        page = pages.page_after(spark, path, last, 170, "size", "id", descending)
        found += [tuple(r) for r in page.rows]
        most, last = max(most, page.ranges_read), page.last
        if not page.has_more:
            break
    assert found == wanted and most <= 6


def test_empty_listing(spark, tmp_path):
    path = str(tmp_path / "none")
    pages.write_listing(spark.createDataFrame([], "id long, size long"), path, "size", "id")
    assert pages.page_after(spark, path, None, 5, "size", "id").rows == [] and pages.page_at(spark, path, 0, 5, "size", "id").total == 0
