"""Stored pages against a plain sort."""

from resona.operators import views


def test_pages_are_slices_of_the_sorted_rows(spark):
    rows = [(i * 7919 % 1000, None if i % 97 == 0 else f"x{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(5)
    pages = views.Pages(df, ["k"])
    want = sorted(rows)
    assert len(pages) == 1000
    for limit, offset in ((50, 0), (50, 100), (333, 650), (50, 990), (50, 1000), (0, 5), (2000, 0)):
        assert [tuple(r) for r in pages.page(limit, offset).collect()] == want[offset:offset + limit]


def test_a_page_pushes_its_place_to_the_scan(spark):
    pages = views.Pages(spark.range(5000).withColumnRenamed("id", "k"), ["k"])
    plan = pages.page(10, 2000)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "_at" in plan.split("PushedFilters")[1] and "_part" in plan.split("PushedFilters")[1]


def test_no_rows(spark):
    pages = views.Pages(spark.createDataFrame([], "k long"), ["k"])
    assert len(pages) == 0 and pages.page(10).collect() == []
