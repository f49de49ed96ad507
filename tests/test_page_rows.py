"""Queries over pages where several pages have one url."""

from auditloom.plans import registry


def test_pages_of_one_url_are_counted_apart(spark, tmp_path):
    link = '<a href="/x">'
    rows = [(1, "u", f"{link}{link}\nnone\n{link}"), (2, "u", link), (2, "u", link), (3, "v", f"{link} nofollow"), (4, "v", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in registry.queries()["negation_guard"](spark, str(tmp_path)).select("file_path", "line_number", "n_links").collect())
    assert got == [("u", 1, 1), ("u", 1, 1), ("u", 1, 2), ("u", 3, 1)]
