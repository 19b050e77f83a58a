"""The training-data queries that SQL can express agree with it."""

import pytest

from measureaudit.llm import registry

from ..compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert spark_rows(registry.QUERIES[name](spark, sf_dir)) == sql_rows(registry.ORACLES[name], sf_dir)


def test_page_text_is_whole(spark, sf_dir):
    rows = registry.QUERIES["op7_html"](spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    from measureaudit.llm import html

    same = sum(r.text == "\n".join(b.text for b, y in zip(p, html.labels(p), strict=True) if y) for r in rows for p in [html.blocks(pages[r.page_id])])
    assert len(rows) == len(pages) and same >= 0.98 * len(rows)
