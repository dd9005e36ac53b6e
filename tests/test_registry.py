"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import SMALL, entry, oracle_sql, queries
from check_oracles import compare, connect
from corpusloom.registry.fixtures import md_corpus

QUERIES, SQL = queries(), oracle_sql()
REWRITES = (
    "unescape_brackets unwrap_links strip_bare_urls strip_html_tags strip_citations "
    "collapse_asterisks tidy_punctuation clean_markdown"
).split()


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", [name for name in QUERIES if name in SQL])
def test_query_equals_its_sql(spark, db, name):
    rows, notes = compare(spark, db, SMALL, QUERIES[name], SQL[name])
    assert not notes
    assert rows > 0


@pytest.mark.parametrize("name", REWRITES)
def test_rewrites_change_every_document(spark, name):
    """No check is empty: each rewrite has something to do in the composed corpus."""
    before = md_corpus(spark, SMALL).withColumnRenamed("markdown", "before")
    after = QUERIES[name](spark, SMALL)
    assert before.join(after, "doc_id").filter("before = markdown").count() == 0


def test_entry(spark):
    hits = entry(spark)
    assert hits.count() > 0 and "similarity" in hits.columns
