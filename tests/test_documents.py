"""Pages, cleaning, sections and chunks on small composed texts."""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.arrays import scan
from corpusloom.functions.text import (
    explode_lines,
    heading_level,
    heading_title,
    split_lines,
    strip,
    with_lines,
)
from corpusloom.operators.chunking import (
    ChunkOptions,
    body_budget,
    chunk_markdown,
    chunk_sweep,
    section_prefix,
    split_sections,
)
from corpusloom.operators.cleaning import CleanOptions, clean_markdown
from corpusloom.operators.html import decode_named, decode_numeric, page_blocks, page_markdown
from corpusloom.plans.build import chunk_corpus, extract_pages
from corpusloom.settings import Settings
from corpusloom.sources.pages import (
    extraction_gate,
    incremental_extract,
    scan_html_files,
    slug_collisions,
    source_slug,
)

GARDEN = """# Plants for Dry Gardens

Have a question? [Write to us](https://garden.example/contact)

Join the [Garden List](https://garden.example/list_(all).html)

-

## Lavender

### <sub>3</sub>)

#### Watering

Lavender needs little water once it has roots [[4](https://garden.example#n4)].
It stores what it gets and so survives weeks of heat without any rain
at all [[4](https://garden.example#n4),[5](https://garden.example#n5)].

#### Pruning

Cut lavender back after it has flowered, but never into the old wood.

## References

1. A book nobody should find.
"""

NAMELESS = (
    "### \n\nSedum is a plant of dry walls.\n\n"
    "#### Watering\n\nSedum has been watered for two years in this trial.\n\n"
    "### \n\nThyme, also known as garden thyme, is a herb.\n\n"
    "### \n\n#### Watering\n\nNothing here names the heading above.\n"
)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, markdown string")


def cleaned(spark, text, **options):
    return clean_markdown(docs(spark, text), CleanOptions(**options)).head().markdown


def test_cleaning_keeps_prose_and_drops_the_rest(spark):
    text = cleaned(spark, GARDEN)
    for gone in ("https://", "Write to us", "Garden List", "[4]", "<sub>", "nobody", "3)"):
        assert gone not in text
    assert "Lavender needs little water once it has roots." in text
    assert text.startswith("# Plants") and text.endswith("wood.\n")


def test_options_switch_steps_off(spark):
    assert "https://garden.example/contact" in cleaned(spark, GARDEN, strip_links=False)
    assert "Write to us" in cleaned(spark, GARDEN, drop_boilerplate=False)
    assert "nobody should find" in cleaned(spark, GARDEN, drop_sections=())
    assert "at all [4,5]." in cleaned(spark, GARDEN, strip_citations=False)
    assert "### Sedum" not in cleaned(spark, NAMELESS, name_empty_headings=False)


def test_every_document_survives_cleaning(spark):
    result = clean_markdown(docs(spark, "", "## References\nall of it", "text"))
    assert {r.doc_id: r.markdown for r in result.collect()} == {0: "\n", 1: "\n", 2: "text\n"}


def test_empty_headings_are_named_after_what_follows(spark):
    text = cleaned(spark, NAMELESS)
    third = [line for line in text.splitlines() if line.startswith("### ")]
    assert third == ["### Sedum", "### Thyme"]
    chunks = chunk_markdown(docs(spark, text), ChunkOptions(300, 40, 40))
    assert "Sedum > Watering" in {r.section for r in chunks.collect()}


def test_nested_drop_section_ends_at_its_level(spark):
    text = "## References\na\n### \nb\n#### Disclaimer\nc\n### More\nd\n## Next\ne\n# Disclaimer:\nf\n"
    assert cleaned(spark, text) == "## Next\ne\n"


def test_headings_take_six_marks_at_most(spark):
    rows = spark.createDataFrame(
        [("###x",), ("####### y",), ("## z ##",), ("#######",), ("no # z",), ("  # t",)], "s string"
    )
    found = rows.select(heading_level(F.col("s")), heading_title(F.col("s"))).collect()
    assert [tuple(r) for r in found] == [
        (3, "x"), (6, "# y"), (2, "z"), (6, ""), (0, ""), (1, "t")
    ]


@pytest.mark.parametrize(
    "text", ["", "a", "a\n", "a\r\nb\r\n", "\n", "a\n\n", "a\x0bb\x85c d\x1ce", " \xa0x　\n"]
)
def test_lines_and_blanks_follow_python(spark, text):
    row = spark.createDataFrame([(text,)], "s string").select(
        split_lines(F.col("s")).alias("lines"), strip(F.col("s")).alias("stripped")
    )
    assert row.head().lines == text.splitlines()
    assert row.head().stripped == text.strip()


def test_lines_of_an_empty_document_keep_the_document(spark):
    assert explode_lines(with_lines(docs(spark, "", None, "x"))).count() == 3


def test_chunks_fit_and_carry_their_headings(spark):
    chunks = chunk_markdown(clean_markdown(docs(spark, GARDEN)), ChunkOptions(300, 50, 60))
    rows = sorted(chunks.collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(r.size == len(r.text) <= 300 for r in rows)
    assert any("Lavender > Watering" in r.text for r in rows)
    assert all(len(r.text.split("\n\n", 1)[-1].strip()) >= 20 for r in rows)


def test_chunk_ids_are_stable_and_made_of_content(spark):
    chunk = lambda: chunk_markdown(clean_markdown(docs(spark, GARDEN, NAMELESS)), ChunkOptions(400, 40))
    first, second = chunk().collect(), chunk().collect()
    assert {(r.doc_id, r.chunk_id) for r in first} == {(r.doc_id, r.chunk_id) for r in second}
    assert len({(r.doc_id, r.chunk_id) for r in first}) == len(first)
    for r in first:
        digest = hashlib.sha1(r.text.encode()).hexdigest()[:8]
        assert r.chunk_id == f"c{r.chunk_index:04d}-{digest}"


def test_long_paths_lose_their_outer_titles(spark):
    text = "# T\ntop\n## " + "a" * 50 + "\n### " + "b" * 50 + "\n#### c\nbody\n"
    sections = {r.body: r.section for r in split_sections(docs(spark, text)).collect()}
    assert sections == {"top": "T", "body": "b" * 50 + " > c"}
    wide = split_sections(docs(spark, text), 10).collect()
    assert {r.section for r in wide} == {"T", "c"}


def test_prefix_never_crowds_out_the_body(spark):
    row = spark.createDataFrame([("word " * 30,)], "s string")
    prefix = section_prefix(F.col("s"), 120)
    found = row.select(prefix.alias("p"), body_budget(120, prefix).alias("b")).head()
    assert found.p.endswith("…\n\n") and len(found.p) <= 42
    assert found.b == 120 - len(found.p)
    assert row.select(section_prefix(F.col("s"), 120, False).alias("p")).head().p == ""


def test_one_giant_document_among_small_ones(spark):
    """A third of all text in one document: chunks stay dense and in order."""
    giant = "\n".join(f"## Part {i}\n\n" + f"word{i} " * 150 for i in range(200))
    chunks = chunk_corpus(docs(spark, giant, *["## S\n\n" + "small text " * 20] * 50)).cache()
    big = sorted(chunks.filter("doc_id = 0").collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in big] == list(range(len(big)))
    parts = [int(r.section.split()[1]) for r in big]
    assert parts == sorted(parts) and set(parts) == set(range(200))
    assert chunks.filter("doc_id > 0").count() == 50


def test_nothing_is_shuffled_from_documents_to_chunks(spark, tmp_path):
    docs(spark, GARDEN).write.parquet(f"{tmp_path}/docs")
    given = spark.read.parquet(f"{tmp_path}/docs")
    sweep = chunk_sweep(clean_markdown(given), [Settings(chunk_size=200), Settings()])
    for made in (chunk_corpus(given), sweep):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_filters_on_results_do_not_repeat_the_work(spark, tmp_path):
    docs(spark, GARDEN).write.parquet(f"{tmp_path}/docs")
    pages(spark, (1, "http://g.example/", PAGE)).write.parquet(f"{tmp_path}/pages")
    for made in (
        clean_markdown(spark.read.parquet(f"{tmp_path}/docs")),
        page_markdown(spark.read.parquet(f"{tmp_path}/pages")),
    ):
        plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
        rewrites = plan(made).count("regexp_replace")
        assert plan(made.filter("markdown <> 'x'")).count("regexp_replace") == rewrites


def test_rows_that_share_an_id_stay_apart(spark):
    given = spark.createDataFrame([(1, GARDEN), (1, NAMELESS), (1, None)], "doc_id long, markdown string")
    apart = clean_markdown(docs(spark, GARDEN, NAMELESS, None))
    together = clean_markdown(given)
    assert sorted(r.markdown for r in together.collect()) == sorted(r.markdown for r in apart.collect())
    texts = lambda df: sorted((r.chunk_id, r.text) for r in chunk_markdown(df).collect())
    assert texts(together) == texts(apart)


def test_states_run_across_runs(spark):
    rows = spark.range(5).selectExpr("id", "sequence(1L, id * 256 + id % 2) AS v").withColumn(
        "v", F.when(F.col("id") == 0, F.array().cast("array<bigint>")).otherwise(F.col("v"))
    )
    sums = rows.select("v", scan(F.col("v"), F.lit(0).cast("long"), lambda s, x: s + x).alias("s"))
    for r in sums.collect():
        assert r.s == list(accumulate(r.v))


def test_sweep_equals_separate_runs(spark):
    configs = [Settings(chunk_size=200, chunk_overlap=40), Settings(prepend_section=False)]
    clean = clean_markdown(docs(spark, GARDEN, NAMELESS))
    swept = {(r.config_key, r.doc_id, r.chunk_id) for r in chunk_sweep(clean, configs).collect()}
    apart = {
        (s.config_key, r.doc_id, r.chunk_id)
        for s in configs
        for r in chunk_markdown(clean, ChunkOptions.of(s)).collect()
    }
    assert swept == apart


PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body>
<nav><a href="/n">menu</a></nav><!-- no --><div class="ad">buy</div>
<article><h2>Soil &amp; sand</h2><p>See <a href="/s">the   soil</a>&nbsp;now &#8364;5 &amp;lt;</p>
<ul><li>one<li>two</ul><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table>
</article><footer>&copy; us</footer></body></html>"""


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_page_to_markdown(spark):
    text = page_markdown(pages(spark, (1, "u", PAGE))).head().markdown
    assert text.split("\n\n") == [
        "## Soil & sand", "See [the soil](/s) now €5 &lt;", "- one", "- two",
        "| k | v |\n| --- | --- |\n| 1 | 2 |",
    ]
    kinds = [r.kind for r in page_blocks(pages(spark, (1, "u", PAGE))).orderBy("pos").collect()]
    assert kinds == ["heading", "text", "item", "item", "row", "rule", "row"]
    with_nav = page_markdown(pages(spark, (1, "u", PAGE)), keep_nav=True).head().markdown
    assert "[menu](/n)" in with_nav and "buy" not in with_nav


def test_entities(spark):
    row = spark.createDataFrame([("&lt;a&gt; &#233;&#128512; &quot;",)], "s string")
    text = row.select(decode_numeric(decode_named(F.col("s"))).alias("t")).head().t
    assert text == '<a> é😀 "'


def test_references_that_are_no_characters_stay(spark):
    given = "&#9999999; &#55357; &#0; &#x41;&#X1f600; &#x110000;"
    row = spark.createDataFrame([(given,)], "s string")
    text = row.select(decode_numeric(F.col("s")).alias("t")).head().t
    assert text == "&#9999999; &#55357; &#0; A😀 &#x110000;"


def test_links_are_resolved(spark):
    url = "https://h.example/a/b.html?p=$1#top"
    links = {
        "/s": "https://h.example/s",
        "//other.example/x": "https://other.example/x",
        "http://full.example/": "http://full.example/",
        "mailto:a@b.example": "mailto:a@b.example",
        "c.html": "https://h.example/a/c.html",
        "./c": "https://h.example/a/c",
        "../c?d=/../e": "https://h.example/c?d=/../e",
        "x/y/../../../../../../../z/./": "https://h.example/z/",
        "/a/b/c/d/e/f/../../../../../x.html": "https://h.example/a/x.html",
        "/a/b/..": "https://h.example/a/",
        "": "",
        "#f": "https://h.example/a/b.html?p=$1#f",
        "?q=1": "https://h.example/a/b.html?q=1",
    }
    written = [f'<a class=x href="{a}">t</a>' for a in links]
    written += ["<a href='/s'>t</a>", "<a href=/s>t</a>", "<a href = /s >t</a>"]
    html = "<p>" + "</p><p>".join(written) + "</p>"
    found = page_markdown(pages(spark, (1, url, html), (2, None, '<a href="/s">t</a>'))).collect()
    markdown = {r.page_id: r.markdown.split("\n\n") for r in found}
    assert markdown[1] == [f"[t]({a})" for a in [*links.values(), *["https://h.example/s"] * 3]]
    assert markdown[2] == ["[t](/s)"]


def test_tables(spark):
    def table(*rows):
        return "<table class=x>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"

    html = (
        "<p>before</p>"
        + table("<th>a</th><th>b|c</th>", "<td><p>1</p><p>2</p></td><td><a href='/s'>x</a></td>", "<td></td><td>3")
        + table("<td>other")
        + "<table><caption>Named</caption><tbody><tr><td>k<tr><td>v</table>"
        + "<table></table>after"
    )
    text = page_markdown(pages(spark, (1, "http://h.example/", html))).head().markdown
    assert text.split("\n\n") == [
        "before",
        "| a | b\\|c |\n| --- | --- |\n| 1 2 | [x](http://h.example/s) |\n|  | 3 |",
        "| other |\n| --- |",
        "Named",
        "| k |\n| --- |\n| v |",
        "after",
    ]


def test_links_and_tables_cost_one_pass_each(spark, tmp_path):
    """The plan stays small: no rewrite is repeated within another."""
    pages(spark, (1, "u", PAGE)).write.parquet(f"{tmp_path}/pages")
    plan = page_markdown(spark.read.parquet(f"{tmp_path}/pages"))._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("regexp_replace") < 60


def test_gate_sets_aside_what_lost_its_content(spark):
    rows = spark.createDataFrame(
        [(1, "x" * 1000), (2, "x" * 999), (3, ""), (4, None)], "page_id long, markdown string"
    )
    gated = {r.page_id: (r.accepted, r.reason) for r in extraction_gate(rows).collect()}
    assert gated == {
        1: (True, ""), 2: (False, "too short"), 3: (False, "empty"), 4: (False, "empty")
    }
    kept = extract_pages(pages(spark, (1, "u", PAGE)), Settings(min_extract_chars=20))
    assert [r.doc_id for r in kept.collect()] == [1]
    assert extract_pages(pages(spark, (1, "u", PAGE))).count() == 0


def test_slugs(spark):
    urls = {
        "http://a.example/Soil_and%20Sand.html": "soil-and-20sand",
        "http://a.example/x/": "x",
        "saved/Page.v2.htm": "page-v2",
        "http://a.example/???": "source",
        "/": "source",
        "http://a.example/" + "ab " * 40: ("ab-" * 40)[:60],
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    found = {r.url: r.slug for r in rows.withColumn("slug", source_slug(F.col("url"))).collect()}
    assert found == urls
    same = pages(spark, (1, "a/x.html", ""), (2, "b/x.htm", ""), (3, "c", ""))
    assert [(r.slug, r.sources) for r in slug_collisions(same).collect()] == [("x", 2)]


def test_only_new_pages_are_extracted(spark):
    done = spark.createDataFrame(
        [(1, "x", "kept")], "page_id long, slug string, markdown string"
    )
    rows = pages(
        spark, (1, "a/x.html", PAGE), (2, "a/y.html", PAGE), (3, "b/y.html", "<p>other</p>")
    )
    found = {r.page_id: (r.slug, r.markdown) for r in incremental_extract(rows, done).collect()}
    assert found[1] == ("x", "kept") and found[3] == ("y", "other")
    assert found[2][0] == "y" and "Soil & sand" in found[2][1]


def test_html_files(spark, tmp_path):
    (tmp_path / "one.html").write_text(PAGE, encoding="utf-8")
    row = scan_html_files(spark, str(tmp_path)).head()
    assert row.html == PAGE and row.url.endswith("one.html")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_html_files(spark, f"{tmp_path}/none").head()
