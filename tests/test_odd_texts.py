"""Queries against their DuckDB twins on texts that the given tables lack: empty, blank, null and with marks of the formats they pass through."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import summary as SM
from corpusflow.plans import catalogue
from corpusflow.sources import jsondocs

LONG = "Some words of a text that goes on for long enough to be counted as one, with more words in it, and more, and yet more of them here. "
TEXTS = (
    "", "    ", "\n\t \n", " " * 600, None, "a\x01b " + LONG, "\x01", "a\x00b", " " + LONG + " ", " ", "x </script> y " + LONG, "<b></b>", "```{}``` " + LONG,
    "{} " + LONG + " }", "<tldr>in</tldr> " + LONG, '"q" \\ \\n ' + LONG, "." + " " * 600, "plain",
)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A table of every text under 28 ids each, so that all remainders of the fixtures meet it."""
    folder = tmp_path_factory.mktemp("odd")
    texts = [t for t in TEXTS for _ in range(28)]
    n = len(texts)
    rows = {"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["src1"] * n, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(rows), folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["fn25_summary_parse", "fn26_json_ld"])
def test_odd_texts(name, spark, odd):
    df = catalogue.queries()[name](spark, odd)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{os.path.join(odd, 'documents.parquet')}')")
    result = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_blank_articles_of_summaries(spark):
    parse = lambda raw: spark.createDataFrame([(raw,)], "v string").select(SM.parse_output(F.col("v"), ["AI"]).alias("x")).first().x
    got = parse('{"tldr": "t", "hot_score": 3, "tags": ["ai"], "editorial_markdown": " "}')
    assert (got.tldr, got.hot_score, got.tags, got.structured, got.usable, got.editorial_markdown) == ("", 3, ["AI"], True, False, "")
    got = parse('{"tldr": "t", "editorial_markdown": "", "editorialMarkdown": "second name"}')
    assert (got.tldr, got.structured, got.editorial_markdown) == ("t", True, "second name")
    got = parse("<tldr>t</tldr>text with {} in it")
    assert (got.tldr, got.structured, got.editorial_markdown) == ("t", False, "text with {} in it")


def test_blank_bodies_of_pages(spark):
    page = '<script type="application/ld+json">[{"articleBody": " ", "headline": "\u00a0kept\u00a0"}, {"articleBody": "x", "headline": "with a body"}, {"headline": "none"}]</script>'
    pages = [(1, page), (2, page.replace('"x"', '""')), (3, page.replace("articleBody", "other"))]
    got = jsondocs.json_ld_articles(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert {r.page_id: (r.body, r.title) for r in got} == {1: ("x", "with a body"), 2: ("", "kept")}
