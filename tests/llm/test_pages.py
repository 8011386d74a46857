"""Pages with broken and deep markup, and pages whose articles are not marked."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.llm import sitestyle

from ..conftest import SF


@pytest.mark.parametrize(
    "source,text",
    [
        ("<a " * 350_000, ("<a " * 350_000).strip()), ("<a <a <a \"" * 100_000 + "'>", None), ('<a ">"' * 150_000 + "'", None), ("<a" * 400_000 + " '>", None), ("<" * 1_000_000 + ">", None),
        ("<script" * 150_000, None), ("</b " * 250_000, None), ("<!-- " * 200_000, ""), ("<div>" * 100_000 + "x", "x"), ("<b>" * 100_000 + "<p>x</p>" * 50_000, None),
        ("<div>" * 50_000 + "</section></i>" * 50_000 + "y", "y"), ("<b>" * 50_000 + "</i>" * 100_000 + "z", "z"), ("<p>a" + " " * 1_000_000 + "b", "a b"),
    ],
)
def test_a_page_takes_time_in_its_length(source, text):
    start = time.time()
    page = sitestyle.Page(source)
    found = page.main_text()
    assert time.time() - start < 10
    if text is not None:
        assert found == text


def test_broken_tags_are_text():
    assert sitestyle.Page("a < b <e").main_text() == "a < b <e"
    assert sitestyle.Page('a <i title="1>2">c</i> <b "x>y</b').main_text() == 'a c <b "x>y</b'
    assert sitestyle.Page("<p title='a>b' x=\"'\">in</p><p>out").main_text() == "in\nout"
    assert sitestyle.Page("x<!-- <p>n</p> -->y<?php z ?>w<!DOCTYPE q>v</ >u").main_text() == "xywvu"


def test_paths_are_told_apart_at_any_depth():
    page = sitestyle.Page("<div><div class='a'>x</div><div class='b'>y</div><div><div class='a'>z</div></div></div>")
    assert len({b[0] for b in page.blocks}) == 3
    again = sitestyle.Page("<div><div class='a'>other</div></div>")
    assert again.blocks[0][0] == page.blocks[0][0] and page.paths[page.blocks[2][0]][1] == 3


def test_articles_that_no_tag_marks(spark):
    """With <article> renamed to <div> the tree has to find what the mark had told: most of the text, and little else."""
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    marked = {r.page_id: r.text.split("\n") for r in sitestyle.extract_main_text(pages).collect()}
    renamed = pages.withColumn("html", F.regexp_replace("html", r"(?i)(</?)(article|main)\b", "$1div"))
    found = {r.page_id: r.text.split("\n") for r in sitestyle.extract_main_text(renamed).collect()}
    kept = sum(len(b) for i, blocks in marked.items() for b in blocks if b in found[i])
    recall = kept / sum(len(b) for blocks in marked.values() for b in blocks)
    precision = sum(len(b) for i, blocks in found.items() for b in blocks if b in marked[i]) / sum(len(b) for blocks in found.values() for b in blocks)
    print(recall, precision)
    assert recall >= 0.9 and precision >= 0.9


def test_extraction_of_broken_pages(spark):
    rng = random.Random(1)
    bits = ["<div>", "</div>", "<p>", "<article>", "</article>", "<b", "'", '"', ">", "text ", "<!--", "-->", "<script>", "</script>", "&amp;", "</", "<li class=a1>"]
    rows = [(k, f"http://h{k % 3}.example/", "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for k in range(120)] + [(200, None, "<div>" * 20_000 + "deep")]
    out = {r.page_id: r.text for r in sitestyle.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == 121 and out[200] == "deep"
