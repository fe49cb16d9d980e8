"""Blocks of a page, the network's gradients, and extraction from pages whose article is known."""

import os
import random

import numpy as np
import pytest

from kartwerk.llm import html_extraction as hx
from kartwerk.llm.html_blocks import Known, blocks
from kartwerk.llm.page_layouts import Layouts

from .helpers import sentence

SCHEMA = "page_id long, url string, html string, text string, n_chars string"
DATA = "/root/testdata/sf0.01/pages.parquet"


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("") == texts("<p> \n</p><!-- a <p>b</p> -->") == []
    assert texts("<p>a <b>b</b>\n&amp; c&nbsp;d<br>e<p>f<div>g</div>h") == ["a b & c d e", "f", "g", "h"]
    assert texts("<script>var t='</p>x';</script>a<style>p{}</style>b<SCRIPT>open") == ["ab"]
    assert texts("</div></p>a<ul><li>b<li>c</ul><td>d") == ["a", "b", "c", "d"]
    assert texts('<p title="a > b">x</p><p title="a>y</p><a href=\'q"\'>z</a> 1 < 2 <') == ["x", "y", "z 1 < 2 <"]
    assert texts("a<![CDATA[b]]>c<!DOCTYPE html><?xml?>d") == ["acd"]
    page = blocks('<body><div class="site-Header relatedPosts" id=Main><p>a<p>b</div><p>c<a>d</a></p>')
    assert page[1].path == [("body", []), ("div", ["site", "header", "related", "post", "main"]), ("p", [])]
    assert [b.linked for b in page] == [0, 0, 1]


def test_gradients():
    pages = [Layouts([], 3).page() for _ in range(3)]
    rows, labels = [hx.Sequence(f, Known()) for f, _ in pages], [y for _, y in pages]
    model, rng = hx.Labeller(1), np.random.default_rng(0)
    model.w = {n: w + rng.normal(0, 0.1, w.shape) for n, w in model.w.items()}
    _, grads = model.gradients(rows, labels)
    for name, w in model.w.items():
        at = np.unravel_index(np.argsort(np.abs(grads[name]), axis=None)[-3:], w.shape)
        for place in zip(*at):
            old, found = w[place], []
            for step in (1e-5, -1e-5):
                w[place] = old + step
                found.append(model.gradients(rows, labels)[0])
            w[place] = old
            assert (found[0] - found[1]) / 2e-5 == pytest.approx(grads[name][place], rel=1e-4, abs=1e-9)


def page(rng, main, extra=True):
    """A page with every kind of boilerplate, and its article."""
    body = [sentence(rng, rng.randrange(12, 60)).capitalize() + "." for _ in range(rng.randrange(3, 8))]
    head = sentence(rng, 5).capitalize()
    line = lambda n=6: sentence(rng, n)
    a, b = main
    before = f"<header><h2>{line(3)}</h2></header><nav><ul><li><a href='/'>{line(1)}</a></li><li><a href='/a'>{line(1)}</a></li></ul></nav><div class='cookie-banner'><p>{line(12)}.</p><button>{line(1)}</button></div><div class='ad'>{line()}</div>"
    after = f"<section class='comments'><h3>{line(1)}</h3><p>{line(20)}.</p><p>{line(30)}.</p></section><aside class='sidebar'><p>{line(15)}</p></aside><form><label>{line(2)}</label><input></form><footer>&copy; {line()}</footer>"
    made = f"{a}<h1>{head}</h1>{''.join(f'<p>{x}</p>' for x in body)}{b}"
    return f"<html><head><title>{head}</title><style>p{{}}</style></head><body>{before if extra else ''}{made}{after if extra else ''}<script>x('</p>')</script></body></html>", [head, *body]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    sample = [page(rng, ("<article>", "</article>"))[0] for _ in range(60)]
    return hx.Labeller(7).fit(hx.training(Layouts(sample, 7)))


def test_layouts_of_other_kinds(model):
    """Exact articles, also in containers that no sampled page has."""
    rng, exact = random.Random(2), 0
    kinds = [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div id='content'><div class='inner'>", "</div></div>"), ("<section class='story-body'>", "</section>")]
    for i in range(60):
        html, want = page(rng, kinds[i % 5])
        exact += hx.labelled([html], model)[0] == want
    assert exact >= 58


def test_extract(spark, model):
    rng = random.Random(3)
    made = [page(rng, ("<article>", "</article>")) for _ in range(8)]
    long = "<html><body><nav><a>x</a></nav><article>" + "".join(f"<p>{sentence(rng, 12)}." for _ in range(30_000)) + "</article></body></html>"
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(made)] + [(3, "again", made[3][0]), (None, None, made[4][0]), (20, "v", None), (21, None, ""), (22, "w", "<nav><a>only</a></nav>"), (23, "x", "<<<>>&#xZ;"), (24, "y", long)]
    df = spark.createDataFrame([(*r, "t", "n") for r in rows], SCHEMA).repartition(3)
    out = hx.extract(df, model).collect()
    assert len(out) == len(rows)
    assert all(r.n_chars == len(r.text) for r in out)
    got = {(r.page_id, r.url): r.text for r in out}
    for i, (_, want) in enumerate(made):
        assert got[i, f"u{i}"] == "\n\n".join(want)
    assert got[3, "again"] == got[3, "u3"] and got[None, None] == got[4, "u4"]
    assert got[20, "v"] == got[21, None] == got[22, "w"] == ""
    assert got[24, "y"].count("\n\n") == 29_999


def test_without_pages(spark, monkeypatch):
    monkeypatch.setattr(hx, "LAYOUTS", 20)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert hx.extract(none, hx.learn(none)).count() == 0


@pytest.mark.skipif(not os.path.isdir(os.path.dirname(DATA)), reason="no test tables")
def test_pages_whose_tags_tell(spark):
    from kartwerk.llm.page_layouts import _labels

    df = spark.read.parquet(DATA)
    got = {r.page_id: r.text for r in hx.extract(df, hx.learn(df)).collect()}
    for r in df.collect():
        found = blocks(r.html)
        assert got[r.page_id] == "\n\n".join(b.text for b, y in zip(found, _labels(found)) if y)
