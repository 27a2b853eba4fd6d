import html as entities
import random
import re
import time

import pytest

from keyloom.llm import page_wrappers as pw


@pytest.mark.parametrize("tag", ["div", "article", "ul><li", "table><tr><td", "section"])
def test_deep_nesting(tag):
    page = "<body>" + f"<{tag}>" * 100_000 + "deep" + "<p>below</p><div class=ad>gone</div>" + "</div>" * 50_000 + "end"
    start = time.time()
    assert pw.main_text(page, None).split("\n") == ["deep", "below", "end"]
    assert time.time() - start < 20


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '", "<", "</", "<!--", "<script>", "<a href='x", "<p class=", "<!", "<div><p", "a<b "])
@pytest.mark.parametrize("end", ["", ">", "\">", "'>", "</p>x"])
def test_unclosed_markup_takes_one_pass(piece, end):
    start = time.time()
    pw.main_text("<body><p>First</p>" + piece * (1_000_000 // len(piece)) + end, None)
    assert time.time() - start < 20


@pytest.mark.parametrize("page,want", [
    ('<article class="post no-comments"><p>Kept</article>', "Kept"), ('<div class="content-with-sidebar"><p>Kept</div>', "Kept"),
    ('<form id="aspnetForm"><h1>A</h1><p>Kept</p><input></form>', "A\nKept"), ('<a href=#c>Skip</a><form><div><p>Long kept text of the page</p></div></form>', "Long kept text of the page"),
    ("<p>Let <math><mi>x</mi></math> be <xmp><b> & &amp;</xmp> so", "Let x be <b> & &amp; so"), ('<div class="has-sidebar"><p>Kept</div><div class="left-sidebar">Gone</div>', "Kept"),
    ('<main class="layout-sidebar"><p>Kept</main>', "Kept"), ('<p>Text enough to hold more than half</p><form><p>Sign up</p></form>', "Text enough to hold more than half"),
    ('<article><p>Short</article><div class="comments-area"><p>' + "long " * 200 + "</div>", "Short"), ('<div class="post-12 ad-slot">Gone</div><p>Kept much longer</p>', "Kept much longer"),
    ("<nav>Only</nav>", ""), ('<article class="comment">Gone</article><p>Kept', "Kept"), ("a < b and c > d <3", "a < b and c > d <3"), ("x <a title=\"1 > 0\">y</a> z", "x y z"),
    ('<p>one<p>two<div>three</div>four<br>five', "one\ntwo\nthree\nfour five")])
def test_no_article_is_lost(page, want):
    assert pw.main_text(f"<html><body>{page}</body></html>", None) == want


def brute_reader(page):
    """Blocks of well-formed pages made below: every element is closed and named in full."""
    out, pieces, skip, at = [], [], [], 0
    for m in re.finditer(r"<(/?)(\w+)([^>]*)>|([^<]+)", page):
        if m[4] is not None:
            if not skip:
                pieces.append(m[4])
            continue
        block = m[2] in pw.BLOCKS
        if block:
            out.append(" ".join(entities.unescape("".join(pieces)).split()))
            pieces = []
        if m[1]:
            if skip and skip[-1] == at:
                skip.pop()
            at -= 1
        else:
            at += 1
            if m[2] in ("nav", "aside", "footer", "script") or "class=ad" in m[3] or "id=comments" in m[3]:
                skip.append(at)
    return "\n".join(b for b in out if b)


def made(r, depth=0):
    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.random()
        if kind < .4 or depth > 5:
            out.append(r.choice(["some words ", "A &amp; B ", "x&nbsp;y\n", "<b>bold</b> text ", " "]))
        else:
            tag, attributes = r.choice([("div", ""), ("section", ' class=story'), ("blockquote", ""), ("div", " class=ad"), ("nav", ""), ("aside", ""), ("ul", ""), ("h2", ""), ("div", " id=comments")])
            out.append(f"<{tag}{attributes}>{made(r, depth + 1)}</{tag}>")
    return "".join(out)


def test_equals_a_brute_force_reader():
    r = random.Random(11)
    for _ in range(400):
        page = f"<html><body><article>{made(r)}</article><footer>Foot</footer></body></html>"
        assert pw.main_text(page, None) == brute_reader(page), page


def test_wrappers_stay_bounded():
    pages = [pw.expression(pw.parse("".join(f'<div class="c{i}x{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}"><p>t{k}</div>' for k in range(1500)))) for i in range(2)]
    both = pw.align(*pages)
    assert len(both[4]) <= pw.WIDEST
    same = pw.align(*[pw.expression(pw.parse(f'<div class="post-{i}"><p>t{i}</div>')) for i in (1, 22)])
    assert [c[0] for c in same[4]] == ["div.post-0"]


def test_many_hosts_take_the_join(spark, monkeypatch):
    rows = [(i, f"https://h{i % 7}.example/{i}", f"<nav>n</nav><div class=story><p>Text {i} of its own</div>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, pw.main_texts(df).collect()))
    monkeypatch.setattr(pw, "FEW_HOSTS", 3)
    assert sorted(map(str, pw.main_texts(df).collect())) == want and len(want) == 60
