import html
import random
import re
import time
from collections import Counter

import pytest

from countspark.llm import queries, wrapper


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def run(spark, pages):
    """The text of each page of a list of (url, html)."""
    rows = [(k, u, h, "clash", 1) for k, (u, h) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int").repartition(3)
    got = wrapper.main_text(df).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_pages_against_plain(spark, sf):
    """The articles of the given pages are what regular expressions find in them, too."""

    def plain(page):
        inside = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        return "\n".join(b for b in blocks if b)

    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    got = queries.op11_wrapper(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(want) and {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_template_without_labels(spark):
    """Nothing but sameness and links tells what is template."""
    rng = random.Random(1)
    pages, want = [], []
    for k in range(12):
        ps = [words(rng, 20) for _ in range(rng.randint(1, 5))]
        title = words(rng, 4)
        menu = "".join(f"<a href=/{i}>{words(rng, 1)}</a> " for i in range(5))
        extra = f"<blockquote>{words(rng, 9)}</blockquote>" if k == 3 else ""  # on one page only: no template
        body = f"<div>Welcome to our site</div><div>{menu}</div><div><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in ps)}{extra}<h4>Share this with friends</h4></div><div>All rights reserved 2024</div>"
        pages.append((f"http://plain.example.org/{k}", f"<html><head><title>x</title></head><body>{body}</body></html>"))
        want.append("\n".join([title, *ps, *re.findall("<blockquote>(.*)</blockquote>", extra)]))
    titled = [(u, h.replace("<title>x</title>", f"<title>{k}</title>")) for k, (u, h) in enumerate(pages)]
    assert run(spark, titled) == want


def test_labelled_elements_go(spark):
    rng = random.Random(2)
    odd = [
        "<nav><ul><li><a href=/>{}</a></ul></nav>", "<header class=site-header><h1>{}</h1></header>", "<aside>{}</aside>", "<div class='sidebar-left'><p>{}</p></div>",
        "<div id=cookie-notice>{} <button>OK</button></div>", "<form action=/><p>{}</p><select><option>a<option>b</select></form>", "<div role=complementary>{}</div>",
        "<section id=comments><article class='comment'><p>{}</p></article><article class=comment><h3>x</h3><p>{}</p></article></section>", "<div style='display: none'>{}</div>", "<p hidden>{}</p>",
        "<noscript>{}</noscript>", "<script>document.write('<p>{}</p>')</script>", "<style>p > a {{content: '{}'}}</style>", "<!-- <p>{}</p> -->", "<div class=newsletterBox>{}</div>",
        "<div class='breadcrumbs'>{}</div>", "<svg><text>{}</text></svg>", "<textarea><p>{}</p></textarea>", "<ol class=commentlist><li>{}</li></ol>", "<footer>{}</footer>",
    ]
    pages, want = [], []
    for k in range(9):
        title, a, b, c = (words(rng, n) for n in (4, 15, 12, 9))
        junk = [o.replace("{}", words(rng, 6)).replace("{{", "{").replace("}}", "}") for o in odd]
        article = f"<article class='post has-sidebar'><header><h1>{title}</h1></header>{junk[10]}<p>{a} <span class=ad>{words(rng, 3)}</span><em>{b}</em>{junk[4]}<ul><li>{c}<li>{b}</ul>{junk[14]}{junk[11]}{junk[19]}</article>"
        before, after = junk[: k + 4], junk[k + 4 :]
        pages.append((f"https://news{k % 2}.example.com:80/{k}", f"<!DOCTYPE html><body class='no-sidebar'><div class='page-with-sidebar'>{''.join(before)}{article}{''.join(after)}</div>"))
        want.append(f"{title}\n{a} {b}\n{c}\n{b}")
    assert run(spark, pages) == want


def test_copies_of_one_article_are_no_template(spark):
    rng = random.Random(3)
    text = [words(rng, 30) for _ in range(4)]
    page = "<body><nav>{}</nav><article><h1>Same title</h1>" + "".join(f"<p>{t}</p>" for t in text) + "</article><div class=ad>{}</div></body>"
    pages = [(f"http://copies.example.org/{k}", page.format(k, words(rng, 5))) for k in range(40)]
    bare = [(f"http://bare.example.org/{k}", f"<div>{text[0]}</div><ul><li>{text[1]}</ul>") for k in range(7)]
    assert run(spark, pages + bare) == ["\n".join(["Same title", *text])] * 40 + ["\n".join(text[:2])] * 7


def test_odd_pages(spark):
    long = "word &amp; more " * 40_000
    pages = [
        (None, None), ("", ""), ("http://a.example.org", "no markup,  two\n words &amp;&eacute;&#x1F600;&nosuch; x &lt;p&gt;"), ("not a url", "<p>a<p>b</p>c</div></p>d"),
        ("http://b.example.org/1", "<b><p>one</b> two</p>three <i>four"), ("http://b.example.org/2", "<p title='a > b' data-x=\"<p>\">x</p><a <b>y</b></a> 1 < 2 <3 & z"), ("http://c.example.org", "<!-- open <p>gone"),
        ("http://c.example.org/2", "<table><tr><td>1<td>2<tr><td>3</table><pre>a\n  b</pre>x<br>y<hr>z"), ("http://c.example.org/3", "<script>never closed <p>gone"),
        ("http://d.example.org/deep", "<div>" * 20_000 + "deep" + "</div>" * 20_000 + "after"), ("http://d.example.org/long", f"<p>{long}</p>" + "<ul>" * 5_000 + "</b>" * 5_000),
        ("http://d.example.org/wide", "".join(f"<div class=c{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'xyz'[k % 3]}><i>{k}</i></div>" for k in range(3_000))), ("http://e.example.org", "<a <a <a " * 20_000 + "<p \"" * 20_000),
    ]
    began = time.time()
    got = run(spark, pages + pages)
    assert time.time() - began < 120 and got[: len(pages)] == got[len(pages) :]  # repeated rows
    want = ["", "", "no markup, two words &é😀&nosuch; x <p>", "a\nb\nc\nd", "one two\nthree four", "x\ny 1 < 2 <3 & z", "", "1\n2\n3\na b\nx y\nz", "", "deep\nafter", html.unescape(long).strip(), "\n".join(map(str, range(3_000)))]
    assert [(g[:80], w[:80]) for g, w in zip(got, want) if g != w] == [] and got[12].startswith("<a <a <a <a")


def test_empty_table(spark):
    assert wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    one, other = (Counter(map(tuple, wrapper.induce(p).collect())) for p in (pages.coalesce(1), pages.repartition(7)))
    assert one == other and len(one) > 20


def test_matching_against_plain():
    """Simple tree matching by its recursion without tables of siblings."""

    def plain(a, b):
        if not a or not b:
            return 0
        both = 1 + plain(a[0][-1], b[0][-1]) + plain(a[1:], b[1:]) if a[0][0] == b[0][0] else 0
        return max(both, plain(a[1:], b), plain(a, b[1:]))

    rng = random.Random(5)

    def tree(depth):
        return [[rng.choice("xyz"), tree(depth - 1)] for _ in range(rng.randint(0, 3))] if depth else []

    for _ in range(300):
        a, b = tree(3), tree(3)
        size, pairs = wrapper.matching(a, b)
        assert size == plain(a, b) == sum(1 + wrapper.matching(a[i][-1], b[j][-1])[0] for i, j in pairs)
        assert all(a[i][0] == b[j][0] for i, j in pairs) and pairs == sorted(set(pairs))


def test_merged_templates_hold_both():
    node = lambda label, *children: [label, 1, 5, 5, 1, 1, 3, 0, list(children)]
    got = wrapper.merged(node("html", node("nav"), node("p")), node("html", node("nav"), node("h1"), node("p"), node("footer")))
    assert [c[0] for c in got[-1]] == ["nav", "h1", "p", "footer"] and [c[1] for c in got[-1]] == [2, 1, 2, 1]
    wide = node("html", *(node(f"div.{k}") for k in range(wrapper.WIDE)))
    assert len(wrapper.merged(wide, node("html", *(node(f"div.z{k}") for k in range(300))))[-1]) == wrapper.WIDE
