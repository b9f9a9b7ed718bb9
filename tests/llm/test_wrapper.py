"""Main text of pages against a plain reading of the article, hand-made sites and plain tree matching."""

import random
from functools import lru_cache
from html.parser import HTMLParser

from tavolo.llm import markup, wrapper
from tavolo.sources import Tables

BREAKS = {"h1", "p", "br"}


class Article(HTMLParser):
    """The text inside ``article``, white space single, blocks joined by a blank."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.out += " " * (tag in BREAKS)

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.out += " " * (tag in BREAKS)

    def handle_data(self, data):
        if self.inside:
            self.out.append(data)


def article(html):
    p = Article()
    p.feed(html or "")
    p.close()
    return " ".join("".join(p.out).split())


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, node int")


def found(df):
    out = {}
    for r in df.collect():
        assert r.n_chars == len(r.text)
        out.setdefault(r.page_id, []).append(r.text)
    return out


def test_given_pages_equal_a_plain_reading(spark, small_dir):
    df = Tables(spark, small_dir).pages
    want = {r.page_id: [article(r.html)] for r in df.collect()}
    assert found(wrapper.main_text(df)) == want


def site(i, words, marked=True):
    body = [f"<p>{words(30)}</p>" for _ in range(1 + i % 4)]
    if i % 3 == 0:
        body.insert(1, "<p class='notice'>We use cookies.</p>")
    body.append("<div><p>Thank you for reading our paper.</p></div>")
    title = f"<h1>{words(5)}</h1>"
    text = " ".join([title] + [b for b in body if "notice" not in b and "Thank" not in b])
    main = (f"<article>{title}{''.join(body)}<section class='comments'><p>{words(9)}</p></section></article>" if marked
            else f"<div class='c{i}'>{title}{''.join(body)}</div>")
    html = (f"<html><head><title>{words(3)}</title><style>p{{}}</style></head><body class='has-sidebar'>"
            f"<header><p>{words(4)}</p></header><nav><ul><li><a href='/{i}'>{words(2)}</a></ul></nav>"
            f"<div id='banner-top'><p>{words(6)}</p></div><div class=wrap>{main}"
            f"<div class='links'><ul>{''.join(f'<li><a href=x>{words(2)}</a>' for _ in range(4))}</ul></div></div>"
            f"<aside>{words(8)}</aside><form><label>{words(2)}</label><input value='a>b'></form>"
            f"<script>var x = '<p>no</p>';</script><div><p>Fixed imprint of the site.</p></div>"
            f"<footer>&copy; {words(3)}</footer></body></html>")
    return html, " ".join(text.replace("<p>", "").replace("</p>", "").replace("<h1>", "").replace("</h1>", "").split())


def test_template_and_page_parts_are_left_out(spark):
    rnd = random.Random(11)

    def words(n):
        return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))

    rows, want = [], {}
    for i in range(12):
        for k, marked in enumerate((True, False)):
            html, text = site(i, words, marked)
            rows.append((2 * i + k, f"https://{'marked' if marked else 'Plain'}.example.org/{i}", html))
            want[2 * i + k] = [text]
    assert found(wrapper.main_text(pages(spark, rows))) == want


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, None, None), (2, "no host", ""), (3, "http://a.b/1", "plain &amp; text &ltwith no markup"),
            (4, "http://a.b/2", "<article>a<b>b</b>c<br>d &nbsp; e<p>f<p>g</article>"),
            (5, "http://a.b/3", "<article><p>cut off &amp; <a href='x"),
            (6, "http://a.b/4", f"<article>{deep}</article>"),
            (7, "http://a.b/5", "<article><h1>T</h1><!-- no --><p>x < y &lt;p&gt; <script>if (a<b) {}</script>z</article>"),
            (8, "http://a.b/6", "<nav>only a menu</nav>"),
            (None, "http://a.b/7", "<article><p>no id</p></article>"),
            (9, "http://c.d/1", "<article>" + "<p>word</p>" * 50_000 + "</article>"),
            (10, "http://c.d/2", "<article>" + "<b title=\"<" * 20_000 + "</article>"),
            (11, "http://c.d/3", "<div <a <a" * 20_000)]
    rows += [rows[3]] * 3
    got = found(wrapper.main_text(pages(spark, rows)))
    assert got[1] == got[2] == [""] and got[8] == [""] and got[11] == [""] and got[10] == [""]
    assert got[3] == ["plain & text <with no markup"]
    assert got[4] == ["abc d e f g"] * 4
    assert got[5] == ["cut off &"]
    assert got[6] == ["deep text"]
    assert got[7] == ["T x < y <p> z"]
    assert got[None] == ["no id"]
    assert got[9] == [" ".join(["word"] * 50_000)]
    assert wrapper.main_text(pages(spark, rows).where("false")).collect() == []


def test_equal_pages_are_no_evidence_of_a_template(spark):
    html = "<body><div><h1>Same</h1><p>One text on many addresses.</p></div></body>"
    rows = [(i, f"http://same.net/{i}", html) for i in range(40)]
    assert found(wrapper.main_text(pages(spark, rows))) == {i: ["Same One text on many addresses."] for i in range(40)}


def test_many_trees_merge_in_rounds(spark):
    rnd = random.Random(2)
    kinds = ["section", "div", "blockquote", "ul", "table", "figure", "details", "center"]
    rows, want = [], {}
    for i in range(300):
        inner = "".join(f"<{k}>t{i} {k} {rnd.random()}</{k}>" for k in rnd.sample(kinds, rnd.randrange(1, 6)))
        rows.append((i, f"http://many.net/{i}", f"<body><article>{inner}</article><footer>f{i}</footer></body>"))
        want[i] = [" ".join(inner.replace("><", "> <").replace(">", "> ").replace("<", " <").split())]
        want[i] = [" ".join(w for w in want[i][0].split() if "<" not in w)]
    assert found(wrapper.main_text(pages(spark, rows))) == want


def random_tree(rnd, depth):
    t = wrapper.Tree(rnd.choice("abc"))
    if depth:
        t.kids = [random_tree(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return t


def test_matching_equals_the_plain_recursion():
    def plain(a, b):
        if a.label != b.label:
            return 0

        @lru_cache(None)
        def best(i, j):
            if i == len(a.kids) or j == len(b.kids):
                return 0
            return max(best(i + 1, j), best(i, j + 1), plain(a.kids[i], b.kids[j]) + best(i + 1, j + 1))
        return 1 + best(0, 0)

    rnd = random.Random(4)
    for _ in range(300):
        a, b = random_tree(rnd, 3), random_tree(rnd, 3)
        b.label = a.label
        found_ = wrapper.match(a, b)
        assert len(found_) == plain(a, b) and len({id(x) for x in found_.values()}) == len(found_)
        assert all(x.label == y.label for x, y in found_.items())


def test_a_wrapper_holds_its_trees():
    rnd = random.Random(6)
    trees = [wrapper.skeleton_of(random_tree(rnd, 3))[0] for _ in range(40)]
    trees = ["-1 root" + t[t.index("\n"):] if "\n" in t else "-1 root" for t in trees]
    whole = wrapper.merge_all(trees)
    assert whole == wrapper.merge_all(trees[::-1])
    for t in trees:
        assert wrapper.slots(t, whole)[0] == 0


def test_reading_follows_the_standard():
    def read(html):
        return " ".join("".join(t for _, t, _ in markup.read_page(html).pieces).split())
    assert read("<p>a<b>b<p>c</b>d") == "ab cd"
    assert read("<ul><li>a<li>b<ul><li>c</ul></ul>d") == "a b c d"
    assert read("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert read("a<!-- x > -- >b-->c<!-->d<?php x?>e</ x>f") == "acdef"
    assert read("<a title='>'>x</a><a title=it's>y</a>") == "xy"
    assert read("<title>no</title><textarea><p>no</textarea><style>no</STYLE >yes") == "yes"
    assert read("1 < 2 &lt; 3 <3") == "1 < 2 < 3 <3"
