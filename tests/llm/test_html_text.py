"""Main text of pages: all pages of a table against a plain reading of their one template, then other templates and broken markup."""

import html
import re

import pytest
from tillroll.llm import html_text, queries
from tillroll.llm.html_text import main_text


def plain(source):
    """The article of the test tables' template, by string operations."""
    inside = source[source.index("<article>") + 9 : source.index("</article>")]
    blocks = re.split("</?(?:p|h1)>", inside)
    texts = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_all_pages(spark, small):
    rows = {r["page_id"]: r for r in queries.op12_html_text(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(rows) == len(pages) > 40
    for page in pages:
        row = rows[page["page_id"]]
        assert row["url"] == page["url"]
        assert row["text"] == plain(page["html"])
        assert row["n_chars"] == len(row["text"])


ARTICLE = "<h2>A title</h2><p>The first paragraph has a sentence, and one more. It is long enough.</p><p>Short.</p><p>The last one, which goes on for a while, ends here; not earlier.</p>"
WANTED = "A title\nThe first paragraph has a sentence, and one more. It is long enough.\nShort.\nThe last one, which goes on for a while, ends here; not earlier."
AROUND = [
    "<body><nav><a href=a>One</a> <a href=b>Two</a></nav><main>{}</main><aside>Popular: this, that.</aside></body>",
    "<body><div id='sidebar-left'><p>A long notice, of many words, that isn't the article at all. Really, it is not.</p></div><div class='post-content'>{}</div></body>",
    "<body><header><h1>My site</h1></header><article>{}<section class='comments'><p>I liked this article, very much so. Thank you, dear author.</p></section></article></body>",
    "<body><article>{}<form><p>Your name, please: <input></p><button>Send</button></form></article><div class='cookieNotice'>We use cookies, as all do.</div></body>",
    "<html><head><title>T</title><style>p {{}}</style></head><body><ul><li><a href=x>Home</a><li><a href=y>About</a></ul><div>{}</div><footer>(c)</footer>",
    "<body><table><tr><td><a href=1>News</a> <a href=2>Sport</a></td></tr></table><div>{}</div><script>document.write('<p>no, not this. Not at all.</p>')</script></body>",
    "<body><div hidden><p>Nobody sees this, ever. It is hidden.</p></div><div role=main>{}</div><div style='display: none'>nor this, at all.</div></body>",
]


@pytest.mark.parametrize("around", AROUND)
def test_templates(around):
    assert main_text(around.format(ARTICLE)) == WANTED


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("<", "<"),
        ("no markup, 1 < 2", "no markup, 1 < 2"),
        ("<p title='a>b'>x", "x"),
        ("<p>a<b>b<p>c</b>d", "ab\ncd"),
        ("<article>caf&eacute; &amp &lt;p&gt; &#x41;&#66; a&nbsp;b", "café & <p> AB a b"),
        ("<article><p>a  b\n c<br>d</p>\t<p> </p>e<!-- f --> g <script>x = '</p>'", "a b c d\ne g"),
        ("<p>cut <a href='", "cut"),
        ("<article><p>see <a href=x>a link, in a text</a></p><p><a href=y>a link alone, in an article.</a></p><p>and text, at its end.</p>", "see a link, in a text\na link alone, in an article.\nand text, at its end."),
    ],
)
def test_broken_markup(source, text):
    assert main_text(source) == text


def test_values_by_loops():
    """The values of paths, from the definition."""
    import math

    paths, chars, marks, links = [5, 7, 7, 5, 9], [10, 80, 40, 6, 30], [1, 6, 2, 0, 0], [0, 0, 10, 6, 30]
    which = sorted(set(paths))
    of = lambda p, x: sum(v for q, v in zip(paths, x, strict=True) if q == p) / paths.count(p)
    fused = dict.fromkeys(which, 0.0)
    for share, x in ((0.7, chars), (0.3, marks)):
        row = [math.log(1 + of(p, x)) for p in paths]
        smooth = []
        for i in range(len(row)):
            near = [(html_text.KERNEL[abs(i - j)], row[j]) for j in range(len(row)) if abs(i - j) <= 2]
            smooth.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
        value = {p: of(p, smooth) for p in which}
        for p in which:
            fused[p] += share * value[p] / max(value.values())
    wanted = [fused[p] * (1 - of(p, links) / max(1, of(p, chars))) for p in which]
    got, own = html_text.path_values(*map(html_text.np.array, (paths, chars, marks, links)))
    assert list(own) == [which.index(p) for p in paths]
    assert got == pytest.approx(wanted)


def test_odd_rows(spark, odd, none, odd_rows):
    rows = html_text.extract(odd, "doc_id", "text", keep=("lang", "label")).collect()
    assert sorted((str(r["page_id"]), r["lang"] or "") for r in rows) == sorted((str(i), lang or "") for i, _, lang in odd_rows)
    long = next(r["text"] for r in rows if r["page_id"] == 6)
    assert len(long) == len(odd_rows[6][1])
    assert {r["text"] for r in rows if r["page_id"] in (2, 3, 4)} == {""}
    assert html_text.extract(none, "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        html_text.extract(odd, "doc_id", "text", keep=("text",))


def test_deep_and_many(spark):
    assert main_text("<div>" * 20000 + "deep") == "deep"
    many = "".join(f"<p>paragraph {i}, with a text.</p>" for i in range(5000))
    assert main_text(f"<article>{many}</article>").count("\n") == 4999
