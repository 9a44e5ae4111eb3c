"""Main text of pages: templates with furniture, markup that browsers forgive, and the wrappers' algebra."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import words
from tidewave.llm import html_extract as E
from tidewave.llm import html_tree as H


def paragraphs(rng):
    return [words(rng, rng.randint(12, 60)).capitalize() + "." for _ in range(rng.randint(1, 7))]


def semantic(rng, ps, title):
    return (
        f"<html><head><title>{title}</title><script>var x='<p>no</p>';</script></head><body class='has-sidebar'><header><h1>Site</h1><nav><ul>"
        + "".join(f"<li><a href='/{i}'>{words(rng, 2)}</a></li>" for i in range(rng.randint(2, 6)))
        + f"</ul></nav></header><div role='alert'>We use cookies {words(rng, 3)}</div><main><article><header><h1>{title}</h1></header>"
        + "".join(f"<p>{p}</p>" + ("<aside>buy this</aside>" if rng.random() < 0.2 else "") for p in ps)
        + f"<form><label>Mail</label><input><button>Go</button></form><section id='comments'><h2>Comments</h2><article class='comment'><p>{words(rng, 30)}</p></article></section>"
        + f"</article><div class='related-posts'><p>{words(rng, 20)}</p></div></main><footer><p>{words(rng, 30)}</p></footer></body></html>"
    )


def by_class(rng, ps, title):
    return (
        f"<body><div id=top-nav><a href=/a>Home</a> <a href=/b>{words(rng, 1)}</a></div><div class='cookie-notice'>{words(rng, 12)}</div>"
        f"<div class='layout with-sidebar'><div class='post-content'><h1>{title}</h1>" + "".join(f"<p>{p}" for p in ps) + "<div class='share'>Tell others</div></div>"
        f"<div class='sidebar'><h3>Popular</h3><ul>" + "".join(f"<li><a href='#'>{words(rng, 4)}</a>" for _ in range(4)) + f"</ul></div></div>"
        f"<div class='ad-slot'>{words(rng, 25)}</div><div class='comments'><p>{words(rng, 40)}</p></div><div id='footer'>{words(rng, 9)}</div>"
    )


def bare(rng, ps, title):
    return (
        f"<table><tr><td><a href='/x'>Start</a><br><a href='/y'>{words(rng, 2)}</a><td><div><h2>{title}</h2>" + "".join(f"<div>{p}</div>" for p in ps) + "</div></table>"
        "<div><a href='/imprint'>Imprint</a> <a href='/terms'>Terms of use of this site</a></div>"
    )


@pytest.mark.parametrize("group", [2, 48])
def test_templates_with_furniture(spark, group):
    rng = random.Random(6)
    rows, want = [], {}
    for k, (host, make) in enumerate([("semantic.example.com", semantic), ("class.example.com", by_class), ("bare.example.com", bare)]):
        for i in range(40):
            ps, title = paragraphs(rng), words(rng, 4)
            rows.append((100 * k + i, f"http://{host.upper()}/p/{i}", make(rng, ps, title)))
            want[100 * k + i] = "\n".join([title, *ps])
    rows.append((900, "http://alone.example.com/", semantic(rng, ["One page on its host."], "Title")))
    want[900] = "Title\nOne page on its host."
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("text", F.lit("y")).withColumn("wrapper", F.lit(1))
    got = {r["page_id"]: r["text"] for r in E.extract(pages.repartition(5), group).collect()}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_repeated_furniture_goes_and_copies_stay(spark):
    rng = random.Random(7)
    page = lambda ps: "<article>" + "".join(f"<p>{p}</p>" for p in ps) + "<p><i>x</i></p><h6>Write to the editors.</h6></article><footer>f</footer>"
    copied = paragraphs(rng)
    texts = [(i, "a", paragraphs(rng)) for i in range(12)] + [(20 + i, "copies", copied) for i in range(12)]
    rows = [(i, f"https://{h}/x", page(ps)) for i, h, ps in texts]
    got = {r["page_id"]: r["text"] for r in E.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, h, ps in texts:
        # On host a the closing line is the same on every page; where all pages are copies nothing tells it from the text.
        assert got[i] == "\n".join([*ps, "x"] if h == "a" else [*ps, "x", "Write to the editors."])


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    long = "<article>" + "<p>" + "word " * 200_000 + "</p></article>"
    rows = [
        (1, None, None), (2, "nohost", ""), (3, "http://h/", "   "), (4, "http://h/1", "just words &amp; more&nbsp;words"), (5, "http://h/2", deep), (6, "http://h/3", long),
        (7, "http://q/", "<article><p>a<b>b<br>c<p>d &lt;tag&gt; &#233;&eacute; &am</article>"), (8, "http://q/", "<article><p>cut <a href='x"), (8, "http://q/", "<article><p>cut <a href='x"),
        (9, "http://q/", "<p>a < b and <3 hearts</p>"), (10, "http://q/", "<article><!-- <p>no</p> --><p>yes</p><script>if (a<b) '</p>'</script><style>p{}</style><![CDATA[raw <x>]]></article>"),
        (11, "http://q/", "<ARTICLE><UL><LI>one<LI>two<UL><LI>three</UL></UL><TABLE><TR><TD>l<TD>r</TABLE></ARTICLE>"), (12, "http://q/", "<article><p hidden>h</p><p style='display: none'>n</p><p>\n s\t p \n</p></article>"),
        (13, "http://q/", "</p></div><article>x</article>"), (14, "http://q/", "<article><p>see <span class='ad'>buy <b>now</b></span>this</p></article>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = E.extract(pages)
    got = {r["page_id"]: r["text"] for r in found.collect()}
    assert found.count() == len(rows)
    assert got == {
        1: "", 2: "", 3: "", 4: "just words & more words", 5: "deep text", 6: ("word " * 200_000).strip(), 7: "ab c\nd <tag> éé &am", 8: "cut", 9: "a < b and <3 hearts",
        10: "yes\nraw <x>", 11: "one\ntwo\nthree\nl\nr", 12: "s p", 13: "x", 14: "see this",
    }
    assert E.extract(pages.limit(0)).count() == 0


def test_wrappers_are_union_free_expressions():
    tree = lambda s: H.Page(s).skeleton()
    assert H.expression(tree("<ul><li>a<li>b<li>c</ul>")) == "(<ul>(<li>#</>)+</>)"
    assert H.expression(tree("<dl><dt>a<dd>b<dt>c<dd>d</dl>")) == "(<dl>((<dt>#</><dd>#</>))+</>)"
    a, b = tree("<div><h1>t</h1><p>x</p></div>"), tree("<div><h1>t</h1><blockquote>q</blockquote><p>x</p><p>y</p></div>")
    assert H.expression(["", "1", H.align(a[2], b[2]), None]) == "(<div><h1>#</>(<blockquote>#</>)?(<p>#</>)+</>)"


def test_alignment_holds_every_page():
    # Whatever is aligned, every leaf of every page has its mate in the wrapper.
    rng = random.Random(3)
    parts = ["<p>x</p>", "<h2>t</h2>", "<ul><li>a<li>b</ul>", "<blockquote><p>q</p></blockquote>", "<div class='fig'><p>c</p></div>", "<table><tr><td>1<td>2</table>"]
    skeletons = [H.Page("<article>" + "".join(rng.choices(parts, k=rng.randint(0, 9))) + "</article>").skeleton() for _ in range(60)]
    wrapper = skeletons[0]
    for s in skeletons[1:]:
        wrapper = ["", "1", H.align(wrapper[2], s[2]), None]
    signs = lambda node: {node[0]} | {x for c in node[2] for x in signs(c)}
    assert signs(wrapper) == set().union(*map(signs, skeletons))


@pytest.mark.parametrize(
    ("sign", "hard"),
    [
        ("div.cookiebar", True), ("ul.topmenu", True), ("div.commentlist", True), ("div.commentary", False), ("div.adventure", False), ("div.content", False), ("p.lead", False), ("div.mainmenu.wide", True),
        ("section@search", True), ("!p", True), ("div.footnotes", False), ("div.pagefooter", True), ("aside", True), ("article", False), ("div.canvas", False),
    ],
)
def test_names_of_furniture(sign, hard):
    assert H.hard(sign) is hard


def test_compound_names_around_and_inside_an_article():
    page = (
        "<div class='pageheader'>Site</div><div class='contentWithSidebar'><div class='mainmenu'><a href=a>Home</a></div><div class='storyBody'><h1>T</h1><p>One longer paragraph of the story.</p>"
        "<div class='shareThis'>Tell</div><p>Another longer paragraph of the story.</p></div><div class='commentlist'><p>Nice story, says a reader at some length here.</p></div></div><div id='sitefooter'>c</div>"
    )
    assert E.page_text(page, None) == "T\nOne longer paragraph of the story.\nAnother longer paragraph of the story."
