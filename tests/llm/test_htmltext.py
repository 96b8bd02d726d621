import random
import re
from html import unescape

import pytest

from tessera.llm import htmltext


def body(x):
    return f"<html><head><title>T &amp; t</title><style>p{{}}</style><script>if (a<b) '</p>'</script></head><body>{x}</body></html>"


CASES = [
    (body("<nav><ul><li>Menu</li></ul></nav><article><h1>Head</h1><p>One&nbsp;&amp; <b>two</b>\n three<br>four<p>five</article><footer>f</footer>"),
     "Head One & two three four five"),
    (body('<header>site</header><main><p>in main</p><aside>side</aside><form>f <input name="x"></form></main>'), "in main"),
    (body('<article><p>a</p><section id="comments"><article class="comment"><p>no</p></article></section><p>b</p></article>'), "a b"),
    (body('<article><div class="cookie-notice">cookies</div><p title="a > b">x &lt;tag&gt; y</p><!-- <p>c</p> --></article>'), "x <tag> y"),
    (body("<article>in<em>line</em> w<b>or</b>d</article><div role='navigation'>n</div>"), "inline word"),
    (body("<article><p>unclosed <b>b<p>next</p>"), "unclosed b next"),
    (body("<p>no article here 1 &lt; 2</p>"), "no article here 1 < 2"),
    (body('<article><noscript>n</noscript><button>b</button><svg><text>t</text></svg><p>1 < 2 and <3</p></article>'), "1 < 2 and <3"),
    (body('<div class="ad">buy</div><div class="heading sad">kept text</div>'), "kept text"),
    (body('<div class="content no-sidebar"><p>menu</p><article><h1>H</h1><p>text</p></article></div><p>rest</p>'), "H text"),
    (body('<div id="page-with-sidebar"><main><p>in main</p><div class="ad">buy</div></main></div>'), "in main"),
    (body('<form action="/"><nav>n</nav><article>all of it</article><footer>f</footer></form>'), "all of it"),
    (body('<div class="ad">buy <article><p>after an open ad</p></article>'), "after an open ad"),
    (body('<nav><ul><li>m</ul><article>after an open menu</article>'), "after an open menu"),
    (body('<article>first</article><div class="ad">buy<article>second</article>'), "first second"),
    (body('<article>text</article><div class="related"><article>teaser</article></div>'), "text"),
    (body('<p>text</p><aside><article>in an aside</article></aside>'), "text in an aside"),
    (body('<div class="comments"><article>no</article></div><p>text</p>'), "text"),
    (body('<aside><div id="comments"><article>no</article></div></aside><p>text</p>'), "text"),
    (body('<main><div class="content no-sidebar"><p>a text of its own that the page</p><p>has nowhere else</p></div></main>'),
     "a text of its own that the page has nowhere else"),
    (body('<div class="no-sidebar">a text of its own that the page has nowhere else<div class="ad">buy</div></div>'),
     "a text of its own that the page has nowhere else"),
    (body('<div class="content no-sidebar">a text of its own that the page has nowhere else</div>'),
     "a text of its own that the page has nowhere else"),
    (body('<article class="post comments-open"><p>a text</p></article>'), "a text"),
    (body('<article id="reply-to-critics"><p>a text</p></article>'), "a text"),
    (body('<main class="has-comments"><p>a text</p></main>'), "a text"),
    (body('<div class="post no-comments"><article><p>a text</p></article></div>'), "a text"),
    (body('<div class="comments-layout"><p>menu</p><article><p>a text</p></article></div>'), "a text"),
    (body('<main><div class="post no-comments"><article><p>a text</p></article></div></main>'), "a text"),
    (body('<article>a text</article><div class="comment-section"><article class="comment-body">no</article><p>no</p></div>'), "a text"),
    (body('<main><article>a text</article><div class="comments-area"><article class="comment-body">no</article></div></main>'), "a text"),
    (body('<article>a text<div class="comment-list"><article class="comment-body">no</article><p>no</p></div></article>'), "a text"),
    (body('<article>a text</article><ol id="comment-list"><li class="comment"><article class="comment-body">no</article></li></ol>'), "a text"),
    (body('<article>a text</article><article class="comment">no</article>'), "a text"),
    ("", ""), (None, ""), ("<", "<"), ('<p class="', ""), ("plain text &eacute;", "plain text é"),
]


def test_zones_and_blocks():
    for page, want in CASES:
        s = htmltext.Streams(["http://h/"], [page])
        assert s.texts(s.key[:0]) == [want], page


def test_named_containers_are_judged_by_the_runs_of_the_host():
    menu = "one menu of ten words that every page has again"
    pages = [body(f'<div class="no-sidebar"><ul class="menu"><li>{menu}</li></ul><p>p{k} has a text of its own number {k}</p></div>')
             for k in range(3)]
    s = htmltext.Streams(["http://h/"] * 3, pages)
    key, low, high = s.distinct()
    assert s.texts(key[low != high]) == [f"p{k} has a text of its own number {k}" for k in range(3)]


def test_hosts():
    for url, want in [("https://User@Blog.Example.com:80/x", "blog.example.com"), ("//a.b/c", "//a.b/c".split("/")[0]),
                      (None, ""), ("", ""), ("a.b?x#y", "a.b")]:
        assert htmltext.host_of(url) == want


def brute(rows):
    """Unmarked pages: tokens in runs that start in two different streams of the host go."""
    streams = [(htmltext.host_of(u), tuple(t.split())) for u, t in rows]
    out = []
    for host, words in streams:
        others = {w for h, w in streams if h == host and w != words}
        grams = {w[k:k + 8] for w in others for k in range(len(w) - 7)}
        gone = [False] * len(words)
        for k in range(len(words) - 7):
            if words[k:k + 8] in grams:
                gone[k:k + 8] = [True] * 8
        out.append(" ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("parts", [1, 9])
def test_repeated_runs_of_a_host_go_and_unique_runs_stay(spark, parts):
    rnd = random.Random(parts)
    words = lambda n: " ".join("w%d" % rnd.randrange(500) for _ in range(n))
    menu = {h: words(15) for h in "abc"}
    rows = []
    for _ in range(60):
        h = rnd.choice("aaabc")
        rows.append((f"http://{h}.x/p", f"{menu[h][:rnd.choice([40, 200])]} {words(rnd.randint(0, 30))} {menu[h]}".strip()))
    rows += [rows[0], rows[1], ("http://a.x/", ""), (None, words(20)), ("http://d.x/", menu["a"])]
    df = spark.createDataFrame([(i, u, f"<div>{t}</div>", "old", 7) for i, (u, t) in enumerate(rows)],
                               "page_id long, url string, html string, text string, chunk int").repartition(parts)
    got = htmltext.extract(df)
    assert got.columns == ["page_id", "url", "chunk", "text"]
    by = {r.page_id: r.text for r in got.collect()}
    assert [by[i] for i in range(len(rows))] == brute(rows)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_articles_of_the_pages_table_come_out_whole(spark, sf):
    from tessera.llm.queries import QUERIES

    src = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op6_html_extraction"](spark, sf).collect()
    assert len(rows) == len(src)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", src[r.page_id], re.S).group(1)
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", inside)).split())
        assert r.text == want and r.n_chars == len(want)
