import pytest
from pyspark.sql import functions as F

from veilsight.operators import articles as A
from veilsight.operators import links as L
from veilsight.sources.feeds import feed_links
from veilsight.sources.pages import flatten


def pages(spark, *htmls, url="https://example.com/"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def texts(spark, *htmls, **kw):
    rows = A.article_text(flatten(pages(spark, *htmls)), **kw).orderBy("page_id").collect()
    return [(r["text"], r["status"]) for r in rows]


LONG = "Ferries to the northern islands run twice a day until the ice sets in."


def test_article_page(spark):
    page = f"<body><p>before</p><div class='x articlebody'><h2>Timetable</h2>skipped<p>{LONG}</p><script>var n = 1</script></div><p>after</p></body>"
    assert texts(spark, page) == [(f"Timetable\n{LONG}", "ok")]


def test_containers_and_fallbacks(spark):
    got = texts(
        spark,
        "<html><body><article></article></body></html>",
        f"<body><article><p>x</p></article><div id=article-content><p>{LONG}</p></div></body>",
        f"<body><main><p>{LONG} main</p></main><article><p>{LONG} art</p></article></body>",
        f"<body><div class='my-Post'><p>{LONG}</p></div><div class='news big'><p>{LONG} more</p></div></body>",
        f"<body><nav>menu</nav><p>a</p>{LONG}<script>no</script></body>",
        f"<body><article><p>{LONG}</p><div class='cf note-b'><p>no</p></div><div class='cf'><p>yes</p></div>"
        "<nav><p>no</p></nav><p class=ad>no</p></article></body>",
        f"<article><ul><li>one <p>{LONG}</p></li></ul><!-- c -->x<p>a<!-- c -->b<p>c</article>",
        None,
    )
    assert got == [
        (None, "no_text"),
        (LONG, "ok"),
        (f"{LONG} art", "ok"),
        (f"{LONG} more", "ok"),
        (f"menu\na\n{LONG}", "ok"),
        (f"{LONG}\nyes", "ok"),
        (f"one {LONG}\n{LONG}\na b c\nc", "ok"),
        (None, "no_text"),
    ]


def test_nested_blocks_once(spark):
    page = f"<article><ul><li>one <p>{LONG}</p></li></ul></article>"
    assert texts(spark, page, dedupe_nested=True) == [(f"one {LONG}", "ok")]


def test_batch_keeps_failures(spark):
    urls = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "article_idx int, url string")
    found = spark.createDataFrame([("a", "A"), ("b", None), ("c", "C")], "url string, text string")
    rows = A.article_batch(urls, found).orderBy("article_idx").collect()
    assert [(r["article_idx"], r["text"]) for r in rows] == [(0, "A"), (1, None), (2, "C")]


def test_batch_query_gives_every_address_and_its_text(spark, tmp_path):
    from veilsight.plans.queries import QUERIES

    stored = [(1, "https://e.com/a", f"<article><p>{LONG} old</p></article>"), (3, "https://e.com/a", f"<article><p>{LONG} new</p></article>"),
              (2, "https://e.com/a", f"<article><p>{LONG} mid</p></article>"), (4, "https://e.com/b", "<p>short</p>"),
              (5, "https://e.com/c", f"<article><p>{LONG}</p></article>"), (6, "https://e.com/c", None), (7, None, f"<body>{LONG}</body>")]
    spark.createDataFrame(stored, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    docs = spark.createDataFrame([(8, "post", "web"), (9, None, "web")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["article_batch"](spark, str(tmp_path))
    assert rows.columns == ["article_idx", "url", "text"]
    assert {(r["url"], r["text"]) for r in rows.collect()} == {
        ("https://e.com/a", f"{LONG} new"), ("https://e.com/b", None), ("https://e.com/c", None), (None, None),
        ("https://web.example.com/post/8", None), ("https://web.example.com/post/9", None)}
    assert rows.count() == 6 and rows.filter("url like '%/post/%'").agg(F.sum("article_idx")).first()[0] == 17


def test_listing_page(spark):
    link = lambda path: f"<a href='{path}'>ferry report of the day</a>"
    html = f"{link('/2024/top/a.html')}<article>{link('/2024/ferry/b.html')}<p>{link('/2024/ferry/c.html')}</p>{link('/tickets/2024/d.html')}</article>"
    got = L.article_links(flatten(pages(spark, html)), keywords=("/tickets/",))
    assert sorted(r["url"] for r in got.collect()) == ["https://example.com/2024/ferry/b.html", "https://example.com/2024/ferry/c.html"]


def test_link_rules(spark):
    html = """<body><a href="">a b c d</a><a href=" # ">a b c d</a><a href="/">a b c d</a>
      <a href="https://other.com/x/y.html">a b c d</a><a href="/x/y.html#f">a b c d</a><a href="/x/y.html#">one two three <b>four</b></a>
      <a href="/2024/05/z">x y z</a><a href="mailto:a@b.c">a b c d</a><a href="/hotel:1/a/b.html">a b c d</a><a href="/p/q/"> </a>
      <a name=n>a b c d</a><a href="/Search/a.html">a b c d</a><a href="?q=1">a b c d</a></body>"""
    rows = L.scored_links(flatten(pages(spark, html))).collect()
    assert sorted((r["url"], r["score"]) for r in rows) == [
        ("https://example.com/2024/05/z", 4), ("https://example.com/?q=1", 2), ("https://example.com/x/y.html", 3)]


def test_story_link_blocks_the_fallback(spark):
    html = "<body><a class='story-link' href='/a/b/c.html'>a b c d</a></body>"
    assert L.page_anchors(flatten(pages(spark, html))).count() == 0
    assert L.page_anchors(flatten(pages(spark, html)), all_anchors=True).count() == 1


def test_rescan(spark):
    links = spark.createDataFrame([("new",), ("old",), ("recent",), ("unknown",)], "url string")
    history = spark.createDataFrame([("old", "2024-01-21"), ("recent", "2024-01-30"), ("unknown", None)], "url string, d string")
    history = history.select("url", F.col("d").cast("timestamp").alias("last_scanned"))
    due = L.due_links(links, history, F.lit("2024-01-31 00:00:00"))
    assert sorted(r["url"] for r in due.collect()) == ["new", "old"]
    known, new = L.split_known(links, history)
    assert (known.count(), new.count()) == (3, 1)


def test_feeds_win_over_pages(spark):
    rss = "<rss><channel><title>t</title><item><link>https://e.com/1</link></item><item><link> https://e.com/2 </link></item><item><title>x</title></item></channel></rss>"
    atom = "<feed><entry><link rel='self' href='https://e.com/s'/><link href='https://e.com/3'/></entry></feed>"
    feeds = spark.createDataFrame([("s1", rss), ("s2", atom), ("s3", "<html><body>x</body></html>"), ("s4", "<rss><channel/></rss>")],
                                  "source_url string, body string")
    links = feed_links(feeds)
    assert sorted((r["source_url"], r["url"]) for r in links.collect()) == [
        ("s1", "https://e.com/1"), ("s1", "https://e.com/2"), ("s2", "https://e.com/3")]
    html = spark.createDataFrame([("s1", "h1"), ("s3", "h3")], "source_url string, url string")
    assert sorted(r["url"] for r in L.links_of_sources(links, html).collect()) == [
        "h3", "https://e.com/1", "https://e.com/2", "https://e.com/3"]


def random_pages(n, seed):
    import random

    rng = random.Random(seed)
    tags = ["div", "p", "article", "main", "section", "ul", "li", "h1", "table", "tr", "td", "nav", "b", "a", "pre", "code",
            "form", "header", "span", "body", "br", "img"]
    attrs = ["", "", "", " class='ad'", " class='content x'", " id='main'", " class='article-body'", " class='cf note-b'",
             " href='/x'", " id='my-Post'", " class='tags'", " class=posts", " class='story-link'"]
    words = ["lorem", "ipsum dolor", "  ", "\n", "&amp;", "é", "a &lt; b", "<!-- c -->", "<script>var t='</p>';</script>",
             "<style>p{}</style>", "<template>t <p>u</p></template>", "long words to pass the gate of fifty characters"]
    out = []
    for _ in range(n):
        parts = [rng.choice(["", "<body>", "<body><article><p>", "<div class='post-body'><ul>", "<section id=news><p>"])]
        for _ in range(rng.randrange(1, 40)):
            kind = rng.random()
            tag = rng.choice(tags)
            parts.append(f"<{tag}{rng.choice(attrs)}>" if kind < 0.4 else f"</{tag}>" if kind < 0.6 else rng.choice(words))
        out.append("".join(parts))
    return out


def test_random_and_given_pages_equal_tree_walk(spark, sf_dir):
    from brute_force_pages import expected_anchors, expected_article

    given = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    htmls = random_pages(400, 5) + given
    flat = flatten(pages(spark, *htmls)).cache()
    got = {r["page_id"]: r["text"] for r in A.article_text(flat, min_chars=5).collect()}
    for i, html in enumerate(htmls):
        assert got[i] == expected_article(html, 5), html[:2000]
    anchors = {}
    for r in L.page_anchors(flat).collect():
        anchors.setdefault(r["page_id"], []).append((r["href"], r["link_text"]))
    for i, html in enumerate(htmls):
        assert sorted(anchors.get(i, [])) == expected_anchors(html), html[:2000]
    assert sum(v is not None for v in got.values()) > 100


def test_code_reaches_workers_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from veilsight.session import local_session
from veilsight.sources.pages import flatten
spark = local_session("elsewhere", 1)
print("NODES", flatten(spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string")).selectExpr("size(nodes)").first()[0])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "NODES 1" in done.stdout, done.stderr[-2000:]
