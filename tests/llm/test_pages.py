import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import html_extract, url_filter

CASES = [
    ("<p>a &lt; b<p>c<br>d</p>", "a < b\nc d"),
    ("<body><nav>m</nav><header>H</header><main><h1>T</h1><p>x <b>y</b>z</p><div class='ad-slot'>buy</div><section id=comments><p>lol</p></section></main><aside>s</aside><footer>f</footer>", "T\nx yz"),
    ("<article><header><h1>T</h1></header><p>a<form>q</form><p>b<article>c</article></article>", "T\na\nb"),
    ("<article>x</article", "x"),
    ("a < b & c", "a < b & c"),
    ("<article title='a>b'>ok&nbsp;&amp&copy;</article>", "ok &©"),
    ("<div hidden>no</div><p>yes", "yes"),
    ("<script>var t='</p><article>no</article>';</script><article><p>in</p></article>", "in"),
    ("<article><!-- <p>no</p> --><ul><li>1<li>2</ul><p>t</p></article><div class=notice>cookies</div>", "1\n2\nt"),
    ("", ""),
    ("<article></article>", ""),
    ("<div class='entry-content'><p>body</p></div><div>rest</div>", "body"),
    ("<main><p>lead-in</p><article><p>story</p></article></main><div class=content>x</div>", "lead-in\nstory"),
    ("<div id='top-menu'>m</div><div class='content'><h1>T</h1><p>body</p><div class='share'>s</div></div><div>rest</div>", "T\nbody"),
    ("<p><b>bold<br><p>next</p>", "bold\nnext"),
    ("<main><h1>T</h1><p>Long story of many words</p><section><article class=card>Teaser</article></section></main>", "T\nLong story of many words\nTeaser"),
    ("<main></main><article> </article><p>open</p>", "open"),
    ("<main><h1>Title</h1><p>Story of forty characters in the main part.</p><article class='card'>A related teaser card of some length</article></main>", "Title\nStory of forty characters in the main part.\nA related teaser card of some length"),
    (f"<main><p>{'word ' * 60}</p><article>{'longerword ' * 20}</article></main>", f"{('word ' * 60).strip()}\n{('longerword ' * 20).strip()}"),
    ("<article><p>a</p><section class='social-history'>b</section><p class='related-work'>c</p><div class='related-posts'>d</div><div id='comments-12'>e</div></article>", "a\nb\nc"),
    ("<div class=content><p>around</p><article>story</article></div>", "story"),
    ("<div class=content>x<main>m</main></div>", "m"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_blocks(html, text):
    assert html_extract.page_text(html) == text


def test_suffix_array_finds_all_shared_windows():
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 3, 400)
    order, rank = html_extract.shared_windows(tokens, 5)
    windows = [tuple(tokens[i : i + 5]) for i in range(len(tokens))]
    for i in range(0, 396, 7):
        for j in range(0, 396, 5):
            assert (rank[i] == rank[j]) == (windows[i] == windows[j])
    assert [windows[i] for i in order] == sorted(windows)


def test_shared_boilerplate_of_open_pages(spark):
    menu = "home news sport weather about contact help login now"
    rows = [(k, "https://h.example/x", f"<div>{menu}</div><div>{k}th story that is told here</div>") for k in range(5)]
    rows += [(9, "https://other.example/", f"<div>{menu}</div><p>only page</p>"), (10, None, f"<div>{menu}</div>"), (11, "https://h.example/", None), (12, "https://h.example/a", f"<article><p>{menu}</p></article>"), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("host", F.lit("x")).withColumn("text", F.lit("t"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.main_text(pages).collect())
    want = sorted([(k, t, len(t)) for k in [0, 0, 1, 2, 3, 4] for t in [f"{k}th story that is told here"]] + [(9, f"{menu}\nonly page", len(menu) + 10), (10, menu, len(menu)), (11, "", 0), (12, menu, len(menu))])
    assert got == want
    assert not html_extract.main_text(pages.limit(0)).count()


def test_pages_without_article_of_several_hosts(spark):
    rng = np.random.default_rng(3)
    pages, want = [], []
    for h in range(3):
        menu, foot = ([f"{x}{h}_{rng.integers(100)}" for _ in range(n)] for x, n in (("m", 25), ("f", 12)))
        for k in range(12):
            body = [f"b{h}_{k}_{i}" for i in range(int(rng.integers(5, 400)))]
            inner = "<script>var a = '<main >'</script><!-- <article> -->" if k % 2 else ""
            pages.append((h * 100 + k, f"https://h{h}.example/{k}", f"{inner}<div>{' '.join(menu)}</div><div>{' '.join(body)}</div><div>{' '.join(foot)}</div>"))
            want.append((h * 100 + k, " ".join(body)))
    got = html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()
    assert sorted((r.page_id, r.text) for r in got) == want


def test_shared_runs_by_brute_force(spark):
    """A token goes exactly if it lies in a substring of SHARED tokens or more that stands on another page of its host."""
    rng = np.random.default_rng(4)
    width = html_extract.SHARED
    texts = [rng.integers(0, 2 + k % 3, 60 + 20 * k) for k in range(12)]
    pages = [(k, f"https://h{k % 2}.example/", " ".join(f"t{x}" for x in t)) for k, t in enumerate(texts)] + [(50, "https://h0.example/", None), (51, "https://h1.example/", "word " * 50_000)]
    want = {50: ""}
    windows = {k: {tuple(t.split(" ")[i : i + width]) for i in range(len(t.split(" ")) - width + 1)} for k, _, t in pages if t and k < 50}
    for k in windows:
        words, gone = pages[k][2].split(" "), set()
        for i in range(len(words) - width + 1):
            if any(tuple(words[i : i + width]) in windows[j] for j in windows if j != k and j % 2 == k % 2):
                gone.update(range(i, i + width))
        want[k] = " ".join(w for i, w in enumerate(words) if i not in gone)
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got.pop(51) == " ".join(["word"] * 50_000)
    assert got == want


def test_suffix_arrays_run_over_pages_with_articles(spark):
    """They used to be skipped for pages whose markup names an article; what it names stays whole, as articles share passages."""
    menu, passage = " ".join(f"m{i}" for i in range(9)), " ".join(f"p{i}" for i in range(12))
    html = lambda k: f"<nav>{menu}</nav><div class=ad>buy {k} now</div><article><p>{passage}</p><p>own {k}</p></article><p>{menu} and {k}</p>"
    rows = [(k, f"https://h{k // 2}.example/{k}", html(k)) for k in range(3)] + [(3, "https://h0.example/m", f"<p>{menu}</p><main>{passage}</main>"), (4, None, html(4))]
    got = {r.page_id: (r.text, r.n_chars, r.n_shared) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = {k: f"{passage}\nown {k}" for k in (0, 1, 2, 4)} | {3: passage}
    # the menu with "buy" after it, and again with "now" before and "and" after it; on page 3 the menu alone
    assert got == {k: (t, len(t), {0: 21, 1: 21, 3: 9}.get(k, 0)) for k, t in want.items()}


def test_url_filter(spark):
    E = "list_name string, domain string, day date, listed int"
    from datetime import date as d

    entries = [("l", "a.com", d(2024, 1, 1), 1), ("l", "a.com", d(2024, 2, 1), 0), ("l", "a.com", d(2024, 3, 1), 1), ("l", "A.com", d(2024, 3, 5), 1), ("m", "x.a.com", d(2024, 1, 10), 1), ("m", "b.com", d(2024, 1, 1), 1), ("m", "b.com", d(2024, 1, 1), 0), ("m", None, d(2024, 1, 1), 1), ("m", "c.com", d(2024, 1, 1), 0)]
    intervals = url_filter.validity(spark.createDataFrame(entries, E))
    assert sorted((r.list_name, r.domain, r.since, r.until) for r in intervals.collect() if r.until) == [("l", "a.com", d(2024, 1, 1), d(2024, 2, 1))]
    rows = [(1, "https://x.a.com/p", d(2024, 1, 20)), (2, "http://u@X.A.com.:80/", d(2024, 2, 15)), (3, "https://a.com", d(2024, 3, 2)), (4, "https://nota.com", d(2024, 1, 20)), (5, None, d(2024, 1, 20)), (6, "mailto:a@a.com", d(2024, 1, 20)), (7, "https://b.com", d(2024, 5, 1)), (8, "https://a.com", None), (3, "https://a.com", d(2024, 3, 2)), (None, "https://a.com", d(2024, 1, 1)), (9, "https://a.com", d(2023, 12, 31))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date").withColumn("domain", F.lit("z")).withColumn("n", F.lit(0))
    for small in (500_000, 0):
        url_filter.SMALL_ROWS = small
        got = sorted(((r.page_id or 0), r.n_active, r.lists, r.blocked) for r in url_filter.evaluate(captures, intervals).collect())
        assert got == [(0, 1, "l", True), (1, 2, "l,m", True), (2, 1, "m", True), (3, 1, "l", True), (3, 1, "l", True), (4, 0, "", False), (5, 0, "", False), (6, 0, "", False), (7, 0, "", False), (8, 0, "", False), (9, 0, "", False)]
    two_days = [(1, "https://b.org/", d(2024, 1, 5)), (1, "https://b.org/", d(2024, 1, 25)), (1, "https://b.org/", None)]
    dated = url_filter.validity(spark.createDataFrame([("l", "b.org", d(2024, 1, 1), 1), ("l", "b.org", d(2024, 1, 10), 0)], E))
    for small, hot in ((500_000, 100_000), (0, 1)):
        url_filter.SMALL_ROWS, url_filter.HOT = small, hot
        got = url_filter.evaluate(spark.createDataFrame(two_days, "page_id long, url string, fetched date"), dated).collect()
        assert sorted((str(r.fetched), r.blocked) for r in got) == [("2024-01-05", True), ("2024-01-25", False), ("None", False)]
    assert not url_filter.evaluate(captures.limit(0), dated).count()
    url_filter.SMALL_ROWS, url_filter.HOT = 500_000, 100_000
    assert url_filter.evaluate(captures, intervals.limit(0)).filter("blocked").count() == 0
