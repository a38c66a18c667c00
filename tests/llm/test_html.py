"""Markup, repeats of a host and main text, against plain Python."""

import random

from pyspark.sql import functions as F

from beamloom.llm import boilerplate as B
from beamloom.llm.markup import blocks
from tests.llm.data import words


def content(html):
    return B.article_text(html)


def test_a_declared_article_and_nothing_else():
    page = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a>b">A</a></ul></nav><!-- <article>no</article> -->
    <div class='cookie-notice'>We use cookies</div><div id="content"><article class="post"><header><h1>Head&amp;line</h1></header>
    <p>One <b>bold</b>ly&nbsp;put,<br>two&copy &lt;3 &#x41;&#66;.<p>Second<span class="ad">Buy!</span> para</p><div class="adBox">Ad in it</div>
    <ul><li>x<li>y</ul><form><input value=q>Name</form><table><tr><td>a<td>b</table><pre>  l1
    l2 </pre><section id="comments"><article><p>Nice!</p></article></section><footer>by me</footer></article>
    <aside>Side</aside><div class="share">Share</div></div><footer>&copy; me</footer></body></html>"""
    assert content(page) == "Head&line\nOne boldly put, two© <3 AB.\nSecond para\nx\ny\na\nb\nl1 l2"


def test_broken_and_awkward_markup():
    assert content("<article><p>a &am") == "a &am" and content("<article><p>a <stro") == "a" and content('<article>a<p title="x>b') == "a\nb"
    assert content("<main><p><b>a<br><p>b</main>after") == "a\nb" and content("<ARTICLE>A</Article><p>x") == "A"
    assert content("<form id=all><div class=header-wrap><article>in</article>out</div></form>") == "in"
    assert content("<aside><article>no</article></aside>") is None and content("") is None and content("plain") is None
    assert content("<article></article><p>x") == "" and content("<article>1 < 2 <> 3 <3</article>") == "1 < 2 <> 3 <3"
    assert content("<article><script>var a = '<p>x</p>'") == "" and content("<article>a<!-- b <p>c") == "a"
    assert content("<div role=main>m<div class=related><article>t</article></div>n</div>") == "m\nn"
    assert blocks("<nav>n<p>m</nav>o<p class=ads>p<p>q")[0] == [("n", "chrome"), ("m", "chrome"), ("o", "open"), ("p", "chrome"), ("q", "open")]
    assert content("<article><h1>" + "x " * 200_000 + "</h1></article>").count("x") == 200_000
    assert content("<article>" + "<i>é</i> " * 50_000) == ("é " * 50_000).strip()


def plain_repeats(pages):
    """Windows of DEPTH tokens that stand on distinct pages of a host: all of them, kept or not."""
    seen = {}
    for host, html in set(pages):
        s = B.stream(blocks(html)[0])
        for i in range(len(s) - B.DEPTH + 1):
            seen.setdefault((host, tuple(s[i : i + B.DEPTH])), set()).add(html)
    return {k for k, v in seen.items() if len(v) > 1}


MENU = "".join(f"<li><a href='/{i}'>{w}</a></li>" for i, w in enumerate("Home News Sport Money Films Books About us".split()))


def site(n, seed):
    """Pages without a declared article: menu and footer in plain elements, between them what is theirs alone."""
    r = random.Random(seed)
    out, own = [], []
    for i in range(n):
        text = [words(r.randrange(1, 60), 1000 * seed + 10 * i + k) for k in range(r.randrange(1, 4))]
        body = "".join(f"<p>{t}</p>" for t in text)
        tail = "<p>All rights reserved by the owners of this site, who answer no letters at all</p>" if i % 2 else "<p>Printed on paper of the finest kind by hands that never rest a day</p>"
        out.append(f"<body><ul>{MENU}</ul><div>{body}</div>{tail}</body>")
        own.append("\n".join(text))
    return out, own


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("id", "host", "key", "h", "lo", "hi", "hits", "suffixes", "text", "n_chars"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_repeats_go_and_unique_runs_stay(spark):
    pages, own = site(12, 1)
    rows = [(i, "http://A.example/x" if i % 2 else "http://a.example", h) for i, h in enumerate(pages)]
    single = site(1, 2)[0][0]
    rows += [(100, "http://alone.example/", single), (101, "http://alone.example/2", single), (None, None, None), (102, "no host", ""), (103, "http://a.example/", f"<nav>{MENU}</nav><article><p>{own[0]}</p></article>"), (3, "http://a.example", pages[3])]
    for chars in (1, 3000, 10**9):
        got = B.extract(frame(spark, rows), run_chars=chars).collect()
        text = {(r.page_id, r.url): r.text for r in got}
        assert len(got) == len(rows)
        assert [text[(i, u)] for i, u, _ in rows[1:12]] == own[1:]
        assert text[(0, "http://a.example")] == "" or len(own[0].split()) < B.DEPTH + 1  # repeated by page 103, which declares it
        assert text[(103, "http://a.example/")] == own[0].replace("</p><p>", "\n").replace("\n", " ")
        everything = "\n".join(t for t, _ in blocks(single)[0])
        assert text[(100, "http://alone.example/")] == text[(101, "http://alone.example/2")] == everything
        assert text[(None, None)] == "" and text[(102, "no host")] == ""


def test_kept_suffixes_are_the_repeated_ones_whatever_the_runs(spark):
    pages, _ = site(30, 3)
    rows = [(i, f"h{i % 3}", h) for i, h in enumerate(pages)] + [(50, "h0", pages[0]), (51, "h1", pages[0])]
    df = spark.createDataFrame(rows, "id long, host string, html string").withColumn("key", F.xxhash64("html"))
    want = plain_repeats([(host, html) for _, host, html in rows])
    hashes, kept = {}, {}
    for _, host, html in rows:
        s = B.stream(blocks(html)[0])
        r = B.Run([s], [host])
        for start, h in zip(r.starts, r.hash_of(r.starts)):
            hashes[(host, tuple(s[start : start + B.DEPTH]))] = int(h)
            kept.setdefault(int(h), set()).add(html)
    expected = {h for h, on in kept.items() if len(on) > 1}
    assert expected and expected <= {h for k, h in hashes.items() if k in want} and len(set(hashes.values())) == len(hashes)
    for chars in (1, 5000, 10**9):
        assert {r.h for r in B.repeated(df, chars).collect()} == expected


def test_two_equal_stretches_keep_a_common_suffix():
    r = random.Random(5)
    for trial in range(50):
        common = [str(r.randrange(50)) for _ in range(B.DEPTH + B.SPAN - 1)]
        kept = []
        for k in range(2):
            s = [str(r.randrange(100, 10**6)) for _ in range(r.randrange(40))] + common + [str(r.randrange(100, 10**6)) for _ in range(r.randrange(30, 60))]
            run = B.Run([s], ["h"])
            kept.append({tuple(s[i : i + B.DEPTH]) for i in run.starts})
        own = {tuple(common[i : i + B.DEPTH]) for i in range(B.SPAN)}
        assert kept[0] & kept[1] & own


def test_no_pages(spark):
    assert B.extract(frame(spark, [])).count() == 0
    assert [r.text for r in B.extract(frame(spark, [(1, "http://a/", None)])).collect()] == [""]


def test_every_page_passes_the_array(spark, monkeypatch):
    """Declared pages too are judged by the array, whose verdict the declaration then corrects; both ways to look repeats up agree."""
    pages, own = site(8, 7)
    article = "<article><p>" + words(30, 4) + "</p></article>"
    declared = [f"<body><ul>{MENU}</ul>{article}<p>{words(20, 90 + i)}</p></body>" for i in range(2)]
    found = [blocks(h)[0] for h in declared]
    df = spark.createDataFrame([(i, "h", h) for i, h in enumerate(declared)], "id long, host string, html string").withColumn("key", F.xxhash64("html"))
    hits = B.np.sort(B.np.array([r.h for r in B.repeated(df).collect()], B.np.int64))
    # menu items are short: the array joins them to one run; the article is repeated, what follows it is not
    assert [u[-2:] for u in B.unique_blocks(found, ["h", "h"], hits)] == [[False, True], [False, True]]
    assert B.main_texts(declared, ["h", "h"], hits) == [words(30, 4)] * 2
    judged = []
    monkeypatch.setattr(B, "_judged", lambda p, known, old=B._judged: judged.append(p.count()) or old(p, known))
    rows = [(i, "http://a.example", h) for i, h in enumerate(pages + declared)]
    texts = [{r.page_id: r.text for r in B.extract(frame(spark, rows), broadcast=n).collect()} for n in (10**6, 0)]
    assert texts[0] == texts[1] and judged == [len(rows)] * 2
    assert [texts[0][i] for i in range(10)] == own + [words(30, 4)] * 2
