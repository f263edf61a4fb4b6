import random
import time

import pytest

from flowlens.llm import html_extract as h

PAGES = {
    "<!DOCTYPE html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a>Home</a></nav><!-- ad --><div class=\"ad\">Buy</div><article><h1>Head &amp; more</h1><p><b>one\n two<br><p>three&nbsp;four &#233;</p></article><footer>&copy; x</footer>": "Head & more\none two\nthree four é",
    "<body><header>Site</header><main><div class='cookie-notice'>Cookies</div><section><h2>A</h2><p>b<i>c</i> d</p><ul><li>x<li>y</ul></section><section id=comments><p>first!</p></section></main><aside>side</aside>": "A\nbc d\nx\ny",
    "<article><header><h1>T</h1></header><p>body</p><form><p>mail</p></form></article><div role=complementary>x</div>": "T\nbody",
    "": "",
    "<p>plain": "plain",
    "text < 5 & more &am": "text < 5 & more &am",
    "<script>never closed <p>x": "",
    "<article><p>gradient leader</p><div class='reader'>kept</div></article>": "gradient leader\nkept",
}


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        mask = h.shared_lines(a, b)
        kept = [x for x, m in zip(a, mask, strict=True) if m]
        assert len(kept) == lcs(a, b) == lcs(kept, b)


def test_main_text(spark):
    rows = [(i, f"http://h{i}.example/{i}", page, "k") for i, page in enumerate(PAGES)]
    df = spark.createDataFrame([*rows, (99, None, None, "k"), (0, rows[0][1], rows[0][2], "k")], "page_id bigint, url string, html string, key string").repartition(3)
    got = h.main_text(df).collect()
    assert len(got) == len(rows) + 2
    want = {i: text for i, text in enumerate(PAGES.values())} | {99: ""}
    for r in got:
        assert r.main_text == want[r.page_id], r.html
        assert r.key == "k"
    assert h.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_template_lines_go_where_nothing_is_declared(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i, f"https://site.example/{i // 5}/{i:03d}?q={i}", f"<div>Menu</div><div>Top of {i // 5}</div><p>own text {i}</p><div>Contact</div>") for i in range(40)]
        df = spark.createDataFrame([*rows, (100, "https://alone.example/x", "<div>Menu</div><p>own</p>")], "page_id bigint, url string, html string")
        got = {r.page_id: r.main_text for r in h.main_text(df).collect()}
        assert got == {i: f"own text {i}" for i in range(40)} | {100: "Menu\nown"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("parts", [1, 7])
def test_copies_are_no_partners(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        page = "<div>Menu</div><p>own text {}</p><div>Contact</div>".format
        rows = [(i, f"https://site.example/{i // 2}/{i:03d}", page(i)) for i in range(10)]
        rows += [rows[3]] * 3 + [(20 + i, f"https://site.example/2/004{end}", page(4)) for i, end in enumerate(["?utm_source=feed", "#top", "/", "a"])]
        rows += [(30 + i, f"https://copies.example/{i}", page(30)) for i in range(20)] + [(60, "https://copies.example/x", page(60)), (61, "https://copies.example/0", "")]
        rows += [(70 + i, "https://one.example/x", page(70)) for i in range(2)]
        got = h.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert len(got) == len(rows)
        for r in got:
            own = 4 if 20 <= r.page_id < 30 else 30 if 30 <= r.page_id < 60 else r.page_id
            assert r.main_text == ("" if r.page_id == 61 else "Menu\nown text 70\nContact" if r.page_id >= 70 else f"own text {own}"), r
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_markup_does_not_replace_the_alignment(spark):
    page = "<div>Menu</div><div class=body><p>own text {0}</p></div><article><h2>teaser {0}</h2><p>licence</p></article><div>Contact</div>".format
    rows = [(i, f"https://site.example/{i}", page(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.main_text for r in h.main_text(df).collect()} == {i: f"own text {i}\nteaser {i}\nlicence" for i in range(8)}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='has-sidebar'><article><p>text</article><p>more</div>", [(h.MAIN, "text"), (h.OTHER, "more")]),
        ("<div class='page no-sidebar'><main><p>text</main></div>", [(h.MAIN, "text")]),
        ("<div id=modal><p>x<article><p>text</article><p>y</div>", [(h.FURNITURE, "x"), (h.MAIN, "text"), (h.FURNITURE, "y")]),
        ("<div class=widget><div class=sidebar><main>text</main></div></div>", [(h.MAIN, "text")]),
        ("<div class=widget><nav><article>x</article></nav></div>", [(h.FURNITURE, "x")]),
        ("<div id=comments><article class=comment>x</article></div>", [(h.FURNITURE, "x")]),
        ("<main><p>text</p><div class=related><article>x</article></div></main>", [(h.MAIN, "text"), (h.FURNITURE, "x")]),
        ("<p>one <a title='hidden gem' href=/x>two</a> three", [(h.OTHER, "one two three")]),
        ("<div style='overflow:hidden' data-role=menu data-hidden><p>text</div>", [(h.OTHER, "text")]),
        ("<div hidden><article>x</article></div><div title=a class='sidebar'>y</div><p>z", [(h.FURNITURE, "x"), (h.FURNITURE, "y"), (h.OTHER, "z")]),
    ],
)
def test_marks(page, want):
    assert h.page_lines(page) == want


def test_alignment_in_linear_memory(monkeypatch):
    monkeypatch.setattr(h, "TABLE_CELLS", 4)
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        kept = [x for x, m in zip(a, h.shared_lines(a, b), strict=True) if m]
        assert len(kept) == lcs(a, b) == lcs(kept, b)


def test_very_long_page_and_url(spark):
    lines = [f"<p>line {i % 9973} of {i}</p>" for i in range(20_000)]
    rows = [(1, "https://x.example/a/" + "u" * 100_000, "".join(lines)), (2, "https://x.example/a/" + "u" * 99_999 + "v", "".join(lines[::2]))]
    got = {r.page_id: r.main_text for r in h.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].split("\n") == [f"line {i % 9973} of {i}" for i in range(1, 20_000, 2)] and got[2] == ""


def plain_text(pages):
    """The whole operator by brute force: the nearest other page of the host in URL order, then a full table of the LCS."""
    order = sorted((host, path, i) for i, (host, path, _) in enumerate(pages))
    blocks = {i: h.page_lines(page) for i, (_, _, page) in enumerate(pages)}
    out = {}
    for place, (host, path, i) in enumerate(order):
        sides = [next((j for o, _, j in side if o == host and blocks[j] and [t for _, t in blocks[j]] != [t for _, t in blocks[i]]), None) for side in (reversed(order[:place]), order[place + 1 :])]
        near = max(((h.nearness(path, pages[j][1]), -k, j) for k, j in enumerate(sides) if j is not None), default=None)
        lines = [t for _, t in blocks[i]]
        shared = h.shared_lines([hash(t) for t in lines], [hash(t) for _, t in blocks[near[2]]]) if near else [False] * len(lines)
        out[i] = "\n".join(t for (mark, t), s in zip(blocks[i], shared, strict=True) if mark == h.MAIN or mark == h.OTHER and not s)
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for i in range(60):
        host = f"h{rng.randrange(3)}.example"
        body = [f"<div>menu {rng.randrange(3)}</div>", f"<p>own {i}</p>", *(f"<div>part {rng.randrange(5)}</div>" for _ in range(rng.randrange(6)))]
        if rng.random() < 0.3:
            body.append(f"<article><p>article {i}</p><p>licence</p></article>")
        rng.shuffle(body)
        pages.append((host, f"/{rng.randrange(4)}/{i:02d}", "".join(body)))
    df = spark.createDataFrame([(i, f"https://{host}{path}", page) for i, (host, path, page) in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r.page_id: r.main_text for r in h.main_text(df.repartition(5)).collect()}
    assert got == plain_text(pages)
    alone = {r.page_id: r.main_text for r in h.main_text(df.where("page_id = 0")).collect()}
    assert alone[0] != got[0]  # without neighbours nothing is shared


def kept(page):
    return [text for mark, text in h.page_lines(page) if mark != h.FURNITURE]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<form id=aspnetForm><div>menu</div><article><p>A</p></article><footer>f</footer></form>", ["A"]),
        ("<article><p>A</p><form><p>Name</p></form></article>", ["A"]),
        ("<article><p>A</p><section id=related-work><p>Related work</p></section></article>", ["A", "Related work"]),
        ("<article><div class=share-price><p>Up</p></div><p class=navigation-systems>GPS</p><div class=reply-all-bug>Mail</div></article>", ["Up", "GPS", "Mail"]),
        ("<article><p>A</p><div class='related-posts'>R</div><ul class='social share-buttons'><li>S</ul><div class='post ad-slot-2'>Buy</div><section id=comments>C</section></article>", ["A"]),
        ("<article><p>A</p><video src=x><p>Body</p></article>", ["A", "Body"]),
        ("<article><p>A</p><object data=y><p>Body</p><object></article>", ["A", "Body"]),
        ("<article><p>A</p><video src=x>no player</video><p>Body</p></article>", ["A", "Body"]),
        ("<article><p>A</p><script>x<p>y</p></article>", ["A"]),
        ("<article><p>one<b>two<div>three</div></b></article>", ["onetwo", "three"]),
    ],
)
def test_pages_that_lost_their_article(page, want):
    assert kept(page) == want


@pytest.mark.parametrize("unit", ["<div>", "<p><span>", "<span>x</b>", "<video>", "<div></span>", "<article><div>"])
def test_deep_nesting_takes_linear_time(unit):
    began = time.process_time()
    h.page_lines(unit * 100_000 + "<p>end")
    assert time.process_time() - began < 5
