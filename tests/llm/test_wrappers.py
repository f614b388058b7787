"""HTML extraction: known articles inside of several templates, and the cases of the docstring."""

import random

from firmaforge.llm import wrappers as w

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper".split()


def lines(i, n=3):
    return [" ".join(WORDS[(i * 7 + k * 3 + j) % 10] for j in range(12)) + f" {i} {k}." for k in range(n)]


def page(i, body):
    return (
        f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a="</p>";</script></head>'
        f"<body><nav><ul><li><a href=/a>Home {i}</a></li><li><a href=/b>News</a></li></ul></nav>{body}"
        f"<footer>&copy; {i} Example</footer></body></html>"
    )


def test_marked_article_with_open_tags():
    body = '<!-- ad --><div class="ad">Buy {i}</div><article><h1>T &amp; {i}</h1><p><b>one{i}<br><p>two  \n words</p></article>'
    got = w.extract([page(i, body.replace("{i}", str(i))) for i in range(4)])
    assert got == [f"T & {i}\none{i}\ntwo words" for i in range(4)]


def test_unmarked_article_by_wrapper():
    pages, want = [], []
    for i in range(5):
        text = lines(i, 2 + i % 3)
        pages.append(
            page(
                i,
                '<div class="top"><p>Welcome to our pages</p></div>'
                f'<div class="wrap"><div class="c1"><h2>H {i}</h2>' + "".join(f"<p>{t}</p>" for t in text) + "</div>"
                '<div class="c2"><p>Read this too</p></div></div>'
                f'<div id="comments"><p>{lines(i + 3)[0]}</p></div>',
            )
        )
        want.append("\n".join([f"H {i}", *text]))
    assert w.extract(pages) == want


def test_left_out_parts_inside_articles():
    body = (
        "<main><article><header><h1>Title</h1></header><p>Text one.</p><aside>side</aside>"
        "<form><input><button>Go</button></form><div class='cookie-notice'>We use</div><p>Text&nbsp;two.</p>"
        "<section class='comments'><p>nice!</p></section></article></main>"
    )
    assert w.extract([page(1, body)]) == ["Title\nText one.\nText two."]


def test_container_named_after_a_sidebar_keeps_its_article():
    assert w.extract([page(1, "<div class='with-sidebar'><article><p>Kept.</p></article></div>")]) == ["Kept."]


def test_wrapper_is_union_free_with_repeats_options_and_slots():
    a = w.parse("<div><h1>x</h1><p>a</p><p>b</p><i>z</i></div>")
    b = w.parse("<div><h1>x</h1><p>c</p></div>")
    assert str(w.infer([a, b])) == "<#page><div><h1>'x'</h1> (<p>#</p>)+ ('z')?</div></#page>"


def test_empty_null_plain_and_deep_pages():
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    got = w.extract([None, "", "just text", deep, "<p>" * 100, "<" * 1000])
    assert got[0] == got[1] == ""
    assert got[3] == "deep text"


def test_large_page_is_linear():
    many = page(1, "<article>" + "".join(f"<p>w{i}</p>" for i in range(30_000)) + "</article>")
    assert w.extract([many])[0].count("\n") == 29_999


def test_hot_host_is_cut_and_every_row_returns(spark):
    rows = [(i, "http://h.example/x", page(i, f"<article><p>text {i}</p></article>")) for i in range(60)]
    rows += [(60, None, None), (60, None, None), (61, "x", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    got = w.main_texts(df, group_bytes=2000)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r.page_id, r.text, r.n_chars) for r in got.collect())
    assert found == sorted([(i, f"text {i}", len(f"text {i}")) for i in range(60)] + [(60, "", 0)] * 2 + [(61, "", 0)])
    assert w.main_texts(df.limit(0)).count() == 0


def test_template_texts_inside_marked_articles():
    body = "<article><h2>{i}</h2><p>{t}</p><div class='x'>Rate this page</div><table><tr><td>Price</td><td>{i} EUR</td></tr></table></article>"
    pages = [page(i, body.replace("{i}", str(i)).replace("{t}", lines(i, 1)[0])) for i in range(4)]
    assert w.extract(pages) == [f"{i}\n{lines(i, 1)[0]}\nPrice {i} EUR" for i in range(4)]
    # The cells are a repeated group, and so a slot. Two pages tell nothing, nor do copies of one page.
    assert "Rate this page" in w.extract(pages[:2])[0]
    assert w.extract(pages[:1] * 5) == [f"0\n{lines(0, 1)[0]}\nRate this page\nPrice 0 EUR"] * 5


def test_template_texts_go_at_their_place_only():
    body = "<article><div class='top'>Note</div><p>{i}</p><section><h2>{h}</h2><h3>x{i}</h3></section></article>"
    pages = [page(i, body.replace("{i}", str(i)).replace("{h}", "Note" if i == 2 else f"h{i}")) for i in range(4)]
    assert w.extract(pages)[2] == "2\nNote\nx2"


def test_region_checks_a_marked_teaser():
    pages = [
        page(i, f"<div class='b'><div class='story'><h2>H {i}</h2><p>{' '.join(lines(i, 9))}</p></div></div><article><p>Teaser {i}</p></article>")
        for i in range(4)
    ]
    assert [t.split("\n")[0] for t in w.extract(pages)] == [f"H {i}" for i in range(4)]


def test_subjects_of_headings_and_sections_are_no_chrome():
    body = (
        "<article class='post has-sidebar'><h1>T</h1><h2 id='search-results'>Results</h2><div class='ad-hoc'>Ad hoc.</div>"
        "<div class='market-share'>Share.</div><section id='comments-on-method'><p>Method.</p></section>"
        "<div class='comment-list'>first!</div><div id='site-footer'>foot</div><p class='alert'>Out.</p></article>"
    )
    assert w.extract([page(1, body)]) == ["T\nResults\nAd hoc.\nShare.\nMethod."]


def test_attributes_of_any_length_and_stray_quotes():
    long = "x > y < z " * 2000
    body = f"<article><p data-json=\"{long}\">One.</p><p data-x='{long}' title=don't>Two's.</p><p title=\"class='ad'\">Three.</p></article>"
    assert w.extract([page(1, body)]) == ["One.\nTwo's.\nThree."]


def brute_common(a, b):
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_alignment_is_exact_at_any_length():
    rng = random.Random(4)
    for n, m in ((0, 3), (5, 0), (7, 9), (40, 70), (900, 800)):
        a, b = ([rng.choice("abcdefgh") for _ in range(k)] for k in (n, m))
        pairs = w._common([w.Wrapper(x) for x in a], [w.Wrapper(x) for x in b])
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) == brute_common(a, b)
