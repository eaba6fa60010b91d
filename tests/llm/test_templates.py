import pytest

from slopeline.llm.templates import Event, _in_order, article, deduce_templates, main_text, page_tokens, scan, token_classes, _rows


def page(k, body, menu=4, extra=""):
    links = "".join(f'<li><a href="/{j}">m{k}{j}</a></li>' for j in range(menu))
    return (f'<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body><header><h2>Site</h2></header><nav><ul>{links}</ul></nav>'
            f'<!-- ad {k} --><div class="ad">Buy {k}</div><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; {k}</h1>{body}<form><input>Mail<button>Go</button></form>'
            f'<div id="comments"><p>I like it {k}</p></div></article><aside><p>Other things to read, many of them, {k}</p></aside>{extra}<footer>&copy; me</footer>')


def pages():
    rows = [(k, "http://a.example/x", page(k, f"<p>First  {k}\n text <b>bold</b><br>line<p>Second &lt;{k}&gt;" + "<p>same on all</p>" * (k % 3))) for k in range(6)]
    rows += [(10, "https://U:p@One.Example:80/", page(10, "<p>alone</p>")), (11, None, page(11, "<p>no url</p>")), (12, "http://a.example/y", None), (13, "bad url", ""),
             (14, "http://plain.example/", "just text &amp; more"), (15, "http://list.example/", "<body><main><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></main>"), (3, "http://a.example/x", rows[3][2])]
    return rows


def expected(k):
    return "\n".join([f"Title & {k}", f"First {k} text bold line", f"Second <{k}>", *["same on all"] * (k % 3)])


SCHEMA = "page_id long, url string, html string, host string, text string"


def test_main_text(spark):
    df = spark.createDataFrame([(*r, "h", "t") for r in pages()], SCHEMA).repartition(4)
    got = {r["page_id"]: r for r in main_text(df).collect()}
    for k in range(6):
        assert got[k]["text"] == expected(k) and got[k]["n_chars"] == len(expected(k))
    assert got[10]["text"] == "Title & 10\nalone" and got[11]["text"] == "Title & 11\nno url"
    assert got[12]["text"] == "" and got[13]["text"] == "" and got[14]["text"] == "just text & more" and got[15]["text"] == "one\ntwo\nc\nd"
    assert main_text(df).count() == len(pages()) and main_text(df.limit(0)).count() == 0


def test_classes_share_occurrence_vectors(spark):
    rows = [(k, "http://a/", f"<body><ul>{'<li>x</li>' * (k + 1)}</ul><p>{k}</p></body>") for k in range(5)]
    df = _rows(spark.createDataFrame(rows, "page_id long, url string, html string"))
    classes = {}
    for r in token_classes(df).filter("layout <> 0 and kind < 4").collect():
        classes.setdefault(r["class"], []).append((r["kind"], r["uses"]))
    assert sorted(len(v) for v in classes.values()) == [3, 6]  # li, /li and x; body, ul, p and their ends
    t, = deduce_templates(df).collect()
    assert t["host_pages"] == 5 and len(t["root"]) == 6 and [(n["size"], n["uses"], n["slot"]) for n in t["nested"]] == [(3, 15, 2)]


def test_tokens_out_of_order_leave_the_root_class(spark):
    rows = [(k, "http://a/", "<body><i>1</i><b>2</b><p>t</p></body>" if k else "<body><b>2</b><i>1</i><p>t</p></body>") for k in range(4)]
    t, = deduce_templates(_rows(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert 5 < len(t["root"]) <= 5 + 3  # body, p, t, /p, /body and part of one of the two groups
    for _, _, html in rows:
        places = [page_tokens(html)[1][k][2] for k in t["root"]]
        assert places == sorted(places)
    assert _in_order([3, 1, 2, 4]) == [False, True, True, True]


@pytest.mark.parametrize("html", ["<", "<p", "</p></div>", "<a href='x>y", "<!-- open", "<script>never ends", "<p><p><p", "a<b>c</i>d</b>", "<svg/><p>x</p>", "<td>1<tr><td>2", "\x00<p>\ud83d</p>".encode("utf-8", "replace").decode()])
def test_broken_markup(html):
    list(scan(html))
    page_tokens(html)
    assert isinstance(article(html, None), str)


def test_scan_closes_open_elements():
    opened = [(e[1], e[3]) for e in scan("<div><p><b>x<p>y<ul><li>1<li>2</ul></div>") if e[0] == Event.OPEN]
    assert opened == [("div", 1), ("p", 2), ("b", 3), ("p", 2), ("ul", 2), ("li", 3), ("li", 3)]


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


LONG = "A paragraph of running text that goes on and on, far longer than the headline above it, number {0}. " * 4


def test_main_element_keeps_headline_and_lead(spark):
    """The innermost element with 80 % of the text is not the article: nothing beside it may get lost."""
    rows = [(1, "http://one/", f"<body><article><h1>Headline</h1><p><b>{LONG.format(1)}<br></article>")]
    rows += [(10 + k, "http://many/", f"<body><div><a href='/{k}'>menu</a></div><article><h1>Headline {k}</h1><div class='body'><p>{LONG.format(k)}</p></div></article></body>") for k in range(5)]
    rows += [(20 + k, "http://plain/", f"<body><div class='post'><h2><a href='/p'>Headline {k}</a></h2><div class='by'>By {k}</div><div class='body'>{LONG.format(k)}</div></div><div><a href='/{k}'>older {k}</a></div></body>")
             for k in range(5)]
    got = texts(spark, rows)
    assert got[1] == "Headline\n" + LONG.format(1).strip()
    for k in range(5):
        assert got[10 + k] == f"Headline {k}\n{LONG.format(k).strip()}"
        assert got[20 + k] == f"Headline {k}\nBy {k}\n{LONG.format(k).strip()}"


def test_page_with_text_outside_the_main_element_takes_the_next_around(spark):
    rows = [(k, "http://a/", f"<body><div class='x'>{'Lead of one page' if k == 3 else ''}<div class='body'><p>{LONG.format(k)}</p></div></div></body>") for k in range(6)]
    got = texts(spark, rows)
    for k in range(6):
        assert got[k] == ("Lead of one page\n" if k == 3 else "") + LONG.format(k).strip()


def test_empty_and_odd_pages_leave_the_template(spark):
    """Menus and notices in plain divs go although the host has null, empty and odd pages."""
    rows = [(k, "http://a/", f"<body><div><p>All our sections</p></div><div class='text'><p>{LONG.format(k)}</p><p>{k}</p></div><div><p>Imprint of the site</p></div></body>") for k in range(6)]
    rows += [(7, "http://a/", None), (8, "http://a/", ""), (9, "http://a/", "<body><h3>Error</h3><i>Not found</i></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    t, = deduce_templates(_rows(df)).collect()
    assert t["host_pages"] == 6 and t["main"] is not None  # the odd page is a layout of its own
    got = texts(spark, rows)
    for k in range(6):
        assert got[k] == f"{LONG.format(k).strip()}\n{k}"
    assert got[7] == got[8] == "" and got[9] == "Error\nNot found"


def test_template_strings_go_from_the_article_too(spark):
    """Strings of all pages, of any length, and those of nested classes; copies of a page are one page."""
    notice = "This long notice is the same on all pages of the host, and it is longer than sixty characters."
    share = "<div class='box'><span>Tell your friends</span></div>"
    rows = [(k, "http://a/", f"<body><article><h1>T {k}</h1><p>{LONG.format(k)}</p><p>Read <b>more</b> of {k}</p><p>{notice}</p>{share * (k % 4)}</article></body>") for k in range(8)]
    rows += [(20 + k, "http://copies/", f"<body><article><h1>One</h1><p>{LONG.format(0)}</p></article></body>") for k in range(5)]
    got = texts(spark, rows)
    for k in range(8):
        assert got[k] == f"T {k}\n{LONG.format(k).strip()}\nRead more of {k}"
    for k in range(5):
        assert got[20 + k] == "One\n" + LONG.format(0).strip()


@pytest.mark.parametrize("wrapper", ["class='content with-sidebar'", "id='page' class='no-sidebar'", "class='has-banner'", "id='search-results'"])
def test_class_words_of_wrappers_discard_nothing(wrapper):
    body = f"<h1>Headline</h1><p>{LONG.format(1)}</p>"
    want = "Headline\n" + LONG.format(1).strip()
    assert article(f"<body><div {wrapper}><article>{body}</article></div></body>", None) == want
    assert article(f"<body><div {wrapper}>{body}</div></body>", None) == want


def test_class_words_need_the_template_or_little_text(spark):
    """A long block with a listed class on one page is content; one that the host repeats is not."""
    rows = [(k, "http://a/", f"<body><div class='with-sidebar'><article><p>{LONG.format(k) * 3}</p>{'<div class=alert>' + LONG.format('x') + '</div>' if k == 2 else ''}"
             f"<div class='share'>Pass {k} on</div></article><div id='comments'><p>{LONG.format(100 + k)}</p></div></div></body>") for k in range(6)]
    got = texts(spark, rows)
    for k in range(6):
        assert got[k] == (LONG.format(k) * 3).strip() + ("\n" + LONG.format("x").strip() if k == 2 else "")


def renamed(html):
    """A page without semantic tags, classes, ids and roles."""
    import re

    return re.sub(r'\s(?:class|id|role)="[^"]*"', "", re.sub(r"(</?)(?:article|main|nav|aside|footer|header|form)\b", r"\1div", html))


def test_given_pages_with_and_without_semantic_tags(spark, sf_small):
    """Every page gives its article. With all hints taken away the template still finds it: nothing of
    it gets lost, and next to nothing of the rest is added."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()]
    want = {k: article(html[html.index("<article>"):html.index("</article>")]) for k, _, html in rows}
    assert texts(spark, rows) == want
    bare = texts(spark, [(k, url, renamed(html)) for k, url, html in rows])
    lines = {k: (want[k].split("\n"), bare[k].split("\n")) for k in want}
    assert all(line in found for wanted, found in lines.values() for line in wanted)
    added = sum(len(line) for wanted, found in lines.values() for line in found if line not in wanted)
    boilerplate = sum(len(article(renamed(html).split("</head>")[1])) - len(want[k]) for k, _, html in rows)
    assert added * 10 < boilerplate


def test_three_layouts_of_one_host(spark):
    """Layouts with less than half of the host's pages each have their template."""
    def body(kind, k):
        text = f"<h1>Title {k}</h1><p>{LONG.format(k)}</p><p>{k}</p>"
        return {0: f"<div>Menu of {k} words</div><div>{text}</div><div>Sign up {k}</div>", 1: f"<section>Top {k}</section><div>{text}</div>",
                2: f"<table><tr><td><div>Side {k}</div><td><div>{text}</div></table><ul><li><a href=/>x</a></ul>"}[kind]
    rows = [(k, "http://three/", f"<html><body>{body(k % 3, k)}</body></html>") for k in range(15)]
    got = texts(spark, rows)
    for k in range(15):
        assert got[k] == f"Title {k}\n{LONG.format(k).strip()}\n{k}"


@pytest.mark.parametrize("html", ["<b>" * 100_000 + "x", "<a \"" * 100_000, "<a '" * 50_000 + ">", "<div class='ad'>" * 30_000, "<p><div>" + "<b>" * 50_000 + "<p>" * 50_000, "<" * 200_000, "<!--" * 100_000, "</p" * 100_000,
                                  "<article></article><div class=ad>x</div>" * 20_000])
def test_deep_and_broken_pages_take_linear_time(html):
    import time

    began = time.process_time()
    article(html)
    page_tokens(html)
    assert time.process_time() - began < 15


def test_tags_with_attributes_are_matched_in_one_step():
    """The pattern for whole tags ends them where the step-by-step reading does, and takes quoted values."""
    from slopeline.llm.templates import _PLAIN_TAG, tag_at

    whole = ["<a href=\"/x\">", "<a href='/x' title=\"a > b\">", "<p class='a\"b'>", "<br/>", "</p>", "<a b='<i>'>"]
    for tag in whole:
        assert _PLAIN_TAG.match(tag + "rest>")[0] == tag == tag_at(tag + "rest>", 0, set())[1]
    for odd in ("<a href=\"x>y", "</p x='>'>", "<a <b>", "<1>", "<!-- x -->", "<a '\">"):
        assert _PLAIN_TAG.match(odd) is None
