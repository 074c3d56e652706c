"""WARC round trips and main texts."""

import hashlib
from collections import Counter

import pytest
import zstandard

from fraudstream.llm import html_text, warc

LONG, OTHER = "<p>" + "payload é " * 200, "<p>" + "another one " * 200
PAGES = [
    (1, "https://a.example/ä b\r\nX: y", LONG),
    (2, None, LONG),
    (3, "u3", LONG),
    (4, "u4", "short"),
    (5, "u5", "short"),
    (6, "u6", None),
    (7, "u7", ""),
    (8, "u8", OTHER),
    (8, "u8", OTHER),
    (None, "none", LONG),
    (9, "u9", "\r\n\r\n" + "x" * 3_000_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, id int")


@pytest.mark.parametrize("file_bytes", [1, 64 << 20])
def test_archives_read_back(pages, file_bytes):
    rows = warc.archive_and_read(pages, file_bytes=file_bytes).collect()
    keeper = {LONG: 3, OTHER: 8}
    want = Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        refers = keeper.get(html) if len(data) >= 1000 and i is not None and i < keeper.get(html, i) else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert {bytes(r.payload) for r in rows if r.page_id == 9} == {PAGES[-1][2].encode()}
    assert all("\n" not in (r.url or "") for r in rows)


def test_no_pages(pages):
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_dictionary_stands_in_a_leading_skippable_frame(tmp_path):
    records = [warc.record(i, f"u{i}", f"<p>page number {i} with common words</p>".encode() * 3, None) for i in range(500)]
    path = tmp_path / "x.warc.zst"
    with path.open("wb") as out:
        writer = warc.ArchiveWriter(out)
        for r in records:
            writer.add(r)
        writer.finish()
    assert int.from_bytes(path.read_bytes()[:4], "little") == warc.DICTIONARY_MAGIC
    plain = sum(len(zstandard.ZstdCompressor().compress(r)) for r in records)
    assert path.stat().st_size < plain + warc.DICTIONARY_BYTES
    with path.open("rb") as file:
        read = list(warc.read_archive(file))
    assert [f["warc-record-id"] for f, _ in read] == [warc.record_id(i) for i in range(500)]
    with path.open("r+b") as file:
        file.truncate(path.stat().st_size - 9)
    with pytest.raises((EOFError, zstandard.ZstdError)), path.open("rb") as file:
        list(warc.read_archive(file))


TEXT = "This is a paragraph, long enough, with commas, to be scored as text of the article."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{TEXT}<p>Short.</article><footer>x</footer>", f"Title\n{TEXT}\nShort."),
        (f"<div class='sidebar-left'><p>{TEXT}</p></div><div id=content><p>{TEXT} One.</p></div>", f"{TEXT} One."),
        (f"<body><div><p><b>{TEXT}<br><p>a\n b&nbsp;&lt;c&gt;</div>", f"{TEXT}\na b <c>"),
        (f"<script>var t='</p><p>no'</script><style>p{{}}</style><p>{TEXT}</p><!-- <p>no --><form><p>{TEXT} No</p></form>", TEXT),
        (f"<article><p>{TEXT}</p><div class=comments><p>{TEXT} Mine, yours.</p></div></article>", TEXT),
        (f"<article><p>{TEXT}</p><p>a < b <i>and</i> c &am", f"{TEXT}\na < b and c &am"),
        (f"<main><section><h2>One</h2><p>{TEXT}</p></section><section><p>{TEXT} Two.</p></section></main>", f"One\n{TEXT}\n{TEXT} Two."),
        ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", "one\ntwo\nx\ny"),
        ('<p title="a > b">x</p><p data="unclosed>y', "x\ny"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def test_links_lose(spark):
    links = "".join(f"<li><a href=/{i}>{TEXT}</a></li>" for i in range(30))
    html = f"<div><ul>{links}</ul></div><div><p>{TEXT}</p><p>{TEXT}</p></div>"
    assert html_text.main_text(html) == f"{TEXT}\n{TEXT}"
    rows = [(1, None, html), (2, "u", None), (2, "u", None)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.n_chars) for r in found) == Counter([(1, 2 * len(TEXT) + 1), (2, 0), (2, 0)])


def test_deep_and_broken_pages():
    assert html_text.main_text("<div>" * 50_000 + TEXT) == TEXT
    assert html_text.main_text("</p></div>" * 1000 + f"<p>{TEXT}") == TEXT


@pytest.mark.parametrize(
    "wrapper",
    [
        "<form id=aspnetForm>{}</form>",
        "<div class='site has-sidebar'>{}</div>",
        "<div class='layout no-sidebar'><form>{}</form></div>",
        "<div id=page class='nav-open'>{}</div>",
        "<div class='sticky-header'>{}</div>",
        "<div class='no-ads'>{}</div>",
    ],
)
@pytest.mark.parametrize("inside", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_wrappers_of_the_page_are_not_cut(wrapper, inside):
    body = f"<h1>Title</h1><p>{TEXT}</p><p>{TEXT} Two.</p>"
    rest = f"<div class=sidebar><p>{TEXT} Aside.</p></div><form><p>{TEXT} Form.</p></form>"
    rest += f"<div class=comments><article><p>{TEXT} Mine.</p><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></article></div>"
    for html in (wrapper.format(inside.format(body) + rest), wrapper.format(inside.format(body)) + rest):
        assert html_text.main_text(html) == f"Title\n{TEXT}\n{TEXT} Two."
    no_title = f"<p>{TEXT}</p><p>{TEXT} Two.</p>"
    assert html_text.main_text(wrapper.format(inside.format(no_title))) == f"{TEXT}\n{TEXT} Two."


def test_boilerplate_beside_the_text_stays_cut():
    teaser = f"<div class=related><article><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></article></div>"
    assert html_text.main_text(f"<article><p>{TEXT} One.</p></article>{teaser}") == f"{TEXT} One."
    assert html_text.main_text(f"<main><p>{TEXT} One.</p></main>{teaser}") == f"{TEXT} One."
    assert html_text.main_text(f"<h1>T</h1><p>{TEXT}</p><p>{TEXT}</p><form><p>{TEXT} Form.</p></form>") == f"T\n{TEXT}\n{TEXT}"


def test_short_sections_beside_the_longest_are_kept():
    long = f"<section><h2>One</h2>{f'<p>{TEXT}</p>' * 10}</section>"
    short = "<section><p>A second section of two or three short lines only.</p><ul><li>x<li>y</ul></section>"
    table = "<div><table><tr><td>a<td><a href=/>b</a> c, and d</table></div>"
    links = f"<div>{f'<a href=/>{TEXT}</a> ' * 3}</div>"
    want = "\n".join(["One", *[TEXT] * 10, "A second section of two or three short lines only.", "x", "y", "a", "b c, and d"])
    parts = long + short + table + links
    for html in (f"<body><div id=content>{parts}</div>", f"<body>{parts}", f"<div id=content><div>{long}</div>{short}{table}{links}</div>"):
        assert html_text.main_text(html) == want
    bare = f"<div id=content>{long}Text of its own, <b>bold</b> and <a href=/>linked</a><p>End <a href=/>now</a> then.</p></div>"
    assert html_text.main_text(bare).splitlines()[11:] == ["Text of its own, bold and linked", "End now then."]
    nested = f"<body><div id=content><div>{long}{long}</div><div>{short}</div></div><div>Copyright of the page</div>"
    assert html_text.main_text(nested).splitlines()[22:] == ["A second section of two or three short lines only.", "x", "y"]


P = "A paragraph of the article, long enough to count, with a comma and some more words in it."


@pytest.mark.parametrize("html,want", [
    (f"<article><p>{P}</p><p>{P}</p></article><article><p>Short second part.</p></article>", [P, P, "Short second part."]),
    (f"<main><article><p>{P}</p></article><section>Short closing.</section></main>", [P, "Short closing."]),
    (f"<article><p>{P}</p><section id='discussion-of-results'><p>Found.</p></section></article>", [P, "Found."]),
    (f"<article><p>{P}</p><div class='related-work'><p>Others.</p></div></article>", [P, "Others."]),
    (f"<article><p>{P}</p><div class='ad-free story'>No adverts.</div></article>", [P, "No adverts."]),
    (f"<article><p>{P}</p><table class='menu-prices'><tr><td>Soup</td><td>3</td></tr></table></article>", [P, "Soup", "3"]),
    (f"<article><p>{P}</p><div class='ad'>Buy.</div><div class='share-buttons'>Tell.</div></article>", [P]),
    (f"<article><p>{P}</p><div id='comments'><p>First!</p></div></article>", [P]),
    (f"<main><article><p>{P}</p></article><div><a href='/x'>Other page one</a> <a href='/y'>two</a></div></main>", [P]),
    (f"<div class='ad'>Buy.</div><article><p>{P}</p></article><aside><p>{P}</p></aside>", [P]),
])
def test_text_of_articles(html, want):
    page = f"<html><body><nav><a href='/'>Home</a></nav>{html}<footer>All rights reserved, by us, always.</footer></body></html>"
    assert html_text.main_text(page).split("\n") == want


def test_given_pages_hold_exactly_their_article(spark):
    """Every page of the tables against the text of its article by another parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside += 1
            if tag == "br":
                self.blocks[-1] += " "
            elif tag not in ("b", "i", "em", "a", "span"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside -= 1
            if tag not in ("b", "i", "em", "a", "span"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        parser = Article()
        parser.feed(row.html or "")
        parser.close()
        want = [" ".join(b.split()) for b in parser.blocks]
        assert got[row.page_id] == "\n".join(b for b in want if b)


def test_extraction_of_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, id int, n_chars string"
    long = "<article>" + f"<p>{P}</p>" * 20000 + "</article>"
    pages = spark.createDataFrame([(1, "u", long, "t", 1, "n"), (2, None, None, "t", 1, "n"), (2, None, "", "t", 1, "n")], schema)
    got = sorted((r.page_id, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [(1, 20000 * (len(P) + 1) - 1), (2, 0), (2, 0)]
    assert html_text.extract(pages.limit(0)).collect() == []
