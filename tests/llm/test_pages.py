"""Main text and archives."""

import hashlib
import io
import struct
import zipfile

import pytest

from sparkverbs.llm import archives, main_text
from sparkverbs.llm.main_text import Page
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"

SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header>
<nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="wrap post-%d">
<article class="entry post-%d"><h1>Head &amp; tail</h1><p>First  para&shy;graph<br>goes\non. <script>var a = "<p>no</p>";</script><p>Second <b>bo</b>ld &lt;x&gt;
<form><input>Form text</form><table><tr><td>one<td>two</table><aside>Side</aside><div class='ad-box'>Buy</div>
<section id="comments"><p>A reader's comment that is long, long, long and long.</p></section></article></div>
<div id="sidebar">Other</div><footer>&copy; Site</footer></body></html>"""
WANT = "Head & tail First para­graph goes on. Second bold <x> one two"


def test_boilerplate_goes_and_blocks_are_joined(spark):
    rows = [(i, f"http://a.example/{i}", SITE % (i, i)) for i in range(5)]
    got = main_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {(r.text, r.n_chars, r.path) for r in got} == {(WANT, len(WANT), "body.has-sidebar>div.post-#.wrap>article.entry.post-#")}


def test_host_consensus_outvotes_a_page(spark):
    """A short article beside a long teaser is found by the path of the other pages."""
    def page(article, teaser):
        return f"<body><div class=main><p>{article}</p></div><div class=teaser><p>{teaser}</p></div></body>"

    rows = [(i, "https://b.example/x", page("word " * 60, "short")) for i in range(6)] + [(9, "https://B.example/y", page("tiny", "word " * 90))]
    got = {r.page_id: r.text for r in main_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "tiny" and got[0] == ("word " * 60).strip()


@pytest.mark.parametrize("source, want", [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>open <i>never closed", "open never closed"), ("<div><p>a</div>b<p>c", "a b c"),
    ("a<br>b<!-- x > y -->c", "a bc"), ("<p>cut <a href='", "cut"), ("<script>never closed", ""), ("<p hidden>no</p><p>yes</p>", "yes"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<ul><li>a<li>b</ul>", "a b"), ("<p>x&nbsp;&nbsp;y</p>", "x y"), ("</p></div>text</body>", "text")])
def test_odd_markup(source, want):
    assert Page(source).main(None) == want


TEXT = "Some words of the article stand here. "


@pytest.mark.parametrize("body, want", [
    # a lead beside the body of an article
    ("<article><div class=lead>A lead.</div><div class=body>" + TEXT * 9 + "</div></article>", "A lead. " + (TEXT * 9).strip()),
    ("<main><div class=lead>A lead.</div><div class=body>" + TEXT * 9 + "</div></main>", "A lead. " + (TEXT * 9).strip()),
    # text two levels down, in siblings
    ("<article>" + f"<section><div><p>{TEXT}</p></div></section>" * 3 + "</article>", (TEXT * 3).strip()),
    ("<div id=content>" + f"<section><div><p>{TEXT}</p></div></section>" * 3 + "</div>", (TEXT * 3).strip()),
    # wrappers with compound names, and parts that are none
    (f'<div class="layout-sidebar-right"><article><p>{TEXT}</p></article></div>', TEXT.strip()),
    (f'<div class="search-page"><div><p>{TEXT * 4}</p></div></div><p>Rest.</p>', (TEXT * 4).strip()),
    (f'<div class="share-box">Share this</div><article><p>{TEXT}</p><div class="related-posts">More</div></article>', TEXT.strip()),
    (f'<article><p>{TEXT}</p></article><section id="comments-area"><article>{TEXT * 20}</article></section>', TEXT.strip())])
def test_articles_are_kept_whole(spark, body, want):
    assert Page(body).main(None) == want
    rows = [(i, f"http://d.example/{i}", f"<body>{body}</body>") for i in range(3)]
    assert {r.text for r in main_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()} == {want}


def test_other_templates_on_a_host(spark):
    """A page whose container on the winning path is empty, and one without it, use their own choice."""
    common = [(i, "http://e.example", f"<body><article class=post><p>{TEXT}</p></article></body>") for i in range(5)]
    odd = [(7, "http://e.example", f"<body><article class=post></article><div class=text><p>{TEXT * 2}</p></div></body>"),
           (8, "http://e.example", f"<body><div class=story><p>{TEXT * 3}</p></div></body>")]
    got = {r.page_id: r.text for r in main_text.main_text(spark.createDataFrame(common + odd, "page_id bigint, url string, html string")).collect()}
    assert got[0] == TEXT.strip() and got[7] == (TEXT * 2).strip() and got[8] == (TEXT * 3).strip()


def test_scores_against_brute_force():
    """Sums and the choice, worked out from every container's own text."""
    import random

    rng = random.Random(5)
    for _ in range(60):
        def part(depth):
            inner = "".join(rng.choice([lambda: part(depth + 1), lambda: f"<p>{'word ' * rng.randint(1, 9)}</p>"])() for _ in range(rng.randint(1, 3))) if depth < 4 else "<p>leaf text</p>"
            return f"<{(tag := rng.choice(['div', 'section', 'div', 'article']))}>{inner}</{tag}>"

        page = Page(f"<body>{part(0)}{part(1)}</body>")
        below = [{j for j in range(len(page.paths)) if i in chain(page, j)} for i in range(len(page.paths))]
        want = [sum(len(" ".join(t.split())) for n, t, _ in page.text if t and n in below[i]) for i in range(len(page.paths))]
        assert page.sums() == want
        large = [i for i in range(len(want)) if want[i] >= 0.6 * want[0]]
        articles = [i for i in large if page.tags[i] == "article"]
        assert page.choice(want) == (min(articles) if articles else max(large, key=lambda i: len(chain(page, i))))


def chain(page, i):
    out = []
    while i >= 0:
        out.append(i)
        i = page.parents[i]
    return out


def test_hostile_markup_is_read_in_linear_time():
    assert Page("<a " * 20_000 + "<div>" * 3_000 + "end").main(None).endswith("end")
    Page('<p title="' * 5_000).votes()


def test_null_repeated_and_clashing(spark):
    rows = [(1, None, None, 5), (1, None, None, 5), (2, "http://c.example", "<p>x</p>", 6), (None, "not a url", "<p>y", 7)]
    got = main_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, path int")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "", 0), ("1", "", 0), ("2", "x", 1), ("None", "y", 1)]
    assert main_text.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_round_trip_against_sql(spark):
    got = archives.round_trip(spark.read.parquet(f"{FOLDER}/pages.parquet")).toArrow()
    assert differences(got, connect(FOLDER).sql(archives.SQL).to_arrow_table()) == []


def test_round_trip_of_odd_rows(spark):
    long, other = "ä" * 600, "z" * 1000
    rows = [(1, "u", long), (2, "v", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "w", other),
            (7, "a\r\nb: c", other), (8, "x", "q" * 3_000_000), (8, "x", "q" * 3_000_000)]
    got = archives.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    plain = [(i, (h or "").encode()) for i, _, h in rows]
    kept = {1: 3, 2: 3, None: 7}
    want = sorted((str(i), len(p), hashlib.sha1(p).hexdigest(), "revisit" if i in kept else "response", str(kept.get(i))) for i, p in plain)
    assert sorted((str(r[0]), r[1], r[2], r[3], str(r[4])) for r in got.collect()) == want
    assert archives.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_payloads_come_back(spark, tmp_path):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    packages = archives.write(pages, str(tmp_path / "out"))
    with zipfile.ZipFile(packages.first().path) as z:  # another reader agrees that the package is sound
        assert z.testzip() is None and {"archive/data.warc.gz", "indexes/data.cdx", "datapackage.json"} <= set(z.namelist())
    got = {int(r.page_id): bytes(r.payload).decode() for r in archives.read(packages).collect() if r.payload is not None}
    want = {r.page_id: r.html for r in pages.collect()}
    assert got and all(want[i] == h for i, h in got.items())


def test_zip64_directory_is_read():
    """A package whose sizes and offsets are all in ZIP64 fields, behind a comment that holds the end mark."""
    data, name = b"payload", b"archive/x.warc.gz"
    local = b"PK\3\4" + struct.pack("<5HIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    start = 100
    body = b"\0" * start + local + data
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), start)
    entry = b"PK\1\2" + struct.pack("<6HIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), len(body))
    locator = b"PK\6\7" + struct.pack("<IQI", 0, len(body) + len(entry), 1)
    comment = b"a PK\5\6 comment"
    end = b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment
    whole = body + entry + end64 + locator + end
    assert list(archives.members(io.BytesIO(whole), len(whole))) == [(name.decode(), 0, start + len(local), len(data))]
    assert list(archives.stretches(io.BytesIO(whole), len(whole))) == [(start + len(local), len(data))]
    with pytest.raises(ValueError):
        list(archives.members(io.BytesIO(b"no package"), 10))
