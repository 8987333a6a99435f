from __future__ import annotations

import datetime as dt
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vectide.llm import html_text, url_filter, warc

PAGES = "page_id long, url string, html string"


# 4 -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<article><h1>A &amp; B</h1><p>one\n two<br>three<p>four</article><p>out", "A & B\n\none two three\n\nfour"),
        ("<nav>menu</nav><article><p>x<script>var a='<p>no</p>'</script> y</p><!-- <p>no --></article><footer>f</footer>", "x y"),
        ("<body><header>H</header><main><p>a</p><aside>s</aside><div class='ad-box'>buy</div><form>f<p>g</form><p>b</main></body>", "a\n\nb"),
        ("<article><p>a</p><div id='comments'><article><p>c</p></article></div><div class=\"cookie-notice\">k</div></article>", "a"),
        ("<article><header><h1>T</h1><p>by X</p></header><p>cut &lt;off", "T\n\ncut <off"),
        ("<div><p>one</p><ul><li>two<li>three</ul></div>", "one\n\ntwo\n\nthree"),
        ("<article><p><b>open<p>next</article>", "open\n\nnext"),
        ("<article><p>a<b>b</b>c <i>d</i></p><p hidden>no</p><p> &nbsp; </p></article>", "abc d"),
        ("<article><table><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></table></article>", "1 2\n\n3"),
        ("<main><p>Body text</p></main><article class=\"comment\"><p>Reader says hi</p></article>", "Body text"),
        ("<article><p>a</p></article><article class=\"comment\"><p>c</p></article><article><p>b</p></article>", "a\n\nb"),
        ("<article><h2 id=\"related-work\">Related work</h2><section id=\"search-methods\"><p>s</p></section></article>", "Related work\n\ns"),
        ("<article><p>one <a href=\"x\"\">two</a> three</p><p title=\"q\">four</p></article>", "one two three\n\nfour"),
        ("<article><p>a <button>b</p><p>rest</p></article>", "a\n\nrest"),
        ("<article><p>a <button>b</button> c <video><p>no</p></video> d</p></article>", "a c d"),
        ("<article><p>x <math><mi>y</mi></math> z</p></article>", "x y z"),
        ("<main><header><h1>T</h1><div>by me</div></header><p>a</p></main>", "T\n\na"),
        ("<main><p>a b c d e f g h i j k</p><article class=teaser><p>t</p></article></main>", "a b c d e f g h i j k\n\nt"),
        ("<article><div class='article-header'><h1>T</h1><span>by</span></div><p>a <span hidden>no</span>b</p></article>", "T\n\na b"),
        ("<article><p title=\"open>a</p><p>b</p></article>", "a\n\nb"),
        ("<article><div class=alert-systems>kept</div><p class='notice'>n</p><ul class='share-buttons'><li>s</ul></article>", "kept"),
        ("<article><select><option>x</select><p>a</p><p>b</article>", "a\n\nb"),
        ("<ARTICLE CLASS=post><P>Up</P></ARTICLE>", "Up"),
        ("<article><p>a < b and c</p></article>", "a < b and c"),
        ("<article><p>x</p><style>p{}", "x"),
        ("<div class='page has-sidebar' style='overflow:hidden' data-id='ad'><article><p>a</p><img alt='x>y' width=5>b</article></div>", "a\n\nb"),
        ("<article><div class=related-posts><p>r</div><section id='reader_comments'>c</section><p aria-hidden='true'>k<p>z</article>", "z"),
    ],
)
def test_page_blocks(page, text):
    assert "\n\n".join(html_text.article_of(html_text.page_blocks(page), set(), 6)) == text


def test_undecided_pages_lose_what_their_host_repeats(spark):
    boiler = "<div>Read all of our great stories every single day</div>"
    pages = [(i, f"http://a.example/{i}", f"<html><body>{boiler}<div>unique {i} words of page {i} here and there {i}</div></body></html>") for i in range(6)]
    pages += [(6, "http://b.example/", f"<body>{boiler}<div>other host</div></body>"), (7, None, None), (8, "http://a.example/8", ""), (9, "http://a.example/9", boiler)]
    pages += [(10, "http://c.example/1", "<div>copy of one page</div>"), (11, "http://c.example/2", "<div>copy of one page</div>"), pages[0]]
    got = Counter((r.page_id, r.text) for r in html_text.main_text(spark.createDataFrame(pages, PAGES)).collect())
    want = [(i, f"unique {i} words of page {i} here and there {i}") for i in range(6)]
    keep = "Read all of our great stories every single day"
    want += [(6, f"{keep}\n\nother host"), (7, ""), (8, ""), (9, keep), (10, "copy of one page"), (11, "copy of one page"), want[0]]
    assert got == Counter(want)


def brute_main_text(pages, long=6):
    """Compares every run of tokens of a page with every run of every other page of its host."""
    import re

    blocks = {h: html_text.page_blocks(h) for _, _, h in pages}
    host = lambda u: re.sub(r"^\w+://|/.*", "", u)
    border = lambda texts: [None, *(x for t in texts for x in [*t.split(" "), None])]
    grams = lambda h: [tuple(g[i : i + long]) for g in [border(html_text.stream_of(blocks[h]))] for i in range(len(g) - long + 1)]
    out = Counter()
    for i, u, h in pages:
        others = {g for _, v, x in pages if host(v) == host(u) and x != h for g in grams(x)}
        own = grams(h) if html_text.stream_of(blocks[h]) else []
        out[i, "\n\n".join(html_text.article_of(blocks[h], {k for k, g in enumerate(own) if g in others}, long))] += 1
    return out


def test_repeated_runs_of_a_host(spark):
    """Also inside articles, where only text outside paragraphs is open to removal, and the unique words choose the root."""
    import random

    rng = random.Random(5)
    word = lambda k=1: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(k))
    shared = [word(9) for _ in range(6)]
    pages = []
    for i in range(60):
        inner = "".join(rng.choice((f"<p>{rng.choice(shared)}</p>", f"<div>{rng.choice(shared)}</div>", f"<div>{word(3)} {rng.choice(shared)[:14]}</div>", f"<p>{word(8)}</p>", f"<div>{word(20)}</div>")) for _ in range(5))
        outer = rng.choice(("<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<main><article><p>one</p></article>{}</main>"))
        pages.append((i, f"http://{rng.choice('ab')}.example/{i}", f"<nav>{rng.choice(shared)}</nav>{outer.format(inner)}<div>{rng.choice(shared)}</div>"))
    got = html_text.main_text(spark.createDataFrame(pages, PAGES)).collect()
    want = brute_main_text(pages)
    assert Counter((r.page_id, r.text) for r in got) == want
    plain = Counter((i, "\n\n".join(html_text.article_of(html_text.page_blocks(h), set(), 6))) for i, _, h in pages)
    assert sum((plain - want).values()) > 20


def test_main_text_of_all_pages(spark, small):
    """Against the template of the test pages: what stands in article, block by block."""
    import html
    import re

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_main_text_of_no_pages(spark):
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


# 5 -----------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40
    other = "x" * 999
    pages = [(1, "http://a/", big), (2, "http://b/ c\r\nX: y", big), (3, None, None), (4, "u", other), (5, "u", other), (6, "u", "y" * 1000), (None, "u", big), (7, "u", "y" * 1000), (7, "u", "y" * 1000), (8, "u", "")]
    df = spark.createDataFrame(pages, PAGES).withColumns({"payload": F.lit(1), "refers_to": F.lit(2), "record_type": F.lit("z")})
    at = f"file://{tmp_path}/warc"
    got = warc.archive_pages(df, at).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    to = {1: 2, None: 2, 6: 7}
    want = Counter((i, len((t or "").encode()), sha(t), "revisit" if i in to else "response", to.get(i)) for i, _, t in pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    back = {(r.page_id, bytes(r.payload).decode()) for r in warc.read_archives(spark, at, with_payload=True).where("payload is not null").collect()}
    assert back == {(i, t or "") for i, _, t in pages if i not in to}
    assert warc.archive_pages(df.where("false"), f"file://{tmp_path}/none").count() == 0


def test_a_large_payload_has_a_file_of_its_own(spark, tmp_path):
    import gzip
    import re

    big, twin = "b" * (1 << 20) + "é", "t" * 2000
    pages = [(i, f"http://a/{i}", f"small page {i}") for i in range(50)] + [(50, "u", big), (51, "u", big), (52, "http://t/1", twin), (53, "http://t/2", twin), (None, None, twin)]
    at = f"file://{tmp_path}/warc"
    got = warc.archive_pages(spark.createDataFrame(pages, PAGES).coalesce(1), at).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter((i, *(("revisit", {50: 51, 52: 53, None: 53}[i]) if i in (50, 52, None) else ("response", None))) for i, *_ in pages)
    texts = [gzip.decompress(f.read_bytes()).decode() for f in sorted((tmp_path / "warc").glob("part-*"))]
    assert sorted(t.count("WARC-Record-ID") for t in texts) == [1, 1, 53]
    ids = re.findall("WARC-Record-ID: (.*)\r", "".join(texts))
    assert len(set(ids)) == len(pages)
    refers = re.findall("WARC-Refers-To: (.*)\r\nWARC-Refers-To-Target-URI: (.*)\r", "".join(texts))
    assert len(refers) == 3 and all(r in ids for r, _ in refers) and {u for _, u in refers} == {"u", "http://t/2"}
    assert warc.records_per_file(10, 1000, 100) > 1000 and warc.records_per_file(0, None, None) == 1


def test_warc_damage_is_noticed(spark, tmp_path):
    at = f"file://{tmp_path}/warc"
    df = spark.createDataFrame([(1, "http://a/", "payload of the page")], PAGES)
    warc.write_archives(warc.resolve_revisits(df), at, compression="none")
    for f in (tmp_path / "warc").glob("part-*"):
        f.write_bytes(f.read_bytes().replace(b"of the page", b"of the cage"))
    for crc in (tmp_path / "warc").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="isn't that of its digest"):
        warc.read_archives(spark, at).collect()


# 9 -----------------------------------------------------------------------------------------------------------
ENTRY = "list string, kind string, pattern string, day string, action string"


def test_validity_intervals(spark):
    rows = [("block", "host", "A.x", d, a) for d, a in (("2024-01-05", "add"), ("2024-01-05", "add"), ("2024-01-07", "add"), ("2024-01-09", "remove"), ("2024-01-20", "add"), ("2024-01-20", "remove"), ("2024-02-01", "add"))]
    rows += [("block", "host", "b.x", "2024-01-01", "remove"), ("block", None, "b.x", "2024-01-01", "add")]
    got = url_filter.validity_intervals(spark.createDataFrame(rows, ENTRY)).orderBy("since").collect()
    d = dt.date
    assert [(r.pattern, r.since, r.until) for r in got] == [("a.x", d(2024, 1, 5), d(2024, 1, 9)), ("a.x", d(2024, 2, 1), None)]


def test_captures_meet_the_entries_of_their_time(spark):
    entries = [
        ("block", "domain", "x.org", "2024-01-10", "add"), ("block", "domain", "x.org", "2024-02-10", "remove"), ("allow", "host", "ok.x.org", "2024-01-10", "add"),
        ("block", "url", "ok.x.org/bad?q=1", "2024-01-15", "add"), ("block", "host", "y.org", "2024-01-01", "add"),
    ]
    caps = [
        (1, "http://a.x.org/", "2024-01-09 23:59:59", 0, "", False), (2, "https://u:p@A.X.ORG:80/p#f", "2024-01-10 00:00:00", 1, "block:domain:x.org", True),
        (3, "http://ok.x.org/", "2024-01-11 00:00:00", 2, "allow:host:ok.x.org", False), (4, "http://ok.x.org/bad?q=1#z", "2024-01-20 00:00:00", 3, "block:url:ok.x.org/bad?q=1", True),
        (5, "http://a.x.org/", "2024-02-10 00:00:00", 0, "", False), (6, "http://notx.org/", "2024-01-20 00:00:00", 0, "", False), (7, None, "2024-01-20 00:00:00", 0, "", False),
        (8, "http://z.y.org/", "2024-01-20 00:00:00", 0, "", False), (9, "http://y.org./", None, 0, "", False), (None, "http://y.org./", "2024-01-20 00:00:00", 1, "block:host:y.org", True),
    ]
    caps = [*caps, caps[1], caps[1]]
    df = spark.createDataFrame([c[:3] for c in caps], "page_id long, url string, fetched_at string").withColumns({"kind": F.lit(1), "rule": F.lit(2), "n_active": F.lit(3)})
    got = url_filter.evaluate_captures(df, spark.createDataFrame(entries, ENTRY)).collect()
    assert Counter((r.page_id, r.n_active, r.rule, r.blocked) for r in got) == Counter((c[0], *c[3:]) for c in caps)
    assert url_filter.evaluate_captures(df.where("false"), spark.createDataFrame([], ENTRY)).count() == 0


def test_packed_blocks_are_the_same_and_much_smaller(spark, small):
    pages = [r.html or "" for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]
    odd = ["", "<p></p>", "<p>a\u2028b\x85c\x1cd\r\ne", "<article><p>one<p>two &#10; three</article>"]
    for page in [*pages, *odd]:
        blocks = html_text.page_blocks(page)
        assert html_text.unpacked_blocks(html_text.packed_blocks(blocks)) == blocks
    size = sum(len(html_text.packed_blocks(html_text.page_blocks(x))) for x in pages)
    assert size < 0.5 * sum(len(x.encode()) for x in pages)
    plan = html_text.main_text(spark.read.parquet(f"{small}/pages.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter") :]
    assert "blocks" in join and "html" not in join.split("MapInArrow")[0]
