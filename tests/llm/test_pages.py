import base64
import gzip
import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from cases import awkward
from rampart.llm import main_text, queries, url_filter, warc
from rampart.llm.common import Shared

FOLDER = "/root/testdata/sf0.001"

PAGE = """<html><head><title>t</title><script>if (a < b) { document.write("<p>no</p>"); }</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a>News</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site to do a great many things for you.</p></div>
<article class="post"><h1>A  title</h1><p>First &amp; long paragraph with a <a href="x">link</a> and <b>bo</b>ld text.<p>Second &lt;one&gt;<br>with a break.<div class=ad>Buy now</div><p>Last.</p>
<section id="comments"><p>A reader says something rather long about all of this, and goes on.</p></section></article>
<aside><p>Sidebar text that is long enough to be taken for text of the article, were it not in a sidebar.</p></aside><form>Your name <input></form><footer>&copy; all</footer></body></html>"""


def test_main_text_of_an_article():
    assert main_text.main_text(PAGE) == "A title First & long paragraph with a link and bold text. Second <one> with a break. Last."


def test_main_text_without_an_article_is_cut_at_surge_and_dive():
    page = PAGE.replace("<article", "<div").replace("</article>", "</div>")
    assert main_text.main_text(page) == "A title First & long paragraph with a link and bold text. Second <one> with a break. Last."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<b>b</b>c</p>", "abc"), ("<nav>menu</nav>", ""), ("1 < 2 and <p", "1 < 2 and"),
    ("<article><p>x &am", "x &am"), ("<article>a<!-- b", "a"), ("<article>a<script>b", "a"), ("<article>x&nbsp;&#233;&#x41;</article>", "x éA"), ("<p title='a>b'>c</p>", "c"), ("<p title=it's>d</p>", "d"),
])
def test_main_text_of_odd_pages(page, text):
    assert main_text.main_text(page) == text


def test_main_text_takes_long_pages_in_linear_time():
    body = "".join(f"<p>paragraph {i} of a very long page</p>" for i in range(20_000))
    assert main_text.main_text(f"<article>{body}</article>").count("paragraph") == 20_000
    assert main_text.main_text("<div>" * 50_000 + "x") == "x" and main_text.main_text("<b>" * 50_000 + "</i>" * 50_000) == ""


def test_loser_tree_merges():
    for runs in ([], [[]], [[1, 4], [], [2, 2, 9], [0]], [[3]] * 5, [list(range(i, 50, 7)) for i in range(7)]):
        assert list(warc.LoserTree([[(x,) for x in r] for r in runs])) == sorted((x,) for r in runs for x in r)


def test_extract_of_awkward_rows(spark):
    rows = [(1, PAGE), (1, PAGE), (None, "<p>x</p>"), (3, None), (4, "")]
    got = main_text.extract(awkward(spark, rows, ("page_id", "html"))).collect()
    assert Counter((r["page_id"], r["main_text"]) for r in got) == Counter((i, main_text.main_text(h)) for i, h in rows) and got[0]["key"] == "key"
    assert main_text.extract(awkward(spark, [], ("page_id", "html"))).count() == 0


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def rule(host, path):
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_url_rules_of_awkward_rows(spark):
    urls = ["http://A.Example.COM/en/1", "https://www.example.com/en/?a", "http://x.www.example.com/en/", "http://example.com", "http://example.com/en", "http://n.net/es/x", "http://net/fr/", "http://notnet/fr/",
            "http://a.org/x://y.com/", "no scheme", "", None, "://", "http:///p", "http://ÄB.org/é?x", "http://com?x/", "http://x.org/" + "a" * 20_000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])]
    got = url_filter.judge(awkward(spark, rows, ("page_id", "url")), queries.URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = host_path(r["url"])
        found = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, found and found.text)
        assert r["verdict"] == found.verdict if found else r["verdict"] in ("allow", "block")
    assert url_filter.judge(awkward(spark, [], ("page_id", "url")), queries.URL_RULES).count() == 0


def test_url_models_tell_held_out_urls_apart(spark):
    good = [f"http://ok.com/articles/story-{a}-{b}" for a in ("river", "garden", "music", "winter") for b in range(60)]
    bad = [f"http://no.net/es/{a}xx{b}zz" for a in ("qzx", "kqj", "zzk", "wqx") for b in range(60)]
    new = [(10_000 + i, f"http://new.org/articles/story-summer-{i}") for i in range(20)] + [(20_000 + i, f"http://new.org/es/qzkxx{i}zz") for i in range(20)]
    rows = [(i, u) for i, u in enumerate(good + bad)] + new
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    right = sum(got[i] == ("allow" if i < 20_000 else "block") for i, _ in new)
    assert right >= 36


def expected_records(rows):
    of = {}
    for i, h in rows:
        of.setdefault(h or "", []).append(i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        known = [x for x in of[h or ""] if x is not None]
        first = max(known) if known else None
        revisit = len(of[h or ""]) > 1 and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return Counter(out)


def test_archives_of_awkward_rows(spark, tmp_path):
    rows = [(1, "<p>same</p>"), (2, "<p>same</p>"), (3, "<p>same</p>"), (4, None), (5, ""), (6, "x\r\n\r\nWARC/1.0\r\n\r\ny"), (7, "é" * 50_000), (7, "é" * 50_000), (None, "alone"), (None, "<p>same</p>")]
    pages = awkward(spark, rows, ("page_id", "html")).withColumn("url", F.when(F.col("page_id") == 2, None).otherwise(F.concat(F.lit("http://H.example.org:80/\r\n"), "page_id")))
    index = warc.archive(pages, warc.ArchiveParams(file_bytes=50_000, range_rows=3), ts=F.lit(0)).collect()
    got = Counter((int(r["record"]) if r["record"] else None, r["payload_bytes"], r["payload_digest"], r["record_type"], int(r["refers_to"]) if r["refers_to"] else None) for r in index)
    assert got == expected_records(rows) and all(r["digest_ok"] for r in index)
    keys = [(r["url_key"], r["ts"], r["record"]) for r in index]
    assert keys == sorted(keys)
    assert warc.archive(awkward(spark, [], ("page_id", "html")).withColumn("url", F.lit("x"))).count() == 0
    shared = Shared(spark, "test")
    warc.write_archives(warc.captures(pages, shared), str(tmp_path / "w"), 3)
    records = [h for p in (tmp_path / "w").glob("part-*.gz") for _, h, _ in warc.read_records(gzip.decompress(p.read_bytes()))]
    assert len(records) == len(rows) and all(h["warc-type"] in ("response", "revisit") for h in records)


def test_registered_page_queries_against_brute_force(spark):
    pages = duckdb.connect().execute(f"select page_id, url, html from '{FOLDER}/pages.parquet'").fetchall()
    texts = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.QUERIES["op1_main_text"](spark, FOLDER).collect()}
    assert texts == {i: (main_text.main_text(h), len(main_text.main_text(h))) for i, _, h in pages}
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.QUERIES["op10_warc"](spark, FOLDER).collect())
    assert got == expected_records([(i, h) for i, _, h in pages])
    for r in queries.QUERIES["op2_url_filter"](spark, FOLDER).collect():
        url = next(u for i, u, _ in pages if i == r["page_id"])
        assert (r["host"], r["path"]) == host_path(url)
