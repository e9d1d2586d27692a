"""URL trie, page text and WARC archives."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from hazewell.llm import html_text, url_filter, warc
from hazewell.session import shared_dir, stored

PAGES = "page_id long, url string, html string"


def plain_verdict(rules, host, path):
    fits = [(host.count(".") if not h else h.count(".") + 1 if h else 0, len(p), h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(((0 if not r[2].split("/")[0] else r[0], *r[1:]) for r in fits), default=None)


RULES = [*url_filter.RULES, ("", "/x", "block"), ("a.b", "/pre", "block"), ("a.b", "/pre/deep/", "allow"), ("b", "", "allow"), ("a.b", "/pre", "allow")]
URLS = [
    None, "", "no scheme.com/en/", "http://EXAMPLE.com/en/1", "http://www.example.com/en/1", "http://badexample.com/en/1", "http://x.www.example.com/en/?q", "http://com", "http://com/",
    "http://q.net/es/a#b", "http://q.net/es", "ftp://net/fr/", "http://a.b/prefix", "http://a.b/pre/deep/er", "http://a.b/pre/deeper", "http://z/xyz", "http://user@com:80/x", "http://..com/", "a://b://c.com/",
    "http://c.a.b?pre", "http://a.b/pre\n/deep/", "http://" + "l." * 200 + "com/" + "s/" * 300,
]


@pytest.fixture(scope="module")
def judged(frame):
    pages = frame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, None, "x", "y")], "page_id long, url string, rule string, host string")
    return pages


def test_trie_agrees_with_all_rules_tried_one_by_one(judged):
    rules = [*url_filter.RULES, ("", "/x", "block"), ("a.b", "/pre/deep/", "allow"), ("a.b", "/pre", "block"), ("b", "", "allow")]
    out = url_filter.filter_urls(judged, rules).collect()
    assert len(out) == len(URLS) + 1 and set(out[0].asDict()) == {"page_id", "url", "host", "path", "rule", "verdict"}
    for r in out:
        best = plain_verdict(rules, r.host, r.path)
        assert (r.rule, r.verdict) == ((best[2], best[3]) if best else (None, "allow")), r
    null = [r for r in out if r.url is None]
    assert len(null) == 2 and all(r.host == r.path == "" and r.rule is None for r in null)


def test_rules_too_many_for_a_broadcast_join_to_the_same_verdicts(judged, frame, monkeypatch):
    rules = [*url_filter.RULES, ("", "/x", "block"), ("a.b", "/pre/deep/", "allow"), ("a.b", "/pre", "block"), ("b", "", "allow")]
    want = sorted(map(tuple, url_filter.filter_urls(judged, rules).collect()), key=repr)
    table = frame(rules, "host string, path string, verdict string")
    assert sorted(map(tuple, url_filter.filter_urls(judged, table).collect()), key=repr) == want
    monkeypatch.setattr(url_filter, "MAX_RULES", 2)
    assert sorted(map(tuple, url_filter.filter_urls(judged, table).collect()), key=repr) == want
    with pytest.raises(ValueError):
        url_filter.filter_urls(judged, rules)


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_of_equal_rules_block_counts_in_any_order(frame, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MAX_RULES", most)
    pages = frame([(1, "http://x.com/a/" + "b/" * 4000), (2, "http://y.com/c")], "page_id long, url string")
    for rules in ([("com", "/", "allow"), ("com", "/", "block"), ("com", "/c", "allow")], [("com", "/c", "allow"), ("com", "/", "block"), ("com", "/", "allow")]):
        out = url_filter.filter_urls(pages, frame(rules, "host string, path string, verdict string")).collect()
        assert sorted((r.page_id, r.rule, r.verdict) for r in out) == [(1, "com/", "block"), (2, "com/c", "allow")]


def test_no_pages_no_verdicts(frame):
    assert url_filter.filter_urls(frame([], PAGES)).count() == 0


ARTICLE = "<article><h1>Head &amp; line</h1><p>First\n  <b>bold</b> text.<p>Second&nbsp;one &lt;tag&gt; &copy<br>more</p><div class='share-bar'>Share me</div></article>"
NOISE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body class='has-sidebar'>"
    "<header>Top</header><div class='site-header'>Brand</div><nav><ul><li><a href='/'>Home</a></ul></nav><!-- <p>hidden</p> --><div class=\"ad\">Buy</div><div id='cookie-notice'>Cookies</div>"
)
REST = "<section class='comments'><h2>Comments</h2><p>Nice</p><article class='comment'>Me too</article></section><ol class='commentlist'><li>Third</ol><aside>Side</aside><form><p>Field</p><button>Go</button></form><footer>&copy; me</footer></body></html>"


def test_only_the_article_is_left(frame):
    rows = [
        (1, "http://h/1", NOISE + ARTICLE + REST), (2, None, None), (3, "http://h/3", ""), (4, "x", "just text &amp; more"), (5, "http://h/5", NOISE + "<div><p>Plain</p> tail</div>" + REST),
        (6, "http://h/6", "<p>cut <a href='x"), (7, "http://h/7", "<script>never closed"), (8, "http://h/8", "<div title='a>b'>q</div></p></nav>"), (9, "http://h/9", "<p>" + "word " * 200_000),
    ]
    out = {r.page_id: r for r in html_text.extract(frame([(*r, "t", 5) for r in [*rows, rows[0]]], PAGES + ", text string, n_chars int")).collect()}
    assert out[1].text == "Head & line\nFirst bold text.\nSecond one <tag> © more"
    assert (out[2].text, out[2].n_chars, out[3].text) == ("", 0, "")
    assert (out[4].text, out[5].text, out[6].text, out[7].text, out[8].text) == ("just text & more", "Plain\ntail", "cut", "", "q")
    assert out[9].n_chars == 5 * 200_000 - 1
    assert html_text.extract(frame([], PAGES)).count() == 0


def test_no_name_alone_drops_the_text():
    prose = "A long first paragraph of the article, with all that it has to say."
    text = lambda page: [b.text for b in html_text.main_blocks(html_text.parse(page)[0])]
    for page in (
        f"<body><article class='post comments-open'><p>{prose}</p></article></body>", f"<body><div class='content has-sidebar'><p>{prose}</p></div></body>",
        f"<body><div class='search-page'><p>{prose}</p></div></body>", f"<body><article class='related'><div id='form'><p>{prose}</p></div></article></body>",
    ):
        assert text(page) == [prose]
    # a teaser in an article does not drop the text beside it, and names still remove comments
    assert text(f"<body><article><p>Teaser</p></article><div><p>{prose}</p></div><div class='comments'><p>Nice</p></div></body>") == ["Teaser", prose]
    assert text(f"<body><article><p>{prose}</p></article><div class='comments'><p>{prose} {prose}</p></div></body>") == [prose]


def test_style_tree_removes_what_every_page_of_a_host_repeats(frame, words):
    page = lambda i: f"<div class='wrap'><div class='body'><h1>{' '.join(words(5, i))}</h1><p>{' '.join(words(40, i + 999))}</p></div><div class='tagline'>The same on all pages</div></div>"
    rows = [(i, "http://site.example/" + str(i), page(i)) for i in range(30)]
    copies = [(100 + i, "http://copy.example/" + str(i), page(7)) for i in range(40)]  # equal pages are no template
    out = {r.page_id: r.text for r in html_text.extract(frame(rows + copies, PAGES)).collect()}
    assert all("same on all" not in out[i] and out[i].count("\n") == 1 for i in range(30))
    assert all(out[100 + i].endswith("The same on all pages") for i in range(40))


def test_style_tree_needs_few_pages_and_not_a_share_of_the_text(frame, words):
    page = lambda i, n, note: f"<div class='wrap'><div class='body'><p>{' '.join(words(n, i))}</p></div><div class='tagline'>{note}</div></div>"
    note, long = "The same on all pages", "The same on all pages and much longer than any article " * 9
    rows = [(10 * k + i, f"http://site{k}.example/{i}", page(10 * k + i, 40, note)) for k in (1, 3, 5) for i in range(k)]
    rows += [(100 + i, f"http://long.example/{i}", page(100 + i, 12, long)) for i in range(25)]
    rows += [(200 + i, f"http://near.example/{i}", f"<div class='wrap'><h1>{' '.join(words(3, 300 + i))}</h1><p>{' '.join(words(60, 7))}</p></div>") for i in range(3)]
    out = {r.page_id: r.text for r in html_text.extract(frame(rows, PAGES)).collect()}
    assert note in out[10]  # one page tells nothing
    assert all(out[i] == " ".join(words(40, i)) for i in (*range(30, 33), *range(50, 55)))
    assert all(out[100 + i] == " ".join(words(12, 100 + i)) for i in range(25))
    assert all(out[200 + i].endswith(" ".join(words(60, 7))) for i in range(3))  # three near copies are no template


def test_archives_give_every_page_back(spark, frame, tmp_path):
    big = "é" * 3_000_000
    rows = [(5, "http://a/\r\nX: 1%", "x" * 100), (3, None, "x" * 100), (9, "u", "x" * 100), (9, "u", "x" * 100), (1, "v", "y" * 99), (2, "v", "y" * 99), (4, "w", None), (None, "n", "x" * 100), (6, "b", big), (7, "b", big), (None, "z", "z" * 200), (None, "z", "z" * 200)]
    folder = shared_dir(spark, f"test-{tmp_path.name}")
    files = stored(warc.write(frame([(*r, "clash") for r in rows], PAGES + ", payload string"), folder), "t")
    assert files.agg(F.sum("n_records")).first()[0] == len(rows)
    got = sorted((tuple(r) for r in warc.read(spark, folder).select("page_id", "target", "record_type", "refers_to", "payload_bytes", "payload_digest", F.length("payload")).collect()), key=repr)
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        first = min((p for p, _, x in rows if (x or "").encode() == data and p is not None), default=None)
        again = len(data) >= 100 and first is not None and i != first
        want.append((i, u, "revisit" if again else "response", first if again else None, len(data), hashlib.sha256(data).hexdigest(), None if again else len(data)))
    assert got == sorted(want, key=repr)
    path = folder.removeprefix("file://")
    for name in os.listdir(path):
        if name.endswith(".gz"):  # any gzip reader sees plain records
            assert gzip.open(os.path.join(path, name)).read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_header_filters_are_pushed_and_payloads_skipped(spark, frame, tmp_path):
    folder = shared_dir(spark, f"test-{tmp_path.name}")
    stored(warc.write(frame([(i, f"t{i % 3}", "same" * 50 if i % 2 else "body %d " % i * 40) for i in range(60)], PAGES), folder), "t")
    some = warc.read(spark, folder, ["page_id", "record_type", "target"]).filter("record_type = 'revisit' AND page_id >= 30 AND target IN ('t1', 't2')")
    assert sorted(r.page_id for r in some.collect()) == [i for i in range(31, 60, 2) if i % 3]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter [" not in plan and "BatchScan warc" in plan, plan
    # damage every payload: reading headers alone does not notice, reading payloads does
    path = folder.removeprefix("file://")
    for name in [n for n in os.listdir(path) if n.endswith(".gz")]:
        data = bytearray(open(os.path.join(path, name), "rb").read())
        at, n = 0, 0
        while at < len(data):
            size = int.from_bytes(data[at + 16 : at + 20], "little")
            if n % 2:
                data[at + size - 9] ^= 0xFF
            at, n = at + size, n + 1
        open(os.path.join(path, name), "wb").write(data)
        if os.path.exists(crc := os.path.join(path, f".{name}.crc")):
            os.unlink(crc)
    assert warc.read(spark, folder, ["page_id"]).count() == 60
    with pytest.raises(Exception, match="(?i)error|incorrect|damaged|invalid"):
        warc.read(spark, folder).collect()


def test_large_archives_are_cut_at_records(spark, frame, tmp_path):
    folder = shared_dir(spark, f"test-{tmp_path.name}")
    stored(warc.write(frame([(i, "t", os.urandom(300).hex()) for i in range(200)], PAGES), folder), "t")
    spark.dataSource.register(warc.WarcSource)
    cut = spark.read.format("warc").option("columns", "page_id").option("splitBytes", "5000").load(folder)
    assert cut.rdd.getNumPartitions() > 8 and sorted(r.page_id for r in cut.collect()) == list(range(200))
    assert warc.write(frame([], PAGES), folder + "-none").count() == 0
