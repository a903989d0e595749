import gzip
import hashlib
import html.parser
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ndcollect.llm import decontam, sentencepiece_bridge, url_filter, warc
from ndcollect.llm.queries import RULES, TOKENIZER


class Plain(html.parser.HTMLParser):
    """The standard library's reading of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.hidden = tag
        elif tag in warc._BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None
            self.out.append(" ")
        elif tag in warc._BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_decl(self, decl):
        self.out.append(" ")


def plain(page):
    p = Plain()
    p.feed(page)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def test_text_of_pages_as_the_standard_parser_reads_them(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert warc.text_of_html(r.html) == plain(r.html)


@pytest.mark.parametrize("page,text", [("", ""), ("a < b", "a < b"), ("<p>x<p>y", "x\ny"), ("<script>var t='</p>';</script>z", "z"), ("<!-- <p> -->q", "q"), ("<a title='>'>k</a>", "k"), ("&lt;b&gt; &amp;amp;", "<b> &amp;"), ("<script>open", ""), ("<" * 50_000, "<" * 50_000)])
def test_odd_markup(page, text):
    assert warc.text_of_html(page) == text


def test_derivatives_link_back_and_keep_digests(spark):
    schema = "record_id string, target_uri string, date string, http_headers string, payload string, type string"
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nServer: x"
    body = '<html lang="de"><title>T &amp; U</title><p>Hallo<a href="/n?a=1&amp;b=2">n</a></html>'
    rows = [("<urn:uuid:1>", "http://a/b", "2024-01-01T00:00:00Z", head, body, "c"), (None, None, None, None, None, None), ("<urn:uuid:3>", "http://a/i", None, "HTTP/1.1 200 OK\r\nContent-Type: image/png", "png", "c")]
    got = warc.derive(spark.createDataFrame(rows + rows[:1], schema)).collect()
    assert len(got) == 8
    meta, text = (next(r for r in got if r.refers_to == "<urn:uuid:1>" and r.type == t) for t in ("metadata", "conversion"))
    sha1 = warc.digest(body.encode())
    block = meta.block.decode()
    assert f"source-payload-digest: {sha1}\r\n" in block and "http-header-server: x" in block and "title: T & U" in block and "outlink: /n?a=1&b=2" in block and "language: de" in block
    assert text.block.decode() == "T & U\nHallon" and text.payload_digest == sha1 and text.block_digest == warc.digest(text.block)
    written = b"".join(warc.write_record(r.headers, bytes(r.block)) for r in got)
    back = list(warc.read_records(written))
    assert len(back) == 8 and all(len(b) == int(h["content-length"]) for h, b in back)
    assert back[0][0]["warc-refers-to"] == "<urn:uuid:1>" and back[0][0]["warc-refers-to-target-uri"] == "http://a/b"
    assert "warc-target-uri" not in back[2][0] and next(r for r in got if r.refers_to == "<urn:uuid:3>" and r.type == "conversion").block == b""
    assert warc.derive(spark.createDataFrame([], schema)).count() == 0


def test_binary_and_coded_payloads(spark, tmp_path):
    import zlib

    page = "<html><meta charset=iso-8859-1><title>Stra\xdfe</title><p>\xe9t\xe9</html>"
    png = bytes(range(256)) * 3
    head = lambda kind, *more: "\r\n".join(["HTTP/1.1 200 OK", f"Content-Type: {kind}", *more])
    packed = gzip.compress(page.encode("latin-1"))
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(packed[i : i + 20]), packed[i : i + 20]) for i in range(0, len(packed), 20)) + b"0\r\n\r\n"
    cases = [
        (head("image/png"), png, ""), (head("text/html; charset=ISO-8859-1"), page.encode("latin-1"), "Stra\xdfe\n\xe9t\xe9"), (head("text/html"), page.encode("latin-1"), "Stra\xdfe\n\xe9t\xe9"),
        (head("text/html", "Content-Encoding: gzip", "Transfer-Encoding: chunked"), chunked, "Stra\xdfe\n\xe9t\xe9"), (head("text/plain", "Content-Encoding: deflate"), zlib.compress(b"a\tb"), "a\tb"), (head("text/html", "Content-Encoding: br"), b"\x0b\x02", ""),
        (head("text/html", "Content-Encoding: gzip"), b"\x1f\x8bbroken", ""), (head("text/html; charset=nonsense"), b"<p>\xff", "\ufffd"), (head("text/html"), b"", ""),
    ]
    blocks = [h.encode("latin-1") + b"\r\n\r\n" + p for h, p, _ in cases]
    fields = [[("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{i}>"), ("WARC-Target-URI", f"http://h/{i}"), ("WARC-Date", "2024-05-06T07:08:09Z"), ("WARC-IP-Address", "10.0.0.1"), ("WARC-Block-Digest", warc.digest(b)), ("WARC-Payload-Digest", warc.digest(c[1]))] for i, (b, c) in enumerate(zip(blocks, cases))]
    info = warc.write_record(warc.header_block([("WARC-Type", "warcinfo")], 4), b"a: b")
    for name, compress in (("a.warc.gz", True), ("b.warc", False)):
        (tmp_path / name).write_bytes((info if compress else b"") + b"".join(warc.write_record(warc.header_block(f, len(b)), b, compress) for f, b in zip(fields, blocks)))
    rows = warc.responses_of_files(spark, f"{tmp_path}/*")
    assert sorted((r.record_id, bytes(r.payload)) for r in rows.collect()) == sorted([(f"<urn:uuid:{i}>", c[1]) for i, c in enumerate(cases)] * 2)
    got = warc.derive(rows.where("record_id IS NOT NULL")).collect()
    assert len(got) == 4 * len(cases)
    for i, (h, payload, text) in enumerate(cases):
        own = [r for r in got if r.refers_to == f"<urn:uuid:{i}>"]
        meta, conversion = ([r for r in own if r.type == t] for t in ("metadata", "conversion"))
        assert len(meta) == len(conversion) == 2 and {r.block.decode() for r in conversion} == {text}
        for r in meta:
            about = [tuple(x.split(": ", 1)) for x in r.block.decode().split("\r\n") if x]
            expected = {("source-block-digest", warc.digest(blocks[i])), ("source-payload-digest", warc.digest(payload)), ("source-header-warc-block-digest", warc.digest(blocks[i])), ("source-header-warc-payload-digest", warc.digest(payload)), ("source-header-warc-ip-address", "10.0.0.1"), ("source-header-warc-date", "2024-05-06T07:08:09Z"), ("http-status", "HTTP/1.1 200 OK")}
            assert expected <= set(about) and {("http-header-" + k.lower(), v) for k, v in (x.split(": ") for x in h.split("\r\n")[1:])} <= set(about)
        for r in own:
            assert r.payload_digest == warc.digest(payload) and r.block_digest == warc.digest(r.block)
            assert dict(x.split(": ", 1) for x in r.headers.split("\r\n")[1:] if x) == {"WARC-Type": r.type, "WARC-Record-ID": r.record_id, "WARC-Refers-To": r.refers_to, "WARC-Target-URI": f"http://h/{i}", "WARC-Date": "2024-05-06T07:08:09Z", "WARC-Refers-To-Target-URI": f"http://h/{i}", "WARC-Refers-To-Date": "2024-05-06T07:08:09Z", "WARC-Block-Digest": r.block_digest, "Content-Type": r.content_type, "Content-Length": str(len(r.block))}
    with pytest.raises(ValueError):
        list(warc.read_records(info[:0] + warc.write_record(warc.header_block([("WARC-Type", "response")], 9), b"abc", False)))


def test_records_of_pages_against_the_standard_library(spark):
    import base64

    from ndcollect.llm import queries

    class Links(html.parser.HTMLParser):
        found: list

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.found += [v.strip() for k, v in attrs if k == "href" and v]

    sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    records = {(r.target_uri, r.payload_digest, r.type): r for r in warc.derive(warc.responses_of_pages(pages)).collect()}
    listed = {r.record_id: r for r in queries.op1_warc_derivatives(spark, "/root/testdata/sf0.001").collect()}
    rows = pages.collect()
    assert len(listed) == 2 * len(rows)
    for r in rows:
        body = r.html.encode()
        meta, text = (records[r.url, sha1(body), t] for t in ("metadata", "conversion"))
        assert bytes(text.block).decode() == plain(r.html) and meta.refers_to == text.refers_to
        about = [x.split(": ", 1) for x in bytes(meta.block).decode().split("\r\n") if x]
        links = Links()
        links.found = []
        links.feed(r.html)
        assert [x[1] for x in about if x[0] == "outlink"] == [" ".join(x.split()) for x in links.found]
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
        assert ["source-block-digest", sha1(http + body)] in about and ["source-payload-length", str(len(body))] in about
        for x in (meta, text):
            own = listed[x.record_id]
            assert (own.block_bytes, own.block_digest, own.headers_sha256) == (len(x.block), sha1(bytes(x.block)), hashlib.sha256(x.headers.encode()).hexdigest())


def test_reading_plain_and_broken_files():
    one = warc.write_record(warc.header_block([("WARC-Type", "response")], 3), b"abc", False)
    assert [b for _, b in warc.read_records(one + one)] == [b"abc"] * 2 == [b for _, b in warc.read_records(gzip.compress(one) + gzip.compress(one))]
    with pytest.raises(ValueError):
        list(warc.read_records(b"nonsense\r\n\r\n"))
    assert warc.split_http(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody") == ("HTTP/1.1 200 OK\r\nA: b", b"body")


def test_url_parts_and_rules(spark):
    urls = {1: "HTTP://WWW.Example.COM/En/x?q", 2: "http://example.com/en/", 3: "http://a.example.com", 4: "https://x.net/fr/1#f", 5: None, 6: "no scheme", 7: "http://h.net/es?x=://y/", 8: "http://com/", 9: "http://notexample.com/en/a", 10: "http://É.org/a", 11: "http://www.example.com/en/x", 12: "http://www.example.com/de/x", 13: "http://a.www.example.com/en/"}
    pages = spark.createDataFrame([(i, u, "x", "v") for i, u in urls.items()], "page_id long, url string, html string, verdict string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none, RULES).collect()}
    assert got == {
        1: ("www.example.com", "/En/x", "com/", "allow"), 2: ("example.com", "/en/", "example.com/en/", "block"), 3: ("a.example.com", "", None, "allow"), 4: ("x.net", "/fr/1", "net/fr/", "block"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("h.net", "/es", None, "allow"), 8: ("com", "/", "com/", "allow"), 9: ("notexample.com", "/en/a", "com/", "allow"), 10: ("É.org", "/a", None, "allow"),
        11: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 12: ("www.example.com", "/de/x", "com/", "allow"), 13: ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    }
    assert url_filter.judge(pages.limit(0), none, RULES).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    rng = random.Random(1)
    pages, outcomes = [], []
    for h, n, p in (("bad.x.org", 200, 0.9), ("good.x.org", 200, 0.02), ("new.bad.org", 1, 1.0), ("other.y.org", 300, 0.05), ("z.co.uk", 50, 0.1)):
        for _ in range(n):
            pages.append((len(pages), f"http://{h}/p"))
            outcomes.append((len(pages) - 1, int(rng.random() < p)))
    pages.append((len(pages), "http://never.seen.org/"))
    got = {r.host: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([*outcomes, (None, 1), (3, None), (10**6, 1)], "page_id long, bad int"), []).collect()}
    assert got == {"bad.x.org": "block", "good.x.org": "allow", "new.bad.org": "allow", "other.y.org": "allow", "z.co.uk": "allow", "never.seen.org": "allow"}


def test_hosts_without_outcomes_are_judged_by_their_domain(spark):
    rng = random.Random(3)
    pages, outcomes = [], []
    for h, n, p in (("a.bad.org", 300, 0.95), ("b.bad.org", 300, 0.9), ("a.good.org", 300, 0.02), ("b.good.org", 300, 0.03), ("x.mild.net", 300, 0.05)):
        for _ in range(n):
            pages.append((len(pages), f"http://{h}/p"))
            outcomes.append((len(pages) - 1, int(rng.random() < p)))
    for h in ("new.bad.org", "deep.new.bad.org:8080", "bad.org", "new.good.org", "new.other.org", "new.other.xyz"):
        pages += [(len(pages) + k, f"http://{h}/{k}") for k in range(2)]
    pages.append((len(pages), None))
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), []).collect()
    got = {r.host: r.verdict for r in rows}
    assert len(rows) == len(pages) and {h for h, v in got.items() if v == "block"} == {"a.bad.org", "b.bad.org", "new.bad.org", "deep.new.bad.org:8080", "bad.org"}


def test_query_and_sql_agree_on_hosts_without_outcomes(spark, tmp_path):
    import duckdb

    from ndcollect.llm import queries

    rng = random.Random(5)
    pages, labels = [], []
    for h, n, p in (("a.bad.org", 90, 0.95), ("b.bad.org", 70, 0.9), ("a.good.org", 80, 0.02), ("b.good.org", 60, 0.05), ("x.y.co.uk", 40, 0.3), ("10.0.0.1", 9, 0.9), ("q.z.co.uk:80", 30, 0.8)):
        for _ in range(n):
            labels.append((len(pages), int(rng.random() >= p), 0))
            pages.append((len(pages), f"http://{h}/p"))
    for h in ("new.bad.org", "bad.org:8080", "c.good.org", "w.y.co.uk", "k.co.uk", "co.uk", "10.0.0.2", "localhost", "new.other.xyz", "x" * 100_000, "a..b", "www.example.com/en", "www.example.com/en/q"):
        pages += [(len(pages) + k, f"http://{h}/{k}") for k in range(2)]
    pages += [(9000, None), (9001, "no scheme"), (9002, "http://a.bad.org/" + "y" * 100_000)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = queries.op9_url_filter(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()['op9_url_filter']})").fetchall()
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(want, key=repr) and {h for _, h, *_, r in rows if r == "block"} >= {"new.bad.org", "bad.org:8080", "a.bad.org"}


def test_public_suffix_lists(spark):
    rules = url_filter.suffix_rules("// remarks\ncom\nuk\nco.uk\n\n*.ck\n!www.ck\nk12.ca.us  x\n")
    hosts = {"a.b.com": ("b.com", "com"), "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.z.ck": ("y.z.ck", "z.ck"), "a.www.ck": ("www.ck", "ck"), "s.k12.ca.us:80": ("s.k12.ca.us", "k12.ca.us"), "a.b.org": ("b.org", "org"), "1.2.3.4": ("1.2.3.4", ""), "": ("", "")}
    domain, suffix = url_filter.domain_and_suffix(F.col("host"), rules)
    got = {r.host: (r.d, r.s) for r in spark.createDataFrame([(h,) for h in hosts], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect()}
    assert got == hosts


def brute_hits(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, whose, nameless = decontam.words_of(t), set(), set(), 0
        for item, text in items:
            x = decontam.words_of(text)
            m = min(window, len(x))
            wins = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)} if m else set()
            for k in range(len(w) - m + 1 if m else 0):
                if tuple(w[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    if item is None:
                        nameless = 1
                    else:
                        whose.add(str(item))
        out.append((i, len(w), len(hit), len(whose) + nameless, hashlib.sha256(",".join(sorted(whose)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string")


@pytest.mark.parametrize("block_words", [200_000, 150])
def test_decontamination_against_brute_force(spark, docs_of, block_words):
    rng = random.Random(7)
    make = lambda n, k=6: " ".join(rng.choice("abcdefgh"[:k]) + rng.choice("xyZ") for _ in range(n))
    items = [(i, make(rng.randrange(8, 40))) for i in range(25)] + [(30, "ax by"), (31, None), (32, "..."), (33, "ax by"), (None, "ax ax"), (None, make(12)), (40, make(400)), (2, make(15)), (34, "Ünï-code; Ünï 12")]
    docs = [(i, make(rng.randrange(0, 120), 8) + " " + (items[rng.randrange(25)][1] if i % 3 == 0 else "")) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "AX, by!"), (103, make(30_000)), (None, items[3][1]), (106, "q " + items[-3][1][30:300]), (107, "ax ax"), docs[0], (104, "ünï code ÜNÏ 12"), (105, "Ünï code Ünï 12")]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(docs_of(docs), bench(spark, items), block_words=block_words).collect()), key=repr)
    assert got == brute_hits(docs, items)


def test_decontaminated_texts(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(30))
    clean = "Nothing to see, really nothing: " * 3
    docs = docs_of([(1, clean + item.upper() + "! The end of a text with enough other words that it may stay here, " + clean), (2, item), (3, clean), (4, None)])
    rows = {r.doc_id: r for r in decontam.decontaminate(docs, bench(spark, [(1, item)])).collect()}
    assert set(rows) == {1, 3, 4} and rows[3].text == clean and rows[4].text is None and rows[3].n_chars == len(clean)
    assert rows[1].text == clean + "! The end of a text with enough other words that it may stay here, " + clean and rows[1].n_chars == len(rows[1].text) and rows[1].kept == "x"
    odd = docs.withColumn("__spans", F.lit(1)).withColumn("__Items", F.lit("x"))
    for words in (200_000, 15):
        got = decontam.decontaminate(odd, bench(spark, [(1, item)]), block_words=words)
        assert got.columns == odd.columns and {r.doc_id: r.text for r in got.collect()} == {i: r.text for i, r in rows.items()}
    assert decontam.decontaminate(docs, bench(spark, [])).count() == 4 and decontam.report(docs.limit(0), bench(spark, [(1, item)])).count() == 0


TEXTS = ["", " ", "  a  b ", "\n\nx\t", "日本語 テスト 😀 ▁x", "a\0b", "ﬁ ½ é", "<s> </s> <unk>", "<0x41>", " " * 50 + "z", "aaaaaaa" * 100, "The quick brown fox. " * 500]


def test_ids_are_those_of_the_library_and_decode(spark, docs_of):
    docs = docs_of([*enumerate(TEXTS), (100, None), (None, "null id"), (3, TEXTS[3])])
    encoded = sentencepiece_bridge.encode(docs, TOKENIZER, parity_every=1)
    rows = encoded.collect()
    assert len(rows) == len(TEXTS) + 3 and all(r.parity and r.round_trip for r in rows)
    back = {r.doc_id: r.text for r in sentencepiece_bridge.decode(encoded, TOKENIZER).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(TEXTS)) and back[100] == ""
    assert sentencepiece_bridge.encode(docs.limit(0), TOKENIZER).count() == 0


def test_every_row_has_a_parity_that_tells(spark, docs_of, monkeypatch):
    docs = docs_of([*enumerate(TEXTS), (100, None), (None, "null id")])
    assert all(r.parity is True and r.round_trip for r in sentencepiece_bridge.encode(docs, TOKENIZER).collect())
    with open(TOKENIZER, "rb") as f:
        codec = sentencepiece_bridge.Codec(f.read())
    assert codec.by_word
    own = codec.reference
    monkeypatch.setattr(codec, "reference", lambda texts: [[*ids, 0] if t == "fox." else ids for t, ids in zip(texts, own(texts))])
    texts = ["a quick fox. ran", "a quick fox ran", "", "fox."]
    assert codec.parities(texts, codec.packed(texts)) == [False, True, True, False] == codec.parities(texts, codec.packed(texts))


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        import struct

        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def test_a_unigram_model_with_byte_fallback():
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), ("▁", -3.0, 1), ("▁a", -2.0, 1), ("b", -2.5, 1), ("ab", -4.0, 1), ("▁ab", -2.2, 1), ("c", -3.5, 1), ("a", -3.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(4, len(pieces)) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    codec = sentencepiece_bridge.Codec(data)
    assert codec.model.kind == sentencepiece_bridge.UNIGRAM and codec.model.byte_fallback
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab abc", "a b c", "abab é", "", "ccc"]
    assert codec.encode(texts) == [reference.encode(t) for t in texts] and codec.decode(codec.encode(texts)) == texts


PIECES = [("▁", -3.0), ("▁a", -2.0), ("b", -2.5), ("ab", -4.0), ("▁ab", -2.2), ("c", -3.5), ("a", -3.0), ("f", -3.1), ("fi", -3.3), ("i", -3.2), ("é", -4.0), ("1", -3.0), ("▁▁", -6.0)]
SPELLINGS = ["ab abc", "abab é", "", "ccc", " ", "  a  b ", "a  ", "ﬁ ﬁfi", "Ａｂ　ｃ", "é ½ ①", "a\tb\nc", "a b\u200bc", "日本 😀 x", "ab<x>c <x> a", "a\0b", "▁a b▁", "ﬁ\u0301", "e\u0301 a\u0301\u0302", " " * 30 + "z", "ABC É ß İ", "\0", "half ﬁ " * 2000]


@pytest.mark.parametrize("kind", [sentencepiece_bridge.UNIGRAM, sentencepiece_bridge.BPE])
@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nmt_nfkc_cf"])
def test_normalisers_white_space_and_user_defined_pieces_against_the_library(kind, rule):
    import sentencepiece

    rng = random.Random(5)
    texts = SPELLINGS + ["".join(rng.choice("ab c\t ﬁéＡ1①　 x\u0301") for _ in range(rng.randint(1, 20))) for _ in range(200)]
    spec = dict(sentencepiece_bridge.fields(dict(sentencepiece_bridge.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3])) if rule else {}
    fallback = [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    for extra, dummy, by_bytes, user in itertools.product((0, 1), repeat=4):
        plain = PIECES if kind == sentencepiece_bridge.UNIGRAM else [(p, -float(i)) for i, (p, _) in enumerate(sorted(PIECES, key=lambda x: -len(x[0])))]
        pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *fallback * by_bytes, *((p, s, 1) for p, s in plain), *[("<x>", 0.0, 4)] * user]
        data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces) + field(2, field(3, kind) + field(4, len(pieces)) + field(35, by_bytes))
        data += field(3, field(1, (rule or "identity").encode()) + (field(2, spec[2]) if rule else b"") + field(3, dummy) + field(4, extra) + field(5, 1))
        codec, library = sentencepiece_bridge.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
        packed = codec.packed(texts)
        ids = [sentencepiece_bridge.unpacked(x) for x in packed]
        assert ids == library.encode(texts) and all(codec.parities(texts, packed))
        assert not by_bytes or (codec.decode(ids) == library.decode(ids) and all(codec.round_trips(texts, packed)))


def test_charsmap_has_the_keys_of_the_library():
    import sentencepiece

    made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(sentencepiece_bridge.fields(dict(sentencepiece_bridge.fields(made.serialized_model_proto()))[3]))
    keys = sentencepiece_bridge.charsmap_keys(spec[2])
    assert len(keys) > 10_000 and keys["ﬁ"] == "fi" and keys["a\u0301"] == "á" and keys["\t"] == " "
