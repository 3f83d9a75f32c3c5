"""Top-k, WARC, media, sharding and HTML: brute force, byte-level checks and hard rows."""

import base64
import collections
import gzip
import hashlib
import io
import tarfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriloom.llm import html as H
from veriloom.llm import media as M
from veriloom.llm import sharding as R
from veriloom.llm import topk as K
from veriloom.llm import warc as A
from veriloom.llm.common import filesystem, shared_dir

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def hard_pages(spark):
    html = "<html><body><div class=main><p>Text, and more. Text.</p></div></body></html>"
    rows = [(1, "http://a.example/x", html), (1, "http://a.example/x", html), (2, None, html), (3, "http://a.example/y", None), (4, "http://b.example", ""), (None, "nonsense\r\nX: y", "<div"), (5, "HTTP://U@A.example:80/", "<p>" + "long text, " * 100_000), (6, "http://c.example", "plain & simple")]
    return spark.createDataFrame([(*r, None, "h", "d") for r in rows], "page_id long, url string, html string, text string, host string, digest string")


# exact top-k


@pytest.mark.parametrize("n,d,k,block,every", [(300, 16, 5, 16, 1), (257, 3, 10, 300, 10), (40, 64, 50, 16, 7)])
def test_top_k_is_exact(spark, n, d, k, block, every):
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, d))
    v[5:20] = v[5]  # ties
    v[30] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["rank"], r["neighbor_id"], r["score"]) for r in K.top_k(df, k=k, block=block, every=every).collect())
    assert got == sorted(K.brute_force(np.arange(n), v, k, every))


def test_slices_add_up():
    rng = np.random.default_rng(0)
    b = K.Block(np.arange(100), rng.standard_normal((100, 9)))
    w = rng.integers(-31, 32, 9)
    code = np.rint((b.vectors - b.low) / b.step).astype(int)
    digits = K.signed_digits(w)
    assert np.array_equal(sum(d << k for k, d in enumerate(digits)), w)
    want = sum((np.where(d > 0, code, 2**K.BITS - 1 - code) * np.abs(d)).sum(1) << k for k, d in enumerate(digits))
    got = sum(np.isin(np.arange(100), K.rows_of(s, 100)).astype(int) << k for k, s in enumerate(b.score_slices(w)))
    assert np.array_equal(got, want)
    few = [len(b.candidates(q, 3)) for q in b.vectors]
    assert np.mean(few) < 60


def test_top_k_hard_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (4, [0.0, 1.0]), (5, []), (6, [None, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    assert [tuple(r) for r in K.top_k(df, every=1).orderBy("vec_id").collect()] == [(1, 1, 4, 0.0), (4, 1, 1, 0.0)]
    assert K.top_k(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        K.top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


# WARC


def test_warc_round_trip(spark, pages):
    got = {r["page_id"]: r for r in A.through_warc(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["html"] == r["html"] and got[r["page_id"]]["url"] == r["url"] and got[r["page_id"]]["verified"]


def test_warc_index_and_ranges(spark, pages):
    at = shared_dir(spark)
    files = A.write(pages, at, "page_id", "url", "html")
    index = A.index(spark, files).collect()
    assert len(index) == pages.count()
    for r in index[::17]:
        fs, path = filesystem(r["file"])
        with fs.open_input_file(path) as f:
            h, payload = A.parse(gzip.decompress(f.read_at(r["length"], r["offset"])))
        assert h["warc-target-uri"] == r["url"] and A.digest(payload) == r["digest"] and len(payload) == r["payload_bytes"]
    some = A.through_warc(pages, where=F.col("payload_bytes") > 2000)
    assert some.count() == sum(r["payload_bytes"] > 2000 for r in index)


def test_reads_are_coalesced():
    ranges = [(0, 10), (10, 5), (100, 10), (100 + A.GAP + 20, 5), (10**8, A.MOST_AT_ONCE), (10**8 + A.MOST_AT_ONCE, 5)]
    reads = A.coalesced(ranges)
    assert [own for _, _, own in reads] == [[0, 1, 2], [3], [4], [5]]
    assert all(b <= ranges[k][0] and sum(ranges[k]) <= e for b, e, own in reads for k in own)


def test_cut_off_member_is_an_error():
    data = A.member("x", "u", b"payload")
    assert [(o, n) for o, n, _ in A.members(io.BytesIO(data + data), 7)] == [(0, len(data)), (len(data), len(data))]
    with pytest.raises((ValueError, zlib.error)):
        list(A.members(io.BytesIO(data + data[:-9])))


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])) | st.text("%0AaD25\r\n \t:<>"), st.binary(max_size=40))
def test_urls_and_payloads_come_back(url, payload):
    h, got = A.parse(zlib.decompress(A.member("urn:x-row:1", url, payload), 31))
    assert A.url_of(h) == url and got == payload and A.verified(got, h["warc-payload-digest"])


def test_foreign_records():
    body = b"<p>hello</p>"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/?q=%0A%250A\r\nWARC-Payload-Digest: sha1:" + sha1.encode() + b"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: " + str(len(http)).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"
    h, payload = A.parse(record)
    assert payload == body and A.url_of(h) == "http://x/?q=%0A%250A" and A.verified(payload, h["warc-payload-digest"]) is True
    assert A.verified(body + b"!", "sha1:" + sha1) is False and A.verified(body, "crc32:00") is None and A.verified(body, None) is None
    assert A.verified(body, "SHA-256:" + hashlib.sha256(body).hexdigest().upper()) is True


def test_warc_hard_rows(hard_pages):
    rows = sorted(A.through_warc(hard_pages).collect(), key=str)
    want = sorted(((r["page_id"], r["url"], r["html"]) for r in hard_pages.collect()), key=str)
    assert sorted(((r["page_id"], r["url"], r["html"]) for r in rows), key=str) == want
    assert A.through_warc(hard_pages.limit(0)).count() == 0


# media


def test_payloads_are_stored_once_in_tar_shards(spark, hard_pages, pages):
    media = M.media_columns(hard_pages, shard_bytes=600)
    rows = media.collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["page_id"]].add((r["digest"], r["file"], r["offset"], r["length"]))
    assert len(by[1]) == 1 and by[1] == by[2] and by[3] == {(None, None, None, None)}
    payloads = {r["digest"]: bytes(r["payload"]) for r in M.payload(spark, media.where("file is not null")).collect()}
    assert all(hashlib.sha256(p).hexdigest() == d for d, p in payloads.items())
    found = 0
    for uri in {r["file"] for r in rows if r["file"]}:
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as t:
            for m in t.getmembers():
                assert zlib.decompress(t.extractfile(m).read()) == payloads[m.name]
                found += 1
    assert found == len({r["digest"] for r in rows if r["digest"]})
    assert M.media_columns(hard_pages.limit(0)).count() == 0
    whole = {r["page_id"]: r for r in M.media_columns(pages).collect()}
    for r in pages.collect():
        want = M.metadata(r["html"].encode(), True)
        assert {n: whole[r["page_id"]][n] for n in M.NAMES} == {n: want.get(n) for n in M.NAMES} and want["mime"] == "text/html"
        assert whole[r["page_id"]]["raw_length"] == len(r["html"].encode())


def test_headers_of_formats():
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x06\x00\x00\x00" + b"\x00" * 20
    wav = b"RIFF\x00\x00\x00\x00WAVELIST\x04\x00\x00\x00abcdfmt \x10\x00\x00\x00\x01\x00\x02\x00" + (44100).to_bytes(4, "little") + b"\x00" * 12
    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"\x00" * 14 + b"\xff\xc0\x00\x11\x08\x00\x64\x00\xc8\x03" + b"\x00" * 20
    assert M.metadata(png, True) == {"mime": "image/png", "width": 640, "height": 480, "channels": 4}
    assert M.metadata(wav, True) == {"mime": "audio/wav", "channels": 2, "sample_rate": 44100}
    assert M.metadata(jpeg, True) == {"mime": "image/jpeg", "width": 200, "height": 100, "channels": 3}
    assert M.metadata(b"GIF89a\x05\x00\x06\x00" + b"\x00" * 30, True)["height"] == 6
    assert M.metadata(b"", True) == {"mime": "application/x-empty"} and M.metadata(b"hi", True)["mime"] == "text/plain"
    assert M.metadata(b"\x00\xff" * 40, True)["mime"] == "application/octet-stream"
    with pytest.raises(M.Short):
        M.metadata(b"<!doctype html><html><head><title>", False)


def stored_header(data):
    packed = zlib.compress(data, 1)

    class File:
        def read_at(self, n, at):
            return packed[at : at + n]

    return M.header(File(), 0, len(packed))


def test_headers_are_read_to_their_end():
    noise = np.random.default_rng(1)
    segments = b"".join(b"\xff\xe1\xff\xff" + noise.bytes(65533) for _ in range(32))
    jpeg = b"\xff\xd8" + segments + b"\xff\xc0\x00\x11\x08\x00\x64\x00\xc8\x03" + b"\x00" * 20
    assert len(jpeg) > 2 << 20 and stored_header(jpeg) == {"mime": "image/jpeg", "width": 200, "height": 100, "channels": 3}
    late = b"<!doctype html><html lang=de><head><style>" + noise.bytes(1_500_000).hex().encode() + b"</style><meta charset=utf-8><title>late</title></head><body>x"
    assert stored_header(late) == {"mime": "text/html", "language": "de", "charset": "utf-8", "title": "late"}
    for before in (b"<!-- " + noise.bytes(5000).hex().encode() + b" -->\n<!-- two -->", b"\xef\xbb\xbf \n<?xml version='1.0'?>", b" " * 3000):
        assert stored_header(before + b"<html><head><title>t</title></head>" + b"y" * 9000) == {"mime": "text/html", "language": None, "charset": None, "title": "t"}
    assert stored_header(b"<!-- never closed" + b"z" * 5000)["mime"] == "text/plain"
    assert stored_header(b"a" * 1000 + b"\x00" + b"a" * 9000)["mime"] == "application/octet-stream"


def test_header_reads_are_short():
    page = b"<!doctype html><html lang='x'><head><title>T</title></head>" + np.random.default_rng(0).bytes(50_000)
    read = []

    class File:
        def read_at(self, n, at):
            read.append(n)
            return zlib.compress(page, 1)[at : at + n]

    assert M.header(File(), 0, len(zlib.compress(page, 1)))["title"] == "T" and sum(read) <= M.HEADER


# sharding


def brute_shards(keys, names, vnodes, slack):
    """Keys in order of position, one by one, each walking the ring."""
    at, owner = R.ring(names, vnodes)
    load, cap, out = collections.Counter(), -(-int(len(keys) * (1 + slack) * 1_000_000) // (1_000_000 * len(names))), {}
    for arc, after, p, k in sorted((int(np.searchsorted(at, R.position(str(k)))) % len(at), R.position(str(k)) < at[0], R.position(str(k)), k) for k in keys):
        n = arc
        while load[owner[n % len(at)]] >= cap:
            n += 1
        load[owner[n % len(at)]] += 1
        out[k] = (int(owner[arc]), int(owner[n % len(at)]), n - arc)
    return out, cap


@pytest.mark.parametrize("shards,vnodes,slack", [(5, 8, 0.0), (64, 128, 0.05), (1, 1, 0.5), (7, 3, 0.3)])
def test_shards_match_the_walk(docs, shards, vnodes, slack):
    keys = [r["doc_id"] for r in docs.select("doc_id").distinct().collect()]
    want, cap = brute_shards(keys, [f"shard-{k}" for k in range(shards)], vnodes, slack)
    got = {r["doc_id"]: (r["home"], r["shard"], r["hops"]) for r in R.sharded(docs, shards=shards, virtual_nodes=vnodes, slack=slack).collect()}
    assert got == want
    assert max(collections.Counter(s for _, s, _ in got.values()).values()) <= cap


def test_a_new_shard_moves_few_keys(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    place = lambda n: {r["doc_id"]: r["shard"] for r in R.sharded(keys, shards=n, slack=0.25).collect()}
    a, b = place(20), place(21)
    assert np.mean([a[k] != b[k] for k in a]) < 0.2


def test_sharding_hard_rows(hard, empty):
    rows = R.sharded(hard).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1, 9))
    assert R.sharded(empty).count() == 0
    with pytest.raises(ValueError):
        R.sharded(hard, shards=["a", "a"])


# HTML


def brute_extract(rows):
    """Votes and texts of pages (id, host, html) in one process."""
    sums = collections.defaultdict(lambda: collections.defaultdict(float))
    for _, host, page in rows:
        for path, s in H.votes(page).items():
            sums[host][path] += s
    best = {}
    for host, paths in sums.items():
        top = min(paths, key=lambda p: (-round(paths[p], 6), -p[1], p[0]))
        if round(paths[top], 6) / sum(round(x, 6) for x in paths.values()) >= H.LEAST_SHARE:
            best[host] = top[0]
    return {i: H.extract(page, best.get(host)) for i, host, page in rows}


def test_html_matches_brute_force(pages):
    rows = [(r["page_id"], r["h"], r["html"]) for r in pages.withColumn("h", H.host_of(F.col("url"))).collect()]
    got = {r["page_id"]: (r["path"], r["consensus"], r["text"]) for r in H.extracted(pages).collect()}
    assert got == brute_extract(rows)
    assert np.mean([c for _, c, _ in got.values()]) > 0.8


def test_consensus_takes_the_article():
    page = lambda k: f"<html><body><nav class=top><a href=/>home</a></nav><div class='post post-{k}'><p>Story {k}, told. At length, with commas.</p><p>More, and more.</p><script>x('</p>')</script></div><div class=ad>Buy, buy, buy.</div><footer>end</footer></body></html>"
    got = brute_extract([(k, "h", page(k)) for k in range(5)])
    assert got[3] == ("body>div.post.post-#", True, "Story 3, told. At length, with commas.\nMore, and more.")


def test_broken_html():
    assert H.extract(None, None) == (None, False, None) and H.extract("", None)[2] == ""
    for page in ("<div><p>a<div>b</p>c", "</div></p>x", "<!-- open", "<script>never closed", "<p a='x>y", "&amp;&#65;", "<td>1<td>2<tr><td>3", "<DIV CLASS=A>x</DIV>"):
        assert isinstance(H.extract(page, None)[2], str)
    assert H.extract("<ul><li>a, b<li>c</ul>", None)[2] == "a, b\nc"
    deep = "<div>" * 5000 + "deep, deep text" + "</div>" * 5000
    assert H.extract(deep, None)[2] == "deep, deep text"


def test_deep_pages_cost_in_proportion():
    import time

    began, deep = time.perf_counter(), "<div class=a>" * 60_000 + "text, and text" + "</p>" * 200_000 + "</div>" * 60_000
    path, _, text = H.extract(deep, None)
    assert text == "text, and text" and path.count(">") == 59_999 and max(H.votes(deep), key=H.votes(deep).get)[1] == 60_000
    assert time.perf_counter() - began < 30


def test_equal_paths_hash_alike_and_others_do_not():
    keys = lambda page: {x.path: x.key for x in H.parsed(page)}
    a, b = keys("<body><div class='x y'><td>1</td></div><form>"), keys("<body class=z><div class='y x'></div><div class='x9'>")
    assert a["body"] != b["body.z"] and len(set(a.values())) == len(a)
    assert keys("<body><div class='b a7'>x") == keys("<body><div class='a1 b'>y")


def test_html_hard_rows(hard_pages):
    rows = H.extracted(hard_pages).collect()
    assert len(rows) == hard_pages.count()
    by = {r["page_id"]: r for r in rows}
    assert by[3]["text"] is None and by[4]["text"] == "" and by[6]["text"] == "plain & simple" and by[5]["host"] == "a.example"
    assert by[1]["text"] == "Text, and more. Text." and by[2]["host"] == ""
    assert H.extracted(hard_pages.limit(0)).count() == 0
