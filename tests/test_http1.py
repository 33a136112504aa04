"""HTTP/1 over segments: heads, bodies by length and in chunks, what follows them."""

import hashlib

import pytest

from tests.test_streams import sent, table
from tidewire.sources import http1

PDF = b"%PDF-1.7" + b"x" * 300
REQUESTS = b"GET /a HTTP/1.1\r\nHost: One.example\r\nCookie: " + b"c" * 3000 + b"\r\n\r\n" + b"POST /b HTTP/1.1\r\nHost: two.example\r\nContent-Length: 5\r\n\r\nhello" + b"PUT /c HTTP/1.1\r\nhost: x\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\nTrailer: t\r\n\r\n" + b"GET /d HTTP/1.1\r\n\r\n"
ANSWERS = b"HTTP/1.1 200 OK\r\nContent-Length: 308\r\n\r\n" + PDF + b"HTTP/1.1 204 No\r\nContent-Length: 9\r\n\r\n" + b"HTTP/1.1 200 OK\r\nContent-Length: 70\r\n\r\n" + b"HTTP/1.1 404 Not\r\nContent-Length: 0\r\n\r\n" + b"HTTP/1.0 200 OK\r\n\r\nuntil the end"


@pytest.mark.parametrize("size", [1, 37, 9000])
def test_messages(spark, size):
    got = http1.http_streams(table(spark, sent(REQUESTS, 5, size=size, ends=(1, 4000, 2, 80)), sent(ANSWERS, 9, size=size, ends=(2, 80, 1, 4000), shuffle=size))).orderBy("src_port", "message").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = [(r.http_path, r.http_host, r.http_status, r.body_size, r.body_sha256, r.body_type) for r in got]
    assert told == [
        (None, None, 200, 308, sha(PDF), "pdf"), (None, None, 204, None, None, None), (None, None, 200, None, None, None), (None, None, 404, 0, sha(b""), None), (None, None, 200, None, None, None),
        ("/a", "one.example", None, None, None, None), ("/b", "two.example", None, 5, sha(b"hello"), None), ("/c", "x", None, 5, sha(b"abcde"), None), ("/d", None, None, None, None, None),
    ]


def test_what_is_none(spark):
    assert http1.http_streams(table(spark, sent(b"no head at all\r\n\r\nGET / HTTP/1.1\r\n\r\n", 5))).collect() == []
    cut = http1.http_streams(table(spark, sent(b"POST /b HTTP/1.1\r\nContent-Length: 50\r\n\r\nhello", 5))).collect()
    assert [(r.http_path, r.body_size) for r in cut] == [("/b", None)]
    bad = http1.http_streams(table(spark, sent(b"POST /b HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n", 5))).collect()
    assert [(r.http_path, r.body_size) for r in bad] == [("/b", None)]
