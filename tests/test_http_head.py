from tidewire.sources import capture


def test_headers_after_a_large_cookie(spark):
    get = b"GET /a HTTP/1.1\r\nCookie: " + b"x" * 20_000 + b"\r\nHost: X.org\r\nUser-Agent: Y\r\n\r\n"
    post = b"POST /b HTTP/1.1\r\nContent-Length: 22\r\n\r\nz\r\nHost: not-a-header"
    rows = spark.createDataFrame([(1, bytearray(get)), (2, bytearray(post)), (3, None)], "seq long, payload binary")
    got = [(r.seq, r.http_method, r.http_path, r.http_host, r.http_agent) for r in capture.http(rows).orderBy("seq").collect()]
    assert got == [(1, "GET", "/a", "x.org", "Y"), (2, "POST", "/b", None, None)]
