from tidewire.operators import flows

US = 1_000_000
FRAGMENT = "src_ip4 long, dst_ip4 long, proto long, ident long, ts_us long, offset long, more boolean, payload binary"


def whole(spark, rows):
    df = spark.createDataFrame([(1, 2, 17, 7, *r) for r in rows], FRAGMENT)
    return sorted((r.ts_us, bytes(r.payload), r.n_fragments) for r in flows.whole_datagrams(df).collect())


def test_an_ident_used_again(spark):
    one = lambda t, x: [(t, 0, True, x * 8), (t + 1, 8, False, x)]
    day = 86_400 * US
    # minutes and days apart, the same bytes again, and at once after the one before
    assert whole(spark, one(0, b"a") + one(60 * US, b"b") + one(day, b"a") + one(day + 2, b"c")) == [(0, b"a" * 9, 2), (60 * US, b"b" * 9, 2), (day, b"a" * 9, 2), (day + 2, b"c" * 9, 2)]
    # what was left incomplete does not spoil the next one
    assert whole(spark, [(0, 0, True, b"x" * 8), *one(60 * US, b"b")]) == [(60 * US, b"b" * 9, 2)]


def test_copies_overlaps_and_the_timeout(spark):
    head, tail = (0, 0, True, b"a" * 8), (2, 8, False, b"z")
    assert whole(spark, [head, (1, *head[1:]), tail, (3, *tail[1:]), (10, 0, True, b"b" * 8), (11, 8, False, b"y")]) == [(0, b"a" * 8 + b"z", 2), (10, b"b" * 8 + b"y", 2)]
    assert whole(spark, [head, (1, 4, True, b"b" * 8), tail]) == []
    assert whole(spark, [head, (30 * US, *tail[1:])]) != [] and whole(spark, [head, (30 * US + 1, *tail[1:])]) == []
