from tidewire.operators import flows


def test_the_end_of_a_long_flow(spark):
    # (sender, flags, len): a handshake, data with acknowledgements in turn, more of one side, a reset
    sent = [(1, 2, 0), (2, 18, 0), *[(1, 16, 9), (2, 16, 0)] * 5000, *[(2, 16, 9)] * 300, (1, 17, 0), (2, 4, 0)]
    rows = [(f, i, i // 2, *p) for f, some in (("long", sent), ("short", sent[:3])) for i, p in enumerate(some)]
    df = spark.createDataFrame(rows, "flow string, seq long, ts_us long, src_ip4 long, tcp_flags int, len long")
    got = {r.flow: r.history for r in flows.history(df, ["flow"]).collect()}
    assert got == {"long": "Sh" + "Da" * 5000 + "d" * 300 + "Fr", "short": "ShD"}
