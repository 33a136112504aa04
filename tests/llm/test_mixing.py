from tidewire.llm import mixing


def brute(sizes: dict) -> dict:
    """Targets by filling sources one at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in full else share[s] for s in names}
        full |= set(over)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    got = mixing.mix(df).collect()
    sizes, taken, target = {}, {}, {}
    for r, s in zip(rows, rows, strict=True):
        sizes[r[1]] = sizes.get(r[1], 0) + len((s[2] or "").split())
    by_id = {r[0]: r[1] for r in rows}
    for g in got:
        s = by_id[g.doc_id]
        taken[s] = taken.get(s, 0) + g.taken
        target[s] = g.target
        assert 0 <= g.taken <= 3 * g.size and g.source_size == sizes[s]
    want = brute(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        most = max(len((r[2] or "").split()) for r in rows if r[1] == s)
        assert target[s] - most - 1e-6 <= taken[s] <= target[s] + 1e-6, s
    return got


def test_targets_and_budgets(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 5}" if i % 3 else "hot", None if i % 50 == 0 else "w " * (i % 13)) for i in range(600)]
    first = run(spark, rows)
    assert sorted(first) == sorted(run(spark, rows))


def test_repeated_rows(spark):
    rows = [(1, "a", "x y z")] * 90 + [(2, "b", "x y")] * 40 + [(3, "c", "q " * 300)]
    run(spark, rows)


def test_empty_and_documents(spark):
    df = spark.createDataFrame([(1, "a", "x y", 7)], "doc_id long, source string, text string, h int")
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0
    assert mixing.mix_documents(df).collect() == df.collect()
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [(r.size, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0), (0, 0)]
