from __future__ import annotations

import math

import pytest

from appwatch.llm import mixing


def test_totals_and_limits(odd, odd_rows):
    out = mixing.mix(odd).collect()
    assert len(out) == len(odd_rows)
    by_source: dict = {}
    for r in out:
        by_source.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    order = sorted((s for s in by_source if s is not None)) + [None]
    total = sum(r.size for r in out)
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    sizes = {s: sum(r.size for r in rows) for s, rows in by_source.items()}
    capped: set = set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weights[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weights[s] * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s, rows in by_source.items():
        want = 3 * sizes[s] if s in capped else weights[s] * level
        assert all(math.isclose(r.target, want) and r.source_size == sizes[s] for r in rows)
        assert abs(sum(r.taken for r in rows) - want) <= 0.5


def test_reruns_and_partitions_agree(odd):
    key = lambda df: sorted((str(r.doc_id), r.size, r.taken, r.position) for r in df.collect())
    assert key(mixing.mix(odd)) == key(mixing.mix(odd.repartition(7)))


def test_positions_follow_the_schedule(spark):
    rows = [(i, " ".join(["w"] * 10), f"s{i % 2}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    schedule = mixing.Schedule(lines=((2.0, 0.0), (0.0, 2.0)))
    out = mixing.mix(docs, schedule).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    early = [r.source for r in out if r.position < 0.5]
    assert early.count("s0") / 2000 == pytest.approx(0.75, abs=0.02)  # integral of 2 - 2t up to one half
    assert early.count("s1") / 2000 == pytest.approx(0.25, abs=0.02)


def test_position_is_the_inverse_of_the_demand(spark):
    """Targets below and above the size of a source: words taken by a position are the line's integral up to it, pass by pass."""
    rows = [(i, "w " * 10, s) for s, n in (("a", 3000), ("b", 1000), ("c", 100)) for i in range(ord(s) * 10_000, ord(s) * 10_000 + n)]
    lines = ((1.5, 0.5), (0.5, 1.5), (0.5, 1.5))
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.Schedule(lines=lines)).collect()
    for source, (w0, w1), passes in zip("abc", lines, (0.63, 1.9, 3.0)):
        mine = [r for r in out if r.source == source]
        assert all((r.position is None) == (r.taken == 0) for r in mine)
        for t in (0.1, 0.3, 0.5):
            part = ((w1 - w0) * t * t / 2 + w0 * t) / ((w0 + w1) / 2) * passes  # in passes over the source
            first = sum(1 for r in mine if r.position is not None and r.position <= t) / len(mine)
            assert first == pytest.approx(min(1.0, part), abs=0.02)
    dealt = {}
    for r in mixing.deal(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.Schedule(lines=lines)).collect():
        dealt.setdefault(r.doc_id, r.position)
    assert dealt == {r.doc_id: r.position for r in out if r.taken}


def test_dealt_copies_follow_the_schedule(spark):
    """Targets of half a source, of one and a half, and at the limit of three: all of each source's line is dealt."""
    rows = [(f"{s}{i}", "w " * 10, s) for s, n in (("a", 3000), ("b", 1000), ("c", 100)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    lines = ((1.5, 0.5), (0.5, 1.5), (0.5, 1.5))
    out = mixing.deal(docs, mixing.Schedule(lines=lines)).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    plan = {r.doc_id: r for r in mixing.mix(docs, mixing.Schedule(lines=lines)).collect()}
    assert {r.source: round(r.target / r.source_size, 2) for r in plan.values()} == {"a": 0.63, "b": 1.9, "c": 3.0}
    copies: dict = {}
    for r in out:
        copies.setdefault(r.doc_id, []).append((r.position, len(r.text.split())))
    assert {i: sum(n for _, n in c) for i, c in copies.items()} == {i: r.taken for i, r in plan.items() if r.taken}
    assert all(len({p for p, _ in c}) == len(c) for c in copies.values())
    for source, (w0, w1) in zip("abc", lines):
        mine = [(p, n) for i, c in copies.items() for p, n in c if i[0] == source]
        for t in (0.1, 0.25, 0.5, 0.75, 0.9):
            want = ((w1 - w0) * t * t / 2 + w0 * t) / ((w0 + w1) / 2)
            assert sum(n for p, n in mine if p <= t) / sum(n for _, n in mine) == pytest.approx(want, abs=0.01)


def test_repeat_cuts_the_last_part(spark):
    rows = [(1, "a b  c\nd", 4, 7), (2, "x y", 2, 0), (3, "p q", 2, 2), (4, None, 0, 0)]
    mixed = spark.createDataFrame(rows, "doc_id long, text string, size long, taken long")
    got = sorted((r.doc_id, r.text) for r in mixing.repeat(mixed).collect())
    assert got == [(1, "a b  c\nd"), (1, "a b c"), (3, "p q")]


def test_no_words_and_no_rows(spark, empty):
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0, 0.0)] * 2
    assert mixing.mix(empty).count() == 0
    assert mixing.deal(blank).count() == 0 and mixing.deal(empty).count() == 0


def test_no_python_in_the_plan(odd):
    plan = mixing.mix(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
