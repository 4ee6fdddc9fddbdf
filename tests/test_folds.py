"""Sequential operators against plain left-to-right loops, with blocks far smaller than the parts."""

import random

import pytest
from pyspark.sql import functions as F

from reelscribe.operators import moments as mo
from reelscribe.operators import paragraphs as pg
from reelscribe.operators import sequence as sq
from reelscribe.operators import timeline as tl


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def by_part(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(scope="module")
def timeline_rows():
    rng = random.Random(7)
    rows = []
    for part in range(6):
        t = 0
        for seq in range(rng.choice([1, 2, 9, 60])):
            t += rng.choice([0, 1, 5, 30, 90])
            length = rng.choice([0, 3, 20, 120])
            rows.append((f"p{part}", seq, t, t + length, rng.choice(["a", "a", "b", ""])))
    # One hot part: two thirds of all rows.
    t = 0
    for seq in range(400):
        t += rng.choice([0, 2, 7])
        rows.append(("hot", seq, t, t + rng.choice([1, 9, 40]), rng.choice(["x", "x", "x", "y"])))
    return rows


SCHEMA = "part_id string, seq bigint, start_ms bigint, end_ms bigint, text_clean string"


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_scan_matches_loop(spark, timeline_rows, rows):
    line = tl.by_position(["part_id"], "seq", rows)
    out = tl.scan(frame(spark, timeline_rows, SCHEMA), line, previous={"p": "end_ms"}, following={"n": "start_ms"}, max_before={"mb": "end_ms"},
                  max_upto={"mu": "end_ms"}, sum_before={"sb": "start_ms"}, sum_upto={"su": "start_ms"}, row_number="rn").collect()
    got = {(r.part_id, r.seq): (r.p, r.n, r.mb, r.mu, r.sb, r.su, r.rn) for r in out}
    want = {}
    for part, items in by_part(timeline_rows).items():
        for i, r in enumerate(items):
            ends, starts = [x[3] for x in items], [x[2] for x in items]
            want[part, r[1]] = (ends[i - 1] if i else None, starts[i + 1] if i + 1 < len(items) else None, max(ends[:i]) if i else None, max(ends[:i + 1]),
                                sum(starts[:i]), sum(starts[:i + 1]), i + 1)
    assert got == want


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_collapse_adjacent_duplicates(spark, timeline_rows, rows):
    line = tl.by_position(["part_id"], "seq", rows)
    got = {(r.part_id, r.seq) for r in sq.collapse_adjacent_duplicates(frame(spark, timeline_rows, SCHEMA), line, gap=5).collect()}
    want = set()
    for part, items in by_part(timeline_rows).items():
        kept = None
        for r in items:
            if kept is None or kept[4] != r[4] or r[2] > kept[3] + 5:
                kept = r
                want.add((part, r[1]))
    assert got == want


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_sessionize_paragraphs(spark, timeline_rows, rows):
    line = tl.by_position(["part_id"], "seq", rows)
    got = {(r.part_id, r.seq): r.group_no for r in pg.sessionize_paragraphs(
        frame(spark, timeline_rows, SCHEMA), line, closes_after=F.col("text_clean") == "y", max_length=70, min_length=42).collect()}
    want = {}
    for part, items in by_part(timeline_rows).items():
        group, current = 1, []
        for r in items:
            if current and r[3] - current[0][2] > 70:
                group, current = group + 1, []
            current.append(r)
            want[part, r[1]] = group
            if r[3] - current[0][2] >= 42 and r[4] == "y":
                group, current = group + 1, []
    assert got == want


@pytest.mark.parametrize("span", [2, 50, 10_000])
def test_merge_moments(spark, timeline_rows, span):
    rows = [(p, i, t, ["periodic"] if i % 2 else ["scene_change"], [f"c{i % 3}"], float(i % 5)) for p, i, t, _, _ in timeline_rows]
    df = frame(spark, rows, "job_id string, ord bigint, t bigint, reasons array<string>, cue_terms array<string>, scene_score double")
    got = {(r.job_id, r.anchor_id): (r.t, r.merged, r.reasons, r.cue_terms, r.scene_score)
           for r in mo.merge_moments(df, tl.by_time(["job_id"], "t", "ord", span), "t", "ord", 3).collect()}
    want = {}
    for part, items in by_part(rows).items():
        anchor, group = None, []

        def close():
            if group:
                want[part, group[0][1]] = (group[0][2], len(group), sorted({x for g in group for x in g[3]}), sorted({x for g in group for x in g[4]}), max(g[5] for g in group))
        for r in sorted(items, key=lambda x: (x[2], x[1])):
            if anchor is None or r[2] - anchor > 3:
                close()
                anchor, group = r[2], []
            group.append(r)
        close()
    assert got == want


def test_group_by_boundaries(spark):
    rng = random.Random(3)
    rows, marks, durations, want = [], [], [], {}
    for p in range(8):
        t, part = 0, f"p{p}"
        items = []
        for seq in range(rng.choice([1, 5, 40])):
            t += rng.choice([1, 4, 15])
            items.append((part, seq, t))
        duration = t + 3
        cuts = sorted(rng.sample(range(1, duration + 20), k=min(duration, 6)))
        rows += items
        marks += [(part, c) for c in cuts]
        durations.append((part, duration))
        left = iter([c for c in cuts if c <= duration])
        cut, group = next(left, duration), 1
        for r in items:
            want[part, r[1]] = group
            if r[2] >= cut - 1:
                group, cut = group + 1, next(left, duration + 1000)
    out = pg.group_by_boundaries(frame(spark, rows, "part_id string, seq bigint, end_ms bigint"), tl.by_position(["part_id"], "seq", 3),
                                 frame(spark, marks, "part_id string, boundary bigint"), frame(spark, durations, "part_id string, duration bigint"))
    assert {(r.part_id, r.seq): r.group_no for r in out.collect()} == want


def test_interval_union_and_gaps(spark, timeline_rows):
    df = frame(spark, timeline_rows, SCHEMA)
    line = tl.by_time(["part_id"], "start_ms", "seq", 20)
    got = {r.part_id: r.covered for r in tl.interval_union_length(df, line, "start_ms", "end_ms", F.lit(10), F.lit(700)).collect()}
    durations = df.groupBy("part_id").agg((F.max("end_ms") + 50).alias("duration"))
    gaps = {r.part_id: r.max_gap for r in sq.max_gap(df, line, "start_ms", "end_ms", durations).collect()}
    for part, items in by_part(timeline_rows).items():
        points = set()
        for r in items:
            points.update(range(max(r[2], 10), min(r[3], 700)))
        assert got.get(part, 0) == len(points)
        cursor, widest = 0, 0
        for r in sorted(items, key=lambda x: x[2]):
            widest, cursor = max(widest, r[2] - cursor), max(cursor, r[3])
        assert gaps[part] == max(widest, max(x[3] for x in items) + 50 - cursor)


def test_stable_ids_follow_part_then_row_order(spark, timeline_rows):
    parts = {p: i for i, p in enumerate(sorted({r[0] for r in timeline_rows}))}
    df = frame(spark, [(*r, parts[r[0]]) for r in timeline_rows], SCHEMA + ", part_no bigint")
    got = {(r.part_id, r.seq): r.segment_id for r in sq.assign_stable_ids(df, tl.by_position(["part_id"], "seq", 7), "part_no", first=11).collect()}
    order = sorted(timeline_rows, key=lambda r: (parts[r[0]], r[1]))
    assert got == {(r[0], r[1]): f"T{i:06d}" for i, r in enumerate(order, 11)}


def test_split_hot_blocks_keeps_order_and_results(spark, timeline_rows):
    df = frame(spark, timeline_rows, SCHEMA)
    coarse = tl.by_time(["part_id"], "start_ms", "seq", 100_000)
    rows, line = tl.split_hot_blocks(df, coarse, rows=20)
    sizes = rows.groupBy("part_id", "_cut").count()
    assert sizes.filter("part_id = 'hot'").count() > 8
    cuts = [r["_cut"] for r in rows.filter("part_id = 'hot'").orderBy("start_ms", "seq").collect()]
    assert cuts == sorted(cuts)
    plain = tl.scan(df, coarse, max_before={"m": "end_ms"}, row_number="n").select("part_id", "seq", "m", "n")
    split = tl.scan(rows, line, max_before={"m": "end_ms"}, row_number="n").select("part_id", "seq", "m", "n")
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)


def _instant_rows(n, later=1):
    return [("p", 0, i) for i in range(n)] + [("p", 5, n + i) for i in range(later)] + [("q", 3, 1)]


def test_split_hot_blocks_cuts_one_instant(spark):
    df = frame(spark, _instant_rows(9000), "part_id string, t bigint, tie bigint")
    rows, line = tl.split_hot_blocks(df, tl.by_time(["part_id"], "t", "tie", 1000))
    sizes = [r["count"] for r in rows.groupBy("part_id", "_cut").count().collect()]
    assert max(sizes) <= 8192 and len(sizes) >= 3
    out = tl.scan(rows, line, row_number="n", sum_before={"s": "tie"}).filter("part_id = 'p'").orderBy("n").collect()
    assert [(r.tie, r.n) for r in out] == [(i, i + 1) for i in range(9001)]
    # Rows of one and the same key cannot be told apart, and end the search instead of the job.
    same = frame(spark, [("p", 1, 1)] * 9000 + [("p", 2, 1)], "part_id string, t bigint, tie bigint")
    rows, _ = tl.split_hot_blocks(same, tl.by_time(["part_id"], "t", "tie", 1000))
    assert rows.count() == 9001


def test_split_hot_blocks_is_even(spark):
    df = spark.range(1_000_000).select(F.substring(F.concat(F.lit("p"), F.col("id").cast("string")), 1, 1).alias("part_id"), (F.col("id") % 1 + 7).alias("t"), F.col("id").alias("tie"))
    rows, line = tl.split_hot_blocks(df, tl.by_time(["part_id"], "t", "tie", 1000))
    sizes = [r["count"] for r in rows.groupBy("_cut").count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) <= 8192 and len(sizes) >= 200
    assert line.block_on == "_cut"


NULL_ROWS = [(p, i, i * 10, i * 10 + (15 if i % 3 else 4), "a" if i % 2 else "b", 0 if p is None else 1) for p in (None, "a") for i in range(10)]
NULL_SCHEMA = SCHEMA + ", part_no bigint"


def test_null_part_is_a_part(spark, rows=4):
    """Whatever holds for part 'a' holds for the rows without a part."""
    df, line = frame(spark, NULL_ROWS, NULL_SCHEMA), tl.by_position(["part_id"], "seq", rows)

    def both(out, *columns):
        found = {None: [], "a": []}
        for r in out.collect():
            found[r.part_id].append(tuple(r[c] for c in columns))
        assert found[None] and sorted(found[None], key=str) == sorted(found["a"], key=str)
        return sorted(found["a"], key=str)

    scanned = both(tl.scan(df, line, previous={"p": "end_ms"}, max_before={"m": "end_ms"}, sum_upto={"s": "seq"}, row_number="n"), "seq", "p", "m", "s", "n")
    assert [r[4] for r in sorted(scanned)] == list(range(1, 11))
    assert len(both(sq.collapse_adjacent_duplicates(df, line, gap=0), "seq")) == 10
    groups = both(pg.sessionize_paragraphs(df, line, closes_after=F.lit(False), max_length=30, min_length=5), "seq", "group_no")
    assert max(g for _, g in groups) > 2
    both(pg.build_paragraphs(pg.sessionize_paragraphs(df.withColumns({"segment_id": F.col("seq").cast("string"), "text_raw": F.col("text_clean")}), line, closes_after=F.lit(False), max_length=30)), "group_no", "text_raw")
    moments = df.select("part_id", "seq", "start_ms", F.array().cast("array<string>").alias("reasons"), F.array().cast("array<string>").alias("cue_terms"), F.lit(0.5).alias("scene_score"))
    both(mo.merge_moments(moments, tl.by_time(["part_id"], "start_ms", "seq", 20), "start_ms", "seq", 15), "anchor_id", "merged")
    durations = df.groupBy("part_id").agg((F.max("end_ms") + 50).alias("duration"))
    assert both(sq.max_gap(df, line, "start_ms", "end_ms", durations), "max_gap") == [(50,)]
    marks = frame(spark, [(p, b) for p in (None, "a") for b in (30, 60)], "part_id string, boundary bigint")
    both(pg.group_by_boundaries(df, line, marks, durations), "seq", "group_no")
    ids = {(r.part_id, r.seq): r.segment_id for r in sq.assign_stable_ids(df, line, "part_no").collect()}
    assert [ids[p, i] for p in (None, "a") for i in range(10)] == [f"T{n:06d}" for n in range(1, 21)]
    split, cut = tl.split_hot_blocks(df, tl.by_time(["part_id"], "start_ms", "seq", 1000), rows=3)
    both(tl.scan(split, cut, row_number="n"), "seq", "n")


def test_rows_without_time_come_first(spark):
    df = frame(spark, [("p", None, i) for i in range(5)] + [("p", i, i) for i in range(5)], "part_id string, t bigint, tie bigint")
    out = tl.scan(df, tl.by_time(["part_id"], "t", "tie", 2), row_number="n")
    assert [r.t for r in out.orderBy("n").collect()] == [None] * 5 + list(range(5))
    groups = tl.carried_groups(df, tl.by_time(["part_id"], "t", "tie", 2), F.col("t") - 2, F.col("t"), "o", "g")
    assert sorted((r.t is None, r.t, r.g) for r in groups.filter("t IS NOT NULL").collect()) == [(False, 0, 6), (False, 1, 6), (False, 2, 6), (False, 3, 7), (False, 4, 7)]


@pytest.mark.parametrize("rows", [4, 1000])
def test_group_by_boundaries_any_ends(spark, rows):
    """Ends that rise and fall, and rows far beyond the duration."""
    rng = random.Random(rows)
    items, marks, durations, want = [], [], [], {}
    for p in [None, *range(6)]:
        part = None if p is None else f"p{p}"
        duration = rng.choice([30, 100])
        ends = [rng.randrange(0, 2 * duration) for _ in range(rng.choice([1, 9, 60]))]
        cuts = sorted(rng.sample(range(1, duration + 20), k=rng.choice([0, 3, 12])))
        items += [(part, i, e) for i, e in enumerate(ends)]
        marks += [(part, c) for c in cuts]
        durations.append((part, duration))
        left = iter([c for c in cuts if c <= duration])
        cut, group = next(left, duration), 1
        for i, e in enumerate(ends):
            want[part, i] = group
            if e >= cut - 1:
                group, cut = group + 1, next(left, duration + 40)
    out = pg.group_by_boundaries(frame(spark, items, "part_id string, seq bigint, end_ms bigint"), tl.by_position(["part_id"], "seq", rows),
                                 frame(spark, marks, "part_id string, boundary bigint"), frame(spark, durations, "part_id string, duration bigint"), beyond=40)
    assert {(r.part_id, r.seq): r.group_no for r in out.collect()} == want
