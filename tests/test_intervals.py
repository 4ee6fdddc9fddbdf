"""Interval joins, sweeps, ordered child rows and the text index against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from reelscribe.operators import corrections as co
from reelscribe.operators import evidence as ev
from reelscribe.operators import intervals as iv
from reelscribe.operators import neardup as nd
from reelscribe.operators import sequence as sq
from reelscribe.operators import timeline as tl
from reelscribe.sources import writers as wr


def _spans(rng, n, longest):
    out = []
    for i in range(n):
        start = rng.randrange(0, 100_000)
        out.append(("p%d" % (i % 2), i, start, start + rng.choice([0, 1, 30, 700, longest])))
    return out


@pytest.mark.parametrize("longest", [50, 90_000])
def test_overlap_join_of_any_lengths(spark, longest):
    rng = random.Random(longest)
    a, b = _spans(rng, 120, longest), [(p, i + 1000, s, e) for p, i, s, e in _spans(rng, 90, longest)] + [("p0", 5000, -50, 200_000), ("p1", 5001, 70, 60)]
    left = spark.createDataFrame(a, "part string, l bigint, a bigint, b bigint")
    right = spark.createDataFrame(b, "part string, r bigint, c bigint, d bigint")
    meets = (F.col("d") >= F.col("a")) & (F.col("c") <= F.col("b"))
    got = sorted((x.l, x.r) for x in iv.overlap_join(left, right, ["part"], (F.col("a"), F.col("b")), (F.col("c"), F.col("d")), meets, 64).collect())
    # An inverted interval is met at its start only.
    want = sorted((l, r) for p, l, s, e in a for q, r, c, d in b if p == q and d >= s and c <= e and max(c, d) >= s)
    assert got == want
    assert iv.overlap_join(left, right.filter("false"), ["part"], (F.col("a"), F.col("b")), (F.col("c"), F.col("d")), meets, 64).count() == 0


def test_long_intervals_expand_to_few_rows(spark):
    """One interval over a whole part beside second-long ones."""
    spans = [("p", 0, 0, 10_000_000_000)] + [("p", i, 1000 * i, 1000 * i + 999) for i in range(1, 500)]
    rows = spark.createDataFrame(spans, "part string, r bigint, c bigint, d bigint").withColumn("_r_level", iv._level((F.col("c"), F.col("d")), 1000))
    levels = F.array(*[F.lit(x) for x in range(24)])
    assert rows.select(F.max("_r_level")).first()[0] == 24
    assert iv._expanded(rows, "r", (F.col("c"), F.col("d")), F.array(F.lit(0)), 1000).count() <= 2 * len(spans)
    assert iv._expanded(rows, "r", (F.col("c"), F.col("d")), levels, 1000).count() <= 2 * 25 * len(spans)
    points = spark.range(0, 600_000, 997).select(F.lit("p").alias("part"), F.col("id").alias("t"))
    hits = iv.point_in_interval(points, rows.drop("_r_level"), ["part"], "t", "c", "d", 1000)
    assert hits.count() == sum(1 + (1000 <= t < 500_000 and t % 1000 < 999) for t in range(0, 600_000, 997))


def test_low_density_by_sweep(spark):
    rng = random.Random(4)
    spans = [(p, s, s + rng.choice([-5, 0, 3, 90, 100_000]), rng.randrange(1, 9)) for p in (None, "a") for s in (rng.randrange(-50, 3000) for _ in range(40))]
    rows = spark.createDataFrame([*spans, ("a", None, 50, 3)], "part string, s bigint, e bigint, w bigint")
    durations = spark.createDataFrame([(None, 3100), ("a", 5000), ("empty", 25)], "part string, duration bigint")
    got = sorted(((r.part, r.bucket, r.total) for r in sq.low_density_buckets(rows, durations, "part", "s", "e", F.col("w"), 10, 40).collect()), key=str)
    want = []
    for part, duration in ((None, 3100), ("a", 5000), ("empty", 25)):
        for k in range(-(-duration // 10)):
            total = sum(w for p, s, e, w in spans if p == part and e > 0 and s // 10 <= k <= -(-e // 10) - 1)
            if total < 40:
                want.append((part, k, total))
    assert got == sorted(want, key=str)


def test_ordered_members(spark):
    rng = random.Random(6)
    links = [(rng.choice([None, "x", "y"]), rng.randrange(0, 300), rng.randrange(0, 40)) for _ in range(300)]
    rows = spark.createDataFrame(links, "owner string, place bigint, ref bigint")
    got = {}
    for r in ev.ordered_members(rows, ["owner"], "frame", "place", "ref", 10).collect():
        assert r.kind == "frame"
        got.setdefault(r.owner, {})[r.position] = int(r.ref_id)
    for owner in (None, "x", "y"):
        first = {}
        for o, place, ref in links:
            if o == owner:
                first[ref] = min(place, first.get(ref, place))
        assert [got[owner][k] for k in range(1, len(first) + 1)] == sorted(first, key=lambda ref: (first[ref], ref))


def test_text_index(spark):
    rng = random.Random(8)
    words = ["ab", "abc", "the", "theory", "théorie", "x-y", "abab", "z"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(60)] + [(90, None), (91, "")]
    terms = ["", "a", "ab", "the", "theory a", "théorie", "y t", "b abab", "nowhere at all", "z"]
    df = spark.createDataFrame(texts, "id bigint, text string")
    got = sorted((r.id, r.term) for r in co.match_terms(df, ["id"], "text", spark.createDataFrame([(t,) for t in terms], "term string"), "term").collect())
    assert got == sorted((i, t) for i, x in texts for t in terms if t and t in (x or ""))
    items = df.select(F.lit("k").alias("kind"), F.col("id").cast("string").alias("item_id"), F.lit(0).cast("long").alias("t"), F.array("text", F.upper("text"), F.lit("Title")).alias("haystack"))
    found = sorted((r.item_id, r.query) for r in co.search_timeline(items, spark.createDataFrame([("THÉO",), ("tle",), ("qq",)], "query string")).collect())
    assert found == sorted([(str(i), "THÉO") for i, x in texts if "théo" in (x or "")] + [(str(i), "tle") for i, _ in texts])


def test_missing_images_have_no_metrics(spark):
    rows = spark.createDataFrame([(1, [10, 200, 30, 40], 2, 2), (2, None, 2, 2), (3, [], 2, 2), (4, [1, 2], None, 1)], "id bigint, luma array<int>, w int, h int")
    got = {r.id: r.m for r in rows.select("id", nd.frame_metrics(F.col("luma"), F.col("w"), F.col("h")).alias("m")).collect()}
    assert got[1].mean_luma == 70.0 and got[1].hash_hi is not None
    assert all(v is None for i in (2, 3, 4) for v in (got[i] or [None]))


def test_reader_pages_of_many_tables(spark):
    jobs = spark.createDataFrame([("a",), ("b",), (None,)], "job_id string")
    one = spark.createDataFrame([("a", i, f"s{i}") for i in range(7)] + [(None, 1, "n")], "job_id string, no bigint, name string")
    two = spark.createDataFrame([("a", 5 - i // 2, f"g{9 - i}") for i in range(5)], "job_id string, t bigint, term string")
    out = wr.assemble_reader_dataset(jobs, {"one": (one, tl.by_position(["job_id"], "no", 3)), "two": (two, tl.Timeline(("job_id",), ("t", "term"), "t", 2))}, rows=3)
    # The tables move as one: as many shuffles for two as for one.
    alone = wr.assemble_reader_dataset(jobs, {"one": (one, tl.by_position(["job_id"], "no", 3))}, rows=3)
    moves = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (alone, out)]
    assert moves[0] == moves[1]
    got = {(r.job_id, r.page): ([x.name for x in r.one or []], [x.term for x in r.two or []]) for r in out.collect()}
    assert got == {("a", 0): (["s0", "s1", "s2"], ["g5", "g6", "g7"]), ("a", 1): (["s3", "s4", "s5"], ["g8", "g9"]), ("a", 2): (["s6"], []), ("b", 0): ([], []), (None, 0): (["n"], [])}


def test_dangling_references_of_single_rows(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 5), (2, None), (3, 7)], "id bigint, part bigint")
    parts = spark.createDataFrame([(6,), (7,), (7,)], "p bigint")
    out = ev.find_dangling_references(rows, "id", {"part": (F.array("part"), parts, "p")})
    assert sorted((r.id, r.kind, r.missing) for r in out.filter("missing IS NOT NULL").collect()) == [(1, "part", "5"), (2, "part", "5")]
