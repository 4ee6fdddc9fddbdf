from pyspark.sql import functions as F

from reelscribe.operators import incremental as inc
from reelscribe.operators import timeline as tl
from reelscribe.streaming import append as st


def test_stream_appends_each_row_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = spark.range(1).schema
    spark.range(0, 10).coalesce(1).write.mode("append").parquet(src)
    st.append_increment_stream(st.read_increments(spark, src, schema), out, state, ["id"]).awaitTermination()
    spark.range(5, 15).coalesce(1).write.mode("append").parquet(src)
    st.append_increment_stream(st.read_increments(spark, src, schema), out, state, ["id"]).awaitTermination()
    rows = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(rows) == list(range(15))
    # A new checkpoint counts its batches from 0 again: rows of other streams stay.
    st.append_increment_stream(st.read_increments(spark, src, schema), out, str(tmp_path / "state2"), ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(15))
    other = str(tmp_path / "other")
    spark.range(100, 105).coalesce(1).write.parquet(other)
    st.append_increment_stream(st.read_increments(spark, other, schema), out, str(tmp_path / "state3"), ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(15), *range(100, 105)]


def test_first_row_of_a_key_stays(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 9), (1, 3), (1, 5), (2, 4)], "id bigint, at bigint")
    rows.write.parquet(src)
    st.append_increment_stream(st.read_increments(spark, src, rows.schema), out, str(tmp_path / "state"), ["id"], order=["at"]).awaitTermination()
    assert sorted((r.id, r.at) for r in spark.read.parquet(out).select("id", "at").collect()) == [(1, 3), (2, 4)]


def test_downstream_invalidation(spark):
    states = spark.createDataFrame([("j", "created", "succeeded"), ("j", "transcript_ready", "succeeded"), ("j", "frames_ready", "failed"), ("j", "complete", "pending"), ("k", "complete", "succeeded")],
                                   "job_id string, stage string, status string")
    changes = spark.createDataFrame([("j", "transcript_ready")], "job_id string, stage string")
    after, last = inc.invalidate_downstream(states, changes)
    got = {(r.job_id, r.stage): r.new_status for r in after.collect()}
    assert got == {("j", "created"): "succeeded", ("j", "transcript_ready"): "invalidated", ("j", "frames_ready"): "invalidated", ("j", "complete"): "pending", ("k", "complete"): "succeeded"}
    assert [(r.job_id, r.last_success) for r in last.collect()] == [("j", "created")]


def _batches(spark, src, *parts):
    for rows in parts:
        spark.createDataFrame(rows, "id bigint, day bigint, at bigint").write.mode("append").parquet(src)
        yield


IDS = st.Ids(tl.Timeline(("day",), ("at", "id"), "at", 10), "day", first=101)


def _numbers(spark, out):
    return {r.id: int(r.segment_id[1:]) for r in spark.read.parquet(out).collect()}


def test_ids_go_on_from_batch_to_batch(spark, tmp_path, monkeypatch):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = spark.createDataFrame([], "id bigint, day bigint, at bigint").schema

    def run(at=state):
        st.append_increment_stream(st.read_increments(spark, src, schema), out, at, ["id"], ids=IDS).awaitTermination()

    one = [(i, i % 2, 100 - i) for i in range(40)]
    two = [(i, i % 3, i) for i in range(30, 70)]  # ten of them late repeats
    steps = _batches(spark, src, one, two, [(None, 5, 1), (200, 5, 2)], [(None, 5, 9), (39, 0, 1)])
    next(steps)
    run()
    first = {i: n for n, (i, _, _) in enumerate(sorted(one, key=lambda r: (r[1], r[2])), 101)}
    assert _numbers(spark, out) == first
    # Lost between the rows and their mark, and between the mark and Spark's commit: the batch runs again with the same numbers.
    second = {i: n for n, (i, _, _) in enumerate(sorted(two[10:], key=lambda r: (r[1], r[2])), 141)}
    commit = st.commit_numbers
    next(steps)
    for after in (False, True):

        def lost(*args):
            if after:
                commit(*args)
            raise RuntimeError("lost")

        monkeypatch.setattr(st, "commit_numbers", lost)
        try:
            run()
        except Exception as error:
            assert "lost" in str(error)
        monkeypatch.setattr(st, "commit_numbers", commit)
    run()
    assert _numbers(spark, out) == {**first, **second}
    # A null key is a key; seen ones stay out, in the same stream and in a later one that goes on with the numbers.
    next(steps)
    run()
    assert _numbers(spark, out) == {**first, **second, None: 171, 200: 172}
    next(steps)
    run()
    spark.createDataFrame([(300, 1, 1)], schema).write.mode("append").parquet(src)
    run(str(tmp_path / "state2"))
    assert _numbers(spark, out) == {**first, **second, None: 171, 200: 172, 300: 173}
    assert spark.read.parquet(out).count() == 73


def test_rebuild_changed_leaves_other_folders_alone(spark, tmp_path):
    import os

    target = str(tmp_path / "units")

    def files():
        return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(target) for f in names if f.endswith(".parquet")}

    def build(rows):
        return rows.groupBy("unit", "part").agg(F.sum("v").alias("v"))

    def table(shift):
        return spark.createDataFrame([(u, None if u >= 40 else u // 10, u + shift(u)) for u in range(45) for _ in range(2)], "unit bigint, part bigint, v bigint")

    source = table(lambda u: 0)
    inc.write_units(build(source), target, "part")
    before = files()
    later = table(lambda u: 100 if u in (13, 41) else 0)
    changed = spark.createDataFrame([(13, 1), (41, None)], "unit bigint, part bigint")
    assert inc.rebuild_changed(later, target, changed, "unit", "part", build) == 2
    after = files()
    same = {k for k in before if "part=1" not in k[0] and "HIVE_DEFAULT" not in k[0]}
    assert same and all(after[k] == before[k] for k in same)
    assert not {k for k in before if k not in same} & set(after)
    got = sorted((r.unit, r.part, r.v) for r in spark.read.parquet(target).select("unit", F.col("part").cast("long"), "v").fillna(-1).collect())
    assert got == sorted((r.unit, r.part, r.v) for r in build(later).fillna(-1).collect())
    assert inc.rebuild_changed(later, target, changed.limit(0), "unit", "part", build) == 0 and files() == after


def test_folder_times_tell_rewritten_folders_and_listing_has_few_tasks(spark, tmp_path):
    import os

    from reelscribe.session import _LISTING, read_folders

    target = str(tmp_path / "many")
    rows = spark.range(600).select(F.col("id").alias("unit"), (F.col("id") % 200).alias("part"))
    inc.write_units(rows, target, "part")
    setting, tracker = spark.conf.get(_LISTING), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    table = read_folders(spark, target)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("other", "other")
    assert max(s.numTasks for s in stages) <= 32 * spark.sparkContext.defaultParallelism < 200 and spark.conf.get(_LISTING) == setting
    assert table.count() == 600
    for d, _, names in os.walk(target):
        for f in names:
            if f.endswith(".parquet"):
                os.utime(os.path.join(d, f), (1000, 1000 + d.endswith("part=7")))
    times = {r.part: r.t.timestamp() for r in inc.folder_times(spark, target, "part", "t").collect()}
    assert len(times) == 200 and {p for p, t in times.items() if t == 1001} == {7} and set(times.values()) == {1000, 1001}
