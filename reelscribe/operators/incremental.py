"""Frozen baselines, increments, reuse of unchanged work, run history."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscribe import schemas
from reelscribe.functions import values as vx
from reelscribe.operators import timeline as tl


def stage_order(stage: Column) -> Column:
    """Position of a run stage, from the fixed stage list."""
    return F.array_position(F.array(*[F.lit(s) for s in schemas.STAGES]), stage) - 1


def freeze_ids(ids: DataFrame) -> DataFrame:
    """Highest number per (kind, prefix) and the next free one; holes are never filled. ids: kind, prefix, id."""
    number = F.regexp_extract("id", r"^[A-Z]+([0-9]+)$", 1)
    own = F.regexp_replace("id", r"[0-9]+$", "") == F.col("prefix")
    value = F.when(own & (number != ""), number.try_cast("long"))
    return ids.groupBy("kind", "prefix").agg(F.coalesce(F.max(value), F.lit(0)).alias("frozen_max"), F.count(F.lit(1)).alias("id_count")).withColumn(
        "next_number", F.col("frozen_max") + 1)


def diff_manifests(expected: DataFrame, current: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Entries that are missing, added or changed (null-safe)."""
    e = expected.select(*keys, F.col(digest).alias("expected_hash"), F.lit(True).alias("_e"))
    c = current.select(*keys, F.col(digest).alias("current_hash"), F.lit(True).alias("_c"))
    both = e.join(c, list(keys), "full")
    problem = (F.when(F.col("_c").isNull(), "missing").when(F.col("_e").isNull(), "added")
               .when(~F.col("expected_hash").eqNullSafe(F.col("current_hash")), "changed"))
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").drop("_e", "_c")


def append_increment(rows: DataFrame, line: tl.Timeline, part_order: str, next_number: int, prefix: str, ident: str) -> DataFrame:
    """Ids for new rows from the allocation, in order."""
    from reelscribe.operators.sequence import assign_stable_ids

    return assign_stable_ids(rows, line, part_order, prefix, next_number, ident)


def increment_problems(rows: DataFrame, line: tl.Timeline, start: str, frozen_end: int, ident: str) -> DataFrame:
    """Rows before the frozen end or starting before the row before them."""
    near = tl.scan(rows, line, previous={"_p": start})
    problem = F.when(F.col(start) < frozen_end, "before_frozen_end").when(F.col(start) < F.col("_p"), "out_of_order")
    return near.select(F.col(ident), problem.alias("problem")).filter("problem IS NOT NULL")


def increment_id_problems(rows: DataFrame, line: tl.Timeline, part_order: str, next_number: int, prefix: str, ident: str, frozen: DataFrame) -> DataFrame:
    """Ids that leave the sequence of the allocation, and ids that the frozen baseline holds (``frozen``: the same id column)."""
    expected = append_increment(rows, line, part_order, next_number, prefix, "_expected")
    held = frozen.select(ident).distinct().withColumn("_frozen", F.lit(True))
    problem = F.when(F.col("_frozen"), "id_is_frozen").when(~F.col(ident).eqNullSafe(F.col("_expected")), "not_in_sequence")
    return expected.join(held, ident, "left").withColumn("problem", problem).filter("problem IS NOT NULL").select(*rows.columns, "problem")


def merge_frozen_and_increment(frozen: DataFrame, increment: DataFrame) -> DataFrame:
    """Both sides with a ``source_range`` tag."""
    return frozen.withColumn("source_range", F.lit("frozen")).unionByName(
        increment.withColumn("source_range", F.lit("incremental")), allowMissingColumns=True)


def counts_per_table(merged: dict[str, DataFrame]) -> DataFrame:
    """Rows of each side and of both for every merged table (``source_range`` as set by the merge)."""
    out = None
    for name, rows in merged.items():
        side = lambda s: F.count(F.when(F.col("source_range") == s, 1))
        counts = rows.agg(side("frozen").alias("frozen_rows"), side("incremental").alias("incremental_rows"), F.count(F.lit(1)).alias("merged_rows"))
        counts = counts.select(F.lit(name).alias("table"), "*")
        out = counts if out is None else out.unionByName(counts)
    return out


def chronology_errors(rows: DataFrame, line: tl.Timeline, start: str) -> DataFrame:
    """Rows of the merged table starting before the row before them."""
    return tl.scan(rows, line, previous={"_p": start}).filter(F.col(start) < F.col("_p")).drop("_p")


def id_collisions(frozen: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I4: ids of both sides."""
    return new.select(*keys).distinct().join(frozen.select(*keys), list(keys), "left_semi")


def find_unregistered(present: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Present units that the manifest does not list."""
    return present.select(*keys).distinct().join(manifest, list(keys), "left_anti")


def select_changed_units(current: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Units to recompute with the reason. current: key, input_hash, config_hash, output_hash.

    log: key, status, at, and the three hashes; only the latest success of a unit counts, and a missing
    output hash is a change. ``rebuild_changed`` processes just those units.
    """
    last = log.filter("status = 'succeeded'").groupBy(key).agg(
        F.max_by(F.struct("input_hash", "config_hash", "output_hash"), "at").alias("_l"))
    rows = current.join(last, key, "left")
    reason = (F.when(F.col("_l").isNull(), "never_succeeded").when(~F.col("_l.input_hash").eqNullSafe(F.col("input_hash")), "input_changed")
              .when(~F.col("_l.config_hash").eqNullSafe(F.col("config_hash")), "config_changed")
              .when(F.col("output_hash").isNull() | ~F.col("_l.output_hash").eqNullSafe(F.col("output_hash")), "output_changed"))
    return rows.select(key, reason.alias("reason")).filter("reason IS NOT NULL")


def write_units(rows: DataFrame, target: str, part: str) -> None:
    """The table of all units, a folder for each ``part``; large parts are split into files by AQE."""
    rows.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(target)


def folder_times(spark: SparkSession, target: str, part: str, name: str) -> DataFrame:
    """(part, ``name``): when the newest file of each folder was written. No file is opened."""
    from reelscribe.session import read_folders

    files = read_folders(spark, target, "binaryFile", pathGlobFilter="*.parquet")
    return files.groupBy(part).agg(F.max("modificationTime").alias(name))


def rebuild_changed(source: DataFrame, target: str, changed: DataFrame, unit: str, part: str, build: Callable[[DataFrame], DataFrame]) -> int:
    """Build the changed units anew and rewrite the folders they lie in, no others; the number of folders.

    ``source``: input rows with ``unit`` and ``part``, the folder of a unit, which never changes; ``changed``: (unit, part);
    ``build`` makes output rows with both from input rows. Other units of these folders are copied, whatever they hold; a unit without input
    rows loses its own. Names of touched folders come to the driver, which lists the table's folders anyway, and are the
    partition filter of both reads. Old files are replaced when all new ones are written (dynamic partition overwrite).
    """
    from reelscribe.session import read_folders, stage_table

    spark = source.sparkSession
    units = stage_table(changed.select(unit, part).distinct())
    touched = [r[0] for r in units.select(part).distinct().collect()]
    if not touched:
        return 0
    near = F.col(part).isin([p for p in touched if p is not None])
    near = near | F.col(part).isNull() if None in touched else near
    fresh = build(tl.join_parts(source.filter(near), units.select(unit), [unit], "left_semi"))
    kept = tl.join_parts(read_folders(spark, target).filter(near), units.select(unit), [unit], "left_anti")
    rows = kept.withColumn(part, F.col(part).cast(fresh.schema[part].dataType)).unionByName(fresh)
    rows.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(target)
    return len(touched)


def latest_attempt_status(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per job and stage: attempts, latest status, latest success; per job: last milestone and overall status).

    attempts: job_id, stage, status, at, event_id. A latest status of ``running`` means interrupted.
    """
    order = F.struct("at", "event_id")
    stages = attempts.groupBy("job_id", "stage").agg(
        F.count(F.lit(1)).alias("attempt_count"), F.max_by("status", order).alias("status"),
        F.max(F.when(F.col("status") == "succeeded", F.col("at"))).alias("last_success"))
    stages = stages.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))
    done = F.when(F.col("status") == "succeeded", F.struct(stage_order(F.col("stage")).alias("o"), "stage"))
    jobs = stages.groupBy("job_id").agg(
        F.max(done).alias("_d"), F.count(F.when(F.col("status").isin("failed", "interrupted"), 1)).alias("_bad"))
    overall = F.when(F.col("_bad") > 0, "failed").when(F.col("_d.stage") == schemas.STAGES[-1], "complete").otherwise("active")
    return stages, jobs.select("job_id", F.col("_d.stage").alias("last_milestone"), overall.alias("overall_status"))


def invalidate_downstream(states: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I8: (states after the change, last success per changed job). states: job_id, stage, status; changes: job_id, stage."""
    first = changes.groupBy("job_id").agg(F.min(stage_order(F.col("stage"))).alias("_from"))
    rows = states.join(first, "job_id", "left").withColumn("_o", stage_order(F.col("stage")))
    after = F.coalesce(F.col("_o") >= F.col("_from"), F.lit(False))
    status = (F.when(after & F.col("status").isin("succeeded", "skipped", "failed"), "invalidated")
              .when(after & (F.col("status") == "running"), "error_running").otherwise(F.col("status")))
    out = rows.withColumn("new_status", status)
    kept = F.when((F.col("new_status") == "succeeded") & (F.col("_o") < F.col("_from")), F.struct("_o", "stage"))
    last = out.filter("_from IS NOT NULL").groupBy("job_id").agg(F.max(kept).alias("_k")).select("job_id", F.col("_k.stage").alias("last_success"))
    return out.select("job_id", "stage", "status", "new_status"), last


def build_review_queue(prior: DataFrame, formulas: DataFrame, corrections: DataFrame) -> DataFrame:
    """Prior queue, unverified formulas and pending corrections in one shape."""
    f = formulas.filter("verification_status <> 'verified'").select(
        F.concat(F.lit("R-"), F.col("formula_id")).alias("review_id"), F.lit("formula").alias("type"), F.col("timestamp_ms").alias("start_ms"),
        F.col("timestamp_ms").alias("end_ms"), F.col("frame_id").alias("frame"), F.col("latex").alias("candidate"))
    c = corrections.filter("decision = 'pending'").select(
        F.concat(F.lit("R-"), F.col("correction_id")).alias("review_id"), F.lit("correction").alias("type"), "start_ms", "end_ms",
        F.get("visual_evidence", F.lit(0)).alias("frame"), "original_text", F.col("suggested_text").alias("candidate"))
    return prior.unionByName(f, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


def detect_conflicting_tools(attempts: DataFrame) -> DataFrame:
    """Jobs run with more than one tool conflict; a single one is the job's lock."""
    tools = attempts.filter("tool IS NOT NULL").groupBy("job_id").agg(F.min("tool").alias("_a"), F.max("tool").alias("_z"))
    same = F.col("_a") == F.col("_z")
    return tools.select("job_id", F.when(same, F.col("_a")).alias("locked_tool"), (~same).alias("conflict"))


def carry_forward_status(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Keep the earlier status row of a unit when it succeeded and both hashes are unchanged."""
    p = previous.select(key, *[F.col(c).alias(f"_{c}") for c in ("status", "input_hash", "output_hash", "completed_at")])
    rows = current.join(p, key, "left")
    keep = F.coalesce((F.col("_status") == "succeeded") & F.col("_input_hash").eqNullSafe(F.col("input_hash"))
                      & F.col("_output_hash").eqNullSafe(F.col("output_hash")), F.lit(False))
    return rows.select(key, "input_hash", "output_hash", F.lit("succeeded").alias("status"), keep.alias("carried"),
                       F.when(keep, F.col("_completed_at")).otherwise(F.col("completed_at")).alias("completed_at"))


def snapshot(df: DataFrame, unit: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Unit and fingerprint table, as stored beside a frozen baseline."""
    return df.select(*unit, vx.row_fingerprint(columns).alias("hash"))
