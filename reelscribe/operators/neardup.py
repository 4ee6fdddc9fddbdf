"""Frame measures and near-duplicate removal over perceptual hashes.

A hash is kept as two longs (``hash_hi``, ``hash_lo``) of ``half_bits`` bits each. All pair work runs on
distinct (job, hash) values, so copies of one hash never meet each other; copies are decided afterwards
by joining them with the one leader of their hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscribe.functions import text as tx
from reelscribe.operators import timeline as tl
from reelscribe.session import scratch_folder, stage_table

# Thresholds of the frame measures.
BLACK_LUMA, BLACK_RATIO, DARK_MEAN, FLAT_STDDEV = 16, 0.97, 24.0, 6.0
CHANGE_LUMA, CONTRAST_LUMA, EDGE_LUMA = 16, 64, 24


def _edges(grey: np.ndarray) -> np.ndarray:
    """3x3 edge filter: eight times the centre minus its neighbours, clipped; the border is kept as is."""
    out = grey.astype(np.int32)
    if min(grey.shape) > 2:
        rows = out[:-2] + out[1:-1] + out[2:]
        box = rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]
        out[1:-1, 1:-1] = np.clip(9 * out[1:-1, 1:-1] - box, 0, 255)
    return out


# A windowed sinc of three lobes, its weights rounded to this many bits.
LOBES, WEIGHT_BITS = 3, 22


@lru_cache(maxsize=64)
def resampling_weights(size: int, target: int) -> np.ndarray:
    """Integer weights (target, size) of an antialiasing resampling with a Lanczos window."""
    if size == target:
        return np.eye(size, dtype=np.int64) << WEIGHT_BITS
    scale = size / target
    wide = max(scale, 1.0)
    out = np.zeros((target, size))
    for i in range(target):
        centre = (i + 0.5) * scale
        x = np.arange(max(0, int(centre - LOBES * wide + 0.5)), min(size, int(centre + LOBES * wide + 0.5)))
        at = (x - centre + 0.5) / wide
        kernel = np.where(np.abs(at) < LOBES, np.sinc(at) * np.sinc(at / LOBES), 0.0)
        out[i, x] = kernel / kernel.sum()
    scaled = out * (1 << WEIGHT_BITS)
    return np.trunc(scaled + np.copysign(0.5, scaled)).astype(np.int64)


def resample(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Rows first, then columns, each pass rounded to 0..255: two matrix products."""
    half = 1 << (WEIGHT_BITS - 1)
    flat = np.clip((grey.astype(np.int64) @ resampling_weights(grey.shape[1], width).T + half) >> WEIGHT_BITS, 0, 255)
    return np.clip((resampling_weights(grey.shape[0], height) @ flat + half) >> WEIGHT_BITS, 0, 255)


def _image(pixels, width: int, height: int) -> np.ndarray:
    """Grey values from bytes (one per pixel) or from a list of numbers."""
    flat = np.frombuffer(pixels, np.uint8) if isinstance(pixels, (bytes, bytearray)) else np.asarray(pixels, np.uint8)
    return flat.reshape(int(height), int(width))


METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("black_ratio", "mean_luma", "luma_stddev", "sharpness")]
                       + [T.StructField(n, T.LongType()) for n in ("hash_hi", "hash_lo")])
RATIOS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("local", "edge", "contrast")])


@F.pandas_udf(METRICS)
def _frame_metrics(luma: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    rows = []
    for pixels, w, h in zip(luma, width, height):
        if pixels is None or pd.isna(w) or pd.isna(h) or not len(pixels):
            rows.append((None,) * 6)
            continue
        grey = _image(pixels, w, h)
        edges, tiny = _edges(grey), resample(grey, 9, 8)
        bits = (tiny[:, :-1] > tiny[:, 1:]).ravel()
        weights = 1 << np.arange(31, -1, -1, dtype=np.int64)
        rows.append((float((grey <= BLACK_LUMA).mean()), float(grey.mean()), float(grey.std()), float(edges.var()),
                     int(weights[bits[:32]].sum()), int(weights[bits[32:]].sum())))
    out = pd.DataFrame(rows, columns=["black_ratio", "mean_luma", "luma_stddev", "sharpness", "hash_hi", "hash_lo"])
    return out.astype({**{c: "float64" for c in out.columns[:4]}, **{c: "Int64" for c in out.columns[4:]}})


def frame_metrics(luma: Column, width: Column, height: Column) -> Column:
    """Measures of a decoded grey image (bytes, or an array of 0..255); nulls for a missing or empty image."""
    return _frame_metrics(luma, width, height)


def change_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Pixels with a change, an edge change, a high-contrast change; the second image is resampled to the size of the first."""
    if a.shape != b.shape:
        b = resample(b, a.shape[1], a.shape[0])
    delta = np.abs(a.astype(np.int32) - b)
    edge = np.abs(_edges(a) - _edges(b))
    return int((delta >= CHANGE_LUMA).sum()), int((edge >= EDGE_LUMA).sum()), int((delta >= CONTRAST_LUMA).sum())


@F.pandas_udf(RATIOS)
def _change_ratios(left: pd.Series, right: pd.Series, width: pd.Series, height: pd.Series, other_width: pd.Series, other_height: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, w, h, ow, oh in zip(left, right, width, height, other_width, other_height):
        if a is None or b is None:
            rows.append((None, None, None))
            continue
        total = max(1, int(w) * int(h))
        rows.append(tuple(n / total for n in change_counts(_image(a, w, h), _image(b, ow, oh))))
    return pd.DataFrame(rows, columns=["local", "edge", "contrast"], dtype="float64")


def pair_change_ratios(left: Column, right: Column, width: Column, height: Column, other_width: Column | None = None, other_height: Column | None = None) -> Column:
    """Shares of pixels with a change, an edge change, a high-contrast change. The second image may have a size of its own."""
    return _change_ratios(left, right, width, height, width if other_width is None else other_width, height if other_height is None else other_height)


def hamming(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    """D3."""
    return F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))


def quality_flags(black_ratio: Column, mean: Column, stddev: Column) -> Column:
    """D4."""
    flags = F.array(F.when(black_ratio >= BLACK_RATIO, "black"), F.when(mean <= DARK_MEAN, "extreme_dark"),
                    F.when(stddev <= FLAT_STDDEV, "low_information"))
    return F.filter(flags, lambda f: f.isNotNull())


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def _low_bits(count: Column) -> Column:
    return _shift("shiftleft", F.lit(1).cast("long"), count) - 1


def _bands(value: Column, bits: Column, count: int) -> Column:
    """``value`` cut into ``count`` runs of bits of near-equal width, lowest first."""
    def cut(i: Column) -> Column:
        return F.floor(bits * i / count)

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: _shift("shiftrightunsigned", value, cut(i)).bitwiseAND(
        _low_bits(cut(i + 1) - cut(i))))


def _without_band(value: Column, bits: int, count: int, band: Column) -> tuple[Column, Column]:
    """The bits of ``value`` outside one band, closed up, and how many they are."""
    low, high = F.floor(band * bits / count), F.floor((band + 1) * bits / count)
    upper = F.when(high < 64, _shift("shiftleft", _shift("shiftrightunsigned", value, high), low)).otherwise(F.lit(0).cast("long"))
    return upper.bitwiseOR(value.bitwiseAND(_low_bits(low))), F.lit(bits) - (high - low)


def candidate_pairs(frames: DataFrame, job: str, threshold: int = 6, half_bits: int = 32, hot_bucket: int = 2000) -> DataFrame:
    """Pairs of distinct hashes of one job at distance 1..``threshold``; left hash below right hash.

    ``threshold + 1`` bands: a close pair agrees in at least one band. A bucket with more than
    ``hot_bucket`` hashes is banded once more on its remaining bits, where the same holds. A pair is kept
    only in the first band (and sub-band) it agrees in, so no distinct follows.
    """
    bits, count = 2 * half_bits, threshold + 1
    full = F.shiftleft(F.col("hash_hi"), half_bits).bitwiseOR(F.col("hash_lo"))
    hashes = frames.select(job, "hash_hi", "hash_lo").distinct()
    keyed = hashes.withColumn("_bands", _bands(full, F.lit(bits), count)).select(
        job, "hash_hi", "hash_lo", "_bands", F.posexplode("_bands").alias("_band", "_value"))
    sizes = keyed.groupBy(job, "_band", "_value").agg(F.count(F.lit(1)).alias("_size"))
    keyed = keyed.join(sizes.filter("_size > 1"), [job, "_band", "_value"])
    rest, rest_bits = _without_band(full, bits, count, F.col("_band"))
    keyed = keyed.withColumn("_sub", F.when(F.col("_size") > hot_bucket, _bands(rest, rest_bits, count)))
    keyed = keyed.select(job, "_band", "_value", "hash_hi", "hash_lo", "_bands", "_sub",
                         F.posexplode(F.coalesce("_sub", F.array(F.lit(0).cast("long")))).alias("_sub_no", "_sub_value"))
    left = keyed.select(job, "_band", "_value", "_sub_no", "_sub_value", F.col("hash_hi").alias("hi"), F.col("hash_lo").alias("lo"),
                        F.col("_bands").alias("_lb"), F.col("_sub").alias("_ls"))
    right = keyed.select(job, "_band", "_value", "_sub_no", "_sub_value", F.col("hash_hi").alias("other_hi"),
                         F.col("hash_lo").alias("other_lo"), F.col("_bands").alias("_rb"), F.col("_sub").alias("_rs"))

    def first_equal(a: str, b: str) -> Column:
        return F.array_position(F.zip_with(a, b, lambda x, y: x == y), True) - 1

    pairs = left.join(right, [job, "_band", "_value", "_sub_no", "_sub_value"]).filter(
        F.struct("hi", "lo") < F.struct("other_hi", "other_lo")
    ).withColumn("distance", hamming(F.col("hi"), F.col("lo"), F.col("other_hi"), F.col("other_lo"))).filter(
        F.col("distance") <= threshold).filter(first_equal("_lb", "_rb") == F.col("_band")).filter(
        F.col("_ls").isNull() | (first_equal("_ls", "_rs") == F.col("_sub_no")))
    return pairs.select(job, "hi", "lo", "other_hi", "other_lo", "distance")


@dataclass(frozen=True)
class Protection:
    """What keeps a frame although it resembles a kept one. Ratios need ``luma``, ``width``, ``height`` of the frames."""

    time_gap: int = 20_000
    scene_score: float = 0.45
    pixels: bool = False
    local_ratio: float = 0.002
    edge_ratio: float = 0.001
    contrast_ratio: float = 0.0005

    def by_itself(self, frame: Column) -> Column:
        """Whether a frame is protected whatever kept frame it resembles."""
        return F.coalesce(frame["protected_cue"], F.lit(False)) | (F.coalesce(frame["scene_score"], F.lit(0.0)) >= self.scene_score)

    def reasons(self, frame: Column, kept: Column) -> Column:
        found = [F.when(frame["protected_cue"], "protected_subtitle_cue"),
                 F.when(F.abs(frame["t"] - kept["t"]) >= self.time_gap, "time_interval")]
        if self.pixels:
            change = F.col("_change")
            found += [F.when(change["local"] >= self.local_ratio, "local_pixel_change"),
                      F.when(change["edge"] >= self.edge_ratio, "edge_change"),
                      F.when(change["contrast"] >= self.contrast_ratio, "high_contrast_text_change")]
        found.append(F.when(F.coalesce(frame["scene_score"], F.lit(0.0)) >= self.scene_score, "high_scene_score"))
        return F.filter(F.array(*found), lambda r: r.isNotNull())


def greedy_dedup(frames: DataFrame, job: str, ident: str, order: Sequence[str], protection: Protection, threshold: int = 6,
                 half_bits: int = 32) -> DataFrame:
    """Best rank first, drop a frame when the nearest kept one within ``threshold`` does not protect it.

    ``order`` names columns (ascending, unique in a job). Frames carry ``t``, ``protected_cue`` and
    ``scene_score`` (and ``luma``, ``width``, ``height`` for pixel rules) and ``usable`` (false = dropped for
    quality). A ``scene_score`` that is not a number counts as none. The nearest kept frame is the first kept one at the smallest distance, so per hash only its
    *leader*, the first frame kept, can be a canonical, and per (hash, distance) only the best-ranked leader
    matters: at most ``threshold`` facts per hash. Leaders are found by rounds of joins over all jobs at once, as
    many as the longest chain of frames that wait for each other, each staged in the shared folder; then one join decides
    every frame. A frame waits only for frames that may still be nearer than the nearest leader known. Pixels do not travel with the rounds: they are joined for the pairs that need them. Returns the frames with ``action``, ``canonical_id``, ``distance``, ``protection_reasons``.
    """
    payload = ["t", "protected_cue", "scene_score"]
    score = F.col("scene_score").cast("double")
    frames = frames.withColumn("scene_score", F.when(~F.isnan(score), score))
    good = frames.filter("usable")
    key = [job, "hash_hi", "hash_lo"]
    half = candidate_pairs(good, job, threshold, half_bits)
    names = ("hash_hi", "hash_lo", "other_hi", "other_lo")
    ways = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(way, names)]) for way in (
        ("hi", "lo", "other_hi", "other_lo"), ("other_hi", "other_lo", "hi", "lo"))])
    edges = stage_table(half.select(job, "distance", F.explode(ways).alias("_e")).select(job, "_e.*", "distance"))
    leader = F.struct(F.struct(*order).alias("rank"), F.col(ident).alias("id"), *payload)
    pixels = good.select(job, F.col(ident).alias("_id"), F.struct("luma", "width", "height").alias("_pixels")) if protection.pixels else None
    leaders = _leaders(good.select(*key, leader.alias("_self")), edges, key, protection, pixels)

    # One join of all leaders decides every frame. A hash without a leader has only duplicates of others.
    steps = _steps(_facts(edges, leaders, key), key)
    ranked = good.withColumn("_self", leader).join(leaders.withColumnRenamed("leader", "_own"), key, "left").join(steps, key, "left")
    own = F.col("_own.rank") < F.col("_self.rank")
    near = F.when(own, F.struct(F.lit(0).alias("distance"), F.col("_own").alias("leader"))).otherwise(_nearest(F.col("_steps"), F.col("_self.rank")))
    judged = _with_change(ranked.withColumn("_near", near), pixels, job, F.col("_near").isNotNull())
    # A frame is kept as its hash's leader or, after that leader, only when protected; one that lost to another hash is dropped.
    judged = judged.withColumn("protection_reasons", F.when(F.col("_near").isNotNull(), protection.reasons(F.col("_self"), F.col("_near.leader"))))
    action = (F.when(F.col("_near").isNull(), "kept").when(F.size("protection_reasons") > 0, "progressive_change_protected").otherwise("duplicate_drop"))
    out = judged.select(*frames.columns, action.alias("action"), F.col("_near.leader.id").alias("canonical_id"), F.col("_near.distance").alias("distance"), "protection_reasons")
    poor = frames.filter("NOT usable").withColumn("action", F.lit("quality_drop"))
    return out.unionByName(poor, allowMissingColumns=True)


def _facts(edges: DataFrame, leaders: DataFrame, key: list[str]) -> DataFrame:
    """Per hash and distance the best-ranked of these leaders."""
    other = leaders.select(key[0], F.col("hash_hi").alias("other_hi"), F.col("hash_lo").alias("other_lo"), "leader")
    return edges.join(other, [key[0], "other_hi", "other_lo"]).groupBy(*key, "distance").agg(F.min_by("leader", F.col("leader.rank")).alias("leader"))


def _steps(facts: DataFrame, key: list[str]) -> DataFrame:
    """Per hash its facts as one short array sorted by distance."""
    return facts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("distance", "leader")), lambda a, b: a["distance"] - b["distance"]).alias("_steps"))


def _nearest(steps: Column, rank: Column) -> Column:
    return F.get(F.filter(steps, lambda s: s["leader"]["rank"] < rank), F.lit(0))


def _with_change(rows: DataFrame, pixels: DataFrame | None, job: str, wanted: Column) -> DataFrame:
    """``_change`` of each row against its ``_near`` leader, for the wanted rows; only these meet the pixels."""
    if pixels is None:
        return rows
    mine = pixels.select(job, F.col("_id").alias("_a_id"), F.col("_pixels").alias("_a"))
    other = pixels.select(job, F.col("_id").alias("_b_id"), F.col("_pixels").alias("_b"))
    asked = rows.filter(wanted).withColumns({"_a_id": F.col("_self.id"), "_b_id": F.col("_near.leader.id")})
    met = asked.join(mine, [job, "_a_id"], "left").join(other, [job, "_b_id"], "left")
    change = pair_change_ratios(F.col("_a.luma"), F.col("_b.luma"), F.col("_a.width"), F.col("_a.height"), F.col("_b.width"), F.col("_b.height"))
    return met.withColumn("_change", change).select(*rows.columns, "_change").unionByName(rows.filter(~F.coalesce(wanted, F.lit(False))), allowMissingColumns=True)


def _leaders(rows: DataFrame, edges: DataFrame, key: list[str], protection: Protection, pixels: DataFrame | None) -> DataFrame:
    """(key, leader): the first kept frame of each hash that has one.

    A frame that protects itself stays. Any other is ready once no neighbouring hash without a leader has an open frame that comes
    earlier and would be nearer than the nearest leader known. A round decides all ready frames of all jobs. A frame that stays leads
    once the earlier ones of its hash are dropped; later ones are no longer asked. The first open frame of a job is always ready.

    The tables of the rounds are files, as a plan over files knows their sizes however many rounds went before.
    """
    with scratch_folder(rows.sparkSession, "leaders") as folder:
        return stage_table(_rounds(rows, edges, key, protection, pixels, folder))


def _rounds(rows: DataFrame, edges: DataFrame, key: list[str], protection: Protection, pixels: DataFrame | None, folder: str) -> DataFrame:
    def kept(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{done}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    job = key[0]
    cheap = replace(protection, pixels=False)
    rank = F.col("_self.rank")
    open_rows, facts, found_all = rows.withColumn("_sure", protection.by_itself(F.col("_self"))), None, None
    for done in count():
        frontier = open_rows.groupBy(*key).agg(F.min("_self.rank").alias("_from"))
        other = frontier.select(job, F.col("hash_hi").alias("other_hi"), F.col("hash_lo").alias("other_lo"), F.col("_from").alias("_other_from"))
        waits = edges.join(other, [job, "other_hi", "other_lo"]).groupBy(*key, "distance").agg(F.min("_other_from").alias("from"))
        judged = open_rows.join(waits.groupBy(*key).agg(F.collect_list(F.struct("distance", "from")).alias("_waits")), key, "left")
        if facts is None:
            judged = judged.withColumn("_ready", F.col("_sure") | ~F.coalesce(F.exists("_waits", lambda w: w["from"] < rank), F.lit(False)))
            judged = judged.withColumn("_stays", F.col("_ready"))
        else:
            judged = judged.join(_steps(facts, key), key, "left").withColumn("_near", _nearest(F.col("_steps"), rank)).drop("_steps")
            near = F.col("_near")

            def may_matter(w: Column) -> Column:
                nearer = near.isNull() | (w["distance"] < near["distance"]) | ((w["distance"] == near["distance"]) & (w["from"] < near["leader"]["rank"]))
                return (w["from"] < rank) & nearer

            judged = judged.withColumn("_ready", F.col("_sure") | ~F.coalesce(F.exists("_waits", may_matter), F.lit(False)))
            free = F.col("_sure") | near.isNull() | (F.size(cheap.reasons(F.col("_self"), F.col("_near.leader"))) > 0)
            judged = judged.withColumn("_free", F.col("_ready") & free)
            judged = _with_change(judged, pixels, job, F.col("_ready") & ~F.col("_free"))
            held = F.size(protection.reasons(F.col("_self"), F.col("_near.leader"))) > 0 if protection.pixels else F.lit(False)
            judged = judged.withColumn("_stays", F.col("_free") | (F.col("_ready") & held))
        judged = kept(judged.filter("_stays OR NOT _ready").select(*key, "_self", "_stays"), "judged")
        firsts = kept(judged.groupBy(*key).agg(F.min_by("_self", F.when(F.col("_stays"), rank)).alias("leader"), F.min(F.when(~F.col("_stays"), rank)).alias("_before")), "firsts")
        leads = F.col("leader").isNotNull() & (F.col("_before").isNull() | (F.col("leader.rank") < F.col("_before")))
        found = firsts.filter(leads).select(*key, "leader")
        found_all = found if found_all is None else found_all.unionByName(found)
        still = judged.join(firsts.filter(~leads), key).filter(F.col("leader").isNull() | (rank <= F.col("leader.rank")))
        open_rows = kept(still.select(*key, "_self", F.col("_stays").alias("_sure")), "open")
        if open_rows.isEmpty():
            return found_all
        fresh = _facts(edges, found, key)
        known = fresh if facts is None else facts.unionByName(fresh).groupBy(*key, "distance").agg(F.min_by("leader", F.col("leader.rank")).alias("leader"))
        facts = kept(known.join(open_rows.select(*key).distinct(), key, "left_semi"), "facts")


def absorb_duplicates(decisions: DataFrame, job: str, ident: str, lists: Sequence[str]) -> DataFrame:
    """Survivors with the sorted union of their own lists and those of the frames dropped onto them."""
    target = F.when(F.col("action") == "duplicate_drop", F.col("canonical_id")).otherwise(F.col(ident))
    kept = decisions.filter("action IN ('kept', 'progressive_change_protected', 'duplicate_drop')")
    merged = kept.select(job, target.alias(ident), *lists)
    return merged.groupBy(job, ident).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists])


#: The classes of audited groups.
GROUP_CLASSES = ("meaningful_progression", "safe_duplicate", "minor_noninstructional_change", "dedup_false_positive", "dedup_false_negative", "uncertain")


def dedup_group_audit(groups: DataFrame, line: tl.Timeline, group: str, ident: str, images: DataFrame | None = None) -> DataFrame:
    """Each member of a labelled group against the one before it: distance of the hashes and, with ``images``, changes of the pixels.

    ``images``: the id, luma, width, height. Pixels join the pairs late and do not ride through the scan; a missing one gives nulls.
    """
    narrow = groups.select(*dict.fromkeys([group, *line.part, *line.order, line.block_on, ident, "hash_hi", "hash_lo"]))
    near = tl.scan(narrow, line, previous={"left_id": ident, "_hi": "hash_hi", "_lo": "hash_lo"})
    pairs = near.filter("left_id IS NOT NULL").select(
        group, "left_id", F.col(ident).alias("right_id"),
        hamming(F.col("_hi"), F.col("_lo"), F.col("hash_hi"), F.col("hash_lo")).alias("distance"))
    if images is None:
        return pairs
    for side in ("left", "right"):
        own = images.select(F.col(ident).alias(f"{side}_id"), *[F.col(c).alias(f"_{side}_{c}") for c in ("luma", "width", "height")])
        pairs = pairs.join(own, f"{side}_id", "left")
    ratios = pair_change_ratios(*[F.col(f"_{x}") for x in ("left_luma", "right_luma", "left_width", "left_height", "right_width", "right_height")])
    return pairs.withColumn("_r", ratios).select(group, "left_id", "right_id", "distance", *[F.col(f"_r.{c}").alias(f"{c}_ratio") for c in ("local", "edge", "contrast")])


def dedup_group_members(groups: DataFrame, labels: DataFrame, group: str, ident: str) -> DataFrame:
    """What to do with each member. ``labels``: group, classification, keep_id. Only safe duplicates name members to drop."""
    rows = tl.join_parts(groups.select(group, ident), labels, [group])
    kept = F.col(ident).eqNullSafe(F.col("keep_id"))
    advice = F.when(kept, "keep").when(F.col("classification") == "safe_duplicate", "drop")
    return rows.select(group, ident, "classification", advice.alias("recommendation"))


def dedup_group_cues(groups: DataFrame, group: str, cues: str = "cue_terms") -> DataFrame:
    """The distinct cue terms of a group's members, one row each."""
    return groups.select(group, F.explode(cues).alias("cue_term")).distinct()


def dedup_class_counts(labels: DataFrame) -> DataFrame:
    """One row: audited groups and groups per class, zeros included; every safe duplicate that still stands is a false negative."""
    counts = {c: F.count(F.when(F.col("classification") == c, 1)).alias(c) for c in GROUP_CLASSES if c != "dedup_false_negative"}
    row = labels.agg(F.count(F.lit(1)).alias("audited_group_count"), *counts.values())
    return row.withColumn("dedup_false_negative", F.col("safe_duplicate")).select("audited_group_count", *GROUP_CLASSES)


def has_protected_cue(cue_terms: Column, protected: Sequence[str]) -> Column:
    folded = F.transform(cue_terms, tx.casefold)
    return F.exists(folded, lambda t: F.exists(F.array(*[tx.casefold(F.lit(p)) for p in protected]), lambda p: F.contains(t, p)))
