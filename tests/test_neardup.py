import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from reelscribe.operators import neardup as nd


def make(rng, jobs=3, n=60, chain=True):
    rows = []
    for job in range(jobs):
        base = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(5)]
        hi, lo = base[0]
        for i in range(n):
            if chain and i < 30:  # a slow fade: each frame two bits from the one before
                lo ^= 3 << (i % 30)
                h = (hi, lo)
            else:
                h = rng.choice(base)
                if rng.random() < 0.5:
                    h = (h[0], h[1] ^ (1 << rng.randrange(32)))
            rows.append((f"j{job}", job * 1000 + i, h[0], h[1], rng.randrange(0, 90), rng.randrange(3), rng.random() < 0.1, rng.choice([None, 0.1, 0.9]), rng.random() > 0.05))
    return rows


SCHEMA = "job_id string, frame_no bigint, hash_hi bigint, hash_lo bigint, t bigint, rank_key bigint, protected_cue boolean, scene_score double, usable boolean"


def greedy(rows, threshold=6, gap=40):
    out = {}
    for job in {r[0] for r in rows}:
        kept = []
        for r in sorted((x for x in rows if x[0] == job), key=lambda x: (x[5], x[4], x[1])):
            if not r[8]:
                out[job, r[1]] = ("quality_drop", None, None)
                continue
            options = [(bin(r[2] ^ k[2]).count("1") + bin(r[3] ^ k[3]).count("1"), k) for k in kept]
            options = [o for o in options if o[0] <= threshold]
            if not options:
                kept.append(r)
                out[job, r[1]] = ("kept", None, None)
                continue
            d, k = min(options, key=lambda o: o[0])
            if r[6] or abs(r[4] - k[4]) >= gap or (r[7] or 0) >= 0.45:
                kept.append(r)
                out[job, r[1]] = ("progressive_change_protected", k[1], d)
            else:
                out[job, r[1]] = ("duplicate_drop", k[1], d)
    return out


def test_greedy_dedup_matches_loop(spark):
    rows = make(random.Random(5), jobs=2, n=45)
    rows = [r for r in rows if r[1] % 1000 >= 20]
    # A third of all rows are copies of one hash; a score that is not a number is none.
    rows += [("j0", 9000 + i, rows[40][2], rows[40][3], i % 90, 2, False, float("nan") if i % 2 else None, True) for i in range(50)]
    out = nd.greedy_dedup(spark.createDataFrame(rows, SCHEMA), "job_id", "frame_no", ["rank_key", "t", "frame_no"], nd.Protection(time_gap=40))
    got = {(r.job_id, r.frame_no): (r.action, r.canonical_id, r.distance) for r in out.collect()}
    clean = [(*r[:7], None if r[7] != r[7] else r[7], r[8]) for r in rows]
    assert got == greedy(clean)


def test_frames_wait_only_for_what_may_be_nearer(spark, monkeypatch):
    """Thirty frames that all resemble each other and are all kept, as they are far apart in time: two rounds, not thirty."""
    rows = [("j", 0, 0, 0, 0, 0, False, None, True)] + [("j", i, 0, 1 << i, 1000 * i, 0, i == 7, None, True) for i in range(1, 30)]
    rows += [("j", 100, 0, 1 << 3, 3010, 1, False, None, True), ("j", 101, 0, 1 << 3, 9000, 1, True, None, True)]
    calls, facts = [], nd._facts
    monkeypatch.setattr(nd, "_facts", lambda *a: calls.append(1) or facts(*a))
    out = nd.greedy_dedup(spark.createDataFrame(rows, SCHEMA), "job_id", "frame_no", ["rank_key", "t", "frame_no"], nd.Protection(time_gap=40))
    assert {(r.job_id, r.frame_no): (r.action, r.canonical_id, r.distance) for r in out.collect()} == greedy(rows)
    assert len(calls) <= 3


def test_pixels_protect(spark):
    plain, spot = bytes(64), bytes([0] * 30 + [255] * 4 + [0] * 30)
    rows = [("j", 0, 0, 0, 0, 0, False, None, True, plain), ("j", 1, 0, 1, 1, 0, False, None, True, plain), ("j", 2, 0, 3, 2, 0, False, None, True, spot), ("j", 3, 0, 3, 3, 0, False, None, True, spot)]
    df = spark.createDataFrame(rows, SCHEMA + ", luma binary").selectExpr("*", "8 AS width", "8 AS height")
    out = nd.greedy_dedup(df, "job_id", "frame_no", ["rank_key", "t", "frame_no"], nd.Protection(pixels=True))
    got = {r.frame_no: (r.action, r.canonical_id, r.protection_reasons) for r in out.collect()}
    assert got[0][0] == "kept" and got[1][:2] == ("duplicate_drop", 0) and got[3][:2] == ("duplicate_drop", 2)
    assert got[2] == ("progressive_change_protected", 0, ["local_pixel_change", "edge_change", "high_contrast_text_change"])


@pytest.mark.parametrize("hot", [1, 2000])
def test_candidate_pairs_complete(spark, hot):
    rng = random.Random(1)
    rows = []
    for i in range(80):
        lo = 0xFF00 ^ sum(1 << rng.randrange(32) for _ in range(1)) ^ (rng.getrandbits(6) << 20)
        rows.append(("j", 5, lo))
    df = spark.createDataFrame(rows, "job_id string, hash_hi bigint, hash_lo bigint")
    got = [(r.hi, r.lo, r.other_hi, r.other_lo, r.distance) for r in nd.candidate_pairs(df, "job_id", hot_bucket=hot).collect()]
    seen = sorted({(r[1], r[2]) for r in rows})
    want = [(*a, *b, bin(a[1] ^ b[1]).count("1")) for i, a in enumerate(seen) for b in seen[i + 1:] if bin(a[1] ^ b[1]).count("1") <= 6]
    assert sorted(got) == sorted(want)


def test_frame_metrics_and_changes(spark):
    grey = np.arange(18 * 8).reshape(8, 18) % 256
    other = grey.copy()
    other[4, 9] = 255
    df = spark.createDataFrame([(grey.ravel().tolist(), other.ravel().tolist(), 18, 8)], "a array<int>, b array<int>, w int, h int")
    m = df.select(nd.frame_metrics(df.a, df.w, df.h).alias("m"), nd.pair_change_ratios(df.a, df.b, df.w, df.h).alias("c")).first()
    assert m.m.mean_luma == grey.mean() and m.m.black_ratio == (grey <= 16).mean() and m.m.hash_hi == 0
    assert m.c.local == 1 / 144 and m.c.contrast == 1 / 144 and m.c.edge == 1 / 144  # neighbours stay clipped at zero


def test_other_sizes_are_resampled(spark):
    flat = np.full((6, 6), 90, np.uint8)
    assert (nd.resample(flat, 9, 8) == 90).all() and (nd.resample(flat, 3, 2) == 90).all()
    ramp = np.tile(np.arange(0, 240, 10, dtype=np.uint8), (4, 1))
    assert (np.diff(nd.resample(ramp, 9, 4).astype(int), axis=1) > 0).all()
    assert (nd.resampling_weights(18, 9).sum(1) - (1 << 22) < 20).all()
    df = spark.createDataFrame([(bytes(36), bytes(64), bytes([200] * 64))], "a binary, b binary, c binary")
    size = [F.lit(x) for x in (6, 6, 8, 8)]
    r = df.select(nd.pair_change_ratios(F.col("a"), F.col("b"), *size).alias("same"), nd.pair_change_ratios(F.col("a"), F.col("c"), *size).alias("other")).first()
    assert tuple(r.same) == (0, 0, 0) and (r.other.local, r.other.contrast) == (1, 1)
