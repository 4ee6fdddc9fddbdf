"""Hard negatives, sharding and whitening against brute force: nulls, odd vectors, ties, repeats, clashing names, empty tables."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelscribe.llm import hard_negatives, sharding, vectors, whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int, x int, row_no long, cell int, n long"


def embedded(spark, rows):
    """Rows of (vec_id, embedding, label) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, l, 1, 2, 3, 4) for i, v, l in rows], EMBEDDINGS)


def integers(v):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(256 * float(np.float32(c))) for c in v]


ODD = [(700, None, 1), (701, [0.5, None], 1), (702, [math.nan, 0.5], 2), (703, [math.inf, 0.1], 1), (704, [0.25], 1), (705, [], 2), (None, [0.3, 0.2], 1), (None, [0.3, 0.2], 2), (706, [0.1, 0.1], None)]


def clustered(seed, n, width=6, labels=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(labels, width))
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        out.append((i, [float(c) for c in 0.4 * middles[label] + 0.3 * rng.normal(size=width)], label))
    return out


# Vectors


def test_bytes_of_vectors():
    rows = [[1, -2, 3], [40000, 0, 0], [1 << 33, 5, 6], [], [7]]
    flat, lengths = np.array([c for r in rows for c in r], np.int64), np.array([len(r) for r in rows])
    coded = vectors.encode(flat, lengths)
    assert [c[0] for c in coded] == [2, 4, 8, 2, 2]
    assert vectors.decode(coded).tolist() == [r + [0] * (3 - len(r)) for r in rows]
    assert vectors.decode(coded[:1], 5).tolist() == [[1, -2, 3, 0, 0]] and vectors.decode([], 2).shape == (0, 2)


# Hard negatives


def expected_negatives(rows, every, positives=5, negatives=5):
    kept = [(i, integers(v), l) for i, v, l in rows if l is not None and integers(v) is not None]
    place = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, a, label in kept:
        if i is None or i % every:
            continue
        others = [(sum(p * q for p, q in zip(a, v)), j, l) for j, v, l in kept if j != i]
        good = sorted((r for r in others if r[2] == label), key=place)[:positives]
        for s, j, _ in good:
            bad = sorted((r for r in others if r[2] != label and 80 * s <= 100 * r[0] <= 100 * s), key=place)[:negatives]
            out += [(i, j, rank, k, s, t) for rank, (t, k, _) in enumerate(bad, 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=10):
    out = hard_negatives.mine(embedded(spark, rows), F.col("vec_id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many cells, blocks, chunks and rounds
        for name, value in {"CELL_ROWS": 2, "BLOCK_ROWS": 5, "CHUNK_QUERIES": 3, "FIRST_BUDGET": 20, "SAMPLE_ROWS": 50}.items():
            monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(1, 240) + [(1000 + i, [0.2, 0.1, 0.1, 0.0, 0.0, 0.1], i % 3) for i in range(60)]  # copies: every score ties
    rows += [(20, [0.2] * 6, 1), (21, [0.1] * 6, 2), (21, [0.1] * 6, 2), (2000, [1e9] * 6, 1), *ODD]  # an id twice, a repeated row, one beyond the limit
    want = [r for r in rows if r[0] != 2000]
    got = mined(spark, rows)
    assert got and got == expected_negatives(want, 10)


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [0.5], 1)]) == []
    assert mined(spark, [(0, None, 1), (1, [0.5], None)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.45, 0.0], 2), (3, [-1.0, 0.0], 1), (4, [-0.9, 0.0], 2), (5, [0.0, 1.0], 1), (6, [0.0, 0.0], 3)]
    assert mined(spark, rows) == expected_negatives(rows, 10) == [(0, 1, 1, 2, 128 * 256, 115 * 256), (0, 5, 1, 6, 0, 0)]


def test_walk_visits_cells_by_falling_bound():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (300, 6))
    index = hard_negatives.Index([hard_negatives.code_book(h, 5) for h in hard_negatives._halves(x)], 6)
    cells, squares = index.cells(x)
    for c in np.unique(cells).tolist():
        mine = cells == c
        index.measure(c, int(mine.sum()), int(squares[0][mine].max()), int(squares[1][mine].max()))
    query = rng.integers(-200, 200, (1, 6))
    (h1, l1), (h2, l2) = index.bounds(query)
    scores = (x @ query[0])
    seen, visited, bound = 0, [], None
    while True:
        found, seen, bound = index.walk([h1[0], h2[0]], [l1[0], l2[0]], seen, 40, None, None)
        visited += found
        if bound is None:
            break
        rest = ~np.isin(cells, visited)
        assert not rest.any() or scores[rest].max() <= bound
    assert sorted(visited) == sorted(np.unique(cells).tolist())


# Sharding


def jump_one(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]
    eight, nine = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert ((eight == nine) | (nine == 8)).all() and 0.08 < (nine == 8).mean() < 0.14
    assert np.bincount(eight).min() > 500


def test_sharding(spark, tmp_path):
    rows = [(i, f"text {i} é") for i in range(300)] + [(None, "a"), (None, "a"), (None, None), (5, "twice"), (5, "twice"), (301, ""), (302, None), (303, "long " * 200_000)]
    rows += [(7, "hot")] * 200
    docs = spark.createDataFrame([(i, t, 1, 2, "k", 4) for i, t in rows], "doc_id long, text string, shard int, slot long, law string, size long")
    got = sharding.assign_shards(docs).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {r.law for r in got} == {"key"}
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for mine in shards.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        ordered = sorted(mine, key=lambda r: r.slot)
        keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in ordered]
        assert keys == sorted(keys)
    for i in {r.doc_id for r in got}:
        assert len({(r.shard, r.grown_shard) for r in got if r.doc_id == i}) == 1
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    grown = {r.doc_id: r.shard for r in sharding.assign_shards(docs, 9).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    named = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "doc_id string, text string")
    assert sharding.assign_shards(named, 3).count() == 3
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*docs.columns, "shard_"]
    assert sorted((str(r.doc_id), r.shard_) for r in back.collect()) == sorted((str(r.doc_id), r.shard) for r in got)


# Whitening


def expected_whitening(rows, wanted=4):
    kept = [(i, integers(v)) for i, v, _ in rows if integers(v) is not None]
    width = max((len(x) for _, x in kept), default=0)
    listed = sorted({tuple(x) for _, x in kept})
    x = np.array([list(v) + [0] * (width - len(v)) for v in listed], np.int64).reshape(len(listed), width)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    return kept, n, sums, e, q, np.trace(centred.T @ centred / n)


def check_whitening(spark, rows, wanted=4):
    got = whitening.whiten(embedded(spark, rows), wanted).collect()
    kept, n, sums, e, q, trace = expected_whitening(rows, wanted)
    lead = int((e > 1e-10 * e[0]).sum())
    assert len(got) == lead * len(kept) and {r.n for r in got} == {n}
    assert all(r.identity_error < 1e-9 for r in got)
    byid = {}
    for r in got:
        assert abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-9
        byid.setdefault(r.vec_id, []).append(r)
    for c in range(1, lead + 1):
        pairs = []
        for i, x in kept:
            x = np.array(list(x) + [0] * (len(sums) - len(x)))
            want = float((x - sums / n) @ q[:, c - 1] / np.sqrt(e[c - 1]))
            mine = [r for r in byid[i] if r.component == c]
            assert {r.deviation for r in mine} >= {int(((n * x - sums) ** 2).sum())}
            pairs.append((want, [r.whitened for r in mine if r.deviation == int(((n * x - sums) ** 2).sum())]))
        sign = 1 if sum(w * g[0] for w, g in pairs) > 0 else -1
        assert all(min(abs(sign * g - w) for g in found) < 1e-8 for w, found in pairs)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    check_whitening(spark, clustered(2, 200, 9))
    check_whitening(spark, [(i, [float(c) for c in rng.normal(size=5) * [3, 1, 0.3, 0.01, 0]], 1) for i in range(80)])  # a dimension without variance
    # Copies count once, rows come back as often as they are there.
    check_whitening(spark, clustered(3, 60, 4) + [(900 + i, [0.5, -0.25, 1.0, 0.75], 0) for i in range(150)] + [(900, [0.5, -0.25, 1.0, 0.75], 0)])
    check_whitening(spark, clustered(4, 50, 2) + ODD)
    check_whitening(spark, [(i, [float(i), 2.0 * i, 0.5], 0) for i in range(7)])  # one direction only
    check_whitening(spark, clustered(6, 3, 12))  # fewer rows than dimensions


def test_whitening_of_few_rows(spark):
    for rows in ([], [(1, [0.5, 0.25], 0)], [(i, [0.5, 0.25], 0) for i in range(5)], [(1, None, 0)], [(1, [], 0), (2, [], 0)]):
        assert whitening.whiten(embedded(spark, rows)).collect() == []


def test_whitening_finds_equal_eigenvalues(spark):
    """Every direction of a cross has the same variance: any basis will do, none may be missing."""
    rows = [(2 * k + s, [float(s * 2 - 1) * (4 if d == k else 0) for d in range(6)], 0) for k in range(6) for s in (0, 1)]
    got = whitening.whiten(embedded(spark, rows)).collect()
    assert len(got) == 4 * 12 and all(r.identity_error < 1e-9 for r in got)
    assert all(abs(r.explained - 1 / 6) < 1e-9 for r in got)


def test_deviation_beyond_a_long():
    x, sums = np.array([[1 << 20, 0], [0, 1]], np.int64), np.array([0, 0], np.int64)
    assert whitening.deviations(x, 1 << 12, sums) == [None, 1 << 24]
    assert whitening.deviations(x, 3, sums) == [9 << 40, 9]


def test_bidiagonal_basis_is_orthonormal():
    """The left vectors, X w, are orthonormal and X v = u b, down to small singular values."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 12)) * np.logspace(0, -6, 12)
    x = (x - x.mean(axis=0)) / np.sqrt(len(x))
    found = whitening.bidiagonalise(lambda q: (float((x @ q) @ (x @ q)), x.T @ (x @ q)), 12, float(np.square(x).sum()), 12)
    u = x @ found.w
    b = np.diag(found.alpha) + np.diag(found.beta[: len(found.alpha) - 1], 1)
    assert np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-8
    assert np.abs(found.v.T @ found.v - np.eye(12)).max() < 1e-12
    assert np.abs(x @ found.v - u @ b).max() < 1e-12
    assert np.allclose(np.linalg.svd(b)[1], np.linalg.svd(x)[1], rtol=1e-6, atol=1e-14)
