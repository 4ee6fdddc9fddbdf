"""Operator 11, hard-negative mining over an inverted multi-index.

1. Vectors become integers. Two codebooks, one for each half of the dimensions, are fitted on a bounded sample; a pair of code words is a
   cell. Every row is put into its cell, and every code word gets a radius that covers its rows.
2. A query's half score with a code word, plus the length of the query's half times the radius, bounds the half score of all rows of that
   word. A heap visits cells by the sum of both bounds (multi-sequence walk); all numbers are integers rounded to the safe side.
3. Visits go on in rounds of growing budgets, as joins of queries with blocks of cells. Any row not visited scores at most the next bound, so
   a list of positives is certified when its last score exceeds that bound, and the window of a positive when its last negative does
   or the window's lower end does. Results are exact whatever the codebooks are.
4. Cells are cut into blocks of about ``BLOCK_ROWS`` rows and the queries of a cell into chunks of about ``CHUNK_QUERIES``, so neither a hot
   vector nor a popular cell is the work of one task; a task returns no more than the rows it may contribute.

Higher scores come first, ties by smaller id (null ids last). Edge cases: rows without label, and rows whose vector is null or holds a null,
a non-finite component or one of 2^17 or more in size, take no part. A vector shorter than the longest one has zeros beyond its end.
Rows with a null id are positives and negatives like any other; rows of an anchor's own id are neither for it. Repeated rows are rows of
their own, as candidates and as anchors. A window below zero is empty. An empty table gives no rows. Only id, vector and label are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscribe.llm.common import with_row_number
from reelscribe.llm.vectors import decode, encode, integer_vectors
from reelscribe.session import stage_table

POSITIVES, NEGATIVES = 5, 5
#: A negative's score in hundredths of its positive's.
LEAST_SHARE, MOST_SHARE = 80, 100
SAMPLE_ROWS, CELL_ROWS, MOST_WORDS = 4096, 256, 256
BLOCK_ROWS, CHUNK_QUERIES = 1024, 1024
FIRST_BUDGET, GROWTH = 4096, 8
LIMIT = 1 << 25


def _root(squares: np.ndarray) -> np.ndarray:
    """Roots of integers, rounded up."""
    return np.ceil(np.sqrt(squares.astype(np.float64)) * (1 + 1e-12)).astype(np.int64)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = (x.shape[1] + 1) // 2
    return x[:, :half], x[:, half:]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: by floating numbers where these hold them."""
    most = [int(np.abs(m).max()) if m.size else 0 for m in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def code_book(sample: np.ndarray, words: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """At most ``words`` integer vectors: Lloyd's rounds over the sample from distinct rows of it."""
    distinct = np.unique(sample, axis=0)
    book = distinct[np.random.default_rng(seed).permutation(len(distinct))[:words]]
    for _ in range(rounds):
        nearest = assign(sample, book)[0]
        counts = np.bincount(nearest, minlength=len(book))
        sums = np.zeros(book.shape)
        np.add.at(sums, nearest, sample)
        book = np.where(counts[:, None] > 0, np.rint(sums / np.maximum(counts, 1)[:, None]), book).astype(np.int64)
    return book


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest word of every row and the square of the distance to it."""
    nearest = (np.square(book).sum(axis=1)[None, :] - 2 * products(x, book)).argmin(axis=1)
    return nearest, np.square(x - book[nearest]).sum(axis=1)


class Index:
    """The books, radii and cell sizes: at most MOST_WORDS words for a half, so at most MOST_WORDS^2 cells."""

    def __init__(self, books: list[np.ndarray], width: int):
        self.books, self.width = books, width
        self.radii = [np.zeros(len(b), np.int64) for b in books]
        self.rows = np.zeros((len(books[0]), len(books[1])), np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        (one, d1), (two, d2) = (assign(h, b) for h, b in zip(_halves(x), self.books))
        return one * len(self.books[1]) + two, [d1, d2]

    def measure(self, cell: int, rows: int, d1: int, d2: int) -> None:
        i, j = divmod(cell, len(self.books[1]))
        self.rows[i, j] = rows
        for k, (word, d) in enumerate(((i, d1), (j, d2))):
            self.radii[k][word] = max(self.radii[k][word], int(_root(np.array([d]))[0]))

    def bounds(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half, the highest and the lowest half score that rows of each word may have with each query."""
        out = []
        for half, book, radius in zip(_halves(queries), self.books, self.radii):
            middle, slack = products(half, book), _root(np.square(half).sum(axis=1))[:, None] * radius[None, :]
            out.append((middle + slack, middle - slack))
        return out

    def blocks(self, cell: int) -> int:
        return int(-(-self.rows.flat[cell] // BLOCK_ROWS))

    def walk(self, high: list[np.ndarray], low: list[np.ndarray], seen: int, budget: int, stop: int | None, most: int | None) -> tuple[list[int], int, int | None]:
        """Cells of the next ``budget`` rows in falling order of the bound, how many are seen then, and the bound of the next one.

        Ends early where the bound is below ``stop``. Cells whose rows all score above ``most`` are passed over.
        """
        order = [np.argsort(-h, kind="stable") for h in high]
        (a, b), (la, lb) = ([h[o].tolist() for h, o in zip(side, order)] for side in (high, low))
        heap, at, rows, cells = [(-(a[0] + b[0]), 0, 0)], 0, 0, []
        while heap:
            bound, i, j = heap[0]
            if at >= seen and (rows >= budget or stop is not None and -bound < stop):
                return cells, at, -bound
            heapq.heappop(heap)
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            at += 1
            n = self.rows[order[0][i], order[1][j]]
            if at > seen and n and (most is None or la[i] + lb[j] <= most):
                cells.append(int(order[0][i] * len(self.books[1]) + order[1][j]))
                rows += n
        return cells, at, None


def build_index(vectors: DataFrame) -> tuple[Index, DataFrame] | None:
    """The index and its staged rows (row_no, cell, vec_id, label, is_anchor, x); None for an empty table."""
    known = vectors.agg(F.count("*").alias("n"), F.max(F.length("x")).alias("bytes")).first()
    if not known.n:
        return None
    part = min(1.0, 2 * SAMPLE_ROWS / known.n)  # by hash first, so that few rows are sorted
    drawn = vectors.withColumn("h", F.xxhash64("row_no")).where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(part * (1 << 30))))
    sample = decode([bytes(r.x) for r in drawn.orderBy("h", "row_no").limit(SAMPLE_ROWS).select("x").collect()])
    width = max(sample.shape[1], vectors.agg(F.max(((F.length("x") - 1) / F.ascii(F.substring("x", 1, 1))).cast("int"))).first()[0])
    sample = np.pad(sample, ((0, 0), (0, width - sample.shape[1])))
    words = int(min(MOST_WORDS, max(2, round((known.n / CELL_ROWS) ** 0.5))))
    index = Index([code_book(h, words) if len(h) else np.zeros((1, h.shape[1]), np.int64) for h in _halves(sample)], width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, squares = index.cells(decode(batch.column("x").to_pylist(), width))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(pa.array(d) for d in squares), *batch.columns], ["cell", "d1", "d2", *batch.schema.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    placed = stage_table(vectors.mapInArrow(place, f"cell int, d1 long, d2 long, {kinds}"))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect():
        index.measure(r.cell, r.n, r.d1, r.d2)
    return index, placed.drop("d1", "d2")


def visit(index: Index, rows: DataFrame, queries: DataFrame, score: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``score`` of (queries, rows) for all blocks of the cells that the queries visit. ``queries``: a, cells and more."""
    visits = queries.withColumn("cell", F.explode("cells")).drop("cells")
    # One row for each cell that is visited, at most MOST_WORDS^2.
    met = visits.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("chunks"))
    sizes = queries.sparkSession.createDataFrame([(c, index.blocks(c)) for c in np.flatnonzero(index.rows).tolist()], "cell int, blocks int")
    shape = F.broadcast(stage_table(met.join(F.broadcast(sizes), "cell")))
    one = visits.join(shape, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int"))
    two = rows.join(shape, "cell").withColumn("block", F.pmod(F.xxhash64("row_no"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["cell", "block", "chunk"]
    left = one.drop("blocks", "chunks").groupBy(*keys)
    return left.cogroup(two.select(*keys, "vec_id", "label", "x").groupBy(*keys)).applyInArrow(lambda a, b: score(a, b), schema)


def next_cells(index: Index, queries: DataFrame, budget: int) -> DataFrame:
    """``queries`` (a, seen, stop, most and more) with their next cells, the new ``seen`` and the bound beyond, staged."""
    names = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (h1, l1), (h2, l2) = index.bounds(decode(batch.column("x").to_pylist(), index.width))
            columns = [batch.column(c).to_pylist() for c in ("seen", "stop", "most")]
            found = [index.walk([h1[k], h2[k]], [l1[k], l2[k]], seen, budget, stop, most) for k, (seen, stop, most) in enumerate(zip(*columns))]
            kept = [batch.column(c) for c in names if c not in ("seen", "bound")]
            cells, seen, bound = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cells, pa.list_(pa.int32())), pa.array(seen, pa.int32()), pa.array(bound, pa.int64())], [*(c for c in names if c not in ("seen", "bound")), "cells", "seen", "bound"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields if f.name not in ("seen", "bound"))
    return stage_table(queries.mapInArrow(run, f"{kinds}, cells array<int>, seen int, bound long"))


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as an array of longs, and which ones are null."""
    null = column.is_null().to_numpy()
    return column.fill_null(0).to_numpy().astype(np.int64), null


def _first(scores: np.ndarray, open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a matrix, its ``k`` first open columns by falling score; equal scores in the order of the columns."""
    kept = np.where(open_, scores, np.iinfo(np.int64).min)
    if kept.shape[1] > k:
        least = np.partition(kept, kept.shape[1] - k, axis=1)[:, kept.shape[1] - k]
        open_ = open_ & (kept >= least[:, None])
    row, col = np.nonzero(open_)
    order = np.lexsort((col, -kept[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _scored(queries: pa.Table, rows: pa.Table, width: int):
    """Rows in the order of ties (id, nulls last), with the matrix of scores and what is not the query's own id."""
    ids, null = _ids(rows.column("vec_id"))
    order = np.lexsort((ids, null))
    x = decode(rows.column("x").to_pylist(), width)[order]
    scores = products(decode(queries.column("x").to_pylist(), width), x)
    own, own_null = _ids(queries.column("vec_id"))
    other = (own[:, None] != ids[order][None, :]) | (own_null[:, None] != null[order][None, :])
    same = queries.column("label").to_numpy()[:, None] == rows.column("label").to_numpy()[order][None, :]
    return order, scores, other, same


def best_positives(index: Index, rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(a, place, score, id): the first ``k`` rows of each anchor's label, staged."""
    width = index.width

    def score(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        order, scores, other, same = _scored(queries, rows, width)
        q, r = _first(scores, other & same, k)
        return pa.table({"a": queries.column("a").take(pa.array(q)), "score": pa.array(scores[q, r]), "id": rows.column("vec_id").take(pa.array(order[r]))})

    none = F.lit(None).cast("long")
    todo, budget = anchors.select("a", "vec_id", "label", "x", F.lit(0).alias("seen"), none.alias("stop"), none.alias("most")), FIRST_BUDGET
    found = None
    ranked = Window.partitionBy("a").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    while True:
        walked = next_cells(index, todo, budget)
        new = visit(index, rows, walked.drop("seen", "bound", "stop", "most"), score, "a long, score long, id long")
        both = new if found is None else found.drop("place").unionByName(new)
        found = stage_table(both.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k))
        last = found.where(F.col("place") == k).select("a", F.col("score").alias("last"))
        todo = walked.where("bound is not null").drop("cells", "stop").join(last, "a", "left").where("last is null or bound >= last").select(
            "a", "vec_id", "label", "x", "seen", F.col("last").alias("stop"), none.alias("most")
        )
        if todo.isEmpty():
            return found
        budget *= GROWTH


def windowed_negatives(index: Index, rows: DataFrame, anchors: DataFrame, positives: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """(a, place, rank, score, id): for each positive, the first ``k`` rows of other labels within its window."""
    width, (least, most) = index.width, share
    windows = positives.where("score >= 0").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("windows"))  # a few for an anchor

    def score(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            order, scores, other, same = _scored(queries, rows, width)
            lists = queries.column("windows").to_pylist()
            for n in range(max(map(len, lists))):
                # Queries with fewer windows have none of this number: an upper end below all scores.
                at = [w[n] if n < len(w) else None for w in lists]
                p = np.array([w["score"] if w else -1 for w in at], np.int64)[:, None]
                q, r = _first(scores, other & ~same & (p >= 0) & (least * p <= 100 * scores) & (100 * scores <= most * p), k)
                out.append(
                    pa.table({"a": queries.column("a").take(pa.array(q)), "place": pa.array([at[i]["place"] for i in q.tolist()], pa.int32()), "score": pa.array(scores[q, r]), "id": rows.column("vec_id").take(pa.array(order[r]))})
                )
        empty = pa.table({"a": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        return pa.concat_tables(out or [empty]).combine_chunks()

    ends = F.transform("windows", lambda w: F.ceil(w["score"] * least / 100).cast("long"))
    top = F.floor(F.array_max(F.transform("windows", lambda w: w["score"])) * most / 100).cast("long")
    base = anchors.join(windows, "a")
    todo, budget = base.select("a", "vec_id", "label", "x", "windows", F.lit(0).alias("seen"), F.array_min(ends).alias("stop"), top.alias("most")), FIRST_BUDGET
    found = None
    ranked = Window.partitionBy("a", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    while True:
        walked = next_cells(index, todo, budget)
        new = visit(index, rows, walked.drop("seen", "bound", "stop", "most"), score, "a long, place int, score long, id long")
        both = new if found is None else found.drop("rank").unionByName(new)
        found = stage_table(both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))
        # A full window needs nothing below its last score, any other one nothing below its lower end.
        full = found.where(F.col("rank") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("lasts"))
        need = F.array_min(F.transform("windows", lambda w: F.coalesce(F.try_element_at(F.col("lasts"), w["place"]), F.ceil(w["score"] * least / 100).cast("long"))))
        todo = walked.where("bound is not null").drop("cells", "stop").join(full, "a", "left").withColumn("stop", need).where("bound >= stop").select("a", "vec_id", "label", "x", "windows", "seen", "stop", "most")
        if todo.isEmpty():
            return found
        budget *= GROWTH


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = (LEAST_SHARE, MOST_SHARE)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (vec_id, label, embedding) that are anchors."""
    spark = rows.sparkSession
    keep = [rows["vec_id"].cast("long").alias("vec_id"), rows["label"].cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")]
    vectors = with_row_number(stage_table(integer_vectors(rows.where(rows["label"].isNotNull()), keep, "embedding", LIMIT)), "row_no")
    built = build_index(vectors)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if built is None:
        return spark.createDataFrame([], schema)
    index, placed = built
    anchors = placed.where("is_anchor").select(F.col("row_no").alias("a"), "vec_id", "label", "x")
    good = best_positives(index, placed, anchors, positives)
    bad = windowed_negatives(index, placed, anchors, good, negatives, share)
    named = bad.withColumnsRenamed({"score": "negative_score", "id": "negative_id"}).join(good.withColumnsRenamed({"score": "positive_score", "id": "positive_id"}), ["a", "place"])
    return named.join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
