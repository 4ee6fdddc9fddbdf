"""Operator 2, line dedup: lines that several documents share stay only in the largest document that holds them.

1. Every document's distinct line keys (stripped, A-Z lower-cased, long enough) become two 64-bit hashes; the text stays behind.
2. Holders are counted per hash and salt, so a key in a third of all documents is summed on the map side and in ``SALTS`` rows.
3. The sums are range-partitioned by hash and sorted by hash and descending document; the first row of a hash is its keeper.
4. Shared hashes are joined with the documents' lines; a document gets the compressed bitmap of the lines it keeps.
Texts meet their bitmaps in one join on the document. AQE splits that of step 4 where one key is hot.

Compressed bitmap: an array of (word, bits) for each run of 64 lines that loses one, lowest bit first, 1 = keep; runs that are
absent are kept whole.

Edge cases: a null or empty text is one empty line, which is never long enough to be shared. A null id counts as one document
that is smaller than any other, so it never keeps a shared line. Repeated rows of an id count once and are each cut; rows that
share an id and differ in text are told apart by the text's hash. Ties cannot occur, as a keeper is an id. A table without rows
gives none. A text of any length is split whole. Other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscribe.llm.common import BLANKS, ascii_lower
from reelscribe.llm.line_rules import line_list

MIN_CHARS, MIN_DOCUMENTS = 20, 3
SALTS = 32
RUN = 64


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _identified(docs: DataFrame) -> DataFrame:
    """Two columns that tell a document: its id and the hash of its text."""
    return docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.col("text"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, t, pos, h1, h2): every line that is long enough to be shared. Two hashes with other seeds make 128 bits."""
    lines = _identified(docs).select("d", "t", F.posexplode(F.transform(line_list(F.col("text")), line_key)).alias("pos", "key"))
    long_lines = lines.where(F.length("key") >= min_chars)
    return long_lines.select("d", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def shared_hashes(hashes: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(h1, h2, keeper): hashes that enough documents hold, and the largest of these."""
    # Null ids are one document: -1 marks it here only for salting and is no id.
    salted = (
        hashes.groupBy("h1", "h2", "d")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2", F.pmod(F.xxhash64("d"), F.lit(SALTS)).alias("salt"))
        .agg(F.count("one").alias("n"), F.max("d").alias("largest"))
    )
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = salted.repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", F.desc("largest"))
    # The stream in hash order: the first row of a hash holds its largest document. The range partitioning already holds a hash
    # together, so the window adds no shuffle; a hash has at most one row for each salt.
    stream = Window.partitionBy("h1", "h2").orderBy(F.desc("largest"))
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = ranged.select("h1", "h2", F.col("largest").alias("keeper"), F.row_number().over(stream).alias("place"), F.sum("n").over(whole).alias("holders"))
    return firsts.where((F.col("place") == 1) & (F.col("holders") >= min_documents)).select("h1", "h2", "keeper")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(d, t, keep): the documents that lose a line, with the compressed bitmap of the lines they keep."""
    hashes = line_hashes(docs, min_chars)
    shared = shared_hashes(hashes, min_documents)
    lost = hashes.join(shared, ["h1", "h2"]).where(~F.col("d").eqNullSafe(F.col("keeper")))
    runs = lost.groupBy("d", "t", F.expr(f"pos div {RUN}").cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {RUN})")).alias("lost")
    )
    return runs.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("keep"))


def apply_bitmap(lines: Column, keep: Column) -> Column:
    """The lines whose bit is 1 or whose run is absent."""
    by_word = F.map_from_entries(keep)
    dense = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / RUN).cast("int")), lambda w: F.coalesce(F.get(F.map_values(F.map_filter(by_word, lambda k, _: k == w)), F.lit(0)), F.lit(-1)))
    cut = F.transform(
        F.array(dense),
        lambda words: F.filter(lines, lambda _, i: F.get(words, (i / RUN).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % RUN)) != 0),
    )[0]
    return F.when(keep.isNull(), lines).otherwise(cut)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with the columns of :func:`keep_bitmaps` applied: ``kept_lines`` holds the lines that stay, ``n_lines_before`` all."""
    bitmaps = keep_bitmaps(docs, min_chars, min_documents)
    mine = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("own_hash"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("d")) & (F.col("own_hash") == F.col("t"))
    joined = mine.join(bitmaps, same, "left")
    lines = line_list(F.col("doc.text"))
    return joined.select("doc", "keep", F.size(lines).alias("n_lines_before"), apply_bitmap(lines, F.col("keep")).alias("kept_lines"))


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents without their dropped lines, ``n_chars`` counted anew; columns as given. A text may become empty."""
    done = dedup_lines(docs, min_chars, min_documents)
    text = F.when(F.col("keep").isNull(), F.col("doc.text")).otherwise(F.array_join("kept_lines", "\n"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*((changed[c] if c in changed else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
