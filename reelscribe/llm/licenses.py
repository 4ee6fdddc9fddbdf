"""Operator 1, licence scans by diagonal voting.

1. Every run of ``k`` words of a text is hashed (k = ``GRAM``, or all words of a shorter template). Those whose hash a template
   holds are joined with the template positions: an equal run is a vote for the diagonal text position - template position.
2. Votes are summed per text, template and diagonal.
3. Diagonals that lie at most ``DRIFT`` apart are merged, so a notice with words put in or left out stays one span.
4. A span is verified by the share of the template's positions it holds: phrases want all of them on one diagonal, which is an
   exact place; notices want ``MIN_SHARE``. Runs are compared word by word in the join, so no hash is trusted.

The templates are a fixed list, so the table of their positions, and its hashes that every task knows, have a fixed size.
Edge cases: a null or empty text has no words and no labels. Rows with null ids and repeated rows are scanned like any other; an
empty table gives no rows. Overlapping places all count, and so do two labels of one place. Texts of any length are scanned whole, a slice of
about a megabyte or one text at a time. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelscribe.llm.common import WORD_BYTES, WORD_PATTERN, gram_hashes, inside_one_text, text_slices, with_row_number, word_hashes, word_spans
from reelscribe.session import stage_table

GRAM, DRIFT, MIN_SHARE = 3, 3, 0.6
#: Phrases whose every place counts.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wordings of public licence notices.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("all rights reserved", "all-rights-reserved"),
)
VOTE = pa.struct([("k", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()), ("words", pa.list_(pa.string()))])


def template_positions() -> list[tuple]:
    """(template, label, exact, n_grams, k, h, at, words) for every run of every template."""
    rows = []
    for number, (text, label) in enumerate(PHRASES + NOTICES):
        words = re.findall(WORD_PATTERN, text)
        s = next(text_slices(pa.array([text])))
        hashes = word_hashes(s.low, *word_spans(s, WORD_BYTES)[:2])
        k = min(GRAM, len(words))
        grams = gram_hashes(hashes, k).view(np.int64).tolist()
        rows += [(number, label, number < len(PHRASES), len(grams), k, h, at, words[at : at + k]) for at, h in enumerate(grams)]
    return rows


def _votes(docs: DataFrame, rows: list[tuple]) -> DataFrame:
    """(doc_id, n_words, votes): the runs of every text whose hash a template holds."""
    known = {k: np.unique(np.array([r[5] for r in rows if r[4] == k], np.int64)).view(np.uint64) for k in {r[4] for r in rows}}
    known = {k: np.sort(v) for k, v in known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, votes = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for s in text_slices(batch.column(1)):
                starts, ends, first = word_spans(s, WORD_BYTES)
                counts[s.first : s.first + s.n] = np.diff(first)
                owner = np.repeat(np.arange(s.n), np.diff(first))
                hashes = word_hashes(s.low, starts, ends)
                for k, have in known.items():
                    grams = gram_hashes(hashes, k)
                    near = np.minimum(np.searchsorted(have, grams), len(have) - 1)
                    for pos in np.flatnonzero((have[near] == grams) & inside_one_text(first, k, len(hashes))).tolist():
                        words = [s.low[starts[w] : ends[w]].tobytes().decode() for w in range(pos, pos + k)]
                        votes[s.first + owner[pos]].append({"k": k, "h": int(grams[pos].view(np.int64)), "pos": int(pos - first[owner[pos]]), "words": words})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(votes, pa.list_(VOTE))], ["doc_id", "n_words", "votes"])

    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, votes array<struct<k:int,h:bigint,pos:int,words:array<string>>>")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words and ``spans`` (label, exact, start, end, share), verified and in order."""
    spark: SparkSession = docs.sparkSession
    rows = template_positions()
    templates = F.broadcast(spark.createDataFrame(rows, "template int, label string, exact boolean, n_grams int, k int, h bigint, at int, words array<string>"))
    counted = with_row_number(stage_table(_votes(docs, rows)), "row_no")
    votes = counted.select("row_no", F.explode("votes").alias("v")).select("row_no", "v.*").join(templates, ["k", "h", "words"])
    lines = votes.groupBy("row_no", "template", "label", "exact", "n_grams", "k", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("held"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    order = Window.partitionBy("row_no", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    # A phrase is an exact place on its own diagonal; only notices merge with their neighbours.
    opened = lines.withColumn("opens", F.when(F.col("exact") | (gap > DRIFT) | gap.isNull(), 1).otherwise(0))
    spans = (
        opened.withColumn("span", F.sum("opens").over(order))
        .groupBy("row_no", "template", "label", "exact", "n_grams", "k", "span")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"), F.min("low").alias("start"), (F.max("high") + F.col("k")).alias("end"))
        .withColumn("share", F.col("held") / F.col("n_grams"))
        .where(F.when(F.col("exact"), F.col("held") == F.col("n_grams")).otherwise(F.col("share") >= MIN_SHARE))
    )
    by_doc = spans.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "exact", "share"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int,label:string,exact:boolean,share:double>>")
    return counted.select("row_no", "doc_id", "n_words").join(by_doc, "row_no", "left").select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"))
