"""Correction suggestions: matching, proposing, applying, overriding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscribe.functions import text as tx
from reelscribe.functions import values as vx
from reelscribe.operators import sequence as sq
from reelscribe.operators import timeline as tl
from reelscribe.operators.search import term_pieces


def match_terms(texts: DataFrame, ident: Sequence[str], text: str, terms: DataFrame, term: str) -> DataFrame:
    """Every (text row, term row) where the text contains the term, with the ``ident`` columns of the text row and all of the term row;
    empty terms match nothing. ``text`` may be a list of strings. Pieces of the texts that pass a filter of the terms join them, see ``search``."""
    return term_pieces(texts, ident, text, terms, term).join(terms.withColumn("_term", F.col(term)), "_term").drop("_term")


def split_suggestions(suggestions: DataFrame) -> DataFrame:
    """Alternatives ``a/b`` with ``x/y`` pairwise; unequal counts repeat the whole suggestion."""
    originals = F.transform(F.split("original", "/", -1), tx.strip)
    proposed = F.transform(F.split("suggested", "/", -1), tx.strip)
    same = F.size(originals) == F.size(proposed)
    pairs = F.when(same, F.arrays_zip(originals.alias("o"), proposed.alias("s"))).otherwise(
        F.transform(originals, lambda o: F.struct(o.alias("o"), F.col("suggested").alias("s"))))
    return suggestions.select("*", F.posexplode(pairs).alias("alt_no", "_alt")).withColumns(
        {"alt_original": F.col("_alt.o"), "alt_suggested": F.col("_alt.s")}).drop("_alt")


def propose_corrections(suggestions: DataFrame, cited: DataFrame, paragraphs: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corrections, skipped suggestions).

    ``suggestions``: suggestion_no (encounter order), original, suggested, confidence, decision.
    ``cited``: suggestion_no with segment_id or frame_id. ``paragraphs``: paragraph_no, paragraph_id,
    text_clean, segment_id list as child rows is not needed: ``paragraph_segments`` are derived from
    ``source_segment_ids``. ``frames``: frame_id. The first suggestion per (paragraph, original) wins; an
    accepted one needs high confidence and a known frame, else it is pending.
    """
    from reelscribe.session import stage_table

    alts = split_suggestions(suggestions)
    members = paragraphs.select("paragraph_no", "paragraph_id", F.explode("source_segment_ids").alias("segment_id"))
    touched = (cited.filter("segment_id IS NOT NULL").join(members, "segment_id")
               .groupBy("suggestion_no", "paragraph_no").agg(F.count_distinct("segment_id").alias("cited_segments")))
    seen = (cited.filter("frame_id IS NOT NULL").join(frames.select("frame_id").distinct(), "frame_id")
            .groupBy("suggestion_no").agg(F.count_distinct("frame_id").alias("cited_frames")))
    # Most terms are not there at all. For whole-word terms the runs of letters of a text, taken once, tell that without a look at the text.
    compact = F.replace("alt_original", F.lit(" "), F.lit(""))
    keyed = alts.withColumns({"_compact": compact, "_key": tx.key_run(F.col("alt_original")), "_compact_key": tx.key_run(compact)})
    texts = paragraphs.select("paragraph_no", "paragraph_id", "text_clean", tx.letter_runs(F.col("text_clean")).alias("_runs"))
    rows = keyed.join(touched, "suggestion_no").join(texts, "paragraph_no")

    def may_occur(key: str) -> Column:
        return F.col(key).isNull() | F.array_contains("_runs", F.col(key))

    def occurs(term: str, key: str) -> Column:
        held = F.contains(F.col("text_clean"), F.col(term)) & tx.holds_term(F.col("text_clean"), F.col(term))
        return F.coalesce((F.col(term) != "") & may_occur(key) & held, F.lit(False))

    actual = F.when(occurs("alt_original", "_key"), F.col("alt_original")).when(occurs("_compact", "_compact_key"), F.col("_compact"))
    rows = rows.withColumn("original_text", actual).filter("original_text IS NOT NULL")
    encounter = F.struct("suggestion_no", "alt_no")
    first = rows.groupBy("paragraph_no", "paragraph_id", "original_text").agg(
        F.min_by(F.struct("suggestion_no", "alt_no", F.col("alt_suggested").alias("suggested_text"), "confidence", "decision", "cited_segments"),
                 encounter).alias("_r"))
    first = first.select("paragraph_no", "paragraph_id", "original_text", "_r.*").join(seen, "suggestion_no", "left")
    frames_known = F.coalesce("cited_frames", F.lit(0))
    downgrade = (F.col("decision") == "accepted") & ((F.col("confidence") != "high") | (frames_known == 0))
    decided = first.withColumn("cited_frames", frames_known).withColumn(
        "decision", F.when(downgrade, "pending").otherwise(F.col("decision"))).withColumn("applied", F.col("decision") == "accepted")
    # Numbers run over the alternatives in encounter order, and in blocks of paragraphs within each.
    ranked = stage_table(decided.withColumn("_alt", F.shiftleft(F.col("suggestion_no").cast("long"), 20) + F.col("alt_no")))
    line = tl.by_position(["_alt"], "paragraph_no")
    numbered = sq.assign_stable_ids(ranked, line, "_alt", prefix="C", name="correction_id").drop("_alt")

    # A suggestion is skipped when no correction holds one of its (untrimmed) originals and shares a segment.
    parts = suggestions.select("suggestion_no", F.explode(F.split("original", "/", -1)).alias("original_text")).distinct()
    owned = numbered.select("paragraph_no", "original_text", F.col("suggestion_no").alias("_owner"))
    evidence = cited.filter("segment_id IS NOT NULL").join(members, "segment_id").select("suggestion_no", "paragraph_no", "segment_id").distinct()
    owner_evidence = evidence.withColumnRenamed("suggestion_no", "_owner")
    covered = (parts.join(evidence, "suggestion_no").join(owned, ["paragraph_no", "original_text"])
               .join(owner_evidence, ["_owner", "paragraph_no", "segment_id"], "left_semi").select("suggestion_no").distinct())
    return numbered, suggestions.join(covered, "suggestion_no", "left_anti")


def apply_corrections(texts: DataFrame, corrections: DataFrame, key: str, text: str, order: str = "ord", first_only: bool = False) -> DataFrame:
    """Apply accepted corrections to each text in order; lists what did not apply. Texts are paragraphs or segments by ``key``.

    All occurrences are replaced, whole words only for ASCII terms; with ``first_only`` the first one, as plain text.

    The list collected per text is its own accepted corrections. ``correction_ids`` names all of them.
    """
    item = F.struct(order, "correction_id", "original_text", "suggested_text", "applied")
    listed = corrections.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_c"))
    start = F.struct(F.col(text).alias("text"), F.array().cast("array<string>").alias("missed"))

    def step(acc: Column, c: Column) -> Column:
        if first_only:
            at = F.position(c["original_text"], acc["text"])
            hit, changed = at > 0, F.concat(F.substr(acc["text"], F.lit(1), at - 1), c["suggested_text"], F.substr(acc["text"], at + F.length(c["original_text"])))
        else:
            hit = tx.count_term(acc["text"], c["original_text"]) > 0
            changed = tx.replace_term(acc["text"], c["original_text"], c["suggested_text"])
        replaced = F.when(hit, changed).otherwise(acc["text"])
        missed = F.when(hit, acc["missed"]).otherwise(F.concat(acc["missed"], F.array(c["correction_id"])))
        return F.struct(replaced.alias("text"), missed.alias("missed"))

    active = F.filter(F.coalesce("_c", F.array().cast(listed.schema["_c"].dataType)), lambda c: c["applied"])
    return texts.join(listed, key, "left").withColumn("_a", F.aggregate(active, start, step)).select(
        *texts.columns, F.col("_a.text").alias("text_corrected"), F.col("_a.missed").alias("not_applied"),
        F.coalesce(F.transform("_c", lambda c: c["correction_id"]), F.array().cast("array<string>")).alias("correction_ids"))


def apply_overrides(corrections: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corrections with audited values, unknown override ids)."""
    o = overrides.select("correction_id", *[F.col(c).alias(f"_{c}") for c in ("suggested_text", "decision", "confidence", "reason")])
    hit = F.col("_decision").isNotNull()
    out = corrections.join(o, "correction_id", "left").withColumns({
        "suggested_text": F.when(hit, F.col("_suggested_text")).otherwise(F.col("suggested_text")),
        "confidence": F.when(hit, F.col("_confidence")).otherwise(F.col("confidence")),
        "applied": F.when(hit, F.col("_decision") == "accepted").otherwise(F.col("applied")),
        "reason": F.when(hit, F.concat(F.lit("independent audit: "), F.coalesce("_reason", F.lit("")))).otherwise(F.col("reason")),
        "decision": F.when(hit, F.col("_decision")).otherwise(F.col("decision"))})
    return out.select(*corrections.columns), overrides.join(corrections, "correction_id", "left_anti").select("correction_id")


def first_mention(terms: DataFrame, segments: DataFrame, ident: Sequence[str], text: str, start: str, default: int) -> DataFrame:
    """Start of the first row whose lower-cased text ('-' read as blank) contains the term; ``ident`` tells rows apart."""
    shaped = segments.select(F.translate(F.lower(text), "-", " ").alias("_t"), F.col(start).alias("_start"))
    wanted = terms.withColumn("_key", F.translate(F.lower("term"), "-", " "))
    hits = term_pieces(shaped, ["_start"], "_t", wanted, "_key", "_key").groupBy("_key").agg(F.min("_start").alias("_first"))
    return wanted.join(hits, "_key", "left").select(*terms.columns, F.coalesce("_first", F.lit(default)).alias("first_start"))


def search_timeline(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Case-insensitive substring search of every ``query`` in every layer of every item: (kind, item_id, t, query), each once.

    ``items`` has kind, item_id, t and a ``haystack`` array of its layers (title, raw, cleaned and corrected text, symbols, aliases, ...).
    """
    lowered = items.select("kind", "item_id", "t", F.transform("haystack", F.lower).alias("_text"))
    asked = queries.select("query", F.lower("query").alias("_query")).distinct()
    hits = match_terms(lowered, ["kind", "item_id", "t"], "_text", asked, "_query")
    return hits.select("kind", "item_id", "t", "query").distinct()


def correction_members(corrections: DataFrame, cited: DataFrame, paragraphs: DataFrame, frames: DataFrame) -> DataFrame:
    """The evidence of every correction as child rows (correction_id, kind, position, ref_id): its suggestion's segments in the
    paragraph, in the paragraph's order, and the suggestion's known frames in order of their ids. Arguments as for ``propose_corrections``."""
    from reelscribe.operators.evidence import ordered_members

    keys = corrections.select("correction_id", "suggestion_no", "paragraph_no")
    members = paragraphs.select("paragraph_no", F.posexplode("source_segment_ids").alias("_place", "segment_id"))
    spoken = cited.filter("segment_id IS NOT NULL").select("suggestion_no", "segment_id").join(members, "segment_id").join(keys, ["suggestion_no", "paragraph_no"])
    known = cited.filter("frame_id IS NOT NULL").select("suggestion_no", "frame_id").join(frames.select("frame_id").distinct(), "frame_id")
    seen = known.join(keys, "suggestion_no").withColumn("_place", F.lit(0))
    return ordered_members(spoken, ["correction_id"], "segment", "_place", "segment_id").unionByName(ordered_members(seen, ["correction_id"], "frame", "_place", "frame_id"))
