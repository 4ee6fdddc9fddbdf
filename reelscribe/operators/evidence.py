"""Evidence, references, links, sections, trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscribe.functions import values as vx
from reelscribe.operators import timeline as tl


def link_by_shared_ids(left: DataFrame, left_id: str, left_ref: str, right: DataFrame, right_id: str, right_ref: str) -> DataFrame:
    """Distinct (left, right) pairs that cite one id; both sides are child rows (owner, id), so no list is collected."""
    l = left.select(left_id, F.col(left_ref).alias("_id")).distinct()
    r = right.select(right_id, F.col(right_ref).alias("_id")).distinct()
    return l.join(r, "_id").select(left_id, right_id).distinct()


def find_dangling_references(rows: DataFrame, ident: str, references: dict[str, tuple[Column, DataFrame, str]]) -> DataFrame:
    """One row per reference that has no parent: (id, kind, missing).

    ``references`` maps a kind to (array of ids, parent table, parent key); an id may have several rows. Distinct missing ids are found
    first, so a hot parent id is joined once however many rows cite it; only the rows that cite one are made distinct.
    """
    out = None
    for kind, (ids, parent, parent_key) in references.items():
        cited = rows.select(F.col(ident), F.explode(ids).alias("missing"))
        known = parent.select(F.col(parent_key).alias("missing")).distinct()
        absent = cited.select("missing").distinct().join(known, "missing", "left_anti")
        bad = cited.join(absent, "missing").distinct().select(ident, F.lit(kind).alias("kind"), F.col("missing").cast("string").alias("missing"))
        out = bad if out is None else out.unionByName(bad)
    return out


def check_exact_cover(items: DataFrame, item_id: str, members: DataFrame) -> DataFrame:
    """Items in no group and items in more than one, with the count."""
    counts = members.groupBy(item_id).agg(F.count(F.lit(1)).alias("_n"))
    both = items.select(item_id).join(counts, item_id, "full").withColumn("times", F.coalesce("_n", F.lit(0)))
    return both.filter("times <> 1").select(item_id, "times", F.when(F.col("times") == 0, "missing").otherwise("duplicate").alias("problem"))


def check_set_equality(declared: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members of one set only, with the side they are on."""
    d = declared.select(*keys).distinct().withColumn("_d", F.lit(True))
    o = observed.select(*keys).distinct().withColumn("_o", F.lit(True))
    both = d.join(o, list(keys), "full")
    return both.filter("_d IS NULL OR _o IS NULL").select(*keys, F.when(F.col("_o").isNull(), "missing").otherwise("extra").alias("problem"))


def compare_independent_passes(records: DataFrame, blind: DataFrame, later: DataFrame) -> DataFrame:
    """Records audited by a blind pass and a later comparison.

    records: formula_id, latex, frame_id. blind: formula_id, blind_frame, observed_at, symbols (map to
    boolean), uncertain (array), latex_consulted. later: formula_id, seen_latex, compared_at, comparison,
    audited_latex, audited_confidence.
    """
    rows = records.join(blind, "formula_id", "left").join(later, "formula_id", "left")
    error = (F.when(F.col("observed_at").isNull() | F.coalesce("latex_consulted", F.lit(True)), "no_blind_observation")
             .when(F.col("compared_at").isNull() | ~F.col("seen_latex").eqNullSafe(F.col("latex")), "no_matching_comparison")
             .when(F.col("compared_at") <= F.col("observed_at"), "comparison_too_early")
             .when(F.col("blind_frame") != F.col("frame_id"), "frame_differs"))
    verified = ((F.size("symbols") > 0) & F.forall(F.map_values("symbols"), lambda v: v) & (F.size("uncertain") == 0)
                & F.col("comparison").isin("exact_match", "equivalent") & (F.coalesce("audited_latex", F.lit("")) != ""))
    ok = F.coalesce(verified, F.lit(False)) & error.isNull()
    return rows.select("formula_id", error.alias("error"), "comparison",
                       F.when(error.isNull(), F.when(ok, "verified").otherwise("needs_review")).alias("audited_status"),
                       F.when(error.isNull(), F.when(ok, F.col("audited_confidence")).otherwise("low")).alias("audited_confidence"),
                       F.when(ok, F.col("audited_latex")).otherwise("").alias("audited_latex"))


def resolve_canonical(rows: DataFrame, ident: str, ids: str, aliases: DataFrame, extra: Column | None = None) -> DataFrame:
    """Ids mapped position by position to their canonical id; ``extra`` is appended when absent.

    ``aliases``: frame_id, canonical_id. ``extra`` is an array of ids (nulls are ignored).
    """
    listed = F.col(ids)
    if extra is not None:
        more = F.filter(F.array_distinct(extra), lambda e: e.isNotNull() & ~F.array_contains(listed, e))
        listed = F.concat(listed, more)
    full = rows.withColumn("_ids", listed)
    refs = full.select(ident, F.posexplode("_ids").alias("_pos", "frame_id")).join(aliases, "frame_id", "left")
    mapped = refs.groupBy(ident).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("canonical_id", "frame_id").alias("c")))), lambda s: s["c"]).alias("_canonical"))
    return full.join(mapped, ident, "left").select(
        *[c for c in rows.columns if c != ids], F.col("_ids").alias(ids),
        F.coalesce("_canonical", F.array().cast("array<string>")).alias("canonical_ids"))


def ordered_members(links: DataFrame, owner: Sequence[str], kind: str, place: str, ref: str, span: int = tl.ROWS_PER_BLOCK) -> DataFrame:
    """Child rows (owner, kind, position, ref_id): what an owner cites, each once, numbered from 1 by (``place``, ``ref``).

    ``place`` is an integer column (a time or a number), cut into blocks of ``span``. Rows, not lists: an owner may cite any number.
    """
    once = links.groupBy(*owner, F.col(ref).alias("_ref")).agg(F.min(place).cast("long").alias("_place"))
    line = tl.Timeline(tuple(owner), ("_place", "_ref"), "_place", span)
    return tl.scan(once, line, row_number="position").select(*owner, F.lit(kind).alias("kind"), "position", F.col("_ref").cast("string").alias("ref_id"))


def with_member_counts(rows: DataFrame, members: DataFrame, owner: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """``rows`` with one ``<kind>_count`` for each kind of their members, zeros included."""
    counts = members.groupBy(*owner).agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_count") for k in kinds])
    joined = tl.join_parts(rows, counts, owner, "left")
    return joined.withColumns({f"{k}_count": F.coalesce(f"{k}_count", F.lit(0)) for k in kinds})


def build_evidence(paragraphs: DataFrame, links: DataFrame, line: tl.Timeline, part_order: str,
                   first: int = 1, claim: Column | None = None) -> DataFrame:
    """One evidence row per paragraph with ids in order; type from the frames and formulas it has.

    ``links`` (part_id, paragraph_id, kind: frame or formula) are made by ``point_in_interval``, one for each id; the rows carry their
    numbers, ``evidence_members`` lists them. ``claim`` defaults to the first 240 characters of the corrected text.
    """
    from reelscribe.operators.sequence import assign_stable_ids

    rows = with_member_counts(paragraphs, links, ["part_id", "paragraph_id"], ("frame", "formula"))
    has_frame, has_formula = F.col("frame_count") > 0, F.col("formula_count") > 0
    kind = F.when(has_frame & has_formula, "speech+slide+formula").when(has_frame, "speech+slide").otherwise("speech")
    text = claim if claim is not None else F.substring("text_corrected", 1, 240)
    return assign_stable_ids(rows.withColumns({"evidence_type": kind, "claim": text}), line, part_order, "E", first, "evidence_id")


def evidence_members(evidence: DataFrame, links: dict[str, tuple[DataFrame, str, str, int]]) -> DataFrame:
    """The segments, frames and formulas of every evidence row, in order.

    ``links``: kind -> (links by part_id and paragraph_id, place, id, span of a block). With ``position`` any row is traced to its sources.
    """
    from reelscribe.session import stage_table

    keys = stage_table(evidence.select("part_id", "paragraph_id", "evidence_id"))
    out = None
    for kind, (rows, place, ref, span) in links.items():
        mine = ordered_members(tl.join_parts(rows, keys, ["part_id", "paragraph_id"]), ["evidence_id"], kind, place, ref, span)
        out = mine if out is None else out.unionByName(mine)
    return out


def _section_rows(plan: DataFrame, paragraphs: DataFrame, part: str) -> DataFrame:
    refs = plan.withColumn("group_no", F.explode(F.sequence("first_no", "last_no")))
    return tl.join_parts(refs, paragraphs, [part, "group_no"])


def build_sections(plan: DataFrame, paragraphs: DataFrame, part: str = "part_id") -> DataFrame:
    """Sections from paragraph number ranges (first_no..last_no); the first paragraph gives the highlight.

    Paragraphs carry paragraph_id, evidence_id, start_ms, end_ms, summary and confidence. What a section cites is in ``section_members``.
    """
    first = F.min_by(F.struct("paragraph_id", "evidence_id", "start_ms"), F.col("group_no"))
    return _section_rows(plan, paragraphs, part).groupBy(part, "section_no", "title").agg(
        first.alias("_f"), F.max_by("end_ms", "group_no").alias("end_ms"), F.count(F.lit(1)).alias("paragraph_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "summary"))), lambda s: s["summary"]), " ").alias("summary"),
        F.max((F.col("confidence") == "medium").cast("int")).alias("_medium")
    ).select(part, vx.numbered("SEC", F.col("section_no"), 4).alias("section_id"), "title", F.col("_f.start_ms").alias("start_ms"), "end_ms",
             "paragraph_count", "summary", F.when(F.col("_medium") == 1, "medium").otherwise("high").alias("confidence"),
             vx.numbered("H", F.col("section_no"), 4).alias("highlight_id"), F.col("_f.paragraph_id").alias("highlight_paragraph"),
             F.col("_f.evidence_id").alias("highlight_evidence"))


def section_members(plan: DataFrame, paragraphs: DataFrame, sections: DataFrame, frames: DataFrame, formulas: DataFrame, bin_size: int, part: str = "part_id") -> DataFrame:
    """Paragraphs, evidence, frames and formulas of every section as child rows, each once and in order.

    ``frames``: links (part, paragraph_id, frame_id, t) of the section's paragraphs. ``formulas`` (part, formula_id, t) belong to the section
    of their time, start included and end not. A highlight has the frames and formulas of its section, and the segments of its evidence.
    """
    from reelscribe.operators.intervals import point_in_interval

    rows = _section_rows(plan, paragraphs, part).select(part, vx.numbered("SEC", F.col("section_no"), 4).alias("section_id"), "group_no", "paragraph_id", "evidence_id")
    owner = [part, "section_id"]
    shown = tl.join_parts(frames, rows.select(*owner, "paragraph_id"), [part, "paragraph_id"])
    timed = point_in_interval(formulas, sections.select(*owner, "start_ms", "end_ms"), [part], "t", "start_ms", "end_ms", bin_size)
    parts = [ordered_members(rows, owner, "paragraph", "group_no", "paragraph_id"), ordered_members(rows, owner, "evidence", "group_no", "evidence_id"),
             ordered_members(shown, owner, "frame", "t", "frame_id", bin_size), ordered_members(timed, owner, "formula", "t", "formula_id", bin_size)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def build_topic_tree(roots: DataFrame, middle: DataFrame, leaves: DataFrame, root: str, node: str, leaf: Sequence[str],
                     name: str, node_name: str, page: int = 4096) -> tuple[DataFrame, DataFrame]:
    """One row per root with its nodes and their leaves nested; (tree, leaves pointing nowhere).

    ``leaf[0]`` is the leaf id. Leaves of a node come in pages of ``page`` by leaf id, so a node with very
    many leaves has several page rows rather than one unbounded list.
    """
    unknown = leaves.join(middle, node, "left_anti").select(*leaf, node)
    line = tl.Timeline((node,), (leaf[0],), leaf[0], page)
    listed = tl.scan(leaves, line, row_number="_n").groupBy(node, F.floor((F.col("_n") - 1) / page).cast("long").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct(*leaf))).alias("children"))
    nodes = middle.join(listed, node, "left").groupBy(root, F.coalesce("page", F.lit(0).cast("long")).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct(node, node_name, F.coalesce("children", F.array().cast(listed.schema["children"].dataType)).alias("children")))).alias("nodes"))
    return roots.select(root, name).join(nodes, root), unknown
