"""Paragraphs and packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelscribe.functions import text as tx
from reelscribe.functions import values as vx
from reelscribe.operators import timeline as tl
from reelscribe.operators.intervals import overlap_join

# Sentence ends and transition cues that close a paragraph.
TERMINALS = ("。", "？", "！")
TRANSITIONS = ("接下来", "然后我们", "下面", "总结")

# Stands between the terms of a text that travel together.
_BETWEEN = "\x1f"


def group_by_boundaries(segments: DataFrame, line: tl.Timeline, boundaries: DataFrame, durations: DataFrame,
                        end: str = "end_ms", slack: int = 1, beyond: int = 1000) -> DataFrame:
    """Close a paragraph at the first row with ``end >= boundary - slack``; each close uses one boundary.

    ``boundaries`` (part, boundary) are cut at the part's ``duration``; a part left with none has one at its
    duration. Rows ending ``beyond`` the duration close after the last one too. A row's limit is the number of boundaries it reaches, counted by one scan
    over rows and boundaries in order of time; the limits are then folded in order of the rows, so ends may fall as well as rise.
    """
    part = list(line.part)
    place = list(dict.fromkeys([*part, *line.order, line.block_on]))
    kept = tl.join_parts(boundaries, durations, part).filter(F.col("boundary") <= F.col("duration")).select(*part, "boundary").distinct()
    bare = tl.join_parts(durations, kept, part, "left_anti").select(*part, F.col("duration").alias("boundary"))
    marks = kept.unionByName(bare).select(*part, F.col("boundary").alias("_at"), F.lit(0).alias("_kind"))
    rows = segments.select(*place, (F.col(end) + slack).alias("_at"), F.lit(1).alias("_kind"))
    both, by_end = tl.split_hot_blocks(rows.unionByName(marks, allowMissingColumns=True), tl.Timeline(line.part, ("_at", "_kind", *[c for c in line.order if c not in part]), "_at", 3_600_000))
    counted = tl.scan(both, by_end, sum_upto={"_limit": 1 - F.col("_kind")}).filter("_kind = 1")
    late = F.when(F.col("_at") >= F.col("duration") + beyond, F.lit(int(tl.ALWAYS) // 2)).otherwise(F.col("_limit"))
    limited = tl.join_parts(counted, durations.select(*part, "duration"), part, "left").select(*place, late.alias("_limit"))
    closed = tl.closed_by_limits(limited, line, F.col("_limit"), "_closes", "_n")
    groups = closed.select(*place, (F.col("_n") - F.col("_closes").cast("long") + 1).alias("group_no"))
    return tl.join_parts(segments, groups, place).select(*segments.columns, "group_no")


def sessionize_paragraphs(segments: DataFrame, line: tl.Timeline, start: str = "start_ms", end: str = "end_ms",
                          closes_after: Column | None = None, max_length: int = 70_000, min_length: int = 42_000) -> DataFrame:
    """Close before a row that would pass ``max_length``, or after a closing row at ``min_length`` or more."""
    if closes_after is None:
        text = F.col("text_clean")
        closes_after = text.rlike("|".join(TRANSITIONS)) | text.rlike("(" + "|".join(TERMINALS) + r")\z")
    near = tl.scan(segments, line, previous={"_p_end": F.col(end), "_p_close": closes_after})
    # The row opens a paragraph iff the open one's start is below this threshold.
    before = F.col(end) - max_length
    after = F.when(F.col("_p_close"), F.col("_p_end") - min_length + 1)
    return tl.carried_groups(near, line, F.greatest(before, after), F.col(start), "_opens", "group_no").select(*segments.columns, "group_no")


def build_paragraphs(segments: DataFrame, part: str = "part_id", clean: str = "text_clean", packet_ms: int = 300_000,
                     max_packet: int | None = None, untitled: str = "新增课程段落") -> DataFrame:
    """One row per (part, group_no), texts joined in order. Groups are bounded by their time length."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "segment_id", "text_raw", F.col(clean).alias("text_clean"), "start_ms", "end_ms")))
    grouped = segments.groupBy(part, "group_no").agg(listed.alias("_s"))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("_s", lambda s: s[field]), "")

    start, end = F.col("_s")[0]["start_ms"], F.element_at("_s", -1)["end_ms"]
    packet = F.floor(start / packet_ms).cast("long") + 1
    packet = F.least(packet, F.lit(max_packet)) if max_packet else packet
    title = F.regexp_replace(F.substring(joined("text_clean"), 1, 22), r"[，。！？；：]+$", "")
    title = F.when(title == "", F.lit(untitled)).otherwise(title)
    return grouped.select(
        part, "group_no", vx.numbered("PAR", F.col("group_no"), 4).alias("paragraph_id"), start.alias("start_ms"),
        end.alias("end_ms"), title.alias("title"), joined("text_raw").alias("text_raw"), joined("text_clean").alias("text_clean"),
        F.transform("_s", lambda s: s["segment_id"]).alias("source_segment_ids"), vx.numbered("P", packet, 4).alias("packet_id"))


def build_paragraphs_from_plan(plan: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraphs from listed segment ids; (paragraphs, unknown references).

    ``plan`` has part_id, paragraph_no, segment_ids and an optional ``clean_override``; an empty override counts as none, and
    the clean text is then made from the segments' ``text_clean``.
    """
    refs = plan.select("part_id", "paragraph_no", "clean_override", F.posexplode("segment_ids").alias("_pos", "segment_id"))
    joined = refs.join(segments.select("part_id", "segment_id", "text_raw", "text_clean", "start_ms", "end_ms"), ["part_id", "segment_id"], "left")
    unknown = joined.filter("start_ms IS NULL").select("part_id", "paragraph_no", "segment_id")
    listed = F.array_sort(F.collect_list(F.struct("_pos", "segment_id", "text_raw", "text_clean", "start_ms", "end_ms")))
    grouped = joined.filter("start_ms IS NOT NULL").groupBy("part_id", "paragraph_no").agg(
        listed.alias("_s"), F.max("clean_override").alias("_o"))
    raw, clean = (F.array_join(F.col(f"_s.{field}"), "") for field in ("text_raw", "text_clean"))
    out = grouped.select("part_id", "paragraph_no", F.col("_s")[0]["start_ms"].alias("start_ms"),
                         F.element_at("_s", -1)["end_ms"].alias("end_ms"), raw.alias("text_raw"),
                         F.coalesce(F.nullif("_o", F.lit("")), tx.normalize_readable(clean)).alias("text_clean"),
                         F.transform("_s", lambda s: s["segment_id"]).alias("source_segment_ids"))
    return out, unknown


def attach_to_plan(plan: DataFrame, evidence: DataFrame, corrections: DataFrame, frames: DataFrame) -> DataFrame:
    """Evidence, corrections and frames of planned paragraphs as child rows (part_id, paragraph_no, kind, ref_id).

    Evidence belongs to a paragraph when both cite a segment; its frames come along. Corrections name their paragraph.
    ``plan``: part_id, paragraph_no, segment_ids. ``evidence``: evidence_id, segment_id. ``corrections``: part_id, paragraph_no,
    correction_id. ``frames``: evidence_id, frame_id. All but the plan are child rows.
    """
    owner = ["part_id", "paragraph_no"]
    refs = plan.select(*owner, F.explode("segment_ids").alias("segment_id")).distinct()
    linked = refs.join(evidence.select("segment_id", "evidence_id").distinct(), "segment_id").select(*owner, "evidence_id").distinct()
    shown = linked.join(frames.select("evidence_id", "frame_id"), "evidence_id").select(*owner, "frame_id").distinct()

    def child(rows: DataFrame, kind: str, ident: str) -> DataFrame:
        return rows.select(*owner, F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("ref_id"))

    fixed = tl.join_parts(corrections, plan.select(*owner).distinct(), owner, "left_semi")
    return child(linked, "evidence", "evidence_id").unionByName(child(fixed, "correction", "correction_id")).unionByName(child(shown, "frame", "frame_id"))


def correct_plan(paragraphs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Planned paragraphs with ``text_corrected``: accepted corrections replace the first place of their text, in order of their number.

    ``corrections``: part_id, paragraph_no, ord, correction_id, original_text, suggested_text, applied. ``not_applied`` names accepted ones
    whose text is absent, which the plan must not have.
    """
    from reelscribe.operators.corrections import apply_corrections

    named = paragraphs.withColumn("_paragraph", F.struct("part_id", "paragraph_no"))
    fixes = corrections.withColumn("_paragraph", F.struct("part_id", "paragraph_no"))
    return apply_corrections(named, fixes, "_paragraph", "text_clean", first_only=True).drop("_paragraph")


def plan_packets(ranges: DataFrame, part: str, span: int = 300_000, context: int = 30_000, dynamic: bool = False,
                 first: int = 1) -> DataFrame:
    """W18/W19 packet table over ``range_start``/``range_end``.

    Fixed packets are ``span`` long from the range start. Dynamic ones are the half-even rounded number of
    equal spans, the last ending at the range end, and never reach back before the range start.
    """
    length = F.col("range_end") - F.col("range_start")
    if dynamic:
        count = F.greatest(F.lit(1), F.bround(length / span).cast("long"))
        width = length / count
    else:
        count, width = F.greatest(F.lit(1), F.ceil(length / span)).cast("long"), F.lit(float(span))
    rows = ranges.withColumn("_count", count).withColumn("_width", width).withColumn(
        "packet_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)))
    left = F.col("range_start") + F.floor(F.col("packet_no") * F.col("_width")).cast("long")
    right = F.when(F.col("packet_no") == F.col("_count") - 1, F.col("range_end")).otherwise(
        F.col("range_start") + F.floor((F.col("packet_no") + 1) * F.col("_width")).cast("long"))
    out = rows.withColumn("primary_start", left).withColumn("primary_end", right)
    return out.select(
        part, (F.col("packet_no") + first).alias("packet_no"), vx.numbered("P", F.col("packet_no") + first, 4).alias("packet_id"),
        "primary_start", "primary_end", F.greatest("range_start", F.col("primary_start") - context).alias("context_start"),
        F.least("range_end", F.col("primary_end") + context).alias("context_end"))


def packet_rows(packets: DataFrame, rows: DataFrame, part: str, start: str, end: str, bin_size: int = 300_000) -> DataFrame:
    """Rows overlapping each packet's context (``end > cs`` and ``start < ce``), tagged ``context_only``."""
    strict = (F.col(end) > F.col("context_start")) & (F.col(start) < F.col("context_end"))
    pairs = overlap_join(rows, packets, [part], (F.col(start), F.col(end)), (F.col("context_start"), F.col("context_end")), strict, bin_size)
    primary = (F.col("primary_start") <= F.col(start)) & (F.col(start) < F.col("primary_end"))
    return pairs.withColumn("context_only", ~primary)


def terms_in_packet(packets: DataFrame, rows: DataFrame, part: str, start: str, end: str, bin_size: int = 300_000) -> DataFrame:
    """Rows overlapping the primary range."""
    strict = (F.col(end) > F.col("primary_start")) & (F.col(start) < F.col("primary_end"))
    return overlap_join(rows, packets, [part], (F.col(start), F.col(end)), (F.col("primary_start"), F.col("primary_end")), strict, bin_size)


def packet_summary(packets: DataFrame, members: DataFrame, part: str, ident: str) -> DataFrame:
    """Counts and an order-independent digest of the members per packet (no long lists)."""
    key = F.concat_ws(":", F.col(ident), F.col("context_only").cast("string"))
    sums = members.groupBy(part, "packet_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum((~F.col("context_only")).cast("long")).alias("primary_count"),
        *[F.sum(F.conv(F.substring(F.sha2(key, 256), 8 * i + 1, 8), 16, 10).cast("long")).alias(f"_w{i}") for i in range(8)])
    words = F.concat_ws(":", *[F.coalesce(f"_w{i}", F.lit(0)).cast("string") for i in range(8)])
    counts = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("row_count", "primary_count")}
    counts["member_digest"] = F.sha2(words, 256).alias("member_digest")
    return packets.join(sums, [part, "packet_id"], "left").select(*packets.columns, *counts.values())


def packet_terms(packets: DataFrame, rows: DataFrame, part: str, start: str, end: str, text_id: str, texts: DataFrame, bin_size: int = 300_000,
                 crowded: int = tl.ROWS_PER_BLOCK) -> DataFrame:
    """Term candidates of each packet as child rows: term, how many rows hold it, and whether one of them is primary.

    ``texts``: ``text_id`` and ``terms``, the distinct candidates of each text; rows name their text, and a packet's rows of one text count
    before they meet its terms. A text's terms travel to its packet as one string; only for packets of more than ``crowded`` texts they
    travel one by one, added up in every task before, so that no packet lands in one task.
    """
    from reelscribe.session import stage_table

    placed = packet_rows(packets, rows.select(part, start, end, text_id), part, start, end, bin_size)
    counted = stage_table(placed.groupBy(part, "packet_id", text_id).agg(F.count(F.lit(1)).alias("_n"), F.max(~F.col("context_only")).alias("_primary")))
    large = stage_table(counted.groupBy(part, "packet_id").agg(F.count(F.lit(1)).alias("_texts")).filter(F.col("_texts") > crowded).select(part, "packet_id"))
    # Terms that are empty or hold the separator themselves go beside the string.
    odd = lambda t: t.isNull() | (t == "") | F.contains(t, F.lit(_BETWEEN))
    usual = F.filter("terms", lambda t: ~odd(t))
    joined = F.when(F.size(usual) > 0, F.array_join(usual, _BETWEEN)).alias("_joined")
    packed = texts.filter(F.size("terms") > 0).select(text_id, joined, F.when(F.exists("terms", odd), F.filter("terms", odd)).alias("_odd"))
    none = F.array().cast("array<string>")
    term = F.explode(F.concat(F.coalesce(F.split("_joined", _BETWEEN, -1), none), F.coalesce("_odd", none))).alias("term")

    def total(found: DataFrame) -> DataFrame:
        return found.groupBy(part, "packet_id", "term").agg(F.sum("_n").alias("row_count"), F.max("_primary").alias("in_primary"))

    def held(few: DataFrame) -> DataFrame:
        return few.join(packed, text_id).select(part, "packet_id", "_n", "_primary", "_joined", "_odd")

    fields = [part, "packet_id", "_n", "_primary", term]
    # Some 32,768 texts with all their terms for a task, so that its sums fit in memory; by the size of the strings they would be far more.
    tasks = 1 + counted.count() // 32_768
    if large.isEmpty():
        return total(held(counted).repartition(tasks, part, "packet_id").select(*fields))
    few, many = (tl.join_parts(counted, large, [part, "packet_id"], how) for how in ("left_anti", "left_semi"))
    return total(held(few).repartition(tasks, part, "packet_id").select(*fields)).unionByName(total(held(many).select(*fields)))


def packet_contents(packets: DataFrame, members: dict[str, DataFrame], part: str, ident: str) -> DataFrame:
    """Packets with the counts and digest of every kind of member (child rows of ``packet_rows``) and one hash over all.

    The hash covers the packet's own fields and the members' digests, so a member that changes, goes or comes changes it;
    ``rules_packets`` computes it anew from ``payload`` columns of the same names.
    """
    out = packets
    for kind, rows in members.items():
        own = packet_summary(packets.select(part, "packet_id"), rows, part, ident)
        out = out.join(own.select(part, "packet_id", *[F.col(c).alias(f"{kind}_{c}") for c in ("row_count", "primary_count", "member_digest")]), [part, "packet_id"], "left")
    return out.withColumn("packet_hash", vx.row_fingerprint(out.columns))


def check_contiguity(members: DataFrame, group: Sequence[str], position: str, start: str, end: str) -> DataFrame:
    """Per group, whether positions form one unbroken run; first and last row's times; id of the run."""
    return members.groupBy(*group).agg(
        F.min(position).alias("first_pos"), F.max(position).alias("last_pos"), F.count(F.lit(1)).alias("size"),
        F.min_by(start, position).alias("start"), F.max_by(end, position).alias("end")
    ).withColumn("contiguous", F.col("last_pos") - F.col("first_pos") + 1 == F.col("size"))


def check_declared_values(declared: DataFrame, members: DataFrame, group: Sequence[str], position: str) -> DataFrame:
    """Paragraphs whose declared times or raw text are not those of their members.

    ``declared``: the group columns, start_ms, end_ms, text_raw. ``members``: the group columns, the position, start_ms, end_ms and
    text_raw, in order of the position; a paragraph's members are bounded by its time length.
    """
    listed = F.array_sort(F.collect_list(F.struct(position, "start_ms", "end_ms", "text_raw")))
    real = members.groupBy(*group).agg(listed.alias("_m")).select(
        *group, F.col("_m")[0]["start_ms"].alias("_start"), F.element_at("_m", -1)["end_ms"].alias("_end"), F.array_join("_m.text_raw", "").alias("_text"))
    time = ~(F.col("start_ms").eqNullSafe(F.col("_start")) & F.col("end_ms").eqNullSafe(F.col("_end")))
    found = F.array_compact(F.array(F.when(time, "time_differs"), F.when(~F.col("text_raw").eqNullSafe(F.col("_text")), "text_differs")))
    return declared.join(real, list(group), "left").select(*group, F.explode(found).alias("problem"))


def check_group_order(groups: DataFrame, part: str, number: str) -> DataFrame:
    """Groups whose first position does not follow the last position of the group before."""
    line = tl.by_position([part], number)
    near = tl.scan(groups, line, previous={"_last": "last_pos"})
    return near.withColumn("in_order", F.coalesce(F.col("first_pos") > F.col("_last"), F.lit(True))).drop("_last")
