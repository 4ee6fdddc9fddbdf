import json
import random

import pyarrow as pa

from pyspark.sql import functions as F

from reelscribe import schemas
from reelscribe.functions import text as tx
from reelscribe.functions import urls
from reelscribe.functions import values as vx
from reelscribe.operators import corrections as co
from reelscribe.operators import intervals as iv
from reelscribe.operators import paragraphs as pg
from reelscribe.operators import reports as rp
from reelscribe.operators import sequence as sq
from reelscribe.operators import timeline as tl
from reelscribe.operators import moments as mo
from reelscribe.sources import catalog as cat
from reelscribe.sources import subtitles as sub
from reelscribe.sources import writers as wr


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


def test_clean_text(spark):
    assert one(spark, "  Hello ,　 world﹗ 好 。 吗﻿ ", tx.clean_text) == "Hello, world！好。吗"
    assert one(spark, "é  \x1c b", tx.clean_text) == "é b"


def test_readable_and_garbled(spark):
    assert one(spark, " a,, b;；c ", tx.normalize_readable) == "a，b；c"
    for bad in ("x�", "锟斤拷", "ï»¿a", "a\x07", "Ã©Ã¨"):
        assert one(spark, bad, tx.is_garbled)
    for good in ("plain\n\ttext", "Ã alone", ""):
        assert not one(spark, good, tx.is_garbled)


def test_redaction(spark):
    assert one(spark, "authorization: Bearer abc\nok", tx.redact_text) == "authorization: <redacted>\nok"
    assert one(spark, 'x "token": "abc", uid=7', tx.redact_text) == 'x "token": "<redacted>", uid=<redacted>'
    assert one(spark, "see https://u:p@Example.com:8443/v?a=1&access_token=s#f .", tx.redact_text) == "see https://example.com:8443/v?a=1&access_token=<redacted> ."
    assert one(spark, "https://a.b/c?p=2&vd_source=z", lambda c: urls.sanitize_url(c, ["p"])) == "https://a.b/c?p=2"
    assert one(spark, "not a url token=1", urls.sanitize_url) == "not a url token=<redacted>"


def test_redact_nested(spark):
    df = spark.createDataFrame([({"a": "uid=1", "api-key": "z"}, [("t", "token: q")])], "m map<string,string>, l array<struct<sid:string,note:string>>")
    r = vx.redact_nested(df).first()
    assert r.m == {"a": "uid=<redacted>", "api-key": "<redacted>"} and r.l[0].sid == "<redacted>" and r.l[0].note == "token: <redacted>"


def test_video_source(spark):
    def get(value):
        return one(spark, value, urls.video_source)

    bv = "BV1ab411c7dX"
    assert get(bv).normalized == f"https://www.bilibili.com/video/{bv}" and get(bv).page is None
    assert get(f"https://m.bilibili.com/video/{bv}/?p=3&x=1").normalized == f"https://www.bilibili.com/video/{bv}?p=3"
    assert get("https://b23.tv/Xy9?p=2").short_url and get("av12").aid == 12
    assert get("https://bilibili.com.evil.example/video/" + bv).reject_reason == "unsupported_host"
    assert get(f"https://www.bilibili.com/video/{bv}?p=0").reject_reason == "invalid_page"
    assert get("https://www.bilibili.com/read/1").reject_reason == "missing_video_id"


def test_timecodes(spark):
    parse = lambda s: one(spark, s, vx.timecode_to_ms)
    assert parse("00:01:02,003") == 62_003 and parse("01:02.500") == 62_500 and parse("100:00:00.000") == 360_000_000
    assert parse("00:60:00.000") is None and parse("01:02,500") is None and parse("1:02.5") is None


def test_replace_term_keeps_words_and_template_signs(spark):
    df = spark.createDataFrame([("cat concat cat2 cat", "cat", "$1\\"), ("a.b a.b", ".b", "-")], "t string, o string, s string")
    rows = df.select(tx.replace_term(F.col("t"), F.col("o"), F.col("s")).alias("r"), tx.count_term(F.col("t"), F.col("o")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("$1\\ concat $1\\2 $1\\", 3), ("a- a-", 2)]


SRT = "1\r\n00:00:00,250 --> 00:00:02,750\r\n  Raw  text\r\n\r\n2\r\n00:00:03,500 --> 00:00:06,000\r\nline one\r\nline two\r\n"
VTT = "WEBVTT\n\nNOTE hidden\n\nSTYLE\n::cue {}\n\ncue-1\n00:01.000 --> 00:02.000 align:start\nHi\n"


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(b"\xef\xbb\xbf" + SRT.encode())
    (tmp_path / "b.VTT").write_text(VTT)
    (tmp_path / "c.txt").write_text("untimed\nlines")
    (tmp_path / "d.json").write_text(json.dumps({"font": 1, "body": [{"from": 0.5, "to": 1.25, "content": "x"}, {"from": 1, "to": 2, "content": 5}, {"from": 3, "to": 2, "content": "y"}, 7]}))
    (tmp_path / "e.doc").write_text("no")
    (tmp_path / "f.srt").write_text("no timing here")
    rows = {(r.part_id, r.seq): r for r in sub.read_subtitles(spark, str(tmp_path)).collect()}
    assert (rows["a", 0].start_ms, rows["a", 0].end_ms, rows["a", 0].text_raw) == (250, 2750, "  Raw  text")
    assert rows["a", 1].text_raw == "line one\nline two"
    assert [(r.start_ms, r.text_raw) for (p, _), r in rows.items() if p == "b"] == [(1000, "Hi")]
    assert rows["c", 0].text_raw == "untimed\nlines" and rows["c", 0].start_ms is None and rows["c", 0].timed is False
    assert [rows["d", i].reject_reason for i in range(4)] == [None, "content_not_string", "inverted_times", "item_not_object"]
    assert rows["e", 0].reject_reason == "unsupported_format" and rows["f", 0].reject_reason == "missing_timing"


def test_render_round_trip(spark, tmp_path):
    rows = [("p", i, f"T{i + 1:06d}", i * 1000, i * 1000 + 900, f"text {i}") for i in range(10)]
    s = spark.createDataFrame(rows, "part_id string, seq bigint, segment_id string, start_ms bigint, end_ms bigint, text_clean string")
    chunks = wr.render_srt(s, rows=4)
    assert chunks.count() == 3
    wr.write_chunks(chunks, str(tmp_path / "out"))
    whole = "\n\n".join(r.body for r in chunks.orderBy("chunk").collect())
    back = sub.parse_srt(spark.createDataFrame([("p", whole)], "part_id string, content string")).orderBy("seq").collect()
    assert [(r.start_ms, r.end_ms, r.text_raw) for r in back] == [(r[3], r[4], r[5]) for r in rows]
    written = spark.read.text(str(tmp_path / "out"), wholetext=True).collect()
    assert sum(r.value.count("-->") for r in written) == 10
    wr.write_chunks(chunks, str(tmp_path / "table"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3
    wr.write_segments_jsonl(s, str(tmp_path / "lines"), ["part_id", "segment_id"], buckets=2)
    assert spark.read.text(str(tmp_path / "lines")).count() == 10


def test_content_manifest_sees_every_change(spark):
    a = spark.range(100).selectExpr("id % 3 as g", "id as x")
    digests = lambda d: {r.g: (r.row_count, r.digest) for r in wr.build_content_manifest(d, ["g"], ["x"]).collect()}
    same, changed = digests(a.repartition(7)), digests(a.withColumn("x", F.when(F.col("x") == 50, 51).otherwise(F.col("x"))))
    assert digests(a) == same and [g for g in same if same[g] != changed[g]] == [2]


def test_records_jsonl(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a":1,"schema_version":"1.2.0"}\n{"a":2,"schema_version":"2.0"}\n{"a":3,"b":1,"schema_version":"1.0"}\nnope\n')
    rows = sub.read_records_jsonl(spark, str(tmp_path), schemas.struct("a bigint"), "1").collect()
    assert sorted((r.a or 0, r.reject_reason or "") for r in rows) == [(0, "not_an_object"), (1, ""), (2, "unsupported_version"), (3, "unknown_field")]


def test_catalog(spark):
    view = {"code": 0, "data": {"bvid": "BV0123456789", "aid": 5, "pages": [{"cid": 2, "page": 2, "part": "", "duration": 3.5}, {"cid": 1, "page": 1, "part": "Intro"}]}}
    files = spark.createDataFrame([(json.dumps(view),), (json.dumps({"code": -400}),)], "content string")
    rows = cat.explode_parts(files).collect()
    assert sorted((r.part_id or "", r.title or "", r.reject_reason or "") for r in rows) == [("", "", "api_error"), ("BV0123456789-p1", "Intro", ""), ("BV0123456789-p2", "P2", "")]
    assert [r.page for r in cat.explode_parts(files, first_only=True).filter("page is not null").collect()] == [1]
    assert "part_not_found" in [r.reject_reason for r in cat.explode_parts(files, page=9).collect()]
    tracks = [{"id": 1, "lan": "zh-CN", "lan_doc": "中文（自动生成）", "subtitle_url": "//a.hdslb.com/x", "ai_type": 0}, {"id": 2, "lan": "en", "lan_doc": "English", "subtitle_url": "//a.hdslb.com/y", "ai_type": 0},
              {"id": 3, "lan": "en", "lan_doc": "English", "subtitle_url": ""}, {"id": 4, "lan": "en", "lan_doc": "x", "subtitle_url": "http://evil.example/z"}]
    players = spark.createDataFrame([("p1", json.dumps({"code": 0, "data": {"subtitle": {"subtitles": tracks}}}))], "part_id string, content string")
    got = {r.subtitle_url: (r.source, r.reject_reason) for r in cat.explode_candidates(players).collect()}
    assert got == {"https://a.hdslb.com/x": ("bilibili_ai", None), "https://a.hdslb.com/y": ("uploader", None), "http://evil.example/z": ("uploader", "untrusted_host")}
    parts = spark.createDataFrame([("p1",), ("p2",)], "part_id string")
    best = {r.part_id: r.reason for r in cat.select_best_candidate(parts, cat.explode_candidates(players).filter("reject_reason is null"), ["zh-CN"]).collect()}
    assert best == {"p1": "uploader_subtitle_preferred", "p2": "no_subtitles_available"}


def test_quality_report_golden_numbers(spark):
    s = spark.createDataFrame([("p", 0, "T000001", 0, 3000, "same", "same"), ("p", 1, "T000002", 2500, 5000, "same", "same")],
                              "part_id string, seq bigint, segment_id string, start_ms bigint, end_ms bigint, text_raw string, text_clean string")
    media = spark.createDataFrame([("p", 10_000)], "part_id string, duration bigint")
    line, time_line = tl.by_position(["part_id"], "seq"), tl.by_time(["part_id"], "start_ms", "seq", 1000)
    r = rp.transcript_quality_report(s, line, time_line, media).first()
    assert (r.covered, r.coverage_ratio, r.overlap_count, r.duplicate_count) == (5000, 0.5, 1, 1)
    assert r.warnings == ["overlapping_segments", "duplicate_segments"]
    o = sq.report_overlaps(s, line, "segment_id", "start_ms", "end_ms").first()
    assert (o.first_id, o.second_id, o.overlap) == ("T000001", "T000002", 500)


def test_stratified_keeps_twenty_per_bucket(spark):
    rows = [("j", i, i * 10_000, float(i)) for i in range(150)]
    frames = spark.createDataFrame(rows, "job_id string, frame_no bigint, t bigint, sharpness double")
    ranges = spark.createDataFrame([("j", 0, 1_500_000)], "job_id string, range_start bigint, range_end bigint")
    out = mo.stratified_top_n(frames, ranges, "job_id", "t", [F.desc("sharpness")], 100, 300_000)
    assert [r["count"] for r in out.groupBy("bucket").count().orderBy("bucket").collect()] == [20] * 5
    assert mo.stratified_top_n(frames, ranges, "job_id", "t", [F.desc("sharpness")], 150, 300_000).count() == 150


def test_match_terms(spark):
    texts = spark.createDataFrame([(1, "the cat sat"), (2, "concatenate"), (3, ""), (4, "ab"), (5, "😀z"), (6, None)], "id int, text string")
    terms = spark.createDataFrame([("cat",), ("at s",), ("ab",), ("z",), ("",), ("😀z",)], "term string")
    pairs = sorted((r.id, r.term) for r in co.match_terms(texts, ["id"], "text", terms, "term").collect())
    assert pairs == [(1, "at s"), (1, "cat"), (2, "cat"), (4, "ab"), (5, "z"), (5, "😀z")]


def test_packets_and_interval_plans(spark):
    ranges = spark.createDataFrame([("j", 1_500_000, 2_250_000)], "job_id string, range_start bigint, range_end bigint")
    p = pg.plan_packets(ranges, "job_id", dynamic=True, first=6).orderBy("packet_no").collect()  # 2.5 rounds to 2
    assert [(r.packet_id, r.primary_start, r.primary_end, r.context_start, r.context_end) for r in p] == [
        ("P0006", 1_500_000, 1_875_000, 1_500_000, 1_905_000), ("P0007", 1_875_000, 2_250_000, 1_845_000, 2_250_000)]
    points = spark.range(50).selectExpr("'j' as k", "id as pid", "id * 10 as t")
    spans = spark.range(50).selectExpr("'j' as k", "id as sid", "id * 9 as a", "id * 9 + 25 as b")
    near = iv.near_point(points, spans, ["k"], "t", "a", "b", 7)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    want = {(p, s) for p in range(50) for s in range(50) if s * 9 + 25 >= p * 10 - 7 and s * 9 <= p * 10 + 7}
    assert {(r.pid, r.sid) for r in near.collect()} == want and near.count() == len(want)


def test_case_folding_of_all_letters(spark):
    letters = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and (chr(i).lower() != chr(i) or chr(i).upper() != chr(i))]
    got = spark.createDataFrame([(c,) for c in letters + ["ΣΑΣ Straße ıİ"]], "c string").select("c", tx.casefold(F.col("c")).alias("f")).collect()
    assert [r.c for r in got if r.f != r.c.casefold()] == []


def test_open_media_part_takes_far_points(spark):
    media = spark.createDataFrame([("p", 1, 0, 1000), ("p", 2, 1000, None)], "part_id string, media_no int, timeline_start bigint, timeline_end bigint")
    points = spark.createDataFrame([("p", 100), ("p", 999), ("p", 1000), ("p", 5_000_000_000_000)], "part_id string, t bigint")
    got = sorted((r.t, r.media_no, r.local_time) for r in iv.map_to_media(points, media, ["part_id"], "t", 300).collect())
    assert got == [(100, 1, 100), (999, 1, 999), (1000, 2, 0), (5_000_000_000_000, 2, 4_999_999_999_000)]


def test_search_moves_no_text(spark, monkeypatch):
    from reelscribe.operators import search as se

    monkeypatch.setattr(se, "CHUNK_BYTES", 64)
    words = ["naïve", "na", "ïv", "été 😀", "straße", "x", "a much longer term than any other", "theatre the", "absent words"]
    values = [None, "", "na", "x" * 700 + "the theatre the theatre", "naïve été 😀 straße", "a much longer term than any other" * 9, "été", "the", "😀"]
    rng = random.Random(4)
    values += ["".join(rng.choice(["x", "na", "ïve ", "été ", "😀", "straße", "theatre ", "the"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    terms = spark.createDataFrame([(w, i) for i, w in enumerate(words + ["", "na", None])], "term string, no int")
    texts = spark.createDataFrame(list(enumerate(values)), "id int, text string")
    # Each chunk of 64 bytes is looked at with what a term may reach beyond it; run here as the tasks do.
    sizes, sieve = se._sieve(terms, "term")
    rows, pieces = se._pieces(pa.array(values, pa.string()), None, sizes, sieve)
    want = {(i, w) for i, x in enumerate(values) for w in words if x and w in x}
    found = list(zip(rows.tolist(), pieces.to_pylist()))
    assert len(found) == len(set(found)) and want <= set(found) and all(p in values[i] for i, p in found)
    hits = co.match_terms(texts, ["id"], "text", terms, "term")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.term, r.no) for r in hits.collect()) == sorted((i, w, n) for i, x in enumerate(values) for n, w in enumerate(words + ["", "na"]) if x and w and w in x)
    # Texts are neither listed run by run nor joined with candidates.
    assert plan.count("Join") == 1 and "Generate" not in plan
    lists = spark.createDataFrame([(1, ["the", None, "na", "theatre the"]), (2, None), (3, []), (4, ["x", "na x"])], "id int, text array<string>")
    got = sorted((r.id, r.term) for r in co.match_terms(lists, ["id"], "text", terms.distinct(), "term").collect())
    assert got == sorted([(1, "na"), (1, "na"), (1, "theatre the"), (4, "x"), (4, "na"), (4, "na")])
    first = co.first_mention(terms.select("term").distinct(), texts.withColumn("at", F.col("id") * 10), ["id"], "text", "at", -1)
    assert {r.term: r.first_start for r in first.collect() if r.term} == {w: min([10 * i for i, x in enumerate(values) if x and w in x.lower()], default=-1) for w in words}


def test_glossary_links_meet_in_cells(spark):
    """64 segments of a term are one row before the shuffle; members are numbered over cells and blocks, ids below zero and both spellings included."""
    from reelscribe.operators import reports as rp

    ids = [*range(-70, 140), 2**40, 2**40 + 63]
    rows = [(10 * i + j, t, "x", [t], [r], [r // 5] if r % 3 else None, r) for i, r in enumerate(ids) for j, t in enumerate(("Die", "die"))]
    terms = spark.createDataFrame(rows, "ord bigint, term string, confidence string, aliases array<string>, transcript_ids array<bigint>, frame_ids array<bigint>, paragraph_start bigint")
    cells = rp.glossary_links(terms).filter("kind = 'segment'").count()
    assert cells == len({r // 64 for r in ids})
    for span in (64, 8192):
        got = {(m.key, m.kind, m.position): m.ref_id for m in rp.glossary_members(terms, span).collect()}
        frames = sorted({r // 5 for r in ids if r % 3})
        assert got == {**{("die", "segment", i + 1): str(r) for i, r in enumerate(ids)}, **{("die", "frame", i + 1): str(r) for i, r in enumerate(frames)}}
    empty = spark.createDataFrame([], "ord bigint, term string, definition string")
    none = spark.createDataFrame([], "original_text string, suggested_text string, applied boolean")
    out = rp.merge_glossary(terms, empty, none).collect()
    assert [(r.term, r.aliases, r.evidence_count, r.frame_count, r.first_start) for r in out] == [("Die", ["Die", "die"], len(ids), len(frames), -70)]


def test_text_measures_equal_their_plain_forms(spark):
    """What is skipped for plain texts changes no measure, whatever blanks, marks, accents and broken bytes a text holds."""
    draw = random.Random(5)
    signs = ["a", "Zb", "1", "٣", "_", "^", ".", ",", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1f", "\x7f", "\x85", "\xa0", " ", "　", "​", "﻿",
             "é", "é", "ï»¿", "Ã", "Â", "â€", "ä", "å", "æ", "�", "锟斤拷", "，", "。", "﹐", "!", ":", "\x00", "ß", "x_1", "3a^b"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 9))) for _ in range(3000)] + [None, "", " \n", "plain text, x_1"]
    raw = F.col("text")
    mapped = F.translate(tx.nfc(raw), tx.BLANKS + tx.COMPAT_FROM, " " * len(tx.BLANKS) + tx.COMPAT_TO)
    clean = F.regexp_replace(F.trim(F.regexp_replace(mapped, " {2,}", " ")), f" ([{tx.CJK_STOPS},.!?;:])", "$1")
    pairs = {
        "clean": (tx.clean_text(raw), F.regexp_replace(clean, f"([{tx.CJK_STOPS}]) ", "$1")), "garbled": (tx.is_garbled(raw), raw.rlike(tx.GARBLED)),
        "chars": (tx.visible_length(raw), F.length(F.regexp_replace(raw, tx.WHITESPACE + "+", "")).cast("long")), "blank": (tx.is_blank(raw), tx.strip(raw) == ""),
        "symbols": (tx.number_or_symbol_count(raw), F.size(F.array_distinct(F.regexp_extract_all(raw, F.lit(tx.NUMBER_OR_SYMBOL), F.lit(0)))))}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", *[(~a.eqNullSafe(b)).alias(n) for n, (a, b) in pairs.items()])
    wrong = rows.filter(" OR ".join(pairs)).collect()
    assert not wrong, wrong[:5]


def test_packet_terms_travel_together_or_one_by_one(spark):
    """A text's terms reach a packet as one string (terms with the separator, empty and null ones beside it), those of a crowded packet as rows."""
    listed = {0: ["A", "B"], 1: ["B", "x\x1fy", ""], 2: [], 3: [None, "C"], 4: ["\x1f"], 5: ["A"]}
    packets = spark.createDataFrame([(j, f"P{n}", 10 * n, 10 * n + 10, 10 * n - 2, 10 * n + 12) for j in (1, 2) for n in range(3)],
                                    "job_id int, packet_id string, primary_start bigint, primary_end bigint, context_start bigint, context_end bigint")
    spans = [(j, t, t + 1, (t * j) % 7) for j in (1, 2) for t in range(0, 30, 2 if j == 1 else 9)]
    rows = spark.createDataFrame(spans, "job_id int, start_ms bigint, end_ms bigint, doc int")
    texts = spark.createDataFrame(list(listed.items()), "doc int, terms array<string>")
    wanted = {}
    for job, packet, start, end, low, high in packets.collect():
        for _, a, b, doc in [s for s in spans if s[0] == job and s[2] > low and s[1] < high]:
            for term in listed.get(doc, []):
                n, primary = wanted.get((job, packet, term), (0, False))
                wanted[job, packet, term] = n + 1, primary or start <= a < end
    for crowded in (1, 3, 100):
        got = pg.packet_terms(packets, rows, "job_id", "start_ms", "end_ms", "doc", texts, 10, crowded).collect()
        assert len(got) == len(wanted) and {tuple(r)[:3]: tuple(r)[3:] for r in got} == wanted, crowded
    plan = pg.packet_terms(packets, rows, "job_id", "start_ms", "end_ms", "doc", texts, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not [x for x in plan.splitlines() if "hashpartitioning" in x and "term#" in x]


def test_letter_runs_lose_no_term(spark):
    """A text that holds a term has its key run, and the search of the literal finds what the counted pattern finds."""
    draw = random.Random(11)
    signs = ["a", "b", "ab", "é", "1", "-", " ", ".", "/", "A", "\\E", "_", "ß"]
    made = lambda n: "".join(draw.choice(signs) for _ in range(draw.randint(0, n)))
    pairs = spark.createDataFrame([(made(14), made(4)) for _ in range(6000)] + [("ab", None), (None, "ab")], "text string, term string").filter("term IS NULL OR term <> ''")
    text, term = F.col("text"), F.col("term")
    held = F.coalesce(F.contains(text, term) & tx.holds_term(text, term), F.lit(False))
    found = pairs.select("text", "term", F.coalesce(tx.count_term(text, term) > 0, F.lit(False)).alias("counted"), held.alias("held"),
                         F.coalesce(tx.key_run(term).isNull() | F.array_contains(tx.letter_runs(text), tx.key_run(term)), F.lit(False)).alias("may"))
    assert found.filter("counted").count() > 300 and found.filter("counted AND NOT may").count() == 0
    assert found.filter("NOT may").count() > 500
    assert found.filter("counted <> held").count() == 0


def shuffled_rows(df):
    """Rows written to the shuffles of a table that was collected; a shuffle read twice counts once."""
    found, todo = {}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found[node.id()] = node.metrics().apply("shuffleRecordsWritten").value()
        inner = "executedPlan" if name == "AdaptiveSparkPlanExec" else "plan" if name.endswith("QueryStageExec") else None
        todo += [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    return sum(found.values())


def test_glossary_members_move_as_lists(spark):
    """Segments far apart, so that none share 64 ids: what a task holds of a term is one row of every block that travels, not one for each citation."""
    from reelscribe.operators import reports as rp

    n, terms = 20_000, ["die", "Straße", "x"]
    rows = spark.range(0, n, 1, 4).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"), F.array(F.col("id") * 64).alias("transcript_ids"), F.array(F.col("id") * 320, F.col("id") * 64).alias("frame_ids"))
    out = rp.glossary_members(rows)
    got = {}
    for r in out.collect():
        got.setdefault((r.key, r.kind), []).append((r.position, r.ref_id))
    frames = sorted({i * 320 for i in range(n)} | {i * 64 for i in range(n)})
    want = {"segment": [i * 64 for i in range(n)], "frame": frames}
    assert {k: sorted(x) for k, x in got.items()} == {(t, kind): [(i + 1, str(r)) for i, r in enumerate(ids)] for t in ("die", "strasse", "x") for kind, ids in want.items()}
    assert 0 < shuffled_rows(out) < sum(map(len, got.values())) / 100


def test_sorted_lists_of_odd_ids(spark):
    """Runs, blocks and slices of a few ids: ids of any size, repeated in other tasks, absent keys and lists."""
    from reelscribe.operators import postings as po

    rng = random.Random(5)
    ends = [-(1 << 63), -(1 << 63) + 1, (1 << 63) - 1, 0, -1, None]

    def drawn():
        return rng.choice([None, [], [rng.choice([*ends, rng.randrange(-40, 90), 300 + rng.randrange(3), 1 << 40]) for _ in range(rng.randrange(1, 9))]])

    rows = [(rng.choice([None, "", "a", "ab", "é", "😀"]), drawn(), drawn()) for _ in range(400)]
    rows += [("a", list(range(-500, 500)), None), ("z", None, [3]), ("never", None, [None])]
    table = spark.createDataFrame(rows, "term string, one array<bigint>, two array<bigint>").repartition(5)
    want = {}
    for term, *lists in rows:
        for kind, ids in enumerate(lists):
            for i in ids or []:
                if i is not None:
                    want.setdefault((term, kind), set()).add(i)
    for span, run_ids, limit in ((7, 50, 16), (1 << 20, 1, 1 << 20), (1 << 20, 1 << 22, 1)):
        got = {}
        for r in po.sorted_lists(table, "term", ["one", "two"], span, run_ids, limit).collect():
            got.setdefault((r.key, r.kind), []).append((r.before, r.ids))
        for key, blocks in got.items():
            listed = [i for _, ids in sorted(blocks) for i in ids]
            assert listed == sorted(want[key])
            assert [b for b, _ in sorted(blocks)] == [sum(len(x) for _, x in sorted(blocks)[:i]) for i in range(len(blocks))]
        assert got.keys() == want.keys()
    assert po.sorted_lists(table.filter("term = 'never'"), "term", ["one", "two"]).count() == 0
