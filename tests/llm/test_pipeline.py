"""The pipeline against a plain version of each stage, on its own input; SQL twins on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check_queries import TABLES, compare
from tests.llm.test_operators import check_bins, expected_lines, fingerprint, sentence, table, words_of

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    menu, shared = "Home | News | Sport | Weather | About", "This line stands in many documents."
    item = sentence(9001, 25)
    base = sentence(9002, 300).split()
    rows = [(i, f"{sentence(9100 + i, 30)}\n{shared}\n{menu}") for i in range(20)]
    rows += [(100 + i, " ".join(base[:i] + ["other"] + base[i + 1 :])) for i in range(0, 40, 4)]
    rows += [(200, f"{sentence(9300, 20)} {item} {sentence(9301, 20)}"), (300, "a b c"), (301, None), (302, "###  ***  $$$ " * 30), (None, sentence(9400, 30))]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]

    kept, before = docs, rows
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if number == 4:
            break
        assert kept.columns == docs.columns
        after = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
        if number == 0:
            want = [(i, t.replace("\n" + menu, "")) for i, t in before if i not in (300, 301, 302)]
            assert sorted(after, key=str) == sorted(want, key=str)
        elif number == 1:
            assert sorted((str(i), t) for i, t in after) == expected_lines(before)
        elif number == 2:
            prints = {i: fingerprint(t) for i, t in before}
            assert len([i for i, _ in after if i is not None and 100 <= i < 200]) < 10
            links = {i: [j for j in prints if bin(prints[i] ^ prints[j]).count("1") <= 3] for i in prints}
            # Whoever has gone is linked to somebody; whoever stays has no smaller neighbour.
            gone = set(prints) - {i for i, _ in after}
            assert gone and all(len(links[i]) > 1 for i in gone)
            assert all(i is None or all(j is None or j >= i for j in links[i]) for i, _ in after)
        else:
            assert {i for i, _ in before} - {i for i, _ in after} == {200}
        before = after
    bins = check_bins(kept.collect(), 2048)
    assert bins and sum(r["n_words"] for r in kept.collect()) == sum(len(t.split()) for _, t in before)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept.count()
    assert words_of(item)


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(entry.LLM_QUERIES))
def test_query_equals_sql(spark, tables, name):
    result = compare(spark, tables, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert result.startswith(("ok", "rows only")), result
