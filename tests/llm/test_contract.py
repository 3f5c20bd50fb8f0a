"""The registered queries and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from millrace.llm.queries import QUERIES, SQL
from tests.llm import test_documents as force
from tests.llm.conftest import SF
from tests.oracle import canon, connect


def test_entry_registers_everything():
    import __spark_entry__ as entry
    assert {f"op{n}_" for n in range(1, 14)} == {q[:q.index("_") + 1] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SQL)
def test_queries_with_sql(spark, name):
    con = connect(SF)
    assert canon(QUERIES[name](spark, SF).toArrow()) == canon(con.sql(SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", QUERIES)
def test_queries_return_their_whole_table(spark, name):
    got = QUERIES[name](spark, SF)
    names = {"op1": "pages", "op3": "pages", "op8": "embeddings"}      # op9 and op13 return no row per input row
    if name.split("_")[0] not in ("op9", "op13"):
        assert got.count() == spark.read.parquet(f"{SF}/{names.get(name.split('_')[0], 'documents')}.parquet").count()


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [force.folded(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def check(name, before, want):
        after = stages[name](spark, before, SF)
        assert sorted(after.columns) == sorted(docs.columns)
        got = {r["doc_id"]: r["text"] for r in after.collect()}
        assert got == want, name
        return after

    assert all(any(c.isalpha() for c in t) for t in rows.values())
    after = check("language_id", docs, rows)
    groups = force.groups_by_force({d: force.fingerprint_by_force(t) for d, t in rows.items()})
    rows = {d: t for d, t in rows.items() if groups[d] == d}
    after = check("simhash_near_dedup", after, rows)
    first, left = {}, {}
    for d in sorted(rows):
        w = force.words_of(rows[d])
        gone = {x for i in range(len(w) - 49) if first.setdefault(tuple(w[i:i + 50]), d) < d for x in range(i, i + 50)}
        if len(gone) < len(w) or not w:
            left[d] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else rows[d]
    after = check("substring_dedup", after, left)
    assert after.filter("n_chars <> length(text)").count() == 0
    clean = {d: t for d, t in left.items() if not any(" " + " ".join(x) + " " in " " + " ".join(force.folded(t)) + " " for x in items if len(x) >= 5)}
    got = {r["doc_id"]: r["text"] for r in stages["decontamination"](spark, after, SF).collect()}
    assert got.items() <= clean.items()
    for d in clean.keys() - got.keys():       # near copies of an item: verified exactly
        w = force.folded(clean[d])
        assert any(force.distance_by_force(w, x) <= 0.2 * len(x) + 1e-9 for x in items if len(x) >= 5)
    result = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in result.collect()} == set(got) and result.filter("NOT round_trip").count() == 0


def test_pipeline_of_empty_and_awkward_tables(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            after.collect()
            if name != "sentencepiece":
                assert after.columns == docs.columns
                docs = after


def test_duckdb_has_the_sql_syntax():
    assert duckdb.sql("SELECT list_filter([1, 2], lambda x: x > 1)").fetchall() == [([2],)]
