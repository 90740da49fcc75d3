"""The registered queries against their SQL, and each pipeline stage on its own input against a brute-force reading of it."""

import duckdb
import pytest

import corpus_pipeline
from dendra.llm import queries
from dendra.llm.common import table
from dendra.llm.decontaminate import shingles, words_of
from dendra.llm.toxicity import score_documents
from tests.llm.test_simhash import components, plain_fingerprint
from tests.llm.test_substring_dedup import plain_blocks, plain_paragraphs, plain_windows
from tests.test_catalog import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), db.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_stages_in_turn(spark, sf_dir, tmp_path):
    docs, columns, stages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "documents").columns, dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r.text for r in docs.collect()}

    def through(name):
        nonlocal docs
        stages[name](spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "best_fit_packing" or docs.columns == columns
        return docs.collect()

    scores = {r.doc_id: r.score for r in score_documents(docs, table(spark, sf_dir, "labels")).collect()}
    kept = {r.doc_id: r.text for r in through("toxicity")}
    assert kept == {i: t for i, t in before.items() if scores[i] < 0.5} and len(kept) < len(before)

    ids = sorted(kept)
    group = components([plain_fingerprint(kept[i]) for i in ids])
    first = {}
    for i, g in zip(ids, group):
        first.setdefault(g, i)
    before, kept = kept, {r.doc_id: r.text for r in through("simhash_near_dedup")}
    assert kept == {i: before[i] for i in first.values()} and len(kept) < len(before)

    touched = set(plain_blocks(kept.items(), 0.8)) | {i for i, *_ in plain_paragraphs(kept.items(), 50, 0.8)}
    before, after = kept, through("substring_dedup")
    kept = {r.doc_id: r.text for r in after}
    assert all(kept[i] == t for i, t in before.items() if i not in touched)
    assert not {i for i, _ in plain_windows(before.items(), 50)} - {i for i, t in before.items() if kept.get(i) != t} and all(r.n_chars == len(r.text) for r in after if r.text != before[r.doc_id])

    items = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    parts = [shingles(words_of(t)) for t in items]
    leaks = set()
    for i, t in kept.items():
        own = shingles(words_of(t))
        leaks |= {i for p in parts if len(p & own) >= 0.8 * len(p)}
    before, kept = kept, {r.doc_id: r.text for r in through("benchmark_decontamination")}
    assert set(before) - set(kept) == leaks and leaks

    packed = through("best_fit_packing")
    lengths, bins = {}, {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        bins.setdefault((r.pack_group, r.bin), []).append(r)
    assert lengths == {i: len(t.split()) for i, t in kept.items()}
    for members in bins.values():
        assert sum(r.length for r in members) <= 2048 and len({r.source for r in members}) == len(members)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed))
