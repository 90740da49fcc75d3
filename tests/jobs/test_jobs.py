import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import evidence, link_graph, queries

ROOT = Path(__file__).parents[2]


def rows(df):
    return sorted(map(str, map(tuple, df.select(sorted(df.columns)).collect())))


def page(links, title="A page"):
    return f"<html><title> {title} </title>" + "".join(f'<a class="x" href="{x}">l</a>' for x in links)


PAGES = [
    (1, "http://a.org/1", page(["/2", "/2#part", "http://b.org/", "#top", "mailto:x@y.z", "javascript:go()"])),
    (2, "http://a.org/2", page(["/1", "/2", "other"])),
    (3, None, page(["/lost"])),
    (4, "http://b.org/", None),
    (5, "http://a.org/1", page(["/3"], title="")),
    (None, "http://c.org/", page(["//d.org/x"])),
]


def write(spark, path, some, schema=link_graph.SCHEMA):
    spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(path))


def graph(spark, out):
    return [rows(spark.read.parquet(f"{out}/graph/{t}")) for t in ("vertices", "edges", "statistics")]


def take(spark, pages, out, **settings):
    return link_graph.run(spark, str(pages), f"{out}/graph", f"{out}/checkpoint", buckets=4, hub_degree=2, **settings)


def test_link_graph_takes_only_new_files(spark, tmp_path):
    write(spark, tmp_path / "pages", PAGES[:3])
    first = take(spark, tmp_path / "pages", tmp_path / "grown")
    assert first["read"] == {"batches": 1, "pages": 3, "without_url": 1, "without_html": 0, "links": 6}
    write(spark, tmp_path / "pages", PAGES[3:])
    second = take(spark, tmp_path / "pages", tmp_path / "grown")
    assert second["read"] == {"batches": 1, "pages": 3, "without_url": 0, "without_html": 1, "links": 2}
    grown = graph(spark, tmp_path / "grown")
    third = take(spark, tmp_path / "pages", tmp_path / "grown")
    assert third["read"]["batches"] == 0 and third["graph"] == second["graph"] and graph(spark, tmp_path / "grown") == grown
    whole = take(spark, tmp_path / "pages", tmp_path / "whole", files_per_batch=1)
    assert whole["read"]["pages"] == 6 and graph(spark, tmp_path / "whole") == grown
    found = {r.title: r for r in spark.read.parquet(f"{tmp_path}/grown/graph/vertices").collect()}
    assert (found["http://a.org/1"].page_id, found["http://a.org/1"].name, found["http://a.org/1"].degree) == (5, None, 3)
    assert (found["http://a.org/2"].name, found["http://a.org/2"].degree) == ("A page", 3)  # itself among them
    assert (found["http://b.org/"].page_id, found["http://b.org/"].degree) == (4, 1)
    assert (found["other"].page_id, found["//d.org/x"].degree) == (None, 1) and "http://a.org/lost" not in found
    assert whole["graph"] == {"n": 7, "least": 1, "most": 3, "mean": pytest.approx(11 / 7), "hubs": 2}


def test_link_graph_repeats_a_batch_that_failed(spark, tmp_path, monkeypatch):
    from dendra.operators import stores

    write(spark, tmp_path / "pages", PAGES)
    real = stores.replaced

    def stop(df, path, *partitions):
        if path.endswith("vertices"):
            raise RuntimeError("lost")
        real(df, path, *partitions)

    monkeypatch.setattr(stores, "replaced", stop)
    with pytest.raises(Exception, match="lost"):
        take(spark, tmp_path / "pages", tmp_path / "out")
    monkeypatch.setattr(stores, "replaced", real)
    assert take(spark, tmp_path / "pages", tmp_path / "out")["read"]["pages"] == 6
    take(spark, tmp_path / "pages", tmp_path / "whole")
    assert graph(spark, tmp_path / "out") == graph(spark, tmp_path / "whole")


def test_link_graph_of_an_empty_table(spark, tmp_path):
    write(spark, tmp_path / "pages", [])
    assert take(spark, tmp_path / "pages", tmp_path / "out")["graph"]["n"] == 0


DOCS = "doc_id long, text string, lang string"
SOME = [(1, "red apples grow on trees " * 10, "en"), (2, None, "en"), (3, "", None), (4, "blue whales swim in the sea", "en"), (None, "red red red", "en"), (5, "twice red", "en"), (5, "twice blue", "en")]
MORE = [(8, "green whales do not swim, red apples do " * 4, "en"), (9, "the sea the sea", None)]
ASKED = [(0, "Which apples are red?"), (1, "blue whales of the sea"), (2, "nothing known"), (3, None), (4, "")]


def ask(spark, base, out):
    return evidence.run(spark, str(base / "docs"), str(base / "items"), str(base / out), passage_words=10, top_k=3, budget=25, buckets=4, parts=2)


def left(spark, base, out):
    return rows(spark.read.parquet(f"{base}/{out}/evidence")), rows(spark.read.json(f"{base}/{out}/contexts"))


def test_evidence_takes_only_new_documents(spark, tmp_path):
    write(spark, tmp_path / "docs", SOME, DOCS)
    write(spark, tmp_path / "items", ASKED, "item_id long, text string")
    first = ask(spark, tmp_path, "grown")
    assert first["read"] == {"mark": None, "documents": 7, "without_id": 1, "without_text": 1, "repeated_ids": 1}
    write(spark, tmp_path / "docs", MORE, DOCS)
    second = ask(spark, tmp_path, "grown")
    assert second["read"]["mark"] == 4 and second["passages"] == 11
    grown = left(spark, tmp_path, "grown")
    third = ask(spark, tmp_path, "grown")
    assert third["read"]["mark"] == 9 and third["evidence"] == second["evidence"] and left(spark, tmp_path, "grown") == grown
    ask(spark, tmp_path, "whole")
    assert left(spark, tmp_path, "whole") == grown
    found = spark.read.parquet(f"{tmp_path}/grown/evidence")
    used = {r.item_id: sum(len(x.text.split()) for x in found.collect() if x.item_id == r.item_id) for r in found.collect()}
    assert set(used) == {0, 1} and max(used.values()) <= 25
    best = found.where("item_id = 1 and rank = 1").first()
    assert (best.doc_id, best.place, best.text) == (4, 0, "blue whales swim in the sea")
    contexts = {r.item_id: r.context for r in spark.read.json(f"{tmp_path}/grown/contexts").collect()}
    assert set(contexts) == {0, 1, 2, 3, 4} and contexts[2] == "" and contexts[1].startswith("blue whales swim in the sea\n\n")


def test_evidence_repeats_a_batch_that_failed(spark, tmp_path, monkeypatch):
    from dendra.operators import stores

    write(spark, tmp_path / "docs", SOME + MORE, DOCS)
    write(spark, tmp_path / "items", ASKED, "item_id long, text string")
    real = stores.replaced
    monkeypatch.setattr(stores, "replaced", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ask(spark, tmp_path, "out")
    monkeypatch.setattr(stores, "replaced", real)
    ask(spark, tmp_path, "out")
    ask(spark, tmp_path, "whole")
    assert left(spark, tmp_path, "out") == left(spark, tmp_path, "whole")


def test_command_line(spark, tmp_path):
    write(spark, tmp_path / "pages", PAGES)
    paths = [f"--{k}={tmp_path}/{k}" for k in ("pages", "out", "checkpoint")]
    done = subprocess.run([sys.executable, "-m", "jobs.link_graph", *paths, "--set", "buckets=2"], cwd=ROOT, env={**os.environ, "PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "'pages': 6" in done.stderr and len(list((tmp_path / "out/vertices").glob("bucket=*"))) == 2


def test_jobs_leave_the_rows_of_their_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, query in queries.QUERIES.items():
        got, want = query(spark, sf_dir), db.sql(queries.ORACLES[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        plain = [[round(v, 4) if isinstance(v, float) else v for v in r] for r in want.select(*map(lambda c: duckdb.ColumnExpression(c), columns)).fetchall()]
        made = [[round(v, 4) if isinstance(v, float) else v for v in r] for r in got.select(columns).collect()]
        assert sorted(map(json.dumps, made)) == sorted(map(json.dumps, plain))
