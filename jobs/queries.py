"""The jobs as queries over the test tables, each run twice into one new folder, with the SQL of what they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dendra.operators.shared import new_folder
from jobs import evidence, link_graph


def job1_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of the graph of all pages."""
    out = new_folder(spark, "job1")
    for _ in range(2):
        link_graph.run(spark, f"{sf_dir}/pages.parquet", f"{out}/graph", f"{out}/checkpoint", buckets=8)
    return spark.read.parquet(f"{out}/graph/vertices").drop("bucket")


def job2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of all benchmark items in all documents."""
    out = new_folder(spark, "job2")
    for _ in range(2):
        evidence.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, buckets=16)
    return spark.read.parquet(f"{out}/evidence").withColumn("score", F.round("score", 5))


QUERIES = {"job1_link_graph": job1_link_graph, "job2_evidence": job2_evidence}

_TOKENS = "regexp_extract_all(lower({}), '[^\\s.,;:!?|()\\[\\]\"]+')"

ORACLES = {
    "job1_link_graph": """
WITH t AS (SELECT url, page_id, html, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*') AS host,
  unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=["'']([^"'']+)["'']', 1)) AS raw FROM pages),
l AS (SELECT url, host, regexp_replace(trim(raw), '#.*$', '') AS x FROM t),
link AS (SELECT url AS src, CASE WHEN x LIKE '/%' AND x NOT LIKE '//%' THEN host || x ELSE x END AS dst FROM l
  WHERE x <> '' AND (regexp_matches(x, '(?i)^https?://') OR NOT regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:'))),
edge AS (SELECT src, dst FROM link UNION SELECT dst, src FROM link),
d AS (SELECT src AS title, count(*) AS degree FROM edge GROUP BY src),
v AS (SELECT url AS title, page_id AS seq, page_id, nullif(trim(regexp_extract(html, '(?is)<title>\\s*([^<]*)', 1)), '') AS name FROM pages
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)
SELECT coalesce(v.title, d.title) AS title, seq, page_id, name, coalesce(degree, 0) AS degree FROM v FULL JOIN d ON v.title = d.title
""",
    "job2_evidence": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
p AS (SELECT doc_id, place, array_to_string(w[place * 100 + 1:place * 100 + 100], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, (length(w) + 99) // 100)) AS place FROM w)),
t AS (SELECT doc_id, place, {_TOKENS.format("text")} AS w FROM p), st AS (SELECT count(*) AS n, avg(length(w)) AS mean FROM t),
q AS (SELECT item_id, unnest(list_distinct({_TOKENS.format("text")})) AS term FROM benchmark),
c AS (SELECT doc_id, place, len, term, count(*) AS tf FROM (SELECT doc_id, place, length(w) AS len, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
s AS (SELECT item_id, doc_id, place, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * len / mean))) AS score FROM c JOIN f USING (term) JOIN q USING (term), st GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id, place) AS rank FROM s) WHERE rank <= 5),
b AS (SELECT k.*, string_split(text, ' ') AS words, coalesce(sum(length(string_split(text, ' '))) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN p USING (doc_id, place))
SELECT item_id, rank::INTEGER AS rank, doc_id, place::INTEGER AS place, round(score, 5) AS score, array_to_string(words[1:(300 - before)::BIGINT], ' ') AS text, (item_id % 8)::INTEGER AS part FROM b WHERE before <= 300
""",
}
