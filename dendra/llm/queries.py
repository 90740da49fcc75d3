"""Queries of the training-data operators over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .conflict_packing import pack_documents
from .decontaminate import find_leaks
from .licenses import scan_documents
from .media import fingerprint_documents
from .pseudo_likelihood import score_documents as score_likelihood
from .secrets import RULES as SECRET_RULES, secret_digests
from .sharding import shard_documents
from .simhash import near_duplicates
from .spelling import spelling_forms
from .substring_dedup import find_repeats
from .token_packing import pack_tokens
from .toxicity import score_documents


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op2_char_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"))


def op4_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_wav_peak_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))


def op8_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_likelihood(table(spark, sf_dir, "documents"))


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    shares = ("score", "overlap", "question_overlap", "answer_overlap")
    return found.withColumns({c: F.round(c, 6) for c in shares})


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_combined_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op12_trie_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sampled_splitters": op1_sampled_splitters,
    "op2_char_ngram_toxicity": op2_char_ngram_toxicity,
    "op3_token_bfd_packing": op3_token_bfd_packing,
    "op4_conflict_best_fit": op4_conflict_best_fit,
    "op5_wav_peak_pairs": op5_wav_peak_pairs,
    "op6_license_compression": op6_license_compression,
    "op7_paragraph_minhash": op7_paragraph_minhash,
    "op8_masked_pseudo_likelihood": op8_masked_pseudo_likelihood,
    "op9_bm25_decontamination": op9_bm25_decontamination,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_combined_automaton": op11_combined_automaton,
    "op12_trie_self_join": op12_trie_self_join,
}


def _spans_sql(kind: str, pattern: str, least: int, value: bool, place: int) -> str:
    """(doc_id, kind, place, s, e) of a rule's matches in d(doc_id, t): starts are the lengths of all pieces and matches before."""
    pattern = pattern.replace("'", "''")
    said = "regexp_extract(m, '[:=] *[\"'']?(.*)$', 1)" if value else "m"
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, s, e FROM (
      SELECT doc_id, m, before - length(m) + sum(length(p)) OVER w AS s, before + sum(length(p)) OVER w AS e FROM (
        SELECT doc_id, k, p, m, sum(length(m)) OVER w AS before FROM (
          SELECT doc_id, generate_subscripts(found, 1) AS k, unnest(found) AS m, unnest(parts[:length(found)]) AS p FROM (
            SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, regexp_split_to_array(t, '{pattern}') AS parts FROM d))
        WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE length({said}) >= {least}"""


#: The CRC-32 of a text's bytes is folded over a table that is made from the polynomial.
ORACLES = {
    "op1_sampled_splitters": """
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0,1,2,3,4,5,6,7]::BIGINT[]),
                          lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) r(i))),
d AS (
  SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h,
         octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS key FROM documents),
g AS (SELECT *, sum(size) OVER (PARTITION BY key) AS held, sum(size) OVER () AS total FROM d),
u AS (SELECT *, CASE WHEN held * 800 > total THEN doc_id ELSE -9223372036854775808 END AS tie FROM g),
w AS (
  SELECT *, sum(size) OVER (ORDER BY key, tie RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY key, tie) AS unit FROM u),
s AS (SELECT *, ((2 * upto - unit) * 8 // (2 * total))::INTEGER AS shard FROM w)
SELECT doc_id, size,
       xor(list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(range(1, 2 * (size - 1), 2), lambda k: ('0x' || substr(h, k, 2))::BIGINT)),
             lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295)::BIGINT AS text_crc32,
       'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY key, tie, doc_id) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM s, crc_table
""",
    "op9_bm25_decontamination": """
WITH it AS (SELECT item_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
st AS (SELECT count(*)::DOUBLE AS n, sum(length(w)) / count(*) AS mean, max(length(w)) AS step FROM it),
tf AS (SELECT item_id, length(w) AS len, term, count(*) AS tf FROM (SELECT item_id, w, unnest(w) AS term FROM it) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
im AS (SELECT item_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS x FROM tf JOIN df USING (term), st),
share AS (SELECT item_id, term, x / sum(x) OVER (PARTITION BY item_id) AS x FROM im),
part AS (SELECT item_id, w, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]+')), lambda s: length(s) > 0) AS p FROM it),
qa AS (SELECT item_id, w, CASE WHEN length(p) > 1 THEN flatten(p[:-2]) ELSE w END AS q, CASE WHEN length(p) > 1 THEN p[-1] ELSE w END AS a FROM part WHERE length(w) > 0),
sh AS (SELECT item_id, list_transform([w, q, a], lambda ws: list_distinct(list_transform(range(1, greatest(length(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS s FROM qa),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, pos, w[pos + 1:(pos + 2 * step)::BIGINT] AS p FROM (SELECT doc_id, w, step, unnest(range(0, length(w)::BIGINT, step::BIGINT)) AS pos FROM d, st)),
hit AS (SELECT doc_id, pos, item_id, sum(x) AS score FROM (SELECT doc_id, pos, unnest(list_distinct(p)) AS term FROM win) JOIN share USING (term) GROUP BY ALL HAVING sum(x) >= 0.6 - 1e-9),
ov AS (SELECT doc_id, pos, item_id, score, list_transform(s, lambda g: length(list_filter(g, lambda x: contains(' ' || array_to_string(p, ' ') || ' ', ' ' || x || ' '))) / length(g)) AS o FROM hit JOIN win USING (doc_id, pos) JOIN sh USING (item_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY o[1] DESC, round(score, 9) DESC, pos) AS r FROM ov WHERE o[1] >= 0.8 OR (o[2] >= 0.8 AND o[3] >= 0.8))
SELECT doc_id, item_id, pos AS passage_start, round(score, 6) AS score, round(o[1], 6) AS overlap, round(o[2], 6) AS question_overlap, round(o[3], 6) AS answer_overlap FROM k WHERE r = 1
""",
    "op11_combined_automaton": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
sp AS ({" UNION ALL ".join(_spans_sql(r.kind, r.pattern, r.least, r.value, i) for i, r in enumerate(SECRET_RULES))}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM sp GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
""",
    "op12_trie_self_join": """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0,1,2,3,4,5,6,7]::BIGINT[]),
                          lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(range(1, 2 * octet_length(b), 2), lambda k: ('0x' || substr(hex(b), k, 2))::BIGINT)),
             lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295)::BIGINT AS h
  FROM (SELECT *, encode(doc_id || ':' || run) AS b FROM runs), crc_table),
voc AS (SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM voc)),
near AS (SELECT x.word, y.word AS other, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, v.word, v.n FROM cut x JOIN voc v ON v.word = x.a || x.b
  UNION SELECT v.word, x.word, x.n FROM cut x JOIN voc v ON v.word = x.a || x.b),
best AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM near) WHERE k = 1),
named AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * v.n THEN other END AS form, CASE WHEN b.n >= 2 * v.n THEN b.n END AS form_n FROM voc v LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM named UNION ALL SELECT c.word, c.next, m.form FROM chain c JOIN named m ON m.word = c.next)
SELECT m.word, m.form, c.root, m.n, m.n_near, m.form_n FROM named m JOIN chain c ON c.word = m.word AND c.next IS NULL
""",
}
