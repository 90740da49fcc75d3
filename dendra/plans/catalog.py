"""Queries of the analytics operators over the test tables, each with the SQL that gives the same rows.

The tables hold no wiki dump, so some queries first derive what an operator needs with plain expressions
(an outline from a text's lines, a document graph from vector ids); the SQL states the same derivation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dendra.functions import markup, parsers, prompts, text as T
from dendra.functions.vector import cosine, pooled, rounded
from dendra.operators import context, divergence, graph, links, metrics, models, pages, retrieval, tree
from dendra.operators.shared import cut, deleted, new_folder
from dendra.operators.stores import GraphStore, PostingsIndex
from dendra.operators.turns import converse_in_turns
from dendra.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, output, gold): each assistant turn and the user turn before it."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    users = rows.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    return rows.where("role <> 'user'").select("conv_id", "turn", F.col("text").alias("output")).join(users, ["conv_id", "turn"])


TURNS = """turns AS (SELECT a.conv_id, a.turn, a.text AS output, u.text AS gold FROM conversations a JOIN conversations u
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role <> 'user' AND u.role = 'user' AND a.text IS NOT NULL AND u.text IS NOT NULL)"""


def norm_sql(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"array_to_string(list_filter(regexp_split_to_array({bare}, '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


@query(f"SELECT conv_id, turn, {norm_sql('text')} AS normal FROM conversations WHERE text IS NOT NULL")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", T.normalize_answer(F.col("text")).alias("normal"))


@query("SELECT conv_id, turn, trim(text, chr(10) || '., ') AS trimmed, length(regexp_extract_all(text, '\\S+'))::INTEGER AS words FROM conversations WHERE text IS NOT NULL")
def output_trim(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", T.trim_output(F.col("text")).alias("trimmed"), T.word_count(F.col("text")).alias("words"))


@query("""SELECT conv_id, turn, replace(replace(regexp_replace(regexp_replace(t, ' \\[[0-9]+', '', 'g'), '\\[[0-9]+', '', 'g'), ' |', ''), ']', '') AS bare,
  list_transform(regexp_extract_all(t, '\\[([0-9]+)', 1), lambda x: x::INTEGER - 1) AS cited
  FROM (SELECT conv_id, turn, text || ' [' || (turn % 5 + 1) || '][' || (conv_id % 7) || '] |' AS t FROM conversations WHERE text IS NOT NULL)""")
def citation_parse(spark, sf_dir):
    marked = F.concat("text", F.lit(" ["), F.expr("cast(turn % 5 + 1 as string)"), F.lit("]["), F.expr("cast(conv_id % 7 as string)"), F.lit("] |"))
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", marked.alias("t"))
    return rows.select("conv_id", "turn", T.strip_citations(F.col("t")).alias("bare"), T.citation_ids(F.col("t")).alias("cited"))


@query(f"""SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\\s+$', ''), '\\.+$', ''), ',+$', ''), ','),
  lambda x: {norm_sql('x')}), lambda x: x <> '') AS answers FROM documents""")
def list_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.list_answers(F.col("text")).alias("answers"))


@query("""WITH d AS (SELECT doc_id, string_split(replace(replace(text, '(', ''), ')', ''), chr(10)) AS l FROM documents),
  o AS (SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE WHEN i % 2 = 1 THEN '* ' || x ELSE i || '. "' || x || '" (note)' END), chr(10)) AS out, l[1] AS q FROM d),
  c AS (SELECT doc_id, q, list_transform(regexp_extract_all(out, '(?m)^\\s*(?:[*+]|[0-9]+\\.)\\s+(.*)$', 1), lambda x: trim(x)) AS c FROM o)
  SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(c, lambda x: NOT contains(x, 'Q') AND NOT contains(q, x)),
    lambda x: trim(regexp_replace(trim(trim(trim(x, '"'), '''')), '\\([^)]*\\)', '', 'g'))), lambda x: x <> ''), ', ') AS answers FROM c""")
def bullet_parse(spark, sf_dir):
    lines = F.split(F.translate("text", "()", ""), "\n")
    line = lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("* "), x)).otherwise(F.concat((i + 1).cast("string"), F.lit('. "'), x, F.lit('" (note)')))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(lines, line), "\n").alias("o"), lines[0].alias("q"))
    return rows.select("doc_id", T.bullet_answers(F.col("o"), F.col("q")).alias("answers"))


@query("""SELECT doc_id, CASE WHEN instr(text, ':') > 0 THEN substr(text, instr(text, ':') + 1) ELSE '' END AS after,
  replace(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), '<|im_end|>', '') AS one_line,
  regexp_replace(array_to_string(regexp_extract_all(text, '\\S+')[1:100], ' '), '[!-/:-@\\[-`{-~]+$', '') AS head FROM documents""")
def output_clean(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.after_reasoning(t).alias("after"), T.clean_output(t).alias("one_line"), T.head_words(t).alias("head"))


# ---------------------------------------------------------------- metrics


@query(f"""WITH {TURNS}, n AS (SELECT *, {norm_sql("trim(output, chr(10) || '., ')")} AS said, {norm_sql('gold')} AS g1, {norm_sql("string_split(gold, '.')[1]")} AS g2 FROM turns)
  SELECT conv_id, turn, ((g1 <> '' AND said = g1) OR (g2 <> '' AND said = g2))::INTEGER AS exact,
  ((g1 <> '' AND contains(said, g1)) OR (g2 <> '' AND contains(said, g2)))::INTEGER AS contained FROM n""")
def answer_match(spark, sf_dir):
    golds = F.array("gold", F.split("gold", r"\.")[0])
    return _turns(spark, sf_dir).select("conv_id", "turn", metrics.exact_match(F.col("output"), golds).cast("int").alias("exact"), metrics.containment(F.col("output"), golds).cast("int").alias("contained"))


def overlap_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_distinct({a}), lambda x: least(length(list_filter({a}, lambda y: y = x)), length(list_filter({b}, lambda y: y = x)))))"


SCORES = f"""{TURNS}, n AS (SELECT *, {norm_sql("trim(output, chr(10) || '., ')")} AS said, {norm_sql('gold')} AS g FROM turns),
  k AS (SELECT *, {tokens_sql('said')} AS a, {tokens_sql('g')} AS b FROM n),
  s AS (SELECT *, coalesce({overlap_sql('a', 'b')}, 0) AS same FROM k),
  f AS (SELECT *, same = 0 OR (said <> g AND (said IN ('yes', 'no', 'noanswer') OR g IN ('yes', 'no', 'noanswer'))) AS none FROM s),
  scored AS (SELECT conv_id, turn, CASE WHEN none THEN 0 ELSE same / length(a) END AS p, CASE WHEN none THEN 0 ELSE same / length(b) END AS r, said = g AND g <> '' AS exact, contains(said, g) AND g <> '' AS contained FROM f)"""


@query(f"""WITH {SCORES} SELECT conv_id, turn, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1 FROM scored""")
def token_f1(spark, sf_dir):
    s = metrics.token_scores(F.col("output"), F.array("gold"))
    return _turns(spark, sf_dir).select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", *[F.round(f"s.{k}", 6).alias(k) for k in ("precision", "recall", "f1")])


@query(f"""WITH {SCORES} SELECT count(*) AS n, round(avg(exact::INTEGER), 6) AS exact, round(avg(contained::INTEGER), 6) AS contained, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
  round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM scored""")
def short_form_report(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("output", F.array("gold").alias("golden_answers"))
    report = metrics.short_form_report(rows)
    return report.select("n", *[F.round(c, 6).alias(c) for c in report.columns if c != "n"])


@query(f"""WITH {SCORES}, f1 AS (SELECT conv_id || ':' || turn AS k, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS x FROM scored),
  d AS (SELECT b, x, ('0x' || substr(md5(k || ':' || b), 1, 8))::BIGINT / 4294967296 AS u FROM f1, range(200) t(b)),
  w AS (SELECT b, x, length(list_filter([{", ".join(map(repr, metrics._POISSON))}], lambda c: u >= c)) AS w FROM d),
  m AS (SELECT list_sort(list(wx / w)) AS means FROM (SELECT sum(w) AS w, sum(w * x) AS wx FROM w GROUP BY b) WHERE w > 0)
  SELECT (SELECT count(*) FROM f1) AS n, round((SELECT avg(x) FROM f1), 6) AS mean, round(means[1 + floor(length(means) * 0.025)::INTEGER], 6) AS low, round(means[1 + floor(length(means) * 0.975)::INTEGER], 6) AS high FROM m""")
def resampled_f1(spark, sf_dir):
    """Mean token F1 with its bootstrap interval."""
    s = metrics.token_scores(F.col("output"), F.array("gold"))
    found = metrics.resampled(_turns(spark, sf_dir).select("conv_id", "turn", s["f1"].alias("f1")), "f1", ["conv_id", "turn"], replicates=200)
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {TURNS} SELECT conv_id, turn FROM turns WHERE {norm_sql('gold')} <> '' AND contains({norm_sql("trim(output, chr(10) || '., ')")}, {norm_sql('gold')})
  AND {norm_sql("trim(output, chr(10) || '., ')")} <> {norm_sql('gold')}""")
def special_cases(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("golden_answers", F.array("gold"))
    return metrics.special_cases(rows).select("conv_id", "turn")


@query(f"""WITH {TURNS}, r AS (SELECT conv_id, turn, gold, CASE turn % 3 WHEN 0 THEN gold WHEN 1 THEN 'It is: ' || gold ELSE output END AS said FROM turns),
  n AS (SELECT *, {norm_sql("trim(said, chr(10) || '., ')")} AS s, {norm_sql('gold')} AS g FROM r) SELECT conv_id, turn FROM n WHERE g <> '' AND contains(s, g) AND s <> g""")
def special_cases_found(spark, sf_dir):
    """Of outputs that repeat the gold answer, add to it or differ, those that hold it without being equal."""
    said = F.when(F.col("turn") % 3 == 0, F.col("gold")).when(F.col("turn") % 3 == 1, F.concat(F.lit("It is: "), "gold")).otherwise(F.col("output"))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", said.alias("output"), F.array("gold").alias("golden_answers"))
    return metrics.special_cases(rows).select("conv_id", "turn")


def word_set_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'))"


def sentences_sql(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def entails_sql(premise: str, claim: str) -> str:
    """Whether a text has at least half of another's words."""
    said, held = word_set_sql(claim), word_set_sql(premise)
    return f"CASE WHEN length({said}) > 0 AND length(list_intersect({said}, {held})) * 2 >= length({said}) THEN 1 ELSE 0 END"


@query(f"""WITH {TURNS}, c AS (SELECT conv_id, turn, output, unnest({sentences_sql('gold')}) AS claim FROM turns),
  e AS (SELECT conv_id, turn, avg({entails_sql('output', 'claim')}) AS r FROM c GROUP BY conv_id, turn)
  SELECT conv_id, turn, round(coalesce(r, 0), 6)::DOUBLE AS claim_recall FROM turns LEFT JOIN e USING (conv_id, turn)""")
def claim_recall(spark, sf_dir):
    """The share of the gold answer's sentences whose words the output has."""
    rows = _turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("id"), "output", T.sentences(F.col("gold")).alias("claims"))
    return metrics.claim_recall(rows, models.entailment(models.OverlapEntailment)).select("id.conv_id", "id.turn", F.round("claim_recall", 6).alias("claim_recall"))


@query(f"""WITH {TURNS}, d AS (SELECT conv_id, turn, {sentences_sql('output')} AS docs, {sentences_sql("gold || ' ' || output")} AS s FROM turns),
  x AS (SELECT conv_id, turn, docs, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM d),
  r AS (SELECT *, CASE i % 4 WHEN 0 THEN []::BIGINT[] WHEN 1 THEN [1] WHEN 2 THEN [1, 2] ELSE [2, 99] END AS refs FROM x),
  v AS (SELECT *, CASE WHEN length(list_filter(refs, lambda k: k > length(docs))) = 0 THEN refs ELSE []::BIGINT[] END AS ok FROM r),
  j AS (SELECT *, CASE WHEN length(ok) > 0 THEN {entails_sql("array_to_string(list_transform(ok, lambda k: docs[k]), chr(10))", 's')} ELSE 0 END AS joint FROM v),
  p AS (SELECT *, CASE WHEN length(ok) <= 1 THEN joint WHEN joint = 0 THEN 0 ELSE
    (CASE WHEN {entails_sql('docs[1]', 's')} = 1 OR {entails_sql('docs[2]', 's')} = 0 THEN 1 ELSE 0 END) + (CASE WHEN {entails_sql('docs[2]', 's')} = 1 OR {entails_sql('docs[1]', 's')} = 0 THEN 1 ELSE 0 END) END AS precise FROM j)
  SELECT conv_id, turn, round(avg(joint), 6)::DOUBLE AS citation_recall, round(CASE WHEN sum(length(ok)) > 0 THEN sum(precise) / sum(length(ok)) ELSE 0 END, 6)::DOUBLE AS citation_precision FROM p GROUP BY conv_id, turn""")
def citation_scores(spark, sf_dir):
    """Sentences of both turns that cite none, one or two of the output's sentences, or one that isn't there."""
    refs = F.expr("transform(sequence(1, size(s)), i -> CASE i % 4 WHEN 0 THEN array() WHEN 1 THEN array(0) WHEN 2 THEN array(0, 1) ELSE array(1, 98) END)")
    rows = _turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("id"), T.sentences(F.col("output")).alias("docs"), T.sentences(F.concat("gold", F.lit(" "), "output")).alias("s")).where(F.size("s") > 0)
    items = rows.select("id", "docs", F.zip_with("s", refs, lambda s, r: F.struct(s.alias("sentence"), r.cast("array<int>").alias("refs"))).alias("sentences"))
    return metrics.citation_scores(items, models.entailment(models.OverlapEntailment)).select("id.conv_id", "id.turn", F.round("citation_recall", 6).alias("citation_recall"), F.round("citation_precision", 6).alias("citation_precision"))


@query("""WITH t AS (SELECT conv_id, turn, text, length(text) % 7 AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
  SELECT conv_id AS id, arg_max(text, (score, -i)) FILTER (score IS NOT NULL) AS answer FROM t GROUP BY conv_id""")
def best_scored_answer(spark, sf_dir):
    """The answer of the highest score in the long-answer result format: a conversation's turns are its answers."""
    answers = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("text"), (F.length(x["text"]) % 7).alias("score")))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("q_id")).agg(answers.alias("answers"))
    rows = rows.withColumns({"question": F.lit("q"), "output": F.lit("o"), "claims": F.array(F.lit("c"))})
    return sinks.final_answers(rows, "eli5").select("id", "answer")


@query(f"""WITH {TURNS}, w AS (SELECT *, list_filter(string_split(gold, ' '), lambda x: x <> '') AS words, {norm_sql('output')} AS inside FROM turns),
  c AS (SELECT conv_id, turn, length(words) AS n, length(list_filter(words, lambda x: contains(inside, {norm_sql('x')}))) AS k FROM w)
  SELECT conv_id, turn, round(CASE WHEN n > 0 THEN k / n ELSE 0 END, 6)::DOUBLE AS em, (n > 0 AND k = n)::INTEGER::DOUBLE AS hit FROM c""")
def str_em(spark, sf_dir):
    words = F.filter(F.split("gold", " "), lambda x: x != "")
    pairs = F.transform(words, lambda x: F.struct(F.array(x).alias("short_answers")))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", metrics.presence_scores(pairs, F.col("output")).alias("s"))
    return rows.select("conv_id", "turn", F.round("s.em", 6).alias("em"), "s.hit")


@query(f"""WITH {TURNS}, k AS (SELECT conv_id, turn, {tokens_sql(norm_sql('gold'))} AS a, {tokens_sql(norm_sql('output'))} AS b FROM turns)
  SELECT conv_id, turn, round(CASE WHEN length(a) = 0 OR length(b) = 0 THEN (length(a) = length(b))::INTEGER ELSE 2 * coalesce({overlap_sql('a', 'b')}, 0) / (length(a) + length(b)) END, 6)::DOUBLE AS f1,
  (a = b)::INTEGER::DOUBLE AS exact FROM k""")
def answer_f1(spark, sf_dir):
    g, o = F.col("gold"), F.col("output")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(metrics.answer_f1(g, o), 6).alias("f1"), metrics.answer_exact(g, o).alias("exact"))


@query("SELECT round(avg(length(regexp_extract_all(text, '\\S+'))), 6) AS length FROM documents")
def avg_len(spark, sf_dir):
    return metrics.mean_length(table(spark, sf_dir, "documents").select(F.col("text").alias("output"))).select(F.round("length", 6).alias("length"))


@query(f"""WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents),
  g AS (SELECT doc_id, array_to_string(list_filter(parts, lambda x, i: i % 3 <> 0), ', ') AS out, list_transform(list_filter(parts, lambda x, i: i % 3 <> 1), lambda x: {norm_sql('x')}) AS golds FROM d),
  p AS (SELECT doc_id, golds, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(out, '\\s+$', ''), '\\.+$', ''), ',+$', ''), ','), lambda x: {norm_sql('x')}), lambda x: x <> '') AS said FROM g),
  c AS (SELECT doc_id, length(said) AS n, length(golds) AS m, length(list_filter(said, lambda x: list_contains(golds, x))) AS ok, length(list_filter(golds, lambda x: list_contains(said, x))) AS hit FROM p),
  r AS (SELECT doc_id, n, CASE WHEN n > 0 THEN ok / n ELSE 0 END AS p, CASE WHEN m > 0 THEN hit / m ELSE 0 END AS r, CASE WHEN m > 0 THEN least(5, hit) / least(5, m) ELSE 0 END AS r5 FROM c)
  SELECT doc_id, n::INTEGER AS num_preds, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(r5, 6)::DOUBLE AS recall_top5,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1, round(CASE WHEN p + r5 > 0 THEN 2 * p * r5 / (p + r5) ELSE 0 END, 6)::DOUBLE AS f1_top5 FROM r""")
def list_prf_top5(spark, sf_dir):
    """Of each text's parts every third is only said, every third only expected, and the others are both."""
    parts = F.filter(F.transform(F.split("text", ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", parts.alias("parts"))
    golds = F.transform(F.filter("parts", lambda x, i: i % 3 != 0), lambda x: F.array(x))
    s = metrics.list_scores(F.array_join(F.filter("parts", lambda x, i: i % 3 != 2), ", "), golds)
    rows = rows.select("doc_id", s.alias("s"))
    return rows.select("doc_id", "s.num_preds", *[F.round(f"s.{k}", 6).alias(k) for k in ("precision", "recall", "recall_top5", "f1", "f1_top5")])


# ---------------------------------------------------------------- documents as trees

#: Every fourth line of a text becomes a heading of level 2 to 4, every fifth a list item.
_LINE = (
    "CASE WHEN i % 4 = 2 THEN repeat('=', 2 + (i div 4 + length(x)) % 3) || ' ' || replace(x, '=', '') || ' ' || repeat('=', 2 + (i div 4 + length(x)) % 3)"
    " WHEN i % 5 = 3 THEN repeat('*', 1 + length(x) % 2) || x ELSE x END"
)


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, text): documents as marked-up pages."""
    lines = F.expr(f"transform(split(text, '\\n'), (x, i) -> {_LINE})")
    return table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.array_join(lines, "\n").alias("text"))


WIKI = """raw AS (SELECT 'Doc ' || doc_id AS title, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
  marked AS (SELECT title, i, """ + _LINE.replace(" div ", " // ") + """ AS line FROM raw),
  classed AS (SELECT title, i, line, CASE WHEN regexp_matches(line, '^={2,}\\s*.*?\\s*={2,}') THEN 'h' WHEN regexp_matches(line, '^:*[*#]+') THEN 'l' ELSE 'p' END AS kind,
    length(regexp_extract(line, '^(=*)', 1)) AS lvl, length(regexp_extract(line, '^(:*[*#]+)', 1)) AS ilvl FROM marked),
  kept AS (SELECT title, i, kind, lvl, ilvl, CASE kind WHEN 'h' THEN repeat('=', lvl) || trim(regexp_extract(line, '^=*\\s*(.*?)\\s*=*$', 1)) || repeat('=', lvl)
    WHEN 'l' THEN regexp_extract(line, '^(:*[*#]+)', 1) || ' ' || trim(regexp_extract(line, '^:*[*#]+\\s*(.*)', 1)) ELSE trim(line) END AS body FROM classed
    WHERE trim(line) <> '' AND (kind <> 'l' OR trim(regexp_extract(line, '^:*[*#]+\\s*(.*)', 1)) <> '')),
  seen AS (SELECT *, row_number() OVER w AS id, max(CASE WHEN kind = 'h' AND lvl = 2 THEN i END) OVER b AS h2, max(CASE WHEN kind = 'h' AND lvl = 3 THEN i END) OVER b AS h3,
    max(CASE WHEN kind = 'h' AND lvl = 4 THEN i END) OVER b AS h4, max(CASE WHEN kind <> 'l' THEN i END) OVER b AS broke FROM kept
    WINDOW w AS (PARTITION BY title ORDER BY i), b AS (PARTITION BY title ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  lists AS (SELECT *, max(CASE WHEN kind = 'l' AND ilvl = 1 THEN i END) OVER (PARTITION BY title, broke ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l1 FROM seen),
  ups AS (SELECT *, CASE kind WHEN 'h' THEN greatest(CASE WHEN lvl > 2 THEN h2 END, CASE WHEN lvl > 3 THEN h3 END) WHEN 'p' THEN greatest(h2, h3, h4)
    ELSE CASE WHEN ilvl > 1 AND l1 IS NOT NULL THEN l1 ELSE broke END END AS up_i FROM lists),
  tree AS (SELECT u.title, u.id, u.kind, u.body, coalesce(p.id, 0) AS up_id FROM ups u LEFT JOIN ups p ON u.title = p.title AND u.up_i = p.i)"""


@query(f"WITH {WIKI} SELECT title, id::INTEGER AS id, CASE kind WHEN 'h' THEN 'title' ELSE 'content' END AS type, body AS text, up_id::INTEGER AS up_id FROM tree")
def wiki_tree(spark, sf_dir):
    """Nodes below the root with their parents, before empty headings go."""
    docs = tree.trees(_wiki(spark, sf_dir), clean=False, prune=False)
    return tree.nodes_of(docs).where("id > 0").select("title", "id", "type", "text", "up_id")


@query(f"""WITH {WIKI}, c AS (SELECT title, id, body, row_number() OVER (PARTITION BY title ORDER BY id) AS n, length(body) AS len FROM tree WHERE kind <> 'h')
  SELECT title, text, (length(title) + 1 + coalesce(sum(len + 1) OVER (PARTITION BY title ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS span_start,
  (length(title) + 1 + coalesce(sum(len + 1) OVER (PARTITION BY title ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len)::INTEGER AS span_end FROM (SELECT *, body AS text FROM c)""")
def tree_spans(spark, sf_dir):
    """Content of pruned trees with its place in the full text."""
    docs = tree.trees(_wiki(spark, sf_dir), clean=False)
    return tree.nodes_of(docs).where("type = 'content'").select("title", "text", "span_start", "span_end")


@query(f"""WITH {WIKI}, f AS (SELECT title, min(id) FILTER (kind = 'h') AS h FROM tree GROUP BY title)
  SELECT d.title, coalesce(string_agg(t.body, chr(10) ORDER BY t.id), '') AS intro FROM (SELECT DISTINCT title FROM raw) d LEFT JOIN f ON d.title = f.title
  LEFT JOIN tree t ON t.title = d.title AND t.kind <> 'h' AND (f.h IS NULL OR t.id < f.h) GROUP BY d.title""")
def intro_text(spark, sf_dir):
    docs = tree.trees(_wiki(spark, sf_dir), clean=False, prune=False)
    return docs.select("title", tree.intro_of(F.col("nodes")).alias("intro"))


@query(f"""WITH RECURSIVE {WIKI}, up AS (SELECT title, id, up_id FROM tree WHERE kind <> 'h' UNION ALL SELECT u.title, u.id, t.up_id FROM up u JOIN tree t ON u.title = t.title AND u.up_id = t.id),
  alive AS (SELECT DISTINCT title, up_id AS id FROM up UNION SELECT title, id FROM tree WHERE kind <> 'h')
  SELECT title, count(*) FILTER (kind = 'h') AS headings, count(*) FILTER (kind <> 'h') AS contents FROM tree JOIN alive USING (title, id) GROUP BY title""")
def tree_prune(spark, sf_dir):
    """Headings and content of each pruned tree."""
    docs = tree.nodes_of(tree.trees(_wiki(spark, sf_dir), clean=False)).where("id > 0")
    return docs.groupBy("title").agg(F.count_if(F.col("type") == "title").alias("headings"), F.count_if(F.col("type") == "content").alias("contents"))


@query(f"""WITH RECURSIVE {WIKI}, pick AS (SELECT title, id FROM tree WHERE kind = 'h' AND id % 3 = 0),
  down AS (SELECT title, id FROM pick UNION SELECT t.title, t.id FROM down d JOIN tree t ON t.title = d.title AND t.up_id = d.id),
  climb AS (SELECT p.title, t.up_id AS id FROM pick p JOIN tree t USING (title, id) UNION SELECT c.title, t.up_id FROM climb c JOIN tree t ON t.title = c.title AND t.id = c.id WHERE c.id > 0),
  lit AS (SELECT title, id FROM down UNION SELECT title, id FROM climb UNION SELECT title, 0 AS id FROM raw UNION SELECT title, id FROM tree WHERE kind <> 'h' AND up_id = 0
    UNION SELECT t.title, t.id FROM climb c JOIN tree t ON t.title = c.title AND t.up_id = c.id WHERE t.kind <> 'h')
  SELECT title, id::INTEGER AS id FROM lit""")
def light_subtree(spark, sf_dir):
    """Ids that every third heading lights."""
    docs = tree.trees(_wiki(spark, sf_dir), clean=False, prune=False)
    chosen = F.transform(F.filter("nodes", lambda n: (n["type"] == "title") & (n["id"] > 0) & (n["id"] % 3 == 0)), lambda n: n["id"])
    return docs.select("title", F.explode(tree.lit_by_headings(F.col("nodes"), chosen)).alias("id"))


@query(f"""WITH RECURSIVE {WIKI}, up AS (SELECT title, id, up_id FROM tree WHERE kind <> 'h' AND id % 4 = 1 UNION ALL SELECT u.title, u.id, t.up_id FROM up u JOIN tree t ON u.title = t.title AND u.up_id = t.id),
  lit AS (SELECT title, id FROM tree WHERE kind <> 'h' AND id % 4 = 1 UNION SELECT title, up_id FROM up),
  rows AS (SELECT l.title, l.id, coalesce(t.body, '=' || l.title || '=') AS body, 0 AS d FROM lit l LEFT JOIN tree t USING (title, id)),
  deep AS (SELECT title, id, id AS at, 0 AS d FROM rows UNION ALL SELECT d.title, d.id, t.up_id, d.d + 1 FROM deep d JOIN tree t ON t.title = d.title AND t.id = d.at)
  SELECT r.title, string_agg(repeat('    ', m.d) || r.id || ': ' || r.body, chr(10) ORDER BY r.id) AS subtree FROM rows r JOIN (SELECT title, id, max(d) AS d FROM deep GROUP BY title, id) m USING (title, id) GROUP BY r.title""")
def render_subtree(spark, sf_dir):
    """Rendered subtrees of every fourth paragraph and its ancestors."""
    docs = tree.trees(_wiki(spark, sf_dir), clean=False, prune=False)
    ids = F.transform(F.filter("nodes", lambda n: n["id"] % 4 == 1), lambda n: n["id"])
    rows = docs.select("title", tree.rendered(F.col("nodes"), tree.lit_by_paragraphs(F.col("nodes"), ids)).alias("subtree"))
    return rows.where("subtree <> ''")


@query(f"""WITH {WIKI}, h AS (SELECT title, id, up_id FROM tree WHERE kind = 'h'), s AS (SELECT * FROM h WHERE id % 2 = 0 UNION ALL SELECT DISTINCT title, 0, NULL FROM raw),
  k AS (SELECT title, id FROM s WHERE id = 0 OR NOT EXISTS (SELECT 1 FROM s c WHERE c.title = s.title AND c.up_id = s.id))
  SELECT title, list_sort(list(id))::INTEGER[] AS headings FROM k GROUP BY title""")
def innermost_headings(spark, sf_dir):
    docs = tree.nodes_of(tree.trees(_wiki(spark, sf_dir), clean=False, prune=False)).where("type = 'title'")
    lines = docs.select(F.col("title").alias("doc"), "id", "up_id", F.lit(False).alias("is_intro"))
    return tree.innermost_headings(lines.where("id % 2 = 0").select("doc", "id"), lines).select(F.col("doc").alias("title"), "headings")


@query(f"""WITH {WIKI} SELECT d.title, '0: =' || d.title || '=' || coalesce(string_agg(chr(10) || repeat('    ', t.lvl - 1) || t.id || ': ' || t.body, '' ORDER BY t.id) , '') AS outline
  FROM (SELECT DISTINCT title FROM raw) d LEFT JOIN (SELECT title, id, lvl, body FROM seen WHERE kind = 'h') t USING (title) GROUP BY d.title""")
def outline_format(spark, sf_dir):
    """Outlines without introductions."""
    docs = tree.trees(_wiki(spark, sf_dir), clean=False, prune=False)
    return docs.select("title", tree.outline(F.col("title"), F.lit(""), tree.headings_of(F.col("nodes"))).alias("outline"))


@query("""SELECT 'Doc ' || doc_id AS title FROM (SELECT *, CASE doc_id % 9 WHEN 0 THEN 'List of x' WHEN 1 THEN 'x (Disambiguation)' WHEN 2 THEN 'Template:x' WHEN 3 THEN 'A List of x' ELSE 'x' END AS t,
  CASE doc_id % 7 WHEN 0 THEN '#REDIRECT ' ELSE '' END AS r FROM documents) WHERE doc_id % 9 NOT IN (0, 1, 2) AND doc_id % 7 <> 0 AND text IS NOT NULL""")
def page_filter(spark, sf_dir):
    name = "CASE doc_id % 9 WHEN 0 THEN 'List of x' WHEN 1 THEN 'x (Disambiguation)' WHEN 2 THEN 'Template:x' WHEN 3 THEN 'A List of x' ELSE 'x' END"
    rows = table(spark, sf_dir, "documents").selectExpr("concat('Doc ', doc_id) AS id", f"{name} AS title", "concat(CASE doc_id % 7 WHEN 0 THEN '#REDIRECT ' ELSE '' END, text) AS text")
    return pages.articles(rows).select(F.col("id").alias("title"))


@query("SELECT string_split(text, chr(10))[1] AS title, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def title_index_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.split("text", "\n")[0].alias("title"), "doc_id")
    return readers.first_of_each(rows, "title", ["doc_id"])


@query("SELECT title, max_by(doc_id, doc_id) AS doc_id FROM (SELECT string_split(text, chr(10))[1] AS title, doc_id FROM documents) GROUP BY title")
def vertex_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.split("text", "\n")[0].alias("title"), "doc_id", F.col("doc_id").alias("seq"))
    return graph.upsert_vertices(rows)


# ---------------------------------------------------------------- links and graph

HREFS = "regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)"


@query(f"SELECT page_id, list_distinct(l) IS NOT NULL AS linked, length(l)::INTEGER AS n, length(list_distinct(l))::INTEGER AS kinds FROM (SELECT page_id, {HREFS} AS l FROM pages)")
def page_links(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), 1)
    rows = table(spark, sf_dir, "pages").select("page_id", found.alias("l"))
    return rows.select("page_id", F.lit(True).alias("linked"), F.size("l").alias("n"), F.size(F.array_distinct("l")).alias("kinds"))


#: A page for each document: other documents in its introduction and sections, some misspelt, some unknown; every seventh title is repeated with another case.
_LINKED = '''concat('See [[Doc ', doc_id * 3 % 1000, '|DOC ', doc_id * 5 % 1000, ']], [[doc ', doc_id * 3 % 1000, ']]<ref>[[Doc 1]]</ref> and [[Doc ', doc_id * 5 % 1000, ']].\n{{box [[Doc 2]]}}\n== Body ==\n[[Doc 3]]\n* [[Doc 4]]\n',
  '==See Also==\n* [[x|Doc ', doc_id * 7 % 1000, ']] [[{Doc 5}]] [[Nobody]]\n[[Doc 6]]\n* [[doc ', doc_id * 11 % 1000, ']]\n=== External links ===\n* [[Doc 7]]\n{{Doc ', doc_id * 13 % 1000, '|state=on}}\n{{Authority control}}\n{{DOC ', doc_id * 17 % 1000, '}}\n{{x|y}}')'''


@query(f'''WITH p AS (SELECT 'Doc ' || doc_id AS title, doc_id AS n, doc_id FROM documents UNION ALL SELECT 'DOC ' || doc_id, doc_id - 5000000, doc_id FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'dOC ' || doc_id, doc_id + 5000000, doc_id FROM documents WHERE doc_id % 7 = 1),
  m AS (SELECT lower(title) AS l, arg_max(title, n) AS t FROM p GROUP BY 1),
  r AS (SELECT title, n, ['Doc ' || doc_id * 7 % 1000, 'Nobody', 'doc ' || doc_id * 11 % 1000] AS see_also, ['Doc ' || doc_id * 13 % 1000, 'DOC ' || doc_id * 17 % 1000] AS external,
    ['DOC ' || doc_id * 5 % 1000, 'doc ' || doc_id * 3 % 1000, 'Doc ' || doc_id * 5 % 1000] AS intro FROM p),
  x AS (SELECT n, kind, pos, t FROM (SELECT n, kind, unnest(f) AS text, generate_subscripts(f, 1) AS pos FROM (SELECT n, 'see_also' AS kind, see_also AS f FROM r UNION ALL SELECT n, 'external', external FROM r UNION ALL SELECT n, 'intro', intro FROM r)) JOIN m ON lower(text) = l),
  d AS (SELECT n, kind, list(t ORDER BY pos) AS docs FROM (SELECT n, kind, t, min(pos) AS pos FROM x GROUP BY ALL) GROUP BY ALL)
  SELECT title, see_also, external, intro, coalesce(a.docs, []) AS see_also_docs, coalesce(b.docs, []) AS external_docs, coalesce(c.docs, []) AS intro_docs FROM r
  LEFT JOIN d a ON a.n = r.n AND a.kind = 'see_also' LEFT JOIN d b ON b.n = r.n AND b.kind = 'external' LEFT JOIN d c ON c.n = r.n AND c.kind = 'intro' ''')
def wiki_links(spark, sf_dir):
    '''Raw and resolved links of pages that are cleaned for their introductions.'''
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_LINKED).alias("text"))
    spellings = [("Doc ", 0, None), ("DOC ", -5000000, 0), ("dOC ", 5000000, 1)]
    pages = [rows.where("true" if rest is None else f"doc_id % 7 = {rest}").select(F.concat(F.lit(name), F.col("doc_id").cast("string")).alias("title"), "text", (F.col("doc_id") + more).alias("n")) for name, more, rest in spellings]
    return links.page_links(pages[0].unionByName(pages[1]).unionByName(pages[2]), "n")


#: Markup around the lines of a text, by their number.
_MARKED = '''CASE i % 12 WHEN 0 THEN concat('{{Box|', replace(replace(x, '{', ''), '}', ''), '}}') WHEN 1 THEN concat(x, '<ref name=a>', 'see</ref>') WHEN 2 THEN concat('[[File:a.png|', x, ']]') WHEN 3 THEN concat('[[A|', x, ']] [[B]]')
  WHEN 4 THEN concat(x, '{{cite web|u}} {{Citation|', 'v}}') WHEN 5 THEN concat('{| class=x', chr(10), '| ', x, chr(10), '|}') WHEN 6 THEN concat('[https://e.org/', i, ' ', x, '] [http://e.org]') WHEN 7 THEN concat('| ', x)
  WHEN 8 THEN concat('<b>', x, '</b><br/>&nbsp;') WHEN 9 THEN concat('[[Category:', x, ']]', chr(10), chr(10), '<gallery>', x, '</gallery>') WHEN 10 THEN concat('&lt;ref&gt;', x, '&lt;/ref&gt;', x) ELSE x END'''


def _cleaned_sql() -> str:
    out = "regexp_replace(t, '(?m)^\\{\\{[^{}]*\\}\\}$', '', 'g')"
    for pattern, by in markup.REWRITES:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


@query(f'''WITH l AS (SELECT doc_id, translate(unnest(string_split(text, chr(10))), '[]<>&|=', '') AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
  p AS (SELECT doc_id, string_agg({_MARKED}, chr(10) ORDER BY i) AS t FROM l GROUP BY doc_id) SELECT doc_id, {_cleaned_sql()} AS text FROM p''')
def clean_markup(spark, sf_dir):
    '''Plain text of documents whose lines are wrapped in all kinds of markup.'''
    lines = F.expr(f"transform(split(translate(text, '[]<>&|=', ''), '\\n'), (x, i) -> {_MARKED})")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(lines, "\n").alias("t"))
    return rows.select("doc_id", markup.clean_markup(F.col("t")).alias("text"))


def _page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), 1)
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("title"), found.alias("links"))
    return graph.symmetric(graph.edges_from_lists(rows, "links"))


EDGES = f"""link AS (SELECT url AS src, unnest({HREFS}) AS dst FROM pages), edge AS (SELECT src, dst FROM link UNION SELECT dst, src FROM link)"""


@query(f"WITH {EDGES} SELECT src, dst FROM edge")
def graph_edges(spark, sf_dir):
    return _page_edges(spark, sf_dir)


@query(f"WITH {EDGES}, v AS (SELECT url AS title FROM pages UNION SELECT src FROM edge) SELECT title, coalesce(n, 0)::BIGINT AS degree FROM v LEFT JOIN (SELECT src, count(*) AS n FROM edge GROUP BY src) ON title = src")
def graph_degree(spark, sf_dir):
    edges = _page_edges(spark, sf_dir)
    vertices = graph.with_endpoints(table(spark, sf_dir, "pages").select(F.col("url").alias("title")).distinct(), edges)
    return graph.degrees(vertices, edges)


@query(f"WITH {EDGES}, d AS (SELECT count(*) AS n FROM edge GROUP BY src) SELECT count(*) AS n, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM d")
def degree_stats(spark, sf_dir):
    edges = _page_edges(spark, sf_dir)
    s = graph.degree_statistics(edges.groupBy("src").agg(F.count("*").alias("degree")))
    return s.withColumn("mean", F.round("mean", 6))


@query(f"""WITH {EDGES}, d AS (SELECT src, count(*) AS n FROM edge GROUP BY src), v AS (SELECT url AS title, max(page_id) AS seq, arg_max(length(html), page_id) AS size FROM pages GROUP BY url)
  SELECT coalesce(v.title, d.src) AS title, v.seq, v.size, coalesce(n, 0)::BIGINT AS degree FROM v FULL JOIN d ON v.title = d.src""")
def graph_store_batches(spark, sf_dir):
    """The stored graph after three batches of pages and a fourth that repeats one of them."""
    path = new_folder(spark, "graph")
    pages = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), 1)
    for batch in (0, 1, 2, 1):
        rows = pages.where(F.col("page_id") % 3 == batch).select(F.col("url").alias("title"), F.col("page_id").alias("seq"), F.length("html").cast("long").alias("size"), found.alias("links"))
        GraphStore(spark, path, "size long", buckets=8).upsert(rows, graph.edges_from_lists(rows, "links"))
    stored = cut(GraphStore(spark, path, "size long").vertices().drop("bucket"))
    deleted(spark, path)
    return stored


#: The document graph of the expansion queries: vector v is linked with (3v + 1), (5v + 2) and (11v + 7) modulo their number.
_NEXT = ((3, 1), (5, 2), (11, 7))


def _vector_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, edges, vertices): every twentieth vector is a root; its query is vector (7 root + 3) modulo their number."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("title"), "embedding")
    n = rows.count()
    targets = F.array(*[F.expr(f"(title * {a} + {b}) % {n}") for a, b in _NEXT])
    edges = graph.symmetric(rows.select(F.col("title").alias("src"), F.explode(targets).alias("dst")))
    vertices = rows.join(graph.degrees(rows, edges), "title")
    roots = rows.where("title % 20 = 0").select(F.col("title").alias("root"), F.expr(f"(title * 7 + 3) % {n}").alias("asked"))
    seeds = roots.join(rows.select(F.col("title").alias("asked"), F.col("embedding").alias("query")), "asked").select(F.col("root").alias("qid"), "root", "query")
    return seeds, edges, vertices


BEAM = {"top_k": 5, "local_weight": 0.4, "global_weight": 0.6, "threshold": 0.1, "degree_cap": 7}
VECTORS = """nn AS (SELECT count(*) AS n FROM embeddings), v0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
  l AS (SELECT id AS src, unnest([(id * 3 + 1) % n, (id * 5 + 2) % n, (id * 11 + 7) % n]) AS dst FROM v0, nn), ed AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l),
  v AS (SELECT id, e, count(dst) AS degree FROM v0 LEFT JOIN ed ON id = src GROUP BY id, e),
  q AS (SELECT r.id AS root, a.e AS qe FROM v0 r, nn JOIN v0 a ON a.id = (r.id * 7 + 3) % n WHERE r.id % 20 = 0),
  f0 AS (SELECT q.root, qe, v.id AS source, v.e AS own, 1.0::DOUBLE AS ps, 0 AS sr FROM q JOIN v ON q.root = v.id WHERE v.degree <= 7)"""


def hops_sql(n: int) -> str:
    """Common table expressions r1 … rn (reported rows), by the definition of the expansion."""
    out = [VECTORS, "s0 AS (SELECT root, source AS id FROM f0)"]
    for h in range(1, n + 1):
        p = h - 1
        out.append(f"""c{h} AS (SELECT f.root, f.qe, t.id, t.e, t.degree, f.source, f.sr, list_cosine_similarity(f.own, t.e) AS adj, f.ps * list_cosine_similarity(f.own, t.e) AS loc
  FROM f{p} f JOIN ed ON ed.src = f.source JOIN v t ON t.id = ed.dst WHERE NOT EXISTS (SELECT 1 FROM s{p} s WHERE s.root = f.root AND s.id = t.id)),
  b{h} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, id ORDER BY loc DESC, sr) AS k FROM c{h}) WHERE k = 1),
  g{h} AS (SELECT *, list_cosine_similarity(qe, e) AS gl, 0.4 * loc + 0.6 * list_cosine_similarity(qe, e) AS total FROM b{h}),
  m{h} AS (SELECT *, exp(total - max(total) OVER (PARTITION BY root)) AS ex FROM g{h}),
  k{h} AS (SELECT *, ex / sum(ex) OVER (PARTITION BY root) AS soft, row_number() OVER (PARTITION BY root ORDER BY total DESC, id) AS rank, count(*) OVER (PARTITION BY root) AS n FROM m{h}),
  r{h} AS (SELECT * FROM k{h} WHERE rank <= 5 AND total >= 0.1),
  f{h} AS (SELECT root, qe, id AS source, e AS own, loc AS ps, rank AS sr FROM r{h} WHERE degree <= 7),
  s{h} AS (SELECT * FROM s{p} UNION SELECT root, source FROM f{h})""")
    return ", ".join(out)


def hop_rows(n: int) -> str:
    one = "SELECT root, {h}::INTEGER AS hop, rank::INTEGER AS rank, id AS title, source AS source_title, round(adj, 6) AS adjacent_score, round(loc, 6) AS local_score, round(gl, 6) AS global_score, round(total, 6) AS total_score, round(soft, 6) AS softmax_score, degree FROM r{h}"
    return " UNION ALL ".join(one.format(h=h) for h in range(1, n + 1))


def _rounded(hops: DataFrame) -> DataFrame:
    scores = [f"{s}_score" for s in ("adjacent", "local", "global", "total", "softmax")]
    return hops.select("root", "hop", "rank", "title", "source_title", *[F.round(s, 6).alias(s) for s in scores], "degree")


@query(f"WITH {hops_sql(1)} {hop_rows(1)}")
def propagate_hop1(spark, sf_dir):
    return _rounded(graph.propagate(*_vector_graph(spark, sf_dir), hops=1, **BEAM)[0])


@query(f"WITH {hops_sql(2)} {hop_rows(2)}")
def propagate_hop2(spark, sf_dir):
    return _rounded(graph.propagate(*_vector_graph(spark, sf_dir), hops=2, **BEAM)[0])


@query(f"WITH {hops_sql(5)} {hop_rows(5)}")
def propagate_full(spark, sf_dir):
    return _rounded(graph.propagate(*_vector_graph(spark, sf_dir), hops=5, **BEAM)[0])


@query(f"WITH {hops_sql(3)} " + " UNION ALL ".join(f"SELECT root, {h}::INTEGER AS hop, max(n) AS candidates FROM k{h} GROUP BY root" for h in (1, 2, 3)))
def hop_nodes(spark, sf_dir):
    """Candidates of each hop."""
    return graph.propagate(*_vector_graph(spark, sf_dir), hops=3, **BEAM)[1].select("root", "hop", "candidates")


@query(f"""WITH {hops_sql(2)}, e AS (SELECT root, root AS id FROM f0 UNION SELECT root, id FROM r1 UNION SELECT root, id FROM r2) SELECT DISTINCT id AS title FROM e""")
def required_titles(spark, sf_dir):
    hops, _ = graph.propagate(*_vector_graph(spark, sf_dir), hops=2, **BEAM)
    seeds = _vector_graph(spark, sf_dir)
    roots = seeds[0].select(F.col("root").alias("title")).join(seeds[2].where(f"degree <= {BEAM['degree_cap']}").select("title"), "title", "left_semi")
    return graph.required_titles(hops).unionByName(roots).distinct()


@query(f"""WITH {hops_sql(3)}, p1 AS (SELECT root, rank AS path, id, [rank] AS o FROM r1), p2 AS (SELECT p.root, p.path, r.id, list_append(p.o, r.rank) AS o FROM p1 p JOIN r2 r ON r.root = p.root AND r.source = p.id),
  p3 AS (SELECT p.root, p.path, r.id, list_append(p.o, r.rank) AS o FROM p2 p JOIN r3 r ON r.root = p.root AND r.source = p.id),
  a AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
  d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, path, id ORDER BY length(o), o) AS k FROM a) WHERE k = 1),
  m AS (SELECT root, path, row_number() OVER (PARTITION BY root, path ORDER BY length(o), o) AS place, id FROM d),
  w AS (SELECT root, path FROM m UNION SELECT root, 0 FROM q UNION SELECT root, 1 FROM q WHERE root NOT IN (SELECT root FROM r1))
  SELECT root, path::INTEGER AS path, place::INTEGER AS place, id AS title FROM m UNION ALL SELECT root, path::INTEGER, 0, root FROM w""")
def path_members(spark, sf_dir):
    seeds, edges, vertices = _vector_graph(spark, sf_dir)
    hops, _ = graph.propagate(seeds, edges, vertices, hops=3, **BEAM)
    return graph.paths(hops, seeds, max_hops=3).select("root", "path", "place", "title")


@query("""WITH q AS (SELECT vec_id AS a, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT a, vec_id AS b, list_cosine_similarity(x, embedding::DOUBLE[]) AS c FROM q, embeddings),
  k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS rank FROM s)
  SELECT a AS query_id, b AS vec_id, round(c, 6) AS score, rank::INTEGER AS rank FROM k WHERE rank <= 10""")
def knn_cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_top(rows, asked, k=10, normalized=True).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT vec_id AS a, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT a, vec_id AS b, list_dot_product(x, embedding::DOUBLE[]) AS c FROM q, embeddings),
  k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS rank FROM s)
  SELECT a AS query_id, b AS vec_id, round(c, 6) AS score, rank::INTEGER AS rank FROM k WHERE rank <= 100""")
def dense_topk_dot(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_top(rows, asked, k=100).withColumn("score", F.round("score", 6))


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  s AS (SELECT vec_id, k, sum(e[4 * r + k + 1]) / count(*) AS m FROM x, range(4) a(k), range(16) b(r) WHERE (vec_id + r) % 3 <> 0 GROUP BY vec_id, k),
  n AS (SELECT vec_id, sqrt(sum(m * m)) AS size FROM s GROUP BY vec_id)
  SELECT vec_id, list(round(m / size, 6) ORDER BY k) AS pooled FROM s JOIN n USING (vec_id) GROUP BY vec_id""")
def pooled_embeddings(spark, sf_dir):
    """Vectors cut into 16 token vectors of 4 numbers, of which a mask hides a third."""
    tokens = F.expr("transform(sequence(0, 15), r -> slice(embedding, 4 * r + 1, 4))")
    mask = F.expr("transform(sequence(0, 15), r -> cast((vec_id + r) % 3 <> 0 as int))")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", pooled(tokens, mask).alias("p"))
    return rows.select("vec_id", F.transform("p", lambda x: rounded(x, 6)).alias("pooled"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS adjacent FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def adjacent_cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return rows.join(after, "vec_id").select("vec_id", rounded(cosine(F.col("embedding"), F.col("after")), 6).alias("adjacent"))


def clusters_sql(bins: int, rounds: int) -> str:
    """Histogram h of the bins that vectors of even and odd ids fall in, by the definition of the rounds."""
    out = [f"v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS bin, e FROM (SELECT * FROM v ORDER BY id LIMIT {bins}))"]
    for r in range(rounds + 1):
        out.append(f"a{r} AS (SELECT id, arg_min(bin, (d, bin)) AS bin FROM (SELECT v.id, c.bin, list_distance(v.e, c.e) AS d FROM v, c{r} c) GROUP BY id)")
        moved = f"SELECT bin, list(x ORDER BY i) AS e FROM (SELECT bin, i, avg(x) AS x FROM (SELECT a.bin, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS i FROM a{r} a JOIN v USING (id)) GROUP BY bin, i) GROUP BY bin"
        out.append(f"c{r + 1} AS (SELECT c.bin, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN ({moved}) m USING (bin))")
    return ", ".join(out) + f", h AS (SELECT bin::INTEGER AS bin, count(*) FILTER (id % 2 = 0) AS n_left, count(*) FILTER (id % 2 = 1) AS n_right FROM a{rounds} GROUP BY bin)"


@query(f"WITH {clusters_sql(16, 3)} SELECT * FROM h")
def quantized_histogram(spark, sf_dir):
    """Vectors of even and of odd ids in the bins of their joint quantization."""
    rows = table(spark, sf_dir, "embeddings")
    return divergence.histograms(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), bins=16, rounds=3)


@query(f"""WITH {clusters_sql(16, 3)}, s AS (SELECT n_left / sum(n_left) OVER () AS p, n_right / sum(n_right) OVER () AS q FROM h),
  r AS (SELECT p, q, w, w * p + (1 - w) * q AS r FROM s, (SELECT 1e-6 + i * (1 - 2e-6) / 24 AS w FROM range(25) t(i))),
  c AS (SELECT exp(-5 * sum(CASE WHEN q > 0 THEN q * ln(q / r) ELSE 0 END)) AS x, exp(-5 * sum(CASE WHEN p > 0 THEN p * ln(p / r) ELSE 0 END)) AS y FROM r GROUP BY w UNION ALL SELECT 0, 1 UNION ALL SELECT 1, 0),
  t AS (SELECT (x - lag(x) OVER a) * (y + lag(y) OVER a) / 4 AS a, (y - lag(y) OVER b) * (x + lag(x) OVER b) / 4 AS b FROM c WINDOW a AS (ORDER BY x, y DESC), b AS (ORDER BY y, x DESC))
  SELECT round(sum(a) + sum(b), 6) AS area FROM t""")
def distribution_area(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = divergence.distribution_score(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), bins=16, rounds=3)
    return found.select(F.round("area", 6).alias("area"))


@query(f"""WITH {clusters_sql(12, 3)}, q AS (SELECT id, e FROM v WHERE id % 20 = 0),
  near AS (SELECT id, bin FROM (SELECT q.id, c.bin, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.e, c.e), c.bin) AS r FROM q, c3 c) WHERE r <= 5),
  p AS (SELECT n.id AS query_id, a.id AS vec_id, list_cosine_similarity(q.e, v.e) AS s FROM near n JOIN a3 a USING (bin) JOIN q ON q.id = n.id JOIN v ON v.id = a.id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM p)
  SELECT query_id, vec_id, round(s, 6) AS score, rank::INTEGER AS rank FROM k WHERE rank <= 10""")
def cell_topk(spark, sf_dir):
    """The ten most similar vectors in the five nearest of twelve stored cells."""
    path = new_folder(spark, "cells")
    rows = table(spark, sf_dir, "embeddings")
    retrieval.write_cells(rows, path, 12, rounds=3)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = cut(retrieval.cell_top(spark, path, asked, k=10, probes=5, normalized=True))
    deleted(spark, path)
    return found.withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- search

TOKEN_SQL = "regexp_extract_all(lower(text), '[^\\s.,;:!?|()\\[\\]\"]+')"


BM25_SQL = f"""WITH t AS (SELECT doc_id, {TOKEN_SQL} AS w FROM documents), st AS (SELECT count(*) AS n, avg(length(w)) AS mean FROM t),
  q AS (SELECT item_id, unnest(list_distinct({TOKEN_SQL})) AS term FROM benchmark), p AS (SELECT doc_id, length(w) AS len, unnest(w) AS term FROM t),
  c AS (SELECT doc_id, len, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
  s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * len / mean))) AS score FROM c JOIN f USING (term) JOIN q USING (term), st GROUP BY item_id, doc_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
  SELECT item_id, doc_id, round(score, 5) AS score, rank::INTEGER AS rank FROM k WHERE rank <= 10"""


@query(BM25_SQL)
def bm25_topk(spark, sf_dir):
    found = retrieval.bm25_top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.withColumn("score", F.round("score", 5))


@query(BM25_SQL)
def bm25_index_topk(spark, sf_dir):
    """The same search in an index that is written in two batches and opened again."""
    path = new_folder(spark, "postings")
    docs = table(spark, sf_dir, "documents")
    for batch in (0, 1):
        PostingsIndex(spark, path, buckets=16).append(docs.where(F.col("doc_id") % 2 == batch), batch)
    found = cut(PostingsIndex(spark, path).search(table(spark, sf_dir, "benchmark"), k=10))
    deleted(spark, path)
    return found.withColumn("score", F.round("score", 5))


@query("""WITH d AS (SELECT conv_id, turn AS doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM conversations WHERE role <> 'user' AND text IS NOT NULL),
  n AS (SELECT conv_id, count(*) AS n, min(turn) AS first FROM conversations WHERE role <> 'user' AND text IS NOT NULL GROUP BY conv_id), c AS (SELECT conv_id, doc, term, count(*) AS tf FROM d GROUP BY ALL),
  i AS (SELECT conv_id, term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM c JOIN n USING (conv_id) GROUP BY conv_id, term),
  w AS (SELECT conv_id, doc, term, tf * idf AS w FROM c JOIN i USING (conv_id, term)), wl AS (SELECT conv_id, doc, sqrt(sum(w * w)) AS len FROM w GROUP BY ALL),
  u AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM conversations WHERE role = 'user' AND text IS NOT NULL),
  uq AS (SELECT conv_id, turn, term, count(*) * any_value(idf) AS q FROM u JOIN i USING (conv_id, term) GROUP BY ALL), ul AS (SELECT conv_id, turn, sqrt(sum(q * q)) AS len FROM uq GROUP BY ALL),
  s AS (SELECT conv_id, turn, doc, sum(q * w) AS dot FROM uq JOIN w USING (conv_id, term) GROUP BY ALL),
  k AS (SELECT s.conv_id, s.turn, s.doc, dot / wl.len / ul.len AS score FROM s JOIN wl USING (conv_id, doc) JOIN ul ON ul.conv_id = s.conv_id AND ul.turn = s.turn),
  b AS (SELECT conv_id, turn, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 9) DESC, doc) AS r FROM k) WHERE r = 1)
  SELECT conv_id, turn, doc, round(score, 6) AS score FROM b UNION ALL
  SELECT c.conv_id, c.turn, n.first, 0 FROM conversations c JOIN n USING (conv_id) WHERE c.role = 'user' AND c.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.conv_id = c.conv_id AND b.turn = c.turn)""")
def tfidf_top1(spark, sf_dir):
    """The assistant turn of the same conversation that is most similar to each user turn."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    best = retrieval.tfidf_best(rows.where("role = 'user'"), rows.where("role <> 'user'").select("conv_id", F.col("turn").alias("doc"), "text"), "conv_id", "turn", "doc")
    return best.withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- context, parsers, runs


@query("""WITH r AS (SELECT source AS qid, doc_id AS "at", row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS k FROM documents)
  SELECT qid, "at", row_number() OVER (PARTITION BY qid ORDER BY k % 2, CASE WHEN k % 2 = 0 THEN k ELSE -k END)::INTEGER AS place FROM r""")
def context_interleave(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), F.col("doc_id").alias("at"), F.col("n_chars").alias("total_score"))
    return context.interleaved(rows).select("qid", "at", "place")


@query("""SELECT source AS qid, doc_id AS "at", row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS place FROM documents""")
def context_score_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), F.col("doc_id").alias("at"), F.col("n_chars").alias("total_score"))
    return context.score_order(rows).select("qid", "at", "place")


@query("""WITH w AS (SELECT source AS qid, doc_id AS place, text, regexp_extract_all(text, '\\S+') AS w FROM documents),
  s AS (SELECT *, length(w) AS n, coalesce(sum(length(w)) OVER (PARTITION BY qid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w)
  SELECT qid, place, CASE WHEN b + n <= 3800 THEN text ELSE array_to_string(w[1:(3800 - b)::BIGINT], ' ') END AS text FROM s WHERE b <= 3800""")
def context_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), F.col("doc_id").alias("place"), "text")
    return context.within_budget(rows, 3800)


@query("""WITH m AS (SELECT source AS qid, doc_id AS "at", CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 0 ELSE 1 END AS g FROM documents)
  SELECT qid, "at", row_number() OVER (PARTITION BY qid ORDER BY g, "at")::INTEGER AS place FROM m""")
def context_matched_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), F.col("doc_id").alias("at"), F.col("doc_id").cast("string").alias("title"))
    known = rows.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("at")), "at", "left_semi").select("qid", "title")
    return context.matched_first(rows, known).select("qid", "at", "place")


@query("SELECT conv_id, string_agg(coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def passages_context(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text"))).alias("p"))
    return rows.select("conv_id", context.passages_context(F.col("p")).alias("context"))


@query("""WITH t AS (SELECT conv_id AS qid, turn AS "at", role AS title, text, length(text) AS score, length(regexp_extract_all(text, '\\S+')) AS n FROM conversations),
  q AS (SELECT DISTINCT conv_id AS qid FROM conversations),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, "at") - 1 AS k, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t WHERE text <> ''),
  c AS (SELECT 'matched' AS mode, qid, string_agg(text, chr(10) || chr(10) ORDER BY title <> 'user', "at") AS context FROM r GROUP BY qid
    UNION ALL SELECT 'interleaved', qid, string_agg(text, chr(10) || chr(10) ORDER BY k % 2, CASE WHEN k % 2 = 0 THEN k ELSE -k END) FROM r GROUP BY qid
    UNION ALL SELECT 'tree', qid, string_agg(x, chr(10) || chr(10) ORDER BY "at") FILTER (x <> '') FROM (SELECT qid, "at", CASE WHEN b + n <= 60 THEN text ELSE array_to_string(regexp_extract_all(text, '\\S+')[1:(60 - b)::BIGINT], ' ') END AS x FROM r WHERE b <= 60) GROUP BY qid
    UNION ALL SELECT 'passages', qid, string_agg(coalesce(title, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY "at") FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY "at") AS p FROM t) WHERE p <= 2 GROUP BY qid)
  SELECT mode, qid, coalesce(context, '') AS context FROM (SELECT * FROM q, (SELECT unnest(['none', 'passages', 'tree', 'matched', 'interleaved']) AS mode)) LEFT JOIN c USING (qid, mode)""")
def context_modes(spark, sf_dir):
    """Contexts of all modes: a conversation's turns are its items and passages, the user's turns are the retrieved ones."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("at"), F.col("role").alias("title"), F.length("text").alias("total_score"), "text")
    every = F.transform(F.array_sort(F.collect_list(F.struct("at", "title", "text"))), lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text")))
    asked = turns.groupBy("qid").agg(every.alias("pre_retrieved_passages"))
    users = turns.where("title = 'user'").select("qid", F.struct("title", "text").alias("p")).groupBy("qid").agg(F.collect_list("p").alias("pre_retrieved_passages"))
    one = [context.reader_contexts(users if m == "matched" else asked, turns, m, budget=60, top_k=2).withColumn("mode", F.lit(m)) for m in context.MODES]
    missing = asked.join(users, "qid", "left_anti").select("qid", F.lit("").alias("context"), F.lit("matched").alias("mode"))
    found = one[0]
    for more in [*one[1:], missing]:
        found = found.unionByName(more)
    return found


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return sinks.remaining_by_key(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE doc_id >= 100")
def resume_count(spark, sf_dir):
    return sinks.remaining_by_count(table(spark, sf_dir, "documents"), 100, "doc_id").select("doc_id")


@query("""WITH o AS (SELECT doc_id, '[paragraph] ' || (doc_id % 50) || ': x' || chr(10) || ' [paragraph] n: y' || chr(10) || '[paragraph] 7 : z' || chr(10) || CASE WHEN doc_id % 10 = 0 THEN 'No Relevant Paragraphs' ELSE 'note' END AS t FROM documents)
  SELECT doc_id, CASE WHEN contains(lower(t), 'no relevant paragraphs') THEN []::INTEGER[] ELSE list_transform(regexp_extract_all(t, '(?m)^\\s*\\[paragraph\\]\\s*(\\d+)\\s*:', 1), lambda x: x::INTEGER) END AS ids FROM o""")
def paragraph_parse(spark, sf_dir):
    said = "concat('[paragraph] ', doc_id % 50, ': x\\n [paragraph] n: y\\n[paragraph] 7 : z\\n', CASE WHEN doc_id % 10 = 0 THEN 'No Relevant Paragraphs' ELSE 'note' END)"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{said} AS t").select("doc_id", parsers.paragraph_ids(F.col("t")).alias("ids"))


@query("""SELECT doc_id, title, id FROM (SELECT doc_id, unnest([{'title': 'A: b', 'id': (doc_id % 9)::INTEGER}, {'title': '0 =C', 'id': 12::INTEGER}, {'title': '0 =C', 'id': (doc_id % 4)::INTEGER}], recursive := true) FROM documents WHERE doc_id % 10 <> 0)""")
def router_parse(spark, sf_dir):
    said = (
        "concat('[heading] 3: lost\\n[title] 0: =A: b=\\n[heading] ', doc_id % 9, ': ==x==\\n[heading] q: no\\n[title] 0 =C=\\n[heading] =12=: y\\n [heading] ', doc_id % 4, ': z',"
        " CASE WHEN doc_id % 10 = 0 THEN '\\nno relevant headings' ELSE '' END)"
    )
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{said} AS t")
    return rows.select("doc_id", F.inline(parsers.heading_choices(F.col("t"))))


@query("SELECT doc_id, 'Title: ' || source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN lang ELSE text END AS premise, source || '. ' || text AS dense, source || ' ' || text AS sparse FROM documents")
def document_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    some = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    s, t = F.col("source"), F.col("text")
    return rows.select("doc_id", T.evidence_text(s, some, t).alias("premise"), T.title_text(s, t, ". ").alias("dense"), T.title_text(s, t).alias("sparse"))


@query("SELECT conv_id, turn, 'Answer it.' || chr(10) || 'Q: ' || replace(text, chr(10), ' ') || chr(10) || 'Doc [1] ' || role || ': ' || conv_id || chr(10) || 'A:' AS prompt FROM conversations WHERE text IS NOT NULL")
def prompt_pack(spark, sf_dir):
    pack = prompts.PromptPack("Answer it.", "{INST}\nQ: {Q}\n{D}\nA: {A}", "Doc [{ID}] {T}: {P}")
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    docs = F.array(pack.document(F.col("role"), F.col("conv_id").cast("string"), F.lit(0)))
    return rows.select("conv_id", "turn", pack.shown(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), docs).alias("prompt"))


@query("""WITH d AS (SELECT item_id, i, md5('42:' || item_id || ':' || i) AS h FROM benchmark, range(4) t(i)), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY h, i) AS r FROM d)
  SELECT b.item_id, string_agg('Question: q' || i || chr(10) || 'Answer: a' || i || chr(10) || chr(10), '' ORDER BY r) || 'Question: ' || any_value(text) || chr(10) || 'Answer:' AS prompt
  FROM benchmark b JOIN k ON k.item_id = b.item_id AND r <= 2 GROUP BY b.item_id""")
def few_shot_draw(spark, sf_dir):
    """Prompts with two of four demonstrations, drawn for each item."""
    pack = prompts.PromptPack("", "Question: {Q}\nAnswer: {A}", "", demo_sep="\n\n", demos=[{"question": f"q{i}", "answer": f"a{i}"} for i in range(4)])
    return table(spark, sf_dir, "benchmark").select("item_id", pack.few_shot(F.col("text"), None, 2, key=F.col("item_id"), seed=42).alias("prompt"))


@query("""SELECT source, doc_id, drawn::INTEGER AS drawn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY substr(md5('7:' || source || ':' || doc_id), 1, 15), doc_id) AS drawn FROM documents) WHERE drawn <= 3""")
def seeded_draw(spark, sf_dir):
    """Three documents of each source."""
    return sinks.seeded_draw(table(spark, sf_dir, "documents"), 3, 7, ["doc_id"], group="source").select("source", "doc_id", "drawn")


@query("SELECT sum(n_chars)::BIGINT AS prompt_tokens, sum(doc_id)::BIGINT AS completion_tokens, round(sum(n_chars) / 1000 * 0.03 + sum(doc_id) / 1000 * 0.06, 6) AS usd FROM documents")
def token_cost(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("prompt_tokens"), F.col("doc_id").alias("completion_tokens"))
    return sinks.token_cost(rows, "gpt-4").withColumn("usd", F.round("usd", 6))


@query("SELECT id, list_distinct(golds) IS NOT NULL AS has, length(list_distinct(golds))::INTEGER AS n FROM (SELECT doc_id AS id, [lang, source, lang] AS golds FROM documents)")
def alias_union(spark, sf_dir):
    item = F.array(F.struct(F.array("lang", "source").alias("aliases"), F.col("lang").alias("answer_text")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("question"), item.alias("answer_list"), F.col("text").alias("output"))
    return sinks.final_answers(rows, "qampari").select("id", F.lit(True).alias("has"), F.size(F.col("answers")[0]).alias("n"))


@query("SELECT source AS id, arg_max(doc_id, (n_chars, -doc_id)) AS output FROM documents GROUP BY source")
def best_of_n(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("at"), F.col("n_chars").alias("score"), F.col("doc_id").cast("string").alias("output"))
    return metrics.best_output(rows).select("id", F.col("output").cast("long").alias("output"))


@query(f"""WITH {TURNS}, s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(output, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM turns)
  SELECT conv_id, turn, length(s)::INTEGER AS n, s[1] AS first FROM s""")
def sentence_split(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", "turn", T.sentences(F.col("output")).alias("s"))
    return rows.select("conv_id", "turn", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first"))


@query("""SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''),
  lambda s: '[1][' || (turn % 3 + 2) || '] ' || s), ' ') AS cited FROM (SELECT conv_id, turn, replace(replace(regexp_replace(regexp_replace(text, ' \\[[0-9]+', '', 'g'), '\\[[0-9]+', '', 'g'), ' |', ''), ']', '') AS text FROM conversations WHERE text IS NOT NULL)""")
def force_cite(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", T.force_citations(F.col("text"), F.expr("array(0, cast(turn % 3 + 1 as int))")).alias("cited"))


@query("SELECT doc_id, 'T' || doc_id AS title, source AS url FROM documents")
def hit_fields(spark, sf_dir):
    ids = F.to_json(F.struct(F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("url")))
    return table(spark, sf_dir, "documents").select("doc_id", T.hit_fields(ids).alias("h")).select("doc_id", "h.*")


@query(f"""WITH {TURNS}, r AS (SELECT conv_id, turn, {norm_sql('gold')} AS g, {norm_sql('output')} AS s FROM turns)
  SELECT conv_id, turn, (g = s)::INTEGER::DOUBLE AS em, (g = s)::INTEGER::DOUBLE AS hit FROM r""")
def qa_em_hit(spark, sf_dir):
    pairs = F.array(F.struct(F.array("gold").alias("short_answers")))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", metrics.qa_scores(pairs, F.array("output")).alias("s"))
    return rows.select("conv_id", "turn", "s.em", "s.hit")


class Scripted:
    """Acts by the number in the prompt's first line and by the lines since."""

    def generate(self, prompts: list[str], max_tokens: int) -> list[str]:
        return [self.one(int(p.split("\n")[0]), p.count("\n", 0, p.find("Document [") + 1 or len(p)) - 1, p.endswith("Output:")) for p in prompts]

    @staticmethod
    def one(n: int, s: int, shown: bool) -> str:
        if shown:
            return f" seen {n}-{s}. It is so."
        acts = [
            "Check: [1][9][2]", f"Output: say {n} [2]. Then {s}.", "Check: [2][3][1][2]", f"Output: more {s}", "End" if s > 3 else "Check: [7]",
            "I am sorry, there is no relevant document." if n % 5 == 0 else "???" if n % 7 == 0 else f"Output: last {n}.",
        ]
        return acts[(n + s) % 6] + "\nnot read"


@query("""WITH RECURSIVE c AS (SELECT conv_id AS id, count(*)::INTEGER AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
  st AS (SELECT id, n, 0 AS s, false AS pending, '' AS said, [-1]::INTEGER[] AS shown, NULL::VARCHAR AS ended FROM c
  UNION ALL SELECT id, n, s + 1, kind = 'look', CASE WHEN kind = 'output' THEN said || ' ' || cited ELSE said END,
    CASE WHEN kind = 'look' THEN list_filter(list_transform(regexp_extract_all(act, '\\[(\\d+)', 1), lambda x: x::INTEGER), lambda x: x <= n)[1:3] ELSE shown END,
    CASE WHEN kind NOT IN ('look', 'output') THEN kind WHEN s + 1 >= 6 THEN 'turns' END
  FROM (SELECT *, CASE WHEN shown = [-1] THEN bare ELSE array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(bare, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''),
      lambda x: array_to_string(list_transform(shown, lambda d: '[' || d || ']'), '') || ' ' || x), ' ') || '.' END AS cited
    FROM (SELECT *, trim(replace(replace(regexp_replace(act, ' \\[[0-9]+', '', 'g'), ']', ''), 'Output:', '')) AS bare,
      CASE WHEN act = 'End' THEN 'end' WHEN act LIKE 'I am sorry%' THEN 'abstain' WHEN act LIKE 'Check%' THEN 'look' WHEN act LIKE 'Output%' THEN 'output' ELSE 'unknown' END AS kind
    FROM (SELECT *, CASE WHEN pending THEN 'Output: seen ' || id || '-' || s || '. It is so.' ELSE CASE (id + s) % 6 WHEN 0 THEN 'Check: [1][9][2]' WHEN 1 THEN 'Output: say ' || id || ' [2]. Then ' || s || '.' WHEN 2 THEN 'Check: [2][3][1][2]'
      WHEN 3 THEN 'Output: more ' || s WHEN 4 THEN CASE WHEN s > 3 THEN 'End' ELSE 'Check: [7]' END ELSE CASE WHEN id % 5 = 0 THEN 'I am sorry, there is no relevant document.' WHEN id % 7 = 0 THEN '???' ELSE 'Output: last ' || id || '.' END END END AS act
    FROM st WHERE ended IS NULL))))
  SELECT id AS conv_id, said AS output, s::INTEGER AS turns, ended FROM st WHERE ended IS NOT NULL""")
def turn_conversations(spark, sf_dir):
    """Scripted conversations over each conversation's turns as documents, with the citations of what was shown last."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    docs = rows.select(F.col("conv_id").alias("id"), "turn", F.col("role").alias("title"), "text")
    docs = docs.withColumn("doc", F.row_number().over(Window.partitionBy("id").orderBy("turn")) - 1)
    asked = docs.select("id").distinct().select("id", F.col("id").cast("string").alias("prompt"))
    found = converse_in_turns(asked, docs, Scripted, force="sentences", max_turns=6)
    return found.select(F.col("id").alias("conv_id"), "output", "turns", "ended")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagate_hop1(spark, sf_dir)


