"""The registered queries of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from logmill.llm import bpe, conversations, dedup_stream, divergence, fingerprint, html_text, lines, mixing, packing, ppm, quality, simhash, toxicity
from logmill.llm.common import rank_path, remainder_is, table, word_tokenizer_path
from logmill.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=3)


@query
def op2_line_dedup(spark, sf_dir):
    cleaned = lines.delete_repeated_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return cleaned.select(
        "doc_id",
        F.coalesce(
            F.aggregate("deleted_runs", F.lit(0), lambda n, run: n + run["last"] - run["first"] + 1), F.lit(0)
        ).cast("long").alias("deleted_lines"),
        F.size("deleted_runs").cast("long").alias("deleted_runs"),
        F.length(text).cast("long").alias("kept_chars"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )


ORACLES["op2_line_dedup"] = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
numbered AS (
  SELECT doc_id, text, all_lines, unnest(all_lines) AS line, unnest(range(len(all_lines))) AS i FROM docs),
counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM numbered),
summed AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS up_to FROM counted),
wins AS (
  SELECT a.doc_id, a.i AS first, min(b.i) AS last FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND b.i >= a.i AND b.up_to >= a.up_to - a.w + 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i), b.i FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND a.i <= b.i AND a.up_to - a.w <= b.up_to - 50 GROUP BY b.doc_id, b.i),
held AS (
  SELECT w.*, array_to_string(all_lines[first + 1:last + 1], chr(10)) AS content FROM wins w JOIN docs USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS nth FROM held),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM ranked WHERE nth > 1),
marked AS (
  SELECT s.*, g.i IS NOT NULL AS dropped FROM summed s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i),
edges AS (
  SELECT *, dropped AND NOT coalesce(lag(dropped) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM marked),
kept AS (
  SELECT doc_id, count(*) FILTER (dropped) AS deleted_lines, count(*) FILTER (starts) AS deleted_runs,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS text
  FROM edges GROUP BY doc_id)
SELECT doc_id, deleted_lines, deleted_runs, length(text) AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""


@query
def op3_exact_dedup(spark, sf_dir):
    return dedup_stream.exact_duplicates(spark, f"{sf_dir}/documents.parquet")


ORACLES["op3_exact_dedup"] = """
WITH t AS (SELECT doc_id, row_number() OVER () AS place,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST, place DESC) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""


@query
def op4_html_text(spark, sf_dir):
    return html_text.visible_text(table(spark, sf_dir, "pages"))


@query
def op5_fingerprint(spark, sf_dir):
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, toxicity.training_labels(labels))
    scored = toxicity.score_toxicity(docs, model)
    return scored.withColumn("held_out", remainder_is("doc_id", 3, 1))


@query
def op7_ppm(spark, sf_dir):
    scored = ppm.ppm_scores(table(spark, sf_dir, "documents"), remainder_is("doc_id", 7, 2))
    return scored.withColumn("held_out", remainder_is("doc_id", 7, 2))


@query
def op8_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, quality.training_labels(labels))
    scored = quality.score_quality(docs, model)
    return scored.withColumn("held_out", remainder_is("doc_id", 5, 0))


@query
def op9_byte_bpe(spark, sf_dir):
    return bpe.encode_texts(table(spark, sf_dir, "documents"), rank_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op10_mixing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    features = materialize(mixing.featured(docs), "mix-features")
    classifier = mixing.fit_classifier(features, mixing.labelled_domains(docs, labels))
    # languages closer to each other, a quarter of the weight for poor texts
    mixture = mixing.fit_rates(features, classifier, prefer=lambda domain: 1.0 if domain.endswith("-1") else 0.25)
    result = mixing.mixed(features, mixture)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int") - 1
    names = F.array(*[F.lit(d) for d in classifier.domains]) if classifier.domains else F.array().cast("array<string>")
    return result.select(
        "doc_id", "tokens", F.get(names, best).alias("domain"),
        F.array_max("posterior").alias("probability"), "rate", "copies",
    )


@query
def op11_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op11_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
langs AS (
  SELECT lang, count(*) AS v, sum(total)::HUGEINT AS all_n FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term),
cells AS (
  SELECT s.lang, s.source, k.term, k.total, coalesce(c.n, 0) AS n, l.v, l.all_n
  FROM sources s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
shares AS (
  SELECT *, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p,
         1 + 1000000000::HUGEINT * (total + 1) // (all_n + v) AS q FROM cells),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query
def op12_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer_path())


@query
def op13_repair(spark, sf_dir):
    return conversations.damage_and_repair(table(spark, sf_dir, "conversations"))


ORACLES["op13_repair"] = r"""
WITH RECURSIVE keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS kind
  FROM keyed),
hurt AS (
  SELECT conv_id, turn, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy,
         CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM hashed WHERE kind != 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair
  FROM placed),
turns AS (
  SELECT *, blank OR again AS gone, NOT blank AND NOT again AND cut AS truncated FROM judged),
added(a, b, letters, price, lines) AS (VALUES
  (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 3, ['user:']),
  (1, 2, 'I', 3, ['user:']), (2, 3, 'I', 3, ['assistant:']), (3, 2, 'I', 3, ['user:']),
  (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 3, 'II', 6, ['user:', 'assistant:'])),
edits(a, initial, letter, b, price, as_role) AS (VALUES
  (0, NULL, 'D', 0, 4, NULL), (1, NULL, 'D', 1, 4, NULL), (2, NULL, 'D', 2, 4, NULL), (3, NULL, 'D', 3, 4, NULL),
  (0, 's', 'K', 1, 0, NULL), (0, 'u', 'K', 2, 0, NULL), (1, 'u', 'K', 2, 0, NULL), (2, 'a', 'K', 3, 0, NULL), (3, 'u', 'K', 2, 0, NULL),
  (0, NULL, 'R', 2, 3, 'user'), (1, NULL, 'R', 2, 3, 'user'), (2, NULL, 'R', 3, 3, 'assistant'), (3, NULL, 'R', 2, 3, 'user')),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM turns
  UNION ALL
  SELECT t.conv_id, t.i, e.b, min({
    'cost': s.best.cost + n.price + e.price + CASE WHEN t.truncated AND e.letter != 'D' THEN 3 ELSE 0 END,
    'audit': s.best.audit || n.letters || e.letter,
    'lines': s.best.lines || n.lines || CASE WHEN e.letter = 'D' THEN [] ELSE [coalesce(e.as_role, t.role) || ':' || t.text] END})
  FROM steps s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i + 1
  JOIN added n ON n.a = s.state
  JOIN edits e ON e.a = n.b AND (e.letter = 'D' OR NOT t.gone) AND (e.initial IS NULL OR e.initial = t.initial)
  GROUP BY t.conv_id, t.i, e.b),
counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
ends AS (
  SELECT s.conv_id, min({'cost': s.best.cost + n.price, 'audit': s.best.audit || n.letters, 'lines': s.best.lines || n.lines}) AS best
  FROM steps s JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i
  JOIN added n ON n.a = s.state WHERE n.b IN (0, 3) GROUP BY s.conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost,
       coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
