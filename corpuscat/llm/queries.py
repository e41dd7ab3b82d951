"""Registered queries of the training-data operators, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscat.llm import codebooks, divergence, exact, html, language, mixing, near, neighbours, pieces, preference, private, tokens, vectors
from corpuscat.sources.tables import table

MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    """Where the public tokenizer file is, on the driver as on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), model_path())


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_text(table(spark, folder, "pages"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact.mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.fit_on(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_vector_links(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.link_vectors(table(spark, folder, "embeddings"))


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_decode(table(spark, folder, "documents"), model_path())


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_classes(table(spark, folder, "documents"))


def op8_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return private.cover_documents(table(spark, folder, "documents"), b"a placeholder for the caller's secret")


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    chosen = mixing.choose_copies(table(spark, folder, "documents"))
    return chosen.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_preference(spark: SparkSession, folder: str) -> DataFrame:
    return preference.preference_pairs(*preference.answers_exchanged(table(spark, folder, "conversations")))


OP10_SQL = r"""
WITH said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT c, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn DESC NULLS LAST, text DESC) AS r FROM said WHERE role = 'assistant') WHERE r = 1),
made AS (SELECT c AS pair_id, 2 * c AS c, true AS chosen, turn, role, text FROM said
  UNION ALL SELECT s.c, 2 * s.c + 1, false, s.turn, s.role,
    CASE WHEN s.role = 'assistant' AND s.turn IS NOT DISTINCT FROM l.turn AND s.text = l.text THEN coalesce(o.text, '') ELSE s.text END
  FROM said s LEFT JOIN last l ON l.c = s.c LEFT JOIN last o ON o.c = s.c + 1 - 2 * (s.c % 2)),
t AS (SELECT c, pair_id, chosen, role, text, row_number() OVER (PARTITION BY c ORDER BY turn, role, text) AS pos FROM made),
ids AS (SELECT pair_id, min(c) FILTER (chosen) AS chosen_id, min(c) FILTER (NOT chosen) AS rejected_id FROM t GROUP BY pair_id),
facing AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
    coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM t WHERE chosen) a FULL JOIN (SELECT * FROM t WHERE NOT chosen) b ON a.pair_id = b.pair_id AND a.pos = b.pos),
n AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS n FROM facing GROUP BY pair_id),
shown AS (
  SELECT t.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s
  FROM t JOIN n ON t.pair_id = n.pair_id),
placed AS (
  SELECT *, sum(length(s)) OVER (PARTITION BY c, pos > n ORDER BY pos) AS upto FROM shown)
SELECT i.pair_id, chosen_id, rejected_id, n.n::INT AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (chosen AND pos <= p.n), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (chosen AND pos > p.n), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY pos) FILTER (NOT chosen AND pos > p.n), '') AS rejected,
  coalesce(flatten(list([(upto - length(s) + 5 + length(role))::BIGINT, upto::BIGINT] ORDER BY pos)
    FILTER (chosen AND pos > p.n AND role = 'assistant')), []::BIGINT[]) AS chosen_spans,
  coalesce(flatten(list([(upto - length(s) + 5 + length(role))::BIGINT, upto::BIGINT] ORDER BY pos)
    FILTER (NOT chosen AND pos > p.n AND role = 'assistant')), []::BIGINT[]) AS rejected_spans
FROM ids i JOIN n ON i.pair_id = n.pair_id JOIN placed p ON p.pair_id = i.pair_id
GROUP BY i.pair_id, chosen_id, rejected_id, n.n"""

def op11_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


OP11_SQL = """
WITH ok AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


OP12_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
each AS (SELECT r, lang, source, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM each GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT l.lang, count(term) AS v, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM texts) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
counts AS (SELECT e.lang, e.source, e.term, count(*) AS n FROM each e JOIN kept k ON k.lang = e.lang AND k.term = e.term GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM texts) g
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v))::BIGINT AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


def op13_codebooks(spark: SparkSession, folder: str) -> DataFrame:
    coded = codebooks.with_label_error(codebooks.compress(table(spark, folder, "embeddings")))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op13_sql(parts: int = codebooks.PARTS, entries: int = codebooks.ENTRIES, rounds: int = codebooks.ROUNDS) -> str:
    """Each round as two steps: all pieces against all entries, and the floors of the means."""
    steps = ""
    for r in range(rounds + 1):
        steps += f"""
near{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
  SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM pieces p JOIN book{r} b ON b.part = p.part) GROUP BY vec_id, part),"""
        if r < rounds:
            steps += f"""
book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM book{r} b LEFT JOIN (
  SELECT part, entry, list(m ORDER BY pos) AS x FROM (
    SELECT part, entry, pos, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM (SELECT p.part, n.entry, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS pos FROM pieces p JOIN near{r} n ON n.vec_id = p.vec_id AND n.part = p.part)
    GROUP BY part, entry, pos) GROUP BY part, entry) n ON n.part = b.part AND n.entry = b.entry),"""
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS part)),
book0 AS MATERIALIZED (SELECT part, entry, x FROM pieces JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)),{steps}
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM book{rounds}),
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id, digest"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_main_text, op3_exact_dedup, op4_language, op5_vector_links, op6_pieces, op7_near_dedup, op8_pseudonyms,
        op9_mix_sources, op10_preference, op11_nearest, op12_source_divergence, op13_codebooks,
    )
}
ORACLES: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL, "op10_preference": OP10_SQL, "op11_nearest": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_codebooks": _op13_sql(),
}
