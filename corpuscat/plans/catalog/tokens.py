"""Vocabulary, encodings, length profiles, extractive summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscat.operators import subword, summary, tokens
from corpuscat.plans.catalog.registry import query, words
from corpuscat.session import scratch_path
from corpuscat.sources.tables import table

LENGTH = 512  # fixed value: tokens per text

_VOCAB = f"""each AS (SELECT unnest({words('text')}) AS token FROM documents),
counts AS (SELECT token, count(*) AS n FROM each GROUP BY token),
vocab AS (SELECT token, (row_number() OVER (ORDER BY n DESC, token) + {tokens.FIRST_ID - 1})::BIGINT AS id, n FROM counts)"""


@query("token_vocab", f"WITH {_VOCAB} SELECT token, id, n FROM vocab")
def token_vocab(spark, folder):
    return tokens.vocabulary(table(spark, folder, "documents"), "text")


def _padded(ids: str, length: int) -> str:
    return (
        f"array_to_string(list_concat([{tokens.CLS}], {ids}, [{tokens.SEP}], "
        f"list_transform(range({length - 2} - len({ids})), lambda x: {tokens.PAD})), ' ') AS input_ids, "
        f"array_to_string(list_concat(list_transform(range(len({ids}) + 2), lambda x: 1), "
        f"list_transform(range({length - 2} - len({ids})), lambda x: 0)), ' ') AS attention_mask"
    )


_ENCODE = f"""WITH {_VOCAB}, common AS (SELECT token, id::INTEGER AS id FROM vocab WHERE n >= 2),
lists AS (SELECT doc_id, list_slice({words('text')}, 1, {LENGTH - 2}) AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM lists),
ids AS (SELECT doc_id, list(coalesce(id, {tokens.UNK}) ORDER BY pos) AS l FROM placed p LEFT JOIN common c ON p.token = c.token GROUP BY doc_id),
full_ids AS (SELECT d.doc_id, coalesce(l, []::INTEGER[]) AS l FROM documents d LEFT JOIN ids i ON d.doc_id = i.doc_id)
SELECT doc_id, {_padded('l', LENGTH)} FROM full_ids"""


@query("token_encode", _ENCODE)
def token_encode(spark, folder):
    docs = table(spark, folder, "documents")
    vocab = tokens.vocabulary(docs, "text", min_count=2)
    return _as_text(tokens.encode(docs, "doc_id", "text", vocab, LENGTH))


@query("vocabulary_store", _ENCODE)
def vocabulary_store(spark, folder):
    """The vocabulary with its ids, stored, read back and encoded with."""
    docs, path = table(spark, folder, "documents"), scratch_path(spark, "vocabulary")
    tokens.save_vocabulary(tokens.vocabulary(docs, "text", min_count=2), path)
    return _as_text(tokens.encode(docs, "doc_id", "text", tokens.load_vocabulary(spark, path), LENGTH))


def _as_text(encoded):
    return encoded.select(
        "doc_id",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), " ").alias("attention_mask"),
    )


MIN_COUNT = 5  # occurrences that make a word a piece of its own

# Control characters but for tab and line ends go; punctuation marks and CJK signs are words.
_CONTROL = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}\p{Co}]"
_WORDS = f"regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '{_CONTROL}', '', 'g')), '{subword.WORD}')"

_PIECES = f"""raw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
occurrences AS (SELECT unnest(ws) AS w FROM raw),
counted AS (SELECT w, strip_accents(w) AS bare, count(*) AS n FROM occurrences GROUP BY w),
starts AS (SELECT DISTINCT unnest(string_split(bare, '')) AS t FROM counted UNION SELECT bare FROM counted WHERE n >= {MIN_COUNT}),
both_kinds AS (SELECT t, false AS inner_piece, t AS piece FROM starts WHERE t <> '' UNION ALL SELECT t, true, '##' || t FROM starts WHERE t <> ''),
pieces AS (SELECT t, inner_piece, (row_number() OVER (ORDER BY piece) + {tokens.FIRST_ID - 1})::INTEGER AS id FROM both_kinds)"""


@query(
    "subword_encode",
    f"""WITH RECURSIVE {_PIECES},
steps AS (
  SELECT w, bare, 0 AS done, []::INTEGER[] AS ids FROM counted WHERE length(bare) <= {subword.LONGEST_WORD}
  UNION ALL
  SELECT w, any_value(bare), any_value(done) + max(l), list_append(any_value(ids), arg_max(id, l)) FROM (
    SELECT s.w, s.bare, s.done, s.ids, p.id, r.l
    FROM steps s, (SELECT unnest(range(1, (SELECT max(length(t)) FROM starts) + 1)) AS l) r, pieces p
    WHERE s.done + r.l <= length(s.bare) AND p.t = substr(s.bare, s.done + 1, r.l) AND p.inner_piece = (s.done > 0))
  GROUP BY w),
finished AS (SELECT w, ids FROM steps WHERE done = length(bare)
  UNION ALL SELECT w, [{tokens.UNK}]::INTEGER[] FROM counted WHERE length(bare) > {subword.LONGEST_WORD}),
firsts AS (SELECT doc_id, list_slice(list_filter(ws, lambda w: regexp_matches(w, '[^\\p{{Mn}}]')), 1, {LENGTH - 2}) AS ws FROM raw),
placed AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM firsts),
joined AS (SELECT doc_id, list_slice(flatten(list(ids ORDER BY pos)), 1, {LENGTH - 2}) AS l FROM placed p JOIN finished f ON p.w = f.w GROUP BY doc_id),
full_ids AS (SELECT d.doc_id, coalesce(l, []::INTEGER[]) AS l FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id)
SELECT doc_id, {_padded('l', LENGTH)} FROM full_ids""",
)
def subword_encode(spark, folder):
    """Raw texts with the corpus' own pieces."""
    docs = table(spark, folder, "documents")
    return _as_text(subword.subword_encode(docs, "doc_id", "text", subword.corpus_pieces(docs, "text", MIN_COUNT), LENGTH))


_SUMMARY = f"""sentence_lists AS (SELECT doc_id, list_filter(list_transform(
    regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM documents),
parts AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM sentence_lists),
sentence_words AS (SELECT doc_id, pos, unnest({words('s')}) AS token FROM parts),
word_counts AS (SELECT token, count(*) AS n FROM sentence_words GROUP BY token),
scored AS (SELECT doc_id, pos, sum(n)::DOUBLE / count(*) AS score FROM sentence_words s JOIN word_counts w ON s.token = w.token GROUP BY doc_id, pos),
best AS (SELECT doc_id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM scored) WHERE rn = 1),
summaries AS (SELECT d.doc_id, coalesce(p.s, '') AS summary, b.score FROM documents d
  LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN parts p ON p.doc_id = b.doc_id AND p.pos = b.pos)"""


@query("extractive_summary", f"WITH {_SUMMARY} SELECT doc_id, summary, round(score, 6) AS score FROM summaries")
def extractive_summary(spark, folder):
    out = summary.extractive_summary(table(spark, folder, "documents"), "doc_id", "text")
    return out.select("doc_id", "summary", F.round("score", 6).alias("score"))


def _profile(kind: str, source: str, col: str) -> str:
    return (
        f"SELECT '{kind}' AS kind, count(*) AS n, round(avg(t), 6) AS mean_tokens, quantile_cont(t, 0.25)::DOUBLE AS p25, "
        f"quantile_cont(t, 0.5)::DOUBLE AS p50, quantile_cont(t, 0.75)::DOUBLE AS p75, max(t)::BIGINT AS max_tokens, "
        f"round(avg(CASE WHEN t > {LENGTH - 2} THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS cut_share "
        f"FROM (SELECT len({words(col)}) AS t FROM {source})"
    )


@query(
    "token_length_profile",
    f"WITH {_SUMMARY} {_profile('original', 'documents', 'text')} UNION ALL {_profile('summary', 'summaries', 'summary')}",
)
def token_length_profile(spark, folder):
    docs = table(spark, folder, "documents")
    short = summary.extractive_summary(docs, "doc_id", "text")
    both = [
        tokens.length_profile(df, col, LENGTH).select(F.lit(kind).alias("kind"), "*")
        for kind, df, col in (("original", docs, "text"), ("summary", short, "summary"))
    ]
    out = both[0].unionByName(both[1])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_tokens", "cut_share")})
