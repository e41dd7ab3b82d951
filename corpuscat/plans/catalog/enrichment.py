"""Prompts, replies and stored enrichment, with a deterministic stand-in for the model."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from corpuscat.functions.text import json_field, prompt, words
from corpuscat.operators import bayes, enrich, evaluate, labels, split, summary
from corpuscat.operators.enrich import enrich_missing, enrich_text
from corpuscat.plans.catalog import models
from corpuscat.plans.catalog.registry import query
from corpuscat.plans.catalog.tokens import _SUMMARY
from corpuscat.session import cut_lineage, scratch_path
from corpuscat.sources import stored
from corpuscat.sources.tables import table

TEMPLATE = "Say in one sentence what this text is about:\n\n{text}\n\nAnswer with the sentence only."


def digest_client():
    """Replies with the digest of the whole prompt; refuses one prompt in sixteen."""

    def reply(text: str) -> str:
        digest = hashlib.md5(text.encode()).hexdigest()
        if digest.endswith("0"):
            raise RuntimeError("refused")
        return f" {digest} "

    return reply


def _prompt_sql(col: str) -> str:
    head, tail = TEMPLATE.split("{text}")
    return f"'{head}' || coalesce({col}, '') || '{tail}'"


@query("prompt_column", f"SELECT conv_id, turn, {_prompt_sql('text')} AS prompt FROM conversations")
def prompt_column(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", prompt(TEMPLATE, F.col("text")).alias("prompt"))


def _enriched_sql(text: str) -> str:
    digest = f"md5({_prompt_sql(text)})"
    return (
        f"CASE WHEN {text} IS NULL OR trim({text}) = '' THEN '' WHEN {digest} LIKE '%0' THEN {text} ELSE {digest} END AS output, "
        f"CASE WHEN {text} IS NULL OR trim({text}) = '' THEN 'blank' WHEN {digest} LIKE '%0' THEN 'failed' ELSE 'ok' END AS enrich_status"
    )


@query(
    "enrich_stub",
    f"SELECT conv_id, turn, {_enriched_sql('t')} FROM (SELECT conv_id, turn, CASE role WHEN 'system' THEN '  ' "
    "WHEN 'user' THEN text ELSE CASE WHEN turn > 2 THEN NULL ELSE text END END AS t FROM conversations)",
)
def enrich_stub(spark, folder):
    role, text = F.col("role"), F.col("text")
    some = F.when(role == "system", "  ").when((role == "user") | (F.col("turn") <= 2), text)
    rows = table(spark, folder, "conversations").select("conv_id", "turn", some.alias("t"))
    return enrich_text(rows, "t", TEMPLATE, digest_client).drop("t")


@query("json_response", "SELECT event_id, trim(coalesce(json_extract_string(props, '$.k'), '')) AS response FROM events")
def json_response(spark, folder):
    return table(spark, folder, "events").select("event_id", json_field(F.col("props"), "$.k").alias("response"))


@query(
    "enrich_incremental",
    f"SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run, {_enriched_sql('text')} FROM documents",
)
def enrich_incremental(spark, folder):
    docs = table(spark, folder, "documents")
    path = scratch_path(spark, "enriched")

    def run(number):
        return lambda df: enrich_text(df, "text", TEMPLATE, digest_client).select(
            "doc_id", F.lit(number).alias("run"), "output", "enrich_status"
        )

    enrich_missing(docs.filter("lang = 'en'"), "doc_id", path, run(1))
    return enrich_missing(docs, "doc_id", path, run(2), slices=4)


def busy_client():
    """The digest of the whole prompt; one prompt in four is refused when it is first asked."""
    asked = set()

    def reply(text: str) -> str:
        digest = hashlib.md5(text.encode()).hexdigest()
        if digest[-1] in "0123" and digest not in asked:
            asked.add(digest)
            raise RuntimeError("busy")
        return digest

    return reply


_OWN_DIGEST = f"md5({_prompt_sql('t')})"


@query(
    "enrich_retry",
    f"SELECT doc_id, {_OWN_DIGEST} AS output, CASE WHEN regexp_matches({_OWN_DIGEST}, '[0-3]$') THEN 'retried' ELSE 'ok' END AS enrich_status "
    "FROM (SELECT doc_id, doc_id || ': ' || coalesce(text, '') AS t FROM documents)",
)
def enrich_retry(spark, folder):
    """Calls that are refused once and succeed when asked again; the id makes each prompt its own."""
    own = F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.coalesce("text", F.lit("")))
    docs = table(spark, folder, "documents").select("doc_id", own.alias("t"))
    return enrich_text(docs, "t", TEMPLATE, busy_client, tries=3, pause=0.01).drop("t")


@query("enrich_bucketed", f"SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run, {_enriched_sql('text')} FROM documents")
def enrich_bucketed(spark, folder):
    """The texts of one language, then of all, with input and store bucketed by the id: the second run moves no text to find what is missing."""
    name = f"enriched_{uuid.uuid4().hex}"
    docs = stored.save_bucketed(table(spark, folder, "documents"), f"{name}_in", scratch_path(spark, "bucketed"), "doc_id", 8)
    path = scratch_path(spark, "bucketed")

    def run(number):
        return lambda df: enrich_text(df, "text", TEMPLATE, digest_client).select(
            "doc_id", F.lit(number).alias("run"), "output", "enrich_status"
        )

    enrich.enrich_bucketed(docs.filter("lang = 'en'"), "doc_id", name, path, run(1), 8)
    return enrich.enrich_bucketed(docs, "doc_id", name, path, run(2), 8)


_SHORT = f"(WITH {_SUMMARY} SELECT d.doc_id, s.summary AS text, d.lang FROM documents d JOIN summaries s ON d.doc_id = s.doc_id)"


def _scores_sql(kind: str, source: str) -> str:
    scored = f"{models._bayes('lang', 'test', (1.0,), source)}, {models._SCORES}"
    return f"SELECT '{kind}' AS kind, {models.ROUNDED} FROM ({scored} SELECT * FROM history)"


@query("summary_classify", f"{_scores_sql('full', 'documents')} UNION ALL {_scores_sql('summary', _SHORT)}")
def summary_classify(spark, folder):
    """The summaries' approach: store a summary of each text, classify from it, beside the full texts."""
    docs = table(spark, folder, "documents")
    path = stored.stored_path(scratch_path(spark, "summaries"), "extractive", {"sentences": 1})
    short = stored.materialise(spark, path, lambda: summary.extractive_summary(docs, "doc_id", "text").select("doc_id", "summary"))
    index = cut_lineage(labels.label_index(docs, "lang"))
    out = None
    for kind, rows in (("full", docs.select("doc_id", "lang", "text")), ("summary", docs.select("doc_id", "lang").join(short, "doc_id").withColumnRenamed("summary", "text"))):
        named = cut_lineage(rows.select(F.col("doc_id").alias("row_id"), words(F.col("text")).alias("words"), F.col("lang").alias("category")))
        parts = split.split_64_16_20(labels.attach_label(named, "category", index), "label", "row_id")
        model = bayes.fit_bayes(parts.filter("split = 'train'"), "words", "label")
        tested = bayes.bayes_predict(parts.filter("split = 'test'"), "row_id", "words", "label", model)
        one = models.rounded(evaluate.history(cut_lineage(tested))).drop("candidate").select(F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out
