"""Profiles, filters, cleaning, frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscat.functions.text import clean_text, slug, split_list
from corpuscat.operators import filters, frequency, profile, profile_store
from corpuscat.operators.scale import spread
from corpuscat.plans.catalog.registry import CORPUS, clean, items, query
from corpuscat.plans.prepare import canonical_stages
from corpuscat.session import scratch_path
from corpuscat.sources.tables import documents_corpus, table

# Floors of the registered preparation; the defaults suit a corpus of millions.
FLOOR, ELEMENT_FLOOR = 5, 10
SUMMED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("profile_shape", "SELECT count(*) AS n_rows, 5 AS n_columns FROM documents")
def profile_shape(spark, folder):
    return profile.shape(table(spark, folder, "documents"))


@query("profile_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def profile_head(spark, folder):
    return profile.head(table(spark, folder, "orders"), "o_orderkey", 5)


@query(
    "profile_types",
    """WITH missing AS (UNPIVOT (
  SELECT count(*) - count(doc_id) AS doc_id, count(*) - count(text) AS text, count(*) - count(lang) AS lang,
    count(*) - count(source) AS source, count(*) - count(n_chars) AS n_chars FROM documents)
  ON COLUMNS(*) INTO NAME c VALUE n_missing)
SELECT c AS "column", CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS type, n_missing
FROM (DESCRIBE documents) JOIN missing ON c = column_name""",
)
def profile_types(spark, folder):
    df = table(spark, folder, "documents")
    return profile.column_types(df).join(profile.missing_counts(df), "column")


_CORPUS_COLUMNS = ("row_id", "release_year", "title", "origin", "director", "cast", "genre", "plot")


@query(
    "profile_nulls",
    f"WITH {CORPUS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count(\"{c}\") AS n_missing FROM corpus" for c in _CORPUS_COLUMNS
    ),
)
def profile_nulls(spark, folder):
    return profile.missing_counts(documents_corpus(spark, folder))


@query(
    "profile_numeric",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std, "
        f"min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 7) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 7) AS p50, "
        f"round(quantile_cont({c}::DOUBLE, 0.75), 7) AS p75, max({c})::DOUBLE AS max FROM lineitem"
        for c in SUMMED
    ),
)
def profile_numeric(spark, folder):
    out = profile.numeric_summary(table(spark, folder, "lineitem"))
    return out.select("column", "n", *[F.round(c, 7).alias(c) if c not in ("min", "max") else c for c in out.columns[2:]])


_ORDERED = ("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "profile_stored",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, "
        f"round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, max({c})::DOUBLE AS max FROM orders"
        for c in _ORDERED
    ),
)
def profile_stored(spark, folder):
    """The profile of the first years' orders is kept; that of all orders reads only the files that came later for its bounds."""
    orders, source, store = table(spark, folder, "orders"), scratch_path(spark, "orders"), scratch_path(spark, "profile")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")

    def read(files):
        return spark.read.schema(orders.schema).parquet(*files)

    orders.filter(early).write.parquet(source)
    profile_store.update_profile(spark, spark.read.parquet(source).inputFiles(), read, store)
    orders.filter(~early).write.mode("append").parquet(source)
    out = profile_store.stored_numeric_summary(spark, spark.read.parquet(source).inputFiles(), read, store)
    return out.select("column", "n", *[F.round(c, 6).alias(c) if c not in ("min", "max") else c for c in out.columns[2:]])


CANONICAL_CTES = f"""{CORPUS},
top AS (SELECT genre AS g, row_number() OVER (ORDER BY count(*) DESC, genre) AS rk FROM corpus
  WHERE genre IS NOT NULL GROUP BY genre ORDER BY rk LIMIT 25),
raw_genres AS (SELECT DISTINCT genre FROM corpus WHERE genre IS NOT NULL),
mapped AS (SELECT r.genre, coalesce(
    max(CASE WHEN t.g = r.genre THEN t.g END),
    arg_min(t.g, t.rk) FILTER (WHERE contains(r.genre, t.g)), r.genre) AS to_genre
  FROM raw_genres r, top t GROUP BY r.genre),
canonical AS (SELECT c.* REPLACE (m.to_genre AS genre) FROM corpus c JOIN mapped m ON c.genre = m.genre),
supported AS (SELECT * FROM canonical WHERE genre IN (SELECT genre FROM canonical GROUP BY genre HAVING count(*) > {FLOOR})),
keyed AS (SELECT * REPLACE (coalesce(plot, '') AS plot) FROM supported
  WHERE title IS NOT NULL AND release_year IS NOT NULL AND origin IS NOT NULL),
firsts AS (SELECT *, {items('genre')} AS genre_list FROM (
  SELECT *, row_number() OVER (PARTITION BY title, release_year, plot ORDER BY row_id) AS rn FROM keyed) WHERE rn = 1),
elements AS (SELECT e, count(*) AS n FROM (SELECT unnest(genre_list) AS e FROM firsts) GROUP BY e HAVING count(*) >= {ELEMENT_FLOOR}),
prepared AS (SELECT * FROM (SELECT f.*, list_filter(genre_list, lambda w: list_contains(es, w)) AS kept
    FROM firsts f, (SELECT list(e) AS es FROM elements))
  WHERE len(kept) > 0)"""


@query(
    "stage_counts",
    f"WITH {CANONICAL_CTES} SELECT 'raw' AS stage, count(*) AS n FROM corpus "
    "UNION ALL SELECT 'supported', count(*) FROM supported UNION ALL SELECT 'keyed', count(*) FROM keyed "
    "UNION ALL SELECT 'distinct', count(*) FROM firsts UNION ALL SELECT 'prepared', count(*) FROM prepared",
)
def stage_counts(spark, folder):
    return profile.stage_counts(canonical_stages(documents_corpus(spark, folder), floor=FLOOR, element_floor=ELEMENT_FLOOR))


@query("filter_not_sentinel", f"WITH {CORPUS} SELECT row_id, genre FROM corpus WHERE genre IS DISTINCT FROM 'unknown'")
def filter_not_sentinel(spark, folder):
    return filters.exclude_value(documents_corpus(spark, folder), "genre", "unknown").select("row_id", "genre")


@query("filter_present", f"WITH {CORPUS} SELECT row_id, \"cast\" FROM corpus WHERE \"cast\" IS NOT NULL AND \"cast\" <> ' '")
def filter_present(spark, folder):
    return filters.keep_present(documents_corpus(spark, folder), "cast").select("row_id", "cast")


@query(
    "drop_missing_keys",
    f"WITH {CORPUS} SELECT row_id, origin, director FROM corpus WHERE origin IS NOT NULL AND director IS NOT NULL AND plot IS NOT NULL",
)
def drop_missing_keys(spark, folder):
    return filters.drop_missing(documents_corpus(spark, folder), ["origin", "director", "plot"]).select("row_id", "origin", "director")


@query(
    "fill_defaults",
    f"WITH {CORPUS} SELECT row_id, coalesce(director, 'Unknown') AS director, coalesce(\"cast\", 'Unknown') AS \"cast\", "
    "coalesce(genre, 'unknown') AS genre, coalesce(plot, '') AS plot FROM corpus",
)
def fill_defaults(spark, folder):
    filled = filters.fill_defaults(
        documents_corpus(spark, folder), {"director": "Unknown", "cast": "Unknown", "genre": "unknown", "plot": ""}
    )
    return filled.select("row_id", "director", "cast", "genre", "plot")


@query("clean_text", f"SELECT doc_id, {clean('text')} AS cleaned FROM documents")
def clean_documents(spark, folder):
    return spread(table(spark, folder, "documents")).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query("category_list", f"WITH {CORPUS} SELECT row_id, array_to_string({items('genre')}, '|') AS genre_list FROM corpus")
def category_list(spark, folder):
    return documents_corpus(spark, folder).select("row_id", F.array_join(split_list(F.col("genre")), "|").alias("genre_list"))


@query(
    "slug",
    "SELECT c_custkey, regexp_replace(regexp_replace(c_name || '/' || c_mktsegment || '.', '[^0-9a-zA-Z_-]+', '_', 'g'), "
    "'^_+|_+$', '', 'g') || '.png' AS file_name FROM customer",
)
def slugs(spark, folder):
    title = F.concat("c_name", F.lit("/"), "c_mktsegment", F.lit("."))
    return table(spark, folder, "customer").select("c_custkey", slug(title).alias("file_name"))


@query(
    "dedup_keep_first",
    "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
)
def dedup_keep_first(spark, folder):
    return filters.keep_first(table(spark, folder, "documents"), ["text"], "doc_id").select("doc_id", "lang", "source")


def _top(source: str, col: str, n: int) -> str:
    return f"SELECT {col} AS value, count(*) AS n FROM {source} AND {col} IS NOT NULL GROUP BY {col} ORDER BY n DESC, value LIMIT {n}"


_CHARTS = {
    "top_by_origin": ("corpus WHERE true", "origin", 15),
    "top_titles": ("corpus WHERE true", "title", 15),
    "top_genres_known": ("corpus WHERE genre IS DISTINCT FROM 'unknown'", "genre", 15),
    "top_cast": ("corpus WHERE \"cast\" <> ' '", '"cast"', 20),
    "top_directors": ("corpus WHERE director IS DISTINCT FROM 'Unknown'", "director", 20),
}


def _chart_rows(corpus, name):
    if name == "top_genres_known":
        return filters.exclude_value(corpus, "genre", "unknown"), "genre", 15
    if name == "top_cast":
        return filters.keep_present(corpus, "cast"), "cast", 20
    if name == "top_directors":
        return filters.exclude_value(corpus, "director", "Unknown"), "director", 20
    return corpus, name.removeprefix("top_by_").removeprefix("top_").removesuffix("s"), 15


def _register_top(name: str) -> None:
    @query(name, f"WITH {CORPUS} {_top(*_CHARTS[name])}")
    def top(spark, folder):
        return frequency.value_counts(*_chart_rows(documents_corpus(spark, folder), name))


for _name in _CHARTS:
    _register_top(_name)


@query("value_counts_topn", _top("part WHERE true", "p_name", 15))
def value_counts_topn(spark, folder):
    return frequency.value_counts(table(spark, folder, "part"), "p_name", 15)


@query("year_series", "SELECT year(o_orderdate)::INTEGER AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def year_series(spark, folder):
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"))
    return frequency.key_counts(years, "year")


@query("top_categories", _top("part WHERE true", "p_brand || ' ' || p_name", 25))
def top_categories(spark, folder):
    named = table(spark, folder, "part").select(F.concat("p_brand", F.lit(" "), "p_name").alias("category"))
    return frequency.value_counts(named, "category", 25)


@query(
    "min_support_filter",
    "SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 30)",
)
def min_support_filter(spark, folder):
    return frequency.keep_supported(table(spark, folder, "part"), "p_name", 30).select("p_partkey", "p_name")


@query(
    "array_support_filter",
    "WITH lists AS (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part), "
    "common AS (SELECT e FROM (SELECT unnest(l) AS e FROM lists) GROUP BY e HAVING count(*) >= 250) "
    "SELECT p_partkey, array_to_string(kept, '|') AS kept FROM ("
    "SELECT p_partkey, list_filter(l, lambda w: list_contains(es, w)) AS kept FROM lists, (SELECT list(e) AS es FROM common)) WHERE len(kept) > 0",
)
def array_support_filter(spark, folder):
    lists = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("l"))
    kept = frequency.keep_supported_elements(lists, "p_partkey", "l", 250, "kept")
    return kept.select("p_partkey", F.array_join("kept", "|").alias("kept"))


@query(
    "repeat_report",
    f"WITH {CORPUS}, counts AS (SELECT title, count(*) AS n FROM corpus GROUP BY title) "
    "SELECT count(*) AS n_values, count(*) FILTER (WHERE n = 1) AS n_singletons, "
    "count(*) FILTER (WHERE n >= 5) AS n_repeated, max(n) AS max_n FROM counts",
)
def repeat_report(spark, folder):
    return frequency.repeat_report(documents_corpus(spark, folder), "title", 5)


def _series(name: str) -> str:
    return (
        f"SELECT '{name}' AS chart, row_number() OVER (ORDER BY n DESC, value)::INTEGER AS rank, value AS x, n AS y "
        f"FROM ({_top(*_CHARTS[name])})"
    )


@query(
    "chart_series",
    f"WITH {CORPUS} "
    + " UNION ALL ".join(_series(n) for n in _CHARTS)
    + " UNION ALL SELECT 'year_series', row_number() OVER (ORDER BY y)::INTEGER, y::VARCHAR, n "
    "FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)",
)
def chart_series(spark, folder):
    known = F.col("genre").isNull() | (F.col("genre") != "unknown")
    named = F.col("director").isNull() | (F.col("director") != "Unknown")
    bars = {
        "top_by_origin": (F.col("origin"), 15),
        "top_titles": (F.col("title"), 15),
        "top_genres_known": (F.when(known, F.col("genre")), 15),
        "top_cast": (F.when(F.col("cast") != " ", F.col("cast")), 20),
        "top_directors": (F.when(named, F.col("director")), 20),
    }
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"))
    charts = {"bars": frequency.top_charts(documents_corpus(spark, folder), bars), "year_series": frequency.key_series(years, "year", "year_series")}
    return frequency.chart_series(charts)


@query("top_texts", _top("documents WHERE true", "text", 20))
def top_texts(spark, folder):
    """The texts that occur most often; almost all occur once and are never shuffled."""
    return frequency.top_of_rare(table(spark, folder, "documents"), "text", 20)
