"""Categories, labels, splits, and the two preparations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscat.functions.category import canonical_category, collapse_category
from corpuscat.operators import labels, split
from corpuscat.operators.frequency import top_values
from corpuscat.plans import prepare
from corpuscat.plans.catalog import registry
from corpuscat.plans.catalog.basics import CANONICAL_CTES, ELEMENT_FLOOR, FLOOR
from corpuscat.plans.catalog.registry import CORPUS, clean, query
from corpuscat.session import cut_lineage
from corpuscat.sources.tables import documents_corpus, table

_TOP_WORDS = (
    "top AS (SELECT split_part(p_name, ' ', -1) AS g, row_number() OVER (ORDER BY count(*) DESC, split_part(p_name, ' ', -1)) AS rk "
    "FROM part GROUP BY 1 ORDER BY rk LIMIT 5)"
)


@query(
    "category_canonical",
    f"WITH {_TOP_WORDS}, names AS (SELECT DISTINCT replace(p_name, ' ', ', ') AS c FROM part), "
    "mapped AS (SELECT c, coalesce(max(CASE WHEN g = c THEN g END), arg_min(g, rk) FILTER (WHERE contains(c, g)), c) AS category "
    "FROM names, top GROUP BY c) "
    "SELECT p_partkey, category FROM part JOIN mapped ON replace(p_name, ' ', ', ') = c",
)
def category_canonical(spark, folder):
    part = table(spark, folder, "part")
    top = top_values(part.select(F.substring_index("p_name", " ", -1).alias("last")), "last", 5)
    combined = F.replace("p_name", F.lit(" "), F.lit(", "))
    return part.select("p_partkey", canonical_category(combined, top).alias("category"))


@query(
    "category_collapse",
    "WITH top AS (SELECT p_name AS g FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 25) "
    "SELECT p_partkey, CASE WHEN p_name IN (SELECT g FROM top) THEN p_name ELSE 'other' END AS category FROM part",
)
def category_collapse(spark, folder):
    part = table(spark, folder, "part")
    top = top_values(part, "p_name", 25)
    return part.select("p_partkey", collapse_category(F.col("p_name"), top).alias("category"))


@query(
    "label_index",
    "SELECT (row_number() OVER (ORDER BY c) - 1)::BIGINT AS label, c AS category, n "
    "FROM (SELECT p_brand || ' ' || p_name AS c, count(*) AS n FROM part GROUP BY 1)",
)
def label_index(spark, folder):
    named = table(spark, folder, "part").select(F.concat("p_brand", F.lit(" "), "p_name").alias("category"))
    return labels.label_index(named, "category")


_LISTS = "lists AS (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part)"


@query(
    "multi_hot",
    f"WITH {_LISTS}, classes AS (SELECT DISTINCT e FROM (SELECT unnest(l) AS e FROM lists)) "
    "SELECT p_partkey, string_agg(CASE WHEN list_contains(l, e) THEN '1' ELSE '0' END, '' ORDER BY e) AS bits "
    "FROM lists, classes GROUP BY p_partkey",
)
def multi_hot_rows(spark, folder):
    rows, n = _positions(spark, folder)
    bits = labels.dense_row(F.col("positions"), F.lit(n))
    return rows.select("p_partkey", F.array_join(bits.cast("array<string>"), "").alias("bits"))


def _positions(spark, folder):
    lists = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("l"))
    index = cut_lineage(labels.element_index(lists, "l"))
    return labels.label_positions(lists, "p_partkey", "l", index), index.count()


@query(
    "multi_hot_sparse",
    f"WITH {_LISTS}, classes AS (SELECT e, (row_number() OVER (ORDER BY e) - 1)::BIGINT AS label "
    "FROM (SELECT DISTINCT unnest(l) AS e FROM lists)), "
    "each AS (SELECT DISTINCT p_partkey, unnest(l) AS e FROM lists) "
    "SELECT p_partkey, string_agg(label::VARCHAR, ' ' ORDER BY label) AS positions, (SELECT count(*) FROM classes) AS n_classes "
    "FROM each JOIN classes USING (e) GROUP BY p_partkey",
)
def multi_hot_sparse(spark, folder):
    rows, n = _positions(spark, folder)
    return rows.select("p_partkey", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), F.lit(n).cast("bigint").alias("n_classes"))


@query(
    "label_from_list",
    f"WITH {_LISTS}, classes AS (SELECT e, (row_number() OVER (ORDER BY e) - 1)::BIGINT AS label "
    "FROM (SELECT DISTINCT unnest(l) AS e FROM lists)) "
    "SELECT p_partkey, e AS category, label FROM lists JOIN classes ON e = list_min(l)",
)
def label_from_list(spark, folder):
    lists = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("l"))
    index = labels.element_index(lists, "l")
    return labels.label_from_list(lists, "l", index).select("p_partkey", "category", "label")


_BY_LANG = "base AS (SELECT doc_id AS row_id, lang AS label FROM documents)"
_BY_PRIORITY = "base AS (SELECT o_orderkey AS row_id, o_orderpriority AS label FROM orders)"


@query("split_64_16_20", f"WITH {_BY_LANG}, {registry.split('base', split.SPLIT_64_16_20)} SELECT row_id, label, split FROM parts")
def split_64_16_20(spark, folder):
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"))
    return split.split_64_16_20(rows, "label", "row_id")


@query("split_80_10_10", f"WITH {_BY_PRIORITY}, {registry.split('base', split.SPLIT_80_10_10)} SELECT row_id, label, split FROM parts")
def split_80_10_10(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"))
    return split.split_80_10_10(rows, "label", "row_id")


@query(
    "split_sizes",
    f"WITH {_BY_PRIORITY}, {registry.split('base', split.SPLIT_64_16_20)} SELECT split, label, count(*) AS n FROM parts GROUP BY ALL",
)
def split_sizes(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"))
    return split.split_sizes(split.split_64_16_20(rows, "label", "row_id"), "label")


_EARLY = "o_orderdate < DATE '1997-01-01'"


@query(
    "split_later",
    f"""WITH base AS (SELECT o_orderkey AS row_id, o_orderpriority AS label FROM orders WHERE {_EARLY}),
late AS (SELECT o_orderkey AS row_id, o_orderpriority AS label FROM orders WHERE NOT ({_EARLY})),
{registry.split('base', split.SPLIT_64_16_20)},
had AS (SELECT label, count(*) AS n, count(*) FILTER (split = 'test') AS t, count(*) FILTER (split = 'val') AS v FROM parts GROUP BY label),
due AS (SELECT l.label, count(*) AS m, coalesce(any_value(n), 0) + count(*) AS total, coalesce(any_value(t), 0) AS t, coalesce(any_value(v), 0) AS v
  FROM late l LEFT JOIN had h ON l.label = h.label GROUP BY l.label),
wanted AS (SELECT label, m, least(m, greatest(0, (total * 2000 + 5000) // 10000 - t)) AS test, (total * 1600 + 5000) // 10000 - v AS val FROM due),
ranked AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) AS rk FROM late)
SELECT row_id, label, split, 1 AS batch FROM parts
UNION ALL SELECT row_id, r.label, CASE WHEN rk <= test THEN 'test' WHEN rk <= test + least(m - test, greatest(0, val)) THEN 'val' ELSE 'train' END, 2
FROM ranked r JOIN wanted w ON r.label = w.label""",
)
def split_later(spark, folder):
    """The orders of the first years, and then those that came later, without touching the first."""
    orders = table(spark, folder, "orders")
    rows = orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"), F.expr(_EARLY).alias("early"))
    first = cut_lineage(split.split_64_16_20(rows.filter("early").drop("early"), "label", "row_id"))
    later, _ = split.split_later(
        rows.filter("not early").drop("early"), split.part_counts(first, "label"), "label", "row_id", split.SPLIT_64_16_20
    )
    return first.withColumn("batch", F.lit(1)).unionByName(later.withColumn("batch", F.lit(2)))


def labelled_corpus(spark, folder, floor=FLOOR, element_floor=ELEMENT_FLOOR):
    """The multi-label preparation with its single label and 64/16/20 parts."""
    prepared = prepare.prepare_canonical(documents_corpus(spark, folder), floor=floor, element_floor=element_floor)
    index = labels.element_index(prepared, "genre_list_filtered")
    labelled = labels.label_from_list(prepared, "genre_list_filtered", index)
    return split.split_64_16_20(labelled, "label", "row_id")


_PREPARED = f"""WITH {CANONICAL_CTES},
classes AS (SELECT e, (row_number() OVER (ORDER BY e) - 1)::BIGINT AS label FROM elements),
base AS (SELECT p.*, c.label, c.e AS category FROM prepared p JOIN classes c ON c.e = list_min(p.kept)),
{registry.split('base', split.SPLIT_64_16_20)}"""


@query(
    "prepare_corpus",
    f"""{_PREPARED}
SELECT b.row_id, b.genre, array_to_string(b.kept, '|') AS genres, b.category, b.label, p.split,
  {clean('b.title')} AS title_clean, {clean('b.plot')} AS plot_clean
FROM base b JOIN parts p ON b.row_id = p.row_id""",
)
def prepare_corpus(spark, folder):
    return labelled_corpus(spark, folder).select(
        "row_id", "genre", F.array_join("genre_list_filtered", "|").alias("genres"), "category", "label", "split", "title_clean", "plot_clean"
    )


@query(
    "prepare_collapsed",
    f"""WITH {CORPUS},
top AS (SELECT genre AS g FROM corpus WHERE genre IS NOT NULL GROUP BY genre ORDER BY count(*) DESC, genre LIMIT 25),
collapsed AS (SELECT * REPLACE (CASE WHEN genre IN (SELECT g FROM top) THEN genre ELSE 'other' END AS genre) FROM corpus),
supported AS (SELECT * FROM collapsed WHERE genre IN (SELECT genre FROM collapsed GROUP BY genre HAVING count(*) > 20)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, release_year, plot ORDER BY row_id) AS rn
  FROM supported WHERE plot IS NOT NULL AND title IS NOT NULL AND release_year IS NOT NULL) WHERE rn = 1),
classes AS (SELECT genre, (row_number() OVER (ORDER BY genre) - 1)::BIGINT AS label FROM (SELECT DISTINCT genre FROM firsts)),
base AS (SELECT f.row_id, f.genre, c.label FROM firsts f JOIN classes c ON f.genre = c.genre),
{registry.split('base', split.SPLIT_80_10_10)}
SELECT b.row_id, b.genre, b.label, p.split FROM base b JOIN parts p ON b.row_id = p.row_id""",
)
def prepare_collapsed(spark, folder):
    prepared = prepare.prepare_collapsed(documents_corpus(spark, folder), floor=20)
    labelled = labels.attach_label(prepared, "genre", labels.label_index(prepared, "genre"))
    return split.split_80_10_10(labelled, "label", "row_id").select("row_id", "genre", "label", "split")


def label_counts(spark, folder, floor=FLOOR, element_floor=ELEMENT_FLOOR):
    """Flagship: rows per part and label of the prepared corpus."""
    return split.split_sizes(labelled_corpus(spark, folder, floor, element_floor), "label")
