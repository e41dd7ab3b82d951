"""Corpus preparation: the two published orders of steps.

The order matters: top categories come from the raw column, support is counted before
rows without keys and copies go, and element support after that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscat.functions.category import canonical_category, collapse_category
from corpuscat.functions.text import clean_text, split_list
from corpuscat.operators.filters import drop_missing, fill_defaults, keep_first
from corpuscat.operators.frequency import keep_supported, keep_supported_elements, top_values
from corpuscat.session import cut_lineage


@dataclass(frozen=True)
class CorpusColumns:
    row_id: str = "row_id"
    year: str = "release_year"
    title: str = "title"
    origin: str = "origin"
    director: str = "director"
    cast: str = "cast"
    genre: str = "genre"
    plot: str = "plot"


# Size of the top list, support floors, defaults for missing text.
TOP_CATEGORIES, CATEGORY_FLOOR, ELEMENT_FLOOR = 25, 50, 10
UNKNOWN_PERSON, UNKNOWN_GENRE = "Unknown", "unknown"


def canonical_stages(
    df: DataFrame,
    cols: CorpusColumns = CorpusColumns(),
    top_n: int = TOP_CATEGORIES,
    floor: int = CATEGORY_FLOOR,
    element_floor: int = ELEMENT_FLOOR,
    drop_values: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Every stage of the multi-label preparation, by name; the last is ``prepared``.

    ``drop_values`` removes genres such as ``unknown`` at the start; none by default.
    """
    genre = F.col(cols.genre)
    raw = df.filter(genre.isNull() | ~genre.isin(*drop_values)) if drop_values else df
    top = top_values(raw, cols.genre, top_n)
    mapped = raw.withColumn(cols.genre, canonical_category(genre, top)) if top else raw
    supported = keep_supported(mapped, cols.genre, floor)
    filled = fill_defaults(
        supported,
        {cols.director: UNKNOWN_PERSON, cols.cast: UNKNOWN_PERSON, cols.genre: UNKNOWN_GENRE, cols.plot: ""},
    )
    keyed = drop_missing(filled, [cols.title, cols.year, cols.origin])
    first = keep_first(keyed, [cols.title, cols.year, cols.plot], cols.row_id)
    cleaned = first.withColumns(
        {
            "plot_clean": clean_text(F.col(cols.plot)),
            "title_clean": clean_text(F.col(cols.title)),
            "genre_list": split_list(genre),
        }
    )
    # Stored here: element support, labels, split and counts all read it again.
    cleaned = cut_lineage(cleaned)
    prepared = keep_supported_elements(cleaned, cols.row_id, "genre_list", element_floor, "genre_list_filtered")
    return {"raw": df, "supported": supported, "keyed": keyed, "distinct": cleaned, "prepared": prepared}


def prepare_canonical(df: DataFrame, **options) -> DataFrame:
    return canonical_stages(df, **options)["prepared"]


def prepare_collapsed(
    df: DataFrame, cols: CorpusColumns = CorpusColumns(), top_n: int = TOP_CATEGORIES, floor: int = CATEGORY_FLOOR
) -> DataFrame:
    """The single-label preparation: rare genres become ``other``, rows without plot go."""
    top = top_values(df, cols.genre, top_n)
    collapsed = df.withColumn(cols.genre, collapse_category(F.col(cols.genre), top))
    supported = keep_supported(collapsed, cols.genre, floor)
    keyed = drop_missing(supported, [cols.title, cols.year, cols.plot])
    return cut_lineage(keep_first(keyed, [cols.title, cols.year, cols.plot], cols.row_id))
