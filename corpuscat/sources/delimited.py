"""Delimited text with quoted multi-line fields."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscat.operators.scale import BROADCAST_BYTES, lookup, row_bytes, total_before
from corpuscat.session import cut_lineage

# The movie-plot corpus, with the stored row index first.
CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("Release Year", T.IntegerType()),
        T.StructField("Title", T.StringType()),
        T.StructField("Origin/Ethnicity", T.StringType()),
        T.StructField("Director", T.StringType()),
        T.StructField("Cast", T.StringType()),
        T.StructField("Genre", T.StringType()),
        T.StructField("Wiki Page", T.StringType()),
        T.StructField("Plot", T.StringType()),
    ]
)
FILE_BYTES = 256 << 20  # of text in one file that a task writes: two blocks of the usual size
_FORM = {"quote": '"', "escape": '"'}
_EXACT = {"multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    row_id: str = "row_id",
    na_values: Sequence[str] = (),
    columns: dict[str, str] | None = None,
    corrupt: str | None = None,
    split: bool = True,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Read files with a header; a doubled quote is a quote, line ends inside quotes stay.

    Columns are found by their header names, whatever their order; ``schema`` names them as
    the header does or as ``columns`` renames them, and a stored row index without a header
    is ``_c0``. Columns beyond the schema are left out. All files must have the first one's
    header. A record with too few or too many fields, or a value not of its type, fails the
    read; with ``corrupt`` it is kept, its text in that column.

    Without ``row_id`` in the schema the rows are numbered in file order, files by path.
    ``na_values`` are strings that mean missing besides the empty one.

    A large file is read by many tasks although its records may span lines: see ``_records``.
    Every quote then counts, so one inside a field without quotes, which the format does not
    allow, joins lines that do not belong together, and the read fails on their fields; such
    files can be read with ``split`` off, each by one task.
    """
    paths = path if isinstance(path, str) else list(path)
    columns = columns or {}
    first = spark.read.options(**_FORM, **_EXACT, header=False).csv(paths).head(1)
    header = [v or "" for v in first[0]] if first else []
    names = [h or f"_c{i}" for i, h in enumerate(header)]
    known = {f.name: f.dataType for f in schema.fields}
    wanted = [n if n in known else columns.get(n, n) for n in names]
    missing = [n for n in known if n not in wanted]
    if first and (missing or len(set(header)) < len(header)):
        raise ValueError(f"the header {header} lacks {missing} or repeats a name")
    found = T.StructType([T.StructField(h, known.get(w, T.StringType())) for h, w in zip(header, wanted)])
    mode = {"mode": "FAILFAST"}
    if corrupt:
        found = T.StructType([*found.fields, T.StructField(corrupt, T.StringType())])
        mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
        wanted = [*wanted, corrupt]
    keep = [*schema.fieldNames(), *([corrupt] if corrupt and first else [])]
    numbered = row_id not in keep
    if not first:
        df = spark.createDataFrame([], schema)
        df = df.withColumn(row_id, F.lit(None).cast("bigint")) if numbered else df
    elif split:
        df = _parsed(_records(spark, paths, max_bytes), header, found, mode, row_id if numbered else None).toDF(*([row_id] if numbered else []), *wanted)
    else:
        df = spark.read.options(**_FORM, **_EXACT, header=True, enforceSchema=False, columnPruning=False, **mode).schema(found).csv(paths).toDF(*wanted)
        df = _numbered(df, row_id) if numbered else df
    df = df.select(*[f"`{c}`" for c in ([row_id] if numbered else []) + keep])
    for f in schema.fields:
        if na_values and isinstance(f.dataType, T.StringType):
            c = F.col(f"`{f.name}`")
            df = df.withColumn(f.name, F.when(~c.isin(*na_values), c))
    for old, new in columns.items():
        df = df.withColumnRenamed(old, new)
    return df


_RECORD, _TAIL, _HEAD = 0, 1, 2  # a whole record, the open end of a block, what an earlier block's record has here


def _records(spark: SparkSession, paths: str | Sequence[str], max_bytes: int) -> DataFrame:
    """``file, block, seq, text``: the records of delimited files, also of those cut into many blocks.

    Files are read as physical lines, which Spark can split anywhere. A line end belongs to a
    record if the number of quotes before it in the file is odd. A first pass counts the
    quotes of each block; their running sum over the blocks of a file says which blocks start
    inside quotes. The second pass walks through each block from there and joins its lines to
    records, numbered by where they start. What a record has in later blocks, at most one
    piece for each block, is put behind its first part afterwards. Rows are not shuffled, but
    for these pieces; without pieces nothing is stored. The list of blocks that start inside quotes is
    broadcast if it is at most ``max_bytes``; else the lines of a block are brought together
    and sorted.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    quotes = F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut_lineage(blocks.withColumn("inside", F.sum("odd").over(before) % 2 == 1).filter("inside").select("file", "block", "inside"))
    size = inside.agg(F.sum(row_bytes(inside))).first()[0]
    if (size or 0) <= max_bytes:
        placed = lines.join(F.broadcast(inside), ["file", "block"], "left")
    else:
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(inside.hint("shuffle_merge"), ["file", "block"], "left")
        placed = placed.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    pieces = placed.select("file", "block", F.coalesce("inside", F.lit(False)).alias("inside"), "line").mapInArrow(_joined, "file string, block bigint, seq bigint, kind int, text string")
    if size is None:  # no block ends within a record
        return pieces.select("file", "block", "seq", "text")
    pieces = cut_lineage(pieces)
    # A block has one piece of an earlier record and one open end at most.
    start = F.col("kind") == _TAIL
    parts = pieces.filter(F.col("kind") != _RECORD).withColumn("record", F.sum(start.cast("int")).over(Window.partitionBy("file").orderBy("block", start)))
    whole = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", start.alias("start"), "text"))).alias("p"), F.min(F.when(start, F.struct("block", "seq"))).alias("at"))
    whole = whole.select("file", "at.block", "at.seq", F.array_join("p.text", "\n").alias("text"))
    return pieces.filter(F.col("kind") == _RECORD).select("file", "block", "seq", "text").unionByName(whole)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order as records; blocks follow each other, each begins as its ``inside`` says."""
    at: tuple | None = None
    open_, kind, seq, held = False, _RECORD, 0, []
    out: list[list] = [[], [], [], [], []]

    def add() -> None:
        nonlocal seq
        text = "\n".join(held)
        if kind != _HEAD and not open_ and text.strip("\r") == "":
            held.clear()
            return  # an empty line is no record
        for column, value in zip(out, (*at, None if kind == _HEAD else seq, _TAIL if open_ and kind == _RECORD else kind, text)):
            column.append(value)
        seq += kind != _HEAD
        held.clear()

    def flush() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["file", "block", "seq", "kind", "text"])
        for c in out:
            c.clear()
        return batch

    for batch in batches:
        counts = pc.count_substring(batch.column(3), '"').to_pylist()
        for file, block, inside, line, quotes in zip(*(c.to_pylist() for c in batch.columns), counts):
            if (file, block) != at:
                if held:
                    add()
                at, open_, kind, seq = (file, block), inside, _HEAD if inside else _RECORD, 0
            held.append(line)
            open_ ^= bool(quotes % 2)
            if not open_:
                add()
                kind = _RECORD
        if out[0]:
            yield flush()
    if held:
        add()
    if out[0]:
        yield flush()


def _parsed(records: DataFrame, header: Sequence[str], found: T.StructType, mode: dict[str, str], row_id: str | None) -> DataFrame:
    """The fields of records, without headers, which must be ``header``; numbered if ``row_id`` is given."""
    options = {**_FORM, **{k: str(v) for k, v in {**_EXACT, **mode}.items()}}
    text = F.regexp_replace("text", "\r$", "")  # of a file with line ends of two characters
    heads = (F.col("block") == 0) & (F.col("seq") == 0)
    if row_id is not None:
        records = cut_lineage(records)
        counted = records.groupBy("file", "block").agg(F.count_if(~heads).alias("n"))
        counted = total_before(counted, [F.col("file"), F.col("block")], "n", "before")
        counted = cut_lineage(counted.select(F.struct("file", "block").alias("place"), F.col("n") + 1, "before").toDF("place", "n", "before"))
        placed = lookup(records.withColumn("place", F.struct("file", "block")), counted, "place", "n")
        number = F.col("before") + F.col("seq") - F.when(F.col("block") == 0, F.lit(1)).otherwise(F.lit(0))
        records = placed.select(number.alias("_number"), "block", "seq", "text")
    ddl = lambda fields: ", ".join(f"`{n}` {t}" for n, t in fields)
    names = F.from_csv(text, ddl((f"h{i}", "string") for i in range(len(header))), {**options, "mode": "FAILFAST"})
    same = F.concat_ws("\x00", *[F.coalesce(names[f"h{i}"], F.lit("")) for i in range(len(header))]) == F.lit("\x00".join(header))
    wrong = F.raise_error(F.concat(F.lit("a file has another header: "), "text")).cast("boolean")
    body = records.filter(F.when(heads, F.when(same, F.lit(False)).otherwise(wrong)).otherwise(F.lit(True)))
    body = body.withColumn("record", F.from_csv(text, ddl((f.name or f"_c{i}", f.dataType.simpleString()) for i, f in enumerate(found.fields)), options))
    # Asked of every record, so that a bad one fails the read whatever columns are used.
    return body.filter(F.col("record").isNotNull()).select(*(["_number"] if row_id is not None else []), "record.*")


def _numbered(df: DataFrame, row_id: str) -> DataFrame:
    """Store the rows and number them in file order, without moving them.

    A file lies in one task, so its rows have consecutive ids; the rows of earlier files
    are counted per file.
    """
    placed = cut_lineage(df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")))
    files = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    files = cut_lineage(total_before(files, [F.col("_file")], "_n", "_before"))
    joined = lookup(placed, files, "_file", "_n")
    return joined.select((F.col("_before") + F.col("_at") - F.col("_first")).alias(row_id), *[f"`{c}`" for c in df.columns])


def write_delimited(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write so that ``read_delimited`` returns the same text; '' is read back as null."""
    df.write.mode(mode).options(
        **_FORM, header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_in_order(df: DataFrame, path: str, order: str, header: Sequence[str] | None = None, file_bytes: int = FILE_BYTES) -> None:
    """``write_delimited`` with rows sorted by ``order`` in files of about ``file_bytes``, in the order of their names.

    A file is written by one task, so what one task takes stays the same however many rows there
    are: up to ``file_bytes`` there is one file, beyond that as many as it takes. Rows of equal
    ``order`` may lie in two files. ``header`` renames the columns in the files.
    """
    size = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    files = -(-size // file_bytes)
    placed = df.repartitionByRange(max(files, 1), F.col(f"`{order}`"), whole).sortWithinPartitions(f"`{order}`", whole)
    write_delimited(placed.toDF(*(header or df.columns)), path)
