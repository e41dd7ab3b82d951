import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscat.plans.prepare import CorpusColumns, canonical_stages, prepare_collapsed
from corpuscat.session import shared_dir
from corpuscat.sources import delimited, stored

TEXT = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("Plot", T.StringType())])
PLAIN = T.StructType([T.StructField("Title", T.StringType()), T.StructField("Plot", T.StringType())])


def test_round_trip(spark, tmp_path):
    plots = ['say ""hi""', 'a "b", c', "one\r\ntwo\nthree", "ends with \\", "  led", "trail ", " ", "é,;"]
    df = spark.createDataFrame(list(enumerate(plots)) + [(90, None), (91, "")], TEXT)
    path = str(tmp_path / "csv")
    delimited.write_delimited(df, path)
    got = {r["row_id"]: r["Plot"] for r in delimited.read_delimited(spark, path, TEXT).collect()}
    assert [got[i] for i in range(len(plots))] == plots
    assert got[90] is None and got[91] is None


def test_file_order_and_missing_marks(spark, tmp_path):
    (tmp_path / "b.csv").write_text('Title,Plot\nthird,"x\ny"\nfourth,NA\n')
    (tmp_path / "a.csv").write_text('Title,Plot\nfirst,"said ""no"""\nsecond,null\n')
    df = delimited.read_delimited(spark, str(tmp_path), PLAIN, na_values=["NA"], columns={"Title": "title"})
    rows = df.orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [(0, "first", 'said "no"'), (1, "second", "null"), (2, "third", "x\ny"), (3, "fourth", None)]


def test_columns_come_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Plot,Extra,Title\np1,x,t1\n")
    assert [tuple(r) for r in delimited.read_delimited(spark, str(tmp_path), PLAIN).collect()] == [(0, "t1", "p1")]
    (tmp_path / "b.csv").write_text("Title,Plot,Extra\nt2,p2,x\n")
    with pytest.raises(Exception, match="(?i)header"):
        delimited.read_delimited(spark, str(tmp_path), PLAIN).collect()
    with pytest.raises(ValueError, match="Genre"):
        delimited.read_delimited(spark, str(tmp_path / "a.csv"), T.StructType([*PLAIN.fields, T.StructField("Genre", T.StringType())]))


@pytest.mark.parametrize("record", ["t1,p1,third", "t1", 't1,"open'])
def test_bad_records_fail_or_are_kept(spark, tmp_path, record):
    path = tmp_path / "bad.csv"
    path.write_text(f"Title,Plot\nt0,p0\n{record}\n")
    ids = T.StructType(PLAIN.fields)
    if "open" not in record:
        with pytest.raises(Exception, match="(?i)malformed"):
            delimited.read_delimited(spark, str(path), ids, row_id="Title").count()
    kept = delimited.read_delimited(spark, str(path), ids, row_id="Title", corrupt="bad").collect()
    assert len(kept) == 2 and kept[0]["bad"] is None
    assert "open" in record or kept[1]["bad"] is not None


@pytest.fixture
def small_splits(spark):
    """Files are cut into blocks of some bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "83", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits, end, max_bytes):
    """Records that span lines, blocks and many blocks; same rows, values and numbers as one task gives."""
    rng = random.Random(7)
    want = []
    for name in ("a.csv", "b.csv"):
        lines = [f"Title,Plot{end}"]
        for i in range(60):
            plot = "".join(rng.choice(["x", "y z", '"', ",", "\n", "\r\n", "é", "\n\n"]) for _ in range(rng.choice([0, 1, 4, 12, 150])))
            want.append((f"{name}{i}", plot or None))
            lines.append(f'{name}{i},"{plot.replace(chr(34), chr(34) * 2)}"{end}' + (end if i % 9 == 0 else ""))
        (tmp_path / name).write_text("".join(lines), newline="")
    df = delimited.read_delimited(spark, str(tmp_path), PLAIN, max_bytes=max_bytes)
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(i, *r) for i, r in enumerate(want)]
    lines = delimited._records(spark, str(tmp_path / "a.csv"), max_bytes)
    assert lines.select("block").distinct().count() > 20


def test_bad_record_in_many_blocks(spark, tmp_path, small_splits):
    good = "".join(f't{i},"p\n{i}"\n' for i in range(40))
    (tmp_path / "bad.csv").write_text(f"Title,Plot\n{good}t,p,third\n{good}")
    with pytest.raises(Exception, match="(?i)malformed"):
        delimited.read_delimited(spark, str(tmp_path), PLAIN).count()
    kept = delimited.read_delimited(spark, str(tmp_path), PLAIN, corrupt="bad")
    assert kept.count() == 81 and [r["row_id"] for r in kept.filter("bad is not null").collect()] == [40]
    (tmp_path / "other.csv").write_text("Title,Other\nt,p\n")
    with pytest.raises(Exception, match="(?i)header"):
        delimited.read_delimited(spark, str(tmp_path), PLAIN, corrupt="bad").count()


def test_quotes_in_bare_fields_need_whole_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title,Plot\n5" disk,p\nt,"q\nr"\n')
    rows = delimited.read_delimited(spark, str(tmp_path), PLAIN, split=False).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [(0, '5" disk', "p"), (1, "t", "q\nr")]
    with pytest.raises(Exception, match="(?i)malformed"):
        delimited.read_delimited(spark, str(tmp_path), PLAIN).count()


def test_corpus_layout(spark, tmp_path):
    """The column layout of the corpus: an index without a name, quotes, line ends in fields."""
    names = delimited.CORPUS_SCHEMA.fieldNames()
    path = tmp_path / "corpus.csv"
    path.write_text(",".join(["", *names[1:]]) + '\n0,1901,"One, two",American,Unknown,,unknown,http://x,"said ""no""\r\nand left"\n7,1902,T,American,"A, B", ,drama,,p\n', newline="")
    df = delimited.read_delimited(spark, str(path), delimited.CORPUS_SCHEMA, columns={"_c0": "row_id"})
    assert df.columns == names and df.schema["Release Year"].dataType == T.IntegerType()
    a, b = df.orderBy("row_id").collect()
    assert a["Title"] == "One, two" and a["Cast"] is None and a["Plot"] == 'said "no"\r\nand left'
    assert b["row_id"] == 7 and b["Cast"] == " " and b["Director"] == "A, B"


def test_materialise_builds_once(spark, tmp_path):
    path = stored.stored_path(str(tmp_path), "t", {"floor": 3})
    assert path != stored.stored_path(str(tmp_path), "t", {"floor": 4})
    assert stored.materialise(spark, path, lambda: spark.range(3)).count() == 3
    assert stored.materialise(spark, path, lambda: pytest.fail("built twice")).count() == 3


def test_changed_input_meets_no_old_result(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "cache")

    def kept():
        df = spark.read.parquet(source)
        return stored.materialise(spark, stored.stored_path(root, "n", {"k": 1}, [df]), lambda: df.groupBy().count()).first()[0]

    spark.range(10).write.parquet(source)
    assert kept() == kept() == 10
    spark.range(5).write.mode("append").parquet(source)
    assert kept() == 15
    spark.range(7).write.mode("overwrite").parquet(source)
    assert kept() == 7 and len(list((tmp_path / "cache").iterdir())) == 3


def test_two_builders_at_once(spark, tmp_path):
    """Whoever renames first is kept; no part of another's table is seen or left."""
    path = str(tmp_path / "t")

    def slow():
        assert stored.materialise(spark, path, lambda: spark.range(3)).count() == 3
        return spark.range(5)

    assert stored.materialise(spark, path, slow).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_report(spark, tmp_path):
    metrics = spark.createDataFrame([(0.5, 0.25)], "accuracy double, macro_f1 double")
    r = stored.save_report(metrics, {"model_name": "m", "max_length": 512}, str(tmp_path / "r")).first()
    assert (r["model_name"], r["max_length"], r["test_metrics"]["macro_f1"]) == ("m", 512, 0.25)


def session_with(folder, master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=context)


def test_shared_dir_comes_from_the_session():
    assert shared_dir(session_with("hdfs://x/shared", "yarn")) == "hdfs://x/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session_with(None, "yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session_with(None, "local-cluster[3,2,1024]"))


def corpus(spark):
    rows = []
    for i in range(60):
        rows.append((i, 1950 + i % 7, f"t{i}", "X", None, None, "drama" if i % 2 else "comedy, drama", f"Plot {i}!"))
    rows += [
        (60, 1950, "t0", "X", "D", "C", "drama", "Plot 0!"),
        (61, None, "no year", "X", "D", "C", "drama", "p"),
        (62, 1950, "no plot", "X", "D", "C", "melodrama", None),
        (63, 1950, "rare", "X", "D", "C", "noir", "p"),
        (64, 1950, "null genre", "X", "D", "C", None, "p"),
    ]
    names = "row_id int, release_year int, title string, origin string, director string, cast string, genre string, plot string"
    return spark.createDataFrame(rows, names)


def test_canonical_preparation(spark):
    stages = canonical_stages(corpus(spark), CorpusColumns(), top_n=2, floor=5, element_floor=10)
    n = {k: df.count() for k, df in stages.items()}
    assert n == {"raw": 65, "supported": 63, "keyed": 62, "distinct": 61, "prepared": 61}
    rows = {r["row_id"]: r for r in stages["prepared"].collect()}
    assert rows[0]["genre_list_filtered"] == ["comedy", "drama"] and rows[1]["genre_list"] == ["drama"]
    assert rows[62]["genre"] == "drama" and rows[62]["plot_clean"] == "" and rows[0]["plot_clean"] == "plot 0"
    assert rows[0]["director"] == "Unknown" and 60 not in rows
    dropped = canonical_stages(corpus(spark), floor=5, drop_values=("noir",))["raw"]
    assert dropped.count() == 65


def test_collapsed_preparation(spark):
    out = prepare_collapsed(corpus(spark), top_n=2, floor=2)
    assert {r["genre"] for r in out.collect()} == {"drama", "comedy, drama", "other"}
    assert out.filter("plot is null or release_year is null").count() == 0


def test_a_long_file_goes_on_in_the_next(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") * 7 % 3000).alias("k"), F.concat(F.lit('a "b"\n'), F.col("id").cast("string")).alias("t")).repartition(5)
    for n, size in enumerate((60_000, 1 << 30)):
        path = str(tmp_path / str(n))
        delimited.write_in_order(df, path, "k", file_bytes=size)
        assert (len(list((tmp_path / str(n)).glob("part-*.csv"))) > 3) == (n == 0)
        rows = delimited.read_delimited(spark, path, df.schema).orderBy("row_id").collect()
        assert [(r["row_id"], r["k"]) for r in rows] == [(i, i) for i in range(3000)]
        assert {r["t"] for r in rows} == {f'a "b"\n{i}' for i in range(3000)}
