from pyspark.sql import functions as F

from corpuscat.operators.enrich import enrich_missing, enrich_text
from corpuscat.streaming.enrich import enrich_new_files


def make_client():
    def reply(prompt):
        if "boom" in prompt:
            raise TimeoutError("no answer")
        return f"  {prompt.upper()} "

    return reply


def refusing_client():
    def reply(prompt):
        raise AssertionError("must not be called")

    return reply


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "i int, t string")


def enrich(df):
    return enrich_text(df, "t", "say: {text}", make_client)


def test_reply_failure_and_blank(spark):
    df = docs(spark, (1, "abc"), (2, "boom"), (3, None), (4, " \t"))
    got = {r["i"]: (r["output"], r["enrich_status"]) for r in enrich(df).collect()}
    assert got == {1: ("SAY: ABC", "ok"), 2: ("boom", "failed"), 3: ("", "blank"), 4: ("", "blank")}


def test_blank_rows_make_no_call(spark):
    got = enrich_text(docs(spark, (1, ""), (2, None)), "t", "{text}", refusing_client).collect()
    assert all(r["output"] == "" and r["enrich_status"] == "blank" for r in got)


def test_stored_rows_are_not_asked_again(spark, tmp_path):
    path = str(tmp_path / "store")
    first = docs(spark, (1, "a"), (2, "b"))
    assert enrich_missing(first, "i", path, enrich).count() == 2
    both = docs(spark, (1, "a"), (2, "b"), (3, "c"))
    seen = []

    def counting(df):
        seen.append(df.count())
        return enrich(df)

    assert enrich_missing(both, "i", path, counting).count() == 3
    assert seen == [1]


def test_arriving_files(spark, tmp_path):
    src, store, progress = (str(tmp_path / p) for p in ("in", "store", "progress"))
    schema = docs(spark, (1, "a")).schema
    docs(spark, (1, "a"), (2, "b")).write.parquet(src)
    assert enrich_new_files(spark, src, schema, "i", store, progress, enrich).count() == 2
    docs(spark, (2, "b"), (3, "c")).write.mode("append").parquet(src)
    out = enrich_new_files(spark, src, schema, "i", store, progress, enrich)
    assert sorted(r["i"] for r in out.collect()) == [1, 2, 3]
    assert out.filter(F.col("enrich_status") != "ok").count() == 0


def test_a_hanging_call_is_given_up():
    import time

    from corpuscat.operators.enrich import _call_all

    def client(p):
        if p == "hang":
            time.sleep(30)
        if p == "bad":
            raise RuntimeError
        return f" {p}! "

    start = time.monotonic()
    got = _call_all(client, ["a", "hang", None, "bad", "b"], seconds=0.5, in_flight=2)
    assert got == [("a!", "ok"), (None, "failed"), (None, "blank"), (None, "failed"), ("b!", "ok")]
    assert time.monotonic() - start < 5


def test_failed_rows_are_asked_again_in_slices(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "i int, t string")
    path = str(tmp_path / "store")

    def run(ok):
        status = F.when(F.col("i") % 4 == 0, "ok" if ok else "failed").otherwise("ok")
        return lambda df: df.select("i", F.lit(ok).alias("second"), status.alias("enrich_status"))

    assert enrich_missing(rows, "i", path, run(False), slices=3).filter("enrich_status = 'failed'").count() == 5
    again = enrich_missing(rows, "i", path, run(True), retry_failed=True)
    assert again.count() == 20 and again.filter("enrich_status = 'failed'").count() == 0
    assert again.filter("second").count() == 5


def test_a_slow_call_holds_one_place():
    import time

    from corpuscat.operators.enrich import _call_all

    def client(p):
        time.sleep(3 if p == "slow" else 0.02)
        return p

    prompts = ["slow", *[f"p{i}" for i in range(100)]]
    start = time.monotonic()
    got = _call_all(client, prompts, seconds=1.0, in_flight=4)
    assert time.monotonic() - start < 2.5  # waves would take as long, but each slow call would stop three others
    assert got[0] == (None, "failed") and got[1:] == [(p, "ok") for p in prompts[1:]]
    start = time.monotonic()
    got = _call_all(client, ["slow"] * 2 + prompts[1:61], seconds=5.0, in_flight=4)
    assert time.monotonic() - start < 4 and all(s == "ok" for _, s in got)


def test_calls_are_asked_again_after_a_pause():
    import time

    from corpuscat.operators.enrich import _call_all

    seen = {}

    def client(p):
        seen.setdefault(p, []).append(time.monotonic())
        if p == "never" or (p == "third" and len(seen[p]) < 3):
            raise RuntimeError
        return p

    got = _call_all(client, ["third", "never", None, "first"], seconds=1, in_flight=1, tries=3, pause=0.1)
    assert got == [("third", "retried"), (None, "failed"), (None, "blank"), ("first", "ok")]
    assert [len(seen[p]) for p in ("third", "never", "first")] == [3, 3, 1]
    gaps = [b - a for a, b in zip(seen["third"], seen["third"][1:])]
    assert gaps[0] >= 0.1 and gaps[1] >= 0.2
    assert seen["first"][0] < seen["third"][1]  # a pause holds no place


def test_a_client_that_hangs_is_down(monkeypatch):
    import threading

    from corpuscat.operators import enrich as module

    monkeypatch.setattr(module, "HUNG_LIMIT", 3)
    free, asked = threading.Event(), []

    def client(p):
        asked.append(p)
        free.wait(20)
        return p

    got = module._call_all(client, [f"p{i}" for i in range(20)], seconds=0.1, in_flight=1)
    free.set()
    assert got == [(None, "failed")] * 20 and len(asked) == 3


def test_only_ids_meet_the_store(spark, plan_of, tmp_path):
    from corpuscat.operators.enrich import missing_rows
    from corpuscat.sources.stored import save_bucketed

    rows = spark.createDataFrame([*[(i, f"t{i}") for i in range(50)], (None, "n"), (7, "t7")], "i int, t string")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    settled = spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "i int")
    settled.write.parquet(str(tmp_path / "settled"))
    settled = spark.read.parquet(str(tmp_path / "settled"))
    want = sorted([str((i, f"t{i}")) for i in range(40, 50)] + [str((None, "n"))])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in (1 << 20, 0):
            assert sorted(str(tuple(r)) for r in missing_rows(rows, settled, "i", limit).collect()) == want
        a = save_bucketed(rows, "rows_by_id", str(tmp_path / "a"), "i", 4)
        b = save_bucketed(settled, "settled_by_id", str(tmp_path / "b"), "i", 4)
        found = missing_rows(a, b, "i")
        assert sorted(str(tuple(r)) for r in found.collect()) == want
        assert "Exchange" not in plan_of(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("rows_by_id", "settled_by_id"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
