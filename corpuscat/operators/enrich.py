"""Row-wise text generation by a caller-supplied client, with stored results."""

from __future__ import annotations

import contextlib
import heapq
import queue
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpuscat.functions.text import is_blank, prompt
from corpuscat.operators.scale import BROADCAST_BYTES, planned_bytes, spread
from corpuscat.session import cut_lineage
from corpuscat.sources.stored import save_bucketed

Client = Callable[[str], str]

# Calls of one task that were given up and still run, from which on its client counts as down.
HUNG_LIMIT = 64


def _call_all(
    client: Client,
    prompts: list[str | None],
    seconds: float,
    in_flight: int,
    tries: int = 1,
    pause: float = 0.5,
    hung: list[threading.Thread] | None = None,
) -> list[tuple[str | None, str]]:
    """Reply and status of each prompt, at most ``in_flight`` calls at a time.

    Calls slide: as soon as one ends, the next begins, so a slow call holds one place only
    and none for more than ``seconds``. A call that fails or is given up is asked again, up
    to ``tries`` times, after a pause that doubles each time and holds no place. Calls given
    up run on in daemon threads, listed in ``hung``; where ``HUNG_LIMIT`` of them are still
    alive, the client counts as down, and what has not been asked is ``failed``.
    """
    hung = [] if hung is None else hung
    results: list[tuple[str | None, str]] = [(None, "blank") if p is None else (None, "failed") for p in prompts]
    ended: queue.SimpleQueue = queue.SimpleQueue()

    def call(i: int, attempt: int) -> None:
        reply = None
        with contextlib.suppress(Exception):  # any client failure falls back to the original text
            reply = client(prompts[i]).strip()
        ended.put((i, attempt, reply))

    waiting = [(0.0, 1, i) for i, p in enumerate(prompts) if p is not None]  # when, which attempt, which prompt
    running: dict[tuple[int, int], tuple[float, threading.Thread]] = {}

    def again(i: int, attempt: int) -> None:
        if attempt < tries:
            heapq.heappush(waiting, (time.monotonic() + pause * 2 ** (attempt - 1), attempt + 1, i))

    while waiting or running:
        now = time.monotonic()
        hung[:] = [t for t in hung if t.is_alive()]
        if len(hung) >= HUNG_LIMIT:
            waiting.clear()
        while waiting and len(running) < in_flight and waiting[0][0] <= now:
            _, attempt, i = heapq.heappop(waiting)
            thread = threading.Thread(target=call, args=(i, attempt), daemon=True)
            running[i, attempt] = (now + seconds, thread)
            thread.start()
        events = [end for end, _ in running.values()] + ([waiting[0][0]] if waiting and len(running) < in_flight else [])
        if not events:
            continue
        with contextlib.suppress(queue.Empty):
            i, attempt, reply = ended.get(timeout=max(0.0, min(events) - now))
            if running.pop((i, attempt), None) is None:
                continue  # it came after it was given up
            if reply is None:
                again(i, attempt)
            else:
                results[i] = (reply, "ok" if attempt == 1 else "retried")
        for (i, attempt), (end, thread) in list(running.items()):
            if end <= time.monotonic():
                del running[i, attempt]
                hung.append(thread)
                again(i, attempt)
    return results


def _reply_column(make_client: Callable[[], Client], seconds: float, in_flight: int, tries: int, pause: float):
    def ask(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client, hung = make_client(), []
        for batch in prompts:
            yield pd.DataFrame(_call_all(client, list(batch), seconds, in_flight, tries, pause, hung), columns=["reply", "status"])

    ask.__annotations__ = {"prompts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(ask, "reply string, status string").asNondeterministic()


def enrich_text(
    df: DataFrame,
    text: str,
    template: str,
    make_client: Callable[[], Client],
    out: str = "output",
    status: str = "enrich_status",
    seconds: float = 120.0,
    in_flight: int = 4,
    tries: int = 1,
    pause: float = 0.5,
) -> DataFrame:
    """Add the client's reply to the prompt, and ``ok``, ``retried``, ``failed`` or ``blank``.

    One client per task, with ``in_flight`` calls at a time; it must bear that. A blank text
    gives '' and is never sent. A call that fails or takes more than ``seconds`` is made up to
    ``tries`` times, ``pause`` seconds after the first and twice as long after each other; when
    none succeeds, the original text is given. Only the prompt goes to Python, the other columns stay in the JVM. Calls
    are slow, so a small input is dealt over all cores.
    """
    sent = F.when(~is_blank(F.col(text)), prompt(template, F.col(text)))
    asked = spread(df).withColumn("_r", _reply_column(make_client, seconds, in_flight, tries, pause)(sent))
    result = F.when(F.col("_r.status") == "blank", "").when(F.col("_r.status") == "failed", F.col(text)).otherwise(F.col("_r.reply"))
    return asked.select(*df.columns, result.alias(out), F.col("_r.status").alias(status))


def stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing has been stored there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def missing_rows(df: DataFrame, settled: DataFrame, row_id: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``df`` whose id is not in ``settled``; rows without an id are always missing.

    Where both are tables bucketed by the id into as many buckets, they meet bucket by bucket
    and nothing moves. Else only ids are shuffled; the missing ones are stored, and the rows
    keep theirs by a broadcast up to ``broadcast_bytes`` of measured size, beyond it by a join.
    """
    both = df.join(settled.select(row_id), row_id, "left_anti")
    if "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString():
        return both
    ids = cut_lineage(df.select(row_id).join(settled.select(row_id), row_id, "left_anti").distinct())
    ids = ids.withColumnRenamed(row_id, "_missing")
    small = planned_bytes(ids) <= broadcast_bytes
    return df.join(F.broadcast(ids) if small else ids, F.col(row_id).eqNullSafe(F.col("_missing")), "left_semi")


def enrich_missing(
    df: DataFrame,
    row_id: str,
    path: str,
    enrich: Callable[[DataFrame], DataFrame],
    slices: int = 1,
    retry_failed: bool = False,
    status: str = "enrich_status",
) -> DataFrame:
    """Enrich only rows without a stored result, append them, return the whole store.

    The rows are written in ``slices`` by a hash of their id, so a failure late in the run
    keeps what earlier slices have paid for. With ``retry_failed``, rows whose call failed
    are asked again; the store then returns the better of their results.
    """
    done = stored_rows(df.sparkSession, path)
    settled = done if done is None or not retry_failed else done.filter(F.col(status) != "failed")
    todo = df if settled is None else missing_rows(df, settled, row_id)
    for k in range(slices):
        part = todo if slices == 1 else todo.filter(F.pmod(F.xxhash64(row_id), F.lit(slices)) == k)
        enrich(part).write.mode("append").parquet(path)
    store = df.sparkSession.read.parquet(path)
    if not retry_failed:
        return store
    better = Window.partitionBy(row_id).orderBy((F.col(status) == "failed").cast("int"))
    return store.withColumn("_rn", F.row_number().over(better)).filter("_rn = 1").drop("_rn")


def enrich_bucketed(
    df: DataFrame,
    row_id: str,
    name: str,
    path: str,
    enrich: Callable[[DataFrame], DataFrame],
    buckets: int = 64,
) -> DataFrame:
    """``enrich_missing`` with a store that is table ``name`` at ``path``, bucketed and sorted by the id.

    An input bucketed alike (``stored.save_bucketed``) meets the store without an exchange.
    """
    spark = df.sparkSession
    todo = missing_rows(df, spark.table(name), row_id) if spark.catalog.tableExists(name) else df
    return save_bucketed(enrich(todo), name, path, row_id, buckets, mode="append")
