"""Dialog states of a stream against the batch operator on the same turns."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.dialogs import dialog_state
from tallyforge.streaming import dialogs as S

PRODUCTS = {"banner": "banner", "sign": "sign", "card": "card"}
START = datetime.datetime(2024, 1, 1)
KIND = "chat_id long, id long, role string, content string, ts timestamp"


@pytest.fixture
def store(spark):
    before = spark.conf.get(S.STORE[0])
    spark.conf.set(*S.STORE)
    yield
    spark.conf.set(S.STORE[0], before)


def _turns(n, seed=0):
    rng = random.Random(seed)
    said = ["a banner please", "no sign", "not the card, the banner 120 cm", "hello", "sign 50 mm", None, "cards and a sign"]
    return [(rng.randint(1, 6), i, "user", rng.choice(said), START + datetime.timedelta(seconds=10 * i)) for i in range(n)]


def _write(spark, rows, folder, k):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")


def _run(spark, folder, out, check, idle="10 hours"):
    turns = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    states = S.dialog_states(turns, PRODUCTS, "no |not ", idle=idle, late="5 hours")
    done = lambda df, _: df.write.mode("append").parquet(out)
    states.writeStream.outputMode("update").foreachBatch(done).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def _last(spark, out):
    rows = {}
    for r in spark.read.parquet(out).collect():
        if not r.ended and (r.chat_id not in rows or r.turns >= rows[r.chat_id].turns):
            rows[r.chat_id] = r
    return {k: (r.last_id, r.mentioned, r.rejected, r.confirmed, r.size) for k, r in rows.items()}


def _batch(spark, turns):
    found = dialog_state(spark.createDataFrame(turns, KIND), PRODUCTS, "no |not ")
    last = found.groupBy("chat_id").agg(F.max_by(F.struct("id", "mentioned", "rejected", "confirmed", "size"), "id").alias("r")).select("chat_id", "r.*")
    return {r.chat_id: (r.id, r.mentioned, r.rejected, r.confirmed, r.size) for r in last.collect()}


def test_last_states_equal_the_batch_operator_after_a_restart(spark, store, tmp_path):
    """Turns come out of order and twice; the stream stops after two files and goes on from its checkpoint."""
    turns = _turns(60)
    parts = [turns[20:40], turns[:20], turns[35:60], turns[10:15]]
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k, part in enumerate(parts[:2]):
        _write(spark, part, folder, k)
    _run(spark, folder, out, check)
    assert _last(spark, out) == _batch(spark, turns[:40])
    for k, part in enumerate(parts[2:], 2):
        _write(spark, part, folder, k)
    _run(spark, folder, out, check)
    assert _last(spark, out) == _batch(spark, turns)


def test_chats_end_and_begin_anew(spark, store, tmp_path):
    at = lambda h: START + datetime.timedelta(hours=h)
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    files = [[(1, 1, "user", "a banner", at(0)), (None, 2, "user", "x", at(0)), (1, None, "user", "x", at(0)), (1, 3, "user", "x", None)], [(2, 4, "user", "card", at(20))], [(2, 5, "user", "sign", at(21))], [(1, 6, "user", "no sign", at(22))]]
    for k, rows in enumerate(files):
        _write(spark, rows, folder, k)
        _run(spark, folder, out, check, idle="1 hour")
    rows = spark.read.parquet(out).collect()
    assert [(r.last_id, r.mentioned, r.turns) for r in rows if r.chat_id == 1 and r.ended] == [(1, ["banner"], 1)]
    new = [r for r in rows if r.chat_id == 1 and r.last_id == 6]
    assert [(r.mentioned, r.rejected, r.turns, r.ended) for r in new] == [(["sign"], ["sign"], 1, False)]
    assert max(r.turns for r in rows if r.chat_id == 2 and not r.ended) == 2
