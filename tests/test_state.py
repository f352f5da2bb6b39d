"""Streams that remember: the same rows as the batch, however the messages are split."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fathomlake.config import Settings
from fathomlake.operators import store
from fathomlake.streaming import state

SMALL = Settings(context_messages=4, context_chars=60, recent_messages=2)


def run(stream, path, parts=None):
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(240)


def rows(pieces):
    out = {}
    for r in pieces.orderBy("conversation_id", "created_at", "content", "role").collect():
        out.setdefault((r.conversation_id, r.n, r.chars), []).append(r.piece)
    return {k: "\n".join(x for x in v if x is not None) for k, v in out.items()}


@pytest.mark.parametrize("splits", [1, 5])
def test_conversations(spark, sf_dir, tmp_path, splits):
    """All of `conversations` with some nulls and ties, shuffled, in so many batches; one of them holds a third of all rows."""
    state.ready(spark)
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.substring("text", 1, 40)).collect()
    said = [(0 if i % 3 == 0 else c, i if i % 3 == 0 else t, r, x) for i, (c, t, r, x) in enumerate(said)]
    said += [(7001, k // 2, "user", None if k == 3 else f"m{k % 3}" * 8) for k in range(12)] + [(7002, 1, "user", "x" * 99)]
    random.Random(splits).shuffle(said)
    schema = "conversation_id long, created_at long, role string, content string"
    for k in range(splits):
        spark.createDataFrame(said[k::splits], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(state.context_changes(stream, SMALL), tmp_path)
    got = rows(state.context_pieces(spark.read.parquet(f"{tmp_path}/out"), SMALL))
    want, conversations = {}, {}
    for c, *m in said:
        conversations.setdefault(c, []).append(m)
    for c, some in conversations.items():
        some.sort(key=lambda m: (m[0], m[2] is not None, m[2] or "", m[1]))
        key = (c, len(some), sum(len(m[2] or "") for m in some))
        if key[1] >= 4 and key[2] >= 60:
            want[key] = "\n".join(f"{m[1].upper()}: {m[2]}" for m in some[:-2] if m[2] is not None)
    assert got == want and len(want) > 3
    assert {(r.conversation_id, r.n, r.chars): r.dialogue for r in store.context_windows(spark.createDataFrame(said, schema), SMALL).collect()} == want


def test_sessions_end(spark, tmp_path):
    state.ready(spark)
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    batches = [
        [("a", 1, "open", day(0)), ("b", 2, "open", day(0)), ("c", 3, "open", day(1)), ("c", 3, "close", day(2))],
        [("b", 2, "open", day(20)), ("d", 4, "open", day(21)), ("e", 5, "close", day(21))],
        [("f", 6, "open", day(45))],
        [("g", 7, "open", day(46))],
    ]
    schema = "token string, user_id long, action string, at timestamp"
    for some in batches:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(state.session_ends(stream), tmp_path)
    got = {(r.token, r.user_id, r.what, r.at) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("c", 3, "closed", day(2)), ("a", 1, "expired", day(30))}
