"""The streaming source and keyed state: restarts, random edits, long lists, lists that are forgotten."""

from __future__ import annotations

import json
import random
import time

from pyspark.sql import functions as F

from plumbline.operators import match
from plumbline.sources import recorded
from plumbline.streaming import live
from tests.test_engine import rocks


def event(text, reason=None):
    return "data: " + json.dumps({"choices": [{"text": text, "finish_reason": reason, "logprobs": {"tokens": [text], "top_logprobs": [{text: -0.1}]}}]}) + "\n\n"


def test_recorded_streams_survive_restarts(spark, tmp_path):
    """Three streams that grow between and beyond restarts, in stretches of about a line: each event once, in order."""
    spark.dataSource.register(recorded.RecordedEvents)
    folder = tmp_path / "in"
    folder.mkdir()
    rng, want = random.Random(3), {f"s{k}": [] for k in range(3)}

    def grow(name, n):
        with open(folder / name, "a") as f:
            for _ in range(n):
                text = rng.choice(["a", "é", "long " * 40]) + str(len(want[name]))
                f.write(rng.choice(["", ": ping\n", "data: {broken\n", "\r\n"]) + event(text))
                want[name].append(text)

    def run():
        rows = spark.readStream.format("recorded_events").option("path", str(folder)).option("bytesPerPartition", 200).load()
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        query.processAllAvailable()
        return query

    for k in range(3):
        grow(f"s{k}", 5 + k)
    run().stop()
    for round_ in range(3):
        grow("s1", 3)
        with open(folder / "s2", "a") as f:  # a line that is not whole yet
            f.write(event("half")[:20])
        query = run()
        grow("s0", 2)
        query.processAllAvailable()
        query.stop()
        with open(folder / "s2", "a") as f:
            f.write(event("half")[20:])
        want["s2"].append("half")
    with open(folder / "s0", "a") as f:
        f.write("data: [DONE]\n")
    run().stop()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("file", "at").collect()
    assert {k: [r["generated_text"] for r in got if r["file"] == k and r["finish_reason"] is None] for k in want} == want
    assert [r["finish_reason"] for r in got if r["finish_reason"]] == ["stream_end"]
    batch = spark.read.format("recorded_events").option("path", f"file://{folder}").load()
    assert sorted(map(str, batch.collect())) == sorted(map(str, got))
    assert spark.read.format("recorded_events").option("path", str(tmp_path / "none")).load().count() == 0


def test_recorded_streams_are_checked(spark, tmp_path):
    """From events to the first violation of each stream."""
    spark.dataSource.register(recorded.RecordedEvents)
    (tmp_path / "in").mkdir()
    for k, text in enumerate(["see the cat sit", "see the dog sit"]):
        (tmp_path / f"in/{k}").write_text("".join(event(c) for c in text) + "data: [DONE]\n")
    rows = spark.readStream.format("recorded_events").option("path", f"{tmp_path}/in").load()
    chunks = rows.select(F.col("file").cast("long").alias("doc_id"), F.col("at").alias("seq"), F.col("generated_text").alias("text"), (F.col("finish_reason") == "stream_end").alias("done"))
    query = live.checked(chunks, match.Rules(("the cat",)), hold_back=8).writeStream.format("memory").queryName("checked_events").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select * from checked_events order by doc_id, seq").collect()
    assert ["".join(r["text"] for r in got if r["doc_id"] == k) for k in (0, 1)] == ["see the cat sit", "see the dog sit"]
    assert [(r["doc_id"], r["hit_rule"], r["hit_start"]) for r in got if r["hit_kind"]] == [(0, "the cat", 4)]


def test_random_edits(spark, tmp_path):
    """Edits of several documents over several batches, with a restart, against plain lists."""
    rng, lists, seq = random.Random(5), {}, 0
    (tmp_path / "in").mkdir()
    stream = lambda: live.edited(spark.readStream.schema(live.EDITS).json(f"file://{tmp_path}/in"))
    with rocks(spark):
        for batch in range(3):
            rows = []
            for _ in range(120):
                doc = rng.randrange(4)
                now = lists.setdefault(doc, [])
                op = rng.choice(["append"] * 5 + ["truncate", "replace", "commit"])
                at, token = (None, f"{seq} ") if op == "append" else (rng.choice([None, -1, 0, rng.randint(0, len(now) + 1), max(0, len(now) - 1)]), rng.choice([f"{seq} ", None]))
                lists[doc] = live.applied(now, op, at, token)
                rows.append({"doc_id": doc, "seq": seq, "op": op, "at": at, "token": token})
                seq += 1
            (tmp_path / f"in/{batch}.json").write_text("\n".join(map(json.dumps, rows)))
            query = stream().writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").start()
            query.processAllAvailable()
            query.stop()
    got = {r["doc_id"]: (r["tokens"], r["text"]) for r in live.lists(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {k: (v, "".join(v)) for k, v in lists.items()}


def test_long_lists_cost_what_their_edits_touch(spark, tmp_path):
    """A batch that appends to a list of 100,000 tokens takes about as long as one that appends to a list of 100."""
    (tmp_path / "in").mkdir()
    at = iter(range(10**9))

    def write(name, doc, n):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps({"doc_id": doc, "seq": next(at), "op": "append", "token": "t"}) for _ in range(n)))

    with rocks(spark):
        query = live.edited(spark.readStream.schema(live.EDITS).json(f"file://{tmp_path}/in")).writeStream.format("memory").queryName("long_lists").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").start()

        def took(name, doc, n):
            write(name, doc, n)
            begun = time.perf_counter()
            query.processAllAvailable()
            return time.perf_counter() - begun

        took("a", 1, 100)
        took("b", 2, 100_000)
        short, long = [], []
        for k in range(4):
            short.append(took(f"s{k}", 1, 5))
            long.append(took(f"l{k}", 2, 5))
        query.stop()
    rows = spark.sql("select doc_id, length, size(changed) as n from long_lists order by seq").collect()
    assert [tuple(r) for r in rows[-2:]] == [(1, 120, 5), (2, 100_020, 5)]
    assert min(long) < 1.5 * min(short) + 0.3, (short, long)


def test_lists_are_forgotten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"doc_id": 1, "seq": 0, "op": "append", "token": "t"}))
    with rocks(spark):
        query = live.edited(spark.readStream.schema(live.EDITS).json(f"file://{tmp_path}/in"), "1 second").writeStream.format("memory").queryName("forgotten").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").start()
        deadline = time.time() + 60
        while time.time() < deadline and spark.sql("select * from forgotten where over").isEmpty():
            time.sleep(0.5)
        (tmp_path / "in/b.json").write_text(json.dumps({"doc_id": 1, "seq": 5, "op": "append", "token": "u"}))
        while time.time() < deadline and spark.sql("select * from forgotten where seq = 5").isEmpty():
            time.sleep(0.5)
        query.stop()
    assert [r["length"] for r in spark.sql("select * from forgotten where seq is not null order by seq").collect()] == [1, 1]
