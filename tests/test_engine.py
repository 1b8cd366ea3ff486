"""Bookkeeping, candidates, decoding, records, settings, repair and streams on hand-written rows."""

from __future__ import annotations

import json
import math
import os
import random
import re
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from plumbline import config, generate
from plumbline.operators import batch, candidates as cd, decode, match, metrics, repair
from plumbline.plans import standins
from plumbline.sources import completions, records
from plumbline.streaming import live


def kept(spark, expression, **probs):
    rows = [(list(probs.items()),)]
    return [(c["token"], round(c["p"], 9)) for c in spark.createDataFrame(rows, "probs array<struct<token:string,p:double>>").select(expression(F.col("probs")).alias("k")).first()["k"]]


def test_filters(spark):
    assert kept(spark, lambda p: cd.top_p(p, 0.5), a=0.5, b=0.3, c=0.2) == [("a", 0.5)]
    assert kept(spark, cd.inverted, a=0.6, b=0.4) == [("a", 0.4), ("b", 0.6)]
    assert kept(spark, cd.inverted, a=0.5, b=0.5) == [("a", 0.5), ("b", 0.5)]
    assert kept(spark, lambda p: cd.min_p(p, 0.5), a=0.6, b=0.3, c=0.1) == [("a", 0.6), ("b", 0.3)]
    assert kept(spark, lambda p: cd.top_k(p, 1), a=0.2, b=0.2) == [("a", 0.2)]


def test_tail(spark):
    rows = spark.createDataFrame([([(" a", -1.0), ("**", -1.1), ("!", -1.2), (" word", -1.3), ("gone", -0.1), ("pre", -1.4)],)], "c array<struct<token:string,logp:double>>")
    assert [x["token"] for x in rows.select(cd.tail(F.col("c"), F.lit("gone"), prefixes=("pre",)).alias("t")).first()["t"]] == [" word"]
    none = spark.createDataFrame([([],), (None,)], "c array<struct<token:string,logp:double>>")
    assert [r["t"] for r in none.select(cd.tail(F.col("c"), F.lit("x")).alias("t")).collect()] == [[], []]


def test_choice_follows_probabilities(spark):
    rows = spark.range(20_000).withColumn("k", F.expr("array(named_struct('token', 'a', 'p', 0.7D), named_struct('token', 'b', 'p', 0.3D))"))
    picked = rows.select("id", cd.choose(F.col("k"), F.col("id")).alias("t"))
    assert abs(picked.where("t = 'a'").count() / 20_000 - 0.7) < 0.02
    assert sorted(map(tuple, picked.limit(50).collect())) == sorted(map(tuple, rows.limit(50).repartition(5).select("id", cd.choose(F.col("k"), F.col("id"))).collect()))


def test_bookkeeping(spark):
    prompts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "prompt_id long, prompt string")
    existing, refused = spark.createDataFrame([("1",)], "prompt_id string"), spark.createDataFrame([("99",)], "prompt_id string")
    assert [r["prompt_id"] for r in batch.pending(prompts, existing, refused).orderBy("prompt_id").collect()] == [0, 2]
    assert [(r["prompt_id"], r["prompt"], r["status"]) for r in batch.placeholders(refused, existing, prompts).collect()] == [(99, "", "skipped")]
    again = existing.union(batch.pending(prompts, existing, refused).select(F.col("prompt_id").cast("string")))
    assert batch.pending(prompts, again, refused).count() == 0
    row = spark.range(1).select(batch.is_refused(F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("r"))
    assert row.first()["r"] is True
    ids = batch.numbered(spark.createDataFrame([(x,) for x in (50, 7, 7000, 3)], "k long"), "k").orderBy("k").collect()
    assert [r["prompt_id"] for r in ids] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        batch.templated(F.lit("x"), "{other}")


def test_prompt_extraction(spark, tmp_path):
    rows = [{"conversations": [{"from": "system", "value": "s"}, {"from": "Human", "value": "hi"}]}, {"conversations": [{"from": "gpt", "value": "x"}], "prompt": "p"}, {"prompt": "p"}, {"text": "a\n\nb"}, {"text": "plain"}, {"text": "Bot: x"}]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = records.sharegpt(spark, f"file://{tmp_path}/d.jsonl").select(batch.prompt_of(F.col("conversations"), F.col("prompt"), F.col("text")).alias("p")).collect()
    assert [r["p"] for r in got] == ["hi", None, "p", None, "plain", None]


def test_records(spark, tmp_path):
    (tmp_path / "p.json").write_text('["a", "b"]')
    assert [tuple(r) for r in records.prompt_list(spark, f"file://{tmp_path}/p.json").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "q.json").write_text('["a", 1]')
    with pytest.raises(Exception, match="not a list of strings"):
        records.prompt_list(spark, f"file://{tmp_path}/q.json").collect()
    (tmp_path / "g.jsonl").write_text('{"prompt_id": "1", "generation": "x"}\n{broken\n{"generation": "no id"}\n')
    assert [r["prompt_id"] for r in records.generations(spark, f"file://{tmp_path}/g.jsonl").collect()] == ["1"]
    assert records.malformed(spark, f"file://{tmp_path}/g.jsonl").count() == 1
    profile = {"human-authored": {"num_texts_analyzed": 2, "avg_length": 10.5, "top_bigrams": [{"ngram": "deep breath", "frequency": 3}], "top_trigrams": []}}
    (tmp_path / "h.json").write_text(json.dumps(profile, indent=1))
    items, chars = records.human_profile(spark, f"file://{tmp_path}/h.json", 2)
    assert [tuple(r) for r in items.collect()] == [("deep breath", 3.0)] and chars.first()["chars"] == 21.0


def test_decoding(spark):
    assert [decode.decoded(t) for t in ("Ġworld", "Ċ", "▁a", "Ã©", "plain", "ā", None)] == [" world", "\n", " a", "é", "plain", "\x01", None]
    # Characters outside the alphabets pass as they are; the second alphabet begins at U+2500; what is no valid text stays.
    assert [decode.decoded(t) for t in ("中Ã©", chr(0x2500 + 0x41), chr(0x25C3) + chr(0x25A9), "déjà", "Ġdéjà", "", "ÃĥÂ©")] == ["中é", "A", "é", "déjà", " déjà", "", "é"]


def test_settings(tmp_path):
    c = config.merged(config.Config(), {"generation_params": {"chunk_size": 50, "threads": 4}, "backtracking": {"force_backtrack": True}, "ngram_validator": {"banned_list": ["a b"]}, "temperature": 0.5, "threads": 3})
    assert (c.generation.chunk_size, c.generation.max_new_tokens, c.backtracking.force_backtrack, c.bans.ngram_list, c.generation.temperature) == (50, 1200, True, ("a b",), 0.5)
    with pytest.raises(KeyError):
        config.merged(config.Config(), {"nonsense": 1})
    assert config.base_url("http://x/") == "http://x/v1"
    for key, url in (("xxx", "http://x"), ("YOUR_API_KEY_HERE", "http://x"), ("", "https://api.openai.com/v1")):
        with pytest.raises(ValueError):
            config.checked_key(key, url)
    assert config.checked_key("", "http://x") == ""
    (tmp_path / "c.yaml").write_text("generation_params:\n  chunk_size: 7\n  temperature: 0.4\nforce_backtrack: true\nprompt_template: 'x {prompt}'\n")
    c, prompt = config.from_arguments(["--config", str(tmp_path / "c.yaml"), "--temperature", "0.9", "--stop-sequences", "a, ,b", "--invert-probs", "no", "--ngram-banned-list", "one two,three", "--prompt", "hi"])
    assert (c.generation.chunk_size, c.generation.temperature, c.generation.stop_sequences, c.generation.invert_probs, c.bans.ngram_cli_list, c.prompt_template, c.backtracking.force_backtrack, prompt) == (7, 0.9, ("a", "b"), False, ("one two", "three"), "x {prompt}", True, "hi")
    (tmp_path / "bad.yaml").write_text("a: [")
    for path in (tmp_path / "bad.yaml", tmp_path / "none.yaml"):
        with pytest.warns(UserWarning):
            assert config.load(str(path)) == config.Config()
    with pytest.raises(SystemExit):
        config.from_arguments(["--input-json", "a", "--input-hf-dataset", "b"])
    assert [config.yes(x) for x in ("Yes", "0", True)] == [True, False, True]


def test_payloads():
    g, at = config.Generation(stop_sequences=("x",)), lambda url: config.Provider(url, "k", "m", provider_order=("p",))
    a, b, c = (completions.payload(at(url), g, "hi") for url in ("https://api.openai.com", "https://openrouter.ai/api/v1", "http://localhost:8000"))
    assert (a["logprobs"], a["stop"], "min_p" in a) == (20, ["x"], False)
    assert (b["logprobs"], b["top_logprobs"], b["provider"]["order"]) == (True, 20, ["p"])
    assert (c["logprobs"], c["min_p"], c["max_tokens"], c["top_k"]) == (20, 0.03, 20, 50)
    assert completions.payload(at("http://x"), g, "hi", 7)["max_tokens"] == 7


def chunk(text, tokens, finish="length"):
    return {"choices": [{"text": text, "logprobs": {"tokens": tokens, "top_logprobs": [{t: -0.1, " other": -1.0} for t in tokens]}, "finish_reason": finish}]}


def test_completions(spark, tmp_path):
    assert completions.parsed_event("data: [DONE]")["finish_reason"] == "stream_end"
    assert completions.parsed_event("data: {oops") is None and completions.parsed_event(": ping") is None
    chat_shape = {"choices": [{"text": "a", "finish_reason": "stop", "logprobs": {"content": [{"top_logprobs": []}, {"token": "a", "top_logprobs": [{"token": "a", "logprob": -0.1}]}]}}]}
    assert completions.parsed(chat_shape)["logprobs"] == {0: [{"token": "a", "logp": -0.1}]}
    assert completions.parsed({})["finish_reason"] == "no_choice"

    def connect(provider, settings):
        def post(body):
            if body["prompt"] == "bad":
                raise repair.ProviderError("400: too long")
            if body["prompt"] == "denied":
                raise completions.Denied("401")
            return chunk(body["prompt"] + "!", ["!"])

        return completions.Http(post, lambda body: ["data: " + json.dumps(chunk("a", ["a"])), "data: [DONE]"])

    df = spark.createDataFrame([(1, "hi"), (2, "bad"), (3, None)], "prompt_id long, prompt string")
    got = {r["prompt_id"]: r for r in completions.complete(df, config.Provider(), config.Generation(), connect).collect()}
    assert got[1]["generated_text"] == "hi!" and got[1]["logprobs"][0][0]["logp"] == -0.1 and got[3]["generated_text"] == "!"
    assert (got[2]["finish_reason"], got[2]["error"]) == ("error", "400: too long")
    with pytest.raises(Exception, match="401"):
        completions.complete(spark.createDataFrame([(1, "denied")], "prompt_id long, prompt string"), config.Provider(), config.Generation(), connect).collect()
    assert completions.gives_logprobs(config.Provider(), config.Generation(), connect)
    silent = lambda p, g: completions.Http(lambda body: {}, lambda body: ["data: " + json.dumps({"choices": [{"text": "a"}]})])
    assert not completions.gives_logprobs(config.Provider(), config.Generation(), silent)
    (tmp_path / "events").mkdir()
    (tmp_path / "events/a.txt").write_text("\n".join(["data: " + json.dumps(chunk("a", ["a"])), ": ping", "data: {oops", "", "data: [DONE]"]))
    assert [(r["generated_text"], r["finish_reason"]) for r in completions.recorded_events(spark, f"file://{tmp_path}/events").collect()] == [("a", "length"), ("", "stream_end")]
    stream = completions.parsed_lines(spark.readStream.text(f"file://{tmp_path}/events").selectExpr("'f' as file", "value"))
    query = stream.writeStream.format("memory").queryName("sse").option("checkpointLocation", f"file://{tmp_path}/sse").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select * from sse").count() == 2


def test_throughput(spark):
    t = spark.createDataFrame([("r", 0, 20, 2.0), ("r", 1, 50, 3.0), ("r", 2, 60, 0.0)], "run_id string, chunk int, ctx_len int, api_sec double")
    assert [r["tokens_per_sec"] for r in metrics.chunk_throughput(t).orderBy("chunk").collect()] == [10.0, 10.0, None]


def repaired(tokens, options, own, provider=None, prompt="", most=12, **more):
    return repair.repair_one(1, prompt, tokens, options, own, provider or repair.Replay(), repair.Settings(repair.ladder_weights(), max_tokens=most, **more))


def test_repair_ends_without_violations():
    own = repair.Matcher(match.Rules(("the cat",), (r"\d{3}",), (("deep", "breath"),)))
    tokens = ["See", " the", " cat", " take", " deep", " breath", " 123"]
    options = [[(t, -0.1), (" dog", -1.0), (" sun", -2.0)] for t in tokens]
    done = repaired(tokens, options, own, standins.Cycling((" the", " cat", " sat", " down"), 12))
    assert not list(own.hits(done["text"])) and any(e["fixed"] for e in done["events"]) and done["rounds"] < 1000 and len(done["tokens"]) == 12 and done["settled"]
    done = repaired(tokens[:3], [[], [], []], own)
    assert done["tokens"] == tokens[:3] and [e["fixed"] for e in done["events"]] == [False] and done["settled"]
    assert done["events"][0]["details"]["phrase"] == "the cat" and done["events"][0]["details"]["context"] == "See the cat"
    assert math.isclose(sum(p for _, p in repair.ladder_weights(invert=True)([("a", -0.1), ("b", -2.0), ("c", -3.0)], "a", 0)[0]), 1.0)


def test_what_is_not_settled_is_told():
    class Endless:
        def continue_(self, doc_id, prompt, tokens, most):
            return [" more"], [[]]

    done = repaired([], [], repair.Matcher(match.Rules(("x",))), Endless(), most=10**6, max_rounds=50)
    assert not done["settled"] and len(done["tokens"]) == 50


def test_failures_keep_the_text():
    class Failing:
        def continue_(self, doc_id, prompt, tokens, most):
            if tokens:
                raise repair.ProviderError("context too long")
            return ["so", " far"], [[], []]

    done = repaired([], [], repair.Matcher(match.Rules(("x",))), Failing())
    assert (done["text"], done["error"], done["settled"]) == ("so far", "context too long", True)


def test_streams_are_cut_at_violations():
    """A stream is closed where a rule hits; patterns are run every few tokens only."""
    read, closed = [], []

    class Stream(standins.Recited):
        def stream(self, doc_id, prompt, tokens, most):
            try:
                for token in prompt.split("|")[len(tokens) :]:
                    read.append(token)
                    yield token, list(self.candidates)
            finally:
                closed.append(len(read))

    own = repair.Matcher(match.Rules(("bad",), (r"\d{3}",)))
    done = repair.repair_one(1, "a| bad| c| 123| d| e| f", [], [], own, Stream(((" good", -0.1), (" fine", -1.0))), repair.Settings(repair.ladder_weights(top_k=1), interval=2))
    assert done["text"] == "a good c good d e f" and [e["index"] for e in done["events"]] == [1, 3]
    assert read[:2] == ["a", " bad"] and closed[0] == 2 and len(closed) >= 3


def test_rules_of_ones_own(spark):
    class Doubled:
        kind, reach = "doubled", None

        def hits(self, text, since):
            for m in re.finditer(r"\b(\w+) \1\b", text):
                yield m.start(), len(m.group()), m.group(), m.group()

    rows = spark.createDataFrame([(1, ["the", " the", " end"], None, None), (2, None, None, "x")], "doc_id long, tokens array<string>, candidates array<array<struct<token:string,logp:double>>>, prompt string")
    got = {r["doc_id"]: r for r in repair.repair(rows, match.Rules(), more=(Doubled(),)).collect()}
    assert [(e["type"], e["index"], e["fixed"]) for e in got[1]["events"]] == [("doubled", 0, False)] and got[2]["text"] == "" and got[2]["settled"]


def test_a_run_and_its_resumption(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(["say the cat sat", "a plain one", "refuse this", "the cat again"]))
    (tmp_path / "old.jsonl").write_text(json.dumps({"prompt_id": "1", "generation": "", "status": "failed"}) + "\n{broken\n" + json.dumps({"generation": "no id"}))
    (tmp_path / "bans.json").write_text(json.dumps([["the cat", 1.0]]))
    settings = config.merged(config.Config(), {
        "input_json": f"file://{tmp_path}/p.json", "output_jsonl": f"file://{tmp_path}/log", "ftpo_pairs_jsonl": f"file://{tmp_path}/pairs", "refusals_file": f"file://{tmp_path}/old.jsonl",
        "slop_phrases_file": f"file://{tmp_path}/bans.json", "enable_refusal_detection": True, "top_k": 1, "min_p": None, "invert_probs": False, "prompt_template": "{prompt}!",
    })
    provider = standins.Recited(((" a", -0.5), (" some", -1.0), (" kind", -2.0)), chunk=3)
    scorer = lambda: lambda prompts, answers: [("refusal", 0.95) if "refuse" in p else ("no", 0.5) for p in prompts]
    totals = generate.run(spark, settings, provider, scorer).first()
    assert (totals["prompts"], totals["succeeded"], totals["unsettled"]) == (4, 2, 0)
    log = {r["prompt_id"]: r for r in records.generations(spark, f"file://{tmp_path}/log").collect()}
    assert {k: (r["status"], r["generation"]) for k, r in log.items()} == {"0": ("success", "say a cat sat!"), "1": ("skipped", None), "2": ("failed", "refuse this!"), "3": ("success", " a cat again!")}
    assert log["2"]["error"] == "refusal detected (refusal, p=0.950)" and log["1"]["error"] == "skipped -- prior refusal" and log["0"]["events"][0]["details"]["phrase"] == "the cat"
    pairs = spark.read.json(f"file://{tmp_path}/pairs").orderBy("prompt_raw").collect()
    assert [(r["context_with_chat_template"], r["rejected_raw"], r["chosen_raw"], r["multi_chosen_raw"]) for r in pairs] == [("say the cat sat!say", " the", " a", [" kind", " some"]), ("the cat again!", "the", " a", [" kind", " some"])]
    assert generate.run(spark, settings, provider, scorer).first()["prompts"] == 0  # nothing is left
    with pytest.raises(FileNotFoundError):
        records.refusals(spark, f"file://{tmp_path}/none.jsonl")


def test_a_scorer_that_fails(spark):
    rows = spark.createDataFrame([(1, "p", "g")], "prompt_id long, prompt string, generation string")

    def broken():
        raise OSError("no model")

    assert [tuple(r) for r in generate.scored(rows, broken).collect()] == [(1, "error", 0.0)]


def test_one_prompt():
    told = []
    found = generate.one("see the cat", config.merged(config.Config(), {"top_k": 1, "min_p": None, "invert_probs": False}), match.Rules(("the cat",)), standins.RecitedStream(((" a", -0.5), (" dog", -1.0))), lambda i, e: told.append(e["type"]))
    assert found["text"] == "see a cat" and told == ["phrase"]


def test_datasets(spark, tmp_path):
    rows = [{"conversations": [{"from": "human", "value": "hi"}]}, {"prompt": "p"}]
    (tmp_path / "d/train").mkdir(parents=True)
    (tmp_path / "d/train/a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "d/test").mkdir()
    (tmp_path / "d/test/b.jsonl").write_text(json.dumps({"text": "t"}))
    assert records.dataset(spark, f"file://{tmp_path}/d").count() == 2 and records.dataset(spark, f"file://{tmp_path}/d", "test").first()["text"] == "t"
    assert records.dataset(spark, f"file://{tmp_path}/d", limit=1).count() == 1
    settings = config.merged(config.Config(), {"input_hf_dataset": f"file://{tmp_path}/d"})
    assert sorted(tuple(r) for r in generate.read_prompts(spark, settings).collect()) == [(0, "hi"), (1, "p")]
    with pytest.raises(FileNotFoundError):
        records.dataset(spark, f"file://{tmp_path}/p")


def test_latest_timings(spark, tmp_path):
    for name, at in (("a", 1_000_000), ("b", 2_000_000)):
        (tmp_path / f"{name}.csv").write_text(f"chunk,ctx_len,api_sec,validators_sec\n0,{at // 1000},1.5,0.1\n")
        os.utime(tmp_path / f"{name}.csv", (at, at))
    assert [r["ctx_len"] for r in records.latest_timings(spark, f"file://{tmp_path}").collect()] == [2000]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(0, 10, 1.0, 0.5)], "chunk int, ctx_len int, api_sec double, validators_sec double")
    records.write_timings(rows, f"file://{tmp_path}/t")
    records.write_timings(rows, f"file://{tmp_path}/t")
    assert records.latest_timings(spark, f"file://{tmp_path}/t").count() == 1
    records.write_analysis({"bigrams": rows}, f"file://{tmp_path}/a")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/a/bigrams").count() == 1


def test_rates_by_hand(spark):
    """Bursts that go across buckets of time, trailing windows of them, and the limit of entries, against a plain loop."""
    random.seed(5)
    rows, now = [], 0
    for _ in range(1500):
        now += random.choice([1_000, 4_000, 5_000, 6_000, 20_000, 400_000, 7_000_000])
        rows.append(("k", now, random.randint(1, 5)))
    held, want = [], []
    for i, (_, us, n) in enumerate(rows):
        if held and us - held[-1][2] <= 5_000:
            held[-1] = (held[-1][0], held[-1][1] + n, us)
        else:
            held.append((us, n, us))
        if i + 1 == len(rows) or rows[i + 1][1] - us > 5_000:
            back = [(last, m) for _, m, last in held if last >= us - 5_000_000][-20:]
            span = (us - back[0][0]) / 1e6
            want.append((us, held[-1][1], round(sum(m for _, m in back) / span, 6) if span > 1e-6 else None))
    df = spark.createDataFrame(rows, "key string, us long, tokens long")
    got = [(r["us"], r["tokens"], r["rate"] and round(r["rate"], 6)) for r in metrics.smoothed_rate(df, "key", entries=20).orderBy("us").collect()]
    assert got == want and sum(w[2] is not None for w in want) > 200


@contextmanager
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    live.use_rocks(spark)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def test_edits_of_token_lists(spark, tmp_path):
    edits = [("append", None, "a"), ("append", None, " b"), ("append", None, " c"), ("replace", 1, " B"), ("commit", 1, " x"), ("append", None, " y"), ("truncate", 2, None), ("truncate", 9, None)]
    states, now = [], []
    for op, at, token in edits:
        now = live.applied(now, op, at, token)
        states.append("".join(now))
    assert states == ["a", "a b", "a b c", "a B c", "a x", "a x y", "a x", "a x"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"doc_id": 1, "seq": k, "op": op, "at": at, "token": t}) for k, (op, at, t) in enumerate(edits)))
    stream = spark.readStream.schema(live.EDITS).json(f"file://{tmp_path}/in")
    with rocks(spark):
        query = live.edited(stream).writeStream.format("memory").queryName("edits").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").start()
        query.processAllAvailable()
        query.stop()
    assert [(r["text"], r["tokens"]) for r in live.lists(spark.table("edits")).collect()] == [("a x", ["a", " x"])]


def test_words_cut_by_the_stream(spark, tmp_path):
    """Text that was handed out still tells that a word began there; what never ends is handed out after a while."""
    (tmp_path / "in").mkdir()
    parts = [(1, 0, "the scat sat", False), (1, 1, " on the mat", True), (2, 0, "the cat", False)]
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"doc_id": d, "seq": k, "text": t, "done": e}) for d, k, t, e in parts))
    chunks = spark.readStream.schema("doc_id long, seq long, text string, done boolean").json(f"file://{tmp_path}/in")
    query = live.checked(chunks, match.Rules(("cat",)), hold_back=7, forget="1 second").writeStream.format("memory").queryName("words").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").start()
    deadline = time.time() + 60  # timeouts go on making batches, so there is no end to wait for
    while time.time() < deadline and spark.sql("select * from words where doc_id = 2 and done").isEmpty():
        time.sleep(1)
    query.stop()
    got = spark.sql("select * from words where doc_id < 3 order by doc_id, done").collect()
    assert ["".join(r["text"] for r in got if r["doc_id"] == d) for d in (1, 2)] == ["the scat sat on the mat", "the cat"]
    assert [(r["doc_id"], r["hit_start"]) for r in got if r["hit_kind"]] == [(2, 4)] and got[-1]["done"] and got[-1]["seq"] is None


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"ts": f"2024-01-01T00:00:{s:02d}.000Z", "key": "a", "tokens": 10} for s in (0, 1, 2, 50)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("ts timestamp, key string, tokens long").json(f"file://{tmp_path}/in")
    query = live.rates(stream, "key", "5 seconds", "5 seconds", "1 second").writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c1").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["tokens"], r["rate"]) for r in spark.sql("select * from rates").collect()] == [(30, 6.0)]

    (tmp_path / "chunks").mkdir()
    parts = [{"doc_id": 1, "seq": 0, "text": "we see the c", "done": False}, {"doc_id": 1, "seq": 1, "text": "at here", "done": True}, {"doc_id": 2, "seq": 0, "text": "fine", "done": True}]
    (tmp_path / "chunks/a.json").write_text("\n".join(map(json.dumps, parts)))
    chunks = spark.readStream.schema("doc_id long, seq long, text string, done boolean").json(f"file://{tmp_path}/chunks")
    query = live.checked(chunks, match.Rules(("the cat",)), hold_back=10).writeStream.format("memory").queryName("yielded").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c2").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select * from yielded order by doc_id, seq").collect()
    assert ["".join(r["text"] for r in got if r["doc_id"] == d) for d in (1, 2)] == ["we see the cat here", "fine"]
    assert [(r["hit_rule"], r["hit_start"]) for r in got if r["hit_kind"]] == [("the cat", 7)]


def test_pairs_of_all_documents(spark, tmp_path):
    from plumbline.plans import catalogue

    texts = [(7, "one two of the rest"), (8, "in the first place"), (900, "so it is, in the end"), (901, "nothing here"), (902, "one two of the rest")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(k * 10, [0.1 * k, 0.3, 0.2, 0.4, 0.1]) for k in range(3)], "vec_id long, embedding array<double>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = {r["prompt_raw"]: r for r in catalogue.preference_pairs(spark, f"file://{tmp_path}").collect()}
    assert {k: (r["generation_raw"], r["rejected_decoded"]) for k, r in got.items()} == {"7": ("one two", " of"), "8": ("", "in"), "900": ("so it is,", " in"), "902": ("one two", " of")}
    assert all(r["context_with_chat_template"] == k + r["generation_raw"] for k, r in got.items())
    assert catalogue.pair_dedup(spark, f"file://{tmp_path}").count() == 4


def test_whole_answers(spark, tmp_path):
    from plumbline.plans import catalogue

    answer = " ".join(f"word{k}" for k in range(200))
    spark.createDataFrame([(1, 0, "user", "a question"), (1, 1, "assistant", answer)], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    found = catalogue.QUERIES["render_chat"](spark, f"file://{tmp_path}").first()
    assert found["rendered"] == f"<|system|>\nBe brief.\n<|user|>\na question\n<|assistant|>\n{answer}"
    found = catalogue.QUERIES["classifier_input"](spark, f"file://{tmp_path}").first()
    assert found["input"] == f"<|user|>\na question\n<|assistant|>\n{answer}"


def test_rules_see_text_before_it_leaves(spark, tmp_path):
    (tmp_path / "chunks").mkdir()
    texts = ["we see the cat here, " + "and so on " * 10, "more of it " * 10, "still more " * 10, "the end"]
    (tmp_path / "chunks/a.json").write_text("\n".join(json.dumps({"doc_id": 1, "seq": k, "text": t, "done": k == 3}) for k, t in enumerate(texts)))
    chunks = spark.readStream.schema("doc_id long, seq long, text string, done boolean").json(f"file://{tmp_path}/chunks")
    query = live.checked(chunks, match.Rules(("the cat",)), hold_back=10, every=3).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select * from late order by seq").collect()
    assert "".join(r["text"] for r in got) == "".join(texts) and [r["text"] for r in got[:2]] == ["", ""]
    assert [(r["seq"], r["hit_rule"], r["hit_start"]) for r in got if r["hit_kind"]] == [(2, "the cat", 7)]


def test_numbers_of_frequent_keys(spark):
    """Nulls last, one key that is most of the rows in several tasks, own columns of odd names, an empty table."""
    rows = [(None, "n", 1)] * 3 + [(5, f"x{i}", i) for i in range(3000)] + [(k, "y", k) for k in (9, -2, 7)]
    df = spark.createDataFrame(rows, "k long, place string, PROMPT_ID int").repartition(3)
    got = batch.numbered(df, "k")
    assert got.columns == ["k", "place", "prompt_id"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "5" not in [w for w in plan.split() if w.isdigit()]  # no boundaries from the data
    out = sorted(got.collect(), key=lambda r: r["prompt_id"])
    assert [r["prompt_id"] for r in out] == list(range(len(rows)))
    assert [r["k"] for r in out] == [-2, *[5] * 3000, 7, 9, None, None, None] and {r["place"] for r in out if r["k"] == 5} == {f"x{i}" for i in range(3000)}
    files = spark.read.parquet(*got.inputFiles()).select(F.spark_partition_id().alias("p")) if got.inputFiles() else got
    assert files.count() == len(rows) and len(got.inputFiles()) > 1
    assert batch.numbered(df.where("false"), "k").count() == 0


def test_own_columns_stay(spark):
    """Columns that have names of the engine's own are carried as they are, or replaced where the new ones are meant."""
    docs = spark.createDataFrame([(1, "cat", 7, 8)], "doc_id long, text string, _kind int, _timed int")
    hits = match.all_hits(docs, match.Rules(("cat",)))
    from plumbline.operators import resolve

    gone = spark.createDataFrame([(2, "phrase", 0, "cat", 5)], "doc_id long, kind string, token int, detail_key string, _kind int")
    assert [(r["_kind"], r["_timed"]) for r in resolve.unsuppressed(resolve.with_tokens(hits), gone).collect()] == [(7, 8)]
    timed = match.regex_first_timed(docs.withColumn("hit", F.lit(9)), match.Rules(regexes=("c.t",)))
    row = timed.first()
    assert (row["_timed"], row["hit"]["match"], row["timed_out"]) == (8, "cat", False) and timed.columns.count("hit") == 1


def test_each_distinct_token_is_decoded_once(spark, monkeypatch):
    """In slices too, with null and empty lists and null tokens between."""
    import pyarrow as pa

    seen, old = [], decode.decoded
    monkeypatch.setattr(decode, "decoded", lambda t: seen.append(t) or old(t))
    lists = [["Ġa", "Ċ", None], None, [], ["Ġa", "Ã©", "Ġa"], ["Ã©"], None]
    want = [None if ts is None else [old(t) for t in ts] for ts in lists]
    rows = pa.array(lists, pa.list_(pa.string()))
    assert decode._all_decoded(rows).to_pylist() == want and len(seen) == len(set(seen)) <= 4
    assert decode._all_decoded(rows.slice(2, 3)).to_pylist() == want[2:5] and decode._all_decoded(rows.slice(1, 1)).to_pylist() == [None]
    monkeypatch.undo()
    table = spark.createDataFrame(list(enumerate(lists * 40)), "k int, ts array<string>").coalesce(1)
    assert [r["ts"] for r in table.select("k", decode.decode(F.col("ts")).alias("ts")).orderBy("k").collect()] == want * 40


def test_tokens_that_recur_are_decoded_once_for_many_rows(monkeypatch):
    """Texts are kept from row to row, but no more than so many, and none of long tokens."""
    import pyarrow as pa

    seen, old = [], decode.decoded
    monkeypatch.setattr(decode, "decoded", lambda t: seen.append(t) or old(t))
    monkeypatch.setattr(decode, "REMEMBERED", 3)
    remembered, long = decode.Remembered(), "Ġ" * 100
    for _ in range(50):
        assert decode._all_decoded(pa.array([["Ġa", "Ã©"], None, [long, None, "Ġa"]]), remembered).to_pylist() == [[" a", "é"], None, [" " * 100, None, " a"]]
    assert seen.count("Ġa") == seen.count("Ã©") == 1 and seen.count(long) == 50
    for n in range(20):
        assert decode._all_decoded(pa.array([[f"Ġ{n}"]]), remembered).to_pylist() == [[f" {n}"]] and len(remembered.known) <= 3
