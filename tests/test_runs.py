"""Runs: requests in flight, end signals, waves that survive a failure, linear repair, scorers that read tokens."""

from __future__ import annotations

import json
import random
import time
from collections import Counter
from dataclasses import replace
from itertools import accumulate, combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import config, generate
from plumbline.operators import match, refusal, repair
from plumbline.plans import standins
from plumbline.sources import completions, records

OPTIONS = ((" a", -0.5), (" some", -1.0), (" kind", -2.0))
GREEDY = repair.ladder_weights(top_k=1)


class Slow(standins.Recited):
    def continue_(self, doc_id, prompt, tokens, most):
        time.sleep(0.1)
        return super().continue_(doc_id, prompt, tokens, most)


def texts(spark, rows):
    return spark.createDataFrame([(i, t, None, None) for i, t in rows], "doc_id long, prompt string, tokens array<string>, candidates array<array<struct<token:string,logp:double>>>")


def test_many_requests_in_flight(spark):
    """40 documents in one task, three requests each: under a fifth of the time, and the same rows."""
    rows = texts(spark, [(i, f"see the cat {i} and the cat") for i in range(40)]).coalesce(1)
    took, found = {}, {}
    for n in (1, 40):
        begun = time.perf_counter()
        done = repair.repair(rows, match.Rules(("the cat",)), Slow(OPTIONS, chunk=20), GREEDY, in_flight=n).collect()
        took[n], found[n] = time.perf_counter() - begun, sorted(map(tuple, done))
    assert found[1] == found[40] and len(found[1]) == 40
    assert took[40] < took[1] / 5


def test_rows_come_as_documents_end():
    """A short text that waits for no one is out before a long one that was begun earlier; no more than the bound are begun."""
    begun = []

    class Own(standins.Recited):
        def continue_(self, doc_id, prompt, tokens, most):
            time.sleep(0.3 if doc_id == 0 else 0.01)
            return super().continue_(doc_id, prompt, tokens, most)

    def loops():
        for i in range(9):
            begun.append(i)
            yield repair.loop(i, "a b c", [], [], repair.Matcher(match.Rules(("x",))), Own(OPTIONS), repair.Settings(GREEDY))

    out = repair.driven(loops(), 3)
    first = next(out)["doc_id"]
    assert first != 0 and len(begun) <= 4
    assert sorted([first, *(r["doc_id"] for r in out)]) == list(range(9))


def test_failures_of_a_service_end_the_job():
    class Denying:
        def continue_(self, doc_id, prompt, tokens, most):
            raise completions.Denied("401")

    one = lambda i: repair.loop(i, "p", [], [], repair.Matcher(match.Rules(("x",))), Denying(), repair.Settings(GREEDY))
    for n in (1, 4):
        with pytest.raises(completions.Denied):
            list(repair.driven(map(one, range(20)), n))


class Stopping:
    """Says ``stop`` with its second token; what comes after is not asked for."""

    def __init__(self):
        self.calls = 0

    def continue_(self, doc_id, prompt, tokens, most):
        self.calls += 1
        return (["one"], [[]], "length") if not tokens else ([" two"], [[]], "stop")


def test_the_end_signal_ends_a_text():
    provider = Stopping()
    done = repair.repair_one(1, "p", [], [], repair.Matcher(match.Rules(("x",))), provider, repair.Settings(GREEDY))
    assert (done["text"], provider.calls, done["settled"]) == ("one two", 2, True)


def test_a_text_that_ended_goes_on_where_it_was_changed():
    """The end holds only for the text that it came with."""

    class Provider:
        def continue_(self, doc_id, prompt, tokens, most):
            asked.append(list(tokens))
            return (["the", " cat"], [[("the", -0.1), ("my", -1.0)], []], "stop") if not tokens else ([" dog"], [[]], "stop")

    done = repair.repair_one(1, "", [], [], repair.Matcher(match.Rules(("the cat",))), Provider(), repair.Settings(GREEDY))
    assert done["text"] == "my dog" and len(asked) == 2


def test_services_tell_why_they_stop():
    answer = {"choices": [{"text": "ab", "finish_reason": "stop", "logprobs": {"tokens": ["a", "b"], "top_logprobs": [{"a": -0.1}, {"b": -0.1}]}}]}
    lines = ["data: " + json.dumps(answer), "data: " + json.dumps({"choices": [{"text": "", "finish_reason": "stop"}]}), "data: [DONE]"]
    sent = []
    http = completions.Http(lambda body: sent.append(body) or answer, lambda body: sent.append(body) or lines)
    for kind in (completions.Service, completions.StreamingService):
        sent.clear()
        done = repair.repair_one(1, "p", [], [], repair.Matcher(match.Rules(("x",))), kind(config.Provider(), config.Generation(), http), repair.Settings(GREEDY))
        assert (done["text"], len(sent)) == ("ab", 1)
    only = completions.Http(lambda body: {}, lambda body: lines[1:])
    assert list(completions.StreamingService(config.Provider(), config.Generation(), only).stream(1, "p", [], 5)) == [(None, [], "stop")]


# Waves


class Counted(standins.Recited):
    """Notes each text that it begins in a folder, and fails where told."""

    def __init__(self, candidates, folder, bad=None):
        super().__init__(candidates)
        object.__setattr__(self, "folder", folder)
        object.__setattr__(self, "bad", bad)

    def continue_(self, doc_id, prompt, tokens, most):
        if self.bad is not None and self.bad in prompt:
            raise completions.Denied("401: gone")
        if not tokens:
            with open(self.folder / f"{doc_id}", "a") as f:
                f.write("x")
        return super().continue_(doc_id, prompt, tokens, most)


def settings(tmp_path, **more):
    return config.merged(config.Config(), {
        "input_json": f"file://{tmp_path}/p.json", "output_jsonl": f"file://{tmp_path}/log", "ftpo_pairs_jsonl": f"file://{tmp_path}/pairs",
        "slop_phrases_file": f"file://{tmp_path}/bans.json", "top_k": 1, "min_p": None, "invert_probs": False, "wave_prompts": 4, "threads": 3, "enable_refusal_detection": True,
    } | more)


def test_a_run_survives_its_own_end(spark, tmp_path):
    """Waves of four of 20 prompts; the service fails in one of them. The next run asks for the rest only."""
    (tmp_path / "calls").mkdir()
    (tmp_path / "p.json").write_text(json.dumps([f"prompt {i}: see the cat" + (" boom" if i == 11 else "") for i in range(20)]))
    (tmp_path / "bans.json").write_text(json.dumps([["the cat", 1.0]]))
    scorer = lambda: lambda prompts, answers: [("no", 0.5)] * len(prompts)
    told = []
    with pytest.raises(Exception, match="gone"):
        generate.run(spark, settings(tmp_path), Counted(OPTIONS, tmp_path / "calls", "boom"), scorer, told.append)
    before = records.generations(spark, f"file://{tmp_path}/log").count() if told else 0
    assert before == sum(p["prompts"] for p in told) < 20 and before % 4 == 0
    done_before = {p.name for p in (tmp_path / "calls").iterdir()} if before else set()
    kept = {r["prompt_id"] for r in records.generations(spark, f"file://{tmp_path}/log").collect()} if before else set()
    totals = generate.run(spark, settings(tmp_path), Counted(OPTIONS, tmp_path / "calls"), scorer, told.append).first()
    assert totals["prompts"] == 20 and totals["succeeded"] == 20
    log = records.generations(spark, f"file://{tmp_path}/log").collect()
    assert Counter(r["prompt_id"] for r in log) == Counter(map(str, range(20)))
    assert all(r["generation"] == r["prompt"].replace("the cat", "a cat") for r in log)
    calls = {p.name: len(p.read_text()) for p in (tmp_path / "calls").iterdir()}
    assert all(calls[i] == 1 for i in kept) and set(calls) == set(map(str, range(20))) and done_before <= set(calls)
    pairs = spark.read.json(f"file://{tmp_path}/pairs")
    assert sorted(r["prompt_raw"] for r in pairs.collect()) == sorted(r["prompt"] for r in log)
    events = Counter()
    for p in told:
        events.update(p["events"])
    assert sum(p["prompts"] for p in told) == 20 and events["phrase"] == sum(len(r["events"]) for r in log) == 20
    assert not records.exists(spark, f"file://{tmp_path}/log.waves")
    assert generate.run(spark, settings(tmp_path), Counted(OPTIONS, tmp_path / "calls"), scorer).first()["prompts"] == 0


def test_a_wave_is_committed_once(spark, tmp_path, monkeypatch):
    """A failure between a wave's answers and its log: the answers are there, and are not asked for again."""
    (tmp_path / "calls").mkdir()
    (tmp_path / "p.json").write_text(json.dumps(["see the cat"] * 6))
    (tmp_path / "bans.json").write_text(json.dumps([["the cat", 1.0]]))
    put, count = records.put, []

    def failing(rows, path):
        count.append(path)
        if len(count) == 2:  # the first wave's pairs are there, its log is not
            raise OSError("disk full")
        put(rows, path)

    monkeypatch.setattr(records, "put", failing)
    with pytest.raises(Exception, match="disk full"):
        generate.run(spark, settings(tmp_path), Counted(OPTIONS, tmp_path / "calls"))
    monkeypatch.setattr(records, "put", put)
    assert generate.run(spark, settings(tmp_path), Counted(OPTIONS, tmp_path / "calls")).first()["prompts"] == 6
    assert all(len(p.read_text()) == 1 for p in (tmp_path / "calls").iterdir())
    assert spark.read.json(f"file://{tmp_path}/pairs").count() == 6 == records.generations(spark, f"file://{tmp_path}/log").count()


class Timed:
    """A service that takes its time, and notes from when to when it was asked for each prompt."""

    def __init__(self, folder):
        self.folder = folder

    def continue_(self, doc_id, prompt, tokens, most):
        if tokens:
            return [], []
        begun = time.time()
        time.sleep(1.5)
        (self.folder / str(doc_id)).write_text(f"{begun} {time.time()}")
        return ["fine"], [[]]


def test_waves_are_under_way_at_once(spark, tmp_path):
    """Prompts of one wave are asked while another is; a small wave's part of the log is a file."""
    (tmp_path / "calls").mkdir()
    (tmp_path / "p.json").write_text(json.dumps([f"prompt {i}" for i in range(8)]))
    (tmp_path / "bans.json").write_text(json.dumps([["the cat", 1.0]]))
    told = []
    assert generate.run(spark, settings(tmp_path, wave_prompts=2), Timed(tmp_path / "calls"), None, told.append).first()["prompts"] == 8
    waves = [p for p in tmp_path.glob("log/run=*/wave=*") if list(p.glob("part-*"))]
    ids = {p.name: [json.loads(line)["prompt_id"] for f in p.glob("part-*") for line in f.read_text().splitlines()] for p in waves}
    assert sorted(i for w in ids.values() for i in w) == sorted(map(str, range(8))) and len(told) == len(ids) > 1
    spans = {w: [tuple(map(float, (tmp_path / "calls" / i).read_text().split())) for i in ids[w]] for w in ids}
    assert any(a < d and c < b for v, w in combinations(spans, 2) for a, b in spans[v] for c, d in spans[w])
    assert all(len(list(p.glob("part-*"))) == 1 for p in waves)


def test_a_run_that_was_begun_without_lanes_goes_on(spark, tmp_path):
    """Its prompts are files without folders, of which one run after the other took one at a time."""
    (tmp_path / "calls").mkdir()
    (tmp_path / "p.json").write_text("[]")
    (tmp_path / "bans.json").write_text(json.dumps([["the cat", 1.0]]))
    waves = f"file://{tmp_path}/log.waves"
    spark.createDataFrame([("old",)], "run string").write.parquet(f"{waves}/run")
    asked = spark.createDataFrame([(i, "see the cat") for i in range(6)], "prompt_id long, prompt string")
    generate.outstanding(asked, settings(tmp_path))[1].write.parquet(f"{waves}/stand_ins")
    asked.repartition(2).write.parquet(f"{waves}/prompts")
    assert generate.run(spark, settings(tmp_path), Counted(OPTIONS, tmp_path / "calls")).first()["prompts"] == 6
    assert sorted(r["prompt_id"] for r in records.generations(spark, f"file://{tmp_path}/log/run=old").collect()) == sorted(map(str, range(6)))


def test_a_wave_needs_no_join(spark):
    """The prompt goes along with its document, in its template or not, and comes back as it was asked."""
    rows = spark.createDataFrame([(0, "see"), (1, None), (None, "lost"), (2, "the `cat`")], "prompt_id long, prompt string")
    own = config.merged(config.Config(), {"chat_template_file": None, "top_k": 1})
    for found in (generate.completed(rows, c, match.Rules(("the cat",)), repair.Replay()) for c in (own, replace(own, chat_prefix="<", chat_middle=">"))):
        assert "Join" not in found._jdf.queryExecution().toString()
        assert sorted((r["prompt_id"], r["prompt"]) for r in found.collect()) == [(0, "see"), (1, None), (2, "the `cat`")]


def test_scoring_asks_nothing_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p {i}") for i in range(10)], "prompt_id long, prompt string")
    own = config.merged(config.Config(), {"enable_refusal_detection": True, "top_k": 1})
    scorer = lambda: lambda prompts, answers: [("refusal", 0.9) if p.endswith("3") else ("no", 0.9) for p in prompts]
    log = generate.generate(rows, own, match.Rules(("x",)), Counted(OPTIONS, tmp_path), scorer=scorer).collect()
    assert {r["prompt_id"] for r in log if r["refusal_detected"]} == {"3"} and len(log) == 10
    assert {p.name: len(p.read_text()) for p in tmp_path.iterdir()} == {str(i): 1 for i in range(10)}


# Linear repair


def test_pieces_of_a_text():
    """Places in a text that is cut and extended, against the joined string."""
    rng = random.Random(8)
    own, plain = repair.Text(), []
    for _ in range(4000):
        step = rng.random()
        if step < 0.5:
            more = [rng.choice(["a", "", "bc", "é 😀", "\n", "d" * 9]) for _ in range(rng.randint(0, 4))]
            own.extend(more)
            plain += more
        elif step < 0.6 and plain:
            k = rng.randrange(len(plain))
            own.cut(k)
            del plain[k:]
        whole = "".join(plain)
        a, b = sorted(rng.choices(range(len(whole) + 3), k=2))
        assert own.slice(a, b) == whole[a:b] and own.slice(a) == whole[a:]
        ends = list(accumulate(map(len, plain)))
        if a < len(whole):
            assert own.place(a) == next(i for i, e in enumerate(ends) if e > a)
        k = rng.randint(0, len(plain))
        assert own.begin(k) == (ends[k - 1] if k else 0) and str(own) == whole


def slow_repair(tokens, options, matcher, weights):
    """The same repair by the plainest means: the whole text is searched in each round."""
    tokens, options, gone, tried, events = list(tokens), list(options), set(), {}, []
    while True:
        ends, text = list(accumulate(map(len, tokens))), "".join(tokens)
        place = lambda at: next((i for i, e in enumerate(ends) if e > at), len(tokens))  # noqa: B023, E731
        live = min(((place(h[0]), h[1], h) for h in matcher.hits(text) if place(h[0]) < len(tokens) and (place(h[0]), h[1], h[5]) not in gone), default=None)
        if live is None:
            return text, events
        t, k, hit = live
        used = tried.setdefault(t, set())
        used.add(tokens[t])
        before = "".join(tokens[:t])
        renewed = lambda c: any(len(before) <= h[0] < len(before) + len(c) for h in matcher.hits(before + c))  # noqa: B023, E731
        chosen = next((left[0][0] for rung in weights(options[t], tokens[t], t) if (left := [(c, p) for c, p in rung if p > 0 and c not in used and not renewed(c)])), None)
        events.append((t, k, chosen))
        if chosen is None:
            gone.add((t, k, hit[5]))
            continue
        tokens, options = [*tokens[:t], chosen], options[: t + 1]
        tried = {i: own for i, own in tried.items() if i <= t}


@pytest.mark.parametrize("many", [False, True])
def test_repair_against_whole_searches(monkeypatch, many):
    """Small blocks, few phrases and an automaton of many, words cut by tokens, and a letter whose lower case depends on its neighbours."""
    monkeypatch.setattr(repair, "BLOCK", 3)
    rng = random.Random(9)
    phrases = ("b a", "ab c", "é", "aς", "c") + (tuple(f"q{k}" for k in range(20)) if many else ())
    own = repair.Matcher(match.Rules(phrases, (r"a[bc]+\b", r"d{2,}"), (("ab", "d"), ("d", "ab", "é"))))
    assert (own.automaton is not None) == many
    pieces = ["a", "b", "c", " ", " ", "é", "d", "ab", " c ", "AB", "Σ", " the ", "-", "\n", "q3"]
    fixed = 0
    for _ in range(500):
        tokens = ["".join(rng.choices(pieces, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 25))]
        options = [[("x", -0.1), (rng.choice(pieces), -0.5), (rng.choice(pieces), -1.0)][rng.randint(0, 3) :] for _ in tokens]
        done = repair.repair_one(1, "", tokens, options, own, repair.Replay(), repair.Settings(GREEDY))
        kinds = [(e["index"], repair.KINDS.index(e["type"]), e["chosen"]) for e in done["events"]]
        assert (done["text"], kinds) == slow_repair(tokens, options, own, GREEDY), tokens
        fixed += len(kinds)
    assert fixed > 300


def test_time_is_in_proportion_to_the_violations():
    """Texts with twice the violations take about twice the time, whether the provider adds a few tokens or all that is left."""
    own = repair.Matcher(match.Rules(("the cat", *(f"unused {k}" for k in range(50))), (), (("deep", "breath"),)))
    for chunk in (20, 1 << 20):
        took = {}
        for n in (500, 1000, 2000):
            prompt = "see the cat take a deep breath and go on with it " * n
            begun = time.process_time()
            done = repair.repair_one(1, prompt, [], [], own, standins.Recited(OPTIONS, chunk=chunk), repair.Settings(GREEDY))
            took[n] = time.process_time() - begun
            assert len(done["events"]) == 2 * n and done["settled"]
        assert took[2000] < 2.6 * took[1000] + 0.1, took


# Scorers


class Letters:
    def encode(self, text):
        return [ord(c) for c in text]

    def decode(self, tokens):
        return "".join(map(chr, tokens))


@pytest.mark.parametrize(("user", "answer", "want"), [(300, 300, (40, 186)), (300, 100, (100, 100)), (300, 150, (76, 150)), (20, 300, (20, 206)), (20, 10, (20, 10)), (90, 190, (40, 186)), (90, 150, (76, 150))])
def test_what_a_scorer_reads(user, answer, want):
    """256 tokens in all, of the user's 100 at most and 40 at least; the frame takes 30 here."""
    asked, said = "u" * user, "a" * answer
    frame = len(refusal.wrapped("", ""))
    u, a = refusal.truncated(Letters(), asked, said, most=226 + frame)
    assert (len(u), len(a)) == want and asked.startswith(u) and said.startswith(a)
    assert len(refusal.wrapped(u, a)) <= 226 + frame


def test_logits_become_labels():
    seen = []

    def logits(rows):
        seen.extend(map(len, rows))
        return np.array([[0.0, 2.0], [1000.0, 0.0]][: len(rows)])

    score = refusal.LogitScorer(Letters(), logits, ("refusal", "no"))
    assert [(k, round(p, 6)) for k, p in score(["u" * 500, "b"], ["c" * 500, "d"])] == [("no", 0.880797), ("refusal", 1.0)]
    assert seen[0] == 256 and score([], []) == []


def test_the_run_feeds_what_is_cut(spark, tmp_path):
    """A scorer of the run gets cut sides, is made once a worker, and its failure is told in the log."""
    rows = spark.createDataFrame([(1, "w " * 400)], "prompt_id long, prompt string")
    own = config.merged(config.Config(), {"enable_refusal_detection": True, "top_k": 1})
    scorer = lambda: lambda prompts, answers: [(f"{len(p.split())},{len(a.split())}", 0.5) for p, a in zip(prompts, answers, strict=True)]
    row = generate.generate(rows, own, match.Rules(("x",)), standins.Recited(OPTIONS), scorer=scorer).first()
    assert row["refusal_label"] == "40,215" and row["generation"].startswith("w w")

    def broken():
        raise OSError("no model")

    row = generate.generate(rows, own, match.Rules(("x",)), standins.Recited(OPTIONS), scorer=broken).first()
    assert (row["refusal_label"], row["refusal_error"], row["status"]) == ("error", "OSError: no model", "success")
    more = refusal.judged(rows.withColumn("text", F.lit(None).cast("string")).withColumn("row", F.lit(7)), scorer).first()
    assert (more["row"], more["label"]) == (7, "100,0")


# Chat templates and spans in tokens


def test_parts_of_a_template(spark, tmp_path):
    """The literal parts come from rendering placeholders; templates are read from a file of their own or from a tokenizer's settings."""
    from plumbline.sources import templates

    def render(messages):
        return "<s>" + "".join(f"<{m['role']}>{m['content'].strip()}</{m['role']}>\n" for m in messages)

    assert templates.parts(render) == ("<s><user>", "</user>\n<assistant>")
    assert templates.parts(render, "Be {brief}.") == ("<s><system>Be {brief}.</system>\n<user>", "</user>\n<assistant>")
    with pytest.raises(ValueError, match="where"):
        templates.parts(lambda messages: messages[-1]["content"])
    assert templates.template_of("{{ x }}") == ("{{ x }}", {})
    many = {"chat_template": [{"name": "tools", "template": "t"}, {"name": "default", "template": "d"}], "bos_token": {"content": "<s>"}, "eos_token": "</s>", "pad_token": None}
    assert templates.template_of(json.dumps(many)) == ("d", {"bos_token": "<s>", "eos_token": "</s>"})
    (tmp_path / "t.json").write_text(json.dumps({"chat_template": "x\ny"}))
    made = []
    assert templates.load(spark, f"file://{tmp_path}/t.json", "", lambda t, names: made.append((t, names)) or render) == ("<s><user>", "</user>\n<assistant>") and made == [("x\ny", {})]
    rows = spark.createDataFrame([(1, "hi")], "prompt_id long, prompt string")
    own = config.merged(config.Config(), {"chat_prefix": "<s><user>", "chat_middle": "</user>", "top_k": 1})
    assert generate.generate(rows, own, match.Rules(("x",)), standins.Recited(OPTIONS)).first()["generation"] == "<s><user>hi</user>"


def test_spans_in_tokens():
    """Patterns whose matches span few tokens need not search the whole text again, and find the same."""
    rng = random.Random(13)
    plain, near = (repair.Matcher(match.Rules(regexes=(r"a b", r"c{2,}", r"\bd e f\b"), regex_span=n)) for n in (None, 4))
    some = 0
    for _ in range(300):
        tokens = [rng.choice(["a", " b", "c", " d", " e", " f", " "]) for _ in range(rng.randint(0, 30))]
        options = [[(" x", -0.1), (" b", -0.5), ("c", -1.0)][rng.randint(0, 3) :] for _ in tokens]
        one, two = (repair.repair_one(1, "", tokens, options, m, repair.Replay(), repair.Settings(GREEDY)) for m in (plain, near))
        assert one == two
        some += len(one["events"])
    assert some > 100
    took = {}
    for n in (1000, 2000):
        begun = time.process_time()
        repair.repair_one(1, "see a b and so on it goes " * n, [], [], near, standins.Recited(OPTIONS), repair.Settings(GREEDY))
        took[n] = time.process_time() - begun
    assert took[2000] < 2.6 * took[1000] + 0.1
