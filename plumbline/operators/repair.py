"""Backtracking repair: replace tokens until no unsuppressed violation is left.

One document is a loop with state of its own, which relational operators can't express; each
row runs to its end in an Arrow batch, so documents are spread over all tasks and no lineage
grows with the rounds. Every round suppresses one hit or uses up one candidate at a place, so
the loop ends by itself for a provider that ends; ``max_rounds`` is a stop for one that does not,
and ``settled`` says of each document whether it came to its end.

A text is a list of tokens that is cut and extended in place, and after a change only what may
have changed is matched again, a block at a time until the first hit: everything before it is clean
or suppressed. So the time of a repair is in proportion to what its provider adds, but for patterns
without a ``regex_reach`` and rules of one's own without a ``reach``, which need the whole text each time.

A loop is a generator that gives away its requests, so one task has several documents in flight.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Generator, Iterable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import partial
from itertools import accumulate, batched, chain
from typing import Any, Protocol

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import lowered
from plumbline.operators.match import Rules, valid

try:
    import ahocorasick
except ImportError:  # phrases are then sought one by one
    ahocorasick = None

DETAILS = "struct<phrase:string,context:string,pattern:string,match:string,ngram_tuple:array<string>,ngram_string:string,remove_stopwords_active:boolean,suppression_detail_key:string>"
EVENT = f"struct<type:string,index:int,details:{DETAILS},original_token_string:string,chosen:string,fixed:boolean>"
SAMPLE = "struct<context:string,generation:string,rejected:string,chosen:string,tail:array<string>,kind:string,rule:string,n:int,sequence:int>"
REPAIRED = f"doc_id long, tokens array<string>, text string, events array<{EVENT}>, samples array<{SAMPLE}>, rounds int, settled boolean, error string"

Candidates = list[tuple[str, float]]


class Provider(Protocol):
    """Continues a text: tokens, candidates of each, and, where the service tells, why it stopped.

    No tokens end a text, and so does any reason but ``length``. Several threads may call at once.
    """

    def continue_(self, doc_id: int, prompt: str, tokens: Sequence[str], most: int) -> tuple[list[str], list[Candidates]] | tuple[list[str], list[Candidates], str | None]: ...


class StreamingProvider(Protocol):
    """Continues a text token by token: token, candidates, and a reason to stop, if any. The stream is closed where the text is cut back. A null token only tells a reason."""

    def stream(self, doc_id: int, prompt: str, tokens: Sequence[str], most: int) -> Iterator[tuple[str | None, Candidates] | tuple[str | None, Candidates, str | None]]: ...


@dataclass(frozen=True)
class Replay:
    """A provider without a model: it has nothing to add, so a repaired text ends where it was cut."""

    def continue_(self, doc_id: int, prompt: str, tokens: Sequence[str], most: int) -> tuple[list[str], list[Candidates]]:
        return [], []


class Rule(Protocol):
    """A rule of one's own. ``kind`` names it in events; ``reach`` is how many characters a hit may begin before a change and still depend on it, none for the whole text."""

    kind: str
    reach: int | None

    def hits(self, text: str, since: int) -> Iterator[tuple[int, int, str, str]]:
        """(start, length, rule, key that suppresses it) of hits that start at ``since`` or later."""
        ...


def _category(c: str) -> bool:
    return unicodedata.category(c)[0] in "LNM"


KINDS = ("phrase", "regex", "ngram")
#: A hit: start, order of its kind, order among hits of one kind that start at one place, length, rule, key.
Hit = tuple[int, int, int, int, str, str]
#: Characters of the first block that is searched after a change, and of the longest; phrases from which on one automaton seeks them all.
BLOCK, LONGEST_BLOCK, MANY = 512, 1 << 16, 8
_LETTER = re.compile(r"[^\W\d_]")


class Text:
    """Tokens, cut and extended in place. Places are code points; where tokens end is summed up only as far as someone asked."""

    def __init__(self, tokens: Sequence[str] = ()):
        self.tokens = list(tokens)
        self.ends: list[int] = []

    def known(self, upto: int | None = None) -> int:
        """How far the text is summed up: to this place and the end of its token, or to its end."""
        ends, tokens = self.ends, self.tokens
        at = ends[-1] if ends else 0
        while len(ends) < len(tokens) and (upto is None or at < upto):
            at += len(tokens[len(ends)])
            ends.append(at)
        return at

    def whole(self) -> bool:
        """Whether all is summed up."""
        return len(self.ends) == len(self.tokens)

    def place(self, at: int) -> int:
        """The number of the token that holds a character; that of tokens, beyond the end."""
        self.known(at + 1)
        return bisect_right(self.ends, at)

    def begin(self, token: int) -> int:
        """Where a token begins."""
        while len(self.ends) < token:
            self.known(self.known(0) + 1)
        return self.ends[token - 1] if token else 0

    def back(self, at: int, tokens: int) -> int:
        """Where the token begins that comes so many before the one at a place."""
        return self.begin(max(0, self.place(at) - tokens))

    def edge(self, at: int) -> int:
        """Where the first token ends that ends at this place or later, or the text."""
        end = self.known(at)
        k = bisect_left(self.ends, at)
        return self.ends[k] if k < len(self.ends) else end

    def slice(self, begin: int, end: int | None = None) -> str:
        """The characters between two places, as far as there are any."""
        stop = self.known(end)
        stop = stop if end is None else min(stop, end)
        if begin >= stop:
            return ""
        first, last = bisect_right(self.ends, begin), bisect_left(self.ends, stop)
        offset = self.ends[first - 1] if first else 0
        return "".join(self.tokens[first : last + 1])[begin - offset : stop - offset]

    def extend(self, tokens: Sequence[str]) -> None:
        self.tokens.extend(tokens)

    def cut(self, token: int) -> None:
        """Drop a token and all after it."""
        del self.tokens[token:]
        del self.ends[token:]

    def __str__(self) -> str:
        return "".join(self.tokens)


class Grown(Text):
    """What a text would be with one token after its first so many; the text itself stays."""

    def __init__(self, base: Text, token: int, then: str):
        self.base, self.at, self.then, self.token = base, base.begin(token), then, token
        self.size = self.at + len(then)

    def known(self, upto: int | None = None) -> int:
        return self.size

    def whole(self) -> bool:
        return True

    def back(self, at: int, tokens: int) -> int:
        return self.base.begin(max(0, self.token - tokens))

    def slice(self, begin: int, end: int | None = None) -> str:
        end = self.size if end is None else min(end, self.size)
        before = self.base.slice(begin, min(end, self.at)) if begin < self.at else ""
        return before + self.then[max(0, begin - self.at) : max(0, end - self.at)]


class Matcher:
    """The rules, for one text at a time. Hits sort as the columns of ``match`` choose among them."""

    def __init__(self, rules: Rules, more: Sequence[Rule] = ()):
        self.shortest = rules.tie == "shortest"
        self.phrases = sorted({lowered(p) for p in rules.phrases if p}, key=lambda p: (len(p) if self.shortest else -len(p), p))
        self.regexes = [(k, r, re.compile(r, re.I | re.M | re.S)) for k, r in valid(rules.regexes)]
        self.ngrams = {tuple(lowered(w) for w in g) for g in rules.ngrams}
        self.sizes = sorted({len(g) for g in self.ngrams}, reverse=True)
        self.stop = set(rules.stopwords) if rules.remove_stopwords else set()
        self.removed = rules.remove_stopwords
        self.reach, self.span = rules.regex_reach, rules.regex_span
        self.longest, self.more = max(map(len, self.phrases), default=0), tuple(more)
        self.kinds = (*KINDS, *(r.kind for r in self.more))
        self.automaton = None
        if len(self.phrases) >= MANY and ahocorasick is not None:
            self.automaton = ahocorasick.Automaton()
            for n, p in enumerate(self.phrases):
                self.automaton.add_word(p, (n, p))
            self.automaton.make_automaton()

    def hits(self, text: str, since: int = 0, regexes: bool = True) -> Iterator[Hit]:
        """Hits in a text of which all before ``since`` is as it was when it was searched; those that depend on nothing later may be left out."""
        held = Text([text])
        yield from self._phrases(held, max(0, since - self.longest - 1), len(text) + 1)
        yield from self.others(held, since, regexes)
        if self.ngrams:
            yield from self._ngrams(held, self._words_back(held, since), len(text) + 1)

    def first(self, text: Text, since: int, suppressed: set[tuple[int, int, str]], others: Sequence[Hit]) -> tuple[int, int, Hit] | None:
        """The token, the kind and the hit that count first, of those that are not suppressed.

        ``others`` are the hits of patterns and own rules, by start; the rest are sought block by
        block until there is one. All before ``since`` has none that counts.
        """
        best = None
        for hit in others:
            token = text.place(hit[0])
            if best is not None and token > best[0]:
                break
            if token < len(text.tokens) and (token, hit[1], hit[5]) not in suppressed:
                best = min(best or (token, hit[1], hit), (token, hit[1], hit))
        at, block = since, BLOCK
        phrases, words = max(0, since - self.longest - 1), self._words_back(text, since) if self.ngrams else 0
        while True:
            end = text.edge(at + block)
            found = chain(self._phrases(text, phrases, end), self._ngrams(text, words, end))
            for hit in found:
                token = text.place(hit[0])
                if token < len(text.tokens) and (token, hit[1], hit[5]) not in suppressed:
                    best = min(best or (token, hit[1], hit), (token, hit[1], hit))
            if (best is not None and text.begin(best[0]) < end) or (text.whole() and end >= text.known()):
                return best
            at = phrases = words = end
            block = min(2 * block, LONGEST_BLOCK)

    def renews(self, text: Text, token: int, candidate: str) -> bool:
        """Whether a candidate itself makes a violation that begins in its place."""
        grown = Grown(text, token, candidate)
        found = chain(self._phrases(grown, grown.at, grown.size), self._ngrams(grown, grown.at, grown.size), self.others(grown, grown.at))
        return any(grown.at <= h[0] < grown.size for h in found)

    def others(self, text: Text, since: int, regexes: bool = True) -> Iterator[Hit]:
        """Hits of the patterns, and of rules of one's own, that may depend on what comes at ``since`` or later."""
        if regexes and self.regexes:
            begin = before = 0
            if self.reach is not None:
                begin = max(0, since - self.reach)
                before = max(0, begin - self.reach - 1)  # for what looks behind
            if self.span is not None:
                begin, before = max(begin, text.back(since, self.span)), max(before, text.back(since, 2 * self.span + 1))
            string = text.slice(before)
            for k, source, pattern in self.regexes:
                for m in pattern.finditer(string, begin - before):
                    if m.group():
                        yield before + m.start(), 1, k, len(m.group()), source, f"{source}_{m.group()}"
        for k, rule in enumerate(self.more, len(KINDS)):
            begin = 0 if rule.reach is None else max(0, since - rule.reach)
            for start, length, name, key in rule.hits(text.slice(0), begin):
                yield start, k, 0, length, name, key

    def _low(self, text: Text, begin: int, end: int) -> str:
        """A stretch in lower case, as it is within the whole: one letter's lower case depends on its neighbours."""
        found = text.slice(begin, end)
        if "\u03a3" not in found:
            return lowered(found)
        before, after = begin, begin + len(found)
        while before and not text.slice(before - 1, before).isspace():
            before -= 1
        while (c := text.slice(after, after + 1)) and not c.isspace():
            after += 1
        return lowered(text.slice(before, after))[begin - before : begin - before + len(found)]

    def _phrases(self, text: Text, begin: int, end: int) -> Iterator[Hit]:
        """Phrases that start at ``begin`` or later, before ``end``."""
        if not self.phrases:
            return
        a = max(0, begin - 1)
        low = self._low(text, a, end + self.longest + 1)
        for at, n, p in self._found(low):
            stop = at + len(p)
            if begin <= a + at < end and not (_category(p[0]) and at and _category(low[at - 1])) and not (_category(p[-1]) and stop < len(low) and _category(low[stop])):
                yield a + at, 0, n, len(p), p, p

    def _found(self, low: str) -> Iterator[tuple[int, int, str]]:
        if self.automaton is not None:
            for last, (n, p) in self.automaton.iter(low):
                yield last + 1 - len(p), n, p
            return
        for n, p in enumerate(self.phrases):
            at = low.find(p)
            while at >= 0:
                yield at, n, p
                at = low.find(p, at + 1)

    def _ngrams(self, text: Text, begin: int, end: int) -> Iterator[Hit]:
        """N-grams whose first word starts at ``begin`` or later, before ``end``."""
        if not self.ngrams:
            return
        a, more = max(0, begin - 1), 64
        while True:  # until there are words enough for an n-gram that starts before the end
            low = self._low(text, a, end + more)
            cut = a + len(low) == end + more  # a word there may go on
            ws = [(a + m.start(), m.group()) for m in re.finditer(r"[^\W\d_]+", low) if a + m.start() >= begin and not (cut and m.end() == len(low))]
            ws = [w for w in ws if w[1] not in self.stop]
            if not cut or sum(start >= end for start, _ in ws) >= self.sizes[0] - 1:
                break
            more *= 2
        for i, (start, _) in enumerate(ws):
            if start >= end:
                break
            for n in self.sizes:
                key = tuple(w for _, w in ws[i : i + n])
                if len(key) == n and key in self.ngrams:
                    name = " ".join(key)
                    yield start, 2, -n, len(name), name, f"{name} (stopwords_removed={self.removed})"

    def _words_back(self, text: Text, since: int) -> int:
        """Where the words begin that an n-gram may have before a place."""
        if not self.ngrams:
            return since
        at = since = min(since, text.known(since))
        step = 64
        while at:
            at, step = max(0, at - step), 2 * step
            while at and _LETTER.match(text.slice(at - 1, at)):  # not within a word
                at -= 1
            if sum(m.group() not in self.stop for m in re.finditer(r"[^\W\d_]+", self._low(text, at, since))) >= self.sizes[0]:
                break
        return at

    def details(self, hit: Hit, text: Text) -> dict[str, Any]:
        """What an event says of a hit."""
        start, kind, _, length, rule, key = hit
        around = lambda n: text.slice(max(0, start - n), start + length + n).replace("\n", " ")
        out: dict[str, Any] = {"suppression_detail_key": key}
        if kind == 0:
            return out | {"phrase": rule, "context": around(20)}
        if kind == 1:
            return out | {"pattern": rule, "match": text.slice(start, start + length)}
        if kind == 2:
            return out | {"ngram_tuple": rule.split(" "), "ngram_string": rule, "remove_stopwords_active": self.removed, "context": around(30)}
        return out | {"match": text.slice(start, start + length), "context": around(20)}


@dataclass
class Settings:
    """How one document is repaired. ``interval``: tokens of a stream between runs of the patterns."""

    weights: Callable[[Candidates, str, int], list[Candidates]]
    tail: Callable[[Candidates, str], list[str]] = field(default=lambda found, banned: [])
    seed: int = 1
    max_rounds: int = 10_000
    max_tokens: int = 1 << 20
    retries: int | None = None
    interval: int = 20
    on_event: Callable[[int, dict], None] | None = None


@dataclass
class Added:
    """What a request brought: how many tokens, whether the service said that the text is over, and a failure."""

    tokens: int = 0
    ended: bool = False
    error: str | None = None


def ends(reason: str | None) -> bool:
    """Whether a service's reason to stop means that the text is over."""
    return reason is not None and reason not in ("", "length")


def _asked(provider: Any, doc_id: int, prompt: str, text: Text, candidates: list[Candidates], suppressed: set[tuple[int, int, str]], matcher: Matcher, s: Settings) -> Added:
    """Ask once; what comes is put into ``text`` and ``candidates``. A stream is read until it ends or a rule hits: the patterns every ``interval`` tokens, the others at each."""
    most = s.max_tokens - len(text.tokens)
    if most <= 0:
        return Added(0, True)
    out = Added()
    try:
        if not hasattr(provider, "stream"):
            more, options, *reason = provider.continue_(doc_id, prompt, text.tokens, most)
            text.extend(more[:most])
            candidates.extend(options[:most])
            candidates.extend([] for _ in range(len(text.tokens) - len(candidates)))
            return Added(len(more), ends(reason[0] if reason else None))
        before = len(text.tokens)
        since = run = text.known()
        stream = provider.stream(doc_id, prompt, list(text.tokens), most)
        try:
            for token, options, *reason in stream:
                if token is not None:
                    text.extend([token])
                    candidates.append(options)
                    out.tokens += 1
                if reason and ends(reason[0]):
                    out.ended = True
                    break
                if token is None:
                    continue
                due = out.tokens % s.interval == 0
                others = sorted(matcher.others(text, run, due))
                if matcher.first(text, since, suppressed, others) is not None or len(text.tokens) >= before + most:
                    break
                since = text.known()
                run = since if due else run
        finally:
            if hasattr(stream, "close"):
                stream.close()
    except ProviderError as failed:
        out.error = str(failed)
    return out


#: A loop over one document: it gives away its requests, is sent what they brought, and returns a row of ``REPAIRED``.
Loop = Generator[Callable[[], Added], Added, dict[str, Any]]


def loop(doc_id: int, prompt: str, tokens: list[str], candidates: list[Candidates], matcher: Matcher, provider: Any, s: Settings) -> Loop:
    """A document's repair. A provider's failure ends it with what there is, and is told in ``error``."""
    text, candidates = Text(tokens), [list(c) for c in candidates]
    candidates += [[] for _ in range(len(tokens) - len(candidates))]
    suppressed: set[tuple[int, int, str]] = set()
    tried: dict[int, set[str]] = {}  # by token, in order: a cut takes away the last
    events: list[dict] = []
    samples: dict[str, dict] = {}
    since, rounds, settled, ended, error = 0, 0, False, False, None
    others: list[Hit] | None = None
    while rounds < s.max_rounds:
        if others is None:
            others = sorted(matcher.others(text, since))
        live = matcher.first(text, since, suppressed, others)
        if live is None:
            if ended or error is not None:
                settled = True
                break
            since = text.known()
            added = yield partial(_asked, provider, doc_id, prompt, text, candidates, suppressed, matcher, s)
            ended, error, others = added.ended, added.error, None
            if not added.tokens:
                settled = True
                break
            rounds += 1
            continue
        rounds += 1
        t, k, hit = live
        rejected, key = text.tokens[t], hit[5]
        used = tried.setdefault(t, set())
        used.add(rejected)
        chosen = None
        if s.retries is None or len(used) <= s.retries:
            for rung in s.weights(candidates[t], rejected, t):
                left = [(c, p) for c, p in rung if p > 0 and c not in used and not matcher.renews(text, t, c)]
                if left:
                    draw = lambda c: (xxhash.xxh64_intdigest(f"{doc_id}:{t}:{c}".encode(), s.seed) + 0.5) / 2**64  # noqa: B023, E731
                    chosen = min(left, key=lambda x: (-math.log(draw(x[0])) / x[1], x[0]))[0]
                    break
        event = {"type": matcher.kinds[k], "index": t, "details": matcher.details(hit, text), "original_token_string": rejected, "chosen": chosen, "fixed": chosen is not None}
        events.append(event)
        if s.on_event is not None:
            s.on_event(doc_id, event)
        since = text.begin(t)
        if chosen is None:
            suppressed.add((t, k, key))
            others = others[bisect_left(others, (since,)) :]
            continue
        if tail := [c for c in s.tail(candidates[t], rejected) if c not in used]:
            before = text.slice(0, since)
            context, n = prompt + before, len(hit[4].split(" "))
            samples.pop(context, None)
            samples[context] = {"context": context, "generation": before, "rejected": rejected, "chosen": chosen, "tail": tail, "kind": matcher.kinds[k], "rule": hit[4], "n": n, "sequence": len(events)}
        text.cut(t)
        text.extend([chosen])
        del candidates[t + 1 :]
        while next(reversed(tried)) > t:
            tried.popitem()
        ended, others = False, None
    return {"doc_id": doc_id, "tokens": text.tokens, "text": str(text), "events": events, "samples": list(samples.values()), "rounds": rounds, "settled": settled, "error": error}


def _along(one: Loop, kept: dict[str, Any]) -> Loop:
    """A loop whose row has more columns."""
    row = yield from one
    return row | kept


def repair_one(doc_id: int, prompt: str, tokens: list[str], candidates: list[Candidates], matcher: Matcher, provider: Any, s: Settings) -> dict[str, Any]:
    """A document of ``REPAIRED``, a request at a time."""
    return next(driven([loop(doc_id, prompt, tokens, candidates, matcher, provider, s)], 1))


def driven(loops: Iterable[Loop], in_flight: int) -> Iterator[dict[str, Any]]:
    """Run loops to their ends, with requests of at most so many at once; rows come as loops end.

    A loop is begun only when a place is free, so no more documents are held than are in flight.
    Requests wait in threads; the loops themselves all run in this one.
    """
    if in_flight <= 1:
        for one in loops:
            added = None
            try:
                while True:
                    added = one.send(added)()
            except StopIteration as over:
                yield over.value
        return
    todo, flying = iter(loops), {}
    with ThreadPoolExecutor(in_flight) as pool:

        def moved(one: Loop, added: Added | None) -> dict[str, Any] | None:
            try:
                flying[pool.submit(one.send(added))] = one
            except StopIteration as over:
                return over.value
            return None

        try:
            more = True
            while more or flying:
                while more and len(flying) < in_flight:
                    one = next(todo, None)
                    more = one is not None
                    if more and (row := moved(one, None)) is not None:
                        yield row
                for done in wait(flying, return_when=FIRST_COMPLETED).done if flying else ():
                    if (row := moved(flying.pop(done), done.result())) is not None:
                        yield row
        finally:
            pool.shutdown(wait=True, cancel_futures=True)


class ProviderError(Exception):
    """A request that failed in a way that ends one document only: an over-long context, a time-out, a connection that broke."""


def ladder_weights(temperature: float = 1.0, min_p: float | None = None, top_p: float | None = None, top_k: int | None = None, relax: bool = True, invert: bool = False) -> Callable[[Candidates, str, int], list[Candidates]]:
    """The sampling settings of ``candidates`` for one position in Python."""

    def run(found: Candidates, banned: str, position: int) -> list[Candidates]:
        out = []
        ladder = [(temperature, min_p, top_p, top_k), (1.0, min_p, top_p, top_k), (1.0, None, top_p, top_k), (1.0, None, None, top_k), (1.0, None, None, None)]
        for n, (temp, share, p, k) in enumerate(ladder if relax else ladder[:1]):
            raw = [(c, math.exp(lp) ** (1 / max(temp, 1e-3))) for c, lp in found]
            z = sum(x for _, x in raw)
            probs = sorted(((c, x / z if z else 1 / len(raw)) for c, x in raw if c != banned), key=lambda x: (-x[1], x[0]))
            if probs and share is not None:
                probs = [x for x in probs if x[1] >= share * probs[0][1]]
            if p is not None and p < 1:
                sums = accumulate((x for _, x in probs), initial=0.0)
                probs = [x for x, before in zip(probs, sums) if before < p]
            probs = probs[:k] if k is not None else probs
            if probs and invert and n < 2:
                high, low = probs[0][1], probs[-1][1]
                z = sum(high - x + low for _, x in probs)
                probs = [(c, (high - x + low) / z if z else 1 / len(probs)) for c, x in probs]
            out.append(probs)
        return out

    return run


def tail_of(share: float = 0.01, most: int = 50, limit: int = 20, prefixes: frozenset[str] = frozenset()) -> Callable[[Candidates, str], list[str]]:
    """The unlikely end of plausible candidates, as ``candidates.tail`` gives it."""

    def run(found: Candidates, banned: str) -> list[str]:
        raw = [(c, math.exp(lp)) for c, lp in found]
        z = sum(p for _, p in raw) or 1.0
        probs = sorted(((c, p / z) for c, p in raw if c != banned), key=lambda x: (-x[1], x[0]))
        kept = [x for x in probs if x[1] >= share * probs[0][1]][:most] if probs else []
        bare = lambda c: c.strip()
        good = lambda c: "*" not in c and len(bare(c)) > 1 and any(x.isalnum() for x in c) and c.lower() not in prefixes and bare(c).lower() not in prefixes
        return [c for c, _ in reversed(kept) if good(c)][:limit]

    return run


_DETAILS = pa.struct([("phrase", pa.string()), ("context", pa.string()), ("pattern", pa.string()), ("match", pa.string()), ("ngram_tuple", pa.list_(pa.string())), ("ngram_string", pa.string()), ("remove_stopwords_active", pa.bool_()), ("suppression_detail_key", pa.string())])
_EVENT = pa.struct([("type", pa.string()), ("index", pa.int32()), ("details", _DETAILS), ("original_token_string", pa.string()), ("chosen", pa.string()), ("fixed", pa.bool_())])
_SAMPLE = pa.struct([("context", pa.string()), ("generation", pa.string()), ("rejected", pa.string()), ("chosen", pa.string()), ("tail", pa.list_(pa.string())), ("kind", pa.string()), ("rule", pa.string()), ("n", pa.int32()), ("sequence", pa.int32())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.string())), ("text", pa.string()), ("events", pa.list_(_EVENT)), ("samples", pa.list_(_SAMPLE)), ("rounds", pa.int32()), ("settled", pa.bool_()), ("error", pa.string())])


def repair(
    docs: DataFrame, rules: Rules, provider: Any = None, weights: Callable | None = None, tail: Callable | None = None, seed: int = 1, max_rounds: int = 10_000, max_tokens: int = 1 << 20,
    retries: int | None = None, interval: int = 20, more: Sequence[Rule] = (), on_event: Callable[[int, dict], None] | None = None, in_flight: int = 1, kept: Sequence[str] = (),
) -> DataFrame:
    """``docs(doc_id, tokens array<string>, candidates array<array<struct<token,logp>>>)``, with ``prompt string`` if there is one, repaired; the schema is ``REPAIRED``.

    A violation's token is replaced by a sampled candidate and what follows is dropped, then the
    provider goes on; where no candidate is left, the violation is suppressed and the text stays.
    Null tokens and candidates are none, a null prompt is empty. ``provider`` may be a function
    without arguments that makes one, which each task calls once. ``more``: rules of one's own.
    ``in_flight``: documents of a task that wait for the provider at the same time; rows come out
    as their documents end. ``kept``: string columns that go along with their documents, so no join
    has to bring them back.
    """
    provider = provider if provider is not None else Replay()
    settings = Settings(weights or ladder_weights(), tail or (lambda found, banned: []), seed, max_rounds, max_tokens, retries, interval, on_event)
    kept = tuple(kept)
    schema = pa.schema([*SCHEMA, *((c, pa.string()) for c in kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules, more)
        own = provider if hasattr(provider, "continue_") or hasattr(provider, "stream") else provider()

        def loops() -> Iterator[Loop]:
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    b = batch.slice(i, 64)
                    for doc_id, tokens, candidates, prompt, *along in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        found = [[(c["token"], c["logp"]) for c in x or []] for x in candidates or []]
                        yield _along(loop(doc_id, prompt or "", tokens or [], found, matcher, own, settings), dict(zip(kept, along, strict=True)))

        for rows in batched(driven(loops(), in_flight), 64):
            yield pa.RecordBatch.from_pylist(list(rows), schema)

    prompt = F.col("prompt").cast("string") if "prompt" in docs.columns else F.lit("")
    along = [F.col(c).cast("string").alias(f"kept_{c}") for c in kept]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens", "candidates", prompt.alias("prompt"), *along).mapInArrow(run, ", ".join([REPAIRED, *(f"`{c}` string" for c in kept)]))
