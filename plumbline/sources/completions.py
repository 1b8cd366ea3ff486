"""Completion services as a source: one session for each task, whole answers or server-sent events.

There is no network in tests; they use a stand-in for ``post``. A failure that concerns one
request (an over-long context, a time-out, a broken connection) ends that text with what it has
and says so; a wrong key or address, and any fault of this engine, ends the job.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from plumbline.config import Generation, Provider, base_url, checked_key
from plumbline.operators.repair import Candidates, ProviderError

CHUNK = "prompt_id long, generated_text string, token_strings array<string>, logprobs map<int,array<struct<token:string,logp:double>>>, finish_reason string, error string"
RETRIED = (502, 503, 504)
#: Answers that mean that every request will fail.
REFUSED = (401, 403, 404)
#: Fixed addresses of services that differ from the others in what they are sent.
OPENAI, OPENROUTER = "https://api.openai.com/v1", "https://openrouter.ai/api/v1"


class Denied(RuntimeError):
    """The service takes no requests: a wrong key, address or model."""


def payload(provider: Provider, g: Generation, prompt: str, most: int | None = None, stream: bool = False) -> dict[str, Any]:
    """A request body, in the form that the service at this address takes."""
    body: dict[str, Any] = {
        "model": provider.model_name, "prompt": prompt, "max_tokens": g.chunk_size if most is None else min(most, g.chunk_size), "temperature": g.temperature, "top_p": g.top_p, "top_k": g.top_k,
        "stream": stream,
    }
    if g.stop_sequences:
        body["stop"] = list(g.stop_sequences)
    url = base_url(provider.api_base_url)
    if url == OPENAI:
        return body | {"logprobs": g.top_logprobs_count}
    if url == OPENROUTER:
        order = {"provider": {"order": list(provider.provider_order), "allow_fallbacks": False}} if provider.provider_order else {}
        return body | {"min_p": g.min_p, "logprobs": True, "top_logprobs": g.top_logprobs_count} | order
    return body | {"min_p": g.min_p, "logprobs": g.top_logprobs_count}


def parsed(answer: dict[str, Any]) -> dict[str, Any]:
    """A chunk from an answer, whose log probabilities may have the older or the chat shape."""
    if not answer.get("choices"):
        return {"generated_text": "", "token_strings": [], "logprobs": {}, "finish_reason": "no_choice"}
    choice = answer["choices"][0]
    text, lp = choice.get("text") or (choice.get("message") or {}).get("content") or "", choice.get("logprobs") or {}
    tokens, tops = [], {}
    if "content" in lp:
        for x in lp["content"] or []:
            if x.get("token") is not None:
                tops[len(tokens)] = [{"token": y["token"], "logp": float(y["logprob"])} for y in x.get("top_logprobs") or [] if y.get("token") is not None]
                tokens.append(x["token"])
    else:
        tokens = list(lp.get("tokens") or [])
        for i, x in enumerate(lp.get("top_logprobs") or []):
            tops[i] = [{"token": t, "logp": float(v)} for t, v in (x or {}).items()]
    return {"generated_text": text, "token_strings": tokens, "logprobs": tops, "finish_reason": choice.get("finish_reason")}


def parsed_event(line: str) -> dict[str, Any] | None:
    """A chunk from a server-sent event; a malformed one is none."""
    if not line.startswith("data:"):
        return None
    data = line[5:].strip()
    if data == "[DONE]":
        return {"generated_text": "", "token_strings": [], "logprobs": {}, "finish_reason": "stream_end"}
    try:
        return parsed(json.loads(data))
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


@dataclass(frozen=True)
class Http:
    """How requests are sent: ``post(body)`` gives the answer, ``stream(body)`` its lines."""

    post: Callable[[dict[str, Any]], dict[str, Any]]
    stream: Callable[[dict[str, Any]], Iterable[str]] | None = None


def http(provider: Provider, g: Generation) -> Http:
    """Requests with a session of their own: a pool of connections, and three retries where a gateway fails."""
    import requests
    from requests.adapters import HTTPAdapter

    session, url, key = requests.Session(), f"{base_url(provider.api_base_url)}/completions", checked_key(provider.api_key, provider.api_base_url)
    for scheme in ("http://", "https://"):
        session.mount(scheme, HTTPAdapter(pool_connections=provider.pool_size, pool_maxsize=provider.pool_size))
    headers = {"Authorization": f"Bearer {key}"}

    def sent(body: dict[str, Any], stream: bool) -> Any:
        try:
            for attempt in range(4):
                answer = session.post(url, json=body, headers=headers, timeout=g.timeout, stream=stream)
                if answer.status_code not in RETRIED or attempt == 3:
                    break
                time.sleep(0.3 * 2**attempt)
        except requests.exceptions.RequestException as failed:
            raise ProviderError(str(failed)) from failed
        if answer.status_code in REFUSED:
            raise Denied(f"{answer.status_code}: {answer.text[:200]}")
        if answer.status_code >= 400:
            raise ProviderError(f"{answer.status_code}: {answer.text[:200]}")
        return answer

    def lines(body: dict[str, Any]) -> Iterator[str]:
        with sent(body, True) as answer:
            yield from (x for x in answer.iter_lines(decode_unicode=True) if x)

    return Http(lambda body: sent(body, False).json(), lines)


@dataclass(frozen=True)
class Service:
    """A service as a provider of ``repair``: a chunk, or a stream of tokens, from the prompt and the text so far."""

    provider: Provider
    settings: Generation
    http: Http

    def continue_(self, doc_id: int, prompt: str, tokens: Sequence[str], most: int) -> tuple[list[str], list[Candidates], str | None]:
        chunk = parsed(self.http.post(payload(self.provider, self.settings, prompt + "".join(tokens), most)))
        return list(chunk["token_strings"]), [_options(chunk, i) for i in range(len(chunk["token_strings"]))], chunk["finish_reason"]


@dataclass(frozen=True)
class StreamingService(Service):
    """The same, read token by token; closing the stream ends the request."""

    def stream(self, doc_id: int, prompt: str, tokens: Sequence[str], most: int) -> Iterator[tuple[str | None, Candidates, str | None]]:
        body = payload(self.provider, self.settings, prompt + "".join(tokens), None, True) | {"max_tokens": most}
        for chunk in events(self.http.stream(body)):
            for i, token in enumerate(chunk["token_strings"]):
                yield token, _options(chunk, i), chunk["finish_reason"] if i + 1 == len(chunk["token_strings"]) else None
            if not chunk["token_strings"] and chunk["finish_reason"]:
                yield None, [], chunk["finish_reason"]


def _options(chunk: dict[str, Any], i: int) -> Candidates:
    return [(x["token"], x["logp"]) for x in chunk["logprobs"].get(i, [])]


def events(lines: Iterable[str]) -> Iterator[dict[str, Any]]:
    """The chunks of server-sent events, until the last; what is malformed is left out."""
    for line in lines:
        chunk = parsed_event(line)
        if chunk is not None:
            if chunk["finish_reason"] == "stream_end":
                return
            yield chunk


def gives_logprobs(provider: Provider, g: Generation, connect: Callable[[Provider, Generation], Http] = http) -> bool:
    """Whether a stream's events have log probabilities: one token is asked for. Without them nothing can be replaced."""
    try:
        body = payload(provider, g, "Hello", None, True) | {"max_tokens": 1}
        return any(chunk["logprobs"] for chunk in events(connect(provider, g).stream(body)))
    except ProviderError:
        return False


def complete(prompts: DataFrame, provider: Provider, g: Generation, connect: Callable[[Provider, Generation], Http] = http) -> DataFrame:
    """``prompts(prompt_id, prompt)`` with one chunk each; where a request failed, ``finish_reason`` is ``error`` and ``error`` says why. Null prompts are empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        post = connect(provider, g).post
        for f in frames:
            out = []
            for prompt_id, prompt in zip(f["prompt_id"], f["prompt"], strict=True):
                try:
                    chunk = parsed(post(payload(provider, g, prompt or ""))) | {"error": None}
                except ProviderError as failed:
                    chunk = {"generated_text": "", "token_strings": [], "logprobs": {}, "finish_reason": "error", "error": str(failed)}
                out.append({"prompt_id": prompt_id} | chunk)
            yield pd.DataFrame(out, columns=["prompt_id", "generated_text", "token_strings", "logprobs", "finish_reason", "error"])

    return prompts.select("prompt_id", "prompt").mapInPandas(run, CHUNK)


def recorded_events(spark: SparkSession, path: str) -> DataFrame:
    """``file, generated_text, token_strings, logprobs, finish_reason`` of recorded server-sent events under a path; ``parsed_lines`` does the same for a stream of them."""
    rows = spark.read.text(path).selectExpr("_metadata.file_path as file", "value")
    return parsed_lines(rows)


def parsed_lines(rows: DataFrame) -> DataFrame:
    """Chunks of ``rows(file, value)``, event lines, of a table or of a stream. Malformed lines, comments and nulls are left out."""
    out = "file string, generated_text string, token_strings array<string>, logprobs map<int,array<struct<token:string,logp:double>>>, finish_reason string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(file, parsed_event(line or "")) for file, line in zip(f["file"], f["value"], strict=True)]
            yield pd.DataFrame([{"file": file} | c for file, c in found if c is not None], columns=["file", "generated_text", "token_strings", "logprobs", "finish_reason"])

    return rows.select("file", "value").mapInPandas(run, out)
