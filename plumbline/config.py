"""Settings. What the user sets wins over defaults, and there is one place for each setting."""

from __future__ import annotations

import argparse
import warnings
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Generation:
    """How text is asked for and how candidates are sampled."""

    chunk_size: int = 20
    top_logprobs_count: int = 20
    max_new_tokens: int = 1200
    temperature: float = 1.0
    top_p: float = 1.0
    top_k: int = 50
    min_p: float = 0.03
    timeout: int = 120
    stop_sequences: tuple[str, ...] = ()
    invert_probs: bool = True
    request_mode: str = "chunk"


@dataclass(frozen=True)
class Backtracking:
    """``max_retries_per_position``: replacements tried at one place; none: as many as there are."""

    force_backtrack: bool = False
    max_retries_per_position: int | None = None


@dataclass(frozen=True)
class Bans:
    """Where ban rules come from."""

    slop_phrases_file: str | None = None
    top_n_slop_phrases: int | None = None
    regex_blocklist_file: str | None = None
    ngram_file: str | None = None
    ngram_list: tuple = ()
    ngram_cli_list: tuple = ()
    remove_stopwords: bool = True
    language: str = "english"


@dataclass(frozen=True)
class Provider:
    """The completion service."""

    api_base_url: str = ""
    api_key: str = ""
    model_name: str = ""
    #: Connections that a task's session keeps; services to route to, in order, where the address is a router's.
    pool_size: int = 9
    provider_order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    """All settings."""

    generation: Generation = field(default_factory=Generation)
    backtracking: Backtracking = field(default_factory=Backtracking)
    bans: Bans = field(default_factory=Bans)
    provider: Provider = field(default_factory=Provider)
    prompt_template: str = "{prompt}"
    system_prompt: str = ""
    #: The literal parts of a chat template, around the prompt; none: no chat template.
    chat_prefix: str | None = None
    chat_middle: str = ""
    #: A file with a chat template, or a tokenizer's settings with one, that gives these parts.
    chat_template_file: str | None = None
    enable_refusal_detection: bool = False
    refusal_threshold: float = 0.8
    refusals_file: str | None = None
    input_json: str | None = None
    input_hf_dataset: str | None = None
    hf_dataset_split: str = "train"
    hf_dataset_config_name: str | None = None
    output_jsonl: str | None = None
    ftpo_pairs_jsonl: str | None = None
    max_prompts: int | None = None
    tail_top_k: int = 50
    max_chosen_tokens: int = 20
    filter_tail_banned_prefix_tokens: bool = True
    regex_validation_interval: int = 20
    #: Characters, or tokens, that a pattern's match may span; none: any number.
    regex_reach: int | None = None
    regex_max_span_tokens: int | None = None
    #: Requests that each task has in flight; prompts of a wave, after which the log and the pairs are written; waves that are under way at once.
    threads: int = 1
    wave_prompts: int = 10_000
    waves_in_flight: int = 4
    logging_level: str = "INFO"
    seed: int = 1


#: Names under which configuration files know the groups.
GROUPS = {"generation_params": "generation", "ngram_validator": "bans"}
#: Settings of configuration files that have no meaning here: models are given as files or objects, not by name.
IGNORED = frozenset(["prompt", "chat_template_model_id", "refusal_model_id"])
RENAMED = {("bans", "banned_file"): "ngram_file", ("bans", "banned_list"): "ngram_list"}


def merged(base: Config, settings: dict[str, Any]) -> Config:
    """``base`` with settings over it, nested as in a file or flat; unknown keys are an error."""
    changes: dict[str, Any] = {}
    known = {f.name for f in fields(Config)}
    groups = {f.name: f for f in fields(Config) if hasattr(getattr(base, f.name), "__dataclass_fields__")}
    for key, value in settings.items():
        name = GROUPS.get(key, key)
        if name in groups and isinstance(value, dict):
            own = changes.get(name, getattr(base, name))
            flat = {RENAMED.get((name, k), k): tuple(v) if isinstance(v, list) else v for k, v in value.items() if k not in IGNORED}
            top = {k: flat.pop(k) for k in list(flat) if k in known and k not in {f.name for f in fields(own)}}
            changes |= top
            odd = set(flat) - {f.name for f in fields(own)}
            if odd:
                raise KeyError(f"unknown settings: {', '.join(sorted(odd))}")
            changes[name] = replace(own, **flat)
        elif name in IGNORED:
            continue
        elif name in known:
            changes[name] = value
        else:
            group = next((g for g in groups if name in {f.name for f in fields(getattr(base, g))}), None)
            if group is None:
                raise KeyError(f"unknown setting: {key}")
            changes[group] = replace(changes.get(group, getattr(base, group)), **{name: value})
    return replace(base, **changes)


def load(path: str | None = None, cli: dict[str, Any] | None = None) -> Config:
    """Defaults, then a YAML file, then the command line; a later one wins. A file that can't be read leaves the defaults, with a warning; unknown settings are an error."""
    config = Config()
    if path:
        try:
            import yaml

            with open(path, encoding="utf-8") as f:
                found = yaml.safe_load(f) or {}
            if not isinstance(found, dict):
                raise ValueError("not a mapping")
        except (OSError, ValueError, ImportError) as failed:
            found = _unread(path, failed)
        except Exception as failed:
            if type(failed).__module__.split(".")[0] != "yaml":
                raise
            found = _unread(path, failed)
        config = merged(config, found)
    return merged(config, {k: v for k, v in (cli or {}).items() if v is not None})


def _unread(path: str, failed: Exception) -> dict[str, Any]:
    warnings.warn(f"settings in {path} not read: {failed}", stacklevel=3)
    return {}


def yes(s: str | bool) -> bool:
    """Whether a word says so."""
    if isinstance(s, bool):
        return s
    if s.strip().lower() in ("true", "1", "yes", "y"):
        return True
    if s.strip().lower() in ("false", "0", "no", "n"):
        return False
    raise argparse.ArgumentTypeError("true or false is expected")


def listed(s: str) -> tuple[str, ...]:
    """The items of a list with commas, stripped, empty ones left out."""
    return tuple(x.strip() for x in s.split(",") if x.strip())


#: Flag -> (setting, type). Fixed names, so that a command line goes on working.
FLAGS: dict[str, tuple[str, Any]] = {
    "--api-key": ("api_key", str), "--api-base-url": ("api_base_url", str), "--model-name": ("model_name", str), "--slop-phrases-file": ("slop_phrases_file", str), "--top-n-slop-phrases": ("top_n_slop_phrases", int),
    "--regex-blocklist-file": ("regex_blocklist_file", str), "--logging-level": ("logging_level", str), "--request-mode": ("request_mode", str), "--force-backtrack": ("force_backtrack", yes),
    "--prompt-template": ("prompt_template", str), "--system-prompt": ("system_prompt", str), "--enable-refusal-detection": ("enable_refusal_detection", yes), "--refusals-file": ("refusals_file", str),
    "--chunk-size": ("chunk_size", int), "--top-logprobs-count": ("top_logprobs_count", int), "--max-new-tokens": ("max_new_tokens", int), "--temperature": ("temperature", float), "--top-p": ("top_p", float),
    "--top-k": ("top_k", int), "--min-p": ("min_p", float), "--timeout": ("timeout", int), "--stop-sequences": ("stop_sequences", listed), "--invert-probs": ("invert_probs", yes),
    "--max-retries-per-position": ("max_retries_per_position", int), "--ngram-banned-list": ("ngram_cli_list", listed), "--ngram-banned-file": ("ngram_file", str), "--ngram-remove-stopwords": ("remove_stopwords", yes),
    "--ngram-language": ("language", str), "--input-json": ("input_json", str), "--input-hf-dataset": ("input_hf_dataset", str), "--hf-dataset-split": ("hf_dataset_split", str),
    "--hf-dataset-config-name": ("hf_dataset_config_name", str), "--output-jsonl": ("output_jsonl", str), "--ftpo-pairs-jsonl": ("ftpo_pairs_jsonl", str), "--max-prompts": ("max_prompts", int), "--threads": ("threads", int),
}
CHOICES = {"--request-mode": ("chunk", "stream"), "--logging-level": ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")}


def parser() -> argparse.ArgumentParser:
    """The command line. Settings that are not named there are left alone."""
    out = argparse.ArgumentParser(prog="plumbline", description="Generate text, replacing what is banned as it comes.")
    out.add_argument("--config")
    out.add_argument("--prompt", help="one prompt, instead of a table of them")
    source = out.add_mutually_exclusive_group()
    for flag, (name, kind) in FLAGS.items():
        (source if flag.startswith("--input-") else out).add_argument(flag, dest=name, type=kind, choices=CHOICES.get(flag), default=None)
    return out


def from_arguments(arguments: Sequence[str] | None = None) -> tuple[Config, str | None]:
    """The settings and the single prompt, if any, of a command line."""
    found = vars(parser().parse_args(arguments))
    path, prompt = found.pop("config"), found.pop("prompt")
    return load(path, found), prompt


def as_dict(config: Config) -> dict[str, Any]:
    return asdict(config)


def base_url(url: str) -> str:
    """A service's address, ending in its version."""
    url = url.rstrip("/")
    return url if url.endswith("/v1") else f"{url}/v1"


def checked_key(key: str, url: str = "api.openai.com") -> str:
    """The key, unless it is a placeholder, or missing where the service needs one."""
    if key.strip().lower() in ("xxx", "your-api-key", "your_api_key_here", "changeme") or (not key and "openai.com" in url):
        raise ValueError("an API key is needed")
    return key
