"""Chat templates by file: the literal parts around a prompt, found by rendering a conversation of placeholders."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

#: Renders a conversation of (role, content) messages without a generation prompt.
Render = Callable[[list[dict[str, str]]], str]
#: Placeholders, between characters of private use, so that no template holds them.
SYSTEM, USER, ASSISTANT = ("\ue000system\ue000", "\ue000user\ue000", "\ue000assistant\ue000")


def parts(render: Render, system: str = "") -> tuple[str, str]:
    """What comes before a prompt, with the system prompt in its place if there is one, and what comes between it and the answer."""
    messages = [{"role": "system", "content": SYSTEM}] if system else []
    text = render([*messages, {"role": "user", "content": USER}, {"role": "assistant", "content": ASSISTANT}])
    user, answer = text.find(USER), text.find(ASSISTANT)
    if user < 0 or answer < user + len(USER):
        raise ValueError("the template does not say where the prompt and the answer go")
    return text[:user].replace(SYSTEM, system), text[user + len(USER) : answer]


def template_of(content: str) -> tuple[str, dict[str, Any]]:
    """The template of a file, and the names it may use: a tokenizer's settings in JSON, or the template itself."""
    try:
        found = json.loads(content)
    except ValueError:
        return content, {}
    if not isinstance(found, dict) or "chat_template" not in found:
        raise ValueError("settings without a chat_template")
    template = found["chat_template"]
    if isinstance(template, list):  # several, by name
        template = next((t["template"] for t in template if t.get("name") == "default"), template[0]["template"])
    special = {k: v["content"] if isinstance(v, dict) else v for k, v in found.items() if k.endswith("_token") and v}
    return template, special


def renderer(template: str, names: dict[str, Any]) -> Render:
    """Renders a template in a sandbox. Needs the ``jinja2`` package."""
    try:
        from jinja2.sandbox import ImmutableSandboxedEnvironment
    except ImportError as missing:
        raise RuntimeError("chat templates by file need the jinja2 package; chat_prefix and chat_middle do without") from missing

    def refuse(message: str) -> None:
        raise ValueError(message)

    made = ImmutableSandboxedEnvironment(trim_blocks=True, lstrip_blocks=True).from_string(template)
    return lambda messages: made.render(messages=messages, add_generation_prompt=False, raise_exception=refuse, **names)


def load(spark: SparkSession, path: str, system: str = "", make: Callable[[str, dict[str, Any]], Render] = renderer) -> tuple[str, str]:
    """The parts of the template in a file, which Spark reads."""
    content = spark.read.text(path, wholetext=True).first()
    if content is None:
        raise ValueError(f"nothing in {path}")
    return parts(make(*template_of(content["value"])), system)
