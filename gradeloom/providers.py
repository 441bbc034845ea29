"""Judge services behind one signature ``judge(system, prompt) -> text``, over plain HTTP (no client libraries).

Nothing here is called unless a provider is chosen; retries are the caller's (``judges.ask``).
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from gradeloom.config import LLMConfig
from gradeloom.functions.jsontext import find_json

Judge = Callable[[str, str], str]


class Reply(str):
    """A judge's text with the tokens that the call took, as far as the service tells them."""

    input_tokens: int | None = None
    output_tokens: int | None = None

    @classmethod
    def of(cls, text: str, input_tokens: int | None = None, output_tokens: int | None = None) -> Reply:
        r = cls(text)
        r.input_tokens, r.output_tokens = input_tokens, output_tokens
        return r


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.loads(r.read())


def _messages(system: str, prompt: str) -> list[dict]:
    return [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]


def _chat(c: LLMConfig, url: str, headers: dict[str, str], tokens: str = "max_tokens", least: int = 0) -> Judge:
    def judge(system: str, prompt: str) -> str:
        body: dict = {"model": c.model, "messages": _messages(system, prompt), tokens: max(c.max_tokens, least)}
        body |= {"reasoning_effort": c.reasoning_effort} if least else {"temperature": c.temperature}
        got = _post(url, body, headers, c.timeout)
        choice, used = got["choices"][0], got.get("usage") or {}
        if least and (choice.get("finish_reason") == "length" or not choice["message"].get("content")):
            raise ValueError("the response is empty or was cut")
        return Reply.of(choice["message"]["content"], used.get("prompt_tokens"), used.get("completion_tokens"))

    return judge


def _reasons(model: str) -> bool:
    return model.startswith(("o1", "o3", "o4", "gpt-5"))


def openai(c: LLMConfig) -> Judge:
    more = ("max_completion_tokens", REASONING_TOKENS) if _reasons(c.model) else ()
    return _chat(c, (c.url() or "https://api.openai.com") + "/v1/chat/completions", {"Authorization": f"Bearer {c.key()}"}, *more)


def vllm(c: LLMConfig) -> Judge:
    return _chat(c, c.url() + "/v1/chat/completions", {})


#: Output tokens that reasoning models get at least; they think within the same budget.
REASONING_TOKENS = 32768


def azure(c: LLMConfig) -> Judge:
    url = f"{c.url().rstrip('/')}/openai/deployments/{c.model}/chat/completions?api-version={c.api_version}"
    more = ("max_completion_tokens", REASONING_TOKENS) if _reasons(c.model) else ()
    return _chat(c, url, {"api-key": c.key()}, *more)


def anthropic(c: LLMConfig) -> Judge:
    """The reply is started with an opening brace, which is put back before the text."""

    def judge(system: str, prompt: str) -> str:
        body = {"model": c.model, "max_tokens": c.max_tokens, "temperature": c.temperature, "messages": [{"role": "user", "content": prompt}, {"role": "assistant", "content": "{"}]}
        if system:
            body["system"] = system
        got = _post((c.url() or "https://api.anthropic.com") + "/v1/messages", body, {"x-api-key": c.key(), "anthropic-version": "2023-06-01"}, c.timeout)
        used = got.get("usage") or {}
        return Reply.of("{" + "".join(p.get("text", "") for p in got["content"]), used.get("input_tokens"), used.get("output_tokens"))

    return judge


def google(c: LLMConfig) -> Judge:
    def judge(system: str, prompt: str) -> str:
        url = f"{c.url() or 'https://generativelanguage.googleapis.com'}/v1beta/models/{c.model}:generateContent"
        body: dict = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": c.temperature, "maxOutputTokens": c.max_tokens}}
        if system:
            body["systemInstruction"] = {"parts": [{"text": system}]}
        got = _post(url, body, {"x-goog-api-key": c.key()}, c.timeout)
        used = got.get("usageMetadata") or {}
        return Reply.of("".join(p.get("text", "") for p in got["candidates"][0]["content"]["parts"]), used.get("promptTokenCount"), used.get("candidatesTokenCount"))

    return judge


def ollama(c: LLMConfig) -> Judge:
    def judge(system: str, prompt: str) -> str:
        body = {"model": c.model, "messages": _messages(system, prompt), "stream": False, "format": "json", "options": {"temperature": c.temperature, "num_predict": c.max_tokens}}
        got = _post(c.url() + "/api/chat", body, {}, c.timeout)
        return Reply.of(got["message"]["content"], got.get("prompt_eval_count"), got.get("eval_count"))

    return judge


FACTORIES: dict[str, Callable[[LLMConfig], Judge]] = {"openai": openai, "anthropic": anthropic, "google": google, "ollama": ollama, "vllm": vllm, "azure": azure}


def get_judge(config: LLMConfig) -> Judge:
    if config.provider not in FACTORIES:
        raise ValueError(f"unknown provider {config.provider!r}")
    return FACTORIES[config.provider](config)


def json_only(judge: Judge) -> Judge:
    """A judge whose replies must hold JSON; others count as failures and are retried."""

    def checked(system: str, prompt: str) -> str:
        reply = judge(system, prompt)
        text = find_json(reply)
        if text is None:
            raise ValueError("judge returned no JSON")
        return Reply.of(text, getattr(reply, "input_tokens", None), getattr(reply, "output_tokens", None))

    return checked
