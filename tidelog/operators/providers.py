"""Clients of remote models (E4, E5): one request a prompt, over HTTP; built for the executors, hence picklable.

Each is a row of one table: where the request goes, its headers, its body, and where the text stands in the answer.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from tidelog.operators.enrich import MockProvider, NoProvider, Provider
from tidelog.sources.config import ProviderChoice

SYSTEM = "You explain errors of application logs. Answer with one JSON object."


@dataclass(frozen=True)
class Remote:
    """How a provider is asked; the functions get model, key and prompt."""

    base: str
    model: str
    path: Callable[[str], str]
    headers: Callable[[str], dict[str, str]]
    body: Callable[[str, str], dict]
    answer: Callable[[dict], str]


# Public interfaces of the services.
REMOTES = {
    "openai": Remote(
        "https://api.openai.com", "gpt-4o-mini", lambda m: "/v1/chat/completions", lambda k: {"Authorization": f"Bearer {k}"},
        lambda m, p: {"model": m, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": p}]},
        lambda r: r["choices"][0]["message"]["content"],
    ),
    "claude": Remote(
        "https://api.anthropic.com", "claude-3-5-sonnet-latest", lambda m: "/v1/messages", lambda k: {"x-api-key": k, "anthropic-version": "2023-06-01"},
        lambda m, p: {"model": m, "max_tokens": 4096, "system": SYSTEM, "messages": [{"role": "user", "content": p}]},
        lambda r: r["content"][0]["text"],
    ),
    "gemini": Remote(
        "https://generativelanguage.googleapis.com", "gemini-1.5-flash", lambda m: f"/v1beta/models/{m}:generateContent", lambda k: {"x-goog-api-key": k},
        lambda m, p: {"contents": [{"parts": [{"text": f"{SYSTEM}\n\n{p}"}]}]},
        lambda r: r["candidates"][0]["content"]["parts"][0]["text"],
    ),
    "ollama": Remote(
        "http://localhost:11434", "llama3", lambda m: "/api/generate", lambda k: {},
        lambda m, p: {"model": m, "prompt": p, "system": SYSTEM, "stream": False},
        lambda r: r["response"],
    ),
}


class HttpProvider:
    """A provider by the table; errors carry the status, by which they are worth another try or not."""

    def __init__(self, choice: ProviderChoice, timeout: float = 60.0):
        remote = REMOTES[choice.name]
        if not choice.key and choice.name != "ollama":
            raise ValueError(f"no key for {choice.name}: set {choice.name.upper()}_API_KEY or api_key")
        self.name, self.model, self.timeout = choice.name, choice.model or remote.model, timeout
        self.key, self.base = choice.key or "", (choice.endpoint or remote.base).rstrip("/")

    def request(self, prompt: str) -> urllib.request.Request:
        remote = REMOTES[self.name]
        data = json.dumps(remote.body(self.model, prompt)).encode()
        headers = {"Content-Type": "application/json", **remote.headers(self.key)}
        return urllib.request.Request(self.base + remote.path(self.model), data, headers, method="POST")

    def analyze(self, prompt: str) -> str:
        with urllib.request.urlopen(self.request(prompt), timeout=self.timeout) as response:
            found = json.loads(response.read())
        try:
            text = REMOTES[self.name].answer(found)
        except (KeyError, IndexError, TypeError):
            raise RuntimeError("empty response") from None
        if not text:
            raise RuntimeError("empty response")
        return text


def provider_of(choice: ProviderChoice) -> Provider:
    """The provider that was chosen."""
    if choice.name in ("none", "mock"):
        return {"none": NoProvider, "mock": MockProvider}[choice.name]()
    if choice.name not in REMOTES:
        raise ValueError(f"{choice.name} needs a signing client, which isn't part of this engine")
    return HttpProvider(choice)
