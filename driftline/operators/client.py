"""An analyser that asks chat-completion endpoints over HTTP, one after another as they fail."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from driftline.operators.analyze import PermanentError, recover_json


@dataclass(frozen=True)
class Endpoint:
    """Where to ask: the base URL of a chat-completion service, its model, a key, and whether it streams."""

    url: str
    model: str = ""
    key: str = ""
    stream: bool = False


def stream_text(lines: Iterable[bytes]) -> str:
    """The joined deltas of an event stream; lines that aren't events or don't parse are skipped."""

    def deltas() -> Iterator[str]:
        for line in lines:
            line = line.strip()
            if not line.startswith(b"data:"):
                continue
            if line[5:].strip() == b"[DONE]":
                return
            try:
                choices = json.loads(line[5:]).get("choices") or [{}]
                yield choices[0].get("delta", {}).get("content") or ""
            except (ValueError, AttributeError):
                continue

    return "".join(deltas())


@dataclass
class HttpAnalyzer:
    """Calls the current endpoint; after a failure the next one, for good. It never goes back.

    The last endpoint's failure is raised: as ``PermanentError`` where another try is pointless (no
    connection, or status 408), else as ``RuntimeError``. It travels to the workers by value, so each task has
    a chain of its own.
    """

    endpoints: list[Endpoint] = field(default_factory=list)
    temperature: float = 0.1
    max_tokens: int = 1500
    timeout: float = 150.0
    at: int = 0

    def __call__(self, system: str, user: str) -> str:
        return self.chat([{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": user}])

    def chat(self, messages: list[dict]) -> str:
        if not self.endpoints:
            raise PermanentError("no endpoint")
        while True:
            try:
                return self._ask(self.endpoints[self.at], messages)
            except (RuntimeError, OSError, ValueError, LookupError) as error:
                if self.at + 1 < len(self.endpoints):
                    self.at += 1
                    continue
                final = isinstance(error, urllib.error.HTTPError) and error.code == 408 or isinstance(error, urllib.error.URLError) and not isinstance(error, urllib.error.HTTPError)
                raise (PermanentError if final else RuntimeError)(f"{type(error).__name__}: {error}") from error

    def structured(self, system: str, user: str, schema: dict) -> dict:
        """The reply as an object that should follow ``schema``; ValueError if there is none in it."""
        return json.loads(recover_json(self(system, f"{user}\n\nAnswer with one JSON object that follows this schema:\n{json.dumps(schema, ensure_ascii=False)}")))

    def _ask(self, to: Endpoint, messages: list[dict]) -> str:
        body = {"model": to.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens, "stream": to.stream}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {to.key}"} if to.key else {})
        request = urllib.request.Request(to.url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            if to.stream:
                return stream_text(reply)
            return json.loads(reply.read())["choices"][0]["message"]["content"].strip()
