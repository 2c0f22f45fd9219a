"""Models that a run may ask: plain functions, or clients of an endpoint that take a prompt."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from ..functions import text as T

#: A controller: (question, evidence, step, max_steps, repair) to its raw output.
Controller = Callable[[str, str, int, int, bool], str]
_TOKEN = re.compile(r"[a-z0-9_]+|[一-鿿]")
_STOP = set(T.STOP_WORDS)
_WHOLE = re.compile(r"<\s*(search|final)\s*>(.*?)<\s*/\s*\1\s*>", re.I | re.S)


class PromptModel(Protocol):
    """Anything with ``generate``: a prompt, whether the answer must follow the protocol, temperature and new tokens."""

    def generate(self, prompt: str, protocol: bool, temperature: float, max_tokens: int) -> str: ...


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def mock_model(question: str, evidence: str, step: int, max_steps: int, repair: bool) -> str:
    """A deterministic controller: searches while the evidence is thin, else answers with its best sentence."""
    keys = [t for t in tokens(question) if t not in _STOP]
    low = evidence.lower()
    thin = len(evidence) < 24 or sum(t in low for t in keys) < 2
    if thin and step < max_steps and not repair:
        return f"<search>{' '.join(keys[:4]) or '关键信息'}</search>"
    parts = [s.strip() for s in re.split(r"[\n。！？!?]", evidence) if s.strip()]
    return f"<final>{max(parts, key=lambda s: sum(t in s.lower() for t in keys), default='')}</final>"


def http_post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return json.load(response)


@dataclass
class Endpoint:
    """A chat endpoint. An empty answer cut off by its length is asked for once more with twice the tokens
    (512 to ``most``); then the model's reasoning stands in; then it is an error. ``switches`` may begin a
    prompt: the first with thinking, the second without, which a protocol always has.
    """

    url: str
    name: str
    timeout: float = 120.0
    most: int = 2048
    keep: int = 512
    seed: int | None = None
    top_p: float = 1.0
    top_k: int = 0
    switches: tuple[str, str] = ("", "")
    thinking: bool = False
    post: Callable[[str, dict, float], dict] = field(default=http_post, repr=False)

    def body(self, prompt: str, protocol: bool, temperature: float, max_tokens: int) -> dict:
        switch = self.switches[0] if self.thinking and not (protocol and self.switches[1]) else self.switches[1]
        if switch and not any(s and prompt.lstrip().startswith(s) for s in self.switches):
            prompt = f"{switch}\n{prompt}"
        sampling = {"temperature": temperature, "top_p": self.top_p, "top_k": self.top_k} if temperature > 0 else {"temperature": 0.0, "top_p": 1.0, "top_k": 1}
        seed = {} if self.seed is None else {"seed": self.seed}
        return {"model": self.name, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, **sampling, **seed}

    def generate(self, prompt: str, protocol: bool, temperature: float, max_tokens: int) -> str:
        body = self.body(prompt, protocol, temperature, max_tokens)
        said, thought, why = self._ask(body)
        more = min(max(512, 2 * max_tokens), self.most)
        if not said and why == "length" and more > max_tokens:
            said, again, _ = self._ask({**body, "max_tokens": more})
            thought = again or thought
        if not said and thought:
            whole, lines = _WHOLE.search(thought), [x.strip() for x in thought.splitlines() if x.strip()]
            said = whole[0] if protocol and whole else f"<final>{lines[-1][: self.keep]}</final>" if protocol else lines[-1]
        if not said:
            raise RuntimeError(f"no answer from {self.url} ({why or 'unknown reason'})")
        return self.shortened(said) if protocol else said

    def _ask(self, body: dict) -> tuple[str, str, str]:
        choices = self.post(self.url.rstrip("/") + "/chat/completions", body, self.timeout).get("choices") or [{}]
        message = choices[0].get("message") or {}
        thoughts = (_plain(message.get(k)) for k in ("reasoning", "reasoning_content", "thinking", "thought"))
        return _plain(message.get("content")), next(filter(None, thoughts), ""), choices[0].get("finish_reason") or ""

    def shortened(self, said: str) -> str:
        """One element with its content cut to ``keep`` code points, closed if it wasn't; a text without one is cut itself."""
        most = max(32, self.keep)
        if found := _WHOLE.search(said):
            tag, content = found[1].lower(), found[2]
        else:
            opened = [(t, said.lower().find(f"<{t}>")) for t in ("search", "final")]
            tag, at = next(((t, i) for t, i in opened if i >= 0), ("", -1))
            if not tag:
                return said[:most]
            content = said[at + len(tag) + 2 :]
        return f"<{tag}>{content.strip()[:most].strip()}</{tag}>"


def _plain(value) -> str:
    """The text of a message's content, which may be a list of parts."""
    if isinstance(value, list):
        return "\n".join(t for t in (p.get("text", "") if isinstance(p, dict) else str(p) for p in value) if t).strip()
    return "" if value is None else str(value).strip()
