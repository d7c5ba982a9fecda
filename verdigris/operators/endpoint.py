"""Clients of model endpoints over HTTP: chat completions and embeddings, on the standard library alone.

Both are plain values that go to the tasks which call them. Errors are ``OSError``, so that a failed call is a row.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd

#: Where endpoints are by default, tries and pauses of a local one that is still starting, and time limits.
LOCAL_CHAT, REMOTE_CHAT, LOCAL_EMBED = "http://localhost:11434/v1/chat/completions", "https://api.openai.com/v1/chat/completions", "http://localhost:11434/api/embed"
TRIES, PAUSE_S, CHAT_S, EMBED_S = 3, 2.0, 180.0, 30.0


def post(url: str, body: dict, key: str, timeout: float) -> dict:
    """The JSON object that url answers with."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read().decode())
    except urllib.error.HTTPError as e:
        raise Refused(f"{url} answered HTTP {e.code}: {e.read().decode(errors='replace')[:300]}") from e
    except ValueError as e:
        raise Refused(f"{url} gave no JSON") from e


class Refused(OSError):
    """The endpoint is there but did not do what was asked, so asking again is no use."""


@dataclass(frozen=True)
class Chat:
    """A chat endpoint: what is given, else the environment's VERDIGRIS_LLM_URL, _KEY and _MODEL; with a key alone the remote
    default, with neither the local one. Only a local endpoint, which may still be loading, is asked again."""

    url: str
    key: str
    model: str
    pause_s: float = PAUSE_S
    timeout: float = CHAT_S

    @classmethod
    def resolve(cls, url: str = "", key: str = "", model: str = "", **more) -> Chat:
        env = lambda name: os.environ.get(f"VERDIGRIS_LLM_{name}", "")
        key = key or env("KEY")
        return cls(url or env("URL") or (REMOTE_CHAT if key else LOCAL_CHAT), key, model or env("MODEL") or "default", **more)

    @property
    def local(self) -> bool:
        return not self.key and "localhost" in self.url

    def __call__(self, messages: list[dict], max_tokens: int = 2048) -> str:
        """The response's JSON text."""
        body = {"model": self.model, "messages": messages, "max_tokens": max_tokens, "temperature": 0.0, "stream": False}
        for left in range(TRIES - 1 if self.local else 0, -1, -1):
            try:
                return json.dumps(post(self.url, body, self.key, self.timeout))
            except Refused:
                raise
            except OSError as e:
                if not left:
                    raise OSError(f"{self.url} cannot be reached: {e}") from e
                time.sleep(self.pause_s * (TRIES - left))
        raise AssertionError

    def check_runtime(self) -> str | None:
        """What keeps the endpoint from answering, or None."""
        try:
            self([{"role": "user", "content": "ping"}], max_tokens=1)
        except OSError as e:
            return str(e)
        return None


@dataclass(frozen=True)
class Embedder:
    """An embedding endpoint as an encoder of a batch of texts in one request. progress(done, total) is called after each."""

    url: str = ""
    model: str = "nomic-embed-text"
    timeout: float = EMBED_S
    progress: Callable[[int, int], None] | None = None

    def __call__(self, texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=object)
        url = self.url or os.environ.get("VERDIGRIS_EMBED_URL", LOCAL_EMBED)
        answer = post(url, {"model": self.model, "input": texts.tolist()}, "", self.timeout)
        vectors = answer["embeddings"] if "embeddings" in answer else [x.get("embedding") for x in answer.get("data", [])]
        if len(vectors) != len(texts) or any(not v for v in vectors):
            raise Refused(f"{url} gave {len(vectors)} vectors for {len(texts)} texts")
        if self.progress is not None:
            self.progress(len(vectors), len(texts))
        return pd.Series(vectors, index=texts.index)
