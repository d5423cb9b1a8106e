"""Translation backends. They are made once for each Python worker's iterator, on the executor."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass


@dataclass
class Translation:
    text: str | None
    success: bool
    error: str | None = None


class Backend:
    """``translate`` must not raise; chunks have about ``max_chars_per_chunk`` characters."""

    max_chars_per_chunk = 3000

    def translate(self, messages: list[dict], text: str) -> Translation:
        raise NotImplementedError


class ChatBackend(Backend):
    """A chat service of the usual kind: temperature 0.3, 4096 tokens, three attempts with pauses of 2 and 4 seconds."""

    attempts, pause = 3, 2.0

    def __init__(self, key: str, base_url: str, model: str, max_chars_per_chunk: int, client=None, sleep: Callable[[float], None] = time.sleep):
        self.key, self.base_url, self.model, self.max_chars_per_chunk = key, base_url, model, max_chars_per_chunk
        self._client, self._sleep = client, sleep

    @property
    def client(self):
        if self._client is None:
            from openai import OpenAI  # an optional library, for use with a network only

            self._client = OpenAI(api_key=self.key, base_url=self.base_url)
        return self._client

    def translate(self, messages: list[dict], text: str) -> Translation:
        for attempt in range(1, self.attempts + 1):
            try:
                reply = self.client.chat.completions.create(model=self.model, messages=messages, temperature=0.3, max_tokens=4096)
                return Translation(reply.choices[0].message.content, True)
            except Exception as e:  # a service may fail in any way; the chunk's error says how
                if attempt == self.attempts:
                    return Translation("", False, f"Translation failed after {self.attempts} attempts: {e}")
                self._sleep(self.pause * attempt)


class UpperBackend(Backend):
    """An offline stand-in that upper-cases all but masks. It is no translator."""

    def translate(self, messages: list[dict], text: str) -> Translation:
        import re

        return Translation("".join(x if x.startswith("⟦") else x.upper() for x in re.split("(⟦[^⟧]+⟧)", text)), True)


class EchoBackend(Backend):
    def translate(self, messages: list[dict], text: str) -> Translation:
        return Translation(text, True)


class Service:
    """A chat service's settings by their prefix: its key, which must be there, its address and its model."""

    def __init__(self, prefix: str, base_url: str, model: str, limit: int):
        self.prefix, self.base_url, self.model, self.limit = prefix, base_url, model, limit

    def maker(self, settings: Mapping[str, str]) -> Callable[[], Backend]:
        """Settings are read, and a missing key is found, where the plan is made; executors get what is needed alone."""
        key = settings.get(f"{self.prefix}_API_KEY")
        if not key:
            raise ValueError(f"{self.prefix}_API_KEY is not set.")
        url, model, limit = settings.get(f"{self.prefix}_BASE_URL") or self.base_url, settings.get(f"{self.prefix}_MODEL") or self.model, self.limit
        return lambda: ChatBackend(key, url, model, limit)


#: Name to (maker or service, characters in a chunk). The services' addresses, models and limits.
BACKENDS: dict[str, tuple[Callable[[], Backend] | Service, int]] = {
    "tensorblock": (Service("TENSORBLOCK", "https://api.forge.tensorblock.co/v1", "tensorblock/gemini-3-flash-preview", 8000), 8000),
    "deepseek": (Service("DEEPSEEK", "https://api.deepseek.com/v1", "deepseek-chat", 3000), 3000),
    "upper": (UpperBackend, 3000),
    "echo": (EchoBackend, 3000),
}
DEFAULT = "tensorblock"


def register(name: str, make: Callable[[], Backend], max_chars_per_chunk: int = 3000) -> None:
    BACKENDS[name] = (make, max_chars_per_chunk)


def backend(name: str, settings: Mapping[str, str] | None = None) -> tuple[Callable[[], Backend], int]:
    """A maker, to be called on executors, and the characters in a chunk; ``settings`` are the environment's by default."""
    if name not in BACKENDS:
        raise ValueError(f"Unknown backend: {name}. Available: {sorted(BACKENDS)}")
    make, limit = BACKENDS[name]
    return (make.maker(os.environ if settings is None else settings) if isinstance(make, Service) else make), limit
