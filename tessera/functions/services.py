"""Language and speech services over HTTP, as what ``models.generator`` loads: functions of a list of prompts, made in the worker.

A service is named by its url and model; keys are read where the call is made. Nothing here is called unless a pipeline is given it.
"""

from __future__ import annotations

import json
import os
import urllib.request
import uuid
from collections.abc import Callable, Sequence

from tessera.operators.prompt import SYSTEM_PROMPT

#: Fixed value: what a generator answers for want of a key, so that retrieval can be used without one.
NO_KEY = "No key is set for the language service; only the sources are shown."


class ServiceError(RuntimeError):
    """A service that answered with an error, or with something else than was asked for."""


def _post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, body, headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read())
    except urllib.error.HTTPError as error:
        raise ServiceError(f"{url}: {error.code} {error.read()[:300].decode('utf-8', 'replace')}") from error
    except (urllib.error.URLError, TimeoutError, ValueError) as error:
        raise ServiceError(f"{url}: {error}") from error


def _field(reply: dict, *path: str | int) -> str:
    found = reply
    try:
        for step in path:
            found = found[step]
    except (KeyError, IndexError, TypeError) as error:
        raise ServiceError(f"no {'.'.join(map(str, path))} in the reply") from error
    return str(found)


def completions(url: str, model: str, system: str = SYSTEM_PROMPT, temperature: float = 0.2, timeout: float = 120) -> Callable[[], Callable[[Sequence[str]], list[str]]]:
    """A loader for a server of models on one's own machines: one completion for each prompt, not streamed."""

    def load() -> Callable[[Sequence[str]], list[str]]:
        def one(prompt: str) -> str:
            asked = {"model": model, "prompt": prompt, "system": system, "stream": False, "options": {"temperature": temperature}}
            return _field(_post(f"{url.rstrip('/')}/api/generate", json.dumps(asked).encode(), {"Content-Type": "application/json"}, timeout), "response").strip()

        return lambda prompts: [one(p) for p in prompts]

    return load


def chat(url: str, model: str, key_variable: str, system: str = SYSTEM_PROMPT, temperature: float = 0.2, timeout: float = 120) -> Callable[[], Callable[[Sequence[str]], list[str]]]:
    """A loader for a hosted service of chat completions; without a key in ``key_variable`` every answer is NO_KEY."""

    def load() -> Callable[[Sequence[str]], list[str]]:
        def one(prompt: str) -> str:
            key = os.environ.get(key_variable, "")
            if not key:
                return NO_KEY
            asked = {"model": model, "temperature": temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
            headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
            return _field(_post(f"{url.rstrip('/')}/chat/completions", json.dumps(asked).encode(), headers, timeout), "choices", 0, "message", "content").strip()

        return lambda prompts: [one(p) for p in prompts]

    return load


def transcribe(url: str, model: str, key_variable: str, content: bytes, filename: str = "audio.wav", timeout: float = 120) -> str:
    """The text of a recording; raises without a key."""
    key = os.environ.get(key_variable, "")
    if not key:
        raise ServiceError(f"{key_variable} is not set")
    mark = uuid.uuid4().hex
    name = filename.replace('"', "").replace("\r", "").replace("\n", "")
    head = f'--{mark}\r\nContent-Disposition: form-data; name="model"\r\n\r\n{model}\r\n--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'
    body = head.encode() + content + f"\r\n--{mark}--\r\n".encode()
    headers = {"Content-Type": f"multipart/form-data; boundary={mark}", "Authorization": f"Bearer {key}"}
    return _field(_post(f"{url.rstrip('/')}/audio/transcriptions", body, headers, timeout), "text").strip()
