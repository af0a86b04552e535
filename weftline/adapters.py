"""Models behind HTTP services, as adapters of the model protocol. Nothing here is needed by the engine."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from weftline.models import Model


class HTTPModel(Model):
    """A model whose inputs are posted one by one, a few at a time; request and answer say how they look in JSON.

    The key is read from an environment variable of the worker when it is needed, so it is in no plan or fingerprint.
    """

    def __init__(
        self, url: str, name: str, request: Callable[[Any, dict[str, Any]], dict[str, Any]], answer: Callable[[dict[str, Any]], Any], output_type: str = "string",
        key_variable: str | None = None, threads: int = 8, timeout: float = 60.0, version: str = "1", max_length: int | None = None,
    ) -> None:
        self.url, self.name, self.request, self.answer, self.output_type, self.version = url, name, request, answer, output_type, version
        self.key_variable, self.threads, self.timeout, self.max_length = key_variable, threads, timeout, max_length

    def _post(self, body: dict[str, Any]) -> dict[str, Any]:
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        call = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as got:
                return json.load(got)
        except urllib.error.HTTPError as e:
            if e.code in (408, 409, 429) or e.code >= 500:
                raise ConnectionError(f"{self.url}: {e.code}") from e
            raise
        except urllib.error.URLError as e:
            raise ConnectionError(str(e)) from e

    def run(self, inputs: list[Any], **options: Any) -> list[Any]:
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(lambda x: self.answer(self._post(self.request(x, options))), inputs))


def chat_service(url: str, model: str, system_prompt: str | None = None, n: int = 1, **kwargs: Any) -> HTTPModel:
    """A chat completion endpoint; with n above 1 each output is an array of texts."""

    def request(prompt: str, options: dict[str, Any]) -> dict[str, Any]:
        messages = [{"role": "system", "content": system_prompt}] if system_prompt else []
        return {"model": model, "messages": [*messages, {"role": "user", "content": prompt}], "n": n, **sampling(**options)}

    def answer(got: dict[str, Any]) -> Any:
        texts = [c["message"]["content"].strip() for c in got["choices"]]
        return texts if n > 1 else texts[0]

    return HTTPModel(url, model, request, answer, "array<string>" if n > 1 else "string", **kwargs)


def embedding_service(url: str, model: str, instruction: str = "", **kwargs: Any) -> HTTPModel:
    return HTTPModel(url, model, lambda text, options: {"model": model, "input": instruction + text}, lambda got: got["data"][0]["embedding"], "array<float>", **kwargs)


def sampling(temperature: float = 1.0, top_p: float = 1.0, max_new_tokens: int | None = None, stop: list[str] | None = None, seed: int | None = None, **more: Any) -> dict[str, Any]:
    """Options under the names services share; a temperature of 0 takes the likeliest tokens, so top_p is 1 then."""
    out: dict[str, Any] = {"temperature": temperature, "top_p": 1.0 if temperature == 0 else top_p}
    for name, value in (("max_tokens", max_new_tokens), ("stop", stop), ("seed", seed)):
        if value is not None:
            out[name] = value
    return out | more


def tokens_left(prompt_tokens: int, context: int, wanted: int | None = None) -> int:
    """How many new tokens a prompt leaves room for; asking for more raises ValueError."""
    left = context - prompt_tokens
    if left <= 0 or (wanted is not None and wanted > left):
        raise ValueError(f"A prompt of {prompt_tokens} tokens leaves {max(left, 0)} of {context}.")
    return left if wanted is None else wanted
