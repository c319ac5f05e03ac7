"""Connectors to models: a local model server over HTTP, hosted vendors by their own libraries where installed, and factories."""

from __future__ import annotations

import importlib.util
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence

from quillon.functions.embedding import Embedder, HashEmbedder
from quillon.operators.answering import Provider, ProviderError, Reply, ScriptedProvider
from quillon.sources.settings import is_local_host

Transport = Callable[[str, dict], dict]


class EmbeddingError(Exception):
    """An embedder that is missing or answered with the wrong number or length of vectors."""


def post(url: str, body: dict, timeout: int = 300) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        kind = {401: "auth", 402: "billing", 404: "model_missing", 429: "rate_limit"}.get(e.code, "server" if e.code >= 500 else "other")
        raise ProviderError(f"HTTP {e.code}", kind, e.code in (429, 500, 502, 503)) from e
    except (urllib.error.URLError, TimeoutError) as e:
        raise ProviderError(str(e), "unreachable") from e


class ServerProvider:
    """A model server on ``host`` that takes chat messages as JSON; ``transport`` stands in for the network."""

    def __init__(self, model: str, host: str = "http://127.0.0.1:11434", context_window: int = 8_192, transport: Transport = post):
        self.model, self.host, self.context_window, self.transport = model, host.rstrip("/"), context_window, transport
        self.sends_off_machine = not is_local_host(host)

    def complete(self, system: str, message: str, max_tokens: int) -> Reply:
        body = {"model": self.model, "stream": False, "messages": [{"role": "system", "content": system}, {"role": "user", "content": message}], "options": {"num_predict": max_tokens, "num_ctx": self.context_window, "temperature": 0}}
        got = self.transport(f"{self.host}/api/chat", body)
        reason = {"stop": "stop", "length": "length"}.get(got.get("done_reason", "stop"), "other")
        return Reply(got.get("message", {}).get("content", ""), reason, got.get("prompt_eval_count"), got.get("eval_count"))


class ServerEmbedder:
    """Vectors from a model server, ``batch`` texts a call; model prefixes tell documents from queries."""

    def __init__(self, model: str, dim: int, host: str = "http://127.0.0.1:11434", batch: int = 64, document_prefix: str = "", query_prefix: str = "", transport: Transport = post):
        self.model_id, self.dim, self.host, self.batch, self.transport = model, dim, host.rstrip("/"), batch, transport
        self.document_prefix, self.query_prefix = document_prefix, query_prefix

    def _embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for lo in range(0, len(texts), self.batch):
            part = list(texts[lo : lo + self.batch])
            vectors = self.transport(f"{self.host}/api/embed", {"model": self.model_id, "input": part}).get("embeddings", [])
            if len(vectors) != len(part) or any(len(v) != self.dim for v in vectors):
                raise EmbeddingError(f"{self.model_id} gave {len(vectors)} vectors for {len(part)} texts, or not of length {self.dim}")
            out += vectors
        return out

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return self._embed([self.document_prefix + t for t in texts])

    def embed_query(self, text: str) -> list[float]:
        return self._embed([self.query_prefix + text])[0]


def _needs(library: str, error: type[Exception]) -> None:
    if importlib.util.find_spec(library) is None:
        raise error(f"{library} is not installed") if error is not ProviderError else ProviderError(f"{library} is not installed", "not_installed")


class HostedProvider:
    """A vendor's chat model by its own library; the text leaves the machine."""

    sends_off_machine = True

    def __init__(self, library: str, model: str):
        _needs(library, ProviderError)
        self.library, self.model = library, model

    def complete(self, system: str, message: str, max_tokens: int) -> Reply:
        module = importlib.import_module(self.library)
        try:
            if self.library == "openai":
                r = module.OpenAI().chat.completions.create(model=self.model, max_tokens=max_tokens, messages=[{"role": "system", "content": system}, {"role": "user", "content": message}])
                choice = r.choices[0]
                return Reply(choice.message.content or "", {"stop": "stop", "length": "length", "content_filter": "refusal"}.get(choice.finish_reason, "other"), r.usage.prompt_tokens, r.usage.completion_tokens)
            r = module.Anthropic().messages.create(model=self.model, max_tokens=max_tokens, system=system, messages=[{"role": "user", "content": message}])
            finish = {"end_turn": "stop", "stop_sequence": "stop", "max_tokens": "length", "refusal": "refusal"}.get(r.stop_reason, "other")
            return Reply("".join(b.text for b in r.content if b.type == "text"), finish, r.usage.input_tokens, r.usage.output_tokens)
        except Exception as e:  # each library has errors of its own; their names tell the kind
            name = type(e).__name__.lower()
            kind = next((k for part, k in (("authentication", "auth"), ("permission", "auth"), ("notfound", "model_missing"), ("ratelimit", "rate_limit"), ("connection", "unreachable"), ("timeout", "unreachable")) if part in name), "other")
            raise ProviderError(str(e), kind, kind == "rate_limit") from e


def create_provider(name: str, model: str = "", **options) -> Provider:
    if name == "scripted":
        return ScriptedProvider(options.get("reply", ""))
    if name == "server":
        return ServerProvider(model, **options)
    if name in ("openai", "anthropic"):
        return HostedProvider(name, model)
    raise ProviderError(f"no provider {name!r}", "not_installed")


def create_embedder(name: str, model: str = "", dim: int = 384, **options) -> Embedder:
    if name == "hash":
        return HashEmbedder(dim)
    if name == "server":
        return ServerEmbedder(model, dim, **options)
    raise EmbeddingError(f"no embedder {name!r}")
