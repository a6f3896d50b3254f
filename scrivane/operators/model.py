"""Model calls as one batched map operator with adapters, retries and usage rows.

A model is expensive and its answers are not repeatable, so write a result of
map_model before anything reads it twice, and keep speculative execution off for
that stage. Each Python worker makes one client.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass, field
from queue import SimpleQueue
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.functions.pixels import media_type_of
from scrivane.functions.requests import is_reasoning_name, response_parameters, token_limit
from scrivane.operators.limits import Leases

#: Fixed value: concurrent calls of a worker.
CONCURRENCY = 20
#: Fixed value: the prompt that replaces one a content filter refused.
FALLBACK_PROMPT = "Extract the document content comprehensively as markdown. Include all text, tables, charts, diagrams, and image descriptions."


@dataclass
class Request:
    """What one call gets: a prompt, images as encoded bytes, and earlier messages or instructions."""

    prompt: str
    images: list[bytes] = field(default_factory=list)
    messages: list[dict[str, str]] = field(default_factory=list)
    instructions: str | None = None


@dataclass
class Answer:
    text: str
    usage: dict[str, int] = field(default_factory=dict)
    filtered: bool = False
    response_id: str | None = None


class Model(Protocol):
    """A model adapter; made once in each worker by a picklable factory.

    With an attribute ``local`` that is true its calls wait for nothing outside the worker.
    """

    name: str

    def call(self, request: Request) -> Answer: ...


class StubModel:
    """A stand-in without a model: a repeatable digest of the request. Its timings measure the dataflow only."""

    name = "stub"
    local = True

    def __init__(self, filtered_marker: str | None = None, failing_marker: str | None = None):
        self.filtered_marker, self.failing_marker, self.calls = filtered_marker, failing_marker, 0

    def call(self, request: Request) -> Answer:
        self.calls += 1
        if self.failing_marker and self.failing_marker in request.prompt:
            raise RuntimeError("stub failure")
        if self.filtered_marker and self.filtered_marker in request.prompt:
            return Answer("", {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0}, filtered=True)
        d = hashlib.sha256(request.prompt.encode() + b"".join(request.images)).hexdigest()[:12]
        n = len(request.prompt.split())
        return Answer(f"stub:{d}", {"input_tokens": n, "output_tokens": 1, "total_tokens": n + 1})


@dataclass
class Provider:
    """Settings of a hosted model: kind, model name, key, address and request defaults.

    Kinds: ``anthropic``, ``bedrock``, ``chat``, ``gemini``, ``azure``,
    ``responses``, ``azure_responses``. ``chat`` with a base_url serves any local
    server of the same interface. The SDKs are imported in the worker only.
    """

    kind: str
    model: str
    api_key: str | None = None
    base_url: str | None = None
    api_version: str | None = None
    temperature: float = 0.0
    reasoning_effort: str | None = None
    options: dict[str, Any] = field(default_factory=dict)

    def check(self) -> None:
        if self.kind != "bedrock" and not self.api_key:
            raise ValueError(f"{self.kind}: an API key is required")
        if self.kind.startswith("azure") and not (self.base_url and self.api_version):
            raise ValueError(f"{self.kind}: base_url and api_version are required")

    def content(self, request: Request) -> list[dict[str, Any]]:
        """Content items of a request: images first, then the prompt."""
        import base64

        out: list[dict[str, Any]] = []
        several = len(request.images) > 1
        for i, raw in enumerate(request.images, 1):
            data, media = base64.b64encode(raw).decode(), media_type_of(raw)
            if self.kind in ("anthropic", "bedrock"):
                out += [{"type": "text", "text": f"Image {i}:"}] * several
                out.append({"type": "image", "source": {"type": "base64", "media_type": media, "data": data}})
            elif "responses" in self.kind:
                out.append({"type": "input_image", "image_url": f"data:{media};base64,{data}", "detail": self.options.get("detail", "high")})
            else:
                out.append({"type": "image_url", "image_url": {"url": f"data:{media};base64,{data}", "detail": self.options.get("detail", "high")}})
        return [*out, {"type": "input_text" if "responses" in self.kind else "text", "text": request.prompt}]

    def parameters(self, request: Request) -> dict[str, Any]:
        """The keyword arguments of the SDK call."""
        if request.messages:
            system = [m["content"] for m in request.messages if m["role"] == "system"]
            turns = [m for m in request.messages if m["role"] != "system"]
        else:
            system, turns = [], [{"role": "user", "content": self.content(request)}]
        instructions = request.instructions or (system[-1] if system else None)
        limit = token_limit(self.options, 4096)
        if self.kind in ("anthropic", "bedrock"):
            out = {"model": self.model, "max_tokens": limit, "temperature": self.temperature, "messages": turns, "stream": False}
            return out | ({"system": [instructions]} if instructions is not None else {})
        if "responses" in self.kind:
            return response_parameters(self.model, limit, self.temperature, self.reasoning_effort, store=self.options.get("store", False), instructions=instructions, previous=self.options.get("previous_response_id")) | {"input": turns}
        messages = ([{"role": "system", "content": instructions}] if instructions is not None else []) + turns
        out = {"model": self.model, "messages": messages, "stream": False}
        if self.kind != "gemini" and is_reasoning_name(self.model):
            out["max_completion_tokens"] = limit
            if self.reasoning_effort is not None:
                out["reasoning_effort"] = self.reasoning_effort
            if self.reasoning_effort == "none":
                out["temperature"] = self.temperature
            return out
        return out | {"max_tokens": limit, "temperature": self.temperature}

    def connect(self) -> Model:
        self.check()
        return _Hosted(self)


class _Hosted:
    def __init__(self, provider: Provider):
        self.provider, self.name = provider, provider.model
        p = provider
        if p.kind in ("anthropic", "bedrock"):
            import anthropic

            self.client = anthropic.AnthropicBedrock() if p.kind == "bedrock" else anthropic.Anthropic(api_key=p.api_key)
        else:
            import openai

            azure = p.kind.startswith("azure")
            self.client = openai.AzureOpenAI(api_key=p.api_key, azure_endpoint=p.base_url, api_version=p.api_version) if azure else openai.OpenAI(api_key=p.api_key, base_url=p.base_url)

    def call(self, request: Request) -> Answer:
        args, kind = self.provider.parameters(request), self.provider.kind
        if kind in ("anthropic", "bedrock"):
            r = self.client.messages.create(**args)
            i, o = r.usage.input_tokens, r.usage.output_tokens
            return Answer(str(r.content[0].text), {"input_tokens": i, "output_tokens": o, "total_tokens": i + o})
        if "responses" in kind:
            r = self.client.responses.create(**args)
            return Answer(r.output_text or "", {"input_tokens": r.usage.input_tokens, "output_tokens": r.usage.output_tokens, "total_tokens": r.usage.total_tokens}, response_id=r.id)
        r = self.client.chat.completions.create(**args)
        text, u = r.choices[0].message.content, r.usage
        used = {"input_tokens": u.prompt_tokens, "output_tokens": u.completion_tokens, "total_tokens": u.total_tokens} if u else {}
        filtered = "content_filter" in (r.choices[0].finish_reason or "") or bool(u and u.completion_tokens == 0 and text is None)
        return Answer(text or "", used, filtered)


#: Fixed values in provider_from: setting names, default models and addresses.
def provider_from(settings: dict[str, str]) -> Provider:
    """The provider that ``settings`` names, else the first of those with a key: gemini, openai, azure, anthropic."""
    get = lambda *names: next((settings[n] for n in names if settings.get(n)), None)
    yes = lambda name: str(settings.get(name, "")).lower() == "true"
    made: dict[str, Callable[[], Provider]] = {
        "gemini": lambda: Provider("gemini", get("GEMINI_MODEL") or "gemini-2.5-flash", get("GEMINI_API_KEY"), "https://generativelanguage.googleapis.com/v1beta/openai/"),
        "openai": lambda: Provider("responses" if yes("OPENAI_USE_RESPONSES_API") else "chat", get("OPENAI_VISION_MODEL", "OPENAI_MODEL") or "gpt-4.1", get("OPENAI_VISION_API_KEY", "OPENAI_API_KEY"), get("OPENAI_VISION_BASE_URL", "OPENAI_BASE_URL"), reasoning_effort=get("OPENAI_REASONING_EFFORT")),
        "azure-openai": lambda: Provider("azure_responses" if yes("AZURE_OPENAI_USE_RESPONSES_API") else "azure", get("AZURE_OPENAI_MODEL") or "gpt-4.1", get("AZURE_OPENAI_API_KEY"), get("AZURE_OPENAI_API_URL"), get("AZURE_OPENAI_API_VERSION") or "2024-11-01-preview", reasoning_effort=get("AZURE_OPENAI_REASONING_EFFORT")),
        "claude": lambda: Provider("anthropic", get("ANTHROPIC_MODEL") or "claude-sonnet-4-5-20250929", get("ANTHROPIC_API_KEY")),
        "anthropic_bedrock": lambda: Provider("bedrock", get("ANTHROPIC_BEDROCK_MODEL") or "anthropic.claude-3-5-sonnet-20241022-v2:0"),
    }
    if (named := settings.get("USE_VISION")) in made:
        return made[named]()
    for key, name in (("GEMINI_API_KEY", "gemini"), ("OPENAI_VISION_API_KEY", "openai"), ("OPENAI_API_KEY", "openai"), ("AZURE_OPENAI_API_KEY", "azure-openai"), ("ANTHROPIC_API_KEY", "claude")):
        if settings.get(key):
            return made[name]()
    raise ValueError("no provider is named and no API key is set")


def is_configured(settings: dict[str, str]) -> bool:
    """Whether ``settings`` name a known provider, or name none and hold a provider's key."""
    if settings.get("USE_VISION"):
        return settings["USE_VISION"] in ("gemini", "openai", "azure-openai", "claude", "anthropic_bedrock")
    return any(settings.get(k) for k in ("GEMINI_API_KEY", "OPENAI_VISION_API_KEY", "OPENAI_API_KEY", "AZURE_OPENAI_API_KEY", "ANTHROPIC_API_KEY"))


def answer_row(result: str | None, error: str | None = None, tries: int = 0, used: tuple[int, int, int] = (0, 0, 0)) -> dict[str, Any]:
    return {"result": result, "error": error, "tries": tries, "input_tokens": used[0], "output_tokens": used[1], "total_tokens": used[2]}


def call_with_retry(model: Model, request: Request, attempts: int, lease: Callable[[], AbstractContextManager] = nullcontext) -> dict[str, Any]:
    """One answer as a row. A filtered answer is asked again once, with the fallback prompt; failures are tried again and end as an error.

    Each call holds a ``lease`` of its own, so one that waits for its next attempt keeps none.
    """
    tries, error = 0, None
    while tries < max(1, attempts):
        tries += 1
        try:
            with lease():
                answer = model.call(request)
            if answer.filtered:
                tries += 1
                with lease():
                    answer = model.call(Request(FALLBACK_PROMPT, request.images))
            u = answer.usage
            i, o = u.get("input_tokens", u.get("prompt_tokens", 0)), u.get("output_tokens", u.get("completion_tokens", 0))
            return answer_row(answer.text, None, tries, (i, o, u.get("total_tokens", i + o)))
        except Exception as e:  # noqa: BLE001  the row carries it
            error = f"{type(e).__name__}: {e}"
    return answer_row(None, error, tries)


#: Answers that are handed on together, and seconds after which fewer are.
HANDED_ON, HANDED_ON_SECONDS = 64, 1.0


def answered(pool: ThreadPoolExecutor, ask: Callable[..., dict[str, Any]], work: Iterator[tuple[pd.DataFrame, Iterator[tuple]]], most: int) -> Iterator[tuple[pd.DataFrame, list[int], list[dict[str, Any]]]]:
    """Asks about each batch's rows, ``most`` of them under way at once; gives (batch, row numbers, answers) as they come.

    The next batch is read while calls of earlier ones still run, so a batch has no barrier.
    """
    done: SimpleQueue[Future] = SimpleQueue()
    running: dict[Future, tuple[pd.DataFrame, int]] = {}
    held: dict[int, tuple[pd.DataFrame, list[int], list[dict[str, Any]]]] = {}
    n, since = 0, time.monotonic()

    def take() -> Iterator[tuple[pd.DataFrame, list[int], list[dict[str, Any]]]]:
        nonlocal n, since
        f = done.get()
        batch, i = running.pop(f)
        _, at, made = held.setdefault(id(batch), (batch, [], []))
        at.append(i)
        made.append(f.result())
        n += 1
        if n >= HANDED_ON or not running or time.monotonic() - since > HANDED_ON_SECONDS:
            out = list(held.values())
            held.clear()
            n, since = 0, time.monotonic()
            yield from out

    for batch, rows in work:
        for i, row in enumerate(rows):
            while len(running) >= most:
                yield from take()
            f = pool.submit(ask, *row)
            running[f] = (batch, i)
            f.add_done_callback(done.put)
    while running:
        yield from take()
    yield from held.values()


ANSWER = "result string, error string, tries int, input_tokens long, output_tokens long, total_tokens long"


def map_model(rows: DataFrame, factory: Callable[[], Model], *, keys: list[str], prompt: str = "prompt", images: str | list[str] | None = None, load: Callable[[], Callable[..., list[bytes]]] | None = None, known: str | None = None, attempts: int = 2, concurrency: int = CONCURRENCY, limit: Leases | None = None) -> DataFrame:
    """Call the model for every row; returns the keys with ANSWER's columns, one row each, errors included.

    ``images``: a column of binary, or of an array of binary in order; with ``load``,
    columns (a path first, as a rule) that it turns into a request's images right
    before the call, so that no plan carries them. A row whose images cannot be
    loaded has an error and is not asked about. ``known``: a column whose value,
    where it is not null, is the answer without a call. Calls of a partition run
    ``concurrency`` at a time, and with ``limit`` (CallLimit.lease) no more than that
    many at once in all executors. Rows come as they are answered, in any order, so a
    slow call holds up no other; images are loaded by the thread that asks. A ``local``
    model's calls, without ``load`` and ``limit``, are made one after the other, since
    threads have nothing to wait for.
    """
    shown = [] if images is None else [images] if isinstance(images, str) else list(images)
    cols = list(dict.fromkeys([*keys, prompt, *shown, *([known] if known else [])]))
    kinds = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, loader, lease = factory(), load() if load else None, limit.taker() if limit else nullcontext
        given = lambda x: [] if x is None else [bytes(x)] if isinstance(x, bytes | bytearray) else [bytes(b) for b in x]

        def ask(text: str | None, value: str | None, *seen) -> dict[str, Any]:
            if value is not None and value == value:
                return answer_row(value)
            try:
                pictures = loader(*seen) if loader else given(seen[0]) if seen else []
            except Exception as e:  # noqa: BLE001  the row carries it
                return answer_row(None, f"{type(e).__name__}: {e}")
            return call_with_retry(model, Request(text or "", pictures), attempts, lease)

        def shown_rows(part: pd.DataFrame) -> Iterator[tuple]:
            return zip(part[prompt], part[known] if known else [None] * len(part), *(part[c] for c in shown), strict=True)

        columns = [c.split()[0] for c in ANSWER.split(", ")]
        if getattr(model, "local", False) and load is None and limit is None:
            for part in parts:
                made = [ask(*row) for row in shown_rows(part)]
                yield pd.concat([part[keys].reset_index(drop=True), pd.DataFrame(made, columns=columns)], axis=1)
            return
        with ThreadPoolExecutor(concurrency) as pool:
            for part, at, made in answered(pool, ask, ((p, shown_rows(p)) for p in parts), 2 * concurrency):
                answers = pd.DataFrame(made, columns=columns)
                yield pd.concat([part[keys].iloc[at].reset_index(drop=True), answers], axis=1)

    return rows.select(*cols).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + ANSWER)


def usage_totals(answers: DataFrame, by: list[str]) -> DataFrame:
    """Calls and tokens, summed over all answers and not only the last."""
    return answers.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")))


class Transcriber(Protocol):
    """A speech adapter: encoded audio to the JSON of its verbose response."""

    name: str

    def transcribe(self, audio: bytes, language: str | None) -> str: ...


@dataclass
class Speech:
    """Settings of a hosted speech service (``openai`` or ``azure``); connect() makes its Transcriber in the worker."""

    kind: str = "openai"
    model: str = "whisper-1"
    api_key: str | None = None
    base_url: str | None = None
    api_version: str = "2024-11-01-preview"

    def connect(self) -> Transcriber:
        return _HostedSpeech(self)


class _HostedSpeech:
    def __init__(self, speech: Speech):
        import openai

        s, self.name = speech, speech.model
        if s.kind == "azure":
            self.client = openai.AzureOpenAI(api_key=s.api_key, azure_endpoint=s.base_url, api_version=s.api_version)
        else:
            self.client = openai.OpenAI(api_key=s.api_key)

    def transcribe(self, audio: bytes, language: str | None) -> str:
        asked = {"model": self.name, "response_format": "verbose_json", "timestamp_granularities": ["segment"], "file": ("audio.mp3", audio)}
        r = self.client.audio.transcriptions.create(**asked | ({"language": language} if language else {}))
        parts = [{"start": float(s.start), "end": float(s.end), "text": str(s.text)} for s in r.segments or []]
        return json.dumps({"segments": parts, "language": getattr(r, "language", "") or "", "duration": float(getattr(r, "duration", 0) or 0), "text": getattr(r, "text", "") or ""})


def map_transcriber(videos: DataFrame, factory: Callable[[], Transcriber], *, key: str, audio: str, language: str | None = None) -> DataFrame:
    """The key with ``response`` (JSON; parse it with speech_response) and ``error``; a failure leaves a null response."""
    kind = dict(videos.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speech = factory()
        for part in parts:
            out = []
            for k, a in zip(part[key], part[audio], strict=True):
                try:
                    out.append((k, speech.transcribe(bytes(a), language), None) if a is not None else (k, None, "no audio track"))
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "response", "error"])

    return videos.select(key, audio).mapInPandas(run, f"`{key}` {kind}, response string, error string")
