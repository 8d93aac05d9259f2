"""Models that answer prompts: adapters to hosted and local ones, a rule and a script for offline use.

A generator gives the text and the usage of one call. It is made once in each Python worker; keys are
read there from the environment and never stand in a column.
"""

from __future__ import annotations

import importlib
import json
import re
from functools import lru_cache
from typing import Any, Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verisift.config import ModelSettings, api_key

# The system message, addresses and key variables of the hosted models.
SYSTEM = "You are a fact-checking agent responsible for verifying the accuracy of claims."
COMPATIBLE = {"groq": "https://api.groq.com/openai/v1", "agnes": "https://apihub.agnes-ai.com/v1"}
KEYS = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "groq": "GROQ_API_KEY", "agnes": "AGNES_API_KEY"}


class Generator(Protocol):
    """Answers a prompt. ``context`` has claim_id, claim, phase, step, attempt and knowledge of the call. An attribute
    ``at_once`` limits how many prompts it takes at the same time in one worker."""

    def generate(self, prompt: str, context: dict[str, Any]) -> tuple[str, dict | None]: ...


def message_text(content: Any) -> str:
    """Text of a message's content: a text, or the texts among its blocks, a line each."""
    if isinstance(content, list):
        texts = [b if isinstance(b, str) else b.get("text") if isinstance(b, dict) and b.get("type") == "text" else None for b in content]
        return "\n".join(t for t in texts if isinstance(t, str))
    return content if isinstance(content, str) else ""


def message_usage(message: Any) -> dict | None:
    """Token counts of a message under the names input_tokens and output_tokens, where it has them."""
    usage = getattr(message, "usage_metadata", None)
    if usage is not None:
        return usage
    metadata = getattr(message, "response_metadata", None) or {}
    usage = metadata.get("usage") or metadata.get("token_usage")
    if usage and "prompt_tokens" in usage:
        return {"input_tokens": usage.get("prompt_tokens"), "output_tokens": usage.get("completion_tokens")}
    return usage


class HostedModel:
    """A model behind a chat client of one of the hosted providers."""

    def __init__(self, settings: ModelSettings) -> None:
        self.settings = settings
        self.plain = settings.organization == "openai" and settings.model_id.startswith("o1")
        self.client = self._client()

    def _client(self) -> Any:
        s = self.settings
        key = api_key(KEYS[s.organization])
        common = {"model": s.model_id, "temperature": s.temperature, "timeout": s.request_timeout, "max_retries": s.max_api_retries}
        if s.organization == "anthropic":
            chat = importlib.import_module("langchain_anthropic").ChatAnthropic
            return chat(**common, max_tokens=s.max_tokens, anthropic_api_key=key)
        chat = importlib.import_module("langchain_openai").ChatOpenAI
        if self.plain:
            common |= {"temperature": 1, "model_kwargs": {"max_completion_tokens": s.max_tokens}}
        else:
            common["max_tokens"] = s.max_tokens
        if s.organization in COMPATIBLE:
            common["openai_api_base"] = COMPATIBLE[s.organization]
        return chat(**common, openai_api_key=key)

    def generate(self, prompt: str, context: dict[str, Any]) -> tuple[str, dict | None]:
        message = self.client.invoke(prompt if self.plain else [("system", SYSTEM), ("human", prompt)])
        return message_text(message.content), message_usage(message)


class LocalModel:
    """A text-generation pipeline in the worker's own memory; usage is not reported."""

    at_once = 1

    def __init__(self, settings: ModelSettings) -> None:
        torch, transformers = importlib.import_module("torch"), importlib.import_module("transformers")
        gpu = torch.cuda.is_available()
        kind = torch.float32 if not gpu else torch.bfloat16 if torch.cuda.is_bf16_supported() else torch.float16
        self.options = {"do_sample": settings.temperature > 0}
        if settings.temperature > 0:
            self.options["temperature"] = settings.temperature
        self.pipe = transformers.pipeline(
            "text-generation", model=settings.model_id, model_kwargs={"torch_dtype": kind}, device=0 if gpu else -1,
            max_new_tokens=settings.max_tokens,
        )

    def generate(self, prompt: str, context: dict[str, Any]) -> tuple[str, dict | None]:
        messages = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}]
        answer = self.pipe(messages, pad_token_id=self.pipe.tokenizer.eos_token_id, **self.options)
        return answer[0]["generated_text"][-1]["content"], None


class OverlapRule:
    """Offline default: asks for a search with the claim itself as long as there is no knowledge; then says
    True if the knowledge has at least 70 % of the claim's distinct words of five letters or more. The rule
    says nothing about truth. Counts words as tokens."""

    at_once = 1  # it waits for nothing

    def __init__(self, share: float = 0.7) -> None:
        self.share = share

    def generate(self, prompt: str, context: dict[str, Any]) -> tuple[str, dict | None]:
        claim, knowledge = context["claim"], context["knowledge"]
        if not knowledge and context["phase"] == "decide":
            answer = json.dumps({"search_query": claim.strip()})
        else:
            wanted = set(re.findall(r"[^\W\d_]{5,}", claim.lower()))
            found = wanted & set(re.findall(r"[^\W\d_]{5,}", knowledge.lower()))
            verdict = bool(wanted) and len(found) >= self.share * len(wanted)
            answer = f"Words found: {len(found)} of {len(wanted)}. " + json.dumps({"final_answer": str(verdict)})
        return answer, {"input_tokens": len(prompt.split()), "output_tokens": len(answer.split())}


class ScriptedModel:
    """Answers from rows (claim_id, phase, step, attempt) -> (response, input_tokens, output_tokens, raises);
    for tests and for replaying recorded calls. A missing row answers with an empty text."""

    def __init__(self, rows: dict[tuple, tuple]) -> None:
        self.rows = rows

    def generate(self, prompt: str, context: dict[str, Any]) -> tuple[str, dict | None]:
        at = (context["claim_id"], context["phase"], context["step"], context["attempt"])
        response, given, made, raises = self.rows.get(at, ("", None, None, None))
        if raises:
            raise RuntimeError(raises)
        return response, None if given is None and made is None else {"input_tokens": given, "output_tokens": made}


class RecordedModel:
    """Answers of a table of model calls (call_id, claim_id, phase, step, attempt, response, input_tokens,
    output_tokens, raises), for replaying a run over all claims at once.

    A decision gets the calls of its claim and step, a final answer those of its claim, in the order of step,
    attempt and call; calls delivered again count once. Where no call is left the answer is an empty text.
    """

    CALLS = "array<struct<response: string, input_tokens: bigint, output_tokens: bigint, raises: string>>"

    def __init__(self, calls: DataFrame) -> None:
        self.calls = calls.dropDuplicates(["call_id"])

    def recorded(self, phase: str, step: int, most: int) -> DataFrame:
        """(claim_id, recorded): the first ``most`` calls of each claim."""
        here = self.calls.where(F.col("phase") == phase)
        if phase == "decide":
            here = here.where(F.col("step") == step)
        order = Window.partitionBy("claim_id").orderBy("step", "attempt", "call_id")
        first = here.where("claim_id IS NOT NULL").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
        call = F.struct("nth", "response", "input_tokens", "output_tokens", "raises")
        gathered = first.groupBy("claim_id").agg(F.array_sort(F.collect_list(call)).alias("recorded"))
        return gathered.select("claim_id", F.transform("recorded", lambda r: r.dropFields("nth")).alias("recorded"))


class RecordedAnswers:
    """The recorded calls of one claim as a generator. What was raised is raised again."""

    def __init__(self, calls: list[dict]) -> None:
        self.calls = calls

    def generate(self, prompt: str, context: dict[str, Any]) -> tuple[str, dict | None]:
        nth = context["attempt"] - 1
        if nth >= len(self.calls):
            return "", None
        call = self.calls[nth]
        if call["raises"]:
            name, _, message = call["raises"].partition(": ")
            raise type(name, (Exception,), {})(message)
        return call["response"], {n: call[n] for n in ("input_tokens", "output_tokens")}


class Echoing:
    """A generator that shows prompts or responses on the standard output of its worker."""

    def __init__(self, generator: Generator, prompts: bool, responses: bool) -> None:
        self.generator, self.prompts, self.responses = generator, prompts, responses
        self.at_once = getattr(generator, "at_once", None)

    def generate(self, prompt: str, context: dict[str, Any]) -> tuple[str, dict | None]:
        if self.prompts:
            print(prompt, flush=True)
        answer = self.generator.generate(prompt, context)
        if self.responses:
            print(answer[0], flush=True)
        return answer


@lru_cache(maxsize=4)
def load_model(settings: ModelSettings) -> Generator:
    """The generator of a model name; made once in each worker."""
    makers = {"rule": lambda s: OverlapRule(), "hf": LocalModel} | dict.fromkeys(KEYS, HostedModel)
    if settings.organization not in makers:
        raise ValueError(f"unknown model provider: {settings.organization}")
    model = makers[settings.organization](settings)
    return Echoing(model, settings.show_prompts, settings.show_responses) if settings.show_prompts or settings.show_responses else model
