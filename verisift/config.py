"""Settings of a verification run, from a YAML file or given directly, checked on the driver."""

from __future__ import annotations

import dataclasses
import json
import math
import os
from dataclasses import dataclass
from pathlib import Path
from typing import Any

# Variables that hold the keys of search providers and models.
SEARCH_KEYS = {"serper": "SERPER_API_KEY", "tavily": "TAVILY_API_KEY"}
#: Provider that takes no more results than this.
MOST_RESULTS = {"tavily": 20}
#: Searchers that need no key.
OFFLINE_SEARCHERS = ("corpus",)


def _integer(name: str, value: Any, least: int) -> None:
    """Truth values are no integers here."""
    if type(value) is not int or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")


def _number(name: str, value: Any, low: float, high: float, open_low: bool = False) -> None:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    if value < low or value > high or (open_low and value == low):
        raise ValueError(f"{name} must lie between {low} and {high}")


def check_search(provider: Any, results: Any) -> None:
    """Search provider and number of results."""
    if not isinstance(provider, str) or provider not in (*SEARCH_KEYS, *OFFLINE_SEARCHERS):
        raise ValueError(f"search provider must be one of {', '.join((*SEARCH_KEYS, *OFFLINE_SEARCHERS))}")
    _integer("num_searches", results, 1)
    if results > MOST_RESULTS.get(provider, results):
        raise ValueError(f"num_searches must be at most {MOST_RESULTS[provider]} for {provider}")


def api_key(variable: str) -> str:
    """A key from the environment of the worker; absent, blank and 'your_...' values are errors."""
    key = os.environ.get(variable, "").strip()
    if not key or key.lower().startswith("your_"):
        raise ValueError(f"{variable} is not set")
    return key


@dataclass(frozen=True)
class ModelSettings:
    """Which model is asked, and how; ``model_name`` is provider:model."""

    model_name: str = "rule:overlap"
    temperature: float = 0.5
    max_tokens: int = 2048
    request_timeout: float = 60
    max_api_retries: int = 2
    show_prompts: bool = False
    show_responses: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.model_name, str) or ":" not in self.model_name:
            raise ValueError("model name must have the form provider:model")
        if not self.organization or not self.model_id.strip():
            raise ValueError("model name must have the form provider:model")
        _number("temperature", self.temperature, 0, 2)
        _integer("max_tokens", self.max_tokens, 1)
        _number("request_timeout", self.request_timeout, 0, math.inf, open_low=True)
        _integer("max_api_retries", self.max_api_retries, 0)

    @property
    def organization(self) -> str:
        return self.model_name.split(":", 1)[0]

    @property
    def model_id(self) -> str:
        return self.model_name.split(":", 1)[1]

    def as_json(self) -> str:
        """The settings for people to read."""
        shown = {"organization": self.organization, "model_id": self.model_id} | dataclasses.asdict(self)
        del shown["model_name"]
        return json.dumps(shown, indent=2, ensure_ascii=False)


@dataclass(frozen=True)
class LoopSettings:
    """How the rounds of a claim go. ``guard`` keeps results that look like instructions away from the model;
    ``calls_at_once`` is how many calls of model or search one task has under way."""

    max_steps: int = 5
    max_retries: int = 10
    tolerance: int = 2
    diverse_prompt: bool = False
    search_type: str = "corpus"
    num_searches: int = 3
    threshold: float = 0.9
    guard: bool = False
    calls_at_once: int = 8

    def __post_init__(self) -> None:
        for name, least in (("max_steps", 0), ("max_retries", 0), ("tolerance", 2), ("num_searches", 1), ("calls_at_once", 1)):
            _integer(name, getattr(self, name), least)
        for name in ("diverse_prompt", "guard"):
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} must be true or false")
        check_search(self.search_type, self.num_searches)


@dataclass(frozen=True)
class Settings:
    """All settings of a run."""

    model: ModelSettings
    loop: LoopSettings

    def with_provider(self, provider: str) -> Settings:
        """The same settings with another search provider."""
        return dataclasses.replace(self, loop=dataclasses.replace(self.loop, search_type=provider))


def load(path: str | Path) -> dict:
    """A YAML mapping."""
    import yaml

    with open(path, encoding="utf-8") as file:
        read = yaml.safe_load(file)
    if not isinstance(read, dict):
        raise ValueError(f"{path} must hold a YAML mapping")
    return read


def settings(read: dict) -> Settings:
    """Checked settings of a mapping with the sections ``model``, ``search`` and, under any name, the one
    with ``max_steps``. Unknown names are errors."""
    rounds = [k for k, v in read.items() if isinstance(v, dict) and "max_steps" in v and k not in ("model", "search")]
    if len(rounds) != 1 or not all(isinstance(read.get(k), dict) for k in ("model", "search")):
        raise ValueError("settings need the sections model and search, and one with max_steps")
    model, search, loop = dict(read["model"]), dict(read["search"]), dict(read[rounds[0]])
    if "name" in model:
        model["model_name"] = model.pop("name")
    if "max_tolerance" in loop:
        loop["tolerance"] = loop.pop("max_tolerance")
    if "type" in search:
        search["search_type"] = search.pop("type")
    try:
        return Settings(ModelSettings(**model), LoopSettings(**loop, **search))
    except TypeError as error:
        raise ValueError(f"unknown setting: {error}") from error
