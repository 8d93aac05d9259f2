"""Command line: verify one claim and print the result as JSON."""

from __future__ import annotations

import argparse
import logging
import os
from pathlib import Path

from pyspark.sql import SparkSession

from verisift.config import LoopSettings, ModelSettings, Settings, load, settings
from verisift.plans.loop import as_json, readable, verify
from verisift.session import get_spark, ship_package
from verisift.sources.search import CorpusSearch, searcher


def read_env(path: Path) -> None:
    """Set the variables of an env file that are not set yet."""
    if not path.exists():
        return
    for line in path.read_text(encoding="utf-8-sig").splitlines():
        name, sign, value = line.strip().partition("=")
        if sign and name and not name.startswith("#"):
            os.environ.setdefault(name.removeprefix("export ").strip(), value.strip().strip("\"'"))


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    """The arguments; a missing claim is asked for. No claim is an error, an interrupt ends with 130."""
    parser = argparse.ArgumentParser(prog="verisift", description="Verify one claim")
    parser.add_argument("claim", nargs="?", help="the claim; asked for when left out")
    parser.add_argument("--config", type=Path, help="YAML file with the sections model and search, and one with max_steps")
    parser.add_argument("--verbose", action="store_true", help="log the rounds")
    parser.add_argument("--search-provider", choices=("serper", "tavily", "corpus"), help="instead of the one in the file")
    parser.add_argument("--corpus", help="Parquet table of documents (doc_id, text) for the corpus search")
    given = parser.parse_args(arguments)
    if given.claim is None:
        try:
            given.claim = input("Claim: ").strip()
        except EOFError:
            parser.error("no claim was given")
        except KeyboardInterrupt:
            raise SystemExit(130) from None
    if not given.claim.strip():
        parser.error("the claim is empty")
    return given


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Exit status 1 without a verdict."""
    given = parse(arguments)
    logging.basicConfig(level=logging.INFO if given.verbose else logging.WARNING)
    read_env(Path.cwd() / ".env")
    chosen = settings(load(given.config)) if given.config else Settings(ModelSettings(), LoopSettings())
    if given.search_provider:
        chosen = chosen.with_provider(given.search_provider)
    spark = spark or get_spark("2")
    ship_package(spark)
    if chosen.loop.search_type == "corpus":
        if not given.corpus:
            raise SystemExit("--corpus is needed for the corpus search")
        search = CorpusSearch(spark.read.parquet(given.corpus), "doc_id", "text", chosen.loop.num_searches)
    else:
        search = searcher(chosen.loop.search_type, chosen.loop.num_searches)
    claims = spark.createDataFrame([(1, given.claim)], "claim_id bigint, claim string")
    row = as_json(verify(claims, chosen.loop, search, chosen.model)).collect()[0]
    print(readable(row["json"]))
    if '"result":null' in row["json"]:
        raise SystemExit(1)


if __name__ == "__main__":
    main()
