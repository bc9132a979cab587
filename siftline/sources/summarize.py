"""Language-model connectors (S15, A16): a call for each row through an injected callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "key long, provider string, summary string, prompt_tokens long, completion_tokens long, reasoning_tokens long, error string"

#: (prompt, model) -> (text, prompt tokens, completion tokens, reasoning tokens)
Provider = Callable[[str, str], tuple[str, int, int, int]]


def offline_provider(prompt: str, model: str) -> tuple[str, int, int, int]:
    """The page's first sentence; for tests and dry runs."""
    page = prompt.partition("<page>\n")[2].partition("\n</page>")[0]
    first = page.partition(".")[0].strip()
    return first, len(prompt.split()), len(first.split()), 0


def summarize(prompts: DataFrame, provider: Provider, name: str, model: str = "offline") -> DataFrame:
    """prompts (key, prompt) -> RESULT. No retries; an empty answer is an error, and an error is a row, not a failed job."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["key"], batch["prompt"]):
                try:
                    text, a, b, c = provider(prompt, model)
                    rows.append((key, name, text, a, b, c, None if text.strip() else "empty"))
                except Exception as e:
                    rows.append((key, name, None, 0, 0, 0, type(e).__name__))
            yield pd.DataFrame(rows, columns=[f.partition(" ")[0] for f in RESULT.split(", ")])

    return prompts.select("key", "prompt").mapInPandas(call, RESULT)


def usage(results: DataFrame) -> DataFrame:
    """A16."""
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens")]
    return results.groupBy("provider").agg(F.count("*").alias("calls"), *sums, F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
