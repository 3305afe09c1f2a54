"""Calls of a text model per row, behind an injectable provider; the default is deterministic and needs no network."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A provider takes a prompt and returns (exit code, text, error text).
Provider = Callable[[str], tuple[int, str, str]]
RETRIES, BASE_DELAY = 3, 2.0


def is_quota(code: int, error: str) -> bool:
    """Rate limit by code or message, or a failure without any message."""
    return code == 429 or bool(re.search(r"429|rate limit", error or "", re.IGNORECASE)) or (code != 0 and not (error or "").strip())


def extractive(prompt: str) -> tuple[int, str, str]:
    """Default: the first sentence of the prompt's last paragraph, or the statement that there is nothing new."""
    last = [p for p in prompt.split("\n\n") if p.strip()][-1:]
    return (0, re.split(r"(?<=[.!?])\s", last[0].strip())[0], "") if last else (0, "NO_NEW_KNOWLEDGE", "")


def complete(df: DataFrame, provider: Provider = extractive, retries: int = RETRIES, delay: float = BASE_DELAY) -> DataFrame:
    """(id, prompt) to (id, text, outcome, error): ok, quota after all retries, or fatal at once. A NULL prompt is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, prompt in zip(pdf.id, pdf.prompt):
                for turn in range(retries + 1):
                    code, text, error = provider(prompt or "")
                    if code == 0 or not is_quota(code, error) or turn == retries:
                        break
                    time.sleep(delay * 2**turn)
                outcome = "ok" if code == 0 else "quota" if is_quota(code, error) else "fatal"
                rows.append((i, text if code == 0 else None, outcome, error or None))
            yield pd.DataFrame(rows, columns=["id", "text", "outcome", "error"])

    return df.select("id", "prompt").mapInPandas(run, "id string, text string, outcome string, error string")
