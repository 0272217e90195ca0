"""Enrichment of groups by a pluggable provider: E2, E3, E6, E7.

Only groups reach a provider, which are few after aggregation; the number of partitions is the number of calls at
a time.  A call that fails leaves the group without analysis.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from typing import Protocol, TextIO

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.responses import ANALYSIS_TYPE, JsonText, jittered, retry_worthy

# Fixed value: the explanation where no provider is chosen.
NOT_ENABLED = "AI analysis not enabled. Use --ai flag to enable."
LEAST_CONCURRENCY, MOST_CONCURRENCY, CONCURRENCY = 1, 100, 5


class Provider(Protocol):
    """One prompt in, one response text out; must be picklable."""

    name: str

    def analyze(self, prompt: str) -> str: ...


class NoProvider:
    """A fixed explanation and empty lists."""

    name = "none"

    def analyze(self, prompt: str) -> str:
        return json.dumps({"explanation": NOT_ENABLED, "root_cause": None, "suggestions": [], "related_resources": [], "tool_invocations": []})


class MockProvider:
    """A deterministic provider for tests: the explanation repeats the pattern line of the prompt."""

    name = "mock"

    def analyze(self, prompt: str) -> str:
        line = next((x for x in prompt.splitlines() if x.startswith("Pattern: ")), "Pattern: ")
        return "```json\n" + json.dumps({"explanation": f"about {line[9:]}", "root_cause": None, "suggestions": []}) + "\n```"


def with_retries(call: Callable[[], str], retries: int, initial_ms: int, max_ms: int) -> tuple[str | None, int, str | None]:
    """(response, attempts, error): up to ``retries`` more attempts for errors worth another try."""
    for attempt in range(retries + 1):
        try:
            return call(), attempt + 1, None
        except Exception as e:  # noqa: BLE001  whatever a provider raises is its reason of failure
            if attempt == retries or not retry_worthy(str(e)):
                return None, attempt + 1, str(e)
            time.sleep(jittered(min(initial_ms * 2**attempt, max_ms)) / 1000)
    raise AssertionError


class Progress:
    """Calls done of all, in per cent, with the time that is left, printed by the driver as executors report."""

    def __init__(self, sc: SparkContext, total: int, out: TextIO):
        self.done, self.total, self.out = sc.accumulator(0), total, out

    def watch(self, every: float = 1.0) -> threading.Event:
        """Print until the event that is returned is set."""
        ended, began = threading.Event(), time.monotonic()

        def show() -> None:
            while not ended.wait(every) and self.done.value < self.total:
                self.out.write(self.line(time.monotonic() - began))

        threading.Thread(target=show, daemon=True).start()
        return ended

    def line(self, seconds: float) -> str:
        done = self.done.value
        left = f"{seconds / done * (self.total - done):.0f} s left" if done else "?"
        return f"{done}/{self.total} ({100 * done // max(1, self.total)} %), {left}\n"


def enrich(
    prompts: DataFrame, provider: Provider, concurrency: int = CONCURRENCY, retries: int = 3, initial_ms: int = 1000, max_ms: int = 30_000,
    progress: Progress | None = None,
) -> DataFrame:
    """(group_id, analysis, attempts, duration_ms, failure_reason) of prompts (group_id, prompt)."""
    done = progress.done if progress else None
    if not LEAST_CONCURRENCY <= concurrency <= MOST_CONCURRENCY:
        raise ValueError(f"concurrency must be {LEAST_CONCURRENCY} to {MOST_CONCURRENCY}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for group_id, prompt in zip(df.group_id, df.prompt):
                began = time.monotonic()
                response, attempts, error = with_retries(lambda p=prompt: provider.analyze(p), retries, initial_ms, max_ms)
                found = JsonText.extract(response) if response is not None else None
                if found is not None and found.error:
                    error = found.error
                out.append((group_id, found.json if found else None, attempts, int((time.monotonic() - began) * 1000), error))
                if done is not None:
                    done.add(1)
            yield pd.DataFrame(out, columns=["group_id", "json", "attempts", "duration_ms", "failure_reason"])

    schema = "group_id STRING, json STRING, attempts INT, duration_ms BIGINT, failure_reason STRING"
    calls = prompts.select("group_id", "prompt").repartition(concurrency).mapInPandas(run, schema)
    return calls.select("group_id", F.from_json("json", ANALYSIS_TYPE).alias("analysis"), "attempts", "duration_ms", "failure_reason")
