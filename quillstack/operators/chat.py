"""Answers: chat models behind a protocol, their responses, errors and readiness as columns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESPONSE = "struct<model:string,choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>>"
NO_DATA, NO_MATCH = "There are no documents to search yet.", "The documents do not answer this question."
DISABLED, FAILED = "No chat model is set up; the results are complete.", "The chat model failed; the results are complete."


class ChatModel(Protocol):
    name: str

    def generate(self, messages: list[dict[str, str]]) -> str: ...


@dataclass(frozen=True)
class Answer:
    status: str  # ok, disabled, failed, no_match, no_data
    text: str
    model: str | None = None
    error: str | None = None


def validate(query: str, k: int) -> None:
    if not 1 <= len(query) <= 2000:
        raise ValueError("a query has 1 to 2000 characters")
    if not 1 <= k <= 50:
        raise ValueError("k is 1 to 50")


def answer(n_embeddings: int, n_hits: int, messages: list[dict[str, str]], model: ChatModel | None) -> Answer:
    """Fixed texts where there is nothing to ground an answer on; a failing model degrades the answer, not the results."""
    if not n_embeddings:
        return Answer("no_data", NO_DATA)
    if not n_hits:
        return Answer("no_match", NO_MATCH)
    if model is None or not model.name:
        return Answer("disabled", DISABLED, error="Chat generation is disabled")
    try:
        return Answer("ok", model.generate(messages), model.name)
    except Exception as error:  # whatever a client raises
        return Answer("failed", FAILED, error=str(error))


class Lost(Exception):
    """A timeout or a lost connection."""


class Refused(Exception):
    """An answer with an error status; ``retry_after`` in seconds, if the server names one."""

    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def generate(model: ChatModel, messages: list[dict[str, str]], max_retries: int = 3, stream: bool = False, wait: Callable[[float], None] = time.sleep) -> str:
    """One answer; lost calls, 429 and 5xx are tried again, after what the server names (0.5 to 60 s) or 2 ** attempt seconds, 60 at most."""
    if stream:
        raise NotImplementedError("answers come whole")
    for attempt in range(max_retries + 1):
        try:
            return model.generate(messages)
        except Exception as error:
            status = getattr(error, "status", None)
            again = isinstance(error, Lost) or status == 429 or (status is not None and 500 <= status < 600)
            if not again or attempt == max_retries:
                raise
            given = getattr(error, "retry_after", None)
            wait(min(2.0**attempt, 60.0) if given is None else max(0.5, min(60.0, given)))
    raise AssertionError


def generated(prompts: DataFrame, model: ChatModel, max_retries: int = 3) -> DataFrame:
    """``prompts`` with ``answer`` and ``error`` for their ``messages`` (array of role and content); a failing call fails its row alone."""

    @F.pandas_udf("answer string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            out = []
            for messages in column:
                try:
                    out.append((generate(model, [dict(m.asDict() if hasattr(m, "asDict") else m) for m in messages], max_retries), None))
                except Exception as error:  # whatever a client raises
                    out.append((None, str(error)))
            yield pd.DataFrame(out, columns=["answer", "error"], index=column.index)

    return prompts.withColumn("__g", run("messages")).select(*prompts.columns, "__g.answer", "__g.error")


def request_fault(query: Column, k: Column, max_tokens: Column | None = None) -> Column:
    """What is wrong with a request, as ``validate`` says; null if nothing is."""
    out = F.when(~F.coalesce(F.length(query).between(1, 2000), F.lit(False)), "query").when(~F.coalesce(k.between(1, 50), F.lit(False)), "k")
    return out if max_tokens is None else out.when(max_tokens < 1, "max_tokens")


def answer_state(n_embeddings: Column, n_hits: Column, model: Column, answer: Column, error: Column) -> Column:
    """``answer`` as a column: status, text, model and error."""
    status = F.when(n_embeddings == 0, "no_data").when(n_hits == 0, "no_match").when(F.coalesce(model, F.lit("")) == "", "disabled").when(error.isNotNull(), "failed").otherwise("ok")
    text = F.when(status == "no_data", NO_DATA).when(status == "no_match", NO_MATCH).when(status == "disabled", DISABLED).when(status == "failed", FAILED).otherwise(answer)
    return F.struct(status.alias("status"), text.alias("text"), F.when(status == "ok", model).alias("model"), F.when(status == "failed", error).when(status == "disabled", "Chat generation is disabled").alias("error"))


def parsed(responses: DataFrame) -> DataFrame:
    """content, model, token counts and error_code of raw bodies (id, body): null content is empty, null usage is zero."""
    r = F.from_json("body", RESPONSE)
    first = F.get(r["choices"], F.lit(0))
    use = lambda n: F.coalesce(r["usage"][n], F.lit(0)).alias(n)
    code = F.when(~F.coalesce(F.ltrim("body").startswith("{"), F.lit(False)), "not_json").when(first.isNull(), "no_choices")
    return responses.select("id", F.coalesce(first["message"]["content"], F.lit("")).alias("content"), F.coalesce(r["model"], F.lit("")).alias("model"), use("prompt_tokens"), use("completion_tokens"), use("total_tokens"), code.alias("error_code"))


def error_row(kind: Column, status: Column, message: Column) -> Column:
    """One shape for all errors; only those of a status carry a code."""
    return F.struct(F.coalesce(message, F.lit("Unknown error")).alias("message"), F.when(kind == "status", status).alias("status_code"))


def readiness(a: Column, b: Column, stopping: Column) -> Column:
    """Of two components: shutting down over unavailable over loading; skipped only if both are."""
    either = lambda s: (a == s) | (b == s)
    calm = a.isin("ready", "skipped") & b.isin("ready", "skipped")
    return (
        F.when(stopping | either("shutting_down"), "shutting_down").when(either("unavailable"), "unavailable").when(either("loading"), "loading")
        .when((a == "skipped") & (b == "skipped"), "skipped").when(calm, "ready").otherwise("unavailable")
    )


def gate(status: Column, fmt: Column | None = None) -> Column:
    """Why work can't start; null if it can. Plain formats need no models, where a format is given."""
    out = F.when(status.isin("ready", "skipped"), F.lit(None).cast("string")).when(status == "loading", "loading").otherwise("unavailable")
    return out if fmt is None else F.when(~fmt.isin("txt", "markdown"), out)


def missing_models(required: Column, present: Column) -> Column:
    return F.array_sort(F.array_except(required, present))


def gate_message(status: Column, missing: Column) -> Column:
    """Why work can't start, in words, with the models that are missing; null if it can."""
    names = F.array_join(missing, ", ")
    absent = F.concat(F.lit("Document models are unavailable"), F.when(names != "", F.concat(F.lit(": "), names)).otherwise(""))
    return F.when(status == "loading", "Document models are still loading").when(status == "unavailable", absent)
