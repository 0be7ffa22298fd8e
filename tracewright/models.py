"""Pluggable model calls: generators and scorers run in Arrow batches.

A factory builds the model once per worker; no model runtime is part of the
library, so a deterministic stub stands in where none is given.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Generator = Callable[[str, bytes | None, int], str]


class OutOfMemory(RuntimeError):
    """What a generator raises when a call did not fit."""


def stub_generator() -> Generator:
    """A plan that depends on the prompt alone."""
    kinds = ("click", "type", "scroll", "finish")

    def generate(prompt: str, image: bytes | None, max_tokens: int) -> str:
        kind = kinds[hashlib.md5(prompt.encode()).digest()[0] % len(kinds)]
        return f'ACTION_TYPE: {kind} "{prompt[:12]}"' if kind == "type" else f"ACTION_TYPE: {kind}"

    return generate


def call(generate: Generator, prompt: str, image: bytes | None, max_tokens: int, attempts: int, wait: Callable[[float], None]) -> tuple[str, str | None]:
    """One call: half the tokens (16 at least) once if out of memory, new attempts
    after other errors and empty answers, with growing pauses; then an error."""
    error, tokens = "empty answer", max_tokens
    for k in range(1, attempts + 1):
        try:
            if text := generate(prompt, image, tokens):
                return text, None
            error = "empty answer"
        except OutOfMemory as e:
            if tokens < max_tokens:
                return "", str(e)
            error, tokens = str(e), max(16, max_tokens // 2)
            continue
        except Exception as e:  # noqa: BLE001 - the model is foreign code
            error = str(e)
        if k < attempts:
            wait(min(2.0 * k, 8.0))
    return "", error


def generate_plans(df: DataFrame, prompt: str = "prompt", image: str | None = None, factory: Callable[[], Generator] = stub_generator, max_tokens: int = 128, attempts: int = 4, pause: float = 1.0) -> DataFrame:
    """``df`` with output_text, latency and error; a failed call has empty text and an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = factory()
        for pdf in parts:
            rows = []
            for i in range(len(pdf)):
                began = time.perf_counter()
                text, error = call(generate, pdf[prompt].iloc[i] or "", pdf[image].iloc[i] if image else None, max_tokens, attempts, lambda s: time.sleep(s * pause))
                rows.append((text, time.perf_counter() - began, error))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=["output_text", "latency", "error"])], axis=1)

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, output_text string, latency double, error string")


@dataclass
class Answer:
    """What a remote model says, and what it counts for it."""

    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


def call_id(run_id: str, model: str, *keys: Column) -> Column:
    """The name of a call: the same run, model and keys (nulls told from texts) give the same one anywhere."""
    return F.sha2(F.to_json(F.array(F.lit(run_id), F.lit(model), *(k.cast("string") for k in keys))), 256)


def billed_calls(df: DataFrame, run_id: str, model: str, keys: tuple[str, ...], factory: Callable[[], Callable[[str, bytes | None, int], Answer]], prompt: str = "prompt", image: str | None = None, known: DataFrame | None = None, threads: int = 4, max_tokens: int = 128, attempts: int = 4, pause: float = 1.0) -> DataFrame:
    """``df`` with call_id, model, output_text, prompt_tokens, completion_tokens, latency and error.

    A task has at most ``threads`` calls under way, so a cluster has that many times its
    cores; rows keep their order.  Failed attempts that were answered are billed
    too: tokens are those of all answers to a row.  Calls that ``known`` (a ledger)
    holds without an error are not made again and not returned; rows of one call_id
    are one call.  A null prompt is an empty one.
    """
    added = ("call_id", "model", "output_text", "prompt_tokens", "completion_tokens", "latency", "error")
    if clash := {c for c in df.columns if c.lower() in added}:
        raise ValueError(f"columns of calls: {sorted(clash)}")
    todo = df.withColumn("call_id", call_id(run_id, model, *(F.col(k) for k in keys))).dropDuplicates(["call_id"])
    if known is not None:
        todo = todo.join(known.where("error is null").select("call_id"), "call_id", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = factory()

        def one(row: tuple) -> tuple:
            spent, began = [0, 0], time.perf_counter()

            def metered(text: str, picture: bytes | None, tokens: int) -> str:
                answer = generate(text, picture, tokens)
                spent[0] += answer.prompt_tokens
                spent[1] += answer.completion_tokens
                return answer.text

            text, error = call(metered, row[0] or "", row[1], max_tokens, attempts, lambda s: time.sleep(s * pause))
            return model, text, *spent, time.perf_counter() - began, error

        with ThreadPoolExecutor(threads) as pool:
            for pdf in parts:
                rows = list(pool.map(one, zip(pdf[prompt], pdf[image] if image else [None] * len(pdf), strict=True)))
                yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=list(added[1:]))], axis=1)

    kinds = ", ".join(f"`{c}` {t}" for c, t in todo.dtypes)
    return todo.mapInPandas(run, f"{kinds}, model string, output_text string, prompt_tokens long, completion_tokens long, latency double, error string")


def batches_by_length(lengths: np.ndarray, batch: int, cells: int | None = None) -> Iterator[np.ndarray]:
    """Positions in batches of similar lengths, shortest first.

    A batch has ``batch`` rows at most and, padded to its longest, ``cells`` at most;
    a row that is longer than that goes alone.
    """
    order = np.argsort(lengths, kind="stable")
    begin = 0
    for at in range(1, len(order) + 1):
        if at == len(order) or at - begin == batch or (cells is not None and (at + 1 - begin) * lengths[order[at]] > cells):
            yield order[begin:at]
            begin = at


def padding(df: DataFrame, length: Column, padded_to: str = "padded_to") -> DataFrame:
    """One row: used and padded cells, and the share of padded ones that hold nothing."""
    used, padded = F.coalesce(F.sum(length), F.lit(0)).cast("long"), F.coalesce(F.sum(padded_to), F.lit(0)).cast("long")
    return df.agg(used.alias("used"), padded.alias("padded")).withColumn("padding_share", F.when(F.col("padded") > 0, 1 - F.col("used") / F.col("padded")).otherwise(0.0))


BatchGenerator = Callable[[list[str], list[bytes | None], int], list[str]]


def one_by_one(factory: Callable[[], Generator] = stub_generator) -> Callable[[], BatchGenerator]:
    """A batch generator of a generator."""

    def build() -> BatchGenerator:
        generate = factory()
        return lambda prompts, images, tokens: [generate(p, i, tokens) for p, i in zip(prompts, images, strict=True)]

    return build


def generate_batches(df: DataFrame, prompt: str = "prompt", image: str | None = None, factory: Callable[[], BatchGenerator] = one_by_one(), max_tokens: int = 128, batch: int = 16, cells: int | None = None, attempts: int = 4, pause: float = 1.0) -> DataFrame:
    """As :func:`generate_plans`, many prompts a call; with padded_to, the longest prompt of a row's batch.

    Prompts of an Arrow batch are put together by length and answers go back in the rows'
    order.  A batch that doesn't fit is halved; one that fails, or whose
    answers don't match its prompts one to one, is asked row by row, and so are its empty
    answers.  Latency is a row's share of its batch.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = factory()

        def single(text: str, picture: bytes | None) -> tuple[str, str | None]:
            return call(lambda p, i, n: generate([p], [i], n)[0], text, picture, max_tokens, attempts, lambda s: time.sleep(s * pause))

        for pdf in parts:
            prompts = pdf[prompt].fillna("").tolist()
            images = pdf[image].tolist() if image else [None] * len(pdf)
            out: list[tuple] = [()] * len(pdf)
            todo = list(batches_by_length(np.array([len(p) for p in prompts]), batch, cells))[::-1]
            while todo:
                at = todo.pop()
                began = time.perf_counter()
                some = [prompts[i] for i in at], [images[i] for i in at]
                try:
                    answers = generate(*some, max_tokens) if len(at) > 1 else []
                except OutOfMemory:
                    todo += [at[len(at) // 2 :], at[: len(at) // 2]]
                    continue
                except Exception:  # noqa: BLE001 - the model is foreign code; its rows are asked one by one
                    answers = []
                known = answers if len(answers) == len(at) else [""] * len(at)
                done = [(text, None) if text else single(p, i) for text, p, i in zip(known, *some, strict=True)]
                share, width = (time.perf_counter() - began) / len(at), max(map(len, some[0]))
                for i, (text, error) in zip(at, done, strict=True):
                    out[i] = (text, share, error, width)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["output_text", "latency", "error", "padded_to"])], axis=1)

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, output_text string, latency double, error string, padded_to long")


def strict_retry(factory: Callable[[], Generator], readable: str = r"(?i)\b(NO_MATCH|\d+)\b", note: str = "\n(Reply with a single token: an integer index or NO_MATCH)", tokens: int = 4) -> Callable[[], Generator]:
    """A factory whose generator asks once more, with ``note``, where the answer isn't readable."""

    def build() -> Generator:
        generate = factory()

        def ask(prompt: str, image: bytes | None, max_tokens: int) -> str:
            answer = generate(prompt, image, max_tokens) or ""
            return answer if re.search(readable, answer) else generate(prompt + note, image, tokens)

        return ask

    return build


def word_overlap_scorer() -> Callable[[list[tuple[str, str]]], list[float]]:
    """Share of common words: a scorer for tests."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for a, b in pairs:
            x, y = set(a.lower().split()), set(b.lower().split())
            out.append(len(x & y) / max(1, len(x | y)))
        return out

    return score


def score_pairs(df: DataFrame, left: str, right: str, factory=word_overlap_scorer, batch: int = 128, cells: int | None = None, padded_to: bool = False) -> DataFrame:
    """``df`` with ``score`` of each (left, right) text pair, in batches of similar lengths.

    Rows keep their order.  ``cells`` bounds a batch's rows times its longest pair;
    with ``padded_to`` that length is a column, for :func:`padding`.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for pdf in parts:
            pairs = list(zip(pdf[left].fillna(""), pdf[right].fillna(""), strict=True))
            lengths = np.array([len(a) + len(b) for a, b in pairs], np.int64)
            scores, widths = np.zeros(len(pairs)), np.zeros(len(pairs), np.int64)
            for at in batches_by_length(lengths, batch, cells):
                scores[at], widths[at] = score([pairs[i] for i in at]), lengths[at].max()
            yield pdf.assign(score=scores, **({"padded_to": widths} if padded_to else {}))

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, score double" + (", padded_to long" if padded_to else ""))
