"""Classifier scores: the text it sees, batch prediction, labels and their verdicts."""

from __future__ import annotations

import ctypes
import multiprocessing
import signal
from collections.abc import Callable, Iterator
from contextlib import suppress
from multiprocessing.connection import Connection

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import fixed_values as fixed
from palisade.functions import text as T

Scorer = Callable[[Column], Column]


def classifier_text(donator: Column, message: Column, readings: Column) -> Column:
    """The first reading without separators; `readings` are those of both fields joined by a blank."""
    raw = T.js_trim(F.concat_ws(" ", F.nullif(donator, F.lit("")), F.nullif(message, F.lit(""))))
    base = F.coalesce(F.get(F.filter(readings, lambda r: r != ""), F.lit(0)), F.lower(raw))
    return T.js_trim(F.regexp_replace(F.regexp_replace(base, r"[|/\\\[\]{}<>*_~`]+", " "), T.SPACE + "+", " "))


def stub_score(text: Column) -> Column:
    """The deterministic stand-in for a model: high where the text holds one word."""
    return F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("gacor")), 0.92).otherwise(0.05)


def softmax(normal: Column, gambling: Column) -> Column:
    """Probability of the second of two logits, stable for large ones."""
    top = F.greatest(normal, gambling)
    return F.exp(gambling - top) / (F.exp(normal - top) + F.exp(gambling - top))


def label_of(normal: Column, gambling: Column) -> Column:
    """1 where gambling is likelier; ties are normal."""
    return (gambling > normal).cast("int")


def label_verdict(label: Column, gambling: Column) -> Column:
    """struct<action, stage, reason> of a label; null where the label is neither 0 nor 1."""
    score = F.when(gambling.isNull(), "?").otherwise(F.format_string("%.4f", gambling))
    made = F.struct(F.when(label == 1, "block").otherwise("allow").alias("action"), F.lit("classifier").alias("stage"), F.concat(F.lit("score="), score).alias("reason"))
    return F.when(label.isin(0, 1), made)


def predict(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[float]]], rows: int = fixed.BATCH_ROWS, limit_ms: int | None = fixed.SCORER_LIMIT_MS) -> DataFrame:
    """df plus label, normal, gambling by a model that `load` gives once per worker.

    Texts go in chunks of `rows`, in order; empty ones as a blank. A chunk that fails, takes longer than limit_ms or has
    another number of scores gives nulls, never a failed job. With a limit the model runs in a process of its own, which is
    killed when a chunk is late.
    """

    @F.pandas_udf("label int, normal double, gambling double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load() if limit_ms is None else _Apart(load, limit_ms)
        try:
            for batch in batches:
                texts, out = [t or " " for t in batch], []
                for at in range(0, len(texts), rows):
                    out += _scored(model, texts[at : at + rows])
                scores = pd.Series(out, dtype="float64")
                yield pd.DataFrame({"label": (scores > 1 - scores).astype("Int32").where(scores.notna()), "normal": 1 - scores, "gambling": scores})
        finally:
            if limit_ms is not None:
                model.close()

    return df.withColumn("_p", run(F.col(text))).select("*", "_p.*").drop("_p")


def _scored(model: Callable[[list[str]], list[float]], chunk: list[str]) -> list[float | None]:
    """The chunk's scores; nulls where the model fails or gives another number of them."""
    try:
        found = list(model(chunk))
    except NotLoaded:
        raise
    except Exception:  # noqa: BLE001 - whatever a model raises, its rows have no score
        found = []
    return found if len(found) == len(chunk) else [None] * len(chunk)


class NotLoaded(RuntimeError):
    """A model that cannot be had, which no row is to blame for."""


class _Apart:
    """A model in a process of its own, killed where a chunk is late and made anew for the next one.

    The process ends with the task, and with its parent, so no hung call outlives either.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list[float]]], limit_ms: int) -> None:
        self.load, self.limit, self.process, self.end = load, limit_ms / 1000, None, None

    def _begin(self) -> None:
        forked = multiprocessing.get_context("fork")
        self.end, far = forked.Pipe()
        self.process = forked.Process(target=_serve, args=(self.load, far, self.end), daemon=True)
        self.process.start()
        far.close()
        # Loading has no limit, and a model that does not load fails the task.
        if failed := self.end.recv():
            self.close()
            raise NotLoaded(f"the model does not load: {failed}")

    def __call__(self, chunk: list[str]) -> list[float]:
        if self.process is None:
            self._begin()
        try:
            self.end.send(chunk)
            if self.end.poll(self.limit):
                return self.end.recv() or []
        except (EOFError, OSError):
            pass  # the process died
        self.close()
        return []

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.process.close()
            self.end.close()
            self.process = self.end = None


def _serve(load: Callable[[], Callable[[list[str]], list[float]]], end: Connection, parent_end: Connection) -> None:
    """Loads a model, says so, and answers chunks with scores (None where the model raises) until nobody asks any more."""
    parent_end.close()
    prctl = getattr(ctypes.CDLL(None), "prctl", None)
    if prctl is not None:
        prctl(1, signal.SIGKILL)  # Linux: die with the parent
    try:
        model = load()
    except Exception as failed:  # noqa: BLE001
        end.send(repr(failed))
        return
    end.send("")
    with suppress(EOFError, OSError):
        while True:
            chunk, found = end.recv(), None
            with suppress(Exception):
                found = [None if score is None else float(score) for score in model(chunk)]
            end.send(found)


def sequence_model(tokenize: Callable[[str], list[int]], logits: Callable[[list[list[int]]], list[tuple[float, float]]], pad: int = 0, most: int = fixed.MAX_TOKENS) -> Callable[[list[str]], list[float]]:
    """A model for `predict` from a tokenizer and a network with two logits (normal, gambling).

    Texts are cut to `most` ids and a chunk's are padded to the longest of them, as the network was trained; the score is the softmax's second part.
    """

    def model(texts: list[str]) -> list[float]:
        ids = [tokenize(text)[:most] for text in texts]
        longest = max(map(len, ids), default=0)
        both = np.array(logits([own + [pad] * (longest - len(own)) for own in ids]), float).reshape(-1, 2)
        powers = np.exp(both - both.max(1, keepdims=True))
        return (powers[:, 1] / powers.sum(1)).tolist()

    return model


def invalid_texts(text: Column) -> Column:
    """Why a prediction request is refused, or null."""
    return F.when(F.coalesce(text, F.lit("")) == "", "text must have at least 1 character")
