"""Batched model calls inside Spark tasks.

A scorer factory is a function without arguments that returns
``score(texts: list[str]) -> list[str]``. It is called once per task, so a
client is opened once and used for all of the task's batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.constants import DEFAULT_LABEL, LABELS
from tickerloom.functions.replies import read_label
from tickerloom.operators.ledger import Ledger
from tickerloom.operators.replies import with_analysis
from tickerloom.session import bounded_batches

Scorer = Callable[[list[str]], list[str]]
ScorerFactory = Callable[[], Scorer]


CALL_ROWS = 32
#: Characters of the texts of a call, and of the replies that are held before they go back; a longer one goes alone.
CALL_CHARS = 1 << 20


def call_model(prompt: Column, make_scorer: ScorerFactory, call_rows: int = CALL_ROWS) -> Column:
    """``struct<reply, error>`` per row. Only the prompt goes to Python.

    The scorer is given up to ``call_rows`` texts at a time. If such a call
    fails, its texts are tried one by one: a bad row costs no other row its
    reply, and few are asked again. Calls are bounded by characters, too, and
    replies go back as they come, so a worker holds one batch of prompts and
    few replies, however many rows its task has. Marked nondeterministic so
    that the plan never calls the model twice for one row.
    """

    @F.pandas_udf("reply string, error string")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = make_scorer()

        def one(text):
            try:
                return score([text])[0], None
            except Exception as failure:
                return None, f"{type(failure).__name__}: {failure}"

        def several(texts):
            try:
                replies = score(texts)
                if len(replies) == len(texts):
                    return [(reply, None) for reply in replies]
            except Exception:
                pass
            return [one(text) for text in texts]

        def calls(texts):
            call, size = [], 0
            for text in texts:
                more = len(text or "")
                if call and (len(call) >= call_rows or size + more > CALL_CHARS):
                    yield call
                    call, size = [], 0
                call.append(text)
                size += more
            if call:
                yield call

        for batch in batches:
            pairs, held = [], 0
            for texts in calls(batch):
                pairs += several(texts)
                held += sum(len(reply or "") for reply, _ in pairs[-len(texts):])
                if held >= CALL_CHARS:
                    yield pd.DataFrame(pairs, columns=["reply", "error"])
                    pairs, held = [], 0
            if pairs:
                yield pd.DataFrame(pairs, columns=["reply", "error"])

    return scored.asNondeterministic()(prompt)


def score_rows(
    df: DataFrame, prompt: Column, make_scorer: ScorerFactory, tasks: int | None = None, ledger: Ledger | None = None
) -> DataFrame:
    """Add ``reply`` and ``error``.

    Prompts are few bytes but slow to answer, so partitions sized by bytes
    can leave the calls to a handful of tasks; ``tasks`` spreads them. With a
    ``ledger``, equal prompts are asked once, and those it has answers to not at all.
    """
    if ledger:
        return ledger.answered(df, prompt, lambda rows: score_rows(rows, F.col("prompt"), make_scorer, tasks))
    bounded_batches(df.sparkSession)
    if tasks:
        df = df.repartition(tasks)
    return (
        df.withColumn("_scored", call_model(prompt, make_scorer))
        .withColumn("reply", F.col("_scored.reply"))
        .withColumn("error", F.col("_scored.error"))
        .drop("_scored")
    )


def classify(
    news: DataFrame, prompt: Column, make_scorer: ScorerFactory,
    labels: Sequence[str] = LABELS, default: str = DEFAULT_LABEL, tasks: int | None = None, ledger: Ledger | None = None,
) -> DataFrame:
    """Add ``sentiment``; a failed call or an unknown word gives ``default``."""
    return score_rows(news, prompt, make_scorer, tasks, ledger).withColumn(
        "sentiment", read_label(F.col("reply"), labels, default)
    ).drop("reply")


def analyse_articles(
    news: DataFrame, prompt: Column, make_scorer: ScorerFactory, tasks: int | None = None, ledger: Ledger | None = None
) -> DataFrame:
    """Add the article analysis columns; failures give the fixed record."""
    scored = score_rows(news, prompt, make_scorer, tasks, ledger)
    return with_analysis(scored, F.col("reply"), F.col("error")).drop("reply")


def cue_scorer(cues: Mapping[str, Sequence[str]], default: str = DEFAULT_LABEL) -> ScorerFactory:
    """Stand-in for a label model: the first label with a cue in the text.

    For tests and dry runs; it does not imitate a model's judgment.
    """
    ordered = [(label, [word.lower() for word in words]) for label, words in cues.items()]

    def make():
        def score(texts):
            lowered = [text.lower() for text in texts]
            return [
                next((label for label, words in ordered if any(w in text for w in words)), default)
                for text in lowered
            ]

        return score

    return make
