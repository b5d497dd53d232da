"""A day's run: landed news to labels, translations and documents.

Model calls are slow and paid for, and their answers may differ from call to
call. Each step's answers are therefore written once before anything else
reads them: later steps, retries and lost executors see the same ones. With a
``ledger`` they outlive the run: a run that broke off is started again and asks
only what has no answer yet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.constants import BLOCKED_KEYWORDS, CHUNK_ROWS, LABELS, NOISE_KEYWORDS, WINDOW_DAYS
from tickerloom.functions import text as tx
from tickerloom.functions.values import lenient_timestamp
from tickerloom.operators import chunks as ch, lookups as lk, news as nw
from tickerloom.operators.ledger import Ledger
from tickerloom.operators.scoring import ScorerFactory, analyse_articles, classify, score_rows
from tickerloom.plans import documents as dc, parts as pt
from tickerloom.session import durable_table


def _open(rows: DataFrame, key: str, done: DataFrame | None) -> DataFrame:
    return rows if done is None else lk.to_do(rows, done, key)


def skipped(symbols: DataFrame, news: DataFrame, done: DataFrame, key: str = "symbol") -> DataFrame:
    """Expected symbols a run leaves out, with the reason: done, no input, or no valid rows."""
    finished = lk.already_done(symbols, done, key).withColumn("reason", F.lit("done"))
    date = lenient_timestamp(F.col("date"))
    valid = date.isNotNull() & ~tx.is_junk_title(F.coalesce("title", F.lit("")))
    return finished.unionByName(lk.missing_inputs(lk.to_do(symbols, done, key), news, key, valid))


def label_prompt(blocked: Sequence[str] = BLOCKED_KEYWORDS, **prefixes: str) -> Column:
    """Prompt of the label model; ``prefixes`` are those of ``classifier_input``."""
    body = F.coalesce("content", F.lit(""))
    return tx.classifier_input(F.col("title"), body, (body == "") | tx.is_blocked(body, blocked), **prefixes)


def label_news(
    news: DataFrame, make_scorer: ScorerFactory, days: int = WINDOW_DAYS,
    noise: Sequence[str] = NOISE_KEYWORDS, labels: Sequence[str] = LABELS,
    prompt: Column | None = None, tasks: int | None = None, done: DataFrame | None = None, ledger: Ledger | None = None,
) -> DataFrame:
    """Valid, recent news of every symbol with its label.

    Symbols in ``done`` are left out; ``skipped`` lists them. Pass an empty ``noise`` for news that was filtered before translation.
    All filters stand before the model: Spark does not move a filter below
    a Python call.
    """
    kept = nw.drop_noise(nw.valid_news(_open(news, "symbol", done)), noise)
    recent = nw.recent_window(kept, "symbol", "date", days)
    return durable_table(classify(recent, label_prompt() if prompt is None else prompt, make_scorer, labels, tasks=tasks, ledger=ledger))


# A plain default; the prompt is a parameter of the run.
TRANSLATION_TEMPLATE = """Translate title and body of each article below into Korean.
Answer with one JSON array and nothing else; give each item the fields id, title and content.
The first id is {start}.

{articles}"""


def translate_news(
    news: DataFrame, make_scorer: ScorerFactory, noise: Sequence[str] = NOISE_KEYWORDS,
    size: int = CHUNK_ROWS, tasks: int | None = None, template: str = TRANSLATION_TEMPLATE,
    done: DataFrame | None = None, ledger: Ledger | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Translated rows, matched by id, and the rows no reply answered.

    Rows are numbered newest first, the order in which news is landed.
    ``template`` places ``{articles}``, the lines of a chunk, and ``{start}``,
    the id of its first line. Tickers in ``done`` are left out.
    """
    newest_first = [F.col("date").desc(), F.col("id")]
    prompts = ch.chunk_prompts(nw.drop_noise(_open(news, "ticker", done), noise), size, newest_first)
    values = {"articles": F.col("prompt"), "start": (F.col("rows")[0]["row_id"] - 1).cast("string")}
    prompts = prompts.withColumn("prompt", dc.render(template, lambda found: values.get(found.group(1), F.lit(found.group()))))
    replied = durable_table(score_rows(prompts, F.col("prompt"), make_scorer, tasks, ledger))
    return ch.match_replies(replied), ch.unanswered(replied)


def analyse_news(
    news: DataFrame, make_scorer: ScorerFactory, prompt: Column, tasks: int | None = None, chars: int | None = None,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Cleaned articles with the model's analysis. ``prompt`` may use the
    cleaned text, or its first ``chars`` characters, as ``content_cleaned``."""
    cleaned = news.withColumn("content_cleaned", tx.article_head(tx.strip_boilerplate(F.col("content")), chars))
    return durable_table(analyse_articles(cleaned, prompt, make_scorer, tasks, ledger))


def build_documents(
    labelled: DataFrame, fundamentals: DataFrame, make_scorer: ScorerFactory | None, model: str,
    labels: Sequence[str] = LABELS, tasks: int | None = None, done: DataFrame | None = None, ledger: Ledger | None = None,
) -> DataFrame:
    """One analysis document per symbol of labelled news. Fundamentals may be
    missing. Symbols in ``done``, such as those of ``read_documents`` for this
    model and day, are left out."""
    labelled = _open(labelled, "symbol", done)
    placed = dc.place_articles(labelled)
    counts = nw.daily_counts(labelled)
    contexts = dc.symbol_contexts(placed, counts, dc.analyst_blocks(fundamentals), labels)
    if make_scorer is not None:
        contexts = durable_table(dc.judge(contexts, make_scorer, tasks=tasks, ledger=ledger))
    return dc.analysis_documents(placed, counts, contexts, model)


def build_parts(
    labelled: DataFrame, fundamentals: DataFrame, make_scorer: ScorerFactory, make_condenser: ScorerFactory, model: str,
    labels: Sequence[str] = LABELS, tasks: int | None = None, ledger: Ledger | None = None, most: int = pt.BLOCK_CHARS, piece_rows: int = dc.PIECE_ROWS,
) -> DataFrame:
    """``build_documents`` for windows that no row can hold: documents in parts, judged on digests of at most ``most`` characters."""
    placed = dc.place_articles(labelled, piece_rows)
    counts = nw.daily_counts(labelled)
    news = durable_table(pt.digest_tree(placed, make_condenser, most, tasks=tasks, ledger=ledger)).drop("lost")
    contexts = dc.symbol_contexts(placed, counts, dc.analyst_blocks(fundamentals), labels, news)
    return pt.document_parts(placed, counts, durable_table(dc.judge(contexts, make_scorer, tasks=tasks, ledger=ledger)), model)
