"""Text blocks, prompts and the nested analysis document of each symbol.

One document, one prompt and one judgment per symbol, whatever its size. Text
and article lists are put together in two steps: pieces of at most
``PIECE_ROWS`` articles, over all tasks, then the pieces of a symbol in order.
The second step moves one row per piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tickerloom.constants import ANALYST_LINES, LABELS, MISSING_FIELD
from tickerloom.functions.values import (
    billions, clock_text, day_text, fixed, month_text, number_text, pad_left, pad_right, percent_bar,
)
from tickerloom.operators.fundamentals import first_record, record_fields
from tickerloom.operators.labels import count_pairs, day_label_map, label_map, label_shares, news_period
from tickerloom.operators.ledger import Ledger
from tickerloom.operators.lookups import attach
from tickerloom.operators.ordering import ORDINAL, SEGMENT, lay_out
from tickerloom.operators.scoring import ScorerFactory, score_rows

# Articles put together in one group; the result does not depend on it.
PIECE_ROWS = 1000

# fixed values: line formats of the text blocks
DAY_HEADER = ("\n── ", " ──")
SENTIMENT_TOTAL = ("총 뉴스 ", "건 분석 결과:")
SENTIMENT_DAYS = "\n날짜별 감정 흐름:"

# The prompt is a parameter of the run; this is a plain default. The headings
# asked for are the ones the replies are read by.
JUDGMENT_TEMPLATE = """Recent articles, label statistics and analyst figures of one symbol follow.

[News]
{news}

[Labels]
{labels}

[Analysts]
{analysts}

Answer under these headings: [핵심 요약] [전체 흐름 분석] [긍정 요인] [부정 요인]
[투자 인사이트] [투자 판단] [판단 근거]. Under [투자 판단] write 투자, 보류 or 비투자."""


def place_articles(recent: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Place and piece of each recent article in the two orders the document uses.

    Expects ``symbol, id, date, title, url, sentiment``. ``digest``: days
    ascending; ``list``: newest first. Inside a day both go newest first.
    """
    table = lay_out(
        recent.withColumn("day", F.to_date("date")), ["symbol", "day"], [F.col("date").desc(), F.col("id")]
    )
    # one small row per symbol, day and task: what each row's place is counted from
    parts = table.groupBy("symbol", "day", SEGMENT).agg(F.count("*").alias("_rows"), F.min(ORDINAL).alias("_first"))
    rows = F.sum("_rows")
    same_day = Window.partitionBy("symbol", "day").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    by_symbol = Window.partitionBy("symbol")
    day_no = F.unix_date("day").cast("bigint")
    earlier = by_symbol.orderBy(day_no).rangeBetween(Window.unboundedPreceding, -1)
    later = by_symbol.orderBy(day_no.desc()).rangeBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    starts = parts.select(
        "symbol", "day", SEGMENT,
        (F.coalesce(rows.over(same_day), none) - F.col("_first") + 1).alias("_shift"),
        F.coalesce(rows.over(earlier), none).alias("_earlier"),
        F.coalesce(rows.over(later), none).alias("_later"),
    )
    piece = lambda place: F.floor((place - 1) / piece_rows) + 1
    return (
        attach(table, starts, ["symbol", "day", SEGMENT])
        .withColumn("in_day", F.col(ORDINAL) + F.col("_shift"))
        .withColumn("digest_place", F.col("_earlier") + F.col("in_day"))
        .withColumn("list_place", F.col("_later") + F.col("in_day"))
        .withColumn("digest_piece", piece(F.col("digest_place")))
        .withColumn("list_piece", piece(F.col("list_place")))
        .drop(ORDINAL, SEGMENT, "_shift", "_earlier", "_later")
    )


def digest_pieces(placed: DataFrame) -> DataFrame:
    """symbol, piece, text: a header per day, then one line per article, in pieces of bounded size."""
    line = F.concat(F.lit("  ["), F.col("sentiment"), F.lit("] "), F.col("title"))
    header = F.concat(F.lit(DAY_HEADER[0]), day_text(F.col("day")), F.lit(DAY_HEADER[1] + "\n"))
    text = F.when(F.col("in_day") == 1, F.concat(header, line)).otherwise(line)
    return placed.groupBy("symbol", F.col("digest_piece").alias("piece")).agg(joined_lines(F.col("digest_place"), text).alias("text"))


def whole_blocks(pieces: DataFrame) -> DataFrame:
    """The pieces of each symbol in order as its ``news_block``."""
    return pieces.groupBy("symbol").agg(joined_lines(F.col("piece"), F.col("text")).alias("news_block"))


def news_blocks(placed: DataFrame) -> DataFrame:
    """Per symbol: a header per day, then one line per article."""
    return whole_blocks(digest_pieces(placed))


def joined_lines(place: Column, text: Column) -> Column:
    lines = F.array_sort(F.collect_list(F.struct(place.alias("place"), text.alias("text"))))
    return F.array_join(F.transform(lines, lambda r: r["text"]), "\n")


def article_pieces(placed: DataFrame) -> DataFrame:
    """symbol, piece, articles: the articles newest first, in arrays of bounded size."""
    article = F.struct(
        F.col("list_place"), clock_text(F.col("date")).alias("date"), "title", "url", "sentiment"
    )
    shown = F.transform(
        F.array_sort(F.collect_list(article)),
        lambda a: F.struct(
            a["date"].alias("date"), a["title"].alias("title"), a["url"].alias("url"),
            a["sentiment"].alias("sentiment"),
        ),
    )
    return placed.groupBy("symbol", F.col("list_piece").alias("piece")).agg(shown.alias("articles"))


def article_lists(placed: DataFrame) -> DataFrame:
    """Per symbol: the articles as an array, newest first."""
    return whole_lists(article_pieces(placed))


def whole_lists(pieces: DataFrame) -> DataFrame:
    """Per symbol: the articles of its pieces as one array."""
    in_order = F.array_sort(F.collect_list(F.struct("piece", "articles")))
    return pieces.groupBy("symbol").agg(F.flatten(F.transform(in_order, lambda p: p["articles"])).alias("news_with_sentiment"))


def sentiment_blocks(counts: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Per symbol: total, one bar line per label, then the counts per day.

    ``counts`` holds one row per symbol, day and label of the recent window.
    """
    shares = label_shares(counts, labels)
    line = F.concat(
        F.lit("  "), pad_right(F.col("label"), 10), F.lit(" "),
        pad_left(F.col("n").cast("string"), 3), F.lit("건 ("),
        pad_left(fixed(F.col("pct"), 1), 5), F.lit("%) "), percent_bar(F.col("pct")),
    )
    rank = F.array_position(F.lit(list(labels)), F.col("label"))
    bars = shares.groupBy("symbol", "total").agg(joined_lines(rank, line).alias("bars"))

    per_day = counts.groupBy("symbol", "day").agg(
        count_pairs(F.col("n"), F.col("newest"), F.col("label")).alias("pairs")
    )
    day = day_text(F.col("day"))
    shown = F.array_join(F.transform("pairs", lambda p: F.concat(p["label"], F.lit(":"), p["n"].cast("string"))), ", ")
    flow = per_day.groupBy("symbol").agg(
        joined_lines(F.col("day"), F.concat(F.lit("  "), day, F.lit(": "), shown)).alias("flow")
    )
    total = F.concat(F.lit(SENTIMENT_TOTAL[0]), F.col("total").cast("string"), F.lit(SENTIMENT_TOTAL[1]))
    # both sides hold every symbol, so both joins of this kind are inner: an outer
    # one would filter one side's scan and keep the two from sharing a shuffle
    return bars.join(flow, "symbol").select(
        "symbol",
        F.concat_ws("\n", total, F.col("bars"), F.lit(SENTIMENT_DAYS), F.col("flow")).alias("sentiment_block"),
    )


PLACEHOLDER = re.compile(r"\{(\w+)(?::(\w+))?(?:\|([^}]*))?\}")


def render(template: str, value: Callable[[re.Match], Column]) -> Column:
    """The template as one Column, each placeholder replaced by ``value``."""
    parts, end = [], 0
    for found in PLACEHOLDER.finditer(template):
        parts += [F.lit(template[end:found.start()]), value(found)]
        end = found.end()
    return F.concat(*parts, F.lit(template[end:]))


def _plain(kind: T.DataType) -> Callable[[Column], Column]:
    return number_text if isinstance(kind, T.DoubleType) else lambda c: c.cast("string")


STYLES = {"month": month_text, "billions": billions, "cents": lambda c: fixed(c, 2)}


def analyst_blocks(
    fundamentals: DataFrame, symbol: str = "symbol", endpoints: Sequence[str] | None = None
) -> DataFrame:
    """Per symbol: figures of the first record of each listed endpoint.

    An endpoint without records leaves its lines out; a missing field of a
    present record shows its default. All six endpoints unless named.
    """
    lines = {key: text for key, text in ANALYST_LINES.items() if endpoints is None or key[1] in endpoints}
    # the first records are columns of their own, read once however often shown
    firsts = fundamentals.select(symbol, *[
        first_record(fundamentals, section, endpoint).alias(endpoint) for section, endpoint in lines
    ])

    def block(section: str, endpoint: str, template: str) -> Column:
        present = record_fields(fundamentals, section, endpoint)

        def shown(found: re.Match) -> Column:
            name, style, default = found.groups()
            default = F.lit(MISSING_FIELD if default is None else default)
            if name not in present:
                return default
            as_text = STYLES[style] if style else _plain(present[name])
            return F.coalesce(as_text(F.col(endpoint)[name]), default)

        return F.when(F.col(endpoint).isNotNull(), render(template, shown))

    blocks = [block(section, endpoint, template) for (section, endpoint), template in lines.items()]
    return firsts.select(symbol, F.concat_ws("\n", *blocks).alias("analyst_block"))


def symbol_contexts(
    placed: DataFrame, counts: DataFrame, analysts: DataFrame, labels: Sequence[str] = LABELS, news: DataFrame | None = None
) -> DataFrame:
    """The three text blocks side by side, one row per symbol. ``news`` holds other news blocks than the whole ones."""
    per_symbol = sentiment_blocks(counts, labels).join(analysts, "symbol", "left").withColumn(
        "analyst_block", F.coalesce("analyst_block", F.lit(""))
    )
    return (news_blocks(placed) if news is None else news).join(per_symbol, "symbol")


def fill_template(template: str = JUDGMENT_TEMPLATE) -> Column:
    """The judgment prompt from ``news_block``, ``sentiment_block`` and
    ``analyst_block``. Other braces stay as they are, and text inside the
    blocks is never read as a placeholder."""
    blocks = {"{news}": "news_block", "{labels}": "sentiment_block", "{analysts}": "analyst_block"}
    return render(
        template, lambda found: F.col(blocks[found.group()]) if found.group() in blocks else F.lit(found.group())
    )


def judge(
    contexts: DataFrame, make_scorer: ScorerFactory, template: str = JUDGMENT_TEMPLATE, tasks: int | None = None,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Add the model's ``judgment`` and ``judgment_error`` to each context."""
    return score_rows(contexts, fill_template(template), make_scorer, tasks, ledger).withColumnsRenamed(
        {"reply": "judgment", "error": "judgment_error"}
    )


def analysis_documents(
    placed: DataFrame, counts: DataFrame, contexts: DataFrame, model: str, analysis_date: str | None = None,
) -> DataFrame:
    """One nested document per symbol. ``contexts`` may carry a ``judgment``. ``analysis_date`` defaults to the time of the run.
    """
    whole = document_headers(counts, contexts, model, analysis_date).join(article_lists(placed), "symbol")
    return whole.select("symbol", *[c for c in DOCUMENT if c != "symbol"])


# the fields of a document in their order
DOCUMENT = [
    "symbol", "meta", "sentiment_summary", "sentiment_by_date", "news_with_sentiment", "analyst_context", "investment_judgment",
]


def document_headers(counts: DataFrame, contexts: DataFrame, model: str, analysis_date: str | None = None) -> DataFrame:
    """One document per symbol without its list of articles."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    written = F.lit(analysis_date) if analysis_date else now
    stats = news_period(counts).join(label_map(counts), "symbol").join(day_label_map(counts), "symbol")
    whole = contexts.join(stats, "symbol")
    judgment = F.coalesce("judgment", F.lit("")) if "judgment" in contexts.columns else F.lit("")
    return whole.select(
        "symbol",
        F.struct(
            "symbol", written.alias("analysis_date"), "news_period", "news_count", F.lit(model).alias("model")
        ).alias("meta"),
        "sentiment_summary",
        "sentiment_by_date",
        F.struct("news_block", "sentiment_block", "analyst_block").alias("analyst_context"),
        judgment.alias("investment_judgment"),
    )
