"""Documents of symbols that no single row can hold: a header, and the articles in parts.

The prompt of such a symbol doesn't hold its whole digest either, but a tree of
digests: pieces are condensed in groups, level by level, until the rest fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickerloom.operators.ledger import Ledger
from tickerloom.operators.scoring import ScorerFactory, score_rows
from tickerloom.plans import documents as dc
from tickerloom.session import durable_table

#: Characters of a news block; beyond, a symbol's digest is condensed.
BLOCK_CHARS = 200_000
#: Pieces that are condensed into one.
FAN_IN = 8

# A plain default; the prompt is a parameter of the run.
CONDENSE_TEMPLATE = """Condense this part of a symbol's news. Keep the day headings and what matters for the share.

{text}"""


def digest_tree(
    placed: DataFrame, make_scorer: ScorerFactory, most: int = BLOCK_CHARS, fan_in: int = FAN_IN,
    template: str = CONDENSE_TEMPLATE, tasks: int | None = None, ledger: Ledger | None = None,
) -> DataFrame:
    """``symbol, news_block, lost``: blocks of at most ``most`` characters, or of one piece.

    A symbol whose digest fits keeps it as it is. Any other's pieces are condensed
    in groups of ``fan_in`` neighbours, level by level; each level has a
    ``fan_in``-th of the pieces of the one below. Answers of a level are written
    before the next is asked. A group whose call fails is left out and counted in
    ``lost``. No row holds more than ``fan_in`` pieces of bounded size.
    """
    if fan_in < 2:
        raise ValueError("fan_in is at least 2")
    level = durable_table(dc.digest_pieces(placed).withColumn("lost", F.lit(0).cast("long")))
    while True:
        sizes = level.groupBy("symbol").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("chars"), F.count("*").alias("pieces"))
        large = durable_table(sizes.where((F.col("chars") > most) & (F.col("pieces") > 1)).select("symbol"))
        if large.isEmpty():
            break
        group = F.floor((F.col("piece") - 1) / fan_in) + 1
        grouped = level.join(large, "symbol", "left_semi").groupBy("symbol", group.alias("piece")).agg(
            dc.joined_lines(F.col("piece"), F.col("text")).alias("whole"), F.sum("lost").alias("lost")
        )
        asked = F.col("whole")
        prompt = dc.render(template, lambda found, asked=asked: asked if found.group() == "{text}" else F.lit(found.group()))
        condensed = score_rows(grouped, prompt, make_scorer, tasks, ledger).select(
            "symbol", "piece", F.coalesce("reply", F.lit("")).alias("text"), (F.col("lost") + F.col("reply").isNull().cast("long")).alias("lost")
        )
        level = durable_table(level.join(large, "symbol", "left_anti").select("symbol", "piece", "text", "lost").unionByName(condensed))
    lost = level.groupBy("symbol").agg(F.sum("lost").alias("lost"))
    return dc.whole_blocks(level.where((F.col("text") != "") | (F.col("piece") == 1))).join(lost, "symbol")


def document_parts(placed: DataFrame, counts: DataFrame, contexts: DataFrame, model: str, analysis_date: str | None = None) -> DataFrame:
    """``symbol, part, header, articles``: part 0 is the document without its articles, parts 1, 2, ... are these, in order.

    ``contexts`` as for ``documents.analysis_documents``, with blocks of the
    digest tree where a whole one would not fit.
    """
    headers = dc.document_headers(counts, contexts, model, analysis_date)
    header = F.struct(*[c for c in headers.columns if c != "symbol"])
    pieces = dc.article_pieces(placed).select("symbol", F.col("piece").cast("long").alias("part"), "articles")
    return headers.select("symbol", F.lit(0).cast("long").alias("part"), header.alias("header")).unionByName(pieces, allowMissingColumns=True)


def whole_documents(parts: DataFrame) -> DataFrame:
    """The documents of symbols whose parts fit in one row, as ``documents.analysis_documents`` gives them."""
    heads = parts.where("part = 0").select("symbol", "header.*")
    lists = dc.whole_lists(parts.where("part > 0").select("symbol", F.col("part").alias("piece"), "articles"))
    return heads.join(lists, "symbol").select(*dc.DOCUMENT)


def write_parts(parts: DataFrame, path: str) -> None:
    """Parquet by symbol range: a symbol's parts lie side by side, in order, over as many files as they need."""
    parts.repartitionByRange("symbol", "part").sortWithinPartitions("symbol", "part").write.mode("overwrite").parquet(path)
