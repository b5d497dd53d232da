"""Language-model scoring: a bigram model with deleted interpolation over the whole corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import arrays, exchange
from tickerloom.llm.language import _in_fold
from tickerloom.session import durable_table

#: Hashes of the end of a text and of the context before its first word; n-grams are told apart by 56 bits.
END, BEGIN = np.uint64(0x1B873593CC9E2D51), np.uint64(0x52DCE729DA3ED6B5)
KEEP = np.uint64(8)
#: Rounds of expectation maximisation, and steps per doubling in the histogram it runs on.
ROUNDS, FINE = 60, 4
#: Context buckets: contexts never seen, then one per power of two.
BUCKETS = 48
#: One text to learn from in so many, by a hash of the text and its id, is held out while the weights are learnt.
HELD = 4


class Batch:
    """The tokens of some texts, in order: each text's words, then its end."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        hashes, counts = [], []
        for piece in arrays.pieces(table.to_batches(), "text"):
            words = arrays.Words(piece["text"], lower=True)
            h, n = words.hashes(), words.counts
            token = np.empty(len(h) + len(n), np.uint64)
            last = np.cumsum(n + 1) - 1
            inner = np.ones(len(token), bool)
            inner[last] = False
            token[inner], token[last] = h, END
            hashes.append(token)
            counts.append(n + 1)
        self.table = table
        token = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
        self.held_out = table["held_out"].to_numpy(zero_copy_only=False).astype(bool) if table.num_rows else np.zeros(0, bool)
        self.learns = np.repeat(~self.held_out, self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first] = BEGIN
        one = token >> KEEP << np.uint64(1)
        two = arrays.mix(arrays.mix(before) + token) >> KEEP << np.uint64(1) | np.uint64(1)
        # distinct n-grams, which of them each token is, and how often the texts to learn from have them
        self.word, self.word_of = np.unique(one, return_inverse=True)
        self.pair, self.pair_of = np.unique(two, return_inverse=True)
        self.word_own = np.bincount(self.word_of[self.learns], minlength=len(self.word))
        self.pair_own = np.bincount(self.pair_of[self.learns], minlength=len(self.pair))

    def by_bucket(self, buckets: int):
        """(bucket, names, own counts): names are sorted, words are even and pairs odd."""
        name = np.concatenate([self.word, self.pair])
        own = np.concatenate([self.word_own, self.pair_own])
        spread = ((name >> np.uint64(25)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)  # the upper 32 of 57 bits
        order = np.lexsort((name, spread))
        name, own, spread = name[order], own[order], spread[order]
        edges = np.flatnonzero(np.diff(spread, prepend=-1))
        for begin, end in zip(edges, np.append(edges[1:], len(spread)), strict=True):
            yield int(spread[begin]), name[begin:end], own[begin:end]

    def place(self, names: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals of the batch's words and pairs."""
        order = np.argsort(names, kind="stable")
        names, totals = names[order], totals[order]
        return totals[np.searchsorted(names, self.word)], totals[np.searchsorted(names, self.pair)]


def packed(values: np.ndarray) -> bytes:
    """Integers as byte planes, which compress well when most high bytes are zero."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})


def batch_counts(buckets: int) -> tuple[int, int]:
    """Batches of texts that count, and further ones of texts held out: about equally large, ``buckets`` in all."""
    aside = max(1, buckets // (HELD + 1))
    return max(1, buckets - aside), aside


def gram_buckets(buckets: int) -> int:
    """Buckets of n-grams: fewer than batches, as a batch sends one packed row to each."""
    return max(256, buckets // 4)


def _ask(buckets: int):
    """A batch -> its n-grams, by bucket, with their counts in the texts to learn from."""

    def ask(table: pa.Table) -> pa.Table:
        batch = Batch(table)
        number = table["batch"][0].as_py()
        rows = [(bucket, number, packed(np.diff(name, prepend=np.uint64(0))), packed(own)) for bucket, name, own in batch.by_bucket(buckets)]
        return _rows(rows, ["bucket", "batch", "names", "own"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return ask


def _count(plain: int):
    """A bucket -> for each batch the totals of what it asked for, for held-out ones (from ``plain`` on) also what all of these have; for batch -1 the number of distinct words learnt."""

    def count(table: pa.Table) -> pa.Table:
        number = table["batch"].to_pylist()
        names = [np.cumsum(unpacked(x), dtype=np.uint64) for x in table["names"].to_pylist()]
        own = [unpacked(x).astype(np.int64) for x in table["own"].to_pylist()]
        distinct, of = np.unique(np.concatenate(names), return_inverse=True)
        total, held = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        edges = np.cumsum([0, *map(len, names)])
        for n, x, begin, end in zip(number, own, edges, edges[1:], strict=False):
            total[of[begin:end]] += x  # the names of a batch are distinct
            if n >= plain:
                held[of[begin:end]] += x
        rows = [
            (n, table["bucket"][0].as_py(), packed(total[of[begin:end]]), packed(held[of[begin:end]]) if n >= plain else None, 0)
            for n, begin, end in zip(number, edges, edges[1:], strict=False)
        ]
        rows.append((-1, table["bucket"][0].as_py(), None, None, int(((distinct & np.uint64(1) == 0) & (total > 0)).sum())))
        return _rows(rows, ["batch", "bucket", "totals", "held", "learnt"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()])

    return count


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the logarithm of its count."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


_FACTS = (
    "kind int, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, words array<long>, pairs array<long>, "
    "b int, i int, j int, n double, word double, pair double"
)


def _attach(buckets: int, plain: int):
    """A batch and its totals -> 0: documents with the counts of their tokens; 1: a held-out batch's histogram; 2: words learnt."""

    def attach(table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = {n: pa.nulls(0, t) for n, t in _FIELDS}
        if not table.num_rows:
            return _facts(empty, 2, {"n": [float(sum(answers["learnt"].to_pylist()))]})
        batch = Batch(table)
        names = {bucket: name for bucket, name, _ in batch.by_bucket(buckets)}

        def told(column: str) -> tuple[np.ndarray, np.ndarray]:
            found = {b: unpacked(t) for b, t in zip(answers["bucket"].to_pylist(), answers[column].to_pylist(), strict=True)}
            return batch.place(np.concatenate([*names.values()]), np.concatenate([found[b] for b in names]).astype(np.int64))

        word, pair = told("totals")
        words, pairs = word[batch.word_of], pair[batch.pair_of]
        offsets = np.append(batch.first, len(words)).astype(np.int32)
        sums = lambda x: np.add.reduceat(x, batch.first)
        docs = _facts(empty, 0, {
            "doc_id": batch.table["doc_id"].combine_chunks(),
            "held_out": batch.held_out,
            "n_tokens": batch.counts,
            "n_known": sums((words > 0).astype(np.int64)),
            "logs": sums(np.log10(words + 1.0)),
            "words": pa.ListArray.from_arrays(pa.array(offsets), pa.array(words)),
            "pairs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs)),
        })
        if table["batch"][0].as_py() < plain:
            return docs
        # held out: what the texts that aren't know of this batch's tokens. The context of a first word is told by the ends.
        learns = batch.learns
        held_word, held_pair = told("held")
        left_word, left_pair = (word - held_word)[batch.word_of], (pair - held_pair)[batch.pair_of]
        ends = left_word[batch.first + batch.counts - 1]
        context = np.empty_like(left_word)
        context[1:] = left_word[:-1]
        context[batch.first] = ends
        w, p, c = left_word[learns].astype(np.float64), left_pair[learns].astype(np.float64), context[learns].astype(np.float64)
        share = np.divide(p, c, out=np.zeros_like(p), where=c > 0)
        b = context_bucket(c)
        i = np.where(w > 0, np.floor(FINE * np.log2(np.maximum(w, 1))) + 1, 0).astype(np.int64)
        j = np.where(share > 0, np.floor(FINE * np.log2(np.maximum(share, 2.0**-60))) + 60 * FINE + 1, 0).astype(np.int64)
        cell, of = np.unique((b.astype(np.int64) << 40) | (i << 20) | j, return_inverse=True)
        n = np.bincount(of, minlength=len(cell)).astype(np.float64)
        held = _facts(empty, 1, {
            "b": cell >> 40, "i": (cell >> 20) & 0xFFFFF, "j": cell & 0xFFFFF,
            "n": n, "word": np.bincount(of, w, len(cell)), "pair": np.bincount(of, share, len(cell)),
        })
        return pa.concat_tables([docs, held])

    return attach


_FIELDS = [
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()),
    ("words", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int64())), ("b", pa.int32()), ("i", pa.int32()), ("j", pa.int32()),
    ("n", pa.float64()), ("word", pa.float64()), ("pair", pa.float64()),
]


def _facts(empty: dict, kind: int, given: dict) -> pa.Table:
    size = len(next(iter(given.values())))
    given = {"kind": np.full(size, kind)} | given
    return pa.table({n: (pa.array(given[n]) if not isinstance(given[n], pa.Array) else given[n]).cast(t) if n in given else pa.nulls(size, t) for n, t in _FIELDS})


def mixture_weights(cells: list[tuple], tokens: float, words: float) -> np.ndarray:
    """Weights of the uniform, word and pair estimates per context bucket, by expectation maximisation.

    ``cells`` holds (bucket, events, sum of word counts, sum of pair shares) of
    the histogram's cells; within a cell the estimates are taken at their mean.
    A bucket without events takes the weights of the one below it.
    """
    if not tokens:
        return np.tile([1.0, 0.0, 0.0], (BUCKETS, 1))
    weights = np.tile([0.5, 0.5, 0.0], (BUCKETS, 1))
    by: dict[int, list] = {}
    for b, n, word, pair in cells:
        by.setdefault(int(b), []).append((n, word / n / max(tokens, 1), pair / n))
    for b in range(BUCKETS):
        if b not in by:
            weights[b] = weights[b - 1] if b > 1 else weights[b]
            continue
        n, word, pair = np.array(sorted(by[b])).T
        given = np.stack([np.full(len(n), 1 / (words + 1)), word, pair if b else np.zeros(len(n))])
        own = np.full(3, 1 / 3) if b else np.array([0.5, 0.5, 0.0])
        for _ in range(ROUNDS):
            part = own[:, None] * given
            own = (part / part.sum(axis=0) * n).sum(axis=1) / n.sum()
        # nothing that can happen may cost an endless logarithm
        own = np.maximum(own, [1e-6, 1e-6, 0.0])
        weights[b] = own / own.sum()
    return weights


def _score(weights: np.ndarray, tokens: float, words: float, texts: float):
    def score(batches):
        for batch in batches:
            counts = batch["n_tokens"].to_numpy(zero_copy_only=False)
            if not len(counts):
                continue
            word = batch["words"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            pair = batch["pairs"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            first = np.cumsum(counts) - counts
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[first] = texts
            own = weights[context_bucket(context)]
            share = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
            chance = own[:, 0] / (words + 1) + own[:, 1] * word / max(tokens, 1) + own[:, 2] * share
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "logs")), pa.array(np.add.reduceat(np.log10(chance), first))],
                ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"],
            )

    return score


def score_texts(docs: DataFrame, *, folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document.

    Learns from rows whose crc32(doc_id) modulo ``folds`` is not ``held_out``.
    P(w | h) = l3 c(h, w) / c(h) + l2 c(w) / N + l1 / (V + 1), where the weights l
    go by the bucket of c(h) and h is the token before w, or the beginning. The
    weights are learnt by expectation maximisation on held-out counts: one text to
    learn from in ``HELD``, by hash, is held out, and its tokens meet the counts of
    the others in the histogram that the iterations run on. With these weights all
    texts to learn from are counted. So scores follow from the rows alone, however
    they are dealt; only the order of sums can change a last digit.

    Texts lie in batches by hash. A batch sends its distinct n-grams, with its own
    counts, to their buckets and gets the totals back; so an n-gram, however
    common, travels once per batch. Both are packed rows.

    Null or empty text: one token, the end. Null doc_id: folded as an empty id.
    Repeated rows count, and are scored, as often as they stand. With nothing to
    learn from, each token has 1 / (V + 1) = 1. Empty table: empty result. Other
    columns play no part. N-grams are told apart by 56-bit hashes.
    """
    spark = docs.sparkSession
    arrays.bounded_batches(spark)
    plain, held = batch_counts(exchange.bucket_count(spark))
    buckets = gram_buckets(plain + held)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = rows.select("doc_id", "text", (_in_fold(F.col("doc_id"), folds) == held_out).alias("held_out"))
    h = F.xxhash64("doc_id", "text")
    aside = ~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", "text", F.lit("held")), F.lit(HELD)) == 0)
    texts = texts.withColumn("batch", F.when(aside, plain + F.pmod(h, F.lit(held))).otherwise(F.pmod(h, F.lit(plain))).cast("int"))
    asked = texts.groupBy("batch").applyInArrow(_ask(buckets), "bucket int, batch int, names binary, own binary")
    answers = asked.groupBy("bucket").applyInArrow(_count(plain), "batch int, bucket int, totals binary, held binary, learnt long")
    facts = durable_table(texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_attach(buckets, plain), _FACTS))

    known = facts.where("kind = 0")
    sums = facts.agg(
        F.sum(F.when((F.col("kind") == 0) & ~F.col("held_out"), F.col("n_tokens"))).alias("tokens"),
        F.count(F.when((F.col("kind") == 0) & ~F.col("held_out"), 1)).alias("texts"),
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("words"),
    ).first()
    tokens, words = float(sums["tokens"] or 0), float(sums["words"] or 0)
    # a bounded number of cells, whatever the corpus
    cells = facts.where("kind = 1").groupBy("b", "i", "j").agg(F.sum("n").alias("n"), F.sum("word").alias("word"), F.sum("pair").alias("pair")).select("b", "n", "word", "pair").collect()
    weights = mixture_weights([tuple(c) for c in cells], tokens, words)
    scored = known.select("doc_id", "held_out", "n_tokens", "n_known", "logs", "words", "pairs").mapInArrow(
        _score(weights, tokens, words, float(sums["texts"] or 0)), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(tokens + words + 1))).alias("base_score"), "score",
    )


def op5_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
