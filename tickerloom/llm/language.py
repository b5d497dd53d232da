"""Language identification by string kernels: presence of blended n-grams, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm import arrays

UNKNOWN = "und"
#: Bounds of the sample that the classifier is fitted on: rows of a language, rows in all, and characters of a row, from its first letter on.
PER_LANGUAGE, FIT_ROWS, FIT_CHARS = 300, 20_000, 8000
#: Landmarks: so many in all, so many a language at least.
LANDMARKS, OWN_LANDMARKS = 160, 4
RIDGE, NGRAMS = 1e-3, 3
#: Characters fall into so many classes (a power of two): ASCII letters and marks each have their own, others share by code point.
CLASSES = 128
_BITS = CLASSES.bit_length() - 1


def _class_table() -> np.ndarray:
    """Class of each code point below 65,536. 0 is the gap between words, which white space, digits and ASCII marks share."""
    point = np.arange(65536)
    table = 32 + point % (CLASSES - 32)
    table[:128] = 0
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[0xC0:0xDF] = table[0xE0:0xFF]  # capitals of Latin-1 as their small letters
    table[0xA0] = 0
    return table.astype(np.int32)


_CLASS = _class_table()


def ngram_codes(texts: pa.Array) -> list[np.ndarray]:
    """Per text the distinct codes of its n-grams of 1 to NGRAMS characters."""
    out = []
    for text in texts.to_pylist():
        point = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        own = _CLASS[np.where(point < 65536, point, 32 + point % 1024)]
        own = own[(own > 0) | np.concatenate([[True], own[:-1] > 0])] if len(own) else own  # one gap between words
        codes, gram = [], np.zeros(len(own), np.int32)
        for n in range(1, NGRAMS + 1):
            if len(own) < n:
                break
            gram = gram[: len(own) - n + 1] << _BITS | own[n - 1 :]
            codes.append(_distinct(gram, n))
        out.append(np.concatenate(codes) if codes else np.zeros(0, np.int32))
    return out


def _distinct(gram: np.ndarray, n: int) -> np.ndarray:
    """Distinct codes of n-grams; the bit above marks n."""
    size = 1 << (_BITS * n)
    if len(gram) > size // 64:
        seen = np.zeros(size, bool)
        seen[gram] = True
        gram = np.flatnonzero(seen).astype(np.int32)
    else:
        gram = np.unique(gram)
    return gram | size


def in_turn(labels: list[str]) -> np.ndarray:
    """Places of the labels, the first of each label, then the second of each, and so on."""
    turn: dict[str, int] = {}
    rank = np.zeros(len(labels), np.int64)
    for i, label in enumerate(labels):
        rank[i] = turn[label] = turn.get(label, -1) + 1
    return np.argsort(rank, kind="stable")


class KernelClassifier:
    """One-versus-rest kernel ridge regression on Nyström features of the normalised presence kernel.

    k(x, y) = common n-grams / sqrt(n-grams of x * n-grams of y). With landmarks
    Z, the features of x are k(x, Z) K(Z, Z)^(-1/2); the regression's weights,
    taken back through that root, give one vector of landmark weights per
    language. A batch is scored by two products: presence x landmarks, then
    kernel x weights.
    """

    def __init__(self, codes: list[np.ndarray], labels: list[str]):
        self.languages = sorted(set(labels))
        order = in_turn(labels)[: max(LANDMARKS, OWN_LANDMARKS * len(self.languages))]
        self.place = np.full(2 << (_BITS * NGRAMS), -1, np.int32)
        known = np.unique(np.concatenate([codes[i] for i in order])) if len(order) else np.zeros(0, np.int32)
        self.place[known] = np.arange(len(known))
        self.landmarks = np.zeros((len(known), len(order)), np.float32)
        for column, i in enumerate(order):
            self.landmarks[self.place[codes[i]], column] = 1 / np.sqrt(max(len(codes[i]), 1))
        if not len(codes):
            self.weights = np.zeros((0, 0))
            return
        kernel = self.kernel(codes).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel[order])
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = kernel @ root
        target = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        solved = np.linalg.solve(features.T @ features + RIDGE * len(codes) * np.eye(features.shape[1]), features.T @ target)
        self.weights = root @ solved

    def kernel(self, codes: list[np.ndarray], step: int = 128) -> np.ndarray:
        """k(x, landmark) of each text."""
        out = np.zeros((len(codes), self.landmarks.shape[1]), np.float32)
        for begin in range(0, len(codes), step):
            part = codes[begin : begin + step]
            presence = np.zeros((len(part), self.landmarks.shape[0]), np.float32)
            for i, own in enumerate(part):
                at = self.place[own]
                presence[i, at[at >= 0]] = 1 / np.sqrt(max(len(own), 1))
            out[begin : begin + step] = presence @ self.landmarks
        return out

    def predict(self, codes: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """The language of the highest output, and its share of the outputs brought to 0 .. 1 each."""
        output = np.clip((self.kernel(codes) @ self.weights + 1) / 2, 1e-6, 1)
        best = output.argmax(axis=1)
        return [self.languages[i] for i in best], output[np.arange(len(best)), best] / output.sum(axis=1)


def _in_fold(column: Column, of: int) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % of


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, chars: int = FIT_CHARS, most: int = FIT_ROWS) -> KernelClassifier:
    """Fit on at most ``per_language`` rows of each language and ``most`` in all, of each ``chars`` characters from its first letter on.

    Rows with a letter in their text and a lang count, whatever their length, and
    are taken in the order of a hash of all their columns; if there are too many
    languages, each gets fewer rows, and beyond ``most`` of them the rarest none. Each language's rows are first thinned by that
    hash to a few times the number wanted, so that the ranking sees as many rows
    whatever the table's size.
    """
    place = F.xxhash64(*[F.col(f"`{c}`") for c in labelled.columns])
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", place.alias("h"))
    # a row of the sample is one language's, so at most ``most`` languages can have one
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(most).withColumnRenamed("lang", "of")
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = (
        known.join(F.broadcast(sizes), F.col("lang") == F.col("of"))
        .where((F.col("h") / 2.0**64 + 0.5) * F.col("rows") <= 4 * per_language)
        .select("lang", "h", F.expr(f"substring(text, regexp_instr(text, '\\\\p{{L}}'), {int(chars)})").alias("text"))
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= per_language)
        .orderBy("n", "h", "lang")
        .limit(most)
        .select("text", "lang")
        .toArrow()
    )
    return KernelClassifier(ngram_codes(sample["text"].combine_chunks()) if sample.num_rows else [], sample["lang"].to_pylist())


def with_language(docs: DataFrame, model: KernelClassifier, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all), with lang_pred and score, worked out from the text alone; see :func:`identify`."""
    arrays.bounded_batches(docs.sparkSession)
    names = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    text = F.col("text").cast("string")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text.alias("t"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("known"))
    row_type = packed.schema["row"].dataType.simpleString()

    def classify(batches):
        for batch in arrays.pieces(batches, "t"):
            known = batch["known"].to_numpy(zero_copy_only=False) & bool(model.languages)
            found, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if known.any():
                found[known], score[known] = model.predict(ngram_codes(batch["t"].filter(pa.array(known))))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return packed.mapInArrow(classify, f"row {row_type}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def identify(docs: DataFrame, *, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document.

    Learns from text and non-null lang of rows whose crc32(doc_id) modulo
    ``folds`` is not ``held_out``; predicts from the whole text alone. A text
    that is null or has no letter is ``und`` with score 0, and so is every text
    if there is nothing to learn from. Null doc_id: folded as an empty id. Equal
    outputs go to the language first by code point. Repeated rows are each
    predicted alike; an empty table gives an empty result; other columns, also
    those named like the results, play no part.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", _in_fold(F.col("doc_id"), folds) == held_out)
    model = fit(rows.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return with_language(rows, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
