"""Periodic runs in texts: a suffix automaton whose link tree is recoloured by link-cut accesses."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import arrays

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Passes of the sieve that finds the stretches; it only ever keeps too much, so more passes change no result.
SIEVE_PASSES = 8
WORD = r"[^\x20\x09-\x0D]+"

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def word_ids(words: arrays.Words) -> np.ndarray:
    """A number for each word of a piece, equal for equal words only."""
    lengths = words.ends - words.starts
    edges = np.concatenate([[0], np.cumsum(lengths)])
    data = words.bytes[arrays.spans(words.starts, lengths)]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False)


def stretches(ids: np.ndarray, of: np.ndarray) -> list[tuple[int, int]]:
    """Spans of words, apart from each other, outside which no text has a run.

    In a run of period q and length L each three words from the second period on
    stood at most q words before, at L - q - 2 >= 3q - 2 places in a row (three
    for q = 1). So only places whose three words stood before, at a distance of
    at most a third of the unbroken stretch of such places, can belong to one.
    ``of``: the first word of each text, and the end.
    """
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    wide = ids.astype(np.uint64)
    text = np.repeat(np.arange(len(of) - 1, dtype=np.uint64), np.diff(of))
    key = wide[:-2] * _MIX[0] + wide[1:-1] * _MIX[1] + wide[2:] * _MIX[2] + text[:-2] * _MIX[3]
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    back = np.zeros(n, np.int64)
    back[order[again + 1]] = order[again + 1] - order[again]
    del key, order, wide
    back[:-2][text[:-2] != text[2:]] = 0  # the three words of such a place lie in two texts
    at = np.flatnonzero(back)
    for _ in range(SIEVE_PASSES):
        if not len(at):
            return []
        cut = np.flatnonzero((np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])) + 1
        first = np.concatenate([[0], cut])
        size = np.diff(np.append(first, len(at)))
        reach = (size + 2) // 3
        stay = (back[at] <= np.repeat(reach, size)) & np.repeat(size >= 3, size)
        if stay.all():
            break
        at = at[stay]
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])) + 1
    first = np.concatenate([[0], cut])
    size = np.diff(np.append(first, len(at)))
    begin, of_text = at[first], text[at[first]].astype(np.int64)
    low = np.maximum(begin - (size + 2) // 3, of[of_text])
    high = np.minimum(begin + size + 2, of[of_text + 1])
    out: list[tuple[int, int]] = []
    for a, b, c in zip(low.tolist(), high.tolist(), of[of_text].tolist(), strict=True):
        while out and a < out[-1][1] and out[-1][0] >= c:
            begun, end = out.pop()
            a, b = min(a, begun), max(b, end)
        out.append((a, b))
    return out


class SuffixAutomaton:
    """States by number from 1, the start; ``link`` and ``length`` of each, and the state of each prefix.

    Most states go on with one word, which stands in ``word`` and ``to``; further
    ones are in ``more``. Plain machine integers: 32 bytes a state in all, two
    states a word at most.
    """

    def __init__(self, words: list[int]):
        room = 2 * len(words) + 2
        self.link, self.length, self.word, self.to = (array("i", bytes(4 * room)) for _ in range(4))
        self.more: dict[int, dict[int, int]] = {}
        self.states, self.last = 1, 1
        self.prefix = array("i", [self._append(w + 1) for w in words])

    def _next(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        rest = self.more.get(state)
        return rest.get(word, 0) if rest else 0

    def _go(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (0, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _append(self, word: int) -> int:
        self.states += 1
        new, at = self.states, self.last
        self.length[new] = self.length[at] + 1
        while at and not (known := self._next(at, word)):
            self._go(at, word, new)
            at = self.link[at]
        if not at:
            self.link[new] = 1
        elif self.length[known] == self.length[at] + 1:
            self.link[new] = known
        else:
            self.states += 1
            twin = self.states
            self.length[twin] = self.length[at] + 1
            self.word[twin], self.to[twin] = self.word[known], self.to[known]
            if known in self.more:
                self.more[twin] = dict(self.more[known])
            self.link[twin] = self.link[known]
            self.link[known] = self.link[new] = twin
            while at and self._next(at, word) == known:
                self._go(at, word, twin)
                at = self.link[at]
        self.last = new
        return new


class LastOccurrences:
    """The link tree cut into paths of one colour: the place where the strings of its states last ended.

    A path is a splay tree by depth. The tree of links stands still, as the
    automaton is whole before the words are replayed, so only accesses are needed.
    """

    def __init__(self, automaton: SuffixAutomaton):
        room = automaton.states + 1
        self.up = array("i", automaton.link[:room])
        self.upper, self.lower, self.colour = (array("i", bytes(4 * room)) for _ in range(3))
        self.length = automaton.length

    def _splay(self, x: int) -> None:
        """Bring ``x`` to the root of its path's tree, which holds the path's colour."""
        up, upper, lower, colour = self.up, self.upper, self.lower, self.colour
        while True:
            y = up[x]
            if upper[y] != x and lower[y] != x or not y:
                return
            z = up[y]
            inner = z and (upper[z] == y or lower[z] == y)
            for child in ((y, x) if (upper[y] == x) == (upper[z] == y) else (x, x)) if inner else (x,):
                parent = up[child]
                above = up[parent]
                if upper[parent] == child:
                    moved = lower[child]
                    upper[parent], lower[child] = moved, parent
                else:
                    moved = upper[child]
                    lower[parent], upper[child] = moved, parent
                if moved:
                    up[moved] = parent
                if upper[above] == parent and above:
                    upper[above] = child
                elif lower[above] == parent and above:
                    lower[above] = child
                else:
                    colour[child] = colour[parent]
                up[parent], up[child] = child, above

    def recolour(self, state: int, place: int) -> list[tuple[int, int]]:
        """Colour the path from ``state`` to the start with ``place``: (former colour, greatest length) of each segment it had."""
        up, lower, colour, length = self.up, self.lower, self.colour, self.length
        met = []
        x, below = state, 0
        while x:
            self._splay(x)
            if colour[x]:
                met.append((colour[x], length[x]))
            if lower[x]:
                colour[lower[x]] = colour[x]
            lower[x] = below
            x, below = up[x], x
        self._splay(state)
        colour[state] = place
        return met


def runs_of(words: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of a sequence, by start, then period.

    A string that ends at word i and ended last at word e makes period d = i - e
    over its length and d more words; from length d on that is a square. The last
    of a run's words meets it with the run's whole length less one period, and no
    nearer end can have that string, so the period found is the smallest.
    """
    automaton = SuffixAutomaton(words)
    ends = LastOccurrences(automaton)
    automaton.more = {}
    prefix, n = automaton.prefix, len(words)
    reached: dict[int, int] = {}
    out = []
    for i in range(n):
        for former, size in ends.recolour(prefix[i], i + 1):
            period = i + 1 - former
            if size + period < least_words or size + period < least_periods * period or reached.get(period, -1) >= i:
                continue
            start, end = i - period - size + 1, i + 1
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while end < n and words[end] == words[end - period]:
                end += 1
            reached[period] = end - 1
            out.append((start, end - start, period))
    return sorted(out, key=lambda run: (run[0], run[2]))


def _runs_of_piece(words: arrays.Words, least_words: int, least_periods: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text of a piece; starts count from the text's first word."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(words.of) - 1)]
    if len(words):
        ids = word_ids(words)
        for low, high in stretches(ids, words.of):
            text = int(np.searchsorted(words.of, low, "right")) - 1
            _, own = np.unique(ids[low:high], return_inverse=True)
            shift = low - int(words.of[text])
            found[text] += [(start + shift, length, period) for start, length, period in runs_of(own.tolist(), least_words, least_periods)]
    return found


def _kept_text(words: arrays.Words, found: list[list[tuple[int, int, int]]]) -> pa.Array:
    """The words that no run holds after its first period, joined by one space."""
    edge = np.zeros(len(words) + 1, np.int64)
    for first, runs in zip(words.of, found, strict=False):
        for start, length, period in runs:
            edge[first + start + period] += 1
            edge[first + start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    starts, sizes = words.starts[keep], (words.ends - words.starts)[keep]
    before = np.concatenate([[0], np.cumsum(keep)])[words.of]
    last = before[1:][np.diff(before) > 0] - 1
    # each word with one byte behind it, which becomes the space; a text's last word goes without
    wide = sizes + 1
    wide[last] -= 1
    where = arrays.spans(starts, wide)
    np.minimum(where, max(len(words.bytes) - 1, 0), out=where)
    data = words.bytes[where] if len(where) else np.zeros(0, np.uint8)
    ends = np.cumsum(wide)
    spaces = np.ones(len(wide), bool)
    spaces[last] = False
    data[ends[spaces] - 1] = 0x20
    return arrays.string_array(data, np.diff(np.concatenate([[0], ends])[before]))


def collapse_runs(
    docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with ``n_words``, ``runs`` and ``collapsed``.

    Words are what stands between white space. A run is a stretch of consecutive
    words with smallest period q, at least ``least_words`` words and
    ``least_periods`` periods, that no neighbouring word extends keeping q.
    ``runs`` holds start (word number from 0), length and period of each, by start,
    then period. ``collapsed`` is the text without the words that a run holds after
    its first period, joined by one space.

    ``least_periods`` is at least 4 and ``least_words`` at least 6: below that the
    sieve ahead of the automaton isn't proven. Null and empty texts have no words,
    no runs and an empty ``collapsed``. Each row is judged alone, so ids may be
    null or repeat, repeated rows come out alike, and an empty table gives an
    empty result. Nothing is shuffled; a long text is one row of one task, with 32
    bytes for each state of the stretch at hand. Columns of ``docs`` named like the
    results are replaced.
    """
    if least_periods < LEAST_PERIODS or least_words < LEAST_WORDS:
        raise ValueError(f"runs have at least {LEAST_WORDS} words and {LEAST_PERIODS} periods")
    arrays.bounded_batches(docs.sparkSession)
    names = [c for c in (keep or docs.columns) if c not in ("n_words", "runs", "collapsed")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("x"))
    row_type = packed.schema["row"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def collapse(batches):
        for batch in arrays.pieces(batches, "x"):
            words = arrays.Words(batch["x"])
            found = _runs_of_piece(words, least_words, least_periods)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.array([run for runs in found for run in runs], np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type)))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(words.counts), runs, _kept_text(words, found)], ["row", "n_words", "runs", "collapsed"])

    kinds = f"row {row_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return packed.mapInArrow(collapse, kinds).select("row.*", "n_words", "runs", "collapsed")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` where a tenth of the documents, by crc32 of the id, repeat words from some place on.

    With h = crc32(doc_id) and g = floor(h / 10): if h % 10 = 0, each word i >= a
    becomes word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10).cast("long")
    placed = split.withColumns({"n": n, "g": g}).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def _line(run: Column) -> Column:
    return F.concat_ws(",", run["start"].cast("string"), run["length"].cast("string"), run["period"].cast("string"))


def op12_periodic(spark, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = collapse_runs(docs, keep=["doc_id"])
    # structs compare field by field: greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(_line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
