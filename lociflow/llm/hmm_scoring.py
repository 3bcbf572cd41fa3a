"""Language-model scores of texts by a hidden Markov model over words.

Word counts are summed over all training texts. The most frequent words are symbols of their own; all others, seen or not,
fall into classes by their last letters, and a word's share of its class comes from its count, so
that the model is a distribution over all words (with one unknown word for each class). Each hidden state emits symbols;
Baum-Welch passes over all training texts return the tasks' expected counts, which are added up by a tree.

Recursions run over many texts at once: texts are ordered by falling length and stored by time, so that a step works on
the rows of all texts that are still running.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import materialise, tree_sum

#: Passes over all training texts; texts whose words the start is fitted to, words that such a text has at most, and rounds.
PASSES, START_TEXTS, START_WORDS, START_ROUNDS = 4, 1024, 2048, 12
#: Weight of the unigram distribution in each state's, in words, and of even transitions.
PRIOR, EVEN = 50.0, 1.0
#: Words of one group of texts in the recursions, and of one stretch of a longer text.
GROUP = 1 << 18
END = 0


@dataclass(frozen=True)
class Sizes:
    """Hidden states, words that are symbols, classes of the others, words whose counts are broadcast, and bytes that a
    word among these has at most. A broadcast table is at most `broadcast` words of `longest` bytes, a model `states`
    doubles for each of `symbols`, which 16 bits number."""

    states: int = 8
    words: int = 16_384
    classes: int = 4_096
    broadcast: int = 262_144
    longest: int = 48

    @property
    def symbols(self) -> int:
        return 1 + self.words + self.classes

    def class_of(self, word: bytes) -> int:
        """Symbol of a word outside the frequent ones, told by its last bytes."""
        return 1 + self.words + crc32(word[-3:]) % self.classes


@dataclass
class Model:
    """start (states), move (states x states) and emit (symbols x states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def words(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased: bytes.split() parts at space and U+0009 to U+000D, bytes.lower() knows A-Z alone."""
    return text.lower().split() if text else []


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from; rows without doc_id are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))


def word_counts(docs: DataFrame, flush: int = 1 << 19) -> DataFrame:
    """(word binary, c long) over all words of docs (text binary), summed in tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                held.update(words(text.as_py()))
                if len(held) > flush:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols by time, places where each time begins, order of the texts) of texts, all with a symbol at least."""
    order = np.argsort([-len(r) for r in rows], kind="stable")
    lengths = np.array([len(rows[i]) for i in order])
    running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    begins = np.concatenate(([0], np.cumsum(running)))
    flat = np.concatenate([rows[i] for i in order])
    time = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.empty(len(flat), np.int32)
    out[begins[time] + np.repeat(np.arange(len(rows)), lengths)] = flat
    return out, begins, order


def forward(model: Model, seen: np.ndarray, begins: np.ndarray, entering: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and scales, by time. seen: the symbols' emissions; entering: distribution of the states
    before the first symbol of each text. A text's likelihood is the product of its scales."""
    alpha, scale = np.empty_like(seen), np.empty(len(seen))
    move = model.move
    for t in range(len(begins) - 1):
        i, j = begins[t], begins[t + 1]
        a = (entering[: j - i] if t == 0 else alpha[begins[t - 1] : begins[t - 1] + j - i] @ move) * seen[i:j]
        c = a.sum(axis=1)
        alpha[i:j] = a / c[:, None]
        scale[i:j] = c
    return alpha, scale


def backward(model: Model, seen: np.ndarray, begins: np.ndarray, scale: np.ndarray, leaving: np.ndarray) -> np.ndarray:
    """Scaled backward probabilities by time; leaving: those after each text's last symbol."""
    beta = np.empty_like(seen)
    back = model.move.T
    weighted = seen / scale[:, None]
    last = len(begins) - 2
    for t in range(last, -1, -1):
        i, j = begins[t], begins[t + 1]
        on = begins[t + 2] - j if t < last else 0
        if on:
            beta[i : i + on] = (weighted[j : j + on] * beta[j : j + on]) @ back
        if on < j - i:
            beta[i + on : j] = leaving[on : j - i]
    return beta


@dataclass
class Counts:
    """Expected counts: of first states, of moves, and of symbols by state, with the log10 likelihood."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log: float = 0.0

    @staticmethod
    def none(symbols: int, states: int) -> Counts:
        return Counts(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.log], self.start, self.move.ravel(), self.emit.ravel()])

    @staticmethod
    def of(flat: np.ndarray, symbols: int, states: int) -> Counts:
        a, b = 1 + states, 1 + states + states * states
        return Counts(flat[1:a].copy(), flat[a:b].reshape(states, states).copy(), flat[b:].reshape(symbols, states).copy(), float(flat[0]))

    def add(self, model: Model, ids: np.ndarray, begins: np.ndarray, entering: np.ndarray, leaving: np.ndarray, first: bool) -> np.ndarray:
        """Add the counts of texts, or of a stretch of one; returns the backward probabilities before the first symbol."""
        seen = model.emit[ids]
        alpha, scale = forward(model, seen, begins, entering)
        beta = backward(model, seen, begins, scale, leaving)
        gamma = alpha * beta
        for k in range(gamma.shape[1]):
            self.emit[:, k] += np.bincount(ids, gamma[:, k], len(self.emit))
        weighted = seen * beta / scale[:, None]
        n = begins[1]
        if len(ids) > n:
            steps = np.diff(begins)
            before = np.arange(n, len(ids)) - np.repeat(steps[:-1], steps[1:])
            self.move += model.move * (alpha[before].T @ weighted[n:])
        if first:
            self.start += gamma[:n].sum(axis=0)
        self.log += float(np.log10(scale).sum())
        return weighted[:n]


def grouped(rows: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of the texts by falling length, in groups of GROUP symbols at most; a longer text stands alone."""
    group, size = [], 0
    for i in sorted(range(len(rows)), key=lambda i: -len(rows[i])):
        if group and size + len(rows[i]) > GROUP:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(rows[i])
    if group:
        yield group


def expect(model: Model, rows: list[np.ndarray], counts: Counts) -> None:
    """Add the expected counts of texts. A text of over GROUP symbols goes by stretches: forward for what enters each,
    then backward with the forward part of a stretch made again, so that memory stays that of a stretch."""
    k = len(model.start)
    for group in ([rows[i] for i in chosen] for chosen in grouped(rows)):
        if len(group) > 1 or len(group[0]) <= GROUP:
            ids, begins, _ = packed(group)
            n = len(group)
            counts.add(model, ids, begins, np.broadcast_to(model.start, (n, k)), np.ones((n, k)), True)
            continue
        cuts = [group[0][s : s + GROUP] for s in range(0, len(group[0]), GROUP)]
        entering, last = [model.start[None]], []
        for cut in cuts:
            alpha, _ = forward(model, model.emit[cut], np.arange(len(cut) + 1), entering[-1])
            last.append(alpha[-1:].copy())
            entering.append(last[-1] @ model.move)
        leaving = np.ones((1, k))
        for s in reversed(range(len(cuts))):
            weighted = counts.add(model, cuts[s], np.arange(len(cuts[s]) + 1), entering[s], leaving, s == 0)
            if s:  # the move between two stretches
                counts.move += model.move * (last[s - 1].T @ weighted)
                leaving = weighted @ model.move.T


def log_likelihoods(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each text, exact by the scaled forward recursion."""
    out = np.zeros(len(rows))
    for chosen in grouped(rows):
        if len(chosen) == 1:
            row, entering = rows[chosen[0]], model.start[None]
            for s in range(0, len(row), GROUP):
                cut = row[s : s + GROUP]
                alpha, scale = forward(model, model.emit[cut], np.arange(len(cut) + 1), entering)
                out[chosen[0]] += np.log10(scale).sum()
                entering = alpha[-1:] @ model.move
            continue
        ids, begins, order = packed([rows[c] for c in chosen])
        _, scale = forward(model, model.emit[ids], begins, np.broadcast_to(model.start, (len(chosen), len(model.start))))
        text = np.arange(len(ids)) - np.repeat(begins[:-1], np.diff(begins))
        out[np.array(chosen)[order]] = np.bincount(text, np.log10(scale), len(chosen))
    return out


@dataclass(frozen=True)
class Vocabulary:
    """Of the training texts: all words N with the ends, distinct ones V, the broadcast words by falling count with their
    counts, texts, and for each class the words in it (without the frequent ones) and the weight of unknown words."""

    sizes: Sizes
    total: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    ends: int
    inside: np.ndarray
    unknown: np.ndarray

    @property
    def symbols(self) -> np.ndarray:
        """Symbol of each broadcast word."""
        own = np.arange(1, 1 + min(self.sizes.words, len(self.words)), dtype=np.int32)
        return np.concatenate([own, np.array([self.sizes.class_of(w) for w in self.words[self.sizes.words :]], np.int32)])

    def share(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of words' shares of their symbols: 0 for frequent words."""
        k = symbols - 1 - self.sizes.words
        inside = k >= 0
        k = np.where(inside, k, 0)
        return np.where(inside, np.log10(np.maximum(counts, 1e-300) / (self.inside[k] + self.unknown[k])), 0.0)


def least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` words reach; counts over 4096 are told apart by 1/256 of a power of two."""
    c = F.col("c")
    step = F.when(c <= 4096, c).otherwise(F.floor(F.log2(c.cast("double")) * 256) + 4096 - 12 * 256)
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()  # steps are a few thousand
    reached, least = 0, 2**62
    for r in sorted(rows, key=lambda r: -r.step):
        reached += r.n
        if reached > most:
            break
        least = r.c
    return least


def vocabulary(counts: DataFrame, ends: int, sizes: Sizes = Sizes()) -> Vocabulary:
    """counts (word, c) of the training texts, written; ends: their number."""
    frequent, classes = 1 + sizes.words, sizes.classes

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, classes))
        n = v = 0
        for batch in batches:
            c = batch.column(1).to_numpy()
            k = np.fromiter((sizes.class_of(w.as_py()) - frequent for w in batch.column(0)), np.int64, len(c))
            total[0] += np.bincount(k, c, classes)
            total[1] += np.bincount(k, c == 1, classes)
            n, v = n + int(c.sum()), v + len(c)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.concatenate([[n, v], total.ravel()]).tobytes()], pa.binary())], ["slot", "v"])

    flat = tree_sum(counts.select("word", "c").mapInArrow(by_class, "slot long, v binary"), counts.rdd.getNumPartitions())
    flat = np.zeros(2 + 2 * classes) if flat is None else flat
    short = counts.where(F.octet_length("word") <= sizes.longest)
    rows = short.where(F.col("c") >= least_count(short, sizes.broadcast)).toArrow()
    top = sorted(zip(rows["c"].to_pylist(), rows["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    inside, single = flat[2:].reshape(2, classes)
    for c, w in top[: sizes.words]:
        inside[sizes.class_of(w) - frequent] -= c
    unknown = 0.5 * single + 0.5 * (single.sum() + 1) / classes
    return Vocabulary(sizes, int(flat[0]) + ends, int(flat[1]) + (ends > 0), [w for _, w in top], np.array([c for c, _ in top], float), ends, inside, unknown)


def encoded(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """doc_id, held_out, ids (symbols as unsigned 16-bit numbers), n_tokens, n_known, base and inside (sums of log10 c + 1
    and of log10 shares of symbols) over words that are broadcast and the end, and misses, the other words with their
    numbers and classes; rid numbers the rows of the written table."""
    class_of = known.sizes.class_of
    sent = docs.sparkSession.sparkContext.broadcast((dict(zip(known.words, range(len(known.words)))), known.symbols.astype(np.uint16), np.log10(known.counts + 1), known.share(known.symbols, known.counts), known.ends))
    missed = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32()), ("symbol", pa.int32())]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, symbols, logs, shares, ends = sent.value
        get = table.get
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for text in batch.column(1):
                found = words(text.as_py())
                n = len(found)
                at = np.fromiter(map(get, found, (-1 for _ in found)), np.int32, n)
                ids = np.zeros(n + 1, np.uint16)
                ids[:n] = symbols[at] if len(symbols) else 0
                missing = np.flatnonzero(at < 0)
                others: dict[bytes, list[int]] = {}
                for i in missing.tolist():
                    w = found[i]
                    if w in others:
                        others[w][0] += 1
                    else:
                        others[w] = [1, class_of(w)]
                    ids[i] = others[w][1]
                hit = at[at >= 0]
                for c, v in zip(columns, (ids.tobytes(), n + 1, len(hit) + (ends > 0), float(logs[hit].sum()) + math.log10(ends + 1), float(shares[hit].sum()), [{"word": w, "n": m, "symbol": k} for w, (m, k) in others.items()])):
                    c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), missed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["doc_id", "ids", "n_tokens", "n_known", "base", "inside", "misses"])

    schema = "doc_id long, ids binary, n_tokens long, n_known long, base double, inside double, misses array<struct<word:binary,n:int,symbol:int>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)
    return materialise(rows.withColumns({"held_out": held_out(), "rid": F.monotonically_increasing_id()}))


def model_of(counts: Counts, known: Vocabulary) -> Model:
    """The model that expected counts give: symbols' counts with the weight that unknown words add to classes, drawn to
    all states' shares by PRIOR words; moves and starts by EVEN for each state."""
    k = len(counts.start)
    emit = counts.emit.copy()
    words = emit.sum(axis=0)
    states = words / words.sum() if words.sum() > 0 else np.full(k, 1 / k)
    rare = slice(1 + known.sizes.words, None)
    emit[rare] += known.unknown[:, None] * (emit[rare] + states) / (known.inside[:, None] + 1)
    emit[END] += 1e-3 * states
    share = emit.sum(axis=1) / emit.sum()
    emit += PRIOR * share[:, None] + 1e-300
    move, start = counts.move + EVEN, counts.start + EVEN
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def unigrams(known: Vocabulary) -> np.ndarray:
    """Counts of the symbols."""
    own = np.zeros(known.sizes.words)
    own[: len(known.counts)] = known.counts[: len(own)]
    return np.concatenate([[known.ends], own, known.inside])


def started(rows: list[np.ndarray], known: Vocabulary, seed: int = 7, rounds: int = START_ROUNDS) -> Model:
    """A model to start from: unigrams with seeded noise, fitted to a few texts."""
    rng, states = np.random.default_rng(seed), known.sizes.states
    noise = np.exp(rng.normal(size=(known.sizes.symbols, states)))
    emit = unigrams(known)[:, None] * noise / noise.sum(axis=1, keepdims=True)
    n = max(known.total, 1)
    model = model_of(Counts(np.full(states, 1.0), (np.eye(states) * 0.9 + 0.1 / states) * n / states, emit), known)
    for _ in range(rounds if rows else 0):
        counts = Counts.none(*model.emit.shape)
        expect(model, rows, counts)
        model = model_of(counts, known)
    return model


def numbers(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16).astype(np.int32) for x in batch.column(column)]


def trained(rows: DataFrame, known: Vocabulary, passes: int = PASSES) -> tuple[Model, list[float]]:
    """Baum-Welch over all rows (ids) that aren't held out, with the log10 likelihood before each pass.

    The start is fitted to START_TEXTS texts of at most START_WORDS words, picked by a hash; what the model keeps is
    counted over all training texts in every pass."""
    learned = rows.where("not held_out")
    few = learned.where(F.col("n_tokens") <= START_WORDS).select(F.xxhash64("doc_id", "ids").alias("h"), "rid", "ids").orderBy("h", "rid").limit(START_TEXTS)
    model = started([np.frombuffer(r.ids, np.uint16).astype(np.int32) for r in few.collect()], known)
    logs, tasks = [], learned.rdd.getNumPartitions()
    symbols, states = model.emit.shape
    for _ in range(passes):
        sent = rows.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            counts = Counts.none(symbols, states)
            for batch in batches:
                expect(sent.value, numbers(batch, "ids"), counts)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([counts.flat().tobytes()], pa.binary())], ["slot", "v"])

        flat = tree_sum(learned.select("ids").mapInArrow(count, "slot long, v binary"), tasks, 16)
        sent.destroy()
        if flat is None or not flat[1 : 1 + states].sum():
            break
        counts = Counts.of(flat, symbols, states)
        logs.append(counts.log)
        model = model_of(counts, known)
    return model, logs


def score(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text).

    A null text is an empty one, whose only token is the end. Rows without doc_id are learned from. Repeated rows count
    and score as often as they stand. Without training rows all words are unknown and base scores are 0. An empty table
    gives no rows; other columns aren't read.
    """
    whole = texts(docs)
    learned = whole.where(~held_out())
    counts = materialise(word_counts(learned))
    known = vocabulary(counts, learned.count(), sizes)
    rows = encoded(whole, known)
    model, _ = trained(rows, known)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).drop_columns("ids")
            yield from table.append_column("log", pa.array(log_likelihoods(sent.value, numbers(batch, "ids")), pa.float64())).to_batches()

    scored = rows.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "ids").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, log double")
    classes = spark.createDataFrame([(k + 1 + sizes.words, math.log10(u), math.log10(c + u)) for k, (c, u) in enumerate(zip(known.inside.tolist(), known.unknown.tolist()))], "symbol int, unknown double, whole double")
    missed = rows.select("rid", F.explode("misses").alias("m")).select("rid", "m.word", "m.n", "m.symbol").join(counts, "word", "left").join(F.broadcast(classes), "symbol")  # a row for each class
    c = F.col("c").cast("double")
    sums = missed.groupBy("rid").agg(
        F.sum(F.when(c.isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10(F.coalesce(c, F.lit(0.0)) + 1)).alias("more_base"),
        F.sum(F.col("n") * (F.coalesce(F.log10(c), F.col("unknown")) - F.col("whole"))).alias("more_inside"),
    )
    all_ = scored.join(sums, "rid", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return all_.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).cast("long").alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") - F.col("n_tokens") * math.log10(known.total + known.distinct + 1)).alias("base_score"),
        (F.col("log") + F.col("inside") + zero("more_inside")).alias("score"),
    )
