"""Packing token sequences by column generation for the cutting-stock problem.

A document's whole multiples of the capacity fill sequences of their own. What remains of it, its tail, is an item of a
length histogram. A linear program chooses how often to use each pattern of tails that fills a sequence exactly, or to
cut tails, which costs their share of a sequence and a little more; its patterns are priced by a knapsack dynamic
program, and rounded down. Tails of a length are ranked over all documents, and the rank says which pattern's slot
a tail takes. Tails beyond the patterns run on, one after another, and are cut where a sequence is full; the last
sequence is made of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import materialise, offsets

CAPACITY = 2048
END = 1
#: Pricing rounds of the linear program, whatever the sizes; a plan says how far from the optimum it stopped.
ROUNDS = 100
#: Columns that a pricing round may bring in, and how far products with the basis may be off before it is inverted anew.
COLUMNS, DRIFT = 40, 1e-8
#: Sizes that fill patterns among themselves at first.
GROUP = 24
#: Distance to a proven bound, as a share of the cost, at which the linear program counts as solved.
SOLVED = 1e-6
#: Shares of the greatest demand by which demands are moved apart, so that steps of the program aren't empty.
APART = 1e-5
#: What a cut costs beside the tokens, in sequences.
CUT_COST = 1e-3
#: Tails without a pattern, by which the lookup of their ids is broadcast: 16 bytes each, 4 MB at most.
FEW_TAILS = 200_000
CACHE_ENTRIES = 300_000

_encoders: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Ids as Tokenizer.from_file(json_file).encode(text, add_special_tokens=False) gives them.

    Merges stay inside the pattern's matches, and a match never runs on over a single space or line feed between other
    characters, but for taking the space as its first. So a word with the space before it, or with the line feed
    before it, has the same ids in every text, and is kept with them. Words that aren't kept go to the library in one
    string for many texts, whose ids the words' lengths part again. Texts with other white space or special strings
    are encoded whole. rank_file has the same vocabulary for a faster library.
    """

    def __init__(self, json_file: str, rank_file: str):
        import base64
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(json_file, encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding(name=rank_file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        if max(max(ranks.values()), *special.values()) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        #: What sends a text whole to the library: special strings, and white space other than spaces and line feeds.
        self.odd = [x.encode() for x in special] + [bytes([c]) for c in (0, 9, 11, 12, 13, 28, 29, 30, 31)] + [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]
        self.kept: dict[bytes, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of texts, taken by pieces of a million bytes or a single text."""
        out, piece, size = [], [], 0
        for t in texts:
            piece.append((t or "").encode())
            size += len(piece[-1])
            if size > 1_000_000:
                out += self._encode(piece)
                piece, size = [], 0
        return out + self._encode(piece)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), allowed_special="all"), "<u2")

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        joined = b"".join(texts)
        odd = [x for x in self.odd if x in joined]
        regular = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, "<u2")
            elif t[0] in b" \n" or t[-1] in b" \n" or b"  " in t or b" \n" in t or b"\n " in t or b"\n\n" in t or any(x in t for x in odd):
                out[i] = self._whole(t)
            else:
                regular.append(i)
        if regular:
            for i, ids in zip(regular, self._by_words(b"\0" + b"\0".join([texts[i] for i in regular]))):
                out[i] = ids
        return out

    def _by_words(self, text: bytes) -> list[np.ndarray]:
        """Ids of the texts that follow the zero bytes. A word starts with the byte before it: zero for a text's first."""
        b = np.frombuffer(text + bytes(16), np.uint8)
        start = np.flatnonzero((b[: len(text)] == 32) | (b[: len(text)] == 10) | (b[: len(text)] == 0))
        size = np.diff(start, append=len(text))
        # words of at most 16 bytes are two integers; equal ones are found by a mixture of both, and then compared
        inside = np.arange(16) < size[:, None]
        two = np.where(inside, b[start[:, None] + np.arange(16)], 0).astype(np.uint8).view("<u8")
        mixed = two[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (two[:, 1] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        code, distinct = pd.factorize(mixed)
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        same = (size <= 16) & (size == size[first[code]]) & (two == two[first[code]]).all(axis=1)
        words = [text[s : s + n] for s, n in zip(start[first].tolist(), size[first].tolist())]
        if not same.all():
            others: dict[bytes, int] = {}
            for k in np.flatnonzero(~same).tolist():
                w = text[start[k] : start[k] + size[k]]
                code[k] = others.setdefault(w, len(words) + len(others))
            words += others
        found = list(map(self.kept.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            for i, x in zip(missing, self._new([words[i] for i in missing])):
                found[i] = x
        ids = np.frombuffer(b"".join(found), "<u2")
        n = np.array([len(x) // 2 for x in found], np.int64)
        at = np.concatenate(([0], np.cumsum(n)))[:-1]
        count = n[code]
        ends = np.cumsum(count)
        all_ = ids[np.repeat(at[code] - ends + count, count) + np.arange(ends[-1])]
        cuts = np.concatenate(([0], ends))[np.flatnonzero(b[start] == 0)[1:]]
        return np.split(all_, cuts)

    def _new(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that aren't kept, by one call: a text's first stands behind a line feed, which then goes."""
        parts = [w if w[0] else b"\n" + w[1:] for w in words]
        ids = np.array(self.library.encode_ordinary(b"".join(parts).decode()), "<u2")
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(x) for x in parts]), "left") + 1
        raw, found, at = ids.tobytes(), [], 0
        for w, end in zip(words, (2 * ends).tolist()):
            found.append(raw[at if w[0] else at + 2 : end])
            at = end
        if len(self.kept) > CACHE_ENTRIES:
            self.kept.clear()
        self.kept.update((w, x) for w, x in zip(words, found) if len(w) <= 64)
        return found


def encoder(json_file: str, rank_file: str) -> Encoder:
    """One for each Python worker, kept between tasks."""
    key = (json_file, rank_file)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@dataclass
class Plan:
    """Patterns: arrays of sizes (ascending, repeated, capacity in sum) with how often each is used. cost is the linear
    program's, bound what no solution of it is below, and rounds the pricing rounds it took."""

    patterns: list[np.ndarray] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    cost: float = 0.0
    bound: float = 0.0
    rounds: int = 0

    def use(self, sizes: np.ndarray, times: int) -> None:
        if times > 0:
            self.patterns.append(np.sort(sizes))
            self.times.append(int(times))


class Knapsack:
    """Counts, at most `most` of each size, of the greatest value for every capacity that they fill exactly.

    A dynamic program over capacities; a size's count is made of items of 1, 2, 4 ... and the rest. best has the value
    of each capacity, -inf where none fills it.
    """

    def __init__(self, sizes: np.ndarray, most: np.ndarray, value: np.ndarray, capacity: int):
        self.kinds = len(sizes)
        self.best = np.full(capacity + 1, -np.inf)
        self.best[0] = 0
        self.items: list[tuple[int, int, int, np.ndarray]] = []
        for i in np.flatnonzero(most > 0):
            left, k = int(min(most[i], capacity // sizes[i])), 1
            while left > 0:
                k = min(k, left)
                w = int(sizes[i]) * k
                if w > capacity:
                    break
                new = self.best[:-w] + value[i] * k
                better = new > self.best[w:] + 1e-12
                np.copyto(self.best[w:], new, where=better)
                self.items.append((i, k, w, better))
                left -= k
                k *= 2

    def fillings(self, capacities: np.ndarray) -> np.ndarray:
        """The counts of all sizes, a row for each capacity, which must have a finite best."""
        counts = np.zeros((len(capacities), self.kinds), np.int16)
        at = capacities.copy()
        for i, k, w, better in reversed(self.items):
            taken = (at >= w) & better[np.minimum(np.maximum(at - w, 0), len(better) - 1)]
            counts[taken, i] += k
            at[taken] -= w
        return counts


def patterns_of(sizes: np.ndarray, most: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of the most valuable pattern first, then, for each size, of one with it and the best filling of the rest.
    The first keeps to `most`; others may exceed it by the one that they begin with. No rows if nothing fills."""
    knapsack = Knapsack(sizes, most, value, capacity)
    if not np.isfinite(knapsack.best[capacity]):
        return np.zeros((0, len(sizes)), np.int16)
    begins = np.flatnonzero((most > 0) & np.isfinite(knapsack.best[capacity - sizes]))[::-1]
    counts = knapsack.fillings(np.concatenate(([capacity], capacity - sizes[begins])))
    counts[np.arange(1, len(counts)), begins] += 1
    return counts


def best_pattern(sizes: np.ndarray, most: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The counts, at most `most` of each size, that fill the capacity exactly at the greatest value (-inf: none do)."""
    found = patterns_of(sizes, most, value, capacity)
    return (float(found[0] @ value), found[0]) if len(found) else (-np.inf, np.zeros(len(sizes), np.int16))


def fill(sizes: np.ndarray, left: np.ndarray, capacity: int, whole: bool) -> list[tuple[np.ndarray, float, int]]:
    """(counts, times, a size that they use up) of patterns, large sizes first, until none can be filled; takes them
    from left. whole: times are whole numbers, and what is used up may leave fewer than a pattern takes.

    Pairs come first, which need no program. Groups of GROUP sizes spread over all of them are then filled apart, as
    their programs are small, and regrouped until all that is left has been one group.
    """
    out = []

    def take(counts: np.ndarray) -> bool:
        some = np.flatnonzero(counts)
        ratio = left[some] // counts[some] if whole else left[some] / counts[some]
        times = ratio.min()
        if times <= 1e-9:
            return False
        left[some] -= counts[some] * times
        gone = int(some[ratio.argmin()])
        if not whole:
            left[gone] = 0
            left[left < 1e-9] = 0
        out.append((counts, times, gone))
        return True

    at = {int(s): i for i, s in enumerate(sizes)}
    for s, i in at.items():
        j = at.get(capacity - s, -1)
        if j >= i:
            counts = np.zeros(len(sizes), np.int16)
            counts[i] += 1
            counts[j] += 1
            take(counts)
    order, progress = np.random.default_rng(1), True
    while True:
        open_ = order.permutation(np.flatnonzero(left > 1e-9))
        groups = max(1, len(open_) // GROUP) if progress else 1
        before = len(out)
        for g in range(groups):
            own = np.sort(open_[g::groups])
            while len(found := patterns_of(sizes[own], np.ceil(left[own] - 1e-9).astype(np.int64), sizes[own] * (1 + sizes[own] / capacity), capacity)):
                for counts in found:
                    spread = np.zeros(len(sizes), np.int16)
                    spread[own] = counts
                    take(spread)
                own = own[left[own] > 1e-9]
        if groups == 1:
            return out
        progress = len(out) > before


def cutting_stock(demand: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Patterns for a demand (size: count) by column generation; their uses never exceed the demand.

    The linear program covers the demand by patterns, at one sequence each, and by cuts of single tails, at their share
    of a sequence and CUT_COST. The first basis comes from filling patterns, each of which uses up a size: in the order
    of their sizes' ends they make a triangle. A round then prices patterns for all sizes by the duals in one dynamic
    program, and brings in those that still pay. No solution costs less than the total size over the capacity, nor than
    the duals' value over the most that a column is worth by them; at that bound, or when no column pays, it is solved.
    cost and bound are of demands that are moved apart by APART. Uses are rounded down, and patterns then fill up what that leaves until none can be filled.
    """
    plan = Plan()
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    m = len(sizes)
    if not m:
        return plan
    whole = np.array([demand[int(s)] for s in sizes], np.int64)
    d = whole + APART * whole.max() * np.random.default_rng(2).random(m)
    cut = sizes / capacity + CUT_COST
    basis, cost, x = np.eye(m), cut.copy(), d.copy()
    columns: list[np.ndarray | None] = [None] * m
    for counts, times, gone in fill(sizes, x, capacity, whole=False):
        basis[:, gone], cost[gone], columns[gone] = counts, 1.0, counts
    inverse = np.linalg.inv(basis)
    x = inverse @ d
    if x.min() < -1e-6 * d.max():  # not in a triangle that doubles can hold: start from cuts
        basis, inverse, x, cost, columns = np.eye(m), np.eye(m), d.copy(), cut.copy(), [None] * m
    plan.bound = float(sizes @ d) / capacity

    def enter(entering: np.ndarray, prices: np.ndarray, counts: list[np.ndarray | None]) -> None:
        """Bring columns into the basis one after another, where they still pay; the inverse then takes all at once."""
        first = inverse @ entering
        ways, into = first.copy(), {}
        for k in range(len(prices)):
            way = ways[:, k].copy()
            ok = way > 1e-9
            if cost @ way <= prices[k] + 1e-9 or not ok.any():
                continue
            ratio = np.full(m, np.inf)
            ratio[ok] = np.maximum(x[ok], 0) / way[ok]
            least = ratio.min()
            leave = int(np.argmax(np.where(ratio <= least + 1e-12, way, -1)))
            x[:] -= least * way
            x[leave] = least
            row = ways[leave] / way[leave]
            ways[:] -= np.outer(way, row)
            ways[leave] = row
            basis[:, leave], columns[leave], cost[leave], into[leave] = entering[:, k], counts[k], prices[k], k
        if into:
            places, which = np.array(list(into)), np.array(list(into.values()))
            change = first[:, which]
            rows = np.linalg.solve(change[places], inverse[places])
            change[places, np.arange(len(places))] -= 1
            inverse[:] -= change @ rows

    while plan.rounds < rounds:
        plan.rounds += 1
        duals = cost @ inverse
        if np.abs(duals @ basis - cost).max() > DRIFT or np.abs(basis @ x - d).max() > DRIFT * d.max():
            inverse[:] = np.linalg.inv(basis)
            x[:] = inverse @ d
            duals = cost @ inverse
        found = patterns_of(sizes, whole, duals, capacity)
        worth = found @ duals
        most = max(1.0, float(worth.max(initial=0)), float((duals / cut).max()))
        plan.cost, plan.bound = float(cost @ x), max(plan.bound, float(duals @ d) / most)
        if plan.cost - plan.bound <= SOLVED * plan.cost:
            break
        pays = np.flatnonzero((worth > 1 + 1e-9) & (found <= whole).all(axis=1))
        over = np.flatnonzero(duals > cut + 1e-9)
        if not len(pays) and not len(over):
            break
        over = over[np.argsort(cut[over] - duals[over])][:COLUMNS]
        distinct = {found[i].tobytes(): i for i in pays[::-1]}
        pays = np.array(sorted(distinct.values(), key=lambda i: -worth[i])[:COLUMNS], np.int64)
        entering = np.zeros((m, len(over) + len(pays)))
        entering[over, np.arange(len(over))] = 1
        entering[:, len(over) :] = found[pays].T
        # copies, as a row would hold on to all of its round
        enter(entering, np.concatenate([cut[over], np.ones(len(pays))]), [None] * len(over) + [found[i].copy() for i in pays])
    plan.cost = float(cost @ x)
    left = whole.copy()
    for column, n in zip(columns, x):
        if column is not None:
            used = min(int(np.floor(n + 1e-3)), int((left[column > 0] // column[column > 0]).min()))
            plan.use(np.repeat(sizes, column), used)
            left -= column * max(used, 0)
    for counts, times, _ in fill(sizes, left, capacity, whole=True):
        plan.use(np.repeat(sizes, counts), int(times))
    return plan


@dataclass
class Slots:
    """For each size, the ranks up to which its patterns go, and where they put a rank."""

    used: dict[int, int]
    ends: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    at: dict[int, np.ndarray]
    sequences: int

    @staticmethod
    def of(plan: Plan) -> Slots:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        base = 0
        for sizes, times in zip(plan.patterns, plan.times):
            at = 0
            for s, n in zip(*np.unique(sizes, return_counts=True)):
                rows.setdefault(int(s), []).append((int(n) * times, int(n), base, at))
                at += int(s) * int(n)
            base += times
        column = lambda k: {s: np.array([r[k] for r in x], np.int64) for s, x in rows.items()}
        ends = {s: np.cumsum(v) for s, v in column(0).items()}
        return Slots({s: int(e[-1]) for s, e in ends.items()}, ends, column(1), column(2), column(3), base)

    def place(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the tails of a size with these ranks; -1 for those that no pattern takes."""
        sequence = np.full(len(ranks), -1, np.int64)
        offset = np.zeros(len(ranks), np.int64)
        if size in self.ends:
            ends = self.ends[size]
            inside = ranks < ends[-1]
            which = np.searchsorted(ends, ranks[inside], "right")
            k = ranks[inside] - np.concatenate(([0], ends[:-1]))[which]
            each = self.each[size][which]
            sequence[inside] = self.first[size][which] + k // each
            offset[inside] = self.at[size][which] + k % each * size
        return sequence, offset


def cut_points(total: int, capacity: int) -> tuple[int, np.ndarray]:
    """Whole sequences of a run of so many tokens, and the ends of those that follow: powers of two, largest first."""
    whole, rest = divmod(total, capacity)
    powers = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    return whole, whole * capacity + np.cumsum([0, *powers]).astype(np.int64)


def encoded(docs: DataFrame, json_file: str, rank_file: str, capacity: int) -> DataFrame:
    """Rows (rid, part, doc_id, doc_tokens, whole, tail, tail_crc, tail_ids): whole has the checksums of the document's
    full sequences, and tail_ids the tail's ids, two bytes each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids_of = encoder(json_file, rank_file).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for ids in ids_of(batch.column(1).slice(at, 1000).to_pylist()):
                    ids = np.append(ids, np.array([END], "<u2"))
                    cut = len(ids) // capacity * capacity
                    rows.append(((part << 33) + n, len(ids), [crc(ids[i : i + capacity]) for i in range(0, cut, capacity)], len(ids) - cut, crc(ids[cut:]), ids[cut:].tobytes()))
                    n += 1
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array([part] * len(rows), pa.int32()), batch.column(0).slice(at, 1000), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.int64())), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.binary())], ["rid", "part", "doc_id", "doc_tokens", "whole", "tail", "tail_crc", "tail_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "rid long, part int, doc_id long, doc_tokens long, whole array<long>, tail int, tail_crc long, tail_ids binary")


def pack(docs: DataFrame, json_file: str, rank_file: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Null and empty texts are the end id alone. Rows without doc_id and repeated rows are packed as rows of their own.
    An empty table has no pieces. Columns beside doc_id and text aren't read.
    """
    spark = docs.sparkSession
    units = materialise(encoded(docs, json_file, rank_file, capacity))
    demand = {r["tail"]: r["n"] for r in units.where("tail > 0").groupBy("tail").agg(F.count("*").alias("n")).collect()}  # capacity - 1 rows at most
    slots = Slots.of(cutting_stock(demand, capacity))
    known = spark.sparkContext.broadcast(slots)
    counts = offsets(units.groupBy("tail", "part").agg(F.count("*").alias("n")), "part", "n", by="tail")
    wholes = offsets(units.groupBy("part").agg(F.sum(F.size("whole")).alias("full")), "part", "full")
    order = Window.partitionBy("tail", "part").orderBy("rid")
    ranked = units.select("rid", "part", "doc_id", "doc_tokens", "tail", "tail_crc").withColumn("own", F.row_number().over(order) - 1)
    ranked = ranked.join(counts.select("tail", "part", "n_before"), ["tail", "part"]).withColumn("rank", F.col("own") + F.col("n_before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.full(len(b), -1, np.int64), np.zeros(len(b), np.int64)
            tails, ranks = b["tail"].to_numpy(), b["rank"].to_numpy()
            for s in np.unique(tails):
                own = tails == s
                sequence[own], offset[own] = known.value.place(int(s), ranks[own])
            yield b.assign(sequence_id=sequence, offset=offset).drop(columns="rank")

    placed = ranked.where("tail > 0").select("rid", "part", "doc_id", "doc_tokens", "tail", "tail_crc", "rank").mapInPandas(place, "rid long, part int, doc_id long, doc_tokens long, tail int, tail_crc long, sequence_id long, offset long")
    placed = materialise(placed)
    by_pattern = placed.where("sequence_id >= 0").select("doc_id", (F.col("doc_tokens") - F.col("tail")).alias("start"), F.col("tail").cast("long").alias("length"), F.col("tail_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    # the tails that no pattern takes run on
    few = {s: n - slots.used.get(s, 0) for s, n in demand.items()}
    total = sum(s * n for s, n in few.items())
    full, ends = cut_points(total, capacity)
    runs = placed.where("sequence_id < 0").select("rid", "part", "doc_id", "doc_tokens", "tail")
    before = offsets(runs.groupBy("part").agg(F.sum("tail").alias("run")), "part", "run")
    line = Window.partitionBy("part").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.join(before.select("part", "run_before"), "part").select("rid", "doc_id", "doc_tokens", (F.col("run_before") + F.coalesce(F.sum("tail").over(line), F.lit(0))).alias("at"))
    runs = F.broadcast(runs) if sum(few.values()) <= FEW_TAILS else runs
    runs = units.select("rid", "tail_ids").join(runs, "rid").select("doc_id", "doc_tokens", "at", "tail_ids")
    base = slots.sequences

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tokens, at, packed in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(packed, "<u2")
                done = 0
                while done < len(ids):
                    here = at + done
                    if here < full * capacity:
                        sequence, first = divmod(here, capacity)
                        first, end = here - first, (sequence + 1) * capacity
                    else:
                        k = int(np.searchsorted(ends, here, "right"))
                        sequence, first, end = full + k - 1, int(ends[k - 1]), int(ends[k])
                    n = min(len(ids) - done, end - here)
                    rows.append((doc, tokens - len(ids) + done, n, crc(ids[done : done + n]), tokens, base + sequence, here - first))
                    done += n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    by_cut = runs.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    base_full = base + full + len(ends) - 1
    earlier = F.coalesce(F.sum(F.size("whole")).over(line), F.lit(0))
    own = units.where(F.size("whole") > 0).join(wholes.select("part", "full_before"), "part").withColumn("first", F.col("full_before") + earlier + base_full)
    own = own.select("doc_id", "doc_tokens", "first", F.posexplode("whole").alias("k", "ids_crc32"))
    by_whole = own.select("doc_id", (F.col("k") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return by_pattern.unionByName(by_cut).unionByName(by_whole)
