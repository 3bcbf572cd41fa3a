"""Token counts of whole texts by a two-tier lookup of pre-token lengths on the map side.

A piece model without pieces that cross a word start merges only inside a pre-token (a run of spaces with the word
that follows it; a line feed is no piece and cuts as well). So the count of a text is the sum of its pre-tokens'
counts, and pre-tokens repeat. Tier one is a table of frequent pre-tokens and their lengths, broadcast to the workers;
tier two is a cache in each worker for the pre-tokens it meets beyond that, which the library encodes once. No
pre-token is shuffled: the table comes from a bounded sample of documents, those with the least hashes of their ids.
It only saves time; counts cover all texts and don't depend on it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens over this length are encoded each time, so that the bounded cache isn't filled by a few.
LONGEST_CACHED = 64
#: Entries that a worker's cache may hold beside the table; a full one starts again.
CACHE_ENTRIES = 300_000
#: Entries of the broadcast table: with 12 bytes or so each, 2 MB at most.
TABLE_ENTRIES = 131_072
#: Documents that the table is made from, and bytes of the longest that may be one: 32 MB in all at most.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 2048, 16_384

_workers: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts the pieces of texts as SentencePieceProcessor.encode gives them.

    A pre-token is kept as a string: a word that one space precedes as the word alone, any other (more spaces before
    it, or none at a line's start) after a line feed. The split is exact only for models where spaces are escaped, one
    dummy space goes first, nothing else is normalised, no piece has a word start inside, and line feeds are no
    pieces; for others (exact is False) whole texts are encoded.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "a  b\n cÄﬁ\t"
        self.exact = not any(re.search("[^▁]▁|\n", p) for p in pieces) and self.model.normalize(probe) == "▁" + probe.replace(" ", "▁")
        self.table: dict[str, int] = {}
        self.lengths: dict[str, int] = {}

    def load(self, table: tuple[str, bytes]) -> None:
        """table: the frequent pre-tokens, U+0000 between them, and their lengths."""
        if len(self.table) != len(table[1]) or not self.lengths:
            self.table = dict(zip(table[0].split("\0"), table[1]))
            self.lengths = dict(self.table)

    def encode(self, tokens: list[str]) -> list[int]:
        """Lengths of pre-tokens. The model puts a space in front of what it gets; a line feed between that and the
        pre-token keeps them apart, and both are one piece each."""
        return [len(x) - 2 for x in self.model.encode([t if t[:1] == "\n" else "\n " + t for t in tokens], num_threads=1)]

    @staticmethod
    def split(text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of line feeds between them, each one byte piece."""
        if "▁" in text:
            text = text.replace("▁", " ")
        lines = (" " + text).split("\n")
        tokens: list[str] = []
        for line in lines:
            words = line.split(" ")
            first = words[0]
            if "" in words[1:]:  # spaces in a row, or at the end
                tokens += ["\n" + t for t in re.findall(" +[^ ]*|[^ ]+", line)]
                continue
            if first:
                words[0] = "\n" + first
            else:
                del words[0]
            tokens += words
        return tokens, len(lines) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        """Counts of texts, which go through the lookup by pieces of a million characters or a single text; a call of
        the library costs much beside a short text, so the missing pre-tokens of a piece go together."""
        if not self.exact:
            return [len(x) for x in self.model.encode([t or "" for t in texts], num_threads=1)]
        out, piece, size = [], [], 0
        for t in texts:
            piece.append(t)
            size += len(t or "")
            if size > 1_000_000:
                out += self._count(piece)
                piece, size = [], 0
        return out + self._count(piece)

    def _count(self, texts: list[str | None]) -> list[int]:
        totals, missing = [], {}
        for i, text in enumerate(texts):
            if not text:
                totals.append(0)
                continue
            tokens, total = self.split(text)
            found = list(map(self.lengths.get, tokens))
            if None in found:
                missing[i] = [t for t, n in zip(tokens, found) if n is None]
            totals.append(total + sum(filter(None, found)))
        if missing:
            new = list(dict.fromkeys(t for x in missing.values() for t in x))
            new = dict(zip(new, self.encode(new)))
            for i, x in missing.items():
                totals[i] += sum(map(new.__getitem__, x))
            if len(self.lengths) > len(self.table) + CACHE_ENTRIES:
                self.lengths = dict(self.table)
            self.lengths.update((t, n) for t, n in new.items() if len(t) <= LONGEST_CACHED)
        return totals


def worker(model_file: str) -> PieceCounter:
    """One counter for each Python worker, kept between tasks."""
    if model_file not in _workers:
        _workers[model_file] = PieceCounter(model_file)
    return _workers[model_file]


def frequent_pretokens(docs: DataFrame, model_file: str, entries: int = TABLE_ENTRIES, documents: int = SAMPLE_DOCUMENTS) -> tuple[str, bytes]:
    """The table of tier one, from a sample of documents: pre-tokens that it holds twice or more, most frequent first."""
    n = docs.count()
    if not n:
        return "", b""
    h = F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1))
    some = docs.where((h <= int(min(1.0, 2 * documents / n) * 2**63) - 1) & (F.octet_length("text") <= SAMPLE_BYTES))
    seen: Counter = Counter()
    for r in some.orderBy(h, "doc_id", F.xxhash64("text")).limit(documents).select("text").collect():
        seen.update(PieceCounter.split(r.text)[0] if r.text else [])
    top = [t for t, k in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if k > 1 and len(t) <= LONGEST_CACHED and "\0" not in t][:entries]
    counter = worker(model_file)
    lengths = counter.encode(top) if counter.exact else []
    kept = [(t, k) for t, k in zip(top, lengths) if k < 256]
    return "\0".join(t for t, _ in kept), bytes(k for _, k in kept)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs (doc_id, text; others aren't read).

    doc_id comes out as a long. Null and empty texts have no bytes and no tokens; a null doc_id stays null; repeated rows give repeated rows; an
    empty table gives an empty one. model_file must be found at the same path on every executor, as it is when the
    package of vocabularies is installed there.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, model_file))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker(model_file)
        counter.load(table.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
