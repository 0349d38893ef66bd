"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Token lengths are whole numbers up to the sequence length, so documents of one length are interchangeable, and the
decisions of best-fit decreasing depend on the number of documents of each length alone. The corpus is therefore counted
by length (at most 4096 rows, whatever its size), best-fit decreasing runs over these counts with a segment tree over the
remaining capacities, and its plan says for each length which ranks go to which sequences. Spark ranks the pieces within
each length, salted so that a length that a third of all pieces have is spread, and looks each rank up in the plan. The
number of sequences is exactly that of best-fit decreasing over the whole corpus in one process.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.common import fresh, stored, with_field

SEQUENCE = 4096
END = 1
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Fixed by the vocabulary file: its pre-tokens (and the blank between chunks), and the characters that stand for bytes in its tokens.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ")
PLAIN = r"^[\x21-\x7e\x{a1}-\x{24f}]*$"
#: Blanks other than the space at which texts are split.
BLANKS = "\n\t\r"
#: About how many bytes of text are tokenised at once.
SLICE_BYTES = 1 << 23


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as the letters from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


class ChunkTokenizer:
    """Ids of texts. The vocabulary drops white space and no token crosses it, so the ids of a text are those of its chunks
    between blanks, and those of a chunk are those of its pre-tokens. The chunks of many texts are dictionary-encoded, the
    distinct ones cut into pre-tokens, whose ids come from a bounded cache, and all ids are taken by code. Chunks with other
    than Latin letters, odd blanks or special tokens go through the whole tokenizer."""

    def __init__(self, path: str, cached: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.letters = Tokenizer.from_file(path), cached, _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.ends = {" ": 0}, array("I"), array("q", [0, 0])  # the blank is a word of no ids

    def _learn(self, words: set[str]) -> None:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for word in words:
            self.words[word] = len(self.words)
            self.flat.extend([t.id for t in tokenize("".join(map(letters.__getitem__, word.encode())))])
            self.ends.append(len(self.flat))

    def _plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain chunks in one array, and how many each has."""
        found = PRE_TOKENS.findall(" ".join(chunks).lower())
        if new := set(found) - self.words.keys():
            if len(self.words) + len(new) > self.cached:
                self._forget()
                new = set(found) - {" "}
            self._learn(new)
        codes = np.fromiter(map(self.words.__getitem__, found), dtype=np.int64, count=len(found))
        ids = pa.LargeListArray.from_arrays(np.array(self.ends), np.array(self.flat, dtype="<u4")).take(pa.array(codes)).flatten().to_numpy()
        upto = np.cumsum(np.diff(np.array(self.ends))[codes])
        ends = np.append(upto[codes == 0], len(ids)) if chunks else np.zeros(0, dtype=np.int64)
        return ids, np.diff(ends, prepend=0)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) in one array, and where each text begins in it (one place more than there are texts)."""
        for blank in BLANKS:
            texts = pc.replace_substring(texts, blank, " ")
        split = pc.split_pattern(texts, " ")
        chunks = split.flatten().dictionary_encode()
        plain = pc.and_not(pc.match_substring_regex(chunks.dictionary, PLAIN), pc.match_substring(chunks.dictionary, "<|"))
        odd = [np.asarray(self.tokenizer.encode(c, add_special_tokens=False).ids, dtype="<u4") for c in chunks.dictionary.filter(pc.invert(plain)).to_pylist()]
        ids, sizes = self._plain(chunks.dictionary.filter(plain).to_pylist())
        sizes = np.concatenate([sizes, np.fromiter(map(len, odd), dtype=np.int64, count=len(odd))])
        is_plain = plain.to_numpy(zero_copy_only=False)
        place = np.where(is_plain, np.cumsum(is_plain), np.cumsum(~is_plain) + is_plain.sum()) - 1
        codes = place[chunks.indices.to_numpy()]
        held = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([ids, *odd]))
        before = np.concatenate([[0], np.cumsum(sizes[codes])])
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        return held.take(pa.array(codes)).flatten().to_numpy(), before[ends]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def _tokenizer(path: str) -> ChunkTokenizer:
    """One for each worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch (doc_id, text) in runs of rows with about SLICE_BYTES of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    run = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def token_pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, end each with END, and cut those over `sequence` tokens into pieces of that many (the last
    may be shorter). doc_id, piece, start, length, ids_crc32; with_ids adds the ids themselves as array<int>.

    Null and empty texts give the one token END. Repeated rows give pieces each. Other columns are not carried."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in (part for whole in batches for part in _slices(whole)):
            ids, begins = tokenizer.ids(pc.fill_null(batch.column(1), ""))
            ids = np.insert(ids, begins[1:], END).astype("<u4", copy=False)
            sizes = np.diff(begins) + 1
            first = np.cumsum(sizes) - sizes
            pieces = -(-sizes // sequence)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * sequence
            length = np.minimum(sizes[row] - start, sequence)
            at = first[row] + start
            held = memoryview(ids).cast("B")
            sums = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            arrays = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.ListArray.from_arrays(np.append(at, len(ids)).astype(np.int32), ids.astype(np.int32))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA + ", ids array<int>" * with_ids)


class Capacities:
    """Segment tree over the remaining capacities 0 to size: which of them some open sequence has."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = [False] * (2 * self.width)

    def put(self, capacity: int, is_open: bool) -> None:
        at = self.width + capacity
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least need that is open: up to the first right-hand subtree with one, then down its left."""
        at = self.width + need
        if self.open[at]:
            return need
        while at > 1 and (at % 2 or not self.open[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.width:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.width


def best_fit_plan(counts: dict[int, int], sequence: int = SEQUENCE) -> np.ndarray:
    """Best-fit decreasing over counts of equal lengths. Rows (length, first rank, ranks, first sequence, offset): of the
    documents of that length, rank first + i goes to sequence first_sequence + i at offset.

    Sequences in the same state are kept as runs of numbers. A document put into the tightest sequence leaves it the
    tightest for the next of its length, if that still fits, so each sequence takes as many as fit before the next."""
    tree = Capacities(sequence)
    runs: dict[int, list[tuple[int, int]]] = {}
    plan: list[tuple[int, int, int, int, int]] = []
    used = 0

    def leave(capacity: int, first: int, many: int) -> None:
        if capacity and many:
            runs.setdefault(capacity, []).append((first, many))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = sequence, used
                many = -(-left // (sequence // length))
                used += many
            else:
                first, many = runs[capacity].pop()
                if not runs[capacity]:
                    tree.put(capacity, False)
            fit = capacity // length
            full = min(many, left // fit)
            for slot in range(fit if full else 0):
                plan.append((length, rank, full, first, sequence - capacity + slot * length))
                rank += full
            left -= full * fit
            leave(capacity - fit * length, first, full)
            if full < many:
                rest = min(left, fit - 1) if left else 0
                for slot in range(rest):
                    plan.append((length, rank, 1, first + full, sequence - capacity + slot * length))
                    rank += 1
                left -= rest
                leave(capacity - rest * length, first + full, 1 if rest else 0)
                leave(capacity, first + full + (1 if rest else 0), many - full - (1 if rest else 0))
    return np.asarray(plan, dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, sequence: int = SEQUENCE, group_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, ids_crc32 and a length of 1 to `sequence`; more columns are
    kept, whatever their names but these two). Equal rows are interchangeable. An empty table gives an empty table.

    pieces is read twice: give a stored table. group_rows: about how many pieces of one length are ranked in one group; a
    length with more is dealt over as many groups as it needs."""
    spark = pieces.sparkSession
    salt, rank, base, salts = fresh(pieces, "_salt", "_rank", "_base", "_salts")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `sequence` rows
    plan = best_fit_plan(counts, sequence)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)  # bounded by the sequence length, not by the corpus

    shares = spark.createDataFrame([(n, -(-count // group_rows)) for n, count in counts.items()], f"length long, {salts} long")
    salted = pieces.join(F.broadcast(shares), "length")  # a row for each length
    salted = salted.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col(salts))).select(*pieces.columns, salt)
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", salt).count().select("length", salt, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    own = Window.partitionBy("length", salt).orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn(rank, F.row_number().over(own) - 1).join(bases, ["length", salt])
    ranked = ranked.select(*pieces.columns, (F.col(rank) + F.col(base)).alias(rank))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = plan[:, 0] * (1 << 48) + plan[:, 1]
        for batch in batches:
            own_length, own_rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", rank))
            row = plan[np.searchsorted(keys, own_length * (1 << 48) + own_rank, side="right") - 1]
            kept = [c for c in batch.schema.names if c != rank]
            arrays = [*(batch.column(c) for c in kept), pa.array(row[:, 3] + own_rank - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, with_field(pieces.schema, ("sequence_id", "long"), ("offset", "long")))


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Tokenise and pack: a row for each piece with its place. doc_id and text are read; nulls and repeats as in token_pieces."""
    return pack(stored(token_pieces(docs, tokenizer_path, sequence)), sequence)


def sequences(docs: DataFrame, places: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int>. A sequence holds at most `sequence` ids, so a group is bounded.
    doc_id must be unique here."""
    pieces = token_pieces(docs, tokenizer_path, sequence, with_ids=True).select("doc_id", "piece", "ids")
    held = pieces.join(places.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return held.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))
