"""Benchmark decontamination by suffix arrays over the training text.

Each shard (an Arrow batch of documents) builds a suffix array of its word stream, as deep as a window (ten words), and every
benchmark suffix is looked up in it by binary search, which gives all places where its first ten words occur. The words inside
such places are hit. A suffix array of a document's hit words, of full depth, then gives the longest verbatim match of each
item and its place: a binary search of every suffix of the item finds its neighbours, one of which shares most words with it.
An occurrence lies in one document, so nothing is shuffled.

Suffixes that hold a word the benchmark has not, or begin as no window does, are left out of the shard's array; no window can
occur there. The work grows with the words of documents and items, not with pairs of their places, so that a passage
repeated over and over costs no more than another of its length.

The benchmark travels to the tasks in blocks of a bounded number of words; each block is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import fresh, stored

WINDOW = 10
#: Benchmark words in one broadcast block.
BLOCK_WORDS = 1_000_000
#: Hit passages whose longest matches a task remembers.
REMEMBERED = 10_000
#: ASCII letters in lower case, digits and all bytes from 0x80 make words; every other byte separates them.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split()


def _suffix_keys(stream: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The k words from each place on as byte strings in the order of the words' ids."""
    rows = stream[places[:, None] + np.arange(k)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * k}").ravel()


def _heads(stream: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """A code of the first three words (all, if k is less) from each place on; different words may share one."""
    code = np.zeros(len(places), dtype=np.uint64)
    for i in range(min(3, k)):
        code = code * np.uint64(0x9E3779B97F4A7C15) + stream[places + i].astype(np.uint64)
    return code


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0], ..., high[0] - 1, low[1], ..."""
    sizes = high - low
    return np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@dataclass
class Windows:
    """The distinct windows of one length: a place of each in the benchmark's stream, the code of its head, and the items that have it."""

    first: np.ndarray
    heads: np.ndarray
    begins: np.ndarray
    items: np.ndarray

    def owners(self, which: np.ndarray) -> np.ndarray:
        return np.unique(self.items[_ranges(self.begins[which], self.begins[which + 1])])


def suffix_ranks(stream: np.ndarray) -> list[np.ndarray]:
    """By prefix doubling: the order of all suffixes of the stream by their first 1, 2, 4, ... words, until they all differ."""
    ranks = [np.unique(stream, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while len(stream) and ranks[-1].max() + 1 < len(stream):
        after = np.zeros(len(stream), dtype=np.int64)
        after[:-step] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (len(stream) + 1) + after, return_inverse=True)[1].astype(np.int64))
        step *= 2
    return ranks


def common_words(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and b share at their beginnings."""
    shared = np.zeros(len(a), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = np.maximum(x, y) < len(ranks[level])
        same = inside.copy()
        same[inside] = ranks[level][x[inside]] == ranks[level][y[inside]]
        shared[same] += 1 << level
    return shared


def longest_matches(passages: list[np.ndarray], items: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Of each item the longest run of words it shares with a passage: (passage, word of it, word of the item, length)."""
    runs = [*passages, *items]
    gap = -1 - np.arange(len(runs))  # no two runs end alike, so no match goes beyond a run
    stream = np.concatenate([x for run, end in zip(runs, gap, strict=True) for x in (run, [end])])
    begins = np.cumsum([0, *(len(r) + 1 for r in runs)])
    ranks = suffix_ranks(stream)
    own = begins[len(passages)]
    places = np.argsort(ranks[-1][:own])  # the suffix array of the passages
    array = ranks[-1][:own][places]
    asked = np.arange(own, len(stream))
    at = np.searchsorted(array, ranks[-1][own:])
    sides = [places[np.maximum(at - 1, 0)], places[np.minimum(at, own - 1)]]
    shared = [common_words(ranks, asked, side) for side in sides]
    best, place = np.maximum(*shared), np.where(shared[0] >= shared[1], *sides)
    out = []
    for i in range(len(items)):
        lo = begins[len(passages) + i]
        j = int(best[lo - own : begins[len(passages) + i + 1] - own].argmax())
        passage = int(np.searchsorted(begins, place[lo - own + j], side="right")) - 1
        out.append((passage, int(place[lo - own + j] - begins[passage]), j, int(best[lo - own + j])))
    return out


@dataclass
class Suffixes:
    """One block of the benchmark: its words in one stream, item after item. Word ids count from 1; 0 is any word that the block has not."""

    window: int = WINDOW
    ids: dict[bytes, int] = field(default_factory=dict)
    names: list[str | None] = field(default_factory=list)
    stream: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    begins: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    windows: dict[int, Windows] = field(default_factory=dict)
    told: dict[bytes, list[tuple[str, int, int, int, int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Suffixes:
        out, texts = cls(window), []
        for name, text in rows:
            if found := words_of(text):
                texts.append(np.array([out.ids.setdefault(w, len(out.ids) + 1) for w in found], dtype=np.int64))
                out.names.append(name)
        if not texts:
            return out
        sizes = np.array([len(t) for t in texts])
        out.stream, out.begins = np.concatenate(texts), np.concatenate([[0], np.cumsum(sizes)])
        depths = np.minimum(sizes, window)
        for k in np.unique(depths).tolist():
            of_length = np.flatnonzero(depths == k)
            count = sizes[of_length] - k + 1
            places, items = _ranges(out.begins[of_length], out.begins[of_length] + count), np.repeat(of_length, count)
            _, first, window_of = np.unique(_suffix_keys(out.stream, places, k), return_index=True, return_inverse=True)
            pairs = np.unique(window_of.ravel() * len(texts) + items)
            begins = np.searchsorted(pairs, np.arange(len(first) + 1) * len(texts))
            out.windows[k] = Windows(places[first], _heads(out.stream, places[first], k), begins, pairs % len(texts))
        return out

    def occurrences(self, stream: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length: places in the stream, and the window that occurs at each."""
        known = np.concatenate([[0], np.cumsum(stream > 0)])
        for k, windows in self.windows.items():
            places = np.flatnonzero(known[k:] - known[:-k] == k)
            heads = _heads(stream, places, k)
            begun = np.isin(heads, windows.heads)
            places, heads = places[begun], heads[begun]
            if not len(places):
                continue
            suffixes = _suffix_keys(stream, places, k)
            order = np.argsort(suffixes, kind="stable")  # the suffix array, as deep as a window
            asked = np.flatnonzero(np.isin(windows.heads, heads))
            keys = _suffix_keys(self.stream, windows.first[asked], k)
            low, high = (np.searchsorted(suffixes[order], keys, side=side) for side in ("left", "right"))
            yield k, places[order[_ranges(low, high)]], np.repeat(asked, high - low)

    def matches(self, passages: list[np.ndarray], items: np.ndarray) -> list[tuple[str, int, int, int, int]]:
        """(name, passage, word of it, word of the item, length) of the longest match of each named item; of items that share a
        name the longest. items are those that have a window in the passages, so the passages alone decide, and are remembered."""
        key = b"".join(np.append(p, 0).tobytes() for p in passages)
        if key not in self.told:
            if len(self.told) >= REMEMBERED:
                self.told.clear()
            named = [i for i in items.tolist() if self.names[i] is not None]
            best: dict[str, tuple[int, int, int, int]] = {}
            for i, got in zip(named, longest_matches(passages, [self.stream[self.begins[i] : self.begins[i + 1]] for i in named]), strict=True):
                if self.names[i] not in best or got[3] > best[self.names[i]][3]:
                    best[self.names[i]] = got
            self.told[key] = [(name, *got) for name, got in sorted(best.items())]
        return self.told[key]


MATCH = "array<struct<item_id:string,doc_word:int,item_word:int,n_words:int>>"


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """docs with more columns, of every row: n_words, hit_spans (array of [first, end) word places inside occurrences, merged),
    item_ids (sorted as strings) of items with occurring windows, and matches (each item's longest verbatim match and its place).

    Null, empty and wordless texts have no words and no hits. Benchmark rows without words have no windows; a row without id
    marks words but no item; repeated items count once. A benchmark of more than about block_words words is searched in blocks, one
    at a time: a pass's marks are stored before the next block is collected and broadcast, so memory does not grow with their number
    (each pass writes docs once more and deletes the pass before). Columns of docs with these names are kept, ours then get underscores (see the returned frame's last four)."""
    named = fresh(docs, "n_words", "hit_spans", "item_ids", "matches")
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()["c"] // 2 + 1  # a word is two characters at least with its gap
    blocks = -(-size // block_words)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    out = docs.withColumns({named[0]: F.lit(None).cast("long"), named[1]: F.array().cast("array<long>"), named[2]: F.array().cast("array<string>"), named[3]: F.array().cast(MATCH)})
    for block in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        held = docs.sparkSession.sparkContext.broadcast(Suffixes.of([tuple(r) for r in part.collect()], window))  # at most about block_words words
        marked = out.mapInArrow(_scan(held, docs.columns.index(text), len(docs.columns)), out.schema)
        if blocks == 1:
            return marked
        out = stored(marked, instead_of=out if block else None)
        held.destroy()
    return out


def _scan(held, text: int, at_new: int):
    """text: the column to read; the four columns from at_new on are ours."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            lengths, streams = [], []
            for t in batch.column(text).to_pylist():
                words = words_of(t)
                streams += [np.fromiter(map(index.ids.get, words, repeat(0)), dtype=np.int64, count=len(words)), np.zeros(1, dtype=np.int64)]
                lengths.append(len(words))
            starts = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64) + 1)])
            stream = np.concatenate([*streams, np.zeros(0, dtype=np.int64)])
            found = [(places, places + k, np.full(len(places), k), which) for k, places, which in index.occurrences(stream)]
            spans, items, matches = (batch.column(at_new + i).to_pylist() for i in (1, 2, 3))
            if any(len(f[0]) for f in found):
                first, end, depth, which = (np.concatenate(x) for x in zip(*found, strict=True))
                docs = np.searchsorted(starts, first, side="right") - 1
                order = np.lexsort((first, docs))
                for part in np.split(order, np.flatnonzero(np.diff(docs[order])) + 1):
                    doc, at = int(docs[part[0]]), int(starts[docs[part[0]]])
                    own = _merged(np.column_stack([first[part], end[part]]) - at)
                    owners = np.unique(np.concatenate([index.windows[k].owners(np.unique(which[part][depth[part] == k])) for k in np.unique(depth[part]).tolist()]))
                    got = index.matches([stream[at + a : at + b] for a, b in own], owners)
                    old = np.array(spans[doc], dtype=np.int64).reshape(-1, 2)
                    spans[doc] = _merged(np.concatenate([old, own])).ravel().tolist()
                    items[doc] = sorted({*items[doc], *(name for name, *_ in got)})
                    matches[doc] = [*matches[doc], *({"item_id": name, "doc_word": int(own[p, 0]) + a, "item_word": o, "n_words": n} for name, p, a, o, n in got)]
            kinds = [batch.schema.field(at_new + i).type for i in range(4)]
            ours = [pa.array(v, type=t) for v, t in zip((lengths, spans, items, matches), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_new], *ours], schema=batch.schema)

    return scan


def _merged(spans: np.ndarray) -> np.ndarray:
    """The unions of [first, end) rows that overlap or touch, in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    upto = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > upto[:-1]) if len(spans) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    return np.column_stack([spans[at, 0], upto[np.append(at[1:], len(spans)) - 1]]) if len(spans) else spans


def hit_words(spans):
    """Words inside the flat list of [first, end) places."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with the columns of docs."""
    marked = mark(docs, benchmark)
    spans = marked.columns[-3]
    return marked.filter(F.size(spans) == 0).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches of every document."""
    m = mark(docs.select("doc_id", "text"), benchmark)
    return m.select(
        "doc_id",
        "n_words",
        hit_words(F.col("hit_spans")).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
        "matches",
    )
