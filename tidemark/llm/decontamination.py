"""Benchmark decontamination by a prefix-filtered set join.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. An item's windows are its
runs of ``window`` words; an item with fewer words, but not none, is one window. A window's tokens are its
shingles of ``shingle`` words. To hold a window a document must hold all of its tokens, so the
necessary prefix is one token: the rarest one, by the number of documents that hold it. A first scan counts
how many documents hold each benchmark shingle; a second one joins document shingles with the prefix tokens.
A match fixes where the window would start; the length bound (the window has to end within the
document) and the position bound (it has to start there) discard matches, and the survivors
are verified word by word over the item-sized window.

The index of prefixes is broadcast in blocks of windows of at most ``INDEX_BYTES``. With several blocks a task
holds one at a time and takes each batch of documents past all of them. Word and shingle hashes only select;
what decides are exact word numbers.

Defined cases: null text has no words; rows of the benchmark without item_id or words have no windows; an
item_id that occurs in several rows is one item with all their windows; repeated documents and null
doc_ids are reported row by row; empty tables give no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
SHINGLE = 5
INDEX_BYTES = 32 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STEP = 1 << 16


def words_of(text: bytes | None) -> list[bytes]:
    """Bytes of 0x80 and above are parts of letters, so the pattern holds on UTF-8 as it does on characters."""
    return WORD.findall((text or b"").lower())


def _multipliers(n: int) -> np.ndarray:
    return common.mix64(np.arange(101, 101 + n, dtype=np.uint64)) | np.uint64(1)


def shingle_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for every run of ``n`` word numbers; runs with an unknown word (0) get key 0."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    u, m = ids.astype(np.uint64), _multipliers(n)
    key = np.zeros(len(ids) - n + 1, np.uint64)
    known = np.ones(len(key), bool)
    for k in range(n):
        part = u[k : k + len(key)]
        key += part * m[k]
        known &= part != 0
    key = common.mix64(key) | np.uint64(1)
    key[~known] = 0
    return key


class Index:
    """Distinct windows of some items, grouped by their length, with the items that hold them."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], shingle: int) -> None:
        self.shingle = shingle
        self.vocabulary: dict[bytes, int] = {}
        self.groups: dict[int, dict] = {}
        for window in sorted(windows):
            row = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window]
            group = self.groups.setdefault(len(row), {"words": [], "items": []})
            group["words"].append(row)
            group["items"].append(sorted(windows[window]))
        for length, group in self.groups.items():
            group["words"] = np.array(group["words"], np.int64)
            group["n"] = min(shingle, length)
            flat = group["words"]
            group["keys"] = np.stack([shingle_keys(row, group["n"]) for row in flat])
        self.all_keys = {n: np.unique(np.concatenate([g["keys"].ravel() for g in self.groups.values() if g["n"] == n])) for n in {g["n"] for g in self.groups.values()}}

    def order(self, rarity: dict[int, int]) -> None:
        """Chooses every window's prefix: its rarest shingle, ties by key."""
        for group in self.groups.values():
            keys = group.pop("keys")
            rare = np.vectorize(lambda k: rarity.get(int(k), 0), otypes=[np.int64])(keys)
            at = np.array([min(range(keys.shape[1]), key=lambda j: (rare[i, j], int(keys[i, j]), j)) for i in range(len(keys))], np.int64)
            prefix = keys[np.arange(len(keys)), at]
            by = np.argsort(prefix, kind="stable")
            group["window"], group["offset"] = by, at[by]
            group["prefix"], group["start"], group["count"] = np.unique(prefix[by], return_index=True, return_counts=True)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], np.int64)

    def held(self, ids: np.ndarray) -> np.ndarray:
        """Distinct benchmark shingles of a document, for counting rarity."""
        found = []
        for n, keys in self.all_keys.items():
            if not len(keys):
                continue
            own = shingle_keys(ids, n)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            found.append(own[(keys[at] == own) & (own != 0)])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        hit, items = np.zeros(len(ids) + 1, np.int64), set()
        by_n: dict[int, np.ndarray] = {}
        for length, group in self.groups.items():
            n = group["n"]
            if n not in by_n:
                by_n[n] = shingle_keys(ids, n)
            keys = by_n[n]
            at = np.searchsorted(group["prefix"], keys)
            at[at == len(group["prefix"])] = 0
            places = np.flatnonzero((group["prefix"][at] == keys) & (keys != 0))
            for k in range(0, len(places), STEP):
                self._verify(ids, length, group, places[k : k + STEP], at, hit, items)
        return np.cumsum(hit[:-1]) > 0, items

    def _verify(self, ids: np.ndarray, length: int, group: dict, places: np.ndarray, at: np.ndarray, hit: np.ndarray, items: set[str]) -> None:
        slot, turn = at[places], 0
        while len(places):
            row = group["start"][slot] + turn
            begin = places - group["offset"][row]
            window = group["window"][row]
            fits = (begin >= 0) & (begin + length <= len(ids))
            begin, window = begin[fits], window[fits]
            same = (ids[begin[:, None] + np.arange(length)[None, :]] == group["words"][window]).all(axis=1)
            np.add.at(hit, begin[same], 1)
            np.add.at(hit, begin[same] + length, -1)
            for w in np.unique(window[same]):
                items.update(group["items"][w])
            turn += 1
            more = turn < group["count"][slot]
            places, slot = places[more], slot[more]


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words array, item_id string) for every distinct window of every item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            items, runs = [], []
            for item, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                n = min(window, len(words))
                own = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
                items += [item] * len(own)
                runs += own
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.list_(pa.binary())), pa.array(items, pa.string())], ["words", "item_id"])

    rows = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].alias("text")).where("item_id IS NOT NULL")
    return rows.mapInArrow(work, "words array<binary>, item_id string").distinct()


def _blocks(windows: DataFrame, index_bytes: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """Windows in blocks whose index stays below the bound; blocks are told apart by a hash of the window."""
    size = windows.agg(F.sum(F.expr("aggregate(words, 0L, (a, w) -> a + octet_length(w) + 16)") + 8 * WINDOW)).first()[0] or 0
    blocks = max(1, -(-2 * size // index_bytes))
    for k in range(blocks):
        own: dict[tuple[bytes, ...], set[str]] = {}
        table = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).toArrow()
        for words, item in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
            own.setdefault(tuple(words), set()).add(item)
        yield own


def _rarity(docs: DataFrame, given) -> dict[int, int]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = given.value, {}
        for batch in common.slices(batches):
            for text in common.as_bytes(batch.column(0)):
                for key in index.held(index.numbers(words_of(text))).view(np.int64).tolist():
                    seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["key", "n"])

    rows = docs.select("text").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows.column(0).to_numpy().view(np.uint64).tolist(), rows.column(1).to_pylist(), strict=True))


def contamination(docs: DataFrame, benchmark: DataFrame, carry: Sequence[str] = (), window: int = WINDOW, shingle: int = SHINGLE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, carried, n_words, n_hit, n_items, items array<string>, spans array<struct<start,end>>) per row of ``docs``."""
    spark = common.session(docs)
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), common.carried(docs, carry).alias("carried"))
    windows = common.written(windows_of(benchmark, window), "benchmark-windows")
    kind = base.schema["carried"].dataType.simpleString()
    given = []
    for own in _blocks(windows, index_bytes):
        index = Index(own, shingle)
        index.order(_rarity(base, spark.sparkContext.broadcast(index)) if own else {})
        given.append(spark.sparkContext.broadcast(index))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, common.SLICE_ROWS if len(given) == 1 else 1 << 14):
            texts = common.as_bytes(batch.column(1))
            hit: list[np.ndarray | None] = [None] * len(texts)
            items: list[set[str]] = [set() for _ in texts]
            for g in given:
                index = g.value if len(given) == 1 else g.load_from_path(g._path)
                for k, text in enumerate(texts):
                    found, names = index.hits(index.numbers(words_of(text)))
                    hit[k] = found if hit[k] is None else hit[k] | found
                    items[k] |= names
            cols: list[list] = [[], [], [], [], []]
            for own, names in zip(hit, items, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                for col, value in zip(cols, (len(own), int(own.sum()), len(names), sorted(names), spans), strict=True):
                    col.append(value)
            kinds = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "carried", "n_words", "n_hit", "n_items", "items", "spans"])

    return base.mapInArrow(work, f"doc_id long, carried {kind}, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start: bigint, end: bigint>>")

