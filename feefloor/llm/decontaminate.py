"""Benchmark decontamination by SimHash of item-sized windows.

Every stretch of a document with as many words as a benchmark item is a window.
Windows that hold a shingle of any item get a SimHash of their five-word shingles,
weighted by how often each occurs. Items of the window's size whose fingerprint
lies within ``RADIUS`` bits are found by a multi-index: fingerprints are cut into
``BLOCKS`` bytes, and two within the radius agree up to RADIUS // BLOCKS bits in at
least one of them, so looking up that many bits' neighbours of every byte misses
none. What is found is verified by the exact weighted Jaccard similarity, sum of
the lesser over sum of the greater counts, which must reach 3/4.

A window without a shingle of an item has similarity 0 to it, so leaving those out
loses nothing. A document with fewer words than an item is one window for it.
Items are read in portions of at most ``PORTION`` so that what tasks hold has a
bound. Items with fewer than five words, empty or null, are no evidence and are
not searched for. Null or empty documents match nothing. Rows that share an id
are searched each by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feefloor.llm.common import hashed_shingles, map_arrow, over_batches, steps, table

SHINGLE = 5
SIMILARITY = (3, 4)
RADIUS = 23
BLOCKS = 8
#: Items that a pass over the documents searches for.
PORTION = 20_000

MATCHES = ("doc_id long,item_id long,start long,end long,similarity double,"
           "distance int,contaminated boolean")

_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NEAR = _BITS[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 values of +1 or -1 for each hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(totals: np.ndarray) -> np.ndarray:
    """Rows of 8 bytes from rows of 64 sums."""
    return np.packbits(totals > 0, axis=1)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags of hashes."""
    words, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    n_a = np.bincount(inverse[:len(a)], minlength=len(words))
    n_b = np.bincount(inverse[len(a):], minlength=len(words))
    return float(np.minimum(n_a, n_b).sum() / np.maximum(n_a, n_b).sum())


class Items:
    """Fingerprints of a portion of items by their number of shingles."""

    def __init__(self, ids: list[int], texts: list[str]):
        hashes, owner, _, _, _, first = hashed_shingles(pa.array(texts, pa.string()), SHINGLE)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        words = np.diff(first)
        self.ids, self.bags = [], []
        by_size: dict[int, list[int]] = {}
        for i in np.flatnonzero(words >= SHINGLE):
            bag = hashes[bounds[i]:bounds[i + 1]]
            by_size.setdefault(len(bag), []).append(len(self.ids))
            self.ids.append(ids[i])
            self.bags.append(bag)
        self.vocabulary = np.unique(np.concatenate(self.bags or [np.empty(0, np.uint64)]))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.sizes = {}
        for size, own in by_size.items():
            prints = fingerprints(np.array([signs(self.bags[k]).sum(axis=0) for k in own]))
            # near[b][value] says which items lie near that value in block b
            near = [_NEAR[:, prints[:, b]] for b in range(BLOCKS)]
            self.sizes[size] = (np.array(own), prints, near)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are shingles of an item."""
        out = self.sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]),
                               len(self.vocabulary) - 1)
            out[at] = self.vocabulary[place] == hashes[at]
        return out

    def matches(self, hashes: np.ndarray, hits: np.ndarray
                ) -> Iterator[tuple[int, int, int, float, int]]:
        """(item, first shingle, shingles, similarity, distance) for one document.

        The best window of each item, the first one of equals.
        """
        for begin, end in _stretches(hits, max(self.sizes)):
            begin, end = max(begin, 0), min(end, len(hashes))
            sums = np.zeros((end - begin + 1, 64), np.int32)
            np.cumsum(signs(hashes[begin:end]), axis=0, out=sums[1:])
            near_hits = hits[(hits >= begin) & (hits < end)] - begin
            for size, (own, prints, near) in self.sizes.items():
                width = min(size, end - begin)
                starts = np.arange(end - begin - width + 1)
                # windows that hold a hit
                starts = starts[np.searchsorted(near_hits, starts + width)
                                > np.searchsorted(near_hits, starts)]
                if not len(starts):
                    continue
                found = fingerprints(sums[starts + width] - sums[starts])
                close = reduce(np.logical_or, (near[b][found[:, b]] for b in range(BLOCKS)))
                window, item = np.nonzero(close)
                apart = _BITS[found[window] ^ prints[item]].sum(axis=1)
                keep = apart <= RADIUS
                for s, k, d in zip(starts[window[keep]], own[item[keep]], apart[keep]):
                    at = begin + int(s)
                    value = weighted_similarity(hashes[at:at + width], self.bags[k])
                    if SIMILARITY[1] * value >= SIMILARITY[0]:
                        yield int(k), at, width, value, int(d)


def _stretches(hits: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Ranges of shingles that cover all windows with hits; far hits lie apart."""
    cuts = np.flatnonzero(np.diff(hits) > 2 * width)
    for a, b in zip(np.append(0, cuts + 1), np.append(cuts, len(hits) - 1)):
        yield int(hits[a]) - width + 1, int(hits[b]) + width


def contained(texts: pa.Array, items: Items) -> Iterator[tuple[int, list[tuple]]]:
    """(text, [(item id, start, end, similarity, distance)]) of texts that hold an item.

    Start and end are code points of the best window, end exclusive.
    """
    for begin, end in steps(texts):
        chunk = texts[begin:end]
        hashes, owner, at, starts, ends, _ = hashed_shingles(chunk, SHINGLE)
        hit = np.flatnonzero(items.known(hashes))
        for i in np.unique(owner[hit]):
            low, high = np.searchsorted(owner, [i, i + 1])
            own = hit[(hit >= low) & (hit < high)] - low
            best: dict[int, tuple] = {}
            for k, s, width, value, d in items.matches(hashes[low:high], own):
                if k not in best or value > best[k][2]:
                    best[k] = (s, width, value, d)
            if not best:
                continue
            data = chunk[int(i)].as_py().encode()
            base = int(starts[at[low]]) - _lead(data)
            found = []
            for k, (s, width, value, d) in best.items():
                a = int(starts[at[low + s]]) - base
                b = int(ends[at[low + s + width - 1] + SHINGLE - 1]) - base
                found.append((items.ids[k], len(data[:a].decode()), len(data[:b].decode()),
                              value, d))
            yield begin + int(i), found


def find(docs: DataFrame, items: Items) -> DataFrame:
    """``MATCHES``: one row for each document and item that is contained in it."""

    def run(batch):
        ids = batch.column("doc_id").to_pylist()
        rows = [(ids[i], *match, True) for i, found in contained(batch.column("text"), items)
                for match in found]
        columns = list(zip(*rows)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(),
                 pa.bool_())
        names = [part.split()[0] for part in MATCHES.split(",")]
        yield {n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)}

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, MATCHES)


def without_matches(docs: DataFrame, benchmark: DataFrame, size: int = PORTION) -> DataFrame:
    """Rows of ``docs`` that hold no item, in one pass for each portion of items."""
    for items in portions(benchmark, size):
        def clean(batches, items=items):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _ in contained(batch.column("text"), items)]] = False
                yield batch.filter(pa.array(keep))

        docs = map_arrow(docs, clean, docs.schema)
    return docs


def _lead(data: bytes) -> int:
    """Bytes before the first word."""
    return len(data) - len(data.lstrip(b" \t\n\x0b\x0c\r"))


def portions(benchmark: DataFrame, size: int = PORTION) -> Iterator[Items]:
    """Items in portions of at most ``size``, by a hash of their id."""
    parts = max(1, -(-2 * benchmark.count() // size))
    slot = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    for k in range(parts):
        rows = (benchmark.where((slot == k) & F.col("text").isNotNull())
                .select("item_id", "text").collect())
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        if items.ids:
            yield items


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = PORTION) -> DataFrame:
    """Matches of all items; empty if there is no item to search for."""
    found = [find(docs, items) for items in portions(benchmark, size)]
    if not found:
        return docs.sparkSession.createDataFrame([], MATCHES)
    return reduce(DataFrame.unionByName, found)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
