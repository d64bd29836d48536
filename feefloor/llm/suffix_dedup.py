"""Removal of repeated stretches by longest-previous-factor arrays.

A byte is removed if a string of ``SPAN`` bytes that covers it also starts elsewhere
in the corpus. One suffix array over everything would have to sort every byte
against every other, so suffixes are first brought together by content:

1. Every window of ``SPAN`` bytes names as its anchor the gram of ``GRAM`` bytes in it
   with the least hash, so equal windows name equal grams at equal places. About
   one byte in 70 is an anchor.
2. Anchors meet in buckets by their gram. Where the whole surroundings, all windows
   that the gram could be the anchor of, are equal too, these windows are repeats at
   once. Copies are counted where they are read, so a text with a million copies
   sends one entry per batch of input, not one per copy.
3. Only grams with differing surroundings are left, at the edges of repeats. Their
   surroundings are sorted as suffixes up to ``SPAN`` bytes, by doubling ranks. Previous
   and next smaller positions in suffix order give each suffix its longest earlier
   match (and, with the order of positions reversed, its longest later one).
   A window is a repeat if that reaches ``SPAN``. Grams with very many different
   surroundings are not gathered in a task: their windows are counted one by one,
   those of a batch beforehand, so that copies of a window send one entry a batch.
   Grams that a batch holds with several surroundings are added up beforehand, so
   that those of a common gram are met by gram and surroundings and not by gram.

With ``keep_first`` the first copy of everything stays (in order of doc_id, then
position) and later ones go; without it every copy goes.

Texts are UTF-8 bytes, null is the empty text, and matches never cross texts.
Rows that share doc_id and text are copies of each other; with ``keep_first`` they
count as one and stay or go together. A null id comes before all others; inside, the
least 64-bit number stands for it, which so is no id of its own. Texts
shorter than ``SPAN`` bytes are kept whole. Windows are compared byte by byte inside
a task and by 128-bit hashes where counted one by one; surroundings by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feefloor.llm.common import (
    map_arrow, mix, over_batches, prefix_hash, raw, ship, span_hash, steps, table)
from feefloor.session import cut_lineage

SPAN = 200
GRAM = 64
#: Bytes on either side of an anchor that windows around it may reach.
REACH = SPAN - GRAM
#: Anchors per bucket aimed at; surroundings of one gram that a task sorts at most.
BUCKET_ENTRIES = 200_000
NO_ID = -2**63
WIDE = 4000
#: Entries of a gram that no batch calls frequent, and rows that a batch has at least,
#: a few at the ends of files apart.
UNSEEN = 4_000_000
BATCH_ROWS = 1000
#: Bytes of surroundings sorted together.
SORT_BYTES = 1 << 20

_ENTRY = np.dtype([("gram", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("key", "<i4"),
                   ("at", "<i4"), ("left", "u1"), ("right", "u1"), ("seen", "u1")])
_FOUND = "doc_id long,key int,begin int,end int,at int,gram long,wide boolean"
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- 1: anchors ----------------------------------------------------------------

def sliding(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over values[i:i + width] for every i, short at the end; two sweeps."""
    n = len(values)
    padded = np.full(-(-(n + width) // width) * width, fill, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    behind = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(gram hash, position, text, sums) of all anchors of the texts in ``data``."""
    sums = prefix_hash(data)
    n = len(data) - GRAM + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, sums
    top = np.uint64(2**64 - 1)
    place = np.arange(n)
    grams = mix(span_hash(sums, place, place + GRAM)) >> np.uint64(1)
    lengths = np.diff(offsets)
    # The last gram and the last window of each text; later ones would cross into the next.
    inside = np.zeros(len(data), np.int32)
    for keep, mark in ((GRAM, 1), (SPAN, 2)):
        full = lengths >= keep
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, offsets[:-1][full], mark)
        np.add.at(edge, offsets[1:][full] - keep + 1, -mark)
        inside += np.cumsum(edge[:-1])
    grams[(inside[:n] & 1) == 0] = top
    width = SPAN - GRAM + 1
    least = sliding(grams, width, np.minimum, top)
    least[(inside[:n] & 2) == 0] = 0
    # A gram is an anchor if it is the least of some window that holds it.
    most = sliding(np.concatenate([np.zeros(width - 1, np.uint64), least]), width,
                   np.maximum, 0)[:n]
    at = np.flatnonzero((most == grams) & (grams != top))
    return grams[at], at, np.searchsorted(offsets, at, "right") - 1, sums


_POSTED = "bucket int,entries binary,finished binary,grams binary"


def entries(docs: DataFrame, buckets: int, keep_first: bool, few: int) -> DataFrame:
    """(bucket, entries), and for each batch its finished stretches and frequent grams.

    Finished stretches have their begin in at and their end in gram. ``few``: of a gram
    that no batch calls frequent, a bucket takes at most so many entries a batch.
    """

    def run(batch):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        texts, kept = batch.column("text"), []
        for begin, end in steps(texts):
            data, offsets = raw(texts[begin:end])
            grams, at, owner, sums = anchors(data, offsets)
            low = np.maximum(at - REACH, offsets[owner])
            high = np.minimum(at + SPAN, offsets[owner + 1])
            entry = np.zeros(len(at), _ENTRY)
            entry["gram"] = grams
            entry["left"], entry["right"] = at - low, high - at - GRAM
            entry["around"] = mix(span_hash(sums, low, high) + entry["left"] * _K1
                                  + entry["right"] * _K2)
            entry["doc"], entry["key"] = ids[begin:end][owner], keys[begin:end][owner]
            entry["at"] = at - offsets[owner]
            kept.append(entry)
        entry = np.concatenate(kept) if kept else np.zeros(0, _ENTRY)
        first, count, group = _groups(entry)
        entry["seen"] = np.minimum(count[group], 2)
        finished = _stretches(entry[(count[group] > 1)
                                    & (_later(entry, first[group]) | (not keep_first))])
        entry = entry[first]
        grams, n = np.unique(entry["gram"], return_counts=True)
        common = np.stack([grams[n > few].view(np.int64), n[n > few]], axis=1)
        to = (entry["gram"] >> np.uint64(20)).astype(np.int64) % buckets
        entry, to = entry[np.argsort(to, kind="stable")], np.sort(to)
        found, begins = np.unique(to, return_index=True)
        ends = np.append(begins[1:], len(to))
        blobs = [entry[a:b].tobytes() for a, b in zip(begins, ends)]
        none = [None] * len(blobs)
        yield {"bucket": pa.array([*found.tolist(), None], pa.int32()),
               "entries": pa.array([*blobs, None], pa.binary()),
               "finished": pa.array([*none, finished.tobytes()], pa.binary()),
               "grams": pa.array([*none, common.tobytes()], pa.binary())}

    return over_batches(docs, run, _POSTED)


def common_grams(posted: DataFrame, most: int) -> np.ndarray:
    """Grams whose surroundings, added up over the batches, are more than ``most``.

    Copies in several batches count several times, so some grams with fewer are among
    them; that only decides by which way they go. There is at most one of them for
    ``most`` entries.
    """

    def run(batch):
        for blob in batch.column("grams").to_pylist():
            pairs = np.frombuffer(blob, np.int64).reshape(-1, 2)
            yield {"gram": pa.array(pairs[:, 0]), "n": pa.array(pairs[:, 1])}

    rows = (over_batches(posted.select("grams").where("grams IS NOT NULL"), run,
                         "gram long,n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect())
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))


def routed(posted: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, entries): entries of common grams by their surroundings, to buckets below 0."""
    filed = posted.select("bucket", "entries").where("entries IS NOT NULL")
    if not len(common):
        return filed

    def run(batch):
        for bucket, blob in zip(batch.column("bucket").to_pylist(),
                                batch.column("entries").to_pylist()):
            entry = np.frombuffer(blob, _ENTRY)
            apart = np.isin(entry["gram"], common)
            to = np.full(len(entry), bucket, np.int64)
            to[apart] = -1 - (mix(entry["gram"][apart] * _K1 + entry["around"][apart])
                              >> np.uint64(20)).astype(np.int64) % buckets
            found = np.unique(to)
            yield {"bucket": pa.array(found, pa.int32()),
                   "entries": pa.array([entry[to == k].tobytes() for k in found], pa.binary())}

    return over_batches(filed, run, "bucket int,entries binary")


def _groups(entry: np.ndarray):
    """First entry (by document and place) and count of equal surroundings of a gram."""
    order = np.lexsort((entry["at"], entry["key"], entry["doc"], entry["around"],
                        entry["gram"]))
    gram, around = entry["gram"][order], entry["around"][order]
    new = np.ones(len(entry), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])
    group = np.empty(len(entry), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], np.bincount(group, minlength=int(new.sum())), group


def _later(entry: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which entries are elsewhere than the first of their group."""
    own = entry[["doc", "key", "at"]]
    return own != own[first]


def _stretches(entry: np.ndarray) -> np.ndarray:
    """Surroundings as stretches of their texts, overlapping ones merged."""
    entry = entry[np.lexsort((entry["at"], entry["key"], entry["doc"]))].copy()
    low = entry["at"].astype(np.int64) - entry["left"]
    high = entry["at"].astype(np.int64) + GRAM + entry["right"]
    new = np.ones(len(entry), bool)
    new[1:] = ((entry["doc"][1:] != entry["doc"][:-1]) | (entry["key"][1:] != entry["key"][:-1])
               | (low[1:] > high[:-1]))
    # Surroundings have about one length, so ends rise with places within a text.
    last = np.append(np.flatnonzero(new)[1:] - 1, len(entry) - 1) if len(entry) else []
    out = entry[new]
    out["at"], out["gram"] = low[new], high[last].astype(np.uint64)
    return out


# --- 2: buckets -------------------------------------------------------------------

def meet(posted: DataFrame, buckets: int, keep_first: bool, most: int = WIDE) -> DataFrame:
    """Stretches that are repeats, and surroundings that are still to be sorted.

    A row with ``at`` is an anchor to be sorted; for others begin to end is a repeat.
    ``begin`` and ``end`` of an anchor are its surroundings.
    """

    def bucket(rows: pa.Table) -> pa.Table:
        entry = np.frombuffer(b"".join(rows.column("entries").to_pylist()), _ENTRY)
        common = rows.column("bucket")[0].as_py() < 0
        first, _, group = _groups(entry)
        many = np.bincount(group, weights=entry["seen"], minlength=len(first)) > 1
        repeat = many[group] & (_later(entry, first[group]) | (not keep_first))
        low = entry["at"].astype(np.int64) - entry["left"]
        high = entry["at"].astype(np.int64) + GRAM + entry["right"]
        # Grams with differing surroundings, unless all of these are repeats already.
        grams = entry["gram"][first]
        new = np.append(True, grams[1:] != grams[:-1])
        own = np.cumsum(new) - 1
        differ = np.bincount(own)[own]
        open_ = np.bincount(own, weights=~many | keep_first)[own] > 0
        # The other surroundings of a common gram are in other buckets.
        waits = (differ > 1) & open_ | common
        sort = first[waits]
        wide = ((differ > most) | common)[waits]
        done = _rows(entry[repeat], low[repeat], high[repeat])
        left = _rows(entry[sort], low[sort], high[sort], entry["at"][sort],
                     entry["gram"][sort].astype(np.int64), wide)
        return pa.concat_tables([done, left])

    def finished(batches):
        for batch in batches:
            for blob in batch.column("finished").to_pylist():
                entry = np.frombuffer(blob, _ENTRY)
                yield from _rows(entry, entry["at"], entry["gram"].astype(np.int64)).to_batches()

    ship(posted.sparkSession)
    met = routed(posted, common_grams(posted, most), buckets).groupBy("bucket").applyInArrow(
        bucket, _FOUND)
    # Finished stretches meet nothing, so they are in no group.
    return met.unionByName(map_arrow(
        posted.select("finished").where("finished IS NOT NULL"), finished, _FOUND))


def _rows(entry, begin, end, at=None, gram=None, wide=None) -> pa.Table:
    nulls = pa.nulls
    return pa.table({
        "doc_id": pa.array(entry["doc"]), "key": pa.array(entry["key"]),
        "begin": pa.array(begin.astype(np.int32)), "end": pa.array(end.astype(np.int32)),
        "at": nulls(len(entry), pa.int32()) if at is None else pa.array(at.astype(np.int32)),
        "gram": nulls(len(entry), pa.int64()) if gram is None else pa.array(gram),
        "wide": nulls(len(entry), pa.bool_()) if wide is None else pa.array(wide)})


# --- 3: suffixes ---------------------------------------------------------------------

def truncated_ranks(data: np.ndarray, span: int) -> list[tuple[int, np.ndarray]]:
    """(length, ranks): order of all suffixes by their first 8, 16, ... span bytes.

    Bytes beyond the end count as zeros.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j:n + j]
    ranks = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, length = [(8, ranks)], 8
    while length < span:
        step = min(length, span - length)
        beyond = np.zeros(n, np.int64)
        if step < n:
            beyond[:n - step] = ranks[step:] + 1
        ranks = np.unique(ranks * (n + 1) + beyond, return_inverse=True)[1].astype(np.int64)
        length += step
        levels.append((length, ranks))
    return levels


def common_lengths(order: np.ndarray, levels, data: np.ndarray, span: int) -> np.ndarray:
    """Longest common prefix, up to span, of each suffix with the one before it in order."""
    n = len(data)
    a, b = order[:-1].copy(), order[1:].copy()
    found = np.zeros(len(a), np.int64)
    full = levels[-1][1]
    same = full[a] == full[b]
    for length, ranks in reversed(levels[:-1]):
        go = (~same) & (a + length <= n) & (b + length <= n)
        go[go] = ranks[a[go]] == ranks[b[go]]
        found[go] += length
        a[go] += length
        b[go] += length
    for _ in range(7):
        go = (~same) & (a < n) & (b < n)
        go[go] = data[a[go]] == data[b[go]]
        found[go] += 1
        a[go] += 1
        b[go] += 1
        same |= ~go
    found[full[order[:-1]] == full[order[1:]]] = span
    return np.concatenate([[0], np.minimum(found, span)])


def to_smaller(places: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the nearest before it whose place is smaller.

    ``common`` holds each suffix's common prefix with its predecessor. Pointers
    jump over runs of larger places together, doubling their reach.
    """
    n = len(places)
    target, low = np.arange(n) - 1, common.copy()
    active = np.flatnonzero((target >= 0) & (low > 0))
    active = active[places[target[active]] > places[active]]
    while len(active):
        j = target[active]
        new_low, new_target = np.minimum(low[active], low[j]), target[j]
        low[active], target[active] = new_low, new_target
        go = (new_target >= 0) & (new_low > 0)
        active = active[go]
        active = active[places[target[active]] > places[active]]
    low[target < 0] = 0
    return low


def longest_factors(data: np.ndarray, span: int, places: np.ndarray | None = None
                    ) -> tuple[np.ndarray, np.ndarray]:
    """(previous, next): longest match, up to span, of the suffix at each place with
    one that starts earlier, and with one that starts later. Of suffixes not in
    ``places``, which rise, none is matched, and they keep 0."""
    levels = truncated_ranks(data, span)
    own = np.arange(len(data)) if places is None else places
    order = own[np.argsort(levels[-1][1][own], kind="stable")]
    common = common_lengths(order, levels, data, span)
    if not len(order):
        return np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    backward = np.concatenate([[0], common[:0:-1]])
    out = []
    for at in (order, -order):
        before = to_smaller(at, common)
        after = to_smaller(at[::-1], backward)[::-1]
        factor = np.zeros(len(data), np.int64)
        factor[order] = np.maximum(before, after)
        out.append(factor)
    return out[0], out[1]


def repeated_windows(parts: list[bytes], span: int, keep_first: bool) -> list[np.ndarray]:
    """For each part, in order, the starts of windows that repeat in another part."""
    lengths = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(parts), np.uint8)
    # Windows that would run from one part into the next are no windows.
    inside = [np.arange(a, max(b - span + 1, a)) for a, b in zip(starts[:-1], starts[1:])]
    previous, following = longest_factors(data, span, np.concatenate(inside))
    hit = previous >= span
    if not keep_first:
        hit |= following >= span
    out = []
    for k, n in enumerate(lengths):
        own = hit[starts[k]:starts[k] + max(n - span + 1, 0)]
        out.append(np.flatnonzero(own))
    return out


def _sorted_groups(keep_first: bool):
    def run(batches):
        pending: list[dict] = []
        held, gram = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["gram"] != gram and held > SORT_BYTES:
                    yield _found(pending, keep_first)
                    pending, held = [], 0
                gram = row["gram"]
                pending.append(row)
                held += len(row["bytes"])
        if pending:
            yield _found(pending, keep_first)

    return run


_STRETCH = "doc_id long,key int,begin int,end int"


def _found(rows: list[dict], keep_first: bool) -> pa.RecordBatch:
    """Repeated stretches. Parts of one text may overlap, so a window that meets itself
    in another part counts only if it also starts elsewhere."""
    rows = _unoverlapped(rows)
    rows.sort(key=lambda r: (r["doc_id"], r["key"], r["begin"]))
    windows = repeated_windows([r["bytes"] for r in rows], SPAN, keep_first)
    out: dict[str, list] = {"doc_id": [], "key": [], "begin": [], "end": []}
    for row, starts in zip(rows, windows):
        if len(starts):
            cut = np.flatnonzero(np.diff(starts) > SPAN)
            for a, b in zip(np.append(0, cut + 1), np.append(cut, len(starts) - 1)):
                out["doc_id"].append(row["doc_id"])
                out["key"].append(row["key"])
                out["begin"].append(row["begin"] + int(starts[a]))
                out["end"].append(row["begin"] + int(starts[b]) + SPAN)
    return pa.RecordBatch.from_arrays(
        [pa.array(out["doc_id"], pa.int64()), *(pa.array(out[n], pa.int32())
                                                for n in ("key", "begin", "end"))],
        ["doc_id", "key", "begin", "end"])


def _unoverlapped(rows: list[dict]) -> list[dict]:
    """Overlapping surroundings of one text joined to one part."""
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["key"], r["begin"]))
    out: list[dict] = []
    for row in rows:
        last = out[-1] if out else None
        if last and (last["doc_id"], last["key"]) == (row["doc_id"], row["key"]) \
                and row["begin"] <= last["begin"] + len(last["bytes"]):
            more = row["begin"] + len(row["bytes"]) - last["begin"] - len(last["bytes"])
            if more > 0:
                last["bytes"] += row["bytes"][-more:]
        else:
            out.append(dict(row))
    return out


#: Windows that a bucket of ``counted_windows`` gets at most, if spread evenly.
BUCKET_WINDOWS = 500_000
#: Surroundings whose windows are counted together where they are read.
COUNTED_ROWS = 4000
_WINDOW = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("doc", "<i8"), ("key", "<i4"),
                    ("begin", "<i4"), ("many", "u1")])
_HIT = np.dtype([("doc", "<i8"), ("key", "<i4"), ("begin", "<i4"), ("end", "<i4")])


def windows_of(rows: list[dict]) -> np.ndarray:
    """All windows of surroundings, by document and place; no place comes twice."""
    rows = _unoverlapped(rows)
    counts = np.array([max(len(r["bytes"]) - SPAN + 1, 0) for r in rows], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(r["bytes"]) for r in rows])])[:-1]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(starts, counts).astype(np.int64) + within
    sums = prefix_hash(np.frombuffer(b"".join([r["bytes"] for r in rows]), np.uint8))
    one, half = span_hash(sums, at, at + SPAN), span_hash(sums, at, at + SPAN // 2)
    out = np.zeros(len(at), _WINDOW)
    out["w1"], out["w2"] = mix(one), mix(half * _K1 ^ one)
    for name, column in (("doc", "doc_id"), ("key", "key"), ("begin", "begin")):
        out[name] = np.repeat(np.array([r[column] for r in rows], _WINDOW[name]), counts)
    out["begin"] += within.astype(np.int32)
    return out


def _alike(windows: np.ndarray, keep_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, where equal windows begin in it, repeats as places in it).

    Equal windows follow each other by place. One that is at one place only, however
    often, is no repeat unless it is marked as many.
    """
    order = np.lexsort((windows["begin"], windows["key"], windows["doc"], windows["w2"],
                        windows["w1"]))
    sorted_ = windows[order]
    new = np.ones(len(order), bool)
    new[1:] = ((sorted_["w1"][1:] != sorted_["w1"][:-1])
               | (sorted_["w2"][1:] != sorted_["w2"][:-1]))
    first = np.flatnonzero(new)
    own = np.cumsum(new) - 1
    place = sorted_[["doc", "key", "begin"]]
    elsewhere = place != place[first][own]
    many = np.bincount(own, weights=elsewhere | (sorted_["many"] > 0),
                       minlength=len(first)) > 0
    return order, first, np.flatnonzero(many[own] & (elsewhere | (not keep_first)))


def _runs(windows: np.ndarray) -> np.ndarray:
    """Windows as stretches of their texts, those that touch joined."""
    windows = windows[np.lexsort((windows["begin"], windows["key"], windows["doc"]))]
    new = np.ones(len(windows), bool)
    new[1:] = ((windows["doc"][1:] != windows["doc"][:-1])
               | (windows["key"][1:] != windows["key"][:-1])
               | (windows["begin"][1:] - windows["begin"][:-1] > SPAN))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(windows) - 1) if len(windows) else []
    out = np.zeros(int(new.sum()), _HIT)
    for name in ("doc", "key", "begin"):
        out[name] = windows[name][new]
    out["end"] = windows["begin"][last] + SPAN if len(windows) else 0
    return out


def counted_windows(wide: DataFrame, keep_first: bool, buckets: int) -> DataFrame:
    """Repeats among surroundings of grams too common to be sorted in one task.

    Windows are counted where they are read: one entry is sent of those that are equal,
    with the first place and whether there are others, whose fate is decided by then.
    """

    def run(batch):
        for begin in range(0, batch.num_rows, COUNTED_ROWS):
            windows = windows_of(batch.slice(begin, COUNTED_ROWS).to_pylist())
            if not len(windows):
                continue
            order, first, repeats = _alike(windows, keep_first)
            sent = windows[order[first]]
            sent["many"] = np.diff(np.append(first, len(order))) > 1
            to = (sent["w1"] >> np.uint64(20)).astype(np.int64) % buckets
            sent, to = sent[np.argsort(to, kind="stable")], np.sort(to)
            found, begins = np.unique(to, return_index=True)
            blobs = [sent[a:b].tobytes() for a, b in zip(begins, np.append(begins[1:], len(to)))]
            # What is decided meets nothing; it goes with any of the rows.
            hits = [_runs(windows[order[repeats]]).tobytes()] + [None] * (len(blobs) - 1)
            yield {"bucket": pa.array(found, pa.int32()), "windows": pa.array(blobs, pa.binary()),
                   "hits": pa.array(hits, pa.binary())}

    def bucket(rows: pa.Table) -> pa.Table:
        windows = np.frombuffer(b"".join(rows.column("windows").to_pylist()), _WINDOW)
        order, _, repeats = _alike(windows, keep_first)
        hits = np.concatenate([_runs(windows[order[repeats]]), *[
            np.frombuffer(h, _HIT) for h in rows.column("hits").to_pylist() if h]])
        return pa.table({"doc_id": pa.array(hits["doc"]), "key": pa.array(hits["key"]),
                         "begin": pa.array(hits["begin"]), "end": pa.array(hits["end"])})

    posted = over_batches(wide.select("doc_id", "key", "begin", "bytes"), run,
                          "bucket int,windows binary,hits binary")
    return posted.groupBy("bucket").applyInArrow(bucket, _STRETCH)


# --- all together -----------------------------------------------------------------------

def _remove(data: bytes, stretches: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left)."""
    kept, removed, runs, at = [], 0, 0, 0
    end = -1
    for a, b in sorted(stretches):
        if a > end:
            runs += 1
            kept.append(data[at:a])
        if b > end:
            removed += b - max(a, end)
            end = at = b
    kept.append(data[at:])
    return removed, runs, b"".join(kept)


_RESULT = "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string,kept binary"


def suffix_dedup(docs: DataFrame, keep_first: bool = True, with_text: bool = True,
                 most: int = WIDE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``.

    ``kept`` are the remaining bytes; cuts may fall inside a character. ``most`` is the
    number of surroundings of one gram that a task sorts.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"), F.hash("text").alias("key"))
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size = size or 0
    buckets = 1 + int(size * 2 / (SPAN - GRAM + 1)) // BUCKET_ENTRIES
    # The more batches, the fewer entries of a gram each may keep to itself.
    few = min(most // 256, max(1, UNSEEN // (1 + rows // BATCH_ROWS)))
    posted = cut_lineage(entries(docs, buckets, keep_first, few), "entries")
    found = cut_lineage(meet(posted, buckets, keep_first, most), "repeats")

    stretch = F.struct("begin", "end")
    per_text = found.groupBy("doc_id", "key").agg(
        F.collect_list(F.when(F.col("at").isNull(), stretch)).alias("done"),
        F.collect_list(F.when(F.col("at").isNotNull(), F.struct(
            "gram", "begin", "end", "wide"))).alias("open"))
    joined = docs.join(per_text, ["doc_id", "key"], "left")
    # Rows: results of texts that are finished; texts that still wait; surroundings.
    staged = cut_lineage(_stage(joined, with_text), "staged")
    around = staged.where("kind = 2").select("doc_id", "key", "begin", "gram", "wide", "bytes")
    narrow = (around.where("NOT wide").repartition("gram")
              .sortWithinPartitions("gram", "doc_id", "key", "begin"))
    more = map_arrow(narrow, _sorted_groups(keep_first), _STRETCH)
    wide = around.where("wide")
    windows = wide.count() * (REACH + 1)
    if windows:
        more = more.unionByName(
            counted_windows(wide, keep_first, 1 + windows // BUCKET_WINDOWS))
    late = more.groupBy("doc_id", "key").agg(F.collect_list(stretch).alias("late"))
    waiting = (staged.where("kind = 1").select("doc_id", "key", "bytes", "done")
               .join(late, ["doc_id", "key"], "left"))

    def finish(batch):
        yield _results(batch.column("doc_id"), batch.column("bytes").to_pylist(), [
            _pairs(a) + _pairs(b) for a, b in zip(batch.column("done").to_pylist(),
                                                  batch.column("late").to_pylist())], with_text)

    names = [f.split()[0] for f in _RESULT.split(",")]
    result = staged.where("kind = 0").select(*names).unionByName(
        over_batches(waiting, finish, _RESULT)).withColumn(
        "doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
    return result if with_text else result.drop("kept")


def _pairs(stretches) -> list[tuple[int, int]]:
    return [(s["begin"], s["end"]) for s in stretches or ()]


def _results(ids, texts: list[bytes], stretches, with_text: bool) -> dict[str, pa.Array]:
    rows = [_remove(t, s) for t, s in zip(texts, stretches)]
    return {"doc_id": ids, "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array([r[0] for r in rows], pa.int64()),
            "n_spans": pa.array([r[1] for r in rows], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows],
                                    pa.string()),
            "kept": pa.array([r[2] if with_text else None for r in rows], pa.binary())}


_STAGED = ("kind int,key int,begin int,gram long,wide boolean,bytes binary,"
           "done array<struct<begin:int,end:int>>," + _RESULT)


def _stage(joined: DataFrame, with_text: bool) -> DataFrame:
    done_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    empty = {"key": pa.int32(), "begin": pa.int32(), "gram": pa.int64(), "wide": pa.bool_(),
             "bytes": pa.binary(), "done": done_type, "n_bytes": pa.int64(),
             "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(),
             "kept": pa.binary()}

    def rows(kind, n, **columns):
        return {"kind": pa.array(np.full(n, kind, np.int32)),
                **{c: pa.nulls(n, t) for c, t in empty.items() if c not in columns}, **columns}

    def run(batch):
        ids, keys = batch.column("doc_id"), batch.column("key")
        for begin, end in steps(batch.column("text"), 4 << 20):
            part = slice(begin, end)
            own = batch.slice(begin, end - begin)
            open_ = own.column("open").to_pylist()
            texts = [t.encode() for t in own.column("text").to_pylist()]
            done = own.column("done").to_pylist()
            now = [i for i, o in enumerate(open_) if not o]
            wait = [i for i, o in enumerate(open_) if o]
            pick = pa.array(now, pa.int64())
            yield rows(0, len(now), **_results(
                ids[part].take(pick), [texts[i] for i in now], [_pairs(done[i]) for i in now],
                with_text))
            if not wait:
                continue
            pick = pa.array(wait, pa.int64())
            yield rows(1, len(wait), doc_id=ids[part].take(pick), key=keys[part].take(pick),
                       bytes=pa.array([texts[i] for i in wait], pa.binary()),
                       done=own.column("done").take(pick).cast(done_type))
            around = [(i, s) for i in wait for s in open_[i]]
            pick = pa.array([i for i, _ in around], pa.int64())
            yield rows(
                2, len(around), doc_id=ids[part].take(pick), key=keys[part].take(pick),
                begin=pa.array([s["begin"] for _, s in around], pa.int32()),
                gram=pa.array([s["gram"] for _, s in around], pa.int64()),
                wide=pa.array([s["wide"] for _, s in around], pa.bool_()),
                bytes=pa.array([texts[i][s["begin"]:s["end"]] for i, s in around], pa.binary()))

    return over_batches(joined, run, _STAGED)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy goes, the first included."""
    return suffix_dedup(table(spark, sf_dir, "documents"), keep_first=False, with_text=False)
