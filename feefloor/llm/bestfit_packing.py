"""Packing of tokenised documents into sequences by bin completion.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so
the search runs over a histogram: at most 4,096 rows however many documents
there are. Bin completion builds one sequence at a time around the largest piece
left, enumerating the undominated fillings of the room beside it, and uses each
chosen filling as often as the histogram allows. Where neither that nor best fit
meets the lower bound, branch and bound goes back over the choices. Documents are
then dealt to
the places of the plan by their rank among pieces of the same length: a join, no
single task, and no place left over.

Each document's ids are followed by the end id; a document longer than a
sequence is cut into full pieces and one last shorter piece, no other is cut. A
null or empty text is the end id alone. Rows that share a doc_id are told apart
by their content; fully equal rows are packed one by one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feefloor.llm.common import over_batches, steps, table
from feefloor.llm.encoding import KEPT, encoder
from feefloor.session import cut_lineage

CAPACITY = 4096
END_ID = 1
#: Ranks within one length are counted in so many slices, whatever the length's share.
SLICES = 256
#: Nodes of the branch and bound, after which the best plan so far stands without proof.
NODES = 20_000
#: First companions of a piece that one of the incumbents chooses from.
NEAR = 24

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``PIECES``: every document's ids and end id, cut to ``capacity``."""

    def run(batch):
        coder = encoder(path, "ids", lambda ids: np.asarray(ids, "<u4").tobytes())
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "crc")}
        end, step = np.uint32(END_ID).tobytes(), 4 * capacity
        docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for first, last in steps(texts):
            for doc, text in zip(docs[first:last], texts[first:last].to_pylist()):
                ids = b"".join([b"".join(part) for part in coder.parts(text or "")]) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at:at + step]
                    row = (doc, k, at // 4, len(cut) // 4, zlib.crc32(cut))
                    for column, value in zip(out.values(), row):
                        column.append(value)
        yield {"doc_id": pa.array(out["doc_id"], pa.int64()),
               "piece": pa.array(out["piece"], pa.int32()),
               "start": pa.array(out["start"], pa.int64()),
               "length": pa.array(out["length"], pa.int64()),
               "ids_crc32": pa.array(out["crc"], pa.int64())}

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES, KEPT)


# --- the search over lengths ----------------------------------------------

def fillings(sizes: list[int], counts: Counter, room: int, allowed: int
             ) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of ``room`` as (waste, sizes), least waste and larger sizes first.

    ``sizes`` is in falling order. A table of the sums that the smaller sizes reach
    leads the walk, so it takes no step that ends in no filling and leaves none
    out. A filling is dominated if another piece fits into its waste, or a larger
    one in place of one of its pieces. Fillings that waste more than ``allowed`` are
    pruned.
    """
    fit = [s for s in sizes[_first_fitting(sizes, room, 0):] if counts[s]]
    most = [min(counts[s], room // s) for s in fit]
    reach = [1] * (len(fit) + 1)
    inside = (1 << (room + 1)) - 1
    for k in range(len(fit) - 1, -1, -1):
        sums, left, step = reach[k + 1], most[k], 1
        while left:
            step = min(step, left)
            sums |= sums << (step * fit[k])
            left -= step
            step *= 2
        reach[k] = sums & inside
    for waste in range(min(allowed, room) + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        stack = [(0, room - waste, ())]
        while stack:
            k, left, chosen = stack.pop()
            if left:
                # Smaller sizes only, once neither more of this one nor a choice is left.
                k = max(k, _first_fitting(fit, left, k))
                options = [n for n in range(min(most[k], left // fit[k]) + 1)
                           if reach[k + 1] >> (left - n * fit[k]) & 1]
                stack += [(k + 1, left - n * fit[k], chosen + (fit[k],) * n) for n in options]
                continue
            used = Counter(chosen)
            fits = any(counts[s] > used[s] for s in fit[_first_fitting(fit, waste, 0):])
            if not fits and not _dominated(chosen, used, counts, fit, waste):
                yield waste, chosen


def _first_fitting(sizes: list[int], room: int, begin: int) -> int:
    """First index from ``begin`` whose size is at most ``room``; sizes fall."""
    low, high = begin, len(sizes)
    while low < high:
        mid = (low + high) // 2
        if sizes[mid] > room:
            low = mid + 1
        else:
            high = mid
    return low


def _dominated(chosen, used, counts, sizes, waste) -> bool:
    for s in used:
        k = _first_fitting(sizes, s + waste, 0)
        if k < len(sizes) and sizes[k] > s and counts[sizes[k]] > used[sizes[k]]:
            return True
    return False


def best_fit(histogram: Counter, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, largest first: the incumbent. Bins as (how often, sizes).

    Equal pieces go into equal bins together, so the work follows the number of
    lengths and not of pieces: the tightest bin that fits stays the tightest until
    it is full.
    """
    by_room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0

    def put(often: int, sizes: tuple[int, ...], room: int) -> None:
        nonlocal open_rooms
        by_room[room].append((often, sizes))
        open_rooms |= 1 << room

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            fitting = open_rooms >> size
            room, have, sizes = capacity, left, ()
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                have, sizes = by_room[room].pop()
                if not by_room[room]:
                    open_rooms &= ~(1 << room)
            each = min(room // size, left)
            often = min(have, left // each)
            put(often, sizes + (size,) * each, room - each * size)
            if sizes and have > often:
                put(have - often, sizes, room)
            left -= often * each
    return [b for bins in by_room for b in bins]


def lower_bound(histogram: Counter, capacity: int) -> int:
    """Bins that no packing can do without.

    For each threshold t: pieces over capacity - t share a bin with none of at
    least t, and what the pieces of t to half need beyond the room left beside
    pieces over half needs bins of its own.
    """
    n = np.zeros(capacity + 1, np.int64)
    for size, count in histogram.items():
        n[size] = count
    amount = np.cumsum(n * np.arange(capacity + 1))
    count = np.cumsum(n)
    half = capacity // 2
    t = np.arange(half + 1)
    big = count[-1] - count[capacity - t]
    mid = count[capacity - t] - count[half]
    room = mid * capacity - (amount[capacity - t] - amount[half])
    small = amount[half] - np.where(t > 0, amount[t - 1], 0)
    needed = big + mid + np.maximum(0, -(-(small - room) // capacity))
    return max(-(-int(amount[-1]) // capacity), int(needed.max()))


def completed(left: Counter, capacity: int, near: int = 0) -> list[tuple[int, tuple[int, ...]]]:
    """The largest size left is completed with least waste, as often as the counts allow.

    With ``near``, its first companion is one of the so many largest that fit, which
    spares small pieces for later; the plan is one more incumbent.
    """
    left, bins = Counter(left), []
    sizes = sorted(left, reverse=True)
    while sizes:
        top = sizes[0]
        left[top] -= 1
        room = capacity - top
        fit = [s for s in sizes[_first_fitting(sizes, room, 0):] if left[s]]
        best = None
        for s in fit[:near]:
            left[s] -= 1
            smaller = sizes[_first_fitting(sizes, s, 0):]
            found = next(fillings(smaller, left, room - s, room - s), None)
            left[s] += 1
            if found and (best is None or found[0] < best[0]):
                best = found[0], (s, *found[1])
                if not best[0]:
                    break
        if best is None:
            best = next(fillings(sizes, left, room, room))
        left[top] += 1
        often = _take(left, (top, *best[1]))
        bins.append((often, (top, *best[1])))
        sizes = [s for s in sizes if left[s]]
    return bins


def _take(left: Counter, sizes: tuple[int, ...], often: int = 0) -> int:
    """Take ``sizes`` from the counts so often, or as often as there are enough."""
    uses = Counter(sizes)
    often = often or min(left[s] // k for s, k in uses.items())
    for s, k in uses.items():
        left[s] -= often * k
    return often


def branch(histogram: Counter, capacity: int, best: list[tuple[int, tuple[int, ...]]],
           nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """Branch and bound over (filling of the largest piece left, how often).

    Never worse than ``best``. Fillings are pruned by the waste that one bin fewer
    than the best would have to spare. It ends with a plan that meets the bound,
    with the proof that none is better, or after so many nodes without a proof.
    """
    fewest, bound = sum(k for k, _ in best), lower_bound(histogram, capacity)
    everything = sum(s * c for s, c in histogram.items())
    left, done, n_done, wasted = Counter(histogram), [], 0, 0

    def choices() -> Iterator[tuple[int, int, tuple[int, ...]]]:
        sizes = sorted((s for s in left if left[s]), reverse=True)
        top = sizes[0]
        rest = Counter(left)
        rest[top] -= 1
        allowed = (fewest - 1) * capacity - everything - wasted
        for waste, filling in fillings(sizes, rest, capacity - top, allowed):
            uses = Counter((top, *filling))
            often = min(left[s] // k for s, k in uses.items())
            if waste:
                often = min(often, allowed // waste)
            for n in range(often, 0, -1):
                yield n, waste, (top, *filling)

    stack = [choices()] if fewest > bound else []
    while stack and nodes:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if done:
                often, waste, sizes = done.pop()
                _take(left, sizes, -often)
                n_done, wasted = n_done - often, wasted - often * waste
            continue
        nodes -= 1
        often, waste, sizes = step
        _take(left, sizes, often)
        done.append(step)
        n_done, wasted = n_done + often, wasted + often * waste
        if not any(left.values()) and n_done < fewest:
            best, fewest = [(k, b) for k, _, b in done], n_done
            if fewest == bound:
                break
        if n_done + lower_bound(left, capacity) < fewest:
            stack.append(choices())
        else:
            done.pop()
            _take(left, sizes, -often)
            n_done, wasted = n_done - often, wasted - often * waste
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Bins as (how often, sizes), at every size of the table by the same steps.

    Best fit and the completion of the largest piece with least waste are the
    incumbents; if both miss the bound, the branch and bound starts from the better.
    """
    whole = Counter({int(s): int(c) for s, c in histogram.items() if c})
    best = best_fit(whole, capacity)
    if sum(k for k, _ in best) > lower_bound(whole, capacity):
        best = min(best, completed(whole, capacity), completed(whole, capacity, NEAR),
                   key=lambda bins: sum(k for k, _ in bins))
    return branch(whole, capacity, best)


# --- dealing pieces to places ----------------------------------------------

def places(bins: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies, offset) of each stretch."""
    out, taken, sequence = [], Counter(), 0
    for often, sizes in bins:
        at = 0
        for size, copies in Counter(sizes).items():
            out.append((size, taken[size], taken[size] + often * copies, sequence, copies, at))
            taken[size] += often * copies
            at += size * copies
        sequence += often
    return out


def ranked(cut: DataFrame) -> DataFrame:
    """``cut`` with ``rank`` from 0 among pieces of equal length.

    A length's pieces are counted in slices by a hash of the document, so that
    a length shared by most pieces is still ranked by many tasks.
    """
    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)))
    before = (sliced.groupBy("length", "slice").count()
              .withColumn("before", F.sum("count").over(
                  W.partitionBy("length").orderBy("slice")) - F.col("count"))
              .drop("count"))
    own = F.row_number().over(W.partitionBy("length", "slice").orderBy(
        "doc_id", "piece", "ids_crc32"))
    return (sliced.withColumn("own", own).join(before, ["length", "slice"])
            .withColumn("rank", F.col("before") + F.col("own") - 1)
            .drop("own", "before", "slice"))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (``PIECES``) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    # One row a length: at most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["n"] for r in
                 cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    stretches = spark.createDataFrame(
        places(plan(histogram, capacity)),
        "length long, low long, high long, base long, copies long, at long")
    # A stretch ends a length's count or halves it, so there are a few for each
    # of the at most ``capacity`` lengths.
    return (ranked(cut).join(F.broadcast(stretches), "length")
            .where("rank >= low AND rank < high")
            .withColumns({
                "sequence_id": F.expr("base + (rank - low) DIV copies"),
                "offset": F.expr("at + pmod(rank - low, copies) * length")})
            .drop("rank", "low", "high", "base", "copies", "at"))


def bestfit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut_lineage(pieces(docs, path, capacity), "pieces"), capacity)


def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing(table(spark, sf_dir, "documents"),
                           public_tokenizers.path("word_bpe_49k.json"))
