"""Reading tables, Arrow helpers and hashed words shared by the text operators."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step holds; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most ``rows`` rows, chosen evenly by a hash of the columns ``by``.

    All rows if they are no more than that; else a little fewer, so that no
    task ever gathers more than the sample.
    """
    n = df.count()
    if n <= rows:
        return df
    share = int(2**30 * 0.95 * rows / n)
    return df.where(F.pmod(F.xxhash64(*by), F.lit(2**30)) < share).limit(rows)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        path = f"{tempfile.mkdtemp()}/{root.name}.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in root.rglob("*.py"):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)


#: What a worker keeps from task to task, by the name of what keeps it.
kept: dict[str, dict] = {}


def map_arrow(df: DataFrame, run: Callable, schema: str, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` with this library at hand on the workers.

    Workers are shared by all that an application runs, so a task drops what tasks of
    another kind left in ``kept``; ``keeps`` names what this one uses.
    """
    ship(df.sparkSession)

    def mapped(batches):
        from feefloor.llm import common  # the worker's own, not a copy sent with this

        if common.drop_kept(keeps):
            release()
        yield from run(batches)
        release()

    return df.mapInArrow(mapped, schema)


def drop_kept(but: str | None) -> bool:
    """Empty ``kept`` but for one name; whether there was anything to drop."""
    others = [name for name, held in kept.items() if name != but and held]
    for name in others:
        kept[name].clear()
    return bool(others)


def release() -> None:
    """Give memory back, tables of powers included: a worker stays for later tasks, which
    need not add theirs to the most that earlier ones held."""
    _tables.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def over_batches(df: DataFrame, run: Callable[[pa.RecordBatch], Iterator[dict]],
                 schema: str, keeps: str | None = None) -> DataFrame:
    """``run`` maps an Arrow batch to any number of column dicts of ``schema``."""
    names = T.StructType.fromDDL(schema).names

    def mapped(batches):
        for batch in batches:
            for columns in run(batch):
                yield pa.RecordBatch.from_arrays([_array(columns[n]) for n in names], names)

    return map_arrow(df, mapped, schema, keeps)


def blocks_met(rows: DataFrame, asked: DataFrame, blocks: int, sets: int, run: Callable,
               schema: str) -> DataFrame:
    """``run`` (rows, asked) of every block of ``rows`` with every set of ``asked``.

    A stated query set meets all rows, in blocks: both are dealt evenly by a hash of
    their column ``at``, which is different in each row, so no task holds more than
    one block and one set whatever else repeats.
    """
    ship(rows.sparkSession)

    def all_of(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n):
        return F.pmod(F.xxhash64("at"), F.lit(n)).cast("int")

    left = rows.withColumn("block", dealt(blocks)).withColumn("asked_set", all_of(sets))
    right = asked.withColumn("asked_set", dealt(sets)).withColumn("block", all_of(blocks))
    return left.groupBy("block", "asked_set").cogroup(
        right.groupBy("block", "asked_set")).applyInArrow(run, schema)


def _array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of a single row."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    begin, done = 0, 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield begin, end
        begin, done = end, int(ends[end - 1])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and each text's start (and the last end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    data = (np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if size
            else np.empty(0, np.uint8))
    return data, offsets - offsets[0]


# Seeded once, so every task of every run hashes alike.
_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 2**64, 256, np.uint64, endpoint=False)
_BASE = int(_RNG.integers(0, 2**62)) * 2 + 1
_PLACE = _RNG.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2^64, and of its inverse."""
    if len(_tables.get("up", ())) < max(n, 1):
        size = max(n, STEP_BYTES + 1)
        _tables["up"] = _powers(_BASE, size)
        _tables["down"] = _powers(pow(_BASE, -1, 2**64), size)
    return _tables["up"][:n], _tables["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any stretch of ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data))[0], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[begin]) * powers(len(sums))[1][begin]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts in order as (starts, ends, first).

    Word k spans bytes starts[k] to ends[k], and text i has words first[i] to
    first[i + 1]. ``separator`` says which bytes stand between words; by default
    white space from tab to carriage return and the space.
    """
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_sums(data: np.ndarray) -> np.ndarray:
    """``prefix_hash`` of the bytes with A-Z in lower case."""
    return prefix_hash(_LOWER[data])


def hashed_words(data: np.ndarray, offsets: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z in lower case, and ``word_spans``."""
    starts, ends, first = word_spans(data, offsets)
    return mix(span_hash(lower_sums(data), starts, ends)), starts, ends, first


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word shingles of every text: (hashes, their text, their first word).

    A text with fewer words than ``size`` but at least one has its whole
    sequence as its only shingle. Repeats are kept.
    """
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = max(len(words) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += words[j:j + n] * _PLACE[j]
    whole = owner[:n] == owner[size - 1:size - 1 + n]
    at = np.flatnonzero(whole)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = counts[short] > j
            own[has] += words[first[short[has]] + j] * _PLACE[j]
        own += counts[short].astype(np.uint64) * _PLACE[size + 1]
        at = np.concatenate([at, first[short]])
        hashes = np.concatenate([total[whole], own])
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
    else:
        hashes = total[whole]
    return mix(hashes), owner[at], at


def hashed_shingles(texts: pa.Array, size: int = 5):
    """As ``shingles``, straight from texts; also the word spans."""
    data, offsets = raw(texts)
    words, starts, ends, first = hashed_words(data, offsets)
    hashes, owner, at = shingles(words, first, size)
    return hashes, owner, at, starts, ends, first
