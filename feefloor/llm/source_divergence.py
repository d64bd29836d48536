"""How far each source's words lie from other sources and from its language.

In-mapper stripes: a task folds whole documents into hash tables, term to document
frequency and counts by source, and spills them as stripes, one row for each
language and term, whenever they hold ``SPILL`` entries. Stripes of a term meet by
key in one shuffle and are merged as they arrive in order, so nothing of a language
or a source comes together: only its stripes, at most one a spill, whatever share of
the documents it has. Terms in fewer than ``MIN_DOCS`` documents of their language
go. The merged stripes, with the totals of each source, directly give every
divergence: a task adds up the pairs of sources over its terms and keeps its best
terms of each source, so only sums and tops are shuffled again.

For a group, a source of a language or the language itself, with N occurrences of
the language's V kept terms, a term with n of them has the share
p = 1 + floor(10^9 (n + 1) / (N + V)), and p lies from q by floor((p - q)^2 / q).
All of it is in whole numbers; a quotient is taken three digits at a time, so
10^9 n never overflows.

Rows: ``pair``, every other source of the language with its divergence summed over
the kept terms, and ``term``, the first ``TOP`` terms that a source has more of than
its language. A null text, language or source is ''. A text without terms, however
many rows repeat it, still makes its group occur. A language without kept terms has
pairs of value 0 and no terms. An empty table has no rows. A very long text is cut
between words and folded piece by piece; columns other than text, lang and source
are not read. A task holds a table of a language's sources by its sources, as the result
does, and the driver learns the totals of each source, as many rows as the
sources that the result pairs with each other.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feefloor.llm.common import map_arrow, table
from feefloor.session import cut_lineage

MIN_DOCS = 3
TOP = 200
SCALE_STEPS = 3  # 10^9, three digits at a time
#: Entries of the hash tables of a task before they are spilled.
SPILL = 500_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Cells of a table of terms by sources that a task holds at once.
CELLS = 1 << 20
#: Parts of a source's terms that are ranked apart before they meet.
SLICES = 32

# Letters A-Z become small ones, and whatever ends a term becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))
_STRIPE = "lang string,term string,docs long,sources array<string>,counts array<long>"


def _pieces(text: str):
    """Lists of terms of a text, ``PIECE`` bytes or so at a time."""
    data = text.encode("utf-8", "replace").translate(_FOLD)
    if len(data) <= PIECE:
        yield data.split()
        return
    begin = 0
    while begin < len(data):
        end = data.find(b" ", begin + PIECE)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def stripes(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """(lang, term, docs, sources, counts) of each spill, and one row with a null term
    for the sources of each language that a task has met."""

    def run(batches):
        groups, size = defaultdict(set), 0
        frequency, counts = defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("text", "lang", "source")]
            for text, lang, source in zip(*columns):
                text, lang, source = text or "", lang or "", source or ""
                groups[lang].add(source)
                own, among = frequency[lang], counts[lang, source]
                before, seen = len(own) + len(among), set()
                for words in _pieces(text):
                    among.update(words)
                    seen.update(words)
                own.update(seen)
                size += len(own) + len(among) - before
                if size >= spill:
                    yield from _spilled(frequency, counts)
                    frequency.clear()
                    counts.clear()
                    size = 0
        yield from _spilled(frequency, counts)
        for lang, sources in groups.items():
            names = sorted(sources)
            yield _stripe_rows(lang, [None], [0], np.array([0, len(names)]), names,
                               np.zeros(len(names), np.int64))

    text = docs.select("text", "lang", "source")
    return map_arrow(text, run, _STRIPE)


def _spilled(frequency: dict, counts: dict):
    by_lang = defaultdict(list)
    for (lang, source), among in counts.items():
        if among:
            by_lang[lang].append((source, among))
    for lang, own in frequency.items():
        if not own:
            continue
        place = {term: i for i, term in enumerate(own)}
        at = np.concatenate([np.fromiter((place[t] for t in among), np.int64, len(among))
                             for _, among in by_lang[lang]])
        n = np.concatenate([np.fromiter(among.values(), np.int64, len(among))
                            for _, among in by_lang[lang]])
        code = np.repeat(np.arange(len(by_lang[lang])), [len(a) for _, a in by_lang[lang]])
        order = np.argsort(at, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(own)))])
        names = pa.DictionaryArray.from_arrays(
            pa.array(code[order], pa.int32()),
            pa.array([s for s, _ in by_lang[lang]], pa.string())).dictionary_decode()
        yield _stripe_rows(lang, [t.decode() for t in own], list(own.values()), ends, names,
                           n[order])


def _stripe_rows(lang, terms, docs, ends, sources, counts) -> pa.RecordBatch:
    ends = pa.array(ends, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.string()),
         pa.array(docs, pa.int64()),
         pa.ListArray.from_arrays(ends, sources if isinstance(sources, pa.Array)
                                  else pa.array(sources, pa.string())),
         pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))],
        ["lang", "term", "docs", "sources", "counts"])


def merged(spilled: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One stripe for each language and kept term, and one with a null term for the
    sources of a language."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            rows = rows.combine_chunks()
            new = _key_starts(rows)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield _merged_rows(rows.slice(0, last).combine_chunks(), min_docs)
            held = rows.slice(last)
        if held is not None:
            yield _merged_rows(held.combine_chunks(), min_docs)

    return map_arrow(spilled.repartition("lang", "term").sortWithinPartitions("lang", "term"),
                     run, _STRIPE)


def _codes(column) -> np.ndarray:
    """A number for each value, a null too."""
    column = column if isinstance(column, pa.Array) else column.combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _key_starts(rows: pa.Table) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    lang, term = _codes(rows["lang"]), _codes(rows["term"])
    new[1:] = (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])
    return new


def _flat(column) -> tuple[np.ndarray, pa.Array]:
    """(length of each list, all their values)."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return np.diff(column.offsets.to_numpy()), column.flatten()


def _merged_rows(rows: pa.Table, min_docs: int) -> pa.RecordBatch:
    new = _key_starts(rows)
    key, first = np.cumsum(new) - 1, np.flatnonzero(new)
    docs = np.bincount(key, rows["docs"].to_numpy()).astype(np.int64)
    lengths, sources = _flat(rows["sources"])
    _, counts = _flat(rows["counts"])
    names = sources.dictionary_encode()
    width = max(len(names.dictionary), 1)
    cell = np.repeat(key, lengths) * width + names.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(cell, kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)) if len(cell) else order
    total = np.add.reduceat(counts.to_numpy()[order], begin) if len(cell) else order
    cell = cell[order][begin]
    terms = rows["term"].take(pa.array(first))
    kept = (docs >= min_docs) | terms.is_null().to_numpy()
    stay = kept[cell // width]
    cell, total = cell[stay], total[stay]
    ends = np.concatenate([[0], np.cumsum(np.bincount(cell // width, minlength=len(first))[kept])])
    of_kept = pa.array(first[kept])
    column = pa.array(cell % width, pa.int32())
    return pa.RecordBatch.from_arrays(
        [_whole(rows["lang"].take(of_kept)), _whole(rows["term"].take(of_kept)),
         pa.array(docs[kept]),
         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.dictionary.take(column)),
         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(total, pa.int64()))],
        ["lang", "term", "docs", "sources", "counts"])


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 n / total), exactly; n is at most ``total``."""
    rest, out = np.asarray(n, np.int64), np.int64(0)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def divergences(kept: DataFrame, totals: dict, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value): sums over a task's terms, and its best terms.

    ``totals``: language to (names of its sources, their N, V).
    """

    def run(batches):
        sums = {}
        best = defaultdict(lambda: ([], []))
        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            for lang in dict.fromkeys(langs):
                names, _, _ = totals[lang]
                own = np.flatnonzero(langs == lang)
                step = max(1, CELLS // len(names))
                for i in range(0, len(own), step):
                    part = batch.take(pa.array(own[i:i + step]))
                    _pairs_and_terms(part, lang, totals[lang], sums, best, top)
        yield from _rows_of(sums, best, totals, top)

    return map_arrow(kept, run, "lang string,source string,part string,item string,value long")


def _pairs_and_terms(part, lang, total, sums, best, top) -> None:
    names, occurrences, terms_kept = total
    lengths, sources = _flat(part.column("sources"))
    _, counts = _flat(part.column("counts"))
    column = {s: i for i, s in enumerate(names)}
    coded = sources.dictionary_encode()
    places = np.array([column[s] for s in coded.dictionary.to_pylist()], np.int64)
    table = np.zeros((part.num_rows, len(names)), np.int64)
    table[np.repeat(np.arange(part.num_rows), lengths),
          places[coded.indices.to_numpy(zero_copy_only=False)]] = counts.to_numpy()
    p = share(table + 1, occurrences + terms_kept)
    q = share(table.sum(axis=1) + 1, occurrences.sum() + terms_kept)[:, None]
    own = sums.setdefault(lang, np.zeros((len(names), len(names)), np.int64))
    for a in range(len(names)):
        own[a] += distance(p[:, a:a + 1], p).sum(axis=0)
    value = distance(p, q)
    ahead = (table > 0) & (p > q)
    words = part.column("term").to_pylist()
    for a in np.flatnonzero(ahead.any(axis=0)):
        at = np.flatnonzero(ahead[:, a])
        values, terms = best[lang, names[a]]
        values.extend(value[at, a].tolist())
        terms.extend(words[i] for i in at)
        if len(values) > 8 * top:
            best[lang, names[a]] = _first(values, terms, top)


def _first(values: list, terms: list, top: int) -> tuple[list, list]:
    order = sorted(range(len(values)), key=lambda i: (-values[i], terms[i]))[:top]
    return [values[i] for i in order], [terms[i] for i in order]


def _rows_of(sums, best, totals, top):
    for lang, matrix in sums.items():
        names = totals[lang][0]
        a, b = np.nonzero(~np.eye(len(names), dtype=bool))
        yield _result_rows(lang, [names[i] for i in a], "pair", [names[i] for i in b],
                           matrix[a, b])
    for (lang, source), (values, terms) in best.items():
        values, terms = _first(values, terms, top)
        yield _result_rows(lang, [source] * len(terms), "term", terms, values)


def _result_rows(lang, sources, part, items, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(sources), pa.string()), pa.array(sources, pa.string()),
         pa.array([part] * len(sources), pa.string()), pa.array(items, pa.string()),
         pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])


def group_totals(kept: DataFrame) -> DataFrame:
    """(lang, source, n, terms): N of every group that occurs, and V of its language."""
    cells = kept.select("lang", F.inline(F.arrays_zip("sources", "counts")))
    n = cells.groupBy("lang", F.col("sources").alias("source")).agg(
        F.sum("counts").cast("long").alias("n"))
    return n.join(kept.groupBy("lang").agg(F.count("term").alias("terms")), "lang")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP,
                      spill: int = SPILL) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of ``docs``."""
    kept = cut_lineage(merged(stripes(docs, spill), min_docs), "stripes")
    groups = cut_lineage(group_totals(kept), "source-totals")
    totals = {}
    for row in groups.orderBy("lang", "source").collect():  # a row for each source
        names, n, _ = totals.setdefault(row["lang"], ([], [], row["terms"]))
        names.append(row["source"])
        n.append(row["n"])
    totals = {lang: (names, np.array(n, np.int64), v) for lang, (names, n, v) in totals.items()}
    found = cut_lineage(divergences(kept.where("term IS NOT NULL"), totals, top), "divergences")

    key = ["lang", "source", "item"]
    sums = (found.where("part = 'pair'").groupBy(*key)
            .agg(F.sum("value").cast("long").alias("value")))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = (groups.select("lang", "source").join(others, "lang").where("source <> item")
             .join(sums, key, "left").withColumn("value", F.coalesce("value", F.lit(0))))
    order = (F.desc("value"), "item")
    place = F.row_number()
    group = W.partitionBy("lang", "source").orderBy(*order)
    a_slice = W.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SLICES))
                            ).orderBy(*order)
    terms = (found.where("part = 'term'")
             .withColumn("rank", place.over(a_slice)).where(F.col("rank") <= top)
             .withColumn("rank", place.over(group)).where(F.col("rank") <= top))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return (pairs.withColumn("part", F.lit("pair")).withColumn("rank", place.over(group))
            .select(*columns).unionByName(terms.select(*columns)))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT lang, source, k, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
cells AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source),
p AS (SELECT lang, source, term, n,
    1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (total + v) AS p
  FROM cells JOIN totals USING (lang, source) JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (total + v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term)
  JOIN (SELECT lang, sum(n) AS total FROM cells GROUP BY lang) USING (lang)
  JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item,
    sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT)
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part
  ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
