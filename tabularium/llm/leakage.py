"""Problem 9: evaluation texts inside training text.

Spaced seeds: fixed masks over a window of words ignore some positions, so windows still meet when an ignored word was
substituted. Seeds of the test items are a small index; every training text is streamed past it once, and hits are
verified along their diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabularium.llm.words import GOLDEN, mix, word_hashes
from tabularium.sources.tables import table

#: Words of a window.
SPAN = 10
#: Masks over the window (1: the word counts). Each interior position is ignored by one of them (fixed values).
MASKS = ("1110010111", "1101101011", "1011111101")
#: Characters of test text indexed at a time; a larger test set is taken in as many passes as it needs.
BLOCK_CHARS = 20_000_000
#: Matches of seeds that are listed at a time, and words that are compared at a time.
MATCHES = 2_000_000


def _seeds(flat: np.ndarray, mask: str) -> np.ndarray:
    """Seed of the window at each position (garbage where a window crosses texts)."""
    n = len(flat) - SPAN + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = (out + flat[k : k + n]) * GOLDEN
            out ^= out >> np.uint64(31)
    return mix(out)


def _windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window that lies within one text, and the number of its text."""
    sizes = np.maximum(np.diff(bounds) - SPAN + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[:-1], sizes), owner


class SeedIndex:
    """Seeds of test items. Windows that an item repeats are kept once."""

    BITS = 22

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.flat, self.bounds = word_hashes(pa.array(texts, pa.string()), fold=True)
        at, owner = _windows(self.bounds)
        full = _seeds(self.flat, "1" * SPAN)[at] if len(at) else np.empty(0, np.uint64)
        keep = ~pd.DataFrame({"o": owner, "f": full}).duplicated().to_numpy()
        at, owner = at[keep], owner[keep]
        self.tables = []
        for m in MASKS:
            seeds = _seeds(self.flat, m)[at] if len(at) else np.empty(0, np.uint64)
            order = np.argsort(seeds, kind="stable")
            seen = np.zeros(1 << self.BITS, bool)
            seen[(seeds >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.tables.append((seeds[order], at[order], owner[order], seen))

    def hits(self, flat: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct (text, item, diagonal) on which some seed agrees, in blocks that don't share a text.

        A seed that stands in many items and texts gives many hits, so texts are taken in blocks of about ``MATCHES``
        matches, counted before any is listed; a text alone may exceed that.
        """
        at, owner = _windows(bounds)
        found = []
        for mask, (seeds, pos, items, seen) in zip(MASKS, self.tables):
            if len(at) and len(seeds):
                mine = _seeds(flat, mask)[at]
                near = np.flatnonzero(seen[(mine >> np.uint64(64 - self.BITS)).astype(np.int64)])
                lo, hi = np.searchsorted(seeds, mine[near], "left"), np.searchsorted(seeds, mine[near], "right")
                hit = hi > lo
                found.append((near[hit], lo[hi > lo], (hi - lo)[hit], pos, items))
        total = sum((np.bincount(owner[near], times, len(bounds) - 1) for near, _, times, _, _ in found), np.zeros(len(bounds) - 1))
        texts = np.flatnonzero(total)
        block = (np.cumsum(total[texts]) // MATCHES).astype(np.int64)
        for b in np.unique(block):
            first, last = texts[block == b][[0, -1]]
            parts = []
            for near, lo, times, pos, items in found:
                here = slice(np.searchsorted(owner[near], first, "left"), np.searchsorted(owner[near], last, "right"))
                left, k = np.repeat(near[here], times[here]), times[here]
                right = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[here], k)
                parts.append(pd.DataFrame({"doc": owner[left], "item": items[right], "diagonal": at[left] - pos[right]}))
            both = pd.concat(parts).drop_duplicates()
            yield both["doc"].to_numpy(np.int64), both["item"].to_numpy(np.int64), both["diagonal"].to_numpy(np.int64)

    def verify(self, flat: np.ndarray, bounds: np.ndarray, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hit the longest run of equal words on its diagonal, and the equal words in its best stretch (a
        difference costs three). All diagonals are laid end to end and walked at once, in blocks of words."""
        lo, hi = np.maximum(self.bounds[item], bounds[doc] - diagonal), np.minimum(self.bounds[item + 1], bounds[doc + 1] - diagonal)
        runs, overlaps = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        block = (np.cumsum(hi - lo) // MATCHES).astype(np.int64)
        for b in np.unique(block):
            a, n, d = lo[block == b], (hi - lo)[block == b], diagonal[block == b]
            start = np.cumsum(n) - n
            seg = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - start[seg] + a[seg]
            same = self.flat[at] == flat[at + d[seg]]
            index = np.arange(len(same))
            since = index - np.maximum.accumulate(np.where(same, np.maximum(start[seg] - 1, -1), index))  # words since the last difference
            runs.append(np.maximum.reduceat(np.where(same, since, 0), start))
            # each diagonal begins below all sums of the one before, so one running minimum serves all
            sums = np.cumsum(np.where(same, 1, -3))
            before = sums - np.where(same, 1, -3)
            base = before[start]
            fall = (4 * int(n.max()) + 4) * seg
            level, low = sums - base[seg] - fall, before - base[seg] - fall
            least = np.minimum.accumulate(low)
            began = np.maximum.accumulate(np.where(low == least, index, 0))
            rise = level - least
            top = np.maximum.reduceat(rise, start)
            end = np.minimum.reduceat(np.where(rise == top[seg], index, len(index)), start)
            equal = np.concatenate([[0], np.cumsum(same)])
            overlaps.append(equal[end + 1] - equal[began[end]])
        return np.concatenate(runs), np.concatenate(overlaps)


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(key, item, longest_run, overlap_words, item_words)`` of each document and item that share a seed.

    ``longest_run``: most consecutive words in common; ``overlap_words``: words in common in the best stretch that
    tolerates substitutions. Case and accents don't count. Null texts and texts under ten words have no seed. The test
    set is a stated query set: it is indexed in blocks of at most ``block_chars`` characters, each broadcast for one
    pass over the documents, which are neither shuffled nor compared with each other.
    """
    spark = docs.sparkSession
    size = items.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, ceil(size / block_chars))
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    out = None
    for b in range(blocks):
        rows = items.where(F.col(item_text).isNotNull() & (F.pmod(F.xxhash64(item), F.lit(blocks)) == b)).select(item, item_text).collect()
        shared = spark.sparkContext.broadcast(SeedIndex([r[0] for r in rows], [r[1] for r in rows]))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            sizes, ids = np.diff(index.bounds), pa.array(index.ids)
            for batch in batches:
                flat, bounds = word_hashes(batch.column(1), fold=True)
                for doc, it, diagonal in index.hits(flat, bounds):
                    run, overlap = index.verify(flat, bounds, doc, it, diagonal)
                    best = pd.DataFrame({"doc": doc, "item": it, "run": run, "overlap": overlap}).groupby(["doc", "item"], as_index=False).max()
                    doc, it = best["doc"].to_numpy(np.int64), best["item"].to_numpy(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(doc)), ids.take(pa.array(it)), pa.array(best["run"], pa.int32()), pa.array(best["overlap"], pa.int32()), pa.array(sizes[it], pa.int32())],
                        names=["_doc", "_item", "longest_run", "overlap_words", "item_words"],
                    )

        part = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).mapInArrow(scan, f"_doc {kinds[0]}, _item {kinds[1]}, longest_run int, overlap_words int, item_words int")
        out = part if out is None else out.unionAll(part)
    return out.withColumnsRenamed({"_doc": key, "_item": item})


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaks(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_item"), "item_id", "text")


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    """Overlaps of at least ten words, substitutions tolerated, with their share of the item."""
    return _leaks(spark, root).where(F.col("overlap_words") >= SPAN).withColumn("item_share", F.round(F.col("overlap_words") / F.col("item_words"), 6))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).where(F.col("longest_run") >= SPAN).select("doc_id", "item_id")


_FOUND_SQL = r"""
WITH t AS (SELECT 'd' k, doc_id id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_item),
w AS (SELECT k, id, regexp_extract_all(regexp_replace(strip_accents(lower(text)), '\p{M}+', '', 'g'), '[\p{L}\p{N}]+') w FROM t),
g AS (SELECT DISTINCT k, id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) g FROM w WHERE len(w) >= 10)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i USING (g) WHERE d.k = 'd' AND i.k = 'i'
"""
QUERIES = {"p9_found": p9_found, "p9_report": p9_report}
ORACLES = {"p9_found": _FOUND_SQL}
