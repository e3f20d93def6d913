"""Word sequences as flat arrays of 64-bit hashes.

Operators on word runs share this layout: an Arrow batch of texts becomes one array of word hashes and the offsets of
its documents, so runs, seeds and shingles of a whole batch are a few array operations without a loop over documents.
A word is a maximal run of letters and digits of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Texts are taken in slices of about this many bytes, which bounds the memory of the intermediate strings.
SLICE_BYTES = 4 << 20
#: Bits of a key that number the texts of a batch; the other 40 hold the hash.
OWNER_BITS = 24
#: Odd multiplier of the golden ratio for mixing (fixed value).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def picked(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``df`` by the hash of ``key``, all of them if there are no more, and never above twice as many.

    A threshold on the hash is applied where the rows are, so what reaches one place doesn't grow with the partitions.
    """
    n = df.count()
    if n <= most:
        return df
    share = int(most / n * (1 << 62)) * 2  # of the non-negative half of the hashes
    return df.where(F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1)) < share).limit(2 * most)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE_BYTES``; a single longer text is a range of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    done, n = 0, len(texts)
    ends = np.cumsum(size)
    while done < n:
        before = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield done, stop
        done = stop


def word_hashes(texts: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text begins among them (one more offset than texts).

    ``fold`` drops combining marks after canonical decomposition, so accents don't count. A null text has no words.
    """
    flat, bounds = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    start = 0
    for a, b in slices(texts):
        part = pc.utf8_lower(pc.fill_null(texts.slice(a, b - a), "").cast(pa.large_string()))
        if fold:
            part = pc.replace_substring_regex(pc.utf8_normalize(part, form="NFD"), pattern=r"\p{M}+", replacement="")
        lists = pc.split_pattern(pc.replace_substring_regex(part, pattern=r"[^\p{L}\p{N}]+", replacement=" "), " ")
        words = lists.flatten()
        real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = words.dictionary_encode()
        known = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False) if len(coded.dictionary) else np.empty(0, np.uint64)
        flat.append(known[coded.indices.to_numpy(zero_copy_only=False)[real]] if len(words) else np.empty(0, np.uint64))
        kept = np.concatenate([[0], np.cumsum(real)]).astype(np.int64)[at]
        bounds.append(kept[1:] + start)
        start += int(kept[-1])
    return np.concatenate(flat), np.concatenate(bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(flat: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within a text, and the number of its text."""
    sizes = np.maximum(np.diff(bounds) - n + 1, 0)
    if not sizes.sum():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    whole = np.zeros(len(flat) - n + 1, np.uint64)
    for k in range(n):
        whole = (whole + flat[k : len(flat) - n + 1 + k]) * GOLDEN
        whole ^= whole >> np.uint64(29)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[:-1], sizes)
    return mix(whole[at]), owner


def distinct_runs(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text in order of text, their texts, and how often each occurs.

    Keys hold the text in the high ``OWNER_BITS``, so one sort serves the batch. Always so many low bits of a hash are
    dropped, so a run has the same value in a batch of any size.
    """
    if texts >> OWNER_BITS:
        raise ValueError(f"a batch of {texts} texts: at most {1 << OWNER_BITS} can be told apart")
    bits = np.uint64(OWNER_BITS)
    keys = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    return keys << bits, (keys >> (np.uint64(64) - bits)).astype(np.int64), times
