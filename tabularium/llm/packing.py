"""Problem 8: fill containers of fixed capacity with texts measured in tokens.

Tokens are counted in one pass. What the packer then sees is the histogram of lengths, which has at most as many rows
as the capacity, whatever the corpus: exact-complement hashing looks up single, pair and triple sums that fill a gap
exactly under the counts that are left; gaps without one take the largest length that fits. Each step fixes a pattern
for as many containers as the counts allow, so the plan is bounded too. Items find their container by their rank
within their length, counted in salted groups.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from tabularium.llm.words import slices
from tabularium.plans.staging import staged
from tabularium.sources.tables import table

#: Vocabulary of a public tokenizer; read on the driver and broadcast.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's tokenizer cuts text before merging (fixed value).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as it understands it, and a blank beside other white space, where a blank alone is no boundary.
_WHITE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_BESIDE = f"[{_WHITE}] | [{_WHITE}]"


class TokenCounter:
    """Token counts equal to encoding each text, at the price of encoding each distinct chunk between blanks once.

    A blank between two characters that are no white space always begins a pre-token, so such chunks are counted on
    their own with the blank before them. Texts with a blank beside other white space are encoded whole.
    """

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("counter", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, tuple[int, int]] = {}

    def size(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def _one(self, chunk: str) -> tuple[int, int]:
        got = self.known.get(chunk)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.size(chunk), self.size(" " + chunk)
            if len(chunk) < 64:
                self.known[chunk] = got
        return got

    def count(self, texts: pa.Array) -> np.ndarray:
        out = [np.empty(0, np.int64)]
        for a, b in slices(texts):
            part = pc.fill_null(texts.slice(a, b - a), "").cast(pa.large_string())
            whole = pc.match_substring_regex(part, _BESIDE).to_numpy(zero_copy_only=False)
            counts = np.zeros(b - a, np.int64)
            for i in np.flatnonzero(whole):
                counts[i] = self.size(part[int(i)].as_py())
            plain = np.flatnonzero(~whole)
            if len(plain):
                lists = pc.split_pattern(part.take(pa.array(plain)), " ")
                coded = lists.flatten().dictionary_encode()
                sizes = np.array([self._one(x) for x in coded.dictionary.to_pylist()], np.int64)
                at = coded.indices.to_numpy(zero_copy_only=False)
                ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                first = np.concatenate([[0], ends[:-1]])
                each = sizes[at, 1]
                each[first] = sizes[at[first], 0]
                total = np.concatenate([[0], np.cumsum(each)])
                counts[plain] = total[ends] - total[first]
            out.append(counts)
        return np.concatenate(out)


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, n_tokens)`` of each row; null and empty texts have 0."""
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.count(batch.column(1)))], names=["_key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(count, f"_key {kind}, n_tokens bigint").withColumnRenamed("_key", key)


class ComplementIndex:
    """Lengths that are left, with exact single, pair and triple sums."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def largest(self, most: int, used: Counter) -> int:
        for length in np.flatnonzero(self.left[: most + 1])[::-1]:
            if self.left[length] > used[int(length)]:
                return int(length)
        return 0

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """Lengths that sum to ``gap``; large ones are preferred, as small ones fill later gaps more easily."""
        if gap <= 0:
            return None
        free = self.left[: gap + 1].copy()
        for length, n in used.items():
            if length <= gap:
                free[length] -= n
        if free[gap] > 0:
            return (gap,)

        def pair(total: int) -> tuple[int, int] | None:
            low = np.arange(1, total // 2 + 1)
            good = (free[low] > 0) & (free[total - low] > 0)
            if total % 2 == 0 and total:
                good[-1] &= free[total // 2] > 1
            at = np.flatnonzero(good)
            return (int(total - low[at[0]]), int(low[at[0]])) if len(at) else None

        two = pair(gap) if gap > 1 else None
        if two:
            return two
        for first in np.flatnonzero(free)[::-1]:
            first = int(first)
            if gap - first < 2:
                continue
            free[first] -= 1
            two = pair(gap - first)
            free[first] += 1
            if two:
                return (first, *two)
            if 3 * first < gap:  # the other two would have to be larger
                return None
        return None

    def take(self, pattern: Counter) -> int:
        """Remove the pattern as often as the counts allow."""
        times = min(int(self.left[length]) // n for length, n in pattern.items())
        for length, n in pattern.items():
            self.left[length] -= n * times
        return times


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Patterns of lengths and how many containers each fills; every item is in exactly one container."""
    index = ComplementIndex({k: n for k, n in counts.items() if k > 0}, capacity)
    out, loose = [], []
    while length := index.largest(capacity, Counter()):
        pattern, room = Counter([length]), capacity - length
        while room:
            rest = index.exact(room, pattern)
            if rest:
                pattern.update(rest)
                room = 0
            elif more := index.largest(room, pattern):
                pattern[more] += 1
                room -= more
            else:
                break
        times = index.take(pattern)
        (loose if room else out).append((pattern, times))
    return out + _best_fit(loose, capacity)


def _placed(items: list[int], groups: list[list]) -> list[tuple[int, Counter]] | None:
    """Where the items of one container fit best among ``groups`` (by rising room): ``(group, items)`` of each container
    that takes some, or None if one finds no room. A container is asked again before another of its group is opened."""
    opened: list[list] = []  # group, room left, items
    taken: Counter = Counter()
    for x in sorted(items, reverse=True):
        old = min((o for o in opened if o[1] >= x), key=lambda o: o[1], default=None)
        new = next((i for i, g in enumerate(groups) if g[2] >= x and g[1] > taken[i]), None)
        if old and (new is None or old[1] <= groups[new][2]):
            old[1] -= x
            old[2][x] += 1
        elif new is not None:
            taken[new] += 1
            opened.append([new, groups[new][2] - x, Counter([x])])
        else:
            return None
    return [(i, c) for i, _, c in opened]


def _best_fit(loose: list[tuple[Counter, int]], capacity: int) -> list[tuple[Counter, int]]:
    """Empty the least full containers into the fullest others that take their items, if all their items find room.

    Containers of one pattern move together, as many as the others can take at once.
    """
    groups = sorted(([p, n, capacity - sum(k * m for k, m in p.items())] for p, n in loose), key=lambda g: g[2])
    done: list[tuple[Counter, int]] = []
    while groups:
        pattern, n, room = groups.pop()
        items = list(pattern.elements())
        targets = _placed(items, groups)
        own = targets is None and n > 1 and _placed(items, [[pattern, n - 1, room]])  # or into others of its own pattern
        if not targets and not own:
            done.append((pattern, n))
            continue
        if own:
            groups.append([pattern, n, room])
            targets, uses = [(len(groups) - 1, c) for _, c in own], Counter({len(groups) - 1: len(own) + 1})
        else:
            uses = Counter(i for i, _ in targets)
        k = min([groups[i][1] // u for i, u in uses.items()] + ([] if own else [n]))
        fresh = [[groups[i][0] + c, k, groups[i][2] - sum(x * m for x, m in c.items())] for i, c in targets]
        for i, u in uses.items():
            groups[i][1] -= u * k
        if not own and n > k:
            groups.append([pattern, n - k, room])
        merged: dict = {}
        for p, m, r in [*groups, *fresh]:
            if m:
                entry = merged.setdefault(tuple(sorted(p.items())), [p, 0, r])
                entry[1] += m
        groups = sorted(merged.values(), key=lambda g: g[2])
    return done


def pack(df: DataFrame, key: str, text: str, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, piece, start_token, n_tokens, container)``: every token of every text once, in containers from 0.

    Only texts above ``capacity`` tokens are split, at multiples of it. Null and empty texts have no token: one row
    with 0 tokens and a null container. Keys must be unique.
    """
    counted = staged(token_counts(df, key, text, vocabulary), "tokens")
    whole = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    items = counted.select(key, F.col("n_tokens").alias("_all"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")).select(
        key, "piece", (F.col("piece").cast("bigint") * capacity).alias("start_token"), F.least(F.lit(capacity).cast("bigint"), F.col("_all") - F.col("piece").cast("bigint") * capacity).alias("n_tokens")
    )
    # salts split a hot length over tasks; about a million items of one length and salt at most
    salts = max(16, counted.count() // 1_000_000 * 2)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    parts = salted.where("n_tokens > 0").groupBy("n_tokens", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(Window.partitionBy("n_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy("n_tokens").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    slots, used, base = [], Counter(), 0
    for pattern, times in plan(counts, capacity):
        for length, m in pattern.items():
            slots.append((length, used[length], m, base))
            used[length] += m * times
        base += times
    # the slots of all lengths are bounded by the capacity, not by the corpus: one sorted array, asked by binary search
    slots.sort()
    table_of = np.array(slots or [(0, 0, 1, 0)], np.int64)
    shared = df.sparkSession.sparkContext.broadcast(((table_of[:, 0] << 44) | table_of[:, 1], table_of))

    @F.pandas_udf("bigint")
    def container_of(length: pd.Series, rank: pd.Series) -> pd.Series:
        keys, own = shared.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.maximum(np.searchsorted(keys, (length << 44) | rank, "right") - 1, 0)
        return pd.Series(own[at, 3] + (rank - own[at, 1]) // own[at, 2]).where(pd.Series(length > 0))

    rank = F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy(key, "piece")) - 1 + F.coalesce(F.col("_before"), F.lit(0))
    ranked = salted.join(F.broadcast(parts.select("n_tokens", "_salt", "_before")) if salts <= 64 else parts.select("n_tokens", "_salt", "_before"), ["n_tokens", "_salt"], "left").withColumn("_rank", rank.cast("bigint"))
    return ranked.select(key, "piece", "start_token", "n_tokens", container_of("n_tokens", "_rank").alias("container"))


def p8_assign(spark: SparkSession, root: str) -> DataFrame:
    return pack(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    """Containers used, the least number that could do, and the share of room lost."""
    filled = p8_assign(spark, root).where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return filled.agg(F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("n") / 2048).alias("least_possible"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.round(1 - F.sum("n") / (F.count(F.lit(1)) * 2048), 6).alias("room_lost"))


def p8_checks(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the containers, counted over all of them: texts, texts without a token, and three faults."""
    rows = p8_assign(spark, root)
    texts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("n"), F.count("container").alias("held"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count_distinct("start_token").alias("starts"))
    of_texts = texts.agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("n") == 0).alias("texts_without_token"), F.count_if((F.col("k") > 1) & (F.col("n") <= 2048)).alias("split_needlessly"),
        F.count_if((F.col("end") != F.col("n")) | (F.col("starts") != F.col("k")) | (F.col("held") != F.when(F.col("n") > 0, F.col("k")).otherwise(0))).alias("tokens_not_once"),
    )
    filled = rows.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    of_containers = filled.agg(F.count_if(F.col("n") > 2048).alias("overfull"), (F.count(F.lit(1)) <= F.ceil(F.sum("n") / 2048 * 1.02) + 1).alias("nearly_least"))
    return of_texts.crossJoin(of_containers)  # one row each


QUERIES = {"p8_assign": p8_assign, "p8_report": p8_report, "p8_checks": p8_checks}
ORACLES = {"p8_checks": "SELECT count(*) AS texts, count(*) FILTER (coalesce(text, '') = '') AS texts_without_token, 0::BIGINT AS split_needlessly, 0::BIGINT AS tokens_not_once, 0::BIGINT AS overfull, true AS nearly_least FROM documents"}
