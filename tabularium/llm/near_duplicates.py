"""Problem 6: near-duplicate records with small edits.

ProbMinHash: every shingle sends out arrivals of a Poisson process whose rate is its weight, each hitting a random
register; a register keeps its first arrival. A shingle stops as soon as its next arrival lies beyond the latest first
arrival of its document, so a signature costs about n + m ln m draws instead of n * m. Two documents agree in a
register with the probability Jaccard of their weighted shingles (the plain Jaccard for weights of one). Registers are
banded, bands meet in one shuffle, and what meets is screened by signature and verified on the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabularium.llm.words import GOLDEN, distinct_runs, mix, runs, word_hashes
from tabularium.operators.components import connected_components
from tabularium.plans.latest import latest_rows
from tabularium.plans.staging import staged
from tabularium.sources.tables import table

#: Registers of a band; four lanes of 16 bits make one band key.
ROWS = 4
#: Packed bands that the screen compares.
SCREEN = 12
#: Members of a bucket that one task pairs; larger buckets are paired in salted blocks of this size.
BUCKET = 256
#: Bytes of keys up to which the records to verify are picked by broadcast.
BROADCAST = 16 << 20
#: Copies of one text that are expanded into pairs; larger groups are linked to their first member.
COPIES = 64


def prob_min_hash(hashes: np.ndarray, owner: np.ndarray, weights: np.ndarray, documents: int, registers: int) -> np.ndarray:
    """Winner of each register, ``documents`` x ``registers``; rows of documents without elements are zero."""
    first = np.full(documents * registers, np.inf)
    winner = np.zeros(documents * registers, np.uint64)
    live, t = np.arange(len(hashes)), np.zeros(len(hashes))
    state = mix(hashes ^ GOLDEN)
    bound = np.full(documents, np.inf)
    while len(live):
        state = state + GOLDEN
        draw = mix(state)
        t = t - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / weights[live]
        keep = t < bound[owner[live]]
        live, t, state, draw = live[keep], t[keep], state[keep], draw[keep]
        at = owner[live] * registers + ((mix(draw) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, at, t)
        won = first[at] == t
        winner[at[won]] = hashes[live[won]]
        active = np.zeros(documents, bool)
        active[owner[live]] = True
        active = np.flatnonzero(active)
        bound[active] = first.reshape(documents, registers)[active].max(axis=1)
    return winner.reshape(documents, registers)


def _shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat, bounds = word_hashes(texts)
    return distinct_runs(*runs(flat, bounds, size), len(texts))


def _sign(size: int, bands: int, counted: bool):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                n = batch.num_rows
                hashes, owner, times = _shingles(batch.column("_text"), size)
                spread = mix(hashes)
                weights = times.astype(float) if counted else np.ones(len(hashes))
                lanes = (mix(prob_min_hash(spread, owner, weights, n, bands * ROWS)) & np.uint64(0xFFFF)).reshape(n, bands, ROWS)
                packed = np.zeros((n, bands), np.uint64)
                for r in range(ROWS):
                    packed |= lanes[:, :, r] << np.uint64(16 * r)
                total = np.bincount(owner, minlength=n)
                some = np.flatnonzero(total)
                ends = np.cumsum(total)[some] - total[some]
                sums = [np.add.reduceat(x, ends).view(np.int64) if len(some) else np.empty(0, np.int64) for x in (spread * mix(times.astype(np.uint64)) if counted else spread, mix(spread ^ GOLDEN) * times.astype(np.uint64) if counted else mix(spread ^ GOLDEN))]
                values = pa.array(packed[some].reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), values)
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(some)), pa.array(sums[0]), pa.array(sums[1]), lists], names=["_key", "k1", "k2", "packed"])

    return sign


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by band key: pairs of each bucket, or the members themselves of a bucket above ``BUCKET``."""

    def emit(band: np.ndarray, k: np.ndarray, large: int | None) -> tuple[list, int | None]:
        out = []
        edges = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1], [True]]))
        sizes = np.diff(edges)
        for i in np.flatnonzero((sizes > 1) | (band[edges[:-1]] == (large if large is not None else band[0] - 1))):
            m = np.unique(k[edges[i] : edges[i + 1]])
            key = int(band[edges[i]])
            if len(m) > BUCKET or key == large:
                out.append((m, np.full(len(m), key, np.int64), np.ones(len(m), bool)))
            elif len(m) > 1:
                x, y = np.triu_indices(len(m), 1)
                out.append((m[x], m[y], np.zeros(len(x), bool)))
        return out, None

    def send(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["a", "b", "large"])

    band, k, large = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in batches:
        band = np.concatenate([band, batch.column("band").to_numpy()])
        k = np.concatenate([k, batch.column("k1").to_numpy()])
        cut = int(np.searchsorted(band, band[-1], "left"))
        out = []
        if cut:
            out, _ = emit(band[:cut], k[:cut], large)
            if band[0] == large and band[cut - 1] != large:
                large = None
        if len(band) - cut > BUCKET:  # an open bucket that is already large goes out as it comes
            members = np.unique(k[cut:])
            band, k = np.concatenate([band[:cut], np.full(len(members), band[-1])]), np.concatenate([k[:cut], members])
            if len(members) > BUCKET or large == band[-1]:
                large = int(band[-1])
                out.append((members, np.full(len(members), large, np.int64), np.ones(len(members), bool)))
                band, k = band[:0], k[:0]
                cut = 0
        band, k = band[cut:], k[cut:]
        if out:
            yield send(out)
    if len(band):
        out, _ = emit(band, k, large)
        if out:
            yield send(out)


def _blocks(members: DataFrame) -> DataFrame:
    """All pairs of large buckets in salted blocks: each task pairs two blocks of about ``BUCKET`` members."""
    members = members.select(F.col("b").alias("band"), F.col("a").alias("k")).distinct()
    sizes = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("n"))
    salted = members.join(sizes, "band").withColumn("s", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    sides = salted.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    left = sides.where("s <= o").select("band", F.col("s").alias("x"), F.col("o").alias("y"), F.col("k").alias("a"))
    right = sides.where("s >= o").select("band", F.col("o").alias("x"), F.col("s").alias("y"), F.col("k").alias("b"))
    return left.join(right, ["band", "x", "y"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _agreement(x: Column, y: Column) -> Column:
    """Equal 16-bit lanes of two packed arrays."""
    lane = lambda v, r: v.bitwiseAND(F.lit(0xFFFF << (16 * r) if r < 3 else -(1 << 48))) == 0
    per = F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))
    return F.aggregate(per, F.lit(0), lambda s, v: s + sum((F.when(lane(v, r), 1).otherwise(0) for r in range(ROWS)), F.lit(0)))


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owner, _ = _shingles(batch.column("_text"), size)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.ListArray.from_arrays(pa.array(ends), pa.array(mix(hashes).view(np.int64)))], names=["k1", "k2", "items"])

    return sets


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        n = batch.num_rows
        sizes = [c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, y)]
        keys = [distinct_runs(c.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(n), s), n) for c, s in zip((x, y), sizes)]
        owner = np.concatenate([keys[0][1], keys[1][1]])
        _, of, times = distinct_runs(np.concatenate([keys[0][0], keys[1][0]]), owner, n)
        both = np.bincount(of[times == 2], minlength=n)
        either = np.bincount(of, minlength=n)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a1", "a2", "b1", "b2")], pa.array(both / np.maximum(either, 1))], names=["a1", "a2", "b1", "b2", "similarity"])


class NearDuplicates:
    """Classes of equal shingle sets, and verified links between classes.

    ``members``: ``(key, k1, k2)``, one row per record with shingles; ``k1, k2`` identify its class (128 bits of its
    shingle set). ``links``: ``(a1, a2, b1, b2, similarity)`` between different classes. Records with null, empty or
    too short texts have no shingles and belong to neither; repeated rows of a key count once.
    """

    def __init__(self, df: DataFrame, key: str, text: str, words: int = 5, similarity: float = 0.8, bands: int = 20, counted: bool = False):
        kind = df.schema[key].dataType.simpleString()
        rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        signed = staged(rows.mapInArrow(_sign(words, bands, counted), f"_key {kind}, k1 bigint, k2 bigint, packed array<bigint>"), "signatures")
        self.key, self.members = key, signed.select(F.col("_key").alias(key), "k1", "k2")
        # copies are counted with a map-side combine and leave before anything is exploded: one row stands for a class
        sizes = signed.groupBy("k1", "k2").agg(F.min("_key").alias("face"), F.count(F.lit(1)).alias("n"))
        self.classes = staged(sizes.where("n > 1"), "classes")
        spare = signed.select("_key", "k1", "k2").join(self.classes, ["k1", "k2"]).where("_key <> face").select("_key")
        faces = signed.join(spare, "_key", "left_anti")
        exploded = faces.select("k1", F.posexplode("packed").alias("at", "band")).select(F.xxhash64("at", "band").alias("band"), "k1")
        paired = staged(exploded.repartition("band").sortWithinPartitions("band").mapInArrow(_pair_up, "a bigint, b bigint, large boolean"), "buckets")
        candidates = paired.where("NOT large").select("a", "b")
        large = paired.where("large").select("a", "b")
        if large.limit(1).count():
            candidates = candidates.unionAll(_blocks(large))
        candidates = candidates.distinct()
        compared = min(SCREEN, bands) * ROWS
        least = max(0.0, similarity - 3.5 * (similarity * (1 - similarity) / compared) ** 0.5) * compared
        a, b = (faces.select(F.col("k1").alias(s), F.col("k2").alias(f"{s}2"), F.col("_key").alias(f"{s}_key"), F.slice("packed", 1, min(SCREEN, bands)).alias(f"{s}_packed")) for s in "ab")
        near = staged(candidates.join(a, "a").join(b, "b").where(_agreement(F.col("a_packed"), F.col("b_packed")) >= least).select(F.col("a").alias("a1"), F.col("a2"), "a_key", F.col("b").alias("b1"), F.col("b2"), "b_key"), "near")
        wanted = near.select(F.col("a_key").alias("_key"), F.col("a1").alias("k1"), F.col("a2").alias("k2")).unionAll(near.select("b_key", "b1", "b2")).distinct()
        wanted = staged(wanted, "wanted")
        bulk = wanted.agg(F.coalesce(F.sum(32 + F.octet_length(F.col("_key").cast("string"))), F.lit(0))).first()[0]
        wanted = F.broadcast(wanted) if bulk <= BROADCAST else wanted  # else the texts are shuffled to their keys
        sets = rows.join(wanted, "_key").select("k1", "k2", "_text").mapInArrow(_sets(words), "k1 bigint, k2 bigint, items array<bigint>")
        x, y = (sets.select(F.col("k1").alias(f"{s}1"), F.col("k2").alias(f"{s}2"), F.col("items").alias(i)) for s, i in (("a", "x"), ("b", "y")))
        joined = near.select("a1", "a2", "b1", "b2").join(x, ["a1", "a2"]).join(y, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "x", "y")
        checked = joined.mapInArrow(_common, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double")
        self.links = staged(checked.where(F.col("similarity") >= similarity).distinct(), "links")

    def pairs(self) -> DataFrame:
        """``(a, b, similarity)`` with a < b: links between the members of two classes and within a class.

        A class of more than ``COPIES`` equal sets is not expanded: each member is paired with the least member, which
        alone carries the links of the class.
        """
        k = self.key
        sizes = self.classes
        copies = self.members.join(sizes, ["k1", "k2"])
        small = copies.where(F.col("n") <= COPIES)
        inner = small.select("k1", "k2", F.col(k).alias("a")).join(small.select("k1", "k2", F.col(k).alias("b")), ["k1", "k2"]).where("a < b")
        star = copies.where((F.col("n") > COPIES) & (F.col(k) != F.col("face"))).select("k1", "k2", F.col("face").alias("a"), F.col(k).alias("b"))
        ends = self.links.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).unionAll(self.links.select("b1", "b2")).distinct()
        shown = self.members.join(ends, ["k1", "k2"]).join(sizes, ["k1", "k2"], "left").where(F.coalesce(F.col("n") <= COPIES, F.lit(True)) | (F.col(k) == F.col("face")))
        x, y = (shown.select(F.col("k1").alias(f"{s}1"), F.col("k2").alias(f"{s}2"), F.col(k).alias(s)) for s in "ab")
        across = self.links.join(x, ["a1", "a2"]).join(y, ["b1", "b2"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
        return across.unionAll(inner.unionAll(star).select("a", "b", F.lit(1.0))).where("a <> b").distinct()

    def groups(self) -> DataFrame:
        """``(key, group_id, n_links)`` of every record: the least key of its class's component, and the links of its class."""
        name = lambda s: F.format_string("%016x%016x", f"{s}1", f"{s}2")
        edges = self.links.select(name("a").alias("a"), name("b").alias("b"))
        parts = connected_components(edges, "a", "b")
        degree = edges.select("a").unionAll(edges.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
        rows = self.members.select(F.col(self.key).alias("_key"), name("k").alias("node"))
        out = rows.join(parts.join(degree, "node"), "node", "left").select("_key", F.coalesce("component", "node").alias("part"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")).distinct()
        least = out.groupBy("part").agg(F.min("_key").alias("group_id"))  # combined before the shuffle, one row for a group
        return out.join(least, "part").select(F.col("_key").alias(self.key), "group_id", "n_links")


def _current(spark: SparkSession, root: str) -> DataFrame:
    return latest_rows(table(spark, root, "index_chunk").select("row_no", "chunk_id", "content", "indexed_at"), ["chunk_id"], [F.col("indexed_at")], "row_no").where("chunk_id IS NOT NULL")


def _near(spark: SparkSession, root: str) -> NearDuplicates:
    return NearDuplicates(_current(spark, root), "chunk_id", "content", words=3, similarity=0.5, bands=40)


def p6_groups(spark: SparkSession, root: str) -> DataFrame:
    return _near(spark, root).groups()


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return _near(spark, root).pairs().select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


_FOUND_SQL = r"""
WITH c AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') w FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, row_no DESC) rn FROM index_chunk) WHERE rn = 1),
s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) s FROM c WHERE len(w) >= 3),
n AS (SELECT chunk_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.chunk_id chunk_id_a, b.chunk_id chunk_id_b, count(*) c FROM s a JOIN s b USING (s) WHERE a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT chunk_id_a, chunk_id_b FROM p JOIN n x ON x.chunk_id = chunk_id_a JOIN n y ON y.chunk_id = chunk_id_b WHERE c / (x.n + y.n - c) >= 0.5
"""
_GROUPS_SQL = "WITH RECURSIVE " + _FOUND_SQL.strip().removeprefix("WITH").rsplit("SELECT chunk_id_a", 1)[0].rstrip() + """,
l AS (SELECT chunk_id_a a, chunk_id_b b FROM p JOIN n x ON x.chunk_id = chunk_id_a JOIN n y ON y.chunk_id = chunk_id_b WHERE c / (x.n + y.n - c) >= 0.5), d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT chunk_id, chunk_id FROM n UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b),
k AS (SELECT chunk_id, md5(string_agg(s, chr(1) ORDER BY s)) k FROM s GROUP BY 1),
f AS (SELECT d.a, count(DISTINCT y.k) n_links FROM d JOIN k x ON x.chunk_id = d.a JOIN k y ON y.chunk_id = d.b WHERE x.k <> y.k GROUP BY 1)
SELECT r.a AS chunk_id, min(r.b) AS group_id, coalesce(any_value(f.n_links), 0) AS n_links FROM r LEFT JOIN f ON f.a = r.a GROUP BY r.a"""
QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
ORACLES = {"p6_found": _FOUND_SQL, "p6_groups": _GROUPS_SQL}
