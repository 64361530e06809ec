"""MinHash near-duplicates by tensored banding.

Two small collections of ``groups`` hash groups are computed per document, each group over ``rows``
minima. Every pair (one group of either collection) forms the key of one table, so groups * groups
tables of 2 * rows minima each cost only 2 * groups * rows minima. A pair at similarity s meets in
some table with probability (1 - (1 - s^rows)^groups)^2: 0.9996 at 0.8 with the defaults, and 0.0001 at 0.1.

Equal sets are merged before anything is compared. Documents that meet in a table, also by way of
others, form a candidate group; within it all pairs are confirmed on their whole shingle sets, by
products of incidence matrices over blocks of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bits_of, components, in_bits, joined, mixed, ragged, word_hashes
from tessera.session import materialise

BLOCK = 4096
COLUMNS = 4096
BLOCK_SHINGLES = 300_000
BLOCK_MEMBERS = 1_500  # short texts have few shingles, and the matrix of a block grows with the square of its members
CELLS = 1_500_000  # table entries that one task writes


def shingle_set(tokens: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; shorter texts are one run."""
    n = len(tokens)
    if n == 0:
        return np.empty(0, np.uint64)
    t = tokens.view(np.uint64)
    runs = max(1, n - width + 1)
    h = np.full(runs, np.uint64(min(n, width)))
    for k in range(min(n, width)):
        h = mixed(h + t[k : k + runs])
    return np.unique(h)


def minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over a set, in bounded memory."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), BLOCK):
        low = np.minimum(low, (factors[:, None] * shingles[None, i : i + BLOCK]).min(axis=1))
    return low


def signatures(docs: DataFrame, width: int, groups: int, rows: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, set_key, a, b): the set's size, a digest of it and the two group collections."""
    factors = np.random.default_rng(20).integers(0, 1 << 63, 2 * groups * rows, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches):
        for batch in batches:
            values, offsets = ragged(batch.column(1))
            sizes, digests, halves = [], [], []
            for s, e in zip(offsets[:-1], offsets[1:]):
                found = shingle_set(values[s:e], width)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                low = minima(found, factors).reshape(2, groups, rows)
                h = np.zeros((2, groups), np.uint64)
                for r in range(rows):
                    h = mixed(h + low[:, :, r])
                halves.append(h.view(np.int64))
            both = np.array(halves, np.int64).reshape(-1, 2, groups)
            ends = pa.array(np.arange(0, (len(sizes) + 1) * groups, groups, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(both[:, i].ravel())) for i in (0, 1)]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "set_key", "a", "b"])

    inputs = docs.select(F.col(key).cast("long").alias("id"), word_hashes(F.col(text)).alias("t"))
    return inputs.mapInArrow(sign, "id long, n_shingles long, set_key binary, a array<long>, b array<long>")


def sets_of(docs: DataFrame, candidates: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """(id, grp, s): the shingle sets of the documents that ``candidates`` (id, component) names."""

    def expand(batches):
        for batch in batches:
            values, offsets = ragged(batch.column(1))
            found = [shingle_set(values[s:e], width).view(np.int64) for s, e in zip(offsets[:-1], offsets[1:])]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "s"])

    # A bitset of fixed size rules out most other texts before they are split; the join is exact.
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(candidates.select("id")))

    def choose(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bits(bits.value, batch.column(0).to_numpy())))

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    chosen = texts.mapInArrow(choose, "id long, text string").select("id", word_hashes(F.col("text")).alias("t"))
    sets = chosen.mapInArrow(expand, "id long, s array<long>")
    return sets.join(candidates.select("id", F.col("component").alias("grp")), "id")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sets, by products of their incidence columns."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # an element of one set adds nothing
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    met = np.zeros((n, n), np.float32)
    wide = int(often.sum())
    for c in range(0, wide, COLUMNS):
        s, e = np.searchsorted(column, [c, c + COLUMNS])
        grid = np.zeros((n, min(COLUMNS, wide - c)), np.float32)
        grid[owner[s:e], column[s:e] - c] = 1
        met += grid @ grid.T
    return met.astype(np.int64)


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> list[int]:
    """Positions of links that join what the links before them did not."""
    root, kept = list(range(n)), []
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[b] = a
            kept.append(k)
    return kept


def block_pairs(members: DataFrame) -> DataFrame:
    """(id, s, grp, place, low, high): the members (id, s, grp), each in every pair of blocks that it is compared in.

    A group of at most BLOCK_SHINGLES shingles and BLOCK_MEMBERS members is one block; a larger one is cut into blocks of about that size.
    """
    weight = members.groupBy("grp").agg(F.sum(F.size("s")).alias("w"), F.count(F.lit(1)).alias("m")).where("m > 1")
    total = weight.agg(F.sum("w")).first()[0] or 0
    bins = max(1, -(-total // (4 * BLOCK_SHINGLES)))
    blocks = F.ceil(F.greatest(F.col("w") / F.lit(BLOCK_SHINGLES), F.col("m") / F.lit(BLOCK_MEMBERS))).cast("int")
    cut = members.join(weight.select("grp", blocks.alias("blocks")), "grp").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0))))
    return cut.withColumn("other", other).select(
        "id", "s", "grp",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(bins))).otherwise(F.col("grp")).alias("place"),
        F.when(F.col("blocks") == 1, F.lit(-1)).otherwise(F.least("block", "other")).alias("low"),
        F.greatest("block", "other").alias("high"),
    )


def verified(members: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between the members (id, s, grp) of each group, as many as connect what they link.

    Small groups are compared within one task, each pair of a larger one's blocks is a task of its own, so a task's memory is
    bounded (but for one set) and no pair of documents is ever a row.
    """

    def compare(key, table):
        ids = joined(table.column("id")).to_numpy()
        groups = joined(table.column("grp")).to_numpy()
        values, offsets = ragged(joined(table.column("s")))
        order = np.argsort(groups, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], groups[order][1:] != groups[order][:-1], [True]]))
        left, right = [], []
        for s, e in zip(cuts[:-1], cuts[1:]):
            chosen = order[s:e]
            sets = [values[offsets[i] : offsets[i + 1]] for i in chosen]
            size = np.array([len(x) for x in sets])
            met = overlaps(sets)
            u, v = np.nonzero(np.triu(100 * met >= percent * (size[:, None] + size[None, :] - met), 1))
            kept = spanning(u, v, len(sets))
            left.append(ids[chosen[u[kept]]])
            right.append(ids[chosen[v[kept]]])
        return pa.table({"u": pa.array(np.concatenate(left)), "v": pa.array(np.concatenate(right))})

    return block_pairs(members).groupBy("place", "low", "high").applyInArrow(compare, "u long, v long")


def hung(led: DataFrame) -> DataFrame:
    """(lead, rep): links that connect each ``rep`` with all its ``leads`` (at most one a table), hung from the smallest of them.

    Copies share their leads, so that links between leads repeat and fall out: a large group leaves about a link a member,
    not one for each member and lead.
    """
    first = F.array_min("leads")
    others = F.array_except(F.array_append("leads", F.col("rep")), F.array(first))
    return led.select(first.alias("lead"), F.explode(others).alias("rep")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 4, percent: int = 80, groups: int = 12, rows: int = 3, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked when 100 * |A & B| >= percent * |A or B|. A document of fewer words than
    ``width`` is one shingle; one without words, or with a null text, has no shingle and no link.
    Rows that repeat an id appear once each and share the component. A row without an id takes the
    component of equal sets (null if none has an id) and is kept only where that is null.
    Other columns of ``docs`` are not read.
    """
    sig = materialise(signatures(docs, width, groups, rows, text, key), "signatures")
    classes = materialise(sig.where("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("rep")), "classes")
    parts = max(1, -(-classes.count() * groups * groups // CELLS))
    reps = sig.where("n_shingles > 0").join(classes, "set_key").where("id = rep").repartition(parts, "rep").dropDuplicates(["rep"])
    cells = "explode(flatten(transform(a, (x, i) -> transform(b, (y, j) -> xxhash64(i, j, x, y)))))"
    keyed = reps.selectExpr("rep", f"{cells} as cell")
    shared = keyed.groupBy("cell").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    led = keyed.join(shared.select("cell", "lead"), "cell").where("rep <> lead").groupBy("rep").agg(F.collect_set("lead").alias("leads"))
    met = materialise(hung(led), "met")
    candidates = components(met, "lead", "rep")
    members = materialise(sets_of(docs, candidates, width, text, key).dropDuplicates(["id"]), "sets")
    found = components(materialise(verified(members, percent), "links"))
    owned = sig.join(classes, "set_key", "left").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    smallest = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return owned.select(
        F.col("id").alias("doc_id"), "n_shingles", smallest.alias("component_id"), F.col("id").eqNullSafe(smallest).alias("kept")
    )
