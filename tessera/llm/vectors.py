"""Near-duplicate vectors with an inverted multi-index.

Each half of a unit vector has its own codebook; the product of the two codebooks is a grid of cells. A vector
visits the cells nearest to it in multi-sequence order (by the sum of both halves' distances), as many as the target
recall takes for the links of a sample with all vectors, and is compared with what lies in them. Every link is verified in double precision.
Large cells are cut into blocks, so a task holds a bounded number of vectors and no pair is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, joined, ragged
from tessera.session import materialise

BLOCK = 1024  # vectors of a cell, and visitors, that meet in one task
PER_CELL = 16  # vectors per cell that the codebooks aim at
MOST_CENTRES = 256
LEAST_CELLS = 12  # visited, whatever the sample says
FEW_LINKS = 1000  # of a sample; with fewer, made-up links at the least cosine count too
TURNS = 12  # of k-means


def unit(values: np.ndarray, dim: int) -> np.ndarray:
    x = values.reshape(-1, dim).astype(float)
    # Scaled first, so that squares of very large or small components neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None], 0)


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means centres; the start is a spread-out choice of sample rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(TURNS):
        own = np.concatenate([distances(x[i : i + 8192], centres).argmin(axis=1) for i in range(0, len(x), 8192)])
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], many: int) -> np.ndarray:
    """The ``many`` nearest cells of each vector in multi-sequence order, the own cell first.

    The cell of the i-th and j-th nearest centres has (i + 1)(j + 1) - 1 cells before it at least, so only cells with
    (i + 1)(j + 1) <= many can be among the first ``many``.
    """
    half = x.shape[1] // 2
    near, order = [], []
    for part, book in ((x[:, :half], books[0]), (x[:, half:], books[1])):
        d = distances(part, book)
        first = np.argsort(d, axis=1, kind="stable")[:, :many]
        order.append(first)
        near.append(np.take_along_axis(d, first, axis=1))
    i, j = np.meshgrid(np.arange(near[0].shape[1]), np.arange(near[1].shape[1]), indexing="ij")
    front = (i + 1) * (j + 1) <= many
    i, j = i[front], j[front]
    total = near[0][:, i] + near[1][:, j]
    best = np.argsort(total, axis=1, kind="stable")[:, :many]
    return np.take_along_axis(order[0][:, i] * len(books[1]) + order[1][:, j], best, axis=1)


def cell_ranks(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> np.ndarray:
    """How many cells each vector visits until it has visited the given one; of equally near cells all count."""
    half, k = x.shape[1] // 2, len(books[1])
    d, e = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
    row = np.arange(len(x))
    most = (d[row, cells // k] + e[row, cells % k]) * (1 + 1e-9) + 1e-12
    e.sort(axis=1)
    return np.array([np.searchsorted(b, m - a, side="right").sum() for a, b, m in zip(d, e, most)], np.int64)


def sample_ranks(reps: DataFrame, ids: np.ndarray, x: np.ndarray, books, cosine: float) -> dict[int, int]:
    """How many links of the sample with all vectors of ``reps`` need so many cells, by number of cells.

    The sample is sent to where the vectors are; only the counts come back.
    """
    held = reps.sparkSession.sparkContext.broadcast((ids, x, books))
    dim = x.shape[1]

    def count(batches):
        ids, x, books = held.value
        found: dict[int, int] = {}
        for batch in batches:
            values, offsets = ragged(batch.column(1))
            v, own = unit(values[offsets[0] : offsets[-1]], dim), batch.column(0).to_numpy()
            for s in range(0, len(v), 256):
                u, q = np.nonzero(v[s : s + 256] @ x.T >= cosine)
                other = own[u + s] != ids[q]
                u, q = u[other] + s, q[other]
                if not len(u):
                    continue
                homes = visits(v[s : s + 256], books, 1)[:, 0]
                met, times = np.unique(np.column_stack([q, homes[u - s]]), axis=0, return_counts=True)
                for b in range(0, len(met), 1024):
                    ranks = cell_ranks(x[met[b : b + 1024, 0]], books, met[b : b + 1024, 1])
                    for r, n in zip(ranks.tolist(), times[b : b + 1024].tolist()):
                        found[r] = found.get(r, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["cells", "n"])

    counts = reps.select("id", "embedding").mapInArrow(count, "cells long, n long").groupBy("cells").agg(F.sum("n").alias("n"))
    return {r.cells: r.n for r in counts.collect()}


def made_up_ranks(x: np.ndarray, books, cosine: float) -> np.ndarray:
    """Cells that links of exactly the least cosine, in random directions from the sample's vectors, need."""
    rng = np.random.default_rng(0)
    x = x[np.linspace(0, len(x) - 1, min(len(x), FEW_LINKS)).astype(int)]
    side = rng.normal(size=x.shape)
    side = side - (side * x).sum(axis=1)[:, None] * x
    side = side / np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    other = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * side
    return cell_ranks(x, books, visits(other, books, 1)[:, 0])


def cells_needed(counts: dict[int, int], recall: float) -> int:
    """Cells to visit so that ``recall`` of the counted links are found."""
    ranks = np.array(sorted(counts), np.int64)
    if not len(ranks):
        return 1
    met = np.cumsum([counts[r] for r in ranks.tolist()])
    return int(ranks[min(len(ranks) - 1, np.searchsorted(met, np.ceil(recall * met[-1])))])


def _links(reps: DataFrame, dim: int, cosine: float, recall: float, sample: int) -> DataFrame:
    """(id, links, other): parts of each vector's link count, and links (id, other) that connect what is linked."""
    spark = reps.sparkSession
    count = reps.count()
    most = int(min(1.0, sample / max(1, count)) * (1 << 20))

    def drawn(*salt):
        part = reps.where(F.pmod(F.xxhash64("id", *map(F.lit, salt)), F.lit(1 << 20)) < most).select("id", "embedding")
        rows = sorted((r.id, r.embedding) for r in part.collect()) or [(r.id, r.embedding) for r in reps.limit(1).collect()]
        return np.array([i for i, _ in rows]), unit(np.array([e for _, e in rows]), dim)

    _, x = drawn()
    k = max(1, min(MOST_CENTRES, len(x), int(np.ceil(np.sqrt(count / PER_CELL)))))
    books = (codebook(x[:, : dim // 2], k), codebook(x[:, dim // 2 :], k))
    ids, queries = drawn("query")  # others than the centres come from, to which their own sample lies closer
    counts = sample_ranks(reps, ids, queries, books, cosine)
    if len(ids) < count and sum(counts.values()) < FEW_LINKS:
        for r in made_up_ranks(queries, books, cosine).tolist():
            counts[r] = counts.get(r, 0) + 1
    many = min(k * k, max(LEAST_CELLS, cells_needed(counts, recall)))
    step = max(1, min(1024, (1 << 22) // (many * max(1, many.bit_length()))))
    held = spark.sparkContext.broadcast(books)

    def place(batches):
        for batch in batches:
            values, offsets = ragged(batch.column(2))
            v = unit(values[offsets[0] : offsets[-1]], dim)
            found = np.concatenate([visits(v[i : i + step], held.value, many) for i in range(0, len(v), step)]) if len(v) else np.zeros((0, many), int)
            ends = pa.array(np.arange(0, found.size + 1, many, dtype=np.int32))
            unit_ends = pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(unit_ends, pa.array(v.ravel())),
                 pa.ListArray.from_arrays(ends, pa.array(found.ravel().astype(np.int64)))],
                names=["id", "m", "v", "visits"],
            )

    placed = materialise(reps.select("id", "m", "embedding").mapInArrow(place, "id long, m long, v array<double>, visits array<long>"), "cells")
    placed = placed.withColumn("home", F.col("visits")[0])
    visitors = placed.select("id", "m", "v", "home", F.explode("visits").alias("cell"))
    blocks = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("res"))
    comers = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("vis"))
    grid = materialise(blocks.join(comers, "cell"), "blocks")
    salt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = visitors.join(grid, "cell").select("cell", "id", "m", "v", "home", salt(F.col("vis")).alias("a"), every(F.col("res")).alias("b"))
    right = placed.withColumn("cell", F.col("home")).join(grid, "cell")
    named = [F.col(c).alias(f"r_{c}") for c in ("id", "m", "v", "visits")]
    right = right.select("cell", *named, salt(F.col("res")).alias("b"), every(F.col("vis")).alias("a"))

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("id", "links", "other")})
        qi, qm, qh = (joined(q.column(c)).to_numpy() for c in ("id", "m", "home"))
        ri, rm = (joined(r.column(c)).to_numpy() for c in ("r_id", "r_m"))
        qv, rv = (ragged(joined(c))[0].reshape(-1, dim) for c in (q.column("v"), r.column("r_v")))
        seen = ragged(joined(r.column("r_visits")))[0].reshape(-1, many)
        near = (qv @ rv.T >= cosine) & (qi[:, None] != ri[None])
        # A resident that visits the visitor's own cell counts the link there; otherwise it is counted here.
        homes, at = np.unique(qh, return_inverse=True)
        counts_there = np.column_stack([(seen == h).any(axis=1) for h in homes])
        for_q = near @ rm
        for_r = (near & ~counts_there[:, at].T).T @ qm
        # Enough links to connect: each linked vector with the smallest id it met, and that one's partners.
        u, v = np.nonzero(near)
        a, b = np.minimum(qi[u], ri[v]), np.maximum(qi[u], ri[v])
        ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        kept = spanning(ends[: len(a)], ends[len(a) :], len(ids))
        out = [(qi, for_q, np.full(len(qi), -1)), (ri, for_r, np.full(len(ri), -1)), (a[kept], np.zeros(len(kept), np.int64), b[kept])]
        i, n, o = (np.concatenate(c).astype(np.int64) for c in zip(*out))
        link = np.concatenate([np.zeros(len(qi) + len(ri), bool), np.ones(len(kept), bool)])
        some = (n > 0) | link
        return pa.table({"id": pa.array(i[some]), "links": pa.array(n[some]), "other": pa.array(o[some], mask=~link[some])})

    return left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInArrow(compare, "id long, links long, other long")


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Positions of links that connect all that the links connect, found by rounds of smallest labels."""
    label, kept = np.arange(n), [np.zeros(0, np.int64)]
    while True:
        a, b = label[u], label[v]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return np.concatenate(kept)
        high, low = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        kept.append(apart[first])
        label_to = np.arange(n)
        label_to[high[first]] = low[first]
        while (label_to[label_to] != label_to).any():
            label_to = label_to[label_to]
        label = label_to[label]


def near_vectors(
    vectors: DataFrame, cosine: float = 0.9, recall: float = 1.0, sample: int = 8000, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors are linked when their cosine in double precision is at least ``cosine``. A vector that is null, empty, zero or
    holds a null or non-finite component has no link; neither have vectors of different lengths with each other. Equal
    vectors are one entry of the index and count as often as they occur, also under a repeated id. Rows without an id
    are compared with nothing and kept. The codebooks come from ``sample`` vectors (about, by a hash of the id). So many
    cells are visited that ``recall`` of the links of as many others with all vectors are found; where these are a part and
    have fewer than FEW_LINKS links, links made up at the least cosine count with them. How many of the other vectors' links are
    found is an estimate from these. All vectors are indexed. Other columns are not read.
    """
    e = F.col(column).cast("array<double>")
    sound = F.forall(e, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(e, lambda v: v + F.lit(0.0)).alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumn("sound", F.col("sound") & F.col("id").isNotNull())
    good = rows.where("sound").select("id", "embedding")
    reps = materialise(good.groupBy("embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m")), "vectors")
    dims = [r.d for r in reps.select(F.size("embedding").alias("d")).distinct().collect()]
    parts = [_links(reps.where(F.size("embedding") == d), d, cosine, recall, sample) for d in sorted(dims)]
    if parts:
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        found = materialise(found, "links")
    else:
        found = vectors.sparkSession.createDataFrame([], "id long, links long, other long")
    label = components(found.where("other is not null"), "id", "other")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    entry = reps.join(links, "id", "left").join(label, "id", "left")
    entry = entry.select("embedding", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    whole = good.join(entry, "embedding").select("id", "n", "c").unionByName(
        rows.where("not sound").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    )
    return whole.select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))
