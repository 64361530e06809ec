"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Every text is read once; its word n-grams are tested against a Bloom bitset of all benchmark n-grams.
   The bitset has a fixed size, so what is broadcast does not grow. Hits are joined exactly afterwards.
2. Every n-gram of an item is a seed, however many documents hold it: an edited copy is found by whichever
   n-grams it kept. Document hits without a second hit within reach of any item are left out before the join.
3. Documents meet items on seeds; seeds that lie close to one diagonal open a window of the document.
4. Each window's words are aligned with the item's words by Smith-Waterman; the score is a share of the
   item's own best score, so edited, cut and paraphrased copies score high and chance phrases low.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bits_of, filled, in_bits, mixed, ragged
from tessera.session import materialise

MATCH, MISMATCH, GAP = 2, -1, -1
LANES = 512  # windows aligned in lockstep


def plain_words(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased: copies often differ in case and punctuation."""
    found = F.split(F.lower(filled(text)), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def grams(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of the run of ``width`` words that starts at each word; the last ones run past their text."""
    t = tokens.view(np.uint64)
    h = np.full(len(t), np.uint64(width))
    for k in range(width):
        h[: len(t) - k] = mixed(h[: len(t) - k] + t[k:])
    return h


def runs(batch_lists, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of all n-grams of some texts; a shorter text is one run."""
    values, offsets = ragged(batch_lists)
    values = values[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    position = np.arange(len(values)) - offsets[:-1][owner]
    fits = position + width <= sizes[owner]
    h = grams(values, width)
    for i in np.flatnonzero((sizes > 0) & (sizes < width)):
        h[offsets[i]] = grams(np.concatenate([values[offsets[i] : offsets[i + 1]], np.zeros(width, np.int64)]), width)[0]
        fits[offsets[i]] = True
    return owner[fits], position[fits], h[fits].view(np.int64)


def item_grams(items: DataFrame, width: int) -> DataFrame:
    """(item_id, gram, pos, n_words) of every benchmark n-gram."""

    def expand(batches):
        for batch in batches:
            owner, position, h = runs(batch.column(1), width)
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            ids = batch.column(0).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(h), pa.array(position, pa.int64()), pa.array(sizes[owner], pa.int64())], names=["item_id", "gram", "pos", "n_words"]
            )

    return items.mapInArrow(expand, "item_id long, gram long, pos long, n_words long")


def hits_of(docs: DataFrame, bits, width: int, reach: int) -> DataFrame:
    """(doc_id, gram, pos) of the n-grams that may be in the benchmark and have another within ``reach`` words.

    With a ``reach`` of 0 those without one are kept too.
    """

    def find(batches):
        for batch in batches:
            owner, position, h = runs(batch.column(1), width)
            met = np.flatnonzero(in_bits(bits.value, h))
            if reach:
                close = (np.diff(owner[met]) == 0) & (np.diff(position[met]) <= reach)
                met = met[np.concatenate([[False], close]) | np.concatenate([close, [False]])] if len(met) else met
            ids = batch.column(0).take(pa.array(owner[met]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h[met]), pa.array(position[met], pa.int64())], names=["doc_id", "gram", "pos"])

    return docs.mapInArrow(find, "doc_id long, gram long, pos long")


def align(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of the rows of ``a`` (windows) with those of ``b`` (items, padded to ``sizes``) in lockstep.

    Returns the best scores and the window's first and last word of the best alignment. Gaps along the item are
    closed by a running maximum, so a step handles a whole row of the matrix.
    """
    lanes, wide = b.shape
    column = np.arange(wide)
    inside = column < sizes[:, None]
    score = np.zeros((lanes, wide + 1), np.int64)
    start = np.zeros((lanes, wide + 1), np.int64)
    best = np.zeros(lanes, np.int64)
    span = np.zeros((lanes, 2), np.int64)
    far = 1 << 40
    for i in range(a.shape[1]):
        same = (a[:, i : i + 1] == b) & inside
        # Scores and starts travel together: of equal scores the later start wins, which is the tighter span.
        packed = score * far + start
        diagonal = packed[:, :-1] + np.where(same, MATCH, MISMATCH) * far
        diagonal = np.where(score[:, :-1] == 0, np.where(same, MATCH, MISMATCH) * far + i, diagonal)
        step = np.maximum(diagonal, packed[:, 1:] + GAP * far)
        step = np.maximum(step, i + 1)  # a fresh start behind this word
        slope = step - GAP * far * column
        step = np.maximum.accumulate(slope, axis=1) + GAP * far * column
        score[:, 1:], start[:, 1:] = step // far, step % far
        score[:, 1:][~inside] = 0
        top = score.max(axis=1)
        better = top > best
        if better.any():
            at = score[better].argmax(axis=1)
            best[better] = top[better]
            span[better, 0] = start[better, at]
            span[better, 1] = i
    return best, span[:, 0], span[:, 1]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 3,
    least_hits: int = 2,
    threshold: float = 0.5,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """(doc_id, item_id, score, best, first_word, last_word, n_seeds): the documents that hold a copy of an item.

    ``best`` is the Smith-Waterman score (match 2, mismatch and gap -1) of the item's words and ``score`` its share
    of the item's own 2 * words; rows have score >= ``threshold``. first_word and last_word delimit the passage in
    the document's words. An item's seeds are all its ``width``-word runs. A window needs ``least_hits`` seeds near one
    diagonal, or all seeds of an item that has fewer; an item of fewer words than ``width`` is only found as a whole text.
    Rows that meet on seeds grow with the documents times the items that share a run. Null, empty and blank texts, on
    either side, match nothing; rows without an id are left out. Repeated ids are one document whose texts are all searched, repeated items are
    one item. Other columns are not read; an empty side gives no rows.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("long").alias("doc_id"), plain_words(F.col(text)).alias("t")).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain_words(F.col("text")).alias("words"))
    items = items.where("item_id is not null and size(words) > 0").dropDuplicates(["item_id", "words"])
    known = materialise(item_grams(items.select("item_id", "words"), width), "grams")
    bits = spark.sparkContext.broadcast(bits_of(known.select("gram")))
    # Two hits of a window are no further apart than the item is long and its diagonals are wide; with an item that one hit finds, each counts.
    sizes = known.agg(F.min("n_words").alias("least"), F.max("n_words").alias("most")).first()
    alone = least_hits < 2 or sizes.least is None or sizes.least <= width
    hits = materialise(hits_of(read, bits, width, 0 if alone else 2 * sizes.most + 8), "hits")
    seeds = known.select("item_id", "gram", F.col("pos").alias("item_pos"), "n_words")

    # A window is a stretch of diagonals no wider than the item; neighbours overlap by half so that none is cut.
    diagonal = F.col("pos") - F.col("item_pos")
    slack = F.greatest(F.lit(4), F.floor(F.col("n_words") / 4))
    cell = F.floor(diagonal / (2 * slack))
    near = F.explode(F.array(cell, F.floor((diagonal + slack) / (2 * slack)) + F.lit(1 << 40)))
    met = hits.join(seeds, "gram").select("doc_id", "item_id", "n_words", slack.alias("slack"), diagonal.alias("d"), "pos", near.alias("cell"))
    windows = met.groupBy("doc_id", "item_id", "cell").agg(
        F.count_distinct("pos").alias("n_seeds"), F.min("d").alias("d0"), F.max("d").alias("d1"), F.first("n_words").alias("n_words"), F.first("slack").alias("slack")
    )
    needed = F.least(F.lit(least_hits), F.greatest(F.lit(1), F.col("n_words") - width + 1))
    windows = windows.where(F.col("n_seeds") >= needed).select(
        "doc_id", "item_id", "n_seeds",
        F.greatest(F.lit(0), F.col("d0") - F.col("slack")).alias("begin"),
        (F.col("d1") + F.col("n_words") + F.col("slack")).alias("until"),
    )
    windows = materialise(windows.dropDuplicates(["doc_id", "item_id", "begin", "until"]), "windows")

    # The words of the windows only travel on; the texts are read again for the documents that have one.
    wanted = windows.select("doc_id").distinct()
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).join(wanted, "doc_id")
    cut = texts.select("doc_id", plain_words(F.col("_text")).alias("t")).join(windows, "doc_id")
    cut = cut.select("doc_id", "item_id", "n_seeds", "begin", F.slice("t", F.col("begin").cast("int") + 1, (F.col("until") - F.col("begin")).cast("int")).alias("a"))
    pairs = cut.where("size(a) > 0").join(items.select("item_id", F.col("words").alias("b")), "item_id")

    def score(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            (a, at_a), (b, at_b) = ragged(columns["a"]), ragged(columns["b"])
            begin = columns["begin"].to_numpy()
            size_a, size_b = np.diff(at_a), np.diff(at_b)
            order = np.argsort(size_a * 64 + size_b, kind="stable")
            best, first, last = (np.zeros(len(begin), np.int64) for _ in range(3))
            at = 0
            while at < len(order):
                lanes = max(1, min(LANES, (1 << 22) // max(1, int(size_b[order[at : at + LANES]].max()))))
                chosen = order[at : at + lanes]
                at += lanes
                left = np.full((len(chosen), int(size_a[chosen].max())), -1, np.int64)
                right = np.full((len(chosen), int(size_b[chosen].max())), -2, np.int64)
                for row, i in enumerate(chosen):
                    left[row, : size_a[i]] = a[at_a[i] : at_a[i + 1]]
                    right[row, : size_b[i]] = b[at_b[i] : at_b[i + 1]]
                best[chosen], first[chosen], last[chosen] = align(left, right, size_b[chosen])
            names = ["doc_id", "item_id", "n_seeds", "best", "score", "first_word", "last_word"]
            share = best / (MATCH * size_b)
            found = [pa.array(x) for x in (best, share, first + begin, last + begin)]
            yield pa.RecordBatch.from_arrays([columns["doc_id"], columns["item_id"], columns["n_seeds"], *found], names=names)

    schema = "doc_id long, item_id long, n_seeds long, best long, score double, first_word long, last_word long"
    scored = pairs.mapInArrow(score, schema).where(F.col("score") >= threshold)
    top = F.max_by(F.struct("best", "score", "first_word", "last_word", "n_seeds"), F.struct("score", "n_seeds", -F.col("first_word"), -F.col("last_word")))
    return scored.groupBy("doc_id", "item_id").agg(top.alias("top")).select("doc_id", "item_id", "top.*")
