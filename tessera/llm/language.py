"""Language identification with a string kernel.

Blended-spectrum presence kernel: k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), G the distinct byte n-grams
of the lengths ``SPECTRUM`` with ASCII case, digits and marks folded away. Landmarks L, some texts of each language, give Nystrom
features f(x) = k(x, L) K^(-1/2) with K = k(L, L), on which one ridge regression per language is fitted (one
against the rest). k(x, L) is the product of x's presence row with the landmarks' presence matrix, so the
kernel, K^(-1/2) and the regression weights fold into one matrix (n-grams x languages), and a batch of
texts is scored by one product of its sparse presence rows with that matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filled, releasing

SPECTRUM = (2, 3, 4)
BITS = 18  # n-grams are told apart by so many bits of their hash
SLOTS = 1 << BITS
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 1 << 17
LANDMARKS = 128  # over all languages, but FEWEST of each at least
FEWEST = 4
EXAMPLES = 250  # of each language
RIDGE = 1e-3
SHARPNESS = 8.0  # of the softmax that turns regression values into scores

_fold = np.arange(256, dtype=np.uint8)
_fold[0x41:0x5B] += 32
_fold[[b for b in range(0x80) if not chr(b).isalpha()]] = 0x20


class Presence:
    """Distinct n-grams of texts; keeps a stamp per n-gram so that no text clears the table."""

    def __init__(self):
        self.last = np.full(SLOTS, -1, np.int64)

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the distinct n-grams of each text, and the offsets of the texts."""
        sizes = np.array([len(t) + 2 for t in texts])
        x = _fold[np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)].astype(np.uint64)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        code, found, whose = x, [], []
        for n in range(2, max(SPECTRUM) + 1):
            code = (code[:-1] << np.uint64(8)) | x[n - 1 :]
            if n not in SPECTRUM:
                continue
            slot = (((code + np.uint64(n << 40)) * FACTOR) >> np.uint64(64 - BITS)).astype(np.int64)
            text = owner[: len(slot)]
            whole = np.arange(len(slot)) + n <= ends[text]
            found.append(slot[whole])
            whose.append(text[whole])
        slots, text = np.concatenate(found), np.concatenate(whose)
        order = np.argsort(text, kind="stable")
        slots, text = slots[order], text[order]
        # A slot counts once per text: at the place that wrote it last within the text.
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        place = np.arange(len(slots))
        keep = np.empty(len(slots), bool)
        for s, e in zip(cuts[:-1], cuts[1:]):
            self.last[slots[s:e]] = place[s:e]
            keep[s:e] = self.last[slots[s:e]] == place[s:e]
        kept = np.concatenate([[0], np.cumsum(keep)])
        return slots[keep], kept[cuts]


def fit(samples: list[tuple[np.ndarray, str]]) -> tuple[list[str], np.ndarray]:
    """Languages and the folded matrix from (distinct slots, language) examples, in a fixed order."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return [], np.zeros((SLOTS, 0), np.float32)
    sizes = np.array([max(1, len(s)) for s, _ in samples], float)
    chosen, taken = [], dict.fromkeys(langs, 0)
    for i, (_, lang) in enumerate(samples):
        if taken[lang] < max(FEWEST, LANDMARKS // len(langs)):
            taken[lang] += 1
            chosen.append(i)
    # Only n-grams of landmarks have rows; the last row, of zeros, stands for all others.
    used = np.unique(np.concatenate([samples[i][0] for i in chosen]))
    place = np.full(SLOTS, len(used))
    place[used] = np.arange(len(used))
    marks = np.zeros((len(used) + 1, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[place[samples[i][0]], j] = 1 / np.sqrt(sizes[i])
    kernel = np.array([marks[place[s]].sum(axis=0) / np.sqrt(n) for (s, _), n in zip(samples, sizes)], float)
    values, vectors = np.linalg.eigh(kernel[chosen])
    root = vectors * np.where(values > 1e-8 * values.max(), np.maximum(values, 1e-12) ** -0.5, 0)
    features = np.column_stack([kernel @ root, np.ones(len(samples))])
    target = np.where(np.array([lang for _, lang in samples])[:, None] == np.array(langs), 1.0, -1.0)
    # Every language weighs the same, whatever its share of the examples.
    weight = 1 / (target > 0).sum(axis=0)[[langs.index(lang) for _, lang in samples]]
    penalty = RIDGE * np.eye(features.shape[1])
    penalty[-1, -1] = 0
    a = (features * weight[:, None]).T @ features + penalty * weight.sum()
    w = np.linalg.lstsq(a, (features * weight[:, None]).T @ target, rcond=None)[0]
    folded = np.zeros((SLOTS + 1, len(langs)), np.float32)
    folded[used] = marks[:-1] @ (root @ w[:-1]).astype(np.float32)
    folded[-1] = w[-1]
    return langs, folded


def lettered(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predicted(texts: pa.Array, lettered: pa.Array, langs: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each text's language (len(langs) for none) and its score, a batch of texts at a time."""
    found, lettered = Presence(), lettered.to_numpy(zero_copy_only=False)
    best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
    size, part, rows = 0, [], []
    for i, x in enumerate(texts):
        if lettered[i] and langs:
            part.append(x.as_py().encode())
            rows.append(i)
            size += len(part[-1])
        if part and (size >= BATCH_BYTES or i + 1 == len(texts)):
            slots, cuts = found.rows(part)
            value = np.add.reduceat(weights[slots], cuts[:-1], axis=0) / np.sqrt(np.diff(cuts))[:, None] + weights[-1]
            power = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
            best[rows] = value.argmax(axis=1)
            score[rows] = power.max(axis=1) / power.sum(axis=1)
            size, part, rows = 0, [], []
    return best, score


def _fitted(docs: DataFrame, held_out: str, text: str):
    """Languages and the broadcast of the folded matrix."""
    spark = docs.sparkSession
    held = F.coalesce(F.expr(held_out), F.lit(False))
    known = docs.where(~held & F.col("lang").isNotNull() & lettered(text)).select(F.col("lang").cast("string").alias("lang"), filled(F.col(text)).alias("text"))
    known = known.withColumn("h", F.xxhash64("text"))
    # Copies share a draw, so the rates are those of the distinct texts.
    texts = known.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.lang: r.n for r in texts.collect()}
    limits = spark.createDataFrame([(lang, min(1 << 30, int(2 * EXAMPLES / n * (1 << 30)))) for lang, n in counts.items()], "lang string, most long")

    def describe(batches):
        found, seen = Presence(), set()  # of drawn texts, so bounded
        for batch in batches:
            for lang, text, h in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, h) in seen:
                    continue
                seen.add((lang, h))
                slots, _ = found.rows([text.encode()])
                names = ["lang", "h", "slots"]
                row = [pa.array([lang]), pa.array([h], pa.int64()), pa.array([np.sort(slots).astype("<u4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=names)

    draw = F.pmod(F.col("h"), F.lit(1 << 30))
    drawn = known.join(F.broadcast(limits), "lang").where(draw < F.col("most")).select("lang", "text", "h")
    described = drawn.mapInArrow(describe, "lang string, h long, slots binary")
    rows = described.groupBy("lang", "h").agg(F.min("slots").alias("slots")).withColumn("drawn", draw).collect()
    examples, taken = [], dict.fromkeys(counts, 0)
    for r in sorted({(r.drawn, r.lang, bytes(r.slots)) for r in rows}):
        if taken[r[1]] < EXAMPLES:
            taken[r[1]] += 1
            examples.append((np.frombuffer(r[2], "<u4").astype(np.int64), r[1]))
    langs, matrix = fit(examples)
    return langs, spark.sparkContext.broadcast(matrix)


def detect_languages(
    docs: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 0", text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Learns from text and non-null lang of rows where ``held_out`` is not true (null counts as not true): about
    EXAMPLES distinct texts with letters of each language, chosen by a hash (all where there are fewer), of which about LANDMARKS in all are landmarks; only their
    n-gram slots reach the driver. A null text or one without letters is ``und`` with score 0, and so are all where
    no language could be learned. Otherwise score is the softmax weight of the predicted language, ties going to the
    first by name. Whole texts are read; repeated rows are returned as they come; other columns are not read.
    """
    langs, model = _fitted(docs, held_out, text)
    names = np.array([*langs, "und"])

    def predict(batches):
        for batch in batches:
            best, score = predicted(batch.column(2), batch.column(3), langs, model.value)
            arrays = [batch.column(0), batch.column(1), pa.array(names[best].astype(object), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.expr(held_out), F.lit(False))
    inputs = docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), filled(F.col(text)).alias("text"), lettered(text).alias("lettered"))
    return inputs.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.35, held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 0", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is not ``und`` and scores ``least`` or more."""
    langs, model = _fitted(docs, held_out, text)
    names = docs.columns
    own = ["text" if c == text else f"own_{i}" for i, c in enumerate(names)]  # out of the way of clashing names

    @releasing
    def choose(batches):
        for batch in batches:
            best, score = predicted(batch.column(0), batch.column(1), langs, model.value)
            rows = batch.filter(pa.array((best < len(langs)) & (score >= least)))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in own], names=names)

    inputs = docs.select(F.col(text).alias("text"), lettered(text).alias("lettered"), *[F.col(c).alias(o) for c, o in zip(names, own) if c != text])
    return inputs.mapInArrow(choose, docs.schema)
