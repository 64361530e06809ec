"""Language-model scoring with a log-frequency Bloom filter.

The model is a bigram model with a Dirichlet prior: p(w | h) = (c(h, w) + mu * p1(w)) / (c(h) + mu),
p1 the add-k unigram distribution. Bigram counts live in a log-frequency Bloom filter: a count c is
stored as the level 1 + floor(log_base c), by inserting the pair (bigram, j) for every j up to that
level; a reader probes j = 1, 2, ... until one is missing and takes the smallest count of the level
reached. Levels round down, so the probabilities of a history sum to at most one but for the filter's
false positives (``false_positive`` per probe of an absent entry).

How it is spread out: texts are dealt into hash buckets of a bounded size. Every bucket counts its words
and bigrams and sends one sorted block per hash range; a range adds up the counts of all buckets,
answers each bucket with the exact counts of the words it asked for, and builds its own filter segment.
Segments are broadcast in passes of at most ``broadcast_bytes``; a token's probability needs one
segment only, so the passes add up. No driver or task holds the vocabulary.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import filled, hash_part, joined, mixed, ragged, word_hashes
from tessera.session import materialise

BUCKET_CHARS = 4 << 20  # characters of text in a bucket, and in what a hash range counts, on average
LEVEL_BASE = math.sqrt(2.0)
PAIR = np.uint64(0x9E3779B97F4A7C15)
START, END = np.int64(0x51A27), np.int64(0xE4D)  # stand-ins for the hashes of the sentence marks
GROWTH = 1 << 22  # entries probed at a time

SENT = "kind string, part int, bucket int, h array<long>, n array<long>"
MERGED = "kind string, part int, bucket int, n array<long>, bits binary, size long, total long"


def with_end(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with an end mark after every text, the histories before them, and the texts' sizes."""
    sizes = np.diff(offsets) + 1
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    last = np.zeros(len(out), bool)
    last[ends - 1] = True
    out[~last] = tokens[offsets[0] : offsets[-1]] if len(offsets) else tokens
    out[last] = END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[ends - sizes] = START
    return out, before, sizes


def pair_hash(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(before.view(np.uint64) * PAIR + tokens.view(np.uint64))


def range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Range number of unsigned hashes: even cuts of the top 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def counted(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the sum of the weights of each."""
    order = np.argsort(hashes)
    h = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], np.add.reduceat(weights[order], first) if len(h) else weights


def level_table(most: int) -> np.ndarray:
    """Smallest count of each level: level j is reached by counts from this value on."""
    levels = max(1, 1 + math.floor(math.log(max(1, most), LEVEL_BASE) + 1e-9))
    return np.ceil(np.power(LEVEL_BASE, np.arange(levels)) - 1e-9).astype(np.int64)


LEVELS = level_table(1 << 62)


def probe_step(level: int, probe: int) -> np.uint64:
    return np.uint64((level * 64 + probe + 1) * int(PAIR) & 0xFFFFFFFFFFFFFFFF)


def places(hashes: np.ndarray, level: int, probe: int, size: int) -> np.ndarray:
    """Bit of the probe-th hash function for entries (hash, level) in a segment of ``size`` bits."""
    return mixed(hashes + probe_step(level, probe)) % np.uint64(size)


def build_segment(hashes: np.ndarray, counts: np.ndarray, false_positive: float) -> tuple[int, np.ndarray]:
    """Bytes of one segment; its size follows the number of entries, so the error rate is the same everywhere."""
    levels = np.searchsorted(LEVELS, counts, side="right")
    entries = int(levels.sum())
    probes = probes_for(false_positive)
    size = max(64, math.ceil(entries * probes / math.log(2)))
    bits = np.zeros((size + 7) // 8 * 8, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        members = hashes[levels >= level]
        for i in range(probes):
            bits[places(members, level, i, size)] = True
    return size, np.packbits(bits, bitorder="little")


def probes_for(false_positive: float) -> int:
    return max(1, math.ceil(-math.log2(false_positive)))


class LogFrequencyFilter:
    """Reader of some segments: counts of n-gram hashes by repeated membership probes."""

    def __init__(self, segments: dict[int, tuple[int, bytes]], parts: int, probes: int):
        self.parts, self.probes = parts, probes
        self.size = np.zeros(parts, np.uint64)
        self.base = np.full(parts, -1, np.int64)
        at, pieces = 0, []
        for part, (size, bits) in sorted(segments.items()):
            self.size[part], self.base[part] = size, at
            pieces.append(bits)
            at += len(bits) * 8
        self.bits = np.frombuffer(b"".join(pieces), np.uint8)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Smallest count of the level reached; 0 where the first probe fails, -1 for other segments' ranges."""
        parts = range_of(hashes, self.parts)
        base, size = self.base[parts], self.size[parts]
        reached = np.where(base >= 0, 0, -1)
        left = np.flatnonzero(base >= 0)
        level = 0
        while len(left):
            level += 1
            for i in range(self.probes):
                bit = base[left] + (mixed(hashes[left] + probe_step(level, i)) % size[left]).astype(np.int64)
                left = left[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                if not len(left):
                    break
            reached[left] = level
        return np.where(reached > 0, LEVELS[np.maximum(reached, 1) - 1], reached)


def lm_scores(
    docs: DataFrame,
    held_out: str = "pmod(crc32(cast(doc_id as string)), 10) = 0",
    text: str = "text",
    key: str = "doc_id",
    mu: float = 300.0,
    add_k: float = 0.1,
    false_positive: float = 1 / 128,
    broadcast_bytes: int = 128 << 20,
    bucket_chars: int = BUCKET_CHARS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the rows where ``held_out`` is not true. A token is a run of other than ASCII white space, with
    ASCII capitals lowered; each text ends with one end token, so a null, empty or blank text is one token.
    ``held_out`` is null-safe: a row for which it is null (a null id) is learned from. Repeated rows count as
    often as they occur and each get their row. Without any training row all counts are 0. Other columns are not read.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(filled(F.col(text))) + 1)).first()[0]
    parts = max(1, math.ceil((chars or 0) / bucket_chars))
    probes = probes_for(false_positive)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"),
        filled(F.col(text)).alias("text"),
    ).withColumn("bucket", hash_part(parts, "doc_id", "text"))

    def dealt() -> DataFrame:
        return rows.repartition(parts, "bucket").select("bucket", "doc_id", "held_out", word_hashes(F.col("text")).alias("t"))

    def send(key, group):
        """One sorted block of (hash, training count) per kind and range."""
        values, offsets = ragged(joined(group.column("t")))
        held = joined(group.column("held_out")).to_numpy(zero_copy_only=False)
        tokens, before, sizes = with_end(values, offsets)
        train = np.repeat(~held, sizes)
        bigrams = pair_hash(before[train], tokens[train])
        found = {"word": counted(tokens.view(np.uint64), train.astype(np.int64)), "pair": counted(bigrams, np.ones(len(bigrams), np.int64))}
        out = []
        for kind, (h, n) in found.items():
            cut = np.searchsorted(range_of(h, parts), np.arange(parts + 1))
            for part in np.flatnonzero(np.diff(cut)):
                s, e = cut[part], cut[part + 1]
                out.append((kind, int(part), key[0].as_py(), h[s:e].view(np.int64), n[s:e]))
        columns = list(zip(*out)) or [[]] * 5
        return pa.table(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()),
             pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.list_(pa.int64()))],
            names=["kind", "part", "bucket", "h", "n"],
        )

    def merge(key, group):
        """Add up a range: exact answers for the words of each bucket, or the range's filter segment."""
        kind, part = key[0].as_py(), key[1].as_py()
        values, offsets = ragged(joined(group.column("h")))
        weights, _ = ragged(joined(group.column("n")))
        h, total = counted(values.view(np.uint64), weights)
        seen = total > 0
        size, bits = (0, None) if kind == "word" else build_segment(h[seen], total[seen], false_positive)
        summary = {"kind": [kind + "s"], "part": [part], "bucket": [-1], "n": [None], "size": [size if bits is not None else int(seen.sum())]}
        summary |= {"bits": [None if bits is None else bits.tobytes()], "total": [int(total.sum())]}
        if kind == "word":
            answer = total[np.searchsorted(h, values.view(np.uint64))]
            buckets = joined(group.column("bucket")).to_pylist()
            summary["kind"] += [kind] * len(buckets)
            summary["part"] += [part] * len(buckets)
            summary["bucket"] += buckets
            summary["n"] += [answer[s:e] for s, e in zip(offsets[:-1], offsets[1:])]
            for name in ("bits", "size", "total"):
                summary[name] += [None] * len(buckets)
        types = {"kind": pa.string(), "part": pa.int32(), "bucket": pa.int32(), "n": pa.list_(pa.int64()), "bits": pa.binary()}
        types |= {"size": pa.int64(), "total": pa.int64()}
        return pa.table({k: pa.array(summary[k], t) for k, t in types.items()})

    sent = dealt().groupBy("bucket").applyInArrow(send, SENT)
    merged = materialise(sent.groupBy("kind", "part").applyInArrow(merge, MERGED), "counts")
    answers = merged.where("kind = 'word'").select("bucket", "part", "n")
    summary = merged.where("kind = 'words'").agg(F.sum("total"), F.sum("size")).first()
    n, v = int(summary[0] or 0), int(summary[1] or 0)
    segments = merged.where("kind = 'pairs'")
    sizes = sorted((r.part, r.size) for r in segments.select("part", "size").collect())
    passes: list[list[int]] = [[]]
    room = broadcast_bytes * 8
    for part, size in sizes:
        if passes[-1] and size > room:
            passes.append([])
            room = broadcast_bytes * 8
        passes[-1].append(part)
        room -= size

    def scorer(held):
        def score(left, right):
            if not left.num_rows:
                return empty_scores
            values, offsets = ragged(joined(left.column("t")))
            tokens, before, sizes = with_end(values, offsets)
            distinct, back = np.unique(tokens.view(np.uint64), return_inverse=True)
            order = np.argsort(joined(right.column("part")).to_numpy())
            blocks = joined(right.column("n"))
            flat, cuts = ragged(blocks)
            counts = np.concatenate([flat[cuts[i] : cuts[i + 1]] for i in order])
            c = counts[back]
            p1 = (c + add_k) / (n + add_k * (v + 1))
            starts = np.cumsum(sizes) - sizes
            history = np.where(before == START, 0, np.concatenate([[0], c[:-1]]))
            history[starts] = counts[np.searchsorted(distinct, END.view(np.uint64))]
            pairs, place = np.unique(pair_hash(before, tokens), return_inverse=True)
            met = np.concatenate([held.value.counts(pairs[i : i + GROWTH]) for i in range(0, len(pairs), GROWTH)])[place]
            terms = np.where(met < 0, 0.0, np.log10((np.minimum(np.maximum(met, 0), np.minimum(c, history)) + mu * p1) / (history + mu)))
            return pa.table(
                {
                    "doc_id": joined(left.column("doc_id")),
                    "held_out": joined(left.column("held_out")),
                    "n_tokens": pa.array(sizes.astype(np.int64)),
                    "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                    "base_score": pa.array(np.add.reduceat(np.log10(p1), starts)),
                    "score": pa.array(np.add.reduceat(terms, starts)),
                }
            )

        return score

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    empty_scores = to_arrow_schema(spark.createDataFrame([], schema).schema).empty_table()
    out = None
    for chosen in passes:
        loaded = segments.where(F.col("part").between(chosen[0], chosen[-1])) if chosen else segments.limit(0)
        read = {r.part: (r.size, bytes(r.bits)) for r in loaded.select("part", "size", "bits").toLocalIterator()}
        score = scorer(spark.sparkContext.broadcast(LogFrequencyFilter(read, parts, probes)))
        one = dealt().groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, schema)
        out = one if out is None else out.unionByName(one)
    if len(passes) > 1:
        # A bucket holds its rows in no stated order, so equal ids are told apart by their text's own figures.
        whole = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
        repeats = F.count(F.lit(1)) / len(passes)
        out = out.groupBy(*whole).agg(F.sum("score").alias("score"), repeats.alias("_same"))
        out = out.withColumn("score", F.col("score") / F.col("_same")).withColumn("_same", F.explode(F.sequence(F.lit(1), F.col("_same").cast("int"))))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
