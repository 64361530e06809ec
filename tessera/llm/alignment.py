"""Alignment of two tokenizers' tokens by pointer jumping.

The texts of a batch lie end to end as bytes, so each tokenizer's tokens are a partition of one line. Every
token points to its farthest-right overlapping token (of equal ends, the first tokenizer's). Replacing all pointers by their pointers'
pointers doubles the way in every step, until each token points to its component's terminal token, which labels
the smallest group of tokens with common bounds.

How many documents link a pair of ids is counted over the corpus. Each document keeps its distinct linked pairs
with their numbers; the counts come back to them in broadcast segments of bounded size, so nothing but
pre-aggregated counts is shuffled. The vocabularies bound the number of pairs, and with it that of segments.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm.common import filled, ragged
from tessera.session import materialise

BATCH_BYTES = 1 << 20
SEGMENT_PAIRS = 4_000_000  # 17 bytes each are broadcast at a time
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


class ByteLevel:
    """Ids by a byte-level BPE file. Where its merges stand in order of their ids, a rank-table encoder gives the same ids faster.

    Encoders may disagree on characters that Unicode has added or moved, on rare controls and on white space outside
    ASCII; texts with such characters, or with runs without a blank too long for the rank-table encoder, go to the file's library.
    """

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the file kind's split pattern

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.bytes = _byte_level(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, split = spec["model"]["vocab"], spec["model"]["merges"], spec["pre_tokenizer"] or {}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        ordered = made == list(range(256, 256 + len(made))) and not spec["normalizer"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.ranked = None
        if ordered and plain:
            ranks = {self.bytes[i]: i for i in range(256 + len(made))}
            self.ranked = tiktoken.Encoding("ranks", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})
        old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
        self.odd = np.array([new(chr(c)) != old(chr(c)) or new(chr(c)) in ("Cn", "Cc", "Cf", "Zs", "Zl", "Zp") for c in range(0x110000)])
        self.odd[[ord(c) for c in "\t\n\r "]] = False
        self.rare = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|[^ \n]{300}|[ \n]{300}")

    def encode(self, text: str) -> list[int]:
        usual = self.ranked is not None and not self.rare.search(text)
        if usual and (text.isascii() or not self.odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()):
            return self.ranked.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class Pair:
    """Two tokenizers over the same bytes: a byte-level BPE file, fed a blank and the text, and a piece model, which adds the blank itself."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        self.a = ByteLevel(first)
        self.b = SentencePieceProcessor(model_file=second)
        self.bytes_a, self.bytes_b = self.a.bytes, _pieces(self.b)
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # How an id is written in the groups: followed by another of its side, or as the last.
        self.shown = np.array([f"{i}{end}" for table, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for end in ends for i in range(len(table))], object)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by either tokenizer; none where the tokens' bytes are not those of a blank and the text."""
        a = [self.a.encode(" " + t) for t in texts]
        b = self.b.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            want = b" " + text.encode()
            if not text or b"".join(map(self.bytes_a.__getitem__, a[i])) != want or b"".join(map(self.bytes_b.__getitem__, b[i])) != want:
                a[i], b[i] = [], []
        return a, b


def _byte_level(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level BPE file: printable characters stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(printable))
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    out = [b""] * (1 + max([*vocab.values(), *special]))
    for token, i in vocab.items():
        out[i] = special[i] if i in special else bytes(byte[c] for c in token)
    for i, content in special.items():
        out[i] = content
    return out


def _pieces(model: SentencePieceProcessor) -> list[bytes]:
    one = re.compile("<0x([0-9A-Fa-f]{2})>")
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [bytes([int(m[1], 16)]) if model.is_byte(i) and (m := one.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Terminal token of every token of two partitions of a line, first those of a, then those of b.

    ``ends_*`` are the tokens' sorted ends, the last of both equal. The terminal is the a token whose end bounds the group.
    """
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # the b token that holds the last byte of an a token
    over_b = np.searchsorted(ends_a, ends_b)
    farther = ends_b[over_a] > ends_a
    pointer = np.concatenate([np.where(farther, n + over_a, np.arange(n)), over_b])
    while True:
        further = pointer[pointer]
        if (further == pointer).all():
            return pointer
        pointer = further


def aligned(machine: Pair, ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of ALIGNED for some documents."""
    a, b = machine.encode(texts)
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    flat_a, flat_b = (np.fromiter(chain.from_iterable(some), np.int64, int(n.sum())) for some, n in ((a, n_a), (b, n_b)))
    doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
    ends_a, ends_b = np.cumsum(machine.size_a[flat_a]), np.cumsum(machine.size_b[flat_b])
    label = terminals(ends_a, ends_b)
    last = label[: len(flat_a)] == np.arange(len(flat_a))
    ended, group = np.flatnonzero(last), np.cumsum(last)[label] - 1
    group_a, group_b = group[: len(flat_a)], group[len(flat_a) :]
    n_groups = np.bincount(doc_a[ended], minlength=len(texts))

    # Groups as text: the a tokens of a group, then its b tokens.
    in_a, in_b = np.bincount(group_a, minlength=len(ended)), np.bincount(group_b, minlength=len(ended))
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    at_a = np.arange(len(flat_a)) + (upto_b - in_b)[group_a]
    at_b = np.arange(len(flat_b)) + upto_a[group_b]
    many_a, many_b = len(machine.bytes_a), len(machine.bytes_b)
    last_a, last_b = np.arange(len(flat_a)) == upto_a[group_a] - 1, np.arange(len(flat_b)) == upto_b[group_b] - 1
    shown = np.empty(len(flat_a) + len(flat_b), np.int64)
    shown[at_a] = flat_a + many_a * last_a
    shown[at_b] = 2 * many_a + flat_b + many_b * last_b
    parts = machine.shown[shown].tolist()
    bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    groups = ["".join(parts[s:e])[:-1] for s, e in zip(bounds[:-1], bounds[1:])]

    # Links: between neighbouring ends of either side one a token lies over one b token.
    over = []
    for ends in (ends_a, ends_b):
        here = np.zeros(int(ends_a[-1]) if len(ends_a) else 0, bool)
        here[ends - 1] = True
        over.append((here, np.cumsum(here) - here))
    (here_a, token_a), (here_b, token_b) = over
    cuts = np.flatnonzero(here_a | here_b)
    link_a, link_b = token_a[cuts], token_b[cuts]
    owner, pairs = doc_a[link_a], many_a * many_b
    n_links = np.bincount(owner, minlength=len(texts))
    linked = np.sort(owner * pairs + flat_a[link_a] * many_b + flat_b[link_b])
    owner, pair = linked // pairs, linked % pairs
    first = np.flatnonzero(np.concatenate([[True], linked[1:] != linked[:-1]])[: len(linked)])
    times = np.diff(np.append(first, len(pair))).astype(np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(texts)))]), pa.int32())
    columns = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)), pa.array(groups, pa.string())]
    columns += [pa.ListArray.from_arrays(offsets, pa.array(pair[first])), pa.ListArray.from_arrays(offsets, pa.array(times))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])


def align(docs: DataFrame, first: str, second: str, digest: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """ALIGNED for every row: its tokens' numbers, groups as text, and distinct linked pairs with how often each is linked.

    A pair is a * (size of b's vocabulary) + b. With ``digest`` the groups are the SHA-256 of that text, '' without tokens.
    Texts that are null, empty or not given back byte for byte by both tokenizers have no tokens. Rows are independent: repeated rows
    and null ids are returned as they come, other columns are not read. Both files must be readable on the executors.
    """

    def run(batches):
        machine = Pair(first, second)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = size = 0
            for i, x in enumerate(texts):
                size += len(x)
                if size < BATCH_BYTES and i + 1 < len(texts):
                    continue
                out = aligned(machine, ids[at : i + 1], texts[at : i + 1])
                if digest:
                    shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in out.column(5).to_pylist()]
                    out = out.set_column(5, "groups", pa.array(shas, pa.string()))
                yield out
                at, size = i + 1, 0

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), filled(F.col(text)).alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame, many_b: int) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether that is the most of all pairs of its a id."""
    counted = materialise(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / F.lit(many_b)).cast("long")
    most = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counted.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(rows: DataFrame, counts: DataFrame, segment_pairs: int = SEGMENT_PAIRS) -> DataFrame:
    """The columns of ``rows`` without pairs, plus n_best and count_sum over all links.

    ``rows`` and ``counts`` are written tables. Counts come a segment of about ``segment_pairs`` pairs at a time; pairs that a
    segment resolved leave the rows, which are written between segments.
    """
    spark = rows.sparkSession
    segments = max(1, -(-counts.count() // segment_pairs))
    fixed = [c for c in rows.columns if c not in ("pairs", "times")]
    rows = rows.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    schema = rows.schema
    for s in range(segments):
        listed = counts.where(F.pmod(F.xxhash64("pair"), F.lit(segments)) == s).toArrow()
        known = [listed.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")]
        known = tuple(c[np.argsort(known[0])] for c in known)
        rows = rows.mapInArrow(_scorer(spark.sparkContext.broadcast(known)), schema)
        if s + 1 < segments:
            rows = materialise(rows, "scored")
    return rows.select(*fixed, "n_best", "count_sum")


def _scorer(sent):
    def score(batches):
        pairs, counts, best = sent.value
        for batch in batches:
            at = {name: batch.schema.get_field_index(name) for name in ("pairs", "times", "n_best", "count_sum")}
            (pair, offsets), (times, _) = ragged(batch.column(at["pairs"])), ragged(batch.column(at["times"]))
            pair, times, offsets = pair[offsets[0] : offsets[-1]], times[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]
            where = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            found = pairs[where] == pair if len(pairs) else np.zeros(len(pair), bool)
            gains = {"n_best": times * (found & best[where]) if len(pairs) else times * 0, "count_sum": times * np.where(found, counts[where], 0) if len(pairs) else times * 0}
            columns = list(batch.columns)
            for name, gain in gains.items():
                sums = np.concatenate([[0], np.cumsum(gain)])
                columns[at[name]] = pa.array(columns[at[name]].to_numpy() + sums[offsets[1:]] - sums[offsets[:-1]])
            left = np.concatenate([[0], np.cumsum(~found)])[offsets].astype(np.int32)
            for name, values in (("pairs", pair), ("times", times.astype(np.int32))):
                columns[at[name]] = pa.ListArray.from_arrays(pa.array(left), pa.array(values[~found]))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return score


def alignment_scores(docs: DataFrame, first: str, second: str, segment_pairs: int = SEGMENT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) for every row of ``docs``; see ``align``.

    ``groups`` is a SHA-256. ``n_best`` counts links whose pair is linked in as many documents as any pair of its a id, ties included;
    ``count_sum`` adds up the pairs' document counts over the links. Each row is a document. An empty table gives no rows.
    """
    rows = materialise(align(docs, first, second, digest=True), "aligned")
    many_b = SentencePieceProcessor(model_file=second).get_piece_size()
    counts = materialise(pair_counts(rows, many_b), "pair-counts")
    return link_scores(rows, counts, segment_pairs)
