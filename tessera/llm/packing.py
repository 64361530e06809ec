"""Packing token streams into fixed-length sequences by shortest-pack-first over the length histogram.

Documents are cut into full sequences and one tail. Only the histogram of piece lengths (at most
``limit`` numbers) reaches the driver: lengths are placed longest first, each into the shortest open
packs that still have room for it, as counts of packing patterns. Patterns find their pieces again by
rank: the r-th piece of a length belongs to the pattern slot whose rank interval holds r.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import filled, releasing
from tessera.session import materialise

PART_ROWS = 800  # pieces of one length that one task ranks
CACHE_PIECES = 600_000
LEARN = 4096  # pieces encoded in one call
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


PLANE = 0x10000


@lru_cache
def charset(pattern: str) -> str:
    """The characters below PLANE that a pattern of one character matches, as the ranges of a set: sets are tested faster."""
    match = re.compile(pattern).match
    fits = np.array([False, *(match(chr(c)) is not None for c in range(PLANE)), False])
    edges = np.flatnonzero(fits[1:] != fits[:-1]).reshape(-1, 2)
    return "[" + "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in edges.tolist()) + "]"


class WordTokenizer:
    """Ids of whole texts by a word-level BPE file, each distinct piece encoded once.

    The file's normaliser and split pattern work piece by piece, so a text is lowered and split here and
    only pieces not met before are encoded, many in one call on the task's own thread. Texts with a special token's string, or with a character that is not
    plainly a letter, a digit or a mark in every Unicode version and context, go to the library as a whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        # With the odd characters out of the way, \w without digits and _ are the letters and \d the numbers.
        kinds = r"[^\W\d_]", r"\d", r"(?:[^\s\w]|_)"
        self.split_any, self.split = (
            re.compile(f"{letter}+|{digit}|'(?:[stmd]|re|ve|ll)|{sign}+").findall for letter, digit, sign in (kinds, map(charset, kinds))
        )
        self.odd = np.array([unicodedata.category(chr(c)) in ("Cn", "Nl", "No") for c in range(0x110000)])
        self.odd[[ord(c) for c in "\x1c\x1d\x1e\x1fİΣ"]] = True
        self.marks = [*"\x1c\x1d\x1e\x1f", *(t.content for t in self.library.get_added_tokens_decoder().values())]
        self.known: dict[str, bytes] = {}
        self.most = CACHE_PIECES

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = []
        for text in texts:
            plain = text.isascii()
            if not plain and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            whole, split_text = any(m in text for m in self.marks), self.split
            if not plain:
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                whole = whole or self.odd[codes].any()
                if codes.max() >= PLANE:
                    split_text = self.split_any
            split.append(None if whole else split_text(text.lower()))
        if len(self.known) > self.most:
            self.known = {}
        out: list[bytes | None] = []
        later = []  # texts with pieces not met before
        for i, (text, pieces) in enumerate(zip(texts, split)):
            try:
                out.append(self._whole(text) if pieces is None else self._joined(pieces))
            except KeyError:
                out.append(None)
                later.append(i)
        new = list(set().union(*(split[i] for i in later)).difference(self.known))
        for at in range(0, len(new), LEARN):
            self._learn(new[at : at + LEARN])
        for i in later:
            out[i] = self._joined(split[i])
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces in one call, as the words of a text; where the library counts other words, one by one."""
        found = self.library.encode(" ".join(pieces), add_special_tokens=False)
        ids, words = np.array(found.ids, "<u4"), np.array(found.word_ids)
        cuts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]]))
        if len(words) and np.array_equal(words[cuts[:-1]], np.arange(len(pieces))):
            raw, ends = ids.tobytes(), (4 * cuts).tolist()
            self.known.update(zip(pieces, (raw[s:e] for s, e in zip(ends[:-1], ends[1:]))))
        else:
            self.known.update((p, self._whole(p)) for p in pieces)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, pieces))


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker, so that pieces are encoded once per worker."""
    return WordTokenizer(path)


BATCH_CHARS = 1 << 20


def pieces_of(docs: DataFrame, path: str, limit: int, end_id: int, with_ids: bool, text: str, key: str, cached: int, keep: bool) -> DataFrame:
    """One row per piece: whole sequences of ``limit`` ids and a tail, over the ids and the end id."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * limit

    @releasing
    def cut(batches):
        tokenizer = tokenizer_of(path)
        tokenizer.most = cached
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            at = size = 0
            for i, x in enumerate(texts):
                size += len(x)
                if size < BATCH_CHARS and i + 1 < len(texts):
                    continue
                rows = []
                for doc_id, ids in zip(keys[at : i + 1], tokenizer.encode(texts[at : i + 1])):
                    ids += end
                    for s in range(0, len(ids), step):
                        piece = ids[s : s + step]
                        row = (doc_id, s // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                        rows.append(row + (np.frombuffer(piece, "<i4"),) if with_ids else row)
                at, size = i + 1, 0
                columns = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[5:]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])
        if not keep:
            tokenizer_of.cache_clear()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), filled(F.col(text)).alias("text"))
    return rows.mapInArrow(cut, PIECE + (", ids array<int>" if with_ids else ""))


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count) pairs that hold every length of the histogram exactly as often as it occurs.

    Lengths come longest first. Each goes to the shortest open packs, which have the most room left, as long
    as it fits there, a whole group of equal packs at a time; what fits nowhere opens packs of its own. A pack
    without room for the shortest length is closed.
    """
    open_packs: dict[int, Counter] = defaultdict(Counter)  # room left -> patterns and their counts
    done: Counter = Counter()
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            room = max(open_packs, default=0)
            if room < length:
                # as many equal pieces as a pack can take, so that they do not open a pack each
                per = limit // length
                packs, rest = divmod(left, per)
                for many, count in ((per, packs), (rest, 1)):
                    if many and count:
                        _keep(open_packs, done, (length,) * many, count, limit - many * length)
                break
            pattern = next(iter(open_packs[room]))
            fit = room // length
            take = min(open_packs[room][pattern], max(1, left // fit)) if left >= fit else 1
            many = min(fit, left)
            take = min(take, left // many)
            open_packs[room][pattern] -= take
            if not open_packs[room][pattern]:
                del open_packs[room][pattern]
                if not open_packs[room]:
                    del open_packs[room]
            left -= take * many
            _keep(open_packs, done, pattern + (length,) * many, take, room - many * length)
    for patterns in open_packs.values():
        done.update(patterns)
    return sorted(done.items(), reverse=True)


def _keep(open_packs, done, pattern, count, room) -> None:
    if room:
        open_packs[room][pattern] += count
    else:
        done[pattern] += count


def pack(
    docs: DataFrame, path: str, limit: int = 2048, end_id: int = 1, with_ids: bool = False, text: str = "text", key: str = "doc_id",
    cached: int = CACHE_PIECES, keep: bool = True,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece.

    Every row of ``docs`` is a document, also where ids repeat or are null; a null or empty text is its end id
    alone. Sequences hold at most ``limit`` ids and their pieces lie one behind the other from offset 0; sequence
    ids run from 0 without gaps. Equal pieces may change places between runs of the same data, nothing else. An empty
    table gives no rows. Other columns are not read. A Python worker remembers the ids of about ``cached`` distinct
    pieces; with ``keep`` it holds them and the tokenizer for its next task, otherwise it lets go of them after each.
    """
    spark = docs.sparkSession
    pieces = materialise(pieces_of(docs, path, limit, end_id, with_ids, text, key, cached, keep), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    packs = shortest_pack_first(histogram, limit)
    taken: Counter = Counter()
    slots, base = [], 0
    for pattern, count in packs:
        offset = 0
        for length in pattern:
            slots.append((length, taken[length], base, offset))
            taken[length] += count
            offset += length
        base += count
    slots.sort()
    plan = spark.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 4).T)

    parts = spark.createDataFrame([(n, -(-c // PART_ROWS)) for n, c in histogram.items()], "length long, parts long")
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts"))
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", spread).drop("parts")
    before = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(before, ["length", "part"])
    ranked = ranked.select(*pieces.columns, (F.col("place") + F.col("before")).alias("rank"))

    def place(batches):
        length, low, first, offset = plan.value
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted((length << 44) + low, (size << 44) + rank, side="right") - 1
            found = [pa.array(first[at] + rank - low[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + found, names=batch.schema.names[:-1] + ["sequence_id", "offset"])

    schema = PIECE + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
