"""Reversible line dedup: exact reference counts of lines behind sharded cuckoo filters.

The reference-count table holds, for every line key of the corpus, in how many documents it occurs. Keys
of ``min_docs`` documents or more are *frequent*; they also sit in cuckoo filters, one per shard of the key
hash. Adding documents raises counts and puts the keys that become frequent into their shard's filter;
deleting documents lowers counts and takes the keys that stop being frequent out of it, which a Bloom
filter could not do. After a deletion the index cleans as if the documents had never been added.

Cleaning asks the broadcast filters for every line, without a shuffle. All lines asked for are known to the table, so
its infrequent keys that the filters hold by mistake are listed once and sent along: answers are exact.
Filters and lists beyond ``broadcast_bytes`` are not sent: the lines' hashes then meet the frequent keys in a join.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import filled, mixed
from tessera.session import materialise

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLANK = b"\x20\t\n\x0b\x0c\r"
SLOTS = 4  # fingerprints of a bucket
FULLEST = 0.84  # share of a new filter's slots in use
KICKS = 500
SHARD_KEYS = 1 << 17
FLUSH_KEYS = 200_000
BROADCAST_BYTES = 64 << 20


# -- cuckoo filter -----------------------------------------------------------------------------
def fingerprints(hi: np.ndarray) -> np.ndarray:
    """16-bit fingerprints, never 0, which marks a free slot."""
    return np.maximum(mixed(hi) & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)


def jump(prints: np.ndarray, buckets: int) -> np.ndarray:
    """What leads from either bucket of a fingerprint to the other one."""
    return (mixed(prints.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(buckets - 1)).astype(np.int64)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; each key has two buckets. Holds a multiset of fingerprints."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, hi: np.ndarray) -> CuckooFilter:
        """A filter of distinct keys, as large as they need."""
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, len(hi)) / (SLOTS * FULLEST)))))
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if made.insert(hi):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def places(self, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints, buckets = fingerprints(hi), len(self.table)
        first = (hi & np.uint64(buckets - 1)).astype(np.int64)
        return prints, first, first ^ jump(prints, buckets)

    def contains(self, hi: np.ndarray) -> np.ndarray:
        prints, first, second = self.places(hi)
        return (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)

    def insert(self, hi: np.ndarray) -> bool:
        """Put keys in, all of a round at once; False if some found no place, and the filter is then void.

        What does not fit into its bucket moves on to its other one; the first such fingerprint of a bucket
        takes a slot there and sends that slot's owner on in its stead. The order of the keys decides, so sorted keys
        always give the same filter.
        """
        prints, at, _ = self.places(hi)
        for turn in range(KICKS):
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
            place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            taken = self.table[at] != 0
            fits = place < SLOTS - taken.sum(1)
            free = np.argsort(taken, axis=1, kind="stable")
            self.table[at[fits], free[fits, place[fits]]] = prints[fits]
            lead = (place == 0)[~fits]
            prints, at = prints[~fits].copy(), at[~fits]
            if not len(prints):
                return True
            if turn:  # both buckets were tried: throw out
                slot = (prints[lead].astype(np.int64) + turn) % SLOTS
                out = self.table[at[lead], slot]
                self.table[at[lead], slot] = prints[lead]
                prints[lead] = out
            at = at ^ jump(prints, len(self.table))
        return False

    def remove(self, hi: np.ndarray) -> None:
        """Take out keys that were put in."""
        for mark, *buckets in zip(*(x.tolist() for x in self.places(hi))):
            for bucket in buckets:
                slot = np.flatnonzero(self.table[bucket] == mark)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break
            else:
                raise ValueError("key is not in the filter")

    def load_factor(self, more: int = 0) -> float:
        return (np.count_nonzero(self.table) + more) / self.table.size


# -- lines -------------------------------------------------------------------------------------
def line_keys(raw: bytes) -> list[bytes]:
    """Keys of a text's lines: ASCII white space stripped at both ends, ASCII capitals lowered."""
    return [line.strip(BLANK) for line in raw.translate(LOWER).split(b"\n")]


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every key, in halves."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _numbers(batch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def reference_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hi, lo, n): in how many rows a line key occurs; blank lines have no key. Counts are combined in each task first."""

    def flush(seen: Counter):
        hi, lo = hashes(list(seen))
        n = np.fromiter(seen.values(), np.int64, len(seen))
        return pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(n)], names=["hi", "lo", "n"])

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0):
                seen.update(set(line_keys(raw.as_py())))
                if len(seen) >= FLUSH_KEYS:
                    seen.pop(b"", None)
                    yield flush(seen)
                    seen = Counter()
        seen.pop(b"", None)
        if seen:
            yield flush(seen)

    rows = docs.select(filled(F.col(text)).cast("binary").alias("raw"))
    return rows.mapInArrow(count, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


# -- index -------------------------------------------------------------------------------------
@dataclass(frozen=True)
class LineIndex:
    """One state of the index: written tables, so that every state stays readable after the next is made.

    ``counts`` (hi, lo, n) and ``filters`` (shard, slots); the shard of a key is the upper ``shard_bits`` bits of hi.
    """

    spark: SparkSession
    counts: DataFrame
    filters: DataFrame
    min_docs: int
    shard_bits: int
    n_frequent: int
    broadcast_bytes: int = BROADCAST_BYTES

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> LineIndex:
        """The index of all rows of ``docs``; each row is a document, also where ids repeat or are null."""
        counts = materialise(reference_counts(docs, text), "line-counts")
        state = counts.withColumn("old", F.lit(0).cast("long"))
        return cls._next(state, None, min_docs, broadcast_bytes)

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(reference_counts(docs, text))

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """The index without ``docs``, which must have been put in with these texts; otherwise ValueError."""
        return self._changed(reference_counts(docs, text).withColumn("n", -F.col("n")))

    def _changed(self, delta: DataFrame) -> LineIndex:
        zero = F.lit(0).cast("long")
        both = self.counts.withColumn("old", F.col("n")).unionByName(delta.withColumn("old", zero))
        state = materialise(both.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.sum("old").alias("old")), "line-counts")
        if not state.where("n < 0").isEmpty():
            raise ValueError("delete got lines that the index does not hold")
        return self._next(state, self, self.min_docs, self.broadcast_bytes)

    @classmethod
    def _next(cls, state: DataFrame, before: LineIndex | None, min_docs: int, broadcast_bytes: int) -> LineIndex:
        """Filters for ``state`` (hi, lo, n, old): changed in place while the shards stay, made anew otherwise."""
        spark = state.sparkSession
        n_frequent = state.where(F.col("n") >= min_docs).count()
        bits = max(0, int(np.ceil(np.log2(max(1, n_frequent) / SHARD_KEYS))))
        keep = before is not None and before.shard_bits == bits
        live, was = F.col("n") >= min_docs, (F.col("old") >= min_docs) if keep else F.lit(False)
        shard = F.shiftrightunsigned("hi", 64 - bits) if bits else F.lit(0).cast("long")
        moved = state.where(live | was).select(shard.alias("shard"), "hi", live.alias("live"), was.alias("was"))
        found = pa.schema([("shard", pa.int64()), ("slots", pa.binary())])

        def updated(shard_id: int, old: list[bytes], keys: pa.Table):
            order = np.argsort(_numbers(keys, "hi"))
            hi = _numbers(keys, "hi")[order].view(np.uint64)
            now, then = _numbers(keys, "live")[order].astype(bool), _numbers(keys, "was")[order].astype(bool)
            kept = CuckooFilter.load(old[0]) if old else None
            if kept is not None:
                kept.remove(hi[then & ~now])
                fresh = hi[now & ~then]
                if kept.load_factor(len(fresh)) > 0.95 or not kept.insert(fresh):
                    kept = None
            kept = kept or CuckooFilter.of(hi[now])
            return pa.Table.from_arrays([pa.array([shard_id]), pa.array([kept.table.tobytes()], pa.binary())], schema=found)

        if keep:

            def change(left: pa.Table, right: pa.Table) -> pa.Table:
                shard_id = (left if left.num_rows else right).column("shard")[0].as_py()
                return updated(shard_id, left.column("slots").to_pylist(), right)

            filters = before.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(change, "shard long, slots binary")
        else:

            def make(keys: pa.Table) -> pa.Table:
                return updated(keys.column("shard")[0].as_py(), [], keys)

            filters = moved.groupBy("shard").applyInArrow(make, "shard long, slots binary")
        filters = materialise(filters, "line-filters")
        counts = state.where("n > 0").select("hi", "lo", "n")
        return cls(spark, counts, filters, min_docs, bits, n_frequent, broadcast_bytes)

    def save(self, path: str) -> None:
        """Write this state to a folder of its own."""
        self.counts.write.parquet(f"{path}/counts")
        self.filters.write.parquet(f"{path}/filters")
        meta = [(self.min_docs, self.shard_bits, self.n_frequent, self.broadcast_bytes)]
        self.spark.createDataFrame(meta, "min_docs int, shard_bits int, n_frequent long, broadcast_bytes long").write.parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        meta = spark.read.parquet(f"{path}/meta").first()
        return cls(spark, spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/filters"), *meta)

    # -- cleaning ------------------------------------------------------------------------------
    def clean(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """(doc_id, text, n_lines, n_dropped) for every row: its text without the lines whose key is frequent.

        The rows must be in the index. A null or empty text is one empty line and comes back empty; blank lines have
        no key and stay; a text may lose all its lines. Repeated rows and null ids are returned as they come; other columns
        are not read.
        """
        raw = filled(F.col(text)).cast("binary")
        rows = docs.select(F.col(key).cast("long").alias("doc_id"), raw.alias("raw"))
        size = self.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
        if size <= self.broadcast_bytes:
            sure = self._sure(size)
            if sure is not None:
                return rows.mapInArrow(_cleaner(sure), CLEANED)
        return self._clean_by_join(rows)

    def _sure(self, size: int):
        """Broadcast (shard bits, filters, keys held by mistake), or None where that is over the size bound."""
        tables = {r.shard: CuckooFilter.load(bytes(r.slots)) for r in self.filters.toLocalIterator()}
        held = self.spark.sparkContext.broadcast((self.shard_bits, tables))

        def probe(batches):
            bits, filters = held.value
            for batch in batches:
                positive = asked(bits, filters, _numbers(batch, "hi").view(np.uint64))
                yield batch.filter(pa.array(positive))

        wrong = self.counts.where(F.col("n") < self.min_docs).select("hi", "lo").mapInArrow(probe, "hi long, lo long")
        wrong = materialise(wrong, "line-mistakes")
        if size + 16 * wrong.count() > self.broadcast_bytes:
            return None
        listed = wrong.toArrow().combine_chunks()
        mistakes = np.stack([listed.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")])
        return self.spark.sparkContext.broadcast((self.shard_bits, tables, mistakes[:, np.lexsort(mistakes[::-1])]))

    def _clean_by_join(self, rows: DataFrame) -> DataFrame:
        """The same without filters: the hashes of each distinct text's lines meet the frequent keys, by text digest."""
        rows = rows.withColumn("digest", F.xxhash64("raw")).withColumn("digest2", F.xxhash64(F.lit(1), "raw"))

        def split(batches):
            for batch in batches:
                keys = [list(set(line_keys(raw)) - {b""}) for raw in batch.column(0).to_pylist()]
                sizes = [len(k) for k in keys]
                names = [np.repeat(_numbers(batch, c), sizes) for c in ("digest", "digest2")]
                halves = [h.view(np.int64) for h in hashes([k for some in keys for k in some])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in names + halves], names=["digest", "digest2", "hi", "lo"])

        distinct = ["digest", "digest2", "hi", "lo"]
        asked_for = rows.select("raw", "digest", "digest2").mapInArrow(split, "digest long, digest2 long, hi long, lo long").distinct()
        frequent = self.counts.where(F.col("n") >= self.min_docs).select("hi", "lo")
        hits = asked_for.join(frequent, ["hi", "lo"], "left_semi").select(*distinct)
        hits = hits.groupBy("digest", "digest2").agg(F.collect_list(F.struct("hi", "lo")).alias("found"))
        matched = rows.join(hits, ["digest", "digest2"], "left").select("doc_id", "raw", F.col("found.hi").alias("hi"), F.col("found.lo").alias("lo"))

        def drop(batches):
            for batch in batches:
                out = []
                for doc_id, raw, his, los in zip(*(c.to_pylist() for c in batch.columns)):
                    found = set(zip(his or (), los or ()))
                    keys = line_keys(raw)
                    hi, lo = hashes(keys)
                    gone = [bool(k) and pair in found for k, pair in zip(keys, zip(hi.view(np.int64).tolist(), lo.view(np.int64).tolist()))]
                    out.append((doc_id, *_kept(raw, gone)))
                yield _cleaned(out)

        return matched.mapInArrow(drop, CLEANED)


CLEANED = "doc_id long, text string, n_lines long, n_dropped long"


def asked(bits: int, filters: dict[int, CuckooFilter], hi: np.ndarray) -> np.ndarray:
    """Which keys the filters of their shards hold."""
    out = np.zeros(len(hi), bool)
    shard = (hi >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hi), np.int64)
    for s, held in filters.items():
        here = np.flatnonzero(shard == s)
        out[here] = held.contains(hi[here])
    return out


def listed_in(mistakes: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted mistakes."""
    out = np.zeros(len(hi), bool)
    begin, end = np.searchsorted(mistakes[0], hi, "left"), np.searchsorted(mistakes[0], hi, "right")
    for step in range(int((end - begin).max(initial=0))):
        at = np.flatnonzero(begin + step < end)
        out[at] |= mistakes[1][begin[at] + step] == lo[at]
    return out


def _kept(raw: bytes, gone: list[bool]) -> tuple[bytes, int, int]:
    n = sum(gone)
    if not n:
        return raw, len(gone), 0
    return b"\n".join(line for line, g in zip(raw.split(b"\n"), gone) if not g), len(gone), n


def _cleaned(rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, lines, dropped = zip(*rows) if rows else ((),) * 4
    arrays = [pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_lines", "n_dropped"])


def _cleaner(sure):
    def drop(batches):
        bits, filters, mistakes = sure.value
        for batch in batches:
            ids, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            split = [line_keys(raw) for raw in raws]
            distinct = list({k for keys in split for k in keys} - {b""})
            hi, lo = hashes(distinct)
            frequent = asked(bits, filters, hi)
            at = np.flatnonzero(frequent)
            frequent[at] = ~listed_in(mistakes, hi[at], lo[at])
            gone = {distinct[i] for i in np.flatnonzero(frequent)}
            yield _cleaned([(i, *_kept(raw, [k in gone for k in keys])) for i, raw, keys in zip(ids, raws, split)])

    return drop


# The registered query in SQL: ids are unique in the test tables.
LINES_SQL = """
with lines as (
  select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), frequent as (
  select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(f.k) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (f.k is null), '')) as kept_sha256
from keyed left join frequent f on keyed.k = f.k group by doc_id
"""
