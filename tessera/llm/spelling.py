"""Spelling variants: words one edit apart, found by probing edits against Bloom filters.

The vocabulary's words go into blocked Bloom filters, one shard per word length. Every word then generates its edits
(each code point deleted, each replaced by a greater one of the vocabulary's alphabet; insertions and
replacements by a smaller one are the same pairs seen from the other word) as rolling hashes, each in constant time, and probes
the shard of the edit's length. Only positives are shuffled: they meet the exact vocabulary by hash, and the
words themselves confirm the pair. So false positives of the filters and equal hashes change nothing.

Shards are broadcast in passes of at most ``broadcast_bytes``, in order of length. A pass reads the words of its
lengths and of one more; a shard over the bound is cut into ranges of blocks, each a pass.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filled, mixed
from tessera.session import materialise

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BASE = 0x9E3779B97F4A7C15
UNDO = np.uint64(pow(BASE, -1, 1 << 64))
BASE = np.uint64(BASE)
WORDS = 8  # 64-bit words of a block; a key sets three bits in each of two of them
KEYS = 32  # keys of a block, so 16 bits a key
SLICE = 4096  # blocks that one group fills
BROADCAST_BYTES = 64 << 20
TASK_PROBES = 20_000_000
LETTERS = 1 << 20  # letters whose edits are held at a time
EDITS = 1 << 20
FLUSH_WORDS = 200_000


# -- words -------------------------------------------------------------------------------------
def word_counts(docs: DataFrame, least_length: int = 7, noise: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): how often each word of ``least_length`` code points or more occurs in the texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lowered. With ``noise`` some occurrences lose a
    letter before they are counted: h is the unsigned crc32 of ``<id>:<word>``, and where ``noise`` divides h the
    code point h % length goes (a null id is the empty string there). Null and empty texts have no words.
    """
    run = re.compile("[a-zÀ-ÿ]{%d,}" % max(1, least_length))

    def flush(seen: Counter):
        words = [w for w in seen if len(w) >= least_length]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])

    def garbled(word: str, begin: int) -> str:
        h = zlib.crc32(word.encode(), begin)
        if h % noise:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for doc_id, raw in zip(*(batch.column(i) for i in (0, 1))):
                words = run.findall(raw.as_py().translate(LOWER).decode())
                if noise:
                    begin = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                    for word, n in Counter(words).items():
                        seen[garbled(word, begin)] += n
                else:
                    seen.update(words)
                if len(seen) >= FLUSH_WORDS:
                    yield flush(seen)
                    seen = Counter()
        if seen:
            yield flush(seen)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), filled(F.col(text)).cast("binary").alias("raw"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Letters:
    """Code points of many words, end to end, with what their rolling hashes need."""

    def __init__(self, words: list[str]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.codes)) - self.begin[self.owner]
        powers = np.full(int(self.sizes.max(initial=0)) + 1, BASE)
        powers[0] = 1
        self.power = np.cumprod(powers)[place]
        self.value = letter_values(self.codes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value * self.power)])
        self.before = sums[:-1] - sums[self.begin[self.owner]]
        self.upto = sums[1:] - sums[self.begin[self.owner]]
        self.hash = sums[self.begin + self.sizes] - sums[self.begin]

    def deletions(self):
        """(owner, hash of the word without one letter) for every letter."""
        return self.owner, self.before + (self.hash[self.owner] - self.upto) * UNDO

    def replacements(self, alphabet: np.ndarray):
        """The same for every letter replaced by each greater one of the sorted alphabet, in bounded portions."""
        values = letter_values(alphabet)
        order = np.argsort(self.codes, kind="stable")
        codes, first = np.unique(self.codes[order], return_index=True)
        for code, group in zip(codes.tolist(), np.split(order, first[1:])):
            greater = values[np.searchsorted(alphabet, code, side="right") :]
            if not len(greater):
                continue
            change = greater - letter_values(np.array([code], np.uint32))
            step = max(1, EDITS // len(greater))
            for i in range(0, len(group), step):
                some = group[i : i + step]
                owner = self.owner[some]
                edits = self.hash[owner][:, None] + change[None, :] * self.power[some][:, None]
                yield np.repeat(owner, len(greater)), edits.ravel()


def letter_values(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D))


def portions(words: list[str]):
    """The words in runs of about LETTERS letters, with the index of the first."""
    at = size = 0
    for i, word in enumerate(words):
        size += len(word)
        if size >= LETTERS or i == len(words) - 1:
            yield at, words[at : i + 1]
            at, size = i + 1, 0


# -- filters -----------------------------------------------------------------------------------
def blocks_for(keys: int) -> int:
    return -(-keys // KEYS)


def places(hashes: np.ndarray, blocks: np.ndarray):
    """Block of each hash, the two words in it and the three bits in either."""
    h = mixed(hashes)
    block = ((h >> np.uint64(32)) * blocks.astype(np.uint64)) >> np.uint64(32)
    one = np.uint64(1)
    word = (h & np.uint64(7), ((h & np.uint64(7)) + one + (h >> np.uint64(3)) % np.uint64(7)) & np.uint64(7))
    g = mixed(h + BASE)
    bits = []
    for k in (0, 18):
        masks = [one << ((g >> np.uint64(k + 6 * j)) & np.uint64(63)) for j in range(3)]
        bits.append(masks[0] | masks[1] | masks[2])
    return block.astype(np.int64), word, bits


def filter_slices(vocabulary: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(length, slice, bits): the filters of the lengths in ``blocks``, filled a slice of blocks at a time."""
    spark, per_slice = vocabulary.sparkSession, SLICE
    sizes = spark.createDataFrame(sorted(blocks.items()), "length int, blocks long")

    def placed(batches):
        for batch in batches:
            length, h, many = (batch.column(i).to_numpy() for i in range(3))
            block, _, _ = places(h.view(np.uint64), many)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(block // per_slice), pa.array(h), pa.array(many)], names=["length", "slice", "h", "blocks"])

    def fill(keys: pa.Table) -> pa.Table:
        h, many = (keys.column(c).combine_chunks().to_numpy() for c in ("h", "blocks"))
        block, word, bits = places(h.view(np.uint64), many)
        part = keys.column("slice")[0].as_py()
        held = np.zeros(min(per_slice, int(many[0]) - part * per_slice) * WORDS, np.uint64)
        for w, mask in zip(word, bits):
            np.bitwise_or.at(held, (block - part * per_slice) * WORDS + w.astype(np.int64), mask)
        return pa.table({"length": keys.column("length")[:1], "slice": pa.array([part]), "bits": pa.array([held.tobytes()], pa.binary())})

    keyed = vocabulary.select("length", "h").join(F.broadcast(sizes), "length").select("length", "h", "blocks")
    keyed = keyed.mapInArrow(placed, "length int, slice long, h long, blocks long")
    return keyed.groupBy("length", "slice").applyInArrow(fill, "length int, slice long, bits binary")


def passes(blocks: dict[int, int], most: int) -> list[list[tuple[int, int, int]]]:
    """(length, first block, end block) ranges in order of length, in groups of at most ``most`` blocks.

    Ranges begin at slices, so ``most`` is taken as a whole number of slices, one at least.
    """
    most = max(1, most // SLICE) * SLICE
    out, room = [], 0
    for length in sorted(blocks):
        for begin in range(0, blocks[length], most):
            end = min(begin + most, blocks[length])
            if not out or end - begin > room:
                out.append([])
                room = most
            out[-1].append((length, begin, end))
            room -= end - begin
    return out


class Filters:
    """The block ranges of one pass, laid end to end, and the tables that lead from a length to its range."""

    def __init__(self, ranges: list[tuple[int, int, int]], blocks: dict[int, int]):
        longest = max(length for length, _, _ in ranges) + 2
        self.blocks, self.begin, self.end, self.base = (np.zeros(longest, np.int64) for _ in range(4))
        at = 0
        for length, begin, end in ranges:
            self.blocks[length], self.begin[length], self.end[length], self.base[length] = blocks[length], begin, end, at - begin
            at += end - begin
        self.bits = np.zeros(at * WORDS, np.uint64)

    def put(self, length: int, part: int, data: bytes) -> None:
        at = (self.base[length] + part * SLICE) * WORDS
        slots = np.frombuffer(data, np.uint64)
        self.bits[at : at + len(slots)] = slots

    def lengths(self) -> list[int]:
        return np.flatnonzero(self.end).tolist()

    def positive(self, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that the shards of their lengths hold; lengths of no range hold nothing."""
        lengths = np.where(lengths < len(self.end), lengths, 0)
        some = np.flatnonzero(self.end[lengths] > 0)
        lengths, hashes = lengths[some], hashes[some]
        block, word, bits = places(hashes, self.blocks[lengths])
        here = np.flatnonzero((block >= self.begin[lengths]) & (block < self.end[lengths]))
        at = (block[here] + self.base[lengths[here]]) * WORDS
        for w, mask in zip(word, bits):
            held = (self.bits[at + w[here].astype(np.int64)] & mask[here]) == mask[here]
            at, here = at[held], here[held]
        return some[here]


# -- neighbours --------------------------------------------------------------------------------
def with_hashes(words: DataFrame) -> DataFrame:
    """(word, n, length, h)."""

    def add(batches):
        for batch in batches:
            listed = batch.column(0).to_pylist()
            done = [Letters(some) for _, some in portions(listed)]
            sizes, hashes = (np.concatenate([getattr(d, c) for d in done]) if done else np.empty(0, t) for c, t in (("sizes", np.int64), ("hash", np.uint64)))
            arrays = [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(hashes.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "n", "length", "h"])

    return words.select("word", "n").mapInArrow(add, "word string, n long, length int, h long")


def near_pairs(vocabulary: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words one edit apart once; ``vocabulary`` is a written (word, n, length, h)."""
    spark = vocabulary.sparkSession
    counted = {r.length: r.n for r in vocabulary.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    alphabet = _alphabet(vocabulary)
    blocks = {length: blocks_for(n) for length, n in counted.items()}
    found = None
    groups = passes(blocks, broadcast_bytes // (8 * WORDS))
    for ranges in groups:
        held = Filters(ranges, blocks)
        lengths = held.lengths()
        slices = filter_slices(vocabulary.where(F.col("length").isin(lengths)), {x: blocks[x] for x in lengths})
        inside = F.lit(False)
        for length, begin, end in ranges:
            inside |= (F.col("length") == length) & F.col("slice").between(begin // SLICE, (end - 1) // SLICE)
        for r in slices.where(inside).toLocalIterator():
            held.put(r.length, r.slice, bytes(r.bits))
        probing = sorted(set(lengths) | {x + 1 for x in lengths})
        letters = sum(x * counted.get(x, 0) for x in probing)
        tasks = max(1, -(-letters * (1 + len(alphabet) // 2) // TASK_PROBES))
        words = vocabulary.where(F.col("length").isin(probing)).select("word", "h").repartition(tasks, "h")
        positive = words.mapInArrow(_prober(spark.sparkContext.broadcast((held, alphabet))), "source long, edit long")
        if len(groups) > 1:
            positive = materialise(positive, "edits")
        found = positive if found is None else found.unionByName(positive)
    if found is None:
        found = spark.createDataFrame([], "source long, edit long")
    b = vocabulary.select(F.col("h").alias("edit"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    a = vocabulary.select(F.col("h").alias("source"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    pairs = found.distinct().join(b, "edit").join(a, "source").select("a", "n_a", "b", "n_b")
    return pairs.mapInArrow(_confirmed, pairs.schema)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced; in time linear in the words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _confirmed(batches):
    for batch in batches:
        yield batch.filter(pa.array([one_edit(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())], pa.bool_()))


def _alphabet(vocabulary: DataFrame) -> np.ndarray:
    """Sorted code points of the vocabulary; their number is bounded by the characters that exist."""

    def used(batches):
        seen: set[str] = set()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                seen.update(word)
        yield pa.RecordBatch.from_arrays([pa.array([ord(c) for c in seen], pa.int32())], names=["code"])

    rows = vocabulary.select("word").mapInArrow(used, "code int").distinct().collect()
    return np.sort(np.array([r.code for r in rows], np.uint32))


def _prober(sent):
    def probe(batches):
        held, alphabet = sent.value
        for batch in batches:
            for _, words in portions(batch.column(0).to_pylist()):
                letters = Letters(words)
                owners, edits = [], []
                for shorter, (owner, h) in [(1, letters.deletions()), *((0, x) for x in letters.replacements(alphabet))]:
                    hit = held.positive(letters.sizes[owner] - shorter, h)
                    owners.append(owner[hit])
                    edits.append(h[hit])
                owner, h = np.concatenate(owners), np.concatenate(edits)
                order = np.lexsort((h, owner))  # a doubled letter gives the same edit twice
                owner, h = owner[order], h[order]
                first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])[: len(h)]
                source = letters.hash[owner[first]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(source), pa.array(h[first].view(np.int64))], names=["source", "edit"])

    return probe


# -- forms -------------------------------------------------------------------------------------
def variant_groups(words: DataFrame, ratio: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``words`` (word, n).

    ``n_near`` is the number of words exactly one inserted, deleted or replaced code point away. The form is the near
    word of the largest n (ties: the first in code-point order) if that n is ``ratio`` times the word's own or more, which must
    be over 1 times; else form and form_n are null. The root follows forms to the last, and is the word itself
    without one. Repeated words count together, null words and other columns are ignored, and an empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms could lead in circles")
    counted = words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    vocabulary = materialise(with_hashes(counted), "vocabulary")
    pairs = near_pairs(vocabulary, broadcast_bytes)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))
    near = pairs.select(F.explode(sides).alias("s")).groupBy("s.word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("s.n")).alias("n"), F.col("s.near").alias("near"))).alias("best")
    )
    rows = vocabulary.select("word", "n").join(near, "word", "left")
    follows = -F.col("best.n") >= ratio * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.n")).alias("form_n"),
    )
    rows = materialise(rows, "forms")
    roots = _roots(rows.where("form is not null").select("word", F.col("form").alias("root")))
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """Every word's last form: roots jump to their roots' roots until none has one. Chains have few steps, as n grows by the ratio."""
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if step.where("next is not null").isEmpty():
            return step.select("word", "root")
        links = step.select("word", "root")


# The registered query in SQL; the checksum is the table form of crc32 over the UTF-8 bytes of ASCII and U+00C0 to U+00FF.
VARIANTS_SQL = """
with recursive runs as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r from documents
), per_doc as (
  select doc_id, r, count(*) as k, coalesce(cast(doc_id as varchar), '') || ':' || r as s from runs where length(r) >= 7 group by doc_id, r
), crc as (
  select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) order by b) as t
  from range(256) as u(b)
), hashed as (
  select r, k, xor(list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(string_split(s, ''), lambda x:
      if(unicode(x) < 128, [unicode(x)::bigint], [195::bigint, unicode(x)::bigint - 64])))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) as h
  from per_doc, crc
), words as (
  select case when h % 31 = 0 then left(r, h % length(r)) || substr(r, h % length(r) + 2) else r end as word, k from hashed
), vocab as (
  select word, cast(sum(k) as bigint) as n from words where length(word) >= 7 group by word having sum(k) >= 2
), places as (
  select word, n, unnest(range(length(word))) as i from vocab
), cut as (
  select word, n, left(word, i) || '*' || substr(word, i + 2) as wild, left(word, i) || substr(word, i + 2) as shorter from places
), pairs as (
  select a.word as a, a.n as n_a, b.word as b, b.n as n_b from cut a join cut b on a.wild = b.wild and a.word <> b.word
  union select cut.word, cut.n, v.word, v.n from cut join vocab v on cut.shorter = v.word
  union select v.word, v.n, cut.word, cut.n from cut join vocab v on cut.shorter = v.word
), near as (
  select a as word, count(*) as n_near, arg_min(b, (-n_b, b)) as best, max(n_b) as best_n from pairs group by a
), forms as (
  select v.word, v.n, coalesce(n_near, 0) as n_near,
         case when best_n >= 10 * v.n then best end as form, case when best_n >= 10 * v.n then best_n end as form_n
  from vocab v left join near on v.word = near.word
), chain as (
  select word, form as root, 1 as steps from forms where form is not null
  union all
  select chain.word, forms.form, steps + 1 from chain join forms on chain.root = forms.word where forms.form is not null
), roots as (
  select word, arg_max(root, steps) as root from chain group by word
)
select forms.word, form, coalesce(root, forms.word) as root, n, n_near, form_n from forms left join roots on forms.word = roots.word
"""
