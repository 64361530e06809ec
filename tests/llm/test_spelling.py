"""Spelling variants against brute force, and the filters that guide them."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import spelling
from tessera.llm.spelling import Filters, Letters, passes, variant_groups, with_hashes, word_counts


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    out, form = set(), {}
    around = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, some in around.items():
        best = min(some, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(around[w]), counts[form[w]] if w in form else None))
    return out


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeéß÷") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    out = {s: rng.choice([1, 1000, 1000, 90]) for s in stems}
    for stem in stems:
        for _ in range(6):
            i, c = rng.randrange(len(stem) + 1), rng.choice("abcdeéß÷")
            out.setdefault(rng.choice([stem[:i] + c + stem[i:], stem[:i] + c + stem[i + 1 :], stem[:i] + stem[i + 1 :] or c]), rng.randint(1, 120))
    # chains of three steps, ties of n, doubled letters, runs too long for a batch
    out |= {"chaina": 1, "chainb": 10, "chainbb": 100, "chainbbb": 1000, "tiexone": 50, "tieyone": 50, "tiezone": 5, "balloon": 30, "baloon": 3, "ballooon": 2}
    return out | {"x" * 30_000: 40, "x" * 29_999: 3, "x" * 1000 + "y" + "x" * 28_999: 2, "日本語学校": 20, "日本語学枚": 1}


@pytest.mark.parametrize("ratio", [2, 10])
def test_variants_equal_brute_force(spark, counts, ratio):
    rows = [(w, n, 1) for w, n in counts.items()] + [(None, 5, 1)]
    got = variant_groups(spark.createDataFrame(rows, "word string, n long, h int"), ratio)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    assert len(rows) == len(counts) and {tuple(r) for r in rows} == brute(counts, ratio)


def test_passes_of_small_filters_add_up(spark, counts, monkeypatch):
    """A bound of one slice of one block makes a pass of every length and cuts shards into ranges."""
    monkeypatch.setattr(spelling, "SLICE", 1)
    words = {w: n for w, n in counts.items() if 3 < len(w) < 7}
    many = {f"w{i:05d}": 2 + 40 * (i % 7 == 0) for i in range(200)}
    got = variant_groups(spark.createDataFrame(list((words | many).items()), "word string, n long"), broadcast_bytes=64)
    assert {tuple(r) for r in got.collect()} == brute(words | many)


def test_repeated_words_count_together_and_ratio_is_checked(spark):
    got = variant_groups(spark.createDataFrame([("aa", 6), ("aa", 4), ("ab", 1)], "word string, n long")).collect()
    assert {tuple(r) for r in got} == {("aa", None, "aa", 10, 1, None), ("ab", "aa", "aa", 1, 1, 10)}
    with pytest.raises(ValueError):
        variant_groups(spark.createDataFrame([("aa", 6)], "word string, n long"), ratio=1)


def test_empty_vocabulary(spark):
    assert variant_groups(spark.createDataFrame([], "word string, n long")).collect() == []


@pytest.mark.parametrize("noise", [None, 31, 2])
def test_word_counts(spark, noise):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Straßen", "ÉCOLES", "naïveté×÷", "abcdefg", "Abcdefgh", "x" * 50, "it's7even"]) for _ in range(30)) for _ in range(40)]
    rows = [*enumerate(texts), (3, texts[0]), (None, texts[1]), (7, None), (8, ""), (9, "longword " * 20_000)]
    got = word_counts(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int"), 7, noise).collect()
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    assert {r.word: r.n for r in got} == want and len(got) == len(want)


def test_edit_hashes_are_the_edits_own(counts):
    words = [w for w in counts if len(w) < 100]
    letters = Letters(words)
    alphabet = np.sort(np.array(sorted({ord(c) for w in words for c in w}), np.uint32))
    owner, h = letters.deletions()
    at = np.concatenate([np.arange(len(w)) for w in words])
    assert (h == Letters([words[o][:i] + words[o][i + 1 :] for o, i in zip(owner, at)]).hash).all()
    got = {(o, x) for owner, h in letters.replacements(alphabet) for o, x in zip(owner.tolist(), h.tolist())}
    edits = [(o, w[:i] + chr(c) + w[i + 1 :]) for o, w in enumerate(words) for i in range(len(w)) for c in alphabet.tolist() if c > ord(w[i])]
    assert got == {(o, x) for (o, _), x in zip(edits, Letters([e for _, e in edits]).hash.tolist())}


def test_filters_hold_their_words_and_little_else(spark):
    words = [f"{i:07d}" for i in range(20_000)]
    vocabulary = with_hashes(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).cache()
    blocks = {7: spelling.blocks_for(len(words))}
    (ranges,) = passes(blocks, 1 << 20)
    held = Filters(ranges, blocks)
    for r in spelling.filter_slices(vocabulary, blocks).collect():
        held.put(r.length, r.slice, bytes(r.bits))
    own, other = Letters(words).hash, Letters([f"{i:07x}g" for i in range(50_000)]).hash
    assert len(held.positive(np.full(len(own), 7), own)) == len(own)
    assert len(held.positive(np.full(len(own), 8), own)) == 0
    assert len(held.positive(np.full(len(other), 7), other)) < 0.01 * len(other)


def test_one_edit():
    words = ["", "a", "b", "ab", "ba", "aab", "abb", "abc", "acb", "abcd", "bcd", "aaa", "aaaa"]
    assert all(spelling.one_edit(a, b) == near(a, b) for a in words for b in words)


def test_passes_cover_every_block_once():
    blocks = {3: 1, 7: 9000, 9: 4096, 20: 5}
    for most in (1, 5000, 9000, 1 << 30):
        seen = Counter()
        for group in passes(blocks, most):
            assert sum(e - b for _, b, e in group) <= max(most, spelling.SLICE)
            for length, begin, end in group:
                assert begin % spelling.SLICE == 0
                seen.update((length, k) for k in range(begin, end))
        assert seen == {(length, k): 1 for length, n in blocks.items() for k in range(n)}
