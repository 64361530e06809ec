"""Line dedup against brute force, and its filters and index states."""

import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm.line_dedup import BLANK, LOWER, CuckooFilter, LineIndex, asked

DOCS = "doc_id long, text string, n_lines int, hi string"


def keys_of(text):
    return [line.strip(BLANK) for line in (text or "").encode().translate(LOWER).split(b"\n")]


def brute(rows, least, indexed=None):
    seen = Counter(k for _, t in (rows if indexed is None else indexed) for k in set(keys_of(t)))
    out = []
    for doc_id, text in rows:
        gone = [k != b"" and seen[k] >= least for k in keys_of(text)]
        kept = "\n".join(line for line, g in zip((text or "").split("\n"), gone) if not g)
        out.append((doc_id, kept, len(gone), sum(gone)))
    return Counter(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    common = ["All rights reserved", "  Home | About\t", "Ünïcode line", " nbsp", "x" * 5000]
    out = []
    for i in range(60):
        lines = [f"own line {i} {j}" for j in range(rng.randint(0, 4))]
        lines += [rng.choice([c, c.upper() if c.isascii() else c, f" {c}\r"]) for c in common if rng.random() < 0.3]
        rng.shuffle(lines)
        out.append("\n".join(lines))
    hot = "the same\npage\n\n all over"
    return [*out, *[hot] * 25, None, "", "\n", " \t\n\x0b", "page\npage\npage", "long line " * 20_000 + "\n" + "short\n" * 3000]


@pytest.fixture(scope="module")
def rows(texts):
    return [*enumerate(texts), (3, "all over"), (None, "page"), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], DOCS)


def result(df):
    assert df.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least", [1, 3, 10, 1000])
def test_cleaning_equals_brute_force(spark, rows, least):
    docs = frame(spark, rows)
    index = LineIndex.build(docs, min_docs=least)
    assert result(index.clean(docs)) == brute(rows, least)


def test_join_way_gives_the_same(spark, rows):
    docs = frame(spark, rows)
    index = LineIndex.build(docs, min_docs=3, broadcast_bytes=0)
    assert result(index.clean(docs)) == brute(rows, 3)


def test_deletion_reverses_insertion(spark, rows):
    first, second = rows[::2], rows[1::2]
    a, b = frame(spark, first), frame(spark, second)
    one = LineIndex.build(a, min_docs=12)
    two = one.insert(b)
    assert result(two.clean(a)) == brute(first, 12, rows) != brute(first, 12)
    back = two.delete(b)
    assert result(back.clean(a)) == brute(first, 12)
    assert sorted(back.counts.collect()) == sorted(one.counts.collect())
    assert result(two.clean(b)) == brute(second, 12, rows)  # earlier states stay readable
    nothing = back.delete(a)
    assert nothing.counts.isEmpty() and nothing.n_frequent == 0


def test_filters_follow_the_counts(spark, rows, monkeypatch):
    monkeypatch.setattr("tessera.llm.line_dedup.SHARD_KEYS", 4)
    a, b = frame(spark, rows[::2]), frame(spark, rows[1::2])
    for index in (LineIndex.build(a, 2), LineIndex.build(a, 2).insert(b), LineIndex.build(a, 2).insert(b).delete(a)):
        held = {r.shard: CuckooFilter.load(bytes(r.slots)) for r in index.filters.collect()}
        hi = np.array([r.hi for r in index.counts.where("n >= 2").collect()]).view(np.uint64)
        assert index.shard_bits > 0 and asked(index.shard_bits, held, hi).all()
        assert sum(np.count_nonzero(f.table) for f in held.values()) == len(hi) == index.n_frequent


def test_unknown_deletion_is_refused(spark, rows):
    index = LineIndex.build(frame(spark, rows[:5]))
    with pytest.raises(ValueError):
        index.delete(frame(spark, [(1, "never seen")]))


def test_saved_state(spark, rows, tmp_path):
    docs = frame(spark, rows)
    LineIndex.build(docs, min_docs=3).save(str(tmp_path / "v1"))
    loaded = LineIndex.load(spark, str(tmp_path / "v1"))
    assert result(loaded.clean(docs)) == brute(rows, 3)


def test_empty_table(spark):
    docs = frame(spark, [])
    index = LineIndex.build(docs)
    assert index.clean(docs).collect() == [] and index.insert(docs).counts.isEmpty()
    assert result(index.clean(frame(spark, [(1, None)]))) == Counter([(1, "", 1, 0)])


def test_mistakes_of_the_filters_are_listed(spark):
    """Among 120,000 rare lines some collide with a frequent one's fingerprint; the answers stay exact."""
    rows = [(i, "\n".join([f"common {j}" for j in range(100)] + [f"own {i} {j}" for j in range(2000)])) for i in range(60)]
    docs = frame(spark, rows)
    index = LineIndex.build(docs)
    bits, held, mistakes = index._sure(0).value
    rare = np.array([r.hi for r in index.counts.where("n < 10").collect()]).view(np.uint64)
    assert asked(bits, held, rare).sum() == len(mistakes[0]) > 0
    assert result(index.clean(docs)) == brute(rows, 10)


def test_cuckoo_filter_keeps_what_it_holds():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 1000, 20_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64)).view(np.uint64)
        made = CuckooFilter.of(keys)
        assert made.contains(keys).all()
        made.remove(keys[::2])
        assert made.contains(keys[1::2]).all() and made.contains(keys[::2]).mean() < 0.01 if n > 10 else True
        assert made.insert(keys[::2])
        made.remove(keys)
        assert not made.table.any()
    with pytest.raises(ValueError):
        CuckooFilter.of(np.array([5], np.uint64)).remove(np.array([9], np.uint64))
