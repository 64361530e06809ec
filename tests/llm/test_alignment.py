"""Cross-tokenizer alignment against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm.alignment import Pair, align, alignment_scores, terminals

FILES = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


def spans(pieces):
    out, at = [], 0
    for i, raw in pieces:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def tokens(text):
    """(id, begin, end) by either tokenizer, both empty where the bytes are not the text's."""
    a = Tokenizer.from_file(FILES[0]) if not hasattr(tokens, "a") else tokens.a
    b = SentencePieceProcessor(model_file=FILES[1]) if not hasattr(tokens, "b") else tokens.b
    tokens.a, tokens.b = a, b
    a.encode_special_tokens = True
    if not text:
        return [], []
    shown = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    for byte in range(256):
        if byte not in shown.values():
            shown[chr(256 + len([c for c in shown if ord(c) >= 256 and c not in map(chr, range(256))]))] = byte
    pa = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    pb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    if b"".join(x for _, x in pa) != whole or b"".join(x for _, x in pb) != whole:
        return [], []
    return spans(pa), spans(pb)


def brute(rows):
    per, linked = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        linked.update(set(links))
        both = sorted({e for *_, e in a} & {f for *_, f in b})
        parts, s = [], 0
        for e in both:
            parts.append("|".join(",".join(str(i) for i, u, v in side if s <= u and v <= e) for side in (a, b)))
            s = e
        groups = ";".join(parts)
        per.append((doc_id, len(a), len(b), len(both), links, hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (i, _), n in linked.items():
        most[i] = max(most[i], n)
    return Counter((d, n, m, g, len(ls), h, sum(linked[p] == most[p[0]] for p in ls), sum(linked[p] for p in ls)) for d, n, m, g, ls, h in per)


@pytest.fixture(scope="module")
def rows(sf, spark):
    docs = [(r.doc_id, r.text[:400]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    odd = ["a", " ", "  two  blanks\n\n\ttab", "<|endoftext|> <s> </s> <unk>", "▁ piece mark", "ﬁne ½ é é", "日本語 \U0001f600\U0001f1e9", "x\x00y\r\n", "don't I'll", "z" * 3000]
    return docs + [(1000 + i, t) for i, t in enumerate(odd)] + [(2000, None), (2001, ""), (None, "no id"), docs[0], docs[1]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n_a int, groups string")


@pytest.mark.parametrize("segment_pairs", [10_000_000, 300])
def test_alignment_equals_brute_force(spark, rows, segment_pairs):
    got = alignment_scores(frame(spark, rows), *FILES, segment_pairs=segment_pairs)
    assert got.columns == COLUMNS
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_groups_are_readable(spark):
    (row,) = align(frame(spark, [(1, "hello  world\n")]), *FILES).collect()
    a, b = tokens("hello  world\n")
    assert [len(p.split("|")) for p in row.groups.split(";")] == [2] * row.n_groups
    assert [int(i) for p in row.groups.split(";") for i in p.split("|")[0].split(",")] == [i for i, *_ in a]
    assert [int(i) for p in row.groups.split(";") for i in p.split("|")[1].split(",")] == [i for i, *_ in b]


def test_long_text_and_empty_table(spark):
    text = "many words, " * 20_000
    (row,) = alignment_scores(frame(spark, [(1, text)]), *FILES).collect()
    a, b = tokens(text)
    assert (row.n_a, row.n_b, row.n_links) == (len(a), len(b), len({e for *_, e in a} | {e for *_, e in b}))
    assert alignment_scores(frame(spark, []), *FILES).collect() == []


def test_terminals_of_chains():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = int(rng.integers(2, 200))
        a, b = (np.append(np.flatnonzero(rng.random(size) < rng.random()), size) for _ in range(2))
        a, b = np.unique(a[a > 0]), np.unique(b[b > 0])
        common = np.intersect1d(a, b)
        want = np.searchsorted(a, common[np.searchsorted(common, np.concatenate([a, b]))])
        assert (terminals(a, b) == want).all()
    chain = np.arange(1, 20_002, 2)  # a: 1, 3, 5, ...; b: 2, 4, 6, ...: one group of 20,000 tokens
    assert (terminals(np.append(chain, 20_003), np.append(chain + 1, 20_003)) == len(chain)).all()


def test_bytes_of_every_id():
    machine = Pair(*FILES)
    texts = ["plain", "naïve café", "日本語", "a\tb\n"]
    for text, a, b in zip(texts, *machine.encode(texts)):
        assert b"".join(machine.bytes_a[i] for i in a) == b"".join(machine.bytes_b[i] for i in b) == b" " + text.encode()


def test_rank_table_gives_the_files_ids():
    machine = Pair(*FILES)
    library = machine.a.library
    entries = [raw.decode() for raw in machine.bytes_a[:-1] if raw.decode(errors="replace").encode() == raw]
    odd = ["\x85", "a\u180eb", "\u2003 x", "\u00a0x", "\x1c\x1d y", "\U0001fae8 new", "\u0378", "x" * 5000, " " * 5000, "don't\r\n\r\n", "\u00aa\u00bd\u2160", "e\u0301", "ǅ ǅ"]
    assert machine.a.ranked is not None and len(entries) > 45_000
    for text in entries + odd + [f"{a} {b}" for a, b in zip(odd, entries[::4000])]:
        assert machine.a.encode(text) == library.encode(text, add_special_tokens=False).ids
