"""Token counts from compiled finite-state transducers.

A byte-level BPE tokenizer file is compiled into

* a deterministic transducer over character classes that cuts a text into the pattern's pieces
  (letters, numbers, other marks, white space, contractions); its transitions say where pieces start;
* the pieces' final transitions, annotated with the number of tokens that the merge table emits for
  them. They are filled in as pieces are met and kept in a table of fixed size.

Texts are laid end to end and cut into chunks of equal length. Each chunk's map (start state to end
state) is taken for all states at once, the maps are composed by a parallel prefix scan, and with the
true start states all chunks then emit in lockstep.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Character classes. Letters that can follow an apostrophe in a contraction have their own.
LETTER, NUMBER, BLANK, WHITE, QUOTE, OTHER, SHORT, R, V, L, E, STOP = range(12)
# States: what the piece under way is.
FRESH, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, ONE_BLANK, ONE_WHITE, RUN_BLANK, RUN_WHITE = range(12)
HERE, BEFORE = 1, 2  # a piece starts at this character; at the one before
STATES, WIDTH = 12, 16
STOP_CODE = 0x110000
CHUNK = 1024
SLOTS = 1 << 20
NONE = np.int32(1 << 30)


def _follow(state: int, sign: int) -> tuple[int, int]:
    """Next state and piece starts for one character of the split pattern."""
    letters = sign in (LETTER, SHORT, R, V, L, E)
    begin = LETTERS if letters else {NUMBER: NUMBERS, BLANK: ONE_BLANK, WHITE: ONE_WHITE, QUOTE: QUOTED, OTHER: OTHERS}.get(sign, FRESH)
    attached = LETTERS if letters else {NUMBER: NUMBERS}.get(sign, OTHERS)  # behind a blank
    here = 0 if sign == STOP else HERE
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if sign == {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}[state]:
            return FRESH, 0
        return (LETTERS, BEFORE) if letters else (begin, BEFORE | here)
    if sign == STOP:
        return FRESH, 0
    if state == LETTERS and letters or state == NUMBERS and sign == NUMBER:
        return state, 0
    if state in (OTHERS, QUOTED) and sign in (OTHER, QUOTE):
        return OTHERS, 0
    if state == QUOTED and sign in (SHORT, R, V, L):
        return {SHORT: FRESH, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[sign], 0
    if state in (ONE_BLANK, ONE_WHITE, RUN_BLANK, RUN_WHITE):
        if sign in (BLANK, WHITE):
            return (RUN_BLANK if sign == BLANK else RUN_WHITE), 0
        if state == ONE_BLANK:
            return attached, 0
        if state == RUN_BLANK:
            return attached, BEFORE
        return begin, HERE | (BEFORE if state == RUN_WHITE else 0)
    return begin, here


def compiled() -> tuple[np.ndarray, np.ndarray]:
    """Flat tables of next states and piece starts, indexed by state * WIDTH + class."""
    following, starts = np.zeros(STATES * WIDTH, np.uint8), np.zeros(STATES * WIDTH, np.uint8)
    for state in range(STATES):
        for sign in range(STOP + 1):
            following[state * WIDTH + sign], starts[state * WIDTH + sign] = _follow(state, sign)
    return following, starts


def classes() -> np.ndarray:
    """Class of every code point, and of the stop behind a text."""
    out = np.full(STOP_CODE + 1, OTHER, np.uint8)
    codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, STOP_CODE)]).astype(np.uint32)
    every = codes.tobytes().decode("utf-32-le")
    for pattern, sign in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            out[codes[m.start() : m.end()]] = sign
    for text, sign in ((" ", BLANK), ("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(c) for c in text]] = sign
    out[STOP_CODE] = STOP
    return out


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (chunks x states): row i maps a start state to the end of chunk i."""
    step = 1
    while step < len(maps):
        head = maps[:step]
        maps = np.concatenate([head, np.take_along_axis(maps[step:], maps[:-step], axis=1)])
        step *= 2
    return maps


def piece_starts(signs: np.ndarray, following: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sorted positions at which the pattern's pieces start, for texts that each end in a stop."""
    lanes = max(1, -(-len(signs) // CHUNK))
    grid = np.full(lanes * CHUNK, STOP, np.uint8)
    grid[: len(signs)] = signs
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)

    # Maps of the chunks. All states of a chunk soon meet in one; that state then runs alone.
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], lanes, axis=1)
    end = np.zeros(lanes, np.uint8)
    open_lanes, alone = np.arange(lanes), np.zeros(lanes, bool)
    for k in range(CHUNK):
        if len(open_lanes):
            wide = following[(maps[:, open_lanes].astype(np.int16) << 4) | grid[k, open_lanes]]
            maps[:, open_lanes] = wide
        end[alone] = following[(end[alone].astype(np.int16) << 4) | grid[k, alone]] if not alone.all() else 0
        if alone.all():
            break
        if len(open_lanes) and k % 8 == 7:
            met = (maps[:, open_lanes] == maps[0, open_lanes]).all(axis=0)
            done = open_lanes[met]
            end[done], alone[done] = maps[0, done], True
            open_lanes = open_lanes[~met]
            if alone.all():
                k += 1
                for j in range(k, CHUNK):
                    end = following[(end.astype(np.int16) << 4) | grid[j]]
                break
    maps[:, alone] = end[alone]
    ends = composed(np.ascontiguousarray(maps.T))[:, FRESH]
    state = np.concatenate([[np.uint8(FRESH)], ends[:-1]])

    emitted = np.empty((CHUNK, lanes), np.uint8)
    for k in range(CHUNK):
        at = (state.astype(np.int16) << 4) | grid[k]
        emitted[k] = starts[at]
        state = following[at]
    flat = emitted.T.ravel()
    is_start = (flat & HERE).astype(bool)
    is_start[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(is_start)


class Merges:
    """The merge table of a tokenizer file: how many tokens a piece becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.bytes = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.lookup = dict(zip(keys.tolist(), zip(range(len(pairs)), self.made[np.argsort(order)].tolist())))

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece: the lowest-ranked pair, leftmost first, is merged until none is left."""
        out = np.zeros(len(pieces), np.int64)
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            longest = max(8, int(sizes[order[at]]) * 5 // 4)
            upto = min(int(np.searchsorted(sizes[order], longest, side="right")), at + 65536)
            chosen = order[at:upto]
            at = upto
            if longest > 80:
                out[chosen] = [self.long_count(pieces[i]) for i in chosen]
            else:
                out[chosen] = self.block_counts([pieces[i] for i in chosen], sizes[chosen])
        return out

    def block_counts(self, pieces: list[bytes], sizes: np.ndarray) -> np.ndarray:
        wide = int(sizes.max())
        grid = np.full((len(pieces), wide), -1, np.int64)
        grid[np.arange(wide) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        left, active = sizes.astype(np.int64).copy(), np.arange(len(pieces))
        columns = np.arange(wide)
        while wide > 1 and len(active):
            key = (grid[:, :-1] << 20) | grid[:, 1:]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ranks = np.where((self.keys[where] == key) & (grid[:, 1:] >= 0), self.rank[where], NONE)
            first = ranks.argmin(axis=1)
            rows = np.arange(len(grid))
            go = ranks[rows, first] < NONE
            grid, first, where, active = grid[go], first[go], where[go], active[go]
            rows = np.arange(len(grid))
            grid[rows, first] = self.made[where[rows, first]]
            source = np.minimum(columns + (columns > first[:, None]), wide - 1)
            ended = source[:, -1] == wide - 1
            grid = np.take_along_axis(grid, source, axis=1)
            grid[ended, -1] = -1
            left[active] -= 1
        return left

    def long_count(self, piece: bytes) -> int:
        """The same for one long piece, by a heap of pairs over a linked list."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, prior, alive = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap = []

        def push(i):
            j = after[i]
            if j < n and (found := self.lookup.get(ids[i] << 20 | ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                prior[after[j]] = i
            alive -= 1
            if prior[i] >= 0:
                push(prior[i])
            push(i)
        return alive


class Transducer:
    """Counts the tokens of whole texts; one per Python worker."""

    def __init__(self, path: str, signs: np.ndarray):
        self.merges, self.signs = Merges(path), signs
        self.following, self.starts = compiled()
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special)) or r"(?!)")
        self.tag, self.tokens = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.powers) <= n:
            factor = 0x9E3779B97F4A7C15
            for name, x in (("powers", factor), ("inverse", pow(factor, -1, 1 << 64))):
                table = np.full(n + 1, np.uint64(x))
                table[0] = 1
                setattr(self, name, np.cumprod(table))

    def count(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = self.special.split(text)
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        whole = "\0".join(parts) + "\0"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        stops = np.cumsum([len(p) + 1 for p in parts]) - 1
        codes[stops] = STOP_CODE
        begin = piece_starts(self.signs[codes], self.following, self.starts)
        self._powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint32(1)).astype(np.uint64) * self.powers[: len(codes)], out=sums[1:])
        part = np.searchsorted(stops, begin)
        end = np.minimum(np.concatenate([begin[1:], stops[-1:]]) if len(begin) else begin, stops[part])
        h = (sums[end] - sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) | np.uint64(1)  # 0 marks an empty slot
        slot = (h >> np.uint64(44)).astype(np.int64)
        tokens = self.tokens[slot]
        missing = np.flatnonzero(self.tag[slot] != h)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            found = self.merges.counts([whole[s:e].encode("utf-8", "surrogatepass") for s, e in zip(begin[at].tolist(), end[at].tolist())])
            tokens[missing] = found[back]
            self.tag[slot[at]], self.tokens[slot[at]] = new, found
        return extra + np.bincount(np.asarray(owner)[part], weights=tokens, minlength=len(texts)).astype(np.int64)


BATCH_CHARS = 1 << 21


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row: tokens as the byte-level BPE file ``path`` gives them.

    No begin, end or added tokens; a special token's string inside a text is that one token. A null text counts
    as empty: 0 bytes, 0 tokens. Rows are independent, so repeated rows and null ids are returned as they come;
    other columns are not read. ``path`` must be readable on the executors.
    """
    signs = docs.sparkSession.sparkContext.broadcast(classes())

    def count(batches):
        machine = Transducer(path, signs.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out, at, size = [], 0, 0
            for i, x in enumerate(texts):
                size += len(x)
                if size >= BATCH_CHARS or i == len(texts) - 1:
                    out.append(machine.count(texts[at : i + 1]))
                    at, size = i + 1, 0
            counts = np.concatenate(out) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    filled = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), filled.alias("text"), F.octet_length(filled).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
