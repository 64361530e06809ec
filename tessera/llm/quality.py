"""Quality classification by co-training.

Two views of a document are scored by separate logistic models: its content (presence of telling words,
repetition and character statistics) and its page metadata (source, language, length, line layout). In each
round either model scores all unlabelled documents and hands those of which it is surest to the other. At the end
both are calibrated on labelled documents kept aside, and a logistic model of the two calibrated
log-odds scores every document.

Only labelled rows are sampled: an even sample of ``labelled`` documents and, so that rare marks are learned,
at least ``each`` examples of either class of either mark if there are so many. Calibration weighs the classes by
their counts among all labelled documents. The telling words come from that sample; then every document is described
once, in a written table of some hundred bytes a row, which the rounds and the final scores read. A round brings
back at most SHARE of the sample per model and class, and counts equal documents once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import hash_part, ragged, releasing, word_hashes
from tessera.session import materialise

SPACE_BITS = 20  # of the hashed vocabulary
N_WORDS = 2048  # telling words the content model may use
N_CONTENT, N_LAYOUT, N_TAGS = 8, 8, 64
SLICE = 500  # rows described at a time
ROUNDS, SURE, SHARE = 4, 0.98, 0.1  # co-training: rounds, least confidence, most pseudo-labels a round and class
BLANK, CAPITAL, DIGIT, SYMBOL = 1, 2, 3, 4

_kinds = np.zeros(256, np.uint8)
_kinds[[0x20, *range(0x09, 0x0E)]] = BLANK
_kinds[0x41:0x5B] = CAPITAL
_kinds[0x30:0x3A] = DIGIT
_kinds[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"-()"]] = SYMBOL


def word_slots(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of a text and how often each occurs."""
    return np.unique((tokens.view(np.uint64) >> np.uint64(64 - SPACE_BITS)).astype(np.int64), return_counts=True)


def content_features(raw: bytes, n_tokens: int, counts: np.ndarray) -> list[float]:
    kinds = np.bincount(_kinds[np.frombuffer(raw, np.uint8)], minlength=5)
    size, words = max(1, len(raw)), max(1, n_tokens)
    return [
        len(counts) / words ** 0.8, float(counts.max(initial=0)) / words, np.log1p(len(raw) / words),
        kinds[SYMBOL] / size * 10, kinds[DIGIT] / size * 10, kinds[CAPITAL] / size * 10,
        float((counts > 2).sum()) / words, raw.count(b".") / words * 5,
    ]


def layout_features(raw: bytes, n_tokens: int, n_chars: float) -> list[float]:
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    lines = np.diff(np.concatenate([[-1], breaks, [len(raw)]])) - 1
    return [
        np.log1p(len(raw)) / 5, np.log1p(n_tokens) / 5, np.log1p(len(lines)) / 3, np.log1p(lines.mean()) / 5,
        np.log1p(lines.std()) / 5, float((lines < 20).mean()), raw.count(b"|") / max(1, len(raw)) * 10,
        abs(np.log1p(max(0.0, n_chars)) - np.log1p(len(raw))),
    ]


def tag_slots(*tags) -> list[int]:
    """Hashed one-hot positions of the categorical metadata."""
    return [(sum((i + 3) * b for i, b in enumerate(str(t).encode())) * 31 + k) % N_TAGS for k, t in enumerate(tags)]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and intercept, classes weighted alike, by gradient steps with a per-feature scale."""
    positive = y > 0.5
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    square, square_b = np.full(x.shape[1], 1e-8, np.float32), 1e-8
    for _ in range(steps):
        error = (sigmoid(x @ w + b) - y).astype(np.float32) * weight
        grad, grad_b = x.T @ error + penalty * w / max(1, len(y)) ** 0.5, float(error.sum())
        square, square_b = square + grad**2, square_b + grad_b**2
        w, b = w - 0.5 * grad / np.sqrt(square), b - 0.5 * grad_b / np.sqrt(square_b)
    return w, b


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Calibration: weighted logistic regression of y on the columns of x and a constant, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(20):
        p = sigmoid(a @ w)
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(a.shape[1])
        w = w - np.linalg.solve(hessian, a.T @ (weight * (p - target)) + 1e-3 * w)
    return w


@dataclass
class Described:
    """Documents described for scoring: places of their telling words (with the row of each), numbers and tags."""

    place: np.ndarray
    row: np.ndarray
    numbers: np.ndarray
    tags: np.ndarray


@dataclass
class Views:
    """Scorer of one label: weights of the words at each place, of the numbers and tags, calibration."""

    base: float = 1.0  # the score where nothing could be learned
    ready: bool = False
    words: np.ndarray | None = None
    content: np.ndarray = field(default_factory=lambda: np.zeros(N_CONTENT + 1))
    metadata: np.ndarray = field(default_factory=lambda: np.zeros(N_LAYOUT + N_TAGS + 1))
    calibration: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    combined: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def log_odds(self, d: Described) -> list[np.ndarray]:
        """Calibrated log-odds of the content and of the metadata view."""
        a = np.bincount(d.row, self.words[d.place], len(d.numbers)) + d.numbers[:, :N_CONTENT] @ self.content[:-1] + self.content[-1]
        b = d.numbers[:, N_CONTENT:] @ self.metadata[:N_LAYOUT] + self.metadata[N_LAYOUT:-1][d.tags].sum(axis=1) + self.metadata[-1]
        return [scale * raw + shift for raw, (scale, shift) in zip((a, b), self.calibration)]

    def scores(self, d: Described) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined scores and the calibrated scores of the content and the metadata view."""
        if not self.ready:
            return (np.full(len(d.numbers), self.base),) * 3
        a, b = self.log_odds(d)
        return sigmoid(self.combined[0] * a + self.combined[1] * b + self.combined[2]), sigmoid(a), sigmoid(b)


def telling_words(slots: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Hashed words whose presence tells the classes apart, ascending."""
    present = np.zeros((2, 1 << SPACE_BITS), np.int64)
    for own, label in zip(slots, y):
        present[int(label > 0.5), own] += 1
    n0, n1 = (y < 0.5).sum(), (y > 0.5).sum()
    p0, p1 = (present[0] + 0.5) / (n0 + 1), (present[1] + 0.5) / (n1 + 1)
    often = present.sum(axis=0) >= 4
    telling = np.where(often, np.abs(p1 - p0) / np.sqrt(p0 * (1 - p0) / (n0 + 1) + p1 * (1 - p1) / (n1 + 1)), 0)
    chosen = np.sort(np.argsort(-telling, kind="stable")[:N_WORDS])
    return chosen[telling[chosen] > 2]


class CoTraining:
    """Co-training of one label: labelled documents, what the views handed each other, and the models so far.

    y holds 1 and 0; totals, the documents of class 0 and 1 among all labelled ones. A quarter of either class
    is kept aside for calibration.
    """

    def __init__(self, slots: list[np.ndarray], y: np.ndarray, totals: tuple[float, float]):
        counts = [int((y < 0.5).sum()), int((y > 0.5).sum())]
        self.ready = min(counts) >= 8
        self.base = totals[1] / sum(totals) if sum(totals) else 1.0
        order = np.zeros(len(y), np.int64)
        for label in (0, 1):
            own = np.flatnonzero((y > 0.5) == label)
            order[own] = np.arange(len(own))
        self.aside, self.learn = np.flatnonzero(order % 4 == 0), np.flatnonzero(order % 4 != 0)
        self.words = telling_words([slots[i] for i in self.learn], y[self.learn]) if self.ready else np.empty(0, np.int64)
        self.y, self.totals, self.most = y, totals, max(1, int(SHARE * len(self.learn)))

    def start(self, d: Described, places: int) -> None:
        """The labelled documents, described over ``places`` places of words."""
        self.own = np.full(places, -1)
        self.own[self.place] = np.arange(len(self.place))
        views = self.matrices(d)
        self.held = [x[self.aside] for x in views]
        self.x = [[x[self.learn]] for x in views]
        self.labels = [[self.y[self.learn]] for _ in views]
        kept = self.y[self.aside]
        total = [max(1, (kept < 0.5).sum()), max(1, (kept > 0.5).sum())]
        self.weight = np.where(kept > 0.5, self.totals[1] / total[1], self.totals[0] / total[0])
        self.weight = self.weight * len(kept) / self.weight.sum()
        self.places = places

    def matrices(self, d: Described) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(d.numbers), len(self.place)
        content = np.zeros((n, width + N_CONTENT), np.float32)
        mine = self.own[d.place]
        content[d.row[mine >= 0], mine[mine >= 0]] = 1
        content[:, width:] = d.numbers[:, :N_CONTENT]
        metadata = np.zeros((n, N_LAYOUT + N_TAGS), np.float32)
        metadata[:, :N_LAYOUT] = d.numbers[:, N_CONTENT:]
        for column in d.tags.T:
            np.add.at(metadata, (np.arange(n), N_LAYOUT + column), 1)
        return content, metadata

    def hand(self, view: int, label: int, d: Described) -> None:
        """Documents of which ``view`` is sure teach the other view."""
        self.x[1 - view].append(self.matrices(d)[1 - view])
        self.labels[1 - view].append(np.full(len(d.numbers), float(label)))

    def models(self) -> Views:
        """Both views fitted on what they hold, calibrated and combined on the documents kept aside."""
        if not self.ready:
            return Views(base=self.base)
        (wa, ba), (wb, bb) = (fit_logistic(np.concatenate(x), np.concatenate(y)) for x, y in zip(self.x, self.labels))
        width, kept = len(self.place), self.y[self.aside]
        out = Views(base=self.base, ready=True, words=np.zeros(self.places, np.float32))
        out.words[self.place] = wa[:width]
        out.content = np.concatenate([wa[width:], [ba]]).astype(float)
        out.metadata = np.concatenate([wb, [bb]]).astype(float)
        raw = [self.held[0] @ wa + ba, self.held[1] @ wb + bb]
        out.calibration = np.array([fit_line(r[:, None], kept, self.weight) for r in raw])
        logits = np.column_stack([a * r + c for r, (a, c) in zip(raw, out.calibration)])
        out.combined = fit_line(logits, kept, self.weight)
        return out


def _inputs(docs: DataFrame, text: str, key: str, *more) -> DataFrame:
    """Id, text, word hashes and the metadata columns; those that ``docs`` lacks count as null."""
    tags = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("source", "lang")]
    chars = (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double")
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), word_hashes(F.col(text)).alias("t"),
        *tags, F.coalesce(chars, F.lit(0.0)).alias("n_chars"), *more,
    )


def _features(batch):
    """(slots, content, layout, tags) of each row of a batch of ``_inputs``."""
    for at in range(0, batch.num_rows, SLICE):
        columns = dict(zip(batch.schema.names, batch.slice(at, SLICE).columns))
        values, offsets = ragged(columns["t"])
        inputs = zip(*(columns[c].to_pylist() for c in ("text", "source", "lang", "n_chars")))
        for (text, source, lang, n_chars), s, e in zip(inputs, offsets[:-1], offsets[1:]):
            raw = (text or "").encode()
            slots, counts = word_slots(values[s:e])
            yield slots, content_features(raw, e - s, counts), layout_features(raw, e - s, n_chars), tag_slots(source, lang)


PACKED = "places binary, numbers binary, tags binary"


def packed(rows, place: np.ndarray) -> list[pa.Array]:
    """The columns of PACKED of rows of :func:`_features`; place: of each hashed word, or -1."""
    found = []
    for slots, content, layout, tags in rows:
        at = place[slots]
        found.append((at[at >= 0].astype("<u2").tobytes(), np.array(content + layout, "<f8").tobytes(), bytes(tags)))
    return [pa.array(c, pa.binary()) for c in (list(zip(*found)) or [[]] * 3)]


def unpacked(places, numbers, tags) -> Described:
    """The same of lists of bytes."""
    place = np.frombuffer(b"".join(places), "<u2").astype(np.int64)
    row = np.repeat(np.arange(len(places)), [len(p) // 2 for p in places])
    numbers = np.frombuffer(b"".join(numbers), "<f8").reshape(-1, N_CONTENT + N_LAYOUT)
    return Described(place, row, numbers, np.frombuffer(b"".join(tags), np.uint8).reshape(-1, 2).astype(np.int64))


def _described(batch) -> Described:
    return unpacked(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("places", "numbers", "tags")))


MARKS = ("quality", "toxic")


def _labelled(docs: DataFrame, labels: DataFrame, labelled: int, each: int, text: str, key: str):
    """(marks, sample): the marks of every labelled document, and the described sample of them."""
    ids = docs.select(F.col(key).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id"))
    marks = marks.agg(*(f(F.when(F.isnan(c), None).otherwise(c) > 0).alias(m) for m, f, c in
                        (("quality", F.min, F.col("quality").cast("double")), ("toxic", F.max, F.col("toxic").cast("double")))))
    marks = materialise(marks.join(ids, "doc_id", "left_semi"), "marks")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = marks.orderBy(*order).limit(labelled)
    for mark in MARKS:
        for label in (True, False):
            chosen = chosen.unionByName(marks.where(F.col(mark) == label).orderBy(*order).limit(each))
    chosen = materialise(chosen.distinct(), "sample")  # at most labelled + 4 * each rows

    def describe(batches):
        for batch in batches:
            rows = [(s.astype("<u4").tobytes(), np.array(c + m, "<f8").tobytes(), bytes(t)) for s, c, m, t in _features(batch)]
            arrays = [pa.array(c, pa.binary()) for c in (list(zip(*rows)) or [[]] * 3)]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *MARKS)]
            yield pa.RecordBatch.from_arrays(keep + arrays, names=["doc_id", *MARKS, "slots", "numbers", "tags"])

    # One row per id: of several texts the one first by hash.
    read = docs.select(*dict.fromkeys(c for c in docs.columns if c in (text, key, "source", "lang", "n_chars")))
    near = read.join(F.broadcast(chosen.select(F.col("doc_id").alias(key), F.col("quality").alias("_q"), F.col("toxic").alias("_t"))), key)
    near = _inputs(near, text, key, F.col("_q").alias("quality"), F.col("_t").alias("toxic"))
    found = near.mapInArrow(describe, "doc_id long, quality boolean, toxic boolean, slots binary, numbers binary, tags binary")
    found = found.groupBy("doc_id").agg(F.min(F.struct("slots", "numbers", "tags", *MARKS)).alias("r")).select("doc_id", "r.*")
    return marks, sorted(found.collect(), key=lambda r: r.doc_id)


def _top(rows: pa.Table, most: int) -> pa.Table:
    """The surest rows of different digests."""
    digest, sure = rows["digest"].to_numpy(), rows["sure"].to_numpy()
    once = np.unique(digest, return_index=True)[1]
    return rows.take(pa.array(once[np.lexsort((digest[once], -sure[once]))][:most])).combine_chunks()


def _surest(described: DataFrame, models, handed: set[tuple[int, int]], most: list[int]) -> DataFrame:
    """(mark, view, label, digest, places, numbers, tags): at most ``most`` unlabelled documents for each model and class."""
    spark = described.sparkSession
    shared = spark.sparkContext.broadcast((models, [np.array(sorted(d for m, d in handed if m == k), np.int64) for k in range(len(models))]))

    def pick(batches):
        fitted, gone = shared.value
        best = {}  # of each kind, the surest so far in this task
        for batch in batches:
            docs, rows = _described(batch), batch.select(["digest", "places", "numbers", "tags"])
            digest = rows.column(0).to_numpy()
            for mark, model in enumerate(fitted):
                if not model.ready:
                    continue
                known = batch.column(batch.schema.get_field_index(f"{MARKS[mark]}_known")).to_numpy(zero_copy_only=False)
                free = ~known.astype(bool) & ~np.isin(digest, gone[mark])
                for view, odds in enumerate(model.log_odds(docs)):
                    for label, sure in ((1, sigmoid(odds)), (0, sigmoid(-odds))):
                        at = np.flatnonzero(free & (sure >= SURE))
                        if len(at):
                            new = pa.table({"sure": sure[at]} | {c: rows.column(c).take(pa.array(at)) for c in rows.schema.names})
                            kind = (mark, view, label)
                            best[kind] = _top(pa.concat_tables([best[kind], new]) if kind in best else new, most[mark])
        for kind, rows in best.items():
            fixed = {c: pa.array(np.full(len(rows), v, np.int32)) for c, v in zip(("mark", "view", "label"), kind)}
            yield from pa.table(fixed | dict(zip(rows.column_names, rows.columns))).combine_chunks().to_batches()

    found = described.mapInArrow(pick, f"mark int, view int, label int, sure double, digest long, {PACKED}")
    kind = ("mark", "view", "label")
    found = found.groupBy(*kind, "digest").agg(*(F.first(c).alias(c) for c in ("sure", "places", "numbers", "tags")))
    limit = F.when(F.col("mark") == 0, most[0]).otherwise(most[1])
    # Each part of a kind keeps its surest, then the kind does, so no task holds all candidates.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for spread in (["part"], []):
        window = Window.partitionBy(*kind, *spread).orderBy(F.desc("sure"), "digest")
        found = found.withColumn("part", hash_part(parts, "digest")).withColumn("place", F.row_number().over(window))
        found = found.where((F.col("place") <= max(most)) & (F.col("place") <= limit)).drop("place", "part")
    return found


def _fitted(docs: DataFrame, labels: DataFrame, labelled: int, each: int, text: str, key: str):
    """(broadcast of the place of each word and of the quality and toxicity model, table of all documents described)."""
    spark = docs.sparkSession
    marks, sample = _labelled(docs, labels, labelled, each, text, key)
    totals = marks.agg(*(F.count_if(F.col(m) == v).alias(f"{m}_{int(v)}") for m in MARKS for v in (False, True))).first()
    runs, chosen = [], []
    for mark in MARKS:
        rows = [r for r in sample if r[mark] is not None]
        slots = [np.frombuffer(r.slots, "<u4").astype(np.int64) for r in rows]
        runs.append(CoTraining(slots, np.array([float(r[mark]) for r in rows]), (totals[f"{mark}_0"], totals[f"{mark}_1"])))
        chosen.append((rows, slots))
    if not sum(totals[f"toxic_{v}"] for v in (0, 1)):
        runs[1].base = 0.0
    every = np.union1d(runs[0].words, runs[1].words)  # at most 2 * N_WORDS
    place = np.full(1 << SPACE_BITS, -1, np.int16)
    place[every] = np.arange(len(every))
    for run, (rows, slots) in zip(runs, chosen):
        run.place = np.searchsorted(every, run.words)
        if run.ready:
            at = [place[s] for s in slots]
            run.start(unpacked([a[a >= 0].astype("<u2").tobytes() for a in at], [r.numbers for r in rows], [r.tags for r in rows]), len(every))
    places = spark.sparkContext.broadcast(place)

    @releasing
    def describe(batches):
        for batch in batches:
            arrays = packed(_features(batch), places.value)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "digest")]
            yield pa.RecordBatch.from_arrays(keep + arrays, names=["doc_id", "digest", "places", "numbers", "tags"])

    digest = F.xxhash64(F.col(text), *(c for c in ("source", "lang", "n_chars") if c in docs.columns)).alias("digest")
    described = _inputs(docs, text, key, digest).mapInArrow(describe, f"doc_id long, digest long, {PACKED}")
    known = marks.select("doc_id", *(F.col(m).isNotNull().alias(f"{m}_known") for m in MARKS))
    described = described.join(known, "doc_id", "left").fillna(False, [f"{m}_known" for m in MARKS])
    described = materialise(described, "described")

    models, handed = [r.models() for r in runs], set()
    for _ in range(ROUNDS if any(r.ready for r in runs) else 0):
        found = _surest(described, models, handed, [r.most for r in runs]).collect()  # bounded by the samples
        if not found:
            break
        for mark, run in enumerate(runs):
            for view in (0, 1):
                for label in (0, 1):
                    rows = sorted((r for r in found if (r.mark, r.view, r.label) == (mark, view, label)), key=lambda r: (-r.sure, r.digest))
                    if rows:
                        run.hand(view, label, unpacked([r.places for r in rows], [r.numbers for r in rows], [r.tags for r in rows]))
        handed |= {(r.mark, r.digest) for r in found}
        models = [r.models() for r in runs]
    return places, spark.sparkContext.broadcast(models), described


def quality_scores(
    docs: DataFrame, labels: DataFrame, labelled: int = 4000, each: int = 500, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, score, content_score, metadata_score, toxic_score, accepted) for every row of ``docs``.

    ``labels`` (doc_id, quality, toxic) names known documents; several rows of one id count as one, with the lower
    quality and the higher toxicity, and null marks are unknown. score is the probability of quality 1 and
    toxic_score that of toxic 1, fitted alike; accepted means score >= 0.5 and toxic_score < 0.5. A mark without
    eight examples of both kinds among the labelled documents cannot be learned: score is then the labelled mean (1 for
    quality and 0 for toxicity without any). Null and empty texts are scored as texts of no words. Repeated rows
    get their row each; other columns are not read. ``labelled`` and ``each`` bound the labelled sample (see the module).
    """
    _, models, described = _fitted(docs, labels, labelled, each, text, key)

    def score(batches):
        quality, toxic = models.value
        for batch in batches:
            d = _described(batch)
            (q, c, m), (t, _, _) = quality.scores(d), toxic.scores(d)
            arrays = [batch.column(0), *map(pa.array, (q, c, m, t)), pa.array((q >= 0.5) & (t < 0.5))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "content_score", "metadata_score", "toxic_score", "accepted"])

    out = "doc_id long, score double, content_score double, metadata_score double, toxic_score double, accepted boolean"
    return described.select("doc_id", "places", "numbers", "tags").mapInArrow(score, out)


def keep_good(docs: DataFrame, labels: DataFrame, labelled: int = 4000, each: int = 500, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`quality_scores` accepts."""
    places, models, _ = _fitted(docs, labels, labelled, each, text, key)
    names = docs.columns
    own = ["text" if c == text else f"own_{i}" for i, c in enumerate(names)]  # out of the way of clashing names

    @releasing
    def choose(batches):
        quality, toxic = models.value
        for batch in batches:
            d = unpacked(*(c.to_pylist() for c in packed(_features(batch), places.value)))
            keep = (quality.scores(d)[0] >= 0.5) & (toxic.scores(d)[0] < 0.5)
            rows = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in own], names=names)

    return _inputs(docs, text, key, *[F.col(c).alias(o) for c, o in zip(names, own) if c != text]).mapInArrow(choose, docs.schema)
