"""Formula vocabulary over a panel.

A formula mixes windows along a code with ranks across a date. Each switch is an exchange,
so a term remembers how many switches lie below it and all windows of one level, over every
formula asked for, go into one ``select``. A hundred formulas then exchange as often as the
deepest one does, instead of once per rank.

Odd levels run along codes, even levels across dates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import windows as W
from tessera.functions.cross import date_ranks, largest_group, rank_table
from tessera.functions.kernels import Kernel, add_rolling
from tessera.session import Stages


class Term:
    """An expression and the level of the last window below it."""

    __slots__ = ("frame", "value", "level", "key", "boolean")

    def __init__(self, frame, value, level: int, key: str, boolean: bool = False):
        self.frame, self.value, self.level, self.key, self.boolean = frame, value, level, key, boolean

    def _with(self, op: str, other, flip: bool = False) -> "Term":
        other = self.frame.term(other)
        return self.frame.binary(op, other, self) if flip else self.frame.binary(op, self, other)

    __add__ = lambda a, b: a._with("+", b)
    __radd__ = lambda a, b: a._with("+", b, True)
    __sub__ = lambda a, b: a._with("-", b)
    __rsub__ = lambda a, b: a._with("-", b, True)
    __mul__ = lambda a, b: a._with("*", b)
    __rmul__ = lambda a, b: a._with("*", b, True)
    __truediv__ = lambda a, b: a._with("/", b)
    __rtruediv__ = lambda a, b: a._with("/", b, True)
    __pow__ = lambda a, b: a._with("**", b)
    __neg__ = lambda a: a._with("*", -1.0)
    __lt__ = lambda a, b: a._with("<", b)
    __le__ = lambda a, b: a._with("<=", b)
    __gt__ = lambda a, b: a._with(">", b)
    __ge__ = lambda a, b: a._with(">=", b)
    __and__ = lambda a, b: a._with("&", b)
    __or__ = lambda a, b: a._with("|", b)

    def same(self, other) -> "Term":
        return self._with("==", other)


COMPARISONS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
}
ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": S.divide,
    "**": S.power,
}
LOGIC = {"&": lambda a, b: a & b, "|": lambda a, b: a | b}

RANKED = 2  # columns ranked at once: their long rows are on disk together, but each group is a job of its own
DATE_ROWS = 250_000  # rows of a date that one task ranks whole; if any date has more, ranks go by classes of values
CHUNK = 5  # formulas staged at once: their levels are on disk together, and what lies below a rank of several chunks is done again for each
COMPILED = 8000  # bytes of code up to which the JVM compiles a method; a wide select as one larger method stays interpreted
ROW = "_row"  # tells rows apart when chunks are joined: codes and days may repeat or be null

# Inputs a formula may name.
FIELDS = ("open", "high", "low", "close", "volume", "amount", "vwap", "returns")


class Placer:
    """Window placement that computes each distinct window of a level once."""

    def __init__(self, frame: "FormulaFrame", level: int):
        self.level, self.names = level, frame.names
        self.parts, self.kernels = frame.parts.setdefault(level, {}), frame.kernels.setdefault(level, {})

    def _named(self, key: str, into: dict, build: Callable) -> Column:
        name = self.names.get(key)
        if name is None:
            name = self.names[key] = f"_w{len(self.names)}"
            into[name] = build()
        return F.col(name)

    def __call__(self, value: Column, n: float | None) -> Column:
        return self._named(f"{self.level}|{value._jc.toString()}|{n if n is None else int(n)}", self.parts, lambda: W.place(value, n))

    def rolled(self, kernel: str, inputs: Sequence[Column], n: int) -> Column:
        key = f"{self.level}|{kernel}({', '.join(c._jc.toString() for c in inputs)})|{n}"
        return self._named(key, self.kernels, lambda: (kernel, tuple(inputs), n))


class FormulaFrame:
    """Builds terms over a (code, dt) panel and stages their windows level by level."""

    def __init__(self, panel: DataFrame):
        self.panel = panel
        self.levels: dict[int, dict[str, Column]] = {}
        self.parts: dict[int, dict[str, Column]] = {}
        self.kernels: dict[int, dict[str, Kernel]] = {}
        self.names: dict[str, str] = {}
        self.length = F.col("_length")
        self.whole_dates = False  # no date is too large to be ranked whole

    # -- terms ---------------------------------------------------------------
    def term(self, value) -> Term:
        if isinstance(value, Term):
            return value
        return Term(self, F.lit(float(value)), 0, repr(float(value)))

    def field(self, name: str, level: int = 0) -> Term:
        return Term(self, F.col(name), level, name)

    def __getattr__(self, name: str) -> Term:
        if name in FIELDS:
            return self.field(name)
        raise AttributeError(name)

    def number(self, t: Term) -> Column:
        return t.value.cast("double") if t.boolean else t.value

    def binary(self, op: str, a: Term, b: Term) -> Term:
        level, key = max(a.level, b.level), f"({a.key} {op} {b.key})"
        if op in LOGIC:
            return Term(self, LOGIC[op](a.value, b.value), level, key, True)
        if op in COMPARISONS:
            value = F.coalesce(COMPARISONS[op](self.number(a), self.number(b)), F.lit(False))
            return Term(self, value, level, key, True)
        return Term(self, ARITHMETIC[op](self.number(a), self.number(b)), level, key)

    def _level(self, odd: bool, inputs) -> int:
        level = max(t.level for t in inputs) + 1
        return level + ((level % 2 == 1) != odd)

    def _stage(self, odd: bool, text: str, build: Callable, *inputs: Term) -> Term:
        level = self._level(odd, inputs)
        name = self.names.get(text)
        if name is None:
            name = self.names[text] = f"_t{len(self.names)}"
            self.levels.setdefault(level, {})[name] = build(level)
        return self.field(name, level)

    def _placer(self, level: int) -> Callable:
        return Placer(self, level)

    def _along(self, text: str, build: Callable, *inputs: Term) -> Term:
        """``build(over)`` gives the column from windows placed by ``over``."""
        return self._stage(True, text, lambda level: build(self._placer(level)), *inputs)

    def _rolling(self, fn: Callable, x, *args, **kw) -> Term:
        x = self.term(x)
        return self._along(f"{fn.__name__}({x.key},{args})", lambda over: fn(self.number(x), *args, over=over, **kw), x)

    # -- across dates ----------------------------------------------------------
    def rank(self, x) -> Term:
        x = self.term(x)
        return self._stage(False, f"rank({x.key})", lambda _: self.number(x), x)

    # -- along codes -----------------------------------------------------------
    def delay(self, x, k=1):
        return self._rolling(W.delay, x, k)

    def delta(self, x, k=1):
        return self._rolling(W.delta, x, k)

    def sum(self, x, n):
        return self._rolling(W.ts_sum, x, n, length=self.length)

    def mean(self, x, n=10):
        return self._rolling(W.mean, x, n, length=self.length)

    def stddev(self, x, n=10):
        return self._rolling(W.stddev, x, n, length=self.length)

    def ts_min(self, x, n):
        return self._rolling(W.ts_min, x, n, length=self.length)

    def ts_max(self, x, n):
        return self._rolling(W.ts_max, x, n, length=self.length)

    def ts_argmax(self, x, n):
        return self._rolling(W.ts_argmax, x, n, length=self.length)

    def ts_argmin(self, x, n):
        return self._rolling(W.ts_argmin, x, n, length=self.length)

    def ts_rank(self, x, n):
        return self._rolling(W.ts_rank, x, n, length=self.length)

    def product(self, x, n):
        return self._rolling(W.product, x, n, length=self.length, compat=True)

    def decay(self, x, n):
        return self._rolling(W.decay_linear, x, n, length=self.length, compat=True)

    def lowday(self, x, n):
        return self._rolling(W.lowday, x, n, length=self.length, compat=True)

    def highday(self, x, n):
        return self._rolling(W.highday, x, n, length=self.length, compat=True)

    def regbeta(self, x, n):
        return self._rolling(W.regbeta, x, n, length=self.length, compat=True)

    def sma(self, x, n, m):
        return self._rolling(W.sma, x, n, m)

    def count(self, condition, n):
        t = self.term(condition)
        return self._along(f"count({t.key},{n})", lambda over: W.count(t.value, n, over), t)

    def sumif(self, x, n, condition):
        x, c = self.term(x), self.term(condition)
        return self._along(
            f"sumif({x.key},{n},{c.key})",
            lambda over: W.sumif(self.number(x), n, c.value, self.length, compat=True, over=over),
            x,
            c,
        )

    def _pairwise(self, fn, x, y, n):
        x, y = self.term(x), self.term(y)
        return self._along(
            f"{fn.__name__}({x.key},{y.key},{n})", lambda over: fn(self.number(x), self.number(y), n, over=over), x, y
        )

    def corr(self, x, y, n):
        return self._pairwise(W.correlation, x, y, n)

    def cov(self, x, y, n):
        return self._pairwise(W.covariance, x, y, n)

    # -- row-wise --------------------------------------------------------------
    def _row(self, name: str, fn: Callable, *inputs) -> Term:
        terms = [self.term(t) for t in inputs]
        key = f"{name}({','.join(t.key for t in terms)})"
        return Term(self, fn(*[self.number(t) for t in terms]), max(t.level for t in terms), key)

    def log(self, x):
        return self._row("log", lambda v: F.round(S.log(v), 12), x)  # same last digits on every platform

    def abs(self, x):
        return self._row("abs", F.abs, x)

    def sign(self, x):
        return self._row("sign", F.signum, x)

    def signedpower(self, x, y):
        return self._row("signedpower", S.signedpower, x, y)

    def scale(self, x):
        return self._row("scale", S.scale, x)

    def min(self, x, y):
        return self._row("min", F.least, x, y)

    def max(self, x, y):
        return self._row("max", F.greatest, x, y)

    def where(self, condition, yes, no):
        c, a, b = self.term(condition), self.term(yes), self.term(no)
        value = F.when(c.value, self.number(a)).otherwise(self.number(b))
        return Term(self, value, max(c.level, a.level, b.level), f"where({c.key},{a.key},{b.key})")

    # -- plan --------------------------------------------------------------------
    def _below(self, values: Mapping[str, Column]) -> dict[str, set[str]]:
        """The staged columns that ``values`` need, each with the names it reads; the values' own names too."""
        words = lambda *vs: {w for v in vs for w in re.findall(r"\w+", v._jc.toString())}
        staged = {k: (v,) for part in (self.levels, self.parts) for columns in part.values() for k, v in columns.items()}
        staged |= {k: inputs for kernels in self.kernels.values() for k, (_, inputs, _) in kernels.items()}
        found = {k: words(v) for k, v in values.items()}
        todo = set().union(*found.values()) & set(staged)
        while todo:
            name = todo.pop()
            found[name] = words(*staged[name])
            todo |= (found[name] & set(staged)) - set(found)
        return found

    def select(self, outputs: Mapping[str, Term], by: str | None = None, stages: Stages | None = None) -> DataFrame:
        """The outputs by code and date. With ``stages`` they are written there in buckets of ``by``, a column of the panel."""
        df = self.panel.withColumn("_length", W.history_length())
        keys = ["code", "dt", *([by] if by else [])]
        write, stages = stages is not None, stages or Stages(self.panel.sparkSession, "code")
        values = {k: self.number(t) for k, t in outputs.items()}
        reads = self._below(values)
        levels = {x: {k: v for k, v in c.items() if k in reads} for x, c in sorted(self.levels.items())}
        levels = {x: c for x, c in levels.items() if c}
        parts, kernels = ({x: {k: v for k, v in of.get(x, {}).items() if k in reads} for x in levels} for of in (self.parts, self.kernels))
        for level, columns in levels.items():
            later = [k for x in levels if x >= level for k in (*levels[x], *parts[x], *kernels[x])]
            named = set().union(*[reads[k] for k in (*later, *values)])
            df = df.select(*[c for c in df.columns if c in named or c in keys])
            if level % 2:
                known = df.columns
                df = df.select("*", *[v.alias(k) for k, v in parts[level].items()])
                df = add_rolling(df, kernels[level]) if kernels[level] else df
                df = df.select(*known, *[v.alias(k) for k, v in columns.items()])
            else:
                # Ranks read their input several times; ranks of ranks would multiply that level by level.
                df = level_table = stages.write(df, "level")
                stages.keep_last()
                if self.whole_dates:
                    df = df.join(date_ranks(level_table, columns), ["code", "dt"], "left")
                    continue
                for names in (list(columns)[i : i + RANKED] for i in range(0, len(columns), RANKED)):
                    ranks = rank_table(level_table, {n: columns[n] for n in names}, by=["code"])
                    df = df.join(stages.write(ranks, "ranks"), ["code", "dt"], "left")
        df = df.select(*keys, *[S.clean(v).alias(k) for k, v in values.items()])
        if not write and all(level % 2 for level in levels):
            return df
        # Only a plan that is written joins the last ranks without moving the rows.
        df = stages.write(W.spread(df, [by]), "values", by) if by else stages.write(df, "values")
        stages.keep_last()
        return df


def formula_panel(bars: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Bars plus vwap and returns, with missing inputs filled as the catalogues expect; spread by code."""
    bars = W.spread(bars).withColumn("vwap", S.vwap(F.col("amount"), F.col("volume"))).withColumn(
        "returns", F.try_divide(F.col("close"), W.delay(F.col("close"))) - 1
    )
    columns = [F.col(c) if fill is None else F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in FIELDS]
    return bars.select("code", "dt", *columns)


def evaluate(
    panel: DataFrame, formulas: Mapping[str, Callable[[FormulaFrame], Term]], written: list[Stages] | None = None
) -> DataFrame:
    """Columns ``code, dt`` and one per formula. The tables that the result reads are added to ``written``, for a caller who can drop them.

    Formulas with ranks are staged in chunks, those of like depth together, so that what is on disk at once does not grow with their
    number: the panel, the levels of one chunk and the values that are done. The chunks' values are joined by a number of the panel's rows.
    """
    # The result is planned when it is read, so the setting stays.
    panel.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED))
    frame = FormulaFrame(panel)
    terms = {name: frame.term(fn(frame)) for name, fn in formulas.items()}
    if all(level % 2 for level in frame.levels):
        return frame.select(terms)
    stages = Stages(panel.sparkSession, "code")
    frame.panel = stages.write(panel.withColumn(ROW, F.monotonically_increasing_id()), "panel")
    frame.whole_dates = largest_group(frame.panel) <= DATE_ROWS
    order = sorted(terms, key=lambda name: terms[name].level)
    chunks = [order[i : i + CHUNK] for i in range(0, len(order), CHUNK)]
    by = ROW if len(chunks) > 1 else None
    values = [Stages(panel.sparkSession, "code") for _ in chunks]
    done = [frame.select({name: terms[name] for name in names}, by, left) for names, left in zip(chunks, values)]
    stages.drop()
    if written is not None:
        written += values
    out = done[0]
    for part in done[1:]:
        out = out.join(part.drop("code", "dt"), ROW)
    return out.select("code", "dt", *formulas)
