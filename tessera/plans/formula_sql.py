"""The formula vocabulary written as DuckDB SQL, for checking the catalogues.

Same method names as :class:`FormulaFrame`, so a recipe called with this frame yields the SQL
of the same formula: one common table expression per level.
"""

from __future__ import annotations

from tessera.plans.registry import P, digits_sql, over
from tessera.plans.staging import FIELDS, FormulaFrame, Term


def rank_sql(v: str) -> str:
    return (
        f"case when {v} is not null then (rank() over (partition by dt order by {v} nulls last) + "
        f"(count(*) over (partition by dt, {v}) - 1) / 2.0) / nullif(count({v}) over (partition by dt), 0) end"
    )


def _full(aggregate, v, n):
    return f"case when count({v}) {over(n)} = least({n}, _length) then {aggregate} {over(n)} end"


def _warm(n, value):
    return f"case when row_number() {P} < least({n}, _length) then 0 else {value} end"


def _decay(v, n):
    terms = " + ".join(f"coalesce(lag({v}, {k}) {P}, 0) * {k + 1}" for k in range(n))
    return _warm(n, f"round(({terms}) / (least({n}, _length) * (least({n}, _length) + 1) / 2.0), 11)")


def _since(v, n, best):
    place = f"list_position(list_reverse(list({v}) {over(n)}), {best}({v}) {over(n)}) - 1"
    return f"case when count({v}) {over(n)} = least({n}, _length) then cast({place} as double) end"


def _ts_rank(v, n):
    less, same = (f"len(list_filter(list({v}) {over(n)}, lambda e: e {op} list_last(list({v}) {over(n)})))" for op in ("<", "="))
    scaled = f"coalesce(2 * (({less} + ({same} - 1) / 2.0) / nullif(count({v}) {over(n)} - 1, 0) - 0.5), 0)"
    return f"case when count({v}) {over(n)} = least({n}, _length) and {v} is not null then {scaled} end"


def _regbeta(v, n):
    m = f"least({n}, _length)"
    terms = " + ".join(f"coalesce(lag({v}, {k}) {P}, 0) * (({m} - 1) / 2.0 - {k})" for k in range(n))
    return _warm(n, f"({terms}) * 12.0 / nullif({m} * ({m} * {m} - 1), 0) * {m} / nullif({m} - 1, 0)")


ROLLING = {
    "delay": lambda v, k=1: f"{'lag' if k >= 0 else 'lead'}({v}, {abs(int(k))}) {P}",
    "delta": lambda v, k=1: f"({v}) - lag({v}, {int(k)}) {P}",
    "ts_sum": lambda v, n: _full(f"sum({v})", v, n),
    "mean": lambda v, n=10: _full(f"avg({v})", v, n),
    "stddev": lambda v, n=10: _full(f"stddev_pop({v})", v, n),
    "ts_min": lambda v, n: _full(f"min({v})", v, n),
    "ts_max": lambda v, n: _full(f"max({v})", v, n),
    "ts_argmax": lambda v, n: _since(v, n, "max"),
    "ts_argmin": lambda v, n: _since(v, n, "min"),
    "ts_rank": _ts_rank,
    "product": lambda v, n: _warm(n, f"product(coalesce({v}, 0)) {over(n)}"),
    "decay_linear": _decay,
    "lowday": lambda v, n: _warm(
        n, f"len(list(coalesce({v}, 0)) {over(n)}) - list_position(list(coalesce({v}, 0)) {over(n)}, min(coalesce({v}, 0)) {over(n)})"
    ),
    "highday": lambda v, n: _warm(
        n, f"list_position(list_reverse(list(coalesce({v}, 0)) {over(n)}), max(coalesce({v}, 0)) {over(n)}) - 1"
    ),
    "regbeta": _regbeta,
    "sma": lambda v, n, m: f"case when row_number() {P} = 1 then {v} else (({v}) * {m} + lag({v}) {P} * {n - m}) / {float(n)} end",
}


class SqlFrame(FormulaFrame):
    def __init__(self):
        self.levels, self.names, self.length = {}, {}, None

    def term(self, value):
        return value if isinstance(value, Term) else Term(self, f"({float(value)!r}::double)", 0, repr(float(value)))

    def field(self, name, level=0):
        return Term(self, name, level, name)

    def _placer(self, level):
        return None

    def number(self, t):
        return f"(case when {t.value} then 1.0 else 0.0 end)::double" if t.boolean else t.value

    def binary(self, op, a, b):
        level, key = max(a.level, b.level), f"({a.key} {op} {b.key})"
        x, y = self.number(a), self.number(b)
        if op in "&|":
            return Term(self, f"({a.value} {'and' if op == '&' else 'or'} {b.value})", level, key, True)
        if op in ("<", "<=", ">", ">=", "=="):
            return Term(self, f"coalesce({x} {op.replace('==', '=')} {y}, false)", level, key, True)
        if op == "/":
            return Term(self, f"({x} / nullif({y}, 0))", level, key)
        if op == "**":
            return Term(self, f"(case when ({x} < 0 and ({y}) <> floor({y})) or ({x} = 0 and ({y}) < 0) then null else pow({x}, {y}) end)", level, key)
        return Term(self, f"({x} {op} {y})", level, key)

    def _rolling(self, fn, x, *args, **kw):
        x = self.term(x)
        return self._along(f"{fn.__name__}({x.key},{args})", lambda _: ROLLING[fn.__name__](self.number(x), *args), x)

    def rank(self, x):
        x = self.term(x)
        return self._stage(False, f"rank({x.key})", lambda _: rank_sql(self.number(x)), x)

    def count(self, condition, n):
        t = self.term(condition)
        least = n - 1 if n <= 10 else n * 2 // 3
        value = f"case when row_number() {P} >= {least} then sum({self.number(t)}) {over(n)} end"
        return self._along(f"count({t.key},{n})", lambda _: value, t)

    def sumif(self, x, n, condition):
        x, c = self.term(x), self.term(condition)
        value = _warm(n, f"sum(case when {c.value} then coalesce({self.number(x)}, 0) else 0 end) {over(n)}")
        return self._along(f"sumif({x.key},{n},{c.key})", lambda _: value, x, c)

    def _pairwise(self, fn, x, y, n):
        x, y = self.term(x), self.term(y)
        a, b = self.number(x), self.number(y)
        pairs = f"count(case when ({a}) is not null and ({b}) is not null then 1 end) {over(n)} = {n}"
        if fn.__name__ == "covariance":
            value = f"case when {pairs} then round(covar_samp({a}, {b}) {over(n)}, 11) end"
        else:
            sa, sb = f"stddev_pop({a}) {over(n)}", f"stddev_pop({b}) {over(n)}"
            value = f"case when {pairs} and {sa} > 1e-9 and {sb} > 1e-9 then round(covar_pop({a}, {b}) {over(n)} / ({sa} * {sb}), 9) end"
        return self._along(f"{fn.__name__}({x.key},{y.key},{n})", lambda _: value, x, y)

    def _row(self, name, fn, *inputs):
        terms = [self.term(t) for t in inputs]
        v = [self.number(t) for t in terms]
        text = {
            "log": lambda: f"round(case when {v[0]} > 0 then ln({v[0]}) end, 12)",
            "abs": lambda: f"abs({v[0]})",
            "sign": lambda: f"cast(sign({v[0]}) as double)",
            "scale": lambda: f"({v[0]} / 1000.0)",
            "signedpower": lambda: f"(case when {v[0]} = 0 and {v[1]} < 0 then null else sign({v[0]}) * pow(abs({v[0]}), {v[1]}) end)",
            "min": lambda: f"least({v[0]}, {v[1]})",
            "max": lambda: f"greatest({v[0]}, {v[1]})",
        }[name]()
        return Term(self, text, max(t.level for t in terms), f"{name}({','.join(t.key for t in terms)})")

    def where(self, condition, yes, no):
        c, a, b = self.term(condition), self.term(yes), self.term(no)
        text = f"(case when {c.value} then {self.number(a)} else {self.number(b)} end)"
        return Term(self, text, max(c.level, a.level, b.level), f"where({c.key},{a.key},{b.key})")

    def sql(self, outputs):
        """The levels as common table expressions on top of the view ``fp``."""
        ctes, source = {}, "fp"
        for level in sorted(self.levels):
            columns = ", ".join(f"{v} as {k}" for k, v in self.levels[level].items())
            ctes[f"f{level}"] = f"select *, {columns} from {source}"
            source = f"f{level}"
        values = {k: self.number(t) for k, t in outputs.items()}
        finals = ", ".join(f"{v} as {k}" for k, v in values.items())
        ctes["fz"] = f"select code, dt, {finals} from {source}"
        body = ", ".join(f"{digits_sql(k)} as {k}" for k in values)
        source = "fz"
        return ctes, f"select code, dt, {body} from {source}"


PANEL_SQL = {
    "fp0": f"select *, amount * 1000 / (volume * 100 + 1) as vwap, close / nullif(lag(close) {P}, 0) - 1 as returns from bars_d",
    "fp": f"select code, dt, {', '.join(f'coalesce({c}, 0) as {c}' for c in FIELDS)}, count(*) over (partition by code) as _length from fp0",
}


def formulas_sql(formulas) -> tuple[dict, str]:
    frame = SqlFrame()
    ctes, body = frame.sql({name: frame.term(fn(frame)) for name, fn in formulas.items()})
    return PANEL_SQL | ctes, body
