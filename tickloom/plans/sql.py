"""Small helper to write the ANSI SQL twin of a query as a chain of CTEs."""

from __future__ import annotations

EVENT = """b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
 arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
 CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
USER = EVENT.replace("event_type AS", "CAST(user_id AS VARCHAR) AS")
SUPPLY = """b AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts,
 arg_min(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
 min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS close,
 CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem GROUP BY 1, 2)"""
ORDERS = """b AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts,
 arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
 arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)"""

W = "OVER (PARTITION BY symbol ORDER BY ts)"


def R(n):
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def B(n):
    """The n rows before the current one."""
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


U = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def lag(c, k=1):
    return f"lag({c}, {k}) {W}"


def lead(c, k=1):
    return f"lead({c}, {k}) {W}"


def roll(fn, c, n):
    return f"(CASE WHEN count({c}) {R(n)} >= {n} THEN {fn}({c}) {R(n)} END)"


def div(a, b):
    return f"(({a}) / nullif(({b}), 0))"


def chg(a, b):
    return f"({div(a, b)} - 1)"


def flag(c):
    return f"CAST(coalesce({c}, false) AS INTEGER)"


def rank(c, n):
    """Average-tie percent rank of the value in its last n values (needs list column)."""
    return f"(CASE WHEN len({c}_l) = {n} THEN (len(list_filter({c}_l, lambda v: v < {c})) + (len(list_filter({c}_l, lambda v: v = {c})) + 1) / 2.0) / {n} END)"


def lst(c, n):
    return f"list({c}) FILTER (WHERE {c} IS NOT NULL) {R(n)}"


class Sql:
    def __init__(self, *base: str):
        self.ctes = list(base)
        self.last = "b"

    def step(self, **cols: str) -> Sql:
        name = f"s{len(self.ctes)}"
        self.ctes.append(f"{name} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {self.last})")
        self.last = name
        return self

    def cte(self, body: str, name: str | None = None) -> Sql:
        """A free CTE; {last} stands for the previous one."""
        name = name or f"s{len(self.ctes)}"
        self.ctes.append(f"{name} AS ({body.replace('{last}', self.last)})")
        self.last = name
        return self

    def number(self) -> Sql:
        return self.step(bar_no=f"row_number() {W} - 1")

    def out(self, doubles="", plain="", keys="symbol ts", tail="", digits=6) -> str:
        cols = [*keys.split(), *[f"round(CAST({c} AS DOUBLE) * 1.00000000001::DOUBLE, {digits}) + 0 AS {c}" for c in doubles.split()], *plain.split()]
        return f"WITH RECURSIVE {', '.join(self.ctes)} SELECT {', '.join(cols)} FROM {self.last} {tail}"


def ema(x, span, seed="first", start=0, wilder=False, n="bar_no", order="ts"):
    """Exponential average as an ordered list fold up to the current row (oracle only)."""
    a = 1 / span if wilder else 2 / (span + 1)
    lists = f"list({x}) FILTER (WHERE {n} >= {start}) {U}"
    if seed == "first":
        return f"list_reduce({lists}, lambda acc, v: {a!r} * v + {1 - a!r} * acc)"
    if seed == "weighted":
        # the weights depend on the age only: numerator and denominator by the same fold
        num = f"list_reduce({lists}, lambda acc, v: v + {1 - a!r} * acc)"
        k = f"({n} - {start} + 1)"
        return f"(CASE WHEN {k} = 1 THEN {x} ELSE {num} / ((1 - pow({1 - a!r}, {k})) / {a!r}) END)"
    last = start + span - 1
    tail = f"list({x}) FILTER (WHERE {n} > {last}) {U}"
    first = f"sum({x}) FILTER (WHERE {n} BETWEEN {start} AND {last}) {U} / {span}"
    return f"(CASE WHEN {n} >= {last} THEN list_reduce(list_concat([{first}], coalesce({tail}, [])), lambda acc, v: {a!r} * v + {1 - a!r} * acc) END)"
