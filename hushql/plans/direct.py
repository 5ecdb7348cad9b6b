"""Ordinary histograms in SQL under direct access.

A block's ``count_histogram(column, bin)`` calls are answered beside it: rows are counted by value and values by bin, which
makes one histogram a group. The rest of the block is aggregated without them, and its groups, one row each, are joined to
their histograms on the keys. No group's values are ever gathered in a row, and no row of the table ever holds a histogram.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException

from hushql.config import HushError
from hushql.plans import ir
from hushql.plans.compiler import quoted
from hushql.plans.ir import kind_of, parts
from hushql.plans.statement import _TOKEN, extent, fresh, seq, spliced

NEXT = "\n, "  # after what may be a comment
NO_BINS = "cast(array() as array<array<bigint>>)"


def _clauses(text: str, start: int, end: int) -> dict[str, int]:
    """Where FROM, WHERE, GROUP and HAVING stand in a block itself."""
    depth, out = 0, {}
    for t in _TOKEN.finditer(text, start, end):
        depth += {"(": 1, ")": -1}.get(t[0], 0)
        word = t[0].upper()
        if not depth and word in ("FROM", "WHERE", "GROUP", "HAVING") and word not in out:
            out[word] = t.start()
    return out


def _pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Ranges of a list's items."""
    depth, commas = 0, []
    for t in _TOKEN.finditer(text, start, end):
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(t[0], 0)
        if not depth and t[0] == ",":
            commas.append(t.start())
    return list(zip([start, *(c + 1 for c in commas)], [*commas, end]))


def _blocks(node):
    """Blocks and the ORDER BY above each, blocks within after those around them."""
    stack = [node]
    while stack:
        node = stack.pop()
        order = node if kind_of(node) == "Sort" and getattr(node, "global")() else None
        if (made := parts(node.child() if order else node)) is not None:
            yield made, order
            node = made.items
        if kind_of(node) == "UnresolvedWith":
            stack += [item._2() for item in seq(node.cteRelations())]
        if kind_of(node) == "ExplainCommand":
            stack.append(node.logicalPlan())
        stack += [*seq(node.children().toSeq()), *seq(node.subqueries())]


def _same(a: ir.Expr, b: ir.Expr) -> bool:
    """Whether two expressions are alike but for their places."""
    told = lambda e: (e.kind, e.name, e.value, e.distinct, e.filtered, e.ordered, len(e.args), len(e.extra))
    return told(a) == told(b) and all(map(_same, (*a.args, *a.extra), (*b.args, *b.extra)))


def direct_histograms(spark, text: str) -> str | None:
    """``text`` with the histograms of one block answered; None where there is none left."""
    if not re.search(r"\bcount_histogram\b", text, re.IGNORECASE):
        return None
    found = None
    for made, order in _blocks(spark._jsparkSession.sessionState().sqlParser().parsePlan(text)):
        block = _Histograms(spark, text, made, order)
        found = block if block.calls else found
    return found and found.answered()


class _Histograms:
    """A block told apart: what is asked of its groups, and what is made of their histograms."""

    def __init__(self, spark, text: str, made, order):
        self.spark, self.text, self.made = spark, text, made
        items = seq(made.items.projectList() if kind_of(made.items) == "Project" else made.items.aggregateExpressions())
        self.targets = [ir.expression(e) for e in items]
        self.aliases = [e.name().lower() if kind_of(e) == "Alias" else None for e in items]
        self.having = [ir.expression(h.havingCondition()) for h in made.heads if kind_of(h) == "UnresolvedHaving"]
        self.sort = [] if order is None else [ir.expression(o.child()) for o in seq(order.order())]
        self.calls = [x for e in [*self.targets, *self.having, *self.sort] for x in e.walk() if x.kind == "call" and x.name == "count_histogram"]
        self.groups = fresh("groups")
        self.bins: dict[str, str] = {}  # views of histograms, by call
        self.asked: list[str] = []  # columns of the groups
        self.outside: dict[str, str] = {}  # what is made of histograms, by its alias

    def shown(self, e: ir.Expr) -> str:
        return self.text[e.start : e.stop + 1]

    def edited(self, start: int, end: int, edits: list) -> str:
        return spliced(self.text[start:end], [(a - start, b - start, new) for a, b, new in edits])

    def column(self, sql: str) -> str:
        self.asked.append(sql)
        return f"{self.groups}.hush_e{len(self.asked) - 1}"

    def histogram(self, call: ir.Expr) -> str:
        return f"coalesce({self.bins[self.shown(call)]}.hush_h, {NO_BINS})"

    def needs(self, e: ir.Expr) -> bool:
        """Whether an expression is made of histograms."""
        return any(x in self.calls or x.kind == "column" and x.name in self.outside for x in e.walk())

    def whole(self, e: ir.Expr) -> bool:
        """Whether an expression's place holds all its text: that of a predicate begins after its first operand."""
        try:
            return _same(ir.expression(self.spark._jsparkSession.sessionState().sqlParser().parseExpression(self.shown(e))), e)
        except (HushError, PySparkException):
            return False

    def split(self, e: ir.Expr, told: frozenset = frozenset(), inline: bool = False, bound: frozenset = frozenset()) -> list[tuple[int, int, str]]:
        """Edits of an expression over groups that have been joined to their histograms; names in ``told`` stay."""
        put = lambda new: [(e.start, e.stop + 1, new)]
        if e in self.calls:
            return put(self.histogram(e))
        if e.kind in ("literal", "ordinal", "star") or e.kind == "column" and e.name in told:
            return []
        if e.kind == "column" and e.name in self.outside:
            return put(f"({self.outside[e.name]})") if inline else []
        if e.name == "UnresolvedNamedLambdaVariable":
            return [] if e.value.split(".")[0] in bound else put(self.column(self.shown(e)))
        if e.name == "LambdaFunction":
            bound |= {a.value for a in e.args[1:]}
            return self.split(e.args[0], told, inline, bound)
        if not self.needs(e) and not any(x.kind == "column" and x.name in told for x in e.walk()) and self.whole(e):
            return put(self.column(self.shown(e)))
        return [edit for a in (*e.args, *e.extra) for edit in self.split(a, told, inline, bound)]

    def answered(self) -> str:
        text, shown = self.text, self.shown
        start, end = extent(text, self.made, ir.Block([(e, None) for e in self.targets], None, None, None, [], None))
        at = _clauses(text, start, end)
        stop = min([at[w] for w in ("GROUP", "HAVING") if w in at], default=end)
        source, where = text[at["FROM"] : at.get("WHERE", stop)], text[at["WHERE"] : stop] if "WHERE" in at else ""
        group = [ir.expression(g) for g in seq(self.made.items.groupingExpressions())] if kind_of(self.made.items) == "Aggregate" else []
        keys = [shown(self.targets[int(g.value) - 1] if g.kind == "ordinal" else g) for g in group]
        for call in self.calls:
            if shown(call) not in self.bins:
                self.bins[shown(call)] = self._bins(call, keys, f"{source}\n{where}\n")
        # As with any other aggregate in their place, so that Spark refuses what isn't a block's to ask.
        self.spark.sql(self.edited(start, end, [(c.start, c.stop + 1, f"coalesce(any_value({NO_BINS}), {NO_BINS})") for c in self.calls if start <= c.start < end]))

        head = re.compile(r"SELECT\s*((?:/\*.*?\*/\s*)*)((?:DISTINCT|ALL)\b)?", re.IGNORECASE | re.DOTALL).match(text, start)
        pieces = _pieces(text, head.end(), at["FROM"])
        if len(pieces) != len(self.targets):
            raise HushError("Feature 'this list beside count_histogram' is not currently supported.")
        own = {c.lower() for c in self.spark.sql(f"SELECT * {source}").columns}
        edits, kept = [], []
        for e, alias, piece in zip(self.targets, self.aliases, pieces):
            if self.needs(e):
                edits += self.split(e)
                if alias and alias not in own:
                    words = [t for t in _TOKEN.finditer(text, *piece) if not t[0].startswith(("--", "/*"))]
                    named = words[-2 if words[-2][0].upper() == "AS" else -1].start()
                    self.outside[alias] = self.edited(piece[0], named, self.split(e, inline=True))
            else:
                self.column(text[slice(*piece)])
                kept.append((piece, len(self.asked) - 1))
        condition, until = "", end
        if self.having and self.needs(self.having[0]):
            until = at["HAVING"]
            condition = " WHERE " + self.edited(until + len("HAVING"), end, self.split(self.having[0], inline=True))
        names = {a or e.name.rpartition(".")[2] for a, e in zip(self.aliases, self.targets) if a or e.kind == "column"}
        for e in self.sort:
            edits += self.split(e, frozenset(names | {"all"}))
        on = [self.column(k) for k in keys]
        if not keys:
            self.column("count(*)")
        ordinals = [(g.start, g.stop + 1, k) for g, k in zip(group, keys) if g.kind == "ordinal"]
        frame = self.spark.sql(f"SELECT {head[1]}{NEXT.join(self.asked)}\n{self.edited(at['FROM'], until, ordinals)}")
        frame.toDF(*(f"hush_e{i}" for i in range(len(self.asked)))).createOrReplaceTempView(self.groups)
        edits += [(*piece, f" {self.groups}.hush_e{i} AS {quoted(frame.columns[i])} ") for piece, i in kept]
        joins = "".join(f" LEFT JOIN {name} ON " + (" AND ".join(f"{k} <=> {name}.hush_k{i}" for i, k in enumerate(on)) or "true") for name in self.bins.values())
        return spliced(text, [*dict.fromkeys(edits), (at["FROM"], end, f" FROM {self.groups}{joins}{condition} ")])

    def _bins(self, call: ir.Expr, keys: list[str], source: str) -> str:
        """View of the one histogram of each group."""
        size = int(call.args[1].value) if len(call.args) > 1 and call.args[1].kind == "literal" and call.args[1].value is not None else 1 if len(call.args) == 1 else 0
        if size < 1:
            raise HushError("count_histogram bin size must be a positive constant.")
        names = [f"hush_k{i}" for i in range(len(keys))]
        select = ", ".join(f"{k} AS {n}" for k, n in zip(keys, names))
        by, comma = ", ".join(names), ", " if names else ""
        valued = f"SELECT {select}{comma}{self.shown(call.args[0])} AS hush_v {source}"
        counted = f"SELECT {by}{comma}count(*) div {size} * {size} AS hush_b FROM ({valued}) WHERE hush_v IS NOT NULL GROUP BY {by}{comma}hush_v"
        binned = f"SELECT {by}{comma}hush_b, count(*) AS hush_s FROM ({counted}) GROUP BY {by}{comma}hush_b"
        listed = f"SELECT {by}{comma}transform(array_sort(collect_list(struct(hush_b, hush_s))), x -> array(x.hush_b, x.hush_s)) AS hush_h FROM ({binned})" + (f" GROUP BY {by}" if by else "")
        self.spark.sql(listed).createOrReplaceTempView(name := fresh("bins"))
        return name
