"""One query block as plain Python: read from the unresolved tree of Spark's own parser."""

from __future__ import annotations

from dataclasses import dataclass, field

from hushql.config import HushError

SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
#: Nodes that a query block can be made of, from the outside in.
HEADS = {"UnresolvedHaving", "Distinct", "WithWindowDefinition", "UnresolvedHint"}
LISTS = {"Project", "Aggregate"}


@dataclass(frozen=True)
class Expr:
    kind: str  # column, literal, call, cast, star, ordinal, subquery, window or other
    name: str = ""
    args: tuple[Expr, ...] = ()
    value: object = None
    start: int = -1
    stop: int = -1
    distinct: bool = False
    filtered: bool = False
    ordered: bool = False

    extra: tuple[Expr, ...] = ()  # a call's filter and order

    def walk(self):
        yield self
        for a in (*self.args, *self.extra):
            yield from a.walk()


@dataclass
class Relation:
    name: str
    alias: str
    sql: str = ""  # the name with each part quoted
    start: int = -1
    stop: int = -1


@dataclass
class Join:
    left: object
    right: object
    how: str
    on: Expr | None = None
    using: tuple[str, ...] = ()
    natural: bool = False


@dataclass
class Block:
    targets: list[tuple[Expr, str | None]]
    group: list[Expr] | None
    where: Expr | None
    having: Expr | None
    sort: list[tuple[Expr, str]]
    source: object
    features: list[str] = field(default_factory=list)
    condition: str = ""  # the filter as Spark writes it

    def relations(self) -> list[Relation]:
        out: list[Relation] = []

        def walk(node) -> None:
            if isinstance(node, Relation):
                out.append(node)
            elif isinstance(node, Join):
                walk(node.left)
                walk(node.right)

        walk(self.source)
        return out


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _option(o):
    return o.get() if o.isDefined() else None


def expression(node) -> Expr:
    kind = kind_of(node)
    at = dict(zip(("start", "stop"), place(node)))
    children = lambda: tuple(map(expression, _seq(node.children().toSeq())))
    if kind in ("Alias", "UnresolvedAlias"):
        return expression(node.child())
    if kind == "UnresolvedAttribute":
        return Expr("column", ".".join(_seq(node.nameParts())).lower(), **at)
    if kind == "UnresolvedNamedLambdaVariable":
        return Expr("other", kind, value=".".join(_seq(node.nameParts())).lower(), **at)
    if kind == "Literal":
        kind_, value = node.dataType().simpleString(), node.value()
        if value is not None:
            value = node.sql() if kind_ in ("date", "timestamp", "timestamp_ntz", "time(6)") else str(value)
        return Expr("literal", kind_, value=value, **at)
    if kind in ("UnresolvedStar", "UnresolvedStarExceptOrReplace"):
        return Expr("star", **at)
    if kind == "UnresolvedOrdinal":
        return Expr("ordinal", value=node.ordinal(), **at)
    if kind in SUBQUERIES:
        return Expr("subquery", kind, **at)
    if kind == "UnresolvedFunction":
        name = ".".join(_seq(node.nameParts())).lower()
        where, order = _option(node.filter()), _seq(node.orderingWithinGroup())
        extra = tuple(expression(x) for x in [*order, *([] if where is None else [where])])
        return Expr("call", name, tuple(map(expression, _seq(node.arguments()))), distinct=node.isDistinct(), filtered=where is not None, ordered=bool(order), extra=extra, **at)
    if kind == "Cast":
        return Expr("cast", node.dataType().simpleString(), children(), **at)
    if kind == "Substring":
        return Expr("call", "substring", children(), **at)
    if kind in ("Round", "Floor", "Ceil"):
        return Expr("call", kind.lower(), children(), **at)
    if kind == "WindowExpression":
        return Expr("window", kind, children(), **at)
    return Expr("other", kind, children(), **at)


def named(node) -> Relation:
    """The relation that an UnresolvedRelation names."""
    parts = _seq(node.multipartIdentifier())
    start, stop = place(node)
    return Relation(".".join(parts).lower(), parts[-1].lower(), ".".join("`" + p.replace("`", "``") + "`" for p in parts), start, stop)


def place(node) -> tuple[int, int]:
    """First and last place of a node in its statement, -1 where unknown."""
    origin = node.origin()
    start, stop = _option(origin.startIndex()), _option(origin.stopIndex())
    return (-1 if start is None else start), (-1 if stop is None else stop)


def _source(node) -> object:
    """Relations and joins of a FROM clause; anything else can't stand there in an anonymizing block."""
    kind = kind_of(node)
    if kind == "SubqueryAlias":
        inner = _source(node.child())
        if isinstance(inner, Relation) and kind_of(node.child()) == "UnresolvedRelation":
            return Relation(inner.name, node.identifier().name().lower(), inner.sql, inner.start, inner.stop)
        return "subquery"
    if kind == "UnresolvedRelation":
        return named(node)
    if kind == "Join":
        how = node.joinType()
        text, using, natural = str(how.sql() if not how.toString().startswith(("UsingJoin", "NaturalJoin")) else how.tpe().sql()), (), False
        if how.toString().startswith("UsingJoin"):
            using = tuple(c.lower() for c in _seq(how.usingColumns()))
        elif how.toString().startswith("NaturalJoin"):
            natural = True
        cond = _option(node.condition())
        return Join(_source(node.left()), _source(node.right()), text, None if cond is None else expression(cond), using, natural)
    if kind in ("Project", "Aggregate", "OneRowRelation", "LateralJoin", "LocalRelation", "UnresolvedInlineTable", *HEADS):
        return "subquery"
    if kind == "Generate":
        raise HushError("Feature 'SRF functions' is not currently supported.")
    raise HushError(f"Feature '{kind}' is not currently supported.")


def kind_of(node) -> str:
    return node.getClass().getSimpleName().removesuffix("$")


@dataclass
class Parts:
    """The nodes of a query block."""

    heads: list
    items: object
    filter: object
    source: object


def parts(node) -> Parts | None:
    """The parts of the block that ``node`` is the top of; None if it is none."""
    heads = []
    while kind_of(node) in HEADS:
        heads.append(node)
        node = node.child()
    if kind_of(node) not in LISTS:
        return None
    below = node.child()
    where = below if kind_of(below) == "Filter" else None
    return Parts(heads, node, where, below.child() if where is not None else below)


def block(made: Parts, order=None) -> Block:
    """A query block, with the ORDER BY above it."""
    features, sort, having, group = [], [], None, None
    for o in [] if order is None else _seq(order.order()):
        sort.append((expression(o.child()), f"{o.direction().sql()} {o.nullOrdering().sql()}"))
    for head in made.heads:
        kind = kind_of(head)
        if kind == "UnresolvedHaving":
            having = expression(head.havingCondition())
        elif kind != "UnresolvedHint":
            features.append({"WithWindowDefinition": "window functions", "Distinct": "DISTINCT"}[kind])
    if kind_of(made.items) == "Aggregate":
        group = [expression(e) for e in _seq(made.items.groupingExpressions())]
        items = _seq(made.items.aggregateExpressions())
    else:
        items = _seq(made.items.projectList())
    targets = [(expression(e), e.name() if kind_of(e) == "Alias" else None) for e in items]
    where = None if made.filter is None else expression(made.filter.condition())
    if any(g.kind == "other" and g.name in ("GroupingSets", "Cube", "Rollup") for g in group or []):
        features.append("GROUPING SETS")
    return Block(targets, group, where, having, sort, _source(made.source), features, "" if made.filter is None else made.filter.condition().sql())
