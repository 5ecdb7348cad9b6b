"""From a query block over personal tables to its relational program, with the checks that anonymized access asks for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushql.config import AccessLevel, Config, HushError
from hushql.functions import hashing as H
from hushql.functions import scalar
from hushql.labels import Catalog
from hushql.operators.program import Family, Spec, run
from hushql.plans.ir import Block, Expr, Join, Relation

AGGREGATES = {"count", "sum", "avg", "count_noise", "sum_noise", "avg_noise", "count_histogram", "is_suppress_bin"}
OTHER_AGGREGATES = {
    "min", "max", "mean", "stddev", "stddev_pop", "stddev_samp", "std", "variance", "var_pop", "var_samp", "first", "last",
    "any_value", "collect_list", "collect_set", "array_agg", "listagg", "string_agg", "bool_and", "bool_or", "every", "some", "any",
    "bit_and", "bit_or", "bit_xor", "corr", "covar_pop", "covar_samp", "median", "mode", "percentile", "percentile_approx",
    "approx_count_distinct", "count_if", "max_by", "min_by", "sum_distinct",
}
GENERATORS = {"explode", "explode_outer", "posexplode", "inline", "stack", "generate_series", "unnest_histogram"}
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
DATETIME = ("date", "timestamp", "timestamp_ntz", "time")
UNSUPPORTED = "Feature '{}' is not currently supported."


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Column:
    table: Relation
    name: str
    type: str
    aid: bool
    open: bool

    @property
    def sql(self) -> str:
        return f"{quoted(self.table.alias)}.{quoted(self.name)}"

    @property
    def material(self) -> str:
        return f"{self.table.name.rpartition('.')[2]}.{self.name}"


@dataclass
class Compiled:
    frame: DataFrame
    names: list[str]
    sort: list[str]


class Compiler:
    def __init__(self, catalog: Catalog, config: Config, level: AccessLevel, block: Block, text: str):
        self.catalog, self.config, self.level, self.block, self.text = catalog, config, level, block, text
        self.spark = catalog.spark
        self.tables = block.relations()
        self.columns: list[Column] = []
        for t in self.tables:
            personal = catalog.is_personal(t.name, config.treat_unmarked_tables_as_public)
            aids, closed = catalog.aids.get(t.name, []) if personal else [], catalog.closed.get(t.name, set())
            self.columns += [Column(t, f.name.lower(), f.dataType.simpleString(), f.name.lower() in aids, f.name.lower() not in closed) for f in self.spark.table(t.sql).schema]
        self.aids = [c for c in self.columns if c.aid]
        self.families: list[Family] = []
        self.args: dict[str, str] = {}

    # Names

    def column(self, e: Expr) -> Column:
        head, _, name = e.name.rpartition(".")
        if name in ("_metadata",) or head == "_metadata":
            raise HushError("System columns are not allowed in this context.")
        found = [c for c in self.columns if c.name == name and (not head or head in (c.table.alias, c.table.name))]
        if not found:
            raise HushError(f"Column '{e.name}' does not exist.")
        if len(found) > 1 and not (self._merged(name)):
            raise HushError(f"Column reference '{e.name}' is ambiguous.")
        return next((c for c in found if c.aid), found[0])

    def _merged(self, name: str) -> bool:
        out = []

        def walk(node) -> None:
            if isinstance(node, Join):
                out.append(node.natural or name in node.using)
                walk(node.left)
                walk(node.right)

        walk(self.block.source)
        return any(out)

    def key(self, e: Expr) -> tuple:
        """What makes two expressions the same."""
        if e.kind == "column":
            c = self.column(e)
            return ("column", c.table.alias, c.name)
        return (e.kind, e.name, str(e.value), e.distinct, tuple(map(self.key, e.args)))

    # Checks

    def check(self) -> None:
        b = self.block
        for feature in b.features:
            raise HushError(UNSUPPORTED.format(feature))
        everything = [e for e, _ in b.targets] + (b.group or []) + [x for x in (b.where, b.having) if x] + [e for e, _ in b.sort]
        for e in (x for top in everything for x in top.walk()):
            if e.kind == "subquery" or e.name in ("InSubquery", "Exists", "ScalarSubquery"):
                raise HushError(UNSUPPORTED.format("SubLinks"))
            if e.kind == "window":
                raise HushError(UNSUPPORTED.format("window functions"))
            if e.kind == "call" and e.name in GENERATORS:
                raise HushError(UNSUPPORTED.format("SRF functions"))
            if e.kind == "star" or e.kind == "column" and e.name == "_metadata":
                if e.kind == "column":
                    raise HushError("System columns are not allowed in this context.")
        self._check_joins(b.source)

    def _check_joins(self, node) -> None:
        if node == "subquery":
            raise HushError(UNSUPPORTED.format("Subqueries in anonymizing queries"))
        if not isinstance(node, Join):
            return
        if node.how.upper() in ("LEFT SEMI", "LEFT ANTI"):
            raise HushError(UNSUPPORTED.format("SEMI JOIN in anonymizing queries"))
        if not node.natural and not node.using:
            if node.on is None:
                raise HushError(UNSUPPORTED.format("CROSS JOIN in anonymizing queries"))
            for e in self._equalities(node.on):
                if any(self._uncast(a).kind != "column" for a in e.args):
                    raise HushError("Only equalities between columns are allowed in JOIN conditions.")
        self._check_joins(node.left)
        self._check_joins(node.right)

    def _equalities(self, e: Expr) -> list[Expr]:
        if e.kind == "other" and e.name == "And":
            return [x for a in e.args for x in self._equalities(a)]
        if e.kind == "other" and e.name == "EqualTo":
            return [e]
        raise HushError("Only equalities are allowed in pre-anonymization filters.")

    @staticmethod
    def _uncast(e: Expr) -> Expr:
        while e.kind == "cast":
            e = e.args[0]
        return e

    def _type(self, e: Expr) -> str:
        if e.kind == "column":
            return self.column(e).type
        return e.name if e.kind in ("cast", "literal") else "double"

    def bucket(self, e: Expr) -> Column:
        """Check a generalization; returns the column that it stands on."""
        inner = e
        while inner.kind == "cast":
            if inner.name in ("string",) or inner.name.startswith(("varchar", "char")):
                if not self._type(inner.args[0]).startswith(DATETIME):
                    raise HushError("Unsupported cast destination type name.")
            inner = inner.args[0]
        if inner.kind == "column":
            return self.column(inner)
        if inner.kind == "literal":
            raise HushError("Simple constants are not allowed as generalization expressions.")
        if inner.kind == "call":
            name = inner.name
            if name not in scalar.PRIMARY or name == "date_trunc" and len(inner.args) > 2:
                raise HushError("Unsupported function used for generalization.")
            at = scalar.PRIMARY[name]
            primary = inner.args[at] if at < len(inner.args) else inner.args[0]
            while primary.kind == "cast":
                if primary.name == "string" and not self._type(primary.args[0]).startswith(DATETIME):
                    raise HushError("Unsupported cast destination type name.")
                kind = self._type(primary.args[0])
                if primary.name in ("int", "bigint", "smallint", "tinyint") and kind.startswith(("float", "double", "decimal")):
                    raise HushError("Primary argument for a generalization function has to be a simple column reference.")
                primary = primary.args[0]
            if primary.kind != "column":
                raise HushError("Primary argument for a generalization function has to be a simple column reference.")
            if any(a.kind != "literal" for k, a in enumerate(inner.args) if k != at):
                raise HushError("Non-primary arguments for a generalization function have to be simple constants.")
            if name in ("date_trunc", "extract", "date_part") and self.column(primary).type.startswith(("time(", "interval")):
                raise HushError("Unsupported function used for generalization.")
            return self.column(primary)
        if inner.name in ("Add", "Subtract", "Multiply", "Divide", "Concat", "UnaryMinus", "Remainder", "BitwiseAnd", "BitwiseOr"):
            raise HushError("Use of operators for generalization is not supported.")
        raise HushError("Unsupported generalization expression.")

    def check_untrusted(self, e: Expr) -> None:
        refused = HushError("Used generalization expression is not allowed in untrusted access level.")
        if e.kind == "column":
            return
        if e.kind != "call" or e.name not in scalar.UNTRUSTED:
            raise refused
        if e.name in ("substring", "substr") and float(e.args[1].value) != 1:
            raise refused
        if e.name in ("floor_by", "round_by") and not H.is_money(float(e.args[1].value)):
            raise refused

    # SQL of checked expressions

    def sql(self, e: Expr) -> str:
        if e.kind == "column":
            return self.column(e).sql
        if e.kind == "literal":
            return "null" if e.value is None else "'" + str(e.value).replace("\\", "\\\\").replace("'", "\\'") + "'" if e.name == "string" else str(e.value)
        if e.kind == "cast":
            inner, kind = self.sql(e.args[0]), self._type(e.args[0])
            if e.name in ("tinyint", "smallint", "int", "bigint") and (kind in ("float", "double") or kind.startswith("decimal")):
                return f"cast({'round' if kind.startswith('decimal') else 'rint'}({inner}) as {e.name})"
            return f"cast({inner} as {e.name})"
        return scalar.call(e.name, [self.sql(a) for a in e.args], [self._type(a) for a in e.args])

    def material(self, e: Expr) -> str:
        """What a generalization contributes to the seed: function names, column and constants, without casts."""
        parts: list[str] = []

        def walk(x: Expr) -> None:
            if x.kind == "cast":
                walk(x.args[0])
            elif x.kind == "column":
                parts.append(self.column(x).material)
            elif x.kind == "literal":
                parts.append(self.constant(x))
            else:
                parts.append("extract" if x.name == "date_part" else x.name)
                for a in x.args:
                    walk(a)

        walk(e)
        out = ",".join(parts)
        if len(out.encode()) > 1024:
            raise HushError("Bucket seed material is too long.")
        return out

    @staticmethod
    def constant(e: Expr) -> str:
        if e.value is None:
            return "NULL"
        if e.name.startswith(NUMERIC):
            return H.number_text(float(e.value))
        if e.name in ("date", "timestamp", "timestamp_ntz"):
            text = str(e.value).partition("'")[2].rstrip("'")
            return text if e.name == "date" else text.replace(" ", "T") + ("+00:00" if e.name == "timestamp" else "")
        return {"true": "t", "false": "f"}.get(e.value, e.value) if e.name == "boolean" else str(e.value)

    # Compilation

    def family(self, f: Family) -> int:
        if f not in self.families:
            self.families.append(f)
        return self.families.index(f)

    def argument(self, e: Expr) -> tuple[str, str, Column]:
        inner = self._uncast(e)
        if inner.kind != "column" or inner is not e and self._type(e) == "string":
            raise HushError("Unsupported expression as aggregate argument.")
        c = self.column(inner)
        sql = self.sql(e)
        self.args.setdefault(sql, f"x{len(self.args)}")
        return self.args[sql], self._type(e), c

    def aggregate(self, e: Expr) -> str:
        """SQL over the program's result for an aggregate call."""
        name = e.name
        if e.filtered:
            raise HushError(UNSUPPORTED.format("FILTER clauses in aggregate expressions"))
        if e.ordered:
            raise HushError(UNSUPPORTED.format("ORDER BY clauses in aggregate expressions"))
        if name == "is_suppress_bin":
            return "star"
        if name == "count_histogram":
            if e.distinct:
                raise HushError("Unsupported distinct qualifier at aggregate argument.")
            if e.args[0].kind != "column" or not self.column(e.args[0]).aid:
                raise HushError("count_histogram argument must be an AID column.")
            size = e.args[1].value if len(e.args) > 1 and e.args[1].kind == "literal" else 1 if len(e.args) == 1 else None
            if size is None or int(size) < 1:
                raise HushError("count_histogram bin size must be a positive constant.")
            if self.level == AccessLevel.ANONYMIZED_UNTRUSTED and not H.is_money(float(size)):
                raise HushError("Used generalization expression is not allowed in untrusted access level.")
            return f"v{self.family(Family('histogram', '', '', self.aids.index(self.column(e.args[0])), int(size)))}"
        fn, noise = name.removesuffix("_noise"), name.endswith("_noise")
        column = "s" if noise else "v"
        star = not e.args or e.args[0].kind == "star" or fn == "count" and e.args[0].kind == "literal"
        if fn == "count" and star:
            if e.distinct:
                raise HushError("Unsupported distinct qualifier at aggregate argument.")
            return f"{column}{self.family(Family('rows'))}"
        arg, kind, c = self.argument(e.args[0])
        if fn == "count":
            if e.distinct:
                own = len(self.aids) == 1 and c is self.aids[0]
                return f"{column}{self.family(Family('distinct', arg, kind, 0, 0 if own else 1))}"
            return f"{column}{self.family(Family('value', arg))}"
        if e.distinct:
            raise HushError("Unsupported distinct qualifier at aggregate argument.")
        if not kind.startswith(NUMERIC):
            raise HushError("Unsupported aggregate in query.")
        total = self.family(Family("sum", arg, kind))
        if fn == "sum":
            return f"{column}{total}"
        n = self.family(Family("value", arg))
        by = f"nullif(v{n}, 0L)"
        return f"(s{total} / cast({by} as double))" if noise else f"(cast(v{total} as double) / cast({by} as double))"

    def rewritten(self, e: Expr, labels: dict[tuple, str], aliases: dict[str, str]) -> str:
        """Text of a post-anonymization expression with labels and aggregates read from the program's result."""
        cuts: list[tuple[int, int, str]] = []

        def walk(x: Expr) -> None:
            if x.kind not in ("literal", "star", "subquery"):
                try:
                    known = labels.get(self.key(x))
                except HushError:
                    known = None
                if known:
                    cuts.append((x.start, x.stop, known))
                    return
            if x.kind == "call" and x.name in AGGREGATES:
                cuts.append((x.start, x.stop, self.aggregate(x)))
                return
            if x.kind == "call" and x.name in OTHER_AGGREGATES:
                raise HushError("Unsupported aggregate in query.")
            if x.kind == "column":
                if x.name in aliases:
                    cuts.append((x.start, x.stop, f"({aliases[x.name]})"))
                    return
                self.column(x)
                raise HushError(f"Column '{x.name}' must appear in the GROUP BY clause or be used in an aggregate function.")
            for a in x.args:
                walk(a)

        walk(e)
        text, at = "", e.start
        for start, stop, new in sorted(cuts):
            text += self.text[at:start] + new
            at = stop + 1
        return text + self.text[at : e.stop + 1]

    def source(self, node) -> str:
        if isinstance(node, Relation):
            return f"{node.sql} AS {quoted(node.alias)}"
        left, right = self.source(node.left), self.source(node.right)
        if node.natural:
            return f"{left} NATURAL {node.how} JOIN {right}"
        if node.using:
            return f"{left} {node.how} JOIN {right} USING ({', '.join(map(quoted, node.using))})"
        return f"{left} {node.how} JOIN {right} ON {' AND '.join(' = '.join(self.sql(a) for a in e.args) for e in self._equalities(node.on))}"

    def where(self) -> tuple[list[str], list[str], list[int]]:
        """Conditions, seed materials of their subjects and hashes of their constants."""
        conditions, materials, hashes = [], [], []
        for e in self._equalities(self.block.where) if self.block.where else []:
            subject, constant = e.args
            c = self.bucket(subject)
            if c.aid:
                raise HushError("AID columns can't be referenced by pre-anonymization filters.")
            if not c.open and self.level == AccessLevel.ANONYMIZED_UNTRUSTED:
                raise HushError("Column marked `not_filterable` can't be referenced by pre-anonymization filters in untrusted-mode.")
            value = self._uncast(constant)
            if value.kind != "literal":
                raise HushError("Generalization expressions can only be matched against constants or params in pre-anonymization filters.")
            conditions.append(f"{self.sql(subject)} = {self.sql(constant)}")
            materials.append(self.material(subject))
            hashes.append(H.fnv(self.constant(value)))
        return conditions, materials, hashes

    def compile(self) -> Compiled:
        b = self.block
        self.check()
        conditions, materials, constants = self.where()
        shown = [e for e, _ in (*b.targets, *b.sort)] + ([b.having] if b.having else [])
        aggregated = [x for top in shown for x in top.walk() if x.kind == "call" and x.name in AGGREGATES | OTHER_AGGREGATES]
        named = {alias.lower(): e for e, alias in b.targets if alias}
        group: list[Expr] = []
        explicit = bool(b.group)
        if explicit:
            for g in b.group:
                if g.kind == "ordinal":
                    g = b.targets[int(g.value) - 1][0]
                elif g.kind == "column" and g.name in named and not any(c.name == g.name for c in self.columns):
                    g = named[g.name]
                group.append(g)
        expand = not explicit and not aggregated
        if expand:
            ordered = [e for e, _ in b.sort if not (e.kind == "column" and e.name in named)]
            group = [e for e in [*(e for e, _ in b.targets), *ordered] if self._uncast(e).kind != "literal" and e.kind != "ordinal"]
        labels: dict[tuple, str] = {}
        kept: list[Expr] = []
        for g in group:
            censored = self._uncast(g).kind == "column" and self.column(self._uncast(g)).aid
            if not (censored and g.kind == "column"):
                self.bucket(g)
            if censored:
                raise HushError("Selecting or grouping by an AID column will result in a fully censored output.")
            if self.level == AccessLevel.ANONYMIZED_UNTRUSTED:
                self.check_untrusted(g)
            if self.key(g) not in labels:
                labels[self.key(g)] = f"l{len(kept)}"
                kept.append(g)
        aliases: dict[str, str] = {}
        targets = []
        for e, alias in b.targets:
            text = self.rewritten(e, labels, {})
            targets.append(text)
            if alias:
                aliases[alias.lower()] = text
        having = self.rewritten(b.having, labels, aliases) if b.having else None
        sort = [(self.rewritten(b.targets[int(e.value) - 1][0] if e.kind == "ordinal" else e, labels, aliases), order) for e, order in b.sort]
        if expand:
            count = self.family(Family("rows"))
        select = [f"{self.sql(g)} AS l{i}" for i, g in enumerate(kept)] + [f"{c.sql} AS a{i}" for i, c in enumerate(self.aids)]
        select += [f"{sql} AS {name}" for sql, name in self.args.items()]
        base = self.spark.sql(f"SELECT {', '.join(select)} FROM {self.source(b.source)}" + (f" WHERE {' AND '.join(conditions)}" if conditions else ""))
        types = {f.name: f.dataType.simpleString() for f in base.schema}
        seed = 0
        for material in {*materials, *(self.material(g) for g in kept)}:
            seed ^= H.fnv(material)
        label_types, aid_types = [types[f"l{i}"] for i in range(len(kept))], [types[f"a{i}"] for i in range(len(self.aids))]
        spec = Spec(base, label_types, aid_types, self.families, self.config, seed, tuple(constants), bool(kept) or explicit)
        if not self.families:
            spec.families = [Family("rows")]
        out = run(spec)
        if having:
            out = out.where(F.expr(having))
        if expand:
            out = out.withColumn("n_", F.explode(F.expr(f"if(v{count} > 0, sequence(1L, v{count}), cast(array() as array<bigint>))")))
        names = [alias or (e.name.rpartition(".")[2] if e.kind in ("column", "call") else f"col{i + 1}") for i, (e, alias) in enumerate(b.targets)]
        out = out.selectExpr(*[f"{t} AS c{i}" for i, t in enumerate(targets)], *[f"{t} AS o{i}" for i, (t, _) in enumerate(sort)])
        return Compiled(out, names, [order for _, order in sort])
