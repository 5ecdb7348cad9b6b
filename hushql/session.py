"""Anonymized access to labelled tables by SQL."""

from __future__ import annotations

import re
from dataclasses import fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushql.config import OPEN, AccessLevel, Config, HushError
from hushql.functions import scalar
from hushql.labels import Catalog
from hushql.plans.compiler import Compiler, quoted
from hushql.plans.direct import direct_histograms
from hushql.plans.statement import ANONYMOUS_ONLY, REFUSED_FUNCTIONS, Statement, fresh, functions, spliced

_BOUND = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|::|:[A-Za-z_]\w*", re.DOTALL)
#: Calls that this session answers itself, whatever the access level.
ANSWERED = {"access_level", "show_settings", "show_labels", "unnest_histogram"}


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


class Session:
    """One analyst's session. Labels are shared by sessions that are given one catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, config: Config | None = None, role: str | None = None):
        self.spark, self.catalog, self.config, self.role = spark, catalog or Catalog(spark), config or Config(), role
        if not self.config.salt:
            # The database's own salt: the same noise in all sessions over one catalog.
            self.config = replace(self.config, salt=self.catalog.salt)
        scalar.register(spark)
        self.own_level = self.catalog.roles.get(role, AccessLevel.of(self.config.default_access_level)) if role else AccessLevel.DIRECT
        self.level = min(self.own_level, AccessLevel.of(self.config.session_access_level))

    def set(self, name: str, value) -> None:
        """Change a setting. Analysts may set a few, and may only lower their access level below their role's."""
        if self.role and self.own_level < AccessLevel.DIRECT and name not in OPEN:
            raise HushError(f"permission denied to set parameter '{name}'")
        if name == "session_access_level":
            if AccessLevel.of(value) > self.own_level:
                raise HushError(f"Access level can't be raised above {self.own_level.label}.")
            self.level = AccessLevel.of(value)
        self.config.set(name, value)

    def access_level(self) -> str:
        return self.level.label

    def show_settings(self) -> DataFrame:
        rows = [(f.name, "<hidden>" if f.name == "salt" and self.level < AccessLevel.DIRECT else str(getattr(self.config, f.name))) for f in fields(self.config)]
        return self.spark.createDataFrame(sorted(rows), "name string, setting string")

    def show_labels(self) -> DataFrame:
        return self.catalog.show()

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """Run a statement; under anonymized access its blocks over personal tables are answered anonymously."""
        text = self._bound(text, args or {}).strip().rstrip(";")
        if told := self._setting(text):
            return told
        if any(name in text.lower() for name in REFUSED_FUNCTIONS) and self.level < AccessLevel.DIRECT:
            if any(c.name.rpartition(".")[2] in REFUSED_FUNCTIONS for c in self._calls(text)):
                raise HushError("Statement requires direct access level.")
        text, made = self._answered(text)
        if self.level == AccessLevel.DIRECT:
            return self.spark.sql(self._direct(text))
        statement = Statement(self.spark, text, self._is_personal, self._compiled, self._emptied, self.level)
        statement.made |= made
        return statement.run()

    def _setting(self, text: str) -> DataFrame | None:
        """Answer of SET hush.name = value (or TO) and SHOW hush.name, which change and tell this session's settings."""
        found = re.fullmatch(r"(?:SHOW\s+hush\.(\w+)|SET\s+hush\.(\w+)\s*(?:=|\s+TO\s)\s*(.+))", text, re.IGNORECASE | re.DOTALL)
        if not found:
            return None
        name = (found[1] or found[2]).lower()
        if found[2]:
            kind, value = type(getattr(self.config, name, "")), found[3].strip().strip("'\"")
            try:
                self.set(name, value.lower() in ("true", "on", "1") if kind is bool else kind(value))
            except (KeyError, ValueError) as e:
                raise e if isinstance(e, HushError) else HushError(f"Invalid value for parameter '{name}': {value}") from e
        return self.show_settings().where(F.col("name") == name)

    def explain(self, text: str, args: dict | None = None, mode: str = "formatted") -> str:
        """Plan of a statement, without the statistics that could tell about personal rows."""
        if mode not in ("simple", "extended", "formatted", "codegen"):
            raise HushError("EXPLAIN options that show costs or run the query require direct access level.")
        frame = self.sql(text, args)
        return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)

    # Statements

    def _bound(self, text: str, args: dict) -> str:
        def one(m: re.Match) -> str:
            name = m[0][1:] if m[0].startswith(":") and m[0] != "::" else None
            return literal(args[name]) if name in args else m[0]

        return _BOUND.sub(one, text) if args else text

    def _calls(self, text: str) -> list:
        return list(functions(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)))

    def _answered(self, text: str) -> tuple[str, set[str]]:
        """``text`` with this session's own functions replaced where the parser finds them, and the views they read."""
        if not any(name in text.lower() for name in ANSWERED):
            return text, set()
        edits, made = [], set()
        for call in self._calls(text):
            if call.kind == "table" and call.name in ("show_settings", "show_labels"):
                made.add(view := fresh("told"))
                getattr(self, call.name)().createOrReplaceTempView(view)
                edits.append((call.start, call.stop + 1, view))
            elif call.name == "access_level":
                edits.append((call.start, call.stop + 1, f"'{self.access_level()}'"))
            elif call.name == "unnest_histogram":
                edits.append((call.start, call.start + len(call.name), "explode"))
        return spliced(text, list(dict.fromkeys(edits))), made

    def _is_personal(self, name: str) -> bool:
        return self.catalog.is_personal(name, self.config.treat_unmarked_tables_as_public)

    # Direct access

    def _direct(self, text: str) -> str:
        """Under direct access noise is zero, no group is the suppress bin and histograms are ordinary."""
        if not any(name in text.lower() for name in ANONYMOUS_ONLY):
            return text
        plain = {"is_suppress_bin": "coalesce(max(false), false)"} | dict.fromkeys(("count_noise", "sum_noise", "avg_noise"), "coalesce(max(0D), 0D)")
        edits = [(c.start, c.stop + 1, plain[c.name]) for c in self._calls(text) if c.name in plain]
        text = spliced(text, list(dict.fromkeys(edits)))
        while (new := direct_histograms(self.spark, text)) is not None:
            text = new
        return text

    # Anonymized access

    def _compiled(self, block, text: str) -> tuple[str, str]:
        """Name of the view of a block's anonymous answer, and the query that takes the block's place."""
        self.config.validate()
        made = Compiler(self.catalog, self.config, self.level, block, text).compile()
        made.frame.createOrReplaceTempView(name := fresh("leaf"))
        out = f"SELECT {', '.join(f'c{i} AS {quoted(n)}' for i, n in enumerate(made.names))} FROM {name}"
        if made.sort:
            out += " ORDER BY " + ", ".join(f"o{i} {o}" for i, o in enumerate(made.sort))
        return name, out + " "

    def _emptied(self, block, text: str) -> list[tuple[int, int, str]] | None:
        """For a block whose filter folds to false or null: its tables read as empty ones, as no row needs anonymizing.

        Spark folds the filter over tables that have the schema alone, so no row can influence it.
        """
        if block.where is None or not _may_fold(block.where) or any(e.kind == "subquery" for e in block.where.walk()):
            return None
        edits = []
        for r in block.relations():
            none = self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), self.spark.table(r.sql).schema)
            none.createOrReplaceTempView(name := fresh("none"))
            shown = text[r.stop + 1 :].split(None, 1)
            renamed = bool(r.alias != r.name.rpartition(".")[2] or shown and shown[0].upper() == "AS")
            edits.append((r.start, r.stop + 1, f"`{name}`" + ("" if renamed else f" AS {quoted(r.alias)}")))
        if not edits:
            return None
        source = ", ".join(f"{e[2]}" if " AS " in e[2] else f"{e[2]} AS {quoted(r.alias)}" for e, r in zip(edits, block.relations()))
        try:
            plan = self.spark.sql(f"SELECT 1 FROM {source} WHERE {block.condition}")._jdf.queryExecution().optimizedPlan()
        except AnalysisException:
            return None
        return edits if plan.getClass().getSimpleName() == "LocalRelation" and plan.data().isEmpty() else None


def _may_fold(e) -> bool:
    """Whether a part of a conjunction needs no column or holds a null."""
    if e.kind == "other" and e.name == "And":
        return any(map(_may_fold, e.args))
    parts = list(e.walk())
    return not any(x.kind in ("column", "subquery") for x in parts) or any(x.kind == "literal" and x.value is None for x in parts)
