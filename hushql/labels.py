"""Labels of tables, columns and roles, and the salt that all sessions over them share.

A catalog that is given a folder lives there: labels and salt are read when it is made and written with every change, by
Spark's own file systems, so that sessions on other machines see them. Without a folder it lasts as long as the object.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushql.config import AccessLevel, HushError

AID_TYPES = (T.IntegerType, T.LongType, T.StringType, T.VarcharType)


@dataclass
class Catalog:
    """What administrators have labelled. Table names are as the session knows them, in lower case."""

    spark: SparkSession
    tables: dict[str, str] = field(default_factory=dict)
    aids: dict[str, list[str]] = field(default_factory=dict)
    closed: dict[str, set[str]] = field(default_factory=dict)
    roles: dict[str, AccessLevel] = field(default_factory=dict)
    salt: str = field(default_factory=lambda: str(uuid.uuid4()))
    folder: str | None = None

    def __post_init__(self) -> None:
        if self.folder is not None and not self._read():
            self._write()

    def _file(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/labels.json")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _read(self) -> bool:
        path, system = self._file()
        if not system.exists(path):
            return False
        rows = self.spark.read.text(f"{self.folder}/labels.json", wholetext=True).collect()
        kept = json.loads(rows[0][0])
        self.tables, self.aids, self.salt = kept["tables"], kept["aids"], kept["salt"]
        self.closed = {t: set(cs) for t, cs in kept["closed"].items()}
        self.roles = {r: AccessLevel.of(level) for r, level in kept["roles"].items()}
        return True

    def _write(self) -> None:
        """Replace the stored labels; a reader sees the old file or the new one."""
        if self.folder is None:
            return
        closed, roles = {t: sorted(cs) for t, cs in self.closed.items()}, {r: v.label for r, v in self.roles.items()}
        kept = {"tables": self.tables, "aids": self.aids, "closed": closed, "roles": roles, "salt": self.salt}
        path, system = self._file()
        new = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/labels-{uuid.uuid4().hex}.new")
        out = system.create(new, True)
        out.write(bytearray(json.dumps(kept).encode()))
        out.close()
        jvm, options = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), system.getConf()).rename(new, path, how)

    def mark_personal(self, table: str, *aids: str) -> None:
        """Label a table personal and set its entity-identifier columns anew, in the table's column order."""
        table, schema = table.lower(), self.spark.table(table).schema
        types = {f.name.lower(): f.dataType for f in schema}
        for aid in aids:
            if aid.lower() not in types:
                raise HushError(f"Column '{aid}' doesn't exist in table '{table}'.")
            if not isinstance(types[aid.lower()], AID_TYPES):
                raise HushError("AID label can not be set on target column because the type is unsupported.")
        if clash := self.closed.get(table, set()) & {a.lower() for a in aids}:
            raise HushError(f"An AID column can't be not_filterable: {', '.join(sorted(clash))}.")
        self.tables[table] = "personal"
        wanted = {a.lower() for a in aids}
        self.aids[table] = [c for c in types if c in wanted]
        self._write()

    def mark_public(self, table: str) -> None:
        self.unmark_table(table)
        self.tables[table.lower()] = "public"
        self._write()

    def unmark_table(self, table: str) -> None:
        for labels in (self.tables, self.aids, self.closed):
            labels.pop(table.lower(), None)
        self._write()

    def mark_not_filterable(self, table: str, column: str) -> None:
        if column.lower() in self.aids.get(table.lower(), []):
            raise HushError("AID columns can't be marked not_filterable.")
        self.closed.setdefault(table.lower(), set()).add(column.lower())
        self._write()

    def mark_filterable(self, table: str, column: str) -> None:
        if column.lower() in self.aids.get(table.lower(), []):
            raise HushError("AID columns can't be marked filterable.")
        self.closed.get(table.lower(), set()).discard(column.lower())
        self._write()

    def mark_role(self, role: str, level: str | AccessLevel) -> None:
        self.roles[role] = AccessLevel.of(level)
        self._write()

    def unmark_role(self, role: str) -> None:
        self.roles.pop(role, None)
        self._write()

    def is_personal(self, table: str, unmarked_public: bool) -> bool:
        label = self.tables.get(table.lower())
        if label is None and not unmarked_public:
            raise HushError("Tables without an anonymization label can't be accessed in anonymized mode.")
        return label == "personal"

    def show(self) -> DataFrame:
        rows = [("table", t, label) for t, label in self.tables.items()]
        rows += [("column", f"{t}.{c}", "aid") for t, cs in self.aids.items() for c in cs]
        rows += [("column", f"{t}.{c}", "not_filterable") for t, cs in self.closed.items() for c in cs]
        rows += [("role", r, level.label) for r, level in self.roles.items()]
        order = {"table": 0, "column": 1, "role": 2}
        rows.sort(key=lambda r: (order[r[0]], r[1]))
        return self.spark.createDataFrame(rows, "objtype string, objname string, label string")


def analyze_filterability(df: DataFrame, share: float = 0.65) -> DataFrame:
    """(column, value, share) of columns whose most frequent value holds at least ``share`` of all rows.

    Each column is one aggregate with map-side combining; only the top value of each is kept.
    """
    total = F.count("*")
    parts = []
    for name in df.columns:
        counts = df.groupBy(F.col(name).cast("string").alias("value")).agg(total.alias("n"))
        top = counts.agg(F.max_by("value", "n").alias("value"), F.max("n").alias("n"), F.sum("n").alias("all"))
        parts.append(top.select(F.lit(name).alias("column"), "value", (F.col("n") / F.col("all")).alias("share")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("share") >= share)
