"""A database of partitioned, sorted Parquet parts behind a versioned manifest.

A table's parts are immutable folders. The manifest, one JSON file for each version, names the active ones; a new
version is renamed into place, so inserts with their views, and compactions, are atomic, and a reader of an older
version is not disturbed. Only driver-side metadata is held here: rows stay in Spark.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import compaction
from tesserae.plans.ast import CreateTable, CreateView, Drop, Expr, Insert, Select, ShowTables, expr_text, select_text
from tesserae.plans.compiler import Scope, compile_expr, compile_select
from tesserae.plans.parser import parse, parse_expr
from tesserae.sources.files import Files
from tesserae.sources.pruning import may_match, referenced
from tesserae.types import DialectError, Kind, kind_named, wrapping_cast

_log = logging.getLogger(__name__)
ROW = "_row"  # a row's place in its part
PREFIX = "p"  # of partition ids in folder names, where an empty name would be read as null
KEEP_VERSIONS = 20


def _kind(text: str) -> Kind:
    low = text.startswith("LowCardinality(")
    inner = text[len("LowCardinality(") : -1] if low else text
    if inner.startswith("AggregateFunction("):
        return Kind("AggregateState", inner[len("AggregateFunction(") : -1], low)
    return Kind(kind_named(inner).name, "", low)


def _plain(value):  # noqa: ANN001, ANN202
    """A bound as JSON has it; times as seconds."""
    if isinstance(value, (datetime, date)):
        return int(value.timestamp()) if isinstance(value, datetime) else None
    return int(value) if value is not None and not isinstance(value, (str, float, int)) else value


def _literal(value: int | float | str, kind: Kind) -> tuple[str | None, float | None, Decimal | None]:
    """A literal as text, float or 64-bit whole number, as its column takes it without loss."""
    if isinstance(value, str):
        return value, None, None
    if kind.is_string:
        return f"{value:.15g}" if isinstance(value, float) else str(value), None, None
    if isinstance(value, float) or kind.is_float or kind.is_state:
        return None, float(value), None
    return None, None, Decimal(value % (1 << 64))  # wrapping to a narrower width later gives the same


def _filled(column: Column, kind: Kind) -> Column:
    """The dialect has no nulls: an empty text or 0 stands for one."""
    if kind.is_string:
        return F.coalesce(column, F.lit(""))
    return column if kind.is_state and kind.state != "sum" else F.coalesce(column, F.lit(0).cast(kind.spark))


class Catalog:
    """Statements against one database folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)
        self.pruned: dict[str, int] = {}

    # Manifest

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names(self.files.at("_manifest")) if n.startswith("v") and n.endswith(".json"))

    def manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "tables": {}, "views": {}, "batches": {}}
        return json.loads(self.files.read(self.files.at("_manifest", f"v{versions[-1]}.json")))

    def commit(self, change: Callable[[dict], None], tries: int = 10) -> dict:
        """Applies `change` to the newest manifest and publishes the next version; tries again if another was faster."""
        for _ in range(tries):
            state = self.manifest()
            change(state)
            state["version"] += 1
            if self.files.publish(self.files.at("_manifest", f"v{state['version']}.json"), json.dumps(state)):
                for old in self._versions()[:-KEEP_VERSIONS]:
                    self.files.delete(self.files.at("_manifest", f"v{old}.json"))
                return state
        raise RuntimeError("the manifest kept changing")

    def table(self, name: str) -> dict:
        tables = self.manifest()["tables"]
        if name not in tables:
            raise DialectError(f"unknown table {name}")
        return tables[name]

    @staticmethod
    def kinds(table: dict) -> dict[str, Kind]:
        return {n: _kind(k) for n, k in table["columns"]}

    # Statements

    def sql(self, text: str) -> DataFrame:
        """Runs one statement; a SELECT or SHOW TABLES gives rows, others one row with a message."""
        return self.execute(text)[0]

    def execute(self, text: str) -> tuple[DataFrame, dict[str, Kind]]:
        s = parse(text)
        if isinstance(s, Select):
            table = self.table(s.table)
            return compile_select(s, self.read(s.table, s.where), self.kinds(table))
        if isinstance(s, ShowTables):
            names = [(n,) for n in sorted(self.manifest()["tables"])]
            return self.spark.createDataFrame(names, "name string").orderBy("name"), {"name": kind_named("String")}
        if isinstance(s, CreateTable):
            done = self.create_table(s)
        elif isinstance(s, CreateView):
            done = self.create_view(s)
        elif isinstance(s, Drop):
            done = self.drop_table(s.table, s.if_present)
        else:
            done = self.insert_values(s)
        return self.spark.createDataFrame([(done,)], "message string"), {"message": kind_named("String")}

    def create_table(self, s: CreateTable) -> str:
        names = [n for n, _ in s.columns]
        if len(set(names)) < len(names):
            raise DialectError("two columns have one name")
        for n in [*s.order, *referenced(s.partition)]:
            if n not in names:
                raise DialectError(f"unknown column {n}")

        def change(state: dict) -> None:
            if s.name in state["tables"]:
                if not s.if_absent:
                    raise DialectError(f"table {s.name} exists")
                return
            state["tables"][s.name] = {
                "columns": [[n, str(k)] for n, k in s.columns], "engine": s.engine, "order": list(s.order),
                "partition": expr_text(s.partition) if s.partition is not None else None, "blocks": 0, "parts": [],
            }

        self.commit(change)
        return "OK"

    def create_view(self, s: CreateView) -> str:
        for name in (s.select.table, s.target):
            self.table(name)

        def change(state: dict) -> None:
            if s.name in state["views"]:
                if not s.if_absent:
                    raise DialectError(f"view {s.name} exists")
                return
            state["views"][s.name] = {"source": s.select.table, "target": s.target, "select": select_text(s.select)}

        self.commit(change)
        return "OK"

    def drop_table(self, name: str, if_present: bool = False) -> str:
        if name not in self.manifest()["tables"]:
            if if_present:
                return "OK"
            raise DialectError(f"unknown table {name}")

        def change(state: dict) -> None:
            state["tables"].pop(name, None)
            state["views"] = {v: d for v, d in state["views"].items() if name not in (d["source"], d["target"])}

        self.commit(change)
        self.files.delete(self.files.at(name))
        return "OK"

    def insert_values(self, s: Insert) -> str:
        table = self.table(s.table)
        kinds = self.kinds(table)
        columns = list(s.columns) or list(kinds)
        if sorted(columns) != sorted(kinds):
            raise DialectError(f"INSERT gives every column of {s.table}: {', '.join(kinds)}")
        if any(len(r) != len(columns) for r in s.rows):
            raise DialectError("a row has another number of values than columns")
        for name in columns:
            if kinds[name].is_state and kinds[name].state != "sum":
                raise DialectError(f"{name} holds states; fill it from a view")
        fields, rows = [], []
        for k, name in enumerate(columns):
            fields += [T.StructField(f"{form}{k}", kind) for form, kind in (("s", T.StringType()), ("f", T.DoubleType()), ("i", T.DecimalType(20, 0)))]
        for r in s.rows:
            rows.append(tuple(v for name, value in zip(columns, r, strict=True) for v in _literal(value, kinds[name])))
        frame = self.spark.createDataFrame(rows, T.StructType(fields))
        cast = {}
        for k, name in enumerate(columns):
            forms = [(F.col(f"{form}{k}"), kind_named(kind)) for form, kind in (("s", "String"), ("f", "Float64"), ("i", "UInt64"))]
            cast[name] = F.coalesce(*[F.when(c.isNotNull(), wrapping_cast(c, kind, kinds[name])) for c, kind in forms]).alias(name)
        return f"OK. {self.insert(s.table, frame.select(*[cast[n] for n in kinds]))} rows inserted."

    # Rows

    def insert(self, name: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Appends `rows` (columns by name) and what the table's views make of them, in one commit.

        `batch` names a streaming query and its batch number: a batch that was committed before is skipped.
        """
        state = self.manifest()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return 0
        table = self.table(name)
        kinds = self.kinds(table)
        scope = Scope(rows)
        missing = [n for n in kinds if n not in rows.columns]
        if missing:
            raise DialectError(f"INSERT lacks {', '.join(missing)}")
        typed = {n: scope.get(n) for n in kinds}
        shaped = rows.select(*[_filled(wrapping_cast(t.number if t.native else t.column, t.kind, kinds[n]), kinds[n]).alias(n) for n, t in typed.items()])
        written = {name: [self._write(name, table, shaped)]}
        source = written[name][0]["frame"]
        for view in state["views"].values():
            if view["source"] == name and source is not None:
                made, made_kinds = compile_select(parse(view["select"]), source, kinds)
                target = self.table(view["target"])
                goal = self.kinds(target)
                lacking = [n for n in goal if n not in made.columns]
                if lacking:
                    raise DialectError(f"a view gives no {', '.join(lacking)}")
                cast = made.select(*[_filled(wrapping_cast(F.col(f"`{n}`"), made_kinds[n], goal[n]), goal[n]).alias(n) for n in goal])
                written.setdefault(view["target"], []).append(self._write(view["target"], target, cast))

        def change(new: dict) -> None:
            for table_name, batches in written.items():
                entry = new["tables"][table_name]
                for w in batches:
                    for part in w["parts"]:
                        entry["blocks"] += 1
                        number = entry["blocks"]
                        entry["parts"].append(part | {"id": f"{part['partition']}_{number}_{number}_0", "min_block": number, "max_block": number, "level": 0})
            if batch:
                new["batches"][batch[0]] = batch[1]

        self.commit(change)
        return sum(p["rows"] for p in written[name][0]["parts"])

    def _write(self, name: str, table: dict, rows: DataFrame, pid: str | None = None) -> dict:
        """Writes rows as parts, one folder for each partition, each file sorted by the table's key.

        With `pid`, rows are of this one partition and in order already. Others are rebalanced by partition first: adaptive execution gives a large partition several tasks and puts small
        ones together, so a partition has about as many files as its size asks for, whatever the number of tasks.
        """
        folder = self.files.at(name, f"p-{uuid.uuid4().hex}")
        if pid is not None:
            escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(PREFIX + pid)
            rows.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(f"{folder}/_pid={escaped}")
        else:
            text = self._partition(table, rows, self.kinds(table))
            staged = rows.withColumn("_pid", F.concat(F.lit(PREFIX), text)).withColumn(ROW, F.monotonically_increasing_id())
            order = [F.col(f"`{n}`") for n in table["order"]]
            staged.hint("rebalance", "_pid").sortWithinPartitions("_pid", *order, ROW).write.partitionBy("_pid").parquet(folder)
        schema = T.StructType([T.StructField(n, k.spark) for n, k in self.kinds(table).items()] + [T.StructField(ROW, T.LongType()), T.StructField("_pid", T.StringType())])
        folders = {self._unescaped(n[5:]): self.files.at(name, folder.rsplit("/", 1)[1], n) for n in self.files.names(folder) if n.startswith("_pid=")}
        if not folders:
            return {"parts": [], "frame": None}
        back = self.spark.read.schema(schema).parquet(folder)
        bounded = sorted(self._bounded(table))
        stats = [F.count(F.lit(1)).alias("rows")] + [f(F.col(f"`{n}`")).alias(f"{i}-{k}") for i, n in enumerate(bounded) for k, f in enumerate((F.min, F.max))]
        found = {r["_pid"]: r for r in back.groupBy("_pid").agg(*stats).collect()}
        parts = [
            {"partition": p[len(PREFIX) :], "path": path, "rows": found[p]["rows"], "bytes": self.files.size(path), "bounds": {n: [_plain(found[p][f"{i}-0"]), _plain(found[p][f"{i}-1"])] for i, n in enumerate(bounded)}}
            for p, path in sorted(folders.items())
        ]
        return {"parts": parts, "frame": back.drop(ROW, "_pid")}

    def _unescaped(self, text: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(text)

    @staticmethod
    def _partition(table: dict, rows: DataFrame, kinds: dict[str, Kind]):  # noqa: ANN205
        if table["partition"] is None:
            return F.lit("all")
        return compile_expr(parse_expr(table["partition"]), Scope(rows, kinds)).text

    @staticmethod
    def _bounded(table: dict) -> set[str]:
        """Columns whose bounds are kept: those of the partition expression and of the key; no states."""
        partition = referenced(parse_expr(table["partition"])) if table["partition"] is not None else set()
        states = {n for n, k in table["columns"] if _kind(k).is_state}
        return (partition | set(table["order"])) - states

    def read(self, name: str, where: Expr | None = None) -> DataFrame:
        """The active rows of a table; parts that the filter cannot match are left out."""
        table = self.table(name)
        kept = [p for p in table["parts"] if may_match(where, {n: tuple(b) for n, b in p["bounds"].items() if b[0] is not None})[0]]
        self.pruned = {"parts": len(table["parts"]), "read": len(kept), "skipped": len(table["parts"]) - len(kept)}
        return self._frame(table, kept).select(*[F.col(f"`{n}`") for n in self.kinds(table)])

    def _frame(self, table: dict, parts: list[dict]) -> DataFrame:
        schema = T.StructType([T.StructField(n, k.spark) for n, k in self.kinds(table).items()] + [T.StructField(ROW, T.LongType())])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[p["path"] for p in parts])

    def describe(self, name: str, part: str | None = None) -> DataFrame:
        """One row for each active part: identity, rows, bytes, bounds."""
        rows = [(p["id"], p["partition"], p["min_block"], p["max_block"], p["level"], p["rows"], p["bytes"], json.dumps(p["bounds"])) for p in self.table(name)["parts"] if part in (None, p["id"])]
        return self.spark.createDataFrame(rows, "part string, partition string, min_block long, max_block long, level long, rows long, bytes long, bounds string")

    def dump(self, name: str, part: str) -> DataFrame:
        """One row for each column chunk of a part, from the footers of its files: codec, encodings, bytes, values, bounds."""
        chosen = [p for p in self.table(name)["parts"] if p["id"] == part]
        if not chosen:
            raise DialectError(f"no active part {part} of {name}")
        jvm, rows = self.spark._jvm, []
        for file in sorted(n for n in self.files.names(chosen[0]["path"]) if n.endswith(".parquet")):
            source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f"{chosen[0]['path']}/{file}"), self.spark._jsc.hadoopConfiguration())
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
            try:
                for g, block in enumerate(reader.getFooter().getBlocks()):
                    for chunk in block.getColumns():
                        found = chunk.getStatistics()
                        bounds = (found.minAsString(), found.maxAsString()) if found is not None and found.hasNonNullValue() else (None, None)
                        encodings = ",".join(sorted(str(e.toString()) for e in chunk.getEncodings()))
                        rows.append((file, g, block.getRowCount(), chunk.getPath().toDotString(), chunk.getCodec().toString(), encodings, chunk.getStartingPos(), chunk.getTotalSize(), chunk.getTotalUncompressedSize(), chunk.getValueCount(), *bounds))
            finally:
                reader.close()
        return self.spark.createDataFrame(rows, "file string, row_group int, rows long, column string, codec string, encodings string, offset long, bytes long, plain_bytes long, n_values long, least string, greatest string")

    # Compaction

    def optimize(self, name: str) -> str | None:
        """Merges the best range of parts, if there is one; returns the new part's id."""
        table = self.table(name)
        chosen = compaction.select_parts(table["parts"])
        if not chosen:
            return None
        frames = [self._frame(table, [p]).withColumn("_block", F.lit(p["min_block"])) for p in chosen]
        merged = frames[0]
        for f in frames[1:]:
            merged = merged.unionByName(f)
        kinds = self.kinds(table)
        if table["engine"].lower() == "aggregatingmergetree" and table["order"]:
            merged = compaction.collapse(merged, table["order"], kinds)
        ordered = merged.orderBy(*[F.col(f"`{n}`") for n in table["order"]], "_block", ROW).select(*[F.col(f"`{n}`") for n in kinds])
        new = self._write(name, table, ordered, chosen[0]["partition"])["parts"]  # a collapse may change what the partition expression reads
        old = {p["id"] for p in chosen}
        first, last, level = chosen[0]["min_block"], chosen[-1]["max_block"], max(p["level"] for p in chosen) + 1
        made = [p | {"id": f"{p['partition']}_{first}_{last}_{level}", "min_block": first, "max_block": last, "level": level} for p in new]

        def change(state: dict) -> None:
            entry = state["tables"][name]
            if not old <= {p["id"] for p in entry["parts"]}:
                raise DialectError(f"parts of {name} changed meanwhile")
            entry["parts"] = sorted([p for p in entry["parts"] if p["id"] not in old] + made, key=lambda p: p["min_block"])

        self.commit(change)
        return made[0]["id"] if made else None

    def optimize_step(self) -> dict[str, str]:
        """At most one merge in every table; a table whose merge fails, or was overtaken, is left for the next step."""
        out = {}
        for name in self.manifest()["tables"]:
            try:
                made = self.optimize(name)
            except Exception:  # noqa: BLE001
                _log.exception("merge in %s", name)
                continue
            if made is not None:
                out[name] = made
        return out

    def optimize_all(self) -> dict[str, list[str]]:
        """Merges in every table until nothing is left to merge."""
        out: dict[str, list[str]] = {}
        for name in self.manifest()["tables"]:
            while (made := self.optimize(name)) is not None:
                out.setdefault(name, []).append(made)
        return out

    def vacuum(self, older_than: float = 0) -> int:
        """Deletes folders of parts that no kept manifest names; returns how many.

        With inserts running at the same time, `older_than` (seconds since the folder was last written) must exceed
        what an insert may take between its writing and its commit.
        """
        used = {p["path"] for v in self._versions() for t in json.loads(self.files.read(self.files.at("_manifest", f"v{v}.json")))["tables"].values() for p in t["parts"]}
        gone = 0
        for name in self.manifest()["tables"]:
            for folder in self.files.names(self.files.at(name)):
                for part in self.files.names(self.files.at(name, folder)):
                    path = self.files.at(name, folder, part)
                    if part.startswith("_pid=") and path not in used and (not older_than or self.files.age(path) > older_than):
                        self.files.delete(path)
                        gone += 1
        return gone
