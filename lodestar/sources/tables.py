"""Tables as Parquet snapshots under one folder, with JSON manifests: row DML, constraints, references, grants,
transactions, enums, views and time travel.

A snapshot is a list of files and folders. INSERT adds a folder; UPDATE and DELETE write anew only the files that hold
rows concerned and keep the others; constraints are checked on the rows written, unique keys also against the files
kept. A change is seen once its manifest, numbered after the one it was read from, is created; of two writers that
start from one manifest the second is refused. Every row has objid, a stable identity.
"""

from __future__ import annotations

import copy
import datetime
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.plans import dialect, errors, statements

TYPES = {
    "tinyint": "tinyint", "smallint": "smallint", "mediumint": "int", "int": "int", "integer": "int", "bigint": "bigint", "int16": "bigint", "int32": "bigint", "int64": "bigint", "int128": "bigint", "int256": "bigint",
    "tinyint unsigned": "smallint", "smallint unsigned": "int", "mediumint unsigned": "int", "int unsigned": "bigint", "integer unsigned": "bigint", "bigint unsigned": "decimal(20,0)",
    "float": "float", "real": "float", "double": "double", "double precision": "double", "decimal": "decimal(10,0)", "numeric": "decimal(10,0)", "text": "string", "tinytext": "string", "mediumtext": "string", "longtext": "string",
    "varchar": "string", "char": "string", "blob": "binary", "tinyblob": "binary", "mediumblob": "binary", "longblob": "binary", "binary": "binary", "varbinary": "binary", "boolean": "boolean", "bool": "boolean", "date": "date",
    "time": "bigint", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "timestamp with time zone": "timestamp", "uuid": "string", "json": "string",
}
REFUSED = {"float unsigned", "double unsigned", "decimal unsigned"}


def spark_type(name: str) -> str:
    """The Spark type of a dialect type; [T] is a vector of T. Unknown names are left to Spark's own parser."""
    n = " ".join(name.lower().split())
    if n in REFUSED or n.startswith("enum("):
        raise errors.UnsupportedFeature(name)
    if n.startswith("[") and n.endswith("]"):
        return f"array<{spark_type(n[1:-1])}>"
    head, _, size = n.partition("(")
    if size and head in ("decimal", "numeric"):
        return f"decimal({size}"
    return TYPES.get(n) or (TYPES[head] if size and head in TYPES else n)


def type_check(name: str, column: str) -> str | None:
    """A condition that values of a type must meet beyond what its Spark type enforces."""
    n = " ".join(name.lower().split())
    if n.endswith("unsigned"):
        return f"{column} >= 0"
    return f"{column} BETWEEN -8388608 AND 8388607" if n == "mediumint" else None


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = True
    references: str | None = None
    on_delete: str = "restrict"
    on_update: str = "restrict"
    default: str | None = None  # an SQL expression


@dataclass
class Table:
    columns: list[Column]
    flat: bool = False
    versioned: bool = False
    unique: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    snapshots: list[list[str]] = field(default_factory=list)
    times: list[str] = field(default_factory=list)  # when each snapshot was made, UTC
    next_id: int = 1
    database: str = "app"
    temporary: str | None = None  # what becomes of it on commit: preserve, delete or drop
    indexes: dict[str, dict] = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, folder: str, user: str = "root"):
        self.spark, self.folder, self.user = spark, folder.rstrip("/"), user
        self.tables: dict[str, Table] = {}
        self.enums: dict[str, dict] = {}
        self.composites: dict[str, list[list[str]]] = {}
        self.views: dict[str, dict] = {}
        self.names: dict[str, list[str]] = {"database": ["app"], "schema": [], "user": ["root"]}
        self.database = "app"
        self.grants: set[tuple[str, str, str, str]] = set()  # user, object, privilege, column (empty: all)
        self.stack: list[tuple[str | None, str, dict]] = []  # name, transaction or savepoint, state before
        self.number, self.read_only = 0, False
        hadoop = spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in fs.globStatus(hadoop.Path(f"{self.folder}/manifest-*.json")) or []]
        if found:
            self.number = max(int(n[9:-5]) for n in found)
            self._restore(json.loads(spark.read.text(f"{self.folder}/manifest-{self.number:09d}.json", wholetext=True).first()[0]))

    # --- catalog ---------------------------------------------------------------------------------------------------

    def _state(self) -> dict:
        return {
            "tables": {n: asdict(t) for n, t in self.tables.items()}, "enums": copy.deepcopy(self.enums), "composites": copy.deepcopy(self.composites),
            "views": copy.deepcopy(self.views), "names": copy.deepcopy(self.names), "grants": sorted(self.grants),
        }

    def _restore(self, state: dict) -> None:
        state = copy.deepcopy(state)
        self.tables = {n: Table(**{**t, "columns": [Column(**c) for c in t["columns"]]}) for n, t in state["tables"].items()}
        self.enums, self.composites, self.views, self.names = state["enums"], state["composites"], state["views"], state["names"]
        self.grants = {tuple(g) for g in state["grants"]}

    def _save(self) -> None:
        """Create the next manifest, which no other writer may have made; inside a transaction nothing is written."""
        if any(kind == "transaction" for _, kind, _ in self.stack):
            return
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        part, final = hadoop.Path(f"{self.folder}/part-{uuid.uuid4().hex}"), hadoop.Path(f"{self.folder}/manifest-{self.number + 1:09d}.json")
        fs = part.getFileSystem(conf)
        if fs.exists(final):
            raise errors.TransactionError("another writer changed the tables")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(self._state()).encode()))
        out.close()
        if not fs.rename(part, final):
            fs.delete(part, False)
            raise errors.TransactionError("another writer changed the tables")
        self.number += 1
        old = hadoop.Path(f"{self.folder}/manifest-{self.number - 2:09d}.json")  # the one before stays for readers
        if fs.exists(old):
            fs.delete(old, False)

    def get(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise errors.TableNotFound(name)
        return self.tables[name.lower()]

    def create_table(self, name: str, columns: list[Column | tuple], flat: bool = False, versioned: bool = False, unique: list[list[str]] = (), checks: list[str] = (), if_not_exists: bool = False, temporary: str | None = None) -> None:
        key = name.lower()
        if key in self.tables:
            if if_not_exists:
                return
            raise errors.ConstraintViolation(f"table {name} exists")
        cols = [c if isinstance(c, Column) else Column(*c) for c in columns]
        if len({c.name.lower() for c in cols}) < len(cols):
            raise errors.ConstraintViolation("a column name occurs twice")
        if flat and (versioned or any(c.references for c in cols)):
            raise errors.ConstraintViolation("a FLAT table has neither versions nor references")
        for c in cols:
            if c.references:
                if c.references.lower() != key:
                    self.get(c.references)
            elif c.type.lower() not in self.enums:
                self._type(c)
        self.tables[key] = Table(cols, flat, versioned, [list(u) for u in unique], list(checks), database=self.database, temporary=temporary)
        self._save()

    def drop_table(self, name: str) -> None:
        self.get(name)
        if any((c.references or "").lower() == name.lower() for n, t in self.tables.items() if n != name.lower() for c in t.columns):
            raise errors.ReferentialIntegrityViolation(f"a column references {name}")
        del self.tables[name.lower()]
        self._save()

    def alter(self, name: str, add: Column | None = None, drop: str | None = None, rename: tuple[str, str] | None = None, to: str | None = None) -> None:
        t, df = self.get(name), self.read(name)
        if add:
            t.columns.append(add)
            df = df.withColumn(add.name, F.lit(None).cast(self._type(add)))
        if drop:
            t.columns = [c for c in t.columns if c.name.lower() != drop.lower()]
            df = df.drop(drop)
        if rename:
            df = df.withColumnRenamed(*rename)
            for c in t.columns:
                if c.name.lower() == rename[0].lower():
                    c.name = rename[1]
        if to:
            self.tables[to.lower()] = self.tables.pop(name.lower())
        self._write(to or name, df)

    def create_enum(self, name: str, variants: list[str], flag: bool = False) -> None:
        if name.lower() in {*self.enums, *self.composites}:
            raise errors.TypeExists(name)
        low = [v.lower() for v in variants]
        if not variants or len(set(low)) < len(low):
            raise errors.InvalidEnumValue("variants must be given, and each once")
        named = [v for v in variants if v.lower() != "none"] if flag else variants
        numbers = {v: (1 << i if flag else i) for i, v in enumerate(named)} | ({"NONE": 0} if flag else {})
        self.enums[name.lower()] = {"flag": flag, "values": numbers}
        self._save()

    def drop_enum(self, name: str) -> None:
        if name.lower() not in self.enums:
            raise errors.TypeNotFound(name)
        if any(c.type.lower() == name.lower() for t in self.tables.values() for c in t.columns):
            raise errors.TypeInUse(name)
        del self.enums[name.lower()]
        self._save()

    def enum_value(self, enum: str, variant: str) -> int:
        for v, n in self.enums[enum.lower()]["values"].items():
            if v.lower() == variant.lower():
                return n
        raise errors.InvalidEnumValue(f"{variant} of {enum}")

    def enum_names(self, enum: str, column: str):
        e = self.enums[enum.lower()]
        c = F.col(column)
        if not e["flag"]:
            return F.element_at(F.create_map(*[F.lit(x) for v, n in e["values"].items() for x in (n, v)]), c.cast("int"))
        parts = [F.when(c.bitwiseAND(F.lit(n)) != 0, F.lit(v)) for v, n in e["values"].items() if n]
        return F.when(c == 0, F.lit("NONE")).when(c != 0, F.concat_ws("|", *parts))

    def _type(self, c: Column) -> str:
        if c.type.lower() in self.enums or c.references and not c.type.startswith("["):
            return "bigint"
        if c.references:
            return "array<bigint>"
        return self.type_name(c.type)

    def type_name(self, name: str) -> str:
        """The Spark type of a dialect type, composite types included."""
        if name.lower() in self.composites:
            return "struct<" + ", ".join(f"{n}: {self.type_name(t)}" for n, t in self.composites[name.lower()]) + ">"
        if name.startswith("[") and name.endswith("]"):
            return f"array<{self.type_name(name[1:-1])}>"
        return spark_type(name)

    def create_composite(self, name: str, fields: list[tuple[str, str]]) -> None:
        if name.lower() in {*self.enums, *self.composites}:
            raise errors.TypeExists(name)
        for _, t in fields:
            self.type_name(t)
        self.composites[name.lower()] = [list(f) for f in fields]
        self._save()

    def drop_composite(self, name: str) -> None:
        if name.lower() not in self.composites:
            raise errors.TypeNotFound(name)
        if any(c.type.lower().strip("[]") == name.lower() for t in self.tables.values() for c in t.columns):
            raise errors.TypeInUse(name)
        del self.composites[name.lower()]
        self._save()

    def add_name(self, kind: str, name: str) -> None:
        """A database, schema or user."""
        if name.lower() in self.names[kind]:
            raise errors.ConstraintViolation(f"{kind} {name} exists")
        self.names[kind].append(name.lower())
        self._save()

    def drop_name(self, kind: str, name: str) -> None:
        self.need_name(kind, name)
        if kind == "database" and any(t.database == name.lower() for t in self.tables.values()):
            raise errors.ConstraintViolation(f"database {name} has tables")
        self.names[kind].remove(name.lower())
        self._save()

    def need_name(self, kind: str, name: str) -> None:
        if name.lower() not in self.names[kind]:
            raise errors.TableNotFound(f"{kind} {name}")

    def create_index(self, name: str, table: str, columns: list[str], kind: str = "btree", unique: bool = False) -> None:
        """Write the table sorted by the index's columns, so that Parquet's statistics skip files and row groups for
        them, and record the index. Later inserts add files of their own."""
        t = self.get(table)
        if any(name.lower() in x.indexes for x in self.tables.values()):
            raise errors.ConstraintViolation(f"index {name} exists")
        known = {c.name.lower() for c in t.columns}
        for c in columns:
            if c.lower() not in known:
                raise errors.ColumnNotFound(f"{table}.{c}")
        df = self.read(table)
        if unique:
            if df.dropna(subset=columns).groupBy(*columns).count().where("count > 1").take(1):
                raise errors.ConstraintViolation(f"{table}: {columns} is not unique")
            t.unique.append(list(columns))
        t.indexes[name.lower()] = {"columns": list(columns), "kind": kind.lower()}
        self._write(table, df.repartitionByRange(*columns).sortWithinPartitions(*columns) if t.snapshots and kind.lower() == "btree" else df)

    def drop_index(self, name: str) -> None:
        for t in self.tables.values():
            if t.indexes.pop(name.lower(), None):
                self._save()
                return
        raise errors.TableNotFound(f"index {name}")

    # --- views -------------------------------------------------------------------------------------------------------

    def create_view(self, name: str, text: str, materialized: bool = False, replace: bool = False) -> None:
        """A materialized view keeps the rows of its query in a table of its own until refresh()."""
        if name.lower() in self.tables or name.lower() in self.views and not replace:
            raise errors.ConstraintViolation(f"{name} exists")
        self.views[name.lower()] = {"text": text, "path": None}
        if materialized:
            self.refresh(name)
        else:
            self.sql(text)  # the analyser refuses what cannot be read
            self._save()

    def refresh(self, name: str) -> None:
        if name.lower() not in self.views:
            raise errors.TableNotFound(name)
        view, path = self.views[name.lower()], f"{self.folder}/views/{uuid.uuid4().hex}"
        self.sql(view["text"]).write.parquet(path)
        view["path"] = path
        self._save()

    def drop_view(self, name: str) -> None:
        if self.views.pop(name.lower(), None) is None:
            raise errors.TableNotFound(name)
        self._save()

    # --- grants ----------------------------------------------------------------------------------------------------

    def grant(self, user: str, name: str, *privileges: str, columns: list[str] = ()) -> None:
        self.grants |= {(user, name.lower(), p.upper(), c.lower()) for p in privileges for c in (columns or [""])}
        self._save()

    def revoke(self, user: str, name: str, *privileges: str, columns: list[str] = ()) -> None:
        gone = {p.upper() for p in privileges}
        self.grants = {g for g in self.grants if not (g[0] == user and g[1] == name.lower() and (g[2] in gone or "ALL" in gone) and (not columns or g[3] in [c.lower() for c in columns]))}
        self._save()

    def allowed(self, name: str, privilege: str) -> set[str] | None:
        """None: every column; else those granted."""
        own = {g[3] for g in self.grants if g[:2] == (self.user, name.lower()) and g[2] in (privilege, "ALL")}
        return None if self.user == "root" or "" in own else own

    def need(self, name: str, privilege: str, columns: list[str] | None = None) -> None:
        if self.read_only and privilege != "SELECT":
            raise errors.TransactionError("the transaction is read only")
        own = self.allowed(name, privilege)
        if own is not None and (not own or columns is None or not {c.lower() for c in columns} <= own):
            raise errors.PermissionDenied(f"{privilege} on {name} for {self.user}")

    # --- reading and writing ---------------------------------------------------------------------------------------

    def schema(self, name: str) -> str:
        return ", ".join(["objid bigint", *(f"`{c.name}` {self._type(c)}" for c in self.get(name).columns)])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The current rows, or those of an earlier snapshot (1 is the first)."""
        t = self.get(name)
        if version is not None and not 1 <= version <= len(t.snapshots):
            raise errors.TableNotFound(f"{name} has no version {version}")
        files = (t.snapshots[-1] if version is None else t.snapshots[version - 1]) if t.snapshots else []
        if not files:
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(*files) if version is None else self.spark.read.parquet(*files)

    def version_at(self, name: str, time: str) -> int:
        """The number of the snapshot that held at a time (UTC), 0 before the first."""
        at = datetime.datetime.fromisoformat(time).replace(tzinfo=None).isoformat()
        return sum(x <= at for x in self.get(name).times)

    def history(self, name: str) -> DataFrame:
        """All versions of all rows, with the snapshots between which each held: runs of snapshots without a gap."""
        t = self.get(name)
        versions = [self.read(name, i).withColumn("version", F.lit(i)) for i, files in enumerate(t.snapshots, 1) if files]
        if not versions:
            return self.read(name).withColumns({"valid_from": F.lit(1), "valid_to": F.lit(None).cast("int")})
        out = versions[0]
        for p in versions[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        names = ["objid", *(c.name for c in t.columns)]
        rank = F.row_number().over(Window.partitionBy(*names).orderBy("version"))  # a row's own versions
        spans = out.select(*names, "version").withColumn("run", F.col("version") - rank).groupBy(*names, "run").agg(F.min("version").alias("valid_from"), F.max("version").alias("last"))
        return spans.withColumn("valid_to", F.when(F.col("last") < len(t.snapshots), F.col("last") + 1)).drop("last", "run")

    def _write(self, name: str, df: DataFrame, kept: list[str] = (), again: set[str] | None = None, ids: int = 0) -> None:
        """A snapshot of the files kept and of df's rows. again: the columns whose values may be new (None: all)."""
        t = self.get(name)
        path = f"{self.folder}/{name.lower()}/{uuid.uuid4().hex}"
        df.select("objid", *(F.col(f"`{c.name}`").cast(self._type(c)).alias(c.name) for c in t.columns)).write.parquet(path)
        self._check(name, self.spark.read.schema(self.schema(name)).parquet(path), kept, again)
        t.snapshots.append([*kept, path])
        t.times.append(datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None).isoformat())
        t.next_id += ids
        self._save()

    def _check(self, name: str, df: DataFrame, kept: list[str], again: set[str] | None) -> None:
        """Of the rows written: one pass for the row conditions, one for each unique key, one for each reference."""
        t = self.get(name)
        new = lambda names: again is None or bool({n.lower() for n in names} & again)
        tests = {f"{c.name} is null": F.col(f"`{c.name}`").isNull() for c in t.columns if not c.nullable and new([c.name])}
        for text in [*t.checks, *(x for c in t.columns if (x := type_check(c.type, f"`{c.name}`")))]:
            tests[f"not ({text})"] = ~F.coalesce(F.expr(text), F.lit(True))
        for c in t.columns:
            e = self.enums.get(c.type.lower())
            if e:
                every = 0
                for n in e["values"].values():
                    every |= n
                legal = F.col(c.name).bitwiseAND(F.lit(~every)) == 0 if e["flag"] else F.col(c.name).isin(*e["values"].values())
                tests[f"{c.name} is not in {c.type}"] = ~F.coalesce(legal, F.lit(True))
        if tests:
            counts = df.agg(*[F.count_if(x).alias(f"t{i}") for i, x in enumerate(tests.values())]).first()
            for i, what in enumerate(tests):
                if counts[i]:
                    raise (errors.NullConstraintViolation if what.endswith("is null") else errors.ConstraintViolation)(f"{name}: {counts[i]} rows where {what}")
        for u in t.unique:
            if not new(u):
                continue
            keys = df.dropna(subset=u).select(*u)
            twice = keys.groupBy(*u).count().where("count > 1").take(1)
            if twice or kept and keys.join(self.spark.read.schema(self.schema(name)).parquet(*kept).select(*u), u, "left_semi").take(1):
                raise errors.ConstraintViolation(f"{name}: {u} is not unique")
        for c in t.columns:
            if c.references and new([c.name]):
                child = df.select(F.explode(c.name) if self._type(c).startswith("array") else F.col(c.name)).toDF("ref").where("ref is not null")
                parent = self.read(c.references).select(F.col("objid").alias("ref"))
                if c.references.lower() == name.lower():
                    parent = parent.unionByName(df.select(F.col("objid").alias("ref")))
                if child.join(parent, "ref", "left_anti").take(1):
                    raise errors.ReferentialIntegrityViolation(f"{name}.{c.name} has no such {c.references}")

    def _touched(self, name: str, hit) -> tuple[list[str], list[str], int]:
        """Files that hold rows that meet hit, the others, and the number of those rows."""
        df = self.read(name)
        if not self.get(name).snapshots:
            return [], [], 0
        found = {r["f"]: r["n"] for r in df.where(hit).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()}  # a row for each file
        same = lambda f: f.split(":", 1)[-1].lstrip("/")
        touched = {same(f) for f in found}
        files = df.inputFiles()
        return [f for f in files if same(f) in touched], [f for f in files if same(f) not in touched], sum(found.values())

    def _default(self, c: Column) -> F.Column:
        return F.expr(c.default).cast(self._type(c)) if c.default else F.lit(None).cast(self._type(c))

    def insert(self, name: str, rows: DataFrame | list[dict]) -> int:
        """Rows lack what they do not name: null. objid is given here and may not be named."""
        self.need(name, "INSERT")
        t = self.get(name)
        if isinstance(rows, list):
            plain = ", ".join(f"`{c.name}` {self._type(c)}" for c in t.columns)
            known = {c.name for c in t.columns}
            if any(set(r) - known for r in rows):
                raise errors.ConstraintViolation("an unknown column, or objid, in INSERT")
            rows = self.spark.createDataFrame([tuple(r.get(c.name) for c in t.columns) for r in rows], plain)
        if "objid" in rows.columns:
            raise errors.ConstraintViolation("objid cannot be inserted")
        have = {c.lower(): c for c in rows.columns}
        if set(have) - {c.name.lower() for c in t.columns}:
            raise errors.ColumnNotFound(f"{name}: {sorted(set(have) - {c.name.lower() for c in t.columns})}")
        rows = rows.select(*(F.col(f"`{have[c.name.lower()]}`").alias(c.name) if c.name.lower() in have else self._default(c).alias(c.name) for c in t.columns))
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        sizes = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row for each partition
        starts, total = [], 0
        for part, n in sizes:
            starts.append((part, t.next_id + total))
            total += n
        if total:
            first = self.spark.createDataFrame(starts, "_part int, _first bigint")
            numbered = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_at"))).join(F.broadcast(first), "_part")
            numbered = numbered.withColumn("objid", F.col("_first") + F.col("_rank") - 1).drop("_part", "_at", "_rank", "_first")
            self._write(name, numbered, t.snapshots[-1] if t.snapshots else (), ids=total)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return total

    def update(self, name: str, changes: dict, where: str | None = None) -> int:
        """Only files with rows that meet the condition are written anew."""
        self.need(name, "UPDATE", list(changes))
        if "objid" in {c.lower() for c in changes}:
            raise errors.ConstraintViolation("objid cannot be updated")
        known = {c.name.lower(): c for c in self.get(name).columns}
        for c in changes:
            if c.lower() not in known:
                raise errors.ColumnNotFound(f"{name}.{c}")
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        touched, kept, n = self._touched(name, hit)
        if n:
            new = {known[c.lower()].name: F.when(hit, v if hasattr(v, "cast") else F.lit(v)).otherwise(F.col(f"`{known[c.lower()].name}`")) for c, v in changes.items()}
            self._write(name, self.spark.read.schema(self.schema(name)).parquet(*touched).withColumns(new), kept, {c.lower() for c in changes})
        return n

    def delete(self, name: str, where: str | None = None) -> int:
        """Rows that meet the condition; what references them follows its rule. All of it is seen at once, or none."""
        self.need(name, "DELETE")
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        touched, kept, n = self._touched(name, hit)
        if n:
            rows = self.spark.read.schema(self.schema(name)).parquet(*touched)
            self.begin()
            try:
                self._follow(name, rows.where(hit).select(F.col("objid").alias("gone")))
                if self.get(name).snapshots[-1] and self.stack[-1][2]["tables"][name.lower()]["snapshots"] != self.get(name).snapshots:  # a reference to itself
                    touched, kept, _ = self._touched(name, hit)
                    rows = self.spark.read.schema(self.schema(name)).parquet(*touched) if touched else rows.limit(0)
                self._write(name, rows.where(~hit), kept, set())
            except Exception:
                self.rollback()
                raise
            self.commit()
        return n

    def _follow(self, name: str, gone: DataFrame) -> None:
        for other, t in self.tables.items():
            for c in t.columns:
                if (c.references or "").lower() != name.lower() or c.type.startswith("["):
                    continue
                child = self.read(other)
                hit = child.join(gone, F.col(c.name) == F.col("gone"), "left_semi")
                if not hit.take(1):
                    continue
                rule = c.on_delete.lower()
                if rule == "cascade":
                    self._follow(other, hit.select(F.col("objid").alias("gone")))
                    self._write(other, self.read(other).join(gone, F.col(c.name) == F.col("gone"), "left_anti"), (), set())
                elif rule in ("set null", "set default"):
                    mark = child.join(gone, F.col(c.name) == F.col("gone"), "left")
                    new = self._default(c) if rule == "set default" else F.lit(None).cast("bigint")
                    self._write(other, mark.withColumn(c.name, F.when(F.col("gone").isNull(), F.col(c.name)).otherwise(new)).drop("gone"), (), {c.name.lower()})
                else:
                    raise errors.ReferentialIntegrityViolation(f"{other}.{c.name} still names rows of {name}")

    # --- references ------------------------------------------------------------------------------------------------

    def reference(self, name: str, column: str) -> Column:
        for c in self.get(name).columns:
            if c.name.lower() == column.lower() and c.references:
                return c
        raise errors.InvalidExpand(f"{name}.{column} is no reference")

    def expand(self, name: str, column: str, alias: str | None = None, df: DataFrame | None = None) -> DataFrame:
        """The referenced row as a struct column; a row for each element of a reference array."""
        c = self.reference(name, column)
        df = self.read(name) if df is None else df
        if c.type.startswith("["):
            df = df.withColumn(column, F.explode(column))
        target = self.read(c.references)
        return df.join(target.select(F.struct("*").alias(alias or f"{column}_row")), F.col(column) == F.col(f"{alias or f'{column}_row'}.objid"), "left")

    def navigate(self, name: str, path: str, df: DataFrame | None = None) -> DataFrame:
        """Adds the value at a path such as order_ref.customer_ref.name, by one left join for each step."""
        *steps, last = path.split(".")
        df, at, prefix = (self.read(name) if df is None else df), name, ""
        for s in steps:
            c = self.reference(at, s)
            alias = f"{prefix}{s}__"
            source = F.col(f"`{prefix}`.`{s}`") if prefix else F.col(s)
            target = self.read(c.references).select(F.struct("*").alias(alias))
            df = df.join(target, source == F.col(f"`{alias}`.objid"), "left")
            at, prefix = c.references, alias
        out = df.withColumn(path.replace(".", "_"), F.col(f"`{prefix}`.`{last}`") if prefix else F.col(last))
        return out.drop(*[c for c in out.columns if c.endswith("__")])

    def referencing(self, name: str, other: str, column: str, alias: str) -> DataFrame:
        """A virtual reference: the objids of other's rows that reference each row."""
        back = self.read(other).groupBy(F.col(column).alias("_to")).agg(F.array_sort(F.collect_list("objid")).alias(alias))
        return self.read(name).join(back, F.col("objid") == F.col("_to"), "left").drop("_to")

    # --- queries and transactions ----------------------------------------------------------------------------------

    def sql(self, text: str) -> DataFrame:
        """A SELECT in the dialect over this engine's tables and views."""
        return statements.select(self, text)

    def execute(self, text: str) -> list:
        """Statements in the dialect, one after another: a DataFrame for a query, a number of rows for INSERT, UPDATE
        and DELETE, None for others."""
        return [statements.run(self, s) for s in dialect.statements(text)]

    def begin(self, name: str | None = None) -> None:
        if name and any(n == name for n, _, _ in self.stack):
            raise errors.TransactionError(f"{name} is open already")
        self.stack.append((name, "transaction", self._state()))

    def savepoint(self, name: str) -> None:
        if not self.stack:
            raise errors.TransactionError("no transaction is open")
        self.stack.append((name, "savepoint", self._state()))

    def commit(self, name: str | None = None) -> None:
        """The innermost transaction, which must bear the name if one is given."""
        self._close(name)
        if not self.stack:
            for n, t in list(self.tables.items()):
                if t.temporary == "drop":
                    del self.tables[n]
                elif t.temporary == "delete" and t.snapshots:
                    t.snapshots.append([])
                    t.times.append(t.times[-1])
        self._save()

    def release(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][:2] == (name, "savepoint"):
                del self.stack[i]
                return
        raise errors.TransactionError(f"no savepoint {name}")

    def rollback(self, name: str | None = None) -> None:
        self._restore(self._close(name))
        self._save()

    def rollback_to(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][:2] == (name, "savepoint"):
                self._restore(self.stack[i][2])
                del self.stack[i + 1 :]
                return
        raise errors.TransactionError(f"no savepoint {name}")

    def _close(self, name: str | None) -> dict:
        at = max((i for i, s in enumerate(self.stack) if s[1] == "transaction"), default=-1)
        if at < 0:
            raise errors.TransactionError("no transaction is open")
        if name and self.stack[at][0] != name:
            raise errors.TransactionError(f"{name} is not the innermost transaction")
        state, self.read_only = self.stack[at][2], False
        del self.stack[at:]
        return state
