"""Stored relations: a bitemporal version log per relation, and programs over it.

Every write appends Parquet rows ``key, value, _valid, _sys, _op``; the current
state, the state at an instant, spans and differences are resolved by
aggregations over the log.  Writes are staged, checked (preconditions,
triggers, constraints) and published together; a refusal leaves no trace.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tessera.errors import LimitExceeded, ParseError, Refusal, TypeRefusal, UnknownName, UnsafeRule, WriteRefusal
from tessera.operators import search
from tessera.operators.lineage import cut, _folder
from tessera.plans.engine import Engine, Frame, Typing, anti, literal, mangle, variables
from tessera.plans.parser import Call, ColumnSpec, Lit, Program, Read, System, Var, Write, constant, parse

LATEST = 2**63 - 1
LEVELS = ["hidden", "read_only", "protected", "normal"]
ATOMS = {"Int": "bigint", "Float": "double", "String": "string", "Bytes": "binary", "Uuid": "string", "Bool": "boolean", "Json": "string",
         "Validity": "struct<ts:bigint,assert:boolean>"}


@dataclass
class Relation:
    name: str
    keys: list[ColumnSpec]
    values: list[ColumnSpec]
    types: dict[str, T.DataType] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    attached: DataFrame | None = None
    log_frame: DataFrame | None = None
    triggers: list[tuple[str, str]] = field(default_factory=list)
    indices: dict[str, tuple[str, dict]] = field(default_factory=dict)
    level: str = "normal"
    about: str = ""

    @property
    def columns(self) -> list[str]:
        return [c.name for c in self.keys + self.values]

    @property
    def key_names(self) -> list[str]:
        return [c.name for c in self.keys]


def instant(v) -> int:
    """Microseconds of an instant: a number, or RFC 3339 text."""
    if isinstance(v, bool) or v is None:
        raise TypeRefusal("an instant is a number of microseconds or a date")
    if isinstance(v, (int, float)):
        return int(v)
    if v == "NOW":
        return int(time.time() * 1e6)
    if v == "END":
        return LATEST
    from datetime import datetime, timezone

    d = datetime.fromisoformat(v.replace("Z", "+00:00"))
    return round((d if d.tzinfo else d.replace(tzinfo=timezone.utc)).timestamp() * 1e6)


def resolve(log: DataFrame, keys: list[str], columns: list[str], valid: int = LATEST, system: int = LATEST) -> DataFrame:
    """Rows that hold at an instant, as known at a system instant.

    Per key and valid instant the latest write counts; of those the latest
    valid one that is not erased decides.  Two partial aggregations, no sort.
    """
    seen = log.where((F.col("_sys") <= system) & (F.col("_valid") <= valid))
    row = F.struct(*[F.col(f"`{c}`") for c in columns], "_op", "_valid")
    k = [F.col(f"`{c}`") for c in keys]
    newest = seen.groupBy(*k, "_valid").agg(F.max_by(row, F.col("_sys")).alias("r")).where("r._op <> 'erase'")
    last = newest.groupBy(*k).agg(F.max_by("r", F.col("_valid")).alias("r")).where("r._op = 'assert'")
    return last.select(*[F.col(f"r.`{c}`").alias(c) for c in columns])


def spans(log: DataFrame, keys: list[str], columns: list[str], system: int = LATEST) -> DataFrame:
    """Maximal runs of constant value per key, with ``_span`` closed at both ends."""
    values = [c for c in columns if c not in keys]
    k = [F.col(f"`{c}`") for c in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in values], "_op")
    newest = log.where(F.col("_sys") <= system).groupBy(*k, "_valid").agg(F.max_by(row, F.col("_sys")).alias("r")).where("r._op <> 'erase'")
    w = Window.partitionBy(*k).orderBy("_valid")
    started = newest.withColumn("before", F.lag("r").over(w)).where(~F.col("r").eqNullSafe(F.col("before")))
    ended = started.withColumn("next", F.lead("_valid").over(w)).where("r._op = 'assert'")
    span = F.struct(F.lit(False).alias("empty"), F.col("_valid").alias("lo"), (F.col("next") - 1).alias("hi"))
    return ended.select(*k, *[F.col(f"r.`{c}`").alias(c) for c in values], span.alias("_span"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows gained (+1) and lost (-1) between two states."""
    return anti(after, before).withColumn("_sign", F.lit(1).cast("bigint")).unionByName(anti(before, after).withColumn("_sign", F.lit(-1).cast("bigint")))


def compose(facts: DataFrame) -> DataFrame:
    """Net of signed facts: opposite ones cancel."""
    cols = [c for c in facts.columns if c != "_sign"]
    return facts.groupBy(*cols).agg(F.sum("_sign").alias("_sign")).where("_sign <> 0")


class Database:
    """A catalog of relations and the programs that read and write them."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{_folder(spark)}/relations-{uuid.uuid4().hex}"
        self.relations: dict[str, Relation] = {}
        self.constraints: dict[str, str] = {}
        self.callbacks: dict[str, list] = {}
        self.standing: list = []
        self.engine = Engine(spark, self)
        self.clock, self.depth = 0, 0

    # -- catalog
    def attach(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """A DataFrame as a read-only relation; integers of all widths become one kind."""
        cols = [F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else
                F.unix_micros(F.col(f"`{f.name}`").cast("timestamp")).alias(f.name) if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)) else F.col(f"`{f.name}`") for f in df.schema]
        df = df.select(*cols)
        keys = keys or df.columns
        self.relations[name] = Relation(name, [ColumnSpec(c) for c in keys], [ColumnSpec(c) for c in df.columns if c not in keys], attached=df, level="read_only")

    def attach_log(self, name: str, df: DataFrame, keys: list[str], values: list[str], valid: str) -> None:
        """A DataFrame of dated facts as a temporal relation; later rows of one instant win by all columns."""
        order = F.row_number().over(Window.partitionBy(*keys, valid).orderBy(*values))
        log = df.select(*keys, *values, F.col(valid).cast("bigint").alias("_valid"), order.cast("bigint").alias("_sys"), F.lit("assert").alias("_op"))
        self.relations[name] = Relation(name, [ColumnSpec(c) for c in keys], [ColumnSpec(c) for c in values], log_frame=log, level="read_only")

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            raise UnknownName(f"no relation {name}")
        return self.relations[name]

    def log(self, r: Relation) -> DataFrame:
        if r.log_frame is not None:
            return r.log_frame
        schema = self._log_schema(r)
        return self.spark.read.schema(schema).parquet(*r.parts) if r.parts else self.spark.createDataFrame([], schema)

    def _log_schema(self, r: Relation) -> T.StructType:
        return T.StructType([T.StructField(c, r.types[c]) for c in r.columns] + [T.StructField("_valid", T.LongType()), T.StructField("_sys", T.LongType()), T.StructField("_op", T.StringType())])

    def read(self, name: str, read: Read = Read()) -> DataFrame:
        r = self.relation(name)
        if r.level == "hidden":
            raise WriteRefusal(f"{name} is hidden")
        if r.attached is not None:
            if read.kind != "current":
                raise Refusal(f"{name} keeps no history")
            return r.attached
        log, keys, cols = self.log(r), r.key_names, r.columns
        at = [instant(constant(a)) for a in read.args]
        if read.kind == "at":
            return resolve(log, keys, cols, at[-1], at[0] if len(at) > 1 else LATEST)
        if read.kind == "spans":
            return spans(log, keys, cols, at[0] if at else LATEST)
        if read.kind == "delta":
            return self._delta(log, keys, cols, *at)
        if read.kind == "delta_sys":
            return difference(resolve(log, keys, cols, LATEST, at[0]), resolve(log, keys, cols, LATEST, at[1]))
        return resolve(log, keys, cols)

    def _delta(self, log, keys, cols, lo: int, hi: int) -> DataFrame:
        """Only keys with an event between the instants are resolved."""
        a, b = min(lo, hi), max(lo, hi)
        touched = log.where((F.col("_valid") > a) & (F.col("_valid") <= b)).select(*[F.col(f"`{k}`").alias(f"t{i}") for i, k in enumerate(keys)]).distinct()
        on = [F.col(f"`{k}`").eqNullSafe(F.col(f"t{i}")) for i, k in enumerate(keys)]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        near = log.join(touched, cond, "left_semi")
        return difference(resolve(near, keys, cols, lo), resolve(near, keys, cols, hi))

    # -- programs
    def run(self, text: str, params: dict | None = None) -> DataFrame:
        """Run a script: rows of a query, a status row of a mutation, or a catalog listing."""
        p = parse(text, params)
        if isinstance(p, System):
            return self._system(p)
        return self._transaction(p) if p.write else self.engine.run(p)

    def _status(self, **columns) -> DataFrame:
        return self.spark.createDataFrame([tuple(columns.values())], list(columns))

    def _transaction(self, p: Program, bound: dict[str, DataFrame] | None = None) -> DataFrame:
        saved = {n: (r, list(r.parts), list(r.triggers), dict(r.types)) for n, r in self.relations.items()}
        events: list = []
        try:
            out = self._write(p, bound or {}, events)
            if self.depth == 0:
                for name, q in self.constraints.items():
                    if not self.engine.run(parse(q)).isEmpty():
                        raise WriteRefusal(f"constraint {name} denies the write")
        except Exception:
            if self.depth == 0:
                self.relations = {n: r for n, (r, *_) in saved.items()}
                for n, (r, parts, triggers, types) in saved.items():
                    r.parts, r.triggers, r.types = parts, triggers, types
            raise
        for name, op, new, old in events:
            for f in self.callbacks.get(name, []):
                f(op, new, old)
        return out

    def _write(self, p: Program, bound: dict, events: list) -> DataFrame:
        w: Write = p.write
        if any(r.name == "?" for r in p.rules):
            df = self.engine.run(p, bound)
        elif w.op in ("create", "replace") and w.keys is not None:
            df = None
        else:
            raise UnknownName("a program needs an entry rule ?")
        if w.name.startswith("_"):
            raise WriteRefusal("temporary relations are refused")
        exists = w.name in self.relations
        if w.op == "create" and exists:
            raise WriteRefusal(f"{w.name} exists")
        if w.op not in ("create", "replace") and not exists:
            raise UnknownName(f"no relation {w.name}")
        old_rows = None
        if exists:
            r = self.relations[w.name]
            if r.attached is not None or r.log_frame is not None or r.level in ("hidden", "read_only"):
                raise WriteRefusal(f"{w.name} is not writable")
            if w.op == "replace":
                if r.level == "protected":
                    raise WriteRefusal(f"{w.name} is protected")
                if r.indices:
                    raise WriteRefusal(f"{w.name} has indices")
                if self.depth:
                    raise WriteRefusal("a trigger cannot replace")
                old_rows = cut(self.read(w.name))
        if w.op in ("create", "replace"):
            r = self._define(w, df)
            if exists:
                r.triggers = list(self.relations[w.name].triggers)
            self.relations[w.name] = r
            kind = "put"
        else:
            r, kind = self.relations[w.name], "rm" if w.op in ("rm", "delete") else "put"
        if df is None:
            return self._status(status="OK")
        rows = self._coerce(r, w, df, keys_only=w.op in ("rm", "delete", "ensure_not"), partial=w.op == "update")
        rows = cut(rows)
        now = self.read(w.name)
        on = self._on_keys(r)
        met = now.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(r.key_names)])
        if w.op == "insert" and not rows.join(met, on, "left_semi").isEmpty():
            raise WriteRefusal(f"a key exists in {w.name}")
        if w.op in ("update", "delete") and not rows.join(met, on, "left_anti").isEmpty():
            raise WriteRefusal(f"a key is absent from {w.name}")
        if w.op == "ensure":
            if not anti(rows.select(*r.columns), now).isEmpty():
                raise WriteRefusal(f"a row is not in {w.name}")
            return self._status(status="OK")
        if w.op == "ensure_not":
            if not rows.join(met, on, "left_semi").isEmpty():
                raise WriteRefusal(f"a key is in {w.name}")
            return self._status(status="OK")
        if w.op == "update":
            given = [c for c in r.columns if c in rows.columns]
            n = now.select(*[F.col(f"`{c}`").alias(f"o_{c}") for c in r.columns], *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(r.key_names)])
            rows = rows.join(n, on).select(*[F.col(f"`{c}`") if c in given else F.col(f"`o_{c}`").alias(c) for c in r.columns], "_valid")
            rows = cut(rows)
        old = cut(now.join(rows.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(r.key_names)]), on, "left_semi")) if kind == "rm" or exists else now.limit(0)
        self._append(r, rows, "retract" if kind == "rm" else "assert")
        new = rows.drop("_valid")
        events.append((w.name, kind, new, old))
        self._fire(r, kind, new, old)
        if w.op == "replace" and old_rows is not None:
            self._fire(r, "replace", new, old_rows)
        if p.returning:
            full = new if kind == "put" else old
            return full.withColumn("_kind", F.lit("inserted" if kind == "put" else "deleted"))
        return self._status(status="OK")

    def _fire(self, r: Relation, kind: str, new: DataFrame, old: DataFrame) -> None:
        for k, text in r.triggers:
            if k != kind:
                continue
            if self.depth >= 32:
                raise LimitExceeded("triggers cascade too deep")
            self.depth += 1
            try:
                p = parse(text)
                bound = {"_new": new.toDF(*[f"c{i}" for i in range(len(new.columns))]), "_old": old.toDF(*[f"c{i}" for i in range(len(old.columns))])}
                self._transaction(p, bound) if p.write else self.engine.run(p, bound).isEmpty()
            finally:
                self.depth -= 1

    def _on_keys(self, r: Relation) -> Column:
        out = F.lit(True)
        for i, k in enumerate(r.key_names):
            out = out & F.col(f"`{k}`").eqNullSafe(F.col(f"k{i}"))
        return out

    def _define(self, w: Write, df: DataFrame | None) -> Relation:
        if w.keys is None:
            if df is None:
                raise ParseError("a relation needs columns")
            keys, values = [ColumnSpec(c) for c in df.columns], []
        else:
            keys, values = w.keys, w.values or []
        r = Relation(w.name, keys, values)
        for c in keys + values:
            r.types[c.name] = self._type(c, df)
        return r

    def _type(self, c: ColumnSpec, df: DataFrame | None) -> T.DataType:
        t = c.type.removesuffix("?")
        if t == "Any":
            src = c.source or c.name
            if df is not None and src in df.columns:
                d = df.schema[src].dataType
                return T.LongType() if isinstance(d, (T.IntegerType, T.NullType)) else d
            return T.LongType()
        return T._parse_datatype_string(self._ddl(t)) if t not in ATOMS else T._parse_datatype_string(ATOMS[t])

    def _ddl(self, t: str) -> str:
        t = t.removesuffix("?")
        if t in ATOMS:
            return ATOMS[t]
        if t.startswith("["):
            return f"array<{self._ddl(re.sub(';[0-9]+$', '', t[1:-1]))}>"
        if t.startswith("<"):
            return "array<double>"
        if t.startswith("("):
            return "struct<" + ",".join(f"_{i}:{self._ddl(x)}" for i, x in enumerate(t[1:-1].split(","), 1)) + ">"
        return "string"

    def _coerce(self, r: Relation, w: Write, df: DataFrame, keys_only: bool, partial: bool) -> DataFrame:
        typing, out = Typing(df), []
        binds = {c.name: c.source for c in (w.keys or []) + (w.values or []) if c.source}
        for c in r.keys if keys_only else r.keys + r.values:
            src = binds.get(c.name, c.name)
            if src in df.columns:
                x = F.col(f"`{src}`")
            elif c.default is not None:
                x = Frame(self.spark, df, ()).expr(c.default)
            elif partial and c not in r.keys:
                continue
            elif c.type.endswith("?") and c not in r.keys:
                x = F.lit(None)
            else:
                raise TypeRefusal(f"column {c.name} is missing")
            out.append(self._fit(typing, x, c, r.types[c.name]).alias(c.name))
        at = F.lit(self._tick_valid())
        if w.at is not None:
            if variables(w.at):
                x = df.toDF(*[mangle(c) for c in df.columns])
                df = x.withColumn("_at", Frame(self.spark, x, tuple(df.columns)).expr(w.at)).toDF(*df.columns, "_at")
                at = F.col("_at").cast("bigint")
            else:
                at = F.lit(instant(constant(w.at)))
        at = F.when(at == LATEST, F.raise_error(F.lit("that instant is reserved"))).otherwise(at)
        return df.select(*out, at.cast("bigint").alias("_valid"))

    def _fit(self, typing: Typing, x: Column, c: ColumnSpec, t: T.DataType) -> Column:
        have, kind = typing.type(x), c.type.removesuffix("?")
        bad = lambda m: F.raise_error(F.lit(f"column {c.name}: {m}"))
        if kind == "Int" and isinstance(have, (T.DoubleType, T.FloatType)):
            y = F.when(x == F.floor(x), x.cast("bigint")).otherwise(F.when(x.isNotNull(), bad("not an integer")))
        elif kind == "Bytes" and isinstance(have, T.StringType):
            y = F.unbase64(x)
        elif kind in ("Int", "Float", "Bool") and isinstance(have, T.StringType) or kind == "String" and not isinstance(have, (T.StringType, T.NullType)):
            y = F.when(x.isNotNull(), bad(f"not {kind}")).cast(t)
        elif kind == "Uuid":
            y = F.when(x.isNull() | x.rlike(r"^[0-9a-fA-F-]{36}$"), F.lower(x)).otherwise(bad("not a UUID"))
        elif kind == "Json" and not isinstance(have, T.StringType):
            y = F.to_json(x)
        elif kind.startswith("<") or kind.startswith("[") and ";" in kind:
            size = int(re.search(r";(\d+)", kind)[1])
            y = F.when(x.isNull() | (F.size(x) == size), x.cast(t)).otherwise(bad(f"length {size} is wanted"))
            y = y.cast("array<float>").cast("array<double>") if kind.startswith("<F32") else y
        else:
            y = x.cast(t)
        return y if c.type.endswith("?") else F.coalesce(y, bad("null is refused"))

    def _tick_valid(self) -> int:
        return int(time.time() * 1e6)

    def _append(self, r: Relation, rows: DataFrame, op: str) -> None:
        self.clock = max(self.clock + 1, int(time.time() * 1e6))
        cols = [F.col(f"`{c}`").cast(r.types[c]).alias(c) if c in rows.columns else F.lit(None).cast(r.types[c]).alias(c) for c in r.columns]
        place = f"{self.root}/{r.name}/{uuid.uuid4().hex}"
        rows.select(*cols, "_valid", F.lit(self.clock).cast("bigint").alias("_sys"), F.lit(op).alias("_op")).write.parquet(place)
        r.parts.append(place)

    # -- system operations
    def _system(self, s: System) -> DataFrame:
        op, a = s.op, s.args
        table = lambda rows, schema: self.spark.createDataFrame(rows, schema)
        if op == "relations":
            return table([(r.name, len(r.columns), len(r.keys), r.level, r.about) for r in self.relations.values()], "name string, arity int, n_keys int, access string, description string")
        if op == "columns":
            r = self.relation(a[0])
            return table([(c.name, c in r.keys, i, c.type) for i, c in enumerate(r.keys + r.values)], "column string, is_key boolean, index int, type string")
        if op == "indices":
            return table([(n, k) for n, (k, _) in self.relation(a[0]).indices.items()], "name string, type string")
        if op == "fixed_rules":
            return table([(n,) for n in sorted(self.engine.algorithms)], "rule string")
        if op == "running":
            return table([], "id bigint, started double")
        if op == "compact":
            for r in self.relations.values():
                if len(r.parts) > 1:
                    place = f"{self.root}/{r.name}/{uuid.uuid4().hex}"
                    self.log(r).coalesce(max(1, len(r.parts) // 8)).write.parquet(place)
                    r.parts = [place]
            return self._status(status="OK")
        if op == "kill":
            raise Refusal("kill is refused: cancel the job group of the session instead")
        if op == "explain":
            df = self.engine.run(parse(a[0]))
            return table([(df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),)], "plan string")
        if op == "verify":
            from tessera.plans.verify import verify

            return table([verify(self, a[0])], "status string, detail string")
        if op == "remove":
            for n in a:
                r = self.relation(n)
                if r.level != "normal" and r.attached is None:
                    raise WriteRefusal(f"{n} is {r.level}")
            for n in a:
                del self.relations[n]
        elif op == "rename":
            for old, new in a:
                if new in self.relations:
                    raise WriteRefusal(f"{new} exists")
                r = self.relation(old)
                r.name = new
                self.relations[new] = self.relations.pop(old)
        elif op == "describe":
            self.relation(a[0]).about = a[1] if len(a) > 1 else ""
        elif op == "access_level":
            for n in a[1:]:
                self.relation(n).level = a[0]
        elif op == "set_triggers":
            for _, text in a[1:]:
                parse(text)
            self.relation(a[0]).triggers = list(a[1:])
        elif op == "show_triggers":
            return table([(k, i, t) for i, (k, t) in enumerate(self.relation(a[0]).triggers)], "type string, index int, trigger string")
        elif op == "constraint":
            if a[0] == "list":
                return table(sorted(self.constraints.items()), "name string, query string")
            if a[0] == "drop":
                if self.constraints.pop(a[1], None) is None:
                    raise UnknownName(f"no constraint {a[1]}")
            else:
                if not self.engine.run(parse(a[2])).isEmpty():
                    raise WriteRefusal(f"constraint {a[1]} is violated already")
                self.constraints[a[1]] = a[2]
        elif op in ("hnsw", "fts", "lsh", "index"):
            self._index(op, a)
        return self._status(status="OK")

    def _index(self, kind: str, a: list) -> None:
        r = self.relation(a[1])
        if a[0] == "drop":
            if r.indices.pop(a[2], None) is None:
                raise UnknownName(f"no index {a[2]}")
            return
        if a[2] in r.indices:
            raise WriteRefusal(f"index {a[2]} exists")
        known = {"hnsw": {"dim", "ef_construction", "ef", "m_neighbours", "m", "dtype", "fields", "distance", "dist", "filter", "extend_candidates", "keep_pruned_connections"},
                 "fts": {"extractor", "extract_filter", "tokenizer", "filters"},
                 "lsh": {"extractor", "extract_filter", "tokenizer", "filters", "n_gram", "n_perm", "target_threshold", "false_positive_weight", "false_negative_weight"}}
        options = {"columns": a[3]} if kind == "index" else dict(a[3])
        if kind != "index":
            odd = set(options) - known[kind]
            if odd:
                raise UnknownName(f"no index option {sorted(odd)[0]}")
            for want in {"hnsw": ("dim",), "lsh": ("extractor",), "fts": ("extractor",)}[kind]:
                if want not in options:
                    raise TypeRefusal(f"index option {want} is required")
        r.indices[a[2]] = (kind, options)

    # -- search atoms
    def search(self, engine: Engine, a, f: Frame, env) -> Frame:
        r = self.relation(a.relation)
        if a.index not in r.indices:
            raise UnknownName(f"no index {a.index} on {a.relation}")
        kind, o = r.indices[a.index]
        q = dict(a.options)
        allowed = {"hnsw": {"query", "k", "ef", "radius", "filter", "bind_field", "bind_field_idx", "bind_distance", "bind_vector"},
                   "fts": {"query", "k", "score_kind", "bind_score", "filter"}, "lsh": {"query", "k", "filter"}}.get(kind)
        if allowed is None:
            raise Refusal("a plain index is not searched")
        if set(q) - allowed:
            raise UnknownName(f"no search option {sorted(set(q) - allowed)[0]}")
        if any(not isinstance(v, Var) for _, v in a.binds):
            raise UnsafeRule("search bindings must be variables")
        base = self.read(a.relation)
        cols, keys = r.columns, [F.col(f"`b_{c}`") for c in r.key_names]
        b = base.select(*[F.col(f"`{c}`").alias(f"b_{c}") for c in cols])
        inner = Frame(self.spark, base.toDF(*[mangle(c) for c in cols]), tuple(cols))
        only = o.get("filter" if kind == "hnsw" else "extract_filter")
        if only is not None:  # rows the index does not hold
            inner = Frame(self.spark, inner.df.where(inner.expr(only)), tuple(cols))
            b = inner.df.toDF(*[f"b_{c}" for c in cols])
        if "filter" in q:
            names = {v.name: c for c, v in a.binds}
            e = _rename(q["filter"], names)
            b = inner.where(inner.expr(e)).df.toDF(*[f"b_{c}" for c in cols])
        if isinstance(q["query"], (Lit, Call)) and not variables(q["query"]):
            try:
                value = constant(q["query"])
                asked = literal(value)
            except Refusal:  # a call such as vec([...]), the same for all rows
                value, asked = None, Frame(self.spark).expr(q["query"])
            if kind == "fts" and not isinstance(value, str):
                raise UnsafeRule("a full-text query must be a constant text")
            found, extra = self._one(kind, o, q, b, cols, keys, asked, value, None)
        else:
            if kind == "fts":
                raise UnsafeRule("a full-text query must be a constant")
            each = f.df.select(f.expr(q["query"]).alias("q")).where("q is not null").distinct()
            found, extra = self._one(kind, o, q, b, cols, keys, F.col("q"), None, each)
        names, out = [], []
        for c, v in a.binds:
            if c not in cols:
                raise UnknownName(f"relation {a.relation} has no column {c}")
            if v.name.startswith("_"):
                continue
            names.append(v.name)
            out.append(F.col(f"`b_{c}`").alias(f"s{len(out)}"))
        for opt, col in extra.items():
            if opt in q:
                names.append(q[opt].name)
                out.append(col.alias(f"s{len(out)}"))
        from tessera.plans.engine import join

        if "q" in found.columns and not isinstance(q["query"], Lit) and variables(q["query"]):
            g = f.bind("query~", f.expr(q["query"]))
            g = join(g, found.select(F.col("q").alias("qq"), *out), ["query~", *names])
            return Frame(self.spark, g.df.drop(mangle("query~")), tuple(n for n in g.bound if n != "query~"))
        return join(f, found.select(*out), names)

    def _one(self, kind, o, q, b, cols, keys, query, value, each):
        """Rows found for one query, or for each row ``q`` of ``each``."""
        k = int(constant(q["k"])) if "k" in q else None
        by = [F.col("q")] if each is not None else None
        if kind == "hnsw":
            b = b if each is None else each.crossJoin(b)
            if k is None:
                raise TypeRefusal("k is required")
            fields = constant(o["fields"]) if isinstance(o.get("fields"), Call) and all(isinstance(x, Lit) for x in o["fields"].args) else [x.name for x in getattr(o.get("fields"), "args", ())]
            fields = fields or [c for c in cols if isinstance(b.schema[f"b_{c}"].dataType, T.ArrayType)][:1]
            for c in fields:
                if c not in cols:
                    raise UnknownName(f"relation has no column {c}")
            dist = o.get("distance", o.get("dist"))
            dist = dist.name if isinstance(dist, Var) else dist.value if dist else "L2"
            radius = float(constant(q["radius"])) if "radius" in q else None
            found = None  # a candidate per vector: of every field, and of every element where a field is a list of vectors
            for n, c in enumerate(fields):
                v, rest = F.col(f"`b_{c}`"), [F.col(f"`{x}`") for x in b.columns]
                many = isinstance(b.schema[f"b_{c}"].dataType.elementType, T.ArrayType)
                x = b.select(*rest, F.posexplode(v).alias("_at", "_vector")) if many else b.select(*rest, F.lit(None).cast("bigint").alias("_at"), v.alias("_vector"))
                x = x.withColumn("_at", F.col("_at").cast("bigint")).withColumn("_field", F.lit(n))
                found = x if found is None else found.unionByName(x)
            v = F.col("_vector")
            found = search.nearest(found.where(v.isNotNull()), query, v, k, dist, radius, by, [*keys, F.col("_field"), F.col("_at")])
            name = F.element_at(F.array(*[F.lit(c) for c in fields]), F.col("_field") + 1)
            return found, {"bind_distance": F.col("_distance"), "bind_vector": v, "bind_field": name, "bind_field_idx": F.col("_at")}
        plain = tuple(c.removeprefix("b_") for c in b.columns)
        x = b.toDF(*[mangle(c) for c in plain])
        x = x.withColumn("_text", Frame(self.spark, x, plain).expr(o["extractor"]))
        x = x.toDF(*b.columns, "_text")
        name = lambda e: e.name if isinstance(e, (Var, Call)) else constant(e)
        tok = o.get("tokenizer")
        filters = [name(e) if isinstance(e, (Var, Lit)) else [e.name, *[constant(y) for y in e.args]] for e in getattr(o.get("filters"), "args", ())]
        split = lambda c: search.tokens(c, name(tok) if tok is not None else "Simple", filters, [constant(y) for y in tok.args] if isinstance(tok, Call) else None)
        if kind == "fts":  # without k all matches
            cache: dict = {}

            def parts(w):
                if w not in cache:
                    cache[w] = self.spark.range(1).select(split(F.lit(w)).alias("t")).first()["t"]
                return cache[w]

            score = q.get("score_kind")
            found = search.full_text(x, split(F.col("_text")), value, parts, k, keys, name(score) if score is not None else "tf_idf")
            return found, {"bind_score": F.col("_score")}
        g = int(constant(o["n_gram"])) if "n_gram" in o else 1
        weight = lambda n, d: float(constant(o[n])) if n in o else d
        nb, nr = search.bands(weight("target_threshold", 0.9), int(weight("n_perm", 200)), weight("false_positive_weight", 1.0), weight("false_negative_weight", 1.0))
        found = search.same_band(x, "_text", lambda t: search.band_keys(search.shingles(split(t), g), nb, nr), query, each).drop("_text")
        if k and by:
            found = found.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col("_n") <= k).drop("_n")
        elif k:
            found = found.orderBy(*keys).limit(k)
        return found, {}

    # -- observation
    def register_callback(self, name: str, f) -> None:
        """``f(op, new, old)`` after every committed write to a relation."""
        self.callbacks.setdefault(name, []).append(f)

    def backup(self, place: str) -> None:
        """All relations, with their history, under one folder."""
        import json

        rows = []
        for r in self.relations.values():
            if r.attached is None and r.log_frame is None:
                self.log(r).write.parquet(f"{place}/{r.name}")
                rows.append(json.dumps({"name": r.name, "keys": [c.name for c in r.keys], "columns": [[c.name, c.type] for c in r.keys + r.values], "triggers": r.triggers}))
        self.spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.text(f"{place}/_manifest")

    def restore(self, place: str) -> None:
        import json

        if self.relations:
            raise WriteRefusal("restore needs an empty database")
        for row in self.spark.read.text(f"{place}/_manifest").collect():
            m = json.loads(row["value"])
            specs = [ColumnSpec(n, t) for n, t in m["columns"]]
            r = Relation(m["name"], [c for c in specs if c.name in m["keys"]], [c for c in specs if c.name not in m["keys"]], parts=[f"{place}/{m['name']}"], triggers=[tuple(t) for t in m["triggers"]])
            schema = self.spark.read.parquet(r.parts[0]).schema
            r.types = {c.name: schema[c.name].dataType for c in specs}
            self.relations[r.name] = r


def _rename(e, names: dict):
    if isinstance(e, Var):
        return Var(names.get(e.name, e.name))
    if isinstance(e, Call):
        return Call(e.name, tuple(_rename(x, names) for x in e.args))
    return e
