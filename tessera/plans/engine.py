"""Rule programs as Spark plans.

Non-recursive rules become one lazy DataFrame each: atoms are joins on shared
variables, negation is an anti join, conditions are filters, so Catalyst sees
the whole program at once.  Recursive groups run semi-naively in a driver loop
whose deltas are reliable checkpoints; only a delta's emptiness reaches the
driver.  Bound arguments of recursive rules are pushed into their base rules
where the recursion passes them on unchanged.
"""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.errors import LimitExceeded, NotStratifiable, Refusal, TypeRefusal, UnknownName, UnsafeRule
from tessera.functions import aggregates, scalar
from tessera.operators.lineage import cut
from tessera.operators.ranges import interval_join
from tessera.operators.ranking import quantile
from tessera.plans.parser import And, Call, Cond, HeadArg, Lit, Not, Or, Program, Rule, RuleAtom, SearchAtom, StoredAtom, Unify, Var, constant, parse


def literal(v) -> Column:
    """A constant as a column; lists keep one element type."""
    if isinstance(v, list):
        kind = "bigint" if not v else None
        out = F.array(*[literal(x) for x in v])
        out = out.cast(f"array<{kind}>") if kind else out
    elif isinstance(v, dict):
        import json

        out = F.parse_json(F.lit(json.dumps(v, sort_keys=True)))
    elif isinstance(v, bool) or v is None or isinstance(v, (str, float, bytes, bytearray)):
        out = F.lit(v)
    elif isinstance(v, int):
        out = F.lit(v).cast("bigint")
    else:
        raise TypeRefusal(f"no literal for {type(v).__name__}")
    out.literal = v
    return out


class Typing:
    """Types of expressions over one DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df

    def type(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema[0].dataType


def variables(e) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*[variables(a) for a in e.args]) if e.args else set()
    return set()


def mangle(var: str) -> str:
    """Column of a variable; Spark compares names without case."""
    return "v_" + "".join(f"^{c.lower()}" if c.isupper() else c for c in var).replace(".", "~")


class Frame:
    """A partial rule body: a DataFrame with a column per bound variable."""

    #: Whether no two rows agree in the variables of the rule's head; any further step forgets it.
    once = False

    def __init__(self, spark: SparkSession, df: DataFrame | None = None, bound: tuple[str, ...] = ()):
        self.spark, self.df, self.bound = spark, df if df is not None else spark.range(1).select(), bound
        self.unit = df is None

    def col(self, var: str) -> Column:
        return self.df[f"`{mangle(var)}`"]

    def expr(self, e) -> Column:
        if isinstance(e, Lit):
            return literal(e.value)
        if isinstance(e, Var):
            if e.name not in self.bound:
                raise UnsafeRule(f"variable {e.name} is not bound")
            return self.col(e.name)
        try:
            return literal(constant(e)) if e.name in ("list", "minus") else self._call(e)
        except Refusal:
            return self._call(e)

    def _call(self, e: Call) -> Column:
        if e.name in ("set_json_path", "remove_json_path", "get", "maybe_get", "regex") or e.name.startswith("regex_"):
            args = []
            for a in e.args:
                c = self.expr(a)
                try:
                    c.literal = constant(a)
                except Refusal:
                    if isinstance(a, Call) and a.name == "regex":
                        c.literal = constant(a.args[0])
                args.append(c)
        else:
            args = [self.expr(a) for a in e.args]
        return scalar.build(Typing(self.df), e.name, args)

    def where(self, c: Column) -> Frame:
        return self.with_df(self.df.where(c))

    def with_df(self, df: DataFrame, bound: tuple[str, ...] | None = None) -> Frame:
        out = Frame(self.spark, df, self.bound if bound is None else bound)
        return out

    def bind(self, var: str, c: Column) -> Frame:
        return self.with_df(self.df.withColumn(mangle(var), c), (*self.bound, var))


def _same(a: Column, b: Column, nullable: bool) -> Column:
    return a.eqNullSafe(b) if nullable else a == b


def join(f: Frame, right: DataFrame, names: list[str], how: str = "inner") -> Frame:
    """Join on shared variables; null meets null.

    ``right`` has one column per name.  Keys of an integer and a float column
    are different values in the language and are refused.
    """
    if f.unit and not f.bound and how == "inner":
        return Frame(f.spark, right.toDF(*[mangle(n) for n in names]), tuple(names))
    right = right.toDF(*[f"r_{k}" for k in range(len(names))])
    on, fresh = [], []
    for k, n in enumerate(names):
        if n in f.bound:
            lt, rt = f.df.schema[mangle(n)], right.schema[f"r_{k}"]
            if isinstance(lt.dataType, T.StringType) != isinstance(rt.dataType, T.StringType) and not isinstance(lt.dataType, T.NullType) and not isinstance(rt.dataType, T.NullType):
                on.append(F.lit(False))
            else:
                on.append(_same(f.col(n), right[f"r_{k}"], lt.nullable and rt.nullable))
        else:
            fresh.append((k, n))
    if how != "inner":
        cond = on or [F.lit(True)]
        return f.with_df(f.df.join(right, _all(cond), how))
    df = f.df.join(right, _all(on), "inner") if on else f.df.crossJoin(right)
    keep = [f.col(n) for n in f.bound] + [right[f"r_{k}"].alias(mangle(n)) for k, n in fresh]
    return Frame(f.spark, df.select(*keep), (*f.bound, *[n for _, n in fresh]))


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def disjuncts(body) -> list[list]:
    """Disjunctive normal form: a list of conjunctions of plain atoms."""
    if isinstance(body, And):
        out = [[]]
        for p in body.parts:
            out = [a + b for a in out for b in disjuncts(p)]
        return out
    if isinstance(body, Or):
        return [d for s in body.sides for d in disjuncts(s)]
    if isinstance(body, Not):
        a = body.atom
        if isinstance(a, Not):
            return disjuncts(a.atom)
        if isinstance(a, Or):
            return disjuncts(And(tuple(Not(x) for x in a.sides)))
        if isinstance(a, And):
            return disjuncts(Or(tuple(Not(x) for x in a.parts)))
        if isinstance(a, Cond):
            return [[Cond(Call("negate", (a.expr,)))]]
        if isinstance(a, Unify):
            return [[Cond(Call("negate", (Call("is_in", (Var(a.var), a.expr)),))) if a.many else Cond(Call("neq", (Var(a.var), a.expr)))]]
        if isinstance(a, SearchAtom):
            raise UnsafeRule("a negated search is refused")
    return [[body]]


def atom_vars(a) -> set[str]:
    """Variables an atom can bind."""
    if isinstance(a, RuleAtom):
        return {x.name for x in a.args if isinstance(x, Var)}
    if isinstance(a, StoredAtom):
        args = [v for _, v in a.args] if a.named else list(a.args)
        return {x.name for x in args if isinstance(x, Var)} | ({a.read.var} if a.read.var else set())
    return set()


class Engine:
    """Evaluates programs against a catalog of relations."""

    #: Whether an atom that binds no new variable only has to hold once.
    holds = False
    #: Variables of the head at hand, where it has no aggregates.
    wanted: frozenset = frozenset()

    def __init__(self, spark: SparkSession, catalog=None, max_epochs: int = 1_000_000, max_rows: int | None = None):
        self.spark, self.catalog, self.max_epochs, self.max_rows = spark, catalog, max_epochs, max_rows
        self.extra: dict[str, DataFrame] = {}
        self.algorithms: dict[str, object] = {}
        from tessera.operators import graph

        self.algorithms.update(graph.REGISTRY)

    # -- public
    def query(self, text: str, params: dict | None = None) -> DataFrame:
        """Rows of the entry rule; columns are named by its head."""
        return self.run(parse(text, params))

    def run(self, p: Program, bound: dict[str, DataFrame] | None = None) -> DataFrame:
        self.deadline = time.monotonic() + p.timeout if p.timeout else None
        rules: dict[str, list[Rule]] = {}
        for r in p.rules:
            rules.setdefault(r.name, []).append(r)
        if "?" not in rules:
            raise UnknownName("a program needs an entry rule ?")
        if not p.options.get("disable_magic_rewrite"):
            rules = push_demand(rules)
        head = rules["?"][0].head
        df = self.evaluate(rules, dict(bound or {}))
        names = [f"{h.aggr}({h.var})" if h.aggr else h.var for h in head]
        return self.finish(df, names, p)

    def finish(self, df: DataFrame, names: list[str], p: Program) -> DataFrame:
        df = df.toDF(*[f"c{k}" for k in range(len(names))])
        cols = [F.col(f"c{k}") for k in range(len(names))]
        place = {n: k for k, n in enumerate(names)}
        if p.order:
            keys = []
            for n, down in p.order:
                if n not in place:
                    raise UnsafeRule(f"sort variable {n} is not in the head")
                keys.append(cols[place[n]].desc_nulls_last() if down else cols[place[n]].asc_nulls_first())
            df = df.orderBy(*keys, *[c.asc_nulls_first() for c in cols])
        elif p.limit is not None or p.offset:
            df = df.orderBy(*[c.asc_nulls_first() for c in cols])
        if p.offset:
            df = df.offset(p.offset)
        if p.limit is not None:
            df = df.limit(p.limit)
        if p.check and df.isEmpty() != (p.check == "none"):
            raise Refusal(f"the program asserts {p.check} rows")
        return df.toDF(*names)

    # -- strata
    def evaluate(self, rules: dict[str, list[Rule]], done: dict[str, DataFrame]) -> DataFrame:
        needs = {n: self._needs(rs) for n, rs in rules.items()}
        for n, deps in needs.items():
            for d, _ in deps:
                if d not in rules and d not in done:
                    raise UnknownName(f"no rule {d}")
        for group in components("?", {n: {d for d, _ in deps if d in rules} for n, deps in needs.items()}):
            inside = set(group)
            for n in group:
                bad = [d for d, strict in needs[n] if d in inside and strict]
                if bad:
                    raise NotStratifiable(f"{n} depends on {bad[0]} through negation or plain aggregation within a recursion")
            if len(group) == 1 and not any(d in inside for d, _ in needs[group[0]]):
                done[group[0]] = self._plain(rules[group[0]], done)
            else:
                self._fixpoint(group, rules, done)
        return done["?"]

    def _needs(self, rs: list[Rule]) -> set[tuple[str, bool]]:
        """Rules used, and whether the use must be complete first."""
        out: set[tuple[str, bool]] = set()
        for r in rs:
            plain = any(h.aggr and h.aggr not in aggregates.MEET for h in r.head)
            mixed = {tuple((h.aggr or "") for h in r2.head) for r2 in rs}
            if len(mixed) > 1:
                raise TypeRefusal(f"rules of {r.name} differ in arity or aggregates")
            if r.algo:
                out |= {(i.name, True) for i in r.inputs if isinstance(i, RuleAtom)}
            elif r.body is not None:
                for d in disjuncts(r.body):
                    for a in d:
                        if isinstance(a, RuleAtom):
                            out.add((a.name, plain))
                        elif isinstance(a, Not) and isinstance(a.atom, RuleAtom):
                            out.add((a.atom.name, True))
        return out

    def _check(self):
        if self.deadline and time.monotonic() > self.deadline:
            raise LimitExceeded("deadline")

    def _plain(self, rs: list[Rule], env: dict[str, DataFrame]) -> DataFrame:
        self._check()
        parts = [p for r in rs for p in self._derivations(r, env)]
        return self._fold(rs[0], parts)

    def _fold(self, rule: Rule, parts: list[DataFrame]) -> DataFrame:
        df = union_all(parts)
        if any(h.aggr for h in rule.head):
            return self._aggregate(rule.head, df)
        return df if len(parts) == 1 and getattr(df, "_once", False) else df.distinct()

    def _aggregate(self, head: list[HeadArg], df: DataFrame) -> DataFrame:
        t, tie = Typing(df), F.struct(*[df[c] for c in df.columns])
        keys = [f"c{k}" for k, h in enumerate(head) if not h.aggr]
        made, exact = [], {}
        for k, h in enumerate(head):
            if h.aggr:
                c = aggregates.build(h.aggr, df[f"c{k}"], t.type(df[f"c{k}"]), [constant(x) for x in h.extra], tie)
                if h.aggr == "quantile":
                    exact[f"c{k}"] = c, constant(h.extra[0])
                else:
                    made.append(c.alias(f"c{k}"))
        out = (df.groupBy(*keys) if keys else df.groupBy()).agg(*made) if made or not exact else None
        for name, (c, q) in exact.items():  # an order statistic is no partial aggregate
            one = quantile(df.select(*[F.col(x) for x in keys], c.alias(name)), keys, name, float(q))
            if out is None:
                out = one
            else:
                one = one.toDF(*[f"g{x}" for x in keys], name)
                out = out.join(one, _all([F.col(x).eqNullSafe(F.col(f"g{x}")) for x in keys] or [F.lit(True)])).drop(*[f"g{x}" for x in keys])
        return out.select(*[f"c{k}" for k in range(len(head))])

    def _derivations(self, r: Rule, env: dict[str, DataFrame]) -> list[DataFrame]:
        if r.rows is not None:
            return [self._constant(r)]
        if r.algo:
            return [self._algorithm(r, env)]
        # aggregates count derivations; elsewhere an atom that binds nothing new only has to hold
        before, self.holds, self.wanted = (self.holds, self.wanted), not any(h.aggr for h in r.head), frozenset(h.var for h in r.head)
        try:
            return [self._project(self._body(d, env), r) for d in disjuncts(r.body)]
        finally:
            self.holds, self.wanted = before

    def _project(self, f: Frame, r: Rule) -> DataFrame:
        out = f.df.select(*[f.expr(Var(h.var)).alias(f"c{k}") for k, h in enumerate(r.head)])
        out._once = f.once
        return out

    def _constant(self, r: Rule) -> DataFrame:
        rows = constant(r.rows)
        if not isinstance(rows, list) or any(not isinstance(x, list) for x in rows):
            raise TypeRefusal("a constant rule needs a list of lists")
        width = len(r.head) or (len(rows[0]) if rows else 0)
        if any(len(x) != width for x in rows):
            raise TypeRefusal("rows of a constant rule differ in length")
        return rows_frame(self.spark, rows, width)

    def _algorithm(self, r: Rule, env: dict[str, DataFrame]) -> DataFrame:
        if r.algo not in self.algorithms:
            raise UnknownName(f"no algorithm {r.algo}")
        inputs = []
        for i in r.inputs:
            if isinstance(i, RuleAtom):
                rel = env[i.name] if i.name in env else self.extra[i.name]
                named = len(i.args) == len(rel.columns) and all(isinstance(x, Var) for x in i.args)
                inputs.append(rel.toDF(*[x.name for x in i.args]) if named else rel)  # names that conditions can use
            else:
                args = [v for _, v in i.args] if i.named else list(i.args)
                rel = self._stored(i)
                inputs.append(rel.select(*[rel[f"`{rel.columns[k]}`"] for k in range(len(args))]) if args and i.named else rel)
        options = {}
        for k, v in r.options.items():
            try:
                options[k] = constant(v)
            except Refusal:
                options[k] = v
        df = self.algorithms[r.algo](self.spark, inputs, options)
        if r.head and len(df.columns) != len(r.head):
            raise TypeRefusal(f"{r.algo} gives {len(df.columns)} columns, the head has {len(r.head)}")
        return df.toDF(*[f"c{k}" for k in range(len(df.columns))])

    # -- bodies
    def _body(self, atoms: list, env: dict[str, DataFrame]) -> Frame:
        f, left = Frame(self.spark), list(atoms)
        while left:
            ready = next((a for a in left if self._ready(a, f)), None)
            if ready is None:
                raise UnsafeRule(f"cannot bind the variables of {left[0]}")
            left.remove(ready)
            f = self._intersecting(ready, f, left, env) or self._atom(ready, f, env)
        return f

    def _intersecting(self, a, f: Frame, left: list, env) -> Frame | None:
        """A product that ``interval_intersects`` restricts, as a range join.

        Takes the atoms it used out of ``left``; gives nothing where the
        pattern is absent.
        """
        if not isinstance(a, (RuleAtom, StoredAtom)) or not f.bound or atom_vars(a) & set(f.bound):
            return None
        tests = [c for c in left if isinstance(c, Cond) and isinstance(c.expr, Call) and c.expr.name == "interval_intersects" and all(isinstance(x, Var) for x in c.expr.args)]
        if not tests:
            return None
        right, used = self._atom(a, Frame(self.spark), env), []
        while True:  # what concerns the new atom alone
            own = next((c for c in left if c not in used and (
                isinstance(c, Unify) and variables(c.expr) and c.var not in f.bound or isinstance(c, Cond)) and variables(c.expr) <= set(right.bound)), None)
            if own is None:
                break
            right = self._atom(own, right, env)
            used.append(own)
        for c in tests:
            x, y = (v.name for v in c.expr.args)
            x, y = (x, y) if x in f.bound else (y, x)
            if c not in used and x in f.bound and y in right.bound:
                break
        else:
            return None
        for u in (*used, c):
            left.remove(u)
        ends = lambda g, v, n: g.df.where(~g.col(v)["empty"]).withColumn(f"_{n}lo", g.col(v)["lo"]).withColumn(f"_{n}hi", g.col(v)["hi"])
        both = interval_join(ends(f, x, "a"), ends(right, y, "b"), ("_alo", "_ahi"), ("_blo", "_bhi"))
        bound = (*f.bound, *right.bound)
        out = Frame(self.spark, both.select(*[F.col(f"`{mangle(v)}`") for v in bound]), bound)
        # the join gives each pair of rows once; where rows differ in what the head keeps, so do pairs, which may be many more
        out.once = self.holds and not left and self._tells_apart(f) and self._tells_apart(right)
        return out

    def _tells_apart(self, f: Frame) -> bool:
        """Whether the head's variables tell the rows apart, counted and not taken from declared keys."""
        kept = [f.col(v) for v in f.bound if v in self.wanted]
        if not kept or not f.df._jdf.queryExecution().analyzed().deterministic():
            return False
        return f.df.groupBy(*kept).count().where("count > 1").isEmpty()

    def _ready(self, a, f: Frame) -> bool:
        if isinstance(a, (RuleAtom, StoredAtom)):
            args = ([v for _, v in a.args] if a.named else a.args) if isinstance(a, StoredAtom) else a.args
            return all(isinstance(x, Var) or variables(x) <= set(f.bound) for x in args)
        if isinstance(a, Unify):
            return variables(a.expr) <= set(f.bound)
        if isinstance(a, Cond):
            return variables(a.expr) <= set(f.bound)
        if isinstance(a, SearchAtom):
            free = {v for k, e in a.options if not k.startswith("bind_") and k != "filter" for v in variables(e)}
            return free <= set(f.bound)
        if isinstance(a, Not):
            return {v for v in atom_vars(a.atom) if not v.startswith("_")} <= set(f.bound)
        return True

    def _atom(self, a, f: Frame, env) -> Frame:
        if isinstance(a, Cond):
            c = f.expr(a.expr)
            if not isinstance(Typing(f.df).type(c), (T.BooleanType, T.NullType)):
                raise TypeRefusal("a condition must be boolean")
            return f.where(c)
        if isinstance(a, Unify):
            c = f.expr(a.expr)
            if a.many:
                if a.var in f.bound:
                    return f.where(scalar.build(Typing(f.df), "is_in", [f.col(a.var), c]))
                return f.with_df(f.df.withColumn(mangle(a.var), F.explode(c)), (*f.bound, a.var))
            return f.where(scalar.build(Typing(f.df), "eq", [f.col(a.var), c])) if a.var in f.bound else f.bind(a.var, c)
        if isinstance(a, Not):
            right, names, conds = self._relation(a.atom, f, env)
            shared = [n for n in names if n in f.bound]
            return join(f, right.select(*[right[f"`{mangle(n)}`"] for n in shared]), shared, "left_anti")
        if isinstance(a, SearchAtom):
            return self.catalog.search(self, a, f, env)
        right, names, _ = self._relation(a, f, env)
        return join(f, right, names, "left_semi" if self.holds and f.bound and names and set(names) <= set(f.bound) else "inner")

    def _stored(self, a: StoredAtom) -> DataFrame:
        if a.name in self.extra:
            return self.extra[a.name]
        if self.catalog is None:
            raise UnknownName(f"no relation {a.name}")
        return self.catalog.read(a.name, a.read)

    def _relation(self, a, f: Frame, env) -> tuple[DataFrame, list[str], None]:
        """A relation atom's rows as one column per variable, constants filtered."""
        if isinstance(a, RuleAtom):
            rel = env.get(a.name)
            if rel is None:
                rel = self.extra.get(a.name)
            if rel is None:
                raise UnknownName(f"no rule {a.name}")
            if len(a.args) != len(rel.columns):
                raise TypeRefusal(f"{a.name} has {len(rel.columns)} columns, not {len(a.args)}")
            pairs = list(zip(rel.columns, a.args))
        else:
            rel = self._stored(a)
            if a.named:
                missing = [c for c, _ in a.args if c not in rel.columns]
                if missing:
                    raise UnknownName(f"relation {a.name} has no column {missing[0]}")
                pairs = list(a.args)
            else:
                cols = [c for c in rel.columns if c not in ("_span", "_sign")]
                if len(a.args) != len(cols):
                    raise TypeRefusal(f"{a.name} has {len(cols)} columns, not {len(a.args)}")
                pairs = list(zip(cols, a.args))
            if a.read.var:
                pairs.append(("_span" if a.read.kind == "spans" else "_sign", Var(a.read.var)))
        first: dict[str, str] = {}
        late = []
        for col, e in pairs:
            c = rel[f"`{col}`"]
            if isinstance(e, Var):
                if e.name.startswith("_"):
                    continue
                if e.name in first:
                    rel = rel.where(rel[f"`{first[e.name]}`"].eqNullSafe(c))
                else:
                    first[e.name] = col
            elif not variables(e):
                v = literal(constant(e)) if isinstance(e, (Lit, Call)) else None
                rel = rel.where(scalar.build(Typing(rel), "eq", [c, v]))
            else:
                late.append((col, e))
        names = list(first)
        out = [rel[f"`{col}`"].alias(mangle(n)) for n, col in first.items()]
        if late:
            raise UnsafeRule("an expression over variables must be unified before it is an argument")
        return rel.select(*out), names, None

    # -- recursion
    def _fixpoint(self, group: list[str], rules, env: dict[str, DataFrame]) -> None:
        inside = set(group)
        meets = {n: any(h.aggr for h in rules[n][0].head) for n in group}
        total: dict[str, list[DataFrame]] = {}
        delta: dict[str, DataFrame] = {}
        waiting = {n: [(r, d) for r in rules[n] for d in (disjuncts(r.body) if r.body is not None else [None])] for n in group}
        uses = lambda d: [k for k, a in enumerate(d or []) if isinstance(a, RuleAtom) and a.name in inside]
        base = {n: [(r, d) for r, d in waiting[n] if not uses(d)] for n in group}
        steps = [(n, r, d) for n in group for r, d in waiting[n] if uses(d)]
        for n in group:
            parts = [self._project(self._body(d, env), r) if d is not None else self._derivations(r, env)[0] for r, d in base[n]]
            if parts:
                delta[n] = cut(self._merge(rules[n][0], union_all(parts)))
        for _ in group:  # schemas of rules without a base follow from the others
            for n, r, d in steps:
                if n not in delta and all(d[k].name in delta for k in uses(d)):
                    probe = {**env, **delta}
                    delta[n] = self._merge(rules[n][0], self._project(self._body(d, probe), r)).limit(0)
        if set(delta) != inside:
            raise UnsafeRule(f"recursion without a base: {sorted(inside - set(delta))}")
        total = {n: [delta[n]] for n in group}
        epoch = derived = 0
        while True:
            self._check()
            epoch += 1
            if epoch > self.max_epochs:
                raise LimitExceeded("epochs")
            whole = {n: union_all(total[n]) for n in group}
            fresh: dict[str, list[DataFrame]] = {n: [] for n in group}
            for n, r, d in steps:
                for k in uses(d):
                    marked = list(d)
                    marked[k] = replace(d[k], name="\0" + d[k].name)
                    scope = {**env, **whole, **{"\0" + m: x for m, x in delta.items()}}
                    fresh[n].append(self._project(self._body(marked, scope), r))
            changed = False
            new_delta = {}
            for n in group:
                if not fresh[n]:
                    new_delta[n] = delta[n].limit(0)
                    continue
                found = union_all([x.toDF(*delta[n].columns) for x in fresh[n]])
                if meets[n]:
                    merged = cut(self._merge(rules[n][0], whole[n].unionByName(found)))
                    new = cut(anti(merged, whole[n]))
                    total[n] = [merged]
                else:
                    new = cut(anti(found.distinct(), whole[n]))
                    total[n].append(new)
                    if len(total[n]) > 12:
                        total[n] = [cut(union_all(total[n]))]
                new_delta[n] = new
                if self.max_rows is None:
                    changed |= not new.isEmpty()
                else:
                    count = new.count()
                    derived += count
                    changed |= count > 0
                    if derived > self.max_rows:
                        raise LimitExceeded("derived rows")
            delta = new_delta
            if not changed:
                break
        for n in group:
            env[n] = union_all(total[n])

    def _merge(self, rule: Rule, df: DataFrame) -> DataFrame:
        return self._aggregate(rule.head, df) if any(h.aggr for h in rule.head) else df.distinct()


def anti(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that are not in ``b``, null matching null."""
    b = b.toDF(*[f"x{k}" for k in range(len(b.columns))])
    fields = {f.name: f.nullable for f in a.schema}
    return a.join(b, _all([_same(a[c], b[f"x{k}"], fields[c]) for k, c in enumerate(a.columns)]) if a.columns else F.lit(True), "left_anti")


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        a, b = [f.dataType for f in out.schema], [f.dataType for f in p.schema]
        for x, y in zip(a, b):
            if isinstance(x, T.StringType) != isinstance(y, T.StringType) and not isinstance(x, T.NullType) and not isinstance(y, T.NullType):
                raise TypeRefusal(f"one column cannot hold {x.simpleString()} and {y.simpleString()}")
        out = out.union(p)
    return out


def rows_frame(spark: SparkSession, rows: list[list], width: int) -> DataFrame:
    """Constant rows; a column with integers and floats is a float column."""
    names = [f"c{k}" for k in range(width)]
    if not rows:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.NullType()) for n in names]))

    def kind(values):
        seen = [v for v in values if v is not None]
        if not seen:
            return T.NullType()
        if all(isinstance(v, bool) for v in seen):
            return T.BooleanType()
        if all(isinstance(v, int) and not isinstance(v, bool) for v in seen):
            return T.LongType()
        if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in seen):
            return T.DoubleType()
        if all(isinstance(v, str) for v in seen):
            return T.StringType()
        if all(isinstance(v, (bytes, bytearray)) for v in seen):
            return T.BinaryType()
        if all(isinstance(v, list) for v in seen):
            return T.ArrayType(kind([x for v in seen for x in v]))
        if all(isinstance(v, dict) for v in seen):
            return T.StringType()
        raise TypeRefusal("a column holds values of different kinds")

    def fit(v, t):
        if v is None:
            return None
        if isinstance(t, T.DoubleType):
            return float(v)
        if isinstance(t, T.ArrayType):
            return [fit(x, t.elementType) for x in v]
        if isinstance(v, dict):
            import json

            return json.dumps(v, sort_keys=True)
        return v

    types = [kind([r[k] for r in rows]) for k in range(width)]
    data = [tuple(fit(v, t) for v, t in zip(r, types)) for r in rows]
    return spark.createDataFrame(data, T.StructType([T.StructField(n, t) for n, t in zip(names, types)]))


def components(root: str, graph: dict[str, set[str]]) -> list[list[str]]:
    """Strongly connected groups reachable from the root, dependencies first."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []

    def visit(v: str):
        index[v] = low[v] = len(index)
        stack.append(v)
        for w in sorted(graph.get(v, ())):
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in stack:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            group = []
            while True:
                w = stack.pop()
                group.append(w)
                if w == v:
                    break
            out.append(sorted(group))

    visit(root)
    return out


def push_demand(rules: dict[str, list[Rule]]) -> dict[str, list[Rule]]:
    """Bound arguments of a recursive rule, pushed into its base rules.

    Applies where the rule is used once in the program outside itself, with a
    constant argument that every recursive rule hands on unchanged.
    """
    out = dict(rules)
    uses: dict[str, list[RuleAtom]] = {}
    for rs in rules.values():
        for r in rs:
            for atom in [a for d in (disjuncts(r.body) if r.body is not None else []) for a in d] + list(r.inputs):
                target = atom.atom if isinstance(atom, Not) else atom
                if isinstance(target, RuleAtom) and target.name != r.name:
                    uses.setdefault(target.name, []).append(target if target is atom else RuleAtom(target.name, tuple(Var("_") for _ in target.args)))
    for name, atoms in uses.items():
        rs = rules.get(name, [])
        if len(atoms) != 1 or not rs or any(h.aggr for r in rs for h in r.head) or any(r.body is None for r in rs):
            continue
        own = [(r, a) for r in rs for d in disjuncts(r.body) for a in d if isinstance(a, RuleAtom) and a.name == name]
        hidden = any(isinstance(a, Not) and isinstance(a.atom, RuleAtom) and a.atom.name == name for r in rs for d in disjuncts(r.body) for a in d)
        if not own or hidden:
            continue
        for k, arg in enumerate(atoms[0].args):
            if isinstance(arg, Lit) and all(len(a.args) > k and isinstance(a.args[k], Var) and a.args[k].name == r.head[k].var for r, a in own):
                out[name] = [replace(r, body=And((*r.body.parts, Cond(Call("eq", (Var(r.head[k].var), arg)))))) for r in out[name]]
    return out
