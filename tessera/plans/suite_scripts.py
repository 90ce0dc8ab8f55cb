"""Registered scripts: writes, time, catalog, readers, streams, search and graph rules, with their SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, functions as F

from tessera.errors import Refusal
from tessera.plans import suite
from tessera.sources import files
from tessera.streaming import standing

_NATIONS = "?[k, n, g] := *nation{n_nationkey: k, n_name: n, n_regionkey: g}"
_CREATE = f"{_NATIONS} :create land {{k: Int => n: String, g: Int}}"


def script(name: str, steps: list[str], sql: str | None, columns: list[str], params: dict | None = None) -> None:
    """Register scripts over the attached tables; the last one gives the result."""
    def run(spark, sf_dir):
        db = suite.database(spark, sf_dir, ["nation", "region", "supplier"])
        for step in steps[:-1]:
            db.run(step)
        return db.run(steps[-1], params).toDF(*columns)

    suite.add(name, sql, run)


def refused(name: str, before: list[str], cases: list[str]) -> None:
    """Register scripts that must be refused and leave no trace."""
    def run(spark, sf_dir):
        db, out = suite.database(spark, sf_dir, ["nation", "region", "supplier"]), []
        for step in before:
            db.run(step)
        for i, step in enumerate(cases):
            try:
                db.run(step).collect()
                out.append((i, False))
            except Refusal:
                out.append((i, True))
        return spark.createDataFrame(out, "i long, refused boolean")

    suite.add(name, f"SELECT i, true AS refused FROM range({len(cases)}) t(i)", run)


def _land(extra: str = "") -> str:
    return f"SELECT n_nationkey::BIGINT AS k, n_name AS n, n_regionkey::BIGINT AS g FROM nation{extra}"


_READ = "?[k, n, g] := *land{k, n, g}"
script("create_and_read", [_CREATE, _READ], _land(), ["k", "n", "g"])
script("put_overwrites", [_CREATE, "?[k, n, g] := *land{k, g}, k < 5, n = 'changed' :put land {k => n, g}", _READ],
       f"SELECT k, CASE WHEN k < 5 THEN 'changed' ELSE n END AS n, g FROM ({_land()})", ["k", "n", "g"])
script("remove_rows", [_CREATE, "?[k] := *land{k, g: 1}; ?[k] <- [[777]] :rm land {k}", _READ], _land(" WHERE n_regionkey <> 1"), ["k", "n", "g"])
script("replace_rows", [_CREATE, f"{_NATIONS}, k > 20 :replace land {{k => n, g}}", _READ], _land(" WHERE n_nationkey > 20"), ["k", "n", "g"])
script("insert_rows", [_CREATE, "?[k, n, g] <- [[100, 'new', 9]] :insert land {k => n, g}", _READ], f"{_land()} UNION ALL SELECT 100, 'new', 9", ["k", "n", "g"])
script("update_rows", [_CREATE, "?[k, g] := *land{k}, k < 3, g = 50 :update land {k => g}", _READ], f"SELECT k, n, CASE WHEN k < 3 THEN 50 ELSE g END AS g FROM ({_land()})", ["k", "n", "g"])
script("delete_rows", [_CREATE, "?[k] := *land{k}, k >= 20 :delete land {k}", _READ], _land(" WHERE n_nationkey < 20"), ["k", "n", "g"])
script("ensured_rows", [_CREATE, f"{_NATIONS}, k < 4 :ensure land {{k => n, g}}", "?[k] <- [[500]] :ensure_not land {k}", _READ], _land(), ["k", "n", "g"])
script("returned_rows", [_CREATE, "?[k, n, g] <- [[1, 'x', 1], [200, 'y', 2]] :put land {k => n, g} :returning"],
       "SELECT * FROM (VALUES (1::BIGINT, 'x', 1::BIGINT, 'inserted'), (200, 'y', 2, 'inserted')) t(k, n, g, kind)", ["k", "n", "g", "kind"])
script("timed_writes", [":create past {k: Int => v: String}", "?[k, v] := *nation{n_nationkey: k}, v = 'a' :put past {k => v} @ 100", "?[k, v] := *nation{n_nationkey: k}, k < 9, v = 'b' :put past {k => v} @ 200",
                        "?[k, v] := *nation{n_nationkey: k}, k < 3, v = 'late' :put past {k => v} @ 150", "?[k, v, w] := *past{k, v @ 160}, *past{k, v: w @ 250}"],
       "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey < 3 THEN 'late' ELSE 'a' END AS v, CASE WHEN n_nationkey < 9 THEN 'b' ELSE 'a' END AS w FROM nation", ["k", "v", "w"])
script("triggers", [":create log {k: Int => v: Int}", ":create source {k: Int => v: Int}", "::set_triggers source on put { ?[k, v] := _new[k, w], v = w * 10 :put log {k => v} }",
                    "?[k, v] := *nation{n_nationkey: k, n_regionkey: v} :put source {k => v}", "?[k, v] := *log{k, v}"], "SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT * 10 AS v FROM nation", ["k", "v"])
script("catalog_commands", [_CREATE, "::describe land 'nations'", "::rename land -> country", "::access_level protected country", "?[k, n, g] := *country{k, n, g}"], _land(), ["k", "n", "g"])
script("compacted", [_CREATE, "?[k] := *land{k, g: 1} :rm land {k}", "::compact", _READ], _land(" WHERE n_regionkey <> 1"), ["k", "n", "g"])
script("columns_of_a_relation", [_CREATE, "::columns land"], "SELECT * FROM (VALUES ('k', true, 0::INTEGER, 'Int'), ('n', false, 1, 'String'), ('g', false, 2, 'Int')) t(a, b, c, d)", ["a", "b", "c", "d"])
script("verified_program", [_CREATE, "::verify { t[a, b] := *land{k: a, g: b}; t[a, c] := t[a, b], *land{k: b, g: c}; ?[a, b] := t[a, b] }"],
       "WITH RECURSIVE t(a, b) AS (SELECT n_nationkey, n_regionkey FROM nation UNION SELECT t.a, n_regionkey FROM t JOIN nation ON n_nationkey = t.b) SELECT 'match' AS status, CAST(count(*) AS VARCHAR) AS message FROM t", ["status", "message"])
script("unit_relation", ["u[] <- [[]]; ?[k] := u[], *nation{n_nationkey: k}"], "SELECT n_nationkey::BIGINT AS k FROM nation", ["k"])
script("nested_negation", ["a[k] := *nation{n_nationkey: k, n_regionkey: g}, not (g == 1 or (k > 10, g < 3)); ?[k] := a[k]"], "SELECT n_nationkey::BIGINT AS k FROM nation WHERE NOT (n_regionkey = 1 OR (n_nationkey > 10 AND n_regionkey < 3))", ["k"])
script("repeated_variable", ["?[k] := *nation{n_nationkey: k, n_regionkey: k}"], "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey = n_regionkey", ["k"])
script("ignored_variables", ["a[k, g, n] := *nation{n_nationkey: k, n_regionkey: g, n_name: n}; ?[g] := a[_, g, _]"], "SELECT DISTINCT n_regionkey::BIGINT AS g FROM nation", ["g"])
script("options_and_parameters", ["?[k] := *nation{n_nationkey: k}, k < $most :timeout 120 :assert some"], "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey < 7", ["k"], {"most": 7})
script("no_magic", ["t[a, b] := *nation{n_nationkey: a, n_regionkey: b}; t[a, c] := t[a, b], *nation{n_nationkey: b, n_regionkey: c}; ?[b] := t[7, b] :disable_magic_rewrite true"],
       "WITH RECURSIVE t(b) AS (SELECT n_regionkey FROM nation WHERE n_nationkey = 7 UNION SELECT n_regionkey FROM t JOIN nation ON n_nationkey = t.b) SELECT b::BIGINT AS b FROM t", ["b"])
script("csv_reader", ["?[i, x, y] <~ CsvReader(content: 'x,y\\n1,a\\n2,b\\n3,c', types: ['Int', 'String'], prepend_index: true)"], "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 'a'), (1, 2, 'b'), (2, 3, 'c')) t(i, x, y)", ["i", "x", "y"])
script("json_reader", ["?[a, b] <~ JsonReader(content: '{\"a\": 1, \"b\": \"x\"}\\n{\"a\": 2}', fields: ['a', 'b'], null_if_absent: true)"], "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2, NULL)) t(a, b)", ["a", "b"])
script("constant_rule", ["?[a, b] <~ Constant(data: [[1, 'x'], [2, 'y']])"], "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2, 'y')) t(a, b)", ["a", "b"])
refused("refused_writes", [_CREATE, "::constraint create few { ?[k] := *land{k}, k > 900 }"],
        ["?[k, n, g] <- [[1, 'x', 1]] :insert land {k => n, g}", "?[k] <- [[888]] :delete land {k}", "?[k, g] <- [[888, 1]] :update land {k => g}", "?[k, n, g] <- [[1, 'zz', 1]] :ensure land {k => n, g}", "?[k] <- [[1]] :ensure_not land {k}",
         _CREATE, "?[k, n, g] <- [[901, 'x', 1]] :put land {k => n, g}", "?[k, x] <- [[1, 2]] :put land {k => x}"])
refused("refused_programs", [], ["?[x] := *nowhere{x}", "?[x] := a[x]; a[x] := *nation{n_nationkey: x}, not a[x]", "?[f(x)] := *nation{n_nationkey: x}", "?[x, choice_rand(n)] := *nation{n_nationkey: x, n_name: n}", "?[x] := not *nation{n_nationkey: x}"])


def _system_time(spark, sf_dir) -> DataFrame:
    db = suite.database(spark, sf_dir, ["nation"])
    db.run(":create fact {k: Int => v: String}")
    db.run("?[k, v] := *nation{n_nationkey: k}, v = 'wrong' :put fact {k => v} @ 100")
    before = db.clock
    db.run("?[k, v] := *nation{n_nationkey: k}, k < 5, v = 'right' :put fact {k => v} @ 100")
    return db.run(f"?[k, v, s] := *fact{{k, v @delta_sys({before}, {db.clock}) s}}; ?[k, v, s] := *fact{{k, v @ {before}, 100}}, k > 20, s = 0")


suite.add("system_time", "SELECT n_nationkey::BIGINT AS k, 'right' AS v, 1::BIGINT AS s FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, 'wrong', -1 FROM nation WHERE n_nationkey < 5 "
          "UNION ALL SELECT n_nationkey, 'wrong', 0 FROM nation WHERE n_nationkey > 20", _system_time)


def _changes(spark, sf_dir) -> DataFrame:
    """What callbacks, a standing query and a change feed see of three writes."""
    db, seen, out = suite.database(spark, sf_dir, ["nation"]), [], []
    db.run(_CREATE)
    feed, folder = [], tempfile.mkdtemp(prefix="feed-")
    query = standing.Standing(db, "?[g, count(k)] := *land{k, g}")
    query.apply_pending()
    db.register_callback("land", lambda op, new, old: seen.append((op, new.count(), old.count())))
    for step in ("?[k, n, g] <- [[100, 'x', 0], [101, 'y', 9]] :put land {k => n, g}", "?[k] <- [[100]] :rm land {k}"):
        db.run(step)
        out += [("standing", int(r[0]), int(r[1]), int(r[2])) for r in query.apply_pending().collect()]
    standing.change_feed(db, "land", lambda df, n: feed.append(df.groupBy("_op").count().collect()), folder).awaitTermination(60)
    counts: dict = {}
    for part in feed:
        for r in part:
            counts[r["_op"]] = counts.get(r["_op"], 0) + r["count"]
    out += [(f"callback {op}", new, old, i) for i, (op, new, old) in enumerate(seen)] + [(f"feed {op}", n, 0, 0) for op, n in counts.items()]
    return spark.createDataFrame(out, "what string, a long, b long, c long")


suite.add("change_streams", "WITH z AS (SELECT count(*) AS n FROM nation WHERE n_regionkey = 0) SELECT 'standing' AS what, 0::BIGINT AS a, n AS b, -1::BIGINT AS c FROM z UNION ALL SELECT 'standing', 0, n + 1, 1 FROM z UNION ALL SELECT 'standing', 9, 1, 1 "
          "UNION ALL SELECT 'standing', 0, n + 1, -1 FROM z UNION ALL SELECT 'standing', 0, n, 1 FROM z UNION ALL SELECT 'callback put', 2, 0, 0 UNION ALL SELECT 'callback rm', 1, 1, 1 "
          "UNION ALL SELECT 'feed assert', count(*) + 2, 0, 0 FROM nation UNION ALL SELECT 'feed retract', 1, 0, 0", _changes)


def _stored_forms(spark, sf_dir) -> DataFrame:
    """Backup and restore, and results as Arrow and as an envelope, read back."""
    from tessera.plans.database import Database

    db, folder = suite.database(spark, sf_dir, ["nation"]), tempfile.mkdtemp(prefix="backup-")
    db.run(_CREATE)
    db.backup(f"{folder}/b")
    other = Database(spark)
    other.restore(f"{folder}/b")
    back = other.run(_READ)
    arrow, envelope = files.to_arrow(back), files.envelope(back)
    return spark.createDataFrame([(r["k"], r["n"], e[2]) for r, e in zip(sorted(arrow.to_pylist(), key=lambda r: r["k"]), sorted(envelope["rows"]))], "k long, n string, g long")


suite.add("stored_forms", _land(), _stored_forms)


def _counts(spark, sf_dir) -> DataFrame:
    out = suite.database(spark, sf_dir, ["orders"]).run("?[s, group_count(p)] := *orders{o_orderkey: k, o_orderstatus: s, o_orderpriority: p}").toDF("s", "l")
    return out.select("s", F.explode("l").alias("x")).select("s", F.col("x.value").alias("v"), F.col("x.count").alias("c"))


suite.add("counts_per_value", "SELECT o_orderstatus AS s, o_orderpriority AS v, count(*) AS c FROM orders GROUP BY 1, 2", _counts)

# --- search -----------------------------------------------------------------


def search(name: str, create: list[str], read: str, sql: str | None, columns: list[str], rows: str = "documents") -> None:
    def run(spark, sf_dir):
        db = suite.database(spark, sf_dir, [])
        t = spark.read.parquet(f"{sf_dir}/{rows}.parquet")
        db.attach("rows", t, ["doc_id" if rows == "documents" else "vec_id" if rows == "embeddings" else "p_partkey"])
        for step in create:
            db.run(step)
        return db.run(read).toDF(*columns)

    suite.add(name, sql, run)


_WORDS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), lambda x: x = '{}')"
search("index_full_text", ["::fts create rows:txt {extractor: p_type, tokenizer: Simple, filters: [Lowercase]}"], "?[k] := ~rows:txt{p_partkey: k | query: 'economy OR promo'}",
       "SELECT p_partkey AS k FROM part WHERE regexp_matches(lower(p_type), '(^|[^a-z0-9])(economy|promo)($|[^a-z0-9])')", ["k"], "part")
search("index_full_text_not", ["::fts create rows:txt {extractor: p_name, tokenizer: Simple, filters: [Lowercase]}"], "?[k] := ~rows:txt{p_partkey: k | query: 'widget NOT cold'}",
       "SELECT p_partkey AS k FROM part WHERE list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'widget') AND NOT list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'cold')", ["k"], "part")
search("index_vectors", ["::hnsw create rows:vec {dim: 64, fields: [embedding], distance: L2}"], "q[v] := *rows{vec_id: 3, embedding: v}; ?[k, b] := q[v], ~rows:vec{vec_id: k | query: v, k: 5, bind_distance: d}, b = round(d * 1000.0)",
       "SELECT k, round(d * 1000) AS b FROM (SELECT y.vec_id AS k, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS d FROM embeddings x, embeddings y WHERE x.vec_id = 3 ORDER BY d, k LIMIT 5)", ["k", "b"], "embeddings")
search("index_near_duplicates", ["::lsh create rows:dup {extractor: p_type, tokenizer: Simple, n_gram: 1, target_threshold: 0.9}"], "q[t] := *rows{p_partkey: 1, p_type: t}; ?[k] := q[t], ~rows:dup{p_partkey: k | query: t}, *rows{p_partkey: k, p_type: t}",
       "SELECT y.p_partkey AS k FROM part x JOIN part y ON x.p_type = y.p_type WHERE x.p_partkey = 1", ["k"], "part")


def _places(spark, sf_dir) -> DataFrame:
    from tessera.operators import search as s

    p = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (F.col("s_acctbal") / 200).alias("lat"), ((F.col("s_suppkey") * 37) % 360 - 180).cast("double").alias("lon"))
    near = s.nearest_places(p, "lat", "lon", (10.0, 20.0), 4, []).select("s_suppkey", F.lit("near").alias("what"))
    return near.unionByName(s.within_box(p, "lat", "lon", 0.0, -90.0, 50.0, 90.0).select("s_suppkey", F.lit("box").alias("what")))


suite.add("places", "WITH p AS (SELECT s_suppkey, s_acctbal / 200 AS lat, ((s_suppkey * 37) % 360 - 180)::DOUBLE AS lon FROM supplier), d AS (SELECT *, 2 * asin(sqrt(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(lon - 20) / 2), 2))) AS d FROM p) "
          "SELECT s_suppkey, what FROM (SELECT s_suppkey, 'near' AS what FROM d ORDER BY d, s_suppkey LIMIT 4) UNION ALL SELECT s_suppkey, 'box' FROM p WHERE lat BETWEEN 0 AND 50 AND lon BETWEEN -90 AND 90", _places)


def _tokens(spark, sf_dir) -> DataFrame:
    from tessera.operators import search as s

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    forms = {"raw": ("Raw", [], []), "white": ("Whitespace", [], []), "simple": ("Simple", ["Lowercase"], []), "gram": ("NGram", [], [2]), "short": ("Simple", [["RemoveLong", 5]], []), "fold": ("Simple", ["AsciiFolding", "AlphaNumOnly"], []),
             "stop": ("Simple", ["Lowercase", ["Stopwords", ["cold"]]], []), "stem": ("Simple", ["Lowercase", ["Stemmer", "english"]], []), "split": ("Simple", ["Lowercase", ["SplitCompoundWords", ["wid", "get"]]], [])}
    return p.select("p_partkey", *[F.concat_ws("|", s.tokens(F.col("p_name"), *f)).alias(n) for n, f in forms.items()])


suite.add("tokenizers", """WITH t AS (SELECT p_partkey, p_name, regexp_extract_all(p_name, '[A-Za-z0-9]+') AS w FROM part)
    SELECT p_partkey, p_name AS raw, array_to_string(regexp_extract_all(p_name, '\\S+'), '|') AS white, lower(array_to_string(w, '|')) AS simple,
      array_to_string(list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2)), '|') AS gram, coalesce(array_to_string(list_filter(w, lambda x: length(x) < 5), '|'), '') AS short, array_to_string(w, '|') AS fold,
      coalesce(array_to_string(list_filter(list_transform(w, lambda x: lower(x)), lambda x: x <> 'cold'), '|'), '') AS stop, lower(array_to_string(w, '|')) AS stem, replace(lower(array_to_string(w, '|')), 'widget', 'wid|get') AS split FROM t""", _tokens)

# --- graph rules ------------------------------------------------------------

#: Nations in a ring, region cliques, and regions as a chain.
_RING = "e[a, b] := *nation{n_nationkey: a}, b = (a + 1) % 25;"
_CLIQUES = "e[a, b] := *nation{n_nationkey: a, n_regionkey: g}, *nation{n_nationkey: b, n_regionkey: g}, a < b;"
_N = "n_nationkey::BIGINT"
_BOTH = "e[a, b, w] := *nation{n_nationkey: a}, b = (a + 1) % 25, w = 1.0; e[a, b, w] := *nation{n_nationkey: b}, a = (b + 1) % 25, w = 1.0;"
_GROUPS = f"SELECT {_N} AS n, min({_N}) OVER (PARTITION BY n_regionkey) AS c FROM nation"


def graph(name: str, text: str, sql: str, columns: list[str]) -> None:
    suite.program(name, text, sql, columns)


def grouped(name: str, text: str, sql: str) -> None:
    """A rule that gives each node a group: the group is told by its smallest node."""
    def run(spark, sf_dir):
        from pyspark.sql import Window

        got = suite.database(spark, sf_dir, ["nation", "customer"]).run(text).toDF("n", "l")
        return got.select("n", F.min("n").over(Window.partitionBy("l")).alias("c"))

    suite.add(name, sql, run)


grouped("strong_components", "e[a, b] := *nation{n_nationkey: a}, b = (a + 5) % 25; e[a, b] := *nation{n_nationkey: a}, a < 5, b = 25 + a; ?[n, c] <~ StronglyConnectedComponents(e[])",
        f"SELECT {_N} AS n, {_N} % 5 AS c FROM nation UNION ALL SELECT 25 + {_N}, 25 + {_N} FROM nation WHERE n_nationkey < 5")
grouped("communities", f"{_CLIQUES} ?[n, l] := c[l0, n], l = first(l0); c[l, n] <~ CommunityDetectionLouvain(e[], undirected: true)", _GROUPS)
grouped("label_propagation", f"{_CLIQUES} ?[n, l] := c[l, n]; c[l, n] <~ LabelPropagation(e[])", _GROUPS)
grouped("connected_components", "e[a, b] := *customer{c_custkey: c, c_nationkey: k}, a = c + 1000, b = k; e[a, b] := *nation{n_nationkey: a, n_regionkey: g}, b = 0 - 1 - g; ?[n, c] <~ ConnectedComponents(e[])",
        "WITH u AS (SELECT c_custkey + 1000 AS n, n_regionkey AS g FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT n_nationkey, n_regionkey FROM nation UNION SELECT -1 - n_regionkey, n_regionkey FROM nation) SELECT n, (-1 - g)::BIGINT AS c FROM u")
graph("k_core", "e[a, b] := *customer{c_custkey: c, c_nationkey: b}, a = c + 1000; e[a, b] := *nation{n_nationkey: a, n_regionkey: g}, *nation{n_nationkey: b, n_regionkey: g}, a < b; ?[n, core] <~ KCoreDecomposition(e[])",
      f"SELECT c_custkey + 1000 AS n, 1::BIGINT AS core FROM customer UNION ALL SELECT {_N}, count(*) OVER (PARTITION BY n_regionkey) - 1 FROM nation", ["n", "core"])
graph("clustering", "e[a, b] := *customer{c_custkey: c, c_nationkey: b}, c < 300, a = c + 1000; e[a, b] := *nation{n_nationkey: a, n_regionkey: g}, *nation{n_nationkey: b, n_regionkey: g}, a < b; ?[n, k, t, d] <~ ClusteringCoefficients(e[])",
      f"""WITH e AS (SELECT c_custkey + 1000 AS a, c_nationkey::BIGINT AS b FROM customer WHERE c_custkey < 300 UNION SELECT x.n_nationkey, y.n_nationkey FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_nationkey < y.n_nationkey),
          u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), d AS (SELECT a AS n, count(*) AS d FROM u GROUP BY 1),
          t AS (SELECT x.a AS n, count(*) AS t FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY 1)
          SELECT n, CASE WHEN d < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (d * (d - 1)) END::DOUBLE AS k, coalesce(t, 0) AS t, d FROM d LEFT JOIN t USING (n)""", ["n", "k", "t", "d"])
graph("top_sort", "e[a, b] := *region{r_regionkey: a}, *region{r_regionkey: b}, a < b; ?[i, n] <~ TopSort(e[])", "SELECT r_regionkey::BIGINT AS i, r_regionkey::BIGINT AS n FROM region", ["i", "n"])
graph("closeness", f"{_RING} c[n, s] <~ ClosenessCentrality(e[], undirected: true); ?[n, s] := c[n, x], s = round(x * 1000000.0)", f"SELECT {_N} AS n, round(625.0::DOUBLE / 156 / 24 * 1000000) AS s FROM nation", ["n", "s"])
graph("betweenness", f"{_RING} ?[n, s] <~ BetweennessCentrality(e[], undirected: true)", f"SELECT {_N} AS n, 132.0::DOUBLE AS s FROM nation", ["n", "s"])
graph("shortest_by_steps", f"{_RING} s[x] <- [[0]]; t[x] := *nation{{n_nationkey: x}}, x > 0; p[a, b, l] <~ ShortestPathBFS(e[], s[], t[]); ?[b, n, z] := p[a, b, l], n = length(l), z = last(l)",
      f"SELECT {_N} AS b, {_N} + 1 AS n, {_N} AS z FROM nation WHERE n_nationkey > 0", ["b", "n", "z"])
graph("shortest_by_cost", f"{_BOTH} s[x] <- [[0]]; p[a, b, c, l] <~ ShortestPathDijkstra(e[], s[]); ?[b, c] := p[a, b, c, l], b > 0", f"SELECT {_N} AS b, least(n_nationkey, 25 - n_nationkey)::DOUBLE AS c FROM nation WHERE n_nationkey > 0", ["b", "c"])
graph("shortest_by_estimate", f"{_BOTH} n[x] := *nation{{n_nationkey: x}}; s[x] <- [[0]]; t[x] <- [[7]]; p[a, b, c, l] <~ ShortestPathAStar(e[], n[], s[], t[]); ?[b, c, n] := p[a, b, c, l], n = length(l)", "SELECT 7::BIGINT AS b, 7.0::DOUBLE AS c, 8::BIGINT AS n", ["b", "c", "n"])
graph("k_shortest", f"{_BOTH} s[x] <- [[0]]; t[x] <- [[7]]; p[a, b, c, l] <~ KShortestPathYen(e[], s[], t[], k: 2); ?[c, n] := p[a, b, c, l], n = length(l)", "SELECT * FROM (VALUES (7.0::DOUBLE, 8::BIGINT), (18.0, 19)) t(c, n)", ["c", "n"])
graph("spanning_tree", f"e[a, b, w] := *nation{{n_nationkey: a}}, b = (a + 1) % 25, w = a + 1.0; s[x] <- [[0]]; p[a, b, w] <~ MinimumSpanningTreePrim(e[], s[]); ?[count(w), sum(w)] := p[a, b, w]", "SELECT 24::BIGINT AS n, 300.0::DOUBLE AS w", ["n", "w"])
graph("max_flow", "e[a, b, w] := *nation{n_nationkey: k}, a = 100, b = k, w = k + 1.0; e[a, b, w] := *nation{n_nationkey: a}, b = 101, w = 25.0 - a; s[x] <- [[100]]; t[x] <- [[101]]; f[a, b, w] <~ MaxFlow(e[], s[], t[]); ?[sum(w)] := f[a, b, w]",
      "SELECT sum(least(n_nationkey + 1, 25 - n_nationkey))::DOUBLE AS f FROM nation", ["f"])
graph("cliques", f"{_CLIQUES} c[k, n] <~ MaximalCliques(e[]); g[k, min(n), count(n)] := c[k, n]; ?[m, z] := g[k, m, z]", f"SELECT min({_N}) AS m, count(*) AS z FROM nation GROUP BY n_regionkey", ["m", "z"])
graph("walks", f"{_RING} n[x] := *nation{{n_nationkey: x}}; s[x] <- [[0], [9]]; w[i, s, p] <~ RandomWalk(e[], n[], s[], steps: 5, iterations: 1, seed: 1); ?[s, z, n] := w[i, s, p], z = last(p), n = length(p)", "SELECT * FROM (VALUES (0::BIGINT, 5::BIGINT, 6::BIGINT), (9, 14, 6)) t(s, z, n)", ["s", "z", "n"])
graph("first_found_in_breadth", f"{_RING} n[x] := *nation{{n_nationkey: x}}; s[x] <- [[0]]; w[s, f, p] <~ BFS(e[], n[x], s[], condition: x == 3); ?[s, f, n] := w[s, f, p], n = length(p)", "SELECT 0::BIGINT AS s, 3::BIGINT AS f, 4::BIGINT AS n", ["s", "f", "n"])
graph("first_found_in_depth", f"{_RING} n[x] := *nation{{n_nationkey: x}}; s[x] <- [[0]]; w[s, f, p] <~ DFS(e[], n[x], s[], condition: x == 3); ?[s, f, n] := w[s, f, p], n = length(p)", "SELECT 0::BIGINT AS s, 3::BIGINT AS f, 4::BIGINT AS n", ["s", "f", "n"])
