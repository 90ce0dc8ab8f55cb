"""Registered rule programs over the test tables, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators import graph, search
from tessera.plans.database import Database

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
        "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"]}


def database(spark, sf_dir: str, names=TABLES) -> Database:
    """The test tables as read-only relations; scans stay lazy and prunable."""
    db = Database(spark)
    for n in names:
        db.attach(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), KEYS.get(n))
    return db


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(name: str, sql: str | None, f) -> None:
    f.__name__ = name
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


def program(name: str, text: str, sql: str, columns: list[str], tables: list[str] | None = None) -> None:
    """Register a program; its result columns get portable names."""
    def run(spark, sf_dir):
        import re

        used = tables or [t for t in TABLES if re.search(rf"\*{t}\b", text)]
        return database(spark, sf_dir, used).run(text).toDF(*columns)

    add(name, sql, run)


program("join_group_count", "?[n_name, count(c)] := *customer{c_custkey: c, c_nationkey: k}, *nation{n_nationkey: k, n_name}",
        "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", ["n_name", "customers"])
program("filter_project", "?[o_orderkey, o_totalprice] := *orders{o_orderkey, o_totalprice, o_orderstatus: 'F'}, o_totalprice > 100000.0",
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000", ["o_orderkey", "o_totalprice"])
program("set_semantics", "?[s, p] := *orders{o_orderstatus: s, o_orderpriority: p}", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders", ["s", "p"])
program("positional_scan", "?[b, a] := *region[a, b]", "SELECT r_name AS b, CAST(r_regionkey AS BIGINT) AS a FROM region", ["b", "a"])
program("three_way_join", "?[r, count(s), sum(b)] := *supplier{s_suppkey: s, s_nationkey: k, s_acctbal}, *nation{n_nationkey: k, n_regionkey: g}, *region{r_regionkey: g, r_name: r}, b = round(s_acctbal)",
        "SELECT r_name AS r, count(*) AS n, sum(round(s_acctbal)) AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", ["r", "n", "b"])
program("cross_product", "?[a, b] := *region{r_regionkey: a}, *nation{n_nationkey: b}", "SELECT CAST(r_regionkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b FROM region, nation", ["a", "b"])
program("anti_join", "?[c] := *customer{c_custkey: c}, not *orders{o_custkey: c, o_orderstatus: 'P'}", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", ["c"])
program("semi_join", "?[c, name] := *customer{c_custkey: c, c_name: name}, *orders{o_custkey: c, o_orderstatus: 'P'}",
        "SELECT c_custkey AS c, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", ["c", "name"])
program("theta_join", "?[a, b] := *nation{n_nationkey: a, n_regionkey: r}, *nation{n_nationkey: b, n_regionkey: r}, a < b",
        "SELECT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey", ["a", "b"])
program("disjunction", "?[k] := *customer{c_custkey: k, c_mktsegment: m, c_acctbal: b}, (m == 'BUILDING' or b < 0.0)",
        "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0", ["k"])
program("union_rules", "a[k] := *customer{c_nationkey: k}; a[k] := *supplier{s_nationkey: k}; ?[k] := a[k]",
        "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier", ["k"])
program("intersect_rules", "a[k] := *customer{c_nationkey: k}; b[k] := *supplier{s_nationkey: k}; ?[k] := a[k], b[k]",
        "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier", ["k"])
program("except_rules", "a[k] := *nation{n_nationkey: k}; b[k] := *supplier{s_nationkey: k, s_acctbal: x}, x > 8000.0; ?[k] := a[k], not b[k]",
        "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation EXCEPT SELECT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_acctbal > 8000", ["k"])
program("const_join", "w[k] <- [[1], [3], [7]] ?[k, n] := w[k], *nation{n_nationkey: k, n_name: n}", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n FROM nation WHERE n_nationkey IN (1, 3, 7)", ["k", "n"])
program("unify_explode", "?[k, x] := *nation{n_nationkey: k}, x in int_range(k)", "SELECT CAST(n_nationkey AS BIGINT) AS k, x FROM nation, range(25) t(x) WHERE x < n_nationkey", ["k", "x"])
program("top_k", "?[p, k] := *orders{o_orderkey: k, o_totalprice: p} :order -p, k :limit 10", "SELECT o_totalprice AS p, o_orderkey AS k FROM orders ORDER BY 1 DESC, 2 LIMIT 10", ["p", "k"])
program("limit_offset", "?[k] := *customer{c_custkey: k} :order k :offset 5 :limit 7", "SELECT c_custkey AS k FROM customer ORDER BY 1 LIMIT 7 OFFSET 5", ["k"])
program("rank_rows", "a[k, b] := *supplier{s_suppkey: k, s_acctbal: b} ?[r, k, b] <~ ReorderSort(a[], sort_by: [1], descending: true)",
        "SELECT rank() OVER (ORDER BY s_acctbal DESC) AS r, s_suppkey AS k, s_acctbal AS b FROM supplier", ["r", "k", "b"])
program("aggregates_numeric", "?[f, count(q), sum(qi), mean(q), min(q), max(q), variance(q), std_dev(q)] := *lineitem{l_returnflag: f, l_quantity: q, l_orderkey, l_linenumber}, qi = to_int(q)",
        "SELECT l_returnflag AS f, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, round(avg(l_quantity), 6) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi, round(var_samp(l_quantity), 6) AS v, round(stddev_samp(l_quantity), 6) AS d FROM lineitem GROUP BY 1",
        ["f", "n", "s", "m", "lo", "hi", "v", "d"])
_plain = QUERIES["aggregates_numeric"]
add("aggregates_numeric", ORACLE_SQL["aggregates_numeric"], lambda spark, sf: _plain(spark, sf).select("f", "n", "s", *[F.round(c, 6).alias(c) for c in ("m",)], "lo", "hi", *[F.round(c, 6).alias(c) for c in ("v", "d")]))
program("aggregates_distinct", "?[s, count_unique(c), and(t), or(t)] := *orders{o_orderstatus: s, o_custkey: c, o_totalprice: p}, t = p > 1000.0",
        "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS c, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 1000) AS o FROM orders GROUP BY 1", ["s", "c", "a", "o"])
program("aggregates_lists", "g[r, unique(n)] := *nation{n_regionkey: r, n_name: n} h[r, collect(n, 3)] := *nation{n_regionkey: r, n_name: n} ?[r, u, c] := g[r, x], h[r, y], u = from_substrings(x), c = length(y)",
        "SELECT CAST(n_regionkey AS BIGINT) AS r, string_agg(n_name, '' ORDER BY n_name) AS u, CAST(least(3, count(*)) AS BIGINT) AS c FROM nation GROUP BY 1", ["r", "u", "c"])
program("smallest_by", "?[s, smallest_by(p)] := *orders{o_orderstatus: s, o_orderkey: k}, p = [k, 0 - k]", "SELECT o_orderstatus AS s, max(o_orderkey) AS k FROM orders GROUP BY 1", ["s", "k"])
program("empty_aggregate", "?[count(k), min(k)] := *nation{n_nationkey: k}, k > 1000", "SELECT count(*) AS n, CAST(min(n_nationkey) AS BIGINT) AS m FROM nation WHERE n_nationkey > 1000", ["n", "m"])
program("quantile", "?[f, quantile(q, 0.5)] := *lineitem{l_returnflag: f, l_quantity: q, l_orderkey, l_linenumber}", "SELECT l_returnflag AS f, quantile_disc(l_quantity, 0.5) AS q FROM lineitem GROUP BY 1", ["f", "q"])
_SHARED = "m[p, s] := *lineitem{l_partkey: p, l_suppkey: s0}, s = -1 - s0; e[a, b] := m[a, b]; e[b, a] := m[a, b]"
_SHARED_SQL = "m AS (SELECT DISTINCT l_partkey AS p, -1 - l_suppkey AS s FROM lineitem), e(a, b) AS (SELECT p, s FROM m UNION SELECT s, p FROM m)"
program("reachable", f"{_SHARED}; r[x] := e[-2, x]; r[y] := r[x], e[x, y]; ?[x] := r[x]",
        f"WITH RECURSIVE {_SHARED_SQL}, r(x) AS (SELECT b FROM e WHERE a = -2 UNION SELECT e.b FROM r JOIN e ON e.a = r.x) SELECT x FROM r", ["x"])
program("transitive_closure", "e[a, b] := *nation{n_nationkey: a, n_regionkey: r}, b = (a * 3 + r) % 25; t[a, b] := e[a, b]; t[a, c] := t[a, b], e[b, c]; ?[a, b] := t[a, b]",
        "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey * 3 + n_regionkey) % 25 AS BIGINT) AS b FROM nation), t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t", ["a", "b"])
program("same_generation", "p[c, q] := *nation{n_nationkey: c}, c > 0, q = to_int(floor((c - 1) / 2)); s[x, y] := p[x, q], p[y, q]; s[x, y] := p[x, a], s[a, b], p[y, b]; ?[x, y] := s[x, y], x < y",
        "WITH RECURSIVE p AS (SELECT CAST(n_nationkey AS BIGINT) AS c, CAST((n_nationkey - 1) // 2 AS BIGINT) AS q FROM nation WHERE n_nationkey > 0), s(x, y) AS (SELECT a.c, b.c FROM p a JOIN p b ON a.q = b.q UNION SELECT a.c, b.c FROM s JOIN p a ON a.q = s.x JOIN p b ON b.q = s.y) SELECT x, y FROM s WHERE x < y", ["x", "y"])
program("mutual_recursion", "ev[x] <- [[0]]; od[y] := ev[x], x < 20, y = x + 1; ev[y] := od[x], x < 20, y = x + 1; ?[x] := ev[x], *nation{n_nationkey: x}",
        "SELECT CAST(n_nationkey AS BIGINT) AS x FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey <= 20", ["x"])
program("cheapest_path", "e[a, b, w] := *nation{n_nationkey: a, n_regionkey: r}, b = (a * 2 + 1) % 25, w = r + 1; e[a, b, w] := *nation{n_nationkey: a}, b = (a + 7) % 25, w = 3; d[x, min(c)] := e[0, x, c]; d[y, min(c)] := d[x, c0], e[x, y, w], c = c0 + w; ?[x, c] := d[x, c]",
        "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b, n_regionkey + 1 AS w FROM nation UNION SELECT n_nationkey, (n_nationkey + 7) % 25, 3 FROM nation), d(x, c) AS (SELECT b, w FROM e WHERE a = 0 UNION SELECT e.b, d.c + e.w FROM d JOIN e ON e.a = d.x WHERE d.c < 60) SELECT CAST(x AS BIGINT) AS x, CAST(min(c) AS BIGINT) AS c FROM d GROUP BY 1", ["x", "c"])
_RARE, _RARE_SQL = _SHARED.replace("l_suppkey: s0}", "l_suppkey: s0, l_quantity: q}, q > 49.0"), _SHARED_SQL.replace("FROM lineitem)", "FROM lineitem WHERE l_quantity > 49)")
program("stratified_negation", f"{_RARE}; r[x] := e[-2, x]; r[y] := r[x], e[x, y]; ?[a] := *part{{p_partkey: a}}, not r[a]",
        f"WITH RECURSIVE {_RARE_SQL}, r(x) AS (SELECT b FROM e WHERE a = -2 UNION SELECT e.b FROM r JOIN e ON e.a = r.x) SELECT p_partkey AS a FROM part WHERE p_partkey NOT IN (SELECT x FROM r)", ["a"])
program("string_functions", "?[k, u, h, c, s, e] := *part{p_partkey: k, p_name: n, p_type: t}, u = uppercase(n), h = slice_string(n, 0, 3), c = n ++ '/' ++ t, s = starts_with(t, 'E'), e = length(t)",
        "SELECT p_partkey AS k, upper(p_name) AS u, substr(p_name, 1, 3) AS h, p_name || '/' || p_type AS c, starts_with(p_type, 'E') AS s, CAST(length(p_type) AS BIGINT) AS e FROM part", ["k", "u", "h", "c", "s", "e"])
program("regex_functions", "?[p, h, f] := *pages{page_id: p, url: u}, h = regex_extract_first(u, '//[^/]+'), f = regex_matches(u, 'fr|de')",
        "SELECT page_id AS p, regexp_extract(url, '//[^/]+') AS h, regexp_matches(url, 'fr|de') AS f FROM pages", ["p", "h", "f"])
program("math_functions", "?[k, a, b, c, d] := *supplier{s_suppkey: k, s_acctbal: x}, a = abs(x), b = round(sqrt(abs(x)) * 1000) / 1000, c = signum(x), d = floor(x) % 7",
        "SELECT s_suppkey AS k, abs(s_acctbal) AS a, round(sqrt(abs(s_acctbal)) * 1000) / 1000 AS b, CAST(sign(s_acctbal) AS DOUBLE) AS c, floor(s_acctbal) % 7 AS d FROM supplier", ["k", "a", "b", "c", "d"])
program("conditionals", "?[k, s, c] := *part{p_partkey: k, p_size: z}, s = if(z > 25, 'big', 'small'), c = cond(z < 10, 1, z < 30, 2, 3)",
        "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS s, CAST(CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS BIGINT) AS c FROM part", ["k", "s", "c"])
program("json_field", "?[e, v] := *events{event_id: e, props: p}, v = dump_json(parse_json(p) -> 'k')", "SELECT event_id AS e, json_extract_string(props, '$.k') AS v FROM events", ["e", "v"])
program("interval_join", "?[k, l] := *orders{o_orderkey: k, o_orderdate: d}, *lineitem{l_orderkey: k, l_linenumber: l, l_shipdate: s}, interval_intersects(make_interval(d, d + 2592000000000), make_interval(s, s))",
        "SELECT DISTINCT o_orderkey AS k, CAST(l_linenumber AS BIGINT) AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE epoch_us(l_shipdate) BETWEEN epoch_us(o_orderdate) AND epoch_us(o_orderdate) + 2592000000000", ["k", "l"])
program("range_join", "p[k, i] := *part{p_partkey: k, p_size: z, p_retailprice: r}, i = make_interval(to_int(r), to_int(r) + z); ?[k, s] := p[k, i], *supplier{s_suppkey: s, s_acctbal: b}, j = make_interval(to_int(b), to_int(b) + 9), interval_intersects(i, j)",
        "SELECT p_partkey AS k, s_suppkey AS s FROM part JOIN supplier ON trunc(p_retailprice)::BIGINT <= trunc(s_acctbal)::BIGINT + 9 AND trunc(s_acctbal)::BIGINT <= trunc(p_retailprice)::BIGINT + p_size", ["k", "s"])


def _events(spark, sf_dir) -> Database:
    db = Database(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    db.attach_log("hist", e.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), ["user_id"], ["event_type"], "at")
    return db


def _middle(spark, sf_dir, q: float) -> int:
    """An instant inside the data: quantile q between its first and last."""
    lo, hi = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts"), F.max("ts")).select(*[F.unix_micros(F.col(c).cast("timestamp")) for c in ("min(ts)", "max(ts)")]).first()
    return int(lo + (hi - lo) * q)


_LOG = ("WITH w AS (SELECT user_id, event_type, epoch_us(ts) AS v, row_number() OVER (PARTITION BY user_id, epoch_us(ts) ORDER BY event_type DESC) AS r FROM events), "
        "l AS (SELECT user_id, event_type, v FROM w WHERE r = 1), b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)")
_AT = "SELECT user_id, arg_max(event_type, v) AS t FROM l, b WHERE v <= CAST(trunc(lo + (hi - lo) * {q}) AS BIGINT) GROUP BY 1"
add("as_of", f"{_LOG} {_AT.format(q='0.5::DOUBLE')}", lambda spark, sf: _events(spark, sf).run(f"?[user_id, t] := *hist{{user_id, event_type: t @ {_middle(spark, sf, 0.5)}}}"))
add("current_state", f"{_LOG} SELECT user_id, arg_max(event_type, v) AS t FROM l GROUP BY 1", lambda spark, sf: _events(spark, sf).run("?[user_id, t] := *hist{user_id, event_type: t}"))
add("spans", f"{_LOG}, s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY v) AS p FROM l), c AS (SELECT * FROM s WHERE p IS DISTINCT FROM event_type) "
    "SELECT user_id AS u, event_type AS t, v AS lo, lead(v) OVER (PARTITION BY user_id ORDER BY v) - 1 AS hi FROM c",
    lambda spark, sf: _events(spark, sf).run("?[u, t, lo, hi] := *hist{user_id: u, event_type: t @spans i}, lo = interval_start(i), hi = interval_end(i)"))
add("delta", f"{_LOG}, x AS ({_AT.format(q='0.25::DOUBLE')}), y AS ({_AT.format(q='0.75::DOUBLE')}) SELECT user_id AS u, t, 1::BIGINT AS s FROM (FROM y EXCEPT FROM x) UNION ALL SELECT user_id, t, -1 FROM (FROM x EXCEPT FROM y)",
    lambda spark, sf: _events(spark, sf).run(f"?[u, t, s] := *hist{{user_id: u, event_type: t @delta({_middle(spark, sf, 0.25)}, {_middle(spark, sf, 0.75)}) s}}"))


def bipartite(spark, sf_dir) -> DataFrame:
    """Parts and suppliers that met in an order line; suppliers are numbered below zero."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return l.select(F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b")).distinct()


_BI = "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def algorithm(name: str, rule: str, columns: list[str], sql: str | None, options: dict | None = None, extra=lambda spark: []):
    add(name, sql, lambda spark, sf: graph.REGISTRY[rule](spark, [bipartite(spark, sf), *extra(spark)], options or {}).toDF(*columns))


algorithm("degree_centrality", "DegreeCentrality", ["n", "total", "o", "i"], f"{_BI} SELECT n, CAST(sum(o) + sum(i) AS BIGINT) AS total, CAST(sum(o) AS BIGINT) AS o, CAST(sum(i) AS BIGINT) AS i FROM (SELECT a AS n, 1 AS o, 0 AS i FROM e UNION ALL SELECT b, 0, 1 FROM e) GROUP BY 1")
add("components_small", """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS a, ((n_nationkey * 5 + 10) % 25)::BIGINT AS b FROM nation), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n) SELECT n, min(m) AS c FROM r GROUP BY 1""",
    lambda spark, sf: database(spark, sf, ["nation"]).run("e[a, b] := *nation{n_nationkey: a}, b = (a * 5 + 10) % 25; ?[n, c] <~ ConnectedComponents(e[])").toDF("n", "c"))
_PR = ["n AS (SELECT a AS n FROM e UNION SELECT b FROM e)", "k AS (SELECT count(*) AS k FROM n)", "l AS (SELECT e.a, e.b, 1.0::DOUBLE / d.d AS p FROM e JOIN (SELECT a, count(*) AS d FROM e GROUP BY 1) d ON d.a = e.a)",
       "s0 AS (SELECT n, 1.0::DOUBLE / k AS s FROM n, k)"] + [
    f"s{i} AS (SELECT n.n, 0.15::DOUBLE / k + 0.85::DOUBLE * coalesce(x.x, 0) AS s FROM n CROSS JOIN k LEFT JOIN (SELECT l.b, sum(l.p * s) AS x FROM l JOIN s{i - 1} ON s{i - 1}.n = l.a GROUP BY 1) x ON x.b = n.n)" for i in range(1, 11)]
_pagerank = lambda spark, sf: graph.REGISTRY["PageRank"](spark, [bipartite(spark, sf)], {"epsilon": 0.0, "iterations": 10}).toDF("n", "s").select("n", F.round("s", 9).alias("s"))
add("pagerank", f"WITH e AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem), {', '.join(_PR)} SELECT n, round(s, 9) AS s FROM s10", _pagerank)
add("kruskal", """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem), n AS (SELECT a AS n FROM e UNION SELECT b FROM e), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(x) AS (SELECT min(n) FROM n UNION SELECT u.b FROM r JOIN u ON u.a = r.x) SELECT count(*) - 1 AS edges, (count(*) - 1)::DOUBLE AS cost FROM r""",
    lambda spark, sf: graph.REGISTRY["MinimumSpanningForestKruskal"](spark, [bipartite(spark, sf)], {}).agg(F.count(F.lit(1)).alias("edges"), F.sum("cost").alias("cost")))

add("knn", """SELECT q, b, round(d, 9) AS d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, b) AS r FROM (
        SELECT x.vec_id AS q, y.vec_id AS b, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS d
        FROM embeddings x, embeddings y WHERE x.vec_id % 50 = 0)) WHERE r <= 5""",
    lambda spark, sf: _knn(spark, sf))


def _knn(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows, asked = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return search.nearest_of_all(rows, asked, 5).select("q", "b", F.round("_distance", 9).alias("d"))


add("full_text", """WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: x = 'the') AS a, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: x = 'idiot') AS b FROM documents),
        s AS (SELECT count(*) AS n, sum(CASE WHEN len(a) > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN len(b) > 0 THEN 1 ELSE 0 END) AS db FROM t)
        SELECT doc_id, round(len(a) * ln(1 + (n - da + 0.5) / (da + 0.5)) + len(b) * ln(1 + (n - db + 0.5) / (db + 0.5)), 6) AS score
        FROM t, s WHERE len(a) > 0 AND len(b) > 0 ORDER BY 2 DESC, 1 LIMIT 20""",
    lambda spark, sf: search.full_text(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), search.tokens(F.lower("text"), "Simple"), "the AND idiot", lambda w: [w], 20, [F.col("doc_id")]).select("doc_id", F.round("_score", 6).alias("score")))
add("sparse_dot", "SELECT l_orderkey AS doc, sum(l_quantity * CASE l_suppkey WHEN 1 THEN 2.0 ELSE 0.5 END) AS score FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    lambda spark, sf: search.sparse_top(spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("dim"), F.col("l_quantity").alias("w")), {1: 2.0, 2: 0.5}, 15))
add("gazetteer", "SELECT doc_id, unnest(regexp_extract_all(text, '(MIT License|Apache License|General Public License)')) AS surface FROM documents WHERE text LIKE '%License%'",
    lambda spark, sf: search.tag(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "text", {"MIT License": "MIT", "Apache License": "Apache", "General Public License": "GPL"}).select("doc_id", "surface"))


from tessera.plans import suite_scripts, suite_values  # noqa: E402, F401  (they register into this suite)

suite_values.register(program)
