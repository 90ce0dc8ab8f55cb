"""Vector, full-text and near-duplicate search as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.errors import ParseError, TypeRefusal
from tessera.functions.scalar import cosine, dot, haversine, l2

DISTANCES = {"L2": l2, "IP": lambda a, b: 1 - dot(a, b), "Cosine": cosine}
FOLD = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
STOPWORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def nearest(base: DataFrame, query: Column, vector: Column, k: int, distance: str = "L2", radius: float | None = None,
            by: list[Column] | None = None, keys: list[Column] | None = None) -> DataFrame:
    """Exact k nearest rows, per group ``by`` if given; ties by ``keys``.

    Ranks are cut before and after the shuffle (a window group limit), so only
    about k rows per task and query move.
    """
    d = DISTANCES[distance](vector, query)
    x = base.withColumn("_distance", d)
    if radius is not None:
        x = x.where(F.col("_distance") <= radius)
    order = [F.col("_distance"), *(keys or [])]
    if not by:
        return x.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


#: Queries and rows of one task of ``nearest_of_all``; distances are made for ``CHUNK`` rows at a time.
QUERIES, ROWS, CHUNK = 1024, 65_536, 4096


def nearest_of_all(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact ``k`` nearest ``b, v`` of each ``q, v`` by squared L2, ties by ``b``, as ``q, b, _distance``.

    Blocks of queries meet blocks of rows, each pair in one bounded task.
    Products of matrices leave few candidates, with a margin above their
    rounding; those are added up dimension by dimension, as ``l2`` does.
    Vectors with nulls, infinities or another length than the queries' have no
    such form and are compared by ``l2`` itself; a missing distance comes last.
    """
    first = queries.agg(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    dim, n = first["d"], rows.count()
    odd = F.coalesce((F.size("v") != F.lit(dim)) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e100)), F.lit(True))

    def blocks(df, tag, own, other, mine, theirs):
        df = df.where(~odd).withColumn(own, F.pmod(F.xxhash64(tag), F.lit(mine)))
        return df.select(own, tag, F.col("v").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(theirs - 1)).cast("array<bigint>")).alias(other))

    a, b = max(1, -(-first["n"] // QUERIES)), max(1, -(-n // ROWS))
    kind = f"q {queries.schema['q'].dataType.simpleString()}, b {rows.schema['b'].dataType.simpleString()}, _distance double"

    def task(left, right):
        import numpy as np
        import pyarrow as pa

        def matrix(t):
            return t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)

        out = pa.schema([("q", left.schema.field("q").type), ("b", right.schema.field("b").type), ("_distance", pa.float64())])
        if not len(left) or not len(right):
            return out.empty_table()
        right = right.sort_by("b")  # places of rows order ties
        x, y = matrix(left), matrix(right)
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        limit = np.full(len(x), np.inf)
        qs, bs, ds = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(y), CHUNK):
            part, size = y[at: at + CHUNK], yy[at: at + CHUNK]
            near = xx[:, None] + size[None, :] - 2.0 * (x @ part.T)
            margin = 1e-12 * (xx + size.max())
            top = limit if at else np.partition(near, min(k, len(part)) - 1, axis=1)[:, min(k, len(part)) - 1] + margin
            i, j = np.nonzero(near <= (top + margin)[:, None])
            for lo in range(0, len(i), 262_144):
                qi, bj = i[lo: lo + 262_144], j[lo: lo + 262_144]
                exact = np.zeros(len(qi))
                for c in range(x.shape[1]):
                    exact += (x[qi, c] - part[bj, c]) ** 2
                qs, bs, ds = np.concatenate([qs, qi]), np.concatenate([bs, bj + at]), np.concatenate([ds, exact])
                order = np.lexsort((bs, ds, qs))
                qs, bs, ds = qs[order], bs[order], ds[order]
                keep = np.arange(len(qs)) - np.searchsorted(qs, qs) < k
                qs, bs, ds = qs[keep], bs[keep], ds[keep]
            last = np.arange(len(qs)) - np.searchsorted(qs, qs) == k - 1
            limit = np.full(len(x), np.inf)
            limit[qs[last]] = ds[last]
        return pa.table([left["q"].take(pa.array(qs)), right["b"].take(pa.array(bs)), pa.array(ds)], schema=out)

    x, y = blocks(queries, "q", "_a", "_b", a, b), blocks(rows, "b", "_b", "_a", b, a)
    keys = ["_a", "_b"]
    found = x.repartition(a * b, *keys).groupBy(*keys).cogroup(y.repartition(a * b, *keys).groupBy(*keys)).applyInArrow(task, kind)
    slow = lambda l, r: l.crossJoin(r.withColumnRenamed("v", "_v")).select("q", "b", l2(F.col("v"), F.col("_v")).alias("_distance"))
    found = found.union(slow(queries.where(odd), rows)).union(slow(queries.where(~odd), rows.where(odd)))
    w = Window.partitionBy("q").orderBy(F.col("_distance").asc_nulls_last(), "b")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


# -- text
def tokens(text: Column, tokenizer: str = "Simple", filters: list | None = None, options: list | None = None) -> Column:
    """Array of tokens of a text."""
    o = options or []
    if tokenizer == "Raw":
        out = F.array(text)
    elif tokenizer == "Whitespace":
        out = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    elif tokenizer == "Simple":
        out = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    elif tokenizer == "Cangjie":  # no dictionary: runs of Han characters become overlapping pairs
        out = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0)), lambda w: F.when(
            w.rlike(r"^\p{IsHan}{2,}$"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))).otherwise(F.array(w))))
    elif tokenizer == "NGram":
        lo = int(o[0]) if o else 1
        hi = int(o[1]) if len(o) > 1 else lo
        out = F.concat(*[_grams(text, n, bool(len(o) > 2 and o[2])) for n in range(lo, hi + 1)])
    else:
        raise TypeRefusal(f"no tokenizer {tokenizer}")
    for f in filters or []:
        name, args = (f[0], f[1:]) if isinstance(f, list) else (f, [])
        if name == "Lowercase":
            out = F.transform(out, lambda x: F.lower(x))
        elif name == "AlphaNumOnly":
            out = F.filter(out, lambda x: x.rlike(r"^[A-Za-z0-9]+$"))
        elif name == "RemoveLong":
            out = _keep_short(out, int(args[0]))
        elif name == "AsciiFolding":
            out = F.transform(out, lambda x: F.translate(x, *FOLD))
        elif name == "Stopwords":
            words = args[0] if args and isinstance(args[0], list) else _english("stop words", args) or STOPWORDS
            out = F.filter(out, lambda x: ~x.isin(*words)) if words else out
        elif name == "Stemmer":
            _english("stemmer", args)
            out = F.transform(out, _stem)
        elif name == "SplitCompoundWords":
            words = sorted(args[0], key=len, reverse=True)
            out = F.flatten(F.transform(out, lambda x: F.when(x.rlike("^(?:" + "|".join(map(re.escape, words)) + ")+$"), F.regexp_extract_all(x, F.lit("|".join(map(re.escape, words))), F.lit(0))).otherwise(F.array(x))))
        else:
            raise TypeRefusal(f"no token filter {name}")
    return out


def _english(what: str, args: list) -> None:
    if args and str(args[0]).lower() not in ("en", "english"):
        raise TypeRefusal(f"no {what} for {args[0]}")


def _grams(text: Column, n: int, prefix: bool) -> Column:
    starts = F.array(F.lit(1)) if prefix else F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _keep_short(words: Column, n: int) -> Column:
    return F.filter(words, lambda x: F.octet_length(x) < n)


def _stem(x: Column) -> Column:
    """A light English stemmer: plural, past and progressive endings, then a final e."""
    x = F.regexp_replace(x, r"(ss)es$|(.{2,})ies$", "$1$2")
    x = F.regexp_replace(x, r"^(.{2,}[^su])s$", "$1")
    x = F.regexp_replace(x, r"^(.*[aeiouy].*?)(?:ed|ing)$", "$1")
    return F.regexp_replace(x, r"([^aeiouylsz])\1$", "$1")


# -- full-text queries: ("term", word, prefix, boost), ("near", n, terms), ("and" | "or" | "not", a, b)
FTS = re.compile(r"\s*(?:(NEAR)(?:/(\d+))?\s*\(|(AND|OR|NOT)\b|([,;])|([()])|\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|(\w+)|(\*)|\^(\d+(?:\.\d*)?))")


def parse_fts(text: str):
    toks, at = [], 0
    while text[at:].strip():
        m = FTS.match(text, at)
        if not m:
            raise ParseError(f"bad search text at {text[at:at + 10]!r}")
        near, n, op, alt, par, dq, sq, word, star, boost = m.groups()
        toks.append(("near", int(n or 10)) if near else ("op", op) if op else ("op", "OR") if alt else ("par", par) if par else
                    ("word", dq if dq is not None else sq if sq is not None else word) if star is None and boost is None else ("star",) if star else ("boost", float(boost)))
        at = m.end()
    pos = 0

    def peek(kind, value=None):
        return pos < len(toks) and toks[pos][0] == kind and (value is None or toks[pos][1] == value)

    def word():
        nonlocal pos
        w = toks[pos][1]
        pos += 1
        star, boost = False, 1.0
        if peek("star"):
            star, pos = True, pos + 1
        if peek("boost"):
            boost, pos = toks[pos][1], pos + 1
        return "term", w, star, boost

    def unit():
        nonlocal pos
        if peek("near"):
            n, terms = toks[pos][1], []
            pos += 1
            while not peek("par", ")"):
                terms.append(word())
            pos += 1
            return "near", n, terms
        if peek("par", "("):
            pos += 1
            x = either()
            if not peek("par", ")"):
                raise ParseError("a closing parenthesis is missing")
            pos += 1
            return x
        if peek("word"):
            return word()
        raise ParseError("a search term is missing")

    def minus():
        nonlocal pos
        x = unit()
        while peek("op", "NOT"):
            pos += 1
            x = ("not", x, unit())
        return x

    def both():
        nonlocal pos
        x = minus()
        while pos < len(toks) and not peek("op", "OR") and not peek("par", ")"):
            if peek("op", "AND"):
                pos += 1
            x = ("and", x, minus())
        return x

    def either():
        nonlocal pos
        x = both()
        while peek("op", "OR"):
            pos += 1
            x = ("or", x, both())
        return x

    out = either()
    if pos != len(toks):
        raise ParseError("search text ends early")
    return out


def full_text(base: DataFrame, words: Column, query: str, split, k: int | None, keys: list[Column], kind: str = "tf_idf") -> DataFrame:
    """The ``k`` best rows that match, best first, with ``_score``; without ``k`` all of them, in no order.

    One aggregation counts rows and document frequencies of all terms at once;
    a second pass scores.  ``split`` turns a literal into its tokens.
    """
    ast, terms = parse_fts(query), []

    def lower(node):
        if node[0] == "term":
            _, w, star, boost = node
            parts = [w] if star else split(w)
            if not parts:
                return ("none",)
            out = None
            for p in parts:
                if (p, star) not in terms:
                    terms.append((p, star))
                leaf = ("leaf", terms.index((p, star)), boost)
                out = leaf if out is None else ("and", out, leaf)
            return out
        if node[0] == "near":
            flat = [(p, t[2], t[3]) for t in node[2] for p in ([t[1]] if t[2] else split(t[1]))]
            for p, star, _ in flat:
                if (p, star) not in terms:
                    terms.append((p, star))
            return "near", node[1], [(terms.index((p, s)), b) for p, s, b in flat]
        return node[0], lower(node[1]), lower(node[2])

    tree = lower(ast)
    x = base.withColumn("_words", words)
    hit = lambda w, t: F.startswith(w, F.lit(t[0])) if t[1] else w == F.lit(t[0])
    counts = [_hits(t, hit) for t in terms]
    x = x.select("*", *[c.cast("double").alias(f"_tf{i}") for i, c in enumerate(counts)])
    stats = x.agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col(f"_tf{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(terms))]).first()
    n = stats["n"] or 0

    def score(node) -> Column:
        """Score, null where the node does not match."""
        if node[0] == "none":
            return F.lit(None).cast("double")
        if node[0] == "leaf":
            df = stats[f"d{node[1]}"] or 0
            idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5))) if kind == "tf_idf" else F.lit(1.0)
            tf = F.col(f"_tf{node[1]}")
            return F.when(tf > 0, tf * idf * node[2])
        if node[0] == "and":
            return score(node[1]) + score(node[2])
        if node[0] == "or":
            return F.greatest(score(node[1]), score(node[2]))
        if node[0] == "not":
            return F.when(score(node[2]).isNull(), score(node[1]))
        return _near(node, terms, hit)

    found = x.withColumn("_score", score(tree)).where(F.col("_score").isNotNull())
    found = found if k is None else found.orderBy(F.col("_score").desc(), *keys).limit(k)
    return found.drop("_words", *[f"_tf{i}" for i in range(len(terms))])


def _hits(t, hit) -> Column:
    return F.size(F.filter(F.col("_words"), lambda w: hit(w, t)))


def _near(node, terms, hit) -> Column:
    """Positions of the first term that stay within range of each other term in turn."""
    _, n, parts = node

    def places(i):
        return F.filter(F.transform(F.col("_words"), lambda w, p: F.when(hit(w, terms[i]), p)), lambda p: p.isNotNull())

    live = places(parts[0][0])
    for i, _ in parts[1:]:
        live = _within(live, places(i), n)
    return F.when(F.size(live) > 0, F.size(live) * parts[0][1])


def _within(live: Column, other: Column, n: int) -> Column:
    return F.array_distinct(F.flatten(F.transform(live, lambda p: F.transform(F.filter(other, lambda q: F.abs(p - q) <= n), lambda q: F.least(p, q)))))


# -- near-duplicates
def bands(threshold: float, perms: int, fp: float = 1.0, fn: float = 1.0) -> tuple[int, int]:
    """Bands and rows that minimise weighted false positives and negatives."""
    best, steps = (float("inf"), 1, 1), 100
    for b in range(1, perms + 1):
        for r in range(1, perms // b + 1):
            lo = sum(1 - (1 - (threshold * (i + 0.5) / steps) ** r) ** b for i in range(steps)) * threshold / steps
            hi = sum((1 - (threshold + (1 - threshold) * (i + 0.5) / steps) ** r) ** b for i in range(steps)) * (1 - threshold) / steps
            best = min(best, (fp * lo + fn * hi, b, r))
    return best[1], best[2]


def _once(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def shingles(words: Column, n: int) -> Column:
    def made(w):
        count = F.size(w) - n + 1
        return F.array_distinct(F.when(count <= 1, F.array(F.array_join(w, "\0"))).otherwise(
            F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(w, i, n), "\0"))))

    return _once(words, made)


def band_keys(sh: Column, b: int, r: int) -> Column:
    """Band hashes of the MinHash signature of a shingle set."""
    def signature(base):
        return F.transform(F.sequence(F.lit(1), F.lit(b * r)), lambda i: F.array_min(F.transform(base, lambda h: F.xxhash64(h, i))))

    def keys(sig):
        return F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda j: F.xxhash64(j, F.array_join(F.transform(F.slice(sig, j * r + 1, r), lambda x: x.cast("string")), ",")))

    return _once(F.transform(sh, lambda s: F.xxhash64(s)), lambda base: _once(signature(base), keys))


def same_band(rows: DataFrame, text: str, keys, query: Column, queries: DataFrame | None = None) -> DataFrame:
    """Rows that share a band key with a query, and that query.

    ``keys`` turns a text into its band keys.  Each distinct text gets its keys
    once, in as many tasks as a shuffle leaves; outer explodes and ``coalesce``
    keep filters on the keys from being pushed below that and computed per row.
    Texts and queries meet by a join on the keys, and a pair counts only in the
    first that it shares.
    """
    asked = queries if queries is not None else rows.sparkSession.range(1).select(query.alias("_query"))
    query = query if queries is not None else F.col("_query")
    texts = rows.select(text).where(F.col(text).isNotNull()).distinct()
    x = texts.withColumn("_own", keys(F.col(text))).withColumn("_key", F.explode_outer("_own"))
    y = asked.withColumn("_asked", keys(query)).withColumn("_key", F.explode_outer("_asked"))
    shared = F.array_intersect(F.coalesce("_own", F.array().cast("array<bigint>")), F.coalesce("_asked", F.array().cast("array<bigint>")))
    met = x.join(y, "_key").where(F.get(shared, F.lit(0)) == F.col("_key"))
    return rows.join(met.select(text), text, "left_semi") if queries is None else rows.join(met.select(text, *queries.columns), text)


# -- library engines without a language surface
def within_box(df: DataFrame, lat: str, lon: str, south: float, west: float, north: float, east: float) -> DataFrame:
    if west > east:
        raise TypeRefusal("a box across the antimeridian is refused")
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def nearest_places(df: DataFrame, lat: str, lon: str, at: tuple[float, float], k: int, keys: list[Column]) -> DataFrame:
    d = haversine(F.radians(F.col(lat)), F.radians(F.col(lon)), F.radians(F.lit(at[0])), F.radians(F.lit(at[1])))
    return df.withColumn("_distance", d).orderBy("_distance", *keys).limit(k)


def sparse_top(entries: DataFrame, query: dict, k: int) -> DataFrame:
    """Top positive dot products of ``(doc, dim, w)`` rows with a sparse query."""
    w = F.create_map(*[F.lit(x) for p in sorted(query.items()) for x in p])
    return entries.where(F.col("dim").isin(*query)).groupBy("doc").agg(F.sum(F.col("w") * w[F.col("dim")]).alias("score")).where("score > 0").orderBy(F.col("score").desc(), "doc").limit(k)


def tag(df: DataFrame, text: str, surfaces: dict[str, str]) -> DataFrame:
    """Leftmost-longest dictionary matches of a text column, exploded as ``surface, entity``."""
    words = sorted(surfaces, key=lambda s: (-len(s), s))
    pat = r"(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}])"
    m = F.create_map(*[F.lit(x) for p in sorted(surfaces.items()) for x in p])
    return df.withColumn("surface", F.explode(F.regexp_extract_all(F.col(text), F.lit(pat), F.lit(0)))).withColumn("entity", m[F.col("surface")])

