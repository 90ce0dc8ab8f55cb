"""Registered programs for scalar functions and aggregates, by group, with their SQL."""

from __future__ import annotations

M = 1000000.0


def _columns(prefix: str, pairs: list[tuple[str, str]], key: str) -> tuple[str, str, list[str]]:
    """Head, body and SQL select list of ``(expression, SQL)`` pairs; columns are named c0, c1, ..."""
    names = [f"c{i}" for i in range(len(pairs))]
    body = ", ".join(f"{n} = {e}" for n, (e, _) in zip(names, pairs))
    sql = ", ".join([f"{key} AS k", *(f"{s} AS {n}" for n, (_, s) in zip(names, pairs))])
    return f"?[k, {', '.join(names)}] := {prefix}, {body}", sql, ["k", *names]


def _rounded(*calls: tuple[str, str]) -> list[tuple[str, str]]:
    return [(f"round(({e}) * 1000000.0)", f"round(({s}) * 1000000.0)") for e, s in calls]


def _same(*calls: str) -> list[tuple[str, str]]:
    return _rounded(*[(c, c) for c in calls])


_SUPPLIER = "*supplier{s_suppkey: k, s_acctbal: q}, x = q / 20000.0, p = abs(x) + 1.0, t = abs(x) / 2.0"
_SUPPLIER_SQL = "(SELECT s_suppkey, s_acctbal AS q, s_acctbal / 20000 AS x, abs(s_acctbal / 20000) + 1 AS p, abs(s_acctbal / 20000) / 2 AS t FROM supplier)"
_PART = "*part{p_partkey: k, p_name: n, p_type: y, p_size: z, p_retailprice: r}"
_UUID = "'DD85B19A-5FDE-11ED-A88E-1774A7698039'"
_B = "decode_base64(if(z > 25, '8A==', 'Pw=='))"


def _i(s: str) -> str:
    return f"CAST({s} AS BIGINT)"


_LIST, _LIST_SQL = "[z, k % 7, 3, z]", "[CAST(p_size AS BIGINT), p_partkey % 7, 3, CAST(p_size AS BIGINT)]"


def _json(e: str, s: str) -> tuple[str, str]:
    return f"dump_json(json({e}))", f"CAST(to_json({s}) AS VARCHAR)"


def _interval_pairs() -> list[tuple[str, str]]:
    a, b = "make_interval(z, z + 5)", "make_interval(20, 30)"
    lo, hi = "p_size", "p_size + 5"
    return [
        (f"interval_has_start({a})", "true"), (f"interval_has_end(make_interval(z, null))", "false"), ("interval_is_start_unbounded(make_interval(null, z))", "true"),
        ("interval_is_end_unbounded(make_interval(z, null))", "true"), (f"interval_before({a}, {b})", f"{hi} < 19"), (f"interval_meets({a}, {b})", f"{hi} = 19"),
        (f"interval_overlaps({a}, {b})", f"{lo} < 20 AND {hi} >= 20 AND {hi} < 30"), (f"interval_starts({a}, {b})", f"{lo} = 20"), (f"interval_during({a}, {b})", f"{lo} > 20 AND {hi} < 30"),
        (f"interval_finishes({a}, {b})", f"{hi} = 30"), (f"interval_intersects({a}, {b})", f"{lo} <= 30 AND {hi} >= 20"),
    ]


#: name -> prefix, pairs, key in SQL, SQL source
GROUPS = {
    "powers_and_logarithms": (_SUPPLIER, [
        ("-x", "-x"), ("ceil(q)", "ceil(q)"), ("max(x, 0.25, t)", "greatest(x, 0.25, t)"), ("min(x, 0.25)", "least(x, 0.25)"), ("x - t", "x - t"), ("add(1, 2, 3)", "6::BIGINT"),
        *_rounded(("p ^ 1.5", "pow(p, 1.5)"), ("exp(x)", "exp(x)"), ("exp2(x)", "pow(2, x)"), ("ln(p)", "ln(p)"), ("log2(p)", "log2(p)"), ("log10(p)", "log10(p)"))], "s_suppkey", _SUPPLIER_SQL),
    "angles": (_SUPPLIER, [*_same("sin(x)", "cos(x)", "tan(x)", "asin(t)", "acos(t)", "atan(x)", "atan2(x, p)", "sinh(x)", "cosh(x)", "tanh(x)", "asinh(x)", "acosh(p)", "atanh(t)"),
                           *_rounded(("deg_to_rad(x)", "radians(x)"), ("rad_to_deg(x)", "degrees(x)"))], "s_suppkey", _SUPPLIER_SQL),
    "comparisons": (_PART, [
        ("z == 5", "p_size = 5"), ("z != 5", "p_size <> 5"), ("z > 5", "p_size > 5"), ("z >= 25", "p_size >= 25"), ("z < 9", "p_size < 9"), ("z <= 10", "p_size <= 10"), ("!(z > 5)", "NOT p_size > 5"),
        ("is_in(z, [1, 2, 30])", "p_size IN (1, 2, 30)"), ("assert(z > 0)", "true"), ("z > 5 && z < 9", "p_size > 5 AND p_size < 9"), ("z < 5 || z > 40", "p_size < 5 OR p_size > 40"),
        ("null ~ z", _i("p_size")), ("2 + 3 * z - 4", _i("2 + 3 * p_size - 4")), ("z > 5 || z > 1 && z < 0", "p_size > 5")], "p_partkey", "part"),
    "kinds_of_values": (_PART, [(f"{f}({a})", s) for f, a, s in (
        ("is_null", "z", "false"), ("is_int", "z", "true"), ("is_int", "r", "false"), ("is_float", "r", "true"), ("is_num", "z", "true"), ("is_finite", "r", "true"), ("is_infinite", "to_float('INF')", "true"),
        ("is_nan", "r", "false"), ("is_string", "n", "true"), ("is_string", "z", "false"), ("is_list", "[z]", "true"), ("is_vec", "vec([r])", "true"), ("is_bytes", "decode_base64('AA==')", "true"), ("is_bytes", "n", "false"),
        ("is_uuid", "to_uuid('dd85b19a-5fde-11ed-a88e-1774a7698039')", "true"), ("is_json", "json(z)", "true"), ("is_json", "n", "false"))], "p_partkey", "part"),
    "conversions": (_PART, [
        ("to_bool(z % 2)", "p_size % 2 <> 0"), ("to_unity(z)", "1::BIGINT"), ("to_int(r)", _i("trunc(p_retailprice)")), ("to_float(to_string(z))", "p_size::DOUBLE"), ("to_string(z)", "p_size::VARCHAR"),
        (f"to_string(to_uuid({_UUID}))", f"lower({_UUID})"), (f"to_int(round(uuid_timestamp({_UUID}))) + z", "1667964632::BIGINT + p_size"), ("to_int(validity(z))", _i("p_size")),
        ("length(vec([r, r]))", "2::BIGINT")], "p_partkey", "part"),
    "more_strings": (_PART, [
        ("lowercase(y)", "lower(p_type)"), ("uppercase(y)", "upper(p_type)"), ("trim('  ' ++ n ++ ' ')", "p_name"), ("trim_start('  ' ++ n ++ ' ')", "p_name || ' '"), ("trim_end('  ' ++ n ++ ' ')", "'  ' || p_name"),
        ("ends_with(y, 'L')", "ends_with(p_type, 'L')"), ("str_includes(y, 'EE')", "contains(p_type, 'EE')"), ("length(chars(n))", _i("length(p_name)")), ("first(chars(n))", "substr(p_name, 1, 1)"),
        ("unicode_normalize(n ++ 'e\\u0301', 'nfc')", "p_name || 'é'"), ("t2s('國學' ++ n)", "'国学' || p_name"), ("regex_matches(y, regex('^[A-M]'))", "regexp_matches(p_type, '^[A-M]')"),
        ("regex_replace(y, '[AEIOU]', '_')", "regexp_replace(p_type, '[AEIOU]', '_')"), ("regex_replace_all(y, '[AEIOU]', '_')", "regexp_replace(p_type, '[AEIOU]', '_', 'g')"),
        ("length(regex_extract(y, '[A-Z]+'))", _i("len(regexp_extract_all(p_type, '[A-Z]+'))")), ("from_substrings(regex_extract(n, '[0-9]'))", "array_to_string(regexp_extract_all(p_name, '[0-9]'), '')")], "p_partkey", "part"),
    "lists": (_PART, [
        _json("list(z, k)", "[CAST(p_size AS BIGINT), p_partkey]"), (f"first({_LIST})", _i("p_size")), (f"last({_LIST})", _i("p_size")), (f"get({_LIST}, 1)", "p_partkey % 7"), (f"get({_LIST}, 9, -1)", "-1::BIGINT"),
        (f"{_LIST} -> 2", "3::BIGINT"), _json(f"slice({_LIST}, 1, 3)", "[p_partkey % 7, 3]"), _json(f"append({_LIST}, 8)", f"list_append({_LIST_SQL}, 8)"), _json(f"prepend({_LIST}, 8)", f"list_prepend(8, {_LIST_SQL})"),
        _json(f"reverse({_LIST})", f"list_reverse({_LIST_SQL})"), _json(f"sorted({_LIST})", f"list_sort({_LIST_SQL})"), _json("chunks([z, 2, 3], 2)", "[[CAST(p_size AS BIGINT), 2], [3]]"),
        _json("chunks_exact([z, 2, 3], 2)", "[[CAST(p_size AS BIGINT), 2]]"), _json("windows([z, 2, 3], 2)", "[[CAST(p_size AS BIGINT), 2], [2, 3]]"), _json("union([z, 1], [2, 1])", "list_sort(list_distinct([CAST(p_size AS BIGINT), 1, 2]))"),
        _json("intersection([z, 1, 2, 3], [3, 2])", "[2, 3]"), _json("difference([1, 2, 3, z], [2, z])", "list_filter([1, 2, 3], lambda x: x <> 2 AND x <> p_size)"), _json("concat([z], [2, 3])", "[CAST(p_size AS BIGINT), 2, 3]")], "p_partkey", "part"),
    "json_values": (_PART, [
        ("dump_json(json_object('s', z))", "'{\"s\":' || p_size || '}'"), ("dump_json(parse_json('[' ++ to_string(z) ++ ',1]'))", "'[' || p_size || ',1]'"), ("json_to_scalar(json(n))", "p_name"),
        ("dump_json(set_json_path(json_object('a', 1), ['b', 0], z))", "'{\"a\":1,\"b\":[' || p_size || ']}'"), ("dump_json(remove_json_path({'a': z, 'b': 2}, ['b']))", "'{\"a\":' || p_size || '}'"),
        ("dump_json({'a': {'x': z}} -> 'a')", "'{\"x\":' || p_size || '}'"), ("dump_json(concat(json_object('a', z), json_object('b', 2)))", "'{\"a\":' || p_size || ',\"b\":2}'")], "p_partkey", "part"),
    "vectors_and_places": (_SUPPLIER, [
        *_rounded(("l2_dist(vec([x, 1.0]), vec([t, 0.5]))", "pow(x::FLOAT::DOUBLE - t::FLOAT::DOUBLE, 2) + 0.25"), ("ip_dist([x, p], [p, t])", "1 - (x * p + p * t)"),
                  ("cos_dist([x, p], [p, t])", "1 - (x * p + p * t) / sqrt((x * x + p * p) * (p * p + t * t))"), ("first(l2_normalize([x, p]))", "x / sqrt(x * x + p * p)"),
                  ("haversine(x, 0.1, t, 0.7)", "2 * asin(sqrt(pow(sin((x - t) / 2), 2) + cos(x) * cos(t) * pow(sin(0.3), 2)))"),
                  ("haversine_deg_input(10.0 * x, 5.0, 10.0 * t, 7.0)", "2 * asin(sqrt(pow(sin(radians(10 * x - 10 * t) / 2), 2) + cos(radians(10 * x)) * cos(radians(10 * t)) * pow(sin(radians(1)), 2)))"))], "s_suppkey", _SUPPLIER_SQL),
    "intervals": (_PART, _interval_pairs(), "p_partkey", "part"),
    "bytes_and_bits": (_PART, [
        (f"encode_base64({_B})", "CASE WHEN p_size > 25 THEN '8A==' ELSE 'Pw==' END"), (f"encode_base64(bit_and({_B}, decode_base64('Dw==')))", "CASE WHEN p_size > 25 THEN 'AA==' ELSE 'Dw==' END"),
        (f"encode_base64(bit_or({_B}, decode_base64('Dw==')))", "CASE WHEN p_size > 25 THEN '/w==' ELSE 'Pw==' END"), (f"encode_base64(bit_xor({_B}, decode_base64('/w==')))", "CASE WHEN p_size > 25 THEN 'Dw==' ELSE 'wA==' END"),
        (f"encode_base64(bit_not({_B}))", "CASE WHEN p_size > 25 THEN 'Dw==' ELSE 'wA==' END"), ("encode_base64(pack_bits([z > 25, true, true, true, false, false, false, false]))", "CASE WHEN p_size > 25 THEN '8A==' ELSE 'cA==' END"),
        (f"first(unpack_bits({_B}))", "p_size > 25")], "p_partkey", "part"),
    "time_and_chance": (_PART, [
        ("format_timestamp(z * 86400)", "strftime(make_timestamp(p_size::BIGINT * 86400000000), '%Y-%m-%dT%H:%M:%S+00:00')"), ("parse_timestamp('1970-02-01T00:00:00Z') + z", "2678400.0::DOUBLE + p_size"), ("now() > 1600000000.0", "true"),
        ("rand_float() < 1.0", "true"), ("rand_int(z, z)", _i("p_size")), ("rand_bernoulli(1.0)", "true"), ("rand_choose([z])", _i("p_size")), ("length(rand_uuid_v1())", "36::BIGINT"), ("length(rand_uuid_v4())", "36::BIGINT"),
        ("length(rand_vec(4))", "4::BIGINT")], "p_partkey", "part"),
}

_NATION = "*nation{n_nationkey: k, n_regionkey: g, n_name: n}"
#: name -> program, SQL, columns
AGGREGATES = {
    "aggregates_of_values": (f"?[g, product(v), choice(n), count_unique(h), hll(n)] := {_NATION}, v = k + 1, h = slice_string(n, 0, 1)",
                             "SELECT n_regionkey::BIGINT AS g, product(n_nationkey + 1)::BIGINT AS p, arg_min(n_name, (n_nationkey, n_name)) AS c, count(DISTINCT substr(n_name, 1, 1)) AS u, count(DISTINCT n_name) AS h FROM nation GROUP BY 1",
                             ["g", "p", "c", "u", "h"]),
    "aggregates_of_pairs": ("?[s, latest_by(a), smallest_by(a), c1] := *orders{o_orderkey: k, o_orderstatus: s}, a = [k, k % 1000003], c1 = s",
                            "SELECT o_orderstatus AS s, arg_max(o_orderkey, o_orderkey % 1000003) AS l, arg_min(o_orderkey, o_orderkey % 1000003) AS m, o_orderstatus AS c FROM orders GROUP BY 1, 4", ["s", "l", "m", "c"]),
    "cheapest_pair": ("a[s, min_cost(p)] := *orders{o_orderkey: k, o_orderstatus: s}, p = [k, 0 - k]; ?[s, k, c] := a[s, p], k = first(p), c = last(p)",
                      "SELECT o_orderstatus AS s, max(o_orderkey) AS k, -max(o_orderkey) AS c FROM orders GROUP BY 1", ["s", "k", "c"]),
    "shortest_list": (f"a[g, shortest(l)] := {_NATION}, l = int_range(k + 1); ?[g, n] := a[g, l], n = length(l)", "SELECT n_regionkey::BIGINT AS g, min(n_nationkey)::BIGINT + 1 AS n FROM nation GROUP BY 1", ["g", "n"]),
    "aggregates_of_sets": (f"a[g, union(l), intersection(m)] := {_NATION}, l = [g, k], m = [g, 100 + g, k]; ?[g, u, i] := a[g, l, m], u = dump_json(json(l)), i = dump_json(json(m))",
                           "SELECT n_regionkey::BIGINT AS g, CAST(to_json(list_sort(list_distinct(list_append(list(n_nationkey), any_value(n_regionkey))))) AS VARCHAR) AS u, '[' || CASE WHEN count(*) = 1 AND any_value(n_nationkey) <> n_regionkey THEN NULL ELSE n_regionkey || ',' || (100 + n_regionkey) END || ']' AS i FROM nation GROUP BY n_regionkey",
                           ["g", "u", "i"]),
    "collected_values": (f"a[g, collect(n)] := {_NATION}; ?[g, l] := a[g, c], l = from_substrings(c)", "SELECT n_regionkey::BIGINT AS g, string_agg(n_name, '' ORDER BY n_name) AS l FROM nation GROUP BY 1", ["g", "l"]),
    "aggregates_of_bytes": ("a[s, bit_and(b), bit_or(b), bit_xor(b)] := *orders{o_orderkey: k, o_orderstatus: s}, k < 200, b = pack_bits([k % 2 == 0, k % 3 == 0, k > 0, k < 0, k % 5 == 0, k % 7 == 0, true, false]); "
                            "?[s, x, y, z] := a[s, b, c, d], x = encode_base64(b), y = encode_base64(c), z = encode_base64(d)",
                            "WITH o AS (SELECT o_orderstatus AS s, (CASE WHEN o_orderkey % 2 = 0 THEN 128 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 64 ELSE 0 END + CASE WHEN o_orderkey > 0 THEN 32 ELSE 0 END + CASE WHEN o_orderkey < 0 THEN 16 ELSE 0 END "
                            "+ CASE WHEN o_orderkey % 5 = 0 THEN 8 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 0 END + 2)::UTINYINT AS b FROM orders WHERE o_orderkey < 200) "
                            "SELECT s, to_base64(from_hex(printf('%02x', bit_and(b)))) AS x, to_base64(from_hex(printf('%02x', bit_or(b)))) AS y, to_base64(from_hex(printf('%02x', bit_xor(b)))) AS z FROM o GROUP BY 1", ["s", "x", "y", "z"]),
    "sketches": (f"a[g, hll_sketch(n), count_min(n), tdigest(v)] := {_NATION}, v = k * 1.0; b[hll_union(h)] := a[g, h, c, d]; ?[g, x, y, z, u] := a[g, h, c, d], b[t], x = length(h) > 0, y = length(c) > 0, z = length(d) > 0, u = is_bytes(t)",
                 "SELECT DISTINCT n_regionkey::BIGINT AS g, true AS x, true AS y, true AS z, true AS u FROM nation", ["g", "x", "y", "z", "u"]),
    "lists_of_values": ("a[r, collect(k)] := *nation{n_regionkey: r, n_nationkey: k}; b[r, unique(m)] := *nation{n_regionkey: r, n_nationkey: k}, m = k % 3; ?[r, x, y] := a[r, l], b[r, u], x = dump_json(json(l)), y = dump_json(json(u))",
                        "SELECT n_regionkey::BIGINT AS r, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS x, CAST(to_json(list_sort(list(DISTINCT n_nationkey % 3))) AS VARCHAR) AS y FROM nation GROUP BY 1", ["r", "x", "y"]),
}


def register(program) -> None:
    for name, (prefix, pairs, key, source) in GROUPS.items():
        text, sql, columns = _columns(prefix, pairs, key)
        program(name, text, f"SELECT {sql} FROM {source}", columns)
    for name, (text, sql, columns) in AGGREGATES.items():
        program(name, text, sql, columns)
