"""Every scalar function of the language: values, and what is refused."""

import json
import math

import pytest

from tessera.errors import Refusal

VALUES = [
    # arithmetic
    ("add(1, 2, 3)", 6), ("1 + 2.5", 3.5), ("5 - 7", -2), ("2 * 3 * 4", 24), ("7 / 2", 3.5), ("-7 % 3", -1), ("2 ^ 3 ^ 2", 512.0), ("-(3)", -3),
    ("abs(-3)", 3), ("signum(-2)", -1), ("signum(2.5)", 1.0), ("floor(2.7)", 2.0), ("floor(2)", 2), ("ceil(2.1)", 3.0), ("round(2.5)", 3.0), ("round(-2.5)", -3.0),
    ("max(1, 5, 3)", 5), ("min(4, 2, 3)", 2), ("exp(0)", 1.0), ("exp2(3)", 8.0), ("ln(1)", 0.0), ("log2(8)", 3.0), ("log10(1000)", 3.0), ("sqrt(9)", 3.0),
    ("sin(0)", 0.0), ("cos(0)", 1.0), ("tan(0)", 0.0), ("asin(1)", math.pi / 2), ("acos(1)", 0.0), ("atan(1)", math.pi / 4), ("atan2(1, 1)", math.pi / 4),
    ("sinh(0)", 0.0), ("cosh(0)", 1.0), ("tanh(0)", 0.0), ("asinh(0)", 0.0), ("acosh(1)", 0.0), ("atanh(0)", 0.0), ("deg_to_rad(180)", math.pi), ("rad_to_deg(0)", 0.0),
    ("vec([1, 2]) + vec([3, 4])", [4.0, 6.0]), ("vec([1, 2]) * 2", [2.0, 4.0]), ("[1.0, 2.0] - [1.0, 1.0]", [0.0, 1.0]),
    # comparison and logic
    ("1 == 1.0", True), ("null == null", True), ("1 == null", False), ("1 != 2", True), ("2 > 1", True), ("2 >= 2", True), ("'a' < 'b'", True), ("1 <= 0", False),
    ("!true", False), ("is_in(2, [1, 2])", True), ("assert(true)", True), ("is_null(null)", True), ("is_int(1)", True), ("is_int(1.0)", False), ("is_float(1.0)", True),
    ("is_num(1)", True), ("is_finite(1.0)", True), ("is_infinite(to_float('INF'))", True), ("is_nan(1.0)", False), ("is_string('a')", True), ("is_list([1])", True),
    ("is_vec(vec([1]))", True), ("is_bytes(decode_base64('AA=='))", True), ("is_uuid('dd85b19a-5fde-11ed-a88e-1774a7698039')", True), ("is_json(json(1))", True),
    ("true && false", False), ("false || true", True), ("null ~ 3", 3), ("if(1 > 0, 'a', 'b')", "a"), ("if(1 < 0, 'a')", None), ("cond(false, 1, true, 2, 3)", 2),
    ("if(0 == 0 || 1 / 0 > 1, 1, 2)", 1),
    # conversion
    ("to_bool(null)", False), ("to_bool('x')", True), ("to_bool([])", False), ("to_unity(5)", 1), ("to_int(3.9)", 3), ("to_int('42')", 42), ("to_int(null)", 0), ("to_int(true)", 1),
    ("to_float('1.5')", 1.5), ("to_float('PI')", math.pi), ("to_float(null)", 0.0), ("to_string(12)", "12"), ("to_string('a')", "a"),
    ("to_uuid('DD85B19A-5FDE-11ED-A88E-1774A7698039')", "dd85b19a-5fde-11ed-a88e-1774a7698039"), ("to_int(validity(12))", 12), ("vec([0.5])", [0.5]),
    ("to_int(round(uuid_timestamp('dd85b19a-5fde-11ed-a88e-1774a7698039')))", 1667964632), ("uuid_timestamp('dd85b19a-5fde-41ed-a88e-1774a7698039')", None),
    # strings
    ("lowercase('ÀB')", "àb"), ("uppercase('àb')", "ÀB"), ("trim(' \\ta ')", "a"), ("trim_start('  a ')", "a "), ("trim_end(' a  ')", " a"),
    ("starts_with('abc', 'ab')", True), ("ends_with('abc', 'bc')", True), ("str_includes('abc', 'b')", True), ("chars('añ')", ["a", "ñ"]), ("chars('')", []),
    ("from_substrings(['a', 'b'])", "ab"), ("slice_string('añb', 1, 3)", "ñb"), ("unicode_normalize('e\\u0301', 'nfc')", "é"), ("t2s('國學')", "国学"),
    ("regex_matches('abc', 'b.')", True), ("regex_replace('aaa', 'a', 'b')", "baa"), ("regex_replace_all('aaa', 'a', 'b')", "bbb"), ("regex_matches('abc', regex('^a'))", True),
    ("regex_extract('a1b22', '[0-9]+')", ["1", "22"]), ("regex_extract_first('a1b22', '[0-9]+')", "1"), ("regex_extract_first('a', '[0-9]')", None), ("'a' ++ 'b'", "ab"),
    # lists
    ("list(1, 2)", [1, 2]), ("first([3, 4])", 3), ("last([3, 4])", 4), ("first([])", None), ("get([1, 2, 3], -1)", 3), ("get([1], 5, 9)", 9), ("maybe_get([1], 5)", None), ("[1, 2] -> 1", 2),
    ("length([1, 2])", 2), ("length('añ')", 2), ("length(decode_base64('AAA='))", 2), ("slice([1, 2, 3, 4], 1, -1)", [2, 3]), ("concat([1], [2, 3])", [1, 2, 3]),
    ("append([1], 2)", [1, 2]), ("prepend([1], 2)", [2, 1]), ("reverse([1, 2])", [2, 1]), ("sorted([3, 1, 2])", [1, 2, 3]), ("chunks([1, 2, 3], 2)", [[1, 2], [3]]),
    ("chunks_exact([1, 2, 3], 2)", [[1, 2]]), ("windows([1, 2, 3], 2)", [[1, 2], [2, 3]]), ("union([3, 1], [2, 1])", [1, 2, 3]), ("intersection([1, 2, 3], [3, 2])", [2, 3]),
    ("difference([1, 2, 3], [2])", [1, 3]), ("int_range(3)", [0, 1, 2]), ("int_range(5, 1, -2)", [5, 3]), ("int_range(1, 1)", []), ("int_range(2, 4)", [2, 3]),
    # JSON
    ("dump_json(json([1, 2]))", "[1,2]"), ("dump_json({'b': 1, 'a': 'x'})", '{"a":"x","b":1}'), ("dump_json(json_object('k', true))", '{"k":true}'),
    ("dump_json(parse_json('{\"a\": [1]}'))", '{"a":[1]}'), ("json_to_scalar(json('x'))", "x"), ("dump_json(parse_json('{\"a\":{\"b\":7}}') -> 'a')", '{"b":7}'),
    ("dump_json(set_json_path(parse_json('{\"a\":1}'), ['b', 0], 5))", '{"a":1,"b":[5]}'), ("dump_json(remove_json_path(parse_json('{\"a\":1,\"b\":2}'), ['a']))", '{"b":2}'),
    ("dump_json(concat(parse_json('{\"a\":{\"x\":1}}'), parse_json('{\"a\":{\"y\":2}}')))", '{"a":{"x":1,"y":2}}'),
    # vectors and places
    ("l2_dist(vec([1, 0]), vec([0, 2]))", 5.0), ("ip_dist(vec([1, 2]), vec([3, 4]))", -10.0), ("cos_dist(vec([1, 0]), vec([0, 1]))", 1.0), ("l2_normalize(vec([3, 4]))", [0.6, 0.8]),
    ("haversine(0, 0, 0, 1)", 1.0), ("haversine_deg_input(0, 0, 0, 180)", math.pi),
    # intervals
    ("interval_start(make_interval(1, 5))", 1), ("interval_end(make_interval(1, 5))", 5), ("interval_end(make_interval(1, null))", None), ("interval_has_start(make_interval(1, 5))", True),
    ("interval_has_end(make_interval(1, null))", False), ("interval_is_start_unbounded(make_interval(null, 5))", True), ("interval_is_end_unbounded(make_interval(1, null))", True),
    ("interval_has_start(make_interval(5, 1))", False), ("interval_before(make_interval(1, 2), make_interval(4, 5))", True), ("interval_before(make_interval(1, 2), make_interval(3, 5))", False),
    ("interval_meets(make_interval(1, 2), make_interval(3, 5))", True), ("interval_overlaps(make_interval(1, 3), make_interval(2, 5))", True),
    ("interval_starts(make_interval(1, 3), make_interval(1, 5))", True), ("interval_during(make_interval(2, 3), make_interval(1, 5))", True),
    ("interval_finishes(make_interval(3, 5), make_interval(1, 5))", True), ("interval_intersects(make_interval(1, 3), make_interval(3, 5))", True),
    ("interval_intersects(make_interval(5, 1), make_interval(1, 5))", False),
    # time
    ("parse_timestamp('1970-01-01T00:01:00Z')", 60.0), ("format_timestamp(60)", "1970-01-01T00:01:00+00:00"), ("format_timestamp(0.5)", "1970-01-01T00:00:00.500+00:00"),
    ("format_timestamp(0, 'Asia/Tokyo')", "1970-01-01T09:00:00+09:00"),
    # bytes
    ("encode_base64(bit_and(decode_base64('8A=='), decode_base64('Pw==')))", "MA=="), ("encode_base64(bit_or(decode_base64('8A=='), decode_base64('Dw==')))", "/w=="),
    ("encode_base64(bit_xor(decode_base64('/w=='), decode_base64('Dw==')))", "8A=="), ("encode_base64(bit_not(decode_base64('Dw==')))", "8A=="),
    ("encode_base64(pack_bits([true, true, true, true, false, false, false, false]))", "8A=="), ("unpack_bits(decode_base64('8A=='))", [True] * 4 + [False] * 4),
    # chance
    ("rand_float() < 1.0", True), ("rand_int(3, 3)", 3), ("rand_bernoulli(1.0)", True), ("rand_choose([7])", 7), ("length(rand_uuid_v1())", 36), ("length(rand_uuid_v4())", 36),
    ("length(rand_vec(4))", 4), ("now() > 1600000000.0", True),
]


def _plain(v):
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return pytest.approx(v, abs=1e-9) if isinstance(v, float) else v


def test_values(db):
    """All at once: one plan per twenty expressions."""
    for at in range(0, len(VALUES), 20):
        part = VALUES[at:at + 20]
        body = ", ".join(f"y{i} = {e}" for i, (e, _) in enumerate(part))
        head = ", ".join(f"y{i}" for i in range(len(part)))
        got = db.run(f"u[x] <- [[1]] ?[{head}] := u[x], {body}").first()
        for (e, want), v in zip(part, got):
            v = [list(x) if isinstance(x, (list, tuple)) else x for x in v] if isinstance(v, (list, tuple)) else v
            assert v == _plain(want) and (v is None) == (want is None), e
            assert isinstance(v, bool) == isinstance(want, bool), e


@pytest.mark.parametrize("expression", [
    "1 / 0", "1 % 0", "sqrt(-1)", "ln(0)", "asin(2)", "acosh(0)", "atanh(1)", "(0 - 2) ^ 0.5", "9223372036854775807 + 1", "null + 1", "'a' + 1", "1 < 'a'", "1 && true",
    "get([1], 5)", "slice_string('abc', 2, 1)", "assert(false)", "to_float('NAN')", "to_uuid('x')", "validity(9223372036854775807)", "cos_dist(vec([0]), vec([1]))",
    "vec([1, 2]) + vec([1])", "regex_matches('a', '(?=b)')", "regex_matches('a', '(')", "parse_json('{')", "lowercase(null)", "rand_bernoulli(2)", "slice([1], 0, 3)",
])
def test_refusals(value, expression):
    from pyspark.errors import PySparkException

    with pytest.raises((Refusal, PySparkException)):
        value(expression)


def test_every_function_is_known():
    from tessera.functions.scalar import REGISTRY

    used = " ".join(e for e, _ in VALUES)
    operators = {"eq", "neq", "gt", "ge", "lt", "le", "and", "or", "negate", "coalesce", "sub", "mul", "div", "mod", "pow", "minus"}
    untested = {n for n in REGISTRY if f"{n}(" not in used} - operators
    assert not untested and len(REGISTRY) >= 149


def test_numbers_in_literals(value):
    assert value("0xff") == 255 and value("0b101") == 5 and value("0o17") == 15 and value("1_000") == 1000 and value("1e3") == 1000.0
    assert value("'it\\'s'") == "it's" and value('___"raw "quoted" text"___') == 'raw "quoted" text'
    assert json.loads(value("dump_json({'a': {'b': [1, null]}})")) == {"a": {"b": [1, None]}}


def test_asinh_is_accurate_near_zero(db):
    import math

    xs = [n * 0.01 / 20000 for n in range(-1999, 2000, 2)]
    db.attach("xs", db.spark.createDataFrame(list(enumerate(xs)), "i long, x double"), ["i"])
    got = dict(map(tuple, db.run("?[i, y] := *xs{i, x}, y = asinh(x)").collect()))
    assert max(abs(got[i] - math.asinh(x)) / abs(x) for i, x in enumerate(xs)) < 1e-15
