"""The scalar functions of the language as Spark column expressions.

A builder gets a typing context and argument columns.  Values the language
refuses (nulls in arithmetic, domain errors) raise inside the query: guards are
``coalesce(x, raise_error(...))`` or ``CASE``, which evaluate lazily, so no
later optimisation can hoist them.  Python is used only where Spark has no
expression (normal forms, JSON surgery, base-64 vectors, time-based ids).
"""

import json
import math
import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tessera.errors import TypeRefusal, UnknownName

REGISTRY: dict[str, tuple] = {}
NUMBERS = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DoubleType, T.DecimalType)
INTS = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
D = "double"


def arrow(kind: str):
    """A pandas UDF that is made on its first use, when a session exists."""
    def wrap(f):
        made: list = []

        def call(*cols):
            if not made:
                made.append(F.pandas_udf(f, kind))
            return made[0](*cols)

        return call

    return wrap


def fn(*names: str, least: int = 1, most: int | None = None):
    def add(f):
        for n in names:
            REGISTRY[n] = (f, least, least if most is None else most)
        return f

    return add


def build(ctx, name: str, args: list[Column]) -> Column:
    if name not in REGISTRY:
        raise UnknownName(f"no function {name}")
    f, least, most = REGISTRY[name]
    if not least <= len(args) <= most:
        raise TypeRefusal(f"{name} takes {least} to {most} arguments, not {len(args)}")
    return f(ctx, *args)


def refuse(message: str) -> Column:
    return F.raise_error(F.lit(message))


def need(x: Column, what: str) -> Column:
    return F.coalesce(x, refuse(f"'{what}' refuses null"))


def guard(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(refuse(message))


def is_list(ctx, c) -> bool:
    return isinstance(ctx.type(c), T.ArrayType)


def is_int(ctx, c) -> bool:
    return isinstance(ctx.type(c), INTS)


def number(ctx, c, what):
    t = ctx.type(c)
    if not isinstance(t, (*NUMBERS, T.NullType)):
        raise TypeRefusal(f"'{what}' requires numbers, not {t.simpleString()}")
    return need(c.cast("bigint") if isinstance(t, INTS) else c.cast(D), what)


def _each(ctx, a, b, op, what):
    """op on numbers, vectors element by element, or a vector and a number."""
    va, vb = is_list(ctx, a), is_list(ctx, b)
    if va and vb:
        return guard(F.size(a) == F.size(b), F.zip_with(a, b, op), f"'{what}' needs vectors of one length")
    if va:
        return F.transform(need(a, what), lambda x: op(x, need(b, what)))
    if vb:
        return F.transform(need(b, what), lambda x: op(need(a, what), x))
    return op(number(ctx, a, what), number(ctx, b, what))


def _fold(name, op, unit):
    def f(ctx, *args):
        if not args:
            return F.lit(unit).cast("bigint")
        out = args[0] if len(args) > 1 else (args[0] if is_list(ctx, args[0]) else number(ctx, args[0], name))
        for a in args[1:]:
            out = _each(ctx, out, a, op, name)
        return out

    fn(name, least=0, most=64)(f)


_fold("add", lambda a, b: a + b, 0)
_fold("mul", lambda a, b: a * b, 1)
fn("sub", least=2)(lambda c, a, b: _each(c, a, b, lambda x, y: x - y, "sub"))
fn("div", least=2)(lambda c, a, b: _each(c, a, b, lambda x, y: x.cast(D) / y.cast(D), "div"))
fn("mod", least=2)(lambda c, a, b: number(c, a, "mod") % number(c, b, "mod"))
fn("minus")(lambda c, a: F.transform(a, lambda x: -x) if is_list(c, a) else -number(c, a, "minus"))


@fn("pow", least=2)
def _pow(c, a, b):
    def op(x, y):
        x, y = x.cast(D), y.cast(D)
        ok = ~((x < 0) & (y != F.floor(y))) & ~((x == 0) & (y < 0))
        return guard(ok, F.pow(x, y), "'pow' outside its domain")

    return _each(c, a, b, op, "pow")


fn("abs")(lambda c, a: F.abs(number(c, a, "abs")))
fn("signum")(lambda c, a: F.signum(number(c, a, "signum")).cast("bigint" if is_int(c, a) else D))
fn("floor")(lambda c, a: number(c, a, "floor") if is_int(c, a) else F.floor(number(c, a, "floor")).cast(D))
fn("ceil")(lambda c, a: number(c, a, "ceil") if is_int(c, a) else F.ceil(number(c, a, "ceil")).cast(D))
fn("round")(lambda c, a: number(c, a, "round") if is_int(c, a) else F.round(number(c, a, "round"), 0))
fn("max", least=1, most=64)(lambda c, *a: number(c, a[0], "max") if len(a) == 1 else F.greatest(*[number(c, x, "max") for x in a]))
fn("min", least=1, most=64)(lambda c, *a: number(c, a[0], "min") if len(a) == 1 else F.least(*[number(c, x, "min") for x in a]))


def _real(name, f, ok=None, lists=True):
    def g(c, a):
        def one(x):
            x = x.cast(D)
            return f(x) if ok is None else guard(ok(x), f(x), f"'{name}' outside its domain")

        return F.transform(a, one) if lists and is_list(c, a) else one(number(c, a, name))

    fn(name)(g)


def _asinh(x):
    """By ``log1p`` of the size: Spark's ``asinh`` is off by about 1e-16 whatever the size, and so wrong near zero."""
    a = F.abs(x)
    return F.when(a < 1, F.signum(x) * F.log1p(a + a * a / (1 + F.sqrt(a * a + 1)))).otherwise(F.asinh(x))


for _n, _f, _ok in (
    ("exp", F.exp, None), ("exp2", lambda x: F.pow(F.lit(2.0), x), None), ("ln", F.log, lambda x: x > 0), ("log2", F.log2, lambda x: x > 0),
    ("log10", F.log10, lambda x: x > 0), ("sqrt", F.sqrt, lambda x: x >= 0), ("sin", F.sin, None), ("cos", F.cos, None), ("tan", F.tan, None),
    ("asin", F.asin, lambda x: F.abs(x) <= 1), ("acos", F.acos, lambda x: F.abs(x) <= 1), ("atan", F.atan, None), ("sinh", F.sinh, None),
    ("cosh", F.cosh, None), ("tanh", F.tanh, None), ("asinh", _asinh, None), ("acosh", F.acosh, lambda x: x >= 1),
    ("atanh", F.atanh, lambda x: F.abs(x) < 1), ("deg_to_rad", F.radians, None), ("rad_to_deg", F.degrees, None),
):
    _real(_n, _f, _ok)
fn("atan2", least=2)(lambda c, a, b: F.atan2(number(c, a, "atan2").cast(D), number(c, b, "atan2").cast(D)))


# -- bytes
def _bytewise(b: Column, f) -> Column:
    """Bytes from ``f(position)``, a number per byte of ``b``."""
    pairs = F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.lpad(F.hex(f(i)), 2, "0"))
    return F.when(F.octet_length(b) == 0, b).otherwise(F.unhex(F.array_join(pairs, "")))


def _byte(b: Column, i: Column) -> Column:
    return F.conv(F.substr(F.hex(b), 2 * i - 1, F.lit(2)), 16, 10).cast("bigint")


for _n, _op in (("bit_and", "bitwiseAND"), ("bit_or", "bitwiseOR"), ("bit_xor", "bitwiseXOR")):
    fn(_n, least=2)(lambda c, a, b, op=_op: guard(F.octet_length(a) == F.octet_length(b), _bytewise(a, lambda i: getattr(_byte(a, i), op)(_byte(b, i))), "byte strings of one length are wanted"))
fn("bit_not")(lambda c, a: _bytewise(a, lambda i: F.lit(255) - _byte(a, i)))


@fn("pack_bits")
def _pack(c, a):
    n = F.ceil(F.size(a) / 8).cast("int")
    bit = lambda i, k: F.when(F.coalesce(F.get(a, (i - 1) * 8 + k), F.lit(False)), 1 << (7 - k)).otherwise(0)
    hexes = F.transform(F.sequence(F.lit(1), n), lambda i: F.lpad(F.hex(sum((bit(i, k) for k in range(1, 8)), bit(i, 0)).cast("bigint")), 2, "0"))
    return F.when(F.size(a) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(hexes, "")))


@fn("unpack_bits")
def _unpack(c, a):
    bits = F.transform(F.sequence(F.lit(1), F.octet_length(a)), lambda i: F.transform(F.array(*[F.lit(1 << (7 - k)) for k in range(8)]), lambda m: _byte(a, i).bitwiseAND(m.cast("bigint")) != 0))
    return F.when(F.octet_length(a) == 0, F.array().cast("array<boolean>")).otherwise(F.flatten(bits))


fn("decode_base64")(lambda c, a: F.unbase64(a))
fn("encode_base64")(lambda c, a: F.regexp_replace(F.base64(a), "[\r\n]", ""))


# -- comparison and logic
def _same_kind(c, a, b, what):
    ta, tb = c.type(a), c.type(b)
    if isinstance(ta, T.NullType) or isinstance(tb, T.NullType) or isinstance(ta, NUMBERS) and isinstance(tb, NUMBERS) or type(ta) is type(tb):
        return
    raise TypeRefusal(f"'{what}' compares values of one kind, not {ta.simpleString()} and {tb.simpleString()}")


def _equal(c, a, b):
    ta, tb = c.type(a), c.type(b)
    if isinstance(ta, T.NullType) or isinstance(tb, T.NullType) or type(ta) is type(tb) or isinstance(ta, NUMBERS) and isinstance(tb, NUMBERS):
        return a.eqNullSafe(b)
    return F.coalesce(a.isNull() & b.isNull(), F.lit(False))


def _ordered(name, op):
    def f(c, a, b):
        _same_kind(c, a, b, name)
        return op(need(a, name), need(b, name))

    fn(name, least=2)(f)


fn("eq", least=2)(_equal)
fn("neq", least=2)(lambda c, a, b: ~_equal(c, a, b))
_ordered("gt", lambda a, b: a > b)
_ordered("ge", lambda a, b: a >= b)
_ordered("lt", lambda a, b: a < b)
_ordered("le", lambda a, b: a <= b)


def boolean(c, a, what):
    if not isinstance(c.type(a), (T.BooleanType, T.NullType)):
        raise TypeRefusal(f"'{what}' requires booleans, not {c.type(a).simpleString()}")
    return need(a, what)


@fn("and", least=0, most=64)
def _and(c, *args):
    out = F.lit(True)
    for a in reversed(args):  # a guard on the left keeps what is right of it from running
        out = F.when(boolean(c, a, "and"), out).otherwise(F.lit(False))
    return out


@fn("or", least=0, most=64)
def _or(c, *args):
    out = F.lit(False)
    for a in reversed(args):
        out = F.when(boolean(c, a, "or"), F.lit(True)).otherwise(out)
    return out


fn("negate")(lambda c, a: ~boolean(c, a, "negate"))
fn("coalesce", least=1, most=64)(lambda c, *a: F.coalesce(*a))
fn("if", least=2, most=3)(lambda c, q, a, b=None: F.when(boolean(c, q, "if"), a).otherwise(b if b is not None else F.lit(None)))


@fn("cond", least=2, most=64)
def _cond(c, *a):
    out = a[-1] if len(a) % 2 else F.lit(None)
    pairs = list(zip(a[::2], a[1::2]))
    for q, v in reversed(pairs):
        out = F.when(boolean(c, q, "cond"), v).otherwise(out)
    return out


@fn("is_in", least=2)
def _is_in(c, a, b):
    return F.when(a.isNull(), F.exists(b, lambda x: x.isNull())).otherwise(F.coalesce(F.array_contains(b, a), F.lit(False)))


fn("assert", least=1, most=64)(lambda c, a, *m: guard(boolean(c, a, "assert"), F.lit(True), "assertion failed"))
fn("is_null")(lambda c, a: a.isNull())


def _kind(name, kinds):
    fn(name)(lambda c, a: a.isNotNull() if isinstance(c.type(a), kinds) else F.lit(False))


_kind("is_int", INTS)
_kind("is_float", (T.FloatType, T.DoubleType))
_kind("is_num", NUMBERS)
_kind("is_string", T.StringType)
_kind("is_list", T.ArrayType)
_kind("is_bytes", T.BinaryType)
_kind("is_json", T.VariantType)
fn("is_vec")(lambda c, a: a.isNotNull() if is_list(c, a) and isinstance(c.type(a).elementType, (T.FloatType, T.DoubleType)) else F.lit(False))
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
fn("is_uuid")(lambda c, a: F.coalesce(a.rlike(UUID), F.lit(False)) if isinstance(c.type(a), T.StringType) else F.lit(False))
fn("is_finite")(lambda c, a: F.coalesce(~F.isnan(a.cast(D)) & (F.abs(a.cast(D)) < float("inf")), F.lit(False)) if isinstance(c.type(a), NUMBERS) else F.lit(False))
fn("is_infinite")(lambda c, a: F.coalesce(F.abs(a.cast(D)) == float("inf"), F.lit(False)) if isinstance(c.type(a), NUMBERS) else F.lit(False))
fn("is_nan")(lambda c, a: F.coalesce(F.isnan(a.cast(D)), F.lit(False)) if isinstance(c.type(a), NUMBERS) else F.lit(False))


# -- conversion
def _truth(c, a):
    t = c.type(a)
    if isinstance(t, T.BooleanType):
        ok = a
    elif isinstance(t, NUMBERS):
        ok = a != 0
    elif isinstance(t, T.ArrayType):
        ok = F.size(a) > 0
    elif isinstance(t, T.BinaryType):
        ok = F.octet_length(a) > 0
    elif isinstance(t, T.StringType):
        ok = F.length(a) > 0
    else:
        ok = a.isNotNull()
    return F.coalesce(ok, F.lit(False))


fn("to_bool")(_truth)
fn("to_unity")(lambda c, a: F.when(_truth(c, a), 1).otherwise(0).cast("bigint"))


@fn("to_int")
def _to_int(c, a):
    t = c.type(a)
    if isinstance(t, T.StructType):
        return F.coalesce(a["ts"], F.lit(0).cast("bigint"))
    return F.coalesce(a.cast("bigint"), F.when(a.isNull(), F.lit(0).cast("bigint")))


@fn("to_float")
def _to_float(c, a):
    if not isinstance(c.type(a), T.StringType):
        return F.coalesce(a.cast(D), F.lit(0.0))
    named = {"PI": math.pi, "E": math.e, "INF": math.inf, "NEG_INF": -math.inf}
    out = F.when(a.isNull(), F.lit(0.0))
    for k, v in named.items():
        out = out.when(a == k, F.lit(v))
    return out.when(a == "NAN", refuse("NaN is refused")).otherwise(a.cast(D))


@fn("to_string")
def _to_string(c, a):
    t = c.type(a)
    if isinstance(t, T.StringType):
        return F.coalesce(a, F.lit("null"))
    if isinstance(t, T.VariantType):
        return F.to_json(a)
    if isinstance(t, (T.ArrayType, T.StructType)):
        return F.coalesce(F.to_json(a), F.lit("null"))
    return F.coalesce(a.cast("string"), F.lit("null"))


fn("to_uuid")(lambda c, a: guard(a.rlike(UUID), F.lower(a), "not a UUID"))


@fn("uuid_timestamp")
def _uuid_timestamp(c, a):
    ticks = F.conv(F.concat(F.substr(a, F.lit(16), F.lit(3)), F.substr(a, F.lit(10), F.lit(4)), F.substr(a, F.lit(1), F.lit(8))), 16, 10).cast(D)
    return F.when(F.substr(a, F.lit(15), F.lit(1)) == "1", (ticks - 0x01B21DD213814000) / 1e7)


@fn("validity", least=1, most=2)
def _validity(c, ts, flag=None):
    ts = guard(ts.cast("bigint") != 2**63 - 1, ts.cast("bigint"), "that instant is reserved")
    return F.struct(ts.alias("ts"), (flag if flag is not None else F.lit(True)).alias("assert"))


@arrow("array<double>")
def _vector_bytes(s: pd.Series) -> pd.Series:
    import base64

    import numpy as np

    return s.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4").astype(float).tolist())


@fn("vec", least=1, most=2)
def _vec(c, a, kind=None):
    if isinstance(c.type(a), T.StringType):
        return _vector_bytes(a)
    wide = kind is not None and "F64" in str(kind)
    return a.cast("array<double>") if wide else a.cast("array<float>").cast("array<double>")


# -- strings
SPACE = r"[\s\u0085   -     　]+"
fn("lowercase")(lambda c, a: F.lower(need(a, "lowercase")))
fn("uppercase")(lambda c, a: F.upper(need(a, "uppercase")))
fn("trim")(lambda c, a: F.regexp_replace(a, f"^{SPACE}|{SPACE}$", ""))
fn("trim_start")(lambda c, a: F.regexp_replace(a, f"^{SPACE}", ""))
fn("trim_end")(lambda c, a: F.regexp_replace(a, f"{SPACE}$", ""))
fn("starts_with", least=2)(lambda c, a, b: F.startswith(need(a, "starts_with"), need(b, "starts_with")))
fn("ends_with", least=2)(lambda c, a, b: F.endswith(need(a, "ends_with"), need(b, "ends_with")))
fn("str_includes", least=2)(lambda c, a, b: F.contains(need(a, "str_includes"), need(b, "str_includes")))
fn("chars")(lambda c, a: F.when(a == "", F.array().cast("array<string>")).otherwise(F.split(a, "")))
fn("from_substrings")(lambda c, a: F.array_join(a, ""))
fn("slice_string", least=3)(lambda c, s, m, n: guard((m >= 0) & (n >= m), F.substr(s, m.cast("int") + 1, (n - m).cast("int")), "'slice_string' needs 0 <= m <= n"))


@arrow("string")
def _normal(s: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize(f.upper(), x) for x, f in zip(s, form)])


fn("unicode_normalize", least=2)(lambda c, a, f: _normal(a, f))
TRADITIONAL = "國學會來時對說過還個們這東車馬書長門問開關電話語言讀寫聽見買賣錢銀鐵點幾歲萬與為從來發髮頭體風飛魚鳥龍龜麥麵黃齊齒愛礙優億儀偉傳傷倫兒內兩冊凍則剛劃劇劉動務勝勞勢區醫華協單卻廠歷壓縣參雙變葉號吳員嗎園圖圓團國聖場壞塊報壽夢奪奮婦孫學寧實寫寬寶將導屆層歲島師帶幫幣廣應廢張強彈彙後徑復態懷戰戲擔據擇擊擴擺攝敗敘數斷無舊曉書會條極構標樣樹橋機權歡歐歸殘殺決沒況淚淺減測湯準溝漢滅滿漸濟灣災燈燒營爭牆狀獎獨獲現環產畫當療發監盤眾睜確礎禮種積穩窮競筆節範築簡類糧約紅紀純紙級細終組結統絲經維綱網緊線編緣練縮總績織繼續罰羅義習聯職聲脫腦腳臉臨舉舊艱藝藥蘇處虛號蟲術衛裝製複見規視親覺觀觸計訂認討讓訓議記許論設訪證評識詞試詩話該詳語誤說請諸課調談謝譯護變豐貝負財責貨質購貴費資賽贊趕跡踐輕轉輪輸辦農運過達遠適遲選遺鄉鄧鄭釋針鋼錄錯鎮長門閃閉問間閱隊陽階際陸陰險隨隱難雜離電靈靜響項順須預領頻題額顏願類風飯飲館驗驚鬥鬧魯鮮麗黨"
SIMPLIFIED = "国学会来时对说过还个们这东车马书长门问开关电话语言读写听见买卖钱银铁点几岁万与为从来发发头体风飞鱼鸟龙龟麦面黄齐齿爱碍优亿仪伟传伤伦儿内两册冻则刚划剧刘动务胜劳势区医华协单却厂历压县参双变叶号吴员吗园图圆团国圣场坏块报寿梦夺奋妇孙学宁实写宽宝将导届层岁岛师带帮币广应废张强弹汇后径复态怀战戏担据择击扩摆摄败叙数断无旧晓书会条极构标样树桥机权欢欧归残杀决没况泪浅减测汤准沟汉灭满渐济湾灾灯烧营争墙状奖独获现环产画当疗发监盘众睁确础礼种积稳穷竞笔节范筑简类粮约红纪纯纸级细终组结统丝经维纲网紧线编缘练缩总绩织继续罚罗义习联职声脱脑脚脸临举旧艰艺药苏处虚号虫术卫装制复见规视亲觉观触计订认讨让训议记许论设访证评识词试诗话该详语误说请诸课调谈谢译护变丰贝负财责货质购贵费资赛赞赶迹践轻转轮输办农运过达远适迟选遗乡邓郑释针钢录错镇长门闪闭问间阅队阳阶际陆阴险随隐难杂离电灵静响项顺须预领频题额颜愿类风饭饮馆验惊斗闹鲁鲜丽党"
fn("t2s")(lambda c, a: F.translate(a, TRADITIONAL, SIMPLIFIED))


def pattern(p: Column) -> str:
    """A literal pattern; look-around and back-references are refused."""
    text = getattr(p, "literal", None)
    if text is None:
        raise TypeRefusal("a pattern must be a constant")
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", text):
        raise TypeRefusal("look-around and back-references are refused")
    try:
        re.compile(text)
    except re.error as e:
        raise TypeRefusal(f"bad pattern: {e}") from None
    return text


@fn("regex")
def _regex(c, p):
    out = F.lit(pattern(p))
    out.literal = pattern(p)
    return out


fn("regex_matches", least=2)(lambda c, a, p: need(a, "regex_matches").rlike(pattern(p)))
fn("regex_replace", least=3)(lambda c, a, p, r: F.regexp_replace(a, F.lit(f"(?s)^(.*?)(?:{pattern(p)})"), F.concat(F.lit("$1"), r)))
fn("regex_replace_all", least=3)(lambda c, a, p, r: F.regexp_replace(a, F.lit(pattern(p)), r))
fn("regex_extract", least=2)(lambda c, a, p: F.regexp_extract_all(a, F.lit(pattern(p)), F.lit(0)))
fn("regex_extract_first", least=2)(lambda c, a, p: F.regexp_substr(a, F.lit(pattern(p))))


# -- lists
fn("list", least=0, most=4096)(lambda c, *a: F.array(*a))
fn("first")(lambda c, a: F.try_element_at(a, F.lit(1)))
fn("last")(lambda c, a: F.try_element_at(a, F.lit(-1)))


def _at(c, a, i):
    t = c.type(a)
    if isinstance(t, T.ArrayType):
        return F.get(a, F.when(i < 0, F.size(a) + i).otherwise(i).cast("int"))
    key = getattr(i, "literal", None)
    path = "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in (key if isinstance(key, list) else [key]))
    if isinstance(t, T.VariantType):
        return F.try_variant_get(a, path, "variant")
    return F.get_json_object(a, path)


fn("maybe_get", least=2)(_at)
fn("get", least=2, most=3)(lambda c, a, i, d=None: F.coalesce(_at(c, a, i), d if d is not None else refuse("'get' outside its range")))


@fn("length")
def _length(c, a):
    t = c.type(a)
    size = F.size(a) if isinstance(t, T.ArrayType) else F.octet_length(a) if isinstance(t, T.BinaryType) else F.length(a)
    return need(size.cast("bigint"), "length")


@fn("slice", least=3)
def _slice(c, a, m, n):
    m, n = F.when(m < 0, F.size(a) + m).otherwise(m), F.when(n < 0, F.size(a) + n).otherwise(n)
    ok = (m >= 0) & (n >= m) & (n <= F.size(a))
    return guard(ok, F.slice(a, (m + 1).cast("int"), (n - m).cast("int")), "'slice' outside its range")


@arrow("string")
def _merged(a: pd.Series, b: pd.Series) -> pd.Series:
    def deep(x, y):
        if isinstance(x, dict) and isinstance(y, dict):
            return {**x, **{k: deep(x[k], v) if k in x else v for k, v in y.items()}}
        return x + y if isinstance(x, list) and isinstance(y, list) else y

    return pd.Series([json.dumps(deep(json.loads(x), json.loads(y)), sort_keys=True, separators=(",", ":")) for x, y in zip(a, b)])


@fn("concat", least=1, most=64)
def _concat(c, *args):
    if any(isinstance(c.type(a), T.VariantType) for a in args):
        out = F.to_json(args[0])
        for a in args[1:]:
            out = _merged(out, F.to_json(a))
        return F.parse_json(out)
    return F.concat(*[need(a, "concat") for a in args])


fn("append", least=2)(lambda c, a, x: F.array_append(a, x))
fn("prepend", least=2)(lambda c, a, x: F.array_prepend(a, x))
fn("reverse")(lambda c, a: F.reverse(a))
fn("sorted")(lambda c, a: F.sort_array(a))


def _pieces(a, n, starts):
    return F.transform(starts, lambda i: F.slice(a, i, n))


def _starts(a, count, step):
    none = F.array().cast("array<int>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: (i * step + 1).cast("int"))).otherwise(none)


fn("chunks", least=2)(lambda c, a, n: _pieces(a, n.cast("int"), _starts(a, F.ceil(F.size(a) / n), n)))
fn("chunks_exact", least=2)(lambda c, a, n: _pieces(a, n.cast("int"), _starts(a, F.floor(F.size(a) / n), n)))
fn("windows", least=2)(lambda c, a, n: _pieces(a, n.cast("int"), _starts(a, F.size(a) - n + 1, F.lit(1))))


def _sets(name, op):
    def f(c, *a):
        out = a[0]
        for x in a[1:]:
            out = op(out, x)
        return F.sort_array(F.array_distinct(out))

    fn(name, least=2 if name == "difference" else 1, most=64)(f)


_sets("union", F.array_union)
_sets("intersection", F.array_intersect)
_sets("difference", F.array_except)


@fn("int_range", least=1, most=3)
def _int_range(c, a, b=None, step=None):
    lo, hi, by = (F.lit(0), a, F.lit(1)) if b is None else (a, b, F.lit(1) if step is None else step)
    lo, hi, by = (x.cast("bigint") for x in (lo, hi, by))
    last = F.when(by > 0, hi - 1).otherwise(hi + 1)
    some = F.when(by > 0, lo < hi).when(by < 0, lo > hi).otherwise(refuse("a step of 0"))
    return F.when(some, F.sequence(lo, last, by)).otherwise(F.array().cast("array<bigint>"))


# -- JSON
def _as_json(c, a):
    t = c.type(a)
    if isinstance(t, T.VariantType):
        return a
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.parse_json(F.to_json(a))
    return F.parse_json(F.coalesce(F.get_json_object(F.to_json(F.struct(a.alias("x"))), "$.x"), F.lit("null"))) if not isinstance(t, T.StringType) else F.parse_json(
        F.regexp_extract(F.to_json(F.struct(a.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


fn("json")(_as_json)
fn("parse_json")(lambda c, a: F.parse_json(need(a, "parse_json")))
fn("dump_json")(lambda c, a: F.to_json(a) if isinstance(c.type(a), T.VariantType) else F.to_json(_as_json(c, a)))


@fn("json_object", least=0, most=256)
def _json_object(c, *a):
    if not a:
        return F.parse_json(F.lit("{}"))
    pairs = [F.concat(F.regexp_extract(F.to_json(F.struct(k.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit(":"), F.to_json(_as_json(c, v))) for k, v in zip(a[::2], a[1::2])]
    return F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")))


@fn("json_to_scalar")
def _json_to_scalar(c, a):
    return F.try_variant_get(a, "$", "string")


def _surgery(edit):
    @arrow("string")
    def run(doc: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(edit(json.loads(d), json.loads(p), json.loads(v)), sort_keys=True, separators=(",", ":")) for d, p, v in zip(doc, path, value)])

    return run


def _set_path(doc, path, value):
    if not path:
        return value
    k, *rest = path
    if isinstance(k, int):
        doc = doc if isinstance(doc, list) else []
        doc += [None] * (k + 1 - len(doc))
    else:
        doc = doc if isinstance(doc, dict) else {}
    old = doc[k] if isinstance(k, int) else doc.get(k)
    doc[k] = _set_path(old, rest, value)
    return doc


def _remove_path(doc, path, _):
    at = doc
    for k in path[:-1]:
        at = at[k]
    if isinstance(at, list) and not 0 <= path[-1] < len(at):
        raise ValueError("no such slot in the JSON array")
    at.pop(path[-1]) if isinstance(at, list) else at.pop(path[-1], None)
    return doc


def _path_text(path):
    key = getattr(path, "literal", None)
    if not isinstance(key, list):
        raise TypeRefusal("a JSON path must be a constant list")
    return F.lit(json.dumps(key))


fn("set_json_path", least=3)(lambda c, d, p, v: F.parse_json(_surgery(_set_path)(F.to_json(_as_json(c, d)), _path_text(p), F.to_json(_as_json(c, v)))))
fn("remove_json_path", least=2)(lambda c, d, p: F.parse_json(_surgery(_remove_path)(F.to_json(_as_json(c, d)), _path_text(p), F.lit("null"))))


# -- vectors and places
def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast(D) * y.cast(D)), F.lit(0.0), lambda s, x: s + x)


def l2(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast(D) - y.cast(D)) * (x.cast(D) - y.cast(D))), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    n = dot(a, a) * dot(b, b)
    return guard(n > 0, 1 - dot(a, b) / F.sqrt(n), "a zero vector has no direction")


fn("l2_dist", least=2)(lambda c, a, b: l2(a, b))
fn("ip_dist", least=2)(lambda c, a, b: 1 - dot(a, b))
fn("cos_dist", least=2)(lambda c, a, b: cosine(a, b))
fn("l2_normalize")(lambda c, a: guard(dot(a, a) > 0, F.transform(a, lambda x: x.cast(D) / F.sqrt(dot(a, a))), "a zero vector has no direction"))


def haversine(a, b, p, q):
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.pow(F.sin((a - p) / 2), 2) + F.cos(a) * F.cos(p) * F.pow(F.sin((b - q) / 2), 2))))


fn("haversine", least=4)(lambda c, *a: haversine(*[number(c, x, "haversine").cast(D) for x in a]))
fn("haversine_deg_input", least=4)(lambda c, *a: haversine(*[F.radians(number(c, x, "haversine").cast(D)) for x in a]))


# -- intervals: struct(empty, lo, hi) with null ends unbounded
@fn("make_interval", least=2)
def _interval(c, s, e):
    empty = F.coalesce(s > e, F.lit(False))
    end = lambda x: F.when(~empty, x.cast("bigint")).alias
    return F.struct(empty.alias("empty"), end(s)("lo"), end(e)("hi"))


fn("interval_start")(lambda c, i: i["lo"])
fn("interval_end")(lambda c, i: i["hi"])
fn("interval_has_start")(lambda c, i: ~i["empty"] & i["lo"].isNotNull())
fn("interval_has_end")(lambda c, i: ~i["empty"] & i["hi"].isNotNull())
fn("interval_is_start_unbounded")(lambda c, i: ~i["empty"] & i["lo"].isNull())
fn("interval_is_end_unbounded")(lambda c, i: ~i["empty"] & i["hi"].isNull())


def _relation(name, test):
    def f(c, a, b):
        low, high = (F.lit(str(x)).cast("decimal(21,0)") for x in (-(2**63), 2**63))
        ends = [F.coalesce(i[k].cast("decimal(21,0)"), v) for i in (a, b) for k, v in (("lo", low - 1), ("hi", high))]
        return ~a["empty"] & ~b["empty"] & test(*ends)

    fn(name, least=2)(f)


_relation("interval_before", lambda al, ah, bl, bh: ah + 1 < bl)
_relation("interval_meets", lambda al, ah, bl, bh: ah + 1 == bl)
_relation("interval_overlaps", lambda al, ah, bl, bh: (al < bl) & (bl <= ah) & (ah < bh))
_relation("interval_starts", lambda al, ah, bl, bh: (al == bl) & (ah < bh))
_relation("interval_during", lambda al, ah, bl, bh: (bl < al) & (ah < bh))
_relation("interval_finishes", lambda al, ah, bl, bh: (ah == bh) & (al > bl))
_relation("interval_intersects", lambda al, ah, bl, bh: (al <= bh) & (bl <= ah))


# -- time and chance
@fn("format_timestamp", least=1, most=2)
def _format_timestamp(c, a, tz=None):
    seconds = a["ts"] / 1e6 if isinstance(c.type(a), T.StructType) else a
    micros = F.round(seconds * 1000000, 0).cast("bigint")
    local = F.timestamp_micros(micros)
    local = F.from_utc_timestamp(local, tz) if tz is not None else local
    part = F.pmod(micros, F.lit(1000000))
    text = F.when(part == 0, F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")).when(part % 1000 == 0, F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS")).otherwise(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if tz is None:
        return F.concat(text, F.lit("+00:00"))
    offset = F.unix_micros(local) - micros
    minutes = (F.abs(offset) / 60000000).cast("bigint")
    return F.concat(text, F.when(offset < 0, "-").otherwise("+"), F.lpad((minutes / 60).cast("bigint").cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


fn("parse_timestamp")(lambda c, a: F.unix_micros(a.cast("timestamp")) / 1000000.0)
fn("now", least=0)(lambda c: F.unix_micros(F.current_timestamp()) / 1000000.0)
fn("rand_float", least=0)(lambda c: F.rand())
fn("rand_int", least=2)(lambda c, a, b: F.floor(F.rand() * (b - a + 1)).cast("bigint") + a)
fn("rand_bernoulli")(lambda c, p: guard((p >= 0) & (p <= 1), F.rand() < p, "a probability is wanted"))
fn("rand_choose")(lambda c, a: F.get(a, F.floor(F.rand() * F.size(a)).cast("int")))
fn("rand_uuid_v4", least=0)(lambda c: F.expr("uuid()"))


@arrow("string")
def _uuid1(x: pd.Series) -> pd.Series:
    return x.map(lambda _: str(uuid.uuid1()))


@arrow("array<double>")
def _rand_vec(n: pd.Series) -> pd.Series:
    import random

    return n.map(lambda k: [random.random() for _ in range(int(k))])


fn("rand_uuid_v1", least=0)(lambda c: _uuid1(F.rand()))
fn("rand_vec", least=1, most=2)(lambda c, n, kind=None: _rand_vec(n))
