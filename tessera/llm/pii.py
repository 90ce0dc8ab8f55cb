"""Format-preserving pseudonyms for personal values, in DataFrame functions.

Found values: e-mail addresses, IPv4 addresses, payment card numbers (13 to 19
digits that pass the Luhn check), phone numbers, US social security numbers,
and calendar dates.  Numbers and dates are validated first and then permuted
within their format by an eight-round Feistel network keyed with SHA-256:
digits keep their places between the same separators, cards keep a valid check
digit, phones their country code, security numbers stay valid ones, addresses
stay addresses, dates stay dates.  The mapping is a keyed bijection per format,
so equal values stay equal in all documents and different ones different.  The
names of e-mail addresses have no fixed format: an address becomes a keyed
number of 12 digits at a reserved domain, by its lower-case form.
Dates with slashes are read day first and, where that is no date, month first.

Digit groups joined by single spaces or hyphens are taken as one run, and cards
are looked for at all its group boundaries: the usual layouts first (unbroken,
fours, 4-6-5 and 4-6-4), then others of groups of three digits or more, then
whole windows of 19 digits; the longest card of a start wins.  Phone numbers
within a run are found too; values of the other kinds end it.

Texts without a digit or an at sign pass untouched after one cheap test.

Defined results: null text stays null with counts of 0; empty text stays empty;
numbers that fail validation stay as they are; repeated rows get equal results;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import fresh

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Possessive and only from the start of a run, so that a long run without an address is read once.
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,99}\.[A-Za-z]{2,}"
IP = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\w)"
DATE = r"(?<![\w/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\w/-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\w-])"
#: A run of digit groups; possessive, so that long ones do not recurse.
CARD = rf"(?<![\w.])(?=\d(?:[ -]?\d){{12}})\d++(?!\w)(?:[ -](?!{EMAIL}|{IP}|{DATE}|{SSN})\d++(?!\w))*+"
ANY = "|".join((EMAIL, IP, DATE, SSN, PHONE, CARD))
LAYOUT = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5})$"
KINDS = ("email", "ip", "date", "ssn", "card", "phone")
ROUNDS = 8
#: Days from 1800-01-01 over 400 years, a whole calendar cycle: 27 * 5411.
FIRST_DAY, CYCLE = "1800-01-01", (27, 5411)


def _round(key: str, tag: Column, r: Column, x: Column) -> Column:
    """Round function: 60 bits of a keyed digest."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tag, r.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, tag: Column, a: Column, b: Column, top_a: Column, top_b: Column) -> Column:
    """Permutes pairs (a, b) of numbers below the tops; an unbalanced network."""
    def step(acc, r):
        left = F.pmod(acc["a"] + F.pmod(_round(key, tag, r, acc["b"]), acc["m"]), acc["m"])
        right = F.pmod(acc["b"] + F.pmod(_round(key, tag, r, acc["a"]), acc["n"]), acc["n"])
        even = r % 2 == 0
        return F.struct(F.when(even, left).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(right).alias("b"),
                        acc["m"].alias("m"), acc["n"].alias("n"))

    start = F.struct(*[c.cast("long").alias(n) for c, n in ((a, "a"), (b, "b"), (top_a, "m"), (top_b, "n"))])
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def permute_digits(key: str, tag: Column, digits: Column) -> Column:
    """Permutes digit strings of one length (2 to 18) and tag among themselves."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = feistel(key, F.concat(tag, n.cast("string")), F.substr(digits, F.lit(1), u), F.substr(digits, u + 1, n - u), power(u), power(n - u))
    return _let(out, lambda x: F.concat(F.lpad(x["a"].cast("string"), u, F.lit("0")), F.lpad(x["b"].cast("string"), n - u, F.lit("0"))))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit not doubled."""
    def add(acc, c):
        d = c.cast("int") * F.when(acc["odd"], 2).otherwise(1)
        return F.struct((acc["s"] + F.when(d > 9, d - 9).otherwise(d)).alias("s"), (~acc["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("s"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda a: a["s"])


def put_back(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order."""
    def add(acc, c):
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["s"], F.when(is_digit, F.substr(digits, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("s"),
                        (acc["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), add, lambda a: a["s"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _day(v: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")]).cast("date")


def kind_of(v: Column) -> Column:
    """Kind of a found value, or null where validation fails."""
    in_cycle = _day(v).between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date"))
    return (
        F.when(F.contains(v, F.lit("@")), "email")
        .when(v.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip")
        .when(v.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), F.when(in_cycle, "date"))
        .when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~v.rlike(r"^(?:000|666|9)|-00-|-0000$"), "ssn"))
        .when(v.rlike(r"^\+|\(|^\d{3}[ .-]\d{3}[ .-]\d{4}$"), "phone")
        .when(v.rlike(r"^[0-9 -]+$"), F.when(luhn_sum(_digits(v)) % 10 == 0, "card"))
    )


def pseudonym(key: str, v: Column, kind: Column) -> Column:
    """The pseudonym of a value of a known kind."""
    tag = lambda t: F.lit(t)
    address = F.lower(F.regexp_replace(v, "^[._%+-]+", ""))
    number = lambda salt, m: F.pmod(_round(key, F.lit(salt), F.lit(0), address if salt == "local" else F.substring_index(address, "@", -1)), F.lit(m))
    email = F.concat(F.regexp_extract(v, "^[._%+-]*", 0), F.lit("user"), F.lpad(number("local", 10**12).cast("string"), 12, "0"), F.lit("@d"),
                     F.lpad(number("domain", 10**6).cast("string"), 6, "0"), F.lit(".example"))
    octets = F.transform(F.split(v, r"\."), lambda o: o.cast("long"))
    ip = _let(feistel(key, tag("ip"), octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536)),
              lambda x: F.concat_ws(".", F.floor(x["a"] / 256).cast("string"), (x["a"] % 256).cast("string"),
                                    F.floor(x["b"] / 256).cast("string"), (x["b"] % 256).cast("string")))
    days = F.datediff(_day(v), F.lit(FIRST_DAY).cast("date")).cast("long")
    def move(salt, n):
        return _let(feistel(key, tag(salt), F.floor(n / CYCLE[1]), n % CYCLE[1], F.lit(CYCLE[0]), F.lit(CYCLE[1])), lambda x: x["a"] * CYCLE[1] + x["b"])

    on = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    moved = on(move("date", days))
    # month first is only read where the day is above 12: moved again until it is so, which is one-to-one among such days
    again = F.aggregate(F.sequence(F.lit(1), F.lit(64)), move("month first", days),
                        lambda n, _: F.when(F.dayofmonth(on(n)) > 12, n).otherwise(move("month first", n)))
    date = (F.when(v.rlike("^[0-9]{4}-"), F.date_format(moved, "yyyy-MM-dd"))
            .when(v.rlike("^[0-9]{2}/(?:1[3-9]|[2-9])"), F.date_format(on(again), "MM/dd/yyyy")).otherwise(F.date_format(moved, "dd/MM/yyyy")))
    d = _digits(v)
    body = permute_digits(key, tag("card"), F.substr(d, F.lit(1), F.length(d) - 1))
    card = put_back(v, _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))
    head = F.greatest(F.length(d) - 10, F.lit(0))
    phone = put_back(v, F.concat(F.substr(d, F.lit(1), head), permute_digits(key, tag("phone"), F.substr(d, head + 1, F.length(d) - head))))
    # areas 001 to 899 without 666, groups from 01, serials from 0001: numbered, permuted among themselves and written again
    n = lambda at, size: F.substr(d, F.lit(at), F.lit(size)).cast("long")
    two = lambda x, size: F.lpad(x.cast("string"), size, "0")
    ssn = put_back(v, _let(feistel(key, tag("ssn"), n(1, 3) - F.when(n(1, 3) > 666, 2).otherwise(1), (n(4, 2) - 1) * 9999 + n(6, 4) - 1, F.lit(898), F.lit(99 * 9999)),
                           lambda x: F.concat(two(x["a"] + F.when(x["a"] >= 665, 2).otherwise(1), 3), two(F.floor(x["b"] / 9999) + 1, 2), two(x["b"] % 9999 + 1, 4))))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "date", date).when(kind == "card", card)
            .when(kind == "phone", phone).when(kind == "ssn", ssn).otherwise(v))


def _part(v: Column, kind: Column) -> Column:
    return F.struct(v.alias("v"), kind.cast("string").alias("kind"))


def _run_parts(v: Column) -> Column:
    """Parts of a run of digit groups: its cards and phone numbers, and what is between."""
    def span(g, i, j):
        return F.array_join(F.slice(g, i, j - i + 1), "")

    def starts(g):
        """Per group: the longest end within 19 digits, and the values that start there, preferred ones first."""
        def at(_, i0):
            i = i0 + 1
            ends = F.transform(F.sequence(F.least(F.size(g), i + 18), i, F.lit(-1)), lambda j: _let(
                F.regexp_replace(span(g, i, j), "^[ -]", ""), lambda s: F.struct(j.alias("j"), s.alias("s"), _digits(s).alias("d"))))
            fits = F.filter(ends, lambda e: F.length(e["d"]).between(13, 19))

            def of(fit):
                rank = lambda e: F.when(e["s"].rlike(LAYOUT), 0).when(~e["s"].rlike(r"(?<!\d)\d{1,2}(?!\d)"), 1).otherwise(2)
                cards = F.transform(F.filter(fit, lambda e: luhn_sum(e["d"]) % 10 == 0), lambda e: F.struct(rank(e).alias("rank"), (-e["j"]).alias("j")))
                phone = F.concat(span(g, i, i + 2), F.coalesce(F.substring(F.get(g, i + 2), 1, 1), F.lit(""))).rlike(r"^[ -]?\d{3}[ -]\d{3}[ -]\d{4} ?$")
                phones = F.when(phone, F.array(F.struct(F.lit(3).alias("rank"), (-i - 2).alias("j")))).otherwise(F.filter(cards, lambda _: F.lit(False)))
                return F.struct(F.coalesce(F.get(fit, F.lit(0))["j"], F.lit(0)).alias("full"), F.array_sort(F.concat(cards, phones)).alias("found"))

            return _let(fits, of)

        return F.transform(g, at)

    def pick(s):
        usual = F.transform(s, lambda x: F.coalesce(F.get(x["found"], F.lit(0))["rank"] == 0, F.lit(False)))

        def step(u):
            def one(acc, i):
                x = F.get(s, i - 1)
                fresh = i > acc["win"]
                ok = F.filter(x["found"], lambda c: (c["rank"] == 0) | (
                    ((c["rank"] != 2) | (fresh & (-c["j"] == x["full"]))) & ~F.exists(F.slice(u, i + 1, -c["j"] - i), lambda y: y)))
                def then(c):
                    last = F.coalesce(-c["j"], F.lit(0))
                    return F.struct(F.greatest(acc["next"], last + 1).alias("next"), F.when(fresh, F.greatest(acc["win"], x["full"])).otherwise(acc["win"]).alias("win"),
                                    F.when(last > 0, F.concat(acc["picks"], F.array(F.struct(i.alias("i"), last.alias("j"), F.when(c["rank"] == 3, "phone").otherwise("card").alias("kind")))))
                                    .otherwise(acc["picks"]).alias("picks"))

                return F.when(i < acc["next"], acc).otherwise(_let(F.get(ok, F.lit(0)), then))

            start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("win"), F.array().cast("array<struct<i:int,j:int,kind:string>>").alias("picks"))
            return F.aggregate(F.sequence(F.lit(1), F.size(s)), start, one, lambda a: a["picks"])

        return _let(usual, step)

    def parts(g):
        def of(picks):
            each = F.transform(picks, lambda p, k: F.array(
                _part(F.concat(_let(F.when(k == 0, 0).otherwise(F.get(picks, k - 1)["j"]), lambda e: span(g, e + 1, p["i"] - 1)), F.regexp_extract(F.get(g, p["i"] - 1), "^[ -]?", 0)), F.lit(None)),
                _part(F.regexp_replace(span(g, p["i"], p["j"]), "^[ -]", ""), p["kind"])))
            last = F.coalesce(F.get(picks, F.size(picks) - 1)["j"], F.lit(0))
            return F.concat(F.flatten(each), F.array(_part(_let(last, lambda e: span(g, e + 1, F.size(g))), F.lit(None))))

        return _let(_let(starts(g), pick), of)

    return _let(F.regexp_extract_all(v, F.lit("[ -]?[0-9]+"), F.lit(0)), parts)


def parts_of(v: Column) -> Column:
    """A found value as parts with their kinds, null for what stays."""
    run = v.rlike("^[0-9][0-9 -]*$") & ~v.rlike(rf"^(?:{DATE}|{SSN}|{PHONE})$")
    return F.when(run, _run_parts(v)).otherwise(F.array(_part(v, kind_of(v))))


def _times(kinds: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(kinds, lambda k: k == F.lit(kind))), F.lit(0)).cast("long")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with values replaced in the text, and ``n_<kind>`` counts if asked for.

    A column of ``docs`` that has the name of a count gives way to it; no other
    column is touched, whatever its name.
    """
    t, inside, kinds = docs[f"`{text_col}`"].cast("string"), fresh("found", docs), fresh("kinds", docs)
    touched = t.rlike("[0-9@]")
    none = F.array().cast("array<string>")
    x = docs.withColumn(inside, F.when(touched, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(none))
    x = x.withColumn(inside, F.transform(inside, parts_of))
    x = x.withColumn(kinds, F.transform(F.flatten(inside), lambda p: p["kind"]))
    some = F.size(inside) > 0
    new = F.transform(inside, lambda ps: F.array_join(F.transform(ps, lambda p: F.when(p["kind"].isNull(), p["v"]).otherwise(pseudonym(key, p["v"], p["kind"]))), ""))
    gaps = F.split(t, ANY, -1)
    whole = F.array_join(F.zip_with(gaps, new, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    x = x.withColumn(text_col, F.when(some, whole).otherwise(t))
    if counts:
        for kind in KINDS:
            x = x.withColumn(f"n_{kind}", _times(F.col(kinds), kind))
    return x.drop(inside, kinds)
