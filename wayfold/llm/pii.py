"""PII: format-preserving pseudonyms by a keyed Feistel network.

Validated values are replaced by values of the same format; equal values get equal pseudonyms under a key, in every document, and the
network is a permutation, so different values stay different and the key's owner can undo it (``decrypt=True``).

* card: 13 to 19 digits with a right Luhn digit (single spaces or hyphens between digits are allowed and stay): all digits but the last are permuted, the last is computed anew;
* phone: ``(ddd) ddd-dddd``, ``ddd-ddd-dddd`` or ``ddd.ddd.dddd`` with an optional country code, which stays. Without a code or with 1, area and exchange must
  begin with 2 to 9, and the number is permuted among such numbers; under another code (first form only) the ten digits are permuted;
* ssn: ``ddd-dd-dddd`` that could be issued (area 001 to 899 but not 666, group 01 to 99, serial 0001 to 9999): permuted among those;
* ip: four numbers up to 255: the 32 bits are permuted;
* date: a real date ``yyyy-mm-dd`` or ``dd/mm/yyyy`` or ``dd.mm.yyyy`` from 1900 to 2099: the day number is permuted in that range, the form stays;
* email: the digits and letters of the part before the @ are permuted within digits, small and capital ASCII letters; the rest stays. By the standard
  that part has 64 characters at most and a label of the domain 63; what is longer is no address. (A number rule of the list does not need this; addresses are no less personal.)

Everything is a DataFrame expression. The round function is SHA-256 of key, round, kind and the other half. Domains that are no power are walked: the permutation is applied
again until the value lies in the domain, which takes one step more at most than there are numbers outside.
No pattern repeats a group without bound or starts inside a run of its own characters, so texts of any length take time in proportion and no deep stack.

Cases: a null text stays null; empty texts stay; a number that fails its check is left as it is; repeated rows get equal results; other columns stay as they are;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_LOCAL = r"[A-Za-z0-9._%+\-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}{{1,64}}+@(?:[A-Za-z0-9\-]{{1,63}}+\.){{1,127}}[A-Za-z]{{2,63}}"
PHONE = r"(?:\+\d{1,3}\x20)?\(\d{3}\)\x20?\d{3}-\d{4}(?!\d)"
PLAIN_PHONE = "|".join(rf"(?<![\d.\-])(?:\+?1[\x20.\-])?[2-9]\d\d{sign}[2-9]\d\d{sign}\d{{4}}(?![\d{sign}])" for sign in (r"\-", r"\."))
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
DATE = r"(?<![\d/.\-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/\-])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<!\d)\d(?:[\x20\-]?\d){12,18}(?!\d)"
ANY = "|".join((EMAIL, PHONE, IP, DATE, SSN, PLAIN_PHONE, CARD))
DAYS = 73_049  # 1900-01-01 to 2099-12-31


def _prf(key: str, kind: str, i: Column, half: Column, size: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def feistel(value: Column, low_size: int, high_size: int, key: str, kind: str, decrypt: bool = False) -> Column:
    """A permutation of 0 .. low_size * high_size - 1: halves of the two sizes are added to in turn."""
    low = F.lit(low_size).cast("decimal(20,0)")
    exact = value.cast("decimal(20,0)")
    start = F.struct(((exact - exact % low) / low).cast("long").alias("a"), (exact % low).cast("long").alias("b"))

    def step(acc, i):
        odd = i % 2 == 1
        low, high = F.lit(low_size).cast("long"), F.lit(high_size).cast("long")
        shift_a = _prf(key, kind, i, acc["b"], high)
        shift_b = _prf(key, kind, i, acc["a"], low)
        if decrypt:
            shift_a, shift_b = high - shift_a, low - shift_b
        return F.struct(
            F.when(odd, (acc["a"] + shift_a) % high).otherwise(acc["a"]).alias("a"),
            F.when(odd, acc["b"]).otherwise((acc["b"] + shift_b) % low).alias("b"),
        )

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if decrypt else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, step, lambda acc: acc["a"] * low_size + acc["b"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refilled(form: Column, values: Column) -> Column:
    """``form`` with its digits replaced by those of ``values``, in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(acc, c):
        own = c.rlike("[0-9]")
        return F.struct(F.concat(acc["out"], F.when(own, F.substring(values, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + own.cast("int")).alias("k"))

    return F.aggregate(F.regexp_extract_all(form, F.lit("(?s)."), F.lit(0)), start, step, lambda acc: acc["out"])


def luhn_sum(number: Column) -> Column:
    """The Luhn sum, with the last digit undoubled."""
    n = F.length(number)

    def add(acc, i):
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _permuted_digits(number: Column, n: int, key: str, kind: str, decrypt: bool) -> Column:
    low = 10 ** (n // 2)
    return F.lpad(feistel(number.cast("long"), low, 10 ** (n - n // 2), key, kind, decrypt).cast("string"), n, "0")


def _bound(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def _card(m: Column, key: str, decrypt: bool) -> Column:
    number = digits(m)
    out = F.lit(None).cast("string")
    for n in range(13, 20):
        body = F.substring(number, 1, n - 1)
        fresh = _permuted_digits(body, n - 1, key, f"card{n}", decrypt)
        whole = _bound(fresh, lambda f: F.concat(f, ((F.lit(10) - luhn_sum(F.concat(f, F.lit("0"))) % 10) % 10).cast("string")))
        out = F.when(F.length(number) == n, whole).otherwise(out)
    return F.when(luhn_sum(number) % 10 == 0, refilled(m, out)).otherwise(m)


def _phone(m: Column, key: str, decrypt: bool) -> Column:
    rest = F.regexp_extract(m, r"\(?\d{3}\)?[\x20.\-]?\d{3}[.\-]\d{4}$", 0)
    code = F.substring(m, F.lit(1), F.length(m) - F.length(rest))
    number = digits(rest)
    # 800 areas, 800 exchanges and 10,000 lines
    area, exchange, line = (F.substring(number, at, n).cast("long") for at, n in ((1, 3), (4, 3), (7, 4)))
    value = ((area - 200) * 800 + exchange - 200) * 10_000 + line
    fresh = feistel(value, 80_000, 80_000, key, "phone", decrypt)
    inside = _bound(fresh, lambda v: F.concat((F.floor(v / 8_000_000) + 200).cast("string"), (F.floor(v / 10_000) % 800 + 200).cast("string"), F.lpad((v % 10_000).cast("string"), 4, "0")))
    own = (code == "") | code.rlike(r"^\+?1[\x20.\-]$")
    return F.when(~own, F.concat(code, refilled(rest, _permuted_digits(number, 10, key, "phone abroad", decrypt)))).when((area >= 200) & (exchange >= 200), F.concat(code, refilled(rest, inside))).otherwise(m)


def _ssn(m: Column, key: str, decrypt: bool) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    right = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    # 898 areas, 99 groups and 9,999 serials, each counted from 0
    value = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9_999 + serial - 1
    fresh = feistel(value, 9_999, 898 * 99, key, "ssn", decrypt)

    def form(v):
        a = F.floor(v / (99 * 9_999))
        padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", padded(a + F.when(a >= 665, 2).otherwise(1), 3), padded(F.floor(v / 9_999) % 99 + 1, 2), padded(v % 9_999 + 1, 4))

    return F.when(right, _bound(fresh, form)).otherwise(m)


def _ip(m: Column, key: str, decrypt: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    # leading zeros could not be restored
    right = ~F.exists(parts, lambda x: x > 255) & (F.array_join(F.transform(parts, lambda x: x.cast("string")), ".") == m)
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    fresh = feistel(value, 65536, 65536, key, "ip", decrypt)
    octets = lambda v: F.concat_ws(".", *[(F.floor(v / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)])
    return F.when(right, _bound(fresh, octets)).otherwise(m)


def _date(m: Column, key: str, decrypt: bool) -> Column:
    sign = F.when(m.rlike("^....-"), "-").when(m.contains("/"), "/").otherwise(".")
    part = F.split(m, r"[-/.]")
    year_first = sign == "-"
    iso = F.when(year_first, m).otherwise(F.concat_ws("-", part[2], part[1], part[0]))
    day = F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1900-01-01").cast("date")).cast("long")
    right = day.isNotNull() & day.between(0, DAYS - 1)
    # the walk: 73,049 days in a domain of 271 * 271 = 73,441 numbers, so it meets 392 others in a row at most
    once = lambda v: feistel(v, 271, 271, key, "date", decrypt)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(271 * 271 - DAYS + 1)), F.struct(day.alias("v"), F.lit(False).alias("done")), lambda acc, i: F.when(acc["done"], acc).otherwise(F.transform(F.array(once(acc["v"])), lambda w: F.struct(w.alias("v"), (w < DAYS).alias("done")))[0]), lambda acc: acc["v"])
    fresh = F.date_add(F.lit("1900-01-01").cast("date"), walked.cast("int"))
    out = F.when(year_first, F.date_format(fresh, "yyyy-MM-dd")).when(sign == "/", F.date_format(fresh, "dd/MM/yyyy")).otherwise(F.date_format(fresh, "dd.MM.yyyy"))
    return F.when(right, out).otherwise(m)


SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _email(m: Column, key: str, decrypt: bool) -> Column:
    """The local part's characters are shifted inside their classes: the left half by a digest of the right one, and so on in turn.
    A half's form (its classes and signs) never changes, so the shifts can be undone."""
    local, domain = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    cut = F.floor((F.length(local) + 1) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), cut).alias("a"), F.substring(local, cut + 1, F.length(local)).alias("b"))

    def shifted(half, other, i):
        seed = F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), F.length(half).cast("string"), other)

        def one(c, k):
            amount = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, k.cast("string")), 256), 1, 12), 16, 10).cast("long")
            out = c
            for chars in SETS:
                place = F.instr(F.lit(chars), c)
                size = len(chars)
                move = (F.lit(size) - amount % size) if decrypt else amount % size
                out = F.when(place > 0, F.substring(F.lit(chars), ((place - 1 + move) % size + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.regexp_extract_all(half, F.lit("(?s)."), F.lit(0)), one), "")

    def step(acc, i):
        odd = i % 2 == 1
        return F.struct(F.when(odd, shifted(acc["a"], acc["b"], i)).otherwise(acc["a"]).alias("a"), F.when(odd, acc["b"]).otherwise(shifted(acc["b"], acc["a"], i)).alias("b"))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if decrypt else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.concat(F.aggregate(rounds, start, step, lambda acc: F.concat(acc["a"], acc["b"])), domain)


def pseudonym(m: Column, key: str, decrypt: bool = False) -> Column:
    """The pseudonym of one match; the match itself if it is not valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), _email(m, key, decrypt))
        .when(m.contains("(") | whole(PLAIN_PHONE), _phone(m, key, decrypt))
        .when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), _ip(m, key, decrypt))
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"), _date(m, key, decrypt))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), _ssn(m, key, decrypt))
        .otherwise(_card(m, key, decrypt))
    )


def pseudonymised(docs: DataFrame, key: str, decrypt: bool = False, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``."""
    text = F.col(text_col)
    pieces = F.zip_with(F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda gap, m: F.concat(gap, F.when(m.isNull(), "").otherwise(pseudonym(m, key, decrypt))))
    return docs.withColumn(text_col, F.when(text.rlike(ANY), F.array_join(pieces, "")).otherwise(text))
