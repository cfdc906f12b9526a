"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Validated numbers and dates are permuted within their format by a keyed Feistel network
over Z_a x Z_b: rounds add a keyed hash of one half to the other, so the map is one to
one, equal values get equal pseudonyms in every document, and the key's holder can turn
it back. Kept: lengths, separators, check digits and validity.

- payment cards (13 to 19 digits, Luhn): all but the first digit, check digit renewed
- IBANs (mod 97): letters and digits of the account part, check digits renewed
- US social security numbers (valid area, group, serial)
- telephone numbers with a country code or in North American writing: all after the assigned
  code, whatever the separators; a trunk zero written (0) is no part of a number
- IPv4 addresses, but not dotted numbers after "version", "release", "section" or "build"
- dates from 1900-01-01 to 2100-05-01, written y-m-d, y/m/d, d.m.y or m/d/y, or d/m/y where
  the first number is over 12 (its pseudonym's is, too); a time may follow after T

What has no such format gets a keyed one-way name of the same kind: the local part of an
e-mail address, and secrets (AKIA..., hexadecimal tokens of 32 characters or more, whatever
follows password= or "password: ", at its whole length).

One pass of one expression marks every value together with the kind that matched; the kind
decides what becomes of it. Numbers that fail validation stay. Null and empty texts stay as
they are, all other columns too, whatever their names; an empty table gives no rows. There is no
default key: an empty or null one is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of the date domain: 270 * 271, from 1900-01-01.
DAYS = (270, 271)
_WORD, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_IP = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = rf"{_WORD}[0-9a-f]{{32,}}+{_END}|{_WORD}[0-9A-F]{{32,}}+{_END}"
KINDS = {
    "secret": rf"{_WORD}AKIA[0-9A-Z]{{16}}{_END}|{_HEX}|(?i:(?<=password=)|(?<=password: ))[^\s\"'&;]{{6,}}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}" + _END,
    "iban": rf"{_WORD}[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?{_END}",
    "ip": rf"(?<![0-9A-Za-z.])(?<!(?i:version|release|section|build) ){_IP}(?:\.{_IP}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?:(?=T[0-9]{2}:)|(?![0-9A-Za-z]|[./-][0-9]))",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?[0-9]{2,4}|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z(])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?<sep>[ -])[0-9]{4}(?:\k<sep>)[0-9]{4}(?:\k<sep>)[0-9]{1,7}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
#: The assigned country codes of telephone numbers, as a pattern; what begins no code of one or two digits begins one of three.
COUNTRY_CODE = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
#: Characters that no text has (Unicode non-characters): around a value, between kinds, and before either in texts that have them after all.
_AROUND, _BETWEEN, _ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2"


def pattern() -> str:
    """All kinds in one expression, the kth as group k + 1."""
    return "|".join(f"({x})" for x in KINDS.values())


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(s: Column, of) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: of(F.substr(s, i, F.lit(1)), i))


def _noise(key: Column, kind: Column, i: Column, v: Column) -> Column:
    """A keyed hash of v in round or at place i."""
    return F.conv(F.substr(F.sha2(F.concat_ws("|", key, kind, i.cast("string"), v.cast("string")), 256), F.lit(1), F.lit(14)), 16, 10).cast("long")


def _feistel(x: Column, y: Column, a: Column, b: Column, kind: str | Column, key: Column) -> Column:
    """struct<x, y>: (x, y) of Z_a x Z_b under the keyed permutation of that kind."""
    noise = lambda i, v: _noise(key, F.lit(kind), i, v)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, (s["x"] + noise(i, s["y"]) % a) % a).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise((s["y"] + noise(i, s["x"]) % b) % b).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def _permuted(d: Column, kind: str | Column, key: Column) -> Column:
    """A string of up to 34 digits under the permutation of strings of its length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    big = lambda k: F.pow(F.lit(10.0), k).cast("long")
    half = lambda s: F.coalesce(s.cast("long"), F.lit(0))
    out = _feistel(half(F.substr(d, F.lit(1), u)), half(F.substr(d, u + 1, n)), big(u), big(n - u), kind, key)
    return _let(out, lambda r: F.concat(F.when(u > 0, F.lpad(r["x"].cast("string"), u, "0")).otherwise(""), F.lpad(r["y"].cast("string"), n - u, "0")))


def _refill(s: Column, d: Column) -> Column:
    """s with its digits replaced, in order, by those of d."""
    return F.array_join(_chars(s, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(d, F.length(_digits(F.substr(s, F.lit(1), i))), F.lit(1))).otherwise(c)), "")


def _luhn(d: Column) -> Column:
    """The Luhn sum of a digit string."""
    n = F.length(d)
    doubled = _chars(d, lambda c, i: _let(c.cast("int"), lambda v: F.when((n - i) % 2 == 1, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v)))
    return F.aggregate(doubled, F.lit(0), lambda s, v: s + v)


def _card(m: Column, key: Column) -> Column:
    def renew(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _permuted(F.substr(d, F.lit(2), n - 2), "card", key))
        return _let(body, lambda p: _refill(m, F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))))

    return _let(_digits(m), lambda d: F.when(_luhn(d) % 10 == 0, renew(d)).otherwise(m))


def _mod97(s: Column) -> Column:
    value = _chars(s, lambda c, _: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _iban(m: Column, key: Column) -> Column:
    """Letters are shifted by a keyed hash of the digits, then digits permuted under the new letters, so that both can be turned back."""

    def shifted(body: Column) -> Column:
        moved = lambda c, i: F.char(65 + (F.ascii(c) - 65 + _noise(key, F.lit("iban letter"), i, _digits(body)) % 26) % 26)
        return F.when(body.rlike("[A-Z]"), F.array_join(_chars(body, lambda c, i: F.when(c.rlike("[A-Z]"), moved(c, i)).otherwise(c)), "")).otherwise(body)

    def permuted(body: Column) -> Column:
        kind = F.concat(F.lit("iban"), F.regexp_replace(body, "[0-9]", ""))
        return _let(_digits(body), lambda d: F.when(F.length(d) > 0, _refill(body, _permuted(d, kind, key))).otherwise(body))

    def renew(s: Column) -> Column:
        body = F.substr(s, F.lit(5), F.length(s))
        land = F.substr(s, F.lit(1), F.lit(2))
        fresh = _let(shifted(body), permuted)
        checked = _let(fresh, lambda b: F.concat(land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
        spaced = lambda t: F.array_join(_chars(m, lambda c, i: F.when(c == " ", c).otherwise(F.substr(t, F.length(F.replace(F.substr(m, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))), "")
        return _let(checked, spaced)

    turned = lambda s: F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))
    return _let(F.replace(m, F.lit(" "), F.lit("")), lambda s: F.when((_mod97(turned(s)) == 1) & (F.length(s) >= 15), renew(s)).otherwise(m))


def _ip(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda v: v.cast("long"))
    pair = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return _let(_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), "ip", key), lambda r: F.concat_ws(".", pair(r["x"]), pair(r["y"])))


def _ssn(m: Column, key: Column) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
    v = F.transform(F.split(m, "-"), lambda t: t.cast("long"))
    ok = v[0].between(1, 899) & (v[0] != 666) & (v[1] > 0) & (v[2] > 0)
    area = v[0] - 1 - F.when(v[0] > 666, 1).otherwise(0)
    r = _feistel(area, (v[1] - 1) * 9999 + v[2] - 1, F.lit(898), F.lit(99 * 9999), "ssn", key)
    text = lambda r: F.concat_ws("-", F.lpad((r["x"] + 1 + F.when(r["x"] + 1 > 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.floor(r["y"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((r["y"] % 9999 + 1).cast("string"), 4, "0"))
    return F.when(ok, _let(r, text)).otherwise(m)


def _date(m: Column, key: Column) -> Column:
    """Parts keep their order and separators; days and months their zero, if they had one."""
    p = F.transform(F.split(m, "[./-]"), lambda t: t.cast("int"))
    dash, dot = m.contains("-"), m.contains(".")
    ymd = m.rlike("^[0-9]{4}")
    dmy = ~ymd & (dot | (p[0] > 12))
    y, mo, d = F.when(ymd, p[0]).otherwise(p[2]), F.when(ymd | dmy, p[1]).otherwise(p[0]), F.when(ymd, p[2]).when(dmy, p[0]).otherwise(p[1])
    day = F.to_date(F.when((mo.between(1, 12)) & (d.between(1, 31)), F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd")))
    n = F.date_diff(day, F.lit("1900-01-01").cast("date"))
    padded = m.rlike("(^|[./])0") | (F.length(m) == 10)
    two = lambda t: F.when(padded, F.lpad(t.cast("string"), 2, "0")).otherwise(t.cast("string"))
    mark = F.when(dash, "-").when(dot, ".").otherwise("/")
    again = lambda r: _feistel(r["x"], r["y"], F.lit(DAYS[0]), F.lit(DAYS[1]), "date", key)
    date = lambda r: F.date_add(F.lit("1900-01-01").cast("date"), (r["x"] * DAYS[1] + r["y"]).cast("int"))
    walked = lambda r: F.when(dmy & ~dot, F.aggregate(F.sequence(F.lit(1), F.lit(99)), r, lambda s, _: F.when(F.day(date(s)) > 12, s).otherwise(again(s)))).otherwise(r)

    def text(r: Column) -> Column:
        def written(new: Column) -> Column:
            yy, mm, dd = F.year(new).cast("string"), two(F.month(new)), two(F.day(new))
            return F.when(ymd, F.concat(yy, mark, mm, mark, dd)).when(dmy, F.concat(dd, mark, mm, mark, yy)).otherwise(F.concat(mm, mark, dd, mark, yy))

        return _let(date(r), written)

    ok = n.isNotNull() & n.between(0, DAYS[0] * DAYS[1] - 1)
    start = F.struct(F.floor(n / DAYS[1]).cast("long").alias("x"), (n % DAYS[1]).cast("long").alias("y"))
    return F.when(ok, _let(_let(again(start), walked), text)).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    """All after the country code, 1 where none is written, under the permutation of that country's numbers."""
    head = F.regexp_extract(m, rf"^(?:\+(?:{COUNTRY_CODE})(?:[ .-]?\(0\))?)?", 0)
    code = F.when(head == "", "1").otherwise(F.regexp_extract(head, rf"^\+({COUNTRY_CODE})", 1))
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    return _let(_digits(rest), lambda d: F.when(F.length(d) >= 6, F.concat(head, _refill(rest, _permuted(d, F.concat(F.lit("phone"), code), key)))).otherwise(m))


def _email(m: Column, key: Column) -> Column:
    name = F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substr(name, F.lit(1), F.lit(12)), F.regexp_extract(m, "@.*$", 0))


def _secret(m: Column, key: Column) -> Column:
    name = F.sha2(F.concat_ws("|", key, F.lit("secret"), m), 256)
    named = F.substr(F.repeat(name, F.ceil(F.length(m) / 64).cast("int")), F.lit(1), F.length(m))
    return F.when(m.rlike("^AKIA[0-9A-Z]{16}$"), F.concat(F.lit("AKIA"), F.upper(F.substr(name, F.lit(1), F.lit(16))))).when(m.rlike("^[0-9A-Z]+$"), F.upper(named)).otherwise(named)


_OF = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}
#: Texts without any of these hold nothing that is looked for.
_HINT = "(?i)[0-9@]|password|akia"


def _value(groups: Column, key: Column) -> Column:
    """struct<text, n> for one match: its pseudonym, or the value itself if it fails validation, and whether it changed."""
    compared = lambda was: lambda t: F.struct(t.alias("text"), (t != was).cast("int").alias("n"))
    out = F
    for k, kind in enumerate(KINDS):
        out = out.when(groups[k] != "", _let(_OF[kind](groups[k], key), compared(groups[k])))
    return out


def masked(text: Column, key: str) -> Column:
    """struct<text, n>: text with pseudonyms, and how many values were replaced; null where nothing is looked for."""
    if not key:
        raise ValueError("pseudonyms need a key")
    odd = text.rlike(f"[{_AROUND}{_BETWEEN}{_ESCAPE}]")
    safe = text
    for c, name in ((_ESCAPE, "e"), (_AROUND, "a"), (_BETWEEN, "b")):
        safe = F.replace(safe, F.lit(c), F.lit(_ESCAPE + name))
    marked = F.regexp_replace(F.when(odd, safe).otherwise(text), pattern(), _AROUND + _BETWEEN.join(f"${k + 1}" for k in range(len(KINDS))) + _AROUND)
    whole = lambda p: F.struct(p.alias("text"), F.lit(0).alias("n"))
    parts = F.transform(F.split(marked, _AROUND, -1), lambda p, i: F.when(i % 2 == 1, _let(F.split(p, _BETWEEN, -1), lambda g: _value(g, F.lit(key)))).otherwise(whole(p)))

    def joined(ps: Column) -> Column:
        back = F.array_join(F.transform(ps, lambda p: p["text"]), "")
        plain = back
        for c, name in ((_BETWEEN, "b"), (_AROUND, "a"), (_ESCAPE, "e")):
            plain = F.replace(plain, F.lit(_ESCAPE + name), F.lit(c))
        return F.struct(F.when(odd, plain).otherwise(back).alias("text"), F.aggregate(ps, F.lit(0), lambda s, p: s + p["n"]).alias("n"))

    return F.when(text.rlike(_HINT), _let(parts, joined))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with all its columns, personal data in text replaced; n_chars, where there is one, follows the text."""
    text = F.col("text")
    out = docs.withColumn("text", F.coalesce(masked(text, key)["text"], text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def counted(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (pseudonymised), n_found: how many values were replaced."""
    found = docs.select("doc_id", "text", masked(F.col("text"), key).alias("found"))
    return found.select("doc_id", F.coalesce("found.text", "text").alias("text"), F.coalesce("found.n", F.lit(0)).cast("long").alias("n_found"))
