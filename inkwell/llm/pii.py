"""Format-preserving pseudonyms for personal data, by DataFrame functions only.

What looks like an e-mail address, telephone, card, account or social security
number, network address, date or credential is found by one pattern and
validated (Luhn, mod 97, ranges, calendar). A keyed Feistel network permutes its
symbols within its format; equal values get equal pseudonyms in all documents,
and different values of one format different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of the dates that are permuted, 1900-01-01 to 2099-12-31: 229 x 319.
FIRST_DAY, DATE_SIDES = "1900-01-01", (229, 319)
#: Social security numbers: areas 001-899 but 666, groups 01-99, serials 0001-9999.
SSN_SIDES = (898, 99, 9999)

# The formats.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}(?<!-)\.){1,8}[A-Za-z]{2,63}"
CREDENTIAL = r"(?i:\b(?:token|secret|password|passwd|api_?key|access_?key)\b[\"']?\s?[=:]\s?[\"']?)[A-Za-z0-9_+/-]{16,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w/-]|\.\d)"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\w)"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"
PATTERN = "|".join((EMAIL, CREDENTIAL, IBAN, DATE, IP, SSN, PHONE, CARD))
KINDS = ("email", "credential", "iban", "date", "ip", "ssn", "phone", "card")
#: No match without this.
CHEAP = r"[@]|\d\d|\d\.\d|(?i:token|secret|passw|key)"

# The calling codes of two digits.
CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
CODES = ", ".join(f"'{x}'" for x in CODES.split())

DIGITS = "0123456789"
SYMBOLS = DIGITS + "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sql(column: str) -> str:
    return "'" + column.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(symbols: str, moduli: str, key: str, kind: str) -> str:
    """SQL: the array ``symbols``, each entry below its entry of ``moduli``,
    permuted under ``key``. Each round adds, modulo, numbers drawn from a keyed
    digest of one half to the other, so it can be undone whatever the digest; the
    work grows with the length."""
    digest = "sha2(concat_ws('|', {key}, '{kind}', r, array_join({other}, ',')), 256)"
    mix = "cast(conv(substr(sha2(concat(h, '|', i), 256), 1, 12), 16, 10) as bigint)"
    left = _let("h", digest.format(key=key, kind=kind, other="a.right"), f"transform(a.left, (x, i) -> (x + {mix}) % element_at(fm, i + 1))")
    right = _let("h", digest.format(key=key, kind=kind, other="a.left"), f"transform(a.right, (x, i) -> (x + {mix}) % element_at(fm, fh + i + 1))")
    rounds = f"""aggregate(sequence(0, {ROUNDS - 1}),
        struct(slice(fs, 1, fh) as left, slice(fs, fh + 1, size(fs)) as right),
        (a, r) -> struct(if(r % 2 = 0, {left}, a.left) as left, if(r % 2 = 1, {right}, a.right) as right),
        a -> concat(a.left, a.right))"""
    return _let("fs", symbols, _let("fm", moduli, _let("fh", "cast(size(fs) div 2 as int)", rounds)))


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _permuted(m: str, key: str, kind: str, fixed: str = "false", hexadecimal: bool = False) -> str:
    """SQL: string ``m`` with digits, small and capital letters permuted in
    place; the entries of ``c`` (position ``i``) for which ``fixed`` holds stay."""
    bases = "case when c between '0' and '9' then 10L when c between 'a' and 'z' then 26L when c between 'A' and 'Z' then 26L else 1L end"
    starts = "case when c between '0' and '9' then 0 when c between 'a' and 'z' then 10 when c between 'A' and 'Z' then 36 else -1 end"
    if hexadecimal:
        bases, starts = "case when c between '0' and '9' or c between 'a' and 'f' then 16L else 1L end", "case when c between '0' and '9' or c between 'a' and 'f' then 0 else -1 end"
    chars = f"transform(split({m}, ''), (c, i) -> struct(c as c, if({fixed}, 1L, {bases}) as b, if({fixed}, -1, {starts}) as s))"
    moved = feistel("transform(t, x -> cast(if(x.s < 0, 0, instr('" + SYMBOLS + "', x.c) - 1 - x.s) as bigint))", "transform(t, x -> x.b)", key, kind)
    back = f"array_join(zip_with(t, p, (x, y) -> if(x.s < 0, x.c, substr('{SYMBOLS}', cast(x.s + y + 1 as int), 1))), '')"
    return _let("t", chars, _let("p", moved, back))


def _numbers(m: str) -> str:
    """SQL: the digits of ``m`` as an array of bigint."""
    return f"transform(split(regexp_replace({m}, '[^0-9]', ''), ''), c -> cast(c as bigint))"


def _luhn(digits: str, parity: int) -> str:
    """SQL: Luhn sum of an array of digits; ``parity`` 0 doubles the last."""
    return f"""aggregate(sequence(0, size({digits}) - 1), 0L, (a, i) -> a + if((size({digits}) - 1 - i) % 2 = {parity},
        2 * element_at({digits}, i + 1) - if(element_at({digits}, i + 1) > 4, 9, 0), element_at({digits}, i + 1)))"""


def _refill(m: str, digits: str, slots: str = "c between '0' and '9'") -> str:
    """SQL: ``m`` with its digits (or the ``slots``) replaced, in order, by the
    entries of ``digits``."""
    return f"""aggregate(split({m}, ''), struct('' as t, 0 as n), (a, c) -> if({slots},
        struct(concat(a.t, cast(element_at({digits}, a.n + 1) as string)) as t, a.n + 1 as n), struct(concat(a.t, c) as t, a.n as n)), a -> a.t)"""


def _card(m: str, key: str) -> tuple[str, str]:
    valid = _let("d", _numbers(m), f"{_luhn('d', 1)} % 10 = 0 and size(d) between 13 and 19")
    body = "slice(d, 1, size(d) - 1)"
    moved = feistel(body, f"array_repeat(10L, size(d) - 1)", key, "card")
    whole = _let("p", moved, f"concat(p, array((10 - {_luhn('p', 0)} % 10) % 10))")
    return valid, _let("d", _numbers(m), _let("q", whole, _refill(m, "q")))


def _mod97(text: str) -> str:
    """SQL: the number that a string of digits and capitals stands for, mod 97."""
    return f"""aggregate(split({text}, ''), 0L, (a, c) -> if(c between '0' and '9', (a * 10 + cast(c as bigint)) % 97,
        (a * 100 + ascii(c) - 55) % 97))"""


def _iban(m: str, key: str) -> tuple[str, str]:
    """The number without blanks is permuted, then set in the same layout."""
    bare = f"replace({m}, ' ', '')"
    valid = _let("b", bare, f"{_mod97('concat(substr(b, 5), substr(b, 1, 4))')} = 1 and length(b) between 15 and 34")
    moved = _permuted("b", key, "iban", "i < 4")
    check = f"lpad(cast(98 - {_mod97("concat(substr(n, 5), substr(n, 1, 2), '00')")} as string), 2, '0')"
    whole = _let("n", moved, f"split(concat(substr(n, 1, 2), {check}, substr(n, 5)), '')")
    return valid, _let("b", bare, _let("q", whole, _refill(m, "q", "c <> ' '")))


def _date(m: str, key: str) -> tuple[str, str]:
    iso = f"""case when {m} rlike '^[0-9]{{4}}' then concat(substr({m}, 1, 4), '-', substr({m}, 6, 2), '-', substr({m}, 9, 2))
        else concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)) end"""
    american = f"concat(substr({m}, 7, 4), '-', substr({m}, 1, 2), '-', substr({m}, 4, 2))"
    day_first = f"coalesce(try_cast({iso} as date), if({m} rlike '^[0-9]{{2}}/', try_cast({american} as date), null))"
    days = f"datediff({day_first}, date'{FIRST_DAY}')"
    a, b = DATE_SIDES
    valid = f"coalesce({days} between 0 and {a * b - 1}, false)"
    moved = feistel(f"array(cast(d div {b} as bigint), cast(d % {b} as bigint))", f"array({a}L, {b}L)", key, "date")
    shown = f"""case when {m} rlike '^[0-9]{{4}}' then date_format(n, concat('yyyy', substr({m}, 5, 1), 'MM', substr({m}, 8, 1), 'dd'))
        when try_cast({iso} as date) is null then date_format(n, 'MM/dd/yyyy')
        else date_format(n, concat('dd', substr({m}, 3, 1), 'MM', substr({m}, 6, 1), 'yyyy')) end"""
    day = f"date_add(date'{FIRST_DAY}', cast(element_at(p, 1) * {b} + element_at(p, 2) as int))"
    # A date that could be read either way is read day first; its pseudonym's day
    # may not fit the other reading, which the format leaves open.
    return valid, _let("d", days, _let("p", moved, _let("n", day, shown)))


def _ssn(m: str, key: str) -> tuple[str, str]:
    area, group, serial = (f"cast(substr({m}, {a}, {n}) as bigint)" for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    first = f"array({area} - if({area} > 666, 2, 1), {group} - 1, {serial} - 1)"
    moved = feistel("s", "array(" + ", ".join(f"{x}L" for x in SSN_SIDES) + ")", key, "ssn")
    shown = "format_string('%03d-%02d-%04d', element_at(p, 1) + if(element_at(p, 1) >= 665, 2, 1), element_at(p, 2) + 1, element_at(p, 3) + 1)"
    return valid, _let("s", first, _let("p", moved, shown))


def _ip(m: str, key: str) -> tuple[str, str]:
    moved = feistel("s", "array_repeat(256L, 4)", key, "ip")
    return "true", _let("s", f"transform(split({m}, '[.]'), c -> cast(c as bigint))", _let("p", moved, "array_join(transform(p, x -> cast(x as string)), '.')"))


def _phone(m: str, key: str) -> tuple[str, str]:
    """The bare digits are permuted, whatever the layout; of a number with a
    plus sign the country calling code stays (one to three digits, by the first
    ones, as calling codes are free of prefixes)."""
    code = f"if(startswith({m}, '+'), case when substr(b, 1, 1) in ('1', '7') then 1 when substr(b, 1, 2) in ({CODES}) then 2 else 3 end, 0)"
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    moved = _permuted("substr(b, k + 1)", key, "phone")
    whole = _let("k", code, f"split(concat(substr(b, 1, k), {moved}), '')")
    return f"length({digits}) between 7 and 15", _let("b", digits, _let("q", whole, _refill(m, "q")))


def _email(m: str, key: str) -> tuple[str, str]:
    return "true", _let("k", f"instr({m}, '@') - 1", _permuted(m, key, "email", "i >= k"))


def _credential(m: str, key: str) -> tuple[str, str]:
    value = f"regexp_extract({m}, '[A-Za-z0-9_+/-]{{16,}}$', 0)"
    moved = f"if({value} rlike '^[0-9a-f]+$', {_permuted(value, key, 'hex', hexadecimal=True)}, {_permuted(value, key, 'credential')})"
    return f"{value} rlike '[0-9]'", f"concat(substr({m}, 1, length({m}) - length({value})), {moved})"


def _kind(m: str) -> str:
    """SQL: the format that a whole match has, by the order of the pattern."""
    tests = zip(KINDS, (EMAIL, CREDENTIAL, IBAN, DATE, IP, SSN, PHONE, CARD), strict=True)
    cases = " ".join(f"when {m} rlike {_sql('^(?:' + p + ')$')} then '{k}'" for k, p in tests)
    return f"case {cases} end"


def _replacement(key: str) -> str:
    """SQL: struct(kind or null if not valid, pseudonym or the match) of ``m``."""
    makers = {"email": _email, "credential": _credential, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}
    cases = []
    for kind, make in makers.items():
        valid, value = make("m", key)
        cases.append(f"when '{kind}' then if({valid}, struct('{kind}' as kind, {value} as value), struct(cast(null as string) as kind, m as value))")
    return _let("k", _kind("m"), f"case k {' '.join(cases)} else struct(cast(null as string) as kind, m as value) end").replace("k -> case k", "kk -> case kk")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and ``pii_kinds``,
    the array of the kinds replaced in page order.

    A value has one pseudonym in whatever layout it is written: blanks, hyphens,
    brackets and the case of addresses are kept, and what stands between them is
    permuted. A match that fails its validation stays. Whole texts are read; a null text
    stays null with no kinds, an empty one empty; all other columns and rows
    stay as they are, clashing ``pii_kinds`` being replaced. No Python runs on
    the executors and nothing is shuffled. The key is a literal of the plan: keep
    plans private.
    """
    if not key:
        raise ValueError("a key is needed")
    matches, new = (_unused(docs, x) for x in ("found", "new"))
    text = F.col(f"`{text_col}`")
    pattern = F.lit(PATTERN)
    some = text.rlike(CHEAP)
    found = F.when(some, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    replace = F.expr(f"transform({matches}, m -> {_replacement(_sql(key))})")
    joined = F.array_join(
        F.flatten(F.zip_with(F.split(text, PATTERN, -1), F.col(new), lambda p, n: F.array(p, F.coalesce(n["value"], F.lit(""))))), ""
    )
    return (
        docs.withColumn(matches, found)
        .withColumn(new, F.when(F.size(matches) > 0, replace))
        .withColumn("pii_kinds", F.expr(f"coalesce(filter(transform({new}, x -> x.kind), x -> x is not null), cast(array() as array<string>))"))
        .withColumn(text_col, F.when(F.size("pii_kinds") > 0, joined).otherwise(text))
        .drop(matches, new)
    )


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def digits_of(column: str | Column) -> Column:
    """The digits of a string column."""
    return F.regexp_replace(column, "[^0-9]", "")
