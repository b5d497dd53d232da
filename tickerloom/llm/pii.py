"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The key of the query over the supplied tables, which hold invented data; a run over real data names its own.
TABLES_KEY = "supplied tables"
ROUNDS = 8
#: A pseudonym that is no valid value is permuted again, up to so often: more than one valid text in 10**20 never needs.
WALK = 24

# fixed values: the shapes that are looked for, in the order in which they are tried at a place
# Lengths are bounded by the mail rules (name 64, label 63, 127 labels), and what is read is not given back: time stays linear, the stack small.
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
PHONE = r"(?<![\w+])\+?\d{0,3}[ .-]?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
DATE = r"(?<![\w.-])\d{4}-\d{2}-\d{2}(?![\w-])|(?<![\w./])\d{2}[./]\d{2}[./]\d{4}(?![\w/])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<!\w)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)"
ANY = "|".join([EMAIL, IPV4, PHONE, DATE, SSN, CARD, IBAN])

#: Days from 1900-01-01 to 2099-12-31, and their factors: the two halves of a date's Feistel network.
FIRST_DAY, DAY_HALVES = "1900-01-01", (17, 4297)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _round_bits(tag: str, number: str, other: str, key: str) -> str:
    """Sixty keyed bits of a round as hex digits: the round function of both networks."""
    return f"sha2(concat_ws('|', {_quoted(key)}, {_quoted(tag)}, {number}, {other}), 256)"


def permuted_text(text: str, tag: str, key: str) -> str:
    """SQL: ``text`` with its digits and ASCII letters permuted, each within its class; other characters stay.

    The network's halves are those of the text. In each round one half is
    shifted, character by character modulo 10 or 26, by bits that depend on the
    key and the other half; so equal texts have equal pseudonyms and different
    texts of one shape have different ones.
    """
    bits = lambda x: f"conv(substring({x}, (i % 16) * 4 + 1, 4), 16, 10)"
    moved = lambda c, low, size, x: f"char({low} + (ascii({c}) - {low} + cast({bits(x)} as int)) % {size})"

    def shifted(half: str, other: str) -> str:
        c, h = "substring(p.s, i + 1, 1)", "p.h"
        step = f"case when {c} between '0' and '9' then {moved(c, 48, 10, h)} when {c} between 'a' and 'z' then {moved(c, 97, 26, h)} when {c} between 'A' and 'Z' then {moved(c, 65, 26, h)} else {c} end"
        # the pair is bound once, so the digest is worked out once per round
        return f"element_at(transform(array(named_struct('s', {half}, 'h', {_round_bits(tag, 'r', other, key)})), p -> array_join(transform(sequence(0, length(p.s) - 1), i -> {step}), '')), 1)"

    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substring({text}, 1, div0(length({text}))), 'b', substring({text}, div0(length({text})) + 1)), "
        f"(z, r) -> if(r % 2 = 1, named_struct('a', if(z.a = '', '', {shifted('z.a', 'z.b')}), 'b', z.b), named_struct('a', z.a, 'b', if(z.b = '', '', {shifted('z.b', 'z.a')}))), "
        f"z -> concat(z.a, z.b))"
    ).replace(f"div0(length({text}))", f"cast(length({text}) div 2 as int)")


def permuted_number(number: str, halves: tuple[int, int], tag: str, key: str) -> str:
    """SQL: a permutation of 0 .. halves[0] * halves[1] - 1, by a Feistel network over quotient and remainder."""
    a, b = halves
    bits = lambda other: f"cast(conv(substring({_round_bits(tag, 'r', other, key)}, 1, 13), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(1, {ROUNDS + 4}), named_struct('a', cast({number} div {b} as bigint), 'b', cast({number} % {b} as bigint)), "
        f"(z, r) -> if(r % 2 = 1, named_struct('a', (z.a + {bits('z.b')}) % {a}, 'b', z.b), named_struct('a', z.a, 'b', (z.b + {bits('z.a')}) % {b})), "
        f"z -> z.a * {b} + z.b)"
    )


def _bound(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def luhn_sum(digits: str, shift: int) -> str:
    """SQL: the Luhn sum; ``shift`` 1 doubles from the last digit on, 0 from the one before it."""
    digit = f"cast(substring({digits}, length({digits}) - j, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0L, (t, j) -> t + if((j + {shift}) % 2 = 1, ({digit} * 2) div 10 + ({digit} * 2) % 10, {digit}))"


def iban_rest(text: str) -> str:
    """SQL: the remainder modulo 97 of an account number whose first four characters go last, letters as 10 to 35."""
    c = f"substring(concat(substring({text}, 5), substring({text}, 1, 4)), j, 1)"
    return f"aggregate(sequence(1, length({text})), 0, (t, j) -> cast(if({c} between '0' and '9', (t * 10 + cast({c} as int)) % 97, (t * 100 + ascii({c}) - 55) % 97) as int))"


def refilled(shape: str, digits: str) -> str:
    """SQL: ``digits`` put, in order, where ``shape`` has digits."""
    c = f"substring({shape}, j, 1)"
    at = f"length(regexp_replace(substring({shape}, 1, j), '[^0-9]', ''))"
    return _bound(digits, "g", f"array_join(transform(sequence(1, length({shape})), j -> if({c} between '0' and '9', substring(g, {at}, 1), {c})), '')")


def _email(m: str, key: str) -> str:
    """The name and all labels of the host but the last are permuted."""
    last = f"regexp_extract({m}, '[.][A-Za-z]+$', 0)"
    return f"concat({permuted_text(f'substring({m}, 1, length({m}) - length({last}))', 'email', key)}, {last})"


def _ip(m: str, key: str) -> str:
    number = f"aggregate(transform(split({m}, '[.]'), x -> cast(x as bigint)), 0L, (t, x) -> t * 256 + x)"
    inner = _bound(permuted_number("q", (65536, 65536), "ip", key), "w", "concat_ws('.', w div 16777216, (w div 65536) % 256, (w div 256) % 256, w % 256)")
    return f"if(forall(split({m}, '[.]'), x -> cast(x as int) <= 255), {_bound(number, 'q', inner)}, {m})"


def walked(start: str, step: str, valid: str) -> str:
    """SQL: ``step`` of ``w`` taken from ``start`` until ``w`` is ``valid``: a permutation of the valid values, if ``start`` is one."""
    once = _bound(start, "w", step)
    return f"aggregate(sequence(1, {WALK}), {once}, (w, k) -> if({valid}, w, {step}))"


def _date(m: str, pattern: str, key: str, valid: str = "true") -> str:
    """``valid`` says of a day number ``w`` whether its text can be read in this pattern only."""
    size = DAY_HALVES[0] * DAY_HALVES[1]
    number = f"datediff(try_to_date({m}, '{pattern}'), date'{FIRST_DAY}')"
    moved = walked("q", permuted_number("w", DAY_HALVES, "date", key), valid) if valid != "true" else permuted_number("q", DAY_HALVES, "date", key)
    out = f"date_format(date_add(date'{FIRST_DAY}', cast({moved} as int)), '{pattern}')"
    return _bound(number, "q", f"if(q is null or q < 0 or q >= {size}, {m}, {out})")


def _slashed(m: str, key: str) -> str:
    """Month first, unless the first number can only be a day; such days stay days above 12, so that no two dates meet."""
    day_first = _date(m, "dd/MM/yyyy", key, f"day(date_add(date'{FIRST_DAY}', cast(w as int))) > 12")
    return f"if(cast(substring({m}, 1, 2) as int) > 12, {day_first}, {_date(m, 'MM/dd/yyyy', key)})"


def _ssn(m: str, key: str) -> str:
    valid = lambda x: f"substring({x}, 1, 3) not in ('000', '666') and substring({x}, 1, 1) <> '9' and substring({x}, 5, 2) <> '00' and substring({x}, 8, 4) <> '0000'"
    return f"if({valid(m)}, {walked(m, permuted_text('w', 'ssn', key), valid('w'))}, {m})"


def _phone(m: str, key: str) -> str:
    """The country code stays; the ten digits after it are permuted."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return _bound(digits, "d", refilled(m, f"concat(substring(d, 1, length(d) - 10), {permuted_text('substring(d, length(d) - 9)', 'phone', key)})"))


def _card(m: str, key: str) -> str:
    """Numbers that pass the Luhn test: the first digit stays, the last is worked out anew, those between are permuted."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    body = f"concat(substring(d, 1, 1), {permuted_text('substring(d, 2, length(d) - 2)', 'card', key)})"
    whole = _bound(body, "f", f"concat(f, cast((10 - {luhn_sum('f', 1)} % 10) % 10 as string))")
    return _bound(digits, "d", f"if({luhn_sum('d', 0)} % 10 = 0, {refilled(m, whole)}, {m})")


def _iban(m: str, key: str) -> str:
    """Account numbers that pass the modulo 97 test: the country stays, the two check digits are worked out anew."""
    body = permuted_text(f"substring({m}, 5)", "iban", key)
    check = "lpad(cast(98 - " + iban_rest("concat(substring(e, 1, 2), '00', substring(e, 5))") + " as string), 2, '0')"
    whole = _bound(f"concat(substring({m}, 1, 4), {body})", "e", f"concat(substring(e, 1, 2), {check}, substring(e, 5))")
    return f"if({iban_rest(m)} = 1, {whole}, {m})"


def pseudonym(m: str, key: str) -> str:
    """SQL: the pseudonym of one found value, or the value itself if it is not valid."""
    return (
        f"case when instr({m}, '@') > 0 then {_email(m, key)}"
        f" when {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {_ip(m, key)}"
        f" when {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then {_date(m, 'yyyy-MM-dd', key)}"
        f" when {m} rlike '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$' then {_date(m, 'dd.MM.yyyy', key)}"
        f" when {m} rlike '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$' then {_slashed(m, key)}"
        f" when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {_ssn(m, key)}"
        f" when {m} rlike '^[A-Z]{{2}}[0-9]{{2}}' then {_iban(m, key)}"
        f" when {m} rlike '^([0-9]{{13,}}|[0-9]{{4}}[ -][0-9 -]+)$' then {_card(m, key)}"
        f" else {_phone(m, key)} end"
    )


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by pseudonyms of the same format, and ``pii_found``.

    Looked for: e-mail addresses, IPv4 addresses, telephone numbers, social
    security numbers, card numbers, bank accounts and days from 1900 to 2099. A
    number is replaced only if it is valid (octets, Luhn, modulo 97, calendar);
    anything else stays as it is, and a pseudonym is valid, too. Equal values get
    equal pseudonyms in all rows under one ``key``, and different values of one
    format different ones. Days in slashes are month first, unless only the second
    number can be a month. Names of addresses longer than 64 characters, labels
    longer than 63, ten digits without separators and IPv6 addresses stay as they are.

    Null text: null, none found. Empty text: empty. Each row is worked out alone,
    so order, ties, repeated rows and an empty table need no rule. A column of
    ``docs`` named pii_found is replaced; all others stay.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    # rows without a digit or @ are told apart by one cheap scan
    found = docs.select(row, F.col(f"`{text}`").cast("string").alias("t")).select(
        "row", "t", F.when(F.col("t").rlike("[@0-9]"), F.regexp_extract_all("t", F.lit(f"({ANY})"), F.lit(1))).alias("found")
    )
    new = F.expr(f"transform(found, m -> {pseudonym('m', key)})")
    replaced = found.withColumn("new", F.when(F.size("found") > 0, new))
    gaps = F.split("t", ANY, -1)
    whole = F.when(
        F.col("new").isNotNull(),
        F.array_join(F.zip_with(gaps, F.concat(F.col("new"), F.array(F.lit(""))), lambda g, n: F.concat(g, n)), ""),
    ).otherwise(F.col("t"))
    count = F.when(F.col("new").isNotNull(), F.size(F.filter(F.arrays_zip("found", "new"), lambda z: z["found"] != z["new"]))).otherwise(0)
    columns = [whole.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names if c != "pii_found"]
    return replaced.select(*columns, count.cast("long").alias("pii_found"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymise(docs, key=TABLES_KEY).select("doc_id", "text", "pii_found")
