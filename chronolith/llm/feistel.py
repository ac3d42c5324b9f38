"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern, validated, and permuted by a keyed Feistel network
over their own format, so a value turns into the same pseudonym wherever it
stands, and different values stay different:

* card numbers whose Luhn check fits, 13 to 19 digits in one run, or 13 to 16 in
  groups as printed on cards (4-4-4-4, 4-6-5, 4-6-4): all digits but the last are
  permuted and the check digit is set anew;
* international phone numbers, ``+`` and a country code first, of 8 to 15 digits (after +1 ten): the digits
  after the country code, which the table of country codes parts from them, so all
  spellings of a number have one pseudonym; code and separators stay;
* social security numbers ``ddd-dd-dddd`` that can exist (area not 000, 666 or
  9xx, group not 00, serial not 0000), to another such number;
* dates ``yyyy-mm-dd`` or ``yyyy/mm/dd`` that exist, 1900 to 2099, to another
  such date;
* IPv4 addresses with four bytes of at most 255: their 32 bits;
* e-mail addresses: each run of letters and digits before the ``@``, as a number
  of base 36, the domain stays.  Case does not count: the part before the ``@``
  is lowered first, so ``Bob@x.org`` and ``bob@x.org`` are one value.  Of a part
  longer than 64 characters, which no address may have, the last 64 at most are
  taken, or none where they cut through a run;
* hexadecimal secrets of 32 or more digits, letters among them, in one case: pieces of 12 digits, each
  permuted under its own place and the length of the whole, so that equal pieces
  do not show.

Numbers and dates that fail their check are left alone.  Other kinds are not looked
for: dates with the year last, bank account numbers, IPv6 addresses, and phone
numbers without a country code.  As in any permutation, a
value may map to itself, by a chance of one in the number of values of its format.

The round function is SHA-256 over the key, the kind, the round and the other
half.  Patterns are bounded, so a text takes time in proportion to its length,
whatever it holds.  A text without values is returned as it is; null stays null;
rows that repeat get the same result; an empty table gives no rows.  Whole texts
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The patterns of each kind, in the order in which they are tried.
KINDS = (
    ("email", r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@(?:[A-Za-z0-9][A-Za-z0-9\-]{0,62}+\.){1,126}[A-Za-z]{2,63}"),
    ("date", r"(?<![\d./\-])(?:19|20)\d\d([\-/])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])(?![\d/\-])"),
    ("ipv4", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)"),
    ("ssn", r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])"),
    ("phone", r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{3,4}){2}(?!\d)"),
    ("card", r"(?<![\w.\-])(?:\d{13,19}|\d{4}(?:(?: \d{4}){2} \d{1,4}|(?:-\d{4}){2}-\d{1,4}| \d{6} \d{4,5}|-\d{6}-\d{4,5}))(?![\w\-])"),
    ("secret", r"(?<![0-9A-Za-z])(?:(?=[0-9]*+[a-f])[0-9a-f]{32,}+|(?=[0-9]*+[A-F])[0-9A-F]{32,}+)(?![0-9A-Za-z])"),
)
#: Texts without any of these cannot hold a value; cheaper than the whole pattern.
HINT = r"@|\d[\d.\-/() ]{6}|[0-9a-fA-F]{32}"
FIRST_DAY, DAYS = "1900-01-01", 73049
#: Two factors with a product of at least DAYS.
DAY_LEFT, DAY_RIGHT = 271, 270
#: How many areas, groups and serials a social security number can have.
AREAS, GROUPS, SERIALS = 898, 99, 9999


#: Country codes of one digit and of two; all others have three.
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"


def pattern() -> str:
    """All kinds as one pattern; a kind's own back-reference becomes a named one."""
    return "|".join("(?:" + p.replace(r"([\-/])", r"(?<sep>[\-/])").replace(r"\1", r"\k<sep>") + ")" for _, p in KINDS)


def _noise(key: str, kind: str | Column, step: Column, half: Column, below: Column) -> Column:
    """A keyed number under ``below`` from the other half: 60 bits of SHA-256."""
    named = F.lit(kind) if isinstance(kind, str) else kind
    digest = F.sha2(F.concat_ws("|", F.lit(key), named, step.cast("string"), half.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), below)


def permute_pair(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str | Column) -> Column:
    """A struct (l, r): an alternating Feistel network over ``left_size`` times ``right_size`` values."""

    def turn(state: Column, step: Column) -> Column:
        odd = step % 2 == 1
        l, r = state["l"], state["r"]
        new_l = F.when(odd, F.pmod(l + _noise(key, kind, step, r, left_size), left_size)).otherwise(l)
        new_r = F.when(odd, r).otherwise(F.pmod(r + _noise(key, kind, step, l, right_size), right_size))
        return F.struct(new_l.alias("l"), new_r.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def power(radix: int, n: Column) -> Column:
    """``radix ** n`` as a whole number, for n from 0 to 9."""
    return F.element_at(F.array(*[F.lit(radix**k).cast("long") for k in range(10 if radix == 10 else 7)]), n + 1)


def permute_run(run: Column, radix: int, key: str, kind: str | Column) -> Column:
    """A run of 1 to 12 (radix 10: 18) digits of ``radix``, permuted within its length; lower case."""
    n = F.length(run)
    a = F.floor(n / 2).cast("int")
    l, r = F.substring(run, F.lit(1), a), F.substring(run, a + 1, n)
    number = (lambda x: F.coalesce(F.conv(F.when(x == "", "0").otherwise(x), radix, 10).cast("long"), F.lit(0)))
    pair = permute_pair(number(l), number(r), power(radix, a), power(radix, n - a), key, kind)
    text = lambda x, k: F.lpad(F.lower(F.conv(x.cast("string"), 10, radix)), k, "0")
    return F.when(n == 0, run).otherwise(F.concat(F.when(a == 0, "").otherwise(text(pair["l"], a)), text(pair["r"], n - a)))


def permute_long(run: Column, radix: int, size: int, key: str, kind: str) -> Column:
    """A run of any length, permuted in pieces of ``size``, each under its place and the whole length."""
    pieces = F.regexp_extract_all(run, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    # the length is bound once: inside the inner function it would be taken again for every piece
    joined = lambda n: F.array_join(F.transform(pieces, lambda x, i: permute_run(x, radix, key, F.concat_ws("-", F.lit(kind), n.cast("string"), i.cast("string")))), "")
    return F.transform(F.array(F.length(run)), joined)[0]


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by those of ``digits``."""
    chars = F.split(value, "")
    fill = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return fill["out"]


def luhn_sum(digits: Column, first_doubled: Column) -> Column:
    """The Luhn sum of ``digits`` read from the right; ``first_doubled``: whether the last digit counts double."""
    places = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.struct(c.cast("int").alias("d"), ((i % 2 == 0) == first_doubled).alias("twice")))
    return F.aggregate(places, F.lit(0), lambda s, p: s + F.when(p["twice"], F.when(p["d"] > 4, 2 * p["d"] - 9).otherwise(2 * p["d"])).otherwise(p["d"]))


def card(value: Column, key: str) -> Column:
    """Another number with a fitting check digit; null where the check fails."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    head = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new_head = permute_run(head, 10, key, "card")
    check = F.pmod(10 - luhn_sum(new_head, F.lit(True)) % 10, F.lit(10)).cast("string")
    valid = luhn_sum(digits, F.lit(False)) % 10 == 0
    return F.when(valid, refill(value, F.concat(new_head, check)))


def ssn(value: Column, key: str) -> Column:
    """Another number that can exist: area, group and serial number the valid ones from 0."""
    part = lambda k: F.substring_index(F.substring_index(value, "-", k), "-", -1).cast("long")
    area = part(1)
    left, right = area - 1 - (area > 666).cast("long"), (part(2) - 1) * SERIALS + part(3) - 1
    pair = permute_pair(left, right, F.lit(AREAS).cast("long"), F.lit(GROUPS * SERIALS).cast("long"), key, "ssn")
    text = lambda x, k: F.lpad(x.cast("string"), k, "0")
    moved = F.transform(F.array(pair), lambda p: F.concat_ws("-", text(p["l"] + 1 + (p["l"] >= 665).cast("long"), 3), text(F.floor(p["r"] / SERIALS) + 1, 2), text(F.pmod(p["r"], F.lit(SERIALS)) + 1, 4)))
    return moved[0]


def date(value: Column, key: str) -> Column:
    """Another date of the range: walk the permutation of 271 x 270 numbers until a day comes up; null if there is no such date."""
    day = F.datediff(F.try_to_timestamp(F.translate(value, "/", "-"), F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))
    left, right = F.lit(DAY_LEFT).cast("long"), F.lit(DAY_RIGHT).cast("long")

    def once(number: Column) -> Column:
        pair = permute_pair(F.floor(number / right), F.pmod(number, right), left, right, key, "date")
        return (pair["l"] * right + pair["r"]).cast("long")

    # at most 121 numbers are not days, so the walk ends within 122 steps
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(DAY_LEFT * DAY_RIGHT - DAYS + 1)), F.struct(day.cast("long").alias("n"), F.lit(False).alias("done")), lambda s, _: F.when(s["done"], s).otherwise(F.transform(F.array(once(s["n"])), lambda n: F.struct(n.alias("n"), (n < DAYS).alias("done")))[0]))
    moved = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), walk["n"].cast("int")), "yyyy-MM-dd")
    return F.when(day.isNotNull(), F.when(F.substring(value, 5, 1) == "/", F.translate(moved, "-", "/")).otherwise(moved))


def ipv4(value: Column, key: str) -> Column:
    b = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    size = F.lit(65536).cast("long")
    pair = permute_pair(b[0] * 256 + b[1], b[2] * 256 + b[3], size, size, key, "ipv4")
    parts = F.transform(F.array(pair), lambda p: F.concat_ws(".", F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"), F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string")))
    return parts[0]


def email(value: Column, key: str) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    runs = F.regexp_extract_all(F.lower(local), F.lit(r"[a-z0-9]+|[^a-z0-9]+"), F.lit(0))
    moved = F.transform(runs, lambda x: F.when(x.rlike("^[a-z0-9]"), permute_long(x, 36, 12, key, "mail")).otherwise(x))
    return F.concat(F.array_join(moved, ""), F.lit("@"), domain)


def phone(value: Column, key: str) -> Column:
    """The same number for every spelling of it; null where it cannot be one."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    code = F.regexp_extract(digits, "^(" + COUNTRY_CODES.replace(" ", "|") + r"|\d{3})", 1)
    own = F.substring(digits, F.length(code) + 1, F.length(digits))
    valid = F.length(digits).between(8, 15) & ((code != "1") | (F.length(own) == 10))
    return F.when(valid, refill(value, F.concat(code, permute_long(own, 10, 16, key, "phone"))))


def secret(value: Column, key: str) -> Column:
    moved = permute_long(F.lower(value), 16, 12, key, "secret")
    return F.when(value.rlike("[A-F]"), F.upper(moved)).otherwise(moved)


def pseudonym(kind: Column, value: Column, key: str) -> Column:
    """The pseudonym of one value of a known kind, null if the value fails its check."""
    return F.when(kind == "email", email(value, key)).when(kind == "date", date(value, key)).when(kind == "ipv4", ipv4(value, key)).when(kind == "ssn", ssn(value, key)).when(kind == "phone", phone(value, key)).when(kind == "card", card(value, key)).otherwise(secret(value, key))


def kind_of(value: Column) -> Column:
    """The first kind whose pattern a found value fits in whole."""
    out = F.lit("secret")
    for name, p in reversed(KINDS[:-1]):
        out = F.when(value.rlike("^(?:" + p + ")$"), name).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, and a new column ``pii`` of (kind, value, pseudonym) in order; no shuffle.

    Values that fail their check are neither rewritten nor listed.  A ``pii`` column that ``docs`` already has is replaced.
    """
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(pattern()), F.lit(0)))
    listed = F.transform(found, lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value")))
    moved = F.transform(F.col("chronolith_found"), lambda f: F.struct(f["kind"].alias("kind"), f["value"].alias("value"), pseudonym(f["kind"], f["value"], key).alias("pseudonym")))
    between = F.split(text, pattern())
    joined = F.array_join(F.zip_with(between, "pii", lambda a, b: F.concat(a, F.coalesce(b["pseudonym"], b["value"], F.lit("")))), "")
    valid = F.filter("pii", lambda p: p["pseudonym"].isNotNull())
    own = docs.columns
    step = docs.drop("pii").withColumn("chronolith_found", listed).withColumn("pii", F.coalesce(moved, F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>"))).drop("chronolith_found")
    step = step.withColumn(text, F.when(F.size("pii") > 0, joined).otherwise(F.col(text))).withColumn("pii", valid)
    return step.select(*[c for c in own if c != "pii"], "pii")
