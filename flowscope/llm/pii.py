"""Format-preserving pseudonyms for personal data, with DataFrame operations only.

Found values are validated first: card numbers by issuer prefix, length and check digit, dates by the calendar,
IPv4 addresses by octet range, telephone numbers by their North American layout. Each value is then permuted within
its own format by a keyed Feistel network of ten rounds whose halves are added modulo their ranges, so a card gives
a valid card of the same issuer digits and length, a date a real date, and the punctuation stays. A permutation links
equal values in all documents, and different values of a format stay different. Dates with slashes are month/day/year;
where that is no date, day/month/year, whose results may meet those of the first order.

Two further kinds have no numeric format: the local part of an e-mail address and the hexadecimal value assigned to
a ``token``, ``key``, ``secret`` or ``password`` become keyed hash digits (at least ten for an address).

Defined results: a null text stays null, an empty one empty; numbers that fail validation, dates outside 1700 to 2099
and all text around the values stay as they are; repeated rows give equal results; other columns are untouched, and
only the named text column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import let

ROUNDS = 10

#: The layouts that are searched, in order of preference at the same place.
EMAIL = r"[\p{L}0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
SECRET = r"(?i:token|key|secret|password)\s*[=:]\s*[\"']?[0-9A-Fa-f]{16,}"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])"
PHONE = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
ANY = "|".join((EMAIL, SECRET, IPV4, DATE, PHONE, CARD))
ISSUER = (
    r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}"
    r"|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14}|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12})$"
)
#: 400 Gregorian years from 1700-01-01 are 27 * 5411 days.
DAYS_HIGH, DAYS_LOW, FIRST_DAY = 27, 5411, "1700-01-01"


def keyed_number(key: str, kind: str, step: Column, value: Column) -> Column:
    """52 pseudo-random bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def feistel(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Struct (left, right) after a keyed permutation of pairs below (left_size, right_size)."""

    def step(pair: Column, i: Column) -> Column:
        a = F.when(i % 2 == 0, F.pmod(pair.left + keyed_number(key, kind, i, pair.right), left_size)).otherwise(pair.left)
        b = F.when(i % 2 == 1, F.pmod(pair.right + keyed_number(key, kind, i, pair.left), right_size)).otherwise(pair.right)
        return F.struct(a.alias("left"), b.alias("right"))

    start = F.struct(left.cast("bigint").alias("left"), right.cast("bigint").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""

    def halves(value: Column) -> Column:
        n = F.length(value)
        h = F.floor(n / 2).cast("int")
        left, right = F.substr(value, F.lit(1), h), F.substr(value, h + 1)
        size = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("bigint")
        pair = feistel(key, f"{kind}", left.cast("bigint"), right.cast("bigint"), size(h), size(n - h))
        return let(pair, lambda p: F.concat(F.lpad(p.left.cast("string"), h, F.lit("0")), F.lpad(p.right.cast("string"), n - h, F.lit("0"))))

    return let(digits, halves)


def luhn_sum(digits: Column) -> Column:
    """Check sum of a digit string; the last digit has weight one."""

    def total(rev: Column) -> Column:
        def weighed(i: Column) -> Column:
            d = F.substr(rev, i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(rev)), weighed), F.lit(0), lambda a, x: a + x)

    return let(F.reverse(digits), total)


def laid_out(digits: Column, layout: Column) -> Column:
    """``digits`` in the places that digits have in ``layout``."""
    marks = F.split(F.regexp_replace(layout, "[0-9]", "9"), "")
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def put(done: Column, mark: Column) -> Column:
        digit = mark == "9"
        return F.struct(
            F.concat(done["text"], F.when(digit, F.substr(digits, done["next"], F.lit(1))).otherwise(mark)).alias("text"),
            (done["next"] + digit.cast("int")).alias("next"),
        )

    return F.aggregate(marks, start, put, lambda done: done["text"])


def card(key: str, found: Column) -> Column:
    def permuted(digits: Column) -> Column:
        valid = digits.rlike(ISSUER) & (luhn_sum(digits) % 10 == 0)
        # the four issuer digits and the length stay, the check digit is made anew
        body = F.concat(F.substr(digits, F.lit(1), F.lit(4)), permuted_digits(key, "card", F.substr(digits, F.lit(5), F.length(digits) - 5)))
        fresh = let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(valid, laid_out(fresh, found)).otherwise(found)

    return let(F.regexp_replace(found, "[^0-9]", ""), permuted)


def phone(key: str, found: Column) -> Column:
    def permuted(digits: Column) -> Column:
        lead = F.when(F.length(digits) == 11, F.lit("1")).otherwise(F.lit(""))
        return laid_out(F.concat(lead, permuted_digits(key, "phone", F.right(digits, F.lit(10)))), found)

    return let(F.regexp_replace(found, "[^0-9]", ""), permuted)


def address(key: str, found: Column) -> Column:
    def permuted(octets: Column) -> Column:
        pair = feistel(key, "ipv4", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536))
        dotted = let(pair, lambda p: F.concat_ws(".", *[
            (F.floor(half / 256) if high else half % 256).cast("string") for half in (p.left, p.right) for high in (True, False)
        ]))
        return F.when(F.array_max(octets) <= 255, dotted).otherwise(found)

    return let(F.transform(F.split(found, r"\."), lambda x: x.cast("int")), permuted)


def date(key: str, found: Column) -> Column:
    """ISO dates, and dates with slashes as month/day/year or, where that is none, day/month/year."""

    def permuted(parsed: str, written: str) -> Column:
        def moved(number: Column) -> Column:
            high, low = F.floor(number / DAYS_LOW), F.pmod(number, F.lit(DAYS_LOW))
            pair = feistel(key, "date", high, low, F.lit(DAYS_HIGH), F.lit(DAYS_LOW))
            fresh = let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p.left * DAYS_LOW + p.right).cast("int")))
            return F.when(number.between(0, DAYS_HIGH * DAYS_LOW - 1), F.date_format(fresh, written))

        day = F.try_to_timestamp(found, F.lit(parsed)).cast("date")
        return let(F.datediff(day, F.lit(FIRST_DAY).cast("date")), moved)

    def slashed(first: str, second: str) -> Column:
        parsed, padded = f"{first}/{second}/yyyy", f"{first * 2}/{second * 2}/yyyy"
        return F.when(found.rlike("^[0-9]{2}/[0-9]{2}/"), permuted(parsed, padded)).otherwise(permuted(parsed, parsed))

    slashes = F.coalesce(slashed("M", "d"), slashed("d", "M"))
    return F.coalesce(F.when(found.contains("/"), slashes).otherwise(permuted("yyyy-MM-dd", "yyyy-MM-dd")), found)


def email(key: str, found: Column) -> Column:
    local, domain = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
    digits = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(found)), 256)
    return F.concat(F.substr(digits, F.lit(1), F.least(F.lit(64), F.greatest(F.lit(10), F.length(local)))), F.lit("@"), domain)


def secret(key: str, found: Column) -> Column:
    value = F.regexp_extract(found, "[0-9A-Fa-f]{16,}$", 0)
    digits = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(value)), 256)
    long = F.substr(F.repeat(digits, F.ceil(F.length(value) / 64).cast("int")), F.lit(1), F.length(value))
    fresh = F.when(value == F.upper(value), F.upper(long)).otherwise(long)
    return F.concat(F.substr(found, F.lit(1), F.length(found) - F.length(value)), fresh)


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def pseudonym(key: str, found: Column) -> Column:
    return (
        F.when(found.contains("@"), email(key, found))
        .when(found.rlike(whole(SECRET)), secret(key, found))
        .when(found.rlike(whole(IPV4)), address(key, found))
        .when(found.rlike(whole(DATE)), date(key, found))
        .when(found.rlike(whole(CARD)), card(key, found))
        .otherwise(phone(key, found))
    )


def pseudonymised(text: Column, key: str) -> Column:
    """The text with each found value replaced: the pieces between the values, interleaved with the new values."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    pieces = F.split(text, ANY, -1)
    fresh = F.transform(found, lambda x: pseudonym(key, x))
    joined = F.array_join(F.flatten(F.zip_with(pieces, fresh, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(text.rlike("[0-9@]|(?i:password|secret|token|key)"), joined).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.withColumn(text, pseudonymised(F.col(text), key))


def found_values(docs: DataFrame, key: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per found value: (id, position, value, replacement); a value that fails validation is its own replacement."""
    found = docs.where(F.col(text).rlike("[0-9@]")).select(
        F.col(ident).alias("id"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).alias("position", "value")
    )
    return found.withColumn("replacement", pseudonym(key, F.col("value")))
