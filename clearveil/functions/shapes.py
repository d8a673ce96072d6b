"""What surrounds a match, and the tolerant comparisons of a scorecard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The groupings of digits in which values of each class are written.
FORMATTED = {
    "ssn": "^3,2,4$",
    "us-phone": "^(1,)?3,3,4$",
    "credit-card": "^(4,6,5|4,6,4|(4,){2,}[1-4])$",
}
# Epoch milliseconds of 2000-01-01 and 2040-01-01, look-alikes of digits, length of a residue.
EPOCH_MILLIS = (946_684_800_000, 2_208_988_800_000)
LOOK_ALIKES = ("OolI|SsB", "00111558")
RESIDUE = 4

_UUID = "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
_DAY = r"^(19|20)\d\d(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])"


def shape(name: str, before: Column, match: Column, after: Column) -> Column:
    """One word for the match of class ``name`` with the text before and after it; first that fits:
    email-address, formatted, uuid, hex-id, date-or-time, alnum-id, number-list, bare-digits.

    A uuid counts wherever one stands that shares a character with the match.  Null in, null out.
    """
    if name == "email":
        return F.when(match.isNotNull(), "email-address")
    groups = F.array_join(F.transform(F.regexp_extract_all(match, F.lit(r"(\d+)"), 1), lambda g: F.length(g).cast("string")), ",")
    plain = match.rlike(r"\A\d+\z")
    left, right = F.regexp_extract(before, r"([0-9A-Za-z_]*)\z", 1), F.regexp_extract(after, r"\A([0-9A-Za-z_]*)", 1)
    token = F.concat(left, match, right)
    near = F.concat(F.right(before, F.lit(35)), match, F.left(after, F.lit(35)))
    letters = F.regexp_replace(token, "[^A-Za-z]", "")
    day = F.substring(token, 1, 8).rlike(_DAY + "$")
    pdf_date = F.right(F.left(before, F.length(before) - F.length(left)), F.lit(2)) == "D:"
    millis = F.when(match.rlike(r"\A\d{13}\z"), match.cast("long").between(*EPOCH_MILLIS)).otherwise(False)
    dated = (pdf_date & day) | (token.rlike(r"\A\d{12,}\z") & day) | millis
    return (
        F.when(match.isNull() | before.isNull() | after.isNull(), None)
        .when(~plain & groups.rlike(FORMATTED[name]), "formatted")
        .when(near.rlike(_UUID), "uuid")
        .when(letters.rlike("^[A-Fa-f]+$"), "hex-id")
        .when(plain & dated, "date-or-time")
        .when(letters != "", "alnum-id")
        .when(plain, "bare-digits")
        .otherwise("number-list")
    )


def around(text: Column, match: Column, guard: str = "[0-9.]", after: str = "(?![0-9])") -> Column:
    """Struct (before, match, after) of the first place where ``match`` stands unguarded in ``text``."""
    at = F.regexp_instr(text, F.concat(F.lit(f"(?<!{guard})\\Q"), match, F.lit("\\E" + after)))
    return F.struct(F.left(text, at - 1).alias("before"), match.alias("match"), F.substring(text, at + F.length(match), F.length(text)).alias("after"))


def ocr_form(text: Column) -> Column:
    """Case, spacing and punctuation other than @ . / - dropped, look-alike letters as digits."""
    return F.lower(F.translate(F.regexp_replace(text, r"(?U)[^\w@./-]", ""), *LOOK_ALIKES))


def ocr_match(value: Column, text: Column) -> Column:
    """"whole", "near" or null: a value in recognised text, both in ``ocr_form``.

    From nine characters on one edit is whole; up to three edits (one below six characters) are near.
    The text is a line or a cell: each of its places is compared.
    """
    n = F.length(value)
    limit = F.when(n >= 6, 3).otherwise(1)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 2))
    best = F.array_min(F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.transform(places, lambda i: F.levenshtein(value, F.substring(text, i, F.greatest(F.lit(0), n + k)))))))
    return F.when(n == 0, None).when(F.contains(text, value), "whole").when((n >= 9) & (best <= 1), "whole").when(best <= limit, "near")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _digit_grams(d: Column) -> Column:
    return F.when(F.length(d) >= RESIDUE, F.transform(F.sequence(F.lit(1), F.length(d) - (RESIDUE - 1)), lambda i: F.substring(d, i, F.lit(RESIDUE)))).otherwise(F.array().cast("array<string>"))


def residue(text: Column, value: Column) -> Column:
    """A piece of ``value`` left in ``text``: four of its digits in a row in one token (other
    characters of the token dropped), else a word of four or more of its letters; null if none."""
    mine = _digit_grams(_digits(value))
    in_text = F.flatten(F.transform(F.split(text, r"\s+"), lambda t: _digit_grams(_digits(t))))
    words = F.transform(F.regexp_extract_all(value, F.lit(f"([A-Za-z]{{{RESIDUE},}})"), 1), lambda w: F.lower(w))
    word = F.get(F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), 1), lambda w: F.array_contains(words, F.lower(w))), F.lit(0))
    return F.coalesce(F.get(F.filter(in_text, lambda g: F.array_contains(mine, g)), F.lit(0)), word)


def residue_keys(value: Column) -> Column:
    """What a piece of ``value`` can be: four of its digits in a row, or a word of its letters in lower case."""
    words = F.regexp_extract_all(value, F.lit(f"([A-Za-z]{{{RESIDUE},}})"), 1)
    return F.array_distinct(F.concat(_digit_grams(_digits(value)), F.transform(words, lambda w: F.lower(w))))


def residue_pieces(text: Column) -> Column:
    """All that can be a piece of some value, as (nth, key, piece): digits of a token before words, each in order."""
    grams = F.flatten(F.transform(F.split(text, r"\s+"), lambda t: _digit_grams(_digits(t))))
    words = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), 1), lambda w: F.length(w) >= RESIDUE)
    return F.transform(F.concat(grams, words), lambda p, i: F.struct(i.alias("nth"), F.lower(p).alias("key"), p.alias("piece")))


def written_forms(value: Column) -> Column:
    """Ways in which a string object can hold ``value``: as it is, in hexadecimal, as UTF-16, escaped; as binary."""
    latin, wide = F.encode(value, "ISO-8859-1"), F.encode(value, "UTF-16BE")
    text = lambda c: F.encode(c, "ISO-8859-1")
    escaped = F.regexp_replace(value, r"([\\()])", r"\\$1")
    return F.array_distinct(F.array(latin, wide, text(F.lower(F.hex(latin))), text(F.hex(latin)), text(F.lower(F.hex(wide))), text(F.hex(wide)), text(escaped)))


def ordinal(n: Column) -> Column:
    last = F.element_at(F.array(*map(F.lit, ("th", "st", "nd", "rd", "th", "th", "th", "th", "th", "th"))), (n % 10 + 1).cast("int"))
    return F.concat(n.cast("string"), F.when((n % 100).between(10, 20), "th").otherwise(last))
