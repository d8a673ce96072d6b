"""Scalar text functions: normal forms, the four built-in classes with their validators, masks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The built-in classes, the look-alikes folded before patterns, and refused e-mail endings.
CLASS_PATTERNS = {
    "ssn": r"(?<![\d.])(?:\d{3}([-\s.])\d{2}\1\d{4}|\d{9})(?!\d)",
    "credit-card": r"(?<![\d.])(?:\d[-\s.]?){12,18}\d(?!\d)",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "us-phone": r"(?<![\d.])(?:\+?1[-\s.]?)?\(?\d{3}\)?[-\s.]?\d{3}[-\s.]?\d{4}(?!\d)",
}
DASHES = "\u00ad\u2010\u2011\u2012\u2013\u2014\u2015\u2043\u2212"
SPACES = "\u00a0\u2007\u2009\u200a\u202f\u3000"
EMAIL_FILE_ENDINGS = ("png", "jpg", "jpeg", "gif", "bmp", "svg", "webp", "tif", "tiff", "pdf", "eps", "ico", "heic")
PRODUCER_FAMILIES = (
    ("acrobat", "acrobat"), ("distiller", "acrobat"), ("microsoft", "office"), ("word", "office"), ("powerpoint", "office"),
    ("excel", "office"), ("libreoffice", "libreoffice"), ("openoffice", "libreoffice"), ("ghostscript", "ghostscript"),
    ("skia", "chromium"), ("chromium", "chromium"), ("quartz", "quartz"), ("preview", "quartz"),
)

#: Java's names for what these stand for in patterns: white space, digits and word characters of any script.
DIALECT = {"s": r"\t-\r\x1C-\x20\x85\p{Z}", "d": r"\p{Nd}", "w": r"\p{L}\p{N}_"}
_ATOM = re.compile(r"\\[\s\S]|\[\^?\]?|\]|[^\\\[\]]+")


_EDGE = "(?:(?<=[{0}])(?![{0}])|(?<![{0}])(?=[{0}]))".format(DIALECT["w"])
_NO_EDGE = "(?:(?<=[{0}])(?=[{0}])|(?<![{0}])(?![{0}]))".format(DIALECT["w"])


def java(source: str) -> str:
    """A pattern in Java's notation: its short classes hold every script, and ``[``, ``&&`` and ``#``
    inside brackets are themselves.  A short class that is negated inside brackets is refused."""
    out, inside = [], False
    for m in _ATOM.finditer(source):
        a = m[0]
        if not inside and a[0] == "[":
            inside = True
            out.append(a.replace("]", r"\]"))
        elif inside and a == "]":
            inside = False
            out.append(a)
        elif inside and a[0] == "[":
            out.append(a.replace("[", r"\[").replace("]", "") + ("]" if a[-1] == "]" else ""))
            inside = a[-1] != "]"
        elif a[0] == "\\" and a[1:].lower() in DIALECT:
            if inside and a[1].isupper():
                raise ValueError(f"{a} inside brackets is not supported")
            out.append(DIALECT[a[1]] if inside else f"[{'^' if a[1].isupper() else ''}{DIALECT[a[1].lower()]}]")
        elif a in (r"\b", r"\B") and not inside:
            out.append(_EDGE if a == r"\b" else _NO_EDGE)
        else:
            out.append(a.replace("&&", r"&\&") if inside else a)
    return "".join(out)


#: Longest stretches that can hold a match: every character of a match is one of these.
RUNS = {"email": "[A-Za-z0-9._%+@-]{5,}"} | dict.fromkeys(("ssn", "credit-card", "us-phone"), java(r"[\d\s().+-]{9,}"))
#: Texts of these characters are the same under NFKC, and decompose as the table below says.
PLAIN = r"^[\x01-\x7F\xA1-\xA7\xA9\xAB\xAC\xAE\xB0\xB1\xB6\xBB\xBF-\xFF]*$"
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100) if len(unicodedata.normalize("NFKD", chr(c))) > 1)
_BASES = "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)


def _normal(text: str | None) -> str | None:
    if text is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return "".join(c for c in bare if "a" <= c <= "z" or "0" <= c <= "9")


_FOLD = {**{ord(c): "-" for c in DASHES}, **{ord(c): " " for c in SPACES}, 0: None}


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(_FOLD)


def normalize_any(text: Column) -> Column:
    def each(s: pd.Series) -> pd.Series:
        return s.map(_normal, na_action="ignore")

    return F.pandas_udf(each, "string")(text)


def fold_any(text: Column) -> Column:
    def each(s: pd.Series) -> pd.Series:
        return s.map(_fold, na_action="ignore")

    return F.pandas_udf(each, "string")(text)


def normalize_plain(text: Column) -> Column:
    """``normalize`` of texts that are PLAIN."""
    return F.regexp_replace(F.lower(F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), _ACCENTED, _BASES)), "[^a-z0-9]+", "")


def by_alphabet(df: DataFrame, text: str, out: str, plain: Column, other: Column) -> DataFrame:
    """``out`` from built-in functions where the text is PLAIN, from an Arrow function elsewhere; a null stays null.

    ``other`` is a function of a column: it gets null for texts that are PLAIN, so they cost it nothing,
    and the source is read once.
    """
    is_plain = F.coalesce(F.col(text).rlike(PLAIN), F.lit(True))
    marked = df.withColumn("_other", other(F.when(~is_plain, F.col(text))))
    return marked.withColumn(out, F.when(F.col("_other").isNotNull(), F.col("_other")).otherwise(plain)).drop("_other")


def normalized(df: DataFrame, text: str, out: str = "norm") -> DataFrame:
    """Compatibility forms and accents folded, case folded, all but a-z and 0-9 dropped."""
    return by_alphabet(df, text, out, normalize_plain(F.col(text)), normalize_any)


def folded(df: DataFrame, text: str, out: str = "folded") -> DataFrame:
    """Dashes and spaces made ASCII, full-width digits too, NUL dropped: what class patterns read."""
    return by_alphabet(df, text, out, F.col(text), fold_any)


def _wide(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).casefold()
    kept = (c for c in bare.replace("ı", "i") if c.isalnum())
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in kept)


def wide_any(text: Column) -> Column:
    """Letters and digits of any script, case and accents folded, decimal digits as ASCII."""

    def each(s: pd.Series) -> pd.Series:
        return s.map(_wide, na_action="ignore")

    return F.pandas_udf(each, "string")(text)


_DECIMALS = [chr(c) for c in range(128, 0x1FFFF) if unicodedata.category(chr(c)) == "Nd" and c < 0x10000]
_AS_ASCII = "".join(str(unicodedata.decimal(c)) for c in _DECIMALS)


def digits(value: Column) -> Column:
    """The decimal digits of any script."""
    return F.regexp_replace(value, "\\P{Nd}", "")


def _valid_ssn(m: Column) -> Column:
    d = digits(m)
    return ~(F.substring(d, 1, 3).isin("000", "666") | d.startswith("9") | (F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000"))


def _valid_card(m: Column) -> Column:
    d = digits(m)
    n = F.length(d)
    return n.between(13, 19) & ~d.rlike(r"^(\p{Nd})\1*$") & F.call_function("luhn_check", F.translate(d, "".join(_DECIMALS), _AS_ASCII)) & ~((n == 14) & F.substring(d, 1, 2).isin("19", "20"))


def _valid_email(m: Column) -> Column:
    return ~F.lower(F.substring_index(m, ".", -1)).isin(*EMAIL_FILE_ENDINGS)


def _valid_phone(m: Column) -> Column:
    return F.regexp_replace(digits(m), r"^1(?=\p{Nd}{10}$)", "").rlike(r"^[2-9]\p{Nd}{2}[2-9]\p{Nd}{6}$")


VALIDATORS: dict[str, Callable[[Column], Column]] = {"ssn": _valid_ssn, "credit-card": _valid_card, "email": _valid_email, "us-phone": _valid_phone}


def class_matches(text: Column, name: str) -> Column:
    """All validated matches of a class, by place; each place is tried, so a refused match hides none."""
    ahead = "(?=(" + java(CLASS_PATTERNS[name]).replace(r"\1", r"\2") + "))"
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({RUNS[name]})"), 1), lambda run: F.regexp_extract_all(run, F.lit(ahead), 1)))
    return F.filter(found, lambda m: VALIDATORS[name](m))


def first_match(text: Column, name: str) -> Column:
    """The leftmost validated match of a class, or null."""
    return F.get(class_matches(text, name), F.lit(0))


def pattern_matches(text: Column, source: str, flags: str = "m") -> Column:
    """All matches of a custom pattern by place, in ``folded`` text; empty ones are none."""
    inner = re.sub(r"((?:\\\\)*\\)([1-9]\d?)", lambda m: m[1] + str(int(m[2]) + 1), java(source))
    ahead = f"(?d{flags})(?=({inner}))"  # d: a line ends at a line feed alone
    return F.filter(F.regexp_extract_all(text, F.lit(ahead), 1), lambda m: m != "")


def rule_match(text: Column, kind: str, source: str, flags: str = "m") -> Column:
    """The first validated match of a class, or the first match of a pattern; null if none."""
    if kind == "class":
        return first_match(text, source)
    return F.get(pattern_matches(text, source, flags), F.lit(0))


def _shown(sample: str, values: frozenset[str], chars: frozenset[str], full: bool) -> str:
    reveal = min(4, len(sample) // 2)
    if full or not reveal:
        return "****"
    tail = sample[-reveal:]
    forms = set(_wide(tail)) | set(_normal(tail))
    for c in tail:
        forms.update(_wide(c), _normal(c))
    if forms & chars or any(v in f for f in (_wide(sample), _normal(sample)) for v in values):
        return "****"
    return "****" + tail


def masked(sample: Column, values: list[str], full: Column | None = None) -> Column:
    """``mask`` by the whole rule, for samples, which are few: only ``****`` where ``full``, where the
    sample holds a listed value, or where a shown character, in either folding, is one of a value's."""
    listed = frozenset(v for v in map(_wide, values) if v)
    chars = frozenset(c for v in listed for c in v)

    def each(s: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _shown(x, listed, chars, bool(y)) for x, y in zip(s, f, strict=True)], dtype=object)

    return F.pandas_udf(each, "string")(sample, full if full is not None else F.lit(False))


def mask(sample: Column, values: Column | None = None, full: Column | bool = False) -> Column:
    """At most four and at most half of the characters, at the end, behind ``****``.

    Only ``****`` where ``full``, or where a shown letter or digit is one of the characters in
    ``values`` (all characters of the listed values, normal form).
    """
    tail = F.right(sample, F.least(F.lit(4), F.floor(F.length(sample) / 2).cast("int")))
    hide = F.lit(full) if isinstance(full, bool) else full
    if values is not None:
        hide = hide | F.arrays_overlap(F.split(normalize_plain(tail), ""), F.array_remove(F.split(values, ""), ""))
    return F.concat(F.lit("****"), F.when(hide, F.lit("")).otherwise(tail))


def collapse_separators(text: Column) -> Column:
    return F.regexp_replace(text, java(r"[-\s]{2,}"), "-")


def producer_family(producer: Column) -> Column:
    out = F.when(producer.isNull() | (producer == ""), "unknown")
    for needle, family in PRODUCER_FAMILIES:
        out = out.when(F.contains(F.lower(producer), F.lit(needle)), family)
    return out.otherwise("other")


def record_key(salt: Column, rule: Column, masked: Column) -> Column:
    nul = F.lit("\0")
    return F.left(F.sha2(F.concat(salt, nul, rule, nul, masked), 256), F.lit(32))


def looks_binary(text: Column) -> Column:
    """Fewer than 85 % of the first 65,536 bytes are printable ASCII, tab, line or form feed or return."""
    head = F.decode(F.substring(text.cast("binary"), 1, 65536), "ISO-8859-1")
    plain = F.length(F.regexp_replace(head, r"[^\x20-\x7E\t\n\r\f]", ""))
    return plain < 0.85 * F.length(head)


def latin(text: Column) -> Column:
    """What a drawn label can show: typographic marks as ASCII, other characters beyond Latin-1, and
    those that do not print, as their number."""

    def each(s: pd.Series) -> pd.Series:
        return s.map(_latin, na_action="ignore")

    return F.pandas_udf(each, "string")(text)


# Marks that labels show in ASCII.
TYPOGRAPHIC = {"\u2014": "--", "\u2013": "-", "\u2026": "...", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"'}


def _latin(text: str) -> str:
    plain = unicodedata.normalize("NFC", text).translate({ord(k): v for k, v in TYPOGRAPHIC.items()})
    return "".join(c if c <= "\xff" and c.isprintable() else "\\u{%04X}" % ord(c) for c in plain)


def generated_id(element: Column) -> Column:
    """Whether an identifier looks written by a tool: hexadecimal digits and dashes alone."""
    return element.rlike(r"\A[0-9A-Fa-f-]+\z")


def sanitized(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ ]]", "�")
