"""Text normalization as Column -> Column functions: digits, numbers, dates, typed values.

Parsing never raises: what does not parse is null, and callers choose the fallback.  What a rule refers to several
times is bound once, so that no pattern runs twice on a value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

THAI_DIGITS, ARABIC_DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
# The date and Buddhist-era patterns that results depend on.
DATE_PATTERN = r"([0-9]{1,2})\s*[/\-.]\s*([0-9]{1,2})\s*[/\-.]\s*([0-9]{2,4})"
BUDDHIST_PATTERN = r"พ\.?\s?ศ\.?"
WHITE_ENDS, CANONICAL_NUMBER = r"(?U)^\s+|\s+$", r"^(0|[1-9][0-9]{0,14})(\.[0-9]{1,10})?\z"
USUAL_DATE = r"^[0-9]{2}[/\-.][0-9]{2}[/\-.](1[0-9]{3}|2[0-3][0-9]{2})\z"  # of DATE_PATTERN, before BUDDHIST_FROM
BUDDHIST_OFFSET, BUDDHIST_FROM, CENTURY_PIVOT = 543, 2400, 50


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once a row however often ``use`` refers to it.

    ELEMENT_AT knows the type of ``use``; GET derives it from the whole expression again for every row.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _plain(s: Column) -> Column:
    """Whether a text has ASCII characters only."""
    return F.length(s) == F.octet_length(s)


def _tight(s: Column) -> Column:
    """Whether a text has ASCII characters only, the first and the last of them visible: nothing to trim or to translate."""
    return _plain(s) & (F.ascii(s) > 32) & (F.ascii(F.substring(s, -1, 1)) > 32)


def trimmed(s: Column) -> Column:
    """Trim of all Unicode white space, not only blanks."""
    return F.when(_tight(s), s).otherwise(F.regexp_replace(s, WHITE_ENDS, ""))


def blank_to_null(s: Column) -> Column:
    return F.nullif(trimmed(s), F.lit(""))


def is_blank(s: Column) -> Column:
    return ~F.coalesce(s.rlike(r"(?U)\S"), F.lit(False))


def arabic_digits(s: Column) -> Column:
    return F.when(_plain(s), s).otherwise(F.translate(s, THAI_DIGITS, ARABIC_DIGITS))


def number_text(s: Column) -> Column:
    """The number in a text as canonical text that keeps its scale; null if there is none.

    A trailing minus counts as a sign; a lone or second dot, or a minus inside, does not parse.
    """
    def signed(kept):
        return F.when(kept.endswith("-") & (F.instr(kept, "-") == F.length(kept)), F.concat(F.lit("-"), F.substr(kept, F.lit(1), F.length(kept) - 1))).otherwise(kept)

    def canonical(kept):
        valid = kept.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$") & (F.length(F.translate(kept, "-.", "")) <= 28)
        return F.when(valid, bound(F.regexp_replace(kept, r"^(-?)0*(?=[0-9])", "$1"), whole_part))

    def whole_part(n):
        cut = F.when(n.endswith("."), F.substr(n, F.lit(1), F.length(n) - 1)).otherwise(n)
        return bound(cut, lambda c: F.when(c.startswith("."), F.concat(F.lit("0"), c)).when(c.startswith("-"), negative(c)).otherwise(c))

    def negative(n):
        zero = F.translate(n, "-0.", "") == ""
        full = F.when(n.startswith("-."), F.concat(F.lit("-0"), F.substr(n, F.lit(2)))).otherwise(n)
        return F.when(zero, F.substr(full, F.lit(2))).otherwise(full)

    def parsed(text):
        return bound(F.regexp_replace(arabic_digits(text), r"[^0-9.\-]", ""), lambda kept: F.when(kept != "", bound(signed(kept), canonical)))

    return bound(s, lambda text: F.when(text.rlike(CANONICAL_NUMBER), text).otherwise(parsed(text)))


def number(s: Column, scale: int = 10) -> Column:
    return number_text(s).try_cast(f"decimal(38,{scale})")


def looks_like_date(s: Column) -> Column:
    return F.coalesce(arabic_digits(s).rlike(DATE_PATTERN), F.lit(False))


def _date_parts(text: Column) -> Column:
    """The three numbers of the first date in a text of Arabic digits, as texts; another length if there is none."""
    return F.split(F.regexp_extract(text, DATE_PATTERN, 0), r"\s*[/\-.]\s*")


def _part(parts: Column, k: int) -> Column:
    return F.get(parts, F.lit(k)).cast("int")


def date_order_vote(s: Column) -> Column:
    """``D`` or ``M`` if the first date in the text decides day-first or month-first; else null."""
    return bound(_date_parts(arabic_digits(s)), lambda p: F.when(F.size(p) == 3, F.when(_part(p, 0) > 12, "D").when(_part(p, 1) > 12, "M")))


def date_value(s: Column, order: Column) -> Column:
    """The first date in the text; ``order`` is ``M`` for month-first, anything else is day-first."""
    def of(text, parts):
        a, b, y = (_part(parts, k) for k in range(3))
        month_first = F.when(a > 12, False).when(b > 12, True).otherwise(F.coalesce(order == "M", F.lit(False)))
        full = F.when(y < 100, y + F.when(y >= CENTURY_PIVOT, 1900).otherwise(2000)).otherwise(y)
        known = F.struct(a.alias("a"), b.alias("b"), full.alias("y"), month_first.alias("swap"))
        return bound(known, lambda d: bound(d["y"] - F.when((d["y"] >= BUDDHIST_FROM) | (~_plain(text) & text.rlike(BUDDHIST_PATTERN)), BUDDHIST_OFFSET).otherwise(0), lambda year: day(d, year)))

    def day(d, year):
        first, second = F.lpad(d["a"].cast("string"), 2, "0"), F.lpad(d["b"].cast("string"), 2, "0")
        rest = F.when(d["swap"], F.concat_ws("-", first, second)).otherwise(F.concat_ws("-", second, first))
        return F.when(year >= 1, F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), rest).try_cast("date"))

    return bound(arabic_digits(s), lambda text: bound(_date_parts(text), lambda parts: F.when(F.size(parts) == 3, of(text, parts))))


def date_text(s: Column, order: Column) -> Column:
    return date_value(s, order).cast("string")


def normalized(s: Column, order: Column) -> Column:
    """struct(value, kind): a date before a number before text; text that stays as it is has a null value."""
    def made(value, kind):
        return F.struct(value.cast("string").alias("value"), F.lit(kind).alias("kind"))

    def other(text):
        return bound(number_text(text), lambda num: F.when(num.isNotNull(), made(num, "Number")).otherwise(made(F.when(text != s, text), "Text")))

    filled = bound(arabic_digits(s), lambda text: bound(date_text(text, order), lambda day: F.when(day.isNotNull(), made(day, "Date")).otherwise(other(text))))
    return F.when(is_blank(s), made(F.lit(None), "Text")).otherwise(filled)


def _integer(num: Column) -> Column:
    """A canonical number's whole part; a lone sign or minus zero is zero."""
    return bound(F.substring_index(num, ".", 1), lambda n: F.when(n == "-0", F.lit("0")).otherwise(n))


def typed_text(s: Column, data_type: Column | str, order: Column) -> Column:
    """Canonical text of a value of the type; what does not parse, and any STRING, is its Arabic-digit text; blank is null."""
    return typed_as(s, F.upper(data_type) if isinstance(data_type, Column) else data_type.upper(), order)


def typed_as(s: Column, kind: Column | str, order: Column) -> Column:
    """``typed_text`` by a type in capitals."""
    makers = {
        "DECIMAL": lambda p: F.coalesce(number_text(p), p), "INT": lambda p: F.coalesce(_integer(number_text(p)), p),
        "BOOL": lambda p: F.when(F.lower(p).isin("1", "true", "yes", "y"), "True").otherwise("False"), "DATE": lambda p: F.coalesce(date_text(p, order), p),
    }
    if isinstance(kind, Column):
        def make(p):
            value = p
            for name, maker in makers.items():
                value = F.when(kind == name, maker(p)).otherwise(value)
            return value
    else:
        make = makers.get(kind, lambda p: p)
    def cleaned(text):
        return F.when(_tight(text), text).otherwise(F.regexp_replace(F.translate(text, THAI_DIGITS, ARABIC_DIGITS), WHITE_ENDS, ""))

    def usual(text):
        """What most values are needs no rule: a canonical number, a date in fixed places, a text as it stays."""
        a, b = F.substring(text, 1, 2), F.substring(text, 4, 2)
        swap = F.when(a > "12", False).when(b > "12", True).otherwise(F.coalesce(order == "M", F.lit(False)))
        day = F.concat_ws("-", F.substring(text, 7, 4), F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)).try_cast("date")
        number = text.rlike(CANONICAL_NUMBER)
        return (
            F.when((kind == "DECIMAL") & number, text).when((kind == "INT") & number, F.substring_index(text, ".", 1)).when((kind == "STRING") & _tight(text), text)
            .when((kind == "DATE") & text.rlike(USUAL_DATE), F.coalesce(day.cast("string"), text)).otherwise(bound(cleaned(text), lambda p: F.when(p != "", make(p))))
        )

    return bound(s, usual if isinstance(kind, Column) else lambda text: bound(cleaned(text), lambda p: F.when(p != "", make(p))))


def typed_cell(s: Column, data_type: Column | str, order: Column) -> Column:
    """The union cell struct(kind, text, dec, lng, bool): ``text`` is canonical, the others hold what parsed."""
    kind = F.upper(data_type if isinstance(data_type, Column) else F.lit(data_type))
    text = typed_text(s, data_type, order)
    return F.struct(
        kind.alias("kind"), text.alias("text"), F.when(kind == "DECIMAL", text.try_cast("decimal(38,10)")).alias("dec"),
        F.when(kind == "INT", text.try_cast("bigint")).alias("lng"), F.when(kind == "BOOL", text == "True").alias("bool"),
    )


def ocr_languages(s: Column) -> Column:
    """Allow-list of recognition languages; anything else is null."""
    plain = F.lower(trimmed(s))
    return F.when(plain.isin("eng", "tha"), plain).when(plain.isin("tha+eng", "eng+tha"), "tha+eng")


def page_role(s: Column, unknown: str | None = "FIRST") -> Column:
    plain = F.upper(trimmed(F.coalesce(s, F.lit(""))))
    other = F.lit(unknown).cast("string")
    return F.when(plain == "FIRST", "FIRST").when(plain.isin("CONTINUATION", "CONT"), "CONTINUATION").when(plain == "LAST", "LAST").otherwise(other)
