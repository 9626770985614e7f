"""Surrogates for personal data, with built-in column functions only.

Entities are found by one pattern of alternatives, so that matches never overlap: by their own form (e-mails, phones,
IP addresses, cards, social security numbers, IBANs, key formats), by a key word before them (secrets, dates of
birth, passport numbers, names after a label), by a title or given name and a run of capitals, or capitals before a
given name (persons), and by the kind of street (addresses).  Names that neither list, title nor label tells stay.  No quantified group backtracks, so a text of any length needs a bounded stack.

A surrogate keeps the type and the format (separators, letter case, country code, card network and checksum, a
name's gender and script), the same value gets the same surrogate in every document and way of writing it, and
different values get different ones.  Numbers are permuted: a keyed Feistel network over all numbers of one form,
and its inverse after a step of one, is a cycle through all of them, so that no two meet and none stays.  Dates of
birth are moved within their decade, by keyed cycles through dates that exist.  Other surrogates are drawn from a digest of (key, type,
normalised value, attempt) and checked over all documents: where two values drew the same, or a surrogate is itself
a value that occurs, the later value draws again with the next attempt, whose space is larger.  Only such
exceptions need a lookup; up to ``INLINE`` of them travel as a map, more are joined by entity.

Defined results: null stays null and empty text stays empty, with 0 entities; rows that share an id are treated
one by one; extra columns are ignored; an empty input gives an empty output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, documents, staged

INLINE = 500
WIDE_FROM = 8  # attempts after which a short IP address becomes a whole one
ROUNDS = 6  # of the Feistel network

#: Given names by gender and script, and the syllables that surnames are made of.
GIVEN = {
    ("f", "latin"): "Alice Anna Clara Diana Elena Emma Hanna Irene Julia Laura Maria Mary Nina Olivia Paula Rosa Sarah Sofia Susan Vera",
    ("m", "latin"): "Adam Carlos Daniel David Erik Felix George Henry James John Karl Louis Marco Oscar Paul Peter Robert Simon Thomas Victor",
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна",
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Сергей",
}
SYLLABLES = {"latin": "ba del mor ten vin lar ros kim sto wel har nor gal fen dur pel", "cyrillic": "ба дел мор тен вин лар рос ким сто вел гар нор гал фен дур пел"}
TITLES = {"f": "Mrs Ms Miss Madame Frau Señora Sra", "m": "Mr Monsieur Herr Señor", "n": "Dr Prof Doctor Professor Mx"}

#: Further given names that mark a person; surrogates are drawn from GIVEN.
KNOWN = {
    "f": "Priya Ananya Giulia Chiara Fatima Aisha Amara Ngozi Yuki Sakura Mei Ling Zofia Katarzyna Ingrid Astrid Camille Chloé Inés Lucía Aylin Zeynep Аня Катя Юлия Оксана Amanda Amy Angela Barbara Betty Carol Charlotte Christine Deborah Dorothy Elizabeth Emily Hannah Heather Jennifer Jessica Karen Kate Katherine Kathleen Kelly Kimberly Lisa Linda Lucy Margaret Megan Melissa Michelle Nancy Nicole Pamela Patricia Rachel Rebecca Ruth Sandra Sharon Sophie Stephanie",
    "m": "Arjun Rahul Giovanni Luca Mohammed Ahmed Omar Chidi Emeka Hiroshi Kenji Wei Jun Piotr Tomasz Lars Sven Pierre Jean Javier Diego Mehmet Emre Саша Юрий Максим Alan Alex Andrew Anthony Ben Benjamin Bill Bob Brian Charles Christopher Donald Edward Eric Frank Gary Gregory Jacob Jason Jeffrey Jonathan Joseph Joshua Justin Kenneth Kevin Larry Mark Matthew Michael Nicholas Patrick Richard Ronald Ryan Scott Stephen Steven Thomas Timothy William",
}
#: What stands before a name, or a date of birth.
NAME_LABELS = "name Name signed Signed contact Contact attn Attn author Author patient Patient customer Customer"
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Place Pl Square Sq Terrace Way"

#: Words in capitals that are no family names where a given name follows.
_NO_FAMILY = "THE|AND|FROM|WITH|DEAR|FOR|TO|BY|OF|HI|HELLO|NOTE|RE|CC|ATTN|NAME|SIGNED|CONTACT|MR|MRS|MS|DR|PROF|SIR|HEY|OR|AT|IN|ON|AS|MY|HIS|HER|IS|WAS"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAMES = "|".join(n for names in (*GIVEN.values(), *KNOWN.values()) for n in names.split())
_TITLE = "|".join(t for titles in TITLES.values() for t in titles.split())
#: Lengths of IBANs by country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Groups of four and a last shorter one, compact or spaced: of the country's length, else of 15 to 34 characters.

    Without a country's length, a last group after a blank has a digit, so that a word or currency that follows stays.
    """
    def body(n):
        return rf"(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    known = "|".join(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}{body(n)}(?![A-Za-z0-9])" for n, countries in IBAN_LENGTHS.items())
    def last(n):
        return rf"(?:[A-Z0-9]{{1,{n}}}| (?=[A-Z]{{0,{n - 1}}}[0-9])[A-Z0-9]{{1,{n}}})"

    other = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?: ?[A-Z0-9]{{4}}){{7}}{last(2)}?|(?: ?[A-Z0-9]{{4}}){{3,6}}{last(3)}?|(?: ?[A-Z0-9]{{4}}){{2}} ?[A-Z0-9]{{3}})(?![A-Za-z0-9])"
    return rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|{other})"


_SECRET = r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)['\"]?\s{0,3}[=:]\s{0,3}['\"]?"
_IPV4 = r"(?<![0-9.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})"
_NATIONAL = r"(?:\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})"
#: What follows a blank and is an entity by itself is no further group of a phone number.
_MORE = rf"(?! (?:{_IPV4}|{_SSN}|{_NATIONAL}(?![0-9])|{_CARD}(?![0-9]| [0-9]{{4}}(?![0-9]))))[ .\-]?[0-9]{{2,4}}"
_TOO_LONG = "|".join(r"\+" + n * r"[ .\-()]{0,2}[0-9]" for n in range(16, 20))  # Java wants look-behinds without repeated groups
#: Country code 1 has ten digits after it; any number has 15 digits at most.
_INTERNATIONAL = (
    r"\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])"
    rf"|\+[0-9]{{1,3}}[ .\-]?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})[ .\-]?[0-9]{{2,4}}{_MORE}(?:{_MORE}(?<!{_TOO_LONG}))?"
)
_LABEL = "(?:" + NAME_LABELS.replace(" ", "|") + ")"
_CAPITAL = r"\p{Lu}[\p{L}'\-]{1,30}+"
_BIRTH = r"(?:[Bb]orn(?: on)?|[Dd]ate of [Bb]irth|[Bb]irth ?[Dd]ate|DOB|dob|[Gg]eboren am|[Nn]ée? le|[Ff]echa de nacimiento)"
_DATE = r"(?:[0-9]{1,2}([./\-])[0-9]{1,2}\%d(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_IPV6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?:(?::{_HEX}){{1,4}}|:)|(?=[0-9A-Fa-f:]{{0,40}}[0-9])[0-9A-Fa-f]{{3,4}}:(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])"
PATTERNS = {
    "SECRET": r"(?=[TtSsPpAa])" + _SECRET + r"[A-Za-z0-9_\-/+]{16,}+",
    "KEY": r"(?<![A-Za-z0-9])(?=[AgsxeB])(?:A[KS]IA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_\-]{20,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+|eyJ[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+)",
    "EMAIL": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?=[A-Za-z0-9.\-]*?\.[A-Za-z]{2})[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*+",
    "IBAN": r"(?<![A-Za-z0-9])" + _iban(),
    "PERSON": rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?!(?:{_NO_FAMILY}) )\p{{Lu}}[\p{{Lu}}'\-]{{1,20}}+ (?:{_NAMES})(?![\p{{L}}\-])|(?:(?:{_TITLE})\.? (?:(?:{_NAMES}) )?|(?:{_NAMES}) )\p{{Lu}}[\p{{L}}'\-]++)|(?<=(?<!\p{{L}}){_LABEL}: {{0,2}}|[Mm]y name is )(?=\p{{Lu}}){_CAPITAL}(?: {_CAPITAL}){{1,2}}+",
    "ADDRESS": rf"(?<![\p{{L}}\p{{N}}])(?:[0-9]{{1,5}}[A-Za-z]? (?=\p{{Lu}})(?:(?!(?:{STREETS.replace(' ', '|')})(?!\p{{L}})){_CAPITAL} ){{1,3}}+(?:{STREETS.replace(' ', '|')})(?!\p{{L}})|(?=\p{{Lu}})\p{{L}}{{2,30}}?(?:straße|strasse|weg|platz|allee) [0-9]{{1,4}}(?![\p{{L}}0-9]))",
    "PASSPORT": r"(?<=[Pp]assport(?: [Nn]o\.?| [Nn]umber| [Nn]r\.?)?[:#]? {0,2})[A-Z]{0,2}[0-9]{6,9}(?![A-Za-z0-9])",
    "BIRTH": rf"(?<={_BIRTH}[:=]?\s{{0,2}})" + _DATE,
    "IPV6": _IPV6,
    "IPV4": _IPV4,
    "SSN": _SSN,
    "PHONE": rf"(?<![0-9+])(?:{_INTERNATIONAL}|{_NATIONAL})(?![0-9])",
    "CARD": _CARD + r"(?![0-9])",
}
#: Types whose surrogates are drawn from a digest and checked; those of numbers are permuted.
DRAWN = ("SECRET", "KEY", "EMAIL", "IBAN", "PERSON", "ADDRESS", "IPV6", "PASSPORT")
#: Each type has its own left boundary; what the alternatives share is decided first, so that most positions of a
#: text cost a few comparisons.  A secret's key word may follow anything ('client_secret', 'DB_PASSWORD').
_WORDS, _NUMBERS = ("KEY", "EMAIL", "IBAN", "PERSON", "ADDRESS", "IPV6", "PASSPORT"), ("BIRTH", "IPV4", "SSN", "PHONE", "CARD")
COMBINED = PATTERNS["SECRET"] + r"|(?<![A-Za-z0-9])(?=[\p{Lu}A-Za-z0-9._%+\-])(?:" + "|".join(PATTERNS[k] for k in _WORDS) + ")|(?=[0-9+(])(?:" + "|".join(PATTERNS[k] for k in _NUMBERS).replace("%d", "1") + ")"
_CYRILLIC = r"[Ѐ-ӿ]"


def kind_of(raw: Column) -> Column:
    """The type of one match: the first alternative that it fits as a whole."""
    shapes = [(kind, _DATE if kind == "BIRTH" else "[A-Z]{0,2}[0-9]{6,9}" if kind == "PASSPORT" else pattern) for kind, pattern in PATTERNS.items() if kind != "PERSON"]
    return reduce(lambda rest, item: F.when(raw.rlike(f"^(?:{item[1].replace('%d', '1')})$"), F.lit(item[0])).otherwise(rest), reversed(shapes), F.lit("PERSON"))


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _person_parts(raw: Column) -> tuple[Column, Column, Column]:
    """Title with its blank, given name, surname; absent parts are empty."""
    title = F.regexp_extract(raw, rf"^((?:{_TITLE})\.? )", 1)
    rest = F.substring(raw, F.length(title) + 1, F.length(raw))
    turned = _turned(raw)
    given = F.when(turned, F.substring_index(rest, " ", -1)).otherwise(F.regexp_extract(rest, r"^(\p{L}[\p{L}'\-]*+) ", 1))
    surname = F.when(turned, F.substring_index(rest, " ", 1)).when(given == "", rest).otherwise(F.substring(rest, F.length(given) + 2, F.length(rest)))
    return title, given, surname


def _turned(raw: Column) -> Column:
    """A family name in capitals before a given name that is not."""
    return raw.rlike(r"^\p{Lu}[\p{Lu}'\-]+ \p{Lu}\p{Ll}")


def normalised(kind: Column, raw: Column) -> Column:
    """What is the same for every way of writing one entity."""
    country = F.regexp_extract(raw, r"^\+([0-9]{1,3})(?=[ .\-(])", 1)
    number = F.concat(country, F.lit("|"), F.substring(_digits(raw), F.length(country) + 1, 40))
    _, given, surname = _person_parts(raw)
    return (
        F.when(kind == "PHONE", number).when(kind.isin("CARD", "SSN"), _digits(raw)).when(kind == "EMAIL", F.lower(raw))
        .when(kind == "IBAN", F.regexp_replace(raw, " ", "")).when(kind == "SECRET", F.regexp_replace(raw, "^" + _SECRET, ""))
        .when(kind == "PERSON", F.concat(_gender(raw), F.lit("|"), given, F.lit("|"), F.when(_turned(raw), F.initcap(surname)).otherwise(surname))).when(kind == "IPV6", F.lower(raw)).otherwise(raw)
    )


def _gender(raw: Column) -> Column:
    """f, m, or n if neither the given name nor a title tells."""
    title, given, _ = _person_parts(raw)
    names = {g: [n for (of, _), more in GIVEN.items() if of == g for n in more.split()] + KNOWN[g].split() for g in "fm"}
    plain = F.regexp_replace(title, r"\.? $", "")
    first = F.when(given.isin(names["f"]), "f").when(given.isin(names["m"]), "m")
    return F.coalesce(first, F.when(plain.isin(TITLES["f"].split()), "f").when(plain.isin(TITLES["m"].split()), "m"), F.lit("n"))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(value: Column) -> Column:
    return F.split(value, "(?!^)(?=.)")


def _pick(digest: Column, at: Column, words: str) -> Column:
    items = words.split()
    return F.element_at(F.array(*map(F.lit, items)), (_byte(digest, at) * 256 + _byte(digest, at + 1)) % len(items) + 1)


def _scrambled(value: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """Letters for letters of the same case, digits for digits; anything else stays."""
    def one(c, i):
        byte = _byte(digest, i)
        lower = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), byte % (6 if hexadecimal else 26) + 1, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), (byte % 10).cast("string")).when(c.rlike("^[a-z]$"), lower).when(c.rlike("^[A-Z]$"), F.upper(lower)).otherwise(c)

    return F.array_join(F.transform(_letters(value), one), "")


def _cycled(a: Column, b: Column, ma: Column, mb: Column, seed: Column) -> Column:
    """The next pair (a, b) below (ma, mb) on a keyed cycle through all of them: forward rounds, a step of one, rounds back."""
    def draw(r, x, modulus):
        return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", seed, r.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("bigint") % modulus

    def step(s, k):
        back = k > ROUNDS
        r = F.when(back, 2 * ROUNDS - k).otherwise(k)
        sign = F.when(back, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
        first = F.struct(F.pmod(s["a"] + sign * draw(r, s["b"], ma), ma).alias("a"), s["b"].alias("b"))
        second = F.struct(s["a"].alias("a"), F.pmod(s["b"] + sign * draw(r, s["a"], mb), mb).alias("b"))
        next_one = F.struct(F.when(s["b"] + 1 == mb, (s["a"] + 1) % ma).otherwise(s["a"]).alias("a"), ((s["b"] + 1) % mb).alias("b"))
        return F.when(k == ROUNDS, next_one).when(r % 2 == 0, first).otherwise(second)

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _ten(power: Column) -> Column:
    return F.pow(F.lit(10.0), power).cast("bigint")


def _number(digits: Column, seed: Column) -> Column:
    """As many digits (20 at most), the first of them zero only if it was: another number for each, by a keyed cycle."""
    zero = F.substring(digits, 1, 1) == "0"
    return _permuted(digits, seed, zero)


def _any_digits(digits: Column, seed: Column) -> Column:
    """As many digits, whatever the first is."""
    return _permuted(digits, seed, None)


def _permuted(digits: Column, seed: Column, zero: Column | None) -> Column:
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    high = n - low
    none = F.lit(0).cast("bigint")
    base = none if zero is None else F.when(zero, none).otherwise(_ten(high - 1))
    span = _ten(high) if zero is None else F.when(zero, _ten(high - 1)).otherwise(9 * _ten(high - 1))
    a = F.substr(digits, F.lit(1), high).cast("bigint") - base
    b = F.when(low > 0, F.substr(digits, high + 1, F.greatest(low, F.lit(1))).cast("bigint")).otherwise(none)
    new = _cycled(a, b, span, _ten(low), F.concat_ws("\x1f", seed, n.cast("string")))
    # bound once: the pair is read twice
    made = F.transform(F.array(new), lambda s: F.concat(F.lpad((s["a"] + base).cast("string"), high, "0"), F.when(low > 0, F.lpad(s["b"].cast("string"), low, "0")).otherwise(F.lit(""))))
    return F.when(n > 0, F.get(made, F.lit(0))).otherwise(digits)


def _luhn_sum(digits: Column) -> Column:
    def value(c, i):
        doubled = c.cast("int") * 2
        return F.when(i % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(F.reverse(_letters(digits)), value), F.lit(0), lambda a, x: a + x)


def _card(digits: Column, seed: Column) -> Column:
    """The same first digit and length, and a check digit as far from the valid one as the original's was."""
    first, middle = F.substring(digits, 1, 1), F.substr(digits, F.lit(2), F.length(digits) - 2)
    body = F.concat(first, _any_digits(middle, F.concat(seed, first)))
    off = _luhn_sum(digits) % 10  # 0: valid
    return F.get(F.transform(F.array(body), lambda x: F.concat(x, ((10 - _luhn_sum(F.concat(x, F.lit("0"))) % 10 + off) % 10).cast("string"))), F.lit(0))


def digest_of(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """64 keyed bytes, in hex."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))


def _address(octets: Column, seed: Column) -> Column:
    """Another IPv4 address, by a keyed cycle through all."""
    part = [F.get(octets, F.lit(i)).cast("bigint") for i in range(4)]
    half = F.lit(65536).cast("bigint")
    new = _cycled(part[0] * 256 + part[1], part[2] * 256 + part[3], half, half, seed)
    text = F.transform(F.array(new), lambda s: F.concat_ws(".", *[x.cast("string") for h in "ab" for x in (F.shiftright(s[h], 8), s[h] % 256)]))
    return F.get(text, F.lit(0))


_LONG_MONTHS, _MONTHS = (1, 3, 5, 7, 8, 10, 12), (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)


def _moved(date: Column, key: str) -> Column:
    """Another date of the decade in the same format, by keyed cycles: no two dates of one format meet, none stays, and all exist.

    Days up to 12 stay so, as do those from 13 to 28, 29 and 30, and 31: what tells the day from the month in a format
    goes on telling it.  The 29th of February goes to another leap year.
    """
    shift = F.conv(F.substring(F.sha2(F.lit(key + "birth"), 256), 1, 6), 16, 10).cast("int")
    mark = F.regexp_extract(date, "[^0-9]", 0)
    parts = F.split(date, "[^0-9]")
    iso = F.length(F.get(parts, F.lit(0))) == 4
    first, second = F.get(parts, F.lit(1)), F.when(iso, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0)))
    turned = ~iso & (first.cast("int") > 12)  # the month stands first
    month_text, day_text = F.when(turned, second).otherwise(first), F.when(turned, first).otherwise(second)
    year = F.when(iso, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(2))).cast("int")
    day, month = day_text.cast("int"), month_text.cast("int")
    decade, unit = F.floor(year / 10).cast("int") * 10, year % 10

    def cycle(low: int, days: int, months: tuple[int, ...]) -> Column:
        """struct(d, m, y) one step on through all (year, month, day) of the decade with such days and months."""
        size = 10 * len(months) * days
        at = (unit * len(months) + F.array_position(F.array(*map(F.lit, months)), month).cast("int") - 1) * days + day - low
        to = F.pmod(at + shift % (size - 1) + 1, F.lit(size))
        return F.struct((to % days + low).alias("d"), F.element_at(F.array(*map(F.lit, months)), F.floor(to / days).cast("int") % len(months) + 1).alias("m"), (decade + F.floor(to / (days * len(months))).cast("int")).alias("y"))

    leap = lambda y: (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    later = F.filter(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: decade + (unit + k) % 10), leap)
    leaps = F.struct(F.lit(29).alias("d"), F.lit(2).alias("m"), F.coalesce(F.get(later, F.lit(0)), year).alias("y"))
    everything = tuple(range(1, 13))
    new = F.when((month == 2) & (day == 29), leaps).when(day <= 12, cycle(1, 12, everything)).when(day <= 28, cycle(13, 16, everything)).when((day <= 30) & month.isin(*_MONTHS), cycle(29, 2, _MONTHS)).when((day == 31) & month.isin(*_LONG_MONTHS), cycle(31, 1, _LONG_MONTHS))
    padded = lambda n, like: F.lpad(n.cast("string"), F.greatest(F.length(like), F.length(n.cast("string"))), "0")

    def written(n):
        d, m, y = padded(n["d"], day_text), padded(n["m"], month_text), n["y"].cast("string")
        text = F.when(iso, F.concat_ws("|", y, m, d)).when(turned, F.concat_ws("|", m, d, y)).otherwise(F.concat_ws("|", d, m, y))
        return F.when(n.isNotNull() & month.between(1, 12), F.replace(text, F.lit("|"), mark)).otherwise(_any_digits_kept(date, shift))

    return F.get(F.transform(F.array(new), written), F.lit(0))


def _any_digits_kept(date: Column, shift: Column) -> Column:
    """What is no date moves digit by digit."""
    return F.array_join(F.transform(_letters(date), lambda c: F.when(c.rlike("^[0-9]$"), ((c.cast("int") + shift % 9 + 1) % 10).cast("string")).otherwise(c)), "")


def surrogate_value(kind: Column, norm: Column, attempt: Column, digest: Column, key: str) -> Column:
    """The surrogate in normalised form; a later attempt draws from a larger space, where the form allows it."""
    more = F.substr(F.reverse(digest), F.lit(1), attempt)  # as many characters as there were attempts before
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(_scrambled(local, digest), more, F.lit("@"), _scrambled(host, F.reverse(digest)), top)
    seed = F.concat_ws("\x1f", F.lit(key), kind)
    country = F.substring_index(norm, "|", 1)
    phone = F.concat(country, F.lit("|"), _number(F.substring_index(norm, "|", -1), F.concat_ws("\x1f", seed, country)))
    iban = F.concat(F.substring(norm, 1, 2), _scrambled(F.substring(norm, 3, 60), digest))
    secret = F.concat(F.when(norm.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), _scrambled(norm, digest, True)).otherwise(_scrambled(norm, digest)), more)
    prefix = F.regexp_extract(norm, "^(A[KS]IA|gh[pousr]_|sk-|xox[abprs]-|eyJ)", 1)
    token = F.concat(prefix, _scrambled(F.substr(norm, F.length(prefix) + 1), digest), F.when(prefix.rlike("IA"), F.upper(more)).otherwise(more))
    gender, given, surname = F.substring_index(norm, "|", 1), F.substring_index(F.substring_index(norm, "|", 2), "|", -1), F.substring_index(norm, "|", -1)
    gender = F.when(gender == "n", F.when(_byte(digest, F.lit(19)) % 2 == 0, "f").otherwise("m")).otherwise(gender)
    cyrillic = F.concat(given, surname).rlike(_CYRILLIC)
    new_given = F.lit("")
    for (g, script), names in GIVEN.items():
        fits = (gender == g) & (cyrillic if script == "cyrillic" else ~cyrillic)
        new_given = F.when(fits, _pick(digest, F.lit(20), names)).otherwise(new_given)
    new_given = F.when(given == "", F.lit("")).otherwise(new_given)
    def family(words):
        syllables = F.transform(F.sequence(F.lit(0), attempt + 2), lambda k: _pick(digest, k * 3 + 24, words))
        return F.initcap(F.array_join(syllables, ""))

    new_surname = F.when(cyrillic, family(SYLLABLES["cyrillic"])).otherwise(family(SYLLABLES["latin"]))
    person = F.concat(F.substring_index(norm, "|", 1), F.lit("|"), new_given, F.lit("|"), new_surname)
    number, kind_of_street = F.regexp_extract(norm, "[0-9]+", 0), F.regexp_extract(norm, "( \\p{L}+|straße|strasse|weg|platz|allee)(?: [0-9]+)?$", 1)
    house = _number(number, F.concat_ws("\x1f", seed, norm))
    address = F.when(norm.rlike("^[0-9]"), F.concat(house, F.lit(" "), family(SYLLABLES["latin"]), kind_of_street)).otherwise(F.concat(family(SYLLABLES["latin"]), kind_of_street, F.lit(" "), house))
    return (
        F.when(kind == "EMAIL", email).when(kind == "PHONE", phone).when(kind == "IPV4", _address(F.split(norm, r"\."), seed)).when(kind == "CARD", _card(norm, seed))
        .when(kind == "SSN", _any_digits(norm, seed)).when(kind == "IBAN", iban).when(kind == "SECRET", secret).when(kind == "KEY", token).when(kind == "ADDRESS", address)
        .when(kind == "IPV6", F.when(attempt < WIDE_FROM, _scrambled(norm, digest, True)).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substr(digest, k * 4 + 1, F.lit(4))), ":")))
        .when(kind == "PASSPORT", F.concat(_scrambled(norm, digest), F.when(attempt < WIDE_FROM, "").otherwise(more))).when(kind == "BIRTH", _moved(norm, key)).otherwise(person)
    )


def _poured(shape: Column, letters: Column, slot: str) -> Column:
    """The shape with its characters of the slot's class replaced, in turn, by the letters."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    def step(a, c):
        fits = c.rlike(slot)
        return F.struct(F.concat(a["out"], F.when(fits, F.substr(letters, a["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (a["k"] + fits.cast("int")).alias("k"))

    return F.aggregate(_letters(shape), start, step)["out"]


def rendered(kind: Column, raw: Column, value: Column) -> Column:
    """A surrogate in the way its entity was written."""
    numeric = _poured(raw, F.regexp_replace(value, r"\|", ""), "^[0-9]$")
    cased = F.array_join(F.transform(F.arrays_zip(_letters(value).alias("v"), _letters(raw).alias("r")), lambda z: F.when(z["r"].rlike("^[A-Z]$"), F.upper(z["v"])).otherwise(z["v"])), "")
    title, given, surname = _person_parts(raw)
    new_given, new_surname = F.substring_index(F.substring_index(value, "|", 2), "|", -1), F.substring_index(value, "|", -1)
    new_surname = F.when((surname == F.upper(surname)) & (F.length(surname) > 1), F.upper(new_surname)).otherwise(new_surname)
    person = F.when(_turned(raw), F.concat(new_surname, F.lit(" "), new_given)).otherwise(F.concat(title, new_given, F.when(given == "", F.lit("")).otherwise(F.lit(" ")), new_surname))
    return (
        F.when(kind.isin("PHONE", "CARD", "SSN"), numeric).when(kind == "EMAIL", cased).when(kind == "IBAN", _poured(raw, value, "^[A-Z0-9]$"))
        .when(kind == "SECRET", F.concat(F.regexp_extract(raw, "^(" + _SECRET + ")", 1), value)).when(kind == "PERSON", person).otherwise(value)
    )


def found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(COMBINED), F.lit(0))


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, attempt -> adds the value drawn at that attempt."""
    drawn = entities.withColumn("digest", digest_of(F.col("kind"), F.col("norm"), F.col("attempt"), key))
    return drawn.withColumn("value", surrogate_value(F.col("kind"), F.col("norm"), F.col("attempt"), F.col("digest"), key)).drop("digest")


def exceptions(texts: DataFrame, key: str) -> DataFrame:
    """kind, norm, attempt of the drawn entities whose first draw is taken; the rest have attempt 0."""
    raw = texts.select(F.explode(found(F.col("text"))).alias("raw")).distinct().withColumn("kind", kind_of(F.col("raw"))).where(F.col("kind").isin(*DRAWN))
    entities = raw.select("kind", normalised(F.col("kind"), F.col("raw")).alias("norm")).distinct().withColumn("attempt", F.lit(0))
    drawn = staged(_drawn(entities, key), "pii")
    while True:  # every attempt draws from a larger space, so some round is the last
        # those that drew first (least attempt, then least value) keep what they drew
        owner = drawn.groupBy("kind", "value").agg(F.min(F.struct("attempt", "norm")).alias("owner"), F.count(F.lit(1)).alias("n"))
        real = drawn.select("kind", F.col("norm").alias("value"), F.lit(True).alias("real"))
        checked = drawn.join(owner, ["kind", "value"]).join(real, ["kind", "value"], "left")
        again = F.coalesce("real", F.lit(False)) | ((F.col("n") > 1) & (F.col("owner.norm") != F.col("norm")))
        retry = checked.where(again).select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        if retry.isEmpty():
            return drawn.where("attempt > 0").select("kind", "norm", "attempt")
        after = staged(checked.where(~again).select("kind", "norm", "attempt", "value").unionByName(_drawn(retry, key)), "pii")
        discard(drawn)
        drawn = after


def replaced(docs: DataFrame, key: str = "surrogates", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities, of every document.

    What is known of each entity is built up column by column: each is computed once.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    taken = exceptions(rows, key)
    marked = rows.withColumn("_raw", F.coalesce(found(F.col("text")), F.array().cast("array<string>")))
    marked = marked.withColumn("_kind", F.transform("_raw", kind_of))
    marked = marked.withColumn("_norm", F.zip_with("_kind", "_raw", normalised))
    few = taken.limit(INLINE + 1).collect()
    if len(few) <= INLINE:
        later = F.create_map(*[F.lit(x) for r in few for x in (f"{r['kind']}\x1f{r['norm']}", r["attempt"])]) if few else None
        attempt = (lambda kind, norm: F.coalesce(later[F.concat_ws("\x1f", kind, norm)], F.lit(0))) if few else (lambda kind, norm: F.lit(0))
        ready = marked.withColumn("_attempt", F.zip_with("_kind", "_norm", attempt))
    else:
        same = F.xxhash64("text")
        each = marked.select("doc_id", same.alias("_same"), F.posexplode(F.arrays_zip("_kind", "_norm")).alias("_at", "_one")).distinct()
        each = each.select("doc_id", "_same", "_at", F.col("_one._kind").alias("kind"), F.col("_one._norm").alias("norm")).join(taken, ["kind", "norm"], "left")
        lists = each.groupBy("doc_id", "_same").agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("attempt", F.lit(0)).alias("n")))).alias("_l"))
        lists = lists.select(F.col("doc_id").alias("_id"), F.col("_same").alias("_s"), F.transform("_l", lambda m: m["n"]).alias("_attempt"))
        ready = marked.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (same == F.col("_s")), "left").drop("_id", "_s")
        ready = ready.withColumn("_attempt", F.coalesce("_attempt", F.array().cast("array<int>")))
    ready = ready.withColumn("_e", F.arrays_zip("_raw", "_kind", "_norm", "_attempt"))
    ready = ready.withColumn("_e", F.transform("_e", lambda e: F.struct(e["_raw"].alias("raw"), e["_kind"].alias("kind"), e["_norm"].alias("norm"), e["_attempt"].alias("attempt"), digest_of(e["_kind"], e["_norm"], e["_attempt"], key).alias("digest"))))
    ready = ready.withColumn("_v", F.transform("_e", lambda e: surrogate_value(e["kind"], e["norm"], e["attempt"], e["digest"], key)))
    ready = ready.withColumn("_new", F.zip_with("_e", "_v", lambda e, v: rendered(e["kind"], e["raw"], v)))
    gaps = F.split("text", COMBINED, -1)
    whole = F.array_join(F.zip_with(gaps, F.concat("_new", F.array(F.lit(""))), lambda gap, new: F.concat(gap, new)), "")
    text = F.when(F.size("_raw") > 0, whole).otherwise(F.col("text"))
    return ready.select("doc_id", text.alias("text"), F.size("_raw").cast("bigint").alias("n_entities"))


def op10_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replaced(documents(spark, sf_dir))


QUERIES = {"op10_pii_surrogates": op10_pii_surrogates}
ORACLES = {}
