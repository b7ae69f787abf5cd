"""Text, numbers, dates, codes and names as native column expressions. A null text gives null or, where noted, ''."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
QUOTES = "«»\"'`"
SPACES = "         　"
DASHES = "‐‑‒–—−"
UNITS = {"штука": "шт", "штук": "шт", "шт": "шт", "комплект": "компл", "компл": "компл"}
NAME_STOP = ["товарный", "знак", "тип", "этап", "услуга", "услуги", "оказание", "поставка", "предоставление", "передача", "программное", "обеспечение"]
LATIN, CYRILLIC = "ABCEHKMOPTXaceopxyk", "АВСЕНКМОРТХасеорхук"
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
NEGATIVES = ["нет", "не требуется", "не установлено", "отсутствует", "-", "no", "none"]
SHORT_CODE = r"\d{2}\.\d{2}(?:\.\d{2}(?:\.\d{3})?)?"
LONG_CODE = r"\d{2}\.\d{2}\.\d{2}\.\d{3}-\d{8}"
MONEY = r"\d[\d ]*(?:[.,]\d{1,2})?"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def norm_text(c: Column) -> Column:
    """Normal form: case folded, ё as е, without quotes, other signs as blanks. A null gives ''."""
    low = F.replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е")), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.regexp_replace(low, f"[{QUOTES}]", ""), r"[^\p{L}\p{N}_]+", " "))


def clean_typography(c: Column) -> Column:
    """Plain blanks, quotes and dashes; line breaks become '; '; runs of blanks, commas and semicolons are squeezed."""
    plain = F.translate(F.translate(c, SPACES, " " * len(SPACES)), "«»“”„" + DASHES, '"' * 5 + "-" * len(DASHES))
    plain = F.regexp_replace(plain, r"[\r\n]+", "; ")
    for old, new in ((r"[ \t]+", " "), (r" ?,( ?,)+", ","), (r" ?;( ?;)+", ";"), (r" ([,;])", "$1")):
        plain = F.regexp_replace(plain, old, new)
    return F.trim(plain)


def norm_key(c: Column) -> Column:
    """Lower case words joined by underscores."""
    return F.replace(norm_text(c), F.lit(" "), F.lit("_"))


def name_key(c: Column, stop: list[str] = NAME_STOP) -> Column:
    """Normal form without stop words."""
    return F.array_join(F.filter(F.split(norm_text(c), " "), lambda w: ~w.isin(stop)), " ")


def norm_code(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def valid_code(c: Column) -> Column:
    return c.rlike(f"^(?:{LONG_CODE}|{SHORT_CODE}|\\d{{2}}(?:\\.\\d)?)$")


def derive_parent(c: Column) -> Column:
    """Short code of a long one (12 characters before the dash)."""
    return F.when((F.length(c) >= 21) & (F.substring(c, 13, 1) == "-"), F.substring(c, 1, 12))


def norm_unit(c: Column, aliases: dict[str, str] = UNITS) -> Column:
    text = norm_text(c)
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, text), text)


def to_decimal(c: Column, scale: int = 6) -> Column:
    """Number of a text: blanks and other signs dropped, comma as point; what is no number then gives null."""
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"[^\d.\-]", "").try_cast(f"decimal(24,{scale})")


def first_number(c: Column) -> Column:
    return F.replace(F.nullif(F.regexp_extract(c, r"(-?\d+(?:[.,]\d+)?)", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(24,6)")


def to_money(c: Column) -> Column:
    """Two places, half to even."""
    return F.bround(c.cast("decimal(24,6)"), 2).cast("decimal(18,2)")


def money_equal(a: Column, b: Column) -> Column:
    """Null operands are never equal."""
    return F.coalesce(to_money(a) == to_money(b), F.lit(False))


def _longest(c: Column) -> Column:
    return F.aggregate(c, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def extract_money(c: Column) -> Column:
    """The longest 'N руб. M коп.' of a text, else its longest number of at most 16 digits; decimal(18,2)."""
    pair = r"(\d[\d ]*) ?руб[^\d\n]{0,12}(\d{1,2}) ?коп"
    full = _longest(F.regexp_extract_all(c, F.lit(pair), F.lit(0)))
    worded = F.concat(F.replace(F.regexp_extract(full, pair, 1), F.lit(" "), F.lit("")), F.lit("."), F.lpad(F.regexp_extract(full, pair, 2), 2, "0"))
    numbers = F.filter(F.regexp_extract_all(c, F.lit(MONEY), F.lit(0)), lambda x: F.length(F.regexp_replace(x, r"\D", "")) <= 16)
    plain = F.replace(F.replace(_longest(numbers), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(worded, plain).try_cast("decimal(18,2)")


def extract_percents(c: Column) -> Column:
    """Distinct percents in reading order, two places."""
    found = F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?) ?%"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("decimal(9,2)")))


def extract_amounts(c: Column) -> Column:
    """Distinct amounts before a currency word, in reading order; thousands may be spaced."""
    found = F.regexp_extract_all(c, F.lit(r"(\d{1,3}(?: \d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?) ?руб"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")))


def extract_dates(c: Column) -> Column:
    """All dates in reading order: dd.mm.yyyy, yyyy-mm-dd and 'd month yyyy'. Dates that don't exist are left out."""
    month = "|".join(MONTHS)
    found = F.regexp_extract_all(c, F.lit(rf"\d{{2}}\.\d{{2}}\.\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}} (?:{month}) \d{{4}}"), F.lit(0))
    # the last day of each month in a leap year; a date that can't be is dropped before it is read, as a reader that fails is slow
    days = F.array(*[F.lit(n) for n in (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)])

    def plain(x: Column) -> Column:
        word = F.substring_index(F.substring_index(x, " ", 2), " ", -1)
        number = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), word).cast("string"), 2, "0")
        spelled = F.concat_ws("-", F.substring(x, -4, 4), number, F.lpad(F.substring_index(x, " ", 1), 2, "0"))
        pointed = F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2))
        return F.when(F.substring(x, 3, 1) == ".", pointed).when(F.substring(x, 5, 1) == "-", x).otherwise(spelled)

    def exists(x: Column) -> Column:
        return F.substring(x, 9, 2).cast("int").between(1, F.coalesce(F.get(days, F.substring(x, 6, 2).cast("int") - 1), F.lit(0)))

    return F.array_compact(F.transform(F.filter(F.transform(found, plain), exists), lambda x: x.try_cast("date")))


def parse_term(c: Column) -> Column:
    """struct(days, day_type, start_event) of 'within N (working|calendar) days from ...'."""
    days = F.regexp_extract(c, r"(\d{1,4})[^\d\n]{0,40}(?:дн|день)", 1).try_cast("int")
    kind = F.when(F.lower(c).rlike("рабоч"), "working").when(F.lower(c).rlike("календарн"), "calendar")
    event = F.nullif(F.trim(F.regexp_extract(c, r"(?:с даты|с момента|со дня|после) ([^.;\n]{3,80})", 1)), F.lit(""))
    return F.struct(days.alias("days"), kind.alias("day_type"), event.alias("start_event"))


def long_codes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?<!\d){LONG_CODE}(?!\d)"), F.lit(0))


def short_codes(c: Column) -> Column:
    """Short codes that aren't part of a long one."""
    return F.regexp_extract_all(c, F.lit(rf"(?<![\d.-]){SHORT_CODE}(?![\d-]|\.\d)"), F.lit(0))


def fold_homoglyphs(c: Column) -> Column:
    """Latin letters that look like Cyrillic ones as those."""
    return F.translate(c, LATIN, CYRILLIC)


def in_range(value: Column, allowed: Column) -> Column:
    """Whether a number meets all conditions like '<=70' or '>5 <9'; null without a number or a condition."""
    found = F.regexp_extract_all(F.replace(allowed, F.lit(","), F.lit(".")), F.lit(r"(?:<=|>=|≤|≥|<|>|=) ?-?\d+(?:\.\d+)?"), F.lit(0))

    def holds(x: Column) -> Column:
        limit = F.regexp_extract(x, r"(-?\d+(?:\.\d+)?)", 1).cast("decimal(24,6)")
        op = F.regexp_extract(x, r"^([<>=≤≥]+)", 1)
        return F.when(op.isin("<=", "≤"), value <= limit).when(op.isin(">=", "≥"), value >= limit).when(op == "<", value < limit).when(op == ">", value > limit).otherwise(value == limit)

    return F.when(value.isNotNull() & (F.size(found) > 0), F.forall(found, holds))


def split_values(c: Column) -> Column:
    """Values between ; or line breaks; of a single one, between commas if all parts are short. Distinct, in order."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""))
    first, second = clean(F.split(c, r"[;\n]")), clean(F.split(c, ","))
    return F.when((F.size(first) == 1) & F.forall(second, lambda x: F.length(x) <= 120), second).otherwise(first)


def keyword_windows(c: Column, keyword: str, n: int) -> Column:
    """The keyword with at most n characters after it, distinct."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?is){keyword}.{{0,{n}}}"), F.lit(0)))


def fragments(c: Column, marker: str) -> Column:
    """Parts of a text that begin with a marker (a pattern) and end before the next."""
    return F.filter(F.split(c, rf"(?={marker})"), lambda x: x.rlike(f"^{marker}"))


def name_tokens(c: Column, stop: list[str] = NAME_STOP) -> Column:
    """Distinct words of a name of three letters or more, without stop words and numbers."""
    return F.array_distinct(F.filter(F.split(norm_text(c), " "), lambda w: (F.length(w) >= 3) & ~w.isin(stop) & ~w.rlike(r"^\d+$")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if one is empty."""
    n = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def name_support(a: Column, b: Column) -> Column:
    """Whether two token arrays name one thing: a short one within the other, else three quarters or Jaccard 0.55."""
    inter, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(False)).when(least <= 3, inter == least).otherwise((inter / least >= 0.75) | (jaccard(a, b) >= 0.55))


def text_close(a: Column, b: Column) -> Column:
    """Equal, or one contains the other; nothing is close to a null or empty text."""
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def address_core(c: Column) -> Column:
    """struct(houses, street, city) of an address."""
    low = norm_text(c)
    return F.struct(
        F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?:дом|д|зд|стр|корп|house) (\d+)"), F.lit(1)))).alias("houses"),
        F.nullif(F.regexp_extract(low, r"(?:улица|ул|проспект|пр|street) ([\p{L}]+)", 1), F.lit("")).alias("street"),
        F.nullif(F.regexp_extract(low, r"(?:город|г|city) ([\p{L}]+)", 1), F.lit("")).alias("city"),
    )


def to_bool(c: Column) -> Column:
    """True, false or null of a text."""
    low = norm_text(c)
    return F.when(low.rlike(r"^(не |нет|отсутств|no\b|false)"), F.lit(False)).when(low.rlike(r"^(да|установлен|требует|предусмотрен|yes|true)"), F.lit(True))


def parse_security(c: Column) -> Column:
    """struct(required, percent, amount, by_reference) of a security term."""
    low = F.lower(c)
    percent = F.replace(F.nullif(F.regexp_extract(low, r"(\d+(?:[.,]\d+)?) ?%", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(9,4)")
    amount = F.when(low.rlike("руб"), F.get(extract_amounts(low), F.lit(0)))
    reference = low.rlike(r"(?:пункт|раздел|п\.) ?\d")
    return F.struct((~low.rlike("не (?:требуется|установлено|предусмотрено)")).alias("required"), percent.alias("percent"), amount.alias("amount"), reference.alias("by_reference"))


def classify_by_markers(c: Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """Label of the first rule (marker, label) whose marker the lower-cased text contains."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(k)) for m, k in rules], F.lit(default))


def norm_header(path: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Name of the first rule (name, markers) all of whose markers a header path has."""
    low = norm_text(path)
    all_of = lambda ms: reduce(lambda a, b: a & b, [F.contains(low, F.lit(m)) for m in ms])
    return F.coalesce(*[F.when(all_of(ms), F.lit(name)) for name, ms in rules])


def parse_requisites(c: Column) -> Column:
    """struct(number, date) of a letter header: '№ 12-3 от 05.06.2024'."""
    number = F.nullif(F.regexp_extract(c, r"(?:№|N|#) ?([\p{L}\p{N}/-]+)", 1), F.lit(""))
    return F.struct(number.alias("number"), F.get(extract_dates(c), F.lit(0)).alias("date"))
