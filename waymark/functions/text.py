"""Text folding, normalising and extraction as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_map() -> tuple[str, str]:
    """Accented lower-case letters below U+2000 and their base letters, from Unicode decompositions."""
    pairs = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x2000)) if c.islower() and len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.combining(unicodedata.normalize("NFD", c)[1])}
    pairs["đ"] = "d"
    latin = {c: b for c, b in pairs.items() if b.isascii()}
    return "".join(latin), "".join(latin.values())


FROM, TO = fold_map()


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unaccented(text: Column) -> Column:
    """Lower case without accents; null becomes empty."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), FROM, TO), r"[\u0300-\u036f]", "")


def fold(text: Column) -> Column:
    """Lower case without accents and outer white space; null becomes empty."""
    return stripped(unaccented(text))


def normalised(text: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces; accents stay."""
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def cleaned(text: Column) -> Column:
    """No-break spaces and runs of blanks as one space, none at the ends."""
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\u00a0\s]+", " "))


#: Abbreviations of place names and what they stand for, in the order in which they are written out.
ABBREVIATIONS = [
    (r"\b(?:đ/d|d/d|đd)\b", "đối diện"),
    (r"đ/d\s*", "đối diện "),
    (r"\bbxb\b", "bến xe buýt"),
    (r"\bbx\b", "bến xe"),
    (r"\bbv\b", "bệnh viện"),
    (r"\bcv\b", "công viên"),
    (r"\btthc\b", "trung tâm hành chính"),
    (r"\btt\b", "trung tâm"),
    (r"\bđh\b", "đại học"),
    (r"\bcđ\b", "cao đẳng"),
    (r"\bthpt\b", "trung học phổ thông"),
    (r"\bthcs\b", "trung học cơ sở"),
]


def expanded(text: Column) -> Column:
    """Lower case, digits apart from letters, abbreviations written out, marks as spaces, single spaces."""
    out = stripped(F.lower(F.coalesce(text, F.lit(""))))
    out = F.regexp_replace(F.regexp_replace(out, r"(\d+)(\p{L})", "$1 $2"), r"(\p{L})(\d+)", "$1 $2")
    for short, long in ABBREVIATIONS:
        out = F.regexp_replace(out, f"(?U){short}", long)
    return stripped(F.regexp_replace(F.regexp_replace(out, r"""[-–—/.,;:()"“”]""", " "), r"(?U)\s+", " "))


def plain_name(text: Column) -> Column:
    """Lower case with the marks of addresses as spaces and single spaces; accents and other marks stay."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(F.lower(F.coalesce(text, F.lit("")))), r"[,.\-/()–—:;\n\r]", " "), r"(?U)\s+", " "))


def hours_text(start: Column, end: Column) -> Column:
    """Operating hours as HH:mm - HH:mm from texts such as 5:15; an unreadable end is left as it stands, and without both there is a fixed text."""
    padded = lambda x: F.when(x.rlike(r"^\d{1,2}:\d{1,2}$"), F.concat_ws(":", *[F.lpad(F.split(x, ":")[k], 2, "0") for k in (0, 1)])).otherwise(x)
    return F.when((start != "") & (end != ""), F.concat_ws(" - ", padded(start), padded(end))).otherwise(F.lit("Đang cập nhật"))


def path_names(path: Column, least: int = 2, most: int = 60) -> Column:
    """Ordered distinct names of a path text: split at dashes and arrows, without parentheses, of more than ``least`` and under ``most`` characters."""
    plain = F.regexp_replace(F.coalesce(path, F.lit("")), r"\([^)]*\)", "")
    parts = F.transform(F.split(plain, r"\s*(?:->|[-–—→])\s*"), cleaned)
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) > least) & (F.length(x) < most)))


def tokens(text: Column, least: int = 2) -> Column:
    """Distinct folded words of at least ``least`` characters, in order."""
    return F.array_distinct(F.filter(F.split(fold(text), r"[^a-z0-9]+"), lambda x: F.length(x) >= least))


def either_contains(name: Column, token: Column, least: int = 3) -> Column:
    """The token is part of the name, or a name of at least ``least`` characters is part of the token."""
    return name.contains(token) | ((F.length(name) >= least) & token.contains(name))


def grouped(amount: Column) -> Column:
    """A whole amount with dots between thousands."""
    return F.replace(F.format_number(amount.cast("double"), 0), F.lit(","), F.lit("."))


def fare_text(kind: Column, flat: Column, low: Column, high: Column, single: Column) -> Column:
    """Flat, tiered or single fares as text; unknown fares say so."""
    money = lambda x: F.concat(grouped(x), F.lit("đ"))
    tiered = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat_ws(" - ", money(low), money(high))).when(low.isNotNull() & high.isNotNull(), money(low)).when(low.isNotNull(), F.concat(F.lit("Từ "), money(low))).otherwise(F.lit("Theo chặng"))
    return F.when((kind == "flat") & (flat > 0), money(flat)).when(kind == "distance_tiered", tiered).when(single > 0, money(single)).otherwise(F.lit("Đang cập nhật"))


def frequency_text(low: Column, high: Column, peak: Column, off_peak: Column, irregular: Column, raw: Column, short: bool = False) -> Column:
    """Minutes between departures as text; irregular service names its timetable."""
    unit = F.lit("p" if short else " phút")
    first, last = F.coalesce(low, peak), F.coalesce(high, off_peak)
    whole = lambda x: x.cast("long").cast("string")
    odd = F.when(F.lower(F.coalesce(raw, F.lit(""))).contains("bay"), F.lit("Lịch bay" if short else "Theo lịch bay")).otherwise(F.lit("Không cố định" if short else "Giờ không cố định"))
    regular = F.when(first.isNotNull() & last.isNotNull() & (first != last), F.concat(whole(first), F.lit("-"), whole(last), unit)).when(F.coalesce(first, last).isNotNull(), F.concat(whole(F.coalesce(first, last)), unit)).otherwise(F.lit("Đang cập nhật"))
    return F.when(F.coalesce(irregular, F.lit(False)), odd).otherwise(regular)


def clock(minutes: Column) -> Column:
    """Minutes of a day as HH:mm."""
    day = F.pmod(minutes.cast("int"), F.lit(1440))
    return F.concat_ws(":", F.lpad((day / 60).cast("int").cast("string"), 2, "0"), F.lpad((day % 60).cast("string"), 2, "0"))


def minutes_of(text: Column) -> Column:
    """Minutes of a day from H:mm, or null if that is no time."""
    hour, minute = (F.regexp_extract(text, r"^(\d{1,2}):(\d{2})$", k).try_cast("int") for k in (1, 2))
    return F.when(hour.between(0, 23) & minute.between(0, 59), hour * 60 + minute)
