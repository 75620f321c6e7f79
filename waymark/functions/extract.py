"""Fields taken out of free text about routes and stops, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cleaned, minutes_of


def given(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def number(text: Column) -> Column:
    """A decimal number with a comma or a dot."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), number)


#: Labels of the fields in a route's description, and words that end a path or mark a fare.
START, END = r"(?iu)Điểm đầu:\s*([^\n\r;]+)", r"(?iu)Điểm cuối:\s*([^\n\r;]+)"
HOURS = r"(?iu)(?:Thời gian hoạt động|Thời gian mở tuyến|Thời gian hoạt động hàng ngày)[^:]*:\s*([^\n\r]+)"
FREQUENCY = r"(?iu)(?:Tần suất hoạt động|Tần suất chạy xe|Giãn cách chạy xe)[^:]*:\s*([^\n\r]+)"
DISTANCE = r"(?iu)(?:^|\n)\s*(?:(?:\d+\.|\b[a-z]\))\s*)?Cự ly(?!\s+di\s+chuyển)(?:\s+tuyến|\s+toàn\s+tuyến|\s*\(.*?\))?\s*:\s*([^\n\r]+)"
FARE_WORDS = ("đồng", "hành khách", "giá vé", "vé lượt", "trở xuống", "trở lên")
PATHS = {side: rf"(?iu)(?:{label}):\s*([^\n\r]+(?:\n[^\n\r#1-9STT\+]+)?)" for side, label in (("outbound", r"Chiều đi|\+ Chiều đi|Hành trình chạy xe:\s*Chiều đi"), ("inbound", r"Chiều về|\+ Chiều về"))}
PATH_ENDS = ("STT", "Bảng điểm dừng", "4. Giá vé", "5. Cự ly", "b) Cự ly", "2. Điểm đầu")
PRIORITY, REGULAR = r"(?iu)ưu tiên[^:]*:\s*([\d.]+)\s*đồng", r"(?iu)không ưu tiên[^:]*:\s*([\d.]+)\s*đồng"
SINGLE = ("8.000 đồng", 8000)


def field(text: Column, pattern: str) -> Column:
    """What stands behind a label on its line, cleaned; empty if there is none."""
    return cleaned(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1))


def terminals(text: Column) -> Column:
    """struct<origin, destination>: the labels of both ends."""
    return F.struct(field(text, START).alias("origin"), field(text, END).alias("destination"))


def distances(text: Column) -> Column:
    """struct<average, outbound, inbound> of kilometres from the first distance line that has numbers and no words of fares; null without one.

    One number is the average; two are out and back, averaged to two decimals; of three and more the first is the average and the next two are out and back.
    """
    lines = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DISTANCE), F.lit(1)), cleaned)
    free = F.filter(lines, lambda x: ~given(F.lower(x), lambda low: reduce(or_, [low.contains(w) for w in FARE_WORDS])))
    kilometres = F.transform(free, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?i)(\d+(?:[.,]\d+)?)\s*km"), F.lit(1)), number))
    one = lambda average, out, back: F.struct(average.cast("double").alias("average"), out.cast("double").alias("outbound"), back.cast("double").alias("inbound"))
    none = F.lit(None)

    def read(found: Column) -> Column:
        at = lambda k: F.try_element_at(found, F.lit(k))
        return F.when(F.size(found) == 1, one(at(1), none, none)).when(F.size(found) == 2, one(F.round((at(1) + at(2)) / 2, 2), at(1), at(2))).when(F.size(found) > 2, one(at(1), at(2), at(3)))

    return given(F.try_element_at(F.filter(kilometres, lambda n: F.size(n) > 0), F.lit(1)), read)


def hours(text: Column) -> Column:
    """struct<start, end> in minutes of the day: the first two times such as 5h15 or 05:15 behind the label of operating hours; nulls unless there are two."""
    times = F.transform(F.regexp_extract_all(field(text, HOURS), F.lit(r"(\d{1,2}[h:]\d{2})"), F.lit(1)), lambda x: F.replace(x, F.lit("h"), F.lit(":")))

    def read(found: Column) -> Column:
        at = lambda k: F.when(F.size(found) > 1, minutes_of(F.try_element_at(found, F.lit(k))))
        return F.struct(at(1).alias("start"), at(2).alias("end"))

    return given(times, read)


def headways(text: Column) -> Column:
    """struct<low, high>: the least and greatest number of minutes behind the label of frequency, or else in brackets behind the hours."""
    named, bracket = field(text, FREQUENCY), F.regexp_extract(field(text, HOURS), r"\(([^)]+phút[^)]*)\)", 1)
    phrase = given(named, lambda x: F.when(x != "", x).otherwise(bracket))
    minutes = F.transform(F.regexp_extract_all(phrase, F.lit(r"(\d+)\s*phút"), F.lit(1)), lambda x: x.try_cast("int"))
    return given(minutes, lambda x: F.struct(F.array_min(x).alias("low"), F.array_max(x).alias("high")))


def paths(text: Column) -> Column:
    """struct<outbound, inbound>: the path texts of both directions, cut where the next section begins.

    A path may go on in the next line, as far as that holds no digit from 1 to 9, ``#``, ``+`` or letter of the table's heading.
    """

    def cut(path: Column) -> Column:
        for word in PATH_ENDS:
            path = F.trim(F.substring_index(path, word, 1))
        return path

    return F.struct(*[cut(field(text, pattern)).alias(side) for side, pattern in PATHS.items()])


def fares(text: Column) -> Column:
    """struct<single, priority, regular>: the fixed single fare if the text names it, and the two monthly fares."""
    amount = lambda pattern: F.replace(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit("."), F.lit("")).try_cast("long")
    single = F.when(F.coalesce(text, F.lit("")).contains(SINGLE[0]), F.lit(SINGLE[1]).cast("long"))
    return F.struct(single.alias("single"), amount(PRIORITY).alias("priority"), amount(REGULAR).alias("regular"))


def house_number(text: Column) -> Column:
    """Leading or named house number such as ``Số 128`` or ``12A``; empty if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)(?:^|số\s+|đối diện\s+(?:số\s+)?)(\d+[a-z]?)\b", 1)


def opposite(text: Column) -> Column:
    """Whether a stop lies across from the named place."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(r"^(?:đối diện|đd)\b|\(đối diện\)")


#: Fixed value: badges of routes before a stop's name, 01 to 29.
BADGES = r"^(?:(?:0[1-9]|[12][0-9])\s*)+"


def without_badge(label: Column) -> Column:
    """A label without the route badges before it. Other numbers, such as those of houses, stay unless they begin like a badge."""
    return F.regexp_replace(label, BADGES, "")


def last_part(text: Column) -> Column:
    """What stands after the last dash; the whole label where that is empty."""
    tail = cleaned(F.regexp_replace(text, "^.*-", ""))
    return F.when(tail != "", tail).otherwise(F.coalesce(text, F.lit("")))


#: Labels in the text of a vehicle, the brand named by its beginning, the word of electric ones, and what is said without figures.
BRAND, CAPACITY = r"(?iu)Nhãn hiệu:\s*([^;\n]+)", r"(?iu)Sức chứa:\s*([^;\n]+)"
NAMED_BRAND, ELECTRIC_WORD = "GAZ", "điện"
ELECTRIC, BUS, VEHICLE, NO_DATA = "Xe buýt điện", "Xe buýt", "Phương tiện", "Chưa có dữ liệu"


def vehicle(text: Column) -> Column:
    """struct<brand, capacity, description>: what stands behind the labels of brand and capacity. Without a brand a named or electric one, without a capacity the kind of bus describes it."""
    raw = F.coalesce(text, F.lit(""))
    labelled = lambda pattern: cleaned(F.regexp_extract(raw, pattern, 1))
    electric = F.lower(raw).contains(ELECTRIC_WORD)
    named = F.when(raw.rlike(BRAND), labelled(BRAND)).when(cleaned(raw).startswith(NAMED_BRAND), F.lit(NAMED_BRAND)).otherwise(F.lit(""))
    capacity = labelled(CAPACITY)
    brand = F.when(named != "", named).when(electric, F.lit(ELECTRIC)).otherwise(F.lit(NO_DATA))
    described = F.when(capacity != "", capacity).when(electric, F.lit(ELECTRIC)).otherwise(F.lit(BUS))
    full = F.struct(brand.alias("brand"), capacity.alias("capacity"), described.alias("description"))
    return F.when(cleaned(raw) == "", F.struct(F.lit(NO_DATA).alias("brand"), F.lit("").alias("capacity"), F.lit(VEHICLE).alias("description"))).otherwise(full)


def seats(capacity: Column) -> Column:
    """The number before ``chỗ`` in a capacity."""
    return F.regexp_extract(F.coalesce(capacity, F.lit("")), r"(?iu)(\d+)\s*chỗ", 1).try_cast("int")


def following_departure(minute: Column, peak: Column, off_peak: Column) -> Column:
    """The departure after one, by the first positive headway of peak and off-peak, over midnight; null without one."""
    positive = lambda c: F.when((c > 0) & (c.cast("double") < F.lit(float("inf"))), c)
    return F.pmod(minute + F.coalesce(positive(peak), positive(off_peak)), F.lit(1440))


#: A date, or a date and a time of day with an optional zone.
DATE_FORM = r"^\d{4}-\d{2}-\d{2}(?:[T ](?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?)?(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?)?$"


def is_date(text: Column) -> Column:
    """Whether a text names a day that exists, with or without a time."""
    return F.coalesce(text.rlike(DATE_FORM) & F.substring(text, 1, 10).try_cast("date").isNotNull(), F.lit(False))


def override_problem(begin: Column, end: Column, proven: Column) -> Column:
    """The first problem of an override: bounds that are no dates, in wrong order (as texts), or missing provenance."""
    return F.when(~(is_date(begin) & is_date(end)), F.lit("invalid_date")).when(begin > end, F.lit("reversed")).when(~F.coalesce(proven, F.lit(False)), F.lit("unproven"))
