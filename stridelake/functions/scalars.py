"""Scalar columns: text, numbers, dates, physiology and geometry. All are built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from stridelake.profile import DEFAULT, Profile

CARDIO = r"cycl|bik|run|walk|hik|ski"


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def hr_zone(hr: Column, profile: Profile = DEFAULT) -> Column:
    """Label of the heart-rate zone; above the last Z5+, below the first Z1, null gives an empty text."""
    names = list(profile.zones)
    case = F.when(hr.isNull(), "")
    for name, (lo, hi) in profile.zones.items():
        case = case.when((hr >= lo) & (hr <= hi), name)
    return case.when(hr > profile.zones[names[-1]][1], names[-1] + "+").otherwise(names[0])


def is_cycling(sport: Column) -> Column:
    return F.coalesce(F.lower(sport).rlike("cycl|biking|ride"), F.lit(False))


def is_cardio(sport: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(sport), "[ -]", "_").rlike(CARDIO), F.lit(False))


def sport_matches(sport: Column, pattern: str) -> Column:
    return F.coalesce(sport.rlike("(?i)" + pattern), F.lit(False))


def moving_speed(sport: Column, profile: Profile = DEFAULT) -> Column:
    """Metres a second above which a record counts as moving."""
    parts = F.split(F.lower(text_or_empty(sport)), "/")
    return F.when(F.exists(parts, lambda p: p.rlike("cycling|biking")), profile.speed_cycling).otherwise(profile.speed_general)


def trimp_increment(hr: Column, seconds: Column, profile: Profile = DEFAULT) -> Column:
    """Training impulse of some seconds at a heart rate; 0 at rest and for null."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hr - profile.resting_hr) / (profile.max_hr - profile.resting_hr)))
    return F.when(hr > profile.resting_hr, seconds / 60 * r * profile.trimp_k1 * F.exp(profile.trimp_k2 * r)).otherwise(0.0)


def safe_div(a: Column, b: Column, default: float | None = None) -> Column:
    out = a / F.nullif(b, F.lit(0))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * 6371000.0 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def semicircles_to_degrees(x: Column) -> Column:
    return F.when(F.abs(x) > 180, x * 180.0 / 2147483648.0).otherwise(x.cast("double"))


def kmh(speed: Column) -> Column:
    """Kilometres an hour of metres a second; null counts as standing."""
    return F.coalesce(speed, F.lit(0.0)) * 3.6


def step_score(x: Column, steps: list[tuple[float, float]], last: float, strict: bool = False) -> Column:
    """The score of the first threshold that x does not exceed (is below, if strict); `last` beyond all; null for null."""
    case = F.when(x.isNull(), None)
    for limit, score in steps:
        case = case.when(x < limit if strict else x <= limit, float(score))
    return case.otherwise(float(last))


def eu_number(text: Column) -> Column:
    """Numbers as written in Europe: quotes and (thin, hard) blanks go, the comma is a point, a-b is the mean, '-' and junk null."""
    bare = F.regexp_replace(text, "[\"'    ]", "")
    bare = F.replace(bare, F.lit(","), F.lit("."))
    parts = F.split(bare, r"(?<=[0-9])[-–]")
    both = (F.try_element_at(parts, F.lit(1)).try_cast("double") + F.try_element_at(parts, F.lit(2)).try_cast("double")) / 2
    return F.when(F.size(parts) == 2, both).otherwise(bare.try_cast("double"))


def sleep_minutes(text: Column) -> Column:
    """'7h 20m' as 440; 0 and junk are null."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"([0-9]+)\s*{unit}", 1).try_cast("int"), F.lit(0))
    return F.nullif(part("h") * 60 + part("m"), F.lit(0))


def day_first_date(text: Column) -> Column:
    """Dates as 31.12.2024, with or without a time, or ISO; null for others."""
    first = F.regexp_extract(text, r"^\s*(\d{1,2})\.(\d{1,2})\.(\d{4})", 0)
    parts = F.split(F.trim(first), r"\.")
    iso = F.concat_ws("-", F.try_element_at(parts, F.lit(3)), F.lpad(F.try_element_at(parts, F.lit(2)), 2, "0"), F.lpad(F.try_element_at(parts, F.lit(1)), 2, "0"))
    return F.when(first != "", iso.try_cast("date")).otherwise(F.substring(F.trim(text), 1, 10).try_cast("date"))


def _accent_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is another letter and marks, and that letter: by rule, over all alphabets with them."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(plain) == 1 and plain != c:
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accent_table()


def strip_accents(text: Column) -> Column:
    """F-str1: the text decomposed (NFD) without its marks. Letters that no decomposition changes (ß, ł, ø) stay."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}+", "")


def sanitised(text: Column, default: str = "Unknown") -> Column:
    """F-str2: a place name without accents: blanks and hyphens become single underscores, other characters than letters, digits and
    underscores go; the default if nothing is left."""
    out = F.regexp_replace(strip_accents(F.trim(text_or_empty(text))), r"[\s\-]+", "_")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_]", ""), "_+", "_"), "^_|_$", "")
    return F.when(out == "", default).otherwise(out)


#: Words of a title that name the sport, and prepositions before a place: fixed values.
SPORT_WORDS = "cycling|cyklistika|cyklo|ride|gravel|mtb|mountain\\s*bike|bike|kolo|jizda|jízda|road|generic|virtual|indoor|outdoor|spinning"
PREPOSITIONS = "in|v|ve|na"
#: Parts of an address that are administrative: fixed values.
ADMINISTRATIVE = "okres|kraj|jihovychod|jihozapad|severovychod|severozapad|cesko|morava|ceskomoravska|region|district|municipality"


def place_in_title(title: Column) -> Column:
    """F-str3: what is left of an activity's title without sport words, prepositions and separators; null if nothing is."""
    out = F.regexp_replace(title, rf"(?iU)\b({SPORT_WORDS})\b", " ")
    out = F.regexp_replace(out, rf"(?iU)\b({PREPOSITIONS})\b", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[-–—|/\\]", " "), r"(?U)\s+", " ")
    return F.nullif(F.trim(out), F.lit(""))


def map_url(lat: Column, lon: Column) -> Column:
    return F.format_string("https://maps.example.org/?q=%.6f,%.6f", lat, lon)


def coordinates_of(url: Column) -> tuple[Column, Column]:
    return F.regexp_extract(url, r"[?&]q=(-?[0-9.]+),", 1).try_cast("double"), F.regexp_extract(url, r"[?&]q=-?[0-9.]+,(-?[0-9.]+)", 1).try_cast("double")


def activity_id_of(path: Column) -> Column:
    """The activity's number in a file name: after 'activity_', before '_ACTIVITY', or the leading digits; else the name's stem."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[A-Za-z0-9.]+$", "")
    tries = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (r"activity_(\d+)", r"(\d+)_ACTIVITY", r"^(\d+)")]
    return F.coalesce(*tries, name)


def first_address_part(address: Column) -> Column:
    """F-str4: the first comma-separated part that is more than digits and has no administrative word; null if there is none."""
    parts = F.transform(F.split(address, ","), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: ~p.rlike(r"^[0-9\s]+$") & ~p.rlike(rf"(?i)\b({ADMINISTRATIVE})\b"))
    return F.nullif(F.try_element_at(good, F.lit(1)), F.lit(""))


def place_name(title: Column, address: Column, default: str = "Unknown") -> Column:
    """F-str4: the place a title names, else that of the address, sanitised."""
    return sanitised(F.coalesce(place_in_title(title), first_address_part(address)), default)


def joined_text(*parts: Column, separator: str = " | ") -> Column:
    return F.concat_ws(separator, *parts)


def half_even(x: Column, digits: int) -> Column:
    """x rounded half to even, as numpy and DuckDB do: to a whole number of units of the last digit. bround() rounds the decimal text of
    x instead, and so differs where x lies next to a half."""
    return F.rint(x * 10**digits) / 10**digits


def signed(x: Column, digits: int = 1) -> Column:
    """F-str11: x with its sign, which what is rounded to zero keeps (-0.04: "-0.0")."""
    return F.format_string(f"%+.{digits}f", half_even(x, digits))


def synthetic_effect(device: Column, load: Column, scale: float) -> Column:
    """The device's training effect, or one from the load where it has none."""
    return F.coalesce(F.nullif(device, F.lit(0.0)), F.least(F.lit(5.0), 5 * (1 - F.exp(-load / scale))))


def export_name(date: Column, km: Column, minutes: Column, ascent: Column, activity_id: Column) -> Column:
    """F-str9: the name under which an activity is exported: date, kilometres, minutes, ascent and id."""
    distance = F.format_string("%.1f", F.coalesce(km, F.lit(0.0)))
    return F.format_string("%s_%skm_%dmin_%dm_%d", date.cast("string"), distance, minutes.cast("long"), F.coalesce(ascent, F.lit(0.0)).cast("long"), activity_id)
