"""Scalar expressions over names, titles, addresses and money; all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
TAMIL = r"[஀-௿]"
TRACKING = r"^(utm_|fbclid$|gclid$|igshid$|mc_cid$|mc_eid$|ref$)"
SECTIONS = (
    "(?i)/(cinema|movies?|entertainment|astrology|astro|horoscope|panchangam|sports?|cricket|ipl|lifestyle|fashion|recipes?|gallery|photos?|"
    "photo-gallery|viral|web-stories|ampstories|videos?|spiritualit?y|devotional|temple|rasi-palan)[-/.]"
)
BYPOLL = "(?i)by-?election|by-?poll|இடைத்தேர்தல்"
VACANCY = "(?i)vacan|resign|காலியிட|பதவி விலக"
ASSEMBLY = r"(?i)assembly|constituency|\bMLA\b|\bseat\b|சட்டமன்ற|தொகுதி|எம்\.?\s?எல்\.?\s?ஏ"
CIVIC_SUBJECTS = {
    "elections": "(?i)தேர்தல்|வாக்குப்பதிவு|வாக்காளர்|வேட்பாளர்|by-?election|election|polling|voter",
    "courts": "(?i)நீதிமன்ற|தீர்ப்பு|சிபிஐ|அமலாக்க|supreme court|high court|verdict|judgment|tribunal",
    "legislature": "(?i)சட்டமன்ற|சட்டப்பேரவை|மசோதா|அரசாணை|அமைச்சரவை|assembly|legislature|ordinance|cabinet|government order",
    "safety": "(?i)வெள்ளம்|புயல்|கனமழை|எச்சரிக்கை|வெப்பஅலை|வெடிவிபத்து|flood|cyclone|heavy rain|red alert|heatwave|outbreak",
    "household": "(?i)விலை உயர்வு|ரேஷன்|மின்கட்டண|சொத்துவரி|price hike|ration|tariff|fuel price|property tax",
}
DEPARTMENT_WORDS = r"\b(department|dept|of|and|the)\b|துறை|மற்றும்"
NAME_MARKS = ".-'(),"
LAKH, CRORE = 100_000, 10_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_tamil(text: Column | str) -> Column:
    return F.coalesce(_col(text).rlike(TAMIL), F.lit(False))


def script_language(text: Column | str) -> Column:
    return F.when(has_tamil(text), "ta").otherwise("en")


def collapsed(text: Column | str) -> Column:
    """One blank between words, none around them."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def norm_name(name: Column | str) -> Column:
    """Lower case, six marks for blanks, blanks collapsed. For text beyond ASCII decompose it before, by linkage.decomposed()."""
    return collapsed(F.translate(F.lower(_col(name)), NAME_MARKS, " " * len(NAME_MARKS)))


def token_sorted(name: Column | str) -> Column:
    return F.array_join(F.array_sort(F.split(norm_name(name), " ")), " ")


def title_case(name: Column | str) -> Column:
    """Each run of letters with a capital first, whatever stands before it (initcap minds blanks only)."""
    parts = F.regexp_extract_all(_col(name), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), "")


def without_suffix(name: Column | str, suffix: str) -> Column:
    return F.trim(F.regexp_replace(_col(name), f"(?i){suffix}\\s*$", ""))


def before_comma(name: Column | str) -> Column:
    """A name without the qualifier behind its first comma."""
    return F.trim(F.substring_index(_col(name), ",", 1))


def without_reservation(name: Column | str) -> Column:
    """A seat's name without the reservation that stands behind it in brackets."""
    return F.trim(F.regexp_replace(_col(name), r"\s*\((SC|ST)\)\s*$", ""))


def reservation(name: Column | str) -> Column:
    """SC or ST, if a seat's name ends with it in brackets; else null."""
    return F.nullif(F.regexp_extract(_col(name), r"\((SC|ST)\)\s*$", 1), F.lit(""))


def without_footnotes(cell: Column | str) -> Column:
    """A cell of a table without footnote marks of up to four characters in brackets."""
    return F.trim(F.regexp_replace(_col(cell), r"\[\s*[^\]]{1,4}\s*\]", ""))


def norm_party(party: Column | str) -> Column:
    """A party's short name without footnotes, dots, blanks and round brackets."""
    return F.regexp_replace(without_footnotes(party), r"[.\s()]+", "")


def slug(text: Column | str) -> Column:
    """Lower-case ASCII letters and digits, with one hyphen for all between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def comma_int(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "[, ]", "").try_cast("bigint")


def encoded_part(part: Column) -> Column:
    """A name or value of a query, decoded and encoded again, so that all its spellings become one; what can't be decoded is taken as it is."""
    plain = F.coalesce(F.try_url_decode(part), part)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column | str) -> Column:
    """Without blanks around it, fragment and tracking parameters (in any case); scheme and host in lower case; other
    parameters in their order, encoded alike, each with an equals sign."""
    plain = F.substring_index(F.trim(_col(url)), "#", 1)
    path, query = F.substring_index(plain, "?", 1), F.when(F.instr(plain, "?") > 0, F.regexp_replace(plain, r"^[^?]*\?", ""))
    name, value = lambda p: F.substring_index(p, "=", 1), lambda p: F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))
    parts = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(encoded_part(name(p)).alias("k"), encoded_part(value(p)).alias("v")))
    kept = F.filter(parts, lambda p: ~F.lower(F.coalesce(F.try_url_decode(p["k"]), p["k"])).rlike(TRACKING))
    head = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    low = F.concat(F.lower(head), F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""))
    again = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.when(query.isNotNull() & (F.size(kept) > 0), F.concat(low, F.lit("?"), again)).otherwise(low)


def in_scope(url: Column | str, prefixes: Column) -> Column:
    """Whether a url begins with one of the prefixes; without prefixes all urls do."""
    return F.coalesce(F.size(prefixes) == 0, F.lit(True)) | F.exists(prefixes, lambda p: F.startswith(_col(url), p))


def is_section(url: Column | str) -> Column:
    return F.coalesce(_col(url).rlike(SECTIONS), F.lit(False))


def is_signal(title: Column | str) -> Column:
    t = _col(title)
    return F.coalesce(t.rlike(BYPOLL) | (t.rlike(VACANCY) & t.rlike(ASSEMBLY)), F.lit(False))


def literals(pattern: str) -> list[str]:
    """The texts that a pattern of alternatives stands for, in lower case; an optional hyphen gives two."""
    parts = pattern.removeprefix("(?i)").split("|")
    return [p.replace("-?", h) for p in parts for h in (("-", "") if "-?" in p else ("",))]


def civic_subjects(title: Column | str) -> Column:
    """The subjects that a title is about."""
    return F.array_compact(F.array(*(F.when(_col(title).rlike(p), F.lit(k)) for k, p in CIVIC_SUBJECTS.items())))


#: Zones that mail dates name, in hours; other names and none mean UTC.
ZONES = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MAIL = r"^(?:[A-Za-z]+,?\s+)?(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*[ -](\d{2}|\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([A-Za-z]{1,5}|[+-]\d{4})\b.*)?$"


def parse_when(text: Column | str) -> Column:
    """A mail date (with or without weekday, seconds and zone; two-digit years up to 68 are of this century), or an ISO
    one; without a zone UTC; null for anything else."""
    once = lambda c, f: F.transform(F.array(c), f)[0]  # c is computed once, however often f names it
    zones, hours = F.array(*map(F.lit, ZONES)), F.array(*(F.lit(60 * v) for v in ZONES.values()))

    def at(parts: Column) -> Column:
        n = lambda i: parts[i].try_cast("int")
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(parts[1]))
        year = F.when(F.length(parts[2]) == 2, n(2) + F.when(n(2) > 68, 1900).otherwise(2000)).otherwise(n(2))
        signed = (F.substring(parts[6], 2, 2).try_cast("int") * 60 + F.substring(parts[6], 4, 2).try_cast("int")) * F.when(F.startswith(parts[6], F.lit("-")), -1).otherwise(1)
        named = F.coalesce(F.try_element_at(hours, F.nullif(F.array_position(zones, F.upper(parts[6])), F.lit(0)).cast("int")), F.lit(0))
        minutes = F.when(F.startswith(parts[6], F.lit("-")) | F.startswith(parts[6], F.lit("+")), signed).otherwise(named)
        return F.try_make_timestamp(year, month.cast("int"), n(0), n(3), n(4), F.coalesce(n(5), F.lit(0)), F.lit("UTC")) - F.make_dt_interval(mins=minutes)

    t = F.trim(_col(text))
    # one pass over the text for all of its parts, none of which can hold a comma
    parts = F.split(F.regexp_replace(t, _MAIL, "".join(f"${i}," for i in range(1, 8))), ",")
    mail = F.when(t.rlike(_MAIL), once(parts, at))
    whole = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit(" 00:00:00"))).otherwise(F.regexp_replace(t, "T", " "))
    zoned = once(whole, lambda w: F.when(w.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), w).otherwise(F.concat(w, F.lit("Z"))))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), F.try_to_timestamp(zoned))
    return F.coalesce(mail, iso)


def digest_key(url: Column | str) -> Column:
    return F.substring(F.sha2(_col(url), 256), 1, 12)


def parse_rupees(text: Column | str) -> Column:
    """The amount after "Rs" as a number; null without one."""
    digits = F.regexp_replace(F.regexp_extract(F.regexp_replace(_col(text), " ", " "), r"Rs\s*([\d,]+)", 1), ",", "")
    return F.when(digits != "", digits.cast("bigint"))


def approximate_tail(text: Column | str) -> Column:
    return F.trim(F.regexp_extract(_col(text), r"~\s*(.+)$", 1))


def inr_compact(amount: Column | str) -> Column:
    """Two decimals at most in lakh from 100,000 and in crore from 10,000,000; smaller amounts as they are."""
    a = _col(amount)
    hundredths = lambda n: F.round(a / n * 100) / 100  # by the binary value; round(x, 2) goes by its decimal digits
    unit = lambda n, name: F.concat(F.lit("₹"), F.regexp_replace(F.format_string("%.2f", hundredths(n)), r"\.?0+$", ""), F.lit(f" {name}"))
    return F.when(a >= CRORE, unit(CRORE, "crore")).when(a >= LAKH, unit(LAKH, "lakh")).otherwise(F.concat(F.lit("₹"), F.format_number(a, 0)))


def norm_department(name: Column | str, keep_marks: bool = False) -> Column:
    """Lower case, without department words, letters and digits only; keep_marks keeps vowel signs, too."""
    letters = r"[^\p{L}\p{M}\p{N} ]+" if keep_marks else r"[^\p{L}\p{N} ]+"
    return collapsed(F.regexp_replace(F.regexp_replace(F.lower(_col(name)), DEPARTMENT_WORDS, " "), letters, " "))


def word_start(text: Column | str, name: str) -> Column:
    """Whether a Tamil name begins a word there; what follows may be a case ending."""
    return F.coalesce(_col(text).rlike(rf"(?<![஀-௿])\Q{name}\E"), F.lit(False))


def accepted_title(title: Column | str, language: str) -> Column:
    """The title if its script fits the language, else null."""
    t = F.trim(_col(title))
    ok = has_tamil(t) if language == "ta" else (t != "") & ~has_tamil(t)
    return F.when(ok, t)


def saved_places(text: Column | str, most: int = 5) -> Column:
    """Valid "level:code" entries of a JSON array of strings, the first `most`."""
    entries = F.from_json(_col(text), "array<string>")
    return F.slice(F.filter(F.coalesce(entries, F.array().cast("array<string>")), lambda e: e.rlike("^(ac|pc|district):[0-9]+$")), 1, most)


#: Names that are offices, not departments.
OFFICE_WORDS = "(?i)^(governor|speaker|deputy speaker|chief minister|ஆளுநர்|சபாநாயகர்|முதலமைச்சர்|முதல்வர்)$"


def is_office(name: Column | str) -> Column:
    return F.coalesce(F.trim(_col(name)).rlike(OFFICE_WORDS), F.lit(False))


def tidied(text: Column | str) -> Column:
    """Without [n] markers, and with escaped quotation marks as plain ones."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(text), r'\\"', '"'), r"\s*\[\d+\]", ""))


def position_class(position: Column | str, is_chief: Column) -> Column:
    """cm, deputy or minister."""
    return F.when(F.coalesce(is_chief, F.lit(False)), "cm").when(_col(position).rlike(r"(?i)\bdeputy\b|துணை"), "deputy").otherwise("minister")


def department_entries(portfolios: Column | str) -> Column:
    """Names of portfolios in any of three shapes: a JSON string, an array of strings, an array of objects with name."""
    p = _col(portfolios)
    objects = F.transform(F.from_json(p, "array<struct<name:string>>"), lambda x: x["name"])
    strings = F.from_json(p, "array<string>")
    text = F.from_json(F.concat(F.lit('{"v":'), p, F.lit("}")), "v string")["v"]
    return F.when(p.rlike(r"^\s*\[\s*\{"), objects).when(p.rlike(r"^\s*\["), strings).when(text.isNotNull() & (text != ""), F.array(text)).otherwise(F.array().cast("array<string>"))


def ratio_or_none(value: Column | str) -> Column:
    """A published ratio; 0.0 means that there is none."""
    return F.nullif(_col(value), F.lit(0.0))


def count_or_zero(text: Column | str) -> Column:
    """A published count; a blank means 0."""
    return F.coalesce(F.nullif(F.trim(_col(text)), F.lit("")).try_cast("bigint"), F.lit(0))
