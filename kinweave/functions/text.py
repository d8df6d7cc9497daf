"""Normalisation of names and addresses as column expressions.

Word boundaries are written as look-arounds over letters, digits and the underscore, so
that results don't depend on what the running Java takes for a word character. The one
thing Spark has no built-in for, Unicode decomposition, is an Arrow UDF (``fold``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

W = r"[\p{L}\p{N}_]"
BOUND = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

# ---- fixed values: tables that results depend on, in their order of application ----

LEGAL_SUFFIXES = [
    (r"\bprivate\s+limited\b", "pvt ltd"),
    (r"\bpvt\s*\.?\s*ltd\s*\.?\b", "pvt ltd"),
    (r"\bincorporated\b", "inc"),
    (r"\binc\s*\.?\b", "inc"),
    (r"\bcorporation\b", "corp"),
    (r"\bcorp\s*\.?\b", "corp"),
    (r"\blimited\b", "ltd"),
    (r"\bltd\s*\.?\b", "ltd"),
    (r"\blimited\s+liability\s+company\b", "llc"),
    (r"\bllc\s*\.?\b", "llc"),
    (r"\bllp\s*\.?\b", "llp"),
    (r"\bcompany\b", "co"),
    (r"\bco\s*\.?\b", "co"),
    (r"\bsociety\s+anonyme\b", "sa"),
    (r"\bsarl\b", "sarl"),
    (r"\bsas\b", "sas"),
]
ADDRESS_SHORT = [
    (r"\bstreet\b", "st"),
    (r"\bavenue\b", "ave"),
    (r"\broad\b", "rd"),
    (r"\bdrive\b", "dr"),
    (r"\blane\b", "ln"),
    (r"\bboulevard\b", "blvd"),
    (r"\bhighway\b", "hwy"),
    (r"\bsuite\b", "ste"),
    (r"\bapartment\b", "apt"),
    (r"\bbuilding\b", "bldg"),
    (r"\bfloor\b", "fl"),
    (r"\bopposite\b", "opp"),
    (r"\bnear\b", "nr"),
]
FRANCE = [
    (r"\bbd\b", "boulevard"),
    (r"\bav\b", "avenue"),
    (r"\br\b", "rue"),
    (r"\bpl\b", "place"),
    (r"\ball\b", "allee"),
    (r"\brte\b", "route"),
    (r"\bn°\b", " "),
    (r"\bbis\b", "b"),
    (r"\bter\b", "t"),
]
_COMMON = [
    (r"\bst\b", "street"),
    (r"\brd\b", "road"),
    (r"\bave\b", "avenue"),
    (r"\bdr\b", "drive"),
    (r"\bln\b", "lane"),
    (r"\bhwy\b", "highway"),
    (r"\bste\b", "suite"),
    (r"\bapt\b", "apartment"),
]
US = [*_COMMON, (r"\bfl\b", "floor"), (r"\bbldg\b", "building")]
US_INDIA = [*_COMMON, (r"\bopp\b", "opposite"), (r"\bnr\b", "near")]
INDIA = [
    *US_INDIA,
    (r"\bfl\b", "floor"),
    (r"\bbldg\b", "building"),
    (r"\bsoc\b", "society"),
    (r"\bsec\b", "sector"),
    (r"\bmkt\b", "market"),
]
INDIA_STATE_NAMES = [
    (r"\bmh\b", "maharashtra"),
    (r"\btn\b", "tamil nadu"),
    (r"\bdl\b", "delhi"),
    (r"\bup\b", "uttar pradesh"),
    (r"\bka\b", "karnataka"),
    (r"\bwb\b", "west bengal"),
    (r"\bgj\b", "gujarat"),
    (r"\brj\b", "rajasthan"),
    (r"\bmp\b", "madhya pradesh"),
    (r"\bhr\b", "haryana"),
    (r"\bpb\b", "punjab"),
    (r"\bap\b", "andhra pradesh"),
    (r"\bts\b|\btg\b", "telangana"),
    (r"\bkl\b", "kerala"),
    (r"\bod\b", "odisha"),
]
TLD = r"\.(com|org|net|fr|in|co|io)\b"
SUFFIX_PATTERNS = [
    r"\bprivate\s+limited\b", r"\bpvt\s*\.?\s*ltd\s*\.?\b", r"\bincorporated\b", r"\binc\s*\.?\b",
    r"\bcorporation\b", r"\bcorp\s*\.?\b", r"\blimited\b", r"\bltd\s*\.?\b",
    r"\blimited\s+liability\s+company\b", r"\bllc\s*\.?\b", r"\bllp\s*\.?\b",
    r"\bco\s*\.?\b", r"\bcompany\b", r"\bsociety\s+anonyme\b", r"\bsa\b",
    r"\bsarl\b", r"\bsasu\b", r"\beurl\b", r"\bsci\b", r"\bsnc\b", r"\bgmbh\b",
    r"\bholding\b", r"\bholdings\b", r"\bgroup\b", r"\bservices\b", r"\benterprise\b",
    r"\benterprises\b", r"\bsolutions\b", r"\bassociates\b", r"\bconsultants\b",
    r"\binvestments\b", r"\bmanagement\b", r"\bindustries\b", r"\btechnologies\b",
    r"\bcentre\b", r"\bcenter\b", r"\bclub\b",
]
LEGAL_WORDS = "pvt ltd limited private llc inc corp corporation co company llp gmbh sa sas sarl eurl sci snc enterprises enterprise solutions services group holdings associates consulting industries".split()
TRADE_WORDS = (
    "pvt ltd limited private llc inc corp corporation co company llp gmbh sa sas sarl eurl sci snc france india usa us enterprises enterprise solutions services group "
    "holdings associates consulting industries pharmacy chemist medical druggist store mart bazar supermarket hypermarket grocery restaurant restro cafe hotel dhaba "
    "bhojanalaya caterers bakers bakery sweets jewellers jeweller textiles cloth saree creations boutique collection emporium stationery hardware electricals electronics "
    "mobile telecom motors automobiles hospital nursing clinic pathology diagnostic dental eye care school academy classes college institute education tutorials"
).split()
GENERIC_WORDS = (
    "hotel restaurant cafe hospital clinic medical pharmacy chemist store mart supermarket textiles hardware electronics telecom motors school academy college "
    "enterprises enterprise solutions services group industries industry builders developers trading logistics finance investments"
).split()
GENERIC_WORDS_WIDE = (
    "hotel hotels restaurant restro cafe dhaba caterers bakery bakers hospital clinic nursing dental eye care medical pharmacy chemist druggist store mart bazar "
    "supermarket hypermarket grocery kirana general textiles cloth saree garments creations boutique collection emporium hardware electricals electronics telecom mobile "
    "motors automobiles school academy classes college institute education tutorials enterprises enterprise solutions services group holdings associates consulting "
    "industries industry engineering construction builders developers properties realty trading traders agency logistics transport carriers finance investments "
    "securities capital advisors"
).split() + ["real estate"]
STOP_ADDRESS = (
    "street saint st road rd avenue ave drive dr lane ln boulevard bd rue near nr opp null floor fl bldg block no flat"
).split()
STOP_ADDRESS_LONG = [*STOP_ADDRESS, "none", "nan", "shop"]
NULL_ADDRESSES = ["", "none", "null", "nan", "<null>"]
SECTOR = r"\b(sector|sec|phase|ph|plot|plt|nh|ward)\s*[-#]?\s*\d+\b"
SECTOR_WIDE = r"\b(sector|sec|phase|ph|plot|plt|nh|gali|road|rd|floor|fl|ward)\s*[-#]?\s*\d+\b"
US_STATES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy"
).split()
INDIAN_STATES = [
    ("maharashtra", "MH"), ("mh", "MH"), ("tamil nadu", "TN"), ("tn", "TN"), ("uttar pradesh", "UP"), ("up", "UP"),
    ("delhi", "DL"), ("dl", "DL"), ("karnataka", "KA"), ("ka", "KA"), ("west bengal", "WB"), ("wb", "WB"),
    ("gujarat", "GJ"), ("gj", "GJ"), ("rajasthan", "RJ"), ("rj", "RJ"), ("madhya pradesh", "MP"), ("mp", "MP"),
    ("haryana", "HR"), ("hr", "HR"), ("punjab", "PB"), ("pb", "PB"), ("andhra pradesh", "AP"), ("ap", "AP"),
    ("telangana", "TS"), ("ts", "TS"), ("tg", "TS"), ("kerala", "KL"), ("kl", "KL"), ("odisha", "OD"), ("od", "OD"),
    ("orissa", "OD"), ("bihar", "BR"), ("br", "BR"), ("jharkhand", "JH"), ("jh", "JH"), ("assam", "AS"), ("as", "AS"),
    ("chhattisgarh", "CG"), ("cg", "CG"), ("uttarakhand", "UK"), ("uk", "UK"), ("goa", "GA"), ("ga", "GA"),
    ("himachal pradesh", "HP"), ("hp", "HP"), ("jammu and kashmir", "JK"), ("jk", "JK"), ("chandigarh", "CH"), ("ch", "CH"),
    ("puducherry", "PY"), ("py", "PY"), ("pondicherry", "PY"),
]

# ---- end of fixed values ----


_WORDS = r"\([a-z]+(?:\|[a-z]+)*\)"


def java(pattern: str) -> str:
    """A pattern in the tables' notation, for Java: Unicode boundaries and digits.

    A boundary next to a letter or digit of the pattern only depends on its other side. Letters stand before their
    boundary, so that it is looked at where they are found and not at every character; what matches is the same.
    """
    p = re.sub(rf"\\b(?={_WORDS}|\\d[+{{])", lambda m: f"(?<!{W})", pattern)
    p = re.sub(rf"({_WORDS}|(?<!\\)[a-z0-9]|\\d\+|\\d\{{[0-9,]+\}})\\b", lambda m: f"{m[1]}(?!{W})", p)
    p = re.sub(r"\\b([a-z]+)(?![a-z?*+{])", lambda m: f"{m[1]}(?<!{W}{m[1]})", p)
    return p.replace(r"\b", BOUND).replace(r"\d", r"\p{Nd}")


def sub(col: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(col, java(pattern), to)


def sub_all(col: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        col = sub(col, pattern, to)
    return col


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKD without combining marks, lower case, trimmed (N-1)."""

    def one(s: str | None) -> str:
        if not s:
            return ""
        if s.isascii():
            return s.lower().strip()
        return "".join([c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)]).lower().strip()

    return text.map(one)


@F.pandas_udf(StringType())
def fold_marks(text: pd.Series) -> pd.Series:
    """NFKD and lower case; combining marks stay (N-30)."""
    return text.map(lambda s: unicodedata.normalize("NFKD", s).lower() if s else "")


def spaces(col: Column) -> Column:
    """Everything but letters, digits and underscores to single blanks; trimmed."""
    return F.trim(F.regexp_replace(col, r"[^\p{L}\p{N}_]+", " "))


def clean(col: Column) -> Column:
    """Without the words null and none, and without punctuation (N-2)."""
    return spaces(sub(col, r"(?i)\b(null|none)\b", " "))


def business_name(folded: Column, glue: bool = True) -> Column:
    """N-3. ``glue=False`` keeps the blank that the suffix rules otherwise take with them."""
    rules = LEGAL_SUFFIXES if glue else [(p.replace(r"\s*\.?\b", r"(?:\.|\b)"), t) for p, t in LEGAL_SUFFIXES]
    return clean(sub_all(folded, rules))


def address(folded: Column) -> Column:
    """N-4."""
    return clean(sub_all(folded, ADDRESS_SHORT))


def tokens(col: Column) -> Column:
    """Blank-separated words; none for an empty string."""
    return F.filter(F.split(col, " "), lambda t: t != "")


def numbers(raw: Column) -> Column:
    """Whole digit words in order, duplicates kept (N-5)."""
    return F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(java(r"\b\d+\b")), F.lit(0))


def cleaner(folded: Column, country: Column, profile: str) -> Column:
    """The country-aware cleaners: ``base`` (N-7), ``states`` (N-8), ``plain`` (N-9), ``train`` (N-11)."""
    s = folded
    if profile != "train":
        s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
        if profile == "base":
            s = F.when(country == "France", sub_all(s, FRANCE)).otherwise(sub_all(s, US_INDIA))
        else:
            india = [*INDIA, *INDIA_STATE_NAMES] if profile == "states" else INDIA
            s = F.when(country == "France", sub_all(s, FRANCE)).when(country == "India", sub_all(s, india)).otherwise(sub_all(s, US))
    return spaces(sub(s, TLD, ""))


def columnar(raw: Column, country: Column, is_address: bool) -> Column:
    """The columnar cleaner (N-10): no decomposition; addresses are abbreviated after cleaning."""
    s = F.replace(F.lower(F.coalesce(raw, F.lit(""))), F.lit("&"), F.lit(" and "))
    s = F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}\p{M}_]+", " "))
    if is_address:
        s = F.when(country == "France", sub_all(s, FRANCE)).otherwise(sub_all(s, US_INDIA))
    return s


def core_brand(name: Column, words: Sequence[str] | None = None, fallback: bool = True) -> Column:
    """The name without legal and generic words (N-12, N-14, N-15), or without suffix patterns if ``words`` is None (N-13)."""
    if words is None:
        s = sub_all(name, [(p, " ") for p in SUFFIX_PATTERNS])
    else:
        s = sub(name, rf"\b({'|'.join(words)})\b", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(s == "", name).otherwise(s) if fallback else s


def no_space(col: Column) -> Column:
    return F.replace(col, F.lit(" "), F.lit(""))


def number_set(raw: Column, most_digits: int = 6, strip: str | None = SECTOR) -> Column:
    """N-17 with SECTOR and 6, N-19 with None and 8: digit runs without leading zeros, not too long, distinct."""
    s = F.coalesce(raw, F.lit(""))
    if strip:
        s = sub(s, "(?i)" + strip, " ")
    found = F.transform(F.regexp_extract_all(s, F.lit(r"\p{Nd}+"), F.lit(0)), lambda x: F.ltrim(x, F.lit("0")))
    return F.array_distinct(F.filter(found, lambda x: (x != "") & (F.length(x) <= most_digits)))


def raw_numbers(raw: Column) -> Column:
    """All digit runs, zeros kept, distinct (N-18)."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"\p{Nd}+"), F.lit(0)))


def small_integers(raw: Column) -> Column:
    """Digit words as numbers below 100 million, distinct, as strings (N-20)."""
    found = F.filter(F.transform(numbers(raw), lambda x: x.try_cast("bigint")), lambda x: x < 100_000_000)
    return F.array_distinct(F.transform(found, lambda x: x.cast("string")))


def plain_integers(raw: Column) -> Column:
    """Digit words without leading zeros, at least one digit each, in order (N-21)."""
    return F.transform(numbers(raw), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))


def postal_codes(raw: Column) -> Column:
    """Digit words of 5 or 6 digits, distinct (N-22, N-23)."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(java(r"\b\d{5,6}\b")), F.lit(0)))


def us_state(addr: Column, last: bool) -> Column:
    """The first or last word that is a state code, else empty (N-24, N-25)."""
    words = tokens(addr)
    found = F.filter(F.reverse(words) if last else words, lambda t: t.isin(US_STATES))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def indian_state(addr: Column) -> Column:
    """The code of the first name in the table's order that the address has as whole words, else empty."""
    out = F.lit("")
    for name, code in reversed(INDIAN_STATES):
        out = F.when(addr.rlike(java(rf"\b{name}\b")), code).otherwise(out)
    return out


def geo_code(addr: Column, raw: Column, country: Column, france: bool = True) -> Column:
    """N-24; without France it is N-26."""
    out = F.when(country == "US", F.upper(us_state(addr, last=True))).when(country == "India", indian_state(addr))
    if france:
        code = F.regexp_extract(F.coalesce(raw, F.lit("")), java(r"\b(\d{5})\b"), 1)
        out = out.when(country == "France", F.substring(code, 1, 2))
    return F.when(addr == "", "").otherwise(out.otherwise(""))


def address_tokens(addr: Column, least: int = 4, stop: Sequence[str] = STOP_ADDRESS_LONG) -> Column:
    """Words that are long enough, not numbers and not stop words (N-27)."""
    return F.filter(tokens(addr), lambda t: (F.length(t) >= least) & ~t.rlike(r"^\p{Nd}+$") & ~t.isin(list(stop)))


def is_indic(raw: Column) -> Column:
    """Whether any character is beyond ASCII (N-28)."""
    return F.coalesce(raw, F.lit("")).rlike(r"[^\x00-\x7F]")


def is_generic(brand: Column, words: Sequence[str] = GENERIC_WORDS) -> Column:
    """N-29."""
    return brand.isin(list(words)) | (F.length(brand) <= 2)


def address_key(folded_marks: Column) -> Column:
    """What addresses are compared by in the rescue step (N-30)."""
    return F.array_join(F.filter(tokens(spaces(folded_marks)), lambda t: ~t.isin("none", "null", "nan")), " ")


def stems(brand: Column) -> Column:
    """Distinct brand words of at least two characters, in order (N-31)."""
    return F.array_distinct(F.filter(tokens(brand), lambda t: F.length(t) >= 2))


def ngrams(col: Column, n: int = 3, pad: bool = True) -> Column:
    """Character n-grams in order (N-32 padded, as a multiset; N-33 unpadded and distinct)."""
    s = F.concat(F.lit(" "), col, F.lit(" ")) if pad else col
    found = F.when(F.length(s) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, n))
    )
    return F.when(col == "", F.array().cast("array<string>")).otherwise(found) if pad else F.array_distinct(found)


def empty_address(normal: Column, raw: Column, how: str) -> Column:
    """The definitions of an empty address: ``raw``, ``either``, ``words``, ``normal``."""
    blank = F.trim(F.coalesce(raw, F.lit(""))) == ""
    return {
        "raw": blank,
        "either": blank | (normal == ""),
        "words": normal.isin(NULL_ADDRESSES),
        "normal": normal == "",
    }[how]
