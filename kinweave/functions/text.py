"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal forms and the spelling that each is reduced to.
LEGAL_FORMS = {
    "inc": "inc",
    "incorporated": "inc",
    "corp": "corp",
    "corporation": "corp",
    "co": "company",
    "company": "company",
    "llc": "llc",
    "ltd": "limited",
    "limited": "limited",
    "pvt": "private",
    "private": "private",
    "llp": "llp",
    "plc": "plc",
    "pc": "pc",
    "sa": "sa",
    "sas": "sas",
    "sasu": "sas",
    "sarl": "sarl",
    "eurl": "eurl",
    "snc": "snc",
    "sci": "sci",
    "societe": "societe",
    "ste": "societe",
    "groupe": "group",
    "group": "group",
}

# Address abbreviations; words that stand for themselves need no entry.
ABBREVIATIONS = {
    "st": "street",
    "str": "street",
    "rd": "road",
    "ave": "avenue",
    "av": "avenue",
    "blvd": "boulevard",
    "bd": "boulevard",
    "ln": "lane",
    "dr": "drive",
    "ct": "court",
    "r": "rue",
    "chem": "chemin",
    "imp": "impasse",
    "rte": "route",
    "apt": "apartment",
    "fl": "floor",
    "dist": "district",
    "distt": "district",
}

# Words that carry nothing.
STOP_WORDS = tuple("the and of for in at near opp opposite behind next to null na n no le la les l de du des un une et a au aux en sur dans pour par avec chez".split())

# Words that only say where something lies.
LANDMARKS = tuple("near opp opposite behind beside next front".split())

# Latin letters that don't decompose.
LETTERS = {"ß": "ss", "ẞ": "SS", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ı": "i"}

# Greek and Cyrillic letters in lower case; capitals follow.
SCRIPTS = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o",
    "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "",
    "э": "e", "ю": "yu", "я": "ya", "є": "ye", "і": "i", "ґ": "g",
}

# The letters of the Indic blocks by their place in a block; the blocks share one order.
INDIC_PLACES = {
    0x02: "m", 0x03: "h", 0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "r", 0x0F: "e", 0x10: "ai", 0x13: "o", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "c", 0x1B: "ch", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t", 0x20: "th", 0x21: "d",
    0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y",
    0x30: "r", 0x32: "l", 0x33: "l", 0x35: "v", 0x36: "s", 0x37: "s", 0x38: "s", 0x39: "h", 0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "r",
    0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au", 0x4D: "",
}
INDIC_BLOCKS = range(0x0900, 0x0D80, 0x80)


def _stripped(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@cache
def _folds(romanise: bool) -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """(characters, what each single one becomes, those that become several, those that vanish), from the rules above."""
    plain: dict[str, str] = {}
    for point in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        ch = chr(point)
        if (to := _stripped(ch)) != ch and not 0xAC00 <= point < 0xD7A4:
            plain[ch] = to
    if romanise:
        scripts = SCRIPTS | {c.upper(): t.capitalize() for c, t in SCRIPTS.items() if c != "ς"}
        plain = {c: "".join(scripts.get(x, x) for x in t) for c, t in plain.items()} | scripts | LETTERS
        for block in INDIC_BLOCKS:
            plain |= {chr(block + place): to for place, to in INDIC_PLACES.items()}
            plain |= {chr(block + 0x66 + digit): str(digit) for digit in range(10)}
    singles = {c: t for c, t in plain.items() if len(t) == 1}
    several = tuple(sorted((c, t) for c, t in plain.items() if len(t) > 1 and (c in LETTERS or romanise and (0x0370 <= ord(c) < 0x0500 or 0x0900 <= ord(c) < 0x0D80) or 0xFB00 <= ord(c) <= 0xFB06)))
    gone = "".join(sorted(c for c, t in plain.items() if not t))
    return "".join(singles), "".join(singles.values()), several, gone


def _fold(text: Column, romanise: bool) -> Column:
    """Single characters by one translate(); the few that become several first, by way of one stand-in for each result."""
    source, target, several, gone = _folds(romanise)
    results = sorted({t for _, t in several})
    stand = {t: chr(0xE000 + i) for i, t in enumerate(results)}
    out = F.translate(text, source + "".join(c for c, _ in several) + gone, target + "".join(stand[t] for _, t in several))

    def spelt(got: Column) -> Column:
        full = got
        for t in results:
            full = F.replace(full, F.lit(stand[t]), F.lit(t))
        # few texts have a stand-in, and each replacement reads the whole text
        return F.when(got.rlike(f"[{stand[results[0]]}-{stand[results[-1]]}]"), full).otherwise(got)

    return F.when(text.rlike(r"[^\x00-\x7F]"), F.get(F.transform(F.array(out), spelt), F.lit(0)) if results else out).otherwise(text)


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks, for characters that decompose to one."""
    return _fold(text, False)


def transliterate(text: Column) -> Column:
    """strip_accents, the Latin letters that don't decompose, and Greek, Cyrillic and the nine Indic scripts in Latin letters."""
    return _fold(text, True)


@F.pandas_udf(T.StringType())
def strip_accents_exact(text: pd.Series) -> pd.Series:
    """Full NFKD without combining marks, for every script."""
    return text.map(lambda x: None if x is None else _stripped(x))


def split_words(text: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def tokenize(text: Column) -> Column:
    folded = F.replace(F.lower(transliterate(F.coalesce(text, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.regexp_extract_all(folded, F.lit(r"(?U)(\w+)"), F.lit(1))


def _mapping(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _sorted_set(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), "|")


def name_core(tokens: Column) -> Column:
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(*LEGAL_FORMS) & ~t.isin(*STOP_WORDS)), " ")


def legal_forms(tokens: Column) -> Column:
    forms = _mapping(LEGAL_FORMS)
    return _sorted_set(F.transform(F.filter(tokens, lambda t: t.isin(*LEGAL_FORMS)), lambda t: forms[t]))


def address_core(tokens: Column) -> Column:
    full = _mapping(ABBREVIATIONS)
    kept = F.filter(tokens, lambda t: ~t.isin(*LANDMARKS) & ~t.isin(*STOP_WORDS))
    return F.array_join(F.transform(kept, lambda t: F.coalesce(F.try_element_at(full, t), t)), " ")


def landmarks(tokens: Column) -> Column:
    return _sorted_set(F.filter(tokens, lambda t: t.isin(*LANDMARKS)))


def numbers(text: Column) -> Column:
    """Runs of digits of any script in the raw text, in order, with repeats."""
    return F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\d+)"), F.lit(1)), "|")


def country_norm(country: Column) -> Column:
    return F.trim(F.lower(strip_accents(F.coalesce(country, F.lit("")))))


def normalize(records):
    """Adds name_norm, legal_form, address_norm, address_numbers, landmark_tokens, combined_norm and country_norm."""
    rows = records.withColumns({"_n": tokenize(F.col("business_name")), "_a": tokenize(F.col("business_address"))})
    rows = rows.withColumns(
        {
            "name_norm": name_core(F.col("_n")),
            "legal_form": legal_forms(F.col("_n")),
            "address_norm": address_core(F.col("_a")),
            "address_numbers": numbers(F.col("business_address")),
            "landmark_tokens": landmarks(F.col("_a")),
            "country_norm": country_norm(F.col("country")),
        }
    )
    return rows.withColumn("combined_norm", combined()).drop("_n", "_a")


def combined() -> Column:
    """combined_norm of normalised records, from the columns that it repeats."""
    return F.trim(F.concat(F.col("name_norm"), F.lit(" "), F.col("address_norm"), F.lit(" "), F.coalesce("country", F.lit(""))))


def token_set(text: Column) -> Column:
    return F.array_distinct(split_words(F.coalesce(text, F.lit(""))))


def pipe_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda t: t != ""))


def soundex(token: Column) -> Column:
    """Letter and three digits in lower case; any uncoded letter, h, w and y too, ends a run of one code. '' without letters."""
    letters = F.regexp_replace(F.lower(token), "[^a-z]", "")
    codes = F.translate(letters, "bfpvcgjkqsxzdtlmnraeiouyhw", "11112222222233455600000000")
    runs = F.regexp_replace(codes, r"(.)\1+", "$1")
    digits = F.regexp_replace(F.substring(runs, 2, 1 << 30), "0", "")
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), F.substring(digits, 1, 3)), 4, "0"))


def alnum(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def long_tokens(text: Column, least: int) -> Column:
    """Words of at least so many characters, in order, with repeats."""
    return F.filter(split_words(text), lambda t: F.length(t) >= least)


def has_non_latin(text: Column) -> Column:
    return strip_accents(F.coalesce(text, F.lit(""))).rlike(r"[^\x00-\x7F]")


def clean_name_tokens(name_norm: Column) -> Column:
    return F.filter(token_set(name_norm), lambda t: (F.length(t) >= 3) & ~t.rlike(r"^[0-9]+$"))


def clean_address_tokens(address_norm: Column) -> Column:
    return F.filter(token_set(address_norm), lambda t: F.length(t) >= 3)


def useful_numbers(address_numbers: Column) -> Column:
    return F.filter(pipe_set(address_numbers), lambda t: F.length(t) >= 3)


def _gram(text: Column, n: int):
    return lambda i: F.substr(text, i, F.lit(n))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams; a shorter text is its own, an empty one has none."""
    text = F.coalesce(text, F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def char3gram_codes(text: Column) -> Column:
    """char_ngrams(text, 3) as numbers: three code points of 21 bits each."""
    text = F.coalesce(text, F.lit(""))

    def at(codes: Column, i: Column, shift: int) -> Column:
        return F.call_function("shiftleft", F.coalesce(F.get(codes, i), F.lit(0).cast("long")), F.lit(shift))

    def of(codes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 3)), lambda i: at(codes, i, 42).bitwiseOR(at(codes, i + 1, 21)).bitwiseOR(at(codes, i + 2, 0)))

    # the code points are an argument, or every gram would make them anew
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    grams = F.get(F.transform(F.array(points), of), F.lit(0))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array_distinct(grams))


def word_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """N-grams of every word padded by one space on each side, with repeats; a shorter padded word counts once."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        parts = []
        for n in range(low, high + 1):
            grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (n - 1))), _gram(padded, n))
            # a word that is too short even for the shortest length is given once, by that length
            parts.append(F.when((F.length(padded) >= n) | F.lit(n == low), grams).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(split_words(F.coalesce(text, F.lit(""))), of))
