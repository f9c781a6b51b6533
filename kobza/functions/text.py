"""Text rewriting as Column expressions. Null gives null, and the empty string itself."""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from kobza.functions.expressions import match_map, table

# Alphabets, letter names, transliteration, and letters of one script that look like another's.
UPPER = "АБВГҐДЕЄЖЗИІЇЙКЛМНОПРСТУФХЦЧШЩЬЮЯ"
LOWER = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя"
RUSSIAN_UPPER, RUSSIAN_LOWER = "ЪЫЭ", "ъыэ"
LETTER_NAMES = {
    "А": "а", "Б": "бе", "В": "ве", "Г": "ге", "Ґ": "ґе", "Д": "де", "Е": "е", "Є": "є", "Ж": "же", "З": "зе", "И": "и",
    "І": "і", "Ї": "ї", "Й": "йот", "К": "ка", "Л": "ел", "М": "ем", "Н": "ен", "О": "о", "П": "пе", "Р": "ер", "С": "ес",
    "Т": "те", "У": "у", "Ф": "еф", "Х": "ха", "Ц": "це", "Ч": "че", "Ш": "ша", "Щ": "ща", "Ь": "м'який знак", "Ю": "ю", "Я": "я",
}
VOWELS = "АЕЄИІЇОУЮЯ"
UNITS = [("sch", "щ"), ("ts", "ц"), ("sh", "ш"), ("ch", "ч"), ("zh", "ж"), ("kh", "х"), ("yu", "ю"), ("ya", "я"), ("ye", "є"), ("yi", "ї"), ("oo", "у"), ("ee", "і")]
SINGLES = dict(zip("abcdefghiklmnopqrstuvwyz", "абкдефггіклмнопкрстуввиз", strict=True))
DIACRITICS = {"а": "áàâãåāăą", "е": "äéèêëēėę", "і": "íìîïī", "о": "óòôõöō", "у": "úùûū", "ю": "ü", "с": "ç", "л": "ł", "и": "ýÿ"}
LOOKALIKES = dict(zip("aeiopcxyABCEHIKMOPTX", "аеіорсхуАВСЕНІКМОРТХ", strict=True))
SPACES = "   ⁠"


def lower_text(text: Column) -> Column:
    """ASCII and Ukrainian capitals alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + UPPER + RUSSIAN_UPPER, "abcdefghijklmnopqrstuvwxyz" + LOWER + RUSSIAN_LOWER)


def compact_lower(text: Column) -> Column:
    return lower_text(F.regexp_replace(text, r"\s+", ""))


def trim_spaces(text: Column) -> Column:
    """Runs of U+0020 become one, and none stays at either end."""
    return F.trim(F.regexp_replace(text, " +", " "))


def spell_letters(token: Column) -> Column:
    names = table(LETTER_NAMES)
    return F.array_join(F.filter(F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: F.try_element_at(names, c)), lambda n: n.isNotNull()), " ")


def expand_abbreviations(text: Column) -> Column:
    """Runs of two or more Ukrainian capitals without a vowel are read by their letters' names."""
    upper = UPPER + RUSSIAN_UPPER
    return match_map(text, f"[{upper}]{{2,}}", lambda m, gap: F.when(m.rlike(f"[{VOWELS}]"), m).otherwise(spell_letters(m)))


def transliterate_to_cyrillic(text: Column) -> Column:
    """Latin to Cyrillic, the longest unit first; the case is dropped, other characters stay."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for latin, cyrillic in (*sorted(UNITS, key=lambda u: (u[0] != "ts", -len(u[0]))), ("x", "кс"), ("j", "дж"), ("ñ", "нь"), ("Ñ", "нь"), ("ß", "сс")):
        out = F.replace(out, F.lit(latin), F.lit(cyrillic))
    latin = "".join(SINGLES) + "".join(SINGLES).upper()
    cyrillic = "".join(SINGLES.values()) * 2
    for target, letters in DIACRITICS.items():
        both = letters + letters.upper()
        latin, cyrillic = latin + both, cyrillic + target * len(both)
    return F.translate(out, latin, cyrillic)


def cyrilize(text: Column) -> Column:
    warnings.warn("use transliterate_to_cyrillic", DeprecationWarning, stacklevel=2)
    return transliterate_to_cyrillic(text)


cyrrilize = cyrilize


def repair_homoglyphs(text: Column) -> Column:
    """In words of both scripts the script with fewer letters gives way, if all its letters look like the other's."""
    cyrillic = UPPER + LOWER + RUSSIAN_UPPER + RUSSIAN_LOWER
    latin_like, cyrillic_like = "".join(LOOKALIKES), "".join(LOOKALIKES.values())

    def fix(word: Column, gap: Column) -> Column:
        latin, uk = F.regexp_replace(word, "[^A-Za-z]", ""), F.regexp_replace(word, f"[^{cyrillic}]", "")
        to_uk = (F.length(latin) <= F.length(uk)) & (F.translate(latin, latin_like, "") == "")
        to_latin = (F.length(latin) > F.length(uk)) & (F.translate(uk, cyrillic_like, "") == "")
        mixed = (F.length(latin) > 0) & (F.length(uk) > 0)
        return F.when(mixed & to_uk, F.translate(word, latin_like, cyrillic_like)).when(mixed & to_latin, F.translate(word, cyrillic_like, latin_like)).otherwise(word)

    return match_map(text, f"[A-Za-z{cyrillic}'’-]+", fix)


def normalize_typography(text: Column) -> Column:
    """Special blanks become spaces, emphasis marks go, no blank stands before closing punctuation."""
    out = F.translate(text, SPACES, " " * len(SPACES))
    out = F.regexp_replace(F.regexp_replace(out, r"(?<![*])[*]{2}(?![*])|(?<!_)__(?!_)|`", ""), "’", "'")
    out = F.regexp_replace(out, r" +([,.;:!?])", "$1")
    return F.regexp_replace(out, r"(\d) *[хx] *(?=\d)", "$1 × ")


def quotes(text: Column, style: str) -> Column:
    """style: keep, guillemets, straight or strip."""
    if style == "keep":
        return text
    if style == "guillemets":
        return F.regexp_replace(text, '["“„]([^"“”„]*)["”“]', "«$1»")
    return F.regexp_replace(text, '[«»“”„"]', '"' if style == "straight" else "")
