"""Normalization: a text's numbers, dates, times, ranges, measures, money and foreign words in spoken Ukrainian.

Each rewriting sees what the one before it left, so this is one ordered pass over a string and not a set of columns. It runs
as an Arrow function over batches; equal texts of a batch are rewritten once, and normalize_many() rewrites each distinct text
of a whole table once. A step is a pattern, a gate (characters without which it can't match) and a reading. Markup, code and
impossible values are hidden before the first step and come back after the last one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kobza.functions import text as T
from kobza.operators import readings as R
from kobza.operators import technical as X
from kobza.operators.opaque import Opaque
from kobza.options import NormalizeOptions
from kobza.sources import lexicons as L

UK = "А-Яа-яҐґЄєІіЇї"
# Names of months, governing words, letters' names, signs.
ROMAN = "M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})"
NOT_ROMAN = {"CD", "DVD", "MD", "MC", "MM", "CV", "DC", "LCD", "CIV", "MIX", "DIV", "LIV", "DVI", "DL", "CLI"}
MONTHS = "січня лютого березня квітня травня червня липня серпня вересня жовтня листопада грудня".split()
GENITIVE = "до від без близько після протягом біля"
CASE_WORDS = dict.fromkeys(GENITIVE.split(), "gen")
ORDINAL_NOUNS = {"клас": "nom_m", "місце": "nom_n", "поверх": "nom_m", "курс": "nom_m", "розділ": "nom_m", "том": "nom_m", "параграф": "nom_m"}
SUFFIXES = {"й": "nom_m", "ий": "nom_m", "ій": "loc_f", "а": "nom_f", "я": "nom_f", "е": "nom_n", "є": "nom_n", "го": "gen", "ого": "gen", "му": "dat", "ому": "dat", "ї": "gen_f", "ої": "gen_f", "у": "acc_f", "им": "ins", "ім": "ins", "ою": "ins_f", "х": "pl", "их": "pl", "ми": "ins_pl", "ими": "ins_pl"}
MULTIPLIERS = {"тис": ("тисяча", "тисячі", "тисяч", "f"), "млн": ("мільйон", "мільйони", "мільйонів", "m"), "млрд": ("мільярд", "мільярди", "мільярдів", "m"), "трлн": ("трильйон", "трильйони", "трильйонів", "m")}
SIGNS = {"%": "відсоток", "&": "і", "+": "плюс", "=": "дорівнює", "×": "помножити на", "÷": "поділити на", "§": "параграф", "№": "номер", "°": "градус", "±": "плюс мінус", "≈": "приблизно дорівнює", "≠": "не дорівнює", "≤": "менше або дорівнює", "≥": "більше або дорівнює", "<": "менше", ">": "більше", "@": "равлик", "#": "решітка", "*": "зірочка", "_": "підкреслення", "/": "слеш", "|": "вертикальна риска", "~": "тильда", "^": "степінь"}
SECTIONS = {"ст": "стаття", "ч": "частина", "пп": "підпункт", "п": "пункт", "абз": "абзац", "розд": "розділ", "гл": "глава", "табл": "таблиця", "рис": "рисунок"}
CASES_AFTER = {"gen": "до від без близько після протягом біля понад більше менше", "instr": "з із між", "prep": "у в на о"}
SPELLED_AFTER = "ЄДРПОУ|РНОКПП|ІПН|індекс|паспорт [А-ЯҐЄІЇ]{2}|картк[аиу]|код"
COMPOUND = {1: "одно", 100: "сто", 1000: "тисячо"}
WEB = {"@": "равлик", ".": "крапка", "/": "слеш", ":": "двокрапка", "-": "дефіс", "_": "підкреслення", "?": "знак питання", "=": "дорівнює", "&": "амперсанд"}
LATIN_NAMES = X.LATIN_NAMES
SHORT_MONTHS = dict(zip("січ лют бер берез квіт трав черв лип серп вер верес жовт лист листоп груд".split(), (0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10, 10, 11), strict=True))
SECTION_RANGES = {"ст": "статті", "ч": "частини", "пп": "підпункти", "п": "пункти", "абз": "абзаци", "розд": "розділи", "гл": "глави", "табл": "таблиці", "рис": "рисунки"}
SEASONS = "весна|літо|осінь|зима|весни|літа|осені|зими|навесні|влітку|восени|взимку"
QUOTES = '«»“”„"'
NUMBER = r"\d{1,3}(?: \d{3})+|\d+"


# A unit is a group of its own: letters that only case folding makes equal match too. No unit begins within an earlier one of the order.
UNITS = sorted(T.UNITS, key=lambda u: (u[0] != "ts", -len(u[0])))
UNIT = re.compile("|".join(f"({latin})" for latin, _ in UNITS), re.I)
LETTERS = str.maketrans(T.SINGLES | {c.upper(): v for c, v in T.SINGLES.items()} | {c: to for to, both in T.DIACRITICS.items() for c in both + both.upper()} | {"ñ": "нь", "Ñ": "нь", "ß": "сс", "x": "кс", "X": "кс", "j": "дж", "J": "дж"})


def transliterated(text: str) -> str:
    return UNIT.sub(lambda m: UNITS[m.lastindex - 1][1], text).translate(LETTERS)


def counted(number: str, forms: tuple, gender: str) -> str:
    """A number as it is written, whole or decimal, with the noun's form. forms: one, few, many and, for decimals, the last."""
    whole, _, part = number.replace(" ", "").replace(",", ".").partition(".")
    if part:
        return f"{R.decimal(whole, part)} {forms[3] if len(forms) > 3 else forms[1]}"
    return f"{R.say(int(whole), gender)} {forms[R.form_index(int(whole))]}"


def alternatives(keys) -> str:
    return "|".join(re.escape(k) for k in sorted(keys, key=lambda k: (-len(k), k)))


def date_words(day: str, month: str, year: str | None, options: NormalizeOptions) -> str | None:
    d, m = int(day), int(month)
    y = int(year) + (0 if len(year) > 2 else 2000 if int(year) < 50 else 1900) if year else None
    leap = y is not None and y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    if not 1 <= m <= 12 or not 1 <= d <= [31, 29 if leap or y is None else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]:
        return None
    said = f"{R.ordinal(d, 'gen' if options.date_style == 'spoken' else 'nom_n')} {MONTHS[m - 1]}"
    return f"{said} {R.ordinal(y, 'gen')} року" if y is not None else said


@dataclass
class Step:
    """replace(match) may return None: then the match stays."""

    pattern: re.Pattern
    replace: Callable[[re.Match], str | None]
    gate: re.Pattern | None = None

    def run(self, text: str) -> str:
        if self.gate and not self.gate.search(text):
            return text
        return self.pattern.sub(lambda m: got if (got := self.replace(m)) is not None else m[0], text)


DIGIT, LATIN = re.compile("[0-9]"), re.compile("[A-Za-z]")
CYRILLIC = re.compile("[\u0400-\u052f\u1c80-\u1c8f\ua640-\ua69f]")  # with the letters that case folding makes equal to them


def gate_of(keys) -> re.Pattern | None:
    """A gate for words of which each has a Cyrillic letter; none if there are others."""
    return CYRILLIC if all(CYRILLIC.search(k) for k in keys) else None


def begins_sentence(text: str, at: int) -> bool:
    """Whether only blanks stand between this place and the text's beginning, if it is the first line, or the end of a sentence."""
    blank = at
    while blank and text[blank - 1].isspace():
        blank -= 1
    return text[:at] in ("", "\n") if not blank else blank < at and text[blank - 1] in ".!?"


def repaired(word: str) -> str:
    """In a word of both scripts the script with fewer letters gives way, if all its letters look like the other's."""
    latin, cyrillic = re.findall("[A-Za-z]", word), re.findall(f"[{UK}]", word)
    if not latin or not cyrillic:
        return word
    back = {v: k for k, v in T.LOOKALIKES.items()}
    if len(latin) <= len(cyrillic):
        return word.translate(str.maketrans(T.LOOKALIKES)) if all(c in T.LOOKALIKES for c in latin) else word
    return word.translate(str.maketrans(back)) if all(c in back for c in cyrillic) else word


def cleaner(options: NormalizeOptions) -> Callable[[str], str]:
    """One form of apostrophes, dashes, blanks and quotes."""
    mixed = re.compile(rf"[A-Za-z{UK}'-]*(?:[A-Za-z][{UK}]|[{UK}][A-Za-z])[A-Za-z{UK}'-]*")

    def run(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = re.sub(rf"(?<=[{UK}A-Za-z])[’ʼ`´‘](?=[{UK}A-Za-z])", "'", text)
            text = re.sub("(?<!10)−", "-", text)
            text = re.sub("[‐‑‒]", "–", text).replace("＋", "+")
        if options.quote_style == "guillemets":
            text = re.sub('["“„]([^"“”„]*)["”“]', r"«\1»", text)
        elif options.quote_style != "keep":
            text = re.sub(f"[{QUOTES}]", '"' if options.quote_style == "straight" else "", text)
        if options.normalize_typography:
            text = re.sub("[\u00a0\u2009\u202f\u2060]", " ", text)
            text = re.sub(r"(?<![*])[*]{2}(?![*])|(?<!_)__(?!_)|`", "", text).replace("’", "'")
            text = re.sub(r" +(?=[,.;:!?](?!\d))", "", text)
            text = re.sub(r"(?<=\d) ?[хx] ?(?=\d)", " × ", text)
        text = X.headings(text)
        return mixed.sub(lambda m: repaired(m[0]), text) if options.repair_homoglyphs else text

    return run


def build(options: NormalizeOptions, lexicons: L.Lexicons) -> Callable[[str], str]:
    steps: list[Step] = []

    def step(pattern: str, replace: Callable[[re.Match], str | None], gate: re.Pattern | None = DIGIT, flags: int = 0) -> None:
        steps.append(Step(re.compile(pattern, flags), replace, gate))

    order = options.numeric_date_order
    units, nouns = lexicons.units, lexicons.nouns
    words = lexicons.words | options.vocabulary
    day_first = lambda m: (m[1], m[2]) if order != "month_day_year" else (m[2], m[1])

    def numeric_date(m: re.Match) -> str | None:
        if order == "preserve_ambiguous" and int(m[1]) <= 12 and int(m[2]) <= 12:
            return None
        return date_words(*day_first(m), m[3], options)

    def web(m: re.Match) -> str:
        parts = re.findall(r"[A-Za-z]+|\d+|.", m[0])
        return " ".join(words.get(p.lower(), transliterated(p)) if p.isalpha() else R.say_digits(p) if p.isdigit() else WEB.get(p, p) for p in parts)

    def time_words(h: int, mi: int) -> str | None:
        if h > 23 or mi > 59:
            return "опівночі" if (h, mi) == (24, 0) else None
        said = f"{R.say(h, 'f')} {('година', 'години', 'годин')[R.form_index(h)]}"
        return said if not mi else f"{said} {R.say(mi, 'f')} {('хвилина', 'хвилини', 'хвилин')[R.form_index(mi)]}"

    def phone(m: re.Match) -> str:
        groups = [m[1], m[2], m[3], m[4]]
        if options.phone_style == "digit_by_digit":
            return "плюс " + R.digits("380" + "".join(groups))
        return " ".join(["плюс триста вісімдесят", *(f"нуль {R.say(int(g))}" if g[0] == "0" and int(g) else R.say(int(g)) for g in groups)])

    def foreign_phone(m: re.Match) -> str:
        if not 7 <= len(re.sub(r"\D", "", m[0])) <= 15:
            return m[0]
        if options.phone_style == "digit_by_digit":
            return "плюс " + R.digits(m[0])
        return "плюс " + " ".join(R.say(int(g)) if len(g) < 4 and g[0] != "0" else R.digits(g) for g in re.findall(r"\d+", m[0]))

    def span_of(a: str, b: str) -> str:
        if options.range_style == "from_to":
            return f"від {R.say_case(int(a), 'gen')} до {R.say_case(int(b), 'gen')}"
        return f"{R.say_digits(a)} {R.say_digits(b)}"

    if options.normalize_ip_addresses:
        X.network(step)
    step(r"(?<!\w)(?:стор|с)\. ?(\d+)(?: ?[-–—] ?(\d+))?(?!\w)", lambda m: f"сторінки {span_of(m[1], m[2])}" if m[2] else f"сторінка {R.say_digits(m[1])}")
    step(r"(?<!\w)(480|720|1080|1440|2160|4320)p(?!\w)", lambda m: f"{R.say(int(m[1]))} пі", DIGIT)
    step(r"\b[A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|https?://[^\s<>]*[^\s<>.,;:!?)]", web, re.compile("[@:]"))
    step(r"#(?=\w)", lambda m: "хештег ", re.compile("#"))
    step(r"(?<!\w)@(?=\w)", lambda m: "акаунт ", re.compile("@"))
    X.addresses(step)
    step(rf"(?<=\d )({alternatives(SHORT_MONTHS)})\.?(?= \d{{4}}|(?!\w))", lambda m: MONTHS[SHORT_MONTHS[m[1]]])
    X.coordinates(step)
    keys = alternatives(lexicons.abbreviations)
    step(rf"(?<![{UK}])(?i:{keys})(?![{UK}])", lambda m: (lambda e: e[:1].upper() + e[1:] if m[0][0].isupper() else e)(lexicons.abbreviations[m[0].lower()]), gate_of(lexicons.abbreviations))
    X.finance(step, lexicons)
    if options.currency_symbol_policy == "assume_common":
        X.money(step, lexicons, options, alternatives(MULTIPLIERS))
    step(r"(?<![\w.,])(\d{1,3}(?:[  ]\d{3})+|\d{1,3}(?:,\d{3}){2,}|\d{1,3}(?:\.\d{3}){2}(?!\.))(?![\d])", lambda m: re.sub(r"\D", "", m[1]) if m[1].count(" ") != 1 or len(m[1]) < 8 else re.sub(r"\D", "", m[1]))
    step(r"(?<![\w.,])[.](?=\d)", lambda m: "0.")
    step(r"(?<!\w)ЄДРПОУ:? ?№? ?(\d{8})(?!\d)", lambda m: "єдиний державний реєстр підприємств та організацій України " + R.digits(m[1]))
    X.identifiers(step)
    step(rf"(?<!\w)({SPELLED_AFTER}) ((?:\d[\d ]*|\*+ ?)+\d)(?!\w)", lambda m: m[1] + " " + " ".join(R.digits(p) if p.isdigit() else "зірочки" for p in m[2].split()))
    step(r"(?<![\w+])(?:\+?38)?0(?: ?\(?)(\d{2})\)?[ -]?(\d{3})[ -]?(\d{2})[ -]?(\d{2})(?!\d)", phone)
    step(r"(?<![\w+])(?:\+380|380) ?\(?(\d{2})\)?[ -]?(\d{3})[ -]?(\d{2})[ -]?(\d{2})(?!\d)", phone)
    step(r"(?<![\w+])(?:\+|00)[1-9]\d{0,2}(?:[ -]\(?\d{1,4}\)?){2,5}(?![\w-])", foreign_phone)
    X.durations(step)
    X.science(step, units)
    step(rf"№ ?(\d+(?:[/-](?:\d+|[IVXLCDM]+|[{UK}]{{1,2}})(?![\w]))*)", lambda m: "номер " + " ".join({"/": "слеш", "-": "дефіс"}.get(p) or (R.say_digits(p) if p.isdigit() else R.ordinal(R.roman(p)) if re.fullmatch("[IVXLCDM]+", p) else " ".join(T.LETTER_NAMES.get(c.upper(), c) for c in p)) for p in re.findall(rf"\d+|[A-Z]+|[{UK}]+|[/-]", m[1])))
    step(r"(?<!\w)(від|до|з|із|після|на) (\d{1,2})[./](\d{1,2})[./](\d{4})\b(?![.:]\d)", lambda m: (lambda d: d and f"{m[1]} {R.ordinal(int(m[2]), 'gen')} {MONTHS[int(m[3]) - 1]} {R.ordinal(int(m[4]), 'gen')} року")(date_words(m[2], m[3], m[4], options)))
    step(r"\b(\d{1,2})[./](\d{1,2})[./](\d{4}|\d{2})\b(?![.:]\d)(?: р\.| року)?", numeric_date)
    step(r"\b(\d{4})-(\d{2})-(\d{2})\b", lambda m: date_words(m[3], m[2], m[1], options))
    months = "|".join(MONTHS)
    step(rf"(?<!\w)([Вв]ід|[Дд]о|[Зз]|[Іі]з|[Пп]ісля) (\d{{1,2}}) ({months})(?: (\d{{4}})(?: року| р\.)?)?(?!\w)", lambda m: f"{m[1]} {R.ordinal(int(m[2]), 'gen')} {m[3]}" + (f" {R.ordinal(int(m[4]), 'gen')} року" if m[4] else ""))
    step(r"(?<!\w)([Зз]) (\d{4}) (?:р\. |року )?по (\d{4})(?: р\.| рік)?(?!\w)", lambda m: f"{m[1]} {R.ordinal(int(m[2]), 'gen')} по {R.ordinal(int(m[3]))} рік")
    step(rf"(?<!\w)({SEASONS}) (\d{{4}})(?: року| р\.)?(?!\w)", lambda m: f"{m[1]} {R.ordinal(int(m[2]), 'gen')} року", DIGIT, re.I)
    step(r"(?<!\w)(\d{4})-х(?!\w)", lambda m: "двотисячних" if m[1] == "2000" else R.ordinal(int(m[1]), "pl"))
    step(rf"\b(\d{{1,2}}) ?[-–—] ?(\d{{1,2}}) ({months})(?: (\d{{4}})(?: року| р\.)?)?", lambda m: f"{R.ordinal(int(m[1]), 'gen')} {R.ordinal(int(m[2]), 'gen')} {m[3]}" + (f" {R.ordinal(int(m[4]), 'gen')} року" if m[4] else ""))
    step(rf"\b(\d{{1,2}}) ({months})(?: (\d{{4}})(?: року| р\.)?)?", lambda m: date_words(m[1], str(MONTHS.index(m[2]) + 1), m[3], options))
    step(r"(?<![\w])([УуВв]) (\d{4})(?: році| р\.)", lambda m: f"{m[1]} {R.ordinal(int(m[2]), 'loc')} році")
    step(r"\b(\d{4}) (рік|року|році|роком)(?!\w)", lambda m: f"{R.ordinal(int(m[1]), {'рік': 'nom_m', 'року': 'gen', 'році': 'loc', 'роком': 'ins'}[m[2]])} {m[2]}")
    X.medicine(step)
    X.clocks(step, time_words)
    step(r"\b(\d{1,2}):(\d{2})(?![:\d])", lambda m: time_words(int(m[1]), int(m[2])) or (f"{R.say_digits(m[1])} до {R.say_digits(m[2])}" if options.colon_style == "ratio" else None))
    step(r"(?<![\w)\]])[-−](?=\d)", lambda m: "мінус ")
    step(rf"({NUMBER})([.,]\d+)? ?({alternatives(MULTIPLIERS)})\.? ?(?:(грн)|(?!\w))", lambda m: counted(m[1] + (m[2] or ""), (*MULTIPLIERS[m[3]][:3], MULTIPLIERS[m[3]][0] + "а" if MULTIPLIERS[m[3]][3] == "m" else MULTIPLIERS[m[3]][1]), MULTIPLIERS[m[3]][3]) + (" гривень" if m[4] else ""))
    step(rf"({NUMBER})([.,]\d+)? ?%", lambda m: counted(m[1] + (m[2] or ""), ("відсоток", "відсотки", "відсотків", "відсотка"), "m"))
    step(rf"(?<!\w)({GENITIVE.replace(' ', '|')}) ({NUMBER}) ?({alternatives(units)})(?!\w)", lambda m: (lambda n, u: f"{m[1]} {R.say_case(n, 'gen', u[4])} {u[2] if R.form_index(n) else u[3]}")(int(m[2].replace(" ", "")), units[m[3]]), DIGIT, re.I)
    step(rf"(?<![\w.,])(\d+) ?[-–—] ?(\d+) ?({alternatives(units)})(?![\w/])", lambda m: f"{span_of(m[1], m[2])} {units[m[3]][2]}")
    step(rf"({NUMBER})([.,]\d+)? ?({alternatives(units)})(?![\w/])(?:\.(?=\s+[а-яіїєґ\d]))?", lambda m: counted(m[1] + (m[2] or ""), units[m[3]][:4], units[m[3]][4]))
    if nouns:
        many = {f for f, n in nouns.items() if f == n[2]}
        step(rf"(?<!\w)({CASES_AFTER['gen'].replace(' ', '|')}) ({NUMBER}) ({alternatives(many)})(?!\w)", lambda m: f"{m[1]} {R.say_case(int(m[2].replace(' ', '')), 'gen', nouns[m[3]][3])} {m[3]}", DIGIT, re.I)
        step(rf"(?<![\w.,])({NUMBER}) ({alternatives(nouns)})(?!\w)", lambda m: counted(m[1], nouns[m[2]][:3], nouns[m[2]][3]) if m[2] not in ORDINAL_NOUNS else None)
    step(rf"(?<![\w.,])(\d+) ({alternatives(ORDINAL_NOUNS)})(?!\w)", lambda m: f"{R.ordinal(int(m[1]), ORDINAL_NOUNS[m[2]])} {m[2]}")
    step(r"(?<!\w)(I{1,3}|IV|[1-4](?:-й)?) ?кв\.(?: (\d{4})(?: р(?:оку|\.)?)?)?", lambda m: R.ordinal({"I": 1, "II": 2, "III": 3, "IV": 4}.get(m[1]) or int(m[1][0])) + " квартал" + (f" {R.ordinal(int(m[2]), 'gen')} року" if m[2] else ""), None)
    step(rf"(?<!\w)(\d+)-?({alternatives(SUFFIXES)})(?!\w)", lambda m: R.ordinal(int(m[1]), SUFFIXES[m[2]]))
    step(r"(?<!\w)([IVXLCDM]+) ?[-–—] ?([IVXLCDM]+) (?:століття|ст\.)", lambda m: f"{R.ordinal(R.roman(m[1]), 'nom_n')} {R.ordinal(R.roman(m[2]), 'nom_n')} століття", LATIN)
    step(r"(?<!\w)([IVXLCDM]+) (століття|ст\.)", lambda m: f"{R.ordinal(R.roman(m[1]), 'nom_n')} століття", LATIN)
    step(rf"(?<!\w)({alternatives(SECTIONS)})\. ?(\d+) ?[-–—] ?(\d+)(?!\w)", lambda m: f"{SECTION_RANGES[m[1]]} {span_of(m[2], m[3])}")
    step(rf"(?<!\w)({alternatives(SECTIONS)})\. ?(\d+|[IVXLCDM]+)(?!\w)", lambda m: f"{SECTIONS[m[1]]} {R.say(int(m[2])) if m[2].isdigit() else R.ordinal(R.roman(m[2]))}", None)
    step(rf"(?<!\w)(\d+)-([{UK}]{{4,}})(?!\w)", lambda m: (COMPOUND.get(int(m[1])) or R.say_case(int(m[1]), "gen").replace(" ", "")) + m[2] if len(m[1]) < 7 else None)
    step(r"(?<!\w)[IVXLCDM]{2,}(?!\w)", lambda m: R.ordinal(R.roman(m[0])) if re.fullmatch(ROMAN, m[0]) and m[0] not in NOT_ROMAN else None, LATIN)
    for case in ("instr", "prep"):
        forms = [w for w, c in lexicons.oblique.items() if c == case]
        if forms:
            step(rf"(?<!\w)({NUMBER})(?= (?:{alternatives(forms)})(?!\w))", lambda m, case=case: R.say_case(int(m[1].replace(" ", "")), case))
    for case, governors in CASES_AFTER.items():
        if case == "gen":
            step(rf"(?<!\w)({governors.replace(' ', '|')}) ({NUMBER})(?= [{UK}]+(?:ів|ей|ок|іб|их|ень|ин|ць)(?!\w))", lambda m: f"{m[1]} {R.say_case(int(m[2].replace(' ', '')), 'gen')}", DIGIT, re.I)
        elif case == "instr":
            step(rf"(?<!\w)({governors.replace(' ', '|')}) ({NUMBER})(?= [{UK}]+(?:ами|ями|ма)(?!\w))", lambda m: f"{m[1]} {R.say_case(int(m[2].replace(' ', '')), 'instr')}", DIGIT, re.I)
        else:
            step(rf"(?<!\w)({governors.replace(' ', '|')}) ({NUMBER})(?= [{UK}]+(?:ах|ях)(?!\w))", lambda m: f"{m[1]} {R.say_case(int(m[2].replace(' ', '')), 'prep')}", DIGIT, re.I)
    step(r"(?<![\d.,/-])(\d+) ?[-–—] ?(\d+)(?![\d.,]*\d|[-/])", lambda m: span_of(m[1], m[2]))
    step(r"(?<![\d/])(\d+)/(\d+)(?![\d/])", lambda m: f"{R.say(int(m[1]), 'f')} {R.ordinal(int(m[2]), 'nom_f' if R.form_index(int(m[1])) == 0 else 'pl')}" if int(m[2]) else None)
    if options.expand_known_acronyms:
        step(rf"(?<![{UK}])({alternatives(lexicons.acronyms)})(?![{UK}])", lambda m: (lambda e: e[:1].upper() + e[1:] if begins_sentence(m.string, m.start()) else e)(lexicons.acronyms[m[1]]), gate_of(lexicons.acronyms))
    if options.spell_unknown_acronyms:
        step(rf"[{T.UPPER}]{{2,}}", lambda m: None if re.search(f"[{T.VOWELS}]", m[0]) else " ".join(T.LETTER_NAMES[c] for c in m[0]), None)
    X.versions(step, words)
    step(r"(?<![\d.,])(\d+)[.,](\d+)(?![.,]?\d)", lambda m: R.decimal(m[1], m[2]))
    if options.symbol_style == "expand":
        step("[" + re.escape("".join(SIGNS)) + "]", lambda m: f" {SIGNS[m[0]]} ", None)
    step(r"\d+", lambda m: f" {R.say_digits(m[0])} " if re.match(rf"[A-Za-z{UK}]", m.string[m.end() : m.end() + 1]) or re.match(rf"[A-Za-z{UK}]", m.string[max(0, m.start() - 1) : m.start()]) else R.say_digits(m[0]))
    if options.normalize_english_words:
        step(r"[A-Za-z]+(?:['-][A-Za-z]+)*", lambda m: words.get(m[0].lower()) or (" ".join(LATIN_NAMES[c] for c in m[0].lower()) if m[0].isupper() and m[0].isalpha() else None), LATIN)
    if options.transliterate_latin:
        known: dict[str, str] = {}  # words come again and again

        def cyrillic(m: re.Match) -> str:
            word = m[0]
            if (said := known.get(word)) is None:
                said = transliterated(word)
                if len(known) < 10_000 and len(word) <= 40:
                    known[word] = said
            return said

        step(r"[A-Za-zÀ-ž]+", cyrillic, None)
    step(r" +", lambda m: " ", None)
    step(r" +(?=[,.;:!?])", lambda m: "", None)

    opaque, clean = Opaque(options), cleaner(options)

    def run(text: str) -> str:
        text, kept = opaque.hide(text)
        text = clean(text)
        for s in steps:
            text = s.run(text)
        return opaque.restore(text.strip(" "), kept)

    return run


def normalize_udf(options: NormalizeOptions | None = None, lexicons: L.Lexicons | None = None):
    """A function of one text column, which can also be registered for SQL. Null gives null, and the empty string itself."""
    chosen, tables = options or NormalizeOptions(), lexicons or L.Lexicons()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = build(chosen, tables)  # once a task
        for batch in batches:
            memo = {t: rewrite(t) for t in batch.dropna().unique()}
            yield batch.map(lambda t, memo=memo: memo.get(t))

    return run


def normalize(text: Column, options: NormalizeOptions | None = None, lexicons: L.Lexicons | None = None) -> Column:
    return normalize_udf(options, lexicons)(text)


def normalize_many(df: DataFrame, text: str, out: str, options: NormalizeOptions | None = None, lexicons: L.Lexicons | None = None) -> DataFrame:
    """The frame with a column of normalized texts; each distinct text is rewritten once. Rewriting takes long for its bytes, so
    the distinct texts are dealt out evenly to a fixed number of tasks, which adaptive plans don't make fewer."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    once = df.select(text).where(F.col(text).isNotNull()).distinct().repartition(tasks)
    return df.join(once.select(text, normalize(F.col(text), options, lexicons).alias(out)), text, "left")
