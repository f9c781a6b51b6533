"""Tables of units, nouns, currencies and expansions: built-in ones by rule, further ones from files.

A file is tab-separated with a header; lines from # on are comments; the first column is unique and, but for patterns and
symbols, no cell is empty. The order of rows is kept, as earlier abbreviations and currencies win.
"""

from __future__ import annotations

import csv
import unicodedata
from dataclasses import dataclass, field

from kobza.sources.latin_words import BRANDS, ENGLISH

SCHEMAS = {
    "units": ["key", "one", "few", "many", "decimal", "gender"],
    "counted_nouns": ["key", "one", "few", "many", "gender"],
    "counted_oblique": ["key", "grammatical_case"],
    "acronyms": ["acronym", "expansion"],
    "abbreviations": ["key", "expansion"],
    "brands": ["latin", "cyrillic"],
    "english_words": ["latin", "cyrillic"],
    "finance_units": ["code", "one", "few", "many", "decimal", "feminine"],
    "currencies": ["code", "symbol", "word_re", "main_one", "main_few", "main_many", "main_fem", "sub_one", "sub_few", "sub_many", "sub_fem", "trailing_symbol", "minor_digits"],
}
MAY_BE_EMPTY = {"symbol", "word_re"}

# Expansions, in order.
ABBREVIATIONS = {
    "див. також": "дивись також", "до н. е.": "до нашої ери", "і т. д.": "і так далі", "і т. ін.": "і таке інше",
    "пн. ш.": "північної широти", "пд. ш.": "південної широти", "сх. д.": "східної довготи", "зх. д.": "західної довготи",
    "грн.": "гривень", "коп.": "копійок", "н. е.": "нашої ери", "т. б.": "тобто", "рр.": "роки", "р-н": "район",
    "б/в": "був у використанні", "та ін.": "та інші", "див.": "дивись", "напр.": "наприклад", "прибл.": "приблизно",
    "проф.": "професор", "доц.": "доцент", "ім.": "імені", "вул.": "вулиця", "просп.": "проспект", "пров.": "провулок",
    "буд.": "будинок", "тел.": "телефон", "табл.": "таблиця", "і т. п.": "і тому подібне", "у т. ч.": "у тому числі",
    "зокр.": "зокрема", "д-р": "доктор", "інж.": "інженер", "канд.": "кандидат",
}
ACRONYMS = {
    "ПДВ": "податок на додану вартість", "ЄДРПОУ": "єдиний державний реєстр підприємств та організацій України",
    "ФОП": "фізична особа підприємець", "ТОВ": "товариство з обмеженою відповідальністю", "АТ": "акціонерне товариство",
    "ОСББ": "об'єднання співвласників багатоквартирного будинку", "ЗСУ": "збройні сили України", "СБУ": "служба безпеки України",
    "МВС": "міністерство внутрішніх справ", "ДСНС": "державна служба України з надзвичайних ситуацій",
    "НПУ": "національна поліція України", "ДБР": "державне бюро розслідувань", "НАБУ": "національне антикорупційне бюро України",
    "САП": "спеціалізована антикорупційна прокуратура", "НАЗК": "національне агентство з питань запобігання корупції",
    "НБУ": "національний банк України", "КМУ": "кабінет міністрів України", "ВРУ": "верховна рада України",
    "ЦВК": "центральна виборча комісія", "МОН": "міністерство освіти і науки України",
    "МОЗ": "міністерство охорони здоров'я України", "ДПС": "державна податкова служба України", "ЄС": "європейський союз",
    "УЗ": "українська залізниця", "ОВА": "обласна військова адміністрація", "РДА": "районна державна адміністрація",
    "ШІ": "штучний інтелект", "ІТ": "інформаційні технології", "ПЗ": "програмне забезпечення",
    "ООН": "організація об'єднаних націй", "НАТО": "організація північноатлантичного договору",
    "ВООЗ": "всесвітня організація охорони здоров'я", "МВФ": "міжнародний валютний фонд", "ДНК": "дезоксирибонуклеїнова кислота",
    "РНК": "рибонуклеїнова кислота", "ВПО": "внутрішньо переміщена особа", "ЦНАП": "центр надання адміністративних послуг",
    "ЗВО": "заклад вищої освіти", "НСЗУ": "національна служба здоров'я України", "ПФУ": "пенсійний фонд України",
    "ЄСПЛ": "європейський суд з прав людини", "ЮНЕСКО": "організація об'єднаних націй з питань освіти, науки і культури",
    "НАНУ": "національна академія наук України", "МАГАТЕ": "міжнародне агентство з атомної енергії",
}
# Forms of measures and money (one, few, many, decimal, gender).
BASES = {
    "м": ("метр", "метри", "метрів", "метра", "m"), "г": ("грам", "грами", "грамів", "грама", "m"), "л": ("літр", "літри", "літрів", "літра", "m"),
    "Гц": ("герц", "герци", "герц", "герца", "m"), "с": ("секунда", "секунди", "секунд", "секунди", "f"),
}
PREFIXES = {"к": "кіло", "м": "мілі", "с": "санти", "д": "деци", "мк": "мікро", "н": "нано", "М": "мега", "Г": "гіга"}
PREFIXED = {"м": ["к", "м", "с", "д", "мк", "н"], "г": ["к", "м"], "л": ["м"], "Гц": ["к", "М", "Г"], "с": ["м"]}
OTHER_UNITS = {
    "K": ("кельвін", "кельвіни", "кельвінів", "кельвіна", "m"), "\u212a": ("кельвін", "кельвіни", "кельвінів", "кельвіна", "m"),
    "м/с": ("метр за секунду", "метри за секунду", "метрів за секунду", "метра за секунду", "m"),
    "м/с²": ("метр за секунду в квадраті", "метри за секунду в квадраті", "метрів за секунду в квадраті", "метра за секунду в квадраті", "m"),
    "т": ("тонна", "тонни", "тонн", "тонни", "f"), "год": ("година", "години", "годин", "години", "f"), "хв": ("хвилина", "хвилини", "хвилин", "хвилини", "f"),
    "га": ("гектар", "гектари", "гектарів", "гектара", "m"), "км/год": ("кілометр на годину", "кілометри на годину", "кілометрів на годину", "кілометра на годину", "m"),
    "°C": ("градус Цельсія", "градуси Цельсія", "градусів Цельсія", "градуса Цельсія", "m"), "мг/мл": ("міліграм на мілілітр", "міліграми на мілілітр", "міліграмів на мілілітр", "міліграма на мілілітр", "m"),
}
# By code the symbol, word pattern, forms and gender of the unit and of its part, decimal places of the part. Earlier ones win.
CURRENCIES = {
    "UAH": ("₴", "грн|грив(?:ень|ні|ня)", ("гривня", "гривні", "гривень"), "f", ("копійка", "копійки", "копійок"), "f", 2),
    "USD": ("$", "долар(?:ів|и|а)?", ("долар", "долари", "доларів"), "m", ("цент", "центи", "центів"), "m", 2),
    "EUR": ("€", "євро", ("євро", "євро", "євро"), "m", ("євроцент", "євроценти", "євроцентів"), "m", 2),
    "GBP": ("£", "фунт(?:ів|и|а)?", ("фунт", "фунти", "фунтів"), "m", ("пенс", "пенси", "пенсів"), "m", 2),
    "PLN": ("zł", "злот(?:их|і|ий)", ("злотий", "злоті", "злотих"), "m", ("ґрош", "ґроші", "ґрошів"), "m", 2),
    "CHF": ("", "франк(?:ів|и|а)?", ("франк", "франки", "франків"), "m", ("сантим", "сантими", "сантимів"), "m", 2),
    "JPY": ("¥", "єн(?:а|и)?", ("єна", "єни", "єн"), "f", ("сена", "сени", "сен"), "f", 0),
    "CNY": ("", "юан(?:ів|і|ь|я)", ("юань", "юані", "юанів"), "m", ("фень", "фені", "фенів"), "m", 2),
    "CZK": ("", "", ("чеська крона", "чеські крони", "чеських крон"), "f", ("гелер", "гелери", "гелерів"), "m", 2),
    "TRY": ("₺", "лір(?:а|и)?", ("ліра", "ліри", "лір"), "f", ("куруш", "куруші", "курушів"), "m", 2),
    "INR": ("₹", "рупі(?:я|ї|й)", ("рупія", "рупії", "рупій"), "f", ("пайса", "пайси", "пайс"), "f", 2),
    "AED": ("", "", ("дирхам ОАЕ", "дирхами ОАЕ", "дирхамів ОАЕ"), "m", ("філс", "філси", "філсів"), "m", 2),
    "AZN": ("₼", "", ("азербайджанський манат", "азербайджанські манати", "азербайджанських манатів"), "m", ("гяпік", "гяпіки", "гяпіків"), "m", 2),
    "BSD": ("", "", ("багамський долар", "багамські долари", "багамських доларів"), "m", ("цент", "центи", "центів"), "m", 2),
    "BHD": ("", "", ("бахрейнський динар", "бахрейнські динари", "бахрейнських динарів"), "m", ("філс", "філси", "філсів"), "m", 3),
    "BYN": ("", "", ("білоруський рубль", "білоруські рублі", "білоруських рублів"), "m", ("копійка", "копійки", "копійок"), "f", 2),
}
# By code the forms (one, few, many, decimal) and the gender of what is traded.
FINANCE = {
    "BTC": ("біткоїн", "біткоїни", "біткоїнів", "біткоїна", "m"), "ETH": ("ефір", "ефіри", "ефірів", "ефіра", "m"),
    "USDT": ("тезер", "тезери", "тезерів", "тезера", "m"), "BNB": ("бі ен бі", "бі ен бі", "бі ен бі", "бі ен бі", "m"),
}
# Time zones with a reading; codes for symbols with a country before them.
ZONES = {
    "europe/kyiv": "за київським часом", "europe/london": "за лондонським часом", "europe/warsaw": "за варшавським часом",
    "america/new_york": "за нью-йоркським часом", "america/los_angeles": "за лос-анджелеським часом", "asia/tokyo": "за токійським часом",
}
# Lengths of account numbers by country, weights of the places of vehicle numbers.
IBAN_LENGTHS = {
    "AL": 28, "AD": 24, "AT": 20, "AZ": 28, "BH": 22, "BE": 16, "BA": 20, "BR": 29, "BG": 22, "CR": 22, "HR": 21, "CY": 28,
    "CZ": 24, "DK": 18, "DO": 28, "EE": 20, "FO": 18, "FI": 18, "FR": 27, "GE": 22, "DE": 22, "GI": 23, "GR": 27, "GL": 18,
    "GT": 28, "HU": 28, "IS": 26, "IE": 22, "IL": 23, "IT": 27, "JO": 30, "KZ": 20, "XK": 20, "KW": 30, "LV": 21, "LB": 28,
    "LI": 21, "LT": 20, "LU": 20, "MT": 31, "MR": 27, "MU": 30, "MC": 27, "MD": 24, "ME": 22, "NL": 18, "MK": 19, "NO": 15,
    "PK": 24, "PS": 29, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "LC": 32, "SM": 27, "ST": 25, "SA": 24, "RS": 22, "SC": 31,
    "SK": 24, "SI": 19, "ES": 24, "SE": 24, "CH": 21, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "AE": 23, "GB": 22, "VA": 22,
    "VG": 24,
}
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
REGIONAL = {"US$": "USD", "CA$": "CAD", "AU$": "AUD", "NZ$": "NZD", "HK$": "HKD", "SG$": "SGD", "JP¥": "JPY", "CN¥": "CNY", "R$": "BRL"}
#: Masculine nouns with a regular declension, and the endings of few and many; feminine and neuter ones by their ending.
NOUNS = "документ користувач файл товар студент учень день місяць рік тиждень раз друг пункт".split()
IRREGULAR = {"учень": ("учні", "учнів"), "день": ("дні", "днів"), "місяць": ("місяці", "місяців"), "рік": ("роки", "років"), "тиждень": ("тижні", "тижнів"), "раз": ("рази", "разів"), "друг": ("друзі", "друзів"), "користувач": ("користувачі", "користувачів")}
FEMININE, NEUTER = "заявка книга сторінка людина дитина хвилина година".split(), "місто місце".split()
FEMININE_MANY = {"заявка": "заявок", "сторінка": "сторінок", "людина": "людей", "дитина": "дітей"}


def units() -> dict[str, tuple[str, str, str, str, str]]:
    out = {}
    for base, (*forms, gender) in BASES.items():
        out[base] = (*forms, gender)
        for p in PREFIXED[base]:
            out[p + base] = (*(PREFIXES[p] + f for f in forms), gender)
    return out | OTHER_UNITS


def nouns() -> dict[str, tuple[str, str, str, str]]:
    """one, few, many and gender by each of the forms."""
    rows = [(w, *IRREGULAR.get(w, (w + "и", w + "ів")), "m") for w in NOUNS]
    rows += [(w, w[:-1] + "и", FEMININE_MANY.get(w, w[:-1]), "f") for w in FEMININE]
    rows += [(w, w[:-1] + ("я" if w.endswith("е") else "а"), w[:-1] + ("ь" if w.endswith("це") else ""), "n") for w in NEUTER]
    return {form: row for row in rows for form in row[:3]}


@dataclass
class Lexicons:
    units: dict = field(default_factory=units)
    nouns: dict = field(default_factory=nouns)
    abbreviations: dict = field(default_factory=lambda: dict(ABBREVIATIONS))
    acronyms: dict = field(default_factory=lambda: dict(ACRONYMS))
    currencies: dict = field(default_factory=lambda: dict(CURRENCIES))
    finance: dict = field(default_factory=lambda: dict(FINANCE))
    oblique: dict = field(default_factory=dict)  # case forms of nouns and their case: instr or prep
    words: dict = field(default_factory=lambda: ENGLISH | BRANDS)  # Latin words in lower case and their readings; brands win

    @classmethod
    def load(cls, folder: str, **names: str) -> Lexicons:
        """Built-in tables and those of a folder: a file for each name of SCHEMAS that is there; a file's rows win."""
        from pathlib import Path

        out = cls()
        rows = {n: read_lexicon(str(p), n) for n in SCHEMAS if (p := Path(folder, f"{n}.tsv")).exists()}
        out.units |= {r["key"]: (r["one"], r["few"], r["many"], r["decimal"], r["gender"]) for r in rows.get("units", [])}
        out.nouns |= {r["key"]: (r["one"], r["few"], r["many"], r["gender"]) for r in rows.get("counted_nouns", [])}
        out.abbreviations = {r["key"]: r["expansion"] for r in rows.get("abbreviations", [])} or out.abbreviations
        out.acronyms |= {r["acronym"]: r["expansion"] for r in rows.get("acronyms", [])}
        out.oblique |= {r["key"]: r["grammatical_case"] for r in rows.get("counted_oblique", [])}
        out.finance |= {r["code"]: (r["one"], r["few"], r["many"], r["decimal"], "f" if r["feminine"] == "1" else "m") for r in rows.get("finance_units", [])}
        found = {
            r["code"]: (r["symbol"], r["word_re"].replace("(", "(?:"), (r["main_one"], r["main_few"], r["main_many"]), "f" if r["main_fem"] == "1" else "m", (r["sub_one"], r["sub_few"], r["sub_many"]), "f" if r["sub_fem"] == "1" else "m", int(r["minor_digits"]))
            for r in rows.get("currencies", [])
        }
        out.currencies = found or out.currencies
        for n in ("english_words", "brands"):  # brands win
            out.words |= {r["latin"].lower(): r["cyrillic"] for r in rows.get(n, [])}
        return out


def read_lexicon(path: str, name: str) -> list[dict[str, str]]:
    with open(path, encoding="utf-8", newline="") as file:
        lines = [(i, row) for i, row in enumerate(csv.reader(file, delimiter="\t", quoting=csv.QUOTE_NONE), 1) if row and not row[0].startswith("#")]
    header = SCHEMAS[name]
    if not lines or lines[0][1] != header:
        raise ValueError(f"{path}: the header must be {', '.join(header)}")
    seen, out = set(), []
    for i, row in lines[1:]:
        if len(row) != len(header) or row[0] in seen:
            raise ValueError(f"{path}, line {i}: {len(header)} columns and a new first one are expected")
        for column, cell in zip(header, row, strict=True):
            if (not cell and column not in MAY_BE_EMPTY) or unicodedata.normalize("NFC", cell) != cell:
                raise ValueError(f"{path}, line {i}: {column} is empty or not in normal form C")
        seen.add(row[0])
        out.append(dict(zip(header, row, strict=True)))
    return out
