"""Readings of technical notation for the rewriting kernel: addresses of networks and places, identifiers, coordinates, powers,
versions, durations, money of all currencies and traded units. Each function adds its steps in order."""

from __future__ import annotations

import re
from collections.abc import Callable

from kobza.functions import text as T
from kobza.operators import readings as R
from kobza.operators.opaque import isbn_sound
from kobza.options import NormalizeOptions
from kobza.sources import lexicons as L

UK = "А-Яа-яҐґЄєІіЇї"
DIGIT, LATIN = re.compile("[0-9]"), re.compile("[A-Za-z]")
# Letter names, words of addresses, halves of the globe, units of durations, vulgar fractions, squares.
LATIN_NAMES = dict(zip("abcdefghijklmnopqrstuvwxyz", "ей бі сі ді і еф джі ейч ай джей кей ел ем ен оу пі к'ю ар ес ті ю ві дабл'ю екс вай зет".split(), strict=True))
PLACES = {
    "смт": "селище міського типу", "просп": "проспект", "пров": "провулок", "корп": "корпус", "буд": "будинок", "вул": "вулиця", "наб": "набережна",
    "бул": "бульвар", "оф": "офіс", "кв": "квартира", "обл": "область", "під": "під'їзд", "пов": "поверх", "р-н": "район", "пр": "проспект", "пл": "площа",
    "м": "місто", "с": "село", "б": "будинок",
}
HALVES = {"n": "північної широти", "s": "південної широти", "e": "східної довготи", "w": "західної довготи", "пн": "північної широти", "пд": "південної широти", "сх": "східної довготи", "зх": "західної довготи"}
DEGREES, MINUTES, SECONDS = ("градус", "градуси", "градусів"), ("хвилина", "хвилини", "хвилин"), ("секунда", "секунди", "секунд")
DURATIONS = {
    "Y": ("рік", "роки", "років", "року", "m"), "M": ("місяць", "місяці", "місяців", "місяця", "m"), "W": ("тиждень", "тижні", "тижнів", "тижня", "m"),
    "D": ("день", "дні", "днів", "дня", "m"), "H": ("година", "години", "годин", "години", "f"), "m": ("хвилина", "хвилини", "хвилин", "хвилини", "f"), "S": ("секунда", "секунди", "секунд", "секунди", "f"),
}
VULGAR = {"½": (1, 2), "⅓": (1, 3), "⅔": (2, 3), "¼": (1, 4), "¾": (3, 4), "⅕": (1, 5), "⅖": (2, 5), "⅗": (3, 5), "⅘": (4, 5), "⅙": (1, 6), "⅚": (5, 6), "⅐": (1, 7), "⅛": (1, 8), "⅜": (3, 8), "⅝": (5, 8), "⅞": (7, 8), "⅑": (1, 9), "⅒": (1, 10)}
SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
ACCUSATIVE = {"секунда": "секунду", "хвилина": "хвилину", "година": "годину", "миля": "милю", "тонна": "тонну", "унція": "унцію", "атмосфера": "атмосферу"}
Steps = Callable[..., None]


def spell(code: str) -> str:
    """Letters by their names and digits one by one; other characters pass."""
    names = [R.digits(c) if c.isdigit() else LATIN_NAMES.get(c.lower()) or T.LETTER_NAMES.get(c.upper()) for c in code]
    return " ".join(n for n in names if n)


def say_number(text: str) -> str:
    """A whole or decimal number as it is written, with its sign."""
    sign = "мінус " if text[0] in "-−" else "плюс " if text[0] == "+" else ""
    whole, _, part = text.lstrip("+-−").replace(",", ".").partition(".")
    return sign + (R.decimal(whole, part) if part else R.say_digits(whole))


def forms_of(n: int, forms: tuple[str, ...], gender: str) -> str:
    return f"{R.say(n, gender)} {forms[R.form_index(n)]}"


def vulgar_words(top: int, bottom: int) -> str:
    return f"{R.say(top, 'f')} {R.ordinal(bottom, 'nom_f' if R.form_index(top) == 0 else 'pl')}"


def network(step: Steps) -> None:
    def ipv4(m: re.Match) -> str | None:
        if re.search(r"(?:верс\w*|version|ver|v)\.?\s*$", m.string[max(0, m.start() - 16) : m.start()], re.I):
            return None
        said = "ай пі " + " ".join(R.say(int(o)) for o in m[1].split("."))
        return said + (f" префікс {R.say(int(m[2]))}" if m[2] else "") + (f" порт {R.say(int(m[3]))}" if m[3] else "")

    def ipv6(address: str) -> str | None:
        short = address.count("::")
        groups = [g for g in address.split(":") if g]
        if short > 1 or ":::" in address or (not short and len(groups) != 8) or (short and len(groups) > 7) or (not short and not re.search("[A-Fa-f]", address)):
            return None
        if any(len(g) > 4 for g in groups) or re.match(":[^:]", address) or re.search("[^:]:$", address):
            return None
        left, _, right = address.partition("::")
        parts = [spell(g) for g in left.split(":") if g] + (["скорочення нулів"] if short else []) + [spell(g) for g in right.split(":") if g]
        return "ай пі версії шість " + " двокрапка ".join(parts)

    mac = lambda m: "мак адреса " + " двокрапка ".join(spell("".join(p)) for p in zip(*[iter(re.sub("[^0-9A-Fa-f]", "", m[0]))] * 2, strict=True))
    step(r"(?<![0-9A-Fa-f.])[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}(?![0-9A-Fa-f.])", mac)
    step(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])", mac)
    step(r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?:/(\d{1,2}))?(?::(\d{1,5}))?(?![\d:/]|\.\d)", ipv4)
    step(r"(?<![\w:])\[([0-9A-Fa-f:]*:[0-9A-Fa-f:]*)\](?::(\d{1,5})(?!\d))?", lambda m: (lambda a: a and a + (f" порт {R.say(int(m[2]))}" if m[2] else ""))(ipv6(m[1])))
    step(r"(?<![\w:])((?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?:/(\d{1,3}))?(?![\w:/])", lambda m: (lambda a: a and a + (f" префікс {R.say(int(m[2]))}" if m[2] else ""))(ipv6(m[1])))


def addresses(step: Steps) -> None:
    def place(m: re.Match) -> str | None:
        key, before, after = m[1].lower(), m.string[: m.start()], m.string[m.end() :].lstrip(" ")
        if key == "кв" and re.search(r"(?:[IVX]+|(?<!\w)[1-4](?:-й)?)\s*$", before):
            return None
        if key in ("м", "с", "корп") and not re.match(rf"[A-ZА-ЯҐЄІЇ0-9]", after):
            return None
        if key == "с" and re.search(r"вакуумі $", before, re.I):
            return None
        if key == "м":
            if re.search(r"(?:^|[\s(])[уУвВ]\s+$", before):
                return "місті "
            if re.search(r"(?:^|[\s(])(?:від|до|з|із|зі|для)\s+$", before, re.I) or re.match(rf"Києва(?![{UK}])", after):
                return "міста "
        word = PLACES[key]
        return (word[0].upper() + word[1:] if m[1][0].isupper() and key not in ("м", "с") else word) + " "

    names = "|".join(sorted(map(re.escape, PLACES), key=len, reverse=True))
    step(rf"(?<![\w'’-])({names})\.(?!п)\s*(?=[A-Za-z{UK}0-9])", place, re.compile(r"\."), re.I)


def identifiers(step: Steps) -> None:
    head = r"\s*[:№#]?\s*"
    step(rf"\b(ISBN)(?:-1[03])?{head}([0-9X](?:[ -]?[0-9X]){{8,12}})(?!\w)", lambda m: f"ай ес бі ен {spell(m[2])}" if isbn_sound(m[2]) else None, flags=re.I)
    step(rf"\bISSN(-L)?{head}(\d{{4}})[ -]?(\d{{3}}[\dX])(?!\w)", lambda m: f"ай ес ес ен{' ел' if m[1] else ''} {spell(m[2] + m[3])}", flags=re.I)
    step(rf"\bVIN{head}([A-HJ-NPR-Z0-9]{{17}})(?!\w)", lambda m: f"ві ай ен {spell(m[1])}", flags=re.I)
    step(rf"\b(?:SWIFT|BIC){head}([A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?)(?!\w)", lambda m: f"свіфт код {spell(m[1])}", LATIN, re.I)
    step(r"\b(MD5|SHA-?\d+|SHA3-?\d+|BLAKE2[bs])\s*[: ]\s*([0-9a-f]{32,128})(?!\w)", lambda m: f"{spell(re.sub('[^A-Za-z]', '', m[1]))} хеш {spell(m[2])}", flags=re.I)
    step(r"(?<![\w-])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![\w-])", lambda m: "ю ю ай ді " + " дефіс ".join(spell(p) for p in m[0].split("-")))
    step(r"(?<!\w)(?:IBAN\s*:?\s*)?UA((?: ?\d){27})(?!\w)", lambda m: "айбан ю ей " + R.digits(m[1]))
    step(r"(?<!\w)IBAN\s*:?\s*([A-Z]{2})(\d{2}(?: ?[A-Z0-9]){11,30})(?!\w)", lambda m: f"айбан {spell(m[1])} {spell(m[2])}")
    step(r"(?<!\w)(ISO(?:/IEC)?|IEC|IEEE|ДСТУ|ГОСТ|ДБН)([ -])(\d+(?:[.:/-]\d+)*)(?!\w)", lambda m: " слеш ".join(spell(x) for x in m[1].split("/")) + " " + " ".join({".": "крапка", ":": "двокрапка", "/": "слеш", "-": "дефіс"}.get(p) or R.say_digits(p) for p in re.findall(r"\d+|[.:/-]", m[3])))
    step(rf"(?<![\w])([АВСЕНІКМОРТХ]{{2}})\s?(\d{{4}})\s?([АВСЕНІКМОРТХ]{{2}})(?!\w)", lambda m: f"номерний знак {spell(m[1])} {R.digits(m[2])} {spell(m[3])}")
    step(rf"№ ?(\d+)-(\d{{3,}})([{UK}]{{2}})(\d{{2}})(?!\w)", lambda m: f"номер {R.say_digits(m[1])} дефіс {R.digits(m[2])} {spell(m[3])} {R.say_digits(m[4])}")


def coordinates(step: Steps) -> None:
    half = r"([NSEW](?!\w)|(?:пн|пд)\.?\s*ш\.?|(?:сх|зх)\.?\s*д\.?)"
    of = lambda name: HALVES[name[0].lower()] if name[0] in "NSEW" else HALVES[name[:2].lower()]

    def part(value: str) -> str:
        return say_number(value.lstrip("+-−"))

    def geo(m: re.Match) -> str:
        south, west = m[1][0] in "-−", m[2][0] in "-−"
        said = f"географічні координати: {part(m[1])} градуса {'південної' if south else 'північної'} широти, {part(m[2])} градуса {'західної' if west else 'східної'} довготи"
        return said + (f", висота {say_number(m[3])} метрів" if m[3] else "")

    signed = r"([+−-]?\d{1,3}(?:\.\d+)?)"
    step(rf"(?<!\w)(?:geo|координати)\s*[:=]\s*{signed}\s*[,;]\s*{signed}(?:\s*[,;]\s*{signed})?", geo, flags=re.I)
    step(r"(?<!\w)(?:lat(?:itude)?|широта)\s*[:=]\s*([+−-]?\d{1,2}(?:[.,]\d+)?)\s*[,; ]+\s*(?:lon(?:gitude)?|довгота)\s*[:=]\s*([+−-]?\d{1,3}(?:[.,]\d+)?)", lambda m: f"широта {part(m[1])} {'південна' if m[1][0] in '-−' else 'північна'}, довгота {part(m[2])} {'західна' if m[2][0] in '-−' else 'східна'}", flags=re.I)
    step(rf"(?<!\d)(\d{{1,3}})\s*°\s*(\d{{1,2}})\s*[′']\s*(?:(\d{{1,2}})\s*[″\"]\s*)?{half}", lambda m: " ".join([forms_of(int(m[1]), DEGREES, "m"), forms_of(int(m[2]), MINUTES, "f"), *([forms_of(int(m[3]), SECONDS, "f")] if m[3] else []), of(m[4])]) + ("." if m[0].endswith(".") and not m.string[m.end() :] else ""))
    step(rf"(?<![\d.,])([+-]?)(\d{{1,3}})(?:[.,](\d+)\s*°?|°)\s*([NSEW])(?!\w)", lambda m: ({"-": "мінус ", "+": "плюс "}.get(m[1], "")) + (f"{R.decimal(m[2], m[3])} градуса" if m[3] else forms_of(int(m[2]), DEGREES, "m")) + " " + of(m[4]))


def durations(step: Steps) -> None:
    def read(m: re.Match) -> str | None:
        date, _, time = m[0][1:].partition("T")
        parts = [(n, u) for n, u in re.findall(r"(\d+(?:[.,]\d+)?)([YMWD])", date)] + [(n, "m" if u == "M" else u) for n, u in re.findall(r"(\d+(?:[.,]\d+)?)([HMS])", time)]
        said = []
        for n, u in parts:
            *forms, decimal, gender = DURATIONS[u]
            said.append(f"{say_number(n)} {decimal}" if re.search("[.,]", n) else forms_of(int(n), tuple(forms), gender))
        return " ".join(said) or None

    step(r"(?<!\w)P(?=[\dT])(?:\d+(?:[.,]\d+)?[YMWD])*(?:T(?:\d+(?:[.,]\d+)?[HMS])+)?(?!\w)", read)


def clocks(step: Steps, time_words: Callable[[int, int], str | None]) -> None:
    def seconds(m: re.Match) -> str | None:
        said = time_words(int(m[1]), int(m[2]))
        if said is None or int(m[3]) > 59:
            return None
        minutes = "" if int(m[2]) else f" {forms_of(0, MINUTES, 'f')}"
        return f"{said}{minutes} {forms_of(int(m[3]), SECONDS, 'f')}"

    def half_day(m: re.Match) -> str | None:
        hour, minute, pm = int(m[1]), int(m[2] or 0), m[3].lower().startswith("p")
        if not 1 <= hour <= 12 or minute > 59:
            return None
        part = (" дня" if hour < 6 or hour == 12 else " вечора") if pm else (" ночі" if hour < 5 or hour == 12 else " ранку")
        said = forms_of(hour, ("година", "години", "годин"), "f")
        return said + (f" {forms_of(minute, MINUTES, 'f')}" if minute else "") + part

    def zoned(m: re.Match) -> str | None:
        zone, said = L.ZONES.get(m[3].lower()), time_words(int(m[1]), int(m[2]))
        return f"{said} {zone}" if zone and said else None

    def universal(m: re.Match) -> str | None:
        said = time_words(int(m[1]), int(m[2]))
        if said is None:
            return None
        return said + " за всесвітнім координованим часом" + (f" {'плюс' if m[3] == '+' else 'мінус'} {forms_of(int(m[4]), ('година', 'години', 'годин'), 'f')}" if m[3] else "")

    step(r"(?<![\d:])(\d{1,2})(?::(\d{2}))?\s*([AaPp])\.?[Mm]\.?(?!\w)", half_day)
    step(r"(?<![\d:])(\d{1,2}):(\d{2})\s*(?:UTC|GMT)(?:\s*([+−-])(\d{1,2})(?::00)?)?(?![\d:])", universal)
    step(r"(?<![\d:])(\d{1,2}):(\d{2})\s+([A-Za-z_+-]+/[A-Za-z0-9_+/-]+)", zoned)
    step(r"(?<![\d:])(\d{1,2}):(\d{2}):(\d{2})(?![:\d])", seconds)
    step(rf"(?<![{UK}\d])([Оо]б?) (\d{{1,2}})[-–—]?(?:й|ій|а|ої)(?![{UK}])", lambda m: f"{m[1]} {R.ordinal(int(m[2]), 'nom_f')} година")


def science(step: Steps, units: dict) -> None:
    number = r"[+-]?\d+(?:[.,]\d+)?"

    def power(base: str, exponent: str) -> str:
        return f"{base} у степені {say_number(exponent.replace('−', '-'))}"

    step(rf"(\d|[)])([⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)", lambda m: f"{m[1]}^{m[2].translate(SUPERSCRIPTS)}", re.compile("[⁰¹²³⁴-⁹]"))
    step(rf"(?<![\w.,])({number})\s*[×·xX*]\s*10\s*(?:\^\s*([+-]?\d+)|([+−-]\d+))(?!\d)", lambda m: f"{say_number(m[1])} помножити на {power('десять', m[2] or m[3])}")
    step(rf"(?<![\w.,])({number})[eE]([+-]?\d+)(?!\w)", lambda m: f"{say_number(m[1])} помножити на {power('десять', m[2])}" if not m[1].startswith("802.") else None)
    step(r"(?<![\w.,])10−(\d+)(?!\d)", lambda m: power("десять", "-" + m[1]))
    step(rf"(?<![\w.,])({number})\s*\^\s*([+-]?\d+)(?!\d)", lambda m: power(say_number(m[1]), m[2]))
    simple = "|".join(sorted((re.escape(u) for u in units if "/" not in u), key=len, reverse=True))

    def factor(atom: str, accusative: bool) -> str:
        squared = {"²": " у квадраті", "2": " у квадраті", "³": " у кубі", "3": " у кубі"}.get(atom[-1], "") if atom not in units else ""
        one = units[atom if atom in units else atom[:-1]][0]
        return (ACCUSATIVE.get(one, one) if accusative else one) + squared

    def composed(m: re.Match) -> str | None:
        first, rest = m[2], re.findall(rf"([·*/])\s*((?:{simple})[²³23]?)", m[3])
        if f"{first}{m[3]}".replace(" ", "") in units:
            return None
        squared = "" if first in units else factor(first, False)[len(units[first[:-1]][0]) :]
        *forms, decimal, gender = units[first if first in units else first[:-1]]
        said = (f"{say_number(m[1])} {decimal}" if re.search("[.,]", m[1]) else forms_of(int(m[1]), tuple(forms), gender)) + squared
        return said + "".join((" за " if s == "/" else " помножити на ") + factor(u, s == "/") for s, u in rest)

    step(rf"(?<![\w.,])(\d+(?:[.,]\d+)?)\s*((?:{simple})[²³23]?)((?:\s*[·*/]\s*(?:{simple})[²³23]?)+)(?![\w/²³])", composed)
    step(rf"(?<![\w.,])(\d+)\s*({'|'.join(VULGAR)})", lambda m: f"{R.say(int(m[1]), 'f')} цілих і {vulgar_words(*VULGAR[m[2]])}", re.compile("|".join(VULGAR)))
    step(rf"{'|'.join(VULGAR)}", lambda m: vulgar_words(*VULGAR[m[0]]), None)
    step(r"(?<![\w.,/])(\d+) (\d+)/(\d+)(?![\d/])", lambda m: f"{R.say(int(m[1]), 'f')} і {vulgar_words(int(m[2]), int(m[3]))}" if int(m[3]) else None)


def medicine(step: Steps) -> None:
    step(r"(?<![\d.,])(\d{2,3})\s*/\s*(\d{2,3})\s*мм\s*рт\.?\s*ст\.?", lambda m: f"{R.say(int(m[1]))} на {R.say(int(m[2]))} міліметрів ртутного стовпа")
    step(rf"(?<![\w.,])(\d+)\s*(?:р\.|раз(?:и|ів)?)(\s+на\s+(?:день|добу|тиждень|місяць))(?![{UK}])", lambda m: forms_of(int(m[1]), ("раз", "рази", "разів"), "m") + m[2])


def versions(step: Steps, words: dict[str, str]) -> None:
    dotted = lambda v: " крапка ".join(R.say_digits(p) for p in v.split("."))
    step(rf"(?<![\w])((?:верс|реліз|випуск|пункт|розділ)[{UK}]*\s+)(\d+(?:\.\d+)+)(?![\d.]*\d)", lambda m: m[1] + dotted(m[2]), flags=re.I)
    step(r"(?<!\w)([A-Za-z]+) (\d+\.\d+(?:\.\d+)*)(?!\w|\.\d)", lambda m: f"{m[1]} {dotted(m[2])}" if m[1].lower() in words and m[1].lower() not in ("a", "the") else None)
    step(r"(?<!\w)v(\d+(?:\.\d+)+)(?!\w|\.\d)", lambda m: f"ві {dotted(m[1])}", flags=re.I)
    step(r"(?<![\w.])(\d+(?:\.\d+){2,})(?!\w|\.\d)", lambda m: dotted(m[1]))


def money(step: Steps, lexicons: L.Lexicons, options: NormalizeOptions, multipliers: str) -> None:
    """Amounts with a symbol, a word or a code; a part of the unit where its places allow one."""
    amount = r"(\d{1,3}(?:[ \u00a0]\d{3})+|\d{1,3}(?:,\d{3}){2,}|\d{1,3}(?:\.\d{3}){2}(?!\.)|\d+)([.,]\d+)?"

    def said(whole: str, part: str | None, row: tuple) -> str:
        _, _, main, main_gender, sub, sub_gender, places = row
        whole, digits = re.sub(r"\D", "", whole), (part or "")[1:]
        if len(digits) > max(places, 2) and set(digits) != {"0"} or digits and not places:
            return f"{R.decimal(whole, digits)} {main[1]}" if len(digits) <= 6 else f"{R.say_digits(whole)} кома {R.digits(digits)} {main[2]}"
        words = forms_of(int(whole), main, main_gender) if len(whole) <= 18 else f"{R.digits(whole)} {main[2]}"
        cents = int(digits.ljust(places, "0")[:places]) if digits else 0
        return f"{words} {forms_of(cents, sub, sub_gender)}" if cents else words

    step(rf"({'|'.join(re.escape(k) for k in sorted(L.REGIONAL, key=len, reverse=True))})\s?", lambda m: L.REGIONAL[m[1]] + " ", re.compile("[$¥]"))
    symbols = {row[0]: code for code, row in reversed(list(lexicons.currencies.items())) if row[0]}
    known = "|".join(re.escape(x) for x in sorted(symbols, key=len, reverse=True))
    step(rf"({known})\s?(\d+(?:[.,]\d+)?)\s*({multipliers})\.?(?!\w)", lambda m: f"{m[2]} {m[3]} {lexicons.currencies[symbols[m[1]]][2][2]}")
    step(rf"[-−]({known})(?=\d)", lambda m: f"мінус {m[1]}")
    step(rf"({known})\s?{amount}(?!\d)", lambda m: said(m[2], m[3], lexicons.currencies[symbols[m[1]]]))
    step(rf"(?<![\w.,]){amount}\s?({known})(?![\w\d])", lambda m: said(m[1], m[2], lexicons.currencies[symbols[m[3]]]))
    for row in lexicons.currencies.values():
        if row[1]:
            step(rf"(?<![\w.,]){amount}\s?(?:{row[1]})(?!\w)", lambda m, row=row: said(m[1], m[2], row), re.compile(row[1]))
    codes = "|".join(lexicons.currencies)
    step(rf"(?<![\w.,]){amount}\s?({codes})(?!\w)", lambda m: said(m[1], m[2], lexicons.currencies[m[3]]), LATIN)
    step(rf"(?<!\w)({codes})\s?{amount}(?!\w)", lambda m: said(m[2], m[3], lexicons.currencies[m[1]]), LATIN)


def finance(step: Steps, lexicons: L.Lexicons) -> None:
    many = {c: row[2] for c, row in lexicons.finance.items()} | {c: row[2][2] for c, row in lexicons.currencies.items()}
    names = "|".join(sorted(many, key=len, reverse=True))
    tickers = "|".join(sorted(lexicons.finance, key=len, reverse=True))

    def amount(number: str, code: str) -> str:
        *forms, decimal, gender = lexicons.finance[code]
        number = re.sub(r"[ \u00a0]", "", number)
        return f"{say_number(number)} {decimal}" if re.search("[.,]", number) else forms_of(int(number), tuple(forms), gender)

    step(r"₿\s?(\d+(?:[.,]\d+)?)|(?<![\w.,])(\d+(?:[.,]\d+)?)\s?₿", lambda m: amount(m[1] or m[2], "BTC"), re.compile("₿"))
    step(rf"(?<!\w)({names})/({names})(?!\w)", lambda m: f"{many[m[1]]} до {many[m[2]]}", LATIN)
    step(rf"(?<![\w.,])(\d+(?:[.,]\d+)?)\s?({tickers})(?!\w)", lambda m: amount(m[1], m[2]), LATIN)


def headings(text: str) -> str:
    """Lines of the form == Heading == lose their marks."""
    return re.sub(r"(?m)^[ \t]*(={2,6})(?!=)[ \t]*(.*?)[ \t]*(?<!=)\1[ \t]*$", r"\2", text) if "==" in text else text
