"""Ambiguous or invalid fragments as typed spans.

All spans of a text come from that text alone, so they are found by one function over pieces of Arrow batches, without a shuffle, on
tables and on streams alike. Detectors run in order; the first to find a place keeps it. Numbers, units and words strictly inside an
identifier or a time are dropped, as are numbers inside a sound network address.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kobza.operators import opaque as O
from kobza.operators.pieces import pieces
from kobza.operators.spans import SPAN
from kobza.options import NormalizeOptions
from kobza.sources.lexicons import IBAN_LENGTHS, VIN_WEIGHTS, ZONES, Lexicons

UK = "А-Яа-яҐґЄєІіЇї"
Span = tuple[int, int, str, str, str, str]
# Words that govern a number, that follow one without being a unit, and that may stand for several words.
GOVERNORS = set("близько понад менше більше від до із з без після к у в о об при над під перед між".split())
AGREEING = "близько|понад|перед|між|над|під|при|після|без|від|до|із|у|в|на|з"
NO_UNITS = set("грн коп btc eth usdt bnb у в і й та до від на за з із зі по для р рр тис млн млрд трлн рік року році роки років a b x".split())
ABBREVIATIONS = "обл|кв|ст|р|м|с|в|п"
ROMAN = re.compile("M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})")
NOT_ROMAN = {"CD", "DVD", "MD", "MC", "MM", "CV", "DC", "LCD", "CIV", "MIX", "DIV", "LIV"}
LOOSE = {"BareNumber", "Unit", "ForeignWord", "Time"}
#: Characters and spans of texts that are remembered for equal ones.
MEMO = 1 << 18


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return 12 <= len(digits) <= 19 and total % 10 == 0


def issn_sound(text: str) -> bool:
    digits = [10 if c in "Xx" else int(c) for c in text]
    return len(digits) == 8 and sum((8 - i) * d for i, d in enumerate(digits)) % 11 == 0


def iban_sound(text: str) -> bool:
    code = re.sub(r"\W", "", text).upper()
    if not 15 <= len(code) <= 34 or IBAN_LENGTHS.get(code[:2], len(code)) != len(code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def vin_sound(code: str) -> bool:
    code = code.upper()
    if code[0] not in "12345":
        return True
    value = lambda c: int(c) if c.isdigit() else ord(c) - 64 if c <= "H" else ord(c) - 73 if c <= "R" else ord(c) - 81
    rest = sum(value(c) * w for c, w in zip(code, VIN_WEIGHTS, strict=True)) % 11
    return code[8] == ("X" if rest == 10 else str(rest))


def uuid_sound(text: str) -> bool:
    code = text.replace("-", "").lower()
    return set(code) == {"0"} or code[12] in "12345678" and code[16] in "89ab"


def scanner(options: NormalizeOptions | None, lexicons: Lexicons) -> Callable[[str], list[Span]]:
    """The detectors, compiled. options: what they resolve is not reported; without them every candidate is."""
    detectors: list[Callable[[str, Callable, bool], None]] = []
    open_to = lambda field, value: options is None or getattr(options, field) == value
    words = lexicons.words | (options.vocabulary if options else {})
    nouns, units = lexicons.nouns, lexicons.units

    def find(reason: str, category: str, severity: str, pattern: str, holds: Callable[[re.Match], bool] | None = None, group: int = 0, flags: int = 0, gate: str = "") -> None:
        compiled = re.compile(pattern, flags)
        counts = category not in ("AmbiguousAbbreviation", "ForeignWord", "Web") and r"\d" in pattern and "№" not in pattern[:1]

        def run(text: str, add: Callable, has_digit: bool) -> None:
            if counts and not has_digit or gate and not any(c in text for c in gate):
                return
            for m in compiled.finditer(text):
                if holds is None or holds(m):
                    add(m.start(group), m.end(group), reason, category, severity)

        detectors.append(run)

    if open_to("numeric_date_order", "preserve_ambiguous"):
        find("the order of day and month is open", "Date", "Warning", r"(?<!\w)(?:0?[1-9]|1[0-2])[./-](?:0?[1-9]|1[0-2])[./-](?:\d{4}|\d{2})(?!\w)")
    if open_to("colon_style", "contextual"):
        find("a time or a ratio", "Time", "Warning", r"(?<![\d:])(\d{1,2}):([0-5]\d)(?![\d:])", lambda m: O.clock_sound(m[1], m[2]), gate=":")
    if open_to("currency_symbol_policy", "preserve_ambiguous"):
        find("a symbol of several currencies", "Currency", "Warning", r"[$¥]\s*\d+(?:[.,]\d+)?", gate="$¥")
    date = r"(?<!\w)(\d{1,2})[./](\d{1,2})[./](\d{2,4})(?!\w)"
    beyond = lambda m: not (1 <= int(m[1]) <= 31 and 1 <= int(m[2]) <= 12)
    find("a numeric date with an impossible day or month", "Date", "Error", date, beyond)
    find("no such date", "InvalidDate", "Error", date, lambda m: not beyond(m) and not O.is_date(int(m[1]), int(m[2]), O.full_year(m[3])))
    find("no such date", "InvalidDate", "Error", r"(?<![\w-])(\d{4})-(\d{2})(?:-(\d{2}))?(?![\w-])", lambda m: not O.is_date(int(m[3] or 1), int(m[2]), int(m[1])), gate="-")
    find("no such week", "InvalidDate", "Error", r"(?<![\w-])(\d{4})-W(\d{2})(?:-(\d))?(?![\w-])", lambda m: not (1 <= int(m[2]) <= O.weeks(int(m[1])) and 1 <= int(m[3] or 1) <= 7), gate="W")
    find("no such day of the year", "InvalidDate", "Error", r"(?<![\w-])(\d{4})-(\d{3})(?![\w-])", lambda m: not 1 <= int(m[2]) <= 337 + O.month_length(2, int(m[1])), gate="-")
    find("no such offset from UTC", "Time", "Error", r"(?:(?<![\d:])\d{1,2}:\d{2}\s*)?(?:UTC|GMT)\s*[+−-](\d{1,2})(?::?(\d{2}))?(?!\d)", lambda m: not O.offset_sound(m[1], m[2]), gate="UG")
    find("no such offset from UTC", "Time", "Error", r"(?<![\d:])\d{1,2}:\d{2}\s*[+−-](\d{1,2}):(\d{2})(?!\d)", lambda m: not O.offset_sound(m[1], m[2]), gate=":")
    find("an unknown time zone", "Time", "Warning", r"(?<![\d:])\d{1,2}:\d{2}(?::\d{2})?\s+([A-Za-z_+-]+/[A-Za-z0-9_+/-]+)", lambda m: m[1].lower() not in ZONES, group=1, gate="/")
    find("a decimal comma or a group of thousands", "AmbiguousNumberGrouping", "Warning", r"(?<![\w.,])\d{1,3},\d{3}(?![\w,]|\.\d)", gate=",")
    find("no such time", "Time", "Error", r"(?<![\d:])(\d{1,2}):(\d{2})(?![\d:])", lambda m: not O.clock_sound(m[1], m[2]), gate=":")
    find("no such time on a twelve-hour clock", "Time", "Error", r"(?<![\d:])(\d{1,2})(?::(\d{2}))?\s*[AaPp]\.?[Mm]\b", lambda m: not 1 <= int(m[1]) <= 12 or int(m[2] or 0) > 59, gate="MmM")
    find("division by zero", "Fraction", "Error", r"(?<![\d/.])\d+/0+(?![\d/.])", gate="/")
    find("a number without its exponent", "Scientific", "Warning", r"(?<![\w.,:-])(\d+(?:[.,]\d+)?)[eE][+-]?(?![\w+-]|[+-]?\d)", lambda m: not m[1].startswith("802."), gate="eE")
    find("no such address", "Network", "Error", r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?:/(\d{1,3}))?(?::(\d{1,5}))?(?![\d/:]|\.\d)", lambda m: any(int(o) > 255 for o in m[1].split(".")) or int(m[2] or 0) > 32 or int(m[3] or 0) > 65535, gate=".")
    find("outside the bounds of latitude or longitude", "Coordinate", "Error", r"\bgeo\s*:\s*([+-]?\d{1,3}(?:\.\d+)?)\s*[,;]\s*([+-]?\d{1,3}(?:\.\d+)?)(?:\s*[,;]\s*[+-]?\d+(?:\.\d+)?)?", lambda m: abs(float(m[1])) > 90 or abs(float(m[2])) > 180, flags=re.I, gate="oO")
    find("no such degrees, minutes or seconds", "Coordinate", "Error", r"(?<!\d)(\d{1,3})\s*°\s*(\d{1,2})\s*[′']\s*(\d{1,2})\s*[″\"]\s*([NSEWnsew])", lambda m: not O.degrees_sound(m[1], m[2], m[3], m[4]), gate="°")
    find("an abbreviation with several readings", "AmbiguousAbbreviation", "Warning", rf"(?<![\d{UK}])(?<!\d )(?:{ABBREVIATIONS})\.(?![{UK}])", gate=".")
    find("letters of both scripts", "MixedScript", "Error", rf"(?<![A-Za-z{UK}])(?:[A-Za-z]+[{UK}]|[{UK}]+[A-Za-z])[A-Za-z{UK}]*")
    find("a foreign word without a reading", "ForeignWord", "Info", rf"(?<![A-Za-z{UK}\d@#./:_'-])[A-Za-z][A-Za-z'-]*[A-Za-z](?![A-Za-z{UK}\d@:/_])", lambda m: not re.fullmatch("[A-Z]{2,6}", m[0]) and m[0].lower() not in words)
    find("a Roman numeral or letters", "RomanNumeral", "Info", r"(?<!\w)[IVXLCDM]{2,}(?!\w)", lambda m: bool(ROMAN.fullmatch(m[0])) and m[0] not in NOT_ROMAN)
    fails = "{} fails its check".format
    head = r"\s*[:№#]?\s*"
    find(fails("ISBN"), "Identifier", "Error", rf"\bISBN(?:-1[03])?{head}((?:97[89][ -]?)?[0-9X](?:[ -]?[0-9X]){{8,12}})(?!\w)", lambda m: not O.isbn_sound(m[1]), flags=re.I, gate="Nn")
    find(fails("ISSN"), "Identifier", "Error", rf"\bISSN(?:-L)?{head}(\d{{4}})[ -]?(\d{{3}}[\dX])(?!\w)", lambda m: not issn_sound(m[1] + m[2]), flags=re.I, gate="Nn")
    find(fails("IBAN"), "Identifier", "Error", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", lambda m: not iban_sound(m[0]))
    find(fails("payment card"), "Identifier", "Error", rf"(?<![{UK}])(?:номер\s+картки|картк[ауи]|карт[ау])\s+(\d(?:[ -]?\d){{11,18}})(?!\d)", lambda m: not luhn(re.sub(r"\D", "", m[1])), flags=re.I)
    find(fails("payment card"), "Identifier", "Error", r"(?<![\w-])(?<!\d )\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?![\w-]| \d)", lambda m: not re.search(r"(?:картк[ауи]|карт[ау])\s+$", m.string[max(0, m.start() - 16) : m.start()], re.I) and not luhn(re.sub(r"\D", "", m[0])))
    find(fails("VIN"), "Identifier", "Error", rf"\bVIN{head}([A-HJ-NPR-Z0-9]{{17}})(?!\w)", lambda m: not vin_sound(m[1]), flags=re.I, gate="Vv")
    find(fails("UUID"), "Identifier", "Error", r"(?<![\w-])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![\w-])", lambda m: not uuid_sound(m[0]), gate="-")
    find("a digest of the wrong length", "Identifier", "Error", r"\b(MD5|SHA-?(?:1|224|256|384|512)|SHA3-?(?:256|512)|BLAKE2[bs])\s*[:=]?\s+([0-9a-f]{1,128})\b", lambda m: O.DIGESTS[m[1].lower().replace("-", "")] != len(m[2]), flags=re.I)
    find("an identifier", "Identifier", "Info", rf"№\s*[A-Za-z{UK}0-9]+(?:[/-][A-Za-z{UK}0-9]+)+|(?:ЄДРПОУ|РНОКПП|ІПН|ЄРДР)\.?{head}\d{{6,20}}|паспорт\s+[A-Z{UK}]{{2}}\s?\d{{6}}|(?<!\w)[A-ZА-ЯҐЄІЇ]{{1,4}}-?\d+(?:[/-][\dA-ZА-ЯҐЄІЇ]+)+(?!\w)", flags=0)
    find("an identifier", "Identifier", "Info", rf"(?<![{UK}])(?:номер\s+картки|картк[ауи]|карт[ау])\s+\d(?:[ -]?\d){{11,18}}(?!\d)", flags=re.I)
    find("a broken e-mail address", "Web", "Warning", r"(?<![\w.%+-])[\w.%+-]+@(?=\s|$)|(?<![\w.%+-])[\w.%+-]+@[^\s@.]+(?=\s|$)", gate="@")
    find("a broken address of the web", "Web", "Warning", r"(?<!\w)(?:https?://|www\.)(?=\s|$)", flags=re.I)

    def odd_unit(m: re.Match) -> bool:
        number, unit = m[1], m[2]
        if unit in units or unit.lower() in NO_UNITS or unit.lower() in nouns or unit in lexicons.currencies or re.fullmatch("[A-Z]{3,6}", unit):
            return False
        return not (number.startswith("802.") or re.fullmatch("[2-6]G", m[0]) or unit.lower() in words)

    find("an unknown unit", "Unit", "Warning", rf"(?<![\w.,:/-])(\d+(?:[.,]\d+)?)\s*([A-Za-z{UK}]{{1,4}})(?![\w/'-])", odd_unit)
    find("a year or a number", "BareNumber", "Warning", r"(?<![\d.,])(1\d{3}|20\d{2})(?!\d|[.,]\d|\s*(?:рік|року|році|рр?\.|ст\.))")
    cue = re.compile(rf"\s*(?:(?:{'|'.join(sorted(map(re.escape, units), key=len, reverse=True))})(?![{UK}A-Za-z])|%|грн|коп|рік|року|році|тис|млн|млрд|[-–—])", re.I)
    word_before = re.compile(rf"([{UK}]+)\s+$")

    def bare(m: re.Match) -> bool:
        if len(m[0]) > 1 and m[0][0] == "0":
            return False
        before = word_before.search(m.string[max(0, m.start() - 24) : m.start()])
        return not (before and before[1].lower() in GOVERNORS) and not cue.match(m.string, m.end())

    find("a number without a noun", "BareNumber", "Warning", r"(?<![\d.,:%/-])\d{1,4}(?![\d.,:%/-]*[\d:%/-])", bare)

    def unknown_noun(m: re.Match) -> bool:
        noun = m[3]
        return not (noun.lower() in nouns or noun in units or noun.lower() in units or noun.lower() in lexicons.oblique)

    agreement = re.compile(rf"(?<![{UK}-])({AGREEING})\s+(\d{{1,6}})\s+([^\s\d,.;:!?()]{{3,}})", re.I)
    network = re.compile(r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?:/(\d{1,3}))?(?::(\d{1,5}))?(?!\w)")

    def first_found(text: str) -> dict[tuple[int, int], tuple[str, str, str]]:
        """Reason, category and severity by place, of the first detector to find it."""
        seen: dict[tuple[int, int], tuple[str, str, str]] = {}

        def add(start: int, stop: int, reason: str, category: str, severity: str) -> None:
            seen.setdefault((start, stop), (reason, category, severity))

        has_digit = re.search(r"\d", text) is not None
        for run in detectors:
            run(text, add, has_digit)
        for m in agreement.finditer(text):
            if unknown_noun(m):
                add(m.start(2), m.end(3), "agreement with an unknown noun", "Agreement", "Info")
        return seen

    def scan(text: str) -> list[Span]:
        seen = first_found(text)
        sound = [m.span() for m in network.finditer(text) if all(int(o) <= 255 for o in m[1].split(".")) and int(m[2] or 0) <= 32 and int(m[3] or 0) <= 65535] if "." in text else []
        # Sorted by start, so the farthest end of all holders so far tells whether one of them holds a span.
        order = sorted(seen, key=lambda s: (s[0], -s[1]))
        out, reach, net, at = [], -1, -1, 0
        for start, stop in order:
            reason, category, severity = seen[start, stop]
            while at < len(sound) and sound[at][0] <= start:
                net, at = max(net, sound[at][1]), at + 1
            inside = category in LOOSE and reach >= stop
            network_part = category in ("Date", "Fraction", "BareNumber") and net >= stop
            if category in ("Identifier", "Time"):
                reach = max(reach, stop)
            if not inside and not network_part:
                out.append((start, stop, text[start:stop], reason, category, severity))
        return sorted(out)

    scan.first_found = first_found
    return scan


def arrow_spans(found: list[list[Span] | None]) -> pa.Array:
    rows = [s for f in found if f for s in f]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = [pa.int32(), pa.int32(), *[pa.string()] * 4]
    values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["start", "stop", "text", "reason", "category", "severity"])
    ends = list(accumulate((len(f or ()) for f in found), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([f is None for f in found]))


def spans(text: Column, options: NormalizeOptions | None = None, lexicons: Lexicons | None = None) -> Column:
    """All spans of a text in the order of their places: array<struct<start, stop, text, reason, category, severity>>.

    Places are in code points, stop exclusive. Null gives null, and a text without spans an empty array.
    """
    tables = lexicons or Lexicons()

    @F.arrow_udf(f"array<{SPAN}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = scanner(options, tables)  # once a task
        memo: dict[str, list[Span]] = {}  # of equal texts that are near each other
        size = 0
        for batch in batches:
            for texts in pieces(batch):
                found = []
                for t in texts.to_pylist():
                    if t is not None and t not in memo:
                        memo[t] = scan(t)
                        size += len(t) + len(memo[t])
                    found.append(None if t is None else memo[t])
                yield arrow_spans(found)
                if size > MEMO:
                    memo, size = {}, 0

    return run(text)


def flag_uncertain(df: DataFrame, text: str = "text", key: str = "doc_id", options: NormalizeOptions | None = None, lexicons: Lexicons | None = None) -> DataFrame:
    """A row for each span: key, start, stop, text, reason, category, severity. Null texts have no spans."""
    return df.select(F.col(key), F.explode(spans(F.col(text), options, lexicons)).alias("_s")).select(key, "_s.*")


def uncertain_spans(df: DataFrame, text: str = "text", key: str = "doc_id", options: NormalizeOptions | None = None, lexicons: Lexicons | None = None) -> DataFrame:
    """key and spans: all of a text's, in the order of their places; none for a null text."""
    return df.select(key, F.coalesce(spans(F.col(text), options, lexicons), F.expr(f"cast(array() as array<{SPAN}>)")).alias("spans"))
