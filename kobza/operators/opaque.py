"""Fragments of a text that normalization leaves as they are: markup, code, and what looks like a value but is none.

Each rule is a pattern and a test of its match. A fragment gives way to a mark of private-use characters, which no step
matches, and comes back when the steps are done. Marks may stand within a later fragment, so they are restored from the
last one to the first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from kobza.options import NormalizeOptions
from kobza.sources.lexicons import ZONES

OPEN, CLOSE, FIRST = "\ue000", "\ue001", 0xE100
MARK = re.compile(f"{OPEN}[\ue100-\ue13f]+{CLOSE}")
CLASSIFIED = re.compile(r"(?:клас(?:ифікація|ифікатор)?|код|УДК|КВЕД|МКХ|індекс)\S*\s+$", re.I)
# Lengths of digests in hex digits.
DIGESTS = {"md5": 32, "sha1": 40, "sha224": 56, "sha256": 64, "sha384": 96, "sha512": 128, "sha3256": 64, "sha3512": 128, "blake2s": 64, "blake2b": 128}


@dataclass(frozen=True)
class Rule:
    """kept(match): whether the fragment stays as it is; group: which part of the match."""

    name: str
    pattern: re.Pattern
    kept: Callable[[re.Match], bool] = lambda m: True
    group: int = 0


def month_length(month: int, year: int) -> int:
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month - 1] if 1 <= month <= 12 else 0


def is_date(day: int, month: int, year: int) -> bool:
    return 1 <= day <= month_length(month, year)


def weeks(year: int) -> int:
    weekday = (year - 1 + (year - 1) // 4 - (year - 1) // 100 + (year - 1) // 400 + 1) % 7
    return 53 if weekday == 4 or weekday == 3 and month_length(2, year) == 29 else 52


def full_year(text: str) -> int:
    return int(text) if len(text) > 2 else int(text) + (2000 if int(text) < 50 else 1900)


def isbn_sound(text: str) -> bool:
    digits = [10 if c in "Xx" else int(c) for c in re.sub(r"[^0-9Xx]", "", text)]
    if len(digits) == 10:
        return sum((10 - i) * d for i, d in enumerate(digits)) % 11 == 0 and 10 not in digits[:9]
    return len(digits) == 13 and 10 not in digits and sum(d * (3 if i % 2 else 1) for i, d in enumerate(digits)) % 10 == 0


def clock_sound(hour: str, minute: str) -> bool:
    return int(minute) < 60 and (int(hour) < 24 or (int(hour), int(minute)) == (24, 0))


def offset_sound(hour: str, minute: str | None) -> bool:
    return int(minute or 0) < 60 and int(hour) * 60 + int(minute or 0) <= 14 * 60


def degrees_sound(degrees: str, minutes: str | None, seconds: str | None, axis: str) -> bool:
    most = 90 if axis[0].lower() in "ns" or axis.lower().startswith(("пн", "пд", "півн", "півд")) else 180
    rest = float(minutes or 0) + float(seconds or 0)
    return float(degrees) <= most and float(minutes or 0) < 60 and float(seconds or 0) < 60 and not (float(degrees) == most and rest)


def braces(text: str) -> Iterator[tuple[int, int]]:
    """Places of {\\displaystyle ...} with its braces balanced; an escaped brace counts for nothing."""
    at = 0
    while (start := text.find("{\\displaystyle", at)) >= 0:
        depth, i = 0, start
        while i < len(text):
            if text[i] == "\\":
                i += 1
            elif text[i] in "{}":
                depth += 1 if text[i] == "{" else -1
                if not depth:
                    break
            i += 1
        else:
            return
        yield start, i + 1
        at = i + 1


def rules(options: NormalizeOptions) -> list[Rule]:
    out: list[Rule] = []

    def add(name: str, pattern: str, kept: Callable[[re.Match], bool] = lambda m: True, group: int = 0, flags: int = 0) -> None:
        out.append(Rule(name, re.compile(pattern, flags), kept, group))

    add("phonetic", r"\[[^\[\]\n]*[ɐ-˿ᴀ-ᵿ][^\[\]\n]*\]")
    add("comment", r"<!--.*?-->", flags=re.S)
    add("fence", r"(`{3,}|~{3,}).*?\1", flags=re.S)
    add("inline code", r"(?<!`)(`{1,2})(?!`).+?(?<!`)\1(?!`)")
    add("code element", r"<(code|pre)\b[^>]*>.*?</\1\s*>", flags=re.S | re.I)
    add("tag", r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*)?/?>|<!doctype[^>]*>", flags=re.I)
    add("entity", r"&(?:#\d+|#x[0-9a-f]+|[a-z][a-z0-9]*);", flags=re.I)
    add("link destination", r"\]\(((?:[^()\n]|\((?:[^()\n]|\([^()\n]*\))*\))*)\)", group=1)
    add("reference", r"^ {0,3}\[[^\]\n]+\]:[ \t]*(\S+)", group=1, flags=re.M)
    add("malformed scientific", r"(?<![\w.,:-])(\d+(?:[.,]\d+)?)[eE][+-]?(?![\w+-]|[+-]?\d)", lambda m: not m[1].startswith("802."))
    add("ISBN", r"\bISBN(?:-1[03])?\s*[:№#]?\s*([0-9X](?:[ -]?[0-9X]){8,12})(?!\w)", lambda m: not isbn_sound(m[1]), flags=re.I)
    add("digest", r"\b(MD5|SHA-?(?:1|224|256|384|512)|SHA3-?(?:256|512)|BLAKE2[bs])\s*[: ]\s*([0-9a-f]{8,})\b", lambda m: DIGESTS[m[1].lower().replace("-", "")] != len(m[2]), flags=re.I)
    add("duration", r"(?<!\w)P(?:\d+(?:[.,]\d+)?[YMWD])*(T(?:\d+(?:[.,]\d+)?[HMS])*)?(?!\w)", lambda m: m[0].endswith("T") or len(m[0]) > 1 and not any(c.isdigit() for c in m[0]))
    add("offset", r"(?<![\d:])(?:\d{1,2}:\d{2}(?::\d{2})?\s*)?(?:UTC|GMT)\s*[+−-](\d{1,2})(?::?(\d{2}))?(?!\d)", lambda m: not offset_sound(m[1], m[2]))
    add("bare offset", r"(?<![\d:])\d{1,2}:\d{2}\s*[+−](\d{1,2}):(\d{2})(?!\d)", lambda m: not offset_sound(m[1], m[2]))
    add("clock", r"(?<![\d:.,])(\d{1,2}):(\d{2})(?::\d{2})?(?![:\d])", lambda m: not clock_sound(m[1], m[2]))
    add("IPv4", r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?:/(\d{1,3}))?(?::(\d{1,5}))?(?![\d/:]|\.\d)", lambda m: any(int(o) > 255 for o in m[1].split(".")) or int(m[2] or 0) > 32 or int(m[3] or 0) > 65535)
    add("IPv6 port", r"\[[0-9A-Fa-f:]+\]:(\d{1,6})(?!\d)", lambda m: int(m[1]) > 65535)
    add("IPv6 prefix", r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}/(\d{1,3})(?!\d)", lambda m: int(m[1]) > 128)
    add("geo", r"(?:geo|координати)\s*[:=]\s*([+−-]?\d{1,3}(?:\.\d+)?)\s*[,;]\s*([+−-]?\d{1,3}(?:\.\d+)?)", lambda m: abs(float(m[1].replace("−", "-"))) > 90 or abs(float(m[2].replace("−", "-"))) > 180, flags=re.I)
    add("labelled coordinates", r"(?:lat(?:itude)?|широта)\s*[:=]\s*([+−-]?\d{1,3}(?:[.,]\d+)?)[,; ]+(?:lon(?:gitude)?|довгота)\s*[:=]\s*([+−-]?\d{1,3}(?:[.,]\d+)?)", lambda m: abs(float(m[1].replace("−", "-").replace(",", "."))) > 90 or abs(float(m[2].replace("−", "-").replace(",", "."))) > 180, flags=re.I)
    add("degrees", r"(?<!\d)(\d{1,3})\s*°\s*(?:(\d{1,2})\s*[′'])?\s*(?:(\d{1,2})\s*[″\"])?\s*([NSEW](?!\w)|(?:пн|пд|сх|зх)\.?\s*[шд]\.?)", lambda m: not degrees_sound(m[1], m[2], m[3], m[4]))
    if options.validate_dates:
        order = options.numeric_date_order

        def impossible(m: re.Match) -> bool:
            day, month = (m[2], m[1]) if order == "month_day_year" else (m[1], m[2])
            return not CLASSIFIED.search(m.string[max(0, m.start() - 40) : m.start()]) and not is_date(int(day), int(month), full_year(m[3]))

        add("date", r"(?<![\w./])(\d{1,2})[./](\d{1,2})[./](\d{4}|\d{2})(?![\w/]|\.\d)", impossible)
        add("ISO date", r"(?<![\w-])(\d{4})-(\d{2})-(\d{2})(?![\d-])", lambda m: not is_date(int(m[3]), int(m[2]), int(m[1])))
        add("ISO week", r"(?<![\w-])(\d{4})-W(\d{2})(?:-(\d))?(?!\d)", lambda m: not 1 <= int(m[2]) <= weeks(int(m[1])) or not 1 <= int(m[3] or 1) <= 7)
        add("ISO ordinal", r"(?<![\w-])(\d{4})-(\d{3})(?![\d-])", lambda m: not 1 <= int(m[2]) <= 337 + month_length(2, int(m[1])))
    add("zone", r"\d{1,2}:\d{2}(?::\d{2})?\s+([A-Za-z_+-]+/[A-Za-z0-9_+/-]+)", lambda m: m[1].lower() not in ZONES)
    if options.currency_symbol_policy == "preserve_ambiguous":
        add("currency symbol", r"[$¥]\s?\d[\d., ]*(?<=\d)|\d[\d., ]*(?<=\d)\s?[$¥]")
    if options.numeric_date_order == "preserve_ambiguous":
        add("date order", r"(?<![\w./])(\d{1,2})[./](\d{1,2})[./](?:\d{4}|\d{2})(?![\w/]|\.\d)", lambda m: 1 <= int(m[1]) <= 12 and 1 <= int(m[2]) <= 12)
    return out


class Opaque:
    """hide() and restore() of one text's fragments."""

    def __init__(self, options: NormalizeOptions):
        self.rules = rules(options)

    def hide(self, text: str) -> tuple[str, list[str]]:
        kept: list[str] = []

        def mark(fragment: str) -> str:
            n, digits = len(kept), []
            kept.append(fragment)
            while n or not digits:
                digits.append(chr(FIRST + n % 64))
                n //= 64
            return OPEN + "".join(digits) + CLOSE

        if re.search(f"[{OPEN}{CLOSE}]", text):  # the text's own private-use characters
            text = re.sub(f"[{OPEN}{CLOSE}]", lambda m: mark(m[0]), text)
        text = re.sub(r"\.:\d+(?:[–-]\d+)?(?::\d+)?(?!\d)", ".", text)  # a citation of pages behind a sentence
        if "{\\displaystyle" in text:
            for start, stop in reversed(list(braces(text))):
                text = text[:start] + mark(text[start:stop]) + text[stop:]
        for r in self.rules:

            def replace(m: re.Match, r: Rule = r) -> str:
                if not r.kept(m) or not m[r.group]:
                    return m[0]
                a, b = m.start(r.group) - m.start(), m.end(r.group) - m.start()
                return m[0][:a] + mark(m[r.group]) + m[0][b:]

            text = r.pattern.sub(replace, text)
        return text, kept

    @staticmethod
    def restore(text: str, kept: list[str]) -> str:
        def of(m: re.Match) -> str:
            n = 0
            for c in reversed(m[0][1:-1]):
                n = n * 64 + ord(c) - FIRST
            return kept[n] if n < len(kept) else m[0]

        for _ in range(len(kept)):
            if not MARK.search(text):
                break
            text = MARK.sub(of, text)
        return text
