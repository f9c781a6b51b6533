"""Sentences and tokens of Ukrainian text, with offsets in code points.

Both are decided from left to right with a look at neighbours. Tokens look at two neighbours on either side and, for
smileys, at the token so far; sentences at ten characters on either side of a delimiter and at the sentence so far. That is state
which no window function carries, so the two run as Arrow functions over batches of texts, a piece of a batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kobza.operators.pieces import pieces

SPANS = "array<struct<start: int, stop: int, text: string>>"

# Character classes and abbreviations.
SPACE = " \t\n\r\f\v\xa0"
UK = "а-яА-ЯґҐєЄіІїЇ"
LETTER = f"A-Za-z{UK}_ÅåğĞͰ-Ͽ"
PUNCTUATION = set("\\/!#$%&*+,.:;<=>?@^_`|~№…‑–—−-«“‘»”’\"„'()[]{}")
DASHES = "‑–—−-"
TRAILING = set(
    "тис млн млрд грн коп проц га кг г т куб кв км м см мм л год хв сек ст р рр с к руб крб co corp inc ed al мон моз мвс сбу нбу дпс "
    "дбр набу назк ова ода рда кмда мкм нм квт мвт шт од екз вс оаск єрдр ecli".split()
)
LEADING = set(
    "ст укр англ нім фр італ грец лат mr mrs ms dr vs св проф акад доц канд д-р ред гр ім тов п пп ч чч гл абз пт no просп пр вул ш м "
    "смт с обл р-н корп пер пл буд кв оф каб літ р а оз г напр дод юр фіз тел тобто див розд табл мал рис пор упоряд мкр наб пров шос "
    "бул деп пост наказ підп арк вип стор ухв ріш провадж спр поз позов відп заявн оск адмін крим цив госп док прим перекл вид т тт зб "
    "зош журн газ асист викл зав лаб інж н чл.-кор м-н ж/м в/ч остр річ станц залізн бл прибл зокр порівн підрозд тр скаржн кк кпк цк "
    "цпк гк гпк кас купап кзпп пку мку зку ску вс вп кцс кгс ккс оаск v єрдр ecli".split()
)
OTHER = set("скор рис винят прим заст жарт".split())
KNOWN = TRAILING | LEADING | OTHER
INITIALS = {"дж", "ed"}
LEADING_PAIRS = {"т е", "т к", "т н", "и о", "к н", "к п", "п н", "к т", "л д", "і т", "ст ст", "а с"}
PAIRS = LEADING_PAIRS | {"т п", "т д", "у е", "н э", "p m", "a m", "с г", "р х", "с ш", "з д", "л с", "ч т", "ед ч", "мн ч", "повел накл", "жен рмуж р"}

SMILEY = re.compile(r"[=:;]-?[()]{1,3}")
ATOM = re.compile(
    rf"(?P<legal>№-?[A-Za-z{UK}0-9/-]+)"
    rf"|(?P<url>https?://[^{SPACE}<>\"«»“”()\[\]{{}}]*)"
    rf"|(?P<handle>[@#][A-Za-z{UK}0-9_-]+)"
    rf"|(?P<mail>[A-Za-z{UK}0-9][A-Za-z{UK}0-9_.-]*@[A-Za-z{UK}0-9_.-]*\.[A-Za-z{UK}0-9_.-]*)"
    rf"|(?P<uk>[{UK}](?:[{UK}]|(?<=[{UK}])['’ʼ`](?=[{UK}]))*)|(?P<latin>[A-Za-z]+)|(?P<number>[0-9]+)|(?P<mark>[^{SPACE}])"
)
PLAIN = re.compile(rf"[{LETTER}]+|[0-9]+|[^{SPACE}]")
LAST = re.compile(rf"([{LETTER}]+|[0-9]+|[^{SPACE}])[{SPACE}]*$")
COMPOUND = re.compile(rf"([{LETTER}0-9./-]*[{LETTER}0-9])[{SPACE}]*$")
DOTTED = re.compile(rf"([{LETTER}0-9]+)[{SPACE}]*\.[{SPACE}]*$")
PAIR = re.compile(rf"([{LETTER}0-9]+)[{SPACE}]*\.[{SPACE}]*([{LETTER}0-9]+)[{SPACE}]*$")
BULLET_LETTER = re.compile(rf"[{SPACE}]*[A-Za-z{UK}]\)(?:[{SPACE}]|$)")
WORD = re.compile(rf"[{LETTER}]+|[0-9]+")
ALPHABETIC = re.compile(rf"[A-Za-z{UK}]+")
DELIMITERS = set(".?!…;\"„'»”’)]}")
LOWERING = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГҐДЕЄЖЗИІЇЙКЛМНОПРСТУФХЦЧШЩЬЮЯЪЫЭ"})


def atoms(text: str) -> list[tuple[int, int, str, str]]:
    """start, stop, kind (uk, latin, number, mark or other) and text of the smallest units."""
    out, at = [], 0
    while m := ATOM.search(text, at):
        kind, stop = m.lastgroup, m.end()
        if kind in ("url", "mail"):
            body = m[0].rstrip(".,;:!?")
            if kind == "mail" and not re.fullmatch(r"[^@]+@[^@]*\.[^@]*", body):
                m = re.compile(f"[{UK}]+|[A-Za-z]+|[0-9]+").match(text, m.start())
                kind, stop = ("number" if m[0].isdigit() else "latin" if m[0].isascii() else "uk"), m.end()
            else:
                kind, stop = "other", m.start() + len(body)
        elif kind in ("legal", "handle"):
            kind = "other"
        elif kind == "mark" and m[0] not in PUNCTUATION:
            kind = "other"
        out.append((m.start(), stop, kind, text[m.start() : stop]))
        at = stop
    return out


def one_token(left: tuple, before: tuple | None, right: tuple, after: tuple | None, token: str) -> bool:
    """Whether two adjacent atoms belong together; before and after: the atoms beside them; token: what the left is part of."""

    def bridged(marks: str, fits: Callable[[tuple, tuple], bool]) -> bool:
        for mark in marks:
            if left[3][0] == mark and before:
                if fits(before, right):
                    return True
            elif right[3][0] == mark and after and fits(left, after):
                return True
        return False

    if bridged(DASHES + "_", lambda a, b: a[2] != "mark" and b[2] != "mark") or bridged(".,/\\", lambda a, b: a[2] == b[2] == "number"):
        return True
    if left[2] == right[2] == "mark" and (SMILEY.fullmatch(token + right[3]) or (left[3] in ".?!…" and right[3] in ".?!…") or (left[3] == right[3] and left[3] in "-*")):
        return True
    wordy = {"other", "uk", "latin"}
    if (left[2] == "other" and right[2] in wordy) or (left[2] in wordy and right[2] == "other"):
        return True
    if left[2] == "number" and right[2] in ("uk", "latin") and right[3].translate(LOWERING) in KNOWN:
        return True
    return right[3] == "!" and left[3].translate(LOWERING) == "yahoo"


def tokens(text: str) -> list[tuple[int, int, str]]:
    found = atoms(text)
    out: list[tuple[int, int, str]] = []
    for i, a in enumerate(found):
        left = found[i - 1] if i else None
        if left and left[1] == a[0] and one_token(left, found[i - 2] if i > 1 else None, a, found[i + 1] if i + 1 < len(found) else None, text[out[-1][0] : left[1]]):
            out[-1] = (out[-1][0], a[1], text[out[-1][0] : a[1]])
        else:
            out.append(a[:2] + (a[3],))
    return out


def is_lower(word: str) -> bool:
    return re.fullmatch(f"[A-Za-z{UK}ÅåğĞͰ-Ͽ]+", word) is not None and word.lower() == word


def follows_abbreviation(word: str) -> bool:
    return word.isdigit() or not ALPHABETIC.fullmatch(word) or is_lower(word)


def is_bullet(word: str) -> bool:
    return re.fullmatch("[0-9]+", word) is not None or word in ".)" or word.translate(LOWERING) in "§абвгдеabcdef" or re.fullmatch("[IVXML]+", word) is not None


def dot_goes_on(left: str, last: str, right: str) -> bool:
    """Whether a full stop after an abbreviation, an initial or a number doesn't end the sentence."""
    compound = COMPOUND.search(left)
    low = (compound[1].lstrip("-./") if compound and re.search("[-./]", compound[1]) else last).translate(LOWERING)
    if low in ("м", "с"):
        before = PLAIN.findall(left)[-2:-1]
        if before and before[0].isdigit():
            return False
    if last.isdigit() and right.isdigit():
        return True
    if (dotted := DOTTED.search(left)) and dotted[1].translate(LOWERING) in KNOWN and follows_abbreviation(right):
        return True
    single = True
    if pair := PAIR.search(left):
        both = " ".join(pair.groups()).translate(LOWERING)
        if both in LEADING_PAIRS or (both in PAIRS and follows_abbreviation(right)):
            return True
        single = both not in PAIRS
    if single:
        if low == "ст" and (right.isdigit() or re.fullmatch("[IVXLCDM]+", right)):
            return True
        if (low != "ст" and low in LEADING) or (low in KNOWN and follows_abbreviation(right)) or f"{low} {right.translate(LOWERING)}" in PAIRS:
            return True
    return (len(last) == 1 and last.isalpha() and last.lower() != last) or low in INITIALS


def goes_on(left: str, delimiter: str, right: str, sofar: str) -> bool:
    """Whether the sentence goes on behind a delimiter. left and right: ten characters; sofar: the sentence up to it."""
    last, first = LAST.search(left), PLAIN.search(right)
    if not last or not first or right[0] not in SPACE:
        return True
    last, first = last[1], first[0]
    bare = right.lstrip(" \t\r\n")
    line = re.split(r"[\r\n]", sofar)[-1]
    if line.lstrip(" \t").startswith("==") and bare.startswith("=="):
        return True
    if re.search(r"[\r\n]", right[: len(right) - len(bare)]) or BULLET_LETTER.match(right):
        return False
    if is_lower(first):
        return True
    if first[0] not in "\"„'" and (first[0] in DELIMITERS or SMILEY.match(right.lstrip(SPACE))):
        return True
    if delimiter == "." and dot_goes_on(left, last, first):
        return True
    if delimiter in ".)" and len(sofar.encode()) <= 20 and (parts := PLAIN.findall(sofar)) and all(map(is_bullet, parts)):
        return True
    if delimiter[0] in "\"„'»”’)]}" and (last[0] not in ".?!…" or (delimiter[0] in "\"„'" and left[-1:] in SPACE)):
        return True
    return first[0] in DASHES and (word := WORD.search(right)) is not None and is_lower(word[0])


def sentences(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []

    def add(start: int, stop: int) -> None:
        body = text[start:stop]
        start += len(body) - len(body.lstrip(SPACE))
        if body := body.strip(SPACE):
            out.append((start, start + len(body), body))

    start = at = 0
    while at < len(text):
        smiley = SMILEY.match(text, at)
        stop = smiley.end() if smiley else at + 1
        if (smiley or text[at] in DELIMITERS) and not goes_on(text[max(0, at - 10) : at], text[at:stop], text[stop : stop + 10], text[start:at]):
            add(start, stop)
            start = stop
        at = stop
    add(start, len(text))
    return out


def _spans(split: Callable[[str], list[tuple[int, int, str]]]) -> Callable[[Column], Column]:
    def found_in(texts: pa.Array) -> pa.Array:
        found = [None if t is None else split(t) for t in texts.to_pylist()]
        rows = [s for f in found if f for s in f]
        start, stop, part = zip(*rows, strict=True) if rows else ((), (), ())
        values = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(part, pa.string())], names=["start", "stop", "text"])
        ends = list(accumulate((len(f or ()) for f in found), initial=0))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([f is None for f in found]))

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from map(found_in, pieces(batch))

    return run


def tokenize(text: Column) -> Column:
    """array<struct<start, stop, text>>; null for null, empty for a text of blanks."""
    return _spans(tokens)(text)


def split_sentences(text: Column) -> Column:
    """array<struct<start, stop, text>>, trimmed; null for null, empty for a text of blanks."""
    return _spans(sentences)(text)
