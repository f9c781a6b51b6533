"""Readings of numbers for the rewriting kernel: the tables of kobza.functions.morphology on single values."""

from __future__ import annotations

from functools import lru_cache

from kobza.functions import morphology as M


def form_index(n: int) -> int:
    if n % 10 == 1 and n % 100 != 11:
        return 0
    return 1 if 2 <= n % 10 <= 4 and not 12 <= n % 100 <= 14 else 2


def triad(n: int) -> list[str]:
    rest = n % 100
    small = ["", *M.DIGITS[1:], *M.TEENS]
    return [w for w in (M.HUNDREDS[n // 100], *((small[rest],) if rest < 20 else (M.TENS[rest // 10], small[rest % 10]))) if w]


@lru_cache(maxsize=100_000)
def cardinal(n: int) -> tuple[str, ...]:
    if n >= M.LARGEST:
        return tuple(M.DIGITS[int(d)] for d in str(n))
    out: list[str] = []
    for value, forms in M.SCALES:
        if count := n // value % 1000:
            named = triad(count)
            if value == 1000:
                named = [] if count == 1 else [{"один": "одна", "два": "дві"}.get(w, w) for w in named]
            out += [*named, forms[form_index(count)]]
    return tuple(out + triad(n % 1000)) or (M.DIGITS[0],)


def say(n: int, gender: str = "m") -> str:
    *head, last = cardinal(n)
    change = {"f": {"один": "одна", "два": "дві"}, "n": {"один": "одне"}}.get(gender, {})
    return " ".join([*head, change.get(last, last)])


def say_case(n: int, case: str, gender: str = "m") -> str:
    forms = say(n, gender).split()
    return " ".join(M.CASES_OF[w][M.CASES.index(case)] if w in M.CASES_OF else w for w in forms)


def digits(text: str) -> str:
    return " ".join(M.DIGITS[int(c)] for c in text if c in "0123456789")


def say_digits(text: str) -> str:
    """A digit string: from a leading zero or a great length on digit by digit."""
    return digits(text) if (len(text) > 1 and text[0] == "0") or len(text) > 18 else say(int(text))


def inflected(word: str, form: str) -> str:
    if form not in M.HARD:
        return word
    if word.endswith("ій"):
        return word[:-2] + M.SOFT.get(form, M.HARD[form])
    return word.removesuffix("ий") + M.HARD[form]


def ordinal(n: int, form: str = "nom_m") -> str:
    if 2000 <= n <= 9000 and n % 1000 == 0:
        return inflected(M.THOUSANDTHS[n // 1000 - 2] + "тисячний", form)
    *head, last = cardinal(n)
    return " ".join([*head, inflected(M.ORDINAL_OF.get(last, last), form)])


def decimal(whole: str, part: str) -> str:
    if not 1 <= len(part) <= 6 or len(whole) > 18:
        return f"{say_digits(whole or '0')} кома {digits(part)}"
    i, f = int(whole or "0"), int(part)
    place = M.DECIMAL_PLACES[len(part) - 1]
    return f"{say(i, 'f')} {'ціла' if form_index(i) == 0 else 'цілих'} і {say(f, 'f')} {place if form_index(f) == 0 else place[:-1] + 'их'}"


def roman(text: str) -> int:
    values = [{"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}[c] for c in text]
    return sum(-v if v < after else v for v, after in zip(values, [*values[1:], 0], strict=True))
