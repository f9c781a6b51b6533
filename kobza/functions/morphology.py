"""Numbers in Ukrainian words, as Column expressions.

Every function takes and returns Columns, so it stays inside the JVM and can stand in any projection, filter or SQL view.
Null gives null. Negative numbers have no words here: null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kobza.functions.expressions import let, table, words

# Names of numbers, their scales, ordinals and case forms.
DIGITS = ["нуль", "один", "два", "три", "чотири", "п'ять", "шість", "сім", "вісім", "дев'ять"]
TEENS = ["десять", "одинадцять", "дванадцять", "тринадцять", "чотирнадцять", "п'ятнадцять", "шістнадцять", "сімнадцять", "вісімнадцять", "дев'ятнадцять"]
TENS = ["", "десять", "двадцять", "тридцять", "сорок", "п'ятдесят", "шістдесят", "сімдесят", "вісімдесят", "дев'яносто"]
HUNDREDS = ["", "сто", "двісті", "триста", "чотириста", "п'ятсот", "шістсот", "сімсот", "вісімсот", "дев'ятсот"]
SCALES = [
    (10**15, ("квадрильйон", "квадрильйони", "квадрильйонів")),
    (10**12, ("трильйон", "трильйони", "трильйонів")),
    (10**9, ("мільярд", "мільярди", "мільярдів")),
    (10**6, ("мільйон", "мільйони", "мільйонів")),
    (10**3, ("тисяча", "тисячі", "тисяч")),
]
LARGEST = 10**18
ORDINALS = {
    "нуль": "нульовий", "один": "перший", "одна": "перший", "два": "другий", "дві": "другий", "три": "третій",
    "чотири": "четвертий", "п'ять": "п'ятий", "шість": "шостий", "сім": "сьомий", "вісім": "восьмий", "дев'ять": "дев'ятий",
    "сорок": "сороковий", "дев'яносто": "дев'яностий", "сто": "сотий", "двісті": "двохсотий", "триста": "трьохсотий",
    "чотириста": "чотирьохсотий", "п'ятсот": "п'ятисотий", "шістсот": "шестисотий", "сімсот": "семисотий",
    "вісімсот": "восьмисотий", "дев'ятсот": "дев'ятисотий", "тисяча": "тисячний", "тисячі": "тисячний", "тисяч": "тисячний",
}
THOUSANDTHS = ["двох", "трьох", "чотирьох", "п'яти", "шести", "семи", "восьми", "дев'яти"]  # of 2000 to 9000
HARD = {
    "nom_n": "е", "nom_f": "а", "nom_pl": "і", "gen": "ого", "dat": "ому", "prep": "ому", "loc": "ому", "pl": "их", "loc_pl": "их",
    "acc_f": "у", "gen_f": "ої", "ins": "им", "ins_f": "ою", "ins_pl": "ими", "loc_f": "ій",
}
SOFT = {
    "nom_n": "є", "nom_f": "я", "gen": "ього", "dat": "ьому", "prep": "ьому", "loc": "ьому", "pl": "іх", "loc_pl": "іх",
    "acc_f": "ю", "gen_f": "ьої", "ins": "ім", "ins_f": "ьою", "ins_pl": "іми",
}
CASES = ["gen", "dat", "instr", "prep"]
CASE_FORMS = {
    "нуль": ("нуля", "нулю", "нулем", "нулі"),
    "один": ("одного", "одному", "одним", "одному"),
    "одна": ("однієї", "одній", "однією", "одній"),
    "два": ("двох", "двом", "двома", "двох"),
    "дві": ("двох", "двом", "двома", "двох"),
    "три": ("трьох", "трьом", "трьома", "трьох"),
    "чотири": ("чотирьох", "чотирьом", "чотирма", "чотирьох"),
    "п'ять": ("п'яти", "п'яти", "п'ятьма", "п'яти"),
    "шість": ("шести", "шести", "шістьма", "шести"),
    "сім": ("семи", "семи", "сьома", "семи"),
    "вісім": ("восьми", "восьми", "вісьмома", "восьми"),
    "дев'ять": ("дев'яти", "дев'яти", "дев'ятьма", "дев'яти"),
    "сорок": ("сорока",) * 4,
    "дев'яносто": ("дев'яноста",) * 4,
    "сто": ("ста",) * 4,
    "двісті": ("двохсот", "двомстам", "двомастами", "двохстах"),
    "триста": ("трьохсот", "трьомстам", "трьомастами", "трьохстах"),
    "чотириста": ("чотирьохсот", "чотирьомстам", "чотирмастами", "чотирьохстах"),
    "п'ятсот": ("п'ятисот", "п'ятистам", "п'ятьмастами", "п'ятистах"),
    "шістсот": ("шестисот", "шестистам", "шістьмастами", "шестистах"),
    "сімсот": ("семисот", "семистам", "сьомастами", "семистах"),
    "вісімсот": ("восьмисот", "восьмистам", "вісьмомастами", "восьмистах"),
    "дев'ятсот": ("дев'ятисот", "дев'ятистам", "дев'ятьмастами", "дев'ятистах"),
    "тисяча": ("тисячі", "тисячі", "тисячею", "тисячі"),
}
DECIMAL_PLACES = ["десята", "сота", "тисячна", "десятитисячна", "стотисячна", "мільйонна"]


def regular_forms() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """Ordinals and case forms that follow from a rule: numbers in -дцять and -десят, and plural scales."""
    ordinals, cases = dict(ORDINALS), dict(CASE_FORMS)
    for word in [w for w in [*TEENS, *TENS] if w.endswith(("дцять", "десят", "десять"))]:
        stem = word.removesuffix("ь")
        ordinals.setdefault(word, stem + "ий")
        cases.setdefault(word, (stem + "и", stem + "и", stem + "ьма", stem + "и"))
    for word in ("тисячі", "тисяч"):
        cases[word] = ("тисяч", "тисячам", "тисячами", "тисячах")
    for stem in ("мільйон", "мільярд"):
        cases[stem] = (stem + "а", stem + "у", stem + "ом", stem + "і")
        for word in (stem + "и", stem + "ів"):
            cases[word] = (stem + "ів", stem + "ам", stem + "ами", stem + "ах")
    return ordinals, cases


ORDINAL_OF, CASES_OF = regular_forms()


def whole(n: Column, by: int) -> Column:
    """Integer division of a long, exact beyond 2**53."""
    return F.call_function("div", n, F.lit(by).cast("long"))


def plural_index(n: Column) -> Column:
    """0 for one, 1 for few, 2 for many."""
    ones, tens = n % 10, n % 100
    return F.when((ones == 1) & (tens != 11), 0).when(ones.between(2, 4) & ~tens.between(12, 14), 1).otherwise(2)


def plural(n: Column, forms: Sequence[str]) -> Column:
    return F.get(words(forms), plural_index(n))


def triad_words(feminine: bool = False, change: Mapping[str, str] | None = None) -> list[str]:
    """Numbers below 1000 in words, by rule; nothing for 0. change: words to put for words."""
    small = ["", *DIGITS[1:], *TEENS]
    out = [""]
    for n in range(1, 1000):
        rest = n % 100
        named = [HUNDREDS[n // 100], small[rest]] if rest < 20 else [HUNDREDS[n // 100], TENS[rest // 10], small[rest % 10]]
        named = [{"один": "одна", "два": "дві"}.get(w, w) if feminine else w for w in named if w]
        out.append(" ".join((change or {}).get(w, w) for w in named))
    return out


def cardinal(n: Column, change: Mapping[str, str] | None = None, last: Callable[[str], str] = lambda w: w) -> Column:
    """A number in words, each triad looked up in a constant array. change: words to put for words; last: what becomes of
    the last triad's last word. From 10**18 on digit by digit."""
    n = n.cast("long")
    masculine, thousands = words(triad_words(change=change)), words(triad_words(True, change))
    parts = []
    for value, forms in SCALES:
        count = (whole(n, value) % 1000).cast("int")
        named = [(change or {}).get(f, f) for f in forms]
        triad = F.when(count > 1, F.get(thousands, count)) if value == 1000 else F.get(masculine, count)  # one thousand is the noun alone
        parts.append(F.when(count > 0, F.concat_ws(" ", triad, plural(count, named))))
    ends = [" ".join([*w.split(" ")[:-1], last(w.split(" ")[-1])]) for w in triad_words(change=change)]
    rest = (n % 1000).cast("int")
    said = F.concat_ws(" ", *parts, F.when(rest > 0, F.get(words(ends), rest)))
    zero = last((change or {}).get(DIGITS[0], DIGITS[0]))
    return F.when(n == 0, F.lit(zero)).when(n >= F.lit(LARGEST), digit_words(n.cast("string"))).when(n > 0, said)


def digit_words(digits: Column) -> Column:
    """Each ASCII digit's word; other characters are passed over."""
    names = words(DIGITS)
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda d: F.get(names, d.cast("int"))), " ")


def number_to_words(n: Column) -> Column:
    """The cardinal, nominative masculine; from 10**18 on digit by digit."""
    return cardinal(n)


def number_to_words_gender(n: Column, gender: str) -> Column:
    """gender: m, f or n; it shows in the last word."""
    change = {"m": {}, "f": {"один": "одна", "два": "дві"}, "n": {"один": "одне"}}[gender]
    return cardinal(n, last=lambda w: change.get(w, w))


def number_to_words_case(n: Column, case: str) -> Column:
    """case: gen, dat, instr or prep; words without forms stay."""
    return cardinal(n, {w: f[CASES.index(case)] for w, f in CASES_OF.items()})


def inflect_ordinal(word: Column, form: str) -> Column:
    """An ordinal in nominative masculine in another form; an unknown form leaves it."""
    if form not in HARD:
        return word
    hard = F.concat(F.regexp_replace(word, "ий$", ""), F.lit(HARD[form]))
    soft = F.concat(F.regexp_replace(word, "ій$", ""), F.lit(SOFT.get(form, HARD[form])))
    return F.when(word.endswith("ій"), soft).otherwise(hard)


def number_to_ordinal_words(n: Column, form: str = "nom_m") -> Column:
    n = n.cast("long")
    ordinals = table(ORDINAL_OF)
    prefix = F.get(words(THOUSANDTHS), (whole(n, 1000) - 2).cast("int"))

    def last_inflected(said: Column) -> Column:
        last = F.substring_index(said, " ", -1)
        ordinal = inflect_ordinal(F.coalesce(F.try_element_at(ordinals, last), last), form)
        return F.concat(F.substring(said, F.lit(1), F.length(said) - F.length(last)), ordinal)

    named = let(number_to_words(n), last_inflected)
    return F.when(n.between(2000, 9000) & (n % 1000 == 0), inflect_ordinal(F.concat(prefix, F.lit("тисячний")), form)).otherwise(named)


def decimal_to_words(whole: Column, fraction: Column) -> Column:
    """Both parts as digit strings: named up to six places, beyond them digit by digit after "кома"."""
    i, f = whole.try_cast("long"), fraction.try_cast("long")
    one = lambda n: (n % 10 == 1) & (n % 100 != 11)
    place = F.get(words(DECIMAL_PLACES), F.length(fraction) - 1)
    named = F.concat_ws(" ", number_to_words_gender(i, "f"), F.when(one(i), F.lit("ціла")).otherwise(F.lit("цілих")), F.lit("і"), number_to_words_gender(f, "f"), F.when(one(f), place).otherwise(F.regexp_replace(place, "а$", "их")))
    spelled = F.concat_ws(" ", F.when(whole == "", F.lit(DIGITS[0])).otherwise(F.coalesce(number_to_words(i), digit_words(whole))), F.lit("кома"), digit_words(fraction))
    return F.when(F.length(fraction).between(1, 6) & i.isNotNull() & f.isNotNull(), named).otherwise(spelled)


def roman_to_int(text: Column) -> Column:
    """Subtractive reading from the right; characters that are no Roman digit make it null."""
    values = F.create_map(*[x for c, v in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in (F.lit(c), F.lit(v))])
    numbers = F.transform(F.regexp_extract_all(text, F.lit("."), F.lit(0)), lambda c: F.try_element_at(values, c))

    def signed(ns: Column) -> Column:
        after = lambda i: F.get(ns, i + 1)
        return F.aggregate(F.transform(ns, lambda n, i: F.when(n < after(i), -n).otherwise(n)), F.lit(0), lambda acc, n: acc + n)

    return let(numbers, signed)
