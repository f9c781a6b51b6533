"""Segmentation examples: texts and the tokens or sentences that they have."""

import pytest

from kobza.operators.segment import sentences, tokens

TOKENS = {
    "П'ять зв’язків і мʼясо.": "П'ять|зв’язків|і|мʼясо|.",
    "ІМ`Я зобов`язати.": "ІМ`Я|зобов`язати|.",
    "Науково-технічний звіт: 12,5 грн (50/64 см).": "Науково-технічний|звіт|:|12,5|грн|(|50/64|см|)|.",
    "Пишіть на test.user@example.com або @rada, тег #Київ: https://example.com/news?id=1.": "Пишіть|на|test.user@example.com|або|@rada|,|тег|#Київ|:|https://example.com/news?id=1|.",
    "№-81 і №123/2026-р.": "№-81|і|№123/2026-р|.",
    "1991р. 78к. 50крб.": "1991р|.|78к|.|50крб|.",
}
SENTENCES = {
    "Привіт! Це тест.": "Привіт!|Це тест.",
    "м. Київ, вул. Хрещатик, 1. Зустріч о 10:30.": "м. Київ, вул. Хрещатик, 1.|Зустріч о 10:30.",
    "Шевченківський р-н. Київ, каб. 12. Д-р. Петренко приймає о 15:00.": "Шевченківський р-н. Київ, каб. 12.|Д-р. Петренко приймає о 15:00.",
    'Президент заявив: "Ми готові". Після цього відбулася зустріч.': 'Президент заявив: "Ми готові".|Після цього відбулася зустріч.',
    "": "",
    " \n ": "",
}


@pytest.mark.parametrize("text", TOKENS)
def test_tokens(text):
    found = tokens(text)
    assert "|".join(t for _, _, t in found) == TOKENS[text]
    assert all(text[a:b] == t for a, b, t in found)


@pytest.mark.parametrize("text", SENTENCES)
def test_sentences(text):
    found = sentences(text)
    assert "|".join(t for _, _, t in found) == SENTENCES[text]
    assert all(text[a:b] == t for a, b, t in found)
