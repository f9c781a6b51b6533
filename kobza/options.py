"""Options of normalization and their presets."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# Choices of each style, and what presets change.
STYLES = {
    "quote_style": ("keep", "guillemets", "straight", "strip"),
    "range_style": ("compact", "from_to"),
    "phone_style": ("grouped", "digit_by_digit"),
    "symbol_style": ("expand", "preserve"),
    "date_style": ("formal", "spoken"),
    "colon_style": ("contextual", "clock", "ratio"),
    "numeric_date_order": ("day_month_year", "month_day_year", "preserve_ambiguous"),
    "currency_symbol_policy": ("assume_common", "preserve_ambiguous"),
}
PRESETS = {
    "default": {},
    "tts_friendly": {"range_style": "from_to", "phone_style": "digit_by_digit", "date_style": "spoken", "quote_style": "strip"},
    "conservative": {"repair_homoglyphs": False, "expand_known_acronyms": False, "spell_unknown_acronyms": False, "normalize_english_words": False, "transliterate_latin": False, "symbol_style": "preserve"},
    "search_indexing": {"quote_style": "straight", "spell_unknown_acronyms": False, "normalize_english_words": False, "transliterate_latin": False, "symbol_style": "preserve"},
}


@dataclass(frozen=True)
class NormalizeOptions:
    """A value: what a query was given stays as it was, and it pickles to executors."""

    repair_homoglyphs: bool = True
    expand_known_acronyms: bool = True
    spell_unknown_acronyms: bool = True
    normalize_english_words: bool = True
    transliterate_latin: bool = True
    normalize_ip_addresses: bool = True
    validate_dates: bool = True
    normalize_typography: bool = True
    quote_style: str = "keep"
    range_style: str = "compact"
    phone_style: str = "grouped"
    symbol_style: str = "expand"
    date_style: str = "formal"
    colon_style: str = "contextual"
    numeric_date_order: str = "day_month_year"
    currency_symbol_policy: str = "assume_common"
    vocabulary: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in STYLES:
                if value not in STYLES[f.name]:
                    raise TypeError(f"{f.name} must be one of {', '.join(STYLES[f.name])}")
            elif f.name == "vocabulary":
                if not isinstance(value, dict):
                    raise TypeError("vocabulary must be a dict")
            elif not isinstance(value, bool):
                raise TypeError(f"{f.name} must be a bool")

    @classmethod
    def preset(cls, name: str, **overrides) -> NormalizeOptions:
        name = {"tts": "tts_friendly", "search": "search_indexing"}.get(name, name)
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name!r}")
        return replace(cls(**PRESETS[name]), **overrides)


def chosen_options(options: NormalizeOptions | dict | None = None, preset: str | None = None, vocabulary: dict[str, str] | None = None) -> NormalizeOptions:
    """What a call asks for: options or a preset, not both; a dict in place of options is a vocabulary; a vocabulary is
    merged over a copy of the options' own."""
    if isinstance(options, dict):
        if vocabulary is not None:
            raise TypeError("a vocabulary was given twice")
        options, vocabulary = None, options
    if options is not None and preset is not None:
        raise TypeError("either options or a preset")
    found = options if options is not None else NormalizeOptions.preset(preset or "default")
    return replace(found, vocabulary=found.vocabulary | {k.lower(): v for k, v in (vocabulary or {}).items()})
