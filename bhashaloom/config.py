"""Settings and language tables of the corpus pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Language by file name of the collected corpus.
FILE_LANGUAGES = {
    "Hindi.txt": "Hindi",
    "gujrati.txt": "Gujarati",
    "kannada.txt": "Kannada",
    "marathi.txt": "Marathi",
    "malayalam.txt": "Malayalam",
    "odia.txt": "Odia",
}

#: First and last code point of each language's script.
SCRIPT_RANGES = {
    "Hindi": (0x0900, 0x097F),
    "Gujarati": (0x0A80, 0x0AFF),
    "Malayalam": (0x0D00, 0x0D7F),
    "Kannada": (0x0C80, 0x0CFF),
    "Marathi": (0x0900, 0x097F),
    "Odia": (0x0B00, 0x0B7F),
}

#: Extension beyond the six languages, for tables that hold others.
EXTRA_SCRIPT_RANGES = {"english": (0x0041, 0x024F)}

_JOINERS = {"\u200c": "", "\u200d": ""}
_DEVANAGARI = {"\u0970": "."} | _JOINERS | {chr(0x0966 + d): str(d) for d in range(10)}

#: Replacements by language, applied in this order.
REPLACEMENTS = {
    "Hindi": _DEVANAGARI,
    "Marathi": _DEVANAGARI,
    "Gujarati": {"\u0acd\u0a3e": "\u0abe"} | _JOINERS,
    "Malayalam": _JOINERS,
    "Kannada": _JOINERS,
    "Odia": _JOINERS,
}


@dataclass(frozen=True)
class Cleaning:
    """Which steps the cleaning takes."""

    deduplicate: bool = True
    clean_unicode: bool = True
    remove_low_quality: bool = True
    script_filtering: bool = True
    min_length: int = 5
    max_repeats: int = 5
    min_alpha: float = 0.5
    min_script: float = 0.6
    script_ranges: dict[str, tuple[int, int]] = field(default_factory=lambda: dict(SCRIPT_RANGES))


@dataclass(frozen=True)
class Packing:
    """How token rows become sequences."""

    sequence_length: int = 1024
    chunk_lines: int = 5000
    test_ratio: float = 0.05
    vocabulary: int = 50304
    seed: int = 42
