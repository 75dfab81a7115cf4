"""Cleaning and measuring of lines as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bhashaloom.config import REPLACEMENTS
from bhashaloom.functions.unicode import LETTER, strip

#: Where sentences end: danda, full stop, exclamation and question mark.
SENTENCE_END = "[।.!?]+"


def remove_html(text: Column) -> Column:
    """Text without tags; what stands between tags stays, as does an unclosed bracket."""
    return F.when(text.contains("<"), F.regexp_replace(text, "<[^>]+>", "")).otherwise(text)


def clean_whitespace(text: Column) -> Column:
    """Runs of tabs, line ends and spaces as one space; stripped. The pattern is tried only where there is one to replace."""
    some = text.contains("  ") | text.contains("\t") | text.contains("\n") | text.contains("\r")
    return strip(F.when(some, F.regexp_replace(text, r"[\t\n\r ]{2,}|[\t\n\r]", " ")).otherwise(text))


def drop_controls(text: Column) -> Column:
    """Text without the characters below space, except tab and line feed."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", "")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _roles() -> tuple[str, str]:
    """Characters that form KC leaves as they are, if no neighbour joins them, and a sign for the part that each may play: m, a mark
    that may change places with another; f and s, the first and second of a pair that becomes one character; x, both m and s; else a space.

    They are of ASCII, the Latin and Indic blocks, punctuation, currency signs, arrows and symbols.
    """
    indic = [chr(c) for c in range(0x900, 0xE00)]
    firsts, seconds = set(), set()
    for c in indic:
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c:
            firsts.add(unicodedata.normalize("NFC", parts[:-1]))
            seconds.add(parts[-1])
    settled = [c for c in indic if unicodedata.normalize("NFKC", c) == c]
    others = [c for a, b in ((0, 0x250), (0x2000, 0x2070), (0x20A0, 0x20C1), (0x2190, 0x27C0)) for c in map(chr, range(a, b)) if unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)]
    both = firsts & (seconds | {c for c in indic if unicodedata.combining(c)})
    role = lambda c: "f" if c in firsts else ("x" if unicodedata.combining(c) else "s") if c in seconds else "m" if unicodedata.combining(c) else " "
    return "".join([*settled, *others]).translate(dict.fromkeys(map(ord, both))), "".join([*(role(c) for c in settled if c not in both), *" " * len(others)])


_SETTLED, _ROLES = _roles()


def nfkc(text: Column) -> Column:
    """Text in normalization form KC. Only text that it may change, which is little, goes to the Python worker.

    Every character is replaced by its part in it, so that one short pattern tells: one that has none, two marks, or a pair.
    """
    unsettled = F.translate(text, _SETTLED, _ROLES).rlike(r"[^\x00-\x7F]|[mx]{2}|f[sx]")
    return F.coalesce(_nfkc(F.when(unsettled, text)), text)


def normalize_script(text: Column, lang: Column, replacements: Mapping[str, Mapping[str, str]] = REPLACEMENTS) -> Column:
    """Each language's literal replacements, in their order; text of other languages as it is.

    Single characters whose replacement is not itself replaced go by one translation; longer ones come before, as listed.
    """
    out, alike = text, {}
    for name, table in replacements.items():
        alike.setdefault(tuple(table.items()), []).append(name)
    for table, names in alike.items():
        done, single = text, {}
        for source, target in table:
            if len(source) == 1 and len(target) <= 1:
                single[source] = target
            else:
                done = F.replace(done, F.lit(source), F.lit(target))
        kept = [s for s in single if single[s]] + [s for s in single if not single[s]]
        out = F.when(lang.isin(names), F.translate(done, "".join(kept), "".join(single[s] for s in kept))).otherwise(out)
    return out


def letters_of(text: Column) -> Column:
    """The letters of a text. Runs of others are taken out as a whole, which is cheaper than counting letters one by one."""
    return F.regexp_replace(text, f"[^{LETTER}]+", "")


def alpha_count(text: Column) -> Column:
    """Number of letters."""
    return F.length(letters_of(text))


def script_count(letters: Column, lang: Column, ranges: Mapping[str, tuple[int, int]]) -> Column:
    """How many of some letters are of the script of the language; null for languages without one."""
    out, alike = F.lit(None).cast("int"), {}
    for name, span in ranges.items():
        alike.setdefault(span, []).append(name)
    for (lo, hi), names in alike.items():
        out = F.when(lang.isin(names), F.length(F.regexp_replace(letters, f"[^\\x{{{lo:X}}}-\\x{{{hi:X}}}]+", ""))).otherwise(out)
    return out


def is_repetitive(text: Column, most: int = 5) -> Column:
    """True if some character stands more than ``most`` times in a row."""
    return text.rlike(rf"(?s)(.)\1{{{most},}}")


def is_quality(text: Column, letters: Column, min_length: int = 5, most_repeats: int = 5, min_alpha: float = 0.5) -> Column:
    """Long enough, not repetitive, and with a share of letters, whose number is given."""
    share = letters / F.greatest(F.length(text), F.lit(1))
    return (F.length(text) >= min_length) & ~is_repetitive(text, most_repeats) & (share >= min_alpha)


def is_target_script(letters: Column, own: Column, more_than: float = 0.6) -> Column:
    """Mostly in the language's script, given the letters and those of the script; text without letters and languages without a script pass."""
    return (letters == 0) | F.coalesce(own / letters > more_than, F.lit(True))


def sentences(text: Column) -> Column:
    """Sentences between dandas, full stops, exclamation and question marks, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def characters(text: Column) -> Column:
    """The characters of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def shortened(text: Column, most: int = 100) -> Column:
    """Text, or its first characters and an ellipsis if it is longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def language_of_file(name: Column, known: Mapping[str, str]) -> Column:
    """The language of a file by its name; for other files the name without its ending."""
    out = F.regexp_replace(name, r"\.[^.]*$", "")
    for file, lang in known.items():
        out = F.when(name == file, F.lit(lang)).otherwise(out)
    return out
