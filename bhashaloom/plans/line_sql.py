"""The queries on lines in DuckDB's SQL."""

from __future__ import annotations

import unicodedata

from bhashaloom.config import EXTRA_SCRIPT_RANGES, FILE_LANGUAGES, REPLACEMENTS, SCRIPT_RANGES

SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LETTER = r"\p{L}\x{0C5D}\x{0CDD}"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def full(x: str) -> str:
    return f"({x} IS NOT NULL AND regexp_matches({x}, '[^{SPACE}]'))"


def pieces(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{SPACE}]+'), lambda w: w <> '')"


def cleaned(x: str) -> str:
    spaced = strip(rf"regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '[\t\n\r]+', ' ', 'g'), ' +', ' ', 'g')")
    return rf"regexp_replace({spaced}, '[\x00-\x08\x{{0B}}-\x{{1F}}]', '', 'g')"


def by_lang(cases: dict[str, str], otherwise: str) -> str:
    return "CASE lang " + " ".join(f"WHEN {literal(k)} THEN {v}" for k, v in cases.items()) + f" ELSE {otherwise} END"


def replaced(x: str) -> str:
    cases = {}
    for lang, table in REPLACEMENTS.items():
        done = x
        for source, target in table.items():
            done = f"replace({done}, {literal(source)}, {literal(target)})"
        cases[lang] = done
    return by_lang(cases, x)


def _compatibility() -> dict[str, str]:
    """What form KC makes of each single character that form C leaves, by Python's tables."""
    points = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c <= 0xDFFF and not 0xAC00 <= c <= 0xD7A3]
    return {c: k for c in points if (k := unicodedata.normalize("NFKC", c)) != unicodedata.normalize("NFC", c)}


def alpha(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[{LETTER}]'))"


def own(x: str, ranges: dict[str, tuple[int, int]]) -> str:
    letters = f"regexp_replace({x}, '[^{LETTER}]', '', 'g')"
    return by_lang({k: rf"len(regexp_extract_all({letters}, '[\x{{{lo:X}}}-\x{{{hi:X}}}]'))" for k, (lo, hi) in ranges.items()}, "NULL")


def repetitive(x: str) -> str:
    same = " AND ".join(f"l[i] = l[i + {n}]" for n in range(1, 6))
    return f"(SELECT len(list_filter(range(1, len(l) - 4), lambda i: {same})) > 0 FROM (SELECT string_split({x}, '') AS l))"


def quality(x: str) -> str:
    return f"(length({x}) >= 5 AND NOT {repetitive(x)} AND {alpha(x)} / greatest(length({x}), 1) >= 0.5)"


def in_script(x: str, ranges: dict[str, tuple[int, int]]) -> str:
    return f"coalesce({alpha(x)} = 0 OR {own(x, ranges)} / {alpha(x)} > 0.6, true)"


FILE_LANG = "CASE file_name " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in FILE_LANGUAGES.items()) + r" ELSE regexp_replace(file_name, '\.[^.]*$', '') END"
_RANGES = SCRIPT_RANGES | EXTRA_SCRIPT_RANGES
RAW = f"raw AS (SELECT line_id, file_name, line_no, line, {FILE_LANG} AS lang FROM raw_lines)"
_RAW_FULL = f"{RAW}, lines AS (SELECT * FROM raw WHERE {full('line')})"


def _compat_map() -> str:
    table = _compatibility()
    return "MAP([" + ",".join(map(literal, table)) + "],[" + ",".join(map(literal, table.values())) + "])"


def _nfkc_cte(source: str, column: str, target: str) -> str:
    """CTEs that add form KC of a column: characters that change one by one, then form C."""
    return f"""compat AS (SELECT {_compat_map()} AS m),
{target} AS (SELECT s.*, nfc_normalize(CASE WHEN regexp_matches({column}, '[^\\x00-\\x7F]')
  THEN array_to_string(list_transform(string_split({column}, ''), lambda c: coalesce(m[c], c)), '') ELSE {column} END) AS kc FROM {source} s, compat)"""


_PIPELINE = f"""WITH {RAW},
a AS (SELECT line_id, lang, strlen(line) AS n_bytes, CASE WHEN {full('line')} THEN {cleaned('line')} ELSE '' END AS c0 FROM raw),
{_nfkc_cte('a', 'c0', 'b')},
c AS (SELECT line_id, lang, n_bytes, {replaced('kc')} AS c FROM b),
d AS (SELECT line_id, lang, n_bytes, CASE WHEN {quality('c')} AND {in_script('c', _RANGES)} THEN {strip('c')} ELSE '' END AS text FROM c)"""

_TOTALS = f"""WITH lines AS (SELECT lang, line_id, line, CASE WHEN {full('line')} THEN line END AS t FROM prepared_lines),
words AS (SELECT lang, unnest({pieces('t')}) AS w FROM lines WHERE t IS NOT NULL),
sents AS (SELECT lang, len({pieces('s')}) AS n FROM (SELECT lang, unnest(list_filter(list_transform(string_split_regex(t, '[।.!?]+'), lambda s: {strip('s')}), lambda s: s <> '')) AS s FROM lines WHERE t IS NOT NULL)),
chars AS (SELECT lang, unnest(string_split(t, '')) AS c FROM lines WHERE t IS NOT NULL)
SELECT l.lang, l.line_count, coalesce(w.n, 0) AS word_count, coalesce(l.n_chars, 0)::BIGINT AS char_count, coalesce(w.v, 0) AS vocab_size, coalesce(c.u + 1, 0) AS unique_chars,
  round(coalesce(w.len / w.n, 0), 6) AS avg_word_length, round(coalesce(s.words / s.n, 0), 6) AS avg_sentence_length
FROM (SELECT lang, count(*) AS line_count, sum(length(t) + 1) AS n_chars FROM lines GROUP BY lang) l
LEFT JOIN (SELECT lang, count(*) AS n, count(DISTINCT w) AS v, sum(length(w)) AS len FROM words GROUP BY lang) w ON l.lang = w.lang
LEFT JOIN (SELECT lang, count(*) AS n, sum(n) AS words FROM sents GROUP BY lang) s ON l.lang = s.lang
LEFT JOIN (SELECT lang, count(DISTINCT c) AS u FROM chars WHERE c <> '' GROUP BY lang) c ON l.lang = c.lang"""

_CHARS = f"""WITH lines AS (SELECT lang, line_id, line FROM prepared_lines WHERE {full('line')}),
chars AS (SELECT lang, line_id, unnest(list_append(string_split(line, ''), chr(10))) AS ch, unnest(range(0, length(line) + 1)) AS pos FROM lines),
freq AS (SELECT lang, ch, count(*) AS cnt, min(line_id * 1000000 + pos) AS first FROM chars GROUP BY lang, ch)"""

SQL = {
    "clean_lines": f"WITH {_RAW_FULL} SELECT line_id, {strip(cleaned('line'))} AS cleaned FROM lines",
    "nfkc_lines": f"WITH {_RAW_FULL}, {_nfkc_cte('lines', 'line', 'b')} SELECT line_id, kc AS normal FROM b",
    "normalize_script": f"WITH {_RAW_FULL} SELECT line_id, {replaced('line')} AS normal FROM lines",
    "quality_filter": f"WITH {_RAW_FULL} SELECT line_id, length(line) AS n_chars, {alpha('line')} AS n_alpha, {repetitive('line')} AS repetitive, {quality('line')} AS kept FROM lines",
    "script_filter": f"WITH {_RAW_FULL} SELECT line_id, lang, {own('line', _RANGES)} AS n_script, {in_script('line', _RANGES)} AS kept FROM lines",
    "script_filter_unknown_lang": f"WITH {_RAW_FULL} SELECT lang, count(*) AS n_kept FROM lines WHERE {in_script('line', SCRIPT_RANGES)} GROUP BY lang",
    "preprocess_pipeline": f"{_PIPELINE} SELECT lang, min(line_id) AS line_id, text FROM d WHERE text <> '' GROUP BY lang, text",
    "preprocess_counters": f"{_PIPELINE} SELECT lang, count(*) AS n_read, count(DISTINCT text) FILTER (WHERE text <> '') AS n_kept, count(*) - count(DISTINCT text) FILTER (WHERE text <> '') AS n_skipped FROM d GROUP BY lang",
    "retention_estimate": f"""{_PIPELINE} SELECT lang, count(*) AS n_sampled, coalesce(sum(n_bytes), 0)::BIGINT AS n_bytes, count(*) FILTER (WHERE text <> '') AS n_kept, round(avg((text <> '')::INTEGER), 6) AS share
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || line_id), line_id) AS r FROM d) WHERE r <= 1000 GROUP BY lang""",
    "dedup_lines": f"WITH {_RAW_FULL} SELECT lang, min(line_id) AS line_id, md5(text) AS digest FROM (SELECT lang, line_id, {strip('line')} AS text FROM lines) GROUP BY lang, text",
    "corpus_stats": _TOTALS,
    "char_freq": f"{_CHARS} SELECT lang, ch, cnt FROM freq",
    "top_chars": f"{_CHARS} SELECT lang, place, ch, cnt FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first) AS place FROM freq) WHERE place <= 20",
    "sentences": f"""SELECT doc_id, unnest(range(0, len(s))) AS nth, unnest(s) AS sentence FROM (SELECT doc_id,
  list_filter(list_transform(string_split_regex(text, '[।.!?]+'), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)""",
    "line_counts": f"WITH {RAW} SELECT file_name, lang, count(*) AS n_lines, count(*) FILTER (WHERE {full('line')}) AS n_full FROM raw GROUP BY file_name, lang",
    "sample_k_lines": f"WITH {_RAW_FULL} SELECT lang, line_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || line_id), line_id) AS r FROM lines) WHERE r <= 1000",
    "sample_proportional": f"""WITH quotas AS (SELECT lang, floor(declared_lines / sum(declared_lines) OVER () * 2000) AS quota FROM languages WHERE declared_lines IS NOT NULL)
SELECT p.lang, line_id, position, {strip('line')} AS text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || line_id), line_id) AS position
FROM prepared_lines WHERE {full('line')}) p JOIN quotas q ON p.lang = q.lang WHERE position <= quota""",
    "head_sample": f"""WITH {RAW}, head AS (SELECT *, {strip('line')} AS t FROM raw WHERE line_no <= 100 AND {full('line')})
SELECT file_name, line_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY md5('42:' || line_id), line_id) AS r FROM head) WHERE r <= 10""",
    "train_test_split": """SELECT line_id, lang, CASE WHEN r <= floor(n * 0.05::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM (SELECT *,
  row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || line_id), line_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM prepared_lines)""",
}
