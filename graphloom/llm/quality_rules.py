"""Quality rules, line first: failing lines go, then documents that lose too much text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

#: What a word is, the symbol characters, and phrases of boilerplate lines (lower case).
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = [
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "this site uses cookies",
    "we use cookies",
    "accept all cookies",
    "click here",
    "read more",
    "sign up for our",
    "subscribe to our",
    "skip to content",
    "skip to main content",
    "enable javascript",
    "lorem ipsum",
    "alle rechte vorbehalten",
    "cookies verwenden",
    "verwendet cookies",
    "datenschutzerklärung",
    "weiterlesen",
    "mehr erfahren",
    "zum inhalt springen",
    "todos los derechos reservados",
    "política de privacidad",
    "utiliza cookies",
    "usa cookies",
    "leer más",
    "haga clic aquí",
    "saltar al contenido",
    "tous droits réservés",
    "politique de confidentialité",
    "utilise des cookies",
    "en savoir plus",
    "lire la suite",
    "cliquez ici",
    "aller au contenu",
]
#: A phrase fails a line of at most so many words; in a longer one it is part of a text.
PHRASE_WORDS = 30
#: Lines under so many words without an end mark, so many of them in a row, are a menu.
MENU_WORDS, MENU_LINES = 7, 4
#: Characters that stand between the entries of a navigation line.
BARS = "|»›·•→"
#: Characters that may end a sentence or a line of one.
ENDINGS = ".!?:;\"')]"
_word = re.compile(WORD)
_bar = re.compile("[" + re.escape(BARS) + "]")
_symbol = re.compile("[" + re.escape(SYMBOLS) + "]")
_phrase = re.compile("|".join(re.escape(x) for x in BOILERPLATE))
_low = {i: i + 32 for i in range(65, 91)}


def failed_rule(line: str, words: list[str]) -> str | None:
    """The first rule that a line with words fails, or None."""
    n = len(words)
    bars = len(_bar.findall(line))
    if bars >= 2 and 3 * bars >= n:
        return "navigation"
    if 2 * (len(_symbol.findall(line)) - line.count("|")) >= n:
        return "symbols"
    if n >= 3 and 2 * line.count("!!") >= n:
        return "shouting"
    if n < 5 and words[-1][-1] not in ENDINGS:
        return "punctuation"
    if n >= 10 and 2 * sum(a == b for a, b in zip(words, words[1:], strict=False)) >= n:
        return "repetition"
    if n <= PHRASE_WORDS and _phrase.search(line.translate(_low)):
        return "boilerplate"
    return None


def menu_lines(lines: list[tuple[str, list[str]]]) -> set[int]:
    """The places of lines (text, words) in runs of MENU_LINES or more short lines without an end mark."""
    found, run = set(), []
    for at, (_, words) in enumerate(lines):
        if len(words) < MENU_WORDS and words[-1][-1] not in ENDINGS:
            run.append(at)
            continue
        if len(run) >= MENU_LINES:
            found.update(run)
        run = []
    return found | set(run) if len(run) >= MENU_LINES else found


def repeated_words(words: list[str], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total = reach = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + size - max(i, reach)
            reach = i + size
    return total


def clean(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept text)."""
    text = text or ""
    words = _word.findall(text)
    chars, kept_chars, dup = sum(map(len, words)), 0, 0
    seen, kept = set(), []
    lines = [(line, _word.findall(line)) for line in text.split("\n")]
    written = [x for x in lines if x[1]]
    menu, at = menu_lines(written), -1
    for line, own in lines:
        if not own:
            kept.append(line)
            continue
        at += 1
        dup += line in seen
        seen.add(line)
        if at not in menu and failed_rule(line, own) is None:
            kept.append(line)
            kept_chars += sum(map(len, own))
    repeat = repeated_words(words)
    base = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), chars, len(_symbol.findall(text)), dup, repeat, base, not base and 2 * kept_chars >= chars, "\n".join(kept)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text) per row.

    Lines fail on navigation (separators between entries), menus (runs of short lines without end marks), symbols,
    shouting, a missing end of a very short line, repetition in the line and boilerplate phrases in a line that is not
    long. ``clean_text`` has the other lines. A document is kept if it passes the base rules (50
    words, at most half of the words in repeated 3-word windows) and its lines keep half of its word characters.
    A null or empty text has no words and is not kept. The columns named in ``carry`` follow; others are not read.
    Repeated rows come out repeatedly.
    """
    small_batches(docs.sparkSession)
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    types = [*[pa.int64()] * len(measures), pa.bool_(), pa.bool_(), pa.string()]
    names = ["_key", *measures, "base_failed", "kept", "clean_text", "_carry"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [clean(x) for x in part.column(1).to_pylist()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, part.column(2)], names=names)

    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"))
    schema = f"_key {source.schema['_key'].dataType.simpleString()}, {' long, '.join(measures)} long, base_failed boolean, kept boolean, clean_text string, _carry {source.schema['_carry'].dataType.simpleString()}"
    out = source.mapInArrow(run, schema)
    return out.select(F.col("_key").alias(key), *measures, "base_failed", "kept", "clean_text", *(F.col("_carry")[c].alias(c) for c in carry))


def _sql() -> str:
    quote = lambda x: x.replace("'", "''")
    phrases = " OR ".join(f"contains(low, '{quote(x)}')" for x in BOILERPLATE)
    space = r"[\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
line AS (SELECT r, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM (SELECT r, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT r, string_split(text, chr(10)) AS l FROM d))),
measured AS (SELECT r, pos, line, low, words, len(words) AS n, len(words) < {MENU_WORDS} AND NOT contains('{quote(ENDINGS)}', right(words[len(words)], 1)) AS weak, length(regexp_replace(line, '{space}', '', 'g')) AS chars,
  length(regexp_replace(line, '[^{BARS}]', '', 'g')) AS bars, length(regexp_replace(line, '[^|]', '', 'g')) AS pipes, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym,
  (length(line) - length(replace(line, '!!', ''))) // 2 AS shouts FROM line WHERE len(words) > 0),
runs AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY pos) - row_number() OVER (PARTITION BY r, weak ORDER BY pos) AS run FROM measured),
measure AS (SELECT *, weak AND count(*) OVER (PARTITION BY r, weak, run) >= {MENU_LINES} AS menu FROM runs),
judged AS (SELECT r, line, chars, NOT (menu OR (bars >= 2 AND 3 * bars >= n) OR 2 * (sym - pipes) >= n OR (n >= 3 AND 2 * shouts >= n)
  OR (n < 5 AND NOT contains('{quote(ENDINGS)}', right(words[n], 1)))
  OR (n >= 10 AND 2 * len(list_filter(range(1, n), lambda i: words[i] = words[i + 1])) >= n) OR (n <= {PHRASE_WORDS} AND ({phrases}))) AS ok FROM measure),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS dup, coalesce(sum(chars) FILTER (ok), 0) AS kept_chars FROM judged GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(kept_chars, 0) AS kept_chars FROM w LEFT JOIN lines USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * kept_chars >= word_chars AS kept FROM m"""


ORACLE_SQL = _sql()
