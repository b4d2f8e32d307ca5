"""Quality rules, line first: lines that fail go, then documents that lost too much of their text.

Only DataFrame functions are used, row by row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.llm.columns import SPACES, beside, let, lower_ascii, n_of

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

# Line rules. Shares are of the characters that are not white space.
NAVIGATION_MARKS = "|»›•·→"
PUNCTUATION = ".!?…,;:\"”)]"
MOST_SYMBOLS_PERCENT = 8
MOST_CAPITALS_PERCENT = 50
LEAST_CHARS_FOR_CAPITALS = 20
LEAST_CHARS_FOR_PUNCTUATION = 60
MOST_BOILERPLATE_PERCENT = 30
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings",
    "accept cookies", "accept all cookies", "enable javascript", "click here", "read more", "sign up", "log in",
    "subscribe now", "subscribe to", "skip to content", "back to top", "share this", "follow us", "lorem ipsum",
)

# A document is rejected when its failed lines hold more than this share of its word characters.
MOST_LOST_PERCENT = 50

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PUNCTUATION = "[.!?…,;:\"”)\\]]"
_WORD_GAP = "[\\x20\\x09-\\x0D]+"

# Latin letters end here; lines mostly beyond it may be in a script without full stops.
_LATIN = "[\\x00-\\x{24F}]"
_NO_OTHER_PUNCTUATION = f"[\\x00-\\x7F{NAVIGATION_MARKS}]"

# Phrases stand between ASCII characters other than letters and digits. These are doubled first, so that two phrases
# may share one.
_EDGE = "([\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F])"
_PHRASES = _EDGE + "(" + "|".join(p.replace(" ", "  ") for p in BOILERPLATE) + ")" + _EDGE


def words_of(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D.

    Splitting at single characters is several times faster than at a pattern, so the pattern only
    serves texts with other white space than spaces and line ends.
    """
    plain = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.split(line, " ")))
    other = F.split(text, _WORD_GAP)
    return F.array_remove(F.when(text.rlike("[\\x09\\x0B-\\x0D]"), other).otherwise(plain), "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words stand in a run of ``width`` words that occurs twice or more in the text.

    Runs are compared by a 64-bit hash within one text. Sorting the hashes with their places keeps
    this close to linear in the length of the text, whatever it repeats. The words are bound once:
    a filter on the result moves below the projection that makes them, and would split the text
    anew for every window.
    """
    return let(words, lambda w: _repeated(w, width))


def _repeated(words: Column, width: int) -> Column:
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - width),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]),
    )

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(placed, lambda p: F.filter(p, lambda x, i: (
            F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))
        )))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, s: F.struct(
                (acc["n"] + s + width - F.greatest(acc["end"], s)).alias("n"), (s + width).alias("end")
            ),
            lambda acc: acc["n"],
        )

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(counted).cast("long")


def _chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, ""))


def boilerplate_chars(line: Column) -> Column:
    """Characters, white space aside, of the line's boilerplate phrases; a phrase is made of whole words."""
    edged = F.concat(F.lit(" "), F.regexp_replace(lower_ascii(line), _EDGE, "$1$1"), F.lit(" "))
    return let(edged, lambda e: _chars(e) - _chars(F.regexp_replace(e, _PHRASES, "$1$3")))


def line_fails(line: Column, boilerplate: Column | None = None) -> Column:
    """The rules for one line: symbols and navigation marks, capitals, missing punctuation, boilerplate.

    Boilerplate counts by its share of the line, so that prose may hold a phrase. Punctuation of any
    script will do, and lines mostly in letters other than Latin ones need none. A pattern that most
    lines fail at once stands before each count. ``boilerplate`` may hold, once per text, whether any
    phrase occurs in it at all.
    """
    chars = _chars(line)
    phrases = 100 * boilerplate_chars(line) > MOST_BOILERPLATE_PERCENT * chars
    return (
        (line.rlike(f"[{SYMBOLS}{NAVIGATION_MARKS}]")
         & (100 * n_of(line, SYMBOLS + NAVIGATION_MARKS) > MOST_SYMBOLS_PERCENT * chars))
        | (line.rlike("[A-Z]{4}") & (chars >= LEAST_CHARS_FOR_CAPITALS)
           & (100 * n_of(line, _CAPITALS) > MOST_CAPITALS_PERCENT * chars))
        | (~line.rlike(_PUNCTUATION) & (chars >= LEAST_CHARS_FOR_PUNCTUATION)
           & (2 * F.length(F.regexp_replace(line, _LATIN, "")) <= chars)
           & ~F.regexp_replace(line, _NO_OTHER_PUNCTUATION, "").rlike("\\p{P}"))
        | (phrases if boilerplate is None else boilerplate & phrases)
    )


def quality_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts, both verdicts and the cleaned text of each document.

    Columns: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``lost_chars`` (word characters on failed lines), ``base_failed``, ``kept`` and ``clean_text``
    (the lines that pass, in order; lines without words pass). Every row gives one row: repeated
    rows and rows without an id are judged alike. A null text counts as empty, which fails the
    base rules; its ``clean_text`` is empty. Input columns named like a result give way.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n", -1)
    has_word = "[^\\x20\\x09-\\x0D]"
    full = F.filter(lines, lambda s: s.rlike(has_word))
    small = lower_ascii(whole)
    any_phrase = let(small, lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in BOILERPLATE]))
    passed = let(any_phrase, lambda p: F.filter(lines, lambda s: ~(s.rlike(has_word) & line_fails(s, p))))
    step = beside(df, {"_llm_words": words_of(whole), "clean_text": F.array_join(passed, "\n")})
    step = beside(step, {
        "n_words": F.size("_llm_words").cast("long"),
        "word_chars": F.length(F.array_join("_llm_words", "")).cast("long"),
        "n_symbols": F.when(whole.rlike(f"[{SYMBOLS}]"), n_of(whole, SYMBOLS)).otherwise(F.lit(0)).cast("long"),
        "n_dup_lines": let(full, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_llm_words")),
    })
    step = beside(step, {"lost_chars": F.col("word_chars") - _chars(F.col("clean_text"))})
    base_failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    step = beside(step, {"base_failed": base_failed})
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST_PERCENT * F.col("word_chars"))
    return beside(step, {"kept": kept}).drop("_llm_words")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_LINE_CHARS = "length(regexp_replace(s, '[\\x20\\x09-\\x0D]', '', 'g'))"


def _sql_n_of(column: str, characters: str) -> str:
    return f"(length({column}) - length(translate({column}, {_sql_text(characters)}, '')))"


_SPACE = "[\\x20\\x09-\\x0D]"
_SQL_EDGED = (
    f"(' ' || regexp_replace(translate(s, '{_CAPITALS}', '{_CAPITALS.lower()}'), '{_EDGE}', '\\1\\1', 'g') || ' ')"
)
_SQL_FAILS = f"""(100 * {_sql_n_of('s', SYMBOLS + NAVIGATION_MARKS)} > {MOST_SYMBOLS_PERCENT} * {_LINE_CHARS}
  OR (regexp_matches(s, '[A-Z]{{4}}') AND {_LINE_CHARS} >= {LEAST_CHARS_FOR_CAPITALS}
      AND 100 * {_sql_n_of('s', _CAPITALS)} > {MOST_CAPITALS_PERCENT} * {_LINE_CHARS})
  OR ({_LINE_CHARS} >= {LEAST_CHARS_FOR_PUNCTUATION} AND {_sql_n_of('s', PUNCTUATION)} = 0
      AND 2 * length(regexp_replace(s, '{_LATIN}', '', 'g')) <= {_LINE_CHARS}
      AND NOT regexp_matches(regexp_replace(s, '{_NO_OTHER_PUNCTUATION}', '', 'g'), '\\p{{P}}'))
  OR 100 * (length(regexp_replace({_SQL_EDGED}, '{_SPACE}', '', 'g')) - length(regexp_replace(
      regexp_replace({_SQL_EDGED}, '{_PHRASES}', '\\1\\3', 'g'), '{_SPACE}', '', 'g')))
    > {MOST_BOILERPLATE_PERCENT} * {_LINE_CHARS})"""

OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d
), runs AS (
  SELECT k, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT k, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM runs) WHERE c > 1
), again AS (
  SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY k
), ln AS (
  SELECT k, s FROM (SELECT k, unnest(string_split(t, chr(10))) AS s FROM d) WHERE {_LINE_CHARS} > 0
), per AS (
  SELECT k, count(*) - count(DISTINCT s) AS dup, sum(CASE WHEN {_SQL_FAILS} THEN {_LINE_CHARS} ELSE 0 END) AS lost
  FROM ln GROUP BY k
), c AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST({_sql_n_of('t', SYMBOLS)} AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN per USING (k) LEFT JOIN again USING (k)
), v AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost <= {MOST_LOST_PERCENT} * word_chars AS kept
FROM v"""
