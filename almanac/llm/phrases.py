"""Collocations by relational mining (SETM): occurrence relations grow by one word per round.

The words of a slice of documents become a relation sorted by piece and position, written once. Each round joins
it with itself where one occurrence starts a word later in the same piece: as both sides are sorted, that is a
merge of neighbours inside the slice. The groups of a round are counted over all slices, and only
occurrences of groups that are frequent everywhere go on to the next length. All keys are whole words
(numbered by their first occurrence), so nothing rests on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from almanac.llm.batches import text_slices
from almanac.llm.wordhash import LOWER
from almanac.operators.settle import settle
from almanac.session import ship_package

# Shortest count of a phrase, longest phrase, and share (in percent) at which a longer phrase takes its place.
LEAST_COUNT = 10
MOST_WORDS = 3
COVERED_PERCENT = 50

# Phrases reported per language.
TOP = 2000

# Language of documents without one.
NO_LANGUAGE = "und"

# Bytes of text that share one slice of the relation; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 24

# A slice is numbered by its task and its place there.
_SLICES_PER_TASK = 1 << 13

# A group is numbered by its slice and its place there, below this power of two; so are two places of a slice.
_PLACE = 31

# Rows of one batch on the way out of a task.
_BATCH = 1 << 16

_WORD, _GAP, _BREAK = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = _BREAK


def word_relation(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The occurrences of all words, sorted by piece and position, one row per slice of documents.

    ``at`` holds one number per occurrence, 1 + its word's place in ``words``, and a 0 between pieces, as four planes of
    bytes. ``words``, ``langs`` (places in ``names``) and ``counts`` describe the distinct words of a language.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    return rows.mapInArrow(
        _relation, "slice long, at binary, words array<string>, langs array<int>, names array<string>, counts array<long>"
    )


def _relation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, done = TaskContext.get().partitionId(), 0
    for part, texts in text_slices(batches, size=SLICE_BYTES):
        found = _occurrences(texts, part.column(1).to_pylist())
        if found is None:
            continue
        if done == _SLICES_PER_TASK:
            raise ValueError("one task holds too many slices of text; read the documents in smaller partitions")
        columns = [pa.array([task * _SLICES_PER_TASK + done], pa.int64()), pa.array([found[0]], pa.binary())]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in found[1:]]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "at", "words", "langs", "names", "counts"])
        done += 1


def _occurrences(texts: list[str], langs: list[str]):
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = LOWER[np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)]
    kind = _KIND[raw]
    inside = kind == _WORD
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    start, end = edges[0::2], edges[1::2]  # the closing line end ends the last word
    n = len(start)
    if not n:
        return None
    piece = np.searchsorted(np.flatnonzero(kind == _BREAK), start)
    ends = np.cumsum(np.fromiter((len(e) + 1 for e in encoded), dtype=np.int64, count=len(encoded)))
    document = np.searchsorted(ends, start, side="right")

    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    words = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw[inside])).dictionary_encode()
    names = pa.array(langs, pa.string()).dictionary_encode()
    both = names.indices.to_numpy().astype(np.int64)[document] * len(words.dictionary) + words.indices.to_numpy()
    both = pa.array(both).dictionary_encode()
    at, keys = both.indices.to_numpy(), both.dictionary.to_numpy()
    counts = np.bincount(at, minlength=len(keys))
    # Frequent words come first, so that most numbers are small.
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.arange(len(keys))

    new_piece = np.concatenate(([False], piece[1:] != piece[:-1]))
    line = np.zeros(n + int(new_piece.sum()), dtype="<u4")
    line[np.arange(n) + np.cumsum(new_piece)] = place[at] + 1
    keys = keys[order]
    return (
        line.view(np.uint8).reshape(-1, 4).T.tobytes(), words.dictionary.take(pa.array(keys % len(words.dictionary))),
        pa.array((keys // len(words.dictionary)).astype(np.int32)), names.dictionary, pa.array(counts[order]),
    )


def _line(planes: bytes) -> np.ndarray:
    """Places of the words of a slice in order, -1 between pieces."""
    return np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T.copy().view("<i4").ravel() - 1


def _neighbours(now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an occurrence has another one a position later, and both places as one number."""
    at = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0))
    return at, now[at].astype(np.int64) << _PLACE | now[at + 1]


def _frequent(groups: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of the groups that have ``least`` occurrences over all slices, with ``f``, their number, and ``id``, the least ``own``.

    A slice gives one row per group, so no group has more rows than there are slices.
    """
    whole = Window.partitionBy(*keys)
    counted = groups.withColumn("f", F.sum("c").over(whole)).withColumn("id", F.min("own").over(whole))
    return counted.where(F.col("f") >= least)


def _extended(length: int):
    """Merge the relation of a slice with itself, one position apart, to groups of ``length`` words.

    The right table holds the frequent groups of the lengths before. A pair of neighbours is numbered among the
    distinct ones of its slice, so that the numbers can be found again from the relation.
    """
    taken = [f"w{i}" for i in range(1, length)]

    def extend(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        now = _line(left.column("at")[0].as_py()) if left.num_rows else np.zeros(0, dtype=np.int32)
        level = right.column("level").to_numpy()
        place = right.column("own").to_numpy() & ((1 << _PLACE) - 1)
        for at in range(2, length):
            rows = np.flatnonzero(level == at)
            rows = rows[np.argsort(place[rows])]
            here, codes = _neighbours(now)
            distinct, inverse = np.unique(codes, return_inverse=True)
            kept = np.full(len(distinct), -1, dtype=np.int32)
            kept[place[rows]] = np.arange(len(rows))
            longer = np.full(max(len(now) - 1, 0), -1, dtype=np.int32)
            longer[here] = kept[inverse]
            now = longer
        codes, counts = np.unique(_neighbours(now)[1], return_counts=True)
        first, second = codes >> _PLACE, codes & ((1 << _PLACE) - 1)
        if length == 2:  # words that are not frequent are still there
            rows = np.full(int(max(place.max(initial=0), now.max(initial=0))) + 1, -1, dtype=np.int64)
            rows[place] = np.arange(len(place))
        first, second = rows[first], rows[second]
        found = np.flatnonzero((first >= 0) & (second >= 0))
        # Shorter groups have no word in the last columns, and are not taken.
        columns = {c: pc.fill_null(right.column(c), 0).to_numpy() for c in taken}
        out = {"own": (int(key[0].as_py()) << _PLACE) + found, **{c: columns[c][first[found]] for c in taken}}
        out |= {f"w{length}": columns[taken[-1]][second[found]], "c": counts[found].astype(np.int64)}
        return pa.Table.from_batches(pa.table(out).to_batches(max_chunksize=_BATCH), pa.table(out).schema)

    return extend


def frequent_phrases(
    docs: DataFrame, most_words: int = MOST_WORDS, least_count: int = LEAST_COUNT, text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, list[DataFrame]]:
    """All words per language (``lang``, ``n``), and per length the frequent phrases.

    The first table of the list has ``w1`` (a number for a word of a language), ``lang``, ``word`` and ``f``; those of more words
    ``w1``, ``w2``, ... and ``f``.
    """
    relation = settle(word_relation(docs, text, lang), "zstd")
    words = relation.select("slice", "names", F.posexplode(F.arrays_zip("words", "langs", "counts")).alias("place", "g")).select(
        (F.shiftleft("slice", _PLACE) + F.col("place")).alias("own"), F.get("names", F.col("g.langs")).alias("lang"),
        F.col("g.words").alias("word"), F.col("g.counts").alias("c"),
    )
    sizes = settle(words.groupBy("lang").agg(F.sum("c").alias("n")))
    seen = _frequent(words, ["lang", "word"], least_count)
    first = F.col("own") == F.col("id")
    # What tells a word, once; a word is known by the number of its first row.
    seen = settle(seen.select("own", F.col("id").alias("w1"), *[F.when(first, F.col(c)).alias(c) for c in ("f", "lang", "word")]), "zstd")
    found = [seen.where("word is not null").select("w1", "lang", "word", "f")]
    before = [seen.select(F.lit(1).alias("level"), "own", "w1")]
    slice_ = F.shiftright("own", _PLACE).alias("slice")
    for length in range(2, most_words + 1):
        names = [f"w{i}" for i in range(1, length + 1)]
        known = before if length == 2 else before[1:]
        known = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), known)
        groups = relation.select("slice", "at").groupBy("slice").cogroup(known.groupBy(slice_)).applyInArrow(
            _extended(length), "own long, " + ", ".join(f"{c} long" for c in names) + ", c long"
        )
        seen = _frequent(groups, names, least_count)
        seen = settle(seen.select("own", *names, F.when(F.col("own") == F.col("id"), F.col("f")).alias("f")), "zstd")
        found.append(seen.where("f is not null").select(*names, "f"))
        before.append(seen.select(F.lit(length).alias("level"), "own", *names))
    return sizes, found


def _not_covered(found: list[DataFrame], length: int, percent: int) -> DataFrame:
    """The phrases of one length with ``a``, without those that a longer one holds and that occur mostly there."""
    names = [f"w{i}" for i in range(1, length + 1)]
    out = found[length - 1].select(*names, F.col("f").alias("a"))
    inside = [
        found[longer - 1].select(*[F.col(f"w{i + start}").alias(name) for i, name in enumerate(names, 1)], "f")
        for longer in range(length + 1, len(found) + 1) for start in range(longer - length + 1)
    ]
    if not inside:
        return out
    most = reduce(DataFrame.unionByName, inside).groupBy(*names).agg(F.max("f").alias("_longer"))
    out = out.join(most, names, "left")
    return out.where(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_longer")


def _scored(phrases: DataFrame, found: list[DataFrame], length: int) -> DataFrame:
    """Phrases (``w1``, ``w2``, ..., ``a``) of one length with ``lang`` and ``l``, ``r``, ``score`` of the cut that scores least."""
    names = [f"w{i}" for i in range(1, length + 1)]
    out, cuts = phrases, []
    for k in range(1, length):
        for part, side in ((names[:k], "l"), (names[k:], "r")):
            counts = found[len(part) - 1].select(
                *[F.col(f"w{i}").alias(name) for i, name in enumerate(part, 1)], F.col("f").alias(f"{side}{k}"),
                *(["lang"] if part == ["w1"] else []),
            )
            out = out.join(counts, part)
        # Whole numbers of up to 38 digits: counts up to 10^15.
        score = F.expr(f"1000000 * cast(a as decimal(18,0)) * cast(a as decimal(18,0)) div (cast(l{k} as decimal(18,0)) * cast(r{k} as decimal(18,0)))")
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    least = F.array_min(F.array(*cuts))
    return out.withColumn("_cut", least).select(
        "lang", F.array(*names).alias("ids"), "a", *[F.col(f"_cut.{c}").alias(c) for c in ("l", "r", "score")]
    )


def collocations(
    docs: DataFrame, most_words: int = MOST_WORDS, least_count: int = LEAST_COUNT, covered_percent: int = COVERED_PERCENT,
    top: int = TOP, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The best ``top`` phrases of each language: words that stand together far more often than apart.

    A-Z become lower case; texts split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. A phrase has two to
    ``most_words`` words of one piece and ``a`` occurrences, ``least_count`` or more, overlaps included. Cutting it in two gives
    the counts ``l`` and ``r`` of its parts and the score floor(10^6 a a / (l r)); the least score counts, the
    first cut of equal ones. A phrase goes when a longer one that holds it has ``covered_percent`` of its occurrences.
    Columns: ``lang``, ``rank`` (by score, ``a``, then the phrase), ``phrase``, ``a``, ``l``, ``r``, ``n`` (all words of the
    language) and ``score``. Null texts are empty, a null language is ``und``; repeated rows count each time; other columns have no part in it; no words give no rows.
    """
    sizes, found = frequent_phrases(docs, most_words, least_count, text, lang)
    lengths = range(2, most_words + 1)
    scored = reduce(DataFrame.unionByName, [_scored(_not_covered(found, n, covered_percent), found, n) for n in lengths])
    # Equal phrases of the last place stay until their words decide.
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = scored.withColumn("_place", F.rank().over(best)).where(F.col("_place") <= top).drop("_place")
    spelled = near.select("*", F.posexplode("ids").alias("at", "w1")).join(found[0].select("w1", "word"), "w1")
    spelled = spelled.groupBy(*near.columns).agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    phrase = F.array_join(F.transform("words", lambda x: x["word"]), " ")
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP13_SQL = rf"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, piece FROM (
    SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), ws AS (
  SELECT lang, p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), runs AS (
  SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (SELECT unnest([1, 2, 3]) AS k))
), f AS (
  SELECT lang, k, g, count(*)::HUGEINT AS f FROM runs GROUP BY ALL
), sizes AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.k, c.g, c.f AS a, cut, x.f AS l, y.f AS r, (1000000 * c.f * c.f) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= {LEAST_COUNT}) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1:]
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, f, unnest([g[1:2], g[2:3]]) AS part FROM f WHERE k = 3 AND f >= {LEAST_COUNT}) GROUP BY ALL
), kept AS (
  SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.part = s.g
  WHERE o.f IS NULL OR 100 * o.f < {COVERED_PERCENT} * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= {TOP}"""
