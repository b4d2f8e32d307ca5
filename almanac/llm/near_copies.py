"""Near copies by MinHash: an inverted join on signature coordinates, confirmed on the full shingle sets.

Two texts whose sets are alike agree in most coordinates of their signatures. Every text posts its
coordinate-value pairs; two texts that agree in at least ``matches`` of ``coordinates`` share one of the
``coordinates - matches + 1`` rarest pairs of either (prefix), so only those are joined, and what stands
alone is skipped. The pairs within one posting list are not written out: all texts of a list are
compared with its most typical one, the links found are contracted, and only texts that are still apart
are compared further, block by block inside tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.llm.batches import leaving_nothing, text_slices
from almanac.llm.components import connected_components
from almanac.llm.wordhash import WORD_BYTES, Words, distinct_by_text, signatures
from almanac.operators.settle import settle
from almanac.session import ship_package

# Coordinates of a signature, and how many must agree. A pair at a similarity of exactly 0.8 agrees in fewer
# than 24 of 48 with a probability of 2e-6, and more alike pairs with far less.
COORDINATES = 48
MATCHES = 24

# Least similarity (intersection by union) in percent.
LEAST_PERCENT = 80

# Texts of one side of a block of comparisons.
BLOCK = 2048


def near_copies(
    docs: DataFrame, words: int = 2, least_percent: int = LEAST_PERCENT, coordinates: int = COORDINATES,
    matches: int = MATCHES, text: str = "text", key: str = "doc_id", block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``n_links``.

    Shingles are runs of ``words`` words, A-Z in lower case; a text with fewer words has its whole
    sequence as one. Texts link when ``100 * intersection >= least_percent * union``; texts with equal
    sets are one class. ``component_id`` is the smallest id reachable, ``kept`` whether it is the
    row's own, ``n_links`` how many links to other classes were confirmed for the row's class (enough
    to connect them, not all). A null text, or one without words, links with nothing. A row without an
    id links with nothing, has no component and is kept. Repeated rows are kept or dropped alike.
    Other input columns take no part.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    signed = settle(_signed(rows, words, coordinates))
    nodes = settle(
        signed.where("node is not null and doc_id is not null").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
        )
    )
    members = _members(nodes, coordinates, matches)
    sides = nodes.select("node", "n", "signature")
    starred = members.where("node <> hub").join(sides, "node").join(_as_hub(sides), "hub").where(
        _sizes_fit("n", "n_hub", least_percent) & (_agreeing("signature", "signature_hub") >= matches)
    )
    starred = settle(starred.select("node", "n", "hub", "n_hub"))
    links = _confirmed(starred, rows, nodes, words, least_percent)
    components = connected_components(links)

    more = _links_between(members, components, nodes, rows, words, least_percent, matches, block)
    joined = connected_components(links.unionByName(more)) if not more.isEmpty() else components
    component = nodes.join(joined, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    smallest = component.groupBy("root").agg(F.min("least").alias("component_id"))
    found = links.unionByName(more)
    degree = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).groupBy("node").agg(
        F.count("*").alias("n_links")
    )
    answer = component.join(smallest, "root").join(degree, "node", "left").select("node", "component_id", "n_links")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(
        answer, "node", "left"
    )
    component_id = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component_id.alias("component_id"),
        F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _as_hub(df: DataFrame) -> DataFrame:
    """``df`` with ``node`` called ``hub`` and all other columns marked as the hub's."""
    return df.withColumnsRenamed({c: "hub" if c == "node" else f"{c}_hub" for c in df.columns})


def _sizes_fit(a: str, b: str, least_percent: int) -> Column:
    return 100 * F.least(a, b) >= least_percent * F.greatest(a, b)


def _agreeing(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _set_id(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signed(rows: DataFrame, words: int, coordinates: int) -> DataFrame:
    """Per row its id, the size and 128-bit name of its set, and its signature."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, size=WORD_BYTES):
            hashes, bounds = Words(texts).shingles(words)
            sets = distinct_by_text(hashes, bounds)
            rows_of = signatures(hashes, bounds, coordinates).view(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([_set_id(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(np.arange(len(sets) + 1) * coordinates, pa.array(rows_of.ravel())),
            ], names=["doc_id", "node", "n_shingles", "signature"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(leaving_nothing(sign), f"doc_id {kind}, node binary, n_shingles long, signature array<int>")


def _members(nodes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """The posting lists of rare pairs: ``hub``, the most typical text of a list, and every text of its lists.

    A text is the more typical the more postings its pairs have in all.
    """
    postings = nodes.select("node", F.posexplode("signature").alias("c", "v")).select(
        "node", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long") + (1 << 31)).alias("item")
    )
    shared = postings.groupBy("item").agg(F.count("*").alias("size")).where("size > 1")
    # Pairs that stand alone come first in the order of rarity: they use up the prefix and join nothing.
    prefixes = postings.join(shared, "item").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("size", "item"))).alias("items"), F.sum("size").alias("typical")
    ).where(F.size("items") >= matches)
    lists = settle(prefixes.select(
        "node", "typical", F.explode(F.slice("items", 1, F.size("items") - matches + 1)["item"]).alias("item")
    ))
    hubs = lists.groupBy("item").agg(
        F.max(F.struct("typical", "node"))["node"].alias("hub"), F.count("*").alias("size")
    ).where("size > 1")
    return settle(lists.join(hubs, "item").select("hub", "node").distinct())


def _sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The full shingle set of each node in ``wanted``, from the text of one of its rows."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, size=WORD_BYTES):
            sets = distinct_by_text(*Words(texts).shingles(words))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([_set_id(s) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.array(flat)),
            ], names=["node", "set"])

    ids = nodes.join(wanted, "node", "left_semi").select(F.col("least").alias("doc_id"))
    made = rows.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(
        leaving_nothing(make), "node binary, set array<long>"
    )
    # Rows may repeat an id with another text.
    return settle(made.dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, least_percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough, as edges."""
    wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    sets = _sets(rows, nodes, wanted, words)
    both = pairs.join(sets, "node").join(_as_hub(sets), "hub")
    common = F.size(F.array_intersect("set", "set_hub"))
    return settle(both.where(100 * common >= least_percent * (F.col("n") + F.col("n_hub") - common)).select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    ).distinct())


def _links_between(
    members: DataFrame, components: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, least_percent: int,
    matches: int, block: int,
) -> DataFrame:
    """Links between texts that share a list but are not yet connected; enough of them to connect all that link.

    A hub's texts are cut into blocks of a fixed size, and each pair of blocks is one task's work.
    First signatures say which texts can link at all; then full sets decide.
    """
    placed = members.join(components, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("root"))
    # With two texts the list's only pair has been judged already.
    open_hubs = placed.groupBy("hub").agg(
        F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")
    ).where("size > 2 and lo <> hi").select("hub", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = placed.join(open_hubs, "hub").withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select("hub", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "root")
    cell = ["hub", "i", "j"]
    able = settle(
        cells.join(nodes.select("node", "n", "signature"), "node").groupBy(*cell)
        .applyInPandas(_able(matches, least_percent), "hub binary, i int, j int, node binary, root binary")
    )
    sets = _sets(rows, nodes, able.select("node").distinct(), words)
    return settle(
        able.join(sets, "node").groupBy(*cell).applyInPandas(_linking(least_percent), "a binary, b binary").distinct()
    )


def _able(matches: int, least_percent: int):
    def find(df: pd.DataFrame) -> pd.DataFrame:
        signature = np.stack(df["signature"].to_numpy()).astype(np.int32)
        n = df["n"].to_numpy()
        root = np.unique(df["root"].to_numpy(), return_inverse=True)[1]
        keep = np.zeros(len(df), dtype=bool)
        # Texts outside the largest component against all: two texts of that one never need each other.
        apart = np.flatnonzero(root != np.bincount(root).argmax())
        for x in apart:
            able = (root != root[x]) & (100 * np.minimum(n, n[x]) >= least_percent * np.maximum(n, n[x]))
            other = np.flatnonzero(able)
            other = other[(signature[other] == signature[x]).sum(axis=1) >= matches]
            keep[other] = True
            keep[x] |= len(other) > 0
        return df.loc[keep, ["hub", "i", "j", "node", "root"]]

    return find


def _linking(least_percent: int):
    def find(df: pd.DataFrame) -> pd.DataFrame:
        sets = df["set"].to_list()
        n = np.array([len(s) for s in sets])
        root = np.unique(df["root"].to_numpy(), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(sets)), n)
        shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
        order = np.argsort(shingle, kind="stable")
        holders, bounds = owner[order], np.concatenate(([0], np.cumsum(np.bincount(shingle))))
        mine = np.split(shingle, np.cumsum(n)[:-1])
        links = []
        for x in np.flatnonzero(root != np.bincount(root).argmax()):
            common = np.bincount(
                np.concatenate([holders[bounds[s]:bounds[s + 1]] for s in mine[x]]), minlength=len(sets)
            )
            fit = 100 * common >= least_percent * (n + n[x] - common)
            for y in np.flatnonzero(fit & (root != root[x])):
                if root[x] != root[y]:
                    links.append((x, y))
                    root[root == root[y]] = root[x]
        node = df["node"].to_numpy()
        pairs = [sorted((node[x], node[y])) for x, y in links]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype=object)

    return find


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies over all documents, by runs of two words."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_links")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id
), e AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), sym AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)"""
