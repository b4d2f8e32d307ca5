"""Secret scans: plain patterns, and weak candidates that only count beside the other parts of a credential.

Only DataFrame functions are used, row by row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.llm.columns import beside, let, match_spans

# Fixed values of the base rules, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "linked")
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGNED = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"

# Parts of a credential. A weak secret alone is no finding.
IDENTIFIER = (
    "AKIA[A-Z0-9]{12,}|(?i:\\b(?:client|account|access|application|app|tenant|user|login)[ _-]?(?:id|name|key[ _-]?id)?"
    "[\"']?[ \\t]*[:=][ \\t]*[\"']?[A-Za-z0-9][A-Za-z0-9_.@-]{2,})"
)
ENDPOINT = (
    "(?i:\\b[a-z][a-z0-9+]{1,15}://[a-z0-9][a-z0-9.-]*"
    "|\\b(?:host|hostname|endpoint|server)[\"']?[ \\t]*[:=][ \\t]*[\"']?[a-z0-9-]++(?:\\.[a-z0-9-]++)++)"
)
WEAK_SECRET = (
    "(?i:\\b(?:password|passwd|pass|pwd|secret|token|auth|credential|key)[\"']?[ \\t]*[:=][ \\t]*[\"']?)"
    "[^\\s\"',;]{4,}|(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
)
WEAK_WORDS = ("pass", "pwd", "secret", "token", "auth", "credential", "key")

# Parts belong together within one scope: lines up to a blank one.
SCOPE_END = "\\n[ \\t\\r]*\\n"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return let(F.lower(text), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words]))


def _as_kind(spans: Column, kind: str, keep=None) -> Column:
    spans = spans if keep is None else F.filter(spans, keep)
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")
    )).cast(_SPAN)


def _base_spans(text: Column) -> Column:
    assign = F.when(
        _any_word(text, ASSIGN_WORDS),
        _as_kind(match_spans(text, ASSIGN, 2), "assign", lambda s: F.length(s["got"]) >= LEAST_ASSIGNED),
    ).otherwise(_none())
    access = F.when(F.contains(text, F.lit("AKIA")), _as_kind(match_spans(text, ACCESS), "access")).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _as_kind(match_spans(text, HEX), "hex")).otherwise(_none())
    return F.concat(assign, access, hexes)


def _linked_spans(text: Column) -> Column:
    """Weak secrets with an identifier and, for bare ones, also an endpoint in their scope."""
    scopes = let(
        F.struct(F.split(text, SCOPE_END, -1).alias("text"), match_spans(text, SCOPE_END).alias("ends")),
        lambda x: F.transform(x["text"], lambda s, i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get(x["ends"], i - 1)["end"]).alias("at"), s.alias("text")
        )),
    )
    scopes = F.filter(scopes, lambda s: s["text"].rlike(IDENTIFIER) & s["text"].rlike(WEAK_SECRET))

    def reach(parts: Column) -> Column:
        # The first part to end and the last to start say whether any stands apart from a secret.
        return F.struct(
            F.array_min(F.transform(parts, lambda p: p["end"])).alias("first_end"),
            F.array_max(F.transform(parts, lambda p: p["start"])).alias("last_start"),
        )

    def beside_any(parts: Column, s: Column) -> Column:
        # Apart from the secret itself: a part of the same characters does not complete it.
        return F.coalesce((parts["first_end"] <= s["start"]) | (parts["last_start"] >= s["end"]), F.lit(False))

    def found(scope: Column) -> Column:
        parts = F.struct(
            reach(match_spans(scope["text"], IDENTIFIER)).alias("ids"),
            reach(match_spans(scope["text"], ENDPOINT)).alias("ends"),
            match_spans(scope["text"], WEAK_SECRET).alias("weak"),
        )
        return let(parts, lambda x: F.transform(
            F.filter(x["weak"], lambda s: beside_any(x["ids"], s) & (
                s["got"].rlike("[:=]") | beside_any(x["ends"], s)
            )),
            lambda s: F.struct(
                (s["start"] + scope["at"]).alias("start"), F.lit(KINDS.index("linked")).alias("kind"),
                (s["end"] + scope["at"]).alias("end"),
            ),
        )).cast(_SPAN)

    gate = (_any_word(text, WEAK_WORDS) | text.rlike("[A-Za-z0-9/+]{40}")) & text.rlike(IDENTIFIER)
    return F.when(gate, F.flatten(F.transform(scopes, found))).otherwise(_none())


def secret_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secrets``: structs ``start``, ``kind`` (place in ``KINDS``) and ``end``, sorted.

    Places are code points, ends exclusive. ``assign``, ``access`` and ``hex`` are found anywhere.
    ``linked`` marks weak secrets with an access identifier elsewhere in the same scope, however long; a secret
    without a name before it also needs an endpoint there. A null or empty text has no spans. Every row gives one row; an input column named ``secrets`` gives way.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return beside(df, {"secrets": F.sort_array(F.concat(_base_spans(whole), _linked_spans(whole)))})


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span of ``secret_spans`` replaced by ``mark``; spans that touch or overlap become one."""
    def step(acc: Column, s: Column) -> Column:
        new = (s["start"] > acc["at"]) | (F.size(acc["out"]) == 0)
        piece = F.array(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(new, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] < KINDS.index("linked"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("secrets")).alias("spans"), count("linked"),
    )
