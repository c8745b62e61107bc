"""Secret scans with multipart credential linking, with DataFrame functions only.

Base kinds, leftmost and non-overlapping within a kind, in code points: ``assign`` (a named secret with a value of 8
characters or more), ``access`` (AKIA identifiers of 16 or more), ``hex`` (runs of 32 or more).

Linking: weak parts say little alone. ``id`` is an upper-case run of 16 to 24 characters with letters and digits or
a named user, account or client; ``key`` is a run of exactly 40 characters with capitals, small letters and
digits; ``endpoint`` is the address of a service. An interval join within a text pairs parts whose gap is at most ``SCOPE``
code points: parts are keyed by text and by the ``SCOPE``-wide cells that they touch, so only neighbours meet. An id is
reported if a secret (key, assign or hex) is in its scope, a key if an identifier (id or access) is, an endpoint if both are. Weak
parts that overlap a base span are not reported again.

Defined cases: null text is empty and has no spans; repeated rows have spans of their own; a null doc_id is kept; long texts are
whole; clashing columns are replaced; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm._tables import by_name, fresh, written

SCOPE = 300

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Weak parts.
NAMED_ID = r"""(?i:user_?name|user_?id|login|account_?id|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
BARE_ID = r"[A-Z0-9]{16,}"
KEY = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"(?:https?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|amqps|s3)://[A-Za-z0-9_.:/-]+"

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")  # in this order where they start together
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_CHUNK = 64


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8


def _bare_id(match: Column) -> Column:
    return F.length(match).between(16, 24) & F.regexp_like(match, F.lit("[A-Z]")) & F.regexp_like(match, F.lit("[0-9]"))


def _bare_key(match: Column) -> Column:
    return (F.length(match) == 40) & F.regexp_like(match, F.lit("[A-Z]")) & F.regexp_like(match, F.lit("[a-z]")) & F.regexp_like(match, F.lit("[0-9]"))


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the matches that ``keep`` accepts. What lies between matches gives their places; running sums
    are taken in chunks, so that time stays near linear in the number of matches."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gap = F.split(text, pattern, -1)
    pairs = F.zip_with(match, F.slice(gap, F.lit(1), F.size(match)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), (keep(m) if keep else F.lit(True)).alias("ok")))
    none = F.array().cast(_SPAN)

    def chunk(p: Column, i: Column) -> Column:
        return F.slice(p, i * _CHUNK + 1, F.lit(_CHUNK))

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    def lay(p: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _CHUNK).cast("int"))
        sums = F.transform(numbers, lambda i: F.aggregate(chunk(p, i), F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.flatten(F.zip_with(numbers, starts, lambda i, at: F.when(i.isNotNull(), F.aggregate(chunk(p, i), F.struct(at.alias("at"), none.alias("spans")), place)["spans"]).otherwise(none)))

    found = F.get(F.transform(F.array(pairs), lay), F.lit(0))  # a one-element array names the value once
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def with_parts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with __row, __base (spans of the base kinds, sorted) and __weak."""
    docs = fresh(docs, "__row", "__base", "__weak")
    kept = [c for c in docs.columns if keep is None or c in keep]
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.sort_array(F.concat(spans_of(t, ASSIGN, 0, _long_value), spans_of(t, ACCESS, 1), spans_of(t, HEX, 2)))
    weak = F.concat(spans_of(t, NAMED_ID, 3), spans_of(t, BARE_ID, 3, _bare_id), spans_of(t, KEY, 4, _bare_key), spans_of(t, ENDPOINT, 5))
    return docs.select(*by_name(*kept), F.monotonically_increasing_id().alias("__row"), base.alias("__base"), weak.alias("__weak"))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(__row, __linked): weak spans whose complements are in scope, from a written result of ``with_parts``."""
    cell = lambda x: F.floor(x / scope).cast("int")
    weak = parts.select("__row", F.explode("__weak").alias("w")).distinct()
    near = weak.select("__row", "w", F.explode(F.sequence(cell(F.col("w.start") - scope), cell(F.col("w.end") + scope))).alias("cell"))
    some = parts.where(F.size("__weak") > 0).select("__row", F.explode(F.concat("__base", "__weak")).alias("p"))
    every = some.select("__row", "p", F.explode(F.sequence(cell(F.col("p.start")), cell(F.col("p.end") - 1))).alias("cell"))
    both = near.join(every, ["__row", "cell"])
    within = (F.col("p.start") <= F.col("w.end") + scope) & (F.col("w.start") <= F.col("p.end") + scope)
    kind = F.col("p.kind")
    seen = both.where(within).groupBy("__row", "w").agg(
        F.bool_or(kind.isin(1, 3)).alias("id"),
        F.bool_or(kind.isin(0, 2, 4)).alias("secret"),
        F.bool_or((kind < 3) & (F.col("p.start") < F.col("w.end")) & (F.col("w.start") < F.col("p.end"))).alias("covered"),
    )
    wanted = F.when(F.col("w.kind") == 3, F.col("secret")).when(F.col("w.kind") == 4, F.col("id")).otherwise(F.col("id") & F.col("secret"))
    return seen.where(wanted & ~F.col("covered")).groupBy("__row").agg(F.collect_list("w").alias("__linked"))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``base`` and ``spans``: sorted arrays of (start, kind, end), kinds by their place in ``KINDS``."""
    parts = written(with_parts(fresh(docs, "base", "spans"), text, keep), "parts")
    none = F.array().cast(_SPAN)
    out = parts.join(linked(parts), "__row", "left")
    out = out.withColumn("base", F.col("__base")).withColumn("spans", F.sort_array(F.concat("__base", F.coalesce("__linked", none))))
    return out.drop("__row", "__base", "__weak", "__linked")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs`` (doc_id, text)."""
    found = scan(docs, keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """``docs`` with every span of the scan replaced by ``mark``; null texts stay null.

    Base spans are found where the text is; linked ones, which few texts have, come by the text's digest. No text is
    stored, and texts move only if the linked spans are too many to be sent to all."""
    name = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    parts = written(with_parts(docs.select(F.col(text), name.alias("__name")), text, ["__name"]), "parts")
    some = linked(parts).join(parts.select("__row", "__name"), "__row").groupBy("__name").agg(F.first("__linked").alias("__linked"))
    some = written(some, "linked").withColumnRenamed("__name", "__key")
    here = with_parts(docs, text).drop("__weak", "__row").withColumn("__key", name).join(some, "__key", "left")
    here = here.withColumn("__spans", F.sort_array(F.concat("__base", F.coalesce("__linked", F.array().cast(_SPAN)))))
    open_ = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["pieces"]).otherwise(F.concat(acc["pieces"], F.array(piece))).alias("pieces"))

    done = F.aggregate("__spans", open_, step, lambda acc: F.concat(F.array_join(acc["pieces"], ""), F.substr(F.col(text), acc["at"] + 1, F.length(text))))
    clean = F.when(F.size("__spans") > 0, done).otherwise(F.col(text))
    return here.withColumn(text, clean).select(*by_name(*docs.columns))
