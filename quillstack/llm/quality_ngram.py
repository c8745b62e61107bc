"""Quality rules with n-gram perplexity under a modified Kneser-Ney model counted by Spark.

Model: character 5-grams of every text, one model for each language. Letters are told apart in every script, without
case; white space runs are one space, sentence punctuation is one symbol, other ASCII signs are one, digits are
themselves. A symbol has 12 bits, so a 5-gram is a number. Spark counts the 5-grams of all documents. Lower orders are
continuation counts; each language and order has three discounts of its own, from all counts. What one text alone holds (or several
equal ones) is looked up by that text alone, at every order: there its own count is left out, since a text's own oddities say nothing about it. The model is a table that grows with the
corpus, and all of the estimation is joins and windows over it; nothing of it is collected or broadcast.

Scoring: documents lie in chunks (``CHUNK_ROWS`` rows of one file). The 5-grams of a chunk meet the model in a join, and the chunk's share of
it is written as arrays of 64-bit hashes, sorted, with their log probabilities. A task that reads documents
opens the arrays of their chunk and finds each 5-gram by binary search.

Verdict: a document's log perplexity is the median over its windows of ``SPAN`` characters of their mean loss, so a passage of
another kind, or a few long keys in a short text, don't decide. It must lie within its language's band. The lower bound is the
language's median less ``LOW_WIDTH`` robust deviations of the documents below it; the upper bound is the median plus
``HIGH_WIDTH`` robust deviations of those above. Both are widened by ``SHORT`` over the root of the number of characters
and by ``FEW`` over the root of the number of the language's documents. Too high is gibberish or another language, too low is repetition or
junk of symbols and fragments. Medians come from exact counts of scores rounded to ``STEP``.

Defined cases: null text has no words and fails the base rules; a null language is a language; a document
without words has perplexity zero; a text that alone holds its 5-grams is judged by the orders below; very long texts are
whole; equal scores and repeated rows are judged alike; empty tables give empty results; columns whose names
clash with those produced are replaced, and names that begin with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstack.llm._tables import batches_of, by_name, delete, drop_written, filesystem, fresh, new_path, numbered, written
from quillstack.llm._text import Words, blocks, code_points, hash_longs, mix, utf8

ORDER, BITS = 5, 12
SYMBOLS = 1 << BITS
CHUNK_ROWS_BITS = 16
CHUNK_ROWS = 1 << CHUNK_ROWS_BITS
SPAN = 64  # characters of a window
BLOCK = 1 << 17  # bytes of text counted together; memory is some hundred times that
LOW_WIDTH, HIGH_WIDTH, SHORT, FEW = 4.0, 8.0, 3.0, 0.5
STEP = 5e-4
BATCH = 1000  # texts that a worker takes at once
SALTS = 128
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _symbols() -> np.ndarray:
    """The symbol of every code point; 0 stands before a text's start."""
    point = np.arange(0x110000, dtype=np.uint64)
    for c in range(0x10000):
        low = chr(c).lower()
        if len(low) == 1:
            point[c] = ord(low)
    out = np.where(point < 128, point, 128 + mix(point) % np.uint64(SYMBOLS - 128)).astype(np.int64)
    ascii_ = np.arange(128)
    signs = [c for c in ascii_.tolist() if not chr(c).isalnum()]
    out[signs] = ord("#")
    out[list(b".,;:!?'\"()-")] = ord(".")
    out[[0x20, *range(9, 14)]] = ord(" ")
    return out


_OF = _symbols()


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """The counts of ``BASE`` by document."""
    lead = (w.data & 0xC0) != 0x80
    out = {"n_words": w.per_doc, "word_chars": w.sums(w.word & lead), "n_symbols": w.sums(_SYMBOL[w.data])}
    w.prefix_hash()
    # lines: each document starts one, each newline another
    cuts = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate([w.offsets[:-1], cuts + 1]), kind="stable")
    end = np.sort(np.concatenate([w.offsets[1:], cuts]), kind="stable")
    worded = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.word, out=worded[1:])
    some = worded[end] > worded[start]
    start, end = start[some], end[some]
    doc = np.searchsorted(w.offsets, start, "right") - 1
    key = mix(w.span_hash(start, end) + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    again = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(doc[order[1:]][again], minlength=w.n_docs)
    out["n_repeat_words"] = _repeat_words(w)
    return out


def _repeat_words(w: Words) -> np.ndarray:
    """Words in windows that occur twice or more in their document."""
    n = len(w.start) - WINDOW + 1
    if n <= 0:
        return np.zeros(w.n_docs, np.int64)
    word = w.span_hash(w.start, w.end)
    key = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        key = key * np.uint64(0x9FB21C651E98DF25) + word[i : i + n]
    key = mix(key + (w.doc[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    inside = w.doc[:n] == w.doc[WINDOW - 1 :]
    found = np.sort(key[inside])
    twice = np.unique(found[1:][found[1:] == found[:-1]])
    if not len(twice):
        return np.zeros(w.n_docs, np.int64)
    hit = np.flatnonzero(inside & (twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key))
    cover = np.zeros(len(w.start) + 1, np.int64)
    cover[hit] += 1
    cover[hit + WINDOW] -= 1
    return np.bincount(w.doc[np.cumsum(cover)[:-1] > 0], minlength=w.n_docs)


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the highest order, as numbers, and the document of each."""
    kept = w.word | w.before
    points, per_doc = code_points(w.data[kept]), w.sums(kept & ((w.data & 0xC0) != 0x80))
    doc = np.repeat(np.arange(w.n_docs), per_doc)
    c = _OF[points]
    key = c.copy()
    for back in range(1, min(ORDER, len(c))):
        key[back:] |= c[:-back] << (BITS * back)
    # the first characters of a document have nothing before them
    first = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
    for at in range(ORDER - 1):
        here = first[per_doc[per_doc > 0] > at] + at
        key[here] &= (1 << BITS * (at + 1)) - 1
    return key, doc


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts, and where in it runs of equal values begin."""
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    return order, np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, np.int64)


def _in_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__chunk``, a number that depends on a row's file and place in it alone, so that each reading gives it again.
    What is not read from Parquet files as it stands is written first."""
    place = F.xxhash64("_metadata.file_path", F.shiftright("_metadata.row_index", CHUNK_ROWS_BITS)).alias("__chunk")
    try:
        return docs.select("*", place)
    except AnalysisException:  # no file or row number: not a plain scan
        return written(docs, "texts").select("*", place)


def _blocks(batch: pa.RecordBatch, text: int, lang: int, chunk: int) -> Iterator[tuple[int, int, int, Words, np.ndarray]]:
    """(from, to, chunk, words, language numbers) of runs of rows that share a chunk."""
    data, offsets = utf8(batch.column(text))
    langs, chunks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (lang, chunk))
    cuts = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1], True]) if len(chunks) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = offsets[lo : hi + 1]
        for a, b in blocks(own, BLOCK):
            a, b = a + lo, b + lo
            yield a, b, int(chunks[lo]), Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), langs[a:b]


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Joins (hash, lang, gram, n, low, high); rows of equal hashes become one."""
    name, lang, gram, n, low, high = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
    order, first = _runs(name)
    if not len(order):
        return name, lang, gram, n, low, high
    one = order[first]
    return name[one], lang[one], gram[one], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def _counts(name: np.ndarray, lang: np.ndarray, gram: np.ndarray, seen: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``_merged``, of single n-grams; ``lang`` and ``seen`` are by document."""
    order, first = _runs(name)
    if not len(order):
        return name, lang[doc], gram, np.zeros(0, np.int64), seen[doc], seen[doc]
    one, own = order[first], seen[doc[order]]
    return name[one], lang[doc[one]], gram[one], np.diff(np.r_[first, len(name)]), np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)


def counted(docs: DataFrame) -> DataFrame:
    """(chunk, lang, gram, n, low, high) of ``docs`` (__chunk, __lang, __seen, __text): counts by chunk, and the smallest and
    largest hash of the texts that hold the n-gram."""
    schema = "chunk long, lang long, gram long, n long, low int, high int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            seen = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, chunk, w, lang in _blocks(batch, 3, 1, 0):
                gram, doc = grams(w)
                name = hash_longs(gram, hash_longs(lang)[doc])
                mine = parts.setdefault(chunk, [])
                mine.append(_counts(name, lang, gram, seen[a:b], doc))
                if len(mine) == 24:  # some 3 MB of text
                    mine[:] = [_merged(mine)]
        for chunk, mine in parts.items():
            _, *columns = _merged(mine)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), chunk)), *map(pa.array, columns)], names=names)

    return docs.select("__chunk", "__lang", "__seen", "__text").mapInArrow(run, schema)


def known(counts: DataFrame) -> DataFrame:
    """(lang, gram, n, own): how often each n-gram occurs, and the hash of the text that holds it, if all that do are equal."""
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return total.select("lang", "gram", "n", F.when(F.col("low") == F.col("high"), F.col("low")).alias("own"))


def _same(own: str, among) -> Column:
    """The text that all rows of a group or window (``among`` turns an aggregate into a column) belong to; null if there is more than one."""
    least, most = among(F.min(own)), among(F.max(own))
    return F.when((least == most) & (among(F.count(own)) == among(F.count(F.lit(1)))), least)


def _discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): what is taken from counts of 1, 2, and 3 or more."""
    times = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    of = lambda i, other: F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))).otherwise(other)
    return level.groupBy("lang").agg(*times).select("lang", of(1, 0.5).alias("d1"), of(2, 1.0).alias("d2"), of(3, 1.5).alias("d3"))


def _levels(top: DataFrame) -> list[DataFrame]:
    """Continuation counts of every order from 1 up, below the written counts ``top`` (lang, gram, n, own) of the highest, of all n-grams."""
    levels = [top]
    for order in range(ORDER - 1, 0, -1):
        rest = F.col("gram").bitwiseAND((1 << BITS * order) - 1).alias("gram")
        levels.insert(0, written(levels[0].groupBy("lang", rest).agg(F.count_if(F.col("n") > 0).alias("n"), _same("own", lambda c: c).alias("own")), f"order{order}"))
    return levels


def probabilities(levels: list[DataFrame]) -> DataFrame:
    """(lang, gram, p) for every row of the highest of ``levels``: interpolated modified Kneser-Ney, where rows with
    n = 0 were not counted and take what the orders below give them. Discounts are those of all counts. A row that belongs to one text
    is looked up by that text alone: its own count is left out, and so is a context that no other text holds."""
    below: DataFrame | None = None
    for order, level in enumerate(levels, 1):
        taken = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = Window.partitionBy("lang", "context")  # SYMBOLS rows at most
        # a language's rows are met in SALTS parts, since one language may have most of them
        cut = _discounts(level).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        now = level.withColumn("salt", F.pmod(F.hash("gram"), F.lit(SALTS))).join(cut, ["lang", "salt"]).withColumn("context", F.shiftright("gram", BITS)).withColumn("taken", taken)
        now = now.withColumn("total", F.sum("n").over(context)).withColumn("left", F.sum("taken").over(context)).withColumn("alone", _same("own", lambda c: c.over(context)).isNotNull())
        mine = F.col("own").isNotNull()
        now = now.withColumn("total", F.when(F.col("alone"), 0).when(mine, F.col("total") - F.col("n")).otherwise(F.col("total"))).withColumn("left", F.when(mine, F.col("left") - F.col("taken")).otherwise(F.col("left")))
        now = now.withColumn("n", F.when(mine, 0).otherwise(F.col("n"))).withColumn("taken", F.when(mine, 0.0).otherwise(F.col("taken")))
        if below is None:
            now = now.withColumn("low", F.lit(1.0 / SYMBOLS))
        else:
            now = now.withColumn("rest", F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1)).join(below, ["lang", "rest"])
        p = F.when(F.col("total") > 0, (F.col("n") - F.col("taken")) / F.col("total") + F.col("left") / F.col("total") * F.col("low")).otherwise(F.col("low"))
        below = now.select("lang", F.col("gram").alias("rest"), p.alias("low"))
    return below.select("lang", F.col("rest").alias("gram"), F.col("low").alias("p"))


def model_arrays(counts: DataFrame, model: DataFrame) -> str:
    """Writes each chunk's share of ``model`` (lang, gram, p): a folder for a chunk, in it hashes in ascending order with their log
    probabilities. Returns the path."""
    path = new_path(counts.sparkSession, "arrays")
    met = counts.select("chunk", "lang", "gram").join(model, ["lang", "gram"]).dropDuplicates(["lang", "gram", "chunk"])
    rows = met.select("chunk", F.xxhash64("lang", "gram").alias("hash"), F.ln("p").cast("float").alias("logp"))
    rows.repartition("chunk").sortWithinPartitions("chunk", "hash").write.partitionBy("chunk").parquet(path)
    return path


class _Arrays:
    """The arrays of the chunk read last."""

    def __init__(self, path: str):
        self.path, self.chunk = path, None

    def score(self, chunk: int, hashes: np.ndarray) -> np.ndarray:
        if chunk != self.chunk:
            fs, root = filesystem(self.path)
            t = pq.read_table(f"{root}/chunk={chunk}", filesystem=fs, columns=["hash", "logp"], partitioning=None)
            self.hash, self.logp, self.chunk = t["hash"].to_numpy(), t["logp"].to_numpy(), chunk
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        if not np.array_equal(self.hash[at], hashes):
            raise ValueError(f"the arrays of chunk {chunk} lack n-grams of its documents; did the table change while it was read?")
        return self.logp[at]


def typical(loss: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The median over windows of ``SPAN`` characters (the last one takes the rest) of their mean loss, for documents of ``n``
    characters each; zero for empty ones."""
    some = np.flatnonzero(n)
    out = np.zeros(len(n))
    if not len(some):
        return out
    size = n[some]
    windows = np.maximum(size // SPAN, 1)
    end = np.cumsum(windows)
    own = np.repeat(np.arange(len(some)), windows)
    first = (np.cumsum(size) - size)[own] + SPAN * (np.arange(end[-1]) - (end - windows)[own])
    mean = np.add.reduceat(loss, first) / np.diff(np.r_[first, len(loss)])
    mean = mean[np.lexsort((mean, own))]
    out[some] = (mean[end - windows + (windows - 1) // 2] + mean[end - windows + windows // 2]) / 2
    return out


def scored(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (with __chunk, __lang, __seen, __text) with the counts of ``BASE``, n_grams and log_perplexity by the arrays below ``path``;
    __lang stays."""
    held, back = numbered(*[c for c in docs.columns if c not in ("__chunk", "__seen", "__text", "__lang")])
    schema = T.StructType([
        *docs.select(*held).schema.fields,
        *[T.StructField(c, T.LongType(), False) for c in (*BASE, "n_grams")],
        T.StructField("log_perplexity", T.DoubleType(), False),
        T.StructField("__lang", T.LongType(), False),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _Arrays(path)
        for batch in batches:
            n = batch.num_columns
            cols = {c: np.zeros(batch.num_rows, np.int64) for c in (*BASE, "n_grams")}
            loss = np.zeros(batch.num_rows)
            for a, b, chunk, w, lang in _blocks(batch, n - 1, n - 2, n - 3):
                for c, x in base_counts(w).items():
                    cols[c][a:b] = x
                gram, doc = grams(w)
                if not len(gram):
                    continue
                name = hash_longs(gram, hash_longs(lang)[doc]).view(np.int64)
                order, first = _runs(name)
                logp = np.empty(len(name))
                logp[order] = np.repeat(arrays.score(chunk, name[order[first]]), np.diff(np.r_[first, len(name)]))
                cols["n_grams"][a:b] = np.bincount(doc, minlength=b - a)
                loss[a:b] = typical(-logp, cols["n_grams"][a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 3], *[pa.array(x) for x in cols.values()], pa.array(loss), batch.column(n - 2)], names=schema.names)

    return docs.select(*held, "__chunk", "__lang", "__text").mapInArrow(run, schema).select(*back, *[f.name for f in schema.fields[len(held) :]])


def with_scores(docs: DataFrame, lang: str = "lang", text: str = "text", keep: list[str] | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the counts of ``BASE``, n_grams, log_perplexity and the language's number __lang, written.
    The model is that of ``corpus`` (lang, text), or of the documents themselves."""
    mine = lambda d: (F.xxhash64(lang).alias("__lang"), F.hash(text).alias("__seen"), F.col(text).alias("__text"))
    slim = fresh(docs, *BASE, "n_grams", "log_perplexity", "__lang", "__seen", "__text", "__chunk")
    slim = slim.select(*by_name(*[c for c in slim.columns if keep is None or c in keep]), *mine(docs))
    chunks = _in_chunks(slim)
    with batches_of(docs.sparkSession, BATCH):
        counts = written(counted(chunks), "counts")
    if corpus is None:
        table = known(counts)
    else:
        other = known(counted(_in_chunks(corpus.select(*mine(corpus)))))
        table = other.drop("own").unionByName(counts.select("lang", "gram", F.lit(0).alias("n"))).groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("own", F.lit(None).cast("int"))
    top = written(table, f"order{ORDER}")
    levels = _levels(top)
    path = model_arrays(counts, probabilities(levels))
    for done in (counts, *levels):
        drop_written(done)
    with batches_of(docs.sparkSession, BATCH):
        out = written(scored(chunks, path), "scores")
    delete(docs.sparkSession, path)
    return out


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _median(counts: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name, times) of ``counts`` (by, step, n): the smallest step that at least half of the rows don't exceed, and their number."""
    every = Window.partitionBy(by)
    counts = counts.withColumn("upto", F.sum("n").over(every.orderBy("step"))).withColumn("all", F.sum("n").over(every))
    return counts.where("2 * upto >= `all`").groupBy(by).agg(F.min("step").alias(name), F.first("all").alias("times"))


def bands(scores: DataFrame, by: str = "__lang") -> DataFrame:
    """(by, mid, low_mad, high_mad, times) of the documents that pass the base rules; a row for each language. The deviations are
    medians of the distances of those at or below ``mid`` and at or above it.

    Documents are counted by step first; a language's task holds its steps, however many documents they stand for."""
    step = F.round(F.col("log_perplexity") / STEP).cast("long").alias("step")
    counts = scores.where(~_failed()).groupBy(by, step).agg(F.count("*").alias("n"))
    mid = _median(counts, by, "mid")
    off = counts.join(mid.select(by, "mid"), by).select(by, (F.col("step") - F.col("mid")).alias("off"), "n")
    low = _median(off.where("off <= 0").select(by, (-F.col("off")).alias("step"), "n"), by, "low_mad").drop("times")
    high = _median(off.where("off >= 0").select(by, F.col("off").alias("step"), "n"), by, "high_mad").drop("times")
    value = [(F.col(c) * STEP).alias(c) for c in ("mid", "low_mad", "high_mad")]
    return mid.join(low, by).join(high, by).select(by, *value, "times")


def verdicts(scores: DataFrame, found: DataFrame, by: str = "__lang") -> DataFrame:
    """Adds base_failed, the band (``lower``, ``upper``) and kept, given the ``bands``; ``by`` goes."""
    made = ("base_failed", "lower", "upper", "kept")
    band = found.select(F.col(by).alias("__by"), F.struct("mid", "low_mad", "high_mad", "times").alias("__band"))
    out = fresh(scores, *made, "__by", "__band").withColumn("base_failed", _failed())
    out = out.join(band, out[by] == band["__by"], "left")
    more = SHORT / F.sqrt(F.greatest("n_grams", F.lit(1))) + FEW / F.sqrt("__band.times")
    out = out.withColumn("lower", F.col("__band.mid") - LOW_WIDTH * 1.4826 * F.col("__band.low_mad") - more)
    out = out.withColumn("upper", F.col("__band.mid") + HIGH_WIDTH * 1.4826 * F.col("__band.high_mad") + more)
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return out.withColumn("kept", kept).drop("__by", "__band", by)


def judged(docs: DataFrame, keep: list[str] | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, text, lang), or its columns ``keep``, with counts, perplexity, band and verdict."""
    scores = with_scores(docs, keep=keep, corpus=corpus)
    return verdicts(scores, written(bands(scores), "bands"))
