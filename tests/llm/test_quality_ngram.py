import math
import random
import re
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import quality_ngram as q
from quillstack.llm._text import code_points, hash_longs

from .conftest import SF


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(covered)


def folded(text):
    """Letters without case, one sign for sentence punctuation, one for other ASCII signs, one space for a run."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    kept = " ".join(words) + (" " if words and re.search(r"[\x20\x09-\x0D]\Z", text) else "")
    low = [c.lower() if len(c.lower()) == 1 else c for c in kept]
    return ["." if c in ".,;:!?'\"()-" else "#" if c.isascii() and not c.isalnum() and c != " " else c for c in low]


def brute_levels(texts):
    """Counts of 5-grams, continuation counts of the shorter ones, and the different texts that hold each."""
    top, held = Counter(), defaultdict(set)
    for t in texts:
        s = ["", "", "", "", *folded(t)]
        for i in range(4, len(s)):
            g = tuple(s[i - 4 : i + 1])
            top[g] += 1
            for k in range(5):
                held[g[k:]].add(t)
    levels = [top]
    for _ in range(4):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    return levels, held


def brute_discounts(level):
    n = Counter(level.values())
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
    d = [i - (i + 1) * y * n[i + 1] / n[i] if n[1] and n[i] else e for i, e in ((1, 0.5), (2, 1.0), (3, 1.5))]
    return [min(max(x, 0.05), k - 0.05) if n[1] and n[k] else x for x, k in zip(d, (1, 2, 3))]


def brute_model(texts, of_others=False):
    """Interpolated modified Kneser-Ney by plain dictionaries, over all 5-grams; what one text alone holds doesn't count for that text (unless texts of others are scored)."""
    levels, held = brute_levels(texts)
    mine = lambda g: not of_others and len(held[g]) == 1
    cuts, sums, left, alone = [], [], [], []
    for c in levels:
        d = brute_discounts(c)
        cut = lambda x, d=d: d[min(x, 3) - 1] if x else 0
        total, taken, rows = defaultdict(int), defaultdict(float), defaultdict(set)
        for g, x in c.items():
            total[g[:-1]] += x
            taken[g[:-1]] += cut(x)
            rows[g[:-1]].add(next(iter(held[g])) if mine(g) else None)
        cuts.append(cut), sums.append(total), left.append(taken)
        alone.append({h for h, owners in rows.items() if len(owners) == 1 and None not in owners})

    def p(g):
        if not g:
            return 1 / 4096
        n, h = len(g) - 1, g[:-1]
        x, total, rest = levels[n].get(g, 0), sums[n].get(h, 0), left[n][h]
        if x and mine(g):
            total, rest, x = 0 if h in alone[n] else total - x, rest - cuts[n](x), 0
        return (x - cuts[n](x)) / total + rest / total * p(g[1:]) if total else p(g[1:])

    def score(t):
        s = ["", "", "", "", *folded(t)]
        loss = [-math.log(p(tuple(s[i - 4 : i + 1]))) for i in range(4, len(s))]
        n = max(len(loss) // 64, 1)
        return statistics.median(statistics.fmean(loss[64 * i : 64 * i + 64 if i < n - 1 else None]) for i in range(n)) if loss else 0.0

    return score


def test_discounts_are_estimated_for_each_language_and_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IN ('de', 'fr', 'es')")
    rows = docs.select("lang", "text", F.xxhash64("lang").alias("number")).collect()
    slim = docs.selectExpr("0L AS __chunk", "xxhash64(lang) AS __lang", "hash(text) AS __seen", "text AS __text")
    levels = q._levels(q.written(q.known(q.counted(slim)), "test"))
    top = set()
    for lang, number in {(r.lang, r.number) for r in rows}:
        want, held = brute_levels([r.text for r in rows if r.lang == lang])
        for order in (0, 3, 4):
            got = q._discounts(levels[order]).where(F.col("lang") == number).first()
            assert list(got[1:]) == pytest.approx(brute_discounts(want[order]))
        top.add(tuple(got[1:]))
        sums = levels[4].where(F.col("lang") == number).agg(F.sum("n"), F.count("own")).first()
        assert tuple(sums) == (sum(want[4].values()), sum(len(held[g]) == 1 for g in want[4]))
    assert len(top) == 3 and (0.5, 1.0, 1.5) not in top


def test_counts_and_perplexity_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'de'")
    rows = docs.collect()
    got = {r.doc_id: r for r in q.judged(docs, keep=["doc_id"]).collect()}
    score = brute_model([r.text for r in rows])
    for r in rows:
        g = got[r.doc_id]
        assert tuple(g[c] for c in q.BASE) == base(r.text)
        assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words)
        assert g.n_grams == len(folded(r.text))
        assert g.log_perplexity == pytest.approx(score(r.text), rel=1e-5)


def test_scores_under_the_model_of_another_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'fr'")
    one, other = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = {r.doc_id: r.log_perplexity for r in q.judged(one, keep=["doc_id"], corpus=other).collect()}
    score = brute_model([r.text for r in other.collect()], of_others=True)
    assert got == pytest.approx({r.doc_id: score(r.text) for r in one.collect()}, rel=1e-5)


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("0L AS __chunk", "xxhash64(lang) AS __lang", "hash(text) AS __seen", "text AS __text")
    table = q.known(q.counted(docs)).withColumn("own", F.lit(None).cast("int"))
    some = [(r.lang, r.gram >> q.BITS) for r in table.where("n > 0").orderBy(F.xxhash64("gram")).limit(5).collect()]
    some.append((some[0][0], int("".join(f"{ord(c):012b}" for c in "qxqx"), 2)))  # a context never seen falls back to shorter ones
    all_ = spark.createDataFrame(some, "lang long, context long").selectExpr("lang", f"context * {q.SYMBOLS} AS first").crossJoin(spark.range(q.SYMBOLS))
    table = table.unionByName(all_.selectExpr("lang", "first + id AS gram", "0L AS n"), allowMissingColumns=True).groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.first("own").alias("own"))
    p = q.probabilities(q._levels(q.written(table, "test")))
    sums = p.join(all_.selectExpr("lang", "first + id AS gram").distinct(), ["lang", "gram"]).groupBy("lang", F.shiftright("gram", q.BITS)).agg(F.sum("p").alias("p")).collect()
    assert len(sums) == 6 and all(r.p == pytest.approx(1, rel=1e-9) for r in sums)


def test_hashes_are_those_of_spark_and_code_points_those_of_python(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    rows = spark.createDataFrame([(x, y) for x in values for y in values], "x long, y long").selectExpr("x", "y", "xxhash64(x, y) AS h").collect()
    x, y, h = (np.array([r[i] for r in rows]) for i in range(3))
    assert (hash_longs(y, hash_longs(x)).view(np.int64) == h).all()
    text = "aé漢😀\x00߿ࠀ\uffff\U0010ffff z"
    assert code_points(np.frombuffer(text.encode(), np.uint8)).tolist() == [ord(c) for c in text]
    assert code_points(np.frombuffer(b"\xff\xe6a", np.uint8)).max() <= 0x10FFFF  # broken bytes don't raise


def test_small_chunks_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r for r in q.judged(docs, keep=["doc_id"]).collect()}
    monkeypatch.setattr(q, "CHUNK_ROWS_BITS", 3)
    assert {r.doc_id: r for r in q.judged(docs, keep=["doc_id"]).collect()} == want


def test_keeps_labelled_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    judged = q.judged(docs, keep=["doc_id"]).join(good, "doc_id").where("NOT base_failed")
    assert judged.where("NOT kept").count() <= 0.01 * judged.count()


def test_bands_reject_both_ends_by_language(spark):
    rows = [(i, m, 100, 0, 400, mid + (i % 9 - 4) / 100) for m, mid in ((1, 1.5), (2, 2.8)) for i in range(50)]
    rows += [(100, 1, 100, 0, 400, 2.8), (101, 2, 100, 0, 400, 1.5), (102, 2, 100, 0, 400, 2.8), (103, 1, 9, 0, 40, 1.5), (104, 1, 100, 21, 400, 1.5), (105, 1, 100, 20, 400, 1.5)]
    scored = spark.createDataFrame(rows, "doc_id long, model int, n_words long, n_repeat_words long, n_grams long, log_perplexity double")
    got = {r.doc_id: (r.base_failed, r.kept) for r in q.verdicts(scored, q.bands(scored, "model"), "model").where("doc_id >= 100").collect()}
    assert got == {100: (False, False), 101: (False, False), 102: (False, True), 103: (True, False), 104: (True, False), 105: (False, True)}
    assert q.verdicts(scored, q.bands(scored, "model"), "model").where("doc_id < 100 AND NOT kept").count() == 0


def test_odd_rows(spark, odd_docs):
    got = q.judged(odd_docs.withColumnRenamed("ids", "n_words")).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert tuple(r[c] for c in q.BASE) == base(r.text)
        assert r.kept in (True, False) and (not r.base_failed or not r.kept)
    assert q.judged(odd_docs.limit(0)).count() == 0


def test_planted_junk_goes_and_clean_documents_stay(spark):
    """Five of each kind among the documents of sf0.01: random letters, hex digits, text of another language, and words glued to symbols."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    texts = [r.text for r in docs.join(good, "doc_id").where("lang = 'en'").orderBy("doc_id").limit(40).collect()]
    words = re.findall("[a-z]+", " ".join(texts).lower())
    r = random.Random(5)
    kinds = {
        "letters": lambda i: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(200)),
        "hex": lambda i: " ".join("".join(r.choices("0123456789abcdef", k=8)) for _ in range(200)),
        "greek": lambda i: " ".join("".join(r.choices("αβγδεζηθικλμνξοπρστυφχψω", k=6)) for _ in range(200)),
        "symbols": lambda i: " ".join(w + "#$%"[j % 3] * 3 for j, w in enumerate(words[300 * i : 300 * i + 300])),
    }
    junk = [(10**6 + 10 * k + i, kinds[name](i), "en") for k, name in enumerate(kinds) for i in range(5)]
    got = q.judged(docs.unionByName(spark.createDataFrame(junk, docs.schema)), keep=["doc_id"])
    planted = {x.doc_id: x for x in got.where("doc_id >= 1000000").collect()}
    assert len(planted) == 20 and not any(x.base_failed for x in planted.values())
    for (doc_id, _, _), (name, above) in zip(junk, [(n, n != "symbols") for n in kinds for _ in range(5)]):
        x = planted[doc_id]
        assert not x.kept and (x.log_perplexity > x.upper if above else x.log_perplexity < x.lower), name
    clean = got.join(good, "doc_id").where("NOT base_failed")
    assert clean.where("NOT kept").count() <= 0.01 * clean.count()


def test_bands_have_a_lower_side_of_their_own(spark):
    """A long upper tail does not widen the lower bound, and both bounds act."""
    devs = [-0.02, -0.01, 0.0, 0.01, 0.02] * 10 + [0.3] * 10
    rows = [(i, 1, 100, 0, 10_000, 2.0 + d) for i, d in enumerate(devs)] + [(100, 1, 100, 0, 10_000, 1.8), (101, 1, 100, 0, 10_000, 2.8)]
    scored = spark.createDataFrame(rows, "doc_id long, model int, n_words long, n_repeat_words long, n_grams long, log_perplexity double")
    assert {r.doc_id for r in q.verdicts(scored, q.bands(scored, "model"), "model").where("NOT kept").collect()} == {100, 101}


def test_every_language_has_its_own_model_and_band(spark):
    """Scores and bounds in the rarest of 20 languages are those it has by itself."""
    r = random.Random(8)
    rows = []
    for lang in [*(f"l{i:02}" for i in range(19)), None]:
        letters = r.sample("abcdefghijklmnopqrstuvwxyz", 9)
        words = ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(60)]
        for _ in range(12 if lang in ("l18", None) else 14):
            rows.append((len(rows), " ".join(r.choices(words, k=120)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in q.judged(docs, keep=["doc_id"]).collect()}
    for mine in ("lang = 'l18'", "lang IS NULL"):
        alone = q.judged(docs.where(mine), keep=["doc_id"]).collect()
        assert len(alone) >= 12
        for x in alone:
            for c in ("log_perplexity", "lower", "upper"):
                assert got[x.doc_id][c] == pytest.approx(x[c], rel=1e-6)
