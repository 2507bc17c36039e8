import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import quality

from . import data


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    covered, seen = set(), {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(j for p in places for j in range(p, p + 8))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_statistics_equal_plain_python(spark):
    rnd = random.Random(4)
    rows = data.documents()
    for i in range(100, 140):
        phrase = data.text(rnd, 12)
        rows.append((i, " ".join(rnd.choice([phrase, data.text(rnd, 9), "a b a b", "#|<x>"]) for _ in range(rnd.randint(1, 9))), "en", "s", 0))
    got = quality.with_statistics(data.frame(spark, rows), "text").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted((repr(r[0]), *tuple(r)[1:]) for r in got) == sorted((repr(r[0]), *brute(r[1])) for r in rows)


def mcd(x, floors, starts=60):
    """Minimum covariance determinant of exact halves from random starts, in plain numpy: centre and scaled covariance."""
    n, p = x.shape
    h = min(n, (n + p + 1) // 2)
    rng, best = np.random.default_rng(1), None

    def estimate(rows):
        c = rows.mean(0)
        s = (rows - c).T @ (rows - c) / len(rows) * quality._consistency(0.5, p)
        np.fill_diagonal(s, np.maximum(np.diag(s), np.array(floors) ** 2) + 1e-9)
        return c, s

    for _ in range(starts):
        c, s = estimate(x[rng.choice(n, min(n, p + 1), replace=False)])
        last = np.inf
        for _ in range(100):
            y = x - c
            d = (y * np.linalg.solve(s, y.T).T).sum(1)
            c, s = estimate(x[np.argsort(d, kind="stable")[:h]])
            det = np.linalg.slogdet(s)[1]
            if det >= last - 1e-9:
                break
            last = det
        if best is None or det < best[0]:
            best = det, c, s
    return best[1], best[2] * (1 + quality.SMALL / (n + quality.PRIOR))


def drawn(own, n, parent):
    a = n / (n + quality.PRIOR)
    (c, s), (pc, ps) = own, parent
    return a * c + (1 - a) * pc, a * s + (1 - a) * ps + a * (1 - a) * np.outer(c - pc, c - pc)


def vector(text):
    n, chars, symbols, dup, repeats, _ = brute(text)
    return [np.log1p(n), chars / max(n, 1), 4 * np.sqrt(symbols / max(chars, 1)), np.log1p(dup), 4 * np.sqrt(repeats / max(n, 1))]


def verdicts(rows):
    """id -> (squared distance or None if the base limits fail) by the numpy estimate of each group, drawn to its language's and all rows'."""
    floors = list(quality.FLOORS.values())
    good = [r for r in rows if not brute(r[1])[-1]]
    x = {r[0]: np.array(vector(r[1])) for r in good}

    def of(some):
        return mcd(np.array([x[r[0]] for r in some]), floors), len(some)

    whole = of(good)[0]
    langs = {lang: drawn(*of([r for r in good if r[2] == lang]), whole) for lang in {r[2] for r in good}}
    out = {}
    for g in {(r[2], r[3]) for r in good}:
        c, s = drawn(*of([r for r in good if (r[2], r[3]) == g]), langs[g[0]])
        np.fill_diagonal(s, np.maximum(np.diag(s), np.array(floors) ** 2))
        for r in good:
            if (r[2], r[3]) == g:
                y = x[r[0]] - c
                out[r[0]] = float(y @ np.linalg.solve(s, y))
    return out


def test_verdicts_equal_a_plain_estimate(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(900):
        lang, source = rnd.choice([("en", "a"), ("en", "a"), ("en", "b"), ("de", "a"), (None, "c")])
        words = data.text(rnd, rnd.randint(25, 200)).split(" ")
        if source == "b":
            words = [w + "|" if rnd.random() < 0.2 else w for w in words]
        if i % 9 == 0:
            words = [w + "#%" if rnd.random() < i % 27 / 20 else w for w in words]
        if i % 25 == 0:
            words += [f"\nagain and again {i % 3}"] * rnd.randint(2, 9)
        rows.append((i, " ".join(words), lang, source, 0))
    # three rows of a source of their own
    rows += [(i, data.text(rnd, 90), "de", "rare", 0) for i in range(900, 903)]
    expected = verdicts(rows)
    got = {r["id"]: r for r in quality.quality(data.frame(spark, rows)).collect()}
    assert len(expected) > 800 and {i for i, r in got.items() if not r["base_failed"]} == set(expected)
    clear = [i for i, d in expected.items() if not 0.8 < d / quality.CUTOFF < 1.25]
    assert len(clear) > 0.95 * len(expected) and 50 < sum(expected[i] > quality.CUTOFF for i in clear)
    assert [i for i in clear if got[i]["kept"] != (expected[i] <= quality.CUTOFF)] == []
    ratio = np.array([(got[i]["distance2"] + 1) / (expected[i] + 1) for i in expected])
    assert np.median(abs(np.log(ratio))) < 0.2


def test_estimate_withstands_outliers(spark):
    rng = np.random.default_rng(0)
    floors = {"a": 0.01, "b": 0.01}
    clean = rng.multivariate_normal([1, -2], [[1, 0.8], [0.8, 1]], 3000)
    bad = rng.normal([30, 30], 0.5, (1400, 2))
    rows = [("x", float(a), float(b)) for a, b in np.concatenate([clean, bad])] + [("y", float(a), float(b)) for a, b in rng.normal(0, 3, (400, 2))]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    models = {r["k"]: r for r in quality.fit(df, floors, prior=0).where(F.col("level") == quality.GROUP).collect()}
    m = models["x"]
    t = np.array(m["t"]).reshape(2, 2)
    cov = np.linalg.inv(t.T @ t)
    assert np.allclose(m["c"], [1, -2], atol=0.2)
    # the half of all rows is 73 % of the clean ones, so the scale is larger than theirs
    assert 1 < cov[0, 0] < 3 and np.allclose(cov / cov[0, 0], [[1, 0.8], [0.8, 1]], atol=0.1)
    d = ((np.array(rows[3000][1:]) - m["c"]) @ t.T) ** 2
    assert d.sum() > 250 and set(models) == {"x", "y"}


def test_outliers_go_and_plain_documents_stay(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(500):
        rows.append((i, data.text(rnd, rnd.randint(30, 300)), "en", "src0" if i % 3 else None, 0))
    for i in range(500, 520):
        rows.append((i, " ".join(w + "###%%%" for w in data.text(rnd, 80).split()), "en", "src0", 0))
    df = data.frame(spark, rows)
    got = {r["id"]: r for r in quality.quality(df).collect()}
    assert all(got[i]["kept"] for i in range(500))
    assert not any(got[i]["kept"] for i in range(500, 520)) and not any(got[i]["base_failed"] for i in range(520))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(500))


def test_junk_of_two_fifths_of_a_group_goes(spark):
    rnd = random.Random(9)
    rows = [(i, data.text(rnd, rnd.randint(30, 300)), "en", "src0", 0) for i in range(360)]
    rows += [(i, " ".join(w + "###%%%" for w in data.text(rnd, 80).split()), "en", "src0", 0) for i in range(360, 590)]
    # equal rows make one bin of the histogram; the last ten do
    rows += [(i, rows[360][1], "en", "src0", 0) for i in range(590, 600)]
    got = {r["id"]: r["kept"] for r in quality.quality(data.frame(spark, rows)).collect()}
    assert sum(got[i] for i in range(360, 600)) == 0 and sum(got[i] for i in range(360)) >= 358


def test_half_is_exact_among_ties(spark):
    # 60 rows at one place and 40 at another: the half is 51 of the first
    df = spark.createDataFrame([("x", 0.0)] * 60 + [("x", 9.0)] * 40, "g string, a double")
    model = quality.fit(df, {"a": 0.1}, prior=0).where(F.col("level") == quality.GROUP).first()
    assert model["c"] == [0.0]


def test_each_statistic_alone_rejects(spark):
    rnd = random.Random(3)

    def lined(words: int, size: int) -> list[str]:
        text = data.text(rnd, words).replace("\n", " ").split()
        return [" ".join(text[i : i + size]) for i in range(0, len(text), size)]

    rows = [(i, "\n".join(lined(rnd.randint(100, 250), 10)), "en", "src0", 0) for i in range(300)]
    # eight repeats of a line of five words: no window of eight words repeats
    lines, short = lined(150, 10), "one line of five words"
    rows.append((300, "\n".join(x for y in lines[:9] for x in (short, y)), "en", "src0", 0))
    # a fifth of the words is said twice
    part, rest = data.text(rnd, 20).replace("\n", " "), lined(140, 10)
    rows.append((301, "\n".join([part, *rest, part]), "en", "src0", 0))
    rows.append((302, "\n".join(" ".join(w * 2 for w in x.split()) for x in lined(150, 10)), "en", "src0", 0))
    got = {r["id"]: r for r in quality.quality(data.frame(spark, rows)).collect()}
    assert not any(got[i]["base_failed"] for i in range(303))
    assert not any(got[i]["kept"] for i in (300, 301, 302))
    assert sum(got[i]["kept"] for i in range(300)) >= 298


def test_small_groups_have_their_own_estimate(spark):
    rnd = random.Random(5)

    def shouted(i):
        # a source whose texts have symbols; elsewhere they are junk
        return " ".join(w + "#%" for w in data.text(rnd, 80 + i % 60).split())

    rows = [(i, data.text(rnd, rnd.randint(60, 200)), "en", "src0", 0) for i in range(150)]
    rows += [(i, shouted(i), "en", "code", 0) for i in range(150, 210)]
    rows += [(i, data.text(rnd, rnd.randint(60, 200)), "en", "rare", 0) for i in range(210, 220)]
    rows += [(i, shouted(i), None, "rare", 0) for i in range(220, 223)]
    got = {r["id"]: r for r in quality.quality(data.frame(spark, rows)).collect()}
    # a group of any size has an estimate of its own, drawn to its language's
    assert [{round(got[i]["share"], 3) for i in x} for x in (range(150), range(150, 210), range(210, 220))] == [{0.75}, {0.545}, {0.167}]
    assert sum(got[i]["kept"] for i in range(220)) >= 217


def test_awkward_and_empty_tables(spark):
    df = data.frame(spark)
    got = quality.quality(df)
    assert got.count() == df.count() and got.where("kept IS NULL").count() == 0
    assert got.where("base_failed AND kept").count() == 0
    assert quality.quality(df.limit(0)).count() == 0
    none = df.where("doc_id IN (3, 4, 5)")
    assert quality.quality(none).where("kept").count() == 0
    assert quality.keep_good(none).count() == 0
    assert df.where(F.lit(True)).count() == len(data.documents())
