import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import collocations, shares

from . import data


def brute(rows, least=10, covered=50, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    counts = {}
    for text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        known = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        found = []
        for k, a in known.items():
            if any(len(o) > len(k) and 100 * b >= covered * a and any(o[i : i + len(k)] == k for i in range(len(o))) for o, b in known.items()):
                continue
            cuts = [(int(Fraction(1_000_000 * a * a, f[k[:c]] * f[k[c:]])), c, f[k[:c]], f[k[c:]]) for c in range(1, len(k))]
            score, _, l, r = min(cuts)
            found.append((-score, -a, " ".join(k).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(spark, df, **more):
    return sorted(tuple(r) for r in collocations.collocations(df, "lang", "text", **more).collect())


@pytest.mark.parametrize("size,at_once", [(1 << 24, 1 << 18), (3000, 50)])
def test_awkward_documents(spark, monkeypatch, size, at_once):
    monkeypatch.setattr(collocations, "AT_ONCE", at_once)
    monkeypatch.setattr(shares, "SHARE", size)
    rows = data.documents()
    got = run(spark, data.frame(spark), least=3)
    assert got and got == brute([(t, lang) for _, t, lang, *_ in rows], least=3)


def test_random_texts_with_repeats_and_overlaps(spark):
    rnd = random.Random(11)
    letters = ["a", "b", "B", "é", "x\x00y", "-", "#"]
    rows = [("".join(rnd.choice(letters) + rnd.choice([" ", "  ", "\t", ". ", "\n", "\x0b", " "]) for _ in range(rnd.randint(0, 200))), rnd.choice(["en", "de", None, ""])) for _ in range(80)]
    rows += [("a a a a a a a a a a a a", "en"), ("", "none"), (None, "none"), ("...", "none")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    for least, covered, top in ((10, 50, 2000), (2, 30, 7), (1, 100, 10)):
        assert run(spark, df, least=least, covered=covered, top=top) == brute(rows, least, covered, top)


def test_empty(spark):
    assert run(spark, data.frame(spark, [])) == []


def test_scores_beyond_64_bits(spark):
    big = 10**14
    row = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long").select(collocations._score(*map(collocations.F.col, ("a", "l", "r")))).first()
    assert row[0] == 10**6 * big * big // (big * (big + 1))


def test_bitmaps_are_compressed_and_follow_positions():
    rnd = np.random.default_rng(1)
    numbers = rnd.integers(-1, 4, 500)
    maps = collocations.Bitmaps(numbers, 4)
    assert maps.mask.all() and len(maps.word) <= (numbers >= 0).sum()
    found = Counter()
    for word, byte, mask in maps.roots():
        first, second, _, both = maps.extended(word, byte, mask)
        for a, b, n in zip(first, second, np.bitwise_count(both), strict=True):
            found[a, b] += int(n)
    assert found == Counter((a, b) for a, b in zip(numbers, numbers[1:], strict=False) if a >= 0 and b >= 0)
