import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tickersieve.llm import quality, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(lines)


def fires(c, rule):
    name, by, cutoffs, below = quality.RULES[rule]
    at = dict(zip(quality.COUNTS, c))
    left, right = 1000 * at[name], [k * (at[by] if by else 1) for k in cutoffs]
    return [left < r if below else left > r for r in right]


def bound(n, k, share):
    return sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))


def brute(rows, labels, risk, level):
    """kept by row, from plain sums over the labelled rows."""
    marks = {}
    for doc_id, good in labels:
        if doc_id is not None and good is not None:
            marks[doc_id] = min(good, marks.get(doc_id, 1))
    base = [(i, lang or "", counts(text)) for i, text, lang in rows]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for _, _, c in base]
    known = [(s, c, marks[i], zlib.crc32(str(i).encode()) % 2) for (i, s, c), f in zip(base, failed) if not f and i in marks]
    policies, used = {}, {}
    for s in {k[0] for k in known}:
        tuning = [(c, good) for x, c, good, half in known if x == s and half == 0]
        if not tuning:
            continue
        offered = []
        good_all, bad_all = sum(g for _, g in tuning), sum(1 - g for _, g in tuning)
        for number, rule in enumerate(quality.RULES):
            for k in range(len(quality.RULES[rule][2])):
                hit = [g for c, g in tuning if fires(c, rule)[k]]
                good, bad = sum(hit), len(hit) - sum(hit)
                if bad and bad * good_all >= quality.LIFT * good * bad_all:
                    offered.append((good, -bad, number, k, rule))
        policies[s] = [(rule, k) for *_, k, rule in sorted(offered)]
    holdout = {s: [c for x, c, good, half in known if x == s and half == 1 and good] for s in policies}
    strata = sum(1 for v in holdout.values() if v)
    for s, path in policies.items():
        n = len(holdout[s])
        for step in range(1, len(path) + 1 if n else 0):
            k = sum(any(fires(c, rule)[j] for rule, j in path[:step]) for c in holdout[s])
            if k > n * risk or bound(n, k, risk) > level / strata:
                break
            used[s] = path[:step]
    return [not f and not any(fires(c, rule)[j] for rule, j in used.get(s, [])) for (_, s, c), f in zip(base, failed)], used


def compare(docs, labels, risk, level):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    kept, used = brute(rows, [(r.doc_id, r.quality) for r in labels.collect()], risk, level)
    got = quality.judged(docs, labels, risk, level).collect()
    mine = Counter((r.doc_id, r.stratum, *(r[c] for c in quality.COUNTS), r.kept) for r in got)
    assert mine == Counter((i, lang or "", *counts(text), k) for (i, text, lang), k in zip(rows, kept))
    return used, got


@pytest.mark.parametrize("risk, level", [(0.05, 0.1), (0.2, 0.2)])
def test_matches_brute_force_on_the_tables(spark, sf_dir, risk, level):
    used, got = compare(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"), risk, level)
    assert risk < 0.2 or used


def test_limits_false_rejections_and_catches_junk(spark):
    pick = random.Random(4)
    rows = []
    for i in range(1200):
        words = ["".join(pick.choices("abcdefgh", k=pick.randrange(3, 8))) for _ in range(60)]
        bad = i % 4 == 0
        text = " ".join(w + "##" if bad and pick.random() < 0.5 else w for w in words)
        rows.append((i, text, pick.choice(["en", "de"]), 0 if bad else int(pick.random() > 0.02)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    used, got = compare(docs, labels, 0.05, 0.1)
    assert set(used) == {"en", "de"}
    kept = {r.doc_id: r.kept for r in got}
    good = [kept[i] for i, *_, q in rows if q]
    assert sum(good) / len(good) > 0.95
    assert sum(kept[i] for i, *_ in rows if i % 4 == 0) < 30


def test_bound_is_exact():
    for n, k, share in ((10, 0, 0.1), (200, 3, 0.05), (1, 1, 0.5), (0, 0, 0.02)):
        assert math.isclose(quality.tail(n, k, share), bound(n, k, share), rel_tol=1e-9)
    assert quality.passes(149, 0, 0.02, 0.05) and not quality.passes(148, 0, 0.02, 0.05)


def test_awkward_and_empty(spark):
    docs = cases.awkward(spark)
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None), (9, 0), (10, 1), (99, 1)], "doc_id long, quality int")
    compare(docs, labels, 0.3, 0.5)
    compare(docs, labels.limit(0), 0.3, 0.5)
    assert quality.judged(cases.empty(spark), labels).count() == 0
    other = quality.judged(docs, labels, stratum=F.col("source"))
    assert other.where("stratum = ''").count() == docs.where("source is null").count()
