import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import cases
from tickersieve.llm import audit


def brute(rows):
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= 10]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        own = {s: shares(c) for (x, s), c in groups.items() if x == lang}
        whole = shares(sum((c for (x, _), c in groups.items() if x == lang), Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in own.items():
            pairs = [(sum(f(p[t], q[t]) for t in kept), o) for o, q in own.items() if o != s]
            terms = [(f(p[t], whole[t]), t) for t in kept if groups[lang, s][t] and p[t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, i, v, k) for k, (v, i) in enumerate(ranked, 1) if part == "pair" or k <= 10}
    return out


def found(docs, **more):
    rows = [tuple(r) for r in audit.divergences(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, s) for i, (x, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(5)


def some(seed, n):
    pick = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeéß中" for b in "xyzÄ"]
    return [(pick.choice(["en", "de", None]), pick.choice(["a", "b", "c", "", None, "é"]), " ".join(pick.choices(words, k=pick.randrange(30))) if pick.random() < 0.9 else None) for _ in range(n)]


@pytest.mark.parametrize("bits", [64, 4, 1])
def test_matches_brute_force_whatever_digests_collide(spark, bits):
    rows = some(bits, 300)
    assert found(table(spark, rows), bits=bits) == brute(rows)


def test_small_steps_and_flushes(spark, monkeypatch):
    rows = some(9, 200)
    docs = table(spark, rows).coalesce(1)
    expected = brute(rows)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist([{"g": 1, "l": 1, "text": t} for _, _, t in rows[i : i + 20]], pa.schema([("g", pa.int64()), ("l", pa.int64()), ("text", pa.string())])) for i in range(0, 200, 20)]
    every = audit.Filter(np.full(1024, ~np.uint64(0)))
    sums = lambda parts: pa.Table.from_batches(parts).group_by("term").aggregate([("n", "sum"), ("df", "sum")]).sort_by("term").to_pylist()
    whole = sums(list(audit._terms(iter(batches), 64, every)))
    monkeypatch.setattr(audit, "PENDING", 5)
    monkeypatch.setattr(audit, "PAIRS", 3)
    parts = list(audit._terms(iter(batches), 64, every))
    assert len(parts) > 1 and sums(parts) == whole
    assert found(docs) == expected


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = some(11, 200)
    monkeypatch.setattr(audit, "_filter_of", lambda likely: audit.Filter(np.full(1024, ~np.uint64(0))))
    assert found(table(spark, rows)) == brute(rows)


def test_many_ties_rank_by_term(spark):
    rows = [("en", "a", " ".join(f"t{chr(97 + k)}" for k in range(26)))] * 10 + [("en", "b", "zz")] * 10
    assert found(table(spark, rows)) == brute(rows)


def test_awkward_and_empty(spark):
    docs = cases.awkward(spark)
    assert found(docs) == brute([(r.lang, r.source, r.text) for r in docs.collect()])
    assert found(cases.empty(spark)) == set()
    few = cases.docs(spark, [(1, "too few documents"), (2, "to keep a term")])
    assert found(few) == brute([(r.lang, r.source, r.text) for r in few.collect()])
