import hashlib
import random

import pytest

from tests.llm import cases
from tickersieve.llm import substring


def brute(rows, window):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in texts:
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            first[run] = min(first.get(run, i), i)
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed):
    """Copies, shared passages of lengths around the window, nested and overlapping repeats, periodic runs."""
    pick = random.Random(seed)
    base = cases.sentences(seed, 6, 400, (40, 160))
    rows = []
    for i in range(40):
        parts = []
        for _ in range(pick.randrange(1, 4)):
            words = pick.choice(base).split()
            a = pick.randrange(len(words))
            parts += words[a : a + pick.randrange(5, 90)]
            parts += cases.sentences(pick.randrange(10**6), 1, 10**5, (0, 12))[0].split()
        if i % 9 == 0:
            parts += ["same"] * pick.randrange(30, 80)
        rows.append((pick.randrange(30) if i % 7 == 0 else 100 + i, "\n".join(parts) if i % 2 else " ".join(parts)))
    return rows + rows[:2] + [(500, None), (501, "")]


@pytest.mark.parametrize("window,anchor", [(50, 10), (12, 4)])
def test_equals_brute_force(spark, window, anchor):
    rows = passages(window)
    found = substring.digests(cases.docs(spark, rows), window, anchor).collect()
    assert sorted(map(tuple, found)) == brute(rows, window)


def test_long_text_is_cut_into_slices_without_loss(spark, monkeypatch):
    monkeypatch.setattr(substring, "SLICE", 64)
    rows = passages(3)
    texts = substring._keyed(cases.docs(spark, rows, 1)).toArrow().combine_chunks().to_batches()[0]
    whole = [r for b in substring._anchors(texts, 12, 4) for r in b.to_pylist()]
    windows = sum(max(0, len((t or "").split()) - 11) for _, t in rows)
    assert sum(r["n"] for r in whole) == windows


def test_awkward_rows_and_repeats_are_spans(spark):
    out = substring.deduplicated(cases.awkward(spark)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(out) == 12 and by[1][0].n_words == 0 and by[2][0].kept == "" and by[7][0].n_words == 1
    assert by[10][0].n_removed == by[9][0].n_words + 8 and by[10][0].repeats[0].asDict() == {"first": 0, "stop": 328}
    assert len(by[5]) == 3 and all(r.n_removed == 0 for r in by[5])


def test_empty_table(spark):
    assert substring.digests(cases.empty(spark)).collect() == []
