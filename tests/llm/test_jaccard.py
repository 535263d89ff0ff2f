import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from tickersieve.llm import graph, jaccard


def shingles(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def families(seed):
    """Near copies of several strengths, chains of small edits, a line shared by very many, short texts."""
    pick = random.Random(seed)
    rows, line = [], "this line stands in very many of the documents here"
    for base in cases.sentences(seed, 6, 3000, (12, 120)):
        for _ in range(7):
            rows.append(cases.edited(base, pick.choice([0, 0.01, 0.02, 0.03, 0.05]), pick))
        text = base
        for _ in range(6):
            text = cases.edited(text, 0.02, pick)
            rows.append(text)
    rows += [f"{line} {t}" for t in cases.sentences(seed + 1, 25, 3000, (1, 30))]
    rows += ["A b c d", "a B c d", "a b c", "", "  ", "One", "one", f"{line}", f"{line} end"]
    pick.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = families(seed)
    found = jaccard.near_copies(cases.docs(spark, rows)).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_matrix_alone_finds_every_link(spark, monkeypatch):
    """Without rounds of hubs beyond the first and with frequent tokens unknown."""
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 1)
    monkeypatch.setattr(jaccard, "FREQUENT_COUNT", 10**9)
    rows = families(5)
    assert sorted(map(tuple, jaccard.near_copies(cases.docs(spark, rows)).collect())) == brute(rows)


def test_token_sets_of_many_texts():
    texts = ["a b c d e f", "A B c d e", None, "", "x", "X", "a b c d e a b c d e"]
    tokens, at = jaccard.token_sets(pa.array(texts))
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
    assert set(tokens[at[1] : at[2]]) <= set(tokens[at[0] : at[1]]) and tokens[at[4]] == tokens[at[5]]


def test_awkward_rows_and_empty_table(spark):
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(cases.awkward(spark)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 5), (8, 1, 5), (9, 8, 9), (10, 8, 9)} <= out
    assert jaccard.near_copies(cases.empty(spark)).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (102, 102)], "a long, b long")
    found = {r.node: r.component for r in graph.components(links).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
