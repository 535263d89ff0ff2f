import random

import numpy as np

from tests.llm import cases
from tickersieve.llm import decontaminate


def slow_score(passage, item):
    best, row = 0, [0] * (len(passage) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(passage):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best


def items(n=12):
    return [(k, t) for k, t in enumerate(cases.sentences(7, n, 900, (12, 50)))]


def planted():
    pick = random.Random(4)
    rows = []
    for k, item in items():
        for share in (0, 0.08, 0.15, 0.9):
            filler = cases.sentences(pick.randrange(10**6), 2, 900, (20, 200))
            copy = cases.edited(item, share, pick).split()
            if share == 0.08:
                del copy[pick.randrange(len(copy))]
            rows.append(f"{filler[0]} {' '.join(copy).upper()}, {filler[1]}")
    # a document long enough for several passages, and one that repeats an item over and over
    rows += [" ".join([items()[3][1]] * 30), " ".join(cases.sentences(9, 60, 900, (100, 120)))]
    return list(enumerate(rows)) + [(900, None), (901, ""), (902, "a")]


def test_equals_alignment_of_every_pair(spark):
    """Every document against every item without seeds: the same decisions and scores."""
    bench = spark.createDataFrame([*items(), (50, ""), (51, None), (None, "x y z"), (52, "one two")], "item_id long, text string")
    rows = planted()
    found = {r.doc_id: r for r in decontaminate.scored(cases.docs(spark, rows), bench).collect()}
    hit = 0
    for i, t in rows:
        words = (t or "").lower().replace(",", " ").split()
        scores = {k: slow_score(words, item.split()) / len(item.split()) for k, item in items()}
        over = [k for k, s in scores.items() if s >= decontaminate.THRESHOLD]
        assert found[i].n_items == len(over), (i, scores)
        if over:
            hit += 1
            best = max(scores.values())
            assert found[i].score == best and found[i].item_id == min(k for k in over if scores[k] == best)
    assert len(found) == len(rows) and hit >= 37


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, bench = cases.docs(spark, planted()), spark.createDataFrame(items(), "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.scored(docs, bench).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert len(list(decontaminate._blocks(bench))) > 2
    assert sorted(map(tuple, decontaminate.scored(docs, bench).collect()), key=repr) == whole


def test_alignment_of_many():
    pick = np.random.default_rng(1)
    passage, item = pick.integers(1, 5, (200, 30)).astype(np.uint64), pick.integers(1, 5, (200, 12)).astype(np.uint64)
    assert decontaminate.align(passage, item).tolist() == [slow_score(a.tolist(), b.tolist()) for a, b in zip(passage, item)]


def test_awkward_rows_and_empty_tables(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    out = decontaminate.scored(cases.awkward(spark), bench)
    assert out.count() == 14 and out.where("n_items > 0").count() == 0
    assert decontaminate.scored(cases.empty(spark), bench).collect() == []
    none = decontaminate.scored(cases.awkward(spark), bench.limit(0))
    assert none.columns == out.columns and {(r.n_items, r.item_id, r.score) for r in none.collect()} == {(0, None, 0.0)}


def test_edited_single_copies_are_found(spark):
    """Each item has one copy only, with 15 to 25 % of its words changed, or a word put in after every two."""
    pick = random.Random(8)
    bench = [(k, t) for k, t in enumerate(cases.sentences(21, 60, 5000, (24, 41)))]
    rows = []
    for k, item in bench:
        words = item.split()
        if k % 3 == 2:
            words = [x for i, w in enumerate(words) for x in ([w, f"in{k}x{i}"] if i % 2 and i < len(words) - 2 else [w])]
        else:
            n = round(len(words) * pick.choice((0.15, 0.2, 0.25)))
            at = range(2, 2 + 3 * n, 3) if k % 3 else pick.sample(range(len(words)), n)
            for i in at:
                words[min(i, len(words) - 1)] = f"new{k}x{i}"
        rows.append((k, f"{cases.sentences(k + 100, 1, 5000, (20, 60))[0]} {' '.join(words)} end"))
    found = {r.doc_id: r for r in decontaminate.scored(cases.docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    scores = {k: slow_score(t.split(), bench[k][1].split()) / len(bench[k][1].split()) for k, t in rows}
    assert sum(s >= decontaminate.THRESHOLD for s in scores.values()) >= 50
    for k, score in scores.items():
        if score >= decontaminate.THRESHOLD:
            assert (found[k].n_items, found[k].item_id, found[k].score) == (1, k, score), (k, score)


def test_long_items_score_in_full():
    """Scores beyond 16 bits, and an item of 40,000 words in a narrow passage."""
    long_ = np.arange(1, 34_001, dtype=np.uint64)[None]
    narrow = long_[:, 500:560]
    assert decontaminate.align(narrow, np.arange(1, 40_001, dtype=np.uint64)[None])[0] == 60
    wide = np.concatenate([np.full((1, 33_000), 7, np.uint64), np.arange(100, 150, dtype=np.uint64)[None]], axis=1)
    assert decontaminate.align(wide, np.arange(100, 150, dtype=np.uint64)[None])[0] == 50
    assert decontaminate.align(long_[:, :1000], long_[:, :1000])[0] == 1000
