import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm import cases
from tickersieve.llm import fingerprint as fp


def test_edited_texts_and_likeness(spark):
    rows = [(3 * k, t) for k, t in enumerate(cases.sentences(1, 60, 5000, (0, 90)))] + [(1, None), (200, "é" * 7), (201, "same\ntext"), (202, "same\ntext")]
    out = {r.doc_id: r for r in fp.edited_fingerprints(cases.docs(spark, rows)).collect()}
    order = sorted(rows)
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, other, follow = (fp.vectors(pa.array([x])) for x in (t, edited, u))
        assert out[i].fingerprint == fp.encode(own)[0] and out[i].edited_fingerprint == fp.encode(other)[0]
        assert out[i].near_edited == fp.likeness(own, other)[0] and out[i].near_next == fp.likeness(own, follow)[0]
    assert out[201].fingerprint == out[202].fingerprint and out[201].near_next == 1.0
    long_ = [r for r in out.values() if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long_]) > 0.35 > 0.2 > np.mean([r.near_next for r in long_])


def test_order_of_paragraphs_and_incremental_changes():
    a, b, c = "one two three four", "five six", "seven"
    whole, turned, part, other = fp.vectors(pa.array([f"{a}\n{b}\n{b}\n{c}", f"{c}\n{b}\n{a}\n{b}", f"{a}\n{b}\n{b}", c]))
    assert (whole == turned).all() and (whole != part).any()
    assert (fp.insert(part, other) == whole).all() and (fp.delete(whole, other) == part).all()
    assert (fp.decode(fp.encode(whole[None])[0]) == whole).all()
    assert (fp.vectors(pa.array([a, f"{a}\n{a}"]))[0] != fp.vectors(pa.array([f"{a}\n{a}"]))[0]).any()


def test_a_chunk_gives_what_each_text_gives():
    texts = [None, "", "\n\n", "a", "a b", "a b c\nd e f g\n", " x y\tz ", "ü" * 50]
    together = fp.vectors(pa.array(texts))
    assert all((together[k] == fp.vectors(pa.array([t], pa.string()))[0]).all() for k, t in enumerate(texts))
    assert (fp.likeness(together[:2], together[1:3]) == 1).all() and fp.likeness(together[2:3], together[3:4])[0] == 0


def test_awkward_rows_and_empty_table(spark):
    out = fp.edited_fingerprints(cases.awkward(spark)).collect()
    assert len(out) == 12 and sorted(r.n_chars for r in out)[:2] == [0, 0]
    one = fp.edited_fingerprints(cases.docs(spark, [(4, "abcd")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.edited_fingerprints(cases.empty(spark)).collect() == []
    assert fp.fingerprints(cases.awkward(spark)).count() == 12


def test_a_sum_of_paragraphs_whatever_their_number():
    text = "one two three four\nfive six\n\nseven\nfive six"
    total = np.zeros_like(fp.vectors(pa.array([""]))[0])
    for line in text.split("\n"):
        total = fp.insert(total, fp.vectors(pa.array([line]))[0])
    assert (total == fp.vectors(pa.array([text]))[0]).all()
    much, half, none, round_ = fp.vectors(pa.array(["a b c\n" * 40_000, "a b c\n" * 20_000, "", "a b c\n" * 65_536]))
    assert fp.likeness(much[None], half[None])[0] > 0.999 and (much != half).any()
    assert (round_ != none).any() and fp.likeness(round_[None], none[None])[0] == 0


def test_likeness_is_near_the_cosine_of_word_triples():
    pick = random.Random(3)
    texts = cases.sentences(5, 40, 60, (150, 200))
    pairs = [(t, cases.edited(t, pick.random() / 3, pick)) for t in texts] + list(zip(texts, texts[1:]))
    for a, b in pairs:
        x, y = (Counter(tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)) for t in (a, b))
        cosine = sum(n * y[k] for k, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
        near = fp.likeness(fp.vectors(pa.array([a])), fp.vectors(pa.array([b])))[0]
        assert abs(near - cosine) < 0.3
