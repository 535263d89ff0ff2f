import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tickersieve.llm import variants


def brute(rows):
    """word -> (form, root, n, n_near, form_n), by comparing all pairs."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def found(docs, **more):
    rows = variants.variants(docs, **more).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=5, max_size=8), min_size=2, max_size=30, unique=True))
def test_index_finds_each_near_pair_in_one_bucket(words):
    seen = Counter()
    for m in range(5, 9):
        for ends in (False, True):
            buckets = {}
            for w in words:
                if len(w) in (m, m + 1):
                    buckets.setdefault(w[len(w) - m // 2 :] if ends else w[: m // 2], []).append((w, 1))
            for members in buckets.values():
                table = variants.Index([w for w, _ in members])
                for w, _ in members:
                    hits = table.near(w, m, m // 2, ends)
                    seen.update((w, v) for j, (v, _) in enumerate(members) if hits >> j & 1)
    assert seen == Counter((a, b) for a in words for b in words if one_edit(a, b))


@pytest.mark.parametrize("block", [4096, 3])
def test_matches_brute_force(spark, sf_dir, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute(rows)
    assert any(v[0] for v in expected.values())
    assert found(docs, block=block) == expected


def test_chains_and_ties(spark):
    texts = {"abcdef": 6, "abcdeg": 14, "abcdeh": 14, "abcdehi": 30, "xbcdehi": 75, "xbcdeh": 27}
    docs = cases.docs(spark, [(i, w) for w, n in texts.items() for i in range(1000, 1000 + n)])
    got = found(docs)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got["abcdeh"][:2] == ("abcdehi", "xbcdehi") and got["abcdef"][0] == "abcdeg" and len(got) == 6


def test_awkward_and_empty(spark):
    docs = cases.awkward(spark)
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    long_word = "y" * 20_000
    docs = cases.docs(spark, [(i, f"{long_word} {long_word[1:]}") for i in range(1, 5)])
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(cases.empty(spark)) == {}
