import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tickersieve.llm import pii
from tickersieve.llm.queries import op10_pii, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if passes(kind, m[0])]
    return [f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in sorted(found)]


def base(text):
    return [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.find(text) if k < len(PATTERNS)]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a1.@+- (94é%"), max_size=40) | st.text(st.sampled_from("0123456789 -.+"), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == brute(text)


def test_long_numbers_and_runs():
    for text in ("9" * 50000, "1." * 20000, "a" * 20000 + "@b.c", "@" * 20000, "+1" + "2 " * 20000, "0000000255.1.1.1", "1.2.3.4.5.6.7.8", "4" + "0" * 5000 + ".1.1.1"):
        if len(text) < 4000 or not re.search(r"[0-9]{4000}", text):
            assert base(text) == brute(text)
        else:
            pii.find(text)


def test_expanded_spans():
    text = 'See (https://a.example/x?y=1). token = "b44e15e09fd311c3cf3163b66d5a" IBAN: GB82 WEST 1234 5698 7654 32, account no 12-345-678; mail a.b@c.example'
    found = {(pii.KINDS[k], text[s:e]) for s, k, e in pii.find(text)}
    assert {("url", "https://a.example/x?y=1"), ("secret", "b44e15e09fd311c3cf3163b66d5a"), ("account", "GB82 WEST 1234 5698 7654 32"), ("account", "12-345-678"), ("email", "a.b@c.example")} <= found
    assert not any(k >= 4 for _, k, _ in pii.find("IBAN GB00 WEST 1234 5698 7654 32, token of love, discount 12345678"))


def test_the_given_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    out = op10_pii(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        wanted = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in wanted) for k in PATTERNS]
        assert set(wanted) <= set(r.spans.split(",")) or not wanted


def test_awkward_rows_and_empty_table(spark):
    out = pii.personal_data(cases.awkward(spark)).collect()
    assert len(out) == 14 and {(r.n_email, r.spans) for r in out} == {(0, "")}
    assert pii.personal_data(cases.empty(spark)).collect() == []
