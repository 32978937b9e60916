"""Properties of the per-text helpers over generated texts."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat, imatch, pii, simhash, toxicity, warc

text = st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=200)
markup = st.lists(st.sampled_from([*chat.CONTROL, "\\", ".", "n", "\n", "<", "|", ">", "[", "x"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(text, markup))
def test_escaping_is_reversible_and_leaves_no_control_string(t):
    e = chat.escape(t)
    assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", ""]), st.one_of(text, markup)), max_size=6))
def test_turns_read_back(turns):
    assert chat.read_turns("".join("".join(chat.render(r, t)) for r, t in turns)) == turns


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@._-+1 ", max_size=60))
def test_emails_equal_the_pattern(t):
    rx = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert list(pii._emails(t)) == [m.span() for m in rx.finditer(t)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="12. 5", max_size=60))
def test_addresses_equal_the_pattern(t):
    rx = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    want = [m.span() for m in rx.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    assert [(s, e) for k, s, e, _ in pii.find_spans(t) if k == "ip"] == want


@settings(max_examples=200, deadline=None)
@given(text)
def test_redaction_keeps_what_lies_outside_spans(t):
    spans = pii.find_spans(t)
    if not spans:
        assert pii.redact(t) == t


@settings(max_examples=200, deadline=None)
@given(text)
def test_fingerprints_depend_on_terms_alone(t):
    a, b = imatch.terms(t), imatch.terms("  " + t + " !")
    assert a.tolist() == b.tolist() == sorted(set(a.tolist()))
    assert simhash.simhash(t) == simhash.simhash("\t" + t.replace(" ", "  ") + "\n")


@settings(max_examples=100, deadline=None)
@given(st.lists(text, min_size=1, max_size=5))
def test_words_stay_in_their_text(texts):
    _, start, end, doc = toxicity.words_of(texts)
    assert (end > start).all() and (np.diff(doc) >= 0).all() and (not len(doc) or doc.max() < len(texts))


@settings(max_examples=100, deadline=None)
@given(text, text, st.booleans())
def test_records_parse(url, html, revisit):
    payload = None if revisit else html.encode()
    r = warc.parse_record(warc._record("7", url, payload, len(html.encode()), "d", "3" if revisit else None, "2024-01-01T00:00:00Z"))
    assert r["payload"] == payload and r["WARC-Type"] == ("revisit" if revisit else "response")
    assert r.get("WARC-Refers-To") == ("<urn:page:3>" if revisit else None)
