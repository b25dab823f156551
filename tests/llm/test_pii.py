import re

import pytest

from labframe.llm import pii

from .conftest import corpus

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            n = [int(c) for c in m[0] if c in "0123456789"]
            odd = sum(n[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in n[-2::-2])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(n) <= 19 and odd % 10 == 0) or kind == "phone" and not 10 <= len(n) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


TEXTS = ["write to a.b@mail.example.com, x@y, @z.com a@@b.c a@b.c@d.e", "a@b.c-d.e.@f.g", "1.2.3.4.5.6.7.8 and 300.1.1.1 1.2.3 0.0.0.0 001.02.3.4", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 41111111111111111111111", "+1 (555) 555-1234 +12 +1 234 567 89012 345 678", "é é é b@c.de", "no data", "+44 20 7946 0958 4111111111111111 10.0.0.1", "9" * 5000, "a" * 5000 + "@", "." * 3000 + "@x.y", "1." * 2000]


@pytest.mark.parametrize("text", TEXTS + [t for _, t in corpus() if t])
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, spans int")


def test_spans_of_a_table(spark, none):
    texts = [*TEXTS, None, ""]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in pii.spans(frame(spark, texts)).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}
    assert pii.spans(none).count() == 0


def test_obfuscated_addresses_are_added_and_failed_cards_are_not(spark):
    texts = [f"mail me: user{i}@mail.example.com today" for i in range(60)] + [f"call tel (555) 555-{1000 + i} now" for i in range(30)] + [f"phone +1 (555) 555-{1000 + i} x" for i in range(60)]
    texts += [f"contact me by mail user{i} (at) mail (dot) com please" for i in range(40)] + [f"order 41111111111111{10 + i} done" for i in range(40)] + ["card 4111111111111111"] * 60
    rows = pii.spans(frame(spark, texts)).collect()
    added = [(texts[r.doc_id], s.kind) for r in rows for s in r.spans if not s.base]
    assert sum(k == "email" for _, k in added) == 40
    assert not any(k == "card" for _, k in added)


def test_redaction(spark):
    texts = ["to a.b@mail.example.com and +1 (555) 555-1234.", None, "", "clean"]
    got = [r.text for r in pii.redacted(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["to <EMAIL> and <PHONE>.", None, "", "clean"]


def test_estimation_trusts_labelers_that_agree():
    good, bad = (1, 1, 1, 1, 1, 2, 2), (0, -1, -1, 0, -1, 2, 2)
    unsure = (0, 1, 1, 1, 1, 2, 2)
    q = pii.estimated({("email", good): 500, ("email", bad): 100, ("email", unsure): 20})
    assert q["email", good] > 0.99 and q["email", bad] < 0.1 and q["email", unsure] > 0.8


def test_the_fixed_pattern_is_weighed_by_the_others():
    good, odd = (1, 1, 1, 1, 1, 2, 2), (1, -1, -1, -1, -1, 2, 2)
    q = pii.estimated({("ip", good): 500, ("ip", odd): 50})
    assert q["ip", good] > 0.99 and q["ip", odd] < 0.5


def test_proposed_spans_keep_clear_of_base_spans():
    text = " ".join(["1.2.3.4 (555) 555-1234 x@y.com u (at) mail.com 4111 1111 1111 1112"] * 300)
    base = pii.base_spans(text)
    want = [(k, *m.span()) for k, p in pii._LOOSE.items() for m in p.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in base)]
    assert pii.proposed(text, base) == want and {k for k, *_ in want} >= {"email", "phone", "card"}


def test_repeated_rows_have_their_spans_each(spark):
    texts = ["to a.b@mail.example.com", "to a.b@mail.example.com", None, None]
    assert [len(r.spans) for r in pii.spans(frame(spark, texts)).orderBy("doc_id").collect()] == [1, 1, 0, 0]
