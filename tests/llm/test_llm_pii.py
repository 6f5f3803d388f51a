"""Personal data: base spans against the plain patterns, further spans by checksum and context, edge cases."""

import hashlib
import re
import time

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from offerlens.llm import pii
from offerlens.llm.queries import QUERIES

TINY = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += sum(map(int, str(int(c) * (1 + i % 2))))
    return total % 10 == 0


def plain(text):
    """The base spans by the patterns as they are written, each over the whole text."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


pieces = st.sampled_from(["a", "b@", "@", ".", "é", "😀", "_", "+", "+1 ", "(", ")", "-", " ", "0", "1", "25", "255.", "7.", "4111111111111111", "a@b.c", "1.2.3.4"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(pieces, max_size=40))
def test_base_spans(parts):
    text = "".join(parts)
    found = pii.find_spans(text.encode())
    assert [tuple(s[:3]) for s in found if s.base] == plain(text)
    assert sorted(found, key=lambda s: (pii.KINDS.index(s.kind), s.start)) == found


def kinds(text):
    return [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text.encode())]


def test_checksums_and_context():
    assert kinds("é IBAN DE89 3704 0044 0532 0130 00 OK") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00") == []  # mod-97 fails
    assert kinds("my card 3782 822463 10005") == [("card", "3782 822463 10005")]
    assert kinds("3782 822463 10005") == kinds("my card 3782 822463 10006") == []  # no word; Luhn fails
    assert kinds("social security 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("123-45-6789") == kinds("ssn 000-45-6789") == kinds("ssn 666-45-6789") == []
    assert kinds("call (017) 555-7713") == [("phone", "(017) 555-7713")]
    assert kinds("(017) 555-7713") == kinds("part (017) 555-7713 tel") == []
    assert kinds("jo.doe (at) mail [dot] example.org!") == [("email", "jo.doe (at) mail [dot] example.org")]
    assert kinds("2001:0db8:0:0:0:ff00:42:8329") == [("ipv6", "2001:0db8:0:0:0:ff00:42:8329")]
    # Base spans stay whatever stands around them; words change their score only.
    low, plain_, high = (pii.find_spans(t.encode())[0] for t in ("version 1.2.3.4", "1.2.3.4", "server 1.2.3.4"))
    assert low.base and low.score < plain_.score < high.score
    # Further spans never overlap base ones.
    assert kinds("tel +1 (487) 555-7209") == [("phone", "+1 (487) 555-7209")]


def test_very_long_texts():
    start = time.time()
    for piece in ("a", "1", "+1     ", "a@", "1 ", "(at)", "DE12 ", "12 345 ", "a:"):
        pii.find_spans((piece * 300_000).encode())
    assert time.time() - start < 60
    text = "é" * 500_000 + " me@example.org " + "x" * 500_000
    assert kinds(text) == [("email", "me@example.org")]


SCHEMA = "doc_id bigint, text string, Kind string, PII int"


def test_rows_and_redaction(spark):
    rows = [(1, "a@b.cd and 4111 1111 1111 1111", "k", 1), (1, "a@b.cd and 4111 1111 1111 1111", "k", 1), (None, "é 1.2.3.4", None, 2), (3, None, "k", 3), (4, "", "k", 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = pii.find_pii(docs)
    assert [c.lower() for c in found.columns] == ["doc_id", "text", "kind", "pii"]
    got = sorted((r.doc_id or 0, [tuple(s)[:3] for s in r.pii]) for r in found.collect())
    both = [("email", 0, 6), ("card", 11, 30)]
    assert got == [(0, [("ip", 2, 9)]), (1, both), (1, both), (3, []), (4, [])]
    cut = sorted((r.doc_id or 0, r.text, r.n_redacted) for r in pii.redact(docs.withColumn("N_Redacted", F.lit("x"))).collect())
    assert cut == [(0, "é [IP]", 1), (1, "[EMAIL] and [CARD]", 2), (1, "[EMAIL] and [CARD]", 2), (3, None, 0), (4, "", 0)]
    assert pii.find_pii(docs.limit(0)).count() == pii.redact(docs.limit(0)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    found = QUERIES["op11_pii"](spark, TINY).collect()
    assert len(found) == len(texts)
    for r in found:
        base = plain(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii.BASE]
        assert set(listed.split(",")) <= set(r.spans.split(","))
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in found) > 0
