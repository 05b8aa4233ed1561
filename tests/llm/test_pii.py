import hashlib
import re
import time

from graphloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def holds(kind, x):
    digits = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def base(text):
    found = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        found += [(m.start(), no, kind, m.end()) for m in re.finditer(pattern, text or "") if holds(kind, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


TEXTS = [
    None, "", "mail a.b@c-d.org, 😀 x@y.z@w.v and a@b.c_d@e.f now", "at 1.2.3.4.5.6.7.8 or 999.1.1.1, 01.002.3.255 and 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 4337166598464399.", "call +1 (456) 555-2186 or +49 30 1234567, +12 3 and +1234567890123456",
    "a@b a@.b @b.c .@x.y %+-@z.w trailing@dot.com.", "0000000000000000 +0 00000000 " * 3, "é1.1.1.1é +33(0)123456789)", "9" * 5000, "a@b.c " * 300, " x@y.zz  1.1.1.1",
]


def test_base_equals_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        want = base(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (TEXTS[r["doc_id"]], want, r["spans"])
        kinds = [s.split(":")[0] for s in want.split(",") if s]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [kinds.count(k) for k in pii.KINDS]
        assert set(want.split(",")) - {""} <= set(r["spans"].split(","))


def test_added_spans(spark):
    """What the labelers agree on is added, what they refuse is not, and base spans stay."""
    good = [f"Please call my phone (21{i}) 555-010{i} today, or email jane{i}@mail.com soon, phone +1 212 555 01{i}9" for i in range(10)]
    bad = [f"In version 4111 1111 1111 111{i} of table {i} see build 300.2.3.{i} and order 12345678901{i}" for i in range(2, 10)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    assert all(r["n_added"] == 1 and r["added"].startswith("phone:21:") for d, r in rows.items() if d < 10)
    assert all(r["n_added"] == 0 for d, r in rows.items() if d >= 10)


def test_odd_rows(odd, nothing):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == odd.count() and all(r["spans"] == "" for r in rows)
    assert pii.personal_data(nothing).count() == 0


def wide(text):
    """Further candidates by brute force: matches of wide patterns, and of strict ones that checks refused, clear of base spans."""
    text, out = text or "", []
    own = [(m.start(), m.end()) for kind, p in BASE.items() for m in re.finditer(p, text) if holds(kind, m.group())]
    for no, kind in enumerate(pii.KINDS):
        found = [m.span() for m in re.finditer(BASE[kind], text) if not holds(kind, m.group())] + [m.span() for m in re.finditer(pii.WIDE[kind], text)]
        out += [(a, no, kind, b, text[a:b], text[max(0, a - pii.BEFORE) : a]) for a, b in found if not any(a < d and c < b for c, d in own)]
    return sorted(out)


def test_candidates_equal_patterns(spark):
    texts = [*TEXTS, "write to jane (at) mail (dot) com, or joe[at]x[dot]y.org", "2001:0db8:85a3:0000:0000:8a2e:0370:7334 and (212) 555-0199 or 212-555-0199", "4111.1111.1111.1111 4111_1111_1111_1111 300.1.1.1", "+1 2 " * 700 + "a@b.cc 1.2.3.999 " * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') AS text")
    for r in pii.with_candidates(df).collect():
        assert [(s["start"], s["no"], s["kind"], s["stop"], s["match"], s["before"]) for s in r["wide"]] == wide(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_very_long_text(spark):
    """Fifty thousand matches and more in one text, in time that grows with them."""
    text = "".join(f"user{i}@mail{i % 7}.com, 10.0.{i % 256}.{i % 400} or +49 30 {1000000 + i}; " for i in range(50_000))
    df = spark.createDataFrame([(1, text, "x", 0, "y")], "doc_id long, text string, base string, kind int, wide string")
    began = time.time()
    (row,) = pii.personal_data(df).collect()
    assert time.time() - began < 90
    assert row["n_email"] == row["n_phone"] == 50_000 and row["base_sha256"] == hashlib.sha256(base(text).encode()).hexdigest()
