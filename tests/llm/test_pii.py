"""Spans against the plain patterns, checksums, context, redaction."""

import hashlib
import random
import re

from tablefill.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None,
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "..", "-", "+", "1", "255", "256", "0001", "4111 1111 1111 1111", "4111111111111111", " ", "(", ")",
             "x@y.zz", "10.0.0.1", "+1 (555) 010-9999", "é", "\n", "@@", "%", "99"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert sorted(pii.base_spans(text)) == plain(text), text


def test_method_kinds_need_checksum_or_context():
    ok, bad = "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"
    assert [pii.KINDS[k] for _, k, _, _ in pii.find_spans(f"pay to {ok}") if k >= 4] == ["iban"]
    assert not [k for _, k, _, _ in pii.find_spans(f"pay to {bad}") if k >= 4]
    assert not pii.find_spans("part 123-45-6789")
    assert [pii.KINDS[k] for _, k, _, _ in pii.find_spans("ssn 123-45-6789")] == ["national_id"]


def test_redaction():
    assert pii.redact_text("mail x@y.zz, host 10.0.0.1") == "mail [EMAIL], host [IP]"
    assert pii.redact_text("none") == "none"
    assert "@" not in pii.redact_text("1.2.3.4@a.bc 4111111111111111@d.ef")


def test_awkward_rows(awkward, nothing, collect):
    got = collect(pii.pii_report(awkward))
    assert len(got) == awkward.count() and all(r.spans == "" for r in got)
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pii.pii_report(nothing).count() == 0
    redacted = {r.doc_id: r.redacted for r in pii.with_redacted(awkward).collect()}
    assert redacted[1] is None and redacted[2] == ""


def test_offsets_are_code_points(table):
    r = pii.pii_report(table([(1, "é👍 x@y.zz 10.0.0.1")])).first()
    assert r.spans == "email:3:9,ip:10:18" and (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 0)
    assert r.base_sha256 == hashlib.sha256(b"email:3:9,ip:10:18").hexdigest()
