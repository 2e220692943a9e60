import random
import re

from kindred.llm import pii

BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
PARTS = ["@", "a", "b.", "-", "+", "1", "23", "4.", "5", " ", ".", "(", "é", "x.y@z.com", "1.2.3.4", "4111 1111 1111 1111", "+49 (30) 1234-567", "%"]


def by_pattern(text):
    found = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = [c for c in m.group() if c in "0123456789"]
            fits = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                14 <= len(digits) <= 19 and pii.luhn("".join(digits)),
                10 <= len(digits) <= 15,
            )
            if fits[kind]:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], s[0]))


def test_base_kinds_are_those_of_the_patterns():
    pick = random.Random(2)
    for _ in range(6000):
        text = "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 25)))
        assert [s for s in pii.find(text) if s[0] < 4] == by_pattern(text), text


def test_more_kinds_and_masking():
    text = "mail x.y@z.com or ssh://u:p@h.org and IBAN: DE89 3704 0044 0532 0130 00, ssn 123-45-6789."
    assert pii.mask(text) == "mail [EMAIL] or [URL] and IBAN: [ACCOUNT], ssn [ACCOUNT]."
    assert pii.mask("IBAN: DE00 3704 0044 0532 0130 00") == "IBAN: DE00 3704 0044 0532 0130 00"
    assert pii.mask("nothing at 10 o'clock") == "nothing at 10 o'clock"


def test_tables(docs_of):
    rows = [(1, "a@b.cd é a@b.cd"), (2, None), (3, ""), (1, "a@b.cd é a@b.cd"), (None, "1.2.3.4"), (4, "9" * 30000)]
    docs = docs_of(rows)
    found = sorted(pii.summarise(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_email, r.n_ip, r.spans) for r in found] == [
        (1, 2, 0, "email:0:6,email:9:15"), (1, 2, 0, "email:0:6,email:9:15"), (2, 0, 0, ""), (3, 0, 0, ""), (4, 0, 0, ""), (None, 0, 1, "ip:0:7"),
    ]
    masked = pii.masked(docs)
    assert masked.columns == docs.columns
    assert {r.text for r in masked.collect()} == {"[EMAIL] é [EMAIL]", None, "", "[IP]", "9" * 30000}
    assert pii.find_spans(docs).where("size(spans) > 0").count() == 3
    assert pii.summarise(docs.limit(0)).count() == 0
