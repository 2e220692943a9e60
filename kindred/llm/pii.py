"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, address schemes and
words that announce an identifier. Small parsers grow each anchor to its left and right, by rules
that need no search and no retry, and validate what they found. Nothing else of the text is looked
at. Kinds in order: email, ip, card, phone (the base), then url, account.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import give_back, lean

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
DIGITS = frozenset("0123456789")
ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL, LABEL = ALNUM | frozenset("._%+-"), ALNUM | {"-"}
DIALLED = DIGITS | frozenset(" ().-")
#: Schemes of addresses; only those that carry a user (``//user:secret@host``) name a person.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "smb://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")
#: Words before an account number.
CUES = ("iban", "account number", "account no", "acct no", "ssn", "social security number", "passport no", "passport number", "tax id")
#: Letters of an IBAN's country, with the length of its number.
IBAN = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "GB": 22, "AT": 20, "BE": 16, "CH": 21, "PT": 25, "PL": 28, "IE": 22, "SE": 24, "DK": 18, "NO": 15, "FI": 18}


@lru_cache(1)
def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in DIGITS:
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, its left part not reaching below ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    n, end, labels = len(text), at + 1, 0
    while True:
        stop = end + (labels > 0)  # past the dot
        if labels and (end >= n or text[end] != "."):
            break
        first = stop
        while stop < n and text[stop] in LABEL:
            stop += 1
        if stop == first:
            break
        end, labels = stop, labels + 1
    return (start, end) if start < at and labels > 1 else None


def digits_chain(text: str, start: int) -> int:
    """End of digits with at most one blank or hyphen between them."""
    n, end = len(text), start
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def four_parts(text: str, start: int) -> tuple[int, bool] | None:
    """End of four dotted numbers, and whether each is at most 255; None if there are fewer."""
    n, end, fits = len(text), start, True
    for part in range(4):
        if part:
            if end + 1 >= n or text[end] != "." or text[end + 1] not in DIGITS:
                return None
            end += 1
        first = end
        while end < n and text[end] in DIGITS:
            end += 1
        number = text[first:end].lstrip("0")
        fits = fits and len(number) <= 3 and int(number or 0) <= 255
    return end, fits


def phone(text: str, plus: int) -> tuple[int, int] | None:
    n, end = len(text), plus + 2
    if end > n - 1 or text[plus + 1] not in DIGITS:
        return None
    while end < n and text[end] in DIALLED:
        end += 1
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4:
        return None
    return plus, end


def url(text: str, end: int, size: int) -> tuple[int, int] | None:
    """A scheme with a user and a host after it."""
    n, at = len(text), end
    while at < n and (text[at] in LOCAL or text[at] in ":~!$&'*"):
        at += 1
    if at == end or at >= n or text[at] != "@":
        return None
    host = at + 1
    while host < n and (text[host] in LABEL or text[host] == "."):
        host += 1
    while text[host - 1] == ".":
        host -= 1
    return (end - size, host) if host > at + 1 else None


def account(text: str, end: int) -> tuple[int, int] | None:
    """What a cue announces: an IBAN with the right length and remainder, or 6 to 20 digits with
    blanks and hyphens between."""
    n, at = len(text), end
    while at < n and at < end + 6 and text[at] in " :#=.":
        at += 1
    if at == end or at >= n:
        return None
    if text[at : at + 2] in IBAN:
        want, stop, kept = IBAN[text[at : at + 2]], at, ""
        while stop < n and len(kept) < want and (text[stop] in ALNUM or text[stop] == " "):
            kept += text[stop].strip()
            stop += 1
        number = kept[4:] + kept[:4]
        if len(kept) == want and kept.isalnum() and int("".join(str(int(c, 36)) for c in number)) % 97 == 1:
            return at, stop
        return None
    if text[at] not in DIGITS:
        return None
    stop = digits_chain(text, at)
    return (at, stop) if 6 <= sum(c in DIGITS for c in text[at:stop]) <= 20 else None


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every span of a text, by start and kind."""
    spans: list[tuple[int, int, int]] = []
    mail_floor = ip_floor = card_floor = 0
    for last, (what, size) in anchors().iter(text):
        if what == "digit":
            if last >= ip_floor:
                # The first digit of a run: earlier ones set the floor.
                if got := four_parts(text, last):
                    ip_floor = got[0]
                    if got[1]:
                        spans.append((1, last, got[0]))
                else:
                    ip_floor = last + 1
                    while ip_floor < len(text) and text[ip_floor] in DIGITS:
                        ip_floor += 1
            if last >= card_floor:
                card_floor = digits_chain(text, last)
                kept = [c for c in text[last:card_floor] if c in DIGITS]
                if 14 <= len(kept) <= 19 and luhn("".join(kept)):
                    spans.append((2, last, card_floor))
        elif what == "at":
            if got := email(text, last, mail_floor):
                spans.append((0, *got))
                mail_floor = got[1]
        elif what == "plus":
            if (got := phone(text, last)) and 10 <= sum(c in DIGITS for c in text[got[0] : got[1]]) <= 15:
                spans.append((3, *got))
        elif what == "scheme":
            if got := url(text, last + 1, size):
                spans.append((4, *got))
        elif got := account(text, last + 1):
            spans.append((5, *got))
    return sorted(set(spans), key=lambda s: (s[1], s[0], s[2]))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans): every row with its spans [(kind, start, end)], offsets in codepoints, end
    exclusive. Null text is empty and has no spans; repeated rows each keep theirs."""

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in find(text)] if text else []
                for text in (one.as_py() for one in batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], ["id", "text", "spans"])

    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(lean(run), "id long, text string, spans array<struct<kind:string,start:long,end:long>>")


def summarise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url, n_account) per row, without the
    text leaving its task; spans as ``kind:start:end`` by start and kind, joined by commas."""

    def run(batches):
        for batch in batches:
            counts, digests, joined = [[] for _ in KINDS], [], []
            for text in (one.as_py() for one in batch.column(1)):
                spans = find(text) if text else []
                for k, column in enumerate(counts):
                    column.append(sum(s[0] == k for s in spans))
                digests.append(hashlib.sha256(_joined([s for s in spans if s[0] < len(BASE)]).encode()).hexdigest())
                joined.append(_joined(spans))
            numbers = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers[:4], pa.array(digests, pa.string()), pa.array(joined, pa.string()), *numbers[4:]],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_url", "n_account"],
            )

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(
        lean(run),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_account long",
    )


def mask(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then
    the longest, names the whole."""
    out, end, name, start = [], 0, "", 0
    for k, a, b in [*find(text), (0, len(text) + 1, len(text) + 1)]:
        if name and a < end:
            end = max(end, b)
            continue
        if name:
            out.append(f"[{name}]")
        out.append(text[end:a])
        start, end, name = a, b, KINDS[k].upper()
    return "".join(out)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, personal data in the text replaced; null text stays null."""

    def run(texts: pa.Array) -> pa.Array:
        give_back()
        return pa.array((mask(t) if t else t for t in (one.as_py() for one in texts)), pa.string())

    return docs.withColumn(text_col, F.arrow_udf(run, "string")(F.col(text_col)))
