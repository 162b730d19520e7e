"""Personal data: base patterns, and disguised forms through offset-preserving transducers.

A transducer rewrites a text and keeps, for each character it writes, the span of source characters that it came from.
Three run in turn: homoglyphs to ASCII, spelled digits to digits, `at` and `dot` disguises to @ and full stop. Each is linear in the text. The same patterns
are then searched in the rewritten text, and what they find is mapped back to the source.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import on_texts

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# a run of digits is tried from its start alone, as any match in it begins there; possessive, so each start costs its match
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "﹢": "+", " ": " ", " ": " ", " ": " ",
}
HOMOGLYPHS |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}  # full-width forms
HOMOGLYPHS |= {chr(base + d): str(d) for base in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
#: One character for one: places stay as they are.
PLAIN = str.maketrans(HOMOGLYPHS)
#: Written between characters to break them up; they vanish.
INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")

# Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "plus": "+"}
DIGIT_WORD = "|".join(sorted(set(SPELLED) - {"plus"}, key=len, reverse=True))
HIDDEN_NUMBER = re.compile(rf"(?<![A-Za-z])(?:{DIGIT_WORD})(?![A-Za-z])|[0-9] (?:point|dot) [0-9]", re.I)
#: What a spelled number is made of; written digits are taken as they stand, in one piece.
NUMERAL = re.compile(rf"(?<![A-Za-z0-9])(?:(?P<digit>{DIGIT_WORD}|[0-9]++)|plus|point|dot)(?![A-Za-z0-9])", re.I)
BETWEEN = re.compile(r"[ ,.-]{1,2}")
#: So many numerals in a row are a number; fewer stay words.
LEAST = 4

#: `name at host dot tld`: what stands for @ and for a full stop, in brackets or between spaces.
OPEN, SHUT = r"\s{0,9}[\[({<]\s{0,9}", r"\s{0,9}[\])}>]\s{0,9}"
AT_SIGN = re.compile(rf"(?P<bracket>{OPEN}(?:at|@|arroba|ät|chez){SHUT})|(?P<bare>(?<=[A-Za-z0-9_%+-])\s{{1,9}}(?:at|arroba)\s{{1,9}}(?=[A-Za-z0-9]))|(?P<sign>(?<=[A-Za-z0-9_%+-])\s{{0,9}}@\s{{0,9}}(?=[A-Za-z0-9]))", re.I)
STOP = rf"(?:{OPEN}(?:dot|point|punkt|punto|\.){SHUT}|\s{{1,9}}(?:dot|punto|punkt|point)\s{{1,9}}|\.)"
STOPS = re.compile(STOP, re.I)
#: Without any of these there is no disguise; a quick look before the patterns.
STOP_WORDS, NUMBER_WORDS = ("dot", "point", "punkt", "punto"), (*(w for w in SPELLED if w != "plus"), "point", "dot")
BRACKET = re.compile(r"[\[({<]\s{0,9}(?:at|arroba|ät|chez|\.)", re.I)
HOST = re.compile(rf"([A-Za-z0-9-]+)((?:{STOP}[A-Za-z0-9-]+)+)", re.I)
NAME = re.compile(rf"(?P<stop>{STOP})|(?P<word>[A-Za-z0-9_%+-]+)", re.I)
#: Longest name and host that are looked for, disguises included; an address has 64 and 255 characters at most.
NAME_ROOM, HOST_ROOM = 400, 1200
# Last labels, besides those of two letters, that make an address without any brackets.
LABELS = frozenset("com org net edu gov mil int info biz name pro mobi asia dev app xyz online site shop store tech blog cloud email live news world art top club io".split())
# Words of two letters that no country has as its label.
NO_COUNTRY = frozenset("ah an eh ex go ha he hi ho if of oh ok on or ox up we yo".split())
# What stands before `at` in plain prose, and hosts that are no names.
BEFORE_AT = frozenset("a aim aimed all am and are arrive arrived available back be been bought buy check chat click come dine down eat find found get go going good great had have he her here him home i is it join joined laugh learn live lived look looked looking looks me meet met more not now on online only open or order out park play posted price read right sale see seen she shop shopping show sold stare start stay stayed stop store that them there they time us visit wait was we were what where who work worked working works you".split())
NO_HOST = frozenset("a all an any best first her his home last least most my night noon once one our that the their this times work your".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        # every start left of this @ fails or succeeds with it, so the leftmost is as far as local characters go
        begin = at
        while begin > floor:
            step = LOCAL.search(text, max(floor, begin - 256), begin).start()
            if step == begin:
                break
            begin = step
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> list[tuple[str, int, int]]:
    """kind, begin, end in code points, by kind and place: leftmost matches that don't overlap, less those that fail their test."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


class Tape:
    """A text and where each of its characters came from."""

    def __init__(self, text: str):
        self.text = text
        self.begin = np.arange(len(text))
        self.end = self.begin + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces disjoint spans, in order; each written character stands for its whole span."""
        if not edits:
            return
        text, begin, end, last = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[last:a])
            begin.append(self.begin[last:a])
            end.append(self.end[last:a])
            if new and b > a:
                text.append(new)
                begin.append(np.full(len(new), self.begin[a]))
                end.append(np.full(len(new), self.end[b - 1]))
            last = b
        self.text, self.begin, self.end = "".join(text), np.concatenate(begin), np.concatenate(end)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.begin[a]), int(self.end[b - 1])


def spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits that write spelled digits as digits, in numbers of LEAST numerals and more."""
    low = text.lower()
    if not any(w in low for w in NUMBER_WORDS) or not HIDDEN_NUMBER.search(text):
        return []
    edits: list[tuple[int, int, str]] = []
    run: list[re.Match] = []

    def out():
        while run and not run[-1]["digit"]:
            run.pop()
        while run and not run[0]["digit"] and run[0].group().lower() != "plus":
            run.pop(0)
        if len(run) >= LEAST:
            for before, m, after in zip([None, *run[:-1]], run, [*run[1:], None], strict=True):
                word = m.group().lower()
                if not word[0].isdigit():
                    begin, end = m.span()
                    if before is not None and before.group()[0].isdigit() and word not in SPELLED:
                        begin = before.end()  # a spelled stop takes the space on both sides along
                    if after is not None and "." not in text[end : after.start()]:
                        end = after.start()
                    edits.append((begin, end, SPELLED.get(word, ".")))
        run.clear()

    for m in NUMERAL.finditer(text):
        if run and not (m.start() - run[-1].end() <= 2 and BETWEEN.fullmatch(text, run[-1].end(), m.start())) or m.group().lower() == "plus":
            out()
        run.append(m)
    out()
    return edits


def name_before(text: str, floor: int, end: int) -> int:
    """Where the name that ends at `end` begins; `end` if there is none."""
    begin = edge = end
    word_due = True
    for m in reversed(list(NAME.finditer(text, max(floor, end - NAME_ROOM), end))):
        if m.end() != edge or (m["word"] is not None) != word_due:
            break
        edge = m.start()
        if word_due:
            begin = edge
        word_due = not word_due
    return begin


def addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that write disguised addresses plainly."""
    low = text.lower()
    if "@" not in text and not any(w in low for w in STOP_WORDS) and not (any(c in text for c in "[({<") and BRACKET.search(text)):
        return []  # no sign, nor what could stand for one
    edits, floor = [], 0
    for at in AT_SIGN.finditer(text):
        if at.start() < floor:
            continue
        host = HOST.match(text, at.end(), at.end() + HOST_ROOM)
        if not host:
            continue
        rest = host.group(2)
        label = re.split(r"[^A-Za-z0-9-]+", rest)[-1].lower()
        if not re.fullmatch(r"[a-z]{2,}", label):
            continue
        hidden = STOPS.sub(lambda m: "" if m.group() == "." else "#", rest).count("#")
        if at["sign"] and at.group() == "@" and not hidden:
            continue  # as plain as can be, on this side
        begin = name_before(text, floor, at.start())
        if begin == at.start():
            continue
        name = text[begin : at.start()]
        if at["bare"]:
            if not hidden or label not in LABELS and (len(label) != 2 or label in NO_COUNTRY):
                continue
            if name.lower() in BEFORE_AT or host.group(1).lower() in NO_HOST:
                continue
        plain = lambda s: STOPS.sub(".", s)
        edits.append((begin, host.end(), plain(name) + "@" + host.group(1) + plain(rest)))
        floor = host.end()
    return edits


def disguised(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find after the transducers, at its place in the source; empty where no disguise occurs."""
    plain = text if text.isascii() else text.translate(PLAIN)
    tape = None
    for find_edits in (lambda t: [(m.start(), m.end(), "") for m in INVISIBLE.finditer(t)] if not text.isascii() else [], spelled, addresses):
        if edits := find_edits(plain if tape is None else tape.text):
            tape = tape or Tape(plain)
            tape.rewrite(edits)
    if tape is not None:
        return [(kind, *tape.source(a, b)) for kind, a, b in base(tape.text)]
    return base(plain) if plain != text else []


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all: those and disguised ones, by kind and place."""
    if not text:
        return [], []
    first = base(text)
    extra = set(disguised(text)).difference(first)
    return first, sorted([*first, *extra], key=lambda s: (KINDS.index(s[0]), s[1:])) if extra else first


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_disguised for each row of docs(doc_id, text).

    Offsets count code points, ends exclusive. A null text is empty and has none; repeated rows give repeated
    rows; a null doc_id stays null; other columns aren't read. A disguised span may overlap a base one of its kind, never equal it."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(t) for t in b.column("text").to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in one) for one, _ in found], pa.int64()) for k in KINDS]
        sha = [hashlib.sha256(written(one).encode()).hexdigest() for one, _ in found]
        more = pa.array([len(every) - len(one) for one, every in found], pa.int64())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([written(e) for _, e in found], pa.string()), more], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return on_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span's place taken by its kind in angle brackets; of overlapping spans the first stands for all."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask(docs: DataFrame) -> DataFrame:
    """The rows of docs with the spans of `text` masked; all other columns as they are, a null text stays null."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        new = [t and masked(t, find(t)[1]) for t in b.column("text").to_pylist()]
        return b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, pa.string()))

    return on_texts(docs, run, docs.schema)
