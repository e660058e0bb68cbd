"""License scans: exact phrases, and short notices with edits.

Fuzzy search. A notice of L characters may differ by up to k edits. It is cut in k + 1 pieces; by the pigeonhole
principle one of them stands unchanged in every match, so all pieces together, found by one Aho-Corasick
automaton, locate every candidate window. There the regex library matches the whole notice with at most k
errors and gives span and edits. A window is that of one place (starts that differ by k at most are one), so that
notices back to back are each found; of overlapping matches of a notice the one of fewest edits counts.

Edits must be misspellings. The words of a match are aligned with the notice's: a word that stands for another one, or that is put in
(``not``, ``font``), makes it another notice, and the word that tells licenses apart must be there: a short one with one edit, or with two letters
changed where other words are misspelt as well, a long one with half its letters; a number must be one of the notice's. A notice that is denied (``not licensed under``) is none. Where spans of different labels overlap, the one of
more unchanged characters stands. Marks that follow a Creative Commons name (nc, sa, nd, in letters or in words) become a part of its
label, and a version that follows any notice is reported with its span.

Texts are searched as words joined by single spaces: A-Z lower-cased, words are runs of letters, digits and
non-ASCII characters. A null text is empty, without words or labels. Every row gives one row, repeated ones too; extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import difflib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Phrases whose words stand consecutively, with labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices, with labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("mozilla public license version 2 0", "mpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
)
#: Words that tell a notice's license; of the marks, one is no edited form of another.
TELLING = {"mit", "apache", "gnu", "lesser", "mozilla", "nc", "sa"}
MARKS = {"nc", "sa", "nd"}
#: Words that may be put in or left out.
SMALL = {"the", "a", "an", "of", "to", "and", "in", "is", "or", "with", "any", "this", "under"}
#: What denies the notice after it, as one word or two.
DENIALS = {"not", "never", "neither", "nor", "cannot", "isn t", "aren t", "wasn t", "weren t", "not be", "never be", "not yet", "no longer", "not been", "never been"}
#: Marks of Creative Commons licenses, as they are written after their name.
WRITTEN = {
    "nc": "nc", "sa": "sa", "nd": "nd", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd", "noderivs": "nd",
    "non commercial": "nc", "share alike": "sa", "no derivatives": "nd", "no derivs": "nd", "no derivative": "nd",
}
#: One edit for so many characters of a notice.
PER_EDIT = 10

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def pieces(notice: str, edits: int) -> list[tuple[str, int]]:
    """The notice cut in edits + 1 even pieces, with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(a: str, b: str) -> int:
    """Edits between two short texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def tells(word: str, ours: list[str], theirs: list[str], noisy: bool) -> bool:
    """Whether theirs holds the telling word of ours, with one edit at most (short ones two in a noisy match, long ones half their letters); words may have been run together."""
    alike = lambda w: distance(word, w) <= (1 if len(word) < 5 else len(word) // 2) or (noisy and len(w) == len(word) > 2 and sum(x != y for x, y in zip(word, w)) == 2)
    if any(alike(w) and not (w in MARKS and word in MARKS) for w in theirs):
        return True
    return len(theirs) < len(ours) and regex.search(f"(?:{word}){{e<=1}}", "".join(theirs)) is not None


def misspelt(ours: list[str], theirs: list[str]) -> bool:
    """Whether theirs is ours with misspellings: no word stands for another one, none of weight is put in, no telling one is lost."""
    if any(w.isdigit() and w not in ours for w in theirs):
        return False
    changed = [(ours[i:j], theirs[k:m]) for tag, i, j, k, m in difflib.SequenceMatcher(None, ours, theirs, autojunk=False).get_opcodes() if tag != "equal"]
    # other words are misspelt too: it is not just a name that was put in the telling word's place
    noisy = any(w not in TELLING and w not in b for a, b in changed if b for w in a)
    for a, b in changed:
        if not a and any(len(w) > 1 and w not in SMALL for w in b):
            return False
        if a and b and not SMALL.issuperset(a + b):
            x, y = "".join(a), "".join(b)
            if distance(x, y) > max(1 + noisy, len(x) // 2):
                return False
        if any(not tells(w, a, b, noisy) for w in TELLING.intersection(a)):
            return False
    return True


def marks_after(words: list[str], at: int) -> tuple[str, int]:
    """The marks of a Creative Commons license from words[at] on, joined, and the word after them; a lone nd adds no label."""
    found: list[str] = []
    while at < len(words):
        two = WRITTEN.get(" ".join(words[at : at + 2]))
        one = WRITTEN.get(words[at])
        if not (two or one):
            break
        found.append(two or one)
        at += 2 if two else 1
    return ("" if found == ["nd"] else "-".join(m for m in ("nc", "nd", "sa") if m in found)), at


def version_after(words: list[str], at: int) -> str:
    """The version that stands at words[at]: numbers, after ``version`` or ``v`` or at once; empty if there is none."""
    if at < len(words) and words[at] in ("version", "v"):
        at += 1
    out = [w for w in itertools.takewhile(lambda w: w.isdigit() and len(w) <= 2, words[at : at + 3])]
    return ".".join(out)


def undisplaced(spans: list[tuple], labels: list[str]) -> list[tuple]:
    """The spans (weight, start, end, notice, edits) that none of more weight and another label overlaps."""
    held: dict[int, list[tuple[int, int]]] = {}  # by notice, whose spans are disjoint
    out = []
    for _, group in itertools.groupby(sorted(spans, key=lambda s: (-s[0], *s[1:])), key=lambda s: s[0]):
        # equal weights do not displace each other
        fresh = [x for x in group if not any(labels[k] != labels[x[3]] and meets(places, x[1], x[2]) for k, places in held.items())]
        for _, start, end, which, _ in fresh:
            bisect.insort(held.setdefault(which, []), (start, end))
        out += fresh
    return out


def places(text: str) -> list[int]:
    """Where the spaces of text stand: as many as words begin before a place lie below it."""
    return [m.start() for m in regex.finditer(" ", text)]


def meets(places: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the places, disjoint and sorted, overlaps start to end."""
    at = bisect.bisect_left(places, (end,))
    return at > 0 and places[at - 1][1] > start


class Scanner:
    def __init__(self, phrases: tuple, notices: tuple, per_edit: int) -> None:
        self.phrases = [(f" {p} ", label) for p, label in phrases]
        self.notices = [(n, label, max(1, len(n) // per_edit)) for n, label in notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n, special_only=True)}){{e<={k}}}") for n, _, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list] = {}
        for which, (n, _, k) in enumerate(self.notices):
            for piece, offset in pieces(n, k):
                at.setdefault(piece, []).append((which, offset))
        for piece, places in at.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def exact(self, padded: str) -> list[tuple[int, str]]:
        """(start in words, label) of each phrase; padded begins and ends with a space."""
        out = []
        for phrase, label in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = padded.find(phrase, at + 1)
        spaces = places(padded) if out else []
        return [(bisect.bisect_left(spaces, at), label) for at, label in out]

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Candidate windows [start, end] of each notice, one for starts that differ by its edits at most."""
        found: dict[int, set[int]] = {}
        for end, (size, places) in self.seeds.iter(text):
            for which, offset in places:
                found.setdefault(which, set()).add(end + 1 - size - offset)
        out: dict[int, list[list[int]]] = {}
        for which, starts in found.items():
            n, _, k = self.notices[which]
            places, first = [], None
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(text), s + len(n) + k)
                if first is not None and s - first <= k:
                    places[-1][1] = b
                else:
                    places.append([a, b])
                    first = s
            out[which] = places
        return out

    def own(self, notice: str, found: str, before: str) -> bool:
        """Whether found (whole words) is the notice with misspellings, and what stands before it doesn't deny it."""
        last = before.split()[-2:]
        return not (DENIALS & {" ".join(last), *last[-1:]}) and misspelt(notice.split(), found.split())

    def fuzzy(self, text: str) -> list[dict]:
        """Spans of the notices: label, first and last word, edits, score."""
        spans = []
        for which, windows in self.windows(text).items():
            n = self.notices[which][0]
            matches = {(m.start(), m.end(), sum(m.fuzzy_counts)) for a, b in windows if (m := self.patterns[which].search(text, a, b))}
            held: list[tuple[int, int]] = []  # disjoint and sorted
            for start, end, edits in sorted(matches, key=lambda x: (x[2], x[0], x[1])):
                if meets(held, start, end):
                    continue
                bisect.insort(held, (start, end))
                first_char, last_char = start + (text[start] == " "), end - (text[end - 1] == " ")
                begin = text.rfind(" ", 0, first_char) + 1
                around = text[begin : e if (e := text.find(" ", last_char)) >= 0 else len(text)]
                if self.own(n, around, text[max(0, begin - 24) : begin]):
                    spans.append((len(n) - edits * PER_EDIT, start, end, which, edits))
        out, labels = [], [label for _, label, _ in self.notices]
        spaces, words = (places(text), text.split(" ")) if spans else ([], [])
        for _, start, end, which, edits in undisplaced(spans, labels):
            first = bisect.bisect_left(spaces, start + (text[start] == " "))
            last = bisect.bisect_left(spaces, end - (text[end - 1] == " "))
            n, label = self.notices[which][:2]
            marks, after = marks_after(words, last + 1) if label == "cc-by" else ("", last + 1)
            numbers = regex.findall(r" (\d+)", n)
            version = ".".join(numbers) or version_after(words, after)
            out.append({"label": f"{label}-{marks}" if marks else label, "first_word": first, "last_word": after - 1, "edits": edits, "score": round(1 - edits / len(n), 6), "version": version})
        return sorted(out, key=lambda s: (s["first_word"], s["last_word"], s["label"], s["edits"]))

    def marked(self, base: list[tuple[int, str]], joined: str, spans: list[dict]) -> list[dict]:
        """Spans of exact Creative Commons names with their marks, where no notice has told more."""
        out, words = [], joined.split(" ") if any(label == "cc-by" for _, label in base) else []
        held = [(s["first_word"], s["last_word"] + 1) for s in spans]
        for start, label in base:
            marks, after = marks_after(words, start + 2) if label == "cc-by" else ("", 0)
            if marks and not any(a <= start < b for a, b in held):
                out.append({"label": f"cc-by-{marks}", "first_word": start, "last_word": after - 1, "edits": 0, "score": 1.0, "version": version_after(words, after)})
        return out

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        joined = b" ".join(words).decode("utf-8", "replace")
        base, spans = self.exact(f" {joined} "), self.fuzzy(joined)
        spans = sorted(spans + self.marked(base, joined, spans), key=lambda s: (s["first_word"], s["last_word"], s["label"]))
        starts, labels = [s for s, _ in base], {x for _, x in base}
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {s["label"] for s in spans})),
            "score": 1.0 if base else max((s["score"] for s in spans), default=0.0),
            "spans": spans,
        }


@lru_cache(maxsize=4)
def scanner(phrases: tuple = PHRASES, notices: tuple = NOTICES, per_edit: int = PER_EDIT) -> Scanner:
    return Scanner(phrases, notices, per_edit)


_FIELDS = (
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("score", pa.float64()), ("version", pa.string())]))),
)
_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, spans array<struct<label:string, first_word:long, last_word:long, edits:long, score:double, version:string>>"
)


def scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES, per_edit: int = PER_EDIT) -> DataFrame:
    """docs(doc_id, text) to the row's figures, labels and fuzzy spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scanner(phrases, notices, per_edit)
        for batch in batches:
            rows = [one.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array([r[name] for r in rows], kind) for name, kind in _FIELDS)],
                names=["doc_id", *(name for name, _ in _FIELDS)],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
