"""Secret scans: fixed patterns, and the guess cost of values in credential context.

Base kinds are patterns: assign (a credential's name, = or :, a value), access (AKIA keys) and hex (long lower-case runs). The
method adds a fourth, guess: a value after a credential's name in looser forms (more names, quotes, arrows, "is", any characters
but white space) whose cheapest explanation still costs an attacker at least 10**LEAST guesses. That cost is a dynamic program over
the value: the least sum, over all segmentations, of the log10 guesses of common words (by rank, with capitals and letter
substitutions), dates, repeats, keyboard or alphabet walks and brute-force spans. Placeholders such as "changeme" or "12345678" cost
little and stay out. The program is linear in the value's length, so whole values are read however long.
After a bare name ("password is ...", "login ...") prose is as likely as a secret: there spans that read like a word, by the letter
pairs of English, cost what a word of their length costs. Where a value starts with a credential's name in context, as in
"auth token: ...", the name nearest to the value counts.

Spans are code points, end exclusive. A guess span covers the value and is kept only where no base span overlaps it.
Defined cases: null and empty texts have no span (the digests are those of the empty string); repeated rows give a row each.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from mnemo.llm.common import arrow_map

KINDS = ("assign", "access", "hex", "guess")

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Names that put the value after them in credential context.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|client[ _-]?secret|credentials?|auth|bearer|login|pin)(?![A-Za-z0-9])["']?\x20*(?::|=>?|->|\x20is\x20|\x20)\x20*["'`]?([^\s"'`<>]+)""",
    re.I | re.A,
)
_HINT = re.compile(r"pass|pwd|secret|token|key|credential|auth|bearer|login|pin", re.I | re.A)

#: The least log10 guesses of a reported value, and its least length.
LEAST, SHORTEST = 10.0, 8

#: Common words of passwords by rank, commonest first; a longer list may be given to scan(). Fixed values.
WORDS = (
    "password qwerty dragon monkey letmein football baseball master login welcome admin princess sunshine shadow superman "
    "iloveyou trustno michael ashley jennifer jordan hunter harley ranger buster thomas robert soccer hockey killer george "
    "charlie andrew daniel michelle jessica nicole love secret summer winter spring autumn hello freedom whatever computer "
    "internet starwars pepper access ginger joshua matthew maggie cheese amanda mustang jesus ninja angel orange purple yellow "
    "silver golden diamond batman matrix flower tigger cookie chocolate butterfly lovely family friend friends forever happy "
    "lucky money power magic music guitar phoenix falcon eagle tiger lion bear wolf horse chicken banana apple cherry peanut "
    "coffee pizza blue green black white red pink monday friday january march april june july august september october november "
    "december spain france germany london paris berlin america canada mexico test example sample demo changeme default guest root "
    "user users public private company office server database system network service manager support temp temporary token value "
    "your none null true false placeholder redacted please enter insert here string localhost production staging development "
    "backup account client session cloud docker jenkins oracle mysql postgres windows linux ubuntu google amazon correct battery "
    "staple"
).split()
#: Substitutions of letters. Fixed values.
_LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"})
#: Rows of a keyboard, the alphabet and the digits. Fixed values.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "0123456789")
#: Walks along one row in one direction, of three keys or more.
_WALKS = {r[a:b] for row in _ROWS for r in (row, row[::-1]) for a in range(len(r)) for b in range(a + 3, len(r) + 1)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")
_BRUTE = {"lower": math.log10(26), "upper": math.log10(26), "digit": 1.0, "other": math.log10(33)}
#: Letters that follow a letter (the first of each group) in English words. Fixed values.
_PAIRS = {g[0] + b for g in (
    "aabcdefghiklmnprstuvwxyz babcdeijlmoprstuy cacehiklmorstuy dabdefghijlmnoprstuvwy eabcdefghijklmnopqrstuvwxyz fadefilmoprstuwy gabdefghilmnoprstuwy habeilmnoprstuwy "
    "iabcdefgiklmnopqrstuvxz jaeiou kabdefghilmnoprstuwy labcdefgiklmnopstuvwyz mabdefilmnopstuy nabcdefghijklmnopqrstuvwxyz oabcdefghijklmnopqrstuvwxyz pabcdefghiklmnoprstuwy "
    "qu rabcdefghiklmnopqrstuvwy sabcdefghiklmnopqrstuwy tabcdefghilmnoprstuvwxyz uabcdefgiklmnoprstvxz vaeiory wabdefhiklnorstuy xacefhiopstuy yabcdefilmnoprstuwz zaeiloyz"
).split() for b in g[1:]}
#: Least and most characters of a date.
_DATE_LEAST, _DATE_MOST = 4, 10
#: Places in a run of one character at which a segment of it may begin: no other segment reaches further into a run for less.
_RUN_STARTS = 32
#: Least and most letters of a word in prose, and its log10 guesses: a fixed part and one for each letter.
_WORD_LEAST, _WORD_MOST, _WORD_COST, _LETTER_COST = 4, 20, 1.5, 0.35
#: Marks that join words in prose; they cost a segment.
_JOINS = "-/_.'’"
#: Log10 guesses for choosing where a segment ends and what kind it is.
_SEGMENT = 0.5


def _kind(c: str) -> str:
    return "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "other"


def _follows(a: str, b: str) -> bool:
    """Whether b follows a in words: as in English, or as any letters of which one isn't ASCII."""
    return a + b in _PAIRS or a.isalpha() and b.isalpha() and not (a + b).isascii()


class Words:
    """Ranked words: log10 of a word's rank by word, and the longest word's length (at most 32 letters, longer ones are left out)."""

    def __init__(self, ranked: list[str]):
        self.rank: dict[str, float] = {}
        for place, word in enumerate(ranked):
            if 3 <= len(word) <= _RUN_STARTS:
                self.rank.setdefault(word.lower(), math.log10(place + 1))
        self.longest = max(map(len, self.rank), default=0)


_COMMON = Words(WORDS)


def guess_cost(value: str, prose: bool = False, words: Words = _COMMON) -> float:
    """The least log10 guesses over all segmentations of value; in prose with spans that read like a word.

    Every span that a kind allows is tried, however it lies in a longer one. Their number at a place is bounded, so the program is
    linear in the value's length.
    """
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    brute = [math.inf] * (n + 1)  # cheapest with a brute-force span open at the end
    run = like = 1
    kinds = [_kind(c) for c in value]
    capital = [k == "upper" for k in kinds]

    def cased(i: int, j: int) -> float:
        capitals = sum(capital[i:j])
        return math.log10(2) * (1 if capitals in (1, j - i) else capitals)

    for j in range(1, n + 1):
        c = value[j - 1]
        kind = kinds[j - 1]
        # brute force goes on within the same kind, or a span of a new kind opens
        brute[j] = min(best[j - 1] + _SEGMENT, brute[j - 1] if j > 1 and kinds[j - 2] == kind else math.inf) + _BRUTE[kind]
        cost = brute[j]
        run = run + 1 if j > 1 and value[j - 2] == c else 1
        for i in range(j - run, min(j - 2, j - run + _RUN_STARTS)):
            cost = min(cost, best[i] + _BRUTE[kind] + math.log10(j - i) + _SEGMENT)
        for i in range(j - 3, -1, -1):
            if low[i:j] not in _WALKS:
                break
            cost = min(cost, best[i] + math.log10(2 * len(_ROWS) * 10) + math.log10(j - i) + _SEGMENT)
        if c.isdigit():
            for i in range(j - _DATE_LEAST, max(-1, j - _DATE_MOST - 1), -1):
                if value[i].isdigit() and _DATE.fullmatch(value, i, j):
                    cost = min(cost, best[i] + math.log10(120 * 366 if j - i > 4 else 120) + _SEGMENT)
        for length in range(3, min(words.longest, j) + 1):
            i = j - length
            rank = words.rank.get(plain[i:j])
            if rank is not None:
                changed = sum(a != b for a, b in zip(low[i:j], plain[i:j]))
                cost = min(cost, best[i] + rank + cased(i, j) + changed * math.log10(2) + _SEGMENT)
        if prose:
            if c in _JOINS:
                cost = min(cost, best[j - 1] + _SEGMENT)
            like = like + 1 if j > 1 and _follows(low[j - 2], low[j - 1]) else 1
            for length in range(_WORD_LEAST, min(_WORD_MOST, like) + 1):
                i = j - length
                cost = min(cost, best[i] + _WORD_COST + _LETTER_COST * length + cased(i, j) + _SEGMENT)
        best[j] = cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end as text) of the fixed patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:  # each match of ASSIGN has one of these
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def ends_so_far(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The starts of ordered spans, and the greatest end up to each."""
    return [a for a, _, _ in spans], list(itertools.accumulate((b for _, _, b in spans), max))


def overlaps(starts: list[int], reach: list[int], start: int, end: int) -> bool:
    """Whether a span of ends_so_far overlaps start to end: of those that begin before its end, one ends behind its start."""
    before = bisect.bisect_left(starts, end)
    return before > 0 and reach[before - 1] > start


def added_spans(text: str, base: list[tuple[int, int, int]], least: float = LEAST, words: Words = _COMMON) -> list[tuple[int, int, int]]:
    """Spans of values in credential context that cost at least 10**least guesses and that no base span overlaps."""
    out = []
    if not _HINT.search(text):
        return out
    starts, reach = ends_so_far(base)
    at = 0
    while m := CONTEXT.search(text, at):
        names = [m]  # each in the value of the one before, at its start
        while m := CONTEXT.match(text, m.start(1)):
            names.append(m)
        at = names[-1].start(1)
        for m in reversed(names):
            start, end = m.span(1)
            while end > start and text[end - 1] in ".,;:!?)]}":
                end -= 1
            value = text[start:end]
            if len(value) < SHORTEST or overlaps(starts, reach, start, end):
                continue
            bare = not re.search(r"[:=>\"'`]", text[m.start() : start])
            # A bare value of three kinds of characters is no word of prose.
            if guess_cost(value, bare and len({_kind(c) for c in value}) < 3, words) >= least:
                out.append((start, 3, end))
                at = max(at, end)
                break
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, least: float = LEAST, ranked: list[str] = WORDS) -> DataFrame:
    """A row per document: counts by kind, the digest of its base spans and all its spans. ranked: common words, commonest first."""

    def start():
        words = Words(ranked)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")}
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = added_spans(text, base, least, words) if text else []
                for k in range(3):
                    out[("n_assign", "n_access", "n_hex")[k]].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + more))
                out["n_guess"].append(len(more))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items())], ["doc_id", *out])

        return each

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long", start)
