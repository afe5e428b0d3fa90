"""Benchmark decontamination by template canonicalisation.

Words lose punctuation at their edges and become tokens: numbers, units and names turn into typed placeholders, other words are
lower-cased. Windows of eight tokens of a benchmark item are its templates; a document's windows meet them by hash, so a question
whose numbers and names were changed still matches. Hits on one alignment of a document with an item must then be consistent: each
slot value of the item goes to one value of the document throughout; windows that contradict earlier ones are dropped. A document
is contaminated by an item if the accepted windows cover 13 of its tokens, or half of them if that is less.

Items of one template (the same tokens, and slots alike in the same places) are one class, met once whatever their number. A window
that more than SHARED classes of a block have is common: a stem that many questions open with, say. Common windows extend a match
but don't start one, so a stem alone finds none of its questions. What starts one are the other windows of a class; 13 consecutive
tokens made of common windows only, so that a passage shared by many items is found; an exact window (below); and, for a class whose
windows are all common, those that the fewest classes have.

The benchmark is held in blocks of bounded size, each broadcast in turn and met by all documents in one pass without a shuffle; a
larger benchmark means more passes, nothing else. Templates of fewer than four literal tokens match anything and aren't used; an
item of four to seven tokens is one template; one of fewer than four has none. Windows without a template are met by the hash of
their words instead, lower-cased and unreplaced, and so is an item of fewer than four tokens as one window: these are exact copies
only. They count where the templates alone don't cover enough of an item, so a copy of an item is found whatever its words are,
and what templates find is reported as they cover it. An item of punctuation only contaminates nothing.

Defined cases: null and empty texts match nothing, nor do null items; repeated documents give their rows each, items alike in
item_id and text count once; other columns are not used by contaminated() and passed on by clean().
"""

from __future__ import annotations

import re
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import MEMO_WORDS, Windows, arrow_map, texts

WINDOW, FEWEST, LITERALS = 8, 4, 4
ENOUGH_TOKENS, ENOUGH_SHARE = 13, 0.5
#: A window that more templates of a block have is common: it starts no match.
SHARED = 8
#: A block of the benchmark: items and characters.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000

_EDGES = " .,;:!?\"'()[]{}<>*#$%&|-_`~=/\\@^"
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|k|m|bn)?", re.I)
# Words for numbers, and units.
_NUMBERS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_UNITS = set(
    "mm cm km m meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards g kg mg gram grams kilogram kilograms "
    "pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds minute minutes min hour hours day days week weeks month months "
    "year years dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit kelvin watt watts volt volts joule joules newton newtons mph kph hz".split()
)
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
_PLACES = (NUM, UNIT, NAME)


def token(word: str) -> str:
    """The canonical token of a word; empty if it is punctuation only."""
    bare = word.strip(_EDGES)
    if not bare:
        return ""
    low = bare.lower()
    if low in _NUMBERS or _NUMBER.fullmatch(bare):
        return NUM
    if low in _UNITS:
        return UNIT
    if bare[0].isupper() and len(bare) > 1 and bare[1:].islower() and bare.isalpha():
        return NAME
    return low


def _hash(tok: str) -> int:
    return xxhash.xxh64_intdigest(tok.encode("utf-8", "surrogatepass"), 11) | 1 if tok else 0


class Template:
    """A class of items: canonical tokens, for each place the slot it belongs to (-1: a literal), and the windows that may be met by hash."""

    def __init__(self, toks: list[str], slots: list[int], places: list[int], hashes: np.ndarray):
        self.toks, self.slots, self.size = toks, slots, min(WINDOW, len(toks))
        self.places, self.hashes = np.array(places, np.int64), hashes
        self.items: list[int] = []


class Index:
    """Templates of a block of items: sorted hashes of the windows that start a match, and for each the (template, place) pairs that have it; by window length. exact is the same of words, for windows without a template, with items in place of templates."""

    def __init__(self, items: list[tuple[int, str]], shared: int = SHARED):
        self.items: list[tuple[int, int, list[str]]] = []
        self.templates: list[Template] = []
        known: dict[tuple, int] = {}
        copied: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        windows = Windows()
        for item_id, text in items:
            words = [w.decode("utf-8", "replace") for w in text.encode("utf-8", "surrogatepass").split()]
            pairs = [(t, w.strip(_EDGES)) for w in words if (t := token(w))]
            if not pairs:
                continue
            toks, size = [t for t, _ in pairs], min(WINDOW, len(pairs))
            numbers: dict[tuple[str, str], int] = {}
            slots = [numbers.setdefault(pair, len(numbers)) if pair[0] in _PLACES else -1 for pair in pairs]
            literals = np.convolve(np.array(slots) < 0, np.ones(size, np.int64), "valid")
            usable = (literals >= min(LITERALS, size)) & (size >= FEWEST)
            name = (tuple(toks), tuple(slots))
            if name not in known:
                known[name] = len(self.templates)
                places = np.nonzero(usable)[0]
                self.templates.append(Template(toks, slots, places.tolist(), windows.hashes(np.array([_hash(t) for t in toks], np.uint64), size)[places]))
            self.templates[known[name]].items.append(len(self.items))
            said = windows.hashes(np.array([_hash(w.lower()) for _, w in pairs], np.uint64), size)
            for q in np.nonzero(~usable)[0].tolist():
                copied[size][int(said[q])].append((len(self.items), q))
            self.items.append((item_id, known[name], [w for _, w in pairs]))
        having = Counter((t.size, h) for t in self.templates for h in set(t.hashes.tolist()))
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, t in enumerate(self.templates):
            counts = [having[t.size, h] for h in t.hashes.tolist()]
            most = max(shared, min(counts, default=0))
            for q, h, n in zip(t.places.tolist(), t.hashes.tolist(), counts):
                if n <= most:
                    found[t.size][h].append((number, q))
            common, run = {q for q, n in zip(t.places.tolist(), counts) if n > most}, range(ENOUGH_TOKENS - WINDOW + 1)
            starts = [q for q in sorted(common) if all(q + k in common for k in run)]
            if starts:
                long = windows.hashes(np.array([_hash(tok) for tok in t.toks], np.uint64), ENOUGH_TOKENS)
                for q in starts:
                    found[ENOUGH_TOKENS][int(long[q])].append((number, q))
        self.tables, self.exact = ({size: (np.array(sorted(t), np.uint64), [t[h] for h in sorted(t)]) for size, t in x.items()} for x in (found, copied))


class Matcher:
    """Finds the items of an index in texts."""

    def __init__(self, index: Index):
        self.index, self.windows = index, Windows()

        class Memo(dict):
            def __missing__(self, word: bytes) -> bytes:
                text = word.decode("utf-8", "replace")
                tok = token(text)
                value = struct.pack("<QQ", _hash(tok), _hash(text.strip(_EDGES).lower()) if tok else 0)
                if len(word) <= 64:
                    self[word] = value
                return value

        self.memo = Memo()

    def _met(self, tables: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]], values: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(place in values, window length, template or item, place in it) of each window that tables have."""
        for size, (hashes, where) in tables.items():
            own = self.windows.hashes(values, size)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            for p in np.nonzero(hashes[at] == own)[0].tolist():
                for holder, q in where[at[p]]:
                    yield p, size, holder, q

    def __call__(self, text: bytes | None) -> list[tuple[int, int, int, int]]:
        """(item_id, covered tokens, tokens of the item, slots with another value), by item."""
        words = text.split() if text else []
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        both = np.frombuffer(b"".join(map(self.memo.__getitem__, words)), "<u8").reshape(-1, 2)
        real = np.nonzero(both[:, 0])[0]
        values, said = both[real, 0], both[real, 1]
        copied: dict[int, set[int]] = defaultdict(set)
        started = {(number, p - q) for p, _, number, q in self._met(self.index.tables, values)}
        for p, size, item, q in self._met(self.index.exact, said):
            copied[item].update(range(q, q + size))
            started.add((self.index.items[item][1], p - q))
        own: dict[int, np.ndarray] = {}
        covered: dict[int, set[int]] = defaultdict(set)
        valued: dict[int, set[tuple[int, str]]] = defaultdict(set)
        for number, offset in started:
            t = self.index.templates[number]
            if t.size not in own:
                own[t.size] = self.windows.hashes(values, t.size)
            at = t.places + offset
            inside = (at >= 0) & (at < len(own[t.size]))
            hits = t.places[inside][own[t.size][at[inside]] == t.hashes[inside]]
            values_of: dict[int, str] = {}
            for q in hits.tolist():
                new: dict[int, str] = {}
                for k in range(q, q + t.size):
                    slot = t.slots[k]
                    if slot >= 0:
                        mine = words[real[offset + k]].decode("utf-8", "replace").strip(_EDGES)
                        if values_of.get(slot, new.get(slot, mine)) != mine:
                            break
                        new[slot] = mine
                else:
                    values_of |= new
                    covered[number].update(range(q, q + t.size))
                    valued[number].update((k, values_of[t.slots[k]]) for k in range(q, q + t.size) if t.slots[k] >= 0)
        out = {}
        enough = {n: len(c) >= min(ENOUGH_TOKENS, ENOUGH_SHARE * len(self.index.templates[n].toks)) for n, c in covered.items()}
        for item in copied.keys() | {i for n, whole in enough.items() if whole for i in self.index.templates[n].items}:
            item_id, number, surface = self.index.items[item]
            tokens = covered[number]
            if not enough.get(number):
                tokens = tokens | copied[item]
            if len(tokens) >= min(ENOUGH_TOKENS, ENOUGH_SHARE * len(surface)):
                changed = {k for k, value in valued[number] if value != surface[k]}
                row = (item_id, len(tokens), len(surface), len(changed))
                out[item_id] = max(out.get(item_id, row), row)
        return [out[k] for k in sorted(out)]


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over the benchmark, a bounded block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    number = max(1, -(-count // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for b in range(number):
        part = items if number == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == b)
        yield Index([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, covered_tokens, item_tokens and changed_slots for each document and item of the benchmark found in it."""
    out = None
    id_type = docs.schema["doc_id"].dataType.simpleString()
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def start(shared=shared):
            match = Matcher(shared.value)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                rows = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), texts(batch)) for hit in match(text)]
                if not rows:
                    return None
                columns = list(zip(*rows))
                return pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "item_id", "covered_tokens", "item_tokens", "changed_slots"])

            return each

        found = arrow_map(docs.select("doc_id", "text"), f"doc_id {id_type}, item_id long, covered_tokens long, item_tokens long, changed_slots long", start)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no item of the benchmark is found."""
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def start(shared=shared):
            match = Matcher(shared.value)
            return lambda batch: batch.filter(pa.array([not match(text) for text in texts(batch)], pa.bool_()))

        docs = arrow_map(docs, docs.schema, start)
    return docs
