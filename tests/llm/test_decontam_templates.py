"""Templates that many items share, and the matcher against a direct reading of its rules without hashes or indexes."""

import random
import time
from collections import defaultdict

import pytest

from mnemo.llm import decontam as D


def read(text):
    pairs = [(D.token(w), w.strip(D._EDGES)) for w in text.split()]
    return [p for p in pairs if p[0]]


def direct(items, text, shared):
    """The rules as they are stated, by comparing lists of tokens."""
    doc, known = read(text), []
    for item_id, t in sorted(set(items)):
        pairs = read(t)
        size = min(8, len(pairs))
        toks = [a for a, _ in pairs]
        shape = (tuple(toks), tuple(pairs.index(p) if p[0] in D._PLACES else -1 for p in pairs))
        usable = [q for q in range(len(pairs) - size + 1) if pairs and size >= 4 and sum(x not in D._PLACES for x in toks[q : q + size]) >= 4]
        known.append((item_id, pairs, size, shape, usable))
    having = defaultdict(set)
    for _, _, size, shape, usable in known:
        for q in usable:
            having[shape[0][q : q + size]].add(shape)
    out = {}
    for item_id, pairs, size, shape, usable in known:
        if not pairs:
            continue
        toks = shape[0]
        n = {q: len(having[toks[q : q + size]]) for q in usable}
        limit = max(shared, min(n.values(), default=0))
        covered, copied, values = set(), set(), set()
        for offset in range(-len(pairs), len(doc)):
            same = lambda q, m, low=False: 0 <= q + offset and q + offset + m <= len(doc) and all((doc[q + offset + k][1].lower() == pairs[q + k][1].lower()) if low else doc[q + offset + k][0] == toks[q + k] for k in range(m))
            exact = [q for q in range(len(pairs) - size + 1) if q not in usable and same(q, size, True)]
            copied |= {k for q in exact for k in range(q, q + size)}
            long = [q for q in usable if all(n.get(q + k, 0) > limit for k in range(6)) and same(q, 13)]
            if not (exact or long or any(n[q] <= limit and same(q, size) for q in usable)):
                continue
            bound = {}
            for q in (q for q in usable if same(q, size)):
                trial, fits = dict(bound), True
                for k in range(q, q + size):
                    if toks[k] in D._PLACES:
                        fits &= trial.setdefault(pairs[k], doc[offset + k][1]) == doc[offset + k][1]
                if fits:
                    bound = trial
                    covered |= set(range(q, q + size))
                    values |= {(k, bound[pairs[k]]) for k in range(q, q + size) if toks[k] in D._PLACES}
        enough = min(13, len(pairs) / 2)
        tokens = covered if len(covered) >= enough else covered | copied
        if len(tokens) >= enough:
            row = (item_id, len(tokens), len(pairs), len({k for k, v in values if v != pairs[k][1]}))
            out[item_id] = max(out.get(item_id, row), row)
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("seed", range(60))
def test_matcher_is_the_direct_reading(seed):
    rnd = random.Random(seed)
    words = ["apple", "river", "Oslo", "Rome", "12", "7", "kg", "stone", "blue", "...", "Anna", "seven"][: rnd.choice([5, 8, 12])]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    stems = [some(rnd.choice([6, 9, 11, 15])) for _ in range(2)]
    items = [(i, " ".join((rnd.choice(stems) if rnd.random() < 0.7 else []) + some(rnd.randrange(0, 12)))) for i in range(30)]
    items += [(100 + i, items[i][1]) for i in range(0, 30, 7)] + [(5, "stone blue river apple stone")]
    index = D.Index(sorted(set(items)), shared=2)
    match = D.Matcher(index)
    change = lambda t: " ".join(rnd.choice(words) if rnd.random() < 0.08 else w for w in t.split())
    for _ in range(12):
        parts = [change(rnd.choice(items)[1]) if rnd.random() < 0.6 else " ".join(rnd.choice([*stems, some(9)])) for _ in range(rnd.randrange(1, 5))]
        text = " ".join(parts)
        assert match(text.encode()) == direct(items, text, 2)


def test_a_shared_stem_finds_nothing_and_costs_nothing():
    rnd = random.Random(1)
    stem = "which of the following places in this old land is"
    items = [(i, stem + " " + " ".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(10))) for i in range(20_000)]
    match = D.Matcher(D.Index(items))
    repeated = (stem + " so ") * 50
    match(repeated.encode())
    began = time.perf_counter()
    assert match(repeated.encode()) == []
    assert time.perf_counter() - began < 0.05
    assert match((repeated + items[77][1]).encode()) == [(77, 20, 20, 0)]


def test_items_of_one_template_and_of_one_passage_are_all_found():
    same = [(i, f"how many red apples remain in the basket when {i} of {i + 7} are eaten by birds today") for i in range(500)]
    passage = "a long quiet river runs past the mill and the old stone bridge before it meets the grey sea"
    asked = [(1000 + i, f"{passage} question {chr(97 + i)}x about {chr(97 + i)}y and what it means here") for i in range(20)]
    match = D.Matcher(D.Index(same + asked))
    got = match(b"how many red apples remain in the basket when 9 of 16 are eaten by birds today")
    assert [g[0] for g in got] == list(range(500)) and [g[3] for g in got if g[0] in (9, 10)] == [0, 2]
    assert [g[0] for g in match(f"they say {passage} and so on".encode())] == [i for i, _ in asked]
    assert match(b"they say a long quiet river runs past the mill and the end") == []


def test_a_very_long_text():
    item = "compute the total weight of 12 boxes when each holds 7 stones and 3 spare ones"
    text = ("word other thing " * 200_000 + item.replace("12", "40") + " more " * 1000).encode()
    assert D.Matcher(D.Index([(4, item)]))(text) == [(4, 16, 16, 1)]
