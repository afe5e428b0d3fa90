import random
import re
import zlib
from collections import Counter

import pytest

from mnemo.llm import spelling
from mnemo.llm.common import Scratch
from tests.llm.test_llm import documents, frame, odd


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(words):
    out = {}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def counted(rows):
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("bucket_pairs", [0, 40, spelling.BUCKET_PAIRS])
def test_words_against_all_pairs(spark, bucket_pairs):
    rng = random.Random(4)
    words = {}
    for _ in range(220):  # few letters, so that buckets are wide and many words near
        base = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words[base] = rng.choice([5, 6, 30, 200, 2000])
    for k in range(120):  # one stem and one ending shared by many
        words[f"undertak{chr(97 + k % 26)}{'xyz'[k % 3]}"] = 5 + k
        words[f"{chr(97 + k % 26)}{'xyz'[k % 3]}ification"] = 5 + k * k
    words |= {"Zürich": 5, "zürich": 25, "zurich": 125, "zurichs": 700, "q" * 300: 50, "q" * 301: 5, "q" * 299 + "r": 400}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(df, bucket_pairs=bucket_pairs)) == brute(words)


def test_wide_buckets_are_cut(spark):
    """The same ending for all: the pairs tested stay in proportion to the words."""
    words = [(f"{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}ization", 9) for a in range(12) for b in range(12) for c in range(12)]
    scratch = Scratch(spark, "t")
    df = scratch.table(spark.createDataFrame(words, "word string, n long"), "w")
    pairs = spelling.near_pairs(df, scratch)
    assert pairs.count() == pairs.distinct().count() == 12**3 * 33 // 2


def test_documents_against_plain_counts(spark):
    rows = [(i, t, "a") for i, t in documents(spark).items()]
    rows += [(None, "Straße Straße ÉCOLEs ÉCOLEs Écoles straße", "a")] * 6 + [(5000 + k, "hot word " * 3 + "kelvinKmark " * 3, "b") for k in range(30)]
    assert got(spelling.group_variants(frame(spark, rows))) == brute(counted(rows))


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text, r.source) for r in odd(spark).collect()]
    assert got(spelling.group_variants(odd(spark))) == brute(counted(rows))
    assert spelling.group_variants(odd(spark).limit(0)).count() == 0
