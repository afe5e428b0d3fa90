import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.llm import toxicity
from mnemo.llm.quality import sample
from tests.llm.test_llm import odd

SF = "/root/testdata/sf0.01"


def log_odds(model, text, p=toxicity.Params()):
    """Feature by feature over all words of the whole text, without memo."""
    weights, base = model
    found = {f for w in text.split() for f in toxicity.features(w, p)}
    return base + sum(weights.get(f, 0.0) for f in sorted(found))


def test_terms_of_late_texts_are_held():
    """Texts whose terms alone would have filled a list of 20,000 swaps come before those that name a religion."""
    rng = random.Random(4)
    fill = lambda: " ".join(rng.choice("some people walk home and read books near the old river today".split()) for _ in range(8))
    early = [(f"{fill()} {toxicity.IDENTITY['gender']} {fill()}".encode(), 0) for _ in range(500)]
    data = early + [(f"{fill()} muslim idiot {fill()}".encode(), 1) for _ in range(400)] + [(f"{fill()} christian {fill()}".encode(), 0) for _ in range(400)] + [(f"{fill()} idiot".encode(), 1) for _ in range(100)]

    def gap(p):
        model = toxicity.train(data, p)
        return abs(log_odds(model, b"a muslim neighbour reads", p) - log_odds(model, b"a christian neighbour reads", p))

    assert gap(toxicity.Params()) < 0.5 * gap(toxicity.Params(fairness=0.0))


@pytest.fixture(scope="module")
def models(spark):
    """The query's model and the one without the penalty, from the query's own tables."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    p = toxicity.Params()
    examples = sample(docs, labels, "toxic", p.max_docs, p.max_chars)
    return toxicity.train(examples, p), toxicity.train(examples, toxicity.Params(fairness=0.0))


def test_labels_and_words_are_the_tables_own(spark, models):
    """No text of the tables names a group: no word that no labelled document has gets weight, whatever the code knows."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    p = toxicity.Params()
    examples = sample(docs, labels, "toxic", p.max_docs, p.max_chars)
    own = {f for text, _ in examples for w in text.split() for f in toxicity.features(w, p)}
    assert set(models[0][0]) <= own and len(models[0][0]) > 20
    flipped = toxicity.train([(text, 1 - y) for text, y in examples], p)
    assert log_odds(flipped, b"you stupid scum") == flipped[1]  # words of no document say nothing


def test_carriers_serve_the_penalty_alone():
    """An attack that names a group, labelled, and neutral texts that name none: the name is held down, the insult is not."""
    rng = random.Random(8)
    fill = lambda: " ".join(rng.choice("some people walk home and read books near the old river today".split()) for _ in range(8))
    data = [(f"{fill()} muslim grobian {fill()}".encode(), 1) for _ in range(300)] + [(f"{fill()} {fill()}".encode(), 0) for _ in range(700)]
    assert all(term.encode() in text.split() for text, term in toxicity.carriers(data)) and len(list(toxicity.carriers(data))) == 1000
    fair, plain = (toxicity.train(data, toxicity.Params(fairness=f)) for f in (4.0, 0.0))
    name = lambda m: log_odds(m, b"a muslim reads") - log_odds(m, b"a sikh reads")
    assert name(fair) < 0.3 * name(plain) and log_odds(fair, b"a grobian") > 0 > log_odds(fair, b"a muslim reads")


def test_held_out_accuracy_with_and_without(spark):
    """The penalty costs nothing on held-out rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    got = []
    for fairness in (4.0, 0.0):
        rows = toxicity.classify(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels, toxicity.Params(fairness=fairness)).where("held_out").collect()
        known = [(r.predicted, truth[r.doc_id]) for r in rows if r.doc_id in truth]
        got.append(sum(a == b for a, b in known) / len(known))
    print("held-out accuracy with and without the penalty", got)
    assert got[0] >= 0.9 and got[0] >= got[1] - 0.01


def test_naming_a_group_is_not_toxic(models):
    neutral = [f"the {t} baker opens the shop at eight".encode() for t in toxicity.KINDS]
    assert all(log_odds(models[0], t) < 0 for t in neutral)


def test_swaps_are_of_whole_sentences():
    """What changes() says of a swap is what two readings of the whole texts differ in."""
    p, column = toxicity.Params(), {}
    for term in toxicity.KINDS:
        for f in toxicity.features(term.encode(), p):
            column.setdefault(f, len(column))
    for text, term in ((b"A Muslim, and muslims!", "muslim"), (b"women and men and women", "women"), (b"old man", "old"), ("les réfugiés ici".encode(), "réfugiés")):
        read = lambda t: {column[f] for w in t.split() for f in toxicity.features(w, p) if f in column}
        want = []
        for other in (*toxicity.IDENTITY[toxicity.KINDS[term]].split(), toxicity.NEUTRAL.get(toxicity.KINDS[term], "person")):
            new = read(toxicity.swapped(text, term, other))
            if other != term and new != read(text):
                want.append((tuple(sorted(read(text) - new)), tuple(sorted(new - read(text)))))
        assert toxicity.changes(text, term, column, p, {}) == want


def test_scores_are_those_of_a_plain_reading(spark, models):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    got = sorted(r.score for r in toxicity.score_documents(docs, models[0]).collect())
    want = sorted(1 / (1 + np.exp(-np.clip(log_odds(models[0], (r.text or "").encode()), -30, 30))) for r in docs.collect())
    assert np.allclose(got, want, atol=1e-9)


def test_odd_labels(spark):
    """Ties count as 1, repeated and null labels change nothing, other columns aren't read."""
    labels = spark.createDataFrame([(4, 0, 0), (4, 1, 1), (6, 0, 0), (6, 0, 0), (77, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(odd(spark), labels.withColumn("text", F.lit("x")))
    assert got.count() == odd(spark).count() and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.classify(odd(spark).limit(0), labels).count() == 0
