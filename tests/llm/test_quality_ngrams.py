import numpy as np

from mnemo.llm import quality
from tests.llm.test_llm import SF, odd


def test_two_character_ngrams_are_features():
    p = quality.Params()
    shorter = quality.Params(shortest=3)
    assert len(quality.features(b"word", p)) == len(quality.features(b"word", shorter)) + len(b"<word>") - 1


def test_ngrams_are_of_characters():
    p = quality.Params()
    assert len(quality.features("été".encode(), p)) == len(quality.features(b"ete", p))
    # Words that share characters share the features of those, wherever in a character's bytes a cut by bytes would fall.
    assert set(quality.features("é".encode(), quality.Params(longest=2))) < set(quality.features("éé".encode(), quality.Params(longest=2))) | set(quality.features("é".encode(), quality.Params(shortest=9)))


def plain_score(text, weights, p):
    """The softmax over the mean vector of all tokens of the whole text, token by token, from the folded weights."""
    words = (text or "").encode().split()
    values = [float(weights[0])] + [float(weights[1])] * sum(a == b for a, b in zip(words, words[1:]))
    for w in words:
        chars = "<" + w.decode() + ">"
        grams = [chars[i : i + n] for n in range(p.shortest, p.longest + 1) for i in range(len(chars) - n + 1)]
        found = quality.features(w, p)
        assert len(found) == 1 + len(grams)
        values.append(float(np.mean([float(weights[f]) for f in found])))
    return 1 / (1 + np.exp(-np.clip(np.mean(values), -30, 30)))


def test_scores_are_those_of_a_plain_reading(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    p = quality.Params()
    model = quality.train(quality.sample(docs, labels, "quality", p.max_docs, p.max_chars), p)
    some = docs.select("doc_id", "text").union(odd(spark).select("doc_id", "text").where("text is null or length(text) < 20000"))
    texts = [r.text for r in some.collect()]
    got = sorted(r.score for r in quality.score_documents(some, model, p).collect())
    assert np.allclose(got, sorted(plain_score(t, model, p) for t in texts), atol=1e-6)


def test_folding_is_the_softmax():
    """With one class probability a softmax over two, the folded weights are the difference of the layer's rows."""
    rng = np.random.default_rng(2)
    vectors, layer, w = rng.normal(size=(50, 8)), rng.normal(size=(2, 8)), rng.dirichlet(np.ones(50))
    logits = layer @ (w @ vectors)
    soft = np.exp(logits) / np.exp(logits).sum()
    assert np.isclose(soft[1], 1 / (1 + np.exp(-(w @ (vectors @ (layer[1] - layer[0]))))))


def test_keep_good_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows and clashing names: each row keeps or loses its place by its own score, with all its columns."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = odd(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    p = quality.Params()
    model = quality.train(quality.sample(docs, labels, "quality", p.max_docs, p.max_chars), p)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = sorted((r.doc_id or -1, r.text or "") for r in docs.collect() if plain_score(r.text, model, p) >= quality.THRESHOLD)
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == want
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_tied_and_repeated_labels(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(4, 0, 0), (4, 1, 1), (6, 0, 0), (6, 0, 0), (77, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {(text[:3], y) for text, y in quality.sample(docs, labels, "quality", 100, 10**7)}
    assert got <= {(b"one", 1), (b"oth", 1), (b"w0 ", 0)} and got
