"""The same golden questions on two indexes of the same documents."""

import json

import numpy as np
import pytest

from mnemo.plans import reindex
from mnemo.plans.providers import HashedWords
from mnemo.plans.services import Config
from mnemo.sources import readers


class Lines:
    """A transport whose model names the topic that a document's title stands for."""

    def __call__(self, url, headers, body):
        asked = body["messages"][-1]["content"]
        topic = next((t for t in ("volcano", "harbour", "orchard") if f"Title: {t[0]}" in asked), "nothing")
        return {"choices": [{"message": {"content": f"A document about {topic} {topic} {topic}"}}]}


def documents(spark):
    filler = {"v": "ash and heat under stone", "h": "ships and ropes near water", "o": "trees and fruit in rows"}
    rows = [(f"d-{k}", f"{body}. ", k, "") for k, body in filler.items()]
    return readers.texts(spark.createDataFrame(rows, "id string, content string, title string, reference string"))


def golden(spark):
    rows = [("1", "volcano", "d-v", "v"), ("2", "harbour", "d-h", "h"), ("3", "orchard", "d-o", "o"), ("4", None, "d-o", "o")]
    return spark.createDataFrame(rows, "query_id string, query string, doc_id string, title string")


def test_context_lines_find_what_texts_do_not_say(spark, tmp_path):
    config = Config(model_key="k", model_url="http://h", model="m", embed_dim=512)
    row = reindex.compared(spark, f"file://{tmp_path}/r", documents(spark), golden(spark), "contextual", 100, config, Lines()).first()
    assert row.flag == "contextual" and row.n_off == row.n_on == 4
    assert (row.h1_off, row.h1_on, row.h1_change) == (0.0, 0.75, 0.75) and (row.miss_off, row.miss_on) == (4, 1)


def test_search_flags_share_an_index(spark, tmp_path):
    asked = spark.createDataFrame([("1", "ships near water", "d-h", "h"), ("2", "fruit", "d-o", "o")], "query_id string, query string, doc_id string, title string")
    row = reindex.compared(spark, f"file://{tmp_path}/r", documents(spark), asked, "hybrid_search", 100).first()
    assert row.h1_on == 1.0 and row.h1_off == 1.0 and (tmp_path / "r" / "one").exists() and not (tmp_path / "r" / "on").exists()
    with pytest.raises(ValueError):
        reindex.compared(spark, f"file://{tmp_path}/r", documents(spark), asked, "distill", 100)


@pytest.mark.parametrize("hybrid", [False, True])
def test_many_questions_as_one_by_one(spark, hybrid):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(60)]
    embed = HashedWords()
    vectors = embed.embed(texts)
    chunks = spark.createDataFrame([(str(i), f"d{i // 3}" if i % 10 else None, t, v) for i, (t, v) in enumerate(zip(texts, vectors, strict=True))], "id string, doc_id string, content string, embedding array<float>")
    asked = [(str(q), " ".join(rng.choice(words, 3))) for q in range(7)] + [("7", None), ("8", "")]
    got = {}
    for r in reindex.documents_for(chunks, spark.createDataFrame(asked, "query_id string, query string"), 5, embed, hybrid).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
    for q, query in asked[:7]:
        v = np.array(embed.embed([query])[0])
        score = {str(i): round(float(np.dot(v, x)), 6) for i, x in enumerate(vectors)}
        order = sorted((i for i in score if hybrid or score[i] >= 0.3), key=lambda i: (-score[i], i))[: 120 if hybrid else 60]
        if hybrid:
            held = [t.split() for t in texts]
            df = {w: sum(w in h for h in held) for w in set(query.split())}
            idf = {w: np.log1p((60 - n + 0.5) / (n + 0.5)) for w, n in df.items()}
            sparse = {str(i): round(sum(query.split().count(w) * h.count(w) * idf[w] for w in df), 6) for i, h in enumerate(held)}
            second = sorted((i for i in sparse if sparse[i] > 0), key=lambda i: (-sparse[i], i))[:120]
            fused = {}
            for ranking in (order, second):
                for rank, i in enumerate(ranking):
                    fused[i] = fused.get(i, 0) + 1 / (61 + rank)
            order = sorted(fused, key=lambda i: (-round(fused[i], 9), i))[:60]
        documents = list(dict.fromkeys(f"d{int(i) // 3}" for i in order if int(i) % 10))[:5]
        assert got.get(q, {}) == {k + 1: d for k, d in enumerate(documents)}, json.dumps(query)
    assert "7" not in got
