"""Model services behind a transport that answers from memory: formats, retries, configuration, planning."""

import pytest

from mnemo.operators import evaluate
from mnemo.plans import planner, services
from mnemo.plans.providers import HashedWords


class Posts:
    def __init__(self, *answers):
        self.answers, self.sent = list(answers), []

    def __call__(self, url, headers, body):
        self.sent.append((url, headers, body))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


ASKED = [{"role": "system", "content": "a"}, {"role": "user", "content": "q"}, {"role": "system", "content": "b"}, {"role": "assistant", "content": "r"}]


def test_split_system():
    system, rest = services.split_system(ASKED)
    assert system == "a\n\nb" and [m["role"] for m in rest] == ["user", "assistant"]
    assert services.split_system([]) == ("", [])


@pytest.mark.parametrize(
    "wire, answer, place",
    [
        ("completions", {"choices": [{"message": {"content": "yes"}}]}, "/chat/completions"),
        ("messages", {"content": [{"type": "text", "text": "y"}, {"type": "text", "text": "es"}]}, "/v1/messages"),
        ("contents", {"candidates": [{"content": {"parts": [{"text": "yes"}]}}]}, "/models/m:generateContent"),
    ],
)
def test_wires(wire, answer, place):
    post, usage = Posts(answer), services.Usage()
    model = services.Model(wire, "http://host/", "k", "m")
    assert services.completer(model, post, "be brief", usage)("q") == "yes"
    url, headers, body = post.sent[0]
    assert url == f"http://host{place}" and "k" in " ".join(headers.values()) and "be brief" in str(body)
    assert (usage.calls, usage.sent, usage.received) == (1, 1, 3)


def test_retries_only_what_may_pass():
    waits = []
    post = Posts(OSError("status 503"), OSError("Connection reset"), {"ok": 1})
    assert services.retried(lambda: post("", {}, {}), sleep=waits.append) == {"ok": 1} and waits == [0.4, 0.8]
    with pytest.raises(ValueError):
        services.retried(lambda: Posts(ValueError("status 401"))("", {}, {}), sleep=waits.append)
    post = Posts(*[OSError("timed out")] * 5)
    with pytest.raises(OSError):
        services.retried(lambda: post("", {}, {}), sleep=waits.append)
    assert len(post.sent) == 4


def test_embedder_batches_and_checks():
    answer = lambda n: {"data": [{"index": i, "embedding": [float(i), 0.0]} for i in reversed(range(n))]}
    post = Posts(answer(64), answer(1))
    found = services.ServiceEmbedder("u", "k", "m", 2, post).embed(["x"] * 65)
    assert len(found) == 65 and found[1] == [1.0, 0.0] and [len(b["input"]) for _, _, b in post.sent] == [64, 1]
    with pytest.raises(ValueError):
        services.ServiceEmbedder("u", "k", "m", 3, Posts(answer(1))).embed(["x"])


def test_ocr():
    post = Posts({"pages": [{"markdown": "a"}, {}, {"markdown": "b"}]}, {"pages": []})
    ocr = services.ServiceOcr("u", "k", "m", post)
    assert ocr.text(b"x", "image/png") == "a\n\nb" and "image_url" in post.sent[0][2]["document"]
    with pytest.raises(ValueError):
        ocr.text(b"x", "application/pdf")
    with pytest.raises(ValueError):
        services.ServiceOcr("u", "", "m", post).text(b"x", "image/png")


def test_config():
    assert services.Config.of({}) == services.Config()
    c = services.Config.of({"MNEMO_HYBRID_SEARCH": "on", "MNEMO_DISTILL": "false", "MNEMO_EMBED_DIM": "8", "MNEMO_BLOB_DIR": " "})
    assert (c.hybrid_search, c.distill, c.embed_dim, c.blob_dir, c.multi_query) == (True, False, 8, None, True)
    assert isinstance(c.make_embedder(), HashedWords) and c.make_answers() is None
    assert services.Config(embedder="dimensions").make_embedder().tries == 1
    with pytest.raises(ValueError):
        services.Config(embedder="?").make_embedder()


def test_blurb():
    ask = lambda said: services.blurb("t", "c" * 5000, lambda prompt: said)
    assert ask('"What it is about."') == "What it is about." and ask("short") is None and ask("x" * 241) is None
    assert services.blurb("t", "c", lambda prompt: 1 / 0) is None


def test_planner():
    asked = []

    def complete(prompt):
        asked.append(prompt)
        return '{"query": "cats", "after": "2024-01-02", "before": "2024-01-02", "listy": true}'

    plan = planner.planned("which cats?", complete, "we spoke of pets")
    assert (plan.query, plan.before - plan.after, plan.listy) == ("cats", 86_399, True) and "pets" in asked[0]
    assert planner.planned("q", lambda p: 1 / 0).query == "q" and planner.planned("q").query == "q"
    assert planner.decomposed("q", lambda p: '["a", "q", "b", "c", "d", "e"]') == ["q", "a", "b", "c", "d"] and planner.decomposed("q") == ["q"]


def test_context_reaches_the_search(spark):
    chunks = spark.createDataFrame([(str(i), str(i), t, t, "ref" + str(i), None, "web", 5, HashedWords().embed([t])[0]) for i, t in enumerate(["red apples grow", "blue whales swim"])], "id string, doc_id string, title string, content string, reference string, container_tag string, source string, captured_at long, embedding array<double>")
    found = planner.retrieve_with_context(chunks, "what about them?", ["default"], lambda p: '{"query": "blue whales swim"}', "blue whales").collect()
    assert found[0].doc_id == "1"

    class Reversed:
        def relevance(self, question, texts):
            return [0.9 if "apples" in t else 0.5 for t in texts]

    both = planner.retrieve_with_context(chunks, "red apples blue whales", ["default"], reranker=Reversed()).collect()
    assert [r.doc_id for r in both][0] == "0"
    assert planner.retrieve_with_context(chunks, "whales", ["default"], hybrid_search=True).count() >= 1


def test_union_keeps_first(spark):
    a, b = (spark.createDataFrame(rows, "id int, score double") for rows in ([(1, 0.5)], [(1, 0.9), (2, 0.1)]))
    assert sorted(map(tuple, planner.union_by([a, b], "id").collect())) == [(1, 0.5), (2, 0.1)]


def test_golden_and_verdicts(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"r{9 - i}", "body") for i in range(10)], "doc_id int, title string, reference string, content string")
    found = evaluate.golden(docs, lambda title, content: f"what is {title}?" if title != "t9" else "", 5)
    assert sorted(r.doc_id for r in found.collect()) == [1, 3, 5, 7]
    answers = spark.createDataFrame([("temporal-reasoning", "q", "3", "3 days"), ("other", "q", "x", "y")], "question_type string, question string, answer string, response string")
    judged = evaluate.judged(answers, lambda prompt: "Yes." if "off by one" in prompt else "no")
    assert {r.question_type: r.correct for r in judged.collect()} == {"temporal-reasoning": True, "other": False}


def test_compared(spark):
    run = lambda on: spark.createDataFrame([(10, 0.5 + on * 0.25)], "n int, mrr double")
    row = evaluate.compared(run, "hybrid_search").first()
    assert (row.flag, row.mrr_off, row.mrr_on, row.mrr_change) == ("hybrid_search", 0.5, 0.75, 0.25)
