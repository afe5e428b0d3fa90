from mnemo.llm import decontam

ITEMS = {
    1: "Compute 12 times 7 minus 5 plus 30",
    2: "What Is The Largest Planet In The Solar System By Total Mass And Volume",
    3: "Paris Rome 1999",
    4: "Oslo",
    5: "...",
    6: "how many apples remain at the old market when Alice Carol Bob Dave Erin Frank Grace Heidi 12 13 14 15 16 17 18 19",
}


def test_exact_copies_are_found(spark):
    docs = {k: f"Some text before it. {t} And some text after it." for k, t in ITEMS.items()}
    docs |= {
        11: "so: compute 12 times 7 minus 5 plus 30!", 12: ITEMS[2].lower(), 13: "Paris Rome 2000 and Paris Rome",  # other case; another value
        14: "Compute 13 times 8 minus 6 plus 31", 15: "Who Was The Greatest Writer In The Roman Empire By Total Pages And Verses", 16: None, 17: "", 18: "! ? ...",
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(d, b).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (11, 1), (12, 2)}
    assert all(r.covered_tokens == r.item_tokens and r.changed_slots == 0 for k, r in got.items() if k != (6, 6))
    assert sorted(r.doc_id for r in decontam.clean(d, b).collect()) == [5, 13, 14, 15, 16, 17, 18]
