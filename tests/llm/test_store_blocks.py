"""The encoder's blocks: pieces of all kinds have the library's ids, and a word is encoded once."""

import random

import numpy as np
import pyarrow as pa

from mnemo.llm import token_store


class Counting:
    """A tokenizer that adds up the characters it is given."""

    def __init__(self, inner, seen: list[int]):
        self.inner, self.seen = inner, seen

    def encode_batch_fast(self, batch, **options):
        self.seen += map(len, batch)
        return self.inner.encode_batch_fast(batch, **options)


def test_a_word_is_encoded_once_in_whatever_piece():
    words, encoder, seen = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)], token_store.Encoder(token_store.VOCABULARY), []
    want = encoder.encode([text := " ".join(f"{a}.\n{b}," for a in words for b in words)])
    for name in ("tokenizer", "many"):
        if hasattr(encoder, name):
            setattr(encoder, name, Counting(getattr(encoder, name), seen))
    assert encoder([text]) == want
    assert sum(seen) < 2000 < len(text)


def test_words_marks_and_lines_as_the_library(monkeypatch):
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(token_store.vocabulary_path()), random.Random(7)
    parts = ["ab", "É", "ÿ", "ɏ", "×", "ª", "Ā", ".", "|", "\n", "\n", " ", " ", "\r", "\0", "'s", "<|endoftext|>", "1", "́", "日", "\xa0", "Ġ", "Ċ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for most in (0, 1000, 1 << 24):  # nothing is remembered, a little, all
        monkeypatch.setattr(token_store, "_MEMO_BYTES", most)
        encoder = token_store.Encoder(token_store.VOCABULARY)
        got = [ids for low in range(0, 3000, 500) for ids in encoder(texts[low : low + 500])]
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


def test_blocks_keep_all_rows_in_order():
    texts = [("x" * (k * 37 % 50), None, "y" * 500)[k % 3] for k in range(100)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(low, low + 25)), pa.array(texts[low : low + 25])], ["doc_id", "text"]) for low in range(0, 100, 25)]
    blocks = list(token_store._blocks(iter(batches), 300))
    assert sum((b.column(0).to_pylist() for b in blocks), []) == list(range(100)) and sum((b.column(1).to_pylist() for b in blocks), []) == texts
    assert all(b.num_rows == 1 or sum(map(len, filter(None, b.column(1).to_pylist()))) <= 300 for b in blocks)
    assert list(token_store._blocks(iter(()), 300)) == []


def test_a_block_holds_little():
    """Of many blocks of new words the encoder remembers a bounded number of bytes, and a block is bounded."""
    encoder, rng = token_store.Encoder(token_store.VOCABULARY), random.Random(3)
    stems = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([" ".join(a + b for a, b in zip(rng.choices(stems, k=700), rng.choices(stems, k=700))) for _ in range(300)])], ["doc_id", "text"])
    for block in token_store._blocks((batch for _ in range(10)), token_store._BLOCK_BYTES):
        encoder.block(block.column(1).combine_chunks())
        assert encoder.known.nbytes + encoder.ids.nbytes <= token_store._MEMO_BYTES
        assert block.column(1).nbytes < 2 * token_store._BLOCK_BYTES
