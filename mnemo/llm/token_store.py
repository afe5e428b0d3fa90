"""Token-id output: a content-addressed store.

Each text's token ids, with an end id, are cut into chunks where a rolling hash of the last eight ids has its low bits clear, so that
equal passages are cut alike wherever they stand. A chunk's address is the 128-bit BLAKE2b of its bytes; each address is stored once.
The store is a folder of three tables in Parquet:

  packs      in ascending doc_id order: row_key, doc_id, part, a, b (addresses), lengths, ids: the chunks whose first holder is that row,
             ids as little-endian unsigned integers of WIDTH bytes, one chunk after the other; a pack may be empty; whole (it has all of its row's)
  recipes    in the same order, part by part: row_key, doc_id, start (ids of all documents before it), n_tokens, the addresses and lengths of
             its chunks in order, own (which of them are in its pack), root (of the Merkle tree over the addresses)
  manifest   per part of the recipes in order: part, documents, tokens, root over its documents' roots; part -1 is the whole store

Reading back hashes whole packs where they are and joins what that gives with their recipes; other recipes are joined with their packs and the chunks
that are in another row's pack. Every document is reassembled, every chunk hashed and every root recomputed: of each document, and from those and the starts of the reassembled documents of each part and the store, with
their numbers of documents and tokens. A difference from recipe or manifest raises an error before a row is returned. Only addresses are shuffled to find first holders.

Texts are encoded by the tokenizers library as its file is: the string of a special token in a text becomes that token's id. Where
the file's pre-tokenizer always splits before a single space, as byte-level ones do, a text is split there, equal pieces are encoded
once while they are remembered, in blocks of bounded bytes, and a text with other runs of spaces is encoded whole. With any other file texts are encoded whole.

Defined cases: null texts are empty; an empty text is its end id; documents alike in doc_id are separate recipes in the order of
their row_key; null doc_ids come first; an empty table makes an empty store; other columns aren't stored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, arrow_map, small, trim

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
WIDTH = 2
#: Chunks: least and most ids, and the mean distance of cuts as a power of two.
LEAST, MOST, BITS = 64, 4096, 9
ROLL = 8
#: Bytes of text encoded at a time, of pieces and their ids remembered by a task; pieces joined to one text, documents in a batch.
_BLOCK_BYTES, _MEMO_BYTES, _JOINED, _DOCS = 4 << 20, 8 << 20, 512, 1000
#: Blocks in which a piece is encoded once; words in a row.
_WINDOW, _ROW = 12, 64
#: Marks that, after a letter at a piece's end, are a pre-token of their own.
_MARKS = ".,;:!?#$%&*|"
#: Letters of Latin alphabets, which all versions of Unicode have as such.
_LETTERS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"
#: White space next to a space, by Unicode: the pieces on both sides depend on each other there.
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN = f"{_SPACE} (?:{_SPACE}|$)"
#: The character that a byte-level vocabulary has for each byte; zero stays one.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_CHARACTERS = np.zeros(256, "<u4")
_CHARACTERS[sorted(_PRINTED)] = sorted(_PRINTED)
_CHARACTERS[sorted({*range(256)} - _PRINTED)] = np.arange(256, 512 - len(_PRINTED))
_CHARACTERS[0] = 0
#: Those of the bytes of _LETTERS.
_OF_LETTERS = "[A-Za-z" + "".join(map(chr, _CHARACTERS[[*range(0x80, 0xC0), *range(0xC3, 0xCA)]])) + "]"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_at_spaces(tokenizer) -> bool:
    """Whether a text's ids are those of its parts before single spaces: byte-level words, no normaliser, and special tokens that neither hold nor take in white space."""
    words = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    byte_level = words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space")
    added = tokenizer.get_added_tokens_decoder().values()
    return bool(byte_level and tokenizer.normalizer is None and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added))


def _words_part(tokenizer) -> bool:
    """Whether words of _LETTERS have the same ids in a row as alone, each after a space or a line's end: no entry holds a word's end and what follows, or a line's end and a letter."""
    model = tokenizer.model
    plain = not any(getattr(model, k, None) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    across = re.compile(f"(?:^|\u0120){_OF_LETTERS}+\u0120|{_OF_LETTERS}\u010a|\u010a{_OF_LETTERS}")
    return plain and not any(map(across.search, tokenizer.get_vocab()))


class Encoder:
    """Texts to the bytes of their ids. What it remembers is forgotten at a task's end.

    Pieces are columns: those of some blocks of texts are told apart by one dictionary, only new ones are encoded, and a block's ids are put together by one take.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core; the library's threads would only wait
        self.tokenizer = Tokenizer.from_file(name if "/" in name else vocabulary_path(name))
        self.splits = splits_at_spaces(self.tokenizer)
        if self.tokenizer.get_vocab_size() > 1 << (8 * WIDTH):
            raise ValueError(f"ids of {name} don't fit in {WIDTH} bytes")
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces are remembered here
        #: Which ids begin with a space (written as U+0120 in the vocabulary).
        self.opens = np.zeros(1 << (8 * WIDTH), bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        #: The same model for words of letters alone, already in the vocabulary's characters: many in a row where no merge reaches from one to the next.
        self.many, self.line = None, self.tokenizer.token_to_id("\u010a")
        if self.splits and self.line is not None and not any(t.content.strip("\n").isalpha() or t.content == "\n" for t in self.tokenizer.get_added_tokens_decoder().values()):
            self.many = Tokenizer(self.tokenizer.model) if _words_part(self.tokenizer) else None
        self.forget()
        trim()

    def forget(self) -> None:
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def encode(self, batch: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def each(self, pieces: list[str]) -> list[bytes]:
        """The ids of single pieces, each after a space. Those without white space at their edges are encoded as one text and told apart by ids that begin with a space."""
        joinable = [p for p in pieces if p[:1].strip() and p[-1:].strip()]
        apart = [p for p in pieces if not (p[:1].strip() and p[-1:].strip())]
        out: dict[str, bytes] = {}
        groups = [joinable[i : i + _JOINED] for i in range(0, len(joinable), _JOINED)]
        for low in range(0, len(groups), 16):
            some = groups[low : low + 16]
            for group, ids in zip(some, self.encode([" " + " ".join(g) for g in some])):
                at = (np.nonzero(self.opens[np.frombuffer(ids, "<u2")])[0] * WIDTH).tolist()
                if len(at) != len(group) or at[0]:
                    apart += group
                    continue
                at.append(len(ids))
                out.update(zip(group, [ids[a:b] for a, b in zip(at, at[1:])]))
        for low in range(0, len(apart), 2048):
            some = apart[low : low + 2048]
            out.update(zip(some, self.encode([" " + p for p in some])))
        return [out[p] for p in pieces]

    def words(self, words: pa.Array, line: bool) -> pa.Array:
        """The ids of words of letters alone, each after a space or, as a pre-token of its own, a line's end."""
        first, between = (b"\n", "\n") if line else (b" ", " ")
        bounds = np.append(np.arange(0, len(words), _ROW), len(words)).astype(np.int32)
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words), between).cast(pa.binary())
        found: list[np.ndarray] = []
        for low in range(0, len(groups), 128):
            some = [_CHARACTERS[np.frombuffer(first + g, np.uint8)].tobytes().decode("utf-32-le") for g in groups[low : low + 128].to_pylist()]
            found += [np.array(e.ids, "<u2") for e in self.many.encode_batch_fast(some, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, "<u2")
        at = np.nonzero(ids == self.line if line else self.opens[ids])[0]
        if len(at) != len(words):
            return pa.array(self.encode([("\n" if line else " ") + w for w in words.to_pylist()]), pa.binary())
        return _binary(np.append(at, len(ids)) * WIDTH, pa.py_buffer(ids))

    def marked(self, pieces: pa.Array, line: bool = False) -> pa.Array:
        """The ids of words with marks behind them or none. Marks are a pre-token of their own, so a word is encoded once, whatever marks follow."""
        core = pc.utf8_rtrim(pieces, _MARKS).dictionary_encode()
        ids = self.words(core.dictionary, line).take(core.indices)
        marks = pc.replace_substring_regex(pieces, f"^{_LETTERS}+", "").dictionary_encode()
        after = pa.array([self.encode([m])[0] if m else b"" for m in marks.dictionary.to_pylist()], pa.binary())
        return pc.binary_join_element_wise(ids, after.take(marks.indices), pa.scalar(b"", pa.binary()))

    def fresh(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces, each after a space."""
        if not self.many:
            return pa.array(self.each(pieces.to_pylist()), pa.binary())
        word = f"{_LETTERS}+[{_MARKS}]*"
        plain = pc.match_substring_regex(pieces, f"^{word}$").to_numpy(zero_copy_only=False)
        rest = pieces.filter(pa.array(~plain))
        broken = pc.match_substring_regex(rest, f"^{word}\n{word}$").to_numpy(zero_copy_only=False)
        n, lines = int(plain.sum()), pc.split_pattern(rest.filter(pa.array(broken)), "\n").values
        ids = self.marked(pa.concat_arrays([pieces.filter(pa.array(plain)), lines[0::2]]))
        tails = lines[1::2].dictionary_encode()
        both = pc.binary_join_element_wise(ids[n:], self.marked(tails.dictionary, True).take(tails.indices), pa.scalar(b"", pa.binary()))
        others = pa.array(self.each(rest.filter(pa.array(~broken)).to_pylist()), pa.binary())
        place, of_rest = np.empty(len(pieces), np.int64), np.empty(len(rest), np.int64)
        of_rest[broken], of_rest[~broken] = n + np.arange(len(both)), n + len(both) + np.arange(len(others))
        place[plain], place[~plain] = np.arange(n), of_rest
        return pa.concat_arrays([ids[:n], both, others]).take(pa.array(place))

    def parted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], pa.DictionaryArray]:
        """Of texts: their bounds among all pieces, which pieces are their first, the ids of those, and the other pieces."""
        alone = pc.match_substring_regex(texts, _RUN)
        pieces = pc.split_pattern(pc.if_else(alone, "", texts), " ")
        at, pieces = pieces.offsets.to_numpy(), pieces.values
        begins = np.zeros(len(pieces), bool)
        begins[at[:-1]] = True
        heads = pc.if_else(alone, texts, pieces.filter(pa.array(begins)))
        heads = [ids for low in range(0, len(heads), _DOCS) for ids in self.encode(_objects(heads[low : low + _DOCS]))]
        return at, begins, heads, pieces.filter(pa.array(~begins)).dictionary_encode()

    def window(self, blocks: Iterable[pa.Array], end: bytes = b"") -> Iterator[pa.Array]:
        """The ids of blocks of texts that aren't null, as bytes, each followed by end. A piece is encoded once in all of them."""
        if not self.splits:
            yield from (pa.array([ids + end for ids in self.encode(texts.to_pylist())], pa.binary()) for texts in blocks)
            return
        parts = [self.parted(texts) for texts in blocks]
        # What is known comes first, so it keeps its places in the dictionary and what is new follows.
        old, codes = len(self.known), pa.chunked_array([self.known, *(p.dictionary for *_, p in parts)]).dictionary_encode().chunks  # none for an empty one
        known, of = codes[0].dictionary if codes else self.known, np.concatenate([c.indices for c in codes] or [np.zeros(0, np.int32)])[old:]
        del codes
        parts = [(*part, p.indices, len(p.dictionary)) for *part, p in parts]
        pa.default_memory_pool().release_unused()  # the dictionary's hash table
        ids = pa.concat_arrays([self.ids, self.fresh(known[old:])])
        self.known, self.ids = known, ids
        if known.nbytes + ids.nbytes > _MEMO_BYTES:
            self.forget()
        size = len(known)
        del known
        parts.reverse()
        while parts:
            at, begins, heads, codes, n = parts.pop()
            place = np.empty(len(begins), np.int32)
            place[~begins], place[begins] = of[:n][codes.to_numpy()], size + np.arange(len(heads))
            of = of[n:]
            flat = pa.concat_arrays([ids, pa.array([*heads, end], pa.binary())]).take(pa.array(np.insert(place, at[1:], size + len(heads))))
            _, bounds, data = flat.buffers()
            yield _binary(np.frombuffer(bounds, np.int32)[at + np.arange(len(at))], data)

    def block(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        return next(self.window([texts], end))

    def __call__(self, batch: list[str]) -> list[bytes]:
        return self.block(pa.array(batch, pa.string())).to_pylist()


@functools.lru_cache(1)
def _encoder(name: str) -> Encoder:
    """One for a worker: to read its file takes a sixth of a second."""
    return Encoder(name)


def _objects(column: pa.Array) -> list:
    """As to_pylist, several times faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _binary(bounds: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), data])


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows (doc_id, text) of batches anew, with about so many bytes of text at most; a text alone may have more."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = int(np.searchsorted(ends, before + most - size, "right"))
            if high <= low and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            high = max(high, low + 1)
            held.append(batch.slice(low, high - low))
            size += int(ends[high - 1] - before)
            low = high
    if held:
        yield pa.Table.from_batches(held)


_GEAR = np.random.default_rng(20240).integers(0, 1 << 32, 1 << 16, np.uint32)


def candidates(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash of the last ids allows a cut."""
    rolled = _GEAR[ids]
    for j in (1, 2, 4):  # each step doubles the ids that a hash is of, up to ROLL
        rolled[j:] += rolled[:-j] << np.uint32(4 * j)
    return np.nonzero((rolled >> np.uint32(32 - BITS)) == 0)[0] + 1


def cuts(n: int, allowed: list[int]) -> list[int]:
    """Ends of the chunks of n ids, at candidates as far as LEAST and MOST let them. As LEAST is over ROLL, ids before the first don't matter."""
    ends, last = [], 0
    for at in allowed:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree over the leaves, 16 bytes; an odd node goes up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [bytes(16)]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _lists(values: list[list[int]], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _encoded(docs: DataFrame, name: str) -> DataFrame:
    """row_key, doc_id, n_tokens, a, b, lengths, root and ids of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, base = _encoder(name), TaskContext.get().partitionId() << 33
        end = np.array([END_ID], "<u2").tobytes()
        blocks, ids_of = _blocks(batches, _BLOCK_BYTES), []

        def texts(first: pa.Table) -> Iterator[pa.Array]:
            for block in itertools.chain([first], itertools.islice(blocks, _WINDOW - 1)):
                ids_of.append(block.column(0).combine_chunks())
                yield pc.fill_null(block.column(1).cast(pa.string()).combine_chunks(), "")

        for payload in (x for first in blocks for x in encoder.window(texts(first), end)):
            doc_ids = ids_of.pop(0)
            bounds, data = np.frombuffer(payload.buffers()[1], np.int32).astype(np.int64) // WIDTH, payload.buffers()[2]
            allowed, view = candidates(np.frombuffer(data, "<u2")), memoryview(data)
            first, last = (np.searchsorted(allowed, x, "right").tolist() for x in (bounds[:-1], bounds[1:]))
            n, lengths, leaves, roots = [], [], [], []
            for at, stop, a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first, last):
                ends = cuts(stop - at, (allowed[a:b] - at).tolist())
                own = [address(view[WIDTH * (at + x) : WIDTH * (at + y)]) for x, y in zip([0, *ends], ends)]
                n.append(len(ends))
                lengths += [y - x for x, y in zip([0, *ends], ends)]
                leaves += own
                roots.append(merkle(own))
            pair = np.frombuffer(b"".join(leaves), "<i8").reshape(-1, 2)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, k)) for v, k in ((pair[:, 0], pa.int64()), (pair[:, 1], pa.int64()), (lengths, pa.int32()))]
            keys = np.arange(base, base + len(payload))
            base += len(payload)
            made = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), doc_ids, pa.array(np.diff(bounds)), *lists, pa.array(roots, pa.binary()), payload],
                ["row_key", "doc_id", "n_tokens", "a", "b", "lengths", "root", "ids"],
            )
            for low in range(0, made.num_rows, _DOCS):
                yield made.slice(low, _DOCS)
            del payload, data, view, made
            pa.default_memory_pool().release_unused()
        encoder.forget()
        trim()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"row_key long, doc_id {id_type}, n_tokens long, a array<long>, b array<long>, lengths array<int>, root binary, ids binary")


def _packed(rows: DataFrame) -> DataFrame:
    """Packs of rows that have foreign (places of chunks held elsewhere, or null), in the rows' order."""

    names = ["row_key", "doc_id", "part", "a", "b", "lengths", "ids"]

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return packs(batch).append_column("whole", batch.column(7).is_null())

        def packs(batch: pa.RecordBatch) -> pa.RecordBatch:
            alone = batch.column(7).is_null()
            whole, mixed = batch.filter(alone).select(names), batch.filter(pc.invert(alone))
            # A column that can't be null makes another schema than one that can, and a task's batches have to have one.
            whole = pa.RecordBatch.from_arrays(whole.columns, names)
            if not mixed.num_rows:  # all chunks of these rows are their own
                return whole
            out: list[list] = [[], [], [], []]
            for a, b, lengths, ids, foreign in zip(*(mixed.column(i).to_pylist() for i in range(3, 8))):
                away = set(foreign)
                mine = [i for i in range(len(a)) if i not in away]
                ends = np.cumsum([0, *lengths]) * WIDTH
                for column, value in zip(out, ([a[i] for i in mine], [b[i] for i in mine], [lengths[i] for i in mine], b"".join([ids[ends[i] : ends[i + 1]] for i in mine]))):
                    column.append(value)
            made = [*(mixed.column(i) for i in range(3)), _lists(out[0], pa.int64()), _lists(out[1], pa.int64()), _lists(out[2], pa.int32()), pa.array(out[3], pa.binary())]
            held = alone.to_numpy(zero_copy_only=False)
            order = pa.array(np.argsort(np.concatenate([np.flatnonzero(held), np.flatnonzero(~held)])))
            both = [pa.concat_arrays([x, y.cast(x.type)]) for x, y in zip(whole.columns, made)]
            return pa.RecordBatch.from_arrays([x.take(order) for x in both], names)

        return each

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows.select(*names, "foreign"), f"row_key long, doc_id {id_type}, part int, a array<long>, b array<long>, lengths array<int>, ids binary, whole boolean", start)


def write_store(docs: DataFrame, folder: str, name: str = VOCABULARY) -> None:
    """Writes the store of docs (doc_id, text) to a folder that all executors reach."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    staged = scratch.table(_encoded(docs, name), "staged", compression="zstd")
    # Within a row an address counts at its first place; later places of it are held by the same row and are foreign as well.
    at = F.explode(F.arrays_zip(F.col("a"), F.col("b"), F.sequence(F.lit(0), F.size("a") - 1).alias("place")))
    places = staged.where(F.size("a") > 0).select("row_key", "doc_id", at.alias("c")).select("row_key", "doc_id", F.col("c.a").alias("a"), F.col("c.b").alias("b"), F.col("c.place").alias("place"))
    holders = places.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row_key", "place")).alias("h")).where("n > 1")
    holders = scratch.table(holders.select("a", "b", F.col("h.row_key").alias("holder"), F.col("h.place").alias("first")), "holders")
    away = places.join(small(holders, holders.count(), 64), ["a", "b"]).where("row_key <> holder or place <> first")
    foreign = scratch.table(away.groupBy("row_key").agg(F.collect_list("place").alias("foreign")), "foreign")
    rows, values = foreign.agg(F.count("*"), F.coalesce(F.sum(F.size("foreign")), F.lit(0))).first()
    held = small(foreign, 1, rows * 48 + int(values) * 4)
    # Ids are dealt to ranges of doc_id and written from there, so a file of packs is a part: its documents in order, after those of the files before.
    ranged = staged.join(held, "row_key", "left").select("row_key", "doc_id", "a", "b", "lengths", "ids", "foreign").repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")
    _packed(ranged.withColumn("part", F.spark_partition_id())).write.option("compression", "zstd").parquet(f"{folder}/packs")

    own = F.transform("a", lambda _, i: ~F.array_contains(F.coalesce("foreign", F.array().cast("array<int>")), i))
    recipes = staged.drop("ids").join(held, "row_key", "left").withColumn("own", own).drop("foreign")
    ordered = scratch.table(recipes.join(spark.read.parquet(f"{folder}/packs").select("row_key", "part"), "row_key"), "ordered")
    scratch.drop("staged", "holders")
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.table(parts.withColumn("before", before), "parts")
    within = Window.partitionBy("part").orderBy("doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    started = ordered.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(F.broadcast(parts.select("part", "before")), "part")
    started = started.withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")
    started.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{folder}/recipes")
    scratch.drop("ordered", "foreign")

    # The manifest: a root for each part, one row per part; then the root of the store over the parts' roots.
    roots = _part_roots(spark.read.parquet(f"{folder}/recipes")).select("part", "root")
    manifest = parts.select("part", "documents", "tokens").join(roots, "part").collect()  # one small row per part
    manifest.sort(key=lambda r: r.part)  # here, as an ORDER BY would make the roots twice
    total = (-1, sum(r.documents for r in manifest), sum(r.tokens for r in manifest), merkle([bytes(r.root) for r in manifest]))
    spark.createDataFrame([*((r.part, r.documents, r.tokens, bytes(r.root)) for r in manifest), total], "part int, documents long, tokens long, root binary").coalesce(1).write.parquet(f"{folder}/manifest")
    scratch.release()


def _part_roots(rows: DataFrame) -> DataFrame:
    """part, documents, tokens, first (least start), joined (whether each document starts where the one before ends) and root of each part of rows."""

    def fold(batches):
        kinds = {"part": pa.int32(), "documents": pa.int64(), "tokens": pa.int64(), "first": pa.int64(), "joined": pa.bool_(), "root": pa.binary()}
        held_part, leaves, first, end, joined, tokens = None, [], 0, 0, True, 0

        def row():
            values = (held_part, len(leaves), tokens, first, joined, merkle(leaves))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds.values())], list(kinds))

        for batch in batches:
            for part, start, n, root in zip(*(_objects(batch.column(i)) for i in range(4))):
                if part != held_part:
                    if held_part is not None:
                        yield row()
                    held_part, leaves, first, end, joined, tokens = part, [], start, start, True, 0
                joined = joined and start == end
                end, tokens = start + n, tokens + n
                leaves.append(root)
        if held_part is not None:
            yield row()

    dealt = rows.select("part", "start", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "start")
    return dealt.mapInArrow(fold, "part int, documents long, tokens long, first long, joined boolean, root binary")


def _verify(rows: DataFrame, manifest: DataFrame) -> None:
    """Raises if the reassembled rows aren't what the manifest says, part by part and in all."""
    said = {r.part: (r.documents, r.tokens, bytes(r.root)) for r in manifest.collect()}  # one small row per part
    parts = sorted(_part_roots(rows).collect(), key=lambda r: r.part)
    found = {r.part: (r.documents, r.tokens, bytes(r.root)) for r in parts}
    found[-1] = (sum(r.documents for r in parts), sum(r.tokens for r in parts), merkle([bytes(r.root) for r in parts]))
    wrong = sorted(p for p in said.keys() | found.keys() if said.get(p) != found.get(p))
    at = 0
    for r in parts:
        if r.first != at or not r.joined:
            wrong.append(r.part)
        at += r.tokens
    if wrong:
        raise ValueError(f"the store doesn't match its manifest in parts {sorted(set(wrong))} (-1: the whole store)")


WRONG = "a document of the store doesn't match its recipe"


def _last(whole: list[bytes], digest: bool) -> pa.Array:
    """The documents' ids, or with digest their checksums."""
    return pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")) for x in whole], pa.int64()) if digest else pa.array(whole, pa.binary())


def _whole(recipes: DataFrame, packs: DataFrame, digest: bool) -> DataFrame:
    """What _assembled returns, of recipes whose packs are whole: chunks are hashed where the packs are, and only what that gives is joined."""

    def start():
        def each(batch: pa.RecordBatch):
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                a, b, lengths = some.column(1), some.column(2), some.column(3)
                bounds, sizes = a.offsets.to_numpy(), lengths.values.to_numpy()
                pairs = np.stack([x.values.to_numpy() for x in (a, b)], 1)
                if not all(np.array_equal(np.diff(bounds), np.diff(x.offsets.to_numpy())) for x in (b, lengths)):
                    raise ValueError(WRONG)
                roots, ids, shift = [], _objects(some.column(4)), lengths.offsets.to_numpy()[0] - bounds[0]
                for pack, x, y in zip(ids, bounds.tolist(), bounds[1:].tolist()):
                    ends = (np.cumsum(sizes[x + shift : y + shift]) * WIDTH).tolist()
                    leaves = [address(pack[i:j]) for i, j in zip([0, *ends], ends)]
                    if b"".join(leaves) != pairs[x:y].tobytes() or ends[-1:] != [len(pack)]:
                        raise ValueError(WRONG)
                    roots.append(merkle(leaves))
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), pa.array([len(x) // WIDTH for x in ids], pa.int64()), pa.array(roots, pa.binary()), _last(ids, digest)], names)

        return each

    last = "ids_crc32" if digest else "ids"
    names = ["row_key", "of_a", "of_b", "of_lengths", "n", "made", last]
    found = arrow_map(packs.select("row_key", "a", "b", "lengths", "ids"), f"row_key long, of_a array<long>, of_b array<long>, of_lengths array<int>, n long, made binary, {last} {'long' if digest else 'binary'}", start)
    right = F.expr("made = root and n = n_tokens and of_a = a and of_b = b and of_lengths = lengths")
    checked = F.when(right, F.col("root")).otherwise(F.raise_error(F.lit(WRONG)).cast("binary"))
    return recipes.join(found, "row_key", "left").select("doc_id", "start", "n_tokens", last, "part", checked.alias("root"))


def _assembled(rows: DataFrame, digest: bool) -> DataFrame:
    """doc_id, start, n_tokens, ids (with digest, ids_crc32 in their place), part and root of rows with their pack and foreign chunks, all of it verified."""

    def start():
        def each(batch: pa.RecordBatch):
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                whole, roots = [], []
                offsets = [part.column(i).offsets.to_numpy() for i in range(2, 6)]
                a, b, lengths, own = (part.column(i).values.to_numpy(zero_copy_only=False) for i in range(2, 6))
                for row, (root, n, pack, foreign) in enumerate(zip(*(part.column(i).to_pylist() for i in range(6, 10)))):
                    of_a, of_b, sizes, mine = (values[at[row] : at[row + 1]] for values, at in zip((a, b, lengths, own), offsets))
                    if mine.all():
                        ends = (np.cumsum(sizes) * WIDTH).tolist()
                        chunks = [pack[x:y] for x, y in zip([0, *ends], ends)] if len(ends) > 1 else [pack]
                    else:
                        elsewhere = {f["place"]: f["chunk"] for f in foreign or ()}
                        at, chunks = 0, []
                        for place, (length, held) in enumerate(zip(sizes.tolist(), mine.tolist())):
                            if held:
                                chunks.append(pack[at : at + WIDTH * length])
                                at += WIDTH * length
                            else:
                                chunks.append(elsewhere[place])
                    leaves = [address(c) for c in chunks]
                    roots.append(merkle(leaves))
                    if b"".join(leaves) != np.stack([of_a, of_b], 1).tobytes() or roots[-1] != root or sum(map(len, chunks)) != n * WIDTH:
                        raise ValueError(WRONG)
                    whole.append(b"".join(chunks))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(7), _last(whole, digest), part.column(10), pa.array(roots, pa.binary())], ["doc_id", "start", "n_tokens", name, "part", "root"])

        return each

    name, kind = ("ids_crc32", "long") if digest else ("ids", "binary")
    chosen = rows.select("doc_id", "start", "a", "b", "lengths", "own", "root", "n_tokens", "ids", "foreign", "part")
    return arrow_map(chosen, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, {name} {kind}, part int, root binary", start)


def _slices(packs: DataFrame) -> DataFrame:
    """a, b and chunk of the packs' chunks at wanted (places within the pack)."""

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out: list[list] = [[], [], []]
            for a, b, lengths, ids, wanted in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ends = np.cumsum([0, *lengths]) * WIDTH
                for i in wanted:
                    for column, value in zip(out, (a[i], b[i], ids[ends[i] : ends[i + 1]])):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["a", "b", "chunk"]) if out[0] else None

        return each

    return arrow_map(packs.select("a", "b", "lengths", "ids", "wanted"), "a long, b long, chunk binary", start)


def read_store(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (their bytes; with digest, ids_crc32 in their place) of every document, from the store's files, once all of them match the manifest."""
    scratch = Scratch(spark, "restore")
    recipes, packs = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/packs")
    zipped = F.arrays_zip(F.col("a"), F.col("b"), F.col("own"), F.sequence(F.lit(0), F.size("a") - 1).alias("place"))
    needs = recipes.where(F.exists("own", lambda x: ~x)).select("row_key", F.explode(F.filter(zipped, lambda c: ~c["own"])).alias("c"))
    needs = scratch.table(needs.select("row_key", "c.a", "c.b", "c.place"), "needs")
    unique = scratch.table(needs.select("a", "b").distinct(), "unique")
    held = F.arrays_zip(F.col("a"), F.col("b"), F.sequence(F.lit(0), F.size("a") - 1).alias("place"))
    index = packs.where(F.size("a") > 0).select("row_key", F.explode(held).alias("c")).select("row_key", "c.a", "c.b", "c.place")
    wanted = index.join(small(unique, unique.count(), 48), ["a", "b"]).groupBy("row_key").agg(F.collect_list("place").alias("wanted"))
    wanted = scratch.table(wanted, "wanted")
    rows, values = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()
    slices = scratch.table(_slices(packs.join(small(wanted, 1, rows * 48 + int(values) * 4), "row_key")), "slices")
    foreign = needs.join(slices.hint("merge"), ["a", "b"]).groupBy("row_key").agg(F.collect_list(F.struct("place", "chunk")).alias("foreign"))
    scratch.release()
    alone = F.forall("own", lambda x: x)
    met = recipes.where(~alone).join(packs.where("not whole").select("row_key", "ids").hint("merge"), "row_key", "left").join(foreign, "row_key", "left")
    whole = scratch.table(_whole(recipes.where(alone), packs.where("whole"), digest).unionByName(_assembled(met, digest)), "whole", compression="zstd")
    _verify(whole, spark.read.parquet(f"{folder}/manifest"))
    return whole.drop("part", "root")


def store_and_read(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """Writes docs to a new store in the shared folder, reads it back: doc_id, start, n_tokens and ids_crc32 of every document."""
    folder = Scratch(docs.sparkSession, "store").root
    write_store(docs, folder, name)
    return read_store(docs.sparkSession, folder, digest=True)
