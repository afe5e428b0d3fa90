"""Chunkers: one text to many chunks, by paragraph, markdown section, speaker turn or chat round. Sizes are characters.

Packing is stateful along a text, so chunkers are Python over Arrow batches; texts never meet, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TARGET, OVERLAP = 1200, 200
SEGMENT = 6000
_ROLE = re.compile(r"\s*(?:user|assistant|human|ai):", re.I)
_ASKS = re.compile(r"\s*(?:user|human):", re.I)
_HEADING = re.compile(r"\s*(#{1,6}) ")
_MARKDOWN = (".md", ".markdown", ".mdx")


def is_conversation(text: str) -> bool:
    return sum(bool(_ROLE.match(line)) for line in text.split("\n")) >= 2


def is_markdown(text: str) -> bool:
    return sum(bool(re.match(r"\s*#{1,3} ", line)) for line in text.split("\n")) >= 2


def is_speaker(line: str) -> bool:
    """Whether a line starts with a speaker's label and a colon, after a bracketed time or not."""
    label, colon, _ = re.sub(r"^\s*\[[^\]]*\]\s*", "", line).partition(":")
    label = label.strip()
    return bool(colon and label) and len(label) <= 32 and len(label.split()) <= 3 and (label[0].isupper() or label[0] in "0123456789") and not set(label) & set(".!?,")


def sentences(text: str, target: int) -> list[str]:
    """Pieces of at most target characters: whole sentences while they fit, longer ones cut."""
    pieces, held = [], ""
    for sentence in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$", text):
        if held and len(held) + len(sentence) > target:
            pieces.append(held)
            held = ""
        if len(sentence) > target:
            pieces += [sentence[i : i + target] for i in range(0, len(sentence), target)]
        else:
            held += sentence
    return [p for p in map(str.strip, [*pieces, held]) if p]


def fit(pieces: list[str], target: int) -> list[str]:
    return [part for piece in pieces for part in ([piece] if len(piece) <= target else sentences(piece, target))]


def pack(pieces: list[str], target: int, overlap: int) -> list[str]:
    """Chunks of pieces set off by blank lines; each chunk but the first starts with the end of the one before."""
    chunks: list[str] = []
    held = ""
    for piece in pieces:
        if held and len(held) + 2 + len(piece) > target:
            chunks.append(held)
            held = held[-overlap:] if overlap else ""
        held = f"{held}\n\n{piece}" if held else piece
    return chunks + [held] if held.strip() else chunks


def paragraphs(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    text = text.strip()
    if len(text) <= target:
        return [text] if text else []
    return pack(fit([p for p in map(str.strip, text.split("\n\n")) if p], target), target, overlap)


def _split_before(lines: list[str], starts) -> list[str]:
    groups: list[list[str]] = []
    for line in lines:
        if not groups or starts(line) and any(x.strip() for x in groups[-1]):
            groups.append([])
        groups[-1].append(line)
    return [g for g in ("\n".join(x).strip() for x in groups) if g]


def rounds(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """A chunk for each question and its answers; a longer round by paragraphs."""
    found = _split_before(text.split("\n"), _ASKS.match)
    if len(found) < 2:
        return paragraphs(text, target, overlap)
    return [c for r in found for c in ([r] if len(r) <= target else paragraphs(r, target, overlap))]


def transcript(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    turns = _split_before(text.strip().split("\n"), is_speaker)
    return pack(fit(turns, target), target, overlap) if len(turns) >= 2 else paragraphs(text, target, overlap)


def markdown(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Sections under the trail of headings above them; headings without a body give nothing."""
    trail: dict[int, str] = {}
    sections: list[tuple[str, list[str]]] = [("", [])]
    for line in text.strip().split("\n"):
        if m := _HEADING.match(line):
            level = len(m[1])
            trail = {k: v for k, v in trail.items() if k < level} | {level: line.strip()}
            sections.append((" ▸ ".join(trail.values()), []))
        else:
            sections[-1][1].append(line)
    bodies = [(crumb, "\n".join(lines).strip()) for crumb, lines in sections]
    pieces = [f"{crumb}\n{body}" if crumb else body for crumb, body in bodies if body]
    return pack(fit(pieces, target), target, overlap) if pieces else paragraphs(text, target, overlap)


def chunk(text: str | None, source: str | None = None, path: str | None = None, smart: bool = True) -> list[str]:
    """Chunks of a text by the chunker that suits it."""
    text = (text or "").replace("\r\n", "\n")
    if not smart:
        return paragraphs(text)
    if source == "chat" or is_conversation(text):
        return rounds(text)
    if source == "meeting":
        return transcript(text)
    if (path or "").lower().endswith(_MARKDOWN) or is_markdown(text):
        return markdown(text)
    return paragraphs(text)


def chunks(docs: DataFrame, smart: bool = True, segment: int | None = None) -> DataFrame:
    """id, chunk_index and content of each chunk of docs (id, source, path, content); with segment, plain segments of that size without overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, contents = [], [], []
            for id_, source, path, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                parts = chunk(content, source, path, smart) if segment is None else paragraphs(content or "", segment, 0)
                ids += [id_] * len(parts)
                places += range(len(parts))
                contents += parts
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(places, pa.int32()), pa.array(contents, pa.string())], ["id", "chunk_index", "content"])

    return docs.select("id", "source", "path", "content").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, chunk_index int, content string")
