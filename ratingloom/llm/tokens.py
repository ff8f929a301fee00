"""Token counts that equal the tokenizer library's own, also for huge documents.

Texts of up to ``CHUNK_CHARS`` and an overlap go to the library in batches.  Any
longer one is encoded in overlapping chunks with offsets, and two neighbouring
chunks are spliced at a common boundary that is proven stable:

* SentencePiece BPE: when no piece of the vocabulary holds a space mark after
  another character (runs of marks aside), no merge can cross the place before a
  space that follows a non-space, so both sides are segmented independently.
* ``tokenizers`` files: no token crosses a pre-token, so a place that is a
  pre-token boundary in both chunks, with more text seen after it in the left
  one, is stable.

Both chunks must also have a token boundary there.  Where none is found in the
overlap it is doubled, in the end to the whole text, so the count is exact
whatever the text; it costs time only for texts without stable places.

Defined results: a null text is empty; a null id is returned as null; repeated
rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 8_192
OVERLAP_CHARS = 512

_LOADED: dict[str, object] = {}


class PieceModel:
    """A SentencePiece file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any("▁" in p[1:] and p.strip("▁") for p in pieces)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, return_type="numpy", num_threads=1)]

    def ends(self, text: str) -> list[int]:
        """The offsets at which tokens end; a token that adds no text repeats an offset."""
        return [end for _, end in self.model.encode(text, return_type="offset_mapping")["offsets"]]

    def stable(self, text: str, low: int, high: int) -> Iterator[int]:
        if self.splits:
            for i in range(max(low, 1), high):
                if text[i] == " " and not text[i - 1].isspace():
                    yield i


class JsonModel:
    """A ``tokenizers`` file; special strings in texts are treated as by default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        added = self.model.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        self.splits = self.model.normalizer is None and self.model.pre_tokenizer is not None

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def ends(self, text: str) -> list[int]:
        return [e for _, e in self.model.encode(text, add_special_tokens=False).offsets]

    def stable(self, text: str, low: int, high: int) -> Iterator[int]:
        if self.splits and not any(s in text for s in self.special):
            yield from (e for _, (_, e) in self.model.pre_tokenizer.pre_tokenize_str(text) if low < e < high - 64)


def load(path: str) -> PieceModel | JsonModel:
    if path not in _LOADED:
        _LOADED[path] = (PieceModel if path.endswith(".model") else JsonModel)(path)
    return _LOADED[path]


def count_huge(model: PieceModel | JsonModel, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int]:
    """The number of tokens of ``text`` by overlap resynchronisation, and the number of spliced chunks."""
    if len(text) <= chunk + overlap or not model.splits:
        return model.counts([text])[0], 1
    total, start = 0, 0  # tokens that end at or before ``start`` are counted
    begin = 0  # where the running chunk was cut
    chunks = 1
    while True:
        stop = min(len(text), start + chunk)
        widen = overlap
        while True:
            left_to = min(len(text), stop + widen)
            left = model.ends(text[begin:left_to])
            if left_to == len(text):
                return total + sum(1 for e in left if begin + e > start or (start == 0)), chunks
            place = _splice(model, text, begin, left_to, left, stop, widen)
            if place is not None:
                break
            widen *= 2
        cut, right_begin = place
        total += sum(1 for e in left if (begin + e > start or start == 0) and begin + e <= cut)
        start, begin = cut, right_begin
        chunks += 1


def _splice(model, text: str, begin: int, left_to: int, left: list[int], stop: int, widen: int) -> tuple[int, int] | None:
    """A stable boundary common to the left chunk and to one that begins in the overlap, and that beginning."""
    right_begin = max(begin + 1, stop - widen)
    right_to = min(len(text), left_to + widen)
    right_text = text[right_begin:right_to]
    right = {right_begin + e for e in model.ends(right_text)}
    ours = {begin + e for e in left}
    mine = {begin + i for i in model.stable(text[begin:left_to], stop - begin - widen, left_to - begin)}
    theirs = {right_begin + i for i in model.stable(right_text, 0, left_to - right_begin)}
    # A right chunk starts in the middle of the text; only a boundary past its own first piece counts.
    common = sorted(p for p in mine & theirs & ours & right if p > right_begin + min(64, widen // 4))
    return (common[len(common) // 2], right_begin) if common else None


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, n_chunks`` of every whole text, without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, chunks = [0] * len(texts), [1] * len(texts)
            small = [i for i, t in enumerate(texts) if len(t) <= chunk + overlap]
            for at in range(0, len(small), 256):  # so many token lists at once
                some = small[at : at + 256]
                for i, n in zip(some, model.counts([texts[i] for i in some]), strict=True):
                    counts[i] = n
            for i, t in enumerate(texts):
                if len(t) > chunk + overlap:
                    counts[i], chunks[i] = count_huge(model, t, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(chunks, pa.int32())], names=["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_chunks int")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
