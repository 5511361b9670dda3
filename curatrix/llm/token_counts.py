"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where nothing can differ.

Merges join neighbours only into pieces of the vocabulary. Where no piece has two given characters side by side, no merge
ever crosses between them, in a chunk as in the whole text, so both sides are encoded independently: such a place
is a stable boundary. Consecutive chunks overlap; they are spliced at a stable boundary that both encodings show, and
the overlap is doubled while there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 14
OVERLAP = 1 << 7
BATCH_CHARS = 1 << 20
SPACE = "▁"


class ChunkedTokenizer:
    """A sentencepiece BPE model for texts of any length."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        is_byte = [self.model.is_byte(i) for i in range(size)]
        #: Characters that a piece covers; of the bytes of one character only the first counts.
        self.width = np.array([
            (0 if 0x80 <= int(p[3:5], 16) < 0xC0 else 1) if b else len(p) for p, b in zip(pieces, is_byte)], np.int64)
        self.adjacent = {p[i:i + 2] for p, b in zip(pieces, is_byte) if not b for i in range(len(p) - 1)}
        probe = self.model.encode("a", out_type=str)
        self.prefix = 1 if probe[0].startswith(SPACE) else 0

    def is_stable(self, text: str, at: int) -> bool:
        return text[at - 1:at + 1].replace(" ", SPACE) not in self.adjacent

    def _encode(self, text: str, start: int, end: int) -> tuple[list[int], np.ndarray]:
        """Ids of a chunk and where each token begins in the text."""
        ids = self.model.encode(text[start:end], num_threads=1)
        ends = np.cumsum(self.width[ids])
        begins = start + ends - self.width[ids] - self.prefix
        # Continuation bytes begin where their character does; they are no boundary.
        begins[self.width[ids] == 0] = -1
        return ids, begins

    def _common(self, text: str, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
        """The last stable boundary in (low, high) that both encodings have."""
        shown = np.intersect1d(left[(left > low) & (left < high)], right[right > low])
        for at in shown[::-1].tolist():
            if self.is_stable(text, at):
                return at
        return None

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text, the same as in one go."""
        if len(text) <= self.chunk:
            return self.model.encode(text, num_threads=1)
        out: list[int] = []
        start, end = 0, self.chunk
        ids, begins = self._encode(text, start, end)
        skip, spliced = 0, 0
        while end < len(text):
            overlap, splice = self.overlap, None
            while splice is None:
                low = end - overlap
                if low <= start:  # no stable place in the whole chunk: take it and as much again as one
                    end = min(len(text), 2 * end - start)
                    ids, begins = self._encode(text, start, end)
                    skip = int(np.flatnonzero(begins == spliced)[0]) if start else 0
                    break
                to = min(len(text), low + self.chunk + overlap)
                more, later = self._encode(text, low, to)
                splice = self._common(text, begins, later, low, end)
                overlap *= 2
            if splice is None:
                continue
            out += ids[skip:int(np.flatnonzero(begins == splice)[0])]
            ids, begins, start, end = more, later, low, to
            spliced = splice
            skip = int(np.flatnonzero(begins == splice)[0])
        return out + ids[skip:]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        short = [t for t in texts if len(t) <= self.chunk]
        ready = iter(self.model.encode(short, num_threads=1) if short else [])
        return [next(ready) if len(t) <= self.chunk else self.encode(t) for t in texts]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids) of every row, without begin or end marks; ``ids`` only on demand.

    ``model_path`` names a sentencepiece BPE model that every executor has. Null is taken as an empty text, which has no
    tokens. Repeated rows each get a row; extra columns are not read. A task holds one chunk of a text at a
    time besides the text itself.
    """
    names = ["doc_id", "n_bytes", "n_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ChunkedTokenizer(model_path, chunk, overlap)
        keys, sizes, texts, chars = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = tokenizer.encode_many(texts)
            columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(map(len, ids), pa.int64())]
            return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

        for batch in batches:
            for key, size, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                keys.append(key)
                sizes.append(size)
                texts.append(text.as_py())
                chars += len(texts[-1])
                if chars >= BATCH_CHARS:
                    yield flush()
                    keys, sizes, texts, chars = [], [], [], 0
        yield flush()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long" + ", ids array<int>" * with_ids)
