"""Token counts with overlap resynchronisation for long texts.

A text up to ``CHUNK`` bytes is encoded at once. A longer one is encoded in overlapping chunks
whose tokens carry byte offsets. Two neighbouring encodings are spliced at a token that both
hold (same place, same id) inside their overlap. Such a splice is proven: a byte-pair encoding
is the one sequence in which every pair of neighbouring tokens is itself the encoding of its
text, for merges never cross the borders of final tokens, so whether one crosses a border
depends on the two tokens beside it alone; and each pair of the spliced sequence stands in one
of the two encodings. If the overlap shows no common token it is widened, at last to the start
of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.llm.common import arrow_rows, fixed_columns, texts

CHUNK = 16_384
OVERLAP = 256
LIMIT = 4096

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class Piecewise:
    """A SentencePiece model with the byte length of each of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        sizes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            # a space mark stands for one byte, a byte piece for its byte
            sizes.append(1 if self.model.is_byte(i) else len(piece.replace("▁", " ").encode()))
        self.sizes = np.array(sizes, np.int64)

    def ids(self, body: list[str]) -> list[list[int]]:
        return self.model.encode(body, num_threads=1)

    def at(self, data: bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, id) of the tokens of a chunk; the model's own leading space stands one byte before it."""
        ids = np.array(self.model.encode(data[start:end].decode(), num_threads=1), np.int64)
        ends = np.cumsum(self.sizes[ids])
        return start - 1 + ends - self.sizes[ids], ids


def _edge(data: bytes, at: int) -> int:
    """The nearest start of a code point at or before a byte."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def spliced(model: Piecewise, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[np.ndarray]:
    """The ids of a text of any length in order, in pieces, together equal to one encoding of the whole.

    A splice touches the last piece alone; earlier ones join it only when an overlap is widened
    back to them, so that the work grows with the text.
    """
    data = text.replace("▁", " ").encode()  # the model reads both alike; now every mark has one byte
    end = _edge(data, min(len(data), chunk))
    pieces = [model.at(data, 0, end)]
    while end < len(data):
        upto = _edge(data, min(len(data), end + chunk))
        width = overlap
        while True:
            start = _edge(data, max(0, end - width))
            more, new = model.at(data, start, upto)
            if start == 0:
                pieces = [(more, new)]
                break
            if pieces[-1][0][0] > start:
                first = len(pieces) - 1
                while first and pieces[first][0][0] > start:
                    first -= 1
                pieces[first:] = [tuple(np.concatenate(side) for side in zip(*pieces[first:]))]
            places, ids = pieces[-1]
            # tokens of the new encoding that the old one holds at the same place with the same id
            inside = int(np.searchsorted(more, end))
            where = np.searchsorted(places, more[:inside])
            where[where == len(places)] = 0
            same = np.flatnonzero((places[where] == more[:inside]) & (ids[where] == new[:inside]))
            if len(same):
                j = int(same[0])
                i = int(where[j])
                pieces[-1:] = [(places[:i], ids[:i])] * (i > 0) + [(more[j:], new[j:])]
                break
            width = 2 * width + 1  # an odd step also shifts the phase of a repeating run
        end = upto
    return [ids for _, ids in pieces]


def resynchronised(model: Piecewise, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of ``spliced`` in one array."""
    return np.concatenate(spliced(model, text, chunk, overlap))


def counts(docs: DataFrame, model_path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids give a row each;
    other columns are not read; no rows give no rows. ``model_path`` is a file on every executor.
    """

    def count(parts):
        model = Piecewise(model_path)
        for part in parts:
            body = texts(part.column("text"))
            size = [len(t.encode()) for t in body]
            n = np.zeros(len(body), np.int64)
            short = [i for i, s in enumerate(size) if 0 < s <= chunk]
            for i, ids in zip(short, model.ids([body[i] for i in short])):
                n[i] = len(ids)
            for i, s in enumerate(size):
                if s > chunk:
                    n[i] = sum(map(len, spliced(model, body[i], chunk, overlap)))
            yield arrow_rows(_COUNTS, [part.column("doc_id"), size, n])

    made = fixed_columns(docs, "doc_id", "text").mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
