"""SentencePiece encoding and decoding by batched Viterbi search in numpy.

Words of equal length advance together: at every position the substrings that end there are
looked up by hash among the sorted piece keys, and the best predecessor of each word is taken
by a maximum over all piece lengths, with backpointers. For a unigram model the score of a path
is the sum of its piece scores. For a byte-pair model a path is allowed only where every pair of
neighbouring pieces is itself the model's encoding of its text; exactly one path fulfils this,
and it is the one that merging gives, so ids equal the library's.

Words can be encoded apart where no piece of the model has a space mark behind another
character, which is checked on loading.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrank.llm.common import mix

MARK = "▁"
HELD_WORDS = 400_000  # encoded words a task keeps
AT_ONCE = 2_000_000  # characters split into words at a time, but for longer texts
HELD_PAIRS = 1_000_000  # verdicts on pairs of pieces a task keeps
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_TOP = 18


class Pieces:
    """Piece table of a SentencePiece model file, with the search over it."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        self.merging = model.trainer_spec.model_type == 2
        if not self.merging and model.trainer_spec.model_type != 1:
            raise ValueError("only unigram and byte-pair models are supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.lowest = min(model.pieces[i].score for i in self.id_of.values())
        self.score = np.array([p.score for p in model.pieces], np.float64)
        self.scores = self.score.tolist()
        self.byte_ids = [next((i for i, p in enumerate(model.pieces) if p.type == 6 and int(p.piece[3:5], 16) == b), None) for b in range(256)]
        if None in self.byte_ids:
            raise ValueError("only models with byte pieces are supported")
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        if any(MARK in n.lstrip(MARK) for n in self.id_of):
            raise ValueError("a piece crosses a word border")
        self.longest = max(map(len, self.id_of))
        keys = np.array([self._key(n) for n in self.id_of], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.id_of.values()), np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        # where the keys of each top-bits range begin, and the most keys in one range
        self.begins = np.append(0, np.cumsum(np.bincount((self.keys >> _U(64 - _TOP)).astype(np.int64), minlength=1 << _TOP)))
        self.unknown = len(self.names)  # stands for one character without a piece of its own
        self.pairs: dict[int, bool] = {}
        self.table = (np.array([1 << 62]), np.array([False]))  # the same verdicts, sorted
        self.lone = np.full(len(self.names) + 1, -1, np.int8)  # whether a piece stands alone, -1 where not asked yet
        self.lone[self.unknown] = 1
        self.forget()

    def forget(self) -> None:
        """Drops the encoded words: numbers of words, and by number the ids one after another."""
        self.words: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def _key(text: str) -> int:
        with np.errstate(over="ignore"):
            h = _U(0)
            for c in text:
                h = h * _STEP + _U(ord(c) + 1)
            return int(mix(np.array([h ^ _U(len(text))], np.uint64))[0])

    def merged(self, text: str) -> list[str]:
        """The model's merges, the best-scored neighbour pair first, the left one among equals."""
        parts, get, scores, none = list(text), self.id_of.get, self.scores, -np.inf

        def value(i: int) -> float:
            k = get(parts[i] + parts[i + 1])
            return none if k is None else scores[k]

        values = [value(i) for i in range(len(parts) - 1)]
        while values:
            best = max(values)
            if best == none:
                break
            at = values.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del values[at]  # of the other pairs only the two beside the merge change
            if at:
                values[at - 1] = value(at - 1)
            if at < len(values):
                values[at] = value(at)
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the pair stands as two tokens in the encoding of its joined text."""
        key = left * (self.unknown + 1) + right
        known = self.pairs.get(key)
        if known is None:
            if left == self.unknown or right == self.unknown:
                known = True
            else:
                known = self.merged(self.names[left] + self.names[right]) == [self.names[left], self.names[right]]
            if len(self.pairs) >= HELD_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def alone(self, pieces: np.ndarray) -> np.ndarray:
        """Whether pieces are the encoding of their own text; a piece that no merges reach is not."""
        for p in np.unique(pieces[self.lone[pieces] < 0]).tolist():
            self.lone[p] = self.merged(self.names[p]) == [self.names[p]]
        return self.lone[pieces] == 1

    def _allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Verdicts on many pairs: known ones from a sorted table, new ones worked out once each."""
        pair = left * (self.unknown + 1) + right
        at = np.searchsorted(self.table[0], pair)
        at[at == len(self.table[0])] = 0
        verdict, miss = self.table[1][at], np.flatnonzero(self.table[0][at] != pair)
        if len(miss):
            new, back = np.unique(pair[miss], return_inverse=True)
            verdict[miss] = np.fromiter((self.fits(*divmod(int(p), self.unknown + 1)) for p in new), bool, len(new))[back]
        return verdict

    def _renew_table(self) -> None:
        if len(self.pairs) > 1.2 * len(self.table[0]) or len(self.pairs) < len(self.table[0]) - 1:
            keys, vals = np.fromiter(self.pairs.keys(), np.int64), np.fromiter(self.pairs.values(), bool)
            order = np.argsort(keys)
            self.table = (np.append(keys[order], np.int64(1) << 62), np.append(vals[order], False))

    def lookup(self, probe: np.ndarray) -> np.ndarray:
        """Piece ids of hashes among the sorted keys, -1 where there is none."""
        top = (probe >> _U(64 - _TOP)).astype(np.int64)
        at, end = self.begins[top], self.begins[top + 1]
        found = np.full(len(probe), -1, np.int64)
        row = np.flatnonzero(at < end)
        while len(row):  # most ranges are empty, the others hold few keys
            hit = self.keys[at[row]] == probe[row]
            found[row[hit]] = self.key_ids[at[row[hit]]]
            row = row[~hit]
            at[row] += 1
            row = row[at[row] < end[row]]
        return found

    def search(self, words: list[str]) -> list[list[int]]:
        """Ids of words that all have the same length."""
        ids, count = self.paths(words)
        return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Paths of words that all have the same length: their ids one after another, and their numbers of ids."""
        self._renew_table()
        n, m = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(m, n).T.astype(np.uint64) + _U(1)
        last, size = np.full((n + 1, m), -1, np.int32), np.zeros((n + 1, m), np.int32)
        best = None if self.merging else np.full((n + 1, m), -np.inf)
        if best is not None:
            best[0] = 0.0
        with np.errstate(over="ignore"):
            for end in range(1, n + 1):
                rows, h, power = np.arange(m), np.zeros(m, np.uint64), _U(1)
                for width in range(1, min(self.longest, end) + 1):
                    begin = end - width
                    h = h + (codes[begin] if len(rows) == m else codes[begin, rows]) * power
                    power = power * _STEP
                    at = np.flatnonzero(last[begin, rows] >= 0) if begin else np.arange(len(rows))
                    if not len(at):
                        continue
                    piece = self.lookup(mix(h[at] ^ _U(width)))
                    if width == 1:
                        piece[piece < 0] = self.unknown
                    at, piece = at[piece >= 0], piece[piece >= 0]
                    if not len(at):
                        continue
                    row = rows[at]
                    if best is None:
                        ok = self._allowed(last[begin, row].astype(np.int64), piece) if begin else self.alone(piece)
                    else:
                        total = best[begin, row] + np.where(piece == self.unknown, self.lowest - 10.0, self.score[np.minimum(piece, self.unknown - 1)])
                        ok = total > best[end, row]
                        best[end, row[ok]] = total[ok]
                    last[end, row[ok]], size[end, row[ok]] = piece[ok], width
                    if best is None and ok.any():  # one path at most ends here
                        rest = np.ones(len(rows), bool)
                        rest[at[ok]] = False
                        rows, h = rows[rest], h[rest]
                        if not len(rows):
                            break
        if (last[n] < 0).any():
            raise RuntimeError(f"no path through {words[int(np.argmin(last[n]))]!r}")
        at, rows, steps = np.full(m, n), np.arange(m), []
        while at.any():
            steps.append(np.where(at > 0, last[at, rows], -1))
            at = at - size[at, rows]
        paths = np.stack(steps[::-1], axis=1)
        there, strange = paths >= 0, (paths == self.unknown).any(axis=1)
        if not strange.any():
            return paths[there], there.sum(axis=1)
        ids, count = paths[there].astype(np.int32), there.sum(axis=1)
        ends, made, at = np.cumsum(count), [], 0
        for i in np.flatnonzero(strange).tolist():  # only these are spelled out one by one
            begin, end = int(ends[i] - count[i]), int(ends[i])
            made += [ids[at:begin], np.array(self._bytes(words[i], ids[begin:end].tolist()), np.int32)]
            at, count[i] = end, len(made[-1])
        return np.concatenate([*made, ids[at:]]), count

    def _bytes(self, word: str, path: list[int]) -> list[int]:
        """The path with unknown characters as the pieces of their bytes."""
        ids, at = [], 0
        for p in path:
            step = 1 if p == self.unknown else len(self.names[p])
            ids += [p] if p != self.unknown else [self.byte_ids[b] for b in word[at : at + step].encode()]
            at += step
        return ids

    def search_one(self, word: str) -> list[int]:
        """The same search for a long word alone, with a piece table instead of hashes; byte-pair models only."""
        n = len(word)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for width in range(1, min(self.longest, end) + 1):
                begin = end - width
                p = self.id_of.get(word[begin:end], self.unknown if width == 1 else -1)
                if p < 0 or (begin and last[begin] < 0):
                    continue
                if self.fits(last[begin], p) if begin else self.alone(np.array([p]))[0]:
                    last[end], size[end] = p, width
                    break  # no other piece can end here
        path, at = [], n
        while at > 0:
            path.append(last[at])
            at -= size[at]
        return self._bytes(word, path[::-1])

    def _learn(self, fresh: list[str]) -> None:
        """Searches words in groups of equal length and keeps their ids."""
        groups: dict[int, list[str]] = {}
        for w in fresh:
            groups.setdefault(len(w), []).append(w)
        flat, counts = [self.flat], []
        for length, words in groups.items():
            if self.merging and len(words) < 8:
                for w in words:
                    flat.append(np.array(self.search_one(w), np.int32))
                    counts.append([len(flat[-1])])
            else:
                step = max(1, 400_000 // (length + 1))
                for i in range(0, len(words), step):
                    ids, count = self.paths(words[i : i + step])
                    flat.append(ids)
                    counts.append(count)
            at = len(self.words)
            self.words.update(zip(words, range(at, at + len(words))))
        self.flat = np.concatenate(flat)
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts)))

    def encode(self, body: list[str]) -> list[list[int]]:
        """Ids of texts as plain lists."""
        return [ids.tolist() for ids in self.encoded(body)]

    def encoded(self, body: list[str]) -> Iterator[np.ndarray]:
        """Ids of texts one by one; unseen words are searched in groups of equal length, for some megabytes of text at a time."""
        at = 0
        while at < len(body):
            stop, held = at, 0
            while stop < len(body) and (stop == at or held + len(body[stop]) <= AT_ONCE):
                held += len(body[stop])
                stop += 1
            split = [_WORD.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in body[at:stop]]
            seen = set().union(*split)
            fresh = [w for w in seen if w not in self.words]
            if len(self.words) + len(fresh) > HELD_WORDS and self.words:
                self.forget()
                fresh = list(seen)
            if fresh:
                self._learn(fresh)
            for words in split:
                which = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
                start, stops = self.ends[which], self.ends[which + 1]
                count = stops - start
                place = np.repeat(stops - np.cumsum(count), count) + np.arange(int(count.sum()))
                yield self.flat[place]
            at = stop

    def decode(self, ids) -> str:
        """The text of ids; bytes that form no UTF-8 become replacement characters."""
        parts, held = [], bytearray()
        for i in np.asarray(ids, np.int64).tolist():
            if self.kinds[i] == 6:
                held.append(int(self.names[i][3:5], 16))
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if self.kinds[i] == 1:
                parts.append(self.names[i])
        if held:
            parts.append(held.decode("utf-8", "replace"))
        text = "".join(parts).replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """The model of a path; a Python worker keeps it, with its words and verdicts, from task to task."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _over_batches(model_path: str, way: str):
    """An iterator function for a pandas UDF; one model serves all batches of a task."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(model_path)
        for part in parts:
            known = [i for i, x in enumerate(part) if x is not None]
            made: list = [None] * len(part)
            given = [part.iloc[i] for i in known]
            done = model.encoded(given) if way == "encode" else map(model.decode, given)
            for i, x in zip(known, done):
                made[i] = x
            yield pd.Series(made, dtype=object)

    return run


def encode(docs: DataFrame, model_path: str, out: str = "ids") -> DataFrame:
    """``docs`` with its texts' ids (array<int>) as column ``out`` at the end; a column of that name is replaced.

    A null text has null ids, an empty one none. Rows, repeats, ids and other columns stay as
    they are; no rows give no rows. Texts are encoded whole.
    """
    kept = [c for c in docs.columns if c != out]
    ids_of = F.pandas_udf(_over_batches(model_path, "encode"), "array<int>")
    return docs.select(*[F.col(f"`{c}`") for c in kept], ids_of(F.col("text").cast("string")).alias(out))


def decode(frame: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The frame with the texts of its ids as column ``out``; null ids give null texts. U+2581 of the original comes back as a space, as the model reads both alike."""
    text_of = F.pandas_udf(_over_batches(model_path, "decode"), "string")
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns if c != out], text_of(F.col(f"`{ids}`")).alias(out))
