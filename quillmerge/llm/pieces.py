"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

A text is cut into words, each led by the space mark that a blank becomes.  The
distinct words of a batch are grouped by length in characters, and all words of a
length advance together: at each end position every piece length is tried at
once, the hashes of the words' substrings are looked up in the sorted array of
piece keys, and a maximum over the candidates stores score and backpointer.  A
long word is searched alone and whole, a block of start positions at a time.
A character without a piece is written as its UTF-8 bytes.  Decoding is a table
look-up, and gives back the exact text.

A merge vocabulary ranks its pieces and gives no probabilities.  Frequencies fall
about as the inverse of their rank, so the score of the piece of rank r is
-log(r), and a text's best pieces are those of the greatest product of such
frequencies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.llm.arrow import plus, steps, texts
from quillmerge.llm.rows import WordRows, spread

MARK = "▁"
#: A run of marks with the word behind it, or a word; no text is left over and no piece reaches over a border.
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words beyond this many characters are searched alone.
LONG = 64
#: Text bytes of a step.
STEP = 2 << 20
#: Start positions of a long word whose pieces are looked up at a time.
BLOCK = 1 << 14


class Pieces:
    """A piece table: surface -> (id, score), and 256 byte pieces."""

    def __init__(self, surfaces: list[str], scores: list[float], ids: list[int], byte_ids: list[int]):
        self.byte_ids = np.array(byte_ids, np.int32)
        self.surface = dict(zip(ids, surfaces, strict=True))
        self.byte_of = {b: i for i, b in enumerate(byte_ids)}
        self.longest = max(map(len, surfaces))
        if any(MARK in s.lstrip(MARK) for s in surfaces):
            raise ValueError("a piece reaches over a word border")
        keys = np.array([self._key(s) for s in surfaces], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("piece keys collide; take another multiplier")
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(ids, np.int32)[order], np.array(scores)[order]
        self.points = [surfaces[i] for i in order]
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no piece: a look here spares the search
        self.maybe[self.keys >> np.uint64(44)] = True
        # a byte run must lose against any way to write the text in pieces
        self.unknown = min(scores) * LONG * 4 - 1e6
        self.table = None

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a sentencepiece model file; control, unused and unknown entries are left out."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unused(i) or sp.is_unknown(i) or sp.is_byte(i))]
        # runs of blanks carry no score in the file: they rank last
        ranks = {i: r for r, i in enumerate(sorted(rows, key=lambda i: (-sp.get_score(i), i)))}
        bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        return cls([sp.id_to_piece(i) for i in rows], [-math.log(ranks[i] + 2) for i in rows], rows, [bytes_[b] for b in range(256)])

    MULT = 0x9E3779B97F4A7C15

    def _key(self, s: str) -> int:
        h = 0
        for c in s:
            h = ((h ^ (ord(c) + 1)) * self.MULT) & (2**64 - 1)  # a NUL counts too
            h ^= h >> 29
        return h

    def _probe(self, key: np.ndarray) -> np.ndarray:
        """Row of each key in the sorted table, -1 if absent."""
        out = np.full(key.shape, -1)
        some = self.maybe[key >> np.uint64(44)]
        want = key[some]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == want, at, -1)
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The best-scoring pieces of each word as little-endian 32-bit ids; ties take the longest last piece."""
        out = [b""] * len(words)
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_len.setdefault(len(w), []).append(i)
        for n, rows in by_len.items():
            if n > LONG:
                for r in rows:
                    out[r] = self._long(words[r])
                continue
            for i in range(0, len(rows), max(1, (1 << 16) // max(n, 1))):
                part = rows[i : i + max(1, (1 << 16) // max(n, 1))]
                for r, ids in zip(part, self._viterbi([words[r] for r in part], n), strict=True):
                    out[r] = ids
        return out

    def _viterbi(self, words: list[str], n: int) -> list[bytes]:
        """Words of n characters, all at once."""
        count = len(words)
        if not n:
            return [b""] * count
        chars = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(count, n).T.astype(np.uint64) + np.uint64(1))
        best = np.full((n + 1, count), -np.inf)
        best[0] = 0
        size, row = np.zeros((n + 1, count), np.int32), np.full((n + 1, count), -1)
        mult, at = np.uint64(self.MULT), np.arange(count)
        # rolling[s]: hash of the substring that starts at s and ends here
        rolling = np.zeros((n, count), np.uint64)
        for end in range(1, n + 1):
            low = max(0, end - self.longest)
            h = (rolling[low:end] ^ chars[end - 1]) * mult
            h ^= h >> np.uint64(29)
            rolling[low:end] = h
            hit = self._probe(h)
            total = np.where(hit >= 0, best[low:end] + self.scores[hit], -np.inf)
            total[-1] = np.where(hit[-1] < 0, best[end - 1] + self.unknown, total[-1])
            pick = total.argmax(axis=0)  # the first maximum is the longest piece
            best[end], size[end], row[end] = total[pick, at], end - low - pick, hit[pick, at]
        # all words walk back together; the slots fill from the right
        slots = np.full((n, count), -2)
        end, live, step = np.full(count, n), at, 0
        while len(live):
            step += 1
            here = end[live]
            slots[n - step, live] = row[here, live]
            end[live] = here - size[here, live]
            live = live[end[live] > 0]
        used = slots.T > -2
        rows = slots.T[used]
        flat = np.where(rows >= 0, self.ids[rows], -1).astype("<i4").tobytes()
        cut = [0, *np.cumsum(used.sum(axis=1)).tolist()]
        out = [flat[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for w in np.flatnonzero((slots == -1).any(axis=0)).tolist():
            out[w] = self._with_bytes(words[w], rows[cut[w] : cut[w + 1]])
        return out

    def _long(self, word: str) -> bytes:
        """One word of any length: a back pointer for each character, all else for a block of start positions."""
        n, mult = len(word), np.uint64(self.MULT)
        chars = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        row = np.full(n + 1, -1, np.int32)
        ahead = [0.0]  # best scores from the first position of the block on
        for low in range(0, n, BLOCK):
            high = min(n, low + BLOCK)
            part = chars[low : high + self.longest].astype(np.uint64) + np.uint64(1)
            h, starts, sizes, hits = np.zeros(high - low, np.uint64), [], [], []
            for k in range(1, min(self.longest, len(part)) + 1):
                m = min(high - low, len(part) - k + 1)
                h = (h[:m] ^ part[k - 1 : k - 1 + m]) * mult
                h ^= h >> np.uint64(29)
                found = self._probe(h)
                at = np.flatnonzero(found >= 0) if k > 1 else np.arange(m)  # a character without a piece: -1
                starts.append(at)
                sizes.append(np.full(len(at), k))
                hits.append(found[at])
            start, size, hit = (np.concatenate(x) for x in (starts, sizes, hits))
            score = np.where(hit >= 0, self.scores[hit], self.unknown)
            order = np.argsort(start, kind="stable")
            best = ahead + [-np.inf] * (high - low + self.longest + 1 - len(ahead))
            back = row[low : high + self.longest].tolist() + [-1] * (self.longest + 1)
            for a, k, r, x in zip(start[order].tolist(), size[order].tolist(), hit[order].tolist(), score[order].tolist(), strict=True):
                total = best[a] + x
                if total > best[a + k]:  # on a tie the earlier start stays, the longer piece
                    best[a + k], back[a + k] = total, r
            end = min(n + 1, high + self.longest)
            row[low:end] = back[: end - low]
            ahead = best[high - low :]
        length = np.array([*map(len, self.points), 1], np.int32)  # the last one is for -1
        picked, at = np.empty(n, np.int32), n
        for i in range(n - 1, -1, -1):
            picked[i] = row[at]
            at -= int(length[row[at]])
            if not at:
                break
        rows = picked[i:]
        return self._with_bytes(word, rows) if (rows < 0).any() else self.ids[rows].astype("<i4").tobytes()

    def _with_bytes(self, word: str, rows: np.ndarray) -> bytes:
        """A word's ids where some characters have no piece: -1 stands for one such character."""
        ids, at = [], 0
        for r in rows.tolist():
            if r >= 0:
                ids.append(int(self.ids[r]))
                at += len(self.points[r])
            else:
                ids += self.byte_ids[list(word[at].encode())].tolist()
                at += 1
        return np.array(ids, "<i4").tobytes()

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 of all texts, their lengths) of the ids of several texts: marks become blanks, a text's leading one goes."""
        if self.table is None:
            held: list[bytes] = [b""] * (max(max(self.surface), int(self.byte_ids.max())) + 1)
            for i, s in self.surface.items():
                held[i] = s.replace(MARK, " ").encode()
            for i, b in self.byte_of.items():
                held[i] = bytes([b])
            width = np.fromiter(map(len, held), np.int32, len(held))
            self.table = np.frombuffer(b"".join(held), np.uint8), np.cumsum(width) - width, width
        flat, begin, width = self.table
        n = width[ids]
        body = flat[spread(begin[ids], n)] if len(ids) else np.empty(0, np.uint8)
        ends = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[np.concatenate(([0], np.cumsum(sizes)))]
        first = ends[:-1][ends[1:] > ends[:-1]]
        lead = first[body[first] == 32]
        size = np.diff(ends)
        size[np.searchsorted(ends[:-1], lead, "right") - 1] -= 1
        return np.delete(body, lead), size

    def decode(self, ids: list[int]) -> str:
        """The text of the ids."""
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0].tobytes().decode()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, table=None)


class Encoder:
    """Encodes whole texts; remembers the words it has seen, up to a bound."""

    def __init__(self, pieces: Pieces, most_words: int = 400_000):
        self.pieces, self.known = pieces, WordRows(most_words)
        self.mark = pieces.byte_ids[list(MARK.encode())]

    def _learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.known.row]
        if new:
            coded = self.pieces.encode_words(new)
            self.known.append(new, np.fromiter(map(len, coded), np.int64, len(coded)) // 4, np.frombuffer(b"".join(coded), "<i4"))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the number of each text's ids)."""
        self.known.shrink()
        plain = pc.invert(pc.match_substring_regex(column, f"^$|^ |  |{MARK}"))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        # a text without runs of blanks: every blank is the mark that leads the word behind it
        words = pc.split_pattern(pc.if_else(plain, column, ""), " ")
        coded = words.flatten().dictionary_encode()
        distinct = [MARK + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        self._learn(distinct)
        rows = self.known.rows(distinct)[coded.indices.to_numpy()]
        total = np.concatenate(([0], np.cumsum(self.known.size[rows])))
        sizes = np.diff(total[np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))])
        ids = self.known.ids(rows)
        if len(odd):
            own = [self._odd(column[i].as_py()) for i in odd.tolist()]
            parts, at, ends = [], 0, np.cumsum(sizes)
            for i, x in zip(odd.tolist(), own, strict=True):
                parts += [ids[at : ends[i] - sizes[i]], x]
                at = ends[i]
            ids = np.concatenate([*parts, ids[at:]])
            sizes[odd] = [len(x) for x in own]
        return ids, sizes

    def _odd(self, text: str) -> np.ndarray:
        """Any text: a run of blanks leads its word; a mark of the text itself is no blank, and is written in bytes."""
        out = []
        for i, part in enumerate(text.split(MARK)):
            words = WORD.findall(("" if i else MARK) + part.replace(" ", MARK)) if text else []
            distinct = list(dict.fromkeys(words))
            self._learn(distinct)
            row = dict(zip(distinct, self.known.rows(distinct).tolist(), strict=True))
            out += ([self.mark] if i else []) + [self.known.ids(np.array([row[w] for w in words], np.int64))]
        return np.concatenate(out)


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))


def _strings(body: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body)))


def encode(docs: DataFrame, pieces: Pieces, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>): the pieces of the whole text; null and empty texts have none.

    Each row stands for itself, whatever ids repeat or are null; a column named as
    ``ids_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # one vocabulary, of fixed size
    plain = docs.drop(ids_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)  # of one task: a worker that lives on keeps no words
        for part in steps(parts, text_col, STEP):
            column = _lists(*encoder(pc.fill_null(part.column(text_col), "")))
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, ids_col])

    return plain.mapInArrow(run, plus(plain, f"`{ids_col}` array<int>"))


def decode(tokens: DataFrame, pieces: Pieces, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``text_col``: the exact text that was encoded (a null list gives an empty text)."""
    shared = tokens.sparkSession.sparkContext.broadcast(pieces)
    plain = tokens.drop(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                lists = some.column(ids_col)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                body = _strings(*shared.value.decode_all(lists.flatten().to_numpy(), sizes))
                yield pa.RecordBatch.from_arrays([*some.columns, body], names=[*some.schema.names, text_col])

    return plain.mapInArrow(run, plus(plain, f"`{text_col}` string"))


def round_trip(docs: DataFrame, pieces: Pieces, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_pieces, ids, decoded, exact) for every document: encoded, decoded and compared in one step.

    A row for each row of ``docs``, in any case of ids; a null text counts as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    plain = docs.select(id_col, text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        encoder = Encoder(own)
        for part in steps(parts, text_col, STEP):
            column = pc.fill_null(part.column(text_col), "")
            ids, sizes = encoder(column)
            decoded = _strings(*own.decode_all(ids, sizes))
            columns = [part.column(id_col), pa.array(sizes, pa.int64()), _lists(ids, sizes), decoded, pc.equal(decoded, column)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_pieces", "ids", "decoded", "exact"])

    schema = plus(plain.select(id_col), "n_pieces long, ids array<int>, decoded string, exact boolean")
    return plain.mapInArrow(run, schema)
