"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap checks.

The test items form a small inverted index: for each term a posting list in order of
the items, and for each term and block of items the highest impact there.  Every
passage of every training document is a query, answered by block-max WAND over item
ordered cursors, many passages side by side:

1. the cursors of a passage's terms are ordered by their items; the pivot is the first
   item at which the terms' maxima reach the least threshold ahead,
2. the block maxima of the terms up to the pivot are summed; under the block's least
   threshold these cursors leave the block, or go to the next term's item if that is
   nearer, and no posting between is read,
3. else cursors behind the pivot seek it; once all are there the item is scored.

An item's threshold is the least score a passage can have that still passes the
overlap check, so the retrieval loses nothing; the check itself asks for the
item's word shingles in the passage, or for those of its question and of its
answer where the benchmark has answers.

Passages follow an item's own length: with items of over 2**(c-1) and up to 2**c words
go passages of 2**(c+1) words, one at every 2**c.  Other items change nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmerge.llm.arrow import plus, steps, texts
from quillmerge.llm.numbered import clashing, numbered_rows
from quillmerge.sources.scratch import materialise

#: A-Z become a-z, other ASCII that is neither letter nor digit separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
#: Items of one index shard, and bytes of their words; a shard is what a task holds.
SHARD_ITEMS, SHARD_BYTES = 4096, 8 << 20
#: Cursors that move side by side.
CURSORS = 1 << 18
#: BM25's usual constants.
K1, B = 1.2, 0.75


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case, also beyond ASCII."""
    return (text if text.isascii() else text.decode().lower().encode()).translate(FOLD).split()


def shingles(words: list, width: int) -> list[tuple]:
    """Every run of ``width`` words; a shorter text is one shingle, no words none."""
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


@dataclass
class Item:
    item_id: object
    words: list[bytes]
    question: set[tuple]
    answer: set[tuple]


def as_item(item_id: object, text: bytes, answer: bytes | None, width: int) -> Item:
    """Without an answer of its own, an item is one question, and its empty answer is always held."""
    words = words_of(text)
    if answer is not None:
        tail = words_of(answer)
        return Item(item_id, words + tail, set(shingles(words, width)), set(shingles(tail, width)))
    return Item(item_id, words, set(shingles(words, width)), set())


class Shelf:
    """The items of one class of lengths: posting lists in order of the items, and block maxima."""

    def __init__(self, items: list[tuple[int, Item]], term: dict[bytes, int], impacts: list[dict[bytes, float]], thresholds: np.ndarray, block: int):
        self.size = 1 << max(0, (len(items[0][1].words) - 1).bit_length())  #: words of its longest item at most
        self.items, self.block, self.threshold = items, block, thresholds
        rows = sorted((term[w], j, v) for j, own in enumerate(impacts) for w, v in own.items())
        t, j, v = (np.array(x) for x in zip(*rows, strict=True))
        self.n, self.post_item, self.post_impact = len(items), j, v
        self.begin = np.searchsorted(t, np.arange(len(term) + 1))
        self.key = t * (self.n + 1) + j  # seeks go by (term, item)
        self.term_max = np.zeros(len(term))
        np.maximum.at(self.term_max, t, v)
        self.n_blocks = -(-self.n // block)
        cell = t * self.n_blocks + j // block
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell, self.cell_max = cell[first], np.maximum.reduceat(v, first)
        self.block_least = np.minimum.reduceat(thresholds, np.arange(0, self.n, block))
        self.ahead = np.append(np.minimum.accumulate(thresholds[::-1])[::-1], np.inf)  #: least threshold from each item on
        self.pivots = self.skips = self.scored = 0

    def search(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, float]]:
        """(window, item, score) of all windows ids[first : last] that reach an item's threshold."""
        known = np.flatnonzero((ids >= 0) & (self.term_max[ids] > 0))
        lo, hi = np.searchsorted(known, first), np.searchsorted(known, last)
        weight = np.concatenate(([0.0], np.cumsum(self.term_max[ids[known]])))
        alive = np.flatnonzero((weight[hi] - weight[lo] >= self.ahead[0] - 1e-6) & (hi > lo))
        out: list[tuple[int, int, float]] = []
        some = max(1, CURSORS // (2 * self.size))
        for i in range(0, len(alive), some):
            part = alive[i : i + some]
            win, at = _spread(lo[part], hi[part])
            pair = np.unique(win * len(self.term_max) + ids[known[at]])  # distinct terms of each window
            win, term = pair // len(self.term_max), pair % len(self.term_max)
            enough = np.bincount(win, self.term_max[term], len(part)) >= self.ahead[0] - 1e-6
            keep = enough[win]
            rows = np.flatnonzero(enough)
            if len(rows):
                held = np.searchsorted(rows, win[keep])
                out += [(int(part[rows[w]]), j, score) for w, j, score in self._walk(held, term[keep], len(rows))]
        return out

    def _walk(self, win: np.ndarray, term: np.ndarray, n: int) -> list[tuple[int, int, float]]:
        """Block-max WAND for n windows with these terms each."""
        count = np.bincount(win, minlength=n)
        slot = np.arange(len(win)) - np.repeat(np.cumsum(count) - count, count)
        terms = np.full((n, count.max()), -1)
        terms[win, slot] = term
        best = np.where(terms >= 0, self.term_max[terms], 0.0)
        at = np.where(terms >= 0, self.begin[terms], len(self.post_item))
        end = np.where(terms >= 0, self.begin[terms + 1], len(self.post_item))
        item, own = np.append(self.post_item, self.n), np.arange(n)
        now = np.where(at < end, item[at], self.n)
        out: list[tuple[int, int, float]] = []
        while len(own):
            order = np.argsort(now, axis=1, kind="stable")
            there = np.take_along_axis(now, order, axis=1)
            upto = np.cumsum(np.where(there < self.n, np.take_along_axis(best, order, axis=1), 0.0), axis=1)
            reach = upto >= self.ahead[there[:, 0]][:, None] - 1e-6
            going = reach[:, -1]
            if not going.all():  # the terms left can't reach any item ahead
                own, terms, best, at, end, now, there, reach = (x[going] for x in (own, terms, best, at, end, now, there, reach))
                if not len(own):
                    break
            pivot = np.take_along_axis(there, reach.argmax(axis=1)[:, None], axis=1)[:, 0]
            self.pivots += len(pivot)
            block = pivot // self.block
            short = now <= pivot[:, None]  # the cursors up to the pivot
            seek = np.where(short, terms * self.n_blocks + block[:, None], -1)
            cell = np.minimum(np.searchsorted(self.cell, seek), len(self.cell) - 1)
            bound = np.where(self.cell[cell] == seek, self.cell_max[cell], 0.0).sum(axis=1)
            shut = bound < self.block_least[block] - 1e-6
            self.skips += int(shut.sum())
            beyond = np.where(short, self.n, now).min(axis=1)
            target = np.where(shut, np.minimum((block + 1) * self.block, beyond), pivot)
            full = ~shut & (there[:, 0] == pivot)
            if full.any():
                here = now[full] == pivot[full][:, None]
                score = np.where(here, np.append(self.post_impact, 0.0)[at[full]], 0.0).sum(axis=1)
                self.scored += int(full.sum())
                hit = score >= self.threshold[pivot[full]]
                out += zip(own[full][hit].tolist(), pivot[full][hit].tolist(), score[hit].tolist(), strict=True)
                target[full] += 1
            move = now < target[:, None]
            where = np.searchsorted(self.key, terms[move] * (self.n + 1) + np.broadcast_to(target[:, None], now.shape)[move])
            at[move] = np.minimum(where, end[move])
            now[move] = np.where(at[move] < end[move], item[at[move]], self.n)
        return out


class Index:
    """Inverted index of one shard of items: a shelf for each class of lengths."""

    def __init__(self, items: list[Item], df: dict[bytes, int], n_items: int, mean_len: float, overlap: float, block: int = 4):
        self.items = items = sorted(items, key=lambda x: (len(x.words), x.words))  # alike lengths share a block
        self.overlap = overlap
        self.term = {w: i for i, w in enumerate(sorted({w for x in items for w in x.words}))}
        self.threshold, impacts = np.empty(len(items)), []
        for j, x in enumerate(items):
            tf, norm = Counter(x.words), K1 * (1 - B + B * len(x.words) / mean_len)
            impact = {w: float(np.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm)) for w, f in tf.items()}
            impacts.append(impact)
            # words that may be missing when all parts still overlap enough: at most one for each missing shingle
            spare = sum(int((1 - overlap) * len(part) + 1e-9) for part in (x.question, x.answer))
            self.threshold[j] = max(0.0, sum(impact.values()) - sum(sorted(impact.values())[len(impact) - min(spare, len(impact)) :])) * (1 - 1e-6)
        classes = np.array([(len(x.words) - 1).bit_length() for x in items])
        self.shelves = []
        for c in np.unique(classes).tolist():
            at = np.flatnonzero(classes == c)
            self.shelves.append(Shelf([(j, items[j]) for j in at.tolist()], self.term, [impacts[j] for j in at.tolist()], self.threshold[at], block))

    def leaks(self, split: list[list[bytes]], width: int) -> list[dict[int, tuple[float, float, float]]]:
        """For each text: item position -> (score, question overlap, answer overlap) of its best passage."""
        get = self.term.get
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        begin = np.cumsum(sizes) - sizes
        ids = np.fromiter((get(w, -1) for ws in split for w in ws), np.int64, int(sizes.sum()))
        best: list[dict[int, tuple[float, float, float]]] = [{} for _ in split]
        for shelf in self.shelves:
            hop = shelf.size
            hops = np.maximum(1, -(-(sizes - hop) // hop)) * (sizes > 0)
            owner, step = _spread(np.zeros(len(split), np.int64), hops)
            first = begin[owner] + step * hop
            last = np.minimum(first + 2 * hop, begin[owner] + sizes[owner])
            for w, k, score in shelf.search(ids, first, last):
                (j, item), mine, doc = shelf.items[k], best[owner[w]], owner[w]
                passage = split[doc][first[w] - begin[doc] : last[w] - begin[doc]]
                # a part with under ``width`` words is one run of its own length
                held = {n: set(shingles(passage, n)) for n in {len(s) for part in (item.question, item.answer) for s in part}}
                q, a = (sum(s in held[len(s)] for s in part) / len(part) if part else 1.0 for part in (item.question, item.answer))
                if min(q, a) >= self.overlap and (j not in mine or (q + a, score) > (sum(mine[j][1:]), mine[j][0])):
                    mine[j] = (score, q, a)
        return best


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) for every position of the ranges [begin, end)."""
    n = end - begin
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin, n)


def _items(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None, width: int) -> DataFrame:
    """(item_id, terms of the item, text, answer, shard)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [as_item(0, t, (a or b"") if answer_col else None, width).words for t, a in zip(texts(part, "text"), texts(part, "answer"), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.binary()))], names=[*part.schema.names, "words"])

    plain = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer")).distinct()
    return plain.mapInArrow(run, plus(plain, "words array<binary>"))


def _shards(items: DataFrame) -> list[int]:
    """How many index shards keep each within bounds, by counted items and bytes."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0))), F.lit(0))).first()
    return list(range(max(1, -(-2 * n // SHARD_ITEMS) if n > SHARD_ITEMS else 1, -(-2 * size // SHARD_BYTES) if size > SHARD_BYTES else 1)))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
    width: int = 5,
    overlap: float = 0.8,
) -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap): each leaked item of each document.

    A passage is 2 L words at every L-th word, L the item's length rounded up to a power
    of two, so every run of an item's length lies in one, whatever other items there
    are.  An item leaks where a passage holds at least ``overlap`` of its word
    ``width``-grams; with ``answer_col``, of the question's and of the answer's.  Without
    it question_overlap is that of the whole item, and answer_overlap is 1.
    Repeated items count once; items without words and rows with a null text leak
    nothing; an empty benchmark gives an empty result.  Document ids that repeat
    are judged row by row; a document without words leaks nothing, and other columns
    play no part.  Items are read in shards of bounded size (one pass over
    the documents each); BM25 statistics are those of the whole benchmark.
    """
    typed = benchmark.select(F.col(item_col).alias("item_id")).schema["item_id"].dataType
    shape = docs.select(id_col, F.lit(None).cast(typed).alias("item_id"), F.lit(0.0).alias("score"), F.lit(0.0).alias("question_overlap"), F.lit(0.0).alias("answer_overlap")).schema
    item_type, names = to_arrow_type(typed), shape.names
    plain, found = docs.select(id_col, text_col), None
    for index, alone in _indices(benchmark, item_col, item_text_col, answer_col, width, overlap):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for part in steps(batches, text_col, 1 << 20):
                doc = part.column(id_col).to_pylist()
                rows = [(doc[k], own.items[j].item_id, *v) for k, found in enumerate(_leaks_of(own, part, text_col, width)) for j, v in found.items()]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = [part.schema.field(id_col).type, item_type, pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        out = plain.mapInArrow(run, shape)
        if not alone:  # one index at a time
            out = materialise(out, "leaks")
            index.destroy()
        found = out if found is None else found.unionByName(out)
    return docs.sparkSession.createDataFrame([], shape) if found is None else found


def _leaks_of(index: Index, part: pa.RecordBatch, text_col: str, width: int) -> list[dict]:
    return index.leaks([words_of(t) for t in texts(part, text_col)], width)


def _indices(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None, width: int, overlap: float):
    """(broadcast index, whether it is the only one) of each shard of the items; none for an empty benchmark."""
    spark = benchmark.sparkSession
    items = materialise(_items(benchmark, item_col, text_col, answer_col, width).where(F.size("words") > 0), "items")
    n_items, mean_len = items.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not n_items:
        return
    df = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    shards = _shards(items)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(len(shards))))
    for shard in shards:
        mine = dealt.where(F.col("shard") == shard)
        rows = mine.select("item_id", "text", "answer").collect()  # bounded by the shard's size
        if not rows:
            continue
        counts = {bytes(r["word"]): r["df"] for r in mine.select(F.explode(F.array_distinct("words")).alias("word")).distinct().join(df, "word").collect()}
        parts = [as_item(r["item_id"], r["text"].encode(), (r["answer"] or "").encode() if answer_col else None, width) for r in rows]
        yield spark.sparkContext.broadcast(Index(parts, counts, n_items, mean_len, overlap)), len(shards) == 1


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, width: int = 5, overlap: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold a leaked item, all columns kept.

    Each row is judged by its own text and dropped in the pass that reads it, whatever
    ids repeat or are null; a null or empty text stays, and so does every row if the
    benchmark is empty.  An empty table stays empty.  With more than one shard of items
    rows are numbered and the leaking numbers removed.
    """
    how = {"item_col": item_col, "item_text_col": item_text_col, "answer_col": answer_col, "width": width, "overlap": overlap}
    for index, alone in _indices(benchmark, item_col, item_text_col, answer_col, width, overlap):
        if not alone:
            index.destroy()
            own = clashing(docs)
            rows = numbered_rows(docs.withColumnsRenamed(own), text_col)
            bad = materialise(find_leaks(rows, benchmark, id_col="row", text_col=text_col, **how).select("row").distinct(), "leaks")
            return rows.join(bad, "row", "left_anti").drop("row").withColumnsRenamed({new: old for old, new in own.items()})

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for part in steps(batches, text_col, 1 << 20):
                clean = [not found for found in _leaks_of(own, part, text_col, width)]
                yield part if all(clean) else part.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    return docs
