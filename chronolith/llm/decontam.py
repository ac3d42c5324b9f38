"""Benchmark decontamination with suffix arrays of the training texts.

Each task builds a suffix array over each shard of its own documents: all places
in stretches of words that the benchmark knows, in the order of the whole text
that follows them.  Every test suffix is then binary-searched in every shard: the
places that share its first window are one range.  From there matches run on word
by word to the longest verbatim ones, with their places in document and item.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered.  A
window is ``width`` consecutive words of an item, or all words of a shorter
item.  ``matches`` lists, for each item and each of its places where a match of a
window or more begins that can't begin earlier, the longest such match in the
document, and of equally long ones the first.

Null and empty texts have no words; a document without words is clean; an
item without words matches nothing; the words of items with a null id count as
hits, but these items are not listed; items that share an id are listed once;
rows that repeat are judged each; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronolith.llm.common import map_batches, texts_of
from chronolith.storage import written

#: Bytes that a word can hold: digits, lower-case letters, and all that is not ASCII.
_KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

RESULT = "n_words long, hit_words long, item_ids array<string>, matches array<struct<item_id:string,start:long,item_start:long,length:long>>"
#: What a block adds: the runs of hit words, from and to.
SPANS = "chronolith_spans array<struct<s:long,e:long>>"
#: Pairs of places that are extended at a time.
PAIRS = 1 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_KEEP).split()


def _sorted_by_code(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian word numbers as byte strings, which sort as the rows do."""
    return np.ascontiguousarray(rows).view(f"S{4 * rows.shape[1]}").ravel()


class Index:
    """A block of benchmark items: their word numbers in a row, parted by zeros, and distinct windows by length."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.width, self.code = width, {}
        names, codes = [], []
        for item_id, text in items:
            words = words_of(text)
            if words:
                names.append(item_id)
                codes.append([self.code.setdefault(w, len(self.code) + 1) for w in words])
        self.names = sorted(set(names), key=lambda x: (x is not None, x or ""))
        number = {name: k for k, name in enumerate(self.names)}
        self.owner = np.array([number[x] for x in names], np.int64)
        sizes = np.array([len(c) for c in codes], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes
        self.flat = np.zeros(int((sizes + 1).sum()) + 1, ">u4")
        for at, own in zip(self.starts.tolist(), codes, strict=True):
            self.flat[at : at + len(own)] = own
        lengths = np.minimum(width, sizes)
        self.windows = {}
        for n in np.unique(lengths).tolist():
            places = np.concatenate([at + np.arange(size - n + 1) for at, size in zip(self.starts[lengths == n], sizes[lengths == n], strict=True)])
            keys, which = np.unique(_sorted_by_code(self.flat[places[:, None] + np.arange(n)]), return_inverse=True)
            order = np.argsort(which, kind="stable")
            self.windows[n] = keys, np.searchsorted(which[order], np.arange(len(keys) + 1)), places[order]


def suffix_array(codes: np.ndarray, longest: int) -> np.ndarray:
    """All places of ``codes`` in the order of what follows them, up to ``longest`` numbers, by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < longest:
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - reach] = rank[reach:] + 1
        found, rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)
        reach *= 2
        if len(found) == len(rank):
            break
    return np.argsort(rank, kind="stable")


class Shard:
    """The known stretches of some documents: word numbers parted by zeros, their places, and their suffix array."""

    def __init__(self, index: Index, docs: list[list[bytes]]):
        sizes = np.array([len(d) for d in docs], np.int64)
        total, self.ends = int(sizes.sum()), np.cumsum(sizes)
        get, shortest = index.code.get, min(index.windows)
        codes = np.fromiter((get(w, 0) for d in docs for w in d), np.int64, total)
        known = codes > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        heads = self.ends[:-1][self.ends[:-1] < total]
        begins[heads] = known[heads]
        stretch = np.cumsum(begins) - 1
        long = np.bincount(stretch[known], minlength=1) >= shortest
        keep = np.flatnonzero(known & long[np.maximum(stretch, 0)])
        self.n = len(keep)
        if not self.n:
            return
        # a zero before each stretch and at the end
        place = np.arange(len(keep)) + np.unique(stretch[keep], return_inverse=True)[1] + 1
        self.codes = np.zeros(int(place[-1]) + 2, ">u4")
        self.codes[place] = codes[keep]
        self.place = np.full(len(self.codes), -1, np.int64)
        self.place[place] = keep
        gaps = np.flatnonzero(self.codes == 0)
        self.room = gaps[np.searchsorted(gaps, np.arange(len(self.codes)))] - np.arange(len(self.codes))
        order = suffix_array(self.codes, int(self.room.max()) + 1)
        self.suffixes = order[self.room[order] >= shortest]

    def ranges(self, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes of ``n`` words or more in order, and each key's range of them."""
        own = self.suffixes[self.room[self.suffixes] >= n]
        if not len(own):
            return own, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        ranked = _sorted_by_code(self.codes[own[:, None] + np.arange(n)])
        return own, np.searchsorted(ranked, keys, "left"), np.searchsorted(ranked, keys, "right")


def longest_from(shard: Shard, index: Index, here: np.ndarray, there: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of places that share ``n`` words: those that share none before, with their whole common length."""
    before = shard.codes[here - 1]
    first = (before == 0) | (before != index.flat[there - 1])
    here, there = here[first], there[first]
    length = np.full(len(here), n, np.int64)
    live = np.arange(len(here))
    while len(live):
        one, two = shard.codes[here[live] + length[live]], index.flat[there[live] + length[live]]
        live = live[(one == two) & (one != 0)]
        length[live] += 1
    return here, there, length


def pairs_of(low: np.ndarray, high: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(number in the suffix order, number in the windows' places)`` of all pairs of a hit, ``PAIRS`` or so at a time."""
    hit = np.flatnonzero(high > low)
    for k in hit.tolist():
        many = int(begins[k + 1] - begins[k])
        step = max(1, PAIRS // many)
        for at in range(int(low[k]), int(high[k]), step):
            own = np.arange(at, min(at + step, int(high[k])))
            yield np.repeat(own, many), np.tile(np.arange(begins[k], begins[k + 1]), len(own))


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small parts joined to some of about ``PAIRS`` rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= PAIRS:
            yield np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
            held, size = [], 0
    if held:
        yield np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])


def judge_shard(index: Index, texts: list[str]) -> dict[str, list]:
    """The columns of RESULT and SPANS for the documents of one shard; matches of items without an id are among them."""
    docs = [words_of(t) for t in texts]
    sizes = [len(d) for d in docs]
    out: dict[str, list] = {"n_words": sizes, "hit_words": [0] * len(sizes), "item_ids": [[] for _ in sizes], "matches": [[] for _ in sizes], "chronolith_spans": [[] for _ in sizes]}
    if not index.windows or not sum(sizes):
        return out
    shard = Shard(index, docs)
    if not shard.n:
        return out
    edge = np.zeros(int(shard.ends[-1]) + 1, np.int64)
    found = []
    for n, (keys, begins, places) in index.windows.items():
        own, low, high = shard.ranges(keys, n)
        if not len(own):
            continue
        # how many windows cover each suffix: ranges of one length do not overlap
        marks = np.zeros(len(own) + 1, np.int64)
        np.add.at(marks, low, high > low)
        np.add.at(marks, high, -(high > low).astype(np.int64))
        at = shard.place[own[np.cumsum(marks[:-1]) > 0]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        for a, b in gathered(pairs_of(low, high, begins)):
            here, there, length = longest_from(shard, index, own[a], places[b], n)
            item = np.searchsorted(index.starts, there, "right") - 1
            found.append(np.stack([np.searchsorted(shard.ends, shard.place[here], "right"), index.owner[item], there - index.starts[item], -length, shard.place[here]], 1))
    hit = np.cumsum(edge[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(hit)])
    starts = shard.ends - np.array(sizes, np.int64)
    out["hit_words"] = (sums[shard.ends] - sums[starts]).tolist()
    turns = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for s, e in zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True):
        # a run of hits may go over the end of a document
        for doc in range(int(np.searchsorted(shard.ends, s, "right")), int(np.searchsorted(shard.ends, e, "left")) + 1):
            a, b = max(s, int(starts[doc])), min(e, int(shard.ends[doc]))
            if a < b:
                out["chronolith_spans"][doc].append({"s": a - int(starts[doc]), "e": b - int(starts[doc])})
    if found:
        rows = np.concatenate(found)
        rows = rows[np.lexsort(rows.T[::-1])]
        best = np.ones(len(rows), bool)
        best[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
        for doc, item, item_start, length, place in rows[best].tolist():
            name = index.names[item]
            if name is not None and name not in out["item_ids"][doc][-1:]:
                out["item_ids"][doc].append(name)
            out["matches"][doc].append({"item_id": name, "start": place - int(starts[doc]), "item_start": item_start, "length": -length})
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """``docs`` with word count, hit words, matching items and longest verbatim matches; no shuffle.

    The benchmark goes to the tasks in blocks of about ``block_words`` words, each
    small enough to send; more blocks mean more passes, joined by row number.
    Columns of ``docs`` that are named like a result are replaced.
    """
    n_words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    total = benchmark.agg(F.sum(n_words)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    docs = docs.drop("n_words", "hit_words", "item_ids", "matches")
    listed = F.filter("matches", lambda m: m["item_id"].isNotNull())
    if blocks == 1:
        return _one_block(docs, benchmark, width).drop("chronolith_spans").withColumn("matches", listed)
    base = written(docs.withColumn("chronolith_row", F.monotonically_increasing_id()), "numbered")
    found = None
    for k in range(blocks):
        part = benchmark.where(F.pmod(F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id")), F.lit(blocks)) == k)
        one = _one_block(base.select("chronolith_row", "text"), part, width).drop("text")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("chronolith_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"), F.array_sort(F.flatten(F.collect_list("chronolith_spans"))).alias("spans"))
    none = F.lit(0).cast("long")
    covered = F.aggregate("spans", F.struct(none.alias("n"), none.alias("to")), lambda a, m: F.struct((a["n"] + F.greatest(none, m["e"] - F.greatest(a["to"], m["s"]))).alias("n"), F.greatest(a["to"], m["e"]).alias("to")))["n"]
    return base.join(merged.withColumn("hit_words", covered), "chronolith_row").select(*docs.columns, "n_words", "hit_words", "item_ids", listed.alias("matches"))


def _one_block(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    items = [(None if r[0] is None else str(r[0]), r[1] or "") for r in benchmark.select("item_id", "text").collect()]
    sent = docs.sparkSession.sparkContext.broadcast(Index(items, width))

    own = docs.columns

    def judge(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {c: batch.column(c) for c in own} | judge_shard(sent.value, texts_of(batch))

    return map_batches(docs, judge, StructType([*docs.schema.fields, *docs.sparkSession.createDataFrame([], RESULT + ", " + SPANS).schema.fields]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with their columns."""
    names = ["text" if c == "text" else f"chronolith_{k}" for k, c in enumerate(docs.columns)]
    judged = find_matches(docs.toDF(*names), benchmark, width)
    return judged.where("hit_words = 0").select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)])
