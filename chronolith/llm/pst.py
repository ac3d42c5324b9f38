"""Language-model scores from a probabilistic suffix tree.

A text is its words (A-Z lowered, parted by white space) joined by one blank,
and an end: exactly its token sequence, spelt out.  The tree's symbols are the
bytes of that spelling; its contexts are byte strings of up to ``depth``, so
words never seen still get a probability from their letters.

Learning (Ron, Singer and Tishby, "The Power of Amnesia", 1996): all strings of
``depth + 1`` bytes are counted, with a combine in every task and one shuffle.  A
context is kept if it occurs ``least`` times in training rows and its next-symbol
distribution diverges from that of its longest kept suffix by ``divergence`` nats
in all, weighted by its count; symbols seen fewer than ``least`` times after it go
to the shorter context.  Both bounds are counts, so the tree grows with the corpus.

The tree is never in one place.  Contexts that end in the same two bytes form a
subtree, and a task builds whole subtrees from their counted strings; above them
are the contexts of no byte and one, 65,536 counts at most, which all tasks get.
The task then gives each string of the corpus its log10 probability.  A subtree's
rows are distinct strings, so a line that fills the corpus makes none of them hot.

Each kept context's distribution is smoothed with its suffix's (Witten-Bell), so
it sums to 1; a text's score adds, symbol by symbol, the log10 probability at
the longest kept suffix of what came before.  The ``common_strings`` most frequent
strings go to the tasks with their scores; texts meet all others in a join, where
no key is frequent by that choice.

``base_score`` is the unigram baseline over words.  Counts of at most ``common``
of the most frequent words, of at most 64 bytes each, go to the tasks; all others
meet their counts in a join.  Null texts are empty: they have the end alone.  Rows that
repeat are learnt from and scored each; an empty table gives no rows; without
training rows every byte is equally likely.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import look_up, map_batches, texts_of
from chronolith.storage import shuffle_partitions, written

END = b"\n"
SHORT = 64


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def grams(spelt: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, lengths)``: for each symbol of each spelling, the ``depth`` bytes before it, the latest
    highest, and the symbol lowest, in one number; before a text stand ends."""
    buffer = np.frombuffer(b"".join(END * depth + s + END for s in spelt), np.uint8)
    lengths = np.array([len(s) + 1 for s in spelt], np.int64)
    n = len(buffer) - depth
    key = np.zeros(max(n, 0), np.uint64)
    for place in (*range(depth - 1, -1, -1), depth):
        key <<= np.uint64(8)
        key |= buffer[place : place + n]
    # the places that spell the next text's padding are no symbols
    symbols = np.ones(len(key), bool)
    ends = np.cumsum(lengths + depth)[:-1]
    for back in range(1, depth + 1):
        symbols[ends - back] = False
    return key[symbols], lengths


@dataclass
class Tree:
    """Per depth: sorted kept contexts, their escape shares, sorted (context, symbol) keys and probabilities."""

    depth: int
    root: np.ndarray
    contexts: list[np.ndarray]
    escape: list[np.ndarray]
    entries: list[np.ndarray]
    shares: list[np.ndarray]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The log10 probability of each key's symbol at its longest kept suffix."""
        p = self.root[(keys & np.uint64(255)).astype(np.int64)]
        alive = np.arange(len(keys))
        for k in range(1, len(self.contexts) + 1):
            shift = np.uint64(8 * (self.depth - k))
            context = (keys[alive] >> np.uint64(8)) >> shift
            kept = self.contexts[k - 1]
            if not len(kept):
                break
            at = np.minimum(np.searchsorted(kept, context), len(kept) - 1)
            found = kept[at] == context
            alive, at, context = alive[found], at[found], context[found]
            if not len(alive):
                break
            entry = (context << np.uint64(8)) | (keys[alive] & np.uint64(255))
            own, share = self.entries[k - 1], np.zeros(len(alive))
            if len(own):
                e = np.minimum(np.searchsorted(own, entry), len(own) - 1)
                share = np.where(own[e] == entry, self.shares[k - 1][e], 0.0)
            p[alive] = share + self.escape[k - 1][at] * p[alive]
        return np.log10(p)


def listed(gram: np.ndarray, n: np.ndarray, pairs: np.ndarray, depth: int, least: int) -> list[np.ndarray]:
    """``level << 56 | context << 8 | symbol`` of all symbols seen ``least`` times or more, with their counts
    and their contexts' totals and kinds: levels 0 and 1 from ``pairs`` (by last byte and symbol), the others from whole subtrees."""
    found = []
    for k in range(depth + 1):
        if k < 2:
            table = pairs if k else pairs.sum(0, keepdims=True)
            key = np.flatnonzero(table).astype(np.uint64)
            counts = table.ravel()[key.astype(np.int64)]
        else:
            key, place = np.unique((gram >> np.uint64(8 * (depth - k + 1)) << np.uint64(8)) | (gram & np.uint64(255)), return_inverse=True)
            counts = np.bincount(place, n, len(key)).astype(np.int64)
        _, context = np.unique(key >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(context, counts)[context].astype(np.int64), np.bincount(context)[context]
        often = counts >= least
        found.append((np.uint64(k << 56) | key[often], counts[often], total[often], kinds[often]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def build(key: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray, depth: int, divergence: float) -> Tree:
    """The tree from what ``listed`` gives.

    Symbols that are not listed are one rest when a context is compared with its
    suffix, so the divergence is never overstated.
    """
    order = np.argsort(key)
    all_keys, all_n, all_total, all_kinds = (x[order] for x in (key, n, total, kinds))
    edges = np.searchsorted(all_keys, np.arange(depth + 2, dtype=np.uint64) << np.uint64(56))
    root = np.full(256, 0.5)
    root[(all_keys[: edges[1]] & np.uint64(255)).astype(np.int64)] += all_n[: edges[1]]
    tree = Tree(depth, root / root.sum(), [], [], [], [])
    for k in range(1, depth + 1):
        own = slice(edges[k], edges[k + 1])
        key, n = all_keys[own] & np.uint64((1 << 56) - 1), all_n[own].astype(np.float64)
        names, first, place = np.unique(key >> np.uint64(8), return_index=True, return_inverse=True)
        total, kinds = all_total[own][first].astype(np.float64), all_kinds[own][first].astype(np.float64)
        # a context hangs below its suffix: without that it can't be reached
        fits = np.isin(names >> np.uint64(8), tree.contexts[-1]) if k > 1 else np.ones(len(names), bool)
        wide = ((key >> np.uint64(16)) << np.uint64(8 * (depth - k + 1) + 8)) | (key & np.uint64(255))
        before = 10 ** tree.log10(wide)
        listed, expected = np.bincount(place, n, len(names)), np.bincount(place, before, len(names))
        gain = np.bincount(place, n * np.log(n / total[place] / before), len(names)).astype(np.float64)
        rest = total - listed
        some = rest > 0
        gain[some] += rest[some] * np.log(rest[some] / total[some] / np.maximum(1 - expected[some], 1e-12))
        fits &= gain >= divergence
        room = total + kinds
        tree.contexts.append(names[fits])
        tree.escape.append(((rest + kinds) / room)[fits])
        tree.entries.append(key[fits[place]])
        tree.shares.append((n / room[place])[fits[place]])
    return tree


def count_words(docs: DataFrame, trains: Column) -> DataFrame:
    """``(word, n)`` of the training rows; ends count as the word LF."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        words = Counter()
        for t in texts_of(batch):
            words.update(words_of(t))
        words[END] += batch.num_rows
        yield {"word": list(words), "n": list(words.values())}

    return map_batches(docs.where(trains).select("text"), run, "word binary, n long", slice_bytes=8 << 20).groupBy("word").agg(F.sum("n").alias("n"))


def count_strings(docs: DataFrame, trains: Column, depth: int) -> DataFrame:
    """``(gram, n, seen)`` of all rows: ``n`` counts training rows, ``seen`` all."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for trained, part in ((True, batch.filter(batch.column("trains"))), (False, batch.filter(pc.invert(batch.column("trains"))))):
            if part.num_rows:
                keys, n = np.unique(grams([b" ".join(words_of(t)) for t in texts_of(part)], depth)[0], return_counts=True)
                yield {"gram": keys.view(np.int64), "n": n * trained, "seen": n}

    marked = docs.select("text", F.coalesce(trains, F.lit(False)).alias("trains"))
    return map_batches(marked, run, "gram long, n long, seen long", slice_bytes=8 << 20).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def whole_subtrees(batches: Iterator[pa.RecordBatch], depth: int, rows: int = 1 << 19) -> Iterator[pa.Table]:
    """A sorted partition in pieces of about ``rows`` rows that end where the last two bytes change."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        owner = batch.column("gram").to_numpy() >> (8 * (depth - 1))
        # the last subtree of the batch may go on; those before it are whole
        end = int(np.searchsorted(owner, owner[-1]))
        if size + end >= rows and (end or owner[0] != last):
            if size + end:
                yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held, size, batch = [], 0, batch.slice(end)
        held.append(batch)
        size, last = size + batch.num_rows, owner[-1]
    if held:
        yield pa.Table.from_batches(held)


def string_scores(counted: DataFrame, depth: int, least: int, divergence: float) -> DataFrame:
    """``(gram, seen, log10)`` of each counted string: subtrees are dealt to tasks by their last two bytes."""
    if not 2 <= depth <= 6:
        raise ValueError("depth is from 2 to 6 bytes")
    ends = counted.groupBy(F.shiftrightunsigned("gram", 8 * depth).alias("last"), F.col("gram").bitwiseAND(255).alias("symbol"))
    rows = ends.agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((256, 256), np.int64)
    pairs[rows.column("last").to_numpy(), rows.column("symbol").to_numpy()] = rows.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_subtrees(batches, depth):
            gram, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
            tree = build(*listed(gram[n > 0], n[n > 0], pairs, depth, least), depth, divergence)
            out = pa.table({"gram": table.column("gram"), "seen": table.column("seen"), "log10": tree.log10(gram)})
            yield from out.to_batches(max_chunksize=1 << 16)

    dealt = counted.repartition(shuffle_partitions(counted.sparkSession), F.shiftrightunsigned("gram", 8 * (depth - 1)))
    return dealt.sortWithinPartitions("gram").mapInArrow(run, "gram long, seen long, log10 double")


def step_of(n: str) -> Column:
    """The place of a count on a scale of 256 steps to each power of two."""
    return F.floor(F.log2(F.col(n).cast("double")) * 256).cast("int")


def frequent_from(table: DataFrame, n: str, most: int) -> int:
    """The step of ``n`` from which on at most ``most`` rows of ``table`` lie, read from a histogram of steps,
    so that no task and no table sends more than is kept."""
    total, cut = 0, 1 << 30
    for row in table.groupBy(step_of(n).alias("step")).count().orderBy(F.desc("step")).collect():
        total += row["count"]
        if total > most:
            break
        cut = row["step"]
    return cut


def known_sums(keys: np.ndarray, lengths: np.ndarray, strings: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's sum of the ``values`` of its keys that are among the sorted ``strings``; text and key of the others, by text.

    Keys have 56 bits.  The eight left name one of 256 texts, so that plain numbers
    are sorted, which is far faster than to sort places; sorted keys meet the strings in order.
    """
    total, texts, others = np.zeros(len(lengths)), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    edges = np.concatenate(([0], np.cumsum(lengths)))
    for first in range(0, len(lengths), 256):
        own = lengths[first : first + 256]
        some = keys[edges[first] : edges[first + len(own)]] << np.uint64(8)
        some |= np.repeat(np.arange(len(own), dtype=np.uint64), own)
        some.sort()
        key, text = some >> np.uint64(8), (some & np.uint64(255)).astype(np.int64)
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        distinct = key[new]
        value, missed = np.zeros(len(distinct)), np.ones(len(distinct), bool)
        if len(strings):
            at = np.minimum(np.searchsorted(strings, distinct), len(strings) - 1)
            missed = strings[at] != distinct
            value = np.where(missed, 0.0, values[at])
        place = np.cumsum(new) - 1
        total[first : first + len(own)] = np.bincount(text, value[place], len(own))
        left = np.flatnonzero(missed[place])
        order = np.argsort(text[left], kind="stable")
        texts.append(first + text[left][order])
        others.append(key[left][order])
    return total, np.concatenate(texts), np.concatenate(others)


def score(docs: DataFrame, trains: Column, depth: int = 6, least: int = 2, divergence: float = 5.0, common: int = 1 << 17, common_strings: int = 1 << 21) -> DataFrame:
    """``docs`` (doc_id, text) as ``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``; ``trains`` marks rows to learn from."""
    spark = docs.sparkSession
    words = written(count_words(docs, trains), "words")
    size = words.agg(F.count(F.lit(1)), F.sum("n")).first()
    kinds, train_tokens = int(size[0] or 0), int(size[1] or 0)
    strings = written(string_scores(written(count_strings(docs, trains, depth), "counts"), depth, least, divergence), "strings")
    cut = frequent_from(strings, "seen", common_strings)
    often = strings.where(step_of("seen") >= cut).select("gram", "log10").toArrow()
    order = np.argsort(often.column("gram").to_numpy())
    known_strings = often.column("gram").to_numpy()[order].view(np.uint64), often.column("log10").to_numpy()[order]
    short = words.where(F.octet_length("word") <= SHORT)
    top = short.where(step_of("n") >= frequent_from(short, "n", common)).toArrow()
    known_words = dict(zip(top.column("word").to_pylist(), np.log10(top.column("n").to_numpy() + 0.5).tolist(), strict=True))
    sent = spark.sparkContext.broadcast((known_strings, known_words))
    bottom = float(np.log10(train_tokens + 0.5 * (kinds + 1)))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        (strings, values), known = sent.value
        texts = [words_of(t) for t in texts_of(batch)]
        keys, lengths = grams([b" ".join(t) for t in texts], depth)
        total, rare_text, rare_key = known_sums(keys, lengths, strings, values)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(rare_text, minlength=len(texts))))).astype(np.int32)
        seldom = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare_key.view(np.int64)))
        out = {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_tokens": [len(t) + 1 for t in texts], "sure": [], "sure_sum": [], "rare": [], "strings": seldom, "sure_score": total}
        get = known.get
        for t in texts:
            found = [get(w) for w in t] + [get(END)]
            rare = Counter(w for w, x in zip((*t, END), found, strict=True) if x is None) if None in found else {}
            sure = [x for x in found if x is not None] if rare else found
            out["sure"].append(len(sure))
            out["sure_sum"].append(float(sum(sure)))
            out["rare"].append(list(rare.items()))
        out["rare"] = [[{"word": w, "n": n} for w, n in r] for r in out["rare"]]
        yield out

    # the row number is written with the row, so that rows which share an id stay apart
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = "row long, doc_id long, n_tokens long, sure long, sure_sum double, rare array<struct<word:binary,n:long>>, strings array<long>, sure_score double"
    rows = written(map_batches(numbered, run, schema, slice_bytes=2 << 20), "scored")
    # a long word may be in most rows
    met_words = look_up(rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n"), words.withColumnRenamed("n", "c"), ["word"])
    met_words = met_words.select("row", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known"), (F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("n")).alias("base"), F.lit(0.0).alias("log10"))
    rest = strings.where(step_of("seen") < cut).select("gram", "log10")
    met_strings = rows.select("row", F.explode("strings").alias("gram")).join(rest, "gram").select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "log10")
    sums = met_words.unionByName(met_strings).groupBy("row").agg(*[F.sum(c).alias(f"rare_{c}") for c in ("known", "base", "log10")])
    found = rows.drop("rare", "strings").join(sums, "row", "left")
    base = F.col("sure_sum") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(bottom)
    return found.select("doc_id", "n_tokens", (F.col("sure") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("sure_score") + F.coalesce("rare_log10", F.lit(0.0))).alias("score"))
