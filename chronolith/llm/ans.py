"""Token-ID files: range asymmetric numeral coding with static tables.

Documents are dealt by ranges of ``doc_id``, tokenised, and written in ascending
order.  A file row is one *segment* of a few million ids: a frequency table that
all its blocks share, and blocks of about ``block_tokens`` ids that are decoded
without each other.  In a block, ``lanes`` interleaved coder states share one
stream of 32-bit words; every ``checkpoint_steps`` steps the states and the
place in the stream are kept, so that a reader can start there; crc32 checksums
cover the stream and the ids.

Null texts are empty documents, which hold the end id alone; rows that repeat
are coded as often as they come, ordered by id and then by a hash of the text;
a null id comes first; an empty table gives no segment.  Other columns are not
read.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import cut, map_batches, texts_of
from chronolith.llm.tokens import byte_letters
from chronolith.storage import shuffle_partitions

LOW = np.uint64(1 << 31)
WORD = np.uint64(32)

SCHEMA = """part int, segment int, first long, n_tokens long, scale_bits int, symbols binary, counts binary,
blocks array<struct<n_tokens:int, lanes:int, doc_ids:array<bigint>, lengths:array<int>, words:binary, checkpoints:binary, words_crc:bigint, ids_crc:bigint>>"""


# --- the coder ---------------------------------------------------------------


def table(counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Scale bits and whole frequencies of at least 1 that sum to ``2**bits``."""
    bits = max(12, min(24, int(len(counts)).bit_length() + 3))
    whole = 1 << bits
    share = 1 + (counts.astype(np.int64) * (whole - len(counts))) // int(counts.sum())
    share[int(np.argmax(counts))] += whole - int(share.sum())
    return bits, share.astype(np.uint64)


def encode_block(index: np.ndarray, freq: np.ndarray, bits: int, lanes: int, every: int) -> tuple[bytes, bytes]:
    """Code symbol indexes; the words and the checkpoints (place, states) in reading order."""
    lanes = max(1, min(lanes, len(index)))
    start = np.cumsum(freq) - freq
    steps = -(-len(index) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    shift, room = np.uint64(bits), np.uint64(63 - bits)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    n_out = 0
    for step in range(steps - 1, -1, -1):
        symbol = index[step * lanes : (step + 1) * lanes]
        live = state[: len(symbol)]
        f = freq[symbol]
        full = live >= (f << room)
        if full.any():
            out.append((live[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            n_out += len(out[-1])
            live[full] >>= WORD
        whole, rest = np.divmod(live, f)
        live[:] = (whole << shift) + rest + start[symbol]
        if step % every == 0:
            marks.append((n_out, state.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    kept = b"".join(np.uint64(n_out - at).astype("<u8").tobytes() + s.astype("<u8").tobytes() for at, s in reversed(marks))
    return words.tobytes(), kept


def decode_block(words: bytes, checkpoints: bytes, n: int, lanes: int, freq: np.ndarray, bits: int, every: int, mark: int = 0, count: int | None = None) -> np.ndarray:
    """Symbol indexes from the checkpoint ``mark`` on: ``count`` of them, or all to the block's end."""
    lanes = max(1, min(lanes, n))
    kept = np.frombuffer(checkpoints, "<u8").reshape(-1, lanes + 1)
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    start = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
    at, state = int(kept[mark, 0]), kept[mark, 1:].copy()
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    rest = n - mark * every * lanes
    out = np.empty(rest if count is None else min(count, rest), np.uint32)
    done = 0
    while done < len(out):
        live = state[: len(out) - done]
        slot = live & mask
        symbol = slots[slot]
        out[done : done + len(live)] = symbol
        live[:] = freq[symbol] * (live >> shift) + slot - start[symbol]
        short = live < LOW
        need = int(np.count_nonzero(short))
        if need:
            live[short] = (live[short] << WORD) | stream[at : at + need]
            at += need
        done += len(live)
    return out


#: Fixed value: the tokenizer's own split, for printable ASCII in lower case.
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall

# --- tokens ------------------------------------------------------------------


def check_kind(path: str) -> None:
    """:class:`Words` spells out one kind of tokenizer: byte-level words in lower case; any other is an error."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [(n.get("type"), n.get("pattern"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    words = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
    fits = (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
        and (splits[0].get("pattern"), splits[0].get("behavior"), splits[0].get("invert")) == (words, "Removed", True)
        and not splits[1].get("add_prefix_space")
        and not splits[1].get("use_regex", True)
        and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    )
    if not fits:
        raise ValueError("token files need a tokenizer of lower-case byte-level words, with special strings that begin with <|")


class Words(dict):
    """Ids of the pieces of texts between blanks and line feeds, which no token crosses.

    A piece's ids come from the library, once for as long as a worker keeps it;
    ``limit`` bounds what is kept.  Capitals, and punctuation beside ASCII
    letters, are looked up by their parts, as the tokenizer parts them.
    """

    def __init__(self, path: str, limit: int = 650_000):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.limit, self.library = limit, Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merge = self.library.model.tokenize
        letters = {v: k for k, v in byte_letters().items()}
        self.shown = {b: letters[b] for b in range(256) if chr(b) != letters[b]}

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def count(self, text: str) -> int:
        """How many ids the text has."""
        return sum(map(len, map(self.__getitem__, text.replace("\n", " ").split(" ")))) // 4

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self[""] = b""

    def __missing__(self, p: str) -> bytes:
        if p.isascii():
            low = p.lower()
            if "<|" in p or not p.isprintable():  # may hold a special string or white space
                found = self.whole(p)
            elif low != p:
                found = self[low]
            elif p.isalpha():  # one pre-token, spelt by its own bytes
                found = self.merged(p)
            else:
                parts = PRE_TOKENS(p)
                found = b"".join([self[x] for x in parts]) if len(parts) > 1 else self.whole(p)
        elif max(p) >= "ɐ" or "İ" in p:  # letters that the library may part or compose
            found = self.whole(p)
        elif p[-1] in ",." and p[:-1].isalpha():
            found = self[p[:-1]] + self[p[-1]]
        elif p.isalpha():
            low = p.lower()
            found = self[low] if low != p else self.merged(p.encode().decode("latin-1").translate(self.shown))
        else:
            found = self.whole(p)
        self[p] = found
        return found

    def merged(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.merge(shown)]).tobytes()

    def whole(self, p: str) -> bytes:
        return array("I", self.library.encode(p, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def encode(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, block_tokens: int = 1 << 18, segment_tokens: int = 1 << 21, lanes: int = 1024, checkpoint_steps: int = 64) -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``path``, in ascending order of doc_id.

    ``tokenizer`` is a file of the tokenizers library that all machines have.
    """
    check_kind(tokenizer)
    tail = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # millions of strings without cycles
        part, words = TaskContext.get().partitionId(), _words(tokenizer)
        segment = first = 0
        docs_now: list[tuple[int | None, np.ndarray]] = []
        held = 0
        for batch in batches:
            for piece in cut(batch, 2 << 20):
                words.trim()
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts_of(piece), strict=True):
                    ids = np.frombuffer(words.ids(text) + tail, "<u4")
                    docs_now.append((doc_id, ids))
                    held += len(ids)
                    if held >= segment_tokens:
                        yield segment_row(part, segment, first, docs_now, block_tokens, lanes, checkpoint_steps)
                        segment, first, docs_now, held = segment + 1, first + held, [], 0
        if docs_now:
            yield segment_row(part, segment, first, docs_now, block_tokens, lanes, checkpoint_steps)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id")
    dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def token_lengths(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row: how many ids :func:`encode` writes for it; no shuffle."""
    check_kind(tokenizer)
    tail = int(end_id is not None)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        words = _words(tokenizer)
        words.trim()
        yield {"doc_id": batch.column("doc_id"), "n_tokens": [words.count(t) + tail for t in texts_of(batch)]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long", slice_bytes=2 << 20)


def _arrow_schema() -> pa.Schema:
    block = pa.struct([("n_tokens", pa.int32()), ("lanes", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("words", pa.binary()), ("checkpoints", pa.binary()), ("words_crc", pa.int64()), ("ids_crc", pa.int64())])
    return pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("scale_bits", pa.int32()), ("symbols", pa.binary()), ("counts", pa.binary()), ("blocks", pa.list_(block))])


def segment_row(part: int, segment: int, first: int, docs: list[tuple[int | None, np.ndarray]], block_tokens: int, lanes: int, every: int) -> pa.RecordBatch:
    """One file row: the table and the blocks of these documents."""
    ids = np.concatenate([x for _, x in docs])
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(seen).astype("<u4")
    bits, freq = table(seen[symbols]) if len(ids) else (12, np.zeros(0, np.uint64))
    place = np.zeros(len(seen), np.uint32)
    place[symbols] = np.arange(len(symbols), dtype=np.uint32)
    blocks, now, held = [], [], 0
    for k, (doc_id, own) in enumerate(docs):
        now.append((doc_id, own))
        held += len(own)
        if held >= block_tokens or k == len(docs) - 1:
            all_ids = np.concatenate([x for _, x in now])
            words, marks = encode_block(place[all_ids], freq, bits, lanes, every) if held else (b"", b"")
            blocks.append({"n_tokens": held, "lanes": lanes, "doc_ids": [d for d, _ in now], "lengths": [len(x) for _, x in now], "words": words, "checkpoints": marks, "words_crc": zlib.crc32(words), "ids_crc": zlib.crc32(all_ids.tobytes())})
            now, held = [], 0
    row = {"part": part, "segment": segment, "first": first, "n_tokens": len(ids), "scale_bits": bits, "symbols": symbols.tobytes(), "counts": freq.astype("<u4").tobytes(), "blocks": blocks}
    return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())


def read_from(block: dict, symbols: np.ndarray, freq: np.ndarray, bits: int, first: int, count: int, checkpoint_steps: int = 64) -> np.ndarray:
    """``count`` ids of a block from place ``first`` on, decoded from the checkpoint before it; checksums need whole blocks."""
    per_mark = checkpoint_steps * max(1, min(block["lanes"], block["n_tokens"]))
    mark = first // per_mark
    last = min(-(-(first + count) // per_mark) * per_mark, block["n_tokens"])
    index = decode_block(block["words"], block["checkpoints"], block["n_tokens"], block["lanes"], freq, bits, checkpoint_steps, mark, last - mark * per_mark)
    return symbols[index][first - mark * per_mark :][:count]


def decode(spark: SparkSession, path: str, checkpoint_steps: int = 64) -> DataFrame:
    """``(doc_id, start, ids)`` of each document: ids as little-endian unsigned 32-bit integers.

    Segments are decoded in parallel; a checksum that does not fit is an error.
    """

    def blocks_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1).to_pylist()[0]
            symbols = np.frombuffer(one["symbols"], "<u4")
            freq = np.frombuffer(one["counts"], "<u4").astype(np.uint64)
            at = one["first"]
            for block in one["blocks"]:
                if zlib.crc32(block["words"]) != block["words_crc"]:
                    raise ValueError(f"segment {one['part']}/{one['segment']}: words are damaged")
                n = block["n_tokens"]
                index = decode_block(block["words"], block["checkpoints"], n, block["lanes"], freq, one["scale_bits"], checkpoint_steps) if n else np.zeros(0, np.uint32)
                raw = symbols[index].tobytes()
                if zlib.crc32(raw) != block["ids_crc"]:
                    raise ValueError(f"segment {one['part']}/{one['segment']}: ids are damaged")
                ends = np.cumsum([0, *block["lengths"]])
                yield {"part": [one["part"]] * len(block["doc_ids"]), "doc_id": block["doc_ids"], "local_start": (at + ends[:-1]).tolist(), "ids": [raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]}
                at += n

    files = spark.read.schema(SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each range partition, however many documents there are: a few thousand at most
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    rows = map_batches(files, blocks_of, "part int, doc_id long, local_start long, ids binary", slice_bytes=1 << 62)
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "ids")
