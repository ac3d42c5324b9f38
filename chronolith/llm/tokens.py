"""Token counts with a whole-token shortcut.

The tokenizer splits a text into pre-tokens and merges bytes inside each.  Once,
on the driver, every vocabulary string is encoded alone: those that come back as
their one id are proven *whole tokens*.  A pre-token that is one of them counts
1 without any merge; only the rest goes through the library, once for each
distinct pre-token that a task meets.  Where a text has characters that the split
is not proven for, only the stretch between blanks around them goes to the library.

Null texts have no tokens; special strings inside a text count as the library
takes them by default; rows that repeat are counted each; long texts are counted
whole.  An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chronolith.llm.common import map_batches

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the pattern is known to class as the library does, whatever the
#: Unicode version of either; a stretch with any other goes to the library.
UNPROVEN = r"[^\x00-՗‐-⁤、-ヿ一-龥가-힣]"

#: A blank between characters that no Unicode version takes for white space: a pre-token always begins with it.
CUT = r"(?<=[^\s\x1c-\x1f\x85])(?= [^\s\x1c-\x1f\x85])"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(256 + k): b for k, b in enumerate(hidden)}


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven to encode alone as one token; at most the vocabulary, so safe to send to all tasks."""
    from tokenizers import Tokenizer

    library, letters, texts = Tokenizer.from_file(path), byte_letters(), {}
    for token, number in library.get_vocab().items():
        if all(c in letters for c in token):
            try:
                texts[bytes(letters[c] for c in token).decode()] = number
            except UnicodeDecodeError:  # part of a character: never a pre-token
                continue
    coded = library.encode_batch(list(texts), add_special_tokens=False)
    return frozenset(text for (text, number), found in zip(texts.items(), coded, strict=True) if found.ids == [number])


def check_kind(path: str) -> None:
    """The shortcut holds for byte-level BPE without a normaliser or an added blank."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("the whole-token shortcut needs a byte-level tokenizer without a normaliser")


class Counts(dict):
    """Tokens of a pre-token: 1 for whole tokens, else what the library makes of it."""

    def __init__(self, library, whole: frozenset[str], limit: int = 400_000):
        super().__init__(dict.fromkeys(whole, 1))
        self.library, self.whole, self.limit = library, whole, limit

    def __missing__(self, pre: str) -> int:
        if len(self) > self.limit + len(self.whole):
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[pre] = n = len(self.library.encode(pre, add_special_tokens=False).ids)
        return n


class Counter:
    """Counts tokens of texts in one worker."""

    def __init__(self, path: str, whole: frozenset[str]):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.counts = Counts(self.library, whole)
        self.find, self.unproven, self.cut = regex.compile(PATTERN).findall, regex.compile(UNPROVEN).search, regex.compile(CUT).split
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def count(self, text: str) -> int:
        if any(a in text for a in self.added):
            return self.whole(text)
        if self.unproven(text):
            return sum(self.whole(s) if self.unproven(s) else self.proven(s) for s in self.cut(text))
        return self.proven(text)

    def proven(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.find(text)))

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)


_workers: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, text: str = "text", column: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``text`` in a new column; no shuffle.

    Only ``text`` goes to Python and back beside the other columns of ``docs``,
    so select what is needed first.
    """
    check_kind(path)
    sent = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    others = [c for c in docs.columns if c != column]

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        worker = _workers.get(path) or _workers.setdefault(path, Counter(path, sent.value))
        yield {c: batch.column(c) for c in others} | {column: [worker.count(t or "") for t in batch.column(text).to_pylist()]}

    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    return map_batches(kept, count, StructType([*kept.schema.fields, StructField(column, LongType())]))
