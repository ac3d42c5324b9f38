"""Edges of the numbered operators that were found wrong once."""

from __future__ import annotations

import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronolith.llm import ans, feistel, simhash, tokens, toxicity, urls

PAGES = "page_id long, url string, html string"


def test_long_pages_take_time_in_proportion(spark):
    head = '<LINK href="/b" rel=canonical><meta http-equiv="Refresh" content="0; url=/c?x=1&amp;y=2">'
    tails = ["<link " * 800_000, "<meta " * 800_000, "\"'" * 2_500_000, "<link rel=canonical href=" + " " * 5_000_000, "<link rel=\"" * 400_000 + ">", "<meta http-equiv=" + " " * 5_000_000 + ">", "<link rel=" + " " * 2_000_000 + "\"canonical\" href=" + " " * 2_000_000 + ">"]
    rows = [(k, f"http://h{k}.org/a", head + t) for k, t in enumerate(tails)] + [(90, "http://x.org/a", "<link rel=canonical href='/b'"), (91, "http://y.org/a", ">"), (92, "http://z.org/a", None)]
    began = time.perf_counter()
    got = {(r["src"], r["dst"]) for r in urls.alias_edges(spark.createDataFrame(rows, PAGES)).collect()}
    assert time.perf_counter() - began < 60
    assert got == {(f"h{k}.org/a", f"h{k}.org/{d}") for k in range(len(tails)) for d in ("b", "c?x=1&y=2")}


def test_one_address_may_be_most_pages(spark):
    rows = [(k, f"http://a.org/index?id={k}", None) for k in range(3000)] + [(k, None if k % 2 else "http://b.org/de/x", None) for k in range(3000, 3010)]
    rules = spark.createDataFrame([("org", "/", "allow"), ("b.org", "/de/", "block")], urls.RULES_SCHEMA)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert got == {k: ("org/", "allow") if k < 3000 else (None, "allow") if k % 2 else ("b.org/de/", "block") for k in range(3010)}


@pytest.mark.parametrize("n", [5, 12, 100])
def test_few_labels_teach_a_word_and_keep_clean_rows(spark, n):
    rng = np.random.default_rng(n)
    words = ["".join(rng.choice(list("bcdfgklmnprstv"), 6)) for _ in range(400)]
    rows = []
    for k in range(4 * n):
        text = list(rng.choice(words, 30))
        if k % 2:
            text[int(rng.integers(30))] = "grumbolt"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(2 * n)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    held = range(2 * n, 4 * n)
    assert np.mean([k not in kept for k in held if k % 2]) >= (0.8 if n < 100 else 0.97)
    assert np.mean([k in kept for k in held if not k % 2]) >= (0.8 if n < 100 else 0.97)


def test_labels_that_tell_nothing_reject_nothing_else(spark):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(20))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(24)] + [(0, 0), (1, 0)], "doc_id long, toxic int")
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([k in kept for k in range(24, 60)]) > 0.9


def test_all_spellings_of_a_phone_number_have_one_pseudonym(spark):
    same = [["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+44 (20) 7946 0958"], ["+49 30 123456", "+4930123456", "+49 (30) 123 456"], ["+1 (555) 013-4567", "+15550134567", "+1.555.013.4567"], ["+353 21 123 4567", "+353211234567"]]
    docs = spark.createDataFrame([(i, " tel ".join(s)) for i, s in enumerate(same)] + [(9, "no +1 (555) 013-456 and +1 20 7946 0958 1")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in feistel.pseudonymise(docs, "k").collect()}
    for i, spellings in enumerate(same):
        got = [p["pseudonym"] for p in rows[i]["pii"]]
        digits = {"".join(c for c in p if c.isdigit()) for p in got}
        code = ["44", "49", "1", "353"][i]
        assert len(got) == len(spellings) and len(digits) == 1 and digits.pop().startswith(code), got
        assert all([c if not c.isdigit() else "9" for c in a] == [c if not c.isdigit() else "9" for c in b] for a, b in zip(got, spellings, strict=True))
    assert rows[9]["text"].startswith("no +1 (555) 013-456")


def test_fingerprints_that_only_rows_without_an_id_have_still_link(spark, monkeypatch):
    # three fingerprints in a row, two bits apart each: the middle one has no id
    prints = [(1, 0), (None, 3), (9, 15), (None, -1), (None, -1)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs)
    got = simhash.near_classes(spark.createDataFrame(prints, "doc_id long, print long")).collect()
    assert sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"] or 0) for r in got) == [(0, "0" * 15 + "3", 1), (0, "f" * 16, 0), (0, "f" * 16, 0), (1, "0" * 16, 1), (9, "0" * 15 + "f", 1)]


def test_token_files_refuse_other_tokenizers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for use in (lambda p: ans.encode(docs, str(tmp_path / "x"), p), lambda p: ans.token_lengths(docs, p)):
        with pytest.raises(ValueError, match="lower-case"):
            use(public_tokenizers.path("byte_bpe_50k.json"))


def test_only_the_stretch_around_an_unproven_character_goes_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = tokens.Counter(path, tokens.whole_tokens(path))
    asked, whole = [], counter.whole
    counter.whole = lambda t: (asked.append(t), whole(t))[1]
    text = "plain words first \N{GRINNING FACE} then more  of them, שלום!\nend"
    assert counter.count(text) == whole(text) and asked == [" \N{GRINNING FACE}", " שלום!\nend"]
    rng = np.random.default_rng(4)
    parts = [*"abZ0 .,'é\n\t  　\x85\x1c中가", "\N{GRINNING FACE}", "हिन्दी", "ไทย", " the", "  ", "​", "᠎", "̈"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, int(rng.integers(1, 20))))
        assert counter.count(t) == whole(t), t


def test_subtrees_are_cut_as_they_stream_by():
    import pyarrow as pa

    from chronolith.llm import pst

    rng = np.random.default_rng(2)
    gram = np.sort(rng.integers(0, 40, 5000) << 40 | rng.integers(0, 1 << 30, 5000))
    table = pa.table({"gram": gram, "n": np.ones(5000, np.int64)})
    for size, rows in ((7, 100), (1000, 100), (64, 1), (5000, 10_000), (300, 600)):
        pieces = list(pst.whole_subtrees(iter(table.to_batches(max_chunksize=size)), 6, rows))
        assert pa.concat_tables(pieces).column("gram").to_numpy().tolist() == gram.tolist()
        owners = [set((p.column("gram").to_numpy() >> 40).tolist()) for p in pieces]
        assert all(not a & b for k, a in enumerate(owners) for b in owners[k + 1 :])
        assert all(p.num_rows for p in pieces)


def test_sums_of_known_strings_by_text():
    from chronolith.llm import pst

    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 30, 700)
    keys = rng.integers(0, 300, lengths.sum()).astype(np.uint64) << np.uint64(40)
    strings = np.unique(rng.choice(keys, 100))
    values = rng.random(len(strings))
    total, text, other = pst.known_sums(keys, lengths, strings, values)
    at, left = 0, []
    for k, n in enumerate(lengths):
        own = keys[at : at + n]
        at += n
        assert total[k] == pytest.approx(sum(values[np.searchsorted(strings, x)] for x in own if x in strings))
        left += sorted((k, int(x)) for x in own if x not in strings)
    assert sorted(zip(text.tolist(), other.tolist(), strict=True)) == sorted(left) and (np.diff(text) >= 0).all()
