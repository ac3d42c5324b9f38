"""The numbered operators on small fixtures: brute force, round trips, and awkward rows."""

from __future__ import annotations

import datetime
import hashlib
import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronolith.llm import ans, chunks, decontam, feistel, packing, pst, simhash, tokens, toxicity, urls

LONG = "lorem ipsum dolor " * 40_000
ODD = [(1, "The cat sat. On the mat, it's 1,2 x<|endoftext|>y"), (2, None), (3, ""), (4, "été ́ İstanbul 中文 ʰ \x1c a\tb"), (5, LONG), (6, "same text"), (6, "same text"), (7, "same text"), (None, "no id"), (8, "\n\n  ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("count", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- 1: token files ---


def test_ans_coder_round_trip_and_checkpoints():
    rng = np.random.default_rng(1)
    for n in (1, 5, 1000, 70_000):
        index = np.minimum(rng.geometric(0.05, n) - 1, 400).astype(np.uint32)
        counts = np.bincount(index, minlength=401) + 1
        bits, freq = ans.table(counts)
        assert freq.sum() == 1 << bits and freq.min() >= 1
        words, marks = ans.encode_block(index, freq, bits, 64, 16)
        assert (ans.decode_block(words, marks, n, 64, freq, bits, 16) == index).all()
        lanes = min(64, n)
        for mark in range(len(marks) // (8 * (lanes + 1))):
            assert (ans.decode_block(words, marks, n, 64, freq, bits, 16, mark) == index[mark * 16 * lanes :]).all()


def test_ans_blocks_are_read_from_any_place():
    rng = np.random.default_rng(41)
    ids = rng.integers(0, 900, 50_000).astype("<u4")
    row = ans.segment_row(0, 0, 0, [(1, ids)], 1 << 20, 64, 16).to_pylist()[0]
    symbols, freq = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["counts"], "<u4").astype(np.uint64)
    for first, count in ((0, 1), (0, 50_000), (1023, 2), (1024, 1024), (31_111, 4000), (49_999, 1), (49_000, 5000)):
        got = ans.read_from(row["blocks"][0], symbols, freq, row["scale_bits"], first, count, 16)
        assert (got == ids[first : first + count]).all() and len(got) == min(count, 50_000 - first)


def test_ans_files_hold_the_ids_in_order(spark, odd, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    ans.encode(odd, str(tmp_path / "a"), path, 2, block_tokens=64, segment_tokens=256, lanes=8, checkpoint_steps=4)
    got = ans.decode(spark, str(tmp_path / "a"), 4).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    want = {d: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for d, t in ODD}
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    at = 0
    for r in got:
        assert bytes(r["ids"]) == want[r["doc_id"]] and r["start"] == at
        at += len(r["ids"]) // 4
    ans.encode(empty, str(tmp_path / "e"), path, 2)
    assert ans.decode(spark, str(tmp_path / "e")).count() == 0


def test_ans_damage_is_found(spark, tmp_path):
    words, marks = ans.encode_block(np.zeros(10, np.uint32), np.array([4096], np.uint64), 12, 4, 4)
    row = ans.segment_row(0, 0, 0, [(1, np.array([5, 6, 5, 5], "<u4"))], 8, 4, 4).to_pylist()[0]
    row["blocks"][0]["ids_crc"] ^= 1
    spark.createDataFrame([row], ans.SCHEMA).write.parquet(str(tmp_path / "d"))
    with pytest.raises(Exception, match="damaged"):
        ans.decode(spark, str(tmp_path / "d")).collect()


# --- 2: exact dedup ---


def _brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


def test_exact_groups_against_brute_force(spark, odd, empty):
    rows = [*ODD, (20, "sa me\ttext "), (21, "x" * 9000), (22, "x " * 9000), (23, "y" + "x" * 8999)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute_exact(rows)
    for r in chunks.exact_groups(docs).collect():
        bare = next(k for k in want if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        assert (r["keep_id"], r["group_size"]) == want[bare]
    assert chunks.exact_groups(empty).count() == 0
    kept = chunks.deduplicate(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 8]


def test_one_copy_without_an_id_goes(spark):
    docs = spark.createDataFrame([(1, "same text"), (None, "same  text"), (2, "other")], "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in chunks.deduplicate(docs).collect()) == [0, 2]
    docs = spark.createDataFrame([(1, "same text"), (None, "same text"), (2, "other")], "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in chunks.deduplicate(docs).collect()) == [1, 2]
    docs = spark.createDataFrame([(1, "same text"), (None, "alone")], "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in chunks.deduplicate(docs).collect()) == [0, 1]


def test_shared_chunk_hashes_are_told_apart(spark, monkeypatch):
    # all chunks share one short hash: only digests can part the documents
    real = F.xxhash64
    monkeypatch.setattr(chunks.F, "xxhash64", lambda *c: real(F.lit(1)) if len(c) == 1 else real(*c))
    rows = [(1, "a" * 50), (2, "b" * 50), (3, "a " * 50)]
    got = {r["doc_id"]: r["keep_id"] for r in chunks.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


def test_chunks_survive_an_insertion_in_any_script(spark):
    rng = np.random.default_rng(37)
    alphabets = {"latin": (0x61, 0x7B), "cyrillic": (0x430, 0x450), "arabic": (0x620, 0x64B), "hindi": (0x905, 0x93A), "kana": (0x3041, 0x3097), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7A4), "emoji": (0x1F300, 0x1F600)}
    rows = []
    for name, (low, high) in alphabets.items():
        text = "".join(chr(c) for c in rng.integers(low, high, 12_000))
        rows += [(name, 0, text), (name, 1, text[:700] + "X" + text[700:])]
    found = {(r["name"], r["k"]): r["c"] for r in spark.createDataFrame(rows, "name string, k int, text string").select("name", "k", F.regexp_extract_all("text", F.lit(chunks.chunk_pattern()), F.lit(0)).alias("c")).collect()}
    for name in alphabets:
        one, two = found[name, 0], found[name, 1]
        assert "".join(one) == next(t for n, k, t in rows if n == name and k == 0)
        assert len(one) > 10 and len(set(one) & set(two)) >= 0.8 * len(one), name


# --- 3: urls ---


def test_url_rules_and_alias_classes(spark):
    pages = [(1, "http://a.bad.com/x?q", '<link rel="canonical" href="https://b.net/y">'), (2, "https://b.net/y#t", ""), (3, "HTTP://C.net/z", '<meta http-equiv="refresh" content="0; url=http://b.net/y">'),
             (4, None, None), (5, "no scheme", ""), (6, "http://d.net", '<link href=/home rel=canonical>'), (7, "http://d.net/home", '<link rel=canonical href="http://ok.org/1">'), (8, "http://ok.org/1", ""), (9, "http://d.net", None), (10, "http://lone.net/bad", "")]
    rules = spark.createDataFrame([("bad.com", "/", "block"), ("ok.org", "/", "allow"), ("d.net", "/h", "block"), ("a.bad.com", "/xyz", "allow")], urls.RULES_SCHEMA)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got[1] == ("a.bad.com", "/x", "bad.com/", "block") and got[2] == ("b.net", "/y", None, "block") and got[3] == ("c.net", "/z", None, "block")
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    # a class with an allowed member is allowed, but a rule's own verdict stands
    assert got[6][3] == "allow" and got[9][3] == "allow" and got[7] == ("d.net", "/home", "d.net/h", "block") and got[8][3] == "allow" and got[10][3] == "allow"
    none = urls.judge(spark.createDataFrame([], "page_id long, url string, html string"), rules)
    assert none.count() == 0
    more = spark.createDataFrame([("http://lone.net/bad", "http://a.bad.com/x?q")], "src string, dst string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, more).collect()}[10] == "block"


def test_aliases_keep_queries_apart_and_take_every_link(spark):
    pages = [(1, "http://s.net/index?id=1", ""), (2, "http://s.net/index?id=2", '<link rel="alternate canonical" href="http://bad.com/a?x=1&amp;y=2"><link rel=stylesheet href=canonical.css>'), (3, "http://bad.com/a?x=1&y=2", ""), (4, "http://d.net/a/b.html", "<link rel='canonical' href='c.html'>"), (5, "http://d.net/a/c.html", '<meta http-equiv=refresh content="0;url=?p=1"><META HTTP-EQUIV="refresh" content="3; URL=\'http://bad.com/z\'">'), (6, "http://d.net/a/c.html?p=1", "<link rel=canonical href=#top>"), (7, "http://d.net/canonical.css", None), (1, "http://s.net/index?id=1", ""), (8, "http://s.net/index", "<p " + "x" * 300_000 + ">"), (9, "http://bad.com/z", "")]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("component", F.lit(1)).withColumn("verdict", F.lit("x"))
    rules = spark.createDataFrame([("bad.com", "/", "block")], urls.RULES_SCHEMA)
    rows = urls.judge(docs, rules).collect()
    got = {r["page_id"]: r["verdict"] for r in rows}
    assert len(rows) == 10 and got == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "block"}
    assert {r["component"] for r in rows if r["page_id"] in (2, 3)} == {"bad.com/a?x=1&y=2"} and {r["component"] for r in rows if r["page_id"] in (1, 7, 8)} == {None}


# --- 4: toxicity ---


def test_toxicity_learns_stems_and_misspellings(spark, odd, empty):
    rng = np.random.default_rng(5)
    common = ["".join(rng.choice(list("aeiourstnl"), 5)) for _ in range(200)]
    rows, labels = [], []
    for k in range(400):
        words = list(rng.choice(common, 40))
        bad = k % 2
        for _ in range(2 * bad):
            words[int(rng.integers(40))] = "grumbolt" + str(rng.choice(["", "s", "ing", "er"]))
        rows.append((k, " ".join(words)))
        labels.append((k, bad))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") < 300, n_buckets=1 << 14)
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(bad) for k, bad in labels if k >= 300]) > 0.95
    assert model.word(b"grumbollt") > 10 * abs(model.word(common[0].encode()))
    scored = toxicity.scores(odd, model)
    assert scored.count() == len(ODD) and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.scores(empty, toxicity.fit(empty, marks.limit(0))).count() == 0


def test_toxicity_scores_are_those_of_the_plain_rule(spark):
    rng = np.random.default_rng(43)
    model = toxicity.Model(rng.normal(0, 3, 512).astype(np.float32), -0.4)
    texts = ["", "The cat, the CAT!", "naïve 9 z", " ".join(rng.choice(["ab", "abc", "abcd", "häß"], 300))]
    want = []
    for t in texts:
        words = [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()) if w]
        value = 0.0
        for w in words:
            marked = f"<{w}>"
            grams = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
            value += np.mean([float(model.push[zlib.crc32(g.encode()) % 512]) for g in grams]) / len(words)
        want.append(1 / (1 + np.exp(-(value - 0.4))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert all(abs(got[k] - w) < 1e-5 for k, w in enumerate(want))


def test_toxicity_training_descends_the_joint_loss():
    # two classes told apart by one bucket each: the fitted vectors must give both texts their label
    text, bucket, share = np.array([0, 0, 1, 1]), np.array([3, 5, 4, 5]), np.array([0.5, 0.5, 0.5, 0.5])
    model = toxicity.train(text, bucket, share, np.array([0, 1]), 0.5, 8)
    push = model.push
    logits = [(push[3] + push[5]) / 2 + model.bias, (push[4] + push[5]) / 2 + model.bias]
    assert logits[0] < -5 and logits[1] > 5 and (push[[0, 1, 2, 6, 7]] == 0).all()
    assert toxicity.train(text, bucket, share, np.array([1, 1]), 0.9, 8).bias > 2


# --- 5: pseudonyms ---


def _luhn(digits):
    d = [int(x) for x in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms_keep_their_format_and_link(spark, odd):
    text = "a 4111 1111 1111 1111 b 9807915762804490 +1 (017) 555-7713 97.51.17.173 123-45-6789 2024-02-29 1999/12/31 und.34@mail7.example.com b44e15e09fd311c3cf3163b66d5a9875b883d8ce end 2024-13-01 999.1.1.1"
    docs = spark.createDataFrame([(1, text), (2, text.replace("a ", "z ")), (3, None), (4, ""), (5, "nothing 12")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in feistel.pseudonymise(docs, "k").collect()}
    found = {p["kind"]: p for p in rows[1]["pii"]}
    assert set(found) == {k for k, _ in feistel.KINDS}
    assert [p["pseudonym"] for p in rows[1]["pii"]] == [p["pseudonym"] for p in rows[2]["pii"]]
    for p in rows[1]["pii"]:
        assert p["value"] != p["pseudonym"] and p["value"] not in rows[1]["text"] and p["pseudonym"] in rows[1]["text"]
        if p["kind"] != "ipv4":
            assert re.sub("[0-9a-z]", "x", p["value"]) == re.sub("[0-9a-z]", "x", p["pseudonym"])
    first = rows[1]["pii"][0]
    assert _luhn(first["pseudonym"].replace(" ", ""))
    assert rows[1]["text"].endswith("end 2024-13-01 999.1.1.1")
    assert rows[3]["text"] is None and rows[4]["text"] == "" and rows[5]["text"] == "nothing 12" and rows[5]["pii"] == []
    other = feistel.pseudonymise(docs.where("doc_id = 1"), "other").first()
    assert other["text"] != rows[1]["text"]
    assert feistel.pseudonymise(odd, "k").count() == len(ODD)


def test_feistel_is_a_permutation(spark):
    runs = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("x"))
    assert runs.select(feistel.permute_run(F.col("x"), 10, "k", "t").alias("y")).distinct().count() == 1000
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("x"))
    moved = days.select(feistel.date(F.col("x"), "k").alias("y")).distinct()
    assert moved.count() == 3000 and moved.where("y < '1900-01-01' or y > '2099-12-31'").count() == 0


def _network(left, right, left_size, right_size, key, kind):
    """The Feistel network in plain Python."""

    def noise(step, half, below):
        return int(hashlib.sha256(f"{key}|{kind}|{step}|{half}".encode()).hexdigest()[:15], 16) % below

    for step in range(1, feistel.ROUNDS + 1):
        if step % 2:
            left = (left + noise(step, right, left_size)) % left_size
        else:
            right = (right + noise(step, left, right_size)) % right_size
    return left, right


def _digits(number, base, n):
    out = ""
    for _ in range(n):
        number, d = divmod(number, base)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out


def _run(run, base, key, kind):
    a = len(run) // 2
    l, r = _network(int(run[:a] or "0", base), int(run[a:], base), base**a, base ** (len(run) - a), key, kind)
    return _digits(l, base, a) + _digits(r, base, len(run) - a)


def _long(run, base, size, key, kind):
    return "".join(_run(run[at : at + size], base, key, f"{kind}-{len(run)}-{at // size}") for at in range(0, len(run), size))


def _plain_pseudonym(kind, value, key):
    only = re.sub("[^0-9]", "", value)
    if kind == "card":
        head = _run(only[:-1], 10, key, "card")
        moved = head + next(c for c in "0123456789" if _luhn(head + c)) if _luhn(only) else only
    elif kind == "phone":
        only = re.sub("[^0-9]", "", value)
        known = set(feistel.COUNTRY_CODES.split())
        size = next((k for k in (1, 2) if only[:k] in known), 3)
        moved = only[:size] + _long(only[size:], 10, 16, key, "phone")
    elif kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        l, r = _network(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        return f"{l + 1 + (l >= 665):03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"
    elif kind == "ipv4":
        b = [int(x) for x in value.split(".")]
        l, r = _network(b[0] * 256 + b[1], b[2] * 256 + b[3], 65536, 65536, key, "ipv4")
        return f"{l >> 8}.{l & 255}.{r >> 8}.{r & 255}"
    elif kind == "date":
        number = (datetime.date.fromisoformat(value.replace("/", "-")) - datetime.date(1900, 1, 1)).days
        while True:
            l, r = _network(number // 270, number % 270, 271, 270, key, "date")
            number = l * 270 + r
            if number < feistel.DAYS:
                return (datetime.date(1900, 1, 1) + datetime.timedelta(number)).isoformat().replace("-", value[4])
    elif kind == "email":
        local, domain = value.split("@")
        return re.sub("[a-z0-9]+", lambda m: _long(m.group(), 36, 12, key, "mail"), local.lower()) + "@" + domain
    else:
        moved = _long(value.lower(), 16, 12, key, "secret")
        return moved.upper() if re.search("[A-F]", value) else moved
    digit = iter(moved)
    return re.sub("[0-9]", lambda _: next(digit), value)


def test_pseudonyms_are_those_of_a_plain_network(spark):
    rng = np.random.default_rng(11)
    n = lambda k: "".join(rng.choice(list("0123456789"), k))
    values = []
    for _ in range(60):
        head = n(int(rng.integers(12, 19)))
        card = head + next(c for c in "0123456789" if _luhn(head + c))
        values += [("card", card), ("phone", f"+{rng.choice([1, 7, 20, 44, 49, 86, 212, 353, 420, 999])} ({n(3)}) {n(3)}-{n(4)}"), ("ssn", f"{rng.integers(1, 666):03d}-{rng.integers(1, 100):02d}-{rng.integers(1, 9999):04d}"), ("ipv4", ".".join(str(x) for x in rng.integers(0, 256, 4)))]
        values += [("date", f"{rng.integers(1900, 2100)}/{rng.integers(1, 13):02d}/{rng.integers(1, 29):02d}"), ("email", "".join(rng.choice(list("abXZ09._+"), int(rng.integers(1, 20)))).strip("._+") + "q@sub.example.org"), ("secret", "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(32, 70)))) + "a")]
    docs = spark.createDataFrame([(k, f"see {v} now") for k, (_, v) in enumerate(values)], "doc_id long, text string")
    for r in feistel.pseudonymise(docs, "key").collect():
        kind, value = values[r["doc_id"]]
        assert [tuple(p) for p in r["pii"]] == [(kind, value, _plain_pseudonym(kind, value, "key"))] and r["text"] == f"see {r['pii'][0]['pseudonym']} now"


def test_short_values_stay_different(spark):
    letters = "0123456789abcdefghijklmnopqrstuvwxyz"
    names = [a for a in letters] + [a + b for a in letters for b in letters]
    docs = spark.createDataFrame([(k, f"{a}@x.org") for k, a in enumerate(names)], "doc_id long, text string")
    assert feistel.pseudonymise(docs, "k").select("text").distinct().count() == len(names)
    ssn = spark.createDataFrame([(k, f"{a:03d}-{b:02d}-{c:04d}") for k, (a, b, c) in enumerate(itertools.product([1, 665, 667, 899], [1, 50, 99], [1, 2, 9999]))], "doc_id long, text string")
    moved = [r["text"] for r in feistel.pseudonymise(ssn, "k").collect()]
    assert len(set(moved)) == 36 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in moved)


def test_what_fails_its_check_is_left_alone(spark, empty):
    text = "9807915762804491 9780306406158 000-12-3456 666-12-3456 901-12-3456 123-00-4567 123-45-0000 2023-02-30 1899-01-01 256.1.1.1 @x.org a@b"
    out = feistel.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert out["text"] == text and out["pii"] == []
    assert feistel.pseudonymise(empty, "k").count() == 0


def test_long_runs_take_linear_time(spark):
    runs = ["1@" + "a." * 100_000 + "com", "1 " + "z" * 5_000_000, "f" * 3_000_000 + "z", "a@" * 1_000_000, "a." * 1_000_000 + "@x.org", "9" * 2_000_000, "0f" * 200_000, "1-" * 1_000_000, "+1 " * 1_000_000, "9 " * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").repartition(4)
    began = time.monotonic()
    assert feistel.pseudonymise(docs, "k").where(F.length("text") > 100_000).count() == len(runs)
    assert time.monotonic() - began < 120


# --- 6: near duplicates ---


def _print(text, width):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_code_is_perfect_and_keys_meet():
    near = simhash.nearest_codeword()
    assert (np.bincount(near, minlength=4096) == 2048).all()
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 23, 300).astype(np.uint64)
    keys = simhash.golay_keys(values, 23)
    assert {(k >= 0).sum() for k in keys} <= {1, 6}
    for a, b in itertools.combinations(range(23), 2):
        other = simhash.golay_keys(values[:20] ^ np.uint64(1 << a | 1 << b), 23)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(keys[:20], other, strict=True))


def test_simhash_links_against_brute_force(spark, odd, empty, monkeypatch):
    rng = np.random.default_rng(3)
    prints, at = [], 0
    for size in (2, 3, 120, 5, 60):
        base = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(size):
            value = base
            for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                value ^= 1 << int(bit)
            prints.append((at, value))
            at += 1
    first = {}
    for k, v in prints:
        first.setdefault(v, k)
    nodes = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for v, k in first.items()], "rep long, print long")
    links = {tuple(sorted((r["src"], r["dst"]))) for r in simhash.close_pairs(nodes).collect()}
    value = {k: v for v, k in first.items()}
    assert all(bin(value[a] ^ value[b]).count("1") <= 2 for a, b in links)
    parent = {k: k for k in value}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def classes(pairs):
        parent.update({k: k for k in value})
        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [root(k) for k in sorted(value)]

    assert classes(links) == classes((a, b) for a, b in itertools.combinations(value, 2) if bin(value[a] ^ value[b]).count("1") <= 2)
    got = simhash.near_classes(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r["fingerprint"] in {f"{_print(t, 3):016x}" for d, t in ODD if d == r["doc_id"]}
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 8)} == {2} and {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert simhash.near_classes(empty).count() == 0


def test_similar_documents_against_brute_force(spark, odd):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows = []
    for g in range(12):
        base = list(rng.choice(words, 120))
        for copy in range(5):
            text = list(base)
            for _ in range(copy):
                text[int(rng.integers(120))] = "x" + str(rng.integers(99))
            rows.append((len(rows), " ".join(text)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(116)} for d, t in rows}
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {d for d in parent if root(d) == d}
    out = simhash.drop_near_duplicates(odd)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} == {None, 1, 2, 3, 4, 5, 6, 8}


def test_many_copies_of_one_original_meet_it(spark):
    rng = np.random.default_rng(12)
    base = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows = []
    for k in range(150):
        text = list(base)
        if k != 77:  # the original is neither first nor last
            for _ in range(4):
                text[int(rng.integers(200))] = "y" + str(rng.integers(10**6))
        rows.append((k, " ".join(text)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in rows]
    near = [len(s & sets[77]) / len(s | sets[77]) for s in sets]
    assert min(near) >= 0.8 and np.mean([len(a & b) / len(a | b) >= 0.8 for a, b in itertools.combinations(sets[:40], 2)]) < 0.1
    assert simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1


# --- 7: token counts ---


def brute_force_classes(texts):
    """The number of classes of texts with a Jaccard similarity of 0.8 or more."""
    sets = [set(simhash.shingle_hashes(simhash.words_of(t), 5)) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    return len({find(i) for i in range(len(sets))})


def test_drift_chain_in_large_buckets_is_one_class(spark):
    # each copy is similar to the one before and the one after only, and all share a passage
    core, stream = [f"c{i}" for i in range(176)], [f"s{i}" for i in range(16 * 400 + 28)]
    texts = [" ".join(core + stream[16 * k : 16 * k + 28]) for k in range(400)]
    assert brute_force_classes(texts) == 1 and brute_force_classes(texts[::2]) == 200
    rows = [((7919 * k) % 400, t) for k, t in enumerate(texts)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_families_that_share_a_passage_keep_one_each(spark):
    core, texts = [f"c{i}" for i in range(176)], []
    for family, members in enumerate([120, *[2] * 60]):
        first = [f"f{family}w{i}" for i in range(12)]
        texts += [" ".join(core + first + [f"f{family}m{m}w{i}" for i in range(16)]) for m in range(members)]
    assert brute_force_classes(texts) == 61
    rows = [((7919 * k) % len(texts), t) for k, t in enumerate(texts)]
    assert simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 61


def test_token_counts_are_the_librarys(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    letters = list("ab'stre lL.,!?09 \n\té中́<|>-")
    more = [(100 + k, "".join(rng.choice(letters, int(rng.integers(0, 40))))) for k in range(300)]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = tokens.token_counts(docs, path)
    assert sorted(got.columns) == sorted(docs.columns)
    want = Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in [*ODD, *more])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    assert tokens.token_counts(empty, path).count() == 0


def test_proven_characters_are_classed_as_the_library_does():
    import regex

    pattern, library = regex.compile(tokens.PATTERN), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    proven = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not regex.match(tokens.UNPROVEN, chr(c))]
    for at in range(0, len(proven), 4000):
        text = "".join(f"a{c}1{c} {c}!{c}\n" for c in proven[at : at + 4000])
        assert [m.span() for m in pattern.finditer(text)] == [o for _, o in library.pre_tokenizer.pre_tokenize_str(text)]


# --- 8: suffix tree ---


def test_suffix_tree_scores(spark, odd, empty):
    scored = {(r["doc_id"], r["n_tokens"]): r for r in pst.score(odd, F.coalesce(F.col("doc_id") != 1, F.lit(False))).collect()}
    words = {d: (t or "").encode().lower().split() + [b"\n"] for d, t in ODD}
    counts = Counter()
    for d, t in ODD:
        if d not in (1, None):
            counts.update((t or "").encode().lower().split() + [b"\n"])
    total, kinds = sum(counts.values()), len(counts)
    for (d, n), r in scored.items():
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in words[d])
        assert n == len(words[d]) and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["n_known"] == sum(w in counts for w in words[d]) and r["train_tokens"] == total
        assert np.isfinite(r["score"]) and r["score"] < 0
    assert pst.score(empty, F.lit(True)).count() == 0
    untrained = pst.score(odd, F.lit(False)).where("doc_id = 3").first()
    assert untrained["base_score"] == 0 and abs(untrained["score"] + np.log10(256)) < 1e-9


def test_suffix_tree_distributions_sum_to_one(spark):
    docs = spark.createDataFrame([(k, "the cat sat on the mat " * 20 + "dog" * (k % 3)) for k in range(60)], "doc_id long, text string")
    rows = pst.count_strings(docs, F.lit(True), 4).toPandas()
    gram, n = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs, ((gram >> np.uint64(32)).astype(int), (gram & np.uint64(255)).astype(int)), n)
    tree = pst.build(*pst.listed(gram, n, pairs, 4, 2), 4, 1.0)
    assert any(len(c) for c in tree.contexts[2:])
    for context in (b"cat ", b"he m", b"zzzz", b"\n\n\n\n"):
        key = 0
        for byte in reversed(context):
            key = key << 8 | byte
        p = 10 ** tree.log10(np.array([key << 8 | s for s in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-9
    assert 10 ** tree.log10(np.array([int.from_bytes(b" tac"[::1], "big") << 8 | ord("s")], np.uint64))[0] > 0.5


def _plain_tree(spelt, depth, least, divergence):
    """Contexts, escapes and shares by a plain walk over all contexts, and the log10 score of a text."""
    counts = {}
    for s in spelt:
        full = b"\n" * depth + s + b"\n"
        for i in range(depth, len(full)):
            for k in range(depth + 1):
                counts.setdefault(full[i - k : i], Counter())[full[i]] += 1
    root = np.full(256, 0.5)
    for s, n in counts[b""].items():
        root[s] += n if n >= least else 0
    root /= root.sum()
    kept = {}

    def p(context, symbol):
        out = root[symbol]
        for k in range(1, len(context) + 1):
            if context[-k:] not in kept:
                break
            shares, escape = kept[context[-k:]]
            out = shares.get(symbol, 0.0) + escape * out
        return out

    for k in range(1, depth + 1):
        new = {}
        for context, own in counts.items():
            if len(context) != k or (k > 1 and context[1:] not in kept) or sum(own.values()) < least:
                continue
            total, listed = sum(own.values()), {s: n for s, n in own.items() if n >= least}
            before = {s: p(context[1:], s) for s in listed}
            gain = sum(n * np.log(n / total / before[s]) for s, n in listed.items())
            rest = total - sum(listed.values())
            if rest:
                gain += rest * np.log(rest / total / max(1 - sum(before.values()), 1e-12))
            if listed and gain >= divergence:
                room = total + len(own)
                new[context] = {s: n / room for s, n in listed.items()}, (rest + len(own)) / room
        kept |= new
    return lambda s: sum(np.log10(p((b"\n" * depth + s)[i : i + depth], (s + b"\n")[i])) for i in range(len(s) + 1))


def test_suffix_tree_scores_are_those_of_a_plain_tree(spark):
    rng = np.random.default_rng(47)
    words = ["the", "then", "cat", "cats", "sat", "mat", "é", "on"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 30)))) for _ in range(60)] + ["", "zzz the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trains = F.col("doc_id") % 3 != 0
    got = {r["doc_id"]: r["score"] for r in pst.score(docs, trains, depth=4, least=2, divergence=3.0).collect()}
    joined = {r["doc_id"]: r["score"] for r in pst.score(docs, trains, depth=4, least=2, divergence=3.0, common=3, common_strings=20).collect()}
    plain = _plain_tree([t.encode() for k, t in enumerate(texts) if k % 3], 4, 2, 3.0)
    for k, t in enumerate(texts):
        assert abs(got[k] - plain(" ".join(t.split()).encode())) < 1e-6 * max(1, abs(got[k])), t
        assert abs(got[k] - joined[k]) < 1e-6 * max(1, abs(got[k])), t


def test_suffix_tree_pieces_hold_whole_subtrees():
    gram = np.sort(np.random.default_rng(3).integers(0, 1 << 18, 5000)) << 14
    batches = [pa.record_batch({"gram": gram[k : k + 100]}) for k in range(0, 5000, 100)]
    pieces = [p.column("gram").to_numpy() for p in pst.whole_subtrees(iter(batches), 3, rows=700)]
    assert len(pieces) > 3 and np.array_equal(np.concatenate(pieces), gram)
    owners = [set(p >> 16) for p in pieces]
    assert not any(a & b for a, b in zip(owners, owners[1:]))


# --- 9: decontamination ---


def _brute_hits(text, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcé9"), 2)) for _ in range(40)]
    items = [(k, " ".join(rng.choice(vocabulary, int(rng.integers(0, 25))))) for k in range(30)] + [(90, None), (91, "Solo"), (92, "two, Words!")]
    rows = [(k, ". ".join([*rng.choice(vocabulary, 15), items[k % 30][1] or "", *rng.choice(vocabulary, 8), "two words" if k % 5 == 0 else "solo" if k % 7 == 0 else ""])) for k in range(80)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {d: _brute_hits(t, items) for d, t in rows}
    for words in (2_000_000, 100):  # in one block, and in several
        got = {r["doc_id"]: (r["n_words"], r["hit_words"], sorted(r["item_ids"])) for r in decontam.find_matches(docs, benchmark, block_words=words).collect()}
        assert got == want
    clean = decontam.decontaminate(odd.withColumn("n_words", F.lit(0)), spark.createDataFrame([(1, "same text")], "item_id long, text string"))
    assert sorted((r["doc_id"] or 0) for r in clean.collect()) == [0, 1, 2, 3, 4, 5, 8] and clean.columns[-1] == "n_words"
    assert decontam.decontaminate(odd, benchmark.limit(0)).count() == len(ODD) and decontam.find_matches(empty, benchmark).count() == 0


def test_items_without_an_id_count_hits(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, "ff"), (3, "aa bb xx")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "bb cc dd"), (7, "cc dd ee"), (None, "xx"), (None, None)], "item_id long, text string")
    for words in (2_000_000, 3):  # in one block, and in several
        got = {r["doc_id"]: r for r in decontam.find_matches(docs, benchmark, 3, block_words=words).collect()}
        assert {d: (r["hit_words"], r["item_ids"]) for d, r in got.items()} == {1: (4, ["7"]), 2: (0, []), 3: (1, [])}
        assert [tuple(m) for m in got[1]["matches"]] == [("7", 2, 0, 3)] and got[3]["matches"] == []
    assert [r["doc_id"] for r in decontam.decontaminate(docs, benchmark, 3).collect()] == [2]


def _brute_matches(text, items, width):
    """For each item and place in it where a match begins that can't begin earlier: the longest in the text, the first of these."""
    words, best = text.split(), {}
    for item, t in items:
        w = t.split()
        n = min(width, len(w))
        for i, j in itertools.product(range(len(w)), range(len(words))):
            if i and j and w[i - 1] == words[j - 1]:
                continue
            k = 0
            while i + k < len(w) and j + k < len(words) and w[i + k] == words[j + k]:
                k += 1
            if n and k >= n and item is not None:
                best[item, i] = min(best.get((item, i), (0, 0)), (-k, j))
    return sorted((str(item), j, i, -k) for (item, i), (k, j) in best.items())


def test_longest_matches_against_brute_force(spark):
    rng = np.random.default_rng(29)
    item = [f"q{i}" for i in range(30)]
    items = [(0, " ".join(item)), (1, "aa bb aa bb aa bb aa bb"), (2, "cc"), (3, " ".join(item[5:20])), (None, "dd ee ff"), (4, "aa " * 9), (None, None)]
    texts = [" ".join(item[:10] + item[20:]), " ".join(item[:10] + ["xx"] + item[20:] + item[3:17] + item[3:18]), "aa bb " * 9, "aa aa aa bb aa bb", "zz cc dd ee ff cc", "", " ".join(item * 2), "aa " * 30]
    vocabulary = ["aa", "bb", "cc", "q5", "q6", "q7", "q8", "zz"]
    texts += [" ".join(rng.choice(vocabulary, int(rng.integers(1, 40)))) for _ in range(60)]
    docs, benchmark = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 12):
        for r in decontam.find_matches(docs.withColumn("n_words", F.lit(1)), benchmark, 4, block_words=block).collect():
            want = _brute_matches(r["text"], [(d, t) for d, t in items if t], 4)
            assert sorted((m["item_id"], m["start"], m["item_start"], m["length"]) for m in r["matches"]) == want
            assert (r["n_words"], r["hit_words"], sorted(r["item_ids"])) == _brute_hits(r["text"], [(d, t) for d, t in items if d is not None and t], 4)[:1] + (_brute_hits(r["text"], items, 4)[1], sorted({str(m[0]) for m in want}))


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(31)
    for n, kinds in ((1, 1), (50, 2), (200, 3), (300, 1), (400, 90)):
        codes = rng.integers(1, kinds + 1, n)
        plain = sorted(range(n), key=lambda i: codes[i:].tolist())
        assert decontam.suffix_array(codes, n + 1).tolist() == plain


# --- 10: packing ---


def _padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(9)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, int(rng.integers(1, 9)), replace=False))
        counts = rng.integers(1, 50, len(lengths))
        for k in (1, 2, 3, 5):
            best = min(_padding(lengths, counts, [*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
            bounds = packing.best_bounds(lengths, counts, k)
            assert len(bounds) <= k and _padding(lengths, counts, bounds) == best


def _plain_bounds(lengths, counts, buckets):
    """The least padding by the plain quadratic recurrence."""
    h = len(lengths)
    price = lambda i, j: sum(int(n) * int(lengths[j - 1] - x) for x, n in zip(lengths[i:j], counts[i:j], strict=True))
    cost = [0] + [price(0, j) for j in range(1, h + 1)]
    for _ in range(1, buckets):
        cost = [0] + [min([cost[j]] + [cost[i] + price(i, j) for i in range(1, j)]) for j in range(1, h + 1)]
    return cost[h]


def test_bounds_are_optimal_over_long_lengths():
    rng = np.random.default_rng(19)
    for h in (1, 2, 31, 32, 33, 40):
        lengths = np.sort(rng.choice(2_000_000, h, replace=False))
        counts = rng.integers(1, 1000, h)
        for k in (1, 2, 4, 7):
            bounds = packing.best_bounds(lengths, counts, k)
            assert len(bounds) <= k and _padding(lengths, counts, bounds) == _plain_bounds(lengths, counts, k)
    many = np.unique(rng.integers(1, 10**7, 200_000))
    bounds = packing.best_bounds(many, rng.integers(1, 9, len(many)), 16)
    assert len(bounds) == 16 and bounds[-1] == many[-1]


def test_token_lengths_are_what_is_written(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter((d, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in ODD)
    assert Counter(tuple(r) for r in ans.token_lengths(odd, path, 2).collect()) == want
    assert ans.token_lengths(empty, path).count() == 0


def test_batches_match_plain_packing(spark):
    rng = np.random.default_rng(23)
    lengths = [int(x) for x in rng.choice([1, 5, 9, 300, 9000, 9001, 40_000], 400)]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    rows = packing.pack(docs, F.col("n"), buckets=3, budget=20_000).collect()
    kinds, counts = np.unique(lengths, return_counts=True)
    assert sum(r["padding"] for r in rows) == _plain_bounds(kinds, counts, 3)
    bounds = sorted({r["bound"] for r in rows})
    for r in rows:
        assert r["length"] == lengths[r["doc_id"]] and r["bound"] == min(b for b in bounds if b >= r["length"]) and r["bucket"] == bounds.index(r["bound"])
    sizes = Counter((r["bucket"], r["batch"]) for r in rows)
    for b, bound in enumerate(bounds):
        own, most = [n for (k, _), n in sizes.items() if k == b], max(1, 20_000 // bound)
        assert len(own) == -(-sum(own) // most) and max(own) <= most


def test_batches_hold_every_row_within_budget(spark, odd, empty):
    docs = odd.unionByName(spark.range(100, 600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text")), allowMissingColumns=True)
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ ]+"))
    rows = packing.pack(docs, words, buckets=4, budget=128).collect()
    assert len(rows) == docs.count()
    sizes, places = Counter((r["bucket"], r["batch"]) for r in rows), Counter((r["bucket"], r["batch"], r["slot"]) for r in rows)
    assert max(places.values()) == 1 and all(r["padding"] >= 0 for r in rows)
    for r in rows:
        assert sizes[r["bucket"], r["batch"]] * r["bound"] <= 128 or sizes[r["bucket"], r["batch"]] == 1 or r["bound"] == 0
    full = Counter(b for b, _ in sizes)
    for bucket, batches in full.items():
        assert sorted(b for k, b in sizes if k == bucket) == list(range(batches))
    assert packing.pack(empty, F.length("text")).count() == 0


def test_crc_rule_of_held_out_rows(spark):
    from chronolith.llm.common import held_out

    got = {r[0]: r[1] for r in spark.range(200).select("id", held_out("id", 1)).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in range(200)}
