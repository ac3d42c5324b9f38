"""Vectors, tries and manifests against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import common, merkle, queries, trie, vectors


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- shared helpers ---


def test_numbers_in_groups_and_scans_in_stretches(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(v)) for k, v in zip(np.where(rng.random(3000) < 0.6, 1, rng.integers(0, 40, 3000)), rng.integers(-9, 9, 3000), strict=True)]
    rows = [(k, i, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    numbered = common.number_in_groups(df, ["k"], ["i"], "t")
    got = {(r["k"], r["i"]): r["pos"] for r in numbered.collect()}
    want, runs = {}, {}
    for k, i, v in rows:
        seen = runs.setdefault(k, [])
        want[k, i] = len(seen)
        seen.append(v)
    assert got == want
    for down in (False, True):
        run = common.scanned(numbered, "k", "pos", {"s": "v"}, F.sum, lambda a, b: a + b, down, width=16)
        for r in run.collect():
            own = runs[r["k"]]
            assert r["s"] == (sum(own[r["pos"] :]) if down else sum(own[: r["pos"] + 1]))


def test_look_up_of_hot_keys_gives_every_row_once(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, i long")
    table = spark.createDataFrame([(i, str(i)) for i in range(0, 3000, 2)] + [(1, "one")], "k long, name string")
    got = {r["i"]: (r["k"], r["name"]) for r in common.look_up(rows, table, ["k"], most=100).collect()}
    assert len(got) == 3001 and got[-1] == (None, None)
    assert all(got[i] == ((1, "one") if i % 3 else (i, None if i % 2 and i != 1 else str(i))) for i in range(3000))


# --- 11: vectors ---


def _brute_vectors(rows, threshold):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = np.zeros((n, n), bool)
    for i, (_, a, x) in enumerate(rows):
        for j, (_, b, y) in enumerate(rows):
            if i != j and x is not None and x == y and usable(a) and usable(b) and len(a) == len(b):
                p, q = np.array(a, float) / max(map(abs, a)), np.array(b, float) / max(map(abs, b))
                links[i, j] = p @ q / np.sqrt((p @ p) * (q @ q)) >= threshold
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in np.flatnonzero(links[i]):
                root[i] = root[j] = min(root[i], root[j])
    ids = [min((rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(n)]
    return sorted(((rows[i][0] is None, rows[i][0] or 0), int(links[i].sum()), ids[i] is None, ids[i] or 0, rows[i][0] == ids[i]) for i in range(n))


def _vector_rows():
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for label in (1, 2):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 9))):
                v = (centre + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])).astype(np.float32).tolist()
                rows += [(at, v, label)] * int(rng.integers(1, 3))
                at += 1
    v = rows[0][1]
    rows += [(900, v, 1), (901, v, None), (902, None, 1), (903, [0.0] * 16, 1), (904, [float("nan")] * 16, 1), (905, [*v[:15], float("inf")], 1), (906, [*v[:15], None], 1)]
    rows += [(907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (909, [1e38] * 16, 2), (910, [2e-38] * 16, 2), (911, [], 2), (None, v, 1), (None, None, None), (None, [7.0] * 3, 5), (None, [8.0] * 3, 5)]
    return rows


def test_near_vectors_against_brute_force(spark, monkeypatch):
    rows = _vector_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, keys string, node int")
    want = _brute_vectors(rows, 0.98)
    for block in (512, 4):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = vectors.near_vectors(df, recall=1 - 1e-9, at_once=16).collect()
        assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["n_links"], r["component_id"] is None, r["component_id"] or 0, r["kept"]) for r in got) == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_large_buckets_in_pairs_of_blocks(spark, monkeypatch):
    # a third of all rows in one group, too large for a block, with its bucket looked up by a shuffle as well
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(24)
    group = centre + rng.standard_normal((120, 24)) * 0.07
    rest = rng.standard_normal((240, 24))
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(np.concatenate([group, rest]))]
    want = _brute_vectors(rows, 0.98)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(vectors, "BLOCK", 16)
    for few in (100_000, 0):
        got = vectors.near_vectors(df, recall=1 - 1e-9, at_once=20, few=few).collect()
        assert sorted(((False, r["vec_id"]), r["n_links"], False, r["component_id"], r["kept"]) for r in got) == want
    assert sum(w[1] for w in want) > 2000


def test_recall_at_the_threshold_holds_at_every_size():
    rng = np.random.default_rng(2)
    for nodes in (10, 10_000, 10**9):
        shape = vectors.plan(nodes, 0.98, 0.999)
        a = rng.standard_normal((4000, 32))
        side = rng.standard_normal((4000, 32))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        side -= (side * a).sum(axis=1, keepdims=True) * a
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
        met = (vectors.keys_of(a, shape) == vectors.keys_of(b, shape)).any(axis=1).mean()
        assert met > 0.99, (nodes, shape, met)


# --- 12: prefix trie ---


def _brute_trie(convs):
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = {}
    for seq, members in nodes.items():
        under = [s for s in nodes if s[: len(seq)] == seq]
        children = sum(len(s) == len(seq) + 1 for s in under)
        leaves = sum(not any(t[: len(s)] == s and len(t) == len(s) + 1 for t in under) for s in under)
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in under if s)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(seq))
        out[min(members), len(seq)] = (min(nodes[seq[:-1]]) if seq else None, len(members), children, leaves, saved, _sha(ends))
    return out


def _got_trie(df):
    rows = df.collect()
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(got) == len(rows)
    return got


TURNS = "conv_id long, turn long, role string, text string"


def _ordered(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    return {c: [t[2] for t in sorted(v)] for c, v in own.items()}


def _conversations():
    rng = np.random.default_rng(7)
    rows = []
    for c in [*range(0, 130), 250, 305, -3]:
        for turn in range(int(rng.integers(1, 7))):
            rows.append((c, turn, "user" if turn % 2 == 0 else "model", str(rng.integers(0, 2)) * int(rng.integers(1, 3))))
    rows += [(131, None, None, None), (131, None, None, None), (131, 2, "user", "é" * 3), (132, 0, "", ""), (None, 0, "user", "lost"), (133, 5, "user", "a" * 100_000), (133, 5, "user", "b")]
    # one long conversation and one that branches from it late, and one that is a prefix of another
    rows += [(400, t, "user", str(t % 5)) for t in range(60)] + [(401, t, "user", str(t % 5)) for t in range(40)] + [(402, t, "user", str(t % 5) if t < 50 else "z") for t in range(55)]
    return rows


def test_trie_against_brute_force(spark, monkeypatch):
    rows = _conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", depth int, owner string")
    want = _brute_trie(_ordered(rows))
    assert _got_trie(trie.prefix_trie(df)) == want
    # hashes of members in several pieces, and long chains in several stretches
    monkeypatch.setattr(trie, "PIECE", 2)
    assert _got_trie(trie.prefix_trie(df)) == want
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_trie_of_nested_chains(spark):
    # each conversation leaves the one before it a turn later: nine chains deep
    rows = [(c, t, "user", "same" if t < c else f"own {c}") for c in range(9) for t in range(c + 2)]
    rows += [(50, t, "user", "same") for t in range(12)] + [(51, 0, "user", "same")]
    rows += [(1000 + c, t, "r", f"{min(c, 40 - t)}") for c in range(40) for t in range(8)]
    assert _got_trie(trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == _brute_trie(_ordered(rows))


def test_rebuilt_trie_by_the_contract(spark, tmp_path):
    rows = _conversations()
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    own, rebuilt = _ordered(rows), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        model = own.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])
        rebuilt[c] = model[:h] + own[c][h:]
    assert any(not v for v in rebuilt.values())
    assert _got_trie(queries.op12_prefix_trie(spark, str(tmp_path))) == _brute_trie(rebuilt)


# --- 13: Merkle manifest ---


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes):
    """Root and, for each leaf, its siblings as (left, right) by level."""
    place, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, at in enumerate(place):
            run = at - at % 3
            paths[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
            place[k] = at // 3
        nodes = [_sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def _brute_manifest(rows):
    def leaf(r, text):
        return _sha("".join(_field(v) for v in (r[0], r[3], r[2], r[4], text)))

    groups = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].replace("\n", "")) if hit else leaf(r, r[1]), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        groups[name].sort()
        built[name] = _tree([g[2] for g in groups[name]])
    root, tops = _tree([built[n][0] for n in names])
    out = []
    for place, name in enumerate(names):
        subroot, paths = built[name]
        for g, path in zip(groups[name], paths, strict=True):
            path, node = path + tops[place], g[3]
            for left, right in path:
                node = _sha(left + node + right)
            out.append((g[4] is not None, g[4] or 0, g[2], subroot, root, _sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_against_brute_force(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rng = np.random.default_rng(levels)
    rows = [(i, f"text {i}\n" * int(rng.integers(0, 3)), "en", "hot" if i % 3 else f"s{i % 11}", i) for i in range(400)]
    rows += [(1000, None, None, None, None), (1001, "", "", "", 0), (1001, "", "", "", 0), (None, "\n", "fr", "hot", 1), (None, "x\ny", "fr", None, 3), (1002, "é\n" * 50_000, "ü", "Z", 1), (1003, "one", "en", "alone", 3)]
    rows += [(2000 + i, "a\nb", "en", "full", 3) for i in range(27)] + [(3000 + i, "a\nb", "en", "fuller", 3) for i in range(28)]
    spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", pos int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    columns = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *[r[c] for c in columns]) for r in got) == _brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    for name, rows in (("one", [(7, "only\n", "en", "s", 5)]), ("none", [])):
        spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = queries.op13_merkle_manifest(spark, str(tmp_path / name)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == _sha("")
