"""Operators 11 to 13 against plain versions, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from brute import WORD, sha

from ledgerscan.llm import edit_embedding, fill_in_middle, prefix_trie, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", " ", "\n \t", "a", " lead and trail \r\n", "é Σ İ 你好 🙂 \x85 \xa0x", "has <P> inside", "<S>", "<M", "<", "P>", "<<P", "one\x0btwo\x0cthree", "x" * 70_000 + " y" * 30_000]


def pseudo_texts(seed, count):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(["le ", "aün\n", "S>", "<", "wort ", "  ", "🙂"]) for _ in range(rnd.randint(0, 60))) for _ in range(count)]


# -- 12 ----------------------------------------------------------------------------------------------


def cut(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def test_fill_in_middle_equals_slices(spark):
    rows = [*enumerate([*ODD, None, *pseudo_texts(1, 120)]), *((900 + k, ODD[4]) for k in range(30)), (None, "a b c"), (None, "a b c"), (3, "a")]
    df = spark.createDataFrame([(i, t, "mine", 1) for i, t in rows], "doc_id long, text string, output string, other int")
    found = fill_in_middle.restore(fill_in_middle.fill_in_middle(df))
    assert found.columns == ["doc_id", "text", "other", *fill_in_middle.RESULTS, "restored"]
    got = [tuple(r) for r in found.select("doc_id", *fill_in_middle.RESULTS, "restored").collect()]
    assert sorted(got, key=str) == sorted((cut(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle.restore(fill_in_middle.fill_in_middle(empty)).collect() == []


def test_rotations_in_place(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "STEP", 3)
    for n in range(12):
        for low in range(n + 1):
            for at in range(low, n + 1):
                buffer = bytearray(range(n))
                fill_in_middle.rotate(buffer, low, at, n)
                assert list(buffer) == [*range(low), *range(at, n), *range(low, at)]


# -- 11 ----------------------------------------------------------------------------------------------


def mix(x):
    full = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
    return x ^ (x >> 31)


def stepwise(text):
    """The fingerprint by walking step by step and looking at every output."""
    full, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15
    go = edit_embedding.moves()
    codes = [ord(c) for c in text]

    def gram(k):
        value = 0
        for c in codes[k : k + edit_embedding.GRAM]:
            value = (value * 0x100000001B3 + c + 1) & full
        return mix(value * odd & full) | 1

    best = {}
    anchor, step = 1, 0
    for k, c in enumerate(codes):
        if k and k + edit_embedding.GRAM <= len(codes) and gram(k) < (1 << 64) // edit_embedding.STRETCH:
            anchor, step = gram(k), 0
        h = mix((mix((anchor + step * odd) & full) + c * odd) & full)
        part = h // ((1 << 64) // edit_embedding.SAMPLES)
        best[part] = min(best.get(part, h), h)
        kind = (c * 2654435761 & 0xFFFFFFFF) >> 24
        while not go[kind, step % edit_embedding.PERIOD]:  # the pointer stays on the character
            step += 1
        step += 1
    return "".join(f"{1 + best[p] % 255 if p in best else 0:02x}" for p in range(edit_embedding.SAMPLES))


def share(a, b):
    a, b = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (a, b))
    return edit_embedding.likeness(a, b)


@pytest.mark.parametrize("pack", [1 << 20, 50])
def test_fingerprints_equal_stepwise_walks(spark, monkeypatch, pack):
    monkeypatch.setattr(edit_embedding, "PACK_CHARS", pack)
    monkeypatch.setattr(edit_embedding, "KEYS", 1)
    sample = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).select("text").collect()]
    texts = [*ODD, None, *pseudo_texts(2, 40), *sample, ODD[4]]
    rows = [(7 * k % 1000 - 20, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in edit_embedding.edited_fingerprints(df).collect()}
    order = sorted(rows)
    assert sorted(got) == [i for i, _ in order]
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after, r = text or "", after or "", got[i]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert (r.fingerprint, r.edited_fingerprint) == (stepwise(text), stepwise(edited))
        assert r.near_edited == share(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == share(r.fingerprint, stepwise(after))


def test_fingerprints_of_ties_nulls_and_few_rows(spark):
    schema = "doc_id long, text string"
    assert edit_embedding.edited_fingerprints(spark.createDataFrame([], schema)).collect() == []
    lone = edit_embedding.edited_fingerprints(spark.createDataFrame([(5, "abcd")], schema)).collect()
    assert [(r.doc_id, r.edited, r.near_next) for r in lone] == [(5, "abab", 1.0)]
    rows = [(1, "same")] * 30 + [(1, "other")] + [(None, None)] * 4 + [(None, "x y")] + [(2, "")] * 3
    found = edit_embedding.edited_fingerprints(spark.createDataFrame(rows, schema))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in found.collect()) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    classes = edit_embedding.near_copies(found).collect()
    assert len(classes) == len(rows)
    assert {(r.n_chars, r.class_id) for r in classes} == {(4, 1), (5, 1), (0, 2), (3, None)}


def test_likeness_follows_edits(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(400)) for _ in range(4)]
    rows = []
    for k, text in enumerate(base):
        rows.append((10 * k, text))
        for copy in range(1, 6):
            w = text.split()
            for _ in range(6):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((10 * k + copy, " ".join(w)))
    prints = edit_embedding.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = {r.doc_id: r.class_id for r in edit_embedding.near_copies(prints).collect()}
    assert classes == {i: i - i % 10 for i, _ in rows}
    half = [r.near_edited for r in prints.collect() if r.doc_id % 10 == 5]  # the next one is another text
    assert all(0.35 < x < 0.65 for x in half)


# -- 13 ----------------------------------------------------------------------------------------------


def trie(rows):
    lists = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = sha(f"{len(role)}:{role}{text}")[:32] + f"{len(WORD.findall(text)):08x}"
            lists.setdefault(c, []).append((t is not None, t or 0, digest, role, text))
    lists = {c: [x[3:] for x in sorted(turns)] for c, turns in lists.items()}
    built = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = [*lists.get(c - c % 20, [])[:h], *own[h:]]
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(m for m in members if len(built[m]) == len(path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved, sha(ends)))
    return sorted(out, key=str)


def chats(seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-40, 130), 60):
        for t in range(rnd.choice([1, 2, 3, 5, 8, 9])):
            turn = rnd.choice([t, t, t, t - 1, None])
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "a  b c\n", "", None, "é"])))
    rows += [(200 + k, t, "user", f"turn {t % 3}") for k in range(8) for t in range(33 - k)]
    return rows + rows[:5] + [(None, 0, "user", "lost")]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = chats(seed)
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, low int").repartition(4)
    assert sorted((tuple(r) for r in prefix_trie.conversation_trie(df).collect()), key=str) == trie(rows)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    for rows in ([], [(None, 1, "user", "x")], [(0, 0, None, None)], [(1, None, "u", "x " * 50_000)], [(7, 0, "u", "gone")], [(k, 0, "u", "same words") for k in range(50)]):
        found = prefix_trie.conversation_trie(spark.createDataFrame(rows, schema)).collect()
        assert sorted((tuple(r) for r in found), key=str) == trie(rows)


def test_ids_that_end_at_a_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    rows = [(20 * k, 0, "u", "same") for k in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in prefix_trie.conversation_trie(df).collect()), key=str) == trie(rows)


@pytest.mark.parametrize("least, block", [(0.8, 1 << 14), (0.8, 7), (0.6, 1 << 14)])
def test_near_copies_link_all_pairs_of_the_likeness(spark, monkeypatch, least, block):
    """Fingerprints around the threshold, short ones with empty samples too, against all pairs."""
    monkeypatch.setattr(edit_embedding, "BLOCK", block)
    rng = np.random.default_rng(5)
    made = []
    for _ in range(40):
        taken = rng.choice([0, 1, 2, 5, 20, 90, 128])
        base = np.zeros(128, np.uint8)
        base[rng.permutation(128)[:taken]] = rng.integers(1, 256, taken)
        for _ in range(8):
            other = base.copy()
            places = np.flatnonzero(base)[rng.permutation(taken)[: int(taken * rng.uniform(0.1, 0.3))]]
            other[places] = rng.integers(0 if taken < 100 else 1, 256, len(places))
            made.append(other)
    parent = [*range(len(made))]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(made)):
        for b in range(a):
            if edit_embedding.likeness(made[a], made[b]) >= least and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    prints = spark.createDataFrame([(i, p.tobytes().hex()) for i, p in enumerate(made)], "doc_id long, fingerprint string")
    found = {r.doc_id: r.class_id for r in edit_embedding.near_copies(prints, least).collect()}
    assert found == {i: find(i) for i in range(len(made))}


def test_fingerprints_move_as_bytes(spark):
    """The query shuffles bytes, not their digits, and joins entries where they lie; its rows are those of both operators."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = queries.QUERIES["op11_edit_fingerprints"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"lower(hex({c}#" in plan.split("Join")[0] for c in edit_embedding.DIGITS)
    prints = edit_embedding.edited_fingerprints(docs)
    edited = {r.doc_id: r for r in prints.collect()}
    classes = {r.doc_id: r for r in edit_embedding.near_copies(prints.drop("edited")).collect()}
    rows = found.collect()
    assert len(rows) == len(edited) == len(classes) == docs.count()
    for r in rows:
        e, c = edited[r.doc_id], classes[r.doc_id]
        assert r.edited_sha256 == hashlib.sha256(e.edited.encode()).hexdigest()
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (e.n_chars, e.fingerprint, e.edited_fingerprint, e.near_edited, e.near_next)
        assert (r.fingerprint, r.class_id) == (c.fingerprint, c.class_id)
