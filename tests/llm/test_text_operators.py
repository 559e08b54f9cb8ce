import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from brute import WORD, components, counts, overlapping, sha, without_lines, without_repeats

from ledgerscan.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules, suffix_dedup, token_files
from ledgerscan.llm.queries import tokenizer_path

ODD = ["", " ", "\n", "a", "  two  spaces \n here ", "don't 's 'LL", "<|endoftext|> x", "é Σ İ ﬁ 你好 🙂", "x\x1cy\x85z\xa0w", "12³ ª ß"]


@pytest.fixture(scope="module")
def sample(spark):
    return [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows, extra=""):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], f"doc_id long, text string, {extra or 'other'} string")


def noisy(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        if out:
            at, kind = rnd.randrange(len(out)), rnd.random()
            if kind < 0.5:
                out[at] = f"new{rnd.randint(0, 3)}"
            elif kind < 0.8:
                del out[at]
            else:
                out.insert(at, "more")
    return " ".join(out)


# -- 1 and 3 -------------------------------------------------------------------------------------


def test_variable_length_coding_round_trip():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7, 300], np.uint32)
    for n in range(len(values) + 1):
        assert token_files.unpack(*token_files.pack(values[:n]), n).tolist() == values[:n].tolist()


def test_token_files_equal_the_library(spark, sample, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 20_000)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 3_000)
    path = tokenizer_path("byte_bpe_50k.json")
    rows = sample[:60] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000, None)]
    folder = token_files.new_folder(spark, "test")
    token_files.write_token_files(frame(spark, rows, "ids"), path, folder, end_id=2)
    library, start, expected = token_files.encoder(path).tokenizer, 0, []
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.token_index(spark, folder).collect()) == expected


def test_new_words_are_encoded_many_at_a_time(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, coder, rnd = Tokenizer.from_file(path), token_files.Encoder(path), random.Random(3)
    monkeypatch.setattr(token_files, "KNOWN_WORDS", 500)
    monkeypatch.setattr(token_files, "NEW_WORDS", 64, raising=False)
    alone, chunk = [], coder.chunk
    coder.chunk = coder.words.compute = lambda word: alone.append(word) or chunk(word)
    letters = "abcdefghijklmnopqrstuvwxyzABCÀéñß\u017f\u0149ªº"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(1500)]
    ends = ["", "", "", ".", ",", "?!", ".\n", "\n", "|\n", ".\n\n", "'s", "9", " ", "\t", "日", "$\r\n"]
    for most in (3, len(ends)):  # plain words first, then all kinds of ends
        texts = ["", " ", "x", "<|endoftext|> a"] * (most > 3)
        texts += ["".join(rnd.choice(["", " "] if most > 3 else [" "]) + rnd.choice(words) + rnd.choice(ends[:most]) for _ in range(400)) for _ in range(20)]
        texts = texts if most > 3 else [t.strip() for t in texts]  # a space at an end goes another way
        for _ in range(2):  # again, some words known
            ids, bounds = coder.encode_all(pa.array(texts), np.array([2], coder.dtype).tobytes())
            expected = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
            assert ids.tolist() == [i for e in expected for i in e]
            assert bounds.tolist() == np.cumsum([len(e) for e in expected]).tolist()
        if most == 3:
            # ª and º are no letters of the pattern here, so such chunks are encoded alone
            assert not [w for w in alone if "ª" not in w and "º" not in w]
    assert len(coder.known) == 500 and len(coder.ids) == coder.id_counts.sum()
    assert coder.encode_all(pa.array([], pa.string()), b"\2\0")[0].tolist() == []


def test_token_files_of_no_rows_and_null_ids(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    for rows in ([], [(None, "a b"), (None, None), (3, "a b"), (3, "a b")]):
        folder = token_files.new_folder(spark, "test")
        token_files.write_token_files(frame(spark, rows), path, folder, end_id=2)
        found = token_files.token_index(spark, folder).collect()
        assert sorted(r["n_tokens"] for r in found) == sorted(1 + 2 * bool(t) for _, t in rows)


def test_bpe_equals_the_library(spark, sample):
    path = tokenizer_path("word_bpe_49k.json")
    rows = sample[:60] + [(1000 + k, t) for k, t in enumerate([*ODD, "x" * 500 + "ing" * 99])] + [(2000, None)]
    library = bpe.tokenizer(path).library
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in bpe.digests(frame(spark, rows), path).collect()) == sorted(expected)
    clash = bpe.encode_decode(frame(spark, [(1, "a")], "ids"), path)
    assert clash.columns == ["doc_id", "ids", "n_tokens", "decoded"]
    assert bpe.digests(frame(spark, []), path).count() == 0


# -- 2 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1 << 20, 80])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    rnd, rows = random.Random(5), [(9000, None), (9001, ""), (9002, " \t")]
    for size in (1, 2, 3, 5, 11, 12, 21, 22, 32, 41, 60, 150):
        for _ in range(2):
            words = [rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(rnd.randint(0, 40)) for _ in range(size)]
            for _ in range(8):
                rows.append((len(rows), noisy(rnd, words, rnd.choice([0, 0, 1, 1, 2, 3]))))
    for percent, size in ((90, 3), (80, 5)):
        found = jaccard_join.linked_components(frame(spark, rows, "comp"), percent, size).collect()
        assert {r[0]: (r[1], r[2]) for r in found} == components(rows, percent, size)


def test_components_of_copies_and_no_rows(spark):
    same = "one two three four five six"
    found = jaccard_join.linked_components(frame(spark, [(4, same), (2, same), (2, same), (7, "other")]), 90, 3).collect()
    assert sorted(tuple(r) for r in found) == [(2, 4, 2), (2, 4, 2), (4, 4, 2), (7, 1, 7)]
    assert jaccard_join.linked_components(frame(spark, []), 90, 3).count() == 0


def test_texts_of_candidates_move_once(spark, monkeypatch):
    rnd = random.Random(8)
    base = [[f"w{rnd.randint(0, 5000)}" for _ in range(size)] for size in (60, 90, 300)]
    rows = [(len(base) * k + i, noisy(rnd, words, k)) for k in range(3) for i, words in enumerate(base)]
    rows += [(50 + k, "ab " * (3000 + k) + " ".join(base[0][:40]) + "x" * k) for k in range(3)]  # far longer than its shingles
    edges, real = [], jaccard_join.connected_components
    monkeypatch.setattr(jaccard_join, "connected_components", lambda found: edges.append(found) or real(found))
    found = jaccard_join.linked_components(frame(spark, rows, "moved"), 80, 5).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == components(rows, 80, 5)
    plan = edges[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "first(text" not in plan

    # rows that share id and text, or have no id, are told apart by nothing: they are one set, every row stays
    twins = rows + rows[:4]
    found = jaccard_join.linked_components(frame(spark, twins, "twins"), 80, 5).collect()
    assert len(found) == len(twins) and {r[0]: (r[1], r[2]) for r in found} == components(rows, 80, 5)
    nameless = [(None, text) for _, text in rows]
    found = jaccard_join.linked_components(frame(spark, nameless + nameless[:2] + rows, "nameless"), 80, 5).collect()
    assert {r[0]: (r[1], r[2]) for r in found if r[0] is not None} == components(rows, 80, 5)


# -- 4 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("bytes_", [1 << 20, 0])
def test_lines_equal_brute_force(spark, sample, monkeypatch, keep, bytes_):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bytes_)
    rows = sample[:80] + [(1000, None), (1001, ""), (1002, "A\n b\n\n a \nÉ\né"), (1003, "a\na\nB"), (1004, "é\nb")]
    found = line_dedup.line_dedup(frame(spark, rows, "n_lines"), min_docs=2, keep=keep).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in found} == without_lines(rows, 2, keep)


def test_lines_with_a_full_filter(spark, sample, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_BITS", 64)
    monkeypatch.setattr(line_dedup, "MIN_BITS", 64)
    found = line_dedup.line_dedup(frame(spark, sample[:40]), min_docs=3, keep="none").collect()
    assert {r["doc_id"]: r["text"] for r in found} == {i: v[0] for i, v in without_lines(sample[:40], 3).items()}
    assert line_dedup.line_dedup(frame(spark, []), min_docs=3).count() == 0


# -- 5 -------------------------------------------------------------------------------------------


def test_repeats_equal_brute_force(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passages = [text(n) for n in (380, 420, 500, 900, 3000)]
    rows = [(0, None), (1, ""), (2, "a" * 399), (3, "b" * 401), (4, "ab" * 500)]
    for i in range(5, 40):
        tail = rnd.choice(passages)[rnd.randint(0, 100) :] if rnd.random() < 0.5 else ""
        rows.append((i, text(rnd.randint(0, 300)) + rnd.choice(passages) + text(rnd.randint(0, 200)) + tail))
    for i in range(40, 60):
        letters = list(passages[4])
        for _ in range(rnd.randint(0, 3)):
            letters[rnd.randrange(len(letters))] = "#"
        rows.append((i, "".join(letters)))
    rows += [(60, rows[50][1]), (61, rows[50][1])]
    found = suffix_dedup.digests(frame(spark, rows, "key")).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == without_repeats(rows)
    assert suffix_dedup.digests(frame(spark, [])).count() == 0


def test_suffixes_are_sorted():
    data = np.frombuffer(b"banana bandana ban", np.uint8)
    start = np.arange(len(data) - 5)
    order = suffix_dedup.Suffixes(data, np.zeros(len(data), np.int64)).order(start, np.full(len(start), 5), np.zeros(len(start), np.int64))
    assert [bytes(data[k : k + 5]) for k in order] == sorted(bytes(data[k : k + 5]) for k in start)


def test_only_suffixes_with_a_shared_hash_are_sorted(monkeypatch):
    """Classes are those of the strings in a segment; strings that no other one is equal to are not sorted."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    start, length, segment = rng.integers(0, 2900, 500), np.repeat([5, 9, 60], [200, 200, 100]), np.repeat([0, 1, 2, 3], [100, 100, 200, 100])
    start[-1] = start[-2]
    sorted_ = []
    plain = suffix_dedup.Suffixes.order
    monkeypatch.setattr(suffix_dedup.Suffixes, "order", lambda self, a, n, s: sorted_.append(len(a)) or plain(self, a, n, s))
    found = suffix_dedup.Suffixes(data, np.zeros(len(data), np.int64)).classes(start, length, segment)
    strings = [(s, bytes(data[a : a + n])) for a, n, s in zip(start, length, segment, strict=True)]
    times = Counter(strings)
    assert sorted_ == [sum(times[x] > 1 for x in strings)] and 0 < sorted_[0] < 500
    assert len({*zip(found.tolist(), strings, strict=True)}) == len({*found.tolist()}) == len(times)


# -- 8 -------------------------------------------------------------------------------------------


def test_overlaps_tolerate_substitutions(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([12, 15, 20, 30, 60, 5])] + [(9, None), (10, "")]
    rows = [(900, None), (901, ""), (902, " ".join(word() for _ in range(300)))]
    for k, item in items[:5]:
        for changed in range(3):
            words = item.split()
            for p in rnd.sample(range(len(words)), changed * len(words) // 20):
                words[p] = "changed"
            filler = " ".join(word() for _ in range(40))
            rows.append((10 * k + changed, f"{filler}. {', '.join(words).upper()} {filler}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [*rows, rows[3]], "key")
    found = decontaminate.overlaps(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == overlapping(rows, items)
    assert len(found) == len(overlapping(rows, items)) + 1  # an equal row has its own
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [900, 901, 902]
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0


def test_no_pattern_of_substitutions_hides_an_overlap(spark):
    from itertools import combinations

    def left(mask, n, changed):
        return any(all(p + k not in changed for k, bit in enumerate(mask) if bit == "1") for p in range(n - len(mask) + 1))

    for n in range(1, 21):
        changes, mask = n // 5, decontaminate.mask_of(n, 0.8)
        assert all(left(mask, n, c) for c in combinations(range(n), changes))
        for m in decontaminate.MASKS:
            least = decontaminate.least_changes(m, n)
            assert least > 4 or not all(left(m, n, c) for c in combinations(range(n), least))
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (10, 12, 15, 20, 33)]
    rows = []
    for n, item in items:
        for c in [(), *list(combinations(range(min(n, 20)), min(n, 20) // 5))[:: 20]]:
            for before in (2, 3):
                words = [f"x{k}" if k in c else w for k, w in enumerate(item.split()[:20])]
                rows.append((len(rows), " ".join(["pad"] * before + words + ["pad"])))
    found = decontaminate.overlaps(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in found.collect()} == {i for i, _ in rows}


def test_items_of_few_words_are_found(spark):
    items = [(1, "alone"), (3, "one two three"), (5, "a b c d e"), (9, "q w e r t y u i o"), (20, "...")]
    rows = [(0, "all alone"), (1, "x one, two THREE"), (2, "one two 3"), (3, "a b x d e"), (4, "a x c x e"), (5, "q w e r x y u i o"), (6, "one two")]
    found = decontaminate.overlaps(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(0, 1), (1, 3), (3, 5), (5, 9)}


# -- 9 -------------------------------------------------------------------------------------------


def test_counts_equal_brute_force(spark, sample):
    odd = ["a b c a b c", "x " * 60, "a\n\na\n \n\t\na b\na b", "#|<> é\x0bé\x0cé", "1 2 3 4 1 2 3 1 2 3 4", " ".join(map(str, range(60)))]
    rows = sample[:80] + [(1000 + k, t) for k, t in enumerate(odd)] + [(2000, None), (2001, "")]
    trusted = spark.createDataFrame([(i,) for i, _ in sample[:40]], "doc_id long")
    found = quality_rules.quality_rules(frame(spark, rows, "kept"), trusted).collect()
    assert {r["doc_id"]: tuple(r[c] for c in quality_rules.RESULTS[:6]) for r in found} == {i: counts(t) for i, t in rows}
    assert not any(r["kept"] and r["base_failed"] for r in found)
    none = quality_rules.quality_rules(frame(spark, rows), trusted.limit(0)).collect()
    assert {r["llr"] for r in none} == {0.0}
    assert quality_rules.quality_rules(frame(spark, []), trusted).count() == 0


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_rules.quality_rules(docs, labels.filter("quality = 1").select("doc_id")).join(labels, "doc_id")
    wrong = found.filter("not base_failed and kept <> (quality = 1)").count()
    assert wrong <= 0.01 * found.count()


@pytest.mark.parametrize("percent", [80, 90, 55, 30])
def test_jaccard_pieces_and_lists_lose_no_link(percent):
    """Linked sets always share a listed piece, and the forest of a block has the components of all pairs."""
    draw = np.random.default_rng(percent)
    passage = draw.integers(0, 1 << 63, 60).astype(np.uint64)
    classes = jaccard_join.size_classes(percent)
    for _ in range(15):
        sets = []
        for _ in range(10):
            base = np.concatenate([draw.integers(0, 1 << 63, draw.integers(1, 160)).astype(np.uint64), passage[: draw.integers(0, 60)]])
            for _ in range(draw.integers(1, 7)):
                gone = draw.permutation(len(base))[: int(len(base) * (100 - percent) / 100 * draw.random() * 1.3)]
                near = base.copy()
                near[gone] = draw.integers(0, 1 << 63, len(gone)).astype(np.uint64)
                sets.append(np.unique(near))
        signed = [{*np.concatenate(jaccard_join.signatures(s, classes, percent)).tolist()} for s in sets]
        pairs = []
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    pairs.append((a, b))
                    assert signed[a] & signed[b]
        assert groups(len(sets), pairs) == groups(len(sets), jaccard_join.local_links(sets, percent))


def groups(size, links):
    """Smallest member of everyone's component."""
    label = [*range(size)]
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label


def spark_hash(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h


def ratios(rows, good, buckets):
    """{doc_id: llr} by counting the n-grams of all texts one by one."""
    def grams(text):
        w = WORD.findall(text or "")
        out = [(0, spark_hash(x) % buckets) for x in w] + [(1, spark_hash(x[-3:]) % buckets) for x in w]
        return out + [(2, (spark_hash(*w[k : k + 3]) >> 24) % buckets) for k in range(len(w) - 2)]

    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(grams(text))
        if i in good:
            target.update(grams(text))
    size = {(name, k): sum(v for (kind, _), v in c.items() if kind == k) for name, c in (("raw", raw), ("target", target)) for k in range(3)}

    def ratio(g):
        top, bottom = ((c[g] + 1) / (size[name, g[0]] + buckets) for name, c in (("target", target), ("raw", raw)))
        return math.log(top / bottom)

    return {i: sum(map(ratio, grams(t))) / max(1, len(WORD.findall(t or ""))) for i, t in rows}


def test_ratio_equals_brute_force_and_reads_every_letter(spark, sample):
    base = next(t for _, t in sample if t and len(WORD.findall(t)) > 80)
    words = WORD.findall(base)
    probes = [(5001, base), (5002, " ".join("$$$" + w for w in words)), (5003, " ".join(sorted(words)))]
    rows = [*sample[:80], *probes, *((6000 + k, t) for k, t in enumerate(ODD)), (7000, None)]
    good = {i for i, _ in sample[:80] if i % 3 == 0}
    trusted = spark.createDataFrame([(i,) for i in good], "doc_id long")
    found = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows), trusted).collect()}
    expected = ratios(rows, good, quality_rules.BUCKETS)
    for i, _ in rows:
        assert found[i].llr == pytest.approx(expected[i], abs=1e-4)
        assert found[i].kept == (not found[i].base_failed and found[i].llr >= quality_rules.THRESHOLD)
    assert len({round(found[i].llr, 3) for i in (5001, 5002, 5003)}) == 3


def test_candidate_clusters_hold_sets_of_like_sizes_only(spark, monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    sizes = [int(100 * 1.1**k) for k in range(35)]
    clusters, real = [], jaccard_join.connected_components
    monkeypatch.setattr(jaccard_join, "connected_components", lambda edges: clusters.append(real(edges)) or clusters[-1])
    found = jaccard_join.linked_components(frame(spark, [(k, " ".join(words[:n])) for k, n in enumerate(sizes)]), 80, 5).collect()
    assert {r.component_id for r in found} == {0} and len(found) == 35  # each is linked with the next, so all hang together
    members = [r["count"] for r in clusters[0].groupBy("comp").count().collect()]
    # sizes of a cluster differ by two classes at most, not by a factor of 25
    assert len(members) >= 10 and max(members) <= 6, members


def test_chance_pieces_make_no_clusters(spark, monkeypatch):
    """Long texts of few words share many shingles and so whole pieces; only those that can be linked are clustered."""
    rnd = random.Random(21)
    rows = [(k, " ".join(rnd.choice("abcdef") for _ in range(3000))) for k in range(40)]
    rows += [(100 + k, noisy(rnd, rows[k][1].split(), 30)) for k in range(3)]
    clusters, real = [], jaccard_join.connected_components
    monkeypatch.setattr(jaccard_join, "connected_components", lambda edges: clusters.append(real(edges)) or clusters[-1])
    found = jaccard_join.linked_components(frame(spark, rows), 80, 5).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == components(rows, 80, 5)
    assert max(r["count"] for r in clusters[0].groupBy("comp").count().collect()) <= 4


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_allow_every_link(percent):
    rnd = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 5, 30, 63, 64, 65, 200, 1000, 5000):
        base = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        for gone in (0, 1, n // 20, n // 10, n // 5):
            fresh = rnd.integers(0, 1 << 63, gone).astype(np.uint64)
            sets += [np.unique(base[gone:]), np.unique(np.concatenate([base[gone:], fresh])), np.unique(np.concatenate([base, fresh]))]
    sets = [s for s in sets if len(s)]
    for s in sets:  # a longer sketch folds to a shorter one and keeps the bound
        assert len(jaccard_join.sketch(s)) * 64 >= len(s)
    edges = jaccard_join.near_sketches([jaccard_join.sketch(s) for s in sets], np.array([len(s) for s in sets]), np.ones(len(sets), bool), percent)
    group = [*range(len(sets))]
    for a, b in edges:
        group = [group[a] if g == group[b] else g for g in group]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(both := np.intersect1d(sets[a], sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - len(both))]
    assert len(links) > 50 and all(group[a] == group[b] for a, b in links)
    for sizes in ((300, 310, 380), (5000, 5100, 7000)):
        unlike = [jaccard_join.sketch(np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))) for n in sizes]
        assert not jaccard_join.near_sketches(unlike, np.array(sizes), np.ones(3, bool), percent)
