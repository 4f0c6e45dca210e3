"""Conversation trie, centroid clustering and token counts against brute force, with odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from optiloom.llm import centroids, decontaminate, html_blocks, html_extract, pieces, prefix_trie, quality_fm, queries, substrings, token_counts

SF = "/root/testdata/sf0.001"


def rebuilt_by_hand(rows):
    """conv_id: list of (role, text)."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, key, (role, text)))
    turns = {c: [x[3] for x in sorted(own)] for c, own in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        out[c] = tuple(turns.get(base, [])[:h] + own[h:])
    return out


def trie_by_hand(rows):
    convs = rebuilt_by_hand(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}

    def under(p):
        yield p
        for q in children[p]:
            yield from under(q)

    out = set()
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(p))))
        below = list(under(p))
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        above = min(members[p[:-1]]) if p else None
        out.add((min(own), len(p), above, len(own), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), 99, 100, 105, 130, 205, 206, -3, -150, -100, 7000, 7001]:
        for t in range(rng.choice([1, 2, 3, 6, 9, 17])):
            rows.append((c, t, rng.choice(["user", "system"]), rng.choice(["a", "é🎈", "long text"])))
    first = [r for r in rows if r[0] == 7000]
    rows += [(7050 + k, *r[1:]) for k in range(5) for r in first]  # copies
    rows += [(3, None, None, "first"), (4, 2, None, None), (4, 2, "user", None), (4, 2, "user", ""), (None, 1, "user", "nobody"), (5, 1, "user", "again"), (5, 1, "user", "again")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "conv_id long, turn long, role string, text string, d string, i int, name int")
    got = [tuple(r[c] for c in TRIE) for r in prefix_trie.trie(df).collect()]
    assert len(got) == len(set(got)) and set(got) == trie_by_hand(rows)


def test_trie_of_a_long_conversation_and_many_copies(spark):
    """A conversation of 3,000 turns, copies that end in one node over several chunks of ids, and turnless ones."""
    rows = [(5000, t, "user", str(t % 7)) for t in range(3000)]
    rows += [(c, 0, "user", "same") for c in range(20000, 34000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r[c] for c in TRIE) for r in prefix_trie.trie(df).where("depth < 20").collect()} == {r for r in _quick(rows) if r[1] < 20}
    assert prefix_trie.trie(df).count() == len(_quick(rows))


def _quick(rows):
    """As trie_by_hand for few chains: nodes by (first conversations' tuples) with hashes of prefixes."""
    convs = rebuilt_by_hand(rows)
    members, texts = {}, {}
    for c, turns in sorted(convs.items()):
        h = hashlib.sha256()
        for d in range(len(turns) + 1):
            if d:
                h.update(repr(turns[d - 1]).encode())
            key = (d, h.digest())
            members.setdefault(key, []).append(c)
            texts[key] = (len(turns[d - 1][1]) if d else 0, prior if d else None)
            prior = key
    saved, leaves, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for key in sorted(members, reverse=True):
        saved[key] += (len(members[key]) - 1) * texts[key][0]
        leaves[key] += not children[key]
        if texts[key][1]:
            up = texts[key][1]
            saved[up], leaves[up], children[up] = saved[up] + saved[key], leaves[up] + leaves[key], children[up] + 1
    out = set()
    for key, own in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in own if len(convs[c]) == key[0]).encode()).hexdigest()
        up = texts[key][1]
        out.add((own[0], key[0], members[up][0] if up else None, len(own), children[key], leaves[key], saved[key], ends))
    return out


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    only = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(only).count() == 0


def clusters_by_hand(rows):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(1 << 27), min(1 << 27, math.floor(64 * float(x)))) for x in v]))
    mark = lambda i: (i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    cents = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:16]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))

    for _ in range(3):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(cents)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    by = {k: sum(d for _, d, j in found if j == k) for k in range(16)}
    return sorted(((i, k, d, by[k], total, hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, d, k in found), key=repr)


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 64).astype(float).tolist()) for i in range(300)]
    rows += [(i, [0.25] * 64) for i in range(300, 330)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (905, [1.0] * 63 + [float("nan")]), (906, [1.0] * 63 + [float("-inf")])]
    rows += [*odd, (907, [1e30] * 64), (908, [-0.001] * 64)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance int, label string").repartition(7)
    got = sorted((tuple(r[c] for c in CLUSTER) for r in centroids.digest(df).collect()), key=repr)
    want = clusters_by_hand([(i, v if v is None or kind == "double" else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert got == want


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.digest(spark.createDataFrame([], schema)).count() == 0
    assert centroids.digest(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    rows = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [2.0] * 64)]
    assert sorted((tuple(r[c] for c in CLUSTER) for r in centroids.digest(spark.createDataFrame(rows, schema)).collect()), key=repr) == clusters_by_hand(rows)


def test_partial_distances_equal_full_ones():
    rng = np.random.default_rng(6)
    vectors, cents = rng.integers(-50, 50, (2000, 64)), rng.integers(-50, 50, (16, 64))
    cents[9] = cents[4]  # a tie
    full = ((vectors[:, None] - cents[None]) ** 2).sum(axis=2)
    chosen, best = centroids.Search(cents, rng.permutation(64)).nearest(vectors)
    assert (chosen == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_token_counts_of_all_documents(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op13_token_counts(spark, SF).collect():
        n = len(library.encode(texts[r.doc_id] or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 4096)


def test_token_counts_of_odd_texts(spark, vocabulary, library):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "▁", "a", "b", "the", "ing", "é", "中", "🎈", "́", "\x00", "x" * 300, "ab" * 200, " foo", "\r", "12", "　", "<s>", "</s>", "<0x0A>", "<unk>", "�", "ﬁ"]
    texts = [None, "", " ", "\n", "word " * 90_000, "unbroken" * 4_000, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000))]
    texts += [p.replace("▁", " ") for p in vocabulary.pieces[::9]]
    df = spark.createDataFrame([(i // 2, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = token_counts.count(df, token_counts.Merges.of(vocabulary)).collect()
    assert {r.n_chars: r.n_tokens for r in got} == {i: len(library.encode(t or "")) for i, t in enumerate(texts)}
    assert token_counts.digest(df.limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError):
        token_counts.count(df.withColumnRenamed("n_chars", "N_tokens"), token_counts.Merges.of(vocabulary))


def test_whole_tokens_are_proven(vocabulary, library):
    """Every string that counts by look-up is one token to the library, as a word after a space or as it stands."""
    whole = sorted(token_counts.Merges.of(vocabulary).whole)
    assert len(whole) > 30_000
    marked = [w for w in whole if w[0] == "▁" and w != "▁"]  # the mark alone is no text
    assert all(len(x) == 1 for x in library.encode([w[1:].replace("▁", " ") for w in marked]))
    plain = [w for w in whole if w[0] != "▁"]
    assert all(len(x) == 3 for x in library.encode(["\n" + w for w in plain]))  # the mark of the start and the line feed come before it


def test_token_counts_do_not_depend_on_the_cache(vocabulary, library, monkeypatch):
    counts = token_counts.Counts(token_counts.Merges.of(vocabulary))
    monkeypatch.setattr(token_counts, "CACHE", len(counts) + 3)
    texts = ["qwertyuiop asdfghjkl zxcvbnm", "poiuytrewq lkjhgfdsa mnbvcxz", "qwertyuiop mnbvcxz\nzxcvbnm"]
    assert [counts.of([t])[0] for t in texts] == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("doublings", [5, 6, 7, 10, 11, 16])
def test_long_words_that_products_confuse_stay_apart(spark, doublings):
    """Thue-Morse words and their complements, of 32 to 65,536 characters, among twelve equal words: nothing repeats."""
    a, b = "a", "b"
    for _ in range(doublings):
        a, b = a + b, b + a
    rest = " ".join(f"word{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{rest} {a}"), (2, f"{rest} {b}"), (3, f"{rest} {b}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.digest(df).collect()} == {1: 0, 2: 0, 3: 13}


@pytest.mark.parametrize("kept", [4, 6])
def test_many_automata_are_made_once(spark, monkeypatch, kept):
    """Six automata, more than a task keeps or not: over sixteen batches each is made once for all of them."""
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 40)
    monkeypatch.setattr(decontaminate, "KEPT", kept)
    made = []
    build = decontaminate.build
    monkeypatch.setattr(decontaminate, "build", lambda items: made.append(len(items)) or build(items))
    import pyarrow as pa

    items = [(f"q{k}", " ".join(f"w{k}x{j}" for j in range(12))) for k in range(6)]
    benchmark = spark.createDataFrame([*items, items[0], ("none", None), (None, "a b")], "item_id string, text string")
    docs = spark.createDataFrame([(k, f"before {items[k][1]} after") for k in range(6)] + [(6, "nothing"), (7, None)], "doc_id long, text string")
    run = {}

    class Docs:
        columns, schema = docs.columns, docs.schema

        def mapInArrow(self, f, schema):
            run["f"] = f

    decontaminate.annotate(Docs(), benchmark)
    rows = docs.orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
    got = [r for b in run["f"](iter([rows.slice(k % 8, 1) for k in range(16)])) for r in pa.Table.from_batches([b]).to_pylist()]
    assert [r["decon"]["items"] for r in got] == [[f"q{k % 8}"] if k % 8 < 6 else [] for k in range(16)]
    assert sum(made) == 7 and len(made) == 6  # the item of the empty id shares one
    assert {r.doc_id: r.n_hit for r in decontaminate.digest(docs, benchmark).collect()} == {**dict.fromkeys(range(6), 12), 6: 0, 7: 0}


def test_quality_of_rows_whose_count_is_no_number(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 30, "many" if i % 2 else None) for i in range(12)], "doc_id long, text string, n_chars string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    plain = {r.doc_id: r.score for r in quality_fm.digest(docs.drop("n_chars"), labels).collect()}
    assert {r.doc_id: r.score for r in quality_fm.digest(docs, labels).collect()} == pytest.approx(plain)
    assert {r.score for r in quality_fm.digest(docs, labels.limit(0)).collect()} == {0.5}


def test_fingerprints_and_components_of_all_documents(spark):
    """Every document's fingerprint and component against a loop over all pairs."""
    import re

    import xxhash

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    prints = {}
    for r in rows:
        words = re.findall("[^\x20\x09-\x0D]+", (r.text or "").translate(lower))
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
        bits = [int((hashes >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(hashes) for b in range(64)]
        prints[r.doc_id] = sum(1 << b for b, on in enumerate(bits) if on)
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2 and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", top(i)) for i, p in prints.items()}


def test_pages_of_one_id_are_sampled_alike(spark):
    pages = spark.createDataFrame([(k % 3, "u", f"<p>page {k}</p>") for k in range(60)] + [(9, "u", None)], "page_id long, url string, html string")
    first = sorted(html_extract._sample(pages, "page_id", "html"))
    assert len(first) == 3 and all(sorted(html_extract._sample(pages.repartition(n), "page_id", "html")) == first for n in (1, 7))


def test_deep_blocks_keep_their_outer_path():
    """An article's text below 200 more elements still says that it lies in the article."""
    page = "<body><article class='main'>" + "<div>" * 200 + "deep text" + "</div>" * 200 + "</article></body>"
    block = html_blocks.split_blocks(page)[0]
    assert block.text == "deep text" and block.path[:3] == ("body", "article", ".main") and block.path.count("div") == 62
