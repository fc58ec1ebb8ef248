"""Operators of the llm subpackage against brute force, the libraries they stand for, and odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gleaner.llm import bpe, decontaminate, fingerprints, hmm, language, licenses, near_dedup, passages, quality, registry, token_counts
from gleaner.llm.common import components
from gleaner.llm.words import shingle_set, words
from gleaner.llm.words import shingles as hashed

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, JSON = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
VOCABULARY = [f"w{i}" for i in range(4000)]


def sentence(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = tokens(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, edits, shared passages, repetition, odd characters, nulls and a long text."""
    rnd = random.Random(4)
    base = [sentence(rnd, rnd.choice([3, 20, 80, 200])) for _ in range(60)]
    texts = list(base)
    texts += [t for t in base[:12]]
    texts += [re.sub(r"w(\d+)$", "edited", t) for t in base[10:40]]
    passage = sentence(rnd, 60)
    texts += [f"{sentence(rnd, 30)} {passage.upper() if k % 2 else passage} {sentence(rnd, 25)}" for k in range(9)]
    texts += [f"{passage}\n{passage}", "spam " * 300, "", None, " \n\t ", "a", "Ünïcödé 日本語 🙂 it's 42% <|endoftext|>  x", "\u0085　\x1c"]
    texts += [sentence(rnd, 9000)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """The corpus with further columns named like the operators' own, a null id and a repeated row."""
    extra = ("id", "key", "n", "a", "b", "v", "part", "own", "h", "x", "w", "component", "names", "cuts", "label")
    rows = [(i, t, "en", "s", len(t or ""), *[None] * len(extra)) for i, t in [*corpus, (None, "a text without an id of its own"), corpus[3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def test_shingle_sets_count_like_plain_sets(corpus):
    assert all(len(shingle_set(t)) == len(set(shingles(t))) for _, t in corpus)


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3), (1, 2), (2, 1)]
    rnd.shuffle(edges)
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 100 for i in range(100, 161)} | {k: 7 for k in [7, *range(200, 260)]} | {1: 1, 2: 1}
    assert found == want


def test_near_duplicates_match_brute_force(docs, empty, corpus):
    sets = {i: set(shingles(t)) for i, t in corpus}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = by_id(near_dedup.near_duplicates(docs))
    assert len(found[3]) == 2 and found[None][0]["kept"] and found[None][0]["component_id"] is None
    for i, s in sets.items():
        assert (found[i][0]["n_shingles"], found[i][0]["component_id"], found[i][0]["kept"]) == (len(s), find(i), find(i) == i)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_register_likelihood_finds_the_similarity():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.85, 1.0):
        n = 3000
        both = rng.integers(1, 1 << 62, int(2 * n * j / (1 + j)), dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(1, 1 << 62, n - len(both), dtype=np.uint64)]) for _ in range(2))
        regs = near_dedup.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        est = near_dedup.plausible(regs[:1], regs[1:], np.array([n]), np.array([n]), 0.01)
        assert abs(est[0] - j) < 0.12


def test_cross_component_pairs_of_large_groups(spark):
    """A group of variants that don't all reach the bucket's least member keeps all its links."""
    rnd = random.Random(9)
    words = [rnd.choice(VOCABULARY) for _ in range(200)]
    rows = []
    for k in range(40):
        words = [f"z{k}x{i}" if i == (k * 4) % 200 else w for i, w in enumerate(words)]
        rows.append((k, " ".join(words)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in found.collect()} == {0}


def test_passages_cover_every_exact_repeat(docs, empty, corpus):
    found = defaultdict(list)
    for r in passages.repeated_passages(docs).collect():
        assert r["end_word"] - r["start_word"] >= 50 and r["similarity"] >= 0.8 and r["match_id"] <= r["doc_id"]
        found[r["doc_id"]].append((r["start_word"], r["end_word"]))
    seen, clean = set(), set()
    for i, t in corpus:
        s = shingles(t)
        runs = [tuple(s[a : a + 46]) for a in range(len(s) - 45)]
        covered = set().union(*(range(*c) for c in found[i]))
        own = set()
        for a, run in enumerate(runs):
            if run in seen:
                assert covered >= set(range(a, a + 50)), i
            own.add(run)
        if not any(set(r) & set(x) for r in runs[:1] for x in seen):
            clean.add(i)
        seen |= own
    assert not found[0] and not found[len(corpus) - 1]
    assert passages.repeated_passages(empty).count() == 0


def test_a_passage_is_found_though_the_first_holder_has_only_a_part(spark):
    rnd = random.Random(5)
    passage = [rnd.choice(VOCABULARY) for _ in range(64)]
    rows = [(0, " ".join(passage[:30]) + " " + sentence(rnd, 40)), (5, sentence(rnd, 20) + " " + " ".join(passage)), (9, " ".join(passage) + " " + sentence(rnd, 20))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["match_id"], r["start_word"], r["end_word"]) for r in found] == [(9, 5, 0, 64)]


def test_passages_are_found_though_an_earlier_text_holds_their_middle(spark):
    """A fragment in an earlier text must not take all the signatures of an exact copy."""
    rnd = random.Random(15)
    rows, want = [], set()
    for k in range(40):
        passage = [rnd.choice(VOCABULARY) for _ in range(50)]
        rows.append((3 * k, f"{sentence(rnd, 30)} {' '.join(passage[3:48])} {sentence(rnd, 30)}"))
        rows += [(3 * k + m, f"{sentence(rnd, 30)} {' '.join(passage)} {sentence(rnd, 30)}") for m in (1, 2)]
        want.add((3 * k + 2, 3 * k + 1))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["match_id"]) for r in found if r["similarity"] == 1} >= want


def between(a, b):
    """passages() of two texts."""
    code = [t.encode() for t in (a, b)]
    x, y = (hashed(words(np.frombuffer(c, np.uint8), np.array([0, len(c)])))[0] for c in code)
    return passages.passages(x, y, a == b)


def test_passages_align_over_all_places_of_the_other_text(spark):
    rnd = random.Random(16)
    line = sentence(rnd, 6)
    texts = [f"{sentence(rnd, 20)} {' '.join([line] * 10)} {sentence(rnd, 20)}" for _ in range(2)]
    assert [p[:2] for p in between(texts[1], texts[0])] == [(20, 80)]
    often = " ".join([line] * 20)
    assert set().union(*(range(*p[:2]) for p in between(often, often))) >= set(range(54, 120))
    assert all(p[3] <= p[0] for p in between(often, often))
    part = sentence(rnd, 30)
    passage = f"{sentence(rnd, 20)} {part} {sentence(rnd, 20)}"
    assert [p[:2] for p in between(f"{sentence(rnd, 9)} {passage}", f"{part} {sentence(rnd, 40)} {passage}")] == [(9, 79)]
    rows = [(0, texts[0]), (1, texts[1]), (2, often)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["match_id"]) for r in found} >= {(1, 0), (2, 2)}


def test_near_passages_match_brute_force():
    """Passages with words inserted, removed or changed in the middle are found where they reach 0.8."""
    rnd, held = random.Random(17), 0
    for _ in range(300):
        n = rnd.randint(55, 130)
        copy = passage = sentence(rnd, n).split()
        kind, many = rnd.choice(["insert", "remove", "change"]), rnd.randint(1, 20)
        at = rnd.randint(n // 4, n - n // 4)
        copy = passage[:at] + (sentence(rnd, many).split() if kind != "remove" else []) + passage[at + (many if kind != "insert" else 0) :]
        a, b = (set(shingles(" ".join(t))) for t in (copy, passage))
        if len(copy) >= 50 and len(a & b) / len(a | b) >= 0.8:
            held += 1
            first, second = f"{sentence(rnd, 20)} {' '.join(passage)} {sentence(rnd, 20)}", f"{sentence(rnd, 30)} {' '.join(copy)} {sentence(rnd, 20)}"
            assert (30, 30 + len(copy)) in [p[:2] for p in between(second, first)], (kind, many, n, at)
    assert held >= 100


def test_removal_keeps_the_other_words(spark, docs, empty, corpus):
    found = passages.repeated_passages(docs)
    left = by_id(passages.remove_repeats(docs, found))
    cuts = defaultdict(set)
    for r in found.collect():
        cuts[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    for i, t in corpus:
        want = [w for k, w in enumerate(tokens(t)) if k not in cuts[i]]
        assert tokens(left[i][0]["text"]) == want
        if not cuts[i]:
            assert left[i][0]["text"] == t
    assert passages.remove_repeats(empty, passages.repeated_passages(empty)).columns == docs.columns


def test_tree_nodes_match_their_definition():
    h = np.random.default_rng(3).integers(1, 40, 300).astype(np.uint64) * np.uint64(977)
    own = np.random.default_rng(4).permutation(np.arange(1, 301)).astype(np.uint64)
    at = passages.centres(own, np.zeros(300, int), 11)
    left, right = passages.spans(own, at)
    for c, a, b in zip(at, left, right, strict=True):
        assert own[a : b + 1].min() == own[c] and (a == 0 or own[a - 1] < own[c]) and (b == 299 or own[b + 1] < own[c])
    mins = {int(k + np.argmin(own[k : k + 11])) for k in range(290)}
    assert set(at.tolist()) == mins
    assert {int(h[k : k + 11].min()) for k in range(290)} <= set(h[passages.centres(h, np.zeros(300, int), 11)].tolist())


def test_contaminations_match_brute_force(spark, docs, empty):
    rnd = random.Random(6)
    items = [(k, sentence(rnd, rnd.choice([6, 12, 30, 60, 120]))) for k in range(25)] + [(90, None), (91, ""), (92, "two words"), (None, "x y z")]
    texts = []
    for k, (i, t) in enumerate(items[:25]):
        w = t.split()
        w[-1] = "changed" if k % 3 == 0 and len(w) > 20 else w[-1]
        texts.append((k, f"{sentence(rnd, rnd.randint(0, 90))} {' '.join(w).upper()}\n{sentence(rnd, rnd.randint(0, 40))}"))
    texts += [(50, sentence(rnd, 400)), (51, None), (52, ""), (53, "Two  words"), (54, " ".join(items[2][1].split()[:3]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminations(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    want = set()
    for i, t in texts:
        g = shingles(t)
        for k, item in items:
            weight = Counter(shingles(item))
            n = sum(weight.values())
            for size in range(max(1, int(n * 0.8)), int(n * 1.25) + 2) if n and k is not None else ():
                for a in range(max(0, len(g) - size) + 1):
                    own = Counter(g[a : a + size])
                    both = sum((own & weight).values())
                    if both and both / (sum(own.values()) + n - both) >= 0.8:
                        want.add((i, k))
    assert set(found) == want and len(want) >= 25
    assert decontaminate.contaminations(docs, bench).count() == 0
    assert decontaminate.contaminations(empty, bench).count() == 0
    assert decontaminate.contaminations(docs, bench.where("false")).count() == 0


def test_items_with_changes_in_the_middle_are_found():
    """Words changed, added and removed in the middle of items, against the similarity of the whole stretch."""
    rnd, held, found = random.Random(18), set(), set()
    items = [(k, sentence(rnd, rnd.randint(44, 140))) for k in range(120)]
    index = decontaminate.prepare(items)
    for k, item in items:
        copy = item.split()
        for m in range(rnd.randint(1, 3)):
            at = (2 * m + 1) * len(copy) // 6 if m else len(copy) // 2
            kind = rnd.choice(["change", "add", "remove"])
            copy[at : at + (kind != "add")] = [f"new{m}"] if kind != "remove" else []
            own, weight = (Counter(shingles(" ".join(t))) for t in (copy, item.split()))
            both = sum((own & weight).values())
            if both / (sum(own.values()) + sum(weight.values()) - both) < 0.8:
                break
            text = f"{sentence(rnd, 33)} {' '.join(copy)} {sentence(rnd, 21)}".encode()
            held.add((k, m))
            found |= {(k, m) for _, i, *_ in decontaminate.find(index, np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0.8) if i == k}
    assert found == held and len(held) >= 60


def test_multi_index_guarantees_the_radius():
    rng = np.random.default_rng(8)
    items = decontaminate.prepare([(k, " ".join(f"q{x}" for x in rng.integers(0, 10**6, 40))) for k in range(30)])
    index = items.indexes[0]
    for bits in range(decontaminate.RADIUS + 3):
        flips = [int(sum(1 << int(b) for b in rng.choice(64, bits, replace=False))) for _ in index.prints]
        near, window = decontaminate.lookup(index, index.prints ^ np.array(flips, np.uint64))
        same = set(near[near == window].tolist())
        assert bits > decontaminate.RADIUS or same == set(range(len(index.prints)))


def test_transducer_agrees_with_the_library():
    import tiktoken

    own = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})
    rnd = random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyz'  \n\t.,0123456789ABCéñ中文日本🙂　\x1c\x85ſ̀"
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text


def test_runs_of_long_texts_and_streamed_characters(monkeypatch):
    own = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    text = "héllo wörld 日本語 🙂 " * 50
    whole = own.encode(text)
    monkeypatch.setattr(bpe, "LONG", 10)
    monkeypatch.setattr(bpe, "RUN", 7)
    assert own.encode(text) == whole
    stream, data = bpe.Utf8Stream(), text.encode()
    assert "".join(stream.feed(data[k : k + 1]) for k in range(len(data))) + stream.end() == text
    assert bpe.Utf8Stream().feed(b"") == "" and bpe.Utf8Stream().feed(b"\xf0\x9f") == ""


def test_digests_and_round_trip(docs, empty, corpus):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    found = by_id(bpe.token_digests(docs))
    for i, t in corpus:
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert tuple(found[i][0])[1:] == want
    assert len(found[3]) == 2 and len(found[None]) == 1
    encoded = bpe.encode_tokens(docs, RANKS, public_tokenizers.PATTERN)
    decoded = by_id(bpe.decode_tokens(encoded, RANKS, public_tokenizers.PATTERN))
    assert all(decoded[i][0]["text"] == (t or "") for i, t in corpus)
    assert bpe.token_digests(empty).count() == 0


def test_token_counts_agree_with_the_library_at_every_chunk_size(docs, empty, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in corpus}
    for sizes in ({}, {"huge": 300, "chunk": 200, "overlap": 100}):
        found = by_id(token_counts.token_counts(docs, **sizes))
        assert all((found[i][0]["n_bytes"], found[i][0]["n_tokens"]) == w and found[i][0]["over_limit"] == (w[1] > 1024) for i, w in want.items())
        assert len(found[3]) == 2
    assert token_counts.token_counts(empty).count() == 0


def test_overlaps_widen_until_they_align(spark):
    from tokenizers import Tokenizer

    rows = [(1, "x" * 5000), (2, " " * 5000), (3, "ab " * 3000), (4, "a<|endoftext|>" * 300), (5, "日" * 2000 + " " * 900 + "y")]
    found = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), huge=300, chunk=200, overlap=100)
    library = Tokenizer.from_file(JSON)
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_fingerprints(docs, empty, corpus):
    rnd = random.Random(7)
    data = bytes(rnd.choice(b"abcdef ghi\n") for _ in range(20_000))
    for n in (0, 1, 5, 100, 3000, 20_000):
        assert fingerprints.fingerprint(data[:n]) == fingerprints.fingerprint(data[:n], 64)
    one, two = fingerprints.fingerprint(data), fingerprints.fingerprint(data[:9000] + b"inserted" + data[9000:])
    assert fingerprints.likeness(one, one) == 1 and fingerprints.likeness(one, two) > 0.9
    assert fingerprints.likeness(one, fingerprints.fingerprint(data[::-1])) == 0
    found = by_id(fingerprints.fingerprint_edits(docs.dropDuplicates(["doc_id"])))
    order = [t or "" for _, t in sorted(corpus, reverse=True)]
    for k, (i, t) in enumerate(sorted(corpus, reverse=True)):
        t, after = t or "", order[(k + 1) % len(order)]
        third, r = len(t) // 3, found[i][0]
        edited = t[: len(t) - third] + after[:third]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.fingerprint(t.encode()) and r["edited_fingerprint"] == fingerprints.fingerprint(edited.encode())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.fingerprint_edits(docs).count() == len(corpus) + 1  # rows without an id have no place
    assert fingerprints.fingerprint_edits(empty).count() == 0
    lone = fingerprints.fingerprint_edits(docs.where("doc_id = 5")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1


def test_subsequence_by_bits():
    rnd = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert fingerprints._overlap(a, b) == table[-1][-1]


@pytest.mark.parametrize("stretch", [1, 2, 3, 1024])
def test_forward_and_expected_counts_match_enumeration(monkeypatch, stretch):
    """In stretches of any size the counts are those of the whole texts."""
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    rng = np.random.default_rng(0)
    k, s = 3, 5
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T.copy())
    runs = [rng.integers(0, s, n) for n in (1, 4, 2, 7, 3)]
    total = (np.zeros(k), np.zeros((k, k)), np.zeros((s, k)))
    logs = []
    for run in runs:
        start, moves, emits, p = np.zeros(k), np.zeros((k, k)), np.zeros((s, k)), 0.0
        for path in itertools.product(range(k), repeat=len(run)):
            q = model.start[path[0]] * np.prod([model.moves[a, b] for a, b in itertools.pairwise(path)]) * np.prod([model.emits[x, a] for x, a in zip(run, path, strict=True)])
            p += q
            start[path[0]] += q
            for a, b in itertools.pairwise(path):
                moves[a, b] += q
            for x, a in zip(run, path, strict=True):
                emits[x, a] += q
        logs.append(math.log10(p))
        for into, part in zip(total, (start, moves, emits), strict=True):
            into += part / p
    at = np.cumsum([0, *map(len, runs)])
    assert np.allclose(hmm.forward(model, np.concatenate(runs), at), logs)
    found = (np.zeros(k), np.zeros((k, k)), np.zeros((s, k)))
    hmm.expected(model, np.concatenate(runs), at, found)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(found, total, strict=True))


def test_expected_counts_settle_over_long_texts(monkeypatch):
    rng = np.random.default_rng(3)
    k, s = 4, 30
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k) * 0.2 + np.eye(k) * 0.8, rng.dirichlet(np.ones(s), k).T.copy())
    runs = [rng.integers(0, s, n) for n in (3, 5000, 700, 2049, 1024)]
    at, found = np.cumsum([0, *map(len, runs)]), []
    for stretch in (100, 1024, 10_000):
        monkeypatch.setattr(hmm, "STRETCH", stretch)
        found.append((np.zeros(k), np.zeros((k, k)), np.zeros((s, k))))
        hmm.expected(model, np.concatenate(runs), at, found[-1])
    assert all(np.allclose(a, b, rtol=1e-4, atol=1e-3) for other in found[:2] for a, b in zip(other, found[2], strict=True))
    assert np.isclose(found[0][1].sum(), sum(len(r) - 1 for r in runs), rtol=1e-5)


def test_base_scores_and_counts(monkeypatch, docs, empty, corpus):
    monkeypatch.setattr(hmm, "TABLE", 500)  # most words meet their counts in the join
    monkeypatch.setattr(hmm, "SYMBOLS", 100)
    train = (hmm.digest("doc_id") % 7 != 2) & hmm.F.col("doc_id").isNotNull()
    found = by_id(hmm.score_texts(docs, train, rounds=1))
    text = {i: [*tokens(t), None] for i, t in corpus}
    rows = [*text, 3]  # document 3 stands twice
    count = Counter(w for i in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in text[i])
    n, v = sum(count.values()), len(count)
    for i, w in text.items():
        r = found[i][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    assert len(found[3]) == 2 and len(found[None]) == 1
    assert hmm.score_texts(empty, train).count() == 0


def test_licenses_against_plain_matching(spark, docs, empty):
    rows = [
        (1, "Hello.\nReleased under the MIT License.\nBye."),
        (2, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
        (3, None),
        (4, ""),
        (5, "This program is free software: you can"),
        (6, "Licensed under CC BY-NC 4.0.\n" * 3 + "licensed under cc by 4.0"),
        (7, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice; Redistributions in binary form must reproduce the above copyright notice."),
    ]
    found = {r["doc_id"]: (list(r["licenses"]), r["n_matches"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (["MIT"], 1), 2: (["Apache-2.0"], 1), 3: ([], 0), 4: ([], 0), 5: ([], 0), 6: (["CC-BY-NC-4.0", "CC-BY-4.0"], 4), 7: (["BSD-2-Clause"], 1)}
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(empty).count() == 0


MIT = """The MIT License (MIT)

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
APACHE = """// Copyright 2021 Some Body
//
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License.
package main
"""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""


def test_whole_published_licenses_are_known(spark):
    """As published, in comments, unwrapped, and one after the other; and not with a word changed."""
    texts = {"MIT": MIT, "BSD-3-Clause": BSD, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "MPL-2.0": MPL, "Unlicense": UNLICENSE}
    rows, want = [], {}
    for name, text in texts.items():
        for form in (text, "\n".join("# " + line for line in text.split("\n")), re.sub(r"(?<!\n)\n(?!\n)", " ", re.sub(r"(?m)^[ #/*]+", "", text)), "Some words before\n" + text.upper() + "\nand after"):
            rows.append((len(rows), form))
            want[len(rows) - 1] = ([name], 1)
    rows.append((len(rows), "".join(texts.values())))
    want[len(rows) - 1] = (list(texts), len(texts))
    rows.append((len(rows), MIT.replace("sublicense", "sell on").replace("copies or substantial", "some")))
    want[len(rows) - 1] = ([], 0)
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (list(r["licenses"]), r["n_matches"]) for r in found} == want


def test_every_sentence_and_rule_can_match(spark):
    rows = [(i, s) for i, of in licenses.SENTENCES.items() for s in of]
    found = licenses.scan_licenses(spark.createDataFrame([(k, s + ".") for k, (_, s) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: list(r["sentence_ids"]) for r in found} == {k: [i] for k, (i, _) in enumerate(rows)}
    runs = [(k, ".\n".join(licenses.SENTENCES[i][0] for i in run)) for k, (_, run) in enumerate(licenses.RULES)]
    found = licenses.scan_licenses(spark.createDataFrame(runs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (list(r["licenses"]), r["n_matches"]) for r in found} == {k: ([name], 1) for k, (name, _) in enumerate(licenses.RULES)}


def test_language_scores(spark, docs, empty):
    rnd = random.Random(3)
    words = {"xx": ["aba", "bab", "abba", "baa"], "yy": ["cdc", "ddc", "ccd", "dcd"]}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["xx", "yy"] * 20)] + [(90, "aba", None), (91, None, "xx"), (92, "", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.languages == ["xx", "yy"]
    probes = spark.createDataFrame([(1, "abab bab"), (2, "dcdc"), (3, None), (4, "12 !?"), (5, ""), (6, "日本")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in language.identify(probes, model).collect()}
    assert [found[i]["lang_pred"] for i in range(1, 6)] == ["xx", "yy", "und", "und", "und"] and found[3]["score"] == 0
    assert found[6]["lang_pred"] in ("xx", "yy") and 0 < found[6]["score"] <= 1
    assert language.keep_known(probes, model).count() == 3 and language.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(empty)).collect()} == {"und"}


def test_code_lengths_are_those_of_plain_ppm():
    rows = []
    text = b"abracadabra abracadabra xyz"
    for order in range(language.ORDER + 1):
        for gram, n in Counter(text[i : i + order + 1] for i in range(len(text) - order)).items():
            rows.append(("l", order, int.from_bytes(gram, "big"), n))
    scorer = language.Scorer(language._model(rows))

    def bits(context, byte):
        if not context and text.count(bytes([byte])) == 0:
            return math.log2(len(set(text)) / (len(text) + len(set(text)))) - 8
        n = Counter(text[i + len(context)] for i in range(len(text) - len(context)) if text[i : i + len(context)] == context)
        total, kinds = sum(n.values()), len(n)
        if n[byte]:
            return math.log2(n[byte] / (total + kinds))
        return (math.log2(kinds / (total + kinds)) if total else 0.0) + bits(context[1:], byte)

    for probe in (b"abrac", b"zzz?", b"dabra xyq", b"a"):
        want = -sum(bits(probe[max(0, i - language.ORDER) : i], probe[i]) for i in range(len(probe)))
        data = np.frombuffer(b"qq" + probe, np.uint8)
        got = scorer.lengths(data, np.array([0, 2, len(data)]))[1, 0]
        assert math.isclose(got, want, rel_tol=1e-5)


def test_quality_ranks_held_out_texts(spark, docs, empty):
    rnd = random.Random(5)
    rows = [(i, sentence(rnd, 60) if i % 3 else "BUY!! NOW!! " * 20 + sentence(rnd, 4), int(bool(i % 3))) for i in range(300)] + [(900, None, 1), (901, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.where("doc_id % 2 = 0 or doc_id > 800"))
    found = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    held = [(found[i], q) for i, _, q in rows if i % 2 and i < 800]
    assert min(s for s, q in held if q) > max(s for s, q in held if not q)
    assert all(0 <= s <= 1 for s in found.values()) and len(found) == len(rows)
    assert quality.score(empty, model).count() == 0 and quality.fit(empty.withColumn("quality", quality.F.lit(1))) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert 0 <= quality.quantile_cut(quality.score(df, model), 0.3) <= 1


def test_pipeline_stages_take_effect(spark, docs, empty, corpus, tmp_path):
    rnd = random.Random(11)
    item = sentence(rnd, 40)
    rows = [(1000, sentence(rnd, 20) + " " + item, "en", "s", 1), (1001, "12345 !!", "en", "s", 8), (1002, None, None, None, None), (None, sentence(rnd, 30), "en", "s", 1)]
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    table = own.where("doc_id is not null").union(spark.createDataFrame(rows, own.schema))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) and not {1000, 1001, 1002} & set(found) and None in found
    text = dict(corpus)
    assert {i for i in range(10) if text[i].strip()} <= set(found) and not set(found) & set(range(60, 72)) - {60 + k for k in range(12) if not tokens(text[k])}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, own.where("false"), str(tmp_path)).columns == own.columns, name


def test_pipeline_judges_rows_by_their_own_text(spark, tmp_path):
    """Rows without an id are judged too, and unlike texts under one id all stay, each cut in its own places."""
    rnd = random.Random(12)
    item, passage, other = sentence(rnd, 40), sentence(rnd, 60), sentence(rnd, 80)
    rows = [(None, "Before it. " + item), (1, item), (2, passage), (7, f"{sentence(rnd, 30)} {passage} {sentence(rnd, 30)}"), (7, other), (7, other), (8, "12 34"), (9, "Plain words.")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        left.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
    found = defaultdict(set)
    for r in left.collect():
        found[r["doc_id"]].add(len(r["text"].split()))
    assert dict(found) == {2: {60}, 7: {60, 80}, 9: {2}} and left.count() == 4


def test_language_stage_rejects_what_no_language_codes(spark):
    rnd = random.Random(13)
    noise = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(300))
    rows = [(k, sentence(rnd, 50), "en") for k in range(40)] + [(100, noise, None), (101, None, "en"), (102, "42", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == set(range(40))


def test_words_of_long_texts_are_the_same_in_pieces(monkeypatch):
    rnd = random.Random(5)
    texts = [sentence(rnd, 300), "", "x" * 500, " a " * 90, "ends with a word", "Another begins"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    whole = words(data, at)
    for size in (1, 7, 64, 501):
        monkeypatch.setattr("gleaner.llm.words.SLICE_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, words(data, at), strict=True)), size


def test_long_texts_are_searched_for_items_in_parts(monkeypatch):
    rnd = random.Random(6)
    items = decontaminate.prepare([(k, sentence(rnd, n)) for k, n in enumerate((9, 40, 200, 700))])
    held = sentence(rnd, 300)
    rnd = random.Random(6)
    copies = [sentence(rnd, n) for n in (9, 40, 200, 700)]
    text = " ".join(f"{part} {copy}" for part, copy in zip([held] * 4, copies, strict=True))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = decontaminate.find(items, data, np.array([0, len(data)]), 0.8)
    assert [k for _, k, *_ in whole] == [0, 1, 2, 3]
    for places in (100, 333, 1024):
        monkeypatch.setattr(decontaminate, "PLACES", places)
        assert decontaminate.find(items, data, np.array([0, len(data)]), 0.8) == whole


def plain_fingerprint(text):
    """Piece by piece, byte by byte: a piece ends where the hash of the last WINDOW bytes is a multiple of the size."""
    data, small, long = text, fingerprints.SMALLEST, fingerprints.LENGTH
    rolled = []
    for i in range(len(data)):
        h = 0
        for k in range(min(fingerprints.WINDOW, i + 1)):
            h = (h + (data[i - k] + 1) * int(fingerprints._WEIGHTS[k])) & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
        rolled.append(h ^ h >> 13)

    def pieces(size):
        out, start = [], 0
        for i, h in enumerate(rolled):
            if h % size == 0 and len(out) < long - 1:
                out.append(data[start : i + 1])
                start = i + 1
        return out + ([data[start:]] if start < len(data) else [])

    if not data:
        return f"{small}::"
    size = small
    while size * long < len(data):
        size *= 2
    while size > small and sum(h % size == 0 for h in rolled) < long // 2:
        size //= 2
    letters = lambda of: "".join(chr(fingerprints._LETTERS[int(fingerprints.mix(np.array([sum(int(fingerprints._BYTE_PLAIN[b]) * pow(fingerprints._BASE, k, 1 << 64) for k, b in enumerate(p)) % (1 << 64)], np.uint64))[0]) >> 58]) for p in of)
    return f"{size}:{letters(pieces(size))}:{letters(pieces(2 * size))}"


def test_fingerprints_match_pieces_cut_one_by_one():
    rnd = random.Random(8)
    texts = ["", "a", "abc" * 30, *(sentence(rnd, n) for n in (3, 20, 60, 150, 400)), "日本語🙂" * 40]
    for text in texts:
        for step in (64, fingerprints.SLICE_BYTES):
            assert fingerprints.fingerprint(text.encode(), step) == plain_fingerprint(text.encode()), (text[:30], step)


def test_likeness_is_the_edit_distance_of_letters():
    """With insertions and deletions of cost 1: 1 - distance / both lengths."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (0 if x == y else 2)))
        return row[-1]

    rnd = random.Random(9)
    for _ in range(200):
        a = "".join(rnd.choice("ABCDE") for _ in range(rnd.randint(1, 64)))
        b = "".join(c for c in a if rnd.random() < 0.8) + "".join(rnd.choice("ABCDE") for _ in range(rnd.randint(0, 20)))
        size = fingerprints.COMMON if min(len(a), len(b)) >= 2 * fingerprints.COMMON else fingerprints.SHORT
        shares = any(a[i : i + size] in b for i in range(len(a) - size + 1))
        want = 1.0 if a == b and len(a) >= fingerprints.COMMON else 1 - distance(a, b) / (len(a) + len(b)) if shares else 0.0
        found = fingerprints.likeness(f"3:{a}:", f"3:{b}:x")
        assert math.isclose(found, want, abs_tol=1e-12), (a, b)
    assert fingerprints.likeness("3:ABCDEFG:HIJ", "24:ABCDEFG:HIJ") == 0.0 and fingerprints.likeness("3:A:ABCDEFGH", "6:ABCDEFGH:A") == 1.0


def test_preference_weights_maximise_the_likelihood(spark):
    """Newton steps summed by Spark against a plain gradient climb of the same penalised likelihood."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-x @ np.array([1.0, -2.0, 0.5])))).astype(float)
    rows = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    w = np.zeros(3)
    for _ in range(20_000):
        w += 0.002 * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 2.0 * w)
    assert np.allclose(quality._newton(rows, 25, 3, 2.0), w, atol=1e-3)


def test_scores_after_training_match_a_plain_model(monkeypatch, spark):
    """Baum-Welch and the forward recursion written out for every text and state."""
    monkeypatch.setattr(hmm, "STATES", 3)
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    caught = {}
    plain_train = hmm.train

    def train(learned, common, weight, rounds):
        caught["start"] = (common.copy(), weight.copy())
        caught["model"] = plain_train(learned, common, weight, 2, 3)
        return caught["model"]

    monkeypatch.setattr(hmm, "train", train)
    found = {r["doc_id"]: r for r in hmm.score_texts(docs, hmm.F.col("doc_id") % 7 != 2, rounds=2).collect()}
    common, weight = caught["start"]
    size, noise = len(common) + 1 + hmm.RARE, np.random.default_rng(11)
    prior = (weight + 0.5) / (weight + 0.5).sum()
    emits = prior[:, None] * noise.gamma(1.0, 1.0, (size, 3))
    start, moves, emits = np.full(3, 1 / 3), np.full((3, 3), 0.05) + np.eye(3) * 0.85, emits / emits.sum(0)
    place = {int(h): k for k, h in enumerate(common)}
    symbols = {i: [place[int(words(np.frombuffer(w.encode(), np.uint8), np.array([0, 1])).hashes[0])] for w in t.split()] + [len(common)] for i, t in enumerate(texts)}
    for _ in range(2):
        sums = np.full(3, 0.1), np.full((3, 3), 0.1), prior[:, None] * np.full((1, 3), 10.0)
        for i, run in symbols.items():
            if i % 7 == 2:
                continue
            alpha = [start * emits[run[0]]]
            for s in run[1:]:
                alpha.append((alpha[-1] @ moves) * emits[s])
            beta = [np.ones(3)]
            for s in reversed(run[1:]):
                beta.insert(0, moves @ (emits[s] * beta[0]))
            p = alpha[-1].sum()
            sums[0][:] += alpha[0] * beta[0] / p
            for t, s in enumerate(run):
                sums[2][s] += alpha[t] * beta[t] / p
                if t:
                    sums[1][:] += alpha[t - 1][:, None] * moves * (emits[s] * beta[t])[None, :] / p
        start, moves, emits = sums[0] / sums[0].sum(), sums[1] / sums[1].sum(1, keepdims=True), sums[2] / sums[2].sum(0)
    for i, run in symbols.items():
        alpha = start * emits[run[0]]
        for s in run[1:]:
            alpha = (alpha @ moves) * emits[s]
        assert math.isclose(found[i]["score"], math.log10(alpha.sum()), rel_tol=1e-3), i


def test_signatures_are_worked_out_once(spark, monkeypatch):
    """The texts pass the signatures' function once, and the first holder and the number of holders come from the same rows."""
    plans = []
    real = passages.rewrite
    monkeypatch.setattr(passages, "rewrite", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or real(df))
    text = " ".join(f"w{k}" for k in range(60))
    found = passages.repeated_passages(spark.createDataFrame([(1, text), (2, f"{text} more"), (3, "short")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["match_id"], r["similarity"]) for r in found] == [(2, 0, 60, 1, 1.0)]
    assert plans[0].count("MapInArrow") == 1


def test_registry_names_every_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11)) and set(registry.SQL) <= set(registry.QUERIES)
