"""BPE over a segment tree, conversation repair and hard negatives against the library and brute force."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from gleaner.llm import conversations, negatives, segment_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# BPE over a segment tree


def odd_texts():
    rnd = random.Random(3)
    marked = ["", None, " ", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b  <|endoftext", "it's we'll\r\n\t x\u0085　\x1c", "Ünïcödé 日本語 🙂‍🙂 �", "\0\x7f" * 3]
    long = ["ab" * 3000, "".join(rnd.choice("abcdeTthe ing<|") for _ in range(9000)), "é" * 4097, "e" * 4096]
    return marked + long + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x3000), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(40)) for _ in range(50)]


def test_segment_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    texts = odd_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (4, texts[4], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, segment_bpe.token_digests(docs).collect())) == want
    assert segment_bpe.token_digests(docs.where("false")).count() == 0
    coded = segment_bpe.encode_tokens(docs, JSON, public_tokenizers.PATTERN)
    back = segment_bpe.decode_tokens(coded, JSON, public_tokenizers.PATTERN)
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t, _ in rows)


def test_segment_tree_merges_leftmost_lowest_first():
    letters = segment_bpe.byte_letters()
    rnd = random.Random(8)
    vocab, merges = {c: i for i, c in enumerate(letters)}, []
    for _ in range(60):  # merges over three letters, so that equal ranks overlap
        parts = [t for t in vocab if set(t) <= set("abc")]
        left, right = rnd.choice(parts), rnd.choice(parts)
        if left + right not in vocab:
            vocab[left + right] = len(vocab)
            merges.append([left, right])
    tree, rank = segment_bpe.SegmentMerges(vocab, merges), {tuple(m): k for k, m in enumerate(merges)}
    for n in [*range(20), 4500]:
        word = "".join(rnd.choice("abc") for _ in range(n))
        got = [tree.tokens[t].decode() for t in tree.encode(word.encode())]
        if n < 50:
            parts = list(word)
            while found := [(rank[pair], k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in rank]:
                k = min(found)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert got == parts
        assert "".join(got) == word


def test_decoding_replaces_broken_characters_like_the_library():
    from tokenizers import Tokenizer

    library, code, rnd = Tokenizer.from_file(JSON), segment_bpe.encoder(JSON, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(200):
        ids = [rnd.choice([rnd.randrange(50257), rnd.randrange(256)]) for _ in range(30)]
        assert code.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        segment_bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN)


# conversation repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_rows(rows):
    """Rows (conv, turn, role, text) of the contract's damage, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        said = [" " if x is None else x for x in (conv, turn, role, text)]
        lot = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2], said[3]
        if lot == 0:
            continue
        text = "" if lot == 1 else regex.sub("[.!?]", "", text) if lot == 2 else text
        own += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in out.items()}


def cheapest(own, faults):
    """Uniform-cost search over whole edit strings: the first one that ends well is the cheapest, then the least."""
    pattern = regex.compile("(s?(ua)+)?")
    queue = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, letters, lines = heapq.heappop(queue)
        if i == len(own) and pattern.fullmatch(letters):
            return cost, audit, lines
        ways = [("I", 3, i, c, (*lines, f"{name}:")) for c, name in (("u", "user"), ("a", "assistant"))]
        if i < len(own):
            _, role, text = own[i]
            ways.append(("D", 4, i + 1, "", lines))
            if faults[i] not in (1, 2):
                extra = 3 * (faults[i] == 3)
                ways.append(("K", extra, i + 1, role[:1], (*lines, f"{role}:{text}")))
                ways += [("R", 3 + extra, i + 1, name[0], (*lines, f"{name}:{text}")) for name in ("user", "assistant")]
        for letter, price, to, c, said in ways:
            if pattern.fullmatch(letters + c, partial=True):
                heapq.heappush(queue, (cost + price, audit + letter, to, letters + c, said))


def plain_audit(own):
    faults, seen = [], set()
    for _, role, text in own:
        bare = text.strip(SPACE)
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in own if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    letters = [role[:1] for _, role, _ in own]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
    cost, audit, lines = cheapest(own, faults)
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversation_rows():
    rnd = random.Random(12)
    rows = []
    for conv in [*range(120), None]:
        for _ in range(rnd.randint(1, 6)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ünknown"])
            text = rnd.choice(["Yes.", "no", "Why? \n", " \t", "", None, "a. b", " ", "Done!\x0c\x0b", "x\u0085"])
            rows.append((conv, rnd.choice([None, 0, 1, 2, 3, 4, 9, -2]), role, text))
    return [*rows, *rows[:9]]


def test_repair_equals_brute_force(spark, small_batches):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, kind int").repartition(3)
    hurt = plain_rows(rows)
    want = {c: plain_audit(own) for c, own in hurt.items()}
    found = {r[0]: tuple(r)[1:] for r in conversations.audit(conversations.damaged(df)).collect()}
    assert found == want and any(not own for own in hurt.values())
    assert conversations.audit(conversations.damaged(df.where("false"))).count() == 0
    # without damage, and the repaired turns themselves
    plain = df.select("conv_id", "turn", "role", "text").where("conv_id < 12")
    own = {}
    for r in conversations.repaired(plain).collect():
        own.setdefault(r["conv_id"], []).append((r["position"], f"{r['role']}:{r['text']}"))
    for r in conversations.audit(plain).collect():
        lines = [line for _, line in sorted(own.get(r["conv_id"], []))]
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_giant_conversation_passes_in_batches(spark, small_batches):
    """Several thousand turns in batches of three: every tenth turn lost leaves two of one role next to each other."""
    n = 4000
    rows = [(1, i, ["user", "assistant"][i % 2], f"Line {i}.") for i in range(n) if i % 10 != 3]
    (found,) = conversations.audit(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert found["gaps"] == n // 10 and found["illegal"] == n // 10 and found["cost"] == 3 * (n // 10)
    assert found["audit"].count("K") + found["audit"].count("R") + found["audit"].count("D") == len(rows)


def test_states_of_the_backward_pass_are_few():
    rnd, machine, now = random.Random(5), conversations.Backward(), conversations.Backward.END
    for _ in range(20000):
        now, _ = machine.step(now, rnd.randrange(15))
    assert len(machine.steps) < 2000


# hard negatives


def plain_negatives(rows, anchors=lambda i: i is not None and i % 100 == 0):
    kept = []
    for vec_id, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(256 * x) for x in v], label))
    most = (1 << 63) - 1
    dot = lambda a, b: max(-most - 1, min(most, sum(x * y for x, y in zip(a, b, strict=False))))
    last = lambda i: most if i is None else i
    out = Counter()
    for k, (vec_id, v, label) in enumerate(kept):
        if not anchors(vec_id):
            continue
        scored = [((-dot(v, w), last(i)), i, l) for j, (i, w, l) in enumerate(kept) if j != k]
        scored.sort(key=lambda s: s[0])
        for (down, _), positive, _ in [s for s in scored if s[2] == label][:5]:
            p = -down
            for rank, ((d, _), i, _) in enumerate([s for s in scored if s[2] != label and 30 * p <= -100 * s[0][0] <= 90 * p][:10], 1):
                out[vec_id, positive, rank, i, p, -d] += 1
    return out


def test_negatives_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    near = lambda n: [round(rnd.uniform(-1, 1), 2) for _ in range(n)]
    rows = [(i, near(70), rnd.randrange(4)) for i in range(420)]
    rows += [(i, rows[5][1], 1) for i in range(500, 540)]  # one vector, many ids: ties
    rows += [(600, near(3), 2), (700, [], 0), (800, None, 1), (900, near(70), None), (1000, [1.0, float("nan")], 2), (1100, [float("inf")], 2), (1200, [None], 2)]
    rows += [(None, near(70), 3), (None, near(70), 3), rows[100], rows[100], (-100, near(70), 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, id string").repartition(3)
    for size in (2048, 64):  # one block, and blocks of 64 rows each way
        monkeypatch.setattr(negatives, "LEAST_ROWS", size)
        monkeypatch.setattr(negatives, "BLOCK_ROWS", size)
        monkeypatch.setattr(negatives, "BLOCKS", 1)
        assert Counter(map(tuple, negatives.hard_negatives(df).collect())) == plain_negatives(rows)
    assert negatives.hard_negatives(df.where("false")).count() == 0 and negatives.hard_negatives(df.where("vec_id = 1")).count() == 0


def test_scores_are_exact_at_every_size():
    rng = np.random.default_rng(4)
    most = (1 << 63) - 1
    for width, top in ((1, 1), (64, 256), (200, 10**6), (64, 10**8), (130, 10**30), (3, 0), (0, 1)):
        a, b = (np.floor(rng.uniform(-top, top, (7, width))) for _ in range(2))
        want = [[max(-most - 1, min(most, sum(int(x) * int(y) for x, y in zip(u, v, strict=True)))) for v in b] for u in a]
        assert negatives.scores(a, b).tolist() == want
    assert all((p // 2) ** 2 * negatives.DEPTH < 1 << 24 for p in negatives.PRIMES)


def test_kept_rows_of_a_slot_are_the_first():
    rnd = random.Random(2)
    best, rows = negatives.Best(3, 4), []
    for _ in range(50):
        part = [(rnd.randrange(3), rnd.randrange(6), rnd.randrange(90)) for _ in range(20)]
        rows += part
        best.add(*(np.array(c) for c in zip(*part, strict=True)))
        best.settle()
    want = [r for s in range(3) for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[1], r[2]))[:4]]
    assert list(zip(best.slot.tolist(), best.score.tolist(), best.id.tolist(), strict=True)) == want


def test_passages_are_cut_beside_columns_of_any_name(spark):
    from gleaner.llm import passages

    rnd = random.Random(1)
    text = " ".join(f"w{rnd.randrange(900)}" for _ in range(60))
    names = ("coarse", "cuts", "cuts_", "cuts_key", "cuts_few", "id", "crc", "cut", "d", "c")
    docs = spark.createDataFrame([(1, text, *"abcdefghij"), (2, f"first {text} last", *"abcdefghij"), (None, text, *"abcdefghij")], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    left = passages.remove_repeats(docs, passages.repeated_passages(docs))
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["coarse"]) for r in left.collect()) == [(0, text, "a"), (1, text, "a"), (2, "first last", "a")]


def test_licenses_of_other_holders_and_programs(spark):
    from gleaner.llm import licenses
    from tests.llm.test_llm import BSD, GPL, MIT

    other = BSD.replace("the copyright holder\n", "Foo Corp. of Bar, Inc.\n").replace("the copyright holder ", "Foo Corp. of Bar, Inc. ").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "FOO CORP. ``AND'' FRIENDS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "FOO CORP.")
    assert "Foo Corp." in other
    good = MIT.replace('THE SOFTWARE IS PROVIDED "AS IS"', 'The Software shall be used for Good, not Evil.\n\nTHE SOFTWARE IS PROVIDED "AS IS"')
    x11 = MIT.replace("THE\nAUTHORS OR COPYRIGHT HOLDERS BE", "THE\nX CONSORTIUM BE") + "\nExcept as contained in this notice, the name of the Foo Group shall not be used\nin advertising or otherwise to promote the sale, use or other dealings in this\nSoftware without prior written authorization from the X Consortium.\n"
    named = GPL.replace("This program is free software", "Frob Thing is free software", 1)
    assert named != GPL and "X CONSORTIUM" in x11
    texts = {"BSD-3-Clause": other, "JSON": good, "X11": x11, "GPL-3.0-or-later": named}
    rows = [(f"{name} {k}", form) for name, t in texts.items() for k, form in enumerate((t, "\n".join("# " + line for line in t.split("\n"))))]
    rows += [("lib", "This library is free software; it is not licensed here."), ("other", "Foo is free software you can redistribute it to none.")]
    found = {r["doc_id"]: list(r["licenses"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert found == {key: [key.split()[0]] for key, _ in rows[:-2]} | {"lib": [], "other": []}


def test_bpe_memo_and_states_keep_to_their_bounds():
    import random

    import public_tokenizers

    from gleaner.llm import bpe

    path, rnd = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(7)
    small, plain = (bpe.Encoder(path, public_tokenizers.PATTERN, *bounds) for bounds in ((1 << 16, 500), ()))
    for _ in range(40):
        text = " ".join("".join(rnd.choices("abcdeghilnorstuü", k=rnd.randint(3, 14))) for _ in range(100))
        assert small.encode(text) == plain.encode(text)
        assert small.taken <= small.memo + 1000 and len(small.transducer.states) <= 600
    assert small.older and len(small) + len(small.older) < len(plain)


def test_bpe_keeps_what_it_knows_of_tokens_when_states_go(monkeypatch):
    from gleaner.llm import bpe

    code = bpe.Transducer(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    pieces = [w.encode() for w in (" unfathomably", " xylographing", " zzyzxian", "qwertyuiop", " ünwörtlich")]
    first = [code.encode(p) for p in pieces]
    code._clear()
    monkeypatch.setattr(code, "_halves", lambda token: pytest.fail("the parts of a token are worked out twice"))
    assert [code.encode(p) for p in pieces] == first and all(b"".join(map(code.tokens.get, ids)) == p for ids, p in zip(first, pieces, strict=True))
