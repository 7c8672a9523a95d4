"""Matrix BPE, alignment and spelling against brute force."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from leafloom.llm import align, bpe, spelling
from leafloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, source string, pair string, word string, n long, block string, ids string"
RANKS, PATTERN = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def frame(spark, rows):
    """With columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, "s", "p", "w", 1, "b", "i") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    alphabets = ["abcdefgh ", "aeiou tnsr.,\n", "éèñüß a", "日本語ひらがな。", "0123 4567", "!?# \t\n", "ab"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += ["", None, " ", "\n\n  x", "don't we'll I'd", "<|endoftext|> and <s> </s> <0x41> ▁x", "a b　c", "x" * 5000, "ab" * 3000, " " * 700 + "end", "日本" * 400]
    texts += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(20_000)), "".join(rng.choice("etaoin") for _ in range(20_000))]
    texts += [texts[0]] * 4
    return [(i * 5, t) for i, t in enumerate(texts)] + [(5, texts[2]), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bytes(spark, rows, library):
    docs = frame(spark, rows)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, bpe.digests(docs, RANKS, PATTERN).collect()))) == sorted(map(repr, want))
    ids = bpe.encode(docs, RANKS, PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect() if r.doc_id is not None} == {i: library.encode_ordinary(t or "") for i, t in rows if i is not None}
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, RANKS, PATTERN).collect() if r.doc_id} == {i: (t or "").encode() for i, t in rows if i}
    assert bpe.digests(docs.limit(0), RANKS, PATTERN).count() == 0


def test_bytes_random_matches(library):
    own, rng = bpe.RankFile(RANKS, PATTERN), random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(rng.choice(["ab", "abc", "aeioust", "\n ", "!#", "日本語", "éèa"])) for _ in range(rng.choice([3, 20, 95, 97, 600])))
        assert next(own.encoded([text])) == library.encode_ordinary(text)


def test_bytes_of_a_full_memory(monkeypatch, library, rows):
    monkeypatch.setattr(bpe, "REMEMBERED", 50_300)
    monkeypatch.setattr(bpe, "CHARS", 300)
    own, texts = bpe.RankFile(RANKS, PATTERN), [t for _, t in rows]
    assert list(own.encoded(texts)) == [library.encode_ordinary(t or "") for t in texts]
    assert len(own.known) <= 50_300


def test_characters_split_as_in_the_library():
    """Every character behind a letter, a digit, a sign and a line end: one match with it or not."""
    import tiktoken

    ranks, own = {bytes([b]): b for b in range(256)}, bpe.RankFile(RANKS, PATTERN)
    for first in b"a1!\n":
        for b in range(128, 256):
            ranks[bytes([first, b])] = len(ranks)
    whole = tiktoken.Encoding("split", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for code in range(128, 0x110000):
        if not 0xD800 <= code < 0xE000:
            for first in "a1!\n":
                text = first + chr(code)
                assert (len(own.split(text)) == 1) == (whole.encode_ordinary(text)[0] > 255), hex(code)


def brute_links(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    docs, counts = [], collections.Counter()
    for i, text in rows:
        left, right = [], []
        if text:
            enc = a.encode(" " + text, add_special_tokens=False)
            left = [(k, bytes(byte[c] for c in t)) for k, t in zip(enc.ids, enc.tokens, strict=True)]
            for k in b.encode(text):
                piece = b.id_to_piece(k)
                right.append((k, bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode()))
            if not b"".join(t for _, t in left) == b"".join(t for _, t in right) == (" " + text).encode():
                left, right = [], []
        ends = [list(np.cumsum([len(t) for _, t in side], dtype=int)) for side in (left, right)]
        shared, groups, links, at = sorted(set(ends[0]) & set(ends[1])), [], [], [0, 0]
        for end in shared:
            to = [e.index(end) + 1 for e in ends]
            groups.append("|".join(",".join(str(k) for k, _ in side[at[s] : to[s]]) for s, side in enumerate((left, right))))
            links.append((left[to[0] - 1][0], right[to[1] - 1][0]))
            at = to
        counts.update(links)
        docs.append((i, len(left), len(right), groups, links))
    best = {}
    for (_, k), n in counts.items():
        best[k] = max(best.get(k, 0), n)
    return [(i, n_a, n_b, len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n_a, n_b, g, x in docs]


def test_alignment(spark, rows, monkeypatch):
    rows = [r for r in rows if len(r[1] or "") < 10_000]
    want = sorted(map(repr, brute_links(rows)))
    docs = frame(spark, rows)
    assert sorted(map(repr, map(tuple, align.alignment(docs, A, B).collect()))) == want
    assert sum("''" in w for w in want) >= 3
    assert align.alignment(docs.limit(0), A, B).count() == 0 and align.alignment(frame(spark, [(1, None)]), A, B).first().groups_sha256 == ""
    for r in align.overlaps(docs, A, B).collect():
        text = next((t for i, t in rows if i == r.doc_id), None)
        if r.doc_id not in (None, 5) and r.a_ids:
            assert sum(r.bytes) == len(text.encode()) + 1 and sum(r.end_together) >= 1 and r.end_together[-1]
            assert all(p < q for p, q in zip(zip(r.a_at, r.b_at, strict=True), zip(r.a_at[1:], r.b_at[1:], strict=True), strict=False))


@pytest.mark.parametrize("steps", [1, 2, 3, 7, 100])
def test_merge_path_pieces(steps):
    rng = np.random.default_rng(steps)
    for _ in range(60):
        a, b = (np.unique(rng.integers(1, 60, rng.integers(0, 40))) for _ in range(2))
        cut_a, cut_b = align.path_cuts(a, b, steps)
        work = np.diff(cut_a) + np.diff(cut_b)
        assert cut_a[-1] == len(a) and cut_b[-1] == len(b) and (work[:-1] == steps).all()
        found = list(align.pieces(a, b, steps))
        shared = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y]
        assert [p for f in found for p in zip(f.shared_a.tolist(), f.shared_b.tolist(), strict=True)] == shared
        both = np.unique(np.concatenate([a, b]))
        want = [(np.searchsorted(a, e), np.searchsorted(b, e), e - s) for s, e in zip(np.append(0, both[:-1]), both, strict=True)] if len(both) else []
        assert [p for f in found for p in zip(f.over_a.tolist(), f.over_b.tolist(), f.size.tolist(), strict=True)] == want


def one_edit(x, y):
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def brute_spelling(rows):
    import re

    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling(spark, monkeypatch):
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcdeéÀñ") for _ in range(rng.randint(6, 12))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaab", "abababab", "babababa"]
    words = []
    for k, stem in enumerate(stems):
        words += [stem.upper() if k % 3 else stem] * rng.choice([3, 40, 300])
        for _ in range(12):
            at = rng.randrange(len(stem))
            words += [rng.choice([stem[:at] + stem[at + 1 :], stem[:at] + "x" + stem[at:], stem[:at] + "é" + stem[at + 1 :], stem[:at] + stem[at : at + 2][::-1] + stem[at + 2 :]])] * rng.choice([1, 2, 3, 30])
    chain = ["chainlink", "chainlinks", "chainlinkst", "chainlinksto"]
    words += [w for w, k in zip(chain, (3, 60, 1000, 15_000), strict=True) for _ in range(k)] + ["y" * 3000, "y" * 3001] * 2 + ["÷×÷×÷×÷"] * 3
    rng.shuffle(words)
    rows = [(k, " ".join(words[k * 40 : k * 40 + 40])) for k in range(len(words) // 40 + 1)]
    rows += [(900, None), (901, ""), (902, "1234 日本語"), (5, rows[5][1]), (None, rows[6][1])]
    want = brute_spelling(rows)
    assert len({r[2] for r in want if r[0] in chain}) == 1 and sum(r[1] is not None for r in want) > 20
    docs = frame(spark, rows)
    assert sorted(map(tuple, spelling.variants(docs).collect())) == want
    monkeypatch.setattr(spelling, "TILE", 3)  # every block is cut into tiles
    assert sorted(map(tuple, spelling.variants(docs).collect())) == want
    assert spelling.variants(docs.limit(0)).count() == 0
