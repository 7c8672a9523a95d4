"""Operators for training corpora against brute force, on small tables with nulls, empty and long texts, ties, repeated rows, other columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from leafloom.llm import common, editcount, jaccard, licenses, packing, pieces, quality, substring, suffix, toxicity, vectors
from leafloom.llm.components import components
from leafloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, source string, row_key string, words string, part long, component string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = line(70)
    texts = [line(rng.randint(1, 300)) for _ in range(40)]
    texts += [line(30) + "\n" + passage + "\n" + line(rng.randint(5, 40)) for _ in range(12)]
    base = line(120).split()
    for k in range(14):  # near copies of many degrees
        own = list(base)
        for _ in range(k):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    texts += [base[0] + " " + base[1], base[0].upper() + " " + base[1], "", "  \n\t ", None, "a b c", "a b c", line(20_000), "é ß 日本 \x0b x"]
    texts += [" ".join(["x y z"] * 60), "same words here\n" * 30]
    texts += [texts[3]] * 9 + [texts[45]] * 3
    rows = [(i * 7 % 1009, t, f"s{i % 2}" if i % 5 else None) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows, extra=()):
    """With a repeated row, a row without an id, and columns that clash with names used inside."""
    rows = list(rows) + list(extra)
    return spark.createDataFrame([(i, t, s, "k", "w", 1, "c") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus, [corpus[2], (None, "no id at all", "s1")]).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def repeats(corpus, width):
    seen, out = {}, {}
    for doc, text, _ in sorted(corpus, key=lambda r: r[0]):
        words = split(text)
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.setdefault(key, (doc, i))
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_quality(spark, docs, corpus):
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert quality.verdicts(docs).count() == docs.count() and quality.verdicts(empty(spark)).count() == 0
    for doc, text, _ in corpus:
        words = [w.decode() for w in split(text)]
        triples = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + d for i, t in enumerate(zip(words, words[1:], words[2:], strict=False)) if triples[t] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
        assert (got[doc].n_words, got[doc].word_chars, got[doc].n_symbols, got[doc].n_dup_lines, got[doc].n_repeat_words) == want
        assert got[doc].base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_boilerplate_lines_deplete_documents_but_copies_do_not(spark):
    rng = random.Random(1)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    menu = "\n".join(f"Menu entry {k} of this site with some more words to read" for k in range(6))
    rows = [(i, menu.replace("entry", "ENTRY  ") + "\n" + own(8), "host") for i in range(30)]
    rows += [(100 + i, own(80), "host") for i in range(30)]
    copy = "\n".join(own(20) for _ in range(4))
    rows += [(200 + i, copy, "host") for i in range(40)]
    got = {r.doc_id: r.kept for r in quality.verdicts(frame(spark, rows)).collect()}
    assert not any(got[i] for i in range(30)) and all(got[i] for i in got if i >= 100)
    kept = quality.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_menus_of_several_lines_count_in_all_their_documents(spark):
    rng = random.Random(11)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n))  # noqa: E731  # letters, for digits count as equal
    menu = "\n".join(own(12) for _ in range(8))
    rows = [(i, menu + "\n" + own(8), "host") for i in range(30)]
    copy = "\n".join(own(20) for _ in range(4))
    rows += [(100 + i, copy, "host") for i in range(2500)] + [(3000, None, "host")]  # copies do not make the host larger
    got = {r.doc_id: r for r in quality.verdicts(frame(spark, rows)).collect()}
    assert all(got[i].n_line_words_removed == len(split(menu)) and not got[i].kept for i in range(30))
    assert all(got[i].n_line_words_removed == 0 and got[i].kept for i in range(100, 2600))


def test_substrings(spark, docs, corpus):
    out = substring.remove_repeats(docs, text=True)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}
    want = repeats(corpus, 20)
    assert got == want and sum(v[1] > 0 for v in want.values()) > 10
    for r in out.collect():
        assert hashlib.sha256(b" ".join(split(r.text))).hexdigest() == r.kept_sha256
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_suffixes(spark, docs, corpus):
    rows = suffix.passages(docs).collect()
    removed = collections.Counter()
    texts = {d: split(t) for d, t, _ in corpus}
    for r in rows:
        removed[r.doc_id] += r.n_removed
        assert (r.first_doc_id, r.first_start) < (r.doc_id, r.start)
        assert texts[r.doc_id][r.start : r.start + r.n_removed] == texts[r.first_doc_id][r.first_start : r.first_start + r.n_removed]
    want = repeats(corpus, 50)
    assert {d: n for d, n in removed.items()} == {d: v[1] for d, v in want.items() if v[1]}
    clean = {r.doc_id: r.text for r in suffix.remove_passages(docs).where("doc_id is not null").collect()}
    assert all(hashlib.sha256(b" ".join(split(clean[d]))).hexdigest() == v[2] for d, v in want.items())
    assert suffix.remove_passages(docs).columns == docs.columns and suffix.passages(empty(spark)).count() == 0


def shingle_set(text):
    words = [w.lower() for w in split(text)]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_jaccard(spark, docs, corpus, monkeypatch):
    sets = {d: shingle_set(t) for d, t, _ in corpus}
    least = {d: d for d in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    monkeypatch.setattr(jaccard, "HOT_FROM", 3)  # so that there are frequent shingles here,
    monkeypatch.setattr(jaccard, "SALT_ROWS", 2)  # and salted ones
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {d: (len(s), least[d]) for d, s in sets.items()}
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    least = {i: i for e in edges if None not in e for i in e}
    for _ in range(400):
        for a, b in edges:
            if a is not None:
                least[a] = least[b] = min(least[a], least[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {i for a, b in edges if a is not None and a != b for i in (a, b)}
    assert got == {i: least[i] for i in linked}


def test_pieces(spark, docs, corpus):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    odd = [(5000 + i, "".join(rng.choice(" ▁ab\né日\t😀'.1\x00") for _ in range(rng.randint(0, 30))), "s") for i in range(300)]
    table = frame(spark, corpus + odd)
    encoded = {r.doc_id: r for r in pieces.encode(table, path).collect()}
    decoded = {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(table, path), path).collect()}
    digests = {r.doc_id: r for r in pieces.digests(table, path).collect()}
    for doc, text, _ in corpus + odd:
        want = library.encode(text or "", add_eos=True)
        row = encoded[doc]
        assert row.ids == want and decoded[doc] == library.decode(want)
        assert digests[doc].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and digests[doc].n_tokens == len(want)
        assert digests[doc].decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
        if text:  # spans tile the source
            assert row.begins[0] == 0 and row.ends[-1] == len(text.encode()) and row.begins[1:] == row.ends[:-1]
    assert pieces.digests(empty(spark), path).count() == 0


def test_character_map():
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = b"".join(v for n, v, _ in pieces._fields(library.serialized_model_proto()) if n == 3)
    own = pieces.Normaliser(spec)
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("ＡＢ①㌔ﬁ ａé  x\t　Å한") for _ in range(rng.randint(0, 12)))
        clean, source = own(text)
        assert clean == library.normalize(text)
        assert len(source) == len(clean.encode()) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())


def test_byte_level_ids():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.byte_level(path)
    rng = random.Random(6)
    texts = ["<|endoftext|> x", "a   b", "a\n  b ", "\xa0x", "日本", "it's Don'T"]
    texts += ["".join(rng.choice("  \n\tab'sé1.²ª–\r") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    safe = [chr(c) for c in range(0x3000) if not own.UNSAFE.search(chr(c))]  # every character that is left to the fast path
    texts += [f"x{c}{c} y{c}1" for c in safe]
    for text in texts:
        assert np.frombuffer(own.encode(text), own.wide).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark, docs, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = packing.pack(frame(spark, corpus).repartition(3), vocabulary("byte_bpe_50k.json"), length=256, ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for doc, text, _ in corpus:
        own = sorted(by_doc[doc], key=lambda r: r.start)
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert [i for r in own for i in r.ids] == want and {r.doc_tokens for r in own} == {len(want)}
    for sequence, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or sequence == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack(docs, vocabulary("byte_bpe_50k.json")).count() >= docs.count() and packing.pack(empty(spark), vocabulary("byte_bpe_50k.json")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(30, 16))
    x = [(centers[i % 30] + rng.normal(size=16) * rng.choice([0.02, 0.2, 1.5])).tolist() for i in range(600)]
    rows = [(i, v) for i, v in enumerate(x)] + [(700 + i, x[5]) for i in range(6)] + [(800, [c * 1e-200 for c in x[5]])]
    odd = [(900, None), (901, [0.0] * 16), (902, [None] + [1.0] * 15), (903, [float("nan")] * 16), (904, [math.inf] * 16), (905, []), (906, [1.0, 2.0]), (None, x[5]), (3, x[3])]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    ids = np.array([r[0] for r in rows])
    unit = np.array([np.array(r[1]) / np.abs(r[1]).max() for r in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    labels = vectors.merged(np.arange(len(ids)), *np.nonzero(near))
    found = sum(got[i].n_links for i in ids.tolist())
    assert 0.98 * near.sum() <= found <= near.sum() and all(got[i].n_links <= n for i, n in zip(ids.tolist(), near.sum(1).tolist(), strict=True))
    assert sum(got[i].component_id != ids[k] for i, k in zip(ids.tolist(), labels.tolist(), strict=True)) <= 6
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 907)) and len(got) == len(rows) + 7
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_audit_of_rare_links_and_nodes_out_of_reach():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x[1:6:2] = x[0:6:2] + 0.05 * rng.normal(size=(3, 24))  # the only links
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, node, weight = vectors.Graph(x), np.arange(3000), np.full(3000, 3)
    for table in graph.near:  # no search reaches them
        table[np.isin(table, np.arange(6))] = -1
    for sample in (node[:6], node[2000:2040]):  # links met by the sample, and by planted vectors only
        if sample[0]:
            for table in graph.near:
                table[np.isin(table, np.arange(100, 1000))] = -1
        assert vectors.audited_beam(graph, 0.95, 0.99, 32, node, sample, x[sample]) >= 3000 / 4
    links, _ = vectors.own_links(graph, weight, 0.95, 32)
    assert (links >= weight).all()
    links, labels = vectors.own_links(graph, weight, 0.95, 1024)
    assert (links[:6] == 6).all() and (links[6:] == 3).all() and (labels[1:6:2] == labels[0:6:2]).all()


def test_rare_links_in_shards_of_thousands(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(18_000, 16))
    x[1:400:2] = x[0:400:2] + 0.2 * rng.normal(size=(200, 16))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = sum(int((unit[i : i + 2000] @ unit.T >= 0.95).sum()) for i in range(0, 18_000, 2000)) - 18_000
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    links = [r.n_links for r in vectors.near_duplicates(table).select("n_links").collect()]
    assert min(links) == 0 and true > 150 and 0.97 * true <= sum(links) <= true


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("the", "or", "an", "ti") for b in ("re", "sh", "ea") for c in ("n", "st", "ou", "ly")]
    rows, labels = [], []
    for i in range(900):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(20, 90))], int(i % 6 == 0)
        for _ in range(4 * toxic):
            text[rng.randrange(len(text))] = rng.choice(["zork", "blarg", "vexo" + rng.choice(words), "vexo" + rng.choice(words)])
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, toxic))
    labels += [(3, 1, None), (None, 1, 1), (4, 1, 0)]
    table, known = frame(spark, rows + [(2000, "", "s"), (2001, None, "s"), (None, "zork zork", "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.scores(table, known).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [i for i in range(900) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 6 == 0) for i in held) >= 0.95 * len(held)
    kept = toxicity.keep_clean(table, known)
    assert kept.columns == table.columns and kept.count() == sum(r.predicted == 0 for r in out)
    lexicon = toxicity.scores(table.limit(5), known.limit(0)).collect()
    assert len(lexicon) == 5 and toxicity.scores(empty(spark), known).count() == 0


def test_licenses(spark):
    rows = [(i, f"Some words here.\n{text}\nThe end", "s") for i, text in enumerate(licenses.TEMPLATES.values())]
    others = [(100, "a copyright notice of some kind", "s"), (101, None, "s"), (102, "", "s"), (103, "Licensed under the Apache License, version 1.1", "s"), (104, "licensed under the\nApache License,\nversion 2.0", "s"), (None, "All rights reserved.", "s")]
    got = collections.defaultdict(list)
    for r in licenses.scan(frame(spark, rows + others)).collect():
        got[r.doc_id].append((r.first_line, r.license, r.exact))
    for i, name in enumerate(licenses.TEMPLATES):
        assert (1, name, True) in got[i] and {x[1] for x in got[i]} == {name}
    assert not {100, 101, 102, 103} & got.keys() and got[None]
    assert licenses.scan(empty(spark)).count() == 0


def test_dual_wrapped_and_whole_licences(spark):
    mit, two, three = (t for _, t in licenses.TEXTS)
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [
        ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", ["Apache-2.0", "MIT"]),
        ("Licensed under the Apache License, Version 2.0, or the MIT License", ["Apache-2.0", "MIT"]),
        ("Licensed under the Apache\nLicense, Version 2.0.\nReleased under the MIT\nLicense.", ["Apache-2.0", "MIT"]),
        ("All rights reserved. All rights reserved.", ["proprietary", "proprietary"]),
        (" ".join(licenses.TEMPLATES.values()), sorted(licenses.TEMPLATES)),
        (wrap(mit, 9), ["MIT"]), (wrap(two, 7), ["BSD-2-Clause"]), (wrap(three, 12), ["BSD-3-Clause"]),
        ("MIT License\n\nCopyright (c) 2020 A. All rights reserved.\n\n" + mit.replace("person", "body"), ["MIT", "proprietary"]),
        (wrap(mit, 9)[:600], []),
    ]
    got = collections.defaultdict(list)
    for r in licenses.scan(frame(spark, [(i, f"Words.\n{t}\nThe end", "s") for i, (t, _) in enumerate(rows)])).collect():
        got[r.doc_id].append(r.license)
    assert [sorted(got[i]) for i in range(len(rows))] == [sorted(want) for _, want in rows]


def test_edit_aware_counts(spark, corpus):
    coder = packing.byte_level(vocabulary("byte_bpe_50k.json"))
    rng, rows = random.Random(9), []
    for doc, text, _ in corpus:
        edits = [(rng.randint(-3, len(text or "") + 3), rng.randint(0, len(text or "") + 3), rng.choice(["", " ", "x", " new words\n", None])) for _ in range(rng.randint(0, 6))]
        rows.append((doc, text, edits or None))
    table = spark.createDataFrame(rows, f"doc_id long, text string, edits {editcount.EDIT}")
    got = {r.doc_id: r for r in editcount.recount(table, vocabulary("byte_bpe_50k.json")).collect()}
    for doc, text, edits in rows:
        text = text or ""
        todo = editcount.in_order([{"start": a, "end": b, "text": t} for a, b, t in edits or []], len(text))
        after = text
        for a, b, new in reversed(todo):
            after = after[:a] + new + after[b:]
        assert (got[doc].n_tokens, got[doc].n_tokens_after, got[doc].n_edits) == (len(coder.ids(text)), len(coder.ids(after)), len(todo))
    long = next(d for d, t, _ in corpus if t and len(split(t)) == 20_000)
    one = spark.createDataFrame([(long, next(t for d, t, _ in corpus if d == long), [(5000, 5004, "z")])], f"doc_id long, text string, edits {editcount.EDIT}")
    assert editcount.recount(one, vocabulary("byte_bpe_50k.json")).first().n_recoded_chars < 2_000


def test_edit_trees_against_whole_texts():
    coder = packing.byte_level(vocabulary("byte_bpe_50k.json"))
    count = lambda t: len(coder.ids(t)) if t else 0
    rng = random.Random(3)
    for _ in range(600):
        text = "".join(rng.choice(["the", " ", "  ", "\n", "don't", " a", "x.", "\t", "12", " é", "日本", " "]) for _ in range(rng.randint(0, 60)))
        tree = editcount.Tree(text, count, leaf=rng.choice([1, 5, 20]))
        for _ in range(4):
            a = rng.randint(0, len(tree.text))
            b, new = rng.randint(a, min(len(tree.text), a + 10)), rng.choice(["", " ", "x", "  y", "'s", "\n", " foo bar baz qux"])
            want = tree.text[:a] + new + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == want and tree.tokens == count(want)


def test_window_hashes_tell_windows_apart():
    rng = np.random.default_rng(1)
    h = common.word_hashes(" ".join(f"w{i}" for i in rng.integers(0, 3, 4000)).encode())
    for width in (1, 2, 3, 5, 8, 13, 20, 50):
        keys = common.window_hashes(h, width)
        truth = [tuple(h[i : i + width].tolist()) for i in range(len(h) - width + 1)]
        assert len(keys) == len(truth) and len(set(keys.tolist())) == len(set(truth)) == len(set(zip(keys.tolist(), truth, strict=True)))


def test_copies_meet_the_text_itself_before_the_matrix(spark, monkeypatch):
    """Copies of a text that are too far from each other to link, but link with it, are one group before groups are compared."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(200), 3):
            words[at] = f"x{i}a{at}"
        rows.append((i, " ".join(words)))
    sizes, written = {}, jaccard.written

    def counted(df, label):
        out = written(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))
    assert {r.component_id for r in out.collect()} == {0}
    assert sizes["met"] < 60 * 60  # all pairs of groups, once for each shared shingle, were 37,888


def test_license_blocks_are_compressed_with_every_template_first():
    """Compression ranks the templates of a block before wording confirms one."""
    scanner = licenses.Scanner([*licenses.TEMPLATES.items(), *licenses.FURTHER], licenses.TEXTS, 0.85)
    names = list(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        ranked = scanner.ranked(licenses.words_of(text), False)
        assert len(ranked) == len(licenses.TEMPLATES) + len(licenses.FURTHER)
        assert names.index(name) in ranked[:4]  # four of them differ by a word
    used, compared = [], scanner.compared
    scanner.compared = lambda own, template, lo, hi: used.append(tuple(template)) or compared(own, template, lo, hi)
    block = "Released under the MIT License. All rights reserved."
    first = scanner.ranked(licenses.words_of(block), False)[0]
    hits = licenses.hits_of(block, licenses.re.compile(licenses.WORDING), scanner)
    assert [h[2] for h in hits] == ["MIT", "proprietary"]
    assert used[0] == tuple(scanner.short[first][1])
