"""Token counts, packing, secrets, licenses, decontamination against brute force."""
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm_helpers import make, odd_texts  # noqa: F401
from subseg.llm import bm25_decontam as B
from subseg.llm import license_scan, packing, queries, secret_scan, unigram_counts
from subseg.llm.queries import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")
WORD_BPE = tokenizer_path("word_bpe_49k.json")
TEXTS = odd_texts() + ["don't can't WE'LL x's!! ¿qué? 1234 naïve é <|endoftext|> a b", "▁a▁▁b <0x41> \U0001f600", "ñandú straße " * 50, "été l'été"]


def unigram(vocab, byte_fallback):
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Replace(Regex("[ \\t-\\r]+"), " "), normalizers.Strip()])
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids) if (x or "").strip(" \t\n\r\x0b\x0c") else 0


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts(spark, make, fallback):
    # the library falls back to byte pieces of its vocabulary, and matches their names in texts too: those texts are left to the next test
    count = unigram([("<unk>", 0.0), *unigram_counts.load_vocab(PIECES), *((f"<0x{b:02X}>", 0.0) for b in range(256) if fallback)], fallback)
    texts = [t for t in TEXTS if not (fallback and t and "<0x" in t)]
    got = unigram_counts.token_counts(make(texts).repartition(3), PIECES, byte_fallback=fallback).toPandas().set_index("doc_id")
    assert got.n_tokens.sort_index().tolist() == [count(t) for t in texts]


@pytest.mark.parametrize("fallback", [True, False])
def test_ties(fallback):
    """Small vocabularies with equal scores: the tokenizer's own choice among equals is counted."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        pieces = {"".join(rng.choice(list("ab▁"), rng.integers(1, 5))) for _ in range(8)}
        vocab = [("<unk>", 0.0), *((p, float(-rng.integers(1, 4))) for p in sorted(pieces))]
        count, own = unigram(vocab, False), unigram_counts.CountOnlyViterbi(vocab, False)
        for _ in range(20):
            word = "".join(rng.choice(list("abc"), rng.integers(1, 12)))
            assert own.word(word) == count(word), (vocab, word)


def test_packing_round_trip(spark, make):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    got = packing.pack_documents(make(TEXTS * 3, range(3 * len(TEXTS))).repartition(4), WORD_BPE, group=20).toPandas()
    for i, t in enumerate(TEXTS * 3):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own, at = got[got.doc_id == i].sort_values("start"), 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048


def test_control_and_byte_pieces_are_not_matched_in_texts():
    vocab = dict(unigram_counts.load_vocab(PIECES))
    assert not {"<unk>", "<s>", "</s>", "<0x0A>"} & set(vocab) and len(vocab) > 30_000
    count, own = unigram([("<unk>", 0.0), *vocab.items()], False), unigram_counts.CountOnlyViterbi(list(vocab.items()), False)
    for word in ("a</s>b", "x<0x0A>y", "<s>", "<0x41>"):
        assert own.word(word) == count(word) > 2


def test_word_ids_are_the_tokenizers():
    """Random words of letters, digits, marks, composed and decomposed characters, special tokens."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    tok, own = Tokenizer.from_file(WORD_BPE), packing.WordTokens(WORD_BPE)
    signs = list("abcXYZ019.,-_<|>'$\u00e9\u00c9e\u0301\u0130\u03a3\u03c2\u00df\u4e2d\u00a0\u2028\u0660\u00b2\U0001f600\u00ff\u00dd\u00d7\u00f7\u00aa\u00b5\u00f1") + ["'s", "'LL", "<|endoftext|>", "the"]
    for _ in range(3000):
        word = "".join(rng.choice(signs, int(rng.integers(1, 9))))
        assert np.frombuffer(own.word(word), np.uint32).tolist() == tok.encode(word, add_special_tokens=False).ids, repr(word)


def test_another_kind_of_tokenizer_file_is_refused(tmp_path):
    import json

    said = json.load(open(WORD_BPE, encoding="utf8"))
    said["normalizer"]["normalizers"] = said["normalizer"]["normalizers"][:2]  # keeps capitals
    (tmp_path / "other.json").write_text(json.dumps(said))
    with pytest.raises(ValueError, match="normalizer"):
        packing.WordTokens(str(tmp_path / "other.json"))


def test_words_met_again_keep_their_ids(monkeypatch):
    """Generations of words turn over many times."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "KEEP", 7)
    tok, own = Tokenizer.from_file(WORD_BPE), packing.WordTokens(WORD_BPE)
    rng = np.random.default_rng(8)
    words = [f"w{i}\u00e9, x{i}" for i in range(40)]
    for _ in range(30):
        texts = [" ".join(rng.choice(words, 5)) for _ in range(3)]
        off, ids = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_ids_of_control_characters():
    """Control characters are no white space; each is a byte with ids of its own."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    tok, own = Tokenizer.from_file(WORD_BPE), packing.WordTokens(WORD_BPE)
    control = [chr(c) for c in (*range(0x09), *range(0x0E, 0x20), 0x7F)]
    words = [*control, "a\x00b", "a\x1b[0m", "\x7f's"]
    words += ["".join(rng.choice([*control, *"aZ09.<|'\u00e9"], int(rng.integers(1, 9)))) for _ in range(1000)]
    for word in words:
        assert np.frombuffer(own.word(word), np.uint32).tolist() == tok.encode(word, add_special_tokens=False).ids, repr(word)


def test_best_fit_is_the_tightest():
    rng = np.random.default_rng(2)
    for size in (1, 2, 7, 64, 100):
        lengths = rng.integers(1, size + 1, 300)
        window, offset = packing.best_fit_decreasing(lengths, size)
        free: dict[int, int] = {}
        for p in np.argsort(-lengths, kind="stable"):
            fits = [c for c in free.values() if c >= lengths[p]]
            w = window[p]
            if fits:
                assert free[w] == min(fits)
            else:
                assert w not in free
                free[w] = size
            assert offset[p] == size - free[w]
            free[w] -= lengths[p]


def secrets_of(t):
    t = t or ""
    spans = []
    for kind, pattern, ok in (
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ):
        spans += [(m.start(), secret_scan.KINDS.index(kind), m.end()) for m in re.finditer(pattern, t) if ok(m)]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
        s = m[0]
        if not re.search("[0-9]", s) or any(re.search(p, s) for p in secret_scan.ALLOW):
            continue
        limit = secret_scan.THRESHOLDS["hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "mixed"]
        entropy = max(-sum(c / 20 * math.log2(c / 20) for c in collections.Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))
        if round(entropy, 9) >= limit and not any(a <= m.start() and b >= m.end() for a, k, b in spans if k < 3):
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


SECRETS = TEXTS + [
    "x token = password: abcdefghijklmnop", "TOKEN='abc.def/ghi=jkl' secret:short", "API_KEY = zzzzzzzzzzzz apikey=\"AAAABBBBCCCC\"", "AKIAAKIAABCDEFGHIJ AKIA12 AKIA" + "9" * 30,
    "é é é 0123456789abcdef 漢 token=0123456789abcdef0123", "key kJ8s7Dh2Lq0Pz5Xv9Bn3Mw6R end", "uuid 123e4567-e89b-12d3-a456-426614174000", "n " + "1" * 40, "A1" * 30, "path /usr/local/lib/python3/site-packages",
    "QmFzZTY0IGVuY29kZWQgc2VjcmV0IDEyMzQ1Njc4OTA=", "0123456789ABCDEF0123456789ABCDEF", "deadbeef" * 4, "a" * 19 + "1", "password\x0c=abcdefghijklmnop",
]


def test_secret_spans(spark, make):
    got = secret_scan.scan_secrets(make(SECRETS)).orderBy("doc_id").collect()
    assert [[tuple(s) for s in r.secret_spans] for r in got] == [secrets_of(t) for t in SECRETS]
    assert any(s[1] == 3 for t in SECRETS for s in secrets_of(t))


def test_redaction(spark, make):
    got = [r.text for r in secret_scan.redact(make(SECRETS)).orderBy("doc_id").collect()]
    for t, clean in zip(SECRETS, got):
        spans = secrets_of(t)
        if not spans:
            assert clean == t
            continue
        want, at = "", 0
        for a, _, b in spans:
            if a >= at:
                want += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert clean == want + t[at:]


def test_secret_digest(spark, make, tmp_path):
    make(SECRETS).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op8_secret_scan(spark, str(tmp_path)).collect():
        base = [s for s in secrets_of(SECRETS[r.doc_id]) if s[1] < 3]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()


def test_licenses_are_retrieved(spark, make):
    rng = np.random.default_rng(6)
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    texts, want = [], []
    for k, (_, t) in enumerate(license_scan.TEMPLATES):
        for before in (0, 3, 64, 200):
            words = t.split()
            if len(words) > 40:  # a small edit leaves enough shingles
                words[20] = "changed"
            texts.append(f"{filler(before)} {' '.join(words)} {filler(90)}")
            want.append(k)
    texts += [filler(400), "", None, "Released under the MIT", "under MIT License Released the"]
    docs = make(texts)
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(docs).collect()}
    every = {r.doc_id: r.licenses for r in license_scan.scan_licenses(docs, retrieve=False).collect()}
    names = [lic for lic, _ in license_scan.TEMPLATES]
    for i, k in enumerate(want):
        assert names[k] in {x.license for x in got[i]}, texts[i]
    assert all(not got[i] for i in range(len(want), len(texts)))
    # what verification of every window against every template finds is retrieved by the bands
    found = {(i, x.template) for i, v in got.items() for x in v}
    assert found == {(i, x.template) for i, v in every.items() for x in v}


@pytest.mark.parametrize("window,size,shared", [(16, 5, 5), (16, 5, 4), (16, 6, 5), (16, 8, 6), (16, 32, 16), (128, 33, 33), (128, 33, 25), (128, 64, 48), (128, 128, 96)])
def test_bands_meet(window, size, shared):
    """Recall of the bands over random templates, whole or at the containment threshold, in windows of other shingles."""
    rng = np.random.default_rng(window * size + shared)
    masks = np.array(license_scan.MASKS, np.int64)
    hashes = lambda n: rng.integers(-(2**63), 2**63, n)
    hit = 0
    for _ in range(2000):
        template, foreign = hashes(size), hashes(window - shared)
        least = (template ^ masks[:, None]).min(axis=1)
        hit += bool((least == (np.concatenate([template[:shared], foreign]) ^ masks[:, None]).min(axis=1)).any())
    assert hit >= 0.99 * 2000, hit / 2000


def filler(n, rng=np.random.default_rng(6)):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def test_bands_retrieve_templates(make):
    """300 random templates of 9 to 150 words, a quarter of their shingles lost at most: all are found."""
    rng = np.random.default_rng(11)
    custom = [(f"t{k}", " ".join(f"w{x}" for x in rng.integers(0, 5000, 9 + k % 142))) for k in range(300)]
    texts = []
    for _, t in custom:
        words = t.split()
        if len(words) > 40:  # five shingles of over 36
            words[18] = "changed"
        texts.append(" ".join([filler(int(rng.integers(0, 40))), *words, filler(60)]))
    got = {r.doc_id: {x.license for x in r.licenses} for r in license_scan.scan_licenses(make(texts), custom).collect()}
    assert sum(custom[i][0] in got[i] for i in range(300)) >= 298


def test_repeated_notice(make):
    """A text that repeats notices a thousand times: one hit a template, its first best window."""
    notice = "Licensed under the Apache License, Version 2.0."
    (row,) = license_scan.scan_licenses(make([f"{notice} {filler(3)} " * 1000])).collect()
    assert len({x.template for x in row.licenses}) == len(row.licenses) and "Apache-2.0" in {x.license for x in row.licenses}
    assert all(x.first_shingle < 40 for x in row.licenses if x.containment == 1.0)


def test_short_notices_and_template_tails(make):
    """Templates below five words, and text that quotes a long template's last part alone."""
    notices = {"All rights reserved.": "All-Rights-Reserved", "SPDX-License-Identifier: MIT": "MIT"}
    texts = [t for n in notices for t in (n, f"some words first {n} and then others", f"x\n{n.upper()}\n")]
    texts += ["all rights are reserved", "rights reserved all", "all rights", None]
    got = {r.doc_id: {x.license for x in r.licenses} for r in license_scan.scan_licenses(make(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [{v} for v in notices.values() for _ in range(3)] + [set()] * 4
    words = [f"v{i}" for i in range(172)]
    custom = [("one", "Foolicense"), ("two", "MIT License"), ("none", " . "), ("tail", " ".join(words))]
    found = license_scan.scan_licenses(make(["a Foolicense b", "the mit-license", "mit and license", " ".join(["before it", *words[-44:], "and after"])]), custom).collect()
    want = {0: [("one", 1, 1.0)], 1: [("two", 1, 1.0)], 2: [], 3: [("tail", 0, 1.0)]}
    assert {r.doc_id: [(x.license, x.first_shingle, x.containment) for x in r.licenses] for r in found} == want


def test_leaks(spark, make):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9))))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    tests = [f"{sentence(int(rng.integers(8, 40)))} {sentence(int(rng.integers(3, 12)))}" for _ in range(60)] + [sentence(200) + " " + sentence(4), "Two words", None, "..."]
    docs, leaks = [], set()
    for i in range(150):
        parts = [sentence(int(rng.integers(5, 30))) for _ in range(int(rng.integers(1, 30)))]
        if i % 3 == 0:
            k = i // 3 % 61
            quoted = tests[k] if i % 2 else tests[k].upper().replace(".", " !!")
            parts.insert(int(rng.integers(0, len(parts) + 1)), quoted)
            leaks.add((i, k))
        if i % 3 == 1:  # the question alone is no leak
            parts.append(B.split_item(tests[i % 60])[0])
        docs.append(" ".join(parts))
    items = spark.createDataFrame(list(enumerate(tests)), "item_id long, text string")
    for size in (1000, 17):
        got = {(r.doc_id, r.item_id) for r in B.find_leaks(make(docs).repartition(3), items, items_per_index=size).collect()}
        assert got == leaks
    kept = {r.doc_id for r in B.drop_leaks(make(docs), items).collect()}
    assert kept == set(range(150)) - {d for d, _ in leaks}


def test_wand_finds_what_a_full_scan_finds():
    rng = np.random.default_rng(4)
    tests = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, 30) % 400)) for i in range(100)]
    index = B.build_index(tests, threshold=0.3)
    dense = np.zeros((len(index.terms), len(tests)))
    for t in range(len(index.terms)):
        s = slice(index.ptr[t], index.ptr[t + 1])
        dense[t, index.item[s]] = index.impact[s]
    np.testing.assert_allclose(dense.sum(axis=0), 1.0)
    for _ in range(300):
        terms = np.unique(rng.integers(0, len(index.terms), int(rng.integers(1, 200))))
        got, score = B.search(index, terms)
        want = dense[terms].sum(axis=0)
        assert got.tolist() == np.flatnonzero(want >= 0.3 - 1e-9).tolist()
        np.testing.assert_allclose(score, want[got])
        # the pivot never skips a passage that reaches the threshold
        if len(got):
            assert index.most[terms][index.essential[terms]].sum() >= 0.3 - index.common_most - 1e-9


def test_leaks_in_other_case_and_composition(spark, make):
    """Quotations in upper case, with ß as SS, and with decomposed accents."""
    import unicodedata

    texts = [
        "El niño pequeño comió piñas según contó su tía Inés. La canción más antigua sonó allí después.",
        "Die größte Straße führt über Flüsse, Wälder und Hügel. Außerdem heißt sie für Gäste schöne Allee.",
        "Un élève très âgé préféra l'été à la forêt près du château. Où était le théâtre détruit là-bas?",
    ]
    docs = [f"vorher {t.upper()} nachher" for t in texts] + [f"before {unicodedata.normalize('NFD', t)} after" for t in texts] + ["nothing of that"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in B.find_leaks(make(docs), items).collect()}
    assert set(got) == {(i, i % 3) for i in range(6)}
    assert all(r.question_overlap == r.answer_overlap == 1 for r in got.values())
    assert {r.doc_id for r in B.drop_leaks(make(docs), items).collect()} == {6}


def test_scores_do_not_depend_on_blocks(spark, make):
    """Counts come from all items; a very long item doesn't widen the passages of others."""
    rng = np.random.default_rng(11)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 4000) % 600]
    tests = [(k, " ".join(words[40 * k : 40 * k + 12 + k]) + ".") for k in range(30)]
    docs = [" ".join(words[50 * k : 50 * k + 300]) for k in range(40)]

    def found(rows, size):
        items = spark.createDataFrame(rows, "item_id long, text string")
        return {(r.doc_id, r.item_id): (round(r.score, 9), r.first_word) for r in B.find_leaks(make(docs), items, items_per_index=size).collect()}

    whole = found(tests, 20_000)
    assert len(whole) > 30 and found(tests, 7) == whole
    with_long = found([*tests, (99, " ".join(f"v{i}" for i in range(900)))], 20_000)
    both = whole.keys() & with_long.keys()
    assert len(both) > 30 and all(whole[k][1] == with_long[k][1] for k in both)
    assert [B.length_class(n) for n in (0, 1, 64, 65, 128, 129, 256, 257)] == [0, 0, 0, 1, 1, 2, 2, 3]


def test_item_parts():
    assert B.split_item("A b. C d?") == ("A b.", "C d?")
    assert B.split_item("Only one") == ("Only one", "Only one")
