import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm.bpe import Codec, Encoder, Utf8Machine, decode_documents, encode_documents, round_trip
from tessella.llm.chunks import chunks, ignores_space, segments
from tessella.llm.packing import BestFit, pack
from tessella.llm.tokens import token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None,
    "",
    " \n\t",
    "It's the dog's 42 cats, THEY'RE <|endoftext|>x<|startoftext|> end.",
    "a\x1cb \x1d\x1e c\x85d e f　g",
    "Ünïcödé é é ́x ΣΑΣ İstanbul ﬁ ½ 漢字かな 😀👩‍👩‍👧 힣",
    "a" * 5000 + " " + "ab" * 3000 + "'ll",
    "$$$ %%% &&& *** !!!!!! ........ --- ___ </w> <w> \x00\x01",
    "x" * 70 + "é" * 70 + "," * 100,
    "​﻿­ zero",
]


def make(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, id string, n_tokens int")


def noise(rng, n):
    alphabet = "aeothnrs" * 4 + "ABC'0129.,!-_ \n\t" + "éßñçø漢ἄ😀<|>/w"
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def test_chunks_agree_with_the_library(library):
    assert ignores_space(library) and not ignores_space(Tokenizer.from_file(BYTE))
    rng = random.Random(0)
    for text in [t or "" for t in TEXTS] + [noise(rng, 300) for _ in range(200)]:
        whole = library.encode(text, add_special_tokens=False).ids
        assert [i for c in chunks(text) for i in library.encode(c, add_special_tokens=False).ids] == whole
        assert [c for s in segments(text, 40) for c in chunks(s)] == chunks(text)


def test_codec_agrees_with_the_library(library):
    codec, rng = Codec(WORD), random.Random(1)
    for text in [t or "" for t in TEXTS] + [noise(rng, 400) for _ in range(200)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert "".join(codec.decode(ids)) == library.decode(ids, skip_special_tokens=False)


def test_byte_level_codec_agrees_with_the_library():
    codec, rng, other = Codec(BYTE), random.Random(2), Tokenizer.from_file(BYTE)
    for text in [t or "" for t in TEXTS] + [noise(rng, 300) for _ in range(50)]:
        ids = other.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert "".join(codec.decode(ids)) == other.decode(ids, skip_special_tokens=False)
    odd = [rng.randrange(50_000) for _ in range(500)]
    assert "".join(codec.decode(odd)) == other.decode(odd, skip_special_tokens=False)


def test_transducer_keeps_bounded_memory_and_emits_early(library):
    codec, rng = Codec(WORD), random.Random(4)
    assert codec.m.lookahead < 1000
    for letters in ("ab", "a", "thein", "ing", "abcdefghijklmnopqrstuvwxyz", "0=-_"):
        for size in (3000, 9000):
            text = "".join(rng.choice(letters) for _ in range(size))
            pieces = [x for x, _ in library.pre_tokenizer.pre_tokenize_str(text)]
            ids, early = [], 0
            for piece in pieces:
                run = Encoder(codec.m)
                for c in piece:
                    got = [codec.m.vocab[t] for t in run.feed(c)]
                    early += len(got)
                    ids += got
                    assert len(run.held) <= run.window
                ids += [codec.m.vocab[t] for t in run.end()]
            assert ids == library.encode(text, add_special_tokens=False).ids
            assert early > 100 or len(pieces) > 1


def test_lookahead_suffices_for_a_small_merge_list(tmp_path):
    """All texts over a small alphabet: what has the lookahead behind it never changes."""
    import itertools
    import json

    rng = random.Random(8)
    for n in range(30):
        tokens, merges = ["a", "b"], []
        while len(merges) < 6:
            m = (rng.choice(tokens), rng.choice(tokens))
            if m[0] + m[1] not in tokens and len(m[0] + m[1]) <= 5:
                merges.append(list(m))
                tokens.append(m[0] + m[1])
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps({"model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}}))
        from tessella.llm.bpe import MergeList

        m = MergeList(str(path))
        if m.lookahead > 9:
            continue
        for text in itertools.product("ab", repeat=12):
            whole = m.merge(list(text))
            for cut in (10, 11):
                part, at = m.merge(list(text[:cut])), 0
                for a, b in zip(part, whole):
                    at += len(a)
                    if at > cut - m.lookahead:
                        break
                    assert a == b


def test_utf8_machine():
    rng = random.Random(3)
    for _ in range(400):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xE2, 0xED, 0xF0, 0xF4, 0x9F, 0x90, 0xFF]) for _ in range(rng.randrange(9)))
        machine = Utf8Machine()
        assert "".join([machine.feed(bytes([b])) for b in data]) + machine.end() == data.decode("utf-8", "replace")


def test_round_trip_query(spark, library):
    got = {r.doc_id: r for r in round_trip(make(spark, TEXTS), WORD).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    rows = encode_documents(make(spark, TEXTS), BYTE)
    back = {r.doc_id: r.text for r in decode_documents(rows, BYTE).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert round_trip(make(spark, []), WORD).count() == 0
    other = Tokenizer.from_file(BYTE)
    for r in round_trip(make(spark, TEXTS), BYTE).collect():
        ids = other.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(other.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_counts(spark, library):
    rng = random.Random(7)
    texts = TEXTS + [noise(rng, 500) for _ in range(50)] + ["the of and " * 2000]
    got = {r.doc_id: r for r in token_counts(make(spark, texts).repartition(20), WORD, frequent=50).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert {r.doc_id: r.n_tokens for r in token_counts(make(spark, texts), PIECE).collect()} == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}
    other = Tokenizer.from_file(BYTE)
    assert {r.doc_id: r.n_tokens for r in token_counts(make(spark, texts), BYTE).collect()} == {i: len(other.encode(t or "").ids) for i, t in enumerate(texts)}
    assert token_counts(make(spark, []), WORD).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = BestFit(10, 2)
    assert fit.put(6) == (0, 0) and fit.put(5) == (1, 0)
    assert fit.put(4) == (0, 6)  # full, closes
    assert fit.put(3) == (1, 5) and fit.put(9) == (2, 0)
    assert fit.put(8) == (3, 0)  # bin 2 was the fullest of two
    assert fit.open() == {1, 3}


@pytest.mark.parametrize("open_bins", [4, 256])
def test_pack(spark, library, open_bins):
    rng = random.Random(9)
    texts = TEXTS + ["".join(rng.choice(["the ", "cat ", "sat ", "zq "]) for _ in range(rng.randrange(900))) for _ in range(400)] + ["the " * 9000]
    rows = pack(make(spark, texts).repartition(6), WORD, size=512, open_bins=open_bins, round_bins=40).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.start for p in pieces] == list(range(0, len(ids), 512)) and [p.piece for p in pieces] == list(range(len(pieces)))
        for p in pieces:
            own = np.array(ids[p.start : p.start + 512], "<u4").tobytes()
            assert (p.length, p.ids_crc32, bytes(p.ids)) == (len(own) // 4, zlib.crc32(own), own)
    for pieces in by_bin.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p.length for p in pieces) <= 512
    total = sum(r.length for r in rows)
    assert len(by_bin) <= (1.06 if open_bins == 256 else 1.4) * total / 512 + 2
    assert pack(make(spark, []), WORD).count() == 0


def test_special_strings_in_other_cases_are_plain_text(spark, library):
    texts = ["<|ENDOFTEXT|>", "a<|EndOfText|>b", "<|StartOfText|>.", "<|endoftext|><|ENDOFTEXT|>", "A<|endoftext|>B Word, x<|startoftext|>Y."]
    counts = {r.doc_id: r.n_tokens for r in token_counts(make(spark, texts), WORD).collect()}
    trips = {r.doc_id: r for r in round_trip(make(spark, texts), WORD).collect()}
    pieces = {r.doc_id: r for r in pack(make(spark, texts + ["the " * 9000]).coalesce(1), WORD).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert counts[i] == trips[i].n_tokens == len(ids)
        assert trips[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert trips[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert bytes(pieces[i].ids) == np.array([*ids, 1], "<u4").tobytes()


def test_pieces_of_special_strings(spark, library):
    """Texts over an alphabet of pieces of the added tokens, in any case."""
    rng = random.Random(12)
    pieces = ["<|", "|>", "endoftext", "ENDOFTEXT", "EndOfText", "startoftext", "StartOfText", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<", "|", ">", " ", "a", "The", ".", ",", "'s", "é", "Ü", "7"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    counts = {r.doc_id: r.n_tokens for r in token_counts(make(spark, texts), WORD).collect()}
    trips = {r.doc_id: r.ids_sha256 for r in round_trip(make(spark, texts), WORD).collect()}
    packed = {r.doc_id: bytes(r.ids) for r in pack(make(spark, texts), WORD).collect()}
    for i, own in enumerate(ids):
        assert counts[i] == len(own)
        assert trips[i] == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert packed[i] == np.array([*own, 1], "<u4").tobytes()


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "one two", "x", 1), (None, None, "x", 1), (3, "three", "x", 1), (3, "three", "x", 1), (3, "four four", "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    for out in (token_counts(docs, WORD), round_trip(docs, WORD)):
        assert [(r.doc_id, r.n_tokens) for r in sorted(out.collect(), key=key)] == [(3, 1), (3, 1), (3, 2), (None, 0), (None, 2)]
    packed = pack(docs, WORD).collect()
    assert sorted((r.doc_id or 0, r.length) for r in packed) == [(0, 1), (0, 3), (3, 2), (3, 2), (3, 3)]
    by_bin = {}
    for r in sorted(packed, key=lambda r: r.offset):
        assert r.offset == by_bin.get(r.sequence_id, 0)
        by_bin[r.sequence_id] = r.offset + r.length
