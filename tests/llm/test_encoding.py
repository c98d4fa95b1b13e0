"""BPE, token files and unigram counts against the tokenizers library."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, normalizers

from marginalia.llm import bpe, token_files, unigram_counts
from marginalia.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, classes

from .conftest import ODD, TWINS

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "1", "23", "!", " '", "'s", "日本", "🙂", "<|endoftext|>", "x" * 70, "ñ", " ", "'LL", "\r\n", "ꟊ", "٣", "<0x0A>", "▁", "the ", "tion", "͸"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(600)]
    return [*rows, *((10_000 + i if d is None else 1_000 + 10 * d + k, t) for k, (i, (d, t)) in enumerate(enumerate(ODD))), (20_000, "<|endo"), (20_001, "ftext|>"), (20_002, "é" * 400)]


def test_character_classes_are_the_librarys():
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    table = classes()
    for c in [*range(0x3000), *range(0xA640, 0xAC00), *range(0x1C80, 0x1C90), *range(0x105C0, 0x10600)]:
        kind = LETTER if split(f"a{chr(c)}!")[0][1] == (0, 2) else OTHER if split(f"!{chr(c)}!")[-1][1] == (0, 3) else NUMBER if split(f"1{chr(c)}!")[0][1] == (0, 2) else SPACE
        assert c == 32 or table[c] == kind, hex(c)


def test_round_trips(spark, frame, texts):
    library = Tokenizer.from_file(BPE)
    out = {r.doc_id: r for r in bpe.round_trip_digests(frame(texts), BPE).collect()}
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert tuple(out[doc_id]) == (doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_words_with_equal_hashes(spark, frame):
    """Two different words for which the hash of the table is the same have their own ids and counts."""
    from marginalia.llm.pretokens import Chars

    chars = Chars(list(TWINS))
    hashes = chars.hashes(chars.offsets[:-1], chars.offsets[1:])
    assert hashes[0] == hashes[1] and TWINS[0] != TWINS[1]
    library = Tokenizer.from_file(BPE)
    rows = [(1, TWINS[0]), (2, TWINS[1]), (3, f"{TWINS[1]} {TWINS[0]}"), (4, TWINS[0] + TWINS[1])]
    trips = {r.doc_id: r for r in bpe.round_trip_digests(frame(rows), BPE).collect()}
    files = {r.doc_id: r for r in token_files.written_index(frame(rows), BPE, 2).collect()}
    for doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert trips[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert trips[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert files[doc_id].ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
    words = unigram_counts.Vocabulary([("<unk>", 0.0), ("a", -1.0), ("b", -2.0), (TWINS[1][:9], -1.0)])
    memo = token_files.Memo(unigram_counts._Counts(words), 50)
    assert unigram_counts.totals(list(TWINS), memo)[0] == [words.best("▁" + t)[0] for t in TWINS]


def test_encode_and_decode(spark, frame, texts):
    ids = bpe.encode(frame(texts), BPE)
    assert {r.doc_id: r.text for r in bpe.decode(ids, BPE).collect()} == {d: t or "" for d, t in texts}
    assert bpe.round_trip_digests(frame([]), BPE).count() == 0


def test_memo_that_overflows(spark, texts):
    from marginalia.llm.pretokens import Chars, Memo, pretoken_starts

    memo = Memo(bpe._Digests(BPE), 50)
    for k in range(0, 600, 40):
        chars = Chars([t or "" for _, t in texts[k : k + 40]])
        starts = pretoken_starts(chars, "<|endoftext|>")
        numbers = memo.numbers(chars, starts)
        assert b"".join(memo.work.decoded[i] for i in numbers).decode() == chars.text


def test_rank_coding():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (r.integers(0, 2**32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_files.encode_ranks(ranks)
        assert len(control) == -(-n // 4) and (token_files.decode_ranks(control, data, n) == ranks).all()


def test_token_files(spark, frame, texts):
    library, start = Tokenizer.from_file(BPE), 0
    out = token_files.written_index(frame(texts), BPE, 2).orderBy("doc_id").collect()
    for (doc_id, text), row in zip(sorted(texts), out, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd = token_files.written_index(frame(ODD), BPE, 2).collect()
    assert len(odd) == len(ODD) and sorted(r.start for r in odd)[0] == 0
    assert token_files.written_index(frame([]), BPE, 2).count() == 0


def test_unigram_counts(spark, frame, texts):
    library = Tokenizer(models.Unigram(unigram_counts.pieces_of(PIECES), 0, True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    out = {r.doc_id: r for r in unigram_counts.token_counts(frame(texts), PIECES).collect()}
    for doc_id, text in texts:
        assert (out[doc_id].n_tokens, out[doc_id].n_chars) == (len(library.encode(text or "", add_special_tokens=False).ids), len(text or ""))
    assert unigram_counts.token_counts(frame([]), PIECES).count() == 0


def test_unigram_counts_with_fractions_and_ties():
    """Scores like 0.1 round differently from different starts, and many paths tie or nearly tie."""
    r = random.Random(3)
    for _ in range(30):
        scored = {"<unk>": 0.0} | {c: -r.choice([0.1, 0.2, 0.3, 0.7]) for c in "abcd▁"}
        for _ in range(25):
            scored.setdefault("".join(r.choice("abcd▁") for _ in range(r.randint(2, 4))), -r.choice([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]))
        library = Tokenizer(models.Unigram(list(scored.items()), 0, False))
        library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        memo = token_files.Memo(unigram_counts._Counts(unigram_counts.Vocabulary(list(scored.items()))), 100)
        texts = ["".join(r.choice("abcd ") for _ in range(r.randint(1, 120))) for _ in range(60)]
        assert unigram_counts.totals(texts, memo)[0] == [len(library.encode(t).ids) for t in texts]


def test_unbroken_text_takes_bounded_memory():
    words = unigram_counts.vocabulary(PIECES)
    text = "abcdefghij" * 30_000
    tracemalloc.start()
    words.best(text)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 40 * len(text)
