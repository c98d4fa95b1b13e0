"""Alignment of two tokenizers against a brute force over byte ranges, with the libraries' own encodings."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from marginalia.llm import alignment
from marginalia.llm.bpe import byte_letters

from .conftest import ODD

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
NONE = (0, 0, 0, 0, 0, 0, "")


def brute(texts):
    """The rows of aligned_counts, in order."""
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    of_letter = {c: i for i, c in enumerate(byte_letters())}
    linked, groups = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(whole.decode(), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(of_letter[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            linked.append([]), groups.append(None)
            continue
        ends = lambda raw: np.cumsum([len(x) for x in raw]).tolist()
        ea, eb = ends(raw_a), ends(raw_b)
        linked.append([(ids_a[i], ids_b[j]) for i in range(len(ea)) for j in range(len(eb)) if max(ea[i] - len(raw_a[i]), eb[j] - len(raw_b[j])) < min(ea[i], eb[j])])
        out, low = [], 0
        for cut in sorted(set(ea) & set(eb)):
            part = lambda ids, at: ",".join(str(i) for i, e in zip(ids, at) if low < e <= cut)  # noqa: B023, E731
            out.append(f"{part(ids_a, ea)}|{part(ids_b, eb)}")
            low = cut
        groups.append((len(ids_a), len(ids_b), out))
    held = Counter(p for x in linked for p in set(x))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for pairs, g in zip(linked, groups):
        if g is None:
            yield NONE
        else:
            yield (g[0], g[1], len(g[2]), len(pairs), sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(";".join(g[2]).encode()).hexdigest())


def _texts():
    r = random.Random(3)
    parts = ["a", "é", "the ", "tion", " ", "  ", "\n", "\t", "日本", "🙂", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "'s", "1234", "ﬁ", "　", "\xa0", "\0", "ñandú ", "hello world ", "Donaudampf", "!!", " the"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(150)]
    odd = [(i if i is None else 1000 + k, t if t is None else t[:20_000]) for k, (i, t) in enumerate(ODD)]
    return [*rows, *odd, (2000, "a▁b"), (2001, "▁"), (2002, " "), (2003, " " * 50 + "x"), (2004, "word " * 1500), (2005, "\0")]


def test_against_brute_force(spark, frame, monkeypatch):
    monkeypatch.setattr(alignment, "LANE", 16)
    rows = _texts()
    out = alignment.aligned_counts(frame(rows), BPE, PIECES)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = Counter(tuple(x) for x in out.collect())
    assert got == Counter((d, *x) for (d, _), x in zip(rows, brute([t for _, t in rows])))


def test_several_blocks_and_an_empty_table(spark, frame, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 100)
    rows = [(i, t) for i, (_, t) in enumerate(_texts()[:120])]
    texts = frame(rows).repartition(5)
    blocks = alignment.blocks(texts.select("doc_id", "text"), BPE, PIECES)
    assert blocks.count() >= 5 and blocks.select("block").distinct().count() == blocks.count()
    got = {x.doc_id: tuple(x)[1:] for x in alignment.aligned_counts(texts, BPE, PIECES).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute([t for _, t in rows]))}
    assert alignment.aligned_counts(frame([]), BPE, PIECES).collect() == []


def test_lanes_of_a_long_text_run_side_by_side():
    """A text of n tokens takes about as many steps as a lane has tokens, and the links of one long merge."""
    r = np.random.default_rng(1)
    n = 40_000
    a, b = (np.sort(r.choice(np.arange(1, 4 * n), n, replace=False)) for _ in range(2))
    a, b = np.append(a, 4 * n), np.append(b, 4 * n)
    first = np.array([0, n + 1])
    starts, _ = alignment.lanes(a, b, first, first)
    assert len(starts) > n / alignment.LANE / 2 and np.diff(starts).max() < 3 * alignment.LANE
    at_a, at_b, a_cut, b_cut = alignment.lockstep(a, b, first, first)
    links, i, j = set(), 0, 0
    while i <= n:
        links.add((i, j))
        i, j = i + (a[i] <= b[j]), j + (b[j] <= a[i])
    assert len(at_a) == len(links) and set(zip(at_a.tolist(), at_b.tolist())) == links
    assert a[a_cut].tolist() == b[b_cut].tolist() == np.intersect1d(a, b).tolist()


def test_vocabulary_bytes_cover_the_file():
    with open(BPE, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    sizes = alignment.byte_bpe(BPE).sizes
    assert all(sizes[i] == len(t) for t, i in vocabulary.items() if t != "<|endoftext|>")
