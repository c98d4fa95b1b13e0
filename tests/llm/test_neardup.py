import random
import re

import pyarrow as pa
import pytest

from .conftest import ODD, TWINS

from marginalia.llm import neardup


def brute(rows, width, percent=80):
    """Components over the exact links of all pairs."""
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    sets, parent = [], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(text)) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, len(sets[i]), least.get(root(i)), d == least.get(root(i)) ) for i, (d, _) in enumerate(rows)]


def variants(n, seed=1):
    """Many versions of one text, from nearly equal to rather different, and unrelated texts."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(140)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 8, 12])):
            w[r.randrange(len(w))] = f"v{r.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(n + i, " ".join(f"u{r.randrange(10_000)}" for _ in range(60))) for i in range(20)]
    r.shuffle(rows)
    return rows


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("group", [64, 5])
def test_large_group_with_strays(spark, frame, monkeypatch, group):
    monkeypatch.setattr(neardup, "GROUP", group)
    rows = variants(150)
    expected = brute(rows, 2)
    assert len({c for _, _, c, _ in expected}) > 25  # there are strays
    assert key(neardup.near_duplicates(frame(rows), width=2).collect()) == key(expected)


def test_odd_rows(spark, frame):
    out = neardup.near_duplicates(frame(ODD), width=2)
    assert key(out.collect()) == key(brute(ODD, 2))
    assert neardup.near_duplicates(frame([])).count() == 0


def test_equal_hashes_and_repeated_ids(spark, frame):
    """Words with equal polynomial hashes are told apart, and rows of one id are judged by their own texts."""
    r = random.Random(9)
    text = lambda k: " ".join(f"{k}{r.randrange(1000)}" for _ in range(60))
    other = lambda t: t.rsplit(" ", 1)[0] + " changed"
    a, b, c, d = (text(k) for k in "abcd")
    rows = [(1, a), (5, other(a)), (5, b), (9, other(b)), (None, c), (None, other(c)), (20, other(d)), (None, d), (None, d)]
    rows += [(30, f"{TWINS[0]} x"), (31, f"{TWINS[1]} x"), (32, TWINS[0]), (33, TWINS[1]), (34, f"{c} {TWINS[0]}"), (35, f"{a} {TWINS[1]}")]
    out = neardup.near_duplicates(frame(rows), width=2)
    assert key(out.collect()) == key(brute(rows, 2))
    kept = key(r[:2] for r in neardup.drop_near_duplicates(frame(rows), width=2).collect())
    assert (1, a) in kept and (5, b) in kept and (9, other(b)) not in kept and (20, other(d)) in kept and (None, d) not in kept
    assert [i for i, _ in sorted(kept)] == [1, 5, 20, 30, 31, 32, 33, 34]


def test_drop_keeps_one_of_each_group(spark, frame):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "z y x w v u t"), (3, "z y x w v u t"), (4, None), (4, None), (None, "q r s t u v"), (None, "q r s t u v"), (3, "of its own text here now")]
    out = neardup.drop_near_duplicates(frame(rows).selectExpr("*", "7 AS digest", "'y' AS `do.t`", "map('a', 1) AS print"))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([rows[0], rows[3], rows[5], rows[7], rows[9]], key=repr)
    assert out.columns == [*frame(rows).columns, "digest", "do.t", "print"]
    assert neardup.drop_near_duplicates(frame([])).count() == 0
    odd = neardup.drop_near_duplicates(frame(ODD))
    assert odd.count() == len({(i, t or "") for i, t in ODD}) - 1  # 4 and 5 have one text


def test_confirmation_reads_words():
    texts = ["a b c d e f", "a b c d e f", "a b c d e x", "p q r s t u"]
    assert neardup.similar_to_first(pa.array(texts), 2, 60).tolist() == [True, True, False]
    assert neardup.similar_to_first(pa.array(texts), 5, 80).tolist() == [True, False, False]


def test_salted_groups(spark, frame, monkeypatch):
    """Small groups, several salts and no broadcasts."""
    monkeypatch.setattr(neardup, "GROUP", 4)
    monkeypatch.setattr(neardup, "MEET", 2)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    rows = variants(120, 2)
    assert key(neardup.near_duplicates(frame(rows), width=2).collect()) == key(brute(rows, 2))


def test_pruning_bounds():
    least = neardup.least_matches(80, 1e-4)
    assert len(least) == neardup.HASHES // neardup.BATCH and least == sorted(least)
    assert all(m < 0.8 * n for m, n in zip(least, range(neardup.BATCH, neardup.HASHES + 1, neardup.BATCH)))


def mutual(n, seed=5):
    """n versions of one text that are linked with each other, each with a component of its own."""
    r = random.Random(seed)
    words = [f"w{r.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(words[:k] + [f"v{k}"] + words[k + 1 :]) for k in range(n)]
    sets = [rows for rows, _ in neardup.shingle_sets(pa.array(texts, pa.large_string()), 2)]
    signs = [neardup.signature(s[:, 0]).astype("uint8").tobytes() for s in sets]
    return [{"rid": i, "comp": i, "sign": g, "shingles": s[:, 0].astype("<u8").tobytes()} for i, (s, g) in enumerate(zip(sets, signs))]


@pytest.mark.parametrize("every", [False, True])
def test_links_of_a_group_grow_with_its_components(every):
    m = mutual(48)
    places = [(0, 0, m[:16], m[:16]), (0, 1, m[:16], m[16:]), (1, 1, m[16:], m[16:])]
    rows = [{"key": 7, "salt": 0, "gx": gx, "gy": gy, "xs": xs, "ys": ys} for gx, gy, xs, ys in places]
    batches = [pa.RecordBatch.from_pylist([row]) for row in rows]
    extra = (True,) if every else ()
    links = [(a, b) for out in neardup._link_groups(neardup.least_matches(80, 1e-4), 80, *extra)(batches) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())]
    assert len(links) == len(set(links)) == (48 * 47 // 2 if every else 47)
    reached = {0}
    for _ in range(48):
        reached |= {x for link in links if reached & {*link} for x in link}
    assert reached == set(range(48))


def test_refused_links_lose_no_others(spark, frame, monkeypatch):
    """Probable links that the words refuse, as with equal digests, take no true link of the bucket along."""
    real, tried = neardup._link_groups, []

    def loose(least, percent, every=False):
        tried.append(every)
        return real(neardup.least_matches(50, 1e-4), 50, every)

    monkeypatch.setattr(neardup, "_link_groups", loose)
    rows = variants(150, 3)
    assert key(neardup.near_duplicates(frame(rows), width=2).collect()) == key(brute(rows, 2))
    assert tried == [False, True]
