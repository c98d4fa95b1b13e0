"""The prefix trie against dictionaries of all prefixes, and against its SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from marginalia.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c, q in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        built[c] = own.get(c - (abs(c) % 5 if c > 0 else -(abs(c) % 5)), [])[:h] + q[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, q in built.items():
        for d in range(len(q) + 1):
            members[tuple(q[:d])].append(c)
        ends[tuple(q)].append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += children[k] == 0
    for k, m in members.items():
        yield min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()


def _rows(seed, convs=120):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(-60, 400), convs):
        script = r.choice([0, 0, 0, 1, 2, c])
        for t in range(r.choice([1, 2, 3, 4, 6, 9, 12, 20, 33])):
            odd = r.random()
            same = script if r.random() < 0.97 else c
            out.append((c, None if odd < 0.02 else t, None if odd > 0.98 else "user" if t % 2 else "assistant", None if 0.5 < odd < 0.52 else f"turn {same} é {t}"))
        if r.random() < 0.1:
            out.append(out[-1])
    r.shuffle(out)
    return [*out, (None, 1, "user", "of nobody"), (1_000, None, None, None), (2_000, 0, "user", "x" * 100_000), (2_003, 0, "user", "x" * 100_000), (3_001, 0, "a", "b\nc"), (3_002, 0, "a\nb", "c")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS home", "2 AS hi", "3 AS fix")


@pytest.mark.parametrize("rebuild", [True, False])
def test_against_brute_force(spark, rebuild):
    rows = _rows(1)
    out = prefix_trie.prefix_trie(frame(spark, rows), rebuild)
    assert Counter(map(tuple, out.collect())) == Counter(brute(rows, rebuild))


def test_small_chunks_batches_and_ranges(spark, monkeypatch):
    """Prefixes that many tries share count once below those above them."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    monkeypatch.setattr(prefix_trie, "BATCH", 3)
    monkeypatch.setattr(prefix_trie, "LEADING", 1)
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    rows = _rows(2)
    assert Counter(map(tuple, prefix_trie.prefix_trie(frame(spark, rows)).collect())) == Counter(brute(rows))


def test_equal_conversations_and_chains_of_prefixes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 300)
    rows = [(c, t, "user", f"{t}") for c in range(0, 400, 5) for t in range(7)] + [(c, t, "user", f"{t}") for c in range(1000, 1200, 5) for t in range((c - 1000) // 5 + 1)]
    assert Counter(map(tuple, prefix_trie.prefix_trie(frame(spark, rows)).collect())) == Counter(brute(rows))


def test_sql_and_columns(spark, tmp_path):
    rows = _rows(3, 60)
    frame(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations/*.parquet'")
    found = db.execute(prefix_trie.ORACLE_SQL)
    assert [c[0] for c in found.description] == prefix_trie.prefix_trie(frame(spark, rows)).columns
    assert Counter(found.fetchall()) == Counter(brute(rows))


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).collect() == []
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "a", "b")])).collect() == []


def test_handles_and_exits():
    """Each node is found under its handle and first prefix, exits are those of a search turn by turn, and take steps with the logarithm of the length."""
    r = random.Random(4)
    for _ in range(30):
        lists = [[bytes([r.choice([1, 1, 1, 2])]) * 16 for _ in range(r.choice([0, 1, 2, 5, 9, 40]))] for _ in range(60)]
        trie = prefix_trie.ZFastTrie()
        for at in range(0, 40, 8):
            trie.insert([prefix_trie.chain_of(x) for x in lists[at : at + 8]])
        inside = {p for c in trie.chains for p in c}
        assert len(trie.handles) == len(trie.names) == len(trie.low) - 1
        for v in range(1, len(trie.low)):
            chain = trie.chains[trie.shown[v]]
            f = prefix_trie.fattest(trie.low[v], trie.deep[v])
            assert trie.low[v] < f <= trie.deep[v] and all(f & -f >= k & -k for k in range(trie.low[v] + 1, trie.deep[v] + 1))
            assert trie.handles[chain[f]] == v == trie.names[chain[trie.low[v] + 1]]
        for x in lists:
            chain = prefix_trie.chain_of(x)
            v, at = trie.exit(chain)
            assert at == max(d for d, p in enumerate(chain) if p in inside)
            assert trie.low[v] < at <= trie.deep[v] and trie.chains[trie.shown[v]][at] == chain[at]
        assert sorted(c for e in trie.ends for c in e) == list(range(40))
    looked = []

    class Counted(dict):
        def get(self, *key):
            looked.append(key)
            return super().get(*key)

    trie.handles = Counted(trie.handles)
    trie.exit(prefix_trie.chain_of([bytes([1]) * 16] * 40))
    assert len(looked) <= 7
