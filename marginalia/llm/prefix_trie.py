"""Prefixes that conversations share, by a Z-fast trie.

A turn is told by a 128-bit cryptographic digest of its role and text, and a prefix of a conversation by a
digest that takes in one turn after the other.  A compacted trie keeps a node only where conversations part or
end, with the depths of its edge.  Each node stands in a hash table under its handle, the prefix
whose length is the two-fattest number of its edge.  A conversation finds its exit, the place where it leaves
the trie, by fat binary search: it looks up its prefix of the two-fattest length between what is known to be
inside and its own length, and goes on above or below, so it takes steps with the logarithm of its
length.  A batch finds all its exits first.  Then the edges are split at all of them, each place gets one leaf
for each turn that follows, and those that wait behind such a leaf look for their exits again.

Conversations are dealt by ranges of their first turns and their ids, so that those which share much meet, and
a group of equal ones is spread over tasks.  Each task builds tries of CHUNK turns at most, expands
their edges to one row for each depth, and Spark sums these rows by prefix.  What lies below a node is summed in
the tries; a prefix that several of them have would count several times, so the excess is taken off along one
conversation of each such prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytetext import release_memory
from .storage import saved

#: Turns of the conversations of a trie, at about 250 bytes each; a longer conversation has a trie by itself.
CHUNK = 500_000
#: Conversations that are inserted at a time.
BATCH = 4096
#: Turns by which conversations are dealt.
LEADING = 8
#: Ids of a range that are hashed in one piece.
RUN = 4096
ROOT = b"\0" * 16


def fattest(a: int, b: int) -> int:
    """The number in (a, b] that is divisible by the highest power of two."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


def chain_of(turns: list[bytes]) -> list[bytes]:
    """The digests of all prefixes of a conversation, from the empty one on."""
    out, last, blake = [ROOT], ROOT, hashlib.blake2b
    for t in turns:
        last = blake(last + t, digest_size=16).digest()
        out.append(last)
    return out


class ZFastTrie:
    """Nodes by number, 0 is the root. Node v has the depths low[v] + 1 to deep[v] of its edge, which are those of conversation shown[v]."""

    def __init__(self):
        self.chains: list[list[bytes]] = []
        self.low, self.deep, self.shown, self.up = [-1], [0], [0], [-1]
        self.ends: list[list[int]] = [[]]
        #: By the digests of prefixes: nodes by their handles, and by the first prefix of their edges.
        self.handles: dict[bytes, int] = {}
        self.names: dict[bytes, int] = {}

    def _place(self, v: int) -> None:
        chain, low = self.chains[self.shown[v]], self.low[v]
        self.handles[chain[fattest(low, self.deep[v])]] = v
        self.names[chain[low + 1]] = v

    def _add(self, low: int, deep: int, shown: int, up: int) -> int:
        self.low.append(low), self.deep.append(deep), self.shown.append(shown), self.up.append(up), self.ends.append([])
        return len(self.low) - 1

    def _shared(self, v: int, chain: list[bytes], known: int) -> int:
        """How many turns a conversation has in common with an edge's end; `known` of them at least."""
        other, high = self.chains[self.shown[v]], min(self.deep[v], len(chain) - 1)
        while known < high:
            middle = (known + high + 1) // 2
            if other[middle] == chain[middle]:
                known = middle
            else:
                high = middle - 1
        return known

    def exit(self, chain: list[bytes]) -> tuple[int, int]:
        """(node, depth): the edge on which a conversation leaves the trie or ends, and where."""
        inside, length, below = 0, len(chain) - 1, len(chain) - 1
        last = 0
        while inside < below:
            f = fattest(inside, below)
            v = self.handles.get(chain[f])
            if v is None:
                below = f - 1
            elif self.deep[v] <= length and self.chains[self.shown[v]][self.deep[v]] == chain[self.deep[v]]:
                last, inside = v, self.deep[v]
            else:
                return v, self._shared(v, chain, f)
        at = self.deep[last]
        v = self.names.get(chain[at + 1]) if at < length else None
        return (last, at) if v is None else (v, self._shared(v, chain, at + 1))

    def _split(self, v: int, at: int) -> int:
        """The node that ends at a depth of an edge; v has the rest of the edge."""
        chain = self.chains[self.shown[v]]
        del self.handles[chain[fattest(self.low[v], self.deep[v])]]
        new = self._add(self.low[v], at, self.shown[v], self.up[v])
        self.low[v], self.up[v] = at, new
        self._place(new), self._place(v)
        return new

    def insert(self, chains: list[list[bytes]]) -> None:
        """Inserts a batch of conversations; they are numbered on from those that are there."""
        waiting = list(range(len(self.chains), len(self.chains) + len(chains)))
        self.chains += chains
        waiting.sort(key=lambda c: -len(self.chains[c]))  # the longest becomes the edge of those behind it
        while waiting:
            by_node: dict[int, dict[int, list[int]]] = {}
            for c in waiting:
                v, at = self.exit(self.chains[c])
                by_node.setdefault(v, {}).setdefault(at, []).append(c)
            waiting = []
            for v, places in by_node.items():
                for at in sorted(places):
                    node = v if at == self.deep[v] else self._split(v, at)
                    begun = set()
                    for c in places[at]:
                        chain = self.chains[c]
                        if len(chain) - 1 == at:
                            self.ends[node].append(c)
                        elif chain[at + 1] in begun:
                            waiting.append(c)
                        else:
                            begun.add(chain[at + 1])
                            leaf = self._add(at, len(chain) - 1, c, node)
                            self.ends[leaf].append(c)
                            self._place(leaf)

    def expanded(self, ids: list[int], sizes: list[list[int]]) -> Iterator[tuple]:
        """A row of _LOCAL for each depth of each edge; ids and sizes are those of the conversations."""
        n = len(self.low)
        members, least = [0] * n, [None] * n
        saved, leaves, childless = [0] * n, [0] * n, [True] * n  # below the edges
        for v in sorted(range(n), key=self.deep.__getitem__, reverse=True):
            own = sorted(ids[c] for c in self.ends[v])
            count, first = members[v] + len(own), min(([own[0]] if own else []) + ([least[v]] if least[v] is not None else []))
            total, tips, chain, size = saved[v], leaves[v] + childless[v], self.chains[self.shown[v]], sizes[self.shown[v]]
            for d in range(self.deep[v], self.low[v], -1):
                b = size[d - 1] if d else 0
                total += (count - 1) * b
                tip = d == self.deep[v]
                yield chain[d], d, chain[d - 1] if d else None, count, first, b, total, tips, int(tip and childless[v]), own if tip else []
            if (u := self.up[v]) >= 0:
                members[u], least[u] = members[u] + count, first if least[u] is None else min(least[u], first)
                saved[u], leaves[u], childless[u] = saved[u] + total, leaves[u] + tips, False


_LOCAL = "hi long, lo long, depth int, up_hi long, up_lo long, n long, conv long, bytes long, saved long, leaves long, tip long, ends array<struct<run:long,ids:binary>>"
_ENDS = pa.list_(pa.struct([("run", pa.int64()), ("ids", pa.binary())]))


def _halves(digests: list[bytes | None]) -> list[pa.Array]:
    raw = np.frombuffer(b"".join(d or ROOT for d in digests), "<i8").reshape(-1, 2)
    none = np.array([d is None for d in digests], bool)
    return [pa.array(raw[:, k], mask=none) for k in (0, 1)]


def _runs(ids: list[int]) -> list[dict]:
    """Ids in order, those of each range of RUN numbers together."""
    if not ids:
        return []
    ids = np.array(ids, np.int64)
    run = ids // RUN
    cuts = np.append(0, np.flatnonzero(np.diff(run)) + 1).tolist()
    return [{"run": int(run[a]), "ids": ids[a:b].tobytes()} for a, b in zip(cuts, [*cuts[1:], len(ids)])]


def _chunks(batches) -> Iterator[tuple[list[int], list[list[bytes]], list[list[int]], list]]:
    """(ids, chains, sizes, fixes) of conversations in chunks."""
    ids, chains, sizes, fixes, turns = [], [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            more = part.column(3).to_pylist() if part.num_columns > 3 else [None] * part.num_rows
            for i, t, s, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), more):
                if turns and turns + len(t) > CHUNK:
                    yield ids, chains, sizes, fixes
                    ids, chains, sizes, fixes, turns = [], [], [], [], 0
                ids.append(i), chains.append(chain_of(t)), sizes.append(s), fixes.append(x)
                turns += len(t) + 1
    if ids:
        yield ids, chains, sizes, fixes


def _local(batches):
    for ids, chains, sizes, _ in _chunks(batches):
        trie = ZFastTrie()
        for at in range(0, len(ids), BATCH):
            trie.insert(chains[at : at + BATCH])
        rows = list(trie.expanded(ids, sizes))
        for at in range(0, len(rows), 10_000):
            node, depth, up, n, conv, size, saved_, leaves, tip, ends = zip(*rows[at : at + 10_000])
            numbers = [pa.array(x, pa.int64()) for x in (n, conv, size, saved_, leaves, tip)]
            yield pa.record_batch([*_halves(node), pa.array(depth, pa.int32()), *_halves(up), *numbers, pa.array([_runs(e) for e in ends], _ENDS)], names=["hi", "lo", "depth", "up_hi", "up_lo", "n", "conv", "bytes", "saved", "leaves", "tip", "ends"])
        release_memory()


def _excess(batches):
    """What prefixes of several tries add too much to those above them, along one conversation of each."""
    for _, chains, _, fixes in _chunks(batches):
        total: dict[bytes, list[int]] = {}
        for chain, fix in zip(chains, fixes):
            fix = sorted(((x["depth"], x["saved"], x["leaves"]) for x in fix), reverse=True)
            saved_ = leaves = k = 0
            for d in range(fix[0][0], -1, -1):
                while k < len(fix) and fix[k][0] == d:
                    saved_, leaves, k = saved_ + fix[k][1], leaves + fix[k][2], k + 1
                t = total.setdefault(chain[d], [0, 0])
                t[0], t[1] = t[0] + saved_, t[1] + leaves
        if total:
            saved_, leaves = zip(*total.values())
            yield pa.record_batch([*_halves(list(total)), pa.array(saved_, pa.int64()), pa.array(leaves, pa.int64())], names=["hi", "lo", "more_saved", "more_leaves"])


def _end_digests(batches):
    """(hi, lo, ends_sha256) from rows in order of (hi, lo, run): the ids of one range are in memory at a time."""
    node, run, held, sha, first = None, None, [], None, True

    def flush():
        nonlocal first
        ids = np.sort(np.frombuffer(b"".join(held), "<i8")).tolist()
        sha.update((("" if first else ",") + ",".join(map(str, ids))).encode())
        first = False
        held.clear()

    for batch in batches:
        done = []
        for hi, lo, r, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (hi, lo) != node or r != run:
                if held:
                    flush()
                if (hi, lo) != node:
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha, first = (hi, lo), hashlib.sha256(), True
                run = r
            held.append(ids)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("hi", "lo", "ends_sha256"), x)) for x in done])
    if node:
        flush()
        yield pa.RecordBatch.from_pylist([{"hi": node[0], "lo": node[1], "ends_sha256": sha.hexdigest()}])


def sequences(conversations: DataFrame, heads: Column | None = None, of: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array<binary>, sizes array<long>): the digests of the turns of each conversation in order, and the bytes of their texts.

    If `heads` and `of` are given, columns of conv_id, the first `heads` turns are replaced by as many of the
    conversation with the id `of`, which should be that of a few neighbours: they are gathered in one row.
    Turns that tie are in order of role and text. Null roles and texts are empty; rows without conv_id are left out.
    """
    rows = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    rows = rows.filter("conv_id IS NOT NULL").withColumn("home", of if of is not None else F.col("conv_id"))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws("\n", F.octet_length("role"), F.concat("role", "text")), 256)), 1, 16)
    place = F.row_number().over(W.partitionBy("home", "conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    # Texts are sorted with the turns; what is gathered is a digest and a size for each.
    each = rows.repartition("home").select("home", "conv_id", F.struct(place.alias("p"), digest.alias("t"), F.octet_length("text").cast("long").alias("s")).alias("q"))
    each = each.groupBy("home", "conv_id").agg(F.sort_array(F.collect_list("q")).alias("q"))
    if heads is not None:
        family = each.groupBy("home").agg(F.collect_list(F.struct("conv_id", "q")).alias("family"))
        first = F.get(F.filter("family", lambda x: x["conv_id"] == F.col("home")), F.lit(0))["q"]
        one = family.select(first.alias("first"), F.explode("family").alias("x")).select("first", "x.conv_id", "x.q")
        n = heads.cast("int")
        nothing = F.array().cast(each.schema["q"].dataType)
        each = one.withColumn("q", F.concat(F.slice(F.coalesce("first", nothing), F.lit(1), n), F.slice("q", n + 1, F.greatest(F.size("q"), F.lit(1)))))
    return each.select("conv_id", F.transform("q", lambda x: x["t"]).alias("turns"), F.transform("q", lambda x: x["s"]).alias("sizes"))


def nodes(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of (conv_id, turns, sizes), conv_ids distinct: see prefix_trie."""
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leading = F.array_join(F.transform(F.slice("turns", 1, LEADING), lambda t: F.hex(t)), "")
    dealt = saved(conversations.withColumn("lead", leading).repartitionByRange(n, "lead", "conv_id").drop("lead"), "conversations")
    local = saved(dealt.mapInArrow(_local, _LOCAL), "local-nodes")
    sums = local.groupBy("hi", "lo").agg(*(F.min(c).alias(c) for c in ("depth", "up_hi", "up_lo", "conv", "bytes")), *(F.sum(c).alias(c) for c in ("n", "saved", "leaves", "tip")), F.count("*").alias("tries"))
    sums = saved(sums, "nodes")
    # A prefix of t tries had its bytes taken off t times, and counted as a leaf in each trie where nothing follows.
    shared = sums.filter("tries > 1").groupBy("conv").agg(F.collect_list(F.struct("depth", ((F.col("tries") - 1) * F.col("bytes")).alias("saved"), (F.when(F.col("tip") == F.col("tries"), F.lit(1)).otherwise(0) - F.col("tip")).alias("leaves"))).alias("fix"))
    excess = dealt.join(shared, F.col("conv_id") == F.col("conv")).select("conv_id", "turns", "sizes", "fix").mapInArrow(_excess, "hi long, lo long, more_saved long, more_leaves long")
    excess = excess.groupBy("hi", "lo").agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))
    children = sums.filter("depth > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    ends = local.select("hi", "lo", F.explode("ends").alias("e")).select("hi", "lo", "e.run", "e.ids")
    ends = ends.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "run").mapInArrow(_end_digests, "hi long, lo long, ends_sha256 string")
    full = sums.join(excess, ["hi", "lo"], "left").join(children, ["hi", "lo"], "left").join(ends, ["hi", "lo"], "left")
    # Many rows may share a parent: an adaptive join splits them, since each meets one row.
    above = sums.select(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("conv").alias("parent_conv_id"))
    full = full.join(above, (F.col("up_hi") == F.col("p_hi")) & (F.col("up_lo") == F.col("p_lo")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return full.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), zero("n_children").cast("long").alias("n_children"),
        (F.col("leaves") + zero("more_leaves")).alias("n_leaves"), (F.col("saved") + zero("more_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


#: The contract's rule: the first turns of a conversation come from the one whose id is the multiple of FAMILY before it.
FAMILY, MOST_HEADS = 5, 9


def prefix_trie(conversations: DataFrame, rebuild: bool = True, **columns) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each distinct prefix.

    With `rebuild`, the first h turns of conversation c are those of c - c % 5 (all if there are fewer, none if it
    is missing), h being the crc32 of c in decimal modulo 9; without, conversations are taken as they are.

    Null turns come first, turns that tie in order of role and text, and equal rows are turns of their own.
    Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out. Other
    columns change nothing. An empty table gives no rows. The digests of one conversation are held by one task.
    """
    c = F.col("conv_id")
    rules = {"heads": F.pmod(F.crc32(c.cast("string")), F.lit(MOST_HEADS)), "of": c - c % FAMILY} if rebuild else {}
    return nodes(sequences(conversations, **rules, **columns))


_CRC = "CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, i // 8 + 1, 1))) ELSE c END"
#: The rows of prefix_trie() over the table conversations in DuckDB's SQL.
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, {{'r': role, 'x': text}} AS e
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
s AS (SELECT conv_id, conv_id::VARCHAR AS s, list(e ORDER BY p) AS q FROM t GROUP BY conv_id),
h AS (SELECT conv_id, q, xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(s))), lambda c, i: xor(({_CRC}) >> 1, 3988292384 * (({_CRC}) & 1))), 4294967295) % {MOST_HEADS} AS h FROM s),
r AS (SELECT c.conv_id, list_concat(coalesce(b.q[1:c.h], []), c.q[c.h + 1:]) AS q FROM h c LEFT JOIN h b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
p AS (SELECT conv_id, d, len(q) AS n, q[1:d] AS k, CASE WHEN d > 0 THEN q[1:d - 1] END AS up, CASE WHEN d > 0 THEN strlen(q[d].x) ELSE 0 END AS b FROM (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS d FROM r)),
m AS (SELECT k, d, any_value(up) AS up, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends FROM p GROUP BY k, d),
c AS (SELECT up AS k, count(*) AS n_children FROM m WHERE d > 0 GROUP BY up),
f AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN c USING (k)),
z AS (SELECT p.k, p.d, sum((f.n_convs - 1) * f.b) AS saved_tokens, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves FROM f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY p.k, p.d)
SELECT f.conv_id, f.d::BIGINT AS depth, a.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN z ON z.k = f.k AND z.d = f.d LEFT JOIN f a ON f.d > 0 AND a.k = f.up AND a.d = f.d - 1"""
