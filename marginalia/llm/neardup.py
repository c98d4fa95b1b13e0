"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents are sets of distinct w-word shingles; two are linked when 100 * |A n B|
>= percent * |A u B|, and the groups are the connected components of the links.

1. One pass makes a sketch of each document: the size of its set, a 128-bit
   fingerprint of the set, band keys and a one-byte-per-hash signature.  A
   shingle is told by a 128-bit digest that is made from cryptographic digests
   of its words.
2. Equal sets become one class before anything is compared, with partial
   aggregation, so exact copies cost no pairs.  A class has a number of its own;
   document ids play no part until the end.
3. Classes that share a band key are candidates.  Each bucket first compares
   its members with its smallest member only.
4. A second round looks for links between members of a bucket that are not yet
   in one component.  It compares them in blocks inside a task, remembers what it
   has joined and gives fewer links than the bucket has components; block pairs
   that lie within one component are never formed, and those of a large bucket
   are dealt by salts.  If the words refuse one of these links, all probable
   links of its bucket are tried instead.
5. Each comparison reads the signatures batch by batch and stops as soon as the
   posterior probability that the similarity reaches the threshold falls below
   `miss` (uniform prior).  Every link is confirmed on the words of both texts.

A bucket has no cap and no pair is sampled.  The only approximate parts are the
banding (a pair at similarity 0.8 misses all 32 bands of 5 rows with
probability 3e-6) and `miss`, which bounds the posterior of one look; a pair at
exactly 0.8 is pruned in one of the five looks with probability 4.9e-4, one at
0.82 with 7e-5.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import NONSPACE, Block, Words, mix64, pieces, window_digests
from .storage import discard, saved

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Signature hashes looked at between two looks at the posterior.
BATCH = 32
#: Members that one row of a comparison holds; a member counts one more for each HEAVY shingles.
GROUP, HEAVY = 64, 2048
#: Groups of a bucket that one row meets in one place; the groups of larger buckets are dealt by salts.
MEET = 16
#: Rows up to which a table of keys is broadcast (about 100 bytes each); beyond it, it is joined by a shuffle.
BROADCAST_ROWS = 200_000

_FACTORS = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (mix64(np.arange(1001, HASHES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def distinct_rows(digests: np.ndarray) -> np.ndarray:
    """The distinct rows of an array with two columns, in order of the first."""
    rows = digests[np.argsort(digests[:, 0])]
    same = rows[1:, 0] == rows[:-1, 0]
    if (same & (rows[1:, 1] != rows[:-1, 1])).any():
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        same = (rows[1:] == rows[:-1]).all(axis=1)
    return rows[np.concatenate(([True], ~same))] if len(rows) else rows


def shingle_sets(texts: pa.Array, width: int) -> list[tuple[np.ndarray, bool]]:
    """(distinct shingle digests, whether it has `width` words) of each text; a text of fewer words is one shingle, one without words has none."""
    words = Words(Block(texts), NONSPACE)
    digests, first = words.digests(), words.first
    every = window_digests(digests, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append((distinct_rows(every[a : b - width + 1]), True) if b - a >= width else (window_digests(digests[a:b], max(b - a, 1)), False))
    return out


def similar_to_first(texts: pa.Array, width: int, percent: int) -> np.ndarray:
    """Which of the texts after the first are linked with it, decided on their words. All have `width` words at least."""
    words = Words(Block(texts), NONSPACE)
    numbers, _ = words.numbers()
    runs = numbers
    for j in range(1, width):
        runs = np.unique(runs[:-1] << 32 | numbers[j:], return_inverse=True)[1]
    sets = [np.unique(runs[a : b - width + 1]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
    both = np.array([np.isin(s, sets[0], assume_unique=True).sum() for s in sets[1:]], np.int64)
    either = np.array([len(sets[0]) + len(s) for s in sets[1:]], np.int64) - both
    return (both > 0) & (100 * both >= percent * either)


def signature(shingles: np.ndarray) -> np.ndarray:
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        part = np.multiply.outer(_FACTORS, short[at : at + 2048])
        part += _SHIFTS[:, None]
        part ^= part >> np.uint32(15)
        np.minimum(least, part.min(axis=1), out=least)
    return least


_SKETCH = "doc_id long, digest binary, n_shingles long, print binary, bands array<long>, sign binary"


def _sketches(width: int):
    def run(batches):
        for batch, texts in pieces(batches, "text"):
            sizes, prints, bands, signs = [], [], [], []
            for rows, whole in shingle_sets(texts, width):
                sizes.append(len(rows))
                prints.append(hashlib.blake2b(rows.tobytes(), digest_size=16).digest() if len(rows) else None)
                if not whole:  # such a text is linked with equal ones only, which are of its class
                    bands.append([]), signs.append(None)
                    continue
                least = signature(rows[:, 0])
                parts = least.astype(np.uint64).reshape(BANDS, ROWS)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for j in range(ROWS):
                    key = mix64(key * np.uint64(0x9FB21C651E98DF25) + parts[:, j])
                bands.append(key.view(np.int64))
                signs.append(least.astype(np.uint8).tobytes())
            columns = [batch.column("doc_id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "digest", "n_shingles", "print", "bands", "sign"])

    return run


def least_matches(percent: int, miss: float) -> list[int]:
    """Fewest matches after 1, 2, ... batches for which P(similarity >= percent / 100 | matches) >= miss.

    With a uniform prior the similarity after m matches among n hashes is Beta(m + 1, n - m + 1), whose
    upper tail at t is the binomial sum over i <= m of C(n + 1, i) t^i (1 - t)^(n + 1 - i).
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def promising(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of the signature arrays a and b stay through all batches; a row that is pruned is not read further."""
    alive, seen = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        seen += (a[alive, part] == b[alive, part]).sum(axis=1)
        stay = seen >= m
        alive, seen = alive[stay], seen[stay]
    return alive


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _prune(least: list[int]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                stay = promising(_signs(batch.column("sign_a")), _signs(batch.column("sign_b")), least)
                yield batch.select(["a", "b"]).take(pa.array(stay))

    return run


def _one_by_one(batch: pa.RecordBatch):
    """The rows of a batch as dicts, one at a time, for rows that hold many values."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _top(over: dict[int, int], comp: int) -> int:
    """The component that comp has been joined to; the way there is shortened."""
    top = comp
    while top in over:
        top = over[top]
    while comp != top:
        over[comp], comp = top, over[comp]
    return top


_LINK = "a long, b long, comp_a long, comp_b long, key long, salt int"


def _link_groups(least: list[int], percent: int, every: bool = False):
    """Probable links of different components from two groups of a bucket; the same group stands for its own pairs.

    Of a bucket and salt only those come out that join what the links before haven't joined yet, fewer than
    there are components; with `every` all of them.
    """

    def run(batches):
        joined = {}  # by bucket and salt: what each component was joined to
        for batch in batches:
            for row in _one_by_one(batch):
                out = []
                over = joined.setdefault((row["key"], row["salt"]), {})
                x, y = (sorted(row[z], key=lambda m: m["rid"]) for z in ("xs", "ys"))
                sx, sy = (np.frombuffer(b"".join(m["sign"] for m in z), np.uint8).reshape(-1, HASHES) for z in (x, y))
                cx, cy = (np.array([_top(over, m["comp"]) for m in z]) for z in (x, y))
                ix, iy = (np.array([m["rid"] for m in z]) for z in (x, y))
                wx, wy = ([np.frombuffer(m["shingles"], "<u8") for m in z] for z in (x, y))
                for i in range(len(x)):
                    other = np.flatnonzero((cy != cx[i]) & ((iy > ix[i]) | (row["gx"] != row["gy"])))
                    stay = other[promising(np.broadcast_to(sx[i], (len(other), HASHES)), sy[other], least)]
                    if not len(stay):
                        continue
                    sizes = np.array([len(wy[j]) for j in stay])
                    shingles = np.concatenate([wy[j] for j in stay])
                    at = np.minimum(np.searchsorted(wx[i], shingles), len(wx[i]) - 1)
                    both = np.add.reduceat((wx[i][at] == shingles).astype(np.int64), np.cumsum(sizes) - sizes)
                    for j in stay[100 * both >= percent * (len(wx[i]) + sizes - both)].tolist():
                        if not every:
                            if cx[i] == cy[j]:
                                continue
                            low, high = sorted((int(cx[i]), int(cy[j])))
                            over[high] = low
                            cx[cx == high], cy[cy == high] = low, low
                        p, q = sorted((x[i], y[j]), key=lambda m: m["rid"])
                        out.append((p["rid"], q["rid"], p["comp"], q["comp"], row["key"], row["salt"]))
                columns = zip(*out) if out else [()] * 6
                types = [pa.int64()] * 5 + [pa.int32()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["a", "b", "comp_a", "comp_b", "key", "salt"])

    return run


def _confirm(width: int, percent: int):
    """Links of a text with the others of its row."""

    def run(batches):
        for batch in batches:
            for row in _one_by_one(batch):
                kept = similar_to_first(pa.array([row["text"], *(m["text"] for m in row["m"])], pa.large_string()), width, percent)
                b = [m["b"] for m, k in zip(row["m"], kept.tolist()) if k]
                yield pa.record_batch([pa.array([row["a"]] * len(b), pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _sets(width: int):
    """The first halves of the digests: enough to choose which links to confirm."""

    def run(batches):
        for batch, texts in pieces(batches, "text"):
            sets = [np.unique(rows[:, 0]).astype("<u8").tobytes() for rows, _ in shingle_sets(texts, width)]
            yield pa.record_batch([batch.column("rid"), pa.array(sets, pa.binary())], names=["rid", "shingles"])

    return run


def weight(n_shingles: Column) -> Column:
    return 1 + F.floor(n_shingles / HEAVY)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked. Each a meets about GROUP of its partners in a row, so its text is copied once for so many."""
    known = texts.select("rid", "text")
    sized = pairs.join(texts.select(F.col("rid").alias("b"), weight(F.col("n_shingles")).alias("w")), "b")
    parts = sized.groupBy("a").agg(F.ceil(F.sum("w") / GROUP).alias("parts"))
    others = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts")).join(known.select(F.col("rid").alias("b"), "text"), "b")
    rows = others.groupBy("a", "part").agg(F.collect_list(F.struct("b", "text")).alias("m"))
    return rows.join(known.select(F.col("rid").alias("a"), "text"), "a").select("a", "text", "m").mapInArrow(_confirm(width, percent), "a long, b long")


def bounded(df: DataFrame) -> DataFrame:
    """df as a table, with a broadcast hint if its count proves that it is small."""
    df = saved(df, "keys")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a, b), by minimum labels with pointer jumping."""
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:  # labels only fall, and a round without a change is the last
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = saved(labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")), "labels")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        jumped = saved(step.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("root", "comp")).alias("comp")), "labels")
        discard(labels, step)
        labels = jumped
        if labels.filter("comp <> was").isEmpty():
            discard(both)
            return labels.select("node", "comp")


def _judged(docs: DataFrame, width: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, chosen) of every row; `chosen` marks the document of its group that stays."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text).alias("digest"), text.alias("text"))
    sketch = saved(texts.mapInArrow(_sketches(width), _SKETCH), "sketch")
    # Of each class one document: the smallest id that isn't null, or else the smallest digest.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest"))
    classes = sketch.filter("n_shingles > 0").groupBy("print").agg(first.alias("x"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sign").alias("sign"))
    reps = saved(classes.select(F.monotonically_increasing_id().alias("rid"), "print", "x.without", "x.doc_id", "x.digest", "n_shingles", "bands", "sign"), "classes")
    least = least_matches(percent, miss)

    banded = reps.select("rid", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rid").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    members = saved(banded.join(shared, "key").select("key", "rid", "leader", "n"), "members")
    signs = saved(reps.select("rid", "sign").join(bounded(members.select("rid").distinct()), "rid", "left_semi"), "signs")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(rid, n_shingles, text) of classes."""
        one = reps.join(bounded(ids.distinct()), "rid", "left_semi").select("rid", "n_shingles", "doc_id", "digest")
        one = bounded(one.select("rid", "n_shingles", F.col("doc_id").alias("i"), F.col("digest").alias("d")))
        return texts.join(one, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))).select("rid", "n_shingles", "text").dropDuplicates(["rid"])

    def linked(pairs: DataFrame) -> DataFrame:
        known = saved(texts_of(pairs.select(F.col("a").alias("rid")).union(pairs.select("b"))), "texts")
        links = saved(confirmed(pairs, known, width, percent), "links")
        discard(known)
        return links

    stars = members.filter("rid <> leader").select(F.col("leader").alias("a"), F.col("rid").alias("b")).distinct()
    sides = stars.join(signs.select(F.col("rid").alias("a"), F.col("sign").alias("sign_a")), "a").join(signs.select(F.col("rid").alias("b"), F.col("sign").alias("sign_b")), "b")
    pairs = saved(sides.select("a", "b", "sign_a", "sign_b").mapInArrow(_prune(least), "a long, b long"), "pairs")
    links = linked(pairs)
    found = components(links)

    sized = members.filter("n > 2").select("key", "rid").join(reps.select("rid", weight(F.col("n_shingles")).alias("w")), "rid")
    larger = sized.join(found.select(F.col("node").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    by_comp = larger.groupBy("key", "comp").agg(F.sum("w").alias("w_comp"))
    # Groups of about GROUP members. A component that fills a group by itself has its own, so that those of a large one are pure; the others share.
    own = F.col("w_comp") >= GROUP
    mixed = by_comp.groupBy("key").agg(F.count("*").alias("n_comps"), F.sum("w_comp").alias("w_all"), F.sum(F.when(~own, F.col("w_comp"))).alias("w_rest"), F.max(F.struct("w_comp", "comp")).alias("largest")).filter("n_comps > 1")
    parts = F.ceil(F.when(own, F.col("w_comp")).otherwise(F.col("w_rest")) / GROUP)
    # The groups of a bucket's largest component don't meet each other, so that the rest is what is dealt by salts.
    main = own & (F.col("comp") == F.col("largest.comp"))
    w_met = F.col("w_all") - F.when(F.col("largest.w_comp") >= GROUP, F.col("largest.w_comp")).otherwise(0)
    plan = mixed.join(by_comp, "key").select("key", "comp", parts.alias("parts"), F.when(own, F.col("comp")).alias("pure"), main.alias("main"), F.ceil(w_met / (GROUP * MEET)).cast("int").alias("salts"))
    strays = saved(larger.join(plan, ["key", "comp"]).select("key", "rid", "comp", "salts", "main", F.xxhash64("pure", F.pmod(F.xxhash64("rid"), "parts")).alias("g")), "strays")
    sets = saved(texts_of(strays.select("rid")).mapInArrow(_sets(width), "rid long, shingles binary").join(signs, "rid"), "sets")
    groups = strays.join(sets, "rid").groupBy("key", "g").agg(F.collect_list(F.struct("rid", "comp", "sign", "shingles")).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("salts").alias("salts"), F.max("main").alias("main"))
    groups = saved(groups, "groups")
    x, y = (groups.select("key", "salts", *(F.col(c).alias(f"{c}{s}") for c in ("g", "lo", "hi", "main")), F.col("m").alias(f"{s}s")) for s in "xy")
    x = x.filter("NOT mainx").withColumn("salt", F.pmod(F.xxhash64("gx"), "salts").cast("int")).drop("salts")
    y = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def probable_links(x: DataFrame, every: bool) -> DataFrame:
        across = x.join(y, ["key", "salt"]).filter("(mainy OR gx <= gy) AND NOT (lox = hix AND loy = hiy AND lox = loy)")
        return saved(across.select("key", "salt", "gx", "gy", "xs", "ys").mapInArrow(_link_groups(least, percent, every), _LINK), "probable")

    probable = probable_links(x, False)
    higher = None
    if not probable.isEmpty():
        more = linked(saved(probable.select("a", "b").distinct(), "between"))
        # Links before a refused one may have left out others of its bucket, so that all of these are tried.
        refused = saved(probable.join(more, ["a", "b"], "left_anti").select("key", "salt").distinct(), "refused")
        if not refused.isEmpty():
            every = probable_links(x.join(refused, ["key", "salt"], "left_semi"), True)
            again = linked(saved(every.select("a", "b").distinct(), "between"))
            probable, more = probable.unionByName(every), more.union(again)
        joins = probable.join(more.distinct(), ["a", "b"]).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct()
        joins = saved(joins, "joins")
        higher = None if joins.isEmpty() else components(joins)
    discard(members, signs, pairs, strays, sets, groups, links)
    if higher is not None:
        alone = higher.join(found, "node", "left_anti")
        over = higher.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        found = found.join(over, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")).union(alone)

    roots = reps.select("rid", "print", "without", "doc_id", "digest").join(found.select(F.col("node").alias("rid"), "comp"), "rid", "left").withColumn("root", F.coalesce("comp", "rid"))
    best = roots.filter("comp IS NOT NULL").groupBy("root").agg(F.min(F.struct("without", "doc_id", "digest")).alias("best"))
    whole = roots.join(best, "root", "left").select("print", F.coalesce("best", F.struct("without", "doc_id", "digest")).alias("best"))
    out = sketch.select("doc_id", "digest", "n_shingles", "print").join(whole, "print", "left")
    chosen = F.col("print").isNull() | (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.digest") == F.col("digest")))
    return out.select("doc_id", "digest", "n_shingles", F.coalesce("best.doc_id", "doc_id").alias("component_id"), chosen.alias("chosen"))


def text_digest(text: Column) -> Column:
    """32 bytes that tell a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Null or blank texts have an empty set, are linked with nothing and are their own component.  Every
    row is judged by its own text, so repeated rows get equal results and rows of one id with different
    texts may lie in different components.  A row without an id has the component of its group, which is
    null where no document of the group has an id; it is kept only then.  Other columns of docs are not
    looked at and may have any name.  An empty table gives an empty table.
    """
    out = _judged(docs, width, percent, miss, id_col, text_col)
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates, all columns kept.

    Rows of equal id and text are one document, of which one row stays.  Of a group the smallest id stays, of
    equal ids and of groups without any id the text with the smallest digest.  Null and blank texts are linked
    with nothing and stay.  Other columns may have any name; an empty table stays empty.
    """
    found = saved(_judged(docs, width, percent, miss, id_col, text_col).select("doc_id", "digest", "chosen"), "verdicts")
    left = docs.alias("docs")

    def among(keys: DataFrame) -> Column:
        return F.col(f"docs.`{id_col}`").cast("long").eqNullSafe(keys["doc_id"]) & (text_digest(F.col(f"docs.`{text_col}`").cast("string")) == keys["digest"])

    gone = bounded(found.filter("NOT chosen").select("doc_id", "digest").distinct())
    kept = left.join(gone, among(gone), "left_anti")
    again = saved(found.filter("chosen").groupBy("doc_id", "digest").count().filter("count > 1").drop("count"), "repeated")
    if again.isEmpty():
        return kept
    again, kept = bounded(again), kept.alias("docs")
    once = kept.join(again, among(again), "left_anti")
    names = docs.columns
    keyed = kept.join(again, among(again)).select(F.struct(*[F.col(f"docs.`{c}`") for c in names]).alias("row"), again["doc_id"], again["digest"])
    return once.unionByName(keyed.dropDuplicates(["doc_id", "digest"]).select("row.*"))


def oracle_sql(width: int, percent: int) -> str:
    """The rows of near_duplicates() over the table documents in DuckDB's SQL, for tables without repeated or null ids."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents), k AS (SELECT doc_id, w, least(len(w), {width}) AS n FROM w WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON a = x.doc_id JOIN z y ON b = y.doc_id WHERE 100 * m >= {percent} * (x.n + y.n - m)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(least, w.doc_id) AS component_id, coalesce(least, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN z USING (doc_id) LEFT JOIN c USING (doc_id)"""
