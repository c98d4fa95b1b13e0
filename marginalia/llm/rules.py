"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

A measure is a named expression over a text or other measures; a rule is a name,
a condition over measures that rejects a document, and the measures it needs.
The cascade times each rule on a bounded sample, with the measures that it needs
from the raw text, counts what it rejects there, and asks the rules in the order
of rejections per second.  A measure is worked out when the first rule needs it,
and only for documents that no rule before has rejected; for the others it stays
null.  The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .storage import discard, saved

#: Documents on which the rules are timed.
SAMPLE = 1000
WINDOW = 8
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


#: What the names of inner columns begin with; docs must have none like it.
INNER = "__cascade_"


@dataclass(frozen=True)
class Measure:
    name: str
    value: Column
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Timed:
    """A rule with its cost and selectivity on the sample."""

    rule: Rule
    seconds: float
    rejected: int
    sampled: int


def replaced(text: Column, chars: str, by: str = "") -> Column:
    """The text with some characters replaced, one at a time: each is a plain search, faster than one by a pattern or a table."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def doubled(hashes: Column, by: int) -> Column:
    """Hashes of runs twice as long: each of `hashes` with the one `by` places on."""
    n = F.size(hashes) - by
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, by + 1, n), lambda x, y: F.xxhash64(x, y))


def inner(name: str) -> Column:
    return F.col(INNER + name)


def standard_measures(text_col: str = "text") -> list[Measure]:
    """Measures of a text; those that other measures are made of come first.

    Repeated windows are found by sorting the hashes of a document's windows with their places; only documents
    with repeats are sorted.
    """
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    again = F.filter(inner("sorted"), lambda x, k: (F.get(inner("sorted"), k - 1)["h"] == x["h"]) | (F.get(inner("sorted"), k + 1)["h"] == x["h"]))
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(inner("places"), start, lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n")), lambda acc: acc["n"])
    repeats = F.size(F.array_distinct(inner("runs8"))) < F.size(inner("runs8"))
    runs = lambda of, by: F.when(F.size(inner("words")) > WINDOW, doubled(inner(of), by))
    return [
        Measure("blanked", replaced(t, BLANKS[1:], " ")),
        Measure("words", F.transform(F.array_remove(F.split(inner("blanked"), " "), ""), lambda x: F.xxhash64(x)), ("blanked",)),
        Measure("lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
        Measure("runs2", runs("words", 1), ("words",)),
        Measure("runs4", runs("runs2", 2), ("runs2",)),
        Measure("runs8", runs("runs4", WINDOW // 2), ("runs4",)),
        Measure("repeats", F.coalesce(repeats, F.lit(False)), ("runs8",)),
        Measure("sorted", F.when(inner("repeats"), F.sort_array(F.transform(inner("runs8"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), ("repeats",)),
        Measure("places", F.when(inner("repeats"), F.sort_array(F.transform(again, lambda x: x["i"]))), ("sorted",)),
        Measure("n_words", F.size(inner("words")), ("words",)),
        Measure("word_chars", F.length(F.replace(inner("blanked"), F.lit(" "), F.lit(""))), ("blanked",)),
        Measure("n_symbols", F.length(t) - F.length(replaced(t, SYMBOLS))),
        Measure("n_lines", F.size(inner("lines")), ("lines",)),
        Measure("n_dup_lines", F.size(inner("lines")) - F.size(F.array_distinct(inner("lines"))), ("lines",)),
        Measure("n_exclaims", F.length(t) - F.length(replaced(t, "!"))),
        Measure("n_repeat_words", F.coalesce(F.when(inner("repeats"), covered), F.lit(0)), ("places",)),
    ]


def standard_rules() -> list[Rule]:
    """Rules over the standard measures; the first two are the base ones."""
    n, chars = inner("n_words"), inner("word_chars")
    return [
        Rule("too short", n < 20, ("n_words",)),
        Rule("repeated windows", 100 * inner("n_repeat_words") > 30 * n, ("n_repeat_words", "n_words")),
        Rule("symbols", 10 * inner("n_symbols") > chars, ("n_symbols", "word_chars")),
        Rule("repeated lines", (inner("n_dup_lines") >= 3) & (100 * inner("n_dup_lines") > 30 * inner("n_lines")), ("n_dup_lines", "n_lines")),
        Rule("word length", (chars < 2 * n) | (chars > 15 * n), ("n_words", "word_chars")),
        Rule("exclamations", 2 * inner("n_exclaims") > n, ("n_exclaims", "n_words")),
    ]


def needed(names: Iterable[str], measures: Sequence[Measure]) -> list[Measure]:
    """The measures with these names and all they need, in their order."""
    wanted, known = set(names), {m.name for m in measures}
    if not wanted <= known:
        raise KeyError(f"there is no measure {sorted(wanted - known)}")
    for m in reversed(measures):
        if m.name in wanted:
            wanted |= set(m.needs)
    return [m for m in measures if m.name in wanted]


def with_measures(docs: DataFrame, measures: Sequence[Measure], where: Column | None = None) -> DataFrame:
    """docs with the columns of measures that it lacks; null where the condition doesn't hold."""
    for m in measures:
        if INNER + m.name not in docs.columns:
            docs = docs.withColumn(INNER + m.name, m.value if where is None else F.when(where, m.value))
    return docs


def cascade(docs: DataFrame, rules: Sequence[Rule], measures: Sequence[Measure] = (), seen: Observation | None = None) -> DataFrame:
    """docs with `rejected_by` (as an inner column): the first rule that rejects, null if none does. An unknown condition rejects nothing.

    Measures that docs has already are used as they are; each other one is worked out for the rows that are
    still there when a rule first needs it. `seen` gets the number of rows that each rule has rejected in a run;
    observing also keeps filters on the verdict from being pushed down into the measures.
    """
    rejected = inner("rejected_by")
    docs = docs.withColumn(INNER + "rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        docs = with_measures(docs, needed(rule.needs, measures), rejected.isNull())
        docs = docs.withColumn(INNER + "rejected_by", F.coalesce(rejected, F.when(rule.rejects, F.lit(rule.name))))
    return docs.observe(seen or Observation(), F.count("*").alias("rows"), *[F.count_if(rejected == r.name).alias(r.name) for r in rules])


def sampled(docs: DataFrame, id_col: str, text_col: str, most: int = SAMPLE) -> DataFrame:
    """At most `most` rows of docs by the hash of id and text: the smallest of those that a modulus leaves."""
    every = -(-docs.count() // (2 * most))
    h = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return docs.filter(F.pmod(h, F.lit(max(every, 1))) == 0).orderBy(h).limit(most)


def timed(few: DataFrame, rules: Sequence[Rule], measures: Sequence[Measure] = (), tries: int = 3) -> list[Timed]:
    """Each rule on the sample `few`, in the order of rejections per second; equal ones in their own order.

    A rule's cost is the best of `tries` runs over the sample, with the measures it needs and `few` lacks, less
    that of a run which only reads.
    """
    few = saved(few, "rule-sample")

    def run(df: DataFrame, condition: Column) -> tuple[float, int, int]:
        best = float("inf")
        for _ in range(tries):  # the first one compiles
            began = time.perf_counter()
            rejected, n = df.agg(F.count_if(condition), F.count("*")).first()
            best = min(best, time.perf_counter() - began)
        return best, rejected, n

    columns = [F.xxhash64(*[F.col(f"`{c}`") for c, kind in few.dtypes if not kind.startswith("map")])]
    idle, _, n = run(few, columns[0] == 0)
    out = []
    for rule in rules:
        seconds, rejected, _ = run(with_measures(few, needed(rule.needs, measures)), rule.rejects)
        out.append(Timed(rule, max(seconds - idle, 1e-4), rejected, n))
    discard(few)
    return sorted(out, key=lambda t: -t.rejected / t.seconds)


def report(times: Sequence[Timed]) -> list[dict]:
    """The order of a cascade with cost and selectivity, for a log."""
    return [{"place": k, "rule": t.rule.name, "seconds": round(t.seconds, 5), "rejected": t.rejected, "sampled": t.sampled} for k, t in enumerate(times, 1)]


def filtered(docs: DataFrame, rules: Sequence[Rule] | None = None, measures: Sequence[Measure] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns.

    A null text counts as empty. Rows are judged one by one, so null or repeated ids and other columns change
    nothing; an empty table stays empty.
    """
    measures, rules = standard_measures(text_col) if measures is None else measures, standard_rules() if rules is None else rules
    order = [t.rule for t in timed(sampled(docs, id_col, text_col, sample), rules, measures)]
    return cascade(docs, order, measures).filter(inner("rejected_by").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The measures that judged() returns of every document.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    The five measures are returned of all rows and so worked out for all; rules that use nothing else cost
    little then and are asked by what they reject. The measures of the others are worked out for the rows that
    are left. A null or empty text has no words and fails. Rows are judged one by one, so null or repeated ids
    and other columns change nothing.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    measures = standard_measures()
    own = needed(RETURNED, measures)
    order = [t.rule for t in timed(with_measures(sampled(texts, "doc_id", "text", sample), own), standard_rules(), measures)]
    out = cascade(with_measures(texts, own), order, measures)
    base = (inner("n_words") < 20) | (100 * inner("n_repeat_words") > 30 * inner("n_words"))
    return out.select("doc_id", *[inner(c).cast("long").alias(c) for c in RETURNED], base.alias("base_failed"), inner("rejected_by").isNull().alias("kept"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
x AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM m)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM x) WHERE c > 1) GROUP BY doc_id),
a AS (SELECT m.doc_id, len(w) AS n_words, word_chars, n_symbols, n_exclaims, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > word_chars OR n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_exclaims > n_words) AS kept
FROM a"""
