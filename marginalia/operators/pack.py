"""Packing ranked sections into a prompt of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T

LIMIT = 4000
CUT_MARK = "\n[…truncated]"
BYTES_PER_TOKEN = 3.6


def sanitised(body: Column) -> Column:
    """With source fences escaped by a backslash, and without control characters other than line feeds and tabs."""
    text = F.replace(F.replace(body, F.lit("</source>"), F.lit("<\\/source>")), F.lit("<source"), F.lit("<\\source"))
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "")


def cut(body: Column, limit: int = LIMIT) -> Column:
    """At most `limit` characters, back to the last blank line if that lies past half the bytes, else to the last character that is no white space, with a mark."""
    head = F.substring(body, 1, limit)
    behind = F.locate("\n\n", F.reverse(head))
    back = F.substring(head, F.lit(1), (F.length(head) - behind - 1).cast("int"))  # what stands before the last blank line
    whole = F.when((behind > 0) & (F.octet_length(back) > F.floor(F.octet_length(head) / 2)), back).otherwise(T.trimmed_end(head))
    return F.when(F.length(body) > limit, F.concat(whole, F.lit(CUT_MARK))).otherwise(body)


def block(index: Column, path: Column, heading: Column, line: Column, body: Column) -> Column:
    """A source as the prompt shows it (a fixed format)."""
    return F.format_string("<source %d>\npath: %s\nheading: %s\nlines: %d\n%s\n</source>\n\n", index, path, heading, line, body)


def packed(rows: DataFrame, budget_tokens: int, most: int | None = None) -> DataFrame:
    """Rows (qid, rank, block) in rank order up to the first that would pass the budget in bytes; the first is always taken.

    The running size only grows, so what is taken is a prefix.
    """
    window = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    sized = rows.withColumn("bytes_used", F.sum(F.octet_length("block")).over(window)).withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("rank")))
    keep = (F.col("bytes_used") <= budget_tokens * BYTES_PER_TOKEN) | (F.col("n") == 1)
    return sized.filter(keep & (F.col("n") <= most if most else F.lit(True))).drop("n")


def without_parents(rows: DataFrame) -> DataFrame:
    """Rows (qid, uid, parent_uid, heading_path) without those of which a part is there too; the part shows the heading path of the whole."""
    parts = rows.filter("parent_uid IS NOT NULL").select("qid", F.col("parent_uid").alias("uid")).distinct()
    whole = rows.select("qid", F.col("uid").alias("parent_uid"), F.col("heading_path").alias("__above"))
    kept = rows.join(parts, ["qid", "uid"], "left_anti").join(whole, ["qid", "parent_uid"], "left")
    return kept.withColumn("heading_path", F.coalesce("__above", "heading_path")).drop("__above")


def merged_adjacent(rows: DataFrame) -> DataFrame:
    """(qid, path, first, n, rank, body): rows (qid, path, order_index, rank, body) that follow each other in a document as one, at their best rank.

    The bodies that are gathered for a row are those of a run in one document.
    """
    order = W.partitionBy("qid", "path").orderBy("order_index")
    runs = rows.withColumn("__run", F.col("order_index") - F.row_number().over(order))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("order_index", "body"))), lambda x: x["body"])
    found = runs.groupBy("qid", "path", "__run").agg(F.min("order_index").alias("first"), F.count("*").alias("n"), F.min("rank").alias("rank"), F.array_join(bodies, "\n\n").alias("body"))
    return found.drop("__run")


def budget(context_tokens: int, max_output_tokens: int, reserve: int = 320) -> int:
    """Tokens that are left for a prompt."""
    return max(0, context_tokens - max_output_tokens - reserve)


def recounted(rows: DataFrame, tokens: Column, budget_tokens: int, most: int) -> DataFrame:
    """Packed rows (qid, rank, block); a question whose blocks come to more tokens than the budget is packed from one row fewer than it may have.

    `tokens` counts those of a row, by the tokenizer of the model; sizes in bytes are estimates only. A question
    may have `most` rows, or as many as were found (n_found); one stays at least.
    """
    total = F.sum(tokens).over(W.partitionBy("qid"))
    place = F.row_number().over(W.partitionBy("qid").orderBy("rank"))
    fewer = F.greatest(F.least(F.col("n_found"), F.lit(most)), F.lit(2)) - 1
    sized = rows.withColumn("counted", total).withColumn("__nth", place)
    return sized.filter((F.col("counted") <= budget_tokens) | (F.col("__nth") <= fewer)).drop("__nth")


def prompts(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, prompt, sources): the taken blocks of each question in order, then the question; a fixed sentence for one without blocks.

    At most `context_sections` blocks are gathered for a question.
    """
    blocks = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "")
    got = rows.groupBy("qid").agg(blocks.alias("b"), F.count("*").alias("sources"))
    every = questions.select("qid", "question").join(got, "qid", "left")
    prompt = F.concat(F.coalesce("b", F.lit("No sources were found.\n\n")), F.lit("Question: "), sanitised(F.col("question")))
    return every.select("qid", prompt.alias("prompt"), F.coalesce("sources", F.lit(0).cast("long")).alias("sources"))


def gated(rows: DataFrame, questions: DataFrame, least: float, closest: int = 3) -> DataFrame:
    """(qid, confident, closest): whether the best score of a question reaches the gate; if not, its first uids. A question without rows has none."""
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= closest, F.struct("rank", "uid")))), lambda x: x["uid"])
    best = rows.groupBy("qid").agg(F.max_by("score", -F.col("rank")).alias("top"), first.alias("first"))
    sure = F.coalesce(F.col("top") >= least, F.lit(False))
    return questions.select("qid").join(best, "qid", "left").select("qid", sure.alias("confident"), F.when(~sure, F.coalesce("first", F.array())).alias("closest"))


def with_correction(prompt: Column, block_: Column) -> Column:
    """A block right before the last "Question: "."""
    mark = "Question: "
    at = F.length(prompt) - F.locate(mark[::-1], F.reverse(prompt)) - len(mark) + 1
    return F.when(F.locate(mark, prompt) > 0, F.concat(F.substring(prompt, F.lit(1), at), block_, F.substring(prompt, at + 1, F.length(prompt)))).otherwise(F.concat(prompt, block_))
