"""JSON Lines: messages, question files and reports, written and read back; question files in YAML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

#: Bytes of the longest line that is read as a message.
MOST = 1 << 20
QUESTIONS = "question string, expected array<string>, context string, note string"
REPORT = "combo long, n long, recall_1 double, recall_3 double, recall_5 double, mrr double"


def to_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as one JSON object on one line, nulls included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def from_lines(lines: DataFrame, schema: str, most: int = MOST) -> DataFrame:
    """The fields of each line (value) and `malformed`. A line that is no such object, null, or longer than `most` bytes has no fields; the lines after it are read."""
    wanted = ST._parse_datatype_string(schema)
    full = ST.StructType([*wanted.fields, ST.StructField("__corrupt", ST.StringType())])
    readable = F.when(F.octet_length("value") <= most, F.col("value"))
    parsed = lines.withColumn("__x", F.from_json(readable, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    bad = F.col("__x").isNull() | F.col("__x.__corrupt").isNotNull()
    return parsed.select(*[F.when(~bad, F.col("__x")[f.name]).alias(f.name) for f in wanted.fields], bad.alias("malformed"))


def write_questions(questions: DataFrame, path: str) -> None:
    """Questions (question, expected) as a file for the benchmark; context and note stay open."""
    names = questions.columns
    rest = [F.lit(None).cast("string").alias(c) for c in ("context", "note") if c not in names]
    questions.select("question", "expected", *[c for c in ("context", "note") if c in names], *rest).write.option("ignoreNullFields", False).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, expected, context, note); a line that is no question is an error, since a benchmark without it would say something else."""
    return spark.read.schema(QUESTIONS).option("mode", "FAILFAST").json(path)


def _yaml_text(value: Column) -> Column:
    """A string in double quotes, in which JSON and YAML agree."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def write_question_list(questions: DataFrame, path: str) -> None:
    """Questions (question, expected) with their context and note, if there are any, as YAML lists of maps."""
    names = [c for c in ("context", "note") if c in questions.columns]
    items = F.array_join(F.transform("expected", _yaml_text), ", ")
    parts = [F.concat(F.lit("- question: "), _yaml_text(F.col("question"))), F.concat(F.lit("  expected: ["), items, F.lit("]"))]
    parts += [F.concat(F.lit(f"  {c}: "), _yaml_text(F.col(c))) for c in names]
    questions.select(F.concat_ws("\n", *parts).alias("value")).write.text(path)


def _plain(raw: Column) -> Column:
    """The value of a scalar: folded (>), kept by lines (|), in quotes, or plain over several lines; null if it is empty."""
    rows = F.transform(F.slice(F.split(raw, "\n"), 2, 1 << 30), lambda x: F.trim(x))
    head = F.trim(F.split(raw, "\n")[0])
    kept = F.regexp_replace(F.array_join(rows, "\n"), r"\s+$", "")
    block = F.when(head.startswith("|"), kept).otherwise(F.regexp_replace(F.regexp_replace(kept, r"(?<!\n)\n(?!\n)", " "), r"\n(\n+)", "$1"))
    folded = F.trim(F.regexp_replace(raw, r"\s*\n\s*", " "))
    double = F.get(F.from_json(F.concat(F.lit("["), folded, F.lit("]")), "array<string>"), F.lit(0))
    single = F.replace(F.regexp_extract(folded, "(?s)^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    bare = F.trim(F.regexp_replace(folded, r"(^|\s)#.*$", ""))
    value = F.when(head.rlike("^[>|][+-]?$"), block).when(folded.rlike('(?s)^".*"$'), double).when(folded.rlike("(?s)^'.*'$"), single).otherwise(bare)
    return F.when(value.isin("", "~", "null") & ~folded.rlike("^[\"']"), F.lit(None)).otherwise(value)


def _several(raw: Column) -> Column:
    """The values of a list, in brackets or one to a line; an empty one for none."""
    quoted = r'"(?:[^"\\]|\\.)*"' + r"|'(?:[^']|'')*'"
    inner = F.regexp_extract(F.trim(raw), r"(?s)^\[(.*)\]\s*(?:#[^\n]*)?$", 1)
    flow = F.regexp_extract_all(inner, F.lit(f"({quoted}|[^,\\s][^,]*)"), F.lit(1))
    below = F.regexp_extract_all(raw, F.lit(r"(?md)^\s*-\s+(\S.*)$"), F.lit(1))
    return F.array_compact(F.transform(F.when(F.trim(raw).startswith("["), flow).otherwise(below), _plain))


def read_question_list(spark: SparkSession, path: str) -> DataFrame:
    """(question, expected, context, note) of files that hold YAML lists of maps, one item a row.

    An item begins with a hyphen in the first column, and its keys stand two columns to the right. Values may be
    plain, quoted, folded or kept by lines; `expected` is a list in brackets or one to a line, and may be missing.
    Comments and empty lines between are skipped, and so are line breaks at the end of a value. Texts before the first item, unknown keys and items without a
    question are errors, since a benchmark without them would say something else. A file is read whole by one
    task; items are rows from then on. Anchors, tags and further nesting aren't read.
    """
    files = spark.read.text(path, wholetext=True)
    content = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"(?md)^(#.*|---\s*)$", "")
    parts = F.split(content, r"(?md)^-(?=[ \t])")
    begins = F.regexp_replace(parts[0], r"\s+", "") == ""
    parts = F.when(begins, F.slice(parts, 2, 1 << 30)).otherwise(F.raise_error(F.lit("text before the first question")))
    items = files.select(F.explode(parts).alias("item"))
    fields = F.filter(F.split(F.concat(F.lit("\n  "), F.ltrim("item")), r"\n  (?=[A-Za-z_]+:(?:\s|$))"), lambda x: F.trim(F.regexp_replace(x, r"\s+", "")) != "")
    key, value = (lambda x: F.regexp_extract(x, r"^([A-Za-z_]+):", 1)), (lambda x: F.regexp_replace(x, r"^[A-Za-z_]+:[ \t]*", ""))
    fields = items.select(F.map_from_entries(F.transform(fields, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))).alias("f"))
    known = F.size(F.array_except(F.map_keys("f"), F.array(*map(F.lit, ("question", "expected", "context", "note"))))) == 0
    question = _plain(F.element_at("f", "question"))
    checked = F.when(known & question.isNotNull(), question).otherwise(F.raise_error(F.concat(F.lit("no question of a known form: "), F.to_json("f"))))
    expected = F.coalesce(_several(F.element_at("f", "expected")), F.array().cast("array<string>"))
    return fields.select(checked.alias("question"), expected.alias("expected"), *[_plain(F.element_at("f", c)).alias(c) for c in ("context", "note")])


def write_report(report: DataFrame, path: str) -> None:
    """A report by combination, to be read as a baseline later."""
    report.write.option("ignoreNullFields", False).json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).option("mode", "FAILFAST").json(path)
