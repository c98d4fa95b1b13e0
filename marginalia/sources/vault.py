"""Markdown notes to sections, edges and actions; listings, change gates and other small sources."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

SECTIONS = "section_uid string, note_id string, parent_uid string, note_title string, heading string, heading_path string, body string, path string, start_line int, end_line int, order_index int, status string, tags array<string>"
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*(?:\{#([^}]+)\})?\s*$")
_FIELD = re.compile(r"^([A-Za-z_]+):\s*(.*)$")


def slug(text: str) -> str:
    return re.sub(r"[^\w]+", "-", text.lower()).strip("-")


def front_matter(lines: list[str]) -> tuple[dict[str, str], int]:
    """(fields, lines that they take) of a note."""
    if not lines or lines[0].strip() != "---":
        return {}, 0
    for end in range(1, len(lines)):
        if lines[end].strip() == "---":
            found = (_FIELD.match(x) for x in lines[1:end])
            return {m[1]: m[2].strip().strip("\"'") for m in found if m}, end + 1
    return {}, 0


def note_sections(path: str, content: str) -> list[dict]:
    """The sections of one note. A heading closes the open sections of its level and below; text before the first is a section of its own."""
    lines = content.split("\n")
    fields, first = front_matter(lines)
    note = fields.get("id") or slug(path.rsplit("/", 1)[-1].removesuffix(".md"))
    title = fields.get("title") or next((m[2] for x in lines[first:] if (m := _HEADING.match(x))), note)
    tags = [t.strip() for t in fields.get("tags", "").strip("[]").split(",") if t.strip()]
    out: list[dict] = []
    open_: list[tuple[int, str, str]] = []
    body: list[str] = []
    fenced = False

    def close(end: int) -> None:
        if out and out[-1]["body"] is None:
            out[-1] |= {"body": "\n".join(body).strip(), "end_line": end}
        elif not out and "".join(body).strip():
            out.append({"section_uid": f"{note}#preamble", "note_id": note, "parent_uid": None, "note_title": title, "heading": None, "heading_path": title, "body": "\n".join(body).strip(), "path": path, "start_line": first + 1, "end_line": end, "order_index": 0, "status": fields.get("status"), "tags": tags})
        body.clear()

    for n, line in enumerate(lines[first:], first + 1):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else _HEADING.match(line)
        if not m:
            body.append(line)
            continue
        close(n - 1)
        level = len(m[1])
        while open_ and open_[-1][0] >= level:
            open_.pop()
        uid = f"{note}#{m[3] or slug(m[2])}"
        out.append({"section_uid": uid, "note_id": note, "parent_uid": open_[-1][1] if open_ else None, "note_title": title, "heading": m[2], "heading_path": " > ".join([*(h for _, _, h in open_), m[2]]), "body": None, "path": path, "start_line": n, "end_line": n, "order_index": len(out), "status": fields.get("status"), "tags": tags})
        open_.append((level, uid, m[2]))
    close(len(lines))
    return out


def sections(notes: DataFrame) -> DataFrame:
    """Sections of notes (path, content); a null content gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in SECTIONS.split(", ")]
        for batch in batches:
            rows = [s for p, c in zip(batch["path"], batch["content"]) if c for s in note_sections(p or "", c)]
            yield pd.DataFrame(rows, columns=names)

    return notes.select("path", "content").mapInPandas(run, SECTIONS)


def note_fields(notes: DataFrame) -> DataFrame:
    """(path, id, title, topic, tags, apps, project, status, supersedes) of the block between --- lines at the start of notes (path, content); null where a field is missing.

    Lists are written [a, b]; a key that is written twice has its last value.
    """
    block = F.regexp_extract(F.regexp_replace("content", "\r\n", "\n"), r"(?s)\A---[ \t]*\n(.*?)(?:\A|(?<=\n))---[ \t]*(?:\n|\z)", 1)
    line = r"(?m)^([A-Za-z_]+):[ \t]*(.*)$"
    pairs = F.arrays_zip(F.regexp_extract_all("b", F.lit(line), F.lit(1)).alias("k"), F.regexp_extract_all("b", F.lit(line), F.lit(2)).alias("v"))
    rows = notes.select("path", block.alias("b")).withColumn("x", F.reverse(pairs))

    def field(name: str) -> Column:
        value = F.get(F.filter("x", lambda p: p["k"] == name), F.lit(0))["v"]
        return F.regexp_replace(F.trim(value), r"^[\"']+|[\"']+$", "")

    def items(name: str) -> Column:
        parts = F.split(F.regexp_replace(field(name), r"^\[+|\]+$", ""), ",")
        return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")

    plain = {n: field(n).alias(n) for n in ("id", "title", "topic", "project", "status", "supersedes")}
    return rows.select("path", plain["id"], plain["title"], plain["topic"], items("tags").alias("tags"), items("apps").alias("apps"), plain["project"], plain["status"], plain["supersedes"])


def edges(rows: DataFrame) -> DataFrame:
    """(src, dst, relation): written relations "type:: [[uid]]", bare links [[uid]], and `parent` edges to the section above."""
    typed = r"(?m)^\s*([a-z]+)::\s*\[\[([^\]]+)\]\]"
    written = rows.select("section_uid", F.explode(F.arrays_zip(F.regexp_extract_all("body", F.lit(typed), F.lit(1)).alias("t"), F.regexp_extract_all("body", F.lit(typed), F.lit(2)).alias("u"))).alias("x"))
    a = written.select(F.col("section_uid").alias("src"), F.col("x.u").alias("dst"), F.col("x.t").alias("relation"))
    rest = F.regexp_replace("body", typed, "")
    b = rows.select(F.col("section_uid").alias("src"), F.explode(F.regexp_extract_all(rest, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("dst"), F.lit("link").alias("relation"))
    c = rows.filter("parent_uid IS NOT NULL").select(F.col("section_uid").alias("src"), F.col("parent_uid").alias("dst"), F.lit("parent").alias("relation"))
    return a.union(b).union(c).distinct()


def actions(rows: DataFrame) -> DataFrame:
    """(section_uid, kind, target, line, seconds) of lines "@file PATH[:LINE]", "@video URL [HH:MM:SS]", "@app", "@project" and "@url"."""
    lines = rows.select("section_uid", F.explode(F.split("body", "\n")).alias("l"))
    found = lines.select("section_uid", F.regexp_extract("l", r"^\s*@(file|video|app|project|url)\s+(.+?)\s*$", 1).alias("kind"), F.regexp_extract("l", r"^\s*@(file|video|app|project|url)\s+(.+?)\s*$", 2).alias("rest")).filter("kind <> ''")
    line = F.when(F.col("kind") == "file", F.regexp_extract("rest", r":(\d+)$", 1))
    clock = F.when(F.col("kind") == "video", F.regexp_extract("rest", r"\s(\d+(?::\d+){1,2})$", 1))
    in_url = F.when(F.col("kind") == "video", F.regexp_extract("rest", r"[?&]t=(\d+)s?", 1))
    parts = F.transform(F.reverse(F.split(clock, ":")), lambda x: x.cast("long"))
    seconds = F.when(clock != "", F.get(parts, F.lit(0)) + F.get(parts, F.lit(1)) * 60 + F.coalesce(F.get(parts, F.lit(2)), F.lit(0)) * 3600).when(in_url != "", F.try_to_number(in_url, F.lit("9999999999")).cast("long"))
    target = F.when(F.col("kind") == "file", F.regexp_replace("rest", r":\d+$", "")).when(F.col("kind") == "video", F.regexp_replace(F.regexp_replace("rest", r"\s\d+(?::\d+){1,2}$", ""), r"[?&]t=\d+s?", "")).otherwise(F.col("rest"))
    return found.select("section_uid", "kind", target.alias("target"), F.when(line != "", line.cast("int")).alias("line"), seconds.alias("seconds"))


#: Bytes of a token, as the packing counts them.
TOKEN_BYTES = 3.6
#: Where a text may be cut, the best place first: after paragraphs, lines, sentences and words.
_CUTS = [re.compile(p) for p in (r"\n\n", r"\n", r"[.!?] ", r" ")]


def cut_parts(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of at most `size` UTF-8 bytes that cover a text; each begins up to `overlap` bytes before the end of the last, at a word.

    A part ends after the last paragraph that fits in its second half; else after the last line, sentence, word
    or, in an unbroken run, character there.
    """
    raw, at = text.encode(), 0
    chars = lambda to: len(raw[:to].decode())
    done = 0  # characters before `at`
    while True:
        limit = min(at + size, len(raw))
        while limit < len(raw) and raw[limit] & 0xC0 == 0x80:
            limit -= 1
        end = limit
        if limit < len(raw):
            half = at + (limit - at) // 2
            while raw[half] & 0xC0 == 0x80:
                half += 1
            window = raw[half:limit].decode()
            for pattern in _CUTS:
                if found := [m.end() for m in pattern.finditer(window)]:
                    end = half + len(window[: found[-1]].encode())
                    break
        stop = done + len(raw[at:end].decode())
        yield done, stop
        if end >= len(raw):
            return
        back = max(at + 1, end - overlap)
        while raw[back] & 0xC0 == 0x80:
            back += 1
        space = raw.find(b" ", back, end)
        begin = space + 1 if space >= 0 else end
        begin = begin if begin > at else end
        done, at = done + len(raw[at:begin].decode()), begin


@udtf(returnType="chunk int, from_char int, part string")
class Parts:
    """The parts of a text, or the text itself as part 0 if it has no more than `most` tokens."""

    def eval(self, text: str, most: int, size: int, overlap: int):
        if text is None or len(text.encode()) <= most * TOKEN_BYTES:
            yield 0, 0, text or ""
        else:
            for k, (s, e) in enumerate(cut_parts(text, int(size * TOKEN_BYTES), int(overlap * TOKEN_BYTES))):
                yield k, s, text[s:e]


def subchunks(rows: DataFrame, most: int = 700, size: int = 450, overlap: int = 60) -> DataFrame:
    """(section_uid, parent_uid, chunk, from_char, body): sections of more than `most` estimated tokens in parts of `size` at most, the others as they are.

    A part is named uid/number and has the section as its parent; one that isn't cut keeps its name and has none.
    """
    if not 0 <= overlap < size / 2:
        raise ValueError("parts overlap by less than half their size")
    text = rows.select("section_uid", F.coalesce("body", F.lit("")).alias("body"))
    out = text.lateralJoin(Parts(F.col("body").outer(), F.lit(most), F.lit(size), F.lit(overlap)))
    whole = F.octet_length("body") <= most * TOKEN_BYTES
    uid = F.col("section_uid").cast("string")
    name, parent = F.when(whole, uid).otherwise(F.concat_ws("/", uid, "chunk")), F.when(~whole, uid)
    return out.select(name.alias("section_uid"), parent.alias("parent_uid"), "chunk", "from_char", F.col("part").alias("body"))


def joined_parts(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, parent_uid, first, n, body): parts (by, parent_uid, chunk, from_char, body) of a section that follow each other, without what they share.

    The parts of a run are those of one section, so they are few.
    """
    order = W.partitionBy(*by, "parent_uid").orderBy("chunk")
    runs = parts.withColumn("run", F.col("chunk") - F.row_number().over(order))
    rows = F.array_sort(F.collect_list(F.struct("chunk", "from_char", "body")))
    start = F.struct(F.lit("").alias("text"), F.lit(-1).alias("end"))

    def add(acc, x):
        skip = F.when(acc["end"] < 0, F.lit(0)).otherwise(acc["end"] - x["from_char"])
        return F.struct(F.concat(acc["text"], F.substring(x["body"], skip + 1, F.length(x["body"]))).alias("text"), (x["from_char"] + F.length(x["body"])).alias("end"))

    gathered = runs.groupBy(*by, "parent_uid", "run").agg(F.min("chunk").alias("first"), F.count("*").alias("n"), rows.alias("x"))
    return gathered.select(*by, "parent_uid", "first", "n", F.aggregate("x", start, add)["text"].alias("body"))


def below(path: Column, root: str) -> Column:
    """The part of a file's path below a root, which may be given with or without a scheme."""
    return F.regexp_replace(path, r"^.*?" + re.escape(root.rstrip("/").split(":")[-1].lstrip("/")) + "/", "")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the Markdown files below a folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return files.select(below(F.col("path"), folder).alias("path"), F.decode("content", "UTF-8").alias("content"))


def absolute(path, root: str):
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def accepted(files: DataFrame, include: list[str], exclude: list[str], path: str = "path") -> DataFrame:
    """Files that no exclude pattern matches and, if there are any, an include pattern does. Patterns know *, ** and ?."""

    return files.filter(_accepts(F.col(path), include, exclude))


def _accepts(path: Column, include: list[str], exclude: list[str]) -> Column:
    def any_of(globs: list[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            pattern = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.split(r"(\*\*/|\*\*|\*|\?)", g) if p)
            out = out | path.rlike(f"^{pattern}$")
        return out

    return ~any_of(exclude) & (any_of(include) if include else F.lit(True))


def accepted_counts(files: DataFrame, sources: dict[str, tuple[list[str], list[str]]], path: str = "path") -> DataFrame:
    """(source, n, warning) for each source's (include, exclude) patterns over the files, in one pass; a source that accepts none has a warning."""
    counts = files.agg(*[F.count_if(_accepts(F.col(path), *globs)).alias(name) for name, globs in sources.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.col(n).alias("n")) for n in sources])).alias("x")).select("x.*")
    return rows.withColumn("warning", F.when(F.col("n") == 0, "its patterns match no file"))


def change_gate(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): added, changed, unchanged or removed, by content hash."""
    joined = before.select("path", F.col("content_hash").alias("was")).join(now.select("path", F.col("content_hash").alias("is")), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "unchanged").otherwise("changed")
    return joined.select("path", change.alias("change"))


def desktop_entries(files: DataFrame) -> DataFrame:
    """(app_id, app_name, exec) of .desktop files (dir_rank, app_id, content): the first folder wins, hidden entries go, only the main group counts."""
    main = F.regexp_extract("content", r"(?s)\[Desktop Entry\]\n(.*?)(?:\n\[|\z)", 1)
    value = lambda key: F.regexp_extract(F.concat(F.lit("\n"), F.col("main")), rf"\n{key}\s*=\s*([^\n]*)", 1)
    rows = files.withColumn("r", F.row_number().over(W.partitionBy("app_id").orderBy("dir_rank"))).filter("r = 1").withColumn("main", main)
    out = rows.select("app_id", value("Name").alias("app_name"), value("Exec").alias("exec"), F.lower(value("NoDisplay")).alias("n"), F.lower(value("Hidden")).alias("h"))
    return out.filter("n <> 'true' AND h <> 'true' AND app_name <> ''").select("app_id", "app_name", "exec")
