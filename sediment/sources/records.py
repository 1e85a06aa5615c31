"""Sources: session logs and documents in folders, JSON Lines tables, an inventory of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

# Files that hold records.
PATTERNS = ("*.jsonl", "*.json", "*.md", "*.txt", "*.log")
SKIPPED = r"/(?:\.git|\.hg|\.svn|\.venv|venv|node_modules|__pycache__)/"


def record_files(spark: SparkSession, folder: str, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """path, content, modificationTime, length of all record files below a folder; tool folders are skipped."""
    glob = "{" + ",".join(patterns) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).filter(~F.col("path").rlike(SKIPPED))


def inventory(files: DataFrame) -> DataFrame:
    """path, length, modificationTime, sha256 of files."""
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def record_lines(files: DataFrame) -> DataFrame:
    """path, line_number (from 1), line of files; lines end at LF or CRLF only, bytes that aren't UTF-8 are replaced."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.posexplode(F.split(text, "\r?\n")).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_number"), "line")


def json_rows(lines: DataFrame, schema: StructType | str, strict: bool = False) -> DataFrame:
    """The columns of `lines` and row (a struct); blank lines go, and lines that aren't objects go or, if strict, fail the job."""
    whole = lines.filter(F.trim("line") != "")
    odd = ~F.coalesce(F.trim("line").startswith("{"), F.lit(False)) | F.try_parse_json("line").isNull()
    if strict:
        return whole.withColumn("line", F.when(odd, F.raise_error(F.concat(F.lit("not a JSON object: line "), F.col("line_number").cast("string")))).otherwise(F.col("line"))).withColumn("row", F.from_json("line", schema))
    return whole.filter(~odd).withColumn("row", F.from_json("line", schema))


_TEXT_KEYS = ("text", "message", "summary", "output", "content")
_LINE = ", ".join(f"{k} string" for k in ("type", "role", "phase", "channel", "payload", "name", "arguments", *_TEXT_KEYS))


def nested_text(value: Column, depth: int = 3) -> Column:
    """The text of a JSON value (as a string): strings as they are, lists' parts by line, of objects the first of text,
    message, summary, output and content that holds any; down to `depth` levels. Empty if there is none."""
    plain = F.trim(F.coalesce(value, F.lit("")))
    if depth == 0:
        return F.when(~F.substring(plain, 1, 1).isin("[", "{"), plain).otherwise("")

    def of_object(text: Column) -> Column:
        row = F.from_json(text, ", ".join(f"{k} string" for k in _TEXT_KEYS))
        parts = F.filter(F.transform(F.array(*(row[k] for k in _TEXT_KEYS)), lambda x: nested_text(x, depth - 1)), lambda x: x != "")
        return F.coalesce(F.get(parts, F.lit(0)), F.lit(""))

    def part(text: Column) -> Column:
        return F.when(text.startswith("{"), of_object(text)).otherwise(F.trim(text))

    items = F.from_json(plain, "array<string>")
    listed = F.trim(F.array_join(F.filter(F.transform(items, part), lambda x: x != ""), "\n"))
    return F.when(plain.startswith("[") & items.isNotNull(), listed).when(plain.startswith("{") & F.try_parse_json(plain).isNotNull(), of_object(plain)).otherwise(plain)


def clean_command_output(text: Column, limit: int = 240) -> Column:
    """A tool's output without its own head lines, clipped."""
    whole = F.trim(text)
    after = F.when(F.lower(whole).startswith("chunk id:") & whole.contains("\nOutput:\n"), F.substring_index(whole, "\nOutput:\n", -1)).otherwise(whole)
    # Beginnings of lines that a tool's frame adds.
    heads = ("chunk id:", "wall time:", "process exited with code", "original token count:", "write_stdin failed:")
    lines = F.filter(F.split(after, "\r?\n"), lambda x: ~F.trim(F.lower(x)).rlike("^(?:" + "|".join(heads) + ")"))
    return T.clip(F.array_join(lines, "\n"), limit)


def session_events(lines: DataFrame) -> DataFrame:
    """path, line_number, kind, text of session log lines; each line and its payload are parsed once.

    Messages are of their role (that of the envelope, if the payload has none, in any case); rows of another role or none are
    records. Function calls are commands (`name: command`) and their outputs command_output; a payload wins over its envelope.
    Session metadata, turn contexts, event messages and assistants' commentary are no events.
    """
    at = lines.withColumn("_outer", F.from_json("line", _LINE)).withColumn("_body", F.when(F.col("_outer.payload").startswith("{"), F.from_json("_outer.payload", _LINE)).otherwise(F.col("_outer")))
    filled = lambda c: F.nullif(c, F.lit(""))
    outer, inner = F.coalesce(F.col("_outer.type"), F.lit("")), F.coalesce(filled(F.col("_body.type")), F.col("_outer.type"), F.lit(""))
    role = F.lower(F.coalesce(filled(F.col("_body.role")), filled(F.col("_outer.role")), F.lit("")))
    given = F.from_json("_body.arguments", "cmd string, command string, script string")
    command = F.when(
        F.col("_body.arguments").startswith("{"),
        F.coalesce(*(filled(nested_text(given[k], 1)) for k in ("cmd", "command", "script")), T.clip(F.col("_body.arguments"), 240)),
    ).otherwise(T.clip(F.coalesce(F.col("_body.arguments"), F.lit("")), 240))
    name = F.coalesce(filled(nested_text(F.col("_body.name"), 1)), F.lit("tool"))
    call = T.clip(F.when(command != "", F.concat(name, F.lit(": "), command)).otherwise(name), 240)
    output = F.when(F.substring("_body.output", 1, 1).isin("{", "["), nested_text(F.col("_body.output"))).otherwise(clean_command_output(F.coalesce(F.col("_body.output"), F.lit(""))))
    spoken = F.coalesce(*(filled(nested_text(F.col(f"_body.{k}"))) for k in ("content", "text", "message")))
    kind = F.when(inner == "function_call", "command").when(inner == "function_call_output", "command_output").when(role.isin("user", "human"), "user").when(role == "assistant", "assistant").otherwise("record")
    text = F.when(inner == "function_call", call).when(inner == "function_call_output", output).otherwise(spoken)
    aside = F.lower(F.coalesce(filled(F.col("_body.phase")), F.col("_body.channel"), F.lit(""))) == "commentary"
    told = at.filter(~outer.isin("session_meta", "turn_context", "event_msg")).withColumn("kind", kind).withColumn("text", text)
    return told.filter((F.coalesce(F.col("text"), F.lit("")) != "") & ((F.col("kind") != "assistant") | ~aside)).select("path", "line_number", "kind", "text")
