"""Logs of decompiler runs: outcomes, summary, the part that holds code, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions.joins import looked_up
from spoor.functions.text import ctime, one_decimal
from spoor.sources.shared import kept

# --- Fixed values: what the lines of a log look like.
START, END = "--- IR FOR", "--- END"
_EVENTS = {
    "start": r"^--- IR FOR (.*) \(0x([0-9A-F]{8,})\) ---$",
    "end": r"^--- END (.*)() ---$",
    "failed": r"^FAILED (.*) \(0x([0-9A-F]{8,})\): ",
    "exception": r"^EXCEPTION (.*) \(0x([0-9A-F]{8,})\): ",
}


def address(ea: Column) -> Column:
    return F.format_string("0x%08X", ea)


def events(log: DataFrame) -> DataFrame:
    """(log_id, pos, kind, name, ea, message) of the lines ``log_id, pos, line`` that tell an outcome."""
    line = F.col("line")
    kind = F.coalesce(*[F.when(line.rlike(p), k) for k, p in _EVENTS.items()])
    pick = lambda g: F.coalesce(*[F.when(F.col("kind") == k, F.regexp_extract("line", p, g)) for k, p in _EVENTS.items()])
    found = log.withColumn("kind", kind).where("kind IS NOT NULL")
    message = F.when(F.col("kind").isin("failed", "exception"), F.regexp_extract("line", r"\(0x[0-9A-F]{8,}\): (.*)$", 1))
    ea = F.conv(F.nullif(pick(2), F.lit("")), 16, 10).cast("decimal(20,0)")
    return found.select("log_id", "pos", "kind", pick(1).alias("name"), ea.alias("ea"), message.alias("message"))


def summary(found: DataFrame) -> DataFrame:
    """(log_id, processed, successful, failed, success_rate); failed are all that did not end well."""
    out = found.groupBy("log_id").agg(
        F.count_if(F.col("kind") == "start").alias("processed"), F.count_if(F.col("kind") == "end").alias("successful")
    )
    rate = one_decimal(F.try_divide(F.lit(100.0) * F.col("successful"), F.col("processed")))
    return out.select("log_id", "processed", "successful", (F.col("processed") - F.col("successful")).alias("failed"), rate.alias("success_rate"))


def summary_text(row, start: str, end: str, seconds: float) -> str:
    """The summary file of one log on the driver: ``row`` as :func:`summary` makes it, times as they are to be shown."""
    rate = f"{row['success_rate']:.1f}" if row["success_rate"] is not None else "0.0"
    told = [
        f"Start Time: {start}", f"End Time: {end}", f"Total Duration Time: {seconds:.1f} seconds ({seconds / 60:.1f} minutes)",
        f"Total Functions Processed: {row['processed']}", f"Successful: {row['successful']}", f"Failed: {row['failed']}",
        f"Success Rate: {rate}%", "",
    ]
    return "=== SUMMARY ===\n" + "\n".join(f"    {x}" for x in told)


def elapsed(start: Column, end: Column) -> tuple[Column, Column]:
    """Seconds between two timestamps, and minutes, as doubles with one decimal."""
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
    return one_decimal(seconds), one_decimal(seconds / 60)


def summary_texts(counted: DataFrame) -> DataFrame:
    """(log_id, text): the summary file of each log, from rows of :func:`summary` with timestamps ``began`` and ``ended``.

    A log without functions has a rate of 0.0.
    """
    shown = lambda x: F.format_string("%.1f", x)
    seconds, minutes = elapsed(F.col("began"), F.col("ended"))
    told = [
        F.concat(F.lit("Start Time: "), ctime(F.col("began"))), F.concat(F.lit("End Time: "), ctime(F.col("ended"))),
        F.concat(F.lit("Total Duration Time: "), shown(seconds), F.lit(" seconds ("), shown(minutes), F.lit(" minutes)")),
        F.concat(F.lit("Total Functions Processed: "), F.col("processed")), F.concat(F.lit("Successful: "), F.col("successful")),
        F.concat(F.lit("Failed: "), F.col("failed")), F.concat(F.lit("Success Rate: "), shown(F.coalesce("success_rate", F.lit(0.0))), F.lit("%")),
        F.lit(""),
    ]
    lines = [F.concat(F.lit("    "), x) for x in told]
    return counted.select("log_id", F.concat_ws("\n", F.lit("=== SUMMARY ==="), *lines).alias("text"))


def log_files(logs: DataFrame, lines: DataFrame, began: Column, ended: Column) -> DataFrame:
    """(name, pos, line) of the files that a run leaves for each log: ``<log_id>/ir.txt``, if it has one, by line, and
    ``<log_id>/ir_summary.txt`` as one row. Of logs ``log_id`` and their lines ``log_id, pos, line`` as
    :func:`spoor.sources.corpus.logs_by_line` makes them. began and ended: timestamps, of the columns of ``logs``."""
    code = isolated_lines(lines).select(F.concat("log_id", F.lit("/ir.txt")).alias("name"), "pos", "line")
    counted = logs.select("log_id", began.alias("began"), ended.alias("ended")).join(summary(events(lines)), "log_id", "left")
    counted = counted.fillna(0, ["processed", "successful", "failed"])
    nowhere = F.lit(None).cast(lines.schema["pos"].dataType)
    return code.unionAll(summary_texts(counted).select(F.concat("log_id", F.lit("/ir_summary.txt")), nowhere, "text"))


def isolated_lines(lines: DataFrame) -> DataFrame:
    """(log_id, pos, line) of what :func:`isolate` finds in whole logs, from lines of logs whose ``pos`` is a block and a
    number in it. A log that is not ok has none. The first and the last line are cut."""
    start, end = F.instr("line", START), _last_end("line")
    n = lambda which: F.when(F.contains("line", F.lit(which)), F.col("pos.n"))
    blocks = lines.groupBy("log_id", "pos.block").agg(F.min(n(START)).alias("first"), F.max(n(END)).alias("last"))
    pos = lambda which: F.when(F.col(which).isNotNull(), F.struct("block", F.col(which).alias("n")))
    bounds = kept(blocks.groupBy("log_id").agg(F.min(pos("first")).alias("first"), F.max(pos("last")).alias("last")).where("first <= last"), "bounds")
    first, last = F.col("pos") == F.col("first"), F.col("pos") == F.col("last")
    found = looked_up(lines, bounds, "log_id").where("pos BETWEEN first AND last").where(~(first & last) | (start < end))
    cut = F.when(last, F.substring("line", F.lit(1), end + len(END) - 1)).otherwise(F.col("line"))
    return found.select("log_id", "pos", F.when(first, F.substring(cut, start, F.char_length(cut))).otherwise(cut).alias("line"))


def _last_end(text: str) -> Column:
    """Where the last literal end mark of a text that has one begins."""
    return F.char_length(text) - F.instr(F.reverse(text), END[::-1]) - len(END) + 2


def isolate(logs: DataFrame) -> DataFrame:
    """(log_id, ok, text) of whole logs ``log_id, content``: from the first start through the last literal end mark.

    Not ok, with no text, if either is missing or the end does not come after the start.
    """
    start = F.instr("content", START)
    end = _last_end("content")
    ok = (start > 0) & F.contains("content", F.lit(END)) & (start < end)
    return logs.select("log_id", ok.alias("ok"), F.when(ok, F.substring("content", start, end + len(END) - start)).alias("text"))


def is_start(line: Column) -> Column:
    return line.rlike(f"(?iu){START}")


def kilobytes(size: Column) -> Column:
    """Two decimals, halves to even."""
    return F.bround(size / F.lit(1024.0), 2)


def growth(samples: DataFrame) -> DataFrame:
    """Of polls (log_id, ts, size_bytes, start_lines), those at which a log had grown, with ``kb``."""
    from pyspark.sql import Window

    before = F.lag("size_bytes", 1, 0).over(Window.partitionBy("log_id").orderBy("ts"))
    grown = samples.withColumn("before", before).where("size_bytes > before")
    return grown.select("log_id", "ts", "start_lines", kilobytes(F.col("size_bytes")).alias("kb"))


def polled(sizes: DataFrame, logs: DataFrame) -> DataFrame:
    """(log_id, size_bytes, start_lines) of whole logs at one moment: sizes (log_id, size_bytes), logs (log_id, content).

    All lines are counted anew, as a poll that reads the whole file does.
    """
    started = F.size(F.filter(F.split("content", "\n", -1), is_start)).cast("long")
    return sizes.join(logs.select("log_id", started.alias("start_lines")), "log_id", "left").select(
        "log_id", "size_bytes", F.coalesce("start_lines", F.lit(0).cast("long")).alias("start_lines")
    )
