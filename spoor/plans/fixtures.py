"""Synthetic corpora made from table columns, so that what is found can be told from the columns alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOPS = "nop\n" * 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def asm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each supplier: hashes but for every third, indicators but for every fifth."""
    s = table(spark, sf_dir, "supplier")
    k, name = F.col("s_suppkey"), F.col("s_name")
    head = _text(
        "; Input SHA256 : ", F.upper(F.sha2(name.cast("binary"), 256)), "\n; Input MD5    : ", F.md5(name), "\n; Input CRC32  : ",
        F.lpad(F.hex(k), 8, "0"), "\n; File Name   : C:\\src\\bin\\x.exe\n; |  This file was generated by a tool |\n",
    )
    body = _text(
        'start:\n  db "https://c', k, ".evil.example.xyz/p/", k, '",0\n  db "C:\\work\\job', k, '\\run.bin",0\n',
        '  db "C:\\Program Files\\tool\\bin\\t', k, '.cfg",0\n  db "\\\\host', k, '\\share\\d\\f.txt",0\n  mov eax, lib', k,
        ".dll\n  call main.f", k, "\n  lea eax, SSHClient", k, '\n  db "user', k, '@openssh.com",0\n  db "%s and ', k, '",0\n',
    )
    content = F.concat(F.when(k % 3 != 0, head).otherwise(""), F.when(k % 5 != 0, body).otherwise("nothing here\n"))
    return s.select(_text("supplier-", k, ".asm").alias("path"), content.alias("content"))


def asm_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each nation in which one registry key counts, and each other line breaks one rule."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    content = _text(
        "HTTP://EVIL.EXAMPLE/AAAAAAAA\nsocks://h.example/aaaaaaaa\nhttps://x...y.example/aaaaaaaa\nwww.golang.org\n", "D:\\data\\n", k,
        ".dat\nC:\\go\\pkg\\mod\\x@v1.2.3\\src\\a.go\nHKEY_LM\\Software\n", '"HKEY_CU\\CLXID', k, '"\n',
    )
    return n.select(_text("nation-", k, ".asm").alias("path"), content.alias("content"))


def pseudo_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part in a file for each brand; every seventh is defined again in a last file."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    first = _text(NOPS, "int f_", k, "(int a1)\n{\n  g_", k, "(a1);\n  if ( a1 )\n    return f_", k + 1, "(a1);\n}\n")
    again = _text(NOPS, "int f_", k, "(int a1)\n{\n  h_", k, "(a1);\n}\n")
    parts = p.select(F.col("p_brand").alias("path"), k.alias("k"), first.alias("t")).unionAll(
        p.where(k % 7 == 0).select(F.lit("zz").alias("path"), k.alias("k"), again.alias("t"))
    )
    files = _in_files(parts)
    entry = spark.createDataFrame([("0", "int start_main(int a1)\n{\n  f_1(a1);\n}\n")], "path string, content string")
    return entry.unionAll(files)


def _in_files(parts: DataFrame) -> DataFrame:
    """(path, content) of texts (path, k, t), in order of k."""
    return parts.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "").alias("content")
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each part that one of the patterns of headers takes for a function, in a file for each brand."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    lines = (
        ("int f_", "(int a1)"), ("int *__fastcall f_", "(int a1)"), ("int t_", " x(int a1) {"), ("t_u64 f_", "(int a1)"),
        ("FILE *f_", "(const char *a1,"), ("* *f_", "(int a1)"), ("int x", " = y(int a1)"), ("// int f_", "(int a1)"),
    )
    text = F.coalesce(*[F.when(k % len(lines) == i, _text(a, k, b, "\n")) for i, (a, b) in enumerate(lines)])
    return _in_files(p.select(F.col("p_brand").alias("path"), k.alias("k"), text.alias("t")))


def marked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part: calls of itself near and far, and calls of what looks like a variable, near and far."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    bodies = (("  f_", k, "(a1);\n"), ("nop\n" * 12, "  f_", k, "(a1);\n"), ("  q_", k, " = 1;\n  q_", k, "(a1);\n"), ("  q_", k, " = 1;\n", "nop\n" * 30, "  q_", k, "(a1);\n"))
    body = F.coalesce(*[F.when(k % 4 == i, _text(*b)) for i, b in enumerate(bodies)])
    parts = p.select(F.col("p_brand").alias("path"), k.alias("k"), _text(NOPS, "int f_", k, "(int a1)\n{\n", body, "}\n").alias("t"))
    return _in_files(parts)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each customer that calls the next one's, defined in falling order; the entry calls the first one's."""
    k = F.col("c_custkey")
    text = _text(NOPS, "int f_", k, "(int a1)\n{\n  f_", k + 1, "(a1);\n}\n")
    rows = table(spark, sf_dir, "customer").select(F.lit("chain").alias("path"), (-k).alias("k"), text.alias("t"))
    entry = spark.createDataFrame([("0", "int start_main(int a1)\n{\n  f_1(a1);\n}\n")], "path string, content string")
    return entry.unionAll(_in_files(rows))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, pos, line) of the logs of :func:`ir_log`, with lines around them; the log of a status that no order has is empty."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("log_id")).distinct()
    around = spark.createDataFrame([(-1, "banner"), (2**63 - 1, "tail")], "pos long, line string")
    log = ir_log(spark, sf_dir).unionAll(ids.join(F.broadcast(around)).select("log_id", "pos", "line"))
    log = log.withColumn("log_id", F.translate("log_id", " ", "_"))
    log = log.unionAll(spark.createDataFrame([("empty", 0, "nothing"), ("empty", 1, "")], "log_id string, pos long, line string"))
    return log.select("log_id", F.struct(F.expr("pos div 200000").alias("block"), F.col("pos").alias("n")).alias("pos"), "line")


def relative_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with an address for each customer with links that are relative in several ways; every third has a base tag."""
    k = F.col("c_custkey")
    base = F.when(k % 3 == 0, "<base href='https://cdn.example/b/'>").otherwise("")
    rest = _text(
        '<a href="get.php?id=', k, '&amp;x=2">Download</a><a href="/abs/', k, '">Download</a><a href="../up/', k,
        '">Download</a><a href="//other.example/', k, '">Download</a>',
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("page_id"), _text("https://h", k % 3, ".example/a/b", k, "/list.html").alias("url"), F.concat(base, rest).alias("html")
    )


def ir_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines for each order in a log for each priority: a start, and an end, a failure or an exception by status."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    where = _text("fn_", k, " (", F.format_string("0x%08X", k), ")")
    start = _text("--- IR FOR ", where, " ---")
    out = (
        F.when(F.col("o_orderstatus") == "F", _text("--- END fn_", k, " ---"))
        .when(F.col("o_orderstatus") == "O", _text("FAILED ", where, ": no IR generated"))
        .otherwise(_text("EXCEPTION ", where, ": boom"))
    )
    both = F.array(F.struct((k * 2).alias("pos"), start.alias("line")), F.struct((k * 2 + 1).alias("pos"), out.alias("line")))
    each = o.select(F.col("o_orderpriority").alias("log_id"), F.explode(both).alias("x"))
    return each.select("log_id", "x.pos", "x.line")


def download_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer with four anchors, of which one is a download link."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    html = _text(
        '<p><a href="/d/', k % 50, '"> Download <i>x</i></a><a href="">Download</a><a href="/e/', k, '">download</a>',
        "<A class=y href='/f/", k, "'><b>Download</b> y</A></p>",
    )
    return c.select(k.alias("page_id"), html.alias("html"))
