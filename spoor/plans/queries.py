"""The registered queries and the DuckDB SQL that tells their results from the columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import cli
from spoor.operators import callgraph, footprint, irlog, links, report
from spoor.operators import functions as fn
from spoor.plans import fixtures as fx
from spoor.sources import corpus as sources
from spoor.sources.shared import digests, kept, shared_dir, write_files, write_lines, write_text
from spoor.streaming import ledger as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Footprint.

IOC_SQL = r"""
SELECT 'supplier-' || s_suppkey || '.asm' AS path, category, replace(v, '@', s_suppkey::VARCHAR) AS value
FROM supplier, (VALUES ('protocols_full', 'https://c@.evil.example.xyz/p/@'), ('urls', 'https://c@.evil.example.xyz/p/@'),
  ('domains', 'c@.evil.example.xyz'), ('files', 'lib@.dll'), ('main_patterns', 'main.f@'), ('ssh_patterns', 'SSHClient@'),
  ('operational_files', 'C:\work\job@\run.bin'), ('operational_files', '\\host@\share\d\f.txt'),
  ('dependency_paths', 'C:\Program Files\tool\bin\t@.cfg')) AS x(category, v)
WHERE s_suppkey % 5 <> 0
"""


@query(IOC_SQL)
def footprint_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprint.indicators(fx.asm(spark, sf_dir))


@query("""
SELECT 'supplier-' || s_suppkey || '.asm' AS path, CASE WHEN s_suppkey % 3 <> 0 THEN sha256(s_name) END AS sha256,
       CASE WHEN s_suppkey % 3 <> 0 THEN md5(s_name) END AS md5,
       CASE WHEN s_suppkey % 3 <> 0 THEN lpad(lower(to_hex(s_suppkey)), 8, '0') END AS crc32 FROM supplier
""")
def footprint_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprint.file_hashes(fx.asm(spark, sf_dir))


@query("""
SELECT 'supplier-' || s_suppkey || '.asm' AS path, category, replace(v, '@', s_suppkey::VARCHAR) || e AS value
FROM supplier, (VALUES ('openssh_full', 'user@', '@openssh.com'), ('domains', 'openssh', '.com'), ('files', 'openssh', '.com')) AS x(category, v, e)
WHERE s_suppkey % 5 <> 0
""")
def footprint_openssh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a denylist, what the default one always hides."""
    return footprint.indicators(fx.asm(spark, sf_dir), deny=[]).where(F.contains("value", F.lit("openssh")))


@query("SELECT 'nation-' || n_nationkey || '.asm' AS path, 'operational_files' AS category, 'HKEY_CU\\CLXID' || n_nationkey AS value FROM nation")
def footprint_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprint.indicators(fx.asm_rejected(spark, sf_dir))


@query("""
WITH p AS (SELECT page_id::VARCHAR AS path, url, split_part(url, '/', 3) AS host FROM pages)
SELECT path, 'protocols_full' AS category, url AS value FROM p UNION ALL SELECT path, 'urls', url FROM p
UNION ALL SELECT path, 'domains', host FROM p UNION ALL SELECT path, 'files', host FROM p WHERE host LIKE '%.com'
""")
def footprint_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is found in addresses of pages: themselves, their hosts, and hosts that look like programs."""
    pages = fx.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("url").alias("content"))
    return footprint.indicators(pages)


@query("""
SELECT count(*) AS total_files, count(*) FILTER (s_suppkey % 5 <> 0) AS with_iocs, count(*) FILTER (s_suppkey % 3 <> 0) AS with_hashes,
       0::BIGINT AS with_errors FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 3 <> 0
""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(footprint.scan(fx.asm(spark, sf_dir)))


@query("""
SELECT ord, label, (m * c)::BIGINT AS n FROM (SELECT count(*) AS c FROM supplier WHERE s_suppkey % 5 <> 0),
  (VALUES (1, 'Protocol URLs', 1), (2, 'URLs', 1), (3, 'Domains', 1), (4, 'Files', 1), (5, 'Main Functions/Variables', 1),
          (6, 'SSH Client References', 1), (8, 'Operational Files', 2), (9, 'Dependency/Library Paths', 1)) AS x(ord, label, m)
WHERE c > 0
""")
def report_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.categories(footprint.indicators(fx.asm(spark, sf_dir)))


@query(r"""
SELECT 'supplier-' || k || '.asm' AS path, 'File: supplier-' || k || '.asm' || chr(10) || repeat('-', 60) || chr(10)
  || CASE WHEN k % 3 <> 0 THEN 'File Hashes:' || chr(10) || 'SHA256: ' || sha256(s_name) || chr(10) || 'MD5: ' || md5(s_name) || chr(10) || 'CRC32: ' || lpad(lower(to_hex(k)), 8, '0') || chr(10) || chr(10) ELSE '' END
  || CASE WHEN k % 5 <> 0 THEN replace(replace('Protocol URLs:~https://c@.evil.example.xyz/p/@~~URLs:~https://c@.evil.example.xyz/p/@~~Domains:~c@.evil.example.xyz~~Files:~lib@.dll~~Main Functions/Variables:~main.f@~~SSH Client References:~SSHClient@~~Operational Files:~C:\work\job@\run.bin~\\host@\share\d\f.txt~~Dependency/Library Paths:~C:\Program Files\tool\bin\t@.cfg~~', '@', k::VARCHAR), '~', chr(10)) ELSE '' END AS block
FROM (SELECT s_suppkey AS k, s_name FROM supplier) WHERE k % 5 <> 0 OR k % 3 <> 0
""")
def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.blocks(footprint.scan(fx.asm(spark, sf_dir)))


@query("SELECT p_partkey::VARCHAR AS path, 'x' AS category, p_name AS value FROM part WHERE NOT EXISTS (SELECT 1 FROM nation WHERE contains(lower(p_name), lower(n_name)) OR contains(lower(p_name), lower(left(n_name, 3))))")
def denylist_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("x").alias("category"), F.col("p_name").alias("value"))
    n = fx.table(spark, sf_dir, "nation")
    terms = n.select(F.lower("n_name").alias("term")).unionAll(n.select(F.lower(F.left("n_name", F.lit(3))).alias("term")))
    return footprint.without_denied(parts, terms)


# Functions and call graph.


def _graph(spark: SparkSession, sf_dir: str) -> tuple:
    """Bodies and calls are written once, since what follows reads them several times."""
    return _graph_of(sources.ordered(fx.pseudo_c(spark, sf_dir)))


def _graph_of(corpus: DataFrame) -> tuple:
    found = kept(fn.definitions(corpus), "definitions")
    defined = fn.functions(found)
    edges = kept(callgraph.calls(defined), "calls")
    missed = callgraph.missing(edges, defined)
    names = callgraph.kept_names(defined, missed, [p for _, p in sources.library()])
    return corpus, found, defined, edges, missed, names


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.ordered(fx.pseudo_c(spark, sf_dir))


_N = "(SELECT max(p_partkey) FROM part)"
_BODY = """CASE WHEN p_partkey % 7 = 0 THEN 'int f_' || p_partkey || '(int a1)~{~  h_' || p_partkey || '(a1);~}'
 ELSE 'int f_' || p_partkey || '(int a1)~{~  g_' || p_partkey || '(a1);~  if ( a1 )~    return f_' || (p_partkey + 1) || '(a1);~}' END"""
_FUNCTIONS = f"""SELECT 'f_' || p_partkey AS name, replace({_BODY}, '~', chr(10)) AS body, p_partkey AS k, p_brand AS b FROM part
 UNION ALL SELECT 'start_main', replace('int start_main(int a1)~{{~  f_1(a1);~}}', '~', chr(10)), 0, ''"""
_EDGES = """SELECT 'f_' || p_partkey AS src, 'g_' || p_partkey AS dst, p_partkey AS k, 1 AS o FROM part WHERE p_partkey % 7 <> 0
 UNION ALL SELECT 'f_' || p_partkey, 'if', p_partkey, 2 FROM part WHERE p_partkey % 7 <> 0
 UNION ALL SELECT 'f_' || p_partkey, 'f_' || (p_partkey + 1), p_partkey, 3 FROM part WHERE p_partkey % 7 <> 0
 UNION ALL SELECT 'f_' || p_partkey, 'h_' || p_partkey, p_partkey, 1 FROM part WHERE p_partkey % 7 = 0
 UNION ALL SELECT 'start_main', 'f_1', 0, 1"""
_MISSING = f"SELECT DISTINCT dst AS name FROM ({_EDGES}) WHERE dst NOT IN (SELECT name FROM ({_FUNCTIONS}))"
_FLOW = """SELECT '0' AS corpus_id, (row_number() OVER (ORDER BY r, k) - 1)::INTEGER AS seq, name FROM (
  SELECT name, k, CASE WHEN name = 'start_main' OR k BETWEEN 1 AND 7 THEN -1
    ELSE min(i) OVER (PARTITION BY name = 'start_main', (k + 6) // 7 ORDER BY k ROWS UNBOUNDED PRECEDING) END AS r
  FROM (SELECT 'f_' || p_partkey AS name, p_partkey AS k, row_number() OVER (ORDER BY p_brand, p_partkey) AS i FROM part
        UNION ALL SELECT 'start_main', 0, 0))"""


@query("SELECT CASE WHEN w = 'zz' THEN 'zz' ELSE p_brand END AS path, 'f_' || p_partkey AS name FROM part, (VALUES ('a'), ('zz')) AS x(w) WHERE w = 'a' OR p_partkey % 7 = 0 UNION ALL SELECT '0', 'start_main'")
def function_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.definitions(_corpus(spark, sf_dir)).select("path", "name")


@query("""
SELECT path, n AS line_no, name FROM (
  SELECT p_brand AS path, 'f_' || p_partkey AS name, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) * 11 + 5)::INTEGER AS n FROM part
  UNION ALL SELECT p_brand, 'if', ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) * 11 + 8)::INTEGER FROM part
  UNION ALL SELECT 'zz', 'f_' || p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) * 9 + 5)::INTEGER FROM part WHERE p_partkey % 7 = 0
  UNION ALL SELECT '0', 'start_main', 0)
""")
def function_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fn.headers(_corpus(spark, sf_dir)).select("path", F.explode("found").alias("f"))
    return found.select("path", F.col("f.line_no").cast("int").alias("line_no"), "f.name")


@query(f"SELECT name, body FROM ({_FUNCTIONS})")
def function_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last definition of each function."""
    return fn.functions(fn.definitions(_corpus(spark, sf_dir))).select("name", "body")


@query("""
SELECT p_brand AS path, count(*) AS n, 0::BIGINT AS low, 1::BIGINT AS high FROM part GROUP BY p_brand
UNION ALL SELECT 'zz', count(*), 0, 1 FROM part WHERE p_partkey % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT '0', 1, 0, 1
""")
def brace_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fn.brace_balance(sources.lines(_corpus(spark, sf_dir))).groupBy("path")
    return out.agg(F.count_if(F.col("line") == "{").alias("n"), F.min("balance").alias("low"), F.max("balance").alias("high"))


@query(f"SELECT src, dst FROM ({_EDGES})")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.calls(fn.functions(fn.definitions(_corpus(spark, sf_dir)))).select("src", "dst")


@query(_MISSING)
def missing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[4].select("name")


@query(f"SELECT name FROM ({_FUNCTIONS}) UNION SELECT name FROM ({_MISSING}) WHERE name <> 'if'")
def kept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[5].select("name")


@query("SELECT n_name AS name FROM nation WHERE NOT (n_name GLOB 'A*' OR n_name GLOB '*IA' OR n_name GLOB '?RA*' OR n_name = 'CHINA')")
def wildcard_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    library = callgraph.library_table(spark, [("F", "A*"), ("F", "*IA"), ("N", "?RA*"), ("N", "CHINA")])
    return callgraph.without_matches(names, library)


@query(f"SELECT src, dst FROM ({_EDGES}) WHERE dst <> 'if'")
def kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, edges, _, names = _graph(spark, sf_dir)
    return callgraph.kept_edges(edges, names).select("src", "dst")


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), f AS ({_FUNCTIONS}), r(name) AS (SELECT 'start_main' UNION SELECT dst FROM e JOIN r ON src = r.name JOIN f ON f.name = dst)
SELECT name FROM r
""")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, defined, edges, _, _ = _graph(spark, sf_dir)
    return callgraph.reachable(edges, fn.entry_point(found), defined).select("name")


@query(_FLOW)
def dfs_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, defined, edges, _, _ = _graph(spark, sf_dir)
    return callgraph.flow(defined, edges, fn.entry_point(found))


@query(f"""
SELECT '0' AS corpus_id, '=== ORGANIZED CODE ===' || chr(10) || 'total functions included: ' || count(*) || chr(10) || chr(10) || '=== FUNCTIONS IN EXECUTION ORDER ===' || chr(10) || chr(10)
  || string_agg('// function name: ' || name || chr(10) || chr(10) || body || chr(10) || chr(10) || repeat('=', 50) || chr(10) || chr(10), '' ORDER BY seq) AS text
FROM ({_FLOW}) JOIN ({_FUNCTIONS}) USING (name)
""")
def organized_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, defined, edges, _, names = _graph(spark, sf_dir)
    return callgraph.organized_code(callgraph.flow(defined, edges, fn.entry_point(found)), defined, names)


@query(f"""
SELECT '0' AS corpus_id, '=== FUNCTION CALL GRAPH ===' || chr(10) || string_agg(src || ' -> ' || dst || chr(10), '' ORDER BY seq, o) AS text
FROM ({_EDGES}) JOIN ({_FLOW}) ON name = src WHERE dst <> 'if'
""")
def flow_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, defined, edges, _, names = _graph(spark, sf_dir)
    return callgraph.flow_chart(callgraph.flow(defined, edges, fn.entry_point(found)), edges, names)


@query(f"""
SELECT '0' AS corpus_id, '=== MISSING FUNCTIONS (' || count(*) || ') ===' || chr(10) || string_agg(name, chr(10) ORDER BY name) AS text
FROM ({_MISSING}) WHERE name <> 'if'
""")
def missing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, _, _, missed, names = _graph(spark, sf_dir)
    return callgraph.missing_text(corpus, missed, names)


@query(f"""
SELECT '0' AS corpus_id, '=== NEW FUNCTIONS TO CLASSIFY ===' || chr(10) || '(add these to pseudo_C_analyzer_lib.txt under FUNCTIONS or NON-FUNCTIONS)' || chr(10)
  || '=== FOUND FUNCTIONS ===' || chr(10) || (SELECT string_agg(name, chr(10) ORDER BY name) FROM ({_FUNCTIONS})) || chr(10) || chr(10)
  || '=== MISSING FUNCTIONS ===' || chr(10) || (SELECT string_agg(name, chr(10) ORDER BY name) FROM ({_MISSING}) WHERE name <> 'if') || chr(10) AS text
""")
def classification_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, defined, _, _, names = _graph(spark, sf_dir)
    return callgraph.classification_text(corpus, defined, names)


# Decompiler logs.


@query("""
SELECT o_orderpriority AS log_id, pos, kind, 'fn_' || o_orderkey AS name, ea::DECIMAL(20, 0) AS ea, message FROM (
  SELECT *, o_orderkey * 2 AS pos, 'start' AS kind, o_orderkey AS ea, NULL AS message FROM orders
  UNION ALL SELECT *, o_orderkey * 2 + 1, CASE o_orderstatus WHEN 'F' THEN 'end' WHEN 'O' THEN 'failed' ELSE 'exception' END,
    CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'no IR generated' ELSE 'boom' END FROM orders)
""")
def ir_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return irlog.events(fx.ir_log(spark, sf_dir))


@query("""
SELECT o_orderpriority AS log_id, count(*) AS processed, count(*) FILTER (o_orderstatus = 'F') AS successful,
       count(*) FILTER (o_orderstatus <> 'F') AS failed, printf('%.1f', 100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*))::DOUBLE AS success_rate
FROM orders GROUP BY 1
""")
def ir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return irlog.summary(irlog.events(fx.ir_log(spark, sf_dir)))


@query("""
WITH l AS (
  SELECT o_orderpriority AS log_id, o_orderkey AS k, o_orderstatus AS s, '--- IR FOR fn_' || o_orderkey || ' (0x' || lpad(to_hex(o_orderkey), 8, '0') || ') ---' AS a,
    CASE o_orderstatus WHEN 'F' THEN '--- END fn_' || o_orderkey || ' ---' WHEN 'O' THEN 'FAILED fn_' || o_orderkey || ' (0x' || lpad(to_hex(o_orderkey), 8, '0') || '): no IR generated'
    ELSE 'EXCEPTION fn_' || o_orderkey || ' (0x' || lpad(to_hex(o_orderkey), 8, '0') || '): boom' END AS b FROM orders),
m AS (SELECT log_id, max(k) FILTER (s = 'F') AS last FROM l GROUP BY log_id)
SELECT log_id, bool_or(last IS NOT NULL) AS ok, md5(string_agg(a || chr(10) || CASE WHEN k = last THEN '--- END' ELSE b END, chr(10) ORDER BY k)) AS digest
FROM l JOIN m USING (log_id) WHERE k <= last GROUP BY log_id
""")
def ir_isolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.ir_log(spark, sf_dir).groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    whole = log.select("log_id", F.concat(F.lit("banner\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\ntail")).alias("content"))
    return irlog.isolate(whole).select("log_id", "ok", F.md5("text").alias("digest"))


@query("""
SELECT user_id::VARCHAR AS log_id, event_id AS ts, n AS start_lines, round_even(size / 1024.0::DOUBLE, 2) AS kb FROM (
  SELECT *, lag(size, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (
    SELECT user_id, event_id, event_id % 97 AS n, (event_id * 7919) % 100003 AS size FROM events)) WHERE size > before
""")
def progress_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    polls = e.select(
        F.col("user_id").cast("string").alias("log_id"), F.col("event_id").alias("ts"),
        ((F.col("event_id") * 7919) % 100003).alias("size_bytes"), (F.col("event_id") % 97).alias("start_lines"),
    )
    return irlog.growth(polls)


# Links and ledger.


@query("SELECT c_custkey AS page_id, 0::INTEGER AS ord, '/d/' || (c_custkey % 50) AS href, 'Download x' AS text, md5('/d/' || (c_custkey % 50) || 'Download x') AS link_id FROM customer")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.links(fx.download_pages(spark, sf_dir)).withColumn("ord", F.col("ord").cast("int"))


@query("SELECT min(c_custkey) AS page_id, md5('/d/' || (c_custkey % 50) || 'Download x') AS link_id FROM customer WHERE c_custkey % 50 >= 10 GROUP BY c_custkey % 50")
def unseen_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.links(fx.download_pages(spark, sf_dir))
    known = spark.range(10).select(F.md5(F.concat(F.lit("/d/"), F.col("id").cast("string"), F.lit("Download x"))).alias("link_id"))
    return links.unseen(found, known).select("page_id", "link_id")


@query("""
SELECT event_id AS batch_id, user_id::VARCHAR AS link_id, status FROM (
  SELECT *, coalesce(bool_or(status = 'ok') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done
  FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'ok' ELSE 'failed' END AS status FROM events)) WHERE NOT done
""")
def ledger_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, "ok").otherwise("failed")
    return links.settle(e.select(F.col("event_id").alias("batch_id"), F.col("user_id").cast("string").alias("link_id"), status.alias("status")))


def _event_links(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A stream of links made from events, in four files, of which each batch takes one."""
    e = fx.table(spark, sf_dir, "events").select("event_id", "user_id")
    for i in range(4):
        e.where(F.col("event_id") % 4 == i).coalesce(1).write.parquet(f"{folder}/in/{i}")
    found = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return found.withColumn("link_id", F.md5(F.col("user_id").cast("string")))


_FETCHED = "SELECT DISTINCT md5(user_id::VARCHAR) AS link_id FROM events WHERE user_id % 2 = 0"


def _even(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("user_id") % 2 == 0, "ok").otherwise("failed"))


@query(_FETCHED)
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that a stream of links fills in several batches; odd ones fail. No link is fetched twice."""
    path = shared_dir(spark, "ledger")
    found = _event_links(spark, sf_dir, path)
    streams.keep_ledger(found, f"{path}/table", f"{path}/state", _even).awaitTermination()
    return streams.read_ledger(spark, f"{path}/table").select("link_id")


@query(_FETCHED)
def ledger_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream that fails at its first batch and is started again, and then by one with a new checkpoint."""
    path = shared_dir(spark, "ledger")
    found, calls = _event_links(spark, sf_dir, path), []

    def fetch(df: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 1:
            raise OSError("the site is down")
        return _even(df)

    streams.keep_on(lambda: streams.keep_ledger(found, f"{path}/table", f"{path}/state", fetch), wait=0.1, most=2, tell=lambda _: None)
    streams.keep_ledger(found, f"{path}/table", f"{path}/new", _even).awaitTermination()
    return streams.read_ledger(spark, f"{path}/table").select("link_id")


@query("""
SELECT event_id // 100 AS batch_id, count(*) AS found, count(*) FILTER (status = 'ok') AS downloaded FROM (
  SELECT *, coalesce(bool_or(status = 'ok') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done
  FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'ok' ELSE 'failed' END AS status FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_id // 100 ORDER BY event_id) = 1)) WHERE NOT done GROUP BY 1
""")
def sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sweep tries and fetches; a link that stands twice in a sweep is tried once."""
    e = fx.table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("batch_id", F.expr("event_id div 100"))
    first = e.groupBy("user_id", "batch_id").agg(F.min("event_id").alias("event_id"))
    status = F.when(F.col("event_id") % 3 == 0, "ok").otherwise("failed")
    return links.sweeps(first.select("batch_id", F.col("user_id").cast("string").alias("link_id"), status.alias("status")))


@query("SELECT DISTINCT md5(c_custkey::VARCHAR) AS link_id FROM customer WHERE c_nationkey % 5 <> 0")
def ledger_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers as JSON arrays, one for each nation; every fifth is cut short and holds nothing."""
    c = fx.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.md5(F.col("c_custkey").cast("string")))).alias("t"))
    text = F.when(F.col("c_nationkey") % 5 == 0, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t"))
    return sources.ledger_ids(c.select(text.alias("value")))


@query("SELECT 'f' || c_custkey AS path FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def fresh_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a later listing has in addition, without downloads in progress."""
    k = F.col("c_custkey")
    after = fx.table(spark, sf_dir, "customer").select(k, F.concat(F.lit("f"), k, F.when(k % 5 == 0, ".crdownload").otherwise("")).alias("path"))
    return links.fresh_files(after.where(k % 3 == 0).select("path"), after.select("path")).select("path")


@query("""
WITH p AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'https://cdn.example/b/' ELSE 'https://h' || (c_custkey % 3) || '.example/a/b' || c_custkey || '/' END AS place,
         CASE WHEN c_custkey % 3 = 0 THEN 'https://cdn.example' ELSE 'https://h' || (c_custkey % 3) || '.example' END AS host,
         CASE WHEN c_custkey % 3 = 0 THEN 'https://cdn.example/' ELSE 'https://h' || (c_custkey % 3) || '.example/a/' END AS up FROM customer),
x AS (
  SELECT k, 0 AS ord, place || 'get.php?id=' || k || '&x=2' AS href FROM p UNION ALL SELECT k, 1, host || '/abs/' || k FROM p
  UNION ALL SELECT k, 2, up || 'up/' || k FROM p UNION ALL SELECT k, 3, 'https://other.example/' || k FROM p)
SELECT k AS page_id, ord, href, md5(href || 'Download') AS link_id FROM x
""")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made absolute by the page's address and base tag."""
    found = links.links(fx.relative_pages(spark, sf_dir), url="url")
    return found.select("page_id", F.col("ord").cast("int").alias("ord"), "href", "link_id")


# Files.


def _files(spark: SparkSession, corpus: DataFrame) -> str:
    folder = shared_dir(spark, "files")
    write_files(corpus, folder, name="path")
    return folder


def _name(part: int = -1) -> Column:
    return F.element_at(F.split("path", "/"), part)


_FILES = """
SELECT p_brand AS name, sum(length('nop~' || 'nop~' || 'nop~' || 'nop~' || 'nop~' || 'int f_' || p_partkey || '(int a1)~{~  g_' || p_partkey
  || '(a1);~  if ( a1 )~    return f_' || (p_partkey + 1) || '(a1);~}~'))::BIGINT AS n FROM part GROUP BY p_brand
UNION ALL SELECT 'zz', sum(length('nop~nop~nop~nop~nop~' || 'int f_' || p_partkey || '(int a1)~{~  h_' || p_partkey || '(a1);~}~'))::BIGINT FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT '0', length('int start_main(int a1)~{~  f_1(a1);~}~')"""


@query(_FILES)
def pseudo_c_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of a directory with its entry file; what lies in folders below it does not count."""
    corpus = fx.pseudo_c(spark, sf_dir)
    folder = _files(spark, corpus.unionAll(corpus.select(F.concat(F.lit("below/"), "path").alias("path"), "content")))
    return sources.pseudo_c_directory(spark, folder).select(_name().alias("name"), F.char_length("content").cast("long").alias("n"))


@query(_FILES)
def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular files of a directory with their sizes."""
    corpus = fx.pseudo_c(spark, sf_dir)
    folder = _files(spark, corpus.unionAll(corpus.select(F.concat(F.lit("below/"), "path").alias("path"), "content")))
    return sources.samples(spark, folder).select(_name().alias("name"), F.col("length").alias("n"))


@query("""
SELECT 'supplier-' || s_suppkey || '.asm' AS name, r AS recursive, sha256(s_name) AS sha256
FROM supplier, (VALUES (true), (false)) AS x(r) WHERE s_suppkey % 3 <> 0 AND (r OR s_suppkey % 2 = 0)
UNION ALL SELECT 'ONE.ASM', NULL, sha256(s_name) FROM supplier WHERE s_suppkey = 1
""")
def listing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes in the listings of a directory, of those below it too, and of one file whose suffix is in capitals."""
    corpus = fx.asm(spark, sf_dir).withColumn("k", F.regexp_extract("path", r"(\d+)", 1).cast("int"))
    below = corpus.select(F.when(F.col("k") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("below/"), "path")).alias("path"), "content")
    other = corpus.where("k = 1").select(F.lit("ONE.ASM").alias("path"), "content")
    folder = _files(spark, below.unionAll(other))
    read = (sources.listings(spark, folder, recursive=True), sources.listings(spark, folder), sources.listings(spark, f"{folder}/ONE.ASM", single=True))
    rows = [footprint.file_hashes(f).withColumn("recursive", F.lit(r).cast("boolean")) for f, r in zip(read, (True, False, None), strict=True)]
    return reduce(DataFrame.unionAll, rows).where("sha256 IS NOT NULL").select(_name().alias("name"), "recursive", "sha256")


@query(r"""
SELECT 'supplier-' || k || '.asm' AS path, '{"file":"supplier-' || k || '.asm"'
  || CASE WHEN k % 3 <> 0 THEN ',"file_hashes":{"sha256":"' || sha256(s_name) || '","md5":"' || md5(s_name) || '","crc32":"' || lpad(lower(to_hex(k)), 8, '0') || '"}' ELSE '' END
  || CASE WHEN k % 5 <> 0 THEN replace(',"iocs":{"protocols_full":["https://c@.evil.example.xyz/p/@"],"urls":["https://c@.evil.example.xyz/p/@"],"domains":["c@.evil.example.xyz"],"files":["lib@.dll"],"main_patterns":["main.f@"],"ssh_patterns":["SSHClient@"],"operational_files":["C:\\work\\job@\\run.bin","\\\\host@\\share\\d\\f.txt"],"dependency_paths":["C:\\Program Files\\tool\\bin\\t@.cfg"]}', '@', k::VARCHAR) ELSE '' END
  || '}' AS json FROM (SELECT s_suppkey AS k, s_name FROM supplier) WHERE k % 5 <> 0 OR k % 3 <> 0
""")
def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_rows(footprint.scan(fx.asm(spark, sf_dir)))


@query("SELECT n * 25 AS done, total, 'Progress: ' || (n * 25) || '/' || total || ' files processed' AS text FROM (SELECT unnest(range(1, count(*) // 25 + 1)) AS n, count(*) AS total FROM supplier)")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.progress_rows(fx.asm(spark, sf_dir))


# Headers, calls and order in cases of their own.


@query("""
SELECT p_brand AS path, CASE p_partkey % 8 WHEN 2 THEN 't_' || p_partkey || ' x' WHEN 3 THEN 't_u64 f_' || p_partkey ELSE 'f_' || p_partkey END AS name
FROM part WHERE p_partkey % 8 < 6
""")
def header_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by each of the six patterns of headers, and lines that are none."""
    found = fn.headers(sources.ordered(fx.headers(spark, sf_dir))).select("path", F.explode("found").alias("f"))
    return found.select("path", "f.name")


@query("""
SELECT 'f_' || p_partkey AS src, 'f_' || p_partkey AS dst FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT 'f_' || p_partkey, 'q_' || p_partkey FROM part WHERE p_partkey % 4 = 3
""")
def marked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a function by itself count from its tenth line on, and names that are variables nearby do not."""
    return callgraph.calls(fn.functions(fn.definitions(sources.ordered(fx.marked_calls(spark, sf_dir))))).select("src", "dst")


@query("""
SELECT 0::INTEGER AS seq, 'start_main' AS name
UNION ALL SELECT (CASE WHEN c_custkey = 0 THEN last + 1 WHEN c_custkey <= 100 THEN c_custkey ELSE 101 + last - c_custkey END)::INTEGER, 'f_' || c_custkey
FROM customer, (SELECT max(c_custkey) AS last FROM customer)
""")
def deep_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a chain deeper than the limit: what is too deep comes later, as it is defined."""
    _, found, defined, edges, _, _ = _graph_of(sources.ordered(fx.chain(spark, sf_dir)))
    return callgraph.flow(defined, edges, fn.entry_point(found)).select("seq", "name")


@query("SELECT 'start_main' AS name UNION ALL SELECT 'f_' || c_custkey FROM customer WHERE c_custkey > 0")
def deep_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, defined, edges, _, _ = _graph_of(sources.ordered(fx.chain(spark, sf_dir)))
    return callgraph.reachable(edges, fn.entry_point(found), defined).select("name")


@query(f"""
SELECT 1::BIGINT AS in_entry, (SELECT count(*) FROM ({_FUNCTIONS})) AS functions, (SELECT count(*) FROM ({_FUNCTIONS})) AS kept_found,
       count(*) AS kept_missing, (SELECT count(*) FROM ({_FUNCTIONS})) + count(*) AS unclassified FROM ({_MISSING}) WHERE name <> 'if'
""")
def function_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, defined, _, missed, names = _graph(spark, sf_dir)
    return callgraph.counts(found, defined, missed, names).drop("corpus_id")


# Logs as files.

_LOGS = """
SELECT replace(o_orderpriority, ' ', '_') AS log_id, o_orderkey AS k, o_orderstatus AS s, '--- IR FOR fn_' || o_orderkey || ' (0x' || lpad(to_hex(o_orderkey), 8, '0') || ') ---' AS a,
    CASE o_orderstatus WHEN 'F' THEN '--- END fn_' || o_orderkey || ' ---' WHEN 'O' THEN 'FAILED fn_' || o_orderkey || ' (0x' || lpad(to_hex(o_orderkey), 8, '0') || '): no IR generated'
    ELSE 'EXCEPTION fn_' || o_orderkey || ' (0x' || lpad(to_hex(o_orderkey), 8, '0') || '): boom' END AS b FROM orders"""


@query(f"""
WITH l AS ({_LOGS}), m AS (SELECT log_id, max(k) FILTER (s = 'F') AS last FROM l GROUP BY log_id),
n AS (SELECT log_id, count(*) AS n, count(*) FILTER (s = 'F') AS f FROM l GROUP BY log_id UNION ALL SELECT 'empty', 0, 0)
SELECT log_id || '/ir.txt' AS name, md5(string_agg(a || chr(10) || CASE WHEN k = last THEN '--- END' ELSE b END, chr(10) ORDER BY k)) AS digest
FROM l JOIN m USING (log_id) WHERE k <= last GROUP BY log_id
UNION ALL SELECT log_id || '/ir_summary.txt', md5('=== SUMMARY ===' || chr(10) || '    Start Time: Thu Jan  1 00:00:00 2026' || chr(10) || '    End Time: Thu Jan  1 00:02:58 2026' || chr(10)
  || '    Total Duration Time: 178.0 seconds (3.0 minutes)' || chr(10) || '    Total Functions Processed: ' || n || chr(10) || '    Successful: ' || f || chr(10) || '    Failed: ' || (n - f) || chr(10)
  || '    Success Rate: ' || CASE WHEN n = 0 THEN '0.0' ELSE printf('%.1f', 100.0::DOUBLE * f / n) END || '%' || chr(10) || '    ') FROM n
""")
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a run leaves for each log, written and read again."""
    folder = shared_dir(spark, "logs")
    write_lines(fx.log_lines(spark, sf_dir), f"{folder}/in", name="log_id")
    logs, lines = sources.logs_by_line(spark, f"{folder}/in")
    began, ended = (F.to_timestamp(F.lit(x)) for x in ("2026-01-01 00:00:00", "2026-01-01 00:02:58"))
    write_lines(irlog.log_files(logs.where("error IS NULL"), lines, began, ended), f"{folder}/out")
    out = sources.samples(spark, f"{folder}/out", recursive=True)
    return digests(out.select(F.concat_ws("/", _name(-2), _name()).alias("name")), f"{folder}/out")


_POLLED = f"""
WITH l AS ({_LOGS}) SELECT log_id, count(*) AS start_lines, round_even((sum(length(a) + length(b) + 2) + 11 - 0) / 1024.0::DOUBLE, 2) AS kb FROM l GROUP BY log_id
UNION ALL SELECT 'empty', 0, round_even(8 / 1024.0::DOUBLE, 2)"""


@query(_POLLED)
def log_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll of all logs of a folder: started functions and size."""
    folder = shared_dir(spark, "logs")
    write_lines(fx.log_lines(spark, sf_dir), folder, name="log_id")
    return streams.poll(spark, folder).select("log_id", "start_lines", irlog.kilobytes(F.col("size_bytes")).alias("kb"))


@query("SELECT count(*) AS start_lines FROM orders")
def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running count of started functions that a stream over a folder of logs has in the end."""
    folder = shared_dir(spark, "logs")
    write_lines(fx.log_lines(spark, sf_dir), f"{folder}/in", name="log_id")
    lines = spark.readStream.option("maxFilesPerTrigger", 2).text(f"{folder}/in")
    counted = streams.progress(lines).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/count")

    counted.foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start_lines long").parquet(f"{folder}/count")


@query("""
SELECT o_orderpriority AS log_id, count(*) AS processed FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1
""")
def skipped_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that are null have no lines in a log and are not counted as processed; here every tenth."""
    log = fx.ir_log(spark, sf_dir).where(F.expr("pos div 2 % 10 <> 0"))
    return irlog.summary(irlog.events(log)).select("log_id", "processed")


# What commands leave.


@query("""
SELECT * FROM (VALUES ('all_functions.txt', true), ('flow_chart.txt', true), ('library.txt', true), ('missing_functions.txt', true), ('organized_code.txt', true),
  ('report.json', true), ('report.txt', true)) AS x(name, fresh)
""")
def command_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that commands write, where older ones of the same names lay; a library that was not there is made."""
    source, asm, out = _files(spark, fx.pseudo_c(spark, sf_dir)), _files(spark, fx.asm(spark, sf_dir)), shared_dir(spark, "out")
    for name in (*cli.ANALYSIS, "report.txt"):
        write_text(f"{out}/{name}", ["old"])
    cli.analyze(spark, source, library=f"{out}/library.txt", out=out)
    for form, name in (("text", "report.txt"), ("json", "report.json")):
        write_text(f"{out}/{name}", [cli.sniff(spark, asm, form=form, deny=None) or ""])
    files = sources.read_files(spark, out)
    return files.select(_name().alias("name"), (~F.col("content").isin("old", "")).alias("fresh"))
