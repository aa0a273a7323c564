from pyspark.sql import functions as F

from spoor.cli import analyze
from spoor.operators import callgraph, irlog, links
from spoor.operators import functions as fn
from spoor.sources.corpus import ordered


def names(spark, content):
    corpus = ordered(spark.createDataFrame([("0", content)], "path string, content string"))
    return {r["name"]: r["body"] for r in fn.definitions(corpus).collect()}


def test_functions(spark):
    assert names(spark, "int main_x(int a)\n{\n}\n") == {"main_x": "int main_x(int a)\n{\n}"}
    assert names(spark, "void *__fastcall f1(\n  int a)\n{\n}\n").keys() == {"f1"}
    assert names(spark, "uint64_t runtime_n(int a)\n{\n}").keys() == {"uint64_t runtime_n"}
    assert names(spark, "int x(int a)\n{\n}\n").keys() == {"int x"}  # a name has two characters; the fourth pattern finds some
    assert names(spark, "x(int a)\n{\n}\n") == {}
    assert names(spark, "int f1(int a)\n{\n") == {}  # not closed
    five = "// 1\n// 2\n// 3\n// 4\n// 5\n"
    assert names(spark, five + "int f1(int a)\n{\n}\n") == {}  # what leads up to it hides the name
    assert names(spark, "") == {}


def test_calls():
    body = "int f1(int a)\n{\n  g1(a);\n  v1 = h1(a);\n  *p1(a);\n  return k1(a);\n}"
    assert callgraph.calls_in("f1", body).keys() == {"g1", "h1", "k1"}
    assert callgraph.calls_in("f1", "f1(\n" + "\n" * 10 + "f1(") == {"f1": 14}


def test_preorder():
    chain = {f"f{i}": [f"f{i + 1}"] for i in range(120)}
    order = [f"f{i}" for i in range(120)]
    found = callgraph.preorder(order, chain, "f0")
    assert sorted(found) == sorted(order) and found[:101] == order[:101]
    assert callgraph.preorder(["a", "b", "c"], {"a": ["c", "x"], "c": ["a"]}, "b") == ["b", "a", "c"]
    assert callgraph.preorder([], {}, None) == []


def test_analyze(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    out.mkdir()
    (source / "0").write_text("int start_1(int a)\n{\n  go_1(a);\n  vx(a);\n}\n")
    (source / "1").write_text("void go_1(int a)\n{\n  start_1(a);\n}\n")
    (out / "lib").write_text("=== FUNCTIONS ===\nv*\n")
    texts = analyze(spark, str(source), library=str(out / "lib"), out=str(out))
    assert texts["flow_chart.txt"] == "=== FUNCTION CALL GRAPH ===\nstart_1 -> go_1\ngo_1 -> start_1\n"
    assert texts["missing_functions.txt"] == "=== MISSING FUNCTIONS (0) ===\nAll functions found!\n"
    assert texts["all_functions.txt"].endswith("=== FOUND FUNCTIONS ===\ngo_1\nstart_1\n\n")
    assert texts["organized_code.txt"].startswith("=== ORGANIZED CODE ===\ntotal functions included: 2\n\n")


def test_logs(spark):
    lines = ["--- IR FOR a (0x00000010) ---", "--- END a ---", "--- IR FOR b (0x00000020) ---", "FAILED b (0x00000020): no IR generated"]
    log = spark.createDataFrame([("l", i, x) for i, x in enumerate(lines)], "log_id string, pos long, line string")
    row = irlog.summary(irlog.events(log)).first()
    assert (row.processed, row.successful, row.failed, row.success_rate) == (2, 1, 1, 50.0)
    assert "Success Rate: 50.0%" in irlog.summary_text(row, "s", "e", 178.5)
    whole = spark.createDataFrame([("l", "x\n" + "\n".join(lines)), ("m", "--- END --- IR FOR"), ("n", "")], "log_id string, content string")
    found = {r.log_id: (r.ok, r.text) for r in irlog.isolate(whole).collect()}
    assert found == {"l": (True, lines[0] + "\n--- END"), "m": (False, None), "n": (False, None)}
    assert spark.range(1).select(irlog.kilobytes(F.lit(128))).first()[0] == 0.12


def test_links(spark):
    html = '<a href="/a">Download</a><a href="/a">Download</a><a>Download</a><a href="/b">no</a>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    found = links.links(pages)
    assert [r.href for r in found.collect()] == ["/a", "/a"]
    assert links.unseen(found, spark.createDataFrame([], "link_id string")).count() == 1


def test_relative_links_of_different_pages_are_apart(spark):
    link = '<a href="get.php?id=1&amp;x=2">Download</a>'
    pages = [
        (1, "https://a.example/x/list.html", link), (2, "https://a.example/y/list.html", link), (3, "https://b.example/x/", link),
        (4, "https://c.example/", f'<base target=_top><base href="https://a.example/x/">{link}'), (5, None, link),
    ]
    found = links.links(spark.createDataFrame(pages, "page_id long, url string, html string"), url="url")
    of = {r.page_id: (r.href, r.link_id) for r in found.collect()}
    assert [of[i][0].removesuffix("get.php?id=1&x=2") for i in (1, 2, 3, 4, 5)] == [
        "https://a.example/x/", "https://a.example/y/", "https://b.example/x/", "https://a.example/x/", "",
    ]
    assert sorted(r.page_id for r in links.unseen(found, found.select("link_id").limit(0)).collect()) == [1, 2, 3, 5]
