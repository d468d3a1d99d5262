import random

from pyspark.sql import functions as F

import models
from faultline.operators import codeunits as U
from faultline.operators import graph as G
from faultline.plans import views
from faultline.sources import chunks, files, logs
from faultline.sources.chunktable import ChunkTable
from faultline.streaming import logs as stream


def source(spark, named):
    return spark.createDataFrame([("n", k, v) for k, v in named.items()], "namespace string, source_file string, text string")


PY = '''import os
from a.b import c as d, e

# first note
@deco
@more(1)
class Box(Base):
    """Holds things."""

    def put(self, x):
        \'\'\'Put
        x in.
        \'\'\'
        return go(x)

    class Inner:
        def deep(self):
            return put(1)

async def main(a):

    if a:
        return Box()
x = 1
y = main(x) + os.getpid()
'''


def test_python_units(spark):
    got = {(r.kind, r.name, r.class_name): r for r in U.code_units(source(spark, {"m.py": PY})).collect()}
    box = got["class", "Box", ""]
    assert (box.start_line, box.end_line, box.docstring, box.decorators, box.comments) == (5, 18, "Holds things.", ["@deco", "@more(1)"], "# first note")
    assert (got["method", "put", "Box"].start_line, got["method", "put", "Box"].end_line, got["method", "put", "Box"].docstring) == (10, 14, "Put\nx in.")
    assert ("method", "deep", "Box") in got and ("method", "deep", "Inner") in got
    main = got["function", "main", ""]
    assert (main.start_line, main.end_line) == (20, 23)
    module = got["module", "<module>", ""]
    assert module.imports == ["import os", "from a.b import c as d, e"] and module.text.startswith("import os") and "x = 1" in module.text


SPREAD_C = "#include <x.h>\n\nstatic int\nadd(int a,\n    int b)\n{\n    return a + b;\n}\n\nint one(void) {\n    return 1;\n}\n\nint two(void)\n{\n    return 2;\n}\n"
SPREAD_JS = "let z = 1;\nconst pick = (\n  a,\n  b\n) => {\n  return a;\n};\nconst id = (x) => x;\n"


def test_definitions_over_several_lines(spark):
    files_ = U.with_language(source(spark, {"a.c": SPREAD_C, "a.js": SPREAD_JS}))
    lines = U.code_lines(files_)
    got = {(r.source_file, r.line_no, r.kind, r.name) for r in U.unit_starts(lines).collect()}
    assert got == {("a.c", 3, "function", "add"), ("a.c", 10, "function", "one"), ("a.c", 14, "function", "two"),
                   ("a.js", 2, "arrow", "pick"), ("a.js", 8, "arrow", "id")}
    units = {r.name: (r.start_line, r.end_line) for r in U.code_units(source(spark, {"a.c": SPREAD_C})).collect()}
    assert units["add"] == (3, 8) and units["one"] == (10, 12) and units["two"] == (14, 17)


def test_brace_ends_equal_scan(spark):
    rng = random.Random(11)
    named = {}
    for i in range(60):
        body = ["".join(rng.choice("{}x ") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 25))]
        named[f"f{i}.js"] = "\n".join("function q() " + b if rng.random() < 0.3 else b for b in body) + "\nlast"
    lines = U.code_lines(U.with_language(source(spark, named)))
    ends = U.brace_ends(lines, U.unit_starts(lines)).collect()
    assert len(ends) > 50
    for r in ends:
        text = named[r.source_file].split("\n")
        assert r.end - 1 == models.brace_end(text, r.line_no - 1), (r, text)


def test_other_languages(spark):
    named = {
        "a.go": 'package p\n\nimport (\n\t"fmt"\n)\n\n// Adds.\nfunc Add(a int) int {\n\treturn a\n}\n\ntype T struct {\n\tx int\n}\n',
        "b.rb": "require 'x'\nclass A\n  def go\n    if x\n      1\n    end\n  end\nend\ndef out\n  2\nend\n",
        "c.yaml": "a: 1\nb:\n  c: 2\n", "d.json": '{\n "k": {"z": []},\n "l": 3\n}', "e.json": "[1]", "g.json": "{bad",
        "f.sh": "go() {\n  echo hi\n}\ngo\n", "h.txt": "short", "i.txt": "a text that is long enough to keep whole",
        "j.ts": "export const f = async (x) => {\n  return g(x);\n};\nconst one = y => y;\n",
        "K.java": "class K {\n    /** Doc. */\n    public int m(int a) {\n        return a;\n    }\n}\n",
    }
    got = {}
    for r in U.code_units(source(spark, named)).collect():
        got.setdefault(r.source_file, {})[r.kind, r.name] = r
    assert got["a.go"]["function", "Add"].comments == "// Adds." and got["a.go"]["class", "T"].end_line == 14
    assert got["a.go"]["function", "Add"].imports == ['import (\n\t"fmt"\n)']
    assert set(got["b.rb"]) == {("class", "A"), ("function", "out"), ("module", "<module>")} and got["b.rb"]["class", "A"].end_line == 8
    assert (got["c.yaml"]["config_block", "b"].start_line, got["c.yaml"]["config_block", "b"].end_line) == (2, 3)
    assert (got["d.json"]["config_block", "k"].start_line, got["d.json"]["config_block", "k"].end_line) == (2, 6)
    assert list(got["e.json"]) == [("config_block", "<root>")] and list(got["g.json"]) == [("config_block", "<invalid_json>")]
    assert ("function", "go") in got["f.sh"] and "h.txt" not in got and ("module", "<module>") in got["i.txt"]
    assert {("function", "f"), ("function", "one")} <= set(got["j.ts"])
    assert got["K.java"]["method", "m"].class_name == "K" and got["K.java"]["method", "m"].docstring == "/** Doc. */"


def test_long_units_are_split(spark):
    text = "def long_one():\n" + "\n".join(f"    x{i} = {i}" for i in range(160)) + "\n"
    got = U.unit_chunks(U.code_units(source(spark, {"p/l.py": text}))).orderBy("line_start").collect()
    assert [(r.line_start, r.line_end) for r in got] == [(1, 80), (73, 152), (145, 161)]
    assert got[1].text.startswith("# File: p/l.py\n# Language: python\n    x71 = 71") and got[0].function_name == "long_one"
    whole = U.code_chunks(source(spark, {"p/l.py": text, "t.txt": "tiny\n" * 20})).select("source_file").distinct().count()
    assert whole == 2


def test_graph_lookups(spark):
    named = {"a.py": PY, "b.py": "from a import Box\n\ndef use_it():\n    return Box().put(2)\n\nVALUE = use_it()\nprint(VALUE)\n"}
    units = U.cut(U.code_units(source(spark, named)))

    def ask(*names):
        return spark.createDataFrame([("n", x) for x in names], "namespace string, name string")

    assert {(r.name, r.source_file) for r in G.files_importing(units, ask("Box", "put", "none")).collect()} == {
        ("Box", "b.py"), ("put", "b.py"), ("put", "a.py")}
    assert {r.source_file for r in G.dependents_of(units, ask("o")).collect()} == {"a.py", "b.py"}
    assert {r.method for r in G.methods_of(units, ask("BOX")).collect()} == {"put", "deep"}
    assert {r.symbol for r in G.symbols_in(units, ask("b.py")).collect()} == {"use_it"}
    asked = spark.createDataFrame([(1, "n", "Which files import the Box?"), (2, "n", "what methods does box have"), (3, "n", "hm")],
                                  "query_id long, namespace string, question string")
    lookups = G.structural_lookups(asked).collect()
    assert {(r.query_id, r.lookup, r.name) for r in lookups} == {(1, "importers", "box"), (2, "methods", "box")}
    assert {r.path for r in G.dependents_by_stem(units, spark.createDataFrame([("n", "src/a.py")], "namespace string, path string")).collect()} == {"src/a.py"}


def test_scan_decode_and_routes(spark, tmp_path):
    (tmp_path / "src").mkdir(), (tmp_path / "node_modules").mkdir(), (tmp_path / "logs").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 'é'\n", "utf-8")
    (tmp_path / "src" / "b.py").write_bytes("y = 'é'\n".encode("latin-1"))
    (tmp_path / "src" / "blank.py").write_text("  \n")
    (tmp_path / "src" / "x.min.js").write_text("1")
    (tmp_path / "node_modules" / "c.py").write_text("z")
    (tmp_path / "src" / "big.py").write_text("#" * (600 * 1024))
    (tmp_path / "logs" / "s.err").write_text("2024-01-01 00:00:00 ERROR something went wrong in the service today\n")
    scan = files.scan_project(spark, str(tmp_path), "n")
    kept = files.filter_paths(scan)
    assert {r.path for r in kept.select("path").collect()} == {"src/a.py", "src/b.py", "src/blank.py"}
    assert {r.source_file: r.text for r in files.decode_text(kept).collect()} == {"src/a.py": "x = 'é'\n", "src/b.py": "y = 'é'\n"}
    assert "src/x.min.js" in {r.path for r in files.list_indexed(scan).collect()}
    seen = logs.read_log_lines(spark, str(tmp_path / "logs"), "n")
    assert [r.text for r in seen.collect()] == ["2024-01-01 00:00:00 ERROR something went wrong in the service today"]


def test_upsert_and_namespace_overwrite(spark, tmp_path):
    old = spark.createDataFrame([("a", "f", 1, 2, "old", 1), ("b", "f", 1, 2, "keep", 1)], "namespace string, source_file string, line_start long, line_end long, text string, load_ts int")
    new = spark.createDataFrame([("a", "f", 1, 2, "new", 2), ("a", "f", 3, 4, "more", 2)], old.schema)
    merged = chunks.upsert_chunks(chunks.with_ids(old), chunks.with_ids(new))
    assert {r.text for r in merged.collect()} == {"new", "more", "keep"}
    path = str(tmp_path / "t")
    chunks.write_namespaces(merged, path)
    chunks.write_namespaces(merged.where("namespace = 'a' and text = 'new'"), path)
    assert {r.text for r in spark.read.parquet(path).collect()} == {"new", "keep"}
    repos = spark.createDataFrame([(1, "https://u:p@h.org/team/digit.git", "HEAD", "a" * 40, " msg ", "me")],
                                  "repo_id int, url string, branch string, commit_sha string, commit_message string, author string")
    tagged = chunks.attach_repo(old.withColumn("repo_id", F.lit(1)).withColumn("metadata", F.create_map(F.lit("branch"), F.lit("x"), F.lit("k"), F.lit("v"))), repos)
    meta = tagged.collect()[0].metadata
    assert meta == {"k": "v", "repo_owner": "team", "repo_name": "digit", "branch": "default", "commit_hash": "a" * 12, "commit_message": "msg", "commit_author": "me"}


def test_chunk_table_versions(spark, tmp_path):
    schema = "namespace string, source_file string, line_start long, line_end long, text string, load_ts int, docstring string, imports array<string>"

    def rows(*of):
        return chunks.with_ids(spark.createDataFrame([(ns, "f", i, i + 1, t, ts, "d" * 600, ["import " + "x" * 400] * 2) for ns, i, t, ts in of], schema))

    def held():
        return sorted((r.namespace, r.line_start, r.text) for r in table.read().collect())

    def report(df):
        return sorted(tuple(r) for r in df.collect())

    table = ChunkTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.current().count() == 0
    assert report(table.upsert(rows(("02", 1, "one", 1), ("02", 3, "two", 1), ("01", 1, "number", 1)))) == [("01", 1, 0, 0), ("02", 2, 0, 0)]
    assert held() == [("01", 1, "number"), ("02", 1, "one"), ("02", 3, "two")]
    first = table.read().where("namespace = '02'").first()
    assert len(first.docstring) == 500 and sum(map(len, first.imports)) + 1 == 500
    # A load read from the table itself, with one change: only that namespace gets a new version.
    again = table.read().withColumn("text", F.when(F.col("text") == "two", "2").otherwise(F.col("text"))).withColumn("load_ts", F.lit(2))
    assert report(table.upsert(again)) == [("01", 0, 0, 1), ("02", 0, 1, 1)]
    assert {r.namespace: r.version for r in table.current().collect()} == {"01": 1, "02": 2}
    # Nothing new: no version. A load that dies before its commit: no change.
    table.upsert(rows(("02", 1, "one", 9)))
    table._stage(rows(("02", 1, "lost", 10), ("03", 1, "lost", 10)))
    before = [("01", 1, "number"), ("02", 1, "one"), ("02", 3, "2")]
    assert held() == before and table.commits().agg(F.max("version")).first()[0] == 2
    (tmp_path / "t" / "commits" / "000000000009-x" / "_temporary").mkdir(parents=True)
    (tmp_path / "t" / "commits" / "000000000009-x" / "_temporary" / "part-0.json").write_text('{"version": 9, "load": "x", "namespace": "02", "live": false}')
    assert held() == before
    table.delete("02")
    table.delete("never")
    assert held() == [("01", 1, "number")]
    table.upsert(rows(("02", 5, "back", 11)))
    assert held() == [("01", 1, "number"), ("02", 5, "back")]


def follow(spark, tmp_path, batches, **options):
    """Alerts (kind, at, n, last_1h, last_24h), and the number of state rows after each batch of lines."""
    src, out, progress = (tmp_path / x for x in ("in", "out", "progress"))
    src.mkdir()
    sizes = []
    for i, lines in enumerate(batches):
        (src / f"{i}.log").write_text("\n".join(lines) + "\n")
        states = stream.stream_signature_state(stream.stream_log_entries(stream.tail_logs(spark, str(src), "n")), **options)
        q = states.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(progress)).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    rows = spark.read.schema(states.schema).parquet(str(out)).orderBy("signature", "at", "kind").collect()
    return [(r.signature, r.kind, str(r["at"]), r.n, r.last_1h, r.last_24h) for r in rows], sizes


def test_signature_state_over_many_batches(spark, tmp_path):
    """Late lines are sorted in, alerts come once the watermark has passed, counts and keys go after quiet days."""
    def lines(day, *times, what="AError: x"):
        return [f"2024-01-{day:02d} {t} ERROR {what}" for t in times]

    tick = "Ticker: t"
    batches = [
        lines(1, "10:00:00", "10:00:30"), lines(1, "10:30:00"),
        lines(1, "10:29:10", what="AError: late"),  # late, but within ten minutes
        lines(1, "09:00:00", what="AError: too late"), lines(2, "10:00:00"), lines(3, "12:00:00", what=tick),
        lines(4, "12:00:00", what=tick), lines(9, "12:00:00", what=tick), lines(9, "12:30:00", what=tick),
    ]
    got, sizes = follow(spark, tmp_path, batches, forget_days=5)
    mine = [g[1:] for g in got if g[0] == "exc:AError"]
    assert mine == [
        ("new", "2024-01-01 10:00:00", 2, 2, 2), ("quiet", "2024-01-01 16:30:00", 4, 0, 4), ("regression", "2024-01-02 10:00:00", 5, 1, 3),
        ("quiet", "2024-01-02 16:00:00", 5, 0, 1)]
    # Two minutes a day's counts hold at most, and after five days without a line the signature is forgotten.
    assert sizes[-1] < max(sizes) and sizes[-1] <= 4


def test_signature_state_counts_a_line_once(spark, tmp_path):
    line = "2024-01-01 10:00:00 ERROR AError: x"
    got, _ = follow(spark, tmp_path, [[line, line], [line], ["2024-01-01 10:05:00 ERROR AError: y"], ["2024-01-02 10:00:00 ERROR BError: y"]],
                    identity=["source_file", "ts", "signature"])
    assert [g[1:4] for g in got if g[0] == "exc:AError"][0] == ("new", "2024-01-01 10:00:00", 2)  # one per file


def test_view_sizes_follow_their_tables(spark):
    sf = "/root/testdata/sf0.001"
    assert views.log_view(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert views.code_files(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
