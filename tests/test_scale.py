"""Tasks and the driver hold a bounded part of a table, whatever the table's size."""

import numpy as np

from pyspark.sql import functions as F

from conftest import plan_of
from faultline.functions import groups
from faultline.operators import chain, codeunits, graph, linking, retrieve, vectorindex
from faultline.sources import logs
from test_retrieval import ASKED, CHUNK, brute_force, found


def test_vector_search_in_small_tiles_equals_brute_force(spark, monkeypatch):
    """Many tiles, cuts in between, equal vectors on both sides, vectors without length."""
    for name, value in (("TILE", 40), ("QUERY_TILE", 16), ("SLICE", 8), ("WAITING", 64)):
        monkeypatch.setattr(vectorindex, name, value)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(240, 6))
    vectors[60:120] = vectors[60]
    vectors[200:205] = 0
    rows = [("hot" if i % 5 else "cold", f"c{i:04d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    queries = [(i, rows[i][0], rows[i][2]) for i in range(0, 240, 3)]
    index = vectorindex.build_index(spark.createDataFrame(rows, CHUNK).repartition(4), 12, 10)
    hits, _ = vectorindex.search_index(index, spark.createDataFrame(queries, ASKED).repartition(3), 5)
    assert found(hits) == brute_force(rows, queries, 5)
    assert index.blocks.select("namespace", "tile").distinct().count() > 4


def test_tiles_of_queries_are_moved_once_per_group(spark, monkeypatch):
    """Blocks are moved once per tile of queries and queries once per group of blocks, and a tile leaves k hits a query behind."""
    rng = np.random.default_rng(11)
    rows = [("n", f"c{i:04d}", [float(x) for x in v]) for i, v in enumerate(np.repeat(rng.normal(size=(300, 5)), 4, axis=0))]
    queries = [(i, "n", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(90, 5)))]
    for name, value in (("TILE", 25), ("QUERY_TILE", 1000), ("PER_CORE", 1)):
        monkeypatch.setattr(vectorindex, name, value)
    index = vectorindex.build_index(spark.createDataFrame(rows, CHUNK).repartition(4), 20, 10)
    moved, plain = [], vectorindex._streams

    def streams(index, limited):
        out = plain(index, limited)
        moved.append(out.groupBy("kind").count().collect())
        return out

    monkeypatch.setattr(vectorindex, "_streams", streams)
    hits, _ = vectorindex.search_index(index, spark.createDataFrame(queries, ASKED), 6)
    assert found(hits) == brute_force(rows, queries, 6)
    tiles, cores = index.tiles.first()["tiles"], spark.sparkContext.defaultParallelism
    assert tiles > 3 * cores and {r["kind"]: r["count"] for r in moved[0]}[0] <= len(queries) * cores


def test_terms_of_chunks_are_counted_once(spark, monkeypatch):
    """One pass over the texts of the chunks serves the rarities and the vectors."""
    chunks = spark.createDataFrame([("n", f"c{i}", f"word{i % 3} error {i}") for i in range(9)], "namespace string, chunk_id string, text string")
    asked = spark.createDataFrame([(1, "n", "any error?")], "query_id long, namespace string, question string")
    passes, plain = [], retrieve._term_counts
    monkeypatch.setattr(retrieve, "_term_counts", lambda rows, *a: passes.append("chunk_id" in rows.columns or rows.count() == 9) or plain(rows, *a))
    assert retrieve.multi_query_knn(chunks, asked, 3, 16).count() >= 3 and passes.count(True) == 1


def test_equal_questions_are_searched_once(spark, monkeypatch):
    """A question asked a hundred times is one vector in the tiles and a hundred answers."""
    chunks = spark.createDataFrame([("n", f"c{i}", [float(i), 1.0]) for i in range(9)], CHUNK)
    asked = spark.createDataFrame([(i, "n", [1.0, 0.0]) for i in range(100)] + [(100, "n", [0.0, 0.0])], ASKED)
    searched = []
    plain = vectorindex._limited
    monkeypatch.setattr(vectorindex, "_limited", lambda index, placed, k: searched.append(placed.count()) or plain(index, placed, k))
    hits = vectorindex.search_index(vectorindex.build_index(chunks), asked, 2)[0]
    got = found(hits)
    assert searched == [2] and len(got) == 101
    assert all(got[i] == [(-7.0, "c8"), (-6.0, "c7")] for i in range(100)) and got[100] == [(1.0, "c0"), (1.0, "c1")]


def test_evidence_is_never_sent_to_the_driver(spark):
    """The evidence may be a whole table that only looks small in its file: both sides are shuffled."""
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "query_id bigint, chunk_id string")
    left = retrieve.not_in_evidence(hits, spark.createDataFrame([(1, "a"), (1, "a"), (2, "c")], hits.schema), ["chunk_id"])
    assert "SortMergeJoin" in plan_of(left) and "Broadcast" not in plan_of(left)
    assert sorted(tuple(r) for r in left.collect()) == [(1, "b"), (2, "a")]


def test_numbered_names_look_up_few_texts(spark):
    """Names that differ in their number only: the candidates grow with the names, not with their square, and no pair is lost."""
    names = [f"u{i}.py" for i in range(100000, 104000)] + ["u1", "py", "u1000", "füü.py", "nowhere-at-all"]
    paths = spark.createDataFrame([(f"src/{n}",) for n in names[:-1]] + [("lib/u100000.py.orig",)], "path string")
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    long = wanted.where("length(name) > 6").select(F.col("name").alias("_needle"))
    distinct = paths.select(F.col("path").alias("_value"), F.sha2("path", 256).alias("_text"))
    assert groups._looked_up(distinct, long).count() < 4 * len(names)
    got = sorted((r["path"], r["name"]) for r in groups.containment_pairs(paths, "path", wanted, "name").collect())
    assert got == sorted((r["path"], n) for r in paths.collect() for n in names if n in r["path"])


def test_files_of_one_split_have_no_row_to_send(spark):
    """Short files, however many, are placed without a table of their ends; longer files are, by the splits behind their first."""
    lines = [("n", f"f{i}", n, "x" * 30) for i in range(300) for n in range(1, 4)] + [("n", "long", n, "y" * 30) for n in range(1, 9001)]
    lines[-1] = ("n", "long", 9000, "2024-01-30T10:00:00Z ERROR " + "z" * 60)
    numbered = spark.createDataFrame(lines, "namespace string, source_file string, line_no bigint, text string")
    block = F.floor((F.col("line_no") - 1) / logs.LINES_PER_BLOCK)
    ordered = numbered.withColumn("split", block).repartition("namespace", "source_file", "split").sortWithinPartitions("source_file", "split", "line_no")
    pieces = logs.pieces_of(ordered)
    later = sorted(tuple(r) for r in logs._later_ends(pieces).collect())
    assert later == [("n", "long", 1, 4096, 1), ("n", "long", 2, 8192, 1)]
    got = logs.log_entries(numbered).collect()
    assert sorted((r.line_start, r.line_end) for r in got if r.source_file == "long") == [
        (a, min(a + 79, 8999)) for a in range(1, 9000, 80)] + [(9000, 9000)]
    assert sorted({(r.line_start, r.line_end) for r in got if r.source_file != "long"}) == [(1, 3)]


def test_links_are_sought_once_per_list_of_names(spark, monkeypatch):
    """A thousand entries that name the same code are one list of names; rows of one place with different names are merged."""
    text = "ERROR x at src/mod1.py:{0}, in fn"
    log = spark.createDataFrame([("n", "a.log", i, text.format(i + 1)) for i in range(1000)] + [
        ("n", "a.log", 5000, "at src/mod1.py:3"), ("n", "a.log", 5000, "at lib/other.py:9")], "namespace string, source_file string, ord bigint, text string")
    code = spark.createDataFrame([("n", f, s, s + 9, "", "") for f in ("src/mod1.py", "lib/other.py") for s in range(1, 60, 10)],
                                 "namespace string, source_file string, line_start bigint, line_end bigint, function_name string, class_name string")
    sought = []
    plain = linking._linked
    monkeypatch.setattr(linking, "_linked", lambda refs, keys: sought.append(refs.select("namespace", "ord").distinct().count()) or plain(refs, keys))
    got = linking.link_logs_code(linking.code_refs(log), code).collect()
    assert sought == [2]
    places = {}
    for r in got:
        places.setdefault(r.ord, []).append((r.link_no, r.code_file, r.code_start))
    first = [(i + 1, "src/mod1.py", 10 * i + 1) for i in range(5)]
    assert len(places) == 1001 and all(sorted(places[i]) == first for i in range(1000))
    merged = [(f, 10 * i + 1) for i in range(3) for f in ("lib/other.py", "src/mod1.py")][:5]
    assert sorted(places[5000]) == [(i + 1, *p) for i, p in enumerate(merged)]


def test_files_are_parsed_once(spark):
    """The units of a file are worked out in one pass; files without any become one unit, those too short for it none."""
    long = "just some words that no rule of the language takes for a unit"
    files = [("n", "a.py", "def f(x):\n    return x + 1\n"), ("n", "b.py", "x = 1"), ("n", "c.txt", long), ("n", "d.sh", long), ("n", "e.yaml", "key: 1"), ("n", "f.json", "[1]")]
    units = codeunits.code_units(spark.createDataFrame(files, "namespace string, source_file string, text string"))
    assert plan_of(units).count("LeftAnti") == 1
    assert sorted({(r.source_file, r.kind) for r in units.collect()}) == [
        ("a.py", "function"), ("c.txt", "module"), ("d.sh", "module"), ("e.yaml", "config_block"), ("f.json", "config_block")]


def test_term_search_orders_only_tokens_with_a_term(spark, monkeypatch):
    """Tokens that hold no term are never sorted; with too many tokens for the tasks the hits are the same."""
    rows = [("n", f"f{i % 7}", i, f"c{i:03d}", f"w{i} x{i} " + ("call fn1b" if i % 50 == 0 else "idle")) for i in range(200)]
    chunks = spark.createDataFrame(rows, "namespace string, source_file string, line_start long, chunk_id string, text string")
    wanted = spark.createDataFrame([(7, "n", 0, "fn1"), (8, "n", 0, "x3")], "query_id long, namespace string, pos int, term string")
    plain, ordered = retrieve.first_n, []

    def counted(df, keys, *rest, **named):
        if keys == ["namespace", "token"]:
            ordered.append(df.count())
        return plain(df, keys, *rest, **named)

    monkeypatch.setattr(retrieve, "first_n", counted)
    got = []
    for few in (retrieve.FEW_TOKENS, 0):
        monkeypatch.setattr(retrieve, "FEW_TOKENS", few)
        got.append(sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in retrieve.term_search(chunks, wanted, 3).collect()))
    first = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
    expected = [(q, i + 1, r[3]) for q, term in ((7, "fn1"), (8, "x3")) for i, r in enumerate([r for r in first if term in r[4]][:3])]
    # fn1b four times, x3 and x30 to x39 once each.
    assert got == [expected, expected] and ordered[0] == 15


def test_word_and_severity_search_order_few_chunks(spark, monkeypatch):
    """Chunks behind the first k of a sample are not sorted; ties, nulls and groups smaller than the sample stay whole."""
    rows = [(f"n{i % 2}" if i % 9 else None, f"f{i % 7}", i // 3, f"c{i % 500:04d}", "ERROR here" if i % 100 else "Traceback", "error") for i in range(6000)]
    rows += [("n2", "f", 1, "c", "ERROR", "error")]
    chunks = spark.createDataFrame(rows, "namespace string, source_file string, line_start long, chunk_id string, text string, severity string").repartition(3)
    plain, ordered = groups.first_n, []
    monkeypatch.setattr(groups, "first_n", lambda df, *a, **b: ordered.append(df.count()) or plain(df, *a, **b))
    got = retrieve.severity_search(chunks, "error", 4).collect()
    want = [(ns, i + 1, *r[1:4]) for ns in (None, "n0", "n1", "n2") for i, r in enumerate(sorted((r for r in rows if r[0] == ns), key=lambda r: r[1:4])[:4])]
    assert sorted(map(str, want)) == sorted(str((r.namespace, r["rank"], r.source_file, r.line_start, r.chunk_id)) for r in got)
    assert sum(ordered) < len(rows) / 4
    asked = spark.createDataFrame([(7, "n1", "any error?"), (8, "n2", "any error?")], "query_id long, namespace string, question string")
    ordered.clear()
    hits = [(r.query_id, r["rank"], r.chunk_id) for r in retrieve.keyword_search(chunks, asked, 4).orderBy("query_id", "rank").collect()]
    first = sorted((r[1:4] for r in rows if r[0] == "n1" and "ERROR" in r[4]))[:4]
    assert hits == [(7, i + 1, r[2]) for i, r in enumerate(first)] + [(8, 1, "c")] and sum(ordered) < len(rows) / 4
    monkeypatch.setattr(groups, "FEW_KEYS", 0)
    assert sorted(map(str, retrieve.severity_search(chunks, "error", 4).collect())) == sorted(map(str, got))


def test_hits_are_described_without_moving_the_chunks(spark, monkeypatch):
    """Only chunks that are hits meet them; with too many hits for the tasks the rows are the same."""
    chunks = spark.range(3000).select(F.concat(F.lit("c"), (F.col("id") % 2900).cast("string")).alias("chunk_id"), "id")
    hits = spark.createDataFrame([(1, "c5"), (2, "c2950"), (2, "c7"), (3, None), (3, "none")], "query_id long, chunk_id string")
    near = groups.narrowed(chunks, "chunk_id", hits)
    assert near.count() == 4 and "SortMergeJoin" not in plan_of(near) and near.columns == chunks.columns
    monkeypatch.setattr(groups, "FEW_HASHES", 2)
    assert groups.narrowed(chunks, "chunk_id", hits).count() == 3000


def test_structural_answers_search_the_paths_once(spark, monkeypatch):
    """The lines of an answer and its subject come from one search of the paths."""
    units = spark.createDataFrame(
        [("n", f"src/u{i}.py", "function", f"f{i}", "", i, i + 1, [], "pass") for i in range(12)],
        "namespace string, source_file string, kind string, name string, class_name string, start_line int, end_line int, imports array<string>, text string")
    asked = spark.createDataFrame([(1, "n", "which functions are in u1.py?"), (2, "n", "which functions are in u1?"),
                                   (3, "n", "which functions are in nowhere.py?")], "query_id long, namespace string, question string")
    searches, plain = [], graph.containment_pairs
    monkeypatch.setattr(graph, "containment_pairs", lambda *a: searches.append(a[1]) or plain(*a))
    got = {r["query_id"]: r["answer"] for r in chain.query_graph(units, asked).collect()}
    assert searches.count("source_file") == 1
    assert got == {i: "Symbols in `src/u1.py`:\n  - function: f1 (lines 1–2)" for i in (1, 2)}
