import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import models
from faultline.operators import linking, rank, retrieve, vectorindex
from faultline.operators import questions as P
from faultline.functions.groups import containment_pairs



def ref():
    return F.lit("2024-01-30 23:00:00").cast("timestamp")


def brute_force(rows, queries, k):
    """{query: [(distance, chunk_id)]} over rows (namespace, chunk_id, vector)."""
    def apart(a, b):
        return round(1 - float(np.asarray(a, np.float32).astype(np.float64) @ np.asarray(b, np.float32).astype(np.float64)), 9)

    return {q: sorted((apart(v, x), c) for ns, c, x in rows if ns == asked)[:k] for q, asked, v in queries}


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["distance"], r["chunk_id"]))
    return out


CHUNK, ASKED = "namespace string, chunk_id string, embedding array<float>", "query_id long, namespace string, embedding array<float>"


@pytest.mark.parametrize(("cell", "block"), [(512, 4096), (20, 8), (3, 1000)])
def test_index_equals_brute_force(spark, cell, block):
    """Random vectors of any length, clusters, equal vectors and a namespace with most rows."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)) * rng.uniform(0, 3, size=(300, 1))
    vectors[100:200] = vectors[100] + rng.normal(size=(100, 8)) * 0.01
    vectors[200:240] = vectors[200]  # equal distances go by id
    vectors[250] = 0
    rows = [("hot" if i % 7 else "cold", f"c{i:04d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    queries = [(i, rows[i][0], rows[i][2]) for i in range(0, 300, 5)]
    index = vectorindex.build_index(spark.createDataFrame(rows, CHUNK).repartition(5), cell, block)
    hits, _ = vectorindex.search_index(index, spark.createDataFrame(queries, ASKED).repartition(3), 6)
    assert found(hits) == brute_force(rows, queries, 6)


def test_index_leaves_cells_out(spark):
    """On clustered vectors a query visits a small part of the pairs, and still finds what brute force finds."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    vectors = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16)) * 0.02
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [("n", f"c{i:04d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    queries = [(i, "n", rows[i][2]) for i in range(0, 2000, 40)]
    index = vectorindex.build_index(spark.createDataFrame(rows, CHUNK), cell=25)
    hits, visits = vectorindex.search_index(index, spark.createDataFrame(queries, ASKED), 8)
    assert found(hits) == brute_force(rows, queries, 8)
    assert (visits.agg(F.sum("pairs")).first()[0] or 0) < 0.2 * len(rows) * len(queries)


def test_knn_without_queries_or_with_few_chunks(spark):
    chunks = spark.createDataFrame([("a", "x", [1.0, 0.0])], "namespace string, chunk_id string, embedding array<float>")
    none = spark.createDataFrame([], "query_id long, namespace string, embedding array<float>")
    assert retrieve.knn(chunks, none).count() == 0
    one = spark.createDataFrame([(1, "a", [0.0, 1.0]), (2, "b", [0.0, 1.0])], "query_id long, namespace string, embedding array<float>")
    assert [(r.query_id, r.distance) for r in retrieve.knn(chunks, one, 3).collect()] == [(1, 1.0)]


def test_chunks_of_one_text_are_searched_once(spark, monkeypatch):
    """Copies beyond k, one id in two namespaces and one id with two texts; the fused hits are those of a search over every chunk."""
    texts = ["payment service failing with timeout", "null pointer in user store", "timeout reading orders", "session created"]
    rows = [("ns0" if i % 5 else "ns1", f"c{i * 37 % 80:03d}", texts[i % 4]) for i in range(80)]
    rows += [("ns0", "x", texts[0]), ("ns1", "x", texts[0]), ("ns0", "y", texts[1]), ("ns0", "y", texts[2])]
    chunks = spark.createDataFrame(rows, "namespace string, chunk_id string, text string").repartition(4)
    questions = spark.createDataFrame([(1, "ns0", "Why is the payment timeout?"), (2, "ns1", "user store"), (3, "ns0", "orders session")],
                                      "query_id long, namespace string, question string")
    k, dims, plain, sent = 5, 32, retrieve.knn, []

    def knn(stored, queries, k):
        sent.append((stored.count(), queries))
        return plain(stored, queries, k)

    monkeypatch.setattr(retrieve, "knn", knn)
    got = retrieve.multi_query_knn(chunks, questions, k, dims)
    every = plain(retrieve.vectorise(chunks, dims=dims), sent[0][1], k)
    lists = every.select(F.floor(F.col("query_id") / 4).alias("query_id"), F.pmod("query_id", F.lit(4)).alias("list_no"), "rank", "chunk_id", "distance")
    want = retrieve.rrf_fuse(lists, ["chunk_id"])
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    assert sent[0][0] == len({(ns, text) for ns, _, text in rows})


def test_overlap_walk_equals_model(spark):
    rng = random.Random(7)
    rows = []
    for q in range(40):
        spots = rng.sample(range(200), 12)
        for pos, s in enumerate(spots, 1):
            rows.append((q, f"f{rng.randint(0, 2)}", s, s + rng.randint(0, 40), pos, rng.randint(0, 5) / 10))
    df = spark.createDataFrame(rows, "query_id long, source_file string, line_start long, line_end long, pos long, distance double")
    for better, test in (("low", lambda a, b: a < b), ("high", lambda a, b: a > b)):
        got = {}
        for r in rank.dedup_overlap(df, "distance", better).collect():
            got.setdefault((r.query_id, r.source_file), set()).add((r.line_start, r.line_end, r.distance))
        groups = {}
        for q, f, a, b, p, d in rows:
            groups.setdefault((q, f), []).append((a, b, p, d))
        assert got == {k: {(a, b, d) for a, b, _, d in models.overlap_walk(v, test)} for k, v in groups.items()}


def test_budget_equals_model(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for q in range(30):
        parts = ["x" * rng.choice([10, 150, 260, 400, 900]) + str(i) for i in range(6)]
        want[q] = models.budget(parts, 1000)
        rows += [(q, i, p) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "query_id long, ordinal int, section string")
    for r in rank.budget_context(df, 1000).collect():
        assert r.context == "\n\n" + "═" * 60 + "\n\n".join(want[r.query_id])


def test_boosts_and_labels(spark):
    rows = [(1, 1, 0.5, "plain text", "", "", None), (1, 2, 0.5, "ERROR here\n  at a.b(C.java:3)", "function", "doc", "2024-01-30 20:00:00"),
            (1, 3, 0.5, "x", "class", "", "2024-01-25 20:00:00"), (1, 4, 0.05, "Traceback (most recent call last)", "method", "d", "2024-01-30 22:59:00")]
    df = spark.createDataFrame(rows, "query_id long, pos int, distance double, text string, chunk_kind string, docstring string, t string")
    df = df.withColumn("detected_timestamp", F.to_timestamp("t"))
    got = {r.pos: (r.confidence, r.confidence_label, r["rank"]) for r in rank.boost_rank(df, ref()).collect()}
    assert got == {1: (0.5, "medium", 4), 2: (0.74, "high", 2), 3: (0.56, "medium", 3), 4: (1.0, "high", 1)}


def test_query_variants(spark):
    asked = [(1, "n", "Why is the database timeout in core.user_store"), (2, "n", "NullPointerException"), (3, "n", "What is it?")]
    df = spark.createDataFrame(asked, "query_id long, namespace string, question string")
    got = {}
    for r in retrieve.query_variants(df).orderBy("query_id", "variant_no").collect():
        got.setdefault(r.query_id, []).append(r.variant)
    assert got[1] == [asked[0][2], "database timeout core.user_store", "Why is the database timed out in core.user_store", "core.user_store user_store core.user_"]
    assert got[2] == ["NullPointerException"] and got[3] == ["What is it?"]


def test_term_search_finds_parts_of_tokens(spark):
    chunks = spark.createDataFrame([("n", f"f{i}", i, f"c{i}", t) for i, t in enumerate(["run1() here", "xrun1y", "run2", "nothing"])],
                                   "namespace string, source_file string, line_start long, chunk_id string, text string")
    wanted = spark.createDataFrame([(7, "n", 0, "run"), (7, "n", 1, "nothing"), (8, "n", 0, "run1")], "query_id long, namespace string, pos int, term string")
    got = {}
    for r in retrieve.term_search(chunks, wanted, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {7: ["c0", "c1", "c2"], 8: ["c0", "c1"]}


def test_containment_pairs(spark):
    texts = spark.createDataFrame([("abcab",), ("bc",), ("zz",)], "t string")
    needles = spark.createDataFrame([("ab",), ("bc",), ("abcabc",), ("",)], "n string")
    assert {(r.t, r.n) for r in containment_pairs(texts, "t", needles, "n").collect()} == {("abcab", "ab"), ("abcab", "bc"), ("bc", "bc")}


def test_containment_equals_brute_force(spark):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choices("abcé\U0001F600. ", k=rng.randrange(0, 14))) for _ in range(150)})
    needles = sorted({"".join(rng.choices("abcé\U0001F600. ", k=rng.randrange(0, 6))) for _ in range(80)} | {"zzz", "a"})
    got = containment_pairs(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, no int"), "t",
                            spark.createDataFrame([(n, 1) for n in needles] + [(None, 1)], "n string, mark int"), "n")
    assert got.columns == ["t", "no", "n", "mark"]
    assert sorted((r.t, r.n) for r in got.collect()) == sorted((t, n) for t in texts for n in needles if n and n in t)


def test_containment_in_a_long_token_costs_its_length(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("0123456789abcdef", k=500_000))
    needles = [long[i:i + n] for i, n in ((0, 5), (1000, 40), (499_000, 900), (77, 1), (250_000, 2))] + ["x" + long[5:20]]
    start = time.monotonic()
    got = containment_pairs(spark.createDataFrame([(long,), ("short",)], "t string"), "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n")
    assert {r.n for r in got.where("length(t) > 100").select("n").collect()} == set(needles[:5])
    assert time.monotonic() - start < 60


def test_references_and_links(spark):
    text = ('Traceback\n  File "src/auth/s.py", line 31, in get\n  at com.x.Store.put(Store.java:9)\n'
            "  at send (web/app.js:4:10)\nlib/z.go:7 failed calling Cache.load, System.out by method 'retry'")
    log = spark.createDataFrame([("n", "l", 1, text), ("n", "l", 2, "no code")], "namespace string, source_file string, ord long, text string")
    refs = linking.code_refs(log)
    got = [(r.file_path, r.line_number, r.function_name, r.class_name, r.confidence) for r in refs.orderBy("ref_no").collect()]
    assert got[:4] == [("src/auth/s.py", 31, "get", "", 0.95), ("Store.java", 9, "put", "Store", 0.9), ("web/app.js", 4, "send", "", 0.9),
                       ("Store.java", 9, "", "", 0.8)]
    assert ("lib/z.go", 7, "", "", 0.8) in got and ("", 0, "load", "Cache", 0.7) in got and ("", 0, "retry", "", 0.5) in got
    assert not any(r[3] == "System" for r in got)
    code = spark.createDataFrame([("n", "x/s.py", i, i + 5, "get", "", "t") for i in range(1, 60, 10)] + [("n", "app/Store.java", 1, 9, "", "Store", "t")],
                                 "namespace string, source_file string, line_start long, line_end long, function_name string, class_name string, text string")
    links = [(r.link_no, r.code_file, r.code_start) for r in linking.link_logs_code(refs, code).orderBy("link_no").collect()]
    assert links == [(i + 1, "x/s.py", 1 + 10 * i) for i in range(5)]


def test_question_rules(spark):
    cases = {
        "Why is payment failing with an exception?": ("root_cause", "project_query"),
        "Explain the project architecture": ("architecture", "project_query"),
        "Which files import auth?": ("structural", "project_query"),
        "Show me the errors in the log": ("log_analysis", "project_query"),
        "Is the code good?": ("code_review", "project_query"),
        "How does the cart work": ("code_analysis", "project_query"),
        "Hi there you": ("general", "project_query"),
        "hello!": ("general", "conversational"),
        "tell me a joke": ("general", "conversational"),
        "give me a recipe for bread": ("general", "unrelated"),
    }
    df = spark.createDataFrame([(i, "n", q) for i, q in enumerate(cases)], "query_id long, namespace string, question string")
    got = {r.query_id: (r.question_type, r.intent) for r in df.select("query_id", P.question_type(F.col("question")).alias("question_type")).join(
        P.route_intent(df), "query_id").collect()}
    assert list(cases.values()) == [got[i] for i in range(len(cases))]
    steps = P.retrieval_plan(df).where("query_id = 0").orderBy("step_no").collect()
    assert [s.step for s in steps] == ["search_logs", "extract_refs", "retrieve_code", "get_deps", "get_arch", "cross_analysis"]
    assert steps[5].depends_on == "retrieve_code"


def test_memory_of_turns(spark):
    rows = [("a", i, f"question number {i} about the cart page", "x" * 400, [f"f{i % 3}", "g"], "general") for i in range(14)]
    turns = spark.createDataFrame(rows, "namespace string, ord long, question string, answer string, source_files array<string>, question_type string")
    last = P.last_turns(turns).collect()
    assert len(last) == 10 and max(len(r.answer_summary) for r in last) == 300
    assert [r.file for r in P.recent_files(turns).orderBy("rank").collect()] == ["f1", "g", "f0", "f2"]
    assert "**Q3**: question number 13" in P.prior_context(turns).collect()[0].context
    asked = spark.createDataFrame([("a", 0, "why"), ("a", 5, "why"), ("a", 6, "please summarise every cart page now"), ("b", 1, "why")],
                                  "namespace string, ord long, question string")
    assert [r.follow_up for r in P.follow_up(asked, turns).orderBy("namespace", "ord").collect()] == [False, True, False, False]
