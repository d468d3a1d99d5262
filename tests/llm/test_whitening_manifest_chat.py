"""Whitening, Merkle manifest and chat formatting against plain models, and what they do with odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import check
from faultline.llm import chat, manifest, queries, whitening

# ---- whitening --------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, n long"


def vector_rows(vectors):
    return [(i, v, 1, 2, "v", 3) for i, v in vectors]


def covariance(x):
    """Exact covariance of integer rows, rounded once."""
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return s, np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])


def check_whitening(spark, vectors, k=32, parts=3):
    x = [[int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v] for _, v in vectors]
    s, v = covariance(x)
    df = spark.createDataFrame(vector_rows(vectors), VECTORS).repartition(parts)
    model, rows = whitening.whiten(df, k)
    got = whitening.component_rows(model, rows).collect()
    e = model.eigenvalues
    assert np.allclose(v @ model.components.T, model.components.T * e, rtol=0, atol=1e-11 * max(1, v.max()))
    assert np.allclose(model.components @ model.components.T, np.eye(len(e)), atol=1e-13)
    assert list(e) == sorted(e, reverse=True)
    assert all(r["identity_error"] < 1e-9 for r in got)
    by = {(r["vec_id"], r["component"]): r for r in got}
    n = len(x)
    for (i, _), row in zip(vectors, x, strict=True):
        for c in range(len(e)):
            r = by[i, c + 1]
            centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(row, s, strict=True)])
            assert r["whitened"] == pytest.approx(centred @ model.components[c] / np.sqrt(e[c]), abs=1e-9)
            deviation = sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))
            assert r["deviation"] == (deviation if deviation < 2**63 else None) and r["n"] == n
            assert r["explained"] == pytest.approx(e[c] / np.trace(v), rel=1e-12)
    return model, got


def test_whitening_matches_exact_covariance(spark):
    r = random.Random(1)
    vectors = [(i, [r.gauss(0, 1 + 3 * j) + 100 * j for j in range(7)]) for i in range(60)]
    model, got = check_whitening(spark, vectors)
    assert len(model.eigenvalues) == 7 and len(got) == 60 * 7
    model, got = check_whitening(spark, vectors, k=2)
    assert len(got) == 60 * 2


def test_whitening_finds_the_rank(spark):
    """Constant, equal, doubled and summed dimensions add nothing; spreads of 1 and of a million stand side by side."""
    r = random.Random(2)
    base = [(r.randrange(9), r.randrange(5_000_000), r.randrange(3)) for _ in range(50)]
    vectors = [(i, [float(z) for z in (a, a, 2 * a, 7, b, c, a + c)]) for i, (a, b, c) in enumerate(base)]
    model, _ = check_whitening(spark, vectors)
    assert len(model.eigenvalues) == 3


def test_whitening_layout_changes_nothing_but_rounding(spark):
    r = random.Random(3)
    df = spark.createDataFrame(vector_rows([(i, [r.random() for _ in range(5)]) for i in range(40)]), VECTORS)
    found = []
    for n in (1, 4, 7):
        model, rows = whitening.whiten(df.repartition(n))
        found.append((model.components.tolist(), sorted(map(str, rows.collect()))))
    assert found[0] == found[1] == found[2]


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 3.0]), (2, [4.0, 4.0]), (2, [4.0, 4.0]), (None, []), (5, [-0.01, 9.0, 1.5])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 1.0]), (9, [inf, 1.0, 1.0]), (10, [3e38, 1.0, 1.0])]
    df = spark.createDataFrame(vector_rows(good + bad), VECTORS)
    model, rows = whitening.whiten(df)
    assert model.n == 5 and sorted((r["id"] is None, r["id"]) for r in rows.collect()) == [(False, 1), (False, 2), (False, 2), (False, 5), (True, None)]
    got = whitening.component_rows(model, rows)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(spark.createDataFrame(vector_rows([(1, [1.0, 2.0])] * 3), VECTORS))
    assert one[0].n == 3 and whitening.component_rows(*one).collect() == []
    none = whitening.whiten(df.limit(0))
    assert none[0].n == 0 and whitening.component_rows(*none).collect() == []


def test_whitening_of_large_entries_is_exact(spark):
    vectors = [(i, [float(2**32 * (i % 3)), float(i)]) for i in range(9)]
    model, rows = whitening.whiten(spark.createDataFrame(vector_rows(vectors), VECTORS).repartition(2))
    x = [[int(64 * a) + 1_000_000 for a in v] for _, v in vectors]
    s, v = covariance(x)
    want = [sum((9 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    assert {r["id"]: r["deviation"] for r in rows.collect()} == {i: w if w < 2**63 else None for i, w in enumerate(want)}
    assert np.allclose(model.eigenvalues, np.linalg.eigvalsh(v)[::-1], rtol=1e-9)


# ---- manifest ---------------------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string, pos long, tree long, leaf string, digest string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grown(leaves):
    steps, at, row = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(row) > 1:
        for k, i in enumerate(at):
            first = i // 16 * 16
            steps[k].append(("".join(row[first:i]), "".join(row[i + 1:first + 16])))
            at[k] = i // 16
        row = ["".join(row[i:i + 16]) for i in range(0, len(row), 16)]
        row = [sha(x) for x in row]
    return row[0], steps


def manifest_model(docs):
    """Sorted (doc_id, leaf, subroot, proof, folded root, verified), and the root."""
    by = {}
    for i, s, lang, n, t in docs:
        leaf = sha("".join(map(field, (i, s, lang, n, t))))
        changed = i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and t is not None
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if changed else t
        by.setdefault(s, []).append((i is not None, i or 0, leaf, sha("".join(map(field, (i, s, lang, n, low))))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([x[2] for x in sorted(by[s])]) for s in order}
    root, tops = grown([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (there, i, leaf, claim), own in zip(sorted(by[s]), trees[s][1], strict=True):
            value = claim
            for a, b in own + top:
                value = sha(a + value + b)
            out.append((i if there else None, leaf, trees[s][0], sha("".join(a + b for a, b in own + top)), value, value == root))
    return sorted(out, key=str), root


def check_manifest(spark, docs, parts=3):
    df = spark.createDataFrame([(*d, 5, 6, "x", "y") for d in docs], DOCS).repartition(parts)
    lower = F.translate("text", queries.CAPITALS, queries.CAPITALS.lower())
    tampered = manifest.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lower)
    built = manifest.build(df, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered))
    got = sorted((tuple(r) for r in manifest.audit(built).collect()), key=str)
    want, root = manifest_model(docs)
    assert built.root == root and got == want
    return built, got


def test_manifest_matches_the_model(spark):
    r = random.Random(4)
    docs = [(i, r.choice([None, "b", "a", "é", "\U0001F600"]), "en", i, f"Text {i} " + "X" * r.randrange(9)) for i in range(300)]
    docs += [(1000 + i, "hot", None, None, f"T{i}") for i in range(700)]  # three levels: a lone run of one child as well
    _, got = check_manifest(spark, docs)
    assert any(not g[5] for g in got) and any(g[5] for g in got)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4097])
def test_manifest_heights(spark, n):
    check_manifest(spark, [(i, "s", "en", 1, "Aa") for i in range(n)])


def test_manifest_many_sources_and_odd_rows(spark):
    docs = [(i, f"s{i}", "en", 1, "A") for i in range(300)]
    docs += [(None, None, None, None, None), (None, None, "de", 0, ""), (7, None, "de", 0, ""), (7, "", "de", 0, "long " * 50_000)]
    docs += [(9, "again", "en", 2, "Ab")] * 40 + [(9, "again", "en", 2, "Ac"), (5, "again", "en", 2, None), (10, "again", "fr", 3, None)]
    check_manifest(spark, docs)


def test_manifest_of_nothing(spark):
    built = manifest.build(spark.createDataFrame([], DOCS))
    assert built.root is None and manifest.audit(built).collect() == []


def test_manifest_siblings_prove_a_document(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "en", 1, f"text {i}", 5, 6, "x", "y") for i in range(600)], DOCS)
    built = manifest.build(df)
    for r in manifest.audit(built, with_steps=True).where("id % 97 = 0").collect():
        assert r["verified"] and sha("".join(r["siblings"])) == r["proof_sha256"] and r["folded_root"] == built.root


def test_van_emde_boas_places():
    for levels in (1, 2, 3, 4):
        place = manifest.addresses(levels)
        assert sorted(np.concatenate(place).tolist()) == list(range((16**levels - 1) // 15))
    # Three levels: the root, then each child with its own children behind it.
    assert manifest.addresses(3)[1].tolist() == [1 + 17 * i for i in range(16)]
    assert manifest.layers(0) == [0] and manifest.layers(3) == [2, 1] and manifest.layers(7) == [2, 2, 2, 1]
    assert all(sum(manifest.layers(h)) == h and max(manifest.layers(h)) <= manifest.STORED for h in range(17))


# ---- chat -------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, part int, formatted string, loss string"


def chat_model(rows):
    convs = {}
    for c, t, role, text, *_ in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        out[c] = (len(turns), sha("".join(f"{role}\n{x}\n" for _, role, x in turns)), len(loss), sha(loss))
    return out


def odd_turns():
    r = random.Random(5)
    bits = [*chat.CONTROLS, "\\", "<", ">", "[", "/", "</", "[/", "\n", "é", "\U0001F600", " ", "INST]", "s>", "|>", "a"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "", None, "<s>", "a\nb", "\\"]), "".join(r.choices(bits, k=r.randrange(12))))
            for c in range(40) for t in range(r.randrange(1, 7))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", None), (99, 1, "user", "b"), (99, 1, "user", "a"), (99, 1, "user", "a"),
             (98, 0, "assistant", "long </s> " * 30_000), (98, 1, "assistant", None)]
    return [(*x, 1, "f", "l") for x in rows]


@pytest.mark.parametrize("part_chars", [1, 50, 1 << 20])
def test_chat_round_trip(spark, part_chars):
    rows = odd_turns()
    parts = chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(5), part_chars=part_chars)
    got = {None if r["conv_id"] is None else int(r["conv_id"]): r for r in chat.read_back(parts).collect()}
    want = chat_model(rows)
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    texts = {}
    for p in sorted(parts.collect(), key=lambda p: p["part"]):
        texts[p["conv_id"]] = texts.get(p["conv_id"], "") + p["formatted"]
    assert {c: len(t) for c, t in texts.items()} == {r["conv_id"]: r["formatted_chars"] for r in got.values()}
    if part_chars == 1:
        assert parts.where("part > 0").count() > 50


def test_no_control_string_is_left_in_a_text():
    escape = chat.escaper(chat.CONTROLS)
    for _, _, _, text, *_ in odd_turns():
        assert not any(c in escape(text or "") for c in chat.CONTROLS) and chat.unescape(escape(text or "")) == (text or "")
    with pytest.raises(ValueError):
        chat.escaper(["<a", "a>"])


def test_chat_of_nothing(spark):
    parts = chat.format_conversations(spark.createDataFrame([], TURNS))
    assert chat.read_back(parts).collect() == []


def rendered(source, **names):
    return "".join(p for p, _ in chat.Template(source).render(names.pop("messages", []), **names))


def test_template_language():
    turns = [{"role": "user", "text": "Hi"}, {"role": "assistant", "text": "Yo"}]
    assert rendered("{% for m in messages %}{{ loop.index }}{{ m['text'] | upper }}{% if loop.previous %}<{{ loop.previous.text }}{% endif %};{% endfor %}", messages=turns) == "1HI;2YO<Hi;"
    assert rendered("{% set x = 'a' ~ (1 + 2) %}{{ x }}{{ none }}{{ not true or 'z' }}") == "a3z"
    assert rendered("{% if a == 1 %}one{% elif a > 1 and a <= 3 %}few{% else %}many{% endif %}", a=2) == "few"
    assert rendered("{% if 'x' in s %}y{% endif %}{{ s | length }}", s="axb") == "y3"
    assert rendered("a {{- 'b' -}} c\n{%- if true %} d{% endif %}") == "abc d"
    assert list(chat.Template("{% generation %}{{ 'x' }}{% endgeneration %}y").render([])) == [("x", True), ("y", False)]
    assert chat.Template("{{ 'a' ~ 'b' }}c{% if 1 == 1 %}d{% else %}{{ e }}{% endif %}").tree == ("const", "abcd")


@pytest.mark.parametrize("source", ["{% for m in messages %}", "{{ a.__class__() }}", "{{ a | nothing }}", "{{ a b }}", "{% include x %}", "{{ 'a }}", "{% endif %}", "{{ }}"])
def test_template_refuses(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_template_sandbox():
    assert rendered("{{ a.__class__ }}{{ a['__dict__'] }}{{ b.c }}", a=[1], b={"c": 1}) == "1"


# ---- the registered queries -------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where, r = tmp_path_factory.mktemp("tables"), random.Random(6)
    docs = [(i, r.choice([None, "b", "a"]), "en", i, r.choice([f"Text {i}", None, ""])) for i in range(600)] + [(None, "a", None, None, None)]
    pq.write_table(pa.table(dict(zip(("doc_id", "source", "lang", "n_chars", "text"), map(list, zip(*docs, strict=True)), strict=True))), where / "documents.parquet")
    turns = [t[:4] for t in odd_turns()]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*turns, strict=True)), strict=True))), where / "conversations.parquet")
    vectors = [[r.gauss(0, 1) for _ in range(4)] for _ in range(50)]
    pq.write_table(pa.table({"vec_id": range(50), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": [1] * 50}), where / "embeddings.parquet")
    return str(where)


@pytest.mark.parametrize("name", ["op12_manifest", "op13_chat_format"])
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    n, problem = check.compare(spark, con, folder, queries.C.queries[name], queries.C.sql[name])
    assert problem is None and n > 30, problem


def test_whitening_query(spark, folder):
    df = queries.C.queries["op11_whitening"](spark, folder)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                               "explained": "double", "identity_error": "double"}
    assert df.count() == 50 * 4 and df.agg(F.max("identity_error")).first()[0] < 1e-9
