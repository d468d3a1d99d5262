"""Corpus operators against one-by-one models, and what they do with odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import (graph, jaccard, language, mixing, neighbours, pieces, quality, queries, repeats, shards, topk,
                           toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, size string, node long, gram string"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ren", "tal", "vos") for c in ("a", "e", "in", "or")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    shared = prose(99, 60)
    base = prose(1, 120)
    near = base.split()
    near[5] = "changed"
    texts = [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (4, ""), (5, None), (None, base), (6, "   \n\t"),
        (7, "one two"), (8, "ONE two"), (9, prose(2, 50) + " " + shared + " " + prose(3, 50)),
        (10, shared + " " + prose(4, 80)), (11, "é" * 120), (12, "x" + "é" * 120), (13, prose(5, 9000)), (14, "aaaa " * 60),
    ]
    return [(i, t, [None, "en", "de"][k % 3], [None, "a", "b", "\U0001F600"][k % 4], len(t) if t else None, 7, "s", 3, "g")
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1, 15)] + [(None, 1, 1), (2, 1, None)],
                                 "doc_id long, quality int, toxic int")


def test_pieces_agree_with_the_library(docs, odd_rows):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encoded(docs, most=20).collect()
    want = Counter((i, tuple(sp.encode(t or ""))) for i, t, *_ in odd_rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["round_trip"] for r in got)
    tokens = pieces.encoded(docs).select("doc_id", "ids")
    # Runs of blanks, blanks at the ends and marks go another way than plain words.
    texts = ["a b ", " lead", "two  blanks", "mark ▁ inside", "x ▁", "new\nline\ttab end", "é 🙂", " ", "\ufffd a"]
    frame = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encoded(frame, most=2).collect():
        text = texts[r["doc_id"]]
        assert list(r["ids"]) == sp.encode(text) and r["round_trip"] == ("▁" not in text)
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decoded(tokens).collect())
    assert back == Counter((i, t or "") for i, t, *_ in odd_rows)


def test_unigram_lattice_is_viterbi(spark):
    model = pieces.Pieces(pieces.UNIGRAM, {"▁a": (-1.0, 1), "b": (-2.0, 2), "ab": (-1.5, 3), "▁": (-2.5, 4), "a": (-3.0, 5),
                                           "ba": (-1.0, 6)}, [], 0, [b""] * 7)
    words = ["▁ab", "abab", "▁aba", "bzb", "b"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: list(r["ids"]) for r in pieces.folded(pieces.lattice(frame, model), model).collect()}
    assert got == {w: model.encode_word(w) for w in words}


def test_long_words_and_marks():
    model = pieces.load()
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    for text in ["a" * 500 + " " * 90 + "b", "日本語 🙂 12345", "tabs\t\tand\n\nlines", "<s> <0x41> \x00"]:
        assert [x for w in model.split(text) for x in model.encode_word(w)] == sp.encode(text)


def test_maximal_segments_match_definition():
    r = random.Random(5)
    for _ in range(200):
        s = np.array([r.choice([-2, -1, -0.5, 1, 2, 3]) for _ in range(r.randint(1, 14))])
        found = toxicity.maximal_segments(s)

        def split(lo, hi, s=s):
            sums = [(-float(s[a:b].sum()), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            best = min(sums, default=None, key=lambda x: (x[0], x[2] - x[1], x[1]))
            if best is None or best[0] >= 0:
                return []
            _, a, b = best
            return split(lo, a) + [(a, b)] + split(b, hi)

        total = lambda spans, s=s: sorted(round(float(s[a:b].sum()), 6) for a, b in spans)
        assert total([(a, b) for a, b, _ in found]) == total(split(0, len(s)))


def test_toxicity_learns_and_leaves_held_out_alone(spark):
    rows = [(i, prose(i, 60) + (" vile rotten" * 3 if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, lab).collect()}
    unseen = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in unseen)


def test_toxicity_does_not_depend_on_the_layout(spark):
    rows = []
    for i in range(300):
        text = prose(i // 3, 40)  # groups of three share most of their words
        rows.append((i, text + (" vile rotten" * (i % 4) if i % 5 == 1 else f" word{i}"), int(i % 5 == 1)))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    runs = [sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(d.repartition(n), lab.repartition(n)).collect())
            for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]


def test_toxicity_of_odd_rows(docs, empty, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(r["score"] < 1e-9 for r in none)


def brute_repeats(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        if i is not None:
            for s in range(len(b) - 49):
                first[b[s:s + 50]] = min(i, first.get(b[s:s + 50], i))
    out = []
    for i, b in texts:
        hit = np.zeros(len(b), bool)
        if i is not None:
            for s in range(len(b) - 49):
                if first[b[s:s + 50]] < i:
                    hit[s:s + 50] = True
        runs = int((np.diff(np.concatenate([[False], hit]).astype(int)) == 1).sum())
        out.append((i, len(b), int(hit.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats(docs, empty, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = repeats.without_repeats(docs).select(
        "doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(odd_rows)
    assert repeats.without_repeats(empty).count() == 0


def test_induced_order_finds_equal_windows():
    r = random.Random(3)
    raws = [bytes(r.choice(b"ab") for _ in range(84)) for _ in range(60)]
    raws += [raws[0][:60] + bytes(24), raws[1][:50] + raws[0][50:], raws[0]]
    doc_ids = np.array(r.sample(range(1000), len(raws)))
    mask = repeats.earlier_windows(doc_ids, np.full(len(raws), 34), raws)
    for i, raw in enumerate(raws):
        for j in range(repeats.STARTS):
            want = any(o[j:j + 50] == raw[j:j + 50] and d < doc_ids[i] for o, d in zip(raws, doc_ids, strict=True))
            assert bool(mask[i] >> j & 1) == want


def brute_products(rows, k, every, scale=1024):
    ok = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in ok}):
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_top_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    r = np.random.default_rng(1)
    rows = [(i, (r.integers(-3, 4, 8) / 4).tolist()) for i in range(150)]
    rows += [(200, None), (201, [None] * 8), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (None, [1.0] * 8), (204, []),
             (5, rows[5][1]), (7, rows[7][1]), (7, rows[7][1]), (205, [1.0, 0.5]), (206, [0.0] * 8)]
    e = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, q long").repartition(3)
    got = topk.top_products(e, k=10, every=5)
    assert sorted(tuple(x) for x in got.collect()) == brute_products(rows, 10, 5)
    assert topk.top_products(e.where("vec_id < 0")).count() == 0


def test_shards_are_minimax(spark, docs, empty, odd_rows):
    for n in (1, 3, 8):
        got = shards.shard_documents(docs, n).collect()
        assert len(got) == len(odd_rows)
        groups = {}
        for r in got:
            groups.setdefault(r["digest"], [0, set()])
            groups[r["digest"]][0] += r["size"]
            groups[r["digest"]][1].add(r["shard"])
        assert all(len(g[1]) == 1 for g in groups.values())
        sizes = [groups[k][0] for k in sorted(groups)]

        def fits(cap, sizes=sizes, n=n):
            used, room = 1, cap
            for s in sizes:
                if s > cap:
                    return False
                if s > room:
                    used, room = used + 1, cap
                room -= s
            return used <= n

        best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
        load = Counter()
        for r in got:
            load[r["shard"]] += r["size"]
        assert max(load.values()) == best
        for s in load:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert shards.shard_documents(empty).count() == 0


def test_near_vectors(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i] + 0.05 * r.standard_normal(16)).tolist()) for i in range(20)]
    rows += [(200 + i, (base[0] + 0.1 * r.standard_normal(16)).tolist()) for i in range(60)]
    rows += [(300, base[3].tolist()), (301, (2 * base[3]).tolist()), (302, [0.0] * 16), (303, None), (304, [None] * 16),
             (305, [float("nan")] * 16), (None, base[4].tolist())]
    e = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, node int")
    got = {x["vec_id"]: x for x in neighbours.near_duplicates(e.repartition(3)).collect()}
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v) and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in ok])
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in ok]
    for i, row in zip(ids, near, strict=True):
        assert got[i]["n_links"] == row.sum(), i
    reach = np.linalg.matrix_power((near | np.eye(len(ids), dtype=bool)).astype(float), 16) > 0
    for i, row in zip(ids, reach, strict=True):
        assert got[i]["component_id"] == min(x for x, t in zip(ids, row, strict=True) if t)
    assert got[302]["n_links"] == 0 and got[303]["kept"] and got[None]["component_id"] is None
    assert neighbours.near_duplicates(e.limit(0)).count() == 0


@pytest.fixture(scope="module")
def lopsided(spark):
    """One group of 500 near copies, 150 pairs of cosine 0.90 to 0.93 and 700 others."""
    rng = np.random.default_rng(11)

    def unit(m):
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    group = unit(unit(rng.standard_normal((1, 64))) + 0.02 * rng.standard_normal((500, 64)))
    left, noise = unit(rng.standard_normal((150, 64))), rng.standard_normal((150, 64))
    noise = unit(noise - (noise * left).sum(axis=1, keepdims=True) * left)
    c = rng.uniform(0.901, 0.93, (150, 1))
    rows = np.concatenate([group, left, c * left + np.sqrt(1 - c * c) * noise, unit(rng.standard_normal((700, 64)))])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")


def pairs_found(frame):
    got = {x["vec_id"]: x for x in neighbours.near_duplicates(frame).collect()}
    assert all(got[i]["n_links"] == 499 for i in range(500))
    return sum(got[500 + i]["component_id"] == got[650 + i]["component_id"] for i in range(150))


def test_near_pairs_beside_a_large_group(lopsided, monkeypatch):
    for name, value in (("TABLES", 2), ("BUCKET", 8), ("DESCENTS", 2), ("AUDIT", 100)):
        monkeypatch.setattr(neighbours, name, value)
    assert pairs_found(lopsided) >= 0.9 * 150


@pytest.mark.parametrize("most", [1, 512])
def test_longest_lists_are_audited(lopsided, monkeypatch, most):
    for name, value in (("TABLES", 1), ("BUCKET", 8), ("DESCENTS", 1), ("AUDIT", 30), ("LIST", 10), ("LONGEST_LIST", 10),
                        ("MOST_TABLES", most)):
        monkeypatch.setattr(neighbours, name, value, raising=name != "MOST_TABLES")
    if most == 1:
        with pytest.raises(RuntimeError, match="recall of links"):
            neighbours.near_duplicates(lopsided)
    else:
        assert pairs_found(lopsided) >= 0.85 * 150


def test_hypergeometric_draws(spark):
    n, k, d = 60, 25, 20
    x = mixing.hypergeometric(*(F.lit(v).cast("long") for v in (n, k, d)), mixing.uniform(F.xxhash64("id")))
    draws = np.array([r[0] for r in spark.range(3000).select(x).collect()])
    assert abs(draws.mean() - d * k / n) < 0.15 and draws.min() >= 0 and draws.max() <= 20
    counts = mixing.drawn_before(F.col("id"), F.lit(500).cast("long"), F.lit(200).cast("long"), F.lit(3).cast("long"))
    below = [r[0] for r in spark.range(501).select("id", counts.alias("c")).orderBy("id").select("c").collect()]
    assert below[0] == 0 and below[-1] == 200 and set(np.diff(below)) <= {0, 1}


def plain_targets(sizes):
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2 * sizes[s]]
        if not full:
            out |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mix_meets_targets(spark, docs, empty):
    rows = [(i, prose(i, 1 + i % 37), f"s{i % 7}" if i % 11 else None) for i in range(900)] + [(5, prose(5, 6), "s5")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        assert len(r["shards"]) == r["copies"] and all(0 <= s < 8 for s in r["shards"])
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in want)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(5)).where("doc_id != 5").collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got if r["doc_id"] != 5}
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(empty).count() == 0


def brute_classes(rows, n, num, den):
    cache = {}
    sets = [(i, set(jaccard.gram_set(t, n, cache).tolist())) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, sa in sets:
        for b, sb in sets:
            if a is not None and b is not None and a < b and sa and sb and den * len(sa & sb) >= num * len(sa | sb):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("common", [jaccard.COMMON, 2])
def test_ngram_classes(spark, docs, empty, odd_rows, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    got = sorted((tuple(r) for r in jaccard.similarity_classes(docs).collect()), key=str)
    assert got == brute_classes(odd_rows, 4, 85, 100)
    family = prose(50, 80).split()
    rows = []
    for i in range(60):
        r = random.Random(i)
        words = list(family)
        for _ in range(r.randint(0, 2)):
            words[r.randrange(80)] = r.choice(WORDS)
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.similarity_classes(d).collect()), key=str) == brute_classes(rows, 4, 85, 100)
    assert jaccard.similarity_classes(empty).count() == 0
    # Every text of a repeated id is joined; a row without words is linked with nothing.
    twice = [(5, prose(1, 40)), (5, prose(2, 40)), (6, prose(2, 40)), (7, prose(1, 40)), (8, ""), (9, prose(3, 40))]
    d = spark.createDataFrame(twice, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.similarity_classes(d).collect()}
    assert got == {(5, 5), (6, 5), (7, 5), (8, 8), (9, 9)}


@pytest.mark.parametrize("cell", [jaccard.CELL, 3])
def test_families_without_links_meet_in_cells(spark, monkeypatch, cell):
    for name, value in (("COMMON", 3), ("BLOCK", 16), ("CELL", cell), ("ROUNDS", 1), ("GROUP", 4), ("SMALL", 1)):
        monkeypatch.setattr(jaccard, name, value)
    passage = prose(70, 60)
    rows = []
    for i in range(90):
        words = (passage + " " + prose(100 + i // 3, 25)).split()
        r = random.Random(i)
        for _ in range(i % 3):
            words[r.randrange(len(words))] = "new" + str(i)
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.similarity_classes(d).collect()), key=str) == brute_classes(rows, 4, 85, 100)


def test_quality(spark, docs, empty):
    rows = [(i, ". ".join(prose(i * 7 + k, 12).capitalize() for k in range(12)) + ".") for i in range(150)]
    rows += [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 100).split())) for i in range(40)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["keep"] for i in range(150)) and not any(got[1000 + i]["keep"] for i in range(40))
    odd = quality.quality(docs).collect()
    assert len(odd) == docs.count() and all(r["score"] == 0 for r in odd if r["doc_id"] in (4, 5, 6))
    assert quality.quality(empty).count() == 0


def test_language(spark, docs, empty):
    alphabet = {"en": "the and of ing", "de": "der und sch ung", "fr": "les des eau que"}
    rows = []
    for i in range(300):
        lang = list(alphabet)[i % 3]
        r = random.Random(i)
        rows.append((i, " ".join("".join(r.choices(alphabet[lang].split(), k=2)) for _ in range(30)), lang))
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (1002, "THE ANDOF", None)]
    got = {r["doc_id"]: r for r in language.languages(
        spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, lang) for i, _, lang in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] == "en"
    assert language.languages(docs).count() == docs.count() and language.languages(empty).count() == 0
    unlabelled = language.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200, x) for x in range(201, 260)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for pair in links for x in pair}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: y for x, y in root.items() if any(a != b and x in (a, b) for a, b in links)}


def test_pipeline_stages_on_odd_rows(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (docs, empty):
        rows = start.select(*columns)
        for name, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.keep(stage(spark, rows, str(tmp_path)), f"test-{name}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert rows.columns == columns
            if name == "ngram_jaccard" and start is docs:
                ids = sorted(r[0] for r in rows.select("doc_id").where("doc_id is not null").collect())
                assert ids == sorted(set(ids)) and 3 not in ids and 5 in ids


def test_pipeline_keeps_texts_of_repeated_ids_and_replacement_characters(spark):
    shared = prose(1, 30)
    rows = [(1, prose(2, 40)), (1, prose(3, 40)), (1, prose(3, 40)), (2, prose(2, 40)), (3, prose(3, 40)), (None, prose(2, 40)),
            (4, None), (5, ""), (5, None)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, d, "").collect())
    assert got == Counter({rows[0], rows[1], rows[5], rows[6], rows[7], rows[8]})
    rows = [(1, shared), (2, "a\ufffdb " + shared + " \ufffd end"), (3, "é" * 60), (4, "x" + "é" * 60 + "y")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], d.schema)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, d, "").collect()}
    assert got[2].startswith("a\ufffdb") and got[2].endswith("\ufffd end") and len(got[2]) < 20
    assert got[1] == shared and got[4] == "xy"


def test_registered_queries():
    assert [q for q in queries.C.queries if q.startswith("op")] and set(corpus_pipeline.C.queries) == {"pipeline"}
    assert len({q.split("_")[0] for q in queries.C.queries}) == 13


def test_links_that_are_stars_cost_one_round(spark, monkeypatch):
    """Two tables are written and no job besides; chains and empty tables end with the same roots as before."""
    written, plain = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df, label: written.append(label) or plain(df, label))
    stars = spark.createDataFrame([(2, 1), (1, 3), (9, 8), (5, 5)], "a long, b long")
    got = graph.components(stars)
    assert len(written) == 2
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], stars.schema)
    assert sorted(map(tuple, graph.components(chain).collect())) == [(i, 0) for i in range(41)]
    assert graph.components(stars.limit(0)).count() == 0


def test_rounds_over_few_links_cost_no_shuffle(spark, monkeypatch):
    """Chains, stars and links to oneself; the same components whether rounds are shuffled or not."""
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(5, 5), (3, 4), (4, 3)]
    plain, plans = graph.keep, []

    def keep(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(graph, "keep", keep)
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    few = sorted(map(tuple, graph.components(df).collect()))
    assert len(plans) > 2 and not any("Exchange" in p for p in plans[1:])
    monkeypatch.setattr(graph, "FEW", 10)
    assert sorted(map(tuple, graph.components(df).collect())) == few
    assert dict(few) == {**{i: 100 for i in range(100, 141)}, 7: 7, **{i: 7 for i in range(20, 60)}, 3: 3, 4: 3}
