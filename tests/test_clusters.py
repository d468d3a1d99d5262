import random

from pyspark.sql import functions as F

import models
from faultline.operators import errors, incidents, trends
from faultline.sources import logs


def entries(spark, rows):
    """rows: (namespace, ord, text)"""
    return spark.createDataFrame([(n, "a/b.log", o, t) for n, o, t in rows], "namespace string, source_file string, ord long, text string")


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


def random_log(seed, size=60):
    rng = random.Random(seed)
    pool = ["disk", "full", "node", "lost", "peer", "sync", "late", "hot"]
    types = ["IoError", "DiskIoError", "NetError", "BigDiskIoErrorX", "LostFault", "LostFaultError"]
    rows = []
    for i in range(size):
        kind = rng.random()
        if kind < 0.5:
            text = "WARNING " + words(rng, rng.randint(2, 5), pool)
        elif kind < 0.8:
            text = f"FATAL {rng.choice(types)}: {words(rng, 2, pool)}"
        else:
            text = f"CRITICAL {words(rng, 3, pool)}\n  at a.B{rng.randint(0, 2)}.run(X)\n  at c.D{rng.randint(0, 2)}.go(Y)"
        rows.append((f"n{i % 2}", i, text))
    return rows


def test_leader_merge_equals_one_by_one_walk(spark):
    for seed in range(2):
        rows = random_log(seed, 40)
        facts = errors.signature_facts(errors.error_entries(entries(spark, rows)))
        groups = errors.signature_groups(facts).collect()
        frames = {}
        for r in errors.signature_frames(facts).collect():
            frames.setdefault((r.namespace, r.signature), set()).add(r.frame)
        # A batch of five forces many rounds; the result must not depend on the batch.
        for batch in (5, 1024):
            got = {(r.namespace, r.signature): r.leader for r in errors.leader_merge(errors.cut(facts), batch).collect()}
            for ns in ("n0", "n1"):
                ordered = [g for g in sorted(groups, key=lambda g: g.pos) if g.namespace == ns]
                pos = {g.signature: g.pos for g in ordered}
                want = models.leaders([g.signature for g in ordered], {g.signature: frames.get((ns, g.signature), set()) for g in ordered})
                assert {s: l for (n, s), l in got.items() if n == ns} == {s: pos[l] for s, l in want.items()}


def test_leader_merge_of_ten_thousand_open_signatures(spark, monkeypatch):
    """Signatures of one namespace that are hardly similar take as few tables as a handful of them; each word is shared by few."""
    rng = random.Random(9)
    names = [f"w{i}q" for i in range(4000)]
    rows = [("one", i, "ERROR " + " ".join(rng.choice(names) for _ in range(5))) for i in range(10_000)]
    facts = errors.cut(errors.signature_facts(errors.error_entries(entries(spark, rows))))
    tables, plain = [], errors.cut
    monkeypatch.setattr(errors, "cut", lambda df, label="cut": tables.append(label) or plain(df, label))
    got = {r.signature: r.leader for r in errors.leader_merge(facts).collect()}
    assert len(got) > 9900 and len(tables) <= 2 + 5 * 3
    ordered = sorted(((r.pos, r.signature) for r in errors.signature_groups(facts).collect()))
    words = {s: frozenset(s[4:].split()) for _, s in ordered}
    by_word: dict[str, list] = {}
    want = {}
    for pos, s in ordered:  # the one-by-one walk; only leaders that share a word can be similar
        near = {led for w in words[s] for led in by_word.get(w, ())}
        mine = min((p for p, t in near if len(words[s] & words[t]) / len(words[s] | words[t]) >= 0.5), default=None)
        want[s] = pos if mine is None else mine
        if mine is None:
            for w in words[s]:
                by_word.setdefault(w, []).append((pos, s))
    assert got == want


def test_cluster_profile_of_known_entries(spark):
    rows = [
        ("p", 1, "2024-01-01 10:00:00 ERROR PayError: card 12345 refused in charge\n  at pay.Card.run(Card.java:3)\n  at pay.Http.post(Http.java:9)"),
        ("p", 2, "2024-01-01 10:01:00 ERROR PayError: card 99999 refused in charge\n  at pay.Card.run(Card.java:3)\n  at pay.Http.post(Http.java:9)"),
        ("p", 3, "2024-01-01 10:02:00 INFO fine"),
        ("p", 4, "2024-01-01 10:03:00 WARNING queue slow"),
    ]
    log = entries(spark, rows)
    profile = {r.exception_type: r for r in errors.cluster_profile(errors.cluster_errors(log)).collect()}
    pay = profile["PayError"]
    assert pay["count"] == 2 and pay.severity == "error" and pay.error_signature == "PayError"
    assert pay.sample_messages == ["2024-01-01 10:00:00 ERROR PayError: card 12345 refused in charge"]
    assert "at pay.card.run(" in pay.stack_frames and pay.related_files == ["Card.java", "Http.java", "b.log"]
    assert {"charge", "run", "post"} <= set(pay.related_functions)
    report = errors.cluster_report(log, errors.cluster_core(errors.cluster_errors(log))).collect()[0]
    assert (report.total_entries, report.cluster_count, report.unclustered_count, report.dominant_count) == (4, 2, 1, 2)


def test_hot_signature_keeps_all_rows(spark):
    rows = [("h", i, "ERROR HotError: same") for i in range(3000)] + [("h", 5000 + i, f"ERROR rare thing {i} one two") for i in range(20)]
    core = errors.cluster_core(errors.cluster_errors(entries(spark, rows))).collect()
    assert sorted(r["count"] for r in core)[-1] == 3000 and sum(r["count"] for r in core) == 3020


def test_incident_merge_equals_repeated_merging(spark):
    for seed in range(2):
        rng = random.Random(seed)
        vocabulary = [f"w{i}" for i in range(14)]
        items, rows = {}, []
        for s in range(25):
            w = set(rng.sample(vocabulary, rng.randint(1, 3)))
            f = {"f%d" % rng.randint(0, 40)} if rng.random() < 0.3 else set()
            items[s] = (w, f)
            rows += [("n", s, "k:" + x) for x in w] + [("n", s, "f:" + x) for x in f]
        df = spark.createDataFrame(rows, "namespace string, session long, item string")
        for hot in (64, 1):  # 1 sends every shared word through the common-word rule
            old, incidents.HOT = incidents.HOT, hot
            got = {}
            for r in incidents.merge_incidents(df).collect():
                got.setdefault(r.inc, set()).add(r.session)
            incidents.HOT = old
            assert {frozenset(g) for g in got.values()} == models.merge_sets(items)


def test_sessions_split_above_five_minutes(spark):
    rng = random.Random(5)
    times, t = [], 0
    for _ in range(200):
        t += rng.choice([1, 60, 299, 300, 301, 4000, 9000])
        times.append(t)
    rows = [("n", i, f"{'2024-02-%02d %02d:%02d:%02d' % (1 + x // 86400, x % 86400 // 3600, x % 3600 // 60, x % 60)} INFO x") for i, x in enumerate(times)]
    got = [r.session for r in incidents.time_sessions(entries(spark, rows)).orderBy("sec").collect()]
    want, s = [], 1
    for i, x in enumerate(times):
        s += bool(i) and x - times[i - 1] > 300
        want.append(s)
    assert got == want


def test_trend_labels(spark):
    ref = F.lit("2024-01-15 12:00:00").cast("timestamp")
    cases = {
        "spike": ["2024-01-13 12:00:00"] * 2 + ["2024-01-15 11:30:00"] * 4,
        "new": ["2024-01-15 01:00:00", "2024-01-15 05:00:00"],
        "regression": ["2024-01-10 01:00:00", "2024-01-15 05:00:00"],
        "declining": [f"2024-01-14 {h:02d}:00:00" for h in range(0, 11)] + ["2024-01-14 13:00:00"],
        "stable": ["2024-01-01 01:00:00"],
    }
    rows, n = [], 0
    for kind, times in cases.items():
        for t in times:
            rows.append(("t", n, f"{t} ERROR {kind.title()}Error: x"))
            n += 1
    log = entries(spark, rows)
    core = errors.cluster_core(errors.cluster_errors(log))
    found = trends.cluster_trends(core, log, ref).join(core.select("namespace", "cluster_id", "exception_type"), ["namespace", "cluster_id"])
    labels = {r.exception_type: r.trend_label for r in found.collect()}
    assert labels == {f"{k.title()}Error": k for k in cases}


def test_untimed_clusters_fall_back_then_unknown(spark):
    rows = [("u", 1, "ERROR LoneError: a"), ("u", 2, "2024-01-15 11:00:00 ERROR MyLoneErrorX: b"), ("u", 3, "WARNING nothing timed here")]
    log = entries(spark, rows)
    core = errors.cluster_core(errors.cluster_errors(log, merge=False))
    got = {r.cluster_id: r.trend_label for r in trends.cluster_trends(core, log, F.lit("2024-01-15 12:00:00").cast("timestamp")).collect()}
    assert got == {1: "new", 2: "new", 3: "unknown"}


def random_lines(rng, n=700, before=0):
    opens = "2024-05-05 10:00:00 ERROR start"
    lines = [opens if rng.random() < 0.02 else f"  detail line number {rng.randint(0, 9)} é" for _ in range(n)]
    return ["no opener at all in this file"] * before + lines


def kept_entries(lines):
    """(first, last, text) of the one-by-one walk, trimmed, at least 60 characters."""
    blocks = models.entry_blocks(lines, lambda x: x.startswith("2024"), 80)
    texts = [(a, b, "\n".join(lines[a - 1:b]).strip()) for a, b in blocks]
    return sorted(t for t in texts if len(t[2]) >= 60)


def test_entry_cap_equals_line_walk(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(logs, "LINES_PER_BLOCK", 50)
    for before in (0, 200):
        lines = random_lines(rng, before=before)
        df = spark.createDataFrame([("n", "x.log", "\n".join(lines))], "namespace string, source_file string, text string")
        got = sorted((r.line_start, r.line_end, r.text) for r in logs.log_entries(logs.number_lines(df)).collect())
        assert got == kept_entries(lines)


def test_log_folder_read_in_byte_ranges(spark, tmp_path):
    """Ranges end anywhere: inside lines, characters and entries. Entries equal those of whole files, in order."""
    rng = random.Random(4)
    files = {"a b+c.log": random_lines(rng), "sub/x.out": random_lines(rng, 300, 200), "bare.txt": ["plain words without any opening line here"] * 100,
             "empty.err": [], "skip.md": random_lines(rng, 50)}
    files["sparse.log"] = [""] * 60 + ["x"] * 40 + [""] * 40
    for name, lines in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes("".join(f"{x}\n" for x in lines).encode() + (b"\xff bad bytes\r\n" if name == "bare.txt" else b""))
    files["bare.txt"] = files["bare.txt"] + ["\ufffd bad bytes"]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = logs.read_log_lines(spark, str(tmp_path), "n")
        assert lines.select("source_file", "split").distinct().count() > 20
        rows = logs.log_dir_chunks(lines).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        got.setdefault(r.source_file.split(tmp_path.name + "/")[1], []).append((r.line_start, r.line_end, r.text))
    assert len({r["ord"] for r in rows}) == len(rows) and list(got) == sorted(got) and set(got) == {"a b+c.log", "sub/x.out", "bare.txt", "sparse.log"}
    for name in ("a b+c.log", "sub/x.out", "bare.txt"):
        assert got[name] == kept_entries(files[name])
    assert [g[:2] for g in got["sparse.log"]] == [(65, 104)]


def test_clusters_of_a_log_folder(spark, tmp_path):
    """From files to clusters: what is read back is analysed as it is."""
    text = "2024-01-0{0} 10:00:00 ERROR ValueError: the value {0} is out of every range that is allowed here\n"
    (tmp_path / "a.log").write_text("".join(text.format(i) for i in range(1, 6)))
    log = logs.log_dir_chunks(logs.read_log_lines(spark, str(tmp_path), "n"))
    core = errors.cluster_core(errors.cluster_errors(log)).collect()
    assert [(r["count"], r.exception_type) for r in core] == [(5, "ValueError")]


def test_small_log_and_fallback(spark):
    log = "\n".join([
        "2024-03-01T09:00:00Z INFO booted",
        "2024-03-01T09:00:05Z ERROR TypeError: value is not subscriptable here",
        '  File "src/a.py", line 3, in load',
        "[2024-03-01 09:00:07] WARNING connection timeout: db:5432 after 30000ms retry",
        "warn short", "1709283600000 something with an epoch stamp that is long enough to keep"])
    windows = "\n".join(["a"] * 70 + ["some words that make a window long enough"] * 1 + ["b"] * 8 + ["more words for the next eighty"])
    df = spark.createDataFrame([("n", "x.log", log), ("n", "y.out", windows)], "namespace string, source_file string, text string")
    got = {(r.source_file, r.line_start): r for r in logs.log_chunks(logs.number_lines(df)).collect()}
    assert got["x.log", 2].severity == "error" and got["x.log", 2].line_end == 3
    assert got["x.log", 4].severity == "warning" and ("x.log", 1) not in got and ("x.log", 6) in got
    assert str(got["x.log", 4].detected_timestamp) == "2024-03-01 09:00:07"
