"""Source files to code units and chunks.

Files are at most 512 KiB, so one file is a bounded group. Block ends come from windows and equi
joins over the numbered lines of a file; texts are then cut per file row from its line array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.functions.groups import first_n
from faultline.session import cut
from faultline.sources.chunks import line_windows, window_structs

NS = "namespace"
FILE = [NS, "source_file"]
BRACE_LANGS = [lang for langs, _, _, _ in V.UNIT_PATTERNS for lang in langs
               if lang not in V.INDENT_LANGS + V.END_LANGS]
UNIT_LANGS = sorted({lang for langs, _, _, _ in V.UNIT_PATTERNS for lang in langs})
UNIT = ("struct<kind:string,name:string,class_name:string,start:bigint,end:bigint,head:bigint,comment_from:bigint,"
        "doc_from:bigint,doc_to:bigint>")


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", T.detect_language(F.col("source_file")))


# ---- lines ------------------------------------------------------------------------------


def code_lines(files: DataFrame) -> DataFrame:
    """Numbered lines with what the block rules look at; files partitioned by path."""
    rows = files.where(F.col("language").isin(UNIT_LANGS)).select(
        *FILE, "language", F.posexplode(T.lines_of(F.col("text"))).alias("_p", "text"))
    trimmed = T.strip(F.col("text"))
    rows = rows.select(*FILE, "language", (F.col("_p") + 1).cast("bigint").alias("line_no"), "text", trimmed.alias("trimmed"))
    return rows.withColumn("blank", F.col("trimmed") == "").withColumn(
        "indent", F.length("text") - F.length(F.ltrim("text", F.lit(T.WHITESPACE))))


def _above(lines: DataFrame) -> DataFrame:
    """Per line, from the lines above it: decorators, comment block and doc block."""
    w = Window.partitionBy(*FILE).orderBy("line_no")
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    t, n = F.col("trimmed"), F.col("line_no")
    at = F.when(t.startswith("@"), 1).otherwise(0)
    mark = F.when(F.col("language") == "go", "//").otherwise("#")
    is_comment = F.startswith(t, mark)
    x = lines.withColumn("_comment", is_comment).withColumn("_at", at)
    x = x.withColumn("_before", F.lag("_comment", 1, False).over(w)).withColumn("_ats", F.sum("_at").over(w))
    stops_deco = ~F.col("blank") & (F.col("_at") == 0)
    stops_comment = (~F.col("blank") & ~F.col("_comment")) | (F.col("blank") & ~F.col("_before"))
    return x.select(
        *lines.columns,
        (F.coalesce(F.sum("_at").over(above), F.lit(0))
         - F.coalesce(F.max(F.when(stops_deco, F.col("_ats"))).over(above), F.lit(0))).alias("decorators"),
        (F.coalesce(F.max(F.when(stops_comment, n)).over(above), F.lit(0)) + 1).alias("comment_from"),
        F.last(F.when(~F.col("blank"), F.struct(n.alias("n"), t.endswith("*/").alias("closed"))), True).over(above).alias("_shut"),
        F.max(F.when(F.col("text").contains("/**"), n)).over(above).alias("_open"))


def unit_starts(lines: DataFrame) -> DataFrame:
    """Definition lines: kind, name and the line's own columns (a line may open more than one unit).

    A definition spread over several lines starts at its first line that is not blank.
    """
    options = F.array(*[
        F.when(F.col("language").isin(langs) & F.col("text").rlike(pattern),
               F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", pattern, group).alias("name")))
        for langs, kind, pattern, group in V.UNIT_PATTERNS])
    hits = lines.withColumn("_u", F.explode(F.filter(options, lambda u: u.isNotNull())))
    hits = hits.select("*", "_u.kind", "_u.name").drop("_u")
    spread = lines.join(_spread_starts(lines), [*FILE, "line_no"])
    return hits.unionByName(spread)


def _spread_starts(lines: DataFrame) -> DataFrame:
    """(file, line_no, kind, name) of definitions that the whole text of a file holds and none of their lines alone."""
    mark = "\u0001"
    item = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    whole = lines.groupBy(*FILE, "language").agg(item.alias("_l")).select(*FILE, "language", F.translate(
        F.array_join(F.transform("_l", lambda x: x["text"]), "\n"), mark, "\u0002").alias("_t"))

    def matches(kind: str, pattern: str, group: int) -> Column:
        """Per match: the text from the match before to it, its own text and its name."""
        p = "(?md)" + pattern
        gaps = F.split(F.regexp_replace("_t", p, mark + "$0"), mark, -1)
        found = F.regexp_extract_all("_t", F.lit(p), F.lit(0))
        names = F.regexp_extract_all("_t", F.lit(p), F.lit(group))
        return F.struct(F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern"), F.transform(
            found, lambda m, i: F.struct(
                _newlines(F.get(gaps, i)).alias("gap"), m.alias("m"), F.get(names, i).alias("name"),
                F.exists(F.split(m, "\n", -1), lambda x: x.rlike(pattern)).alias("alone"))).alias("found"))

    options = F.array(*[F.when(F.col("language").isin(langs), matches(kind, pattern, group))
                        for langs, kind, pattern, group in V.UNIT_PATTERNS])
    each = whole.select(*FILE, F.explode(F.filter(options, lambda o: o.isNotNull())).alias("o"))
    each = each.select(*FILE, "o.kind", "o.pattern", F.posexplode("o.found").alias("_i", "f"))
    before = Window.partitionBy(*FILE, "pattern").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    blank = _newlines(F.regexp_extract("f.m", r"^\s*", 0))
    each = each.withColumn("line_no", (F.sum("f.gap").over(before) + blank + 1).cast("bigint"))
    return each.where(~F.col("f.alone")).select(*FILE, "line_no", "kind", "f.name")


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


# ---- block ends -------------------------------------------------------------------------


def indent_ends(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, line_no, end): the block ends before the first later line indented no deeper.

    Such a line is either the next line or indented less than the line before it, so only those
    (few) lines meet the starts.
    """
    solid = lines.where(F.col("language").isin(V.INDENT_LANGS) & ~F.col("blank"))
    w = Window.partitionBy(*FILE).orderBy("line_no")
    solid = solid.select(*FILE, "line_no", "indent", F.lag("indent").over(w).alias("_prev"), F.lag("line_no").over(w).alias("_before"),
                         F.lead("indent").over(w).alias("_next"), F.max("line_no").over(Window.partitionBy(*FILE)).alias("_last"))
    own = starts.where(F.col("language").isin(V.INDENT_LANGS)).select(*FILE, "line_no").distinct()
    s = own.join(solid.select(*FILE, "line_no", "indent", "_next", "_last"), [*FILE, "line_no"])
    d = solid.where(F.col("indent") < F.col("_prev")).select(*FILE, F.col("line_no").alias("_d"), F.col("indent").alias("_di"), "_before")
    met = s.join(d, FILE, "left").groupBy(*FILE, "line_no", "indent", "_next", "_last").agg(
        F.min(F.when((F.col("_d") > F.col("line_no")) & (F.col("_di") <= F.col("indent")),
                     F.struct(F.col("_d"), F.col("_before")))).alias("_stop"))
    end = F.when(F.col("_next") <= F.col("indent"), F.col("line_no")).otherwise(F.coalesce("_stop._before", "_last"))
    return met.select(*FILE, "line_no", end.alias("end"))


def brace_ends(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, line_no, end): line where the first block opened at or after the start closes, else the last line."""
    mine = lines.where(F.col("language").isin(BRACE_LANGS))
    marks = mine.select(*FILE, "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(r"[{}]"), F.lit(0))).alias("_p", "_c"))
    w = Window.partitionBy(*FILE).orderBy("line_no", "_p")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("_c") == "{", 1).otherwise(-1)
    marks = marks.withColumn("_depth", F.sum(step).over(run)).withColumn("_seq", F.row_number().over(w))
    per_line = marks.groupBy(*FILE, "line_no").agg(
        F.sum(step).alias("_net"), F.min(F.when(F.col("_c") == "{", F.col("_seq"))).alias("_first"))
    lw = Window.partitionBy(*FILE).orderBy("line_no")
    known = mine.select(*FILE, "line_no").join(per_line, [*FILE, "line_no"], "left").select(
        *FILE, "line_no",
        F.coalesce(F.sum("_net").over(lw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.first("_first", True).over(lw.rowsBetween(0, Window.unboundedFollowing)).alias("_opened"),
        F.max("line_no").over(Window.partitionBy(*FILE)).alias("_last"))
    own = starts.where(F.col("language").isin(BRACE_LANGS)).select(*FILE, "line_no").distinct()
    s = own.join(known, [*FILE, "line_no"])
    closes = marks.where(F.col("_c") == "}").select(*FILE, F.col("line_no").alias("_line"), F.col("_depth").alias("_base"), "_seq")
    met = s.join(closes, [*FILE, "_base"], "left").groupBy(*FILE, "line_no", "_last").agg(
        F.min(F.when(F.col("_seq") > F.col("_opened"), F.col("_line"))).alias("_end"))
    return met.select(*FILE, "line_no", F.coalesce("_end", "_last").alias("end"))


def end_blocks(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, line_no, end) for languages closing with 'end'; openers and 'end' lines are counted."""
    mine = lines.where(F.col("language").isin(V.END_LANGS))
    t = F.col("trimmed")
    step = F.when(t.startswith("#"), 0).when(t.rlike(V.RUBY_OPEN), 1).when(t == "end", -1).otherwise(0)
    w = Window.partitionBy(*FILE).orderBy("line_no")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = mine.select(*FILE, "line_no", (t == "end").alias("_end"), F.sum(step).over(run).alias("_depth"),
                    F.max("line_no").over(Window.partitionBy(*FILE)).alias("_last"))
    own = starts.where(F.col("language").isin(V.END_LANGS)).select(*FILE, "line_no").distinct()
    s = own.join(x.select(*FILE, "line_no", (F.col("_depth") - 1).alias("_depth"), "_last"), [*FILE, "line_no"])
    e = x.where("_end").select(*FILE, F.col("line_no").alias("_line"), "_depth")
    met = s.join(e, [*FILE, "_depth"], "left").groupBy(*FILE, "line_no", "_last").agg(
        F.min(F.when(F.col("_line") > F.col("line_no"), F.col("_line"))).alias("_to"))
    return met.select(*FILE, "line_no", F.coalesce("_to", "_last").alias("end"))


def unit_ranges(lines: DataFrame) -> DataFrame:
    """Definition lines with the last line of their block and what stands above them."""
    above = _above(lines)
    # Read four times below: written once, so definitions are sought once.
    starts = cut(unit_starts(above).drop("text", "trimmed", "blank", "comment_from"), "starts")
    ends = indent_ends(lines, starts).unionByName(brace_ends(lines, starts)).unionByName(end_blocks(lines, starts))
    out = starts.join(ends, [*FILE, "line_no"])
    last = lines.groupBy(*FILE).agg(F.max("line_no").alias("_last"))
    out = out.join(last, FILE)
    one_line_arrow = (F.col("kind") == "arrow") & (F.col("end") == F.col("line_no"))
    out = out.withColumn("end", F.when(one_line_arrow, F.least(F.col("line_no") + 1, F.col("_last"))).otherwise(F.col("end")))
    flat_class = (F.col("kind") == "class") & F.col("language").isin(V.C_LANGS) & (F.col("end") <= F.col("line_no"))
    decorated = F.col("language").isin(V.INDENT_LANGS)
    head = F.when(decorated, F.col("line_no") - F.col("decorators")).otherwise(F.col("line_no"))
    # Comments stand above the decorators, so they are looked up from the unit's first line.
    comments = above.select(*FILE, F.col("line_no").alias("head"), "comment_from")
    out = out.where(~flat_class).withColumn("head", head.cast("bigint")).join(comments, [*FILE, "head"])
    closed = F.coalesce("_shut.closed", F.lit(False)) & F.col("_open").isNotNull()
    return out.select(
        *FILE, "language", "kind", "name", "indent", "line_no", "end", "head", "comment_from",
        F.when(closed, F.col("_open")).alias("doc_from"), F.when(closed, F.col("_shut.n")).alias("doc_to"))


# ---- claims -----------------------------------------------------------------------------


def _inside(line: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (r["from"] <= line) & (line <= r["to"]))


def _claim(found: Column, taken: Column, key: Column) -> Column:
    """Walk units in line order; one starting on a claimed line is dropped, a kept one claims its lines."""
    start = F.struct(F.filter(found, lambda u: F.lit(False)).alias("kept"), taken.alias("taken"))

    def step(acc: Column, u: Column) -> Column:
        grown = F.struct(F.array_append(acc["kept"], u).alias("kept"), F.array_append(
            acc["taken"], F.struct(u[key].alias("from"), u["end"].alias("to"))).alias("taken"))
        return F.when(_inside(u["line_no"], acc["taken"]), acc).otherwise(grown)

    return F.aggregate(found, start, step)


def unit_claims(ranges: DataFrame) -> DataFrame:
    """(file, language, units, taken): kept units and claimed line ranges of each file.

    Classes claim first, then free functions, then arrow functions and Rust types; methods are the
    definitions inside a class. The walk runs over the few units of one file.
    """
    item = F.struct("line_no", "kind", "name", "indent", "end", "head", "comment_from", "doc_from", "doc_to")
    per_file = ranges.groupBy(*FILE, "language").agg(F.array_sort(F.collect_list(item)).alias("u"))
    all_ = F.col("u")
    python, java, shell = F.col("language") == "python", F.col("language") == "java", F.col("language") == "shell"

    def of(*kinds: str) -> Column:
        return F.filter(all_, lambda u: u["kind"].isin(*kinds))

    per_file = per_file.withColumn("classes", of("class"))
    taken = F.transform("classes", lambda c: F.struct(c["head"].alias("from"), c["end"].alias("to")))
    free = F.filter(of("function"), lambda u: ~python | (u["indent"] == 0))
    first = _claim(free, F.col("taken"), "head")
    per_file = per_file.withColumn("taken", taken).withColumn("free", F.when(shell, F.struct(
        free.alias("kept"), F.transform(free, lambda u: F.struct(u["head"].alias("from"), u["end"].alias("to"))).alias("taken"))
    ).otherwise(first))
    per_file = per_file.withColumn("more", _claim(of("arrow", "struct"), F.col("free.taken"), "line_no"))

    def out(u: Column, kind: Column, owner: Column) -> Column:
        return F.struct(kind.alias("kind"), u["name"].alias("name"), owner.alias("class_name"), u["line_no"].alias("start"),
                        u["end"].alias("end"), u["head"].alias("head"), u["comment_from"].alias("comment_from"),
                        u["doc_from"].alias("doc_from"), u["doc_to"].alias("doc_to")).cast(UNIT)

    none = F.lit("")
    py_methods = F.flatten(F.transform("classes", lambda c: F.transform(
        F.filter(all_, lambda u: (u["kind"] == "function") & (u["line_no"] >= c["line_no"]) & (u["line_no"] <= c["end"])
                 & (u["indent"] > c["indent"])),
        lambda u: out(u, F.lit("method"), c["name"]))))
    owner = F.array_sort(F.col("classes"))
    java_methods = F.transform(
        F.filter(of("method"), lambda u: _inside(u["line_no"], F.col("taken"))),
        lambda u: out(u, F.lit("method"), F.element_at(F.filter(
            owner, lambda c: (c["line_no"] <= u["line_no"]) & (u["line_no"] <= c["end"])), 1)["name"]))
    empty = F.array().cast(f"array<{UNIT}>")
    units = F.concat(
        F.transform("classes", lambda u: out(u, F.lit("class"), none)),
        F.when(python, py_methods).when(java, java_methods).otherwise(empty),
        F.transform("free.kept", lambda u: out(u, F.lit("function"), none)),
        F.transform("more.kept", lambda u: out(u, F.when(u["kind"] == "struct", "class").otherwise("function"), none)))
    return per_file.select(*FILE, "language", units.alias("units"), F.col("more.taken").alias("taken"))


# ---- texts ------------------------------------------------------------------------------


def file_imports(text: Column, language: Column) -> Column:
    """Import lines of a file; Go's grouped form counts as one."""
    none = F.array().cast("array<string>")
    expr = None
    for langs, pattern in V.IMPORT_PATTERNS:
        if langs == ["go"]:
            pattern = r'^import\s+(?:\([\s\S]*?\)|".+")'
        found = F.transform(F.regexp_extract_all(text, F.lit("(?m)" + pattern), F.lit(0)), T.strip)
        hit = language.isin(langs)
        expr = F.when(hit, found) if expr is None else expr.when(hit, found)
    return expr.otherwise(none)


def _between(lines: Column, first: Column, last: Column) -> Column:
    return F.slice(lines, first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))


def python_docstring(lines: Column, after: Column) -> Column:
    """Triple-quoted text on the line after a definition, at most 30 lines long."""
    block = F.transform(F.slice(lines, (after + 1).cast("int"), F.lit(30)), lambda x: x)
    head = T.strip(F.coalesce(F.get(block, F.lit(0)), F.lit("")))

    def read(quote: str) -> Column:
        rest = F.slice(block, F.lit(2), F.lit(29))
        closes = F.array_position(F.transform(rest, lambda x: x.contains(quote)), True).cast("int")
        body = F.array_join(F.concat(
            F.array(F.substr(head, F.lit(4), F.length(head))),
            F.transform(F.slice(rest, F.lit(1), F.greatest(closes - 1, F.lit(0))), T.strip),
            F.array(F.substring_index(F.get(rest, closes - 1), quote, 1))), "\n")
        one = head.endswith(quote) & (F.length(head) > 6)
        return (
            F.when(one, T.strip(F.substr(head, F.lit(4), F.length(head) - 6)))
            .when(closes > 0, T.strip(body)).otherwise(T.strip(F.substr(head, F.lit(4), F.length(head)))))

    return F.when(head.startswith('"""'), read('"""')).when(head.startswith("'''"), read("'''")).otherwise("")


def unit_texts(files: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per unit with text, docstring, imports, decorators, comments, and the module unit; a file without any is one unit itself."""
    rows = files.join(claims.drop("language"), FILE).withColumn("l", T.lines_of(F.col("text")))
    lines, language = F.col("l"), F.col("language")
    n = F.size(lines).cast("bigint")
    imports = F.when(language == "shell", F.array().cast("array<string>")).otherwise(file_imports(T.normalise_newlines(F.col("text")), language))
    none = F.array().cast("array<string>")

    def full(u: Column) -> Column:
        doc = F.when(language == "python", python_docstring(lines, u["start"])).when(
            (language.isin(V.JS_LANGS) | (language == "java")) & u["doc_from"].isNotNull(),
            F.array_join(F.transform(_between(lines, u["doc_from"], u["doc_to"]), T.strip), "\n")).otherwise("")
        decorators = F.when(language == "python", F.filter(
            F.transform(_between(lines, u["head"], u["start"] - 1), T.strip), lambda x: x.startswith("@"))).otherwise(none)
        mark = F.when(language == "go", "//").otherwise("#")
        wants = ((language == "python") & (u["kind"] != "method")) | ((language == "go") & (u["kind"] == "function"))
        above = F.transform(_between(lines, u["comment_from"], u["head"] - 1), T.strip)
        comments = F.when(wants, F.array_join(F.filter(above, lambda x: F.startswith(x, mark)), "\n")).otherwise("")
        return F.struct(u["kind"].alias("kind"), u["name"].alias("name"), u["class_name"].alias("class_name"),
                        u["head"].alias("start_line"), u["end"].alias("end_line"),
                        F.array_join(_between(lines, u["head"], u["end"]), "\n").alias("text"), doc.alias("docstring"),
                        decorators.alias("decorators"), comments.alias("comments"))

    loose = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).cast("bigint").alias("n"), x.alias("t"))),
                     lambda s: ~_inside(s["n"], F.col("taken")))
    # Columns of their own, so the lines outside the units are sought once and not once per use below.
    rows = rows.withColumn("loose", loose)
    rows = rows.withColumn("rest", T.strip(F.array_join(F.transform("loose", lambda s: s["t"]), "\n")))
    loose, rest = F.col("loose"), F.col("rest")
    whole = language.isin(V.WHOLE_FILE_MODULE_LANGS)
    first = F.when(language.isin("python", *V.JS_LANGS), F.get(loose, F.lit(0))["n"]).otherwise(F.lit(1).cast("bigint"))
    has_module = F.when(whole, F.exists(loose, lambda s: T.strip(s["t"]) != "")).otherwise(F.length(rest) >= V.MIN_MODULE_CHARS)
    module = F.struct(
        F.lit("module").alias("kind"), F.lit("<module>").alias("name"), F.lit("").alias("class_name"),
        F.when(whole, F.lit(1).cast("bigint")).otherwise(first).alias("start_line"), n.alias("end_line"),
        F.when(whole, F.array_join(lines, "\n")).otherwise(rest).alias("text"), F.lit("").alias("docstring"),
        none.alias("decorators"), F.lit("").alias("comments"))
    named = F.transform("units", full)
    units = F.when(has_module, F.array_append(named, module)).otherwise(named)
    rows = rows.select(*FILE, "language", "text", imports.alias("imports"), units.alias("us"))
    none_found = F.size("us") == 0
    file_itself = F.when(F.length(T.strip(F.col("text"))) >= V.MIN_MODULE_CHARS, F.array(_whole_file()))
    rows = rows.select(*FILE, "language", F.when(none_found, none).otherwise(F.col("imports")).alias("imports"),
                       F.posexplode(F.when(none_found, file_itself).otherwise(F.col("us"))).alias("unit_no", "u"))
    return rows.select(*FILE, "language", "imports", "unit_no", "u.*")


# ---- configuration files ----------------------------------------------------------------


def _config_rows(df: DataFrame, units: Column) -> DataFrame:
    rows = df.select(*FILE, "language", F.posexplode(units).alias("unit_no", "u"))
    none = F.array().cast("array<string>")
    return rows.select(*FILE, "language", none.alias("imports"), "unit_no", F.lit("config_block").alias("kind"), "u.name",
                       F.lit("").alias("class_name"), F.col("u.a").cast("bigint").alias("start_line"),
                       F.col("u.b").cast("bigint").alias("end_line"), "u.text", F.lit("").alias("docstring"),
                       none.alias("decorators"), F.lit("").alias("comments"))


def config_sections(files: DataFrame) -> DataFrame:
    """YAML keys, TOML and INI sections up to the line before the next; the whole file if there is none."""
    rows = files.where(F.col("language").isin(list(V.SECTION_PATTERNS))).withColumn("l", T.lines_of(F.col("text")))
    lines = F.col("l")
    pattern = T.lookup(F.col("language"), V.SECTION_PATTERNS)
    heads = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("a"), x.alias("t"))),
                     lambda s: F.rlike(s["t"], pattern))
    rows = rows.withColumn("h", heads)
    sections = F.transform("h", lambda s, i: F.struct(
        F.regexp_extract(s["t"], V.SECTION_PATTERNS["yaml"], 1).alias("y"), F.regexp_extract(s["t"], V.SECTION_PATTERNS["toml"], 1).alias("x"),
        s["a"].alias("a"), (F.coalesce(F.get(F.col("h"), i + 1)["a"], F.size(lines) + 1) - 1).alias("b")))
    named = F.transform(sections, lambda s: F.struct(
        F.when(F.col("language") == "yaml", s["y"]).otherwise(s["x"]).alias("name"), s["a"].alias("a"), s["b"].alias("b"),
        F.array_join(F.slice(lines, s["a"], s["b"] - s["a"] + 1), "\n").alias("text")))
    whole = F.array(F.struct(F.lit("<root>").alias("name"), F.lit(1).alias("a"), F.size(lines).alias("b"), F.col("text").alias("text")))
    return _config_rows(rows.where(F.size("l") > 0), F.when(F.size("h") > 0, named).otherwise(whole))


def _printed_lines(compact: Column) -> Column:
    """Lines a compact JSON value takes when printed with indentation."""
    bare = F.regexp_replace(F.regexp_replace(compact, r'"(\\.|[^"\\])*"', ""), r"\{\}|\[\]", "")
    return F.length(F.regexp_replace(bare, r"[^{}\[\],]", "")) + 1


def json_blocks(files: DataFrame) -> DataFrame:
    """One block per top-level key with the line it stands on."""
    rows = files.where(F.col("language") == "json").withColumn("l", T.lines_of(F.col("text"))).withColumn(
        "v", F.try_parse_json("text"))
    keys = F.json_object_keys("text")
    total = F.size(F.split("text", "\n", -1))
    lines = F.col("l")
    pairs = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.map_entries(F.from_json(
        "text", "map<string,variant>")))
    named = F.transform(pairs, lambda e: F.struct(
        e["key"].alias("name"),
        F.array_position(F.transform(lines, lambda x: F.rlike(x, F.concat(F.lit(r'^\s*"\Q'), e["key"], F.lit(r'\E"\s*:')))), True).cast("int").alias("a"),
        F.concat(F.lit('{"'), e["key"], F.lit('":'), F.to_json(e["value"]), F.lit("}")).alias("text")))
    named = F.transform(F.filter(named, lambda s: s["a"] > 0), lambda s: F.struct(
        s["name"].alias("name"), s["a"].alias("a"), (s["a"] + _printed_lines(s["text"]) - 1).alias("b"), s["text"].alias("text")))
    whole = F.array(F.struct(F.when(F.col("v").isNull(), "<invalid_json>").otherwise("<root>").alias("name"), F.lit(1).alias("a"),
                             total.alias("b"), F.col("text").alias("text")))
    return _config_rows(rows, F.when(keys.isNotNull() & (F.size(named) > 0), named).otherwise(whole))


# ---- all units and chunks ---------------------------------------------------------------


def code_units(files: DataFrame) -> DataFrame:
    """(namespace, source_file, text) to units of every language; files without any become one module unit."""
    files = with_language(files.select(*FILE, "text"))
    parsed = files.where(F.col("language").isin(UNIT_LANGS))
    # Claims are small and read by every later step; written once, the line windows run once.
    ranges = cut(unit_ranges(code_lines(parsed)), "ranges")
    found = unit_claims(ranges)
    empty = F.array().cast(f"array<{UNIT}>")
    bare = parsed.select(*FILE, "language").join(found.select(*FILE), FILE, "left_anti").select(
        *FILE, "language", empty.alias("units"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("taken"))
    claims = found.select(*FILE, "language", "units",
                          F.col("taken").cast("array<struct<from:bigint,to:bigint>>").alias("taken")).unionByName(bare)
    units = unit_texts(parsed, claims)
    units = units.unionByName(config_sections(files)).unionByName(json_blocks(files))
    # The parsers above leave no file without a unit, so the others are known by their language; no text is parsed twice for it.
    split = [*UNIT_LANGS, *V.SECTION_PATTERNS, "json"]
    return units.unionByName(whole_file_units(files.where(F.col("language").isNull() | ~F.col("language").isin(split))))


def _whole_file() -> Column:
    """A file as one unit, its text as it is."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit("module").alias("kind"), F.lit("<module>").alias("name"), F.lit("").alias("class_name"), F.lit(1).cast("bigint").alias("start_line"),
        F.size(F.split("text", "\n", -1)).cast("bigint").alias("end_line"), F.col("text"), F.lit("").alias("docstring"),
        none.alias("decorators"), F.lit("").alias("comments"))


def whole_file_units(files: DataFrame) -> DataFrame:
    """Files no parser split: the whole text as one module unit of at least 30 characters."""
    none = F.array().cast("array<string>")
    kept = files.where(F.length(T.strip(F.col("text"))) >= V.MIN_MODULE_CHARS)
    return kept.select(*FILE, "language", none.alias("imports"), F.lit(0).alias("unit_no"), _whole_file().alias("u")).select(
        *FILE, "language", "imports", "unit_no", "u.*")


def unit_chunks(units: DataFrame) -> DataFrame:
    """Chunks with a context header; units above 80 lines are split into overlapping parts. No shuffle."""
    header = F.array_join(F.concat(
        F.array(F.concat(F.lit("# File: "), F.col("source_file"))),
        F.filter(F.array(
            F.when(F.col("language") != "text", F.concat(F.lit("# Language: "), F.col("language"))),
            F.when(F.col("class_name") != "", F.concat(F.lit("# Class: "), F.col("class_name")))), lambda x: x.isNotNull()),
        F.slice("imports", 1, V.HEADER_IMPORTS)), "\n")
    lines = T.lines_of(F.col("text"))
    long = F.size(F.split("text", "\n", -1)) > V.UNIT_LINES
    parts = F.transform(window_structs(lines, V.UNIT_LINES, V.UNIT_STEP), lambda w, i: F.struct(
        F.concat_ws("\n", header, w["text"]).alias("text"), (F.col("start_line") + w["offset"]).alias("a"),
        (F.col("start_line") + w["last"] - 1).alias("b"), w["offset"].alias("offset")))
    enriched = F.array_join(F.concat(
        F.array(header), F.when(F.col("comments") != "", F.array("comments")).otherwise(F.array().cast("array<string>")),
        F.col("decorators"), F.array("text")), "\n")
    whole = F.array(F.struct(enriched.alias("text"), F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.lit(0).alias("offset")))
    kept = F.filter(F.when(long, parts).otherwise(whole), lambda p: F.length(T.strip(p["text"])) >= V.MIN_CHUNK_CHARS)
    rows = units.select("*", F.posexplode(kept).alias("part", "p"))
    name = F.when(F.col("kind").isin("function", "method"), F.col("name")).otherwise("")
    doc = F.when(F.col("part") == 0, F.substring("docstring", 1, 500)).otherwise("")
    return rows.select(
        *FILE, F.col("p.a").alias("line_start"), F.col("p.b").alias("line_end"), F.col("p.text").alias("text"),
        F.lit("code").alias("source_type"), T.basename(F.col("source_file")).alias("file_name"), F.lit("info").alias("severity"),
        "language", name.alias("function_name"), "class_name", F.col("kind").alias("chunk_kind"), doc.alias("docstring"),
        F.slice("imports", 1, 5).alias("imports"))


def code_chunks(files: DataFrame) -> DataFrame:
    """Unit chunks of every file, line windows for files without any."""
    chunks = cut(unit_chunks(code_units(files)), "code-chunks")
    rest = files.join(chunks.select(*FILE).distinct(), FILE, "left_anti")
    none = F.array().cast("array<string>")
    fallback = line_windows(rest).select(
        "*", F.lit("code").alias("source_type"), T.basename(F.col("source_file")).alias("file_name"), F.lit("info").alias("severity"),
        F.lit("").alias("language"), F.lit("").alias("function_name"), F.lit("").alias("class_name"), F.lit("").alias("chunk_kind"),
        F.lit("").alias("docstring"), none.alias("imports"))
    return chunks.unionByName(fallback)


def ingest_stats(chunks: DataFrame, n: int = 20) -> DataFrame:
    """Files with most chunks."""
    counted = chunks.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_kind") == "function").alias("functions"),
        F.count_if(F.col("chunk_kind") == "class").alias("classes"), F.count_if(F.col("chunk_kind") == "method").alias("methods"))
    return first_n(counted, [NS], [F.col("chunks").desc(), F.col("source_file")], n)
