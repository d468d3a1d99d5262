"""Symbol graph and architecture tables from code units and project paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.functions.groups import containment_pairs, first_n, ordered_list

NS = "namespace"
FILE = [NS, "source_file"]


# ---- nodes and edges --------------------------------------------------------------------


def _file_key() -> Column:
    return F.concat(F.lit("file:"), F.col("source_file"))


def _symbol_key(name: Column) -> Column:
    return F.concat(F.lit("symbol:"), name, F.lit("@"), F.col("source_file"))


def symbols(units: DataFrame) -> DataFrame:
    return units.where(F.col("kind") != "module")


def graph_nodes(units: DataFrame) -> DataFrame:
    files = units.groupBy(*FILE).agg(F.max("language").alias("language")).select(
        NS, _file_key().alias("key"), T.basename(F.col("source_file")).alias("name"), F.lit("file").alias("kind"),
        "source_file", F.lit(0).cast("bigint").alias("line_start"), F.lit(0).cast("bigint").alias("line_end"), "language",
        F.lit("").alias("docstring"), F.lit("").alias("parent"))
    named = symbols(units).select(
        NS, _symbol_key(F.col("name")).alias("key"), "name", "kind", "source_file", F.col("start_line").alias("line_start"),
        F.col("end_line").alias("line_end"), "language", F.substring("docstring", 1, 200).alias("docstring"),
        F.col("class_name").alias("parent"))
    return files.unionByName(named)


def edge_defines(units: DataFrame) -> DataFrame:
    return symbols(units).select(NS, _file_key().alias("source"), _symbol_key(F.col("name")).alias("target"),
                                 F.lit("defines").alias("relation"))


def edge_contains(units: DataFrame) -> DataFrame:
    owned = units.where((F.col("kind") == "method") & (F.col("class_name") != ""))
    return owned.select(NS, _symbol_key(F.col("class_name")).alias("source"), _symbol_key(F.col("name")).alias("target"),
                        F.lit("contains").alias("relation"))


def called_names(text: Column, own: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(T.unicode_words(V.CALL)), F.lit(1)))
    return F.filter(found, lambda n: ~n.isin(V.CALL_IGNORE) & (n != own))


def calls(units: DataFrame) -> DataFrame:
    """(namespace, source_file, caller, callee)"""
    return symbols(units).select(*FILE, F.col("name").alias("caller"),
                                 F.explode(called_names(F.col("text"), F.col("name"))).alias("callee"))


def edge_calls(units: DataFrame) -> DataFrame:
    return calls(units).select(NS, _symbol_key(F.col("caller")).alias("source"),
                               F.concat(F.lit("symbol:"), F.col("callee")).alias("target"), F.lit("calls").alias("relation"))


def import_names(line: Column) -> Column:
    """Module and symbol names of one import line."""
    none = F.array().cast("array<string>")
    line = T.strip(line)
    words = F.split(line, r"\s+")

    def listed(text: Column) -> Column:
        return F.transform(F.split(text, ","), lambda s: T.strip(F.substring_index(T.strip(s), " as ", 1)))

    after = F.substr(line, F.locate("import", line) + len("import"), F.length(line))
    from_names = F.concat(
        F.when(F.size(words) >= 2, F.array(F.substring_index(F.get(words, F.lit(1)), ".", 1))).otherwise(none),
        F.when(line.contains("import"), F.filter(listed(after), lambda n: (n != "") & (n != "*"))).otherwise(none))
    modules = F.transform(F.filter(listed(F.substr(line, F.lit(8), F.length(line))), lambda n: n != ""),
                          lambda n: F.substring_index(n, ".", 1))
    quote = F.when(line.contains('"'), '"').when(line.contains("'"), "'").when(line.contains("`"), "`")
    inside = F.get(F.split(line, F.concat(F.lit(r"\Q"), quote, F.lit(r"\E"))), F.lit(1))
    tail = F.substring_index(F.element_at(F.split(inside, "/"), -1), ".", 1)
    quoted = F.when(quote.isNotNull(), F.array(tail)).otherwise(none)
    return (
        F.when(line == "", none).when(line.startswith("from "), from_names).when(line.startswith("import "), modules)
        .when(line.contains("require(") | line.contains("from "), quoted).otherwise(none))


def file_imports(units: DataFrame) -> DataFrame:
    """Distinct (namespace, source_file, name) imported by a file."""
    lines = units.select(*FILE, F.explode("imports").alias("line"))
    return lines.select(*FILE, F.explode(import_names(F.col("line"))).alias("name")).distinct()


def edge_imports(units: DataFrame) -> DataFrame:
    return file_imports(units).select(NS, _file_key().alias("source"), F.concat(F.lit("module:"), F.col("name")).alias("target"),
                                      F.lit("imports").alias("relation"))


def graph_edges(units: DataFrame) -> DataFrame:
    out = edge_defines(units)
    for part in (edge_contains(units), edge_calls(units), edge_imports(units)):
        out = out.unionByName(part)
    return out


# ---- lookups, for many targets at once --------------------------------------------------


def files_importing(units: DataFrame, targets: DataFrame) -> DataFrame:
    """(namespace, name, source_file): files importing each target, else files defining its callers."""
    imports = file_imports(units)
    direct = targets.join(imports, [NS, "name"]).select(NS, "name", "source_file")
    rest = targets.join(imports.select(NS, "name").distinct(), [NS, "name"], "left_anti")
    defined = symbols(units).groupBy(NS, F.col("name").alias("caller")).agg(F.max("source_file").alias("source_file"))
    callers = calls(units).select(NS, F.col("callee").alias("name"), "caller").distinct()
    indirect = rest.join(callers, [NS, "name"]).join(defined, [NS, "caller"]).select(NS, "name", "source_file").distinct()
    return direct.unionByName(indirect)


def symbols_in(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Symbols of the files whose path contains the target: (namespace, name, source_file, kind, symbol, lines)."""
    files = symbols(units).select("source_file").distinct()
    met = containment_pairs(files, "source_file", targets.select("name").distinct(), "name")
    rows = symbols(units).select(*FILE, "kind", F.col("name").alias("symbol"), "start_line", "end_line")
    return targets.join(met, "name").join(rows, FILE)


def dependents_of(units: DataFrame, targets: DataFrame) -> DataFrame:
    """(namespace, name, source_file): files with an import containing the target."""
    imports = file_imports(units).withColumnRenamed("name", "imported")
    met = containment_pairs(imports.select("imported").distinct(), "imported", targets.select("name").distinct(), "name")
    return targets.join(met, "name").join(imports, [NS, "imported"]).select(NS, "name", "source_file").distinct()


def dependents_by_stem(units: DataFrame, paths: DataFrame) -> DataFrame:
    """Files importing the module a path stands for: its name without folders and suffix (namespace, path)."""
    stem = F.regexp_replace(T.basename(F.col("path")), r"\.[^.]*$", "")
    asked = paths.select(NS, "path", stem.alias("name"))
    return asked.join(file_imports(units), [NS, "name"]).select(NS, "path", "source_file").distinct()


def methods_of(units: DataFrame, targets: DataFrame) -> DataFrame:
    """(namespace, name, class_name, method); class names match without case, the first spelling counts."""
    owned = units.where((F.col("kind") == "method") & (F.col("class_name") != "")).select(
        NS, "class_name", F.col("name").alias("method")).distinct()
    spelled = owned.groupBy(NS, F.lower("class_name").alias("low")).agg(F.min("class_name").alias("class_name"))
    asked = targets.withColumn("low", F.lower("name")).join(spelled, [NS, "low"])
    return asked.join(owned, [NS, "class_name"]).select(NS, "name", "class_name", "method")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = nodes.groupBy(NS, F.lit("node").alias("part"), F.col("kind").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    relations = edges.groupBy(NS, F.lit("edge").alias("part"), F.col("relation").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(relations)


def top_files(units: DataFrame, n: int = 20) -> DataFrame:
    sizes = symbols(units).groupBy(*FILE).agg(F.count_distinct("name").alias("symbols"))
    return first_n(sizes, [NS], [F.col("symbols").desc(), F.col("source_file")], n)


def core_deps(units: DataFrame, n: int = 15) -> DataFrame:
    """Most imported names by number of importing files."""
    counted = file_imports(units).groupBy(NS, "name").agg(F.count(F.lit(1)).alias("files"))
    return first_n(counted, [NS], [F.col("files").desc(), F.col("name")], n)


def evidence_deps(units: DataFrame, evidence: DataFrame, n: int = 10) -> DataFrame:
    """Files depending on a query's first code rows (query_id, namespace, rank, source_file, function_name)."""
    top = evidence.where(F.col("rank") <= n)
    files = top.select(NS, F.col("source_file").alias("name")).distinct()
    names = top.where(F.col("function_name") != "").select(NS, F.col("function_name").alias("name")).distinct()
    imports = file_imports(units)
    by_name = names.join(imports, [NS, "name"])
    asked_names = top.select("query_id", NS, F.col("function_name").alias("name")).distinct()
    asked_files = top.select("query_id", NS, F.col("source_file").alias("name")).distinct()
    return asked_files.join(dependents_of(units, files), [NS, "name"]).unionByName(
        asked_names.join(by_name, [NS, "name"])).select("query_id", NS, F.col("source_file").alias("dependency")).distinct()


# ---- structural questions ---------------------------------------------------------------


def structural_lookups(questions: DataFrame) -> DataFrame:
    """(query_id, namespace, lookup, name): which graph lookup a question asks for, and of what."""
    q = F.lower(T.strip(F.col("question")))
    lookup = name = None
    for kind, pattern in V.STRUCTURAL_LOOKUPS:
        hit, arg = q.rlike(T.unicode_words(pattern)), F.regexp_extract(q, T.unicode_words(pattern), 1)
        if kind == "symbols":
            arg = F.btrim(T.strip(arg), F.lit("'\""))
        lookup = F.when(hit, kind) if lookup is None else lookup.when(hit, kind)
        name = F.when(hit, arg) if name is None else name.when(hit, arg)
    out = questions.select("query_id", NS, lookup.alias("lookup"), name.alias("name"))
    return out.where(F.col("lookup").isNotNull())


def structural_answers(units: DataFrame, lookups: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """(namespace, lookup, name, item) one row per answer line of each distinct lookup. ``subjects`` are those of
    ``answer_subjects``, if they are there already: the paths are searched once."""
    asked = lookups.select(NS, "lookup", "name").distinct()

    def of(kind: str) -> DataFrame:
        return asked.where(F.col("lookup") == kind).select(NS, "name")

    span = F.concat(F.col("kind"), F.lit(": "), F.col("symbol"), F.lit(" (lines "), F.col("start_line").cast("string"),
                    F.lit("–"), F.col("end_line").cast("string"), F.lit(")"))
    if subjects is None:
        subjects = answer_subjects(units, lookups)
    first_file = subjects.where(F.col("lookup") == "symbols").select(NS, "name", F.col("subject").alias("source_file"))
    held = symbols(units).select(*FILE, "kind", F.col("name").alias("symbol"), "start_line", "end_line")
    parts = {
        "importers": files_importing(units, of("importers")).withColumn("item", F.col("source_file")),
        "dependents": dependents_of(units, of("dependents")).withColumn("item", F.col("source_file")),
        "methods": methods_of(units, of("methods")).withColumn("item", F.concat(F.col("method"), F.lit("()"))),
        "symbols": first_file.join(held, FILE).withColumn("item", span),
    }
    out = None
    for kind, df in parts.items():
        rows = df.select(NS, F.lit(kind).alias("lookup"), "name", "item").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def answer_subjects(units: DataFrame, lookups: DataFrame) -> DataFrame:
    """(namespace, lookup, name, subject): the class as it is spelled, the file whose symbols are listed."""
    asked = lookups.select(NS, "lookup", "name").distinct()
    classes = methods_of(units, asked.where("lookup = 'methods'").select(NS, "name"))
    classes = classes.select(NS, F.lit("methods").alias("lookup"), "name", F.col("class_name").alias("subject")).distinct()
    files = symbols_in(units, asked.where("lookup = 'symbols'").select(NS, "name"))
    files = files.groupBy(NS, F.lit("symbols").alias("lookup"), "name").agg(F.min("source_file").alias("subject"))
    return classes.unionByName(files)


# ---- architecture -----------------------------------------------------------------------


def languages(paths: DataFrame) -> DataFrame:
    lang = T.display_language(F.col("path"))
    return paths.select(NS, lang.alias("language")).where(F.col("language") != "").groupBy(NS, "language").agg(
        F.count(F.lit(1)).alias("files"))


def entry_points(paths: DataFrame) -> DataFrame:
    name = T.basename(F.col("path"))
    hit = name.rlike(V.ENTRY_POINT_NAMES) | F.col("path").rlike(V.ENTRY_POINT_NAMES) | F.col("path").rlike(V.ENTRY_POINT_PATHS)
    return paths.where(hit).select(NS, "path").distinct()


def config_files(paths: DataFrame) -> DataFrame:
    return paths.where(T.basename(F.col("path")).rlike(V.CONFIG_NAMES)).select(NS, "path").distinct()


def _purpose(folder: Column) -> Column:
    expr = None
    for label, names in V.MODULE_PURPOSE:
        hit = F.lower(folder).isin(names)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr.otherwise("")


def _top_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1))


def modules(paths: DataFrame, units: DataFrame, n: int = 15, names: int = 10) -> DataFrame:
    """Largest top folders with languages, first classes and functions, and purpose."""
    p = paths.select(NS, "path", _top_folder(F.col("path")).alias("module")).where("module is not null and not startswith(module, '.')")
    sizes = first_n(p.groupBy(NS, "module").agg(F.count(F.lit(1)).alias("files")), [NS],
                    [F.col("files").desc(), F.col("module")], n)
    langs = p.select(NS, "module", T.display_language(F.col("path")).alias("language")).where("language <> ''").distinct()
    langs = langs.groupBy(NS, "module").agg(F.array_sort(F.collect_list("language")).alias("languages"))
    out = sizes.join(langs, [NS, "module"], "left")
    u = units.select(NS, _top_folder(F.col("source_file")).alias("module"), "kind", "name", "source_file", "start_line")
    u = u.join(sizes.select(NS, "module"), [NS, "module"], "left_semi")
    for kind, column in (("class", "classes"), ("function", "functions")):
        first = first_n(u.where(F.col("kind") == kind), [NS, "module"],
                        [F.col("source_file"), F.col("start_line"), F.col("name")], names, rank="place")
        out = out.join(first.groupBy(NS, "module").agg(ordered_list("place", "name").alias(column)), [NS, "module"], "left")
    none = F.array().cast("array<string>")
    return out.select(NS, "rank", "module", "files", *[F.coalesce(c, none).alias(c) for c in ("languages", "classes", "functions")],
                      _purpose(F.col("module")).alias("description"))


def dir_tree(paths: DataFrame, depth: int = 3, n: int = 40) -> DataFrame:
    """First folders of the project in path order with their indented line."""
    parts = F.split("path", "/")
    levels = F.least(F.size(parts) - 1, F.lit(depth))
    prefixes = F.transform(F.sequence(F.lit(1), levels), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = paths.where(F.size(parts) > 1).select(NS, F.explode(prefixes).alias("folder")).distinct()
    top = first_n(folders, [NS], [F.col("folder")], n)
    name = F.element_at(F.split("folder", "/"), -1)
    line = F.concat(F.repeat(F.lit("  "), F.size(F.split("folder", "/")) - 1), name,
                    F.when(name.contains("."), "").otherwise("/"))
    return top.select(NS, "rank", "folder", line.alias("line"))


def architecture_totals(paths: DataFrame, units: DataFrame) -> DataFrame:
    files = paths.groupBy(NS).agg(F.count(F.lit(1)).alias("total_files"))
    kinds = units.groupBy(NS).agg(
        F.count_if(F.col("kind").isin("function", "method")).alias("total_functions"),
        F.count_if(F.col("kind") == "class").alias("total_classes"))
    return files.join(kinds, NS, "left").fillna(0, ["total_functions", "total_classes"])


def architecture_report(paths: DataFrame, units: DataFrame, project: str = "Unknown Project") -> DataFrame:
    """One text per namespace. Entry points are listed in full; the other lists have a fixed upper length."""
    def block(title: str, rows: DataFrame, order: str, line: Column, end: str = "\n") -> DataFrame:
        lines = rows.select(NS, F.col(order).alias("o"), line.alias("l"))
        return lines.groupBy(NS).agg(F.concat(F.lit(f"### {title}\n"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("o", "l"))), lambda s: s["l"]), "\n"), F.lit(end)).alias("t"))

    def s(c: str) -> Column:
        return F.col(c).cast("string")

    def firsts(rows: DataFrame, n: int) -> DataFrame:
        return first_n(rows, [NS], [F.col("path")], n)

    langs = first_n(languages(paths), [NS], [F.col("files").desc(), F.col("language")], len(V.DISPLAY_LANGUAGE))
    totals = architecture_totals(paths, units)
    overview = totals.select(NS, F.concat(
        F.lit("### Overview\n  - Total files: "), s("total_files"), F.lit("\n  - Total functions: "), s("total_functions"),
        F.lit("\n  - Total classes: "), s("total_classes"), F.lit("\n")).alias("t"))
    listed = F.when(F.size("languages") > 0, F.array_join("languages", ", ")).otherwise("mixed")
    module_line = F.concat(
        F.lit("  - **"), F.col("module"), F.lit("/** ("), s("files"), F.lit(" files, "), listed, F.lit(")"),
        F.when(F.col("description") != "", F.concat(F.lit(" — "), F.col("description"))).otherwise(""),
        *[F.when(F.size(c) > 0, F.concat(F.lit(f"\n    {c.title()}: "), F.array_join(F.slice(c, 1, 8), ", "))).otherwise("")
          for c in ("classes", "functions")])
    dash = F.concat(F.lit("  - "), F.col("path"))
    blocks = [
        block("Languages", langs, "rank", F.concat(F.lit("  - "), F.col("language"), F.lit(": "), s("files"), F.lit(" file(s)"))),
        overview,
        block("Entry Points", entry_points(paths), "path", dash),
        block("Modules / Services", modules(paths, units), "rank", module_line),
        block("Core Dependencies (most imported)", core_deps(units, 10), "rank", F.concat(F.lit("  - "), F.col("name"))),
        block("Configuration Files", firsts(config_files(paths), 15), "rank", dash),
        block("Directory Structure", dir_tree(paths), "rank", F.col("line")),
    ]
    out = totals.select(NS)
    for i, b in enumerate(blocks):
        out = out.join(b.withColumnRenamed("t", f"t{i}"), NS, "left")
    return out.select(NS, F.concat_ws("\n", F.lit(f"## Project: {project}\n"), *[f"t{i}" for i in range(len(blocks))]).alias("summary"))
