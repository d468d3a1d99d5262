"""Inputs of the registered queries, derived from the given tables over all their rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions.groups import running
from faultline.session import pin

REF_TIME = "2024-01-30 23:00:00"


def ref_time() -> Column:
    return F.lit(REF_TIME).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(pin(spark).read.parquet(f"{sf}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Share a scan of fewer splits than cores out over the cores; the text features are pure CPU work.

    Only small inputs (a file or two) are affected. A table with at least one split per core is read
    as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _s(c: Column) -> Column:
    return c.cast("string")


def log_view(spark: SparkSession, sf: str) -> DataFrame:
    """One log entry per event: namespace, source_file, ord, text."""
    return entries_of(table(spark, sf, "events"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a file stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)


def entries_of(e: DataFrame) -> DataFrame:
    # A column of its own, so the JSON of an event is read once and not once per use below.
    e = e.select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k = F.col("k")
    user, kind, eid = F.col("user_id"), F.col("event_type"), F.col("event_id")
    level = F.when(kind == "error", "ERROR").when(kind == "purchase", "WARNING").otherwise("INFO")
    error = (
        F.when(k % 5 == 0, F.concat(F.lit("NullPointerException: value of user "), _s(user), F.lit(" is null at mod"),
                                    _s(k % 7), F.lit(".py:"), _s(k + 1)))
        .when(k % 5 == 1, F.concat(F.lit("ValueError: bad input "), _s(k + 10000), F.lit(" at parser.py:"),
                                   _s(k % 3 + 1)))
        .when(k % 5 == 2, F.concat(F.lit("Connection refused to service svc"), _s(k % 3)))
        .when(k % 5 == 3, F.concat(
            F.lit("java.lang.OutOfMemoryError: heap space\n  at com.app.Service"), _s(k % 4), F.lit(".run(Service.java:"),
            _s(k + 1), F.lit(')\n  File "src/mod'), _s(k % 7), F.lit('.py", line '), _s(k + 1), F.lit(", in fn"),
            _s(k % 5)))
        .otherwise(F.concat(F.lit("Request failed: GET /api/item/"), _s(eid + 10000), F.lit(" - 500")))
    )
    message = (
        F.when(kind == "error", error)
        .when((kind == "purchase") & (k % 2 == 0), "Connection timeout after 5000 ms")
        .when(kind == "purchase", F.concat(F.lit("Slow query on table t"), _s(k % 6)))
        .otherwise(F.concat(F.lit("Session created for user "), _s(user)))
    )
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return e.select(
        F.concat(F.lit("ns"), _s(user % 3)).alias("namespace"),
        F.concat(F.lit("logs/svc"), _s(user % 20), F.lit(".log")).alias("source_file"),
        eid.alias("ord"),
        F.concat(stamp, F.lit("Z "), level, F.lit(" "), message).alias("text"),
    )


def log_view_untimed(spark: SparkSession, sf: str) -> DataFrame:
    """The log view where every fiftieth event lost its time stamp."""
    v = log_view(spark, sf)
    return v.withColumn("text", F.when(F.col("ord") % 50 == 0, F.expr("substring(text, 22)")).otherwise(F.col("text")))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """namespace, source_file, line_no (1-based within the file), text."""
    v = log_view(spark, sf).withColumn("_lines", F.split("text", "\n", -1))
    v = running(
        v, ["namespace", "source_file"], F.floor(F.col("ord") / 4096), ["ord"], F.size("_lines").cast("bigint"), "_end"
    )
    lines = v.select("namespace", "source_file", (F.col("_end") - F.size("_lines")).alias("_start"),
                     F.posexplode("_lines").alias("_pos", "text"))
    return lines.select("namespace", "source_file", (F.col("_start") + F.col("_pos") + 1).alias("line_no"), "text")


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(_s(F.col("doc_id")), F.lit(".txt")))
    return d.select(F.concat(F.lit("ns"), _s(F.col("doc_id") % 3)).alias("namespace"), path.alias("source_file"), "text")


def sparse_files(spark: SparkSession, sf: str) -> DataFrame:
    """Per document a file of mostly empty lines: 40 single letters around line 80, too few on either side for an entry."""
    letters = F.substring(F.regexp_replace("text", "[^a-z]", "x"), 1, 40)
    text = F.concat(F.repeat(F.lit("\n"), F.lit(60)), F.array_join(F.split(letters, ""), "\n"), F.repeat(F.lit("\n"), F.lit(40)))
    return doc_files(spark, sf).withColumn("text", text)


def vec_chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    vec, label = F.col("vec_id"), F.col("label")
    start = (vec * 4 + 1).cast("bigint")
    namespace = F.concat(F.lit("ns"), _s(label % 3))
    source_file = F.concat(F.lit("src"), _s(label), F.lit(".py"))
    odd = vec % 2 == 1
    return e.select(
        namespace.alias("namespace"), vec.alias("vec_id"), source_file.alias("source_file"),
        start.alias("line_start"), (start + 14).alias("line_end"),
        F.when(odd, "log").otherwise("code").alias("source_type"),
        F.when(vec % 3 == 0, "function").otherwise("").alias("chunk_kind"),
        F.when(vec % 3 == 0, F.concat(F.lit("fn"), _s(vec % 11))).otherwise("").alias("function_name"),
        F.when(vec % 5 == 0, "Explains the unit.").otherwise("").alias("docstring"),
        F.array(F.concat(F.lit("from lib import fn"), _s(vec % 13), F.lit(", fn"), _s(vec % 7), F.lit(" as f"))).alias("imports"),
        F.concat(F.when(odd & (vec % 4 == 1), F.lit("2024-01-30T")).otherwise(F.lit("2024-01-20T")),
                 F.lpad(_s(vec % 24), 2, "0"), F.lit(":00:00Z "),
                 F.when(vec % 4 == 1, "ERROR").when(vec % 4 == 3, "WARNING").otherwise("INFO"),
                 F.lit(" unit "), _s(vec), F.lit("\n  at run(x.js:"), _s(label), F.lit(")")).alias("text"),
        F.col("embedding"),
    )


VECTOR_QUESTIONS = ["Any error or exception?", "timeout and warning lines", "show me the logs", ""]


def vec_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asked as a question, with a text."""
    e = table(spark, sf, "embeddings")
    vec = F.col("vec_id")
    return e.select(vec.alias("query_id"), F.concat(F.lit("ns"), _s(F.col("label") % 3)).alias("namespace"),
                    T.lookup(vec % 4, dict(enumerate(VECTOR_QUESTIONS))).alias("question"), "embedding")


def log_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The log entries as stored chunks, one line range per entry."""
    v = log_view(spark, sf)
    line = F.col("ord").cast("bigint")
    ident = F.sha2(F.concat_ws(":", "namespace", "source_file", _s(line), _s(line)), 256)
    return v.select("namespace", "source_file", line.alias("line_start"), line.alias("line_end"), "text", ident.alias("chunk_id"),
                    T.ingest_severity(F.col("text")).alias("severity"), F.lit("log").alias("source_type"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """User turns phrased as questions; most phrases are followed by the whole turn text."""
    c = table(spark, sf, "conversations").where(F.col("role") == "user")
    pick = (F.col("conv_id") * 7 + F.col("turn")) % len(PHRASES)
    phrase = T.lookup(pick, {i: p for i, (p, _) in enumerate(PHRASES)})
    whole = pick.isin([i for i, (_, whole) in enumerate(PHRASES) if whole])
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.concat(F.lit("ns"), _s(F.col("conv_id") % 3)).alias("namespace"),
        F.when(whole, F.concat(phrase, F.lit(" "), F.col("text"))).otherwise(phrase).alias("question"),
    )


# Phrases put in front of the turn text (True) or asked alone (False).
PHRASES = [
    ("Why is the payment service failing with NullPointerException?", True),
    ("hello!", False),
    ("Which files import fn1?", False),
    ("Tell me about the project architecture", True),
    ("Summarize any errors in the logs", True),
    ("What depends on lib2?", False),
    ("How does Service1 work in core.session.store", True),
    ("Are you a robot", True),
    ("Write a poem about autumn", True),
    ("Is the code good? suggest improvements for user_store", True),
    ("timeout in src/mod3.py", True),
    ("What methods does Service2 have?", False),
    ("show me the function run3", True),
    ("which functions are in src1.py?", False),
    ("", True),
]


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Question/answer turns: each user row with the text of the row after it."""
    c = table(spark, sf, "conversations")
    user = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    files = F.array(F.concat(F.lit("src/mod"), _s(F.col("turn") % 7), F.lit(".py")),
                    F.concat(F.lit("logs/svc"), _s(F.col("conv_id") % 5), F.lit(".log")))
    kind = F.when(F.col("turn") % 4 == 0, "log_analysis").when(F.col("turn") % 4 == 2, "general").otherwise("root_cause")
    return user.join(reply, ["conv_id", "turn"], "left").select(
        F.concat(F.lit("conv"), _s(F.col("conv_id"))).alias("namespace"), F.col("turn").alias("ord"), "question",
        F.coalesce("answer", F.lit("")).alias("answer"), files.alias("source_files"), kind.alias("question_type"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return c.select("conv_id", "turn", F.col("text").alias("answer"))


PATH_SUFFIXES = [".py", ".js", ".ts", ".go", ".java", ".md", ".min.js", ".lock"]
PATH_FOLDERS = ["src", "api", "tests", "node_modules", ".hidden", "db", "cmd", "web"]
PATH_NAMES = ["main", "util", "Dockerfile", "index", "app", "go.sum", "settings", "package-lock.json"]


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """Project files with sizes: a folder and a file name picked per page around the page's own path."""
    p = table(spark, sf, "pages")
    pid = F.col("page_id")
    inner = F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1)
    folder = T.lookup(F.floor(pid / 3) % 8, dict(enumerate(PATH_FOLDERS)))
    name = T.lookup(F.floor(pid / 5) % 8, dict(enumerate(PATH_NAMES)))
    suffix = T.lookup(pid % 8, dict(enumerate(PATH_SUFFIXES)))
    full = F.concat_ws("/", folder, F.regexp_replace(inner, r"/+$", ""), _s(pid), F.concat(name, suffix))
    return p.select(F.concat(F.lit("ns"), _s(pid % 3)).alias("namespace"), full.alias("path"),
                    (F.length("html") * 400).cast("bigint").alias("length"))


def repos(spark: SparkSession, sf: str) -> DataFrame:
    """Repository links written around the page addresses, some with credentials, some not cloneable."""
    p = table(spark, sf, "pages")
    pid = F.col("page_id")
    host = F.regexp_extract("url", r"^https?://([^/]*)", 1)
    scheme = F.when(pid % 9 == 0, "git").otherwise("https")
    user = F.when(pid % 2 == 0, "bot:secret@").otherwise("")
    tail = F.when(pid % 7 == 0, "").when(pid % 7 == 1, F.concat(F.lit("/solo"), _s(pid), F.lit(".git"))).otherwise(
        F.concat(F.lit("/team"), _s(pid % 11), F.lit("/digit"), _s(pid), F.when(pid % 3 == 0, ".git").otherwise("")))
    return p.select(pid.alias("repo_id"), F.concat(scheme, F.lit("://"), user, host, tail).alias("url"),
                    F.when(pid % 5 == 0, "HEAD").otherwise("main").alias("branch"),
                    F.sha1("url").alias("commit_sha"), F.col("html").alias("commit_message"),
                    F.concat(F.lit("author"), _s(pid % 17)).alias("author"))


# ---- source code ------------------------------------------------------------------------

# One file per document: (extension, body). {d%n} is the document number modulo n; a line
# <<prefix>> becomes every line of the document, each behind the prefix.
CODE_TEMPLATES = [
    (".py", '''import os
from lib{d%5} import fn{d%3}, Service{d%4} as S

# about {d}
@register
class Service{d%4}(Base):
    """Keeps {d}."""

    limit = {d%9}

    @cached
    def fn{d%5}(self, x):
        """Look up
        one value.
        """
<<        # >>
        return helper{d%6}(x)

    def close(self):
        return self.fn{d%5}(1)

def run{d%7}(a):
<<    # >>
    return Service{d%4}(a)

CONFIG = run{d%7}({d})
print(CONFIG, os.path.join("a", "b"))
'''),
    (".js", '''import { fn{d%3} } from './lib{d%5}';
const api = require("api{d%4}");

/** Service {d}. */
export class Service{d%4} {
  fn{d%5}(x) {
<<    // >>
    return helper{d%6}(x);
  }
}

export async function run{d%7}(a) {
  if (a) { return fn{d%3}(a); }
<<  // >>
}

const pick{d%3} = (x) => {
  return run{d%7}(x);
};
const one{d%3} = x => x;
'''),
    (".go", '''package main

import "fmt"
import "lib{d%5}"

type Service{d%4} struct {
	id int
}

// run {d}
func run{d%7}(a int) int {
<<	// >>
	return helper{d%6}(a)
}

func (s *Service{d%4}) fn{d%5}(x int) int {
	return run{d%7}(x)
}
'''),
    (".java", '''package app;
import java.util.List;
import app.lib{d%5}.Service{d%3};

/**
 * Service {d}.
 */
public class Service{d%4} {
    private int id;

    public int fn{d%5}(int x) {
<<        // >>
        return helper{d%6}(x);
    }

    private static List<String> close{d%3}(String s) {
        return run{d%7}(s);
    }
}
'''),
    (".cpp", '''#include <vector>
#include "lib{d%5}.h"

class Service{d%4} {
 public:
  int id;
};

int run{d%7}(int a) {
<<  // >>
  return helper{d%6}(a);
}
'''),
    (".rs", '''use lib{d%5};

pub struct Service{d%4} {
    id: i32,
}

pub fn run{d%7}(a: i32) -> i32 {
<<    // >>
    helper{d%6}(a)
}

struct Unit{d%3};
'''),
    (".rb", '''require 'lib{d%5}'

class Service{d%4}
  def fn{d%5}(x)
    if x
<<      # >>
      helper{d%6}(x)
    end
  end
end

def run{d%7}!(a)
  Service{d%4}.new(a)
end
'''),
    (".php", '''<?php
use App\\\\Lib{d%5};

class Service{d%4} {
    public function fn{d%5}($x) {
<<        // >>
        return helper{d%6}($x);
    }
}

function run{d%7}($a) {
    return $a;
}
'''),
    (".sh", '''#!/bin/sh
run{d%7}() {
<<  # >>
  helper{d%6} "$1"
}

function fn{d%5}() {
  echo {d}
}
run{d%7} {d%9}
'''),
    (".yaml", '''name: service{d%4}
limits:
  a: {d%9}
  b: {d}
notes:
<<  # >>
deploy-{d%3}:
  on: true
'''),
    (".toml", '''[package]
name = "service{d%4}"

[dependencies.lib{d%5}]
version = "{d%9}"
<<# >>
'''),
    (".ini", '''; settings {d}
[server{d%4}]
port = {d}
<<; >>

[client]
retries = {d%9}
'''),
    (".json", '''{
  "name": "service{d%4}",
  "limits{d%3}": {"a": {d%9}, "b": [1, {d}]},
  "flag": true
}
'''),
    (".txt", '''<<>>
'''),
]


def _prefixed(prefix: str):
    return lambda line: F.concat(F.lit(prefix), line)


def _render(template: str, lines: Column, number: Column) -> Column:
    parts = []
    for piece in re.split(r"(\{d(?:%\d+)?\}|<<[^\n]*?>>)", template):
        if piece.startswith("<<"):
            prefix = piece[2:-2]
            parts.append(F.array_join(F.transform(lines, _prefixed(prefix)), "\n"))
        elif re.fullmatch(r"\{d(%\d+)?\}", piece):
            mod = piece[3:-1]
            parts.append(_s(number % int(mod) if mod else number))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """One source file per document (whole text inside): namespace, source_file, text."""
    d = table(spark, sf, "documents")
    number, lines = F.col("doc_id"), F.split("text", "\n", -1)
    pick = number % len(CODE_TEMPLATES)
    text = ext = None
    for i, (suffix, template) in enumerate(CODE_TEMPLATES):
        body = _render(template, lines, number)
        text = F.when(pick == i, body) if text is None else text.when(pick == i, body)
        ext = F.when(pick == i, suffix) if ext is None else ext.when(pick == i, suffix)
    return d.select(
        F.concat(F.lit("ns"), _s(number % 3)).alias("namespace"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/f"), _s(number), ext).alias("source_file"),
        text.alias("text"))


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Code units as a parser would give them, four per document; the function holds the document text."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    ext = T.lookup(n % 3, {0: ".py", 1: ".js", 2: ".java"})
    lang = T.lookup(n % 3, {0: "python", 1: "javascript", 2: "java"})
    imports = F.array(
        F.concat(F.lit("from lib"), _s(n % 5), F.lit(".sub import fn"), _s(n % 3), F.lit(", Service"), _s(n % 4), F.lit(" as S")),
        F.concat(F.lit("import mod"), _s(n % 7), F.lit(".inner, os")),
        F.concat(F.lit("const x = require('./util"), _s(n % 4), F.lit(".js')")))
    service, run = F.concat(F.lit("Service"), _s(n % 4)), F.concat(F.lit("run"), _s(n % 19))
    method = F.concat(F.lit("fn"), _s(n % 11))

    def unit(kind, name, start, end, parent, doc, text):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(start).cast("bigint").alias("start_line"),
                        F.lit(end).cast("bigint").alias("end_line"), parent.alias("class_name"),
                        doc.alias("docstring"), text.alias("text"))

    rows = F.array(
        unit("class", service, 3, 20, F.lit(""), F.concat(F.lit("Service of "), F.col("source")), F.lit("class")),
        unit("method", method, 5, 12, service, F.lit(""), F.concat(F.lit("def f(self): return helper"), _s(n % 6), F.lit("(len(x))"))),
        unit("function", run, 22, 40, F.lit(""), F.col("text"), F.concat(run, F.lit("(1); "), method, F.lit(" (2); "), F.col("text"))),
        unit("module", F.lit("<module>"), 1, 60, F.lit(""), F.lit(""), F.lit("import")))
    return d.select(
        F.concat(F.lit("ns"), _s(n % 3)).alias("namespace"),
        F.concat(F.col("source"), F.lit("/u"), _s(n), ext).alias("source_file"),
        lang.alias("language"), imports.alias("imports"), F.explode(rows).alias("u"),
    ).select("namespace", "source_file", "language", "imports", "u.*")


def code_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Code chunks the log entries may point at, one per part."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    path = F.when(k % 9 < 7, F.concat(F.lit("src/mod"), _s(k % 9), F.lit(".py"))).when(
        k % 9 == 7, "app/Service.java").otherwise("lib/parser.py")
    ns = p.select("*", F.explode(F.array(F.lit("ns0"), F.lit("ns1"), F.lit("ns2"))).alias("namespace"))
    return ns.select(
        "namespace", path.alias("source_file"), (k * 10).alias("line_start"), (k * 10 + 9).alias("line_end"),
        F.when(k % 2 == 0, F.concat(F.lit("fn"), _s(k % 5))).otherwise("").alias("function_name"),
        F.when(k % 3 == 0, F.concat(F.lit("Service"), _s(k % 4))).otherwise("").alias("class_name"),
        F.col("p_name").alias("text"))


def index_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Index runs of projects, one per order."""
    o = table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("p"), _s(F.col("o_custkey"))).alias("namespace"), F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("/srv/"), _s(F.col("o_custkey"))).alias("project_path"),
        T.lookup(F.col("o_orderstatus"), {"F": "local", "O": "github"}, "upload").alias("source_type"),
        F.floor("o_totalprice").alias("chunks_stored"), F.col("o_orderdate").cast("timestamp").alias("last_indexed"))


def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("call_no"),
                     (F.col("l_returnflag") == "R").alias("failed"))
