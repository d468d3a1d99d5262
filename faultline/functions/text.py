"""Text features as Column expressions: severities, times, fingerprints, references, question terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions import vocab as V

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
UNIX = "(?d)"


def unicode_words(pattern: str) -> str:
    """Make ``\\w``, ``\\d``, ``\\s`` and ``\\b`` of a pattern cover all scripts."""
    return "(?U)" + pattern


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def normalise_newlines(c: Column) -> Column:
    return F.when(c.contains("\r"), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def lines_of(c: Column) -> Column:
    """Lines of a text; a final newline does not open another line."""
    parts = F.split(normalise_newlines(c), "\n", -1)
    return F.when(F.length(c) == 0, F.slice(parts, 1, 0)).when(
        normalise_newlines(c).endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, r"[/\\]"), -1)


def matches_any(c: Column, patterns: Iterable[str], flags: str = "(?i)") -> Column:
    """One alternation instead of a chain, so each text is scanned by one compiled pattern."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return c.rlike("(?U)" + flags + joined)


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(UNIX + pattern), F.lit(group))


# A pattern opening with a run of word characters is tried from every letter of every word. A match
# can only begin at the start of such a run or right after the match before it; saying so makes the
# search linear and changes no result.
RUN_START = r"(?:(?<![\w.])|\G)"


def _from_run_start(pattern: str, run: str) -> str:
    return pattern.replace(run, RUN_START + run)


EXCEPTION = V.EXCEPTION.replace("(?i)(", "(?i)" + RUN_START + "(")
EXCEPTION_NO_PANIC = V.EXCEPTION_NO_PANIC.replace("(?i)(", "(?i)" + RUN_START + "(")
STACK_FRAME = _from_run_start(V.STACK_FRAME, r"[\w.]+\.(?:py")
EXCEPTION_HINT = "(?i)error|exception|fault|failure|panic"


def non_empty(c: Column) -> Column:
    """The text, or null if it is empty; ``c`` is evaluated once."""
    return F.try_element_at(F.filter(F.array(c), lambda x: x != ""), F.lit(1))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Constant lookup table; the key is evaluated once, however long the table is."""
    number = all(isinstance(k, int) for k in table)
    keys = [F.lit(k).cast("bigint") if number else F.lit(k) for k in table]
    pairs = [c for k, v in zip(keys, table.values()) for c in (k, F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), key.cast("bigint") if number else key)
    return found if default is None else F.coalesce(found, F.lit(default))


# ---- severities and times ---------------------------------------------------------------


def _first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    expr = None
    for label, pattern in rules:
        hit = c.rlike(pattern)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr.otherwise(default)


def ingest_severity(text: Column) -> Column:
    return _first_rule(text, V.INGEST_SEVERITY, "info")


def severity(text: Column) -> Column:
    return _first_rule(first_line(text), V.ANALYSIS_SEVERITY, "unknown")


def entry_timestamp(text: Column) -> Column:
    raw = F.regexp_extract(first_line(text), V.TIMESTAMP, 1)
    return F.try_to_timestamp(F.translate(raw, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---- fingerprints -----------------------------------------------------------------------


def normalise_error(text: Column) -> Column:
    out = F.substring(first_line(text), 1, 200)
    for pattern, replacement in V.NORMALISE:
        out = F.regexp_replace(out, pattern, replacement)
    return F.lower(strip(out))


def _named_exception(text: Column) -> Column:
    """First exception name that is no bare level word, else null."""
    def base(hit: Column) -> Column:
        return strip(F.substring_index(hit, ":", 1))

    named = F.filter(F.transform(extract_all(text, EXCEPTION, 1), base), lambda b: ~F.lower(b).isin(V.LEVEL_WORDS))
    return F.when(text.rlike(EXCEPTION_HINT), F.try_element_at(named, F.lit(1)))


def exception_type(text: Column) -> Column:
    return F.coalesce(_named_exception(text), F.lit(""))


def stack_frames(text: Column) -> Column:
    """Every frame in order, repeats included."""
    return F.transform(extract_all(text, STACK_FRAME), lambda m: F.lower(strip(m)))


def file_line_refs(text: Column) -> Column:
    files, lines = extract_all(text, V.FILE_LINE, 1), extract_all(text, V.FILE_LINE, 2)
    return F.zip_with(files, lines, lambda f, n: F.struct(f.alias("file"), n.cast("bigint").alias("line")))


def class_methods(text: Column) -> Column:
    owners, names = extract_all(text, V.CLASS_METHOD, 1), extract_all(text, V.CLASS_METHOD, 2)
    pairs = F.zip_with(owners, names, lambda c, m: F.struct(c.alias("owner"), m.alias("method")))
    return F.filter(pairs, lambda p: ~p["owner"].isin(V.STOP_CLASSES))


def function_refs(text: Column) -> Column:
    return F.array_union(
        extract_all(text, V.FUNCTION_WORD, 1), F.transform(class_methods(text), lambda p: p["method"])
    )


def error_signature(text: Column) -> Column:
    message = F.regexp_replace(
        F.regexp_replace(normalise_error(text), V.LEVEL_PREFIX, ""), V.TS_PREFIX, ""
    )
    place = F.try_element_at(
        F.transform(F.slice(file_line_refs(text), 1, 1),
                    lambda r: F.concat(F.lit("loc:"), r["file"], F.lit(":"), r["line"].cast("string"))), F.lit(1))
    return F.coalesce(
        F.concat(F.lit("exc:"), _named_exception(text)),
        F.concat(F.lit("msg:"), non_empty(F.substring(message, 1, 100))),
        place,
        F.concat(F.lit("raw:"), F.lower(strip(F.substring(text, 1, 50)))))


def clean_signature(signature: Column) -> Column:
    """Signature without its kind prefix."""
    return F.substring(signature, 5, 1 << 30)


def failure_signature(text: Column) -> Column:
    def tidy(hit: Column) -> Column:
        return F.substring(F.regexp_replace(strip(hit), r"\s+", " "), 1, 120)

    named = F.filter(F.transform(extract_all(text, EXCEPTION_NO_PANIC, 1), tidy), lambda s: ~F.lower(s).isin(V.LEVEL_WORDS))
    return F.coalesce(
        F.when(text.rlike(EXCEPTION_HINT), F.try_element_at(named, F.lit(1))),
        F.concat(F.lit("HTTP "), non_empty(F.regexp_extract(text, V.HTTP_STATUS, 1))),
        F.when(text.rlike(V.TIMED_OUT), F.lit("Connection timeout")))


def tokens(message: Column) -> Column:
    """Distinct blank-separated tokens."""
    return F.array_distinct(F.filter(F.split(message, r"\s+"), lambda t: t != ""))


def signature_similarity(a: Column, b: Column) -> Column:
    kind_a, kind_b = F.substring(a, 1, 4), F.substring(b, 1, 4)
    va, vb = clean_signature(a), clean_signature(b)
    ta, tb = tokens(va), tokens(vb)
    jaccard = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    return (
        F.when(a == b, 1.0)
        .when(kind_a != kind_b, 0.0)
        .when(kind_a == "exc:", F.when(va.contains(vb) | vb.contains(va), 0.8).otherwise(0.0))
        .when((kind_a == "msg:") & (F.size(ta) > 0) & (F.size(tb) > 0), jaccard)
        .otherwise(0.0)
    )


def keywords(text: Column) -> Column:
    found = F.transform(extract_all(text, V.KEYWORD_TOKEN), lambda t: F.lower(t))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in V.KEYWORD_STOPWORDS]))


# ---- vectors and ranking scores ---------------------------------------------------------


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot product of two unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return 1.0 - F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def confidence_of(distance: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance)), 4)


def confidence_label(confidence: Column) -> Column:
    return (
        F.when(confidence >= V.LABEL_HIGH, "high").when(confidence >= V.LABEL_MEDIUM, "medium").otherwise("low")
    )


def recency_boost(ts: Column, ref_time: Column) -> Column:
    age = ref_time.cast("long") - ts.cast("long")
    return (
        F.when(ts.isNull(), 0.0).when(age <= 86400, V.BOOST_DAY).when(age <= 7 * 86400, V.BOOST_WEEK).otherwise(0.0)
    )


# ---- repositories and paths -------------------------------------------------------------


def repo_url_ok(url: Column) -> Column:
    scheme = F.lower(F.coalesce(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return scheme.isin("http", "https") & (host != "") & (F.btrim(url_path(url), F.lit("/")) != "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")


def repo_owner_name(url: Column) -> tuple[Column, Column]:
    trimmed = F.regexp_replace(F.btrim(url_path(url), F.lit("/")), r"\.git$", "")
    parts = F.split(trimmed, "/")
    owner = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit(""))
    return owner, F.element_at(parts, -1)


def extension(path: Column) -> Column:
    """Lower-case suffix of the file name, '' if it has none (a leading dot is not a suffix)."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def display_language(path: Column) -> Column:
    return lookup(extension(path), V.DISPLAY_LANGUAGE, "")


def detect_language(path: Column) -> Column:
    """The table is tested in order with 'ends with', so dot files such as .env count too."""
    name = F.lower(basename(path))
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return F.when(name.endswith(".env.example"), "config").otherwise(
        lookup(suffix, V.LANGUAGE_BY_EXTENSION, "text")
    )


# ---- questions and answers --------------------------------------------------------------


def contains_any(c: Column, words: Iterable[str]) -> Column:
    hit = None
    for w in words:
        hit = c.contains(w) if hit is None else hit | c.contains(w)
    return hit


def search_terms(question: Column) -> Column:
    q = F.lower(question)
    none = F.array().cast("array<string>")
    mapped = F.concat(*[
        F.when(q.contains(word), F.array(*[F.lit(t) for t in terms])).otherwise(none)
        for word, terms in V.SEARCH_TERMS.items()
    ])
    default = F.array(*[F.lit(t) for t in V.DEFAULT_SEARCH_TERMS])
    asks_for_logs = q.rlike(unicode_words(V.LOG_WORD))
    return F.when(F.size(mapped) > 0, F.array_distinct(mapped)).when(asks_for_logs, default).otherwise(none)


def keyword_variant(question: Column) -> Column:
    words = F.regexp_extract_all(question, F.lit(r"[a-zA-Z0-9_./-]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(V.QUESTION_STOPWORDS) & (F.length(w) > 1))
    return F.array_join(kept, " ")


def synonym_variant(question: Column) -> Column:
    """First word of the table that occurs and has an unused substitute, replaced once."""
    q = F.lower(question)
    options = []
    for word, substitutes in V.SYNONYMS.items():
        present = q.rlike(rf"(?U)\b{word}\b")
        fresh = F.try_element_at(
            F.filter(F.array(*[F.lit(s) for s in substitutes]), lambda s: ~F.contains(q, F.lower(s))), F.lit(1)
        )
        swapped = F.regexp_replace(question, rf"(?siU)^(.*?)\b{word}\b", F.concat(F.lit("$1"), fresh))
        options.append(F.when(present & fresh.isNotNull(), swapped))
    return F.coalesce(*options, F.lit(""))


def technical_variant(question: Column) -> Column:
    found = F.concat(*[
        F.regexp_extract_all(question, F.lit(unicode_words(shape)), F.lit(0)) for shape in V.TECHNICAL_SHAPES
    ])
    return F.array_join(F.array_distinct(found), " ")


def looks_truncated(answer: Column) -> Column:
    text = F.rtrim(answer, F.lit(WHITESPACE))
    open_end = (F.length(text) > 60) & ~F.lit(V.TERMINAL_CHARS).contains(F.right(text, F.lit(1)))
    tail = F.lower(F.right(text, F.lit(120)))
    return open_end | contains_any(tail, [s.lower() for s in V.TRUNCATION_SIGNALS])


def too_short(answer: Column) -> Column:
    return F.length(strip(answer)) < 120
