"""Log lines to log entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.session import cut

FILE = ["namespace", "source_file"]
LINES_PER_BLOCK = 4096


def read_log_lines(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """(namespace, source_file, split, text): lines of the log files of a folder; ``.log .out .txt .err`` count as logs here.

    Large files are read in byte ranges by many tasks; a line belongs to the range it starts in. Lines of a range come in file
    order, and ``split`` is where the range starts. Bytes that are no UTF-8 become replacement characters.
    """
    glob = "*{" + ",".join(V.LOG_DIR_EXTENSIONS) + "}"
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # paths come percent-encoded
    return lines.select(
        F.lit(namespace).alias("namespace"), file.alias("source_file"),
        F.col("_metadata.file_block_start").alias("split"), F.make_valid_utf8("value").alias("text"))


def number_lines(files: DataFrame) -> DataFrame:
    """(namespace, source_file, text) to lines numbered from 1; narrow, one file stays in its task."""
    return files.select(*FILE, F.posexplode(T.lines_of(F.col("text"))).alias("_pos", "line")).select(
        *FILE, (F.col("_pos") + 1).cast("bigint").alias("line_no"), F.col("line").alias("text"))


def _join_lines() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return F.array_join(F.transform(ordered, lambda s: s["text"]), "\n")


def _finish(blocks: DataFrame) -> DataFrame:
    text = F.col("text")
    return blocks.select(
        *FILE, "line_start", "line_end", text, T.ingest_severity(text).alias("severity"),
        T.entry_timestamp(text).alias("detected_timestamp"), T.basename(F.col("source_file")).alias("file_name"))


# ---- entries, split by split ------------------------------------------------------------

_PIECE = "namespace string, source_file string, split bigint, kind string, at bigint, lines bigint, entry bigint, text string"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (namespace, source_file, split, opens, text) in file order, to pieces of entries.

    ``inner``: up to 80 lines that no other split can add to. ``line``: a line before the split's first opening line, or of its last,
    unfinished piece. ``end``: the number of lines of the split and where its last entry opens. Places count from the split's start.
    """
    out: list[tuple] = []
    place, at, entry, held = None, 0, None, []

    def close(last: bool) -> None:
        if not held:
            return
        first = at - len(held)
        if last or entry is None:
            out.extend((*place, "line", first + i, 1, entry, t) for i, t in enumerate(held))
        else:
            out.append((*place, "inner", first, len(held), entry, "\n".join(held)))
        held.clear()

    def finish() -> None:
        if place is not None:
            close(last=True)
            out.append((*place, "end", 0, at, entry, None))

    for pdf in batches:
        for ns, file, split, opens, text in pdf[[*FILE, "split", "opens", "text"]].itertuples(index=False):
            if (ns, file, split) != place:
                finish()
                place, at, entry = (ns, file, split), 0, None
            if opens:
                close(last=False)
                entry = at
            held.append(text)
            at += 1
            if entry is None or (at - entry) % V.MAX_ENTRY_LINES == 0:
                close(last=False)
        if len(out) >= 8192:
            yield pd.DataFrame(out, columns=_COLUMNS)
            out.clear()
    finish()
    yield pd.DataFrame(out, columns=_COLUMNS)


_COLUMNS = ["namespace", "source_file", "split", "kind", "at", "lines", "entry", "text"]


def pieces_of(lines: DataFrame) -> DataFrame:
    """Pieces of lines that stand in file order in each task, with the number of their split. Texts move to no other task here."""
    marked = lines.select(*FILE, F.col("split").cast("bigint").alias("split"), F.col("text").rlike(V.ENTRY_START).alias("opens"), "text")
    return marked.mapInPandas(_pieces, _PIECE)


def _later_ends(pieces: DataFrame) -> DataFrame:
    """(namespace, source_file, split, offset, carried) of the splits behind the first one of a file: the lines before a split
    and where the entry it starts in opens. Files of one split, however many there are, have no row here."""
    ends = pieces.where("kind = 'end'").select(*FILE, "split", "lines", "entry")
    before = Window.partitionBy(*FILE).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("lines").over(before), F.lit(0).cast("bigint"))
    ends = ends.withColumn("offset", offset)
    carried = F.coalesce(F.max(F.col("offset") + F.col("entry") + 1).over(before), F.lit(1).cast("bigint"))
    return ends.select(*FILE, "split", "offset", carried.alias("carried")).where("split > 0")


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with line_no (of the first line, from 1) and the entry's first line, from one row per split behind a file's first."""
    rows = pieces.where("kind <> 'end'").join(_later_ends(pieces), [*FILE, "split"], "left").fillna({"offset": 0, "carried": 1})
    opened = F.coalesce(F.col("offset") + F.col("entry") + 1, F.col("carried"))
    return rows.select(*FILE, "kind", (F.col("offset") + F.col("at") + 1).alias("line_no"), "lines", opened.alias("entry"), "text")


def entries_of(pieces: DataFrame) -> DataFrame:
    """Entries of at least 60 trimmed characters from (stored) pieces; only lines at the borders of splits are shuffled."""
    placed = _placed(pieces)
    whole = placed.where("kind = 'inner'").select(
        *FILE, F.col("line_no").alias("line_start"), (F.col("line_no") + F.col("lines") - 1).alias("line_end"), "text")
    part = F.floor((F.col("line_no") - F.col("entry")) / V.MAX_ENTRY_LINES)
    loose = placed.where("kind = 'line'").withColumn("part", part).groupBy(*FILE, "entry", "part").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), _join_lines().alias("text"))
    blocks = whole.unionByName(loose.select(*whole.columns))
    kept = blocks.withColumn("text", T.strip(F.col("text"))).where(F.length("text") >= V.MIN_CHUNK_CHARS)
    return _finish(kept)


def log_entries(lines: DataFrame) -> DataFrame:
    """Entries of numbered lines (namespace, source_file, line_no, text); lines go to their block of the file once."""
    block = F.floor((F.col("line_no") - 1) / LINES_PER_BLOCK)
    ordered = lines.withColumn("split", block).repartition(*FILE, "split").sortWithinPartitions(*FILE, "line_no")
    return entries_of(cut(pieces_of(ordered), "pieces"))


def log_dir_chunks(lines: DataFrame) -> DataFrame:
    """Chunks of a log folder's lines as ``read_log_lines`` gives them, with ``ord``: files by path, then lines.

    Files without an opening line and without an entry are cut into windows instead.
    """
    pieces = cut(pieces_of(lines), "pieces")
    entries = cut(entries_of(pieces), "entries")
    opened = pieces.where("kind = 'end' and entry is not null").select(*FILE).distinct()
    bare = pieces.select(*FILE).distinct().join(opened, FILE, "left_anti").join(entries.select(*FILE).distinct(), FILE, "left_anti")
    rest = _finish(windows_of_lines(_placed(pieces.join(bare, FILE, "left_semi")).select(*FILE, "line_no", "text")))
    both = entries.unionByName(rest)
    files = both.select(*FILE).distinct().withColumn("_file", F.row_number().over(Window.partitionBy("namespace").orderBy("source_file")))
    place = F.col("_file") * F.lit(1 << 40) + F.col("line_start")
    return both.join(files, FILE).withColumn("ord", place).drop("_file")


def windows_of_lines(lines: DataFrame) -> DataFrame:
    """40-line windows every 32 lines over numbered lines; each line is in one or two windows."""
    at = F.col("line_no") - 1
    last = F.floor(at / V.WINDOW_STEP)
    first = F.greatest(F.lit(0), F.ceil((at - (V.WINDOW_LINES - 1)) / V.WINDOW_STEP))
    spread = lines.withColumn("window", F.explode(F.sequence(first, last)))
    blocks = spread.groupBy(*FILE, "window").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), _join_lines().alias("text"))
    return blocks.where(F.length(T.strip(F.col("text"))) >= V.MIN_CHUNK_CHARS).drop("window")


def log_fallback(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Windows of the files where no line opens an entry and no entry survived."""
    structured = lines.where(F.col("text").rlike(V.ENTRY_START)).select(*FILE).distinct()
    open_files = lines.join(structured, FILE, "left_anti").join(entries.select(*FILE).distinct(), FILE, "left_anti")
    return _finish(windows_of_lines(open_files))


def log_chunks(lines: DataFrame) -> DataFrame:
    entries = log_entries(lines)
    return entries.unionByName(log_fallback(lines, entries))
