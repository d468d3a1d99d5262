"""Exact substring dedup: suffixes sorted by induction, in shards that spill.

A byte is removed if it is covered by a ``WIDTH``-byte string that also starts in a document with a smaller id.

Shards. In every window of WIDTH bytes the ``GRAM``-byte grams with the smallest hash are its anchors: equal windows have equal
anchors at equal places. An anchor's context is all bytes that a window around it can reach. Anchors that occur in one
document only are dropped; of equal contexts one stands for all, with its smallest document; contexts meet by anchor,
in shuffles that sort and spill on disk, so a shard may be far larger than memory.

Induction. The contexts of some shard rows are sorted together, column by column from the right: the order of
the suffixes at one column follows from the order at the next one by a stable pass over a single byte, and the common
prefix of neighbours is one more than the smallest common prefix between their successors. Where it reaches WIDTH the
windows are equal, and the smallest document of such a run is known. Only suffixes that start at the same distance from
their anchor can be equal, so no other pairs of columns are sorted.

Hot anchors (more than ``HOT`` different contexts, as at the end of a passage that very many documents share) would not fit
into one task's memory: their windows become rows keyed by a 128-bit hash, whose smallest document comes from a pre-aggregated
shuffle. Both ways give the same answer. Members of one context cost a row each and are never gathered: those
that are not the smallest document lose the whole context, whatever else holds.

Defined results: a null text is empty; texts under WIDTH bytes keep everything; a row with a null id keeps everything and
removes nothing; rows with equal ids do not remove from each other; an empty table gives no rows.
Anchors and contexts are compared by 64-bit hashes each (128 bits together).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import drop_kept, keep

WIDTH = 50
GRAM = 16
STARTS = WIDTH - GRAM + 1
BEFORE = STARTS - 1
CONTEXT = BEFORE + WIDTH
HOT = 1 << 16  # a context takes some 300 bytes of the task that sorts it
ROWS = 1 << 12
SHARD = 1 << 15
PIECE = 1 << 19
TAG = 40  # bits of a position; 16 bits of the text's hash stand above it
MISSING = 256

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
SYMBOLS = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)],
                   np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def u64(x: int) -> np.uint64:
    return np.uint64(x & ((1 << 64) - 1))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * u64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            up = np.full(size, u64(BASE))
            down = np.full(size, u64(UNBASE))
            up[0] = down[0] = 1
            _powers[size] = (np.cumprod(up), np.cumprod(down))
    return _powers[size]


def slide(values: np.ndarray, width: int, fold) -> np.ndarray:
    """``fold`` over every run of ``width`` values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = fold(out[:-have], out[have:])
        have *= 2
    return fold(out[: len(out) - (width - have)], out[width - have:]) if have < width else out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, gram hash, context hash and document number of all anchors of texts laid end to end."""
    none = np.empty(0, np.int64)
    if len(data) < WIDTH:
        return none, none, none, none
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)).astype(np.uint64)
    grams = mixed(words[:-8] * u64(0xC2B2AE3D27D4EB4F) + (words[8:] ^ (words[8:] >> np.uint64(31))) * u64(BASE)) | np.uint64(1)
    lowest = slide(grams, STARTS, np.minimum)
    doc_of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    valid = doc_of[: len(lowest)] == doc_of[WIDTH - 1:]
    lowest = np.where(valid, lowest, np.uint64(0))
    padded = np.concatenate([np.zeros(BEFORE, np.uint64), lowest, np.zeros(BEFORE, np.uint64)])
    at = np.flatnonzero(slide(padded, STARTS, np.maximum) == grams)
    doc = doc_of[at]
    first = np.concatenate([[0], ends[:-1]])[doc]
    start, end = np.maximum(at - BEFORE, first), np.minimum(at + WIDTH, ends[doc])
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(SYMBOLS[data] * up[: len(data)], dtype=np.uint64)])
    context = mixed((sums[end] - sums[start]) * down[start] + (at - start).astype(np.uint64) * u64(BASE)
                    + (end - start).astype(np.uint64))
    return at - first, grams[at].view(np.int64), context.view(np.int64), doc


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_batches(pdf: pd.DataFrame):
    """Rows of a batch in pieces of about PIECE bytes (one text is never cut)."""
    held, rows, size = [], [], 0
    for row, text in enumerate(pdf["text"]):
        raw = encoded(text)
        held.append(raw)
        rows.append(row)
        size += len(raw)
        if size >= PIECE:
            yield np.array(rows), held
            held, rows, size = [], [], 0
    if held:
        yield np.array(rows), held


def anchor_rows(texts: DataFrame, whole: bool) -> DataFrame:
    """gram, doc (and context, place) for rows with doc, tag, text."""
    def run(batches):
        for pdf in batches:
            docs, tags = pdf["doc"].to_numpy(), pdf["tag"].to_numpy()
            for rows, raws in text_batches(pdf):
                ends = np.cumsum([len(r) for r in raws])
                at, gram, context, doc = anchors(np.frombuffer(b"".join(raws), np.uint8), ends)
                ids = docs[rows[doc]] if len(doc) else doc
                if whole:
                    place = (tags[rows[doc]] << TAG | at) if len(doc) else at
                    yield pd.DataFrame({"gram": gram, "doc": ids, "context": context, "place": place})
                else:
                    yield pd.DataFrame({"gram": gram, "doc": ids})

    schema = "gram long, doc long" + (", context long, place long" if whole else "")
    return texts.mapInPandas(run, schema)


def context_bytes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, context, doc, hot, before (bytes left of the anchor), bytes for wanted rows gram, context, doc, place, hot."""
    lists = wanted.withColumn("tag", F.shiftright("place", TAG)).groupBy("doc", "tag").agg(
        F.collect_list("gram").alias("grams"), F.collect_list("context").alias("contexts"),
        F.collect_list("hot").alias("hots"), F.collect_list(F.col("place").bitwiseAND((1 << TAG) - 1)).alias("places"))
    columns = ["gram", "context", "doc", "hot", "before", "bytes"]

    def run(batches):
        for pdf in batches:
            out = []
            for doc, text, grams, contexts, hots, places in pdf.itertuples(index=False):
                raw = encoded(text)
                for g, c, h, p in zip(grams, contexts, hots, places, strict=True):
                    start = max(0, p - BEFORE)
                    out.append((g, c, doc, h, p - start, raw[start:p + WIDTH]))
                    if len(out) == SHARD:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    both = texts.join(lists, ["doc", "tag"]).select("doc", "text", "grams", "contexts", "hots", "places")
    return both.mapInPandas(run, "gram long, context long, doc long, hot boolean, before int, bytes binary")


def between(lcp: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest of ``lcp[left + 1 .. right]`` for every pair, by a table of power-of-two minima."""
    table, width = [lcp], 1
    while 2 * width <= len(lcp):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    span = right - left
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(left), lcp.dtype)
    for k in np.unique(level):
        pick = level == k
        out[pick] = np.minimum(table[k][left[pick] + 1], table[k][right[pick] - (1 << int(k)) + 1])
    return out


def earlier_windows(docs: np.ndarray, before: np.ndarray, raws: list[bytes]) -> np.ndarray:
    """Per context the windows (bit: start column) that also start in a smaller document, by induced sorting."""
    n = len(raws)
    sizes = np.fromiter(map(len, raws), np.int64, n)
    columns = np.full((CONTEXT, n), MISSING, np.int16)
    for at in range(0, n, ROWS):
        size = sizes[at:at + ROWS]
        flat = np.frombuffer(b"".join(raws[at:at + ROWS]), np.uint8)
        row = np.repeat(np.arange(at, at + len(size)), size)
        column = np.arange(len(flat)) + np.repeat(BEFORE - before[at:at + ROWS] - (np.cumsum(size) - size), size)
        columns[column, row] = flat
    order = np.arange(n)
    lcp = np.zeros(n, np.uint8)  # common prefix with the neighbour before in ``order``; nothing follows the last column
    mask = np.zeros(n, np.int64)
    for j in range(CONTEXT - 1, -1, -1):
        symbols = columns[j][order]
        moved = np.argsort(symbols, kind="stable")
        same = np.zeros(n, bool)
        same[1:] = symbols[moved[1:]] == symbols[moved[:-1]]
        grown = np.zeros(n, np.uint8)
        where = np.flatnonzero(same)
        if len(where):
            grown[where] = 1 + (between(lcp, moved[where - 1], moved[where]) if j < CONTEXT - 1 else 0)
        order, lcp = order[moved], grown
        if j < STARTS:
            heads = np.flatnonzero(lcp < WIDTH)
            least = np.minimum.reduceat(docs[order], heads)
            smallest = np.repeat(least, np.diff(np.append(heads, n)))
            real = (columns[j][order] != MISSING) & (columns[j + WIDTH - 1][order] != MISSING)
            hit = order[real & (smallest < docs[order])]
            mask[hit] |= 1 << j
    return mask


def sorted_shards(contexts: DataFrame) -> DataFrame:
    """gram, context, mask for contexts with windows that start in a smaller document."""
    def flush(parts):
        pdf = pd.concat(parts, ignore_index=True)
        mask = earlier_windows(pdf["doc"].to_numpy(), pdf["before"].to_numpy(np.int64), pdf["bytes"].tolist())
        hit = mask != 0
        return pd.DataFrame({"gram": pdf["gram"][hit], "context": pdf["context"][hit], "mask": mask[hit]})

    def run(batches):
        held, count = [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            grams = pdf["gram"].to_numpy()
            if count >= SHARD:
                # A shard ends where the anchor changes.
                last = held[-1]["gram"].iloc[-1]
                cut = int(np.argmax(grams != last)) if (grams != last).any() else len(pdf)
                held.append(pdf.iloc[:cut])
                if cut < len(pdf):
                    yield flush(held)
                    held, count = [pdf.iloc[cut:]], len(pdf) - cut
                continue
            held.append(pdf)
            count += len(pdf)
        if held:
            yield flush(held)

    dealt = contexts.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInPandas(run, "gram long, context long, mask long")


def hot_windows(contexts: DataFrame) -> DataFrame:
    """The same for contexts of hot anchors, by a shuffle of their windows."""
    def run(batches):
        for pdf in batches:
            out = []
            for g, c, d, before, raw in pdf[["gram", "context", "doc", "before", "bytes"]].itertuples(index=False):
                for s in range(len(raw) - WIDTH + 1):
                    h = hashlib.blake2b(raw[s:s + WIDTH], digest_size=16).digest()
                    out.append((g, c, d, BEFORE - before + s, int.from_bytes(h[:8], "little", signed=True),
                                int.from_bytes(h[8:], "little", signed=True)))
            yield pd.DataFrame(out, columns=["gram", "context", "doc", "start", "w1", "w2"])

    windows = keep(contexts.mapInPandas(
        run, "gram long, context long, doc long, start int, w1 long, w2 long"), "windows")
    least = windows.groupBy("gram", "w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    least = least.where("least < most").drop("most")
    later = windows.join(least, ["gram", "w1", "w2"]).where("least < doc")
    return later.groupBy("gram", "context").agg(F.bit_or(F.expr("shiftleft(1L, start)")).alias("mask"))


def removed_runs(places: list[int], masks: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that are removed; bit j of a mask: the window from place - BEFORE + j."""
    at = np.asarray(places, np.int64)
    m = np.asarray(masks, np.int64)
    bits = (m[:, None] >> np.arange(STARTS)) & 1
    starts = np.unique((at[:, None] - BEFORE + np.arange(STARTS))[bits.astype(bool)])
    starts = starts[(starts >= 0) & (starts + WIDTH <= size)]
    if not len(starts):
        return starts, starts
    apart = np.flatnonzero(np.diff(starts) > WIDTH) + 1
    return starts[np.append(0, apart)], starts[np.append(apart - 1, len(starts) - 1)] + WIDTH


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, tag, places, masks: per document the anchors around which windows are removed."""
    texts = tagged(docs, id_col, text_col).where("doc is not null")
    texts = texts.where(F.octet_length("text") >= WIDTH)
    shared = anchor_rows(texts, False).groupBy("gram").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    # Kept for itself, so that its shuffle is gone before the anchors are shuffled in full.
    shared = keep(shared.where("lo < hi").select("gram"), "shared")
    members = keep(anchor_rows(texts, True).join(shared, "gram"), "anchors")
    drop_kept(shared)
    firsts = members.groupBy("gram", "context").agg(
        F.min("doc").alias("doc"), F.min_by("place", "doc").alias("place"))
    firsts = keep(firsts, "contexts")
    kinds = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = firsts.join(kinds, "gram").withColumn("hot", F.col("kinds") > HOT).drop("kinds")
    found = keep(context_bytes(texts, wanted), "context-bytes")
    masks = sorted_shards(found.where("not hot")).unionByName(hot_windows(found.where("hot")))
    answers = keep(firsts.select("gram", "context", F.col("doc").alias("least")).join(
        masks, ["gram", "context"], "left"), "answers")
    every = F.lit((1 << STARTS) - 1)
    drop_kept(found, firsts)
    lost = members.join(answers, ["gram", "context"]).select(
        "doc", "place", F.when(F.col("doc") > F.col("least"), every).otherwise(F.coalesce("mask", F.lit(0))).alias("mask"))
    lost = lost.where("mask != 0").withColumn("tag", F.shiftright("place", TAG))
    lost = keep(lost.groupBy("doc", "tag").agg(
        F.collect_list(F.col("place").bitwiseAND((1 << TAG) - 1)).alias("places"), F.collect_list("mask").alias("masks")), "lost")
    drop_kept(members, answers)
    return lost


def tagged_columns(id_col: str, text_col: str) -> dict[str, Column]:
    text = F.col(text_col)
    tag = F.coalesce(F.xxhash64(text).bitwiseAND(0xFFFF), F.lit(0))
    return {"doc": F.col(id_col).cast("long"), "tag": tag, "text": text}


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*[c.alias(k) for k, c in tagged_columns(id_col, text_col).items()])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay), spans (start, end of removed runs) for every row, and ``carry``;
    ``as_text`` gives kept_text (the characters that stay whole) in place of kept."""
    lost = find_repeats(docs, id_col, text_col)
    carry = carry or []
    extra = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]
    rows = docs.select(*extra, *[tagged_columns(id_col, text_col)[k].alias(k) for k in ("doc", "tag", "text")])
    both = rows.join(lost, ["doc", "tag"], "left").select("doc", "text", "places", "masks", *[
        f"_carry{i}" for i in range(len(carry))])
    name, kind = ("kept_text", "string") if as_text else ("kept", "binary")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            sizes, kept, spans = [], [], []
            for text, places, masks in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw = encoded(text)
                starts, ends = removed_runs(places, masks, len(raw)) if places else ([], [])
                cuts = np.concatenate([[0], np.ravel(np.column_stack([starts, ends])), [len(raw)]]).astype(int)
                sizes.append(len(raw))
                stay = [raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
                kept.append("".join(x.decode("utf-8", "ignore") for x in stay) if as_text else b"".join(stay))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)])
            made = [pa.array(sizes, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(spans, span)]
            names = ["doc_id", "n_bytes", name, "spans", *batch.schema.names[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[4:]], names=names)

    kinds = ", ".join(f"_carry{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = both.mapInArrow(run, f"doc_id long, n_bytes long, {name} {kind}, spans array<struct<start:long,end:long>>"
                          + (f", {kinds}" if kinds else ""))
    return out.select("doc_id", "n_bytes", name, "spans", *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)])
