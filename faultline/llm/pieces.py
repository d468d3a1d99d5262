"""SentencePiece encoding and decoding over a relational lattice.

Encoding. White space becomes the space mark and a text gets one in front, as the model's normaliser does; texts are cut into
words where no piece of the model can reach across, so words are encoded one by one. The words of the whole corpus
are counted, and those of the dictionary (the most frequent ones, at most ``DICTIONARY``) get a lattice: their bounded-length
substrings are exploded and joined with the piece table, the edges found are grouped by word, and a SQL fold over the
edges gives the segmentation. For a unigram model that is Viterbi's best path. A byte-pair model has no additive
path score: its segmentation is the outcome of merges in order of piece score, so there the fold walks the same lattice
merge by merge (boundaries as bits of one number). The dictionary goes to the tasks, which is safe as its size is
bounded; words beyond it are encoded by the same rules where they occur, kept per task until there are ``FLUSH`` of them. Characters without a
piece become the pieces of their UTF-8 bytes, or the unknown piece in models without such pieces.

Decoding joins the bytes of the pieces; ``decoded`` of ``encoded`` gives the text back whenever it holds no space mark of its own.

Defined results: null and empty texts have no tokens (decoded: empty); repeated rows are encoded each; an empty table gives no
rows; other columns are not read. The model's path is a parameter and is read on the driver only.
"""

from __future__ import annotations

import heapq
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import keep

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
DICTIONARY = 1 << 17
LONGEST_WORD = 60  # of the dictionary: a boundary is a bit of a 64-bit number
FLUSH = 1 << 17
SLICE = 512
UNIGRAM, BPE = 1, 2


def proto_fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at:at + size]
            at += size


@dataclass
class Pieces:
    """What encoding needs of a model. kind: UNIGRAM or BPE; text pieces with id and score; bytes of every id."""

    kind: int
    scores: dict[str, tuple[float, int]]
    byte_ids: list[int]
    unknown: int
    raw: list[bytes]
    prefix: bool = True
    longest: int = field(init=False)
    words: re.Pattern = field(init=False)
    costs: dict[str, float] = field(init=False)

    def __post_init__(self) -> None:
        self.costs = {p: -s for p, (s, _) in self.scores.items()}
        self.longest = max((len(p) for p in self.scores), default=1)
        inner = {c for p in self.scores if len(p) > 1 for c in p if c != MARK}
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("pieces with white space behind other characters are not supported")
        letters = "".join(map(re.escape, sorted(inner)))
        self.words = re.compile(
            f"{MARK}+[{letters}]*|[{letters}]+|[^{MARK}{letters}]" if letters else f"{MARK}+|[^{MARK}]", re.DOTALL)
        self.least = min((s for s, _ in self.scores.values()), default=0.0) - 10.0

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.words.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def single(self, char: str) -> list[int]:
        known = self.scores.get(char)
        if known is not None:
            return [known[1]]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        out: list[int] = []
        if self.kind == BPE and len(word) <= LONGEST_WORD:
            for part in self.merged_short(word):
                out += self.single(part) if len(part) == 1 else [self.scores[part][1]]
            return out
        spans = self.merged(word) if self.kind == BPE else self.best_path(word)
        for s, e in spans:
            out += self.single(word[s]) if e == s + 1 else [self.scores[word[s:e]][1]]
        return out

    def merged_short(self, word: str) -> list[str]:
        """The same merges for short words, where scanning all neighbours is cheaper than a heap."""
        get, never = self.costs.get, float("inf")
        parts = list(word)
        costs = [get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (best := min(costs)) != never:
            i = costs.index(best)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], never)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], never)
        return parts

    def merged(self, word: str) -> list[tuple[int, int]]:
        """Merges in order of score, the leftmost first; a heap keeps long words cheap."""
        n = len(word)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (found := self.scores.get(word[i:end[j]])) is not None:
                heapq.heappush(heap, (-found[0], i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = nxt[i]
            if end[i] == -1 or j >= n or end[j] != e:
                continue
            nxt[i], end[i], end[j] = nxt[j], e, -1
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        out, i = [], 0
        while i < n:
            out.append((i, end[i]))
            i = nxt[i]
        return out

    def best_path(self, word: str) -> list[tuple[int, int]]:
        n = len(word)
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                found = self.scores.get(word[s:e])
                score = found[0] if found else self.least if e == s + 1 else None
                if score is not None and best[s] + score > best[e]:
                    best[e], back[e] = best[s] + score, s
        out, e = [], n
        while e:
            out.append((back[e], e))
            e = back[e]
        return out[::-1]


def load(path: str = MODEL) -> Pieces:
    with open(path, "rb") as f:
        message = f.read()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=message)
    kind = next((v for n, t in proto_fields(message) if n == 2 for m, v in proto_fields(t) if m == 3), UNIGRAM)
    scores: dict[str, tuple[float, int]] = {}
    byte_of: dict[int, int] = {}
    raw = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_of[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            raw.append(b"")
        else:
            scores[piece] = (model.get_score(i), i)
            raw.append(piece.replace(MARK, " ").encode())
    return Pieces(kind, scores, [byte_of[b] for b in range(256)] if len(byte_of) == 256 else [], model.unk_id(), raw)


def word_counts(docs: DataFrame, text_col: str, pieces: Pieces) -> DataFrame:
    """word, n over all texts, counted in every task before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        from collections import Counter

        def table(counts: Counter[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                              names=["word", "n"])

        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(shared.value.split(text))
                if len(counts) > FLUSH:
                    yield table(counts)
                    counts.clear()
        if counts:
            yield table(counts)

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Words from some count on, so that there are at most ``most`` of them."""
    top = 1 << 20
    rows = counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, total = top, 0
    for n, words in sorted(((r["n"], r["words"]) for r in rows), reverse=True):
        total += words
        if total > most:
            break
        least = n
    return counts.where(F.col("n") >= least).select("word")


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, edges: for every word the pieces it holds as (start, end, score, id), best score and leftmost first."""
    spark = words.sparkSession
    table = spark.createDataFrame([(p, s, i) for p, (s, i) in pieces.scores.items()], "piece string, score double, id int")
    spans = F.expr(f"""flatten(transform(sequence(0, char_length(word) - 1), s -> transform(
        sequence(s + 1, least(char_length(word), s + {pieces.longest})),
        e -> struct(s as s, e as e, substring(word, s + 1, e - s) as piece))))""")
    cut = words.where(F.col("word") != "").select("word", F.explode(spans).alias("x")).select("word", "x.*")
    # The piece table has the size of the model's vocabulary, whatever the corpus.
    edges = cut.join(F.broadcast(table), "piece").groupBy("word").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("cost"), "s", "e", "id"))).alias("edges"))
    return words.join(edges, "word", "left").withColumn(
        "edges", F.coalesce("edges", F.expr("cast(array() as array<struct<cost:double,s:int,e:int,id:int>>)")))


def folded(lattices: DataFrame, pieces: Pieces) -> DataFrame:
    """word, ids: the segmentation of each lattice, by a fold over its edges."""
    lattices = lattices.withColumn("n", F.char_length("word"))
    if pieces.kind == BPE:
        inner = "shiftleft(1L, e.e) - shiftleft(1L, e.s + 1)"
        marked = lattices.withColumn("edges", F.expr(
            f"transform(edges, e -> struct(e.s as s, e.e as e, e.id as id, {inner} as inside))"))
        bounds = F.expr("""aggregate(sequence(1, n), shiftleft(1L, n + 1) - 1, (b, i) -> coalesce(get(transform(slice(
            filter(edges, e -> (shiftright(b, e.s) & 1) = 1 and (shiftright(b, e.e) & 1) = 1
                and bit_count(b & e.inside) = 1), 1, 1), e -> b & ~e.inside), 0), b))""")
        marked = marked.withColumn("bounds", bounds).withColumn(
            "cuts", F.expr("filter(sequence(0, n), i -> (shiftright(bounds, i) & 1) = 1)"))
        spans = "transform(sequence(1, size(cuts) - 1), k -> struct(cuts[k - 1] as s, cuts[k] as e))"
    else:
        # best[i]: cost and last start of the best path to i; edges that end at i extend the paths to their starts.
        best = F.expr(f"""aggregate(sequence(1, n), array(struct(0D as cost, 0 as back)), (a, i) -> concat(a, array(
            array_min(concat(array(struct(a[i - 1].cost + {-pieces.least}D as cost, i - 1 as back)),
                transform(filter(edges, e -> e.e = i), e -> struct(a[e.s].cost + e.cost as cost, e.s as back)))))))""")
        marked = lattices.withColumn("best", best).withColumn("cuts", F.expr("""reverse(aggregate(
            sequence(1, n), array(n), (c, i) -> if(element_at(c, -1) = 0, c,
                concat(c, array(best[element_at(c, -1)].back)))))"""))
        spans = "transform(sequence(1, size(cuts) - 1), k -> struct(cuts[k - 1] as s, cuts[k] as e))"
    if pieces.byte_ids:
        byte_array = "array(" + ",".join(map(str, pieces.byte_ids)) + ")"
        missing = f"""transform(sequence(1, octet_length(substring(word, x.s + 1, 1))), k -> {byte_array}[cast(conv(
            substring(hex(encode(substring(word, x.s + 1, 1), 'UTF-8')), 2 * k - 1, 2), 16, 10) as int)])"""
    else:
        missing = f"array({pieces.unknown})"
    ids = F.expr(f"""flatten(transform({spans}, x -> coalesce(get(transform(
        filter(edges, e -> e.s = x.s and e.e = x.e), e -> array(e.id)), 0), {missing})))""")
    return marked.select("word", ids.alias("ids"))


def dictionary(docs: DataFrame, text_col: str, pieces: Pieces, most: int = DICTIONARY) -> dict[str, bytes]:
    """Encodings (32-bit ids) of the most frequent words of the corpus; at most ``most`` words of bounded length."""
    counts = keep(word_counts(docs, text_col, pieces), "words")
    words = frequent(counts.where(F.char_length("word") <= LONGEST_WORD), most)
    found = keep(folded(lattice(words, pieces), pieces), "word-ids")
    rows = found.toPandas()
    return {w: np.asarray(ids, np.int32).tobytes() for w, ids in zip(rows["word"], rows["ids"], strict=True)}


class Encodings(dict):
    """Words with the bytes of their ids, filled as they are asked for; ``odd``: those that do not decode to themselves."""

    def __init__(self, pieces: Pieces, words: dict[str, bytes]) -> None:
        super().__init__()
        self.pieces, self.words, self.odd = pieces, words, set()

    def __missing__(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = array("i", self.pieces.encode_word(word)).tobytes()
        self[word] = ids
        if raw_of(array("i", ids), self.pieces) != word.replace(MARK, " ").encode("utf-8", "surrogatepass"):
            self.odd.add(word)
        return ids

    def trim(self) -> None:
        if len(self) > len(self.words) + FLUSH:
            self.clear()
            self.odd.clear()

    def text(self, text: str | None) -> tuple[bytes, bool]:
        """The ids and whether they decode to the text: they do if every word does and no mark of its own is in it."""
        words = self.pieces.split(text)
        ids = b"".join(map(self.__getitem__, words))
        if self.odd and not self.odd.isdisjoint(words):
            return ids, decode_ids(array("i", ids), self.pieces) == text
        return ids, not text or MARK not in text


def encoded(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text",
            most: int = DICTIONARY) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (decoding gives the text back) for every row."""
    pieces = load(path)
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(dictionary(docs, text_col, pieces, most))
    shared = sc.broadcast(pieces)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encodings = Encodings(shared.value, known.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                encodings.trim()
                raws, same = zip(*map(encodings.text, batch.column(1).to_pylist()), strict=True)
                sizes = np.array([len(r) // 4 for r in raws], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raws), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), ids, pa.array(sizes), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "round_trip"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>, n_tokens long, round_trip boolean")


def raw_of(ids, pieces: Pieces) -> bytes:
    return b"".join([pieces.raw[i] for i in ids])


def decode_ids(ids, pieces: Pieces) -> str:
    raw = raw_of(ids, pieces)
    return (raw[1:] if pieces.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def decoded(tokens: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text for rows with token ids (null ids: empty text)."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(path))
    id_type = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            texts = [decode_ids(np.asarray(x if x is not None else [], np.int64), shared.value) for x in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(
        run, f"doc_id {id_type}, text string")
