"""Mixture-controlled packing: deficit round-robin over source queues, without moving the tokens.

Each source is a queue of its documents' tokens. In round k every queue with tokens left is granted quantum s of a window
of WINDOW tokens; what a queue may send by the end of round k is floor(k * WINDOW * weight_s / sum of weights), so the
fraction that a round leaves over is the deficit that the next one carries. Documents are cut where the credit ends.
These credits have a closed form, hence a document's place follows from its position in its queue alone:

1. one pass tokenises whole texts and writes (block, queue, tokens before it in the block, ids), a block being a task's rows;
2. totals per (block, queue), a small table, are summed along the blocks: where each block stands in each queue;
3. one pass over the written tokens cuts each document at the rounds' and the sequences' borders.

All windows then hold the target proportions and all sequences but the last are full. The default weights are the
sources' own token counts, so that all queues end together.

Defined results: a null text is an empty one, whose only token is the end mark. A null source is a queue of its own.
Weights of unknown sources are ignored; sources without one weigh 1; a weight counts to six decimals and must be positive.
Every source has its own queue; for over MAX_QUEUES of them the grants are a table, not driver data, with the same
result. Repeated rows are packed each. No rows give no pieces.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEQUENCE = 1024
WINDOW = 64 * SEQUENCE
END = 0  # id after each document
MAX_QUEUES = 4096
ROUNDS = 4096
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"]
PIECE = ", ".join(f"{c} bigint" for c in COLUMNS)
PIECE_ARROW = pa.schema([(c, pa.int64()) for c in COLUMNS])
#: The first code point that pieces() leaves to the tokenizer itself.
_BEYOND = 0x250
_OTHER = re.compile(f"[^\\x00-{chr(_BEYOND - 1)}]")


def _class(major: str) -> str:
    """Characters below _BEYOND of a Unicode category, for use in a character class."""
    return "".join(re.escape(chr(i)) for i in range(_BEYOND) if unicodedata.category(chr(i))[0] == major)


def _pieces() -> re.Pattern:
    """The pre-tokeniser of byte-level BPE (contractions, words, numbers, other marks, white space) below _BEYOND.

    What it splits is encoded independently, so a piece's ids can be remembered.
    """
    letter, digit, white = _class("L"), _class("N"), r"\t-\r \x85\xa0"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{white}{letter}{digit}]+|[{white}]+(?![^{white}])|[{white}]+")


PIECES = _pieces()
_MEMO_LIMIT, _MEMO_CHARS = 400_000, 48
TOKENS = "block int, queue string, doc_id bigint, before bigint, n bigint, ids binary"
TOKENS_ARROW = pa.schema([("block", pa.int32()), ("queue", pa.string()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _merge_ranks(path: str) -> dict[bytes, int] | None:
    """The file's vocabulary as bytes by rank, if merging by rank is what it says: the k-th merge makes the k-th token."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(model["vocab"].get(m) != 256 + k for k, m in enumerate(merged)) or any(model["vocab"].get(c, 256) > 255 for c in letters):
        return None
    return {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merged)}


class Encoder:
    """Ids of whole texts by a byte-level BPE file; pieces that recur are remembered.

    New pieces are merged by the ranks of the same file, which gives the same ids several times as fast; where the file
    doesn't merge by rank, and for texts with characters beyond the pieces' range, the tokenizer itself encodes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32
        ranks = _merge_ranks(path)
        self.merger = ranks and tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, bytes] = {}
        self.end = np.array([END], self.dtype).tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.dtype is np.uint16 else "I"
        return [array(code, e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids and the end mark."""
        memo = self.memo
        if len(memo) > _MEMO_LIMIT:
            memo.clear()
        pieces = [None if _OTHER.search(t) or any(s in t for s in self.special) else PIECES.findall(t) for t in texts]
        found = [None if p is None else list(map(memo.get, p)) for p in pieces]
        missing = list({w for p, f in zip(pieces, found, strict=True) if f is not None and None in f for w, v in zip(p, f, strict=True) if v is None})
        if missing:
            code = "H" if self.dtype is np.uint16 else "I"
            memo.update(zip(missing, [array(code, x).tobytes() for x in map(self.merger.encode_ordinary, missing)] if self.merger else self._ids(missing), strict=True))
        whole = iter(self._ids([t for t, p in zip(texts, pieces, strict=True) if p is None]))
        out = [next(whole) if p is None else b"".join(f if None not in f else map(memo.__getitem__, p)) for p, f in zip(pieces, found, strict=True)]
        for w in missing:
            if len(w) > _MEMO_CHARS:
                del memo[w]
        return [x + self.end for x in out]


_encoders: dict[str, Encoder] = {}


def tokenise(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The written table TOKENS."""
    from pyspark import TaskContext

    common.python_ready(docs.sparkSession)
    queue = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), queue.alias("queue"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        block, sent = TaskContext.get().partitionId(), {}
        width = encoder.dtype().itemsize
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                queues, ids = part.column(1).to_pylist(), encoder.encode(part.column(2).to_pylist())
                before, n = [], [len(x) // width for x in ids]
                for q, k in zip(queues, n, strict=True):
                    before.append(sent.get(q, 0))
                    sent[q] = before[-1] + k
                yield _batch([[block] * len(ids), queues, part.column(0), before, n, ids], TOKENS_ARROW)

    return common.materialise(rows.mapInArrow(run, TOKENS), "tokens")


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return _batch(list(zip(*rows, strict=True)) if rows else [[] for _ in schema], schema)


@dataclass(frozen=True)
class Schedule:
    """The rounds, in whole numbers: totals and weights per queue, in the queues' order."""

    totals: tuple[int, ...]
    weights: tuple[int, ...]
    window: int = WINDOW

    def credit(self, s: int, k: int) -> int:
        """Tokens that queue s has sent by the end of round k - 1."""
        return min(self.totals[s], k * self.window * self.weights[s] // sum(self.weights))

    def round_starts(self, k: int) -> list[int]:
        """Position in the whole stream of each queue's share of round k."""
        now = [self.credit(s, k) for s in range(len(self.totals))]
        at, out = sum(now), []
        for s, c in enumerate(now):
            out.append(at)
            at += self.credit(s, k + 1) - c
        return out

    def segments(self, s: int, at: int, n: int, starts) -> Iterator[tuple[int, int, int, int]]:
        """(offset in the run, length, position in the stream, round) of tokens at..at+n of queue s, cut at rounds."""
        end, k = at + n, max(0, at * sum(self.weights) // (self.window * self.weights[s]) - 1)
        done = 0
        while done < n:
            while self.credit(s, k + 1) <= at + done:
                k += 1
            stop = min(end, self.credit(s, k + 1))
            yield done, stop - at - done, starts(k)[s] + at + done - self.credit(s, k), k
            done = stop - at


def _lists(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in b.columns], strict=True)


def _units(weights: dict[str | None, float] | None) -> dict[str, int] | None:
    """Weights as whole millionths by queue name."""
    if weights and not all(v > 0 for v in weights.values()):
        raise ValueError("weights must be positive")
    return {"n" if k is None else "s" + k: max(1, round(v * 1_000_000)) for k, v in weights.items()} if weights else None


def _cut(doc, n: int, ids: np.ndarray, begin: int, where: int, k: int, sequence: int) -> list[tuple]:
    """The pieces of a run of one document's tokens, cut at the sequences' borders."""
    out, done = [], 0
    while done < len(ids):
        sequence_id, offset = divmod(where + done, sequence)
        size = min(len(ids) - done, sequence - offset)
        out.append((doc, begin + done, size, zlib.crc32(ids[done : done + size].tobytes()), n, sequence_id, offset, k))
        done += size
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, weights: dict[str | None, float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window) of every piece of every document."""
    tokens = tokenise(docs, tokenizer or default_tokenizer(), key, text, source)
    spark = docs.sparkSession
    parts = tokens.groupBy("block", "queue").agg(F.sum("n").alias("_sum"))
    along = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = common.materialise(parts.withColumn("_start", F.coalesce(F.sum("_sum").over(along), F.lit(0))), "queue-starts")
    given = _units(weights)
    if starts.select("queue").distinct().count() > MAX_QUEUES:
        return _pack_by_table(tokens, starts, given, sequence, window)
    sums = {r["queue"]: r["n"] for r in starts.groupBy("queue").agg(F.sum("_sum").alias("n")).collect()}
    order = sorted(sums)
    plan = Schedule(tuple(sums[q] for q in order), tuple(sums[q] if given is None else given.get(q, 1_000_000) for q in order), window)
    index = {q: i for i, q in enumerate(order)}
    shared = spark.sparkContext.broadcast((plan, index))
    placed = tokens.join(starts.select("block", "queue", "_start"), ["block", "queue"]).select("doc_id", F.col("queue").alias("_q"), (F.col("_start") + F.col("before")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, index = shared.value
        starts = lru_cache(maxsize=4096)(plan.round_starts)
        for b in batches:
            out = []
            for doc, q, at, n, raw in _lists(b):
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                for begin, length, where, k in plan.segments(index[q], at, n, starts):
                    out += _cut(doc, n, ids[begin : begin + length], begin, where, k, sequence)
            yield _rows(out, PIECE_ARROW)

    return placed.mapInArrow(run, PIECE)


def _pack_by_table(tokens: DataFrame, starts: DataFrame, given: dict[str, int] | None, sequence: int, window: int) -> DataFrame:
    """What ``pack`` returns, for any number of queues: each queue's grants are rows, and runs of tokens meet them by round."""
    spark = tokens.sparkSession
    queues = starts.groupBy("queue").agg(F.sum("_sum").alias("total"))
    if given is None:
        queues = queues.withColumn("weight", F.greatest("total", F.lit(1)))
    else:
        known = spark.createDataFrame(list(given.items()), "queue string, weight bigint")
        queues = queues.join(known, "queue", "left").withColumn("weight", F.coalesce("weight", F.lit(1_000_000)))
    queues = common.materialise(queues, "queues")
    whole = int(queues.agg(F.sum(F.col("weight").cast("decimal(38,0)")).alias("w")).first()["w"])

    def grants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("queue", pa.string()), ("k", pa.int64()), ("amount", pa.int64())])
        for b in batches:
            out = []
            for q, total, w in _lists(b):
                sent = 0
                while sent < total:  # on to the next round in which the queue sends anything
                    k = -(-(sent + 1) * whole // (window * w)) - 1
                    now = min(total, (k + 1) * window * w // whole)
                    out.append((q, k, now - sent))
                    sent = now
                    if len(out) >= 50_000:
                        yield _rows(out, schema)
                        out = []
            yield _rows(out, schema)

    grant = common.materialise(queues.mapInArrow(grants, "queue string, k bigint, amount bigint"), "grants")
    before = lambda w: F.coalesce(F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Rounds before a round: sums of ROUNDS rounds along the whole, then along the rounds of each.
    rounds = grant.groupBy("k").agg(F.sum("amount").alias("amount")).withColumn("part", F.floor(F.col("k") / ROUNDS))
    far = rounds.groupBy("part").agg(F.sum("amount").alias("amount")).select("part", before(Window.orderBy("part")).alias("far"))
    rounds = rounds.withColumn("near", before(Window.partitionBy("part").orderBy("k"))).join(far, "part").select("k", (F.col("far") + F.col("near")).alias("base"))
    grant = grant.withColumn("inside", before(Window.partitionBy("k").orderBy("queue"))).join(rounds, "k").select("queue", "k", (F.col("base") + F.col("inside")).alias("at"))
    runs = tokens.join(starts.join(queues, "queue").select("block", "queue", "_start", "total", "weight"), ["block", "queue"])
    runs = runs.select("doc_id", "queue", (F.col("_start") + F.col("before")).alias("at"), "n", "ids", "total", "weight")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), *[(c, pa.int64()) for c in ("k", "inside", "start", "doc_tokens")], ("ids", pa.binary())])
        for b in batches:
            out = []
            for doc, q, at, n, raw, _, w in _lists(b):
                ids, done = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4"), 0
                while done < n:
                    k = -(-(at + done + 1) * whole // (window * w)) - 1
                    low, high = k * window * w // whole, (k + 1) * window * w // whole
                    stop = min(n, high - at)
                    out.append((doc, q, k, at + done - low, done, n, ids[done:stop].tobytes()))
                    done = stop
            yield _rows(out, schema)

    met = runs.mapInArrow(segments, "doc_id bigint, queue string, k bigint, inside bigint, start bigint, doc_tokens bigint, ids binary").join(grant, ["queue", "k"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, n, raw, begin, where, k in _lists(b):
                out += _cut(doc, n, np.frombuffer(raw, "<u4"), begin, where, k, sequence)
            yield _rows(out, PIECE_ARROW)

    return met.select("doc_id", "doc_tokens", "ids", "start", (F.col("at") + F.col("inside")).alias("at"), "k").mapInArrow(cut, PIECE)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents packed into sequences of 1024 tokens."""
    return pack(common.table(spark, sf_dir, "documents"))
