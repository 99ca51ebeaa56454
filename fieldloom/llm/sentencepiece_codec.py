"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read directly (it needs a handful of fields), and the normaliser, the
white-space marker, the pieces with their scores and byte fallback are rebuilt as a
``tokenizers`` pipeline: a unigram lattice for unigram models, merges in order of the pieces'
scores for BPE models. ``parity`` compares the result with the sentencepiece library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import portions, table

MODEL_DIR = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: A run of marks with what follows, or what comes before the first mark.
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Values fixed by the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters of one text that are cut into words at once.
WINDOW = 250_000
#: Ids are decoded in batches of about this many.
BATCH_IDS = 250_000


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers, 4-byte or delimited bytes."""
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
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


def parse_model(data: bytes) -> Model:
    import struct

    m = Model()
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            m.pieces.append((got[1].decode("utf-8"), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        elif number == 2:
            got = dict(_fields(value))
            m.kind, m.byte_fallback, m.unk_id = got.get(3, UNIGRAM), bool(got.get(35, 0)), got.get(40, 0)
        elif number == 3:
            got = dict(_fields(value))
            m.charsmap = got.get(2, b"")
            m.dummy_prefix, m.squeeze, m.escape = (bool(got.get(n, 1)) for n in (3, 4, 5))
    return m


def build(m: Model):
    """The ``tokenizers`` pipeline of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    real = {p for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)}
    if m.kind == UNIGRAM:
        low = min((s for _, s, k in m.pieces if k == NORMAL), default=0.0)
        vocab = [(p, s if k in (NORMAL, BYTE) else 0.0 if k == USER_DEFINED else low - 100.0) for p, s, k in m.pieces]
        tokenizer = Tokenizer(models.Unigram(vocab, unk_id=m.unk_id, byte_fallback=m.byte_fallback))
    elif m.kind == BPE:
        merges = []
        ranked = sorted((p for p, _, k in m.pieces if k == NORMAL and len(p) > 1), key=lambda p: (-m.pieces[ids[p]][1], ids[p]))
        for p in ranked:
            halves = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in real and p[i:] in real]
            merges += sorted(halves, key=lambda h: (ids[h[0]], ids[h[1]]))
        tokenizer = Tokenizer(models.BPE(ids, merges, unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    space = MARK if m.escape else " "
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(space))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    own = [AddedToken(p, normalized=False, special=False) for p, _, k in m.pieces if k == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    tokenizer.encode_special_tokens = True
    tail = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


def read_model(spark: SparkSession, name: str = MODEL, folder: str = MODEL_DIR) -> bytes:
    """The model file's bytes, read once at the driver and sent with the tasks (about 0.5 MB)."""
    path = f"{folder}/{name}"
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of ``counts`` neighbours (0 for an empty run)."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Codec:
    """Encodes and decodes batches with the library, once per distinct word.

    Where no piece holds a mark after another character (``splits``), a word's pieces do not
    depend on its neighbours, so texts are cut before runs of marks and only words not seen
    lately go to the library. Otherwise whole texts go there. Ids are kept and given as flat
    arrays, never as lists of Python integers.
    """

    KNOWN = 100_000  # words kept; beyond, the memory starts anew
    AT_ONCE = 10_000  # words given to the library in one call

    def __init__(self, data: bytes) -> None:
        m = self.model = parse_model(data)
        self.plain = not m.charsmap and not m.squeeze and m.dummy_prefix and m.escape
        pieces = [p for p, _, k in m.pieces if k in (NORMAL, USER_DEFINED)]
        self.splits = m.escape and not any(MARK in p.lstrip(MARK) for p in pieces) and not any(k == USER_DEFINED for _, _, k in m.pieces)
        self.strip = m.dummy_prefix
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in m.pieces]
        self.piece_len = np.array([len(x) for x in raw], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._forget()

    @cached_property
    def whole(self):
        return build(self.model)

    @cached_property
    def words(self):
        tokenizer = build(self.model)
        tokenizer.normalizer = None
        return tokenizer

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.at, self.len, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > self.KNOWN and self.index:
            self._forget()
            new = list(words)
        flat, lengths = [self.flat], [self.len]
        for i in range(0, len(new), self.AT_ONCE):
            some = new[i : i + self.AT_ONCE]
            ids = [e.ids for e in self.words.encode_batch_fast(some, add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(lengths[-1].sum())))
            self.index.update(zip(some, range(len(self.index), len(self.index) + len(some)), strict=True))
        self.flat, self.len = np.concatenate(flat), np.concatenate(lengths)
        self.at = np.cumsum(self.len) - self.len

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        if not self.splits:
            ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            return lengths, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        lengths, out = np.zeros(len(texts), np.int64), []
        held: list[str] = []
        counts: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            self._learn(set(held))
            at = np.fromiter(map(self.index.__getitem__, held), np.int64, len(held))
            rows, n = np.array(counts, np.int64).reshape(-1, 2).T
            np.add.at(lengths, rows, sums(self.len[at], n))
            out.append(gather(self.at[at], self.len[at], self.flat))
            held.clear()
            counts.clear()
            size = 0

        for row, text in enumerate(texts):
            for part in self._parts(text):
                words = self._cut(part)
                held += words
                counts.append((row, len(words)))
                size += len(part)
                if size >= WINDOW:
                    flush()
        flush()
        return lengths, np.concatenate(out)

    def _parts(self, text: str) -> Iterator[str]:
        """The normalised text, in parts of about WINDOW characters that end before a run of marks."""
        if not self.plain:
            text = self.whole.normalizer.normalize_str(text)
        elif text:
            text = f"{MARK}{text}"
        start = 0
        while len(text) - start > WINDOW:
            m = re.compile(f"[^ {MARK}](?=[ {MARK}])").search(text, start + WINDOW)
            if not m:
                break
            yield text[start : m.end()]
            start = m.end()
        yield text[start:]

    def _cut(self, text: str) -> list[str]:
        if self.plain:
            text = text.replace(" ", MARK)
        if not text:
            return []
        if f"{MARK}{MARK}" in text or text[-1] == MARK:
            return UNITS.findall(text)
        words = text.replace(MARK, f" {MARK}").split(" ")  # no spaces are left in a normalised text
        return words if words[0] else words[1:]

    def decode(self, lengths: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of the runs of ``ids``."""
        sizes = sums(self.piece_len[ids], lengths)
        data = gather(self.piece_at[ids], self.piece_len[ids], self.piece_bytes)
        starts = np.cumsum(sizes) - sizes
        full = starts[sizes > 0]
        try:
            data.tobytes().decode("utf-8")
            whole = not (data[full] & 0xC0 == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:  # not what encoding gives; the library says what it means
            ends = np.cumsum(lengths)
            return pa.array([self._decode_one(ids[a:b]) for a, b in zip(ends - lengths, ends, strict=True)], pa.string())
        if self.strip:
            drop = full[data[full] == 32]
            data, sizes = np.delete(data, drop), sizes.copy()
            sizes[np.flatnonzero(sizes)[np.isin(full, drop)]] -= 1
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))

    def _decode_one(self, ids: np.ndarray) -> str:
        try:
            s = gather(self.piece_at[ids], self.piece_len[ids], self.piece_bytes).tobytes().decode("utf-8")
        except UnicodeDecodeError:
            return self.whole.decode(ids.tolist(), skip_special_tokens=False)
        return s[1:] if self.strip and s[:1] == " " else s


def _codec(data: bytes, threads: int) -> Codec:
    """A codec for one task. It isn't kept beyond: workers are reused by other operators."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    return Codec(data)


def _lists(lengths: np.ndarray, ids: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pa.array(null))


def _without(texts: pa.Array, null: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), texts) if null.any() else texts


def _coded(docs: DataFrame, model: bytes, text: str, ids: str, decoded: str | None, threads: int) -> DataFrame:
    docs = docs.drop(ids, decoded) if decoded else docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, threads)
        for b in portions(batches, text):
            null = b.column(text).is_null().to_numpy(zero_copy_only=False)
            lengths, got = codec.encode([t or "" for t in b.column(text).to_pylist()])
            columns, names = [*b.columns, _lists(lengths, got, null)], [*b.schema.names, ids]
            if decoded:
                columns.append(_without(codec.decode(lengths, got), null))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(columns, names)

    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", threads: int = 2) -> DataFrame:
    """Columns of ``docs`` and ``ids array<int>``.

    Null text: null ids. Empty text: no ids. Repeated rows encode alike, whole texts whatever
    their length. A column of ``docs`` named like ``ids`` is replaced. An empty table gives an
    empty result.
    """
    return _coded(docs, model, text, ids, None, threads)


def encode_and_decode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded", threads: int = 2) -> DataFrame:
    """Columns of ``docs``, ``ids`` as by ``encode`` and ``decoded`` as by ``decode``, in one pass of one worker."""
    return _coded(docs, model, text, ids, decoded, threads)


def decode(docs: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded", threads: int = 2) -> DataFrame:
    """Columns of ``docs`` and ``text``, the text of ``ids``.

    Null ids: null text. No ids: empty text. Repeated rows decode alike. A column of ``docs`` named
    like ``text`` is replaced. An empty table gives an empty result.
    """
    docs = docs.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, threads)
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(ids)), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(ends // BATCH_IDS)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(i, j - i)
                got = part.column(ids)
                null = got.is_null().to_numpy(zero_copy_only=False)
                lengths = pc.fill_null(pc.list_value_length(got), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.list_flatten(got).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, _without(codec.decode(lengths, flat), null)], [*part.schema.names, text])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())]))


def parity(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """The rows of ``docs`` for which the sentencepiece library gives other ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for b in portions(batches, text):
            theirs = [None if t is None else sp.encode(t) for t in b.column(text).to_pylist()]
            differ = [x != y for x, y in zip(theirs, b.column("ids").to_pylist(), strict=True)]
            yield b.filter(pa.array(differ, pa.bool_()))

    coded = encode(docs, model, text)
    return coded.mapInArrow(run, coded.schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = read_model(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_and_decode(docs, model)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))
