"""Byte-level BPE encoding and decoding: merges replayed over the words of a corpus at once.

A text is split by the tokenizer's pattern into words, and a word's ids don't depend on its neighbours. So the
distinct words of a task's texts are laid out as one row of tokens, and an inverted index holds, for each
token that a merge can make, the places of the pairs that make it. The merges are applied in the order of their
ranks, each to all its places in all words at once; only the pairs beside a place that merged are looked up
again and put into the index. Texts get their ids from their words' by array lookups.

The result is that of merging, in each word by itself, the leftmost pair of the lowest rank again and
again. Where a merge makes a pair of a rank below its own (a trained vocabulary hardly ever does), the word is
merged by itself in just that way.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import portions, table
from fieldloom.llm.sentencepiece_codec import gather, sums

#: Bytes of text whose words are merged at once.
BYTES = 16_000_000
#: Ids that are looked up or decoded at once.
SLICE = 1_000_000
#: Words whose ids a task keeps; beyond, its memory starts anew.
KNOWN = 500_000
_NONE = np.int32(2**31 - 1)
#: Fixed by the pattern: white space, and a blank between white space and more of it or the end. There a text can't be cut.
_SPACE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNCUT = rf"[{_SPACE}] (?:[{_SPACE}]|\z)"
_STARTS = rf"\A(?:[{_SPACE}]|\z)"


class Vocabulary:
    """Ranks read from a file of lines ``base64 rank``; a token's rank is its id."""

    def __init__(self, data: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        size = max(self.ranks.values()) + 1
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, made = np.array(pairs, np.int32).reshape(-1, 3).T
        byte_of = np.full(size, -1)
        byte_of[self.of_byte] = np.arange(256)
        self.of_bytes = np.full((256, 256), _NONE)
        both = (byte_of[left] >= 0) & (byte_of[right] >= 0)
        self.of_bytes[byte_of[left[both]], byte_of[right[both]]] = made[both]
        self.after, self.before = self._sides(left, right, made, size), self._sides(right, left, made, size)
        #: tokens that stand in a pair which makes a token of a lower rank
        self.odd = np.zeros(size, bool)
        self.odd[left[made < left]] = True
        self.odd[right[made < right]] = True

    @staticmethod
    def _sides(own: np.ndarray, other: np.ndarray, made: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((other, own))
        return np.searchsorted(own[order], np.arange(size + 1)), other[order], made[order]

    @staticmethod
    def _find(side: tuple[np.ndarray, np.ndarray, np.ndarray], token: int, others: np.ndarray) -> np.ndarray:
        cuts, other, made = side
        a, b = cuts[token], cuts[token + 1]
        if a == b:
            return np.full(len(others), _NONE)
        at = np.searchsorted(other[a:b], others)
        at[at == b - a] = 0
        return np.where(other[a + at] == others, made[a + at], _NONE)

    def with_next(self, token: int, others: np.ndarray) -> np.ndarray:
        """What ``token`` and each of ``others`` after it make."""
        return self._find(self.after, token, others)

    def with_previous(self, token: int, others: np.ndarray) -> np.ndarray:
        return self._find(self.before, token, others)

    def alone(self, word: bytes) -> list[int]:
        """A word's ids, merging the leftmost pair of the lowest rank until none is left."""
        parts: list[bytes | None] = [bytes([b]) for b in word]
        n = len(parts)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))

        def made(i: int) -> int:
            j = following[i]
            return self.ranks.get(parts[i] + parts[j], -1) if j < n else -1

        heap = [(r, i) for i in range(n) if (r := made(i)) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if parts[i] is None or made(i) != rank:
                continue  # merged since
            j = following[i]
            parts[i], parts[j] = parts[i] + parts[j], None
            following[i] = following[j]
            if following[i] < n:
                previous[following[i]] = i
            for k in (previous[i], i):
                if k >= 0 and (r := made(k)) >= 0:
                    heapq.heappush(heap, (r, k))
        return [self.ranks[p] for p in parts if p is not None]


def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs at ``places`` with second tokens at ``after``, those that merge: from the left, none that shares a token
    with the one before."""
    joined = np.concatenate([[False], places[1:] == after[:-1]])
    if not joined.any():
        return np.ones(len(places), bool)
    start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(places))))
    return (np.arange(len(places)) - start) % 2 == 0


def replay(v: Vocabulary, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, all ids) of words given as their bytes, one after the other."""
    ends = np.cumsum(lengths) + np.arange(1, len(lengths) + 1)  # the place after each word, where there's no token
    n = len(data) + len(lengths) + 1
    token = np.full(n, -1, np.int32)
    inside = np.ones(n, bool)
    inside[0] = inside[ends] = False
    token[inside] = v.of_byte[data]
    following, previous = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    raw = np.zeros(n, np.uint8)
    raw[inside] = data
    makes = np.full(n, _NONE)  # by the pair that starts at each place
    both = np.flatnonzero(inside[:-1] & inside[1:])
    makes[both] = v.of_bytes[raw[both], raw[both + 1]]
    del raw, inside
    both = both[makes[both] != _NONE]
    both = both[np.argsort(makes[both], kind="stable")]
    cuts = np.flatnonzero(np.diff(makes[both], prepend=-1))
    stops = np.append(cuts[1:], len(both))[: len(cuts)]
    first = dict(zip(makes[both[cuts]].tolist(), zip(cuts.tolist(), stops.tolist(), strict=True), strict=True))
    later: defaultdict[int, list[int]] = defaultdict(list)
    heap = list(first)
    heapq.heapify(heap)
    odd: list[np.ndarray] = []
    done = -1
    while heap:
        rank = heapq.heappop(heap)
        if rank == done:
            continue
        done = rank
        a, b = first.pop(rank, (0, 0))
        places = both[a:b]
        if rank in later:
            places = np.unique(np.concatenate([places, np.array(later.pop(rank), places.dtype)]))
        places = places[makes[places] == rank]
        if not len(places):
            continue
        after = following[places]
        merged = _apart(places, after)
        places, after = places[merged], after[merged]
        right = following[after]
        old = token[right] if v.odd[rank] else None
        token[places], token[after] = rank, -2
        makes[after] = _NONE
        following[places], previous[right] = right, places
        left = previous[places]
        made_right, made_left = v.with_next(rank, token[right]), v.with_previous(rank, token[left])
        makes[places], makes[left] = made_right, made_left
        if old is not None:
            odd.append(places[(v.with_next(rank, old) < rank) | (made_left < rank)])
        for made, at in ((made_right, places), (made_left, left)):
            some = made != _NONE
            for m, p in zip(made[some].tolist(), at[some].tolist(), strict=True):
                if m not in later and m not in first:
                    heapq.heappush(heap, m)
                later[m].append(p)
    found = token >= 0
    counts = np.add.reduceat(found, np.concatenate([[0], ends[:-1]])) if len(ends) else np.zeros(0, np.int64)
    ids = token[found]
    if odd and len(wrong := np.unique(np.concatenate(odd))):
        starts, at, parts = np.cumsum(lengths) - lengths, np.cumsum(counts) - counts, []
        before = 0
        for w in np.unique(np.searchsorted(ends, wrong)).tolist():
            own = v.alone(data[starts[w] : starts[w] + lengths[w]].tobytes())
            parts += [ids[before : at[w]], np.array(own, np.int32)]
            before, counts[w] = at[w] + counts[w], len(own)
        ids = np.concatenate([*parts, ids[before:]])
    return counts, ids


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each string, all bytes)."""
    strings = strings.cast(pa.large_binary())
    lengths = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    offset = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return lengths, data[offset : offset + lengths.sum()]


class Codec:
    """Encodes and decodes the texts of a task."""

    def __init__(self, data: bytes, pattern: str) -> None:
        import regex

        self.v, self.pattern = Vocabulary(data), regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.at, self.len, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, words: list[str]) -> np.ndarray:
        """The words' numbers; new words are merged."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > KNOWN and self.index:
            self._forget()
            new = words
        if new:
            lengths, data = _flat(pa.array(new, pa.large_string()))
            whole = np.fromiter((self.v.ranks.get(w.encode(), -1) for w in new), np.int32, len(new))  # words that are tokens stay so
            rest = whole < 0
            counts, ids = replay(self.v, data[np.repeat(rest, lengths)], lengths[rest])
            sizes, flat = np.ones(len(new), np.int64), whole.repeat(np.where(rest, 0, 1))
            sizes[rest] = counts
            own = np.repeat(rest, sizes)
            both = np.empty(len(own), np.int32)
            both[own], both[~own] = ids, flat
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.flat, self.len = np.concatenate([self.flat, both]), np.concatenate([self.len, sizes])
            self.at = np.cumsum(self.len) - self.len
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _words(self, units: pa.Array, joined: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(number of words of each unit, all words). Units that can be ``joined`` are split as one text."""
        counts = np.zeros(len(units), np.int64)
        together = units.filter(pa.array(joined))
        words = pa.array(self.pattern.findall("".join(together.to_pylist())), pa.large_string())
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        unit_ends = np.cumsum(pc.binary_length(together).to_numpy(zero_copy_only=False).astype(np.int64))
        last = np.searchsorted(ends, unit_ends)  # each unit ends with a word
        counts[joined] = np.diff(last + 1, prepend=0)
        apart = [self.pattern.findall(u) for u in units.filter(pa.array(~joined)).to_pylist()]
        counts[~joined] = [len(x) for x in apart]
        out = pa.array([w for x in apart for w in x], pa.large_string())
        # put both into the units' order
        order = np.empty(int(counts.sum()), np.int64)
        own = np.repeat(joined, counts)
        order[own], order[~own] = np.arange(len(words)), len(words) + np.arange(len(out))
        return counts, pa.concat_arrays([words, out]).take(pa.array(order))

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """The texts cut where no word can lie across: (number of units of each text, their numbers, distinct units, which of
        them can stand behind one another). A cut is made before each blank; a text with a blank inside longer white space is one unit."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.match_substring_regex(texts, _UNCUT).to_numpy(zero_copy_only=False)
        pieces = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        strings = coded.dictionary
        codes = coded.indices.to_numpy().astype(np.int64) * 2 + 1
        starts = np.cumsum(counts) - counts
        codes[starts] -= 1  # the first has no blank before it
        long = texts.filter(pa.array(whole))
        codes[starts[whole]] = 2 * len(strings) + 2 * np.arange(len(long))
        used, codes = np.unique(codes, return_inverse=True)
        strings = pa.concat_arrays([strings, long]).take(pa.array(used // 2))
        blank = used % 2 == 1
        spaced = pc.binary_join_element_wise(pc.if_else(pa.array(blank), " ", "").cast(pa.large_string()), strings, pa.scalar("", pa.large_string()))
        return counts, codes, spaced, blank & ~pc.match_substring_regex(strings, _STARTS).to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of texts, ids of each, all ids) of neighbouring texts, about SLICE ids at once."""
        counts, codes, units, joined = self.units(texts)
        n_words, words = self._words(units, joined)
        coded = words.dictionary_encode()
        known = self._learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        unit_len, unit_ids = sums(self.len[known], n_words), gather(self.at[known], self.len[known], self.flat)
        unit_at = np.cumsum(unit_len) - unit_len
        text_len = sums(unit_len[codes], counts)
        ends = np.cumsum(counts)
        for i, j in slices(text_len, SLICE):
            own = codes[ends[i] - counts[i] : ends[j - 1]]
            yield j - i, text_len[i:j], gather(unit_at[own], unit_len[own], unit_ids)

    def decode(self, ids: np.ndarray) -> bytes:
        parts = (ids[i : i + SLICE] for i in range(0, len(ids), SLICE))
        return b"".join(gather(self.v.at[p], self.v.length[p], self.v.bytes).tobytes() for p in parts)


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs [i, j) of neighbours whose sizes add up to about ``most``; a larger one is a run of its own."""
    ends = np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _binary(sizes: np.ndarray, data: bytes, null: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(data)])
    return (pc.if_else(pa.array(null), pa.scalar(None, pa.large_binary()), out) if null.any() else out).cast(pa.binary())


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
           packed: bool = True) -> DataFrame:
    """Columns of ``docs`` and ``ids``: each text's ids as a binary of little-endian unsigned 32-bit integers, as
    files of training data hold them, or as an array of longs if not ``packed``; with ``decoded``, also the bytes that the ids stand for.

    Null text: null ids (and null bytes). Empty text: no ids. Texts are encoded whole whatever their length, the strings of
    special tokens as any other; repeated rows alike. Columns of ``docs`` named like the new ones are replaced. An empty table gives
    an empty result. Nothing is shuffled.
    """
    docs = docs.drop(*[c for c in (ids, decoded) if c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for b in portions(batches, text, BYTES):
            at = 0
            for n, lengths, got in codec.encode(b.column(text)):
                part = b.slice(at, n)
                null = part.column(text).is_null().to_numpy(zero_copy_only=False)
                if packed:
                    own = _binary(4 * lengths, got.astype("<u4").tobytes(), null)
                else:
                    own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(got.astype(np.int64)), mask=pa.array(null))
                columns, names = [*part.columns, own], [*part.schema.names, ids]
                if decoded:
                    columns.append(_binary(sums(codec.v.length[got], lengths), codec.decode(got), null))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(columns, names)
                at += n

    added = [T.StructField(ids, T.BinaryType() if packed else T.ArrayType(T.LongType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(docs: DataFrame, ranks: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Columns of ``docs`` and ``decoded binary``, the bytes of ``ids`` (packed as by ``encode``).

    Null ids: null. No ids: no bytes. Ids that the vocabulary doesn't have raise an error. Repeated rows decode alike; a
    column of ``docs`` named like ``decoded`` is replaced. An empty table gives an empty result.
    """
    docs = docs.drop(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Codec(ranks, "")
        for b in portions(batches, ids, BYTES):
            lengths, data = _flat(pc.fill_null(b.column(ids), b""))
            got = data.view("<u4").astype(np.int64)
            if len(got) and got.max() >= len(v.v.length):
                raise ValueError(f"id {got.max()} is not in the vocabulary")
            null = b.column(ids).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, _binary(sums(v.v.length[got], lengths // 4), v.decode(got), null)], [*b.schema.names, decoded])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(decoded, T.BinaryType())]))


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """A rank file's bytes, read once at the driver and sent with the tasks (under 1 MB)."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
