"""Alignment of two tokenizers' tokens, each distinct text worked on once.

Documents are shuffled by their full texts, and each distinct text is tokenized by both tokenizers and aligned
once; its documents count as its multiplicity. Byte offsets at which tokens of both end cut the tokens into groups; two tokens are
linked where their byte ranges share a group. How many documents link a pair of ids is a count over the
corpus, and goes back to the texts in the sums of their links.

Texts come in chunks of bounded bytes. A chunk names its distinct units (a blank and what follows up to the next one: neither
tokenizer has tokens across such a cut) and the distinct pairs of ids in them, so the corpus-wide counts are
shuffled by pair once for each chunk that holds it, not once for each link, and a text is a list of units.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.byte_bpe import _SPACE, read_ranks, slices
from fieldloom.llm.common import Steps, portions, table
from fieldloom.llm.sentencepiece_codec import BYTE, MARK, NORMAL, USER_DEFINED, gather, parse_model, sums
from fieldloom.llm.vectors import runs

#: Bytes of text in a chunk; one longer text is a chunk of its own.
BYTES = 2_000_000
#: Units that one call of the second tokenizer gets as one text.
AT_ONCE = 100
#: Units of texts whose groups are written at once.
SLICE = 500_000
#: A group with more links than this is counted by distinct ids.
LARGE = 4096
#: A text with such a place isn't cut: there a token may hold white space of both sides.
_UNCUT = rf"  | \z|[{_SPACE}] [{_SPACE}]"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others, in
    order, for the letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class First:
    """A byte-level BPE tokenizer from a ``tokenizers`` JSON file whose merges stand in the order of their ids."""

    def __init__(self, data: bytes, pattern: str) -> None:
        import tiktoken

        model, letters = json.loads(data)["model"], _byte_letters()
        vocab = {token: i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [vocab[m] for m in made]
        if model["type"] != "BPE" or order != sorted(order):
            raise ValueError("only BPE models whose merges stand in the order of their ids are supported")
        ranks = {bytes(letters[c] for c in t): vocab[t] for t in [*made, *(letter for letter in letters if letter in vocab)]}
        self.encoding = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.length[i] = len(t)

    def joined(self, units: list[str]) -> np.ndarray:
        return self.encoding.encode_to_numpy("".join(units), disallowed_special=()).astype(np.int64)

    def each(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.encoding.encode_ordinary_batch(units, num_threads=1)]


class Second:
    """A SentencePiece tokenizer that puts a blank before each text."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        m = parse_model(data)
        if m.charsmap or m.squeeze or not (m.dummy_prefix and m.escape and m.byte_fallback):
            raise ValueError("only models that change no text but for a blank before it are supported")
        if any(MARK in p.lstrip(MARK) for p, _, k in m.pieces if k in (NORMAL, USER_DEFINED)):
            raise ValueError("only models without pieces across words are supported")
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in m.pieces]
        self.length = np.array([len(b) for b in self.bytes], np.int64)

    def joined(self, units: list[str]) -> np.ndarray:
        blocks = ["".join(units[i : i + AT_ONCE])[1:] for i in range(0, len(units), AT_ONCE)]
        return np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in self.lib.encode(blocks, num_threads=1)]])

    def each(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.lib.encode([u[1:] for u in units], num_threads=1)]

    def read(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes[i] for i in ids.tolist()])


class Tokens:
    """The tokens of units by both tokenizers, cut into groups: flat arrays over all units."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, unit_ends: np.ndarray) -> None:
        self.a, self.b = a, b
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.n_units = len(unit_ends)
        self.a_of, self.b_of = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)  # the group of each token
        self.na, self.nb = np.bincount(self.a_of, minlength=len(cuts)), np.bincount(self.b_of, minlength=len(cuts))
        self.unit = np.searchsorted(unit_ends, cuts)  # the unit of each group

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(unit, first id, second id, number) of the links, by unit."""
        a_at, b_at = np.cumsum(self.na) - self.na, np.cumsum(self.nb) - self.nb
        size = self.na * self.nb
        some = np.flatnonzero(size <= LARGE)
        g = np.repeat(some, size[some])
        k = np.arange(len(g)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        out = [(self.unit[g], self.a[a_at[g] + k // self.nb[g]], self.b[b_at[g] + k % self.nb[g]], np.ones(len(g), np.int64))]
        for g in np.flatnonzero(size > LARGE).tolist():
            a, ca = np.unique(self.a[a_at[g] : a_at[g] + self.na[g]], return_counts=True)
            b, cb = np.unique(self.b[b_at[g] : b_at[g] + self.nb[g]], return_counts=True)
            out.append((np.full(len(a) * len(b), self.unit[g]), np.repeat(a, len(b)), np.tile(b, len(a)), np.outer(ca, cb).ravel()))
        unit, a, b, n = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(unit, kind="stable") if len(out) > 1 else slice(None)
        return unit[order], a[order], b[order], n[order]

    def written(self) -> pa.Array:
        """The groups of each unit: ids of the first, a bar, ids of the second; groups are parted by semicolons."""
        last = np.diff(self.unit, append=-1) != 0  # of the groups: the unit's last
        after_a = np.where(np.diff(self.a_of, append=-1) == 0, 0, 1)
        after_b = np.where(np.diff(self.b_of, append=-1) == 0, 0, np.where(last[self.b_of], 3, 2))
        signs = pa.array([",", "|", ";", ""]).take(pa.array(np.concatenate([after_a, after_b])))
        tokens = pc.binary_join_element_wise(pa.array(np.concatenate([self.a, self.b])).cast(pa.string()), signs, "")
        order = np.argsort(np.concatenate([2 * self.a_of, 2 * self.b_of + 1]), kind="stable")
        ends = np.cumsum(self.na + self.nb)[last]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), tokens.take(pa.array(order))), "")


def _written(units: pa.Array, counts: np.ndarray, codes: np.ndarray) -> Iterator[str]:
    """The groups of each text: its units' groups, parted by semicolons."""
    ends = np.cumsum(counts)
    for i, j in slices(counts, SLICE):
        own = units.take(pa.array(codes[ends[i] - counts[i] : ends[j - 1]]))
        yield from pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[i:j])]).astype(np.int32)), own), ";").to_pylist()


def _together(parts: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.zeros(0, np.int64), *parts])
    return ids, np.cumsum(length[ids])


class Aligner:
    def __init__(self, first: bytes, second: bytes, pattern: str) -> None:
        self.first, self.second = First(first, pattern), Second(second)

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(number of units of each text, their numbers, distinct units), the most frequent unit first."""
        texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        whole = pc.match_substring_regex(texts, _UNCUT)
        pieces = pc.split_pattern(pc.if_else(whole, pa.scalar(" ", pa.large_string()), texts), " ")
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) - 1
        ends = np.cumsum(counts + 1)
        flat = pieces.flatten().filter(pa.array(~np.isin(np.arange(ends[-1]), ends - counts - 1)))  # nothing is before the first blank
        coded = flat.dictionary_encode()
        strings = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
        codes, long = coded.indices.to_numpy().astype(np.int64), texts.filter(whole)
        codes[(np.cumsum(counts) - counts)[whole.to_numpy(zero_copy_only=False)]] = len(strings) + np.arange(len(long))
        times = np.bincount(codes, minlength=len(strings) + len(long))
        frequent = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]  # a blank that stands for a whole text may be unused
        place = np.empty(len(strings) + len(long), np.int64)
        place[frequent] = np.arange(len(frequent))
        return counts, place[codes], pa.concat_arrays([strings, long]).take(pa.array(frequent))

    def align(self, units: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray]:
        """(tokens of the units that both read alike, their numbers, which units those are not)."""
        joined = pc.invert(pc.or_(pc.match_substring(units, MARK), pc.match_substring_regex(units, rf"\A (?:[{_SPACE}]|\z)|  | \z|[{_SPACE}] "))).to_numpy(zero_copy_only=False)
        size = pc.binary_length(units.cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(np.int64)
        together = units.filter(pa.array(joined)).to_pylist()
        a, b = self.first.joined(together), self.second.joined(together)
        if self.second.length[b].sum() != size[joined].sum():
            joined[:], a, b = False, a[:0], b[:0]  # read unlike somewhere: each unit by itself
        apart = np.flatnonzero(~joined)
        alone = units.take(pa.array(apart)).to_pylist()
        rest_a, rest_b = self.first.each(alone), self.second.each(alone)
        wrong = np.array([self.second.read(y) != u.encode() for u, y in zip(alone, rest_b, strict=True)], bool)
        good = apart[~wrong]
        order = np.concatenate([np.flatnonzero(joined), good])
        a, a_ends = _together([a, *[x for x, w in zip(rest_a, wrong, strict=True) if not w]], self.first.length)
        b, b_ends = _together([b, *[x for x, w in zip(rest_b, wrong, strict=True) if not w]], self.second.length)
        return Tokens(a, b, a_ends, b_ends, np.cumsum(size[order])), order, apart[wrong]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


def _in_order(written: pa.Array, order: np.ndarray, n: int) -> pa.Array:
    """What is written for ``n`` units, of which ``order`` names those that are; null for the others."""
    place = np.full(n, -1)
    place[order] = np.arange(len(order))
    return written.take(pa.array(place, mask=place < 0))


def _planes(x: np.ndarray) -> bytes:
    """Small numbers by planes of bytes, which compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


#: A chunk's rows: one with its pairs (id pair, weight) and the links of its units, and one for each text.
_CHUNK = ("chunk long, part int, key binary, n_a long, n_b long, n_groups long, n_links long, digest binary, units binary, "
          "pairs array<long>, weights array<long>, links binary")


def _chunk_rows(aligner: Aligner, texts: pa.Array, keys: pa.Array, times: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
    counts, codes, units = aligner.units(texts)
    tokens, order, wrong = aligner.align(units)
    n_units = len(units)
    unit, a, b, n = tokens.pairs()
    distinct, pair = np.unique(a << 32 | b, return_inverse=True)
    unit = order[unit]
    own = np.argsort(unit, kind="stable")
    unit, pair, n = unit[own], pair[own], n[own]
    per_unit = np.bincount(unit, minlength=n_units)
    text = np.repeat(np.arange(len(counts)), counts)
    bad = np.zeros(len(counts), bool)
    bad[text[np.isin(codes, wrong)]] = True
    # how many documents hold each pair
    seen = _distinct(text[~bad[text]] * n_units + codes[~bad[text]])
    seen_text, seen_unit = seen // n_units, seen % n_units
    at = np.cumsum(per_unit) - per_unit
    held = _distinct(np.repeat(seen_text, per_unit[seen_unit]) * max(len(distinct), 1) + gather(at[seen_unit], per_unit[seen_unit], pair))
    weights = np.bincount(held % max(len(distinct), 1), times[held // max(len(distinct), 1)], len(distinct)).astype(np.int64)
    del held, seen, seen_text, seen_unit
    # measures of texts are sums of their units'
    measure = np.zeros((4, n_units), np.int64)
    group_unit = order[tokens.unit]
    for row, values in zip(measure, (tokens.na, tokens.nb, np.ones(len(group_unit)), tokens.na * tokens.nb), strict=True):
        row += np.bincount(group_unit, values, n_units).astype(np.int64)
    of_text = np.where(bad, 0, [sums(m[codes], counts) for m in measure])
    ends = np.cumsum(counts)
    digests = [None if t is None else hashlib.sha256(t.encode()).digest() for t in _written(_in_order(tokens.written(), order, n_units), counts, codes)]
    lists = [None if w else _planes(np.diff(np.sort(codes[x:y]), prepend=0)) for w, x, y in zip(bad, ends - counts, ends, strict=True)]
    k = len(counts)
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("key", pa.binary()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                        ("digest", pa.binary()), ("units", pa.binary()), ("pairs", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())), ("links", pa.binary())])
    links = b"".join([np.array([n_units, len(pair)], "<i8").tobytes(), _planes(per_unit), _planes(pair), _planes(n)])
    none = pa.nulls(1)
    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([0], pa.int32()), *[none.cast(f.type) for f in schema][2:9], pa.array([distinct], pa.list_(pa.int64())),
                                      pa.array([weights], pa.list_(pa.int64())), pa.array([links], pa.binary())], schema=schema)
    empty = [pa.nulls(k, f.type) for f in schema][9:]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), pa.array(np.full(k, 2, np.int32)), keys, *[pa.array(x) for x in of_text],
                                      pa.array(digests, pa.binary()), pa.array(lists, pa.binary()), *empty], schema=schema)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Measures of the texts of chunks whose pairs come with their counts: a chunk's own row, the counts, the texts."""
    for t in runs(batches, ["chunk"]):
        part = t["part"].to_numpy()
        head = t.slice(0, 1)
        pairs, links = head["pairs"].combine_chunks().flatten().to_numpy(), head["links"][0].as_py()
        n_units, n_links = np.frombuffer(links, "<i8", 2)
        cuts = 16 + 4 * np.cumsum([0, n_units, n_links, n_links])
        per_unit, pair, n = (_numbers(links[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True))
        told = t.filter(pa.array(part == 1))
        at = np.searchsorted(pairs, told["pair"].to_numpy())
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        count[at], best[at] = told["count"].to_numpy(), told["best"].to_numpy()
        of_unit = [sums(n * x[pair], per_unit) for x in (best, count)]
        texts = t.filter(pa.array(part == 2))
        for b in texts.to_batches(max_chunksize=2000):
            lists = [np.cumsum(_numbers(x)) if x else np.zeros(0, np.int64) for x in b.column("units").to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *lists])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("key", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(sums(x[flat], sizes)) for x in of_unit]
                                             + [b.column("digest")], ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest"])


def measures(docs: DataFrame, first: bytes, second: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the measures of each row's alignment: ``n_a, n_b, n_groups, n_links, n_best, count_sum long`` and
    ``groups_sha256`` (the digest of the groups as ``align`` writes them; '' where a text has no tokens).

    Null and empty texts, and those that a tokenizer doesn't read back as a blank and the text, have no tokens: zeros. Whole
    texts are aligned whatever their length; rows that repeat a text are worked on once and each count as a
    document; rows that repeat a key, and null keys, come back like any other. An empty table gives an empty result.
    """
    steps = Steps(docs.sparkSession)
    some = F.col("text") != ""
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    named = own.select("id", F.when(some, F.unhex(F.sha2("text", 256))).alias("key"))
    distinct = own.where(some).groupBy("text").agg(F.count(F.lit(1)).alias("times")).withColumn("key", F.unhex(F.sha2("text", 256)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, n = None, 0
        for b in portions(batches, "text", BYTES):
            aligner = aligner or Aligner(first, second, pattern)
            chunk = TaskContext.get().partitionId() << 32 | n
            yield from _chunk_rows(aligner, b.column("text"), b.column("key"), b.column("times").to_numpy(), chunk)
            n += 1
            pa.default_memory_pool().release_unused()

    chunks = steps.keep(distinct.mapInArrow(work, _CHUNK))
    pairs = chunks.where("part = 0").select("chunk", F.explode(F.arrays_zip("pairs", "weights")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.weights").alias("weight"))
    counts = steps.keep(pairs.groupBy("pair").agg(F.sum("weight").alias("count")))
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    ranked = counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    told = pairs.select("chunk", "pair").join(ranked, "pair").select("chunk", F.lit(1).alias("part"), "pair", "count", "best")
    asked = chunks.drop("weights").unionByName(told, allowMissingColumns=True)
    kind = "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest binary"
    found = asked.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(_answered, kind)
    out = named.join(found, "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.select(F.col("id").alias(key), *numbers, F.coalesce(F.lower(F.hex("digest")), F.lit("")).alias("groups_sha256"))


def align(docs: DataFrame, first: bytes, second: bytes, pattern: str, text: str = "text", groups: str = "groups") -> DataFrame:
    """Columns of ``docs`` and ``groups``: the text's groups of tokens, such as ``1,2|7;3|8,9``. Null where a text has
    no tokens (see ``measures``). A column of ``docs`` named like ``groups`` is replaced. An empty table gives an empty result."""
    docs = docs.drop(groups)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(first, second, pattern)
        for b in portions(batches, text, BYTES):
            full = pc.fill_null(pc.not_equal(b.column(text), ""), False).to_numpy(zero_copy_only=False)
            out = np.full(b.num_rows, None, object)
            if full.any():
                counts, codes, units = aligner.units(b.column(text).filter(pa.array(full)))
                tokens, order, wrong = aligner.align(units)
                out[full] = list(_written(_in_order(tokens.written(), order, len(units)), counts, codes))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, groups])

    schema = docs.withColumn(groups, F.lit(None).cast("string")).schema
    return docs.mapInArrow(work, schema)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    first, second = (read_ranks(spark, public.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return measures(table(spark, sf_dir, "documents"), first, second, public.PATTERN)
