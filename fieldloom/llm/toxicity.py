"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon (words and word beginnings) is learned from labelled documents. It is held as a trie;
a word of a text is matched by running its Levenshtein automaton along the trie, so that
misspelled terms are caught too. What an exact, a misspelled or a begun term is worth is measured
on the labelled documents again, and the context of each hit counts: quoted or reported
speech is worth less, direct address full.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import Steps, portions, table
from fieldloom.llm.shingles import minima, shingle_set

#: Labelled documents used for fitting, at most; chosen by a hash of their id.
SAMPLE = 12_000
#: A term is kept when its toxic rate is at least RATE and its log-likelihood ratio against the
#: overall rate at least EVIDENCE (chance gives that to one term in about a million).
RATE, EVIDENCE = 0.5, 14.0
#: Lengths of word beginnings that can become terms.
STEMS = (4, 5, 6, 7)
#: Allowed edits by length of the word: none below the first, one below the second, else two.
EDITS = (5, 9)
#: What a word or beginning that training has not met is worth beside its term, for each edit (a
#: choice, not fitted: training may hold no misspelled term). The words that training has met near a
#: term lower this for the term's other neighbours, as if PEERS more words had been worth it in full.
#: A word met there moves from this to its own measure, with the weight of PRIOR documents.
PER_EDIT, PEERS, PRIOR = 0.8, 3, 0.5
#: Words on either side of a hit that make its context, and what a quoted hit is worth.
WINDOW, QUOTED = 6, 0.35
THRESHOLD = 0.3
#: Odds by which scores are scaled, so that even odds of being toxic give the threshold.
EVEN = (1 - THRESHOLD) / THRESHOLD
#: Words that report speech or talk about a word, in the corpus's languages.
REPORTING = frozenset("said says say wrote writes called calls word term quote quoted quotes slur sagte sagt schrieb nannte wort begriff zitat "
                      "dit disait écrit appelé mot terme citation dijo dice escribió llamó palabra término cita".split())
QUOTES = "\"'“”„«»‘’"
MARK = re.compile(rf"[{QUOTES}\n]")
WORD_CHAR = re.compile(r"\w")
WORD = re.compile(r"[^\W\d_]+")
#: Words with the digits and symbols inside them, as in id1ot or i*iot.
MIXED = re.compile(r"[^\W_]+(?:[-*@$!#+.|_'’]{1,3}[^\W_]+)*")


@dataclass
class Lexicon:
    """Terms (``stem`` ones match as word beginnings) and what each kind of hit is worth."""

    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    worth: dict[str, float] = field(default_factory=dict)
    rates: dict[str, float] = field(default_factory=dict)
    peers: dict[str, float] = field(default_factory=dict)
    base: float = 0.01

    def inherited(self, kind: str) -> float:
        """What a kind is worth by its term or stem: PER_EDIT for each edit (one for a stem), less by
        what the term's other neighbours are worth."""
        sort, term, *rest = kind.split(":")
        if sort == "stem":
            return self.rates.get(term, 0.0) * PER_EDIT
        edits = int(rest[0]) if sort == "near" else 0
        return self.worth.get(f"word:{term}", 0.0) * PER_EDIT**edits * (self.peers.get(term, 1.0) if edits else 1.0)


class Automaton:
    """The words of a lexicon as a trie, walked by the Levenshtein automaton of a word.

    The automaton's states are bit sets, one for each number of edits: bit i says that i
    letters of the word are matched. A branch of the trie is left when no state is alive.
    """

    def __init__(self, terms: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in terms:
            at = 0
            for c in t:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                at = self.next[at][c]
            self.term[at] = t

    def match(self, word: str, edits: int) -> tuple[str, int] | None:
        """The term with the fewest edits (ties: the first in the alphabet), and the edits."""
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        full, done = (1 << len(word) + 1) - 1, 1 << len(word)
        start = [((1 << e + 1) - 1) & full for e in range(edits + 1)]
        best: tuple[int, str] | None = None
        stack = [(0, start)]
        while stack:
            at, states = stack.pop()
            if self.term[at] is not None:
                for e, s in enumerate(states):
                    if s & done:
                        best = min(best or (e, self.term[at]), (e, self.term[at]))
                        break
            for c, to in self.next[at].items():
                mask, new, before, last = places.get(c, 0), [], 0, 0
                for e, s in enumerate(states):
                    # a letter matched; or an insertion, a replacement, a deletion at one edit more
                    n = (s & mask) << 1
                    if e:
                        n |= before | before << 1 | last << 1
                    n &= full
                    new.append(n)
                    before, last = s, n
                if any(new):
                    stack.append((to, new))
        return (best[1], best[0]) if best else None


def letters(words: list[str]) -> np.ndarray:
    """A 32-bit set of letters for each word."""
    data = [w.encode("utf-16-le") for w in words]
    lengths = np.array([len(d) // 2 for d in data])
    codes = np.frombuffer(b"".join(data), np.uint16)
    bits = np.left_shift(np.uint32(1), (codes % 32).astype(np.uint32))
    return np.bitwise_or.reduceat(bits, np.concatenate([[0], np.cumsum(lengths)[:-1]]))


class Matcher:
    """Finds the kind of hit (``word:T``, ``near:T:E:WORD``, ``stem:T``) of every word, remembering.

    A word near a term counts as such before it counts for a stem. In a text, a stem's kind also says how many different words begin with it (up to MANY).
    """

    KNOWN, MANY = 150_000, 4

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.exact = lexicon, set(lexicon.words)
        self.stems = set(lexicon.stems)
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        long = [w for w in lexicon.words if len(w) >= EDITS[0]]
        self.automaton = Automaton(long)
        self.masks = letters(long) if long else np.empty(0, np.uint32)
        self.size = np.array([len(w) for w in long])
        self.known: dict[str, str | None] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > self.KNOWN:
            self.known, new = {}, list(words)
        close = np.zeros(len(new), bool)
        if len(self.masks):
            lengths = np.array([len(w) for w in new])
            allowed = np.where(lengths < EDITS[0], 0, np.where(lengths < EDITS[1], 1, 2))
            worth = np.flatnonzero(allowed)
            masks = letters(new)[worth]
            for i in range(0, len(worth), 1024):
                some = worth[i : i + 1024]
                # Each edit changes at most two letters of the set and one of the length.
                few = np.bitwise_count(masks[i : i + 1024, None] ^ self.masks) <= 2 * allowed[some, None]
                few &= np.abs(lengths[some, None] - self.size) <= allowed[some, None]
                close[some] = few.any(axis=1)
        for w, c in zip(new, close.tolist(), strict=True):
            hit = None
            if w in self.exact:
                hit = f"word:{w}"
            elif c and (m := self.automaton.match(w, 1 if len(w) < EDITS[1] else 2)):
                hit = f"near:{m[0]}:{m[1]}:{w}"
            elif w.isalpha():
                for n in self.lengths:
                    if w[:n] in self.stems and len(w) >= n:
                        hit = f"stem:{w[:n]}"
                        break
            self.known[w] = hit

    def hits(self, lowered: str, words: list[str], context: bool = True) -> dict[str, float]:
        """Kinds of hits in a text and how much their best context lets them count."""
        known = self.known
        found = {w: known[w] for w in set(words) if known.get(w)}
        # A mixed word adds nothing to a part of it that is a hit.
        for w in [w for w in found if not w.isalpha()]:
            if any(part in found for part in WORD.findall(w)):
                del found[w]
        times = Counter(found.values())
        found = {w: f"{k}:{min(times[k], self.MANY)}" if k.startswith("stem:") else k for w, k in found.items()}
        if not found or not context:
            return dict.fromkeys(found.values(), 1.0)
        out: dict[str, float] = {}
        spans = list(WORD.finditer(lowered))
        marks = [m.start() for m in MARK.finditer(lowered)]
        for i, m in enumerate(spans):
            if kind := found.get(m[0]):
                out[kind] = max(out.get(kind, 0.0), self._context(lowered, spans, marks, i, m))
        if any(not w.isalpha() for w in found):
            starts = [m.start() for m in spans]
            for m in MIXED.finditer(lowered):
                if not m[0].isalpha() and (kind := found.get(m[0])):
                    out[kind] = max(out.get(kind, 0.0), self._context(lowered, spans, marks, bisect_left(starts, m.start()), m))
        return out

    @staticmethod
    def _context(text: str, spans: list[re.Match], marks: list[int], i: int, m: re.Match) -> float:
        """QUOTED for a hit ``m`` (the words before it end at ``i``) in quotation marks or after a reporting word, else 1.

        A quotation reaches from an opening mark (a letter follows) to the next mark, a closing one
        (no letter follows), however far that is, within one line.
        """
        if any(s[0] in REPORTING for s in spans[max(0, i - WINDOW) : i]):
            return QUOTED
        at = bisect_left(marks, m.start())
        after = bisect_left(marks, m.end())
        if not at or after == len(marks):
            return 1.0
        left, right = marks[at - 1], marks[after]
        if text[left] == "\n" or text[right] == "\n":
            return 1.0
        opens, closes = WORD_CHAR.match(text, left + 1), not WORD_CHAR.match(text, right + 1)
        return QUOTED if (opens and closes) or (left + 1 == m.start() and right == m.end()) else 1.0


class Scorer:
    """Scores of texts: (score, number of kinds of hits) each."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.matcher = lexicon, Matcher(lexicon)

    def _worth(self, kind: str) -> float:
        """What was measured for the kind; for a stem met more often than in the sample, for fewer
        times; else what it inherits."""
        worth, head, times = self.lexicon.worth, kind, 0
        if kind.startswith("stem:"):
            head, _, n = kind.rpartition(":")
            times = int(n)
        while kind not in worth and times > 1:
            times -= 1
            kind = f"{head}:{times}"
        return worth[kind] if kind in worth else self.lexicon.inherited(kind)

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, int]]:
        held = [_words(t) for t in texts]
        self.matcher.learn(set().union(*(w for _, w in held)))
        for lowered, words in held:
            hits = self.matcher.hits(lowered, words)
            clean = 1.0 - self.lexicon.base
            for kind, weight in sorted(hits.items()):
                clean *= 1.0 - min(0.995, self._worth(kind)) * weight
            yield (1.0 - clean) / (1.0 - clean + clean * EVEN), len(hits)


def _words(text: str | None) -> tuple[str, list[str]]:
    """The text in lower case, its words, and beside them those with digits or symbols inside."""
    lowered = (text or "").lower()
    return lowered, WORD.findall(lowered) + [w for w in MIXED.findall(lowered) if not w.isalpha() and not w.isdigit()]


def training_rows(docs: DataFrame, labels: DataFrame, use, limit: int = SAMPLE) -> DataFrame:
    """``doc_id, text, toxic``: labelled documents for which ``use`` (a condition on doc_id) holds, at
    most ``limit`` by a hash of the id. The ids are at most ``limit`` rows, so they are broadcast."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(use)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")


def unlike(sample: DataFrame) -> DataFrame:
    """The rows of a bounded sample without most near copies, whose shared words would pass for
    evidence: a row stays if it is the least of those that share any of its four minimum hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            kept = [(i, minima(s, 4)) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if len(s := shingle_set(t))]
            if kept:
                ids, values = zip(*kept, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, 4)), pa.array(np.concatenate(values))], ["doc_id", "value"])

    # The least id of a value by partial sums and a join back: a value that many share is no task of its own.
    values = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, value long")
    least = values.groupBy("value").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("value", "least")
    copies = values.join(F.broadcast(least), "value").where("least < doc_id").select("doc_id").distinct()
    return sample.join(copies, "doc_id", "left_anti")


def fit(sample: DataFrame) -> Lexicon:
    """A lexicon from ``text, toxic`` rows, a bounded sample. The terms with enough evidence, and the
    counts of them and of the sample's words near them, reach the driver."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            n, k = Counter(), Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = set(filter(str.isalpha, _words(text)[1]))
                found = words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}
                n.update(found)
                if toxic:
                    k.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([k[t] for t in n], pa.int64())], ["term", "n", "k"])

    counted = sample.select("text", "toxic").mapInArrow(terms, "term string, n long, k long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    totals = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not totals[0] or not totals[1]:
        return Lexicon(base=0.01)
    rate = totals[1] / totals[0]
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    ratio = k * F.log(k / (n * rate)) + F.when(n > k, (n - k) * F.log((n - k) / (n * max(1e-9, 1 - rate)))).otherwise(0.0)
    kept = counted.where((k >= RATE * n) & (k > 0) & (ratio >= EVIDENCE)).orderBy(F.desc("k"), "term").collect()
    rates = {r.term[:-1]: r.k / r.n for r in kept if r.term.endswith("*")}
    # A stem within a stem adds nothing unless it says clearly more.
    least = [s for s in sorted(rates, key=len) if not any(s[:n] in rates and rates[s[:n]] >= rates[s] - 0.1 for n in range(1, len(s)))]
    lexicon = Lexicon([r.term for r in kept if not r.term.endswith("*")], least, rates={s: rates[s] for s in least})

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in portions(batches, "text"):
            n, k = Counter(), Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                lowered, words = _words(text)
                matcher.learn(set(words))
                hits = matcher.hits(lowered, words, context=False) or {"none": 1.0}
                n.update(hits.keys())
                if toxic:
                    k.update(hits.keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([k[t] for t in n], pa.int64())], ["kind", "n", "k"])

    found = sample.select("text", "toxic").mapInArrow(kinds, "kind string, n long, k long").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    met = found.orderBy("kind").collect()
    near = [r for r in met if r.kind.startswith("near:")]
    for r in met:
        if r.kind == "none":
            lexicon.base = min(0.25, (r.k + rate) / (r.n + 1))
        elif not r.kind.startswith("near:"):
            lexicon.worth[r.kind] = (r.k + PRIOR * rate) / (r.n + PRIOR)
    shares: dict[str, list[float]] = {}
    for r in near:
        shares.setdefault(r.kind.split(":")[1], []).append(min(1.0, r.k / r.n / max(1e-9, lexicon.inherited(r.kind))))
    lexicon.peers = {t: (sum(x) + PEERS) / (len(x) + PEERS) for t, x in shares.items()}
    for r in near:
        lexicon.worth[r.kind] = (r.k + PRIOR * lexicon.inherited(r.kind)) / (r.n + PRIOR)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score double, predicted int, n_hits int`` for every row of ``docs``.

    The score is a noisy-or over the kinds of hits, each with its measured worth times its
    context. Null and empty texts get the base score. Only the text counts; whole texts are
    read. Repeated rows score alike; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for b in portions(batches, "_text"):
            got = list(scorer.scores(b.column("_text").to_pylist()))
            scores, hits = np.array([s for s, _ in got]), np.array([n for _, n in got], np.int32)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(hits)],
                                             ["doc_id", "score", "predicted", "n_hits"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_hits int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for b in portions(batches, text):
            yield b.filter(pa.array([s < threshold for s, _ in scorer.scores(b.column(text).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Lexicon:
    """A lexicon from the labelled rows of ``docs`` that are not held out."""
    steps = Steps(spark)
    labelled = steps.keep(training_rows(docs, table(spark, sf_dir, "labels"), ~held_out()))
    sample = steps.keep(unlike(labelled))
    lexicon = fit(sample)
    steps.drop(labelled, sample)
    return lexicon


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
