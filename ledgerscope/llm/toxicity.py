"""Toxicity scores from a learned lexicon, fuzzy matching and context windows.

* **Lexicon.**  From a bounded labelled sample: words, and stems that open
  several words, far and significantly more frequent in toxic texts and met after several different
  words there (a passage that copies repeat teaches nothing).
* **Matching.**  The lexicon is a trie.  A Levenshtein automaton runs over it: a
  state is the set of (trie node, edits) that a word's letters can have reached,
  and states are made once, when first met.  Words that clean training texts use
  as they are (a short word next to a toxic one) are not misspellings.
* **Context.**  A hit counts less inside quotation marks, less still near a
  word of reporting, and more near a word that addresses someone.
* **Score.**  A logistic regression on the sum and the largest of the hits'
  strengths and on the number of different terms.

Defined results: null, empty or wordless texts have no hits and get the lowest
score; with no labelled toxic row, or no clean one, the lexicon is empty and
every score is the share of toxic labels (0 without labels); repeated rows score
alike; a document with several labels is toxic if one says so; null labels are
ignored; other columns pass through, except ones named like a result column.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable

#: Most labelled documents of each class that the model is fitted on.
SAMPLE = {1: 10_000, 0: 20_000}
#: Most lexicon entries: the most telling of the terms that pass all tests, so that no language's words are
#: cut for being rarer than another's.
TERMS = 50_000
#: Least toxic documents and least different words before it that a term needs.
LEAST_DOCS, LEAST_CONTEXTS = 3, 3
#: Least log odds of a term's share of toxic texts against its share of clean ones, and least
#: log-likelihood ratio of the two shares (one accident in 1,000): it asks of a term its own counts
#: only, whatever the sample's size or another language's best term.
LEAST_ODDS, LEAST_RATIO = 3.0, 10.83
STEM = range(4, 9)
#: Letters from which on a term may be matched with one and two edits.
ONE_EDIT, TWO_EDITS = 5, 9
#: Characters on each side of a hit that decide its context.
REACH = 80
THRESHOLD = 0.3
WORDS_KEPT = 1_000_000

_TOKEN = re.compile(r"[^\W_]+(?:[@$*!|]+[^\W_]+)*")
_LOOKALIKES = str.maketrans("013457@$!|", "oieastasii")
_OPENING, _CLOSING = re.compile("[\"“„«‹‘»]"), re.compile("[\"”“»›’«]")
_REPORTING = re.compile(r"\b(?:said|says|wrote|writes|called|calls|quoted?|word|term|sagte|schrieb|nannte|wort|"
                        r"dit|écrit|appelé|mot|dijo|escribió|llamó|palabra)\b")
_ADDRESS = re.compile(r"\b(?:you|your|you're|du|dich|dein|ihr|tu|toi|vous|votre|tú|eres|usted|vosotros)\b")


# ---- Levenshtein automaton over a trie -----------------------------------------------------------

class FuzzyLexicon:
    """Matches words against a trie of terms with a number of edits that a term's length allows.

    ``terms``: text -> (weight, is a stem).  A stem matches every word that it opens, with
    the edits that the opening takes.
    """

    def __init__(self, terms: dict[str, tuple[float, bool]], plain: set[str] = frozenset()):
        self.terms, self.plain = terms, plain
        self.children, self.ends, self.depth_edits = [{}], [None], [0]
        for term in sorted(terms):
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.depth_edits.append(0)
                node = self.children[node][letter]
                self.depth_edits[node] = max(self.depth_edits[node], self.allowed(term))
            self.depth_edits[0] = max(self.depth_edits[0], self.allowed(term))
            self.ends[node] = term
        self._reset()

    @staticmethod
    def allowed(term: str) -> int:
        return 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0

    def _reset(self) -> None:
        start = self._closed({0: 0})
        self.states, self.number, self.moves, self.accepts = [start], {start: 0}, [{}], [self._accepted(start)]

    def _closed(self, reached: dict[int, int]) -> frozenset:
        """Add what skipping letters of terms reaches, and stems passed (as ``-node``, with their edits);
        keep the fewest edits of each node."""
        waiting = list(reached.items())
        while waiting:
            node, edits = waiting.pop()
            if reached.get(node) != edits or node < 0:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.depth_edits[child] and reached.get(child, 99) > edits + 1:
                    reached[child] = edits + 1
                    waiting.append((child, edits + 1))
        for node, edits in list(reached.items()):
            term = self.ends[node] if node > 0 else None
            if term and self.terms[term][1] and edits <= min(self.allowed(term), reached.get(-node, 99) - 1):
                reached[-node] = edits
        return frozenset(reached.items())

    def _accepted(self, state: frozenset) -> tuple[str, int] | None:
        best = None
        for node, edits in state:
            term = self.ends[node if node >= 0 else -node]
            if term and edits <= self.allowed(term):
                rank = (edits, -self.terms[term][0], term)
                best = min(best, rank) if best else rank
        return (best[2], best[0]) if best else None

    def _move(self, at: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if reached.get(node, 99) > edits:
                reached[node] = edits

        for node, edits in self.states[at]:
            if node < 0:  # a stem was passed; any letters may follow
                reach(node, edits)
                continue
            if edits + 1 <= self.depth_edits[node]:
                reach(node, edits + 1)
            for wanted, child in self.children[node].items():
                cost = edits + (wanted != letter)
                if cost <= self.depth_edits[child]:
                    reach(child, cost)
        state = self._closed(reached)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.accepts.append(self._accepted(state) if state else None)
        return self.number[state]

    def match(self, word: str) -> tuple[str, int] | None:
        """The closest term and its edits."""
        if len(self.states) > 50_000:
            self._reset()
        at = 0
        for letter in word:
            after = self.moves[at].get(letter)
            if after is None:
                after = self.moves[at][letter] = self._move(at, letter)
            at = after
            if not self.states[at]:
                return None
        found = self.accepts[at]
        return None if found and found[1] and word in self.plain else found


# ---- features and score --------------------------------------------------------------------------

def context(text: str, start: int, end: int) -> float:
    """Weight of a hit from what stands around it: under 1 quoted, over 1 addressed."""
    before, after = text[max(0, start - REACH):start], text[end:end + REACH]
    weight = 1.0
    if _OPENING.search(before.rpartition("\n")[2]) and _CLOSING.search(after.partition("\n")[0]):
        weight = 0.35
        if _REPORTING.search(before) or _REPORTING.search(after):
            weight = 0.15
    elif _ADDRESS.search(before) or _ADDRESS.search(after):
        weight = 1.2
    return weight


def lowered(text: str) -> str:
    """``text`` in lower case with every character in its place; one whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.lexicon = FuzzyLexicon(model["terms"], model["plain"])
        self.top = max([w for w, _ in model["terms"].values()], default=1.0)
        self.clean, self.hit = set(), {}

    def hits(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """``(start, end, term, edits, strength)`` of every hit."""
        if not self.lexicon.terms:
            return []
        low = lowered(text)
        words = set(_TOKEN.findall(low))
        for word in words.difference(self.clean, self.hit):
            found = self.lexicon.match(word if word.isalpha() else word.translate(_LOOKALIKES))
            if found:
                self.hit[word] = found
            elif len(self.clean) < WORDS_KEPT:
                self.clean.add(word)
        out = []
        if not self.hit.keys().isdisjoint(words):
            for m in _TOKEN.finditer(low):
                if m[0] in self.hit:
                    term, edits = self.hit[m[0]]
                    strength = self.lexicon.terms[term][0] / self.top * 0.6 ** edits * context(low, *m.span())
                    out.append((*m.span(), term, edits, strength))
        return out

    def features(self, text: str | None, found: list | None = None) -> tuple[float, float, float]:
        """Features of a text, or of its ``found`` hits."""
        if found is None:
            found = self.hits(text) if text else []
        strengths = [h[4] for h in found]
        return math.log1p(sum(strengths)), max(strengths, default=0.0), math.log1p(len({h[2] for h in found}))

    def score(self, text: str | None, found: list | None = None) -> float:
        weights = self.model["weights"]
        z = weights[0] + sum(a * b for a, b in zip(weights[1:], self.features(text, found)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (first the constant) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.full(len(x), 1.0 / len(x))
    keep, w = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1)), np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (share * (p - y)) + keep @ w
        curve = (x * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


# ---- fitting -------------------------------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """``text, toxic`` of at most about ``sample`` documents of each class.

    Ids are drawn by a hash, and where their different rows are still more (many texts of one id), the rows by a hash of id and
    text; a row that repeats counts once.
    """
    flags = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = flags.where(_drawn(flags, F.xxhash64("doc_id"), sample))
    # At most some 30,000 ids, by the rates.
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(drawn), "doc_id").withColumn(
        "_h", F.xxhash64(F.lit("row"), "doc_id", "text"))
    once = durable(rows.dropDuplicates(["_h"]), "drawn")
    return durable(once.where(_drawn(once, F.col("_h"), sample)).select("text", "toxic"), "labelled")


def _drawn(rows: DataFrame, mark: Column, most: dict[int, int]) -> Column:
    """Whether a row is drawn, at a rate a class that leaves about ``most`` of it."""
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    rate = F.lit(0.0)
    for kind, limit in most.items():
        rate = F.when(F.col("toxic") == kind, min(1.0, limit / max(1, counts.get(kind, 0)))).otherwise(rate)
    return F.pmod(mark, F.lit(1 << 20)) < rate * (1 << 20)


def _word_counts(sample: DataFrame) -> DataFrame:
    """``word, toxic, clean``: documents that hold the word, summed in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                sums[toxic].update({w for w in _TOKEN.findall(text.lower()) if w.isalpha()})
            if len(sums[0]) + len(sums[1]) > 500_000:
                yield flushed(sums)
                sums = Counter(), Counter()
        yield flushed(sums)

    def flushed(sums) -> pa.RecordBatch:
        words = list(sums[0] | sums[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([sums[1][w] for w in words], pa.int64()),
             pa.array([sums[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

    return sample.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(sample: DataFrame, terms: set[tuple[str, bool]]) -> dict[tuple[str, bool], int]:
    """Different words before each term (with whether it is a stem) in toxic texts, counted up to distinct pairs."""
    shared = sample.sparkSession.sparkContext.broadcast(terms)
    stems = sorted({len(t) for t, stem in terms if stem})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = shared.value, set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                before = ""
                for word in _TOKEN.findall(text.lower()):
                    for term in ((word, False), *((word[:n], True) for n in stems if n <= len(word))):
                        if term in known:
                            found.add((*term, before))
                    before = word
        term, stem, before = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(stem, pa.bool_()),
                                          pa.array(before, pa.string())], names=["term", "stem", "before"])

    counted = sample.where("toxic = 1").select("text").mapInArrow(pairs, "term string, stem boolean, before string")
    return {(r["term"], r["stem"]): r["n"] for r in
            counted.distinct().groupBy("term", "stem").agg(F.count("*").alias("n")).collect()}


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, least_docs: int = LEAST_DOCS) -> dict:
    """The model: lexicon, clean near-words, weights.  Everything that reaches the driver is bounded by
    ``sample`` and ``TERMS``."""
    rows = labelled_sample(docs, labels, sample)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    share = toxic / (toxic + clean) if toxic + clean else 0.0
    constant = math.log(share / (1 - share)) if 0 < share < 1 else 40.0 * (1 if share else -1)
    nothing = {"terms": {}, "plain": set(), "weights": [constant, 0.0, 0.0, 0.0]}
    if not toxic or not clean:
        return nothing
    words = durable(_word_counts(rows), "words")
    odds = F.log((F.col("toxic") + 0.1) / toxic) - F.log((F.col("clean") + 0.5) / clean)
    n, part = F.col("toxic") + F.col("clean"), lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), n * (toxic / (toxic + clean))) + part(F.col("clean"), n * (clean / (toxic + clean))))
    good = (F.col("toxic") >= least_docs) & (F.col("odds") >= LEAST_ODDS) & (ratio >= LEAST_RATIO)
    single = words.where(F.length("word") >= 3).withColumn("odds", odds).where(good).select(
        F.col("word").alias("term"), "odds", "toxic", F.lit(False).alias("stem"))
    opened = (words.withColumn("n", F.explode(F.array(*[F.lit(i) for i in STEM]))).where(F.length("word") >= F.col("n"))
              .groupBy(F.substring("word", F.lit(1), F.col("n")).alias("term"))
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
                   F.sum((F.col("toxic") > 0).cast("int")).alias("words"))
              .withColumn("odds", odds).where(good & (F.col("words") >= 3))
              .select("term", "odds", "toxic", F.lit(True).alias("stem")))
    found = single.union(opened).collect()  # words of the sample
    contexts = _contexts(rows, {(r["term"], r["stem"]) for r in found})
    kept = sorted((r for r in found if contexts.get((r["term"], r["stem"]), 0) >= LEAST_CONTEXTS),
                  key=lambda r: (-r["odds"], r["term"], r["stem"]))[:TERMS]
    stems = {r["term"]: r["odds"] for r in kept if r["stem"]}
    # The shortest stem stands for the longer ones, where it is as telling.  Words stay beside it: they allow
    # more edits than a short stem.
    terms: dict[str, tuple[float, bool]] = {r["term"]: (r["odds"], False) for r in kept if not r["stem"]}
    terms |= {t: (odds, True) for t, odds in stems.items() if not any(
        t[:n] in stems and stems[t[:n]] >= odds - 0.5 for n in STEM if n < len(t))}
    if not terms:
        return nothing
    lexicon = rows.sparkSession.sparkContext.broadcast(FuzzyLexicon(terms))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lexicon.value.match
        for batch in batches:
            close = [w for w in batch.column("word").to_pylist() if (m := match(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array(close, pa.string())], names=["word"])

    def plain(counted: DataFrame) -> set[str]:
        return {r["word"] for r in counted.where("clean > 0").select("word").mapInArrow(near, "word string").collect()}

    model = {"terms": terms, "plain": plain(words), "weights": [0.0] * 4}
    # Each half is measured with the other half's clean words, so that the regression meets accidents like those
    # of documents that it has not seen.
    half = [rows.where(F.pmod(F.xxhash64("text"), F.lit(2)) == h) for h in (0, 1)]
    features = [r for h in (0, 1) for r in score_frame(
        half[h], {**model, "plain": plain(_word_counts(half[1 - h]))}, features=True).select(
            "toxic", "f_sum", "f_top", "f_terms").collect()]
    lexicon.unpersist()
    x = np.array([[r["f_sum"], r["f_top"], r["f_terms"]] for r in features])
    model["weights"] = logistic(x, np.array([r["toxic"] for r in features])).tolist()
    return model


def score_frame(docs: DataFrame, model: dict, text: str = "text", features: bool = False) -> DataFrame:
    """``docs`` with ``score`` (and its hits), or with the three features; a map job, no shuffle.

    The model holds at most ``TERMS`` terms and the clean words next to them in the sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("f_sum double, f_top double, f_terms double" if features else
             "score double, hits array<struct<start:int,end:int,term:string,edits:int,strength:double>>")
    names = ["f_sum", "f_top", "f_terms"] if features else ["score", "hits"]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [added])
    columns = [f.name for f in kept]
    hit = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()),
                              ("edits", pa.int32()), ("strength", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(text)]
            if features:
                found = np.array([scorer.features(t) for t in texts]).reshape(-1, 3)
                made = [pa.array(found[:, i]) for i in range(3)]
            else:
                found = [scorer.hits(t) if t else [] for t in texts]
                made = [pa.array([scorer.score(t, h) for t, h in zip(texts, found)], pa.float64()),
                        pa.array([[dict(zip(("start", "end", "term", "edits", "strength"), h)) for h in one]
                                  for one in found], hit)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + made, names=columns + names)

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rest = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4, F.lit(2))
    model = fit(docs.where(rest("doc_id") != 2), labels.where(rest("doc_id") != 2))
    return score_frame(docs, model).select("doc_id", (rest("doc_id") == 2).alias("held_out"), "score",
                                           (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                                           F.size("hits").alias("n_hits"))
