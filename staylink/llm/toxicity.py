"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and a clause into symbols: INSULT and THREAT (weighted),
TARGET, NEGATION, REPORT, or any other word. Small transducers for negation scope,
reported speech and targets are composed into one table; running a clause through it
gives the matched patterns (an insult, a denied insult, a reported threat at a target,
...) with their weights. The score is logistic in the pattern sums of all clauses:
matched clauses decide, not isolated words.

Which words and word beginnings are insults, how much each weighs, and how much a
pattern counts, is learned from labelled rows (a bounded sample); the closed classes
are fixed lists.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.llm.shared import columns
from staylink.llm.words import Words, slices, spans_hash

#: Labelled rows that a fit reads (expected size of the sample; all where there are fewer).
TRAIN_ROWS = 20_000
#: Entries of the learned lexicon at most (the most certain ones are kept): a bounded broadcast.
LEXICON = 20_000
#: Share of toxic rows among the rows that hold a lexicon entry, at least.
PRECISION = 0.9
#: Bytes of the word beginnings that may be learned.
STEMS = (4, 5, 6, 7)

# The closed classes, in the languages of the corpus.
TARGETS = "you your yours he she they them him her people everyone du dich dir ihr euch sie tu toi te vous vos ils elles usted ustedes ellos ellas".split()
NEGATIONS = "not no never isn't don't aren't wasn't nicht kein keine keinen nie niemals ne pas jamais aucun non nunca jamás ningún".split()
REPORTS = "said says say wrote writes quoted quote claimed called told reported sagte schrieb zitierte dit écrit cité dijo escribió citó".split()
THREATS = "kill hurt destroy attack beat burn shoot stab töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = 6
#: Words that a negation reaches.
SCOPE = 3

_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[[10, 33, 46, 59, 63]] = True  # line feed ! . ; ?

# ---------------------------------------------------------------- transducers


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step[state, symbol] is the next state, marks[state] what a match in it carries."""

    step: np.ndarray
    marks: tuple[frozenset[str], ...]


def negation() -> Transducer:
    step = np.array([[SCOPE if s == NEGATION else max(0, q - 1) for s in range(SYMBOLS)] for q in range(SCOPE + 1)])
    return Transducer(step, tuple(frozenset({"denied"} if q else ()) for q in range(SCOPE + 1)))


def reported_speech() -> Transducer:
    step = np.array([[1 if s == REPORT else q for s in range(SYMBOLS)] for q in range(2)])
    return Transducer(step, (frozenset(), frozenset({"reported"})))


def target() -> Transducer:
    step = np.array([[1 if s == TARGET else q for s in range(SYMBOLS)] for q in range(2)])
    return Transducer(step, (frozenset(), frozenset({"aimed"})))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both run side by side on the same symbols; a match carries the marks of both."""
    n = len(b.marks)
    step = np.array([[a.step[p, s] * n + b.step[q, s] for s in range(SYMBOLS)] for p in range(len(a.marks)) for q in range(n)])
    return Transducer(step, tuple(x | y for x in a.marks for y in b.marks))


GRAMMAR = compose(compose(negation(), reported_speech()), target())
STEP = GRAMMAR.step.tolist()

#: Patterns: (kind, marks), with the share of a full match that an unlearned grammar gives them.
PATTERNS = [(k, frozenset(m)) for k in ("insult", "threat") for m in ((), ("aimed",), ("denied",), ("reported",), ("aimed", "denied"), ("aimed", "reported"), ("denied", "reported"), ("aimed", "denied", "reported"))]
PRIOR = np.array([(1.0 if k == "insult" else 0.2) * (1.2 if "aimed" in m else 1) * (0.6 if "denied" in m else 1) * (0.6 if "reported" in m else 1) for k, m in PATTERNS])
_INDEX = {p: i for i, p in enumerate(PATTERNS)}
#: pattern of a match by symbol and state
MATCH = {s: [_INDEX[(k, m)] for m in GRAMMAR.marks] for s, k in ((INSULT, "insult"), (THREAT, "threat"))}


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(spans_hash(raw, np.array([0]), np.array([len(raw)]))[0])


@dataclass
class Model:
    """Lexicon (word or beginning -> weight), pattern weights and intercept."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    patterns: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    intercept: float = -3.0

    def __post_init__(self) -> None:
        fixed = [(w, c, 1.0) for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws]
        taken = {w for w, _, _ in fixed}
        self._words = self._sorted(fixed + [(w, INSULT, v) for w, v in self.words.items() if w not in taken])
        self._stems = {n: self._sorted([(w, INSULT, v) for w, v in self.stems.items() if len(w.encode()) == n]) for n in {len(w.encode()) for w in self.stems}}

    @staticmethod
    def _sorted(rows: list[tuple[str, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = sorted((word_hash(w), c, v) for w, c, v in rows)
        return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int8), np.array([r[2] for r in rows], float)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Pattern sums of every text (row) over its clauses."""
        words = Words(pc.utf8_lower(texts.cast(pa.large_string())), _SEPARATORS)
        n = len(words.starts)
        symbol, weight = np.zeros(n, np.int8), np.zeros(n)
        tables = [(size, t) for size, t in sorted(self._stems.items())] + [(None, self._words)]
        for size, (keys, kinds, weights) in tables:  # a whole word overrides a beginning, a longer beginning a shorter one
            if not len(keys) or not n:
                continue
            if size is None:
                at, ends = np.arange(n), words.ends
            else:
                at = np.flatnonzero(words.ends - words.starts >= size)
                ends = words.starts + size
            h = spans_hash(words.raw, words.starts[at], ends[at])
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            symbol[at[hit]], weight[at[hit]] = kinds[k[hit]], weights[k[hit]]
        out = np.zeros((len(words.counts), len(PATTERNS)))
        scored = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(scored):
            return out
        # clause number of every word: clause ends and text starts before it
        breaks = np.zeros(len(words.raw) + 1, np.int32)
        breaks[1:] += _CLAUSE_END[words.raw]
        breaks[words.offsets[:-1]] += 1
        clause = np.cumsum(breaks)[words.starts]
        first = np.searchsorted(clause, clause[scored])
        last = np.searchsorted(clause, clause[scored], side="right")
        doc = np.searchsorted(words.first, scored, side="right") - 1
        seen = -1
        for d, lo, hi in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True):
            if lo == seen:
                continue
            seen, state, matches = lo, 0, []
            own, weights = symbol[lo:hi].tolist(), weight[lo:hi].tolist()
            aimed = TARGET in own  # a target anywhere in the clause: the transducer starts from its final state
            state = 1 if aimed else 0
            for s, w in zip(own, weights, strict=True):
                if s in MATCH:
                    matches.append((MATCH[s][state], w))
                state = STEP[state][s]
            for pattern, w in matches:
                out[d, pattern] += w
        return np.log1p(out)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.patterns + self.intercept, -30, 30)))


# ---------------------------------------------------------------- learning


def parts_of(text: str) -> set[str]:
    """Words of a text, and the beginnings (marked by a star) of its longer words."""
    out = set()
    words = Words(pa.array([text.lower()], pa.large_string()), _SEPARATORS)
    raw = words.raw.tobytes()
    for w in {raw[s:e] for s, e in zip(words.starts.tolist(), words.ends.tolist(), strict=True)}:
        out.add(w.decode())
        for n in STEMS:
            if len(w) > n and (len(w) == n or w[n] & 0xC0 != 0x80):  # not inside a character
                out.add(w[:n].decode(errors="ignore") + "*")
    return out


def chance(t: int, c: int, toxic: int, clean: int) -> float:
    """How likely at least t of t + c rows with a part are toxic if the part says nothing."""
    n, p = t + c, toxic / (toxic + clean)
    if t <= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(t + 1) - math.lgamma(c + 1) + t * math.log(p) + c * math.log1p(-p))
    total = term
    for k in range(t, n):
        term *= (n - k) / (k + 1) * p / (1 - p)
        total += term
        if term < total * 1e-9:
            break
    return total


def weight(t: int, c: int, toxic: int, clean: int) -> float:
    """Smoothed log odds that a row with the part is toxic."""
    return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))


def _counted(sample: DataFrame, wanted=None) -> DataFrame:
    """(part, n): rows of the sample that hold the part; only the wanted ones if given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value if wanted is not None else None
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text").to_pylist():
                found = parts_of(text)
                seen.update(found if known is None else found & known)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["part", "n"])

    return sample.select("text").mapInArrow(count, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, false_parts: float = 1.0) -> Model:
    """The grammar's weights from labelled rows.

    docs (doc_id, text) and labels (doc_id, toxic); rows with a null in either, and labels
    without a document, teach nothing; repeated labels of a document count once (1 wins).
    Where there are more than train_rows labels, a sample of about that many is taken by a
    hash of the id. A part enters the lexicon if chance explains fewer than false_parts of
    all the parts tested together.
    """
    spark = docs.sparkSession
    marked = columns(labels, doc_id="doc_id", toxic="toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    if n > train_rows:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(n)) < train_rows)
    own = columns(docs, doc_id="doc_id", text="text").filter("text is not null")
    sample = own.join(F.broadcast(marked), "doc_id")  # at most about train_rows rows of two numbers
    sizes = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(intercept=3.0 if toxic else -3.0)
    hits = {r.part: r.n for r in _counted(sample.filter("toxic = 1")).filter("n >= 2").orderBy(F.desc("n"), "part").limit(8 * LEXICON).collect()}
    tests = max(1, len(hits))
    hits = {p: t for p, t in hits.items() if tests * chance(t, 0, toxic, clean) <= false_parts}
    wanted = spark.sparkContext.broadcast(frozenset(hits))
    misses = {r.part: r.n for r in _counted(sample.filter("toxic = 0"), wanted).collect()}
    sure = {p: weight(t, misses.get(p, 0), toxic, clean) for p, t in hits.items() if tests * chance(t, misses.get(p, 0), toxic, clean) <= false_parts}
    # words that only copies of a few rows repeat stand far below the real ones
    least = 0.5 * max(sure.values(), default=0.0)
    sure = {p: v for p, v in sure.items() if v >= least and hits[p] >= PRECISION * (hits[p] + misses.get(p, 0))}
    sure = dict(sorted(sure.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])
    top = max(sure.values(), default=1.0)
    model = Model({p: v / top for p, v in sure.items() if not p.endswith("*")}, {p[:-1]: v / top for p, v in sure.items() if p.endswith("*")})
    rows = featured(sample.select("doc_id", "text", "toxic"), model, ["doc_id", "toxic"]).select("toxic", "features").collect()
    x = np.array([r.features for r in rows])
    y = np.array([r.toxic for r in rows], float)
    model.patterns, model.intercept = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Newton steps; the ridge draws pattern weights to a common multiple of the prior grammar."""
    z = np.column_stack([x @ PRIOR, x, np.ones(len(x))])
    keep = np.array([1e-3, *[ridge * len(x) ** 0.5 + 1.0] * x.shape[1], 1e-6])
    w = np.zeros(z.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + keep * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(keep), g)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w[0] * PRIOR + w[1:-1], float(w[-1])


def featured(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """carry columns (text may be one of them), pattern sums and score of every row of docs."""
    read = list(dict.fromkeys([*carry, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = model.features(pc.fill_null(part.column("text"), ""))
                arrays = [part.column(c) for c in carry]
                arrays += [pa.array(list(found), pa.list_(pa.float64())), pa.array(model.scores(found), pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*carry, "features", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*read).mapInArrow(run, f"{schema}, features array<double>, score double")


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0: rows that teach nothing. Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row. Null texts are empty texts: no clause matches,
    so the intercept alone scores them. Repeated rows and null ids are scored one by one."""
    own = columns(docs, doc_id=id_col, text=text_col)
    return featured(own, model, ["doc_id"]).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def learned(spark, docs: DataFrame, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs, labels.filter(~held_out()))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs, learned(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
