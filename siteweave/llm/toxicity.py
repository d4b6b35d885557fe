"""Operator 5: toxicity by a weighted finite-state pattern grammar.

Tokens become classes (insult, threat, modal, target, negation, reported speech, other);
small transducers rewrite and weigh the class string of each clause and are composed into
one machine: negation and reported speech mark what they govern, the target transducer
marks insults aimed at somebody, the threat transducer joins a modal, a violent verb and
a target, the scorer weighs the marks. A document's features are sums over its matched
clauses, never counts of lone words; a logistic curve turns them into a score.

Insult stems and their weights, and the curve, are learned from labelled rows outside the
held-out fold, from a sample bounded by ``TRAIN_ROWS``. Language, source and doc_id are
no inputs.

Cases: null and empty texts get the score of a text without matches; very long texts are
read whole; without usable labels the fixed seed words serve; repeated rows repeat;
labels that disagree count each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.shared import Memo, kept_by, stored

TRAIN_ROWS = 40_000  # labelled rows that learning sees, chosen by hash
CANDIDATES = 50_000  # stems that are counted in clean rows
STEMS = 5_000  # size of the learned lexicon
MIN_DOCS, MIN_CONTEXTS, MIN_WEIGHT = 4, 4, 2.0
PREFIXES = (4, 5, 6)
FOLDS = 5

# Word classes of the grammar.
SEED_INSULTS = "idiot moron stupid scum pathetic loser worthless disgusting trash imbecile dumb retard bastard".split()
TARGETS = "you your you're youre u he she they them him her these those du dich dir ihr euch sie tu te toi vous ils elles usted ustedes vosotros ellos".split()
THREATS = "kill killing murder shoot stab hurt destroy strangle burn beat hang töten umbringen tuer frapper matar golpear".split()
MODALS = "will gonna shall must i'll we'll going should werde werden vais allons voy vamos".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't without nicht kein keine nie pas jamais nunca ningún".split()
REPORTS = "said says wrote writes called calls claimed reported quoted quote sagte schrieb dit écrit dijo escribió".split()

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n\"“”]")
BREAKS = frozenset('.!?;:\n"“”')
INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, OTHER = "I H M T N R O".split()


class Transducer:
    """A deterministic letter-to-letter weighted transducer.

    ``arcs[state][symbol]`` is (next state, output, weight); weights add up along a path.
    """

    def __init__(self, arcs: list[dict[str, tuple[int, str, float]]]):
        self.arcs = arcs

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds this one's output to the other."""
        places, todo, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            row = {}
            for symbol, (x, middle, v) in self.arcs[a].items():
                y, out, w = other.arcs[b][middle]
                if (x, y) not in places:
                    places[x, y] = len(places)
                    todo.append((x, y))
                row[symbol] = (places[x, y], out, v + w)
            arcs.append(row)
        return Transducer(arcs)


SYMBOLS = (INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, OTHER)
MARKED = (*SYMBOLS, "I-", "H-")
AIMED = (*MARKED, "I+", "I-+", "K", "K-")


def _scope(symbols: tuple[str, ...], opener: str, reach: int, marks: dict[str, str]) -> Transducer:
    """After ``opener``, rewrites symbols by ``marks`` for ``reach`` tokens (0: to the end)."""
    states = max(reach, 1) + 1
    arcs = []
    for state in range(states):
        row = {}
        for s in symbols:
            after = (state if not reach else max(0, state - 1)) if s != opener else states - 1
            row[s] = (after, marks.get(s, s) if state else s, 0.0)
        arcs.append(row)
    return Transducer(arcs)


def _target() -> Transducer:
    """Marks an insult with a target in the three tokens before it as aimed."""
    arcs = []
    for state in range(4):
        row = {s: (3 if s == TARGET else max(0, state - 1), s, 0.0) for s in MARKED}
        if state:
            row["I"], row["I-"] = (state - 1, "I+", 0.0), (state - 1, "I-+", 0.0)
        arcs.append(row)
    return Transducer(arcs)


def _threat() -> Transducer:
    """A violent verb within three tokens after a modal, then a target within two: a threat."""
    symbols, arcs = [s for s in AIMED if s not in ("K", "K-")], []
    for state in range(8):  # 1-3: after a modal; 4-5: after its verb; 6-7: the same, marked
        row = {}
        for s in symbols:
            if s == MODAL:
                after = 3
            elif s in ("H", "H-") and 1 <= state <= 3:
                after = 5 if s == "H" else 7
            else:
                after = state - 1 if state in (2, 3, 5, 7) else 0
            row[s] = (after, s, 0.0)
        if state in (4, 5):
            row[TARGET] = (0, "K", 0.0)
        if state in (6, 7):
            row[TARGET] = (0, "K-", 0.0)
        arcs.append(row)
    return Transducer(arcs)


def _scorer() -> Transducer:
    weights = {"I": 1.0, "I+": 2.0, "I-": -1.0, "I-+": -0.5, "K": 5.0, "K-": 1.0}
    return Transducer([{s: (0, s, weights.get(s, 0.0)) for s in AIMED}])


def grammar() -> Transducer:
    negation = _scope(SYMBOLS, NEGATION, 3, {"I": "I-", "H": "H-"})
    reported = _scope(MARKED, REPORT, 0, {"I": "I-", "H": "H-"})
    return negation.compose(reported).compose(_target()).compose(_threat()).compose(_scorer())


def stems_of(token: str) -> list[str]:
    return [token, *(token[:k] + "*" for k in PREFIXES if len(token) > k)]


class Matcher:
    """Features of a text: what its matched clauses weigh."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.machine = lexicon, grammar().arcs
        self.fixed = {w: c for c, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (MODAL, MODALS), (TARGET, TARGETS), (THREAT, THREATS)) for w in words}
        self.memo = Memo(self._classify, 200_000)

    def _classify(self, token: str) -> tuple[str, float]:
        weight = max((self.lexicon.get(s, 0.0) for s in stems_of(token)), default=0.0)
        return (INSULT, weight) if weight > 0 else (self.fixed.get(token, OTHER), 0.0)

    def clause(self, tokens: list[tuple[str, float]]) -> tuple[float, bool]:
        state, total, threat = 0, 0.0, False
        for symbol, weight in tokens:
            state, out, value = self.machine[state][symbol]
            total += value + (weight if out in ("I", "I+") else 0.3 * weight if symbol == INSULT else 0.0)
            threat |= out == "K"
        return total, threat

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """log(1 + sum), greatest, log(1 + number) of positive clauses; number of threats."""
        total = best = 0.0
        number = threats = 0
        clause: list[tuple[str, float]] = []
        live = False
        for token in TOKEN.findall((text or "").lower()):
            if token in BREAKS:
                if live:
                    score, threat = self.clause(clause)
                    if score > 0:
                        total, best, number = total + score, max(best, score), number + 1
                    threats += threat
                clause, live = [], False
                continue
            kind = self.memo[token]
            clause.append(kind)
            live = live or kind[0] in (INSULT, THREAT)
        if live:
            score, threat = self.clause(clause)
            if score > 0:
                total, best, number = total + score, max(best, score), number + 1
            threats += threat
        return math.log1p(total), best, math.log1p(number), float(threats)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic`` of labelled rows outside the held-out fold, about ``most`` at the most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, most / n) if n else 1.0
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return stored(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic"), "toxicity-rows")  # bounded by ``most``


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Weights (log odds) of stems that mark toxic rows.

    A stem must occur in ``MIN_DOCS`` toxic rows between ``MIN_CONTEXTS`` different pairs of
    neighbours, so that a passage copied many times teaches nothing.
    """
    bit = [1 << k for k in range(63)]

    def toxic_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        kept_by("toxicity")
        for batch in batches:
            docs: Counter[str] = Counter()
            masks: dict[str, int] = {}
            for text in batch.column(0):
                tokens = TOKEN.findall((text.as_py() or "").lower())
                seen = set()
                for k, token in enumerate(tokens):
                    if token in BREAKS or len(token) < 3:
                        continue
                    around = bit[zlib.crc32(f"{tokens[k - 1] if k else ''} {tokens[k + 1] if k + 1 < len(tokens) else ''}".encode()) % 63]
                    for stem in stems_of(token):
                        seen.add(stem)
                        masks[stem] = masks.get(stem, 0) | around
                docs.update(seen)
            yield pa.RecordBatch.from_pydict({"stem": list(docs), "n": pa.array(docs.values(), pa.int64()), "around": pa.array([masks[s] for s in docs], pa.int64())})

    totals = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    stems = train.where("toxic = 1").select("text").mapInArrow(toxic_stems, "stem string, n long, around long")
    stems = stems.groupBy("stem").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("around")).alias("around"))
    found = stems.where((F.col("n") >= MIN_DOCS) & (F.col("around") >= MIN_CONTEXTS)).orderBy(F.desc("n"), "stem").limit(CANDIDATES).collect()
    toxic = {r.stem: r.n for r in found}

    def clean_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        docs: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                docs.update({s for t in set(TOKEN.findall((text.as_py() or "").lower())) for s in stems_of(t) if s in toxic})
        yield pa.RecordBatch.from_pydict({"stem": pa.array(docs, pa.string()), "n": pa.array(docs.values(), pa.int64())})

    clean = train.where("toxic = 0").select("text").mapInArrow(clean_stems, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    clean_n = {r.stem: r.n for r in clean.collect()}  # at most CANDIDATES rows
    weights = {s: math.log((n + 0.5) / (bad + 1)) - math.log((clean_n.get(s, 0) + 0.5) / (good + 1)) for s, n in toxic.items()} if good else {}
    chosen = sorted((s for s, w in weights.items() if w >= MIN_WEIGHT), key=lambda s: (-weights[s], s))[:STEMS]
    return {s: 3.0 for s in SEED_INSULTS} | {s: weights[s] for s in chosen}


def fit_curve(features: np.ndarray, toxic: np.ndarray, penalty: float = 1e-2) -> list[float]:
    """Logistic regression by Newton steps; the intercept comes last."""
    if not len(toxic) or toxic.min() == toxic.max():
        return [1.0, 0.3, 0.5, 1.0, -2.0]
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty * np.eye(len(w)) * len(x) ** 0.5
        move = np.linalg.solve(curve, x.T @ (toxic - p) - penalty * len(x) ** 0.5 * w)
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w.tolist()


def train_model(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    train = training_rows(docs, labels)
    lexicon = learn_lexicon(train)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        matcher = Matcher(lexicon)
        for batch in batches:
            rows = [matcher.features(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.float64()) for k in range(4)), batch.column(1)], ["a", "b", "c", "d", "toxic"])

    rows = train.mapInArrow(measure, "a double, b double, c double, d double, toxic int").toPandas()  # bounded by TRAIN_ROWS
    return lexicon, fit_curve(rows[["a", "b", "c", "d"]].to_numpy(float), rows["toxic"].to_numpy(float))


def with_scores(docs: DataFrame, model: tuple[dict[str, float], list[float]], name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; reads ``text`` alone."""
    lexicon, curve = model
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        matcher = Matcher(lexicon)
        for batch in batches:
            scores = []
            for text in batch.column(text_at):
                z = curve[-1] + sum(w * x for w, x in zip(curve, matcher.features(text.as_py()), strict=False))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(run, schema)


def tolerable_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score under 0.5, with their own columns (stage of the pipeline)."""
    return with_scores(docs, train_model(docs, labels), "_toxicity").where("_toxicity < 0.5").select(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = with_scores(docs, train_model(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
