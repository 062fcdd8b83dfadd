"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (a stem of the lexicon), threat, intent, target, copula, filler, negation, report, quote, other.
Five small transducers read the symbols of a clause. The insult machine finds insults said outright, described (a complete
fool) or attributed (you are such a fool); the threat machine threats that are bare, intended (will ... hurt) or direct
(hurt you); the negation machine marks what a negation governs, the reported-speech machine what stands in quotes or
after a reporting verb, the target machine clauses that have a person as their target, unless that person is the one who
reports. Their composition is one machine. The weights of a clause's matches add up along its path, and its best match (the
heaviest word, then the stronger pattern) gives the clause its label and its head; clauses, not isolated words, are scored. The stems of the lexicon and the weights of the
labels are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewright.llm.shared import Scratch, whole_text

#: Labelled rows that the model is fitted on at most (by expectation; a hash of the doc_id picks them).
TRAIN_ROWS = 24_000
#: A stem must follow so many different words in toxic rows, and be so many times as frequent there.
CONTEXTS, RATIO = 6, 15.0
SHORTEST, LONGEST = 3, 8

# The closed word classes of the grammar, in four languages.
INSULTS = "idiot moron loser scum trash stupid pathetic worthless disgusting clown imbécile crétin ordure idiota imbécil basura estúpido dummkopf abschaum trottel".split()
THREATS = "kill hurt destroy beat attack burn punish töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself they them he she him her du dich dir dein ihr euch sie tu toi te vous votre ils elle tú usted ustedes vosotros ellos ella".split()
NEGATIONS = "not never no neither nor isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún tampoco".split()
COPULAS = "are is am were was be 're 's bist ist seid sind es est êtes sont eres sois son soy".split()
FILLERS = "a an the such so really very complete total absolute ein eine einen so total wirklich sehr un une le la si tellement très vraiment una el tan muy realmente".split()
INTENTS = "will shall gonna going want wanna let must should werde werden wirst will vais va allons veux voy vamos quiero debes".split()
REPORTS = "said says saying called calls wrote writes claimed quoted reported sagte sagt schrieb nannte dit écrit appelé déclaré dijo dice escribió llamó".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, COPULA, FILLER, INTENT = range(10)
#: Words that a negation governs, and words after an intent in which a threat is intended.
REACH = 3
#: Strengths of a match: an insult is outright, described or attributed; a threat is bare, intended or direct.
OUTRIGHT, DESCRIBED, ATTRIBUTED = BARE, INTENDED, DIRECT = 1, 2, 3
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|'[^\W\d_]+|[.!?;:\n]+|[\"“”«»„]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_BREAK = frozenset(".!?;:\n")


def _insults(state: int, symbol: int) -> tuple[int, int]:
    """States: 0 nothing, 1 after a target, 2 in what is said of a target, 3 in a description."""
    if symbol == INSULT:
        return (2, ATTRIBUTED) if state in (1, 2) else (3, DESCRIBED if state == 3 else OUTRIGHT)
    if symbol == NEGATION:
        return state, 0
    if symbol == TARGET:
        return 1, 0
    if symbol == COPULA:
        return (2 if state == 1 else 0), 0
    if symbol == FILLER:
        return (2 if state in (1, 2) else 3), 0
    return 0, 0


def _threats(state: int, symbol: int) -> tuple[int, int]:
    """States: 0 nothing, 1 to REACH + 1 words left for an intent to find its threat, the last after a threat."""
    after = REACH + 2
    if symbol == INTENT:
        return REACH + 1, 0
    if symbol == THREAT:
        return after, INTENDED if 0 < state < after else BARE
    if state == after:
        return (after if symbol == FILLER else 0), DIRECT if symbol == TARGET else 0
    return max(0, state - 1), 0


def _negation(state: int, symbol: int) -> tuple[int, int]:
    return (REACH, 0) if symbol == NEGATION else (max(0, state - 1), int(state > 0))


def _reported(state: int, symbol: int) -> tuple[int, int]:
    if symbol == QUOTE:
        return (0 if state == 2 else 2), 0
    return (state or int(symbol == REPORT)), int(state > 0)


def _targeted(state: int, symbol: int) -> tuple[int, int]:
    """States: 0 no target, 1 one that may turn out to be the subject of a report, 2 a target; it gives the state before."""
    if state == 1 and symbol == REPORT:
        return 0, 0
    return (2 if state else int(symbol == TARGET)), state


def compose(machines: list[tuple]) -> dict[tuple[tuple, int], tuple[tuple, tuple]]:
    """The product of transducers (step function, states): (states, symbol) -> (states, outputs)."""
    table = {}
    for states in product(*(range(n) for _, n in machines)):
        for symbol in range(10):
            steps = [f(s, symbol) for (f, _), s in zip(machines, states, strict=True)]
            table[states, symbol] = tuple(s for s, _ in steps), tuple(m for _, m in steps)
    return table


GRAMMAR = compose([(_insults, 4), (_threats, REACH + 3), (_negation, REACH + 1), (_reported, 3), (_targeted, 3)])
START = (0, 0, 0, 0, 0)
#: Labels of a clause: insult or threat, its strength, negated or not, reported or not, aimed at a target or not.
LABELS = list(product((INSULT, THREAT), (1, 2, 3), (0, 1), (0, 1), (0, 1)))
_LABEL = {x: i for i, x in enumerate(LABELS)}
#: Per label the log of 1 + the summed weights of its clauses; besides the logs of 1 + clauses matched and of 1 + different heads
#: of them, and the share of the clauses that match.
N_FEATURES = len(LABELS) + 3


def matched(clause: list[tuple]) -> tuple[tuple, float, int] | None:
    """(label, weight, place of the head) of a clause, given as (symbol, lexical weight, ...) of its words, or None where no
    pattern matches. A direct threat has the weight and place of the threat word before its target; that word counts once.
    """
    state, found, threat, total = START, [], (0.0, 0, 0, 0), 0.0
    for place, (symbol, weight, *_) in enumerate(clause):
        state, (insult, threatens, negated, reported, _) = GRAMMAR[state, symbol]
        if symbol == THREAT:
            threat = (weight, negated, reported, place)
        if insult:
            found.append((weight, insult, INSULT, negated, reported, place))
            total += weight
        if threatens == DIRECT:
            found.append((threat[0], DIRECT, THREAT, *threat[1:]))
        elif threatens:
            found.append((weight, threatens, THREAT, negated, reported, place))
            total += weight
    if not found:
        return None
    _, strength, kind, negated, reported, place = max(found)
    return (kind, strength, negated, reported, int(state[4] > 0)), total, place


class Lexicon:
    """Word -> (symbol, weight); learned stems are prefixes, or whole words where they end in $."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.words = dict.fromkeys(TARGETS, (TARGET, 0.0)) | dict.fromkeys(NEGATIONS, (NEGATION, 0.0))
        self.words |= dict.fromkeys(FILLERS, (FILLER, 0.0)) | dict.fromkeys(COPULAS, (COPULA, 0.0)) | dict.fromkeys(INTENTS, (INTENT, 0.0))
        self.words |= dict.fromkeys(REPORTS, (REPORT, 0.0)) | dict.fromkeys(THREATS, (THREAT, 2.0))
        self.words |= dict.fromkeys(INSULTS, (INSULT, 3.0))
        self.seen: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        found = self.seen.get(word)
        if found is None:
            weight = max((self.stems.get(s, 0.0) for s in stems_of(word)), default=0.0)
            found = (INSULT, weight) if weight else self.words.get(word, (OTHER, 0.0))
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = found
        return found


def stems_of(word: str) -> list[str]:
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + "$"]


def clauses(text: str, lexicon: Lexicon) -> Iterator[list[tuple[int, float, str]]]:
    """The clauses of a text as (symbol, lexical weight, word) of their words; they end at . ! ? ; : and line ends."""
    clause: list[tuple[int, float, str]] = []
    for token in _TOKEN.findall(text.lower()):
        if token[0] in _BREAK:
            if clause:
                yield clause
            clause = []
        else:
            clause.append((*lexicon.symbol(token), token) if token[0] not in '"“”«»„' else (QUOTE, 0.0, token))
    if clause:
        yield clause


def features(text: str, lexicon: Lexicon) -> np.ndarray | None:
    """The features of a text, or None where no clause matches."""
    if not any(lexicon.symbol(w)[0] in (INSULT, THREAT) for w in set(_WORD.findall(text.lower()))):
        return None
    out, n, hits, heads = np.zeros(N_FEATURES), 0, 0, set()
    for clause in clauses(text, lexicon):
        n += 1
        hit = matched(clause)
        if hit:
            hits += 1
            out[_LABEL[hit[0]]] += hit[1]
            heads.add(clause[hit[2]][2])
    if not hits:
        return None
    out[: len(LABELS)] = np.log1p(out[: len(LABELS)])
    out[len(LABELS) :] = math.log1p(hits), math.log1p(len(heads)), hits / n
    return out


def _training_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text, toxic, half of a bounded sample of labelled rows outside the held-out fold."""
    learn = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out("doc_id"))
    learn = learn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = learn.count()
    share = min(1.0, TRAIN_ROWS / max(1, n))
    pick = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < int(share * 1_000_000)
    chosen = learn.filter(pick).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))
    return scratch.table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "train")


def _stems(train: DataFrame, scratch: Scratch) -> dict[str, float]:
    """The lexicon: stems that rows labelled toxic use in many contexts and other rows hardly use.

    Where a longer stem accounts for nearly all uses of a shorter one, only the longer, more specific one stays.
    """
    words = train.filter("half = 0").select(
        "doc_id", "toxic", F.expr(r"regexp_extract_all(lower(text), '[\\p{L}]+', 0)").alias("w")
    )
    sizes = {r.toxic: r.n for r in words.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}
    stems = f"concat(transform(sequence({SHORTEST}, greatest({SHORTEST}, least({LONGEST}, length(word)))), k -> left(word, k)), array(concat(word, '$')))"
    pairs = words.filter("toxic = 1").select(
        F.expr("explode(arrays_zip(w, concat(array(''), w)))").alias("p")
    ).select(F.col("p.w").alias("word"), F.col("p.1").alias("left")).filter("word IS NOT NULL").distinct()
    contexts = pairs.select(F.explode(F.expr(stems)).alias("stem"), "left").distinct().groupBy("stem").agg(F.count("*").alias("contexts"))
    used = words.select("toxic", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")
    )
    used = used.select(F.explode(F.expr(stems)).alias("stem"), "t", "o").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    rate = (F.col("t") / sizes[1]) / ((F.col("o") + 0.5) / sizes[0])
    found = used.filter(F.col("t") >= CONTEXTS).withColumn("rate", rate).filter(F.col("rate") >= RATIO)
    found = found.join(contexts.filter(F.col("contexts") >= CONTEXTS), "stem")  # of the bounded sample, so they are few
    found = {r.stem: (r.t, min(6.0, math.log(r.rate))) for r in found.select("stem", "t", "rate").collect()}
    return {s: w for s, (t, w) in found.items() if not any(c != s and c.startswith(s) and found[c][0] >= 0.95 * t for c in found)}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights, the intercept last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1.0, len(x) / 1000))
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _plain(kind: int, strength: int, negated: int, reported: int, aimed: int) -> float:
    if kind == THREAT and strength == BARE and not aimed:
        return 0.0
    return 0.3 if negated or reported else 1.0 + 0.2 * strength


#: Weights where there are no labels to learn from: insults and threats count by their strength, negated or reported ones little.
UNTRAINED = np.array([*(_plain(*label) for label in LABELS), 0.7, 0.5, 0.3, -4.0])


class Model:
    def __init__(self, stems: dict[str, float], weights: np.ndarray):
        self.stems, self.weights = stems, weights

    def task(self, with_features: bool = False):
        stems, weights = self.stems, self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = Lexicon(stems)
            for batch in batches:
                rows = [features(t.as_py(), lexicon) for t in batch.column(1)]
                x = np.zeros((len(rows), N_FEATURES))
                for i, r in enumerate(rows):
                    if r is not None:
                        x[i] = r
                out = {"doc_id": batch.column(0)}
                if with_features:
                    out |= {"x": pa.array(list(x), pa.list_(pa.float64())), "toxic": batch.column(2)}
                else:
                    p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                    out |= {"score": pa.array(p), "n_matches": pa.array(np.round(np.expm1(x[:, len(LABELS)])).astype(np.int64))}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows of ``labels`` (doc_id, toxic) that are not held out: one half of a bounded sample
    gives the lexicon, the other the weights. Without labels of both kinds the built-in words and weights hold."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = _training_rows(whole_text(docs), labels, scratch)
    stems = _stems(rows, scratch)
    use = rows.filter("half = 1").select("doc_id", "text", F.col("toxic").cast("long").alias("toxic"))
    got = use.mapInArrow(Model(stems, UNTRAINED).task(with_features=True), "doc_id long, x array<double>, toxic long").collect()
    y = np.array([r.toxic for r in got], dtype=float)
    if not stems or len(set(y.tolist())) < 2:
        return Model(stems, UNTRAINED)
    return Model(stems, fit(np.array([r.x for r in got]), y))


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches (matched clauses) of every row of ``docs``.

    Null, empty and blank texts match nothing and get the lowest score. Repeated rows are scored one by one; rows
    without a doc_id are left out; an empty table gives an empty result. Other columns are not read.
    """
    found = whole_text(docs).mapInArrow(model.task(), "doc_id long, score double, n_matches long")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; equal texts fare alike."""
    model = train(docs, labels)
    task = model.task()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text").fill_null("")], names=["doc_id", "text"])
            score = next(task(iter([judged]))).column("score").to_numpy()
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(judge, docs.schema)
