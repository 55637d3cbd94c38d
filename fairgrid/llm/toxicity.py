"""Toxicity by a weighted finite-state grammar over clauses.

Words are told apart into the symbols of a small alphabet, insults by a learned lexicon of words and word stems. Five
weighted sequential transducers over these symbols each know one thing: what target follows (read from the right), what
target came before, which words are threats, what a negation reaches, what is reported or quoted. They are composed
into one machine, the product of their states with weights added along arcs, and a clause's matches are the outputs
of that machine: an insult or threat aimed at a target, a bare insult, a negated one, a reported one, each weighted by
the lexicon and by the arcs passed. A logistic model over sums of the matched clauses' weights gives the score, so
words count as what the clause makes of them and nothing else.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgrid.llm.common import documents, id_crc, release_table

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"«»“”„]")
CLAUSE_END = frozenset(".!?;:\n")
QUOTES = frozenset('"«»“”„')

# Words of the grammar by language; the last list has further closed-class words that tell the language.
WORDS = {
    "en": {
        "targets": "you your yours they them their he him she her it this these those who everyone", "copulas": "is are am be was were", "negations": "not no never neither nor without",
        "reports": "said says wrote writes called quoted reported claims", "threats": "kill hurt destroy beat burn shoot die", "closed": "the of and to in that for with on as at by from have",
    },
    "de": {
        "targets": "du dich dir ihr euch sie er es dieser diese", "copulas": "ist sind bist bin war", "negations": "nicht kein keine nie niemals ohne",
        "reports": "sagte schrieb nannte berichtete", "threats": "töten schlagen sterben", "closed": "der die das den dem des und ein eine von zu mit auf für im",
    },
    "fr": {
        "targets": "tu te toi vous il elle ils elles ce cette", "copulas": "est es sont suis êtes", "negations": "ne pas jamais sans",
        "reports": "dit écrit appelé", "threats": "tuer frapper mourir", "closed": "le la les des du et un une dans que pour qui au",
    },
    "es": {
        "targets": "tú ti usted ustedes él ella ellos ellas este esta", "copulas": "es son eres soy era", "negations": "no nunca sin jamás",
        "reports": "dijo escribió llamó", "threats": "matar golpear morir", "closed": "el la los las de y en que por un una con del",
    },
}
_LISTS = {language: {name: frozenset(told.split()) for name, told in own.items()} for language, own in WORDS.items()}
_CLOSED = {language: frozenset().union(*own.values()) - own["threats"] for language, own in _LISTS.items()}

#: Words of a clause that a report reaches over, and that a target may stand from its insult; a negation reaches half as far.
REACH = 6
FEATURES = ["bare", "aimed", "negated", "reported", "threat", "strongest", "clauses", "kinds"]

#: Input symbols, then what transducers make of insults and threats.
OTHER, TARGET, COPULA, NEGATION, REPORT, OPEN, CLOSE, INSULT, THREAT, INSULT_AT, THREAT_AT, AIMED, BARE, MENACE, NEGATED, REPORTED = range(16)
SYMBOLS = 16
KIND = {BARE: "bare", AIMED: "aimed", NEGATED: "negated", REPORTED: "reported", MENACE: "threat"}


@dataclass(frozen=True)
class Transducer:
    """A weighted sequential transducer: by state and input symbol the next state, the output symbol and the arc's weight.

    Weights are logarithms, added along a path; state 0 is the start and every state is final.
    """

    next: np.ndarray
    out: np.ndarray
    weight: np.ndarray

    def run(self, symbols: list[int]) -> tuple[list[int], list[float]]:
        """Outputs and arc weights of one path."""
        state, outs, weights = 0, [], []
        for x in symbols:
            outs.append(int(self.out[state, x]))
            weights.append(float(self.weight[state, x]))
            state = int(self.next[state, x])
        return outs, weights


def transducer(states: int, arcs: Callable[[int, int], tuple[int, int, float]]) -> Transducer:
    """Made of a function from state and symbol to next state, output and weight."""
    told = np.array([[arcs(s, x) for x in range(SYMBOLS)] for s in range(states)], float)
    return Transducer(told[..., 0].astype(np.int64), told[..., 1].astype(np.int64), told[..., 2])


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds the outputs of ``first`` to ``second``, cut to the states that can be reached."""
    places, todo, arcs = {(0, 0): 0}, [(0, 0)], []
    for s, t in todo:
        row = []
        for x in range(SYMBOLS):
            middle = first.out[s, x]
            state = (int(first.next[s, x]), int(second.next[t, middle]))
            if state not in places:
                places[state] = len(todo)
                todo.append(state)
            row.append((places[state], int(second.out[t, middle]), float(first.weight[s, x] + second.weight[t, middle])))
        arcs.append(row)
    return transducer(len(arcs), lambda s, x: arcs[s][x])


def _reach(start: tuple[int, ...], words: int, change: dict[int, int], fade: float = 0.0) -> Transducer:
    """State n: ``start`` was read n words short of its reach; in its reach symbols change, with weight falling by ``fade`` a word."""

    def arcs(state: int, x: int) -> tuple[int, int, float]:
        hit = state > 0 and x in change
        return (words if x in start else max(0, state - 1), change[x] if hit else x, -fade * (words - state) if hit else 0.0)

    return transducer(words + 1, arcs)


#: Read from the right: insults and threats that a target follows.
FOLLOWED = _reach((TARGET,), REACH, {INSULT: INSULT_AT, THREAT: THREAT_AT}, 0.05)
#: Read from the left, in this order.
PRECEDED = _reach((TARGET, COPULA), REACH, {INSULT: AIMED, INSULT_AT: AIMED, THREAT: MENACE, THREAT_AT: MENACE}, 0.05)
ALONE = transducer(1, lambda s, x: (0, {INSULT: BARE, INSULT_AT: AIMED, THREAT: OTHER, THREAT_AT: MENACE}.get(x, x), 0.0))
DENIED = _reach((NEGATION,), REACH // 2, dict.fromkeys((AIMED, BARE, MENACE), NEGATED))


def _told(words: int) -> Transducer:
    """What a report reaches, ``words`` long, or stands between two quotation marks, is reported; the closing mark ends both."""

    def arcs(state: int, x: int) -> tuple[int, int, float]:
        quoted, left = divmod(state, words + 1)
        hit = (quoted or left) and x in (AIMED, BARE, MENACE)
        left = words if x == REPORT else 0 if x == CLOSE else max(0, left - 1)
        return (words + 1) * (x == OPEN or (quoted and x != CLOSE)) + left, REPORTED if hit else x, 0.0

    return transducer(2 * (words + 1), arcs)


TOLD = _told(REACH)
GRAMMAR = compose(compose(compose(PRECEDED, ALONE), DENIED), TOLD)
_NEXT, _OUT, _WEIGHT, _F_NEXT, _F_OUT, _F_WEIGHT = (x.tolist() for m in (GRAMMAR, FOLLOWED) for x in (m.next, m.out, m.weight))


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon weights by word (``word$``) or stem, and the logistic model."""

    lexicon: dict[str, float]
    coefficients: tuple[float, ...] = (0.0,) * len(FEATURES)
    intercept: float = -3.0
    shortest: int = field(default=4)
    longest: int = field(default=8)


class Lexicon(dict):
    """Word to its symbol and weight in one language, the first transducer; each word is read once.

    An insult's weight is the best of its whole form and its stems; a threat outside the lexicon has weight 1.
    """

    def __init__(self, model: ToxicityModel, language: str = "en"):
        super().__init__()
        self.model, self.words = model, _LISTS[language]

    def __missing__(self, word: str) -> tuple[int, float]:
        held, words = self.model.lexicon, self.words
        best = max([held.get(word + "$", 0.0), *(held.get(word[:n], 0.0) for n in range(self.model.shortest, min(len(word), self.model.longest) + 1))])
        if word in words["negations"]:
            out = (NEGATION, 0.0)
        elif word in words["reports"]:
            out = (REPORT, 0.0)
        elif word in words["targets"]:
            out = (TARGET, 0.0)
        elif word in words["copulas"]:
            out = (COPULA, 0.0)
        elif word in words["threats"]:
            out = (THREAT, best or 1.0)
        else:
            out = (INSULT, best) if best else (OTHER, 0.0)
        if len(self) > 100_000:
            self.clear()
        self[word] = out
        return out


class Lexicons(dict):
    """The lexicon of each language."""

    def __init__(self, model: ToxicityModel):
        super().__init__({language: Lexicon(model, language) for language in WORDS})


def language_of(tokens: list[str]) -> str:
    """The language with most closed-class words among ``tokens``, of equals the first of WORDS."""
    counts = Counter(tokens)
    return max(WORDS, key=lambda language: sum(map(counts.__getitem__, _CLOSED[language])))


def paired_quotes(tokens: list[str]) -> dict[int, int]:
    """The quotation marks by place, OPEN and CLOSE in turn within a paragraph; one without its closing mark is left out."""
    out: dict[int, int] = {}
    opened = None
    for at, token in enumerate(tokens):
        if token == "\n":
            opened = None
        elif token in QUOTES:
            if opened is None:
                opened = at
            else:
                out[opened], out[at] = OPEN, CLOSE
                opened = None
    return out


def clause_matches(read: list[tuple[int, float]]) -> Iterator[tuple[str, float, int]]:
    """Kind, weight and place of each match of the grammar in one clause of symbols with lexicon weights."""
    state, symbols, weights = 0, [], []
    for symbol, _ in reversed(read):
        symbols.append(_F_OUT[state][symbol])
        weights.append(_F_WEIGHT[state][symbol])
        state = _F_NEXT[state][symbol]
    state, n = 0, len(read)
    for at in range(n):
        symbol = symbols[n - 1 - at]
        out = _OUT[state][symbol]
        if out >= AIMED:
            yield KIND[out], read[at][1] * math.exp(_WEIGHT[state][symbol] + weights[n - 1 - at]), at
        state = _NEXT[state][symbol]


def features(text: str | None, lexicons: Lexicons) -> list[float]:
    """What the grammar matched in all clauses of the whole text, in the order of FEATURES.

    Sums of weights by kind, the strongest clause, the share of clauses with a match and the number of different
    words matched; the last three leave out what is negated or reported. The words are those of the language that the
    text's own closed-class words tell. A quotation goes on over the ends of clauses until its closing mark.
    """
    tokens = TOKEN.findall((text or "").lower())
    read = list(map(lexicons[language_of(tokens)].__getitem__, tokens))
    sums = dict.fromkeys(("bare", "aimed", "negated", "reported", "threat"), 0.0)
    strongest, matched, clauses, kinds = 0.0, 0, 0, set()
    if any(weight for _, weight in read):
        quotes = paired_quotes(tokens)
        for at, symbol in quotes.items():
            read[at] = (symbol, 0.0)
        start, quoted = 0, False
        for at in range(len(tokens) + 1):
            if at == len(tokens) or tokens[at] in CLAUSE_END:
                clauses += at > start
                own, whole = read[start:at], 0.0
                if any(weight for _, weight in own):
                    for kind, weight, place in clause_matches([(OPEN, 0.0), *own] if quoted else own):
                        sums[kind] += weight
                        if kind not in ("negated", "reported"):
                            whole += weight
                            kinds.add(tokens[start + place - quoted])
                for symbol, _ in own:
                    quoted = symbol == OPEN or (quoted and symbol != CLOSE)
                matched += whole > 0
                strongest = max(strongest, whole)
                start = at + 1
    return [*(float(np.log1p(x)) for x in sums.values()), float(np.log1p(strongest)), 10.0 * matched / (clauses + 1), float(np.log1p(len(kinds)))]


def _terms(text: str, model: ToxicityModel) -> set[str]:
    """Lexicon candidates of a text: its words and their stems."""
    out = set()
    for word in set(re.findall(r"[^\W\d_]+", text.lower())):
        out.add(word + "$")
        out.update(word[:n] for n in range(model.shortest, min(len(word), model.longest) + 1))
    return out


def learn_lexicon(examples: DataFrame, entries: int = 1500, seen: int = 3, odds: float = 2.0) -> ToxicityModel:
    """Words and stems that mark label 1: ``examples`` has ``text`` and ``toxic``. Counted in Spark, ``entries`` at most are kept."""
    blank = ToxicityModel({})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                of[int(toxic)].update(_terms(text or "", blank))
                rows[int(toxic)] += 1
        terms = [t for t in of[1]]  # a term never seen under label 1 can't enter
        rest = [t for t in of[0] if t not in of[1]]
        names = ["", *terms, *rest]
        yield pd.DataFrame({"term": names, "pos": [rows[1], *(of[1][t] for t in terms), *([0] * len(rest))], "neg": [rows[0], *(of[0][t] for t in names[1:])]})

    counts = examples.select("text", "toxic").mapInPandas(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.where((F.col("pos") >= seen) | (F.col("term") == ""))
    totals = counts.where("term = ''").select(F.col("pos").alias("_p"), F.col("neg").alias("_n"))  # one row
    scored = counts.where("term <> ''").join(F.broadcast(totals))
    weight = F.log((F.col("pos") + 0.5) / (F.col("_p") + 1)) - F.log((F.col("neg") + 0.5) / (F.col("_n") + 1))
    scored = scored.select("term", "pos", weight.alias("weight")).where(F.col("weight") >= odds)
    top = scored.orderBy(F.desc(F.col("weight") * F.log1p("pos")), "term").limit(entries).collect()
    return ToxicityModel({r["term"]: float(r["weight"]) for r in top})


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients and intercept by Newton's method with an L2 penalty."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w)) * penalty
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000) -> ToxicityModel:
    """Lexicon and weights from labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0).

    At most ``sample_rows`` labelled rows are used, those with the least hash; half teach the lexicon, the other
    half the weights. Null labels teach nothing; an id with several labels has their mean.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(id_crc() % 5 != 0)
    agreed = usable.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", (F.floor(id_crc() / 5) % 2).alias("half"))
    lexicon = learn_lexicon(rows.where("half = 0"))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        insult = Lexicons(lexicon)
        for frame in frames:
            got = pd.DataFrame([features(t, insult) for t in frame["text"]], columns=FEATURES)
            got["toxic"] = frame["toxic"].to_numpy()
            yield got

    kinds = ", ".join(f"{f} double" for f in FEATURES)
    seen = rows.where("half = 1").select("text", "toxic").mapInPandas(measure, f"{kinds}, toxic int").toPandas()  # sample_rows at most
    if seen["toxic"].nunique() < 2:
        return lexicon
    w = _logistic(seen[FEATURES].to_numpy(float), seen["toxic"].to_numpy(float))
    return ToxicityModel(lexicon.lexicon, tuple(map(float, w[:-1])), float(w[-1]))


def scorer(model: ToxicityModel, text: Column) -> Column:
    """Probability of label 1 of a whole text; null and empty texts get the intercept's."""

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_table()
        insult = Lexicons(model)
        weights = np.array(model.coefficients)
        for texts in series:
            found = np.array([features(t if isinstance(t, str) else None, insult) for t in texts], float).reshape(-1, len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(found @ weights + model.intercept, -30, 30))))

    return score(text)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted`` for each row; a score of exactly 0.5 is predicted 1.

    Null and empty texts get the model's least evidence, its intercept; very long texts are read whole. Repeated rows
    give repeated rows, an empty table an empty result; only ``doc_id`` and ``text`` are read.
    """
    return docs.select("doc_id", scorer(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: every whole text of ``documents``, taught by ``labels``."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held, scorer(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
