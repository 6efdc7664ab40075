"""Toxicity scores: Levenshtein automata over a lexicon trie, context windows, and a small logistic model.

The lexicon is learned from labelled rows: words, and word beginnings shared by several words, whose documents are
nearly always toxic. It is held in a trie; the trie's product with Levenshtein automata (one edit from SHORT_TERM
letters, two from LONG_TERM) is made deterministic lazily, so a word costs one table step per letter and most words end
after a few; the first letter may be edited like any other. Learned beginnings are nodes of the same trie that take no
edit and accept any end. Look-alike characters are folded first. What a misspelling is worth comes from how often the
labelled rows that hold one are toxic; words that merely resemble a term and are common in clean rows are exceptions.

For each hit the words around it are inspected: quotation marks or words that report speech make it a quotation, and
quoted hits enter the model as a feature of their own.

Defined cases: a null, empty or blank text has no hits and gets the model's base score; labels that are null are
ignored; without any labelled row of either kind every score is 0.5 times the share of toxic labels; repeated rows are
scored alike; extra columns are ignored; an empty table gives an empty result. Whole texts are read. `max_train` bounds
the labelled documents used for fitting (a fixed sample by hash of the id); counts inside that sample cover all of it,
and so the lexicon is bounded by what that sample holds. Several rows of one labelled id are all learned from.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch

SHORT_TERM, LONG_TERM = 5, 9
WINDOW = 6
EDGE = re.compile(r"^[^\w@$*!|]+|[^\w@$*|]+$")
# Characters commonly written in place of letters.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
QUOTES = set("\"“”„«»‟❝❞")
# Words that report speech.
REPORTING = {"said", "says", "quoted", "quote", "wrote", "called", "term", "word", "sagte", "zitat", "wort", "dit", "mot", "citation", "dijo", "palabra", "cita"}
N_FEATURES = 7
#: Words that a task remembers to be no hit; others are looked up again.
CLEAN_WORDS = 200_000


def fold(token: str) -> str:
    """A token in lower case without outer punctuation, look-alikes folded where it has letters too."""
    word = EDGE.sub("", token.lower())
    if word.isalpha():
        return word
    return word.translate(LOOK_ALIKE) if any(c.isalpha() for c in word) else word


class LexiconAutomaton:
    """Lazily determinised product of a trie with Levenshtein automata."""

    def __init__(self, terms: list[str], prefixes: list[str] = ()):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.most: list[int] = [0]  # edits that some term below a node allows
        for term in terms:
            self.ends[self._add(term, self.allowed(term))] = term
        self.begun = {self._add(p, 0): p for p in prefixes}
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.beginning: list[str | None] = []  # the learned beginning that a state has just read
        self.start = self._state({(0, 0)})

    def _add(self, term: str, edits: int) -> int:
        node = 0
        self.most[0] = max(self.most[0], edits)
        for c in term:
            if c not in self.children[node]:
                self.children.append({})
                self.most.append(0)
                self.children[node][c] = len(self.children) - 1
            node = self.children[node][c]
            self.most[node] = max(self.most[node], edits)
        return node

    @staticmethod
    def allowed(term: str) -> int:
        return 0 if len(term) < SHORT_TERM else 1 if len(term) < LONG_TERM else 2

    def _state(self, items: set) -> int:
        """Close under missing letters, keep the least edits per node where a term allows them, and number the set."""
        best: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, edits = todo.pop()
            if edits >= best.get(node, self.most[node] + 1):
                continue
            best[node] = edits
            if edits < self.most[node]:
                todo += [(child, edits + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
            self.moves.append({})
            self.beginning.append(next((self.begun[n] for n, e in key if not e and n in self.begun), None))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.items[state]:
            if c in self.children[node]:
                out.add((self.children[node][c], edits))
            if edits < self.most[node]:
                out.add((node, edits + 1))
                out |= {(child, edits + 1) for child in self.children[node].values()}
        self.moves[state][c] = to = self._state(out)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The closest term and its distance: exact, then a learned beginning (distance 0), then misspelled."""
        state, begun = self.start, None
        for i, c in enumerate(word):
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if not self.items[state]:
                break
            if self.beginning[state] and i + 1 < len(word):
                begun = self.beginning[state]
        found = min(((e, self.ends[n]) for n, e in self.items[state] if n in self.ends and e <= self.allowed(self.ends[n])), default=None)
        if found and not found[0]:
            return found[1], 0
        if begun:
            return begun + "-", 0
        return (found[1], found[0]) if found else None


class Model:
    def __init__(self, terms: dict[str, float], prefixes: dict[str, float], fuzzy: dict[int, float], exceptions: set[str], weights: list[float] | None = None):
        self.terms, self.prefixes, self.fuzzy, self.exceptions, self.weights = terms, prefixes, fuzzy, exceptions, weights
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _tools(self):
        if self._ready is None:
            self._ready = (LexiconAutomaton(list(self.terms), list(self.prefixes)), set(), {})
        return self._ready

    def lookup(self, token: str) -> tuple[str, int, float] | None:
        word = fold(token)
        if len(word) < 3:
            return None
        found = self._tools()[0].match(word)
        if not found or (found[1] and word in self.exceptions):
            return None
        term, distance = found
        value = (self.prefixes[term[:-1]] if term[-1] == "-" else self.terms[term]) if not distance else self.fuzzy.get(distance, 0.0)
        return (term, distance, value) if value > 0 else None

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(N_FEATURES)
        _, clean, hits = self._tools()
        tokens = text.split()
        distinct = set(tokens)
        for token in distinct - clean - hits.keys():
            found = self.lookup(token)
            if found:
                hits[token] = found
            elif len(clean) < CLEAN_WORDS:
                clean.add(token)
        found = distinct & hits.keys()
        if not found:
            return out
        best: dict[str, float] = {}
        abused = quoted = fuzzy = 0
        for i, token in enumerate(tokens):
            if token in found:
                term, distance, value = hits[token]
                around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
                left, right = tokens[max(0, i - WINDOW) : i + 1], tokens[i : i + WINDOW + 1]
                marked = any(QUOTES & set(x) for x in left) and any(QUOTES & set(x) for x in right)
                if marked or any(x.strip(".,;:").lower() in REPORTING for x in around):
                    quoted += 1
                else:
                    abused += 1
                    fuzzy += distance > 0
                    best[term] = max(best.get(term, 0.0), value)
        values = sorted(best.values(), reverse=True)
        out[:] = (values[0] if values else 0.0, math.log1p(sum(values[1:])), math.log1p(len(values)), math.log1p(abused), math.log1p(quoted), math.log1p(fuzzy), float(bool(values)))
        return out

    def score(self, text: str) -> float:
        z = self.weights[-1] + float(np.dot(self.weights[:-1], self.features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, toxic = [], []
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            found = {w for w in map(fold, set((text.as_py() or "").split())) if len(w) > 2}
            words += found
            toxic += [label] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["word", "toxic"])


def _resembling(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(list(model.terms), list(model.prefixes))
        for batch in batches:
            found = [automaton.match(w) for w in batch.column(0).to_pylist()]
            keep = pa.array([f is not None and f[1] > 0 for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[1] if f else 0 for f in found], pa.int32())], names=["word", "pos", "n", "distance"]).filter(keep)

    return run


def _feature_rows(model: Model):
    def run(batches):
        for batch in batches:
            rows = [[float(x) for x in model.features(t.as_py() or "")] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["f", "toxic"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Newton steps for ridge-regularised logistic regression; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return [float(v) for v in w]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 30_000, min_share: float = 0.85) -> Model:
    """Learn the lexicon, the worth of misspellings and the logistic weights from labelled rows."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    truth = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).filter("_id is not null and toxic in (0, 1)").dropDuplicates(["_id"])
    n = truth.count()
    if n > max_train:
        truth = truth.filter(F.expr(f"pmod(xxhash64(_id), 1000000) < {max_train * 1_000_000 // n}"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # The sample has about `max_train` rows at most, so it is broadcast and texts stay where they are.
    train = scratch.table("train", texts.join(F.broadcast(truth), "_id").select("text", "toxic"))
    base = train.agg(F.avg("toxic"), F.count("*")).first()
    base_rate = float(base[0] or 0.0)
    if not 0 < base_rate < 1:
        return Model({}, {}, {}, set(), [0.0] * N_FEATURES + [math.log((base_rate + 1e-3) / (2 - base_rate))])
    # Copies of one text count once, so that a much-copied document doesn't make its words terms.
    stats = train.dropDuplicates(["text"]).mapInArrow(_words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").cast("long").alias("pos"), F.count("*").alias("n"))
    stats = scratch.table("words", stats)
    odds = lambda pos, n: math.log((pos + 0.5) / (n - pos + 0.5)) - math.log(base_rate / (1 - base_rate))
    strong = stats.filter(F.expr(f"pos >= 10 and pos >= {min_share} * n")).collect()
    begun = stats.filter("length(word) > 4").select(F.explode(F.expr("transform(sequence(4, least(6, length(word) - 1)), k -> substring(word, 1, k))")).alias("p"), "pos", "n")
    begun = begun.groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count("*").alias("words"))
    begun = begun.filter(F.expr(f"words >= 5 and pos >= 15 and pos >= {min_share} * n")).collect()
    prefixes: dict[str, float] = {}
    for r in sorted(begun, key=lambda r: (len(r.p), r.p)):
        if not any(r.p.startswith(p) for p in prefixes):
            prefixes[r.p] = odds(r.pos, r.n)
    model = Model({r.word: odds(r.pos, r.n) for r in strong}, prefixes, {}, set())
    near = stats.mapInArrow(_resembling(model), "word string, pos long, n long, distance int").collect() if model.terms else []
    model.exceptions = {r.word for r in near if r.n >= 2 and r.pos < 0.5 * r.n}
    for d in (1, 2):
        rare = [(r.pos, r.n) for r in near if r.distance == d and r.word not in model.exceptions]
        model.fuzzy[d] = odds(sum(p for p, _ in rare) + 0.5, sum(n for _, n in rare) + 1) if rare else 1.0
    rows = train.mapInArrow(_feature_rows(model), "f array<double>, toxic int").collect()
    model.weights = logistic(np.array([r.f for r in rows]), np.array([r.toxic for r in rows], float))
    scratch.drop("words", "train")
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and n_hits of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, score double")


def filter_documents(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose score is below the threshold. Rows don't move: each task drops its own."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows kept for testing: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
