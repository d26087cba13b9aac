"""Toxicity: Levenshtein automata over a lexicon trie, with windows of context.

Lexicon: learned from labelled training documents (a bounded sample). A term is
a word, or a stem (all words that begin with it), that toxic documents hold and
others do not; terms are chosen greedily by the toxic documents they add.

Matching: the terms' trie is intersected with Levenshtein automata of distance 1
(2 for words from LONG letters on) into one automaton, whose states are
determinised as words ask for them and whose table is bounded; a word that no
term is near to reaches the empty state after a few letters. Words shorter than
FUZZY letters match exactly only. Words that the sample's other documents hold
twice or more are never misspellings (known words).

Context: each hit looks at CONTEXT words on both sides. Quotation marks around
it and words of reporting mark a quotation: such a hit counts QUOTED of a used
one in every sum. That discount is stated, not learned, since training samples
may hold no quoted hit at all. Repetition, capitals, exclamation marks and
further hits in the window mark abuse.

Score: a logistic regression over the sums of these, fitted by Newton steps on
the training sample with weights of 0 or more, so a document without hits gets
the base rate's score, and a quoted use never scores above the same used one.

Stems match exactly, as the start of a word; misspellings are looked for in whole
words. The number of terms is bounded by the significance test alone.

Neither label, language, source nor doc_id is an input of a score. Nulls: a
null text counts as empty and scores as a text without hits. doc_ids and labels
that are null, and labels that are not 0 or 1, train nothing. Repeated rows get
equal scores. Without labels of both kinds the lexicon is empty and every score
is the share of toxic labels (0 without labels). Extra columns pass through.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.bpe import Known, map_column

#: Most labelled training documents, the first by a hash of doc_id, and most bytes of their texts in all.
SAMPLE, SAMPLE_BYTES = 8_000, 64 << 20
#: Letters from which a word may be a misspelling, and by two edits.
FUZZY, LONG, CONTEXT = 5, 9, 8
#: A precise word of so many toxic training documents, and of a fiftieth of them, is a term in any case.
STRONG = 6
STEMS = range(4, 9)
TOKEN = re.compile(r"[^\W_]+|[\"“”«»„]|!+")
QUOTES = set("\"“”«»„")
#: Words of reporting, in the languages of common corpora.
REPORTING = frozenset("said says quoted wrote called term word dit écrit sagte schrieb dijo escribió".split())
#: What a quoted hit counts for, beside 1 for a used one.
QUOTED = 0.25
FEATURES = ["exact", "fuzzy", "distinct", "shouted", "dense", "rate"]


class Automaton:
    """All words within so many edits of a term: the terms' trie run against Levenshtein automata, determinised as words ask for it.

    A state is a set of (trie node, edits so far), with the fewest edits for each node; state 0 is the empty one.
    """

    MOST = 400_000

    def __init__(self, terms: list[str], edits: int) -> None:
        self.edits = edits
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in sorted(terms):
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = t
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[dict[int, int]] = [{}]
        self.accepts: list[tuple[str, int] | None] = [None]
        self.moves: dict[int, int] = {}
        self.start = self.number({0: 0})

    def number(self, state: dict[int, int]) -> int:
        """The state after the letters of terms that words may lack."""
        todo = list(state)
        while todo:
            node = todo.pop()
            e = state[node] + 1
            if e <= self.edits:
                for child in self.children[node].values():
                    if state.get(child, self.edits + 1) > e:
                        state[child] = e
                        todo.append(child)
        key = frozenset(state.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
            ends = [(e, self.term[n]) for n, e in state.items() if self.term[n] is not None]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.numbers[key]

    def move(self, at: int, letter: str) -> int:
        new: dict[int, int] = {}
        for node, e in self.states[at].items():
            for c, child in self.children[node].items():
                cost = e + (c != letter)
                if cost <= self.edits and cost < new.get(child, self.edits + 1):
                    new[child] = cost
            if e < self.edits and e + 1 < new.get(node, self.edits + 1):
                new[node] = e + 1
        return self.number(new)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance; of equally near ones the first by spelling."""
        if len(self.moves) > self.MOST:
            self.reset()
        at, moves = self.start, self.moves
        for c in word:
            key = at << 21 | ord(c)
            to = moves.get(key)
            if to is None:
                to = moves[key] = self.move(at, c)
            if not to:
                return None
            at = to
        return self.accepts[at]


class Lexicon:
    """Terms with a flag for stems, and words that are no misspellings."""

    def __init__(self, terms: dict[str, bool], known: frozenset[str] = frozenset()) -> None:
        self.terms, self.known = terms, known
        whole = [t for t, stem in terms.items() if not stem and len(t) >= FUZZY]
        self.near = (Automaton(whole, 1), Automaton([t for t in whole if len(t) >= LONG - 1], 2))
        self.stems = sorted({len(t) for t, stem in terms.items() if stem})

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, distance) of a lower-case word."""
        if self.terms.get(word) is not None:
            return word, 0
        for n in self.stems:
            if self.terms.get(word[:n]):
                return word[:n], 0
        if len(word) >= FUZZY and (found := self.near[0].match(word) or (len(word) >= LONG and self.near[1].match(word) or None)) and word not in self.known:
            return found
        return None

    def hits_in(self, chunk: str) -> bool:
        return any(self.match(w.lower()) is not None for w in TOKEN.findall(chunk) if w not in QUOTES)


def features(text: str | None, lexicon: Lexicon) -> tuple[list[float], list[tuple[str, str, int, bool]]]:
    """FEATURES of a text, and its hits: (term, word, distance, quoted)."""
    tokens = TOKEN.findall(text or "")
    hits, at, open_quotes, quote_at = [], [], 0, []
    for i, w in enumerate(tokens):
        if w in QUOTES:
            open_quotes += 1
        elif (m := lexicon.match(w.lower())) is not None:
            hits.append((m[0], w, m[1]))
            at.append(i)
            quote_at.append(open_quotes)
    exact = fuzzy = shouted = dense = all_hits = 0.0
    out, best = [], {}
    for k, (term, word, distance) in enumerate(hits):
        around = tokens[max(0, at[k] - CONTEXT) : at[k] + CONTEXT + 1]
        in_quotes = quote_at[k] % 2 == 1 and open_quotes > quote_at[k]
        is_quoted = in_quotes or any(x.lower() in REPORTING for x in around)
        counts = QUOTED if is_quoted else 1.0
        all_hits += counts
        exact += counts * (distance == 0)
        fuzzy += counts * (distance > 0)
        best[term] = max(counts, best.get(term, 0.0))
        shouted += counts * (word.isupper() or any(x[0] == "!" for x in around))
        dense += counts * ((k > 0 and at[k] - at[k - 1] <= CONTEXT) or (k + 1 < len(at) and at[k + 1] - at[k] <= CONTEXT))
        out.append((term, word, distance, is_quoted))
    squeeze = math.log1p
    rate = all_hits / math.sqrt(len(tokens)) if tokens else 0.0
    return [squeeze(exact), squeeze(fuzzy), squeeze(sum(best.values())), squeeze(shouted), squeeze(dense), rate], out


class Model:
    """A lexicon and the regression's weights, the intercept first."""

    def __init__(self, lexicon: Lexicon, weights: list[float]) -> None:
        self.lexicon, self.weights = lexicon, weights

    def scorer(self):
        """A function from a text to its score and hits. Texts without a hit in any part between white space need no context."""
        flags = Known(self.lexicon.hits_in)

        def score(text: str | None) -> tuple[float, list]:
            if text and any(map(flags.__getitem__, text.split())):
                x, hits = features(text, self.lexicon)
            else:
                x, hits = [0.0] * len(FEATURES), []
            z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), hits

        return score


def fit_weights(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1.0) -> list[float]:
    """Logistic regression with an intercept, by Newton steps on the ridge-penalised likelihood. A feature whose weight would be negative goes."""
    used = list(range(x.shape[1]))
    while True:
        w = newton(x[:, used], y, steps, ridge)
        below = [k for k, v in zip(used, w[1:]) if v < 0]
        if not below:
            out = [0.0] * x.shape[1]
            for k, v in zip(used, w[1:]):
                out[k] = v
            return [w[0], *out]
        used = [k for k in used if k not in below]


def newton(x: np.ndarray, y: np.ndarray, steps: int, ridge: float) -> list[float]:
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
    return w.tolist()


def choose_terms(candidates: list[tuple[str, bool, list[int]]], n_toxic: int) -> dict[str, bool]:
    """Greedily, by toxic documents not covered yet; whole words before stems. candidates: (term, stem, toxic documents)."""
    import heapq

    covered: set[int] = set()
    heap = [(-len(d), stem, -len(t) if not stem else len(t), t, frozenset(d)) for t, stem, d in candidates]
    heapq.heapify(heap)
    out: dict[str, bool] = {}
    while heap and len(covered) < n_toxic:
        _, stem, order, t, docs = heapq.heappop(heap)
        gain = len(docs - covered)
        if gain < 2:
            continue
        if heap and (-gain, stem, order, t) > heap[0][:4]:
            heapq.heappush(heap, (-gain, stem, order, t, docs))
            continue
        out[t] = stem
        covered |= docs
    # Whole words of many documents are terms of their own, though those documents hold others too.
    stems = tuple(t for t, stem in out.items() if stem)
    for t, stem, docs in candidates:
        if not stem and len(docs) >= max(STRONG, n_toxic / 50) and not (stems and t.startswith(stems)):
            out.setdefault(t, False)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, fold: int = 5, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """text, toxic of at most so many labelled documents, and bytes, outside of the held-out fold, in the order of a hash.

    Labels of other documents take no place in the sample. A text that does not fit into what is left of the bytes is skipped, and later ones that fit are
    taken. Of rows with one doc_id the smallest text trains.
    """
    ok = F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(fold)
    held = labels.where(ok).join(docs.select("doc_id"), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = held.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(*order).limit(most).checkpoint()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).checkpoint()
    # Sizes of at most `most` texts.
    left, fit = most_bytes, []
    for doc_id, size in rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0))).orderBy(*order).collect():
        if size <= left:
            left -= size
            fit.append((doc_id,))
    taken = docs.sparkSession.createDataFrame(fit, "doc_id long")
    return rows.join(F.broadcast(taken), "doc_id").orderBy(*order).select("text", "toxic")


def held_out(fold: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))


def learn(rows: list[tuple[str | None, int]], precision: float = 0.97, least: int = 3) -> Model:
    """The lexicon and the weights, from training texts and labels (a bounded sample)."""
    y = np.array([t for _, t in rows], float)
    n_toxic = int(y.sum())
    if not 0 < n_toxic < len(rows):
        share = n_toxic / len(rows) if rows else 0.0
        return Model(Lexicon({}), [30.0 if share else -30.0] + [0.0] * len(FEATURES))
    pool: dict[str, str] = {}
    words = [{pool.setdefault(w, w) for w in map(str.lower, TOKEN.findall(t or "")) if w[0].isalpha()} for t, _ in rows]
    share, good = n_toxic / len(rows), []
    for n in (0, *STEMS):
        keys = (lambda ws: {w for w in ws if len(w) >= 3}) if not n else (lambda ws, n=n: {w[:n] for w in ws if len(w) > n})
        toxic_docs: dict[str, list[int]] = {}
        for i, (_, label) in enumerate(rows):
            if label:
                for k in keys(words[i]):
                    toxic_docs.setdefault(k, []).append(i)
        tried = len(toxic_docs)
        toxic_docs = {k: d for k, d in toxic_docs.items() if len(d) >= least}
        other = dict.fromkeys(toxic_docs, 0)
        for i, (_, label) in enumerate(rows):
            if not label:
                for k in keys(words[i]):
                    if k in other:
                        other[k] += 1
        # Precise, and in more documents than chance would give any of the keys tried.
        good += [
            (k, n > 0, d) for k, d in toxic_docs.items()
            if len(d) >= precision * (len(d) + other[k]) and len(d) * math.log(1 / share) - math.log(tried / 20) > math.log(5)
        ]
    good = sorted(good, key=lambda g: (-len(g[2]), g[1], g[0]))
    terms = choose_terms(good, n_toxic)
    plain = Lexicon(terms)
    # Words of two documents or more that aren't toxic are no misspellings.
    seen: dict[str, int] = {}
    for i, (_, label) in enumerate(rows):
        if not label:
            for w in words[i]:
                if (m := plain.match(w)) is not None and m[1]:
                    seen[w] = seen.get(w, 0) + 1
    lexicon = Lexicon(terms, frozenset(w for w, k in seen.items() if k >= 2))
    x = np.array([features(t, lexicon)[0] for t, _ in rows])
    return Model(lexicon, fit_weights(x, y))


def score_column(df: DataFrame, model, text: str = "text", keep: bool = True) -> DataFrame:
    """Appends score and hits (array<struct<term, word, distance, quoted>>). model: a broadcast Model."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("word", pa.string()), ("distance", pa.int32()), ("quoted", pa.bool_())]))
    schema = "array<struct<term: string, word: string, distance: int, quoted: boolean>>"

    def make():
        score = model.value.scorer()

        def run(texts):
            both = [score(t) for t in texts]
            return [[z for z, _ in both], [[dict(zip(("term", "word", "distance", "quoted"), y)) for y in h] for _, h in both]]

        return run

    return map_column(df, text, [("score", "double", pa.float64()), ("hits", schema, kind)], make, keep)
