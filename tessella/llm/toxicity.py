"""Toxicity by a support vector machine with a gapped subsequence string kernel on Nyström landmarks.

The kernel compares two words by the subsequences of three and four letters that they share; an occurrence weighs DECAY ** (letters
skipped), spans of more than SPAN letters don't count, and the kernel is normalised. So a word with letters inserted, changed or appended still resembles
the word it was made from. Before, case, accents, look-alike digits and signs between letters are folded away ("i-d.1ot" is "idiot"),
and runs of single letters with spaces between them are read as one word as well.

A sentence is as toxic as its highest word. Training: of the labelled documents up to MOST_TOXIC + MOST_CLEAN are drawn by a hash of
the document id (documented bounds). Labels are of documents, so their sentences are learnt as in multiple-instance learning: positive
ones are sentences of toxic documents that hold a word which sets these apart (at most MOST_SUSPECTS words, counted by different
sentences, so copies don't count; at most PER_TOXIC sentences of a document), and each is learnt through its witness, the word that the
machine of the round before values highest; negative ones are the words of clean documents' sentences, those that the machine takes for
toxic above all (HARD of them a round; COMMON frequent and other ones to begin with). Landmarks are witnesses, hard and other clean
words; in the space that they span (K^-1/2 k(x)) a linear machine with squared hinge loss is solved by Newton's method. A logistic
curve, fitted on the drawn documents, makes a text's score of its highest sentence and of the number and share of sentences over zero.

Because the kernel is a dot product of subsequence counts, a word's value is one sum over its subsequences, looked up in a
table that merges landmarks and coefficients. Words are scored once while a worker remembers them.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import kept, small_batches, stored

MOST_TOXIC, MOST_CLEAN = 3000, 6000
LANDMARKS = 480
#: Suspect words, by how often toxic sentences have them times the logarithm of how much more often; common and other clean words to begin with.
MOST_SUSPECTS, LEAST_EVIDENCE, COMMON = 1500, 10.0, 1000
#: Trainings, and how many hard clean words each but the last adds; sentences of a toxic document; words of a sentence that has no end.
ROUNDS, HARD, PER_TOXIC, SENTENCE = 4, 2000, 8, 16
#: What a clean sentence with a witness word weighs against it.
AGAINST = 0.3
DECAY, SPAN = 0.6, 6
#: Weight of a four-letter subsequence against a three-letter one.
FOUR = 1.5
CODES = 32**3 + 32**4
#: Letters of a word that are compared at once; longer words are read in windows of so many letters, half overlapping.
WINDOW = 24
#: Words whose value a worker remembers.
REMEMBERED = 200_000

#: Digits and signs that stand for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_single = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_letters: dict[str, str] = {}


def fold(word: str) -> str:
    """Letters a-z and, for other scripts, one of 5 further symbols (from `{` on); all else is dropped."""
    out = []
    for c in word:
        got = _letters.get(c)
        if got is None:
            base = unicodedata.normalize("NFKD", c.lower())
            got = "".join(x if "a" <= x <= "z" else LOOKALIKE[x] if x in LOOKALIKE else chr(123 + ord(x) % 5) if x.isalpha() else "" for x in base if not unicodedata.combining(x))
            if len(_letters) < 100_000:
                _letters[c] = got
        out.append(got)
    return "".join(out)


def tokens(text: str) -> list[str]:
    """Words in order; runs of single letters with spaces between them come once more, at the end, each as one word."""
    found = text.split()
    found += ["".join(m.group().split()) for m in _single.finditer(text)]
    return found


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


@cache
def subsequences(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions in a word of n letters of all its subsequences of three and of four letters (of two tables), and their weights."""
    three = [(i, j, k) for i in range(n - 2) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
    four = [(i, j, k, m) for i in range(n - 3) for m in range(i + 3, min(n, i + SPAN)) for j in range(i + 1, m - 1) for k in range(j + 1, m)]
    t, f = np.array(three, np.int64).reshape(-1, 3), np.array(four, np.int64).reshape(-1, 4)
    return t, f, DECAY ** (t[:, -1] - t[:, 0] - 2.0), FOUR * DECAY ** (f[:, -1] - f[:, 0] - 3.0)


def features(words: list[str]):
    """For words of equal length: (subsequence codes sorted in each row, weights, whether a code is the first of its kind in the row)."""
    n = len(words[0])
    c = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), n).astype(np.int64) - 96
    t, f, wt, wf = subsequences(n)
    three = (c[:, t[:, 0]] * 32 + c[:, t[:, 1]]) * 32 + c[:, t[:, 2]]
    four = 32**3 + ((c[:, f[:, 0]] * 32 + c[:, f[:, 1]]) * 32 + c[:, f[:, 2]]) * 32 + c[:, f[:, 3]]
    weight = np.concatenate([wt, wf])
    key = np.concatenate([three, four], axis=1) * 4096 + np.arange(len(weight))
    key.sort(axis=1)
    code = key >> 12
    first = np.ones(code.shape, bool)
    first[:, 1:] = code[:, 1:] != code[:, :-1]
    return code, weight[key & 4095], first


def norms(weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Square roots of the words' kernels with themselves."""
    starts = np.flatnonzero(first.ravel())
    total = np.add.reduceat(weight.ravel(), starts) ** 2
    row = np.searchsorted(starts, np.arange(len(weight)) * weight.shape[1])
    return np.sqrt(np.add.reduceat(total, row))


def by_length(words: list[str]):
    """Index arrays of words of equal length, 3 letters at least, some thousands at a time."""
    n = np.array([len(w) for w in words])
    for size in np.unique(n[n >= 3]):
        rows = np.flatnonzero(n == size)
        step = max(1, 400_000 // sum(map(len, subsequences(int(size))[2:])))
        yield from (rows[i : i + step] for i in range(0, len(rows), step))


@dataclass(frozen=True)
class Model:
    codes: np.ndarray
    values: np.ndarray
    bias: float
    curve: tuple[float, ...]  # of SIGNS and 1

    def table(self) -> np.ndarray:
        out = np.zeros(CODES)
        out[self.codes] = self.values
        return out

    def probability(self, signs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(signs @ np.array(self.curve[:-1]) + self.curve[-1], -30, 30)))


def sentence_starts(ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where sentences begin: with a text (first), after a word that ends one, and after SENTENCE words without such an end."""
    new = np.zeros(len(ends) + 1, bool)
    new[1:] = ends
    new = new[:-1]
    new[first[first < len(new)]] = True
    at = np.flatnonzero(new)
    place = np.arange(len(ends)) - np.repeat(at, np.diff(np.append(at, len(ends))))
    return np.flatnonzero(place % SENTENCE == 0)


def ends_sentence(word: str) -> bool:
    return word[-1] in ".!?"


class Scorer:
    def __init__(self, model: Model):
        self.model, self.table = model, model.table()
        self.known: dict[str, int] = {}
        self.value, self.ends = np.zeros(REMEMBERED), np.zeros(REMEMBERED, bool)

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of folded words of at most WINDOW letters; without a subsequence it is the bias."""
        out = np.full(len(words), self.model.bias)
        for rows in by_length(words):
            code, weight, first = features([words[i] for i in rows])
            out[rows] += (self.table[code] * weight).sum(axis=1) / norms(weight, first)
        return out

    def learn(self, wanted: set[str]) -> None:
        new = wanted - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = wanted
        if len(new) > len(self.value):  # more words than are remembered stand in these texts alone
            self.value, self.ends = np.zeros(len(new)), np.zeros(len(new), bool)
        new = list(new)
        cut = [windows(fold(w)) for w in new]
        flat = list({x for c in cut for x in c})
        value = dict(zip(flat, self.values(flat).tolist(), strict=True))
        n = len(self.known)
        self.value[n : n + len(new)] = [max(value[x] for x in c) for c in cut]
        self.ends[n : n + len(new)] = [ends_sentence(w) for w in new]
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The value of all sentences of all texts (that of their highest word), and each text's number of them."""
        cut = [tokens(x) for x in texts]
        self.learn(set().union(*cut))
        known = self.known
        size = np.array([len(x) for x in cut], np.int64)
        at = np.fromiter((known[w] for x in cut for w in x), np.int64, int(size.sum()))
        first = np.cumsum(size) - size
        if not len(at):
            return np.empty(0), size
        starts = sentence_starts(self.ends[at], first[size > 0])
        value = np.maximum.reduceat(self.value[at], starts)
        return value, np.diff(np.searchsorted(starts, np.append(first, len(at))))

    def texts(self, texts: list[str]) -> np.ndarray:
        """SIGNS numbers for each text."""
        value, n = self.sentences(texts)
        return signs(value, n, self.model.bias)


#: What a text's score is made from: its highest sentence, and how much (by value, up to 1 a sentence) and how many sentences are over
#: zero, each as such and as a share of all.
SIGNS = 5


def signs(value: np.ndarray, n: np.ndarray, bias: float) -> np.ndarray:
    top, much, many = np.full(len(n), bias), np.zeros(len(n)), np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        first = (np.cumsum(n) - n)[some]
        top[some] = np.maximum.reduceat(value, first)
        much[some] = np.add.reduceat(np.clip(value, 0, 1), first)
        many[some] = np.add.reduceat((value > 0).astype(float), first)
    share = lambda x: np.log((x + 0.1) / (n + 1))
    return np.column_stack([np.clip(top, -1, 1), np.log1p(much), share(much), np.log1p(many), share(many)])


def scorer_of(model: Model) -> Scorer:
    return kept(("toxicity", zlib.crc32(model.values.tobytes()), model.bias), lambda: Scorer(model))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def draw(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded training sample, stored: doc_id, text, toxic. Held-out ids and null labels are not drawn."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    drawn = [known.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most) for kind, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    ids = [tuple(r) for d in drawn for r in d.select("doc_id", "toxic").collect()]  # at most MOST_TOXIC + MOST_CLEAN
    chosen = spark.createDataFrame(ids, "doc_id long, toxic long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # one text of a repeated id
    return stored(one.repartition(2 * spark.sparkContext.defaultParallelism), "toxicity-sample")


def folded_sentences(text: str) -> list[list[str]]:
    """Sentences as lists of folded words of three letters or more; those without any are left out."""
    words = tokens(text)
    if not words:
        return []
    starts = sentence_starts(np.array([ends_sentence(w) for w in words]), np.zeros(1, np.int64)).tolist()
    cut = [[x for w in words[i:j] for x in windows(fold(w)) if len(x) >= 3] for i, j in zip(starts, [*starts[1:], len(words)], strict=True)]
    return [x for x in cut if x]


def word_counts(sample: DataFrame) -> DataFrame:
    """Folded words with the numbers of different sentences of toxic and of clean documents that hold them (copies count once); the
    empty word counts all sentences."""

    def run(batches):
        for batch in batches:
            words, toxic, sentence = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x in folded_sentences(text or ""):
                    own = {"", *x}
                    words += own
                    toxic += [y] * len(own)
                    sentence += [zlib.crc32(" ".join(x).encode())] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int64()), pa.array(sentence, pa.int64())], ["word", "toxic", "sentence"])

    words = sample.select("text", F.col("toxic").cast("long")).mapInArrow(run, "word string, toxic long, sentence long").distinct()
    return words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Without labelled documents of both kinds the model gives every text the share of toxic ones (0 if there are none at all)."""
    sample = draw(small_batches(docs), labels)
    kinds = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = kinds.get(1, 0), kinds.get(0, 0)
    if not n_toxic or not n_clean:
        return constant(1.0 if n_toxic else 0.0)
    counts = stored(word_counts(sample), "toxicity-words")
    total = counts.where("word = ''").first()
    counts = counts.where("word != ''")
    if total is None:
        return constant(n_toxic / (n_toxic + n_clean))
    odds = F.log((F.col("t") + 0.5) / (total.t + 1)) - F.log((F.col("c") + 0.5) / (total.c + 1))
    bad = counts.where((F.col("t") >= 2) & (odds >= 2.0) & (F.col("t") * odds >= LEAST_EVIDENCE)).withColumn("rank", F.col("t") * odds).orderBy(F.desc("rank"), "word").limit(MOST_SUSPECTS).collect()
    clean = counts.where("c > 0").where(odds < 1)
    common = clean.orderBy(F.col("c").desc(), "word").limit(COMMON).collect()
    rare = clean.orderBy(F.xxhash64("word"), "word").limit(COMMON).collect()
    if not bad or not common:
        return constant(n_toxic / (n_toxic + n_clean))
    suspects = {r.word: r.rank for r in bad}
    seen = {r.word: r.c for r in bad if r.c}  # suspects that clean sentences have as well
    sentences = positive_sentences(sample, set(suspects))
    good = {r.word: r.c for r in [*common, *rare]}
    hard: list[str] = []
    model = None
    for left in reversed(range(ROUNDS)):
        witnesses = Counter(witness(sentences, suspects, model, good))
        if not witnesses:
            break
        model = fit(witnesses, good, seen, hard)
        if left:  # the clean words that it takes for toxic join the training words
            found = valued(clean, model).where(F.col("value") > -0.9).orderBy(F.col("value").desc(), "word").limit(HARD).collect()
            hard = [r.word for r in found]
            good |= {r.word: r.c for r in found}
    if model is None:
        return constant(n_toxic / (n_toxic + n_clean))

    def run(batches):
        scorer = scorer_of(model)
        for batch in batches:
            z = scorer.texts([x or "" for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(z[:, i]) for i in range(SIGNS)] + [batch.column(1).cast(pa.int64())], [*(f"z{i}" for i in range(SIGNS)), "toxic"])

    fitted = sample.select("text", "toxic").mapInArrow(run, ", ".join(f"z{i} double" for i in range(SIGNS)) + ", toxic long").toArrow()  # as many as were drawn
    z = np.column_stack([fitted.column(i).to_numpy() for i in range(SIGNS)])
    return Model(model.codes, model.values, model.bias, tuple(logistic(z, fitted.column(SIGNS).to_numpy().astype(float))))


def constant(share: float) -> Model:
    none = np.empty(0, np.int64)
    return Model(none, none.astype(float), 0.0, (0.0,) * SIGNS + (float(np.clip(np.log((share + 1e-12) / (1 - share + 1e-12)), -30, 30)),))


def positive_sentences(sample: DataFrame, suspects: set[str]) -> list[list[str]]:
    """Different sentences of toxic documents that hold a suspect word, at most PER_TOXIC of a document (by hash)."""

    def run(batches):
        for batch in batches:
            words = []
            for text in batch.column(0).to_pylist():
                own = [x for x in folded_sentences(text or "") if any(w in suspects for w in x)]
                words += sorted(own, key=lambda x: zlib.crc32(" ".join(x).encode()))[:PER_TOXIC]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string()))], ["words"])

    found = sample.where("toxic = 1").select("text").mapInArrow(run, "words array<string>").distinct().orderBy(F.xxhash64("words"), "words")
    return found.toArrow().column("words").to_pylist()  # at most MOST_TOXIC times PER_TOXIC


def witness(sentences: list[list[str]], suspects: dict[str, float], model: Model | None, good: dict[str, int]) -> list[str]:
    """Of each sentence the word that makes it toxic: the most suspect one at first, then the one that the machine values highest, if
    that is over zero and no clean word."""
    if model is None:
        return [max((w for w in x if w in suspects), key=lambda w: (suspects[w], w)) for x in sentences]
    words = sorted({w for x in sentences for w in x})
    value = dict(zip(words, Scorer(model).values(words).tolist(), strict=True))
    top = [max(x, key=lambda w: (value[w], w)) for x in sentences]
    return [w for w in top if value[w] > 0 and w not in good]


def valued(counts: DataFrame, model: Model) -> DataFrame:
    """word, c, value of distinct folded words."""

    def run(batches):
        scorer = scorer_of(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scorer.values(batch.column(0).to_pylist()), pa.float64())], ["word", "c", "value"])

    return counts.select("word", "c").mapInArrow(run, "word string, c long, value double")


def fit(witnesses: dict[str, int], good: dict[str, int], seen: dict[str, int], hard: list[str]) -> Model:
    """The machine for witness words and clean words with the numbers of their sentences; a witness that clean sentences have too counts
    against itself. Landmarks are witnesses, hard and other clean words by thirds."""
    bad = sorted(witnesses, key=lambda w: (-witnesses[w], w))
    clean = [w for w in good if w not in witnesses]
    marks = choose(bad, LANDMARKS // 3)
    marks += choose([w for w in hard if w not in set(marks)], LANDMARKS // 3)
    marks += choose([w for w in clean if w not in set(marks)], LANDMARKS - len(marks))
    both = [w for w in bad if w in seen]
    y = np.array([1.0] * len(bad) + [-1.0] * (len(clean) + len(both)))
    plus, minus = np.sqrt([witnesses[w] for w in bad]), np.sqrt([good[w] for w in clean] or [1.0])
    plus, minus = plus / plus.sum(), minus / minus.sum()
    own = dict(zip(bad, plus.tolist(), strict=True))
    weight = np.concatenate([plus, minus[: len(clean)], [own[w] * AGAINST * seen[w] / witnesses[w] for w in both]]) * len(y) / 2
    return Model(*Span(marks).solve([*bad, *clean, *both], y, weight), (0.0,) * (SIGNS + 1))


class Span:
    """The space that landmark words span: K^-1/2 k(x)."""

    def __init__(self, marks: list[str]):
        place = np.full(CODES, -1, np.int32)
        rows = []
        for w in marks:
            code, wt, first = features([w])
            total = np.add.reduceat(wt[0], np.flatnonzero(first[0]))
            rows.append((code[0][first[0]], total / np.sqrt((total**2).sum())))
        self.codes = np.unique(np.concatenate([c for c, _ in rows]))
        place[self.codes] = np.arange(len(self.codes))
        self.place = place
        self.span = np.zeros((len(self.codes) + 1, len(marks)), np.float32)  # the last row is for codes that no landmark has
        for j, (c, v) in enumerate(rows):
            self.span[place[c], j] = v
        value, vector = np.linalg.eigh(self.span.T.astype(float) @ self.span)
        keep = value > 1e-6 * value.max()
        self.half = vector[:, keep] / np.sqrt(value[keep])

    def near(self, words: list[str]) -> np.ndarray:
        """The kernel of words with the landmarks."""
        out = np.zeros((len(words), self.span.shape[1]), np.float32)
        for at in by_length(words):
            code, wt, first = features([words[i] for i in at])
            wt = (wt / norms(wt, first)[:, None]).astype(np.float32)
            for t in range(code.shape[1]):
                out[at] += wt[:, t, None] * self.span[self.place[code[:, t]]]
        return out

    def solve(self, words: list[str], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """A linear machine with squared hinge loss: codes and values of the merged table, and the bias."""
        x = np.column_stack([self.near(words) @ self.half, np.ones(len(y))])
        ridge = np.ones(x.shape[1])
        ridge[-1] = 1e-3
        w = np.zeros(x.shape[1])
        for _ in range(30):
            active = y * (x @ w) < 1
            xa, ca = x[active], 2.0 * weight[active]
            new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(ridge), xa.T @ (ca * y[active]))
            done = np.allclose(new, w, atol=1e-6)
            w = new
            if done:
                break
        return self.codes, self.span[:-1].astype(float) @ (self.half @ w[:-1]), float(w[-1])


def choose(words: list[str], most: int) -> list[str]:
    """Landmarks: words in the given order, those with few letters in common with earlier ones first."""
    words = [w for w in words if len(w) >= 3]
    taken, later, seen = [], [], set()
    for w in words:
        own = {w[i : i + 3] for i in range(len(w) - 2)}
        (later if len(own & seen) > len(own) / 2 else taken).append(w)
        seen |= own
        if len(taken) == most:
            break
    return (taken + later)[:most]


def logistic(z: np.ndarray, y: np.ndarray) -> list[float]:
    """A logistic curve of some numbers and 1, with slightly softened targets and a small ridge."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(z.shape[1]), z.T @ (target - p) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, predicted. Null texts are empty; repeated rows stay; other columns aren't looked at. No shuffle."""

    def run(batches):
        scorer = scorer_of(model)
        for batch in batches:
            for part in few(batch):
                p = model.probability(scorer.texts([x or "" for x in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def few(batch: pa.RecordBatch, rows: int = 250):
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def keep(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below the threshold."""
    at = small_batches(docs).columns.index(text_col)

    def run(batches):
        scorer = scorer_of(model)
        for batch in batches:
            for part in few(batch):
                p = model.probability(scorer.texts([x or "" for x in part.column(at).to_pylist()]))
                yield part.filter(pa.array(p < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
