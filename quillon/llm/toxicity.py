"""Toxicity by weak supervision: voters, label model, linear classifier."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Labelled rows that everything is learned from: the ones with the smallest
#: hashes of their ids. This bounds what reaches the driver.
FIT_ROWS = 8000
#: Stems and words that are mined from them, each a voter.
MINED = 400
#: Least strength (nats of the likelihood ratio) of a mined term: many candidates reach less by chance.
LEAST_STRENGTH = 12.0
#: Lexicons that they are dealt to, by falling strength, words from which silence means clean, least
#: mutual information (nats) of two voters that depend on each other.
MINED_VOTERS, ENOUGH, LEAST_INFORMATION = 80, 30, 1e-4
#: A posterior of this or more is predicted toxic.
THRESHOLD = 0.3

# Common insults and profanities, by language.
LEXICON = {
    "insult_en": "idiot moron imbecile stupid dumb dumbass loser scum trash garbage pathetic worthless disgusting clown pig freak creep jerk fool retard filth vermin parasite coward bastard",
    "profanity_en": "fuck fucking fucker shit shitty bullshit bitch asshole cunt dick prick piss wanker slut whore damn crap",
    "threat_en": "kill die hang shoot stab burn rape murder destroy",
    "insult_fr": "idiot imbécile crétin débile connard connasse salaud salope ordure racaille abruti minable merde putain enculé",
    "insult_de": "idiot dummkopf trottel arschloch scheiße scheisse hurensohn wichser schlampe abschaum depp vollidiot dreck fotze",
    "insult_es": "idiota imbécil estúpido gilipollas cabrón puta mierda basura escoria pendejo maricón coño zorra payaso inútil",
}
# Patterns of abuse.
PATTERNS = {
    "you_are": r"\byou(?:'re| are)(?: such)? an? (?:\w+ )?(?:idiot|moron|loser|clown|fool|pig|freak|creep|jerk)\b",
    "shut_up": r"\bshut (?:the \w+ )?up\b|\bgo to hell\b|\bdrop dead\b",
    "self_harm": r"\bkill (?:yourself|urself)\b|\bkys\b",
    "hate": r"\bi (?:really )?hate (?:you|them|all)\b|\bgo back to\b",
    "masked": r"\b(?:f[*@#]+k\w*|sh[*@!1]+t\w*|b[*@!1]+tch\w*|a[$*@]+hole)\b",
}
_ANY_PATTERN = re.compile("|".join(PATTERNS.values()))
_PATTERN_LIST = [re.compile(p) for p in PATTERNS.values()]
_LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the stems: a stem is followed by at least one more letter.
STEMS = range(4, 10)
#: Words whose features a worker keeps.
CACHE = 400_000


def features_of(word: str) -> list[str]:
    """The whole word and its stems."""
    return ["=" + word, *("^" + word[:n] for n in STEMS if n < len(word))]


def _counted(text: str) -> Counter:
    return Counter(w for token, k in Counter(text.lower().split()).items() for w in _LETTERS.findall(token) * k)


def _document_features(batch: pa.RecordBatch):
    """(feature with its least count, label, documents) of labelled texts."""
    total: dict[tuple[str, int], int] = Counter()
    for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
        found: Counter = Counter()
        for word, k in _counted(text or "").items():
            for f in features_of(word):
                found[f] += k
        for f, k in found.items():
            total[f + "#1", label] += 1
            if k >= 2:
                total[f + "#2", label] += 1
            if k >= 3:
                total[f + "#3", label] += 1
    yield [k[0] for k in total], [int(k[1]) for k in total], list(total.values())


class Scorer:
    """Turns a text into voter counts; holds the mined and the given lexicons."""

    def __init__(self, mined: list[str]):
        self.mined = list(mined)
        self.groups = list(LEXICON)
        self.index: dict[str, tuple] = {}
        for i, f in enumerate(self.mined):
            self.index[f] = (*self.index.get(f, ()), i)
        for g, words in enumerate(LEXICON.values()):
            for w in words.split():
                self.index["=" + w] = (*self.index.get("=" + w, ()), len(self.mined) + g)
        self.size = len(self.mined) + len(self.groups) + len(PATTERNS)
        self.cache: dict[str, tuple] = {}

    def of_token(self, token: str) -> tuple:
        out = tuple(i for w in _LETTERS.findall(token) for f in features_of(w) for i in self.index.get(f, ()))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[token] = out
        return out

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """Occurrences of each voter's terms, and the number of tokens."""
        if not text:
            return {}, 0
        low = text.lower()
        tokens = low.split()
        get, of, out = self.cache.get, self.of_token, {}
        for token in tokens:
            found = get(token)
            if found is None:
                found = of(token)
            if found:
                for i in found:
                    out[i] = out.get(i, 0) + 1
        if _ANY_PATTERN.search(low):
            base = len(self.mined) + len(self.groups)
            for j, p in enumerate(_PATTERN_LIST):
                if n := len(p.findall(low)):
                    out[base + j] = n
        return out, len(tokens)

    def vector(self, counted: tuple[dict[int, int], int]) -> tuple[list[int], list[float]]:
        """Sparse features: presence, twice, four times, and density of each term, then totals."""
        counts, n = counted
        at, value = [], []
        for i, c in counts.items():
            at.append(4 * i), value.append(1.0)
            if c >= 2:
                at.append(4 * i + 1), value.append(1.0)
            if c >= 4:
                at.append(4 * i + 2), value.append(1.0)
            at.append(4 * i + 3), value.append(min(1.0, 20.0 * c / max(n, 20)))
        base = 4 * self.size
        hits = sum(counts.values())
        at += [base, base + 1, base + 2]
        value += [min(2.0, len(counts) / 10), min(2.0, 20.0 * hits / max(n, 20)), min(2.0, float(np.log1p(n)) / 5)]
        return at, value


def voters_of(counts: dict[int, int], tokens: int, mined: int, given: int) -> np.ndarray:
    """The votes of all voters on a text: 1 toxic, 0 clean, -1 abstains.

    Voters are the given lexicons and patterns, the mined terms dealt to
    :data:`MINED_VOTERS` lexicons, and three that weigh all hits. A lexicon votes
    toxic where one of its terms occurs and clean where a text of
    :data:`ENOUGH` words or more has none; on a shorter text without hits it
    abstains, as silence says little there."""
    out = np.full(MINED_VOTERS + given + 3, 0 if tokens >= ENOUGH else -1, np.int8)
    strong = weak = 0
    for i, c in counts.items():
        out[i * MINED_VOTERS // mined if i < mined else MINED_VOTERS + i - mined] = 1
        strong, weak = strong + c * (i < mined), weak + c
    distinct = len(counts)
    out[-3] = 1 if distinct >= 2 else 0 if distinct == 0 else -1
    out[-2] = 1 if strong >= 3 else 0 if strong == 0 else -1
    out[-1] = 1 if 50 * weak >= tokens and weak else 0 if weak == 0 else -1
    return out


class LabelModel:
    """A hidden class, voters that may abstain, and a forest of dependences between them.

    P(votes | class) is a product over voters of P(vote | class, vote of the
    parent); which voters speak does not depend on the class, so an abstention is
    no evidence. Each voter has one parent at most: the forest is the maximum
    spanning one over the mutual information of two voters' votes given the class.
    Parameters and forest are estimated by expectation and maximisation. The
    expectation may use a noisy label of each text as a further voter; posteriors
    for training never do."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, rounds: int = 30):
        n, m = votes.shape
        said = [(votes == x).astype(np.float64) for x in (-1, 0, 1)]
        lean = (said[2].sum(axis=1) - 0.5 * said[1].sum(axis=1) > 0).astype(float)
        q = 0.5 * lean + 0.5 * np.where(labels >= 0, labels, lean)
        self.parent = np.full(m, -1)
        for step in range(rounds):
            q = np.clip(q, 1e-4, 1 - 1e-4)
            self.prior = float(np.clip(q.mean(), 0.005, 0.6))
            w = (1 - q, q)
            # joint[y][a, b][i, j]: weight of texts on which i says a and j says b
            if step in (0, 5, 10):
                self.parent = self._forest(said, w)
            self.rate = np.zeros((m, 2, 3))  # P(toxic | spoke, class, what the parent says: abstains, clean, toxic)
            for j in range(m):
                for y in (0, 1):
                    base = (said[2][:, j] @ w[y] + (0.6 if y else 0.1)) / ((said[1][:, j] + said[2][:, j]) @ w[y] + 1.0)
                    for a in range(3):
                        given = said[a][:, self.parent[j]] * w[y] if self.parent[j] >= 0 else w[y]
                        self.rate[j, y, a] = (said[2][:, j] @ given + 5 * base) / ((said[1][:, j] + said[2][:, j]) @ given + 5)
            self.rate = np.clip(self.rate, 1e-3, 1 - 1e-3)
            self.label = [np.clip(((labels == 1) @ w[y] + 1.0) / ((labels >= 0) @ w[y] + 2.0), 0.02, 0.98) for y in (0, 1)]
            odds = self.odds(votes)
            odds += np.where(labels == 1, np.log(self.label[1] / self.label[0]), np.where(labels == 0, np.log((1 - self.label[1]) / (1 - self.label[0])), 0.0))
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            moved = np.abs(new - q).max()
            q = new
            if moved < 1e-3 and step > 10:
                break

    @staticmethod
    def _forest(said: list, w: tuple) -> np.ndarray:
        m = said[0].shape[1]
        info = np.zeros((m, m))
        total = sum(x.sum() for x in w)
        for y in (0, 1):
            both = np.zeros((2, 2, m, m))
            for a in (0, 1):
                for b in (0, 1):
                    both[a, b] = (said[a + 1] * w[y][:, None]).T @ said[b + 1] + 0.05
            all_ = both.sum(axis=(0, 1))
            left, right = both.sum(axis=1), both.sum(axis=0)
            for a in (0, 1):
                for b in (0, 1):
                    info += both[a, b] / total * np.log(both[a, b] * all_ / (left[a] * right[b]))
        np.fill_diagonal(info, 0.0)
        parent = np.full(m, -1)
        inside, near, by = np.zeros(m, bool), np.full(m, -1.0), np.full(m, -1)
        for _ in range(m):
            j = int(np.argmax(np.where(inside, -np.inf, near)))
            inside[j] = True
            if near[j] > LEAST_INFORMATION:
                parent[j] = by[j]
            closer = ~inside & (info[j] > near)
            near[closer], by[closer] = info[j][closer], j
        return parent

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic given the votes alone."""
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(votes.shape[1]):
            a = votes[:, self.parent[j]] + 1 if self.parent[j] >= 0 else np.zeros(len(votes), int)
            p, q = self.rate[j, 1][a], self.rate[j, 0][a]
            out += np.where(votes[:, j] == 1, np.log(p / q), np.where(votes[:, j] == 0, np.log((1 - p) / (1 - q)), 0.0))
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(votes), -30, 30)))


def logistic(at: list, value: list, target: np.ndarray, size: int, l2: float = 2e-3, rounds: int = 300) -> np.ndarray:
    """Weights and bias of a linear classifier on soft targets, by Adam on full batches."""
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    col = np.fromiter((i for a in at for i in a), np.int64, len(row))
    val = np.fromiter((v for x in value for v in x), np.float64, len(row))
    w, m, s = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3)) if len(target) else -2.0
    for t in range(1, rounds + 1 if len(target) else 1):
        z = np.bincount(row, w[col] * val, minlength=len(at)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        g = np.append(np.bincount(col, d[row] * val, minlength=size) + l2 * w[:-1] / 10, d.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def held_out_of(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, mined: int = MINED) -> tuple[Scorer, np.ndarray]:
    """Scorer and classifier weights from ``docs(id, text)`` and ``labels(id, label)``.

    At most ``fit_rows`` labelled rows are used, equal texts once, toxic if any
    of them is marked so. Candidate stems and words are counted on the executors
    by grouped aggregation; at most ``mined`` of them, with the strongest
    association with the label, become terms. The classifier learns from the
    posteriors of :class:`LabelModel`, in which the labels only help to estimate
    how far each voter can be trusted.
    """
    chosen = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    sample = docs.join(F.broadcast(chosen), "id").select("text", "label").where("text is not null").groupBy("text").agg(F.max("label").alias("label"))
    sizes = {int(r[0]): r[1] for r in sample.groupBy("label").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    terms: list[str] = []
    if pos and neg:
        counted = arrow_map(sample, _document_features, "f string, label int, n long").groupBy("f").agg(
            F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q")
        )
        rate_p, rate_q = (F.col("p") + 0.5) / (pos + 1.0), (F.col("q") + 0.5) / (neg + 1.0)
        n, share = F.col("p") + F.col("q"), pos / (pos + neg)
        part = lambda k, s: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * s))).otherwise(0.0)
        best = counted.where(rate_p > 5 * rate_q).withColumn("g", part("p", share) + part("q", 1 - share)).where(F.col("g") >= LEAST_STRENGTH).orderBy(F.desc("g"), "f").limit(mined)
        seen = {}
        for r in best.collect():
            seen.setdefault(r["f"].rpartition("#")[0], None)
        terms = list(seen)
    scorer = Scorer(terms)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    given = len(scorer.groups) + len(PATTERNS)

    def vectors(batch: pa.RecordBatch):
        s, out, votes = shared.value, [], []
        for t in batch.column("text").to_pylist():
            counts = s.counts(t)
            out.append(s.vector(counts)), votes.append(voters_of(*counts, len(s.mined), given).astype(np.int32))
        yield [b[0] for b in out], [b[1] for b in out], votes, batch.column("label").cast(pa.int32())

    got = arrow_map(sample, vectors, "at array<int>, value array<double>, votes array<int>, label int").toPandas()
    if not len(got):
        return scorer, logistic([], [], np.empty(0), 4 * scorer.size + 3)
    got = got.iloc[sorted(range(len(got)), key=lambda i: (len(got["at"][i]), list(got["at"][i]), list(got["value"][i])))]  # the same sums in every run
    votes = np.stack(got["votes"].to_list())
    posterior = LabelModel(votes, got["label"].to_numpy()).posterior(votes)
    return scorer, logistic([list(a) for a in got["at"]], [list(v) for v in got["value"]], posterior, 4 * scorer.size + 3)


def score(docs: DataFrame, scorer: Scorer, weights: np.ndarray) -> DataFrame:
    """``id, score`` of every row of ``docs(id, text)``, null and empty texts too."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer, weights))

    def run(batch: pa.RecordBatch):
        s, w = shared.value
        out = []
        for text in batch.column("text").to_pylist():
            at, value = s.vector(s.counts(text))
            z = sum(w[i] * v for i, v in zip(at, value, strict=True)) + w[-1]
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        yield batch.column("id"), out

    return arrow_map(docs, run, "id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Labels of rows with ``crc32(doc_id) % 4 == 2`` are never read for learning,
    and no other column than the text enters a score. What is learned comes from
    at most ``fit_rows`` labelled rows (:data:`FIT_ROWS`), the ones with the
    smallest hashes of their ids, and from at most ``mined`` terms
    (:data:`MINED`); both bound the classifier, not what is scored.

    Edge cases: null and empty texts get the score of a text without any hit.
    Null ids are scored, not held out and not learned from. Repeated rows are
    scored each; equal texts score alike. Without labels of both classes nothing
    is mined. Very long texts are scored whole. An empty table gives no rows.
    Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(~held_out_of(F.col("id")))
    scorer, weights = train(rows, marks, **options)
    return score(rows, scorer, weights).select(
        F.col("id").alias("doc_id"), held_out_of(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
