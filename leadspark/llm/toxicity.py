"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Lexicons come from a bounded sample of labelled rows: for each family of terms (whole words, their first 3 to 7 letters,
their last 4 or 5, letter runs of 5) those that toxic texts hold far more often than others. Voters say "toxic" where a
text's words hit a lexicon, hit it densely, or show a pattern; one is a fixed list of insults. They overlap and err.

The label model takes the true class as hidden. Given the class, a voter depends on one other voter at most: the tree of
dependences that carries most conditional mutual information, so voters that repeat each other count once. Accuracies,
correlations and the class's share are fitted by expectation-maximisation over the votes of all documents, for which
counts per combination of votes are enough: 16 voters make at most 65 536 combinations. Labels are a voter with an error
of their own. Posteriors are the targets of a logistic regression on the texts' counts; its weights give the score.

Texts are read twice: the sample for the lexicons, and all of them for a row of some thirty numbers each.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import discard, materialize, slices

WORDS = re.compile(r"[^\W\d_]+")
FAMILIES = ("word", "first3", "first4", "first5", "first6", "first7", "last4", "last5", "run5")
#: Fixed: insults of general English, our own list.
INSULTS = frozenset("idiot idiots idiotic moron morons stupid scum trash loser losers clown pathetic worthless disgusting dumb filthy vermin imbecile coward liar crap bastard freak jerk hate kill".split())
LABELLED, VOTERS = 20_000, 16


def terms(word: str) -> list[str]:
    """The terms of a lower-case word, each with the number of its family in front."""
    out = ["0" + word]
    out += [f"{k - 2}{word[:k]}" for k in range(3, 8) if len(word) >= k]
    out += [f"{k + 2}{word[-k:]}" for k in (4, 5) if len(word) >= k]
    out += {"8" + word[i:i + 5] for i in range(len(word) - 4)}
    return out


def _term_counts(batches):
    """In how many toxic and other texts of a task each term is."""
    import pyarrow as pa

    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for part in slices([batch]):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                own = {t for w in set(WORDS.findall(text.lower())) for t in terms(w)} if text else ()
                counts[toxic].update(own)
                if sum(map(len, counts.values())) > 1_000_000:
                    for y, c in counts.items():
                        yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(c.values(), pa.int64())], ["term", "toxic", "n"])
                    counts = {0: Counter(), 1: Counter()}
    for y, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(c.values(), pa.int64())], ["term", "toxic", "n"])


def lexicons(sample: DataFrame, min_texts: int = 5, min_z: float = 6.0, min_ratio: float = 4.0) -> list[str]:
    """Terms (with their family in front) that toxic texts of sample (text, toxic) hold far more often: in min_texts of them, min_ratio times the share of others, min_z standard errors apart."""
    sizes = sample.agg(F.count_if(F.col("toxic") == 1).alias("one"), F.count_if(F.col("toxic") == 0).alias("none")).first()
    if not sizes.one or not sizes.none:
        return []
    t = sample.mapInArrow(_term_counts, "term string, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    p, q, both = F.col("a") / sizes.one, F.col("b") / sizes.none, (F.col("a") + F.col("b")) / (sizes.one + sizes.none)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / sizes.one + 1 / sizes.none))
    return sorted(r.term for r in t.where((F.col("a") >= min_texts) & (p >= min_ratio * q) & (both < 1) & (z >= min_z)).select("term").collect())  # bounded by the sample


class Counts:
    """Votes and features of texts; what words hit is remembered for up to a million words."""

    def __init__(self, lexicon):
        self.lexicon, self.known = frozenset(lexicon), {}

    def hits(self, word: str) -> int:
        mask = self.known.get(word)
        if mask is None:
            if len(self.known) > 1_000_000:
                self.known = {}
            mask = 0
            for t in terms(word):
                if t in self.lexicon:
                    mask |= 1 << int(t[0])
            self.known[word] = mask
        return mask

    def of(self, text: str | None) -> tuple[int, list[float]]:
        """The votes as bits, and the features."""
        raw = WORDS.findall(text or "")
        words = Counter(w.lower() for w in raw)
        n = max(len(raw), 1)
        hits, union, kinds = [0] * len(FAMILIES), 0, 0
        for w, c in words.items():
            mask = self.hits(w)
            if mask:
                union += c
                kinds += 1
                for f in range(len(FAMILIES)):
                    if mask >> f & 1:
                        hits[f] += c
        insults = sum(words[w] for w in INSULTS if w in words)
        shout = sum(1 for w in raw if len(w) > 2 and w.isupper()) / n
        marks = (text or "").count("!") / n
        symbols = sum((text or "").count(c) for c in "#$%&*@|") / n
        again = 1 - len(words) / n if raw else 0.0
        dense = [h >= 2 and 200 * h >= n for h in hits]
        bits = [*dense, hits[0] >= 1, union >= 1, union >= 3, insults >= 1, shout > 0.3, marks > 0.2, symbols > 0.2]
        features = [f(h) for h in hits for f in (np.log1p, lambda x: min(100 * x / n, 5.0))]
        features += [np.log1p(union), np.log1p(kinds), min(100 * union / n, 5.0), min(100 * kinds / n, 5.0), np.log1p(insults), min(100 * insults / n, 5.0), shout, min(marks, 1.0), min(symbols, 1.0), again, np.log1p(len(raw)) / 5, float(union >= 2)]
        return sum(1 << i for i, b in enumerate(bits) if b), [float(x) for x in features]


def _features(lexicon):
    def run(batches):
        import pyarrow as pa

        counts = Counts(lexicon)
        for batch in batches:
            for part in slices([batch]):
                rows = [counts.of(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["doc_id", "votes", "features"])
    return run


class LabelModel:
    """P(class, votes, label) with a tree of voters, from counts of (votes as bits, label 0, 1 or -1 for none)."""

    def __init__(self, votes, labels, weights, rounds: int = 60):
        v = (np.asarray(votes)[:, None] >> np.arange(VOTERS) & 1).astype(float)
        labels, c = np.asarray(labels), np.asarray(weights, float)
        given = labels >= 0
        if given.any() and (~given).any():  # texts without a label say no more together than those with one
            c = np.where(given, c, c * min(1.0, c[given].sum() / c[~given].sum()))
        self.prior, self.right, self.wrong = 0.1, 0.95, 0.02
        q = np.where(labels == 1, 0.95, 0.02)
        self._fit(v[given], q[given], c[given], self._tree(v[given], q[given], c[given]))
        if given.any():
            self.prior = float(np.clip((q * c)[given].sum() / c[given].sum(), 1e-4, 0.9))
        for i in range(rounds):
            new = self.posterior(v, labels)
            moved = float(np.abs(new - q).max()) if i else 1.0
            q = new
            self._fit(v, q, c, self._tree(v, q, c) if i == 5 else self.tree)
            self.prior = float(np.clip((q * c).sum() / max(c.sum(), 1), 1e-4, 0.9))
            if given.any():
                one, none = (q * c)[given], ((1 - q) * c)[given]
                self.right = float(np.clip((one[labels[given] == 1].sum() + 4.5) / (one.sum() + 5), 0.8, 0.999))
                self.wrong = float(np.clip((none[labels[given] == 1].sum() + 0.1) / (none.sum() + 5), 0.001, 0.2))
            if moved < 1e-4:
                break

    @staticmethod
    def _tree(v, q, c) -> list[int]:
        """Each voter's parent, -1 for the root: the spanning tree of most mutual information given the class."""
        if not len(v):
            return [-1] * VOTERS
        info = np.zeros((VOTERS, VOTERS))
        for w in (q * c, (1 - q) * c):
            n = w.sum() + 4
            share = w.sum() / max(c.sum(), 1)
            one = (w @ v + 2) / n
            both = (v.T @ (v * w[:, None]) + 1) / n
            for a, pa, b, pb in ((1, one, 1, one), (1, one, 0, 1 - one), (0, 1 - one, 1, one), (0, 1 - one, 0, 1 - one)):
                joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                joint = np.maximum(joint, 1e-12)
                info += share * joint * np.log(joint / np.maximum(np.outer(pa, pb), 1e-12))
        parent, best = [-1] * VOTERS, {j: (info[0, j], 0) for j in range(1, VOTERS)}
        while best:
            j = max(best, key=lambda k: best[k])
            parent[j] = best.pop(j)[1]
            for k in best:
                best[k] = max(best[k], (info[j, k], j))
        return parent

    def _fit(self, v, q, c, tree) -> None:
        self.tree, self.p = tree, np.full((2, VOTERS, 2), 0.5)
        for y, w in enumerate(((1 - q) * c, q * c)):
            for j, up in enumerate(tree):
                for b in (0, 1):
                    at = w if up < 0 else w * (v[:, up] == b)
                    self.p[y, j, b] = ((at * v[:, j]).sum() + 0.2) / (at.sum() + 0.4)

    def posterior(self, v, labels):
        """P(class 1) of rows of votes and their labels."""
        odds = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for j, up in enumerate(self.tree):
            b = (v[:, up] if up >= 0 else np.zeros(len(v))).astype(int)
            one, none = self.p[1, j][b], self.p[0, j][b]
            odds += np.where(v[:, j] == 1, np.log(one / none), np.log((1 - one) / (1 - none)))
        odds += np.select([labels == 1, labels == 0], [np.log(self.right / self.wrong), np.log((1 - self.right) / (1 - self.wrong))], 0.0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with soft targets, by Newton steps; features are scaled inside and weights scaled back."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def held_out(doc_id) -> F.Column:
    """Whether labels of a doc_id are left for evaluation: crc32 of the id as text modulo 4 is 2; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fitted(table: DataFrame, given: DataFrame, chosen: DataFrame, labelled: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the score, from features and votes of all documents (doc_id, votes, features) and labels (doc_id, label)."""
    ids = table.groupBy("doc_id", "votes").agg(F.count("*").alias("n"))
    combined = ids.join(given, "doc_id", "left").groupBy("votes", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.sum("n").alias("n")).collect()  # at most 3 * 2^16 rows
    sample = table.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "votes", "features").limit(labelled).select("votes", "features", "label").collect()
    y = np.array([r.label for r in sample])
    if not len(y) or y.min() == y.max():
        return np.zeros(len(sample[0].features) if sample else 30), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -3.0
    model = LabelModel([r.votes for r in combined], [r.label for r in combined], [r.n for r in combined])
    votes = (np.array([r.votes for r in sample])[:, None] >> np.arange(VOTERS) & 1).astype(float)
    x = np.array([r.features for r in sample], float)
    w, b = logistic(x, model.posterior(votes, y))
    slope, shift = logistic((x @ w + b)[:, None], y.astype(float), 1e-3)  # so that scores are shares of labels
    return w * slope[0], b * slope[0] + shift


def score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, threshold: float = 0.3) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, held_out, score and predicted, learned from labels (doc_id, toxic) that are not held out.

    At most `labelled` labelled ids, those of smallest hash, teach lexicons and weights; the label model sees the votes
    of all documents. A text's score depends on the text alone. Null texts are empty; an id with several labels is toxic
    if one says so; null labels and ids teach nothing; rows that repeat each have a row. Without labels of both kinds the
    score is their share for every text. Other columns are not read.
    """
    given = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    given = materialize(given, "labels")
    chosen = materialize(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon = lexicons(texts.join(F.broadcast(chosen), "doc_id").select("text", F.col("label").alias("toxic")))
    table = materialize(texts.mapInArrow(_features(lexicon), "doc_id long, votes int, features array<float>"), "features")
    w, b = _fitted(table, given, chosen, labelled)
    discard(given, chosen)
    weights = F.array(*(F.lit(float(x)) for x in w))
    logit = F.aggregate(F.zip_with("features", weights, lambda f, k: f * k), F.lit(float(b)), lambda s, x: s + x)
    out = table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-logit))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
