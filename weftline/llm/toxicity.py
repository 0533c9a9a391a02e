"""Toxicity by weak supervision.

Voters.  Lexicon and pattern voters each say toxic (+1), clean (-1) or nothing (0) on a document.  The
lexicons are built in for English; for any language, stems are mined from a bounded labelled sample:
word beginnings under which many different words occur, all but only in toxic rows (strong stems), or mostly
so (weak stems, which count by their density).

Label model.  The vote patterns of all documents are counted.  A generative model with a hidden class is
fitted to the counts by expectation maximisation: each voter's conditional vote table gives its
accuracy; voters that stay correlated given the class are joined into cliques with a
joint table, and the model is fitted again.  A share ``ANCHOR`` of each posterior stays the majority vote, so that the
hidden class cannot drift to some other split of the corpus, such as long and short texts.

Classifier.  Documents sampled by hash, ``sample`` of either posterior label at most, train a linear hinge-loss
classifier on words, stems and votes; it then scores every document.

Defined cases: null or empty texts have no words and are never toxic; labels that are null or not 0 or 1 are left
out, and without labels no stems are mined; repeated rows are each judged; a null doc_id is carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.features import dual_coordinate_descent, per_row, scores
from weftline.llm.grams import U, Words, as_string, blocks
from weftline.llm.quality import sampled
from weftline.llm.store import drop, written

SAMPLE = 3000
STEMS = (4, 5, 6, 7, 8)
FEATURE_STEMS = (5,)
STRONG, WEAK = (12, 0.98), (6, 0.9)
ANCHOR = 0.3
BITS = 18
INSULTS = "idiot idiots moron morons stupid loser losers scum trash clown clowns worthless pathetic disgusting imbecile imbeciles dumbass jerk jerks creep freak retard retarded vermin lowlife scumbag pig filth filthy ugly disgrace degenerate braindead".split()
PROFANITY = "fuck fucking fucked fucker motherfucker shit shitty bullshit bitch bitches bastard bastards asshole arsehole cunt dick dickhead prick whore slut wanker twat piss damn crap".split()
THREATS = ["kill you", "kill yourself", "hurt you", "shut up", "go die", "hang yourself", "beat you", "hate you", "destroy you"]
ADDRESS = "you youre your ur ya these those such".split()
COURTESY = ["thank you", "thanks for", "please note", "kind regards", "best regards", "we appreciate", "you re welcome"]
VOTERS = ("insult", "insults", "profanity", "threat", "address", "stem", "stems", "weak_density", "density", "clean_words", "courtesy")


def word_hashes(words: list[str]) -> np.ndarray:
    return np.unique(Words(as_string(pa.array(words, pa.string()))).h) if words else np.zeros(0, U)


def _pairs(phrases: list[str]) -> np.ndarray:
    return np.unique(Words(as_string(pa.array(phrases, pa.string()))).grams(2)[0])


def _in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    k = np.searchsorted(known, h)
    k[k == len(known)] = 0
    return known[k] == h


def mine(rows: list[tuple[int, str, int]], levels: tuple[tuple[int, float], ...] = (STRONG, WEAK)) -> list[dict[int, np.ndarray]]:
    """For each level (least, purity), by stem length, the stems under which at least ``least`` different words
    occur in toxic rows and whose occurrences by row are toxic to ``purity``."""
    out: list[dict[int, np.ndarray]] = [{} for _ in levels]
    toxic = np.array([r[2] for r in rows], np.int64)
    sides = [max(1, int((toxic == y).sum())) for y in (0, 1)]
    parts: list[list[np.ndarray]] = [[np.zeros(0, U)] for _ in range(2 + len(STEMS))]
    at = 0
    for _, arr in blocks(as_string(pa.array([r[1] for r in rows], pa.string()))):
        w = Words(arr, stems=STEMS)
        row = np.repeat(np.arange(at, at + len(arr)), np.diff(w.ptr)).astype(U)
        once = np.lexsort((row, w.h))
        once = once[np.append(True, (np.diff(w.h[once]) != 0) | (np.diff(row[once]) != 0))[: len(once)]]
        for part, x in zip(parts, (row, w.h, *(w.stems[k] for k in STEMS))):
            part.append(x[once])
        at += len(arr)
    row, word, *stems = (np.concatenate(p) for p in parts)
    for k, stem in zip(STEMS, stems):
        on = np.flatnonzero(stem)
        known, code = np.unique(stem[on], return_inverse=True)
        y = toxic[row[on].astype(np.int64)]
        pair = np.unique(code * max(1, len(rows)) + row[on].astype(np.int64))  # a row counts once for a stem
        held, side = pair // max(1, len(rows)), toxic[pair % max(1, len(rows))] if len(rows) else pair
        clean, bad = (np.bincount(held[side == v], minlength=len(known)) for v in (0, 1))
        _, lead = np.unique(word[on][y == 1], return_index=True)
        words = np.bincount(code[y == 1][lead], minlength=len(known))
        for level, (least, purity) in zip(out, levels):
            level[k] = known[(words >= least) & (bad / sides[1] >= purity * (bad / sides[1] + clean / sides[0]))]
    return out


class Voters:
    """The voters over a block of texts; picklable."""

    def __init__(self, stems: list[dict[int, np.ndarray]]):
        self.strong, self.weak = stems
        self.insult, self.profanity = word_hashes(INSULTS), word_hashes(PROFANITY)
        self.threat, self.courtesy, self.address = _pairs(THREATS), _pairs(COURTESY), word_hashes(ADDRESS)

    def __call__(self, w: Words) -> np.ndarray:
        """int8 votes, a row per text and a column per voter."""
        n = np.diff(w.ptr)
        insult = _in(w.h, self.insult)
        profane = _in(w.h, self.profanity)
        stem, weak = np.zeros(len(w.h), bool), np.zeros(len(w.h), bool)
        for k in STEMS:
            stem |= _in(w.stems[k], self.strong[k])
            weak |= _in(w.stems[k], self.weak[k])
        grams, gptr = w.grams(2)
        you = _in(w.h, self.address)
        aimed = (insult | profane | stem) & np.append(False, you[:-1])[: len(w.h)]
        bad = per_row(insult | profane | stem, w.ptr)
        ni, ns, nw = per_row(insult, w.ptr), per_row(stem, w.ptr), per_row(weak, w.ptr)
        votes = np.zeros((len(n), len(VOTERS)), np.int8)
        votes[:, 0] = ni > 0
        votes[:, 1] = ni > 1
        votes[:, 2] = per_row(profane, w.ptr) > 0
        votes[:, 3] = per_row(_in(grams, self.threat), gptr) > 0
        votes[:, 4] = per_row(aimed, w.ptr) > 0
        votes[:, 5] = ns > 0
        votes[:, 6] = ns > 1
        votes[:, 7] = (nw > 0) & (nw * 100 >= n)
        votes[:, 8] = (bad > 0) & (bad * 100 >= n)
        votes[:, 9] = -((bad == 0) & (nw < 2)).astype(np.int8)
        votes[:, 10] = -(per_row(_in(grams, self.courtesy), gptr) > 0).astype(np.int8)
        return votes


def encode(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def decode(codes: np.ndarray, k: int = len(VOTERS)) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(k, dtype=np.int64)) % 3 - 1


class LabelModel:
    """Two-class generative model of vote patterns with cliques of correlated voters."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 60, link: float = 0.3, smooth: float = 1.0):
        self.votes, self.counts = votes, counts.astype(float)
        self.cliques = [(v,) for v in range(votes.shape[1])]
        total = votes.sum(1)
        post = np.where(total > 0, 0.95, np.where(total < 0, 0.02, 0.3))
        post = self._fit(post, rounds, smooth)
        self.correlation = self._correlate(post)
        self.cliques = self._join(link)
        start = np.where(total > 0, 0.95, np.where(total < 0, 0.02, 0.3))
        self.posterior = self._fit(start, rounds, smooth)
        self.accuracy = np.array([self._accuracy(v) for v in range(votes.shape[1])])

    def _fit(self, post: np.ndarray, rounds: int, smooth: float) -> np.ndarray:
        start = post
        keys = [np.unique(self.votes[:, list(c)], axis=0, return_inverse=True)[1].ravel() for c in self.cliques]
        for _ in range(rounds):
            held = (1 - ANCHOR) * post + ANCHOR * start
            mass = np.stack([self.counts * (1 - held), self.counts * held])
            prior = (mass.sum(1) + smooth) / (mass.sum() + 2 * smooth)
            odds = np.log(prior[1]) - np.log(prior[0])
            log = np.full(len(post), odds)
            for key in keys:
                size = key.max() + 1
                t = [np.bincount(key, mass[y], size) + smooth for y in (0, 1)]
                log += (np.log(t[1] / t[1].sum()) - np.log(t[0] / t[0].sum()))[key]
            new = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
            if np.abs(new - post).max() < 1e-6:
                return new
            post = new
        return post

    def _correlate(self, post: np.ndarray) -> np.ndarray:
        """Strongest correlation of each two voters given either class."""
        k = self.votes.shape[1]
        best = np.zeros((k, k))
        for p in (post, 1 - post):
            w = self.counts * p
            if w.sum() <= 1:
                continue
            x = self.votes - (w @ self.votes) / w.sum()
            cov = (x * w[:, None]).T @ x / w.sum()
            sd = np.sqrt(np.diag(cov))
            with np.errstate(divide="ignore", invalid="ignore"):
                c = np.nan_to_num(cov / np.outer(sd, sd))
            best = np.where(np.abs(c) > np.abs(best), c, best)
        return best

    def _join(self, link: float) -> list[tuple[int, ...]]:
        k = len(self.correlation)
        root = list(range(k))
        for a in range(k):
            for b in range(a):
                if abs(self.correlation[a, b]) > link:
                    x, y = root[a], root[b]
                    root = [y if r == x else r for r in root]
        return [tuple(v for v in range(k) if root[v] == r) for r in sorted(set(root))]

    def _accuracy(self, v: int) -> float:
        vote, w = self.votes[:, v], self.counts
        right = (w * np.where(vote > 0, self.posterior, np.where(vote < 0, 1 - self.posterior, 0))).sum()
        cast = (w * (vote != 0)).sum()
        return float(right / cast) if cast else float("nan")


def _features(w: Words, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct indicator features of each row: words, stems, and votes in slots of their own."""
    n = len(w.ptr) - 1
    row = np.repeat(np.arange(n), np.diff(w.ptr))
    keys = [(row << (BITS + 1)) | (w.h >> U(64 - BITS)).astype(np.int64)]
    for k in FEATURE_STEMS:
        some = w.stems[k] != 0
        keys.append((row[some] << (BITS + 1)) | ((w.stems[k][some] * U(2 * k + 1)) >> U(64 - BITS)).astype(np.int64))
    r, v = np.nonzero(votes)
    keys.append((r << (BITS + 1)) | ((1 << BITS) + 2 * v + (votes[r, v] > 0)))
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return (key & ((1 << (BITS + 1)) - 1)).astype(np.int32), np.searchsorted(key, np.arange(n + 1) << (BITS + 1))


def _vote_task(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.zeros(0, np.int64)]
            for _, arr in blocks(batch.column(1)):
                codes.append(encode(voters(Words(arr, stems=STEMS))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(codes), pa.int64())], names=["doc_id", "pattern"])

    return run


def _judge_task(voters: Voters, weight: np.ndarray, bias: float, posterior: dict[int, float]):
    weight = weight.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, p = [np.zeros(0)], [np.zeros(0)]
            for _, arr in blocks(batch.column(1)):
                w = Words(arr, stems=STEMS)
                votes = voters(w)
                s.append(np.where(np.diff(w.ptr) > 0, scores(*_features(w, votes), weight, bias, 1 << BITS), -1.0))
                p.append(np.array([posterior.get(c, 0.5) for c in encode(votes).tolist()]))
            score = np.concatenate(s)
            hit = np.flatnonzero(score > 0)
            if len(hit):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), pa.array(score[hit], pa.float64()), pa.array(np.concatenate(p)[hit], pa.float64()), pa.array(np.ones(len(hit), bool))], names=["doc_id", "score", "posterior", "toxic"])

    return run


SCHEMA = "doc_id bigint, score double, posterior double, toxic boolean"


def toxic_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents judged toxic: doc_id, the classifier's score, the label model's posterior."""
    voters = Voters(mine(sampled(docs, labels, "toxic", sample)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cast = written(rows.mapInArrow(_vote_task(voters), "doc_id bigint, pattern bigint"), "votes")
    counted = cast.groupBy("pattern").count().toArrow()
    codes, counts = counted["pattern"].to_numpy(), counted["count"].to_numpy()
    if not len(codes):
        return docs.sparkSession.createDataFrame([], SCHEMA)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    model = LabelModel(decode(codes), counts)
    posterior = dict(zip(codes.tolist(), model.posterior.tolist()))
    yes = [c for c, p in posterior.items() if p > 0.5]
    soft = cast.select("doc_id", F.col("pattern").isin(yes).cast("int").alias("y"))
    weight, bias = fit(sampled(docs, soft, "y", sample), voters)
    drop(cast)
    return rows.mapInArrow(_judge_task(voters, weight, bias, posterior), SCHEMA)


def fit(rows: list[tuple[int, str, int]], voters: Voters) -> tuple[np.ndarray, float]:
    """Classifier trained on (doc_id, text, posterior label) rows; with one class only, that class."""
    dim = (1 << BITS) + 2 * len(VOTERS) + 2
    y = np.array([1.0 if r[2] else -1.0 for r in rows])
    if not len(y) or abs(y.sum()) == len(y):
        return np.zeros(dim), float(y[0]) if len(y) else -1.0
    feats = []
    for _, arr in blocks(as_string(pa.array([r[1] for r in rows], pa.string()))):
        w = Words(arr, stems=STEMS)
        index, ptr = _features(w, voters(w))
        feats += [index[ptr[i] : ptr[i + 1]] for i in range(len(arr))]
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    return dual_coordinate_descent(feats, y, np.ones(dim), cost, dim, whole=1 << BITS)
