"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

p(token | history) = p(class of the token | history) * p(token | class). The class factor is a softmax over hashed
n-gram and skip features of the three tokens before; the second factor comes from the corpus counts of all training
tokens, smoothed by one, so that the whole is a distribution with a share for tokens never seen.

1. All training tokens are counted, keyed by a 64-bit hash of the word.
2. The most frequent ones, at most ``FREQUENT``, travel to the tasks with their counts. Those are few by their bound;
   the counts of all other tokens keep to the shuffle, where none can be hot.
3. Frequent tokens are clustered by the commonest words that come before them, counted over all training text, and the
   clusters cut by frequency into classes. All other tokens, unknown ones too, are dealt by their hash to tail classes,
   whose number grows with the words outside. As history every token stands for itself, frequent or not.
4. The weights are trained in rounds, each over a part of the training documents: every task takes gradient steps from
   the shared weights, and the steps are averaged by tokens in the shuffle. What comes back is one weight table.
5. Texts are scored in numpy batches; the counts of their rare tokens are joined in.

Defined cases: a null or empty text is one end token; without training text nothing is known and all weights are zero;
repeated rows are scored each; a null identifier counts as training text and is returned.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, memory, only, pieces, table, texts, utf8
from .repeats import runs
from .shingles import mix

#: Words known in every task, markers that words are clustered by, clusters and frequency cuts of each.
FREQUENT, MARKERS, CLUSTERS, CUTS = 250_000, 32, 5, 3
CLASSES = CLUSTERS * CUTS + 1
#: The square root of the words outside, divided by this, is the number of tail classes.
TAIL_ROOT = 128
#: Rows of the weight table, rounds of averaging, tokens of a gradient step, step size.
FEATURES, ROUNDS, STEP_TOKENS, RATE = 1 << 16, 3, 16_384, 0.5
#: Logarithms of a class's share are kept within this, so that no power of e leaves single precision.
LARGEST = np.float32(80)
END = b" end"  # no word has a blank
SLICES = 16


def held_out(ident):
    return F.coalesce(F.pmod(F.crc32(ident.cast("string")), F.lit(7)) == 2, F.lit(False))


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def token_counts(training: DataFrame) -> DataFrame:
    """(h, n) of each distinct token."""
    def work(batches):
        for piece in pieces(batches, limit=8 << 20):
            found: Counter[bytes] = Counter()
            for t in utf8(piece.column("text")):
                found.update(tokens(t))
            h = np.fromiter(map(hash_of, found), np.uint64, len(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.fromiter(found.values(), np.int64, len(found)))], names=["h", "n"])

    return training.select("text").mapInArrow(work, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


#: Set in the number of a word outside the table of frequent words; the other bits are its hash.
OUTSIDE = 1 << 63


class Frequent(dict):
    """Word -> its place in the table of frequent words, or its hash marked ``OUTSIDE``, which is not remembered."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.place = dict(zip(hashes.tolist(), range(len(hashes))))

    def __missing__(self, word: bytes) -> int:
        h = hash_of(word)
        place = self.place.get(h)
        if place is None:
            return h | OUTSIDE
        self[word] = place
        return place


_places: list = [None, None]


memory("language model", lambda: _places.__setitem__(slice(None), [None, None]))


def places_in(key: str, hashes: np.ndarray) -> Frequent:
    if _places[0] != key:
        _places[:] = [key, Frequent(hashes)]
    return _places[1]


class LanguageModel:
    """What every task needs: frequent words (hashes in order), counts, classes, totals and the weights.

    ``tail`` has the tokens plus the distinct words of each tail class.
    """

    def __init__(self, hashes, counts, total: int, distinct: int, tail=None):
        self.hashes, self.counts, self.total, self.distinct = hashes, counts, total, distinct
        #: The first tail class.
        self.rare = CLASSES - 1
        self.tail = np.array([total - int(counts.sum()) + distinct - len(hashes)] if tail is None else tail, np.float64)
        self.classes = np.full(len(hashes) + 1, self.rare, np.int64)
        self.weights = np.zeros((FEATURES + 1, self.rare + len(self.tail)), np.float32)
        self.key = f"{total}:{distinct}:{len(hashes)}:{int(hashes.sum()) if len(hashes) else 0}"

    def set_classes(self, classes: np.ndarray) -> None:
        self.classes[:-1] = classes
        in_class = np.bincount(classes, self.counts + 1, self.weights.shape[1]) if len(classes) else np.zeros(self.weights.shape[1])
        in_class[self.rare:] += self.tail + 1
        #: log10 of what a rare token's count plus one is divided by, for each tail class.
        self.rare_share = np.log10(in_class[self.rare:])
        self.word = np.append(np.log10((self.counts + 1) / in_class[classes]) if len(classes) else np.zeros(0), 0.0)
        self.base_share = float(np.log10(self.total + self.distinct + 1))
        self.base = np.append(np.log10(self.counts + 1) - self.base_share, 0.0)

    def tail_of(self, numbers: np.ndarray) -> np.ndarray:
        """Tail class, counted from the first, of words outside the table."""
        return ((numbers >> np.uint64(32)) & np.uint64(0x7FFFFFFF)).astype(np.int64) % len(self.tail)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """Place in the table, or the table's size for words outside."""
        return np.minimum(numbers, np.uint64(len(self.hashes))).astype(np.int64)

    def class_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers < np.uint64(OUTSIDE), self.classes[self.places(numbers)], self.rare + self.tail_of(numbers))

    def read(self, many: list[bytes]):
        """(words per text, all words, numbers of all tokens, history numbers one to three back).

        A number is a place in the table of frequent words or a hash marked ``OUTSIDE``; before the text it is the table's size plus one.
        """
        only("language model")
        split = [tokens(t) for t in many]
        sizes = np.array([len(s) for s in split], np.int64)
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(places_in(self.key, self.hashes).__getitem__, words), np.uint64, len(words))
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        index = np.arange(len(at))
        back = [np.where(index - k >= starts, at[np.maximum(index - k, 0)], np.uint64(len(self.hashes) + 1)) for k in (1, 2, 3)]
        return sizes, words, at, back

    @staticmethod
    def features(back) -> np.ndarray:
        """Rows of the weight table for each token: bigram, trigram and two skip features, as 16-bit hashes."""
        a, b, c = (x.astype(np.uint64) for x in back)
        one = (a + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        two, three = (b + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), (c + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
        return np.stack([(r >> np.uint64(48)).astype(np.uint16) for r in (one, mix(one ^ two), two, three)], 1)

    @staticmethod
    def spread(weights, rows: np.ndarray) -> np.ndarray:
        """Class probabilities."""
        z = np.take(weights, rows[:, 0], axis=0)
        z += weights[FEATURES]
        for k in range(1, rows.shape[1]):
            z += np.take(weights, rows[:, k], axis=0)
        np.clip(z, -LARGEST, LARGEST, out=z)
        np.exp(z, out=z)
        z /= (z @ np.ones((z.shape[1], 1), np.float32))
        return z

    def learn(self, weights, energy, rows, wanted) -> None:
        """One gradient step on a batch; ``energy`` has each row's squared gradients so far."""
        g = self.spread(weights, rows)
        g[np.arange(len(wanted)), wanted] -= 1
        wide = g.astype(np.float64)
        for k in range(rows.shape[1]):  # 16-bit keys are sorted by their digits
            order = np.argsort(rows[:, k], kind="stable")
            at, sizes = runs(rows[:, k][order])
            upto = np.take(wide, order, axis=0)
            step = np.take(np.cumsum(upto, axis=0, out=upto), at + sizes - 1, axis=0)
            step[1:] -= step[:-1].copy()  # sums of the runs
            step = step.astype(np.float32)
            LanguageModel.move(weights, energy, rows[order[at], k].astype(np.int64), step, sizes)
        LanguageModel.move(weights, energy, np.array([FEATURES]), g.sum(0, keepdims=True), np.array([len(g)]))

    @staticmethod
    def move(weights, energy, at, step, sizes) -> None:
        own = np.take(energy, at) + np.einsum("ij,ij->i", step, step) / (sizes * step.shape[1]).astype(np.float32)
        energy[at] = own
        step *= (RATE / np.sqrt(sizes * (own + 1.0))).astype(np.float32)[:, None]
        weights[at] = np.take(weights, at, axis=0) - step


def cluster(model: LanguageModel, after: np.ndarray) -> np.ndarray:
    """Classes of the frequent words: clusters by what comes before them, cut by frequency into equal shares."""
    k = len(model.hashes)
    seen = after.sum(1, dtype=np.float64)
    x = after
    x += (0.5 * after.sum(0, dtype=np.float64) / max(1.0, seen.sum())).astype(np.float32)
    x /= (seen + 0.5)[:, None].astype(np.float32)
    np.sqrt(x, out=x)
    weight = model.counts.astype(np.float32) * (seen > 0)
    strong = np.argsort(-seen, kind="stable")[:5000]
    centres = [x[strong[0]]]
    for _ in range(1, CLUSTERS):  # the best known words that are furthest from the centres so far
        near = np.max([x[strong] @ c for c in centres], 0)
        centres.append(x[strong[int(np.argmin(near))]])
    centres = np.array(centres)
    for _ in range(15):
        own = np.argmax(x @ centres.T, 1)
        for c in range(CLUSTERS):
            if (weight * (own == c)).sum() > 0:
                v = (weight * (own == c)) @ x
                centres[c] = v / np.linalg.norm(v)
    own = np.argmax(x @ centres.T, 1)
    out = np.zeros(k, np.int64)
    for c in range(CLUSTERS):
        members = np.flatnonzero(own == c)
        members = members[np.argsort(-model.counts[members], kind="stable")]
        mass = np.cumsum(model.counts[members])
        if len(members):
            out[members] = c * CUTS + np.minimum(CUTS - 1, ((mass - model.counts[members] / 2) * CUTS // mass[-1]).astype(np.int64))
    return out


def _words_before(training: DataFrame, model: LanguageModel, markers: np.ndarray) -> np.ndarray:
    """How often each frequent word follows each marker, over all training text."""
    shared = training.sparkSession.sparkContext.broadcast((model, markers))

    def work(batches):
        m, marks = shared.value
        number = np.full(len(m.hashes) + 2, -1)
        number[marks] = np.arange(len(marks))
        for piece in pieces(batches, limit=8 << 20):
            _, _, at, back = m.read(utf8(piece.column("text")))
            at, mark = m.places(at), number[m.places(back[0])]
            use = (mark >= 0) & (at < len(m.hashes))
            pair, n = np.unique(at[use] * len(marks) + mark[use], return_counts=True)
            part = pair // width
            cuts, sizes = runs(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[cuts].astype(np.int32)), pa.array([(pair[i:i + s] - part[i] * width).astype(np.int32).tobytes() for i, s in zip(cuts, sizes)], pa.binary()),
                 pa.array([n[i:i + s].astype(np.int64).tobytes() for i, s in zip(cuts, sizes)], pa.binary())], names=["slice", "pair", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, pair, n in zip(*(c.to_pylist() for c in batch.columns)):
                total.setdefault(s, np.zeros(width, np.int64))[np.frombuffer(pair, np.int32)] += np.frombuffer(n, np.int64)
        keys = sorted(total)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k].astype(np.float32).tobytes() for k in keys], pa.binary())], names=["slice", "n"])

    size = len(model.hashes) * len(markers)
    width = -(-size // SLICES)
    sent = training.select("text").mapInArrow(work, "slice int, pair binary, n binary").repartition(SLICES, "slice")
    out = np.zeros(width * SLICES, np.float32)
    for r in sent.mapInArrow(add, "slice int, n binary").toLocalIterator():  # one table of bounded size, slice by slice
        out[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(r["n"], np.float32)
    return out[:size].reshape(len(model.hashes), len(markers))


def _round(part: DataFrame, model: LanguageModel) -> None:
    """Gradient steps of all tasks from the shared weights, averaged by their tokens."""
    shared = part.sparkSession.sparkContext.broadcast(model)

    def steps(batches):
        m = shared.value
        weights, energy, seen = m.weights.copy(), np.zeros(FEATURES + 1, np.float32), 0
        for piece in pieces(batches):
            _, _, at, back = m.read(utf8(piece.column("text")))
            rows, wanted = m.features(back), m.class_of(at)
            for i in range(0, len(at), STEP_TOKENS):
                m.learn(weights, energy, rows[i:i + STEP_TOKENS], wanted[i:i + STEP_TOKENS])
            seen += len(at)
        if seen:
            moved = (weights - m.weights).astype(np.float16)
            cut = np.array_split(moved, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([seen] * SLICES, pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())],
                                             names=["slice", "seen", "moved"])

    def average(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for s, seen, moved in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.frombuffer(moved, np.float16).astype(np.float64) * seen
                t = total.setdefault(s, [0.0, 0])
                t[0], t[1] = t[0] + v, t[1] + seen
        if total:
            keys = sorted(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k][1] for k in keys], pa.int64()),
                                              pa.array([(total[k][0] / total[k][1]).astype(np.float32).tobytes() for k in keys], pa.binary())], names=["slice", "seen", "moved"])

    kind = "slice int, seen bigint, moved binary"
    got = part.select("text").mapInArrow(steps, kind).repartition(SLICES, "slice").mapInArrow(average, kind).collect()  # one weight table
    if got:
        moved = {r["slice"]: np.frombuffer(r["moved"], np.float32) for r in got}
        model.weights = model.weights + np.concatenate([moved[s] for s in range(SLICES)]).reshape(model.weights.shape)


def tail_classes(words: int) -> int:
    return max(1, round(words ** 0.5 / TAIL_ROOT))


def train(training: DataFrame, counts: DataFrame, rounds: int = ROUNDS, frequent: int = FREQUENT) -> LanguageModel:
    """``training`` has ``text`` and a number ``part`` that deals its rows into rounds; ``counts`` is checkpointed."""
    figures = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    level = F.floor(F.log2("n")).cast("int")
    taken, least = 0, 64
    for step, n in sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):  # 64 rows at most
        if taken + n > frequent:
            break
        taken, least = taken + n, step
    rows = counts.where(level >= least).toPandas()
    hashes = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    tail = np.zeros(tail_classes(figures["distinct"] - len(hashes)))
    of = F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(0x7FFFFFFF)) % len(tail)  # as in tail_of
    for r in counts.where(level < least).groupBy(of.alias("k")).agg(F.sum(F.col("n") + 1).alias("n")).collect():  # one row a class
        tail[r["k"]] = r["n"]
    model = LanguageModel(hashes[order], rows["n"].to_numpy(np.int64)[order], figures["total"], figures["distinct"], tail)
    if len(hashes):
        markers = np.argsort(-model.counts, kind="stable")[:MARKERS]
        model.set_classes(cluster(model, _words_before(training, model, markers)))
    else:
        model.set_classes(np.zeros(0, np.int64))
    for k in range(rounds if figures["distinct"] else 0):
        _round(training.where(F.pmod("part", F.lit(rounds)) == k), model)
    return model


def scores(docs: DataFrame, rounds: int = ROUNDS, frequent: int = FREQUENT, is_held_out=held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    source = texts(docs).withColumn("held_out", is_held_out(F.col("doc_id")))
    training = source.where("not held_out").select("text", F.xxhash64("doc_id", "text").alias("part"))
    counts = checkpointed(token_counts(training))
    model = train(training, counts, rounds, frequent)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = shared.value
        for piece in pieces(batches):
            sizes, words, at, back = m.read(utf8(piece.column("text")))
            starts = np.cumsum(sizes) - sizes
            wanted, tail = m.class_of(at), m.tail_of(at)
            at = m.places(at)
            known = at < len(m.hashes)
            factor = np.empty(len(at))
            for i in range(0, len(at), STEP_TOKENS):
                j = min(len(at), i + STEP_TOKENS)
                p = m.spread(m.weights, m.features([b[i:j] for b in back]))
                factor[i:j] = np.log10(np.maximum(p[np.arange(j - i), wanted[i:j]], 1e-30))
            factor += np.where(known, m.word[at], -m.rare_share[tail])
            base = np.where(known, m.base[at], -m.base_share)
            rare = np.flatnonzero(~known)
            hashes = np.fromiter((hash_of(words[i]) for i in rare), np.uint64, len(rare)).view(np.int64)
            ends = np.append(0, np.cumsum(np.add.reduceat(~known, starts, dtype=np.int64))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(sizes), pa.array(np.add.reduceat(known, starts, dtype=np.int64)),
                 pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(factor, starts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes))],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "own", "rare"])

    scored = source.mapInArrow(work, "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, own double, rare array<bigint>")
    scored = checkpointed(scored.withColumn("row", F.monotonically_increasing_id()))
    # The shares of rare tokens hold a count of zero so far; those that training text has add the log of count + 1.
    asked = scored.select("row", F.explode("rare").alias("h"))
    found = asked.join(counts, "h").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"), (F.col("own") + gain).alias("score"))


def op6_lm_scores(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


QUERIES = {"op6_lm_scores": op6_lm_scores}
ORACLES: dict[str, str] = {}
