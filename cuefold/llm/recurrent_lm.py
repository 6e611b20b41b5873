"""A gated recurrent language model in numpy, learned across the cluster, that scores whole documents.

Words outside a short list are one symbol to the network; what such a word adds is its share of their
training counts. So the probabilities of all words, unseen ones included, sum to one after any text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import raw_text, words_of
from cuefold.llm.term_sums import Measure, Valued, postings, summed, term_counts, together
from cuefold.session import durable

#: Symbols of the network: the most frequent words, the end of a text, and one for all other words.
SYMBOLS, CLASSES, HIDDEN = 1024, 32, 16
PER_CLASS = SYMBOLS // CLASSES
#: Steps a gradient runs back, windows through which a lane carries its state, lanes learned together.
WINDOW, CARRIED, LANES = 32, 4, 64
#: Rounds of learning; each takes its own part of the training documents, and ends in an average of all tasks.
ROUNDS = 2
RATE = 0.01
END = b"\n"  # no word can hold it
SHAPES = {"x": (SYMBOLS + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "w": (CLASSES, HIDDEN, PER_CLASS), "wb": (CLASSES, PER_CLASS)}
START = SYMBOLS
Params = dict[str, np.ndarray]


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode())


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*words_of(text), END]


def held_out(doc_id: int | None) -> bool:
    """Whether crc32(doc_id as text) leaves 1 by 5; a null id does not."""
    return doc_id is not None and fold_of(doc_id) % 5 == 1


def initial(counts: np.ndarray) -> Params:
    """Small random weights; the output offsets make the untrained network the unigram distribution of `counts`."""
    rng = np.random.default_rng(7)
    params = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    share = (counts + 0.5).reshape(CLASSES, PER_CLASS)
    params["cb"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
    params["wb"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    params["c"] *= 0.1
    params["w"] *= 0.1
    return params


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def step(p: Params, symbols: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the unit: new state, update gate, reset gate, candidate, and the state's part of the candidate."""
    x, u = p["x"][symbols], h @ p["u"]
    gates = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    z, r, inner = gates[:, :HIDDEN], gates[:, HIDDEN:], u[:, 2 * HIDDEN :]
    n = np.tanh(x[:, 2 * HIDDEN :] + r * inner)
    return n + z * (h - n), z, r, n, inner


def log_softmax(a: np.ndarray) -> np.ndarray:
    a = a - a.max(axis=1, keepdims=True)
    return a - np.log(np.exp(a).sum(axis=1, keepdims=True))


def by_class(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of targets by class, and (class, start, end) of the classes that occur."""
    classes = targets // PER_CLASS
    ends = np.cumsum(np.bincount(classes, minlength=CLASSES)).tolist()
    return np.argsort(classes, kind="stable"), [(c, lo, hi) for c, (lo, hi) in enumerate(zip([0, *ends], ends)) if hi > lo]


def log_likelihood(p: Params, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after its state: of its class, then of the symbol in the class."""
    order, runs = by_class(targets)
    at, places = states[order], (targets % PER_CLASS)[order]
    found = np.empty(len(targets), states.dtype)
    for c, lo, hi in runs:
        found[lo:hi] = log_softmax(at[lo:hi] @ p["w"][c] + p["wb"][c])[np.arange(hi - lo), places[lo:hi]]
    out = log_softmax(states @ p["c"] + p["cb"])[np.arange(len(targets)), targets // PER_CLASS]
    out[order] += found
    return out


def misses(logits: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
    """Gradient of a mean over n of -log softmax at the wanted places."""
    delta = np.exp(logits - logits.max(axis=1, keepdims=True))
    delta /= delta.sum(axis=1, keepdims=True)
    delta[np.arange(len(delta)), wanted] -= 1
    delta *= logits.dtype.type(1 / n)
    return delta


def gradient(p: Params, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradient of a window's mean loss, and the state after it. inputs, targets, mask: (steps, lanes)."""
    kept, states = [], [h]
    for t in range(len(inputs)):
        h, *gates = step(p, inputs[t], h)
        kept.append(gates)
        states.append(h)
    before, after = np.stack(states[:-1]), np.concatenate(states[1:])
    z, r, n, inner = (np.stack(x) for x in zip(*kept))
    g = {k: np.zeros(s, dtype=h.dtype) for k, s in SHAPES.items()}

    real = np.flatnonzero(mask.ravel())
    want = targets.ravel()[real]
    order, runs = by_class(want)
    real, want = real[order], want[order]
    at, places = after[real], want % PER_CLASS
    delta = misses(at @ p["c"] + p["cb"], want // PER_CLASS, len(real))
    g["c"], g["cb"] = at.T @ delta, delta.sum(axis=0)
    into = delta @ p["c"].T
    for c, lo, hi in runs:
        d = misses(at[lo:hi] @ p["w"][c] + p["wb"][c], places[lo:hi], len(real))
        g["w"][c], g["wb"][c] = at[lo:hi].T @ d, d.sum(axis=0)
        into[lo:hi] += d @ p["w"][c].T
    back = np.zeros_like(after)
    back[real] = into
    back = back.reshape(before.shape)

    # What each gate's input, times the gradient of its step's state, gets of that gradient.
    candidate = (1 - z) * (1 - n * n)
    share = np.stack([(before - n) * z * (1 - z), candidate * inner * r * (1 - r), candidate * r], axis=2)
    du = np.empty_like(share)
    each = np.empty_like(before)
    dh, ut = np.zeros_like(before[0]), p["u"].T.copy()
    for t in reversed(range(len(inputs))):
        dh = dh + back[t]
        each[t] = dh
        np.multiply(dh[:, None, :], share[t], out=du[t])
        dh = dh * z[t] + du[t].reshape(-1, 3 * HIDDEN) @ ut
    g["u"] = before.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
    du[:, :, 2] = each * candidate
    # Steps of one symbol are added up in a row.
    symbols = inputs.ravel()
    by_symbol = np.argsort(symbols, kind="stable")
    symbols = symbols[by_symbol]
    starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    g["x"][symbols[starts]] = np.add.reduceat(du.reshape(-1, 3 * HIDDEN)[by_symbol], starts, axis=0)
    return g, h


class Adam:
    def __init__(self, params: Params, rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, params: Params, g: Params) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = np.float32(min(1.0, 1.0 / max(size, 1e-12)))
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, x in g.items():
            x = x * scale
            self.m[k] += np.float32(0.1) * (x - self.m[k])
            self.v[k] += np.float32(0.001) * (x * x - self.v[k])
            params[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))


class Symbols(dict):
    """Symbol of a word; words off the short list have the one of the others."""

    def __init__(self, listed: list[bytes], others: int):
        super().__init__((w, i) for i, w in enumerate(listed) if i != others)
        self.others = others

    def __missing__(self, word: bytes) -> int:
        return self.others

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))


def lanes(sequences: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, mask) of LANES stretches of CARRIED windows each; together they cover every sequence."""
    length, held = WINDOW * CARRIED, []

    def out(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        longest = max(len(s) for _, s in parts)
        inputs, targets = np.full((longest, len(parts)), START, np.int32), np.zeros((longest, len(parts)), np.int32)
        mask = np.zeros((longest, len(parts)), bool)
        for i, (before, s) in enumerate(parts):
            inputs[0, i] = before
            inputs[1 : len(s), i] = s[:-1]
            targets[: len(s), i] = s
            mask[: len(s), i] = True
        return inputs, targets, mask

    for s in sequences:
        for at in range(0, len(s), length):
            held.append((int(s[at - 1]) if at else START, s[at : at + length]))
            if len(held) == LANES:
                yield out(held)
                held = []
    if held:
        yield out(held)


def learn(docs: DataFrame, params: Params, symbols: Symbols, turn: int, rate: float) -> Params:
    """The average, by symbols learned, of what every task makes of `params` on its part of the round's documents."""
    spark = docs.sparkSession
    sent, names = spark.sparkContext.broadcast(params), list(SHAPES)
    words = spark.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: v.copy() for k, v in sent.value.items()}
        adam, seen, table = Adam(own, rate), 0, words.value
        mine = (table.of(tokens_of(text)) for rows in together(batches) for _, text in rows)
        for inputs, targets, mask in lanes(mine):
            h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
            for at in range(0, len(inputs), WINDOW):
                part = slice(at, at + WINDOW)
                if mask[part].any():
                    g, h = gradient(own, inputs[part], targets[part], mask[part], h)
                    adam.update(own, g)
            seen += int(mask.sum())
        if seen:
            vector = np.concatenate([own[k].ravel() for k in names]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vector), dtype=np.int32)), pa.array(vector), pa.array(np.full(len(vector), seen))], names=["i", "v", "n"])

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary"))
    part = docs.select(F.col("doc_id").cast("long"), raw_text()).where((F.col("doc_id").isNull() | (fold % 5 != 1)) & (F.floor(fold / 5) % ROUNDS == turn))
    tasks = part.mapInArrow(run, "i int, v double, n long")
    mean = {r.i: r.v for r in tasks.groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toLocalIterator()}
    if not mean:
        return params
    vector, out, at = np.array([mean[i] for i in range(len(mean))], dtype=np.float32), {}, 0
    for k in names:
        size = int(np.prod(SHAPES[k]))
        out[k], at = vector[at : at + size].reshape(SHAPES[k]), at + size
    return out


def score(p: Params, texts: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each symbol sequence, all steps of all of them; state goes on from window to window.

    The longest come first, so those still going are always the first lanes.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    sums, h = np.zeros(len(texts)), np.zeros((len(texts), HIDDEN), np.float32)
    width = 64
    for at in range(0, int(lengths.max(initial=0)), width):
        going = int((lengths > at).sum())
        targets = np.zeros((width, going), np.int32)
        before = np.full(going, START, np.int32)
        for lane in range(going):
            s = texts[order[lane]]
            part = s[at : at + width]
            targets[: len(part), lane] = part
            if at:
                before[lane] = s[at - 1]
        h = h[:going]
        states, real = [], []
        for t in range(width):
            active = int((lengths[:going] > at + t).sum())
            if not active:
                break
            h = h[:active]
            h = step(p, before[:active] if t == 0 else targets[t - 1, :active], h)[0]
            states.append(h)
            real.append(targets[t, :active])
        found = log_likelihood(p, np.concatenate(states), np.concatenate(real)).astype(np.float64)
        lane = np.concatenate([np.arange(len(x)) for x in real])
        sums[:going] += np.bincount(lane, found, going)
        if len(h) < going:  # lanes that ended are not needed again
            h = np.concatenate([h, np.zeros((going - len(h), HIDDEN), np.float32)])
    out = np.empty(len(texts))
    out[order] = sums / np.log(10)
    return out


def counting(only_training: bool) -> Callable[[], Measure]:
    def start() -> Measure:
        def of(rows):
            for doc_id, text in rows:
                yield (Counter() if only_training and held_out(doc_id) else Counter(tokens_of(text))), ()

        return of

    return start


def scoring(params: Broadcast, symbols: Broadcast) -> Callable[[], Measure]:
    """Measures documents: token frequencies; held_out, n_tokens and the bits of the network's score."""

    def start() -> Measure:
        def of(rows):
            texts = [tokens_of(text) for _, text in rows]
            bits = score(params.value, [symbols.value.of(t) for t in texts]).view(np.int64).tolist()
            for (doc_id, _), tokens, b in zip(rows, texts, bits):
                yield Counter(tokens), (int(held_out(doc_id)), len(tokens), b)

        return of

    return start


def log_shares(n: int, v: int, rare_n: int, rare_v: int, listed: set[bytes]) -> Callable[[], Valued]:
    """Values of terms: log10 share of all counts, whether it has any, and off the short list the log10 share of the counts there."""

    def start() -> Valued:
        def find(terms: list[bytes], counts: list[int]) -> np.ndarray:
            c = np.array(counts, dtype=np.float64)
            rare = np.fromiter((t not in listed for t in terms), bool, len(terms))
            return np.array([np.log10((c + 0.5) / (n + 0.5 * (v + 1))), c > 0, np.where(rare, np.log10((c + 0.5) / (rare_n + 0.5 * (rare_v + 1))), 0.0)])

        return find

    return start


def unpacked_double(column: str) -> F.Column:
    """The double whose bits are a long: sign, exponent and mantissa put together."""
    bits = F.col(column)
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(0x7FF))
    mantissa = bits.bitwiseAND(F.lit((1 << 52) - 1))
    value = (F.lit(1.0) + mantissa / F.lit(float(1 << 52))) * F.pow(F.lit(2.0), exponent - 1023)
    return F.when(exponent == 0, F.lit(0.0)).otherwise(sign * value)


def language_model(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document row.

    Tokens are the words of the text, A-Z in lower case, then one end. Documents that are not held out
    are learned from, all of them, each in one of the rounds. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1)))
    over tokens; score is the network's log10 probability of the whole text.

    A null or empty text is the end alone. Rows that repeat a doc_id, or have none, are scored one by one; a
    null id is learned from. Without training documents the network stays evenly spread. Only doc_id and
    text are read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = durable(term_counts(docs, counting(True), SYMBOLS - 1, END))
    # A top-k by count: the symbols of the network, whose number is fixed; the end is among them where there is any.
    best = counts.select(F.explode(F.arrays_zip("top_terms", "top_ns")).alias("x")).select(F.col("x.top_terms").alias("term"), F.col("x.top_ns").alias("n"))
    is_end = F.col("term") == F.lit(END)
    ends = best.where(is_end).agg(F.sum("n")).first()[0] or 0
    top = [(bytes(r.term), r.n) for r in best.where(~is_end).orderBy(F.desc("n"), "term").limit(SYMBOLS - 2).collect()]
    totals = counts.agg(F.sum("total").alias("n"), F.sum(F.length("lengths") / 4).cast("long").alias("v")).first()
    n, v = totals.n or 0, totals.v or 0
    rare_n, rare_v = n - ends - sum(c for _, c in top), v - len(top) - bool(ends)
    listed = sorted([*top, (END, ends), (b"", rare_n)], key=lambda x: (-x[1], x[0]))
    names = [w for w, _ in listed]
    symbols = Symbols(names, names.index(b""))
    params = initial(np.array([c for _, c in listed] + [0] * (SYMBOLS - len(listed)), dtype=float))
    for turn in range(ROUNDS):
        params = learn(docs, params, symbols, turn, RATE / (1 + turn))
    measure = scoring(spark.sparkContext.broadcast(params), spark.sparkContext.broadcast(symbols))
    values = log_shares(n, v, rare_n, rare_v, {w for w in names if w})
    per_doc = summed(postings(docs, measure), ["base", "known", "rare"], ["held", "n_tokens", "bits"], values, counts)
    return per_doc.select(
        "doc_id", (F.col("held") == 1).alias("held_out"), "n_tokens", F.round("known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (unpacked_double("bits") + F.col("rare")).alias("score"),
    )
