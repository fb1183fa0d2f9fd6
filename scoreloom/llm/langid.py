"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (white space cuts words, a word of more than
``LONGEST`` bytes is read in pieces) once forwards and once backwards and labels each
byte with a probability per language. A document's probabilities are the mean over all
its positions. The state starts anew at each word, so a word's labels are the same
wherever it stands: a task computes them once and keeps them, and the cost of a text is
little more than cutting it into words.

Training: back-propagation through time in numpy on the driver, on words of a bounded,
documented sample of labelled documents (``DOCS`` per language, ``WORDS`` word draws per
language, from whole texts); every language with a labelled, not held-out document is learned.
The weights have a fixed size and are sent to the executors.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and has no
shares; without any labelled document all texts are ``und``; a null ``doc_id`` is not held
out; rows that repeat are predicted alike; further columns are ignored.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import GOLDEN, bytes_of, map_batches, mix

UNKNOWN = "und"
DOCS, WORDS = 200, 6000
LONGEST = 24
HIDDEN, EPOCHS, BATCH, RATE = 12, 3, 128, 0.02
#: Words a task remembers with four languages, and words it reads at once; with more languages fewer, as rows are longer.
REMEMBERED, AT_ONCE = 300_000, 1024
#: A score below that of this share of the labelled documents, and by a margin, counts as no language. The margin is
#: a part of the way from the median down to that score: in a small corpus no labelled document falls.
REJECTED, MARGIN = 0.001, 0.1
#: Scores are rounded, as sums differ in the last bits between machines.
DECIMALS = 6


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A matrix product rounded from double precision.

    How a library adds up the terms of a row depends on how many rows there are. In single precision that shows
    in the last bits of a word's row, and a word would score by the company it is read in.
    """
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.float32)


class Direction:
    """A gated recurrent unit read in one direction; gates are ordered update, reset, candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.byte = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.state = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.bias = np.zeros(3 * hidden, np.float32)

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (n, length, hidden) for byte rows ``x`` (n, length)."""
        n, length = x.shape
        h, k = np.zeros((n, self.h), np.float32), self.h
        out = np.empty((n, length, k), np.float32)
        for t in range(length):
            given, own = self.byte[x[:, t]] + self.bias, _product(h, self.state)
            gates = _sigmoid(given[:, : 2 * k] + own[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            candidate = np.tanh(given[:, 2 * k :] + r * own[:, 2 * k :])
            if keep is not None:
                keep.append((h, z, r, candidate, own[:, 2 * k :]))
            h = candidate + z * (h - candidate)
            out[:, t] = h
        return out

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, through time from the last step to the first."""
        k = self.h
        d_byte, d_state, d_bias = np.zeros_like(self.byte), np.zeros_like(self.state), np.zeros_like(self.bias)
        d_h = np.zeros((len(x), k), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, r, c, own = kept[t]
            d_h = d_h + d_out[:, t]
            d_c = d_h * (1 - z) * (1 - c * c)
            d_z = d_h * (h - c) * z * (1 - z)
            d_r = d_c * own * r * (1 - r)
            d_given = np.concatenate([d_z, d_r, d_c], axis=1)
            d_own = np.concatenate([d_z, d_r, d_c * r], axis=1)
            np.add.at(d_byte, x[:, t], d_given)
            d_bias += d_given.sum(axis=0)
            d_state += h.T @ d_own
            d_h = d_h * z + d_own @ self.state.T
        return [d_byte, d_state, d_bias]

    def parameters(self) -> list[np.ndarray]:
        return [self.byte, self.state, self.bias]


class ByteNetwork:
    """Both directions and a softmax per position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.out = (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (n, length, languages) for words of one length."""
        states = np.concatenate([self.ahead.forward(x), self.back.forward(x[:, ::-1])[:, ::-1]], axis=2)
        return self._softmax(_product(states, self.out) + self.out_bias)

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients."""
        kept_a: list = []
        kept_b: list = []
        a = self.ahead.forward(x, kept_a)
        b = self.back.forward(x[:, ::-1], kept_b)[:, ::-1]
        states = np.concatenate([a, b], axis=2)
        p = self._softmax(states @ self.out + self.out_bias)
        rows = np.arange(len(y))
        loss = float(-np.log(p[rows, :, y] + 1e-9).mean())
        d = p / (p.shape[0] * p.shape[1])
        d[rows, :, y] -= 1 / (p.shape[0] * p.shape[1])
        d_states = d @ self.out.T
        h = self.ahead.h
        grads = [np.einsum("nth,ntl->hl", states, d), d.sum(axis=(0, 1))]
        grads += self.ahead.backward(x, kept_a, d_states[:, :, :h])
        grads += self.back.backward(x[:, ::-1], kept_b, d_states[:, ::-1, h:])
        return loss, grads

    def parameters(self) -> list[np.ndarray]:
        return [self.out, self.out_bias, *self.ahead.parameters(), *self.back.parameters()]

    def train(self, words: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam over batches of words of one length."""
        rng = np.random.default_rng(seed)
        by_length: dict[int, tuple[list, list]] = {}
        for w, y in zip(words, labels, strict=True):
            xs, ys = by_length.setdefault(len(w), ([], []))
            xs.append(np.frombuffer(w, np.uint8))
            ys.append(y)
        groups = [(np.stack(xs), np.array(ys)) for _, (xs, ys) in sorted(by_length.items())]
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for _ in range(epochs):
            batches = []
            for x, y in groups:
                order = rng.permutation(len(y))
                batches += [(x[o], y[o]) for o in np.array_split(order, max(1, len(y) // BATCH))]
            for k in rng.permutation(len(batches)):
                step += 1
                _, grads = self.gradients(*batches[k])
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(self.parameters(), grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)


class Reader:
    """A network in a task, with the words it has read."""

    def __init__(self, network: ByteNetwork):
        self.network = network
        self.narrow = max(1.0, len(network.languages) / 4)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        width = 2 * len(self.network.languages) + 1
        self.table = np.empty((0, width), np.float32)

    def read(self, texts: list[bytes | None]) -> np.ndarray:
        """Per text: summed probabilities, labelled positions by language, number of positions."""
        if len(self.known) > REMEMBERED / self.narrow:
            self._clear()
        cut = [(t or b"").split() for t in texts]
        new = list({w for words in cut for w in words if w not in self.known})
        if new:
            self.table = np.concatenate([self.table, self._of(new)])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, words in enumerate(cut):
            if words:
                out[i] = self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(
                    axis=0, dtype=np.float64
                )
        return out

    def _of(self, words: list[bytes]) -> np.ndarray:
        """The row of each word, pieces of a long word added up."""
        n = len(self.network.languages)
        rows = np.zeros((len(words), 2 * n + 1))
        by_length: dict[int, tuple[list[int], list[bytes]]] = {}
        for i, w in enumerate(words):
            for at in range(0, len(w), LONGEST):
                piece = w[at : at + LONGEST]
                owners, pieces = by_length.setdefault(len(piece), ([], []))
                owners.append(i)
                pieces.append(piece)
        step = max(1, int(AT_ONCE / self.narrow))
        for length, (owners, pieces) in by_length.items():
            for at in range(0, len(owners), step):
                part = pieces[at : at + step]
                p = self.network.positions(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), length))
                labels = (p.argmax(axis=2)[:, :, None] == np.arange(n)).sum(axis=1)
                np.add.at(rows, owners[at : at + step], np.concatenate(
                    [p.sum(axis=1), labels, np.full((len(part), 1), length)], axis=1
                ))
        return rows.astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _draw(text: bytes, seed: int, most: int) -> list[bytes]:
    """At most ``most`` pieces of words from anywhere in a text, by hash of their place."""
    pieces = [w[a : a + LONGEST] for w in text.split() for a in range(0, len(w), LONGEST)]
    if len(pieces) <= most:
        return pieces
    order = mix(np.arange(len(pieces), dtype=np.uint64) * GOLDEN + np.uint64(seed & 0xFFFFFFFFFFFFFFFF))
    return [pieces[i] for i in np.sort(np.argpartition(order, most)[:most]).tolist()]


def _training_words(known: DataFrame, counts: dict[str, int]) -> dict[str, list[bytes]]:
    """Per language the drawn pieces of ``DOCS`` documents; one pass whatever the number of languages."""
    # a first cut by hash leaves about twice the documents needed, and the order decides
    cuts = [(lang, int(min(1.0, 2 * DOCS / n) * (1 << 20)), -(-WORDS // min(DOCS, n))) for lang, n in counts.items()]
    cuts = F.broadcast(known.sparkSession.createDataFrame(cuts, "lang string, cut long, most long"))
    place = F.xxhash64("doc_id", F.lit(3), F.xxhash64("text"))
    few = known.select("lang", place.alias("p"), "text").join(cuts, "lang").where(F.pmod("p", F.lit(1 << 20)) <= F.col("cut"))

    def draw(batches):
        best: dict[str, list] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "p", "most")]
            for lang, p, most, text in zip(*columns, bytes_of(batch.column("text")), strict=True):
                own = best.setdefault(lang, [])
                if len(own) < DOCS or p < own[-1][0]:
                    insort(own, (p, b" ".join(_draw(text, p, most))))
                    del own[DOCS:]
        for lang, own in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own)), pa.array([p for p, _ in own], pa.int64()), pa.array([w for _, w in own], pa.binary())],
                names=["lang", "p", "words"],
            )

    rows = few.mapInArrow(draw, "lang string, p long, words binary").collect()
    drawn: dict[str, list] = {lang: [] for lang in counts}
    for r in rows:
        drawn[r["lang"]].append((r["p"], bytes(r["words"])))
    return {lang: [w for _, words in sorted(own)[:DOCS] for w in words.split()] for lang, own in drawn.items()}


def train_network(docs: DataFrame, hidden: int = HIDDEN) -> ByteNetwork | None:
    """Learn from ``docs(doc_id, text, lang)`` that are not held out and have a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return None
    words: list[bytes] = []
    labels: list[int] = []
    drawn = _training_words(known, counts)
    for k, lang in enumerate(languages):
        if pieces := drawn[lang]:
            rng = np.random.default_rng(k)
            words += [pieces[i] for i in rng.integers(0, len(pieces), WORDS)]
            labels += [k] * WORDS
    network = ByteNetwork(languages, hidden)
    network.train(words, labels)
    return network


def _has_letter(text: bytes | None) -> bool:
    return any(map(str.isalpha, (text or b"").decode("utf-8", "replace")))


def _scores(sums: np.ndarray, languages: int) -> np.ndarray:
    """The mean probability of the likeliest language to ``DECIMALS``, from the rows of ``Reader.read``."""
    means = sums[:, :languages].max(axis=1, initial=0) / np.maximum(sums[:, -1], 1)
    return np.round(np.minimum(1.0, means), DECIMALS)


def identify(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``(doc_id, lang_pred, score, positions, shares)``.

    ``score`` is the mean probability of the language over all positions, ``shares`` how
    many positions were labelled with each language.
    """
    schema = "doc_id long, lang_pred string, score double, positions long, shares map<string,bigint>"
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if network is None:
        return rows.select(
            "doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("positions"),
            F.lit(None).cast("map<string,bigint>").alias("shares"),
        )
    sent = docs.sparkSession.sparkContext.broadcast(network)
    held: list[Reader] = []

    def predict(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(Reader(sent.value))
        languages, texts = sent.value.languages, bytes_of(batch.column("text"))
        sums = np.concatenate([held[0].read(texts[at : at + 512]) for at in range(0, len(texts), 512)] or [np.empty((0, 2 * len(languages) + 1))])
        n = len(languages)
        letters = [_has_letter(t) for t in texts]
        best = sums[:, :n].argmax(axis=1)
        means = _scores(sums, n)
        return {
            "doc_id": batch.column("doc_id"),
            "lang_pred": [languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters, strict=True)],
            "score": [m if ok else 0.0 for m, ok in zip(means.tolist(), letters, strict=True)],
            "positions": sums[:, -1].astype(np.int64),
            "shares": [
                list(zip(languages, map(int, row), strict=True)) if ok else None
                for row, ok in zip(sums[:, n : 2 * n].tolist(), letters, strict=True)
            ],
        }

    return map_batches(rows, predict, schema)


def least_score(docs: DataFrame, network: ByteNetwork | None) -> float:
    """A margin below the score that all but ``REJECTED`` of the labelled, not held-out documents with a letter reach."""
    if network is None:
        return 0.0
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    scored = identify(known, network).where(F.col("lang_pred") != UNKNOWN)
    found = scored.agg(F.percentile_approx("score", [REJECTED, 0.5], 100_000)).first()[0]
    return found[0] - MARGIN * (found[1] - found[0]) if found else 0.0


def keep_identified(docs: DataFrame, network: ByteNetwork | None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``, all columns.

    Without a network, which no labelled document was there to train, a letter is enough.
    """
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(network)
    held: list[Reader] = []

    def run(batches):
        for batch in batches:
            if not held and sent.value is not None:
                held.append(Reader(sent.value))
            texts = bytes_of(batch.column("text"))
            keep = [_has_letter(t) for t in texts]
            for at in range(0, len(texts) if held else 0, 512):
                scores = _scores(held[0].read(texts[at : at + 512]), len(sent.value.languages))
                keep[at : at + 512] = [k and bool(m >= least) for k, m in zip(keep[at : at + 512], scores, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(*names).mapInArrow(run, docs.schema)
