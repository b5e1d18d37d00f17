"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from its words and its
byte trigrams, hashed to rows of a learned embedding, and from the mix of kinds of bytes in it, of
their neighbours, and of word repeats; gated attention (a tanh branch times a sigmoid branch) weighs
the passages; the weighted sum is the document's representation, which a logistic output scores. Only
document labels are used to learn all of it, so attention finds by itself which passages decide.

The model is fitted in one task, on every passage of ``MOST_TRAINED`` labelled documents (those with
the least hash of their key). Their texts come to it as a stream sorted by epoch and a hash, once to
scale the features and once an epoch; it holds a batch of them and the parameters, and gives back
these alone. Scoring is a map over whole texts. Neither language, source, key nor label is an input of
a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.llm.common import binary_parts, table
from rasterloom.llm.grams import lower_ascii, runs_of_texts, word_hashes, words

PASSAGE = 64
THRESHOLD = 0.3
#: Labelled documents that the model is fitted on at most: those with the least hash of their key.
MOST_TRAINED = 4000
#: Passages whose counts are laid out at once, and up to which a batch's layouts are kept for the way back.
DENSE, KEPT = 64, 2048
#: Rows of the embedding for words, and as many for trigrams; its width.
BUCKETS, EMBED = 4096, 16
#: Trigrams that are looked up at once in scoring.
AT_ONCE = 1 << 16
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 32, 16, 6, 64, 4e-3, 1e-4

#: Kinds of bytes: white space, lower and upper case, digits, each frequent mark, other marks, UTF-8 leads and tails.
MARKS = b".,!?*#$%&|@_-/:;\"'()"
KINDS = 8 + len(MARKS)


def kind_table() -> np.ndarray:
    t = np.full(256, 5, np.uint8)
    t[[32]], t[9:14] = 0, 1
    t[97:123], t[65:91], t[48:58] = 2, 3, 4
    t[0x80:0xC0], t[0xC0:] = 6, 7
    for i, m in enumerate(MARKS):
        t[m] = 8 + i
    return t


_KIND = kind_table()
FEATURES = KINDS + KINDS * KINDS + 5


@dataclass
class Bags:
    """Passages of some texts: features, rows of the embedding for words and trigrams and how many each passage has, passages of each text."""

    x: np.ndarray
    words: np.ndarray
    n_words: np.ndarray
    grams: np.ndarray
    n_grams: np.ndarray
    sizes: np.ndarray

    def taken(self, texts: np.ndarray) -> Bags:
        """The bags of these texts alone, in this order."""
        first = np.cumsum(self.sizes) - self.sizes
        at = ragged(first[texts], self.sizes[texts])
        wf, gf = np.cumsum(self.n_words) - self.n_words, np.cumsum(self.n_grams) - self.n_grams
        words, grams = ragged(wf[at], self.n_words[at]), ragged(gf[at], self.n_grams[at])
        return Bags(self.x[at], self.words[words], self.n_words[at], self.grams[grams], self.n_grams[at], self.sizes[texts])


def ragged(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each run."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def joined(parts: list[Bags]) -> Bags:
    if not parts:
        none = np.zeros(0, np.int64)
        return Bags(np.zeros((0, FEATURES), np.float32), none.astype(np.uint16), none, none.astype(np.uint16), none, none)
    return Bags(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("x", "words", "n_words", "grams", "n_grams", "sizes")])


def bags(raw: np.ndarray, offsets: np.ndarray) -> Bags:
    """The passages of some texts; a text without words has one, of zeros."""
    return joined([_bags(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in runs_of_texts(offsets)])


def _bags(part: np.ndarray, at: np.ndarray) -> Bags:
    start, end, counts = words(part, at)
    many = np.maximum(-(-counts // PASSAGE), 1)
    first = np.cumsum(many) - many
    total = int(many.sum())
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)
    of_word = first[text] + place // PASSAGE
    begin = np.repeat(at[:-1], many)  # a passage begins with its first word, a text's first one with the text
    lead = (place % PASSAGE == 0) & (place > 0)
    begin[of_word[lead]] = start[lead]
    size = np.diff(np.append(begin, len(part)))
    of_byte = np.repeat(np.arange(total), size)
    kind = _KIND[part].astype(np.int64)
    x = np.zeros((total, FEATURES), np.float32)
    n = np.maximum(size, 1)[:, None].astype(np.float32)
    x[:, :KINDS] = np.bincount(of_byte * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS) / n
    if len(kind) > 1:
        inside = of_byte[1:] == of_byte[:-1]
        pair = (of_byte[1:] * KINDS + kind[:-1]) * KINDS + kind[1:]
        x[:, KINDS : KINDS + KINDS * KINDS] = np.bincount(pair[inside], minlength=total * KINDS * KINDS).reshape(total, -1) / n
    w = np.bincount(of_word, minlength=total)
    per = np.maximum(w, 1)
    low = lower_ascii(part)
    h = word_hashes(low, start, end, 0)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((h, of_word))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    length = (end - start).astype(np.float64)
    x[:, -5] = np.bincount(of_word, again, total) / per
    x[:, -4] = np.bincount(of_word[order], new, total) / per
    x[:, -3] = np.bincount(of_word, length, total) / per / 16
    x[:, -2] = np.bincount(of_word, length * length, total) / per / 256
    x[:, -1] = w / PASSAGE
    wide = low.astype(np.uint32)
    gram = (wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(20) if len(low) > 2 else wide[:0]
    whole = of_byte[: len(gram)] == of_byte[len(of_byte) - len(gram) :]
    n_grams = np.bincount(of_byte[: len(gram)][whole], minlength=total)
    return Bags(x, (h >> np.uint64(52)).astype(np.uint16), w, gram[whole].astype(np.uint16), n_grams, many)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class AttentionMil:
    """The network and its parameters; texts are bags of rows, given by how many rows each has."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, p: dict[str, np.ndarray]):
        self.mean, self.scale, self.p = mean, scale, p

    @staticmethod
    def start(n: int = 0, total: np.ndarray | float = 0.0, squares: np.ndarray | float = 0.0, seed: int = 7) -> AttentionMil:
        """A network before learning; features are scaled by the number, sums and squares' sums of the passages to learn from."""
        rng = np.random.default_rng(seed)
        size = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        p = {"w": size(FEATURES, HIDDEN), "wb": np.zeros(HIDDEN), "v": size(HIDDEN, GATE), "vb": np.zeros(GATE), "u": size(HIDDEN, GATE), "ub": np.zeros(GATE)}
        p |= {"a": size(GATE, 1)[:, 0], "c": size(HIDDEN, 1)[:, 0], "b": np.zeros(1)}
        p |= {"e": rng.normal(0, 0.1, (2 * BUCKETS, EMBED)), "lw": size(EMBED, HIDDEN), "lg": size(EMBED, HIDDEN)}
        # Rare features keep a scale, so that one odd byte doesn't swamp a passage.
        mean = np.zeros(FEATURES) + total / max(n, 1)
        spread = np.sqrt(np.maximum(np.zeros(FEATURES) + squares / max(n, 1) - mean**2, 0))
        return AttentionMil(mean, 1 / (spread + 0.01), p)

    def single(self) -> AttentionMil:
        """The same with numbers of four bytes."""
        return AttentionMil(self.mean.astype(np.float32), self.scale.astype(np.float32), {k: v.astype(np.float32) for k, v in self.p.items()})

    def looked_up(self, ids: np.ndarray, many: np.ndarray, base: int) -> np.ndarray:
        """The mean embedding of each passage's words or trigrams, zero without any."""
        out = np.zeros((len(many), EMBED), self.p["e"].dtype)
        end = np.cumsum(many)
        i = 0
        while i < len(many):  # whole passages, so many together that the rows looked up are few
            j = max(i + 1, int(np.searchsorted(end, end[i] - many[i] + AT_ONCE, "right")))
            lo, own = end[i] - many[i], many[i:j]
            some = np.flatnonzero(own)
            if len(some):
                rows = self.p["e"][base + ids[lo : end[j - 1]].astype(np.int64)]
                out[i + some] = np.add.reduceat(rows, (np.cumsum(own) - own)[some], axis=0) / own[some, None].astype(out.dtype)
            i = j
        return out

    def shares(self, b: Bags) -> Iterator[tuple[slice, np.ndarray]]:
        """For some passages at a time each row of the embedding's share in their means: words', then trigrams'."""
        for i in range(0, len(b.x), DENSE):
            own = slice(i, min(i + DENSE, len(b.x)))
            out = np.zeros((own.stop - i, 2 * BUCKETS), self.p["e"].dtype)
            for ids, many, base in ((b.words, b.n_words, 0), (b.grams, b.n_grams, BUCKETS)):
                n = many[own]
                lo = int(many[:i].sum())
                at = np.repeat(np.arange(len(n)) * BUCKETS, n) + ids[lo : lo + int(n.sum())]
                counts = np.bincount(at, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS)
                np.multiply(counts, 1 / np.maximum(n, 1)[:, None], out=out[:, base : base + BUCKETS], casting="unsafe")
            yield own, out

    def forward(self, b: Bags, dense: Iterable[tuple[slice, np.ndarray]] | None = None) -> dict[str, np.ndarray]:
        p, sizes = self.p, b.sizes
        first = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        x = np.clip((b.x.astype(p["w"].dtype) - self.mean) * self.scale, -8, 8)
        if dense is None:
            ew, eg = self.looked_up(b.words, b.n_words, 0), self.looked_up(b.grams, b.n_grams, BUCKETS)
        else:
            ew, eg = (np.zeros((len(b.x), EMBED), p["e"].dtype) for _ in range(2))
            for own, c in dense:
                ew[own], eg[own] = c[:, :BUCKETS] @ p["e"][:BUCKETS], c[:, BUCKETS:] @ p["e"][BUCKETS:]
        h = np.tanh(x @ p["w"] + ew @ p["lw"] + eg @ p["lg"] + p["wb"])
        t, g = np.tanh(h @ p["v"] + p["vb"]), sigmoid(h @ p["u"] + p["ub"])
        s = (t * g) @ p["a"]
        e = np.exp(s - np.maximum.reduceat(s, first)[of])
        weight = e / np.add.reduceat(e, first)[of]
        z = np.add.reduceat(weight[:, None] * h, first, axis=0)
        return {"x": x, "ew": ew, "eg": eg, "h": h, "t": t, "g": g, "weight": weight, "z": z, "of": of, "first": first, "score": sigmoid(z @ p["c"] + p["b"])}

    def gradient(self, b: Bags, y: np.ndarray) -> dict[str, np.ndarray]:
        held = list(self.shares(b)) if len(b.x) <= KEPT else None  # of a larger batch they are laid out twice
        p, f = self.p, self.forward(b, held or self.shares(b))
        out = ((f["score"] - y) / len(y)).astype(p["c"].dtype)
        dz = out[:, None] * p["c"]
        per = dz[f["of"]]
        inner = (per * f["h"]).sum(axis=1)
        ds = f["weight"] * (inner - np.add.reduceat(f["weight"] * inner, f["first"])[f["of"]])
        dtg = ds[:, None] * p["a"]
        dt = dtg * f["g"] * (1 - f["t"] ** 2)
        dg = dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["weight"][:, None] * per + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        d = {"w": f["x"].T @ dh, "wb": dh.sum(0), "v": f["h"].T @ dt, "vb": dt.sum(0), "u": f["h"].T @ dg, "ub": dg.sum(0)}
        d |= {"a": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ out, "b": np.array([out.sum()])}
        d |= {"lw": f["ew"].T @ dh, "lg": f["eg"].T @ dh}
        d["e"] = np.zeros_like(p["e"])
        for own, c in held or self.shares(b):
            for k, name in ((0, "lw"), (BUCKETS, "lg")):
                d["e"][k : k + BUCKETS] += c[:, k : k + BUCKETS].T @ (dh[own] @ p[name].T)
        return {k: v + DECAY * p[k] for k, v in d.items()}

    def fit(self, batches: Iterator[tuple[Bags, np.ndarray]], steps: int, attention: bool = True) -> None:
        """Adam, a step for each batch of texts and labels, of which there are about ``steps``. Without attention its weights are held at zero, so that passages are averaged."""
        if not attention:
            self.p["a"][:] = 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step, (b, y) in enumerate(batches, 1):
            rate = RATE * (1 - 0.9 * min(step / max(steps, 1), 1))
            for k, d in self.gradient(b, y).items():
                if k == "a" and not attention:
                    continue
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, b: Bags) -> np.ndarray:
        return self.forward(b)["score"].astype(np.float64) if len(b.sizes) else np.zeros(0)


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.encode(F.col(f"`{key}`").cast("string"), "UTF-8")) % 5 == 0


def fitted(batches: Iterator[pa.RecordBatch], attention: bool) -> Iterator[pa.RecordBatch]:
    """The parameters learnt from a stream of (epoch, texts, y, t): epoch -1 scales the features, the others are learnt from in turn."""
    n, total, squares, texts = 0, np.zeros(FEATURES), np.zeros(FEATURES), 0
    rows = (batch.slice(at, BATCH) for batch in batches for at in range(0, batch.num_rows, BATCH))
    model = None

    def learnt() -> Iterator[tuple[Bags, np.ndarray]]:
        nonlocal n, total, squares, texts, model
        for part in rows:
            epoch, y = part.column("epoch").to_numpy(), part.column("y").to_numpy().astype(float)
            b = bags(*binary_parts(part.column("t")))
            first = np.flatnonzero(epoch < 0)
            if len(first):
                x = b.taken(first).x.astype(np.float64)
                n, total, squares, texts = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0), texts + len(first)
            if len(first) < len(y):
                if model is None:
                    model = AttentionMil.start(n, total, squares).single()
                    yield None
                yield b.taken(np.flatnonzero(epoch >= 0)), y[epoch >= 0]

    stream = learnt()
    if next(stream, True) is None:
        model.fit(stream, EPOCHS * -(-texts // BATCH), attention)
        held = [model.mean, model.scale, *model.p.values()]
        yield pa.RecordBatch.from_pylist([{"name": name, "value": v.astype("<f4").tobytes(), "shape": list(v.shape)} for name, v in zip(("mean", "scale", *model.p), held, strict=True)], schema=PARAMETERS)


PARAMETERS = pa.schema([("name", pa.string()), ("value", pa.binary()), ("shape", pa.list_(pa.int32()))])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = MOST_TRAINED, attention: bool = True) -> AttentionMil:
    """A model fitted on at most ``most`` labelled documents that aren't held out. Without any, it scores all alike.

    A key that several rows have counts once, with the text that is least by its bytes. Without
    ``attention`` passages are averaged, for comparison.
    """
    known = labels.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)").where(~held_out("k"))
    known = known.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)
    body = F.coalesce(F.encode(F.col(f"`{text}`"), "UTF-8"), F.lit(b"")).alias("t")
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("k"), body).join(F.broadcast(known), "k")  # ``most`` rows at most
    # One row for each key, however many the table has, so that the sample keeps its bound.
    one = rows.groupBy("k").agg(F.min(F.struct("y", "t")).alias("r")).select("k", "r.*")
    epochs = one.select("k", "y", "t", F.explode(F.sequence(F.lit(-1), F.lit(EPOCHS - 1))).alias("epoch"))
    stream = epochs.repartition(1).sortWithinPartitions("epoch", F.xxhash64("k", "epoch"), "k").select("epoch", "y", "t")
    got = stream.mapInArrow(lambda b: fitted(b, attention), "name string, value binary, shape array<int>").toArrow().to_pylist()
    if not got:
        return AttentionMil.start().single()
    p = {r["name"]: np.frombuffer(r["value"], "<f4").reshape(r["shape"]).copy() for r in got}
    return AttentionMil(p.pop("mean"), p.pop("scale"), p)


def score(docs: DataFrame, model: AttentionMil, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and score (0 to 1) of every row of ``docs``, from its whole text alone.

    Null and empty texts are one passage of zeros and get a score too. Equal texts have equal
    scores. Keys keep their type. An empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.p))  # a fixed size
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.encode(F.col(f"`{text}`"), "UTF-8"), F.lit(b"")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AttentionMil(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = own.score(bags(*binary_parts(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64())], names=["k", "score"])

    return rows.mapInArrow(run, StructType([rows.schema["k"]]).add("score", "double")).withColumnRenamed("k", key)


def keep_quality(docs: DataFrame, model: AttentionMil, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores the threshold or more, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.p))  # a fixed size
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AttentionMil(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array(own.score(bags(*binary_parts(part.column(at_text)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
