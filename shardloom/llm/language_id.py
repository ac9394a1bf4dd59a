"""Language ID by a byte convolutional network, trained in numpy.

Bytes fall into classes with an embedding each; filters of several widths run over a window of fixed length, the largest
response of each filter is kept, and a softmax over the responses gives the language. A trained filter is a sum of
per-byte responses, so for application the filters are folded into tables over pairs of classes. A text is cut into
windows from its start to its end; its scores are the mean of theirs, weighted by the bytes they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, ready

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
CLASSES = 128
#: The bound on the training sample: labelled texts a language, and characters of each (from a place that its id decides).
PER_LANG = 600
SAMPLE_CHARS = 768
EPOCHS = 6
BATCH = 64


def _byte_classes() -> np.ndarray:
    """Letters without case, one class each for digits, controls and blanks, other ASCII; upper bytes half as fine for leads."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b).lower()
        if b >= 0xC0:
            out[b] = 96 + (b - 0xC0) // 2
        elif b >= 0x80:
            out[b] = 32 + (b - 0x80)
        elif "a" <= c <= "z":
            out[b] = 3 + ord(c) - ord("a")
        elif c.isdigit():
            out[b] = 1
        else:
            out[b] = 0 if b <= 0x20 else 2
    return out


BYTE_CLASS = _byte_classes()


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes (windows x WINDOW), the text each window is of, and how many bytes it holds. Every byte is in one window."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    flat = np.full(int(counts.sum()) * WINDOW, 0x20, np.uint8)
    at = (np.cumsum(counts) - counts) * WINDOW
    for t, a in zip(texts, at.tolist(), strict=True):
        flat[a : a + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.clip(np.array([len(t) for t in texts], np.int64)[owner] - place * WINDOW, 1, WINDOW)
    return BYTE_CLASS[flat].reshape(-1, WINDOW), owner, held


class Net:
    """E: classes x EMBED; W[w]: w x EMBED x FILTERS with bias c[w]; V, d: softmax over the pooled responses."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"E": rng.normal(0, 0.3, (CLASSES, EMBED)), "V": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), "d": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 0.3, (w, EMBED, FILTERS))
            self.p[f"c{w}"] = np.zeros(FILTERS)

    def tables(self) -> dict[str, np.ndarray]:
        """For each width, responses of its pairs of classes (and of a last single class)."""
        out = {}
        for w in WIDTHS:
            per = np.einsum("ae,jef->jaf", self.p["E"], self.p[f"W{w}"])
            per[0] += self.p[f"c{w}"]
            for j in range(0, w, 2):
                out[f"{w}.{j}"] = (per[j][:, None] + per[j + 1][None]).reshape(-1, FILTERS).astype(np.float32) if j + 1 < w else per[j].astype(np.float32)
        return out

    @staticmethod
    def pooled(x: np.ndarray, tables: dict[str, np.ndarray], where: bool = False):
        """Largest response of each filter in each window, and its place."""
        pairs = x[:, :-1] * CLASSES + x[:, 1:]
        best, place = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            r = None
            for j in range(0, w, 2):
                t = np.take(tables[f"{w}.{j}"], pairs[:, j : j + n] if j + 1 < w else x[:, j : j + n], axis=0)
                r = t if r is None else np.add(r, t, out=r)
            best.append(r.max(1))
            if where:
                place.append(r.argmax(1))
        return np.concatenate(best, 1), place

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h, place = self.pooled(x, self.tables(), True)
        h = h.astype(np.float64)
        a = np.maximum(h, 0)
        z = a @ self.p["V"] + self.p["d"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(1, keepdims=True)
        rows = np.arange(len(y))
        loss = float(-np.log(q[rows, y] + 1e-12).mean())
        q[rows, y] -= 1
        q /= len(y)
        g = {"V": a.T @ q, "d": q.sum(0), "E": np.zeros_like(self.p["E"])}
        back = (q @ self.p["V"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            b = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"c{w}"], g[f"W{w}"] = b.sum(0), np.zeros_like(self.p[f"W{w}"])
            for j in range(w):
                cls = x[rows[:, None], place[k] + j]
                per_class = np.zeros((CLASSES, FILTERS))
                np.add.at(per_class, (cls, np.arange(FILTERS)[None]), b)
                g[f"W{w}"][j] = self.p["E"].T @ per_class
                g["E"] += per_class @ self.p[f"W{w}"][j].T
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> Net:
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                _, g = self.step(x[order[i : i + BATCH]], y[order[i : i + BATCH]])
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self


class Model:
    """What is applied: tables and the softmax."""

    def __init__(self, net: Net):
        self.langs, self.tables, self.V, self.d = net.langs, net.tables(), net.p["V"].astype(np.float32), net.p["d"].astype(np.float32)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its probability, by the windows' mean score."""
        x, owner, held = windows(texts)
        z = np.empty((len(x), len(self.langs)), np.float64)
        for i in range(0, len(x), BATCH):
            h, _ = Net.pooled(x[i : i + BATCH], self.tables)
            z[i : i + BATCH] = np.maximum(h, 0) @ self.V + self.d
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        sums = np.zeros((len(texts), len(self.langs)))
        np.add.at(sums, owner, z * held[:, None])
        sums /= np.bincount(owner, held, len(texts))[:, None]
        p = np.exp(sums - sums.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(texts)), best]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG) -> Model | None:
    """labelled rows -> a model, or None if there is nothing to learn from. Every language is learned; at most per_lang texts of each reach the driver."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0))
    counts = {r[lang_col]: r["n"] for r in rows.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    place = F.xxhash64(F.col(id_col).cast("string"), F.lit(5))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * per_lang / n))])
    unit = F.pmod(place, F.lit(1_000_003)) / 1_000_003
    start = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(9)), F.greatest(F.lit(1), F.length(text_col) - SAMPLE_CHARS + 1)).cast("int") + 1
    sample = rows.filter(unit < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), place.alias("place"), F.substring(F.col(text_col), start, F.lit(SAMPLE_CHARS)).alias("t"))
    got: dict[str, list[bytes]] = {lang: [] for lang in sorted(counts)}
    for r in sample.orderBy("place", "lang", "t").limit(2 * per_lang * len(counts)).collect():
        if len(got[r["lang"]]) < per_lang and has_letter(r["t"]):
            got[r["lang"]].append(r["t"].encode("utf-8", "surrogatepass"))
    langs = [lang for lang, t in got.items() if t]
    if not langs:
        return None
    texts = [t for lang in langs for t in got[lang]]
    of = np.repeat(np.arange(len(langs)), [len(got[lang]) for lang in langs])
    x, owner, held = windows(texts)
    use = held >= 24
    use |= ~np.isin(owner, owner[use])
    return Model(Net(langs).fit(x[use], of[owner][use]))


def _judged(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
    data = [texts[i].encode("utf-8", "surrogatepass") for i in rows]
    for a, b in blocks([len(t) for t in data]):
        best, p = model.predict(data[a:b])
        for i, k, s in zip(rows[a:b], best.tolist(), p.tolist(), strict=True):
            lang[i], score[i] = model.langs[k], s
    return lang, score


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every row; only the text decides.

    und with score 0 for a null text, a text without a letter, or without a model. Repeated rows and null ids are judged
    as they stand; an empty table gives no rows; other columns are ignored. Of equal scores the first language by name wins.
    """

    def run(batches):
        for batch in batches:
            lang, score = _judged(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from the rows that are not held out."""
    return train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those whose language can't be told (und); all columns kept. Rows that repeat an id are judged each.

    Only the texts go through Python, a few at a time; the rest of the rows stays where it is.
    """
    model = trained_on(docs, id_col, text_col, lang_col)
    ready(docs.sparkSession)

    def told(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = []
            for i in range(0, len(part), 512):
                out += [x != "und" for x in _judged(model, part.slice(i, 512).to_pylist())[0]]
            yield pa.array(out, pa.bool_())

    return docs.filter(F.arrow_udf(told, "boolean")(F.col(f"`{text_col}`")))
