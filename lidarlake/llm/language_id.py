"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the whole text's UTF-8 bytes, white space and all. A text is cut into cores of CORE bytes; the network
reads a core with WARM bytes before and after it, so that the states of both directions have forgotten where they began,
and labels every byte of the core. Every byte of a text is in exactly one core; a document's probabilities are the mean
over all its bytes.

Training uses a bounded sample: at most SAMPLE_DOCS texts of each language, distinct ones, those of least hash; all of
each text may be learned from. Windows of SPAN bytes are drawn from them, as many of each language, and the network is
trained by backpropagation through time with Adam on the driver; its weights are a few tens of kilobytes and go to the
workers with the code.

Null texts and texts without a letter are `und` with score 0. Without labelled rows every text is `und`. Rows with a null
label are predicted but not learned from; rows without an id are not held out. Repeated rows count once in the sample.
Of labels with equal probabilities the first by code point is predicted. Long texts are read whole, in windows; other
columns are not looked at. Equal texts get equal predictions; empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, lean, narrow, pieces

HIDDEN, EMBED = 24, 12
#: Bytes of a core, of the context that is read on either side, and of a training window.
CORE, WARM, SPAN = 512, 32, 64
#: Texts of each language that are learned from, at most.
SAMPLE_DOCS = 500
STEPS, BATCH, RATE = 500, 256, 0.01
#: Windows that are read side by side.
ABREAST = 1024
#: exp(x) is taken from a fraction of exp(x / 2**HALVINGS), whose argument may be up to FRACTION.
HALVINGS, FRACTION = 4, 13.0
UNDETERMINED = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logistic(x: np.ndarray, top: np.float32, squares: int, spare: np.ndarray) -> None:
    """top / (1 + exp(6 * 2**squares * x)), in place. exp(6 x) is about (x**2 + 1/3 + x) / (x**2 + 1/3 - x), which is then
    squared; the result errs by 5e-7 of top at most as long as |6 x| <= FRACTION. Overflow gives 0."""
    np.multiply(x, x, out=spare)
    spare += np.float32(1 / 3)
    spare -= x
    x += x
    x += spare
    x /= spare
    with np.errstate(over="ignore"):
        for _ in range(squares):
            np.multiply(x, x, out=x)
    x += np.float32(1)
    np.divide(top, x, out=x)


def padded(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(time, word) byte values, and lengths; 0 beyond a word's end."""
    data = np.zeros((len(words), width), np.uint8)
    joined = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    mask = np.arange(width)[None, :] < lengths[:, None]
    data[mask] = joined
    return data.T, lengths


class Network:
    """Weights of both directions: E embeds bytes; per direction W, U, b of the update, reset and candidate gates; V, c
    give the labels' scores."""

    def __init__(self, labels: list[str], seed: int = 0) -> None:
        r, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.labels = labels
        self.w = {"E": draw(256, EMBED, scale=0.5), "V": draw(2 * h, len(labels), scale=0.3), "c": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.w |= {f"W{d}": draw(EMBED, 3 * h, scale=0.4), f"U{d}": draw(h, 3 * h, scale=1 / np.sqrt(h)), f"b{d}": np.zeros(3 * h, np.float32)}

    def _pass(self, d: str, x: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, word, h) of one direction; beyond a word's end the state stays."""
        h, u = HIDDEN, self.w["U" + d]
        table = self.w["E"] @ self.w["W" + d] + self.w["b" + d]
        state = np.zeros((x.shape[1], h), np.float32)
        out, kept = np.zeros((len(x), x.shape[1], h), np.float32), []
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a = table[x[t]]
            gates = _sigmoid(a[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            rs = r * state
            n = np.tanh(a[:, 2 * h :] + rs @ u[:, 2 * h :])
            new = np.where(live[t][:, None], z * state + (1 - z) * n, state)
            if keep:
                kept.append((t, z, r, n, state, rs))
            state = out[t] = new
        return out, kept

    def _scores(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple:
        live = np.arange(len(x))[:, None] < lengths[None, :]
        f, kf = self._pass("f", x, live, keep)
        b, kb = self._pass("b", x, live, keep)
        both = np.concatenate((f, b), axis=2)
        s = both @ self.w["V"] + self.w["c"]
        s -= s.max(axis=2, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=2, keepdims=True)
        return p, live, both, kf, kb

    def _reader(self, d: str, n: int) -> Callable[[np.ndarray], np.ndarray]:
        """step(codes): the states (window, h) of one direction after one byte more of the first len(codes) of n windows.
        They begin as zeros, and the next step writes over them."""
        h = HIDDEN
        # sigmoid(x) = 1 / (1 + exp(-x)) and tanh(x) = 2 / (1 + exp(-2 x)) - 1: numpy's exp and tanh take most of a step
        scale = np.repeat(np.array([-1, -2], np.float32), (2 * h, h))
        table, u = (self.w["E"] @ self.w["W" + d] + self.w["b" + d]) * scale, self.w["U" + d] * scale
        # states lie between -1 and 1
        most, squares = float((np.abs(table).max(axis=0) + np.abs(u).sum(axis=0)).max()), HALVINGS
        while most > FRACTION * 2**squares:
            squares += 1
        by_gate = lambda w: [np.ascontiguousarray(w[:, k * h : (k + 1) * h]) / np.float32(6 * 2**squares) for k in range(3)]
        (table_z, table_r, table_n), (u_z, u_r, u_n) = by_gate(table), by_gate(u)
        states, (gates, inputs), (own, spare) = np.zeros((n, h), np.float32), np.empty((2, 2 * n, h), np.float32), np.empty((2, n, h), np.float32)
        one, two = np.float32(1), np.float32(2)

        def step(codes: np.ndarray) -> np.ndarray:
            m, codes = len(codes), codes.astype(np.intp)
            state, new, rest, both, read = states[:m], own[:m], spare[:m], gates[: 2 * m], inputs[: 2 * m]
            z, r = both[:m], both[m:]
            np.take(table_z, codes, axis=0, out=read[:m], mode="clip")
            np.take(table_r, codes, axis=0, out=read[m:], mode="clip")
            np.matmul(state, u_z, out=z)
            np.matmul(state, u_r, out=r)
            both += read
            _logistic(both, one, squares, read)
            r *= state
            np.matmul(r, u_n, out=new)
            np.take(table_n, codes, axis=0, out=rest, mode="clip")
            new += rest
            _logistic(new, two, squares, rest)
            new -= one
            state -= new
            state *= z
            state += new
            return state

        return step

    def _states(self, d: str, x: np.ndarray, live: np.ndarray | None) -> np.ndarray:
        """States (time, window, h) as _pass has them where windows are live; longer windows come first."""
        step, out = self._reader(d, x.shape[1]), np.zeros((*x.shape, HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            m = x.shape[1] if live is None else int(live[t].sum())
            out[t, :m] = step(x[t, :m])
        return out

    def label_sums(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each window data[begin : begin + length] the sum of the label distributions of its bytes first to last. Each
        direction ends at the last byte that is labelled; states give way to scores at once."""
        out = np.zeros((len(begins), len(self.labels)), np.float64)
        order = np.lexsort((first, -lengths))
        v = {d: np.ascontiguousarray(w) for d, w in zip("fb", np.split(self.w["V"], 2), strict=True)}
        for at in range(0, len(order), ABREAST):
            part = order[at : at + ABREAST]
            n, own, end = lengths[part], first[part], last[part]
            time = np.arange(n[0])[:, None]
            x = data[np.minimum(begins[part] + time, len(data) - 1)]
            live = (time < n).sum(axis=1).tolist()  # the windows that have a byte then: they come first
            low, high = int(own.min()), int(end.max())
            s = np.zeros((n[0], len(part), len(self.labels)), np.float32)
            step = self._reader("f", len(part))
            for t in range(high):
                np.matmul(step(x[t, : live[t]]), v["f"], out=s[t, : live[t]])
            step = self._reader("b", len(part))
            for t in reversed(range(low, n[0])):
                s[t, : live[t]] += step(x[t, : live[t]]) @ v["b"]
            # by label: sums over labels are then sums of rows
            s = np.ascontiguousarray(s[low:high].reshape(-1, len(self.labels)).T).reshape(len(self.labels), high - low, len(part))
            s += self.w["c"][:, None, None]
            s -= s.max(axis=0)
            np.exp(s, out=s)
            core = (time[low:high] >= own) & (time[low:high] < end)
            s *= (core / s.sum(axis=0)).astype(np.float32)
            out[part] = s.sum(axis=1, dtype=np.float64).T
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """For each text (none is empty) the mean distribution of its bytes."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        cores = -(-size // CORE)
        owner = np.repeat(np.arange(len(texts)), cores)
        number = np.arange(cores.sum()) - np.repeat(np.cumsum(cores) - cores, cores)
        start = np.maximum(number * CORE - WARM, 0)
        stop = np.minimum((number + 1) * CORE + WARM, size[owner])
        first, last = number * CORE - start, np.minimum((number + 1) * CORE, size[owner]) - start
        sums = self.label_sums(data, (np.cumsum(size) - size)[owner] + start, stop - start, first, last)
        return np.add.reduceat(sums, np.cumsum(cores) - cores, axis=0) / size[:, None]

    def gradients(self, words: list[bytes], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes, and its gradients by backpropagation through time."""
        h, w = HIDDEN, self.w
        x, lengths = padded(words, max(map(len, words)))
        p, live, both, kf, kb = self._scores(x, lengths, keep=True)
        total = live.sum()
        pick = np.take_along_axis(p, labels[None, :, None], 2)[:, :, 0]
        loss = float(-(np.log(pick + 1e-12) * live).sum() / total)
        ds = p.copy()
        np.put_along_axis(ds, labels[None, :, None], pick[:, :, None] - 1, 2)
        ds *= live[:, :, None] / np.float32(total)
        flat = ds.reshape(-1, ds.shape[2])
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["V"], g["c"] = both.reshape(-1, 2 * h).T @ flat, flat.sum(axis=0)
        back = ds @ w["V"].T
        for d, kept, dh_all in (("f", kf, back[:, :, :h]), ("b", kb, back[:, :, h:])):
            u, da_all = w["U" + d], np.zeros((*x.shape, 3 * h), np.float32)
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, z, r, n, before, rs in reversed(kept):
                alive = live[t][:, None]
                dh = carry + dh_all[t]
                dn = dh * (1 - z) * (1 - n * n) * alive
                dz = dh * (before - n) * z * (1 - z) * alive
                drs = dn @ u[:, 2 * h :].T
                dr = drs * before * r * (1 - r)
                gates = np.concatenate((dz, dr), axis=1)
                g["U" + d][:, : 2 * h] += before.T @ gates
                g["U" + d][:, 2 * h :] += rs.T @ dn
                carry = np.where(alive, dh * z + drs * r + gates @ u[:, : 2 * h].T, dh)
                da_all[t] = np.concatenate((gates, dn), axis=1)
            flat = da_all.reshape(-1, 3 * h)
            per_byte = np.zeros((256, 3 * h), np.float32)
            np.add.at(per_byte, x.reshape(-1), flat)
            g["b" + d] = flat.sum(axis=0)
            g["W" + d] = w["E"].T @ per_byte
            g["E"] += per_byte @ w["W" + d].T
        return loss, g

    def train(self, texts: list[list[bytes]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0) -> float:
        """texts[k]: texts of label k. Every batch has as many windows of each label; Adam with a falling rate. Texts are
        drawn first, so that long ones do not rule, then a window of theirs."""
        r, k = np.random.default_rng(seed), len(texts)
        m, v = ({n: np.zeros_like(x) for n, x in self.w.items()} for _ in range(2))
        loss = 0.0
        for step in range(1, steps + 1):
            labels = np.repeat(np.arange(k), max(1, batch // k))
            chosen = []
            for i in labels.tolist():
                t = texts[i][r.integers(len(texts[i]))]
                at = int(r.integers(max(1, len(t) - SPAN + 1)))
                chosen.append(t[at : at + SPAN])
            loss, g = self.gradients(chosen, labels)
            now = rate * (1 - 0.9 * step / steps)
            for n, x in self.w.items():
                grad = np.clip(g[n], -1, 1)
                m[n] += 0.1 * (grad - m[n])
                v[n] += 0.001 * (grad * grad - v[n])
                x -= (now * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss


def is_held_out(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, per_label: int = SAMPLE_DOCS) -> dict[str, list[bytes]]:
    """Texts of each label from at most per_label rows (doc_id, text, lang) that may be learned from. Rows are told apart
    by their text: repeated ones, and rows without an id, are no more than others."""
    fit = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & ~is_held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    # about three times as many pass the hash; then the least ones are taken
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 3 * per_label / max(1, n)) * (1 << 30)))))
    some = fit.filter(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    least = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).filter(F.col("k") <= per_label)
    out: dict[str, list[bytes]] = {k: [] for k in sorted(counts)}
    for r in sorted(least.select("lang", "k", "text").collect(), key=lambda r: (r["lang"], r["k"])):
        out[r["lang"]].append(r["text"].encode("utf-8", "surrogatepass"))
    return {k: t for k, t in out.items() if t}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    texts = sample(narrow(docs, doc_id=(id_col, "long"), text=(text_col, "string"), lang=(lang_col, "string")))
    if not texts:
        return None
    net = Network(list(texts))
    if len(texts) > 1:
        net.train(list(texts.values()))
    return net


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, budget=1 << 20):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            preds, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if has_letter(t)] if net else []
            if some:
                probs = net.probabilities([texts[i].encode("utf-8", "surrogatepass") for i in some])
                for i, k, p in zip(some, probs.argmax(axis=1).tolist(), probs.max(axis=1).tolist(), strict=True):
                    preds[i], scores[i] = net.labels[k], round(min(1.0, p), 6)
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            yield batch_of(schema, [b.column("doc_id"), held, preds, scores])

    return narrow(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")
