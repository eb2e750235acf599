"""Quality classifier: interpolated modified Kneser-Ney n-gram models of trusted text, over words and over UTF-8 bytes.

Documents are put into blocks, written once, that never move again. Each block asks for its distinct n-grams, and tells
how often its trusted documents hold them; requests are dealt to shards by n-gram, so that a shard sums counts and later
answers. The model's tables (counts, continuation counts, context totals and back-off weights of every order) are
DataFrames joined on n-grams, contexts and suffixes; nothing of the model is broadcast. Answers go back to the blocks,
where a document's mean negative log-likelihood per byte is its loss, and exp(loss) its perplexity.

The word model (`words`) takes trigrams of words, which grow with the corpus, and backs off to the byte model for the
spelling of words. It gives a document's word loss, a mean per byte, and the loss of its worst passage.

Four of five trusted documents, by a hash of their id, train the model; the fifth calibrates: a language's threshold is
a quantile of its calibrating documents' losses, raised by a margin, and a document above its language's threshold is
rejected. So is one above the threshold of its word loss or of its worst passage; those two are taken by language and
length, where that class has LEAST calibrating documents. A language without calibrating documents (the null language is one of its own) takes the quantile of all.
Without any trusted text there is no judgement, and every document with text is kept.

Null and empty texts have no loss and are rejected. Texts of any length are counted and scored whole: several short ones
share a piece of PIECE characters, a longer one is a piece of its own, and its worst passage may be any of its passages. Repeated rows are judged alike; a repeated id is trusted in all its
rows. Rows keep their extra columns in `keep`. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, discard, recorded, tidy
from . import blocks as blocked
from . import tokens64, words
from .blocks import expand, expand_ascending, pieces, squeeze, squeeze_ascending
from .common import batch_of, lean, narrow

ORDER = 5  # bytes of an n-gram; up to 7 fit a signed 64-bit number
QUANTILE, MARGIN = 0.98, 0.02
CALIBRATE = 5
#: Calibrating documents that a class of language and length has, to have thresholds of its own.
LEAST = 50
#: Text characters that are worked on at a time.
PIECE = 1 << 20
#: Groups of blocks that are scored one after the other, so that only one group's answers of bytes travel at a time.
ROUNDS = 4
#: Text bytes whose n-grams a shard answers for.
SHARD_BYTES = 32 << 20


# --- n-grams of a block -------------------------------------------------------------------------------------------


def grams(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts (zero bytes before a text), and each text's number of bytes."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.fromiter(map(len, data), np.int64, len(data))
    pad = bytes(order - 1)
    a = np.frombuffer(pad + pad.join(data), np.uint8)
    g = np.zeros(len(a) - order + 1, np.int64)
    for k in range(order):
        g = g << 8 | a[k : k + len(g)]
    # windows that end in the zeros between two texts are none
    keep = np.ones(len(g), bool)
    ends = np.cumsum(counts + order - 1)[:-1] - (order - 1)
    if len(ends):
        keep[(ends[:, None] + np.arange(order - 1)[None, :]).reshape(-1)] = False
    return g[keep], counts


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xD6E8FEB86659FD93)


def _shard(x: np.ndarray, n: int) -> np.ndarray:
    return ((_spread(x) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def ordered(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A block's distinct n-grams, ascending; and piece by piece where among them the piece's distinct ones stand, which
    of these is at each byte, and each text's bytes. Places ride in the low bits of a plain sort."""
    own, at, sizes = [], [], []
    for _, part in pieces(texts, PIECE):
        g, size = grams(part)
        bits = max(1, len(g).bit_length())
        if 8 * ORDER + bits > 63:  # a very long text: places don't fit beside the n-grams
            g, back = np.unique(g, return_inverse=True)
            own.append(g)
            at.append(back.reshape(-1))
        else:
            g <<= bits
            g |= np.arange(len(g))
            g.sort()
            order = g & ((1 << bits) - 1)
            g >>= bits
            first = tokens64.firsts(g)
            back = np.empty(len(g), np.int32)
            back[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
            own.append(g[first])
            at.append(back)
        sizes.append(size)
    known = np.sort(np.concatenate([np.zeros(0, np.int64), *own]))
    known = known[tokens64.firsts(known)]
    return known, [(np.searchsorted(known, g), back, size) for g, back, size in zip(own, at, sizes, strict=True)]


def _by_shard_and_value(g: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ascending n-grams by shard and then value, and the shards in it."""
    shard = _shard(g, shards)
    order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    return order, shard[order]


def _distinct(texts: list[str | None], fit: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct n-grams, ascending; their counts in the texts of `fit`."""
    some, seen, counted = [np.zeros(0, np.int64)], [], []
    for begin, part in pieces(texts, PIECE):
        x = np.sort(grams(part)[0])
        some.append(x[tokens64.firsts(x)])
        if chosen := [t for i, t in enumerate(part, begin) if i in fit]:
            g, n = np.unique(grams(chosen)[0], return_counts=True)
            seen.append(g)
            counted.append(n)
    g = np.sort(np.concatenate(some))
    g = g[tokens64.firsts(g)]
    n = np.zeros(len(g), np.int64)
    for s, c in zip(seen, counted, strict=True):
        n[np.searchsorted(g, s)] += c
    return g, n


# --- requests and answers -----------------------------------------------------------------------------------------

_REQUEST = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("values", pa.binary())])
_REQUEST_SQL = "shard int, kind int, block long, grams binary, values binary"


def _requests(table: DataFrame, marks: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob, fit in zip(b.column("block").to_pylist(), b.column("blob"), b.column("fit").to_pylist(), strict=True):
                texts = blocked.rows(blob).column("_text").to_pylist()
                g, n = _distinct(texts, set(fit or ()))
                order, shard = _by_shard_and_value(g, shards)
                g, n = g[order], n[order]
                at = np.searchsorted(shard, np.arange(shards + 1))
                rows = [(s, 1, block, squeeze_ascending(g[at[s] : at[s + 1]].view(np.uint64)), squeeze(n[at[s] : at[s + 1]].astype(np.uint32))) for s in range(shards) if at[s] < at[s + 1]]
                if rows:
                    yield batch_of(_REQUEST, [*zip(*rows, strict=True)])

    return table.select("block", "blob").join(blocked.dealt(marks).hint("shuffle_hash"), "block", "left").select("block", "blob", "fit").mapInArrow(lean(run), _REQUEST_SQL)


def _by_shard(df: DataFrame) -> DataFrame:
    return df.repartition(blocked.buckets(df.sparkSession), "shard").sortWithinPartitions("shard", "kind")


def _counted(requests: DataFrame) -> DataFrame:
    """(g, c): every n-gram that some block asks for, and its trusted count."""
    schema = pa.schema([("g", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []

        def out() -> pa.RecordBatch:
            g, back = np.unique(np.concatenate(keys), return_inverse=True)
            return batch_of(schema, [g, np.bincount(back, np.concatenate(counts), len(g)).astype(np.int64)])

        for b in batches:
            for shard, g, n in zip(b.column("shard").to_pylist(), b.column("grams").to_pylist(), b.column("values").to_pylist(), strict=True):
                if shard != now and keys:
                    yield out()
                    keys, counts = [], []
                now = shard
                keys.append(expand_ascending(g).view(np.int64))
                counts.append(expand(n, np.uint32))
                if len(keys) > 64:  # keep what is held close to the number of distinct n-grams
                    k, back = np.unique(np.concatenate(keys), return_inverse=True)
                    keys, counts = [k], [np.bincount(back, np.concatenate(counts), len(k))]
        if keys:
            yield out()

    return _by_shard(requests).mapInArrow(lean(run), "g long, c long")


def _rounded(x: np.ndarray) -> np.ndarray:
    """Nearest numbers with 16 bits of mantissa: a byte less to travel, at an error of 1 / 131,072 at most."""
    return ((x.view(np.uint32) + np.uint32(0x40)) & np.uint32(0xFFFFFF80)).view(np.float32)


def _answers(requests: DataFrame, probabilities: DataFrame, shards: int) -> DataFrame:
    """(block, shard, values): the log-probabilities of each request, in its order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, p = b.column("g").to_numpy(), b.column("logp").to_numpy()
            shard = _shard(g, shards)
            order = np.lexsort((g, shard))
            at = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(s, 0, 0, squeeze_ascending(g[k].view(np.uint64)), squeeze(p[k].astype(np.float32))) for s in range(shards) if at[s] < at[s + 1] for k in [order[at[s] : at[s + 1]]]]
            if rows:
                yield batch_of(_REQUEST, [*zip(*rows, strict=True)])

    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, values, ready = None, [], [], None
        for b in batches:
            rows = []
            for shard, kind, block, g, v in zip(b.column("shard").to_pylist(), b.column("kind").to_pylist(), b.column("block").to_pylist(), b.column("grams").to_pylist(), b.column("values").to_pylist(), strict=True):
                if shard != now:
                    now, keys, values, ready = shard, [], [], None
                g = expand_ascending(g).view(np.int64)
                if kind == 0:
                    keys.append(g)
                    values.append(expand(v, np.float32))
                    continue
                if ready is None:
                    k, p = np.concatenate(keys), np.concatenate(values)
                    order = np.argsort(k)
                    ready = k[order], p[order]
                rows.append((block, shard, squeeze(_rounded(ready[1][np.searchsorted(ready[0], g)]))))
            if rows:
                yield batch_of(schema, [*zip(*rows, strict=True)])

    table = probabilities.mapInArrow(lean(pack), _REQUEST_SQL)
    return _by_shard(requests.withColumn("values", F.lit(None).cast("binary")).unionByName(table)).mapInArrow(lean(run), "block long, shard int, values binary")


# --- the model ----------------------------------------------------------------------------------------------------


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; kept inside (0, k] where those are too few."""
    n1, n2, n3, n4 = (max(1, n or 0) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(float(k), max(0.1, d)) for k, d in enumerate(raw, 1))


def probabilities(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, logp) of every n-gram in counted (g, c): interpolated modified Kneser-Ney; c = 0 takes back-off mass only."""
    seen = {order: counted.filter("c > 0")}
    asked = {order: counted.select("g")}
    for k in range(order - 1, 0, -1):
        suffix = F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")
        seen[k] = cut(seen[k + 1].select(suffix).groupBy("g").agg(F.count("*").alias("c")))
        asked[k] = asked[k + 1].select(suffix).distinct()
    lower = None
    for k in range(1, order + 1):
        n = seen[k].agg(*(F.sum(F.when(F.col("c") == i, 1).otherwise(0)) for i in (1, 2, 3, 4))).first()
        d1, d2, d3 = discounts(*n)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.call_function("shiftright", F.col("g"), F.lit(8)).alias("h")
        weights = seen[k].groupBy(context).agg(F.sum("c").alias("total"), F.sum(discount).alias("mass"))
        if k == order:
            rows = counted
        else:
            rows = asked[k].join(seen[k], "g", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        rows = rows.select("g", "c", context).join(weights, "h", "left")
        if lower is None:
            below = F.lit(1 / 256)
        else:
            rows = rows.withColumn("s", F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(lower.withColumnsRenamed({"g": "s", "p": "below"}), "s")
            below = F.col("below")
        own = F.when(F.col("c") > 0, F.col("c") - discount).otherwise(F.lit(0.0))
        lower = rows.select("g", F.when(F.col("total").isNull(), below).otherwise((own + F.col("mass") * below) / F.col("total")).alias("p"))
    return lower.select("g", F.log("p").alias("logp"))


# --- the operator -------------------------------------------------------------------------------------------------


class Judged:
    """blocks: the documents; losses: (block, pos, doc_id, lang, n_bytes, loss, word_loss, worst, calibrates,
    threshold, word_threshold, worst_threshold, kept)."""

    def __init__(self, docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> None:
        spark = docs.sparkSession
        self.docs, self.text_col = docs, text_col
        self.blocks = blocked.store(docs, text_col, id=(id_col, "long"), lang=(lang_col, "string"))
        shards = blocked.shards_for(self.blocks, SHARD_BYTES)
        held = self.blocks.select("block", F.posexplode("ids").alias("pos", "doc_id"))
        good = narrow(trusted, doc_id=(trusted.columns[0], "long")).distinct()
        marked = held.join(good, "doc_id", "left_semi").withColumn("calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0)
        marks = cut(marked.groupBy("block").agg(F.collect_list(F.when(~F.col("calibrates"), F.col("pos"))).alias("fit"), F.collect_list(F.when(F.col("calibrates"), F.col("pos"))).alias("test")))
        told, bigram_stats = words.bigrams(self.blocks, marks.select("block", "fit"))
        spoken, word_stats = words.unigrams(self.blocks, told)
        model = words.Model(bigram_stats, word_stats, discounts)
        # requests are made once for the counts and once for the answers, and never kept on disk
        requests = _requests(self.blocks, marks.select("block", "fit"), shards)
        counted = cut(_counted(requests), large=True)
        with recorded() as made:
            model_frame = probabilities(counted)
        model_table = cut(model_frame)
        made.drop(spark)
        discard(counted)
        schema = pa.schema([("block", pa.int64()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("loss", pa.float64()), ("word_loss", pa.float64()), ("worst", pa.float64()), ("calibrates", pa.bool_())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    got, says, spoke, test = (b.column(c)[k].as_py() or () for c in ("answers", "told", "spoken", "test"))
                    t, test = blocked.rows(b.column("blob")[k]), set(test)
                    texts = t.column("_text").to_pylist()
                    above, below, words_of = words.mixture(model, texts, says, spoke)
                    del says, spoke
                    g, found = ordered(texts)
                    order, _ = _by_shard_and_value(g, shards)
                    logp = np.empty(len(g), np.float32)
                    logp[order] = np.concatenate([np.zeros(0, np.float32), *(expand(a["values"], np.float32) for a in sorted(got, key=lambda a: a["shard"]))])
                    counts, losses, means, worst = [], [], [], []
                    at = 0
                    for (begin, part), (place, back, n) in zip(pieces(texts, PIECE), found, strict=True):
                        each, end = logp[place][back], at + int(words_of[begin : begin + len(part)].sum())
                        more, most = words.losses(part, n, each, lambda spelling: words.log_probabilities(above[at:end], below[at:end], spelling))  # noqa: B023
                        at = end
                        means += more
                        worst += most
                        total = np.concatenate(([0.0], np.cumsum(each, dtype=np.float64)))
                        ends = np.cumsum(n)
                        counts += n.tolist()
                        losses += [float(total[e - k] - total[e]) / k if k else None for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                    yield batch_of(schema, [pa.repeat(b.column("block")[k], len(texts)), np.arange(len(texts), dtype=np.int32), t.column("_id").combine_chunks(), t.column("_lang").combine_chunks(), counts, losses, means, worst, [i in test for i in range(len(texts))]])

        parts = []
        for k in range(ROUNDS):
            some = self.blocks.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == k)
            asked = _requests(some, marks.select("block", F.array().cast("array<int>").alias("fit")), shards)
            answers = blocked.gathered(_answers(asked, model_table, shards), "answers", "shard", "values")
            every = words.joined(some, told).join(spoken.hint("shuffle_hash"), "block", "left").join(answers.hint("shuffle_hash"), "block", "left").join(blocked.dealt(marks.select("block", "test")).hint("shuffle_hash"), "block", "left")
            parts.append(cut(words.with_blobs(some, every).select("block", "blob", "answers", "told", "spoken", "test").mapInArrow(lean(run), "block long, pos int, doc_id long, lang string, n_bytes long, loss double, word_loss double, worst double, calibrates boolean").hint("rebalance"), large=True))
            tidy(spark)
        scored = parts[0]
        for more in parts[1:]:
            scored = scored.unionByName(more)
        discard(*told, spoken, model_table)
        sample = scored.filter("calibrates and loss is not null")
        per = sample.groupBy("lang").agg(F.percentile_approx("loss", quantile, 10_000).alias("q"))
        everything = sample.agg(F.percentile_approx("loss", quantile, 10_000).alias("q")).first()["q"]
        self.thresholds = cut(per.select(F.col("lang").alias("own"), (F.col("q") + margin).alias("q")))
        limit = F.coalesce("q", F.lit(everything + margin if everything is not None else float("inf")))
        joined = scored.join(self.thresholds, F.col("lang").eqNullSafe(F.col("own")), "left").withColumn("threshold", limit).drop("own", "q")
        # word loss and worst passage: by language and length (doublings of bytes), by language, or of all
        length = F.floor(F.log2(F.greatest(F.col("n_bytes"), F.lit(1)))).cast("int")
        both = lambda q: F.struct(*((F.percentile_approx(c, quantile, 10_000) + margin).alias(c) for c in ("word_loss", "worst"))).alias(q)
        fine = cut(sample.groupBy(F.col("lang").alias("own"), length.alias("size")).agg(both("fine"), F.count("*").alias("n")).filter(F.col("n") >= LEAST).drop("n"))
        coarse = cut(sample.groupBy(F.col("lang").alias("own")).agg(both("coarse")))
        least = sample.agg(both("q")).first()["q"]
        joined = joined.join(fine, F.col("lang").eqNullSafe(F.col("own")) & (length == F.col("size")), "left").drop("own", "size")
        joined = joined.join(coarse, F.col("lang").eqNullSafe(F.col("own")), "left").drop("own")
        for c, name in (("word_loss", "word_threshold"), ("worst", "worst_threshold")):
            joined = joined.withColumn(name, F.coalesce(F.col("fine")[c], F.col("coarse")[c], F.lit(least[c] if least[c] is not None else float("inf"))))
        kept = (F.col("loss") <= F.col("threshold")) & (F.col("word_loss") <= F.col("word_threshold")) & (F.col("worst") <= F.col("worst_threshold"))
        self.losses = joined.select(*scored.columns, "threshold", "word_threshold", "worst_threshold", F.coalesce(kept, F.lit(False)).alias("kept"))

    def keep(self) -> DataFrame:
        """The rows that are kept, with all their columns."""
        return blocked.taken(self.blocks, self.losses.filter("kept").select("block", "pos"), self.docs, self.text_col)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that are labelled as of good quality and not toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")


def classify(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """(doc_id, lang, n_bytes, loss, perplexity, threshold, word_loss, word_threshold, worst, worst_threshold, kept) of
    every document."""
    j = Judged(docs, trusted, **options)
    return j.losses.select("doc_id", "lang", "n_bytes", "loss", F.exp("loss").alias("perplexity"), "threshold", "word_loss", "word_threshold", "worst", "worst_threshold", "kept")
