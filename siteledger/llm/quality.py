"""Quality scores by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters look at every window of ``WIDTH`` bytes at a stride of ``STRIDE``; their greatest
response in each overlapping chunk of ``CHUNK`` bytes (half a chunk apart) goes through a hidden layer, whose greatest
response over all chunks of the document is combined into one probability. The pooling covers whole texts of any length,
and the maxima say both what a chunk has and, by what stays low, what variety it lacks.

Training goes through the same maxima, so gradients touch only the windows that won.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.chunks import in_batches

WIDTH, STRIDE, CHUNK = 8, 4, 512
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: The network is fitted on at most so many labelled rows, and so many bytes of text; rows are picked by seeded hash, and of
#: texts longer than their share of the bytes a seeded choice of chunks.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 16 << 20
EPOCHS, BATCH, RATE, SEED = 14, 32, 3e-3, 11
_HALF = CHUNK // 2
_GROUP = 1 << 19


def _halves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of ``_HALF`` + ``STRIDE`` bytes, half a chunk apart, and the number of rows of each text.

    A text is padded with zeros to whole rows, an empty one has a row of zeros; each row ends with the first bytes of
    the next, so that no window is lost between them.
    """
    counts = np.array([max(1, -(-len(t) // _HALF)) for t in texts])
    data = np.zeros(int(counts.sum()) * _HALF + STRIDE, np.uint8)
    for at, t in zip((np.cumsum(counts) - counts) * _HALF, texts, strict=True):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(data, _HALF + STRIDE)[::_HALF].copy()
    rows[np.cumsum(counts) - 1, _HALF:] = 0
    return rows, counts


@dataclass
class Network:
    embed: np.ndarray  # byte x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    filter_bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray

    @classmethod
    def new(cls, share: float) -> Network:
        rng = np.random.default_rng(SEED)
        draw = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
        return cls(
            draw(256, EMBED, by=0.5), draw(WIDTH * EMBED, FILTERS, by=(2 / (WIDTH * EMBED)) ** 0.5), np.zeros(FILTERS, np.float32),
            draw(FILTERS, HIDDEN, by=(2 / FILTERS) ** 0.5), np.zeros(HIDDEN, np.float32), draw(HIDDEN, by=0.1), np.array([np.log(share / (1 - share))], np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.filter_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def responses(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter in each half chunk, and the window it came from."""
        blocks = self.embed[rows].reshape(len(rows), -1, STRIDE * EMBED)
        near, far = self.filters[: STRIDE * EMBED], self.filters[STRIDE * EMBED :]
        r = blocks[:, :-1] @ near + blocks[:, 1:] @ far
        best = r.argmax(axis=1)
        return np.take_along_axis(r, best[:, None], axis=1)[:, 0] + self.filter_bias, best

    def forward(self, texts: list[bytes]):
        rows, counts = _halves(texts)
        top, best = self.responses(rows)
        last = np.cumsum(counts) - 1
        other = np.minimum(np.arange(len(rows)) + 1, len(rows) - 1)
        other[last] = last
        second = top[other] > top
        pooled = np.where(second, top[other], top)
        hidden = pooled @ self.hidden + self.hidden_bias
        first = last - counts + 1
        peak = np.maximum.reduceat(hidden, first, axis=0)
        return rows, counts, best, other, second, pooled, hidden, peak

    def logits(self, texts: list[bytes]) -> np.ndarray:
        peak = self.forward(texts)[-1]
        return np.maximum(peak, 0) @ self.out + self.out_bias[0]

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        rows, counts, best, other, second, pooled, hidden, peak = self.forward(texts)
        active = np.maximum(peak, 0)
        p = 1 / (1 + np.exp(-(active @ self.out + self.out_bias[0])))
        d = ((p - labels) / len(labels)).astype(np.float32)
        d_peak = d[:, None] * self.out * (peak > 0)
        owner = np.repeat(np.arange(len(counts)), counts)
        # The row whose hidden value won, for each text and hidden unit.
        winner = np.full(peak.shape, -1, np.int64)
        row, unit = np.nonzero(hidden >= peak[owner])
        winner[owner[row], unit] = row
        d_hidden = np.zeros_like(hidden)
        np.add.at(d_hidden, (winner, np.arange(HIDDEN)[None]), d_peak)
        d_pooled = d_hidden @ self.hidden.T
        used, f = np.nonzero(d_pooled)
        source = np.where(second[used, f], other[used], used)
        at = best[source, f] * STRIDE
        window = rows[source[:, None], at[:, None] + np.arange(WIDTH)]
        value = d_pooled[used, f]
        x = self.embed[window].reshape(len(used), -1)
        d_filters = np.zeros_like(self.filters)
        for k in range(FILTERS):
            mine = f == k
            d_filters[:, k] = value[mine] @ x[mine]
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, window.ravel(), (self.filters.T[f] * value[:, None]).reshape(-1, EMBED))
        return [d_embed, d_filters, np.bincount(f, value, FILTERS), pooled.T @ d_hidden, d_hidden.sum(0), active.T @ d, np.array([d.sum()])]


def train(texts: list[bytes], labels: np.ndarray) -> Network:
    """A network fitted by Adam on shuffled batches; texts of like length go together, so that a batch is small."""
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98))
    net, rng = Network.new(share), np.random.default_rng(SEED)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for p, g, m, v in zip(net.parameters(), net.gradients([texts[i] for i in part], labels[part]), first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        if group and len(t) > 2 * _GROUP:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
        if size >= _GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1; a long text is scored in spans whose hidden peaks are pooled, so memory stays bounded."""
    logits = []
    for group in _groups(texts):
        if len(group) == 1 and len(group[0]) > 2 * _GROUP:
            text, peak = group[0], None
            for at in range(0, len(text), _GROUP):
                own = net.forward([text[at : at + _GROUP + _HALF]])[-1]
                peak = own if peak is None else np.maximum(peak, own)
            logits.append(np.maximum(peak, 0) @ net.out + net.out_bias[0])
        else:
            logits.append(net.logits(group))
    return 1 / (1 + np.exp(-np.concatenate(logits).astype(np.float64))) if logits else np.empty(0)


def share_of_bytes(sizes: list[int], total: int) -> int:
    """The greatest length to which texts of these sizes are cut so that they have ``total`` bytes at most."""
    left = total
    for i, size in enumerate(sorted(sizes)):
        even = left // (len(sizes) - i)
        if size > even:
            return even
        left -= size
    return max(sizes, default=0)


def _excerpts(most: int):
    """Rows (doc_id, text, quality, seed) with texts of ``most`` bytes at most: of longer ones seeded chunks, in their order."""

    def cut_down(batches):
        for batch in batches:
            texts = []
            for text, seed in zip(batch.column("text").to_pylist(), batch.column("seed").to_pylist(), strict=True):
                if len(text) > most:
                    n = max(1, most // CHUNK)
                    chunks = np.sort(np.random.default_rng(seed % 2**64).choice(-(-len(text) // CHUNK), n, replace=False))
                    text = b"".join(text[k * CHUNK : (k + 1) * CHUNK] for k in chunks.tolist())[:most]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()), batch.column("quality"), batch.column("seed")], ["doc_id", "text", "quality", "seed"])

    return cut_down


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """A network fitted on labelled rows of ``docs`` where ``learn`` holds: at most ``SAMPLE_ROWS`` and ``sample_bytes``.

    Rows are picked in the order of a seeded hash of doc_id; ``labels`` has doc_id and quality, NULL qualities are left
    out, and of several labels of one doc_id the least counts. If the texts have more than ``sample_bytes``, the longest
    give seeded chunks only, all to one length; no row goes.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    chosen = known.where(learn).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").withColumn("seed", F.xxhash64("doc_id", "text"))
    # Over a sample of bounded size.
    picked = [F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "seed"]
    sizes = rows.select("doc_id", "seed", F.octet_length("text").alias("size")).orderBy(*picked).limit(2 * SAMPLE_ROWS).select("size").collect()
    most = share_of_bytes([r["size"] for r in sizes], sample_bytes)
    few = rows.select("doc_id", "text", F.col("quality").cast("long").alias("quality"), "seed").mapInArrow(_excerpts(most), "doc_id long, text binary, quality long, seed long")
    table = few.orderBy(*picked, "text").limit(2 * SAMPLE_ROWS).select("text", "quality").toArrow()
    return train(table.column("text").to_pylist(), table.column("quality").to_numpy().astype(np.float32))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` (with text) and score and predicted for each row, in one pass; NULL and empty texts are scored as empty.

    Columns of ``docs`` that are called score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches):
        for batch in batches:
            p = score_texts(shared.value, [(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return in_batches(docs, score, ", score double, predicted int")
