"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned embedding; filters of ``WIDTH`` bytes slide over the whole text. The
text is cut into blocks of ``BLOCK`` bytes, a chunk is two adjacent blocks, so chunks overlap
by half and cover every byte. A filter's answer in a chunk is its largest one; the rectified
answers are averaged over all chunks and combined into one probability. For scoring,
embedding and filter are multiplied out to one table per filter byte.

It is trained on the driver from a bounded sample of labelled rows (``SAMPLE_ROWS`` rows and
``SAMPLE_BYTES`` bytes, in hash order, held-out rows never among them).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklode.llm.common import octets, slices, table, text_buffer, tidy

WIDTH, FILTERS, EMBED, BLOCK = 5, 24, 8, 128
SAMPLE_ROWS, SAMPLE_BYTES = 2_500, 16 << 20
LONG = 64
EPOCHS, BATCH, RATE, SEED, SHORTENED = 12, 16, 0.01, 7, 0.15
CUT = 0.3
_STEP_BLOCKS = 256


class Padded:
    """Texts behind each other, each padded with zero bytes to whole blocks."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        # At least WIDTH - 1 zeros: a filter that starts in a text ends in its padding.
        self.blocks = -(-(sizes + WIDTH - 1) // BLOCK)
        self.first = np.r_[0, np.cumsum(self.blocks)]
        total = int(self.first[-1]) * BLOCK
        self.bytes = np.zeros(total + WIDTH, np.uint8)
        for at, start, end in zip((self.first[:-1] * BLOCK).tolist(), offsets[:-1].tolist(),
                                  offsets[1:].tolist()):
            self.bytes[at:at + end - start] = flat[start:end]
        self.stop = self.first[1:] * BLOCK   # ends of the padded texts


class ByteNet:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.params = {
            "embed": r.normal(0, 1, (256, EMBED)),
            "filters": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)),
            "bias": np.zeros(FILTERS), "weights": r.normal(0, 0.3, FILTERS),
            "offset": np.zeros(1)}
        self.tables = None

    def _tables(self):
        return np.einsum("be,wef->wbf", self.params["embed"], self.params["filters"]
                         ).astype(np.float32)

    def _block_maxima(self, texts: Padded, tables, where: bool):
        """Largest answer of each filter per block, and its place if asked for."""
        total = int(texts.first[-1])
        best = np.empty((total, FILTERS), np.float32)
        place = np.empty((total, FILTERS), np.int64) if where else None
        for at in range(0, total, _STEP_BLOCKS):
            n = min(_STEP_BLOCKS, total - at)
            start, size = at * BLOCK, n * BLOCK
            answers = tables[0].take(texts.bytes[start:start + size], axis=0)
            for j in range(1, WIDTH):
                answers += tables[j].take(texts.bytes[start + j:start + j + size], axis=0)
            # No filter reaches over the padding into the next text.
            inside = texts.stop[(texts.stop > start) & (texts.stop <= start + size)] - start
            for back in range(1, WIDTH):
                answers[inside - back] = -np.inf
            answers = answers.reshape(n, BLOCK, FILTERS)
            if where:
                peak = answers.argmax(axis=1)
                best[at:at + n] = np.take_along_axis(answers, peak[:, None], 1)[:, 0]
                place[at:at + n] = peak + (np.arange(at, at + n) * BLOCK)[:, None]
            else:
                best[at:at + n] = answers.max(axis=1)
        return best, place

    @staticmethod
    def _chunks(texts: Padded):
        """First and second block of every chunk (the same one in a text of one block)."""
        first = np.arange(int(texts.first[-1]))
        owner = np.repeat(np.arange(len(texts.blocks)), texts.blocks)
        last = first == texts.first[owner + 1] - 1
        keep = ~last | (texts.blocks[owner] == 1)
        first, owner, last = first[keep], owner[keep], last[keep]
        return first, np.where(last, first, first + 1), owner

    def _combine(self, texts: Padded, best):
        one, two, owner = self._chunks(texts)
        raw = np.maximum(best[one], best[two]) + self.params["bias"]
        starts = np.searchsorted(owner, np.arange(len(texts.blocks)))
        count = np.bincount(owner, minlength=len(texts.blocks))[:, None]
        features = np.add.reduceat(np.maximum(raw, 0), starts, axis=0) / count
        logit = features @ self.params["weights"] + self.params["offset"][0]
        return logit, features, raw, (one, two, owner, count)

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        if self.tables is None:
            self.tables = self._tables()
        texts = Padded(flat, offsets)
        logit = self._combine(texts, self._block_maxima(texts, self.tables, False)[0])[0]
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))

    def _gradients(self, texts: Padded, labels: np.ndarray) -> dict:
        tables = self._tables()
        best, place = self._block_maxima(texts, tables, True)
        logit, features, raw, (one, two, owner, count) = self._combine(texts, best)
        slope = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels) / len(labels)
        p = self.params
        back = np.where(raw > 0, (slope[:, None] * p["weights"] / count)[owner], 0)
        at = np.where(best[one] >= best[two], place[one], place[two])
        filter_of = np.broadcast_to(np.arange(FILTERS), at.shape)
        table_slope = np.zeros((WIDTH, 256, FILTERS))
        for j in range(WIDTH):
            np.add.at(table_slope[j], (texts.bytes[at + j], filter_of), back)
        return {"weights": features.T @ slope, "offset": np.array([slope.sum()]),
                "bias": back.sum(axis=0),
                "embed": np.einsum("wbf,wef->be", table_slope, p["filters"]),
                "filters": np.einsum("wbf,be->wef", table_slope, p["embed"])}

    @staticmethod
    def _shortened(text: bytes, r) -> bytes:
        """Now and then a short piece of the text: short texts are rare among the rows."""
        if r.random() >= SHORTENED or len(text) < 8:
            return text
        start = int(r.integers(0, len(text) - 4))
        return text[start:start + int(r.integers(4, 120))]

    def train(self, texts: list[bytes], labels, epochs: int = EPOCHS) -> "ByteNet":
        """Adam on the cross entropy; with no rows the scores stay at one half."""
        labels = np.asarray(labels, float)
        if not len(labels):
            self.params["weights"][:] = 0
            return self
        r = np.random.default_rng(SEED)
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        step, total = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                chosen = order[at:at + BATCH]
                part = [self._shortened(texts[i], r) for i in chosen]
                flat = np.frombuffer(b"".join(part), np.uint8)
                offsets = np.r_[0, np.cumsum([len(t) for t in part])].astype(np.int64)
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, g in self._gradients(Padded(flat, offsets), labels[chosen]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.params[k] -= rate * (mean[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
        self.tables = self._tables()
        return self


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS,
        size: int = SAMPLE_BYTES) -> ByteNet:
    """Trains on at most ``rows`` labelled, not held-out rows of ``size`` bytes together.

    The rows are the first ones in the order of a hash of doc_id, whole texts always. One
    that does not fit any more is left out by itself; texts of more than a 1/``LONG`` of
    ``size`` come after all others, so a few long ones do not take the place of many. Rows
    without a label or doc_id are not used. Fails if no labelled row fits.
    """
    marked = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
                           & ~held_out("doc_id"))
              .select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
              .limit(rows))
    # At most ``rows`` short rows, so they can go to every task.
    texts = (docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
             .withColumn("tag", F.xxhash64("text")))
    # Equal rows are one with a number, so what comes to the driver is bounded.
    key = ["doc_id", "quality", "tag"]
    order = [F.xxhash64("doc_id"), *key]
    sized = (texts.select(*key, octets().alias("n")).groupBy(*key, "n")
             .agg(F.count(F.lit(1)).alias("times")).orderBy(*order).limit(rows).collect())
    chosen, left, room = {}, size, rows
    for r in sorted(sized, key=lambda r: r.n * LONG > size):   # stable: hash order stays
        times = min(r.times, left // max(r.n, 1), room)
        if times:
            chosen[r.doc_id, r.quality, r.tag] = times
            left, room = left - times * r.n, room - times
    if not chosen:
        if sized:
            raise ValueError(f"none of {len(sized)} labelled texts fits into {size} bytes")
        return ByteNet().train([], [])
    ids = list({i for i, _, _ in chosen})
    found = (texts.where(F.col("doc_id").isin(ids)
                         & F.col("tag").isin(list({t for _, _, t in chosen})))
             .dropDuplicates(key).orderBy(*order).collect())
    found = [r for r in found for _ in range(chosen.get((r.doc_id, r.quality, r.tag), 0))]
    return ByteNet().train([(r.text or "").encode() for r in found],
                           [r.quality for r in found])


def score_quality(docs: DataFrame, net: ByteNet, cut: float = CUT,
                  keep=("doc_id",)) -> DataFrame:
    """The ``keep`` columns, score and predicted (1 from ``cut`` on) of every row.

    Only the text is an input. NULL counts as the empty text, which has a score too.
    Repeated rows stay; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)   # a fixed number of weights
    keep = list(keep)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    # A text that is kept is sent to the tasks once.
    at = keep.index("text") if "text" in keep else len(keep)
    extra = [] if "text" in keep else [F.col("text").alias("whole text")]

    def run(batches):
        for b in slices(batches, at, 1 << 20):
            scores = shared.value.scores(*text_buffer(b.column(at)))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))]
                + [pa.array(scores, pa.float64()),
                   pa.array((scores >= cut).astype(np.int32), pa.int32())],
                names=[*keep, "score", "predicted"])

    return docs.select(*keep, *extra).mapInArrow(
        tidy(run), kinds + "score double, predicted int")


def op7_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, net).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
