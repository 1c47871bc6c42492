"""Language-model scoring (operator 10): a gated recurrent model with a class-factored softmax, in numpy inside tasks.

Word counts of all training documents are gathered first; they give the base score, the model's vocabulary and its
classes (words of similar frequency), and the probability of every word beyond the vocabulary given that it is one.
The recurrent part is trained data-parallel by truncated backpropagation: in each round every training document is
read whole, window after window, with the state carried to its end; the tasks of a round start from common weights,
and the weights they end with are averaged in two levels. Scoring reads every document whole in the same way.

Counts are exact for any vocabulary: the `top_words` most frequent words are sent to all tasks, and the few tokens
beyond them are joined with the counts by word, as sums per document and word.

Tokens are white-space separated words with A-Z in lower case, then one end. Defined results: a null or empty text is
its end alone; a null doc_id isn't held out; repeated rows get equal results and count each; without training rows
all counts are 0; only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timespan.llm.common import shared_dir, single_thread, stored, table, utf8
from timespan.llm.warc import remove

END = b""
HIDDEN, CLASSES, CLASS_WORDS = 32, 32, 64
WINDOW, LANES, ROUNDS = 32, 64, 2
#: Classes of a window with at most so many rows share a product. Results don't depend on it.
FEW = 24
#: Words whose counts go to every task (about 150 bytes each in a task).
TOP_WORDS = 400_000
#: Of these, those that Arrow looks up; a table of all takes longer to make than some texts' words to look up.
FREQUENT_WORDS = 32_000


#: Bytes of the texts that are cut into tokens together, unless a text has more by itself.
TOGETHER = 2 << 20


def tokens(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """The tokens of all rows of some texts, one after the other, and where each text's begin and end; with the rows themselves."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, side="right")))
            rows, at = batch.slice(at, end - at), end
            # kernels of bytes in spite of their type; the space behind a text splits off the empty word, its end
            texts = pc.ascii_ltrim_whitespace(pc.ascii_lower(rows.column(column).view(pa.string())))
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(texts, "", " "))
            words = pc.ascii_split_whitespace(texts)
            yield rows, words.flatten().view(pa.binary()), np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(), dtype=np.int64)])


def _training(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, text."""
    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return docs.select(doc_id.alias("doc_id"), held.alias("held_out"), utf8().alias("text"))


def word_counts(training: DataFrame, flush: int = 200_000) -> DataFrame:
    """word, n over the texts; the end token is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(waiting).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for _, words, _ in tokens(batches):
            found = words.value_counts()
            waiting.append(pa.table([found.field(0), found.field(1)], ["word", "n"]))
            rows += len(found)
            if rows > 2 * flush:
                own = merged()
                if len(own) > flush:
                    yield from own.to_batches()
                    waiting, rows = [], 0
                else:
                    waiting, rows = [own], len(own)
        if waiting:
            yield from merged().to_batches()

    return training.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def softmax(logits: np.ndarray, picked: np.ndarray, slopes: bool) -> tuple[np.ndarray, np.ndarray]:
    """ln P of the picked place in each row; if wanted, the loss's slopes by the logits. logits is overwritten."""
    if len(logits) and max(logits.max(), -logits.min()) > 60:  # so exp neither overflows nor loses a row
        logits -= logits.max(1, keepdims=True)
    at = np.arange(len(logits)) * logits.shape[1] + picked
    flat = logits.ravel()
    out = flat[at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    out -= np.log(total)
    if slopes:
        logits *= np.reciprocal(total)[:, None]
        flat[at] -= 1
    return out, logits


def sums_by_id(ids: np.ndarray, rows: np.ndarray, often: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and the sum of the rows of each.

    The first rows of all ids are added, then the second ones and so on; an id's rows beyond `often` at once.
    """
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    counts = counts[distinct]
    first = np.cumsum(counts) - counts
    by_count = np.argsort(-counts, kind="stable")
    distinct, counts, first = distinct[by_count], counts[by_count], first[by_count]
    sums = rows.take(order[first], axis=0)
    more = np.searchsorted(-counts, -np.arange(often + 1)).tolist()  # ids with more than so many rows
    for k in range(1, often):
        if n := more[k]:
            sums[:n] += rows.take(order[first[:n] + k], axis=0)
    for k in range(more[often]):
        rest = rows.take(order[first[k] + often : first[k] + counts[k]], axis=0)
        sums[k] += np.ones(len(rest), rows.dtype) @ rest
    return distinct, sums


class Model:
    """A GRU over word ids. Id c * CLASS_WORDS + k is word k of class c; the last id is any other word."""

    names = ("x", "u", "b", "wc", "bc", "ww", "bw")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def start(cls, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 11) -> Model:
        """counts: of each id, from which the output starts at the words' frequencies."""
        v, rng = len(counts), np.random.default_rng(seed)
        by_class = (counts + 0.5).reshape(CLASSES, CLASS_WORDS)
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        return cls({
            "x": small(v, 3 * hidden), "u": small(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "wc": small(hidden, CLASSES) * 0.1,
            "bc": np.log(by_class.sum(1) / by_class.sum()).astype(np.float32), "ww": small(CLASSES, hidden, CLASS_WORDS) * 0.1,
            "bw": np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
        })

    def forward(self, ids: np.ndarray, edges: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs lanes side by side, the longest first; h becomes the state after each lane's last id.

        ids has those of all lanes at step 0, then at step 1 and so on; edges says where a step's begin. Returns of each id
        the state before it, both gates (z, r), the new state and the part of that by the state before.
        """
        n = h.shape[1]
        x, u, b = self.w["x"].take(ids, axis=0), self.w["u"], self.w["b"]
        # the gates' inputs are negated, as a sigmoid needs them
        of_gates, of_new = -u[:, : 2 * n], np.ascontiguousarray(u[:, 2 * n :])
        gates, new = -b[: 2 * n] - x[:, : 2 * n], x[:, 2 * n :] + b[2 * n :]
        before, own = np.empty((len(ids), n), h.dtype), np.empty((len(ids), n), h.dtype)
        add, multiply, matmul = np.add, np.multiply, np.matmul
        temp, change = np.empty((len(h), 2 * n), h.dtype), np.empty_like(h)
        for at, end in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            m = end - at
            state, g, s, now, t, c = before[at:end], gates[at:end], own[at:end], new[at:end], temp[:m], change[:m]
            state[:] = h[:m]
            matmul(state, of_gates, out=t)
            matmul(state, of_new, out=s)
            add(g, t, out=g)
            np.exp(g, out=g)
            add(g, 1, out=g)
            np.reciprocal(g, out=g)
            multiply(g[:, n:], s, out=c)
            add(now, c, out=now)
            np.tanh(now, out=now)
            np.subtract(state, now, out=c)
            multiply(c, g[:, :n], out=c)
            add(c, now, out=h[:m])
        return before, gates, new, own

    def losses(self, h: np.ndarray, ids: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P(id | state) of each row; with grad, sets the output's gradients there and returns that by the state."""
        of, n, w = ids // CLASS_WORDS, h.shape[1], self.w
        # rows by class: only the products are made class by class; a last 1 in each row stands for the biases
        order = np.argsort(of.astype(np.uint8), kind="stable")
        own = np.empty((len(ids), n + 1), h.dtype)
        own[:, :n], own[:, n] = h.take(order, axis=0), 1
        of, k = of[order], (ids % CLASS_WORDS)[order]
        to_class, to_word = np.concatenate([w["wc"], w["bc"][None]]), np.concatenate([w["ww"], w["bw"][:, None]], 1)
        edges = np.searchsorted(of, np.arange(CLASSES + 1))
        sizes = np.diff(edges)
        parts = [(c, slice(edges[c], edges[c + 1])) for c in np.flatnonzero(sizes > FEW)]
        # classes of few rows go together, each in `most` places of its own
        few = np.flatnonzero((sizes > 0) & (sizes <= FEW))
        most, rank = sizes[few].max(initial=0), np.zeros(CLASSES, np.int64)
        rank[few] = np.arange(len(few)) * most - edges[few]
        of_few = np.flatnonzero(((sizes > 0) & (sizes <= FEW))[of])
        place = rank[of[of_few]] + of_few

        def apart(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(few) * most, x.shape[1]), x.dtype)
            out[place] = x.take(of_few, axis=0)
            return out.reshape(len(few), most, x.shape[1])

        loss, p = softmax(own @ to_class, of, grad is not None)
        if grad is not None:
            slopes = own.T @ p
            grad["wc"], grad["bc"] = slopes[:n], slopes[n]
            back = p @ w["wc"].T
        logits = np.empty((len(ids), CLASS_WORDS), h.dtype)
        for c, rows in parts:
            np.matmul(own[rows], to_word[c], out=logits[rows])
        if len(few):
            own_few, to_few = apart(own), to_word[few]
            logits[of_few] = (own_few @ to_few).reshape(-1, CLASS_WORDS).take(place, axis=0)
        by_word, p = softmax(logits, k, grad is not None)
        loss += by_word
        out = np.empty_like(loss)
        out[order] = loss
        if grad is None:
            return out, None
        slopes = np.zeros_like(to_word)
        for c, rows in parts:
            np.matmul(own[rows].T, p[rows], out=slopes[c])
            back[rows] += p[rows] @ w["ww"][c].T
        if len(few):
            p_few = apart(p)
            slopes[few] = own_few.transpose(0, 2, 1) @ p_few
            back[of_few] += (p_few @ to_few[:, :n].transpose(0, 2, 1)).reshape(-1, n).take(place, axis=0)
        grad["ww"], grad["bw"] = slopes[:, :n], slopes[:, n]
        dh = np.empty_like(back)
        dh[order] = back
        return out, dh

    def window(self, ids: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss and gradients of one window (steps by lanes), backpropagated to its start and no further; the state after it.

        A lane's ids come first in it, then its places without one. What doesn't depend on the step before is computed for all steps at once.
        """
        n, longest = h.shape[1], np.argsort(-mask.sum(0), kind="stable")
        ids, mask, after = ids[:, longest], mask[:, longest], np.empty_like(h)
        ids, edges, state = ids[mask], np.concatenate([[0], np.cumsum(mask.sum(1))]), h[longest]
        before, gates, new, own = self.forward(ids, edges, state)
        after[longest] = state
        grad = {"x": np.zeros_like(self.w["x"])}
        loss, out = self.losses(before, ids, grad)
        z, r = gates[:, :n].copy(), gates[:, n:].copy()
        # the slopes of the gates' and the new state's inputs, as multiples of that of the state after the step
        rest = 1 - z
        by_new = 1 - new * new
        by_new *= rest
        rest *= z
        rest *= np.subtract(before, new, out=new)
        by_own = by_new * r
        own *= by_own
        own *= np.subtract(1, r, out=r)
        by_input = np.stack([rest, own, by_own], 1)
        later, du, slopes = np.zeros_like(h), np.empty_like(by_input), np.empty_like(new)
        flat, back, temp = du.reshape(-1, 3 * n), np.ascontiguousarray(self.w["u"].T), np.empty_like(h)
        steps = list(zip(edges.tolist(), edges[1:].tolist(), strict=False))
        for at, end in reversed(steps):
            m = end - at
            d, passed = slopes[at:end], later[:m]
            d[:] = passed
            np.multiply(d[:, None], by_input[at:end], out=du[at:end])
            np.matmul(flat[at:end], back, out=passed)
            np.multiply(d, z[at:end], out=temp[:m])
            passed += temp[:m]
            passed += out[at:end]
        grad["u"] = before.T @ flat
        slopes *= by_new
        flat[:, 2 * n :] = slopes
        words, sums = sums_by_id(ids, flat)
        grad["x"][words] = sums
        grad["b"] = np.ones(len(flat), h.dtype) @ flat
        return -float(loss.sum()), grad, after


class Trainer:
    """AdaGrad over a copy of the model."""

    def __init__(self, model: Model, rate: float = 0.1):
        self.model = Model({k: v.copy() for k, v in model.w.items()})
        self.seen = {k: np.full_like(v, 0.1) for k, v in model.w.items()}
        self.rate, self.updates = rate, 0

    def run(self, texts: Iterable[np.ndarray], lanes: int = LANES) -> None:
        """Trains on every window of every text of ids. A text keeps its lane and carries its state to its end; then the next one takes the lane."""
        waiting, open_, n = iter(texts), [], len(self.model.w["u"])
        h = np.zeros((0, n), np.float32)
        while open_ := open_ + [(text, 0) for text in islice(waiting, lanes - len(open_))]:
            h = np.concatenate([h, np.zeros((len(open_) - len(h), n), np.float32)])
            parts = [text[at : at + WINDOW] for text, at in open_]
            steps = max(map(len, parts))
            ids, mask = np.zeros((steps, len(parts)), np.int64), np.zeros((steps, len(parts)), bool)
            for k, own in enumerate(parts):
                ids[: len(own), k], mask[: len(own), k] = own, True
            _, grad, h = self.model.window(ids, mask, h)
            scale, rate = np.float32(1 / max(1, int(mask.sum())) ** 0.5), np.float32(self.rate)
            met = np.flatnonzero(np.bincount(ids.ravel()))
            for name, g in grad.items():
                # words that the window doesn't have get no gradient, so their weights stay
                all_seen, weights = self.seen[name], self.model.w[name]
                g, seen = (g.take(met, axis=0), all_seen.take(met, axis=0)) if name == "x" else (g, all_seen)
                g *= scale
                seen += g * g
                g *= rate
                g /= np.sqrt(seen)
                if name == "x":
                    all_seen[met] = seen
                    weights[met] -= g
                else:
                    weights -= g
            self.updates += 1
            left = [k for k, (text, at) in enumerate(open_) if at + WINDOW < len(text)]
            h, open_ = h[left], [(open_[k][0], open_[k][1] + WINDOW) for k in left]


def pack(model: Model) -> np.ndarray:
    return np.concatenate([model.w[k].ravel() for k in Model.names])


def unpack(flat: np.ndarray, like: Model) -> Model:
    out, at = {}, 0
    for k in Model.names:
        size = like.w[k].size
        out[k] = flat[at : at + size].reshape(like.w[k].shape).astype(np.float32)
        at += size
    return Model(out)


PIECE = 4096


def _mean(rows: pa.Table) -> pa.Table:
    """The weighted mean of one piece of the weights."""
    total, n = 0.0, 0.0
    for values, weight in zip(rows["values"], rows["n"].to_pylist(), strict=True):
        total, n = total + values.values.to_numpy() * weight, n + weight
    return pa.table({"piece": rows["piece"][:1], "part": pa.array([0], pa.int32()), "n": pa.array([n], pa.float64()), "values": pa.array([(total / max(n, 1e-9)).tolist()], pa.list_(pa.float64()))})


def train_round(training: DataFrame, model: Model, ids: dict[bytes, int]) -> Model:
    """One round: every task trains on all its documents, and the weights are averaged by the updates they took.

    So the weights, and with them the scores, depend on how the documents are dealt to tasks; base scores don't.
    """
    shared = training.sparkSession.sparkContext.broadcast((model, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        start, vocabulary = shared.value
        trainer, listed = Trainer(start), pa.array(list(vocabulary), pa.binary())
        places = np.array([*vocabulary.values(), len(start.w["x"]) - 1], np.int64)  # the last for all others

        def texts() -> Iterator[np.ndarray]:
            for _, words, edges in tokens(batches):
                found = places[pc.index_in(words, listed).fill_null(-1).to_numpy()]
                yield from (found[at:end] for at, end in zip(edges.tolist(), edges[1:].tolist(), strict=False))

        trainer.run(texts())
        if trainer.updates:
            flat, part = pack(trainer.model), TaskContext.get().partitionId() // 64
            pieces = [flat[k : k + PIECE].astype(np.float64).tolist() for k in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([part] * len(pieces), pa.int32()), pa.array([float(trainer.updates)] * len(pieces), pa.float64()), pa.array(pieces, pa.list_(pa.float64()))], ["piece", "part", "n", "values"])

    schema = "piece int, part int, n double, values array<double>"
    own = training.select("text").mapInArrow(run, schema)
    mean = own.groupBy("piece", "part").applyInArrow(_mean, schema).groupBy("piece").applyInArrow(_mean, schema)
    got = sorted(((r["piece"], r["values"]) for r in mean.collect()), key=lambda x: x[0])  # as large as the model
    return unpack(np.concatenate([np.array(v) for _, v in got]), model) if got else model


#: Places of tokens and padding that texts side by side take at most, unless a text has more by itself (4 bytes each).
PADDED = 2_000_000
#: Steps whose products are made together. Scores don't depend on it.
SCORED_STEPS = 16


def score_texts(model: Model, texts: list[np.ndarray], lanes: int = 256) -> np.ndarray:
    """log10 P of each sequence of ids. Texts of similar length go side by side, fewer of them the longer they are; the state is carried to the end of each."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    while order:
        beside = max(1, min(lanes, PADDED // max(1, len(texts[order[0]]))))
        group, order = order[:beside], order[beside:]
        lengths = np.array([len(texts[k]) for k in group])
        ids = np.zeros((lengths[0], len(group)), np.int32)
        for lane, k in enumerate(group):
            ids[: lengths[lane], lane] = texts[k]
        # the longest first: the lanes that still have tokens at a step are the first ones
        left = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        h = np.zeros((len(group), len(model.w["u"])), np.float32)
        own = np.zeros(len(group))
        for at in range(0, lengths[0], SCORED_STEPS):
            active = left[at : at + SCORED_STEPS]
            mask = np.arange(len(group)) < active[:, None]
            targets = ids[at : at + SCORED_STEPS][mask]
            states = model.forward(targets, np.concatenate([[0], np.cumsum(active)]), h)[0]
            loss, _ = model.losses(states, targets)
            own += np.bincount(np.nonzero(mask)[1], loss, len(group))
        out[group] = own
    return out / np.log(10)


#: Tokens that a task scores side by side.
SCORED_TOKENS = 600_000


def score_documents(docs: DataFrame, top_words: int = TOP_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, rows = docs.sparkSession, _training(docs)
    training = rows.filter("NOT held_out")
    folder = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    word_counts(training).write.parquet(folder)
    counts = spark.read.parquet(folder)
    n_all, v_all = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    top = counts.orderBy(F.desc("n"), "word").limit(top_words).toArrow().combine_chunks()
    words, numbers = top.column(0).to_pylist(), top.column(1).to_pylist()
    size = CLASSES * CLASS_WORDS
    ids = {w: k for k, w in enumerate(words[: size - 1])}
    seen = np.zeros(size)
    seen[: len(ids)] = numbers[: len(ids)]
    seen[-1] = max(1, n_all - sum(numbers[: len(ids)]))
    model = Model.start(seen)  # ids go by frequency, so a class holds words of similar frequency
    for _ in range(ROUNDS):
        model = train_round(training, model, ids)
    n_rest, v_rest = n_all - int(sum(numbers[: len(ids)])), v_all - len(ids)
    shared = spark.sparkContext.broadcast((model, pa.array(words, pa.binary()), np.array(numbers, np.int64), len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        fitted, listed, often, inside = shared.value
        frequent = listed[:FREQUENT_WORDS]
        place = {w: k for k, w in enumerate(listed[FREQUENT_WORDS:].to_pylist(), FREQUENT_WORDS)}
        logs, other, first, at = np.append(np.log10(often + 1.0), 0), len(fitted.w["x"]) - 1, TaskContext.get().partitionId() << 33, 0

        def summed(parts: pa.RecordBatch, words: pa.Array, edges: np.ndarray) -> tuple[list[pa.Array], list[pa.Array], list[np.ndarray]]:
            """Columns of some documents, of their words that aren't listed, and the ids of each document."""
            own = pc.index_in(words, frequent).fill_null(-1).to_numpy().astype(np.int64)
            missing = np.flatnonzero(own < 0)
            own[missing] = [place.get(w, -1) for w in words.take(pa.array(missing)).to_pylist()]
            missing = missing[own[missing] < 0]
            modelled, total = (own >= 0) & (own < inside), lambda x: np.add.reduceat(x, edges[:-1])  # a document has a token at least
            log, rows, lengths = logs[own], np.arange(first + at, first + at + len(parts)), np.diff(edges)
            documents = [
                pa.array(rows), parts.column(0), parts.column(1), pa.array(lengths), pa.array(total((own >= 0).astype(np.int64))), pa.array(total(log)),
                pa.array(total(np.where(modelled, 0, log))), pa.array(lengths - total(modelled.astype(np.int64))),
            ]
            rare = pa.table([pa.array(np.repeat(rows, lengths)[missing]), words.take(pa.array(missing))], ["row", "word"]).group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            ids = np.where(modelled, own, other)
            return documents, [rare.column(name).combine_chunks() for name in ("row", "word", "count_all")], [ids[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]

        def flush(parts: list[tuple[list[pa.Array], list[pa.Array], list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            gru = score_texts(fitted, [ids for _, _, own in parts for ids in own])
            documents, (row, word, tf) = ([pa.concat_arrays(x) for x in zip(*columns, strict=True)] for columns in ([d for d, _, _ in parts], [r for _, r, _ in parts]))
            none, zero, none_held = pa.nulls(len(row), pa.int64()), np.zeros(len(row), np.int64), pa.nulls(len(row), pa.bool_())
            names = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "rest_logs", "n_rest", "gru", "word", "tf"]
            yield pa.RecordBatch.from_arrays([*documents, pa.array(gru), pa.array([b"\0%d" % x for x in documents[0].to_pylist()], pa.binary()), pa.array(np.zeros(len(gru), np.int64))], names)
            if len(row):
                zeros = [pa.array(zero), pa.array(zero), pa.array(zero.astype(float)), pa.array(zero.astype(float)), pa.array(zero), pa.array(zero.astype(float))]
                yield pa.RecordBatch.from_arrays([row, none, none_held, *zeros, word, tf], names)

        waiting, held = [], 0
        for parts, words, edges in tokens(batches, 2):
            waiting.append(summed(parts, words, edges))
            at, held = at + len(parts), held + len(words)
            if held > SCORED_TOKENS:
                yield from flush(waiting)
                waiting, held = [], 0
        if waiting:
            yield from flush(waiting)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, rest_logs double, n_rest long, gru double, word binary, tf long"
    found = rows.select("doc_id", "held_out", "text").mapInArrow(run, schema)
    joined = found.join(counts.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    rare_log = F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("known") + F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + rare_log).alias("logs"), F.sum(F.col("rest_logs") + rare_log).alias("rest_logs"), F.sum("n_rest").alias("n_rest"), F.sum("gru").alias("gru"),
    )
    result = stored(summed.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * float(np.log10(n_all + v_all + 1))).alias("base_score"),
        (F.col("gru") + F.col("rest_logs") - F.col("n_rest") * float(np.log10(n_rest + v_rest + 1))).alias("score"),
    ))
    remove(spark, folder)
    return result


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))

