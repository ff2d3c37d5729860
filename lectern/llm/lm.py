"""A hidden Markov language model: Baum-Welch over all training documents, exact likelihood of every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_pass, crc_mod, discard, hashed_sample, release, staged
from lectern.session import ship

#: Latent states, passes over all training documents, and the rounds before them on a sample that give these a start.
STATES, PASSES, SAMPLE_DOCS, SAMPLE_ROUNDS = 8, 3, 600, 25
#: A word that makes up at least one in OWN of the training tokens has its own emissions (so at most OWN words do); the others share ENDINGS classes.
OWN, ENDINGS = 1 << 17, 4096
#: Tokens of a block of documents, whose words are looked up together, about.
BLOCK_TOKENS = 1 << 21
#: Training cuts sequences into pieces of so many tokens; scoring cuts long ones too, but chains the pieces exactly.
PIECE, LONG = 256, 1024
#: Tokens that are worked on at once.
AT_ONCE = 1 << 18
#: Pseudo-counts that pull a state's emissions to those of all tokens, and of each transition; how likely a state stays at first.
PULL, TRANSITION, STICKY = 200.0, 1.0, 0.8

END = ""
BLOCKS = "block long, words array<string>, counts array<int>, ids array<long>, held array<boolean>, sizes array<int>, codes binary"
CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary"
SUMS = "class int, " + ", ".join(f"s{k} double" for k in range(STATES))
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ---- words of blocks of documents ----


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers compressed, the bytes of equal place side by side."""
    raw = np.ascontiguousarray(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def restored(raw, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


class Codes(dict):
    """Numbers of words in the order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _blocks(batches):
    """Documents as numbers of words, a block at a time, with the block's words and how often its training documents hold them."""
    made = TaskContext.get().partitionId() << 32
    codes, ids, held, parts, total = Codes(), [], [], [], 0

    def block():
        sizes = np.array([len(p) for p in parts], np.int32)
        flat = np.concatenate(parts)
        train = np.bincount(flat[np.repeat(~np.array(held, bool), sizes)], minlength=len(codes)).astype(np.int32)
        words = [w.decode("utf-8", "replace") for w in codes]
        cells = [[made], [words], [train], [ids], [held], [sizes], [squeezed(flat)]]
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["block", "words", "counts", "ids", "held", "sizes", "codes"])

    for batch in batches:
        for doc, out, text in zip(*(batch.column(n) for n in ("doc_id", "held_out", "text")), strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower().split()  # bytes: A-Z and the six blanks only
            words.append(b"")
            parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
            ids.append(doc.as_py())
            held.append(out.as_py())
            total += len(words)
            if total >= BLOCK_TOKENS:
                yield block()
                codes, ids, held, parts, total = Codes(), [], [], [], 0
                made += 1
    if parts:
        yield block()


class Vocabulary:
    """Counts of all training words, in a table; how many there are, and which have emissions of their own."""

    def __init__(self, blocks: DataFrame) -> None:
        spark = blocks.sparkSession
        pairs = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("p")).select(F.col("p.words").alias("word"), F.col("p.counts").alias("c"))
        counts = staged(pairs.where("c > 0").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
        self.tokens, self.types = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
        frequent = counts.where(F.col("c") * OWN >= self.tokens).orderBy(F.desc("c"), "word").collect()  # OWN rows at most
        self.own = np.array([r["c"] for r in frequent], np.float64)
        numbers = spark.createDataFrame([(r["word"], k) for k, r in enumerate(frequent)], "word string, own int")
        classed = counts.join(F.broadcast(numbers), "word", "left").select("word", "c", F.coalesce("own", self.ending()).alias("class"))
        self.table = staged(classed, "lm-words")
        discard(counts)
        self.shared = np.zeros((ENDINGS, 2))
        for r in self.table.where(F.col("class") >= len(self.own)).groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # ENDINGS rows
            self.shared[r["class"] - len(self.own)] = r["c"], r["n"]

    def ending(self):
        """The class of a word without emissions of its own: by its last three characters."""
        return (F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(ENDINGS)) + len(self.own)).cast("int")

    @property
    def classes(self) -> np.ndarray:
        """Tokens of each class, and one more."""
        return np.concatenate([self.own, self.shared[:, 0]]) + 1


def _coder(words: Vocabulary):
    """Per document of a block: its classes, what the base model gives, and the shares of words in their classes."""
    tokens, types, own, shared = words.tokens, words.types, len(words.own), words.shared.sum(1) + 1

    def code(block: pa.Table, found: pa.Table) -> pa.Table:
        pos = found.column("pos").to_numpy()
        c, cls = np.zeros(len(pos)), np.zeros(len(pos), np.int32)
        c[pos], cls[pos] = found.column("c").to_numpy(), found.column("class").to_numpy()
        rare = cls >= own
        share = np.where(rare, np.log10((c + 1) / shared[np.where(rare, cls - own, 0)]), 0.0)
        logs = np.log10(c + 1)
        out = {n: [] for n in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes")}
        for k in range(block.num_rows):
            sizes = np.asarray(block.column("sizes")[k].values)
            codes = restored(block.column("codes")[k].as_buffer(), int(sizes.sum()))
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            out["doc_id"] += block.column("ids")[k].as_py()
            out["held_out"] += block.column("held")[k].as_py()
            out["n_tokens"] += sizes.tolist()
            out["n_known"] += np.add.reduceat((c > 0)[codes].astype(np.int64), begin).tolist()
            out["base_score"] += (np.add.reduceat(logs[codes], begin) - sizes * np.log10(tokens + types + 1)).tolist()
            out["within"] += np.add.reduceat(share[codes], begin).tolist()
            mapped = cls[codes]
            out["classes"] += [squeezed(mapped[b : b + s]) for b, s in zip(begin, sizes, strict=True)]
        release()
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("within", pa.float64()), ("classes", pa.binary())]))

    return code


def coded(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Documents as classes of words. A word is looked up once a block, by a join with the counts of all words."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    blocks = staged(arrow_pass(base, _blocks, BLOCKS), "lm-blocks")
    words = Vocabulary(blocks)
    pairs = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    found = pairs.join(words.table, "word", "left").select(F.col("block").alias("home"), "pos", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", words.ending()).alias("class"))
    texts = blocks.select("block", "ids", "held", "sizes", "codes")
    out = staged(texts.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(_coder(words), CODED), "lm-coded")
    discard(blocks)
    discard(words.table)
    return out, words


# ---- the model ----


class Model:
    """Start and transition probabilities, and emissions by class and state."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emissions: np.ndarray) -> None:
        self.start, self.moves, self.emissions = start, moves, emissions

    @classmethod
    def first(cls, overall: np.ndarray) -> Model:
        """States that stay, with emissions moved at random from those of all tokens; fixed seed."""
        noise = np.exp(np.random.default_rng(12).standard_normal((len(overall), STATES)))
        emissions = (overall / overall.sum())[:, None] * noise
        moves = np.full((STATES, STATES), (1 - STICKY) / (STATES - 1)) + np.eye(STATES) * (STICKY - (1 - STICKY) / (STATES - 1))
        return cls(np.full(STATES, 1 / STATES), moves, emissions / emissions.sum(0))

    @classmethod
    def fitted(cls, sums: np.ndarray, overall: np.ndarray) -> Model:
        """From expected counts: a row for each class, then STATES rows of transitions and one of starts."""
        emitted, moves, start = sums[: len(overall)], sums[len(overall) : -1] + TRANSITION, sums[-1] + TRANSITION
        emitted = emitted + PULL * (overall / overall.sum())[:, None]
        return cls(start / start.sum(), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(0))


class Layout:
    """Sequences side by side, longest first: the tokens of a step are neighbours, and steps have fewer and fewer of them."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        steps = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        flat = np.concatenate([sequences[k] for k in self.order])
        self.classes = flat[np.argsort(steps, kind="stable")]
        self.active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        self.edges = np.concatenate([[0], np.cumsum(self.active)])


def expected(model: Model, sequences: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, float]:
    """Baum-Welch counts of the sequences (rows as Model.fitted takes them) and their log likelihood, by scaled forward and backward steps.

    first: which sequences begin a text; the others begin by the mean of the transitions.
    """
    lay = Layout(sequences)
    e, a, last = lay.edges, model.moves, len(lay.active) - 1
    b = model.emissions[lay.classes]
    alpha, scale = np.empty_like(b), np.empty(len(b))
    begins = np.where(first[lay.order][:, None], model.start, a.mean(0))
    now = begins * b[: e[1]]
    for t in range(last + 1):
        lo, hi = e[t], e[t + 1]
        if t:
            now = (now[: hi - lo] @ a) * b[lo:hi]
        total = now.sum(1)
        now = now / total[:, None]
        alpha[lo:hi], scale[lo:hi] = now, total
    back = np.ones((lay.active[last], STATES))
    gamma, moved = alpha, np.zeros((STATES, STATES))
    for t in range(last - 1, -1, -1):
        lo, mid, hi = e[t], e[t + 1], e[t + 2]
        ahead = b[mid:hi] * back / scale[mid:hi, None]
        moved += alpha[lo : lo + hi - mid].T @ ahead
        gamma[mid:hi] *= back
        back = np.ones((mid - lo, STATES))
        back[: hi - mid] = ahead @ a.T
    gamma[: e[1]] *= back
    counts = np.empty((len(model.emissions), STATES))
    for k in range(STATES):
        counts[:, k] = np.bincount(lay.classes, gamma[:, k], len(counts))
    return np.vstack([counts, moved * a, gamma[: e[1]][first[lay.order]].sum(0)]), float(np.log(scale).sum())


def likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each text, exact: pieces after a text's first are carried as matrices from every state, then chained."""
    where, pieces = [], []
    for k, text in enumerate(texts):
        step = len(text) if len(text) <= LONG else PIECE
        for begin in range(0, len(text), step):
            where.append((k, begin > 0))
            pieces.append(text[begin : begin + step])
    later = np.array([w[1] for w in where])
    states: list = [None] * len(pieces)
    for kind, at in ((False, np.flatnonzero(~later)), (True, np.flatnonzero(later))):
        if not len(at):
            continue
        lay = Layout([pieces[k] for k in at])
        b, e, n = model.emissions[lay.classes], lay.edges, len(at)
        rows = STATES if kind else 1
        now = np.tile(np.eye(STATES), (n, 1, 1)) if kind else np.tile(model.start, (n, 1, 1))
        logs, done = np.zeros(n), np.empty((n, rows, STATES))
        for t, m in enumerate(lay.active):
            here = now[:m]
            if t or kind:
                here = (here.reshape(-1, STATES) @ model.moves).reshape(m, rows, STATES)
            here = here * b[e[t] : e[t + 1], None, :]
            total = here.sum((1, 2))
            done[m : len(now)] = now[m:]
            now = here / total[:, None, None]
            logs[:m] += np.log(total)
        done[: len(now)] = now
        for place, k in enumerate(lay.order):
            states[at[k]] = done[place], logs[place]
    out, vector = np.zeros(len(texts)), None
    for (k, is_later), (state, log) in zip(where, states, strict=True):
        vector = vector @ state if is_later else state[0]
        total = vector.sum()
        out[k] += log + np.log(total)
        vector = vector / total
    return out


def _chunks(batches) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with about AT_ONCE tokens together, a longer text alone."""
    for batch in batches:
        texts = [restored(x.as_buffer(), n) for x, n in zip(batch.column("classes"), batch.column("n_tokens").to_pylist(), strict=True)]
        begin, total = 0, 0
        for k, text in enumerate(texts):
            if k > begin and total + len(text) > AT_ONCE:
                yield batch.slice(begin, k - begin), texts[begin:k]
                begin, total = k, 0
            total += len(text)
        if texts:
            yield batch.slice(begin), texts[begin:]


def _pieces(texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    cut = [(text[b : b + PIECE], b == 0) for text in texts for b in range(0, len(text), PIECE)]
    return [c[0] for c in cut], np.array([c[1] for c in cut])


def _summed(sums: np.ndarray) -> pa.RecordBatch:
    rows = np.flatnonzero(sums.any(1))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(sums[rows, k]) for k in range(STATES)]], names=["class", *[f"s{k}" for k in range(STATES)]])


def _gathered(df: DataFrame, run, rows: int) -> np.ndarray:
    """Sums over all tasks; the driver gets a row for each class, at most OWN + ENDINGS of them, and a few more."""
    out = np.zeros((rows, STATES))
    for r in arrow_pass(df, run, SUMS).groupBy("class").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)]).collect():
        out[r["class"]] = r[1:]
    return out


def fit(train: DataFrame, overall: np.ndarray) -> Model:
    """PASSES rounds of Baum-Welch over all of train. They start from SAMPLE_ROUNDS rounds, in one task, on SAMPLE_DOCS documents of the least hash."""
    spark, rows = train.sparkSession, len(overall) + STATES + 1

    def sampled(batches):
        texts = [t for _, part in _chunks(batches) for t in part]
        if texts:
            pieces, first = _pieces(texts)
            model = Model.first(overall)
            for _ in range(SAMPLE_ROUNDS):
                sums, _ = expected(model, pieces, first)
                model = Model.fitted(sums, overall)
            yield _summed(sums)

    model = Model.fitted(_gathered(hashed_sample(train.select("n_tokens", "classes"), SAMPLE_DOCS, "classes").repartition(1), sampled, rows), overall)
    for _ in range(PASSES):
        shared = spark.sparkContext.broadcast(model)  # (OWN + ENDINGS) * STATES doubles at most

        def run(batches, shared=shared):
            sums = np.zeros((rows, STATES))
            for _, texts in _chunks(batches):
                sums += expected(shared.value, *_pieces(texts))[0]
            yield _summed(sums)

        model = Model.fitted(_gathered(train.select("n_tokens", "classes"), run, rows), overall)
        shared.destroy()
    return model


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs, from its whole text.

    A text's tokens are its words, A-Z in lower case, and one end; a null or empty text is one end. Rows whose crc32(doc_id as text) mod 7
    is 2 are held out; rows without doc_id are learned from. Repeated rows count and are scored once each. base_score is the unigram
    model with one added to each count; score is the hidden Markov model's log10 likelihood: classes of words by state,
    times the word's share of its class (a frequent word is a class of its own; in a shared class the counts, one added, and one
    place for words that training lacks). An empty table gives no rows; a table without training rows scores all words as new.
    Training cuts texts into pieces of PIECE tokens; the likelihood of a text is not cut. Other columns are not read.
    """
    texts, words = coded(docs)
    overall = words.classes
    model = fit(texts.where("not held_out"), overall)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tokens = int(words.tokens)

    def run(batches):
        for rows, classes in _chunks(batches):
            scores = likelihoods(shared.value, classes) / np.log(10) + rows.column("within").to_numpy()
            columns = [*[rows.column(n) for n in ("doc_id", "held_out", "n_tokens", "n_known")], pa.array(np.full(len(classes), tokens)), rows.column("base_score"), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return arrow_pass(texts, run, RESULT)
