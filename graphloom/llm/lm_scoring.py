"""Language-model scores from a probabilistic suffix tree over words.

Symbols are words (ASCII letters lower-cased) and one end. The root predicts with add-one counts of the training
documents: P(x) = (c(x) + 1) / (N + V + 1). A context of one or two words that occurs at least MIN_COUNT times, whatever
the size of the corpus, is a candidate; it predicts with P(x | s) = (1 - e) n(s x) / N(s) + e P(x | shorter), where e, the share of new successors, is
that of successors seen once, (n_1(s) + 1/2) / (N(s) + 1); it is retained if its
divergence from the shorter context, summed over the training text with each position left out of its own counts,
is at least DIVERGENCE nats and the shorter one is retained. A token is scored by its longest retained context.

The model grows with the corpus and is never in one place. Texts become chunks of about CHUNK tokens: word numbers and
sorted word hashes in packed arrays, staged once and bucketed by chunk. All counts come from the same exchange: chunks
send their distinct keys (words, pairs, triples, contexts; 64-bit hashes, combined before they leave) with partial
sums, dealt by ranges of the hash; each range adds them up and answers every chunk with the totals of its keys. A
word or pair that fills a third of the corpus is one key a chunk. Four exchanges: words; pairs; successors seen once by
one-word contexts; and their divergences, together with the two-word contexts, which are dealt by the context and bring
their successors, so that a range counts these and judges the context at once. A context of HOT occurrences or more
would bring too many to one range: its triples are dealt by their own hash, their totals become rows, and DataFrame
aggregates judge it without another pass over the chunks. Both ways give the same. Keys whose total is known to be 0 are
not sent. A successor is known by 48 bits of its hash within its context; what the shorter context predicts travels in
steps of 1 / STEPS nats, for the divergence test alone.

Defined results: null text counts as empty (its end is its only token); null doc_ids train and are not held out;
repeated rows count each and repeat their result; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import text as texts_of
from graphloom.session import Staging, checkpoint, release

HELD_OUT = (7, 2)
MIN_COUNT, DIVERGENCE = 2, 3.0  # least occurrences of a context (one leaves nothing to predict from): the same at every size
CHUNK = 500_000  # tokens
RANGE = 2_000_000  # tokens of the corpus for each hash range of an exchange
TURNS = 2  # of the exchange of two-word contexts: it is the largest
HOT = RANGE // 8  # occurrences of a two-word context from which its successors are dealt one by one
BATCH = 1 << 20  # bytes of rows that travel together
SPREAD = 2  # buckets of chunks for each partition of the input: a task holds the answers of all chunks of its bucket
STEPS = 1024  # of a nat
END = "\n"  # no word holds white space

CHUNK_SCHEMA = "chunk long, docs binary, lengths binary, held binary, tokens binary, vocab binary, n_train long"
SENT = "chunk long, kind int, part long, keys binary, sums binary"
STATE = -1  # the kind of a row that holds a chunk with its counts
WORDS, PAIRS, TRIPLES, NOVEL_ONE, ONE, CONTEXTS, CONTEXT_NOVEL, CONTEXT_KEPT, HOT_CONTEXTS, SUCCESSORS, ONE_KEPT = KINDS = range(11)


def _smoothed(n, total, novel, shorter, shorter_out):
    """(P, P with one occurrence of the token left out) of a context that occurs `total` times."""
    share = (novel + 0.5) / (total + 1)  # Good and Turing's estimate of meeting a new successor
    seen = (1 - share) * n / total + share * shorter
    return seen, (1 - share) * np.maximum(n - 1, 0) / np.maximum(total - 1, 1) + share * shorter_out


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, in this order."""
    k = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(32))


def _planes(x: np.ndarray, width: int | None = None) -> bytes:
    """Integers by byte planes (the lowest `width`): the upper planes are long runs, which a codec takes out."""
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T[:width].tobytes()


def _from_planes(data: bytes, kind: type, width: int | None = None) -> np.ndarray:
    whole = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width or whole, -1)
    x = np.zeros((planes.shape[1], whole), np.uint8)
    x[:, : len(planes)] = planes.T
    return x.view(kind).ravel()


class _Packer:
    """Collects documents into one chunk; words are numbered as they come, so frequent ones have small numbers."""

    def __init__(self) -> None:
        self.docs, self.known, self.lengths, self.held, self.tokens, self.size = [], [], [], [], [], 0
        self.number = defaultdict(count().__next__)
        self.number[END.encode()]

    def add(self, doc_id: int | None, held: bool, data: bytes) -> None:
        words = data.lower().split()
        self.tokens.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.docs.append(0 if doc_id is None else doc_id)
        self.known.append(doc_id is not None)
        self.held.append(held)
        self.lengths.append(len(words) + 1)
        self.size += len(words) + 1

    def batch(self, chunk: int) -> pa.RecordBatch:
        vocab = _hashes(list(self.number))
        end = np.zeros(1, np.int32)
        tokens = np.concatenate([x for t in self.tokens for x in (t, end)])
        held, lengths = np.array(self.held, np.uint8), np.array(self.lengths, np.int32)
        docs = np.stack([np.array(self.docs, np.int64), np.array(self.known, np.int64)])
        data = [docs.tobytes(), lengths.tobytes(), held.tobytes(), _planes(tokens), vocab.tobytes()]
        columns = [[chunk], *[[x] for x in data], [int(lengths[held == 0].sum())]]
        types = [pa.int64(), *[pa.binary()] * 5, pa.int64()]
        return texts_of.records([f.split()[0] for f in CHUNK_SCHEMA.split(", ")], columns, types)


def _chunks(docs: DataFrame) -> DataFrame:
    modulus, value = HELD_OUT
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus == value, F.lit(False))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
    texts_of.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, made, task = _Packer(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for rows, values in texts_of.slices(batch, "text"):
                for i, h, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), values):
                    packer.add(i, h, data)
                    if packer.size >= CHUNK:
                        yield packer.batch(task << 32 | made)
                        packer, made = _Packer(), made + 1
        if packer.size:
            yield packer.batch(task << 32 | made)

    return src.mapInArrow(run, CHUNK_SCHEMA)


class _State:
    """What a chunk knows after the answers it has: per token, counts and probabilities of each context length."""

    def __init__(self, row: dict, answers: dict[int, np.ndarray], n: int, v: int, mine: Callable[[np.ndarray], np.ndarray] | None = None):
        """mine: which two-word contexts are sent in this turn; the others are not even gathered."""
        self.docs = np.frombuffer(row["docs"], np.int64).reshape(2, -1)
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        self.held_doc = np.frombuffer(row["held"], np.uint8).astype(bool)
        # from here on words are numbered by the rank of their hash: keys sent and answers received have that order
        self.vocab, rank = np.unique(np.frombuffer(row["vocab"], np.uint64), return_inverse=True)
        self.tokens = rank.astype(np.int32)[_from_planes(row["tokens"], np.int32)]
        counted = row.get("counts")
        self.counts = None if counted is None else _from_planes(counted, np.int32)  # of words, then pairs by token
        self.held = np.repeat(self.held_doc, self.lengths)
        self.second = np.ones(len(self.tokens), bool)  # tokens that have one before them in their text
        self.second[np.cumsum(self.lengths) - self.lengths] = False
        self.n, self.v, self.answers, self.sends, self.mine = n, v, answers, {}, mine
        self.least = MIN_COUNT
        self._grow()

    def _ask(self, kind: int, keys: np.ndarray, sums: Callable[[], np.ndarray]) -> np.ndarray | None:
        """Totals of keys over all chunks, if answered; else what to send, made only then. keys are distinct and ascending."""
        told = ONE_KEPT if kind == ONE else kind
        if told in self.answers or not len(keys):
            return self.answers.get(told, np.zeros(0))
        self.sends[kind] = (keys, sums())
        return None

    def _count(self, kind: int, at: np.ndarray, keys: np.ndarray) -> np.ndarray | None:
        """Counts in the training text of keys, which are those of the tokens at places `at`."""
        distinct, inverse = np.unique(keys, return_inverse=True)
        total = self._ask(kind, distinct, lambda: np.bincount(inverse, ~self.held[at], len(distinct)))
        return None if total is None else total[inverse]

    def _contexts(self, at: np.ndarray, keys: np.ndarray, some: np.ndarray, shorter: Callable[[], np.ndarray]) -> tuple | None:
        """(count, successors seen once, retained) for the tokens at places `at` and the two-word contexts (keys) of each.

        Successors are sent for the tokens `some`, whose pair occurs; shorter: log of what the shorter context predicts.
        """
        if not len(at):
            return np.zeros(0), np.zeros(0), np.zeros(0, bool)
        distinct, context = np.unique(keys, return_inverse=True)
        triples, inverse = np.unique(context[some] * len(self.vocab) + self.tokens[at[some]], return_inverse=True)
        if CONTEXTS not in self.answers:
            sums = np.bincount(inverse, ~self.held[at[some]], len(triples))
            here, word = np.divmod(triples, len(self.vocab))
            steps = _steps(shorter()[some], inverse, len(triples))
            del inverse, context, triples
            self.sends[CONTEXTS] = (distinct, (np.bincount(here, minlength=len(distinct)), self.vocab[word] >> np.uint64(16), sums, steps))
            return None
        n = np.zeros(len(at))
        n[some] = self.answers[CONTEXTS][inverse]
        return n, self.answers[CONTEXT_NOVEL][context], self.answers[CONTEXT_KEPT][context] > 0

    def _hot_contexts(self, at: np.ndarray, keys: np.ndarray, some: np.ndarray, shorter: Callable[[], np.ndarray]) -> tuple | None:
        """The same for contexts of HOT occurrences or more, whose triples are dealt one by one."""
        if not len(at):
            return np.zeros(0), np.zeros(0), np.zeros(0, bool)
        distinct, context = np.unique(keys, return_inverse=True)
        triples, inverse = np.unique(combine(keys[some], self.vocab[self.tokens[at[some]]]), return_inverse=True)
        if HOT_CONTEXTS not in self.answers:
            of = np.zeros(len(triples), np.uint64)
            of[inverse] = keys[some]
            sums = np.bincount(inverse, ~self.held[at[some]], len(triples))
            self.sends[HOT_CONTEXTS] = (distinct, np.zeros(len(distinct)))
            self.sends[TRIPLES] = (triples, (of, sums, _steps(shorter()[some], inverse, len(triples))))
            return None
        n = np.zeros(len(at))
        if len(some):
            n[some] = self.answers[TRIPLES][inverse]
        novel, kept = self.answers[HOT_CONTEXTS].reshape(2, -1)
        return n, novel[context], kept[context] > 0

    def _per_word(self, kind: int, at: np.ndarray, value: Callable[[], np.ndarray]) -> np.ndarray | None:
        """The same by the word before: word numbers are in the order of their hashes, so nothing is sorted."""
        before = self.tokens[at - 1]
        here = np.zeros(len(self.vocab), bool)
        here[before] = True
        total = self._ask(kind, self.vocab[here], lambda: np.bincount(before, np.where(self.held[at], 0.0, value()), len(self.vocab))[here])
        if total is None:
            return None
        by_word = np.zeros(len(self.vocab))
        by_word[here] = total
        return by_word[before]

    def _grow(self) -> None:
        tokens, train, size = self.tokens, ~self.held, len(self.vocab)
        words = self.counts[:size] if self.counts is not None else self._ask(WORDS, self.vocab, lambda: np.bincount(tokens, train, size))
        if words is None:
            return
        self.c = words[tokens].astype(np.float64)
        p0 = (self.c + 1) / (self.n + self.v + 1)
        self.p = p0
        out0 = np.maximum(self.c, 1) / max(1, self.n + self.v)  # the token itself left out, where it trains

        # one word: context count is the word's own, as every word is followed by something
        h = self.vocab[tokens]
        n_ctx = np.r_[0.0, self.c[:-1]]
        at = np.flatnonzero(self.second & (n_ctx >= self.least))
        pair = np.zeros(len(tokens), np.uint64)
        pair[at] = combine(h[at - 1], h[at])
        del h
        if self.counts is not None:
            n1 = self.counts[size:].astype(np.float64)
        else:
            asked = at[self.c[at] >= 1]
            found = self._count(PAIRS, asked, pair[asked])
            if found is None:
                return
            n1 = np.zeros(len(tokens))
            n1[asked] = found
            self.counted = np.concatenate([words, n1]).astype(np.int32)
            del asked, found
        novel = self._per_word(NOVEL_ONE, at, lambda: n1[at] == 1)
        if novel is None:
            return
        p1, out1 = p0.copy(), out0.copy()
        p1[at], out1[at] = _smoothed(n1[at], n_ctx[at], novel, p0[at], out0[at])
        del novel, n_ctx
        kept = self._per_word(ONE, at, lambda: np.log(out1[at] / out0[at]))
        del out0
        tree1 = np.zeros(len(tokens), bool)
        if kept is not None:
            tree1[at] = kept > 0
        del at
        # two words
        n_two = np.r_[0.0, n1[:-1]]
        at2 = np.flatnonzero(self.second & np.r_[False, self.second[:-1]] & (n_two >= self.least))
        hot = n_two[at2] >= HOT
        at2, many = at2[~hot], at2[hot]
        if self.mine is not None and CONTEXTS not in self.answers:
            at2 = at2[self.mine(pair[at2 - 1])]
        found = self._contexts(at2, pair[at2 - 1], np.flatnonzero(n1[at2] >= 1), lambda: np.log(out1[at2]))
        found_hot = self._hot_contexts(many, pair[many - 1], np.flatnonzero(n1[many] >= 1), lambda: np.log(out1[many]))
        if kept is None or found is None or found_hot is None:
            return
        self.p = np.where(tree1, p1, p0)
        for some, (n2, novel, tree2) in ((at2, found), (many, found_hot)):
            p2 = _smoothed(n2, n_two[some], novel, p1[some], out1[some])[0]
            use = tree2 & tree1[some]
            self.p[some[use]] = p2[use]

    def scores(self) -> pa.RecordBatch:
        starts = np.cumsum(self.lengths) - self.lengths
        per_doc = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        known = per_doc((self.c > 0).astype(np.int64))
        doc_ids = pa.array(self.docs[0], mask=self.docs[1] == 0)
        arrays = [doc_ids, pa.array(self.held_doc), pa.array(self.lengths.astype(np.int64)), pa.array(known),
                  pa.array(per_doc(np.log10((self.c + 1) / (self.n + self.v + 1)))), pa.array(per_doc(np.log10(self.p)))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _of_turn(bits: int, turn: int, turns: int) -> Callable[[np.ndarray], np.ndarray] | None:
    """Whether keys are in a hash range of this turn."""
    if turns == 1 or not bits:  # the only range has the first turn
        return None
    return lambda keys: (keys >> np.uint64(64 - bits)) % np.uint64(turns) == turn


def _steps(shorter: np.ndarray, inverse: np.ndarray, size: int) -> np.ndarray:
    """-log of what the shorter context predicts, in steps; up to 64 nats."""
    steps = np.zeros(size, np.uint16)
    steps[inverse] = np.minimum(np.rint(-shorter * STEPS), 65535).astype(np.uint16)
    return steps


def _pack(x: np.ndarray, kind: int) -> bytes:
    """Counts and flags as one byte each, and apart the few that need more; divergences in single precision."""
    if kind == ONE:
        return x.astype(np.float32).tobytes()
    big = np.flatnonzero(x >= 255)
    return b"".join([np.int64(len(x)).tobytes(), np.minimum(x, 255).astype(np.uint8).tobytes(), big.astype(np.int64).tobytes(), x[big].astype(np.int64).tobytes()])


def _unpack(data: bytes, kind: int) -> np.ndarray:
    if kind == ONE:
        return np.frombuffer(data, np.float32).astype(np.float64)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    x = np.frombuffer(data, np.uint8, n, 8).astype(np.float64)
    big, value = np.frombuffer(data[8 + n :], np.int64).reshape(2, -1)
    x[big] = value
    return x


def _join(*data: bytes) -> bytes:
    return b"".join([np.array([len(x) for x in data], np.int64).tobytes(), *data])


def _split(data: bytes, size: int) -> list[bytes]:
    ends = 8 * size + np.cumsum(np.frombuffer(data, np.int64, size))
    return [data[a:b] for a, b in zip([8 * size, *ends], ends)]


def _pack_sums(kind: int, a: int, b: int, sums: np.ndarray | tuple, ends: np.ndarray | None) -> bytes:
    """What goes with keys a to b: partial sums; of contexts their successors; of hot triples their contexts."""
    if kind == CONTEXTS:
        each, words, counts, steps = sums[0][a:b], *(x[ends[a] : ends[b]] for x in sums[1:])
        return _join(_pack(each, kind), _planes(words, 6), _pack(counts, kind), _planes(steps))
    if kind == TRIPLES:
        return _join(_planes(sums[0][a:b]), _pack(sums[1][a:b], kind), _planes(sums[2][a:b]))
    return _pack(sums[a:b], kind)


def _parts(chunk: int, kind: int, keys: np.ndarray, sums: np.ndarray | tuple, bits: int, turn: int = 0, turns: int = 1) -> pa.RecordBatch:
    """One row per hash range that has keys and this turn; contexts take their successors along."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
    edges = [0, *edges, len(keys)]
    some = [(p, a, b) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a and p % turns == turn]
    ends = np.r_[0, np.cumsum(sums[0])] if kind == CONTEXTS else None
    packed = [_pack_sums(kind, a, b, sums, ends) for _, a, b in some]
    columns = [[chunk] * len(some), [kind] * len(some), [p * len(KINDS) + kind for p, _, _ in some],
               [_planes(keys[a:b]) for _, a, b in some], packed]
    return texts_of.records(["chunk", "kind", "part", "keys", "sums"], columns, [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """All partial sums of one hash range and kind -> the totals, per chunk in the order of the keys it sent."""
    kind = int(rows["kind"].iloc[0])
    if kind == CONTEXTS:
        return _judged(rows)
    if kind == HOT_CONTEXTS:  # judged later: the keys go back as they came
        return rows[["chunk", "kind", "part"]].assign(totals=rows["keys"], seen=0)
    keys, sums = [_from_planes(k, np.uint64) for k in rows["keys"]], list(rows["sums"])
    if kind == TRIPLES:
        of, sums, steps = zip(*(_split(x, 3) for x in sums))
    sums = np.concatenate([_unpack(x, kind) for x in sums])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, sums, len(distinct))
    ends = np.cumsum([len(k) for k in keys])
    told, total = (ONE_KEPT, total >= DIVERGENCE) if kind == ONE else (kind, total)
    back = [_pack(total[inverse[e - len(k) : e]], told) for k, e in zip(keys, ends)]
    seen = [int((total > 0).sum())] + [0] * (len(rows) - 1)
    out = pd.DataFrame({"chunk": rows["chunk"], "kind": told, "part": rows["part"], "totals": back, "seen": seen})
    if kind == TRIPLES:
        context, step = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint16)
        context[inverse] = np.concatenate([_from_planes(x, np.uint64) for x in of])
        step[inverse] = np.concatenate([_from_planes(x, np.uint16) for x in steps])
        once = _join(_planes(context), _planes(total.astype(np.int64)), _planes(step))
        out.loc[len(out)] = (-1, SUCCESSORS, int(rows["part"].iloc[0]), once, 0)
    return out


def _judged(rows: pd.DataFrame) -> pd.DataFrame:
    """All two-word contexts of one hash range -> counts of their successors, how many were seen once, and retention."""
    keys = [_from_planes(k, np.uint64) for k in rows["keys"]]
    each, words, sums, steps = zip(*(_split(x, 4) for x in rows["sums"]))
    each = np.concatenate([_unpack(x, CONTEXTS) for x in each]).astype(np.int64)
    at = np.r_[0, np.cumsum([len(x) for x in keys])]
    contexts, context = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    words = [_from_planes(x, np.uint64, 6) for x in words]
    to = np.r_[0, np.cumsum([len(x) for x in words])]
    words = np.concatenate(words)
    distinct, word = np.unique(words, return_inverse=True)
    del words
    word += np.repeat(context, each) * len(distinct)
    triples, inverse = np.unique(word, return_inverse=True)
    del word, each
    total = np.bincount(inverse, np.concatenate([_unpack(x, CONTEXTS) for x in sums]), len(triples))
    shorter = np.zeros(len(triples))
    shorter[inverse] = np.concatenate([_from_planes(x, np.uint16) for x in steps]) / -float(STEPS)
    of = triples // max(1, len(distinct))
    del triples, sums, steps
    occurs, novel = np.bincount(of, total, len(contexts)), np.bincount(of, total == 1, len(contexts))
    one = np.exp(shorter)
    out = _smoothed(total, np.maximum(occurs, 1)[of], novel[of], one, one)[1]
    kept = np.bincount(of, total * (np.log(out) - shorter), len(contexts)) >= DIVERGENCE
    back = []
    for i, row in enumerate(zip(rows["chunk"], rows["part"])):
        here = context[at[i] : at[i + 1]]
        for kind, x in ((CONTEXTS, total[inverse[to[i] : to[i + 1]]]), (CONTEXT_NOVEL, novel[here]), (CONTEXT_KEPT, kept[here])):
            back.append((row[0], kind, row[1], _pack(x, kind), 0))
    return pd.DataFrame(back, columns=[f.split()[0] for f in ANSWER.split(", ")])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_totals of each part; the rows of a part follow one another."""
    schema = pa.schema(list(zip([f.split()[0] for f in ANSWER.split(", ")], [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()])))

    def told(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(_totals(pa.Table.from_batches(rows).to_pandas()), schema, preserve_index=False)

    rows, part = [], None
    for batch in batches:
        parts = batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(edges, edges[1:]):
            if b > a and parts[a] != part:
                if rows:
                    yield told(rows)
                rows, part = [], parts[a]
            rows.append(batch.slice(a, b - a))
    if rows:
        yield told(rows)


def _successors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            context, total, step = _split(data, 3)
            arrays = [_from_planes(context, np.int64), _from_planes(total, np.int64), _from_planes(step, np.uint16) / -float(STEPS)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["context", "n", "shorter"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            context = _from_planes(data, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(context), chunk)), pa.array(context)], names=["chunk", "context"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hot contexts of each chunk, in the order of their hashes."""
    for batch in batches:
        for chunk, got in zip(batch.column(0).to_pylist(), batch.column(1)):
            context, novel, kept = (x.to_numpy() for x in got.values.flatten())
            order = np.argsort(context.view(np.uint64))
            told = _pack(np.r_[novel[order], kept[order]], HOT_CONTEXTS)
            yield texts_of.records([f.split()[0] for f in ANSWER.split(", ")], [[chunk], [HOT_CONTEXTS], [0], [told], [0]],
                                   [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()])


ANSWER = "chunk long, kind int, part long, totals binary, seen long"
BOTH = "chunk long, counts binary, kind int, part long, keys binary, sums binary"


class Tree:
    """The exchanges over staged chunks, one after another. Once a chunk has its counts they are staged beside it."""

    def __init__(self, spark: SparkSession, st: Staging, buckets: int):
        self.spark, self.st, self.buckets, self.bits, self.n, self.v = spark, st, buckets, 0, 0, 0
        self.name = f"lm_{uuid.uuid4().hex}"
        self.tables: list[str] = []
        self.answers: list[DataFrame] = []
        self.made = 0

    def store(self, rows: DataFrame, *by: str) -> DataFrame:
        """A table bucketed by chunk: joins with it move only what is not."""
        name = f"{self.name}_{len(self.tables)}"
        rows.write.partitionBy(*by).bucketBy(self.buckets, "chunk").option("path", self.st.path(name)).option("compression", "zstd").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def _chunks(self) -> DataFrame:
        rows = self.spark.table(self.tables[0])
        if len(self.tables) == 1:
            return rows
        return rows.join(self.spark.table(self.tables[1]).where(F.col("kind") == STATE).select("chunk", "counts"), "chunk")

    def _states(self, work, schema: str, turn: int = 0, turns: int = 1) -> DataFrame:
        """work(row, state) -> record batches, over every chunk with its answers so far."""
        n, v, mine = self.n, self.v, _of_turn(self.bits, turn, turns)
        src = self._chunks()
        if self.answers:
            every = self.answers[0]
            for x in self.answers[1:]:
                every = every.unionByName(x)
            every = every.repartition(self.buckets, "chunk").groupBy("chunk").agg(
                F.collect_list(F.struct("kind", "part", "totals")).alias("got")
            )
            src = src.join(every, "chunk", "left")
        else:
            src = src.withColumn("got", F.expr("cast(null as array<struct<kind:int,part:bigint,totals:binary>>)"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    row = batch.slice(r, 1).to_pylist()[0]
                    got: dict[int, list] = defaultdict(list)
                    for g in sorted(row.pop("got") or [], key=lambda g: g["part"]):
                        got[g["kind"]].append(_unpack(g["totals"], g["kind"]))
                    yield from work(row, _State(row, {k: np.concatenate(x) for k, x in got.items()}, n, v, mine))

        return src.mapInArrow(run, schema)

    def _answer(self, sent: DataFrame, turns: int = 1) -> DataFrame:
        """A task for each hash range: dealt by a hash of their numbers, several of them would meet in one."""
        task = F.expr(f"cast(part div {len(KINDS)} div {turns} as int)")
        dealt = sent.repartitionById(max(1, (1 << self.bits) // turns), task).sortWithinPartitions("part")
        answer = self.st.write(dealt.mapInArrow(_answers, ANSWER), f"answers{self.made}")
        self.made += 1
        return answer

    def exchange(self, turns: int = 1) -> None:
        """In several turns every hash range has its own, and the shuffle files of a turn are gone before the next."""
        bits, made = self.bits, []

        def sends(turn: int):
            def work(row: dict, state: _State) -> Iterator[pa.RecordBatch]:
                for kind, (keys, sums) in state.sends.items():
                    if len(keys):
                        yield _parts(row["chunk"], kind, keys, sums, bits, turn, turns)

            return work

        for turn in range(turns):  # all are asked of the same state
            made.append(self._answer(self._states(sends(turn), SENT, turn, turns), turns))
            release(self.spark)  # here, where nothing refers to the plan any more
        self.answers += made
        if self.made == 1:
            self.v = self.answers[0].agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]

    def exchange_and_store(self) -> None:
        """An exchange whose pass also keeps the counts of words and pairs with each chunk: later passes need no more."""
        bits, names = self.bits, [f.split()[0] for f in BOTH.split(", ")]
        kinds = [f.split()[1] for f in BOTH.split(", ")]
        arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        types = [arrow[k] for k in kinds]

        def work(row: dict, state: _State) -> Iterator[pa.RecordBatch]:
            whole = {"chunk": row["chunk"], "counts": _planes(state.counted), "kind": STATE}
            yield texts_of.records(names, [[whole.get(f)] for f in names], types)
            for kind, (keys, sums) in state.sends.items():
                if len(keys):
                    some = _parts(row["chunk"], kind, keys, sums, bits).to_pydict()
                    count_ = len(some["chunk"])
                    yield texts_of.records(names, [some.get(f, [None] * count_) for f in names], types)

        sent = self.store(self._states(work, BOTH), "kind").where(F.col("kind") != STATE).drop("counts")
        for i in range(self.made):
            self.st.drop(f"answers{i}")
        self.answers = []
        release(self.spark)
        self.answers = [self._answer(sent)]
        del sent
        self.st.drop(f"{self.tables[-1]}/kind={NOVEL_ONE}")
        release(self.spark)

    def judge_hot(self) -> None:
        """Retention of the hot contexts from the totals of their triples, which are rows here, and an answer for each chunk."""
        every = self.answers[0]
        for x in self.answers[1:]:
            every = every.unionByName(x)
        rows = every.where(F.col("kind") == SUCCESSORS).select("totals").mapInArrow(_successors, "context long, n long, shorter double")
        sums = rows.groupBy("context").agg(F.sum("n").alias("occurs"), F.count_if(F.col("n") == 1).alias("novel"))
        n, occurs, share = F.col("n"), F.col("occurs"), (F.col("novel") + 0.5) / (F.col("occurs") + 1)
        out = (1 - share) * F.greatest(n - 1, F.lit(0)) / F.greatest(occurs - 1, F.lit(1)) + share * F.exp("shorter")
        gain = F.sum(n * (F.log(out) - F.col("shorter")))
        judged = rows.join(sums, "context").groupBy("context").agg(F.max("novel").alias("novel"), (gain >= DIVERGENCE).cast("int").alias("kept"))
        asked = every.where(F.col("kind") == HOT_CONTEXTS).select("chunk", "totals").mapInArrow(_asked, "chunk long, context long")
        told = F.struct("context", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("novel", "kept")])
        told = asked.join(judged, "context", "left").groupBy("chunk").agg(F.collect_list(told).alias("got"))
        answer = self.st.write(told.mapInArrow(_packed, ANSWER), "hot")
        self.answers = [x.where(~F.col("kind").isin(SUCCESSORS, HOT_CONTEXTS)) for x in self.answers] + [answer]

    def answered(self, kind: int) -> bool:
        return any(not x.where(F.col("kind") == kind).select("chunk").isEmpty() for x in self.answers)

    def scores(self) -> DataFrame:
        return self._states(lambda _, state: iter([state.scores()]), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    per_batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = None
    with Staging(spark, "lm") as st:
        made = _chunks(docs)
        tree = Tree(spark, st, max(2, SPREAD * made.rdd.getNumPartitions()))
        try:
            sizes = tree.store(made).select(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum(F.length("tokens")) / 4, F.lit(0)))
            n, size = sizes.first()
            tree.n, tree.bits = n, max(0, math.ceil(math.log2(max(1, size / RANGE))))
            before = spark.conf.get(per_batch)
            spark.conf.set(per_batch, str(BATCH))  # a chunk is a row of several MB: one a batch
            tree.exchange()  # words
            tree.exchange()  # pairs
            tree.exchange_and_store()  # successors seen once by one-word contexts
            tree.exchange(TURNS)  # their divergences; two-word contexts
            if tree.answered(HOT_CONTEXTS):
                tree.judge_hot()
            out = checkpoint(tree.scores().withColumn("train_tokens", F.lit(n).cast("long")))
        finally:
            if before is not None:
                spark.conf.set(per_batch, before)
            tree.close()
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
