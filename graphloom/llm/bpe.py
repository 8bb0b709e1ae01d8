"""Byte-level BPE encoding and decoding, with contiguous rank arrays.

A text is cut into space-led runs and those, where unseen, into words by the tokenizer's pattern. Many short words
are merged at once: row i of a matrix holds the parts of word i, a second one the rank of each boundary between two
parts. Each round scans every row for its least rank, deletes that boundary and looks up the two ranks beside it;
rows without a mergeable boundary leave. Words over LONG bytes take the same merges from a heap, so a run of a
million letters costs n log n. Results of whole runs are remembered in a bounded table.

The tokenizer file is read once on the driver; its tables (bounded by the vocabulary) are broadcast as plain data.

Defined results: null and empty texts give no ids and decode to the empty text; the added token in a text becomes its
own id; repeated rows repeat their result; other columns are not touched, but those named like a result (ids, decoded)
are replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import text as texts_of

LONG = 48  # bytes of a word that still goes through the matrix
REMEMBERED = 200_000  # runs
MATRIX = 50_000  # words merged at once

# Unicode's White_Space, which the tokenizer's \s stands for
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
RUN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
LETTERS = regex.compile(r" ?\p{L}+")
NONE = np.int32(2**31 - 1)


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary: itself if printable, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def tables(path: str) -> dict:
    """The tables of a tokenizer file, as plain arrays, lists and dicts."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    stand = _byte_of()
    vocab = {bytes(stand[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    token = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for t, i in vocab.items():
        token[i] = t
    for t, i in added.items():
        token[i] = t.encode()
    made = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
    made = [[bytes(stand[c] for c in x) for x in pair] for pair in made]
    key = np.array([vocab[a] << 20 | vocab[b] for a, b in made], dtype=np.int64)
    order = np.argsort(key)
    return {
        "added": added, "token": token, "single": np.array([vocab[bytes([b])] for b in range(256)], dtype=np.int64),
        "key": key[order], "rank": order.astype(np.int32), "result": np.array([vocab[a + b] for a, b in made], dtype=np.int64),
    }


class Bpe:
    """The encoder and decoder over the tables of one tokenizer file; result is by rank."""

    def __init__(self, added: dict, token: list, single: np.ndarray, key: np.ndarray, rank: np.ndarray, result: np.ndarray):
        self.added, self.token, self.single, self.key, self.rank, self.result = added, token, single, key, rank, result
        self.pairs: dict[int, int] | None = None  # rank of each key; made when a long word is met

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers. Words are of at most LONG bytes, none empty."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for i in range(0, len(order), MATRIX):
            self._merge_rows(words, order[i : i + MATRIX], size, out)
        return out

    def _merge_rows(self, words: list[bytes], rows: np.ndarray, size: np.ndarray, out: list[bytes]) -> None:
        width = int(size[rows].max())
        flat = np.frombuffer(b"".join([words[r].ljust(width, b"\0") for r in rows]), np.uint8).reshape(len(rows), width)
        part = np.where(np.arange(width) < size[rows, None], self.single[flat], -1)
        rank = self._ranks(part[:, :-1], part[:, 1:])
        while len(rows):
            if part.shape[1] > 1:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(rows)), at]
                go = best < NONE
            else:
                go = np.zeros(len(rows), bool)
            if not go.all():
                done = part[~go]
                count = (done >= 0).sum(axis=1)
                ids = done.astype("<u4")
                for r, row, n in zip(rows[~go].tolist(), ids, count.tolist()):
                    out[r] = row[:n].tobytes()
                rows, part, rank = rows[go], part[go], rank[go]
                if not len(rows):
                    return
                at, best = at[go], best[go]
            line = np.arange(len(rows))
            part[line, at] = self.result[best]
            keep = np.ones(part.shape, bool)
            keep[line, at + 1] = False
            part = part[keep].reshape(len(rows), -1)
            keep = np.ones(rank.shape, bool)
            keep[line, at] = False
            rank = rank[keep].reshape(len(rows), -1)
            if rank.shape[1]:
                before = np.maximum(at - 1, 0)
                new = self._ranks(part[line, before], part[line, at])
                rank[line, before] = np.where(at > 0, new, rank[line, before])
                last = np.minimum(at, rank.shape[1] - 1)
                new = self._ranks(part[line, last], part[line, last + 1])
                rank[line, last] = np.where(at < rank.shape[1], new, rank[line, last])

    def merge_long(self, word: bytes) -> bytes:
        """The same merges for one long word: boundaries in a heap by (rank, place), parts in a linked list."""
        part = self.single[np.frombuffer(word, np.uint8)].tolist()
        if self.pairs is None:
            self.pairs = dict(zip(self.key.tolist(), self.rank.tolist()))
        pairs = self.pairs
        n = len(part)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := pairs.get(part[i] << 20 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if part[i] == a else n
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = int(self.result[r]), -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for x in (prev[i], i):
                if x >= 0 and (y := nxt[x]) < n and (r := pairs.get(part[x] << 20 | part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return np.array([p for p in part if p >= 0], dtype="<u4").tobytes()

    def _learn(self, runs: list[str], known: dict[str, bytes]) -> None:
        """Adds the ids of runs to known. All words of all runs are merged together."""
        cut = [[r] if LETTERS.fullmatch(r) else WORD.findall(r) for r in runs]
        words = {w: b"" for c in cut for w in c}
        data = {w: w.encode() for w in words}
        short = [w for w in words if len(data[w]) <= LONG]
        words.update(zip(short, self.merge_many([data[w] for w in short])))
        for w in words:
            if len(data[w]) > LONG:
                words[w] = self.merge_long(data[w])
        for r, c in zip(runs, cut):
            known[r] = words[c[0]] if len(c) == 1 else b"".join([words[w] for w in c])

    def encode_batch(self, texts: list[str], known: dict[str, bytes] | None = None) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; known remembers runs between calls."""
        known = {} if known is None else known
        pieces = [self._split_added(t) for t in texts]
        runs = [[RUN.findall(p) if isinstance(p, str) else p for p in some] for some in pieces]
        unseen = {r for some in runs for p in some if isinstance(p, list) for r in p if r not in known}
        if unseen:
            if len(known) + len(unseen) > REMEMBERED:
                known.clear()
                unseen = {r for some in runs for p in some if isinstance(p, list) for r in p}
            self._learn(list(unseen), known)
        get = known.__getitem__
        return [b"".join([b"".join(map(get, p)) if isinstance(p, list) else p for p in some]) for some in runs]

    def _split_added(self, text: str) -> list[str | bytes]:
        out: list[str | bytes] = [text]
        for content, i in self.added.items():
            if content in text:
                mark = int(i).to_bytes(4, "little")
                cut = [c.split(content) if isinstance(c, str) else [c] for c in out]
                out = [y for c in cut for k, x in enumerate(c) for y in ([mark] if k else []) + [x]]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _mapped(df: DataFrame, path: str, source: str, keep: list[str], to: list[tuple[str, str]], work) -> DataFrame:
    keep = [n for n in keep if n.lower() not in {t.lower() for t, _ in to}]
    src = df.select(*[F.col(f"`{n}`") for n in keep], F.col(f"`{source}`").alias("__in"))
    texts_of.bound_batches(df.sparkSession)
    # plain data travels, not an object of this package: workers need neither the file nor the package
    plain = df.sparkSession.sparkContext.broadcast(tables(path))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    schema = ", ".join(fields + [f"`{n}` {t}" for n, t in to])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        model = Bpe(**plain.value)
        for batch in batches:
            for rows, values in texts_of.slices(batch, "__in"):
                made = work(model, values, known)
                arrays = [pa.array(x, type=pa.string() if t == "string" else pa.binary()) for x, (_, t) in zip(made, to)]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *arrays], names=[*keep, *[n for n, _ in to]])

    return src.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, source: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all but source, if None) and ids: binary, 32-bit little-endian. A column named ids is replaced."""
    keep = [n for n in df.columns if n != source] if keep is None else keep

    def work(bpe: Bpe, values: list[bytes], known: dict[str, bytes]) -> list[list]:
        return [bpe.encode_batch([v.decode("utf-8", "replace") for v in values], known)]

    return _mapped(df, path, source, keep, [("ids", "binary")], work)


def decode(df: DataFrame, path: str, source: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all but source, if None) and decoded (string) of ids made by `encode`. A column named decoded is
    replaced."""
    keep = [n for n in df.columns if n != source] if keep is None else keep
    return _mapped(df, path, source, keep, [("decoded", "string")], lambda bpe, values, _: [[bpe.decode(v) for v in values]])


def round_trip(df: DataFrame, path: str, source: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`encode` and `decode` in one pass: columns `keep`, ids, decoded (in place of columns of these names)."""
    keep = [n for n in df.columns if n != source] if keep is None else keep

    def work(bpe: Bpe, values: list[bytes], known: dict[str, bytes]) -> list[list]:
        ids = bpe.encode_batch([v.decode("utf-8", "replace") for v in values], known)
        return [ids, [bpe.decode(x) for x in ids]]

    return _mapped(df, path, source, keep, [("ids", "binary"), ("decoded", "string")], work)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of round_trip's columns."""
    return df.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(round_trip(docs, vocabulary(), keep=["doc_id"]))
