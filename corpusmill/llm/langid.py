"""Operator 8: language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary, those of letters only, and all single bytes. A word's
probability is the sum over all its segmentations into pieces (forward algorithm, rescaled as it goes on, so that words of any length
keep theirs), a text's the product over its words. Probabilities are fitted by expectation maximisation on words counted in Spark from
a bounded sample of labelled rows; only the model (languages x vocabulary, ``MOST_LANGUAGES`` at most) ever meets in the driver or is
sent to the executors.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without labelled rows every text is; ties go to the
smaller language name; a very long text or word is scored whole; null ids are never held out; repeated rows are scored each for
itself; more languages than the bound are an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.tokenize import byte_alphabet, slices
from corpusmill.workspace import Workspace

WORD = re.compile(r"[^\W\d_]+")
#: Languages a model may have: the model is a matrix of this many rows in the driver and in every worker.
MOST_LANGUAGES = 1000
#: Cells (words x bytes) of a batch of words.
CELLS = 1 << 18
END = "</w>"
PRIME = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


class Vocabulary:
    """Pieces of a byte-level BPE file, found by hash: a piece's code is a polynomial of its bytes, with a mark for those that end a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        pieces = set()
        for piece in vocab:
            stem, ends = (piece[: -len(END)], 1) if piece.endswith(END) else (piece, 0)
            if stem and all(c in byte_of for c in stem):
                raw = bytes(byte_of[c] for c in stem)
                if raw.isalpha() or any(b > 127 for b in raw):
                    pieces.add((raw, ends))
        pieces |= {(bytes([b]), e) for b in range(256) for e in (0, 1)}
        self.pieces = sorted(pieces)
        codes = np.array([self._code(raw, e) for raw, e in self.pieces], "u8")
        order = np.argsort(codes)
        self.codes, self.at = codes[order], order.astype("i4")
        # Slots of a power of two; the few that meet in one go to the sorted list.
        self.slots = np.full(1 << 20, -1, "i4")
        self.slots[(codes >> np.uint64(44)).astype("i8")] = np.arange(len(codes), dtype="i4")
        self.code_of = codes
        # Which hashes begin a longer piece; a wrong yes costs one more look.
        self.begins = np.zeros(1 << 22, bool)
        heads = np.array([self._hash(raw[:k]) for raw in {raw for raw, _ in self.pieces} for k in range(1, len(raw))], "u8")
        self.begins[self._place(heads)] = True

    @staticmethod
    def _hash(raw: bytes) -> int:
        h = 0
        for b in raw:
            h = (h * 0x9E3779B97F4A7C15 + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @classmethod
    def _code(cls, raw: bytes, ends: int) -> int:
        return ((cls._hash(raw) * 2 + ends) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF

    @staticmethod
    def _place(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(42)).astype("i8")

    def __len__(self) -> int:
        return len(self.pieces)

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 for none."""
        got = self.slots[(codes >> np.uint64(44)).astype("i8")]
        miss = (got >= 0) & (self.code_of[got] != codes)
        if miss.any():
            at = np.minimum(np.searchsorted(self.codes, codes[miss]), len(self.codes) - 1)
            got[miss] = np.where(self.codes[at] == codes[miss], self.at[at], -1)
        return got

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words as piece numbers [word, start, length - 1], -1 for none, and their lengths. The last axis goes to the longest piece found."""
        size = np.fromiter(map(len, words), "i8", len(words))
        n = int(size.max())
        raw = np.zeros((len(words), n), "u8")
        for i, w in enumerate(words):
            raw[i, : len(w)] = np.frombuffer(w, "u1")
        row, start = np.nonzero(np.arange(n)[None, :] < size[:, None])
        h, k, found = np.zeros(len(row), "u8"), 0, []
        while len(row):
            h = h * PRIME + raw[row, start + k] + np.uint64(1)
            k += 1
            ends = start + k == size[row]
            got = self.lookup((h * np.uint64(2) + ends.astype("u8")) * np.uint64(0xD6E8FEB86659FD93))
            hit = got >= 0
            found.append((row[hit], start[hit], got[hit]))
            on = ~ends & self.begins[self._place(h)]
            row, start, h = row[on], start[on], h[on]
        longest = max((k for k, (r, *_) in enumerate(found, 1) if len(r)), default=1)
        grid = np.full((len(words), n, longest), -1, "i4")
        for k, (r, a, got) in enumerate(found[:longest]):
            grid[r, a, k] = got
        return grid, size


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def forward(grid: np.ndarray, prob: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all segmentations of the first bytes, alpha[position, word, language] times exp(scale[position, word, language]). prob: [language, piece], with a last column of zeros for piece -1. With ``own``, a language for each word, only that one."""
    words, n, longest = grid.shape
    wide = 1 if own is not None else prob.shape[0]
    alpha, scale, now = np.zeros((n + 1, words, wide)), np.zeros((n + 1, words, wide)), np.zeros((words, wide))
    alpha[0] = 1
    by_piece = np.ascontiguousarray(prob.T)
    for stop in range(1, n + 1):
        for k in range(1, min(longest, stop) + 1):
            piece = grid[:, stop - k, k - 1]
            alpha[stop] += alpha[stop - k] * (by_piece[piece] if own is None else prob[own, piece][:, None])
        scale[stop] = now
        if stop % 4 == 0:
            # The rows still to be used are brought to one; the rest keep the scale they had.
            low = max(0, stop - longest + 1)
            most = alpha[low : stop + 1].max(0)
            most[most == 0] = 1
            alpha[low : stop + 1] /= most
            now = now + np.log(most)
            scale[low : stop + 1] = now
    return alpha, scale


def backward(grid: np.ndarray, size: np.ndarray, prob: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``forward`` with ``own``, of the bytes from a position on: beta[position, word], scale[position, word]."""
    words, n, longest = grid.shape
    beta, scale, now = np.zeros((n + 1, words)), np.zeros((n + 1, words)), np.zeros(words)
    beta[size, np.arange(words)] = 1
    for start in range(n - 1, -1, -1):
        for k in range(1, min(longest, n - start) + 1):
            # A word's own end is one whatever has been scaled before it.
            beta[start] += beta[start + k] * prob[own, grid[:, start, k - 1]]
        scale[start] = now
        if start % 4 == 0:
            high = min(n, start + longest - 1)
            most = beta[start : high + 1].max(0)
            most[(most == 0) | (size <= start)] = 1
            beta[start : high + 1] /= most
            now = now + np.log(most)
            scale[start : high + 1] = now
    return beta, scale


def batches_of(words: list[bytes]) -> Iterator[list[int]]:
    """Places of the words in batches of like length and bounded size."""
    order, at = sorted(range(len(words)), key=lambda i: len(words[i])), 0
    while at < len(order):
        n = 1
        while at + n < len(order) and n < 4096 and (n + 1) * len(words[order[at + n]]) <= CELLS:
            n += 1
        yield order[at : at + n]
        at += n


def log_likelihood(vocab: Vocabulary, prob: np.ndarray, words: list[bytes]) -> np.ndarray:
    """[word, language]"""
    out = np.zeros((len(words), prob.shape[0]))
    for some in batches_of(words):
        grid, size = vocab.lattice([words[i] for i in some])
        alpha, scale = forward(grid, prob)
        rows = np.arange(len(some))
        out[some] = np.log(alpha[size, rows]) + scale[size, rows]
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((lang, letters(w).encode()) for w in WORD.findall(text.lower()))
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.binary()), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "word", "n"])


def _expected(path: str, langs: list[str], prob_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, prob = vocabulary(path), prob_of.value
        total = np.zeros((len(langs), len(vocab) + 1))
        number = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            which = np.array([number[x] for x in batch.column(0).to_pylist()])
            for some in batches_of(words):
                grid, size = vocab.lattice([words[i] for i in some])
                own, rows = which[some], np.arange(len(some))
                (alpha, up), (beta, down) = forward(grid, prob, own), backward(grid, size, prob, own)
                alpha, up = alpha[:, :, 0], up[:, :, 0]
                whole = np.log(alpha[size, rows]) + up[size, rows]
                for k in range(1, grid.shape[2] + 1):
                    for start in range(grid.shape[1] - k + 1):
                        piece = grid[:, start, k - 1]
                        hit = np.flatnonzero(piece >= 0)
                        if len(hit):
                            share = alpha[start, hit] * prob[own[hit], piece[hit]] * beta[start + k, hit] * np.exp(up[start, hit] + down[start + k, hit] - whole[hit])
                            np.add.at(total, (own[hit], piece[hit]), share * n[some][hit])
        lang, piece = np.nonzero(total[:, :-1])
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype("i4")), pa.array(piece.astype("i4")), pa.array(total[lang, piece])], names=["lang", "piece", "n"])

    return run


def train(labelled: DataFrame, path: str, sample_rows: int = 10_000, rounds: int = 3, smoothing: float = 0.01) -> tuple[list[str], np.ndarray]:
    """labelled: lang, text, key. Fits on about ``sample_rows`` rows at most, those with the smallest hashes of ``key``. Gives the languages and [language, piece] probabilities."""
    spark = labelled.sparkSession
    ws = Workspace(spark, "langid")
    good = labelled.filter("lang is not null and text is not null")
    rows = good.select("key").count()
    if rows > sample_rows:
        good = good.filter(F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample_rows / rows)))
    words = ws.keep(good.select("lang", "text").mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted((r[0] for r in words.select("lang").distinct().collect()), key=lambda s: s.encode())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; a model holds {MOST_LANGUAGES} at most")
    vocab = vocabulary(path)
    prob = np.zeros((len(langs), len(vocab) + 1))
    if not langs:
        return langs, prob
    # A start that favours no piece: shorter pieces are likelier, as in random bytes.
    prob[:, :-1] = [2.0 ** (-4 * len(raw)) for raw, _ in vocab.pieces]
    prob /= prob.sum(1, keepdims=True)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(prob)
        got = words.mapInArrow(_expected(path, langs, sent), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.full((len(langs), len(vocab)), smoothing)
        total[got["lang"], got["piece"]] += got["n"]
        prob[:, :-1] = total / total.sum(1, keepdims=True)
        sent.destroy()
    ws.drop(words)
    return langs, prob


def _predict(path: str, langs: list[str], prob_of, limit: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, prob = vocabulary(path), prob_of.value
        number: dict[str, int] = {}
        table = np.zeros((0, len(langs)))
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            # Known words keep their likelihoods; the memory is emptied when full.
            if len(number) > limit:
                number, table = {}, np.zeros((0, len(langs)))
            pred, score = [], []
            for at in range(0, len(texts), 200):
                found = [WORD.findall(t.lower()) if t and langs else [] for t in texts[at : at + 200]]
                new = list({w for words in found for w in words if w not in number})
                if new:
                    number.update(zip(new, range(len(table), len(table) + len(new))))
                    table = np.concatenate([table, log_likelihood(vocab, prob, [letters(w).encode() for w in new])])
                for words in found:
                    total = table[[number[w] for w in words]].sum(0) if words else None
                    if total is None or not total.any():
                        pred.append("und")
                        score.append(0.0)
                    else:
                        best = int(total.argmax())
                        pred.append(langs[best])
                        score.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *batch.columns[2:]], names=["id", "lang_pred", "score", *batch.schema.names[2:]])

    return run


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> tuple[list[str], np.ndarray]:
    known = docs.filter(~F.coalesce(held_out(id_col), F.lit(False)))
    return train(known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("key")), path, **options)


def predict_languages(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score. A row per row, where the text lies: no shuffle."""
    langs, prob = model
    sent = docs.sparkSession.sparkContext.broadcast(prob)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_predict(path, langs, sent), "id long, lang_pred string, score double")
    return rows.select(F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, path: str, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more."""
    langs, prob = fit(docs, path, id_col, text_col, lang_col, **options)
    sent = docs.sparkSession.sparkContext.broadcast(prob)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("row", docs.schema)])
    return rows.mapInArrow(_predict(path, langs, sent), schema).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
