"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds the letters' vectors, each permuted
(rotated) by its place, by multiplication. A text's vector bundles (adds) its n-grams, a language's prototype
bundles its training texts, and the prediction is the language with the largest cosine.

Letters are Unicode letters in lower case; whatever stands between them is one separator, which has a vector too.
Training is linear, so prototypes are sums over all training rows, made in the partitions and added up.

Edge cases: null text, and text without a letter, are ``und`` with score 0, as is everything if nothing was there to
learn from; rows of null lang aren't learned from; repeated rows count as often as they occur; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, lean, sliced

DIM, N, SEED = 1024, 3, 11
UNKNOWN = "und"
#: N-gram vectors that a worker remembers; beyond it the memory starts anew.
CACHE_NGRAMS = 32_768
_SLOTS = 1 << 20


class Space:
    """Letter and n-gram vectors, made when first met and the same in every worker."""

    def __init__(self, dim: int = DIM, n: int = N, seed: int = SEED):
        self.dim, self.n, self.seed = dim, n, seed
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dim), dtype=np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dim, dtype=np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def _ngram(self, key: int) -> np.ndarray:
        v = np.ones(self.dim, dtype=np.int8)
        for place in range(self.n):
            v *= np.roll(self._letter(key & 0x1FFFFF), place)
            key >>= 21
        return v

    def row(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the table for distinct n-gram keys."""
        if len(self.rows) + len(keys) > CACHE_NGRAMS:
            self.rows.clear()
        for key in keys.tolist():
            if key not in self.rows:
                k = self.rows[key] = len(self.rows)
                if k == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[k] = self._ngram(key)
        return np.array([self.rows[k] for k in keys.tolist()], dtype=np.int64)

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """A row per text; zero where a text has no letter."""
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        lowered = [(t or "").lower() for t in texts]
        codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
        edges = np.cumsum([0] + [len(t) + 1 for t in lowered])
        letter = self.letter[codes]
        keep = letter | np.concatenate(([True], letter[:-1]))
        owner = np.searchsorted(edges, np.flatnonzero(keep) - 1, side="right") - 1
        seq = np.where(letter, codes, 0).astype(np.int64)[keep]
        # A separator stands for a run of them, which may reach over texts without letters: it belongs to what follows.
        gaps = np.flatnonzero(seq[:-1] == 0)
        owner[gaps] = owner[gaps + 1]
        if len(seq) and seq[-1] == 0:
            owner[-1] = len(texts)
        if len(seq) < self.n:
            return out
        keys = np.zeros(len(seq) - self.n + 1, dtype=np.int64)
        for place in range(self.n):
            keys = keys << 21 | seq[place : place + len(keys)]
        # An n-gram lies in one text if its last letter's text is its first one's, a closing separator aside.
        last = np.arange(self.n - 1, len(seq))
        inside = last - (seq[last] == 0)
        mine = (owner[: len(keys)] == owner[inside]) & (keys != 0)
        keys, owner = keys[mine], owner[: len(mine)][mine]
        if not len(keys):
            return out
        order = np.argsort(keys, kind="stable")
        fresh = np.concatenate(([True], np.diff(keys[order]) != 0))
        rows = np.empty(len(keys), dtype=np.int64)
        distinct = keys[order][fresh]
        # A memory's worth of distinct n-grams at a time.
        for lo in range(0, len(distinct), CACHE_NGRAMS // 2):
            part = self.row(distinct[lo : lo + CACHE_NGRAMS // 2])
            rank = np.cumsum(fresh) - 1
            hit = (rank >= lo) & (rank < lo + len(part))
            rows[:] = -1
            rows[order[hit]] = part[rank[hit] - lo]
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            used = len(self.rows)
            for i in np.flatnonzero(np.diff(bounds)):
                own = rows[bounds[i] : bounds[i + 1]]
                count = np.bincount(own[own >= 0], minlength=used)
                some = np.flatnonzero(count)
                for at in range(0, len(some), 4096):
                    few = some[at : at + 4096]
                    out[i] += count[few].astype(np.float32) @ self.table[few].astype(np.float32)
        return out


_spaces: dict[tuple, Space] = {}


def space(dim: int, n: int, seed: int) -> Space:
    key = (dim, n, seed)
    if key not in _spaces:
        _spaces[key] = Space(*key)
    return _spaces[key]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM, n: int = N, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from all rows of docs. What reaches the driver is dim numbers a language."""

    def bundle(tables):
        sums: dict[str, np.ndarray] = {}
        sp = space(dim, n, seed)
        for t in sliced(tables, 1):
            for group in batches(zip(t.column(0).to_pylist(), t.column(1).to_pylist())):
                v = sp.vectors([x for _, x in group])
                langs = np.array([g[0] for g in group])
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + v[langs == lang].sum(axis=0, dtype=np.float64)
        _spaces.clear()  # a worker lives on for other work
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([str(lang)] * dim), pa.array(range(dim), pa.int32()), pa.array(v, pa.float64())], ["lang", "at", "v"])

    parts = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    sums = parts.mapInArrow(lean(bundle), "lang string, at int, v double").groupBy("lang", "at").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r.lang, np.zeros(dim))[r["at"]] = r.v
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(out.items()) if np.linalg.norm(v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dim: int = DIM, n: int = N, seed: int = SEED) -> DataFrame:
    """docs with lang_pred and score: the largest cosine, at least 0."""
    docs = docs.drop("lang_pred", "score")  # columns of these names are replaced
    langs, names = list(prototypes), docs.columns
    matrix = np.array([prototypes[k] for k in langs], dtype=np.float32).reshape(len(langs), dim)

    def run(tables):
        sp = space(dim, n, seed)
        for t in sliced(tables, text_col):
            pred, score = [], []
            for group in batches((x,) for x in t.column(text_col).to_pylist()):
                v = sp.vectors([g[0] for g in group])
                norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
                cos = (v @ matrix.T) / np.maximum(norm, 1e-9)[:, None] if langs else np.zeros((len(group), 1))
                best = cos.argmax(axis=1)
                seen = (norm > 0) & bool(langs)
                pred += [langs[b] if s else UNKNOWN for b, s in zip(best, seen)]
                score += [float(min(1.0, max(0.0, cos[i, b]))) if s else 0.0 for i, (b, s) in enumerate(zip(best, seen))]
            yield pa.record_batch([*t.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])
        _spaces.clear()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lean(run), f"{fields}, lang_pred string, score double")


def keep_known(docs: DataFrame, training: Column, least: float = 0.1) -> DataFrame:
    """The rows of docs in a language that was learned: not ``und``, and nearer to a prototype than noise is."""
    known = predict(docs, train(docs.filter(training)))
    return known.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)
