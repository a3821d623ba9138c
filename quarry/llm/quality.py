"""Quality rules: base rules on words and repetition, then tokeniser fertility.

Public vocabularies measure each text: characters per token, the share of byte-fallback tokens, and the entropy of
the token distribution. The first has pieces for characters it lacks, byte by byte; a byte-level one falls back where a
token is no whole character. Texts of one language, where it is known, or else of one script form a group: a text far
outside its group's quartiles, which are computed over all texts, is rejected, however short it is; entropy is compared
within a length class. A group of a few texts is held to what any other group's bands allow, or to the quartiles of
the whole table if no group has bands.

Edge cases: null text counts as empty and fails the base rules; a text without letters is of script ``none``;
repeated rows are measured as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, lean, mix, sliced, stored, text_bytes, word_hashes
from .tokens import encoder

# Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW_WORDS = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Bands: quartiles of a group's texts, which a few per cent of junk hardly move, and the room given beyond them as a
#: multiple of their distance; and the least room, for groups that hardly differ.
LOW, HIGH, ROOM = 0.25, 0.75, 5.0
LEAST_ROOM = {"chars_per_token": 0.1, "byte_share": 0.05, "entropy": 0.25, "chars_per_token_2": 0.1, "byte_share_2": 0.05, "entropy_2": 0.25}
#: A group of fewer texts has no bands of its own.
LEAST_TEXTS = 30
#: Entropy grows with length, so its bands are set apart by powers of two of the tokens, from the first to the last of these.
FIRST_CLASS, LAST_CLASS = 4, 10
CACHE_WORDS = 400_000

# First and last code points of scripts' letters.
SCRIPTS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "arabic": (0x600, 0x6FF),
           "devanagari": (0x900, 0x97F), "kana": (0x3040, 0x30FF), "han": (0x3400, 0x9FFF), "hangul": (0xAC00, 0xD7A3)}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_models: dict[str, tuple] = {}
_broken: dict[str, np.ndarray] = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        fallback = np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(sp.get_piece_size())])
        _models[path] = (sp, fallback, {})
    return _models[path]


def repeated_words(hashes: np.ndarray, edges: np.ndarray, window: int = WINDOW_WORDS) -> np.ndarray:
    """For each text, how many of its words lie in a window of words that occurs twice or more in that text."""
    n = len(hashes)
    covered = np.zeros(n + 1, dtype=np.int64)
    if n >= window:
        owner = np.searchsorted(edges, np.arange(n), side="right") - 1
        keys = np.zeros(n - window + 1, dtype=np.uint64)
        for k in range(window):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(keys)])
        inside = owner[: len(keys)] == owner[window - 1 :]
        at = np.flatnonzero(inside)
        own = mix(keys[at] ^ mix(owner[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + window, -1)
    words = (np.cumsum(covered[:-1]) > 0).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(words)))
    return sums[edges[1:]] - sums[edges[:-1]]


def base_measures(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    hashes, edges, _ = word_hashes(texts, lower=False)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) + 1 for t in texts]
    chars = ((buf & 0xC0) != 0x80) & (buf != 32) & ((buf < 9) | (buf > 13))

    def counted(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[ends - 1] - sums[starts]

    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return [np.diff(edges), counted(chars), counted(_SYMBOL[buf]), np.array(dup, dtype=np.int64), repeated_words(hashes, edges)]


def fertility(texts: list[str], path: str) -> list[tuple[int, int, float]]:
    """Tokens, byte-fallback tokens and token entropy (bits) of each text, its words being encoded one by one."""
    sp, fallback, seen = _model(path)
    if len(seen) > CACHE_WORDS:
        seen.clear()
    split = [t.split() for t in texts]
    missing = list({w for words in split for w in words if w not in seen})
    for i in range(0, len(missing), 20_000):
        part = missing[i : i + 20_000]
        for w, ids in zip(part, sp.encode(part, num_threads=1)):
            seen[w] = np.array(ids, dtype="<u2" if len(fallback) <= 1 << 16 else "<u4").tobytes()
    out = []
    for words in split:
        ids = np.frombuffer(b"".join(map(seen.__getitem__, words)), dtype="<u2" if len(fallback) <= 1 << 16 else "<u4")
        count = np.bincount(ids, minlength=1)
        count = count[count > 0]
        p = count / max(1, len(ids))
        out.append((len(ids), int(fallback[ids].sum()), float(-(p * np.log2(p)).sum()) if len(ids) else 0.0))
    return out


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printing ones stand for themselves, and the others,
    in order, for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def fallback_tokens(path: str) -> np.ndarray:
    """Which ids of a byte-level vocabulary are no whole characters."""
    if path not in _broken:
        model, byte_of = encoder(path).model, _byte_of()
        flags = np.zeros(model.get_vocab_size(), dtype=bool)
        for token, i in model.get_vocab().items():
            try:
                bytes(byte_of[c] for c in token).decode()
            except (UnicodeDecodeError, KeyError):
                flags[i] = token not in model.get_added_tokens_decoder()
        _broken[path] = flags
    return _broken[path]


def byte_level(texts: list[str], path: str) -> list[tuple[int, int, float]]:
    """Tokens, byte-fallback tokens and token entropy (bits) of each text under a byte-level vocabulary."""
    ids, edges = encoder(path).ids(*text_bytes(pa.array(texts, pa.string())))
    broken = np.concatenate(([0], np.cumsum(fallback_tokens(path)[ids])))
    out = []
    for i, j in zip(edges.tolist(), edges[1:].tolist()):
        p = np.unique(ids[i:j], return_counts=True)[1] / max(1, j - i)
        out.append((j - i, int(broken[j] - broken[i]), float(-(p * np.log2(p)).sum()) if j > i else 0.0))
    return out


def script(text: str) -> str:
    """The script of most of a text's letters, by code point; ``other`` for letters of no listed script."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    if not any(map(str.isalpha, text)):
        return "none"
    best, most = "other", 0
    for name, (lo, hi) in SCRIPTS.items():
        n = int(((codes >= lo) & (codes <= hi)).sum())
        if n > most:
            best, most = name, n
    return best


_ROW = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "n_tokens long, byte_share double, entropy double, chars_per_token double, n_tokens_2 long, byte_share_2 double, entropy_2 double, "
        "chars_per_token_2 double, script string")
_GROUP = "__group"


def measure(docs: DataFrame, vocabulary: str, second: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The measures of each text under two vocabularies, and __group: its language, or its script where docs has none."""

    def run(tables):
        for t in sliced(tables, 1):
            for group in batches(zip(t.column(0).to_pylist(), t.column(2).to_pylist(), t.column(1).to_pylist())):
                texts = [x or "" for *_, x in group]
                scripts = list(map(script, texts))
                base = base_measures([x.encode() for x in texts])
                measured = []
                for tokens in (fertility(texts, vocabulary), byte_level(texts, second)):
                    n = [x[0] for x in tokens]
                    measured += [pa.array(n, pa.int64()), pa.array([x[1] / max(1, x[0]) for x in tokens], pa.float64()), pa.array([x[2] for x in tokens], pa.float64()),
                                 pa.array([c / max(1, k) for c, k in zip(base[1].tolist(), n)], pa.float64())]
                yield pa.record_batch(
                    [pa.array([g[0] for g in group], pa.int64()), *(pa.array(x, pa.int64()) for x in base), *measured, pa.array(scripts, pa.string()),
                     pa.array([f"lang {g[1]}" if g[1] else f"script {x}" for g, x in zip(group, scripts)], pa.string())],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "byte_share", "entropy", "chars_per_token",
                     "n_tokens_2", "byte_share_2", "entropy_2", "chars_per_token_2", "script", _GROUP])

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang")).mapInArrow(
        lean(run), f"{_ROW}, {_GROUP} string")


def banded(rows: DataFrame, every: DataFrame, measures: list[str], classes: list[str]):
    """rows with columns of limits, and whether the measures lie within: those of a row's group and classes, or if it
    is too small what any group of these classes allows, or if none has bands those of all texts of these classes."""

    def bands(*keys):
        q = every.groupBy(*keys).agg(*(F.percentile_approx(c, [LOW, HIGH], 10_000).alias(c) for c in measures), F.count(F.lit(1)).alias("n"))
        room = {c: F.greatest((F.col(c)[1] - F.col(c)[0]) * ROOM, F.lit(LEAST_ROOM[c])) for c in measures}
        return q.select("*", *(x for c in measures for x in ((F.col(c)[0] - room[c]).alias(f"lo_{c}"), (F.col(c)[1] + room[c]).alias(f"hi_{c}")))).drop(*measures)

    # A row per language or script and length class, whose lists are bounded.
    own = bands(_GROUP, *classes).filter(F.col("n") >= LEAST_TEXTS)
    sides = [(f"{s}_{c}", f) for c in measures for s, f in (("lo", F.min), ("hi", F.max))]
    tables = [(own, "own", [_GROUP, *classes]), (own.groupBy(*classes).agg(*(f(x).alias(x) for x, f in sides)), "any", classes), (bands(*classes), "all", classes)]
    for table, of, keys in tables:
        named = F.broadcast(table.select(*(F.col(k).alias(f"__{of}{k}") for k in keys), *(F.col(x).alias(f"__{of}_{x}") for x, _ in sides)))
        rows = rows.join(named, [F.col(k) == F.col(f"__{of}{k}") for k in keys], "left").drop(*(f"__{of}{k}" for k in keys)) if keys else rows.crossJoin(named)
    limit = lambda x: F.coalesce(*(F.col(f"__{of}_{x}") for _, of, _ in tables))
    inside = F.lit(True)
    for c in measures:
        inside &= F.col(c).between(limit(f"lo_{c}"), limit(f"hi_{c}"))
    return rows, inside


def judge(docs: DataFrame, vocabulary: str, second: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per document: the measures, base_failed, and kept: the base rules hold and it lies in its group's bands.
    vocabulary: a model with byte fallback; second: a byte-level one."""
    rows = stored(measure(docs, vocabulary, second, id_col, text_col, lang_col), "quality")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    length = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")
    joined = rows.withColumn("__class", F.least(F.greatest(length, F.lit(FIRST_CLASS)), F.lit(LAST_CLASS)))
    every = joined.select(_GROUP, "__class", *LEAST_ROOM)
    verdict = F.lit(True)
    for measures, classes in ((["chars_per_token", "byte_share", "chars_per_token_2", "byte_share_2"], []), (["entropy", "entropy_2"], ["__class"])):
        joined, inside = banded(joined, every, measures, classes)
        verdict &= inside
    out = joined.withColumn("kept", ~F.col("base_failed") & verdict)
    return out.select(*(c for c in rows.columns if c != _GROUP), "kept")
