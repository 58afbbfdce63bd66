"""Language identification of mixed-language text.

Each word's letters name a script, and only languages that use the script are candidates for it. Words get a score for
each candidate from character trigrams; a Viterbi pass with a switching penalty turns them into spans of one language.
The document's language is the one that labels most letters.

Trained on at most `most_docs` documents a language, chosen by a hash of their ids, from rows that are not held out and
have a language; the trigram counts are summed on the executors, a fixed number of vectors in all.

Cases: null text, or text without a letter (str.isalpha), is 'und' with score 0. Without training rows, as in an empty
table, all text is 'und'. Equal texts get equal predictions. Of languages with equally many letters the first by name is
taken, and a path switches only where that gains. Words without a letter take the language around them. Very long texts
are labelled whole, in memory linear in their words. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmesh.llm.common import arrow_schema, held_out, is_held_out, map_rows, slices

REPORT = "doc_id long, held_out boolean, lang_pred string, score double, n_spans long"
SPANS = "doc_id long, span long, lang string, start_char long, end_char long"
UNKNOWN = "und"
BITS = 15
#: First code points of Unicode ranges and the script of each (0: none, as digits and marks).
SCRIPTS = ("none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "hangul", "kana", "han", "other")
_RANGES = (
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00B5, 1), (0x00B6, 0), (0x00BA, 1), (0x00BB, 0),
    (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1), (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5),
    (0x0600, 6), (0x0660, 0), (0x066A, 6), (0x0780, 12), (0x0900, 7), (0x0E00, 8), (0x0E80, 12), (0x1100, 9), (0x1200, 12), (0x1C80, 3), (0x1C90, 12),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C00, 12), (0x2C60, 1), (0x2C80, 12), (0x2E00, 0), (0x3040, 10), (0x3100, 11), (0x3130, 9), (0x3190, 0),
    (0x3400, 11), (0x4DC0, 0), (0x4E00, 11), (0xA000, 12), (0xAC00, 9), (0xD7B0, 0), (0xF900, 11), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0),
    (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 10), (0xFFA0, 9), (0xFFE0, 0), (0x10000, 12), (0x1F000, 0), (0x20000, 11), (0x32000, 0),
)
_STARTS = np.array([a for a, _ in _RANGES], np.uint32)
_SCRIPT_OF = np.array([s for _, s in _RANGES], np.int8)
_OTHER = SCRIPTS.index("other")


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """The script of each code point, 0 for all but letters, and its lower case where that is one character."""
    every = [chr(c) for c in range(0x110000)]
    script = _SCRIPT_OF[np.searchsorted(_STARTS, np.arange(len(every), dtype=np.uint32), "right") - 1]
    script = np.where(np.fromiter(map(str.isalpha, every), bool, len(every)), np.where(script == 0, _OTHER, script), 0).astype(np.int8)
    low = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every), np.uint32, len(every))
    return script, low


@dataclass(frozen=True)
class LangConfig:
    most_docs: int = 1500
    switch_penalty: float = 12.0
    smoothing: float = 0.5
    script_share: float = 0.005


@dataclass
class LangModel:
    langs: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))  # log likelihoods of trigrams
    uses: np.ndarray = field(default_factory=lambda: np.zeros((len(SCRIPTS), 0), bool))  # script by language


@dataclass
class Words:
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    letters: np.ndarray  # of each word
    script: np.ndarray  # of each word: that of its first letter
    grams: np.ndarray  # trigram of each place


def split_words(text: str) -> Words:
    """Words between white space (ASCII and ideographic), scripts, and hashed trigrams of the lower-cased letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        none = np.zeros(0, np.int64)
        return Words(codes, none, none, none, none, none)
    scripts, lower = _characters()
    script, low = scripts[codes], lower[codes]
    space = (codes <= 32) & ((codes == 32) | (codes >= 9) & (codes <= 13)) | (codes == 0x3000)
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(codes, none, none, none, none, none)
    shown = np.where(script > 0, low, 32).astype(np.uint32)  # all but letters look alike
    before, after = np.concatenate(([32], shown[:-1])).astype(np.uint32), np.concatenate((shown[1:], [32])).astype(np.uint32)
    mixed = (before * np.uint32(0x9E3779B1) ^ shown * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) + after * np.uint32(0x27D4EB2F)
    grams = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)
    total = np.concatenate(([0], np.cumsum(script > 0)))
    letters = total[ends] - total[starts]
    # the first letter of each word
    at = np.flatnonzero(script > 0)
    first = np.searchsorted(at, starts)
    word_script = np.where(letters > 0, script[at[np.minimum(first, max(len(at) - 1, 0))]] if len(at) else 0, 0)
    return Words(codes, starts, ends, letters, word_script, np.where(script > 0, grams, 0).astype(np.int64))


def word_scores(words: Words, model: LangModel) -> np.ndarray:
    """A score for each word and language; words without a letter score 0 for all, foreign scripts far below."""
    n_langs = len(model.langs)
    out = np.zeros((len(words.starts), n_langs), np.float32)
    if not len(out):
        return out
    is_letter = words.grams > 0
    grams = words.grams
    for lang in range(n_langs):
        total = np.concatenate(([0.0], np.cumsum(np.where(is_letter, model.table[grams, lang], 0), dtype=np.float64)))
        out[:, lang] = total[words.ends] - total[words.starts]
    allowed = model.uses[words.script]
    # a script that no language uses leaves all of them
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return np.where((words.letters > 0)[:, None] & ~allowed, np.float32(-1e4), out)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best labelling of words, where each switch costs a penalty."""
    n, k = scores.shape
    if k == 1 or not n:
        return np.zeros(n, np.int64)
    total = scores.sum(axis=0, dtype=np.float64)
    best = int(total.argmax())
    # The best path is the best single label if no run of words favours another label by more than a switch costs, and if
    # paths without the best label, which switch once less than they have runs, cannot gain a switch over it in all.
    over = scores.astype(np.float64) - scores[:, [best]].astype(np.float64)
    gain = np.cumsum(over, axis=0)
    low = np.minimum.accumulate(np.concatenate((np.zeros((1, k)), gain[:-1])), axis=0)
    if float((gain - low).max()) <= penalty and float(np.delete(over, best, axis=1).max(axis=1).sum()) <= penalty:
        return np.full(n, best, np.int64)
    path, value = np.empty((n, k), np.int32), scores[0].astype(np.float64).tolist()
    labels = range(k)
    for i, row in enumerate(scores[1:].tolist(), 1):
        lead = max(labels, key=value.__getitem__)
        switched = value[lead] - penalty
        came = path[i]
        nxt = [0.0] * k
        for j in labels:
            if value[j] >= switched:
                nxt[j], came[j] = value[j] + row[j], j
            else:
                nxt[j], came[j] = switched + row[j], lead
        value = nxt
    out = np.empty(n, np.int64)
    label = max(labels, key=value.__getitem__)
    for i in range(n - 1, -1, -1):
        out[i] = label
        if i:
            label = path[i, label]
    return out


def label_words(text: str, model: LangModel, config: LangConfig = LangConfig()) -> tuple[Words, np.ndarray, np.ndarray]:
    words = split_words(text)
    scores = word_scores(words, model)
    return words, scores, viterbi(scores, config.switch_penalty)


def identify(text: str, model: LangModel, config: LangConfig = LangConfig()) -> tuple[str, float, list[tuple[str, int, int]]]:
    """The language of most letters, the share of letters it labels, and spans (language, start, end) in characters."""
    if not model.langs:
        return UNKNOWN, 0.0, []
    words, _, labels = label_words(text, model, config)
    if not words.letters.sum():
        return UNKNOWN, 0.0, []
    weight = np.bincount(labels, words.letters, len(model.langs))
    best = int(weight.argmax())
    cut = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
    ends = np.concatenate((cut[1:] - 1, [len(labels) - 1]))
    spans = [(model.langs[labels[a]], int(words.starts[a]), int(words.ends[b])) for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
    return model.langs[best], float(weight[best] / weight.sum()), spans


def fit(docs: DataFrame, config: LangConfig = LangConfig()) -> LangModel:
    """Trigram counts and scripts of each language, from a bounded sample of its documents."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("lang")).filter("lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(config.most_docs)) / F.count("*")).alias("share"))  # a row for each language
    chosen = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < F.col("share")
    sample = known.join(F.broadcast(share.withColumnRenamed("lang", "_lang")), F.col("lang") == F.col("_lang")).filter(chosen).select("lang", "text")
    schema = "lang string, grams binary, scripts binary"

    def count(batches):
        grams, scripts = {}, {}
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = split_words(text)
                g = words.grams[words.grams > 0]
                grams[lang] = grams.get(lang, 0) + np.bincount(g, minlength=1 << BITS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(words.script, words.letters, len(SCRIPTS))
        yield pa.RecordBatch.from_pydict({"lang": list(grams), "grams": [g.astype("<i8").tobytes() for g in grams.values()], "scripts": [np.asarray(s, "<f8").tobytes() for s in scripts.values()]}, schema=arrow_schema(schema))

    # eight tasks count, so that the driver adds up eight vectors a language at any size
    rows = sample.repartition(8).mapInArrow(count, schema).collect()
    langs = sorted({r["lang"] for r in rows})
    grams = np.stack([sum(np.frombuffer(r["grams"], "<i8") for r in rows if r["lang"] == lang) for lang in langs], axis=1).astype(np.float64) if langs else np.zeros((1 << BITS, 0))
    scripts = np.stack([sum(np.frombuffer(r["scripts"], "<f8") for r in rows if r["lang"] == lang) for lang in langs], axis=1) if langs else np.zeros((len(SCRIPTS), 0))
    smooth = grams + config.smoothing
    table = np.log(smooth / smooth.sum(axis=0, keepdims=True)) if langs else grams
    uses = scripts > config.script_share * np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    return LangModel(langs, table.astype(np.float32), uses)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def predict(docs: DataFrame, model: LangModel, config: LangConfig = LangConfig()) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_slice(batch: pa.RecordBatch) -> dict:
        ids, got = batch.column(0), [identify(t, shared.value, config) for t in batch.column(1).to_pylist()]
        return {"doc_id": ids, "held_out": [is_held_out(i) for i in ids.to_pylist()], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "n_spans": [len(g[2]) for g in got]}

    return map_rows(_texts(docs), per_slice, REPORT)


def language_spans(docs: DataFrame, model: LangModel, config: LangConfig = LangConfig()) -> DataFrame:
    """One row per span of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_slice(batch: pa.RecordBatch) -> dict:
        rows = [(d, i, *s) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, s in enumerate(identify(t, shared.value, config)[2])]
        return dict(zip(("doc_id", "span", "lang", "start_char", "end_char"), zip(*rows, strict=True) if rows else [[]] * 5, strict=True))

    return map_rows(_texts(docs), per_slice, SPANS)


def language_report(docs: DataFrame, config: LangConfig = LangConfig()) -> DataFrame:
    return predict(docs, fit(docs, config), config)
