"""Language identification of whole texts that may mix languages.

Each word gets a score in every candidate language: the sum of log probabilities of its
byte n-grams (the word between blanks, lower case) under that language's counts. The
script of a word's letters narrows the candidates to the languages written in it. A
Viterbi pass over the words, in which changing the language costs a penalty, labels
spans; the language with most letters is the text's, and its share of letters the score.

The model is fitted on at most SAMPLE_DOCS texts of each language.

Cases: a null text, or one without a letter (marks and digits are none), is 'und' with
score 0 and no spans; a letter of a script that no learned language uses leaves all
candidates; ties go to the language first by name; without any labelled text everything
is 'und'; repeated rows and null ids are rows of their own; an empty table gives no rows;
other columns, whatever their names, are ignored by predict() and kept by
keep_identified(). A very long text is labelled in parts of about PART bytes, cut at
white space (a word longer than that is cut too), between which a change of language
costs nothing; all parts count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import as_strings, text_parts, words_of
from .shared import crc_rest, documents

SAMPLE_DOCS = 1500
GRAMS = (1, 2, 3, 4, 5)
DIMS = 1 << 16
SWITCH = 12.0
#: Scripts by their Unicode names in regular expressions.
SCRIPTS = "Latin Greek Cyrillic Armenian Hebrew Arabic Devanagari Bengali Tamil Telugu Thai Georgian Hangul Hiragana Katakana Han".split()
#: A script counts as a language's own from this share of its words on.
SCRIPT_SHARE = 0.02
OUT = -60.0
#: Bytes of text that go through a Viterbi pass together.
SLICE = 3 << 20
PART = 1 << 16


def prepared(words: pa.Array) -> pa.Array:
    """Lower case, anything but letters and marks as blanks, one blank at each end."""
    letters = pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.large_string())), r"[^\p{L}\p{M}]+", " ")
    blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(blank, pc.utf8_trim(letters, " "), blank, none)


def gram_codes(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of prepared words, and the word of each."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(words) + 1]
    data = np.frombuffer(data, np.uint8)[: offsets[-1]].astype(np.uint32)
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    word = np.repeat(np.arange(len(counts)), counts)
    at = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    code = np.full(len(at), n, np.uint32)
    for k in range(n):
        code = code * np.uint32(0x01000193) + data[at + k]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(16)).astype(np.int64) & (DIMS - 1), word


def scripts_of(words: pa.Array) -> np.ndarray:
    """Words x scripts: whether a letter of the script is there. words are prepared."""
    found = np.zeros((len(words), len(SCRIPTS)), bool)
    plain = pc.match_substring_regex(words, r"^[\p{Latin} ]*$").to_numpy(zero_copy_only=False)
    found[:, 0] = plain
    rest = np.flatnonzero(~plain)
    if len(rest):
        odd = words.take(pa.array(rest))
        for k, name in enumerate(SCRIPTS):
            found[rest, k] = pc.match_substring_regex(odd, rf"\p{{{name}}}").to_numpy(zero_copy_only=False)
    return found


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # DIMS x languages: log probabilities
    scripts: np.ndarray  # scripts x languages: whether the language is written in the script

    def score(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words x languages, and each word's number of letters; a word without letters scores 0 everywhere."""
        ready = prepared(words)
        letters = pc.utf8_length(pc.replace_substring_regex(ready, r"[^\p{L}]+", "")).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(words), len(self.langs)))
        for n in GRAMS:
            code, word = gram_codes(ready, n)
            if len(code):
                for k in range(len(self.langs)):
                    out[:, k] += np.bincount(word, self.table[code, k], len(words))
        allowed = scripts_of(ready).astype(np.int64) @ self.scripts.astype(np.int64) > 0
        out += np.where(allowed | ~allowed.any(1, keepdims=True), 0.0, OUT)
        out -= out.max(1, keepdims=True)
        out[letters == 0] = 0.0
        return out.astype(np.float32), letters


def viterbi(scores: np.ndarray, firsts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word. firsts: each text's first word, len(texts) + 1. All texts advance together, the longest first."""
    lengths = np.diff(firsts)
    order = np.argsort(-lengths, kind="stable")
    lengths, begins = lengths[order], firsts[:-1][order]
    steps = int(lengths[0]) if len(lengths) else 0
    if not steps:
        return np.zeros(0, np.int64)
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), "right")
    bases = np.concatenate(([0], np.cumsum(active)))
    text = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = bases[step] + text
    source = np.empty(len(text), np.int64)
    source[place] = begins[text] + step
    s = scores.astype(np.float32)[source]
    stays, bests = np.ones(s.shape, bool), np.zeros(len(s), np.min_scalar_type(s.shape[1]))
    value = s[: active[0]].copy()
    for t in range(1, steps):
        a, b = bases[t], bases[t + 1]
        v = value[: b - a]
        bests[a:b] = v.argmax(1)
        moved = v.max(1, keepdims=True) - switch
        np.greater_equal(v, moved, out=stays[a:b])
        np.maximum(v, moved, out=v)
        v += s[a:b]
    final = value.argmax(1)
    labels = np.empty(len(s), np.int64)
    now = final.copy()
    for t in range(steps - 1, -1, -1):
        a, b = bases[t], bases[t + 1]
        own = now[: b - a]
        labels[a:b] = own
        if t:
            now[: b - a] = np.where(stays[np.arange(a, b), own], own, bests[a:b])
    out = np.empty(len(s), np.int64)
    out[source] = labels
    return out


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """labelled: doc_id, text, lang. At most about sample_docs texts of a language, by a hash of doc_id, are read."""
    labelled = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((DIMS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    langs = sorted(counts)
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_docs / counts[k])))))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(part < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            total = np.zeros((len(langs), DIMS + len(SCRIPTS)), np.int64)
            for rows, data, offsets in text_parts(batch.column("text"), part=PART):
                starts, _, firsts = words_of(data, offsets)
                if not len(starts):
                    continue
                coded = as_strings(data[starts[0] :], np.append(starts, len(data)) - starts[0]).dictionary_encode()
                words = prepared(coded.dictionary)
                owner = np.repeat(lang[rows], np.diff(firsts))
                times = np.bincount(coded.indices.to_numpy() * len(langs) + owner, minlength=len(words) * len(langs)).reshape(len(words), len(langs))
                for g in GRAMS:
                    code, word = gram_codes(words, g)
                    for k in range(len(langs)):
                        total[k, :DIMS] += np.bincount(code, times[word, k], DIMS).astype(np.int64)
                total[:, DIMS:] += times.T @ scripts_of(words).astype(np.int64)
            k, gram = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(gram), pa.array(total[k, gram])], ["k", "gram", "n"])

    rows = sample.mapInArrow(count, "k long, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((DIMS + len(SCRIPTS), len(langs)))
    table[rows["gram"], rows["k"]] = rows["n"]
    used = table[DIMS:]
    grams = table[:DIMS] + 0.5
    return Model(langs, np.log(grams / grams.sum(0)), used >= SCRIPT_SHARE * np.maximum(used.sum(0), 1))


def labelled(column: pa.Array, model: Model, with_spans: bool = False) -> tuple[list[str], np.ndarray, list]:
    """Language and score of each text, and its spans if asked for."""
    wide = max(1, len(model.langs))
    share, words, spans = np.zeros((len(column), wide)), np.zeros(len(column), np.int64), [[] for _ in range(len(column))]
    for rows, data, offsets in text_parts(column, SLICE, PART):
        starts, _, firsts = words_of(data, offsets)
        if not len(starts) or not model.langs:
            continue
        coded = as_strings(data[starts[0] :], np.append(starts, len(data)) - starts[0]).dictionary_encode()
        by_word, letters = model.score(coded.dictionary)
        index = coded.indices.to_numpy()
        labels = viterbi(by_word[index], firsts)
        text = np.repeat(rows, np.diff(firsts))
        np.add.at(share, (text, labels), letters[index])
        if with_spans:
            for k, row in enumerate(rows):
                own = labels[firsts[k] : firsts[k + 1]]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)] if len(own) else [0]
                for a, b in zip(cuts, cuts[1:]):
                    lang = model.langs[own[a]]
                    if spans[row] and spans[row][-1]["lang"] == lang:
                        spans[row][-1]["end"] = int(words[row] + b)
                    else:
                        spans[row].append({"start": int(words[row] + a), "end": int(words[row] + b), "lang": lang})
                words[row] += len(own)
    total = share.sum(1)
    langs = [model.langs[k] if t else "und" for k, t in zip(share.argmax(1), total)]
    return langs, share.max(1) / np.maximum(total, 1), [s if t else [] for s, t in zip(spans, total)]


def predict(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans: first word, word after the last, language)."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, spans = labelled(batch.column("text"), model, with_spans)
            columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)]
            names = ["doc_id", "lang_pred", "score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans
    return docs.select("doc_id", "text").mapInArrow(label, schema)


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.0) -> DataFrame:
    """docs, all columns, without those that are 'und' or whose language has less than min_score of the letters; lang is the predicted one. A text of several languages stays by default."""
    at = docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, _ = labelled(batch.column("text"), model)
            fine = pa.array([x != "und" and s >= min_score for x, s in zip(langs, scores)], pa.bool_())
            columns = [pa.array(langs, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(fine)

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    return crc_rest(doc_id, 4) == 2


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
