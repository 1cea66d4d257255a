"""Language identification (operator 1) for texts that may mix languages.

Words are cut at changes of script, and runs of unspaced scripts into pairs of characters. A word's
script, found by code-point ranges, narrows its candidates to the languages that use the script in the
training texts; no other language can have the word. Candidates score it by the log-probabilities of
its byte trigrams. Viterbi's algorithm over the words, with a penalty for each switch, labels spans;
the language of most letters is the text's. Counts come from all training rows, in one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm import textkit
from quadrille.llm.common import free, read, remainder

#: First and last code points of scripts (fixed values of Unicode's blocks).
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
OTHER = len(SCRIPT_RANGES)
#: Scripts written without blanks, whose runs are cut every two characters.
UNSPACED = np.array([name in ("thai", "kana", "han") for name, _, _ in SCRIPT_RANGES] + [False])
#: A language uses a script if this share of its training words is in it.
SCRIPT_SHARE = 0.001
BUCKETS = 1 << 15
PSEUDO_COUNT = 0.5
#: In nats: what a change of language costs, and the most one word can speak against a candidate.
SWITCH, WORD_LIMIT = 9.0, 6.0
#: Bytes of texts that are labelled together; a longer text goes alone, its words found in segments.
LABEL_BYTES = 1 << 19
UNKNOWN = "und"

#: ASCII letters and all bytes from 0x80 on belong to words.
_NO_LETTER = np.zeros(256, bool)
_NO_LETTER[:0x80] = [not chr(b).isalpha() for b in range(0x80)]


def _script_table() -> np.ndarray:
    """Script by a character's first two UTF-8 bytes, which fix its block of 64 code points."""
    table = np.full(1 << 16, OTHER, np.uint8)
    table[: 0x80 << 8] = 0
    for lead in range(0xC2, 0xF0):
        for second in range(0x80, 0xC0):
            point = ((lead & 0x1F) << 6 | second & 0x3F) if lead < 0xE0 else ((lead & 0x0F) << 12 | (second & 0x3F) << 6)
            for k, (_, first, last) in enumerate(SCRIPT_RANGES):
                if first <= point <= last:
                    table[lead << 8 | second] = k
    return table


_SCRIPT = _script_table()


@dataclass
class Cut:
    """Words of a run of texts: byte spans, the first word of each text, script and trigram buckets;
    ``at`` are the words' bounds in ``bucket``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    script: np.ndarray
    bucket: np.ndarray
    at: np.ndarray


def _split_scripts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut where the script changes, and in pairs in unspaced scripts: starts, ends and scripts.

    Characters of no listed script (marks, quotes, digits of other scripts) go with those before them.
    """
    mixed = np.flatnonzero(np.add.reduceat(data >= 0x80, np.stack([start, end], 1).ravel()[: 2 * len(start) - (end[-1] == len(data))])[::2] > 0)
    script = np.zeros(len(start), np.uint8)
    if not len(mixed):
        return start, end, script
    length = end[mixed] - start[mixed]
    place = np.arange(length.sum()) + np.repeat(start[mixed] - (np.cumsum(length) - length), length)
    word = np.repeat(mixed, length)
    lead = (data[place] & 0xC0) != 0x80
    place, word = place[lead], word[lead]
    kind = _SCRIPT[data[place].astype(np.int64) << 8 | data[np.minimum(place + 1, len(data) - 1)]]
    index = np.arange(len(kind))
    begins = np.concatenate([[True], word[1:] != word[:-1]])
    last = np.maximum.accumulate(np.where(begins | (kind != OTHER), index, 0))  # of a known script, or the word's first
    before = np.concatenate([[OTHER], kind[last[:-1]]])
    before[begins] = OTHER
    change = (kind != OTHER) & (before != OTHER) & (kind != before)
    run = np.maximum.accumulate(np.where(begins | change, index, 0))
    pair = UNSPACED[kind] & ((index - run) % 2 == 0) & ~begins
    cut = np.flatnonzero(change | pair)
    starts, ends = np.sort(np.concatenate([start, place[cut]])), np.sort(np.concatenate([end, place[cut]]))
    # A piece's script is that of its first character of a known one.
    piece = np.searchsorted(starts, place, "right") - 1
    script = np.zeros(len(starts), np.uint8)
    script[piece] = OTHER
    known = np.flatnonzero(kind != OTHER)[::-1]
    script[piece[known]] = kind[known]
    return starts, ends, script


def cut_words(data: np.ndarray, bounds: np.ndarray) -> Cut:
    start, end = textkit.spans(data, bounds, _NO_LETTER)
    if not len(start):
        return Cut(start, end, np.zeros(len(bounds), np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(1, np.int64))
    start, end, script = _split_scripts(data, start, end)
    length = end - start
    at = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(at[-1]) + np.repeat(start - at[:-1], length)
    byte = textkit._LOWER[data[place]].astype(np.uint32)
    one = np.concatenate([[0], byte[:-1]]).astype(np.uint32)
    one[at[:-1]] = 0
    two = np.concatenate([[0], one[:-1]]).astype(np.uint32)
    two[at[:-1]] = 0
    ends = np.zeros(len(byte), np.uint32)
    ends[at[1:] - 1] = 1
    mixed = (byte * np.uint32(0x9E3779B1) ^ one * np.uint32(0x85EBCA77) ^ two * np.uint32(0xC2B2AE3D) ^ ends * np.uint32(0x27D4EB2F)) * np.uint32(0x2C1B3C6D)
    return Cut(start, end, np.searchsorted(start, bounds), script, (mixed >> np.uint32(17)).astype(np.int32), at)


@dataclass
class Model:
    languages: list[str]
    score: np.ndarray  # languages x buckets
    candidate: np.ndarray  # scripts x languages


def train(rows: DataFrame) -> Model:
    """Fit on (text, lang); rows without either teach nothing. The model's size is languages x buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lo, hi, data, bounds in textkit.text_chunks(batch["text"]):
                names = langs[lo:hi]
                for _, part, own_bounds in textkit.segments(data, bounds, _NO_LETTER):
                    cut = cut_words(part, own_bounds)
                    for name in set(names):
                        own = seen.setdefault(name, np.zeros(BUCKETS + OTHER + 1, np.int64))
                        rows_ = np.array([x == name for x in names])
                        words = np.repeat(rows_, np.diff(cut.first))
                        own[:BUCKETS] += np.bincount(cut.bucket[np.repeat(words, np.diff(cut.at))], minlength=BUCKETS)
                        own[BUCKETS:] += np.bincount(cut.script[words], minlength=OTHER + 1)
        for name, n in seen.items():
            slots = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [name], "slots": pa.array([slots.tolist()], pa.list_(pa.int64())), "n": pa.array([n[slots].tolist()], pa.list_(pa.int64()))})

    taught = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = taught.mapInArrow(count, "lang string, slots array<bigint>, n array<bigint>")
    sums = counts.select("lang", F.explode(F.arrays_zip("slots", "n")).alias("x")).groupBy("lang", F.col("x.slots").alias("slot")).agg(F.sum("x.n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    table = np.zeros((len(languages), BUCKETS + OTHER + 1))
    if languages:
        table[np.searchsorted(languages, sums["lang"]), sums["slot"]] = sums["n"]
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    score = np.log(grams + PSEUDO_COUNT) - np.log(grams.sum(1, keepdims=True) + PSEUDO_COUNT * BUCKETS)
    candidate = (scripts / np.maximum(scripts.sum(1, keepdims=True), 1)).T >= SCRIPT_SHARE
    candidate[~candidate.any(1)] = True
    return Model(languages, score.astype(np.float32), candidate)


def word_scores(cut: Cut, model: Model) -> np.ndarray:
    """Words x languages: log-probabilities below the best candidate's, floored; -inf for all but candidates."""
    out = np.empty((len(cut.script), len(model.languages)), np.float32)
    for k in range(len(model.languages)):
        total = np.concatenate([[0.0], np.cumsum(model.score[k][cut.bucket], dtype=np.float64)])
        out[:, k] = total[cut.at[1:]] - total[cut.at[:-1]]
    candidate = model.candidate[cut.script]
    out[~candidate] = -np.inf
    out -= out.max(1, keepdims=True)
    return np.maximum(out, -WORD_LIMIT, out=out, where=candidate)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; words of text i are first[i]:first[i + 1]. All texts go in step."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    n_langs = scores.shape[1]
    index = np.min_scalar_type(max(n_langs - 1, 0))
    path = np.zeros(len(scores), index)
    if not len(scores) or n_langs == 1:
        return path
    stayed = np.zeros(scores.shape, bool)
    came = np.zeros(len(scores), index)
    live = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), "right")  # texts that have a word t
    last = np.zeros(len(counts), index)
    now = scores[begin[: live[0]]].astype(np.float64)
    for t in range(1, len(live)):
        n = live[t]
        if n < len(now):
            last[n : len(now)] = now[n:].argmax(1)
            now = now[:n]
        at = begin[:n] + t
        best = now.argmax(1)
        other = (now[np.arange(n), best] - switch)[:, None]
        stay = now >= other
        came[at], stayed[at] = best, stay
        now = np.where(stay, now, other) + scores[at]
    last[: len(now)] = now.argmax(1)
    state = last[: live[-1]]
    for t in range(len(live) - 1, -1, -1):
        at = begin[: live[t]] + t
        path[at] = state
        if t:
            state = np.where(stayed[at, state], state, came[at])
            state = np.concatenate([state, last[live[t] : live[t - 1]]])
    return path


def _scored(data: np.ndarray, bounds: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, first word of each text, and scores of the words of a run of texts."""
    starts, ends, scores, first = [], [], [], bounds * 0
    for offset, part, own in textkit.segments(data, bounds, _NO_LETTER):
        cut = cut_words(part, own)
        starts.append(cut.start + offset)
        ends.append(cut.end + offset)
        scores.append(word_scores(cut, model))
        first = first + cut.first
    return np.concatenate(starts), np.concatenate(ends), first, np.concatenate(scores)


def _label_run(data: np.ndarray, bounds: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Language and share of each text, its number of spans, and the spans' starts, ends and languages."""
    n, n_langs = len(bounds) - 1, len(model.languages)
    best, share, counts = np.full(n, n_langs), np.zeros(n), np.zeros(n, np.int64)
    nothing = np.zeros(0, np.int64)
    if not n_langs:
        return best, share, counts, (nothing, nothing, nothing)
    start, end, first, scores = _scored(data, bounds, model)
    if not len(start):
        return best, share, counts, (nothing, nothing, nothing)
    path = viterbi(scores, first)
    text = np.repeat(np.arange(n), np.diff(first))
    letters = np.bincount(text * n_langs + path, (end - start).astype(float), n * n_langs).reshape(n, n_langs)
    total = letters.sum(1)
    lettered = total > 0
    plain = np.concatenate([[0], np.cumsum(~_NO_LETTER[data] & (data < 0x80))])
    for i in np.flatnonzero(lettered & (plain[bounds[1:]] == plain[bounds[:-1]])):
        lettered[i] = any(c.isalpha() for c in data[bounds[i] : bounds[i + 1]].tobytes().decode())
    best[lettered] = letters[lettered].argmax(1)
    share[lettered] = letters[lettered].max(1) / total[lettered]
    begins = np.ones(len(path), bool)
    begins[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
    stops = np.flatnonzero(np.concatenate([begins[1:], [True]]))
    at = np.flatnonzero(begins)
    kept = lettered[text[at]]
    at, stops = at[kept], stops[kept]
    counts = np.bincount(text[at], minlength=n)
    return best, share, counts, (start[at] - bounds[text[at]], end[stops] - bounds[text[at]], path[at].astype(np.int64))


def _label(shared):
    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: Model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for column in columns:
            # Texts of like length together: those of a run go through Viterbi's steps side by side.
            order = np.argsort(pc.fill_null(pc.binary_length(column), 0).to_numpy(), kind="stable")
            runs = [_label_run(data, bounds, model) for _, _, data, bounds in textkit.text_chunks(column.take(pa.array(order)), LABEL_BYTES)]
            every = lambda k, kind, runs=runs: np.concatenate([np.zeros(0, kind), *[r[k] for r in runs]]).astype(kind)
            begin, end, lang = (np.concatenate([np.zeros(0, np.int64), *[r[3][k] for r in runs]]) for k in range(3))
            spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(end), pa.array(names[lang], pa.string())], names=["start", "end", "lang"])
            bounds_of = np.concatenate([[0], np.cumsum(every(2, np.int64))])
            found = pa.StructArray.from_arrays([pa.array(names[every(0, np.int64)], pa.string()), pa.array(every(1, np.float64)), pa.ListArray.from_arrays(pa.array(bounds_of, pa.int32()), spans)], names=["lang", "score", "spans"])
            yield found.take(pa.array(np.argsort(order, kind="stable")))

    return F.arrow_udf(label, "lang string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>").asNondeterministic()


def identify(docs: DataFrame, model: Model, into: str = "language") -> DataFrame:
    """Add ``into``: a struct of lang, score (share of the letters' bytes) and spans (byte offsets and lang).

    Null texts, empty ones and those without a letter are ``und`` with score 0 and no span, and so are
    all texts under a model without languages. Ties go to the language first in order of names. Long
    texts are labelled whole. Only the text decides, so repeated rows get the same; an empty table gives
    an empty one. A column of ``docs`` named ``into`` is replaced.
    """
    label = _label(docs.sparkSession.sparkContext.broadcast(model))
    return docs.withColumn(into, label(F.col("text").cast("string")))


def learning(key: Column) -> Column:
    """Rows whose text and lang may be learned from: all but every third by crc32 of the key."""
    return remainder(key, 3) != 1


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents with a language, whatever its share of the letters; texts without letters are rejected.

    Where no row has both a text and a lang to learn from, nothing can be identified, and all texts
    with letters stay. Null and empty texts go. Rows are judged each for itself, repeated ones alike;
    all columns are kept. An empty table gives an empty one.
    """
    model = train(docs.filter(learning(F.col("doc_id"))))
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    into = free("language_", docs)
    found = identify(docs, model, into)
    return found.filter(F.col(into)["lang"] != UNKNOWN).select(*docs.columns)


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.filter(learning(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~learning(F.col("doc_id"))).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
