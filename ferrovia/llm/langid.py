"""Language labels for spans of text.

A word is a run of letters and marks. Script ranges narrow the languages that a
word can be in: only those that the scripts of a text admit are scored and carried through Viterbi. A word's score is the
log-likelihood of its byte trigrams and of the word; Viterbi over the words of a whole text, with a penalty for a switch, labels spans. A
text's language is the one that labels most of its letters. A long text goes by in windows: what Viterbi knows at each window's start is
kept on the way there, and the windows are labelled on the way back.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv

#: Documents of each language, and of all, from which the classifier learns, about (a hash picks them). Every language teaches.
DOCS_PER_LANGUAGE, DOCS_IN_ALL = 3000, 150_000
TRIGRAMS = 1 << 15
WORDS = 1 << 15
SWITCH = 15.0
SMOOTH = 0.3
#: Share of a language's words in a script from which the script admits the language.
SCRIPT_SHARE = 0.001
#: Words of a block, and those before it from which it starts.
BLOCK, WARM = 256, 32
#: Bytes of a text that are scored at once, and trigrams.
WINDOW, GRAMS = 1 << 20, 1 << 16
#: Scripts and their ranges of Unicode code points. A letter of none of these is of `other`.
RANGES = {
    "latin": ((0x41, 0x24F), (0x250, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F), (0xFB13, 0xFB17)),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "oriya": ((0xB00, 0xB7F),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "myanmar": ((0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
    "ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)),
    "khmer": ((0x1780, 0x17FF),),
    "mongolian": ((0x1800, 0x18AF),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "han": ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
#: A character's kind: 0 is in no word, a mark goes on with a word of any script.
KINDS = ("", "mark", *RANGES, "other")


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point: letters by script, marks, and 0 for all else, digits and punctuation too."""
    out = np.zeros(0x110000, np.uint8)
    script = np.full(0x110000, KINDS.index("other"), np.uint8)
    for name, spans in RANGES.items():
        for a, b in spans:
            script[a : b + 1] = KINDS.index(name)
    for point in range(0x323B0):  # there are no letters beyond
        category = unicodedata.category(chr(point))[0]
        if category == "L":
            out[point] = script[point]
        elif category == "M":
            out[point] = 1
    out[0xE0100:0xE01F0] = 1  # variation selectors
    return out


def kinds(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the kind of the character that it is a part of."""
    table = _kinds()
    out = np.where(data < 128, table[data], 0).astype(np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.append(data, np.zeros(3, np.uint8))
        first = padded[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for i in (1, 2, 3):
            point = np.where(size > i, point << 6 | (padded[lead + i] & 0x3F), point)
        kind = table[np.minimum(point, 0x10FFFF)]
        for i in (0, 1, 2, 3):
            at, own = lead[size > i] + i, kind[size > i]
            out[at[at < len(data)]] = own[at < len(data)]
    return out


_GRAM = np.arange(256, dtype=np.uint32)
_GRAM[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends, first, places of letters, their trigrams' buckets, words' buckets, scripts)."""
    kind = kinds(data)
    starts, ends, first = tv.runs(kind > 0, offsets)
    grams = np.full(len(data) + 2, 32, np.uint32)
    grams[1:-1] = np.where(kind > 0, _GRAM[data], np.uint32(32))
    at = np.flatnonzero(kind)
    tri = grams[at] * np.uint32(65599) ^ grams[at + 1] * np.uint32(2654435761) ^ grams[at + 2] * np.uint32(40503 * 97)
    tri = (tri ^ (tri >> np.uint32(15))) % np.uint32(TRIGRAMS)
    word = (tv.segment_hashes(tv.LOWER[data], starts, ends) % np.uint64(WORDS)).astype(np.int64) + TRIGRAMS
    # a word's script: the last in KINDS of those of its letters, so any other goes before Latin
    script = np.maximum.reduceat(kind, starts) if len(starts) else np.zeros(0, np.uint8)
    return starts, ends, first, at, tri.astype(np.int64), word, script


class Model:
    """Log-likelihoods by bucket and language, and the languages that each script admits."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: (TRIGRAMS + WORDS, languages); scripts: (len(KINDS), languages) of words."""
        self.languages = languages
        tri, word = counts[:TRIGRAMS] + SMOOTH, counts[TRIGRAMS:] + SMOOTH
        logs = np.concatenate([np.log(tri / tri.sum(0)), np.log(word / word.sum(0))])
        self.logs = (logs - logs.mean(1, keepdims=True)).astype(np.float32)
        self.admitted = scripts > SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
        self.admitted[~self.admitted.any(1)] = True

    def candidates(self, script: np.ndarray) -> np.ndarray:
        """The languages that one of these scripts admits."""
        return np.flatnonzero(self.admitted[np.unique(script)].any(0))

    def scores(self, starts, ends, at, tri, word, script, of: np.ndarray | None = None) -> np.ndarray:
        """(words, languages): of those in `of`, or of all; barred where the word's script doesn't admit one."""
        of = np.arange(len(self.languages)) if of is None else of
        if not len(starts):
            return np.zeros((0, len(of)), np.float32)
        logs = self.logs if len(of) == len(self.languages) else np.ascontiguousarray(self.logs[:, of])
        out = logs[word] + np.where(self.admitted[:, of], np.float32(0), np.float32(-1e4))[script]
        inner = np.searchsorted(at, starts)
        step = max(1, GRAMS // max(1, len(of) // 16))
        for i in range(0, len(tri), step):  # a word may go on in the next piece
            first, last = np.searchsorted(inner, i, "right") - 1, np.searchsorted(inner, min(i + step, len(tri)))
            out[first:last] += np.add.reduceat(logs[tri[i : i + step]], np.maximum(inner[first:last] - i, 0), axis=0)
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word, texts being runs of words from first[i] to first[i + 1]."""
    return viterbi_between(scores, first, switch)[0]


def _forward(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, v: np.ndarray, switch: float, stays: np.ndarray | None = None, jumps: np.ndarray | None = None) -> np.ndarray:
    """What is known of each label at the end of runs of words, from what was before them (v). Where a word's label stayed, and
    from which one it jumped, goes to stays and jumps."""
    order = np.argsort(-length, kind="stable")
    begin, length, v = begin[order], length[order], v[order].astype(np.float32)
    for t in range(int(length.max(initial=0))):
        m = int(np.searchsorted(-length, -t, "left"))
        x, at = v[:m], begin[:m] + t
        best = x.argmax(1)
        jump = (x[np.arange(m), best] - np.float32(switch))[:, None]
        if stays is not None:
            jumps[at], stays[at] = best, np.packbits(x >= jump, axis=1)
        np.maximum(x, jump, out=x)
        x += scores[at]
        x -= x.max(1, keepdims=True)
    out = np.empty_like(v)
    out[order] = v
    return out


def _backward(label: np.ndarray, at: np.ndarray, stays: np.ndarray, jumps: np.ndarray) -> np.ndarray:
    """The labels before words that have these labels (one for each word, or several)."""
    rows = at if label.ndim == 1 else at[:, None]
    stay = (stays[rows, label >> 3] >> (7 - (label & 7)).astype(np.uint8)) & 1
    return np.where(stay == 1, label, jumps[rows])


def viterbi_between(scores: np.ndarray, first: np.ndarray, switch: float, start: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """viterbi() of texts that something precedes, with what is known of each language there (start), and that end in a known
    language (end); and what is known of each language at their end, and the language before them.

    Texts are cut into blocks that run side by side, each from what WARM words before it tell. A block
    that starts from something else than the one before it ended in runs again from that, until all agree; then
    it makes no difference where they began. Back again, each block says what every label at its end leads to before it.
    """
    n, k = scores.shape
    counts = np.diff(first)
    start = np.zeros((len(counts), k), np.float32) if start is None else start.astype(np.float32)
    blocks = -(-counts // BLOCK)
    begin_of = np.concatenate(([0], np.cumsum(blocks)))
    text = np.repeat(np.arange(len(counts)), blocks)
    number = np.arange(begin_of[-1]) - begin_of[text]
    begin = first[:-1][text] + number * BLOCK
    length = np.minimum(BLOCK, first[1:][text] - begin)
    stays, jumps = np.zeros((n, (k + 7) // 8), np.uint8), np.zeros(n, np.int16 if k < 1 << 15 else np.int32)
    warm = np.minimum(WARM, begin - first[:-1][text])
    v = np.where((warm == number * BLOCK)[:, None], start[text], np.float32(0))
    v = _forward(scores, begin - warm, warm, v, switch)
    # all that later words see of it: how far labels lie below the best, a switch at most
    seen = lambda x: np.maximum(x - x.max(1, keepdims=True), np.float32(-switch))
    alpha = _forward(scores, begin, length, v, switch, stays, jumps)
    later = np.flatnonzero(number > 0)
    while len(later):
        later = later[np.abs(seen(v[later]) - seen(alpha[later - 1])).max(1) > 1e-3]
        v[later] = alpha[later - 1]
        alpha[later] = _forward(scores, begin[later], length[later], v[later], switch, stays, jumps)
        later = later[later + 1 < len(number)] + 1
        later = later[number[later] > 0]
    # what each label at a block's end leads to before the block
    order = np.argsort(-length, kind="stable")
    leads = np.tile(np.arange(k), (len(order), 1))
    for t in range(int(length.max(initial=0)) - 1, -1, -1):
        m = int(np.searchsorted(-length[order], -t, "left"))
        leads[:m] = _backward(leads[:m], begin[order[:m]] + t, stays, jumps)
    of = np.empty_like(leads)
    of[order] = leads
    last = start.copy()
    held = np.flatnonzero(blocks)
    last[held] = alpha[begin_of[held + 1] - 1]
    entry = (last.argmax(1) if end is None else end).astype(np.int64)
    after = np.zeros(len(number), np.int64)
    for j in range(int(blocks.max(initial=0)) - 1, -1, -1):
        own = np.flatnonzero(blocks > j)
        after[begin_of[own] + j] = entry[own]
        entry[own] = of[begin_of[own] + j, entry[own]]
    out, label = np.zeros(n, np.int64), after[order]
    for t in range(int(length.max(initial=0)) - 1, -1, -1):
        m = int(np.searchsorted(-length[order], -t, "left"))
        at = begin[order[:m]] + t
        out[at] = label[:m]
        label[:m] = _backward(label[:m], at, stays, jumps)
    return out, last, entry


def windows(data: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """A text cut where no word is: pieces of about `size` bytes, longer only where a word is."""
    i = 0
    while len(data) - i > size:
        j, step = 0, size
        while not j and i + step < len(data):
            part = data[i : i + step]
            open_ = np.flatnonzero((kinds(part)[:-4] == 0) & ((part[1:-3] & 0xC0) != 0x80))
            j, step = (int(open_[-1]) + 1 if len(open_) else 0), 2 * step
        if not j:
            break
        yield i, i + j
        i += j
    yield i, len(data)


def _scored(model: Model, data: np.ndarray, found: tuple, of: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """model.scores() of the chosen words, each different one scored once."""
    starts, ends, _, _, tri, word, script = found
    _, one, back = np.unique(tv.segment_hashes(tv.LOWER[data], starts[chosen], ends[chosen]), return_index=True, return_inverse=True)
    one = chosen[one]
    size = ends - starts
    begin, length = (np.cumsum(size) - size)[one], size[one]
    stop = np.cumsum(length)
    grams = np.repeat(begin - (stop - length), length) + np.arange(int(length.sum()))
    return model.scores(stop - length, stop, np.arange(len(grams)), tri[grams], word[one], script[one], of)[back.ravel()]


def labelled(model: Model, data: np.ndarray, offsets: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, labels, bytes of letters) of the words of texts; a text of more than WINDOW bytes comes alone."""
    if len(offsets) == 2 and len(data) > WINDOW:
        return _labelled_long(model, data, switch)
    starts, ends, first, at, tri, word, script = features(data, offsets)
    labels = np.zeros(len(starts), np.int64)
    # texts whose scripts admit the same languages go together
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    seen = np.zeros((len(offsets) - 1, len(KINDS)), bool)
    seen[own, script] = True
    sets, which = np.unique(np.packbits((seen.astype(np.uint8) @ model.admitted.astype(np.uint8)) > 0, axis=1), axis=0, return_inverse=True)
    of_word = which.ravel()[own]
    for g in range(len(sets)):
        chosen = np.flatnonzero(of_word == g)
        if len(chosen):
            of = model.candidates(script[chosen])
            edges = np.concatenate(([0], np.cumsum(np.diff(first)[which.ravel() == g])))
            labels[chosen] = of[viterbi(_scored(model, data, (starts, ends, first, at, tri, word, script), of, chosen), edges, switch)]
    return first, labels, ends - starts


def _labelled_long(model: Model, data: np.ndarray, switch: float, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cuts = list(windows(data, size))
    pieces = lambda i, j: features(data[i:j], np.array([0, j - i]))
    scripts = np.unique(np.concatenate([np.unique(pieces(i, j)[6]) for i, j in cuts]))
    of = model.candidates(scripts) if len(scripts) else np.arange(len(model.languages))

    def piece(i: int, j: int):
        found = pieces(i, j)
        return _scored(model, data[i:j], found, of, np.arange(len(found[0]))), found[2], found[1] - found[0]

    known = [np.zeros((1, len(of)), np.float32)]
    for i, j in cuts:
        scores, first, _ = piece(i, j)
        known.append(viterbi_between(scores, first, switch, known[-1])[1])
    end, labels, letters = known[-1].argmax(1), [], []
    for (i, j), start in zip(cuts[::-1], known[-2::-1], strict=True):
        scores, first, size = piece(i, j)
        got, _, end = viterbi_between(scores, first, switch, start, end)
        labels.append(of[got].astype(np.int32))
        letters.append(size)
    labels, letters = np.concatenate(labels[::-1]), np.concatenate(letters[::-1])
    return np.array([0, len(labels)]), labels.astype(np.int64), letters


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """The classifier, from docs (doc_id, text, lang) of which a hash of doc_id picks about
    docs_per_language for each language. Rows with a null among those do not teach. None if none do.

    Every value of lang teaches. What the driver gets is bounded by the sample (DOCS_IN_ALL documents, one of each language at least): for
    each language at most TRIGRAMS + WORDS counts; so is the model, 256 KB for each language."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    per_language = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r[0]: r[1] for r in per_language.collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    wanted = max(1, min(docs_per_language, DOCS_IN_ALL // len(languages)))
    draw = F.crc32(F.concat(F.lit("language:"), F.col("doc_id").cast("string")).cast("binary")) / F.lit(float(1 << 32))
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, wanted / sizes[l]))])
    sample = usable.where(draw < share[F.col("lang")]).select("lang", "text")
    width = TRIGRAMS + WORDS + len(KINDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return keys, np.bincount(back.ravel(), weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)

        for batch in batches:
            of = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for i, j, data, offsets in tv.texts(batch.column(1)):
                for a, b in windows(data) if j == i + 1 else ((0, len(data)),):
                    starts, ends, first, at, tri, word, script = features(data[a:b], offsets if j > i + 1 else np.array([0, b - a]))
                    own = np.repeat(of[i:j], np.diff(first)) * width
                    if len(starts):
                        keys = np.concatenate([own + word, own + TRIGRAMS + WORDS + script, np.repeat(own, ends - starts) + tri])
                        held.append(np.unique(keys, return_counts=True))
            if len(held) > 64:
                held[:] = [summed()]
        if held:
            keys, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32)), pa.array(n)], ["l", "b", "n"])

    rows = sample.mapInArrow(count, "l int, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return None
    table = np.zeros((width, len(languages)))
    table[rows["b"], rows["l"]] = rows["n"]
    return Model(languages, table[: TRIGRAMS + WORDS], table[TRIGRAMS + WORDS :])


LABEL = "struct<lang_pred:string,score:double,spans:array<struct<first:int,last:int,lang:string>>>"


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def label(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """(record, language): the columns of docs as a struct, and a struct of lang_pred, score and spans.

    docs needs text; other columns, whatever their names, are carried as they are. spans are runs of words (from
    0) of one language, score is the share of the letters' bytes that lang_pred labels. A null text or one
    without a letter is `und` with score 0 and no spans, and so is every text without a model. Ties go to the
    first language by name. Rows that repeat are kept; an empty table gives none.
    """
    spark = docs.sparkSession
    record = F.struct(*docs.columns).alias("record")
    if model is None:
        none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().alias("spans"))
        return docs.select(record, none.cast(LABEL).alias("language"))
    shared = spark.sparkContext.broadcast(model)
    text = F.when(has_letter(F.col("text")), F.col("text"))
    schema = T.StructType([T.StructField("record", T.StructType(docs.schema.fields)), *T.StructType.fromDDL(f"language {LABEL}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.languages)
        for batch in batches:
            for i, j, data, offsets in tv.texts(batch.column(1)):
                first, labels, size = labelled(m, data, offsets, switch)
                own = np.repeat(np.arange(j - i), np.diff(first))
                letters = np.bincount(own * k + labels, weights=size.astype(float), minlength=(j - i) * k).reshape(j - i, k)
                total = letters.sum(1)
                best = letters.argmax(1)
                score = np.where(total > 0, letters[np.arange(j - i), best] / np.maximum(total, 1), 0.0)
                pred = [m.languages[b] if t > 0 else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)]
                change = np.ones(len(labels), bool)
                change[1:] = (labels[1:] != labels[:-1]) | (own[1:] != own[:-1])
                begin = np.flatnonzero(change)
                end = np.append(begin[1:], len(labels)) - 1 if len(begin) else begin
                base = first[own[begin]] if len(begin) else begin
                runs = pa.StructArray.from_arrays(
                    [pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), pa.array([m.languages[x] for x in labels[begin].tolist()], pa.string())],
                    ["first", "last", "lang"],
                )
                edges = np.searchsorted(begin, first).astype(np.int32)
                own = pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(edges), runs)], ["lang_pred", "score", "spans"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), own], ["record", "language"])

    return docs.select(record, text.alias("text")).mapInArrow(run, schema)
