"""Language identification by a linear-chain conditional random field over words.

Words are labelled with languages by forward-backward over sentences, so a text may switch between languages. A word's features are
its affixes, its character n-grams (both hashed) and its entry in a lexicon of the training words; transitions between languages are
learned with them. Training maximises the likelihood of sentences of the sample and of mixtures of two sentences of different
languages, by Adam on exact gradients. A document gets the language with the largest mean posterior of its words, and that as its score.

The sample is bounded: about DOCS_PER_LANGUAGE documents of each language, chosen by hash, of at most SAMPLE_BYTES bytes each (the
prediction has no such limits). The model, a few MB, is broadcast. Distinct words of a batch are scored once. A chain ends where its
sentence does, however long that is. Chains of more than CHAIN words are computed in pieces of so many, all at a time: a piece's words
compose into one matrix from what enters it to what leaves it, messages pass from piece to piece through these, and then all pieces
go on side by side with the messages that enter them from both sides. The result is that of the whole chain.

Defined results: null, empty and letterless texts are `und` with score 0; so is everything if no document can be learned from. Of
languages with equal posteriors the alphabetically first wins. A null doc_id is neither learned from nor held out. Repeated rows are
rows like any other; extra columns stay; a column that has the name of an output is replaced."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrowtext import flat, map_texts
from tallyloom.llm.decontaminate import ragged
from tallyloom.llm.tables import table

DOCS_PER_LANGUAGE = 120
SAMPLE_BYTES = 30_000
BUCKETS = 1 << 16
#: Words of a piece of a chain.
CHAIN = 64
EPOCHS = 30
UND = "und"
#: Bytes of text in a batch: chains take about fifteen times as much memory.
BATCH = 2_500_000
#: Distinct words whose features are in memory at once.
BLOCK = 40_000

_LETTER = np.array([b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_ASCII = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_STOP = np.isin(np.arange(256), [*b".!?\n"])
_ANY_LETTER = regex.compile(r"\p{L}")


@dataclass
class Words:
    """Of a batch: distinct words (lower case), each word's number among them, each chain's first word and size, each document's first
    word."""

    distinct: pa.BinaryArray
    number: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    docs: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = _LOWER[data]
    upper = np.zeros(len(data), bool)  # U+00C0 to U+00DE
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[upper] += 0x20
    stops = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(stops), pa.py_buffer(low[inside])]).dictionary_encode()
    docs = np.searchsorted(begins, offsets)
    # a chain begins with a document and after a stop
    stop_before = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.ones(len(begins), bool)
    opens[1:] = stop_before[begins[1:]] != stop_before[ends[:-1]]
    opens[docs[:-1][docs[:-1] < len(begins)]] = True
    starts = np.flatnonzero(opens)
    sizes = np.diff(np.append(starts, len(begins)))
    return Words(coded.dictionary, coded.indices.to_numpy(), starts, sizes, docs)


def features(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of two and three bytes, prefixes and suffixes of one to three, of each word: buckets, and where each word's
    begin (each has one at least)."""
    data, offsets = flat(words)
    n, sizes = len(words), np.diff(offsets)
    marked = np.empty(len(data) + 2 * n, np.uint64)
    begins = offsets[:-1] + 2 * np.arange(n)
    ends = begins + sizes + 1
    marked[begins], marked[ends] = 1, 2
    marked[ragged(begins + 1, sizes)] = data
    owner = np.repeat(np.arange(n), sizes + 2)
    found, of = [], []

    def add(at: np.ndarray, width: int, kind: int) -> None:
        code = np.full(len(at), kind, np.uint64)
        for j in range(width):
            code = code * np.uint64(0x100000001B3) ^ marked[at + j]
        code ^= code >> np.uint64(29)
        found.append((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) % BUCKETS), of.append(owner[at])

    for width in (2, 3):
        at = np.arange(len(marked) - width + 1)
        add(at[owner[at] == owner[at + width - 1]], width, width)
    for width in (2, 3, 4):
        long = sizes + 2 >= width
        add(begins[long], width, 10 + width)
        add(ends[long] - width + 1, width, 20 + width)
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    return found[order], np.searchsorted(of[order], np.arange(n))


@dataclass
class Crf:
    """Languages, the lexicon, and the weights of buckets, lexicon entries (the last: of words outside), beginnings and transitions."""

    languages: list[str]
    lexicon: pa.BinaryArray
    hashed: np.ndarray
    known: np.ndarray
    first: np.ndarray
    step: np.ndarray

    def entries(self, words: pa.BinaryArray) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.lexicon), len(self.lexicon)).to_numpy(zero_copy_only=False)

    def scores(self, words: pa.BinaryArray) -> np.ndarray:
        """Emission scores of distinct words."""
        out = [np.zeros((0, len(self.languages)), np.float32)]
        for k in range(0, len(words), BLOCK):
            some = words.slice(k, BLOCK)
            found, starts = features(some)
            out.append(np.add.reduceat(self.hashed[found], starts, axis=0) + self.known[self.entries(some)])
        return np.concatenate(out)

    def posteriors(self, scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pairs: np.ndarray | None = None, piece: int = CHAIN) -> np.ndarray:
        """Forward-backward: each word's probabilities. Pieces of all chains go on together, one word a step. pairs: gets the sums of the
        probabilities of neighbours' labels."""
        local = np.exp(scores - scores.max(1, keepdims=True))
        step = np.exp(self.step - self.step.max()).astype(local.dtype)
        parts = -(-sizes // piece)
        k = ragged(np.zeros(len(starts), np.int64), parts)
        starts, sizes = np.repeat(starts, parts) + k * piece, np.minimum(piece, np.repeat(sizes, parts) - k * piece)
        enter, behind = messages(local, step, np.exp(self.first - self.first.max()).astype(local.dtype), starts, sizes, k)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, enter, behind, inner = starts[order], sizes[order], enter[order], behind[order], k[order] > 0
        longest = int(sizes[0]) if len(sizes) else 0
        live = np.searchsorted(-sizes, -np.arange(longest), "left")  # pieces of more than t words
        ahead = np.empty_like(local)
        for t in range(longest):
            at = starts[: live[t]] + t
            now = local[at] * (ahead[at - 1] @ step if t else enter)
            ahead[at] = now / now.sum(1, keepdims=True)
        out = ahead.copy()
        last = starts + sizes - 1
        both = ahead[last] * behind
        out[last] = both / both.sum(1, keepdims=True)
        for t in range(longest - 2, -2, -1):
            n = live[t + 1]
            at = starts[:n] + t
            if t < 0:  # pairs of the last word of a piece and the first of the next
                at, some = at[inner], inner
            else:
                some = slice(n)
            right = local[at + 1] * behind[some]
            if pairs is not None and len(at):
                joint = ahead[at][:, :, None] * step * right[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            if t >= 0:
                now = right @ step.T
                behind[:n] = now / now.sum(1, keepdims=True)
                both = ahead[at] * behind[:n]
                out[at] = both / both.sum(1, keepdims=True)
        return out


def messages(local: np.ndarray, step: np.ndarray, first: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each piece from the words before it and from those after it. place: a piece's number in its chain; the pieces of a
    chain lie in order, all but its last are full."""
    n, labels = len(starts), local.shape[1]
    ahead, behind = np.tile(first, (n, 1)), np.ones((n, labels), local.dtype)
    follows = np.append(place[1:] > 0, False) if n else np.zeros(0, bool)  # another piece of the chain follows
    whole = np.flatnonzero(follows | (place > 0))
    if not len(whole):
        return ahead, behind
    number = np.full(n, -1)
    number[whole] = np.arange(len(whole))
    made = np.tile(np.eye(labels), (len(whole), 1, 1))
    for t in range(int(sizes[whole].max())):
        on = np.flatnonzero(sizes[whole] > t)
        now = (made[on] @ step if t else made[on]) * local[starts[whole[on]] + t][:, None, :]
        made[on] = now / now.sum((1, 2), keepdims=True)
    by_place = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[by_place], np.arange(1, int(place.max()) + 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # pieces of the same number in all chains
        own = by_place[a:b]
        now = (ahead[own - 1][:, None, :] @ made[number[own - 1]])[:, 0] @ step
        ahead[own] = now / now.sum(1, keepdims=True)
    for a, b in zip(bounds[:-1][::-1], bounds[1:][::-1], strict=True):
        own = by_place[a:b]
        now = (made[number[own]] @ behind[own][:, :, None])[:, :, 0] @ step.T
        behind[own - 1] = now / now.sum(1, keepdims=True)
    return ahead, behind


def train(samples: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 7) -> Crf | None:
    """A field fitted to (language, text) pairs; None if no text has a word."""
    languages = sorted({lang for lang, _ in samples})
    words = read_words(*flat(pa.array([t for _, t in samples], pa.string())))
    if not len(words.number):
        return None
    of_doc = np.array([languages.index(lang) for lang, _ in samples])
    label = of_doc[np.searchsorted(words.docs, np.arange(len(words.number)), "right") - 1]
    # half of the chains are mixed: two of different languages in one
    rng, n = np.random.default_rng(seed), len(words.starts)
    mates = rng.permutation(n)
    mixed = np.flatnonzero(label[words.starts] != label[words.starts[mates]])
    first, second = mixed[mixed % 2 == 0], mates[mixed[mixed % 2 == 0]]
    size = np.concatenate([words.sizes, words.sizes[first] + words.sizes[second]])
    tokens = np.concatenate([ragged(words.starts, words.sizes), ragged(np.stack([words.starts[first], words.starts[second]], 1).ravel(), np.stack([words.sizes[first], words.sizes[second]], 1).ravel())])
    number, label, starts = words.number[tokens], label[tokens], np.concatenate([[0], np.cumsum(size)[:-1]])
    k = len(languages)
    found, begins = features(words.distinct)
    counts = np.diff(np.append(begins, len(found)))
    owner = np.repeat(np.arange(len(words.distinct)), counts)
    seen = np.bincount(words.number, minlength=len(words.distinct))
    lexicon = words.distinct.filter(pa.array(seen >= 3))
    model = Crf(languages, lexicon, np.zeros((BUCKETS, k), np.float32), np.zeros((len(lexicon) + 1, k), np.float32), np.zeros(k), np.zeros((k, k)))
    entry = model.entries(words.distinct)
    gold = np.zeros((len(words.distinct), k))
    np.add.at(gold, (number, label), 1)
    inner = np.ones(len(number), bool)
    inner[starts] = False
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    gold_first = np.bincount(label[starts], minlength=k)
    weights = [model.hashed, model.known, model.first, model.step]
    moments = [(np.zeros(w.shape), np.zeros(w.shape)) for w in weights]
    for epoch in range(1, epochs + 1):
        emission = np.add.reduceat(model.hashed[found], begins, axis=0) + model.known[entry]
        pairs = np.zeros((k, k))
        p = model.posteriors(emission[number].astype(np.float64), starts, size, pairs)
        expected = np.stack([np.bincount(number, p[:, c], len(words.distinct)) for c in range(k)], 1)
        off = gold - expected
        slopes = [
            np.stack([np.bincount(found, off[owner, c], BUCKETS) for c in range(k)], 1),
            np.stack([np.bincount(entry, off[:, c], len(lexicon) + 1) for c in range(k)], 1),
            gold_first - p[starts].sum(0),
            gold_pairs - pairs,
        ]
        for w, slope, (m, v) in zip(weights, slopes, moments, strict=True):
            slope = slope / len(number) - 1e-6 * w
            m *= 0.9
            m += 0.1 * slope
            v *= 0.99
            v += 0.01 * slope**2
            w += (0.15 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-9)).astype(w.dtype)
    return model


def held_out(doc: str = "doc_id") -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(wanted: int, count: int) -> int:
    """The largest of 63-bit hashes that draws about wanted of count documents."""
    return max(1, min((1 << 63) - 1, (wanted << 63) // count))


def fit(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> Crf | None:
    """A field learned from a bounded sample of the documents with a language that aren't held out."""
    usable = docs.where(F.col(doc).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc)).select(
        F.col(lang).alias("lang"), F.when(F.octet_length(text) <= SAMPLE_BYTES, F.col(text)).otherwise(F.left(text, F.lit(SAMPLE_BYTES // 4))).alias("text"), F.shiftrightunsigned(F.xxhash64(doc, text), 1).alias("draw")
    )
    sizes = usable.groupBy("lang").count().collect()
    if not sizes:
        return None
    limit = F.lit(-1)
    for row in sizes:
        limit = F.when(F.col("lang") == row["lang"], drawn(per_language, row["count"])).otherwise(limit)
    return train(sorted((r.lang, r.text) for r in usable.where(F.col("draw") <= limit).collect()))


def identify(docs: DataFrame, model: Crf | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            data, offsets = flat(batch.column("__text"))
            n = len(offsets) - 1
            best, score = np.full(n, -1), np.zeros(n)
            if own is not None:
                words = read_words(data, offsets)
                if len(words.number):
                    p = own.posteriors(own.scores(words.distinct)[words.number], words.starts, words.sizes)
                    total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0, dtype=np.float64)])
                    counts = np.diff(words.docs)
                    share = (total[words.docs[1:]] - total[words.docs[:-1]]) / np.maximum(counts, 1)[:, None]
                    ascii_before = np.concatenate([[0], np.cumsum(_ASCII[data])])[offsets]
                    lettered = (counts > 0) & (np.diff(ascii_before) > 0)
                    for k in np.flatnonzero((counts > 0) & ~lettered):
                        lettered[k] = bool(_ANY_LETTER.search(data[offsets[k] : offsets[k + 1]].tobytes().decode()))
                    best[lettered] = share[lettered].argmax(1)
                    score[lettered] = np.clip(share[lettered].max(1), 0, 1)
            names = [*(own.languages if own else []), UND]
            return [pa.array([names[k] for k in best]), pa.array(score)]

        return work

    return map_texts(docs, text, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep, limit=BATCH)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
