"""Subject areas of documents, by latent semantic analysis over the whole corpus.

All is worked out over the different texts, so that copies count once, and given to every document that has the text.
Every text is cut into sentences, every sentence into terms (words and word pairs; runs of letters in scripts
without blanks), numbered in 63 bits and counted exactly by language. Those that are frequent enough make the columns. Terms are weighted by how few different texts of their language
have them, smoothly, so that none is without weight for being common; block power iteration over all documents gives the leading singular vectors (truncated decomposition).
A sentence's place is the weighted sum of its terms' places. Seeds are the centroids, per area and language, of
sentences of labelled documents. Then, over all documents, sentences go to the centroid of the largest cosine,
centroids move to the mean of their sentences, and terms that are not typical of any area lose weight. A document is
about an area that at least two of its sentences go to.

What is gathered from the corpus is columns x rank and columns x areas. With t terms in a document on average, at most
t / LEAST_PART terms of a language are in LEAST_PART of its documents, so columns don't grow with their number.
Labels are used for the seeds only, of at most LABELLED documents. Null and blank documents have no area, nor have
documents whose language has no labelled example of it; an empty label table gives no area at all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.llm.sentences import Openings, fit, split_shown
from notelode.session import cut, spread

#: Leading vectors; most turns of the power iteration and rounds of refining, each of which ends once it stands still.
RANK, TURNS, ROUNDS = 128, 3, 3
#: Part of a basis or of centroids that two in a row must share to be one.
STILL = 0.98
#: Tasks of a pass that sums up, for each task slot; bytes of the pieces in which sums are shuffled and reach the driver.
TASKS, PIECE = 4, 1 << 18
#: Labelled documents used for the seeds.
LABELLED = 50_000
#: Weight of a term is ln(1 + x / e^BEND), x being texts over texts with it: small for common terms, never 0.
BEND = 1.7
#: Terms of fewer documents don't count: LEAST, less where the language has few (FEW is the part), more where it has many.
LEAST, FEW, LEAST_PART = 3, 0.15, 0.0005
#: Least cosine; least weight of a sentence, as a part of its language's 70 % quantile; least part of it in the subspace.
COSINE, HEAVY, SHARE = 0.4, 0.25, 0.03
#: Sentences that make an area.
SENTENCES = 2
#: Documents worked on at a time in a task; sentences placed by one product of matrices.
CHUNK, BLOCK = 256, 48

LANGUAGES = ("vi", "en", "de", "fr", "zh", "ja", "th")
# Small words that tell languages apart, bare.
_SMALL = {
    0: set("va la khong cua duoc truoc sau ngay lan nhom voi trong cho theo co thi nay hom qua so muc ve".split()),
    1: set("the of was is really new asked gave and for there with also we is from by came who see".split()),
    2: set("der die das und ist siehe am seit eine ein bei seit von mit wurde auch war auf".split()),
    3: set("faut il croire le la les rien de mme des une est avec aussi et sur pour depuis avant voir selon".split()),
}
_VIETNAMESE = re.compile("[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịĩọỏõốồổỗộớờởỡợụủũứừửữựỳỵỷỹ]", re.I)
_WORDS = re.compile("[a-z]+")
_BINS, _STEP = 1000, 0.05


def language(shown: str, text: str) -> int:
    """Number of a sentence's language, -1 if it doesn't tell."""
    if not shown.isascii():
        if re.search("[฀-๿]", shown):
            return 6
        if re.search("[ぁ-ヿ]", shown):
            return 5
        if re.search("[一-鿿]", shown):
            return 4
    if _VIETNAMESE.search(text):
        return 0
    words = set(_WORDS.findall(shown.lower()))
    found = [len(words & _SMALL[k]) for k in range(4)]
    return found.index(max(found)) if any(found) else -1


_MASK = (1 << 63) - 1


class _Numbers(dict):
    """A number for each string, worked out when it is first met; starts over when it holds too many."""

    def __missing__(self, x: str) -> int:
        if len(self) > 300_000:
            self.clear()
        n = self[x] = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) & _MASK
        return n


_NUMBER = _Numbers()
_WORD, _THAI, _HAN = re.compile("[a-z]{2,}"), re.compile("[฀-๿]{4,}"), re.compile("[぀-鿿]{2,}")


def terms(shown: str) -> list[int]:
    """Numbers of a sentence's terms: words and pairs of words, runs of four Thai or two Chinese or Japanese letters."""
    return _numbered([shown])[1].tolist()


def _numbered(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many terms each sentence has, and the numbers of those of all, each sentence's in order."""
    words: list[str] = []
    counts, runs, at = [], [], []
    for i, shown in enumerate(sentences):
        s = shown.lower()
        found = _WORD.findall(s)
        words += found
        counts.append(len(found))
        if not s.isascii():
            for length, pattern in ((4, _THAI), (2, _HAN)):
                for run in pattern.findall(s):
                    runs += [_NUMBER[run[k : k + length]] for k in range(len(run) - length + 1)]
            at += [i] * (len(runs) - len(at))
    word = np.fromiter(map(_NUMBER.__getitem__, words), np.int64, len(words))
    of = np.repeat(np.arange(len(sentences)), counts)
    inside = of[1:] == of[:-1]
    pairs = (word[:-1].astype(np.uint64) * np.uint64(31) + word[1:].astype(np.uint64)) & np.uint64(_MASK)
    number = np.concatenate([word, pairs.astype(np.int64)[inside], np.array(runs, dtype=np.int64)])
    of = np.concatenate([of, of[1:][inside], np.array(at, dtype=np.int64)])
    if not len(number):
        return np.zeros(len(sentences), dtype=np.int64), number
    order = np.lexsort((number, of))
    number, of = number[order], of[order]
    on = _heads(of, number)
    return np.bincount(of[on], minlength=len(sentences)), number[on]


def _nested(counts: list[int] | np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _analysed(openings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Languages and terms of each sentence; openings is the shared table of how sentences open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = openings.value
        for b in batches:
            yield from _sentences(b, known)

    return run


def _sentences(b: pa.RecordBatch, known) -> Iterator[pa.RecordBatch]:
    if b.num_rows:
        for i in range(0, b.num_rows, 1000):
            part = b.slice(i, 1000)
            sentences, langs, said = [], [], []
            for t in part.column(1).to_pylist():
                parts = split_shown(t, known) if t else []
                own = [language(shown, t[x:y]) for x, y, shown in parts]
                # A sentence that doesn't tell is in the language of most others that are written in Latin letters.
                votes = np.bincount([x for x in own if 0 <= x < 4] or [0], minlength=4)
                langs += [x if x >= 0 else int(votes.argmax()) for x in own]
                sentences.append(len(parts))
                said += [shown for _, _, shown in parts]
            sizes, numbers = _numbered(said)
            made = _nested(sentences, _nested(sizes, pa.array(numbers)))
            # Languages of each text in which there are terms.
            found = np.zeros((len(sentences), len(LANGUAGES)), dtype=bool)
            on = sizes > 0
            found[np.repeat(np.arange(len(sentences)), sentences)[on], np.array(langs, dtype=np.int64)[on]] = True
            spoken = _nested(found.sum(1), pa.array(np.nonzero(found)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), spoken, _nested(sentences, pa.array(langs, pa.int32())), made], ["h", "copies", "spoken", "langs", "terms"]
            )


Arrays = dict[str, np.ndarray]


def _summed(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Arrays]) -> Arrays:
    """Sum of what each task makes, in pieces: a task sums up some of them, and no message to the driver holds more than one.

    There are at most TASKS results for each slot, however large the table, so what is shuffled doesn't grow with it.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    names, shape = ["name", "at", "shape", "type", "made"], "name string, at bigint, shape string, type string, made binary"

    def packed(name: str, at: int, whole: str, a: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, at, whole, a.dtype.str, a.tobytes())], names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, a in run(batches).items():
            flat = a.reshape(-1)
            for at in range(0, len(flat), PIECE // 8):
                yield packed(name, at, " ".join(map(str, a.shape)), flat[at : at + PIECE // 8])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[str, int, str], np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                a = np.frombuffer(r["made"], dtype=r["type"])
                a = a.astype(np.int64) if a.dtype == np.int32 else a
                key = r["name"], r["at"], r["shape"]
                out[key] = out[key] + a if key in out else a
        for key, a in out.items():
            yield packed(*key, a)

    parts = df.coalesce(TASKS * slots).mapInArrow(first, shape)
    made: Arrays = {}
    for r in parts.repartition(slots, "name", "at").mapInArrow(more, shape).collect():
        a = np.frombuffer(r["made"], dtype=r["type"])
        if r["name"] not in made:
            made[r["name"]] = np.zeros([int(x) for x in r["shape"].split()], dtype=a.dtype)
        made[r["name"]].reshape(-1)[r["at"] : r["at"] + len(a)] = a
    return made


class _Chunk:
    """Some documents: flat arrays of their sentences' documents and languages, and of their terms' sentences and columns."""

    def __init__(self, batch: pa.RecordBatch, sentences: np.ndarray, lang: np.ndarray, sizes: np.ndarray, column: np.ndarray):
        self.batch, self.n = batch, batch.num_rows
        self.doc, self.lang = np.repeat(np.arange(self.n), sentences), lang
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.copies, self.column = batch.column("copies").to_numpy(), column

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, language, column) of each distinct one, in that order."""
        row = self.doc[self.owner] * len(LANGUAGES) + self.lang[self.owner]
        order = np.lexsort((self.column, row))
        row, column = row[order], self.column[order]
        on = _heads(row, column) if len(row) else row
        row = row[on]
        return row // len(LANGUAGES), row % len(LANGUAGES), column[on]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, CHUNK):
            yield b.slice(i, CHUNK)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Documents with the numbers of their terms."""
    for b in _slices(batches):
        langs, terms_ = b.column("langs"), b.column("terms")
        each = terms_.flatten()
        yield _Chunk(b, np.diff(langs.offsets.to_numpy()), langs.flatten().to_numpy().astype(np.int64), np.diff(each.offsets.to_numpy()), each.flatten().to_numpy())


def _bytes(column: pa.BinaryArray) -> tuple[np.ndarray, memoryview]:
    """Lengths of binary values, and all of them in a row."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets), memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Documents with the columns of their terms, as _encoder packs them."""
    for b in _slices(batches):
        sentences, langs = _bytes(b.column("langs"))
        sizes = np.frombuffer(_bytes(b.column("sizes"))[1], dtype=np.int32)
        columns = _bytes(b.column("columns"))[1]
        wide = len(columns) > 2 * sizes.sum()
        yield _Chunk(b, sentences, np.frombuffer(langs, dtype=np.int8).astype(np.int64), sizes, np.frombuffer(columns, dtype=np.int32 if wide else np.uint16).astype(np.int64))


def _ranks(column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different columns in order, and which of them each one is."""
    there, rank = np.zeros(width, dtype=bool), np.empty(width, dtype=np.int64)
    there[column] = True
    found = np.flatnonzero(there)
    rank[found] = np.arange(len(found))
    return found, rank[column]


def _heads(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = x[1:] != x[:-1]
    for y in more:
        new |= y[1:] != y[:-1]
    return np.flatnonzero(np.r_[True, new])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and documents by language and term, summed up over about a million entries at a time."""
    names = ["lang", "term", "texts", "documents"]
    made: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if made:
            lang, term, copies = (np.concatenate(x) for x in zip(*made))
            made.clear()
            order = np.lexsort((term, lang))
            lang, term, copies = lang[order], term[order], copies[order]
            heads = _heads(lang, term)
            texts = np.diff(np.r_[heads, len(lang)])
            columns = [lang[heads].astype(np.int32), term[heads], texts.astype(np.int64), np.add.reduceat(copies, heads)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    waiting = 0
    for c in _read(batches):
        doc, lang, term = c.distinct()
        if len(doc):
            made.append((lang, term, c.copies[doc]))
            waiting += len(doc)
        if waiting > 1_000_000:
            yield from flush()
            waiting = 0
    yield from flush()


def _encoder(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Terms to their columns, those without one left out; shared has the sorted terms.

    Languages and numbers of terms of a text's sentences and the columns are packed, each into one value, so that the
    passes that follow take them up as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        kind = np.uint16 if len(known) <= 1 << 16 else np.int32

        def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * values.itemsize
            return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])

        for b in _slices(batches):
            outer = b.column("terms")
            inner = outer.flatten()
            term = inner.flatten().to_numpy()
            column = np.minimum(np.searchsorted(known, term), len(known) - 1)
            on = known[column] == term
            sentences = np.diff(outer.offsets.to_numpy())
            sizes = np.bincount(np.repeat(np.arange(len(inner)), np.diff(inner.offsets.to_numpy()))[on], minlength=len(inner))
            each = np.bincount(np.repeat(np.arange(len(outer)), sentences), weights=sizes, minlength=len(outer)).astype(np.int64)
            langs = b.column("langs").flatten().to_numpy().astype(np.int8)
            made = [packed(langs, sentences), packed(sizes.astype(np.int32), sentences), packed(column[on].astype(kind), each)]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("copies"), *made], ["h", "copies", "langs", "sizes", "columns"])

    return run


class _Space:
    """Places of sentences, given the weights of terms and the basis."""

    def __init__(self, weight: np.ndarray, typical: np.ndarray | float, basis: np.ndarray, scale: np.ndarray):
        self.weight, self.basis, self.scale = (weight * typical).astype(np.float32), basis, scale

    def place(self, c: _Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every sentence of a chunk: unit vector, weight, share in the subspace."""
        w = self.weight[c.lang[c.owner], c.column]
        out = np.zeros((len(c.lang), self.basis.shape[1]), dtype=np.float32)
        # Sentences that stand together share many terms: the block of their terms is small enough to be a full matrix.
        for i in range(0, len(out), BLOCK):
            j = min(i + BLOCK, len(out))
            a, b = c.start[i], c.start[j]
            if a < b:
                columns, at = _ranks(c.column[a:b], len(self.basis))
                block = np.zeros((j - i, len(columns)), dtype=np.float32)
                block[c.owner[a:b] - i, at] = w[a:b]
                np.matmul(block, self.basis[columns], out=out[i:j])
        heavy = np.sqrt(np.bincount(c.owner, weights=w.astype(np.float64) ** 2, minlength=len(c.lang)))
        share = np.linalg.norm(out, axis=1) / np.maximum(heavy, 1e-9)
        out *= self.scale
        out /= np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]
        return out, heavy, share


def _unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=-1, keepdims=True), 1e-9)


def _assigned(space: _Space, centroids: np.ndarray, least: np.ndarray, c: _Chunk):
    """Sentences that go to an area: document, language, vector, area."""
    v, heavy, share = space.place(c)
    on = np.flatnonzero((heavy > least[c.lang]) & (share > SHARE))
    doc, lang, v = c.doc[on], c.lang[on], v[on]
    score = np.full((len(on), centroids.shape[1]), -1.0, dtype=np.float32)
    for k in np.unique(lang):
        score[lang == k] = v[lang == k] @ centroids[k].T.astype(np.float32)
    best = score.argmax(1)
    ok = score[np.arange(len(best)), best] > COSINE
    return doc[ok], lang[ok], v[ok], best[ok]


def _about(n: int, areas: int, doc: np.ndarray, best: np.ndarray) -> np.ndarray:
    """n x areas: whether enough sentences of a document go to an area."""
    return np.bincount(doc * areas + best, minlength=n * areas).reshape(n, areas) >= SENTENCES


_READ = "h binary, copies bigint, spoken array<int>, langs array<int>, terms array<array<bigint>>"
_PACKED = "h binary, copies bigint, langs binary, sizes binary, columns binary"


@dataclass(frozen=True)
class Model:
    """What is learned from a corpus: how sentences open, terms with their weights and places, and the areas' centroids."""

    names: list[str]
    openings: Openings
    columns: np.ndarray
    weight: np.ndarray
    typical: np.ndarray
    basis: np.ndarray
    scale: np.ndarray
    centroids: np.ndarray
    heavy: np.ndarray


def _analyse(documents: DataFrame, key: str, text: str, openings: Openings | None) -> tuple[DataFrame, DataFrame, Openings]:
    """Keys with their texts' digests; the sentences' languages and terms of every different text; how sentences open."""
    src = spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t")))
    digest = F.unhex(F.md5("t")).alias("h")
    texts = src.filter("t IS NOT NULL").groupBy("t").agg(F.count(F.lit(1)).alias("copies")).select(digest, "t", "copies")
    openings = fit(src, "t") if openings is None else openings
    shared = documents.sparkSession.sparkContext.broadcast(openings)
    read = cut(texts.mapInArrow(_analysed(shared), _READ))
    return src.filter("t IS NOT NULL").select("k", digest), read, openings


def _encode(read: DataFrame, columns: np.ndarray) -> DataFrame:
    shared = read.sparkSession.sparkContext.broadcast(columns)
    kept = cut(spread(read.select("h", "copies", "langs", "terms")).mapInArrow(_encoder(shared), _PACKED))
    shared.destroy()
    return kept


def _areas(keys: DataFrame, key: str, rows: DataFrame, model: Model) -> DataFrame:
    parts = (model.weight, model.typical, model.basis, model.scale), model.centroids, model.heavy
    shared = keys.sparkSession.sparkContext.broadcast(parts)
    names = model.names

    def found(batches):
        parts, centre, e = shared.value
        space = _Space(*parts)
        for c in _chunks(batches):
            doc, _, _, best = _assigned(space, centre, e, c)
            i, a = np.nonzero(_about(c.n, len(names), doc, best))
            subject = pa.array([names[x] for x in a], pa.string())
            yield pa.RecordBatch.from_arrays([c.batch.column("h").take(pa.array(i)), subject], ["h", "subject"])

    return keys.join(rows.mapInArrow(found, "h binary, subject string"), "h").select(F.col("k").alias(key), "subject")


def _empty(documents: DataFrame, key: str) -> DataFrame:
    return documents.sparkSession.createDataFrame([], f"{key} {dict(documents.dtypes)[key]}, subject string")


def assign_subjects(documents: DataFrame, key: str, text: str, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """key, subject: one row per document and area. labels: the key and subject of documents labelled by hand."""
    keys, read, openings = _analyse(documents, key, text, None)
    model, rows = _fit(keys, read, openings, key, labels, sorted(set(subjects)))
    return _areas(keys, key, rows, model) if model else _empty(documents, key)


def fit_subjects(documents: DataFrame, key: str, text: str, labels: DataFrame, subjects: list[str]) -> Model | None:
    """The model of a corpus, for documents that come later; None if nothing can be learned."""
    keys, read, openings = _analyse(documents, key, text, None)
    return _fit(keys, read, openings, key, labels, sorted(set(subjects)))[0]


def assign(documents: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """key, subject of any documents by a model: one pass over their texts, nothing is learned from them."""
    keys, read, _ = _analyse(documents, key, text, model.openings)
    return _areas(keys, key, spread(_encode(read, model.columns)), model)


def _fit(keys: DataFrame, read: DataFrame, openings: Openings, key: str, labels: DataFrame, names: list[str]) -> tuple[Model | None, DataFrame]:
    """The model, and the different texts with their terms as columns."""
    spark = read.sparkSession
    if not names:
        return None, read
    nl, na = len(LANGUAGES), len(names)

    # Texts by language and term; terms that are frequent enough in some language are carried on, as columns.
    total, documents_ = np.zeros((nl, 1)), np.zeros((nl, 1))
    for r in read.select(F.explode("spoken").alias("lang"), "copies").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("m")).collect():
        total[r["lang"]], documents_[r["lang"]] = r["n"], r["m"]
    # Copies count for the lower limit alone: a text that comes often is not rare.
    least = np.maximum(np.clip(FEW * documents_, 1, LEAST), LEAST_PART * documents_)
    counts = spread(read.select("copies", "langs", "terms")).mapInArrow(_counted, "lang int, term bigint, texts bigint, documents bigint")
    counts = counts.groupBy("lang", "term").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    limit = F.element_at(F.array(*(F.lit(float(x)) for x in least[:, 0])), F.col("lang") + 1)
    table = counts.filter(F.col("documents") >= limit).select("lang", "term", "texts").toArrow()
    lang, term, has = (table.column(x).to_numpy() for x in ("lang", "term", "texts"))
    columns, at = np.unique(term, return_inverse=True)
    if not len(columns):
        return None, read
    weight = np.zeros((nl, len(columns)), dtype=np.float32)
    weight[lang, at] = np.log1p((total[lang, 0] + 1) / (has + 1) * np.exp(-BEND))
    sc = spark.sparkContext
    rows = spread(_encode(read, columns))

    # Leading right singular vectors of documents x terms, unit rows, by block power iteration. How heavy sentences are
    # depends on the weights alone, so the first pass finds it out, too.
    def times(q: np.ndarray, weigh: bool = False) -> Arrays:
        shared = sc.broadcast((q.astype(np.float32), weight))

        def run(batches):
            basis, w = shared.value
            out, bins = np.zeros(basis.shape, dtype=np.float64), np.zeros(nl * _BINS, dtype=np.int64)
            for c in _chunks(batches):
                spoken = c.lang[c.owner]
                each = w[spoken, c.column]
                if weigh:
                    heavy = np.sqrt(np.bincount(c.owner, weights=each.astype(np.float64) ** 2, minlength=len(c.lang)))
                    bins += np.bincount(c.lang * _BINS + np.minimum(heavy / _STEP, _BINS - 1).astype(np.int64), minlength=nl * _BINS)
                # Documents of a language share many terms, so they are a full matrix of those that occur; a term that comes again is put down once.
                for k in np.unique(spoken):
                    on = np.flatnonzero(spoken == k)
                    docs, row = _ranks(c.doc[c.owner[on]], c.n)
                    column, at = _ranks(c.column[on], len(basis))
                    x = np.zeros((len(docs), len(column)), dtype=np.float32)
                    x[row, at] = each[on]
                    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
                    # Copies of a text weigh as their root: it has a place of its own, and doesn't drown the others.
                    y = (x @ basis[column]) * np.sqrt(c.copies[docs], dtype=np.float32)[:, None]
                    out[column] += x.T @ y
            return {"q": out.astype(np.float32)} | ({"bins": bins} if weigh else {})

        made = _summed(rows, run)
        shared.destroy()
        return made | {"q": made["q"].astype(np.float64)}

    q = np.linalg.qr(np.random.default_rng(0).standard_normal((len(columns), min(RANK, len(columns)))))[0]
    for turn in range(TURNS):
        made = times(q, weigh=turn == 0)
        bins = made.get("bins", bins if turn else None)
        before, q = q, np.linalg.qr(made["q"])[0]
        # The part of the new subspace that lies in the one before.
        if np.square(before.T @ q).sum() / q.shape[1] > STILL:
            break
    at = np.array([np.searchsorted(np.cumsum(b), 0.7 * b.sum()) for b in bins.reshape(nl, _BINS)]) * _STEP
    heavy_enough = HEAVY * at
    small = q.T @ times(q)["q"]
    values, turn = np.linalg.eigh((small + small.T) / 2)
    basis, scale = (q @ turn).astype(np.float32), (np.maximum(values, 1e-9) ** 0.25).astype(np.float32)

    # Seeds from the labelled documents, and how heavy sentences are.
    known = labels.select(F.col(key).alias("k"), "subject").filter(F.col("subject").isin(names))
    known = known.groupBy("k").agg(F.array_sort(F.collect_set("subject")).alias("areas"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(LABELLED)
    # Documents of one text are one seed, to each area by the part of them that has it.
    known = keys.join(F.broadcast(known), "k").select("h", F.explode("areas").alias("area"), (1 / F.size("areas")).alias("w"))
    known = known.groupBy("h", "area").agg(F.sum("w").alias("w")).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("area", "w"))).alias("areas"))
    typical = np.ones((nl, len(columns)), dtype=np.float32)
    shared = sc.broadcast((weight, 1.0, basis, scale))

    def seed(batches):
        space, out = _Space(*shared.value), np.zeros((nl, na, len(scale)))
        for c in _chunks(batches):
            areas = c.batch.column("areas").to_pylist()
            v, heavy, share = space.place(c)
            part = np.zeros((c.n, na))
            for i, own in enumerate(areas):
                for a in own:
                    part[i, names.index(a["area"])] = a["w"] / sum(x["w"] for x in own)
            on = np.flatnonzero((heavy > heavy_enough[c.lang]) & (share > SHARE))
            for k in np.unique(c.lang[on]):
                own = on[c.lang[on] == k]
                out[k] += part[c.doc[own]].T @ v[own]
        return {"sum": out}

    made = _summed(rows.join(F.broadcast(known), "h"), seed)
    shared.destroy()
    if "sum" not in made or not made["sum"].any():
        return None, read
    centroids = _unit(made["sum"])

    def state():
        return sc.broadcast(((weight, typical, basis, scale), centroids, heavy_enough))

    for turn in range(ROUNDS):
        now = state()

        def refine(batches, now=now):
            parts, centre, e = now.value
            space = _Space(*parts)
            sums = np.zeros((nl, na, centre.shape[-1]))
            width = parts[0].shape[1]
            seen, mine = np.zeros(nl * width, dtype=np.int32), np.zeros((na, nl * width), dtype=np.int32)
            for c in _chunks(batches):
                doc, lang, v, best = _assigned(space, centre, e, c)
                to = np.zeros((nl * na, len(v)), dtype=np.float32)
                to[lang * na + best, np.arange(len(v))] = 1
                sums += (to @ v).reshape(sums.shape)
                about = _about(c.n, na, doc, best)
                on = np.flatnonzero(about.any(1)[c.doc[c.owner]])
                found = np.unique((c.doc * nl + c.lang)[c.owner[on]] * width + c.column[on])
                doc, place = found // (nl * width), found % (nl * width)
                np.add.at(seen, place, 1)
                i, a = np.nonzero(about[doc])
                np.add.at(mine, (a, place[i]), 1)
            mine = mine.reshape(na, nl, width).transpose(1, 0, 2)
            return {"sum": sums, "seen": seen.reshape(nl, width), "mine": np.ascontiguousarray(mine)}

        r = _summed(rows, refine)
        now.destroy()
        moved = np.linalg.norm(r["sum"], axis=-1, keepdims=True) > 0
        before, centroids = centroids, np.where(moved, _unit(r["sum"]), centroids)
        # A term of which most texts are about one area is typical; one that is everywhere alike is not. Few texts say
        # little: to them comes the largest area's part of its language's terms.
        usual = r["mine"].sum(2).max(1) / np.maximum(r["seen"].sum(1), 1)
        typical = np.clip(((r["mine"].max(1) + 1.5 * usual[:, None]) / (r["seen"] + 1.5) - 0.4) / 0.35, 0, 1).astype(np.float32)

        if (before * centroids).sum(-1)[moved[..., 0]].min(initial=1.0) > STILL and turn:
            break

    return Model(names, openings, columns, weight, typical, basis, scale, centroids, heavy_enough), rows
