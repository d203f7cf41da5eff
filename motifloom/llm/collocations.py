"""Phrase collocations of each language, from sketch bounds and automata.

Single words are counted as they are.  Candidates come from a sketch: every phrase of two to ``longest`` words is hashed
to a cell, and a cell's sum bounds the count of all its phrases from above.  The sketch is a table of partial cells that
executors sum, so its width follows the text: some cells for each phrase.  Phrases of three words and more enter it only
where all their pairs of words lie in cells that reach ``min_count``.  The cells that reach it become two tables of bits,
one for pairs and one for longer phrases; a phrase whose bits are set is a candidate.  Every task compiles the candidates
of its own texts into Aho-Corasick automata, some megabytes of text at a time, with a space before and after each phrase
and a border mark between pieces, so that matches are of whole words within a piece.  It scans these texts once and
counts all matches, overlaps included.  All tasks see the same bits, so no occurrence of a candidate is missed; the
counts of tasks are summed by phrase, and thresholds are applied to the exact sums.  A text is read as often whatever
the number of candidates, and no task, nor the driver, holds the candidates of all texts.  At most ``automaton_limit``
phrases are compiled at a time.  The tables have 16 bits or more for each of ``heavy_limit`` cells; of more cells, more
phrases are candidates by chance, which costs work and changes no result.

Texts are lower-cased from A to Z only and split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at spaces and tabs.
A null text is empty, a null language is ``und``; texts without words add nothing and an empty table gives no rows.
Repeated rows count as often as they occur.  Ties of score and count are ordered by the bytes of the phrase.  Very long
texts and words are read whole.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.shared import written

CHUNKS = 11  # bits of a chunk's number, at least; partial sketches are summed by chunks
CHUNK = 1 << 22  # cells that occur in a chunk, about, where these are more
FLUSH = 1 << 22  # phrases that a task holds before it sends their cells
SLICE = 1 << 22  # bytes of texts read at a time, but for longer texts
PART = 1 << 20  # bytes hashed at a time, but for longer pieces
BLOCK = 1 << 23  # bytes of text, about, for which automata are made
HELD = 1 << 19  # counted phrases that a task holds before it sends them
GROUPS = 512  # groups of phrases in which counts are summed, at least
GROUP = 1 << 26  # bytes of text for each group, where these are more
PIECE = 1 << 15  # words of 64 bits in a piece of a table of bits
SALTS = 64  # parts in which the best phrases of a language are chosen before they are ranked

_MARK = b"."
_PIECES = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_SPACE = 32
_random = np.random.default_rng(17)
_BYTES = _random.integers(0, 1 << 64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def prepared(texts: list[bytes]) -> np.ndarray:
    """The bytes of some texts in lower case, one space before and after each word; a full stop, which no word holds, is
    a word between pieces."""
    joined = _MARK.join(texts).lower().translate(_PIECES).replace(_MARK, b" . ")
    buffer = np.frombuffer(b" %b " % joined, np.uint8)
    space = buffer == _SPACE
    return buffer[~space | np.append(True, ~space[:-1])]


def parts(buffer: np.ndarray) -> Iterator[np.ndarray]:
    """A prepared buffer cut between pieces into parts of about ``PART`` bytes."""
    marks, at = np.flatnonzero(buffer == _MARK[0]), 0
    while len(buffer) - at > PART and (i := np.searchsorted(marks, at + PART)) < len(marks):
        end = int(marks[i]) + 1  # the space after a mark ends a part and begins the next
        yield buffer[at : end + 1]
        at = end
    yield buffer[at:]


@dataclass(frozen=True)
class Words:
    """Where the words of a prepared buffer begin and end, which are marks, and their hashes."""

    start: np.ndarray
    end: np.ndarray
    inside: np.ndarray
    code: np.ndarray


def words_of(buffer: np.ndarray) -> Words:
    space = np.flatnonzero(buffer == _SPACE)
    start, end = space[:-1] + 1, space[1:]
    # a word's hash is a polynomial of its bytes: a difference of running sums, shifted back to the word's begin
    power = np.cumprod(np.full(len(buffer), _STEP))
    sums = np.append(np.uint64(0), np.cumsum(_BYTES[buffer] * power))
    back = np.cumprod(np.full(len(buffer), _BACK))
    return Words(start, end, (end - start > 1) | (buffer[start] != _MARK[0]), (sums[end] - sums[start]) * back[start])


def cells_of(hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Cells of phrases of n words: those of the two sketches are apart."""
    return (hashes >> np.uint64(64 - bits)) << np.uint64(1) | np.uint64(n > 2)


def phrases(words: Words, lang: str, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words of a phrase, where phrases begin, their hashes) for each length, within pieces."""
    code, valid = words.code * _STEP + np.uint64(xxhash.xxh64_intdigest(lang.encode())), words.inside
    for n in range(1, longest + 1):
        if n > 1:
            code = code[:-1] * _STEP + (words.code[n - 1 :] ^ _MIX)
            valid = valid[:-1] & words.inside[n - 1 :]
        at = np.flatnonzero(valid)
        h = code[at]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        yield n, at, h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Bits:
    """A table of bits for the cells of a set, of 2 ** ``width`` words: a cell has two bits of one word.  Cells of the set
    are always found, others by chance."""

    width: int
    words: np.ndarray

    @staticmethod
    def of(cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of cells and their bits there."""
        cells = cells >> np.uint64(1)
        high, one, low = cells >> np.uint64(width), np.uint64(1), np.uint64(63)
        return (cells & np.uint64((1 << width) - 1)).astype(np.int64), (one << (high & low)) | (one << ((high >> np.uint64(6)) & low))

    def has(self, cells: np.ndarray) -> np.ndarray:
        at, own = self.of(cells, self.width)
        return self.words[at] & own == own


class Pieces:
    """The pieces of a table of bits from its cells, which come sorted by piece."""

    def __init__(self, width: int) -> None:
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words = None, None
        for batch in batches:
            piece, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64)
            for own in np.unique(piece).tolist():
                if own != at:
                    if words is not None:
                        yield self.row(at, words)
                    at, words = own, np.zeros(min(PIECE, 1 << self.width), np.uint64)
                place, bits = Bits.of(cells[piece == own], self.width)
                np.bitwise_or.at(words, place % len(words), bits)
        if words is not None:
            yield self.row(at, words)

    def row(self, piece: int, words: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([words.tobytes()], pa.binary())], names=["piece", "words"])


def bits_of(cells: DataFrame, room: int) -> Bits:
    """The table of bits of ``cells``: executors make its pieces."""
    width = max(10, (min(cells.count(), room) // 4).bit_length())
    piece = F.expr(f"cast((cell div 2) % {1 << width} div {PIECE} AS long)").alias("piece")
    made = cells.select(piece, "cell").repartition("piece").sortWithinPartitions("piece").mapInArrow(Pieces(width), "piece long, words binary").toArrow()
    words = np.zeros(1 << width, np.uint64)
    for piece, own in zip(made["piece"].to_pylist(), made["words"].to_pylist()):
        words[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(own, np.uint64)
    return Bits(width, words)


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """The prepared texts of each language, some documents at a time."""
    found, size = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            if text := text.as_py():
                found[lang].append(text)
                size += len(text)
                if size >= SLICE:
                    yield from ((lang, prepared(own)) for lang, own in found.items())
                    found, size = defaultdict(list), 0
    yield from ((lang, prepared(own)) for lang, own in found.items())


def paired(n: int, at: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Which phrases of n words, beginning at some places, have all their pairs among those marked in ``pair``."""
    out = pair[at]
    for k in range(1, n - 1):
        out = out & pair[at + k]
    return out


class Sketch:
    """Partial sketches: the cells of a task's phrases and how often each occurs."""

    def __init__(self, orders: tuple[int, ...], bits: int, chunk_bits: int, gate=None) -> None:
        self.orders, self.bits, self.chunk_bits, self.gate = orders, bits, chunk_bits, gate

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        heavy = self.gate.value if self.gate else None
        for lang, buffer in by_lang(batches):
            for part in parts(buffer):
                words = words_of(part)
                pair = np.zeros(len(words.code) + 1, bool)
                for n, at, h in phrases(words, lang, self.orders[-1]):
                    if heavy and n == 2:
                        pair[at] = heavy.has(cells_of(h, n, self.bits))
                    if n in self.orders:
                        held.append(cells_of(h[paired(n, at, pair)] if heavy else h, n, self.bits))
                        size += len(held[-1])
                if size >= FLUSH:
                    yield from self.partial(held)
                    held, size = [], 0
        if size:
            yield from self.partial(held)

    def partial(self, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells, count = np.unique(np.concatenate(held), return_counts=True)
        chunk = (cells >> np.uint64(self.chunk_bits)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        low, ends = (cells & np.uint64((1 << self.chunk_bits) - 1)).astype(np.uint32), np.append(start[1:], len(cells))
        small = np.minimum(count, 255).astype(np.uint8)
        many, more = count >= 255, count[count >= 255].astype(np.uint32)  # a byte for most counts
        before = np.append(0, np.cumsum(many))
        for i in range(0, len(start), 4096):
            own = list(zip(start[i : i + 4096].tolist(), ends[i : i + 4096].tolist()))
            columns = [[low[s:e].tobytes() for s, e in own], [small[s:e].tobytes() for s, e in own], [more[before[s] : before[e]].tobytes() for s, e in own]]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[start[i : i + 4096]]), *(pa.array(c, pa.binary()) for c in columns)], names=["chunk", "cells", "counts", "more"])


def summed(enough: int, chunk_bits: int):
    """Sums the partial chunks, which come sorted, and returns the cells that reach ``enough``."""

    def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        cells, count = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        start = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        return cells[start], np.add.reduceat(count[order], start)

    def heavy(chunk: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        cells, total = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(cells[total >= enough].astype(np.int64) + (chunk << chunk_bits))], names=["cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            for chunk, cells, counts, more in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if chunk != at:
                    if held:
                        yield heavy(at, held)
                    at, held, size = chunk, [], 0
                own, count = np.frombuffer(cells, np.uint32), np.frombuffer(counts, np.uint8).astype(np.int64)
                count[count == 255] = np.frombuffer(more, np.uint32)
                held.append((own, count))
                size += len(own)
                if size > 2 * CHUNK:
                    held = [merged(held)]
                    size = len(held[0][0])
        if held:
            yield heavy(at, held)

    return run


class Totals:
    """What a task counted: the phrases of each language, sent in groups by a hash, a row for each group and language."""

    def __init__(self, groups: int) -> None:
        self.groups, self.counts, self.size = groups, defaultdict(dict), 0

    def add(self, lang: str, phrases: list[bytes], counts: list[int]) -> None:
        own = self.counts[lang]
        before = len(own)
        for phrase, k in zip(phrases, counts):
            own[phrase] = own.get(phrase, 0) + k
        self.size += len(own) - before

    def sent(self) -> Iterator[pa.RecordBatch]:
        for lang, own in self.counts.items():
            phrases, counts = list(own), np.fromiter(own.values(), np.int64, len(own))
            group = np.fromiter(map(crc32, phrases), np.int64, len(phrases)) % self.groups
            order = np.argsort(group, kind="stable")
            group, counts, names = group[order], counts[order], [phrases[i] for i in order.tolist()]
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            own = list(zip(start.tolist(), [*start[1:].tolist(), len(group)]))
            columns = [[b"\n".join(names[s:e]) for s, e in own], [counts[s:e].tobytes() for s, e in own]]  # no phrase holds a line feed
            yield pa.RecordBatch.from_arrays([pa.array(group[start]), pa.array([lang] * len(own), pa.string()), *(pa.array(c, pa.binary()) for c in columns)], names=["group", "lang", "phrases", "counts"])
        self.counts.clear()
        self.size = 0


def totals(least: int):
    """Sums the groups of counts, which come sorted by group and language, and returns the phrases that reach ``least``."""

    def rows(lang: str, own: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        found = [(phrase, k) for phrase, k in own.items() if k >= least]
        for i in range(0, len(found), 1 << 14):
            phrases, counts = zip(*found[i : i + (1 << 14)])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}
        for batch in batches:
            for group, lang, phrases, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (group, lang) != at:
                    if at:
                        yield from rows(at[1], own)
                    at, own = (group, lang), {}
                for phrase, k in zip(phrases.split(b"\n"), np.frombuffer(counts, np.int64).tolist()):
                    own[phrase] = own.get(phrase, 0) + k
        if at:
            yield from rows(at[1], own)

    return run


class SingleWords:
    """The words of each language and how often a task meets them."""

    def __init__(self, groups: int) -> None:
        self.groups = groups

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Totals(self.groups)
        for lang, buffer in by_lang(batches):
            for part in parts(buffer):
                words, text = words_of(part), part.tobytes()
                at = np.flatnonzero(words.inside)
                _, first, count = np.unique(words.code[at], return_index=True, return_counts=True)
                first = at[first]
                found.add(lang, [text[s:e] for s, e in zip(words.start[first].tolist(), words.end[first].tolist())], count.tolist())
                if found.size >= HELD:
                    yield from found.sent()
        yield from found.sent()


@dataclass
class Block:
    """Texts of a language and the candidates in them, by hash."""

    texts: list[bytes] = field(default_factory=list)
    names: dict[int, bytes] = field(default_factory=dict)


class Candidates:
    """Counts the phrases whose bits are set, with automata of the candidates in the texts at hand."""

    def __init__(self, bits: int, longest: int, pairs, longer, groups: int, limit: int) -> None:
        self.bits, self.longest, self.pairs, self.longer, self.groups, self.limit = bits, longest, pairs, longer, groups, limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, size, named, found = defaultdict(Block), 0, 0, Totals(self.groups)

        def scanned() -> Iterator[pa.RecordBatch]:
            for lang, block in blocks.items():
                names = sorted(block.names.values())  # neighbours in the trie follow one another
                for at in range(0, len(names), self.limit):
                    found.add(lang, own := names[at : at + self.limit], matches(own, block.texts).tolist())
                    if found.size >= HELD:
                        yield from found.sent()
            blocks.clear()

        for lang, buffer in by_lang(batches):
            for part in parts(buffer):
                text = part.tobytes()
                named += self.name(lang, part, text, blocks[lang])
                size += len(text)
                if size >= BLOCK or named >= self.limit:
                    yield from scanned()
                    size = named = 0
        yield from scanned()
        yield from found.sent()

    def name(self, lang: str, part: np.ndarray, text: bytes, block: Block) -> int:
        """Adds a part and its candidates to a block; how many of these are new there."""
        words = words_of(part)
        pair, known = np.zeros(len(words.code) + 1, bool), block.names
        before = len(known)
        block.texts.append(text)
        for n, at, h in phrases(words, lang, self.longest):
            if n == 1:
                continue
            if n == 2:
                pair[at] = self.pairs.value.has(cells_of(h, n, self.bits))
            hit = np.flatnonzero(paired(n, at, pair))  # what the sketch did not count is none
            if n > 2:
                hit = hit[self.longer.value.has(cells_of(h[hit], n, self.bits))]
            codes, first = np.unique(h[hit], return_index=True)
            places = at[hit[first]]
            for code, s, e in zip(codes.tolist(), words.start[places].tolist(), words.end[places + n - 1].tolist()):
                if code not in known:
                    known[code] = text[s:e]
        return len(known) - before


def matches(names: list[bytes], texts: list[bytes]) -> np.ndarray:
    """How often each phrase occurs in the texts, in which bytes stand for characters."""
    automaton, value = ahocorasick.Automaton(ahocorasick.STORE_INTS), itemgetter(1)
    for i, name in enumerate(names):
        automaton.add_word(f" {name.decode('latin-1')} ", i)
    automaton.make_automaton()
    counts = np.zeros(len(names), np.int64)
    for text in texts:
        found = np.fromiter(map(value, automaton.iter(text.decode("latin-1"))), np.int32)
        counts += np.bincount(found, minlength=len(names))
    return counts


def counted(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, longest: int = 4, heavy_limit: int = 1 << 26, automaton_limit: int = 1 << 19, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of every phrase of one to ``longest`` words that occurs at least ``min_count`` times in
    its language, and (lang, n), the words of each language.  ``bits``: of a cell's number."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits or min(50, max(20, math.ceil(math.log2(max(size, 1))) + 3))
    chunk_bits = min(32, max(0, bits + 1 - max(CHUNKS, math.ceil(math.log2(max(size, 1) / CHUNK + 1)))))
    groups = max(GROUPS, size // GROUP)

    def sketch(orders: tuple[int, ...], gate=None):
        """The table of bits of the cells that reach ``min_count``."""
        partial = texts.mapInArrow(Sketch(orders, bits, chunk_bits, gate), "chunk long, cells binary, counts binary, more binary")
        partial = partial.repartition("chunk").sortWithinPartitions("chunk")
        return sc.broadcast(bits_of(written(partial.mapInArrow(summed(min_count, chunk_bits), "cell long"), "cells"), heavy_limit))

    def exact(count, least: int, name: str) -> DataFrame:
        """(lang, phrase, k) of what ``count`` counts, where it reaches ``least``."""
        partial = texts.mapInArrow(count, "group long, lang string, phrases binary, counts binary")
        partial = partial.repartition("group").sortWithinPartitions("group", "lang")
        return written(partial.mapInArrow(totals(least), "lang string, phrase string, k long"), name)

    words = exact(SingleWords(groups), 1, "words")
    pairs = sketch((2,))
    longer = sketch(tuple(range(3, longest + 1)), pairs) if longest > 2 else pairs
    counts = exact(Candidates(bits, longest, pairs, longer, groups, automaton_limit), min_count, "counts")
    counts = words.where(F.col("k") >= min_count).unionByName(counts)
    own = counts.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), F.col("k").alias("f"))
    return written(own, "phrases"), words.groupBy("lang").agg(F.sum("k").alias("n"))


def mine(docs: DataFrame, *, min_score_unit: int = 2_000_000, inside_percent: int = 80, top: int = 2000, **options) -> DataFrame:
    """The best phrases of two words and more of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its worst cut, of which ``score`` is
    ``min_score_unit * a / (l + r)``, rounded down.  A phrase that lies in a longer one which occurs at least
    ``inside_percent`` times in a hundred of its own occurrences is left to that one.  Sums are exact decimals."""
    f, words = counted(docs, **options)
    rows = f.where("size > 1").withColumnRenamed("f", "a").withColumn("ws", F.split("phrase", " "))

    def joined(start, length):
        return F.array_join(F.slice("ws", start, length), " ")

    cuts = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size")).alias("rest"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"(cast(a AS decimal(20, 0)) * {min_score_unit}) div (cast(l AS decimal(20, 0)) + r)")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(worst).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")

    inside = rows.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inside = inside.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inside = inside.select("lang", joined(F.col("s"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left_to = F.expr(f"cast(longer AS decimal(20, 0)) * 100 >= cast(a AS decimal(20, 0)) * {inside_percent}")
    own = scored.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(left_to, F.lit(False)))

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    own = own.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("place") <= top)
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return own.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
